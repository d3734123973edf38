"""Truth-table schema and the fixed values every operator shares.

Everything under "Fixed values" must keep its exact spelling: stored tables,
uploaded sheets and filter parameters are matched against these strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values (must stay exactly as written)
# --------------------------------------------------------------------------

SN = "S.N."
COMPANY = "Company Name (Based on Website Domain)"
INDUSTRY = "Industry"
REVENUE = "Revenue"
SIZE = "Size"
ADDRESS = "Company Address / Headquarters"
COMPANY_PHONE = "Contact Number (Company)"
LISTED = "Listed Company"
WEBSITE = "Website URLs"
COMPANY_LINKEDIN = "LinkedIn Company Page"
EMPLOYEES = "# Employees"
FIRST = "First Name"
LAST = "Last Name"
TITLE = "Job Title"
EMAIL = "Email ID (unique)"
PERSON_LINKEDIN = "Person LinkedIn Profile"
PERSON_PHONE = "Contact Number (Person)"
COUNTRY = "Country"
STATE = "State"
LEAD_SOURCE = "Lead Source"
CLIENT_TYPE = "Client Type"
UPDATED = "UPDATE AS ON"
EMAIL_SEND = "Email Send (Yes/No)"

# The 23 base columns of the truth table, in table order.
BASE_COLUMNS = [
    SN, COMPANY, INDUSTRY, REVENUE, SIZE, ADDRESS, COMPANY_PHONE, LISTED,
    WEBSITE, COMPANY_LINKEDIN, EMPLOYEES, FIRST, LAST, TITLE, EMAIL,
    PERSON_LINKEDIN, PERSON_PHONE, COUNTRY, STATE, LEAD_SOURCE, CLIENT_TYPE,
    UPDATED, EMAIL_SEND,
]

# Header aliases: a trimmed, lower-cased sheet header equal to one of these
# (or to the lower-cased standard name) is renamed to the standard column.
# Checked in this order; the first standard column that matches wins.
COLUMN_ALIASES: dict[str, list[str]] = {
    EMAIL: ["email", "email address", "e-mail", "email id",
            "email id (unique)", "mail", "email_address"],
    FIRST: ["first name", "firstname", "fname", "given name",
            "first_name", "given_name"],
    LAST: ["last name", "lastname", "lname", "surname",
           "family name", "last_name", "family_name"],
    COMPANY: ["company", "company name", "organization", "organisation",
              "org name", "org", "account", "company_name",
              "organization_name", "organisation_name"],
    WEBSITE: ["website", "domain", "url", "website url", "website_url",
              "website urls", "web", "site", "company website"],
    TITLE: ["title", "job title", "position", "role", "job_title",
            "job", "designation"],
    PERSON_PHONE: ["phone", "phone number", "contact", "contact number",
                   "mobile", "telephone", "tel", "contact_number",
                   "phone_number", "person phone"],
    COMPANY_PHONE: ["company phone", "company contact", "office phone",
                    "company_phone", "office_phone"],
    COUNTRY: ["country", "nation", "country_name"],
    STATE: ["state", "province", "region", "state_name"],
    COMPANY_LINKEDIN: ["company linkedin", "linkedin company",
                       "company_linkedin", "linkedin_company", "org linkedin"],
    PERSON_LINKEDIN: ["linkedin", "linkedin url", "linkedin profile",
                      "person linkedin", "linkedin_url", "linkedin_profile"],
    INDUSTRY: ["industry", "sector", "vertical", "industry_name"],
}

# Search / export parameter name -> column.
FILTER_PARAMS: dict[str, str] = {
    "email": EMAIL,
    "company": COMPANY,
    "country": COUNTRY,
    "first_name": FIRST,
    "last_name": LAST,
    "job_title": TITLE,
    "industry": INDUSTRY,
    "state": STATE,
    "website": WEBSITE,
    "lead_source": LEAD_SOURCE,
    "client_type": CLIENT_TYPE,
    "email_send": EMAIL_SEND,
}

# Provider column suffixes (the prefix is a parameter, see ProviderPrefixes).
PERSON_FIELDS = [
    "Email Status", "Headline", "Seniority", "Departments", "Subdepartments",
    "Functions", "Photo URL", "Twitter URL", "Github URL", "Facebook URL",
    "Is Likely To Engage", "Current Org", "Current Role Start Date",
]
COMPANY_FIELDS = [
    "Primary Domain", "Founded Year", "Alexa Ranking", "SEO Description",
    "Short Description", "Keywords", "Public Ticker", "Public Exchange",
    "Logo URL", "Twitter URL", "Facebook URL", "Department Headcount",
    "Revenue Range", "Employee Range", "Total Funding",
    "Latest Funding Round Date", "Technologies",
]

DEFAULT_LEAD_SOURCE = "Excel Upload"
SCRAPE_LEAD_SOURCE = "Website Scrape"
DEFAULT_EMAIL_SEND = "No"
SKIPPED_NO_IDENTIFIER = "Skipped (no identifier for matching)"
EMAIL_REQUIRED = "Email ID (unique) is required for upsert"
TRUNCATION_MARKER = "\n[... truncated ...]"
DEFAULT_MAX_HTML_CHARS = 120_000
EMAIL_MAX_LENGTH = 254
MAX_PROVIDER_BATCH = 10
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 500
EXPORT_ROW_CAP = 1_000_000
PAGE_SIZES = [25, 50, 100, 500]
EXPORT_SHEET = "Truth Data"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
MSG_MULTIPLE_SHEETS = "Multiple sheets detected; only the first sheet was read."
MSG_DUPLICATE_COLUMNS = ("Duplicate column names detected (e.g. 'Email.1'); "
                         "only the first matching column is used for each field.")
MSG_NO_EMAIL_COLUMN = ("The file must contain an email column (e.g. 'Email', 'Email Address', "
                       "'E-mail'). No rows can be saved without email.")
MSG_NO_EMAIL_DEDUPE = "Email column not found, skipping deduplication"
MSG_NO_NAME_COMPANY_DEDUPE = "Columns {missing} not found, skipping name+company deduplication"
MSG_NO_DATA_EXPORT = "No data to export"
MSG_PROCESSING_FAILED = "Processing failed: {error}"
MSG_REQUEST_FAILED = "Request failed: {error}"
MSG_RETRIES_EXHAUSTED = "Request failed after {attempts} attempts"

# --------------------------------------------------------------------------
# End of fixed values
# --------------------------------------------------------------------------


class ProviderPrefixes:
    """Column-name prefixes of the two provider column families.

    The defaults are neutral; pass the prefixes an existing table already
    uses to keep writing into the same columns.
    """

    def __init__(self, person: str = "Provider Person: ",
                 company: str = "Provider Company: ") -> None:
        self.person = person
        self.company = company

    @property
    def all(self) -> tuple[str, str]:
        return (self.person, self.company)

    def person_columns(self) -> list[str]:
        return [self.person + f for f in PERSON_FIELDS]

    def company_columns(self) -> list[str]:
        return [self.company + f for f in COMPANY_FIELDS]

    def is_provider(self, name: str) -> bool:
        return name.startswith(self.all)

    def family(self) -> str:
        """Shared leading word of both prefixes (used to split the catalog)."""
        a, b = self.person, self.company
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        return a[:i].strip() or a


DEFAULT_PREFIXES = ProviderPrefixes()


def truth_schema(extra_columns: list[str] | None = None) -> T.StructType:
    """Base truth schema: S.N. long, e-mail and timestamp non-null, text elsewhere."""
    fields = []
    for c in BASE_COLUMNS:
        if c == SN:
            fields.append(T.StructField(c, T.LongType(), False))
        elif c in (EMAIL, UPDATED):
            fields.append(T.StructField(c, T.StringType(), False))
        else:
            fields.append(T.StructField(c, T.StringType(), True))
    for c in extra_columns or []:
        fields.append(T.StructField(c, T.StringType(), True))
    return T.StructType(fields)


# Columns the fill-empty merge never touches directly.
UPSERT_SPECIAL = (SN, EMAIL, EMAIL_SEND, UPDATED)
