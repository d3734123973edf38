"""Column -> Column scalar functions."""

from .json import json_path, normalize_item, reply_objects, strip_fence, keep_item
from .text import (clean_phone, collapse_spaces, display_value, flatten_list, format_utc,
                   has_value, is_blank, is_valid_email, mask_pii, normalize_company,
                   py_strip, safe_int, safe_str, title_case, truncate_text, utc_now_text)
from .url import extract_domain

__all__ = [
    "clean_phone", "collapse_spaces", "display_value", "extract_domain", "flatten_list",
    "format_utc", "has_value", "is_blank", "is_valid_email", "json_path", "keep_item",
    "mask_pii", "normalize_company", "normalize_item", "py_strip", "reply_objects",
    "safe_int", "safe_str", "strip_fence", "title_case", "truncate_text", "utc_now_text",
]
