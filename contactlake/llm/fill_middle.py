"""Fill-in-the-middle transformation with Arrow's compute functions.

A text is cut into units: a word with the white space before it, or white
space that ends the text. Two of the n + 1 borders, fixed by a digest of the
document's id, part the units into prefix, middle and suffix, which are put in
the order prefix, suffix, middle (``psm``) or suffix, prefix, middle
(``spm``), each behind its marker; other texts stay plain.

Each Arrow batch runs through whole-column steps: a mark that occurs in no
UTF-8 text is put behind each unit, texts are split at it into lists of units,
the lists are flattened with the row that each unit comes from, a unit's
ordinal is its place less its row's first place, units are filtered by role,
and the lists of a role are rebuilt and joined to one piece a row. Batches are
taken in slices of about ``SLICE`` bytes.

``restore`` is the inverse: the markers of an output part it into its pieces.
A marker starts with a character that it holds nowhere else, and a text that
holds one is plain, so the first match of a marker is always the marker.

Defined cases: a null text is empty; a text without units is plain; texts are
taken whole, whatever their length; a null id has an empty decimal; repeated
rows give repeated results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, utf8

UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50
SPM = 80
SLICE = 4 << 20
_MARK = b"\xff"  # in no UTF-8 text


def _mod(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _role(flat: pa.Array, parent: pa.Array, mask: pa.Array, rows: int) -> pa.Array:
    """The units of one role, joined to a text a row."""
    kept, own = flat.filter(mask), parent.filter(mask).to_numpy()
    ends = np.append(0, np.cumsum(np.bincount(own, minlength=rows)))
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), kept)
    return pc.binary_join(lists, pa.scalar(b"", kept.type)).cast(pa.large_string())


def units(texts: pa.Array) -> pa.Array:
    """The list of units of each text (large_string without nulls), and one empty entry after the last."""
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), UNIT, rb"\0" + _MARK)
    return pc.split_pattern(marked, _MARK)


def _assembled(form: pa.Array, text: pa.Array, prefix: pa.Array, middle: pa.Array, suffix: pa.Array) -> pa.Array:
    kind = pa.large_string()
    p, s, m, none = (pa.scalar(x, kind) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    return pc.if_else(pc.equal(form, "plain"), text, pc.if_else(pc.equal(form, "psm"), psm, spm))


def transformed(texts: pa.Array, draws: list[pa.Array], rate: int, spm: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of texts and the four 32-bit numbers of each."""
    rows = len(texts)
    lists = units(texts)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)  # the entry after the last unit is no unit
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    first = pa.array(np.append(0, np.cumsum(n.to_numpy() + 1))[:-1], pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(flat)), pa.int64()), first.take(parent))
    borders = pc.add(n, 1)
    one, two = _mod(draws[0], borders), _mod(draws[1], borders)
    low = pc.min_element_wise(one, two).take(parent)
    high = pc.max_element_wise(one, two).take(parent)
    before, after = pc.less(ordinal, low), pc.greater_equal(ordinal, high)
    prefix, middle, suffix = (
        _role(flat, parent, mask, rows)
        for mask in (before, pc.and_(pc.invert(before), pc.invert(after)), after))
    plain = pc.greater_equal(_mod(draws[2], pa.scalar(100, pa.int64())), rate)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    plain = pc.or_(plain, pc.equal(pc.binary_length(texts), 0))
    spm_drawn = pc.less(_mod(draws[3], pa.scalar(100, pa.int64())), spm)
    form = pc.if_else(plain, "plain", pc.if_else(spm_drawn, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, _assembled(form, texts, prefix, middle, suffix)]


def _parted(outputs: pa.Array, first: str, second: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The three pieces of outputs that start with ``first`` and go on with ``second`` and the middle's marker."""
    body = pc.binary_replace_slice(outputs.cast(pa.large_binary()), 0, len(first), b"")
    head = pc.split_pattern(body, second.encode(), max_splits=1)
    tail = pc.split_pattern(pc.list_element(head, 1), MIDDLE.encode(), max_splits=1)
    return pc.list_element(head, 0), pc.list_element(tail, 0), pc.list_element(tail, 1)


def restored(outputs: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs were made of."""
    kind, order, found = np.asarray(form.to_pylist(), dtype=object), [], []
    none = pa.scalar(b"", pa.large_binary())
    for name in ("plain", "psm", "spm"):
        at = np.flatnonzero(kind == name)
        own = outputs.take(pa.array(at))
        if name == "plain":
            texts = own.cast(pa.large_binary())
        elif name == "psm":
            prefix, suffix, middle = _parted(own, PREFIX, SUFFIX)
            texts = pc.binary_join_element_wise(prefix, middle, suffix, none)
        else:
            suffix, prefix, middle = _parted(own, SUFFIX, PREFIX)
            texts = pc.binary_join_element_wise(prefix, middle, suffix, none)
        order.append(at)
        found.append(texts)
    back = np.argsort(np.concatenate(order), kind="stable")
    return pa.concat_arrays(found).take(pa.array(back)).cast(pa.large_string())


def _large(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).fill_null("")


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   rate: int = RATE, spm: int = SPM) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output of every row.

    ``rate`` is the share in a hundred of texts that are transformed, ``spm``
    the share in a hundred of these that have the suffix first.
    """
    ready(documents.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *draws)

    def run(batches):
        for batch in batches:
            texts = _large(batch.column(1))
            for a, b in slices(utf8(texts)[1], SLICE):
                made = transformed(texts.slice(a, b - a), [batch.column(k).slice(a, b - a) for k in range(2, 6)], rate, spm)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *made[:-1], made[-1].cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = documents.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
                           ).withColumnRenamed("id", id_col)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """The rows, and the exact text that each output was made of."""
    ready(rows.sparkSession)
    names = [c for c in rows.columns if c != text_col]
    rows = rows.select(*[F.col(f"`{c}`") for c in names])
    at_output, at_form = names.index(output_col), names.index(form_col)

    def run(batches):
        for batch in batches:
            outputs = _large(batch.column(at_output))
            for a, b in slices(utf8(outputs)[1], SLICE):
                text = restored(outputs.slice(a, b - a), batch.column(at_form).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, text.cast(pa.string())], names=[*names, text_col])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))
