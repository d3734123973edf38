"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes with counts
of the bytes that followed them. A byte's probability is looked up in the
longest context that the language knows; a byte not seen there costs an escape
to the next shorter context, down to equal chances for all bytes. Escapes
follow method C (distinct followers over followers plus distinct followers),
and bytes that a longer context offers are excluded from the shorter ones. The
counts are frozen after training, so that the code length of a text is exact:
it is the sum, over its bytes, of code lengths that depend on the last
``ORDER`` bytes only. These are tabulated once a worker for every known
context, byte and language; a text then costs a few look-ups a byte.

A text is predicted to be in the language with the shortest code length (ties
to the smaller name); the score is that language's share of the sum of
2 ** -length over all languages.

The trees are fitted on a bounded sample: of each language, about ``SAMPLE``
documents, those with the smallest hashes of id and text, whole texts, so that
the tables don't grow with the corpus. All texts are predicted, whole.

Defined cases: a null text or one without a letter is ``und`` with score 0;
with no training row at all every text is ``und``; null languages are no
training rows; repeated rows are predicted alike; extra columns are kept by
``predict`` (columns named like its results are replaced).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, utf8, worker_state

ORDER = 3
SAMPLE = 250
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, count): n bytes of context and one byte, packed in a long."""

    def grams(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                for n in range(order + 1):
                    parts = []
                    for i in np.flatnonzero(langs == lang):
                        x = data[offsets[i]: offsets[i + 1]].astype(np.int64)
                        x = np.concatenate([np.zeros(order, np.int64), x])  # a text begins after zero bytes
                        parts.append(sum(x[order - j: len(x) - j] << (8 * j) for j in range(n + 1)))
                    gram, count = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array([n] * len(gram), pa.int32()),
                         pa.array(gram), pa.array(count.astype(np.int64))], names=["lang", "n", "gram", "count"])

    return (rows.mapInArrow(grams, "lang string, n int, gram long, count long")
            .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")))


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, order: int = ORDER) -> dict:
    """The frozen counts: {"langs": [...], "order": k, "grams": {n: (gram, lang, count)}}.

    Of a language with n rows, a row is in the sample if its hash falls in the
    lowest ``sample / n`` of all hashes: about ``sample`` rows at any n.
    """
    ready(documents.sparkSession)
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    n_rows = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n_rows:
        return {"langs": [], "order": order, "grams": {}}
    langs = sorted(n_rows)
    most = {x: min((1 << 63) - 1, int(sample / n * 2.0 ** 64) - (1 << 63)) for x, n in n_rows.items()}
    chosen = rows.where(F.greatest(F.lit(False), *[(F.col("lang") == x) & (F.col("h") <= most[x]) for x in langs]))
    found = _counts(chosen.select("lang", "text"), order).toPandas()
    number = {x: i for i, x in enumerate(langs)}
    found["lang"] = found["lang"].map(number)
    found = found.sort_values(["n", "gram", "lang"])
    return {"langs": langs, "order": order, "key": uuid.uuid4().hex,
            "grams": {int(n): tuple(np.ascontiguousarray(g[c].to_numpy(np.int64)) for c in ("gram", "lang", "count"))
                      for n, g in found.groupby("n")}}


def code_lengths(counts: list[np.ndarray]) -> np.ndarray:
    """Bits of each of 256 bytes after contexts given as counts from the longest to the empty one.

    ``counts``: arrays of (contexts, 256), one for each order; an unknown
    context has zeros only and costs nothing.
    """
    bits = np.zeros(counts[0].shape)
    left = np.ones(counts[0].shape, bool)  # bytes that no longer context has offered
    for c in counts:
        c = np.where(left, c, 0)
        seen = c > 0
        total, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        known = total > 0
        with np.errstate(divide="ignore"):
            bits += np.where(seen, np.log2(total + kinds) - np.log2(np.maximum(c, 1)), 0)
            escape = np.where(known, np.log2(total + kinds) - np.log2(np.maximum(kinds, 1)), 0)
        left = left & ~seen
        # with every byte offered there is nothing to escape to
        bits += np.where(left, escape, 0)
    return bits + np.where(left, np.log2(np.maximum(left.sum(1, keepdims=True), 1)), 0)


class Tables:
    """Code lengths of every known context, byte and language, and where to find a context."""

    def __init__(self, model: dict):
        self.langs, self.order = model["langs"], model["order"]
        n_langs = len(self.langs)
        level = []  # by order: contexts in rising order, counts (langs, contexts, 256)
        for n in range(self.order + 1):
            gram, lang, count = model["grams"][n]
            contexts, at = np.unique(gram >> 8, return_inverse=True)
            c = np.zeros((n_langs, len(contexts), 256), np.int32)
            c[lang, at, gram & 255] = count
            level.append((contexts, c))
        n_contexts = sum(len(contexts) for contexts, _ in level)
        kind = np.uint16 if n_contexts <= 1 << 16 else np.int32
        self.node = np.zeros(1 << (8 * self.order), kind)
        self.bits = np.empty((n_contexts, 256, n_langs), np.float32)
        first = 0
        for n in range(self.order + 1):
            contexts = level[n][0]
            table = self.bits[first: first + len(contexts)]
            for lang in range(n_langs):
                for a in range(0, len(contexts), 2048):
                    own = contexts[a: a + 2048]
                    chain = []
                    for m in range(n, -1, -1):
                        shorter = own & ((1 << (8 * m)) - 1)
                        chain.append(level[m][1][lang][np.searchsorted(level[m][0], shorter)])
                    table[a: a + 2048, :, lang] = code_lengths(chain)
            # each context takes over from the shorter one it ends in
            view = self.node.reshape(-1, 1 << (8 * n))
            view[:, contexts] = np.arange(first, first + len(contexts), dtype=kind)
            first += len(contexts)
        self.bits = self.bits.reshape(-1, n_langs)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text (rows) under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for a in range(0, len(data), 1 << 18):
            own = data[a: a + (1 << 18)].astype(np.int32)
            first = int(np.searchsorted(offsets, a, "right")) - 1
            last = int(np.searchsorted(offsets, a + len(own), "left"))
            starts = offsets[first:last] - a
            sizes = np.diff(np.append(np.maximum(starts, 0), len(own)))
            within = np.arange(len(own)) - np.repeat(starts, sizes)
            context = np.zeros(len(own), np.int32)
            for j in range(1, self.order + 1):
                before = np.zeros(len(own), np.int32)
                from_ = max(0, j - a)
                before[from_:] = data[a + from_ - j: a + len(own) - j]
                before[within < j] = 0
                context |= before << (8 * (j - 1))
            spent = self.bits[self.node[context].astype(np.int32) * 256 + own].astype(np.float64)
            some = np.flatnonzero(sizes)
            out[first + some] += np.add.reduceat(spent, np.maximum(starts, 0)[some], axis=0)
        return out


def tables_of(shared) -> Tables:
    """The tables of a broadcast model, made once a worker."""
    return worker_state(("language", shared.value["key"]), lambda: Tables(shared.value))


def predict(documents: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """The rows with two more columns: predicted language and score."""
    spark = documents.sparkSession
    ready(spark)
    kept = documents.drop(lang_out, score_out)
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if not model["langs"]:
        return kept.withColumns({lang_out: F.lit(UNKNOWN), score_out: F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    columns = kept.columns
    at = columns.index(text_col)
    flag = "_letter_" + "_".join(columns)  # a name that no column has

    def run(batches):
        tables = tables_of(shared)
        langs = np.array(tables.langs, object)
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            bits = tables.lengths(data, offsets)
            pick = bits.argmin(1)
            share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            letters = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.where(letters, langs[pick], UNKNOWN), pa.string()),
                 pa.array(np.where(letters, share, 0.0))], names=[*columns, lang_out, score_out])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(kept.schema.fields).add(lang_out, StringType()).add(score_out, DoubleType())
    return kept.withColumn(flag, letter).mapInArrow(run, schema)


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    model = train(documents.where(~held_out(F.col(id_col))), id_col, text_col, lang_col, sample, order)
    return predict(documents, model, text_col)
