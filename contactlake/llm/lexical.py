"""Ranked lexical search: summed accumulators of short lists inside document-at-a-time skipping over long ones.

``build_index`` cuts the corpus into shards of about ``SHARD`` bytes of text
and writes one row a word of a shard: the documents that hold it, in the order
of their ids, and how often. ``search`` finds the ``k`` best documents of each
query:

1. Statistics. Document counts a word, the number of documents and of words
   are sums over the index.
2. Lists. Postings meet the queries' words in an equi-join, so that only the
   lists that are asked for move. Queries are taken in blocks of ``BLOCK``
   (a stated query set against all rows, in blocks); a shard and a block of
   queries make one task group, whose size the shard bounds.
3. Rank. In a shard, lists of at most one in ``SHORT`` documents are summed
   term at a time to accumulators. These are then one iterator among the long
   lists, bounded by its own largest sums. Documents are passed in order,
   ``STEP`` at a time: a step whose bounds together stay below the ``k``-th
   best score so far is skipped in all lists. In others, documents come from
   the accumulators and from the lists that are needed to reach that score;
   the rest is added from the highest bound down, and documents that can't
   reach it any more are left out.
4. Merge. A shard gives ``k`` rows a query at most; a window that cuts each
   task's rows to ``k`` a query before they move takes the best of all.

The score is in 64-bit integers as ``search`` says. Nothing is capped: bounds
are never below a score, so the result is that of scoring everything.

Defined cases: null and empty texts and texts without words are no documents;
queries without words find nothing, as do words that no document holds;
queries with equal ids and texts are one, with equal ids and different texts
two; rows with equal document ids are documents of their own; equal scores go
to the smaller id, null ids last; an empty table gives an empty result; texts
are taken whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready, slices, stored, utf8

K = 10
SHARD = 16 << 20
BLOCK = 1024
SHORT = 32
STEP = 256
K1 = 8  # of 1000 with the length's part of M
B = 75
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the n + 1 offsets of each text's words. Characters beyond ASCII belong to words."""
    data, offsets = utf8(column)
    inside = _INSIDE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]  # a word ends where its text ends
    first = np.flatnonzero(start)
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    ends = np.append(before[first], before[-1]).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_string(), len(first), [
        None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_LOWER[data[inside]].tobytes())])
    return made, np.searchsorted(first, offsets)


def _shard_rows(number: int, ids: pa.Array, held: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """One row a word of the shard, and one of the empty word: the documents' ids and numbers of words."""
    order = pc.sort_indices(ids)  # null ids last
    place = np.empty(len(ids), np.int64)
    place[order.to_numpy()] = np.arange(len(ids))
    n = np.concatenate([x[1] for x in held])
    of = place[np.repeat(np.arange(len(n)), n)]
    coded = pa.chunked_array([x[0] for x in held], pa.large_string()).combine_chunks().dictionary_encode()
    vocabulary = coded.dictionary
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(n) + of, return_counts=True)
    of_word, docs = pairs // len(n), (pairs % len(n)).astype("<i4")
    df = np.bincount(of_word, minlength=len(vocabulary))
    ends = np.append(0, np.cumsum(df))
    total = np.bincount(of_word, weights=tf, minlength=len(vocabulary)).astype(np.int64)
    tf = tf.astype("<i8")
    sizes = np.empty(len(n), "<i8")
    sizes[place] = n
    binary = lambda x, own: pa.Array.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(np.append(ends * x.itemsize, len(x) * x.itemsize + own.nbytes).astype(np.int64).tobytes()),
        pa.py_buffer(x.tobytes() + own.tobytes())]).cast(pa.binary())
    lists = pa.ListArray.from_arrays(pa.array([*[0] * len(ends), len(ids)], pa.int32()), ids.take(order))
    mask = pa.array([True] * len(vocabulary) + [False])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ends), number)), pa.concat_arrays([vocabulary, pa.array([""], pa.large_string())]).cast(pa.string()),
         pa.array(np.append(df, len(n))), pa.array(np.append(total, n.sum())), binary(docs, np.zeros(0, "<i4")),
         binary(tf, sizes), pc.if_else(mask, pa.scalar(None, lists.type), lists)],
        names=["shard", "word", "df", "total", "docs", "tfs", "ids"])


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """shard, word, df, total, docs, tfs, ids: see ``_shard_rows``. Written to the shared folder and read again."""
    spark = documents.sparkSession
    ready(spark)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, size = [], [], 0
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                found, ends = words(batch.column(1).slice(a, b - a))
                n = np.diff(ends)
                some = np.flatnonzero(n)
                ids.append(batch.column(0).slice(a, b - a).take(pa.array(some)))
                held.append((found, n[some]))
                size += int(offsets[b] - offsets[a])
                if size >= shard:
                    yield _shard_rows(number, pa.concat_arrays(ids), held)
                    number, ids, held, size = number + 1, [], [], 0
        if sum(map(len, ids)):
            yield _shard_rows(number, pa.concat_arrays(ids), held)

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"shard long, word string, df long, total long, docs binary, tfs binary, ids array<{kind}>"
    return stored(rows.mapInArrow(run, schema), "lexical-index")


def _query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query, word, n of each query's different words."""

    def run(batches):
        for batch in batches:
            found, ends = words(batch.column(1))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), found.cast(pa.string())], names=["query", "word"])

    return queries.select("query", text_col).mapInArrow(run, "query long, word string").groupBy("query", "word").agg(
        F.count("*").alias("n"))


class Lists:
    """The postings of one shard that a block of queries asks for, with their parts of a score and its bounds."""

    def __init__(self, table: dict, n_docs: int, n_words: int, step: int):
        at = table["word"].index("")
        sizes = np.frombuffer(table["tfs"][at], "<i8")
        self.n = len(sizes)
        if self.n and int(sizes.max()) * B * n_docs >= 1 << 63:
            m = np.array([B * int(x) * n_docs // n_words for x in sizes], np.int64)
        else:
            m = sizes * np.int64(B * n_docs) // np.int64(n_words)
        m += 100 - B
        self.steps = np.arange(0, self.n + step, step)
        self.docs, self.parts, self.cuts, self.most = {}, {}, {}, {}
        for k, (word, w) in enumerate(zip(table["word"], table["w"])):
            if k == at:
                continue
            docs, tf = np.frombuffer(table["docs"][k], "<i4"), np.frombuffer(table["tfs"][k], "<i8")
            parts = np.int64(w) * (np.int64(1_000_000_000) * tf // (1000 * tf + K1 * m[docs]))
            self.docs[word], self.parts[word] = docs, parts
            self.cuts[word], self.most[word] = bounds(docs, parts, self.steps)


def bounds(docs: np.ndarray, parts: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the postings of each step begin, and the largest part in each step (0: none)."""
    cuts = np.searchsorted(docs, steps)
    most = np.zeros(len(steps) - 1, np.int64)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        most[some] = np.maximum.reduceat(parts, cuts[some])
    return cuts, most


def ranked(lists: Lists, query: list[tuple[str, int]], k: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best documents of a shard above 0, best first, equal scores by place."""
    none = np.zeros(0, np.int64)
    query = [(word, n) for word, n in query if word in lists.docs and lists.most[word].any()]
    few = [x for x in query if len(lists.docs[x[0]]) * short <= lists.n]
    many = [x for x in query if len(lists.docs[x[0]]) * short > lists.n]
    # term at a time: sums of the short lists
    docs = np.concatenate([none, *(lists.docs[word] for word, _ in few)]).astype(np.int64)
    parts = np.concatenate([none, *(lists.parts[word] * n for word, n in few)])
    acc_docs, back = np.unique(docs, return_inverse=True)
    acc = np.zeros(len(acc_docs), np.int64)
    np.add.at(acc, back, parts)
    acc_cuts, acc_most = bounds(acc_docs, acc, lists.steps)
    iterators = [(acc_docs, acc, acc_cuts, acc_most, 1)] + [
        (lists.docs[word], lists.parts[word], lists.cuts[word], lists.most[word], n) for word, n in many]
    tops = np.stack([most * n for *_, most, n in iterators])
    reach = tops.sum(axis=0)
    # what the k-th best of the accumulators has already is no more than the k-th best score
    least = int(np.partition(acc, len(acc) - k)[len(acc) - k]) if len(acc) >= k else 1
    best_docs, best = none, none
    for j in np.flatnonzero(reach > 0):  # document at a time, a step of documents at once
        if reach[j] < least:
            continue
        low, high = int(lists.steps[j]), min(int(lists.steps[j + 1]), lists.n)
        order = np.argsort(tops[:, j], kind="stable")
        sums = np.cumsum(tops[order, j])
        rest = int(np.searchsorted(sums, least))  # the lists before it can't reach the score on their own
        score, open_ = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for i in range(len(order) - 1, -1, -1):
            d, s, cuts, _, n = iterators[order[i]]
            a, b = cuts[j], cuts[j + 1]
            if a == b:
                continue
            at = d[a:b] - low
            if i < rest:  # only documents that the lists above have named, and that can still reach the score
                open_ &= score + sums[i] >= least
                if not open_.any():
                    break
            else:
                open_[at] = True
            score[at] += s[a:b] * n
        at = np.flatnonzero(open_ & (score >= least))
        if len(at):
            best_docs, best = np.append(best_docs, at + low), np.append(best, score[at])
            if len(best) > k:
                keep = np.lexsort((best_docs, -best))[:k]
                best_docs, best = best_docs[keep], best[keep]
            if len(best) == k:
                least = max(least, int(best.min()))
    keep = np.lexsort((best_docs, -best))[:k]
    return best_docs[keep], best[keep]


def search(index: DataFrame, queries: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text",
           doc_col: str = "doc_id", block: int = BLOCK, step: int = STEP, short: int = SHORT) -> DataFrame:
    """The query's id under ``id_col``, rank (from 1), the document's id under ``doc_col``, score.

    N documents hold L words; a word that df of them hold weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))). A document of n words that
    holds it tf times gets w ((10**9 tf) div (1000 tf + 8 m)) each time the
    query has it, with m = 25 + (75 n N) div L.
    """
    spark = index.sparkSession
    ready(spark)
    numbered = cut(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct())
    numbered = cut(numbered.withColumn("query", F.monotonically_increasing_id()))
    blocks = 1 + numbered.count() // block
    asked = _query_words(numbered, "query", "text")
    whole = index.where("word = ''").agg(F.sum("df"), F.sum("total")).first()
    n_docs, n_words = whole[0] or 0, whole[1] or 0
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "query-words")
    df = index.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    lists = asked.join(df, "word").groupBy("block", "word").agg(
        F.first(weight).alias("w"), F.collect_list(F.struct("query", "n")).alias("queries"))
    # the empty word stands for the shard's table of documents
    tables = asked.select("block").distinct().select(
        "block", F.lit("").alias("word"), F.lit(0).cast("long").alias("w"), F.array().cast("array<struct<query:bigint,n:bigint>>").alias("queries"))
    asked_lists = stored(lists.unionByName(tables), "query-lists")
    hits = index.select("shard", "word", "docs", "tfs", "ids").join(asked_lists, "word")
    kind = index.schema["ids"].dataType.elementType

    def rank(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in ("word", "w", "docs", "tfs", "queries")}
        held = Lists(columns, n_docs, n_words, step)
        ids = table.column("ids").combine_chunks()
        own = ids.filter(ids.is_valid()).flatten()
        by_query: dict[int, list] = {}
        for word, queries_ in zip(columns["word"], columns["queries"]):
            for x in queries_:
                by_query.setdefault(x["query"], []).append((word, x["n"]))
        found = [(q, *ranked(held, terms, k, short)) for q, terms in by_query.items()]
        sizes = [len(x[1]) for x in found]
        places = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
        return pa.table({"query": pa.array(np.repeat([x[0] for x in found], sizes).astype(np.int64)),
                         "id": own.take(pa.array(places)),
                         "score": pa.array(np.concatenate([np.zeros(0, np.int64), *(x[2] for x in found)]))})

    found = hits.groupBy("shard", "block").applyInArrow(rank, f"query long, id {kind.simpleString()}, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", "found_id")
    return (best.join(numbered.select("query", "id"), "query")
            .select(F.col("id").alias(id_col), "rank", F.col("found_id").alias(doc_col), "score"))
