"""Exact top-k search by tiled matrix products.

Vectors are packed into blocks of at most ``tile`` rows and ``BLOCK_BYTES``.
The cells of a grid are tasks: a block of candidates goes to one row of it and
all columns, a block of queries to one column and all rows, so each query
meets every candidate of its dimension once. Blocks go to their cells by
themselves, not as pairs: a cell holds its queries and the k best found so far
of each, while its candidates pass by, one matrix product a tile. Rows and
columns are chosen so that little is moved (``grid``); what a cell found, k
rows of a query at most, is merged by buckets of queries. Nothing is broadcast.

Components are scaled to floor(scale * x) and kept in 16 bits where all of a
vector fit. Products run in float32 or float64 (BLAS) where every partial sum
is proven to be below 2 ** 24 or 2 ** 53 (no partial sum is larger than the
product of the norms), and in Python integers elsewhere; scores beyond 64 bits
are clamped to the long range.

Defined cases: null vectors, empty vectors, vectors with a null or non-finite
component and rows with a null id take no part; vectors of other lengths are
no candidates of a query; equal scores go to the smaller id; rows with a
query's own id are not its candidates; a repeated row is a candidate each time
it occurs, while queries of the same id are one query (the least vector);
empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, ready, stored

TILE = 2048
QUERIES = 256  # of a cell, in one product
GROUP = 16
BLOCK_BYTES = 1 << 15  # small, since Spark hands a thousand rows to Python at once
PACKED_BYTES = 1 << 22
HELD_BYTES = 3 << 25
BUCKET_ROWS = 1024
MERGE_ROWS = 1 << 16
MOVED = 3.0
SCALE = 1024.0
_LONG = (-(1 << 63), (1 << 63) - 1)
_SMALL = (1 << 15) - 1


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), 0 where that is not finite."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    return np.where(np.isfinite(x), x, 0.0)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of several blocks as one."""
    return tuple(np.concatenate(x) for x in zip(*parts))


def _packed(rows: DataFrame, tile: int, scale: float) -> DataFrame:
    """Rows (id, vector) to (dim, ids, values): blocks of one dimension and one width each, cut by partition."""

    def pack(batches):
        held, n = {}, 0

        def blocks(key, last):
            d, small = key
            ids, x = _joined(held.pop(key))
            most = max(1, min(tile, BLOCK_BYTES // (d * (2 if small else 8))))
            end = len(ids) if last else len(ids) // most * most
            for k in range(0, end, most):
                part = slice(k, min(k + most, end))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d], pa.int32()), pa.array([ids[part].tobytes()], pa.binary()),
                     pa.array([x[part].tobytes()], pa.binary())], names=["dim", "ids", "values"])
            if end < len(ids):
                held[key] = [(ids[end:], x[end:])]

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1)
            offsets = v.offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            whole = _scaled(flat, scale)
            dims = np.diff(offsets)
            none_of = lambda bad: np.diff(np.concatenate([[0], np.cumsum(bad)])[offsets]) == 0
            usable = none_of(~np.isfinite(flat)) & (dims > 0)
            small = none_of(np.abs(whole) > _SMALL)
            for d in np.unique(dims[usable]).tolist():
                for fits in (True, False):
                    at = np.flatnonzero(usable & (dims == d) & (small == fits))
                    if len(at):
                        x = whole[offsets[at][:, None] + np.arange(d)].astype("<i2" if fits else "<f8")
                        held.setdefault((d, fits), []).append((ids[at].astype("<i8"), x))
                        n += x.nbytes
            if n >= PACKED_BYTES:
                many, n = len(held) > 64, 0
                for key in list(held):
                    yield from blocks(key, many)
        for key in list(held):
            yield from blocks(key, True)

    return rows.mapInArrow(pack, "dim int, ids binary, values binary")


def _unpacked(dim: int, ids: pa.Scalar, values: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of a block; components of 16 bits as float32."""
    ids, small = np.frombuffer(ids.as_buffer(), "<i8"), values.as_buffer().size == len(ids.as_buffer()) // 4 * dim
    x = np.frombuffer(values.as_buffer(), "<i2" if small else "<f8").reshape(-1, dim)
    return ids, x.astype(np.float32) if small else x


def _norm(x: np.ndarray) -> float:
    """The largest norm of a row."""
    with np.errstate(over="ignore"):
        return math.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64).max(initial=0.0)) * (1 + 1e-9)


def _products(q: np.ndarray, c: np.ndarray, q_norm: float, c_norm: float) -> np.ndarray:
    """Exact products of whole numbers, as float32, float64 or integers."""
    if max(q_norm, c_norm, q_norm * c_norm) < 2.0 ** 24:
        return q.astype(np.float32, copy=False) @ c.astype(np.float32, copy=False).T
    if q_norm * c_norm < 2.0 ** 53:
        return q.astype(np.float64, copy=False) @ c.astype(np.float64, copy=False).T
    whole = lambda x: np.vectorize(int, otypes=[object])(x)
    return np.clip(whole(q).dot(whole(c).T), *_LONG).astype(np.int64)


def _scores(q: np.ndarray, c: np.ndarray, scale: float) -> np.ndarray:
    q, c = _scaled(q, scale), _scaled(c, scale)
    return _products(q, c, _norm(q), _norm(c)).astype(np.int64)


def merged(lists: np.ndarray, k: int) -> np.ndarray:
    """The k best (query, id, score) rows of each query."""
    if not len(lists):
        return lists
    query, number, score = np.ascontiguousarray(lists.T)
    top, span = score.max(), int(score.max()) - int(score.min()) + 1
    if query.min() >= 0 and (int(query.max()) + 1) * span < 1 << 62:  # query and score in one number; ties are put in order after
        key = query * span + (top - score)
        order = np.argsort(key)
        key = key[order]
        tied = key[1:] == key[:-1]
        tied = np.flatnonzero(np.append(tied, False) | np.append(False, tied))
        some = order[tied]
        order[tied] = some[np.lexsort((number[some], key[tied]))]
    else:
        order = np.lexsort((number, ~score, query))  # ~ falls as the score rises and can't overflow
    lists = lists[order]
    starts = np.flatnonzero(np.diff(lists[:, 0], prepend=lists[0, 0] - 1))
    return lists[np.arange(len(lists)) - np.repeat(starts, np.diff(starts, append=len(lists))) < k]


def _reaching(scores: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """Flat places of the scores that reach their row's ``low`` and, where those are many, may be among the ``most`` best.

    They are few, so most scores are passed over in groups, by their maximum."""
    n, width = scores.shape
    m = width // GROUP
    groups = scores[:, : m * GROUP].reshape(n, GROUP, m)
    tops = groups.max(axis=1)
    reach = np.flatnonzero(tops >= low)
    if len(reach) > 4 * most * n and m > most:
        low = np.maximum(low, np.partition(tops, m - most, axis=1)[:, m - most, None])
        reach = np.flatnonzero(tops >= low)
    row, at = np.divmod(reach, max(1, m))
    some, which = np.nonzero(groups[row, :, at] >= low[row])
    rest_row, rest = np.nonzero(scores[:, m * GROUP:] >= low)
    return np.concatenate([row[some] * width + which * m + at[some], rest_row * width + m * GROUP + rest])


class Best:
    """Queries (of different ids), and the k best candidates found so far of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids)
        self.ids, self.x, self.k, self.norm = ids[order], x[order], k, _norm(x)
        # score and id of the k-th best: what is behind it takes no part any more
        self.low, self.last = (np.full(len(ids), y, np.int64) for y in _LONG)
        self.lists, self.new, self.n_new = np.empty((0, 3), np.int64), [], 0

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        norm = _norm(c)
        same = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = int(np.bincount(same[self.ids[same] == ids]).max(initial=0))  # rows of a query's own id
        for at in range(0, len(self.ids), QUERIES):
            scores = _products(self.x[at: at + QUERIES], c, self.norm, norm)
            self._take(at, scores, ids, own)

    def _take(self, at: int, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        n, width = scores.shape
        low = self.low[at: at + n].astype(scores.dtype)[:, None]  # rounding keeps the order
        passed = _reaching(scores, low, self.k + own)
        q, i = np.divmod(passed, width)
        q, i, s = q + at, ids[i], scores.ravel()[passed].astype(np.int64)
        keep = (i != self.ids[q]) & ((s > self.low[q]) | ((s == self.low[q]) & (i <= self.last[q])))
        found = np.column_stack([q[keep], i[keep], s[keep]])
        if len(found) > 4 * self.k * n:
            found = merged(found, self.k)
        self.new.append(found)
        self.n_new += len(found)
        if self.n_new > max(MERGE_ROWS, len(self.lists) // 2):
            self.settle()

    def settle(self) -> np.ndarray:
        """Merge what was found; rows (number of the query, id, score)."""
        self.lists = merged(np.concatenate([self.lists, *self.new]), self.k)
        self.new, self.n_new = [], 0
        end = np.searchsorted(self.lists[:, 0], np.arange(len(self.ids)), "right")
        size = np.diff(end, prepend=0)
        full = size == self.k
        self.last[full], self.low[full] = self.lists[end[full] - 1, 1:].T
        return self.lists


class Cell:
    """The queries of one cell of the grid, which its candidates meet in tiles."""

    def __init__(self, k: int, tile: int):
        self.k, self.tile, self.best = k, tile, []
        self.queries, self.candidates, self.n = {}, {}, 0

    def add(self, is_candidate: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Queries come before candidates; vectors of different widths are kept apart."""
        if not is_candidate:
            self.queries.setdefault(x.dtype, []).append((ids, x))
        elif self.queries or self.best:
            self.candidates.setdefault(x.dtype, []).append((ids, x))
            self.n += len(ids)
            if self.n >= self.tile:
                self._meet()

    def _meet(self) -> None:
        while self.queries:
            self.best.append(Best(*_joined(self.queries.popitem()[1]), self.k))
        while self.candidates:
            ids, x = _joined(self.candidates.popitem()[1])
            for best in self.best:
                best.meet(ids, x)
        self.n = 0

    def found(self, buckets: int):
        """Blocks (bucket of queries, rows (query, id, score)) of the k best of each query."""
        self._meet()
        for best in self.best:
            lists = best.settle().copy()
            lists[:, 0] = best.ids[lists[:, 0]]
            bucket = (mixed(lists[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            lists, bucket = lists[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for at in range(0, len(cuts), 128):
                some = cuts[at: at + 128]
                ends = [*cuts[at + 1: at + len(some) + 1], len(lists)][:len(some)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[some], pa.int32()), pa.array([lists[a:b].tobytes() for a, b in zip(some, ends)], pa.binary())],
                    names=["bucket", "lists"])


def grid(n: int, n_queries: int, query_bytes: int, k: int, tasks: int, least: int) -> tuple[int, int]:
    """Rows and columns: about ``tasks`` cells, fewer (though ``least``) where they would move over ``MOVED`` times the bytes of
    the vectors, and columns enough for the queries of a cell to be held in memory."""
    size = query_bytes / max(1, n_queries)
    to_columns, to_rows = max(1.0, n * size), max(1.0, query_bytes + 24.0 * k * n_queries)
    # rows * to_rows + columns * to_columns is least at 2 * sqrt(cells * to_rows * to_columns)
    cells = max(1, least, min(tasks, int(MOVED ** 2 * to_columns / to_rows)))
    columns = max(math.ceil((2 * query_bytes + 48.0 * k * n_queries) / HELD_BYTES),
                  round(math.sqrt(cells * to_rows / to_columns)), 1)
    return max(1, math.ceil(cells / columns)), columns


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = SCALE, tile: int = TILE) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id under ``id_col``, score."""
    spark = vectors.sparkSession
    ready(spark)
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull())
    shape = [F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")]
    queries = rows.where(is_query).where(usable).select(*shape).groupBy("id").agg(F.min("v").alias("v"))
    blocks = stored(_packed(queries, tile, scale), "topk-queries")
    n_queries, query_bytes = blocks.agg(F.coalesce(F.sum(F.length("ids")) / 8, F.lit(0)).cast("long"),
                                        F.coalesce(F.sum(F.length("values")), F.lit(0)).cast("long")).first()
    down, across = grid(vectors.count(), n_queries, query_bytes, k, int(spark.conf.get("spark.sql.shuffle.partitions")),
                        spark.sparkContext.defaultParallelism)
    buckets = 1 + n_queries * k // BUCKET_ROWS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("ids", "values"), F.lit(n)).cast("int")
    shards = (_packed(rows.select(*shape), tile, scale)
              .select(F.lit(1).alias("is_candidate"), "*", dealt(down).alias("r"), every(across).alias("c")))
    blocks = blocks.select(F.lit(0).alias("is_candidate"), "*", dealt(across).alias("c"), every(down).alias("r"))
    cells = (shards.unionByName(blocks).repartition(down * across, "dim", "r", "c")
             .sortWithinPartitions("dim", "r", "c", "is_candidate"))

    def meet(batches):
        at, cell = None, None
        for batch in batches:
            place = zip(*(batch.column(x).to_pylist() for x in ("dim", "r", "c")))
            for here, is_candidate, ids, values in zip(place, batch.column("is_candidate").to_pylist(),
                                                       batch.column("ids"), batch.column("values")):
                if here != at:
                    if cell:
                        yield from cell.found(buckets)
                    at, cell = here, Cell(k, tile)
                cell.add(is_candidate, *_unpacked(here[0], ids, values))
        if cell:
            yield from cell.found(buckets)

    def last(lists: pd.DataFrame) -> pd.DataFrame:
        out = merged(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in lists["lists"]]), k)
        rank = np.arange(len(out)) - np.searchsorted(out[:, 0], out[:, 0]) + 1
        return pd.DataFrame({"query_id": out[:, 0], "rank": rank.astype(np.int32), id_col: out[:, 1], "score": out[:, 2]})

    return (cells.mapInArrow(meet, "bucket int, lists binary").groupBy("bucket")
            .applyInPandas(last, f"query_id long, rank int, `{id_col}` long, score long"))
