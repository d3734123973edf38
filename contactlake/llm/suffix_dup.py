"""Removal of repeated passages by a difference-cover suffix sort of bounded depth.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else goes. That needs the order of suffixes by their first LENGTH bytes only,
so the difference-cover construction is carried to this depth and no further:

1. Sample. Of each text, the places whose offset modulo v is in a difference
   cover D of v are sampled. For any two places there is one k < v at which
   both i + k and j + k are sampled, so two equal strings of LENGTH bytes
   always hold an equal sampled tuple of LENGTH - v + 1 bytes at the same k.
   With v = q * q + q + 1 and a perfect cover of q + 1 residues, the share of
   sampled places is least (for q = 17: 18 of 307).
2. Sort and name. Tuples are named by 64-bit fingerprints. Fingerprints are
   range partitioned over all tasks and sorted; a tuple whose name has no
   equal neighbour can't lie in a repeat.
3. Recurse and merge. Only places within reach before a sampled place with a
   repeated name remain. A second naming of these sampled places takes in what
   strings share that begin in one of ``PARTS`` parts of the reach, and leaves
   the parts whose name is repeated. Then all remaining places are named by
   their whole LENGTH bytes (88 bits), partitioned and sorted in the same way.
4. Compare adjacent. A place whose name equals a neighbour's starts a repeated
   string; the bytes that such strings cover are removed.

Names order the suffixes by an order of their own, which is as good as that of
bytes: only equality of neighbours is asked. Symbols are mixed eight bytes
before they are summed, so that no regular text (as in attacks on polynomial
sums modulo 2 ** 64) makes names equal.

Equal texts are folded first, as an aggregate with partial results. What is
left is packed into chunks of about ``CHUNK`` bytes, compressed, in one
checkpointed table. A chunk sends each of its distinct names once, sorted, to
the task of the name's range, and gets one bit for each back. So a string that
occurs in a third of all texts is one entry a chunk, no group is ever larger
than the number of chunks, and a task holds about ``RANGE`` names.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing;
copies of a text of LENGTH bytes or more are removed whole (the input is
judged, not what is left); matches never cross texts; rows with equal ids are
texts of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mixed, ready, utf8, worker_state

LENGTH = 400
Q = 17
CHUNK = 2 << 20
RANGE = 2_000_000
PARTS = 4
LAST = 3
_BASE = 0x5851F42D4C957F2D
_BLOCK = 1 << 20


def difference_cover(q: int) -> tuple[int, list[int]]:
    """v = q * q + q + 1 and q + 1 residues whose differences are all residues, for a prime q.

    Powers of a generator of the cubic extension of the field of q elements,
    taken modulo the field: those in a plane (no square term) are a perfect
    cover.
    """
    v = q * q + q + 1
    for c in range(q ** 3):
        c0, c1, c2 = c % q, c // q % q, c // q // q
        if not c0:
            continue
        power, plane = (1, 0, 0), []
        for k in range(v):
            if power[2] == 0:
                plane.append(k)
            a, b, d = power  # times x, where x ** 3 = c2 * x ** 2 + c1 * x + c0
            power = (d * c0 % q, (a + d * c1) % q, (b + d * c2) % q)
        if len(plane) == q + 1 and len({(x - y) % v for x in plane for y in plane}) == v:
            return v, plane
    raise ValueError(f"{q} is not a prime")


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    return worker_state("powers", lambda: [
        np.cumprod(np.concatenate([[np.uint64(1)], np.full(_BLOCK + 4096, np.uint64(b))]), dtype=np.uint64)
        for b in (_BASE, pow(_BASE, -1, 1 << 64))])


class Chunk:
    """A packed row of texts and what is asked about them."""

    def __init__(self, row, length: int, q: int):
        self.length = length
        self.v, self.cover = difference_cover_of(q)
        self.tuple = length - self.v + 1
        self.ends = np.cumsum(np.frombuffer(row["sizes"], "<i8"))
        n = int(self.ends[-1]) if len(self.ends) else 0
        self.data = np.frombuffer(pa.decompress(row["texts"], n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
        self.starts = np.append(0, self.ends[:-1])
        self._kept: dict[int, np.ndarray] = {}

    def _sums(self, a: int) -> np.ndarray:
        """Running sums of mixed symbols from byte ``a`` on, a block and what its strings reach; kept in small chunks."""
        if a not in self._kept:
            own = np.concatenate([self.data[a: a + _BLOCK + self.length], np.zeros(8, np.uint8)])
            eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, 8)).view("<u8").ravel()[:-1]
            sums = np.cumsum(mixed(eight) * _powers()[0][: len(eight)], dtype=np.uint64)
            if len(self.data) > 4 * _BLOCK:
                self._kept.clear()
            self._kept[a] = np.concatenate([np.zeros(1, np.uint64), sums])
        return self._kept[a]

    def names(self, places: np.ndarray, length: int) -> np.ndarray:
        """64-bit fingerprints of the ``length`` bytes (8 at least) from each of the rising ``places``."""
        back, out = _powers()[1], np.empty(len(places), np.uint64)
        for a in range(0, len(self.data), _BLOCK):
            i, j = np.searchsorted(places, (a, a + _BLOCK))
            if i < j:
                sums, at = self._sums(a), places[i:j] - a
                out[i:j] = (sums[at + length - 7] - sums[at]) * back[at]
        return mixed(out)

    def sampled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled places with a whole tuple, and the first and last byte's place of the text of each."""
        longest = int((self.ends - self.starts).max(initial=0))
        offsets = (np.arange(0, longest + self.v, self.v)[:, None] + np.array(self.cover)).ravel()
        long = self.ends - self.starts >= self.length
        starts, ends = self.starts[long], self.ends[long]
        n = np.searchsorted(offsets, ends - starts - self.tuple, "right")
        heads = np.repeat(starts, n)
        return offsets[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] + heads, heads, np.repeat(ends, n)

    def asked(self, step: int, replies: pd.DataFrame | None = None):
        """(names, places) of a step; places rise in step 3 only, in which they are what remains of all places."""
        places, heads, ends = self.sampled()
        own = self.names(places, self.tuple)
        if step == 1:
            return own, places
        again = _again(own, replies[replies["step"] == 1])
        places, heads, ends = places[again], heads[again], ends[again]
        # a string that begins from a to b bytes before a sampled place holds what all strings of that part share
        parts = []
        for k in range(PARTS):
            a, b = k * self.v // PARTS, (k + 1) * self.v // PARTS - 1
            whole = (places - a >= heads) & (places - b + self.length <= ends)
            at = places[whole] - a
            parts.append((self.names(at, self.length - (b - a)), at - (b - a), at, heads[whole], ends[whole]))
        own, low, high, heads, ends = (np.concatenate(x) for x in zip(*parts))
        if step == 2:
            return own, high
        again = _again(own, replies[replies["step"] == 2])
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, np.maximum(low, heads)[again], 1)
        np.add.at(change, np.minimum(high, ends - self.length)[again] + 1, -1)
        rest = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        return self.names(rest, self.length), rest


_COVERS: dict[int, tuple[int, list[int]]] = {}


def difference_cover_of(q: int) -> tuple[int, list[int]]:
    if q not in _COVERS:
        _COVERS[q] = difference_cover(q)
    return _COVERS[q]


def _check_bits(chunk: Chunk, places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """24 more bits of the names of places, from another sum: of the string's two halves."""
    half = chunk.length // 2
    other = chunk.names(places, half) * np.uint64(3) + chunk.names(places + half, chunk.length - half)
    return (mixed(other ^ (own * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(40)).astype("<u4")


def _requests(chunk_id: int, own: np.ndarray, ranges: int, checks=None) -> pd.DataFrame:
    """The distinct names of a chunk, sorted and cut by range: one row a range.

    There are 256 ranges or more, as a power of two, so that a name's first
    byte follows from its range: seven bytes of it are sent, and three of its
    check bits if it has any.
    """
    distinct, first = np.unique(own, return_index=True)
    bounds = np.searchsorted(distinct >> np.uint64(64 - ranges.bit_length() + 1), np.arange(ranges + 1))
    rows = np.flatnonzero(np.diff(bounds))
    sent = [_low_bytes(distinct, 7)] + ([] if checks is None else [_low_bytes(checks(first), 3)])
    sent = np.concatenate(sent, axis=1)
    return pd.DataFrame({
        "range": rows.astype(np.int64), "chunk": np.full(len(rows), chunk_id),
        "names": [sent[bounds[r]: bounds[r + 1]].tobytes() for r in rows]})


def _low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]


def _replies(frame: pd.DataFrame, step: int) -> pd.DataFrame:
    """One bit for each name that was sent: whether an equal one came from another chunk."""
    width = 10 if step == LAST else 7
    sent = np.frombuffer(b"".join(frame["names"]), np.uint8).reshape(-1, width)
    wide = np.zeros((len(sent), 8), np.uint8)
    wide[:, :7] = sent[:, :7]
    own = wide.view("<u8").ravel()
    if step == LAST:
        wide = np.zeros((len(sent), 4), np.uint8)
        wide[:, :3] = sent[:, 7:]
        checks = wide.view("<u4").ravel()
        order = np.lexsort((checks, own))
        same = (own[order[1:]] == own[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
    else:
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    n = np.array([len(x) // width for x in frame["names"]])
    ends = np.cumsum(n)
    return pd.DataFrame({"chunk": frame["chunk"].to_numpy(), "step": np.full(len(n), step, np.int32),
                         "range": frame["range"].to_numpy(), "n": n,
                         "bits": [np.packbits(again[e - k: e]).tobytes() for e, k in zip(ends, n)]})


def _again(own: np.ndarray, replies: pd.DataFrame) -> np.ndarray:
    """Which of the names occur again, in this chunk or in another."""
    distinct, back, count = np.unique(own, return_inverse=True, return_counts=True)
    replies = replies.sort_values("range")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(replies["bits"], replies["n"])]
    elsewhere = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    if len(elsewhere) != len(distinct):
        raise ValueError(f"{len(distinct)} names were sent, {len(elsewhere)} answers came")
    return ((count > 1) | elsewhere)[back]


_REQUEST = "range long, chunk long, names binary"
_REPLY = "chunk long, step int, range long, n long, bits binary"


def _packed(texts: DataFrame, size: int) -> DataFrame:
    """Rows (sha, text, copies) into chunks: about ``size`` bytes each, one text at least."""

    def run(batches):
        from pyspark import TaskContext

        codec = pa.Codec("zstd", 5)
        number = TaskContext.get().partitionId() << 32
        held: list = []
        total = 0

        def row():
            nonlocal number, held, total
            blob = b"".join(x[1] for x in held)
            made = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(blob)], pa.int64()), pa.array([b"".join(x[0] for x in held)], pa.binary()),
                 pa.array([np.array([len(x[1]) for x in held], "<i8").tobytes()], pa.binary()),
                 pa.array([np.array([x[2] for x in held], "<i8").tobytes()], pa.binary()),
                 pa.array([codec.compress(blob, asbytes=True) if blob else b""], pa.binary())],
                names=["chunk", "n_bytes", "shas", "sizes", "copies", "texts"])
            number, held, total = number + 1, [], 0
            return made

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            shas, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                held.append((shas[i], data[offsets[i]: offsets[i + 1]].tobytes(), copies[i]))
                total += len(held[-1][1])
                if total >= size:
                    yield row()
        if held:
            yield row()

    return texts.mapInArrow(run, "chunk long, n_bytes long, shas binary, sizes binary, copies binary, texts binary")


def _kept(chunk: Chunk, row, replies: pd.DataFrame, keep_text: bool) -> pd.DataFrame:
    own, rest = chunk.asked(LAST, replies)
    again = rest[_again(own, replies[replies["step"] == LAST])]
    change = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(change, again, 1)
    np.add.at(change, again + chunk.length, -1)
    gone = np.cumsum(change[:-1]) > 0
    out = []
    copies = np.frombuffer(row["copies"], "<i8").tolist()
    for k, (s, e) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist())):
        own = gone[s:e]
        if copies[k] > 1 and e - s >= chunk.length:
            own = np.ones(e - s, bool)
        left = chunk.data[s:e][~own].tobytes()
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
        found = (row["shas"][32 * k: 32 * k + 32], e - s, int(own.sum()), spans, hashlib.sha256(left).hexdigest())
        out.append((*found, left.decode("utf-8", "ignore")) if keep_text else found)
    columns = ["sha", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    return pd.DataFrame(out, columns=columns)


def _released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are checkpointed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(documents: DataFrame, text_col: str = "text", length: int = LENGTH, q: int = Q, chunk: int = CHUNK,
            keep_text: bool = False) -> DataFrame:
    """sha, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text left) of each different text."""
    spark = documents.sparkSession
    ready(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    folded = (documents.select(F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
              .groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    chunks = cut(_packed(folded, chunk))
    _released(spark)
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    names = n_bytes * (q + 1) // (q * q + q + 1)
    ranges = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")), names // RANGE)
    ranges = 1 << (int(ranges) - 1).bit_length()

    def ask(row, step, replies=None):
        c = Chunk(row, length, q)
        own, places = c.asked(step, replies)
        return _requests(row["chunk"], own, ranges,
                         (lambda first: _checks_at(c, places, own, first)) if step == LAST else None)

    def first(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                yield ask(row, 1)

    def further(step):
        return lambda left, right: pd.concat([ask(row, step, right) for row in left.to_dict("records")])

    def answer(step):
        return lambda frame: _replies(frame, step)

    def last(left, right):
        return pd.concat([_kept(Chunk(row, length, q), row, right, keep_text) for row in left.to_dict("records")])

    by_chunk, replies = chunks.groupBy("chunk"), None
    for step in range(1, LAST + 1):
        if step == 1:
            asked = chunks.mapInPandas(first, _REQUEST)
        else:
            asked = by_chunk.cogroup(replies.groupBy("chunk")).applyInPandas(further(step), _REQUEST)
        new = cut(asked.groupBy("range").applyInPandas(answer(step), _REPLY))
        replies = new if replies is None else replies.unionByName(new)
        _released(spark)
    schema = "sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    return by_chunk.cogroup(replies.groupBy("chunk")).applyInPandas(last, schema)


def _checks_at(chunk: Chunk, places: np.ndarray, own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Check bits of the places whose names are at ``first``, in that order."""
    order = np.argsort(first)
    bits = np.empty(len(first), "<u4")
    bits[order] = _check_bits(chunk, places[first[order]], own[first[order]])
    return bits


def _joined(documents: DataFrame, found: DataFrame, text_col: str, columns: list) -> DataFrame:
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
    rows = documents.select(F.struct(*columns).alias("row"), sha.alias("row_sha"))
    return rows.join(found, F.col("row_sha") == F.col("sha"))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   q: int = Q, chunk: int = CHUNK) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = repeats(documents, text_col, length, q, chunk)
    return (_joined(documents, found, text_col, [F.col(id_col).alias("id")])
            .select(F.col("row.id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def without_repeats(documents: DataFrame, text_col: str = "text", length: int = LENGTH, q: int = Q,
                    chunk: int = CHUNK) -> DataFrame:
    """The rows, all columns kept, with repeated passages cut out of their text.

    Of a character that a cut splits, the other bytes go too. A null text
    stays null.
    """
    found = repeats(documents, text_col, length, q, chunk, keep_text=True).select("sha", "kept")
    others = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    there = F.col(f"`{text_col}`").isNotNull().alias(text_col)
    text = F.when(F.col(f"row.`{text_col}`"), F.col("kept"))
    return (_joined(documents, found, text_col, [*others, there])
            .select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in documents.columns]))
