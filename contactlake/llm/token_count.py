"""Exact token counts of every prefix, by dynamic programming over prefixes.

For a merge-type vocabulary the encoding of a prefix ends in one certain
piece, and what stands before that piece is encoded as if it stood alone. So
one piece and one number a prefix suffice: ``count[i] = count[i - len(piece)]
+ 1``, where the piece is the one that ends at i and that stays whole beside
the last piece of the prefix before it. Two pieces stay whole beside each
other if the two together encode to just these two; that is found once for
every pair met and then looked up.

No merge crosses a segment border (see ``pieces``), so the table of a text is
the tables of its segments, each set on top of the counts before it. The
tables answer questions about truncation and budgets without encoding again:
``PrefixCounts.fit(budget)`` and ``PrefixCounts.count(n)``.

Defined cases: a null or empty text has 0 tokens; strings that look like
special tokens are ordinary text; texts of any length are counted whole;
repeated rows are counted alike; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import gc
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, utf8, worker_state
from .pieces import Recent, Vocabulary

LIMIT = 4096
KEPT = 200_000
_SHIFT = 21
_DEAD = -1


class Prefixes:
    """Prefix tables of segments for one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        # a trie of the pieces that are encoded as themselves; node 0 is the root
        names = list(vocab.pieces)
        alone = vocab.encode(names)
        steps, self.ends = {}, [-1]
        for name, ids in zip(names, alone):
            if ids != [vocab.pieces[name]]:
                continue
            node = 0
            for c in name:
                key = (node << _SHIFT) | vocab.symbol[c]
                node = steps.get(key)
                if node is None:
                    node = steps[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = vocab.pieces[name]
        self.ends = np.array(self.ends + [-1], np.int32)  # the last is for dead ends
        bits = max(2, (4 * len(steps)).bit_length())
        self._bits = bits
        self._keys, self._next = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, -1, np.int32)
        for key, node in steps.items():
            at = ((key * 0x9E3779B97F4A7C15) & (2 ** 64 - 1)) >> (64 - bits)
            while self._keys[at] != -1:
                at += 1
            self._keys[at], self._next[at] = key, node
        self.names = dict((i, p) for p, i in vocab.pieces.items())
        self._pairs = np.zeros(0, np.int64)  # known pairs in rising order
        self._whole = np.zeros(0, bool)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = (node.astype(np.int64) << _SHIFT) | symbol
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)
        out = np.full(len(key), _DEAD, np.int32)
        rest = np.arange(len(key))
        while len(rest):
            held = self._keys[at]
            hit = held == key
            out[rest[hit]] = self._next[at[hit]]
            go = ~hit & (held != -1)
            rest, key, at = rest[go], key[go], at[go] + 1
        return out

    def _stay_whole(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side are encoded as these two."""
        key = (left.astype(np.int64) << _SHIFT) | right
        at = np.searchsorted(self._pairs, key)
        known = np.zeros(len(key), bool)
        inside = at < len(self._pairs)
        known[inside] = self._pairs[at[inside]] == key[inside]
        if not known.all():
            new = np.unique(key[~known])
            a, b = (new >> _SHIFT).tolist(), (new & ((1 << _SHIFT) - 1)).tolist()
            ids = self.vocab.encode([self.names[x] + self.names[y] for x, y in zip(a, b)])
            whole = np.array([i == [x, y] for i, x, y in zip(ids, a, b)], bool)
            merged = np.concatenate([self._pairs, new])
            order = np.argsort(merged, kind="stable")
            self._pairs, self._whole = merged[order], np.concatenate([self._whole, whole])[order]
            at = np.searchsorted(self._pairs, key)
        return self._whole[at]

    def tables(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every prefix (0 characters first) of all segments, and the n + 1 offsets of the segments' tables."""
        vocab = self.vocab
        n = np.array([len(x) for x in segments], np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = vocab._char[points]
        starts = np.cumsum(n) - n
        # every piece that stands anywhere: walk the trie from all places at once
        place = np.arange(len(flat))
        left = np.repeat(starts + n, n) - place  # characters from here to the segment's end
        node, from_, length = np.zeros(len(flat), np.int32), place, 0
        found_at, found_len, found_id = [], [], []
        while len(from_):
            node = self._step(node, flat[from_ + length])
            length += 1
            alive = node != _DEAD
            node, from_ = node[alive], from_[alive]
            ends = self.ends[node]
            hit = ends >= 0
            found_at.append(from_[hit])
            found_len.append(np.full(int(hit.sum()), length))
            found_id.append(ends[hit])
            more = left[from_] > length
            node, from_ = node[more], from_[more]
        # a character that is no piece of its own is spelt in bytes
        size = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        at, long, made = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_at, found_len, found_id))
        single = np.zeros(len(flat), bool)
        single[at[long == 1]] = True
        spelt = np.flatnonzero(~single)
        # tables have one place more than characters
        shift = np.repeat(np.arange(len(n)), n)
        count = np.full(len(flat) + len(n), -1, np.int64)
        last = np.full(len(flat) + len(n), -1, np.int64)
        heads = starts + np.arange(len(n))
        count[heads] = 0
        all_at = np.concatenate([at, spelt])
        all_len = np.concatenate([long, np.ones(len(spelt), np.int64)])
        all_id = np.concatenate([made, np.full(len(spelt), -2)]).astype(np.int64)
        all_cost = np.concatenate([np.ones(len(at), np.int64), size[spelt]])
        depth = all_at - starts[shift[all_at]]
        order = np.argsort(depth, kind="stable")
        depth = depth[order]
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for own in np.split(order, cuts) if len(order) else []:
            here = all_at[own] + shift[all_at[own]]
            own, here = own[count[here] >= 0], here[count[here] >= 0]
            before, piece = last[here], all_id[own]
            ok = (before < 0) | (piece < 0)
            ask = np.flatnonzero(~ok)
            if len(ask):
                ok[ask] = self._stay_whole(before[ask], piece[ask])
            own, here = own[ok], here[ok]
            to = here + all_len[own]
            count[to] = count[here] + all_cost[own]
            last[to] = all_id[own]
        return count, np.append(heads, len(count))

    def totals(self, segments: list[str]) -> list[int]:
        """Counts of whole segments: the last row of each table."""
        out: list[int] = []
        for k in range(0, len(segments), 50_000):
            count, offsets = self.tables(segments[k: k + 50_000])
            out.extend(count[offsets[1:] - 1].tolist())
        return out


class PrefixCounts:
    """Exact token counts of all prefixes of one text."""

    def __init__(self, text: str, prefixes: Prefixes):
        segments = prefixes.vocab.segments(text)
        tables, offsets = prefixes.tables(segments)
        totals = tables[offsets[1:] - 1] if segments else np.zeros(0, np.int64)
        base = np.cumsum(totals) - totals
        own = tables + np.repeat(base, np.diff(offsets))
        keep = np.ones(len(own), bool)
        keep[offsets[1:-1]] = False  # the empty prefix of a later segment is the whole of the one before
        #: with a space mark set before the text, the prefix of i characters is at place i + 1
        self.counts = np.append(0, own[keep][2:]) if len(segments) else np.zeros(1, np.int64)
        self.text = text

    def count(self, n: int) -> int:
        """Tokens of the first n characters."""
        return int(self.counts[n])

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of ``budget`` tokens at most."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


def _prefixes(path: str) -> tuple[Prefixes, Recent]:
    return worker_state(("prefixes", path), lambda: (Prefixes(Vocabulary(path)), Recent(KEPT)))


def count_tokens(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row."""
    ready(documents.sparkSession)

    def run(batches):
        prefixes, kept = _prefixes(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            column, tokens = batch.column(1), []
            for a, b in slices(offsets, 1 << 20):
                gc.disable()  # the many short strings made here hold no cycles
                own = [prefixes.vocab.segments(x or "") for x in column.slice(a, b - a).to_pylist()]
                known = kept.fetch(itertools.chain.from_iterable(own), prefixes.totals)
                tokens.extend(sum(map(known.__getitem__, x)) for x in own)
                gc.enable()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens, pa.int64())],
                names=["id", "n_bytes", "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
