"""Merge-type (BPE) piece vocabularies of the sentencepiece library.

``Vocabulary`` reads a .model file and encodes many short segments at once. A
text is first cut into segments that no merge can cross: before a run of
spaces (no piece has a space mark after another character) and around
characters that are in no piece. So segments can be encoded apart and their
results kept for the next time they occur.

Encoding keeps, for each segment, an agenda of adjacent symbol pairs ordered
by piece score, then by place: the best pair is merged, its two neighbour
pairs are scored anew, until no pair makes a piece. Short segments of a batch
are worked on side by side in arrays, one merge a segment a round; long ones
use a heap each.
"""

from __future__ import annotations

import heapq
import re

import numpy as np

SPACE = "▁"
NONE = np.int32(2 ** 31 - 1)
SHORT = 40
_SHIFT = 21


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = [0] * 256
        pieces: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i
        self.pieces, self.eos = pieces, sp.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"{path}: pieces that hold a space mark inside aren't supported")
        # symbols: pieces by their id, then characters that only occur in longer pieces
        self.symbol = dict(pieces)
        n = sp.get_piece_size()
        for p in pieces:
            for c in p:
                if c not in self.symbol:
                    self.symbol[c] = n + len(self.symbol) - len(pieces)
        self.n_ids, self.other = n, (1 << _SHIFT) - 1  # other: a character of no piece
        score = sorted({sp.get_score(i) for i in pieces.values()}, reverse=True)
        place = {s: k for k, s in enumerate(score)}
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << _SHIFT) | b] = (place[sp.get_score(i)], i)
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()] + [NONE], np.int32)
        self.pair_id = np.array([pairs[k][1] for k in self.pair_keys.tolist()] + [-1], np.int32)
        # an open hash table for the pairs: searching the sorted keys is slower
        bits = 2
        while (1 << bits) < 4 * max(1, len(self.pair_keys)):
            bits += 1
        self._bits, slots = bits, np.full((1 << bits) + 64, -1, np.int64)
        where = np.zeros((1 << bits) + 64, np.int32)
        for k, key in enumerate(self.pair_keys.tolist()):
            at = self._slot(key)
            while slots[at] != -1:
                at += 1
                if at == len(slots):
                    raise ValueError("pair table is too full")
            slots[at], where[at] = key, k
        self._slots, self._where = slots, where
        in_pieces = "".join(sorted({c for p in pieces for c in p if c != SPACE}))
        alone = "[^" + SPACE + re.escape(in_pieces) + "]" if in_pieces else "[^" + SPACE + "]"
        self._alone = re.compile(alone)
        self._segment = re.compile(f"{SPACE}+[{re.escape(in_pieces)}]*|[{re.escape(in_pieces)}]+|{alone}"
                                   if in_pieces else f"{SPACE}+|{alone}", re.S)
        char = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                char[ord(c)] = i
        self._char = char

    def _slot(self, key):
        return ((key * 0x9E3779B97F4A7C15) & (2 ** 64 - 1)) >> (64 - self._bits)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the known pairs, -1 (the last) where it makes no piece."""
        key = (left.astype(np.int64) << _SHIFT) | right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        rest = np.arange(len(key))
        while len(rest):
            held = self._slots[at]
            hit = held == key
            out[rest[hit]] = self._where[at[hit]]
            go = ~hit & (held != -1)
            rest, key, at = rest[go], key[go], at[go] + 1
        return out

    def segments(self, text: str) -> list[str]:
        """Segments of a text as the library sees it: a space mark first, one for every space."""
        if not text:
            return []
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return self._segment.findall(SPACE + text.replace(" ", SPACE))
        out = (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
        return [x for x in out if x] if "\n" in text else out

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Ids of each segment."""
        n = np.array([len(x) for x in segments], np.int64)
        out: list = [None] * len(segments)
        for i in np.flatnonzero(n > SHORT):
            out[i] = self._ids_of(*self._by_heap(segments[i]))
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 18), (18, SHORT)):
            at = np.flatnonzero((n > low) & (n <= high))
            for k in range(0, len(at), 20_000):
                rows = at[k: k + 20_000]
                own = [segments[i] for i in rows]
                symbols, starts, ends = self._side_by_side(own, n[rows], high)
                plain = np.add.reduceat(symbols >= self.n_ids, np.append(0, ends[:-1])) == 0
                flat, a = symbols.tolist(), 0
                for i, b in zip(rows.tolist(), ends.tolist()):
                    out[i] = flat[a:b]
                    a = b
                for j in np.flatnonzero(~plain):
                    a = ends[j - 1] if j else 0
                    out[rows[j]] = self._ids_of(own[j], out[rows[j]], starts[a: ends[j]].tolist())
        for i in np.flatnonzero(n == 0):
            out[i] = []
        return out

    def _ids_of(self, segment: str, symbols: list[int], starts: list[int]) -> list[int]:
        ids = []
        for k, x in enumerate(symbols):
            if x < self.n_ids:
                ids.append(x)
            else:
                ids.extend(self.byte_ids[b] for b in segment[starts[k]].encode("utf-8", "surrogatepass"))
        return ids

    def _by_heap(self, segment: str):
        symbols = self._char[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        agenda = []

        def propose(a: int, b: int):
            found = self.pairs.get((symbols[a] << _SHIFT) | symbols[b])
            if found:
                heapq.heappush(agenda, (found[0], a, b, symbols[a], symbols[b], found[1]))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            _, a, b, x, y, made = heapq.heappop(agenda)
            if not (alive[a] and alive[b]) or after[a] != b or symbols[a] != x or symbols[b] != y:
                continue
            symbols[a], alive[b] = made, False
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                propose(a, after[a])
            if before[a] >= 0:
                propose(before[a], a)
        kept = [k for k in range(n) if alive[k]]
        return segment, [symbols[k] for k in kept], kept

    def _side_by_side(self, segments: list[str], n: np.ndarray, width: int):
        rows = len(segments)
        flat = self._char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)]
        column = np.arange(width)
        inside = column < n[:, None]
        symbols = np.full((rows, width), -1, np.int32)
        symbols[inside] = flat
        start = np.where(inside, column, 0).astype(np.int16)
        rank = np.full((rows, width), NONE, np.int32)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.pair_rank[self._found(symbols[:, :-1][both], symbols[:, 1:][both])]
        n = n.copy()
        done_s, done_c, done_n = symbols.copy(), start.copy(), n.copy()
        live = np.arange(rows)
        while True:
            best = rank.argmin(1)
            k = np.arange(len(live))
            more = rank[k, best] != NONE
            if not more.all():
                over = live[~more]
                done_s[over], done_c[over], done_n[over] = symbols[~more], start[~more], n[~more]
                if not more.any():
                    break
                live, best, n = live[more], best[more], n[more]
                symbols, start, rank = symbols[more], start[more], rank[more]
                k = np.arange(len(live))
            made = self.pair_id[self._found(symbols[k, best], symbols[k, best + 1])]
            n -= 1
            # what stands after the pair moves up by one place
            moves = column[:-1] > best[:, None]
            for x, empty in ((symbols, -1), (start, 0), (rank, NONE)):
                x[:, :-1] = np.where(moves, x[:, 1:], x[:, :-1])
                x[:, -1] = empty
            symbols[k, best] = made
            rank[k, best] = NONE
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best + 1 < n)
            a = np.concatenate([symbols[left, best[left] - 1], made[right]])
            b = np.concatenate([made[left], symbols[right, best[right] + 1]])
            found = self.pair_rank[self._found(a, b)]
            rank[left, best[left] - 1] = found[: len(left)]
            rank[right, best[right]] = found[len(left):]
        symbols, start, n = done_s, done_c, done_n
        kept = column < n[:, None]
        return symbols[kept], start[kept], np.cumsum(n)


class Recent:
    """A bounded memory of two generations: what isn't asked for again is forgotten."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def fetch(self, keys: list[str], make) -> dict:
        """A dict that has all of ``keys``; ``make(new)`` gives the values of new ones."""
        wanted = set(keys)
        known = self.young
        missing = wanted.difference(known)
        if missing and self.old:
            back = missing.intersection(self.old)
            for k in back:
                known[k] = self.old[k]
            missing -= back
        if missing:
            new = list(missing)
            known.update(zip(new, make(new)))
        if len(known) > self.most:
            self.old, self.young = known, {}
        return known
