"""Near duplicates by Order MinHash, checked by banded alignment.

Texts are rows of words; k-mers are runs of words, labelled with their
occurrence number in the text. ``KINDS`` says how many words, how many hash
functions, and how many of the labelled k-mers with the smallest hashes each of
them takes and keeps in text order: two texts agree with a chance that falls
with their edit distance, not only with what they share. Long k-mers tell texts
apart, short ones are left between edits that are close together. Texts that
agree in one sketch are candidates; a candidate pair is a link if the edit
distance of their words is at most a fifth of the longer one's words
(a similarity of 0.8 or more).

Equal texts are folded first (by SHA-256), as an aggregate: a sketch row is
made from each text where it is read, and one row a different text goes on.
In a bucket (hash function and sketch), every text is first compared with the
smallest id, and the links are closed to classes (``components``). Then every
pair of different classes in a bucket is decided, in one more pass:

* Where at most ``SMALL`` rows lie outside the bucket's largest class, these
  are compared with all rows of the bucket.
* Other buckets are split without loss. Similar texts have all but a fifth of
  the longer one's words in common, so of two rows of words in one order, rare
  ones first, the first fifth and one more must share a word (an occurrence of
  it), and one more for each word that is taken further. Rows of all such
  buckets together go to a list for each of these words and ``DEEP`` more; as
  the same texts share many buckets, that is less than each bucket's own
  lists. Pairs that share a bucket and ``DEEP`` + 1 of the words are compared;
  of the lists in which a pair meets, only the last of these words' makes a row
  of it (where a list is too large, all that share one of the first fifth and one, which
  similar texts do too; only with these words rows go on). Up to ``LARGE`` rows outside a list's largest class are compared
  there; a larger list is split by the buckets that its rows come from, then
  by the next common word in the same way. What is still larger after ``DEEP``
  steps (texts of the same words in another order) is compared like a small one.

The distance test has three exact steps: it is at least the longer length less
the common words, at most what lies between common unique words in order, and
if these two don't decide, a bit-parallel alignment is made in the band of
diagonals that the limit allows.

Defined cases: a null text is an empty text; texts without words only match
equal texts; texts of fewer words than a k-mer are one k-mer; equal texts are
always one class; rows with equal ids and different texts have one class; rows
with a null id get the class of their text, null if no such row has an id;
repeated rows are equal texts; an empty table gives an empty result; extra
columns of any name are ignored by ``near_duplicates`` and kept by
``without_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_shuffle, cut, dropped, mixed, ready, released, slices, stored, utf8, worker_state
from .components import components

#: Words of a k-mer, hash functions, k-mers each takes.
KINDS = ((5, 24, 2), (3, 72, 2))
#: Rows outside the largest class of a bucket that are compared with all of the bucket.
SMALL = 32
#: The same in a bucket that has been split by a rare word: splitting it again multiplies its rows.
LARGE = 512
#: Edit distance over the longer length: one in FIFTH at most.
FIFTH = 5
#: Words beyond the first fifth and one that lists are made of, and steps after which a list isn't split any more.
DEEP = 12
#: Bits of a word's hash by which occurrences are counted to order words by rarity.
COUNTS = 18
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the n + 1 offsets of each text's words."""
    inside = ~_BLANK[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    start[heads] = inside[heads]  # a word ends where its text ends
    stop = np.append(~inside[1:] | False, True) if len(data) else np.zeros(0, bool)
    stop[heads[heads > 0] - 1] = True
    first, last = np.flatnonzero(start), np.flatnonzero(inside & stop)
    # sum of byte values times powers of an odd number, shifted back: equal words, equal sums
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[:-1], dtype=np.uint64)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE)]), dtype=np.uint64)
    h = mixed((sums[last + 1] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return h, np.searchsorted(first, offsets)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def all_sketches(h: np.ndarray, offsets: np.ndarray, kinds=KINDS) -> np.ndarray:
    """The sketches of all kinds side by side."""
    return np.concatenate([sketches(h, offsets, *kind) for kind in kinds], axis=1)


def sketches(h: np.ndarray, offsets: np.ndarray, k: int, m: int, ell: int) -> np.ndarray:
    """Order MinHash of each text that has a word: (texts, m) 64-bit numbers; 0 for texts without words."""
    n_words = np.diff(offsets)
    out = np.zeros((len(n_words), m), np.uint64)
    some = np.flatnonzero(n_words)
    if not len(some):
        return out
    n = np.maximum(n_words[some] - k + 1, 1)
    ends = np.cumsum(n)
    starts = ends - n
    doc = np.repeat(np.arange(len(some)), n)
    at = np.arange(ends[-1]) - starts[doc] + offsets[some][doc]
    mers = np.zeros(len(at), np.uint64)
    stop = offsets[some + 1][doc]
    for j in range(k):
        there = at + j < stop
        mers = mixed(mers + np.where(there, h[np.minimum(at + j, len(h) - 1)], np.uint64(j + 1)))
    # label equal k-mers of a text by occurrence
    own = mixed(mers ^ mixed(doc.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    label = np.empty(len(order), np.uint64)
    label[order] = (np.arange(len(order)) - first).astype(np.uint64)
    mers = mixed(mers + label * np.uint64(0x632BE59BD9B4E019))
    bits = np.uint64(max(1, int(len(at) - 1).bit_length()))
    place = np.arange(len(at), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    for j in range(m):
        x = mers * (np.uint64(2) * mixed(np.array([j + 1], np.uint64)) + np.uint64(1))
        x ^= x >> np.uint64(32)
        x = (x & ~low) | place
        chosen = []
        for _ in range(ell):
            least = np.minimum.reduceat(x, starts)
            chosen.append(np.where(least == _TAKEN, _TAKEN, least & low))
            x[chosen[-1][least != _TAKEN]] = _TAKEN
        chosen = np.sort(np.stack(chosen), axis=0)
        value = np.full(len(some), j, np.uint64)
        for c in chosen:
            value = mixed(value + np.where(c == _TAKEN, np.uint64(7), mers[np.where(c == _TAKEN, 0, c)]))
        out[some, j] = value
    return out


_TAKEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def banded(a: list[int], b: list[int], most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel, on the 2 * most + 1 middle diagonals."""
    if abs(len(a) - len(b)) > most:
        return False
    if most == 0:
        return a == b
    if most >= min(len(a), len(b)):  # the band is the whole table
        return _plain(a, b) <= most
    n, m, w = len(a), len(b), most
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    mask, top = (1 << (2 * w + 1)) - 1, 1 << (2 * w)
    # vertical differences of the rows j - w .. j + w of column j, the topmost row in the lowest bit
    plus, minus, score = (mask >> w) << w, 0, w
    row = top
    for j in range(1, m + 1):
        # rows of column j are numbered from j - w; what stands in plus and minus is aligned to them
        shift = j - w - 1
        hit = where.get(b[j - 1], 0)
        hit = (hit >> shift if shift >= 0 else hit << -shift) & mask
        diagonal = ((((hit & plus) + plus) ^ plus) | hit | minus) & mask
        right = minus | (~(diagonal | plus) & mask)
        left = diagonal & plus
        if j + w <= n:
            score += not diagonal & top
        else:
            row >>= 1
            score += bool(right & row) - bool(left & row)
        down = diagonal >> 1
        plus, minus = left | (~(down | right) & mask), right & down
    return score <= most


def _plain(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a: np.ndarray, b: np.ndarray, fifth: int = FIFTH) -> bool:
    """Whether the edit distance of two word rows is at most the longer length over ``fifth``."""
    n, m = len(a), len(b)
    most = max(n, m) // fifth
    if abs(n - m) > most:
        return False
    if n == m and np.array_equal(a, b):
        return True
    ua, ia, ca = np.unique(a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(b, return_index=True, return_counts=True)
    both, pa_, pb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if max(n, m) - np.minimum(ca[pa_], cb[pb]).sum() > most:
        return False
    once = (ca[pa_] == 1) & (cb[pb] == 1)
    if once.any():
        x, y = ia[pa_[once]], ib[pb[once]]
        order = np.argsort(x)
        x, y = np.concatenate([[-1], x[order], [n]]), np.concatenate([[-1], y[order], [m]])
        if (np.diff(y) > 0).all() and np.maximum(np.diff(x) - 1, np.diff(y) - 1).sum() <= most:
            return True
    return banded(a.tolist(), b.tolist(), most)


def _sketch_rows(documents: DataFrame, id_col: str, text_col: str, kinds) -> DataFrame:
    """id, sha, n_words, sketch and words (32-bit hashes in a row of bytes) of every row; no text."""
    m = sum(kind[1] for kind in kinds)

    def run(batches):
        worker_state("near_dup", dict)  # what another operator kept in this worker goes
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, 1 << 19):
                h, words = word_hashes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                found = all_sketches(h, words, kinds)
                flat = pa.array(found.astype(np.int64).ravel())
                h = (h >> np.uint64(32)).astype("<u4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * m), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(np.diff(words).astype(np.int64)), lists,
                     pa.array([h[words[i]: words[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    names=["id", "sha", "n_words", "sketch", "words"])

    kind = documents.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, sha binary, n_words long, sketch array<long>, words binary")


def _checked(pairs: DataFrame, words: DataFrame, fifth: int) -> DataFrame:
    """The links among the pairs (a, b): those whose word rows are similar."""
    kind = pairs.schema["a"].dataType.simpleString()
    joined = (pairs.join(by_shuffle(words.select(F.col("id").alias("a"), F.col("words").alias("a_words"))), "a")
              .join(by_shuffle(words.select(F.col("id").alias("b"), F.col("words").alias("b_words"))), "b"))

    def run(frames):
        for frame in frames:
            same = np.array([similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), fifth)
                             for x, y in zip(frame["a_words"], frame["b_words"])], bool)
            yield pd.DataFrame({"a": frame["a"][same], "b": frame["b"][same]})

    return cut(joined.select("a", "b", "a_words", "b_words").mapInPandas(run, f"a {kind}, b {kind}").distinct())


def _near(n: str, other: str, fifth: int):
    """Lengths that differ by more than the limit need no words to be told apart."""
    return fifth * F.abs(F.col(n) - F.col(other)) <= F.greatest(n, other)


def _mixed(entries: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, n_words, class, p) of keys of several classes: with ``main``, the key's largest class, and
    whether the rows of other classes are ``few``."""
    # most keys hold one class: what they need is one row a key; the join has one row a key on its other side, and is made once
    sizes = entries.groupBy("key", "class").agg(F.count("*").alias("n"))
    keys = cut(sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("class", "n").alias("main"),
                                        F.count("*").alias("classes"))
               .where("classes > 1").select("key", "main", (F.col("n") - F.col("top") <= small).alias("few")))
    rows = cut(entries.join(by_shuffle(keys), "key"))
    return rows.where("few"), rows.where("NOT few").drop("main", "few")


def _across(rows: DataFrame, fifth: int, shared: int = 1, words: int = 0) -> DataFrame:
    """Pairs (a, b) of different classes in a key: the rows outside its main class, each with all of the key.

    Where rows have the buckets that they come from, a pair has one in common.
    Where they have the words ``before`` the key's, a pair is made once: at the
    word that is the ``shared``-th that it has in common, or the last that similar
    texts of its length must have, if that is less. With ``words``, the rows of a key
    have had at most that many words in common, the last at place ``p``: similar texts
    have met at the first that they share, and so had few others before.
    """
    within = [c for c in ("buckets", "before") if c in rows.columns]
    out = rows.where("class <> main").select("key", F.col("id").alias("o_id"), F.col("n_words").alias("o_words"),
                                             F.col("class").alias("o_class"), F.col("p").alias("o_p"), *[F.col(c).alias(f"o_{c}") for c in within])
    met = rows.join(by_shuffle(out), "key").where(
        (F.col("class") != F.col("o_class")) & _near("n_words", "o_words", fifth)
        & ((F.col("class") == F.col("main")) | (F.col("o_id") < F.col("id"))))
    longest = F.greatest("n_words", "o_words")
    if words:
        spare = F.floor(longest / fifth) + F.lit(words - 1) - longest
        met = met.where((F.col("p") <= F.col("n_words") + spare) & (F.col("o_p") <= F.col("o_words") + spare))
    if "buckets" in within:
        met = met.where(F.arrays_overlap("buckets", "o_buckets"))
    if "before" in within:
        met = met.where(F.size(F.array_intersect("before", "o_before")) + 1 == F.least(F.lit(shared), longest - F.floor(longest / fifth)))
    return met.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()


def _in_a_bucket(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """The pairs (a, b) that have a bucket in common."""
    of = lambda c: by_shuffle(buckets.select(F.col("id").alias(c), F.col("buckets").alias(f"{c}_buckets")))
    return (pairs.join(of("a"), "a").join(of("b"), "b").where(F.arrays_overlap("a_buckets", "b_buckets"))
            .select("a", "b").distinct())


def _frequencies(words: DataFrame) -> np.ndarray:
    """How often the words of each of 2 ** COUNTS ranges of hashes occur: a table of fixed size."""

    def run(batches):
        n = np.zeros(1 << COUNTS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), "<u4") >> np.uint32(32 - COUNTS), minlength=1 << COUNTS)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(at[k: k + (1 << 14)]), pa.array(n[at[k: k + (1 << 14)]])], names=["at", "n"])

    found = words.select("words").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << COUNTS, np.int64)
    out[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def rare_words(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit names of the first ``n`` words of a row, equal ones told apart by occurrence, in one order
    of all words that has the rare ones first; words that occur once in all rows are left out."""
    h = np.sort(h)
    first = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), np.arange(len(h)), 0))
    occurrence = np.arange(len(h)) - first
    often = counts[h >> np.uint32(32 - COUNTS)]
    order = np.lexsort((occurrence, h, often))[:n]
    places = np.flatnonzero(often[order] > 1)
    order = order[places]
    return places, (h[order].astype(np.int64) << 32) | occurrence[order]


def _rare(words: DataFrame, fifth: int) -> DataFrame:
    """id, n_words and rare: the first words of each text's row of rare words, with their places."""
    counts, kind = _frequencies(words), words.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(1)]
            found = [rare_words(h, counts, len(h) // fifth + 1 + DEEP) for h in found]
            ends = np.append(0, np.cumsum([len(x[0]) for x in found])).astype(np.int32)
            none = [np.zeros(0, np.int64)]
            made = pa.StructArray.from_arrays([pa.array(np.concatenate(none + [x[k] for x in found])) for k in (0, 1)], names=["p", "e"])
            n = pa.array([len(x) // 4 for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.ListArray.from_arrays(pa.array(ends), made)],
                                             names=["id", "n_words", "rare"])

    return words.select("id", "words").mapInArrow(run, f"id {kind}, n_words long, rare array<struct<p:bigint,e:bigint>>")


def links(texts: DataFrame, small: int = SMALL, fifth: int = FIFTH, large: int = LARGE) -> DataFrame:
    """Links (a, b) between different texts: ``texts`` has id, n_words, sketch and words of one row a text."""
    spark = texts.sparkSession
    texts = texts.where("n_words > 0")
    sizes = texts.select("id", "n_words")
    entries = (texts.select("id", "n_words", F.posexplode("sketch").alias("band", "value"))
               .select(F.xxhash64("band", "value").alias("key"), "id", "n_words"))
    stars = cut(entries.groupBy("key").agg(F.min("id").alias("star"), F.count("*").alias("n")).where("n > 1").drop("n"))
    shared = stored(entries.join(by_shuffle(stars), "key"), "near-buckets")
    released(spark)
    words = texts.select("id", "words")
    met = (shared.where("id <> star").select("star", "id", "n_words").distinct()
           .join(by_shuffle(sizes.select(F.col("id").alias("star"), F.col("n_words").alias("star_words"))), "star")
           .where(_near("n_words", "star_words", fifth)))
    done = cut(met.select(F.col("star").alias("a"), F.col("id").alias("b")))
    found = _checked(done, words, fifth)
    released(spark)
    # one class table; of the buckets that hold several classes, the rows go on
    roots = cut(components(found).withColumnRenamed("node", "id"))
    each = shared.select("key", "id", "n_words").join(by_shuffle(roots), "id", "left").select(
        "key", "id", "n_words", F.coalesce("root", "id").alias("class"), F.lit(-1).cast("long").alias("p"))
    pairs, many = _mixed(each, small)
    pairs, depth, kept = _across(pairs, fifth), 0, []
    released(spark)
    if not many.isEmpty():
        some = words.join(by_shuffle(many.select("id").distinct()), "id", "left_semi")
        rare = stored(_rare(some, fifth), "near-rare")
        # a row's buckets are kept apart from its entries in the first lists: the same for each of them
        buckets = stored(many.groupBy("id", "n_words").agg(F.collect_set("key").alias("buckets")), "near-lists")
        kept = [rare, buckets]
        many = many.select(F.lit(0).cast("long").alias("key"), "id", "n_words", "class", "p").distinct()
    while not many.isEmpty():
        if depth == 1:
            split = (many.withColumn("bucket", F.explode("buckets"))
                     .withColumn("key", F.xxhash64("key", "bucket")).withColumn("buckets", F.array("bucket")).drop("bucket"))
        else:
            # the lists go DEEP words further at first, see below
            reach = F.floor(F.col("n_words") / fifth) + 1 + F.lit(depth - 1 if depth else DEEP)
            next_ = F.explode_outer(F.filter("rare", lambda x: (x["p"] > F.col("p")) & (x["p"] < reach)))
            split = (many.join(by_shuffle(rare), ["id", "n_words"]).select(*many.columns, next_.alias("x")).where("x IS NOT NULL")
                     .withColumn("key", F.xxhash64("key", "x.e")).withColumn("p", F.col("x.p")).drop("x"))
        depth += 1
        split = stored(split, "near-split")
        few, many = _mixed(split, large if depth < DEEP else 1 << 62)
        dropped(split)
        released(spark)
        if depth == 1 and many.isEmpty():
            # similar texts share one word more for each that the lists go further: where no list is left out, that many count
            before = F.transform(F.filter("rare", lambda x: x["p"] < F.col("p")), lambda x: x["e"])
            # the first words of a row have too few before them to be the last of these
            last = F.size(before) + 1 >= F.least(F.lit(1 + DEEP), F.col("n_words") - F.floor(F.col("n_words") / fifth))
            few = (few.join(by_shuffle(rare), ["id", "n_words"]).where(last)
                   .select(*few.columns, before.alias("before")))
            new = _in_a_bucket(cut(_across(few, fifth, 1 + DEEP, 1 + DEEP)), buckets)
        else:
            # else the first that they share is enough: it is among the first fifth and one, the next is among one more
            step = max(1, depth - 1)
            first = F.col("p") < F.floor(F.col("n_words") / fifth) + F.lit(step)
            few, many = few.where(first), many.where(first)
            if depth == 1:
                few, many = (x.join(by_shuffle(buckets), ["id", "n_words"]) for x in (few, many))
            new = _across(few, fifth, words=step)
        pairs = cut(pairs.unionByName(new).distinct())
        released(spark)
    pairs = cut(pairs.join(by_shuffle(done), ["a", "b"], "left_anti"))
    dropped(shared, *kept)
    return found.unionByName(_checked(pairs, words, fifth))


def _classes(documents: DataFrame, id_col: str, text_col: str, kinds, small: int, fifth: int, large: int) -> DataFrame:
    """t_sha, t_id (the smallest id of the text) and class_id of each different text."""
    ready(documents.sparkSession)
    each = _sketch_rows(documents, id_col, text_col, kinds)
    texts = stored(each.groupBy("sha").agg(F.min("id").alias("id"), F.first("n_words").alias("n_words"),
                                           F.first("sketch").alias("sketch"), F.first("words").alias("words")), "near-texts")
    released(documents.sparkSession)
    found = links(texts.where("id IS NOT NULL").drop("sha"), small, fifth, large)
    roots = cut(components(found))
    classes = cut(texts.select(F.col("sha").alias("t_sha"), F.col("id").alias("t_id"))
                  .join(by_shuffle(roots), F.col("t_id") == F.col("node"), "left")
                  .select("t_sha", "t_id", F.coalesce("root", "t_id").alias("class_id")))
    dropped(texts)
    released(documents.sparkSession)
    return classes


def _sha(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS,
                    small: int = SMALL, fifth: int = FIFTH, large: int = LARGE) -> DataFrame:
    """id and class_id (the smallest id of the class) of every row."""
    documents = documents.select(id_col, text_col)
    classes = _classes(documents, id_col, text_col, kinds, small, fifth, large)
    rows = documents.select(F.struct(id_col).alias("row"), _sha(text_col).alias("row_sha"))
    return (rows.join(by_shuffle(classes), F.col("row_sha") == F.col("t_sha"), "left")
            .select(F.col(f"row.`{id_col}`").alias(id_col), "class_id"))


def without_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds=KINDS,
                       small: int = SMALL, fifth: int = FIFTH, large: int = LARGE) -> DataFrame:
    """The rows, all columns kept, of one document of each class: the one with the smallest id.

    Of rows with the same id one stays. Texts that only occur without an id
    stay once each.
    """
    classes = _classes(documents.select(id_col, text_col), id_col, text_col, kinds, small, fifth, large)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            F.col(f"`{id_col}`").alias("row_id"), _sha(text_col).alias("row_sha"))
    kept = rows.join(by_shuffle(classes), F.col("row_sha") == F.col("t_sha")).where(
        (F.col("row_id") == F.col("class_id")) | (F.col("row_id").isNull() & F.col("t_id").isNull()))
    one = kept.withColumn("row_sha", F.when(F.col("row_id").isNull(), F.col("row_sha"))).dropDuplicates(["row_id", "row_sha"])
    return one.select("row.*")
