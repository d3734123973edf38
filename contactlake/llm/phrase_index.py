"""Benchmark decontamination with a distributed positional inverted index.

The index holds one posting (word, document, position) for each word of the
corpus that an item asks for, written as Parquet without a shuffle: each file
is the index of one shard of documents, list after list in the order of a hash
of the word. The list of the empty word holds the documents themselves, with
their numbers of words. Items are searched in it by rising list length:

1. Windows. A window is ``window`` consecutive words of an item (all of a
   shorter item). Postings a word are counted; the words of a window are put
   in order from the rarest. A window that holds a word without postings can't
   occur.
2. Intersect. The list of the rarest word, less the word's offset in the item,
   gives the alignments (item, document, shift) that may hold the window. They
   are joined with the list of the next rarest word at its own offset. Windows
   beside each other mostly share their rarest word, so that an alignment is
   kept once for all of them.
3. Phrases. What is left is met with the lists of all other words of its
   windows, in the documents concerned only. A run of ``window`` matched
   offsets of an alignment or more is an occurrence, and its words are hit.

``proximity_matches`` finds documents in which all words of an item stand
within a span of words, in any order, from the rarest word's postings too.

DataFrame operations only. Tables made here are written to the shared folder
and read again, so that the planner knows their size: it broadcasts the small
ones and shuffles the others; no join has a hint. A frequent word's list is
never in one place: where the vocabulary is broadcast, postings stay where
they were read, and adaptive execution splits a large key elsewhere.

Defined cases: null and empty texts, and texts without words, have no words
and no hits; an item without words doesn't occur; items with the same words
are searched once and each counted by its id; a null item id is written as an
empty string; items with equal ids and different words count once; documents
are told apart by id and text, so rows that repeat both have the same result
each; an empty table gives an empty result, empty items give no hits; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: ASCII letters and digits, and all beyond ASCII: two tests a character, where five ranges would take five.
WORD = r"[\p{Alnum}\P{ASCII}]+"
WINDOW = 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text in order, as they are written; none of a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return (F.when(F.octet_length(word) == F.length(word), F.lower(word))
            .otherwise(F.translate(word, _UPPER, _UPPER.lower())))


def _document_key(documents: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell documents apart: the id, and a hash of the text and of whether there is an id."""
    kind = documents.schema[id_col].dataType
    return [F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("doc"),
            F.xxhash64(F.col(text_col), F.col(id_col).isNull()).alias("h")]


class Items:
    """Test items: their different word rows, numbered, and the ids that each stands for."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
        each = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                            F.transform(words(F.col(text_col)), lowered).alias("words")).where(F.size("words") > 0)
        folded = stored(each.select("words").distinct().select(F.monotonically_increasing_id().alias("item"), "words"), "items")
        self.ids = stored(each.join(folded, "words").select("item", "item_id").distinct(), "item-ids")
        self.words = folded.select("item", F.size("words").alias("m"), F.posexplode("words").alias("q", "word"))
        self.vocabulary = stored(self.words.select("word").distinct(), "vocabulary")


def build_index(documents: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Postings (word, doc, h, pos) of all words, or of those in ``vocabulary`` (word), written by shard.

    Those of the empty word have n_words, and in ``no_id`` whether the
    document's id is null.
    """
    found = words(F.col(text_col))
    # keys, length and list are settled below the generator, which would work them out for each word; the outer form
    # keeps the planner from testing the list in a filter before
    each = documents.select(*_document_key(documents, id_col, text_col), F.col(id_col).isNull().alias("no_id"),
                            F.size(found).cast("long").alias("n_words"), F.concat(F.array(F.lit("")), found).alias("words"))
    head = F.col("pos") == 0
    postings = (each.select("doc", "h", "no_id", "n_words", F.posexplode_outer("words").alias("pos", "word"))
                .select(lowered(F.col("word")).alias("word"), "doc", "h", (F.col("pos") - 1).alias("pos"),
                        F.when(head, F.col("n_words")).alias("n_words"), F.when(head, F.col("no_id")).alias("no_id")))
    if vocabulary is not None:
        empty = vocabulary.sparkSession.range(1).select(F.lit("").alias("word"))
        postings = postings.join(vocabulary.unionByName(empty), "word", "left_semi")
    # a list lies in one place of a file; by a hash of the word the sort needs no comparison of strings
    return stored(postings.sortWithinPartitions(F.xxhash64("word")), "postings")


def _ranked(postings: DataFrame, items: Items) -> DataFrame:
    """item, m, q, word and n, the number of the word's postings."""
    counts = postings.join(items.vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return stored(items.words.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))), "item-words")


def phrase_matches(postings: DataFrame, items: Items, window: int = WINDOW) -> DataFrame:
    """item, doc, h, pos of every word of a document that stands in an occurrence of a window of an item."""
    ranked = _ranked(postings, items)
    ahead = Window.partitionBy("item").orderBy("q").rowsBetween(0, window - 1)
    rare = F.array_sort(F.collect_list(F.struct("n", "q", "word")).over(ahead))
    # a window of one word meets its own list twice
    second = F.coalesce(F.get("rare", F.lit(1)), F.get("rare", F.lit(0)))
    windows = stored(
        ranked.withColumn("rare", rare)
        .where((F.col("q") <= F.greatest(F.col("m") - window, F.lit(0))) & (F.col("rare")[0]["n"] > 0))
        .withColumn("second", second)
        .select("item", F.col("q").alias("first"), F.least("m", F.lit(window)).alias("width"),
                F.col("rare")[0]["q"].alias("q1"), F.col("rare")[0]["word"].alias("word1"),
                F.col("second.q").alias("q2"), F.col("second.word").alias("word2")), "windows")
    # a word that stands twice at q in different windows has one list: alignments of an anchor, not of a window
    anchors = windows.select("item", "q1", F.col("word1").alias("word")).distinct()
    shifts = stored(postings.join(anchors, "word").select("item", "q1", "doc", "h", (F.col("pos") - F.col("q1")).alias("shift")),
                    "alignments")
    pairs = windows.select("item", "q1", "q2", F.col("word2").alias("word")).distinct()
    asked = shifts.join(pairs, ["item", "q1"]).withColumn("pos", F.col("shift") + F.col("q2"))
    both = asked.join(postings.join(pairs.select("word").distinct(), "word", "left_semi"), ["word", "doc", "h", "pos"]
                      ).select("item", "q1", "q2", "doc", "h", "shift").distinct()
    left = stored(both.join(windows.select("item", "q1", "q2", "first", "width"), ["item", "q1", "q2"])
                  .where(F.col("shift") + F.col("first") >= 0)
                  .select("item", "doc", "h", "shift", "first", "width").distinct(), "survivors")
    docs = stored(left.select("doc", "h").distinct(), "survivor-documents")
    offsets = (left.select("item", "doc", "h", "shift", F.explode(
        F.sequence(F.col("first"), F.col("first") + F.col("width") - 1)).alias("q")).distinct()
        .join(ranked.select("item", "q", "m", "word"), ["item", "q"])
        .withColumn("pos", (F.col("shift") + F.col("q")).cast("int")))
    there = postings.join(docs, ["doc", "h"], "left_semi")
    matched = offsets.join(there, ["doc", "h", "pos", "word"]).select("item", "doc", "h", "shift", "q", "m").distinct()
    by_shift = Window.partitionBy("item", "doc", "h", "shift")
    runs = matched.withColumn("run", F.col("q") - F.row_number().over(by_shift.orderBy("q")))
    long = (runs.withColumn("n", F.count("*").over(Window.partitionBy("item", "doc", "h", "shift", "run")))
            .where(F.col("n") >= F.least("m", F.lit(window))))
    return long.select("item", "doc", "h", (F.col("shift") + F.col("q")).alias("pos")).distinct()


def proximity_matches(postings: DataFrame, items: Items, within: int) -> DataFrame:
    """item, doc, h, first, last: spans of at most ``within`` words that hold all different words of an item.

    Spans are those that begin at one of the item's words and end at the first
    place by which all have been met, each once; those that hold no other
    shorter one are among them.
    """
    ranked = _ranked(postings, items)
    each = ranked.groupBy("item", "word").agg(F.min("n").alias("n"))
    heads = each.groupBy("item").agg(F.min(F.struct("n", "word")).alias("least"), F.count("*").alias("k"))
    heads = stored(heads.where((F.col("least.n") > 0) & (F.col("k") <= within))
                   .select("item", "k", F.col("least.word").alias("word")), "heads")
    block = F.floor(F.col("pos") / within)
    anchors = stored(postings.join(heads, "word").select("item", "k", "doc", "h", F.col("pos").alias("at")), "anchors")
    asked = (anchors.join(each.select("item", "word"), "item")
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / within) - 1, F.floor(F.col("at") / within) + 1))))
    lists = postings.join(items.vocabulary, "word", "left_semi").withColumn("block", block)
    near = asked.join(lists, ["word", "doc", "h", "block"]).where(F.abs(F.col("pos") - F.col("at")) < within)
    around = near.groupBy("item", "k", "doc", "h", "at").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("met"))
    # a span has as many starts as met places before the anchor; it ends where the last of the k words is first met
    spans = around.select("item", "k", "doc", "h", "at", "met", F.explode("met.pos").alias("first")).where("first <= at")
    inside = F.filter("met", lambda x: (x["pos"] >= F.col("first")) & (x["pos"] < F.col("first") + within))
    ends = F.array_sort(F.transform(F.array_distinct(F.transform(inside, lambda x: x["word"])), lambda w: F.array_min(
        F.transform(F.filter(inside, lambda x: x["word"] == w), lambda x: x["pos"]))))
    found = spans.withColumn("ends", ends).where(F.size("ends") == F.col("k"))
    return found.select("item", "doc", "h", "first", F.element_at("ends", -1).alias("last")).where("last >= at").distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    items = Items(benchmark, item_id_col, item_text_col)
    postings = build_index(documents, items.vocabulary, id_col, text_col)
    hits = stored(phrase_matches(postings, items, window), "hits")
    n_hit = hits.select("doc", "h", "pos").distinct().groupBy("doc", "h").agg(F.count("*").alias("n_hit"))
    ids = hits.select("doc", "h", "item").distinct().join(items.ids, "item").groupBy("doc", "h").agg(
        F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = n_hit.join(ids, ["doc", "h"]).withColumnRenamed("doc", "f_doc").withColumnRenamed("h", "f_h")
    rows = postings.where("word = ''")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (rows.join(found, (F.col("doc") == F.col("f_doc")) & (F.col("h") == F.col("f_h")), "left")
            .select(F.when(~F.col("no_id"), F.col("doc")).alias(id_col), "n_words", n.alias("n_hit"),
                    F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
                    (n > 0).alias("contaminated")))
