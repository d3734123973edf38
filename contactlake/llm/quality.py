"""Quality rules: fixed base rules, then robust multivariate outliers.

Each text gets counts (words, their characters, symbols, repeated lines,
words in repeated 3-word windows). ``base_failed`` are texts of fewer than 50
words or with more than half of their words in repeated windows. The others
are judged by language and source: the counts are transformed (logarithms and
ratios), location and scatter of each group are estimated by the minimum
covariance determinant, and a row whose squared Mahalanobis distance exceeds
the cut-off is rejected.

The estimate follows the usual concentration steps, run over all groups at
once as aggregations, from several starts a group side by side: the median of
each component with its quartile range, and the median and both quartiles with
the narrower side of that range, which copies on one side can't widen. The
``HALF`` of the rows nearest to the present centre give the next mean and
covariance, ``STEPS`` times; of a group's fits the one with the least
determinant stays, and one more step takes all rows within a quantile
(reweighting). In the determinants a direction thinner than ``FLOOR`` counts as
``FLOOR``, so that a group of copies doesn't win by having no scatter of its
own, and another start than the first must have less than ``LESS`` times the
first one's, as fits to the same rows differ a little. The distance that bounds the nearest rows is found
from counts by a fine logarithmic grid of distances, so that no group is ever
gathered or sorted in one task. A row keeps only six numbers.

Groups with fewer than ``LEAST`` rows that pass the base rules are judged by
the estimate of their language, and if that is small too, by that of all rows;
with fewer than ``LEAST`` in all, only the base rules reject. ``FLOOR`` is the
least standard deviation of a component, so that a component which is constant
in most of a group doesn't make a small difference an outlier.

Defined cases: a null or empty text has zero counts and fails the base rules;
null languages and null sources are groups of their own; repeated rows count
each for itself; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint_dir, cut, ready, texts

STEPS = 4
HALF = 0.5
LESS = 0.5
LEAST = 60
#: Least standard deviations: log words, characters a word, then shares (symbols, lines, windows).
FLOOR = (0.25, 0.25, 0.02, 0.05, 0.05)
#: Squared distance beyond which a row is rejected: the 0.999 quantile of chi-square with 5 degrees of freedom.
CUT_OFF = 20.515
#: Chi-square with 5 degrees of freedom: its 0.975 quantile, and what makes the scatter of the nearest
#: half, or of the rows within that quantile, that of all (share over the chi-square probability
#: with 7 degrees of the same quantile).
_Q975, _FACTOR_HALF, _FACTOR_975 = 12.8325, 1.912, 1.055
_GRID = 16
P = len(FLOOR)
_WORD, _SYMBOL = re.compile(WORD), re.compile(r"[#*$%&|<>]")


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORD.findall(text)
    lines = Counter(x for x in text.split("\n") if _WORD.search(x))
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    windows = list(zip(ids, ids[1:], ids[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1} if len(set(windows)) < len(windows) else ()
    repeated, reach = 0, 0
    if often:
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), sum(lines.values()) - len(lines), repeated)


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               source_col: str = "source") -> DataFrame:
    """id, lang, source, the five counts and base_failed of every row."""
    ready(documents.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = np.array([counts(x) for x in texts(part.column(3))], np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[pa.array(found[:, j]) for j in range(5)]],
                    names=["id", "lang", "source", *names])

    kinds = [documents.schema[c].dataType.simpleString() for c in (id_col, lang_col, source_col)]
    rows = documents.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                            F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(
        run, f"id {kinds[0]}, lang {kinds[1]}, source {kinds[2]}, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _vector() -> Column:
    """The transformed counts, as an array of P doubles."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return F.array(F.log(words), F.col("word_chars") / words, F.col("n_symbols") / words,
                   F.log1p(F.col("n_dup_lines").cast("double")) / F.lit(math.log(1000.0)),
                   F.col("n_repeat_words") / words)


def _distance(x: str, centre: str, inverse: str) -> Column:
    """Squared Mahalanobis distance, with the inverse scatter as P * P numbers in a row."""
    d = [F.col(x)[i] - F.col(centre)[i] for i in range(P)]
    terms = [d[i] * d[j] * F.col(inverse)[i * P + j] * F.lit(1.0 if i == j else 2.0)
             for i in range(P) for j in range(i, P)]
    return sum(terms[1:], terms[0])


def _fitted(groups: DataFrame, factor: float) -> DataFrame:
    """centre, inverse scatter and its log determinant in units of FLOOR, of each fit from its sums: one row a fit."""

    def run(frames):
        for frame in frames:
            inverse, size = [], []
            for n, sums, squares in zip(frame["n"], frame["sums"], frame["squares"]):
                mean = np.array(sums, float) / n
                c = np.zeros((P, P))
                c[np.triu_indices(P)] = np.array(squares, float) / n
                c = (c + np.triu(c, 1).T - np.outer(mean, mean)) * factor
                c += np.diag(np.maximum(np.array(FLOOR) ** 2 - np.diag(c), 0) + np.array(FLOOR) ** 2 * 1e-6)
                inverse.append(np.linalg.inv(c).ravel())
                size.append(np.log(np.maximum(np.linalg.eigvalsh(c / np.outer(FLOOR, FLOOR)), 1)).sum())
            frame["centre"] = [np.array(x, float) / n for x, n in zip(frame["sums"], frame["n"])]
            frame["inverse"], frame["size"] = inverse, size
            yield frame[["key", "start", "centre", "inverse", "size"]]

    return groups.mapInPandas(run, "key string, start int, centre array<double>, inverse array<double>, size double")


def _sums(rows: DataFrame, factor: float) -> DataFrame:
    """Estimates from (key, start, x): sums and products are added up map-side, then one row a fit is inverted."""
    x = [F.col("x")[i] for i in range(P)]
    groups = rows.groupBy("key", "start").agg(
        F.count("*").alias("n"), F.array(*[F.sum(a) for a in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i in range(P) for j in range(i, P)]).alias("squares"))
    return cut(_fitted(groups, factor))


def _start(rows: DataFrame) -> DataFrame:
    """The starts of each group, by medians and quartiles of each component, from counts by a grid of eighths of FLOOR."""
    step = F.element_at(F.array(*[F.lit(f / 8) for f in FLOOR]), F.col("i") + 1)
    cells = (rows.select("key", F.posexplode("x").alias("i", "v"))
             .groupBy("key", "i", F.floor(F.col("v") / step).alias("cell")).agg(F.count("*").alias("n")))
    run = Window.partitionBy("key", "i")
    share = F.sum("n").over(run.orderBy("cell")) / F.sum("n").over(run)
    at = [F.min(F.when(F.col("share") >= q, F.col("cell"))) for q in (0.25, 0.5, 0.75)]
    least = F.element_at(F.array(*[F.lit(f) for f in FLOOR]), F.col("i") + 1)
    wide = F.greatest((F.col("q2") - F.col("q0")) * F.col("step") / 1.349, least)
    narrow = F.greatest(2 * F.least(F.col("q2") - F.col("q1"), F.col("q1") - F.col("q0")) * F.col("step") / 1.349, least)
    starts = [("q1", wide), ("q1", narrow), ("q0", narrow), ("q2", narrow)]
    found = (cells.withColumn("share", share).groupBy("key", "i")
             .agg(*[a.alias(f"q{k}") for k, a in enumerate(at)])
             .withColumn("step", step)
             .select("key", "i", F.posexplode(F.array(*[
                 F.struct(((F.col(q) + 0.5) * F.col("step")).alias("middle"), spread.alias("spread"))
                 for q, spread in starts])).alias("start", "c"))
             .select("key", "start", "i", "c.*"))
    whole = found.groupBy("key", "start").agg(F.array_sort(F.collect_list(F.struct("i", "middle", "spread"))).alias("s"))
    inverse = F.flatten(F.array(*[F.array(*[
        1 / F.col("s")[i]["spread"] ** 2 if i == j else F.lit(0.0) for j in range(P)]) for i in range(P)]))
    return cut(whole.select("key", "start", F.col("s.middle").alias("centre"), inverse.alias("inverse")))


def _least(fits: DataFrame) -> DataFrame:
    """Of each group's fits the one with the least determinant, or the first if none is less than LESS times its."""
    size = F.col("size") - F.when(F.col("start") > 0, F.lit(math.log(LESS))).otherwise(F.lit(0.0))
    return cut(fits.groupBy("key").agg(F.min_by(F.struct("start", "centre", "inverse"), F.struct(size, "start")).alias("f"))
               .select("key", "f.*"))


def _with_distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Each row once a fit of its group, with start and d2."""
    fit = fit.select(F.col("key").alias("f_key"), "start", "centre", "inverse")
    return (rows.join(fit, F.col("key") == F.col("f_key"), "left")
            .withColumn("d2", _distance("x", "centre", "inverse")).drop("f_key", "centre", "inverse"))


def _nearest(rows: DataFrame, fit: DataFrame, share: float) -> DataFrame:
    """The rows of each group, once a fit, within the grid distance of the fit that holds ``share`` of the group."""
    near = _with_distance(rows, fit).withColumn(
        "cell", F.greatest(F.lit(-200), F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * _GRID)))
    cells = near.groupBy("key", "start", "cell").agg(F.count("*").alias("n"))
    run = Window.partitionBy("key", "start")
    most = (cells.withColumn("share", F.sum("n").over(run.orderBy("cell")) / F.sum("n").over(run))
            .where(F.col("share") >= share).groupBy(F.col("key").alias("m_key"), F.col("start").alias("m_start"))
            .agg(F.min("cell").alias("most")))
    return (near.join(most, (F.col("key") == F.col("m_key")) & (F.col("start") == F.col("m_start")))
            .where(F.col("cell") <= F.col("most")).select("key", "start", "x"))


def judge(stats: DataFrame, steps: int = STEPS, half: float = HALF, least: int = LEAST,
          cut_off: float = CUT_OFF) -> DataFrame:
    """``statistics`` rows with two more columns: distance (null: not judged) and kept."""
    checkpoint_dir(stats.sparkSession)
    good = ~F.col("base_failed")
    own = F.to_json(F.struct(F.coalesce("lang", F.lit("\x00")).alias("l"), F.coalesce("source", F.lit("\x00")).alias("s")))
    of_lang = F.to_json(F.struct(F.coalesce("lang", F.lit("\x00")).alias("l")))
    rows = cut(stats.withColumn("x", _vector()).withColumn("own", own).withColumn("of_lang", of_lang))
    lang, everything = Window.partitionBy("of_lang"), Window.partitionBy()
    by_own = (rows.where(good).groupBy("own", "of_lang").agg(F.count("*").alias("n"))
              .withColumn("n_lang", F.sum("n").over(lang)).withColumn("n_all", F.sum("n").over(everything))
              .withColumn("key", F.when(F.col("n") >= least, F.col("own"))
                          .when(F.col("n_lang") >= least, F.col("of_lang"))
                          .when(F.col("n_all") >= least, F.lit("all")))
              # a wider estimate that any group needs is made from all rows it is about
              .withColumn("fits", F.array_compact(F.array(
                  F.when(F.col("n") >= least, F.col("own")),
                  F.max(F.when(F.col("key") == F.col("of_lang"), F.col("key"))).over(lang),
                  F.max(F.when(F.col("key") == "all", F.col("key"))).over(everything))))
              .select(F.col("own").alias("g_own"), "key", "fits"))
    rows = cut(rows.join(cut(by_own), F.col("own") == F.col("g_own"), "left").drop("own", "of_lang", "g_own"))
    base = rows.where(good & F.col("key").isNotNull()).select(F.explode("fits").alias("key"), "x")
    fit = _start(base)
    for _ in range(steps):
        fit = _sums(_nearest(base, fit, half), _FACTOR_HALF)
    fit = _sums(_with_distance(base, _least(fit)).where(F.col("d2") <= _Q975), _FACTOR_975)
    return (_with_distance(rows, fit)
            .withColumn("distance", F.when(good, F.col("d2")))
            .withColumn("kept", good & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut_off))
            .drop("d2", "x", "key", "fits", "start"))


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", **how) -> DataFrame:
    """id, the five counts, base_failed, distance and kept of every row."""
    judged = judge(statistics(documents, id_col, text_col, lang_col, source_col), **how)
    return judged.drop("lang", "source").withColumnRenamed("id", id_col)
