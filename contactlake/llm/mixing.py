"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words; target over size is its rate. The whole
part of the rate is a number of certain copies of each document of the source;
the rest is the inclusion probability p of one more copy. Documents of a
source are ranked by (u / (1 - u)) / (p / (1 - p)), where u is a fixed random
number of the document's id, and taken in that order until the size they bring
is as near as possible to what is left of the target: a fixed-size sample with
unequal probabilities. As p is that of the source, all documents of one source
have the same odds: between sources chances differ, within a source the order
of the odds ratio falls together with the order of u, which is what is sorted.

The cut-off rank is found without gathering a source in one place: sizes are
summed by source and by one of ``BUCKETS`` ranges of u (map-side partial
sums), a running sum over these ranges finds the range in which the target is
met, the range is divided once more in the same way, and only the documents
of the last range are ordered, rows that are alike as one entry with their
number. If the target is met among rows that are alike, so many of them are
taken as bring it nearest; they are counted, not gathered, and given out again
in blocks of ``BLOCK`` rows. Rows meet their source's numbers by
source and one of ``SALTS`` hashes of the row, with the table of sources
repeated that often, so that a source with a third of all rows is spread over
as many tasks.

Defined cases: a null or empty text has size 0 and is taken whole (it brings
no words); a null source is a source of its own, ordered last; repeated rows
with the same id fall in order of size, text digest and (where columns are
kept) digest of the other columns; of those that agree in all of these as many
are taken as the target needs, no matter which; an empty table gives an empty
result. Extra columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BUCKETS = 1 << 10
SALTS = 32
BLOCK = 1000
SEED = "mix-1"
_UNIT = float(1 << 52)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_unit(key: Column, seed: str = SEED) -> Column:
    """A fixed number in [0, 1) of the key: 52 bits of its digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_UNIT)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): one row a source.

    Filling by weight under the ceilings ``most * source_size``: sources are
    put in order of ceiling over weight; with all before it at their ceilings,
    the first source that stays under its own fixes the level which it and all
    later ones get per unit of weight. The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1) % len(weights)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    open_level = F.when(F.col("ceiling") >= F.col("level") * F.col("weight"), F.col("level"))
    return (sizes
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int")))
            .withColumn("ceiling", F.lit(float(most)) * F.col("source_size"))
            .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything)
                                  - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
                        / F.sum("weight").over(after))
            # later sources' levels are lower, as what stands before them is cut at ceilings it doesn't reach
            .withColumn("level", F.max(open_level).over(everything))
            .select("source", "source_size",
                    F.least("ceiling", F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling"))).alias("target")))


def _with_source(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """The rows, with the columns of their source's row in ``plan``."""
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return rows.join(plan.withColumn("p_salt", F.explode(salts)),
                     F.col("source").eqNullSafe(F.col("p_source")) & (F.col("salt") == F.col("p_salt")), how)


def _cut_offs(rows: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """One row a source: whole copies, and how far the order of rank is taken.

    ``low`` is the share of u below which all rows are taken; ``last`` is the
    last rank taken at or above it (null: none there), ``n_last`` the number of
    rows that have it and ``n_taken`` how many of them are taken.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.select(
        F.col("source").alias("p_source"), "source_size", "target", F.floor(rate).alias("whole"),
        (rate - F.floor(rate)).alias("p"),
        (F.col("target") - F.floor(rate) * F.col("source_size")).alias("rest"))
    low, step = F.lit(0.0), 1.0
    for _ in range(2):  # two digits of u: a range left over holds one row in buckets ** 2
        step /= buckets
        digit = F.floor((F.col("u") - F.col("low")) / F.lit(step))
        inside = (_with_source(rows, plan.withColumn("low", low) if "low" not in plan.columns else plan)
                  .where((F.col("u") >= F.col("low")) & (digit < buckets)))
        sums = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        found = (sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
                 .withColumnRenamed("source", "s_source").withColumnRenamed("size", "s_size"))
        base = plan if "low" in plan.columns else plan.withColumn("low", low).withColumn("below", F.lit(0).cast("long"))
        at = (found.join(base, F.col("s_source").eqNullSafe(F.col("p_source")))
              .where(F.col("below") + F.col("before") + F.col("s_size") >= F.col("rest"))
              .groupBy("s_source").agg(F.min_by(F.struct("digit", "before"), "digit").alias("at")))
        plan = (base.join(at, F.col("p_source").eqNullSafe(F.col("s_source")), "left")
                .withColumn("below", F.col("below") + F.coalesce(F.col("at.before"), F.lit(0)))
                .withColumn("low", F.when(F.col("at").isNull(), F.lit(2.0))
                            .otherwise(F.col("low") + F.col("at.digit") * F.lit(step)))
                .drop("s_source", "at"))
        plan = cut(plan)
    edge = (_with_source(rows, plan)
            .where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.lit(step)))
            .groupBy("source", "rank", "below", "rest").agg(F.count("*").alias("n_last")))
    size = F.col("rank.size")
    run = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("below") - F.coalesce(F.sum(size * F.col("n_last")).over(run), F.lit(0))
    # the k-th of them is taken if half of it still fits: (k - 1/2) * size <= left
    most = F.when(size > 0, F.floor(F.col("left") / size + 0.5)).otherwise(F.when(F.col("left") >= 0, F.col("n_last")))
    last = (edge.withColumn("left", left).withColumn("n_taken", F.least(most, F.col("n_last"))).where("n_taken > 0")
            .groupBy("source").agg(F.max(F.struct("rank", "n_last", "n_taken")).alias("at"))
            .select(F.col("source").alias("l_source"), F.col("at.rank").alias("last"), "at.n_last", "at.n_taken"))
    return plan.join(last, F.col("p_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")


def _planned(documents: DataFrame, id_col: str, text_col: str, source_col: str, keep: bool,
             weights, share, most, seed, buckets) -> DataFrame:
    size = n_words(F.col(text_col))
    u = random_unit(F.col(id_col), seed)
    others = [c for c in documents.columns if c not in (id_col, text_col, source_col)] if keep else []
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    rank = F.struct(u.alias("u"), F.col(id_col).alias("id"), size.alias("size"),
                    F.xxhash64(F.col(text_col)).alias("digest"), rest.alias("rest"))
    salt = F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int").alias("salt")
    rows = cut(documents.select(F.col(source_col).alias("source"), salt, size.alias("size"), u.alias("u"),
                                rank.alias("rank"), F.col(id_col).alias("id")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = cut(_cut_offs(rows, cut(targets), buckets))
    if keep:
        rows = documents.select(F.struct(*documents.columns).alias("row"), F.col(source_col).alias("source"),
                                salt, size.alias("size"), u.alias("u"), rank.alias("rank"))
    # odds of u over odds of p rise with u inside a source, so that u's order is the order of rank
    part = ((F.col("p") > 0) & (F.col("rank") == F.col("last")) & (F.col("n_taken") < F.col("n_last")))
    extra = F.when((F.col("p") > 0) & ((F.col("u") < F.col("low")) | F.coalesce(
        F.col("rank") <= F.col("last"), F.lit(False))), F.lit(1)).otherwise(F.lit(0))
    whole = F.coalesce(F.col("whole"), F.lit(0))
    planned = _with_source(rows, plan, "left").withColumn("part", F.coalesce(part, F.lit(False)))
    out = [c for c in planned.columns if c not in ("part", "salt", "p_salt", "rank", "last")]
    some = plan.where("p > 0 AND n_taken < n_last")
    if some.isEmpty():
        return planned.select(*out, (whole + extra).cast("int").alias("copies"))
    # rows alike of which some are taken: one row with their number, given out again in blocks
    first = F.col("block") * F.lit(BLOCK)
    alike = (planned.where("part").groupBy("source", "rank").agg(*[F.any_value(c).alias(c) for c in out if c != "source"])
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_last") - 1) / F.lit(BLOCK)))))
             .repartition("source", "block")
             .withColumn("k", F.explode(F.sequence(first, F.least(first + F.lit(BLOCK), F.col("n_last")) - 1))))
    return (planned.where("NOT part").select(*out, (whole + extra).cast("int").alias("copies"))
            .unionByName(alike.select(*out, (whole + (F.col("k") < F.col("n_taken")).cast("int")).cast("int").alias("copies"))))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED,
        buckets: int = BUCKETS) -> DataFrame:
    """Per row: id, source, size, source_size, target, copies, pareto_rank.

    ``pareto_rank`` is (u / (1 - u)) / (p / (1 - p)); null where the source
    has no random part.
    """
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1),
                  (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    return (_planned(documents, id_col, text_col, source_col, False, weights, share, most, seed, buckets)
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                    "copies", odds.alias("pareto_rank")))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST,
                    seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mixed rows themselves, all columns kept: each as often as it is taken."""
    planned = _planned(documents, id_col, text_col, source_col, True, weights, share, most, seed, buckets)
    return (planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("row.*"))
