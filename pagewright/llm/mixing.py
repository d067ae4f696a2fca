"""Mixing sources to target weights.

Words are summed per source, a repetition rate follows for each source, and every document is
emitted floor(rate) times plus one more copy with probability rate - floor(rate). That draw is a
function of the seed and the doc_id alone, so reruns and retried tasks agree.

Only (source, words) is shuffled, with partial sums, so a hot source costs one row per task. The
table of sources has one row per source; it is broadcast if it has few rows and joined by a shuffle
that AQE may split otherwise. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, n_words, small_side

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2.0
SEED = "mix-1"


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the seed and the id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, max_repeats: float) -> DataFrame:
    """One row per source: source, source_size, target.

    A target is min(cap, level * weight). With the sources in order of cap / weight, the level at
    which the targets share out the total is the largest of (total - caps of the first k) /
    (weights of the rest), over k: the same as to share by weight, cut at the caps and share the
    excess again until no target is above its cap.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .select("source", "source_size", "place", weight.alias("weight"), (F.col("source_size") * F.lit(max_repeats)).alias("cap"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("rest")).over(everything))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Per row of `docs` (doc_id, text, source, any others): row (all its columns), size, source_size,
    target, copies.

    Null and empty texts have size 0. Null is a source of its own, last in order. Rows that repeat a
    doc_id get the same number of copies; null ids share one draw. A source without words has
    target 0 and no copies. No rows give no rows.
    """
    sized = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    targets = materialise(source_targets(sized.select("source", "size"), weights, share, max_repeats), "mix-targets")
    targets = small_side(targets.withColumnRenamed("source", "target_source"), targets.count())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("rate", rate)
        .select("row", "size", "source_size", "target", (F.floor("rate") + extra).alias("copies"))
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row of `docs` as often as mix_plan() says, with the columns of `docs`."""
    planned = mix_plan(docs, **options).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
