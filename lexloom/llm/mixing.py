"""Mixing sources to target weights, with DataFrame functions only.

Every document has a 60-bit hash of its id. Per source a number of whole passes plus the documents whose hash lies
below a threshold make up the target. The threshold comes from nested histograms: words by source and hash bucket,
then the same inside the one bucket where the budget ends, and so on. No document is sorted or moved; only the
histograms (buckets x sources rows) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import word_count
from lexloom.session import discard, materialize

HASH_BITS, LEVEL_BITS = 60, 10


def id_hash(c: Column) -> Column:
    """60 bits of the MD5 of the id as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_ranks(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights dealt to the sources by code point, null last. Ranks are positions in a range partition plus the sizes
    of the partitions before it, so that no task sees all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialize(sizes.repartitionByRange(8, *order).withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # 8 rows at most
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("long")
    return parts.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"))


def targets(ranked: DataFrame, max_repeat: int) -> DataFrame:
    """weight * level for the level at which the targets add up to all words, where none is above max_repeat times its
    source. In the order of cap by weight, with the sums of caps and weights before each source, the level is that of the
    first source whose share of what they leave is below its cap. Three numbers reach the driver."""
    cap = F.col("source_size") * max_repeat
    order = ["ratio", "none", "source"]
    rows = ranked.withColumns({"cap": cap, "ratio": cap / F.col("weight"), "none": F.col("source").isNull()})
    parts = materialize(rows.repartitionByRange(8, *order).withColumn("part", F.spark_partition_id()), "caps")
    before = parts.groupBy("part").agg(F.sum("cap").alias("c"), F.sum("weight").alias("w"))  # 8 rows at most
    over = Window.orderBy("part")
    before = before.select("part", (F.sum("c").over(over) - F.col("c")).alias("c_before"), (F.sum("w").over(over) - F.col("w")).alias("w_before"))
    total, weights = (x or 0 for x in parts.agg(F.sum("source_size"), F.sum("weight")).first())
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = parts.withColumns({"c_in": F.sum("cap").over(inside) - F.col("cap"), "w_in": F.sum("weight").over(inside) - F.col("weight")}).join(F.broadcast(before), "part")
    level = (F.lit(total).cast("double") - F.col("c_in") - F.col("c_before")) / (F.lit(weights) - F.col("w_in") - F.col("w_before"))
    level = sums.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct(*order))).first()[0]
    share = F.col("weight") * F.lit(level or 0.0)
    return ranked.withColumn("target", F.when(share >= cap, cap.cast("double")).otherwise(share))


def thresholds(docs: DataFrame, goal: DataFrame, name: str = "mix") -> DataFrame:
    """goal with the columns passes and threshold. docs: source, size, hash. goal: source, source_size, target.

    The last bucket has a single hash. Its documents join if the sum then is nearer to the target.
    """
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = materialize(
        goal.withColumn("passes", passes)
        .withColumn("rest", F.col("target") - F.col("passes") * size)
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("threshold", F.when(F.col("rest") <= 0, F.lit(0)).cast("long")),
        f"{name}-state",
    )
    w = Window.partitionBy("source").orderBy("bucket")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = state.filter("threshold IS NULL").select(F.col("source").alias("s"), "prefix")
        bucket = F.shiftright("hash", shift)
        inside = docs.join(open_, docs["source"].eqNullSafe(F.col("s")) & (F.shiftright(bucket, LEVEL_BITS) == F.col("prefix")))
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        cum = hist.withColumn("upto", F.sum("sum").over(w)).join(
            state.filter("threshold IS NULL").select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))
        )
        edge = (
            cum.filter(F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min_by(F.struct("bucket", "low", "high", "upto", "sum"), "bucket").alias("e"))
            .select(F.col("source").alias("s"), "e.*")
        )
        left = F.col("rest") - (F.col("upto") - F.col("sum"))
        alone = F.col("low") == F.col("high")
        found = (
            F.when(F.col("threshold").isNotNull(), F.col("threshold"))
            .when(F.col("bucket").isNull(), F.lit(1 << HASH_BITS))  # all of them fit
            .when(alone, F.when(F.col("upto") - F.col("rest") < left, F.col("low") + 1).otherwise(F.col("low")))
        )
        old, state = state, materialize(
            state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "passes", F.when(F.col("bucket").isNull(), F.col("rest")).otherwise(left).alias("rest"),
                F.coalesce("bucket", "prefix").alias("prefix"), found.alias("threshold"),
            ),
            f"{name}-state",
        )
        discard(old)
        if state.filter("threshold IS NULL").isEmpty():
            break
    return state


def sized(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash"))


def assign(docs: DataFrame, state: DataFrame) -> DataFrame:
    """docs (source, size, hash, any others) with source_size, target, copies and taken. The table of sources is
    broadcast below Spark's threshold and joined by shuffle above it."""
    s = state.select(F.col("source").alias("mix_key"), "source_size", "target", "passes", "threshold")
    copies = F.col("passes") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    out = docs.join(s, F.col("source").eqNullSafe(F.col("mix_key"))).withColumn("copies", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("mix_key", "passes", "threshold")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The table of sources: source, source_size, target, passes, rest, prefix, threshold. docs: source, size, hash."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(docs, targets(materialize(source_ranks(sizes, weights), "ranks"), max_repeat))


def mix_report(df: DataFrame, **names) -> DataFrame:
    """How much of each document the mix takes: id, source, size, source_size, target, copies, taken.

    A null text has size 0 and takes nothing. Null sources are one source, the last. Rows with one id share its hash
    and are taken or left together. An empty table gives an empty result. Other columns are not read.
    """
    docs = materialize(sized(df, **names), "mix-sizes")  # id, source, size, hash: the texts are read once
    return assign(docs, plan_mix(docs)).drop("hash")


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The mixed corpus itself: every row of df as often as the mix takes it, with the columns of df.

    A source whose texts are all empty has target 0 and gives no rows.
    """
    docs = materialize(sized(df, id_col=id_col, text_col=text_col, source_col=source_col), "mix-sizes")
    s = plan_mix(docs, weights, max_repeat).select(F.struct("source", "passes", "threshold").alias("mix plan"))
    out = df.withColumn("mix hash", id_hash(F.col(id_col))).join(s, F.col(source_col).eqNullSafe(F.col("mix plan.source")))
    copies = F.col("mix plan.passes") + F.when(F.col("mix hash") < F.col("mix plan.threshold"), 1).otherwise(0)
    out = out.withColumn("mix copies", copies).filter("`mix copies` > 0")
    return out.withColumn("mix copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix copies")))).select(*[F.col(f"`{c}`") for c in df.columns])
