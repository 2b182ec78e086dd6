"""Line dedup by the spread of a line over sites.

Every line hash gets a HyperLogLog sketch of its sites; sketches merge in partial aggregation before the shuffle, so a
line that stands everywhere sends one small row per task. Estimates far from the threshold decide; lines near it get
exact distinct counts. A line of MIN_WORDS words or more on min_sites sites or more is boilerplate: its first occurrence
stays, so that no content leaves the corpus, and all others go. Shorter lines are prose, or whole short texts, that meet by
chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import SPACES
from lexloom.session import materialize

MIN_SITES, MIN_WORDS, LG_REGISTERS, MARKS = 5, 3, 10, 1 << 18
_LONG_ENOUGH = r"^[ \t-\r]*" + r"[^ \t-\r]+[ \t-\r]+" * (MIN_WORDS - 1) + r"[^ \t-\r]"
NEAR = 5 * 1.04 / (1 << LG_REGISTERS) ** 0.5  # five standard errors of the estimate


def _key(line: Column) -> Column:
    """96 bits; the lines of a corpus are far fewer than the square root of that."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def line_rows(df: DataFrame, *, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, th (the text's hash, which tells rows with one id apart), site, pos, key of every line of MIN_WORDS words or more."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return rows.filter(F.col("line").rlike(_LONG_ENOUGH)).select("id", "th", "site", "pos", _key(F.trim("line", F.lit(SPACES))).alias("key"))


def boilerplate_hits(rows: DataFrame, min_sites: int) -> DataFrame:
    """The occurrences (key, id, th, pos) of lines on min_sites sites or more. Rows without a site count for none."""
    spread = rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_REGISTERS)).alias("est"))
    maybe = materialize(spread.filter(F.col("est") >= min_sites * (1 - NEAR) - 1).select(F.col("key").alias("k"), (F.col("est") > min_sites * (1 + NEAR) + 1).alias("sure")), "line-spread")
    hits = materialize(rows.join(maybe, F.col("key") == F.col("k")).drop("k"), "line-hits")
    exact = hits.filter("NOT sure").groupBy("key", "site").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count("site").alias("sites"))
    exact = materialize(exact.filter(F.col("sites") >= min_sites).select(F.col("key").alias("k")), "line-exact")
    near = hits.filter("NOT sure").join(exact, F.col("key") == F.col("k"), "left_semi")
    return hits.filter("sure").unionByName(near).select("key", "id", "th", "pos")


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """df with boilerplate lines removed from text_col, and n_lines and n_removed (long; such columns are replaced).

    Lines end at newlines and compare without surrounding ASCII white space; blank and short lines stay. The first occurrence
    is that of the smallest id, null before all, then by text hash and position; rows that repeat an id and a text share
    its fate. A null text stays null and has 0 lines, an empty one has 1. Rows never go, texts may become empty. Other
    columns stay as they are. Only rows that may have such a line are moved to their list of positions: a set of MARKS hash
    values at most, which is broadcast, tells the others apart.
    """
    hits = materialize(boilerplate_hits(line_rows(df, id_col=id_col, text_col=text_col, site_col=site_col), min_sites), "line-boilerplate")
    first = materialize(hits.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("id", "th", "pos")).alias("first")), "line-first")
    # one row per boilerplate line, of known size: below Spark's threshold the occurrences stay where they are, above it a hot
    # line's are split by its skew handling
    gone = hits.join(first, F.col("key") == F.col("k")).filter(~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("gone id"), F.col("th").alias("gone th")).agg(F.collect_set("pos").alias("gone pos"))
    gone = materialize(gone, "line-removals")
    text = F.col(text_col)
    marks = gone.select(F.pmod(F.xxhash64("gone id", "gone th"), F.lit(MARKS)).alias("gone mark")).distinct()
    marks = F.broadcast(materialize(marks, "line-marks"))
    mine = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text_col)), F.lit(MARKS)) == F.col("gone mark")
    same = F.col(id_col).eqNullSafe(F.col("gone id")) & (F.xxhash64(text_col) == F.col("gone th"))
    rows = df.join(marks, mine, "left_semi").join(gone, same, "left")
    rest = df.join(marks, mine, "left_anti").withColumns({f.name: F.lit(None).cast(f.dataType) for f in gone.schema})
    rows = rows.unionByName(rest)
    lines = F.split(text, "\n")
    kept = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone pos"))), lambda i: F.get(lines, i))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return rows.withColumns(
        {"n_lines": n, "n_removed": F.when(F.col("gone pos").isNull(), 0).otherwise(F.size("gone pos")).cast("long"), text_col: F.when(F.col("gone pos").isNull(), text).otherwise(F.array_join(kept, "\n"))}
    ).drop("gone id", "gone th", "gone pos")
