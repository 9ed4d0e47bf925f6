"""Choice among recognition passes (page_id, ds, conf, pitch, wide, lineh, n_lines) at several resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels in their order and the bounds of the rules.
LEVELS = (3, 2, 1)
PITCH, CONF, UNREADABLE, MIN_LINE_H = 0.85, 0.90, 0.60, 8.0
WIDE, WIDE_IMPROVE, MARGIN, INFLATE = 0.08, 0.04, 0.02, 1.4


def starved(pitch: Column, wide: Column, lineh: Column, conf: Column | None = None) -> Column:
    """Whether a layout is too coarse; with conf, whether a recognition is."""
    bad = (lineh < MIN_LINE_H) | (pitch < PITCH) | (wide > WIDE)
    return bad if conf is None else bad | (conf < CONF)


def recognised(passes: DataFrame) -> DataFrame:
    """The passes that the level loop recognises, in order: from the coarsest down, starved layouts are skipped unless they are
    the last level; the loop ends with the first confidence of CONF. As one row a page: an array by order."""
    item = F.struct((-F.col("ds")).alias("o"), "ds", "conf", "pitch", "wide", "lineh", "n_lines", starved(F.col("pitch"), F.col("wide"), F.col("lineh")).alias("skip"))
    pages = passes.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    tried = pages.withColumn("seen", F.filter("all", lambda v: ~v["skip"] | (v["ds"] == LEVELS[-1])))
    stop = F.aggregate(F.transform("seen", lambda v, i: F.when(v["conf"] >= CONF, i)), F.lit(None).cast("int"), lambda s, i: F.coalesce(s, i))
    return tried.withColumn("seen", F.slice("seen", 1, F.coalesce(stop + 1, F.size("seen")))).withColumn("first_lines", F.get("all", F.lit(0))["n_lines"])


def _best(seen: Column) -> Column:
    """The first pass of the largest confidence."""
    return F.aggregate(F.slice(seen, 2, F.greatest(F.lit(0), F.size(seen) - 1)), F.get(seen, F.lit(0)), lambda a, v: F.when(v["conf"] > a["conf"], v).otherwise(a))


def choose(passes: DataFrame) -> DataFrame:
    """(page_id, ds, conf, n_seen, accepted): the first recognised pass, or the most confident one if it gains over MARGIN and either
    the first was starved or unreadable, or the lines didn't inflate over the coarsest layout's."""
    rows = recognised(passes).withColumn("base", F.get("seen", F.lit(0))).withColumn("cand", _best(F.col("seen")))
    poor = (F.col("base.pitch") < PITCH) | (F.col("base.conf") < UNREADABLE) | (F.col("base.lineh") < MIN_LINE_H)
    ok = (F.col("cand.ds") != F.col("base.ds")) & (F.col("cand.conf") > F.col("base.conf") + MARGIN) & (poor | (F.col("cand.n_lines") <= INFLATE * F.greatest(F.lit(1), F.col("first_lines"))))
    pick = lambda c: F.when(ok, F.col(f"cand.{c}")).otherwise(F.col(f"base.{c}"))
    return rows.select("page_id", pick("ds").alias("ds"), pick("conf").alias("conf"), F.size("seen").alias("n_seen"), ok.alias("accepted"))


def choose_wide(passes: DataFrame) -> DataFrame:
    """(page_id, ds, conf): as choose over all passes in order, but first, where the base has wide lines, the pass with the fewest
    (most confident on ties) if it has clearly fewer and is hardly less confident."""
    item = F.struct((-F.col("ds")).alias("o"), "ds", "conf", "pitch", "wide", "lineh", "n_lines")
    pages = passes.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("seen"))
    rows = pages.withColumn("base", F.get("seen", F.lit(0))).withColumn("cand", _best(F.col("seen")))
    narrow = F.aggregate(F.slice("seen", 2, F.greatest(F.lit(0), F.size("seen") - 1)), F.get("seen", F.lit(0)), lambda a, v: F.when((v["wide"] < a["wide"]) | ((v["wide"] == a["wide"]) & (v["conf"] > a["conf"])), v).otherwise(a))
    rows = rows.withColumn("narrow", narrow)
    first = (F.col("base.wide") > WIDE) & (F.col("narrow.ds") != F.col("base.ds")) & (F.col("narrow.wide") < F.col("base.wide") - WIDE_IMPROVE) & (F.col("narrow.conf") >= F.col("base.conf") - 0.01)
    poor = (F.col("base.pitch") < PITCH) | (F.col("base.conf") < UNREADABLE) | (F.col("base.lineh") < MIN_LINE_H)
    ok = (F.col("cand.ds") != F.col("base.ds")) & (F.col("cand.conf") > F.col("base.conf") + MARGIN) & (poor | (F.col("cand.n_lines") <= INFLATE * F.greatest(F.lit(1), F.col("base.n_lines"))))
    pick = lambda c: F.when(first, F.col(f"narrow.{c}")).when(ok, F.col(f"cand.{c}")).otherwise(F.col(f"base.{c}"))
    return rows.select("page_id", pick("ds").alias("ds"), pick("conf").alias("conf"))
