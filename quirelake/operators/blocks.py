"""Blocks of lines: blank lines, texts of pages, boxes, and what a line's neighbours are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import blank, clamp


def kept_lines(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank."""
    return lines.where(~blank(F.col("text")))


def page_text(lines: DataFrame) -> DataFrame:
    """lines (page_id, region_idx, line_idx, text) -> (page_id, page_text): one line each, an empty line after each block, no
    white space at the end but one line break. A page without text is one line break."""
    block = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"])
    blocks = kept_lines(lines).groupBy("page_id", "region_idx").agg(F.array_join(block, "\n").alias("block"))
    pages = blocks.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region_idx", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    every = lines.select("page_id").distinct().join(pages, "page_id", "left")
    return every.select("page_id", F.concat(F.regexp_replace(F.coalesce("body", F.lit("")), r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+$", ""), F.lit("\n")).alias("page_text"))


def block_boxes(lines: DataFrame) -> DataFrame:
    """(page_id, region_idx, x, y, w, h, n_lines) of blocks; w and h are 1 at least."""
    x, y = F.min("hpos"), F.min("vpos")
    return kept_lines(lines).groupBy("page_id", "region_idx").agg(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.max(F.col("hpos") + F.col("width")) - x).alias("w"), F.greatest(F.lit(1), F.max(F.col("vpos") + F.col("height")) - y).alias("h"), F.count("*").alias("n_lines"))


def _in_block() -> Window:
    return Window.partitionBy("page_id", "region_idx").orderBy("line_idx")


def median_height(lines: DataFrame) -> DataFrame:
    return lines.groupBy("page_id").agg(F.median(F.greatest(F.lit(1), F.col("height"))).alias("medh"))


def geometry_features(lines: DataFrame) -> DataFrame:
    """Eight numbers of a line's place on its page and in its block."""
    kept = kept_lines(lines)
    rows = kept.join(median_height(kept), "page_id").withColumn("li", F.row_number().over(_in_block()) - 1).withColumn("nl", F.count("*").over(Window.partitionBy("page_id", "region_idx")))
    cy, cx = F.col("vpos") + F.col("height") / 2, F.col("hpos") + F.col("width") / 2
    flag = lambda c: c.cast("int").cast("double")
    return rows.select(
        "page_id", "line_idx", (cy / F.col("page_h")).alias("g_cy"), (cx / F.col("page_w")).alias("g_cx"), (F.col("width") / F.col("page_w")).alias("g_w"), (F.col("height") / F.col("medh") / 4).alias("g_h"),
        flag(cy < 0.12 * F.col("page_h")).alias("g_top"), flag(cy > 0.88 * F.col("page_h")).alias("g_bottom"), (F.col("li") / F.greatest(F.lit(1), F.col("nl"))).alias("g_pos"), flag(F.col("nl") == 1).alias("g_single"),
    )


def context_features(lines: DataFrame) -> DataFrame:
    """Seven numbers of a line against its neighbours in the block; without one, its own sizes and a gap of 2."""
    kept, w = kept_lines(lines), _in_block()
    rows = kept.join(median_height(kept), "page_id")
    near = {f"{side}_{c}": f(c).over(w) for side, f in (("p", F.lag), ("n", F.lead)) for c in ("height", "width", "vpos")}
    rows = rows.withColumns(near)
    h, y = F.col("height"), F.col("vpos")
    ratio = lambda a, c, most: clamp(a / F.greatest(F.lit(1), F.coalesce(F.col(c), a)), 0.0, float(most)) / most
    ahead = F.coalesce((y - (F.col("p_vpos") + F.col("p_height"))) / F.col("medh"), F.lit(2.0))
    behind = F.coalesce((F.col("n_vpos") - (y + h)) / F.col("medh"), F.lit(2.0))
    flag = lambda c: c.cast("int").cast("double")
    return rows.select(
        "page_id", "line_idx", ratio(h, "p_height", 4).alias("c_prev_h"), ratio(h, "n_height", 4).alias("c_next_h"), (clamp(ahead, 0.0, 5.0) / 5).alias("c_gap_above"), (clamp(behind, 0.0, 5.0) / 5).alias("c_gap_below"),
        ratio(F.col("width"), "p_width", 3).alias("c_prev_w"), flag(F.col("p_height").isNull()).alias("c_first"), flag(F.col("n_height").isNull()).alias("c_last"),
    )


#: Roles and the probability that each but body needs.
ROLES = ("body", "heading", "header", "footer", "page_number")
NEEDED = {"heading": 0.6, "header": 0.6, "footer": 0.6, "page_number": 0.5}


def gate_roles(scored: DataFrame, scores: str = "scores", needed: dict[str, float] = NEEDED) -> DataFrame:
    """Adds best (first best role), p, and role: body where p is under what the best one needs."""
    from quirelake.functions import argmax, top_probability

    best = F.element_at(F.array(*map(F.lit, ROLES)), argmax(F.col(scores)) + 1)
    bound = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in needed.items() for x in kv)), F.col("best")), F.lit(0.0))
    return scored.withColumn("best", best).withColumn("p", top_probability(F.col(scores))).withColumn("role", F.when(F.col("p") < bound, "body").otherwise(F.col("best")))
