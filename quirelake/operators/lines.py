"""Statistics of detected lines (page_id, seq, region_idx, x0, x1, cy, asc, desc), fragments, regions and reading order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the layout rules.
MIN_REGION_LINES, MIN_REGION_WIDTH, MIN_WIDE_LINES = 5, 400, 20
NO_LINES_HEIGHT, NO_REGION_PITCH = 99.0, 1.0
CALIBRATE = 0.70
GAP, SEP_GATE, PARAGRAPH = 1.5, 0.2, 0.25


def _height():
    return F.col("asc") + F.col("desc")


def line_height_median(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Median of ascender plus descender by page; NO_LINES_HEIGHT for pages without lines."""
    m = lines.groupBy("page_id").agg(F.median(_height()).alias("m"))
    return pages.select("page_id").join(m, "page_id", "left").select("page_id", F.coalesce("m", F.lit(NO_LINES_HEIGHT)).alias("line_height"))


def pitch_ratio(pages: DataFrame, lines: DataFrame, img_scale: float = 1.0) -> DataFrame:
    """The least ratio of median pitch to median height over a page's regions that are large enough; else NO_REGION_PITCH."""
    w = Window.partitionBy("page_id", "region_idx").orderBy("cy", "seq")
    steps = lines.withColumn("step", F.col("cy") - F.lag("cy").over(w))
    by = steps.groupBy("page_id", "region_idx").agg(F.count("*").alias("n"), ((F.max("x1") - F.min("x0")) * img_scale).alias("extent"), F.median("step").alias("pitch"), F.median(_height()).alias("h"))
    ratio = F.col("pitch") / F.greatest(F.lit(1.0), F.col("h"))
    least = by.where((F.col("n") >= MIN_REGION_LINES) & (F.col("extent") >= MIN_REGION_WIDTH)).groupBy("page_id").agg(F.min(ratio).alias("r"))
    return pages.select("page_id").join(least, "page_id", "left").select("page_id", F.coalesce("r", F.lit(NO_REGION_PITCH)).alias("pitch_ratio"))


def wide_fraction(pages: DataFrame, lines: DataFrame, page_w: float, img_scale: float = 1.0) -> DataFrame:
    """Share of lines wider than 1.8 medians and 0.45 of the page; 0 for fewer than MIN_WIDE_LINES lines."""
    rows = lines.select("page_id", ((F.col("x1") - F.col("x0")) * img_scale).alias("w"))
    med = rows.groupBy(F.col("page_id").alias("m_page")).agg(F.median("w").alias("med"), F.count("*").alias("n"))
    wide = rows.join(med, F.col("page_id") == F.col("m_page")).groupBy("page_id").agg(F.first("n").alias("n"), F.avg(((F.col("w") > 1.8 * F.col("med")) & (F.col("w") > 0.45 * page_w)).cast("double")).alias("f"))
    return pages.select("page_id").join(wide, "page_id", "left").select("page_id", F.when(F.col("n") >= MIN_WIDE_LINES, F.col("f")).otherwise(0.0).alias("wide_frac"))


def calibrate_pitch(lines: DataFrame) -> DataFrame:
    """Scales asc and desc of lines whose ascender is under 0.7 of their region's median pitch (three lines at least)."""
    w = Window.partitionBy("page_id", "region_idx").orderBy("cy", "seq")
    steps = lines.withColumn("step", F.col("cy") - F.lag("cy").over(w))
    by = steps.groupBy(F.col("page_id").alias("r_page"), F.col("region_idx").alias("r_idx")).agg(F.count("*").alias("n"), F.median("step").alias("pitch"))
    rows = lines.join(by, (F.col("page_id") == F.col("r_page")) & (F.col("region_idx") == F.col("r_idx"))).drop("r_page", "r_idx")
    low = (F.col("n") >= 3) & (F.col("asc") > 0) & (F.col("asc") < CALIBRATE * F.col("pitch"))
    scale = F.when(low, CALIBRATE * F.col("pitch") / F.col("asc")).otherwise(1.0)
    return rows.withColumn("scale", scale).withColumn("asc", F.col("asc") * F.col("scale")).withColumn("desc", F.col("desc") * F.col("scale")).drop("n", "pitch")


def by_page(rows: DataFrame, names: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, marks: DataFrame | None = None) -> DataFrame:
    """fn of each page's columns, as arrays in no set order, to columns of its results; schema names these, without page_id.

    Pages are gathered by one shuffle and come in Arrow batches, many pages in each, so a small page costs its lines only. Marks
    (page_id and further columns) come to the same call with all their rows. They are gathered, not joined: a join may broadcast them
    whole, as rows made by explode count for nothing in Spark's estimates.
    """
    lists = {"rows": names}
    given = rows.select("page_id", F.struct(*names).alias("rows"))
    if marks is not None:
        lists["marks"] = [c for c in marks.columns if c != "page_id"]
        given = given.unionByName(marks.select("page_id", F.struct(*lists["marks"]).alias("marks")), allowMissingColumns=True)
    pages = given.groupBy("page_id").agg(*(F.collect_list(c).alias(c) for c in lists))
    fields = [f.split() for f in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            cols: list[dict] = [{} for _ in range(batch.num_rows)]
            for name, held in lists.items():
                flat, ends = batch.column(name).flatten(), batch.column(name).offsets.to_numpy()
                ends = ends - ends[0]
                for k, n in enumerate(held):
                    values = flat.field(k).to_numpy(zero_copy_only=False)
                    for page, a, b in zip(cols, ends, ends[1:]):
                        page[n] = values[a:b]
            made = [fn(page) for page in cols]
            sizes = [len(m[fields[0][0]]) for m in made]
            page = batch.column("page_id").take(pa.array(np.repeat(np.arange(len(made)), sizes)))
            out = [pa.array(np.concatenate([m[n] for m in made]) if made else [], types[t]) for n, t in fields]
            yield pa.RecordBatch.from_arrays([page, *out], ["page_id", *(n for n, _ in fields)])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, {schema}")


LINE = ["seq", "x0", "x1", "cy", "asc", "desc"]
PAIRS_AT_ONCE = 1 << 18


def _joining(p: dict[str, np.ndarray], skip_later: bool = True) -> dict[str, np.ndarray]:
    """The pairs of a page's lines that join, and the box of the gap between them."""
    order = np.lexsort((p["seq"], p["x0"], p["cy"]))
    seq, x0, x1, cy = (p[c][order] for c in ("seq", "x0", "x1", "cy"))
    h = np.maximum(1.0, p["asc"] + p["desc"])[order]
    # what joins is within the tallest height, so partners behind that aren't looked at
    n = np.searchsorted(cy, cy + h.max(initial=0.0), side="right") - np.arange(1, len(cy) + 1)
    out: list[tuple] = []
    # lines come in blocks, so that the pairs at hand are bounded on crowded pages too
    for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_AT_ONCE)) + 1):
        first = np.cumsum(n[rows]) - n[rows]
        i = np.repeat(rows, n[rows])
        b = i + 1 + np.arange(len(i)) - np.repeat(first, n[rows])
        d, mean = cy[b] - cy[i], 0.5 * (h[i] + h[b])
        left, right = np.where(x0[i] <= x0[b], x1[i], x1[b]), np.maximum(x0[i], x0[b])
        gap = right - left
        fits = (d <= 0.6 * mean) & (gap >= -0.5 * mean) & (gap <= GAP * mean)
        if skip_later:
            over = np.append(0, np.cumsum(d > np.maximum(h[i], h[b])))
            fits &= over[1:] == np.repeat(over[first], n[rows])
        i, b, mean, left, right = (c[fits] for c in (i, b, mean, left, right))
        mid, half = np.floor(0.5 * (cy[i] + cy[b])), np.floor(0.5 * mean)
        out.append((seq[i], seq[b], np.floor(np.minimum(left, right)), np.floor(np.maximum(left, right) + 1), mid - half, mid + half + 1))
    return {n: np.concatenate([o[k] for o in out]) for k, n in enumerate(("a_seq", "b_seq", "gx0", "gx1", "gy0", "gy1"))}


def _barred(found: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the gap's box of each pair that _joining found holds one of the page's cells (y, x)."""
    order = np.argsort(y, kind="stable")
    y, x = y[order], x[order]
    a, b = np.searchsorted(y, found["gy0"]), np.searchsorted(y, found["gy1"])
    return np.array([((x[i:j] >= x0) & (x[i:j] < x1)).any() for i, j, x0, x1 in zip(a, b, found["gx0"], found["gx1"])], bool)


def _named(seqs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of seqs the smallest one that the pairs (a, b) lead to."""
    parent = {int(s): int(s) for s in seqs}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(a, b):
        u, v = sorted((root(int(u)), root(int(v))))
        parent[v] = u
    return np.array([root(int(s)) for s in seqs])


def merge_candidates(lines: DataFrame, seps: DataFrame | None = None, skip_later: bool = True) -> DataFrame:
    """(page_id, a_seq, b_seq) of fragments that belong to one line.

    Lines are taken by (cy, x0). A pair joins if its cy differ by 0.6 mean heights at most and its gap lies in [-0.5, 1.5] mean
    heights, and no separator in the gap's box is over the gate (seps: page_id, y, x, sep). The scan for a line's partners ends with
    the first line below it by more than the taller of both: with skip_later lines behind that one aren't joined, whatever
    their heights.
    """

    def free(p):
        found = _joining(p, skip_later)
        ok = ~_barred(found, p["y"], p["x"])
        return {n: found[n][ok] for n in ("a_seq", "b_seq")}

    schema = "a_seq int, b_seq int"
    if seps is None:
        return by_page(lines, LINE, lambda p: _joining(p, skip_later), schema)
    return by_page(lines, LINE, free, schema, seps.where(F.col("sep") > SEP_GATE).select("page_id", "y", "x"))


def region_candidates(lines: DataFrame) -> DataFrame:
    """(page_id, a_seq, b_seq) of lines at most three median heights apart that overlap by over 5; no separators here."""
    med = lines.groupBy(F.col("page_id").alias("m_page")).agg((3.0 * F.median(F.greatest(F.lit(1.0), _height()))).alias("reach"))
    rows = lines.join(med, F.col("page_id") == F.col("m_page")).withColumn("bin", F.floor(F.col("cy") / F.col("reach")))
    cols = ["seq", "x0", "x1", "cy"]
    a = rows.select("page_id", "reach", "bin", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = rows.select("page_id", F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), *(F.col(c).alias(f"b_{c}") for c in cols))
    ordered = (F.col("a_cy") < F.col("b_cy")) | ((F.col("a_cy") == F.col("b_cy")) & (F.col("a_seq") < F.col("b_seq")))
    near = (F.col("b_cy") - F.col("a_cy") <= F.col("reach")) & (F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0") > 5)
    return a.join(b, ["page_id", "bin"]).where(ordered & near).select("page_id", "a_seq", "b_seq")


def closure(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, seq, group_seq): components of each page's pairs, named by their smallest seq.

    A page has a few hundred lines, and pages never meet, so each is closed by one call; nothing crosses pages.
    """
    nodes = lines.select("page_id", "seq", F.lit(None).cast("int").alias("other"))
    both = nodes.unionByName(pairs.select("page_id", F.col("a_seq").alias("seq"), F.col("b_seq").alias("other")))

    def close(p):
        pair = ~np.isnan(p["other"].astype(float))
        seqs = np.unique(p["seq"][~pair])
        return {"seq": seqs, "group_seq": _named(seqs, p["seq"][pair], p["other"][pair])}

    return by_page(both, ["seq", "other"], close, "seq int, group_seq int")


def merge_lines(lines: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Merged lines: (page_id, group_seq, n, x0, x1, cy, asc, desc), heights averaged, cy the mean of the members'. Without pairs
    those of merge_candidates without separators, found and closed in one call by page."""

    def name(p):
        found = _joining(p)
        return {c: p[c] for c in LINE} | {"group_seq": _named(p["seq"], found["a_seq"], found["b_seq"])}

    if pairs is None:
        joined = by_page(lines, LINE, name, "seq int, x0 double, x1 double, cy double, asc double, desc double, group_seq int")
    else:
        joined = lines.join(closure(lines, pairs), ["page_id", "seq"])
    return joined.groupBy("page_id", "group_seq").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg("cy").alias("cy"), F.avg("asc").alias("asc"), F.avg("desc").alias("desc"))


def order_boxes(boxes: list[tuple[float, float, float, float]]) -> list[tuple[int, int, int]]:
    """(index, band, column) in reading order.

    Boxes (x0, y0, x1, y1) by top go to the first band whose extent covers over half of the smaller height, which then grows;
    in a band, a new column starts where the next centre is over half an upper median width away; columns are read downwards.
    """
    bands: list[list[int]] = []
    extent: list[list[float]] = []
    for i in sorted(range(len(boxes)), key=lambda i: boxes[i][1]):
        _, y0, _, y1 = boxes[i]
        for members, e in zip(bands, extent):
            if min(y1, e[1]) - max(y0, e[0]) > 0.5 * max(1, min(y1 - y0, e[1] - e[0])):
                members.append(i)
                e[0], e[1] = min(e[0], y0), max(e[1], y1)
                break
        else:
            bands.append([i])
            extent.append([y0, y1])
    out = []
    for number, members in enumerate(bands):
        reach = 0.5 * max(1.0, sorted(boxes[i][2] - boxes[i][0] for i in members)[len(members) // 2])
        centre = {i: (boxes[i][0] + boxes[i][2]) / 2 for i in members}
        across = sorted(members, key=centre.__getitem__)
        jumps = np.cumsum([0] + [centre[b] - centre[a] > reach for a, b in zip(across, across[1:])])
        column = dict(zip(across, map(int, jumps)))
        out += [(i, number, column[i]) for i in sorted(members, key=lambda i: (column[i], boxes[i][1]))]
    return out


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (page_id, seq, x0, y0, x1, y1) -> (page_id, seq, band, col, read_pos). A fold over a page: each band depends on
    those before, so no join expresses it; pages are small and independent. Ties go by seq."""

    def order(p):
        at = np.argsort(p["seq"], kind="stable")
        made = np.array(order_boxes(list(zip(*(p[c][at].tolist() for c in ("x0", "y0", "x1", "y1"))))))
        return {"seq": p["seq"][at][made[:, 0]], "band": made[:, 1], "col": made[:, 2], "read_pos": np.arange(len(made))}

    return by_page(boxes, ["seq", "x0", "y0", "x1", "y1"], order, "seq int, band int, col int, read_pos int")


def column_islands(boxes: DataFrame, band: str = "band") -> DataFrame:
    """(page_id, band, seq, col): gaps and islands over centres, with the upper median width as the measure."""
    upper = F.element_at(F.array_sort(F.collect_list(F.col("x1") - F.col("x0"))), (F.floor(F.count("*") / 2) + 1).cast("int"))
    reach = boxes.groupBy("page_id", band).agg((0.5 * F.greatest(F.lit(1.0), upper)).alias("reach"))
    w = Window.partitionBy("page_id", band).orderBy("centre", "seq")
    rows = boxes.join(reach, ["page_id", band]).withColumn("centre", (F.col("x0") + F.col("x1")) / 2)
    jump = F.coalesce((F.col("centre") - F.lag("centre").over(w) > F.col("reach")).cast("int"), F.lit(0))
    return rows.withColumn("jump", jump).select("page_id", band, "seq", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("col"))


def split_columns(lines: DataFrame, gutters: DataFrame, page_w: float, min_side: int = 3, most_bridge: float = 0.25) -> DataFrame:
    """(page_id, seq, side) with side left, right, bridge or whole; gutters (page_id, gutter) are places of strong separators.

    A page is split if it has twice min_side lines, is 0.55 of the page wide, and after the split holds min_side lines on either side and at
    most a share of most_bridge across.
    """
    rows = lines.join(gutters, "page_id", "left")
    by = rows.groupBy(F.col("page_id").alias("b_page")).agg(F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("width"))
    rows = rows.join(by, F.col("page_id") == F.col("b_page"))
    margin = 0.02 * F.col("width")
    side = F.when(F.col("x1") <= F.col("gutter") + margin, "left").when(F.col("x0") >= F.col("gutter") - margin, "right").otherwise("bridge")
    rows = rows.withColumn("side", side)
    tally = rows.groupBy(F.col("page_id").alias("t_page")).agg(*(F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in ("left", "right", "bridge")))
    rows = rows.join(tally, F.col("page_id") == F.col("t_page"))
    ok = F.col("gutter").isNotNull() & (F.col("n") >= 2 * min_side) & (F.col("width") >= 0.55 * page_w) & (F.col("n_left") >= min_side) & (F.col("n_right") >= min_side) & (F.col("n_bridge") <= most_bridge * F.col("n"))
    return rows.select("page_id", "seq", F.when(ok, F.col("side")).otherwise("whole").alias("side"))
