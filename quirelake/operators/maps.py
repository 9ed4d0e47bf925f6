"""Layout maps, one row a page: (page_id, h, w) and each channel an array by rows. What a map shows is found in one call a page."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crops, lines

#: Fixed values of the line rules.
THRESHOLD, ENDPOINT_WEIGHT, REACH = 0.25, 1.0, 2
MIN_PIXELS, MIN_WIDTH, MAX_POINTS, EXTEND = 5, 5, 10, 2
DARK, GUTTER_RATIO = 128, 0.25
MIN_SIDE, MOST_BRIDGE, SPLIT_WIDTH = 3, 0.25, 0.55
#: Channels of a layout network: heights above and below a baseline, baseline, end point and separator probabilities.
CHANNELS = ("asc_h", "desc_h", "base", "endp", "sep")
MAP = "page_id long, h int, w int, " + ", ".join(f"{c} array<double>" for c in CHANNELS)


class Line(NamedTuple):
    seq: int
    points: np.ndarray  # (n, 2) x and y, by x
    asc: float
    desc: float

    @property
    def cy(self) -> float:
        return float(self.points[:, 1].mean())

    @property
    def extent(self) -> tuple[float, float]:
        return float(self.points[:, 0].min()), float(self.points[:, 0].max())


def column_max(a: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The largest value within reach rows of the same column; the window is clipped at the border."""
    padded = np.pad(a, ((reach, reach), (0, 0)), constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=0).max(axis=-1)


def mean3x3(a: np.ndarray) -> np.ndarray:
    """The 3 x 3 mean; border cells count twice, as the mirrored neighbour is the cell itself."""
    p = np.pad(a, 1, mode="symmetric")
    across = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return (across[:-2] + across[1:-1] + across[2:]) / 9


def peaks(base: np.ndarray, endp: np.ndarray) -> np.ndarray:
    """Cells whose smoothed baseline probability is a vertical peak and exceeds the endpoint probability by over the threshold."""
    smooth = mean3x3(base)
    return np.where(smooth >= column_max(smooth) - 1e-6, smooth, 0.0) - ENDPOINT_WEIGHT * endp > THRESHOLD


def label_cells(ys: np.ndarray, xs: np.ndarray, reach: int = 3) -> np.ndarray:
    """Components of cells within a Chebyshev distance of reach, numbered from 0 by their first cell in (y, x) order."""
    if not len(ys):
        return np.zeros(0, dtype=int)
    order = np.lexsort((xs, ys))
    y, x = ys[order] - ys.min() + reach, xs[order] - xs.min() + reach
    grid = np.full((y.max() + reach + 1, x.max() + reach + 1), -1)
    grid[y, x] = np.arange(len(y))
    ends = []
    for dy in range(reach + 1):
        for dx in range(-reach if dy else 1, reach + 1):
            other = grid[y + dy, x + dx]
            near = np.flatnonzero(other >= 0)
            ends.append(np.stack([near, other[near]]))
    a, b = np.concatenate(ends, axis=1)
    label = np.arange(len(y))
    while True:  # the least label spreads over links, and each round follows it as far as it leads
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(y), dtype=int)
    out[order] = np.unique(label, return_inverse=True)[1]
    return out


def baseline(xs: np.ndarray, ys: np.ndarray) -> np.ndarray | None:
    """The median y of each column, a tenth of them, 2 at least and MAX_POINTS at most, evenly taken; None for a single column."""
    order = np.lexsort((ys, xs))
    y = ys[order]
    x, first, n = np.unique(xs[order], return_index=True, return_counts=True)
    if len(x) < 2:
        return None
    chosen = np.linspace(0, len(x) - 1, max(2, min(MAX_POINTS, len(x) // 10))).astype(int)
    median = (y[first + (n - 1) // 2] + y[first + n // 2]) / 2
    return np.stack([x[chosen], np.rint(median[chosen])], axis=1).astype(float)


def map_lines(m: dict[str, np.ndarray]) -> list[tuple[Line, int, tuple[int, int]]]:
    """The lines of a map, with their pixels and first cell (y, x): components of over MIN_PIXELS cells and MIN_WIDTH columns, their
    ends drawn out by EXTEND; heights are medians over the cells of the largest value near, floored at 0."""
    ys, xs = np.nonzero(peaks(m["base"], m["endp"]))
    labels, tall = label_cells(ys, xs), {c: np.maximum(0, column_max(m[c])[ys, xs]) for c in ("asc_h", "desc_h")}
    order = np.argsort(labels, kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if len(order) else ():
        points = baseline(xs[at], ys[at]) if len(at) > MIN_PIXELS else None
        if points is not None and points[-1, 0] - points[0, 0] >= MIN_WIDTH:
            points[0, 0], points[-1, 0] = max(0, points[0, 0] - EXTEND), min(m["base"].shape[1] - 1, points[-1, 0] + EXTEND)
            out.append((Line(int(labels[at[0]]), points, *(float(np.median(tall[c][at])) for c in tall)), len(at), (int(ys[at[0]]), int(xs[at[0]]))))
    return out


def _table(found: list[Line]) -> dict[str, np.ndarray]:
    ends = [x.extent for x in found]
    cols = {"seq": [x.seq for x in found], "x0": [e[0] for e in ends], "x1": [e[1] for e in ends], "cy": [x.cy for x in found], "asc": [x.asc for x in found], "desc": [x.desc for x in found]}
    return {k: np.array(v) for k, v in cols.items()}


def joined(found: list[Line], sep: np.ndarray) -> list[Line]:
    """Fragments of one line as one, under the name of the first: the baseline of all their points, and mean heights. No separator
    may stand in the gap."""
    if len(found) < 2:
        return found
    table = _table(found)
    pairs = lines._joining(table)
    free = [k for k, box in enumerate(zip(*(pairs[c] for c in ("gx0", "gx1", "gy0", "gy1")))) if not _barred(sep, *map(int, box))]
    names = lines._named(table["seq"], pairs["a_seq"][free], pairs["b_seq"][free])
    out = []
    for name in np.unique(names):
        parts = [x for x, n in zip(found, names) if n == name]
        points = baseline(*np.concatenate([x.points for x in parts]).T) if len(parts) > 1 else parts[0].points
        if points is None:
            points = max(parts, key=lambda x: x.extent[1] - x.extent[0]).points
        out.append(Line(int(name), points, float(np.mean([x.asc for x in parts])), float(np.mean([x.desc for x in parts]))))
    return out


def _barred(sep: np.ndarray, x0: int, x1: int, y0: int, y1: int) -> bool:
    return bool((sep[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] > lines.SEP_GATE).any())


def regions(found: list[Line], sep: np.ndarray) -> list[list[Line]]:
    """Lines at most three median heights apart that overlap by over 5, and that no separator parts, are one region."""
    if not found:
        return []
    t = _table(sorted(found, key=lambda x: x.cy))
    by_seq = {x.seq: x for x in found}
    reach = 3.0 * float(np.median(np.maximum(1.0, t["asc"] + t["desc"])))
    a, b = [], []
    for i, end in enumerate(np.searchsorted(t["cy"], t["cy"] + reach, side="right")):
        over = np.minimum(t["x1"][i], t["x1"][i + 1 : end]) - np.maximum(t["x0"][i], t["x0"][i + 1 : end])
        for j in np.flatnonzero(over > 5) + i + 1:
            upper, lower = by_seq[int(t["seq"][i])], by_seq[int(t["seq"][j])]
            if crops.separator_penalty(upper.points.tolist(), lower.points.tolist(), upper.desc, lower.asc, sep) < lines.PARAGRAPH:
                a.append(upper.seq)
                b.append(lower.seq)
    names = lines._named(t["seq"], np.array(a), np.array(b))
    return [[by_seq[int(s)] for s in t["seq"][names == n]] for n in np.unique(names)]


def gutter(sep: np.ndarray) -> tuple[int, float, float, bool]:
    """(column, its sum, median sum, strong): the column of the largest sum in the middle half, the first on ties; strong if the
    sum is 0.12 of the height and four medians."""
    sums = np.round(sep.sum(axis=0), 9)
    lo, hi = int(0.25 * len(sums)), int(0.75 * len(sums))
    if hi - lo < 2:
        return 0, 0.0, 0.0, False
    at = lo + int(sums[lo:hi].argmax())
    peak, median = float(sums[at]), float(np.median(sums)) + 1e-6
    return at, peak, median, peak >= 0.12 * len(sep) and peak >= 4.0 * median


def columns(region: list[Line], sep: np.ndarray) -> list[list[Line]]:
    """The parts left and right of a strong gutter and those across, where a wide region holds two columns; else the region."""
    t = _table(region)
    ys = np.concatenate([x.points[:, 1] for x in region])
    left, right, width = t["x0"].min(), t["x1"].max(), t["x1"].max() - t["x0"].min()
    if len(region) < 2 * MIN_SIDE or width < max(2, SPLIT_WIDTH * sep.shape[1]):
        return [region]
    inside = sep[max(0, int(ys.min())) : int(ys.max()) + 1, max(0, int(left)) : int(right) + 1]
    if inside.shape[0] < 2 or inside.shape[1] < 4:
        return [region]
    at, _, _, strong = gutter(inside)
    place, margin = max(0, int(left)) + at, 0.02 * width
    side = np.where(t["x1"] <= place + margin, 0, np.where(t["x0"] >= place - margin, 1, 2))
    n = np.bincount(side, minlength=3)
    if not strong or n[:2].min() < MIN_SIDE or n[2] > MOST_BRIDGE * len(region):
        return [region]
    return [[x for x, s in zip(region, side) if s == k] for k in range(3) if n[k]]


def outline(line: Line) -> np.ndarray:
    """Points asc above and desc below the baseline, along each point's normal; the last segment's serves its end too."""
    step = np.diff(line.points, axis=0)
    long = np.hypot(step[:, 0], step[:, 1])
    flat = long == 0
    along = np.where(flat[:, None], [1.0, 0.0], step / np.where(flat, 1, long)[:, None])
    normal = np.stack([-along[:, 1], along[:, 0]], axis=1)[[*range(len(along)), len(along) - 1]]
    return np.rint(np.concatenate([line.points - normal * max(1.0, line.asc), line.points + normal * max(1.0, line.desc)]))


def page_lines(m: dict[str, np.ndarray]) -> list[list[Line]]:
    """The regions of a map in reading order, the lines of each from top to bottom: fragments joined, regions by close lines that no
    separator parts, wide ones split at a gutter, then the order of their hulls' boxes."""
    sep = np.maximum(m["sep"], 0)
    found = joined([x for x, _, _ in map_lines(m)], sep)
    parts = [p for region in regions(found, sep) for p in columns(region, sep)]
    boxes = []
    for part in parts:
        hull = np.array(crops.hull([tuple(p) for x in part for p in outline(x)]))
        boxes.append((*hull.min(axis=0), *hull.max(axis=0)))
    return [sorted(parts[i], key=lambda x: x.cy) for i, _, _ in lines.order_boxes(boxes)]


def by_map(maps: DataFrame, names: list[str], fn: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """(page_id, ..) of fn's rows for each page; fn takes the named channels as arrays of h x w. Nothing is shuffled."""
    fields = schema if schema.startswith("struct") else f"page_id {dict(maps.dtypes)['page_id']}, {schema}"

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        for batch in batches:
            rows: list[tuple] = []
            hs, ws = batch.column("h").to_pylist(), batch.column("w").to_pylist()
            flat = {n: batch.column(n) for n in names}
            for k, page in enumerate(batch.column("page_id").to_pylist()):
                got = fn({n: c[k].values.to_numpy(zero_copy_only=False).reshape(hs[k], ws[k]) for n, c in flat.items()})
                rows += [(page, *r) for r in got]
            cols = list(zip(*rows)) or [()] * len(arrow.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], arrow.names)

    from pyspark.sql.types import _parse_datatype_string

    made = _parse_datatype_string(fields)
    return maps.select("page_id", "h", "w", *names).mapInArrow(run, made)


def _channel(maps: DataFrame, col: str, out: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    return by_map(maps, [col], lambda m: [(*m[col].shape, fn(m[col]).ravel().tolist())], f"h int, w int, {out} array<double>")


def vertical_max(maps: DataFrame, col: str, out: str, reach: int = REACH) -> DataFrame:
    """(page_id, h, w, out): column_max of a channel."""
    return _channel(maps, col, out, lambda a: column_max(a, reach))


def smooth3x3(maps: DataFrame, col: str, out: str) -> DataFrame:
    """(page_id, h, w, out): mean3x3 of a channel."""
    return _channel(maps, col, out, mean3x3)


def peak_mask(maps: DataFrame) -> DataFrame:
    """(page_id, y, x) of the peaks: few of a map's cells."""
    return by_map(maps, ["base", "endp"], lambda m: list(zip(*(c.tolist() for c in np.nonzero(peaks(m["base"], m["endp"]))))), "y int, x int")


def found_lines(maps: DataFrame) -> DataFrame:
    """(page_id, seq, min_y, min_x, n_pixels, baseline, asc, desc) of map_lines()."""

    def rows(m):
        return [(x.seq, *first, n, [{"x": float(a), "y": float(b)} for a, b in x.points], x.asc, x.desc) for x, n, first in map_lines(m)]

    return by_map(maps, ["asc_h", "desc_h", "base", "endp"], rows, "seq int, min_y int, min_x int, n_pixels long, baseline array<struct<x:double,y:double>>, asc double, desc double")


def column_profile(maps: DataFrame, col: str = "sep") -> DataFrame:
    """(page_id, gutter, peak, med, strong) of gutter()."""
    return by_map(maps, [col], lambda m: [gutter(m[col])], "gutter int, peak double, med double, strong boolean")


def has_gutter(gray: np.ndarray) -> bool:
    """Whether the ink share, smoothed over columns, dips in the centre under a quarter of its median."""
    w = gray.shape[1]
    if w < 10:
        return False
    k = max(3, w // 200)
    ink = np.convolve((gray < DARK).mean(axis=0), np.ones(k) / k, mode="same")
    part = lambda a, b: ink[int(a * w) : int(b * w)]
    return bool(part(0.42, 0.58).min() < GUTTER_RATIO * (np.median(part(0.05, 0.95)) + 1e-6))


def central_gutter(maps: DataFrame, gray: str = "gray") -> DataFrame:
    """(page_id, gutter) of has_gutter()."""
    return by_map(maps, [gray], lambda m: [(has_gutter(m[gray]),)], "gutter boolean")


def cells(maps: DataFrame, *cols: str) -> DataFrame:
    """(page_id, y, x, cols): a row for each cell, to look at a map as a table."""
    rows = maps.select("page_id", "w", F.posexplode(F.arrays_zip(*cols)).alias("i", "c"))
    return rows.select("page_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), *(F.col(f"c.{c}").alias(c) for c in cols))


PLACED = "region_idx int, line_idx int, baseline array<struct<x:double,y:double>>, asc double, desc double"


def placed_rows(found: list[list[Line]], sx: float = 1.0, sy: float = 1.0, x_off: float = 0.0, first: tuple[int, int] = (0, 0)) -> list[tuple]:
    """Rows of PLACED of regions in order, their places scaled and moved, regions and lines counted on from first."""
    out, n = [], first[1]
    for r, region in enumerate(found, first[0]):
        for x in region:
            out.append((r, n, [{"x": float(a) * sx + x_off, "y": float(b) * sy} for a, b in x.points], x.asc * sy, x.desc * sy))
            n += 1
    return out


def maps_to_regions(maps: DataFrame) -> DataFrame:
    """(page_id, region_idx, line_idx, baseline, asc, desc, x0, x1, cy): page_lines() of each map. Pages without lines have no row."""
    return measured(by_map(maps, list(CHANNELS), lambda m: placed_rows(page_lines(m)), PLACED))


def measured(rows: DataFrame) -> DataFrame:
    """rows (.., baseline) with x0, x1 and cy of their baselines."""
    xs = F.transform("baseline", lambda p: p["x"])
    mean = F.aggregate("baseline", F.lit(0.0), lambda s, p: s + p["y"]) / F.size("baseline")
    return rows.withColumn("x0", F.array_min(xs)).withColumn("x1", F.array_max(xs)).withColumn("cy", mean)
