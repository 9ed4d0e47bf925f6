"""Geometry of scans and line crops: sizes of the layout input, spreads, affine crops, line polygons."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import fold_angle, line_direction

#: Fixed values of the size rules.
MAX_WIDTH, MAX_SIDE, DOWNSAMPLE, PAD, SPREAD = 1500, 1536, 3, 32, 1.2
MIN_ASC, MIN_DESC, TARGET_H = 3.0, 2.0, 40


def resize_chain(sizes: DataFrame, ds: int = DOWNSAMPLE) -> DataFrame:
    """sizes (.., h, w) -> with hd, wd (layout input), img_scale, pad_h, pad_w."""
    whole = lambda c: F.greatest(F.lit(1), c.cast("int"))
    wide = F.col("w") > MAX_WIDTH
    rows = sizes.withColumn("h1", F.when(wide, whole(F.col("h") * (F.lit(float(MAX_WIDTH)) / F.col("w")))).otherwise(F.col("h"))).withColumn("w1", F.when(wide, F.lit(MAX_WIDTH)).otherwise(F.col("w")))
    rows = rows.withColumn("h2", whole(F.floor(F.col("h1") / ds))).withColumn("w2", whole(F.floor(F.col("w1") / ds)))
    side = F.greatest("h2", "w2")
    scale = F.lit(float(MAX_SIDE)) / side
    rows = rows.withColumn("hd", F.when(side > MAX_SIDE, whole(F.col("h2") * scale)).otherwise(F.col("h2"))).withColumn("wd", F.when(side > MAX_SIDE, whole(F.col("w2") * scale)).otherwise(F.col("w2")))
    pad = lambda c: ((F.lit(PAD) - F.col(c) % PAD) % PAD).cast("int")
    return rows.withColumn("img_scale", F.col("h") / F.col("hd")).withColumn("pad_h", pad("hd")).withColumn("pad_w", pad("wd")).drop("h1", "w1", "h2", "w2")


def spread_frame(sizes: DataFrame, ds: int = DOWNSAMPLE) -> DataFrame:
    """sizes (page_id, h, w) of spreads -> (page_id, side, sx, sy, x_off): how each half's map coordinates become those of the
    whole page's map. The left half comes first."""
    mid = F.floor(F.col("w") / 2).cast("int")
    whole = resize_chain(sizes.select("page_id", "h", "w"), ds).select("page_id", F.col("hd").alias("f_hd"), F.col("wd").alias("f_wd"))
    halves = [resize_chain(sizes.select("page_id", "h", w.cast("int").alias("w")), ds).select("page_id", F.lit(side).alias("side"), "hd", "wd") for side, w in ((0, mid), (1, F.col("w") - mid))]
    rows = halves[0].unionByName(halves[1]).join(whole, "page_id")
    return rows.select("page_id", "side", (F.col("f_wd") / 2 / F.col("wd")).alias("sx"), (F.col("f_hd") / F.col("hd")).alias("sy"), F.when(F.col("side") == 1, F.col("f_wd") / 2).otherwise(0.0).alias("x_off"))


def layout_sizes(h: int, w: int, ds: int = DOWNSAMPLE) -> list[tuple[int, int]]:
    """The sizes (h, w) that an image goes through on its way to the layout network, as of resize_chain; the last is hd, wd."""
    out = [(max(1, int(h * (MAX_WIDTH / w))), MAX_WIDTH)] if w > MAX_WIDTH else []
    h, w = out[-1] if out else (h, w)
    out.append((max(1, h // ds), max(1, w // ds)))
    if (side := max(out[-1])) > MAX_SIDE:
        out.append(tuple(max(1, int(v * (MAX_SIDE / side))) for v in out[-1]))
    return out


def _shares(src: int, dst: int) -> np.ndarray:
    """(dst, src): what share each old pixel has in each new one: by covered area, or between the two nearest where it grows."""
    at = np.arange(src)
    if dst <= src:
        a, b = (np.arange(dst)[:, None] + k for k in (0, 1))
        return np.clip(np.minimum(at + 1, b * (src / dst)) - np.maximum(at, a * (src / dst)), 0, None) * (dst / src)
    centre = np.clip((np.arange(dst)[:, None] + 0.5) * (src / dst) - 0.5, 0, src - 1)
    return np.clip(1 - np.abs(centre - at), 0, None)


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bytes (h0, w0) or (h0, w0, channels) at another size; each new pixel is the mean over the area it covers."""
    if image.shape[:2] == (h, w):
        return image
    rows, cols = (_shares(a, b).astype(np.float32) for a, b in zip(image.shape, (h, w)))
    made = np.tensordot(rows, image.astype(np.float32), axes=(1, 0))
    made = np.moveaxis(np.tensordot(cols, made, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(made), 0, 255).astype(np.uint8)


def crop_affine(points: DataFrame, *keys: str, scale: float = 1.0) -> DataFrame:
    """points (keys, i, x, y, asc, desc) of baselines -> (keys, dst_w, dst_h, crop_w, m): the affine map from crop pixels to the page.

    The line's direction is the principal axis of its points; with one point it is level. The crop is TARGET_H high.
    """
    p = points.withColumn("px", F.col("x") * scale).withColumn("py", F.col("y") * scale)
    ends = lambda f, c: f(F.struct("i", c))[c]
    g = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.covar_pop("px", "py").alias("cov"), F.var_pop("px").alias("vx"), F.var_pop("py").alias("vy"),
        ends(F.min, "px").alias("x0"), ends(F.min, "py").alias("y0"), ends(F.max, "px").alias("x1"), ends(F.max, "py").alias("y1"), F.first("asc").alias("asc"), F.first("desc").alias("desc"),
    )
    angle = F.when(F.col("n") >= 2, line_direction(F.col("cov"), F.col("vx"), F.col("vy"))).otherwise(0.0)
    g = g.withColumn("dx", F.cos(angle)).withColumn("dy", F.sin(angle)).withColumn("up", F.greatest(F.lit(MIN_ASC), F.col("asc")) * scale).withColumn("down", F.greatest(F.lit(MIN_DESC), F.col("desc")) * scale)
    g = g.withColumn("dst_w", F.greatest(F.lit(1), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).cast("int"))).withColumn("dst_h", F.bround(F.col("up") + F.col("down")).cast("int"))
    half, dx, dy = F.col("dst_w") / 2, F.col("dx"), F.col("dy")
    tl_x, tl_y = F.col("cx") - half * dx + F.col("up") * dy, F.col("cy") - half * dy - F.col("up") * dx
    # one crop row is (up + down) / dst_h along the normal; a crop pixel of the scaled crop is dst_h / TARGET_H of it
    step = F.col("dst_h") / F.lit(float(TARGET_H))
    tall = (F.col("up") + F.col("down")) / F.col("dst_h") * step
    m = F.array(dx * step, -dy * tall, tl_x, dy * step, dx * tall, tl_y, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return g.where((F.col("dst_h") >= 2) & (F.col("dst_w") >= 2)).select(*keys, "dst_w", "dst_h", F.greatest(F.lit(1), (F.col("dst_w") * (F.lit(float(TARGET_H)) / F.col("dst_h"))).cast("int")).alias("crop_w"), m.alias("m"))


def baseline_polygon(baseline: Column, asc: Column, desc: Column) -> Column:
    """The outline of a baseline (array of x, y structs): offset along each point's normal by asc above and desc below; the last
    segment's normal serves its end too. One point: a box four wide."""
    up, down = F.greatest(asc, F.lit(1.0)), F.greatest(desc, F.lit(1.0))
    n = F.size(baseline)

    def normal(i: Column) -> Column:
        k = F.least(i, n - 2)
        a, b = F.get(baseline, k), F.get(baseline, k + 1)
        return fold_angle((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double"))

    at = lambda x, y: F.struct(F.bround(x).cast("int").alias("x"), F.bround(y).cast("int").alias("y"))
    above = F.transform(baseline, lambda p, i: at(p["x"] - F.cos(normal(i)) * up, p["y"] - F.sin(normal(i)) * up))
    below = F.transform(baseline, lambda p, i: at(p["x"] + F.cos(normal(i)) * down, p["y"] + F.sin(normal(i)) * down))
    p = F.get(baseline, F.lit(0))
    corner = lambda dx, dy: F.struct((p["x"] + dx).cast("int").alias("x"), (p["y"] + dy).cast("int").alias("y"))
    box = F.array(corner(-2, -up.cast("int")), corner(2, -up.cast("int")), corner(2, down.cast("int")), corner(-2, down.cast("int")))
    return F.when(n >= 2, F.concat(above, F.reverse(below))).when(n == 1, box)


def line_crop(gray: np.ndarray, m: list[float], dst_w: int, dst_h: int, crop_w: int) -> np.ndarray:
    """A line's pixels, TARGET_H high: cut at the page's resolution, then resized by area. m is that of crop_affine."""
    step = dst_h / TARGET_H
    return area_resize(warp(gray, [m[0] / step, m[1] / step, m[2], m[3] / step, m[4] / step, m[5]], dst_w, dst_h), TARGET_H, crop_w)


def warp(image: np.ndarray, m: list[float], width: int, height: int = TARGET_H) -> np.ndarray:
    """Crop pixels from a gray image by bilinear sampling, borders repeated."""
    v, u = np.mgrid[0:height, 0:width].astype(float)
    x = np.clip(m[0] * u + m[1] * v + m[2], 0, image.shape[1] - 1)
    y = np.clip(m[3] * u + m[4] * v + m[5], 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = x - x0, y - y0
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    bottom = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, from the leftmost point on."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def separator_penalty(upper: list[tuple[float, float]], lower: list[tuple[float, float]], desc: float, asc: float, sep: np.ndarray) -> float:
    """The larger share of separator mass under two baselines, the upper one moved down by desc and the lower one up by asc,
    three pixels thick, over their common columns; 1 if they share 5 or fewer."""
    x0 = math.ceil(max(upper[0][0], lower[0][0], 0))
    x1 = math.floor(min(upper[-1][0], lower[-1][0], sep.shape[1] - 1))
    if x1 - x0 <= 5:
        return 1.0
    cols = np.arange(x0, x1 + 1)
    out = []
    for line, shift in ((upper, desc), (lower, -asc)):
        ys = np.rint(np.interp(cols, [p[0] for p in line], [p[1] for p in line]) + shift).astype(int)
        rows = ys[None, :] + np.array([[-1], [0], [1]])
        inside = (rows >= 0) & (rows < sep.shape[0])
        out.append(float((sep[np.clip(rows, 0, sep.shape[0] - 1), cols] * inside).sum()) / (x1 - x0))
    return max(out)
