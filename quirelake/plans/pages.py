"""From page images to texts: layout, crops, recognition, the choice among resolutions, and roles."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import bbox_from_quad, text_features, word_box
from quirelake.operators import adaptive, alto, blocks, crops, ctc, lines, maps
from quirelake.session import scratch
from quirelake.sources.models import LayoutPort, ModelPort, RolePort, key_of, loaded, probed, recognise

#: Fixed value: the size (h, w) of a line's picture for the role network.
ROLE_CROP = (32, 256)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that no network runs twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bgr(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(h, w, 3)


def _gray(image: np.ndarray) -> np.ndarray:
    return np.floor(image @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def channels(image: np.ndarray, net, ds: int) -> dict[str, np.ndarray]:
    """The layout map of an image: resized as layout_sizes says, padded to multiples of PAD by its last rows and columns, and cut back."""
    for h, w in crops.layout_sizes(*image.shape[:2], ds):
        image = crops.area_resize(image, h, w)
    padded = np.pad(image, ((0, -h % crops.PAD), (0, -w % crops.PAD), (0, 0)), mode="edge")
    return dict(zip(maps.CHANNELS, net(padded)[:, :h, :w].astype(float)))


def laid_out(image: np.ndarray, net, ds: int) -> list[tuple]:
    """Rows of maps.PLACED of a page. A wide page with a gutter in its middle is two pages side by side: each half is laid out by
    itself, and both are put on the whole page's map, the left one's regions first."""
    h, w = image.shape[:2]
    if w <= crops.SPREAD * h or not maps.has_gutter(_gray(image)):
        return maps.placed_rows(maps.page_lines(channels(image, net, ds)))
    full_h, full_w = crops.layout_sizes(h, w, ds)[-1]
    out: list[tuple] = []
    for half, off in ((image[:, : w // 2], 0.0), (image[:, w // 2 :], full_w / 2)):
        m = channels(half, net, ds)
        map_h, map_w = m["base"].shape
        first = (out[-1][0] + 1, out[-1][1] + 1) if out else (0, 0)
        out += maps.placed_rows(maps.page_lines(m), full_w / 2 / map_w, full_h / map_h, off, first)
    return out


def layout(pages: DataFrame, port: LayoutPort, ds: int = crops.DOWNSAMPLE) -> DataFrame:
    """pages (page_id long, h, w, data) -> (page_id, region_idx, line_idx, baseline, asc, desc, x0, x1, cy) in reading order, on the
    page's map. A page's map lives within one call; its lines alone leave it. The network is loaded once a worker."""
    key = key_of(port)

    def run(batches):
        net = loaded(key, port, probed)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = [(r.page_id, *x) for x in laid_out(_bgr(r.data, r.h, r.w), net, ds)]
                yield pd.DataFrame(rows, columns=["page_id", "region_idx", "line_idx", "baseline", "asc", "desc"])

    return maps.measured(pages.select("page_id", "h", "w", "data").mapInPandas(run, f"page_id long, {maps.PLACED}"))


def line_crops(pages: DataFrame, found: DataFrame, ds: int = crops.DOWNSAMPLE, height_scale: float = 1.0) -> DataFrame:
    """(page_id, line_idx, crop_w, m, pixels): gray crops of all lines, cut where the page's pixels are; m maps them to the page."""
    scales = crops.resize_chain(pages.select("page_id", "h", "w"), ds).select("page_id", "img_scale")
    taller = lambda c, least: F.greatest(F.lit(least), F.col(c) * height_scale) * F.col("img_scale")
    rows = found.join(scales, "page_id").withColumn("asc", taller("asc", crops.MIN_ASC)).withColumn("desc", taller("desc", crops.MIN_DESC))
    points = rows.select("page_id", "line_idx", "asc", "desc", "img_scale", F.posexplode("baseline").alias("i", "p")).select("page_id", "line_idx", "asc", "desc", "i", (F.col("p.x") * F.col("img_scale")).alias("x"), (F.col("p.y") * F.col("img_scale")).alias("y"))
    cut = crops.crop_affine(points, "page_id", "line_idx").groupBy("page_id").agg(F.collect_list(F.struct("line_idx", "dst_w", "dst_h", "crop_w", "m")).alias("cut"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                gray = _gray(_bgr(r.data, r.h, r.w))
                made = [(r.page_id, c["line_idx"], c["crop_w"], list(c["m"]), crops.line_crop(gray, c["m"], c["dst_w"], c["dst_h"], c["crop_w"]).tobytes()) for c in r.cut]
                yield pd.DataFrame(made, columns=["page_id", "line_idx", "crop_w", "m", "pixels"])

    return pages.join(cut, "page_id").select("page_id", "h", "w", "data", "cut").mapInPandas(run, "page_id long, line_idx int, crop_w int, m array<double>, pixels binary")


def layout_figures(pages: DataFrame, found: DataFrame, ds: int) -> DataFrame:
    """(page_id, ds, pitch, wide, lineh, n_lines) of the lines as the layout gives them, before their heights are calibrated."""
    ids = pages.select("page_id")
    scaled = found.join(crops.resize_chain(pages.select("page_id", "h", "w"), ds).select("page_id", "img_scale", F.col("w").alias("page_w")), "page_id").withColumn("seq", F.col("line_idx"))
    wider = scaled.withColumn("x0", F.col("x0") * F.col("img_scale")).withColumn("x1", F.col("x1") * F.col("img_scale"))
    share = wider.withColumn("x0", F.col("x0") / F.col("page_w")).withColumn("x1", F.col("x1") / F.col("page_w"))
    count = found.groupBy("page_id").agg(F.count("*").cast("int").alias("n_lines"))
    figures = ids.join(lines.pitch_ratio(ids, wider), "page_id").join(lines.wide_fraction(ids, share, 1.0), "page_id").join(lines.line_height_median(ids, found), "page_id").join(count, "page_id", "left")
    return figures.select("page_id", F.lit(ds).alias("ds"), F.col("pitch_ratio").alias("pitch"), F.col("wide_frac").alias("wide"), F.col("line_height").alias("lineh"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def recognised_lines(pages: DataFrame, found: DataFrame, model: ModelPort, vocab: DataFrame, ds: int, height_scale: float = 1.0, max_width: int = 1600) -> tuple[DataFrame, DataFrame]:
    """(lines, words) of the pages at one resolution; heights are calibrated by the pitch of their region first."""
    calibrated = lines.calibrate_pitch(found.withColumn("seq", F.col("line_idx")))
    line_id = F.concat_ws(":", "page_id", "line_idx")
    cut = _kept(line_crops(pages, calibrated, ds, height_scale).withColumn("line_id", line_id), "crops")
    frames = _kept(recognise(cut, model, max_width, "string"), "frames")
    box = bbox_from_quad(F.lit(0.0), F.lit(0.0), F.col("crop_w").cast("double"), F.lit(float(crops.TARGET_H)), F.col("m"))
    text = ctc.decode(frames, vocab).join(cut.select("line_id", "page_id", "line_idx", box.alias("box")), "line_id")
    rows = text.join(found.select("page_id", "line_idx", "region_idx"), ["page_id", "line_idx"]).join(pages.select("page_id", F.col("h").alias("page_h"), F.col("w").alias("page_w")), "page_id")
    rows = rows.select("page_id", "region_idx", "line_idx", "text", "conf", F.col("box.x").alias("hpos"), F.col("box.y").alias("vpos"), F.col("box.w").alias("width"), F.col("box.h").alias("height"), "page_w", "page_h")
    chars = ctc.emitted(ctc.best_classes(frames, max_width)).join(F.broadcast(vocab), F.col("cls") == F.col("idx")).select("line_id", "t", "ch")
    spans = ctc.word_spans(chars, "line_id").join(cut.select("line_id", "page_id", "line_idx", "crop_w", "m"), "line_id")
    words = spans.withColumn("b", word_box(F.col("t0"), F.col("t1"), F.col("crop_w"), F.col("m"))).select("page_id", "line_idx", "word_idx", "word", "b.x", "b.y", "b.w", "b.h")
    return _kept(rows, "texts"), _kept(words, "words")


def with_roles(pages: DataFrame, rows: DataFrame, port: RolePort | None) -> DataFrame:
    """rows of chosen lines with role: of the network's scores, those that are sure enough; body where a line lies outside the page.
    Without a network role is null."""
    if port is None:
        return rows.withColumn("role", F.lit(None).cast("string"))
    key, by = key_of(port), ["page_id", "line_idx"]
    geometry, context = blocks.geometry_features(rows), blocks.context_features(rows)
    said = blocks.kept_lines(rows).select(*by, "hpos", "vpos", "width", "height", *(c.alias(k) for k, c in text_features(F.col("text")).items()))
    full = said.join(geometry, by).join(context, by)
    names = [c for part in (said, geometry, context) for c in part.columns if c[:2] in ("f_", "g_", "c_")]
    asked = full.groupBy("page_id").agg(F.collect_list(F.struct("line_idx", "hpos", "vpos", "width", "height", F.array(*names).alias("feats"))).alias("lines"))

    def run(batches):
        net = loaded(key, port)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                gray, made = _gray(_bgr(r.data, r.h, r.w)), []
                for x in r.lines:
                    top, left = max(0, x["vpos"]), max(0, x["hpos"])
                    part = gray[top : max(0, x["vpos"] + x["height"]), left : max(0, x["hpos"] + x["width"])]
                    if part.size:
                        made.append((x["line_idx"], crops.area_resize(part, *ROLE_CROP), x["feats"]))
                if made:
                    at, pictures, feats = zip(*made)
                    scores = net.scores((np.array(pictures, dtype=np.float32)[:, None] / 255 - 0.5) / 0.5, np.array([list(f) for f in feats], dtype=np.float32))
                    yield pd.DataFrame({"page_id": r.page_id, "line_idx": at, "scores": [s.astype(float).tolist() for s in scores]})

    scored = pages.join(asked, "page_id").select("page_id", "h", "w", "data", "lines").mapInPandas(run, "page_id long, line_idx int, scores array<double>")
    return rows.join(blocks.gate_roles(scored).select(*by, "role"), by, "left").withColumn("role", F.coalesce("role", F.lit("body")))


def process(pages: DataFrame, port: LayoutPort, model: ModelPort, vocab: DataFrame, adaptive_levels: bool = True, height_scale: float = 1.0, max_width: int = 1600, processed_at: str = "1970-01-01T00:00:00Z", roles: RolePort | None = None) -> DataFrame:
    """read_pages() -> (page_id, origin, status, ds, mean_conf, n_lines, text, alto).

    With adaptive_levels a page is laid out at the coarsest resolution first, and recognised there unless that is too coarse; only
    pages that weren't, or whose text isn't sure enough, go on to the next one. Pages that can't be read keep their status
    and have no text; pages without lines have an empty one.
    """
    # operators take numbers for pages; names come back at the end
    keyed = pages.withColumn("name", F.col("page_id")).withColumn("page_id", F.xxhash64("origin"))
    usable = keyed.where("status = 202").select("page_id", F.col("height").alias("h"), F.col("width").alias("w"), "data")
    levels = adaptive.LEVELS if adaptive_levels else adaptive.LEVELS[:1]
    open_, passes, read = usable, [], []
    for ds in levels:
        found = _kept(layout(open_, port, ds), "layout")
        figures = _kept(layout_figures(open_, found, ds), "figures")
        coarse = adaptive.starved(F.col("pitch"), F.col("wide"), F.col("lineh")) if ds != levels[-1] else F.lit(False)
        legible = figures.where(~coarse).select("page_id")
        now = open_.join(legible, "page_id", "left_semi")
        rows, words = recognised_lines(now, found.join(legible, "page_id", "left_semi"), model, vocab, ds, height_scale, max_width)
        conf = blocks.kept_lines(rows).groupBy("page_id").agg(F.avg("conf").alias("conf"))
        seen = _kept(figures.join(conf, "page_id", "left").withColumn("conf", F.coalesce("conf", F.lit(0.0))), "pass")
        passes.append(seen)
        read.append((rows.withColumn("ds", F.lit(ds)), words.withColumn("ds", F.lit(ds))))
        done = seen.where(~coarse & (F.col("conf") >= adaptive.CONF)).select("page_id")
        open_ = open_.join(done, "page_id", "left_anti")
        if ds != levels[-1] and open_.select("page_id").isEmpty():
            break
    every = _union(passes)
    chosen = _kept(adaptive.choose(every).select("page_id", "ds", "conf") if adaptive_levels else every.select("page_id", "ds", "conf"), "chosen")
    rows, words = (_union([r[k] for r in read]).join(chosen.select("page_id", "ds"), ["page_id", "ds"]) for k in (0, 1))
    rows = _kept(with_roles(usable, rows, roles), "chosen-lines")
    n = blocks.kept_lines(rows).groupBy("page_id").agg(F.count("*").alias("n_lines"))
    out = keyed.select("page_id", "name", "origin", "status").join(chosen, "page_id", "left").join(n, "page_id", "left").join(blocks.page_text(rows), "page_id", "left").join(alto.to_alto(alto.with_words(rows, words), processed_at), "page_id", "left")
    got = lambda c: F.when(F.col("status") == 202, c)
    return out.select(F.col("name").alias("page_id"), "origin", "status", "ds", F.bround("conf", 4).alias("mean_conf"), got(F.coalesce("n_lines", F.lit(0))).alias("n_lines"), got(F.coalesce("page_text", F.lit("\n"))).alias("text"), "alto")


class Networks(NamedTuple):
    """What a domain's pages are read with."""

    layout: LayoutPort
    model: ModelPort
    vocab: DataFrame
    roles: RolePort | None = None


def process_domains(pages: DataFrame, networks: dict[str, Networks], **settings) -> DataFrame:
    """process() of read_pages() with a column domain, each page by its domain's networks; no domain and an empty one are "default".
    Pages of other domains have status 400 and no text. There are as many runs as domains."""
    domain = F.when(F.coalesce("domain", F.lit("")) == "", "default").otherwise(F.col("domain"))
    named = pages.withColumn("domain", domain)
    parts = [process(named.where(F.col("domain") == d).drop("domain"), n.layout, n.model, n.vocab, roles=n.roles, **settings).withColumn("domain", F.lit(d)) for d, n in networks.items()]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    refused = named.where(~F.col("domain").isin(*networks)).select("page_id", "origin", F.lit(400).alias("status"), none("ds", "int"), none("mean_conf", "double"), none("n_lines", "long"), none("text", "string"), none("alto", "string"), "domain")
    return _union([*parts, refused])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
