"""Hand-computed cases and properties of the page operators."""

import math
import random
import re
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import argmax, bbox_from_quad, softmax, text_features
from quirelake.operators import adaptive, alto, blocks, crops, ctc, jobs, lines, maps, requests
from quirelake.plans import catalog
from quirelake.plans import views as V
from quirelake.sources import Config, StubModel, load_env
from quirelake.sources.images import read_pages, scan_folder, write_samples
from quirelake.sources.models import load_vocab, recognise, resolve


def test_page_text_blank_and_empty(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, "  "), (1, 1, 5, "b"), (2, 0, 0, " \t ")]
    got = dict(blocks.page_text(spark.createDataFrame(rows, "page_id long, region_idx int, line_idx int, text string")).collect())
    assert got == {1: "a\n\nb\n", 2: "\n"}


def test_decode_words_and_spaces(spark):
    text = "ab  b c"
    frames = []
    for i, ch in enumerate(text):
        frames += [(1, 2 * i, ch), (1, 2 * i + 1, None if text[i + 1 : i + 2] == ch else ch)]
    df = spark.createDataFrame(frames, "line_id long, t int, ch string")
    chars = ctc.emitted(df, "ch", None)
    assert ctc.text_of(chars, "line_id").collect()[0][1] == text
    spans = [(r.word, r.t0, r.t1) for r in ctc.word_spans(chars, "line_id").orderBy("word_idx").collect()]
    assert spans == [("ab", 0, 3), ("b", 8, 9), ("c", 12, 12)]


def test_decode_of_nothing(spark):
    frames = spark.createDataFrame([(7, 0, [5.0, 1.0]), (7, 1, [5.0, 1.0])], "line_id long, t int, logits array<double>")
    vocab = spark.createDataFrame([(1, "a")], "idx int, ch string")
    assert ctc.decode(frames, vocab).collect()[0].asDict() == {"line_id": 7, "text": "", "conf": 0.0, "n_chars": 0}


def test_array_functions(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "a array<double>").select(argmax(F.col("a")), softmax(F.col("a"))).first()
    assert row[0] == 1
    assert np.allclose(row[1], np.exp([-2, 0, 0]) / np.exp([-2, 0, 0]).sum())


@pytest.mark.parametrize(("text", "numeral", "ends"), [("XII", 1, 0), ("– 3 –", 1, 0), ("", 0, 1), ("Ende.", 0, 1), ("2²", 0, 0)])
def test_text_features(spark, text, numeral, ends):
    row = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in text_features(F.col("t")).items())).first()
    assert (row.f_numeral, row.f_ends) == (numeral, ends)
    assert row.f_digits == (1 if text == "2²" else sum(c.isdigit() for c in text) / max(1, len(text)))


def test_box_of_a_quad(spark):
    m = [0.0, -1.0, 10.5, 1.0, 0.0, 2.0, 0.0, 0.0, 1.0]
    got = spark.range(1).select(bbox_from_quad(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.array(*map(F.lit, m))).alias("b")).first().b
    assert tuple(got) == (8, 2, 3, 4)


def test_adaptive_rules(spark):
    rows = [
        (1, 3, 0.95, 1.0, 0.0, 20.0, 10), (1, 2, 0.99, 1.0, 0.0, 20.0, 10),  # confident at once
        (2, 3, 0.50, 1.0, 0.0, 20.0, 10), (2, 2, 0.80, 1.0, 0.0, 20.0, 99), (2, 1, 0.70, 1.0, 0.0, 20.0, 99),  # unreadable: the best
        (3, 3, 0.50, 0.5, 0.0, 20.0, 10), (3, 2, 0.70, 1.0, 0.0, 20.0, 10), (3, 1, 0.71, 1.0, 0.0, 20.0, 10),  # starved is skipped; no margin
    ]
    df = spark.createDataFrame(rows, "page_id long, ds int, conf double, pitch double, wide double, lineh double, n_lines int")
    assert {r.page_id: (r.ds, r.n_seen) for r in adaptive.choose(df).collect()} == {1: (3, 1), 2: (2, 3), 3: (2, 2)}


def test_smoothing_is_that_of_mirrored_borders(spark):
    a = np.random.default_rng(1).random((7, 9))
    page = spark.createDataFrame([(1, 7, 9, a.ravel().tolist())], "page_id long, h int, w int, v array<double>")
    p = np.pad(a, 1, mode="symmetric")
    want = sum(p[i : i + 7, j : j + 9] for i in range(3) for j in range(3)) / 9
    got = maps.cells(maps.smooth3x3(page, "v", "s"), "s").collect()
    assert len(got) == 63 and all(abs(r.s - want[r.y, r.x]) < 1e-12 for r in got)


def test_cells_within_three_are_one_component():
    assert maps.label_cells(np.array([0, 3, 7]), np.array([0, 3, 3])).tolist() == [0, 0, 1]
    rng = np.random.default_rng(7)
    for share in (0.02, 0.05, 0.2):
        ys, xs = np.nonzero(rng.random((60, 70)) < share)
        shuffled = rng.permutation(len(ys))
        ys, xs = ys[shuffled], xs[shuffled]
        label, number = {}, 0
        for start in sorted(zip(ys.tolist(), xs.tolist())):
            if start not in label:
                label[start], stack = number, [start]
                while stack:
                    y, x = stack.pop()
                    for other in zip(ys.tolist(), xs.tolist()):
                        if other not in label and max(abs(other[0] - y), abs(other[1] - x)) <= 3:
                            label[other] = number
                            stack.append(other)
                number += 1
        assert maps.label_cells(ys, xs).tolist() == [label[k] for k in zip(ys.tolist(), xs.tolist())]


def test_reading_order_is_a_permutation_in_columns():
    boxes = [(0, 0, 40, 100), (60, 0, 100, 100), (0, 10, 40, 90), (0, 200, 100, 220)]
    got = lines.order_boxes(boxes)
    assert [i for i, _, _ in got] == [0, 2, 1, 3]
    boxes = [(random.random() * 100, random.random() * 500, 100 + random.random() * 50, 520.0) for _ in range(50)]
    assert sorted(i for i, _, _ in lines.order_boxes(boxes)) == list(range(50))
    assert lines.order_boxes([]) == []


def test_merge_stops_at_the_first_line_out_of_reach(spark):
    # the tall third line would join the first, but the second ends the scan
    rows = [(1, 1, 0.0, 50.0, 0.0, 7.0, 3.0), (1, 2, 500.0, 550.0, 11.0, 7.0, 3.0), (1, 3, 52.0, 90.0, 15.0, 60.0, 3.0)]
    df = spark.createDataFrame(rows, "page_id long, seq int, x0 double, x1 double, cy double, asc double, desc double")
    pairs = lambda keep: {(r.a_seq, r.b_seq) for r in lines.merge_candidates(df, skip_later=keep).collect()}
    assert (1, 3) in pairs(False) and (1, 3) not in pairs(True)
    seps = spark.createDataFrame([(1, 7, 51, 0.9)], "page_id long, y int, x int, sep double")
    assert (1, 3) not in {(r.a_seq, r.b_seq) for r in lines.merge_candidates(df, seps, skip_later=False).collect()}


def test_separators_of_many_cells_are_not_broadcast(spark):
    # 400 cells for each of 300 pages and for the unnamed one; they bar the pairs of even pages and of the unnamed page
    pages = spark.range(300).selectExpr("id AS page_id").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    line = "page_id long, seq int, x0 double, x1 double, cy double, asc double, desc double"
    two = [(n, s, x, x + 50.0, 100.0, 7.0, 3.0) for n in [*range(300), None] for s, x in ((1, 0.0), (2, 55.0))]
    cells = pages.where("page_id % 2 = 0 OR page_id IS NULL").selectExpr("page_id", "explode(sequence(90, 109)) AS y").selectExpr("page_id", "y", "explode(sequence(40, 59)) AS x", "0.9D AS sep")
    faint = pages.where("page_id % 2 = 1").selectExpr("page_id", "100 AS y", "52 AS x", "0.2D AS sep")
    beside = pages.where("page_id % 2 = 1").selectExpr("page_id", "100 AS y", "explode(array(49, 56)) AS x", "0.9D AS sep")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = lines.merge_candidates(spark.createDataFrame(two, line), cells.union(faint).union(beside))
        assert got.columns == ["page_id", "a_seq", "b_seq"]
        assert sorted(map(tuple, got.collect())) == [(n, 1, 2) for n in range(1, 300, 2)]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize("at_once", [1, 40, 1 << 18])
def test_joining_by_blocks_is_the_scan_by_lines(monkeypatch, at_once):
    monkeypatch.setattr(lines, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    for n in [0, 1, 2, *[40] * 30]:
        x0, h = rng.integers(0, 300, n).astype(float), rng.integers(8, 15, n) * rng.choice([1.0, 8.0], n, p=[0.9, 0.1])
        p = {"seq": np.arange(n), "x0": x0, "x1": x0 + rng.integers(20, 90, n), "cy": rng.integers(0, 200, n).astype(float), "asc": h, "desc": np.full(n, 3.0)}
        y, x = rng.integers(0, 200, 60), rng.integers(0, 400, 60)
        want = {}
        order = sorted(range(n), key=lambda i: (p["cy"][i], x0[i], i))
        for k, i in enumerate(order):
            for j in order[k + 1 :]:
                hi, hj = h[i] + 3, h[j] + 3
                d, mean = p["cy"][j] - p["cy"][i], 0.5 * (hi + hj)
                if d > max(hi, hj):
                    break
                left, right = p["x1"][i if x0[i] <= x0[j] else j], max(x0[i], x0[j])
                if d <= 0.6 * mean and -0.5 * mean <= right - left <= 1.5 * mean:
                    mid, half = np.floor(0.5 * (p["cy"][i] + p["cy"][j])), np.floor(0.5 * mean)
                    want[i, j] = any(min(left, right) <= b < max(left, right) + 1 and mid - half <= a < mid + half + 1 for a, b in zip(y, x))
        found = lines._joining(p)
        assert dict(zip(zip(found["a_seq"], found["b_seq"]), lines._barred(found, y, x))) == want


def test_separators_and_hulls():
    sep = np.zeros((40, 60))
    up, low = [(0, 10), (50, 10)], [(0, 30), (50, 30)]
    assert crops.separator_penalty(up, low, 2, 8, sep) == 0
    sep[12] = 1
    assert crops.separator_penalty(up, low, 2, 8, sep) > 0.9
    assert crops.separator_penalty(up, [(48, 30), (59, 30)], 2, 8, sep) == 1
    assert crops.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    gray = np.arange(100, dtype=np.uint8).reshape(10, 10)
    assert (crops.warp(gray, [1, 0, 2, 0, 1, 3, 0, 0, 1], 5, 4) == gray[3:7, 2:7]).all()


def test_alto_is_xml_and_holds_the_text(spark):
    rows = [(1, 0, 0, 'a "b" <c> & d', 3, 4, 100, 20, 500, 700, "heading"), (1, 1, 5, "e", 3, 40, 10, 20, 500, 700, None), (1, 2, 9, "  ", 0, 0, 1, 1, 500, 700, None), (2, 0, 0, "", 0, 0, 1, 1, 500, 700, None)]
    df = spark.createDataFrame(rows, "page_id long, region_idx int, line_idx int, text string, hpos int, vpos int, width int, height int, page_w int, page_h int, role string")
    got = {r.page_id: ElementTree.fromstring(r.alto) for r in alto.to_alto(alto.with_shared_words(df)).collect()}
    assert [e.get("CONTENT") for e in got[1].iter() if e.tag.endswith("String")] == ["a", '"b"', "<c>", "&", "d", "e"]
    assert [e.get("ID") for e in got[1].iter() if e.tag.endswith("TextBlock")] == ["block_0", "block_1"]
    assert [e.get("LABEL") for e in got[1].iter() if e.tag.endswith("StructureTag")] == ["heading"]
    assert not [e for e in got[2].iter() if e.tag.endswith("TextBlock")]


def test_words_share_a_long_line(spark):
    rng = random.Random(4)
    texts = ["", "one", " ".join("x" * rng.randint(1, 9) for _ in range(1000)), " ".join(["ab"] * 256), " ".join(["ab"] * 257)]
    rows = [(1, i, t, 7, 5, 3000 + i, 20) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, line_idx int, text string, hpos int, vpos int, width int, height int")
    for r in alto.with_shared_words(df).collect():
        at, unit = 0, r.width / max(1, len(r.text))
        assert len(r.words) == len(r.text.split())
        for w, word in zip(r.words, r.text.split()):
            assert (w.word, w.x, w.y, w.w, w.h) == (word, 7 + math.floor(at * unit), 5, math.ceil(len(word) * unit), 20)
            at += len(word) + 1


def test_requests_and_results(spark):
    keys = spark.createDataFrame([("ann", "k1")], "name string, key string")
    asked = spark.createDataFrame([("k1",), ("k2",), (None,)], "key string")
    assert sorted(r.status for r in requests.authorised(asked, keys).collect()) == [202, 401, 401]
    assert {r.status for r in requests.authorised(asked, None).collect()} == {202}
    files = spark.createDataFrame([(1, ".txt"), (1, ".xml"), (4, ".txt")], "job_id long, suffix string")
    table = spark.createDataFrame([(1, "done"), (2, "failed"), (3, "queued"), (4, "done"), (5, "done")], "job_id long, status string")
    assert {r.job_id: (r.code, r.suffix) for r in jobs.result_of(table, files).collect()} == {1: (200, ".xml"), 2: (500, None), 3: (202, None), 4: (200, ".txt"), 5: (404, None)}
    assert {r.code for r in jobs.result_of(table, files, "pdf").collect()} == {400}
    names = spark.createDataFrame([("rec-a.onnx",), ("dec-b.ONNX",), ("x.txt",)], "name string")
    assert requests.pages_of_models(names).first().recognizers == ["rec-a.onnx"]


def test_images_models_and_settings(spark, tmp_path):
    write_samples(spark.createDataFrame([(0,), (1,)], "k int"), str(tmp_path / "in"))
    pages = {r.page_id: r for r in read_pages(spark, str(tmp_path / "in")).collect()}
    assert pages["broken"].status == 422 and pages["broken"].data is None
    assert pages["page1"].nChannels == 3 and len(pages["page1"].data) == 3 * 12 * 9
    assert [r.page_id for r in scan_folder(spark, str(tmp_path / "in")).collect()] == ["broken", "page0", "page1"]
    (tmp_path / "v.json").write_text('{"characters": ["a", "é"]}', encoding="utf-8")
    assert [tuple(r) for r in load_vocab(spark, str(tmp_path / "v.json")).collect()] == [(1, "a"), (2, "é")]
    assert resolve("/nowhere/v.json", tmp_path) == tmp_path / "v.json"
    crop = spark.createDataFrame([(1, 8, bytearray(range(256)) + bytearray(64)), (2, 4, bytearray(160))], "line_id long, crop_w int, pixels binary")
    assert recognise(crop, StubModel(16)).groupBy("line_id").count().orderBy("line_id").collect() == [(1, 4), (2, 2)]
    with pytest.raises(ValueError, match="ocr_threads.*device"):
        Config(ocr_threads=0, device="tpu")
    (tmp_path / ".env").write_text("QUIRELAKE_ADAPTIVE=no\nQUIRELAKE_MAX_QUEUE=3\n")
    got = load_env({"QUIRELAKE_MAX_QUEUE": "5"}, tmp_path / ".env")
    assert (got.adaptive, got.max_queue) == (False, 5)


def test_uploads_land_and_requests_are_let_in_batch_by_batch(spark, tmp_path):
    from quirelake.streaming import jobs as stream

    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"f{k}.png").write_bytes(bytes([k]) * (k + 1))
    landed = stream.landing(spark, str(tmp_path / "in"), files_a_batch=2)
    sizes = lambda b: b.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")
    stream.write_results(landed, str(tmp_path / "out"), str(tmp_path / "c1"), sizes).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.name, r.length) for r in got.collect()) == [(f"f{k}.png", k + 1) for k in range(5)] and got.select("batch").distinct().count() == 3

    spark.createDataFrame([(i, i % 7) for i in range(20)], "request_id long, at long").coalesce(1).write.parquet(str(tmp_path / "asked"))
    asked = spark.readStream.schema("request_id long, at long").parquet(str(tmp_path / "asked"))
    stream.admit(asked, str(tmp_path / "let"), str(tmp_path / "c2"), 16, lambda s: 11).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "let")).collect()
    assert {r.request_id for r in rows if r.status == 202} == {0, 7, 14, 1, 8} and {r.retry_after for r in rows if r.status == 503} == {5} and len(rows) == 20
    assert {r.status for r in jobs.admitted(spark.createDataFrame([(1, 1)], "request_id long, at long"), 16, 16).collect()} == {503}


def test_pages_are_read_from_pixels_to_text(spark, tmp_path):
    from quirelake.plans.pages import process
    from quirelake.sources.images import png
    from quirelake.sources.models import StubLayout

    def page(bars):
        a = np.full((600, 900), 255, np.uint8)
        for y, x0, x1 in bars:
            a[y - 30 : y, x0:x1] = 90
        return png(a)

    (tmp_path / "two.png").write_bytes(page([(120, 90, 390), (200, 90, 390), (120, 510, 810), (200, 510, 810)]))
    (tmp_path / "blank.png").write_bytes(page([]))
    (tmp_path / "broken.png").write_bytes(b"no image")
    vocab = spark.createDataFrame([(i, chr(96 + i)) for i in range(1, 16)], "idx int, ch string")
    got = {r.page_id: r for r in process(read_pages(spark, str(tmp_path)), StubLayout(), StubModel(16), vocab, adaptive_levels=False).collect()}
    assert (got["broken"].status, got["broken"].text) == (422, None) and (got["blank"].text, got["blank"].n_lines) == ("\n", 0)
    two = got["two"]
    assert two.n_lines == 4 and two.alto.count("<TextLine") == 4 and two.alto.count("<TextBlock") == 2
    assert len(two.text.split("\n\n")) == 2 and 0 < two.mean_conf <= 1
    first = [int(x.split('"')[0]) for x in two.alto.split('<TextLine ID="')[1].split('HPOS="')[1:2]]
    assert abs(first[0] - 90) < 15


class CountedLayout:
    """The stub, of another resolution's pages too; each load leaves a file."""

    def __init__(self, folder):
        self.folder = folder

    def load(self):
        import os
        import uuid

        open(f"{self.folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def maps(self, image):
        from quirelake.sources.models import StubLayout

        return StubLayout().maps(image)


class Logits(CountedLayout):
    """Gives its probabilities before the logistic function."""

    def maps(self, image):
        out = super().maps(image).astype(float)
        out[2:5] = np.where(out[2:5] > 0.5, 4.0, -4.0)
        return out


class Roles:
    """The first line of a page is a heading; lines that end in a digit-like shape are body."""

    def load(self):
        pass

    def scores(self, crops, feats):
        assert crops.shape[1:] == (1, 32, 256) and feats.shape[1] == 21 and -1 <= crops.min() and crops.max() <= 1
        out = np.zeros((len(feats), 5))
        out[:, 1] = np.where(feats[:, 6] < 0.25, 5.0, -5.0)
        return out


def bars(size, places):
    from quirelake.sources.images import png

    a = np.full(size, 255, np.uint8)
    for y, x0, x1 in places:
        a[y - 30 : y, x0:x1] = 90
    return png(a)


def test_networks_load_once_a_worker_and_roles_are_written(spark, tmp_path):
    import os

    from quirelake.plans.pages import process
    from quirelake.sources.models import StubLayout

    (tmp_path / "in").mkdir()
    (tmp_path / "loads").mkdir()
    for k in range(8):
        (tmp_path / "in" / f"p{k}.png").write_bytes(bars((600, 500), [(120, 90, 390), (200, 90, 390 - k), (300, 90, 390)]))
    vocab = spark.createDataFrame([(i, chr(96 + i)) for i in range(1, 16)], "idx int, ch string")
    pages = read_pages(spark, str(tmp_path / "in")).repartition(8)
    got = {r.page_id: r for r in process(pages, CountedLayout(str(tmp_path / "loads")), StubModel(16), vocab, roles=Roles()).collect()}
    # the names are process ids: however many tasks a worker runs, it loads once
    loads = [f.split("-")[0] for f in os.listdir(tmp_path / "loads")]
    assert 0 < len(loads) == len(set(loads))
    plain = {r.page_id: r for r in process(pages, StubLayout(), StubModel(16), vocab).collect()}
    for k, r in got.items():
        assert r.n_lines == 3 and r.alto.count('TAGREFS="ROLE_heading"') == 1 and '<StructureTag ID="ROLE_heading" LABEL="heading"/>' in r.alto
        assert (r.ds, r.text) == (plain[k].ds, plain[k].text) and "TAGREFS" not in plain[k].alto
    # probabilities before the logistic function give the same lines
    other = {r.page_id: r.n_lines for r in process(pages, Logits(str(tmp_path / "loads")), StubModel(16), vocab).collect()}
    assert set(other.values()) == {3}


def test_only_pages_that_need_it_are_read_again(spark, tmp_path, monkeypatch):
    """A page of low lines is laid out again at finer resolutions; the choice is that of the rule over all passes."""
    from quirelake.plans import pages as plan
    from quirelake.sources.models import StubLayout

    (tmp_path / "tall.png").write_bytes(bars((600, 900), [(120, 90, 390), (220, 90, 390)]))
    low = np.full((600, 900), 255, np.uint8)
    for y in range(60, 560, 40):
        low[y - 8 : y, 60:800] = 90
    from quirelake.sources.images import png

    (tmp_path / "low.png").write_bytes(png(low))
    asked, read = [], []
    real_layout, real_read = plan.layout, plan.recognised_lines
    monkeypatch.setattr(plan, "layout", lambda pages, port, ds: asked.append((ds, pages.count())) or real_layout(pages, port, ds))
    monkeypatch.setattr(plan, "recognised_lines", lambda pages, *a: read.append(pages.count()) or real_read(pages, *a))

    class Sure(StubModel):
        def run(self, crops):
            return super().run(crops) * 4

    vocab = spark.createDataFrame([(i, chr(96 + i)) for i in range(1, 16)], "idx int, ch string")
    got = {r.page_id: r for r in plan.process(read_pages(spark, str(tmp_path)), StubLayout(), Sure(16), vocab).collect()}
    assert asked[0] == (3, 2) and asked[1] == (2, 1) and read[0] == 1
    assert got["tall"].ds == 3 and got["tall"].n_lines == 2 and got["low"].ds < 3


def test_spreads_are_two_pages(spark, tmp_path):
    from quirelake.plans.pages import process
    from quirelake.sources.models import StubLayout

    left, right = [(y, 90, 500) for y in (120, 200, 280)], [(y, 700, 1100) for y in (140, 220)]
    (tmp_path / "spread.png").write_bytes(bars((600, 1200), left + right))
    (tmp_path / "wide.png").write_bytes(bars((600, 1200), [(y, 90, 1100) for y in (120, 200, 280)]))
    vocab = spark.createDataFrame([(i, chr(96 + i)) for i in range(1, 16)], "idx int, ch string")
    got = {r.page_id: r for r in process(read_pages(spark, str(tmp_path)), StubLayout(), StubModel(16), vocab, adaptive_levels=False).collect()}
    assert got["spread"].n_lines == 5 and got["wide"].n_lines == 3 and got["wide"].alto.count("<TextBlock") == 1
    places = [tuple(int(v) for v in re.search('HPOS="(-?[0-9]+)" VPOS="(-?[0-9]+)" WIDTH="[0-9]+" HEIGHT="([0-9]+)"', x).groups()) for x in got["spread"].alto.split("<TextLine")[1:]]
    assert len(places) == 5 and all(abs(x - 90) < 20 for x, _, _ in places[:3]) and all(abs(x - 700) < 20 for x, _, _ in places[3:])
    # each box holds its bar's lower half, and ends a little under it
    assert all(y < foot - 15 and foot - 6 < y + h < foot + 25 for (_, y, h), foot in zip(places, (120, 200, 280, 140, 220)))


def test_domains_have_networks_of_their_own(spark, tmp_path):
    from quirelake.plans.pages import Networks, process_domains
    from quirelake.sources.models import StubLayout

    for k in range(4):
        (tmp_path / f"p{k}.png").write_bytes(bars((400, 600), [(120, 60, 420)]))
    vocab = lambda first: spark.createDataFrame([(i, chr(first + i)) for i in range(1, 16)], "idx int, ch string")
    nets = {"default": Networks(StubLayout(), StubModel(16), vocab(96)), "kramarky": Networks(StubLayout(), StubModel(16), vocab(64))}
    asked = F.get(F.array(F.lit(None), F.lit("default"), F.lit("kramarky"), F.lit("other")), F.substring("page_id", 2, 1).cast("int"))
    got = {r.page_id: r for r in process_domains(read_pages(spark, str(tmp_path)).withColumn("domain", asked), nets, adaptive_levels=False).collect()}
    assert [got[f"p{k}"].status for k in range(4)] == [202, 202, 202, 400] and got["p3"].text is None
    assert got["p0"].text == got["p1"].text == got["p2"].text.lower() != got["p2"].text


def test_resizing_by_area_keeps_means(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (60, 90), dtype=np.uint8)
    assert (crops.area_resize(a, 20, 30) == np.rint(a.reshape(20, 3, 30, 3).mean(axis=(1, 3)))).all()
    assert abs(crops.area_resize(a, 7, 11).mean() - a.mean()) < 1 and crops.area_resize(a[:4, :4], 8, 8).shape == (8, 8)
    color = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    assert all((crops.area_resize(color, 13, 17)[:, :, k] == crops.area_resize(color[:, :, k], 13, 17)).all() for k in range(3))
    for h, w in ((400, 300), (3000, 2000), (900, 5200), (4000, 1499)):
        for ds in (3, 2, 1):
            sizes = spark.createDataFrame([(1, h, w)], "page_id long, h int, w int")
            r = crops.resize_chain(sizes, ds).first()
            assert crops.layout_sizes(h, w, ds)[-1] == (r.hd, r.wd)


def test_command_line_writes_files(spark, tmp_path):
    import json

    from quirelake.__main__ import main, named
    from quirelake.sources.images import png

    a = np.full((400, 600), 255, np.uint8)
    a[80:110, 60:420] = 90
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(png(a))
    (tmp_path / "v.json").write_text(json.dumps({"characters": [chr(200 + i) for i in range(63)]}))
    models = ["--layout", "quirelake.sources.models:StubLayout", "--model", "quirelake.sources.models:StubModel", "--vocab", str(tmp_path / "v.json")]
    assert main([str(tmp_path / "in"), "--out-dir", str(tmp_path / "out"), "--format", "multi", "--no-adaptive", *models]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.alto.xml", "one.txt"]
    assert "<TextLine" in (tmp_path / "out" / "one.alto.xml").read_text() and named("math:pi") > 3


def test_regions_of_maps(spark):
    from quirelake.plans import catalog, views

    rows = catalog.page_regions(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert sorted(by) == list(range(1, 11)) or sorted(by) == list(range(10))
    for page in by.values():
        page.sort(key=lambda r: r.line_idx)
        assert [r.line_idx for r in page] == list(range(len(page)))
        assert [r.region_idx for r in page] == sorted(r.region_idx for r in page)
        assert all(0 <= r.x0 < r.x1 < views.CELL_W for r in page)
        assert all(a.cy <= b.cy for a, b in zip(page, page[1:]) if a.region_idx == b.region_idx)
        # text rows lie at 5, 17, 29, 41 and 53
        assert {round(r.cy) for r in page} == {5, 17, 29, 41, 53}


def test_ctc_queries_take_every_line_and_its_whole_text(spark, tmp_path):
    texts = {3: "a  bb c\n" + "xyz " * 700 + "end", 10: "one", 11: None, 12: "\taab\n   \n é😀é"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = {(r.page_id, r.line_idx): r for r in V.v_line(spark, str(tmp_path)).collect() if r.text.strip(" ")}
    assert {k[0] for k in lines} == {3, 10, 12} and max(len(r.text) for r in lines.values()) > 2000
    # decoding what was encoded gives the text
    assert {(r.page_id, r.line_idx): r.text for r in catalog.ctc_roundtrip(spark, str(tmp_path)).collect()} == {k: r.text for k, r in lines.items()}
    want, boxes = set(), set()
    for k, r in lines.items():
        n = -1
        for m in re.finditer("[^ ]+", r.text[:400]):
            n += 1
            t0, t1 = 2 * m.start(), 2 * m.end() - 1
            # a repeated character ends before its blank, so the last one of the kept text is emitted at its own first frame
            t1 = t1 if m.end() < len(r.text[:400]) else 2 * (m.end() - 1)
            want.add((*k, n, m[0], t0, t1))
            boxes.add((*k, n, math.floor(r.width / 1000 * 2 * t0 + r.hpos)))
    assert {tuple(r) for r in catalog.ctc_words(spark, str(tmp_path)).select("page_id", "line_idx", "word_idx", "word", "t0", "t1").collect()} == want
    assert {(r.page_id, r.line_idx, r.word_idx, r.x) for r in catalog.word_boxes(spark, str(tmp_path)).collect()} == boxes
