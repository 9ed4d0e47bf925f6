"""The registered queries, each a library operator on a derived input, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import strip, strip_suffix, text_features, word_box
from quirelake.operators import adaptive, alto, blocks, crops, ctc, jobs, lines, maps, requests
from quirelake.plans import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(*parts: str, sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name, with its SQL over the derived inputs that it names."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = V.with_views(*parts, then=sql, recursive=recursive) if parts else sql
        return f

    return put


def r6(c) -> F.Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


#: SQL pieces: white space of any script, and a line's stripped text.
_S = r"[\s\x1C-\x1F\x{85}\p{Z}]"
_STRIP = rf"regexp_replace(text, '^{_S}+|{_S}+$', '', 'g')"
_KEPT = f"v_kept AS (SELECT * FROM v_line WHERE {_STRIP} <> '')"


@query(V.V_LINE, _KEPT, sql=rf"""
SELECT d.page_id, regexp_replace(coalesce(body, ''), '{_S}+$', '') || chr(10) AS page_text
FROM (SELECT DISTINCT page_id FROM v_line) d LEFT JOIN (
    SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY region_idx) AS body
    FROM (SELECT page_id, region_idx, string_agg(text, chr(10) ORDER BY line_idx) AS block FROM v_kept GROUP BY ALL) GROUP BY ALL
) p USING (page_id)""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.page_text(V.v_line(spark, sf_dir))


_VOCAB = f"v_vocab AS (SELECT i::INT AS idx, substr('{V.SYMBOLS}', i, 1) AS ch FROM range(1, 64) r(i))"
_BEST = """
v_best AS (
    SELECT line_id, t, (list_position(logits, list_max(logits)) - 1)::INT AS cls,
           1.0::DOUBLE / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS p
    FROM v_frame WHERE t * 2 < 1600
),
v_emit AS (
    SELECT * FROM (SELECT *, lag(cls) OVER (PARTITION BY line_id ORDER BY t) AS before FROM v_best)
    WHERE cls <> 0 AND cls IS DISTINCT FROM before
)"""


def vocab(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(V.SYMBOLS, 1)), "idx int, ch string")


@query(V.V_FRAME, _BEST, _VOCAB, sql="""
SELECT d.line_id, coalesce(text, '') AS text, coalesce(n_chars, 0)::BIGINT AS n_chars
FROM (SELECT DISTINCT line_id FROM v_frame) d
LEFT JOIN (SELECT line_id, string_agg(ch, '' ORDER BY t) AS text, count(*) AS n_chars FROM v_emit JOIN v_vocab ON cls = idx GROUP BY ALL) USING (line_id)""")
def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.decode(V.v_frame(spark, sf_dir), vocab(spark)).select("line_id", "text", "n_chars")


@query(V.V_FRAME, _BEST, sql="""
SELECT d.line_id, round(coalesce(conf, 0.0), 6) AS conf FROM (SELECT DISTINCT line_id FROM v_frame) d
LEFT JOIN (SELECT line_id, avg(p) AS conf FROM v_emit GROUP BY ALL) USING (line_id)""")
def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ctc.decode(V.v_frame(spark, sf_dir), vocab(spark)).select("line_id", "conf"), "conf")


@query(V.V_FRAME, _BEST, _VOCAB, sql="""
SELECT page_id, round_even(coalesce(avg(conf) FILTER (WHERE NOT blank), 0.0), 4) AS mean_conf, (count(*) FILTER (WHERE NOT blank))::BIGINT AS n_lines
FROM (
    SELECT d.line_id // 4 AS page_id, coalesce(conf, 0.0) AS conf, coalesce(trim(text), '') = '' AS blank FROM (SELECT DISTINCT line_id FROM v_frame) d
    LEFT JOIN (SELECT line_id, avg(p) AS conf, string_agg(ch, '' ORDER BY t) AS text FROM v_emit JOIN v_vocab ON cls = idx GROUP BY ALL) USING (line_id)
) GROUP BY ALL""")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ctc.decode(V.v_frame(spark, sf_dir), vocab(spark)).withColumn("page_id", F.floor(F.col("line_id") / 4))
    said = F.trim("text") != ""
    return made.groupBy("page_id").agg(F.bround(F.coalesce(F.avg(F.when(said, F.col("conf"))), F.lit(0.0)), 4).alias("mean_conf"), F.count(F.when(said, 1)).alias("n_lines"))


_CHARS = """
v_ch AS (
    SELECT * FROM (SELECT *, lag(ch) OVER (PARTITION BY line_id ORDER BY t) AS before FROM v_ctc) WHERE ch IS NOT NULL AND ch IS DISTINCT FROM before
)"""


@query(V.V_LINE, V.V_CTC, _CHARS, sql="SELECT page_id, line_idx, string_agg(ch, '' ORDER BY t) AS text FROM v_ch GROUP BY ALL")
def ctc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_ctc(spark, sf_dir).select("page_id", "line_idx", ctc.joined_of(ctc.emitted_of(F.col("frames"))).alias("text"))


_SPANS = """
v_isl AS (
    SELECT *, sum((ch = ' ')::INT) OVER w AS island, lead(t) OVER w AS next_t, coalesce(lead(ch) OVER w = ' ', false) AS next_space
    FROM v_ch WINDOW w AS (PARTITION BY page_id, line_idx ORDER BY t)
),
v_word AS (
    SELECT page_id, line_idx, island, string_agg(ch, '' ORDER BY t) AS word, min(t) AS t0, coalesce(max(CASE WHEN next_space THEN next_t - 1 END), max(t)) AS t1
    FROM v_isl WHERE ch <> ' ' GROUP BY ALL
),
v_span AS (SELECT page_id, line_idx, (row_number() OVER (PARTITION BY page_id, line_idx ORDER BY island) - 1)::INT AS word_idx, word, t0::INT AS t0, t1::INT AS t1 FROM v_word)"""


def spans(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Words of the frames within the recogniser's width, 1,600 at a stride of 2."""
    lines = V.v_ctc(spark, sf_dir).withColumn("kept", F.slice("frames", 1, 800))
    return ctc.words_of(lines.withColumn("chars", ctc.emitted_of(F.col("kept"))), "chars", "page_id", "line_idx", *keep)


@query(V.V_LINE, V.V_CTC, _CHARS.replace("FROM v_ctc)", "FROM v_ctc WHERE t * 2 < 1600)"), _SPANS, sql="SELECT page_id, line_idx, word_idx, word, t0, t1 FROM v_span")
def ctc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


@query(V.V_LINE, V.V_CTC, _CHARS.replace("FROM v_ctc)", "FROM v_ctc WHERE t * 2 < 1600)"), _SPANS, sql="""
SELECT page_id, line_idx, word_idx, word, floor(x1)::INT AS x, floor(y1)::INT AS y, (ceil(x2) - floor(x1))::INT AS w, (ceil(y2) - floor(y1))::INT AS h
FROM (
    SELECT s.*, (l.width / 1000.0::DOUBLE) * (2 * t0)::DOUBLE + hpos::DOUBLE AS x1, (l.width / 1000.0::DOUBLE) * least(2 * (t1 + 1), 1600)::DOUBLE + hpos::DOUBLE AS x2,
           vpos::DOUBLE AS y1, (l.height / 40.0::DOUBLE) * 40.0::DOUBLE + vpos::DOUBLE AS y2
    FROM v_span s JOIN v_line l ON s.page_id = l.page_id AND s.line_idx = l.line_idx
)""")
def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    zero = F.lit(0.0)
    m = F.array(d("width") / 1000.0, zero, d("hpos"), zero, d("height") / 40.0, d("vpos"), zero, zero, F.lit(1.0))
    rows = spans(spark, sf_dir, "hpos", "vpos", "width", "height").withColumn("m", m)
    b = rows.withColumn("b", word_box(F.col("t0"), F.col("t1"), F.lit(1600), F.col("m")))
    return b.select("page_id", "line_idx", "word_idx", "word", "b.x", "b.y", "b.w", "b.h")


@query(V.V_LINE, _KEPT, sql="""
SELECT page_id, region_idx, min(hpos) AS x, min(vpos) AS y, greatest(1, max(hpos + width) - min(hpos)) AS w, greatest(1, max(vpos + height) - min(vpos)) AS h, count(*) AS n_lines
FROM v_kept GROUP BY ALL""")
def block_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_boxes(V.v_line(spark, sf_dir))


@query(V.V_LINE, f"v_s AS (SELECT page_id, line_idx, {_STRIP} AS s FROM v_line)", sql=rf"""
SELECT page_id, line_idx, round(least(length(s), 80) / 80.0::DOUBLE, 6) AS f_len,
       round(least(len(list_filter(string_split_regex(s, '{_S}+'), lambda w: w <> '')), 20) / 20.0::DOUBLE, 6) AS f_words,
       round(len(regexp_extract_all(s, '[\p{{Nd}}²³¹⁰⁴-⁹₀-₉]'))::DOUBLE / greatest(1, length(s)), 6) AS f_digits,
       round(len(regexp_extract_all(s, '\p{{Lu}}'))::DOUBLE / greatest(1, len(regexp_extract_all(s, '\p{{L}}'))), 6) AS f_upper,
       CASE WHEN regexp_full_match(s, '[\p{{Nd}}IVXLCDMivxlcdm.\-–—\s]+') THEN 1.0 ELSE 0.0 END::DOUBLE AS f_numeral,
       CASE WHEN s = '' OR right(s, 1) IN ('.', ':', '!', '?') THEN 1.0 ELSE 0.0 END::DOUBLE AS f_ends
FROM v_s""")
def text_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stripped once, in a projection of its own
    rows = V.v_line(spark, sf_dir).select("page_id", "line_idx", strip(F.coalesce("text", F.lit(""))).alias("s"))
    return rows.select("page_id", "line_idx", *(r6(c).alias(k) for k, c in text_features(F.col("s"), stripped=True).items()))


QUERIES["text_features"] = QUERIES.pop("text_feature_rows")
SQL["text_features"] = SQL.pop("text_feature_rows")

_MEDH = "v_medh AS (SELECT page_id, quantile_cont(greatest(1, height), 0.5) AS medh FROM v_kept GROUP BY ALL)"


@query(V.V_LINE, _KEPT, _MEDH, sql="""
SELECT page_id, line_idx, round((vpos + height / 2) / page_h, 6) AS g_cy, round((hpos + width / 2) / page_w, 6) AS g_cx, round(width / page_w, 6) AS g_w, round(height / medh / 4, 6) AS g_h,
       CASE WHEN vpos + height / 2 < 0.12::DOUBLE * page_h THEN 1.0 ELSE 0.0 END::DOUBLE AS g_top, CASE WHEN vpos + height / 2 > 0.88::DOUBLE * page_h THEN 1.0 ELSE 0.0 END::DOUBLE AS g_bottom,
       round((row_number() OVER w - 1) / greatest(1, count(*) OVER (PARTITION BY page_id, region_idx)), 6) AS g_pos,
       CASE WHEN count(*) OVER (PARTITION BY page_id, region_idx) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS g_single
FROM v_kept JOIN v_medh USING (page_id) WINDOW w AS (PARTITION BY page_id, region_idx ORDER BY line_idx)""")
def geom_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.geometry_features(V.v_line(spark, sf_dir)), "g_cy", "g_cx", "g_w", "g_h", "g_pos")


@query(V.V_LINE, _KEPT, _MEDH, sql="""
SELECT page_id, line_idx, round(greatest(0.0, least(4.0, height / greatest(1, coalesce(lag(height) OVER w, height)))) / 4, 6)::DOUBLE AS c_prev_h,
       round(greatest(0.0, least(4.0, height / greatest(1, coalesce(lead(height) OVER w, height)))) / 4, 6)::DOUBLE AS c_next_h,
       round(greatest(0.0, least(5.0, coalesce((vpos - (lag(vpos) OVER w + lag(height) OVER w)) / medh, 2.0))) / 5, 6)::DOUBLE AS c_gap_above,
       round(greatest(0.0, least(5.0, coalesce((lead(vpos) OVER w - (vpos + height)) / medh, 2.0))) / 5, 6)::DOUBLE AS c_gap_below,
       round(greatest(0.0, least(3.0, width / greatest(1, coalesce(lag(width) OVER w, width)))) / 3, 6)::DOUBLE AS c_prev_w,
       CASE WHEN lag(height) OVER w IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS c_first, CASE WHEN lead(height) OVER w IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS c_last
FROM v_kept JOIN v_medh USING (page_id) WINDOW w AS (PARTITION BY page_id, region_idx ORDER BY line_idx)""")
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.context_features(V.v_line(spark, sf_dir)), "c_prev_h", "c_next_h", "c_gap_above", "c_gap_below", "c_prev_w")


@query(V.V_FRAME, sql="""
SELECT line_id, t, best, round(p, 6) AS p, CASE WHEN best = 'page_number' AND p < 0.5 OR best IN ('heading', 'header', 'footer') AND p < 0.6 THEN 'body' ELSE best END AS role
FROM (
    SELECT line_id, t, ['body', 'heading', 'header', 'footer', 'page_number'][list_position(s, list_max(s))] AS best, 1.0::DOUBLE / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS p
    FROM (SELECT line_id, t, list_transform(logits[1:5], lambda x: x * 12.0::DOUBLE) AS s FROM v_frame)
)""")
def role_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = V.v_frame(spark, sf_dir).select("line_id", "t", F.transform(F.slice("logits", 1, 5), lambda x: x * 12.0).alias("scores"))
    return rounded(blocks.gate_roles(scored).select("line_id", "t", "best", "p", "role"), "p")


# lines of pages, with regions by bands of page height
REGION_H = 325
_RBOX = f"v_rbox AS (SELECT *, floor(cy / {REGION_H})::INT AS region_idx FROM v_box)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_box(spark, sf_dir).withColumn("region_idx", F.floor(F.col("cy") / REGION_H).cast("int"))


def pages_of(rows: DataFrame) -> DataFrame:
    return rows.select("page_id").distinct()


@query(V.V_BOX, sql='SELECT page_id, quantile_cont("asc" + "desc", 0.5) AS line_height FROM v_box GROUP BY ALL')
def line_height_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir)
    return lines.line_height_median(pages_of(rows), rows)


@query(V.V_BOX, _RBOX, sql="""
SELECT d.page_id, round(coalesce(r, 1.0), 6) AS pitch_ratio FROM (SELECT DISTINCT page_id FROM v_box) d LEFT JOIN (
    SELECT page_id, min(pitch / greatest(1.0, h)) AS r FROM (
        SELECT page_id, region_idx, count(*) AS n, max(x1) - min(x0) AS extent, quantile_cont(step, 0.5) AS pitch, quantile_cont("asc" + "desc", 0.5) AS h
        FROM (SELECT *, cy - lag(cy) OVER (PARTITION BY page_id, region_idx ORDER BY cy, seq) AS step FROM v_rbox) GROUP BY ALL
    ) WHERE n >= 5 AND extent >= 400 GROUP BY ALL
) USING (page_id)""")
def pitch_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir)
    return rounded(lines.pitch_ratio(pages_of(rows), rows), "pitch_ratio")


@query(V.V_BOX, sql="""
SELECT page_id, round(CASE WHEN n >= 20 THEN f ELSE 0.0 END, 6) AS wide_frac FROM (
    SELECT page_id, count(*) AS n, avg(CASE WHEN w > 1.8::DOUBLE * med AND w > 0.45::DOUBLE * 400 THEN 1.0 ELSE 0.0 END) AS f
    FROM (SELECT page_id, x1 - x0 AS w FROM v_box) JOIN (SELECT page_id, quantile_cont(x1 - x0, 0.5) AS med FROM v_box GROUP BY ALL) USING (page_id) GROUP BY ALL
)""")
def wide_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir)
    return rounded(lines.wide_fraction(pages_of(rows), rows, page_w=400.0), "wide_frac")


@query(V.V_BOX, _RBOX, sql="""
SELECT page_id, seq, round(scale, 6) AS scale, round("asc" * scale, 6) AS asc_new, round("desc" * scale, 6) AS desc_new FROM (
    SELECT b.*, CASE WHEN n >= 3 AND "asc" > 0 AND "asc" < 0.7::DOUBLE * pitch THEN 0.7::DOUBLE * pitch / "asc" ELSE 1.0 END AS scale
    FROM v_rbox b JOIN (
        SELECT page_id, region_idx, count(*) AS n, quantile_cont(step, 0.5) AS pitch
        FROM (SELECT *, cy - lag(cy) OVER (PARTITION BY page_id, region_idx ORDER BY cy, seq) AS step FROM v_rbox) GROUP BY ALL
    ) USING (page_id, region_idx)
)""")
def pitch_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.calibrate_pitch(boxes(spark, sf_dir))
    return made.select("page_id", "seq", r6("scale").alias("scale"), r6("asc").alias("asc_new"), r6("desc").alias("desc_new"))


_SEEN = """
v_try AS (SELECT *, lineh < 8 OR pitch < 0.85::DOUBLE OR wide > 0.08::DOUBLE AS skip, first_value(n_lines) OVER (PARTITION BY page_id ORDER BY ds DESC) AS first_lines FROM v_level),
v_rec AS (SELECT * FROM v_try WHERE NOT skip OR ds = 1),
v_seen AS (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ds DESC) AS k FROM (
        SELECT *, coalesce(sum((conf >= 0.9::DOUBLE)::INT) OVER (PARTITION BY page_id ORDER BY ds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM v_rec
    ) WHERE over = 0
)"""
_PICK = """
SELECT page_id, CASE WHEN ok THEN c.ds ELSE b.ds END AS ds, CASE WHEN ok THEN c.conf ELSE b.conf END AS conf{more} FROM (
    SELECT *, c.ds <> b.ds AND c.conf > b.conf + 0.02::DOUBLE AND (b.pitch < 0.85::DOUBLE OR b.conf < 0.6::DOUBLE OR b.lineh < 8 OR c.n_lines <= 1.4::DOUBLE * greatest(1, first_lines)) AS ok
    FROM (
        SELECT page_id, first(s ORDER BY s.k) AS b, first(s ORDER BY s.conf DESC, s.k) AS c, count(*) AS n, first(s.first_lines) AS first_lines{inner} FROM {source} s GROUP BY page_id
    )
)"""


@query(V.V_LEVEL, _SEEN, sql=_PICK.format(more=", n::INT AS n_seen, ok AS accepted", inner="", source="v_seen"))
def adaptive_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adaptive.choose(V.v_level(spark, sf_dir))
    return out.withColumn("ds", F.col("ds").cast("int"))


@query(V.V_LEVEL, "v_all AS (SELECT *, 3 - ds AS k, first_value(n_lines) OVER (PARTITION BY page_id ORDER BY ds DESC) AS first_lines FROM v_level)", sql="""
SELECT page_id, CASE WHEN narrow THEN w.ds WHEN ok THEN c.ds ELSE b.ds END AS ds, CASE WHEN narrow THEN w.conf WHEN ok THEN c.conf ELSE b.conf END AS conf FROM (
    SELECT *, c.ds <> b.ds AND c.conf > b.conf + 0.02::DOUBLE AND (b.pitch < 0.85::DOUBLE OR b.conf < 0.6::DOUBLE OR b.lineh < 8 OR c.n_lines <= 1.4::DOUBLE * greatest(1, b.n_lines)) AS ok,
           b.wide > 0.08::DOUBLE AND w.ds <> b.ds AND w.wide < b.wide - 0.04::DOUBLE AND w.conf >= b.conf - 0.01::DOUBLE AS narrow
    FROM (SELECT page_id, first(s ORDER BY s.k) AS b, first(s ORDER BY s.conf DESC, s.k) AS c, first(s ORDER BY s.wide, s.conf DESC, s.k) AS w FROM v_all s GROUP BY page_id)
)""")
def adaptive_choose_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.choose_wide(V.v_level(spark, sf_dir)).withColumn("ds", F.col("ds").cast("int"))


@query(V.V_CELL, sql="SELECT page_id, y, x, round(max(base) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS top FROM v_cell")
def vertical_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.cells(maps.vertical_max(V.v_map(spark, sf_dir), "base", "top"), "top"), "top")


_SMOOTH = """
v_row AS (SELECT *, coalesce(lag(base) OVER w, base) + base + coalesce(lead(base) OVER w, base) AS r FROM v_cell WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
v_smooth AS (SELECT *, (coalesce(lag(r) OVER w, r) + r + coalesce(lead(r) OVER w, r)) / 9 AS smooth FROM v_row WINDOW w AS (PARTITION BY page_id, x ORDER BY y))"""
_MASK = """
v_top AS (SELECT * REPLACE (max(asc_h) OVER k AS asc_h, max(desc_h) OVER k AS desc_h), max(smooth) OVER k AS top FROM v_smooth WINDOW k AS (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
v_mask AS (SELECT * FROM v_top WHERE CASE WHEN smooth >= top - 1e-6::DOUBLE THEN smooth ELSE 0.0 END - endp > 0.25::DOUBLE)"""


@query(V.V_CELL, _SMOOTH, sql="SELECT page_id, y, x, round(smooth, 6) AS smooth FROM v_smooth")
def smooth3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.cells(maps.smooth3x3(V.v_map(spark, sf_dir), "base", "smooth"), "smooth"), "smooth")


@query(V.V_CELL, _SMOOTH, _MASK, sql="SELECT page_id, y, x FROM v_mask")
def nms_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.peak_mask(V.v_map(spark, sf_dir))


@query(V.V_CELL, _SMOOTH, _MASK, """
v_near AS (SELECT a.page_id, a.y * 1000 + a.x AS a, b.y * 1000 + b.x AS b FROM v_mask a JOIN v_mask b ON a.page_id = b.page_id AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3),
v_reach AS (SELECT page_id, a AS node, a AS seen FROM v_near UNION SELECT r.page_id, r.node, n.b FROM v_reach r JOIN v_near n ON n.page_id = r.page_id AND n.a = r.seen),
v_comp AS (SELECT page_id, node, min(seen) AS root FROM v_reach GROUP BY ALL),
v_pix AS (SELECT m.*, root FROM v_mask m JOIN v_comp c ON c.page_id = m.page_id AND c.node = m.y * 1000 + m.x)""", recursive=True, sql="""
SELECT page_id, min_y, min_x, n_pixels, round(asc_h, 6) AS asc_h, round(desc_h, 6) AS desc_h,
       string_agg(CASE k WHEN 0 THEN greatest(0, px - 2) WHEN n - 1 THEN least(95, px + 2) ELSE px END || ' ' || py, ',' ORDER BY k) AS baseline
FROM (
    SELECT c.*, k, n, xs[trunc(k * ((len(xs) - 1)::DOUBLE / (n - 1)))::INT + 1] AS px, yy[trunc(k * ((len(xs) - 1)::DOUBLE / (n - 1)))::INT + 1] AS py
    FROM (
        SELECT page_id, root, (root // 1000)::INT AS min_y, (root % 1000)::INT AS min_x, count(*) AS n_pixels, quantile_cont(greatest(0.0, asc_h), 0.5) AS asc_h, quantile_cont(greatest(0.0, desc_h), 0.5) AS desc_h FROM v_pix GROUP BY ALL
    ) c JOIN (
        SELECT page_id, root, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS yy, greatest(2, least(10, count(*) // 10)) AS n
        FROM (SELECT page_id, root, x, round_even(quantile_cont(y, 0.5), 0)::INT AS y FROM v_pix GROUP BY ALL) GROUP BY ALL
    ) p USING (page_id, root), range(n) AS r(k)
    WHERE n_pixels > 5 AND len(xs) >= 2 AND xs[len(xs)] - xs[1] >= 5
) GROUP BY ALL""")
def line_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maps.found_lines(V.v_map(spark, sf_dir))
    points = F.array_join(F.transform("baseline", lambda p: F.concat_ws(" ", p["x"].cast("int"), p["y"].cast("int"))), ",")
    return found.select("page_id", "min_y", "min_x", "n_pixels", r6("asc").alias("asc_h"), r6("desc").alias("desc_h"), points.alias("baseline"))


@query(V.V_CELL, "v_sum AS (SELECT page_id, x, round(sum(sep), 9) AS s FROM v_cell GROUP BY ALL)", sql="""
SELECT page_id, gutter, round(peak, 6) AS peak, round(med, 6) AS med, peak >= 0.12::DOUBLE * 64 AND peak >= 4 * med AS strong FROM (
    SELECT page_id, first(x ORDER BY s DESC, x) FILTER (WHERE x >= 24 AND x < 72) AS gutter, max(s) FILTER (WHERE x >= 24 AND x < 72) AS peak, quantile_cont(s, 0.5) + 1e-6::DOUBLE AS med FROM v_sum GROUP BY ALL
)""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(maps.column_profile(V.v_map(spark, sf_dir)), "peak", "med")


@query(V.V_CELL, """
v_gray AS (SELECT page_id, y, x, CASE WHEN x BETWEEN 44 AND 50 AND page_id % 2 = 0 THEN 250 ELSE 255 - (base * 300)::INT END AS gray FROM v_cell),
v_ink AS (SELECT page_id, x, avg((gray < 128)::INT) AS ink FROM v_gray GROUP BY ALL),
v_sm AS (SELECT page_id, x, sum(ink) OVER (PARTITION BY page_id ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS v FROM v_ink)""", sql="""
SELECT page_id, min(v) FILTER (WHERE x >= 40 AND x < 55) < 0.25::DOUBLE * (quantile_cont(v, 0.5) FILTER (WHERE x >= 4 AND x < 91) + 1e-6::DOUBLE) AS gutter FROM v_sm GROUP BY ALL""")
def gutter_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.expr(f"transform(base, (b, i) -> CASE WHEN i % {V.CELL_W} BETWEEN 44 AND 50 AND page_id % 2 = 0 THEN 250D ELSE 255D - cast(round(b * 300) as int) END)")
    return maps.central_gutter(V.v_map(spark, sf_dir).withColumn("gray", gray))


_MERGE = """
v_k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cy, x0, seq) AS k, greatest(1.0, "asc" + "desc") AS h FROM v_box),
v_pair AS (
    SELECT a.page_id, a.seq AS a_seq, b.seq AS b_seq, a.k AS a_k, b.k AS b_k, a.cy AS a_cy, b.cy AS b_cy, a.h AS a_h, b.h AS b_h, 0.5::DOUBLE * (a.h + b.h) AS h,
           greatest(a.x0, b.x0) - CASE WHEN a.x0 <= b.x0 THEN a.x1 ELSE b.x1 END AS gap
    FROM v_k a JOIN v_k b ON a.page_id = b.page_id AND a.k < b.k
),
v_stop AS (SELECT page_id, a_seq, min(b_k) AS stop FROM v_pair WHERE b_cy - a_cy > greatest(a_h, b_h) GROUP BY ALL),
v_cand AS (
    SELECT p.page_id, p.a_seq, p.b_seq FROM v_pair p LEFT JOIN v_stop s USING (page_id, a_seq)
    WHERE b_cy - a_cy <= 0.6::DOUBLE * h AND gap >= -0.5::DOUBLE * h AND gap <= 1.5::DOUBLE * h AND (stop IS NULL OR b_k < stop)
)"""


@query(V.V_BOX, _MERGE, sql="SELECT page_id, a_seq, b_seq FROM v_cand")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.merge_candidates(V.v_box(spark, sf_dir))


_CLOSE = """
v_both AS (SELECT page_id, a_seq AS a, b_seq AS b FROM v_cand UNION ALL SELECT page_id, b_seq, a_seq FROM v_cand),
v_reach AS (SELECT page_id, seq AS node, seq AS seen FROM v_box UNION SELECT r.page_id, r.node, n.b FROM v_reach r JOIN v_both n ON n.page_id = r.page_id AND n.a = r.seen),
v_group AS (SELECT page_id, node AS seq, min(seen) AS group_seq FROM v_reach GROUP BY ALL)"""


@query(V.V_BOX, _MERGE, _CLOSE, recursive=True, sql="""
SELECT page_id, group_seq, count(*) AS n, min(x0) AS x0, max(x1) AS x1, round(avg(cy), 6) AS cy, round(avg("asc"), 6) AS "asc", round(avg("desc"), 6) AS "desc"
FROM v_box JOIN v_group USING (page_id, seq) GROUP BY ALL""")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.merge_lines(V.v_box(spark, sf_dir)), "cy", "asc", "desc")


_REGION = """
v_med AS (SELECT page_id, 3.0::DOUBLE * quantile_cont(greatest(1.0, "asc" + "desc"), 0.5) AS reach FROM v_box GROUP BY ALL),
v_cand AS (
    SELECT a.page_id, a.seq AS a_seq, b.seq AS b_seq FROM v_box a JOIN v_box b ON a.page_id = b.page_id AND (a.cy < b.cy OR a.cy = b.cy AND a.seq < b.seq) JOIN v_med m ON m.page_id = a.page_id
    WHERE b.cy - a.cy <= reach AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 5
)"""


@query(V.V_BOX, _REGION, _CLOSE, recursive=True, sql="SELECT page_id, seq, group_seq FROM v_group")
def region_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir)
    return lines.closure(rows, lines.region_candidates(rows))


@query(V.V_BOX, """
v_c AS (SELECT page_id, floor(cy / 325)::INT AS band, seq, x0, x1, (x0 + x1) / 2 AS centre FROM v_box),
v_r AS (SELECT page_id, band, 0.5::DOUBLE * greatest(1.0, list_sort(list(x1 - x0))[count(*) // 2 + 1]) AS reach FROM v_c GROUP BY ALL)""", sql="""
SELECT page_id, band, seq, (sum(jump) OVER (PARTITION BY page_id, band ORDER BY centre, seq ROWS UNBOUNDED PRECEDING))::INT AS col FROM (
    SELECT c.*, coalesce((centre - lag(centre) OVER (PARTITION BY c.page_id, c.band ORDER BY centre, seq) > reach)::INT, 0) AS jump FROM v_c c JOIN v_r r ON c.page_id = r.page_id AND c.band = r.band
)""")
def column_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.column_islands(boxes(spark, sf_dir).withColumn("band", F.col("region_idx")))


# boxes one by one by their tops: n is how many of a page's are placed, tops and feet the extents of its bands so far
_BANDS = """
v_top AS (SELECT page_id, seq, x0, x1, cy - "asc" AS y0, cy + "desc" AS y1, row_number() OVER (PARTITION BY page_id ORDER BY cy - "asc", seq) AS k FROM v_box),
v_place AS (
    SELECT page_id, k, 1 AS band, [y0] AS tops, [y1] AS feet FROM v_top WHERE k = 1
    UNION ALL
    SELECT page_id, k, band,
           CASE WHEN band > len(tops) THEN list_append(tops, y0) ELSE list_transform(tops, lambda t, i: CASE WHEN i = band THEN least(t, y0) ELSE t END) END,
           CASE WHEN band > len(feet) THEN list_append(feet, y1) ELSE list_transform(feet, lambda t, i: CASE WHEN i = band THEN greatest(t, y1) ELSE t END) END
    FROM (
        SELECT b.page_id, b.k, b.y0, b.y1, tops, feet, coalesce(list_position(list_transform(tops, lambda t, i: least(b.y1, feet[i]) - greatest(b.y0, t) > 0.5::DOUBLE * greatest(1, least(b.y1 - b.y0, feet[i] - t))), true), len(tops) + 1)::INT AS band
        FROM v_place p JOIN v_top b ON b.page_id = p.page_id AND b.k = p.k + 1
    )
),
v_band AS (SELECT page_id, k, band - 1 AS band, seq, x0, x1, y0, (x0 + x1) / 2 AS centre FROM v_place JOIN v_top USING (page_id, k)),
v_r AS (SELECT page_id, band, 0.5::DOUBLE * greatest(1.0, list_sort(list(x1 - x0))[count(*) // 2 + 1]) AS reach FROM v_band GROUP BY ALL),
v_col AS (
    SELECT page_id, band, seq, k, y0, (sum(jump) OVER (PARTITION BY page_id, band ORDER BY centre, k ROWS UNBOUNDED PRECEDING))::INT AS col FROM (
        SELECT c.*, coalesce((centre - lag(centre) OVER (PARTITION BY c.page_id, c.band ORDER BY centre, k) > reach)::INT, 0) AS jump FROM v_band c JOIN v_r r ON c.page_id = r.page_id AND c.band = r.band
    )
)"""


@query(V.V_BOX, _BANDS, recursive=True, sql="SELECT page_id, seq, band, col, (row_number() OVER (PARTITION BY page_id ORDER BY band, col, y0, k) - 1)::INT AS read_pos FROM v_col")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir)
    return lines.reading_order(rows.withColumn("y0", F.col("cy") - F.col("asc")).withColumn("y1", F.col("cy") + F.col("desc")))


@query(V.V_BOX, """
v_n AS (SELECT page_id, count(*) AS n, max(x1) - min(x0) AS width FROM v_box GROUP BY ALL),
v_side AS (
    SELECT b.*, n, width, CASE WHEN x1 <= g + 0.02::DOUBLE * width THEN 'left' WHEN x0 >= g - 0.02::DOUBLE * width THEN 'right' ELSE 'bridge' END AS side
    FROM (SELECT *, CASE WHEN page_id % 3 <> 2 THEN (300 + page_id % 400)::DOUBLE END AS g FROM v_box) b JOIN v_n USING (page_id)
),
v_t AS (SELECT page_id, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r, count(*) FILTER (WHERE side = 'bridge') AS b FROM v_side GROUP BY ALL)""", sql="""
SELECT page_id, seq, CASE WHEN g IS NOT NULL AND n >= 6 AND width >= 0.55::DOUBLE * 1100 AND l >= 3 AND r >= 3 AND b <= 0.25::DOUBLE * n THEN side ELSE 'whole' END AS side FROM v_side JOIN v_t USING (page_id)""")
def split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir)
    gutters = pages_of(rows).where("page_id % 3 <> 2").withColumn("gutter", (F.lit(300) + F.col("page_id") % 400).cast("double"))
    return lines.split_columns(rows, gutters, page_w=1100.0)


# page sizes by formula: heights 400..4399, widths 300..5299
_SIZE = "v_size AS (SELECT page_id, (400 + (length * 37) % 4000)::INT AS h, (300 + (length * 53) % 5000)::INT AS w FROM v_upload)"
_CHAIN = """
SELECT page_id, h, w, hd, wd, h / hd AS img_scale, (32 - hd % 32) % 32 AS pad_h, (32 - wd % 32) % 32 AS pad_w FROM (
    SELECT *, CASE WHEN greatest(h2, w2) > 1536 THEN greatest(1, trunc(h2 * (1536.0::DOUBLE / greatest(h2, w2)))::INT) ELSE h2 END AS hd,
           CASE WHEN greatest(h2, w2) > 1536 THEN greatest(1, trunc(w2 * (1536.0::DOUBLE / greatest(h2, w2)))::INT) ELSE w2 END AS wd
    FROM (
        SELECT *, greatest(1, h1 // {ds}) AS h2, greatest(1, w1 // {ds}) AS w2
        FROM (SELECT *, CASE WHEN w > 1500 THEN greatest(1, trunc(h * (1500.0::DOUBLE / w))::INT) ELSE h END AS h1, least(w, 1500) AS w1 FROM {source})
    )
)"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_upload(spark, sf_dir).select("page_id", (F.lit(400) + (F.col("length") * 37) % 4000).cast("int").alias("h"), (F.lit(300) + (F.col("length") * 53) % 5000).cast("int").alias("w"))


@query(V.V_UPLOAD, _SIZE, sql="SELECT page_id, hd, wd, round(img_scale, 6) AS img_scale, pad_h, pad_w FROM (" + _CHAIN.format(ds=3, source="v_size") + ")")
def resize_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.resize_chain(sizes(spark, sf_dir)).select("page_id", "hd", "wd", r6("img_scale").alias("img_scale"), "pad_h", "pad_w")


@query(V.V_UPLOAD, _SIZE, "v_spread AS (SELECT * FROM v_size WHERE w > 1.2::DOUBLE * h)", "v_half AS (SELECT page_id, 0 AS side, h, w // 2 AS w FROM v_spread UNION ALL SELECT page_id, 1, h, w - w // 2 FROM v_spread)",
       f"v_whole AS ({_CHAIN.format(ds=3, source='v_spread')})", f"v_part AS (SELECT c.page_id, s.side, c.hd, c.wd FROM (SELECT DISTINCT * FROM ({_CHAIN.format(ds=3, source='v_half')})) c JOIN v_half s ON s.page_id = c.page_id AND s.w = c.w)", sql="""
SELECT p.page_id, p.side, round(w.wd / 2 / p.wd, 6) AS sx, round(w.hd / p.hd, 6) AS sy, CASE WHEN p.side = 1 THEN w.wd / 2 ELSE 0.0 END::DOUBLE AS x_off FROM v_part p JOIN v_whole w USING (page_id)""")  # fmt: skip
def spread_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    spreads = sizes(spark, sf_dir).where(F.col("w") > crops.SPREAD * F.col("h"))
    return rounded(crops.spread_frame(spreads), "sx", "sy")


# three points a line, on a slant by its number
_PTS = """
v_pt AS (SELECT page_id, seq, i, x0 + (x1 - x0) * i / 2.0::DOUBLE AS x, cy + (i * (seq % 7 - 3))::DOUBLE AS y, "asc" AS a, "desc" AS d FROM v_box, range(3) r(i)),
v_fit AS (
    SELECT page_id, seq, 0.5::DOUBLE * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS th, avg(x) AS cx, avg(y) AS cy, greatest(3.0, first(a)) AS up, greatest(2.0, first(d)) AS down,
           greatest(1, trunc(sqrt(pow(max(x) - min(x), 2) + pow(arg_max(y, i) - arg_min(y, i), 2)))::INT) AS dst_w
    FROM v_pt GROUP BY ALL
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.select("page_id", "seq", "i", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / F.lit(2.0)).alias("x"), (F.col("cy") + (F.col("i") * (F.col("seq") % 7 - 3)).cast("double")).alias("y"), "asc", "desc")


@query(V.V_BOX, _PTS, sql="""
SELECT page_id, seq, dst_w, dst_h, greatest(1, trunc(dst_w * (40.0::DOUBLE / dst_h))::INT) AS crop_w,
       round(cos(th) * dst_h / 40, 4) AS m0, round(-sin(th) * (up + down) / 40, 4) + 0.0 AS m1, round(cx - dst_w / 2 * cos(th) + up * sin(th), 4) AS m2, round(cy - dst_w / 2 * sin(th) - up * cos(th), 4) AS m5
FROM (SELECT *, round_even(up + down, 0)::INT AS dst_h FROM v_fit) WHERE dst_h >= 2 AND dst_w >= 2""")
def crop_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = crops.crop_affine(points(spark, sf_dir), "page_id", "seq")
    return made.select("page_id", "seq", "dst_w", "dst_h", "crop_w", *((F.round(F.get("m", F.lit(i)), 4) + F.lit(0.0)).alias(f"m{i}") for i in (0, 1, 2, 5)))


@query(V.V_BOX, _PTS, """
v_ang AS (SELECT *, pi() / 2 + atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS own, pi() / 2 + atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS before FROM v_pt WINDOW w AS (PARTITION BY page_id, seq ORDER BY i)),
v_out AS (
    SELECT page_id, seq, i AS k, x - cos(coalesce(own, before)) * greatest(1.0, a) AS px, y - sin(coalesce(own, before)) * greatest(1.0, a) AS py FROM v_ang
    UNION ALL SELECT page_id, seq, 5 - i, x + cos(coalesce(own, before)) * greatest(1.0, d), y + sin(coalesce(own, before)) * greatest(1.0, d) FROM v_ang
)""", sql="SELECT page_id, seq, string_agg(round_even(px, 0)::INT || ' ' || round_even(py, 0)::INT, ',' ORDER BY k) AS polygon FROM v_out GROUP BY ALL")
def baseline_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = points(spark, sf_dir).groupBy("page_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("b"), F.first("asc").alias("asc"), F.first("desc").alias("desc"))
    poly = crops.baseline_polygon(F.col("b"), F.col("asc"), F.col("desc"))
    return line.select("page_id", "seq", F.array_join(F.transform(poly, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",").alias("polygon"))


_ESC = "replace(replace(replace(replace(replace(regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(9), '&#9;')"
_WORDS = rf"""
v_al AS (
    SELECT *, {_STRIP} AS s, CASE WHEN line_idx = 9999 THEN 'page_number' WHEN pos = 0 THEN 'heading' ELSE 'body' END AS role,
           dense_rank() OVER (PARTITION BY page_id ORDER BY region_idx) - 1 AS bi, row_number() OVER (PARTITION BY page_id, region_idx ORDER BY line_idx) - 1 AS li FROM v_kept
),
v_aw0 AS (SELECT page_id, bi, li, line_idx, hpos, vpos, width, height, unnest(range(1, len(ws) + 1)) AS i, ws FROM (SELECT *, list_filter(string_split(s, ' '), lambda w: w <> '') AS ws FROM v_al)),
v_aw1 AS (SELECT * EXCLUDE ws, ws[i] AS word, length(ws[i]) AS n FROM v_aw0),
v_aw2 AS (SELECT *, sum(n + 1) OVER k - n - 1 AS ahead, width / greatest(1, sum(n + 1) OVER (PARTITION BY page_id, line_idx) - 1) AS unit FROM v_aw1 WINDOW k AS (PARTITION BY page_id, line_idx ORDER BY i ROWS UNBOUNDED PRECEDING)),
v_aws AS (
    SELECT page_id, line_idx, string_agg('            <String ID="word_' || bi || '_' || li || '_' || (i - 1) || '" CONTENT="' || {_ESC.format(t="word")} || '" HPOS="' || greatest(0, hpos + floor(ahead * unit)::INT) || '" VPOS="' || greatest(0, vpos) || '" WIDTH="' || greatest(1, ceil(n * unit)::INT) || '" HEIGHT="' || greatest(1, height) || '"/>' || chr(10), '            <SP/>' || chr(10) ORDER BY i) AS inner_xml
    FROM v_aw2 GROUP BY ALL
),
v_axl AS (
    SELECT l.*, '          <TextLine ID="line_' || bi || '_' || li || '" HPOS="' || hpos || '" VPOS="' || vpos || '" WIDTH="' || width || '" HEIGHT="' || height || '"' || CASE WHEN role <> 'body' THEN ' TAGREFS="ROLE_' || role || '"' ELSE '' END || CASE WHEN inner_xml IS NULL THEN '/>' || chr(10) ELSE '>' || chr(10) || inner_xml || '          </TextLine>' || chr(10) END AS xml
    FROM v_al l LEFT JOIN v_aws USING (page_id, line_idx)
),
v_axb AS (
    SELECT page_id, bi, '        <TextBlock ID="block_' || bi || '" HPOS="' || min(hpos) || '" VPOS="' || min(vpos) || '" WIDTH="' || greatest(1, max(hpos + width) - min(hpos)) || '" HEIGHT="' || greatest(1, max(vpos + height) - min(vpos)) || '">' || chr(10) || string_agg(xml, '' ORDER BY li) || '        </TextBlock>' || chr(10) AS block
    FROM v_axl GROUP BY page_id, bi
),
v_axp AS (SELECT page_id, string_agg(block, '' ORDER BY bi) AS blocks FROM v_axb GROUP BY ALL),
v_axt AS (SELECT page_id, '  <Tags>' || chr(10) || string_agg('    <StructureTag ID="ROLE_' || role || '" LABEL="' || role || '"/>' || chr(10), '' ORDER BY first_at) || '  </Tags>' || chr(10) AS tags FROM (SELECT page_id, role, min(bi * 100000 + li) AS first_at FROM v_al WHERE role <> 'body' GROUP BY ALL) GROUP BY ALL)"""

#: What each document starts with, written out: the namespaces of the format's fourth version, a step for the layout and one for the text.
_ALTO_HEAD = """<?xml version="1.0" ?>
<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://www.loc.gov/standards/alto/ns-v4# http://www.loc.gov/standards/alto/v4/alto-4-4.xsd">
  <Description>
    <MeasurementUnit>pixel</MeasurementUnit>
    <OCRProcessing ID="IdLayout">
      <ocrProcessingStep>
        <processingDateTime>1970-01-01T00:00:00Z</processingDateTime>
        <processingStepDescription>layout</processingStepDescription>
        <processingSoftware>
          <softwareCreator>quirelake</softwareCreator>
          <softwareName>layout</softwareName>
        </processingSoftware>
      </ocrProcessingStep>
    </OCRProcessing>
    <OCRProcessing ID="IdRecognition">
      <ocrProcessingStep>
        <processingDateTime>1970-01-01T00:00:00Z</processingDateTime>
        <processingStepDescription>recognition</processingStepDescription>
        <processingSoftware>
          <softwareCreator>quirelake</softwareCreator>
          <softwareName>recogniser</softwareName>
        </processingSoftware>
      </ocrProcessingStep>
    </OCRProcessing>
  </Description>
"""


@query(V.V_LINE, _KEPT, _WORDS, sql=f"""
SELECT d.page_id, '{_ALTO_HEAD}' || coalesce(tags, '') || '  <Layout>' || chr(10) || '    <Page ID="page_' || d.page_id || '" WIDTH="' || page_w || '" HEIGHT="' || page_h || '" PHYSICAL_IMG_NR="1">' || chr(10)
       || '      <PrintSpace HPOS="0" VPOS="0" WIDTH="' || page_w || '" HEIGHT="' || page_h || '"' || CASE WHEN blocks IS NULL THEN '/>' || chr(10) ELSE '>' || chr(10) || blocks || '      </PrintSpace>' || chr(10) END || '    </Page>' || chr(10) || '  </Layout>' || chr(10) || '</alto>' || chr(10) AS alto
FROM (SELECT DISTINCT page_id, page_w, page_h FROM v_line) d LEFT JOIN v_axp USING (page_id) LEFT JOIN v_axt USING (page_id)""")
def alto_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("line_idx") == 9999, "page_number").when(F.col("pos") == 0, "heading").otherwise("body")
    rows = V.v_line(spark, sf_dir).withColumn("role", role)
    return alto.to_alto(alto.with_shared_words(rows))


@query(V.V_UPLOAD, sql="SELECT page_id, name, length, CASE WHEN length > 4096 THEN 413 ELSE 202 END AS status FROM v_upload")
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.v_upload(spark, sf_dir).withColumn("status", requests.upload_status(F.col("length"), 4096))


@query(V.V_UPLOAD, "v_req AS (SELECT page_id, [NULL, '', 'default', 'kramarky', 'other'][(page_id % 5 + 1)::INT] AS domain, [NULL, 'alto', 'txt', 'multi', 'pdf', '', 'alto'][(page_id % 7 + 1)::INT] AS fmt FROM v_upload)", sql="""
SELECT page_id, CASE WHEN domain = 'kramarky' THEN domain END AS model, CASE WHEN coalesce(fmt, '') = '' THEN 'alto' WHEN fmt = 'pdf' THEN NULL ELSE fmt END AS fmt_used,
       CASE WHEN domain = 'other' OR fmt = 'pdf' THEN 400 ELSE 202 END AS status, CASE WHEN domain = 'other' THEN 'unknown domain: other' WHEN fmt = 'pdf' THEN 'unknown format: pdf' END AS error
FROM v_req""")
def request_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, m: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("page_id") % m).cast("int"))
    rows = V.v_upload(spark, sf_dir).select("page_id", pick([None, "", "default", "kramarky", "other"], 5).alias("domain"), pick([None, "alto", "txt", "multi", "pdf", "", "alto"], 7).alias("fmt"))
    return requests.validated(rows).select("page_id", "model", "fmt_used", "status", "error")


@query(V.V_UPLOAD, r"""
v_name AS (SELECT page_id, name || ['.jpg', '.PNG', '.tiff', '.gif'][(page_id % 4 + 1)::INT] AS path, ['alto', 'txt', 'multi'][(page_id % 3 + 1)::INT] AS fmt FROM v_upload),
v_stem AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext FROM v_name)""", sql="""
SELECT page_id, path, ext IN ('jpg', 'jpeg', 'png', 'tif', 'tiff') AS is_image, stem || CASE fmt WHEN 'txt' THEN '.txt' WHEN 'multi' THEN '' ELSE '.alto.xml' END AS result FROM v_stem""")
def suffix_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, m: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % m).cast("int"))
    rows = V.v_upload(spark, sf_dir).select("page_id", F.concat("name", pick([".jpg", ".PNG", ".tiff", ".gif"], 4)).alias("path"), pick(["alto", "txt", "multi"], 3).alias("fmt"))
    return rows.select("page_id", "path", requests.is_image(F.col("path")).alias("is_image"), requests.result_name(F.col("path"), F.col("fmt")).alias("result"))


@query(V.V_UPLOAD, "v_active AS (SELECT count(*) FILTER (WHERE status IN ('queued', 'running')) AS n FROM (SELECT job_id, arg_max(status, ts) AS status FROM v_job GROUP BY ALL))", sql="")
def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = jobs.latest(V.v_job(spark, sf_dir))
    active = jobs.capacity(table, 0).first().n_active
    asked = V.v_upload(spark, sf_dir).select(F.col("page_id").alias("request_id"), (F.col("page_id") * 7919 % 1009).alias("at"))
    return jobs.admitted(asked, active, active + 40)


SQL["job_admission"] = V.with_views(V.V_UPLOAD, then="""
SELECT request_id, at_, status, CASE WHEN status = 503 THEN 5 ELSE 0 END AS retry_after FROM (
    SELECT page_id AS request_id, page_id * 7919 % 1009 AS at_, CASE WHEN row_number() OVER (ORDER BY page_id * 7919 % 1009, page_id) <= 40 THEN 202 ELSE 503 END AS status FROM v_upload
)""").replace("at_, status,", 'at_ AS "at", status,', 1)


@query(sql="""
SELECT user_id AS upload_id, count(*) AS n_read, max(upto)::BIGINT AS bytes_read, CASE WHEN max(upto) > 150000 THEN 413 ELSE 202 END AS status
FROM (SELECT user_id, (event_id * 37) % 5000 AS length, sum((event_id * 37) % 5000) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM events)
WHERE upto - length <= 150000 GROUP BY ALL""")
def upload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("upload_id"), F.col("event_id").alias("seq"), ((F.col("event_id") * 37) % 5000).alias("length"))
    return requests.chunks_read(chunks, 150_000)


@query(sql="""
SELECT c_custkey, n_name AS caller, CASE WHEN n_name IS NULL THEN 401 ELSE 202 END AS status
FROM customer LEFT JOIN nation ON 'key' || (c_custkey % 40) = 'key' || n_nationkey""")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("key"), F.col("n_nationkey")).alias("key"))
    asked = V.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("key"), F.col("c_custkey") % 40).alias("key"))
    return requests.authorised(asked, keys).select("c_custkey", "caller", "status")


@query(V.V_UPLOAD, sql="SELECT page_id, name AS stem FROM v_upload WHERE name IS NOT NULL")
def suffix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.get(F.array(*map(F.lit, (".alto.xml", ".xml", ".txt", ""))), (F.col("page_id") % 4).cast("int"))
    return V.v_upload(spark, sf_dir).where("name IS NOT NULL").select("page_id", strip_suffix(F.concat("name", ends)).alias("stem"))


@query(V.V_JOB, """
v_made AS (
    SELECT job_id, 'alto' AS key FROM v_job WHERE status = 'done' UNION SELECT job_id, 'txt' FROM v_job WHERE status = 'running'
    UNION SELECT job_id, 'pdf' FROM v_job WHERE status = 'failed' AND job_id % 3 = 0 UNION SELECT job_id, 'doc' FROM v_job WHERE status = 'failed' AND job_id % 6 = 0
)""", sql="""
SELECT job_id, CASE WHEN odd IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN odd IS NULL THEN files ELSE '' END AS files, 'unknown output: ' || odd AS error FROM (
    SELECT job_id, min(key) FILTER (WHERE key NOT IN ('alto', 'txt')) AS odd, coalesce(string_agg(job_id || CASE key WHEN 'alto' THEN '.xml' ELSE '.txt' END, ' ' ORDER BY key = 'alto') FILTER (WHERE key IN ('alto', 'txt')), '') AS files FROM v_made GROUP BY ALL
)""")
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE WHEN status = 'done' THEN array('alto') WHEN status = 'running' THEN array('txt') WHEN status = 'failed' AND job_id % 6 = 0 THEN array('pdf', 'doc') WHEN status = 'failed' AND job_id % 3 = 0 THEN array('pdf') END")
    made = V.v_job(spark, sf_dir).select("job_id", F.explode(kind).alias("key")).distinct()
    return jobs.outcomes(made).withColumn("files", F.array_join("files", " "))


@query(sql="SELECT event_id, ts FROM events WHERE event_id % 3 <> 2 AND ts < TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 24 HOURS")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.get(F.array(*map(F.lit, (".xml", ".txt", ".png"))), (F.col("event_id") % 3).cast("int"))
    files = V.table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("results/"), "event_id", ends).alias("path"), F.col("ts").alias("modificationTime"))
    return jobs.orphans(files, F.to_timestamp(F.lit("2024-01-02 12:00:00"))).select("event_id", "ts")


@query(V.V_LINE, _KEPT, sql=rf"""
SELECT d.page_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_lines, 1)::BIGINT AS n_lines FROM (SELECT DISTINCT page_id FROM v_line) d LEFT JOIN (
    SELECT page_id, sum(len(list_filter(string_split({_STRIP}, ' '), lambda w: w <> ''))) AS n_words, count(*) + count(DISTINCT region_idx) - 1 AS n_lines FROM v_kept GROUP BY ALL
) USING (page_id)""")
def written_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_line(spark, sf_dir).withColumn("role", F.lit(None).cast("string"))
    made = alto.to_alto(alto.with_shared_words(rows)).join(blocks.page_text(rows), "page_id")
    words, lines_ = requests.written_counts(F.col("alto"), F.col("page_text"))
    return made.select("page_id", words.cast("long").alias("n_words"), lines_.cast("long").alias("n_lines"))


@query(V.V_UPLOAD, sql="""
SELECT page_id, stem || '.txt' AS result, count(*) OVER (PARTITION BY stem) AS n_same FROM (SELECT page_id, regexp_replace(regexp_extract(name || '.png', '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM v_upload)""")
def result_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = V.v_upload(spark, sf_dir).select("page_id", requests.result_name(F.concat("name", F.lit(".png")), F.lit("txt")).alias("result"))
    return requests.colliding(names).select("page_id", "result", "n_same")


@query(sql="""
SELECT (SELECT string_agg(n, ' ' ORDER BY n) FROM m WHERE contains(n, 'rec-') AND ends_with(n, '.onnx')) AS recognizers, (SELECT string_agg(n, ' ' ORDER BY n) FROM m WHERE contains(n, 'dec-') AND ends_with(n, '.onnx')) AS detectors
""".replace("SELECT (SELECT", "WITH m AS (SELECT ['rec-', 'dec-', 'x-'][(n_nationkey % 3 + 1)::INT] || lower(n_name) || ['.onnx', '.json'][(n_nationkey % 2 + 1)::INT] AS n FROM nation) SELECT (SELECT", 1))
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("n_nationkey") % len(values)).cast("int"))
    names = V.table(spark, sf_dir, "nation").select(F.concat(pick(("rec-", "dec-", "x-")), F.lower("n_name"), pick((".onnx", ".json"))).alias("name"))
    made = requests.pages_of_models(names)
    return made.select(*(F.array_join(c, " ").alias(c) for c in ("recognizers", "detectors")))


# a separator at every 50th pixel of every 100th row of pages with an even number
_SEPS = """
v_gap AS (
    SELECT c.page_id, c.a_seq, c.b_seq, floor(least(l, r))::INT AS gx0, floor(greatest(l, r) + 1)::INT AS gx1, (floor(mid) - floor(half))::INT AS gy0, (floor(mid) + floor(half) + 1)::INT AS gy1
    FROM (
        SELECT v_cand.*, CASE WHEN a.x0 <= b.x0 THEN a.x1 ELSE b.x1 END AS l, greatest(a.x0, b.x0) AS r, 0.5::DOUBLE * (a.cy + b.cy) AS mid, 0.25::DOUBLE * (greatest(1.0, a."asc" + a."desc") + greatest(1.0, b."asc" + b."desc")) AS half
        FROM v_cand JOIN v_box a ON a.page_id = v_cand.page_id AND a.seq = a_seq JOIN v_box b ON b.page_id = v_cand.page_id AND b.seq = b_seq
    ) c
)"""


@query(V.V_BOX, _MERGE, _SEPS, sql="""
SELECT page_id, a_seq, b_seq FROM v_gap WHERE NOT (page_id % 2 = 0 AND EXISTS (SELECT 1 FROM range(0, 1400, 100) y(y), range(0, 1200, 50) x(x) WHERE x >= gx0 AND x < gx1 AND y >= gy0 AND y < gy1))""")
def merge_barred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.v_box(spark, sf_dir)
    seps = pages_of(rows).where("page_id % 2 = 0").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(1399), F.lit(100))).alias("y")).select("page_id", "y", F.explode(F.sequence(F.lit(0), F.lit(1199), F.lit(50))).alias("x"), F.lit(0.9).alias("sep"))
    return lines.merge_candidates(rows, seps)


_LATEST = "v_latest AS (SELECT job_id, arg_max(status, ts) AS status, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM v_job GROUP BY ALL)"


@query(V.V_JOB, _LATEST, sql="SELECT job_id, status, CASE WHEN status = 'done' THEN 'success' ELSE status END AS legacy, created_at, updated_at, n_events FROM v_latest")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(V.v_job(spark, sf_dir))


@query(V.V_JOB, _LATEST, sql="SELECT count(*) FILTER (WHERE status IN ('queued', 'running')) AS n_active, count(*) FILTER (WHERE status = 'queued') AS n_pending, count(*) FILTER (WHERE status IN ('queued', 'running')) < 16 AS has_room FROM v_latest")
def job_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.capacity(jobs.latest(V.v_job(spark, sf_dir)), 16)


NOW = "2024-01-02 12:00:00"


@query(V.V_JOB, _LATEST, sql=f"SELECT job_id, status, created_at FROM v_latest WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS")
def job_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.unexpired(jobs.latest(V.v_job(spark, sf_dir)), F.to_timestamp(F.lit(NOW))).select("job_id", "status", "created_at")


@query(V.V_JOB, _LATEST, sql="""
SELECT job_id, code, CASE WHEN code = 200 THEN suffix END AS suffix, CASE WHEN code = 200 THEN CASE suffix WHEN '.xml' THEN 'application/xml' ELSE 'text/plain; charset=utf-8' END END AS media FROM (
    SELECT job_id, CASE WHEN job_id % 2 = 0 THEN '.xml' WHEN job_id % 3 = 0 THEN '.txt' END AS suffix,
           CASE WHEN status = 'failed' THEN 500 WHEN status <> 'done' THEN 202 WHEN job_id % 2 <> 0 AND job_id % 3 <> 0 THEN 404 ELSE 200 END AS code FROM v_latest
)""")
def result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = jobs.latest(V.v_job(spark, sf_dir))
    files = table.where("job_id % 2 = 0").select("job_id", F.lit(".xml").alias("suffix")).union(table.where("job_id % 3 = 0").select("job_id", F.lit(".txt").alias("suffix")))
    return jobs.result_of(table, files)


@query(V.V_JOB, sql="SELECT count(*) FILTER (WHERE status <> 'failed') AS n_ok, count(*) FILTER (WHERE status = 'failed') AS n_errors, round(avg(value), 6) AS seconds_per_page FROM v_job")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(jobs.summary(V.v_job(spark, sf_dir).select((F.col("status") != "failed").alias("ok"), F.col("value").alias("seconds"))), "seconds_per_page")


@query(V.V_JOB, sql="SELECT job_id, arg_max(status, ts) AS status, count(*) AS n_events, min(ts) AS created_at, max(ts) AS updated_at FROM v_job GROUP BY ALL")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over all events at once, with an age that none reaches; its results go to the shared folder."""
    from quirelake.session import scratch
    from quirelake.streaming import jobs as stream

    folder = scratch(spark, "job-stream")
    schema = V.table(spark, sf_dir, "events").schema
    # the table is a file or a folder; a stream reads folders, so the name is a glob in its parent
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END")
    rows = events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("status"))
    stream.run_once(stream.track(rows, max_age_hours=24 * 365 * 100), f"{folder}/changes", f"{folder}/state")
    out = stream.current(spark.read.schema(stream.TABLE).parquet(f"{folder}/changes"))
    return out.select("job_id", "status", "n_events", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


# a ramp for each key: gray pages have it in all three channels; others hold it as red, upside down as green, from right to left as blue
@query("""
v_px AS (
    SELECT k, y, x, c, CASE WHEN k % 2 = 1 OR c = 2 THEN y * (8 + k) + x WHEN c = 1 THEN (11 - y) * (8 + k) + x ELSE y * (8 + k) + 7 + k - x END * (k + 3) % 256 AS v
    FROM (SELECT r_regionkey::INT AS k FROM region), range(12) AS a(y), (SELECT unnest(range(3)) AS c), LATERAL (SELECT unnest(range(8 + k)) AS x)
)""", sql="""
SELECT 'page' || k AS page_id, 12 AS height, 8 + k AS width, 3 AS nChannels, 202 AS status, sha256(unhex(string_agg(printf('%02x', v::INT), '' ORDER BY y, x, c))) AS sha FROM v_px GROUP BY k
UNION ALL SELECT 'broken', -1, -1, -1, 422, NULL""")
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small images made from the regions' keys, one of them broken, written to the shared folder and read as pages."""
    from quirelake.session import scratch
    from quirelake.sources import images

    folder = scratch(spark, "images")
    images.write_samples(V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("k")), folder)
    rows = images.read_pages(spark, folder)
    return rows.select("page_id", "height", "width", "nChannels", "status", F.sha2("data", 256).alias("sha"))


@query()
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From layout maps to lines in reading order: fragments joined, regions, columns, order."""
    rows = maps.maps_to_regions(V.v_map(spark, sf_dir))
    return rows.select("page_id", "region_idx", "line_idx", F.size("baseline").alias("n_points"), "x0", "x1", r6("cy").alias("cy"), r6("asc").alias("asc"), r6("desc").alias("desc"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

