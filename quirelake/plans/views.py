"""Typed stand-ins for page data, derived from the test tables by the same integer and string formulas in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_W = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with boxes: (page_id, line_idx, region_idx, text, pos, hpos, vpos, width, height, page_w, page_h)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("ls"))
    last = F.concat(F.lit("– "), F.col("page_id").cast("string"), F.lit(" –"))
    marked = F.transform("ls", lambda t, i: F.when(i % 7 == 6, F.lit("   ")).when(i % 11 == 5, F.concat(t, F.lit("²"))).otherwise(t))
    rows = docs.select("page_id", F.size("ls").alias("n"), F.posexplode(F.concat(marked, F.array(last))).alias("pos", "text"))
    idx = F.when(F.col("pos") == F.col("n"), 9999).otherwise(F.col("pos"))
    rows = rows.withColumn("line_idx", idx).withColumn("region_idx", F.floor(F.col("line_idx") / 5).cast("int"))
    size = F.length("text")
    return rows.select(
        "page_id", "line_idx", "region_idx", "text", "pos",
        (F.lit(40) + 10 * (F.col("region_idx") % 3)).alias("hpos"), (F.lit(60) + 48 * F.col("pos")).alias("vpos"),
        F.least(F.lit(1400), 11 * size).alias("width"), (F.lit(30) + size % 7).alias("height"),
        F.lit(PAGE_W).alias("page_w"), (F.lit(120) + 48 * (F.col("n") + 1)).alias("page_h"),
    )


V_LINE = """
v_doc AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS ls FROM documents),
v_raw AS (
    SELECT page_id, len(ls) AS n, i - 1 AS pos, i - 1 AS line_idx,
           CASE WHEN (i - 1) % 7 = 6 THEN '   ' WHEN (i - 1) % 11 = 5 THEN ls[i] || '²' ELSE ls[i] END AS text
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM v_doc)
    UNION ALL SELECT page_id, len(ls), len(ls), 9999, '– ' || page_id || ' –' FROM v_doc
),
v_line AS (
    SELECT page_id, line_idx::INT AS line_idx, (line_idx // 5)::INT AS region_idx, text, pos::INT AS pos,
           (40 + 10 * ((line_idx // 5) % 3))::INT AS hpos, (60 + 48 * pos)::INT AS vpos,
           least(1400, 11 * length(text))::INT AS width, (30 + length(text) % 7)::INT AS height,
           1500 AS page_w, (120 + 48 * (n + 1))::INT AS page_h
    FROM v_raw
)"""


def v_ctc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_line's lines that aren't blank, with (line_id, frames): two frames a character of the whole text, null for blank. The
    frames of a line stay in its row: as rows of their own they would be sorted and dealt, twice the corpus' characters."""
    rows = v_line(spark, sf_dir).where(F.trim("text") != "")
    rows = rows.withColumn("cs", F.split("text", "")).withColumn("cs", F.filter("cs", lambda c: c != ""))
    framed = F.flatten(F.transform("cs", lambda c, i: F.array(c, F.when(F.get("cs", i + 1).eqNullSafe(c), F.lit(None).cast("string")).otherwise(c))))
    return rows.withColumn("line_id", F.col("page_id") * 10000 + F.col("line_idx")).withColumn("frames", framed).drop("cs")


V_CTC = """
v_cl AS (SELECT *, string_split(text, '') AS cs FROM v_line WHERE trim(text) <> ''),
v_ci AS (SELECT page_id * 10000 + line_idx AS line_id, page_id, line_idx, unnest(range(1, len(cs) + 1)) AS i, cs FROM v_cl),
v_ctc AS (
    SELECT line_id, page_id, line_idx, (2 * (i - 1))::INT AS t, cs[i] AS ch FROM v_ci
    UNION ALL SELECT line_id, page_id, line_idx, (2 * (i - 1) + 1)::INT, CASE WHEN i < len(cs) AND cs[i + 1] = cs[i] THEN NULL ELSE cs[i] END FROM v_ci
)"""

#: 63 symbols; class 0 is blank.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "


def v_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score frames (line_id, t, logits): 25 vectors a line."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 25).alias("line_id"), (F.col("vec_id") % 25).cast("int").alias("t"), F.col("embedding").cast("array<double>").alias("logits"))


V_FRAME = "v_frame AS (SELECT vec_id // 25 AS line_id, (vec_id % 25)::INT AS t, embedding::DOUBLE[] AS logits FROM embeddings)"


def v_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected lines (page_id, seq, x0, x1, cy, asc, desc): about forty a page."""
    li = table(spark, sf_dir, "lineitem").withColumn("page_id", F.floor(F.col("l_orderkey") / 10))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    x0 = (F.col("l_partkey") * 37) % 900
    rows = li.withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)))
    return rows.select(
        "page_id", "seq", x0.cast("double").alias("x0"), (x0 + 20 + 4 * F.col("l_quantity").cast("int")).cast("double").alias("x1"),
        (F.lit(40) + (F.col("l_orderkey") * 97 + F.col("l_linenumber") * 131) % 1300).cast("double").alias("cy"),
        ((F.lit(8) + F.col("l_suppkey") % 7) * F.when(F.col("l_partkey") % 9 == 0, 8).otherwise(1)).cast("double").alias("asc"),
        (F.lit(3) + F.col("l_linenumber") % 4).cast("double").alias("desc"),
    )


V_BOX = """
v_box AS (
    SELECT l_orderkey // 10 AS page_id,
           row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)::INT AS seq,
           ((l_partkey * 37) % 900)::DOUBLE AS x0, ((l_partkey * 37) % 900 + 20 + 4 * trunc(l_quantity)::INT)::DOUBLE AS x1,
           (40 + (l_orderkey * 97 + l_linenumber * 131) % 1300)::DOUBLE AS cy,
           ((8 + l_suppkey % 7) * CASE WHEN l_partkey % 9 = 0 THEN 8 ELSE 1 END)::DOUBLE AS "asc", (3 + l_linenumber % 4)::DOUBLE AS "desc"
    FROM lineitem
)"""


def v_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout passes (page_id, ds, conf, pitch, wide, lineh, n_lines), three resolutions a page."""
    ev = table(spark, sf_dir, "events")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = ev.withColumn("rn", rn)
    num = lambda a, m: (F.col("event_id") * a) % m
    rows = e.select(
        (F.col("user_id") * 1000 + F.floor(F.col("rn") / 3)).alias("page_id"), (F.lit(3) - F.col("rn") % 3).alias("ds"),
        (num(7919, 100) / F.lit(100.0)).alias("conf"), (F.lit(0.8) + num(31, 80) / F.lit(100.0)).alias("pitch"), (num(17, 30) / F.lit(300.0)).alias("wide"),
        (F.lit(6) + num(13, 20)).cast("double").alias("lineh"), (F.lit(10) + num(11, 60)).cast("int").alias("n_lines"),
    )
    full = rows.groupBy(F.col("page_id").alias("p")).count().where("count = 3").select("p")
    return rows.join(full, F.col("page_id") == F.col("p"), "left_semi")


V_LEVEL = """
v_ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events),
v_lv AS (
    SELECT user_id * 1000 + rn // 3 AS page_id, (3 - rn % 3)::INT AS ds, ((event_id * 7919) % 100) / 100.0::DOUBLE AS conf,
           0.8::DOUBLE + ((event_id * 31) % 80) / 100.0::DOUBLE AS pitch, ((event_id * 17) % 30) / 300.0::DOUBLE AS wide,
           (6 + (event_id * 13) % 20)::DOUBLE AS lineh, (10 + (event_id * 11) % 60)::INT AS n_lines
    FROM v_ev
),
v_level AS (SELECT * FROM v_lv WHERE page_id IN (SELECT page_id FROM v_lv GROUP BY page_id HAVING count(*) = 3))"""

CELL_H, CELL_W = 64, 96


def v_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout maps (page_id, h, w, asc_h, desc_h, base, endp, sep) of 64 x 96 cells, a page for each supplier."""
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("page_id"), F.lit(CELL_H).alias("h"), F.lit(CELL_W).alias("w"))
    each = lambda body: F.expr(f"transform(sequence(0, {CELL_H * CELL_W - 1}), i -> {body.replace('[y]', f'(i div {CELL_W})').replace('[x]', f'(i % {CELL_W})')})")
    nz = "((cast([x] as long) * 7919 + [y] * 104729 + page_id * 1299721) % 1000) / 1000D"
    on = "([y] % 12 BETWEEN 4 AND 6 AND NOT (([x] div 32 + page_id) % 3 = 2 AND [x] % 32 < 8))"
    return pages.select(
        "page_id", "h", "w", each(f"6D + {nz}").alias("asc_h"), each("2D").alias("desc_h"),
        each(f"CASE WHEN {on} THEN 0.8D - 0.2D * abs([y] % 12 - 5) + 0.1D * ({nz}) ELSE 0.05D * ({nz}) END").alias("base"),
        each("CASE WHEN [x] % 48 >= 44 THEN 0.9D ELSE 0D END").alias("endp"), each("CASE WHEN [x] BETWEEN 47 AND 49 AND page_id % 2 = 0 THEN 0.9D ELSE 0.02D END").alias("sep"),
    )


V_CELL = """
v_cn AS (
    SELECT s_suppkey::BIGINT AS page_id, y::INT AS y, x::INT AS x, ((x * 7919 + y * 104729 + s_suppkey::BIGINT * 1299721) % 1000) / 1000.0::DOUBLE AS nz
    FROM supplier, range(64) AS a(y), range(96) AS b(x)
),
v_cell AS (
    SELECT page_id, y, x,
           CASE WHEN y % 12 BETWEEN 4 AND 6 AND NOT ((x // 32 + page_id) % 3 = 2 AND x % 32 < 8) THEN 0.8::DOUBLE - 0.2::DOUBLE * abs(y % 12 - 5) + 0.1::DOUBLE * nz ELSE 0.05::DOUBLE * nz END AS base,
           CASE WHEN x % 48 >= 44 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS endp,
           CASE WHEN x BETWEEN 47 AND 49 AND page_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.02::DOUBLE END AS sep,
           6.0::DOUBLE + nz AS asc_h, 2.0::DOUBLE AS desc_h
    FROM v_cn
)"""


def v_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events (job_id, seq, ts, status)."""
    ev = table(spark, sf_dir, "events")
    status = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END")
    return ev.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), "value")


V_JOB = """
v_job AS (
    SELECT user_id AS job_id, event_id AS seq, ts, value,
           CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS status
    FROM events
)"""


def v_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads (page_id, name, length)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("name"), F.octet_length("html").cast("long").alias("length"))


V_UPLOAD = "v_upload AS (SELECT page_id, url AS name, strlen(html)::BIGINT AS length FROM pages)"


def with_views(*parts: str, then: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(p.strip() for p in parts)}\n{then}"
