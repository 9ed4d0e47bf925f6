"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, exact, langid, license, minhash, mix, pack, pii, quotes, toxicity
from .common import LOWER, UPPER, documents, long_schema, small_batches

#: The fold that language models don't learn from.
LANG_FOLD, LANG_FOLDS = 0, 5


def tokenizer_path() -> str:
    """The ranks of the vocabulary byte_bpe_50k.json: the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(documents(spark, sf_dir), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def replies(talk: DataFrame) -> DataFrame:
    """The test tables' messages quote nothing, so each is given the quote of the message of the turn before: at even turns of its
    first line, at odd ones of all of it."""
    before = talk.where("text IS NOT NULL").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("said"))
    part = F.when(F.col("turn") % 2 == 0, F.substring_index("said", "\n", 1)).otherwise(F.col("said"))
    quote = F.concat(F.lit("> "), F.regexp_replace(part, "\n", "\n> "), F.lit("\n"))
    return talk.select("conv_id", "turn", "text").join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", F.concat(F.coalesce(quote, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.withColumn("own_sha256", F.sha2("own_text", 256)).drop("own_text")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, threshold=0.8)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(documents(spark, sf_dir))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(documents(spark, sf_dir), tokenizer_path(), end_id=2, length=1024)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % LANG_FOLDS == LANG_FOLD, F.lit(False))
    return langid.identify(docs, langid.fit(docs.where(~held_out)), keep={"held_out": held_out})


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, threshold=0.3)


#: Of the chords that recordings() plays: unrelated ones differ in this share of bits, with this spread / sqrt(overlap).
CHORD_CHANCE = (0.365, 0.32)


def recordings(vectors: DataFrame, rate: int = 8000, note: int = 1024) -> DataFrame:
    """(id, audio, rate): the test tables have no sound, so each vector is played whole. A chord begins with each of its values:
    twelve pitch classes, as loud as twelve of the values, the next chord's one further on. Vectors that are close sound alike."""
    small_batches(vectors.sparkSession, rows=50)

    def run(batches):
        voices: dict[int, np.ndarray] = {}
        for batch in batches:
            audio = []
            for v in batch.column("embedding").to_pylist():
                x = np.nan_to_num(np.array([y or 0.0 for y in v or []], dtype=np.float64))
                n = len(x)
                if n not in voices:
                    t = np.arange(n * note) / rate
                    voices = {n: np.sin(2 * np.pi * 440 * 2 ** (np.arange(12) / 12)[:, None] * t).astype(np.float32).reshape(12, n, note)}
                loud = np.exp(8 * np.clip(x, -1, 1))[(np.arange(n)[:, None] + 19 * np.arange(12)) % max(n, 1)]
                loud /= np.sqrt((loud * loud).sum(axis=1, keepdims=True))
                audio.append((np.einsum("csn,sc->sn", voices[n], loud.astype(np.float32)) * 9000).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(audio, pa.binary()), pa.array([rate] * len(audio), pa.int32())], ["id", "audio", "rate"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, long_schema("id long, audio binary, rate int"))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.group(recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), chance=CHORD_CHANCE, sigmas=7.0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix, op2_quotes, op3_minhash, op4_pii, op5_pack, op6_langid, op7_exact, op8_license, op9_toxicity, op10_chroma)}


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_OP1 = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
    FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS w, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM r),
v AS (SELECT *, cap / w AS per FROM w),
l AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY per, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY per, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
    FROM v
), k AS (SELECT arg_min(level, per * 1000000.0 + rank) AS level FROM l WHERE per >= level),
t AS (SELECT source, source_size, CASE WHEN k.level IS NULL THEN cap ELSE least(cap, w * k.level) END AS target FROM l, k),
p AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), e AS (SELECT *, floor(sqrt(size))::BIGINT AS odds FROM d),
m AS (SELECT source, sum(size * odds)::DOUBLE AS mass FROM e GROUP BY source),
o AS (
    SELECT e.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
           least(0.999::DOUBLE, CASE WHEN m.mass > 0 THEN (p.target - p.whole * p.source_size) * odds / m.mass ELSE 0.0 END) AS p
    FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source JOIN m ON e.source IS NOT DISTINCT FROM m.source
), q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM o),
l1 AS (
    SELECT source_size, target, whole, first(rest) AS rest, list({'x': q / (1 + q), 'doc_id': doc_id, 'size': size} ORDER BY q / (1 + q), doc_id NULLS FIRST, size) AS items
    FROM q WHERE q IS NOT NULL GROUP BY source, source_size, target, whole
), f1 AS (SELECT *, list_reduce(items, FILL, {'room': rest, 'out': []::OUT}) AS one FROM l1),
f2 AS (
    SELECT *, CASE WHEN rest >= 1 AND one.room > 0.001::DOUBLE * target THEN list_filter(one.out, lambda i: NOT i.more AND i.item.size <= rest)[1].item END AS lead FROM f1
), f3 AS (
    SELECT *, CASE WHEN lead IS NOT NULL THEN list_reduce(list_filter(items, lambda i: i IS DISTINCT FROM lead), FILL, {'room': rest - lead.size, 'out': []::OUT}) END AS two FROM f2
), r1 AS (
    SELECT source_size, target, whole, CASE WHEN two.room < one.room THEN list_concat(two.out, list_transform(list_filter(items, lambda i: i IS NOT DISTINCT FROM lead), lambda i, k: {'item': i, 'more': k = 1})) ELSE one.out END AS rows FROM f3
), x AS (
    SELECT r.item.doc_id AS doc_id, r.item.size AS size, source_size, target, whole, r.more AS more FROM (SELECT *, unnest(rows) AS r FROM r1)
    UNION ALL SELECT doc_id, size, source_size, target, whole, false FROM q WHERE q IS NULL
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
""".replace("FILL", "lambda acc, i: {'room': CASE WHEN i.size <= acc.room THEN acc.room - i.size ELSE acc.room END, 'out': list_append(acc.out, {'item': i, 'more': i.size <= acc.room})}").replace("OUT", "STRUCT(item STRUCT(x DOUBLE, doc_id BIGINT, size BIGINT), more BOOLEAN)[]")

# what a message wrote, by its whole text, its paragraphs and its lines; here every quote has its origin in its own conversation
_OP2 = r"""
WITH RECURSIVE p AS (SELECT conv_id, turn + 1 AS turn, min(text) AS said FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
m AS (
    SELECT c.conv_id, c.turn, coalesce(c.text, '') AS own, CASE WHEN c.turn % 2 = 0 THEN string_split(said, chr(10))[1] ELSE said END AS quote
    FROM conversations c LEFT JOIN p ON p.conv_id = c.conv_id AND p.turn = c.turn
), w AS (SELECT conv_id, turn, unnest(list_concat([own], string_split_regex(own, '\n[ \t]*\n'), string_split(own, chr(10)))) AS piece FROM m),
n AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS piece FROM w),
o AS (
    SELECT m.conv_id, m.turn, min(n.turn) AS origin FROM m JOIN n ON n.conv_id = m.conv_id AND n.turn < m.turn AND n.piece = trim(regexp_replace(lower(m.quote), '\s+', ' ', 'g'))
    WHERE n.piece <> '' GROUP BY ALL
), u AS (
    SELECT m.*, o.origin, coalesce(o.origin, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS parent FROM m LEFT JOIN o ON o.conv_id = m.conv_id AND o.turn = m.turn
), d AS (
    SELECT conv_id, turn, 0 AS depth FROM u WHERE parent IS NULL
    UNION ALL SELECT u.conv_id, u.turn, d.depth + 1 FROM u JOIN d ON u.conv_id = d.conv_id AND u.parent = d.turn
)
SELECT u.conv_id, u.turn, u.conv_id AS thread_id, row_number() OVER (PARTITION BY u.conv_id ORDER BY depth, u.turn) - 1 AS reply_order,
       CASE WHEN parent IS NOT NULL THEN u.conv_id END AS parent_conv, parent AS parent_turn,
       (coalesce(trim(regexp_replace(quote, '\s+', ' ', 'g')), '') <> '')::BIGINT AS n_quoted, (origin IS NOT NULL)::BIGINT AS n_linked,
       (quote IS NOT NULL)::INT AS max_level, sha256(own) AS own_sha256
FROM u JOIN d ON u.conv_id = d.conv_id AND u.turn = d.turn
"""

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d
), e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), sides AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT reach.x, sides.b FROM reach JOIN sides ON sides.a = reach.y)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(reach.y) AS component_id, s.doc_id = min(reach.y) AS kept
FROM s JOIN reach ON reach.x = s.doc_id GROUP BY s.doc_id, s.s
"""

_LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _op8() -> str:
    """The templates' word pairs, but those of two function words in all but the exact ones, meet all pairs of neighbouring words."""
    quoted = lambda table: ", ".join(f"('{k}', '{v}')" for k, v in table.items())
    stop = ", ".join(f"'{w}'" for w in license.FUNCTION_WORDS)
    return rf"""
WITH t AS (
    SELECT label, true AS exact, string_split(phrase, ' ') AS w FROM (VALUES {quoted(license.BASE)}) b(label, phrase)
    UNION ALL SELECT label, false, string_split(phrase, ' ') FROM (VALUES {quoted(license.TEMPLATES)}) b(label, phrase)
), g AS (
    SELECT *, count(*) OVER (PARTITION BY label, exact) AS anchors FROM (SELECT label, exact, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t))
    WHERE exact OR a NOT IN ({stop}) OR b NOT IN ({stop})
), d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_LICENSE_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS place, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT doc_id, label, exact, anchors, place - pos AS diagonal, pos, place FROM p JOIN g ON p.a = g.a AND p.b = g.b),
n AS (
    SELECT *, sum(apart) OVER (PARTITION BY doc_id, label, exact ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label, exact ORDER BY diagonal) > {license.GAP})::INT, 0) AS apart FROM v
    )
), s AS (
    SELECT doc_id, label, exact, diagonal AS first, 1.0::DOUBLE AS share FROM v WHERE exact GROUP BY doc_id, label, exact, diagonal, anchors HAVING count(DISTINCT pos) = anchors
    UNION ALL SELECT doc_id, label, exact, min(place), count(DISTINCT pos) / anchors FROM n WHERE NOT exact GROUP BY doc_id, label, exact, run, anchors HAVING count(DISTINCT pos) / anchors >= {license.SHARE}
), f AS (
    SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(first) FILTER (WHERE exact) AS first_word, max(first) FILTER (WHERE exact) AS last_word, max(share) AS score,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM s GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id)
"""


_OP7 = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": _OP1, "op2_quotes": _OP2, "op3_minhash": _OP3, "op7_exact": _OP7, "op8_license": _op8()}
