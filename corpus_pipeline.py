"""From documents to training sequences: five stages, each of one operator, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import exact, minhash, mix, pack, toxicity
from quirelake.llm.common import _folders, documents, fresh, release, sized, staged
from quirelake.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the rest stay as they are."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, threshold=0.3)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row that is fixed as it is written, and its name: ids may be null or repeat, these aren't and don't."""
    key = fresh(docs, "row_key")
    return staged(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def _one_of_each(rows: DataFrame, key: str, groups: DataFrame, best: Callable[[Column], Column], order: list, tag: str) -> DataFrame:
    """rows without all but the best row of each group; groups (g_key, group) has the rows of groups of more than one."""
    ids = sized(staged(groups, f"{tag}-groups"))
    named = rows.select(F.col(key).alias("r_key"), "doc_id").join(ids, F.col("r_key") == F.col("g_key"))
    named = staged(named.select("group", F.struct(*order, "r_key").alias("rank")), f"{tag}-ranks")
    kept = sized(staged(named.groupBy("group").agg(best(F.col("rank")).alias("top")), f"{tag}-kept"))
    gone = named.join(kept, "group").where("rank != top").select(F.col("rank.r_key").alias(fresh(rows, "gone_key")))
    gone = sized(staged(gone, f"{tag}-gone"))
    return rows.join(gone, rows[key] == gone[gone.columns[0]], "left_anti").drop(key)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row of the largest doc_id stays; null is smaller than any other."""
    rows, key = _numbered(docs)
    found = exact.exact_groups(rows, id_col=key).where("group_size > 1")
    return _one_of_each(rows, key, found.select(F.col("doc_id").alias("g_key"), F.col("keep_id").alias("group")), F.max, ["doc_id"], "exact")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row of the smallest doc_id stays, of a null one if there is no other.
    Texts without words are near nothing and stay."""
    rows, key = _numbered(docs)
    found = staged(minhash.near_duplicates(rows, width=5, threshold=0.8, id_col=key).select(F.col("doc_id").alias("g_key"), F.col("component_id").alias("group"), "kept"), "near-found")
    several = sized(staged(found.where("NOT kept").select("group").distinct(), "near-several"))
    return _one_of_each(rows, key, found.join(several, "group", "left_semi").select("g_key", "group"), F.min, [F.col("doc_id").isNull().alias("no_id"), "doc_id"], "near")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes; a document of two copies is two rows. Texts without words aren't taken."""
    n, who, nth = (fresh(docs, name) for name in ("copies", "mix_id", "copy"))
    taken = mix.mix(docs, share=1.5, most=2.0).where("copies > 0").groupBy(F.col("doc_id").alias(who)).agg(F.max("copies").alias(n))
    taken = sized(staged(taken, "mix"))
    chosen = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(who)))
    return chosen.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens."""
    return pack.pack(docs, tokenizer_path(), end_id=2, length=1024)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("pack", pack_sequences)]

#: The stages learn a model, follow links and fill bins, which SQL can't express; tests/llm holds run() to plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read as the next one's docs. What a stage has
    written besides, and what it has read, is deleted when it is done."""
    docs, before = documents(spark, sf_dir), len(_folders)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before)
    return docs
