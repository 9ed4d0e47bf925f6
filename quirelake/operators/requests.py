"""Checks of uploads and requests, and names of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What can be asked for, and suffixes by format.
DOMAINS, FORMATS = ("default", "kramarky"), ("alto", "txt", "multi")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff")
SUFFIX = {"alto": ".alto.xml", "txt": ".txt", "multi": ""}


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def upload_status(length: Column, most: int) -> Column:
    """413 for uploads over the limit, before anything is decoded; equal is allowed."""
    return F.when(length > most, 413).otherwise(202)


def chunks_read(chunks: DataFrame, most: int) -> DataFrame:
    """chunks (upload_id, seq, length) in the order they come -> (upload_id, n_read, bytes_read, status): reading ends with the chunk
    that takes an upload over the limit, whatever length was declared; then 413."""
    upto = F.sum("length").over(Window.partitionBy("upload_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    read = chunks.withColumn("upto", upto).where(F.col("upto") - F.col("length") <= most)
    g = read.groupBy("upload_id").agg(F.count("*").alias("n_read"), F.max("upto").alias("bytes_read"))
    return g.select("upload_id", "n_read", "bytes_read", upload_status(F.col("bytes_read"), most).alias("status"))


def pixel_status(height: Column, width: Column, most: int) -> Column:
    """422 for images that can't be decoded or have too many pixels."""
    return F.when((height <= 0) | (width <= 0) | (height.cast("long") * width > most), 422).otherwise(202)


def validated(requests: DataFrame) -> DataFrame:
    """requests (.., domain, fmt) -> with model (null for the default), fmt_used, status 400 for an unknown value, and error."""
    d = F.when(F.coalesce("domain", F.lit("")).isin("", "default"), F.lit(None).cast("string")).otherwise(F.col("domain"))
    f = F.when(F.coalesce("fmt", F.lit("")) == "", "alto").otherwise(F.col("fmt"))
    bad_d, bad_f = d.isNotNull() & ~F.coalesce(d.isin(*DOMAINS), F.lit(False)), ~f.isin(*FORMATS)
    error = F.when(bad_d, F.concat(F.lit("unknown domain: "), d)).when(bad_f, F.concat(F.lit("unknown format: "), f))
    return requests.withColumn("model", F.when(~bad_d, d)).withColumn("fmt_used", F.when(~bad_f, f)).withColumn("status", F.when(bad_d | bad_f, 400).otherwise(202)).withColumn("error", error)


def authorised(requests: DataFrame, keys: DataFrame | None, single_key: str | None = None) -> DataFrame:
    """With caller and status: a keys table (name, key) comes first, then a single key, else all are let in; otherwise 401. Of names
    that share a key the last one calls. The join is left to the planner, which broadcasts a small table of keys."""
    if keys is not None:
        named = keys.groupBy(F.col("key").alias("_key")).agg(F.max("name").alias("caller"))
        return requests.join(named, F.col("key") == F.col("_key"), "left").drop("_key").withColumn("status", F.when(F.col("caller").isNull(), 401).otherwise(202))
    ok = F.lit(True) if not single_key else F.coalesce(F.col("key") == single_key, F.lit(False))
    return requests.withColumn("caller", F.when(ok, F.lit("default"))).withColumn("status", F.when(ok, 202).otherwise(401))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def result_name(path: Column, fmt: Column) -> Column:
    """The stem with the format's suffix; other formats are written as ALTO."""
    suffix = F.when(fmt == "txt", SUFFIX["txt"]).when(fmt == "multi", SUFFIX["multi"]).otherwise(SUFFIX["alto"])
    return F.concat(stem(path), suffix)


def colliding(names: DataFrame) -> DataFrame:
    """names (page_id, result) -> with n_same: results that inputs of one stem would overwrite."""
    return names.join(names.groupBy("result").agg(F.count("*").alias("n_same")), "result")


def written_counts(xml: Column, txt: Column) -> tuple[Column, Column]:
    """Words of an ALTO document and lines of a text, by their marks."""
    return F.regexp_count(xml, F.lit("<String ")), F.regexp_count(txt, F.lit("\n"))


def pages_of_models(names: DataFrame) -> DataFrame:
    """names (name) of model files -> one row (recognizers, detectors): sorted, by their prefixes."""
    pick = lambda part: F.array_sort(F.collect_list(F.when(F.col("name").contains(part), F.col("name"))))
    return names.where(F.lower("name").endswith(".onnx")).agg(pick("rec-").alias("recognizers"), pick("dec-").alias("detectors"))
