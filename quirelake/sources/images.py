"""Page images by Spark's own image and binary sources."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quirelake.operators.requests import is_image, pixel_status, stem


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder, not of folders below it, any case of suffix, sorted by path: (path, page_id, length)."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.where(is_image(F.col("path"))).withColumn("page_id", stem(F.col("path"))).orderBy("path")


def read_pages(spark: SparkSession, folder: str, max_pixels: int = 300_000_000) -> DataFrame:
    """(page_id, origin, height, width, nChannels, mode, data, status): pixels in BGR order; files that can't be decoded, and images of
    too many pixels, stay as rows of status 422 without pixels."""
    raw = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    rows = raw.where(is_image(F.col("origin"))).withColumn("page_id", stem(F.col("origin"))).withColumn("status", pixel_status(F.col("height"), F.col("width"), max_pixels))
    data = F.when((F.col("status") == 202) & (F.col("nChannels") != 3), ensure_bgr("data", "nChannels")).when(F.col("status") == 202, F.col("data"))
    return rows.select("page_id", "origin", "height", "width", F.when(F.col("status") == 202, 3).otherwise(F.col("nChannels")).alias("nChannels"), "mode", data.alias("data"), "status")


@pandas_udf(BinaryType())
def ensure_bgr(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Three channels: gray is repeated, a fourth channel dropped, others stay."""

    def one(d, c):
        if d is None or c not in (1, 4):
            return d
        a = np.frombuffer(d, dtype=np.uint8)
        return np.repeat(a, 3).tobytes() if c == 1 else a.reshape(-1, c)[:, :3].tobytes()

    return pd.Series([one(d, c) for d, c in zip(data, channels)])


def png(pixels: np.ndarray) -> bytes:
    """A PNG of gray (h, w) or colour (h, w, 3 in RGB order) bytes."""
    rows = pixels.reshape(pixels.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_samples(keys: DataFrame, folder: str) -> None:
    """A small image for each key (k), alternately gray and colour, and one broken file, by the driver through Hadoop's file
    system, as the folder may be in any store. For tests and demonstrations: the keys come to the driver one after the other."""
    spark = keys.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = {"broken.png": b"not an image"}
    for (k,) in keys.orderBy("k").toLocalIterator():
        ramp = (np.arange(12 * (8 + k)).reshape(12, 8 + k) * (k + 3) % 256).astype(np.uint8)
        files[f"page{k}.png"] = png(ramp if k % 2 else np.stack([ramp, ramp[::-1], ramp[:, ::-1]], axis=2))
    for name, body in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(body))
        out.close()
