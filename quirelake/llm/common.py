"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of words are these bytes, 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a place of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            path = tempfile.mkdtemp(prefix="quirelake-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The folders that staged() has written and release() hasn't deleted.
_folders: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int) -> None:
    """Delete all staged folders but the first keep ones and the last one, on whatever file system they are: what came between was
    written for what the last one holds."""
    for path in _folders[keep:-1]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    del _folders[keep:-1]


def sized(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """A staged, narrow df (ids and numbers): marked for broadcast if it has at most so many rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with no, the place of each row in the order, from 0; part and at, its range and its place there. Sorted by ranges and
    counted by range: no task has more than its range, whatever the keys. Written to the shared folder."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = rows.groupBy(F.col("part").alias("n_part")).agg(F.count("*").alias("n_rows"))
    ahead = counts.select("n_part", F.coalesce(F.sum("n_rows").over(Window.orderBy("n_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_ahead"))
    return rows.join(F.broadcast(ahead), F.col("part") == F.col("n_part")).withColumn("no", F.col("n_ahead") + F.col("at")).drop("n_part", "n_ahead")


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 2) -> None:
    """Bound the Arrow batches, as one row may hold a very long text, and as the JVM keeps the buffers of the largest one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def short_reads(spark: SparkSession, rows: int = 128) -> None:
    """Bound the rows that Parquet columns are read by: the texts of a batch are one array, which doubles as it grows, and of 4096
    rows it is so large that the JVM's heap grows with it."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def chunks(texts: list[bytes], limit: int = 1 << 20):
    """Runs (first, last) of consecutive texts of about limit bytes together; one long text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


M64 = (1 << 64) - 1


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-spread 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & M64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two primes under 2**31, and a base for each. A prime modulus, as long words with a regular structure have equal
#: polynomial hashes modulo a power of two.
PRIMES, BASES = (2147483647, 2147483629), (1270513943, 1824019577)
_powers: list[np.ndarray] = []
_LOW = np.arange(1, 257, dtype=np.uint64)
_LOW[65:91] = _LOW[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are hashed at once, but for a longer word.
SEGMENT = 1 << 20


def _power_tables(n: int) -> list[np.ndarray]:
    """base**i modulo prime, for n values of i at least, by doubling."""
    if not _powers:
        _powers.extend(np.ones(1, dtype=np.uint64) for _ in PRIMES)
    for k, (p, b) in enumerate(zip(PRIMES, BASES)):
        while len(_powers[k]) < n:
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(b, len(_powers[k]), p)) % np.uint64(p)])
    return _powers


def _hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of buf, and where they start."""
    edge = np.diff(_SPACE[buf].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    value = _LOW[buf[at + np.repeat(starts, sizes)]]
    parts = []
    for p, up in zip(PRIMES, _power_tables(int(sizes.max()))):
        term = value * up[at]
        if sizes.max() >= 1 << 24:  # else the sums of 39-bit terms fit
            term %= np.uint64(p)
        parts.append(np.add.reduceat(term, firsts) % np.uint64(p))
    with np.errstate(over="ignore"):
        return mix64(mix64((parts[0] << np.uint64(31)) | parts[1]) + sizes.astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts after lower-casing A-Z, and for each text the index after its last word."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    found, first = [], 0
    while first < len(buf):
        last = min(first + SEGMENT, len(buf))
        if last < len(buf) and not _SPACE[buf[last]]:  # cut where a word ends
            ends = np.flatnonzero(_SPACE[buf[first:last]])
            while not len(ends):
                more = np.flatnonzero(_SPACE[buf[last : last + SEGMENT]])
                ends, last = (more + last - first, last) if len(more) else (more, last + SEGMENT)
            last = first + int(ends[-1]) + 1 if ends[-1] < SEGMENT else first + int(ends[0]) + 1
        h, starts = _hashes(buf[first:last])
        found.append((h, starts + first))
        first = last
    h, starts = (np.concatenate(x) for x in zip(*found))
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return h, np.searchsorted(starts, stops)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of width words; of fewer words, one hash of them all; of none, nothing."""
    h, stops = word_hashes(texts)
    n = len(h)
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        k = np.uint64(0xC2B2AE3D27D4EB4F)
        acc = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        for j in range(width if len(acc) else 0):
            acc = acc * k + h[j : j + len(acc)]
        acc = mix64(acc)
        first = 0
        for stop in stops.tolist():
            if stop - first >= width:
                out.append(np.unique(acc[first : stop - width + 1]))
            elif stop > first:
                a = np.uint64(stop - first)
                for x in h[first:stop]:
                    a = a * k + x
                out.append(mix64(np.array([a ^ np.uint64(0x5BD1E9955BD1E995)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            first = stop
    return out


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """name, or with so many underscores behind it that df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def long_schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)
