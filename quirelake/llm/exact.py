"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, long_schema, sized, small_batches, staged

#: Three primes under 2**31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1664525007, 1015568748)
CHUNK = 1 << 16
_pow: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """base**i modulo prime for i up to CHUNK, by doubling."""
    if not _pow:
        for p, b in zip(PRIMES, BASES):
            t = np.ones(1, dtype=np.uint64)
            while len(t) <= CHUNK:
                t = np.concatenate([t, t * np.uint64(pow(b, len(t), p)) % np.uint64(p)])
            _pow.append(t[: CHUNK + 1])
    return _pow


def chunk_print(data: bytes) -> tuple[int, ...]:
    """Fingerprint of at most CHUNK bytes: sum of (byte + 1) * base**(bytes after it), one value for each prime."""
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)[::-1] + np.uint64(1)
    return tuple(int(np.dot(a, t[: len(a)]) % np.uint64(p)) for t, p in zip(_tables(), PRIMES))


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """The fingerprint of two strings one after the other: the left one shifted by the right one's length, plus the right one."""
    return tuple((x * pow(b, right_length, p) + y) % p for x, y, b, p in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> tuple[int, ...]:
    out = (0,) * len(PRIMES)
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        out = combine(out, chunk_print(part), len(part))
    return out


def same_bytes(a: bytes, b: bytes) -> bool:
    """Chunk by chunk, up to the first that differs."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _prints(batches):
    for batch in batches:
        rows = [(x.lower(), h) for x, h in zip(as_bytes(batch.column("text")), batch.column("huge").to_pylist())]
        prints = [None if h else list(fingerprint(x)) for x, h in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rk"), pa.array([len(x) for x, _ in rows], pa.int64()), pa.array(prints, pa.list_(pa.int64())), pa.array([hashlib.sha256(x).hexdigest() for x, _ in rows])],
            ["doc_id", "rk", "length", "print", "sha"],
        )


def _part_prints(batches):
    for batch in batches:
        parts = [x.lower() for x in as_bytes(batch.column("part"))]
        prints = []
        for x, after in zip(parts, batch.column("after").to_pylist()):
            prints.append([v * pow(b, after, p) % p for v, b, p in zip(fingerprint(x), BASES, PRIMES)])
        yield pa.RecordBatch.from_arrays([batch.column("rk"), batch.column("part_no"), *(pa.array([v[i] for v in prints], pa.int64()) for i in range(3))], ["rk", "part_no", "p0", "p1", "p2"])


def prints_of(docs: DataFrame, huge_chars: int = 8 << 20, part_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, rk, length, print, sha) of rows (doc_id, rk, text); texts over huge_chars are cut and their parts hashed in parallel."""
    size = F.length("text")
    flat = docs.withColumn("huge", F.coalesce(size > huge_chars, F.lit(False))).select("doc_id", "rk", "text", "huge").mapInArrow(_prints, long_schema("doc_id long, rk long, length long, print array<long>, sha string"))
    flat = staged(flat, "flat-prints")
    left = flat.where(F.col("print").isNull())
    if left.isEmpty():
        return flat
    large = docs.where(size > huge_chars).dropDuplicates(["rk"]).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / part_chars).cast("int"))))
    cut = large.withColumn("start", F.col("part_no") * part_chars + 1)
    parts = cut.select("rk", "part_no", F.substring("text", F.col("start"), F.lit(part_chars)).alias("part"), F.octet_length(F.substring("text", F.col("start") + part_chars, F.lit(2147483647))).cast("long").alias("after"))
    summed = parts.repartition("rk", "part_no").mapInArrow(_part_prints, long_schema("rk long, part_no int, p0 long, p1 long, p2 long")).groupBy("rk").agg(*(F.pmod(F.sum(f"p{i}"), F.lit(p)).alias(f"p{i}") for i, p in enumerate(PRIMES)))
    whole = summed.select("rk", F.array("p0", "p1", "p2").alias("whole"))
    return flat.where(F.col("print").isNotNull()).unionByName(left.join(whole, "rk").select("doc_id", "rk", "length", F.col("whole").alias("print"), "sha"))


def _compare(batches):
    """Rows come sorted by group and salt, the leader first; each is compared with its leader."""
    group, leader = None, b""
    for batch in batches:
        texts, out = [t.lower() for t in as_bytes(batch.column("text"))], []
        for text, is_leader, *key in zip(texts, *(batch.column(c).to_pylist() for c in ("is_leader", "print", "length", "salt"))):
            if is_leader:
                group, leader = key, text
                out.append(True)
            else:
                assert group == key, "a leader must come first"
                out.append(same_bytes(leader, text))
        keep = pa.array([not x for x in batch.column("is_leader").to_pylist()])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rk")), pa.array(out)], ["doc_id", "rk", "same"]).filter(keep)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = 500, huge_chars: int = 8 << 20) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; texts are equal if they are after lower-casing A-Z.

    A text's fingerprint is a polynomial in three primes; those of chunks combine by length-shifted arithmetic, so a huge
    text is hashed in parts in parallel. Rows of equal length and fingerprint are compared chunk by chunk with their group's
    leader (largest id) in a stream; each group is salted into pieces of about salt_rows rows, each with a copy of the
    leader, so no task gets a whole hot group. A row that differs from its leader in spite of an equal fingerprint is
    grouped by its SHA-256.

    Null text counts as empty. The row with the largest id stays; of rows that repeat that id too, each counts in group_size,
    and all of them are kept rows. Null ids are smaller than any other. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), text.alias("text"))
    # a number for each row, fixed once it is written: salts of rows that are the same in all else
    prints = staged(prints_of(rows, huge_chars).withColumn("no", F.monotonically_increasing_id()), "prints")
    key = ["print", "length"]
    groups = prints.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rk")).alias("top")).where("n > 1")
    groups = staged(groups.select(*key, "n", F.col("top.doc_id").alias("top_id"), F.col("top.rk").alias("top_rk")), "groups")
    placed = staged(prints.join(sized(groups), key, "left"), "placed")
    grouped = placed.where(F.col("n").isNotNull())

    members = staged(grouped.select("doc_id", "rk", *key, "n", "top_id", "top_rk").dropDuplicates(["doc_id", "rk"]), "members")
    salts = F.ceil(F.col("n") / salt_rows).cast("int")
    found = rows.join(sized(members).withColumnRenamed("doc_id", "m_id").withColumnRenamed("rk", "m_rk"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("rk") == F.col("m_rk")))
    found = found.select("doc_id", "rk", "text", *key, "n", (F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("rk") == F.col("top_rk"))).alias("top"))
    plain = found.select("doc_id", "rk", "text", *key, F.pmod(F.xxhash64("doc_id", "rk"), salts).cast("int").alias("salt"), F.lit(False).alias("is_leader"))
    lead = found.where("top").dropDuplicates(["doc_id", "rk"]).select("doc_id", "rk", "text", *key, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("is_leader"))
    stream = plain.unionByName(lead).repartition(*key, "salt").sortWithinPartitions(*key, "salt", F.desc("is_leader"))
    checked = stream.mapInArrow(_compare, long_schema("doc_id long, rk long, same boolean"))
    odd = staged(checked.where("not same").select("doc_id", "rk").distinct().withColumn("odd", F.lit(True)), "collided")

    odd = sized(odd.withColumnRenamed("doc_id", "o_id").withColumnRenamed("rk", "o_rk"))
    labelled = grouped.join(odd, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("rk") == F.col("o_rk")), "left").withColumn("own", F.when(F.col("odd"), F.col("sha")).otherwise("")).select("doc_id", *key, "own", "sha", "n", "no")
    # each group's result meets its rows in as many pieces as the group was compared in
    final = staged(labelled.groupBy(*key, "own").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.first("n").alias("n")), "kept")
    pieces = final.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    out = labelled.withColumn("salt", F.pmod("no", salts).cast("int")).join(pieces, [*key, "own", "salt"])
    done = out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = placed.where(F.col("n").isNull())
    return done.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")))
