"""Packing documents into sequences by vector best-fit."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_schema, small_batches, staged

LENGTH = 1024
#: Pieces that one task packs; more pieces, more tasks.
PIECES = 8192
#: Runs of white space from which tiktoken's pattern, whose stack grows with the run, isn't asked (it overflows near 1,000,000).
RUN = re.compile(r"\s{1000}")
_encoders: dict[str, Callable] = {}


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian 32-bit ids, as by tokenizers without a template's tokens: an added token's string is that token.

    A .json file is read by tokenizers. A .tiktoken file of ranks is read by tiktoken, which gives the same ids in a sixth of
    the time, but knows no added tokens and fails on long runs of white space: texts with either go to tokenizers and the .json
    file of the same name beside it, which is loaded when the first such text comes.
    """
    if path not in _encoders:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            one = Tokenizer.from_file(path)
            _encoders[path] = lambda texts: [array("I", e.ids).tobytes() for e in one.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            beside = path.removesuffix(".tiktoken") + ".json"
            with open(beside, encoding="utf-8") as f:
                added = [t["content"] for t in json.load(f)["added_tokens"]]
            slow = lambda t: any(a in t for a in added) or RUN.search(t) is not None
            _encoders[path] = lambda texts: [encoder(beside)([t])[0] if slow(t) else array("I", own.encode_ordinary(t)).tobytes() for t in texts]
    return _encoders[path]


def _pieces(path: str, end_id: int, length: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        for batch in batches:
            rows = []
            coded = encode([t or "" for t in batch.column("text").to_pylist()])
            for key, rk, ids in zip(batch.column("doc_id").to_pylist(), batch.column("rk").to_pylist(), coded):
                ids += end
                n = len(ids) // 4
                # the first piece takes what doesn't fill a sequence, so all others are full
                first = n % length or length
                bounds = [0, *range(first, n + 1, length)]
                rows += [(key, rk, i, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for i, (s, e) in enumerate(zip(bounds, bounds[1:]))]
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "rk", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """items (n, d), in the order they are placed; returns the bin of each.

    Of the open bins that hold an item under every capacity: rule 'norm' takes the one with the least weighted norm of what is
    then left, 'dot' the one whose residual has the largest weighted dot product with the item; ties go to the older bin.
    """
    scaled, w = items / capacity, weights / weights.sum()
    left = np.empty((64, items.shape[1]))
    names = np.empty(64, dtype=np.int64)
    where = np.empty(len(items), dtype=np.int64)
    least = np.minimum.accumulate(scaled[::-1], axis=0)[::-1]
    bins = open_ = 0
    eps = 1e-12
    for i, x in enumerate(scaled):
        rest = left[:open_]
        fits = np.flatnonzero((rest >= x - eps).all(axis=1))
        if len(fits):
            r = rest[fits]
            k = fits[np.argmax((r * x * w).sum(axis=1)) if rule == "dot" else np.argmin((w * (r - x) ** 2).sum(axis=1))]
        else:
            if open_ == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            k, left[open_], names[open_] = open_, 1.0, bins
            bins, open_ = bins + 1, open_ + 1
        left[k] -= x
        where[i] = names[k]
        if i + 1 < len(items) and (left[k] < least[i + 1] - eps).any():  # nothing that follows fits: closed
            left[k : open_ - 1], names[k : open_ - 1] = left[k + 1 : open_].copy(), names[k + 1 : open_].copy()
            open_ -= 1
    return where


def _packed(length: int, docs_cap: int, cost_cap: float, weights: tuple[float, ...], rule: str):
    """A task's pieces, longest first (ties by id and piece), into bins of its own."""

    def run(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        n = table.column("length").to_numpy()
        ids = table.column("doc_id").to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("piece").to_numpy(), table.column("rk").to_numpy(), ids, -n))
        size = n[order].astype(float)
        items = np.stack([size, np.ones(len(size)), size * size], axis=1)
        bins = best_fit(items, np.array([length, docs_cap, cost_cap], dtype=float), np.array(weights, dtype=float), rule)
        by_bin = np.argsort(bins, kind="stable")
        placed = n[order][by_bin]
        before = np.concatenate([[0], np.cumsum(placed)[:-1]])
        firsts = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
        offset = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(placed))))
        table = table.take(pa.array(order[by_bin]))
        table = table.append_column("sequence_id", pa.array((np.int64(part) << 40) | bins[by_bin])).append_column("offset", pa.array(offset))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, piece, start, length, ids_crc32): every document's ids and end_id, cut into at most length each."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(path, end_id, length), long_schema("doc_id long, rk long, piece int, start long, length long, ids_crc32 long"))


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, docs_cap: int | None = None, cost_cap: float | None = None, weights=(1.0, 1e-6, 1e-6), rule: str = "norm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Only documents of over length ids are cut; the first piece takes the remainder. Sequences have three capacities: tokens,
    pieces (docs_cap) and attention cost, the sum of squared lengths (cost_cap); unset, the last two never bind, as for as few
    sequences as possible. Full pieces are sequences by themselves. The others are dealt by a hash over tasks of about PIECES
    pieces, and each task packs its own by best-fit decreasing: of large sets the loss to one big packing is under a
    sequence a task. Reruns agree.

    Null and empty texts: one piece, the end id. Null ids are packed like others. Rows that repeat are packed each. An empty
    table gives an empty result. docs_cap under 1 or cost_cap under length**2 are refused: some piece could not be placed.
    """
    docs_cap = docs_cap or length
    cost_cap = cost_cap or float(length) ** 2
    if docs_cap < 1 or cost_cap < float(length) ** 2:
        raise ValueError("a full piece must fit a sequence")
    cut = staged(pieces(docs, path, end_id, length, id_col, text_col), "pieces")
    rest = cut.where(F.col("length") < length)
    tasks = max(1, -(-rest.count() // PIECES))
    schema = long_schema("doc_id long, rk long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    filled = rest.repartition(tasks, F.xxhash64("doc_id", "rk", "piece")).mapInArrow(_packed(length, docs_cap, cost_cap, tuple(weights), rule), schema)
    full = cut.where(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return filled.unionByName(full).drop("rk")
