"""Near-duplicate detection by b-bit MinHash."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, long_schema, mix64, shingle_sets, sized, small_batches, splitmix, staged
from .components import components, grown

HASHES, ROWS, BITS = 80, 4, 4
LANES = 64 // BITS
#: Estimates this many standard errors under the threshold are still confirmed.
SLACK = 4.5
#: Members of unlike components meet by pairs in buckets of at most SMALL members, and by blocks of BLOCK members in larger ones;
#: with their full sets, by blocks of about so many shingles if that is less.
SMALL, BLOCK, BLOCK_SHINGLES = 8, 1024, 1 << 20


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """Of each non-empty set the least value under each of the hashes."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), hashes), dtype=np.uint64)
    add, mul = splitmix(hashes, 21), splitmix(hashes, 22) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(hashes):
            out[:, i] = np.minimum.reduceat((values ^ add[i]) * mul[i], starts)
    return out


def band_keys(low: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each run of rows minima."""
    bands = low.shape[1] // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(splitmix(bands, 23), (len(low), bands)).copy()
        for j in range(rows):
            key = mix64(key ^ low[:, j::rows][:, :bands]) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def pack(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    lanes = 64 // bits
    kept = (low & np.uint64((1 << bits) - 1)).reshape(len(low), -1, lanes)
    return np.bitwise_or.reduce(kept << (np.arange(lanes, dtype=np.uint64) * np.uint64(bits)), axis=2)


_ONES = np.uint64(sum(1 << (i * BITS) for i in range(LANES)))


def unequal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many lanes differ: bits of each lane are folded onto its lowest one and counted."""
    d = x ^ y
    s = BITS
    while s > 1:
        s //= 2
        d = d | (d >> np.uint64(s))
    return np.bitwise_count(d & _ONES).sum(axis=-1, dtype=np.int64)


def estimate(differ: np.ndarray, hashes: int = HASHES, bits: int = BITS) -> np.ndarray:
    """Similarity from unequal lanes, corrected for lanes that agree by chance."""
    c = 0.5**bits
    return (1 - differ / hashes - c) / (1 - c)


def most_unequal(threshold: float) -> int:
    """The largest number of unequal lanes within SLACK standard errors of the threshold."""
    c = 0.5**BITS
    p = threshold * (1 - c) + c
    return math.floor(HASHES * (1 - p + SLACK * math.sqrt(p * (1 - p) / HASHES)))


def _signatures(width: int):
    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            sizes, classes, packed, keys = [], [], [], []
            for first, last in chunks(texts, 1 << 19):
                sets = shingle_sets(texts[first:last], width)
                full = [s for s in sets if len(s)]
                if full:
                    low = minima(full)
                    made = iter(zip(pack(low), band_keys(low)))
                for s in sets:
                    sizes.append(len(s))
                    classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig, key = next(made) if len(s) else (None, None)
                    packed.append(None if sig is None else sig.tobytes())
                    keys.append(None if key is None else key.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "cls", "sig", "bands"],
            )

    return run


def _estimated(limit: int, floor: float):
    """Of the pairs (a, b, n_a, n_b, sig_a, sig_b) those that may be similar enough, with the number of unequal lanes."""

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            differ = unequal(_signs(batch, "sig_a"), _signs(batch, "sig_b"))
            ok = (differ <= limit) & (np.minimum(n_a, n_b) >= floor * np.maximum(n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ)], ["a", "b", "differ"]).filter(pa.array(ok))

    return run


def _by_group(keys: tuple[str, ...], done):
    """Rows come sorted by keys: done() gets tables of whole groups and yields record batches."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cols = [held.column(c).to_numpy() for c in keys]
            same = np.logical_and.reduce([k == k[-1] for k in cols])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def _groups(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where each group starts, and its size."""
    cols = np.stack([table.column(c).to_numpy() for c in keys])
    new = np.flatnonzero(np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(axis=0)]))
    return new, np.diff(np.append(new, table.num_rows))


def _signs(table, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)


def _set_views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column, without copies."""
    out = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = memoryview(chunk.buffers()[2] or b"")
        out += [np.frombuffer(data[a:b], dtype=np.uint64) for a, b in zip(ends, ends[1:])]
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    x, y = (x, y) if len(x) < len(y) else (y, x)
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


KEYS = ("key", "kind", "bi", "bj")


class _Blocks:
    """The blocks of a table of members, and in each the pairs to look at."""

    def __init__(self, table: pa.Table, limit: int, floor: float):
        self.ids, self.n, self.comp, self.major, self.kind, self.keys = (table.column(c).to_numpy() for c in ("node", "n", "comp", "major", "kind", "key"))
        self.sig, self.bands = _signs(table), np.array(table.column("bands").to_pylist(), dtype=np.int64)
        self.starts, self.sizes, self.limit, self.floor = *_groups(table, KEYS), limit, floor

    def near(self, first: int, size: int):
        """Of a block (i, the places after it of members of unlike components that may be similar enough, and share no earlier
        band: there they meet as well). In a block of kind 0 members of the major component meet the others alone."""
        s = slice(first, first + size)
        n, comp, major, sig, bands = self.n[s], self.comp[s], self.major[s], self.sig[s], self.bands[s]
        if size < 2 or (comp == comp[0]).all():
            return
        place = int(np.flatnonzero(bands[0] == self.keys[first])[0])
        for i in range(size - 1):
            ok = (comp[i + 1 :] != comp[i]) & (np.minimum(n[i], n[i + 1 :]) >= self.floor * np.maximum(n[i], n[i + 1 :]))
            if not self.kind[first]:
                ok &= major[i + 1 :] != major[i]
            j = np.flatnonzero(ok) + i + 1
            j = j[unequal(sig[j], sig[i]) <= self.limit]
            if place:
                j = j[~(bands[j, :place] == bands[i, :place]).any(axis=1)]
            if len(j):
                yield first + i, first + j


def _worth_a_look(limit: int, floor: float):
    """(key, node): members of blocks that have a candidate in another component."""

    def done(table):
        b = _Blocks(table, limit, floor)
        seen = np.zeros(len(b.ids), dtype=bool)
        for first, size in zip(b.starts, b.sizes):
            for i, j in b.near(first, size):
                seen[i] = seen[j] = True
        return pa.RecordBatch.from_arrays([pa.array(b.keys[seen], pa.int64()), pa.array(b.ids[seen], pa.int64())], ["key", "node"])

    return _by_group(KEYS, done)


def _links_of_apart(limit: int, threshold: float):
    """Of each block links that join what isn't connected yet. The members bring their full sets, so candidates are confirmed here
    and no pair leaves the task but the links of a spanning forest."""
    top = round(threshold * 100)

    def done(table):
        b, sets, out = _Blocks(table, limit, threshold), _set_views(table.column("set")), []
        for first, size in zip(b.starts, b.sizes):
            parent = {c: c for c in b.comp[first : first + size].tolist()}

            def root(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for i, places in b.near(first, size):
                for k in places:
                    if (x := root(b.comp[i])) != (y := root(b.comp[k])):
                        common = _common(sets[i], sets[k])
                        if 100 * common >= top * (b.n[i] + b.n[k] - common):
                            parent[y] = x
                            out.append((b.ids[i], b.ids[k]))
        ab = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ab.min(axis=1), pa.int64()), pa.array(ab.max(axis=1), pa.int64())], ["a", "b"])

    return _by_group(KEYS, done)


def _dealt(members: DataFrame, shingles: int | None = None) -> DataFrame:
    """members (key, node, comp, n) -> (*KEYS, node, comp, major): blocks of BLOCK members, or of so many shingles in all, in which all members of unlike components of a key meet.

    Of each key the largest component is the major one: its members meet the others, block by block (kind 0), but not each other; the
    others meet each other (kind 1). With m members of the major component and s others these are m * s / BLOCK + s * (m + s) / BLOCK
    rows and a row for each member at least: in proportion to the bucket as long as m or s fit a block.
    """
    heavy = F.sum("n") / shingles if shingles else F.lit(0)
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n_comp"), F.greatest(F.count("*") / BLOCK, heavy).alias("need"))
    tops = parts.groupBy("key").agg(F.max(F.struct("n_comp", "need", "comp")).alias("top"), F.sum("need").alias("need"))
    tops = tops.select("key", F.col("top.comp").alias("top"), F.ceil("top.need").cast("int").alias("m"), F.ceil(F.col("need") - F.col("top.need") + 1e-9).cast("int").alias("s"))
    rows = members.join(tops, "key").withColumn("major", F.col("comp") == F.col("top"))
    own = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("m")).otherwise(F.col("s"))).cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("bi"), j.cast("int").alias("bj"))
    mine = F.col("own")
    cells = F.when(F.col("major"), F.transform(every("s"), lambda j: cell(0, mine, j))).otherwise(F.concat(F.transform(every("m"), lambda i: cell(0, i, mine)), F.transform(every("s"), lambda j: cell(1, F.least(mine, j), F.greatest(mine, j)))))
    return own.withColumn("cell", F.explode(cells)).select("key", "cell.kind", "cell.bi", "cell.bj", "node", "comp", "major")


def _sets(width: int):
    """(node, set): the full shingle set of each text, if it is that of its class."""

    def run(batches):
        for batch in batches:
            texts, sets = as_bytes(batch.column("text")), []
            for first, last in chunks(texts, 1 << 19):
                sets += shingle_sets(texts[first:last], width)
            own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == c for s, c in zip(sets, batch.column("cls").to_pylist())]
            made = pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])
            yield made.filter(pa.array(own, pa.bool_()))

    return run


def _confirm(width: int, threshold: float):
    """Exact similarity of the full shingle sets of each pair of texts; the set of a is kept while pairs share it."""
    top, whole = round(threshold * 100), 100

    def run(batches):
        key, kept = None, None
        for batch in batches:
            a, b, ca, cb = (batch.column(c).to_pylist() for c in ("a", "b", "cls_a", "cls_b"))
            ta, tb = batch.column("text_a"), batch.column("text_b")
            ok = []
            others = as_bytes(tb)
            sets_b: list[np.ndarray] = []
            for first, last in chunks(others, 1 << 19):
                sets_b += shingle_sets(others[first:last], width)
            for i in range(len(a)):
                if key != (a[i], ca[i]):
                    text = ta[i].as_py()
                    key, kept = (a[i], ca[i]), shingle_sets([b"" if text is None else text.encode("utf-8", "surrogatepass")], width)[0]
                common = _common(kept, sets_b[i]) if len(kept) and len(sets_b[i]) else 0
                ok.append(whole * common >= top * (len(kept) + len(sets_b[i]) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "ok"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; documents whose shingle sets have a Jaccard similarity of at
    least threshold (two decimals) are linked, and component_id is the smallest id reachable.

    1. One pass over the texts: distinct shingles, HASHES minima, the low BITS of each packed, and a key for each band of ROWS.
       At a similarity of 0.8 a pair shares no band in under 3 of 100,000 cases.
    2. Equal sets are one class, its node the smallest id. Classes that share a band key are a bucket. Each member is paired with the
       smallest one of its bucket; bit counts of the packed signatures estimate the similarity, and what is within SLACK standard
       errors of the threshold is confirmed on the full sets: first each member's most similar pair, then those of the
       others that still join two components. So a bucket costs its length.
    3. Buckets that then hold several components: there members of unlike components meet, by pairs in small buckets, else in
       blocks, first with their signatures, then those that have candidates with their full sets. No link is lost and a
       group isn't expanded to pairs; only members that are alike by band but never linked cost more than their number.
    4. Components of the confirmed links.

    Words: runs without 0x20 and 0x09-0x0D, A-Z lower-cased. Texts with fewer words than width: the whole sequence is the one
    shingle. Null texts and texts without words: 0 shingles, linked with nothing. Rows that repeat an id are one
    document. Rows with a null id get a null component_id and are kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(rows.mapInArrow(_signatures(width), long_schema("doc_id long, n_shingles long, cls binary, sig binary, bands array<long>")), "signed")
    known = signed.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    classes = staged(known.groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    met = staged(keyed.join(shared, "key"), "met")
    limit = most_unequal(threshold)
    pair_schema = long_schema("a long, b long")
    class_of = classes.select("node", "cls")
    signs = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))

    def likely(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> those whose estimate is near the threshold, with differ."""
        full = pairs.join(signs("b"), "b").join(signs("a"), "a").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
        return full.mapInArrow(_estimated(limit, threshold), long_schema("a long, b long, differ long"))

    def texts_of(nodes: DataFrame, tag: str) -> DataFrame:
        """nodes (node) -> (node, cls, text): a text of each class."""
        named = sized(staged(nodes.join(class_of, "node").select("node", "cls"), f"nodes-{tag}"))
        return rows.where(F.col("doc_id").isNotNull()).join(named, F.col("doc_id") == F.col("node")).select("node", "cls", "text")

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """Those of the staged pairs (a, b) whose full sets are similar enough."""
        if pairs.isEmpty():
            return pairs
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), tag)
        texts = staged(texts.dropDuplicates(["node", "cls"]), f"texts-{tag}")
        b = texts.select(F.col("node").alias("b"), F.col("cls").alias("cls_b"), F.col("text").alias("text_b"))
        a = texts.select(F.col("node").alias("a"), F.col("cls").alias("cls_a"), F.col("text").alias("text_a"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", "cls_a", "cls_b", "text_a", "text_b")
        return staged(both.mapInArrow(_confirm(width, threshold), long_schema("a long, b long, ok boolean")).where("ok").select("a", "b"), f"links-{tag}")

    def unlike(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that comps doesn't connect."""
        side = lambda s: comps.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"))
        named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return named.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    def members_apart(buckets: DataFrame, comps: DataFrame) -> DataFrame:
        """(key, node, comp) of the buckets that hold several components."""
        named = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return named.join(apart, "key").select("key", "node", "comp")

    stars = staged(likely(met.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()), "stars")
    firsts = stars.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = confirmed(staged(firsts, "firsts"), "firsts")
    comps = components(links)

    few = members_apart(met.where(F.col("size").between(3, SMALL)), comps)
    other = few.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    pairs = few.select("key", F.col("node").alias("a"), "comp").join(other, "key").where("a < b AND comp != comp_b").select("a", "b").distinct()
    others = unlike(stars.select("a", "b"), comps).union(likely(pairs.join(stars, ["a", "b"], "left_anti")).select("a", "b"))
    # the most similar pairs that weren't confirmed aren't tried again
    more = confirmed(staged(others.distinct().join(firsts, ["a", "b"], "left_anti"), "others"), "others")
    if not more.isEmpty():
        comps = grown(comps, more)

    wide = staged(members_apart(met.where(F.col("size") > SMALL), comps).join(classes.select("node", "n"), "node"), "apart")
    if not wide.isEmpty():
        grouped = lambda rows: rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
        payload = [*KEYS, "node", "comp", "major", "n", "sig", "bands"]
        looked = grouped(_dealt(wide).join(classes.select("node", "n", "sig", "bands"), "node").select(*payload))
        seen = staged(looked.mapInArrow(_worth_a_look(limit, threshold), long_schema("key long, node long")).distinct(), "seen")
        some = staged(wide.join(seen, ["key", "node"]), "some")
        sets = texts_of(some.select("node").distinct(), "apart").mapInArrow(_sets(width), long_schema("node long, set binary")).dropDuplicates(["node"])
        full = classes.select("node", "n", "sig", "bands").join(sets, "node")
        meet = grouped(_dealt(some, BLOCK_SHINGLES).join(full, "node").select(*payload, "set"))
        late = staged(meet.mapInArrow(_links_of_apart(limit, threshold), pair_schema), "late-links")
        if not late.isEmpty():
            comps = grown(comps, late)
    named = class_of.join(comps, "node", "left").select("cls", F.coalesce("comp", "node").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
