"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, sized, staged

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A source's ranks are summed in so many bins at most before one is looked at more closely.
BINS = 4096


def source_targets(sizes: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """sizes (src, source_size) -> with target: share of all sizes by weight, each at most `most` times its source's size.

    What the capped sources can't take goes to the others by weight until none is above: the level, a target for each unit of weight,
    rises until the sources whose cap is under it stay the same. Ranks come from a sort by ranges with counts ahead of each
    range, and each step of the level is a sum, so there may be as many sources as hosts.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    ranked = numbered(sizes, F.col("src").asc_nulls_last()).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = staged(ranked.select("src", "source_size", "w", "cap"), "weights")
    n, every, rest = ranked.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    goal, under, level = every * float(share), 0, None
    while under < n:
        level = goal / rest if level is None else level
        full = ranked.where(F.col("cap") / F.col("w") < F.lit(level)).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if full[0] == under:
            break
        under = full[0]
        level = (goal - full[1]) / (rest - full[2]) if under < n else None
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("w") * F.lit(level))
    return ranked.select("src", "source_size", target.alias("target"))


def root_of_size(size: Column) -> Column:
    """Inclusion odds that favour long documents by the root of their words."""
    return F.floor(F.sqrt(size))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", odds: Callable[[Column], Column] | str | None = root_of_size, seed: str = "mix", near: float = 0.001, bucket_rows: int = 512) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, rank_odds) of every row.

    Each document of a source gets floor(target / source size) certain whole copies. What is left of the target is a sample
    of fixed size, in words: documents are ranked by their random odds u/(1-u) divided by their inclusion odds p/(1-p) (Pareto
    order sampling) and in that order one more copy is taken of each that still fits, to the last. p is in proportion to the odds
    (a function of the size, or a column of docs; None: equal), such that the expected words are what is left, at most
    0.999. rank_odds is r/(1+r) of the ranking odds r.

    u comes from a hash of the id and the seed, so reruns agree. No source is gathered in one task: ranks are summed in BINS bins. All
    before the bin in which the words left are passed are taken; that bin is split again until it has about bucket_rows
    rows, and those alone are filled one by one. Then the rest of the order goes on with the documents that fit what room is
    left, until none does: a few rounds, each of sums.

    Where that misses a target by more than its near-th part, as long documents were passed over when the short ones had been
    taken, the first one in order that was passed over and isn't above what is left of the target goes first, and the order is
    filled again without it and rows equal to it. Of both fillings the nearer one stands, the first if they are equal.

    Null or empty text: size 0, taken 0. Null sources are one source, the last. Null ids hash as the empty string. Ties go
    by id, then by size; rows that repeat id and size are interchangeable and are counted, not gathered. An empty table
    gives an empty result.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    own = F.col(odds) if isinstance(odds, str) else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("src"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"), own.alias("own"))
    weight = F.greatest(F.coalesce(F.col("own").cast("double"), F.lit(0.0)), F.lit(0.0)) if isinstance(odds, str) else odds(F.col("size")) if odds else F.lit(1)
    rows = staged(rows.withColumn("weight", weight).drop("own"), "sizes")
    totals = staged(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.sum(F.col("size") * F.col("weight")).alias("mass"), F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(1)).alias("smallest")), "totals")
    plan = source_targets(totals.select("src", "source_size"), share, most).join(totals.select(F.col("src").alias("s2"), "n", "mass", "smallest"), F.col("src").eqNullSafe(F.col("s2"))).drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("src", "s2")
    plan = staged(plan, "targets")

    same = F.col("src").eqNullSafe(F.col("s2"))
    p = F.least(F.lit(0.999), F.when(F.col("mass") > 0, F.col("left") * F.col("weight") / F.col("mass")).otherwise(0.0))
    q = F.when((p > 0) & (F.col("size") > 0), (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    ranked = rows.join(sized(plan), same).withColumn("x", q / (1 + q)).drop("s2", "u", "weight", "mass", "n", "left", "smallest")
    ranked = staged(ranked, "ranked")

    first, missed = _decided(ranked, plan.select("s2", F.col("left").alias("room"), "n", "smallest"), plan, bucket_rows)
    poor = staged(plan.join(missed.withColumnRenamed("s2", "m2"), F.col("s2").eqNullSafe(F.col("m2"))).where((F.col("left") >= 1) & (F.col("room") > near * F.col("target"))).select("s2", "room", "left", "n", "smallest"), "missed")
    if not poor.isEmpty():
        first = staged(first, "first-order")
        over = first.where("x IS NOT NULL AND NOT more").join(sized(poor), same).where("size <= left")
        again = staged(over.groupBy("s2", "room", "left", "n", "smallest").agg(F.min(F.struct("x", "doc_id", "size")).alias("lead")), "passed-over")
        if not again.isEmpty():
            is_lead = F.struct("x", "doc_id", "size").eqNullSafe(F.col("lead"))
            led = ranked.join(sized(again.select("s2", "lead")), same)
            second, missed = _decided(led.where(~is_lead).drop("s2", "lead"), again.select("s2", (F.col("left") - F.col("lead.size")).alias("room"), "n", "smallest"), plan, bucket_rows)
            nearer = again.join(missed.select(F.col("s2").alias("m2"), F.col("room").alias("left_over")), F.col("s2").eqNullSafe(F.col("m2")))
            nearer = sized(staged(nearer.where("left_over < room").select("s2"), "nearer"))
            leads = led.where(is_lead).groupBy(*[c for c in ranked.columns]).agg(F.count("*").alias("c")).withColumn("take", F.lit(1).cast("long"))
            better = second.unionByName(_each(leads))
            first = first.join(nearer, same, "left_anti").unionByName(better.join(nearer, same, "left_semi"))
    copies = F.col("whole") + F.when(F.col("more"), 1).otherwise(0)
    out = first.withColumn("copies", copies)
    return out.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("x").alias("rank_odds"))


def _decided(ranked: DataFrame, rooms: DataFrame, plan: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """ranked (src, x, doc_id, size, ..) with more, whether the row is taken when the rows of each source are filled into its room in
    the order of x; and the room left (s2, room) of the sources in rooms (s2, room, n, smallest), smallest their smallest size."""
    # where each source stands: ranks over `after` and from lo to hi are being decided, room is the words left
    wide = F.col("room") >= F.col("smallest")
    lines = staged(rooms.where(wide).select("s2", "room", F.lit(-1.0).alias("after"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), "n", "smallest"), "standing")
    spans, folds, ends = [], [], [rooms.where(~wide).select("s2", "room")]
    while not lines.isEmpty():
        edges = staged(_edges(ranked, lines, bucket_rows), "edges")
        spans.append(edges.select("s2", F.struct("after", "lo", F.when(F.col("found"), F.col("f_lo")).otherwise(F.col("hi")).alias("until"), (~F.col("found")).alias("closed"), F.col("room").alias("most")).alias("span")))
        filled = staged(_filled(ranked, edges.where("found AND NOT refine")), "filled")
        folds.append(filled)
        on = edges.where("refine").select("s2", F.col("room_left").alias("room"), "after", F.col("f_lo").alias("lo"), F.col("f_hi").alias("hi"), F.col("n_b").alias("n"), "smallest")
        past = edges.where("NOT found AND hi < 1").select("s2", F.col("room_left").alias("room"), F.col("hi").alias("after"), F.col("hi").alias("lo"), F.lit(1.0).alias("hi"), "n", "smallest")
        # where none of the ranks to be filled fits any more, the room stays as it is
        full = edges.where("found AND NOT refine").join(filled.select(F.col("s2").alias("e2"), "end"), F.col("s2").eqNullSafe(F.col("e2")), "left")
        after_fill = full.select("s2", F.coalesce("end", "room_left").alias("room"), F.col("f_hi").alias("after"), F.col("f_hi").alias("lo"), F.lit(1.0).alias("hi"), "n", "smallest")
        # sources without a candidate have no edge: they go on after the ranks in question, or end with the room that they had
        idle = lines.join(edges.select(F.col("s2").alias("e2")), F.col("s2").eqNullSafe(F.col("e2")), "left_anti")
        passed = idle.where("hi < 1").select("s2", "room", F.col("hi").alias("after"), F.col("hi").alias("lo"), F.lit(1.0).alias("hi"), "n", "smallest")
        going = on.unionByName(past).unionByName(after_fill).unionByName(passed)
        ends.append(idle.where("hi >= 1").select("s2", "room").unionByName(edges.where("NOT found AND hi >= 1").select("s2", F.col("room_left").alias("room"))).unionByName(going.where(~wide).select("s2", "room")))
        lines = staged(going.where(wide), "standing")
    if not spans:
        return ranked.withColumn("more", F.lit(False)), _union(ends)

    same = F.col("src").eqNullSafe(F.col("s2"))
    taken = sized(staged(_union(spans).groupBy("s2").agg(F.collect_list("span").alias("spans")), "spans"))
    gone = _union([f.select("s2", F.struct("f_lo", "f_hi", F.col("most").alias("f_most")).alias("fold")) for f in folds])
    gone = sized(staged(gone.groupBy("s2").agg(F.collect_list("fold").alias("folds")), "folds"))
    out = ranked.join(taken, same, "left").drop("s2").join(gone, same, "left").drop("s2")
    x, size = F.col("x"), F.col("size")
    inside = F.exists("spans", lambda s: (x > s["after"]) & (x >= s["lo"]) & ((x < s["until"]) | (s["closed"] & (x <= s["until"]))) & (size <= s["most"]))
    filled_in = F.exists("folds", lambda f: (x >= f["f_lo"]) & (x <= f["f_hi"]) & (size <= f["f_most"]))
    out = out.where(~F.coalesce(filled_in, F.lit(False))).withColumn("more", F.coalesce(inside, F.lit(False))).drop("spans", "folds")
    items = _union([f.select(F.col("s2").alias("src"), F.explode("items").alias("i")) for f in folds]).select("src", "i.*")
    about = sized(plan.select("s2", *(c for c in ranked.columns if c not in ("src", "x", "doc_id", "size"))))
    return out.unionByName(_each(items.join(about, same).drop("s2"))), _union(ends)


def _each(items: DataFrame) -> DataFrame:
    """items (.., c, take), each of which stands for c rows, as rows with more: true for the first take of them."""
    many = items.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 10_000))))
    each = many.withColumn("nth", F.explode(F.sequence(F.col("part") * 10_000 + 1, F.least(F.col("part") * 10_000 + 10_000, F.col("c")))))
    return each.withColumn("more", F.col("nth") <= F.col("take")).drop("c", "take", "part", "nth")


def _edges(ranked: DataFrame, lines: DataFrame, bucket_rows: int) -> DataFrame:
    """Of each source in lines: found, whether the words of the ranks in question pass its room; from f_lo to f_hi the ranks of the
    bin where they do, and of bins after it up to bucket_rows; refine, whether that bin has more rows and can be split; n_b its
    rows; room_left what is left before it."""
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300))
    bins = F.least(F.lit(BINS), F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)))
    state = ["s2", "room", "after", "lo", "hi", "n", "smallest"]
    mine = ranked.select("src", "size", "x").join(sized(lines), F.col("src").eqNullSafe(F.col("s2")) & (F.col("x") > F.col("after")) & F.col("x").between(F.col("lo"), F.col("hi")) & (F.col("size") <= F.col("room")))
    sums = mine.groupBy(*state, F.floor((F.col("x") - F.col("lo")) / span * bins).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("x").alias("least"), F.max("x").alias("largest"))
    by, upto = Window.partitionBy("s2"), Window.partitionBy("s2").orderBy("bin")
    sums = sums.withColumn("sum", F.sum("words").over(upto)).withColumn("b", F.min(F.when(F.col("sum") > F.col("room"), F.col("bin"))).over(by))
    at, past = F.col("bin") == F.col("b"), F.col("bin") >= F.col("b")
    sums = sums.withColumn("from_b", F.sum(F.when(past, F.col("rows"))).over(upto)).withColumn("n_b", F.max(F.when(at, F.col("rows"))).over(by))
    close = past & (F.col("from_b") <= F.greatest(F.lit(bucket_rows), F.col("n_b")))
    edge = sums.groupBy(*state).agg(F.first("b").isNotNull().alias("found"), F.coalesce(F.sum(F.when(F.col("b").isNull() | (F.col("bin") < F.col("b")), F.col("words"))), F.lit(0)).alias("before"), F.min(F.when(at, F.col("least"))).alias("f_lo"), F.max(F.when(at, F.col("largest"))).alias("b_hi"), F.max(F.when(close, F.col("largest"))).alias("last"), F.first("n_b").alias("n_b"))
    refine = F.col("found") & (F.col("n_b") > bucket_rows) & (F.col("f_lo") < F.col("b_hi"))
    edge = edge.withColumn("refine", F.coalesce(refine, F.lit(False))).withColumn("room_left", F.col("room") - F.col("before"))
    return edge.withColumn("f_hi", F.when(F.col("refine"), F.col("b_hi")).otherwise(F.col("last"))).drop("before", "b_hi", "last")


def _filled(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each source in edges the rows from f_lo to f_hi, filled one by one in the order of their ranks: (s2, f_lo, f_hi, most, n, items,
    end), items (x, doc_id, size, c, take) with the number of equal rows and of those that are taken, end the room left."""
    state = ["s2", "f_lo", "f_hi", "room_left", "n"]
    mine = ranked.select("src", "doc_id", "size", "x").join(sized(edges.select(*state)), F.col("src").eqNullSafe(F.col("s2")) & F.col("x").between(F.col("f_lo"), F.col("f_hi")) & (F.col("size") <= F.col("room_left")))
    equal = mine.groupBy(*state, "x", "doc_id", "size").agg(F.count("*").alias("c"))
    lists = equal.groupBy(*state).agg(F.array_sort(F.collect_list(F.struct("x", "doc_id", "size", "c"))).alias("all"))
    start = F.struct(F.col("room_left").alias("room"), F.expr("CAST(array() AS array<struct<x:double,doc_id:bigint,size:bigint,c:bigint,take:bigint>>)").alias("out"))

    def place(acc, i):
        take = F.least(i["c"], F.floor(acc["room"] / i["size"]))
        item = F.struct(i["x"].alias("x"), i["doc_id"].alias("doc_id"), i["size"].alias("size"), i["c"].alias("c"), take.alias("take"))
        return F.struct((acc["room"] - take * i["size"]).alias("room"), F.concat(acc["out"], F.array(item)).alias("out"))

    done = lists.withColumn("done", F.aggregate("all", start, place))
    return done.select("s2", "f_lo", "f_hi", F.col("room_left").alias("most"), "n", F.col("done.out").alias("items"), F.col("done.room").alias("end"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
