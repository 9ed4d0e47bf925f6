"""Quotation linking: from messages with quoted passages to reply-ordered conversations without quotes."""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_schema, numbered, sized, small_batches, staged
from .components import components

#: Fixed value: the marks of quote levels at a line's head.
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)*)")
ENDS, BLANK = re.compile("\r\n?|\n"), re.compile("\n[ \t]*\n")
#: A passage of fewer words links to another conversation only if no third one wrote it too: "thanks" has no origin.
LEAST_WORDS = 4


def parse(text: str | None) -> list[tuple[int, str]]:
    """(level, text) of the runs of lines of one level, without their marks."""
    lines = []
    for line in ENDS.split(text or ""):
        m = MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :]))
    return [(level, "\n".join(plain for _, plain in run)) for level, run in itertools.groupby(lines, key=lambda x: x[0])]


def own_text(text: str | None) -> str:
    """The message without its quoted lines."""
    return "\n".join(line for line in ENDS.split(text or "") if not MARKS.match(line)[1])


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(run: str) -> list[tuple[int, int, str]]:
    """(paragraph, line, normalised text) of a run: as a whole (-1, -1), its paragraphs (line -1) and their lines, without blank ones."""
    out = [(-1, -1, run)]
    for k, par in enumerate(BLANK.split(run)):
        out += [(k, -1, par), *((k, i, line) for i, line in enumerate(par.split("\n")))]
    return [(k, i, n) for k, i, t in out if (n := normal(t))]


def _own(batches):
    """(conv, turn, mid, own_text, n_quoted, max_level) of every row."""
    for batch in batches:
        runs = [parse(t) for t in batch.column("text").to_pylist()]
        quoted = [sum(1 for level, t in r if level and normal(t)) for r in runs]
        made = pa.array([own_text(t) for t in batch.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "turn", "mid")), made, pa.array(quoted, pa.int64()), pa.array([max(level for level, _ in r) for r in runs], pa.int32())], ["conv", "turn", "mid", "own_text", "n_quoted", "max_level"])


def _pieces(batches):
    """(conv, turn, mid, passage, level, par, line, digest, words): every piece of what messages quote and wrote."""
    names = ["conv", "turn", "mid", "passage", "level", "par", "line", "digest", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = []
    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "mid", "text"))):
            for passage, (level, run) in enumerate(parse(text)):
                for par, line, n in pieces(run):
                    rows.append((*key, passage, level, par, line, hashlib.md5(n.encode("utf-8", "surrogatepass")).digest(), n.count(" ") + 1))
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
    if rows:
        yield batch_of(rows)


def _same(names: list[str]) -> list[Column]:
    return [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]


def _origins(asked: DataFrame, own: DataFrame) -> DataFrame:
    """(conv, turn, digest, origin): for the digests that a message asks, the first place that wrote it earlier in the message's own
    conversation, else the smallest one in another; own (digest, conv, turn, words) has each conversation's first turn."""
    place = F.struct("conv", F.col("turn.turn").alias("turn"))
    wanted = asked.select("conv", "turn", "digest").distinct()
    first = own.join(wanted.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min(place).alias("one"), F.count("*").alias("writers"), F.max("words").alias("words"))
    # only a conversation that is itself the first needs the second one
    both = staged(wanted.join(first, "digest"), "first-origins")
    lone = both.where(F.col("one.conv") == F.col("conv")).select("digest", F.col("conv").alias("but")).distinct()
    second = own.join(lone, "digest").where("conv != but").groupBy("digest").agg(F.min(place).alias("two"))
    at_home = own.select("digest", "conv", F.col("turn").alias("home"))
    out = both.join(second, "digest", "left").join(at_home, ["digest", "conv"], "left")
    # as structs, so that a null turn is the earliest
    here = F.when(F.col("home") < F.struct("turn"), F.struct("conv", F.col("home.turn").alias("turn")))
    others = F.col("writers") - F.when(F.col("home").isNotNull(), 1).otherwise(0)
    away = F.when((F.col("words") >= LEAST_WORDS) | (others == 1), F.when(F.col("one.conv") == F.col("conv"), F.col("two")).otherwise(F.col("one")))
    return out.select("conv", "turn", "digest", F.coalesce(here, away).alias("origin")).where("origin IS NOT NULL")


PASSAGE = ["conv", "turn", "mid", "passage", "level"]


def _used(asked: DataFrame, origins: DataFrame) -> DataFrame:
    """The largest pieces that link, of the passages that link: (*PASSAGE, origin)."""
    found = asked.alias("l").join(origins.alias("r"), _same(["conv", "turn", "digest"]), "left").select("l.*", "r.origin")
    got, no = F.col("origin").isNotNull(), F.col("origin").isNull()
    pars = found.where("par >= 0").groupBy(*PASSAGE, "par").agg(F.count(F.when((F.col("line") < 0) & got, 1)).alias("as_one"), F.count(F.when((F.col("line") >= 0) & no, 1)).alias("lost"))
    lost = pars.where("as_one = 0 AND lost > 0").select(*PASSAGE).distinct().withColumn("part_lost", F.lit(True))
    runs = found.where("par < 0").select(*PASSAGE, got.alias("whole")).alias("l").join(lost.alias("r"), _same(PASSAGE), "left").select("l.*", "r.part_lost")
    runs = runs.where("whole OR part_lost IS NULL").drop("part_lost")
    kept = found.alias("l").join(runs.alias("r"), _same(PASSAGE)).select("l.*", "r.whole")
    kept = kept.alias("l").join(pars.alias("r"), _same([*PASSAGE, "par"]), "left").select("l.*", "r.as_one")
    leaf = F.when(F.col("whole"), F.col("par") < 0).otherwise((F.col("par") >= 0) & ((F.col("line") < 0) == (F.col("as_one") > 0)))
    return kept.where(leaf).select(*PASSAGE, "origin")


def _depths(heads: DataFrame) -> DataFrame:
    """heads (head, to, far): each points to another one, far steps away, or to none (null) -> (head, depth), the steps to the last one.

    By pointer doubling: the rounds grow with the logarithm of the longest chain, and stop when no pointer is left. Chains that
    end in a circle never do: of each circle the smallest head is then taken as the last one, and all is counted again.
    """
    now = staged(heads.select("head", "to", F.col("far").alias("depth"), F.col("to").alias("least")), "pointers")
    most = heads.count().bit_length() + 1
    for _ in range(most):
        if now.where("to IS NOT NULL").isEmpty():
            return now.select("head", "depth")
        step = now.where("to IS NOT NULL").join(now.select(F.col("head").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("least").alias("other")), "to")
        moved = step.select("head", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.least("least", "other").alias("least"))
        now = staged(now.where("to IS NULL").unionByName(moved), "pointers")
    cut = sized(staged(now.where("to IS NOT NULL AND least = head").select("head"), "circles"))
    open_ = heads.join(cut, "head", "left_anti").unionByName(heads.join(cut, "head", "left_semi").select("head", F.lit(None).cast("long").alias("to"), F.lit(0).cast("long").alias("far")))
    return _depths(staged(open_, "opened"))


def _places(base: DataFrame, parents: DataFrame) -> DataFrame:
    """(conv, turn, before, depth) of every place (conv, turn) of base: the turn before it in its conversation, and how many replies
    it is away from the first message. parents (conv, turn, parent) has the places that answer another place."""
    places = numbered(base.where(F.col("conv").isNotNull()).select("conv", "turn").distinct(), F.col("conv"), F.col("turn").asc_nulls_first())
    places = staged(places.alias("l").join(parents.alias("r"), _same(["conv", "turn"]), "left").select("l.*", "r.parent"), "places")
    # within a range by windows; what comes before a range by its last row and its last head
    inside = Window.partitionBy("part").orderBy("at")
    last = F.lag(F.struct("conv", "turn")).over(inside)
    ends = places.groupBy(F.col("part").alias("e_part")).agg(F.max_by(F.struct("conv", "turn"), "at").alias("end"))
    ends = F.broadcast(ends.select((F.lead("e_part").over(Window.orderBy("e_part"))).alias("e_part"), "end"))
    rows = places.withColumn("last", last).join(ends, F.col("part") == F.col("e_part"), "left").withColumn("last", F.when(F.col("at") == 0, F.col("end")).otherwise(F.col("last")))
    rows = rows.withColumn("follows", F.coalesce(F.col("last.conv") == F.col("conv"), F.lit(False))).withColumn("before", F.when(F.col("follows"), F.col("last.turn")))
    own = F.when(~F.col("follows") | F.col("parent").isNotNull(), F.col("no"))
    rows = staged(rows.select("conv", "turn", "part", "at", "no", "parent", "follows", "before", own.alias("own")), "followed")
    carry = rows.groupBy(F.col("part").alias("c_part")).agg(F.max("own").alias("own_last"))
    carry = F.broadcast(carry.select("c_part", F.max("own_last").over(Window.orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")))
    rows = rows.withColumn("head", F.max("own").over(inside)).join(carry, F.col("part") == F.col("c_part")).withColumn("head", F.coalesce("head", "carried"))
    rows = staged(rows.select("conv", "turn", "no", "parent", "follows", "before", "head"), "headed")
    starts = rows.where("no = head").select("head", F.col("parent.conv").alias("p_conv"), F.col("parent.turn").alias("p_turn"), F.col("parent").isNotNull().alias("answers"))
    to = starts.join(rows.select(F.col("conv").alias("r_conv"), F.col("turn").alias("r_turn"), F.col("head").alias("r_head"), F.col("no").alias("r_no")), (F.col("p_conv") == F.col("r_conv")) & F.col("p_turn").eqNullSafe(F.col("r_turn")) & F.col("answers"), "left")
    heads = to.select("head", F.col("r_head").alias("to"), F.coalesce(F.col("r_no") - F.col("r_head") + 1, F.lit(0)).cast("long").alias("far"))
    depths = _depths(staged(heads, "heads"))
    return rows.join(depths, "head").select("conv", "turn", "follows", "before", (F.col("depth") + F.col("no") - F.col("head")).alias("depth"))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, thread_id, reply_order, parent_conv, parent_turn, n_quoted, n_linked, max_level, own_text) of every message.

    Quoted passages and what messages wrote themselves are hashed as whole runs, as paragraphs and as lines, after marks are
    taken off and white space and case are normalised. A passage links if its whole hash meets one, or else if each of its
    paragraphs does, as a paragraph or by all of its lines; so a quote of a part links, and one with a line that nobody wrote
    doesn't. A hash has one origin for a message, so no pairs are made: the first turn that wrote it earlier in the message's own
    conversation, else the smallest (conversation, turn) of the others; their ids are no times, so it may be a larger one. A
    passage of fewer than LEAST_WORDS words links to another conversation only if a single other one wrote it. The passage's
    origin is the one of most of its pieces, then the smallest.

    Level 1's first linked passage names the parent; without one it is the message before in the same conversation. thread_id
    is the smallest conversation reachable over the links of all pieces; reply_order counts a thread's messages from 0 by their
    depth in the tree of replies, then by turn and conversation, so a parent always comes before its replies. Of a circle
    of quotes the smallest place counts as a first message. own_text is the message without its quoted lines.

    Orders are counted over sorted ranges, so no conversation or thread is gathered in a task. Null or empty texts have no
    passage. Null conversations form no thread: null thread and order. Null turns come before all others. Rows that repeat
    in every column have the same result but for their order, one after the other; unlike texts at one place are one place in
    the tree, which the smallest parent among theirs decides. Quotes of a message's own words, or of later ones of its
    conversation, don't link. An empty table gives an empty result.
    """
    small_batches(messages.sparkSession)
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mid"), F.col(text_col).alias("text"))
    base = staged(rows.mapInArrow(_own, long_schema("conv long, turn long, mid long, own_text string, n_quoted long, max_level int")).withColumn("rid", F.monotonically_increasing_id()), "messages")
    found = rows.where(F.col("conv").isNotNull()).mapInArrow(_pieces, long_schema("conv long, turn long, mid long, passage int, level int, par int, line int, digest binary, words int"))
    found = staged(found, "pieces")
    own = found.where("level = 0").groupBy("digest", "conv").agg(F.min(F.struct("turn")).alias("turn"), F.max("words").alias("words"))
    asked = staged(found.where("level > 0").select(*PASSAGE, "par", "line", "digest").distinct(), "quoted-pieces")
    used = staged(_used(asked, _origins(asked, staged(own, "own-pieces"))), "piece-links")

    votes = used.groupBy(*PASSAGE, "origin").agg(F.count("*").alias("n"))
    linked = votes.groupBy(*PASSAGE).agg(F.min(F.struct(-F.col("n"), F.col("origin").alias("origin"))).getField("origin").alias("origin"))
    linked = staged(linked, "quote-links")
    message = ["conv", "turn", "mid"]
    parents = linked.where("level = 1").groupBy(*message).agg(F.min(F.struct("passage", "origin")).alias("p")).select(*message, F.col("p.origin").alias("parent"))
    links = linked.groupBy(*message).agg(F.count("*").alias("n_linked"))
    said = staged(links.alias("l").join(parents.alias("r"), _same(message), "left").select("l.*", "r.parent"), "linked")

    edges = used.select(F.col("conv").alias("a"), F.col("origin.conv").alias("b")).where("a != b").distinct()
    threads = components(edges).select(F.col("node").alias("conv"), F.col("comp").alias("thread"))
    places = _places(base, said.where("parent IS NOT NULL").groupBy("conv", "turn").agg(F.min("parent").alias("parent")))
    rows = base.select("rid", *message).alias("l").join(said.alias("r"), _same(message), "left").select("l.*", "r.n_linked", "r.parent")
    rows = rows.alias("l").join(places.alias("r"), _same(["conv", "turn"]), "left").select("l.*", "r.follows", "r.before", "r.depth")
    rows = rows.join(threads, "conv", "left").withColumn("thread_id", F.coalesce("thread", "conv")).drop("thread")
    ordered = numbered(rows, F.col("thread_id").asc_nulls_first(), F.col("depth"), F.col("turn").asc_nulls_first(), F.col("conv"), F.col("mid"), F.col("rid"))
    firsts = ordered.groupBy(F.col("thread_id").alias("f_thread")).agg(F.min("no").alias("first"))
    ordered = ordered.join(firsts, F.col("thread_id") == F.col("f_thread"), "left")
    out = base.select("rid", "own_text", "n_quoted", "max_level").join(ordered, "rid")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "thread_id", (F.col("no") - F.col("first")).alias("reply_order"),
        F.coalesce(F.col("parent.conv"), F.when(F.col("follows"), F.col("conv"))).alias("parent_conv"), F.when(F.col("parent").isNotNull(), F.col("parent.turn")).otherwise(F.col("before")).alias("parent_turn"),
        "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level", "own_text",
    )
