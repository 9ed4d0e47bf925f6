"""Audio fingerprints: integral-image filters over pitch-class frames, aligned by offset histograms and bit errors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_schema, sized, small_batches, staged
from .components import components, grown

WINDOW, HOP = 1024, 512
#: Filters (kind, first pitch class, pitch classes, frames): the classic rectangle pairs over a sliding image of 12 classes.
#: Kinds: 0 all against nothing (level), 1 upper against lower half, 2 early against late half, 3 checkerboard, 4 middle against
#: both sides in pitch, 5 middle against both sides in time.
FILTERS = (
    (2, 0, 3, 8), (2, 3, 3, 8), (2, 6, 3, 8), (2, 9, 3, 8), (1, 0, 6, 6), (1, 6, 6, 6), (1, 3, 6, 6), (3, 0, 6, 8),
    (3, 6, 6, 8), (4, 0, 12, 4), (4, 3, 9, 8), (5, 0, 4, 9), (5, 4, 4, 9), (5, 8, 4, 9), (1, 0, 12, 12), (2, 0, 12, 16),
)
SPAN = max(f[3] for f in FILTERS)
#: Quantiser bounds: the log ratio of the two areas falls into four classes, in Gray code.
BOUNDS = (-0.25, 0.0, 0.25)
#: A query asks for each of its integers with every choice of so many least reliable bits flipped: a cut that doesn't begin on
#: the recording's frames has few integers that are equal in all bits.
WEAK = 4
#: The law of chance: unrelated recordings differ in a share of bits with this mean, and over an overlap of m integers with this
#: spread / sqrt(m). Neighbouring integers see mostly the same frames, so the spread is three times that of independent bits.
CHANCE, SIGMAS = (0.5, 1.5 / 32**0.5), 6.0


def chroma(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Frames of 12 pitch-class energies, each of unit length; A is class 0."""
    frames = max(0, 1 + (len(pcm) - WINDOW) // HOP)
    if not frames:
        return np.zeros((0, 12))
    x = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), WINDOW)[::HOP]
    power = np.abs(np.fft.rfft(x * np.hanning(WINDOW).astype(np.float32), axis=1)) ** 2
    hz = np.fft.rfftfreq(WINDOW, 1 / rate)
    use = (hz >= 55) & (hz <= 3520)
    cls = np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12
    fold = np.zeros((int(use.sum()), 12))
    fold[np.arange(len(cls)), cls] = 1
    out = power[:, use] @ fold
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 1e-6, norm, 1)


def soft_prints(frames: np.ndarray, weak: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One unsigned 32-bit integer for each place of the sliding image: two bits a filter, from sums of the integral image; and
    of each the masks (places x weak) of its least reliable bits, those whose log ratios lie nearest to a quantiser bound."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros((0, weak), dtype=np.uint32)
    total = np.zeros((len(frames) + 1, 13))
    total[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t, bounds = np.arange(n), np.array(BOUNDS)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return total[t + t1, p1] - total[t + t0, p1] - total[t + t1, p0] + total[t + t0, p0]

    out = np.zeros(n, dtype=np.uint32)
    margins, masks = np.empty((n, len(FILTERS))), np.empty((n, len(FILTERS)), dtype=np.uint32)
    for f, (kind, p, h, w) in enumerate(FILTERS):
        q, v = p + h, w // 2
        whole = area(0, w, p, q)
        part = (
            area(0, w, p, p + h // 2) if kind == 1
            else area(0, v, p, q) if kind == 2
            else area(0, v, p, p + h // 2) + area(v, w, p + h // 2, q) if kind == 3
            else area(0, w, p + h // 3, q - h // 3) if kind == 4
            else area(w // 3, w - w // 3, p, q) if kind == 5
            else whole
        )
        ratio = np.log((1e-3 + part) / (1e-3 + whole - part))
        level = np.searchsorted(bounds, ratio)
        out = (out << np.uint32(2)) | _gray(level)
        apart = np.abs(ratio[:, None] - bounds)
        near = apart.argmin(axis=1)
        margins[:, f] = apart[t, near]
        masks[:, f] = (_gray(near) ^ _gray(near + 1)) << np.uint32(2 * (len(FILTERS) - 1 - f))
    return out, np.take_along_axis(masks, np.argsort(margins, axis=1, kind="stable")[:, :weak], axis=1)


def _gray(level: np.ndarray) -> np.ndarray:
    return (level ^ (level >> 1)).astype(np.uint32)


def prints(frames: np.ndarray) -> np.ndarray:
    return soft_prints(frames)[0]


def _fingerprint(batches):
    for batch in batches:
        made = []
        for audio, rate in zip(batch.column("audio").to_pylist(), batch.column("rate").to_pylist()):
            pcm = np.frombuffer(audio[: len(audio) // 2 * 2], dtype="<i2") if audio and rate and rate > 0 else np.zeros(0, np.int16)
            made.append(soft_prints(chroma(pcm, rate or 1), WEAK))
        cls = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x, _ in made]
        lists = [pa.array([x[k].astype(np.int64).ravel() for x in made], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cls, pa.binary()), *lists], ["id", "cls", "prints", "weak"])


def fingerprints(media: DataFrame, id_col: str = "id", audio_col: str = "audio", rate_col: str = "rate") -> DataFrame:
    """(id, cls, prints, weak) of mono 16-bit little-endian recordings; weak holds WEAK masks for each print, one after the
    other. Too short, empty and null ones have no prints and a null class."""
    small_batches(media.sparkSession, rows=200)
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio"), F.col(rate_col).cast("int").alias("rate"))
    return rows.mapInArrow(_fingerprint, long_schema("id long, cls binary, prints array<long>, weak array<long>"))


def most_error_by_chance(overlap: Column, most_error: float, chance: tuple[float, float], sigmas: float) -> Column:
    """The bit error that an overlap of so many integers may have: most_error, and sigmas spreads under what chance gives. Short
    overlaps thus need fewer errors, and those on which chance may agree in full match nothing."""
    mean, spread = chance
    return F.least(F.lit(most_error), F.lit(mean) - sigmas * spread / F.sqrt(overlap))


def verified(pairs: DataFrame, sounds: DataFrame, most_error: float, chance: tuple[float, float], sigmas: float) -> DataFrame:
    """pairs (q, r, offset, ..) of sounds (name, prints) with bit_error over their overlap, where that is small enough."""
    side = lambda who: sounds.select(F.col("name").alias(who), F.col("prints").alias(f"{who}_prints"))
    full = pairs.join(side("q"), "q").join(side("r"), "r")
    cut = lambda c, off: F.slice(c, F.greatest(off, F.lit(0)) + 1, F.size(c))
    both = F.arrays_zip(cut(F.col("q_prints"), -F.col("offset")).alias("a"), cut(F.col("r_prints"), F.col("offset")).alias("b"))
    overlap = F.least(F.size("q_prints") - F.greatest(-F.col("offset"), F.lit(0)), F.size("r_prints") - F.greatest(F.col("offset"), F.lit(0)))
    wrong = F.aggregate(F.slice(both, 1, overlap), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x["a"].bitwiseXOR(x["b"])))
    checked = full.withColumn("bit_error", wrong / (overlap * 32)).where(F.col("bit_error") <= most_error_by_chance(overlap, most_error, chance, sigmas))
    return checked.drop("q_prints", "r_prints")


def _best(hits: DataFrame, least_votes: int) -> DataFrame:
    """hits (q, q_at, r, r_at) -> (q, r, votes, offset): of each pair the offset with most votes, then the smallest."""
    votes = hits.groupBy("q", "r", (F.col("r_at") - F.col("q_at")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("q", "r").agg(F.max(F.struct("votes", (-F.col("offset")).alias("back"))).alias("b")).where(F.col("b.votes") >= least_votes)
    return best.select("q", "r", F.col("b.votes").alias("votes"), (-F.col("b.back")).alias("offset"))


def _sounds(usable: DataFrame, *more: Column) -> DataFrame:
    """(cls, name, copies, prints, ..): recordings with equal prints are one sound, its smallest id its name."""
    return usable.groupBy("cls").agg(F.min("id").alias("name"), F.count("*").alias("copies"), F.first("prints").alias("prints"), *more)


#: A steady sound repeats one integer: it is kept where it begins.
BEGINS = "at = 0 OR prints[at - 1] != print"


def align(media: DataFrame, queries_every: int = 20, least_votes: int = 3, most_error: float = 0.2, chance: tuple[float, float] = CHANCE, sigmas: float = SIGMAS, id_col: str = "id", audio_col: str = "audio", rate_col: str = "rate") -> DataFrame:
    """(query_id, match_id, copies, offset, votes, bit_error): recordings whose id queries_every divides, against all others.

    Recordings with equal prints are one class, its smallest id its name (match_id) and copies its members, so a hot group of copies
    isn't expanded. Integers of a query, as they are or with any of their WEAK least reliable bits flipped, vote for the
    difference of their places and those of equal integers of a recording. The best offset of a pair with least_votes votes is kept if the
    share of unequal bits over the overlap is at most most_error, and so far under what chance gives that it can't be chance.
    Ties: most votes, then the smallest offset.

    Recordings without prints and null ids match nothing. Rows that repeat an id and sound count once each in copies. A
    query's own class is reported if it has other members. An empty table gives an empty result.
    """
    found = staged(fingerprints(media, id_col, audio_col, rate_col), "prints")
    usable = found.where(F.col("cls").isNotNull() & F.col("id").isNotNull())
    classes = staged(_sounds(usable, F.min(F.struct("id", "weak"))["weak"].alias("weak"), F.max((F.col("id") % queries_every == 0).cast("int")).alias("asks")), "sounds")
    starts = lambda df, who: df.select("name", "prints", "weak", F.posexplode("prints").alias("at", "print")).where(BEGINS).select(F.col("name").alias(who), F.col("at").alias(f"{who}_at"), "print", F.slice("weak", F.col("at") * WEAK + 1, WEAK).alias("weak"))
    flipped = F.aggregate("weak", F.array("print"), lambda acc, m: F.concat(acc, F.transform(acc, lambda x: x.bitwiseXOR(m))))
    asked_for = starts(classes.where("asks = 1"), "q").select("q", "q_at", F.explode(flipped).alias("print"))
    hits = asked_for.join(starts(classes, "r").drop("weak"), "print").where("q != r")
    matched = verified(_best(hits, least_votes), classes, most_error, chance, sigmas).join(classes.select(F.col("name").alias("r"), F.col("copies").alias("r_copies")), "r")
    asked = usable.where(F.col("id") % queries_every == 0).select(F.col("id").alias("query_id"), "cls").distinct().join(classes.select("cls", F.col("name").alias("q"), F.col("copies").alias("own")), "cls")
    other = asked.join(matched.select("q", "r", "r_copies", "offset", "votes", "bit_error"), "q").select("query_id", F.col("r").alias("match_id"), F.col("r_copies").alias("copies"), F.col("offset").cast("int").alias("offset"), "votes", "bit_error")
    same = asked.where("own > 1").join(classes.select("cls", F.size("prints").cast("long").alias("votes")), "cls").select("query_id", F.col("q").alias("match_id"), F.col("own").alias("copies"), F.lit(0).alias("offset"), "votes", F.lit(0.0).alias("bit_error"))
    return other.unionByName(same)


def group(media: DataFrame, apart: int = SPAN, least_votes: int = 1, most_error: float = 0.2, chance: tuple[float, float] = CHANCE, sigmas: float = SIGMAS, id_col: str = "id", audio_col: str = "audio", rate_col: str = "rate") -> DataFrame:
    """(id, n_prints, group_id, group_size, match_id, offset, votes, bit_error) of every recording.

    All recordings are aligned with all: those that align are linked, and group_id is the smallest id reachable. match_id is the
    smallest id that the recording itself was aligned with, offset its place there; null where there is none.

    1. Equal prints are one sound, its name the smallest id.
    2. Each integer and the one apart places later are a key. Integers a span apart share no frame, so by chance both agree too
       seldom for pairs to grow with the square of the table. Every sound votes, by key and offset, for the smallest name
       that has the key: a hot key costs its length and not its square. The best offset of each such pair is verified over the
       overlap, as in align(). Links make components.
    3. Keys whose sounds aren't all of one component after that: there all sounds of unlike components vote for each other. So
       no link between components is lost to the choice of names. Only a key that many unlinked recordings share costs more
       than its length.

    Recordings with fewer than apart + 1 integers align only if equal. Without prints: 0 integers, a group of their own. Null
    ids: null group, size 1. Rows that repeat an id are one recording, but count once each in group_size. An empty table gives an
    empty result.
    """
    found = staged(fingerprints(media, id_col, audio_col, rate_col).drop("weak"), "prints")
    usable = found.where(F.col("cls").isNotNull() & F.col("id").isNotNull())
    sounds = staged(_sounds(usable), "sounds")
    placed = sounds.select("name", "prints", F.posexplode("prints").alias("at", "print")).where(BEGINS).where(F.col("at") + apart < F.size("prints"))
    keys = placed.select("name", "at", F.shiftleft("print", 32).bitwiseOR(F.element_at("prints", F.col("at") + apart + 1)).alias("key"))
    shared = staged(keys.groupBy("key").agg(F.min(F.struct("name", "at")).alias("first"), F.max("name").alias("last")).where("first.name < last").select("key", F.col("first.name").alias("r"), F.col("first.at").alias("r_at")), "keys")
    held = staged(keys.withColumnRenamed("key", "own").join(sized(shared), F.col("own") == F.col("key")).select(F.col("name").alias("q"), F.col("at").alias("q_at"), "key", "r", "r_at"), "held")
    check = lambda hits, tag: staged(verified(_best(hits, least_votes), sounds, most_error, chance, sigmas), tag)
    links = check(held.where("q != r"), "links")
    comps = components(links.select(F.col("q").alias("a"), F.col("r").alias("b")))

    who = held.select("q", "q_at", "key").join(comps.withColumnRenamed("node", "q"), "q", "left").withColumn("comp", F.coalesce("comp", "q"))
    mixed = who.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = staged(who.join(mixed, "key"), "rest")
    other = rest.select("key", F.col("q").alias("r"), F.col("q_at").alias("r_at"), F.col("comp").alias("r_comp"))
    late = check(rest.join(other, "key").where("comp != r_comp AND r < q").select("q", "q_at", "r", "r_at"), "late-links")
    if not late.isEmpty():
        links = links.unionByName(late)
        comps = grown(comps, late.select(F.col("q").alias("a"), F.col("r").alias("b")))

    best = links.groupBy("q").agg(F.min(F.struct("r", "offset", "votes", "bit_error")).alias("m"))
    named = sounds.select("cls", F.col("name").alias("q"), "copies").join(comps.withColumnRenamed("node", "q"), "q", "left").withColumn("group_id", F.coalesce("comp", "q")).join(best, "q", "left")
    sizes = named.groupBy(F.col("group_id").alias("g")).agg(F.sum("copies").alias("group_size"))
    named = named.join(sizes, F.col("group_id") == F.col("g")).select(F.col("cls").alias("n_cls"), "q", "group_id", "group_size", "m")
    out = found.join(named, (F.col("cls") == F.col("n_cls")) & F.col("id").isNotNull(), "left")
    # a copy aligns with the name of its sound, from the first integer to the last
    copy = F.col("id") > F.col("q")
    pick = lambda c, own: F.when(copy, own).otherwise(F.col(f"m.{c}")).alias(c)
    n = F.coalesce(F.size("prints"), F.lit(0)).alias("n_prints")
    return out.select(
        "id", n, F.coalesce("group_id", "id").alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(copy, F.col("q")).otherwise(F.col("m.r")).alias("match_id"), pick("offset", F.lit(0)).cast("int").alias("offset"), pick("votes", F.size("prints")).cast("long").alias("votes"), pick("bit_error", F.lit(0.0)),
    )
