"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, long_schema, mix64, shingle_sets, short_reads, small_batches, staged

TOKEN = re.compile(r"[^\W_]+")
#: A task sends its counts on when it holds so many features; and forgets the weights of so many tokens.
FLUSH, CACHE = 150_000, 100_000
SECOND = np.uint64(0x9E3779B97F4A7C15)
#: Inflected words share a stem: the first characters, so many.
STEMS = (4, 5)


def features(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Known(dict):
    """token -> the log-odds of its most significant feature, or None; found once for each token, and forgotten when there are too
    many."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        super().__init__()
        self.weights = weights
        self.stems = [(n, {f[:-1]: w for f, w in weights.items() if len(f) == n + 1 and f[-1] == "*"}) for n in STEMS]

    def __missing__(self, token: str) -> float | None:
        if len(self) > CACHE:
            self.clear()
        best = self.weights.get(token)
        for n, stems in self.stems:
            # a token of under n characters is no stem of that length
            w = stems.get(token[:n])
            if w is not None and (best is None or abs(w[1]) > abs(best[1])):
                best = w
        out = self[token] = None if best is None else best[0]
        return out

    def __reduce__(self):
        return Known, (self.weights,)


@dataclass
class Model:
    """weights: log-odds and z of the words and stems that stand out; drift: what every other token costs; decay and scale: lambda
    and K of the extreme-value law of a clean text's best segment; slope and shift: from evidence to probability."""

    weights: dict[str, tuple[float, float]]
    drift: float = 0.5
    decay: float = 1.0
    scale: float = 0.1
    slope: float = 1.0
    shift: float = 0.0
    known: Known = field(init=False, repr=False)

    def __post_init__(self):
        self.known = Known(self.weights)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time, by the method of Ruzzo and Tompa."""
    total, held = 0.0, []  # held: [left sum, right sum, start, end], and for each the nearest earlier one with a lesser left sum
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [total, total + s, i, i + 1, -1]
        total += s
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][0] >= new[0]:
                j = held[j][4]
            if j < 0 or held[j][1] >= new[1]:
                new[4] = j
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3], -1]
            del held[j:]
            j = len(held) - 1
    return [(a, b, right - left) for left, right, a, b, _ in held]


def sparse_segments(places: Sequence[int], weights: Sequence[float], drift: float) -> list[tuple[int, int, float]]:
    """As segments(), where all tokens but those at places score -drift; the gaps between are summed up."""
    scores: list[float] = []
    at: list[int] = []
    last = 0
    for p, w in zip(places, weights):
        if p > last:
            scores.append(-drift * (p - last))
            at.append(last)
        scores.append(w)
        at.append(p)
        last = p + 1
    return [(at[a], at[b - 1] + 1, s) for a, b, s in segments(scores)]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


COUNTS = ("clean_0", "toxic_0", "clean_1", "toxic_1")


def _count(batches):
    """(word, *COUNTS): in how many texts of each half and label a word or stem occurs."""
    seen: dict[str, list[int]] = {}

    def rows():
        words = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[w][k] for w in words], pa.int64()) for k in range(4))], ["word", *COUNTS])
        seen.clear()
        return out

    for batch in batches:
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half"))):
            words = set(tokens(text))
            for f in words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS)):
                seen.setdefault(f, [0, 0, 0, 0])[2 * half + label] += 1
            if len(seen) > FLUSH:
                yield rows()
    yield rows()


def _first_of_copies(batches):
    """(m_id, toxic, mark): the least hashes of a text's runs of three words under two orders. Copies share both, near copies
    mostly; texts that only have a passage in common seldom do."""
    for batch in batches:
        texts, marks = as_bytes(batch.column("text")), []
        for first, last in chunks(texts, 1 << 19):
            marks += [int(mix64(x[:1] ^ mix64(x ^ SECOND).min())[0].view(np.int64)) if len(x) else None for x in shingle_sets(texts[first:last], 3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("m_id", "toxic")), pa.array(marks, pa.int64())], ["m_id", "toxic", "mark"])


def fit_words(words: DataFrame, prior: float = 0.05, least_z: float = 2.2, least_odds: float = 1.5, most_words: int = 50_000, drift: float = 0.5) -> Model:
    """words (word, y0, y1): in how many clean and toxic texts a word or stem occurs -> its log-odds with a Dirichlet prior of prior
    times its count in all.

    most_words bounds what is broadcast: the features with the largest |z| among those with |z| >= least_z
    and log-odds of least_odds at least, up or down.
    """
    n0, n1 = words.agg(F.coalesce(F.sum("y0"), F.lit(0)), F.coalesce(F.sum("y1"), F.lit(0))).first()
    if not n1 or not n0:
        return Model({}, drift)
    a, mass = (F.col("y0") + F.col("y1")) * F.lit(prior), prior * (n0 + n1)
    odds = lambda y, n: F.log((F.col(y) + F.col("a")) / (F.lit(n + mass) - F.col(y) - F.col("a")))
    delta = odds("y1", n1) - odds("y0", n0)
    z = F.col("delta") / F.sqrt(1 / (F.col("y1") + F.col("a")) + 1 / (F.col("y0") + F.col("a")))
    scored = words.withColumn("a", a).withColumn("delta", delta).withColumn("z", z).where((F.abs("z") >= least_z) & (F.abs("delta") >= least_odds))
    top = scored.orderBy(F.abs("z").desc(), "word").limit(most_words).select("word", "delta", "z", "y0", "a").collect()
    weights = {r.word: (float(r.delta), float(r.z)) for r in top}
    # lambda: the positive root of E[exp(lambda * score)] = 1 over the tokens of clean texts
    p = np.array([(r.y0 + r.a) / (n0 + mass) for r in top])
    s = np.array([r.delta for r in top])
    rest = max(0.0, 1 - p.sum())

    def excess(x: float) -> float:
        return float((p * np.exp(np.minimum(x * s, 600))).sum() + rest * math.exp(-x * drift)) - 1

    low, high = 1e-3, 1e-3
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return Model(weights, drift, (low + high) / 2)


def scored(model: Model, words: list[str]) -> list[tuple[int, int, float]]:
    """The maximal segments of a text."""
    found = [(i, w) for i, w in enumerate(map(model.known.__getitem__, words)) if w is not None]
    places, weights = zip(*found) if found else ((), ())
    return sparse_segments(places, weights, model.drift)


def evidence(model: Model, words: list[str]) -> tuple[float, int, list[tuple[int, int, float]]]:
    """lambda * best score - ln(K * tokens), the number of significant segments, and these; the evidence is the negative log of
    the number of such segments that a clean text of this length has by chance."""
    room = math.log(model.scale * max(1, len(words)))
    found = scored(model, words)
    best = max((s for _, _, s in found), default=0.0)
    strong = [x for x in found if model.decay * x[2] - room > math.log(20)]
    return model.decay * best - room, len(strong), strong


def calibrate(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, shift) of a logistic law, by Newton's method over (evidence, clean, toxic), with Platt's smoothed targets."""
    n0, n1 = sum(b[1] for b in bins), sum(b[2] for b in bins)
    x = np.array([b[0] for b in bins])
    c, t = (np.array([b[k] for b in bins], dtype=float) for k in (1, 2))
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    n, y = c + t, t * hi + c * lo
    slope, shift = 0.0, math.log((n1 + 1) / (n0 + 1))
    loss = lambda a, b: float((n * np.logaddexp(0, a * x + b) - y * (a * x + b)).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -500, 500)))
        g = np.array([((n * p - y) * x).sum(), (n * p - y).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-9, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        k = 1.0
        while k > 1e-6 and loss(slope - k * step[0], shift - k * step[1]) > loss(slope, shift):
            k /= 2
        slope, shift = slope - k * step[0], shift - k * step[1]
        if abs(step).max() * k < 1e-8:
            break
    return max(slope, 1e-6), shift


def clipped(x: float) -> float:
    return min(max(x, -40.0), 80.0)


def score(model: Model, x: float) -> float:
    """Probability of label 1 by the evidence."""
    return 1 / (1 + math.exp(-(model.slope * clipped(x) + model.shift))) if model.weights else 0.0


def in_fold(id_col: str, fold: int, folds: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tally(model: Model):
    """(bin, clean, toxic, drawn, mass): evidence for K = 1 in steps of a quarter by label; and of the clean texts how many have a
    segment at all, and the sum of tokens * exp(-lambda * best score)."""

    def run(batches):
        bins: dict[int, list[float]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = tokens(text)
                best = max((s for _, _, s in scored(model, words)), default=0.0)
                n = max(1, len(words))
                row = bins.setdefault(round(4 * clipped(model.decay * best - math.log(n))), [0, 0, 0, 0.0])
                row[label] += 1
                if not label:
                    row[2] += best > 0
                    row[3] += n * math.exp(-model.decay * best)
        cols = [pa.array([v[k] for v in bins.values()], pa.int64() if k < 3 else pa.float64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int64()), *cols], ["bin", "clean", "toxic", "drawn", "mass"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4, most_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the texts of labelled rows (id, 0/1) whose crc32(id as text) % folds isn't fold.

    most_rows bounds the labelled rows: of more, a sample by a hash of the id. So the labels can be broadcast, and the texts
    aren't shuffled to meet them. Where an id has several labels, the largest counts. Of copies and near copies with one label
    (two least hashes of their runs of three words are equal) one teaches: a word that only they have says little.

    The words' weights and lambda come from all teachers. K and the logistic law come from texts that the weights didn't see:
    weights are learned from either half of the teachers and scored on the other. K is its most likely value under the
    extreme-value law of the clean texts: those with a segment over the sum of tokens * exp(-lambda * best score).
    """
    spark = docs.sparkSession
    small_batches(spark)
    short_reads(spark)
    marks = labels.select(F.col(id_col).cast("long").alias("m_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("m_id").isNotNull())
    marks = staged(marks.where(~in_fold("m_id", fold, folds)).groupBy("m_id").agg(F.max("toxic").alias("toxic")), "labels")
    if (n := marks.count()) > most_rows:
        marks = staged(marks.where(F.pmod(F.xxhash64("m_id"), F.lit(1 << 20)) < int(0.98 * most_rows / n * (1 << 20))), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = texts.join(F.broadcast(marks), F.col("doc_id") == F.col("m_id")).select("m_id", "text", "toxic")
    seen = seen.mapInArrow(_first_of_copies, long_schema("m_id long, toxic int, mark long"))
    teachers = seen.groupBy("mark", "toxic").agg(F.min("m_id").alias("t_id")).groupBy("t_id").agg(F.max("toxic").alias("toxic"))
    teachers = staged(teachers.withColumn("half", F.pmod(F.xxhash64("t_id", F.lit("half")), F.lit(2)).cast("int")), "teachers")
    labelled = staged(texts.join(F.broadcast(teachers), F.col("doc_id") == F.col("t_id")).select("text", "toxic", "half"), "taught")
    counted = labelled.mapInArrow(_count, long_schema(", ".join(["word string", *(f"{c} long" for c in COUNTS)])))
    words = staged(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)), "words")
    model = fit_words(words.select("word", (F.col("clean_0") + F.col("clean_1")).alias("y0"), (F.col("toxic_0") + F.col("toxic_1")).alias("y1")))
    if not model.weights:
        return model
    parts = []
    for k in (0, 1):
        other = fit_words(words.select("word", F.col(f"clean_{1 - k}").alias("y0"), F.col(f"toxic_{1 - k}").alias("y1")).where("y0 + y1 > 0"))
        if other.weights:
            parts += labelled.where(F.col("half") == k).mapInArrow(_tally(other), long_schema("bin long, clean long, toxic long, drawn long, mass double")).groupBy("bin").agg(*(F.sum(c) for c in ("clean", "toxic", "drawn", "mass"))).orderBy("bin").collect()
    if not any(p[1] for p in parts) or not any(p[2] for p in parts):
        # too few labels for halves: the law of the words' own texts
        parts = labelled.mapInArrow(_tally(model), long_schema("bin long, clean long, toxic long, drawn long, mass double")).groupBy("bin").agg(*(F.sum(c) for c in ("clean", "toxic", "drawn", "mass"))).orderBy("bin").collect()
    mass = sum(p[4] for p in parts)
    model.scale = max(1, sum(p[3] for p in parts)) / mass if mass > 0 else model.scale
    model.slope, model.shift = calibrate([(b / 4 - math.log(model.scale), c, t) for b, c, t, _, _ in parts])
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, fold: int = 2, folds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_segments, segments) of every row of docs, in one pass without a shuffle.

    Words get log-odds with a Dirichlet prior; a linear scan finds every maximal segment; the best one's score is turned into
    evidence by the extreme-value law for the text's length, and evidence into a probability by a logistic law. segments has the
    tokens [start, end) of those passages that a clean text of this length holds less than once in twenty.

    Null and empty texts: the score of no evidence. Null ids: not held out, never labelled. Without labels of both kinds every
    score is 0. Rows that repeat are each scored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    short_reads(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), in_fold(id_col, fold, folds).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            made = [evidence(shared.value, tokens(t)) for t in batch.column("text").to_pylist()]
            scores = [score(shared.value, x[0]) for x in made]
            spans = [",".join(f"{a}:{b}" for a, b, _ in x[2]) for x in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([x[1] for x in made], pa.int64()), pa.array(spans, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "n_segments", "segments"],
            )

    return rows.mapInArrow(run, long_schema("doc_id long, held_out boolean, score double, predicted int, n_segments long, segments string"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores under threshold; nothing is shuffled."""
    small_batches(docs.sparkSession)
    short_reads(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [score(shared.value, evidence(shared.value, tokens(t))[0]) < threshold for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
