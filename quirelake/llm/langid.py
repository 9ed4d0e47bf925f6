"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_schema, small_batches, staged

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
CHARS = 1 << 18
#: The matrix is broadcast; more languages than this are refused.
MOST_LANGUAGES = 500
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _alpha[0]


def gram_runs(texts: list[str | None]):
    """Yields (first, last, buckets, rows): the hashed n-grams of texts[first:last] that hold a letter, and whose each is.

    Characters are lower-cased and all but letters count as one space each. Each text has two separators on either side, so that no
    n-gram has letters of two texts, and a text's n-grams are the same wherever it stands.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") < CHARS):
            size += len(texts[last] or "") + 4
            last += 1
        lowered = [f"\n\n{(t or '').lower()}\n\n" for t in texts[first:last]]
        code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        code = np.where(letter, code, np.uint32(32))
        owner = np.repeat(np.arange(first, last), [len(t) for t in lowered])
        hashes, rows = [], []
        for n in GRAMS:
            m = len(code) - n + 1
            if m <= 0:
                continue
            h, some = np.full(m, 2166136261 + n, dtype=np.uint32), np.zeros(m, dtype=bool)
            for j in range(n):
                h = (h ^ code[j : j + m]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                some |= letter[j : j + m]
            at = np.flatnonzero(some)
            hashes.append(h[at] & np.uint32(BUCKETS - 1))
            rows.append(owner[at])
        yield first, last, hashes, rows
        first = last


def _count(batches):
    """(lang, bucket, n): what a task has counted, sent once at its end; bucket -1 counts documents."""
    seen: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        order = sorted(range(len(langs)), key=langs.__getitem__)
        langs, texts = [langs[i] for i in order], [texts[i] for i in order]
        start = 0
        for i in range(1, len(langs) + 1):
            if i == len(langs) or langs[i] != langs[start]:
                total = seen.setdefault(langs[start], np.zeros(BUCKETS, dtype=np.int64))
                docs[langs[start]] = docs.get(langs[start], 0) + i - start
                for _, _, hashes, _ in gram_runs(texts[start:i]):
                    for h in hashes:
                        total += np.bincount(h, minlength=BUCKETS)
                start = i
    for lang, total in seen.items():
        at = np.flatnonzero(total)
        buckets, n = np.append(at, -1), np.append(total[at], docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(buckets, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])


class Model:
    """langs in code point order, log priors and the log-probability matrix (languages x BUCKETS), Laplace-smoothed."""

    def __init__(self, langs: list[str], docs: np.ndarray, counts: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        self.prior = np.log(docs / docs.sum()) if len(langs) else np.zeros(0)
        smooth = counts + alpha
        self.matrix = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32) if len(langs) else np.zeros((0, BUCKETS), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for first, last, hashes, rows in gram_runs(texts):
            n = np.zeros(last - first, dtype=np.int64)
            sums = np.zeros((len(self.langs), last - first))
            for h, r in zip(hashes, rows):
                if not len(r):
                    continue
                at = np.flatnonzero(np.diff(r, prepend=-1))
                who = r[at] - first
                n[who] += np.diff(np.append(at, len(r)))
                for k, row in enumerate(self.matrix):
                    sums[k, who] += np.add.reduceat(row[h], at, dtype=np.float64)
            for i in range(last - first):
                if not n[i] or not self.langs:
                    out.append(("und", 0.0))
                    continue
                x = sums[:, i] + self.prior
                k = int(x.argmax())
                out.append((self.langs[k], float(1 / np.exp(x - x[k]).sum())))
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows whose lang isn't null; the driver gets one row for each language and bucket, MOST_LANGUAGES * BUCKETS at most."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = staged(rows.mapInArrow(_count, long_schema("lang string, bucket int, n long")).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    if counts.where("bucket = -1").count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    cells = counts.toArrow()
    langs = sorted(set(cells.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    row = np.array([index[x] for x in cells.column("lang").to_pylist()], dtype=np.int64)
    bucket, n = cells.column("bucket").to_numpy(), cells.column("n").to_numpy()
    matrix, total = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    matrix[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    total[row[bucket < 0]] = n[bucket < 0]
    return Model(langs, total, matrix)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of every row, in one pass without a shuffle; score is the posterior probability.

    'und' with score 0 for null texts, texts without letters, and where the model has no language. keep maps names of
    boolean columns to carry to their expressions. Rows that repeat are each predicted; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared, keep = docs.sparkSession.sparkContext.broadcast(model), keep or {}
    names = list(keep)

    def run(batches):
        for batch in batches:
            made = shared.value.predict(batch.column("text").to_pylist())
            cols = [batch.column(c) for c in ("doc_id", *names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], ["doc_id", *names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, long_schema(", ".join(["doc_id long", *(f"{k} boolean" for k in keep), "lang_pred string", "score double"])))
