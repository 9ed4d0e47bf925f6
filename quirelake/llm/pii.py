"""Personal data by patterns, made consistent within each document by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_schema, small_batches, staged

#: Kinds in their order, and the patterns asked for.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Only where a token begins: else a long run without a digit would be tried from each of its characters.
TOKEN = re.compile(r"(?<![^\s,;<>\"'])[^\s,;<>\"'0-9@]*[0-9@][^\s,;<>\"']*")
NOT_DIGIT, NOT_KEY = re.compile("[^0-9]+"), re.compile(r"[^0-9a-z@]+")
DIGITS, LETTERS, LETTER = re.compile("[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile("[A-Za-z@]")
#: A bound against messages that swing for ever; they settle long before.
MOST_ROUNDS = 1_000


def luhn(digits: str) -> bool:
    odd, even = (sum(map(int, digits[-k::-2])) for k in (1, 2))
    return (odd + even + sum(d > "4" for d in digits[-2::-2]) * -9 + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and without overlap for each kind; failing ones are dropped.

    An email is found from its @: the longest run of local characters before it that no earlier match has taken, so long runs
    without @ cost nothing.
    """
    out: list[tuple[int, int, str]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end(), "email"))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(token: str) -> str:
    """What a token looks like as a whole, in steps, so that there are at most 18 * 6 * 3 * 2 * 5 * 4 * 2 * 2 shapes, twice: its digits and
    runs of digits, letters, @, points, hyphens or spaces, a plus at its head, and other characters."""
    runs = DIGITS.findall(token)
    digits = sum(map(len, runs))
    at, points, joints = token.count("@"), token.count("."), token.count("-") + token.count(" ")
    letters = sum(map(len, LETTERS.findall(token)))
    plus = token[0] == "+"
    other = len(token) > digits + letters + at + points + joints + plus
    return f"{min(digits, 17)}/{min(len(runs), 5)}/{min((letters + 2) // 3, 2)}/{min(at, 1)}/{min(points, 4)}/{min(joints, 3)}/{int(plus)}/{int(other)}"


def keyed(token: str) -> tuple[str, str]:
    """What repeated tokens share, and what similar ones do; "" is shared with none. Repeated: the digits of a number whatever stands
    between them, else letters and digits. Similar: the last seven of a number's digits, as with and without a country's code, or
    what an address has before its @."""
    digits = NOT_DIGIT.sub("", token)
    if len(digits) >= 7 and not LETTER.search(token):
        return digits, f"~{digits[-7:]}"
    whole = NOT_KEY.sub("", token.lower())
    name = whole.partition("@")[0] if "@" in whole else ""
    return (whole if len(whole) >= 4 else ""), (f"{name}@" if len(name) >= 4 else "")


def nodes_of(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None, str, tuple[str, str]]]:
    """(start, end, base kind or None, shape, keys): the base spans, and the tokens with a digit or @ that no base span touches."""
    out = [(s, e, k, shape(text[s:e]), keyed(text[s:e])) for s, e, k in base]
    i, top = 0, 0
    for m in TOKEN.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in ".:!?)":
            b -= 1
        while a < b and text[a] in "(":
            a += 1
        while i < len(base) and base[i][0] < b:
            top, i = max(top, base[i][1]), i + 1
        if a < b and top <= a:
            token = text[a:b]
            # what a pattern finds in a token and its check refuses is evidence of its own
            refused = IP.search(token) or PHONE.search(token) or any(len(NOT_DIGIT.sub("", m[0])) >= 12 for m in CARD.finditer(token))
            out.append((a, b, None, shape(token) + "!" * bool(refused), keyed(token)))
    return sorted(out, key=lambda n: (n[0], n[1], n[2] or ""))


def edges_of(nodes) -> list[tuple[int, int, int]]:
    """(node, node, 0 neighbours, 1 repeated, 2 similar tokens) of one document.

    A token whose key a base span has is linked to the first base span of each kind with that key, so the same evidence reaches
    every repeat however many there are, unweakened; other repeated keys are linked from each occurrence to the next. Similar
    tokens are linked likewise where no base span has the key itself. There are at most a few edges for each node.
    """
    held: dict[str, dict[str, int]] = {}
    for i, x in enumerate(nodes):
        if x[2]:
            for k in x[4]:
                if k:
                    held.setdefault(k, {}).setdefault(x[2], i)
    edges, last = [], {}
    for i, x in enumerate(nodes):
        if i:
            edges.append((i - 1, i, 0))
        for kind, k in enumerate(x[4], 1):
            if k in held:
                if not x[2]:
                    edges += [(j, i, kind) for j in held[k].values()]
                    break
            elif k:
                if k in last:
                    edges.append((last[k], i, kind))
                last[k] = i
    return edges


class Model:
    """Potentials of a skip-chain field over the labels none and KINDS: of a token by its shape, of neighbours, and of tokens
    that are repeated or similar. All are smoothed log-frequencies of the corpus; other is the potential of shapes it doesn't have."""

    def __init__(self, shapes: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray, alike: np.ndarray | None = None):
        n = len(KINDS) + 1
        alike = skip if alike is None else alike
        total = sum(shapes.values(), np.zeros(n)) + 1
        self.shape = {k: np.log((v + 0.1) / (v.sum() + 0.1 * n)) for k, v in shapes.items()}
        self.other = np.log(total / total.sum())
        # how much likelier a pair of labels is than the two by themselves
        pairs = (chain + 1.0, *(c + c.T + np.eye(n) + 0.02 for c in (skip, alike)))
        self.pairs = np.stack([c * c.sum() / np.outer(c.sum(1), c.sum(0)) for c in pairs])

    def infer(self, docs: list) -> list[np.ndarray]:
        """For each document's nodes the marginals by loopy sum-product; base spans are held at their kinds.

        Messages of all documents are sent at once, of each until its own settle: a document's result doesn't depend on the others.
        The cost grows with the number of nodes and not with its square.
        """
        m = len(KINDS) + 1
        sizes = [len(nodes) for nodes in docs]
        firsts = np.cumsum([0, *sizes])
        every = [x for nodes in docs for x in nodes]
        if not every:
            return [np.zeros((0, m)) for _ in docs]
        local = np.stack([self.shape.get(x[3], self.other) for x in every])
        for i, x in enumerate(every):
            if x[2]:
                local[i] = -1e9  # held whatever the number of messages that meet here
                local[i, _label(x[2])] = 0.0
        edges = np.array([(a + f, b + f, k, d) for d, (nodes, f) in enumerate(zip(docs, firsts)) for a, b, k in edges_of(nodes)], dtype=np.int64).reshape(-1, 4)
        belief = local.copy()
        a, b, kind, doc = edges.T
        pot = self.pairs[kind]
        msg = np.zeros((2, len(edges), m))  # to b, and back to a
        for _ in range(MOST_ROUNDS):
            if not len(a):
                break
            new = np.empty_like(msg)
            for way, (src, p) in enumerate(((a, pot), (b, pot.transpose(0, 2, 1)))):
                out = belief[src] - msg[1 - way]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new[way] = np.log((out[:, :, None] * p).sum(axis=1) + 1e-30)
            new -= new.max(axis=2, keepdims=True)
            moved = np.abs(new - msg).max(axis=(0, 2))
            msg = 0.5 * (msg + new)
            at = np.concatenate([b, a])
            belief[at] = local[at]
            np.add.at(belief, b, msg[0])
            np.add.at(belief, a, msg[1])
            # a document whose largest change is small has settled; its edges stand together
            new_doc = np.flatnonzero(np.diff(doc, prepend=-1))
            most = np.maximum.reduceat(moved, new_doc)
            going = np.repeat(most >= 1e-3, np.diff(np.append(new_doc, len(doc))))
            if not going.all():
                a, b, doc, pot, msg = a[going], b[going], doc[going], pot[going], msg[:, going]
        p = _norm(belief)
        return [p[f : f + n] for f, n in zip(firsts, sizes)]


def _norm(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _label(kind: str | None) -> int:
    return 1 + KINDS.index(kind) if kind else 0


def _tally(batches):
    """Counts of (what, label or pair of labels): shapes, neighbours and tokens that share a key."""
    seen: Counter = Counter()

    def rows():
        keys = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["what", "cell", "n"])
        seen.clear()
        return out

    width = len(KINDS) + 1
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            nodes, last, before = nodes_of(text, base_spans(text)), {}, None
            for x in nodes:
                y = _label(x[2])
                seen["s" + x[3], y] += 1
                if before is not None:
                    seen["chain", before * width + y] += 1
                for what, k in zip(("skip", "alike"), x[4]):
                    if k:
                        if k in last:
                            seen[what, last[k] * width + y] += 1
                        last[k] = y
                before = y
        if len(seen) > 200_000:
            yield rows()
    yield rows()


def fit(docs: DataFrame) -> Model:
    """Potentials from all texts, with the base patterns as labels. The driver gets the counts of shapes, whose number is bounded."""
    counts = staged(docs.select("text").mapInArrow(_tally, long_schema("what string, cell int, n long")).groupBy("what", "cell").agg(F.sum("n").alias("n")), "shapes")
    width = len(KINDS) + 1
    shapes: dict[str, np.ndarray] = {}
    pairs = {what: np.zeros((width, width)) for what in ("chain", "skip", "alike")}
    for what, cell, n in counts.collect():
        if what in pairs:
            pairs[what][divmod(cell, width)] += n
        else:
            shapes.setdefault(what[1:], np.zeros(width))[cell] += n
    return Model(shapes, **pairs)


def spans_of_all(texts: list[str | None], model: Model, least: float = 0.5) -> list[tuple[list, list]]:
    """Of each text the base spans, and all spans: tokens whose likeliest label is a kind of at least that probability are added."""
    bases = [base_spans(t) if t else [] for t in texts]
    docs = [nodes_of(t, b) if t else [] for t, b in zip(texts, bases)]
    out = []
    for base, nodes, p in zip(bases, docs, model.infer(docs)):
        best = p.argmax(axis=1).tolist()
        more = [(x[0], x[1], KINDS[k - 1]) for x, k, q in zip(nodes, best, p.max(axis=1).tolist()) if not x[2] and k and q >= least]
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base))
    return out


def spans_of(text: str | None, model: Model, least: float = 0.5) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    return spans_of_all([text], model, least)[0]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row; the counts of kinds and the digest are of
    base spans, n_spans is the number of all.

    Two passes over the texts without a shuffle of them: one fits the field, one labels, on every document. Null texts are empty and have no span.
    Null ids and repeated rows are labelled like others; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches):
        for batch in batches:
            made = spans_of_all(batch.column("text").to_pylist(), shared.value)
            counts = [Counter(k for _, _, k in b) for b, _ in made]
            cols = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in made], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, digest, pa.array([joined(s) for _, s in made], pa.string()), pa.array([len(s) for _, s in made], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return rows.mapInArrow(run, long_schema("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"))
