"""The training-data operators against brute force, SQL, exact round trips and hand-made cases."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import chroma, common, exact, langid, license, minhash, mix, pack, pii, queries, quotes, toxicity
from quirelake.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "ONE", "en", "b", 3), (7, "x" * 300_000, "en", "b", 300_000), (8, "word " * 60_000, "de", "b", 300_000), (9, "éİK <|endoftext|> +1 555 010 99 99", "fr", "c", 9)]


@pytest.fixture(scope="module")
def hard(spark):
    clashes = {c: F.lit(1) for c in ("size", "cls", "node", "key", "rk", "source_size", "print", "held_out", "score", "copies")}
    return spark.createDataFrame(HARD, SCHEMA).withColumns(clashes)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def make(name, docs, labels):
    if name == "op1_mix":
        return mix.mix(docs)
    if name == "op3_minhash":
        return minhash.near_duplicates(docs, width=2)
    if name == "op4_pii":
        return pii.find_personal(docs)
    if name == "op5_pack":
        return pack.pack(docs, queries.tokenizer_path())
    if name == "op6_langid":
        return langid.identify(docs, langid.fit(docs))
    if name == "op7_exact":
        return exact.exact_groups(docs)
    if name == "op8_license":
        return license.scan_licenses(docs)
    return toxicity.score_documents(docs, toxicity.fit(docs, labels))


NAMES = ["op1_mix", "op3_minhash", "op4_pii", "op5_pack", "op6_langid", "op7_exact", "op8_license", "op9_toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows_and_empty_tables(spark, hard, empty, labels, name):
    rows = make(name, hard, labels).collect()
    if name == "op5_pack":
        assert {r.doc_id for r in rows} == {r[0] for r in HARD}
    else:
        assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in HARD), key=str)
    assert make(name, empty, labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    plain = lambda d: sorted((tuple(None if pd.isna(x) else x for x in r) for r in d[sorted(d.columns)].astype(object).values.tolist()), key=lambda r: [(x is None, 0 if x is None else x) for x in r])
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "b", "c", "d", None]), 0) for i in range(3000)]
    got = mix.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    by = got.fillna({"source": "~"}).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 1 + 0.001 * by.target).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1 and (by.target <= 2 * by["size"] + 1e-6).all()
    assert (got.taken <= 2 * got["size"]).all()


def greedy(rows, odds, share=1.5, most=2.0, seed="mix"):
    """The rule of the mix by plain loops: sorted (doc_id, size, taken), and by source the target and the words taken."""
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mix.WEIGHTS[k % 3] for k, s in enumerate(names)}
    goal, capped = sum(sizes.values()) * share, set()
    while True:
        free = [s for s in names if s not in capped]
        level = (goal - sum(most * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if most * sizes[s] / weight[s] < level}
        if not over:
            break
        capped |= over
    target = {s: min(most * sizes[s], weight[s] * level) for s in names} if free else {s: most * sizes[s] for s in names}
    out, took = [], {}
    for s in names:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        room = target[s] - whole * sizes[s]
        mass = sum(n * odds(n) for _, n, x in rows if x == s)
        ranked = []
        for i, n, x in rows:
            if x == s:
                u = (int(hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
                p = min(0.999, room * odds(n) / mass) if mass else 0
                q = (u / (1 - u)) / (p / (1 - p)) if p > 0 and n else None
                ranked.append((q is None, 0 if q is None else q / (1 + q), i is not None, i or 0, n, i))
        order, fills = [(i, n, x) for no, x, _, _, n, i in sorted(ranked) if not no], []
        out += [(i, n, n * whole) for no, _, _, _, n, i in ranked if no]

        def fill(items, room):
            made = []
            for i, n, _ in items:
                made.append((i, n, n <= room))
                room -= n * made[-1][2]
            return room, made

        miss, made = fill(order, room)
        passed = [x for x, y in zip(order, made) if not y[2] and x[1] <= room]
        if passed and room >= 1 and miss > 0.001 * target[s]:
            lead = passed[0]
            miss2, made2 = fill([x for x in order if x != lead], room - lead[1])
            if miss2 < miss:
                miss, made = miss2, made2 + [(lead[0], lead[1], not k) for k in range(order.count(lead))]
        out += [(i, n, n * (whole + more)) for i, n, more in made]
        took[s] = target[s], miss
    return sorted(out, key=str), took


@pytest.mark.parametrize("seed", range(2))
def test_mix_is_the_plain_greedy_order_with_skewed_sizes(spark, seed):
    """Many short documents and a few very long ones, hot and null sources, repeated ids: each target is met within a short one."""
    rng = random.Random(seed)
    rows = [(i, 10, "a") for i in range(2000)] + [(5000 + i, 20_000, "a") for i in range(3)] + [(6000 + i, rng.choice([0, 1, 7, 300]), rng.choice(["b", "b", "c", None])) for i in range(600)]
    rows += [(9, 25, "d")] * 300 + [(9, 3, "d")] * 40 + [(7000, 1000, "e"), (None, 12, "a"), (None, 12, "a")]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), "en", s, 0) for i, n, s in rows], SCHEMA)
    for odds, plain, bucket in ((mix.root_of_size, lambda n: int(n**0.5), 16), (None, lambda n: 1, 512), (lambda size: 1 / (1 + size), lambda n: 1 / (1 + n), 40)):
        got = mix.mix(docs, odds=odds, seed=f"s{seed}", bucket_rows=bucket).toPandas()
        want, took = greedy(rows, plain, seed=f"s{seed}")
        assert sorted(((None if i != i else int(i), n, t) for i, n, t in zip(got.doc_id, got["size"], got.taken)), key=str) == want
        for source, g in got.assign(source=got.source.fillna("~")).groupby("source"):
            target, miss = took[None if source == "~" else source]
            assert abs(g.target.iloc[0] - target) < 1e-6 * max(1, target) and g.taken.sum() <= target + 1e-6
            assert abs(target - g.taken.sum() - miss) < 1e-6
            if source == "a":
                assert miss < 20
    by_odds = mix.mix(docs, odds="n_chars").toPandas()
    assert (by_odds.taken % by_odds["size"].clip(lower=1) == 0).all()


def test_pareto_order_keeps_to_its_inclusion_odds(spark):
    """Over many seeds documents are taken about as often as their odds say."""
    rows = [(i, " ".join(["w"] * n), "en", "a", 0) for i, n in enumerate([4, 16, 36, 64] * 60)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    hits = {n: 0 for n in (4, 16, 36, 64)}
    for seed in range(5):
        for r in mix.mix(docs, seed=f"o{seed}").where("copies = 2").collect():
            hits[r.size] += 1
    share = {n: k / 300 for n, k in hits.items()}
    mass = sum(n * n**0.5 for n in hits)
    for n in hits:
        assert abs(share[n] - 0.5 * sum(hits) * n**0.5 / mass) < 0.09
    assert share[4] < share[16] < share[36] < share[64]


def test_polynomial_prints_compose():
    data = random.Random(1).randbytes(300_000)
    slow = tuple(0 for _ in exact.PRIMES)
    for cut in (0, 1, 70_000, 131_072, 299_999):
        a, b = data[:cut], data[cut:]
        assert exact.combine(exact.fingerprint(a), exact.fingerprint(b), len(b)) == exact.fingerprint(data)
    for byte in data[:500]:
        slow = tuple((x * b + byte + 1) % p for x, b, p in zip(slow, exact.BASES, exact.PRIMES))
    assert exact.fingerprint(data[:500]) == slow


def test_huge_texts_are_hashed_in_parts(spark):
    rows = [(1, "Äb" * 3000, None, None, 0), (2, "Äb" * 3000, None, None, 0), (3, "ÄB" * 3000, None, None, 0), (4, "Äb" * 2999 + "Äc", None, None, 0)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(spark.createDataFrame(rows, SCHEMA), huge_chars=1000).collect()}
    assert got == {1: (3, 3), 2: (3, 3), 3: (3, 3), 4: (4, 1)}


def test_hot_groups_of_copies_meet_in_pieces(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(400)]), rng.choice(["Same", "same", "SAME"] * 5 + ["other", "Other", "", None, f"t{i}"]), None, None, 0) for i in range(600)]
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, top[x], len(groups[x]), i == top[x], hashlib.sha256(x.encode()).hexdigest()) for i, x in ((i, (t or "").lower()) for i, t, *_ in rows)), key=str)
    got = exact.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), salt_rows=20).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_equal_prints_of_unequal_texts_are_told_apart(spark, monkeypatch):
    batch = [("a", True), ("a", False), ("b", False)]
    import pyarrow as pa

    rb = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array([x for x, _ in batch]), pa.array([[1]] * 3), pa.array([1] * 3), pa.array([0] * 3), pa.array([y for _, y in batch])], ["doc_id", "rk", "text", "print", "length", "salt", "is_leader"])
    assert [x for b in exact._compare([rb]) for x in b.column("same").to_pylist()] == [True, False]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_those_of_brute_force(spark, k):
    rng = random.Random(k)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.choice([1, 2, 12])):
            w = [x if rng.random() > 0.02 else "zz" for x in b]
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.3 else " ".join(w), None, None, 0))
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=k).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_long_words_with_a_regular_structure_are_told_apart(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    flip = word.translate({97: 98, 98: 97})
    rows = [(1, word), (2, flip), (3, f"x {word} y"), (4, f"x {flip} y"), (5, word.upper())]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_words_are_hashed_alike_in_every_segment(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("ab"[rng.random() < 0.5] * rng.choice([1, 2, 3, 40, 300]) for _ in range(rng.randint(0, 30))).encode() for _ in range(40)] + [b"", b" \n ", b"x" * 5000]
    want = common.word_hashes(texts)
    seen = {}
    for t, first, stop in zip(texts, [0, *want[1]], want[1]):
        words = t.split()
        assert stop - first == len(words)
        for w, h in zip(words, want[0][first:stop].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for n in (1, 7, 64, 1000):
        monkeypatch.setattr(common, "SEGMENT", n)
        got = common.word_hashes(texts)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_buckets_of_unlinked_members_lose_no_link(spark, monkeypatch):
    """Texts that share half their words meet in large buckets without being similar; some pairs among them are."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(12)
    common_part = [f"c{i}" for i in range(60)]
    rows, sets = [], []
    for i in range(150):
        own = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 10, 25]))]
        rows.append((i, " ".join(common_part + own)))
    sets = [shingles(t, 2) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {i: root(i) for i in range(len(rows))}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert len(set(want.values())) > 20 and got == want


def test_b_bit_estimates():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    for share in (0.2, 0.5, 0.9):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 1 << 63, len(a) - n, dtype=np.uint64)]))
        s = minhash.pack(minhash.minima([a, b], 800))
        assert abs(minhash.estimate(minhash.unequal(s[0], s[1]), 800) - share) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 150)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 200: 150}
    rng = random.Random(3)
    for n, m in ((0, 5), (30, 40), (60, 60), (25, 40)):
        edges = [(rng.randrange(m), rng.randrange(m)) for _ in range(n)]
        least = {x: x for e in edges for x in e}
        for _ in range(m):
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == {x: c for x, c in least.items() if x in linked}


@given(st.text(alphabet="aB9@.+-_% ()1é\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_spans_are_those_of_the_plain_patterns(text):
    want = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                want.append((m.start(), m.end(), kind))
    assert pii.base_spans(text) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_long_parts_of_addresses_and_long_texts(spark):
    text = "0" * 5000 + ".1.1.1 and 1.2.3." + "9" * 6000 + " 256.1.1.1 " + "@" * 100_000
    assert pii.base_spans(text) == [(0, 5006, "ip")]
    got = pii.find_personal(spark.createDataFrame([(1, text, None, None, 0), (2, "7" * 300_000, None, None, 0)], SCHEMA)).orderBy("doc_id").collect()
    assert (got[0].n_ip, got[0].base_sha256, got[1].n_spans) == (1, hashlib.sha256(b"ip:0:5006").hexdigest(), 0)


def test_documents_do_not_change_each_others_labels():
    rng = random.Random(6)
    pool = ["+15550109999", "15550109999", "555-010-9999", "(555)0109999", "a.b@c.de", "a.b@x.org", "10.0.0.1", "10.0.0.1:80", "4111111111111111", "4111-1111-1111-1111", "4111111111111112", "99", "word"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    skip = np.diag([50.0] * 5)
    model = pii.Model({pii.shape(t): np.array([5.0, 1, 1, 1, 1]) for t in pool[:-1]}, np.ones((5, 5)), skip)
    together = pii.spans_of_all(texts, model)
    assert together == [pii.spans_of(t, model) for t in texts] and any(len(a) > len(b) for b, a in together)
    # the field runs where no base span is: here the shape alone says what the tokens are
    sure = pii.Model({pii.shape("99"): np.array([1.0, 0, 0, 0, 200])}, np.ones((5, 5)), skip)
    assert pii.spans_of("at 99 or 98", sure) == ([], [(3, 5, "phone"), (9, 11, "phone")])


def test_marginals_on_a_tree_are_exact():
    """Three nodes in a chain: sums over all labellings."""
    rng = np.random.default_rng(3)
    model = pii.Model({"s": rng.random(5) * 9, "t": rng.random(5) * 9}, rng.random((5, 5)) * 9, rng.random((5, 5)) * 9)
    nodes = [(0, 1, None, "s", ("", "")), (2, 3, None, "t", ("", "")), (4, 5, None, "s", ("", ""))]
    want = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        p = np.exp(sum(model.shape[n[3]][k] for n, k in zip(nodes, y))) * model.pairs[0][y[0], y[1]] * model.pairs[0][y[1], y[2]]
        for i, k in enumerate(y):
            want[i, k] += p
    assert np.allclose(model.infer([nodes])[0], want / want.sum(axis=1, keepdims=True), atol=2e-3)


def test_luhn_and_repeats():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    shapes = {pii.shape("99"): np.array([50.0, 0, 0, 0, 0]), pii.shape("+15550109999"): np.array([0, 0, 0, 0, 50.0]), pii.shape("15550109999"): np.array([5, 0, 0, 0, 4.0])}
    skip = np.zeros((5, 5))
    skip[4, 4] = 50
    skip[0, 0] = 50
    model = pii.Model(shapes, np.ones((5, 5)), skip)
    text = "call +15550109999 now. it is 15550109999 again, not 99"
    base, every = pii.spans_of(text, model)
    assert base == [(5, 17, "phone")] and every == [(5, 17, "phone"), (29, 40, "phone")]


@pytest.mark.parametrize("n", [1, 5, 8, 12, 30, 300])
@pytest.mark.parametrize("first", [True, False])
def test_every_repeat_of_a_base_span_is_labelled(n, first):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    shapes = {pii.shape("99"): np.array([50.0, 0, 0, 0, 0]), pii.shape("+15550109999"): np.array([0, 0, 0, 0, 50.0]), pii.shape("15550109999"): np.array([5, 0, 0, 0, 4.0])}
    skip = np.zeros((5, 5))
    skip[4, 4] = 50
    skip[0, 0] = 50
    model = pii.Model(shapes, np.ones((5, 5)), skip)
    base, bare = "+15550109999", "15550109999"
    text = " and ".join([base] + [bare] * n if first else [bare] * n + [base])
    found, every = pii.spans_of(text, pii.Model(shapes, np.ones((5, 5)), skip))
    assert len(found) == 1 and [text[a:b].lstrip("+") for a, b, k in every if k == "phone"] == [bare] * (n + 1)


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=100, deadline=None)
def test_ids_of_both_tokenizer_files_are_the_same(texts):
    import public_tokenizers

    assert pack.encoder(public_tokenizers.path("byte_bpe_50k.json"))(texts) == pack.encoder(queries.tokenizer_path())(texts)


def test_ids_of_added_tokens_and_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|> b", "<|endoftext|>", "a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "\u3000 \t" * 400_000, "x " + " " * 999 + "y"]
    want = [np.array(untouched.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert np.frombuffer(want[1], "<u4").tolist() == [50256]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        assert pack.encoder(public_tokenizers.path(name))(texts) == want
    got = pack.pack(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), queries.tokenizer_path()).collect()
    assert {r.doc_id: r.ids_crc32 for r in got if r.doc_id < 2} == {k: zlib.crc32(w + np.array([2], "<u4").tobytes()) for k, w in enumerate(want[:2])}
    for k, w in enumerate(want):
        assert sum(r.length for r in got if r.doc_id == k) == len(w) // 4 + 1


def test_packing_is_gapless_and_tight(spark):
    got = queries.op5_pack(spark, SF).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024) + 1
    docs = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    encode = pack.encoder(queries.tokenizer_path())
    for doc, g in got.sort_values("piece").groupby("doc_id"):
        ids = encode([docs[doc]])[0] + np.array([2], "<u4").tobytes()
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() * 4 == len(ids)
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(g.start, g.length)] == g.ids_crc32.tolist()


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(1, 100, 300))[::-1].astype(float)
    items = np.stack([n, np.ones(300), n * n], axis=1)
    cap = np.array([100.0, 4, 6000])
    items = items[items[:, 2] <= 6000]
    for rule in ("norm", "dot"):
        bins = pack.best_fit(items, cap, np.array([1.0, 0.5, 0.5]), rule)
        for k in range(3):
            assert np.bincount(bins, items[:, k]).max() <= cap[k] + 1e-6


def test_language_model_on_held_out_rows(spark):
    got = queries.op6_langid(spark, SF).join(common.documents(spark, SF).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    model = langid.Model(["aa", "bb"], np.array([1, 1]), np.ones((2, langid.BUCKETS)))
    assert model.predict([None, "", "123 !", "x"])[:3] == [("und", 0.0)] * 3


def test_license_spans_of_many_diagonals(spark):
    """Runs of neighbouring diagonals by brute force, on texts that repeat pieces of the templates; a long one in linear time."""
    templates = {"abc": "one two three four five six seven eight", "xyz": "alpha beta gamma delta epsilon zeta"}
    rng = random.Random(2)
    words = [*templates["abc"].split(), *templates["xyz"].split(), "noise", "other"]
    texts = []
    for _ in range(40):
        made = []
        while len(made) < rng.randint(1, 60):
            t = rng.choice(list(templates.values())).split()
            a = rng.randrange(len(t))
            made += t[a : a + rng.randint(1, 8)] + rng.choices(words, k=rng.choice([0, 0, 1, 5]))
        texts.append(" ".join(made))
    got = {}
    hits = license.license_hits(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, rk long, text string"), {}, templates)
    for r in hits.collect():
        got.setdefault(r.doc_id, set()).add((r.label, r.first, r.last, round(r.share, 6)))
    for i, text in enumerate(texts):
        w, want = text.split(), set()
        for label, t in templates.items():
            t = t.split()
            votes = sorted((p - a, a, p) for p in range(len(w) - 1) for a in range(len(t) - 1) if (w[p], w[p + 1]) == (t[a], t[a + 1]))
            run = []
            for v in [*votes, (10**9, 0, 0)]:
                if run and v[0] - run[-1][0] > license.GAP:
                    share = len({a for _, a, _ in run}) / (len(t) - 1)
                    if share >= license.SHARE:
                        want.add((label, min(p for _, _, p in run), max(p for _, _, p in run), round(share, 6)))
                    run = []
                run.append(v)
        assert got.get(i, set()) == want, text
    long = " ".join(["one two noise noise noise noise noise"] * 30_000)
    assert license.scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().n_words == 210_000


def test_language_scores_are_those_of_plain_naive_bayes():
    """Each text's posterior by sums over its n-grams, one by one."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, (3, langid.BUCKETS))
    docs = np.array([5, 3, 2])
    model = langid.Model(["aa", "bb", "cc"], docs, counts)
    texts = ["Hello, world", "é", "a b", "", None, "12 !", "x" * 50, "Ab1cd ef", "ZZZ\nzz", "straße und weg " * 30]
    logp = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)

    def bucket(gram):
        h = np.uint32(2166136261 + len(gram))
        with np.errstate(over="ignore"):
            for c in gram:
                h = (h ^ np.uint32(ord(c))) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
        return int(h) % langid.BUCKETS

    for text, (lang, score) in zip(texts, model.predict(texts)):
        plain = "  " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
        grams = [plain[i : i + n] for n in langid.GRAMS for i in range(len(plain) - n + 1) if any(c.isalpha() for c in plain[i : i + n])]
        if not grams:
            assert (lang, score) == ("und", 0.0)
            continue
        x = np.log(docs / docs.sum()) + sum(logp[:, bucket(g)].astype(float) for g in grams)
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 1e-6
    assert model.predict(texts) == [x for t in texts for x in model.predict([t])]


def test_license_places(spark):
    text = "All Rights Reserved. cc-BY CC BY! the GNU General  Public\nLicense; general public. all rights reserved"
    notice = "x y Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files"
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (2, notice, None, None, 0), (3, "nothing", None, None, 0)]
    got = license.scan_licenses(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    one = got[0].asDict()
    assert got[0] == got[1] and (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (17, 5, 0, 14, "cc-by,gpl,reserved")
    assert got[2].labels == "mit" and got[2].base_labels == "" and 0.5 <= got[2].score < 1
    assert (got[3].labels, got[3].score, got[3].first_word) == ("", 0.0, None)


@given(st.lists(st.integers(-5, 5).filter(bool), max_size=25))
@settings(max_examples=300, deadline=None)
def test_maximal_segments(scores):
    def best(lo, hi):
        """All maximal segments by their definition: the best one, then those on either side of it."""
        found = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        if not found or max(found)[0] <= 0:
            return []
        s, _, _, i, j = max(found)
        return best(lo, i) + [(i, j, s)] + best(j, hi)

    assert sum(s for _, _, s in toxicity.segments(scores)) == sum(s for _, _, s in best(0, len(scores)))
    top = max((s for _, _, s in best(0, len(scores))), default=0)
    assert max((s for _, _, s in toxicity.segments(scores)), default=0) == top


def maximal(scores):
    """Maximal scoring segments by their properties: every part that starts or ends the segment has a positive sum, and no longer
    segment with that property holds it."""
    n, sums = len(scores), [0, *itertools.accumulate(scores)]
    good = lambda a, b: all(sums[k] > sums[a] for k in range(a + 1, b + 1)) and all(sums[k] < sums[b] for k in range(a, b))
    found = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if good(a, b)]
    return [(a, b, sums[b] - sums[a]) for a, b in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found)]


@given(st.lists(st.integers(-9, 9).filter(bool), max_size=25))
@settings(max_examples=300, deadline=None)
def test_segments_are_the_maximal_ones(scores):
    assert sorted(toxicity.segments(scores)) == sorted(maximal(scores))
    places = [i for i, s in enumerate(scores) if s > 0]
    plain = [scores[i] if i in places else -0.5 for i in range(len(scores))]
    sparse = toxicity.sparse_segments(places, [scores[i] for i in places], 0.5)
    assert sorted(sparse) == sorted(maximal(plain))


def test_scale_of_chance_is_fitted():
    """Best segments drawn from an extreme-value law with a known K give it back."""
    rng = np.random.default_rng(8)
    n, decay, scale = 400, 0.7, 0.03
    # P(best < s) = exp(-K n exp(-decay s)), and no segment where that is under 0
    best = np.maximum(0, -np.log(-np.log(rng.random(20_000)) / (scale * n)) / decay)
    assert abs((best > 0).sum() / (n * np.exp(-decay * best)).sum() / scale - 1) < 0.03


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    docs, marks = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_toxicity(spark, sf).join(marks, "doc_id").where("held_out").toPandas()
    assert docs.count() >= len(got) > 500
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() > 0.8 and hit.sum() / (got.predicted == 1).sum() > 0.85


def test_toxicity_reads_texts_in_short_batches(spark, tmp_path):
    """4096 texts at a time are one array of the JVM, which doubles until it holds them."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    spark.range(2000).selectExpr("id AS doc_id", "concat('words of row ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs, model = spark.read.parquet(f"{tmp_path}/documents.parquet"), toxicity.Model({"row": (1.0, 3.0)}, shift=-10.0)
    for made in (toxicity.score_documents, toxicity.drop_toxic):
        spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
        run = made(docs, model)._jdf.queryExecution()
        assert run.toRdd().count() == 2000
        batches = [p.metrics().apply("numInputBatches").value() for p in nodes(run.executedPlan()) if p.metrics().contains("numInputBatches")]
        assert len(batches) == 1 and batches[0] >= 2000 / 128


MESSAGE = "conv_id long, turn long, text string"


def test_quotes_are_linked_and_ordered(spark):
    rows = [(1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "> hello   THERE\nmy answer"), (2, 0, "u", ">> Hello there\n> my answer\nI agree"), (3, 0, "u", "> never said\nx"), (4, 0, "u", None), (None, 0, "u", "> Hello there")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df).collect()}
    assert (got[1, 1].parent_conv, got[1, 1].parent_turn, got[1, 1].own_text) == (1, 0, "my answer")
    r = got[2, 0]
    assert (r.thread_id, r.parent_conv, r.parent_turn, r.n_quoted, r.n_linked, r.max_level, r.own_text) == (1, 1, 1, 2, 2, 2, "I agree")
    assert (got[3, 0].n_linked, got[3, 0].parent_conv, got[4, 0].own_text) == (0, None, "")
    assert [got[k].reply_order for k in ((1, 0), (1, 1), (2, 0))] == [0, 1, 2] and got[None, 0].thread_id is None
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_common_phrases_and_repeated_messages(spark):
    rows = [(c, t, x) for c in (1, 5, 11, 12) for t, x in ((0, "thanks"), (1, "> thanks\nwell"))] + [(20, 0, "> thanks\nfrom none of them")]
    rows += [(30, 0, "said once"), (31, 0, "> said once\nyes"), (31, 0, "> said once\nyes"), (32, None, "> said once\nno turn"), (33, 0, "> said once\na"), (33, 0, "> said once\n\n> said once\nb")]
    got = quotes.link_quotes(spark.createDataFrame(rows, MESSAGE)).collect()
    at = {}
    for r in got:
        at.setdefault((r.conv_id, r.turn), []).append(r)
    for c in (1, 5, 11, 12):
        assert (at[c, 1][0].thread_id, at[c, 1][0].parent_conv, at[c, 1][0].parent_turn, at[c, 1][0].n_linked) == (c, c, 0, 1)
    assert (at[20, 0][0].thread_id, at[20, 0][0].n_linked) == (20, 0)
    assert [(r.n_quoted, r.n_linked, r.thread_id) for r in at[31, 0]] == [(1, 1, 30)] * 2 and sorted(r.n_linked for r in at[33, 0]) == [1, 2]
    assert (at[32, None][0].n_quoted, at[32, None][0].n_linked, at[32, None][0].parent_conv) == (1, 1, 30)
    assert sorted(r.reply_order for r in got if r.thread_id == 30) == list(range(6))


def plain_links(rows):
    """n_linked and first level-1 origin of each message, by comparing every piece with all pieces of all messages."""
    norm = lambda t: " ".join(t.lower().split())
    cut = lambda t: [t, *re.split("\n[ \t]*\n", t), *t.split("\n")]
    runs = {}
    for conv, turn, text in rows:
        of = runs[conv, turn] = []
        for line in text.split("\n"):
            m = re.match(r"[ \t]*((?:>[ \t]?)*)", line)
            level, body = m[1].count(">"), line[m.end() :]
            if of and of[-1][0] == level:
                of[-1][1] += "\n" + body
            else:
                of.append([level, body])
    wrote = {k: {norm(p) for level, t in of if not level for p in cut(t)} - {""} for k, of in runs.items()}
    out = {}
    for (conv, turn), of in runs.items():

        def at(p):
            here = sorted(k for k in wrote if k[0] == conv and k[1] < turn and norm(p) in wrote[k])
            away = sorted(k for k in wrote if k[0] != conv and norm(p) in wrote[k])
            if here or not away or (len(norm(p).split()) < 4 and len({c for c, _ in away}) > 1):
                return here[0] if here else None
            return away[0]

        n, parent = 0, None
        for level, text in of:
            if not level or not norm(text):
                continue
            hits = [at(text)]
            if not hits[0]:
                hits = []
                for par in re.split("\n[ \t]*\n", text):
                    if norm(par):
                        hits += [at(par)] if at(par) else [at(line) for line in par.split("\n") if norm(line)]
            if all(hits):
                n += 1
                parent = parent or (level == 1 and min(hits, key=lambda k: (-hits.count(k), k))) or None
        out[conv, turn] = n, parent
    return out


def check_links(spark, rows):
    """Links and parents against plain_links, and in every thread parents before replies, but for circles of quotes."""
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, MESSAGE).repartition(3)).collect()}
    up = {}
    for (conv, turn), (n, parent) in plain_links(rows).items():
        r = got[conv, turn]
        before = max(((c, t) for c, t, _ in rows if c == conv and t < turn), default=(None, None))
        up[conv, turn] = parent or (before if before[0] is not None else None)
        assert (r.n_linked, (r.parent_conv, r.parent_turn)) == (n, parent or before), (conv, turn)
    threads = {}
    for k, r in got.items():
        threads.setdefault(r.thread_id, []).append((r.reply_order, k))
        circle, x = [k], up[k]
        while x is not None and x not in circle:
            circle.append(x)
            x = up[x]
        if up[k] is not None and not (x == k and k == min(circle)):
            assert got[up[k]].reply_order < r.reply_order and got[up[k]].thread_id == r.thread_id, (k, up[k])
    assert all(sorted(n for n, _ in t) == list(range(len(t))) for t in threads.values())
    return got


def test_a_parent_comes_before_its_replies(spark):
    got = check_links(spark, [(1, 0, "a first one"), (1, 1, "and the second message here"), (2, 0, "> and the second message here\nreply"), (2, 1, "more"), (3, 0, "> reply\nto the reply"), (4, 7, "late"), (4, 9, "later")])
    assert [got[k].reply_order for k in ((1, 0), (1, 1), (2, 0), (2, 1), (3, 0))] == [0, 1, 2, 4, 3] and got[4, 9].parent_turn == 7
    # circles: of two, of three, of a message that is quoted by what it answers, and chains that end in them
    rows = [(1, 0, "> two says this\none says this"), (2, 0, "> one says this\ntwo says this"), (3, 0, "> one says this\nthree"), (3, 1, "> three\nfour"), (5, 0, "> c writes\na writes"), (6, 0, "> a writes\nb writes"), (7, 0, "> b writes\nc writes"), (7, 1, "x")]
    got = check_links(spark, rows)
    assert {r.thread_id for k, r in got.items() if k[0] >= 5} == {5} and got[1, 0].reply_order == 0


def test_partial_quotes_link_as_by_brute_force(spark):
    rows = [(1, 0, "a\nb\nc"), (1, 1, "> a\n> b\nyes"), (1, 2, "> a\n> c"), (1, 3, "> a\n> z"), (2, 0, "p one\np two\n\nq\n\nr"), (2, 1, "> p one p two\n>\n> r\nfine"), (2, 2, "> q\n>\n> p two\n>\n> never")]
    # of a conversation with a larger id, of the message itself, of a later turn, and of one in two places
    rows += [(3, 0, "> from nine\nok"), (9, 0, "from nine"), (4, 0, "> mine\nmine"), (4, 1, "> later\nx"), (4, 2, "later"), (5, 0, "> both\nboth"), (6, 4, "both"), (7, 0, ">> both of these are long enough\n> a\n>\n> from nine"), (8, 0, "both of these are long enough")]
    got = check_links(spark, rows)
    assert [got[k].n_linked for k in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 0), (4, 0), (4, 1), (5, 0), (7, 0))] == [1, 1, 0, 1, 0, 1, 0, 0, 1, 2]
    assert got[3, 0].thread_id == got[9, 0].thread_id


def test_random_threads_link_as_by_brute_force(spark):
    rng = random.Random(5)
    said = ["l1", "l2 is a long enough one", "l3 is a long one too", "L4  x", "l5 y z w", "l6", "l7 has five words here", "", ""]
    rows = []
    for conv in range(20, 44):
        own = [f"line {conv} number {k}" for k in range(4)]
        for turn in range(3):
            rows.append((conv, turn * (1 + conv % 2), "\n".join(rng.choice(["", "", "> ", "> ", ">> "]) + rng.choice([*said, *own, f"line {rng.randint(20, 43)} number {rng.randint(0, 3)}"]) for _ in range(rng.randint(1, 6)))))
    check_links(spark, rows)


def test_recordings_are_aligned(spark):
    rng = np.random.default_rng(4)
    t = np.arange(1024) / 8000
    song = np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in rng.integers(-12, 12, 60)])
    cut = song[1024 * 10 : 1024 * 50] + 0.02 * rng.standard_normal(1024 * 40)
    other = np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in rng.integers(-12, 12, 60)])
    pcm = lambda x: bytearray((x * 9000).astype("<i2").tobytes())
    rows = [(20, pcm(cut), 8000), (21, pcm(song), 8000), (22, pcm(other), 8000), (23, None, 8000), (24, bytearray(b"abc"), 8000), (25, pcm(song), 8000)]
    got = chroma.align(spark.createDataFrame(rows, "id long, audio binary, rate int")).collect()
    assert [(r.query_id, r.match_id, r.copies, r.offset) for r in got] == [(20, 21, 2, 20)] and got[0].bit_error < 0.15
    frames = rng.random((40, 12))
    assert len(chroma.prints(frames)) == 40 - chroma.SPAN + 1 and len(chroma.prints(frames[:3])) == 0


def test_recall_of_noisy_cuts_that_begin_between_frames(spark):
    """Against brute force: every offset of every recording, by bit errors alone."""
    rng = np.random.default_rng(9)
    t = np.arange(1024) / 8000
    pcm = lambda x: bytearray((x * 9000).astype("<i2").tobytes())
    songs = [np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in rng.integers(-12, 12, 60)]) for _ in range(40)]
    cuts = []
    for i, s in enumerate(songs):
        first = 1024 * int(rng.integers(0, 20)) + (128, 256)[i % 2]
        cuts.append(s[first : first + 1024 * 40] + (0.02, 0.1, 0.2)[i % 3] * rng.standard_normal(1024 * 40))
    rows = [(20 * i, pcm(x), 8000) for i, x in enumerate(cuts)] + [(20 * i + 1, pcm(x), 8000) for i, x in enumerate(songs)]
    printed = {i: chroma.prints(chroma.chroma(np.frombuffer(bytes(x), "<i2"), r)) for i, x, r in rows}
    want = set()
    for q in range(len(cuts)):
        a = printed[20 * q]
        for r in range(len(songs)):
            b = printed[20 * r + 1]
            if min(np.bitwise_count(a ^ b[o : o + len(a)]).sum() for o in range(len(b) - len(a) + 1)) <= 0.2 * 32 * len(a):
                want.add((20 * q, 20 * r + 1))
    got = {(r.query_id, r.match_id) for r in chroma.align(spark.createDataFrame(rows, "id long, audio binary, rate int")).collect()}
    assert len(want) >= 40 and len(got & want) >= 0.9 * len(want)
    assert len({m for m in got if m[1] % 20 == 1} - want) <= 4


def chance_bound(m, chance, sigmas, most=0.2):
    return min(most, chance[0] - sigmas * chance[1] / m**0.5)


def test_groups_of_recordings_are_those_of_brute_force(spark):
    """The registered vectors, and near copies of some: every offset of every pair by bit errors alone, then components."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    x = np.array(pq.read_table(f"{SF}/embeddings.parquet").column("embedding").to_pylist())[:150]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for k, n in ((3, 1), (40, 1), (77, 12), (120, 3)):
        for _ in range(n):
            rows.append((len(rows), (x[k] + rng.normal(0, 0.012, 64)).tolist()))
    rows += [(len(rows), x[5].tolist()), (len(rows) + 1, x[5][:50].tolist()), (len(rows) + 2, x[9][::-1].tolist()), (None, x[5].tolist()), (9000, None), (9001, []), (9002, [None] * 64)]
    media = queries.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = chroma.group(media, chance=queries.CHORD_CHANCE, sigmas=7.0).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got if r.id is not None}
    prints = {r.id: chroma.prints(chroma.chroma(np.frombuffer(bytes(r.audio), "<i2"), r.rate)) for r in media.where("id IS NOT NULL").collect()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    found = 0
    for a, b in itertools.combinations(sorted(i for i, p in prints.items() if len(p)), 2):
        p, q = prints[a], prints[b]
        for off in range(-len(p) + 1, len(q)):
            u, v = p[max(0, -off) :], q[max(0, off) :]
            m = min(len(u), len(v))
            bound = chance_bound(m, queries.CHORD_CHANCE, 7.0)
            if bound >= 0 and np.bitwise_count(u[:m] ^ v[:m]).sum() <= bound * 32 * m:
                found += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
                break
    want = {i: root(i) for i in prints}
    sizes = {g: sum(1 for j in want.values() if j == g) for g in want.values()}
    assert found >= 17 + 60 and len(set(want.values())) < len(want) - 15
    right = sum(by[i].group_id == g for i, g in want.items())
    assert right >= 0.99 * len(want)
    # no group holds two of brute force, and nine tenths of its pairs are found
    assert all(want[r.group_id] == want[r.id] for r in by.values())
    pairs = [(a, b) for a, b in itertools.combinations(sorted(want), 2) if want[a] == want[b]]
    assert sum(by[a].group_id == by[b].group_id for a, b in pairs) >= 0.9 * len(pairs)
    for r in by.values():
        assert r.n_prints == len(prints[r.id]) and (r.match_id is None) == (r.offset is None)
        if r.match_id is not None:
            p, q = prints[r.id], prints[r.match_id]
            u, v = p[max(0, -r.offset) :], q[max(0, r.offset) :]
            m = min(len(u), len(v))
            assert r.match_id < r.id and abs(np.bitwise_count(u[:m] ^ v[:m]).sum() / (32 * m) - r.bit_error) < 1e-12
    assert sizes[want[77]] >= 13 and [r.group_id for r in got if r.id is None] == [None]
    assert by[9000].n_prints == by[9001].n_prints == 0 and by[9000].group_id == 9000


def test_groups_of_hard_recordings(spark):
    clashes = {c: F.lit(1) for c in ("cls", "name", "q", "r", "prints", "key", "at", "copies", "comp", "group_id", "m")}
    rng = np.random.default_rng(2)
    t = np.arange(1024) / 8000
    song = (np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in rng.integers(-12, 12, 60)]) * 9000).astype("<i2")
    rows = [(7, bytearray(song.tobytes()), 8000), (7, bytearray(song.tobytes()), 8000), (7, bytearray(song[1024 * 8 :].tobytes()), 8000), (9, bytearray(song[1024 * 4 :].tobytes()), 8000), (None, bytearray(song.tobytes()), 8000), (11, None, 8000), (12, bytearray(), None), (13, bytearray(400_000), 8000), (14, bytearray(400_000), 8000), (15, bytearray(300_000), 8000), (16, bytearray(b"abc"), 0)]
    media = spark.createDataFrame(rows, "id long, audio binary, rate int").withColumns(clashes)
    got = chroma.group(media).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
    at = {r.id: r for r in got}
    assert at[9].group_id == 7 and at[9].match_id == 7 and at[9].group_size >= 3 and at[9].offset in (8, 0, -8)
    assert (at[14].group_id, at[14].match_id, at[14].bit_error, at[14].group_size) == (13, 13, 0.0, 3) and at[15].group_id == 13 and at[11].group_id == 11
    assert chroma.group(media.limit(0)).count() == 0


def test_rest_of_a_key_loses_no_link(spark, monkeypatch):
    """Where the smallest sound of a key is like none of the others, the others are still linked."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, 80, dtype=np.uint64)
    other = rng.integers(0, 1 << 32, 80, dtype=np.uint64)
    other[30], other[46] = base[30], base[46]
    near = [base.copy() for _ in range(3)]
    for k, p in enumerate(near):
        p[[i for i in range(80) if i not in (30, 46)]] ^= np.uint64(1 << k)
    sounds = {1: other, **{2 + k: p for k, p in enumerate(near)}}
    rows = [(i, hashlib.md5(p.tobytes()).digest(), [int(v) for v in p]) for i, p in sounds.items()]
    made = spark.createDataFrame([(i, bytearray(c), p, []) for i, c, p in rows], "id long, cls binary, prints array<long>, weak array<long>")
    monkeypatch.setattr(chroma, "fingerprints", lambda *a: made)
    got = {r.id: r.group_id for r in chroma.group(made).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2}


def test_pipeline_keeps_clean_documents_once(spark):
    import corpus_pipeline

    docs = common.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, common.staged(stage(spark, docs, SF), name)
        assert docs.columns == before.columns
    texts = [r.text.lower() for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    kept = {r.doc_id: r.n for r in common.staged(corpus_pipeline.mix_sources(spark, docs, SF), "mixed").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r.doc_id: r.copies for r in mix.mix(docs).where("copies > 0").collect()}
    assert kept == want


def test_pipeline_is_that_of_plain_stages(spark):
    """run() against a loop for each stage; the toxicity model's scores are taken as they are."""
    import corpus_pipeline

    docs, before = common.documents(spark, SF), len(common._folders)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(common._folders) == before + 1
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score_documents(docs, model).where("score < 0.3").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in clean}
    last = {}
    for i, r in rows.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        last[key] = max(i, last.get(key, i))
    ids = sorted(last.values())
    sets = {i: shingles(rows[i].text, 5) for i in ids}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    left = [i for i in ids if root(i) == i]
    sizes = {i: len(re.findall(common.WORD, rows[i].text)) for i in left}
    taken, _ = greedy([(i, sizes[i], rows[i].source) for i in left], lambda n: int(n**0.5))
    encode, want = pack.encoder(queries.tokenizer_path()), []
    for i, n, t in taken:
        data = encode([rows[i].text])[0] + np.array([2], "<u4").tobytes()
        first = len(data) // 4 % 1024 or 1024
        bounds = [0, *range(first, len(data) // 4 + 1, 1024)]
        for _ in range(t // n if n else 0):
            want += [(i, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert len(want) > 150 and sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024


def test_pipeline_stages_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = {c: F.lit(7) for c in ("row_key", "gone_key", "group", "rank", "copies", "mix_id", "copy", "size", "cls", "kept", "top")}
    docs = spark.createDataFrame(HARD, SCHEMA).withColumns(extra)
    for rows in (docs, docs.limit(0)):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.staged(stage(spark, now, str(tmp_path)), name)
            assert now.columns == docs.columns and now.where("copies != 7 OR row_key != 7").isEmpty()
        packed = corpus_pipeline.pack_sequences(spark, now, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in now.select("doc_id").collect()}
    # of the rows "one", the last one alone is left by the dedups, and texts without words by all stages up to the mix
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.exact_dedup(spark, docs, SF), SF).collect()
    assert sorted((r.doc_id for r in left), key=str) == sorted([2, 3, 5, 7, 8, 9], key=str)


def test_dedup_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    x, y, z, u = (" ".join(f"{w}{i}" for i in range(60)) for w in "xyzu")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = [(5, x), (5, y), (9, x), (7, z), (7, z), (None, u), (None, u), (None, x), (None, y + " end")]
    assert left(corpus_pipeline.exact_dedup(spark, make(rows), SF)) == sorted([(5, y), (9, x), (7, z), (None, u), (None, y + " end")], key=str)
    rows = [(5, x + " end"), (5, y), (3, x), (7, z), (7, z + " end"), (None, u), (None, u + " end"), (None, y + " end")]
    got = left(corpus_pipeline.near_dedup(spark, make(rows), SF))
    assert [(k, t.removesuffix(" end")) for k, t in got] == sorted([(3, x), (5, y), (7, z), (None, u)], key=str)


def test_hash_of_equal_words_in_other_places():
    h, stops = common.word_hashes([b"A b a", b"", b"  a\tB "])
    assert h[0] == h[2] == h[3] and h[1] == h[4] and stops.tolist() == [3, 3, 5]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_license_base_places_are_those_of_brute_force(spark):
    rng = random.Random(8)
    words = "cc by general public license all rights reserved x Kéy".split()
    texts = ["".join(rng.choice([w, w.upper()]) + rng.choice([" ", "\n", ", ", "-"]) for w in rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
        at = [(k, label) for label, phrase in license.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want


def test_messages_and_recordings_of_hard_rows(spark):
    clashes = {c: F.lit(1) for c in ("conv", "level", "digest", "thread_id", "node", "t", "cls", "name", "q", "r", "prints", "print", "copies", "b")}
    talk = [(1, None, "u", "> a\nb"), (1, 0, "u", ""), (1, 0, "u", None), (2, 0, "u", "> " * 50 + "deep"), (2, 1, None, "x" * 200_000), (2, 1, None, "x" * 200_000), (None, None, None, None)]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumns(clashes)
    got = quotes.link_quotes(df).collect()
    assert sorted((str(r.conv_id), str(r.turn)) for r in got) == sorted((str(c), str(t)) for c, t, _, _ in talk)
    assert sorted(r.reply_order for r in got if r.conv_id == 2) == [0, 1, 2] and max(r.max_level for r in got if r.conv_id == 2) == 50
    sound = bytearray((np.sin(np.arange(60_000) * 0.3) * 9000).astype("<i2").tobytes())
    rows = [(20, sound, 8000), (20, sound, 8000), (None, sound, 8000), (40, bytearray(), 8000), (60, sound, None), (80, sound, 0), (81, bytearray(400_000), 8000), (100, bytearray(400_000), 8000)]
    media = spark.createDataFrame(rows, "id long, audio binary, rate int").withColumns(clashes)
    found = {(r.query_id, r.match_id): r.copies for r in chroma.align(media).collect()}
    assert found == {(20, 20): 2, (100, 81): 2}
    assert chroma.align(media.limit(0)).count() == 0
