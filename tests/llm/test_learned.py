"""Near-duplicates, neighbours and chains against brute force and held-out rows."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.llm import bagminhash, chains, mih
from tessitura.llm.common import give_back
from tessitura.llm.components import components


def bag(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weighted(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    d = []
    for i in range(300):
        base = [f"{i}w{j}" for j in range(60)]
        other = list(base)
        for p in rng.integers(0, 60, 3):
            other[p] = "x"
        d.append((" ".join(base + ["r"] * int(rng.integers(5, 40))), " ".join(other + ["r"] * int(rng.integers(5, 40)))))
    s = bagminhash.signatures(*bagminhash.bags(pa.array([t for p in d for t in p])), 600)
    got = (s[::2] == s[1::2]).mean(axis=1)
    want = np.array([weighted(bag(a), bag(b)) for a, b in d])
    assert abs((got - want).mean()) < 0.012 and np.sqrt(((got - want) ** 2).mean()) < 0.075 and (s != 0).all()


def _documents():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):  # a base, close copies, copies of copies, and a text that shares a passage
        base = [word() for _ in range(r.randint(40, 90))]
        texts.append(" ".join(base))
        cur = base
        for _ in range(6):
            cur = list(cur)
            cur[r.randrange(len(cur))] = word()
            texts.append(" ".join(cur))
        texts.append(" ".join([word() for _ in range(40)] + base[:30]))
    cloud = [word() for _ in range(80)]
    for _ in range(120):  # many that are near each other in part
        c = list(cloud)
        for _ in range(r.randint(0, 3)):
            c[r.randrange(80)] = word()
        texts.append(" ".join(c))
    return texts + ["", None, " ", "one", "One", "one", texts[0], texts[0].upper(), "a b", "rep " * 300, "rep " * 280]


def test_classes_equal_brute_force(spark):
    texts = _documents()
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(5, texts[5], "again"), (None, "lonely text of a null id here", "n")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, class string").repartition(5)
    got = {}
    for r in bagminhash.classes(d).collect():
        got[r.doc_id] = (r.class_id, r.class_size)
    bags, root = [bag(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or (bags[i] and bags[j] and weighted(bags[i], bags[j]) >= 0.8):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    size = Counter(find(i) for i in range(len(texts)))
    size[find(5)] += 1
    assert {i: got[i] for i in range(len(texts))} == {i: (find(i), size[find(i)]) for i in range(len(texts))}
    assert got[None] == (None, 1)
    kept = bagminhash.kept(d)
    assert kept.columns == d.columns and kept.count() == len(size) + 1
    assert bagminhash.classes(d.where("false")).count() == 0


def test_kept_with_repeated_and_null_ids(spark):
    many = "a text of some words that all these rows have in common"
    rows = [(1, many, 9, 9), (1, many, 9, 9), (1, many + " x", 9, 9), (2, "quite another text of more than five words", 9, 9), (None, "null one text with six words", 9, 9), (None, "null one text with six words", 9, 9), (1, "alone", 9, 9)]
    rows += [(100 + i, many, 9, 9) for i in range(3000)] + [(5000 + i, f"text number {i} of its own and no other", 9, 9) for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, node int, __n int").repartition(6)
    got = bagminhash.kept(d)
    assert got.columns == d.columns
    texts = [(r.doc_id, r.text, r.node, r["__n"]) for r in got.collect()]
    alone = [r for r in texts if r[0] is None or r[0] >= 5000 or r[1] in ("alone", rows[3][1])]
    assert len(alone) == 53 and len(texts) == 54 and {r[2:] for r in texts} == {(9, 9)}
    c = {r.doc_id: (r.class_id, r.class_size) for r in bagminhash.classes(d).collect()}
    assert c[105] == (1, 3003) and c[None] == (None, 2) and c[5001] == (5001, 1)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(200, 300), (300, 250)]
    d = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.label for r in components(d).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 1 for i in range(2, 60)}, 250: 200, 300: 200}
    assert components(d.where("false")).count() == 0


def _vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    same = rng.standard_normal(32).tolist()
    rows += [(3000 + i, same, "x") for i in range(500)]
    rows += [(5000, None, "x"), (5100, [0.0] * 32, "x"), (5200, [None] + [1.0] * 31, "x"), (5300, [float("nan")] * 32, "x"), (5400, [1.0], "x"), (None, same, "x")]
    return rows


def test_neighbours(spark):
    rows = _vectors()
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = {}
    for r in mih.search(d, d.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and len(v) == 32 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hits = 0
    queries = [i for i in ids if i % 100 == 0]
    assert sorted(got) == sorted(queries)
    for i in queries:
        dist = np.sqrt(((x - x[ids == i][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, dist)) if ids[j] != i][:10]
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(m[2] - dist[ids == m[1]][0]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & {*ids[order].tolist()})
        if i >= 3000:
            assert [m[1] for m in mine] == ids[order].tolist()
    assert hits >= 0.95 * 10 * len(queries)
    few = d.where("vec_id in (0, 1, 2)")
    assert mih.search(few, few).count() == 6 and mih.search(few.where("false"), few).count() == 0


def _recall(spark, x, k=10):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in mih.search(d, d.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i, mine in got.items():
        dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), dist)) if j != i][:k]
        assert [m[0] for m in sorted(mine)] == list(range(1, k + 1)) and all(abs(m[2] - dist[m[1]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & {*order})
    assert sorted(got) == list(range(0, len(x), 100))
    return hits / (k * len(got))


def test_neighbours_by_key_where_vectors_have_structure(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((300, 32))
    x = np.repeat(centres, 20, axis=0) + 0.05 * rng.standard_normal((6000, 32))
    x = np.concatenate([x, rng.standard_normal((40, 32)) * 3])  # and some far from all others
    model = mih.fit(x)
    assert model.reached < 0.1, model.reached
    codes = model.codes(x)
    for i in (0, 77, 6010):
        far = mih.limits(model.radius, codes.shape[1])
        found = {int(v) for v in mih.probes(codes[i], model.radius)}
        by_keys = np.array([any((j << 16) + int(c[j]) in found for j in range(len(c))) for c in codes[:500]])
        assert (by_keys == (np.bitwise_count(codes[:500] ^ codes[i]) <= far).any(axis=1)).all()
    monkeypatch.setattr(mih, "HOT", 50)
    assert _recall(spark, x) >= 0.9


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(mih, "INDEX_BLOCK", 700)
    monkeypatch.setattr(mih, "QUERY_BLOCK", 9)
    assert _recall(spark, np.random.default_rng(9).standard_normal((4000, 32))) >= 0.9


@pytest.mark.parametrize("radius", [0, 5, 16, 33, 47])
def test_probing_finds_every_code_in_the_radius(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 16, (2000, 4)).astype(np.uint16)
    codes[:200] = codes[0] ^ (1 << rng.integers(0, 16, (200, 4))).astype(np.uint16)
    t = mih.Index(codes)
    for q in (codes[0], codes[500]):
        assert t.within(q, radius).tolist() == np.flatnonzero(mih.hamming(codes, q) <= radius).tolist()


def test_chain_uses_earlier_categories():
    r = random.Random(1)
    rows = []
    for i in range(600):
        junk, mean = r.random() < 0.3, r.random() < 0.5
        words = {r.choice("abcdefghij") * 5 for _ in range(6)} | ({"rubbish"} if junk else set()) | ({"nasty"} if mean else set())
        rows.append((chains.codes(" ".join(sorted(words))), (int(junk), int(junk and mean))))
    chain = chains.fit(rows, ["junk", "toxic"])
    assert chain[1].earlier[0] > 0.5 and chain[0].weights[chains.code("rubbish")] > 1 and chain[1].weights[chains.code("nasty")] > 1
    assert chains.fit([], ["junk"])[0].threshold == 2.0 and chains.fit([(chains.codes("a"), (0,))], ["junk"])[0].weights == {}


def test_toxic_documents_are_found(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(700):
        toxic = i % 7 == 0
        words = ["".join(r.choice("aeioulmnt") for _ in range(5)) for _ in range(30)]
        if toxic:
            words[r.randrange(30)] = r.choice(["Idiot", "scum!", "idiotisch"])
        rows.append((i, " ".join(words), "c"))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "c"), (1001, "", "c"), (1, rows[1][1], "c")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, is_toxic string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    chain = chains.chain_for(d, lab)
    got = {x.doc_id: x for x in chains.score(d, chain).collect()}
    assert [i for i in range(700) if got[i].is_toxic] == list(range(0, 700, 7)) and not got[1000].is_toxic
    kept = chains.clean(d, chain)
    assert kept.columns == d.columns and kept.count() == len(rows) - 100
    none = chains.chain_for(d.where("false"), lab.where("false"))
    assert chains.score(d.where("false"), none).count() == 0 and chains.clean(d, none).count() == len(rows)


def test_scores_equal_a_slow_version_and_three_categories_chain(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(60)] + ["rubbish", "IDIOT", "scum!!", "Höhle", "don't", "x-y", "10%"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(300)]
    junk, mean = [int("rubbish" in t) for t in texts], [int("IDIOT" in t or "scum" in t) for t in texts]
    both = [int(a and b) for a, b in zip(junk, mean)]
    chain = chains.fit([(chains.codes(t), (a, b, c)) for t, a, b, c in zip(texts, junk, mean, both)], ["junk", "mean", "both"])
    assert [len(c.earlier) for c in chain] == [0, 1, 2] and chain[2].earlier[0] > 0 and chain[2].earlier[1] > 0
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "rubbish " * 30_000])], "doc_id int, text string").repartition(3)
    for x in chains.score(d, chain).collect():
        text = [*texts, "", "rubbish " * 30_000][x.doc_id]
        has, ps = {f for w in text.split() for f in chains.features(w)}, []
        for c in chain:
            z = c.bias + sum(v for f, v in c.weights.items() if f in has) + sum(w * p for w, p in zip(c.earlier, ps))
            ps.append(1 / (1 + np.exp(-z)))
            assert x[f"p_{c.category}"] == pytest.approx(ps[-1], abs=1e-9) and x[f"is_{c.category}"] == int(ps[-1] >= c.threshold)


def test_sample_is_bounded(spark, monkeypatch):
    d = spark.createDataFrame([(i % 5, "".join(chr(97 + int(c)) for c in str(i)) + " other") for i in range(500)], "doc_id int, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id int, toxic int")
    rows = lambda: chains.training_rows(d, lab, {"toxic": F.col("toxic")}, sample=2)
    assert len(rows()) == 8
    monkeypatch.setattr(chains, "SAMPLE_BYTES", 300)
    assert 0 < len(rows()) < 5


def test_sample_comes_in_few_parts_and_freed_memory_goes_back(spark, monkeypatch):
    """however many partitions a shuffle has. Rows that repeat count once."""
    d = spark.createDataFrame([(i, f"word{i} other{i % 3}") for i in range(200)] * 2, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    parts, plain = [], type(d).toArrow
    monkeypatch.setattr(type(d), "toArrow", lambda self: (parts.append(self.rdd.getNumPartitions()), plain(self))[1])
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = chains.training_rows(d, lab, {"toxic": F.col("toxic")})
        size = sum(c.nbytes + 64 for c, _ in got)
        monkeypatch.setattr(chains, "PART_BYTES", size // 3)
        again = chains.training_rows(d, lab, {"toxic": F.col("toxic")})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert parts[0] == 1 and 3 <= parts[1] <= 4
    want = sorted((chains.codes(f"word{i} other{i % 3}").tobytes(), (i % 2,)) for i in range(200))
    assert [(c.tobytes(), y) for c, y in got] == [(c.tobytes(), y) for c, y in again] == want
    assert "RSS" in give_back(spark)
