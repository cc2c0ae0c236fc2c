"""The corpus pipeline, stage by stage, against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline as pipeline
from tessitura.llm import mixing, pii, segment
from tests.llm.test_learned import bag, weighted

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder of documents and labels: toxic ones, copies, near copies, personal data, nulls, and a source of few words."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioulmntrs") for _ in range(r.randint(3, 8)))
    texts = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(400)]
    for i in range(0, 400, 8):
        w = texts[i].split()
        w[r.randrange(len(w))] = r.choice(["Idiot", "scum!", "idiotisch"])
        texts[i] = " ".join(w)
    texts[401:] = [texts[1], texts[1].upper(), texts[3] + " more", texts[5].replace(texts[5].split()[4], "other")]
    texts += [f"{' '.join(word() for _ in range(9))} mail me at user{i}@example.com or +1 (555) 010-99{10 + i}" for i in range(3)]
    texts += ["", None, "\n", "one"]
    rows = [(i, t, "en", "s0" if i < 300 else "s1" if i < 404 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(360)], "doc_id bigint, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return {r[0]: r for r in rows}, str(path)


def _stages(spark, path):
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.staged(stage(spark, docs, path), f"test-{name}")
        out.append((before, docs))
    return out


def test_stages_equal_brute_force(spark, world):
    given, path = world
    (_, clean), (_, kept), (_, redacted), (_, mixed), (_, ids) = stages = _stages(spark, path)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "sentencepiece"]
    for _, d in stages[:-1]:
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]

    have = {r.doc_id: r.text for r in clean.collect()}
    assert have == {i: r[1] for i, r in given.items() if not (i < 400 and i % 8 == 0)}

    root = {i: i for i in have}
    find = lambda x: x if root[x] == x else find(root[x])
    bags = {i: bag(t) for i, t in have.items()}
    for i, j in combinations(sorted(have), 2):
        if (have[i] or "") == (have[j] or "") or (bags[i] and bags[j] and weighted(bags[i], bags[j]) >= 0.8):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    have = {r.doc_id: r.text for r in kept.collect()}
    assert have == {i: given[i][1] for i in root if find(i) == i}

    # spans by the operator's own search, replaced one after the other
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.find(kept).collect()}
    for r in redacted.collect():
        text, out, end = have[r.doc_id], [], 0
        for k, a, b in spans[r.doc_id]:
            if int(a) >= end:
                out += [text[end : int(a)], f"[{k.upper()}]"]
            end = max(end, int(b))
        assert r.text == (text and "".join(out) + text[end:]) and r.n_chars == (None if text is None else len(r.text))
    texts = {r.doc_id: r.text for r in redacted.collect()}
    assert sum("[EMAIL]" in (t or "") and "[PHONE]" in t for t in texts.values()) == 3 and not any("@" in (t or "") for t in texts.values())

    # every source is a stream of its documents, over and over, up to its target; each word of it is somewhere in the mix
    plan = mixing.mix(redacted).collect()
    want = Counter()
    for s in {r.source_size for r in plan}:
        own = sorted((r for r in plan if r.source_size == s), key=lambda r: r.draw)
        left = round(own[0].target)
        while left > 0:
            for r in own:
                if r["size"] and left > 0:
                    part = " ".join((texts[r.doc_id] or "").split()[:left])
                    want[(r.doc_id, part)] += 1
                    left -= r["size"]
    assert Counter((r.doc_id, " ".join(r.text.split())) for r in mixed.collect()) == want

    sp, lattice = segment.load(segment.default_model())
    rows = ids.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for (i, _), n in want.items() for _ in range(n))
    bodies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert Counter((r.doc_id, r.decoded) for r in rows) == bodies
    for r in rows[:40]:
        best = lattice.best(sp.normalize(r.decoded), 3)
        assert [r.score, *(a.score for a in r.alternatives)] == pytest.approx([b[0] for b in best]) and r.n_tokens == len(r.ids)


def test_run_equals_its_stages(spark, world):
    _, path = world
    got = sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, path).collect())
    assert got == sorted((r.doc_id, tuple(r.ids)) for r in _stages(spark, path)[-1][1].collect())


def test_empty_tables(spark, world, tmp_path):
    _, path = world
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
