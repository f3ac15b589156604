"""Near copies against brute-force Jaccard similarity, and the pipeline's stage on them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowtrace.llm import near_copies as nc


def _set(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _groups(rows, size=5, similarity=0.8):
    sets = [_set(t, size) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        one, both = sets[a] | sets[b], sets[a] & sets[b]
        if len(both) >= similarity * len(one) - 1e-9 and root[a] != root[b]:
            old, new = root[b], root[a]
            root = [new if r == old else r for r in root]
    return {frozenset(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(100)]
        texts.append(" ".join(base))
        for changed in (1, 1, 2, 3, 6):
            copy = list(base)
            for at in rng.sample(range(100), changed):
                copy[at] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base) + " " + line)
    big = [word() for _ in range(80)]
    texts += [" ".join(big[:k] + [word()] + big[k + 1 :]) for k in range(0, 80, 2)]
    # sets of 501 and 521 shingles have bitmaps of different widths, those of 2000 wide ones
    wide = [word() for _ in range(525)]
    long = [word() for _ in range(2004)]
    texts += [" ".join(wide), " ".join(wide[:505]), " ".join(long), " ".join(long[:1700]), " ".join(long[:1500] + [word() for _ in range(500)])]
    texts += [" ".join(word() for _ in range(20)) + " " + line for _ in range(20)] + [None, "", " ", "one two", "One TWO", "a b c d e f g h", "a b c d e f g h i"]
    return list(enumerate(texts))


def test_one_of_each_by_similarity(spark, rows):
    import corpus_pipeline

    want = _groups(rows)
    assert any(len(g) > 20 for g in want) and len(want) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want)


def test_near_copies_with_and_without_common_shingles(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for common, size, similarity in ((2, 3, 0.6), (10**9, 5, 0.8)):
        monkeypatch.setattr(nc, "COMMON", common)
        groups = {}
        for r in nc.near_copies(docs, size=size, similarity=similarity).collect():
            groups.setdefault(r.component, set()).add(r.doc_id)
        assert {frozenset(g) for g in groups.values()} == _groups(rows, size, similarity)
    assert nc.near_copies(docs.limit(0)).count() == 0


def test_one_of_each_verifies_what_fingerprints_find(spark, rows, monkeypatch):
    """With a similarity the fingerprints' groups are asked first, and a group of unlike texts stays apart."""
    from flowtrace.llm import simhash

    docs, asked = spark.createDataFrame(rows[:30], "doc_id long, text string").repartition(2), []
    real = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **b: asked.append(b) or real(*a, **b).withColumn("component_id", F.lit(0).cast("long")))
    kept = simhash.one_of_each(docs, similarity=0.8)
    assert asked and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in _groups(rows[:30]))


def test_what_is_common_does_not_depend_on_how_many_texts_there_are(spark, monkeypatch):
    """A passage of 40 texts is common among 400 as among 40,000: a share of the texts shows it, not a fixed number. Of many shingles the most frequent are known."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    line, often = " ".join(word() for _ in range(16)), " ".join(word() for _ in range(16))
    texts = [" ".join(word() for _ in range(10)) + " " + (line if k < 40 else often if k < 160 else "") for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nc, "SAMPLE", 10)
    of = lambda text: set(nc.shingle_set(text, 5).tolist())
    known, counts = nc._common(docs, "text", 5, 0.8)
    assert set(known.tolist()) & of(line) and set(known.tolist()) & of(often)
    monkeypatch.setattr(nc, "KNOWN", sum(counts > counts.min()))
    fewer, _ = nc._common(docs, "text", 5, 0.8)
    assert 0 < len(fewer) <= nc.KNOWN < len(known) and set(fewer.tolist()) <= of(often) | of(line)
    monkeypatch.setattr(nc, "SHARE", 10**9)
    monkeypatch.setattr(nc, "KNOWN", 10**6)
    old = set(nc._common(docs, "text", 5, 0.8)[0].tolist())
    assert not old & of(line)  # what a fixed number of texts shows
