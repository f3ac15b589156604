"""Contiguous balanced shards against a plain running sum."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from flowtrace.llm import sharding


def plain(rows: list[tuple], n: int, law: str) -> dict:
    """Places of (doc_id, text) rows in the line: doc_id, text -> shards in order."""
    sized = sorted(((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i is not None, i or 0) for i, t in rows))
    weights = [s[1] if law == "bytes" else 1 for s in sized]
    total, at, out = sum(weights), 0, defaultdict(list)
    for (crc, size, known, i), w in zip(sized, weights):
        out[i if known else None, crc, size].append((2 * at + w) * n // (2 * total))
        at += w
    return out


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    own = random.Random(5)
    texts = ["", None, "ä" * 7, "short", "one two three", "𝔘" * 3, "long " * 20_000]
    rows = [(k if own.random() < 0.97 else None, own.choice(texts[:6]) if own.random() < 0.4 else f"text {own.randint(1, 400)} " * own.randint(1, 40)) for k in range(900)]
    rows += [(5000, texts[6]), (7, "again"), (7, "again"), (7, "again")] + [(k, "the same copy of a third of all") for k in range(6000, 6450)]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, shard int, row int").repartition(7)
    want = plain(rows, 16, law)
    got = sharding.shards(sharding.sized(df), 16, law).collect()
    assert Counter((r.doc_id, r.row.text) for r in got) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) == (len((r.row.text or "").encode()) + 1, zlib.crc32((r.row.text or "").encode()))
        by[r.doc_id, r.text_crc32, r.size].append(r.shard)
    assert {k: sorted(v) for k, v in by.items()} == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = sharding.shards(sharding.sized(df), 16).collect()
    assert len(got) == 3 and len({r.shard for r in got}) == 3 and {r.slot for r in got} == {0}
    assert sharding.shards(sharding.sized(df.limit(0)), 16).count() == 0
    assert {(r.shard, r.slot) for r in sharding.shards(sharding.sized(df.where("doc_id = 1")), 1).collect()} == {(0, 0), (0, 1)}


def test_written_shards(spark, tmp_path):
    rows = [(k, f"text {k % 50} " * (k % 17)) for k in range(400)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, slot string").repartition(5)
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in back) == Counter(rows) and {r.row.slot for r in back} == {"x"}
    mass = Counter()
    for r in back:
        mass[r.shard] += len(r.row.text.encode()) + 1
    assert max(mass.values()) - min(mass.values()) <= 2 * max(len(t.encode()) + 1 for _, t in rows)
