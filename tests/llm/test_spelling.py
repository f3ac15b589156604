"""Spelling variants against edit distances computed pair by pair."""

import random
import re
import zlib
from collections import Counter

import pytest

from flowtrace.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows: list[tuple]) -> dict:
    n: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out, form = {}, {}
    for w in n:
        near = sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x))
        form[w] = near[0] if near and n[near[0]] >= 2 * n[w] else None
        out[w] = len(near)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], out[w], form[w], n[form[w]] if form[w] else None, root)
    return out


def test_automaton():
    own = random.Random(1)
    words = sorted({"".join(own.choice("abc") for _ in range(own.randint(2, 8))) for _ in range(700)} | {"é" * 6, "a" * 9})
    a = spelling.Automaton(words)
    assert len(a.edges) < sum(map(len, words)) / 2

    def number(word):
        at, n = a.root, 0
        for c in word:
            at, ahead = a.edges[at][c]
            n += ahead
        return n

    assert [number(w) for w in words] == list(range(len(words)))
    for w in [*words[::9], "", "cabbb", "zzz", "a" * 10]:
        for exact in (0, 1, len(w) // 2, len(w)):
            assert {words[k] for k in a.one_edit(w, exact)} == {x for x in words if one_edit(w, x) and x.startswith(w[:exact])}
    assert spelling.Automaton([]).one_edit("abc", 1) == set()
    long = "a" * 30_000
    assert spelling.Automaton([long]).one_edit(long + "a", 15_000) == {0}


@pytest.mark.parametrize("part", [spelling.PART, 7])
def test_variants(spark, part):
    """Few letters make many near words and ties; with parts of 7 words nearly every half is dealt further."""
    own = random.Random(2)
    pool = ["".join(own.choice("abÉé") for _ in range(own.randint(4, 7))) for _ in range(250)] + ["Receive", "recieve", "receive", "receives", "réceive", "naïve", "ÀÉÎÕÜ", "àéîõü"]
    weights = [own.choice((1, 2, 5, 30)) for _ in pool]
    rows = [(k if k % 50 else None, own.choice((" ", "-", "1", "\n")).join(own.choices(pool, weights, k=own.randint(0, 60)))) for k in range(150)]
    rows += [(7, None), (8, ""), rows[5], rows[5], (900, "x" * 40_000), (901, "x" * 40_001 + " " + "x" * 40_000), (902, "x" * 40_001 + " " + "x" * 40_000 + " " + "x" * 40_001), (903, "word and " * 30_000), (905, "garden " * 60 + "gardens " * 16 + "gardenss " * 5), (904, "١٢٣ слово 漢字 straße_straße straße straße")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(4)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, part=part).collect()}
    want = plain(rows)
    assert got == want and any(v[2] and v[4] != v[2] for v in want.values()) and len(want) > 60
    assert spelling.variants(df.limit(0), part=part).count() == 0
