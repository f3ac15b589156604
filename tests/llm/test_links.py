"""Licences, quotations, top-k search and the whole pipeline."""

import random
from collections import Counter

from pyspark.sql import functions as F

from flowtrace.llm import licenses, quoting, vafile


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        ("a/b/c/x.py", "code only"), ("a/b/y.py", "text\n# Licensed under the Apache License, Version 2.0.\nmore " + "words " * 50), ("a/b/z/COPYING", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
        ("a/b/z/q/deep.c", "int main"), ("top.txt", "nothing"), ("other/only", "All rights reserved."), ("other/f", "my driving license is old and this long sentence says nothing of software at all"), (None, None),
    ]
    df = spark.createDataFrame([(p, t, 1) for p, t in files], "path string, text string, license int")
    out = {r.path: (r.license, r.origin, r.origin_dir) for r in licenses.scan(df).collect()}
    assert out["a/LICENSE"][:2] == ("MIT", "own") and out["a/b/c/x.py"] == ("MIT", "inherited", "a") and out["a/b/y.py"][:2] == ("Apache-2.0", "own")
    assert out["a/b/z/q/deep.c"] == ("GPL-3.0", "inherited", "a/b/z") and out["top.txt"] == (None, None, None) and out[""] == (None, None, None)
    assert out["other/only"][:2] == ("proprietary", "own") and out["other/f"] == ("proprietary", "inherited", "other")
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_of_real_files(spark):
    """Notices and licence files as they are found, wrapped in comments."""
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n\nint main;\n"
    lgpl = "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.\n#\nimport os\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.\n\n  13. Use with the GNU Affero General Public License.\n\n  Notwithstanding any other provision of this License, you have\npermission to link or combine any covered work with a work licensed\nunder version 3 of the GNU Affero General Public License into a single\ncombined work, and to convey the resulting work.\n"
    clauses = ["Copyright (c) 2021, Some One\nAll rights reserved.\n", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n", "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n",
               "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n", "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", licenses._BSD_LIABILITY]
    want = {
        "g/COPYING": ("GPL-3.0", gpl), "b3/LICENSE": ("BSD-3-Clause", "\n".join(clauses)), "b2/LICENSE": ("BSD-2-Clause", "\n".join(clauses[:4] + clauses[5:])), "i/LICENSE.md": ("ISC", "ISC License\n\nCopyright (c) 2020 A. Person\n\n" + dict(licenses.TEXTS[6:7])["ISC"]),
        "m/whole": ("MIT", "MIT License\n\nCopyright (c) 2019 Some One\n\n" + licenses._MIT_GRANT + "\n\n" + licenses._MIT_REST), "n/x.c": ("MPL-2.0", mpl), "n/y.py": ("LGPL-2.1", lgpl), "o/no.txt": (None, "This is NOT released under the MIT License."), "s/see.txt": ("MIT", "Licensed under the MIT License and see file."),
        "n/apache.py": ("Apache-2.0", "# Copyright 2020 Some One. All rights reserved.\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\nimport sys"), "n/spdx.rs": ("AGPL-3.0", "// SPDX-License-Identifier: AGPL-3.0-or-later\nfn main() {}\n" + "let x = 1;\n" * 40),
        "u/UNLICENSE": ("Unlicense", dict(licenses.TEXTS[7:8])["Unlicense"]), "o/none.txt": (None, "My driving license is old, and this long sentence says nothing of software."), "p/own.txt": ("proprietary", "Copyright 2020 Some One.\nAll rights reserved."),
    }
    rows = [(p, t) for p, (_, t) in want.items()] + [("m/q/r/deep.py", "x = 1"), ("same/f", "SPDX-License-Identifier: MIT"), ("same/f", "licenses of trade and of copyright are not what this says at all, and so on it goes for very long"), ("same/f", "SPDX-License-Identifier: MIT")]
    out = licenses.scan(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect()
    got = {r.path: r.license for r in out}
    assert {p: got[p] for p in want} == {p: name for p, (name, _) in want.items()}
    by = {r.path: (r.license, r.origin, r.origin_dir) for r in out}
    assert by["m/q/r/deep.py"] == ("MIT", "inherited", "m")
    same = Counter((r.license, r.cosine, r.origin) for r in out if r.path == "same/f")
    assert same == {("MIT", 1.0, "own"): 2, ("MIT", None, "inherited"): 1}


def test_quoting(spark):
    rows = [
        (1, 0, "a", "First question here.\nSecond line of it.", 0), (1, 1, "b", "> First question here.\n> Second line of it.\nMy answer is yes.", 0),
        (1, 2, "a", ">> first   QUESTION here.\n> My answer is yes.\nThanks", 0), (1, 3, "c", "> not said by anyone\nhello", 0), (1, 4, "d", "> First question here.\nLate reply", 0),
        (2, 0, "a", "First question here.", 0), (2, 1, "b", "> My answer is yes.\nwrong thread", 0), (3, 0, None, None, 0), (None, None, "x", "> y", 0), (1, 4, "d", "> First question here.\nLate reply", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    out = quoting.conversations(df).collect()
    by = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(rows)
    assert (by[1, 1].reply_to, by[1, 1].root, by[1, 1].depth, by[1, 1].text) == (0, 0, 1, "My answer is yes.")
    assert (by[1, 2].reply_to, by[1, 2].root, by[1, 2].depth, by[1, 2].n_quotes, by[1, 2].text) == (1, 0, 2, 2, "Thanks")
    assert (by[1, 3].reply_to, by[1, 3].root) == (None, 3) and by[1, 4].reply_to == 0 and by[2, 1].reply_to is None and by[3, 0].text == ""
    assert [r.turn for r in out if r.conv_id == 1] == [0, 1, 2, 4, 4, 3]
    assert quoting.conversations(df.limit(0)).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, k, "r", (f"> message number {k - 1}\n" if k else "") + f"message number {k}") for k in range(40)]
    out = quoting.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.depth, r.root) for r in out] == [(k, k, 0) for k in range(40)]


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)]) for k in range(1200)]
    rows += [rows[100], rows[100], rows[5], rows[5]]
    rows += [(2000 + k, rows[7][1]) for k in range(60)] + [(3000, None), (3100, [1.0, None] * 4), (3200, [float("nan")] * 8), (3300, [float("inf")] * 8), (3400, []), (3500, [0.5] * 3), (None, [0.1] * 8), (4000, [-3.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("hash", F.lit("own")).repartition(5)
    got = vafile.top_k(df, F.col("vec_id") % 100 == 0, k=10).collect()
    import math

    import numpy as np

    good = {k: [math.floor(1024 * float(np.float32(x))) for x in v] for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (k for k in good if k % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), k) for k, v in good.items() if k != q and len(v) == len(good[q]))[:10]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_candidates_beside_an_outlier(spark):
    import numpy as np
    own = np.random.default_rng(2)
    v = own.normal(0, 0.3, (3000, 16))
    v[5, 3], v[9, 0] = 1000.0, -1000.0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    exact = df.select("vec_id", (F.col("vec_id") % 100 == 0).alias("asks"), vafile.integers(F.col("embedding")).alias("v")).withColumn("hash", F.xxhash64("v"))
    queries = exact.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n = vafile.candidates(exact, queries, 16, 3000, 30, 10).count()
    assert 30 * 10 <= n < 0.05 * 30 * 3000
    whole = np.floor(1024 * v).astype(np.int64)
    got = {}
    for r in vafile.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 3000, 100):
        score = whole @ whole[q]
        assert got[q] == [(int(i), int(score[i])) for i in np.lexsort((np.arange(3000), -score)) if i != q][:10]
    large = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vafile.top_k(large, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024**2 * (10**9 + 1))]


def test_top_k_of_large_components(spark):
    """Exact where doubles no longer hold the products, and where a long doesn't hold the score (null, in its place)."""
    own = random.Random(12)
    rows = [(k, [own.uniform(-1, 1) for _ in range(64)]) for k in range(300)]
    for far in (9000.0, 2.0**33):
        rows[7] = (7, [far, *rows[7][1][1:]])
        rows[200] = (200, [far * own.choice((1, 0.5)) + k for k in range(64)])
        whole = {k: [int(x * 1024 // 1) for x in v] for k, v in rows}
        got = {}
        for r in vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in (0, 100, 200):
            best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q))[:10]
            assert sorted(got[q]) == [(n + 1, k, -s if -(2**63) <= -s < 2**63 else None) for n, (s, k) in enumerate(best)]



def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    from flowtrace.llm import mixing, toxicity

    verdict = {r.doc_id: r.predicted for r in toxicity.predictions(docs, labels).collect()}
    steps = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf_dir).cache()
        steps[name] = out
        at = out
    ids = lambda name: [r.doc_id for r in steps[name].select("doc_id").collect()]
    assert sorted(ids("toxicity")) == sorted(k for k, p in verdict.items() if p == 0)
    from test_near_copies import _groups

    left = [(r.doc_id, r.text) for r in steps["toxicity"].select("doc_id", "text").collect()]
    assert sorted(ids("near_duplicates")) == sorted(min(g) for g in _groups(left)) == sorted(ids("personal_data"))
    placed, parts = mixing.mixture(mixing.sized(steps["personal_data"]))
    want = {r.doc_id: r.taken for r in mixing.taken(placed, parts).collect() if r.taken}
    got = Counter()
    for r in steps["source_mix"].collect():
        got[r.doc_id] += len(r.text.split())
    assert set(want) == set(got)
    assert all(s.columns == docs.columns for n, s in steps.items() if n != "packing")
    assert steps["packing"].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert set(ids("packing")) == set(got)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Nulls, empty, repeated and long rows and columns of the stages' own names, through all stages; redaction and packing against plain ones."""
    import re
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 90").collect()]
    rows = [*base, base[4], base[4], (None, "write to jo.doe@mail.example.org or 10.0.0.7 and think about the long road home with many friends", "en", None, 3), (None, None, None, None, None), (7001, "", "en", "s", 0), (7002, " \n\t", "en", None, 3), (7003, "one", None, "web", 3)]
    rows += [(7004, "a tale of rivers, hills and towns. " * 3000, "en", "web", 9), (7004, "the same id with another text about the weather of the coast", "en", "web", 9)]
    df = spark.createDataFrame([(*r, "k", 1, 2, "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, size int, _takes string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    at, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = steps[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or at.columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    kept = Counter((r.doc_id, r.text) for r in steps["near_duplicates"].collect())
    assert kept[(base[4][0], base[4][1])] <= 1 and sum(kept[x] for x in ((None, None), (7001, ""), (7002, " \n\t"))) == 1 and kept[(7003, "one")] == 1
    clean = steps["personal_data"].collect()
    assert Counter(r.doc_id for r in clean) == Counter(k for k, _ in kept.elements())
    for r in clean:  # what the base patterns find is gone, what holds no candidate is as it was
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "")
        assert kept[(r.doc_id, r.text)] or "[" in r.text
    assert next(r.text for r in clean if r.text and r.text.startswith("write to")).startswith("write to [EMAIL] or [IP] and think")
    mixed = steps["source_mix"].collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean if r.text and r.text.split()} and all(r.text.split() for r in mixed)
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        ids = [*tokens.encode(r.text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    packed = steps["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for line in by.values():
        ends = 0
        for offset, length in sorted(line):
            assert offset == ends
            ends += length
        assert ends <= 2048
