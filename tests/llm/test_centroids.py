"""k-means with bounds against one that computes every distance in Python numbers."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowtrace.llm import centroids


def plain(rows: list[tuple], k: int, rounds: int) -> tuple[list[tuple], list[list[int]]]:
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in rows[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for j in range(len(centres)):
            own = [v for (_, v), a in zip(rows, at) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], centres


def same(spark, rows, k, rounds, dims, scale=1):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    want, centres = plain(kept, k, rounds)
    got, found = centroids.clustered(centroids.whole(df, dims, scale), k, rounds)
    out = got.collect()
    fits = [(i, j, d if d < 1 << 63 else None) for i, j, d in want]
    assert Counter((r.vec_id, r.cluster, r.distance) for r in out) == Counter(fits)
    assert found.tolist() == centres
    return centroids.with_inertia(got, found).collect(), fits, centres


@pytest.mark.parametrize("seed,spread", [(1, 3), (2, 40), (3, 2000)])
def test_clusters_with_ties(spark, seed, spread):
    """Small whole components make many equal distances; a third of all rows are one vector."""
    own = random.Random(seed)
    rows = [(k, [float(own.randint(-spread, spread)) for _ in range(4)]) for k in range(400)]
    rows += [(1000 + k, [1.0, 2.0, 0.0, -1.0]) for k in range(200)] + [rows[3], rows[3], (None, rows[5][1])]
    out, want, centres = same(spark, rows, 12, 5, 4)
    inertia = Counter()
    for _, j, d in want:
        inertia[j] += d
    assert all((r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values())) for r in out)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest() for r in out)


def test_awkward_vectors(spark):
    """What isn't a vector of the length takes no part; far outliers are exact, and a distance that no long holds is null."""
    own = random.Random(9)
    rows = [(k, [own.uniform(-1, 1) for _ in range(3)]) for k in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 2.0]), (105, [float("inf"), 0.0, 0.0]), (106, [1e300, 0.0, 0.0])]
    same(spark, [r for r in rows if r[0] != 106], 7, 3, 3, 256)
    same(spark, [r for r in rows if r[0] < 100] + [(200, [9000.0, -3.0, 2.0**40]), (201, [2.0**50, 1.0, 0.0]), (202, [-(2.0**50), 1.0, 0.0])], 7, 3, 3, 256)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert centroids.whole(df, 3).count() == 60  # 106 lies beyond MOST
    assert same(spark, rows[:4], 40, 5, 3, 256)[0].__len__() == 4
    got, centres = centroids.clustered(centroids.whole(df.limit(0), 3))
    assert got.count() == 0 and centroids.with_inertia(got, centres).count() == 0


def test_bounds_save_distances():
    """Bounds must do their work: in later rounds far fewer distances than k a vector, and the same clusters."""
    own = np.random.default_rng(4)
    middle = own.integers(-200, 200, (40, 64))
    v = (middle[own.integers(0, 40, 3000)] + own.integers(-9, 9, (3000, 64))).astype(np.int64)
    before, after = middle.astype(np.int64), (middle + own.integers(-2, 3, middle.shape)).astype(np.int64)
    cluster, upper, lower = centroids._Rounds(before, np.zeros(40), True, False).start(v)
    moved = centroids._root(centroids._squares(after, before), True)
    cluster, _, _, n = centroids._Rounds(after, moved, False, False).go_on(v, cluster, upper, lower)
    assert (cluster == centroids._all_squares(v, after).argmin(axis=1)).all() and n < 0.1 * 40 * len(v)
