"""k-means over whole-number vectors with Elkan's bounds, exact whatever the order of rows.

Every vector carries an upper bound on the distance to its own centroid and a lower bound on the distance
to each of the others. After a round bounds move by what the centroids moved; a distance is computed only
where bounds and half the distance between centroids leave the outcome open. Bounds round outward and
prune strictly, so a tie is never pruned, and what decides are exact squared distances in whole numbers.
Sums of a task's vectors are made within the task; what reaches the driver are k centroids and their sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .vafile import integers

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Vectors and pairs of a vector and a centroid that are worked on at once.
CHUNK, PAIRS = 4096, 1 << 16
#: Components beyond this count as not finite: they leave no room in a long.
MOST = 1 << 62
#: Relative room for the rounding of a conversion and a square root.
ROOM = 2.0**-50
STATE = "vec_id long, v binary, cluster int, upper double, lower binary, totals array<decimal(38,0)>, n long"
FINAL = "vec_id long, cluster int, distance long"


def _pack(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    ends = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * m.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(m)])


def _unpack(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _reach(*arrays: np.ndarray) -> int:
    """The largest magnitude in arrays."""
    return max((int(max(a.max(), -a.min())) for a in arrays if a.size), default=0)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between rows, exact: as Python numbers where a long might not hold them."""
    if 4 * v.shape[1] * _reach(v, c) ** 2 >= 1 << 62:
        v, c = v.astype(object), c.astype(object)
    d = v - c
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def _all_squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of v to every row of c, exact."""
    if 4 * v.shape[1] * _reach(v, c) ** 2 < 1 << 53:  # every step is a whole number that doubles hold
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([_squares(v, x[None, :]) for x in c], axis=1)


def _root(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded outward."""
    return np.sqrt(squares.astype(np.float64)) * (1 + ROOM if up else 1 - ROOM)


def _below(x: np.ndarray) -> np.ndarray:
    """x in single precision, rounded down, not under 0."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


class _Rounds:
    """What a task does with its vectors in one round, given the centroids and how far each has moved."""

    def __init__(self, centres: np.ndarray, moved: np.ndarray, first: bool, final: bool) -> None:
        self.centres, self.moved, self.first, self.final = centres, moved, first, final
        self.half = _root(_all_squares(centres, centres), False) / 2
        np.fill_diagonal(self.half, np.inf)
        self.nearest = self.half.min(axis=1)

    def start(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper and lower bounds of vectors that have none: all distances are computed."""
        squares = _all_squares(v, self.centres)
        cluster = squares.argmin(axis=1)
        return cluster, _root(squares[np.arange(len(v)), cluster], True), _below(_root(squares, False))

    def go_on(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after a round, from what stood before it; and how many distances were computed."""
        upper = np.nextafter(upper + self.moved[cluster], np.inf)
        lower = np.maximum(np.nextafter(lower.astype(np.float64) - self.moved, -np.inf), 0.0)
        rows = np.flatnonzero(upper >= self.nearest[cluster])
        still = lambda some: (lower[some] <= upper[some, None]) & (self.half[cluster[some]] <= upper[some, None])
        rows = rows[still(rows).any(axis=1)]
        own = _squares(v[rows], self.centres[cluster[rows]])
        upper[rows] = _root(own, True)
        lower[rows, cluster[rows]] = _root(own, False)
        which, at = np.nonzero(still(rows))
        other = at != cluster[rows[which]]
        which, at = which[other], at[other]
        parts = [_squares(v[rows[which[k : k + PAIRS]]], self.centres[at[k : k + PAIRS]]) for k in range(0, len(at), PAIRS)]
        if parts:
            found = np.concatenate(parts)
            lower[rows[which], at] = _root(found, False)
            # of a vector's open distances and its own the least, of equals the smaller number
            ids, numbers, squares = np.r_[which, np.arange(len(rows))], np.r_[at, cluster[rows]], np.concatenate([found, own])
            order = sorted(range(len(ids)), key=lambda k: (ids[k], squares[k], numbers[k])) if squares.dtype == object else np.lexsort((numbers, squares, ids))
            best = np.asarray(order, dtype=np.int64)[np.r_[True, np.diff(ids[order]) != 0]]
            cluster[rows], upper[rows] = numbers[best], _root(squares[best], True)
        return cluster, upper, _below(lower), len(rows) + len(at)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = self.centres.shape
        totals, n = np.zeros((k, width), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for b in (batch.slice(at, CHUNK) for at in range(0, batch.num_rows, CHUNK)):
                if self.first:
                    v = b.column(1).flatten().to_numpy().reshape(-1, width)
                    cluster, upper, lower = self.start(v)
                else:
                    v = _unpack(b.column(1), np.int64, width)
                    cluster, upper, lower, _ = self.go_on(v, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), _unpack(b.column(4), np.float32, k))
                ids, numbers = b.column(0), pa.array(cluster.astype(np.int32))
                if self.final:
                    distance = _squares(v, self.centres[cluster])
                    yield pa.RecordBatch.from_arrays([ids, numbers, pa.array([int(d) if d < 1 << 63 else None for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])
                    continue
                order = np.argsort(cluster, kind="stable")
                present, begins = np.unique(cluster[order], return_index=True)
                wide = v if CHUNK * _reach(v) < 1 << 62 else v.astype(object)
                totals[present] += np.add.reduceat(wide[order], begins, axis=0)
                n[present] += np.diff(np.r_[begins, len(order)])
                none = pa.nulls(len(v))
                yield self._state(ids, _pack(v), numbers, pa.array(upper), _pack(lower), none, none)
        if not self.final and n.any():
            some = np.flatnonzero(n)
            none = pa.nulls(len(some))
            yield self._state(none, none, pa.array(some.astype(np.int32)), none, none, pa.array([[Decimal(int(x)) for x in totals[j]] for j in some], pa.list_(pa.decimal128(38, 0))), pa.array(n[some]))

    @staticmethod
    def _state(*columns: pa.Array) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.decimal128(38, 0)), pa.int64())
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names=["vec_id", "v", "cluster", "upper", "lower", "totals", "n"])


def whole(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of the components of vectors with exactly dims of them, none null, non-finite or beyond MOST."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("v"))
    return own.where(F.col("v").isNotNull() & (F.size("v") == dims) & F.forall("v", lambda x: x.between(-MOST, MOST)))


def first_centres(rows: DataFrame, k: int, salt: int = 2) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of `salt:vec_id` (null: empty), in that order; fewer where there are fewer."""
    by: Column = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in rows.orderBy(by, "v").select("v").limit(k).collect()], dtype=np.int64)  # k rows


def clustered(rows: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of whole()'s rows after so many rounds and one more assignment, and the final centroids.

    Rows are what counts: a repeated one weighs twice, a null id is an id. Ties go to the smaller number; an empty cluster
    keeps its centroid. With fewer rows than k there are fewer clusters; an empty table gives no rows. A squared distance
    that no long holds is null.
    """
    centres = first_centres(rows, k)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], FINAL), centres
    state, moved = rows, np.zeros(len(centres))
    for r in range(rounds):
        state = cut(state.mapInArrow(_Rounds(centres, moved, r == 0, False), STATE))
        sums = state.where("n IS NOT NULL").select("cluster", "n", F.posexplode("totals").alias("dim", "x"))
        sums = sums.groupBy("cluster", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # k * dims numbers
        new = centres.copy()
        for s in sums:
            new[s.cluster, s.dim] = int(s.x) // s.n
        moved, centres = _root(_squares(new, centres), True), new
        state = state.where("n IS NULL")
    return cut(state.mapInArrow(_Rounds(centres, moved, rounds == 0, True), FINAL)), centres


def with_inertia(assigned: DataFrame, centres: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia and inertia (null where a distance in them is, or no long holds the sum) and centroid_sha256."""
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    long = lambda x: int(x) if x is not None and x < 1 << 63 else None
    every = long(None if None in per.values() else sum(per.values()))
    rows = [(j, long(per[j]), every, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centres) if j in per]
    known = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centres = clustered(whole(table(spark, sf_dir, "embeddings")))
    return with_inertia(assigned, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    """SQL for an assignment to the centroids c{r} and, but for the last, their means as c{r + 1}."""
    square = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)])::BIGINT"
    assigned = f""", a{r} AS MATERIALIZED (
  SELECT r, vec_id, v, no, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, no) AS nth FROM (SELECT r, vec_id, v, no, {square} AS distance FROM kept, c{r})
  ) WHERE nth = 1
)"""
    if r == ROUNDS:
        return assigned
    mean = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    return f"""{assigned}, c{r + 1} AS MATERIALIZED (
  SELECT c{r}.no, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT no, list(x ORDER BY i) AS c FROM (
      SELECT no, i, {mean} AS x FROM (SELECT no, unnest(v) AS x, unnest(range({DIMS})) AS i FROM a{r}) GROUP BY no, i
    ) GROUP BY no
  ) m ON m.no = c{r}.no
)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS no, v AS c FROM (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT {K})
){"".join(map(_round_sql, range(ROUNDS + 1)))}
SELECT vec_id, a.no::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY a.no))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.no = a.no
"""
