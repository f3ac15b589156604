"""Exact top-k inner products with a vector-approximation file.

Every vector is kept a second time as one byte per dimension: the number of its cell among that
dimension's quantiles, so that an outlier widens no cell but its own. Blocks of queries meet groups of
cells by a join; scanning the bytes bounds each inner product from below and above. Exact vectors are
read first for the k best lower bounds, and then for those whose upper bound still reaches the kth exact
score, after which the result is certain. Queries, cells and candidates stay in tables throughout.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Queries in a block, and vectors that one step bounds against it.
BLOCK, CHUNK = 1024, 4096
#: Vectors in a group at least, and how many groups there are at most (beyond that, groups grow).
GROUP, GROUPS = 8192, 4096
#: Vectors whose quantiles set the cells (the bounds hold for any), drawn by hash.
SAMPLE = 16384
CELLS = 256
#: Parts that a query's scores are ranked in before they meet.
SALTS = 32
#: Bounds are summed in floating point: exact below this, else widened by this share of the sum of magnitudes.
LIMIT, ROOM = 1 << 53, 2.0**-44
#: Scores below this are sums of longs, others of decimals.
LONG = 1 << 62
RESULT = "query_id long, rank int, vec_id long, score long"


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double; null where a component is null or not finite, or vector is null."""
    x = F.transform(vector, lambda v: v.cast("double"))
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(ok, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _cells(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per dimension, the values at which cells 1 to CELLS - 1 begin, and the least and greatest value of each cell."""
    inner = np.quantile(sample, np.linspace(0, 1, CELLS - 1), axis=0, method="lower").astype(np.int64).T
    inner[:, -1] += 1  # what lies above the sample has a cell of its own
    least = np.hstack([np.minimum(low, inner[:, 0])[:, None], inner])
    greatest = np.hstack([inner - 1, np.maximum(high, inner[:, -1])[:, None]])
    return inner, least, np.maximum(greatest, least)


def _scanner(least: np.ndarray, greatest: np.ndarray, k: int, room: float):
    """A function of a block of queries and a group of cells that gives (query_id, vec_id, hash, part, lower, upper) of all that may be among the k best.

    Bounds are doubled, which keeps them whole; where sums may still be rounded they give way by room. A vector whose upper bound
    stays under the kth lower bound is out for good.
    """
    low, high = least.astype(np.float64), greatest.astype(np.float64)
    twice_mid, width = low + high, high - low
    dims = np.arange(len(least))

    def scan(key: tuple, asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(stored):
            ids = asked["query_id"].to_numpy()
            q = np.array(asked["q"].tolist(), dtype=np.float64)
            own, hashes = (np.frombuffer(b"".join(stored[c]), dtype=np.int64) for c in ("ids", "hashes"))
            # of equal vectors only the k + 1 smallest ids can be in a result, the query itself aside; a repeated row counts once
            order = np.lexsort((own, hashes))
            order = order[np.r_[True, (np.diff(own[order]) != 0) | (np.diff(hashes[order]) != 0)]]
            run = np.r_[0, np.flatnonzero(np.diff(hashes[order])) + 1]
            rank = np.arange(len(order)) - np.repeat(run, np.diff(np.r_[run, len(order)]))
            rows = np.sort(order[rank <= k])
            cells = np.frombuffer(b"".join(stored["cells"]), dtype=np.uint8).reshape(-1, len(least))[rows]
            own, hashes = own[rows], hashes[rows]
            best, kept = np.full((len(ids), k), -np.inf), []
            for at in range(0, len(own), CHUNK):
                part, some = cells[at : at + CHUNK], own[at : at + CHUNK]
                mid, reach = q @ twice_mid[dims, part].T, np.abs(q) @ (width + room * (np.abs(twice_mid) + width))[dims, part].T
                lower = mid - reach
                lower[ids[:, None] == some[None, :]] = -np.inf
                both = np.hstack([best, lower])
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                which, row = np.nonzero((mid + reach >= best.min(axis=1)[:, None]) & (lower > -np.inf))
                kept.append((which, row + at, lower[which, row], (mid + reach)[which, row]))
            which, row, lower, upper = (np.concatenate(x) for x in zip(*kept))
            still = upper >= best.min(axis=1)[which]
            found = [ids[which[still]], own[row[still]], hashes[row[still]], np.full(still.sum(), key[1]), lower[still], upper[still]]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "hash", "part", "lower", "upper"), found or [[]] * 6)))

    return scan


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with rows other than its own.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part,
    nor do rows with a null id or empty vectors; only vectors of one length are compared. A row repeated
    with id and vector counts once; ids are taken to stand for one vector each. Scores are exact whatever the
    components; one that no long holds is null, in its place by size. An empty table gives no rows.
    """
    exact = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"), integers(F.col(vector_col), scale).alias("v"))
    exact = exact.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).withColumn("hash", F.xxhash64("v"))
    largest = F.max(F.greatest(F.abs(F.array_min("v").cast("double")), F.abs(F.array_max("v").cast("double"))))
    sizes = exact.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("all"), largest.alias("largest"), F.count_if("asks").alias("asks")).collect()
    found = [_of_length(exact.where(F.size("v") == s.n), int(s.n), int(s.all), int(s.asks), k, int(s.n) * int(s.largest) ** 2) for s in sizes if s.asks]
    if not found:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, found)


def approximations(exact: DataFrame, n: int, n_vectors: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(group, ids, hashes, cells) in chunks of vectors, and the cells' least and greatest values by dimension."""

    def bounds(batches):
        low = high = None
        for b in batches:
            v = b.column(0).flatten().to_numpy().reshape(-1, n)
            if len(v):
                low, high = (v.min(axis=0), v.max(axis=0)) if low is None else (np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0)))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64()))], names=["low", "high"])

    each = F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")
    rows = exact.select("v").mapInArrow(bounds, "low array<long>, high array<long>").select(each).groupBy("dim").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("dim").collect()  # a row per dimension
    sample = exact.orderBy(F.xxhash64("hash")).select("v").limit(SAMPLE).collect()  # bounded by SAMPLE
    inner, least, greatest = _cells(np.array([r.v for r in sample], dtype=np.int64), np.array([r.low for r in rows]), np.array([r.high for r in rows]))

    def quantise(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                v = part.column(2).flatten().to_numpy().reshape(-1, n)
                cells = np.stack([np.searchsorted(inner[d], v[:, d], side="right") for d in range(n)], axis=1).astype(np.uint8)
                ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
                columns = [pa.array([int(ids[0] ^ hashes[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "ids", "hashes", "cells"])

    groups = max(1, min(GROUPS, -(-n_vectors // GROUP)))
    chunks = exact.select("vec_id", "hash", "v").mapInArrow(quantise, "group long, ids binary, hashes binary, cells binary")
    return cut(chunks.withColumn("group", F.pmod(F.xxhash64("group"), F.lit(groups)))), least, greatest


def candidates(exact: DataFrame, queries: DataFrame, n: int, n_vectors: int, n_queries: int, k: int, most: int = 0) -> DataFrame:
    """(query_id, vec_id, hash, part, lower, upper): by group, the vectors that may be among a query's k best."""
    stored, least, greatest = approximations(exact, n, n_vectors)
    blocks, groups = -(-n_queries // BLOCK), max(1, min(GROUPS, -(-n_vectors // GROUP)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    dealt = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    scan = _scanner(least, greatest, k, ROOM if 4 * most >= LIMIT else 0.0)
    return cut(asked.groupBy("block", "group").cogroup(dealt.groupBy("block", "group")).applyInPandas(scan, "query_id long, vec_id long, hash long, part long, lower double, upper double"))


def _top(rows: DataFrame, by: Column, k: int) -> DataFrame:
    """(query_id, top): the k greatest values of by, ranked in parts of each query first."""
    first = lambda c: F.slice(F.sort_array(c, asc=False), 1, k)
    parts = rows.groupBy("query_id", F.pmod("vec_id", F.lit(SALTS)).alias("salt")).agg(first(F.collect_list(by)).alias("top"))
    return parts.groupBy("query_id").agg(first(F.flatten(F.collect_list("top"))).alias("top"))


def _of_length(exact: DataFrame, n: int, n_vectors: int, n_queries: int, k: int, most: int) -> DataFrame:
    """top_k() of vectors of n components; no inner product is larger than most."""
    queries = cut(exact.where("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct())
    found = candidates(exact, queries, n, n_vectors, n_queries, k, most)
    kind = "long" if most < LONG else "decimal(38,0)"
    kth = _top(found, F.col("lower"), k).select("query_id", F.when(F.size("top") >= k, F.element_at("top", k)).alias("kth"))
    likely = cut(found.join(kth, "query_id").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))))
    vectors = exact.select("vec_id", "hash", "v")

    def read(pairs: DataFrame) -> DataFrame:
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: (a.cast(kind) * b.cast(kind)).cast(kind)), F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))
        return pairs.join(vectors, ["vec_id", "hash"]).join(queries, "query_id").select("query_id", "vec_id", score.alias("score")).distinct()

    early = F.col("kth").isNull() | (F.col("lower") >= F.col("kth"))
    first = cut(read(likely.where(early)))
    sure = first.groupBy("query_id").agg(F.min("score").alias("certain"))
    rest = read(likely.where(~early).join(sure, "query_id").where(F.col("upper") >= 2 * F.col("certain").cast("double")))
    best = _top(first.union(rest), F.struct("score", (-F.col("vec_id")).alias("id")), k)
    out = best.select("query_id", F.posexplode("top").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), (-F.col("x.id")).alias("vec_id"), F.col("x.score").try_cast("long").alias("score"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
