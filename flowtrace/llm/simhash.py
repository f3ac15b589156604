"""Near-duplicates by 64-bit SimHash fingerprints, found with deletion-variant signatures.

Fingerprints at two or fewer differing bits are cut into two halves, of which at least one then
differs by at most one bit. Each half is indexed under all its one-wildcard variants (the half with
one bit cleared, and which bit), equal variants are joined and the pairs verified in full. Exact
copies meet as one distinct fingerprint first, so groups of copies make no pairs. Variants that more
fingerprints share than HOT are not paired: their members go to themselves and to the 64 values at one
bit from them. Two of them meet at such a value just when they link, and no more than 65 meet at any,
so a star per value is exact and no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import cut, table
from .near_copies import SENT, near_copies

SEED = 42
#: Fingerprints under one variant from which stars over the values at one bit take the place of pairs.
HOT = 64
#: Shingles hashed at once, so that the longest text needs bounded memory.
BLOCK = 1 << 16

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of text's word shingles, as a signed 64-bit number; 0 for null or no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    n = max(1, len(tokens) - size + 1) if tokens else 0
    set_in = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = tokens[at : at + BLOCK + size - 1]
        shingles = zip(*(part[k:] for k in range(size))) if len(part) >= size else [part]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), dtype=np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            set_in[k] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(np.packbits((2 * set_in > n).astype(np.uint8).ravel(), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, size: int = 3) -> Column:
    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return prints(text)


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(prints: DataFrame) -> DataFrame:
    """(fp, sig): the 64 one-wildcard half variants of every fingerprint; sig holds half, cleared bit and what is left."""
    halves = F.expr("explode(array(struct(0L AS half, fp & 4294967295L AS seg), struct(1L AS half, shiftrightunsigned(fp, 32) AS seg)))")
    return (
        prints.select("fp", halves.alias("h"))
        .select("fp", "h.half", "h.seg", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
        .select("fp", F.expr("shiftleft(half * 32 + bit, 32) | (seg & ~shiftleft(1L, bit))").alias("sig"))
    )


def links(prints: DataFrame) -> DataFrame:
    """(src, dst): links that join all fingerprints of prints(fp, distinct) at two or fewer differing bits."""
    variants = _variants(prints)
    sizes = variants.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    # only variants that two or more share go on: a small part of the index
    shared = cut(variants.join(sizes, "sig").select("fp", "sig", "n"))
    few = shared.where(F.col("n") <= HOT)
    a, b = few.select("sig", F.col("fp").alias("dst")), few.select("sig", F.col("fp").alias("src"))
    pairs = a.join(b, "sig").where((F.col("dst") < F.col("src")) & (_distance("dst", "src") <= 2)).select("src", "dst").distinct()
    hot = shared.where(F.col("n") > HOT).select("fp").distinct()
    # a window, not a join: adaptive execution takes the size of hot for that of its 65 times as many values, and would broadcast them
    values = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit")).selectExpr("fp", "if(bit < 64, fp ^ shiftleft(1L, bit), fp) AS value")
    low = values.withColumn("dst", F.min("fp").over(Window.partitionBy("value")))
    stars = low.where(F.col("fp") != F.col("dst")).select(F.col("fp").alias("src"), "dst").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), size: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, and the columns named in keep.

    Null text and texts without words have fingerprint 0 and link like any other. component_id is the
    smallest id in the component (null ids count for nothing, so a component of null ids has null).
    Repeated rows stay. An empty table gives no rows.
    """
    marked = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), size).alias("fp"), *keep))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    root = components(links(prints.select("fp")))
    rooted = prints.join(root, prints.fp == root.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = cut(rooted.join(lowest, "root").select("fp", "component_id"))
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float | None = None, words: int = 5) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, or of equal ids the smallest row hash.

    Components are those of near_duplicates(). With a similarity their members are held against each other exactly, at so many
    words, and near_copies() adds the links that fingerprints can't reach. A row repeated in full stays once. Null ids come after all others. Columns are those of docs.
    """
    row_hash = F.xxhash64(*docs.columns)
    marked = docs.withColumn("_row", row_hash)
    found = near_duplicates(marked, id_col, text_col, keep=("_row",), size=size)
    # a component without any id has no component_id: its fingerprint stands for it
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("alone")]
    if similarity is not None:
        likely = cut(found.select("_row", F.xxhash64(*group).alias("group")).distinct())
        found, group = near_copies(marked, id_col, text_col, keep=("_row",), size=words, similarity=similarity, likely=likely), [F.col("component")]
    rows = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    best = found.groupBy(*group).agg(F.min(rows).alias("best")).select("best.doc_id", "best._row")
    copies = found.groupBy("doc_id", "_row").agg(F.count("*").alias("_copies"))
    first = copies.join(best.withColumn("_first", F.lit(True)), copies.doc_id.eqNullSafe(best.doc_id) & (copies._row == best._row), "left")
    # rows to go, and those to keep once; all others stay as they are
    marks = cut(first.where("_first IS NULL OR _copies > 1").select(copies.doc_id.alias("_id"), copies._row.alias("_hash"), "_first"))
    marks = F.broadcast(marks) if marks.count() <= SENT else marks.hint("merge")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (row_hash == F.col("_hash"))
    repeated = docs.join(marks.where("_first"), same).select(*docs.columns).dropDuplicates()
    return docs.join(marks, same, "left_anti").unionByName(repeated)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
