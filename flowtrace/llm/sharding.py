"""Contiguous shards of equal size from global prefix sums, in DataFrame functions alone.

Rows are dealt to ranges of the order (CRC-32 of the text, size, id), so that equal texts stand together
and a cut parts them in at most one place. A row per partition gives every partition the sizes and rows
before it, a running sum within the partition does the rest, and the line of all sizes is cut at equal
targets: a row goes to the shard in whose part its middle falls. No shard is further from its target
than half a row at either end, whatever the number of shards or of equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 16
#: What a shard's share is counted in: a row's size, or each row as one.
LAWS = {"bytes": "size", "rows": "1L"}
#: The order of rows; ties are told apart by a row's place in the input, which matters only for rows alike in all three.
ORDER = ("text_crc32", "size", "doc_id")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, row) of docs: UTF-8 bytes of the text plus 1 (null: as empty), its unsigned CRC-32, all columns of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(c) for c in docs.columns]
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.struct(*own).alias("row"))


def shards(rows: DataFrame, n_shards: int = SHARDS, law: str = "bytes") -> DataFrame:
    """rows of sized() with shard (0 to n_shards - 1) and slot, the place within it, gapless from 0.

    Null ids come first among equal texts. Rows repeated in full keep places of their own and are interchangeable, so one
    text that makes up most of the table is cut like any other. With fewer rows than shards some shards are empty; an empty
    table gives no rows.
    """
    weight = LAWS[law]
    ranged = cut(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*ORDER, "tie").withColumn("part", F.spark_partition_id()))
    # one row per partition
    totals = ranged.groupBy("part").agg(F.sum(F.expr(weight)).alias("w"), F.count("*").alias("n"))
    ahead = totals.select("part", F.expr("sum(w) OVER (ORDER BY part) - w").alias("w_ahead"), F.expr("sum(n) OVER (ORDER BY part) - n").alias("n_ahead"), F.expr("sum(w) OVER ()").alias("total"))
    order = f"PARTITION BY part ORDER BY {', '.join(ORDER)}, tie"
    before = F.col("w_ahead") + F.expr(f"sum({weight}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") - F.expr(weight)
    rank = F.col("n_ahead") + F.expr(f"row_number() OVER ({order})") - 1

    def numbered(some: DataFrame) -> DataFrame:
        lined = some.join(F.broadcast(ahead), "part").withColumns({"before": before, "rank": rank})
        return lined.withColumn("shard", F.expr(f"int((2 * before + {weight}) * {n_shards} div (2 * total))"))

    # a row per shard
    first = numbered(ranged.select(*ORDER, "tie", "part")).groupBy("shard").agg(F.min("rank").alias("first"))
    out = numbered(ranged).join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    return out.select(*rows.columns, "shard", "slot")


def write_shards(docs: DataFrame, folder: str, n_shards: int = SHARDS, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as Parquet under folder/shard=N/: slot and the columns of docs in row; files of a shard hold slots in order.

    Columns of docs may have any names. A shard is as many files as tasks hold rows of it.
    """
    placed = shards(sized(docs, id_col, text_col), n_shards, law).select("shard", "slot", "row")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def grown(law: str) -> Column:
    """Where a row goes with one more shard: nothing is promised under these laws."""
    return F.lit(None).cast("int")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read once: what the order needs is small beside the texts
    slim = cut(sized(table(spark, sf_dir, "documents")).drop("row"))
    return shards(slim).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", grown("bytes").alias("grown_shard"))


#: SQL for the unsigned CRC-32 of a text's UTF-8 bytes needs the table of the 256 bytes' remainders, made by rule.
CRC_TABLE = """
SELECT list(v ORDER BY n) AS e FROM (
  SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM range(256) r(n)
)"""


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text, with CRC_TABLE's e at hand."""
    octets = (
        "CASE WHEN c < 128 THEN [c] WHEN c < 2048 THEN [192 + (c >> 6), 128 + (c & 63)] WHEN c < 65536 THEN [224 + (c >> 12), 128 + ((c >> 6) & 63), 128 + (c & 63)]"
        " ELSE [240 + (c >> 18), 128 + ((c >> 12) & 63), 128 + ((c >> 6) & 63), 128 + (c & 63)] END"
    )
    points = f"[unicode(x)::BIGINT FOR x IN regexp_extract_all({text}, '(?s).')]"
    return f"xor(list_reduce(flatten([{octets} FOR c IN {points}]), lambda c, x: xor(c >> 8, e[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


OP11_SQL = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}
), d AS MATERIALIZED (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {crc32_sql("coalesce(text, '')")}::BIGINT AS text_crc32 FROM documents, crc
), p AS (
  SELECT *, (sum(size) OVER w - size)::BIGINT AS ahead, row_number() OVER w AS rank, (sum(size) OVER ())::BIGINT AS total
  FROM d WINDOW w AS (ORDER BY text_crc32, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)
), s AS (
  SELECT *, ((2 * ahead + size) * {SHARDS} // (2 * total))::INTEGER AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM s
"""
