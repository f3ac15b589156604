"""Document quality rules and the frequency of lines across the documents of a host, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, cut, table, words

#: Lines that more documents of one host have are boilerplate.
MAX_DOCS = 20
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.5
#: Parts that the documents of a common line are dealt into.
SALTS = 16

#: Word positions that fit beside a hash prefix in one long; longer texts sort (hash, position) pairs.
_POSITION_BITS = 20
_MASK = (1 << _POSITION_BITS) - 1


def _covered(positions: Column) -> Column:
    """Words in the three-word windows that begin at the sorted positions, each word once."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def _entries(windows: Column, n: Column) -> Column:
    """Windows (hashes by position) in hash order, as hash prefix and position in one long; none for texts too long for that."""
    packed = F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long")))
    return F.when(n <= _MASK, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _pairs(windows: Column, n: Column) -> Column:
    """The same as (hash, position) pairs, for the texts that _entries leaves out."""
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.cast("long").alias("at")))
    return F.when(n > _MASK, F.array_sort(pairs)).otherwise(F.array().cast("array<struct<hash:bigint,at:bigint>>"))


def _twins(column: str, same, at) -> Column:
    """Sorted positions of the entries that equal a neighbour. (column is a name: lambdas evaluate what they hold anew.)"""
    twin = lambda x, k: ((k > 0) & same(F.get(column, k - 1), x)) | same(F.get(column, k + 1), x)
    return F.sort_array(F.transform(F.filter(column, twin), at))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Per row: doc_id, host, two row keys, the base measures, and lines as (hash, words, first of its kind) in hash order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.xxhash64(id_col, host_col, text_col).alias("key1"),
        F.xxhash64(F.lit(1), text_col, host_col, id_col).alias("key2"),
        words(text).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    window = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    counted = split.select(
        *(c for c in split.columns if c not in ("w", "lines")),
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.array_sort(F.transform("lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("hash"), F.size(words(x)).alias("words")))).alias("lines"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    some = F.when(repeats, F.col("windows")).otherwise(F.array().cast("array<bigint>"))
    found = counted.withColumn("windows", some).withColumn("entries", _entries(F.col("windows"), F.col("n"))).withColumn("pairs", _pairs(F.col("windows"), F.col("n")))
    at = lambda x: x.bitwiseAND(F.lit(_MASK))
    whole = lambda x: F.get("windows", at(x).cast("int"))
    twins = _twins("entries", lambda a, b: F.coalesce((F.shiftright(a, _POSITION_BITS) == F.shiftright(b, _POSITION_BITS)) & (whole(a) == whole(b)), F.lit(False)), at)
    long_twins = _twins("pairs", lambda a, b: F.coalesce(a["hash"] == b["hash"], F.lit(False)), lambda x: x["at"])
    return found.select(
        "doc_id", "host", "key1", "key2",
        F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        (_covered(twins) + _covered(long_twins)).alias("n_repeat_words"),
        F.transform("lines", lambda x, k: F.struct(x["hash"].alias("hash"), x["words"].alias("words"), ((k == 0) | (F.get("lines", k - 1)["hash"] != x["hash"])).alias("first"))).alias("lines"),
    )


def normalised(line: Column) -> Column:
    """The form in which lines of different documents are compared: lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod("key1", F.lit(SALTS)))


def common_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(host, hash) of lines that more than max_docs documents of the host have."""
    return lines.where("first").groupBy("host", "hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs: measures, base_failed, words_left after common lines went, removed (their hashes) and kept.

    Null text has no words; a null host is a host of its own. Repeated rows each count as a document
    and each stay. A line is compared by a 64-bit hash of its normalised form. An empty table gives no rows.
    """
    rows = cut(measures(docs, id_col, text_col, host_col))
    lines = rows.select("key1", "key2", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("line")).select("key1", "key2", F.struct("host", "no_host").alias("host"), "line.*")
    common = cut(common_lines(lines, max_docs)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = _salted(lines).join(common, ["host", "hash", "salt"])
    # copies of a row share its keys, so their sums are divided again below
    removed = hits.groupBy("key1", "key2").agg(F.sum("words").alias("gone"), F.collect_set("hash").alias("removed"))
    measured = rows.drop("lines", "host").join(removed, ["key1", "key2"], "left")
    copies = F.expr("count(*) OVER (PARTITION BY key1, key2)")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.expr("gone div copies"), F.lit(0))
    return (
        measured.withColumn("copies", copies)
        .withColumn("words_left", left)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= min_left * F.col("n_words")))
        .drop("copies", "gone")
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept rows of docs, common lines removed from their text."""
    verdicts = quality_rules(docs, id_col, text_col, host_col, **limits).where("kept").select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2"), F.col("removed").alias("_removed")).dropDuplicates(["_key1", "_key2"])
    same = (F.xxhash64(id_col, host_col, text_col) == F.col("_key1")) & (F.xxhash64(F.lit(1), text_col, host_col, id_col) == F.col("_key2"))
    stays = lambda x: ~F.array_contains(F.coalesce("_removed", F.array().cast("array<bigint>")), F.xxhash64(normalised(x)))
    text = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), stays), "\n")
    return docs.join(verdicts, same).withColumn(text_col, text).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d
), win AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 3
), keyed AS (
  SELECT r, i, list_slice(w, i, i + 2) AS k FROM win
), twice AS (
  SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, k) > 1
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), line AS (
  SELECT r, source, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS k,
    len([x FOR x IN regexp_split_to_array(l, '[\x20\x09-\x0D]+') IF x <> '']) AS n
  FROM (SELECT r, source, unnest(lines) AS l FROM w)
), common AS (
  SELECT source, k FROM line GROUP BY source, k HAVING count(DISTINCT r) > 20
), gone AS (
  SELECT r, sum(n) AS n FROM line l WHERE EXISTS (SELECT 1 FROM common c WHERE c.source IS NOT DISTINCT FROM l.source AND c.k = l.k) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(w) - coalesce(gone.n, 0))::BIGINT AS words_left
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND words_left >= 0.5 * n_words AS kept FROM f
"""
