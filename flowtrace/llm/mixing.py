"""Mixing sources to target weights over a low-discrepancy schedule.

Each source's documents, in hashed order, form one stream that is cut into blocks of equal words. The
schedule's slots are golden-ratio points on the unit interval, which the sources share by their
targets; a slot takes the next block of the source whose part its point falls into, starting over when
the stream ends, until its target is reached. Turns that the points leave a source short of, a few of the
many thousand or all of a source smaller than a block, stand beside other slots, placed by further points:
so every source gives its target in whole words. Ranks and prefix sums are counted in two levels, within
groups and over the groups, so that a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, words

#: Words in a block: a mix of fewer than SLOTS blocks of the largest size has smaller ones, down to the least.
LEAST_BLOCK, MOST_BLOCK, SLOTS = 16, 1024, 16384
#: Weights of the sources in code point order, over and over.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all words, and how often it may take a document at most.
SHARE, REPEATS = 1.5, 2
#: Slots ranked together, and how many such groups there are at most (beyond that, groups grow).
CHUNK, CHUNKS = 512, 1 << 16
#: Documents from which a stream has more buckets.
MANY = 100_000_000
#: Cells of the unit interval, by which slots meet the sources whose parts lie there.
CELLS = 1024
#: The points are multiples of 2**31 divided by the golden ratio, modulo 2**31: exact in whole numbers.
MODULUS, STEP = 1 << 31, 1327217885


def key_of(id_col: str, text_col: str) -> Column:
    """The hash that orders a source's stream and knows a row by its id and text."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size in words, and key: the hash that orders a source's stream."""
    size = F.size(words(F.col(text_col))).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key_of(id_col, text_col).alias("key"), *keep)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_no, source_size, target, quota): what each source gives, quota in whole words.

    A target stops at repeats times the source's size; what is over goes to the others by weight. With
    the sources in order of size over weight, the first whose own share of the rest stays within its
    limit sets the level for all after it. There is one row per source here, so one task orders them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = per.withColumn("source_no", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)").cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    limited = numbered.withColumn("weight", weight).withColumn("most", repeats * F.col("source_size"))
    limited = limited.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("goal", share * F.expr("sum(source_size) OVER ()"))
    by = "OVER (ORDER BY ratio, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    level = (F.col("goal") - F.expr(f"sum(most) {by} - most")) / F.expr(f"sum(weight) OVER () - sum(weight) {by} + weight")
    levelled = limited.withColumn("level", level)
    first = F.expr("min(CASE WHEN level <= ratio THEN struct(ratio, source_no, level) END) OVER ()")["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(first * F.col("weight"), F.col("most").cast("double")))
    return levelled.withColumn("target", target).select("source", "source_no", "source_size", "target", F.floor(F.col("target") + 0.5).alias("quota"))


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes with source_no, source_size, target and start: the words before the document in its source's stream."""
    numbered = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).select(sizes["*"], "source_no", "source_size", "target")
    # the keys are hashes, so buckets are alike in size
    numbered = numbered.withColumn("bucket", F.substring("key", 1, 3 if sizes.count() < MANY else 5))
    buckets = numbered.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = buckets.select("source_no", "bucket", F.expr("sum(words) OVER (PARTITION BY source_no ORDER BY bucket) - words").alias("before"))
    within = F.expr("sum(size) OVER (PARTITION BY source_no, bucket ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size")
    return numbered.join(before, ["source_no", "bucket"]).withColumn("start", F.col("before") + within).drop("bucket", "before")


def block_words(total: int) -> int:
    """Words in a block of a mix of total words."""
    return max(LEAST_BLOCK, min(MOST_BLOCK, total // SLOTS))


def schedule(sources: DataFrame, block: int | None = None) -> tuple[DataFrame, int]:
    """(slot, source_no, turn, quota), and the words in a block: the source of every slot and which of its turns it is, from 0.

    There are as many slots as the quotas have blocks. How many of them a source has is what the points give it; turns
    that it lacks share slots with others, at points further on.
    """
    spark = sources.sparkSession
    parts = cut(sources.select("source_no", "quota").where("quota > 0").withColumn("high", F.expr("sum(quota) OVER (ORDER BY source_no)")))
    total = int(parts.agg(F.coalesce(F.max("high"), F.lit(0))).first()[0])
    block = block or block_words(total)
    n_slots = -(-total // block)
    parts = parts.withColumn("low", F.col("high") - F.col("quota"))
    cell_of = lambda x: F.floor(x / total * CELLS) if total else F.lit(0).cast("long")
    covered = parts.withColumn("cell", F.explode(F.sequence(cell_of(F.col("low")), cell_of(F.col("high")))))
    point = (F.col("slot") % MODULUS * STEP % MODULUS) / MODULUS * total
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", cell_of(F.col("point")))
    chunk = F.floor(F.col("slot") / max(CHUNK, -(-n_slots // CHUNKS)))
    drawn = slots.join(covered, "cell").where("point >= low AND point < high").select("slot", "source_no", chunk.alias("chunk"))
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("source_no", "chunk", F.expr("sum(n) OVER (PARTITION BY source_no ORDER BY chunk) - n").alias("before"))
    turn = F.col("before") + F.expr("row_number() OVER (PARTITION BY source_no, chunk ORDER BY slot)") - 1
    drawn = drawn.join(before, ["source_no", "chunk"]).withColumn("turn", turn).select("slot", "source_no", "turn")
    have = counts.groupBy("source_no").agg(F.sum("n").alias("have"))
    short = parts.join(have, "source_no", "left").select("source_no", F.coalesce("have", F.lit(0).cast("long")).alias("have"), F.ceil(F.col("quota") / block).alias("need")).where("have < need")
    rest = short.select("source_no", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("turn"))
    further = (n_slots + F.col("source_no") + F.col("turn")) % MODULUS * STEP % MODULUS
    rest = rest.select(F.floor(further / MODULUS * n_slots).alias("slot"), "source_no", "turn")
    return cut(drawn.unionByName(rest).join(parts.select("source_no", "quota"), "source_no")), block


def pieces(placed: DataFrame, slots: DataFrame, block: int, repeats: int = REPEATS) -> DataFrame:
    """Which words of which document every slot takes: slot, source_no, turn, pass, from_word, n_words and placed's columns.

    Where a source's quota or its stream, gone through repeats times, ends, its later slots stay empty.
    """
    limits = slots.groupBy("source_no").agg(F.first("quota").alias("limit"))
    passes = placed.where("size > 0").join(limits, "source_no").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    virtual = passes.withColumn("first", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("end", F.least(F.col("first") + F.col("size"), F.col("limit"))).where("first < end")
    cells = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("end") - 1) / block))
    parts = virtual.withColumn("turn", F.explode(cells))
    begin, stop = F.greatest("first", F.col("turn") * block), F.least("end", (F.col("turn") + 1) * block)
    joined = parts.join(slots.drop("quota"), ["source_no", "turn"])
    return joined.withColumn("from_word", begin - F.col("first")).withColumn("n_words", stop - begin).drop("first", "end", "limit")


def mixture(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of sized documents, their places in the streams and the pieces that the mix takes, in slots.

    A null source is a source of its own. Documents without words are placed and never taken. Rows
    repeated in full hold places of their own and are interchangeable. Empty tables give empty ones.
    """
    sizes = cut(sizes)
    sources = cut(targets(sizes, weights, share, repeats))
    placed = cut(streams(sizes, sources))
    slots, words_each = schedule(sources, block)
    return placed, pieces(placed, slots, words_each, repeats)


def taken(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """placed with taken: how many of its words the mix takes, repeats counted; n_pieces, first_slot and last_slot: where."""
    # a place in a stream is the key: doc ids may be null or repeat
    total = parts.groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"), F.count("*").alias("n_pieces"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    has = placed.where("size > 0").join(total, ["source_no", "start"], "left")
    return has.unionByName(placed.where("size = 0"), allowMissingColumns=True).na.fill(0, ["taken", "n_pieces"])


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rules) -> DataFrame:
    """(slot, source, n_words, text) in order of slot: the mix itself, a row per slot and source that takes words, documents joined by spaces.

    A row holds a block's words at most. Rows equal in id and text are interchangeable and are read once.
    """
    _, parts = mixture(sized(docs, id_col, text_col, source_col), **rules)
    texts = docs.select(F.col(text_col).alias("text"), key_of(id_col, text_col).alias("key")).dropDuplicates(["key"])
    cutout = F.array_join(F.slice(words(F.col("text")), (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    each = parts.select("slot", "source", "pass", "start", "n_words", "from_word", "key").join(texts, "key").select("slot", "source", "n_words", F.struct("pass", "start", cutout.alias("words")).alias("piece"))
    whole = each.groupBy("slot", "source").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list("piece")).alias("p"))
    return whole.select("slot", "source", "n_words", F.array_join(F.transform("p", lambda x: x["words"]), " ").alias("text")).orderBy("slot", "source")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of text, joined by spaces."""
    return F.array_join(F.slice(words(text), F.lit(1), n.cast("int")), " ")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rules) -> DataFrame:
    """The mix as documents, in order of their first slots: a row for each time that a document is taken, its text cut where the mix stops short.

    What a pass takes of a document is always its beginning. Columns are those of docs, n_chars (where
    there is one) counted anew.
    """
    placed, parts = mixture(sized(docs, id_col, text_col, source_col), **rules)
    each = parts.groupBy("source_no", "start", "pass").agg(F.sum("n_words").alias("n"), F.min("slot").alias("slot"), F.first("key").alias("_key"), F.first("size").alias("_size"))
    # copies of a row share its key: each takes one element of takes, in any order
    per_row = each.groupBy("_key", "_size", "source_no", "start").agg(F.sort_array(F.collect_list(F.struct("n", "slot")), asc=False).alias("_n"))
    takes = cut(per_row.groupBy("_key", "_size").agg(F.collect_list("_n").alias("_takes")))
    copies = placed.groupBy("key").agg(F.count("*").alias("_copies"))
    takes = takes.join(copies, takes._key == copies.key).drop("key")
    # docs' own columns travel in one, whatever their names
    own = docs.select(F.struct(*docs.columns).alias("_doc"), key_of(id_col, text_col).alias("_at"))
    rows = own.join(takes, F.col("_at") == F.col("_key"))
    once = rows.where("_copies = 1").withColumn("_take", F.element_at("_takes", 1))
    more = rows.where("_copies > 1").withColumn("_no", F.expr("row_number() OVER (PARTITION BY _key ORDER BY _key)"))
    more = more.where(F.col("_no") <= F.size("_takes")).withColumn("_take", F.element_at("_takes", F.col("_no"))).drop("_no")
    out = once.unionByName(more).withColumn("_taken", F.explode("_take"))
    whole = F.col("_doc")[text_col]
    out = out.withColumn("_text", F.when(F.col("_taken.n") < F.col("_size"), first_words(whole, F.col("_taken.n"))).otherwise(whole))
    new = {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.orderBy("_taken.slot").select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, parts = mixture(sized(table(spark, sf_dir, "documents")))
    return taken(placed, parts).select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "first_slot", "last_slot")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''])::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM per
), w AS (
  SELECT *, [3, 1, 2][(no - 1) % 3 + 1] AS weight, 2 * source_size AS most, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS goal FROM n
), r AS (
  SELECT *, most::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (goal - (sum(most) OVER c - most)::DOUBLE) / (sum(weight) OVER () - sum(weight) OVER c + weight)::DOUBLE AS level FROM r
  WINDOW c AS (ORDER BY ratio, no ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT level AS chosen FROM l WHERE level <= ratio ORDER BY ratio, no LIMIT 1
), t AS (
  SELECT source, no, source_size, least(most::DOUBLE, coalesce((SELECT chosen FROM f) * weight, most::DOUBLE)) AS target FROM l
), q AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota, sum(floor(target + 0.5)::BIGINT) OVER (ORDER BY no) AS high FROM t
), k AS (
  SELECT greatest(16, least(1024, coalesce(max(high), 0) // 16384))::BIGINT AS block, coalesce(max(high), 0)::BIGINT AS total FROM q
), points AS (
  SELECT slot, ((slot % 2147483648) * 1327217885 % 2147483648) / 2147483648::DOUBLE * total AS point
  FROM (SELECT unnest(range(((total + block - 1) // block)::BIGINT)) AS slot, total FROM k)
), drawn AS (
  SELECT no, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS turn FROM points JOIN q ON point >= high - quota AND point < high
), rest AS (
  SELECT q.no, unnest(range(coalesce(have, 0), ((quota + block - 1) // block)::BIGINT)) AS turn, ((total + block - 1) // block)::BIGINT AS n_slots
  FROM k, q LEFT JOIN (SELECT no, count(*) AS have FROM drawn GROUP BY no) h ON h.no = q.no
), turns AS (
  SELECT no, slot, turn FROM drawn UNION ALL
  SELECT no, floor(((n_slots + no + turn) % 2147483648 * 1327217885 % 2147483648) / 2147483648::DOUBLE * n_slots)::BIGINT, turn FROM rest
), p AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.size, t.no, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), v AS (
  SELECT r, no, start + pass * source_size AS first, least(start + pass * source_size + size, quota) AS stop, block
  FROM p, k, (SELECT unnest([0, 1]) AS pass) WHERE size > 0
), u AS (
  SELECT v.*, unnest(range((first // block)::BIGINT, ((stop - 1) // block + 1)::BIGINT)) AS turn FROM v WHERE first < stop
), got AS (
  SELECT r, sum(least(stop, (u.turn + 1) * block) - greatest(first, u.turn * block))::BIGINT AS taken, count(*) AS n_pieces, min(slot) AS first_slot, max(slot) AS last_slot
  FROM u JOIN turns ON turns.no = u.no AND turns.turn = u.turn GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_pieces, 0) AS n_pieces, first_slot, last_slot FROM p LEFT JOIN got USING (r)
"""
