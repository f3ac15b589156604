"""Quotation linking: reply-ordered conversations from messages that quote one another, in DataFrame functions alone.

Lines that begin with '>' are quoted, as deep as they have such signs. Runs of lines of one depth are
passages; their normalised hashes, whole, by paragraph and by line, meet the hashes of what messages
of the conversation wrote themselves. A message replies to the one it quotes most of at its least depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, cut, table

#: Parts that a frequent passage's quotations are dealt into.
SALTS = 16
_MARK = r"^(?:[ \t]*>)++"


def normalised(text: Column) -> Column:
    """The form in which passages are compared: lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), GAP, " "))


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """messages with own (text without quotes), blocks (depth, text) of all runs of lines of one depth, and quoted lines."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = F.col("text").rlike(r"(?m)^[ \t]*>")
    lines = rows.withColumn("lines", F.transform(F.split("text", "\n", -1), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 0), "[^>]", "")).alias("depth"), F.regexp_replace(x, _MARK + "[ \t]?", "").alias("line"))))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: (k == 0) | (F.get("lines", k)["depth"] != F.get("lines", k - 1)["depth"]))
    cuts = lines.withColumn("starts", F.when(marked, starts).otherwise(F.array(F.lit(0))))
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines"))
    text = lambda s, k: F.array_join(F.transform(F.slice("lines", s + 1, end(k) - s), lambda x: x["line"]), "\n")
    blocks = cuts.withColumn("blocks", F.transform("starts", lambda s, k: F.struct(F.get("lines", s)["depth"].alias("depth"), text(s, k).alias("text"))))
    own = F.array_join(F.transform(F.filter("blocks", lambda b: b["depth"] == 0), lambda b: b["text"]), "\n")
    return blocks.withColumn("own", F.when(marked, F.trim(own)).otherwise(F.col("text"))).drop("lines", "starts", "text")


def _passages(text: Column) -> Column:
    """The distinct normalised forms of text whole, of its paragraphs and of its lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n", -1), F.split(text, "\n", -1))
    return F.array_remove(F.array_distinct(F.transform(parts, normalised)), "")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, matched): the earlier message that each quoting one replies to, and the quoted letters found.

    A passage is the message's that wrote it first. The least depth with any match decides; there the
    message with most matched letters, the later of equals.
    """
    quotes = messages.select("conv_id", "turn", F.explode(F.filter("blocks", lambda b: b["depth"] > 0)).alias("b"))
    quotes = quotes.select("conv_id", "turn", "b.depth", F.explode(_passages(F.col("b.text"))).alias("p"))
    quotes = cut(quotes.select("conv_id", "turn", "depth", F.length("p").cast("long").alias("size"), F.xxhash64("p").alias("hash"))).withColumn("salt", F.pmod("turn", F.lit(SALTS)))
    wrote = messages.select("conv_id", "turn", F.explode(_passages(F.col("own"))).alias("p")).select("conv_id", "turn", F.xxhash64("p").alias("hash"))
    # of all that was written only what someone quotes is kept
    first = wrote.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    first = cut(first.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi"))
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = quotes.join(spread, ["conv_id", "hash", "salt"]).where(F.col("origin") < F.col("turn"))
    votes = found.groupBy("conv_id", "turn", "depth", "origin").agg(F.max("size").alias("matched"))
    best = F.max_by(F.struct("origin", "matched"), F.struct((-F.col("depth")).alias("depth"), "matched", "origin"))
    return votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.origin").alias("reply_to"), "b.matched")


def roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) for replies(conv_id, turn, reply_to): by doubling the reach of every link until none moves."""
    reach = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = reach.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = cut(reach.join(up, ["conv_id", "root"], "left"))
        moved = joined.where(F.col("next").isNotNull()).limit(1).count()
        reach = joined.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if not moved:
            return reach


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages in reply order, without quotes: conv_id, root, turn, role, text, n_quotes, reply_to, depth, matched.

    A conversation's threads follow one another by their first message; in a thread messages stand in
    order of turn, so a reply follows what it replies to. Messages that quote nothing found start a
    thread of their own at depth 0. Null text is empty. Rows with a null conversation or turn are linked
    to nothing; repeated turns are each listed and share their link. The sort deals a large conversation to many tasks.
    """
    rows = cut(parsed(messages, conv_col, turn_col, role_col, text_col))
    replies = cut(links(rows))
    rooted = cut(roots(replies))
    tied = replies.join(rooted, ["conv_id", "turn"])
    quoted = F.size(F.filter("blocks", lambda b: b["depth"] > 0)).alias("n_quotes")
    out = rows.select("conv_id", "turn", "role", F.col("own").alias("text"), quoted).join(tied, ["conv_id", "turn"], "left")
    out = out.withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))
    return out.select("conv_id", "root", "turn", "role", "text", "n_quotes", "reply_to", "depth", "matched").orderBy("conv_id", "root", "turn", "role", "text")


def op3_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS r FROM conversations
), l AS (
  SELECT r, conv_id, turn, unnest(range(len(s))) AS k, unnest(s) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM m)
), d AS (
  SELECT r, conv_id, turn, k, len(regexp_replace(regexp_extract(line, '^([ \t]*>)+'), '[^>]', '', 'g')) AS depth, regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS line FROM l
), g AS (
  SELECT *, sum(step) OVER (PARTITION BY r ORDER BY k) AS block
  FROM (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY r ORDER BY k) THEN 1 ELSE 0 END AS step FROM d)
), b AS (
  SELECT r, conv_id, turn, block, depth, string_agg(line, chr(10) ORDER BY k) AS text FROM g GROUP BY ALL
), own AS (
  SELECT m.r, m.conv_id, m.turn, m.role,
    CASE WHEN regexp_matches(m.text, '(^|\n)[ \t]*>') THEN trim(coalesce((SELECT string_agg(b.text, chr(10) ORDER BY block) FROM b WHERE b.r = m.r AND depth = 0), '')) ELSE m.text END AS text,
    (SELECT count(*) FROM b WHERE b.r = m.r AND depth > 0)::INTEGER AS n_quotes FROM m
), src AS (
  SELECT r, conv_id, turn, 0 AS depth, text FROM own UNION ALL SELECT r, conv_id, turn, depth, text FROM b WHERE depth > 0
), pas AS (
  SELECT DISTINCT r, conv_id, turn, depth, trim(regexp_replace(lower(p), '[\x20\x09-\x0D]+', ' ', 'g')) AS p
  FROM (SELECT r, conv_id, turn, depth, unnest(list_concat([text], regexp_split_to_array(text, '\n[ \t]*\n'), string_split(text, chr(10)))) AS p FROM src)
), orig AS (
  SELECT conv_id, p, min(turn) AS origin FROM pas WHERE depth = 0 AND p <> '' GROUP BY ALL
), vote AS (
  SELECT q.conv_id, q.turn, q.depth, origin, max(length(q.p)) AS matched FROM pas q JOIN orig o ON o.conv_id = q.conv_id AND o.p = q.p AND origin < q.turn WHERE q.depth > 0 GROUP BY ALL
), rep AS (
  SELECT conv_id, turn, origin AS reply_to, matched FROM vote QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth, matched DESC, origin DESC) = 1
), up AS (
  SELECT conv_id, turn, reply_to AS root, 1::BIGINT AS depth FROM rep
  UNION ALL SELECT up.conv_id, up.turn, rep.reply_to, up.depth + 1 FROM up JOIN rep ON rep.conv_id = up.conv_id AND rep.turn = up.root
), top AS (
  SELECT conv_id, turn, root, depth FROM up QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1
)
SELECT o.conv_id, coalesce(top.root, o.turn) AS root, o.turn, o.role, o.text, o.n_quotes, rep.reply_to, coalesce(top.depth, 0) AS depth, rep.matched
FROM own o LEFT JOIN rep ON rep.conv_id = o.conv_id AND rep.turn = o.turn LEFT JOIN top ON top.conv_id = o.conv_id AND top.turn = o.turn
"""
