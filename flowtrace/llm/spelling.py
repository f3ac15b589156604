"""Spelling variants: words one edit apart, found with minimal acyclic automata read forward and backward.

Of two words one edit apart, either the first half of the one or its second half stands unchanged at that
end of the other. Words meet by such halves: in each task the dictionary words are one automaton from the
front and one from the back, whose paths number the words (a minimal perfect hash). A word walks its half
exactly and completes the rest with one error, both ways; what both ways or several paths find is taken once.
The dictionary's size decides into how many parts halves are dealt, and a half that too many words share is
dealt further, its words apart and whoever asks to every part, so that no automaton outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, table
from .sharding import CRC_TABLE, crc32_sql

RUN = "[A-Za-zÀ-ÿ]+"
#: Words have so many letters and occurrences; of the hashes of runs one in DROPS loses a letter.
LETTERS, OCCURRENCES, DROPS = 5, 3, 97
#: How many times as frequent as a word its form must be.
TIMES = 2
#: Words of an automaton.
PART = 50_000


class Automaton:
    """The minimal acyclic automaton of distinct words in order; a word's number is its place among them."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        known: dict[tuple, int] = {}
        line: list[list] = [["", False, {}]]  # the open path: letter, whether a word ends here, closed children
        before = ""

        def close(depth: int) -> int:
            node = 0
            while len(line) > depth:
                letter, final, children = line.pop()
                key = (final, tuple(children.items()))
                if key not in known:
                    known[key] = self._add(final, children)
                node = known[key]
                if line:
                    line[-1][2][letter] = node
            return node

        for word in words:
            same = 0
            while same < min(len(before), len(word)) and before[same] == word[same]:
                same += 1
            close(same + 1)
            line += [[letter, False, {}] for letter in word[same:]]
            line[-1][1] = True
            before = word
        self.root = close(0)

    def _add(self, final: bool, children: dict[str, int]) -> int:
        """A new node; each edge knows how many words come before those behind it."""
        ahead, edges = int(final), {}
        for letter, child in children.items():
            edges[letter] = (child, ahead)
            ahead += self._count[child]
        self.edges.append(edges)
        self.final.append(final)
        self._count.append(ahead)
        return len(self.edges) - 1

    def one_edit(self, word: str, exact: int) -> set[int]:
        """Numbers of the words at exactly one edit from word that begin with its first so many letters.

        Beside the exact path only what an error has led to is followed, letter by letter, equal places once: the work is
        linear in the word's length.
        """
        at, number = self.root, 0
        for letter in word[:exact]:
            step = self.edges[at].get(letter)
            if step is None:
                return set()
            at, number = step[0], number + step[1]
        alive, strayed = True, set()
        for letter in word[exact:]:
            after = set()
            if alive:
                strayed.update((child, number + ahead) for child, ahead in self.edges[at].values())  # one letter more
                after.add((at, number))  # one letter less
                after.update((child, number + ahead) for other, (child, ahead) in self.edges[at].items() if other != letter)
            for node, n in strayed:
                step = self.edges[node].get(letter)
                if step is not None:
                    after.add((step[0], n + step[1]))
            step = self.edges[at].get(letter) if alive else None
            alive = step is not None
            if alive:
                at, number = step[0], number + step[1]
            strayed = after
            if not alive and not strayed:
                return set()
        if alive:
            strayed.update((child, number + ahead) for child, ahead in self.edges[at].values())
        return {n for node, n in strayed if self.final[node]}


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every run of letters of every text, A-Z in lower case, a letter left out where the hash of id and run says so."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    # what is too short stays so
    runs = runs.where(F.length("run") >= LETTERS).withColumn("run", fold(F.col("run")))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    return hashed.select(F.expr(f"if(h % {DROPS} = 0, concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2)), run)").alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least LETTERS letters and OCCURRENCES occurrences over all texts."""
    counted = occurrences(docs, id_col, text_col).where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def _halves(lengths: Column) -> Column:
    """The halves of word that stand where a word of each of these lengths would have its own: struct(side, half)."""
    front = F.transform(F.array_distinct(F.transform(lengths, lambda l: F.floor(l / 2).cast("int"))), lambda k: F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), k).alias("half")))
    back = F.transform(F.array_distinct(F.transform(lengths, lambda l: (l - F.floor(l / 2)).cast("int"))), lambda k: F.struct(F.lit(1).alias("side"), F.substr("word", F.length("word") - k + 1, k).alias("half")))
    return F.explode(F.concat(front, back))


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, near, near_n) of a partition, whose dictionary words (asks 0) come first."""
    known: tuple[dict[str, int], dict[str, int]] = ({}, {})
    built = None
    for b in batches:
        here = b["asks"].to_numpy() == 0
        for side, word, n in b.loc[here, ["side", "word", "n"]].itertuples(index=False, name=None):
            known[side][word if side == 0 else word[::-1]] = n
        if here.all():
            continue
        if built is None:
            listed = [sorted(k) for k in known]
            built = [(words, Automaton(words)) for words in listed]
        out = []
        for side, word in b.loc[~here, ["side", "word"]].itertuples(index=False, name=None):
            words, automaton = built[side]
            if words:
                way, turn = (word, len(word) // 2) if side == 0 else (word[::-1], len(word) - len(word) // 2)
                for number in automaton.one_edit(way, turn):
                    near = words[number]
                    out.append((word, near if side == 0 else near[::-1], known[side][near]))
        yield pd.DataFrame(out, columns=["word", "near", "near_n"])


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, near, near_n): all pairs of words(word, n), which are distinct, at exactly one edit, in both directions."""
    size = F.length("word")
    meant = F.filter(F.array(size - 1, size, size + 1), lambda l: l >= LETTERS)
    stored = words.select("word", "n", F.lit(0).alias("asks"), _halves(meant).alias("h"))
    asking = words.select("word", "n", F.lit(1).alias("asks"), _halves(F.array(size)).alias("h"))
    keyed = lambda some: some.select("word", "n", "asks", "h.side", F.xxhash64("h.side", "h.half").alias("key"))
    stored, asking = keyed(stored), keyed(asking)
    sizes = cut(stored.groupBy("key").agg(F.count("*").alias("n_key")))
    total = sizes.agg(F.coalesce(F.sum("n_key"), F.lit(0))).first()[0]
    hot = sizes.where(F.col("n_key") > part).select("key", F.ceil(F.col("n_key") / part).alias("parts"))
    if hot.isEmpty():
        both = stored.unionByName(asking).withColumn("part", F.lit(0).cast("long"))
    else:
        split = lambda some: some.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = split(stored).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
        both = dealt.unionByName(split(asking).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))).drop("parts")
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part))
    lined = both.repartition(tasks, "key", "part").sortWithinPartitions("asks").select("word", "n", "asks", "side")
    return lined.mapInPandas(_search, "word string, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms(word, form) lead in the end, by doubling steps. Forms grow in n, so chains are short and end."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """(word, n, n_near, form, form_n, root): the words of all texts, their near words and what they are a variant of.

    A word's form is its near word of largest n, of equals the first by code points, if that n is at least TIMES the word's.
    Null texts hold no words; a null id counts as empty; rows may repeat and count each time. A text, or a word, may be of
    any length. An empty table gives no rows.
    """
    words = cut(vocabulary(docs, id_col, text_col))
    found = near_words(words, part).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("by"), "near")).alias("best"))
    is_form = -F.col("best.by") >= TIMES * F.col("n")
    judged = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.by")).alias("form_n"))
    judged = cut(judged)
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), hashed AS MATERIALIZED (
  SELECT run, count, {crc32_sql("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS count FROM runs WHERE length(run) >= {LETTERS} GROUP BY id, run), crc
), words AS MATERIALIZED (
  SELECT word, sum(count)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DROPS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, count FROM hashed
  ) WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(count) >= {OCCURRENCES}
), less AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word
), ranked AS (
  SELECT near.word, near.near, f.n AS form_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY f.n DESC, near.near) AS nth
  FROM near JOIN words f ON f.word = near.near
), judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN ranked ON ranked.word = w.word AND nth = 1
), chain AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL SELECT chain.word, judged.word, judged.form FROM chain JOIN judged ON judged.word = chain.next
)
SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN chain ON chain.word = judged.word AND chain.next IS NULL
"""
