"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Some voters hold fixed word lists, others the words and word beginnings that labelled training rows
show to be toxic. A label model over how often voters fire together, counted on all documents,
estimates each voter's accuracy and which voters repeat one another, without weighing those twice. Its
posterior labels train a logistic regression on the voters' counts, which then scores whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .kneser_ney import held_out

#: Labelled rows that lexicons are learned from and the classifier is fitted on: about so many, by hash of the id.
MAX_TRAIN = 20_000
#: Toxic training documents that a learned term needs, and the share of its documents that are toxic.
LEAST, PRECISION = 5, 0.9
ROUNDS = 25

#: Word lists of the lexicon voters.
LEXICONS = {
    "insult": "idiot idiots moron morons fool fools clown clowns loser losers jerk creep scum imbecile dimwit cretin",
    "contempt": "worthless pathetic useless trash garbage disgusting stupid dumb brainless filthy vile ridiculous",
    "hostile": "hate kill damn shut destroy despise",
    "other": "dumm idioten abschaum wertlos ekelhaft imbécile stupide minable dégoûtant estúpido inútil basura asqueroso patético",
}
#: Words of courtesy, whose voter speaks for clean text where the label model finds it does.
_COURTESY = frozenset("please thanks thank welcome kindly sorry appreciate bitte danke merci pardon gracias perdón".split())
_POINTERS = frozenset("this that these those you such der die das dieser ce cette ces el la este esta eres".split())
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_"
#: Learned words are dealt to so many voters, besides one for word beginnings of five and one for those of six letters.
WORD_GROUPS = 4
VOTERS = (*LEXICONS, *(f"words{k}" for k in range(WORD_GROUPS)), "begin5", "begin6", "pointed", "repeated", "shout", "exclaim", "silent", "courteous", "calm")
_FIXED = {w: k for k, name in enumerate(LEXICONS) for w in LEXICONS[name].split()}
_AT = {name: k for k, name in enumerate(VOTERS)}


def terms(text: str | None) -> set[str]:
    """The words of text in lower case without signs around them, and their beginnings of five and six letters."""
    own = {w.strip(_STRIP) for w in set((text or "").lower().split())}
    return {f"w{w}" for w in own if len(w) > 2} | {f"5{w[:5]}" for w in own if len(w) > 5} | {f"6{w[:6]}" for w in own if len(w) > 6}


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            part = pdf.iloc[at : at + 500]
            n = {1: Counter(), 0: Counter()}
            for text, toxic in zip(part["text"], part["toxic"]):
                n[toxic].update(terms(text))
            rows = [(t, n[1][t], n[0][t]) for t in n[1].keys() | n[0].keys()]
            yield pd.DataFrame(rows, columns=["term", "toxic", "clean"])


class Hits(dict):
    """The voters that a token (lower case) fires, as a tuple, from learned terms and the fixed words that aren't muted."""

    def __init__(self, learned: frozenset[str], muted: frozenset[str] = frozenset()):
        super().__init__()
        self.learned, self.muted = learned, muted

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        w, found = token.strip(_STRIP), []
        if w in _FIXED and w not in self.muted:
            found.append(_FIXED[w])
        if f"w{w}" in self.learned:
            found.append(len(LEXICONS) + zlib.crc32(w.encode()) % WORD_GROUPS)
        if len(w) > 5 and f"5{w[:5]}" in self.learned:
            found.append(_AT["begin5"])
        if len(w) > 6 and f"6{w[:6]}" in self.learned:
            found.append(_AT["begin6"])
        self[token] = tuple(found)
        return self[token]


def voter_counts(text: str | None, hits: Hits) -> list[int]:
    """How often each voter finds what it looks for in the whole text."""
    text = text or ""
    tokens, n = text.lower().split(), [0] * len(VOTERS)
    fired = [k for k, h in enumerate(map(hits.__getitem__, tokens)) if h]
    for k in fired:
        for voter in hits[tokens[k]]:
            n[voter] += 1
        n[_AT["pointed"]] += k > 0 and tokens[k - 1].strip(_STRIP) in _POINTERS
    n[_AT["repeated"]] = max(0, len(fired) - 1)
    n[_AT["shout"]] = len(_SHOUT.findall(text))
    n[_AT["exclaim"]] = text.count("!!")
    n[_AT["silent"]] = int(not fired)
    n[_AT["courteous"]] = sum(t.strip(_STRIP) in _COURTESY for t in tokens)
    n[_AT["calm"]] = int(not n[_AT["shout"]] and "!" not in text)
    return n


@dataclass
class Toxicity:
    """A fitted model: learned terms, fixed words that labels speak against, the label model's parameters, the classifier's weights."""

    learned: list[str] = field(default_factory=list)
    muted: list[str] = field(default_factory=list)
    accuracies: list[tuple[float, float]] = field(default_factory=list)
    correlations: list[list[float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def counts(self, text: Column) -> Column:
        learned, muted = frozenset(self.learned), frozenset(self.muted)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            hits = Hits(learned, muted)
            for texts in batches:
                yield pd.Series([voter_counts(t, hits) for t in texts])

        # annotations are resolved by name, so they stay real objects
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)

    def score(self, counts: Column) -> Column:
        """The probability that a text with these voter counts is toxic."""
        product = F.zip_with(features(counts), F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(product, F.lit(float(self.intercept)), lambda a, x: a + x)))


def features(counts: Column) -> Column:
    """Per voter, whether it fires and the logarithm of how often."""
    return F.concat(F.transform(counts, lambda n: (n > 0).cast("double")), F.transform(counts, lambda n: F.log1p(n.cast("double"))))


def fires(counts: Column) -> Column:
    """The voters that fire, as the bits of a number."""
    bits = F.transform(counts, lambda n, k: F.when(n > 0, F.expr("1L") * F.pow(F.lit(2.0), k).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


def label_model(patterns: np.ndarray, n: np.ndarray, labelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and the voters' fire rates by class and residual correlations, by expectation maximisation.

    patterns: votes of 0 or 1, a row per pattern; n: documents with it; labelled: how many of them are
    labelled clean and toxic, which anchors the classes. A voter that fires and one that doesn't both give
    evidence; "silent", "courteous" and "calm" fire on texts that lack what the others look for. A voter's evidence
    is divided by one plus what its votes correlate within the classes with those of the others, so that
    copies of a vote count once.
    """
    votes, anchors = patterns.astype(float), labelled.astype(float)
    free = np.maximum(n - anchors.sum(axis=1), 0)
    lexical = votes[:, : _AT["begin6"] + 1].any(axis=1)
    posterior = np.where(lexical, 0.9, 0.02)
    rates, correlation = np.zeros((2, votes.shape[1])), np.eye(votes.shape[1])
    for k in range(ROUNDS):
        # where labels are known, they alone set the first rates
        own = free * (k > 0 or not anchors.any())
        mass = np.stack([own * (1 - posterior) + anchors[:, 0], own * posterior + anchors[:, 1]])
        total = mass.sum(axis=1)
        rates = (mass @ votes + 0.5) / (total[:, None] + 1.0)
        residual = [np.sqrt(m)[:, None] * (votes - r) for m, r in zip(mass, rates)]
        covariance = sum(x.T @ x for x in residual) / max(total.sum(), 1.0)
        scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        correlation = covariance / np.outer(scale, scale)
        shared = np.clip(correlation - np.eye(len(correlation)), 0, 1)
        # voters that never fire tell nothing
        discount = votes.any(axis=0) / (1 + shared @ votes.any(axis=0))
        odds = np.log((total[1] + 1) / (total[0] + 1)) + votes @ (discount * np.log(rates[1] / rates[0])) + (1 - votes) @ (discount * np.log((1 - rates[1]) / (1 - rates[0])))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, rates, correlation


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, keep: tuple[str, ...] = ()) -> tuple[Toxicity, DataFrame]:
    """The model, and docs' voter counts as (doc_id, counts) and the columns named in keep.

    labels(doc_id, toxic): rows of other labels, held-out ids or null ids aren't used; of an id with both labels the
    toxic one holds. Without any labels, the fixed lexicons and the label model stand alone.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_train / max(1, known.count()))
    # bounded: at most about max_train rows of twelve bytes
    sample = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    model = Toxicity()
    counted = ids.join(sample, "doc_id").select("text", "toxic").mapInPandas(_term_counts, "term string, toxic long, clean long")
    summed = cut(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") + F.col("clean") >= LEAST))
    # fixed words that labels speak against, as in a language that uses them otherwise
    model.muted = sorted(r.term[1:] for r in summed.where(F.col("term").isin([f"w{w}" for w in _FIXED]) & (F.col("clean") > F.col("toxic"))).collect())
    # no more terms than the bounded sample's toxic documents have, LEAST documents each
    chosen = summed.where((F.col("toxic") >= LEAST) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
    model.learned = sorted(r.term for r in chosen.select("term").collect())
    marked = cut(ids.select("doc_id", model.counts(F.col("text")).alias("counts"), *keep))
    labelled = marked.join(sample, "doc_id", "left").select(fires(F.col("counts")).alias("fires"), "toxic")
    # at most two to the power of the number of voters
    rows = labelled.groupBy("fires").agg(F.count("*").alias("n"), F.sum(F.expr("int(toxic = 0)")).alias("clean"), F.sum(F.expr("int(toxic = 1)")).alias("toxic")).collect()
    bits = np.array([[r.fires >> k & 1 for k in range(len(VOTERS))] for r in rows]).reshape(-1, len(VOTERS))
    posterior, rates, correlation = label_model(bits, np.array([r.n for r in rows]), np.array([[r.clean or 0, r.toxic or 0] for r in rows]).reshape(-1, 2))
    model.accuracies, model.correlations = [tuple(x) for x in rates.T.tolist()], correlation.tolist()
    _classify(model, marked, sample, {r.fires: float(p) for r, p in zip(rows, posterior)})
    return model, marked


def _classify(model: Toxicity, marked: DataFrame, sample: DataFrame, posterior: dict[int, float]) -> None:
    """Fits the linear classifier to the posterior labels of the sample's documents."""
    on, off = np.array(model.accuracies).T[1], np.array(model.accuracies).T[0]
    model.weights = [*np.log(on / off).tolist(), *[0.0] * len(VOTERS)]
    model.intercept = -4.0
    own = {f: p for f, p in posterior.items()}
    if not own:
        return
    table_of = marked.sparkSession.createDataFrame(list(own.items()), "fires long, p double")
    rows = marked.join(sample.select("doc_id"), "doc_id").withColumn("fires", fires(F.col("counts")))
    soft = rows.join(F.broadcast(table_of), "fires").select(array_to_vector(features(F.col("counts"))).alias("features"), "p")
    both = soft.select("features", F.explode(F.expr("array(struct(1D AS label, p AS weight), struct(0D AS label, 1 - p AS weight))")).alias("x")).select("features", "x.label", "x.weight")
    both = cut(both.coalesce(4))
    if both.limit(1).count():
        fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=50).fit(both)
        model.weights, model.intercept = fitted.coefficients.toArray().tolist(), float(fitted.intercept)


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null text is empty; an empty table gives no rows."""
    model, marked = fit(docs, labels, id_col, text_col)
    scored = marked.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), model.score(F.col("counts")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic. Voters see each text once: what they reject is known by two hashes of the row."""
    row = (F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *reversed(docs.columns)))
    model, marked = fit(docs.withColumn("_row1", row[0]).withColumn("_row2", row[1]), labels, id_col, text_col, keep=("_row1", "_row2"))
    rejected = cut(marked.where(model.score(F.col("counts")) >= 0.5).select("_row1", "_row2").distinct())
    return docs.join(rejected, (row[0] == F.col("_row1")) & (row[1] == F.col("_row2")), "left_anti")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
