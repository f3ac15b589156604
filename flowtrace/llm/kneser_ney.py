"""An interpolated modified Kneser-Ney bigram model over whole texts.

Spark counts words and word pairs: tasks count within large batches, and shuffle sorted arrays of
64-bit hashes with their counts, so that a frequent word is one entry per batch. What meets in a
shard is merged, and stored as a sorted hash array with its counts beside it in the shared folder. Workers map
those files into memory and look up all pairs of a batch at once. Pairs are dealt to shards by their
first word, those of hot words by the whole pair, so that shards stay alike in size.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mounted_dir, table, word_hashes

#: Shards of the word table, and pairs that a shard of the pair table is made for.
WORD_SHARDS = 128
PAIRS_A_SHARD = 1_000_000
#: Tokens counted or scored together.
FLUSH = 800_000

#: Hashes of the end and of the start of a text; no word is empty or holds a space.
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" start")
_BLOBS = "kind string, shard int, blob binary"


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of text, A-Z in lower case, and of the end."""
    return np.append(word_hashes(text), np.uint64(END))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def word_shards(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(40)) % np.uint64(WORD_SHARDS)


def _small(values: np.ndarray) -> np.ndarray:
    """values in the narrowest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _pack(*arrays: np.ndarray) -> bytes:
    import pickle

    return pickle.dumps([arrays[0], *map(_small, arrays[1:])], protocol=5)


def _unpack(blobs, n: int) -> list[np.ndarray]:
    import pickle

    parts = [pickle.loads(b) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(n)]


def _dealt(kind: str, shards: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """A row per shard, with its entries of arrays."""
    order = np.argsort(shards, kind="stable")
    found, starts = np.unique(shards[order], return_index=True)
    for shard, own in zip(found.tolist(), np.split(order, starts[1:])):
        yield kind, int(shard), _pack(*(a[own] for a in arrays))


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of each of values."""
    if not len(keys):
        return [keys, *(v.astype(np.uint64) for v in values)]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return [keys[starts], *(np.add.reduceat(v[order].astype(np.uint64), starts) for v in values)]


def _rows(rows) -> pa.RecordBatch:
    kinds, shards, blobs = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "shard", "blob"])


def _counter(flush):
    """A function over batches of texts that gives flush the token hashes of many texts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(token_hashes(text.as_py()))
                n += len(held[-1])
                if n >= FLUSH:
                    yield _rows(list(flush(held)))
                    held, n = [], 0
        if held:
            yield _rows(list(flush(held)))

    return count


def _word_counts(held: list[np.ndarray]):
    words, n = np.unique(np.concatenate(held), return_counts=True)
    yield from _dealt("count", word_shards(words), words, n)


def _merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """All counts of a shard's words, and what they sum to."""
    words, n = _summed(*_unpack(pdf["blob"], 2))
    rows = [("count", int(pdf["shard"].iloc[0]), _pack(words, n)), ("total", len(words), int(n.sum()).to_bytes(8, "little"))]
    return pd.DataFrame(rows, columns=["kind", "shard", "blob"])


def previous(held: list[np.ndarray]) -> np.ndarray:
    """For each token of the texts in a row, the hash of the one before it."""
    tokens = np.concatenate(held)
    before = np.r_[np.uint64(START), tokens[:-1]]
    before[np.cumsum([len(x) for x in held[:-1]], dtype=np.int64)] = START
    return before


def pair_shards(first: np.ndarray, pairs: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    by = np.where(np.isin(first, hot), pairs, first * np.uint64(0xC2B2AE3D27D4EB4F))
    return (by >> np.uint64(33)) % np.uint64(shards)


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """One file, put in place whole; a task that runs again writes the same."""
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


def _discounts(n: list[float]) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more from the numbers of entries with counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


@dataclass
class Model:
    """A fitted model: where its arrays are and the numbers that hold for all of it."""

    folder: str
    pair_shards: int
    hot: np.ndarray
    tokens: int = 0
    vocabulary: int = 0
    continuations: int = 0
    pair_discounts: list[float] = field(default_factory=list)
    word_discounts: list[float] = field(default_factory=list)
    word_gamma: float = 1.0

    def remove(self) -> None:
        """Deletes the model's files."""
        shutil.rmtree(self.folder, ignore_errors=True)


def fit(texts: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows of texts (null: empty). Its files lie in the shared folder until model.remove()."""
    spark = texts.sparkSession
    folder = f"{mounted_dir(spark)}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    source = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = cut(source.mapInArrow(_counter(_word_counts), _BLOBS).groupBy("shard").applyInPandas(_merge_words, _BLOBS))
    totals = counted.where("kind = 'total'").select("shard", "blob").collect()  # two numbers a shard
    tokens, vocabulary = sum(int.from_bytes(r.blob, "little") for r in totals), sum(r.shard for r in totals)
    shards = max(16, 1 << max(0, -(-tokens // PAIRS_A_SHARD) - 1).bit_length())
    least = tokens // (4 * shards) + 1

    def hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                words, n = _unpack([blob.as_py()], 2)
                yield pa.RecordBatch.from_arrays([pa.array(words[n >= least].view(np.int64))], names=["word"])

    # fewer than four words a shard can hold so large a part of all tokens
    hot = np.array([r.word for r in counted.where("kind = 'count'").select("blob").mapInArrow(hottest, "word long").collect()] + [np.uint64(START).view(np.int64)], dtype=np.int64).view(np.uint64)

    def pairs(held: list[np.ndarray]):
        first, second = previous(held), np.concatenate(held)
        keys, at, n = np.unique(pair_hashes(first, second), return_index=True, return_counts=True)
        first, second, shard = first[at], second[at], pair_shards(first[at], keys, hot, shards)
        order = np.lexsort((first, shard))
        found, starts = np.unique(shard[order], return_index=True)
        for k, own in zip(found.tolist(), np.split(order, starts[1:])):
            # each first word once, with how many pairs it has here
            words, runs = np.unique(first[own], return_counts=True)
            yield "pair", int(k), _pack(words, runs, second[own], n[own])

    def merge_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stores a shard's pairs; gives how many kinds of word come before and after each word, by count, and counts of counts."""
        words, runs, second, n = _unpack(pdf["blob"], 4)
        first = np.repeat(words, runs)
        del words, runs
        keys = pair_hashes(first, second)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n, first, second = np.add.reduceat(n[order].astype(np.uint64), starts), first[order][starts], second[order][starts]
        shard = int(pdf["shard"].iloc[0])
        _write(folder, f"pair-{shard}", keys[starts])
        _write(folder, f"pair-{shard}-n", _small(n))
        after = _summed(first, n == 1, n == 2, n > 2)
        before = _summed(second, np.ones(len(second), np.uint8))
        stats = np.array([(n == k).sum() for k in (1, 2, 3, 4)] + [len(n)], dtype=np.int64)
        rows = [*_dealt("after", word_shards(after[0]), *after), *_dealt("before", word_shards(before[0]), *before), ("stats", -1 - shard, stats.tobytes())]
        return pd.DataFrame(rows, columns=["kind", "shard", "blob"])

    def merge_all(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stores a shard's words: count, kinds of word before, and kinds after that were seen once, twice, more often."""
        shard = int(pdf["shard"].iloc[0])
        if shard < 0:
            return pdf[["kind", "shard", "blob"]]
        parts, columns = [], {"count": [0], "before": [1], "after": [2, 3, 4]}
        for kind, at in columns.items():
            own = _unpack(pdf.loc[pdf["kind"] == kind, "blob"], 1 + len(at))
            values = np.zeros((len(own[0]), 5), dtype=np.uint64)
            for k, v in zip(at, own[1:]):
                values[:, k] = v
            parts.append((own[0], values))
        words, *sums = _summed(np.concatenate([w for w, _ in parts]).astype(np.uint64), *np.concatenate([v for _, v in parts]).T)
        values = np.stack(sums, axis=1)
        _write(folder, f"word-{shard}", words)
        _write(folder, f"word-{shard}-n", _small(values))
        stats = np.array([(values[:, 1] == k).sum() for k in (1, 2, 3, 4)] + [(values[:, 1] > 2).sum()], dtype=np.int64)
        return pd.DataFrame([("words", shard, stats.tobytes())], columns=["kind", "shard", "blob"])

    merged = source.mapInArrow(_counter(pairs), _BLOBS).groupBy("shard").applyInPandas(merge_pairs, _BLOBS)
    stats = merged.union(counted.where("kind = 'count'")).groupBy("shard").applyInPandas(merge_all, _BLOBS).collect()  # five numbers a shard
    add = lambda kind: np.sum([np.frombuffer(r.blob, np.int64) for r in stats if r.kind == kind] or [np.zeros(5, np.int64)], axis=0).tolist()
    of_pairs, of_words = add("stats"), add("words")
    model = Model(folder, shards, hot, tokens, vocabulary, of_pairs[4], _discounts(of_pairs[:4]), _discounts(of_words[:4]))
    if model.continuations:
        d = model.word_discounts
        model.word_gamma = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[4]) / model.continuations
    return model


_mapped: dict[str, dict[str, np.ndarray]] = {}


def _array(folder: str, name: str) -> np.ndarray | None:
    """A stored array, mapped into memory once per worker; None where a shard had no entries."""
    if folder not in _mapped:
        _mapped.clear()
        _mapped[folder] = {}
    files = _mapped[folder]
    if name not in files:
        path = f"{folder}/{name}.npy"
        files[name] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
    return files[name]


def _look_up(folder: str, kind: str, keys: np.ndarray, shards: np.ndarray, width: int) -> np.ndarray:
    """The stored numbers of keys (distinct, sorted); zeros for those that aren't stored."""
    out = np.zeros((len(keys), width), dtype=np.float64)
    order = np.argsort(shards, kind="stable")
    found, starts = np.unique(shards[order], return_index=True)
    for shard, own in zip(found.tolist(), np.split(order, starts[1:])):
        stored = _array(folder, f"{kind}-{shard}")
        if stored is None or not len(stored):
            continue
        at = np.minimum(np.searchsorted(stored, keys[own]), len(stored) - 1)
        hit = stored[at] == keys[own]
        values = _array(folder, f"{kind}-{shard}-n")
        out[own[hit]] = values[at[hit]].reshape(-1, width)
    return out


def _discounted(n: np.ndarray, discounts: list[float]) -> np.ndarray:
    d = np.array([0.0, *discounts])
    return np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0)


def log_probabilities(model: Model, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For all tokens of the texts in a row: log10 of the model's probability, and their counts in training."""
    tokens, first = np.concatenate(held), previous(held)
    words, which = np.unique(np.r_[tokens, np.uint64(START)], return_inverse=True)
    stats = _look_up(model.folder, "word", words, word_shards(words), 5)
    own = stats[which[:-1]]
    before = stats[np.r_[which[-1], which[:-2]]].copy()
    before[first == np.uint64(START)] = stats[which[-1]]
    keys, at, back = np.unique(pair_hashes(first, tokens), return_index=True, return_inverse=True)
    seen = _look_up(model.folder, "pair", keys, pair_shards(first[at], keys, model.hot, model.pair_shards), 1)[back, 0]
    # the words' own distribution, from how many kinds of word they follow; the rest goes to all words and one unknown
    lower = model.word_gamma / (model.vocabulary + 1)
    if model.continuations:
        lower = lower + _discounted(own[:, 1], model.word_discounts) / model.continuations
    d = model.pair_discounts
    kept = d[0] * before[:, 2] + d[1] * before[:, 3] + d[2] * before[:, 4]
    # what follows a word was counted as often as the word, and what starts a text as often as there are texts
    texts = stats[np.searchsorted(words, np.uint64(END)), 0]
    total = np.where(first == np.uint64(START), texts, before[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(total > 0, (_discounted(seen, d) + kept * lower) / total, lower)
    return np.log10(p), own[:, 0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, keep, n_tokens, n_known, base_score and score (log10), perplexity. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held, n, begin = [], 0, at
                while at < batch.num_rows and n < FLUSH:
                    held.append(token_hashes(batch.column(0)[at].as_py()))
                    n, at = n + len(held[-1]), at + 1
                logs, counts = log_probabilities(model, held)
                starts = np.r_[0, np.cumsum([len(x) for x in held[:-1]], dtype=np.int64)]
                sizes = np.array([len(x) for x in held], dtype=np.int64)
                base = np.log10((counts + 1) / (model.tokens + model.vocabulary + 1))
                total = np.add.reduceat(logs, starts)
                part = batch.slice(begin, at - begin)
                columns = [*part.columns[1:], pa.array(sizes), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(total), pa.array(10 ** (-total / sizes))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), *keep)
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    names = [*source.columns[1:], "n_tokens", "n_known", "base_score", "score", "perplexity"]
    return source.mapInArrow(run, ", ".join([*own, "n_tokens long", "n_known long", "base_score double", "score double", "perplexity double"]))


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text (null: empty) leaves which when divided by parts."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == which


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 7, 2))
    model = fit(docs.where(~F.col("held_out")))
    scored = cut(score(docs, model, keep=("held_out",)))
    model.remove()
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
