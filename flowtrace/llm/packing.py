"""Best-fit decreasing packing of token sequences.

Best fit depends on piece lengths alone, and there are at most `capacity` of them. So Spark counts the
pieces of each length, the plan for the counts is made once with a segment tree over remaining
capacities, and every piece finds its place by its rank among those of its length. The result is the
one that best-fit decreasing gives for all pieces at once, however many there are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

CAPACITY = 2048
#: Rank groups per length: ranks are counted within a group and offset by the groups before it.
GROUPS = 512
#: Cached distinct words per worker; the cache is emptied when full.
CACHE = 700_000


class SegmentTree:
    """Which remaining capacities have open bins; finds the tightest that fits in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest room of at least size that an open bin has."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of counts[length] pieces, as runs (length, first rank, pieces, first bin, pieces a bin, offset).

    The pieces of a run fill consecutive bins, so many to a bin, the first at offset in each.
    """
    tree, rooms, runs, bins = SegmentTree(capacity), {}, [], 0  # rooms: room -> [(first bin, bins)]
    for length in sorted((k for k, n in counts.items() if n and k > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                first, many = bins, -(-left // (capacity // length))
                bins, room = bins + many, capacity
            else:
                first, many = rooms[room].pop()
                tree.add(room, -many)
            each = min(room // length, left)
            used = min(many, left // each)
            runs.append((length, rank, used * each, first, each, capacity - room))
            rank, left = rank + used * each, left - used * each
            for start, n, rest in ((first, used, room - each * length), (first + used, many - used, room)):
                if n and rest:
                    rooms.setdefault(rest, []).append((start, n))
                    tree.add(rest, n)
    return runs


#: The pattern by which a word-level tokenizer parts a text, and letters and signs whose tokens are those of either alone.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-^`{-~]*)")


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary has for each byte: itself where it prints, else the next one from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    return [chr(b if prints[b] else 256 + b - sum(prints[:b])) for b in range(256)]


class _Words(dict):
    """The ids of each distinct word, as little-endian unsigned 32-bit numbers; each is tokenised once.

    A run of letters, perhaps with signs after it, goes straight to the vocabulary's merges, which is
    what the tokenizer does after its patterns; anything else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merges, self.letters = tokenizer, tokenizer.model.tokenize, _byte_letters()
        self.runs: dict[str, bytes] = {}

    def _run(self, letters: str) -> bytes:
        if letters not in self.runs:
            mapped = letters if letters.isascii() else "".join(self.letters[b] for b in letters.encode())
            self.runs[letters] = np.array([t.id for t in self.merges(mapped)], dtype="<u4").tobytes()
        return self.runs[letters]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
            self.runs.clear()
        plain = _PLAIN.fullmatch(text := word.decode())
        if plain:
            ids = self._run(plain[1].lower()) + (self[plain[2].encode()] if plain[2] else b"")
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = ids
        return ids


_encoders: dict[str, object] = {}


def encoder(path: str):
    """A function from a text to its ids as bytes, for the tokenizer at path; made once per worker.

    A word-level tokenizer drops white space and never joins what it parts, so the ids of a text are
    those of its words in turn. (bytes.split parts at ASCII white space alone.)
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
        tokenizer = Tokenizer.from_file(path)
        state = json.loads(tokenizer.to_str())
        split, *rest = (state["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        by_word = split.get("pattern") == {"Regex": WORD_SPLIT} and [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        if by_word and [x["type"] for x in (state["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            words = _Words(tokenizer)
            _encoders[path] = lambda text: b"".join(map(words.__getitem__, text.encode().split()))
        else:
            _encoders[path] = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Null text is empty; an empty text is one piece that holds only end_id. Ids longer than capacity
    are cut into pieces of capacity, the last of which may be shorter.
    """
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
    id_type = docs.schema[id_col].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, number, start, ids = [], [], [], []
                for row, text in enumerate(part.column(1)):
                    own = encode(text.as_py()) + end
                    for k, first in enumerate(range(0, len(own), step)):
                        rows.append(row), number.append(k), start.append(first // 4), ids.append(own[first : first + step])
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(pieces, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, order: tuple[str, ...], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id and offset, packed by best-fit decreasing into sequences of at most capacity.

    order names columns that tell pieces of one length apart; rows equal in all of them are
    interchangeable. Lengths must be between 1 and capacity. No more than capacity counts reach the driver.
    """
    spark, length = pieces.sparkSession, F.col(length_col)
    dealt = cut(pieces.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(GROUPS))))
    groups = dealt.groupBy(length.alias("_length"), "_group").agg(F.count("*").alias("_n"))
    before = groups.select("_length", "_group", "_n", F.expr("sum(_n) OVER (PARTITION BY _length ORDER BY _group) - _n").alias("_before"))
    counts = {int(r[0]): int(r[1]) for r in dealt.groupBy(length).count().collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"piece lengths must be between 1 and {capacity}")
    schema = "_length long, _first long, _many long, _bin long, _each long, _offset long"
    runs = spark.createDataFrame(plan(counts, capacity), schema)
    by_length = runs.groupBy("_length").agg(F.sort_array(F.collect_list(F.struct("_first", "_many", "_bin", "_each", "_offset"))).alias("_runs"))
    # of a length's runs a group keeps those that its own ranks fall into
    own = F.expr("filter(_runs, r -> r._first < _before + _n AND r._first + r._many > _before)")
    places = before.join(by_length, "_length").select("_length", "_group", "_before", own.alias("_runs"))
    ranked = dealt.alias("d").join(places, (length == F.col("_length")) & (F.col("d._group") == places["_group"]))
    by = ", ".join(f"`{c}`" for c in order)
    ranked = ranked.withColumn("_rank", F.expr(f"_before + row_number() OVER (PARTITION BY _length, d._group ORDER BY {by}) - 1"))
    run = ranked.withColumn("_run", F.expr("element_at(filter(_runs, r -> r._first <= _rank), -1)"))
    return run.select(
        *(F.col(f"d.{c}") for c in pieces.columns),
        F.expr("_run._bin + (_rank - _run._first) div _run._each").alias("sequence_id"),
        (F.col("_run._offset") + F.expr("(_rank - _run._first) % _run._each") * length).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids, pieces joined in order of offset; a sequence has at most capacity ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame) -> DataFrame:
    """The packed pieces of docs with a checksum in place of the ids."""
    pieces = tokenize(docs, default_tokenizer())
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(slim, ("doc_id", "piece", "start", "ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
