"""What the corpus operators share: the word pattern, table reading and lineage cuts."""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir

__all__ = ["GAP", "WORD", "cut", "fold", "mounted_dir", "shared_dir", "table", "word_hashes", "words"]

#: A word is a maximal run of anything but ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mounted_dir(spark: SparkSession) -> str:
    """shared_dir as a path that Python on every executor can open; ValueError where it isn't a mounted folder."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need spark.checkpoint.dir on a mounted shared folder, not {url.scheme}://")
    return url.path


def words(text: Column) -> Column:
    """The words of text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP, -1), "")


def fold(text: Column) -> Column:
    """text with A-Z in lower case and all else as it is (null: empty)."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Distinct words whose hashes a worker keeps.
CACHE = 100_000


class _Hashes(dict):
    """A word's 64-bit hash; each word is hashed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of text in order, A-Z in lower case (null: none)."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
