"""Helpers shared by the training-data operators.

Texts travel to Python as UTF-8 bytes: lower-casing A-Z and splitting on ASCII
blanks are then two C calls, and every other character passes through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and blanks out all ASCII but letters and digits.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit word hashes, remembered up to a fixed number of words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` consecutive words; fewer words form one window."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= PRIME
        out += words[k : len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids give 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default of our own only on one machine."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/listwright"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return Scratch(df.sparkSession).keep(df, name)


class Scratch:
    """Tables of one job in the shared folder; :meth:`drop` deletes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/kept/{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame, name: str, **options: int) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, step: int = 512) -> DataFrame:
    """Apply a per-row helper to Arrow batches.

    ``make`` runs once per task and returns a function from one row's values to one
    output row; output leaves in slices of ``step`` rows, so memory stays bounded.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return df.mapInArrow(run, schema)
