"""A stored word index: postings in buckets by word, kept up by changed rows, read by the asked words' buckets only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..shared import dealt
from ..streaming.store import BucketStore

#: Rows that a version adds to a word, or takes from it; a word has several lists a version.
POSTINGS = "word string, ids array<string>, present boolean, version long"
#: Lists of one word that compaction makes at most.
WAYS = 32
#: Words of a query; more are refused.
MOST_WORDS = 256


def query_words(query: str | None) -> list[str]:
    """The words that must all occur, as in :func:`search.matches_text`."""
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in (query or "").lower()).split()})


def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ids, present) of a batch's rows (id, gained words, lost words): one row a word instead of one a word and id."""
    for batch in batches:
        for name, present in (("gained", True), ("lost", False)):
            own = batch.column(name)
            words = own.flatten().dictionary_encode()
            codes = words.indices.to_numpy()
            ids = batch.column("id").take(pc.list_parent_indices(own).take(pa.array(np.argsort(codes, kind="stable"))))
            ends = np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))
            held = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([words.dictionary, held, pa.repeat(pa.scalar(present), len(held))], ["word", "ids", "present"])


class WordIndex:
    """Postings of a table's texts.

    An update appends, per changed row, the words it lost and gained, so its cost follows the change, not the table.
    Readers take the newest entry of each word and row.  :meth:`compact` rewrites buckets that have grown long chains.
    A word that a third of all rows hold has many lists, which are spread over tasks by their first id, in writing and in reading.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, BucketStore(spark, root, buckets)

    @staticmethod
    def words(rows: DataFrame, key: str, *columns: str) -> DataFrame:
        """(id, words) of rows with an id."""
        whole = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
        return rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), text.lexemes(whole).alias("words"))

    @staticmethod
    def delta(now: DataFrame, was: DataFrame | None) -> DataFrame:
        """(word, ids, present) of the words that ids gained and lost.

        The words of an id meet as arrays and leave as lists of ids, so that no single posting crosses an exchange.
        """
        side = lambda df, mark: df.withColumn("_now", F.lit(mark))
        both = dealt(side(now, True) if was is None else side(now, True).unionByName(side(was, False)), "id")
        held = lambda own: F.flatten(F.collect_list(F.when(own, F.col("words"))))
        sides = both.groupBy("id").agg(held(F.col("_now")).alias("now"), held(~F.col("_now")).alias("was"))
        return sides.select("id", F.array_except("now", "was").alias("gained"), F.array_except("was", "now").alias("lost")).mapInArrow(lists, "word string, ids array<string>, present boolean")

    def update(self, version: int, key: str, columns: list[str], new: DataFrame, old: DataFrame | None = None) -> bool:
        """Take in changed rows: ``new`` as they are, ``old`` as they were (rows without a new form are deleted ones).

        False if ``version`` is there already.
        """
        if self.store.version() >= version:
            return False
        delta = self.delta(self.words(new, key, *columns), None if old is None else self.words(old, key, *columns))
        self.store.commit(version, appended={"postings": self._write(delta, version)})
        return True

    def _write(self, lists: DataFrame, version: int) -> list[int]:
        own = lists.withColumns({"version": F.lit(version).cast("long"), "_first": F.col("ids")[0]})
        return self.store.write("postings", own, version, "word", spread="_first")

    def current(self, buckets: list[int] | None = None, words: list[str] | None = None) -> DataFrame:
        """(word, id) in force."""
        rows = self.store.read("postings", POSTINGS, buckets)
        if words is not None:
            rows = rows.filter(F.col("word").isin(words))
        return rows.select("word", F.explode("ids").alias("id"), "version", "present").groupBy("word", "id").agg(F.max_by("present", "version").alias("present")).filter("present").select("word", "id")

    def matching(self, query: str | None) -> DataFrame:
        """id of the rows that hold all words of the query; a query without words has no answer here."""
        words = query_words(query)
        if not 0 < len(words) <= MOST_WORDS:
            raise ValueError(f"a query needs 1 to {MOST_WORDS} words")
        asked = self.spark.createDataFrame([(w,) for w in words], "word string").select(self.store.bucket("word")).distinct()
        found = self.current([r[0] for r in asked.collect()], words)
        return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(words)).select("id")

    def compact(self, version: int, longest: int = 8) -> list[int]:
        """Rewrite the buckets whose postings lie in more than ``longest`` versions; returns them."""
        long = [b for b, versions in self.store.folders("postings").items() if len(versions) > longest]
        if long and self.store.version() < version:
            rows = self.current(long).groupBy("word", F.pmod(F.xxhash64("id"), F.lit(WAYS))).agg(F.collect_list("id").alias("ids")).select("word", "ids", F.lit(True).alias("present"))
            self.store.commit(version, {"postings": (long, self._write(rows, version))})
        return long
