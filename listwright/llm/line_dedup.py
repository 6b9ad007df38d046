"""Reversible line de-duplication: sharded cuckoo filters over exact reference counts.

The state is three tables in the shared folder.  *Postings* (key, doc_id) is exact; *counts* (key, documents, largest
doc_id) is its aggregate with map-side combine, so a line that a third of all documents hold costs one row per task;
*filters* holds one cuckoo filter per shard of the key space, with the keys at or over the threshold.  A filter answers
"surely not frequent" without touching the counts and, unlike a Bloom filter, gives entries back: an
insertion or deletion changes the counts of its own lines only, and the keys that cross the threshold are added to or
discarded from the filters of their shards; the other filters are taken over as they are.

Defined results: a null text is one empty line; all rows with a null id form one document, which counts once, loses
frequent lines like others and owns a line only if no document with an id holds it; rows that repeat a doc_id are one
document too; extra columns of ``docs`` pass through :meth:`LineDedup.apply`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, keep, map_rows, table

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SLOTS = 4
#: Filters up to this size together are sent to every task; larger ones meet the postings of their shards in an exchange.
FILTER_BYTES = 4 << 20
#: Postings of one shard that meet its filter in one group.
GROUP_ROWS = 1_000_000
KEY = ["k1", "k2"]


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 128-bit key of a line, None for lines too short to count."""
    key = line.strip(BLANKS)
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.translate(LOWER), digest_size=16).digest()


def halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; partial-key cuckoo hashing with deletion."""

    def __init__(self, capacity: int, cells: np.ndarray | None = None):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.8 * SLOTS)))))
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.uint64(len(self.cells) - 1)
        mark = (k2.astype(np.uint64) >> np.uint64(48)) | np.uint64(1)
        first = k1.astype(np.uint64) & last
        return mark.astype(np.uint16), first, first ^ (mark * np.uint64(0x5BD1E995) & last)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.places(k1, k2)), strict=True):
            self._put(mark, a, b)

    def _put(self, mark: int, a: int, b: int) -> None:
        last = len(self.cells) - 1
        for kick in range(500):
            for at in (a, b):
                if len(free := np.flatnonzero(self.cells[at] == 0)):
                    self.cells[at, free[0]] = mark
                    return
            slot = kick % SLOTS
            mark, old = int(self.cells[b, slot]), mark
            self.cells[b, slot] = old
            a, b = b, b ^ (mark * 0x5BD1E995 & last)
        raise OverflowError("cuckoo filter is full")

    def discard(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.places(k1, k2)), strict=True):
            for at in (a, b):
                if len(held := np.flatnonzero(self.cells[at] == mark)):
                    self.cells[at, held[0]] = 0
                    break

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(k1, k2)
        return (self.cells[a] == mark[:, None]).any(1) | (self.cells[b] == mark[:, None]).any(1)


def built(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    """A filter of all keys; grows on the rare overflow."""
    room = len(k1)
    while True:
        try:
            (f := CuckooFilter(room)).add(k1, k2)
            return f
        except OverflowError:
            room *= 2


def changed_filter(cells: bytes | None, add: np.ndarray, drop: np.ndarray) -> bytes | None:
    """A filter's cells after insertions and deletions; None if it has no room (or is new) and is to be built."""
    if cells is None:
        return None
    f = CuckooFilter.load(cells)
    f.discard(drop[:, 0], drop[:, 1])
    try:
        f.add(add[:, 0], add[:, 1])
    except OverflowError:
        return None
    return f.dump()


@dataclass
class LineDedup:
    """Incremental state.  ``insert`` and ``remove`` return a new state; nothing is changed in place."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @staticmethod
    def read_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        def make():
            def one(doc_id, text):
                found = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                return doc_id, [k[:8] for k in found], [k[8:] for k in found]

            return one

        # One Arrow list per document keeps Python's row count low; the JVM explodes it.
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = make()
            for batch in batches:
                ids, k1, k2 = [], [], []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _, a, b = one(doc_id, text)
                    ids += [doc_id] * len(a)
                    k1 += a
                    k2 += b
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(k1), np.int64)), pa.array(np.frombuffer(b"".join(k2), np.int64)), pa.array(ids, pa.int64())], names=["k1", "k2", "doc_id"])

        return docs.select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(run, "k1 long, k2 long, doc_id long")

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = 50_000) -> LineDedup:
        postings = keep(cls.read_postings(docs, min_chars), "postings")
        counts = keep(counted(postings), "counts")
        shards = max(1, -(-counts.filter(F.col("refs") >= min_docs).count() // shard_keys))
        state = cls(postings, counts, None, shards, min_chars, min_docs)
        state.filters = keep(state.built_filters(state.frequent()), "filters")
        return state

    def insert(self, docs: DataFrame) -> LineDedup:
        """``docs``: documents that the state does not hold yet."""
        more = keep(self.read_postings(docs, self.min_chars), "inserted")
        counts = self.counts.unionByName(counted(more)).groupBy(KEY).agg(F.sum("refs").alias("refs"), F.max("owner").alias("owner"))
        return self.moved(keep(self.postings.unionByName(more), "postings"), keep(counts, "counts"), more.select(KEY))

    def remove(self, doc_ids: DataFrame) -> LineDedup:
        """``doc_ids``: one column doc_id.  All traces of these documents leave the counts."""
        # Two readings of the exact table: what leaves, and what stays.
        ids = doc_ids.select("doc_id").distinct()
        gone = keep(self.postings.join(ids, "doc_id", "left_semi").select(KEY).distinct(), "removed")
        left = keep(self.postings.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"), "postings")
        # Only the lines of removed documents are counted again: their largest id may have left.
        again = counted(left.join(gone, KEY, "left_semi"))
        return self.moved(left, keep(self.counts.join(gone, KEY, "left_anti").unionByName(again), "counts"), gone)

    def moved(self, postings: DataFrame, counts: DataFrame, touched: DataFrame) -> LineDedup:
        """The new state, with the filters changed by the ``touched`` keys that crossed the threshold."""
        new = LineDedup(postings, counts, None, self.shards, self.min_chars, self.min_docs)
        keys = touched.distinct()
        was, now = (s.frequent().select(KEY).join(keys, KEY, "left_semi") for s in (self, new))
        both = now.withColumn("by", F.lit(1)).unionByName(was.withColumn("by", F.lit(-1))).groupBy(KEY).agg(F.sum("by").cast("int").alias("by")).filter("by <> 0")

        def change(old: pa.Table, moves: pa.Table) -> pa.Table:
            cells = old.column("cells").to_pylist()
            k1, k2, by = (moves.column(c).to_numpy() for c in (*KEY, "by"))
            k = np.stack((k1, k2), 1)
            shard = (old if len(cells) else moves).column("shard")[:1]
            return pa.table({"shard": shard, "cells": pa.array([changed_filter(cells[0] if cells else None, k[by > 0], k[by < 0]) if len(by) else cells[0]], pa.binary())})

        changed = keep(self.filters.groupBy("shard").cogroup(both.withColumn("shard", self.shard()).groupBy("shard")).applyInArrow(change, "shard int, cells binary"), "changed")
        fresh = new.frequent().withColumn("shard", self.shard()).join(changed.filter("cells IS NULL").select("shard"), "shard", "left_semi")
        new.filters = keep(changed.filter("cells IS NOT NULL").unionByName(self.built_filters(fresh)), "filters")
        return new

    def shard(self):
        return F.pmod("k2", F.lit(self.shards)).cast("int")

    def references(self) -> DataFrame:
        """The exact table: key, number of documents, largest doc_id."""
        return self.counts

    def frequent(self) -> DataFrame:
        return self.counts.filter(F.col("refs") >= self.min_docs)

    def built_filters(self, keys: DataFrame) -> DataFrame:
        """New filters of the shards of ``keys``: (shard, cells)."""

        def build(t: pa.Table) -> pa.Table:
            return pa.table({"shard": t.column("shard")[:1], "cells": pa.array([built(t.column("k1").to_numpy(), t.column("k2").to_numpy()).dump()], pa.binary())})

        return keys.select(*KEY, self.shard().alias("shard")).groupBy("shard").applyInArrow(build, "shard int, cells binary")

    def maybe_frequent(self) -> DataFrame:
        """Postings that the filters may hold."""
        shards = self.shards
        size = self.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0))).first()[0]
        if size <= FILTER_BYTES:
            sent = self.postings.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["cells"]) for r in self.filters.collect()})

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = {k: CuckooFilter.load(v) for k, v in sent.value.items()}
                for batch in batches:
                    k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
                    shard, may = k2 % shards, np.zeros(len(k1), bool)
                    for s, f in own.items():
                        at = np.flatnonzero(shard == s)
                        may[at] = f.holds(k1[at], k2[at])
                    yield batch.filter(pa.array(may))

            return self.postings.mapInArrow(probe, "k1 long, k2 long, doc_id long")

        # A shard's postings are cut in groups of bounded size; each meets a copy of the shard's filter.
        most = self.counts.groupBy(self.shard().alias("shard")).agg(F.sum("refs").alias("n")).agg(F.max("n")).first()[0] or 0
        salts = int(most // GROUP_ROWS + 1)

        def meet(cells: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.select([*KEY, "doc_id"])
            if not cells.num_rows:
                return rows.slice(0, 0)
            f = CuckooFilter.load(cells.column("cells")[0].as_py())
            return rows.filter(pa.array(f.holds(rows.column("k1").to_numpy(), rows.column("k2").to_numpy())))

        copies = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = self.postings.withColumns({"shard": self.shard(), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
        return copies.groupBy("shard", "salt").cogroup(rows.groupBy("shard", "salt")).applyInArrow(meet, "k1 long, k2 long, doc_id long")

    def drops(self) -> DataFrame:
        """(doc_id, keys): the lines each document loses, as 16-byte keys."""
        exact = self.maybe_frequent().join(self.frequent().select(*KEY, "owner"), KEY)
        key = F.concat(F.unhex(F.lpad(F.hex("k1"), 16, "0")), F.unhex(F.lpad(F.hex("k2"), 16, "0")))
        lost = exact.filter(~F.col("doc_id").eqNullSafe(F.col("owner"))).select("doc_id", key.alias("key"))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def marked(self, docs: DataFrame, *columns: str) -> DataFrame:
        """``row`` (the ``columns`` of docs, all if none are named) and ``keys``, those that the row's document loses."""
        drops = self.drops().toDF("id", "keys")
        rows = docs.select(F.struct(*(f"`{c}`" for c in columns or docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own"))
        return rows.join(drops, F.col("own").eqNullSafe(F.col("id")), "left").select("row", "keys")

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its lines dropped from ``text``; other columns as they are, n_chars renewed."""
        chars = self.min_chars

        @F.pandas_udf("string")
        def rest(text: pd.Series, keys: pd.Series) -> pd.Series:
            return pd.Series([t if k is None else kept_lines(t.encode(), wanted(k), chars)[0].decode("utf-8", "replace") for t, k in zip(text, keys, strict=True)], dtype=object)

        text = F.col("row.text")
        out = self.marked(docs).select("row", "keys", F.when(F.col("keys").isNull(), text).otherwise(rest(F.coalesce(text, F.lit("")), "keys")).alias("new"))
        new = {"text": F.col("new")}
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(F.col("keys").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
        return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def counted(postings: DataFrame) -> DataFrame:
    """(k1, k2, refs, owner): documents that hold a key, rows of one doc_id (or of none) as one, and the largest id."""
    return postings.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(KEY).agg(F.count("*").alias("refs"), F.max("doc_id").alias("owner"))


def wanted(keys) -> frozenset[bytes]:
    """Keys as line_key gives them; the exchange stores each half as a big-endian number."""
    return frozenset(bytes(k[7::-1]) + bytes(k[:7:-1]) for k in map(bytes, keys))


def kept_lines(text: bytes, drop: frozenset[bytes], min_chars: int = MIN_CHARS) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    kept = [x for x in lines if not (k := line_key(x, min_chars)) or k not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def make():
        def one(doc_id, text, keys):
            kept, n, gone = kept_lines(text, wanted(keys or ()))
            return doc_id, n, gone, hashlib.sha256(kept).hexdigest()

        return one

    marked = LineDedup.of(docs).marked(docs)
    return map_rows(marked.select("row.doc_id", as_bytes("row.text").alias("text"), "keys"), make, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'pos': i})) AS u FROM documents)
), f AS (SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, f.key IS NOT NULL AND l.doc_id <> f.owner AS gone FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
