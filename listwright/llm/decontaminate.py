"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of ten item words; an item of fewer words is one pattern.  Words
become ids of the benchmark's vocabulary (0: not in it).  Patterns of one length form
a searcher: a shift table over blocks of two words skips positions where no pattern can
end, the hash of a pattern's last block selects a bucket, and direct comparison of all words confirms.

The benchmark is the stated query set.  It is taken in blocks of a bounded number of words, a pass over the
documents for each; the words hit so far travel with the document.  So the driver and each task hold one block,
however many items there are and however long they are; every document meets every block.

Defined results: null text has no words; an empty benchmark hits nothing; items that repeat an id
count once; a null item_id is never reported but its windows hit; rows that repeat a doc_id are scored separately.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Scratch, as_bytes, map_rows, table

WINDOW = 10
#: Benchmark words in one block of patterns (some 40 MB of tables in a task).
BLOCK_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class WuManber:
    """All patterns of one length, as tuples of word ids (1 and up)."""

    def __init__(self, patterns: dict[tuple[int, ...], set[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.bits = 18
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        self.buckets: dict[int, list[tuple[tuple[int, ...], set[int]]]] = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                h = self.hash(np.array(p[end - self.block : end], np.int64))[0]
                self.shift[h] = min(self.shift[h], length - end)
            self.buckets[int(h)].append((p, items))

    def hash(self, ids: np.ndarray) -> np.ndarray:
        x = ids if self.block == 1 else ids[:-1] * 1_000_003 + ids[1:]
        return (x * 2_654_435_761 >> 7) & ((1 << self.bits) - 1)

    def find(self, ids: np.ndarray) -> list[tuple[int, set[int]]]:
        """(start, items) of all occurrences."""
        out: list[tuple[int, set[int]]] = []
        if len(ids) < self.length:
            return out
        blocks = self.hash(ids)
        # A block with a word outside the vocabulary is in no pattern: the full shift.
        known = ids > 0 if self.block == 1 else (ids[:-1] > 0) & (ids[1:] > 0)
        shifts = np.where(known, self.shift[blocks], self.length - self.block + 1).astype(np.uint8).tobytes()
        at, end = self.length - self.block, len(shifts)
        while at < end:
            if step := shifts[at]:
                at += step
                continue
            start = at + self.block - self.length
            here = None
            for p, items in self.buckets.get(int(blocks[at]), ()):
                if here is None:
                    here = tuple(ids[start : start + self.length].tolist())
                if p == here:
                    out.append((start, items))
            at += 1
        return out


class Matcher:
    """Windows of some items, searched by length."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                p = tuple(ids[i : i + window])
                by_length[len(p)][p].add(k)
        self.searchers = [WuManber(p, n) for n, p in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and which items occur."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        hit, found = np.zeros(len(words), bool), set()
        if ids.any():
            for s in self.searchers:
                for start, items in s.find(ids):
                    hit[start : start + s.length] = True
                    found |= items
        return hit, found


def segments(text: bytes, window: int, size: int) -> list[bytes]:
    """An item in parts of some ``size`` words, each window in one of them."""
    if len(text) // 2 < size:  # a word and its blank take two bytes at least
        return [text]
    words, step = words_of(text), max(size, window)
    return [b" ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)]


def blocks(benchmark: DataFrame, window: int = WINDOW, size: int | None = None) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of about ``size`` words, one after the other; one empty block if there are none."""
    block, n, size = [], 0, size or BLOCK_WORDS
    for name, text in benchmark.select(F.col("item_id").cast("string"), as_bytes("text")).toLocalIterator(prefetchPartitions=False):
        for part in segments(bytes(text), window, size):
            if block and n + len(part) // 2 + 1 > size:
                yield block
                block, n = [], 0
            block.append((name, part))
            n += len(part) // 2 + 1
    yield block


def passes(rows: DataFrame, benchmark: DataFrame, window: int, size: int | None, step: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """``step(rows, block, last)`` for each block in turn; what an earlier one returns is written and read again.

    So the driver and every task hold one block at a time, and a benchmark of one block needs no written table.
    """
    spark, scratch, at = rows.sparkSession, Scratch(rows.sparkSession), blocks(benchmark, window, size)
    block, k = next(at), 0
    for following in at:
        sent = spark.sparkContext.broadcast(block)
        rows = scratch.keep(step(rows, sent, False), f"pass{k}")
        sent.destroy()
        if k:
            scratch.drop(f"pass{k - 1}")
        block, k = following, k + 1
    return step(rows, spark.sparkContext.broadcast(block), True)


def covered(edges: list[int], n: int) -> np.ndarray:
    """Which of ``n`` words lie in the runs that start and end at ``edges``."""
    change = np.zeros(n + 1, np.int8)
    change[edges[0::2]], change[edges[1::2]] = 1, -1
    return np.cumsum(change[:n]) > 0


def edges_of(hit: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings) for every row of ``docs``."""

    def step(rows: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        def make():
            matcher = Matcher(sent.value, window)

            def one(doc_id, text, edges, items):
                words = words_of(text)
                hit, found = matcher.search(words)
                hit |= covered(edges, len(words))
                names = sorted({*items, *(matcher.names[k] for k in found)} - {None})
                return (doc_id, len(words), int(hit.sum()), names) if last else (doc_id, text, edges_of(hit), names)

            return one

        return map_rows(rows, make, "doc_id long, n_words long, n_hit long, items array<string>" if last else "doc_id long, text binary, edges array<int>, items array<string>")

    empty = F.array().cast("array<int>").alias("edges"), F.array().cast("array<string>").alias("items")
    return passes(docs.select("doc_id", as_bytes("text").alias("text"), *empty), benchmark, window, size, step)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int | None = None) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, all columns as they are."""

    def step(rows: DataFrame, sent: Broadcast, last: bool) -> DataFrame:
        @F.pandas_udf("boolean")
        def leaks(texts):
            matcher = hold(sent, window)
            return texts.map(lambda t: bool(matcher.search(words_of(bytes(t)))[1]))

        return rows.filter(~leaks(as_bytes("text")))

    return passes(docs, benchmark, window, size, step)


_HELD: dict = {}


def hold(sent: Broadcast, window: int) -> Matcher:
    """One set of tables per worker, however many batches come."""
    key = (sent.id if hasattr(sent, "id") else sent._path, window)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Matcher(sent.value, window)
    return _HELD[key]


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, win FROM (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0))),
ns AS (SELECT DISTINCT n FROM p),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
o AS (SELECT d.doc_id, d.i, p.n, p.item_id FROM (SELECT doc_id, i, ns.n, array_to_string(w[i : i + ns.n - 1], ' ') AS win FROM dp JOIN ns ON i + ns.n - 1 <= len(w)) d JOIN p ON p.n = d.n AND p.win = d.win),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
