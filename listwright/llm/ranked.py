"""Ranked lexical search over dual-sorted wavelet trees, one a shard.

1. One pass counts documents and terms, for the lengths that the weights need.
2. Each task cuts its documents into shards of some SHARD postings; no text is exchanged.  A shard's postings lie
   list by list, in each list by falling impact, as document numbers (numbers follow doc_id).  A wavelet
   matrix over this sequence makes them navigable by document as well: going down by a bit of the number halves the
   document range and keeps each list's order, so the first posting of a list's part in a node is the
   largest impact that any document below it has there.
3. A query starts at the root with the ranges of its lists.  Nodes leave a queue best bound first, many at a time;
   the bound is the sum of weight times first impact over the lists.  A leaf is one document and its bound its score.
   Nodes that cannot enter the k best found so far, in this shard or an earlier one of the task, are dropped,
   so the k best are exact.
4. Tasks hand on k rows a query, which are ranked in two steps.

The shards are a table; impacts by level and ranks are derived from it on loading.  Queries come in blocks of some
BLOCK bytes of terms, each one pass over the shards, so driver and tasks hold one block, however many there are.

Defined results: null and termless texts are no documents and no queries; query rows of one item_id (null too)
count as one text; rows that repeat a doc_id are documents of their own; a null doc_id comes before all others among
equal scores; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, Scratch, as_bytes, map_rows, table

#: Postings of a shard; its last document may add some.
SHARD = 1 << 19
#: Bytes of query terms in a block.
BLOCK = 4 << 20
#: Node ranges that one step of a search expands.
STEP = 1 << 13
TOP = 20
_NULL = np.iinfo(np.int64).min


def terms(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def impact(tf: np.ndarray, length: int, docs: int, total: int) -> np.ndarray:
    """What a term gives a document of ``length`` terms, per unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + 25 * length * docs // total))


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Builder:
    """Postings of one shard in the making."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total, self.numbers = docs, total, {}
        self.ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, found: Counter) -> None:
        number = self.numbers
        term = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
        tf = np.fromiter(found.values(), np.int64, len(found))
        self.parts.append((term, impact(tf, int(tf.sum()), self.docs, self.total)))
        self.ids.append(doc_id)
        self.size += len(found)

    def shard(self) -> tuple:
        """docs, n_null, terms, starts, impacts, bits."""
        ids = np.array([_NULL if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, [i is not None for i in self.ids]))
        sizes = np.array([len(self.parts[k][0]) for k in order])
        term, value = (np.concatenate([self.parts[k][i] for k in order]) for i in (0, 1))
        by = np.argsort((term << 20) - value, kind="stable")
        number = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[by]
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.numbers)))))
        levels, bits = depth(len(ids)), []
        for shift in range(levels - 1, -1, -1):
            bit = (number >> shift) & 1 == 1
            bits.append(np.packbits(bit).tobytes())
            number = np.concatenate((number[~bit], number[bit]))
        return ids[order].tobytes(), sum(i is None for i in self.ids), list(self.numbers), starts.astype(np.int64).tobytes(), value[by].astype(np.int32).tobytes(), b"".join(bits)


def depth(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


class Tree:
    """A shard in memory: per level the rank of ones before each place, and the impacts in that level's order."""

    def __init__(self, docs: bytes, n_null: int, starts: bytes, impacts: bytes, bits: bytes):
        self.ids, self.n_null, self.starts = np.frombuffer(docs, np.int64), n_null, np.frombuffer(starts, np.int64)
        now = np.frombuffer(impacts, np.int32)
        self.n, self.levels = len(now), depth(len(self.ids))
        self.rank = np.zeros((self.levels, self.n + 1), np.int32)
        self.value = np.empty((self.levels + 1, self.n), np.int32)
        self.zeros, self.value[0], wide = np.empty(self.levels, np.int64), now, (self.n + 7) // 8
        for k in range(self.levels):
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, wide, k * wide), count=self.n)
            np.cumsum(bit, out=self.rank[k, 1:])
            ones = bit == 1
            self.zeros[k] = self.n - self.rank[k, -1]
            now = self.value[k + 1] = np.concatenate((now[~ones], now[ones]))

    def bounds(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> np.ndarray:
        first = self.value[level[:, None], np.minimum(lo, self.n - 1)]
        return np.where(hi > lo, first, 0) @ weights

    def search(self, lists: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Puts the documents of the lists with these numbers that belong into ``best`` there."""
        level, doc = np.zeros(1, np.int64), np.zeros(1, np.int64)
        lo, hi = self.starts[lists][None, :], self.starts[lists + 1][None, :]
        bound, step = self.bounds(level, lo, hi, weights), max(4, STEP // len(lists))
        while len(bound):
            # Best bounds first; equal ones by their smallest document.
            if len(bound) > step:
                order = np.argpartition(-bound, step)
                now, later = order[:step], order[step:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            at, left = level[now], lo[now]
            one_lo, one_hi = self.rank[at[:, None], left], self.rank[at[:, None], hi[now]]
            zero = self.zeros[at][:, None]
            new = [np.concatenate(x) for x in ((at + 1, at + 1), (doc[now], doc[now] + (1 << (self.levels - 1 - at))), (left - one_lo, zero + one_lo), (hi[now] - one_hi, zero + one_hi))]
            new.append(self.bounds(new[0], new[2], new[3], weights))
            leaf = (new[0] == self.levels) & (new[4] > 0)
            if leaf.any():
                best.add(new[4][leaf], self.ids[new[1][leaf]], new[1][leaf] < self.n_null)
            level, doc, lo, hi, bound = (np.concatenate((old[later], x[~leaf])) for old, x in zip((level, doc, lo, hi, bound), new, strict=True))
            may = (bound > 0) & (level < self.levels)
            may[may] = best.may(bound[may], self.ids[doc[may]])
            level, doc, lo, hi, bound = (x[may] for x in (level, doc, lo, hi, bound))


class Best:
    """The k best (score, doc_id) so far; equal scores by ascending id, null first."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate((self.score, score)), np.concatenate((self.ids, ids)), np.concatenate((self.null, null))
        order = np.lexsort((ids, ~null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]

    def may(self, bound: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether nodes with these bounds and smallest ids can change the k best."""
        if len(self.score) < self.k:
            return np.ones(len(bound), bool)
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (first <= self.ids[-1]))


def blocks(queries: DataFrame, size: int) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """The items with their terms' counts, in blocks of some ``size`` bytes, one after the other."""
    texts = queries.select("item_id", as_bytes("text").alias("text")).groupBy("item_id").agg(F.collect_list(F.col("text").cast("string")).alias("texts"))
    block, n = [], 0
    for item, found in texts.toLocalIterator():
        counts = Counter(w for t in found for w in terms(t.encode()))
        grown = sum(map(len, counts)) + 8 * len(counts)
        if block and n + grown > size:
            yield block
            block, n = [], 0
        if counts:
            block.append((item, dict(counts)))
            n += grown
    if block:
        yield block


class RankedIndex:
    """The shards of a document table, with what the weights need."""

    def __init__(self, shards: DataFrame, docs: int):
        self.shards, self.docs = shards, docs

    @classmethod
    def of(cls, docs: DataFrame, size: int = SHARD) -> RankedIndex:
        rows = docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("text"))
        counted = map_rows(rows.select("text"), lambda: lambda text: (len(terms(text)),), "n long").filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        n_docs, total = counted[0], counted[1] or 1

        def run(batches):
            def row(builder):
                kinds = pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((builder.size, *builder.shard()), kinds, strict=True)], names=["n", "docs", "n_null", "terms", "starts", "impacts", "bits"])

            builder = Builder(n_docs, total)
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    if found := Counter(terms(text.as_py())):
                        builder.add(doc_id.as_py(), found)
                    if builder.size >= size:
                        yield row(builder)
                        builder = Builder(n_docs, total)
            if builder.size:
                yield row(builder)

        made = rows.mapInArrow(run, "n long, docs binary, n_null int, terms array<binary>, starts binary, impacts binary, bits binary")
        # Few rows of megabytes: small row groups, looked at after each row, so that no reader or writer gathers many.
        return cls(Scratch(docs.sparkSession).keep(made, "shards", **{"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.row.count.limit": 8}), n_docs)

    def frequencies(self, wanted: list[bytes]) -> dict[bytes, int]:
        """Documents that hold each of the terms; reads the shards' term lists only."""
        sent = self.shards.sparkSession.sparkContext.broadcast(wanted)

        def run(batches):
            asked, total = pa.array(sent.value, pa.binary()), np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for k in range(batch.num_rows):
                    at = pc.index_in(asked, value_set=batch.column(0)[k].values)
                    held = at.is_valid().to_numpy(False)
                    lists = at.drop_null().to_numpy()
                    total[held] += np.diff(np.frombuffer(batch.column(1)[k].as_py(), np.int64))[lists]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "df"])

        found = self.shards.select("terms", "starts").mapInArrow(run, "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).collect()
        sent.destroy()
        return {wanted[r.k]: r.df for r in found}

    def search(self, queries: DataFrame, k: int = TOP, size: int = BLOCK) -> DataFrame:
        """item_id, rank, doc_id, score: the k best documents of each item."""
        from pyspark.sql.pandas.types import to_arrow_type

        spark, kind = queries.sparkSession, queries.schema["item_id"].dataType
        scratch, arrow = Scratch(spark), to_arrow_type(queries.schema["item_id"].dataType)
        out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
        for number, block in enumerate(blocks(queries, size)):
            df = self.frequencies(sorted({w for _, counts in block for w in counts}))
            asked = [(item, [(w, n * weight(df[w], self.docs)) for w, n in counts.items() if w in df]) for item, counts in block]
            sent = spark.sparkContext.broadcast(asked)

            def run(batches, sent=sent):
                asked, best = sent.value, [Best(k) for _ in sent.value]
                known = {w: i for i, w in enumerate({w for _, found in asked for w, _ in found})}
                numbers = [(np.array([known[w] for w, _ in found], np.int64), np.array([v for _, v in found], np.int64)) for _, found in asked]
                words = pa.array(list(known), pa.binary())
                for batch in batches:
                    for row in range(batch.num_rows):
                        docs, n_null, held, starts, impacts, bits = (c[row] for c in batch.columns)
                        at = pc.fill_null(pc.index_in(words, value_set=held.values), -1).to_numpy(False).astype(np.int64)
                        tree = Tree(docs.as_py(), n_null.as_py(), starts.as_py(), impacts.as_py(), bits.as_py())
                        for (number, weights), into in zip(numbers, best, strict=True):
                            here = at[number]
                            ok = (here >= 0) & (weights > 0)
                            if ok.any():
                                tree.search(here[ok], weights[ok], into)
                part = TaskContext.get().partitionId() % 256
                for (item, _), found in zip(asked, best, strict=True):
                    n = len(found.score)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * n, arrow), pa.array([part] * n, pa.int32()), pa.array(found.ids, mask=found.null), pa.array(found.score)], names=["item_id", "part", "doc_id", "score"])

            rows = self.shards.select("docs", "n_null", "terms", "starts", "impacts", "bits").mapInArrow(run, f"item_id {kind.simpleString()}, part int, doc_id long, score long")
            for by in (["item_id", "part"], ["item_id"]):
                rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).filter(F.col("rank") <= k)
            out = out.unionByName(scratch.keep(rows.select("item_id", "rank", "doc_id", "score"), f"block{number}"))
            sent.destroy()
        return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return RankedIndex.of(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, t FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, nd),
r AS (SELECT item_id, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN p USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
