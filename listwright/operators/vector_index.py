"""A vector index: items stored by coarse cell, queries read the nearest cells and rank their items exactly.

Cell centres are fitted on a bounded sample; every item is stored.  The exact search is :func:`rag.similar`; here the
share of cells that a query reads trades recall for reading, and reading all cells is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top

#: Share of the true neighbours that the default number of cells is to hold, neighbours and queries of the sample that set it.
REACH, NEIGHBOURS, ASKED = 0.95, 10, 256
#: Items that centres are fitted on, rows of a group that ranks a cell's items, queries of a block.
SAMPLE, ROWS, BLOCK = 20_000, 8192, 4096


def matrix(values) -> np.ndarray:
    return np.array(values.to_pylist(), float)


def centres_of(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows."""
    out = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, out, 1)[:, 0]
        n = np.bincount(own, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, own, x)
        out[n > 0] = total[n > 0] / n[n > 0, None]
    return out


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of every row, nearest first."""
    d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def calibrated(x: np.ndarray, centres: np.ndarray) -> int:
    """How many of the nearest cells hold REACH of the neighbours, by ASKED rows of ``x`` against all of them."""
    asked = np.unique(np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int))
    k = min(NEIGHBOURS, len(x))
    own, place = nearest(x, centres, 1)[:, 0], np.argsort(nearest(x[asked], centres, len(centres)), axis=1)
    steps = [place[row, own[np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:k]]] for row, q in enumerate(asked)]
    return int(np.quantile(np.concatenate(steps), REACH, method="higher")) + 1


class VectorIndex:
    """``probes`` is the number of cells that a query reads by default."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, probes: int):
        self.spark, self.path, self.centres, self.probes = spark, path.rstrip("/"), centres, probes

    @classmethod
    def build(cls, items: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Store ``items`` (item_id long, vector) by cell; ``cells`` defaults to the square root of their number.

        Null vectors, and those of another length than most have, are not stored.
        """
        own = items.filter("vector IS NOT NULL AND size(vector) > 0")
        dims = own.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        own = own.filter(F.size("vector") == (dims.d if dims else 0))
        n = dims["count"] if dims else 0
        cells = cells or max(1, round(math.sqrt(n)))
        # The smallest hashes: some ``sample`` rows, however many there are.
        part = own.filter(F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, n))))).select("vector") if n > sample else own.select("vector")
        x = matrix(part.toArrow()["vector"]) if n else np.zeros((1, 1))
        centres = centres_of(x, cells)
        index = cls(items.sparkSession, path, centres, calibrated(x, centres))

        def placed(batches):
            for batch in batches:
                for b in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest(matrix(b.column(1)), centres, 1)[:, 0].astype(np.int32))], names=["item_id", "vector", "cell"])

        rows = own.select(F.col("item_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(placed, "item_id long, vector array<double>, cell int") if n else own.limit(0).select(F.col("item_id").cast("long"), F.col("vector").cast("array<double>"), F.lit(0).alias("cell"))
        # A cell can hold a third of all items: its rows are dealt by id too.
        rows.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(16))).write.mode("overwrite").partitionBy("cell").parquet(index.path)
        return index

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, item_id, distance, position: the ``k`` nearest items in each query's ``probes`` nearest cells, ties by id.

        Queries meet the items of a cell in groups of bounded size; a group hands on k items a query.
        """
        probes, centres = probes or self.probes, self.centres
        items = self.spark.read.schema("item_id long, vector array<double>, cell int").parquet(self.path)
        sizes = items.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("n"))

        def asked(batches):
            for b in batches:
                cells = nearest(matrix(b.column(1)), centres, probes)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query_id", "vector", "cells"])

        own = queries.filter("vector IS NOT NULL").select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(asked, "query_id long, vector array<double>, cells array<int>")
        own = own.select("query_id", "vector", F.explode("cells").alias("cell")).join(sizes, "cell")
        own = own.select("query_id", "vector", F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
        held = items.join(sizes, "cell").select("item_id", "vector", "cell", F.pmod(F.xxhash64("item_id"), F.col("n")).cast("int").alias("part"))

        def ranked(left, right):
            if not len(left) or not len(right):
                return pa.table({"query_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            x, ids, out = matrix(right["vector"]), right["item_id"].to_numpy(), []
            for at in range(0, len(left), BLOCK):
                b = left.slice(at, BLOCK)
                for query, q in zip(b["query_id"].to_pylist(), matrix(b["vector"]), strict=True):
                    d = np.sqrt(((x - q) ** 2).sum(1))
                    best = np.lexsort((ids, d))[:k]
                    out.append((np.full(len(best), query), ids[best], d[best]))
            return pa.table(dict(zip(("query_id", "item_id", "distance"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

        found = own.groupBy("c", "p").cogroup(held.groupBy("cell", "part")).applyInArrow(ranked, "query_id long, item_id long, distance double")
        return top(found, ["query_id"], [F.col("distance").asc(), F.col("item_id").asc()], k, "position")
