"""The pipeline's stages against brute force on its own inputs."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as cp
import pytest
from listwright.llm import mixing
from pyspark.sql import functions as F

from .test_operators import decontamination_expected, lines_expected, near_expected


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    first = cp.toxicity(spark, docs, sf)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in first.collect()}
    assert first.columns == columns
    assert all(i in kept for i, t in labels.items() if not t)
    assert any(i not in kept for i, t in labels.items() if t)

    second = cp.line_dedup(spark, first, sf).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    gone = {k[0]: k[2] for k in lines_expected(rows)}
    assert second.columns == columns and {r.doc_id: len((r.text or "").split("\n")) for r in second.collect()} == {i: len((t or "").split("\n")) - gone[i] if len((t or "").split("\n")) > gone[i] else 1 for i, t in rows}

    third = cp.near_duplicates(spark, second, sf).cache()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert {r.doc_id for r in third.collect()} == {i for i, _, c in near_expected(rows) if i == c}

    fourth = cp.benchmark(spark, third, sf).cache()
    rows = [(r.doc_id, r.text) for r in third.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in fourth.collect()} == {d for d, _, hit, _ in decontamination_expected(rows, items) if not hit}

    fifth = cp.mixture(spark, fourth, sf)
    assert fifth.columns == [*columns, "copy_no", "shuffle_key"]
    copies, sources = Counter(r.doc_id for r in fifth.collect()), Counter(r.source for r in fourth.collect())
    shares = {s: mixing.TARGETS.get(s, 0.55 / len(set(sources) - set(mixing.TARGETS))) for s in sources}
    for r in fourth.collect():
        u = (int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate = shares[r.source] * sum(sources.values()) / sources[r.source]
        cdf, k = math.exp(-rate), 0
        while cdf < u:
            k += 1
            cdf += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert copies[r.doc_id] == k
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "benchmark", "mixture"]


@pytest.mark.parametrize("rows", ["some", "none"])
def test_edges(spark, sf, rows):
    """Nulls everywhere, repeated rows, empty tables, and columns whose names the stages use themselves."""
    long_line = "a line of more than forty characters, in many documents"
    data = [(1, "plain words here", "en", "src0", 3), (2, None, None, None, None), (None, "", "en", "src1", 0), (None, None, None, None, None), (1, "plain words here", "en", "src0", 3)] + [(10 + i, f"{long_line}\nown {i}", "en", None, 9) for i in range(6)]
    docs = spark.createDataFrame(data if rows == "some" else [], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "keys", "id", "own", "label", "_row", "_id", "_drop", "copy_no", "rep", "root")})
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name == "mixture":
            assert sorted(out.columns) == sorted({*docs.columns, "copy_no", "shuffle_key"})
        else:
            assert out.columns == docs.columns
        if rows == "none":
            assert out.count() == 0
        elif name != "mixture":
            ids = [r.doc_id for r in out.collect()]
            assert 2 in ids and ids.count(None) == 2


def test_toxic_documents_go(spark):
    """On enough labels to learn from (sf0.001 has eleven toxic rows): held-out rows too."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    kept = cp.toxicity(spark, docs.drop("toxic"), sf)
    docs = docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    before, after = ({r.toxic: r["count"] for r in d.groupBy("toxic").count().collect()} for d in (docs, docs.join(kept.select("doc_id"), "doc_id", "left_semi")))
    assert after.get(1, 0) < 0.25 * before[1] and after[0] > 0.99 * before[0]
