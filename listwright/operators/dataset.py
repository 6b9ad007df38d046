"""Instruction datasets: normalise records of several schemas, filter, split, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "instruction string, input string, output string, messages array<struct<role:string,content:string>>, question string, answer string, text string"


def read_jsonl(lines: DataFrame) -> DataFrame:
    """``lines``: value.  Malformed lines are counted by their null record and left out of ``normalized``."""
    return lines.filter(F.trim("value") != "").select("value", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNotNull().alias("valid"))


def normalized(records: DataFrame) -> DataFrame:
    """instruction, input, output by the first schema that fits: direct, chat, question, long text."""
    r = F.col("r")
    said = lambda role: F.try_element_at(F.filter(r["messages"], lambda m: m["role"] == role), F.lit(1))["content"]
    make = lambda i, n, o: F.struct(F.trim(i).alias("instruction"), F.trim(n).alias("input"), F.trim(o).alias("output"))
    empty, text = F.lit(""), F.trim(r["text"])
    best = F.coalesce(
        F.when(r["instruction"].isNotNull() & r["output"].isNotNull(), make(r["instruction"], F.coalesce(r["input"], empty), r["output"])),
        F.when(said("user").isNotNull() & said("assistant").isNotNull(), make(said("user"), empty, said("assistant"))),
        F.when(r["question"].isNotNull() & r["answer"].isNotNull(), make(r["question"], empty, r["answer"])),
        F.when(F.length(text) > 100, F.struct(F.lit("Pokračuj v textu:").alias("instruction"), F.left(text, F.lit(200)).alias("input"), F.substring(text, 201, 1 << 30).alias("output"))),
    )
    return records.filter("valid").select(best.alias("b")).filter("b IS NOT NULL").select("b.*")


def reasons(rows: DataFrame, shortest: int = 20, longest: int = 2000) -> DataFrame:
    n = F.length("output")
    return rows.withColumn("reason", F.when(F.trim("instruction") == "", "empty_instruction").when(n < shortest, "too_short").when(n > longest, "too_long").otherwise("ok"))


def kept(rows: DataFrame, **limits) -> DataFrame:
    return reasons(rows, **limits).filter("reason = 'ok'").drop("reason")


def reason_counts(rows: DataFrame, **limits) -> DataFrame:
    return reasons(rows, **limits).groupBy("reason").agg(F.count("*").alias("n"))


def shuffled(rows: DataFrame, seed: int = 42, limit: int | None = None) -> DataFrame:
    """A repeatable order by a seeded hash of the row; ``limit`` samples without replacement."""
    own = rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)
    return own.limit(limit) if limit else own


def split(rows: DataFrame, share: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, eval); a share of 0 leaves eval empty.

    A hash of the row decides, so neither partitions nor retries move it, and equal rows stay together.
    """
    if share <= 0:
        return rows, rows.limit(0)
    row = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    held = F.conv(F.substring(F.md5(row.cast("binary")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    return rows.filter(~held), rows.filter(held)


def as_jsonl(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("instruction", "input", "output")).alias("value"))
