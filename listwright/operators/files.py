"""Searches over file metadata and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_files(files: DataFrame, name_glob: str = "*", content: str = "", extensions: list[str] | None = None, limit: int = 50, around: int = 60) -> DataFrame:
    """path, snippet of ``files`` (path, content): glob on the name, extensions, content without case."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in name_glob) + "$"
    own = files.filter(name.rlike("(?i)" + pattern))
    if extensions:
        own = own.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))
    at = F.locate(content.lower(), F.lower("content")) if content else F.lit(1)
    own = own.withColumn("_at", at).filter("_at > 0")
    snippet = F.substring(F.col("content"), F.greatest(F.lit(1), F.col("_at") - around), F.lit(2 * around + len(content))) if content else F.lit("")
    return own.orderBy("path").limit(limit).select("path", snippet.alias("snippet"))


def search_drive(files: DataFrame, query: str, folder: str | None = None, kind: str | None = None, limit: int = 30) -> DataFrame:
    """Content or name contains the query, within a folder and type; newest first.  The clauses are grouped."""
    hit = F.col("content").contains(query) | F.col("name").contains(query)
    if folder:
        hit = hit & (F.col("folder_id") == folder)
    if kind:
        hit = hit & (F.col("mime_type") == kind)
    return files.filter(hit).orderBy(F.col("modified_at").desc(), "name").limit(min(100, limit))


def listed(entries: DataFrame, sort_by: str = "name") -> DataFrame:
    """Folder listing: folders first by name, or by size or time."""
    order = {"size": [F.col("size").desc_nulls_last(), F.col("name")], "modified": [F.col("modified_at").desc_nulls_last(), F.col("name")]}.get(sort_by, [F.col("is_dir").desc(), F.lower("name"), F.col("name")])
    return entries.orderBy(*order)


def folder_counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count_if("is_dir").alias("folders"), F.count_if(~F.col("is_dir")).alias("files"))


def analysis_files(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("name").contains("anal"))
