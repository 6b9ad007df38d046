"""Table functions for SQL: ``SELECT * FROM elements(TABLE(pages))``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..sources.html import parse

ELEMENTS = "page_id bigint, idx int, parent int, tag string, attrs map<string,string>, text string"
#: Pages parsed before their elements are handed on.
STEP = 64
_SCHEMA = pa.schema([("page_id", pa.int64()), ("idx", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


class Elements:
    """The elements of pages (page_id, html), one row each, in document order within a page; other columns are ignored."""

    def eval(self, pages: pa.RecordBatch):
        ids, texts = pages.column("page_id"), pages.column("html")
        for at in range(0, pages.num_rows, STEP):
            found = [(page.as_py(), e) for page, text in zip(ids.slice(at, STEP), texts.slice(at, STEP), strict=True) for e in parse(text.as_py())]
            columns = [[page for page, _ in found], *([e[k] for _, e in found] for k in ("idx", "parent", "tag")), [list(e["attrs"].items()) for _, e in found], [e["text"] for _, e in found]]
            yield pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("elements", arrow_udtf(Elements, returnType=ELEMENTS))
