"""The paged feed: pages written from all conversations come back whole, by batch and by stream."""

import json
from collections import Counter

from pyspark.sql import functions as F

from listwright.plans.views import view
from listwright.shared import fresh_folder
from listwright.sources.payloads import JsonPages


def test_pages_of_conversations(spark, sf, tmp_path):
    spark.dataSource.register(JsonPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    items = [r.asDict() for r in view(spark, sf, "conversations").orderBy("conv_id", "turn").collect()]
    size = 7

    def write(n):
        for page in range(1, -(-n // size) + 1):
            (tmp_path / f"{page}.json").write_text(json.dumps({"total": n, "items": items[(page - 1) * size : min(n, page * size)]}))

    def seen(df):
        return Counter(tuple(sorted(json.loads(r.item).items())) for r in df.collect())

    whole = Counter(tuple(sorted(x.items())) for x in items)
    first = len(items) - 10
    write(first)
    pages = spark.read.format("json_pages").options(path=str(tmp_path), per_page=size, group=3).load()
    assert seen(pages) == Counter(tuple(sorted(x.items())) for x in items[:first])
    assert pages.rdd.getNumPartitions() == -(-(-(-first // size)) // 3)

    root = fresh_folder(spark, "tests")

    def run():
        stream = spark.readStream.format("json_pages").options(path=str(tmp_path), per_page=size, group=3).load()
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()

    run()
    write(len(items))  # the last page fills up, others follow
    run()
    run()
    assert seen(spark.read.parquet(f"{root}/out")) == whole
    pages = spark.read.format("json_pages").options(path=f"file://{tmp_path}", per_page=size, group=3).load()
    assert seen(pages) == whole
    some = pages.filter((F.col("page") > 2) & (F.col("page") <= 5))
    assert seen(some) == Counter(tuple(sorted(x.items())) for x in items[2 * size : 5 * size]) and some.rdd.getNumPartitions() == 1
    (tmp_path / "1.json").write_text("{broken")
    assert spark.read.format("json_pages").options(path=str(tmp_path), per_page=size).load().count() == 0
