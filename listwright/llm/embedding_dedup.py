"""Near-duplicate vectors by robust-pruned flat graphs on overlapping cluster shards.

1. Equal vectors of one label form a class; one row a class goes on.
2. Labels are shards at first.  A shard of more than CAP classes is split by centres fitted on some SAMPLE of its
   classes.  A class is at home with its nearest centre and a guest with each centre whose border is within a margin,
   so a partner across a border is met at home.  Splitting goes on until shards are small or do not shrink.
3. A shard is dealt by hash into blocks of CAP classes at most, nearly always one.  For each block of queries and each
   block of the shard a task builds the latter's flat graphs: every point keeps neighbours that robust pruning leaves.
   Two orders of insertion make two graphs, for a dense group can fall into parts in one order, hardly into the same in both.
4. A point's lists from both graphs are united.  Lists never leave the task, so vectors are all that is exchanged.
5. Home classes are the queries.  A greedy search starts from
   medoids and expands lists, both ways, as long as they bring points in range.  Searches are audited against all points for AUDIT
   queries a task, and repeated with a wider beam while they find less than REACH of the links; if even WIDEST times
   the beam does not, the block's points are compared directly.  Candidates are verified by their cosine in double precision.
6. A task hands on a count per query and one edge per point with links, its union of links; components join these.

Work is per block and bounded by CAP rows; dense shards that no centre splits cost a task per pair of blocks, which is
what their links cost anyhow.  The margin of a border is exact up to MARGIN standard deviations of a
link's step across it: sqrt(2 - 2 * threshold) / sqrt(dimensions) each, and never more than the step itself.

Defined results: vectors without label, null, empty, zero or with null or non-finite components, and rows with a null
vec_id, link with nothing: n_links 0, component_id = vec_id.  Rows that repeat a vec_id are vectors of their own, with
the smallest vec_id of their component.  Vectors of different lengths are not compared.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch, map_rows, mix, table
from .flat_graph import BATCH, DEGREE, Both, build, clusters, in_range, medoids
from .graph import components

THRESHOLD = 0.93
#: Classes of a block, classes that centres are fitted on (about), centres of a split at most.
CAP, SAMPLE, CENTRES = 16384, 4096, 64
MARGIN = 2.5
#: A shard that keeps this share of its classes in a part is not split further.
SHRINKS = 0.75
#: Graphs of a block, each by another order of insertion.
ORDERS = 2
#: Queries of a task that are compared with all points, and the share of links to be found.
AUDIT, REACH = 32, 0.99
#: Beam of a search, and how many times as wide an audit may make it.
WIDTH, WIDEST = 48, 4


def units(raw: list[bytes], kind: str = "f8") -> np.ndarray:
    """Unit vectors in double precision, one a row, of components stored as ``kind``."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored_as(vectors: DataFrame) -> str:
    """Components travel in the precision they come in."""
    return "f4" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "f8"


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label as text, and for vectors that can have links their bytes and a key of label and vector."""
    kind = stored_as(vectors)

    def make():
        def one(vec_id, label, values):
            x = None if vec_id is None or label is None or not values or None in values else np.array(values, np.float64) + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                return vec_id, None, None, None, None
            raw = x.astype(kind).tobytes()
            return vec_id, label, len(x), raw, hashlib.blake2b(f"{label}:{len(x)}:".encode() + raw, digest_size=16).digest()

        return one

    return map_rows(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")), make, "vec_id long, label string, dim int, raw binary, key binary", step=2048)


def split(members: DataFrame, cap: int, sample: int, margin: float, kind: str) -> DataFrame:
    """The parts of shards: ``members`` is (shard, no, raw, copies, home, size), the same comes out with the parts' names and ``above`` = size."""
    chosen = members.filter(F.pmod(F.xxhash64(F.lit(7), "no"), F.lit(1 << 20)) * F.col("size") < F.lit(sample << 20))

    def fit(key, rows):
        x = units(rows["raw"].to_pylist(), kind)
        centres = clusters(x, min(CENTRES, max(2, -(-2 * rows["size"][0].as_py() // cap))))
        return pa.table({"shard": [key[0].as_py()], "centres": pa.array([centres.tobytes()], pa.binary()), "size": pa.array([rows["size"][0].as_py()], pa.int64())})

    centres = chosen.groupBy("shard").applyInArrow(fit, "shard string, centres binary, size long")
    salts = F.ceil(F.col("size") / cap).cast("long")
    rows = members.withColumn("salt", F.pmod(F.xxhash64(F.lit(11), "no"), salts))
    copies = centres.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))

    def assign(key, own, fitted):
        if not len(own) or not len(fitted):  # no class of a shard fell into the sample: it stays whole
            return own.select(["shard", "no", "raw", "copies", "home", "size"]).rename_columns(["shard", "no", "raw", "copies", "home", "above"])
        x = units(own["raw"].to_pylist(), kind)
        c = np.frombuffer(fitted["centres"][0].as_py(), np.float64).reshape(-1, x.shape[1])
        near = x @ c.T
        best = near.argmax(1)
        border = (near[np.arange(len(x)), best][:, None] - near) / np.maximum(np.linalg.norm(c[best][:, None] - c[None], axis=2), 1e-12)
        row, part = np.nonzero((border <= margin) | (np.arange(len(c)) == best[:, None]))
        home = own["home"].to_numpy(zero_copy_only=False)[row] & (part == best[row])
        out = own.take(pa.array(row))
        return pa.table({"shard": [f"{key[0].as_py()}/{p}" for p in part], "no": out["no"], "raw": out["raw"], "copies": out["copies"], "home": home, "above": out["size"]})

    return rows.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(assign, "shard string, no long, raw binary, copies long, home boolean, above long")


def sharded(classes: DataFrame, scratch: Scratch, cap: int, sample: int, margin: float, kind: str) -> DataFrame:
    """(shard, no, raw, copies, home, size): the members of all shards, and how many each shard has."""
    now = classes.select(F.concat_ws(":", "label", "dim").alias("shard"), "no", "raw", "copies", F.lit(True).alias("home"), F.lit(None).cast("long").alias("above"))
    done, level = None, 0
    while True:
        sizes = now.groupBy("shard").agg(F.count("*").alias("size"), F.first("above").alias("_above"))
        large = (F.col("size") > cap) & (F.col("_above").isNull() | (F.col("size") < SHRINKS * F.col("_above")))
        # A row a shard: sent to the vectors, which so are not exchanged for it.
        sizes = scratch.keep(sizes.select("shard", "size", F.coalesce(large, F.lit(False)).alias("_large")), f"sizes{level}")
        n = {r[0]: r[1] for r in sizes.groupBy("_large").count().collect()}
        now = now.drop("above").join(F.broadcast(sizes), "shard")
        if n.get(False) or not n:
            small = now.filter("NOT _large").drop("_large")
            done = small if done is None else done.unionByName(small)
        if not n.get(True):
            return done
        now, level = scratch.keep(split(now.filter("_large").drop("_large"), cap, sample, margin, kind), f"parts{level}"), level + 1
        if level > 1 and not n.get(False):
            scratch.drop(f"parts{level - 2}")


class Links:
    """Union of points by links; ``root`` of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(self.root, hi, lo)
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]
            left = self.root[a] != self.root[b]
            a, b = a[left], b[left]


def neighbours(x: np.ndarray) -> np.ndarray:
    """The united lists of all points' graphs, each neighbour once, and an empty one behind them."""
    links = np.full((len(x) + 1, ORDERS * DEGREE), -1, np.int64)
    links[:-1] = np.sort(np.hstack([build(x, seed=k) for k in range(ORDERS)]), axis=1)
    again = links[:, 1:] == links[:, :-1]
    links[:, 1:][again] = -1
    return links


def searched(tasks: DataFrame, threshold: float, width: int, kind: str) -> DataFrame:
    """no, n_found (linked vectors), root, audited, caught; for queries and for points with links."""

    def run(rows):
        number, sizes = rows["no"].to_numpy(), rows["copies"].to_numpy()
        asks, held = (rows[c].to_numpy(zero_copy_only=False) for c in ("asks", "held"))
        x, points, queries = units(rows["raw"].to_pylist(), kind), np.flatnonzero(held), np.flatnonzero(asks)
        count, union, audited, caught = np.zeros(len(number), np.int64), Links(len(number)), 0, 0
        if len(points) and len(queries):
            single = x[points].astype(np.float32)
            links = neighbours(single)
            both = Both(links, len(points))
            starts = medoids(single)
            own = np.full(len(number), -1)
            own[points] = np.arange(len(points))
            sample = np.sort(queries[np.argsort(mix(number[queries].astype(np.uint64)), kind="stable")[:AUDIT]])
            truth = [set(points[f].tolist()) - {int(q)} for q, f in zip(sample, (x[sample] @ x[points].T) >= threshold, strict=True)]

            def search(asked: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
                if wide > WIDEST * width:
                    q, p = np.nonzero(x[asked] @ x[points].T >= threshold - 1e-5)
                else:
                    q, p = in_range(single, links, both, starts, x[asked].astype(np.float32), own[asked], min(wide, len(points)), threshold - 1e-5)
                q, p = asked[q], points[p]
                ok = np.concatenate([np.einsum("id,id->i", x[q[k : k + 65536]], x[p[k : k + 65536]]) >= threshold for k in range(0, len(q), 65536)] or [np.zeros(0, bool)]) & (q != p)
                return q[ok], p[ok]

            wide, audited = width, sum(map(len, truth))
            while True:
                q, p = search(sample, wide)
                caught = len(set(zip(q.tolist(), p.tolist(), strict=True)) & {(int(s), t) for s, found in zip(sample, truth, strict=True) for t in found})
                if caught >= REACH * audited or wide > WIDEST * width:
                    break
                wide *= 2
            for lo in range(0, len(queries), BATCH):
                q, p = search(queries[lo : lo + BATCH], wide)
                np.add.at(count, q, sizes[p])
                union.add(q, p)
        root = number[union.root]
        some = asks | (root != number)
        n = int(some.sum())
        first = np.arange(n) == 0
        return pa.table({"no": number[some], "n_found": count[some], "root": root[some], "audited": np.where(first, audited, 0), "caught": np.where(first, caught, 0)})

    return tasks.groupBy("shard", "i", "j").applyInArrow(run, "no long, n_found long, root long, audited long, caught long")


def linked(vectors: DataFrame, threshold: float = THRESHOLD, cap: int = CAP, sample: int = SAMPLE, width: int = WIDTH, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """vec_id, n_links and component_id of every row; and one row of what the audits had to find and found."""
    scratch, kind = Scratch(vectors.sparkSession), stored_as(vectors)
    rows = scratch.keep(keyed(vectors), "rows")
    dims = rows.agg(F.max("dim")).first()[0] or 1
    step = (2 - 2 * threshold) ** 0.5
    one = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    classes = scratch.keep(one.withColumn("no", F.monotonically_increasing_id()), "classes")
    rows = scratch.keep(rows.select("vec_id", "key"), "keys")
    scratch.drop("rows")
    members = sharded(classes, scratch, cap, sample, min(step, margin * step / dims**0.5), kind)
    parts = F.ceil(F.col("size") / cap).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64(F.lit(13), "no"), parts).cast("int")).withColumn("parts", parts)
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    as_point = F.transform(all_parts, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), (F.col("home") & (i == F.col("block"))).alias("asks"), F.lit(True).alias("held")))
    as_query = F.transform(F.filter(all_parts, lambda j: F.col("home") & (j != F.col("block"))), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("held")))
    tasks = members.select("shard", "no", "raw", "copies", F.explode(F.concat(as_point, as_query)).alias("t")).select("shard", "t.*", "no", "raw", "copies")
    found = scratch.keep(searched(tasks, threshold, width, kind), "found")
    roots = components(found.filter("no <> root").select(F.col("no").alias("a"), F.col("root").alias("b")))
    placed = classes.select("key", "no", "copies", "rep").join(roots.withColumnRenamed("id", "no"), "no", "left").withColumn("root", F.coalesce("root", "no"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    counts = found.groupBy("no").agg(F.sum("n_found").alias("n_found"))
    of = placed.join(least, "root").join(counts, "no").select("key", (F.col("n_found") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(of, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out, found.agg(F.sum("audited").alias("audited"), F.sum("caught").alias("caught"))


def op12_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found, _ = linked(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
