"""Near-duplicate classes by SetSketch registers, banding, joint likelihood and exact checks.

1. Every document's set of five-word shingles is digested; documents of one set form a class, and one row
   a class goes on, so thousands of copies cost one row each and no pairs.
2. A class gets 250 SetSketch registers: exponentially spaced, truncated minima of hashed
   exponentials.  Unions merge by the register-wise maximum.  Fifty bands of five registers give candidate buckets.
3. In each bucket the smallest id is the pivot; members are compared with it only.  Register pairs give a
   joint maximum-likelihood similarity; pairs clearly below the threshold (six standard errors) stop
   here, the rest are compared on full sets.
4. Links give components.  For documents in buckets that still hold several, shingles are counted by how many
   documents and components hold them.  Documents with too few shingles of other components leave.  The rest
   meet where they share a rare shingle (held by at most 100), or in their bucket if common shingles alone could
   make a link: first the most typical member, then each other.  Common shingles are counted in parts by their
   hash; the smaller counts of all parts, added up, bound what two documents have in common, and pairs below
   the overlap asked for are never emitted.  All bounds are exact, so a link that could join two components is
   not lost to the star shape.

A pair at similarity 0.75 shares a band with probability 1 - 1e-6 (closer pairs: more).

Defined results: null or wordless texts have size 0 and stay alone; rows with a null doc_id stay alone with a
null component; rows that repeat a doc_id share a component and are expected to repeat the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, maybe
from .common import LOWER, Scratch, WordHash, as_bytes, keep, map_rows, mix, ngram_hashes, table
from .graph import components

WORDS = 5
REGISTERS, BAND = 250, 5
#: SetSketch parameters: base, rate, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
THRESHOLD = 75
#: Documents that may hold a shingle that counts as rare.
RARE = 100
#: Parts by hash in which common shingles are counted.
PARTS = 64

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BANDS = REGISTERS // BAND


def shingles(text: bytes, cache: WordHash, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(ngram_hashes(cache.array(text.translate(LOWER).split()), words))


def registers(found: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes.

    Register i holds floor(1 - log_b(x)) of the smallest of the elements' exponentials x,
    truncated to 0..TOP+1; the smallest exponential belongs to the largest hashed uniform.
    """
    best = np.zeros(REGISTERS, np.uint64)
    for at in range(0, len(found), 256):
        np.maximum(best, (found[at : at + 256, None] * _MULTIPLIERS).max(0), out=best)
    x = -np.log1p(-((~best).astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    out = np.arange(1, _BANDS + 1, dtype=np.uint64)
    for col in regs.reshape(_BANDS, BAND).T.astype(np.uint64):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + col)
    return out.view(np.int64)


GRID = np.linspace(0.0, 1.0, 201)


def joint_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register pairs and known set sizes."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = GRID[None, :] * most

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    hi, lo = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    like = up[:, None] * np.log(hi) + down[:, None] * np.log(lo) + same[:, None] * np.log(np.clip(1 - hi - lo, 1e-12, 1))
    return j[np.arange(len(j)), like.argmax(1)]


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest, registers and bands of every row; nulls for empty sets."""

    def make():
        cache = WordHash()

        def one(doc_id, text):
            found = shingles(text, cache, words)
            if not len(found):
                return doc_id, 0, None, None, None
            r = registers(found)
            return doc_id, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), r.tobytes(), bands(r)

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), as_bytes("text")), make, "doc_id long, n_shingles long, digest binary, regs binary, bands array<long>", step=256)


def estimated(pairs: DataFrame, classes: DataFrame, margin: float) -> DataFrame:
    """(a, b) with the joint estimate ``est`` and whether it may reach the threshold."""
    regs = classes.select("rep", "regs", "n")
    both = pairs.join(regs.toDF("a", "ra", "na"), "a").join(regs.toDF("b", "rb", "nb"), "b").select("a", "b", "ra", "rb", "na", "nb")

    def run(batches):
        for x in batches:
            for at in range(0, x.num_rows, 1024):
                s = x.slice(at, 1024)
                ra, rb = (np.frombuffer(b"".join(s.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                est = joint_similarity(ra, rb, *(s.column(i).to_numpy().astype(float) for i in (4, 5)))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(est)], names=["a", "b", "est"])

    return both.mapInArrow(run, "a long, b long, est double").withColumn("may", F.col("est") >= THRESHOLD / 100 - margin)


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, inter, total) of the full sets."""
    ends = pairs.select(F.col("a").alias("_end")).unionByName(pairs.select(F.col("b").alias("_end"))).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("_end"), F.col("text").alias("_text"))
    texts = keep(maybe(own, "_end", bloom(ends, "_end")).join(ends, "_end", "left_semi"), "texts")
    both = pairs.select("a", "b").join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", as_bytes("ta"), as_bytes("tb"))

    def make():
        cache, held = WordHash(), {}

        def own(i, text):
            if (i, text) not in held:
                if len(held) > 64:
                    held.clear()
                held[i, text] = shingles(text, cache, words)
            return held[i, text]

        def one(a, b, ta, tb):
            x, y = shingles(ta, cache, words), own(b, tb)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            return a, b, inter, len(x) + len(y) - inter

        return one

    return map_rows(both, make, "a long, b long, inter long, total long", step=128)


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def opened(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(rep, n, root) of the documents in buckets that hold several components."""
    placed = rooted(buckets.select("key", "rep", "n"), roots)
    keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return placed.join(keys, "key", "left_semi").select("rep", "n", "root").distinct()


def reachable(rows: DataFrame, docs: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The documents that can have a link to another component, and their rare shingles.

    The first table is (rep, n, root, s, c, parts): ``s`` counts the shingles that also occur under another root, ``c``
    those of them that more than RARE documents hold, ``parts`` the latter by hash.  A link needs at least ``threshold`` percent of a set
    in common with the other set, so documents with a smaller ``s`` leave.  Of two linked documents either both have
    ``c`` as large as the overlap asked for, or they share a rare shingle; the second table, (h, rep, n, root, s),
    lets these meet, at most RARE to a shingle.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(rows, "open")

    def run(batches):
        cache = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t, cache, words) for t in part.column(2).to_pylist()]
                times = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *(pa.array(np.repeat(part.column(i).to_numpy(), times)) for i in (0, 1))], names=["h", "rep", "root"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), as_bytes("text").alias("t"))
    # Kept first: the filter and the next step in one task would need two Python workers at a time.
    texts = scratch.keep(maybe(texts, "rep", bloom(rows, "rep")).join(rows, "rep").select("rep", "root", "t"), "open_texts")
    held = scratch.keep(texts.mapInArrow(run, "h long, rep long, root long"), "shingles")
    scratch.drop("open_texts")
    shared = held.groupBy("h").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h", "df")
    held = scratch.keep(held.select("h", "rep").join(shared, "h"), "shared")
    scratch.drop("shingles")
    by_part = held.groupBy("rep", F.pmod("h", F.lit(PARTS)).cast("int").alias("part")).agg(F.count("*").alias("s"), F.count_if(F.col("df") > RARE).alias("c"))
    counted = by_part.groupBy("rep").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("part", "c"))).alias("of"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.element_at("of", i), F.lit(0)).cast("int"))
    live = scratch.keep(rows.join(counted, "rep").filter(F.col("s") * 100 >= F.col("n") * threshold).withColumn("parts", parts).drop("of"), "live")
    scratch.drop("open")
    return live, held.filter(F.col("df") <= RARE).select("h", "rep").join(live.drop("c", "parts"), "rep")


def meeting(rows: DataFrame, key: str, most: str, threshold: int) -> DataFrame:
    """(a, b) of one ``key`` and different roots, where ``most`` common shingles, in all and by parts, allow a link."""
    a, b = rows.alias("a"), rows.alias("b")
    asked = (F.col("a.n") + F.col("b.n")) * threshold
    fits = F.least(f"a.{most}", f"b.{most}") * (100 + threshold) >= asked
    if "parts" in rows.columns:
        fits &= F.aggregate(F.zip_with("a.parts", "b.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y) * (100 + threshold) >= asked
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rep") > F.col("b.rep")) & (F.col("a.root") != F.col("b.root")) & fits)
    return both.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))


def near_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    prof = keep(profiles(docs, words), "profiles")
    member = prof.select("doc_id", "n_shingles", "digest")
    whole = prof.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = keep(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "regs", "bands"), "doc_id").alias("x")).select("digest", "rep", F.col("x.n_shingles").alias("n"), "x.regs", "x.bands"), "classes")
    margin = 6 * (threshold / 100 * (1 - threshold / 100) / REGISTERS) ** 0.5

    rows = classes.select(F.explode("bands").alias("key"), "rep", "n")
    pivots = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    buckets = keep(rows.join(pivots, "key"), "buckets")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * threshold
    sizes = classes.select(F.col("rep").alias("pivot"), F.col("n").alias("m"))
    star = buckets.filter("rep <> pivot").select("rep", "pivot", "n").distinct().join(sizes, "pivot").filter(fits).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))

    est = keep(estimated(star, classes, margin), "estimates")
    exact = keep(verified(est.filter("may"), docs, words), "verified")
    is_link = F.col("inter") * 100 >= F.col("total") * threshold
    links = exact.filter(is_link).select("a", "b")
    roots = keep(components(links), "roots")

    # What the stars leave: buckets with several components, and in them the documents that can still be linked.
    live, rare = reachable(opened(buckets, roots), docs, words, threshold)
    tried = est.select("a", "b")
    dense = keep(buckets.select("key", "rep").join(live.filter(F.col("c") * 100 >= F.col("n") * threshold), "rep"), "dense")
    typical = dense.groupBy("key").agg(F.min_by(F.struct("rep", "root"), F.struct(1 - F.col("c") / F.col("n"), "rep")).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.root").alias("pivot_root"))
    first = dense.join(typical, "key").filter(F.col("root") != F.col("pivot_root")).select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b"))
    for pairs in (lambda: first.unionByName(meeting(rare, "h", "s", threshold)), lambda: meeting(rooted(dense.drop("root"), roots), "key", "c", threshold)):
        more = keep(estimated(pairs().distinct().join(tried, ["a", "b"], "left_anti"), classes, margin), "estimates")
        found = keep(verified(more.filter("may"), docs, words).filter(is_link).select("a", "b"), "links")
        tried = tried.unionByName(more.select("a", "b"))
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = keep(components(links), "roots")

    ids = classes.select("digest", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("_root"))
    out = member.join(ids, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row a component stays: its smallest doc_id.  All columns as they are; rows with a null id stay."""
    drop = near_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op6_minhash_setsketch(spark, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
