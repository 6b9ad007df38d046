"""Spelling variants by full neighbourhood generation.

1. Words are counted per task and summed by word; only those of LEAST code points and TIMES occurrences go on.
2. Each word gives its whole neighbourhood: every distinct deletion, replacement and insertion over the
   letters that the vocabulary uses.  Candidates are hashed together, a word's at a time; those that a filter over the
   vocabulary cannot hold end there, the rest go to their word in a hash join.  A candidate that is a word
   is a near word by construction, so no distance is ever computed, and the filter's errors only cost exchange.
3. A word's form is its most frequent near word if that is FACTOR times as frequent.  Chains of forms grow in
   frequency, so following them by doubling ends after a few joins.

A word has at most (2 * length + 1) * (letters + 1) candidates, however frequent it or its neighbours are, so no
join key is hot.  The filter has 16 bits a word up to FILTER bits (32 MB); beyond that it lets more candidates through.

Defined results: null and letterless texts have no words; a null doc_id counts as an empty id in the deletion of
code points; rows that repeat count each time; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, Scratch, mix, table

LEAST, TIMES, FACTOR = 6, 5, 5
#: One run in so many loses a code point.
EVERY = 199
#: Largest number of bits of the filter over the vocabulary.
FILTER = 1 << 28
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Words of a task that spells neighbourhoods: little to read, much to do.
TASK = 20_000
#: Positions of a word whose candidates are hashed at a time.
BLOCK = 1024

#: Latin-1 bytes: A-Z to a-z, a-z and U+00C0 to U+00FF as they are, all else a blank.
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)
_BACK = np.uint64(pow(int(PRIME), -1, 1 << 64))


def runs(text: str | None) -> Counter[bytes]:
    """The lower-cased runs of a text, one byte a code point."""
    return Counter((text or "").encode("latin-1", "replace").translate(RUNS).split())


def shortened(word: bytes, start: int) -> bytes:
    """``word`` without a code point if its checksum behind ``start`` asks for it."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n) over all rows of ``docs``."""

    def handed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word, n in runs(text.as_py()).items():
                    if len(word) >= least and len(word := shortened(word, start)) >= least:
                        held[word] += n
                if len(held) > HELD:
                    yield handed(held)
                    held.clear()
        yield handed(held)

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def powers(n: int) -> np.ndarray:
    out = np.full(n, PRIME)
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashed(word: bytes) -> np.uint64:
    """The sum of each letter's number times a power of PRIME by its place."""
    return (_LETTER[np.frombuffer(word, np.uint8)] * powers(len(word))).sum()


def neighbourhood(word: bytes, letters: np.ndarray):
    """Hashes of all distinct words at one edit, in parts: (hashes, cut), where ``cut(k)`` spells the k-th.

    Of equal strings one stays: of a stretch of one letter the first is deleted, and a letter goes in only
    behind others of its kind.  The sums of all letters before and behind a place give each hash in a few operations.
    """
    w, n = np.frombuffer(word, np.uint8), len(word)
    power = powers(n + 1)
    term = _LETTER[w] * power[:n]
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
    behind = before[n] - before
    gone = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    yield before[gone] + behind[gone + 1] * _BACK, lambda k: word[: gone[k]] + word[gone[k] + 1 :]
    for lo in range(0, n + 1, BLOCK):
        at, c = np.meshgrid(np.arange(lo, min(lo + BLOCK, n)), letters, indexing="ij")
        at, c = at[w[at] != c], c[w[at] != c]
        yield before[at] + behind[at + 1] + _LETTER[c] * power[at], lambda k, at=at, c=c: word[: at[k]] + bytes([c[k]]) + word[at[k] + 1 :]
        at, c = np.meshgrid(np.arange(lo, min(lo + BLOCK, n + 1)), letters, indexing="ij")
        ok = (at == n) | (w[np.minimum(at, n - 1)] != c)
        at, c = at[ok], c[ok]
        yield before[at] + behind[at] * PRIME + _LETTER[c] * power[at], lambda k, at=at, c=c: word[: at[k]] + bytes([c[k]]) + word[at[k] :]


def probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, mask = mix(hashes), np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(33)) & mask


def word_filter(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, two set by each word; the driver sees at most the filter, not the words."""

    def run(batches):
        for batch in batches:
            found = np.array([hashed(w.encode("latin-1")) for w in batch.column(0).to_pylist()], np.uint64)
            at = np.concatenate(probes(found, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["w", "b"])

    words = vocabulary.select("word").mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def candidates(vocabulary: DataFrame) -> DataFrame:
    """(word, near): of every word's neighbourhood what the filter lets through, all its near words among them."""
    spark = vocabulary.sparkSession
    letters = np.array(sorted(ord(r.c) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()), np.uint8)
    n = vocabulary.count()
    bits = 1 << min(max(20, (16 * n).bit_length()), FILTER.bit_length() - 1)
    sent = spark.sparkContext.broadcast(word_filter(vocabulary, bits))

    def run(batches):
        held = sent.value

        def may(at):
            return (held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1

        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                words, near = [], []
                for word in part.column(0).to_pylist():
                    for hashes, spell in neighbourhood(word.encode("latin-1"), letters):
                        one, two = probes(hashes, bits)
                        first = np.flatnonzero(may(one))
                        found = [spell(k).decode("latin-1") for k in first[may(two[first])].tolist()]
                        near += found
                        words += [word] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    return vocabulary.select("word").repartition(n // TASK + 1, "word").mapInArrow(run, "word string, near string")


def followed(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): the end of each word's chain of forms; ``forms`` is (word, form)."""
    now, k = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now, k = scratch.keep(now.select("word", "root").join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{k + 1}"), k + 1
        scratch.drop(f"roots{k - 1}")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.keep(word_counts(docs, least).filter(F.col("n") >= times), "vocabulary")
    known = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m"))
    pairs = candidates(vocabulary).join(known, "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = vocabulary.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= factor * F.col("n"), -F.col("best.m")))
    found = scratch.keep(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "forms")
    roots = followed(found.filter("form IS NOT NULL").select("word", "form"), scratch)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE t AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT w, n, list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))) AS b FROM r),
h AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) AS h FROM b, t),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
p AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS p FROM i),
d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM i),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM p a JOIN p b ON a.p = b.p AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.d UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.d),
g AS (SELECT word, count(*) AS n_near, min({'m': -m, 'w': near}) AS best FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.w END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n FROM v LEFT JOIN g ON g.word = v.word),
c AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM f
LEFT JOIN (SELECT c.word, c.at FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL) e ON e.word = f.word
"""
