"""Exact removal of repeated 400-byte strings by column-wise Burrows-Wheeler construction.

Building one Burrows-Wheeler transform of a whole corpus takes a pass over all of it for each symbol of
the longest document.  Here the corpus is first routed, without loss, so that all candidates for one repeat meet
in a bounded block, and the column-wise construction runs in the blocks:

1. Anchors.  Of the 113 288-byte strings inside a 400-byte window the one with the smallest hash is an
   anchor.  Equal windows have equal anchors at equal places, so every repeat shows as an anchor that occurs twice.
2. Counting.  Anchors that occur once leave.  Occurrences whose surroundings (112 bytes on both sides) are
   equal as a whole need no comparison; one of them stands for all, whether two or a million.
3. Blocks.  Different surroundings of one anchor are compared.  Each becomes a row of symbols, its left bytes,
   with the anchor and the right bytes as ending (the endings are sorted once, so only left bytes take rounds).  A
   round inserts one symbol of every row into the collection's Burrows-Wheeler transform and updates the common
   prefixes of neighbours by range minima; neighbours with a common prefix over the anchor's window length repeat.
4. An anchor with more surroundings than a block holds is first dealt by content: the 113 window offsets are cut in
   ranges, and occurrences that agree in what all windows of a range share form a group of their own; then steps 2
   and 3 again.  Groups that are still too large are cut to single offsets, where a group is one string.

A block's transform is a few megabytes and stays in memory; its segments are read and written in order, as the
published construction does with files.

Defined results: null is the empty text; texts under 400 bytes lose nothing; rows that repeat a doc_id are
documents of their own, and equal rows remove each other; null ids keep their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, maybe
from .common import Scratch, as_bytes, map_rows, mix, table

WINDOW = 400
GRAM = 288
#: Anchor positions in a window; surroundings reach one less to both sides.
PLACES = WINDOW - GRAM + 1
REACH = PLACES - 1
#: Surroundings of one anchor that one collection takes, and rows after which a collection ends at the next anchor.
ROWS = 1024
#: Window offsets of the ranges by which larger groups are dealt, level by level.
WIDTHS = (15, 1)
TEXT = ["u1", "u2"]

_TABLES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_BASES = [0x2127599BF4325C37, 0x880355F21E6D1965]


class Rolling:
    """Prefix hashes: the hash of any substring in O(1), vectorised."""

    def __init__(self, kind: int):
        self.kind, self.powers = kind, np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def room(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 1 << 16)
            base = _BASES[self.kind]
            back = pow(base, -1, 1 << 64)
            ones = np.ones(n, np.uint64)
            self.powers = np.multiply.accumulate(np.concatenate((ones[:1], np.full(n, base, np.uint64))))
            self.inverse = np.multiply.accumulate(np.concatenate((ones[:1], np.full(n, back, np.uint64))))

    def prefixes(self, text: np.ndarray) -> np.ndarray:
        self.room(len(text))
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_TABLES[self.kind][text] * self.powers[: len(text)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * self.inverse[a])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every ``width`` consecutive values, by block-wise accumulation."""
    n = len(x) - width + 1
    short = -len(x) % width
    rows = np.concatenate((x, np.full(short, x[-1]))).reshape(-1, width)
    ahead = best.accumulate(rows, 1).ravel()
    back = best.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, grams: Rolling, around: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and surroundings' hashes of a text's anchors."""
    if len(text) < WINDOW:
        return (np.empty(0, np.int64),) + (np.empty(0, np.uint64),) * 2
    data = np.frombuffer(text, np.uint8)
    sums = grams.prefixes(data)
    at = np.arange(len(text) - GRAM + 1)
    h = grams.hashes(sums, at, at + GRAM)
    low = sliding(h, PLACES, np.minimum)
    # A position is smallest in some window over it if the largest of those windows' minima is its own hash.
    edge = np.zeros(REACH, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate((edge, low, edge)), PLACES, np.maximum) == h)
    a, b = np.maximum(0, chosen - REACH), np.minimum(len(text), chosen + GRAM + REACH)
    s = around.hashes(around.prefixes(data), a, b)
    return chosen, h[chosen], mix(s + (chosen - a).astype(np.uint64) * np.uint64(1009) + (b - chosen).astype(np.uint64))


def range_minima(x: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Minima of x over (after, upto]; ``upto`` ascends."""
    cuts = np.stack((after + 1, upto + 1), 1).ravel()
    return np.minimum.reduceat(np.append(x, x[-1:]), cuts)[::2]


def collection_order(rows: np.ndarray, lengths: np.ndarray, base: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection and their common prefixes, by inserting one symbol of every row per round.

    ``rows``: symbols above 0, right-aligned; row r has ``lengths[r]`` of them and goes on with an ending.  ``base``
    ranks the rows' endings (all endings sort first), ``shared`` counts the symbols each ending has in common with the
    one before it.  The transform holds, for every suffix so far in sorted order, the symbol before it.  A round fills in
    those symbols for the newest suffixes; the place of each new suffix is the rank of its symbol (a counting
    sort of the transform), as old suffixes keep their order.  Two suffixes that meet under one symbol have one
    more in common than what follows it, which is the smallest common prefix between the two places they come from;
    that gives the values of the new suffix and of the one behind it.
    Returns row and start column of all suffixes, sorted, and the symbols in common with the suffix before.
    """
    m, width = rows.shape
    before = np.zeros(m, np.uint16)
    place = base.astype(np.int64).copy()
    row, start = np.empty(m, np.int32), np.full(m, width, np.int16)
    row[place] = np.arange(m)
    common = shared.astype(np.int16)
    for column in range(width - 1, -1, -1):
        own = np.flatnonzero(lengths >= width - column)
        if not len(own):
            break
        own = own[np.argsort(place[own])]
        source = place[own]
        before[source] = rows[own, column]
        order = np.argsort(before, kind="stable")
        # Suffixes without a symbol before them (0: rows that ended) sort first and stand for no new suffix.
        ended = len(before) - np.count_nonzero(before)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(m - ended, m - ended + len(order), dtype=np.int32)
        new = rank[source]
        n = len(before) + len(own)
        # Neighbours under the same symbol, and what they have in common.
        at = new - (m - ended)
        values = []
        for step in (-1, 1):
            beside = order[np.clip(at + step, 0, len(order) - 1)]
            known = (at + step >= 0) & (at + step < len(order)) & (before[beside] == before[source])
            low, high = (beside, source) if step < 0 else (source, beside)
            there = np.flatnonzero(known)
            value = np.zeros(len(own), np.int16)
            if len(there):
                by = there[np.argsort(high[there], kind="stable")]
                value[by] = range_minima(common, low[by], high[by]) + 1
            values.append((value, beside, known))
        old = np.ones(n, bool)
        old[new] = False
        grown = []
        for was, value in ((before, 0), (row, own), (start, column), (common, values[0][0])):
            x = np.empty(n, was.dtype)
            x[old] = was
            x[new] = value
            grown.append(x)
        before, row, start, common = grown
        value, beside, known = values[1]
        common[rank[beside[known]]] = value[known]
        if len(own) < m:
            rest = np.flatnonzero(lengths < width - column)
            place[rest] = np.flatnonzero(old)[place[rest]]
        place[own] = new
    return row, start, common


def repeats(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, origins: np.ndarray) -> list[np.ndarray]:
    """Per row, the window offsets j (left bytes in the window) that another row of its group shares.

    ``origins``: a number per row such that origin - j is the window's place in the corpus.
    """
    m = len(lefts)
    # Symbols: 1 to 256 for bytes, 0 for none.
    rows, ends = np.zeros((2, m, REACH), np.uint16)
    for i, (a, b) in enumerate(zip(lefts, rights, strict=True)):
        rows[i, REACH - len(a) :] = np.frombuffer(a, np.uint8)
        rows[i, REACH - len(a) :] += 1
        ends[i, : len(b)] = np.frombuffer(b, np.uint8)
        ends[i, : len(b)] += 1
    order = np.array(sorted(range(m), key=lambda i: (groups[i], rights[i])))
    base, shared = np.empty(m, np.int64), np.zeros(m, np.int64)
    base[order] = np.arange(m)
    # Endings of one group have the anchor and the start of their right bytes in common.
    x, y = ends[order[:-1]], ends[order[1:]]
    equal = np.logical_and.accumulate((x == y) & (x > 0), 1).sum(1)
    shared[1:] = np.where(groups[order[:-1]] == groups[order[1:]], equal + 1, 0)
    row, start, common = collection_order(rows, np.array([len(a) for a in lefts]), base, shared)
    # A window is j left bytes, the anchor (one symbol) and REACH - j right bytes.
    first = np.flatnonzero(common < PLACES)
    j = REACH - start.astype(np.int64)
    place = origins[row] - j
    lo, hi = (f.reduceat(place, first) for f in (np.minimum, np.maximum))
    found = (lo < hi)[np.cumsum(common < PLACES) - 1]
    row, j = row[found], j[found]
    by = np.argsort(row, kind="stable")
    return np.split(j[by], np.cumsum(np.bincount(row, minlength=m))[:-1])


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(a, s, u1, u2, pos) of all anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, around = Rolling(0), Rolling(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [anchors(t, grams, around) for t in part.column(2).to_pylist()]
                sizes = [len(f[0]) for f in found]
                pos, a, s = (np.concatenate([f[i] for f in found]) for i in range(3))
                names = [pa.array(np.repeat(part.column(i).to_numpy(), sizes)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), *names, pa.array(pos.astype(np.int32))], names=["a", "s", "u1", "u2", "pos"])

    return docs.select(*TEXT, as_bytes("text")).mapInArrow(run, "a long, s long, u1 long, u2 long, pos int")


def of_keys(rows: DataFrame, marks: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is (``left_semi``) or is not (``left_anti``) among ``marks`` (on, cnt: its rows).

    Keys with more than a thousandth of all marked rows would fill a task: of these there are at most a thousand, so
    they are sent to the rows; the others meet their rows in an exchange.
    """
    limit = (marks.agg(F.sum("cnt")).first()[0] or 0) / 1000
    hot, cold = F.broadcast(marks.filter(F.col("cnt") > limit).select(on)), marks.filter(F.col("cnt") <= limit).select(on)
    rest = rows.join(hot, on, "left_anti").join(cold, on, how)
    return rest if how == "left_anti" else rows.join(hot, on, "left_semi").unionByName(rest)


def surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, u1, u2, pos, left, right, cnt) for ``wanted``, the bytes beside each anchor."""
    asked = wanted.groupBy(TEXT).agg(F.collect_list(F.struct("pos", "a", "cnt")).alias("asked"))
    # Copies leave before the exchange: all of one text would meet in a task.
    own = maybe(docs.select(*TEXT, "text"), "u1", bloom(wanted, "u1")).dropDuplicates(TEXT).join(asked, TEXT)
    texts = own.select(*TEXT, as_bytes("text").alias("t"), "asked.pos", "asked.a", "asked.cnt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u1, u2, t, ps, a, cnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(ps)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([u1] * n, pa.int64()), pa.array([u2] * n, pa.int64()), pa.array(ps, pa.int32()), pa.array([t[max(0, p - REACH) : p] for p in ps], pa.binary()), pa.array([t[p + GRAM : p + GRAM + REACH] for p in ps], pa.binary()), pa.array(cnt, pa.int64())], names=["key", "u1", "u2", "pos", "left", "right", "cnt"])

    return texts.mapInArrow(run, "key long, u1 long, u2 long, pos int, left binary, right binary, cnt long")


def compared(rows: DataFrame) -> DataFrame:
    """(u1, u2, lo, hi): repeated byte ranges found in the collections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(part: list[tuple]) -> pa.RecordBatch:
            names: dict[int, int] = {}
            groups = np.array([names.setdefault(r[0], len(names)) for r in part])
            # Places in the corpus: texts far apart, positions as they are.
            docs: dict[tuple, int] = {}
            origins = np.array([(docs.setdefault(r[1:3], len(docs)) << 32) + r[3] for r in part], np.int64)
            out: list[tuple] = []
            for r, js in zip(part, repeats([r[4] for r in part], [r[5] for r in part], groups, origins), strict=True):
                if len(js):
                    starts = np.sort(r[3] - js)
                    cut = np.flatnonzero(np.diff(starts) > WINDOW)
                    lo, hi = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + WINDOW
                    out += [(r[1], r[2], a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            u1, u2, lo, hi = zip(*out, strict=True) if out else ((),) * 4
            return pa.RecordBatch.from_arrays([pa.array(u1, pa.int64()), pa.array(u2, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["u1", "u2", "lo", "hi"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Rows come sorted by group; a collection ends between groups.
                if len(held) >= ROWS and held[-1][0] != r[0]:
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    dealt = rows.repartition("key").sortWithinPartitions("key", "u1", "u2", "pos")
    return dealt.select("key", "u1", "u2", "pos", "left", "right").mapInArrow(run, "u1 long, u2 long, lo int, hi int")


def sides(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` dealt by ranges of ``width`` window offsets: key by what a range's windows share, ``whole`` by all it sees.

    A window of offset j takes the last j left bytes and the first REACH - j right bytes.
    """
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(REACH), F.lit(width))).alias("j0")).withColumn("j1", F.least(F.col("j0") + (width - 1), F.lit(REACH)))
    cut = cut.withColumn("k0", F.greatest("j0", REACH - F.length("right"))).withColumn("k1", F.least("j1", F.length("left"))).filter("k0 <= k1")

    def part(left: str, right: str) -> tuple:
        return F.expr(f"substring(left, length(left) - {left} + 1, {left})"), F.expr(f"substring(right, 1, {right})")

    core, whole = part("j0", f"({REACH} - j1)"), part("k1", f"({REACH} - k0)")
    return cut.select(F.xxhash64("key", "j0", F.lit(width), *core).alias("key"), F.xxhash64(F.lit(5), "k0", "k1", *whole).alias("whole"), "u1", "u2", "pos", whole[0].alias("left"), whole[1].alias("right"), "cnt", "k0", "k1")


def removed_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """u1, u2, spans (array of lo, hi): byte ranges to remove, before merging."""
    rows = scratch.keep(anchor_rows(docs), "anchors")
    again = scratch.keep(rows.groupBy("a").agg(F.count("*").alias("cnt")).filter("cnt > 1"), "again")
    # The filter passes some anchors that occur once; the counts below drop them.
    shared = scratch.keep(maybe(rows, "a", bloom(again, "a")), "shared")
    scratch.drop("anchors", "again")
    kinds = scratch.keep(shared.groupBy("a", "s").agg(F.count("*").alias("cnt"), *(F.first(c).alias(c) for c in ("u1", "u2", "pos"))), "kinds")
    # Whole surroundings that occur twice.
    twice = of_keys(shared, kinds.filter("cnt > 1").select("a", "s", "cnt"), ["a", "s"])
    found = [twice.select(*TEXT, (F.col("pos") - REACH).alias("lo"), (F.col("pos") + GRAM + REACH).alias("hi"))]
    # Different surroundings of one anchor, at least one of them alone.
    groups = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.min("cnt").alias("least")).filter("kinds > 1 AND least = 1").select("a", "kinds")
    groups = scratch.keep(groups, "groups")
    wanted = scratch.keep(of_keys(kinds, groups.select("a", F.col("kinds").alias("cnt")), ["a"]).select(*TEXT, "pos", "a", "cnt"), "wanted")
    large = groups.filter(F.col("kinds") > ROWS).select(F.col("a").alias("key"), F.col("kinds").alias("cnt"))
    beside = scratch.keep(surroundings(docs, wanted), "beside")
    found.append(compared(of_keys(beside, large, ["key"], "left_anti")))
    rest = of_keys(beside, large, ["key"])
    for level, width in enumerate(WIDTHS):
        if level and rest.isEmpty():
            break
        cut = scratch.keep(sides(rest, width), f"sides{level}")
        kinds = scratch.keep(cut.groupBy("key", "whole").agg(F.sum("cnt").alias("cnt")), f"kinds{level}")
        same = of_keys(cut.filter("cnt = 1"), kinds.filter("cnt > 1"), ["key", "whole"])
        found.append(same.select(*TEXT, (F.col("pos") - F.col("k1")).alias("lo"), (F.col("pos") - F.col("k0") + WINDOW).alias("hi")))
        groups = kinds.groupBy("key").agg(F.count("*").alias("cnt"), F.min("cnt").alias("least")).filter("cnt > 1 AND least = 1")
        groups = scratch.keep(groups, f"groups{level}")
        small, large = groups.filter(F.col("cnt") <= ROWS), groups.filter(F.col("cnt") > ROWS)
        found.append(compared(of_keys(cut, small, ["key"]).dropDuplicates(["key", "whole"])))
        rest = scratch.keep(of_keys(cut, large, ["key"]).dropDuplicates(["key", "whole"]), f"rest{level}")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy(TEXT).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal ranges; a range under the window length (cut by the text's ends) repeats nothing."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, s["lo"]), min(size, s["hi"])) for s in spans or ()):
        if hi - lo < WINDOW:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def cut_out(text: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, and the number of runs."""
    gone = merged(spans, len(text))
    kept, at = [], 0
    for lo, hi in gone:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]]), sum(hi - lo for lo, hi in gone), len(gone)


def deduplicated(docs: DataFrame, view=lambda kept: kept) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: ``view`` of the remaining bytes, of every row.

    A text that occurs twice goes as a whole, which needs no bytes of it; other texts that lose something
    meet their ranges in an exchange; the rest stay where they are and send a view only.
    """
    scratch = Scratch(docs.sparkSession)
    whole = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(whole).alias("u1"), F.xxhash64(F.lit(17), whole).alias("u2"), whole.alias("text"))
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    copies = scratch.keep(own.filter(size >= WINDOW).groupBy(TEXT).agg(F.count("*").alias("cnt")).filter("cnt > 1"), "copies")
    ranges = scratch.keep(removed_ranges(own, scratch), "all_ranges")
    found = scratch.keep(ranges.join(copies.select(TEXT), TEXT, "left_anti"), "ranges")
    scratch.drop(*(set(scratch.paths) - {"copies", "ranges"}))

    def make():
        def one(doc_id, text, spans):
            kept, gone, runs = cut_out(text, spans)
            return doc_id, len(text), gone, runs, kept

        return one

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    hit = maybe(own, "u1", bloom(found, "u1")).join(found, TEXT)
    cut = map_rows(hit.select("doc_id", as_bytes("text"), "spans"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", step=128).withColumn("kept", view(F.col("kept")))
    gone = of_keys(own.select("doc_id", *TEXT, size.alias("n_bytes")), copies, TEXT).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), view(F.lit(b"")).alias("kept"))
    same = own.select("doc_id", *TEXT, size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), view(F.col("text").cast("binary")).alias("kept"))
    same = of_keys(same, copies, TEXT, "left_anti").join(found.select(TEXT), TEXT, "left_anti")
    return cut.select(names).unionByName(gone.select(names)).unionByName(same.select(names))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"), lambda kept: F.sha2(kept, 256))
    return found.withColumnRenamed("kept", "kept_sha256")
