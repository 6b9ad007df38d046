"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing:

    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w | h) = (c(hw) + K P(w | h')) / (c(h) + K)

so every seen history h is a state, every seen hw an arc of weight log P(w | h), and every state has a failure
arc of weight log K / (c(h) + K) to the state of the shorter history h'.  One traversal from left to right
carries the state: a token without an arc follows failure arcs until there is one, and what is passed adds up.

No task ever holds the whole model.  Documents are packed in blocks of bounded size.  A block sends each
distinct n-gram once, with its training count, to the range of the key space that owns it; ranges add up the
counts and answer each block's n-grams in the order sent; the block turns the answers into the part of the automaton
that its documents can reach and follows it.  A frequent n-gram costs one entry a block, so no range is hot.
All counts cover all training documents; nothing is pruned or sampled.

Defined results: null and empty texts are one end token; a null id counts as training (its remainder is taken as 0);
rows that repeat a doc_id are counted and scored separately; without training tokens all words are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PRIME, WordHash, as_bytes, crc_mod, keep, mix, table

ORDER = 2
#: Pseudo-count of the shorter history.
WEIGHT = 3.0
#: Text bytes of one block, and n-grams of one range.
BLOCK = 8 << 20
RANGE = 1_500_000
END, BEGIN = np.uint64(0x0E0D), np.uint64(0xBE61)


def packed(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of documents: block, ids, held_out, lengths and the texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze, block, rows, total = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            ids, held, texts = zip(*rows, strict=True)
            body = squeeze.compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(held)], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([body], pa.binary())], names=["block", "ids", "held", "sizes", "body"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(row)
                total += len(row[2])
                if total >= size:
                    yield out()
                    block, rows, total = block + 1, [], 0
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), "_held", as_bytes("text")).mapInArrow(run, "block long, ids array<long>, held array<boolean>, sizes array<long>, body binary")


class Block:
    """The tokens of a block's documents and the keys of their n-grams."""

    def __init__(self, sizes, body: bytes, order: int):
        text, at, cache, tokens, ends = zstandard.ZstdDecompressor().decompress(body, max(1, sum(sizes))), 0, WordHash(), [], []
        for size in sizes:
            w = cache.array(text[at : at + size].translate(LOWER).split())
            tokens += [mix(w) | np.uint64(1), np.array([END])]
            ends.append(len(w) + 1)
            at += size
        self.tokens = np.concatenate(tokens)
        self.counts = np.array(ends)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        self.doc = np.repeat(np.arange(len(ends)), self.counts)
        self.keys = [self.tokens]
        for k in range(2, order + 1):
            key = self.tokens.copy()
            for back in range(1, k):
                before = np.concatenate((np.full(back, BEGIN), self.tokens[:-back]))[: len(key)]
                before[self.place() < back] = BEGIN
                key = key * PRIME + before
            self.keys.append(mix(key + np.uint64(k)))

    def place(self) -> np.ndarray:
        """Position of every token in its document."""
        return np.arange(len(self.tokens)) - np.repeat(self.starts, self.counts)


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of the key space each key belongs to."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def sent_keys(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, level, block, keys, counts): a block's distinct n-grams in key order, cut by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, held, sizes, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Block(sizes, body, order)
                train = ~np.array(held, bool)[x.doc]
                for level, keys in enumerate(x.keys):
                    own, inverse = np.unique(keys, return_inverse=True)
                    counts = np.bincount(inverse, weights=train, minlength=len(own)).astype(np.uint32)
                    at, cuts = np.unique(ranges(own, parts), return_index=True)
                    cuts = [slice(i, j) for i, j in zip(cuts, [*cuts[1:], len(own)], strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(at, pa.int32()), pa.array([level] * len(at), pa.int32()), pa.array([block] * len(at), pa.int64()),
                        pa.array([own[c].tobytes() for c in cuts], pa.binary()), pa.array([counts[c].tobytes() for c in cuts], pa.binary()),
                    ], names=["part", "level", "block", "keys", "counts"])

    return blocks.select("block", "held", "sizes", "body").mapInArrow(run, "part int, level int, block long, keys binary, counts binary")


def answers(sent: DataFrame) -> DataFrame:
    """Total counts of the keys, row by row as sent; types and tokens of the range on its first row."""

    def run(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(c, np.uint32) for c in t.column("counts").to_pylist()]))
        squeeze, cuts = zstandard.ZstdCompressor(1), np.cumsum([len(k) for k in keys])[:-1]
        # Four bytes a count, eight in ranges where a total is larger.
        width = 4 if total.max(initial=0) < 1 << 32 else 8
        back = [squeeze.compress(x.tobytes()) for x in np.split(total.astype(f"u{width}")[inverse], cuts)]
        first = np.arange(len(keys)) == 0
        return pa.table({"part": t.column("part"), "level": t.column("level"), "block": t.column("block"), "width": pa.array([width] * len(keys), pa.int32()), "totals": pa.array(back, pa.binary()), "types": pa.array((first * (total > 0).sum()).astype(np.int64)), "tokens": pa.array((first * total.sum()).astype(np.int64))})

    return sent.groupBy("part", "level").applyInArrow(run, "part int, level int, block long, width int, totals binary, types long, tokens long")


class Automaton:
    """The part of the model that a block's documents can reach.

    State 0 is the empty history, states 1 to order - 1 are the starts of documents (that many begin marks); then come the
    seen n-grams of the block, shorter ones first.  ``arcs`` are the sorted numbers state * words + word; those of state 0
    are ``base``, as every word has one.
    """

    def __init__(self, x: Block, totals: list[np.ndarray], docs: int, tokens: int, types: int, weight: float):
        order = len(x.keys)
        starts = x.place() == 0
        ids, first = zip(*(np.unique(k, return_index=True, return_inverse=True)[:0:-1] for k in x.keys), strict=True)
        counts = [c.astype(np.float64) for c in totals]
        self.word, self.words, self.known = ids[0], len(counts[0]), counts[0] > 0
        p = (counts[0] + 0.5) / (tokens + 0.5 * (types + 1))
        self.base = np.log10(p)
        # Numbers of the states of every n-gram up to order - 1 words; 0 where it was never seen.
        state, n = [], order
        for c in counts[: order - 1]:
            own = np.zeros(len(c), np.int64)
            own[c > 0] = n + np.arange(np.count_nonzero(c))
            n += np.count_nonzero(c)
            state.append(own)
        self.fail, self.fail_weight = np.zeros(n, np.int64), np.zeros(n)
        marks = np.arange(1, order)
        self.fail[marks], self.fail_weight[marks] = marks - 1, np.log10(weight / (docs + weight))
        self.begin = order - 1 if docs else 0
        for k, own in enumerate(state):
            seen = own > 0
            if k:
                self.fail[own[seen]] = state[k - 1][ids[k - 1][first[k][seen]]]
            self.fail_weight[own[seen]] = np.log10(weight / (counts[k][seen] + weight))
        self.after = state[0] if state else np.zeros(self.words, np.int64)
        arcs, weights, targets = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        for k in range(1, order):
            at = first[k]
            before = ids[k - 1][at - 1]
            left = np.where(starts[at], docs, counts[k - 1][before])
            lower = p[ids[k - 1][at]]
            p = np.where(left > 0, (counts[k] + weight * lower) / (left + weight), lower)
            seen = counts[k] > 0
            source = np.where(starts[at], k, state[k - 1][before])
            # After an arc of the longest histories the oldest word is forgotten.
            target = state[k] if k < order - 1 else state[k - 1][ids[k - 1][at]]
            arcs.append((source * self.words + self.word[at])[seen])
            weights.append(np.log10(p[seen]))
            targets.append(target[seen])
        arcs = np.concatenate(arcs)
        by = np.argsort(arcs)
        self.arcs, self.weight, self.target = arcs[by], np.concatenate(weights)[by], np.concatenate(targets)[by]

    def follow(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probabilities of documents, all of them one token further each round."""
        longest = np.argsort(-counts, kind="stable")
        starts, counts = starts[longest], counts[longest]
        state, total = np.full(len(starts), self.begin), np.zeros(len(starts))
        alive = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")
        for t, n in enumerate(alive.tolist()):
            word, now = self.word[starts[:n] + t], state[:n]
            open_ = np.flatnonzero(now)
            while len(open_) and len(self.arcs):
                arc = now[open_] * self.words + word[open_]
                at = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
                hit = self.arcs[at] == arc
                took, at, rest = open_[hit], at[hit], open_[~hit]
                total[took] += self.weight[at]
                now[took] = -self.target[at] - 1
                total[rest] += self.fail_weight[now[rest]]
                now[rest] = self.fail[now[rest]]
                open_ = rest[now[rest] > 0]
            # States taken by an arc wait as negative numbers; the others are at the empty history.
            empty = np.flatnonzero(now == 0)
            total[empty] += self.base[word[empty]]
            now[empty] = -self.after[word[empty]] - 1
            state[:n] = -now - 1
        out = np.empty(len(total))
        out[longest] = total
        return out


def followed(x: Block, totals: list[np.ndarray], docs: int, tokens: int, types: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: known tokens, unigram and model log10 probabilities; ``totals[k]``: counts of the block's sorted n-grams."""
    a = Automaton(x, totals, docs, tokens, types, weight)
    return *(np.add.reduceat(v[a.word], x.starts) for v in (a.known, a.base)), a.follow(x.starts, x.counts)


def scores(docs: DataFrame, held_out, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``held_out``: rows not learned from."""
    spark = docs.sparkSession
    blocks = keep(packed(docs.select("doc_id", "text", held_out.alias("_held"))), "blocks")
    volume = blocks.select(F.explode("sizes").alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0)), F.count("*")).first()
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (volume[0] / 6 + volume[1]) // RANGE + 1))
    back = keep(answers(sent_keys(blocks, order, parts)), "answers")
    stats = back.filter("level = 0").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    train_docs = blocks.select(F.explode("held").alias("h")).agg(F.count_if(~F.col("h"))).first()[0]
    types, tokens = int(stats[0]), int(stats[1])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        for level, *row in zip(*(right.column(c).to_pylist() for c in ("level", "part", "width", "totals")), strict=True):
            found.setdefault(level, []).append(row)
        squeeze = zstandard.ZstdDecompressor()
        totals = [np.concatenate([np.frombuffer(squeeze.decompress(b), f"u{width}") for _, width, b in sorted(found[k])]) for k in range(order)]
        ids, held, sizes, body = (left.column(c).to_pylist()[0] for c in ("ids", "held", "sizes", "body"))
        x = Block(sizes, body, order)
        known, base, score = followed(x, totals, train_docs, tokens, types, weight)
        n = len(ids)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(x.counts.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(back.select("block", "level", "part", "width", "totals").groupBy("block")).applyInArrow(run, schema)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, crc_mod("doc_id", 5) == 1)
