"""Token counts of a unigram model by dynamic programming shared along a trie.

Distinct pre-tokens (a word mark, then the word) are inserted in a trie that a task keeps from batch to batch.  Each
node holds the best forward score of its prefix and the number of pieces that reach it, computed when the node is made,
so once however many pre-tokens share the prefix: pieces that end at the node are found by walking towards the root
along a trie of reversed pieces until an edge is missing.  Terminal counts are stored and looked up per occurrence.

The vocabulary comes from a public tokenizer's file, a parameter (a limit of this operator: at most MOST_PIECES
pieces).  Scores of a unigram file are taken as they are.  A merge-ranked file has ranks only; its pieces
have log-probabilities of a Zipf law over the ranks, as tokenizers are not trained here.  A character in
no piece costs its UTF-8 bytes, one token each, at the floor score.  Ties take the fewer tokens.

Defined results: null and empty texts have no tokens; rows that repeat a doc_id are counted separately.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Largest vocabulary that is sent to the tasks, in pieces.
MOST_PIECES = 1_000_000
#: Nodes of a task's trie; beyond them it starts anew.
NODES = 1_500_000


def vocabulary(path: str = MODEL) -> dict[str, float]:
    """Pieces and log-probabilities; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if len(names) > MOST_PIECES:
        raise ValueError(f"{len(names)} pieces; at most {MOST_PIECES} are sent to tasks")
    scores = [sp.get_score(sp.piece_to_id(p)) for p in names]
    if any(s != round(s) for s in scores):
        return dict(zip(names, scores, strict=True))
    total = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(names)}


class TrieCounter:
    """Best token counts of pre-tokens, prefix by prefix."""

    def __init__(self, pieces: dict[str, float]):
        self.floor = min(pieces.values(), default=-20.0) - 5.0
        # Reversed pieces: a node is (edges, score of the piece that ends here or None).
        self.ends: list = [{}, None]
        for piece, score in pieces.items():
            node = self.ends
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        self.clear()

    def clear(self) -> None:
        self.edges: dict[tuple[int, str], int] = {}
        self.up, self.char, self.score, self.taken = [0], [""], [0.0], [0]
        self.counts: dict[str, int] = {}

    def grown(self, parent: int, c: str) -> int:
        """A new node: the best way to its prefix over all pieces that end here."""
        up, char, scores, taken = self.up, self.char, self.score, self.taken
        size = len(c.encode("utf-8", "replace"))
        best, n = scores[parent] + self.floor * size, taken[parent] + size
        node, at, symbol = self.ends, parent, c
        while (node := node[0].get(symbol)) is not None:
            if (p := node[1]) is not None:
                s, t = scores[at] + p, taken[at] + 1
                if s > best or (s == best and t < n):
                    best, n = s, t
            if not at:
                break
            symbol, at = char[at], up[at]
        up.append(parent)
        char.append(c)
        scores.append(best)
        taken.append(n)
        made = self.edges[parent, c] = len(up) - 1
        return made

    def insert(self, words: set[str]) -> None:
        edges = self.edges
        for word in words:
            at = 0
            for c in word:
                at = edges.get((at, c)) or self.grown(at, c)
            self.counts[word] = self.taken[at]


def token_counts(docs: DataFrame, path: str = MODEL, step: int = 256) -> DataFrame:
    """doc_id, n_words, n_tokens, n_single (words that are one token)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        import pyarrow as pa

        counter = TrieCounter(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                words = [[MARK + w.decode("utf-8", "replace") for w in t.split()] for t in part.column(1).to_pylist()]
                if len(counter.up) > NODES:
                    counter.clear()
                counter.insert({w for ws in words for w in ws if w not in counter.counts})
                counts = [np.fromiter(map(counter.counts.__getitem__, ws), np.int64, len(ws)) for ws in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(c) for c in counts], pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([int((c == 1).sum()) for c in counts], pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_single"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_single long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
