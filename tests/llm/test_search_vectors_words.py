"""Ranked search, vector links and spelling variants against brute force, with their edges."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from listwright.llm import embedding_dedup, flat_graph, ranked, variants


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- ranked search


def ranking_expected(docs, items, k):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    own = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    asked = defaultdict(Counter)
    for item, t in items:
        asked[item].update(cut(t))
    out = Counter()
    for item, query in asked.items():
        scores = []
        for i, c in own:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in query.items() if c[w])
            if s > 0:
                scores.append((-s, i is not None, i))
        out.update((item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


def rows(df, *names):
    return Counter(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize(("size", "block"), [(50, 40), (1 << 19, 4 << 20)])
def test_ranking(spark, size, block):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("the THE of ab7 cé Ž9 déjà x y z w v u t s".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "- !"), (203, text(4000)), (7, "the of x"), (7, "the of x"), (None, "the of x"), (204, "the of x")]
    items = [(1, "the of of x"), (2, "Ž9 ab7"), (3, None), (4, "  "), (5, "unknown"), (None, "x y"), (1, "déjà"), (6, text(300))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "a") for i, t in items], "item_id long, text string, doc_id string")
    found = ranked.RankedIndex.of(d, size).search(q, 20, block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found, *found.columns) == ranking_expected(docs, items, 20)


def test_ranking_of_nothing(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.RankedIndex.of(d).search(q).count() == 0
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ranked.RankedIndex.of(d).search(q.limit(0)).count() == 0


def test_equal_scores_by_id_through_bounds():
    """Twenty of many equal documents: the smallest ids, though every node's bound is the same."""
    builder = ranked.Builder(500, 1000)
    for i in random.Random(1).sample(range(500), 500):
        builder.add(i, Counter([b"a", b"b"]))
    docs, n_null, _, starts, impacts, bits = builder.shard()
    best = ranked.Best(20)
    ranked.Tree(docs, n_null, starts, impacts, bits).search(np.array([0, 1]), np.array([5, 7]), best)
    assert best.ids.tolist() == list(range(20))


# --- vectors


def vectors_expected(rows, threshold):
    own = {}
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v, float) / max(map(abs, v))
            own.setdefault((label, len(v)), []).append((k, x / np.linalg.norm(x)))
    links, parent = Counter(), list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for group in own.values():
        for a, x in group:
            for b, y in group:
                if a != b and x @ y >= threshold:
                    links[a] += 1
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root(k)] = i if i is None else min(i, least.get(root(k), i))
    return Counter((i, links[k], least[root(k)]) for k, (i, _, _) in enumerate(rows))


def vectors(seed=2, groups=12, dims=16):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for label in (1, 2):
        centres = rng.normal(size=(groups, dims))
        for c in centres:
            for _ in range(int(rng.integers(1, 12))):
                out.append((k := k + 1, label, (c + rng.normal(size=dims) * 0.12).tolist()))
        for _ in range(40):
            out.append((k := k + 1, label, rng.normal(size=dims).tolist()))
    return out


EDGES = [(900, None, [1.0, 0.0]), (901, 1, None), (902, 1, []), (903, 1, [0.0] * 16), (904, 1, [1.0, None]), (905, 1, [float("nan")] * 16), (906, 1, [float("inf"), 1.0]), (907, 3, [1.0, 2.0]), (908, 3, [1.0, 2.0]), (908, 3, [1.0, 2.0]), (909, 3, [2.0, 4.0]), (910, 3, [1e200, 2e200]), (None, 3, [1.0, 2.0]), (911, 3, [1.0, 2.0, 0.0])]


@pytest.mark.parametrize(("cap", "sample"), [(4096, 4096), (60, 200), (24, 200)])
def test_vectors(spark, cap, sample):
    """Whole labels, clusters that overlap, and dense shards that are dealt into blocks."""
    data = vectors() + EDGES
    df = spark.createDataFrame([(i, label, v, 0) for i, label, v in data], "vec_id long, label int, embedding array<double>, size int").repartition(3)
    found, audit = embedding_dedup.linked(df, cap=cap, sample=sample)
    assert rows(found, "vec_id", "n_links", "component_id") == vectors_expected(data, 0.93)
    told = audit.first()
    assert told.audited > 0 and told.caught == told.audited


def test_vectors_travel_as_stored(spark):
    """Four bytes a component of floats, and a label of some thousand is one shard, whose lists stay in its task."""
    df = spark.createDataFrame([(1, 1, [0.1] * 16), (2, 1, [0.3] * 16)], "vec_id long, label int, embedding array<float>")
    assert {len(r.raw) for r in embedding_dedup.keyed(df).collect()} == {64}
    assert embedding_dedup.CAP > 4096 and not hasattr(embedding_dedup, "lists")
    found, _ = embedding_dedup.linked(df)
    assert rows(found, "vec_id", "n_links", "component_id") == Counter({(1, 1, 1): 1, (2, 1, 1): 1})


def test_no_vectors(spark):
    found, _ = embedding_dedup.linked(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert found.count() == 0


def test_graph_reaches_a_dense_group():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 32))
    x[:400] = x[0] + rng.normal(size=(400, 32)) * 0.1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    links = flat_graph.build(x)
    both = flat_graph.Both(links, len(x))
    q, p = flat_graph.in_range(x, np.vstack((links, links[:1] * 0 - 1)), both, flat_graph.medoids(x), x[:200], np.arange(200), 32, 0.93)
    true = (x[:200] @ x.T) >= 0.93
    assert len(set(zip(q.tolist(), p.tolist(), strict=True))) == len(q)
    assert true[q, p].all() and len(q) >= 0.99 * true.sum()


# --- spelling variants


def words_expected(docs, least, times, factor):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= times}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: (lambda b: b if b and n[b] >= factor * n[w] else None)(min(by[w], key=lambda v: (-n[v], v), default=None)) for w in n}
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n[w], len(by[w]), n.get(form[w])] += 1
    return out


def test_variants(spark):
    rng = random.Random(8)
    base = ["committee", "aaaaaa", "éclairs", "straße", "señora", "bookkeeper", "x" * 30]
    pool = []
    for w in base:
        pool += [w] * 200
        for _ in range(12):
            k, c = rng.randrange(len(w)), rng.choice("abcéßx")
            one = rng.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]))
            pool += [one] * rng.choice((1, 5, 7, 30))
            pool += [one[:k] + c + one[k:]] * rng.choice((3, 6))
    rng.shuffle(pool)
    sep = [" ", "\n", "1", "_", "č", "漢", " ", "'"]
    docs = [(k, "".join(w + rng.choice(sep) for w in pool[at : at + 97])) for k, at in enumerate(range(0, len(pool), 97))]
    docs += [(900, None), (901, ""), (902, "12 漢字"), (None, "Committee COMMITTEE committee"), (5, docs[5][1]), (903, "z" * 3000 + " ") , (904, ("q" * 2000 + " ") * 6), (905, ("q" * 1999 + " ") * 40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n int").repartition(3)
    found = variants.variants(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(found, *found.columns) == words_expected(docs, 6, 5, 5)


def test_no_words(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("word", ["aab", "abab", "é", "aaaa"])
def test_neighbourhood_is_full_and_distinct(word):
    letters = np.frombuffer("abé".encode("latin-1"), np.uint8)
    found = []
    for hashes, spell in variants.neighbourhood(word.encode("latin-1"), letters):
        own = [spell(k) for k in range(len(hashes))]
        assert [variants.hashed(w) for w in own] == hashes.tolist()
        found += [w.decode("latin-1") for w in own]
    want = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in "abé"} | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "abé"}
    assert sorted(found) == sorted(want - {word})
