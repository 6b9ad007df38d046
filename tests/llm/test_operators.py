"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from listwright.llm import classify, decontaminate, graph, line_dedup, lm_score, media, mixing, near_dedup, substring_dedup, tokens
from listwright.llm.common import crc_mod
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in texts], schema)


LONG_LINE = "  This Line is certainly longer than forty characters, as asked.\t"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[50] = "CHANGED"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "   \n\t"), (7, "one two"), (8, "ONE  two"), (9, "é" * 41 + "\n" + LONG_LINE), (10, words(rng, 4000))]
    out += [(20 + i, LONG_LINE + "\n" + words(rng, 30) + "\nshort") for i in range(6)]
    out += [(30 + i, words(rng, 60) + " " + base[:500] + " " + words(rng, 60)) for i in range(3)]
    return [*out, (None, LONG_LINE + "\nnull id"), (40, "same row"), (40, "same row")]


# --- line dedup


def lines_expected(texts):
    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 40 else None

    holders = {}
    for i, t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            holders.setdefault(k, set()).add(i)
    hot = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == i]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def line_rows(docs):
    from listwright.llm.common import as_bytes, map_rows

    def make():
        def one(i, t, k):
            kept, n, gone = line_dedup.kept_lines(t, line_dedup.wanted(k or ()))
            return i, n, gone, hashlib.sha256(kept).hexdigest()

        return one

    marked = line_dedup.LineDedup.of(docs).marked(docs)
    return Counter(tuple(r) for r in map_rows(marked.select("row.doc_id", as_bytes("row.text").alias("text"), "keys"), make, "i long, n long, g long, h string").collect())


def test_line_dedup(spark, texts):
    assert line_rows(frame(spark, texts)) == lines_expected(texts)


def test_line_dedup_without_filters(spark, texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    assert line_rows(frame(spark, texts)) == lines_expected(texts)


def test_line_dedup_null_ids(spark):
    """Rows without an id are one document; it owns a line only where no id holds it."""
    rows = [(None, LONG_LINE)] * 6 + [(i, LONG_LINE + "\n" + LONG_LINE) for i in range(4)] + [(9, "x" * 40)] * 7
    assert line_rows(frame(spark, rows)) == lines_expected(rows)


def filter_state(state):
    """How many entries the filters of a state have, and whether they hold exactly its frequent keys."""
    cells = {r.shard: line_dedup.CuckooFilter.load(bytes(r.cells)) for r in state.filters.collect()}
    keys = [(r.k1, r.k2, r.refs) for r in state.counts.collect()]
    for k1, k2, refs in keys:
        if refs >= state.min_docs:
            assert cells[k2 % state.shards].holds(np.array([k1]), np.array([k2])).all()
    assert sum((f.cells > 0).sum() for f in cells.values()) == sum(refs >= state.min_docs for *_, refs in keys)


def test_line_dedup_reversible(spark, texts):
    docs = frame(spark, texts)
    table = lambda s: {tuple(r) for r in s.references().collect()}
    first, second = docs.filter("doc_id < 23"), docs.filter("doc_id >= 23 OR doc_id IS NULL")
    start = line_dedup.LineDedup.of(first)
    assert start.filters.count() == 0
    whole = start.insert(second)
    assert table(whole) == table(line_dedup.LineDedup.of(docs)) and whole.filters.count() == 1
    filter_state(whole)
    fewer = whole.remove(docs.filter("doc_id >= 30 OR doc_id = 21").select("doc_id"))
    assert table(fewer) == table(line_dedup.LineDedup.of(docs.filter("(doc_id < 30 AND doc_id <> 21) OR doc_id IS NULL")))
    filter_state(fewer)
    none = fewer.remove(docs.filter("doc_id >= 20").select("doc_id"))
    filter_state(none)
    again = none.insert(docs.filter("doc_id >= 20"))
    assert table(again) == table(whole)
    filter_state(again)
    assert line_dedup.LineDedup.of(docs.limit(0)).frequent().count() == 0


def test_line_dedup_columns(spark, texts):
    docs = frame(spark, texts).withColumns({c: F.lit(1) for c in ("k1", "owner", "row", "keys", "id", "own", "new", "_drop_id", "_drop_keys")})
    out = line_dedup.LineDedup.of(docs).apply(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert LONG_LINE not in out.filter("doc_id = 20").first()["text"] and out.filter("doc_id = 25").first()["text"].startswith(LONG_LINE)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    f = line_dedup.built(k1, k2)
    assert f.holds(k1, k2).all() and line_dedup.CuckooFilter.load(f.dump()).holds(k1, k2).all()
    other = rng.integers(-(1 << 62), 1 << 62, (2, 20000))
    assert f.holds(*other).mean() < 0.01
    f.discard(k1[:2500], k2[:2500])
    assert f.holds(k1[2500:], k2[2500:]).all() and f.holds(k1[:2500], k2[:2500]).mean() < 0.01


# --- decontamination


def decontamination_expected(docs, items):
    def split(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")

    clean = lambda t: [w for w in split(t) if w]
    wins = {(str(n) if n is not None else None, tuple(w[i : i + 10])) for n, t in items for w in [clean(t)] if w for i in range(max(1, len(w) - 9))}
    out = []
    for d, t in docs:
        w, hit, names = clean(t), set(), set()
        for n, p in wins:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    names.add(n)
        out.append((d, len(w), len(hit), sorted(x for x in names if x is not None)))
    return sorted(out, key=repr)


def test_benchmark_segments():
    text = " ".join(f"w{i}" for i in range(57)).encode()
    for size in (1, 5, 10, 13, 48, 56, 57, 1000):
        wins = [tuple(w[i : i + 10]) for part in decontaminate.segments(text, 10, size) for w in [decontaminate.words_of(part)] for i in range(len(w) - 9)]
        assert wins == [tuple(f"w{j}".encode() for j in range(i, i + 10)) for i in range(48)]
    assert decontaminate.segments(b"", 10, 1) == [b""] and decontaminate.segments(b"one two", 10, 1) == [b"one two"]


def test_decontaminate(spark, texts):
    rng = random.Random(3)
    item = words(rng, 25)
    docs = [*texts, (50, "x " + item.upper() + " y"), (51, " ".join(item.split()[3:13])), (52, " ".join(item.split()[3:12])), (53, "ÉTÉ one-two! three"), (54, "aa aa aa aa aa aa aa aa aa aa aa aa")]
    items = [(1, item), (1, item), (2, "one two"), (3, None), (4, "..."), (None, "été"), (5, "aa aa"), (6, " ".join(["aa"] * 11))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = decontamination_expected(docs, items)
    for size, parts in ((10**6, 1), (5, 8)):
        assert len(list(decontaminate.blocks(bench, size=size))) == parts
        got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.search(frame(spark, docs), bench, size=size).collect()), key=repr)
        assert got == expected
        kept = decontaminate.clean(frame(spark, docs), bench, size=size)
        assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert sorted(kept.select("doc_id").collect(), key=repr) == sorted(((d,) for d, _, n, _ in expected if not n), key=repr)
    assert decontaminate.search(frame(spark, docs), bench.limit(0)).filter("n_hit > 0").count() == 0


# --- near duplicates


def near_expected(texts):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((i, len(sets[i]), find(i) if i is not None else None) for i, _ in texts)


def test_near_dedup(spark, texts):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_components(frame(spark, texts)).collect())
    assert got == near_expected(texts)


def test_near_dedup_null_id_beside_copies(spark):
    """A row without an id stays alone, even where its text is that of others."""
    text = " ".join(WORDS)
    docs = frame(spark, [(2, text), (None, text), (1, text), (3, "other words"), (None, "other words")])
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_components(docs).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 3), (None, None), (None, None)])


def test_near_dedup_borderline(spark, monkeypatch):
    """Chains around the threshold, of which stars alone would miss links, for any bound of rare shingles."""
    rng = random.Random(11)
    base = words(rng, 80).split()
    docs = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(80)] = f"new{rng.randrange(12)}"
        docs.append((k, " ".join(w)))
    expected = near_expected(docs)
    for rare in (100, 1, 7):
        monkeypatch.setattr(near_dedup, "RARE", rare)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_components(frame(spark, docs)).collect())
        assert got == expected


def test_near_dedup_keeps_one(spark, texts):
    docs = frame(spark, texts).withColumn("rep", F.lit(0)).withColumn("root", F.lit("x"))
    out = near_dedup.deduplicated(docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and 1 in ids and None in ids and {2, 3, 8}.isdisjoint(ids)
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = near_dedup.mix(np.arange(4000, dtype=np.uint64) + np.uint64(9))
    for _ in range(3):
        a, b = pool[:1500], pool[300:1900]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = near_dedup.joint_similarity(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(est - truth) < 0.15
        # Registers of a union are the larger of both.
        assert (near_dedup.registers(np.union1d(a, b)) == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()
        pool = rng.permutation(pool)


def test_components_of_chains(spark):
    n = 200
    links = spark.createDataFrame([(i + 1, i) for i in range(n) if i != 77] + [(500, 400)], "a long, b long")
    got = dict((r.id, r.root) for r in graph.components(links).collect())
    assert got == {**{i: 0 for i in range(78)}, **{i: 78 for i in range(78, n + 1)}, 400: 400, 500: 400}


# --- repeated substrings


def repeats_expected(texts):
    rows = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))
    out = Counter()
    for i, b in rows:
        cover = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for k, c in enumerate(cover) if c and (not k or not cover[k - 1]))
        out[i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [1024, 4, 1])
def test_substring_dedup(spark, texts, tmp_path, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "ROWS", group)
    rng = random.Random(8)
    common = words(rng, 90)
    more = [(100 + i, words(rng, rng.randrange(5)) + " " + common[rng.randrange(40) : 300 + rng.randrange(300)] + " " + words(rng, 5)) for i in range(12)]
    more += [(120, "ab" * 700), (121, common + common[:450]), (122, "z" * 400), (123, "z" * 399), (124, "ž" * 350)]
    docs = [*texts, *more]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == repeats_expected(docs)


def records_written(plan):
    """Records of every exchange of a plan that has run."""
    metric = plan.metrics().get("shuffleRecordsWritten")
    own = [metric.get().value()] if metric.isDefined() else []
    return own + [n for k in range(plan.children().size()) for n in records_written(plan.children().apply(k))]


def test_copies_leave_before_the_exchange(spark):
    """A text that occurs often is wanted once; its copies do not meet in one task."""
    docs = spark.createDataFrame([(1, 2, "x" * 500)] * 300 + [(3, 4, "y" * 450), (5, 6, "z")], "u1 long, u2 long, text string").coalesce(2)
    wanted = spark.createDataFrame([(1, 2, 112, 7, 300), (3, 4, 20, 7, 1)], "u1 long, u2 long, pos int, a long, cnt long")
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found = substring_dedup.surroundings(docs, wanted)
        got = sorted((r.key, r.u1, r.u2, r.pos, bytes(r.left), bytes(r.right), r.cnt) for r in found.collect())
        counts = records_written(found._jdf.queryExecution().executedPlan())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == [(7, 1, 2, 112, b"x" * 112, b"x" * 100, 300), (7, 3, 4, 20, b"y" * 20, b"y" * 112, 1)]
    assert counts and max(counts) < 20


def test_collection_order():
    rng = random.Random(4)
    for _ in range(50):
        m, w = rng.randint(1, 7), rng.randint(1, 6)
        n = [rng.randint(0, w) for _ in range(m)]
        rows, ends = np.zeros((m, w), np.uint16), [[rng.choice([1, 2]) for _ in range(3)] for _ in range(m)]
        for i, k in enumerate(n):
            rows[i, w - k :] = [rng.choice([1, 2]) for _ in range(k)]
        base = np.empty(m, np.int64)
        base[sorted(range(m), key=lambda i: ends[i])] = np.arange(m)
        ranked = sorted(range(m), key=lambda i: ends[i])
        both = [next((k for k, (x, y) in enumerate(zip(ends[a], ends[b], strict=True)) if x != y), 3) + 1 for a, b in zip(ranked, ranked[1:], strict=False)]
        row, start, common = substring_dedup.collection_order(rows, np.array(n), base, np.array([0, *both]))
        suffixes = [(*rows[a, b:].tolist(), 0, *ends[a]) for a, b in zip(row, start, strict=True)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(n) + m
        for k, (x, y) in enumerate(zip(suffixes, suffixes[1:], strict=False), 1):
            same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert common[k] == same


# --- media


def test_png_round_trip():
    rng = np.random.default_rng(3)
    for payload in (bytes(64), bytes(rng.integers(0, 256, 64 * 77, dtype=np.uint8)), media.padded("Příliš žluťoučký kůň. ".encode() * 5000)):
        assert media.decode(media.encode(payload)).tobytes() == payload
    png = bytearray(media.encode(bytes(range(128))))
    png[60] ^= 1
    with pytest.raises(media.MediaError):
        media.decode(bytes(png))
    for bad in (b"", b"GIF89a", media.encode(bytes(64))[:-6]):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_png_foreign_filters():
    rng = np.random.default_rng(4)
    img = rng.integers(0, 256, (9, 16), dtype=np.uint8)
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1], np.uint8)
    rows = np.empty_like(img)
    for r in range(9):
        for c in range(16):
            a = int(img[r, c - 1]) if c else 0
            b = int(img[r - 1, c]) if r else 0
            d = int(img[r - 1, c - 1]) if r and c else 0
            p = a + b - d
            guess = [0, a, b, (a + b) // 2, min((a, b, d), key=lambda v: abs(p - v))][kinds[r]]  # noqa: B023
            rows[r, c] = (int(img[r, c]) - guess) & 255
    assert (media.unfilter(kinds, rows) == img).all()


def test_media_query(spark, texts):
    got = media.read_media(media.write_media(frame(spark, texts))).collect()
    expected = Counter()
    for i, t in texts:
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        expected[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == expected
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1


# --- language model


def lm_expected(rows, order, weight):
    split = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").encode().decode().split(None)]
    grams, n_docs = [Counter() for _ in range(order)], 0
    for _, t, held in rows:
        seq = ["<s>"] * (order - 1) + [*split(t), "</s>"]
        if not held:
            n_docs += 1
            for i in range(order - 1, len(seq)):
                for k in range(order):
                    grams[k][tuple(seq[i - k : i + 1])] += 1
    total, types = sum(grams[0].values()), len(grams[0])
    out = []
    for i, t, held in rows:
        seq = ["<s>"] * (order - 1) + [*split(t), "</s>"]
        base = score = 0.0
        known = 0
        for x in range(order - 1, len(seq)):
            p = (grams[0][(seq[x],)] + 0.5) / (total + 0.5 * (types + 1))
            base += np.log10(p)
            known += grams[0][(seq[x],)] > 0
            for k in range(1, order):
                h = tuple(seq[x - k : x])
                c = n_docs if x == order - 1 else grams[k - 1][h]
                if c:
                    p = (grams[k][tuple(seq[x - k : x + 1])] + weight * p) / (c + weight)
            score += np.log10(p)
        out.append((i, held, len(seq) - order + 1, known, total, round(base, 5), round(score, 5)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(spark, texts, monkeypatch, order):
    monkeypatch.setattr(lm_score, "BLOCK", 3000)
    monkeypatch.setattr(lm_score.packed, "__defaults__", (3000,))
    docs = frame(spark, texts)
    held = crc_mod("doc_id", 5) == 1
    rows = [(i, t, i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in texts]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm_score.scores(docs, held, order=order).collect()), key=repr)
    want = lm_expected(rows, order, lm_score.WEIGHT)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(a - b) < 1e-3 for g, w in zip(got, want, strict=True) for a, b in zip(g[5:], w[5:], strict=True))


def test_lm_score_empty(spark, texts):
    assert lm_score.scores(frame(spark, texts).limit(0), F.lit(False)).count() == 0
    alone = lm_score.scores(frame(spark, [(1, "a b")]), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.n_known == 0


# --- mixing, tokens


def test_mixing_rates(spark):
    docs = frame(spark, [(i, "x", ) for i in range(6000)]).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 < 9, "mid"))
    out = mixing.mix(docs, {"big": 0.3, "mid": 0.5}, size=2.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    for source, share in (("big", 0.3), ("mid", 0.5), (None, 0.2)):
        assert abs(n[source] / 12000 - share) < 0.02
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    again = mixing.mix(docs.repartition(7), {"big": 0.3, "mid": 0.5}, size=2.0)
    assert again.exceptAll(out).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.shuffled(out).count() == out.count()


def test_mixing_columns(spark):
    docs = frame(spark, [(1, "a"), (2, None), (None, ""), (2, None)])
    clash = docs.withColumns({c: F.lit(5) for c in ("_u", "_n", "_order", "_source", "_first", "_cdf", "_row", "_id", "_own", "copy_no", "dotted.name")})
    out = mixing.mix(clash, size=4.0)
    assert sorted(out.columns) == sorted([*clash.columns, "shuffle_key"]) and out.filter("_u <> 5 OR _cdf <> 5 OR _row <> 5").count() == 0
    assert out.select("doc_id", "text", "copy_no").exceptAll(mixing.mix(docs, size=4.0).select("doc_id", "text", "copy_no")).count() == 0
    assert out.filter("copy_no = 5").count() < out.count()


def test_token_counts(spark, texts):
    pieces = tokens.vocabulary()
    longest, floor = max(map(len, pieces)), min(pieces.values()) - 5

    def slow(word):
        best = [(0.0, 0)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            size = len(word[e - 1].encode())
            options = [(best[e - 1][0] + floor * size, -(best[e - 1][1] + size))]
            options += [(best[s][0] + pieces[word[s:e]], -(best[s][1] + 1)) for s in range(max(0, e - longest), e) if word[s:e] in pieces]
            score, n = max(options)
            best[e] = (score, -n)
        return best[-1][1]

    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in tokens.token_counts(frame(spark, texts)).collect())
    want = Counter((i, len(w), sum(slow(tokens.MARK + x) for x in w)) for i, t in texts for w in [(t or "").encode().split()] for w in [[x.decode() for x in w]])
    assert got == want


# --- classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = words(rng, 40).split()
        if bad:
            w[rng.randrange(40)] = rng.choice(["idiot", "clown"])
        t = " ".join(w) if i % 4 else " ".join(x.upper() + "!!" for x in w)
        docs.append((i, t))
        labels.append((i, int(i % 4 != 0), int(bad)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("fit", "score", "label", "modulus", "rest"), [(classify.fit_toxicity, classify.score_toxicity, "toxic", 5, 0), (classify.fit_quality, classify.score_quality, "quality", 3, 1)])
def test_held_out_accuracy(labelled, fit, score, label, modulus, rest):
    docs, labels = labelled
    held = crc_mod("doc_id", modulus) == rest
    found = score(docs, fit(docs, labels.filter(~held)), held_out=held).join(labels, "doc_id").filter("held_out")
    right = found.filter(F.col("predicted") == F.col(label)).count() / found.count()
    assert right > 0.95
    assert found.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0


def test_classifier_edges(spark, labelled, texts):
    docs, labels = labelled
    for one in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        w = classify.fit_toxicity(docs, one)
        assert classify.score_toxicity(frame(spark, texts), w).count() == len(texts)
    w = classify.fit_quality(docs, labels.limit(0))
    assert classify.score_quality(frame(spark, texts), w).count() == len(texts)
    w = classify.fit_toxicity(docs, labels.unionByName(labels))
    kept = classify.without_toxic(docs, w)
    assert kept.columns == docs.columns and abs(kept.count() - 720) < 15
    assert len(w.at) < 2000


def test_classifier_column_names(spark, labelled):
    docs, labels = labelled
    own = docs.withColumns({c: F.lit(1) for c in ("_label", "label", "id", "at", "_t", "x")})
    w = classify.fit_toxicity(own, labels.withColumn("text", F.lit("mine")))
    assert (w.at == classify.fit_toxicity(docs, labels).at).all()
    assert classify.without_toxic(own, w).columns == own.columns and classify.score_toxicity(own, w).count() == own.count()


def examples(rng, n=200):
    rows = []
    for i in range(n):
        x = {rng.randrange(30) for _ in range(6)} | ({31} if i % 3 == 0 and rng.random() < 0.9 else set())
        rows.append((np.array(sorted(x), np.uint32), int(i % 3 == 0)))
    return rows


def test_ftrl_plain():
    """Per-coordinate FTRL-proximal, one number at a time."""
    rows = examples(random.Random(1))
    got = classify.Ftrl.fit(classify.Examples.of(rows), bits=6, l1=2.0, alpha=0.5)
    z, n, rng = Counter(), Counter(), np.random.default_rng(7)

    def weight(f):
        return 0.0 if abs(z[f]) <= 2 else -(z[f] - np.sign(z[f]) * 2) / ((1 + n[f] ** 0.5) / 0.5)

    for _ in range(3):
        for k in rng.permutation(len(rows)):
            at, y = [*rows[k][0].tolist(), "bias"], rows[k][1]
            w = {f: weight(f) for f in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for f in at:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / 0.5 * w[f]
                n[f] += g * g
    want = np.array([weight(f) for f in range(64)])
    assert np.allclose(got.dense()[0], want, atol=1e-5) and abs(got.bias[0] - weight("bias")) < 1e-5
    assert 0 < len(got.at) < 31


def test_nbsvm_plain():
    """Ratios by counting; the dual by plain lists; interpolation as published."""
    rows = examples(random.Random(2))
    got = classify.fit_nbsvm(classify.Examples.of(rows), bits=6)
    docs = Counter(f for x, _ in rows for f in x.tolist())
    pos = Counter(f for x, y in rows if y for f in x.tolist())
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    r = {f: np.log((pos[f] + 1) / (n1 + 2)) - np.log((docs[f] - pos[f] + 1) / (n0 + 2)) for f in docs if docs[f] >= 3}
    r["bias"] = 1.0
    w, alpha, rng = Counter(), [0.0] * len(rows), np.random.default_rng(7)
    for _ in range(12):
        for k in rng.permutation(len(rows)):
            at = [f for f in [*rows[k][0].tolist(), "bias"] if f in r]
            size = sum(r[f] ** 2 for f in at) ** 0.5
            y = 1 if rows[k][1] else -1
            g = y * sum(w[f] * r[f] / size for f in at) - 1
            new = min(max(alpha[k] - g, 0.0), 1.0 if y > 0 else n1 / n0)
            for f in at:
                w[f] += (new - alpha[k]) * y * r[f] / size
            alpha[k] = new
    names = [f for f in r if f != "bias"]
    mean = sum(abs(w[f]) for f in names) / len(names)
    dense = got.dense()
    assert all(abs(dense[0, f] - r[f]) < 1e-5 and abs(dense[1, f] - (0.75 * mean + 0.25 * w[f])) < 1e-4 for f in names)
    assert abs(got.bias[0] - w["bias"]) < 1e-4
