"""The corpus operators against plain versions, over awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from isobar.llm import bpe_codec, decontamination, line_dedup, lm_scoring, quality_classifier, quality_rules, sharding, simhash, token_counts
from isobar.llm.common import Written
from isobar.llm.components import stars
from isobar.llm.pii import personal_data, summary

SPACES = re.compile("[\x20\x09-\x0d]+")


def words(t):
    return [w for w in SPACES.split(t or "") if w]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# 1


def rule_row(i, t):
    w = words(t)
    wins = defaultdict(list)
    for k in range(len(w) - 4):
        wins[tuple(w[k : k + 5])].append(k)
    covered = {p for v in wins.values() if len(v) > 1 for k in v for p in range(k, k + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_rules(docs, texts):
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(got.collect(), [rule_row(*x) for x in texts])


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, good if k % 50 == 0 else "few", "bad") for k in range(400)] + [(1000 + k, good, f"h{k % 5}") for k in range(200)] + [(5000, good, "tiny"), (5001, "few", "tiny"), (5002, good, None)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0]["base_failed"] and got[0]["host_rejected"] and not got[0]["kept"]
    assert all(got[1000 + k]["kept"] for k in range(200)) and got[5002]["kept"] and not got[5002]["host_rejected"]
    assert 0.02 < got[5000]["host_rate"] < 0.9  # a tiny host is drawn towards the others


# 2, 3


def library(name):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_bpe_codec(docs, texts, monkeypatch):
    tok = library("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(i, t):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))

    same(bpe_codec.digests(bpe_codec.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))).collect(), [want(*x) for x in texts])


def test_bpe_words_one_by_one():
    """Words of few letters, so that merges compete, and emptied tables on the way."""
    import random

    tok, rng = library("word_bpe_49k.json"), random.Random(1)
    bpe = bpe_codec.TrieBpe(public_tokenizers.path("word_bpe_49k.json"))
    some = {"".join(rng.choice("aehinostu") for _ in range(rng.randrange(1, 14))) for _ in range(3000)} | {"a" * k for k in range(1, 60)} | {"haha" * k for k in range(1, 9)}
    got = bpe.encode(list(some))
    assert all(got[w] == tok.encode(w, add_special_tokens=False).ids for w in some)


@pytest.mark.parametrize("tier", [0, 5, 5000])
def test_token_counts(docs, texts, tier):
    tok = library("byte_bpe_50k.json")
    want = []
    for i, t in texts:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    same(token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), tier_one=tier).collect(), want)


# 4


def test_classifier_on_held_out_rows(spark):
    from ..conftest import DATA

    d = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))


def test_classifier_equals_a_plain_fit(spark):
    """Normal equations of all rows at once, cross-fitted scores, and the isotonic fit by
    its max-min formula."""
    from ..conftest import DATA

    d = f"{DATA}/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality_classifier
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(q.PARTS)).alias("p")).collect()}
    given = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    own = [i for i in text if i in given and zlib.crc32(str(i).encode()) % 5]
    x, y, parts = np.array([q.statistics(text[i]) for i in own]), np.array([given[i] for i in own], float), np.array([part[i] for i in own])
    mean, spread = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(7)
    w, b = rng.normal(size=(q.STATISTICS, q.COSINES)) * q.SCALE, rng.uniform(0, 2 * np.pi, q.COSINES)
    made = lambda x: np.hstack([np.sqrt(2 / q.COSINES) * np.cos(np.clip((x - mean) / spread, -5, 5) @ w + b), np.ones((len(x), 1))])
    ridge = lambda p, y: np.linalg.solve(p.T @ p + q.RIDGE * np.eye(p.shape[1]), p.T @ y)
    p = made(x)
    raw = np.zeros(len(own))
    for k in range(q.PARTS):
        raw[parts == k] = p[parts == k] @ ridge(p[parts != k], y[parts != k])
    at = np.clip(((raw - q.LOW) / (q.HIGH - q.LOW) * q.BINS).astype(int), 0, q.BINS - 1)
    bins = np.unique(at)
    n, total = np.array([(at == v).sum() for v in bins]), np.array([y[at == v].sum() for v in bins])
    share = [max(min(total[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    whole = made(np.array([q.statistics(text[i]) for i in text])) @ ridge(p, y)
    want = 0.999 * np.interp(whole, (bins + 0.5) / q.BINS * (q.HIGH - q.LOW) + q.LOW, share) + 0.001 / (1 + np.exp(-np.clip(whole, -9, 9)))
    got = {r["doc_id"]: r["score"] for r in q.quality_scores(docs, labels).collect()}
    assert np.allclose([got[i] for i in text], want, atol=1e-6)


def test_classifier_on_awkward_rows(spark, docs, texts):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(docs, labels).toPandas()
    assert len(got) == len(texts) and got["score"].between(0, 1).all() and got["held_out"].isna().sum() == 0
    none = quality_classifier.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all()
    assert quality_classifier.keep_quality(docs, labels.limit(0)).columns == docs.columns


def test_calibration_is_monotone():
    rng = np.random.default_rng(0)
    y, w = rng.random(200), rng.integers(1, 9, 200).astype(float)
    m = quality_classifier.monotone(y, w)
    assert (np.diff(m) >= 0).all() and (m * w).sum() == pytest.approx((y * w).sum())


# 5


def fingerprint(t):
    w = words(low(t))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_simhash(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    fps = {t: fingerprint(t) for _, t in texts}
    every = sorted(set(fps.values()))
    comp = classes(every, [(a, b) for a in every for b in every if (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in texts:
        c = comp[fps[t]]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    same(got, [(i, f"{fps[t]:016x}", least.get(comp[fps[t]])) for i, t in texts])


@pytest.mark.parametrize("cell", [8, 64, 1024])
def test_links_in_large_buckets(spark, monkeypatch, cell):
    """Chains of near fingerprints that share many keys, in cells of several sizes."""
    import random

    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    fps = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1, 1 << 63}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    found = simhash.near(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()
    nodes = [signed(x) for x in fps]
    want = classes(nodes, [(signed(a), signed(b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3])
    assert classes(nodes, [(r["a"], r["b"]) for r in found]) == want


def test_components(spark):
    rows = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {n: r for n, r in classes({x for e in rows for x in e}, rows).items() if n != r}
    assert got == want
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_stays(docs, texts):
    """One row of each component of fingerprints; two unlinked texts of one id both stay."""
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = {fingerprint(t) for _, t in texts}
    comp = classes(sorted(fps), [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3])
    stay = [comp[fingerprint(r["text"])] for r in kept.select("text").collect()]
    assert sorted(stay) == sorted(set(comp.values()))
    assert set(kept.select("cut", "__id", "_score").distinct().collect()) == {("clash",) * 3}


def test_no_unique_document_is_lost(spark):
    """Null and repeated ids: one row of each component, whatever its id."""
    rng = np.random.default_rng(3)
    made = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))
    a, b, c, d, e, f = (made() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (1, c), (8, d), (8, e), (3, b), (None, f), (None, f), (9, f.upper())]
    fps = {fingerprint(x) for _, x in rows}
    assert len(fps) == 6 and min((x ^ y).bit_count() for x in fps for y in fps if x != y) > 3
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    same(kept.collect(), [(None, a), (1, c), (8, d), (8, e), (3, b), (9, f.upper())])
    none = [(None, a), (None, b), (None, b), (None, c), (None, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(none, "doc_id long, text string")).collect()
    assert sorted(r["text"] or "" for r in kept) == sorted([a, b, c, ""])


# 6


def bench_words(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t)) if w]


def contamination(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = bench_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(item)
    lengths = {len(w) for w in wins}
    for i, t in rows:
        w, hit, found = bench_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        names = ",".join(sorted(map(str, found)))
        yield i, len(w), len(hit), names, len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_decontamination(spark, docs, texts, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    base = [t for _, t in texts[:10]]
    items = [(1, base[0][:300]), (2, base[0][:300]), (10, base[6][50:250].upper()), (3, "one"), (4, "two, WORDS!"), (5, None), (6, ""), (7, "a b c"), (8, "--"), (9, "Straßea dé x1"), (11, "word " * 20), (12, base[9][:70])]
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    same([(*r[:3], ",".join(r["items"]), r["contaminated"]) for r in got], list(contamination(texts, items)))


def test_decontamination_of_nothing(spark, docs, none, texts):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(docs, items).collect()
    assert len(got) == len(texts) and not any(r["contaminated"] or r["n_hit"] for r in got)
    assert decontamination.keep_clean(docs, items).count() == len(texts)
    assert decontamination.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [200_000, 1])
def test_decontamination_of_null_and_repeated_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    monkeypatch.setattr("isobar.llm.common.BROADCAST_ROWS", limit)
    passage, other, clean = (" ".join(f"{x}{k}" for k in range(20)) for x in "poc")
    items = [(1, passage), (None, passage), (None, other)]
    rows = [(None, passage), (None, clean), (1, f"{other} x"), (2, passage), (2, clean), (3, None), (None, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    both, none, unnamed = [None, "1"], [], [None]
    same(got, [(None, 20, 20, both, True), (None, 20, 0, none, False), (1, 21, 20, unnamed, True), (2, 20, 20, both, True), (2, 20, 0, none, False), (3, 0, 0, none, False), (None, 0, 0, none, False)])
    same(decontamination.keep_clean(docs, bench).collect(), [(None, clean), (2, clean), (3, None), (None, None)])


def test_decontamination_moves_no_words_of_long_texts(spark, monkeypatch):
    """Beyond the broadcast size shuffles grow with the text, not with its square."""
    import random

    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 1)
    monkeypatch.setattr("isobar.llm.common.BROADCAST_ROWS", 1)
    rng = random.Random(4)
    some = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = spark.createDataFrame([(k, some(60)) for k in range(200)], "item_id long, text string")
    first = items.first()["text"]
    tracker = spark.sparkContext._jsc.sc().statusStore()

    def written(words):
        docs = spark.createDataFrame([(k, f"{some(words)} {first}") for k in range(4)], "doc_id long, text string").repartition(4)
        before = tracker.executorSummary("driver").totalShuffleWrite()
        got = decontamination.decontaminate(docs, items).select("doc_id", "n_hit").collect()
        assert all(r["n_hit"] >= 60 for r in got)
        return tracker.executorSummary("driver").totalShuffleWrite() - before

    small, large = written(3000), written(12_000)
    assert large < 6 * small


# 7


@pytest.mark.parametrize("frequent", [0, 40, 100_000])
def test_language_model(docs, texts, frequent):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts if i is not None} | {None: False}
    toks = [(i, [low(x) for x in words(t)] + [None]) for i, t in texts]
    c = Counter(x for i, w in toks if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    got = lm_scoring.lm_scores(docs, frequent=frequent).collect()
    want = sorted(((repr(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5), held[i]) for i, w in toks))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5), r["held_out"]) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_model_sums_to_one_and_beats_the_base(spark):
    from ..conftest import DATA

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    vocabulary = Written(lm_scoring.counts(docs), "v").df
    state = lm_scoring.fit(vocabulary)
    table = lm_scoring.common(lm_scoring.model(vocabulary, state).toPandas(), state)
    unknown = sum(state.behind(s[0]) * state.unknown(s) for s in state.samples) / len(state.samples)
    assert np.allclose((10.0 ** table.score.astype(float)).sum(0) + unknown, 1, atol=1e-5)
    p = lm_scoring.perplexity(lm_scoring.lm_scores(docs)).where("held_out").first()
    assert p["perplexity"] < p["base_perplexity"]


def test_seating():
    c = np.array([0, 1, 2, 5, 40, 1000, 100_000])
    t = lm_scoring.seat(c, np.full(7, 0.5), 0.7, np.arange(7), 0)
    assert t[0] == 0 and t[1] == 1 and (t <= c).all() and (t[1:] >= 1).all()
    assert lm_scoring.seat(np.full(500, 30), np.full(500, 1e9), 0.7, np.arange(500), 0).mean() == pytest.approx(30, abs=0.1)
    assert lm_scoring.seat(np.full(500, 30), np.full(500, 1e-9), 0.7, np.arange(500), 0).mean() == 1


def test_chance():
    u = lm_scoring.chance(np.arange(200_000), 3, 1)
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002 and abs(np.corrcoef(u, lm_scoring.chance(np.arange(200_000), 3, 2))[0, 1]) < 0.01
    for n, p in ((64, 0.01), (64, 0.5), (1024, 0.9), (100_000, 0.0001), (5000, 0.2)):
        x = lm_scoring.binomial(np.full(len(u), n), np.full(len(u), p), u, lm_scoring.chance(np.arange(200_000), 9))
        assert x.mean() == pytest.approx(n * p, rel=0.02) and x.var() == pytest.approx(n * p * (1 - p), rel=0.03) and x.min() >= 0 and x.max() <= n


def plain_scores(rows, held):
    """The seated model one customer at a time: log10 probability of each text."""
    hashed = lambda x: xxhash.xxh64_intdigest(b" " if x is None else x.encode(), 42) >> 6
    klass = lambda x: 0 if x is None else int(lm_scoring.CLASS[x.encode()[-1]])
    split = [(i, [low(x) for x in words(t)] + [None]) for i, t in rows]
    pairs = lambda w: [(hashed(x), klass(w[k - 1]) if k else 0) for k, x in enumerate(w)]
    n = Counter(p for i, w in split if not held[i] for p in pairs(w))
    c = Counter()
    for (w, _), m in n.items():
        c[w] += m
    assert max(n.values()) <= lm_scoring.SINGLY and max(c.values()) <= 10 * lm_scoring.SINGLY
    contexts = range(lm_scoring.CONTEXTS)
    customers = {k: sum(m for (_, x), m in n.items() if x == k) for k in contexts}
    rate = lambda v: min(max(v.count(1) / (v.count(1) + 2 * v.count(2)), 0.1), 0.95) if v.count(1) else 0.5
    d, d0 = rate(list(n.values())), rate(list(c.values()))
    tables, top, v, s = {k: sum(x == k for _, x in n) for k in contexts}, len(c), len(c), lm_scoring.STRENGTH

    def seated(m, new, discount, key, sweep):
        t = 1
        for k in range(1, m):
            t += lm_scoring.chance(np.array([key], np.uint64), sweep, k)[0] < new / (new + max(k - discount * t, 1e-9))
        return t

    def chain(tables, top, kept):
        total = sum(tables.values())
        fresh = (s + d0 * top) / (s + total) / (v + 1)
        arrivals, own0 = Counter(w for w, _ in n), dict.fromkeys(c, 1)
        for sweep in range(lm_scoring.BURN + kept):
            root = {w: max(arrivals[w] - d0 * own0[w], 0) / (s + total) + fresh for w in c}
            own = {(w, k): seated(m, (s + d * tables[k]) * root[w], d, w << 6 | k, sweep) for (w, k), m in n.items()}
            arrivals = Counter()
            for (w, _), t in own.items():
                arrivals[w] += t
            own0 = {w: seated(arrivals[w], (s + d0 * top) / (v + 1), d0, w << 6 | 63, sweep) for w in c}
            if sweep >= lm_scoring.BURN:
                yield own, own0, arrivals

    for _ in range(lm_scoring.SETTLE):
        ((own, own0, _),) = chain(tables, top, 1)
        tables, top = {k: sum(t for (_, x), t in own.items() if x == k) for k in contexts}, sum(own0.values())
    samples = list(chain(tables, top, lm_scoring.KEPT))

    def probability(w, k):
        p = 0
        for own, own0, arrivals in samples:
            in_k = {x: sum(t for (_, y), t in own.items() if y == x) for x in (k,)}[k]
            total = sum(own.values())
            root = (arrivals[w] - d0 * own0[w]) / (s + total) if w in c else 0
            root += (s + d0 * sum(own0.values())) / (s + total) / (v + 1)
            p += (max(n.get((w, k), 0) - d * own.get((w, k), 0), 0) + (s + d * in_k) * root) / (s + customers[k])
        return p / len(samples)

    return {i: sum(math.log10(probability(*x)) for x in pairs(w)) for i, w in split}


@pytest.mark.parametrize("frequent", [0, 100_000])
def test_scores_equal_a_plain_seated_model(spark, frequent):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"{'abcdefgh'[int(x)]}{'xyz'[int(y)]}" for x, y in zip(rng.integers(0, 8, 8), rng.integers(0, 3, 8), strict=True))) for k in range(40)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    want = plain_scores(rows, held)
    for parts in (1, 3):
        got = lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), frequent=frequent).collect()
        assert {r["doc_id"]: round(r["score"], 4) for r in got} == {i: round(x, 4) for i, x in want.items()}


# 8


def sizes(rows):
    return sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_sharding(docs, texts):
    got = sharding.shard_table(docs).toPandas()
    assert sorted(zip(map(repr, [None if x != x else int(x) for x in got["doc_id"]]), got["size"], got["text_crc32"], strict=True)) == sizes(texts)
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all() and got["shard"].between(0, 7).all()


def test_shards_are_equal_though_a_third_are_copies(spark):
    import random

    rng = random.Random(2)
    rows = [(k, "copy of one text " * 20, "en") for k in range(1500)] + [(5000 + k, "w" * rng.randrange(600) + str(k), rng.choice(["en", "de", None])) for k in range(3000)]
    got = sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 8 and by.max() - by.min() < 0.01 * by.mean() + 1500
    spread = got[got["size"] != 341].groupby("text_crc32")["shard"].nunique()
    assert (spread == 1).all()
    assert sharding.shard_table(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string")).count() == 1


def test_shards_are_equal_though_copies_have_no_ids(spark):
    """Rows of equal text and no id, or one id, that hold half of the bytes."""
    rows = [(None if k % 3 else 7, "copy of one text " * 9, None) for k in range(400)] + [(k, f"{k} " + "w" * (k * 37 % 150), "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for shards in (8, 6, 5):
        got = sharding.shard_table(docs, shards).toPandas()
        by = got.groupby("shard")["size"].sum()
        assert len(by) == shards and by.max() - by.min() < 0.02 * by.mean() + 2 * got["size"].max()
        for _, slots in got.groupby("shard")["slot"]:
            assert sorted(slots) == list(range(len(slots)))


def test_first_cut_is_the_plain_weighted_median(spark):
    """The first node against a median of all rows sorted along the widest dimension."""
    import random

    rng = random.Random(8)
    rows = [(k, "x" * int(rng.expovariate(0.01)) + str(k), rng.choice(["en", "de"])) for k in range(3000)]
    points = sharding.points(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    cut = sharding.tree(spark.createDataFrame(points), 2)[0]
    spread = {d: (points[f"k_{d}"].to_numpy() >> 40).std() for d in sharding.DIMENSIONS}
    assert cut.dimension == max(spread, key=spread.get)
    ordered = points.sort_values([f"k_{cut.dimension}", "k_id"])
    median = ordered[f"k_{cut.dimension}"][(ordered["size"].cumsum() >= ordered["size"].sum() / 2).to_numpy()].iloc[0]
    left = points[points[f"k_{cut.dimension}"] <= cut.at]["size"].sum()
    plain = points[points[f"k_{cut.dimension}"] <= median]["size"].sum()
    assert abs(left - plain) <= 2 * sharding.TOLERANCE * points["size"].sum() + points["size"].max()


# 10


def deduplicated(rows, ends=line_dedup.FEEDS):
    """Every row a document of its own; equal ids go by the text's hash."""
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, signed(rows[k][1]), k))
    units = [[x for x in re.split(ends, t or "") if x] for _, t in rows]
    seen, cut = set(), defaultdict(set)
    for r in order:
        for k in range(len(units[r]) - 2):
            window = tuple(x.strip(" \t\n\r\x0b\x0c") for x in units[r][k : k + 3])
            if window in seen:
                cut[r] |= {k, k + 1, k + 2}
            seen.add(window)
    return [(i, t if t is None else "".join(x for k, x in enumerate(units[r]) if k not in cut[r])) for r, (i, t) in enumerate(rows)]


ENDS = {"feeds": line_dedup.FEEDS, "sentences": line_dedup.SENTENCES}


@pytest.mark.parametrize("ends", ENDS)
def test_line_dedup(docs, texts, ends, spark):
    page = "one\ntwo\n\nthree\nfour. five! six? seven\n"
    more = [(9, page), (9, page), (9, "zero\n" + page), (9, page + "eight\nnine"), (None, page), (None, page), (400, "zero\n" + page * 3), (401, "\n\n" + page)]
    made = docs.unionByName(spark.createDataFrame([(i, t, len(t)) for i, t in more], "doc_id long, text string, n_chars long"), True)
    got = line_dedup.dedup_lines(made, ENDS[ends])
    assert got.columns == made.columns
    rows = got.select("doc_id", "text", "n_chars").collect()
    want = deduplicated([*texts, *more], ENDS[ends])
    same([r[:2] for r in rows], want)
    assert sum(t == "" for i, t in want) > 3
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)


def test_words_stay_whole(spark):
    """Marks inside words end no line."""
    rows = [(1, "See http://www.bbc.co.uk/a and 1.5 or a@b.c.d today. More to come"), (2, "Our shop is at http://www.bbc.co.uk/b and 1.5 or a@b.c.d always. More to come")]
    for ends in ENDS.values():
        same(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), ends).collect(), rows)


@pytest.mark.parametrize("doc_id", [None, 9])
def test_of_repeated_rows_one_stays(spark, doc_id):
    text = "one\ntwo\nthree\nfour"
    docs = spark.createDataFrame([(doc_id, text)] * 5, "doc_id long, text string").repartition(3)
    same(line_dedup.dedup_lines(docs).collect(), [(doc_id, text)] + [(doc_id, "")] * 4)
    assert sorted(r["n_removed"] for r in line_dedup.dedup_report(docs).collect()) == [0, 4, 4, 4, 4]


def test_line_dedup_of_awkward_rows_equals_sql(spark):
    """Repeated and null-id rows by the query's own SQL."""
    import duckdb

    from isobar.llm.queries import ORACLE_SQL

    text = "one\ntwo\n\nthree \n four"
    rows = [(None, text), (None, text), (9, text), (9, text), (10, "x\n" + text), (11, None), (12, ""), (13, "three\nfour\nfive"), (14, "three\nfour\nfive\n")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    columns = ["doc_id", "n_removed", "n_chars_removed", "text_sha256"]
    want = [tuple(r) for r in con.execute(ORACLE_SQL["op10_line_dedup"]).fetchall()]
    got = line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).select(columns).collect(), want)


def test_clauses_inside_lines_are_found_and_words_stay_whole(spark, tmp_path):
    """The query's rule, by its SQL: passages inside longer lines go, words are not cut."""
    import duckdb

    from isobar.llm.queries import ORACLE_SQL, QUERIES

    passage = "first of all, it rained; then it stopped: nobody knew why, as ever."
    rows = [
        (1, f"A beginning without marks and {passage} An end"), (2, f"Quite another one, though: {passage} And more"), (3, None), (4, ""), (5, "...!? a.b,c .\n\n;x: y"),
        (6, "See http://www.bbc.co.uk/a, and 1.5, or 8:30. More"), (7, "At http://www.bbc.co.uk/b, and 1.5, or 8:30. More"), (8, "一二，三四。五六！七\n八。。.b c：\n"), (9, "九，三四。五六！七\n八。。.b c：\n"),
        (10, "x, y, z, a.b"), (11, "x, y, z, a.b"), (12, "one.\n two, \n three...four,\t five.\x0b six"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()
    same(got, [tuple(r) for r in con.execute(ORACLE_SQL["op10_line_dedup"]).fetchall()])
    assert {r["doc_id"]: r["n_removed"] for r in got}[2] == 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, line_dedup.CLAUSES).collect()}
    same(kept.items(), deduplicated(rows, line_dedup.CLAUSES))
    assert kept[7] == "At http://www.bbc.co.uk/b," and kept[2] == "Quite another one, though: first of all, And more"


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a\nb\nc\nd", 1, 2, 3, 4, 5), (2, "a\nb\nc\ne", 6, 7, 8, 9, 10), (None, None, 1, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut int, number int, row int, `a.b` int, key int")
    got = line_dedup.dedup_lines(docs)
    assert got.dtypes == docs.dtypes
    same(got.collect(), [rows[0], (2, "e", *rows[1][2:]), rows[2]])


@pytest.mark.parametrize("ends", ENDS.values())
def test_a_window_stays_once(docs, ends):
    """Whatever repeats is still there in one place."""
    rows = [r["text"] or "" for r in line_dedup.dedup_lines(docs, ends).select("text").collect()]
    before = {r["text"] for r in docs.select("text").collect()}
    for t in before - {None}:
        for piece in re.split(ends, t):
            assert any(piece.strip() in x for x in rows)


def test_every_later_window_goes(spark):
    """Short ones, and those beside a first occurrence."""
    p = "p one\np two\np three\n"
    rows = [(1, f"a1\n{p}a2\n"), (2, f"x1\nx2\n{p}y1\ny2\n"), (3, f"x1\nx2\n{p}y1\ny2\n"), (4, "home\nnews\nhelp"), (5, "home\nnews\nhelp")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, [rows[0], (2, "x1\nx2\ny1\ny2\n"), (3, ""), rows[3], (5, "")])


# all


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path
    for made in (
        quality_rules.quality_rules(none), bpe_codec.encode_decode(none, path("word_bpe_49k.json")), token_counts.token_counts(none, path("byte_bpe_50k.json")),
        quality_classifier.quality_scores(none, labels), simhash.near_duplicates(none), simhash.keep_one(none), lm_scoring.lm_scores(none), sharding.shard_table(none),
        personal_data(none), line_dedup.dedup_lines(none), line_dedup.dedup_report(none),
    ):
        assert made.count() == 0


def test_a_very_long_text(spark):
    """1.4 million characters, more than is taken at once, among short ones."""
    import random

    rng = random.Random(12)
    long = "\n".join(f"line {k} {rng.randrange(10**6)} of Words{rng.randrange(3000)}, é and a@b{k}.com" for k in range(32_000))
    assert len(long) > bpe_codec.TAKE
    rows = [(1, "short one"), (2, long), (3, None), (4, "short two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path
    tok = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in bpe_codec.encode_decode(docs, path("word_bpe_49k.json")).collect()}
    ids = tok.encode(long, add_special_tokens=False).ids
    assert got[2]["ids"] == " ".join(map(str, ids)) and got[2]["decoded"] == tok.decode(ids, skip_special_tokens=False) and got[3]["ids"] == ""
    n = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path("byte_bpe_50k.json")).collect()}
    assert n[2] == len(library("byte_bpe_50k.json").encode(long, add_special_tokens=False).ids)
    fp = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}
    assert fp[2] == f"{fingerprint(long):016x}"
    assert {r["doc_id"]: r["n_tokens"] for r in lm_scoring.lm_scores(docs).collect()} == {i: len(words(t)) + 1 for i, t in rows}
    same(line_dedup.dedup_lines(docs).collect(), list(deduplicated(rows)))
    assert {r["doc_id"]: r["n_email"] for r in summary(personal_data(docs)).collect()} == {1: 0, 2: 32_000, 3: 0, 4: 0}
    item = " ".join(bench_words(long)[-13:])
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.decontaminate(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert hit[2] == (len(bench_words(long)), 13) and hit[1] == (2, 0)


def test_personal_data_of_awkward_rows(docs, texts):
    got = summary(personal_data(docs.withColumn("text", F.when(F.col("doc_id") == 303, "a@b.c 1.2.3.4").otherwise(F.col("text"))))).collect()
    assert len(got) == len(texts) and {r["spans"] for r in got} == {"", "email:0:5,ip:6:13"}


def executed(df):
    """The final plan of a run over all rows."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_broadcast_is_measured(spark, monkeypatch):
    """Many items of one text have few shingles; their names aren't broadcast by hint."""
    from isobar.llm import common

    asked = []
    plain = common.if_small
    monkeypatch.setattr(decontamination, "if_small", lambda df, *a: asked.append((df.columns, df.count())) or plain(df, *a))
    text = " ".join(f"w{k}" for k in range(13))
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.lit(text).alias("text"))
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "none")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], len(r["items"])) for r in decontamination.decontaminate(docs, items).collect()}
    assert got == {1: (13, 3000), 2: (0, 0)}
    assert (["same", "item"], 3000) in asked and [n for c, n in asked if c == ["same", "n"]] == [1]


def test_shingles_beyond_the_broadcast(spark, docs, texts, monkeypatch):
    """The same rows where nothing is small enough."""
    from isobar.llm import common

    items = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts[:20]) if t], "item_id long, text string")
    plain = decontamination.decontaminate(docs, items).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "if_small", lambda df, *a: df)
    assert sorted(map(repr, decontamination.decontaminate(docs, items).collect())) == sorted(map(repr, plain))


def test_a_hub_is_split(spark):
    """Links of one node are dealt to several tasks."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "128m", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    seen = []
    plain = Written.__init__

    def watched(self, df, label):
        if label == "large":
            seen.append(executed(df))
        plain(self, df, label)

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(Written, "__init__", watched)
            links = spark.range(1, 60_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
            assert stars(links).where("root = 0").count() == 59_999
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert any("skew=true" in p or "isSkewJoin=true" in p or "skewed" in p for p in seen)
