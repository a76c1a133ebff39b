"""The language model with a restaurant for every previous word."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from isobar.llm import lm_scoring, lm_words
from isobar.llm.queries import op7_lm_scoring

hashed = lambda x: xxhash.xxh64_intdigest(b" " if x is None else x.encode(), 42) >> 6
klass = lambda x: 0 if x is None else int(lm_scoring.CLASS[x.encode()[-1]])


def of(text):
    """(context, token) of a text, None being its end and what stands before its start."""
    w = [*(text or "").split(), None]
    return list(zip([None, *w[:-1]], w, strict=True))


def upper(spark, n, t, c):
    """The upper levels, fitted to the tables of the pairs: p(token, class), unknown tokens too."""
    arrivals = Counter()
    for (u, w), tables in t.items():
        arrivals[w, klass(u)] += tables
    rows = []
    for w in c:
        own = sorted((k, m) for (x, k), m in arrivals.items() if x == w)
        rows.append((hashed(w), c[w], [k for k, _ in own], [m for _, m in own]))
    vocabulary = spark.createDataFrame(rows, "w long, c long, context array<int>, n array<long>")
    state = lm_scoring.fit(vocabulary)
    table = lm_scoring.common(lm_scoring.model(vocabulary, state).toPandas(), state)
    place = {w: i for i, w in enumerate(table.hashes)}
    unknown = sum(state.behind(s[0]) * state.unknown(s) for s in state.samples) / len(state.samples)
    return lambda w, k: 10.0 ** float(table.score[place[hashed(w)], k]) if hashed(w) in place else unknown[k]


def plain(spark, rows):
    """Scores with the words' customers seated one at a time, and the sums of some contexts."""
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    n = Counter(p for t in train for p in of(t))
    c = Counter(w for t in train for _, w in of(t))
    customers = Counter(u for t in train for u, _ in of(t))
    ones, twos = (sum(m == k for m in n.values()) for k in (1, 2))
    d, s = min(max(ones / (ones + 2 * twos), 0.1), 0.95), lm_scoring.STRENGTH
    t = dict.fromkeys(n, 1)
    for sweep in range(lm_words.SWEEPS + 1):
        p = upper(spark, n, t, c)
        tables = Counter()
        for (u, _), x in t.items():
            tables[u] += x
        if sweep == lm_words.SWEEPS:
            break
        for (u, w), m in n.items():
            new, seats = (s + d * tables[u]) * p(w, klass(u)), 1
            key = lm_words.pair_hash(np.array([hashed(w)]), np.array([hashed(u) << 6 | klass(u)], np.uint64).view(np.int64))
            for k in range(1, m):
                seats += lm_scoring.chance(key, sweep, k)[0] < new / (new + max(k - d * seats, 1e-9))
            t[u, w] = int(seats)
    each = lambda u, w: (n[u, w] - d * t.get((u, w), 0) + (s + d * tables[u]) * p(w, klass(u))) / (s + customers[u])
    sums = {u: sum(each(u, w) for w in c) + each(u, "never met") for u in [*list(customers)[:10], "never met"]}
    return {i: sum(math.log10(each(*x)) for x in of(text)) for i, text in rows}, sums


@pytest.mark.parametrize(("frequent", "contexts", "pairs"), [(0, 0, 0), (8, 8, 8), (100_000, 1_000_000, 2_000_000)])
def test_scores_equal_a_plain_model(spark, frequent, contexts, pairs):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"{'abcdefgh'[int(x)]}{'xyz'[int(y)]}" for x, y in zip(rng.integers(0, 8, 8), rng.integers(0, 3, 8), strict=True))) for k in range(60)]
    rows += [(60, "new words ax"), (61, None), (62, "ax ay " * 14)]
    rows += [(k, "unseen pair az ax by unseen") for k in range(63, 90) if zlib.crc32(str(k).encode()) % 10 == 0]
    want, sums = plain(spark, rows)
    assert all(x == pytest.approx(1, abs=1e-5) for x in sums.values())
    for parts in (1, 3):
        made = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = lm_words.lm_word_scores(made, frequent=frequent, most_contexts=contexts, most_pairs=pairs).collect()
        assert {r["doc_id"]: round(r["score"], 3) for r in got} == {i: round(x, 3) for i, x in want.items()}


def test_the_word_before_counts(spark, tmp_path):
    """'in' and 'ran' end alike; what follows them is told apart."""
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    rows = [(k, "in here" if k % 2 else "ran off") for k in range(1000, 1200)]
    rows += [(held[0], "in here in here in here"), (held[1], "in off in off in off")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in op7_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 3


def test_same_counts_and_base(docs, none):
    columns = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    rows = lambda df: sorted(repr(tuple(round(x, 5) if isinstance(x, float) else x for x in (r[c] for c in columns))) for r in df.collect())
    assert rows(lm_words.lm_word_scores(docs, frequent=40, most_contexts=40, most_pairs=40)) == rows(lm_scoring.lm_scores(docs))
    assert lm_words.lm_word_scores(none).count() == 0


def test_tokens_equal_splitting():
    texts = ["", " \t\n", "Ab ÿ\x0bcd\x0c", "日本 🙂\r\n\x00 \xa0x\x85", "a", " \x1cÀ "]
    got = lm_scoring.tokens(texts)
    want = [[*(w.lower() if w.isascii() else w for w in t.encode().translate(lm_scoring._LOWER).decode().replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w), None] for t in texts]
    assert got.hashes[got.codes].tolist() == [hashed(w) for t in want for w in t]
    assert got.context.tolist() == [klass(w) for t in want for w in [None, *t[:-1]]]
    assert got.starts.tolist() == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_pairs_lie_by_token_and_meet_once(spark, tmp_path):
    """What the disk holds is less so: equal tokens lie side by side, and their counts are dealt out once."""
    rng = np.random.default_rng(3)
    rows = [(False, " ".join(map(str, rng.integers(0, 30, 200)))) for _ in range(40)]
    lm_words.pairs(spark.createDataFrame(rows, "held_out boolean, text string")).write.parquet(str(tmp_path / "pairs"))
    made = spark.read.parquet(str(tmp_path / "pairs"))
    assert all(r["w"] == sorted(r["w"]) for r in made.select("w").collect())
    words = lm_words.vocabulary(made)
    assert words._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    c = Counter(w for _, t in rows for w in [*t.split(), None])
    assert {r["w"]: r["c"] for r in words.collect()} == {hashed(w): n for w, n in c.items()}


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = 0
    while files.hasNext():
        found += files.next().getName().startswith("shuffle_")
    return found


def test_no_shuffle_files_stay(spark, docs):
    """Disk holds one query's shuffles at a time; the session's setting is as it was."""
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    kept = spark.conf.get(key, "false")
    found = lm_words.lm_word_scores(docs, frequent=40, most_contexts=40, most_pairs=40)
    assert shuffle_files(spark) <= before and spark.conf.get(key, "false") == kept
    assert found.count() == docs.count()


def test_occurrences_meet_marked_pairs_packed(spark):
    rng = np.random.default_rng(2)
    h, row = rng.integers(-(2**62), 2**62, 50), rng.integers(0, 9, 400) + (rng.integers(0, 3, 400) << 33)
    which = rng.integers(0, 50, 400)
    at = lambda x: x.view(np.uint64) % 4
    scores = [(int(k), h[at(h) == k].tobytes(), np.arange(50)[at(h) == k].tobytes(), np.arange(50, dtype=np.float32)[at(h) == k].tobytes()) for k in range(4)]
    met = [(int(k), row[part].tobytes(), h[which][part].tobytes()) for k in range(4) for half in (0, 1) for part in [(at(h[which]) == k) & (np.arange(400) % 2 == half)]]
    state = lm_scoring.State(50, 2000, np.zeros(0), 0.5, 0.5, np.zeros(0), 0.0)
    got = lm_words.pair_sums(spark.createDataFrame(met, "at int, rows binary, h binary"), spark.createDataFrame(scores, "at int, h binary, count binary, score binary"), state)
    base = lm_scoring.base_score(which.astype(float), state)
    want = {int(r): (int((which[row == r] > 0).sum()), pytest.approx(base[row == r].sum()), float(which[row == r].sum())) for r in set(row)}
    assert {r["row"]: tuple(r)[1:] for r in got.collect()} == want
