"""Language-model scores with a restaurant for every previous word.

Three levels of Pitman-Yor restaurants: a token's context is the word before it; its
parent is the class of that word's last character, whose parent is that of single
tokens (``lm_scoring``).  Every word that was met is a restaurant, however rare.  Before
the start of a text stands the end token, which no other token follows.

Pairs of (context, token) are counted in packed buckets of their hash.  Customers of the
upper levels are the tables of the words' restaurants.  A pair met once has one table, so
tables are only sampled for those met more often: ``customers - tables`` of these is what
a context or a class has fewer tables than customers.  ``SWEEPS`` times the upper levels
are fitted to the tables (with their own Gibbs sweeps) and the customers of each pair are
seated anew given the upper levels and the tables of their context; then the upper
levels are fitted once more.  A context's probabilities add up to one whatever its tables.

Scoring needs to know a pair's count.  Pairs met twice or more in training, or once there
and in the held-out texts, are marked in a bitmap of fixed size, and all pairs that
share a mark are written with their scores.  So an unmarked pair of a training text was met
once, of a held-out text never, exactly; its probability only needs its context's tables
and the class's probability.  The commonest tokens, contexts and pairs are broadcast in
tables of bounded size; the other occurrences meet theirs in joins.  Pairs whose token and
context are both among the commonest are seated and scored by these tables alone, before
any join; marked pairs lie packed in groups by their hash, where the occurrences meet them.

Cases: those of ``lm_scoring``.  Pairs are told apart by 64 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import groups
from .collocations import mixed
from .common import Written, collected, fold, shuffles_removed, whole
from .lm_scoring import END, STRENGTH, Common, State, Tokens, _base, _probability, base_score, fit, least_count, model, seat, tokens

#: Commonest tokens, contexts and pairs that are broadcast.
FREQUENT, CONTEXTS, PAIRS = 40_000, 300_000, 400_000
#: Times that the pairs' customers are seated.
SWEEPS = 1
#: Buckets in which pairs are counted, and the bits of a bucket's share of the bitmap (16 MB).
BUCKETS, SHARE = 2048, 1 << 16
#: Buckets that a token's pairs are dealt out to, and parts in which tokens of a bucket are counted.
DEALT, PARTS = 16, 16
#: Pairs and their occurrences meet in groups of about so many pairs.
GROUP = 200_000
#: Pairs that a task holds before they are sent.
HELD_PAIRS = 2_000_000
#: Marks a count of a held-out text.
HELD = 1 << 40
END_HASH = xxhash.xxh64_intdigest(END, 42) >> 6


def pair_hash(w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mixed(w.view(np.uint64), ctx.view(np.uint64))


def bucket_of(w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """By the token and four bits of its context, so that hot tokens are dealt out."""
    return ((w & BUCKETS // DEALT - 1) * DEALT + (ctx >> 6 & DEALT - 1)).astype(np.int32)


def contexts(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: a number for its pair, and its context (hash of the word before, and
    in the last six bits the class)."""
    end = int(np.flatnonzero(t.hashes == END_HASH)[0])
    before = np.concatenate([[end], t.codes[:-1]]).astype(np.int64)
    ctx = (t.hashes[before].view(np.uint64) << np.uint64(6) | t.context.astype(np.uint64)).view(np.int64)
    return before * len(t.hashes) + t.codes, ctx


def merged(w: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and their counts, HELD added if held-out texts have them."""
    h = pair_hash(w, ctx)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first) if len(h) else n
    return w[order[first]], ctx[order[first]], (total & HELD - 1) | np.where(total >= HELD, HELD, 0)


def _bytes(first: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Of ordered values, a row of bytes for each run; first: where runs begin."""
    out = []
    for v in values:
        ends = pa.array((np.append(first, len(v)) * v.itemsize).astype(np.int32))
        out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(v))]))
    return out


def _numbers(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    """The numbers of all rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _lists(ends: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    ends = pa.array(ends.astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def pairs(docs: DataFrame) -> DataFrame:
    """From held_out and text, a row a bucket: bits, w, ctx, n (pairs of marked bits and their
    training counts), key, count, types (training counts of token and class, and in how many
    pairs, as bytes in parts by token), ones, twos (pairs met so often)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            w, ctx, n = map(np.concatenate, zip(*held, strict=True))
            bucket, h = bucket_of(w, ctx), pair_hash(w, ctx)
            # By bucket, and there by token, which compresses; pairs that such an order parts meet in ``counted``.
            order = np.argsort(bucket.astype(np.uint64) << np.uint64(53) | (w.view(np.uint64) & np.uint64(0x7FFFFFF)) << np.uint64(26) | h >> np.uint64(38))
            w, ctx, n, bucket = w[order], ctx[order], n[order], bucket[order]
            one = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (ctx[1:] != ctx[:-1])]))
            n = np.add.reduceat(n, one)
            w, ctx, n, bucket = w[one], ctx[one], (n & HELD - 1) | np.where(n >= HELD, HELD, 0), bucket[one]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *_bytes(first, w, ctx, n)], names=["bucket", "w", "ctx", "n"])

        for batch in batches:
            done, out = 0, np.array(batch.column(0), bool)
            for run in groups(batch.column(1)):
                t = tokens(run)
                number, ctx = contexts(t)
                of_text = np.repeat(out[done : done + len(run)], np.diff(np.append(t.starts, len(number))))
                _, at, n = np.unique(number * 2 + of_text, return_index=True, return_counts=True)
                held.append((t.hashes[t.codes[at]], ctx[at], np.where(of_text[at], HELD, n)))
                done += len(run)
                if sum(len(x[0]) for x in held) >= HELD_PAIRS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    def counted(table: pa.Table) -> pa.Table:
        w, ctx, n = merged(*(_numbers(table.column(c)) for c in ("w", "ctx", "n")))
        mark = (pair_hash(w, ctx) % np.uint64(SHARE)).astype(np.int64)
        n, out = n & HELD - 1, n >= HELD
        bits = np.zeros(SHARE, bool)
        bits[mark[(n > 1) | (n == 1) & out]] = True
        kept = np.flatnonzero(bits[mark])
        kept = kept[np.argsort(w[kept])]
        key = (w.view(np.uint64) << np.uint64(6) | ctx.view(np.uint64) & np.uint64(63)).view(np.int64)[n > 0]
        part = (key.view(np.uint64) >> np.uint64(6)) // np.uint64(BUCKETS // DEALT) % np.uint64(PARTS)
        order = np.lexsort((key, part))
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
        count, types = (np.add.reduceat(x, first) if len(key) else key for x in (n[n > 0][order], np.ones(len(key), np.int64)))
        of_part = np.searchsorted(part[order[first]], np.arange(PARTS, dtype=np.uint64))
        packed = [pa.ListArray.from_arrays(pa.array([0, PARTS], pa.int32()), x) for x in _bytes(of_part, key[order[first]], count, types)]
        made = {
            "bucket": table.column("bucket").slice(0, 1).combine_chunks(), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            **{c: pa.array([v[kept]], pa.list_(pa.int64())) for c, v in (("w", w), ("ctx", ctx), ("n", n))},
            **dict(zip(("key", "count", "types"), packed, strict=True)),
            "ones": pa.array([int((n == 1).sum())]), "twos": pa.array([int((n == 2).sum())]),
        }
        return pa.table(made)

    packed = docs.select("held_out", whole().alias("text")).mapInArrow(tally, "bucket int, w binary, ctx binary, n binary")
    return packed.groupBy("bucket").applyInArrow(counted, "bucket int, bits binary, w array<long>, ctx array<long>, n array<long>, key array<binary>, count array<binary>, types array<binary>, ones long, twos long")


def bitmap(made: DataFrame) -> np.ndarray:
    bits = np.zeros((BUCKETS, SHARE // 8), np.uint8)
    for bucket, some in made.select("bucket", "bits").toLocalIterator():  # 8 kB each
        bits[bucket] = np.frombuffer(bytes(some), np.uint8)
    return bits.ravel()


def marked(bits: np.ndarray, w: np.ndarray, ctx: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bucket_of(w, ctx).astype(np.int64) * SHARE + (h % np.uint64(SHARE)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def _before(ctx: str = "ctx") -> Column:
    return F.shiftrightunsigned(ctx, 6)


def vocabulary(made: DataFrame) -> DataFrame:
    """w, c, context, n, types: each token's training count, and by class its count and in how
    many pairs it is."""

    def counted(table: pa.Table) -> pa.Table:
        key, n, types = (_numbers(table.column(c)) for c in ("key", "count", "types"))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        n, types, key = np.add.reduceat(n[order], first) if len(key) else n, np.add.reduceat(types[order], first) if len(key) else types, key[first]
        w = (key.view(np.uint64) >> np.uint64(6)).view(np.int64)
        of_token = np.flatnonzero(np.diff(w, prepend=-1))
        lists = _lists(np.append(of_token, len(w)), (key & 63).astype(np.int32), n, types)
        return pa.table([pa.array(w[of_token]), pa.array(np.add.reduceat(n, of_token) if len(n) else n), *lists], ["w", "c", "context", "n", "types"])

    each = made.select(F.floor(F.col("bucket") / DEALT).alias("tokens"), F.posexplode(F.arrays_zip("key", "count", "types")).alias("part", "y"))
    return each.select("tokens", "part", "y.key", "y.count", "y.types").groupBy("tokens", "part").applyInArrow(counted, "w long, c long, context array<int>, n array<long>, types array<long>")


def with_tables(words: DataFrame, seated: DataFrame, first: bool) -> DataFrame:
    """w, c, context, n (customers of the class's restaurant: tables of words of the class), t
    (tables of the word's own restaurant).  At first every pair has one table."""
    less = seated.where("n > t").select("w", "ctx", (F.col("n") - F.col("t")).alias("less"))
    of_word = less.groupBy(_before().alias("w")).agg(F.sum("less").alias("own"))
    found, n = words.join(of_word, "w", "left"), F.col("types")
    if not first:
        by_class = less.groupBy("w", F.col("ctx").bitwiseAND(F.lit(63)).cast("int").alias("at")).agg(F.sum("less").alias("less"))
        of_token = by_class.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("at", "less"))).alias("by"))
        found = found.join(of_token, "w", "left")
        n = F.transform(F.arrays_zip("context", "n"), lambda y: y["n"] - F.coalesce(F.try_element_at("by", y["context"]), F.lit(0)))
    return found.select("w", "c", "context", n.alias("n"), (F.col("c") - F.coalesce("own", F.lit(0))).alias("t"))


@dataclass
class Restaurants:
    """What the words' restaurants share, and their probabilities."""

    discount: float

    def own(self, c: np.ndarray) -> np.ndarray:
        """What a customer less the discount of one table brings, at one table."""
        return (1 - self.discount) / (STRENGTH + c)

    def behind(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The share of a context's probability that its class deals out."""
        return (STRENGTH + self.discount * t) / (STRENGTH + c)


def _met(seated: DataFrame, made: DataFrame, words: DataFrame, state: State) -> DataFrame:
    """The pairs with the class's probability, and the counts of token and context."""
    found = seated.join(made, "w", "left").withColumn("at", F.col("ctx").bitwiseAND(F.lit(63)).cast("int"))
    found = found.select("w", "ctx", "n", "t", _before().alias("before"), F.coalesce("c", F.lit(0)).cast("long").alias("cw"), _probability(state).alias("up"))
    own = words.select(F.col("w").alias("before"), F.col("c").alias("cu"), F.col("t").alias("tu"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    return found.join(own, "before", "left").select("w", "ctx", "n", "t", "cw", "up", zero("cu"), zero("tu"))


@dataclass
class Known:
    """The commonest tokens and contexts, broadcast."""

    words: Common
    count: np.ndarray  # of each common token
    context: np.ndarray  # hashes of the commonest words before, in order
    c: np.ndarray
    t: np.ndarray


def known(made: DataFrame, words: DataFrame, state: State, frequent: int, most_contexts: int) -> Known:
    """Two tables of bounded size: ``frequent`` rows of a few hundred bytes, and 7 MB."""
    top = made.where(F.col("c") >= least_count(made, frequent)).toArrow().combine_chunks()
    before = words.where(F.col("c") >= least_count(words, most_contexts)).select("w", "c", "t").toArrow()
    w, c, t = (before.column(x).to_numpy() for x in ("w", "c", "t"))
    order = np.argsort(w)
    count = top.column("c").to_numpy()[np.argsort(top.column("w").to_numpy())]
    return Known(_common(top, state), count, w[order], c[order], t[order])


def _common(top: pa.Table, state: State) -> Common:
    """``common`` of a table of Arrow."""
    flat = lambda c: top.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    w, c = (top.column(x).to_numpy() for x in ("w", "c"))
    behind = np.array([state.behind(s[0]) for s in state.samples])  # sample, context
    p = flat("root").astype(float).reshape(len(w), len(behind)) @ behind / len(behind)
    row = np.repeat(np.arange(len(w)), np.array(pc.list_value_length(top.column("context")), np.int64))
    p[row, flat("context")] = flat("p")
    order = np.argsort(w)
    return Common(w[order], base_score(c[order].astype(np.float64), state), np.log10(p[order]).astype(np.float32))


def _settled(b: pa.RecordBatch, table: Known) -> tuple[np.ndarray, ...]:
    """Of pairs: whether token and context are known; of these the token's place, w, ctx, n,
    t, the class's probability, and the context's customers and tables."""
    w, ctx, n, t = (np.array(b.column(c)) for c in ("w", "ctx", "n", "t"))
    at, is_common = _found(table.words.hashes, w)
    place, is_near = _found(table.context, ctx >> 6 & (1 << 58) - 1)
    here = is_common & is_near
    at, place, ctx = at[here], place[here], ctx[here]
    return here, at, w[here], ctx, n[here], t[here], 10.0 ** table.words.score[at, ctx & 63], table.c[place].astype(np.float64), table.t[place].astype(np.float64)


def reseated(seated: DataFrame, made: DataFrame, words: DataFrame, state: State, shared: Restaurants, table: Broadcast, sweep: int) -> list[Written]:
    """w, ctx, n, t in two tables: of the known pairs, and of those that a join gives theirs;
    the first one has these too, without t."""

    def anew(w: np.ndarray, ctx: np.ndarray, n: np.ndarray, up: np.ndarray, tu: np.ndarray) -> np.ndarray:
        return seat(n, (STRENGTH + shared.discount * tu) * up, shared.discount, pair_hash(w, ctx), sweep).astype(np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here, _, w, ctx, n, _, up, _, tu = _settled(b, table.value)
            t = np.zeros(len(here), np.int64)
            t[here] = anew(w, ctx, n, up, tu)
            yield pa.RecordBatch.from_arrays([b.column("w"), b.column("ctx"), b.column("n"), pa.array(t, mask=~here), b.column("t")], names=["w", "ctx", "n", "t", "was"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = anew(*(np.array(b.column(c)) for c in ("w", "ctx", "n", "up", "tu")))
            yield pa.RecordBatch.from_arrays([b.column("w"), b.column("ctx"), b.column("n"), pa.array(t)], names=["w", "ctx", "n", "t"])

    first = Written(seated.mapInArrow(near, "w long, ctx long, n long, t long, was long"), "seated")
    left = first.df.where("t is null").select("w", "ctx", "n", F.col("was").alias("t"))
    met = _met(left, made, words, state).select("w", "ctx", "n", "up", "tu")
    return [first, Written(met.mapInArrow(far, "w long, ctx long, n long, t long"), "seated")]


def pair_scores(seated: DataFrame, made: DataFrame, words: DataFrame, state: State, shared: Restaurants, table: Broadcast, spread: int) -> list[Written]:
    """The marked pairs in groups by their hash: h, c (training count), count (of the token),
    score as bytes, in two tables as in ``reseated``."""
    schema = "at int, h binary, c binary, count binary, score binary"

    def packed(w: np.ndarray, ctx: np.ndarray, n: np.ndarray, t: np.ndarray, cw: np.ndarray, up: np.ndarray, cu: np.ndarray, tu: np.ndarray) -> list[pa.Array]:
        h = pair_hash(w, ctx)
        at = (h % np.uint64(spread)).astype(np.int32)
        p = (n - shared.discount * t) / (STRENGTH + cu) + shared.behind(cu, tu) * up
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        return [pa.array(at[order[first]]), *_bytes(first, *(x[order] for x in (h, n, cw, np.log10(p).astype(np.float32))))]

    names = ["at", "h", "c", "count", "score"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here, at, w, ctx, n, t, up, cu, tu = _settled(b, table.value)
            made = packed(w, ctx, n, t, table.value.count[at], up, cu, tu)
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(len(made[0]), pa.int64()) for _ in range(4))], names=[*names, "w", "ctx", "n", "t"])
            left = b.filter(pa.array(~here))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(left), x.type) for x in made] + [left.column(c) for c in ("w", "ctx", "n", "t")], names=[*names, "w", "ctx", "n", "t"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(packed(*(np.array(b.column(c)) for c in ("w", "ctx", "n", "t", "cw", "up", "cu", "tu"))), names=names)

    first = Written(seated.mapInArrow(near, f"{schema}, w long, ctx long, n long, t long"), "scores")
    met = _met(first.df.where("at is null").select("w", "ctx", "n", "t"), made, words, state)
    return [first, Written(met.mapInArrow(far, schema), "scores")]


@dataclass
class Near(Known):
    """The broadcast tables."""

    bits: np.ndarray
    pair: np.ndarray  # hashes of the commonest pairs, in order
    score: np.ndarray


def near(bits: np.ndarray, table: Known, scores: DataFrame, most_pairs: int) -> Near:
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n = np.unique(_numbers(b.column("c")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c[c > 1]), pa.array(n[c > 1])], names=["c", "n"])

    def of_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = _numbers(b.column("c")) >= max(least, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_numbers(b.column("h"))[some]), pa.array(_numbers(b.column("score"), np.float32)[some])], names=["h", "score"])

    least = least_count(scores.select("c").mapInArrow(bins, "c long, n long"), most_pairs, F.sum("n"))
    hot = scores.mapInArrow(of_least, "h long, score float").toArrow()  # 5 MB at most
    h, score = (hot.column(c).to_numpy() for c in ("h", "score"))
    order = np.argsort(h)
    return Near(table.words, table.count, table.context, table.c, table.t, bits, h[order], score[order])


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in an ordered table, and whether the keys are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _local(t: Tokens, known: Near, shared: Restaurants, out: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each token: its context, pair, kind (0 settled here, 1 a marked pair, 2 of a known
    context, 3 other), base and score where settled, the context's shares, and the class's
    probability if the token is common (else 0)."""
    number, ctx = contexts(t)
    _, first, back = np.unique(number, return_index=True, return_inverse=True)
    code, ctx_, klass = t.codes[first], ctx[first], t.context[first]
    w = t.hashes[code]
    at, is_common = (x[code] for x in _found(known.words.hashes, t.hashes))
    h = pair_hash(w, ctx_)
    mark = marked(known.bits, w, ctx_, h)
    end = len(t.hashes)
    place, is_near = (x[number[first] // end] for x in _found(known.context, t.hashes))
    kind = np.where(mark, 1, np.where(is_near, np.where(is_common, 0, 2), 3))
    score = np.zeros((2, len(w)))
    base = np.zeros(len(w))
    cu, tu = (x[place].astype(np.float64) if len(x) else np.zeros(len(place)) for x in (known.c, known.t))
    own, behind = shared.own(cu).astype(np.float32), shared.behind(cu, tu).astype(np.float32)
    common_up = np.zeros(len(w), np.float32)
    there = np.flatnonzero((kind == 3) & is_common)
    base[there] = known.words.base[at[there]]
    common_up[there] = 10.0 ** known.words.score[at[there], klass[there]]
    here = np.flatnonzero(kind == 0)
    up = behind[here] * 10.0 ** known.words.score[at[here], klass[here]]
    score[0, here], score[1, here] = np.log10(own[here] + up), np.log10(up)
    some = np.flatnonzero(mark & is_common)
    pair, hot = _found(known.pair, h[some].view(np.int64))
    kind[some[hot]] = 0
    score[:, some[hot]] = known.score[pair[hot]]
    settled = kind == 0
    base[settled] = known.words.base[at[settled]]
    return ctx, h.view(np.int64)[back], kind[back], base[back], score[out.astype(int), back], own[back], behind[back], common_up[back]


def pair_sums(met: DataFrame, scores: DataFrame, state: State) -> DataFrame:
    """row, known, base, score: sums over the rows' occurrences of marked pairs; both tables lie
    in groups by hash, and sums go on in groups by the rows' partition."""
    names = ["known", "base", "score"]

    def by_row(rows: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        which, back = np.unique(rows, return_inverse=True)
        return [which, *(np.bincount(back, v, len(which)) for v in values)]

    def looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, h, key = _numbers(left.column("rows")), _numbers(left.column("h")), _numbers(right.column("h"))
        order = np.argsort(key)
        at, found = _found(key[order], h)
        at = order[at[found]]
        count = _numbers(right.column("count"))[at]
        which, *values = by_row(rows[found], count > 0, base_score(count.astype(np.float64), state), _numbers(right.column("score"), np.float32)[at])
        part = which >> 33
        first = np.flatnonzero(np.diff(part, prepend=-1))
        return pa.table([pa.array(part[first]), *_bytes(first, which, *values)], ["part", "rows", *names])

    def added(table: pa.Table) -> pa.Table:
        which, known, base, score = by_row(*(_numbers(table.column(c), k) for c, k in (("rows", np.int64), *((c, np.float64) for c in names))))
        return pa.table([which, known.astype(np.int64), base, score], ["row", *names])

    each = met.groupBy("at").cogroup(scores.groupBy("at")).applyInArrow(looked_up, "part long, rows binary, known binary, base binary, score binary")
    return each.groupBy("part").applyInArrow(added, "row long, known long, base double, score double")


#: What the scoring pass gives, a row a document or a group of occurrences; doc_id is of its own type.
_LONGS, _FLOATS = pa.list_(pa.int64()), pa.list_(pa.float32())
FIELDS = [
    ("row", pa.int64()), ("doc_id", None), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ("w", _LONGS), ("at", pa.list_(pa.int32())), ("own", _FLOATS), ("behind", _FLOATS), ("w3", _LONGS), ("ctx", _LONGS), ("up", _FLOATS),
    ("group", pa.int32()), ("rows", pa.binary()), ("h", pa.binary()),
]


def lm_word_scores(docs: DataFrame, divisor: int = 10, frequent: int = FREQUENT, most_contexts: int = CONTEXTS, most_pairs: int = PAIRS, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with shuffles_removed(docs.sparkSession):
        return _scores(docs, divisor, frequent, most_contexts, most_pairs, sweeps)


def _scores(docs: DataFrame, divisor: int, frequent: int, most_contexts: int, most_pairs: int, sweeps: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", fold("doc_id", divisor).alias("held_out"), whole().alias("text"))
    counts = Written(pairs(rows), "pairs")
    bits = bitmap(counts.df)
    m = counts.df.agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("o"), F.coalesce(F.sum("twos"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("p")).first()
    shared = Restaurants(min(max(m["o"] / (m["o"] + 2 * m["d"]), 0.1), 0.95) if m["o"] else 0.5)
    spread = max(16, m["p"] // GROUP)
    words = Written(vocabulary(counts.df), "words")
    tables = F.least("n", F.lit(1)).cast("long").alias("t")
    seated = [Written(counts.df.select(F.explode(F.arrays_zip("w", "ctx", "n")).alias("x")).select("x.w", "x.ctx", "x.n").select("w", "ctx", "n", tables), "seated")]
    counts.drop()
    of_all = lambda some: reduce(DataFrame.unionByName, [x.df.where("t is not null").select("w", "ctx", "n", "t") for x in some])
    for sweep in range(sweeps + 1):
        full = Written(with_tables(words.df, of_all(seated), sweep == 0), "tables")
        state = fit(full.df)
        made = Written(model(full.df, state), "model")
        table = known(made.df, full.df, state, frequent, most_contexts)
        if sweep == sweeps:
            break
        near_table = spark.sparkContext.broadcast(table)
        anew = reseated(of_all(seated), made.df, full.df, state, shared, near_table, sweep)
        near_table.destroy()
        for old in (*seated, full, made):
            old.drop()
        seated = anew
        collected(spark)
    words.drop()
    near_table = spark.sparkContext.broadcast(table)
    scores = pair_scores(of_all(seated), made.df, full.df, state, shared, near_table, spread)
    near_table.destroy()
    for old in seated:
        old.drop()
    collected(spark)
    packed = reduce(DataFrame.unionByName, [x.df.where("at is not null").select("at", "h", "c", "count", "score") for x in scores])
    table = spark.sparkContext.broadcast(near(bits, table, packed, most_pairs))
    collected(spark)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        met: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            which, h = map(np.concatenate, zip(*met, strict=True))
            met.clear()
            at = (h.view(np.uint64) % np.uint64(spread)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            columns = dict(zip(("group", "rows", "h"), [pa.array(at[order[first]]), *_bytes(first, which[order], h[order])], strict=True))
            return pa.RecordBatch.from_arrays([columns.get(c.name, pa.nulls(len(first), c.type)) for c in fields], schema=fields)

        for batch in batches:
            done, held = 0, np.array(batch.column(1), bool)
            fields = pa.schema([(n, k or batch.column(0).type) for n, k in FIELDS])
            for run in groups(batch.column(2)):
                t = tokens(run)
                sizes = np.diff(np.append(t.starts, len(t.codes)))
                out = np.repeat(held[done : done + len(run)], sizes)
                ctx, h, kind, base, score, own, behind, up = _local(t, table.value, shared, out)
                add = lambda x, t=t: np.add.reduceat(x, t.starts)
                numbers = row + np.arange(len(run))
                pair = kind == 1
                met.append((np.repeat(numbers, sizes)[pair], h[pair]))
                if sum(len(x[0]) for x in met) >= HELD_PAIRS:
                    yield sent()
                lists: list[pa.Array] = []
                w = t.hashes[t.codes]
                for k, values in ((2, (w, t.context.astype(np.int32), np.where(out, np.float32(0), own), behind)), (3, (w, ctx, up))):
                    some = kind == k
                    lists += _lists(np.concatenate([[0], np.cumsum(add(some.astype(np.int64)))]), *(v[some] for v in values))
                made = [pa.array(numbers), batch.column(0)[done : done + len(run)], batch.column(1)[done : done + len(run)], pa.array(sizes), pa.array(add(((kind == 0) | (up > 0)).astype(np.int64))), pa.array(add(base)), pa.array(add(score)), *lists]
                yield pa.RecordBatch.from_arrays(made + [pa.nulls(len(run), fields.field(c).type) for c in ("group", "rows", "h")], schema=fields)
                row, done = row + len(run), done + len(run)
        if met:
            yield sent()

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, w array<long>, at array<int>, own array<float>, behind array<float>, w3 array<long>, ctx array<long>, up array<float>, group int, rows binary, h binary"
    written = Written(rows.mapInArrow(scored, schema), "scored")
    part = written.df.where("group is null")
    sums = lambda df: df.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("known", "base", "score")])
    # Each of the joins is written as its sums, so that the shuffles of one at a time are on disk.
    of_pair = Written(pair_sums(written.df.where("group is not null").select(F.col("group").alias("at"), "rows", "h"), packed.drop("c"), state), "of_pair")
    for old in scores:
        old.drop()
    two = part.select("row", F.explode(F.arrays_zip("w", "at", "own", "behind")).alias("x")).select("row", "x.w", "x.at", "x.own", "x.behind")
    other = part.select("row", F.col("held_out"), F.explode(F.arrays_zip(F.col("w3").alias("w"), "ctx", F.col("up").alias("up"))).alias("x")).select("row", "held_out", F.col("x.w").alias("w"), F.col("x.up").alias("up"), F.col("x.ctx").bitwiseAND(F.lit(63)).cast("int").alias("at"), _before("x.ctx").alias("before"))
    c, t = (F.coalesce(x, F.lit(0)) for x in ("cu", "tu"))
    own = F.when(F.col("held_out"), 0.0).otherwise((1 - shared.discount) / (STRENGTH + c)).cast("float").alias("own")
    behind = ((STRENGTH + shared.discount * t) / (STRENGTH + c)).cast("float").alias("behind")
    three = other.join(full.df.select(F.col("w").alias("before"), F.col("c").alias("cu"), F.col("t").alias("tu")), "before", "left").select("row", "w", "at", own, behind, "up")
    three = Written(three, "three")
    # Common tokens, whose class's probability was known, don't meet the model, where they would be hot keys.
    of_common = three.df.where("up > 0").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.log10(F.col("own") + F.col("behind") * F.col("up").cast("double")).alias("score"))
    single = two.unionByName(three.df.where("up = 0").drop("up")).join(made.df, "w", "left")
    of_class = single.select("row", F.col("c").isNotNull().cast("long").alias("known"), _base(state).alias("base"), F.log10(F.col("own") + F.col("behind") * _probability(state)).alias("score"))
    of_single = Written(sums(of_class.unionByName(of_common)), "of_single")
    three.drop()
    full.drop()
    made.drop()
    rest = sums(of_pair.df.unionByName(of_single.df))
    both = part.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(rest.select("row", *[F.col(x).alias(f"r_{x}") for x in ("known", "base", "score")]), "row", "left")
    whole_ = lambda x, zero: F.col(x) + F.coalesce(f"r_{x}", F.lit(zero))
    return both.select(
        "doc_id", "held_out", "n_tokens", whole_("known", 0).alias("n_known"), F.lit(state.total).cast("long").alias("train_tokens"),
        whole_("base", 0.0).alias("base_score"), whole_("score", 0.0).alias("score"),
    )
