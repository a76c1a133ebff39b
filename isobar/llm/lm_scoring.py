"""Language-model scores by a hierarchical Pitman-Yor model.

A token's context is the class of the character before it (that which ends the
previous word, or the start of the text).  Each context is a restaurant; all share
the parent restaurant of single tokens, whose base is uniform over the known
tokens and one unknown.  Customers are the corpus counts: every training text is
counted, in sums that are pre-aggregated by Spark.

Tables are sampled by Gibbs sweeps over blocks: given how many tables each
restaurant has, the customers of one token are seated anew, in every context and
then in the parent.  Blocks are independent, so a sweep is one pass over the
vocabulary, and only the tables of each restaurant (a few dozen sums) go from
pass to pass.  Chance is a hash of the token, the context, the sweep and the customer,
so that samples don't depend on how rows lie in files or batches, and the pass that
adds up the kept samples' tables and the pass that turns them into probabilities see
the same ones; each sample's predictive probabilities add up to one.  Probabilities are
averaged over the samples.

Scoring looks tokens up in two ways.  The ``FREQUENT`` commonest tokens' scores
are broadcast as a table of bounded size; the other occurrences meet the model in
a join on the token.

Cases: null and empty texts are one end token; a null id is not held out; without
training texts every token is unknown and has the base probability; repeated rows
are counted and scored each; an empty table gives an empty result; columns besides
doc_id and text are ignored.  Tokens are told apart by 58 bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import groups
from .common import LOWER, UPPER, Written, fold, whole

#: Contexts: start, a to z, digits, other ASCII, and last bytes of other characters.
CONTEXTS = 45
#: Tokens whose scores are broadcast (a float for each context of each).
FREQUENT = 100_000
#: Sweeps that are not kept and that are, and passes that settle the tables.
BURN, KEPT, SETTLE = 1, 3, 1
#: Customers seated one by one; those beyond are seated in runs that double.
SINGLY = 32
#: Strength of the contexts' restaurants and of their parent.
STRENGTH = 1.0
BASE_ADD = 0.1

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
END = b" "  # no word has a space


def _classes() -> np.ndarray:
    table = np.full(256, 28, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = 27
    table[128:] = 29 + (np.arange(128, 256) & 15)
    return table


CLASS = _classes()
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass
class Tokens:
    """The tokens of some texts: which, in what context, and where texts begin."""

    codes: np.ndarray
    hashes: np.ndarray  # of each code
    context: np.ndarray
    starts: np.ndarray


def tokens(texts: list[str]) -> Tokens:
    joined = b" \xff ".join([*(text.encode() for text in texts), b""])  # no byte of UTF-8 is FF
    data = np.frombuffer(joined.translate(_LOWER), np.uint8)
    inside = ~SPACE[data]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(data[first] == 0xFF)
    kept = data[inside]
    bounds = np.append(np.cumsum(inside)[first] - 1, len(kept)).astype(np.int32)
    kept[bounds[ends]] = END[0]
    coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    context = np.concatenate([[0], CLASS[kept[bounds[1:] - 1]][:-1]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    context[starts] = 0
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct, repeat(42)), np.uint64, len(distinct)) >> np.uint64(6)
    return Tokens(coded.indices.to_numpy(), hashes.view(np.int64), context, starts)


def counts(docs: DataFrame) -> DataFrame:
    """w, c, context, n: each token's count, and its counts by context."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in groups(batch.column(0)):
                t = tokens(run)
                key, n = np.unique(t.hashes[t.codes] * 64 + t.context, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    pairs = docs.select(whole().alias("text")).mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    by_token = pairs.select(F.shiftrightunsigned("key", 6).alias("w"), F.struct(F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("context"), "n").alias("x"))
    rows = by_token.groupBy("w").agg(F.sort_array(F.collect_list("x")).alias("x"))  # a row a context: 45 at most
    return rows.select("w", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("c"), F.col("x.context").alias("context"), F.col("x.n").alias("n"))


def chance(keys: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform numbers between 0 and 1 for keys and salts: two rounds of a mixing
    function of 64 bits for each salt."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for salt in salts:
            x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


#: Expected successes up to which a binomial number is found by adding up its terms.
TERMS = 60


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The u-quantile of n trials with chance p; where many are expected, a normal
    number of the same mean and spread from u and v."""
    p = np.clip(p, 0.0, 1 - 1e-12)
    mean = n * p
    normal = np.round(mean + np.sqrt(mean * (1 - p)) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    out = np.clip(normal, 0, n)
    few = np.flatnonzero(mean <= TERMS)
    n, p, u = n[few].astype(float), p[few], u[few]
    term = np.exp(n * np.log1p(-p))
    below, k = np.zeros(len(few)), np.zeros(len(few))
    on = np.arange(len(few))
    while len(on):
        below[on] += term[on]
        on = on[(below[on] < u[on]) & (k[on] < n[on])]
        term[on] *= (n[on] - k[on]) / (k[on] + 1) * p[on] / (1 - p[on])
        k[on] += 1
        on = on[term[on] > 0]
    out[few] = k
    return out


def seat(customers: np.ndarray, new: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables taken by each token's customers, who sit down one after another: at
    a new table with weight ``new``, at those of their token with their number less
    the discount for each table.  keys tell the (token, context) pairs apart."""
    out = np.minimum(customers, 1).astype(np.float64)
    several = np.flatnonzero(customers > 1)
    order = several[np.argsort(-customers[several], kind="stable")]
    c, w, keys = customers[order], new[order], keys[order]
    tables = np.ones(len(order))
    n, size = 1, 1
    while n < (c[0] if len(c) else 0):
        active = int(np.searchsorted(-c, -n, side="left"))  # those with more than n
        size = 1 if n < SINGLY else n
        some = np.minimum(c[:active] - n, size)
        old = n + (some - 1) / 2 - discount * tables[:active]
        p = w[:active] / (w[:active] + np.maximum(old, 1e-9))
        u = chance(keys[:active], sweep, n)
        tables[:active] += u < p if size == 1 else binomial(some, p, u, chance(keys[:active], sweep, n, 1))
        n += size
    out[order] = tables
    return out


@dataclass
class State:
    """What the blocks share."""

    vocabulary: int
    total: int  # training tokens
    customers: np.ndarray  # of each context
    discount: float  # of the contexts
    root_discount: float
    tables: np.ndarray  # of each context, driving the sweeps
    root_tables: float
    samples: list[tuple[np.ndarray, float]] = field(default_factory=list)  # tables of the kept samples

    def behind(self, tables: np.ndarray) -> np.ndarray:
        """The share of each context's probability that its parent deals out."""
        return (STRENGTH + self.discount * tables) / (STRENGTH + self.customers)

    def unknown(self, sample: tuple[np.ndarray, float]) -> float:
        """The parent's probability of a token that it has not seen."""
        return (STRENGTH + self.root_discount * sample[1]) / (STRENGTH + sample[0].sum()) / (self.vocabulary + 1)


def sweeps(state: State, w: np.ndarray, row: np.ndarray, context: np.ndarray, n: np.ndarray, kept: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of each (token, context) and of each token in the parent, and the
    parent's customers, for the kept samples.  row: the pair's token in w."""
    token = w.astype(np.uint64) << np.uint64(6)  # contexts are below 63, which is the parent's
    pair, parent = token[row] | context.astype(np.uint64), token | np.uint64(63)
    root_total = state.tables.sum()
    fresh = (STRENGTH + state.root_discount * state.root_tables) / (STRENGTH + root_total) / (state.vocabulary + 1)
    weight = STRENGTH + state.discount * state.tables
    arrivals = np.bincount(row, minlength=len(w)).astype(np.float64)
    tables = np.ones(len(w))
    for sweep in range(BURN + kept):
        root = np.maximum(arrivals - state.root_discount * tables, 0) / (STRENGTH + root_total) + fresh
        own = seat(n, weight[context] * root[row], state.discount, pair, sweep)
        arrivals = np.bincount(row, own, minlength=len(w))
        tables = seat(arrivals.astype(np.int64), np.full(len(w), (STRENGTH + state.root_discount * state.root_tables) / (state.vocabulary + 1)), state.root_discount, parent, sweep)
        if sweep >= BURN:
            yield own, tables, arrivals


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    context = batch.column("context")
    sizes = np.diff(np.array(context.offsets)) if len(batch) else np.zeros(0, np.int64)
    return np.array(batch.column("w")), np.repeat(np.arange(len(batch)), sizes), np.array(context.flatten(), np.int64), np.array(batch.column("n").flatten(), np.int64)


def _sums(vocabulary: DataFrame, state: State, kept: int) -> list[tuple[np.ndarray, float]]:
    """Tables of each context and of the parent in each kept sample, summed."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept, CONTEXTS + 1))
        for batch in batches:
            w, row, context, n = _flat(batch)
            for s, (own, tables, _) in enumerate(sweeps(state, w, row, context, n, kept)):
                total[s, :CONTEXTS] += np.bincount(context, own, minlength=CONTEXTS)
                total[s, CONTEXTS] += tables.sum()
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], names=["s", "k", "tables"])

    found = np.zeros((kept, CONTEXTS + 1))
    for r in vocabulary.mapInArrow(summed, "s long, k long, tables double").groupBy("s", "k").agg(F.sum("tables").alias("tables")).collect():
        found[r["s"], r["k"]] = r["tables"]  # kept x 46 rows
    return [(x[:CONTEXTS], float(x[CONTEXTS])) for x in found]


def fit(vocabulary: DataFrame) -> State:
    """The shared state, with the kept samples' tables."""
    pair = vocabulary.select(F.explode(F.arrays_zip("context", "n")).alias("x")).select("x.context", "x.n")
    customers, types = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
    ones = twos = 0
    for r in pair.groupBy("context").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"), F.count_if(F.col("n") == 1).alias("o"), F.count_if(F.col("n") == 2).alias("d")).collect():
        customers[r["context"]], types[r["context"]] = r["n"], r["t"]
        ones, twos = ones + r["o"], twos + r["d"]
    m = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("o"), F.count_if(F.col("c") == 2).alias("d")).first()
    # Discounts from counts of counts.
    rate = lambda o, d: min(max(o / (o + 2 * d), 0.1), 0.95) if o else 0.5
    state = State(m["v"], m["c"] or 0, customers, rate(ones, twos), rate(m["o"], m["d"]), types, float(m["v"]))
    for _ in range(SETTLE):
        state.tables, state.root_tables = _sums(vocabulary, state, 1)[0]
    state.samples = _sums(vocabulary, state, KEPT)
    return state


def model(vocabulary: DataFrame, state: State) -> DataFrame:
    """w, c, root (the parent's probability in each sample), context, p (averaged
    probability in each context where the token was seen)."""

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, row, context, n = _flat(batch)
            p, roots = np.zeros(len(n)), np.zeros((len(w), KEPT))
            for s, (own, tables, arrivals) in enumerate(sweeps(state, w, row, context, n, KEPT)):
                sample = state.samples[s]
                root = (arrivals - state.root_discount * tables) / (STRENGTH + sample[0].sum()) + state.unknown(sample)
                p += ((n - state.discount * own) / (STRENGTH + state.customers[context]) + state.behind(sample[0])[context] * root[row]) / KEPT
                roots[:, s] = root
            offsets = batch.column("context").offsets.cast(pa.int32())
            first = offsets[0].as_py() if len(offsets) else 0
            ends = pa.array(np.array(offsets) - first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("w"), batch.column("c"), pa.array(list(roots.astype(np.float32)), pa.list_(pa.float32())),
                 pa.ListArray.from_arrays(ends, pa.array(context.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(p.astype(np.float32)))],
                names=["w", "c", "root", "context", "p"],
            )

    return vocabulary.mapInArrow(averaged, "w long, c long, root array<float>, context array<int>, p array<float>")


@dataclass
class Common:
    """Scores of the commonest tokens: base by token, log10 p by token and context."""

    hashes: np.ndarray
    base: np.ndarray
    score: np.ndarray


def common(rows: pd.DataFrame, state: State) -> Common:
    rows = rows.sort_values("w", ignore_index=True)
    behind = np.array([state.behind(s[0]) for s in state.samples])  # sample, context
    roots = np.array(rows["root"].tolist(), float).reshape(len(rows), KEPT)
    p = roots @ behind / KEPT if len(rows) else np.zeros((0, CONTEXTS))
    for k, (context, seen) in enumerate(zip(rows["context"], rows["p"], strict=True)):  # FREQUENT rows
        p[k, context] = seen
    return Common(rows["w"].to_numpy(np.int64), base_score(rows["c"].to_numpy(np.float64), state), np.log10(p).astype(np.float32))


def base_score(c: np.ndarray, state: State) -> np.ndarray:
    return np.log10((c + BASE_ADD) / (state.total + BASE_ADD * (state.vocabulary + 1)))


def least_count(made: DataFrame, most: int, rows: Column | None = None) -> int:
    """A count that at most ``most`` tokens reach, close to the largest such number
    of tokens: from a histogram of sixteen bins to a doubling.  rows: how many a row stands
    for, summed."""
    bins = made.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg((F.count(F.lit(1)) if rows is None else rows).alias("n"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect()
    reached, least = 0, 1 << 62
    for r in bins:  # a thousand at most
        reached += r["n"]
        if reached > most:
            break
        least = r["c"]
    return least


def lm_scores(docs: DataFrame, divisor: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    marked = docs.select("doc_id", fold("doc_id", divisor).alias("held_out"), whole().alias("text"))
    vocabulary = Written(counts(marked.where(~F.col("held_out"))), "vocabulary")
    state = fit(vocabulary.df)
    made = Written(model(vocabulary.df, state), "model")
    vocabulary.drop()
    top = made.df.where(F.col("c") >= least_count(made.df, frequent))  # ``frequent`` rows of a few hundred bytes at most
    table = spark.sparkContext.broadcast(common(top.toPandas(), state))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Common = table.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for run in groups(batch.column(2)):
                t = tokens(run)
                at = np.minimum(np.searchsorted(known.hashes, t.hashes), max(len(known.hashes) - 1, 0))
                hit = known.hashes[at] == t.hashes if len(known.hashes) else np.zeros(len(at), bool)
                is_hit, at = hit[t.codes], at[t.codes]
                base, score = np.zeros(len(at)), np.zeros(len(at))
                base[is_hit], score[is_hit] = known.base[at[is_hit]], known.score[at[is_hit], t.context[is_hit]]
                add = lambda x, t=t: np.add.reduceat(x, t.starts)
                rare = ~is_hit
                ends = pa.array(np.concatenate([[0], np.cumsum(add(rare.astype(np.int64)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(run))), batch.column(0)[done : done + len(run)], batch.column(1)[done : done + len(run)],
                     pa.array(np.diff(np.append(t.starts, len(at)))), pa.array(add(is_hit.astype(np.int64))), pa.array(add(base)), pa.array(add(score)),
                     pa.ListArray.from_arrays(ends, pa.array(t.hashes[t.codes][rare])), pa.ListArray.from_arrays(ends, pa.array(t.context[rare].astype(np.int32)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "w", "context"],
                )
                row, done = row + len(run), done + len(run)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, w array<long>, context array<int>"
    part = Written(marked.mapInArrow(scored, schema), "scored").df
    rare = part.select("row", F.explode(F.arrays_zip("w", "context")).alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.context").alias("at"))
    met = rare.join(made.df, "w", "left").select("row", F.col("c").isNotNull().cast("long").alias("known"), _base(state).alias("base"), F.log10(_probability(state)).alias("score"))
    rest = met.groupBy("row").agg(*[F.sum(x).alias(f"r_{x}") for x in ("known", "base", "score")])
    both = part.drop("w", "context").join(rest, "row", "left")
    whole_ = lambda x, zero: F.col(x) + F.coalesce(f"r_{x}", F.lit(zero))
    return both.select(
        "doc_id", "held_out", "n_tokens", whole_("known", 0).alias("n_known"), F.lit(state.total).cast("long").alias("train_tokens"),
        whole_("base", 0.0).alias("base_score"), whole_("score", 0.0).alias("score"),
    )


def _base(state: State) -> Column:
    return F.log10((F.coalesce("c", F.lit(0)) + F.lit(BASE_ADD)) / F.lit(state.total + BASE_ADD * (state.vocabulary + 1)))


def _probability(state: State) -> Column:
    """A token's probability in the context ``at``, from its row of the model or none."""
    by_context = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("at") + 1)
    parts = [by_context(state.behind(s[0]) / KEPT) * F.coalesce(F.col("root")[k].cast("double"), F.lit(state.unknown(s))) for k, s in enumerate(state.samples)]
    unseen = sum(parts[1:], parts[0])
    place = F.coalesce(F.array_position("context", F.col("at")), F.lit(0)).cast("int")
    return F.when(place > 0, F.try_element_at("p", F.greatest(place, F.lit(1))).cast("double")).otherwise(unseen)


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, tokens, and the perplexities of the model and of the base."""
    mean = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), mean("score").alias("perplexity"), mean("base_score").alias("base_perplexity"))
