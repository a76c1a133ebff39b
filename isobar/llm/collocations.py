"""Phrase collocations from suffix arrays of word ids.

A task takes its texts in shards of bounded size.  A shard's words get ids, and the
suffixes of its pieces are sorted by numpy prefix doubling; suffixes that share their
first n words lie side by side, so that the stretches between longest common prefixes
below n are the shard's n-grams with their counts.  Counts are merged by key, summed
on the map side first.

A phrase can only be frequent if its words, pairs and triples are.  So there are four
rounds over the texts: of single words, of pairs of frequent words, of triples of frequent
pairs, and of the longer phrases all of whose triples are frequent: a run of such triples
is sorted like a text, of words that overlap.  What is frequent is told to the tasks by a
bitmap over the hashes, ``BITS`` bits at any size of the input.  Bits that several share
only let more through: each round's counts decide.

Only the first round sends texts, those of words.  The others count by the 64-bit hashes of a
phrase's words, one after the other; the phrases that are frequent, each once, get their
texts from the words' table.  No frequent word shares its hash with another word: that is
looked up, and the words are hashed anew if one does.

Scores are exact, in decimals of 38 digits: a times n may have 34 digits and the
product of two counts 37.  Contained phrases are compared with those one word longer:
where a longer phrase is as frequent, so are all between.

Cases: null texts have no words; a null lang is ``und``; ties go to the shorter first
part, then by count and phrase; repeated rows count again; an empty table gives an
empty result; columns besides lang and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_codec import groups
from .common import Written, if_small, whole

#: Words of the longest phrase, its least count, and the rows of a language.
WORDS, LEAST, ROWS = 5, 100, 2000
#: Characters of a shard, about.
SHARD = 6_000_000
#: Bits of what tells frequent words or pairs: 16 MB.
BITS = 1 << 27
PIECE_ENDS, SPACES = "[.,;:!?\\x0A-\\x0D]", "[\\x20\\x09]+"


class Shard(NamedTuple):
    """Words by id, their hashes, and the texts as ids; -1 ends a piece."""

    words: pa.Array
    hashes: np.ndarray
    ids: np.ndarray


def shard(texts: list[str], lang: str, salt: int = 0) -> Shard:
    pieces = pc.split_pattern_regex(pc.ascii_lower(pa.array(texts, pa.string())), PIECE_ENDS).flatten()
    split = pc.split_pattern_regex(pieces, SPACES)
    coded = split.values.dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(words, pa.scalar("", pa.string())).as_py()  # beside spaces at a piece's end
    offsets = split.offsets.to_numpy()
    bounds = np.insert(ids, offsets[1:], -1)
    seed = xxhash.xxh3_64_intdigest(lang.encode(), salt)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words.to_pylist()), np.uint64, len(words))
    return Shard(words, hashes, bounds[bounds != empty] if empty >= 0 else bounds)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019) ^ b
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def kept(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(BITS)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def suffixes(ids: np.ndarray, words: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of words in the order of what follows them, and for each length up to
    ``words``: whether the prefix differs from that of the place before, and whether
    it is as long.

    Ranks of prefixes of 1, 2, 4 ... words come from those of half the length; the last
    round takes the remainder.
    """
    rank = ids + 1  # 0 ends a piece
    key, size = rank, 1
    while size < words:
        step = min(size, words - size)
        long = np.unique(key, return_inverse=True)[1] if size > 1 else rank
        behind = np.zeros_like(rank)
        behind[:-size] = (long if step == size else _prefix_rank(rank, step))[size:]
        key = long * (behind.max(initial=0) + 1) + behind
        size += step
    order = np.argsort(key)
    order = order[ids[order] >= 0]
    starts, same, full = [], np.ones(len(order), bool), np.ones(len(order), bool)
    padded = np.concatenate([ids, np.full(words, -1)])
    for n in range(words):
        here = padded[order + n]
        full = full & (here >= 0)
        same = same & np.concatenate([[False], here[1:] == here[:-1]])
        starts.append((~same, full))
    return order, starts


def _prefix_rank(rank: np.ndarray, words: int) -> np.ndarray:
    """Ranks of prefixes of so few words, dense and in order."""
    out = rank
    for k in range(1, words):
        behind = np.zeros_like(rank)
        behind[:-k] = rank[k:]
        _, out = np.unique(out * (behind.max(initial=0) + 1) + behind, return_inverse=True)
    return out


def grams(ids: np.ndarray, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """First places and counts of the phrases of each length."""
    if not (ids >= 0).any():
        return
    order, starts = suffixes(ids, most)
    for n in range(least, most + 1):
        new, full = starts[n - 1]
        runs = np.flatnonzero(new | ~full)
        count = np.diff(np.append(runs, len(order)))
        real = full[runs]
        yield order[runs[real]], count[real], n


def _parts(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.RecordBatch.from_arrays(columns, names=names)
    yield from (table[k : k + 50_000] for k in range(0, len(table), 50_000))


def known(made: Shard, single: np.ndarray | None, double: np.ndarray | None) -> np.ndarray:
    """The ids, with ends where a word isn't frequent and between pairs that aren't."""
    ids = made.ids
    if single is not None:
        ids = np.where((ids >= 0) & kept(single, made.hashes)[ids], ids, -1)
    if double is not None and len(ids) > 1:
        pair = kept(double, mixed(made.hashes[ids[:-1]], made.hashes[ids[1:]])) & (ids[:-1] >= 0) & (ids[1:] >= 0)
        ids = np.insert(ids, np.flatnonzero(~pair) + 1, -1)
    if single is None:
        return ids
    ends = np.concatenate([[True], ids < 0, [True]])
    return ids[~(ends[1:-1] & ends[:-2]) & ~((ids >= 0) & ends[:-2] & ends[2:])]  # ends in a row, and words alone


def _hashes(made: Shard, ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Of the n words from these places on."""
    return reduce(mixed, (made.hashes[ids[places + k]] for k in range(n)))


def word_counts(docs: DataFrame, size: int, salt: int) -> DataFrame:
    """lang, word, h, f of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches, size):
            made = shard(texts, lang, salt)
            f = np.bincount(made.ids[made.ids >= 0], minlength=len(made.words))
            own = np.flatnonzero(f)
            columns = [pa.repeat(pa.scalar(lang, pa.string()), len(own)), made.words.take(pa.array(own)), pa.array(made.hashes[own].view(np.int64)), pa.array(f[own])]
            yield from _parts(columns, ["lang", "word", "h", "f"])

    return _taken(docs).mapInArrow(count, "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def keys(made: Shard, ids: np.ndarray, places: np.ndarray, n: int) -> pa.Array:
    """The hashes of the n words from these places on, as bytes."""
    words = made.hashes[ids[places[:, None] + np.arange(n)]]
    ends = np.arange(len(places) + 1, dtype=np.int32) * (8 * n)
    return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(ends), pa.py_buffer(words.tobytes())])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """words (the hashes), mark and f from key and f."""
    for b in batches:
        sizes = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False) // 8
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
        h = words[starts[:-1]]
        for k in range(1, sizes.max(initial=0)):
            some = sizes > k
            h[some] = mixed(h[some], words[starts[:-1][some] + k])
        mark = (h % np.uint64(BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(words.view(np.int64))), pa.array(mark), b.column(1)], names=["words", "mark", "f"])


def frequent(docs: DataFrame, n: int, least: int, size: int, salt: int, single: Broadcast, double: Broadcast | None = None, triple: Broadcast | None = None) -> Written:
    """words (hashes), mark, f of the frequent phrases of n words, or of more than three
    where frequent triples are given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches, size):
            made = shard(texts, lang, salt)
            if not len(made.words):
                continue
            ids = known(made, *(None if b is None else b.value for b in (single, double)))
            if triple is None:
                found = grams(ids, n, n)
            else:
                found = ((places, f, k + 2) for places, f, k in grams(triples(made, ids, triple.value), n - 2, WORDS - 2))
            for places, f, k in found:
                yield from _parts([keys(made, ids, places, k), pa.array(f.astype(np.int64))], ["key", "f"])

    counted = _taken(docs).mapInArrow(count, "key binary, f long").groupBy("key").agg(F.sum("f").alias("f"))
    return Written(counted.where(F.col("f") >= least).mapInArrow(opened, "words array<long>, mark long, f long"), "frequent")


def bitmap(marks: DataFrame) -> Broadcast:
    """Bits at the marks, as many bytes at any size; sent to all tasks."""
    one = F.col("mark") + 1  # buckets of 32,768 bits count from one
    some = marks.groupBy(F.bitmap_bucket_number(one).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    made = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in some.toLocalIterator():
        made[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return marks.sparkSession.sparkContext.broadcast(made)


def _taken(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole().alias("text"))


def triples(made: Shard, ids: np.ndarray, triple: np.ndarray) -> np.ndarray:
    """A number for each place's triple of words, -1 where it isn't frequent."""
    at = np.flatnonzero((ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0))
    at = at[kept(triple, _hashes(made, ids, at, 3))]
    out = np.full(len(ids), -1)
    out[at] = _prefix_rank(ids + 1, 3)[at]
    return out


def named(found: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """lang, phrase, words (their number), f of phrases of words' hashes; n: how many rows
    ``words`` (lang, word, h) has."""
    found = found.select(F.size("words").alias("size"), "words", "f")
    for k in range(WORDS):  # a shorter phrase meets its last word again
        own = words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), *["lang"] * (k == 0))
        found = found.withColumn(f"h{k}", F.element_at("words", F.least(F.lit(k + 1), "size"))).join(if_small(own, n), f"h{k}").drop(f"h{k}")
    text = F.array_join(F.slice(F.array(*[f"w{k}" for k in range(WORDS)]), F.lit(1), F.col("size")), " ")
    return found.select("lang", text.alias("phrase"), F.col("size").alias("words"), "f")


def shards(batches: Iterator[pa.RecordBatch], full: int) -> Iterator[tuple[str, list[str]]]:
    """Languages and texts, about so many characters of one language at a time and at
    most twice as many held."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        langs, done = batch.column(0).to_pylist(), 0
        for run in groups(batch.column(1)):
            for lang, text in zip(langs[done : done + len(run)], run, strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
            done += len(run)
            while size and (max(size.values()) >= full or sum(size.values()) >= 2 * full):
                most = max(size, key=size.__getitem__)
                del size[most]
                yield most, held.pop(most)
    yield from held.items()


def collocations(docs: DataFrame, least: int = LEAST, most_rows: int = ROWS, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language; shards
    have about ``size`` characters."""
    for salt in count():
        every = Written(word_counts(docs, size, salt), "words")
        words = Written(every.df.where(F.col("f") >= least), "often")
        n = words.df.count()
        if every.df.join(if_small(words.df.select("h"), n), "h").count() == n:
            break
        every.drop()
        words.drop()
    single = bitmap(words.df.select(F.col("h").bitwiseAND(BITS - 1).alias("mark")))
    pairs = frequent(docs, 2, least, size, salt, single)
    double = bitmap(pairs.df)
    threes = frequent(docs, 3, least, size, salt, single, double)
    more = frequent(docs, 4, least, size, salt, single, double, bitmap(threes.df))
    found = named(pairs.df.unionByName(threes.df).unionByName(more.df), words.df, n)
    often = Written(found.unionByName(words.df.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f")), "phrases").df
    total = Written(every.df.groupBy("lang").agg(F.sum("f").alias("n")), "total").df
    for old in (every, words, pairs, threes, more):
        old.drop()
    return best(often, total, most_rows)


def best(phrases: DataFrame, total: DataFrame, most_rows: int = ROWS) -> DataFrame:
    """The report from lang, phrase, words, f of all frequent phrases, and lang, n."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    parts = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    found = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", parts(F.lit(1), F.col("k")).alias("left"), parts(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang")
    score = ((exact("a") * exact("n") * F.lit(1000)).cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)"))
    scored = cuts.withColumns({"above": score[0], "below": score[1]}).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.where("words > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(parts(F.lit(1), F.col("words") - 1), parts(F.lit(2), F.col("words") - 1))).alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where("f IS NULL OR f < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    flat = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= most_rows).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
