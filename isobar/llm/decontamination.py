"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows (13 words, or all of a shorter item) must lie in a document
whole, so whichever of a window's shingles (five words, or all of a shorter
window) is chosen, a document that holds the window holds it: at containment one
the necessary prefix is a single token.  A first pass counts the benchmark's
shingles in the documents, in sums that are pre-aggregated; ordered by these
counts, each window's rarest shingle is its prefix, and a window with a shingle
that no document holds needs none.

A second pass joins the documents' shingles, as hashes with their places, to the
prefixes alone.  A prefix says at which distances before it windows of which
lengths begin, so each hit gives a few starts; those that lie before the first
word or whose window would end after the last are dropped (positional and length
bounds).  The documents left, and only these, are split once more, and the hash of
each start's own words meets the windows' (128 bits: exact in effect).

The small side of a join is measured before it is broadcast; beyond that the same
joins shuffle hashes and places, never words.

Cases: null and empty texts have no words and no hits; null or empty items have no
window; equal items each count; equal windows of one or several items are one
window with several items; null ids of documents and items count like others (a
null item_id is one item, without a name); repeated documents are each given the
same counts; empty tables give no rows, or documents without hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, Written, if_small, whole

WINDOW, SHINGLE = 13, 5
#: What stands between words, upper-case letters being still there.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_words(text: Column) -> Column:
    """Words with A to Z in lower case.  lower() is exact and fast for ASCII texts;
    others are translated letter by letter."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _hash(words: Column, at: Column, n: int) -> Column:
    """Of the n words from position at (0-based); n goes in, so lengths differ."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))


def _same(words: Column, at: Column, n: Column) -> Column:
    """128 bits of n words from position at."""
    return F.unhex(F.md5(F.array_join(F.slice(words, at + 1, n), " ")))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, start, n, k (shingle length), words of each window of each item."""
    split = items.select("item_id", lower_words(whole()).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    placed = split.select("item_id", "words", n.alias("n"), F.least(n, F.lit(SHINGLE)).alias("k"))
    return placed.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))


def _shingles(split: DataFrame, lengths: list[int]) -> DataFrame:
    """Further columns, n_words, p and h of every run of the given lengths of words."""
    rest = [c for c in split.columns if c != "words"]
    one = [
        split.select(*rest, "words", F.size("words").alias("n_words"), F.explode(_starts(F.col("words"), n)).alias("p")).select(*rest, "n_words", "p", _hash(F.col("words"), F.col("p"), n).alias("h"))
        for n in lengths
    ]
    return reduce(DataFrame.union, one)


def _key() -> list[Column]:
    """A document row: its id and its text's hash, as ids may repeat."""
    return [F.col("doc_id"), F.xxhash64("text").alias("_text")]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and contaminated of each
    document."""
    return _judged(docs, items, window, share).drop("_text")


def _judged(docs: DataFrame, items: DataFrame, window: int, share: int) -> DataFrame:
    """decontaminate(), with the rest of each document's key."""
    # Each window once: its identity and length, and the hashes of its shingles.
    own = windows(items, window).withColumn("same", _same(F.col("words"), F.col("start"), F.col("n")))
    words_ = F.slice("words", F.col("start") + 1, F.col("n"))
    each = Written(own.groupBy("same", "n", "k").agg(F.first(words_).alias("words"), F.collect_set(F.struct("item_id")).alias("items")), "windows").df
    lengths = [r["k"] for r in each.select("k").distinct().collect()] or [SHINGLE]  # five values at most
    inside = reduce(DataFrame.union, [_shingles(each.where(F.col("k") == n).select("same", "n", "words"), [n]) for n in lengths])
    inside = inside.select("same", "n", F.col("p").alias("at"), "h")

    split = docs.select("doc_id", whole().alias("text")).select(*_key(), lower_words(F.col("text")).alias("words"))
    tokens = inside.select("h").distinct()
    few = tokens.count() <= BROADCAST_ROWS
    held = _shingles(split.select("words"), lengths).select("h")
    # Beyond what is broadcast, counts come first, so that a hot shingle is a row a task.
    counted = lambda df: df.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarity = Written(counted(held.join(F.broadcast(tokens), "h", "left_semi")) if few else counted(held).join(tokens, "h", "left_semi"), "rarity").df

    # A window's shingles, nine at most: one that no document holds rules the window out.
    ordered = F.array_sort(F.collect_list(F.struct("df", "h", "at")))[0]
    rarest = inside.join(rarity, "h", "left").groupBy("same", "n").agg(ordered.alias("x"), F.count_if(F.col("df").isNull()).alias("absent"))
    prefix = Written(rarest.where("absent = 0").select("x.h", "x.at", "n").distinct(), "prefixes").df
    met = _shingles(split, lengths).join(if_small(prefix), "h")
    start = F.col("p") - F.col("at")
    starts = met.where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), start.alias("start"), "n")
    starts = Written(starts.groupBy("_id", "_hash").agg(F.collect_set(F.struct("start", "n")).alias("starts")), "starts").df

    same_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    some = docs.select("doc_id", whole().alias("text")).select(*_key(), "text").join(if_small(starts), same_row)
    some = some.select("doc_id", "_text", lower_words(F.col("text")).alias("words"), "starts")
    # The generator asks for the words, so that a text is split once, not for each start.
    some = some.select("doc_id", "_text", "words", F.explode(F.when(F.size("words") > 0, F.col("starts"))).alias("x"))
    placed = some.select("doc_id", "_text", _same(F.col("words"), F.col("x.start"), F.col("x.n")).alias("same"), "x.start", "x.n")
    known = each.select("same", "n")
    hits = Written(placed.join(if_small(known), ["same", "n"], "left_semi").distinct(), "hits").df

    spans = hits.groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    # Words covered: each span counts from where those before it ended.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["sum"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("sum"), F.greatest(a["end"], x["end"]).alias("end")),
    )["sum"]
    of = Written(each.select("same", F.explode("items.item_id").alias("item")), "items").df
    named = hits.select("doc_id", "_text", "same").distinct().join(if_small(of), "same")
    names = F.sort_array(F.collect_set(F.struct(F.col("item").cast("string").alias("item"))))["item"]  # sets drop bare nulls
    named = named.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash")).agg(names.alias("items"))
    found = spans.select("doc_id", "_text", covered.cast("long").alias("hit")).join(named, same_row, "left").drop("_id", "_hash")

    count = F.size(F.array_remove(F.split("text", BETWEEN, -1), "")).cast("long")
    every = docs.select("doc_id", whole().alias("text")).select(*_key(), count.alias("n_words"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "hit", "items")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return every.join(found, same_row, "left").select(
        "doc_id", "_text", "n_words", n_hit.alias("n_hit"), names.alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their columns."""
    judged = _judged(docs, items, WINDOW, 20)
    bad = Written(judged.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("_text").alias("__hash")).distinct(), "contaminated").df
    gone = if_small(bad)  # by reference: the documents may have columns of these names
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__hash"]), "left_anti")
