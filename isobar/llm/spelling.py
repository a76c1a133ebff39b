"""Spelling variants by a symmetric-delete join.

A word is a run of Latin letters with enough code points and occurrences.  Every word
emits itself and its distinct single deletions; words that meet in a key are compared,
and those at a distance of exactly one are near.  A word's form is its most frequent
near word, if that is frequent enough, and forms are followed to the root by joins
that double what is jumped over each round.

Occurrences are counted on the map side first.  A key has 64 bits and stands for a
string; only words that are it, or have one character more, meet in it, at most some
hundred a place in the string, so that no key is hot however the text is.  Equal
numbers of code points decide what is compared: a word that is the key of another is
one deletion away, two words of the key's length and one more may differ in one place.

Cases: null texts have no words; a null id counts as an empty string in what decides
the deletion; repeated rows count again; words without near ones are their own root;
ties go to the word that is smaller by code points; an empty table gives an empty
result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Written, whole

RUN = "[A-Za-zÀ-ÿ]+"
#: One in so many occurrences loses a code point.
ERRORS = 97
#: Code points and occurrences of a word; how often more frequent a form is.
LENGTH, LEAST, TIMES = 5, 3, 2


def without(word: Column, at: Column) -> Column:
    """The word without its code point at this place, from zero."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words with their occurrences."""
    low = F.translate(whole(), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    word = F.when(h % ERRORS == 0, without(F.col("run"), (h % F.length("run")).cast("int"))).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= LENGTH).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


def keys(found: DataFrame) -> DataFrame:
    """key, length, word, n: a word and its distinct single deletions, by their hashes."""
    own = F.xxhash64("word")
    deleted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda k: F.xxhash64(without(F.col("word"), k))))
    one = found.select(own.alias("key"), F.length("word").alias("length"), "word", "n")
    return one.union(found.select(F.explode(deleted).alias("key"), (F.length("word") - 1).alias("length"), "word", "n"))


def near(found: DataFrame) -> DataFrame:
    """word, n, other, m: words at a distance of one, each pair both ways."""
    made = Written(keys(found), "keys")
    left = made.df.select("key", "length", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = made.df.select("key", "length", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, ["key", "length"]).where("a < b AND levenshtein(a, b, 1) = 1")
    pairs = Written(met.select("a", "n_a", "b", "n_b").distinct(), "near").df
    made.drop()
    return pairs.union(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "other", "m")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): what is reached in the end.  A round takes every
    word's goal to that one's own goal, and the rounds end when none moves."""
    now = Written(forms.toDF("word", "root"), "roots")
    while True:
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.df.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        after = Written(moved, "roots")
        now.drop()
        now = after
        if after.df.where("went").isEmpty():
            return after.df.select("word", "root")
        now.df = after.df.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    found = Written(words(docs), "words").df
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    grouped = near(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    form = F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best.other"))
    variants = Written(grouped.select("word", "n_near", form.alias("form"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "variants").df
    root = roots(variants.where("form IS NOT NULL").select("word", "form"))
    every = found.join(variants, "word", "left").join(root, "word", "left")
    return every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
