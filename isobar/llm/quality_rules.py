"""Quality rules with host verdicts, in DataFrame functions only.

Document rules are counted inside each row (arrays and higher-order functions:
no text is exploded or shuffled).  Failures are then summed by host with
map-side partial sums, each host's rate is shrunk towards an empirical beta
prior, and the verdict goes back to the documents.

Cases: a null or empty text has no words and fails; a null host groups nothing,
so its documents get no host verdict; a repeated row is judged like its twin; an
empty table gives an empty result; columns besides doc_id, text and the host
column are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Written, join_measured, whole, words

WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(words_: Column, n: int) -> Column:
    """A hash for each run of n consecutive words (none if there are fewer)."""
    starts = F.when(F.size(words_) >= n, F.sequence(F.lit(1), F.size(words_) - (n - 1)))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.try_element_at(words_, i + k) for k in range(n)]))
    return F.coalesce(hashed, F.array().cast("array<bigint>"))


def _covered(hashes: Column, n: int) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Sorted by (hash, position), a repeated window equals a neighbour; covered
    words are the sum of steps between repeated positions, n at most each.
    """

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.try_element_at(s, j)["h"] == x["h"], F.lit(False))
        flagged = F.transform(s, lambda x, i: F.when(same(x, i + 2) | ((i > 0) & same(x, F.greatest(i, F.lit(1)))), x["p"]))
        return F.sort_array(F.array_compact(flagged))

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    steps = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.try_element_at(p, i + 2) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b
    )
    slow = _let(F.sort_array(pairs), lambda s: _let(repeated(s), steps))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(slow).cast("long")


def document_rules(docs: DataFrame, host: str = "source", min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """doc_id, host and the counts of each document's rules."""
    split = docs.select("doc_id", F.col(host).alias("host"), whole().alias("text")).withColumn("w", words(F.col("text")))
    hashed = split.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _window_hashes(F.col("w"), WINDOW).alias("h"),
    )
    counted = hashed.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("h"), WINDOW).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _rules() -> dict[str, Column]:
    """Host-level rules: what counts as a document's failure."""
    return {
        "base": F.col("base_failed"),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("word_chars"),
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


#: Documents that the prior weighs as much as, at most.
MOST_WEIGHT = 1000.0


def host_rates(rules: DataFrame) -> DataFrame:
    """By host: documents, and for each rule its failures' rate shrunk by a beta
    prior whose two parameters are fitted to the hosts' rates by moments.  The prior
    weighs as much as 2 documents at least and ``MOST_WEIGHT`` at most, where hosts
    differ more than any beta distribution or hardly at all."""
    names = list(_rules())
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(f"k_{r}") for r, c in _rules().items()]
    )
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"),
        *[F.sum(f"k_{r}").alias(f"k_{r}") for r in names],
        *[F.var_pop(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}") for r in names],
    ).first()
    shrunk = []
    for r in names:  # three rules, one row of moments
        mean = ((moments[f"k_{r}"] or 0) + 1) / ((moments["n"] or 0) + 2)
        variance = max(moments[f"v_{r}"] or 0.0, 1e-9)
        weight = min(max(mean * (1 - mean) / variance - 1, 2.0), MOST_WEIGHT)
        shrunk.append(((F.col(f"k_{r}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))).alias(f"rate_{r}"))
    return hosts.select("host", F.col("n").alias("host_docs"), *shrunk)


def quality_rules(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """A row for each document: its counts, base_failed, its host's shrunk rates,
    host_rejected (some rate over ``limit``) and kept."""
    rules = Written(document_rules(docs, host), "quality-rules").df
    rates = host_rates(rules)
    worst = F.greatest(*[F.col(f"rate_{r}") for r in _rules()])
    verdicts = rates.select("host", worst.alias("host_rate"), (worst > limit).alias("host_rejected"))
    judged = join_measured(rules, verdicts, "host")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), F.round("host_rate", 9).alias("host_rate"), rejected.alias("host_rejected"),
    )
