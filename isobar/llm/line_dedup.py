"""Line dedup by overlapping three-line windows.

Lines are hashed, three consecutive ones are a window, and windows found more than
once anywhere are repeated.  The first occurrence stays; the positions that later
occurrences cover are merged, and all of them go, however short.  Each line that goes
still stands where its window came first.

What ends a line is a parameter, a pattern of the places between lines.  ``FEEDS``, the
default, are those behind line feeds; ``SENTENCES`` also those behind a full stop,
exclamation or question mark that white space follows, for passages that repeat inside
longer lines; ``CLAUSES``, which the query takes, also those behind commas, semicolons,
colons and dots of omission that white space follows, and behind full-width marks.  None
cuts a word.

Rows are numbered once, in a written table, so that rows of equal id and text are
documents of their own.  Occurrences are in the order of ids (null first), of the
text's hash where ids are equal, and of the rows' numbers where texts are.  Windows are
told apart by 64 bits.  Counts and minima are pre-aggregated; a hot window's occurrences
meet one row in a join that Spark splits where it is skewed.  The plan is the same at
every size: a row's positions meet it in a shuffled join, and nothing is broadcast.

Cases: null texts stay null and empty ones empty; fewer than three lines have no
window; of repeated rows the first one stays, whether ids are null or not; an empty
table gives an empty result; all other columns pass through, whatever their names, but
n_chars, which is counted anew where the text has changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

LINES = 3
#: Where a line ends.
FEEDS, SENTENCES = r"(?<=\n)(?!\n)", r"(?<=\n)(?!\n)|(?<=[.!?])(?=[\x20\x09-\x0D])"
#: Also at clauses.  Places behind word characters and spaces, most of all, are left at once.
CLAUSES = r"(?<!\w)(?<!\x20)(?:(?<=\n)(?!\n)|(?<=[.,;:!?…])(?=[\x20\x09\x0B-\x0D])|(?<=[、。！，：；？])(?![.,;:!?…、。！，：；？\n]))"
#: The same for CLAUSES as marks with what makes them ends: a search that takes characters is quicker than one that looks behind each.
MARKS = {CLAUSES: r"[.,;:!?\n\u2026-\uFF1F](?:(?<=[.,;:!?…])(?=[\x20\x09\x0B-\x0D])|(?<=\n)(?!\n)|(?<=[、。！，：；？])(?![.,;:!?…、。！，：；？\n]))"}
BLANK = " \t\n\r\x0b\x0c"


def lines(text: Column, ends: str = FEEDS) -> Column:
    """The lines, each with what ends it; joined, they are the text."""
    cut = F.split(text, ends, -1)
    if ends in MARKS:  # a zero character is put behind each end, unless the text has some
        cut = F.when(F.contains(text, F.lit("\0")), cut).otherwise(F.split(F.regexp_replace(text, MARKS[ends], "$0\0"), "\0", -1))
    return F.array_remove(cut, "")


def trimmed(each: Column) -> Column:
    """Lines without BLANK characters at their ends.  Spaces alone are quick to trim; other
    blanks, which ``btrim`` looks for in the whole line, only where they are."""
    blank = lambda c: F.ascii(c).between(9, 13)
    return F.transform(F.transform(each, lambda x: F.trim(x)), lambda x: F.when(blank(F.substring(x, -1, 1)) | blank(x), F.btrim(x, F.lit(BLANK))).otherwise(x))


def numbered(docs: DataFrame) -> Written:
    """row (a document as it is), number."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return Written(rows.select("row", F.monotonically_increasing_id().alias("number")), "rows")


def occurrences(rows: DataFrame, ends: str = FEEDS) -> DataFrame:
    """doc, key, number, p, a: each window's document, first line and hash."""
    hashed = F.transform(trimmed(lines(F.col("row.text"), ends)), lambda x: F.xxhash64(x))
    split = rows.select(F.col("row.doc_id").alias("doc"), F.xxhash64("row.text").alias("key"), "number", hashed.alias("l")).where(F.size("l") >= LINES)
    placed = split.select("doc", "key", "number", "l", F.explode(F.sequence(F.lit(0), F.size("l") - LINES)).alias("p"))
    return placed.select("doc", "key", "number", "p", F.xxhash64(*[F.get("l", F.col("p") + k) for k in range(LINES)]).alias("a"))


def marks(rows: DataFrame, ends: str = FEEDS) -> DataFrame:
    """number, cut: the positions that later occurrences of repeated windows cover."""
    every = Written(occurrences(rows, ends), "windows")
    twice = Written(every.df.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "repeated")
    met = Written(every.df.join(twice.df, "a", "left_semi"), "met")
    every.drop()
    twice.drop()
    place = F.struct("doc", "key", "number", "p")
    # Written, so that both sides of the join are exchanges and Spark can split a hot window's rows.
    first = Written(met.df.groupBy("a").agg(F.min(place).alias("first")), "first")
    later = met.df.join(first.df, "a").where((F.col("number") != F.col("first.number")) | (F.col("p") != F.col("first.p")))
    covered = later.select("number", F.explode(F.sequence("p", F.col("p") + (LINES - 1))).alias("p"))
    out = Written(covered.groupBy("number").agg(F.array_sort(F.collect_set("p")).alias("cut")), "marks").df
    met.drop()
    first.drop()
    return out


def _with_cuts(docs: DataFrame, ends: str) -> DataFrame:
    """row (a document as it is), cut (null: nothing repeats), text without the cut."""
    rows = numbered(docs).df
    found = rows.join(marks(rows, ends).hint("merge"), "number", "left")
    found = found.withColumn("own", F.when(F.col("cut").isNotNull(), lines(F.col("row.text"), ends)))
    left = F.array_except(F.sequence(F.lit(0), F.size("own") - 1), F.col("cut"))
    rest = F.array_join(F.transform(left, lambda i: F.get("own", i)), "")
    return found.select("row", "cut", F.when(F.col("cut").isNotNull(), rest).otherwise(F.col("row.text")).alias("text"))


def dedup_lines(docs: DataFrame, ends: str = FEEDS) -> DataFrame:
    """The documents without the lines that repeat earlier ones; every row stays."""
    found = _with_cuts(docs, ends)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut").isNotNull(), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def dedup_report(docs: DataFrame, ends: str = FEEDS) -> DataFrame:
    """doc_id, lines and characters that went, and the text left."""
    found = _with_cuts(docs.select("doc_id", "text"), ends)
    length = lambda text: F.length(F.coalesce(text, F.lit("")))
    return found.select(
        "row.doc_id", F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"),
        (length("row.text") - length("text")).cast("long").alias("n_chars_removed"), "text",
    )
