"""Sharding by a k-d tree of weighted medians.

Documents are points of a few metadata dimensions, weighted by their bytes.  From
the whole table on, each node is split at the weighted median of its widest
dimension until its bytes reach the target; leaves are shards of nearly equal
size.  A node of an odd number of shards is split at the quantile that gives each
side its shards' bytes.  A level's nodes are split together: sums by bucket, pre-aggregated, bracket
each median ever more closely (a fixed number of buckets a node comes to the
driver, whatever the input).

Points with equal coordinates are told apart by the hash of their text, those of
equal texts by their ids, and those of equal ids by a number of their row, which is
drawn once and written: equal texts stay in one shard unless a median falls among
them, as it must where one text's rows have more bytes than a shard.

Cases: null texts have no bytes (size one) and the checksum of nothing; null
metadata counts as zero or empty; rows of equal ids and texts, or of null ids, are
split like others; of fewer rows than shards some shards are empty; an empty table gives an empty result; columns other than
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, whole

#: Buckets a node is summed into at a time, and rounds at most a median takes:
#: twelve bits each narrow 63-bit keys to one value.
BUCKETS, ROUNDS = 4096, 6
#: A median may be off by this share of its node's bytes.
TOLERANCE = 2e-4
#: Rows that share a slot bucket, about.
SLOT_ROWS = 20_000

DIMENSIONS = ("bytes", "script", "language")
TOP = (1 << 62) - 1


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc, one key a dimension and the key of last resort.

    A dimension's key is its coordinate in 22 bits, above 40 bits of the text's
    hash.  Coordinates: logarithm of the bytes, bytes a character, and a hash of the
    language (any order serves to keep a language together).
    """
    text = whole()
    size = F.octet_length(text)
    unit = [F.log1p(size) / 24, (size / F.greatest(F.length(text), F.lit(1)) - 1) / 3, F.pmod(F.hash(F.coalesce("lang", F.lit(""))), F.lit(1 << 20)) / F.lit(1 << 20)]
    low = F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1))
    key = lambda u: F.shiftleft(F.least(F.greatest(F.floor(u * ((1 << 22) - 1)), F.lit(0)), F.lit((1 << 22) - 1)).cast("long"), 40).bitwiseOR(low)
    own = F.shiftleft(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 40) - 1)), 22)
    own = own.bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 22) - 1)))
    return docs.select(
        "doc_id", (size + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        *[key(u).alias(f"k_{d}") for d, u in zip(DIMENSIONS, unit, strict=True)], own.alias("k_id"),
    )


@dataclass
class Cut:
    """Rows of a node go right if (key, id key) is beyond (at, id_at]."""

    node: int
    dimension: str
    at: int
    id_at: int


def _nest(points_: DataFrame, cuts: list[Cut]) -> DataFrame:
    """points with the column node; a level of the tree at a time, so that
    expressions stay small."""
    out = points_.withColumn("node", F.lit(1))
    for level in sorted({c.node.bit_length() for c in cuts}):
        node = F.col("node")
        for c in (c for c in cuts if c.node.bit_length() == level):
            key = F.col(f"k_{c.dimension}")
            right = (key > c.at) | ((key == c.at) & (F.col("k_id") > c.id_at))
            node = F.when(F.col("node") == c.node, F.when(right, F.lit(2 * c.node + 1)).otherwise(F.lit(2 * c.node))).otherwise(node)
        out = out.withColumn("node", node)
    return out


def _bracket(nested: DataFrame, key: dict[int, str], low: dict[int, int], high: dict[int, int], below: dict[int, int], goal: dict[int, int], total: dict[int, int], where: Column | None) -> None:
    """Narrow low..high (keys, inclusive) of each node until the bytes up to high
    are the node's goal, within the tolerance, or one key is left.  below: bytes
    before low."""
    active = set(key)
    for _ in range(ROUNDS):
        active = {n for n in active if low[n] < high[n]}
        if not active:
            return
        step = {n: (high[n] - low[n]) // BUCKETS + 1 for n in active}
        bucket = F.lit(None).cast("long")
        for n in active:
            k = F.col(key[n])
            inside = (F.col("node") == n) & (k >= low[n]) & (k <= high[n])
            bucket = F.when(inside, F.expr(f"({key[n]} - {low[n]}L) div {step[n]}L")).otherwise(bucket)
        rows = nested if where is None else nested.where(where)
        sums = rows.select("node", bucket.alias("bucket"), "size").where("bucket is not null").groupBy("node", "bucket").agg(F.sum("size").alias("bytes"))
        found: dict[int, list[tuple[int, int]]] = {n: [] for n in active}
        for row in sums.collect():  # BUCKETS rows a node at most
            found[row["node"]].append((row["bucket"], row["bytes"]))
        for n in list(active):
            run, start, width = below[n], low[n], step[n]
            for b, size in sorted(found[n]):
                if run + size >= goal[n]:
                    low[n], high[n], below[n] = start + b * width, min(start + (b + 1) * width - 1, high[n]), run
                    if size <= TOLERANCE * total[n]:  # near enough: cut at the nearer end
                        if goal[n] - run < run + size - goal[n]:
                            high[n] = low[n] - 1
                        low[n] = high[n]
                        active.discard(n)
                    break
                run += size
            else:
                low[n] = high[n]
                active.discard(n)


def tree(points_: DataFrame, shards: int) -> list[Cut]:
    """Cuts until every leaf is one shard's share of the bytes, about."""
    cuts: list[Cut] = []
    share = {1: shards}  # the leaves, and how many shards each is still to give
    while any(k > 1 for k in share.values()):
        nested = _nest(points_, cuts)
        spread = [F.stddev_pop(F.shiftright(f"k_{d}", 40) / F.lit(1 << 22)).alias(d) for d in DIMENSIONS]
        large = nested.where(F.col("node").isin([n for n, k in share.items() if k > 1])).groupBy("node").agg(F.sum("size").alias("total"), *spread).collect()  # a row a node
        share |= dict.fromkeys(share.keys() - {r["node"] for r in large}, 1)  # no rows, or done
        # The widest dimension; the first of equals.
        widest = {r["node"]: max(DIMENSIONS, key=lambda d: r[d] or 0.0) for r in large}
        total = {r["node"]: r["total"] for r in large}
        goal = {n: round(b * (share[n] // 2) / share[n]) for n, b in total.items()}
        key = {n: f"k_{d}" for n, d in widest.items()}
        low, high, below = dict.fromkeys(total, 0), dict.fromkeys(total, TOP), dict.fromkeys(total, 0)
        _bracket(nested, key, low, high, below, goal, total, None)
        # Where one key is left that holds more than its share, its rows are cut by id.
        at = {n: high[n] for n in total}
        tied = F.lit(False)
        for n in total:
            tied = tied | ((F.col("node") == n) & (F.col(key[n]) == at[n]))
        heavy = {r["node"]: r["bytes"] for r in nested.where(tied).groupBy("node").agg(F.sum("size").alias("bytes")).collect()}
        heavy = {n: b for n, b in heavy.items() if b > TOLERANCE * total[n] and below[n] < goal[n]}
        id_low, id_high = dict.fromkeys(heavy, 0), dict.fromkeys(heavy, TOP)
        _bracket(nested, dict.fromkeys(heavy, "k_id"), id_low, id_high, {n: below[n] for n in heavy}, goal, total, tied)
        for n in total:
            cuts.append(Cut(n, widest[n], at[n], id_high.get(n, TOP)))
            k = share.pop(n)
            share |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
    return cuts


def assign(points_: DataFrame, cuts: list[Cut]) -> DataFrame:
    """points with shard: the leaves numbered from zero, from left to right."""
    inner = {c.node for c in cuts}
    leaves = [n for n in {1} | {m for c in cuts for m in (2 * c.node, 2 * c.node + 1)} if n not in inner]
    depth = max(n.bit_length() for n in leaves)
    leaves.sort(key=lambda n: n << (depth - n.bit_length()))
    shard = F.lit(0)
    for number, n in enumerate(leaves):
        shard = F.when(F.col("node") == n, F.lit(number)).otherwise(shard)
    return _nest(points_, cuts).withColumn("shard", shard).drop("node")


def with_slots(placed: DataFrame, rows: int) -> DataFrame:
    """slot: from 0 in each shard without gaps.  Rows are ranked in buckets of
    about SLOT_ROWS, and a bucket begins where those before it end."""
    buckets = max(1, rows // SLOT_ROWS)
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("k_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("shard", "bucket", before.alias("begins"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("k_id", "text_crc32")) - 1
    return dealt.withColumn("rank", rank).join(begins, ["shard", "bucket"]).withColumn("slot", (F.col("begins") + F.col("rank")).cast("long"))


def shard_table(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document,
    in shards of nearly equal bytes."""
    held = Written(points(docs), "points").df
    rows = held.count()
    cuts = tree(held, shards) if rows else []
    placed = with_slots(assign(held, cuts), rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
