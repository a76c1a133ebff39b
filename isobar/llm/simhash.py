"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are one.  Of five bit blocks, two fingerprints within three
bits share at least two, so ten keys of two blocks each bring every such pair
together; the keys are 25 or 26 bits long, and a key's fingerprints are a bucket.
In a bucket, fingerprints stand in blocks of 64 lanes, one bit plane each for the
64 bits.  A fingerprint is compared with a whole block at once: the planes that
differ from its bits are added up in carry-save counters of one bit a lane, and a
block is given up once all its lanes are over the radius.

A bucket of any size is compared whole: its fingerprints are dealt into cells of
about ``CELL``, and every pair of cells is a group of its own.  Groups give back
a spanning forest of their links, not the pairs.

Cases: null, empty and blank texts have fingerprint zero and link like others;
fewer than three words are one shingle; repeated rows and ids are one by one
given their component; a null doc_id never names a component unless no other id
is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_codec import groups
from .common import LOWER, UPPER, Written, if_small, whole
from .components import stars

SEED, RADIUS, SHINGLE = 42, 3, 3
#: Bits of the blocks, highest first, and blocks to a key.
BLOCKS, SHARED = (13, 13, 13, 13, 12), 2
#: Fingerprints of a bucket that are compared as one group.
CELL = 1024
#: Comparisons (fingerprint with block) and shingles held at a time.
AT_ONCE, HASHES = 200_000, 400_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str, n: int = SHINGLE) -> list[int]:
    """XXH64 of each run of n words, in order; of all words if there are fewer."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return []
    if len(words) < n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return [digest(join(x), SEED) for x in zip(*[words[k:] for k in range(n)], strict=False)]


def majority(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), HASHES):
        bits = np.unpackbits(np.array(hashes[k : k + HASHES], ">u8").view(np.uint8)).reshape(-1, 64)
        count += bits.sum(0, dtype=np.int64)
    return count


def fingerprints(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 64), np.uint8)
    for k, text in enumerate(texts):
        hashes = shingle_hashes(text)
        out[k] = 2 * majority(hashes) > len(hashes)
    return np.packbits(out, axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprinted(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, further columns, fp (the 64 bits as a long)."""
    read = docs.select("doc_id", *more, whole().alias("__text"))
    names = read.columns[:-1]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(run) for run in groups(batch.column(len(names)))]
            fp = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(fp)], names=[*names, "fp"])

    kinds = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in names)
    return read.mapInArrow(mapped, f"{kinds}, fp long")


def keys() -> Column:
    """The ten bucket keys of a fingerprint, told apart by their highest bits."""
    ends = np.cumsum(BLOCKS).tolist()
    block = [F.shiftrightunsigned("fp", 64 - e).bitwiseAND(F.lit((1 << n) - 1)) for n, e in zip(BLOCKS, ends, strict=True)]
    made = []
    for number, (a, b) in enumerate(combinations(range(len(BLOCKS)), SHARED)):
        made.append(F.shiftleft(block[a], BLOCKS[b]).bitwiseOR(block[b]).bitwiseOR(F.lit(number << 32)))
    return F.array(*made)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64: [bit, block], a lane a bit."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8)).reshape(-1, 64, 64)
    lanes = np.ascontiguousarray(bits.transpose(2, 0, 1))
    return np.packbits(lanes.reshape(-1, 64), axis=1).reshape(-1).view(">u8").astype(np.uint64).reshape(64, -1)


def within(fps: np.ndarray, query: np.ndarray, block: np.ndarray, plane: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which comparisons still have lanes within the radius, and these lanes.

    query[i] is compared with block[i].  Counters of one and two, one bit a lane,
    hold up to three; a lane that would reach four is over.
    """
    zero = np.zeros(len(query), np.uint64)
    at, ones, twos, over = np.arange(len(query)), zero, zero.copy(), zero.copy()
    asked = fps[query]
    for bit in range(64):
        differ = plane[bit, block[at]] ^ (np.uint64(0) - ((asked[at] >> np.uint64(63 - bit)) & np.uint64(1)))
        carry = ones & differ
        ones = ones ^ differ
        over = over | (twos & carry)
        twos = twos ^ carry
        if bit % 8 == 7:
            alive = (~over & used[block[at]]) != 0
            at, ones, twos, over = at[alive], ones[alive], twos[alive], over[alive]
    return at, ~over & used[block[at]]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def links(fps: np.ndarray, start: np.ndarray, lanes: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many groups.  start: where groups begin, and the end;
    lanes, asks: whether a row stands in its group's blocks, is compared with them."""
    n = len(fps)
    group = np.repeat(np.arange(len(start) - 1), np.diff(start))
    rows = np.flatnonzero(lanes)
    inside = np.bincount(group[rows], minlength=len(start) - 1)
    blocks = -(-inside // 64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    place = first[group[rows]] * 64 + np.arange(len(rows)) - np.concatenate([[0], np.cumsum(inside)])[group[rows]]
    lane_row = np.full(first[-1] * 64, -1)
    lane_row[place] = rows
    plane = planes(np.where(lane_row >= 0, fps[lane_row], 0).astype(np.uint64))
    used = np.packbits(lane_row.reshape(-1, 64) >= 0, axis=1).reshape(-1).view(">u8").astype(np.uint64)
    asking = np.flatnonzero(asks)
    times = blocks[group[asking]]
    query = np.repeat(asking, times)
    block = np.repeat(first[group[asking]], times) + np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
    root = np.arange(n)
    for k in range(0, len(query), AT_ONCE):
        at, hit = within(fps, query[k : k + AT_ONCE], block[k : k + AT_ONCE], plane, used)
        row, lane = np.nonzero(np.unpackbits(hit.astype(">u8").view(np.uint8)).reshape(-1, 64))
        a, b = query[k + at[row]], lane_row[block[k + at[row]] * 64 + lane]
        if len(a):
            root = forest(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, root]))
    found = np.flatnonzero(root != np.arange(n))
    return fps[found], fps[root[found]]


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups (key, i, j) that a sorted partition holds one after
    another; a group may go on in the next batch."""
    kept = np.zeros((5, 0), np.int64)
    for batch in batches:
        kept = np.hstack([kept, np.array([np.array(batch.column(c)) for c in ("key", "i", "j", "cell", "fp")], np.int64).reshape(5, -1)])
        if kept.shape[1]:
            new = np.flatnonzero((np.diff(kept[:3]) != 0).any(0)) + 1
            last = new[-1] if len(new) else 0
            if last >= 20_000 or last and kept.shape[1] > 8 * CELL:
                yield _answer(kept[:, :last])
                kept = kept[:, last:]
    if kept.shape[1]:
        yield _answer(kept)


def _answer(rows: np.ndarray) -> pa.RecordBatch:
    start = np.concatenate([[0], np.flatnonzero((np.diff(rows[:3]) != 0).any(0)) + 1, [rows.shape[1]]])
    fps = rows[4].view(np.uint64) if rows[4].flags.c_contiguous else np.ascontiguousarray(rows[4]).view(np.uint64)
    a, b = links(fps, start, lanes=rows[3] == rows[2], asks=rows[3] == rows[1])
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near(unique: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of fingerprints within the radius."""
    dealt = unique.select("fp", F.explode(keys()).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / F.lit(CELL)).cast("int")
    cell = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    met = dealt.join(sizes.select("key", cells.alias("cells")), "key").withColumn("cell", cell)
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    pairs = pairs.select("key", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), "cell", "fp")
    grouped = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return grouped.mapInArrow(bucket_links, "a long, b long")


def components(unique: DataFrame) -> DataFrame:
    """fp, root: the component of every fingerprint with a link, roots too."""
    roots = stars(near(unique.select("fp")))
    return roots.select(F.col("node").alias("fp"), "root").union(roots.select("root", "root").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable."""
    own = Written(fingerprinted(docs), "fingerprints").df
    unique = Written(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique").df
    linked = components(unique)
    smallest = linked.join(unique, "fp").groupBy("root").agg(F.min("first").alias("least"))
    component = linked.join(smallest, "root").select("fp", "least")
    # Written, so that both sides of the last join are exchanges and Spark can split a hot fingerprint's rows.
    named = Written(unique.join(component, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named").df
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(named, "fp").select("doc_id", hex_.alias("fingerprint"), "component_id")


def _text_hash() -> Column:
    return F.xxhash64(whole())


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns: that of the smallest id, or,
    where no id is in it, of the smallest text hash.

    Rows are told apart by id and text hash, as ids may be null or repeat, so texts
    are moved only where the keys that go are too many to broadcast; keys that
    several rows share are settled apart.
    """
    own = Written(fingerprinted(docs, _text_hash().alias("hash")), "fingerprints").df
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    unique = Written(own.groupBy("fp").agg(F.min(place).alias("first")), "unique").df
    linked = components(unique)
    smallest = linked.join(unique, "fp").groupBy("root").agg(F.min("first").alias("least"))
    component = linked.join(smallest, "root").select("fp", "least")
    named = Written(unique.join(component, "fp", "left").select("fp", F.coalesce("least", "first").alias("stays")), "named").df
    stays = (F.col("hash") == F.col("stays.hash")) & F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
    key = [F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")]
    found = Written(own.join(named, "fp").select(*key, stays.alias("stays")), "components").df
    gone = Written(found.where("NOT stays").select("__id", "__hash").distinct(), "gone").df
    shared = Written(found.where("stays").groupBy("__id", "__hash").count().where("count > 1").select("__id", "__hash"), "shared").df
    of = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*of).alias("row"), F.col("doc_id").alias("id"), _text_hash().alias("hash"))
    by_key = F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))
    left = held.join(if_small(gone), by_key, "left_anti")
    if shared.limit(1).count():
        some = if_small(shared)
        several = left.join(some, by_key, "left_semi")
        left = left.join(some, by_key, "left_anti").unionByName(several.dropDuplicates(["id", "hash"]))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
