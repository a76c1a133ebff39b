"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table, broadcast: 64-bit hashes of frequent pre-tokens
in order, and how many tokens each has.  It is bounded (``FREQUENT`` entries of
nine bytes) and learnt from a bounded sample, which can only change how often it
is hit: what it misses, tier two encodes through the worker's own cache.  No
pre-token is shuffled; the documents are mapped over once.

Cases: null and empty texts have no bytes and no tokens; repeated rows give equal
rows; an empty table gives an empty result; columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import BACK, OTHER, groups
from .common import whole

#: Entries of tier one, of a task's candidates for it, and of a worker's tier two.
FREQUENT, CANDIDATES, CACHE = 60_000, 60_000, 400_000
#: The sample: files at most, spread over the input, and about so many rows.
SAMPLE_FILES, SAMPLE_ROWS = 8, 10_000
#: Pre-tokens of texts without OTHER characters, whose classes can be listed.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Counts:
    """Token counts of pre-tokens, with a worker's tier two."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.added = {x["content"] for x in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text and not OTHER.search(text):
            return PLAIN.findall(text)
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out += [bytes(map(BACK.__getitem__, x)).decode() for x, _ in self.split(part)]
        return out

    def misses(self, pieces: list[str]) -> list[int]:
        """Tier two."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = pieces
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            self.cache.update(zip(some, map(len, self.library.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        return [self.cache[p] for p in pieces]

    def texts(self, texts: list[str], hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        split = [self.pieces(t) for t in texts]
        coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = np.zeros(len(distinct), np.int64)
        own = hashed(distinct)
        at = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
        hit = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
        found[hit] = lengths[at[hit]] if len(hashes) else 0
        missed = np.flatnonzero(~hit)
        found[missed] = self.misses([distinct[k] for k in missed])
        ends = np.cumsum([0, *map(len, split)])
        sums = np.concatenate([[0], np.cumsum(found[coded.indices.to_numpy()])]).astype(np.int64)
        return sums[ends[1:]] - sums[ends[:-1]]


def hashed(pieces: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) for p in pieces), np.uint64, len(pieces))


@lru_cache(2)
def counts(path: str) -> Counts:
    return Counts(path)


def sample(docs: DataFrame, files: int = SAMPLE_FILES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` texts: of a few whole files where docs come from files."""
    paths = sorted(docs.inputFiles())
    if len(paths) > files:
        some = [paths[k * len(paths) // files] for k in range(files)]
        docs = docs.sparkSession.read.schema(docs.schema).parquet(*some)
    n = docs.count()
    return docs.select(whole().alias("text")).sample(min(1.0, rows / max(n, 1)), 11)


def frequent(some: DataFrame, path: str, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Tier one: hashes in order, and token counts.  Tasks send their most
    frequent pre-tokens, sums are taken by key, and ``size`` rows are kept."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = counts(path), Counter()
        for batch in batches:
            for run in groups(batch.column(0)):
                seen.update(chain.from_iterable(map(made.pieces, run)))
        top = seen.most_common(CANDIDATES)
        pieces = [p for p, _ in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashed(pieces).view(np.int64)), pa.array(np.array(made.misses(pieces), np.int64)), pa.array([n for _, n in top], pa.int64())],
            names=["hash", "tokens", "n"],
        )

    rows = (
        some.mapInArrow(tally, "hash long, tokens long, n long")
        .groupBy("hash").agg(F.first("tokens").alias("tokens"), F.sum("n").alias("n"))
        .where(F.col("tokens") < 256)
        .coalesce(4).orderBy(F.desc("n"), "hash").limit(size).select("hash", "tokens").toPandas()
    )
    hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["tokens"].to_numpy(np.int64)[order].astype(np.uint8)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, tier_one: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(sample(docs), path, tier_one))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counts(path)
        hashes, lengths = table.value
        for batch in batches:
            n = [made.texts(run, hashes, lengths) for run in groups(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], names=["doc_id", "n_bytes", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), whole().alias("text"))
    return taken.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
