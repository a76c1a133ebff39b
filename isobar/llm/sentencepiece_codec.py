"""SentencePiece encoding and decoding that keeps every piece's place.

A text is normalised by the longest prefix that the model's compiled character map
(a double-array trie) replaces; each character made remembers where in the text it
came from.  The normalised text is cut where no piece of the model reaches across;
such words are merged pair by pair, best score first, and what a worker has met it
keeps.  Pieces stand at places of the normalised text, and the alignment takes these
to the bytes of the text as it was.

A character that no piece has goes as its bytes: the last of them has the
character's bytes, the others are empty spans before it.  The begin and end ids have
empty spans at the text's ends.

Cases: null and empty texts give the begin and end ids alone; repeated rows give
equal rows; an empty table gives an empty result; columns besides doc_id and text
are ignored.  Models that aren't BPE, or that have user-defined pieces or spaces at
words' ends, are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import groups
from .common import whole

SPACE = "▁"
#: Fixed values of the model format: kinds of pieces, and the one kind of model read.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Words, and characters in them, that a worker keeps; beyond either it begins anew.
CACHE, CACHE_CHARACTERS = 400_000, 8_000_000
#: Symbols from which on a heap finds the next merge.
LONG = 48


def fields(message: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Numbers and values of a serialised message's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        wire = key & 7
        if wire == 0:
            value, at = number(at)
        elif wire == 2:
            size, at = number(at)
            value, at = message[at : at + size], at + size
        else:
            size = 4 if wire == 5 else 8
            value, at = struct.unpack("<f" if wire == 5 else "<d", message[at : at + size])[0], at + size
        yield key >> 3, value


class CharacterMap:
    """Replacements by longest prefix, read from the compiled form: a trie in units
    of 32 bits, then the replacements, each ended by a zero."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.made = compiled[4 + size :]
        first = [b for b in range(256) if self._child(self._below(0), b) is not None] if size else []
        self.start = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in first) + b"]") if first else None

    def _below(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, base: int, byte: int) -> int | None:
        at = base ^ byte  # no key has a zero byte: its label marks what a key ends with
        return at if byte and at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Bytes that the longest known prefix of data[at:] has, and what replaces them."""
        base, found = self._below(0), None
        for k in range(at, len(data)):
            node = self._child(base, data[k])
            if node is None:
                break
            base = self._below(node)
            if self.units[node] >> 8 & 1:
                found = k + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.made[found[1] : self.made.index(b"\0", found[1])].decode()

    def units_of(self, data: bytes) -> Iterator[tuple[int, str, bool]]:
        """Byte place and text of stretches: as they were, or replaced (True)."""
        at = done = 0
        while met := self.start.search(data, at):
            at = met.start()
            replaced = self.longest(data, at)
            if replaced is None:
                at += 1
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1
                continue
            if done < at:
                yield done, data[done:at].decode(), False
            yield at, replaced[1], True
            at = done = at + replaced[0]
        if done < len(data):
            yield done, data[done:].decode(), False


def byte_places(text: str) -> np.ndarray:
    """Where each character begins in UTF-8, and where the text ends."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)]).astype(np.int64)


class Model:
    """A model's pieces, its normaliser, and the words a worker has met."""

    def __init__(self, serialised: bytes):
        self.pieces: list[str] = []
        kinds, scores, normaliser, trainer = [], [], {}, {}
        for key, value in fields(serialised):
            if key == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece[2])
                kinds.append(piece[3])
            elif key == 2:
                trainer = dict(fields(value))
            elif key == 3:
                normaliser = dict(fields(value))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or USER in kinds:
            raise ValueError("only BPE models without user-defined pieces, with spaces before words, are read")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.unknown, self.begin, self.end = trainer.get(40, 0), trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.ids = {p: k for k, p in enumerate(self.pieces) if kinds[k] in (NORMAL, UNUSED)}
        order = {s: k for k, s in enumerate(sorted({scores[k] for k in self.ids.values()}, reverse=True))}
        self.rank = {p: order[scores[k]] for p, k in self.ids.items() if len(p) > 1}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if kinds[k] == BYTE} if trainer.get(35, 0) else {}
        self.surfaces = [
            None if kind == BYTE else "" if kind == CONTROL else self.unknown_text if k == self.unknown else p.replace(SPACE, " ")
            for k, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True))
        ]
        self.cut = self._cutter()
        self.known: dict[str, tuple[bytes, bytes, str]] = {}
        self.kept = 0

    def _cutter(self) -> re.Pattern:
        """Words of a normalised text that pieces don't cross: a run of spaces and then
        characters that pieces join, directly or through others.  One word, if a piece
        has a space after another character."""
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            return re.compile(".+", re.DOTALL)
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for p in self.rank:
            own = p.lstrip(SPACE)
            for c in own:
                root.setdefault(c, c)
            for a, b in pairwise(own):
                root[find(a)] = find(b)
        classes: dict[str, list[str]] = {}
        for c in root:
            classes.setdefault(find(c), []).append(c)
        runs = ["[" + "".join(map(re.escape, sorted(cs))) + "]+" for cs in sorted(classes.values(), key=len, reverse=True)]
        return re.compile((f"{SPACE}*(?:{'|'.join(runs)})|" if runs else "") + f"{SPACE}+|.", re.DOTALL)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the byte
        of ``text`` that it came from."""
        if not text:
            return "", np.zeros(1, np.int64)
        space = SPACE if self.escape else " "
        if self.map.start is None and not self.trim:
            places = byte_places(text)
            made = text.replace(" ", space)
            return (space + made, np.concatenate([[0], places])) if self.prefix else (made, places)
        data = text.encode()
        parts, places = [], []
        for at, piece, new in self.map.units_of(data) if self.map.start else [(0, text, False)]:
            parts.append(piece)
            places.append(np.full(len(piece), at) if new else at + byte_places(piece)[:-1])
        made = "".join(parts)
        source = np.concatenate([*places, [len(data)]]).astype(np.int64)
        first = 0
        if self.trim:
            blank = np.frombuffer(made.encode("utf-32-le"), np.uint32) == 32
            if blank.all():
                return "", np.zeros(1, np.int64)
            first = source[int(np.argmin(blank))]
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))  # of a run of blanks the first, at the start none
            source, made = np.append(source[:-1][keep], source[-1]), "".join(compress(made, keep))
        made = made.replace(" ", space)
        if self.trim:
            made = made.rstrip(space)
            source = source[: len(made) + 1]
        return (space + made, np.concatenate([[first], source])) if self.prefix else (made, source)

    def merged(self, word: str) -> list[str]:
        """The word's symbols when no neighbours join into a piece any more: the pair of
        best score first, of equal scores the leftmost."""
        symbols = list(word)
        if len(symbols) >= LONG:
            return self._merged_long(symbols)
        rank, none = self.rank.get, len(self.pieces)
        ranks = [rank(a + b, none) for a, b in pairwise(symbols)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(symbols[at] + symbols[at + 1], none)
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + symbols[at], none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        n, rank = len(symbols), self.rank.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, k, a + b) for k, (a, b) in enumerate(pairwise(symbols)) if (r := rank(a + b)) is not None]
        heapq.heapify(queue)

        def offer(k: int) -> None:
            if k >= 0 and (j := after[k]) < n and (r := rank(both := symbols[k] + symbols[j])) is not None:
                heapq.heappush(queue, (r, k, both))

        while queue:
            _, k, both = heapq.heappop(queue)
            j = after[k]
            if not symbols[k] or j >= n or symbols[k] + symbols[j] != both:
                continue  # one of the two has gone into another symbol
            symbols[k], symbols[j] = both, ""
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            offer(before[k])
            offer(k)
        return [s for s in symbols if s]

    def word(self, word: str) -> tuple[bytes, bytes, str]:
        """Ids, ends of their characters in the word, and the decoded word."""
        ids, ends, at = [], [], 0
        for s in self.merged(word):
            id_ = self.ids.get(s)
            if id_ is not None or not self.bytes:
                ids.append(self.unknown if id_ is None else id_)
            else:
                own = [self.bytes[b] for b in s.encode()]
                ids += own
                ends += [at] * (len(own) - 1)
            at += len(s)
            ends.append(at)
        return array("i", ids).tobytes(), array("i", ends).tobytes(), self.decoded(ids)

    def decoded(self, ids: list[int]) -> str:
        """The text of ids within a word: pieces with spaces again, bytes as characters."""
        parts = [self.surfaces[k] for k in ids]
        if None not in parts:
            return "".join(parts)
        made = b"".join(bytes([int(self.pieces[k][3:5], 16)]) if p is None else p.encode() for k, p in zip(ids, parts, strict=True))
        return made.decode(errors="replace")

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE or self.kept > CACHE_CHARACTERS:
            self.known, self.kept, new = {}, 0, words
        for w in new:
            self.known[w] = self.word(w)
            self.kept += len(w)

    def texts(self, texts: list[str]) -> list[pa.Array]:
        """Ids, first bytes, ends of bytes, and decoded text, of each text."""
        words: list[str] = []
        counts, sources = [], []
        for text in texts:
            made, source = self.normalised(text)
            own = self.cut.findall(made)
            words += own
            counts.append(len(own))
            sources.append(source)
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy()
        self.learn(distinct)
        met = list(map(self.known.__getitem__, distinct))
        ids, ends = (np.frombuffer(b"".join([m[k] for m in met]), np.int32) for k in (0, 1))
        size = np.array([len(m[0]) // 4 for m in met], np.int64)
        length = np.array([len(w) for w in distinct], np.int64)

        n = len(texts)
        per_word = size[index]
        word_ends = np.cumsum([0, *counts])
        token_ends = np.concatenate([[0], np.cumsum(per_word)])
        tokens = np.diff(token_ends[word_ends])  # of each text
        total = int(token_ends[-1])
        taken = np.repeat((np.cumsum(size) - size)[index] - token_ends[:-1], per_word) + np.arange(total)
        base = np.cumsum(length[index]) - length[index]
        stop = ends[taken] + np.repeat(base, per_word)  # among the characters of all texts
        start = np.concatenate([[0], stop[:-1]])
        text = np.repeat(np.arange(n), tokens)
        at = np.arange(total) + 2 * text + 1
        source = np.concatenate([np.zeros(0, np.int64), *sources])  # a character more each text
        bounds = np.concatenate([[0], np.cumsum(tokens + 2)])
        first, last = bounds[:-1], bounds[1:] - 1
        out = np.zeros((3, total + 2 * n), np.int32)
        out[0, at], out[1, at], out[2, at] = ids[taken], source[start + text], source[stop + text]
        out[0, first], out[0, last] = self.begin, self.end
        out[1:, last] = np.array([len(t.encode()) for t in texts], np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in out]
        surfaces = pa.array([m[2] for m in met], pa.string()).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(word_ends, pa.int32()), surfaces), "")
        if self.prefix or self.trim:
            joined = pa.array([t.removeprefix(" ") for t in joined.to_pylist()], pa.string())
        return [*lists, joined]


@lru_cache(2)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, starts and ends (bytes of the text, end exclusive, an entry an id)
    and decoded text of each whole text."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model(path)
        for batch in batches:
            done = 0
            for run in groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[done : done + len(run)], *made.texts(run)], names=["doc_id", "ids", "starts", "ends", "decoded"])
                done += len(run)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole().alias("text")).mapInArrow(coded, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and spans_sha256 (little-endian, 32 bits a number;
    spans are starts, then ends), decoded_sha256 of coded texts."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in (1, 2, 3)]
            flat = [np.ascontiguousarray(c.values.to_numpy(), "<i4") for c in columns]
            offsets = columns[0].offsets.to_numpy()
            cuts = [slice(a, b) for a, b in pairwise(offsets.tolist())]
            if any((c.offsets.to_numpy() != offsets).any() for c in columns[1:]):
                raise ValueError("an id has no span")
            sha = lambda *parts: hashlib.sha256(b"".join(parts)).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array([sha(flat[0][c].tobytes()) for c in cuts], pa.string()),
                    pa.array([sha(flat[1][c].tobytes(), flat[2][c].tobytes()) for c in cuts], pa.string()),
                    pa.array([sha(t.encode()) for t in batch.column(4).to_pylist()], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"],
            )

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, spans_sha256 string, decoded_sha256 string")
