"""BPE encoding and decoding by a prefix-sharing trie.

The documents are only mapped over: each batch's distinct pre-tokens that no
earlier batch has met, sorted, are the leaves of a trie in depth-first order.  The
walk keeps the nodes on the path to the present leaf, and each node has the last
token of its prefix's encoding.  A prefix's encoding is its last token put behind
the encoding of what stands before that token, so what words share at their start
is encoded once.  The memory of a worker is bounded, in bytes of its tables.

A last token is right if it stands at the prefix's end, its own parts merge back
to it, and no merge would reach across the boundary to the token before it.  The
tokens that stand at a prefix's end come from an automaton over all tokens
(Aho-Corasick), longest first.

Cases: null and empty texts give no ids; repeated rows give equal rows; an empty
table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Bytes, about, of a generation of words, of the token pairs and of the automaton's
#: further steps.  A full generation of words becomes the old one, from which what is
#: met again is taken over; full pairs are begun anew, full steps take no more.
WORDS, PAIRS, STEPS = 16 << 20, 12 << 20, 6 << 20
#: Bytes of an entry of a dictionary of numbers, and what a word's entry has
#: besides its text and ids.
ENTRY, WORD_ENTRY = 110, 190
#: Texts without these characters are split by PLAIN: they are in normal form C,
#: lower() goes character by character, and letters and digits can be listed.
OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\u0180-\U0010ffff]")
LETTERS, DIGITS, BLANKS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the
#: characters from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_SELF)]
BYTES = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(_REST)}
BACK = {c: b for b, c in BYTES.items()}
NEVER = 1 << 60


class TrieBpe:
    """Encodes words whose last symbol bears the vocabulary's word end.

    Tables are keyed by numbers (two tokens, or a state and a byte), and properties
    of tokens and states stand in arrays, so that a worker's copy stays small.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        none = [0] * (max(ids.values(), default=-1) + 1)
        self.rank: dict[int, int] = {}
        # The rank of the merge that makes a token (-1: none) and the parts it joins.
        self.made, self.left, self.right = array("i", [-1] * len(none)), array("i", none), array("i", none)
        for rank, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, token = ids[x], ids[y], ids[x + y]
            self.rank[a << 32 | b] = rank
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = rank, a, b
        self.size = array("i", none)
        inner, final = {}, {}
        for name, token in ids.items():
            spelt = name.removesuffix(end)
            self.size[token] = len(spelt)
            if (self.made[token] >= 0 or len(spelt) == 1) and self._merges_back(token):
                (final if spelt != name else inner)[bytes(map(BACK.__getitem__, spelt))] = token
        self._automaton(inner, final if end else inner)
        self.pairs: dict[int, bool] = {}

    def _automaton(self, inner: dict[bytes, int], final: dict[bytes, int]) -> None:
        """States for the tokens' prefixes; a state's fallback is its longest proper
        suffix that is one."""
        step, depth = {}, [0]
        for spelt in chain(inner, final):
            state = 0
            for b in spelt:
                below = step.setdefault(state << 8 | b, len(depth))
                if below == len(depth):
                    depth.append(depth[state] + 1)
                state = below
        fallback = array("i", [0] * len(depth))
        for _, key, below in sorted((depth[below], key, below) for key, below in step.items()):
            back, b = fallback[key >> 8], key & 255
            while back and back << 8 | b not in step:
                back = fallback[back]
            fallback[below] = step.get(back << 8 | b, 0) if key >> 8 else 0
        self.step, self.fallback, self.most_steps = step, fallback, len(step) + STEPS // ENTRY
        self.ends = []
        for tokens in (inner, final):
            at = array("i", [-1] * len(depth))
            for spelt, token in tokens.items():
                state = 0
                for b in spelt:
                    state = step[state << 8 | b]
                at[state] = token
            self.ends.append(at)
        # Tokens that end a prefix in a state, longest first; filled when first asked for.
        self.inner: list[tuple[int, ...] | None] = [None] * len(depth)
        self.final: list[tuple[int, ...] | None] = [None] * len(depth)

    def _stepped(self, state: int, b: int) -> int:
        """A step that is not in the table."""
        key = state << 8 | b
        while True:
            below = self.step.get(state << 8 | b)
            if below is not None or not state:
                break
            state = self.fallback[state]
        below = below or 0
        if len(self.step) < self.most_steps:
            self.step[key] = below
        return below

    def _listed(self, which: int, state: int) -> tuple[int, ...]:
        found, at = [], state
        while at:
            if self.ends[which][at] >= 0:
                found.append(self.ends[which][at])
            at = self.fallback[at]
        (self.final if which else self.inner)[state] = made = tuple(found)
        return made

    def _crossed(self, a: int, b: int, until: int = NEVER) -> bool:
        """Would a merge reach across the boundary between two tokens, before rank
        ``until``?  The merges at the boundary are undone, latest first; equal ranks go
        to the one further left."""
        while self.rank.get(a << 32 | b, NEVER) >= until:
            if self.made[a] > self.made[b]:
                a, until = self.right[a], self.made[a]
            elif self.made[b] >= 0:
                b, until = self.left[b], self.made[b] + 1
            else:
                return False
        return True

    def _merges_back(self, token: int) -> bool:
        if self.made[token] < 0:
            return True
        a, b = self.left[token], self.right[token]
        return not self._crossed(a, b, self.made[token]) and self._merges_back(a) and self._merges_back(b)

    def _fits(self, pair: int) -> bool:
        if len(self.pairs) > PAIRS // ENTRY:
            self.pairs.clear()
        known = self.pairs[pair] = not self._crossed(pair >> 32, pair & 0xFFFFFFFF)
        return known

    def encode(self, distinct: list[str]) -> dict[str, list[int]]:
        """The ids of each distinct word."""
        spelt = sorted(w.encode() for w in distinct)
        return {w.decode(): ids for w, ids in zip(spelt, self.walk(spelt), strict=True)}

    def walk(self, distinct: list[bytes]) -> list[list[int]]:
        """The ids of each distinct word; the words (UTF-8, none empty) are sorted."""
        step, inner, final, pairs, size = self.step, self.inner, self.final, self.pairs, self.size
        states, last = [0], [-1]  # of the nodes on the path: state of the automaton, last token
        out, before = [], b""
        for word in distinct:
            n = len(word)
            shared, most = 0, min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            before = word
            del states[shared + 1 :], last[shared + 1 :]
            state = states[shared]
            for at in range(shared + 1, n):
                b = word[at - 1]
                below = step.get(state << 8 | b)
                state = self._stepped(state, b) if below is None else below
                for token in inner[state] or self._listed(0, state):
                    start = at - size[token]
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    fits = pairs.get(pair)
                    if self._fits(pair) if fits is None else fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:at]!r}")
                states.append(state)
                last.append(token)
            b = word[-1]
            below = step.get(state << 8 | b)
            state = self._stepped(state, b) if below is None else below
            for token in final[state] or self._listed(1, state):
                start = n - size[token]
                if not start:
                    break
                pair = last[start] << 32 | token
                fits = pairs.get(pair)
                if self._fits(pair) if fits is None else fits:
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids = [token]
            while start:
                ids.append(last[start])
                start -= size[ids[-1]]
            ids.reverse()
            out.append(ids)
        return out


class Codec:
    """From texts to ids and decoded text, with a worker's tables."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.bpe = TrieBpe(path)
        names = {i: name for name, i in read["model"]["vocab"].items()} | {x["id"]: x["content"] for x in read["added_tokens"]}
        self.names = pa.array([names.get(i, "") for i in range(max(names, default=-1) + 1)], pa.string())
        self.decimals = pa.array(map(str, range(len(self.names))), pa.string())
        self.added = {x["content"]: x["id"] for x in read["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # The library splits texts that PLAIN can't; it gets no vocabulary.
        rules = Tokenizer.from_str(json.dumps(read | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normal, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.known, self.old, self.bytes = self._first(), {}, 0

    def _first(self) -> dict[str, bytes]:
        """The ids (four bytes each) of the words known from the start."""
        return {x: array("i", [i]).tobytes() for x, i in self.added.items()}

    def pieces(self, text: str) -> list[str]:
        """The words that merges stay within, normalized."""
        if "<|" not in text and not OTHER.search(text):
            return PLAIN.findall(text.lower())
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out += [bytes(map(BACK.__getitem__, x)).decode() for x, _ in self.split(self.normal(part))]
        return out

    def learn(self, words: list[str]) -> None:
        """Enter words that are not known yet, by one trie."""
        spelt = sorted(w.encode() for w in words)
        for word, ids in zip(spelt, self.bpe.walk(spelt), strict=True):
            self.known[word.decode()] = array("i", ids).tobytes()
            self.bytes += WORD_ENTRY + len(word) + 4 * len(ids)

    def texts(self, texts: list[str]) -> list[pa.Array]:
        """Ids (decimal, joined by spaces) and decoded text of each text."""
        split = [self.pieces(text) for text in texts]
        ends = pa.array([0, *accumulate(map(len, split))], pa.int32())
        coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        del split
        met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.bytes > WORDS:
            self.old, self.known, self.bytes = self.known, self._first(), 0
        known, old = self.known, self.old
        new = [w for w in met if w not in known]
        for w in old.keys() & new:
            known[w] = old[w]
            self.bytes += WORD_ENTRY + len(w) + len(old[w])
        self.learn([w for w in new if w not in known])
        ids = [known[w] for w in met]
        flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
        starts = pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32) // 4)
        joined = (pc.binary_join(pa.ListArray.from_arrays(starts, x.take(flat)), " ") for x in (self.decimals, self.names))
        return [pc.binary_join(pa.ListArray.from_arrays(ends, x.take(coded.indices)), " ") for x in joined]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


#: Characters of text taken at once, so that a batch's distinct words stay few.
TAKE = 1_000_000


def groups(texts: list[str] | pa.Array) -> Iterator[list[str]]:
    """Runs of texts of about TAKE characters; of a column, one run at a time is made
    into strings."""
    run, size = [], 0
    for text in texts:
        run.append(text.as_py() if isinstance(text, pa.Scalar) else text)
        size += len(run[-1])
        if size >= TAKE:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by spaces) and decoded text of each whole text."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            done = 0
            for run in groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[done : done + len(run)], *made.texts(run)], names=["doc_id", "ids", "decoded"])
                done += len(run)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole().alias("text")).mapInArrow(coded, f"doc_id {kind}, ids string, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of coded texts."""
    n = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace("ids", F.lit(" "), F.lit(""))) + 1)
    return coded.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
