"""SentencePiece, collocations and spelling variants against plain versions."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from isobar.llm import collocations, spelling
from isobar.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "▁", "é", "日", "🙂", "\n", "\x00", "<s>", "</s>", "<0x0A>", "ing", "the", "'s", ".", "1", "23", "ﬁ", "𐍈", "́", "‍", "क", "्", "한", "\t", "ａ", "Ⅳ", "ｶﾞ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*made, "", " ", "   ", "x" * 3000, " " * 400, "ab" * 2000, "á" * 300, "word " * 500]


def want(library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
    size = len(text.encode())
    return ids, [(0, 0), *spans, (size, size)], library.decode(ids)


def test_pieces_and_spans_equal_the_library(library, strange):
    ids, starts, ends, decoded = (x.to_pylist() for x in codec.Model(open(PATH, "rb").read()).texts(strange))
    for k, text in enumerate(strange):
        assert (ids[k], list(zip(starts[k], ends[k], strict=True)), decoded[k]) == want(library, text)


def test_a_full_cache_changes_nothing(library, strange, monkeypatch):
    made = codec.Model(open(PATH, "rb").read())
    monkeypatch.setattr(codec, "CACHE", 100)
    for k in range(0, 200, 5):
        got = [x.to_pylist() for x in made.texts(strange[k : k + 5])]
        assert got[0] == [want(library, t)[0] for t in strange[k : k + 5]]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [True, False])
def test_alignment_through_compiled_maps(rule, trim, strange):
    """Normalised texts and where they came from, by the library's own rules."""
    plain = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=trim, escape_whitespaces=True)
    compiled = dict(codec.fields(dict(codec.fields(plain.serialized_model_proto()))[3]))[2]
    made = codec.Model.__new__(codec.Model)
    made.map, made.prefix, made.trim, made.escape = codec.CharacterMap(compiled), True, trim, True
    for text in strange[:600]:
        got, source = made.normalised(text)
        norm, offsets = plain.normalize(text, with_offsets=True)
        places = codec.byte_places(text)
        assert got == norm and source.tolist() == [int(places[k]) for k in offsets]


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="only BPE"):
        codec.Model(b"\x12\x02\x18\x01")


def test_sentencepiece_codec(docs, texts, none, library):
    coded = codec.encode_decode(docs, PATH)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(i, t):
        ids, spans, decoded = want(library, t or "")
        pack = lambda xs: struct.pack(f"<{len(xs)}I", *xs)
        return i, len(ids), sha(pack(ids)), sha(pack([a for a, _ in spans]) + pack([b for _, b in spans])), sha(decoded.encode())

    got = codec.digests(coded).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(row(*x)) for x in texts)
    assert coded.columns == ["doc_id", "ids", "starts", "ends", "decoded"]
    assert codec.digests(codec.encode_decode(none, PATH)).count() == 0


# collocations


def phrase_report(rows, least, most_rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = set()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= 100 * own[p[i:j]]:
                        inside.add(p[i:j])
        found = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, x, n[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(found)[:most_rows])]  # noqa: E741
    return out


@pytest.mark.parametrize("shard", [500, 10**7])
@pytest.mark.parametrize("least,most_rows", [(2, 10**6), (5, 7)])
def test_collocations(spark, docs, texts, shard, least, most_rows):
    made = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("de")).otherwise(F.lit("und")))
    rows = [(t, None if i is not None and i % 3 == 0 else "de" if i is not None and i % 3 == 1 else "und") for i, t in texts]
    got = [tuple(r) for r in collocations.collocations(made, least, most_rows, shard).collect()]
    assert sorted(got) == sorted(phrase_report(rows, least, most_rows)) and len(got) > 10


def test_suffix_order_and_counts():
    """Places in the order of their next five words, and counts of all lengths, in shards of few words."""
    rng = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(25))) + rng.choice(".! ") for _ in range(rng.randrange(1, 12))]
        made = collocations.shard(texts, "en")
        names = made.words.to_pylist()
        want_counts = Counter()
        for t in texts:
            for piece in re.split("[.!]", t):
                w = piece.split()
                want_counts.update(" ".join(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
        got = Counter()
        for places, count, n in collocations.grams(made.ids, 1, 5):
            for p, c in zip(places, count, strict=True):
                got[" ".join(names[made.ids[p + k]] for k in range(n))] += int(c)
        assert got == want_counts
        if want_counts:
            order, _ = collocations.suffixes(made.ids, 5)
            key = [(*made.ids[p : p + 5].tolist(), *[-1] * 5)[:5] for p in order]
            assert key == sorted(key)


def test_shared_bits_change_nothing(docs, monkeypatch):
    plain = sorted(map(tuple, collocations.collocations(docs, 3).collect()))
    bits = collocations.bitmap
    monkeypatch.setattr(collocations, "bitmap", lambda df: df.sparkSession.sparkContext.broadcast(np.full_like(bits(df).value, 255)))
    assert sorted(map(tuple, collocations.collocations(docs, 3).collect())) == plain


def test_rows_with_text_grow_as_the_shards(spark, monkeypatch):
    """Five times the texts, in which all pairs of words are frequent that weren't: no phrase's text comes from every shard."""
    sent, kind = [], type(spark.range(0))
    plain = kind.mapInArrow

    def seen(self, f, schema, *a, **b):
        out = plain(self, f, schema, *a, **b)
        if "string" in schema and f.__name__ == "count":
            sent.append(out.count())
        return out

    monkeypatch.setattr(kind, "mapInArrow", seen)
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(60)), "en") for _ in range(400)]
    made = []
    for some in (rows[:80], rows):
        sent.clear()
        got = collocations.collocations(spark.createDataFrame(some, "text string, lang string").coalesce(1), 20, 2000, 1000)
        assert sorted(map(tuple, got.collect())) == sorted(phrase_report(some, 20, 2000))
        made.append(sum(sent))
    assert 0 < made[1] < 6 * made[0]


def test_words_of_one_hash_are_told_apart(docs, monkeypatch):
    """Words are hashed anew where frequent ones share a hash with others."""
    plain = sorted(map(tuple, collocations.collocations(docs, 3).collect()))
    counts, salts = collocations.word_counts, []

    def clashing(docs, size, salt):
        salts.append(salt)
        made = counts(docs, size, salt)
        return made if salt else made.withColumn("h", F.lit(7).cast("long"))

    monkeypatch.setattr(collocations, "word_counts", clashing)
    assert sorted(map(tuple, collocations.collocations(docs, 3).collect())) == plain and salts == [0, 1]


def test_scores_beyond_64_bits(spark):
    big = 10**14
    rows = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "c", 1, 7), ("en", "b c", 2, 5)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    n = 2 * big
    got = collocations.best(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big - 1, big, big, n, 1999), ("en", 2, "b c", 5, big, 7, n, 1428)]


def test_no_collocations(none):
    assert collocations.collocations(none).count() == 0


# spelling


def variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in n if v != w and one(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, n[w], len(near[w]), form[w], n.get(form[w]), root


def test_spelling_variants(spark, docs, texts, none):
    rng = random.Random(9)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(60)]
    more = [(k, " ".join(rng.choice(base) for _ in range(400))) for k in range(1000, 1020)]
    chain = [(2000, " ".join(["letters"] * 40 + ["letter"] * 19 + ["lettr"] * 8 + ["lEttré"] * 3))]
    every = [*texts, *more, *chain]
    made = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*more, *chain], "doc_id long, text string"))
    got = sorted(map(tuple, spelling.spelling_variants(made).collect()), key=repr)
    assert got == sorted(variants(every), key=repr)
    by = {w: (form, root) for w, _, _, form, _, root in got}
    assert by["lettr"] == ("letter", "letters") and by["lettré"] == ("lettr", "letters")
    assert spelling.spelling_variants(none).count() == 0


def test_a_long_word_and_a_hub(spark):
    """A run of thousands of letters, and a word with hundreds of near ones."""
    long = "ab" * 1500
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    hub = {"absorbed"[:k] + c + "absorbed"[k:] for k in range(9) for c in letters} - {"absorbed"}
    rows = [(k, f"{long} {long[1:]} ") for k in range(4)] + [(10 + k, " ".join(["absorbed"] * 9 + sorted(hub))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r for r in spelling.spelling_variants(docs).collect()}
    assert got[long]["n_near"] == got[long[1:]]["n_near"] == 1 and got[long]["form"] is None
    found = [w for w, r in got.items() if r["form"] == "absorbed"]
    assert len(found) > 300 and got["absorbed"]["n_near"] >= len(found) and got["absorbed"]["root"] == "absorbed"
