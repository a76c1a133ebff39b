import random

import pytest
from pyspark.sql import functions as F

from ..conftest import oracle  # noqa: F401  (for the modules here)

#: Columns whose names operators also use inside.
CLASHING = ("words", "w", "h", "fp", "key", "size", "bucket", "shard", "slot", "host", "label", "score", "row", "n", "p", "a", "b", "cut", "crc", "node", "_text", "rank", "c", "_score", "__id", "__hash", "__text", "__lines", "__cut", "id")


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma", "dé", "x1", "Straße", "omega", "tau"]) + rng.choice("abcdefgh") for _ in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """Awkward texts, copies and near copies: (doc_id, text)."""
    rng = random.Random(5)
    base = [" ".join(sentence(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(3, 30))) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + k, base[0]) for k in range(30)]  # a large group of copies
    rows += [(200 + k, base[1] + f" extra{k}") for k in range(10)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "Two words"), (305, "a b c"), (306, "a\r\nb\x0bc\x0cd"), (307, "日本語 🙂 ñandú İx ΑΣ"), (308, "\n".join([base[2]] * 3))]
    rows += [(309, "word " * 3000), (310, base[3][:200] + base[4]), (311, "x" * 20_000), (312, "<|endoftext|> a<|startoftext|>b"), (None, base[5]), (None, None), (7, base[7]), (7, base[7]), (8, "same id, other text. " * 9)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 11 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return made.withColumns({c: F.lit("clash") for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
