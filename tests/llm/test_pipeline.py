"""The pipeline's stages, and the corpus queries against their SQL."""

import pytest

import corpus_pipeline
from isobar.llm.common import Written
from isobar.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA, as_rows, oracle

FOLDER = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before, counts = docs.dtypes, docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        made = Written(stage(spark, docs, FOLDER), name).df
        counts.append(made.count())
        if name != "bpe_codec":
            assert made.dtypes == columns
            assert made.select("doc_id").distinct().count() == counts[-1]
            docs = made
    assert before >= counts[0] == counts[1] > counts[2] >= counts[3] == counts[4] > before / 2
    assert corpus_pipeline.run(spark, FOLDER).count() == counts[-1]


def test_pipeline_equals_plain_stages(spark):
    """All rows of run(), from what the classifier keeps on, by the brute-force versions."""
    import hashlib

    from isobar.llm.quality_classifier import quality_scores

    from .test_operators import classes, contamination, deduplicated, fingerprint, library

    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    score = {r["doc_id"]: r["score"] for r in quality_scores(read("documents"), read("labels")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in read("documents").collect() if score[r["doc_id"]] >= 0.3]
    rows = list(deduplicated(rows))
    fps = {i: fingerprint(t) for i, t in rows}
    every = sorted(set(fps.values()))
    comp = classes(every, [(a, b) for a in every for b in every if (a ^ b).bit_count() <= 3])
    first = {}
    for i, _ in rows:
        first[comp[fps[i]]] = min(first.get(comp[fps[i]], i), i)
    rows = [(i, t) for i, t in rows if first[comp[fps[i]]] == i]
    bad = {i for i, *_, c in contamination(rows, [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]) if c}
    tok = library("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        if i not in bad:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), oracle(ORACLE_SQL[name], FOLDER)
    whole = {c: "Int64" for c, kind in theirs.dtypes.items() if str(kind) == "Int64"}  # pandas makes floats of longs beside nulls
    assert as_rows(ours.astype(whole)) == as_rows(theirs)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
