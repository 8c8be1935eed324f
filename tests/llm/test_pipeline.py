import random

import pytest

import corpus_pipeline
from figmill.llm import bpe, queries, simhash, toxicity
from figmill.sources.staging import stage
from helpers import documents, lower, prose
from test_decontaminate import nearest, tokens
from test_likeness import brute_first

RUDE = "grumbok vexlout snarfle"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of known fate: ``(why it goes, text)``."""
    rng = random.Random(3)
    rows = []
    for n in range(240):
        rows.append((None, prose(n, rng.randint(30, 90), 2000)))
        if n % 4 == 0:
            own = prose(5000 + n, 60, 2000).split()
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(RUDE.split()))
            rows.append(("toxic", " ".join(own)))
    item = prose(9999, 40, 2000)
    rows += [("language", None), ("language", ""), ("language", "12 34 !!")]
    rows += [("copy", rows[k][1]) for k in (0, 2, 3, 3)]
    long = prose(31, 300, 2000).split()
    rows.append((None, " ".join(long)))
    for n in range(6):  # five of 300 words replaced: alike, but not in two bits
        other = list(long)
        for k in range(5):
            other[20 + 50 * k + n] = f"new{chr(97 + n)}{chr(97 + k)}"
        rows.append(("copy", " ".join(other)))
    rows += [("leak", f"{prose(7000 + k, 20, 2000)} {item} {prose(8000 + k, 20, 2000)}") for k in range(3)]
    path = tmp_path_factory.mktemp("pipeline")
    documents(spark, [t for _, t in rows]).write.parquet(f"{path}/documents.parquet")
    labels = [(n, 1, int(why == "toxic")) for n, (why, _) in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages_in_order(spark, folder):
    path, rows = folder
    docs = queries.read(spark, path, "documents").selectExpr("*", "1 AS score", "2 AS id", "3 AS ids")
    columns = docs.columns
    left = dict(enumerate(rows))
    for name, work in corpus_pipeline.STAGES[:-1]:
        docs = stage(work(spark, docs, path), "test")
        assert docs.columns == columns, name
        why = {"toxicity": "toxic", "language": "language", "near_duplicates": "copy", "decontamination": "leak"}[name]
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {left[n][0] for n in set(left) - kept} == {why}
        assert why not in {left[n][0] for n in kept}
        left = {n: left[n] for n in kept}
    assert set(left) == {n for n, (why, _) in enumerate(rows) if why is None}


def test_run_against_brute_force(spark, folder):
    """The later stages anew in plain Python, from what the learned ones keep."""
    path, rows = folder
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{queries.TOKENIZERS}/word_bpe_49k.json")
    kept = [(n, t) for n, (why, t) in enumerate(rows) if why not in ("toxic", "language")]
    stays = brute_first(kept)
    kept = [(n, t) for n, t in kept if n in stays]
    item = tokens(rows and prose(9999, 40, 2000))
    kept = [(n, t) for n, t in kept if nearest(item, tokens(lower(t))) > 0.2 * len(item)]
    found = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, path).collect()}
    assert found == {n: library.encode(t, add_special_tokens=False).ids for n, t in kept}


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = queries.read(spark, path, "documents").filter("false")
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, docs, path).count() == 0


def test_stages_call_five_operators():
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.ORACLE_SQL is None
    for module in (bpe, simhash, toxicity):
        assert module.__name__.split(".")[-1] in corpus_pipeline.__dict__
