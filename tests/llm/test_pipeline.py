"""Every stage of the pipeline on its own input, against plain Python."""

import re

import pytest
from cases import TEXTS, awkward, empty
from test_host_rules import expected
from test_near_dup import brute_force
from test_passages import exact_runs
from test_tokens import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from wavelead.llm.queries import vocabulary
from wavelead.llm.quality import score_documents
from wavelead.storage import materialize

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(materialize(stage(spark, made[-1], SF), "test"))
    return made


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_classifier(spark, stages):
    scores = {r["doc_id"]: r["predicted"] for r in score_documents(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = rows_of(stages[1])
    assert set(kept) == {k for k, p in scores.items() if p == 1}
    before = rows_of(stages[0])
    assert all(kept[k] == before[k] for k in kept)
    assert 0.7 < len(kept) / len(scores) < 1


def test_rules(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    fine = {k for k, r in before.items() if not expected(r["text"])["base_failed"]}
    assert set(after) == fine  # no host fails for the most part here
    assert all(after[k] == before[k] for k in after)


def test_near_duplicates(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    component, _ = brute_force({k: r["text"] for k, r in before.items()})
    assert set(after) == set(component.values())
    assert all(after[k] == before[k] for k in after)


def test_substring_dedup(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert set(after) == set(before)
    runs = exact_runs({k: r["text"] for k, r in before.items()}, 50)
    for k, row in after.items():
        if row["text"] == before[k]["text"]:
            assert row == before[k] and k not in runs
        else:
            assert row["n_chars"] == len(row["text"]) < before[k]["n_chars"]
    assert not exact_runs({k: r["text"] for k, r in after.items()}, 51)


def test_packing(stages):
    texts = {k: r["text"] for k, r in rows_of(stages[4]).items()}
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert check_packing(rows, texts, Tokenizer.from_str(vocabulary())) > 0.97


def test_awkward_tables(spark):
    for source in (awkward(spark), empty(spark)):
        docs = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), "test")
            assert docs.columns == source.columns
        left = docs.count()
        assert left < len(TEXTS) + 2
        assert all(len(re.findall(r"\S+", r["text"])) >= 50 for r in docs.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= left
