"""The corpus pipeline stage by stage, and the registration of its queries."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
from recollect.llm import byte_bpe
from recollect.operators.staging import stage

SF = "/root/testdata/sf0.001"


def grams(text):
    words = text.encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, apply in corpus_pipeline.STAGES:
        found.append(stage(apply(spark, found[-1], SF), name))
    return found


def test_all_queries_are_registered():
    names = entry.queries()
    assert [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None


def test_columns_and_rows_of_every_stage(results):
    docs, known, single, mixed, tokens = results
    assert [r.columns for r in (known, single, mixed)] == [docs.columns] * 3
    ids = [[row["doc_id"] for row in r.select("doc_id").collect()] for r in results]
    assert set(ids[3]) <= set(ids[2]) <= set(ids[1]) <= set(ids[0])
    assert sorted(ids[4]) == sorted(ids[3]) and len(ids[1]) > 0.95 * len(ids[0])


def test_one_document_of_each_group_stays(results):
    rows = {r["doc_id"]: grams(r["text"]) for r in results[1].collect()}
    parent = {k: k for k in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in rows:
        for b in rows:
            if a < b and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in results[2].collect()) == sorted(k for k in rows if find(k) == k)


def test_tokens_are_those_of_the_mixed_rows(results):
    path = public_tokenizers.path(corpus_pipeline.RANK_FILE)
    with open(path, "rb") as file:
        ranks = byte_bpe.Merges(file.read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in results[3].collect()}
    for row in results[4].collect():
        ids = np.array(library.encode_ordinary(texts[row["doc_id"]]), "<u4")
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), name)
    assert docs.count() == 0
