"""The five stages on the smallest tables, each held against a plain version of what it decides."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parchmint.llm import near_dedup, secrets, toxicity
from parchmint.llm.shared import stored, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), name)
        out.append((name, before.toPandas(), docs.toPandas()))
    return {name: (a, b) for name, a, b in out}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    for name, (before, after) in stages.items():
        if name != "packing":
            assert list(after.columns) == list(before.columns) and len(after)


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    docs = table(spark, SMALL, "documents")
    scored = toxicity.fit(docs, table(spark, SMALL, "labels")).score(docs).where(F.col("score") < 0.3)
    assert sorted(after.doc_id) == sorted(r["doc_id"] for r in scored.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = [(i, near_dedup.shingle_set(t, 5)) for i, t in zip(before.doc_id, before.text, strict=True)]
    group = {i: i for i, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[n + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    assert sorted(after.doc_id) == sorted(i for i in group if root(i) == i)


def test_secrets_are_masked(stages):
    before, after = stages["secrets"]
    want = {i: secrets.masked(t) for i, t in zip(before.doc_id, before.text, strict=True)}
    assert dict(zip(after.doc_id, after.text, strict=True)) == want
    assert all(n == len(t) for n, t in zip(after.n_chars, after.text, strict=True))
    assert not any(s[0] != "literal" for t in after.text for s in secrets.find(t) if s[0] in ("access", "hex"))


def test_mixture_repeats_at_most_three_times(stages):
    before, after = stages["mixing"]
    assert after.doc_id.value_counts().max() <= 3 and set(after.doc_id) <= set(before.doc_id)


def test_packed_ids_are_the_documents(stages):
    before, after = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(sum(([i] for i in before.doc_id), []))
    assert after.groupby("doc_id").length.sum().sum() == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in before.text)
    assert sorted(set(want)) == sorted(set(after.doc_id))
    assert (after.groupby("sequence_id").length.sum() <= 2048).all()
