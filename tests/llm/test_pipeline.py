"""The pipeline's stages in order, each on what the one before kept, against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from ledgerlake.llm import mixing, toxicity
from ledgerlake.llm.common import documents, materialize
from tests.llm.test_ops import EDGE, brute_components, check_packing

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_stages(spark):
    df = documents(spark, SF)
    columns = df.columns
    rows = {r.doc_id: r for r in df.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    def stage(name, docs):
        out = materialize(STAGE[name](spark, docs, SF), name)
        found = out.collect()
        assert out.columns == columns and all(r == rows[r.doc_id] for r in found) and len({r.doc_id for r in found}) == len(found)
        return out, sorted(r.doc_id for r in found)

    df, clean = stage("toxicity", df)
    model = toxicity.fit(toxicity.training_sample(spark, documents(spark, SF), SF))
    assert clean == sorted(r.doc_id for r in toxicity.score_toxicity(documents(spark, SF), model).where("score < 0.5").collect())

    df, single = stage("exact_dedup", df)
    first = {}
    for i in clean:
        first.setdefault(normal(rows[i].text), i)
    assert single == sorted(first.values())

    df, apart = stage("near_dedup", df)
    components = brute_components([(i, rows[i].text) for i in single])
    assert apart == sorted(i for i, _, _, kept in components if kept)

    before = df
    df, mixed = stage("mixing", df)
    told = {r.doc_id: r for r in mixing.mix(before).collect()}
    assert mixed == sorted(i for i, r in told.items() if r.selected) and set(told) == set(apart)
    tokens, goal = sum(r.n_tokens for r in told.values()), sum(r.n_tokens * r.probability for r in told.values())
    assert abs(sum(told[i].n_tokens for i in mixed) - goal) < 0.1 * tokens

    pieces = STAGE["packing"](spark, df, SF).collect()
    sequences = check_packing(pieces, [(i, rows[i].text) for i in mixed])
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= df.rdd.getNumPartitions()


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls in any column, empty, blank and very long texts, repeated ids and rows, and columns that the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, topic string, sha string, comp long, key string, id long, probability double"
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", None, "x", None, 1, "k", k, 0.5) for k, (i, t) in enumerate(EDGE)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_with_odd_rows(spark, odd):
    df = documents(spark, odd)
    columns = df.columns
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before = Counter((r.doc_id, r.text) for r in df.collect())
        df = materialize(stage(spark, df, odd), name)
        after = Counter((r.doc_id, r.text) for r in df.collect())
        assert df.columns == columns and not after - before
        if name == "exact_dedup":
            assert sum(after.values()) == len({normal(t) for _, t in EDGE})
        if name == "near_dedup":
            groups = brute_components([(k, t) for k, (_, t) in enumerate(before.elements())])
            assert sum(1 for _, t in after.elements() if (t or "").split()) == sum(kept for _, n, _, kept in groups if n)
    pieces = STAGE["packing"](spark, df, odd).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in df.collect()])


def test_run_with_odd_rows_and_without_rows(spark, odd, tmp_path):
    assert corpus_pipeline.run(spark, odd).count() >= 0
    none = tmp_path / "none"
    for table in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{table}.parquet").limit(0).write.parquet(f"{none}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(none)).collect() == []
