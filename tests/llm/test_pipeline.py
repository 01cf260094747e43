"""The stages against plain versions, each on what its predecessor kept, and the rows that run() gives."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrelq.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, out = tmp_path_factory.mktemp("stages"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert {"token_ids", "n_tokens"} <= set(stages[-1].columns)


def test_quality_agrees_with_labels(spark, stages):
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    kept = ids(stages[1])
    assert len(kept & bad) <= 0.2 * len(bad) and len(good & ids(stages[0]) - kept) <= 0.05 * len(good)


def test_near_duplicates_leave_no_alike_pair(stages):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    kept = ids(stages[2])
    assert not any(a in kept and b in kept for a, b in alike)
    assert set(sets) - {b for _, b in alike} == kept


def test_substrings_and_decontamination_and_tokens(spark, stages):
    from tests.llm.test_operators import plain_contamination, plain_removal

    before = [(r.doc_id, r.text) for r in stages[2].collect()]
    removed = {i: n for i, _, n, _ in plain_removal(before, 20)}
    after = {r.doc_id: r.text for r in stages[3].collect()}
    for i, text in before:
        words = (text or "").split()
        if i in after:
            assert len((after[i] or "").split()) == len(words) - removed[i] and (removed[i] or after[i] == text)
        else:
            assert removed[i] == len(words)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in plain_contamination(list(after.items()), items) if r[3] == 0}
    assert ids(stages[4]) == clean == ids(stages[5])
    assert stages[5].filter(~F.col("round_trip")).count() == 0


def test_near_duplicates_recall_against_all_rows(spark):
    """Queries are the ids divisible by 50, against all rows: every text of similarity 0.8 or more is in the query's group."""
    from kestrelq.llm import simhash
    from kestrelq.llm.common import Workspace

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    group = {r.doc_id: r.group for r in simhash.similar_texts(docs, Workspace(spark, "recall")).select("doc_id", "group").collect()}
    made = simhash.Shingles(simhash.STAGE_SHINGLE)
    sets = {r.doc_id: made.of(r.text) for r in docs.select("doc_id", "text").collect()}
    alike = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and (n := simhash._common(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert alike and all(group[a] == group[b] for a, b in alike)


def test_stages_pass_clashing_columns_and_edges(spark, docs, empty, clashing, tmp_path):
    """Nulls, empty and long texts, repeated rows, empty tables, and columns named like those of the operators."""
    extra = clashing.withColumns({c: F.lit("mine") for c in ("n_removed", "round_trip", "n_tokens", "component_id", "KEY")})
    for name, start in (("edges", docs), ("empty", empty), ("clashing", extra)):
        now = start
        for step, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, SF)
            assert name == "clashing" and step == "bpe" or made.columns[: len(start.columns)] == start.columns
            made.write.parquet(str(tmp_path / name / step))
            now = spark.read.parquet(str(tmp_path / name / step))
        got = now.collect()
        assert len(now.columns) == len(start.columns) + 3 and (name != "empty" or not got)
        if name == "clashing":
            assert {"token_ids_", "n_tokens_", "round_trip_"} <= set(now.columns)
            assert all(r[c] == "mine" for r in got for c in ("score", "predicted", "n_removed", "token_ids", "round_trip", "KEY")) and got


def test_registry_has_all_ten(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert corpus_pipeline.run(spark, SF).count() > 0
