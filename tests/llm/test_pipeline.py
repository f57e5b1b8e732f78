"""Stages of the pipeline on a small corpus, and the registered queries on the smallest given tables."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgermatch.llm.oracle import ORACLE
from ledgermatch.llm.queries import QUERIES, table
from ledgermatch.sources.rounds import RunFolder
from tests.llm.test_operators import brute_components, brute_lines

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it returned."""
    folder, docs, out = RunFolder(spark), table(spark, SF, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = folder.table(stage(spark, docs, SF), f"stage-{k}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = map(rows, stages["toxicity"])
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if r.doc_id in before}
    assert all(after[i] == before[i] for i in after)
    assert np.mean([i not in after for i, t in labels.items() if t == 1]) > 0.9
    assert np.mean([i in after for i, t in labels.items() if t == 0]) > 0.98


def test_lines_go(stages):
    before, after = map(rows, stages["line dedup"])
    want = {i: (n, text) for i, _, n, text in brute_lines([(r.doc_id, r.text) for r in before.values()])}
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert r.text == (want[i][1] if want[i][0] else before[i].text) and r.n_chars == len(r.text)
    assert any(n for n, _ in want.values())


def test_one_document_of_each_group_stays(stages):
    before, after = map(rows, stages["near dedup"])
    given = [(r.doc_id, r.text) for r in before.values()]
    assert set(after) == set(brute_components(given)[2])
    assert all(after[i] == before[i] for i in after)


def test_contaminated_documents_go(spark, stages):
    before, after = map(rows, stages["decontamination"])
    found = {r.doc_id: r.contaminated for r in QUERIES["op1_decontamination"](spark, SF).collect()}
    assert all(after[i] == before[i] for i in after)
    assert set(before) - set(after) <= set(before)
    kept = [i for i in before if not found[i]]
    assert set(kept) <= set(after)


def test_mix_has_every_document(stages):
    before, after = map(rows, stages["mixing"])
    assert after.keys() == before.keys() and all(r.taken == r.size * r.copies for r in after.values())


def test_run_gives_what_the_stages_give(spark, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in stages["mixing"][1].collect()}


def _plain(value):
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    got = sorted((tuple(map(str, (r[c] for c in sorted(frame.columns)))) for r in frame.collect()))
    assert got
    if name not in ORACLE:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = con.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted(tuple(str(_plain(r[k])) for k in order) for r in found.fetchall())
    assert got == want
