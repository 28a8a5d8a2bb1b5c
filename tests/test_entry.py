import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["token_estimate", "paragraph_split", "table_rows", "turn_links", "dense_topk_filtered", "phrase_scan", "search_dense_filtered", "inspect_pages", "ordered_chunks", "neighbor_radius", "terminal_status_agreement", "committed_tokens", "bind_generated_assertions", "claim_status", "absence_conclusion"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) >= 40


@pytest.mark.parametrize("name", CHECKED)
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda rs: sorted((tuple(r) for r in rs), key=str)
    assert rows(got.select(columns).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_a_missing_part_of_the_training_operators_leaves_the_rest(monkeypatch):
    monkeypatch.setitem(__import__("sys").modules, "lodestone.llm.queries", None)  # its import raises ImportError
    assert len(entry.queries()) >= 60 and not [n for n in entry.queries() if n.startswith(("op1", "op5", "pipeline"))]
    assert set(entry.oracle_sql()) <= set(entry.queries())
