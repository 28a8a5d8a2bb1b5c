import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrow
from lodestone.functions import columns as C
from lodestone.functions import text as T
from lodestone.operators import chunking
from lodestone.sources import corpus


def test_chunks_of_long_lines():
    words = [f"token-{i}" for i in range(4000)]
    parts = chunking.chunk_page(" ".join(words))
    assert len(parts) > 1 and all(T.estimate_tokens(p) <= 710 for p in parts)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(parts, parts[1:]))
    assert {w for p in parts for w in p.split()} == set(words)


def test_two_paragraphs_overlap():
    parts = chunking.chunk_page(" ".join(f"a{i}" for i in range(400)) + "\n\n" + " ".join(f"b{i}" for i in range(400)))
    assert len(parts) == 2 and all(T.estimate_tokens(p) <= 700 for p in parts) and set(parts[0].split()) & set(parts[1].split())


def test_small_pages():
    assert chunking.chunk_page("") == [] and chunking.chunk_page(" \n ") == [] and chunking.chunk_page("one line") == ["one line"]
    assert chunking.tail("a b c d", 3) == "c d" and chunking.tail("a b", 0) == ""
    short_rest = " ".join(["w"] * 480) + "\n\n" + "tiny end"
    assert len(chunking.chunk_page(short_rest)) == 1


def test_records_and_links(spark):
    pages = spark.createDataFrame([("d", "n", p, str(p), o, f"page {p} text") for o, p in enumerate((3, 1, 2))] + [("e", "n", 1, "1", 0, None)], "document_id string, document_name string, page int, page_label string, page_order int, raw_text string")
    rows = {r.page: r for r in chunking.with_links(chunking.checked(chunking.chunks(pages))).collect()}
    assert len(rows) == 3 and rows[3].previous_chunk_id is None and rows[3].next_chunk_id == rows[1].chunk_id and rows[2].previous_chunk_id == rows[1].chunk_id
    assert rows[1].chunk_id == "chk_" + T.sha256("d:1:0")[:16] and rows[1].sha256 == T.sha256("page 1 text") and len(rows[1].chunk_id) == 20
    doubled = chunking.chunks(pages.where("page = 3")).unionByName(chunking.chunks(pages.where("page = 3")))
    assert chunking.collisions(doubled).count() == 1
    with pytest.raises(Exception, match="collision"):
        chunking.checked(doubled).collect()


def test_native_columns(spark):
    row = spark.range(1).select(
        C.token_estimate(F.lit("a b  c")).alias("n"), C.preview(F.lit("x" * 300)).alias("p"), C.chunk_number(F.lit("chk_ffffffffffffffff")).alias("c"), C.chunk_number(F.lit("chk_FF")).alias("bad"),
        C.table_markdown(F.lit("Name  Value\nFees   3\nplain")).alias("t"), C.table_markdown(F.lit("one  two")).alias("none"), C.canonical_digits(F.lit("000.500")).alias("d"), C.document_id(F.lit("ab")).alias("doc"),
    ).first()
    assert row.n == 4 and len(row.p) == 278 and row.p.endswith("…") and int(row.c) == 2**64 - 1 and row.bad is None and row.none is None
    assert row.t == "| Name | Value |\n| --- | --- |\n| Fees | 3 |" and row.d == "0.5"
    assert row.doc == "doc_" + T.sha256('{"include_pages":null,"source_sha256":"ab"}')[:24]
    with pytest.raises(Exception, match="zero vector"):
        spark.range(1).select(C.l2_normalize(F.array(F.lit(0.0)))).collect()


def test_sql_functions(spark):
    arrow.register(spark)
    row = spark.sql("SELECT normalize_evidence('a  b') n, metric_key('U.S. revenue') k, temporal_signature('Q1 2025') t, numeric_signatures('$2 million')[0].digits d, bind_observation('Revenue was $2.', 'Revenue', '$2', 'reported_level', NULL).profile p").first()
    assert tuple(row) == ("a b", "US revenue", "quarter:2025-q1", "2", "direct_copula")
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunk_page('one')").collect()] == [(0, "one")]


def test_definition_and_text_pages(spark, tmp_path):
    definition = {"corpus_id": "c", "display_name": "C", "documents": [{"path": "a.txt", "include_pages": [2, 1]}, {"path": "b.docx"}]}
    (tmp_path / "d.json").write_text(json.dumps(definition))
    rows = corpus.read_definition(spark, str(tmp_path / "d.json"))
    assert [(r.nth, r.path, r.include_pages) for r in rows.orderBy("nth").collect()] == [(0, "a.txt", [2, 1]), (1, "b.docx", None)]
    with pytest.raises(Exception, match="unsupported"):
        rows.select(corpus.source_kind(F.col("path"))).collect()
    (tmp_path / "a.txt").write_text("hello there")
    (tmp_path / "b.txt").write_text(" \n")
    assert corpus.read_text_pages(spark, [str(tmp_path / "a.txt")]).first().raw_text == "hello there"
    with pytest.raises(Exception, match="no text"):
        corpus.read_text_pages(spark, [str(tmp_path / "b.txt")]).collect()


def test_binary_pages(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"one|two|three")
    pages = lambda chosen: corpus.read_binary_pages(spark, str(tmp_path / "x.bin"), lambda b: b.decode().split("|"), chosen)
    assert [(r.page, r.raw_text) for r in pages([3, 1]).orderBy("page_order").collect()] == [(3, "three"), (1, "one")] and pages(None).count() == 3
    with pytest.raises(Exception, match="no page 9"):
        pages([9]).collect()


def test_publish_is_immutable_and_checked(spark, tmp_path):
    pages = spark.createDataFrame([("d", "n", 1, "1", 0, "some text"), ("d", "n", 2, "2", 1, "more text")], "document_id string, document_name string, page int, page_label string, page_order int, raw_text string")
    records = chunking.with_links(chunking.chunks(pages))
    first = corpus.publish(records, tmp_path, "c", [{"document_id": "d"}])
    assert corpus.publish(records, tmp_path, "c", [{"document_id": "d"}])["corpus_version"] == first["corpus_version"]
    assert corpus.load_current(tmp_path)["manifest_sha256"] == first["manifest_sha256"] and corpus.verify_version(spark, tmp_path, first["corpus_version"], records) == []
    assert corpus.verify_version(spark, tmp_path, first["corpus_version"], records.limit(1)) == ["vector ids"]
    assert not list(tmp_path.glob("_build_*"))
    path = tmp_path / first["corpus_version"] / "manifest.json"
    path.write_text(path.read_text().replace('"c"', '"other"'))
    with pytest.raises(ValueError):
        corpus.load_current(tmp_path)
    with pytest.raises(ValueError):
        corpus.load_manifest(tmp_path, "../x")


def test_artifacts_stay_inside(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a").write_text("x")
    (tmp_path / "b").write_text("x")
    digest = T.sha256("x")
    assert corpus.artifacts_match(tmp_path / "root", [{"source_file": "a", "source_sha256": digest}])
    assert not corpus.artifacts_match(tmp_path / "root", [{"source_file": "../b", "source_sha256": digest}])
    assert not corpus.artifacts_match(tmp_path / "root", [{"source_file": "a", "source_sha256": "0"}])


def test_embedding_batches(spark):
    rows = spark.createDataFrame([(f"c{i}", "t" * (i + 1)) for i in range(5)], "chunk_id string, normalized_text string")
    out = corpus.embed_batches(rows, lambda texts: [[float(len(t)), 0.0] for t in texts], size=2).collect()
    assert len(out) == 5 and all(list(r.vector) == [1.0, 0.0] for r in out)


def test_all_documents_are_normalized(spark, tmp_path):
    import re
    import unicodedata

    import __spark_entry__ as entry

    texts = ["plain  ascii\n text ", "L\u2019e\u0301te\u0301  \ufb01nit", "Stra\u00dfen-\n  bahn in K\u00f6ln", "ni\u00f1o\u00a0peque\u00f1o \u00bd", "line-\nbreak", "a - \n b", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: " ".join(re.sub(r"(\w)-\s*\n\s*(?=\w)", r"\1", unicodedata.normalize("NFKC", t)).split()) for i, t in enumerate(texts)}
    got = {r.doc_id: r.normalized for r in entry.queries()["normalized_documents"](spark, str(tmp_path)).collect()}
    assert got == want and got[1] == "L\u2019\u00e9t\u00e9 finit" and got[2] == "Stra\u00dfenbahn in K\u00f6ln" and got[4] == "linebreak"
