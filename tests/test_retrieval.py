import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.functions import text as T
from lodestone.operators import containment
from lodestone.operators import retrieval as R

SEEDS = ("Café fee-related earnings rose in the year", "The river ran over old stones and the fee was small", "Assets under management were reported at year end", "fee related matters and fee related earnings", "nothing of note", "margin margin margin")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"{SEEDS[i % 6]} {'filler sentence ' * (i % 7)}number {i}") for i in range(122)]
    records = spark.createDataFrame([(i, t, T.index_words(t)) for i, t in rows], "chunk_id long, text string, words array<string>")
    return rows, R.postings(records, F.col("words")), R.corpus_stats(records, F.col("words"))


@pytest.mark.parametrize("query", ["fee-related earnings", "margin $ number", "cafe", "the the river", "zzz"])
def test_bm25_is_that_of_fts5(spark, corpus, query):
    rows, index, stats = corpus
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?, ?)", rows)
    phrases = T.query_phrases(query)
    match = " OR ".join(f'"{p}"' for p in phrases)
    want = {int(i): s for i, s in db.execute("SELECT id, bm25(f) FROM f WHERE f MATCH ?", (match,))}
    table = spark.createDataFrame([(1, n, T.index_words(p)) for n, p in enumerate(phrases)], "query_id int, phrase_no int, words array<string>")
    got = {r.id: r.score for r in R.bm25(index, table, stats).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_date_filters_come_after_the_limit(spark, corpus):
    _, index, stats = corpus
    phrases = spark.createDataFrame([(1, 0, ["number"])], "query_id int, phrase_no int, words array<string>")
    everything = R.lexical_topk(index, phrases, stats, 2)
    late = R.lexical_topk(index, phrases, stats, 2, dated=spark.createDataFrame([(121,)], "id long"))
    assert everything.count() == 2 and late.count() <= 1


def test_vectors(spark):
    eye = [(101, [1.0, 0.0, 0.0]), (202, [0.0, 1.0, 0.0]), (303, [0.0, 0.0, 1.0])]
    vectors = spark.createDataFrame(eye, "id long, vector array<float>")
    query = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query_vector array<float>")
    top = lambda **k: [r.id for r in R.dense_topk(vectors, query, 3, **k).orderBy("rank").collect()]
    assert top() == [101, 202, 303] and top(allowed=vectors.where("id > 200").select("id")) == [202, 303] and top(allowed=vectors.where("false").select("id")) == []


def test_fusion_adds_reciprocal_ranks(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "query_id int, id int, rank int")
    rows = R.fuse(ranked([7, 8]), ranked([8, 9]), 3).orderBy("rank").collect()
    assert [r.id for r in rows] == [8, 7, 9] and abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-9


def test_candidates_compare_dates_as_text(spark):
    documents = spark.createDataFrame([("a", None, "2025-01-01", None), ("b", "2024-05-01", "2025-01-01", None), ("c", None, None, None)], "document_id string, reporting_period_date string, publication_date string, file_creation_date string")
    records = documents.select("document_id", F.concat("document_id", F.lit("1")).alias("chunk_id"))
    ids = lambda *a: {r.id for r in R.candidates(records, documents, *a).collect()}
    assert ids() == {"a1", "b1", "c1"} and ids(None, "2025-01-01") == {"a1"} and ids(["b", "c"], None, "2025") == {"b1"}


def test_neighbours_in_rounds(spark):
    records = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None, f"c{i + 1}" if i < 5 else None) for i in range(6)], "chunk_id string, previous_chunk_id string, next_chunk_id string")
    seeds = spark.createDataFrame([(1, "c2", 0), (1, "c5", 1)], "query_id int, chunk_id string, ordinal int")
    order = lambda r: [x.id for x in R.neighbours(records, seeds, r).orderBy("nth").collect()]
    assert order(0) == ["c2", "c5"] and order(1) == ["c2", "c5", "c1", "c3", "c4"] and set(order(2)) == {f"c{i}" for i in range(6)}


def test_passages_inside_texts(spark):
    texts = spark.createDataFrame([(1, "one two three four"), (2, "xone two threey"), (3, "a.b")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "one two three"), (2, "."), (3, "two three"), (4, "missing words here")], "item_id long, passage string")
    assert {tuple(r) for r in containment.contained_passages(texts, passages).collect()} == {(1, 1), (2, 1), (1, 3), (2, 3), (3, 2)}


def test_hashed_embeddings_find_their_text(spark):
    from lodestone.functions.embedding import hashed_embedding

    texts = spark.createDataFrame([(i, f"{t} {'filler sentence ' * 5}") for i, t in enumerate(SEEDS)], "id long, text string")
    vectors = texts.select("id", hashed_embedding(F.col("text")).alias("vector"))
    queries = texts.select(F.col("id").alias("query_id"), hashed_embedding(F.col("text")).alias("query_vector"))
    assert {(r.query_id, r.id) for r in R.dense_topk(vectors, queries, 1).collect()} == {(i, i) for i in range(len(SEEDS))}
    assert spark.range(1).select(hashed_embedding(F.lit("--")).alias("v")).first().v is None


def test_golden_gate(spark):
    from lodestone.functions import arrow

    records = spark.createDataFrame([("c1", 1, "Fee-related earnings were $345 million"), ("c2", 2, "Output the table only.")], "chunk_id string, page int, normalized_text string")
    hits = spark.createDataFrame([("a", "c1"), ("b", "c1")], "query_id string, id string")
    case = lambda *rows: spark.createDataFrame(list(rows), "case_id string, passages array<string>, absent string, absence_pages array<int>")
    gate = lambda cases: R.golden_results(cases, hits, records, arrow.text_contains).first()
    assert tuple(gate(case(("a", ["fee-related  EARNINGS"], "table only", [1]), ("b", ["$345 million"], None, None)))) == (1.0, 2, True)
    assert gate(case(("a", ["fee-related earnings"], "table only", None))).holds is False and gate(case(("a", ["nowhere"], None, None))).recall == 0.0


LANGUAGES = (
    "Le café de l’été était fermé après la fête à Besançon", "Die größten Straßen führen über Köln und Düsseldorf nach München", "El niño pequeño comió una piña en el jardín de la montaña",
    "The naïve river café ran over old stones", "Le cafe de l'ete etait grand", "Ein Müller und ein Muller in Köln", "Россия и ёлка, Αθήνα 中文", "El jardín del niño y la montaña, otra vez el jardín del niño",
)


def test_unicode_queries_are_those_of_fts5(spark, tmp_path):
    import __spark_entry__ as entry

    items = ["été était fermé", "größten Straßen führen", "niño pequeño comió", "jardín del niño", "the naïve river", "Россия и ёлка"]
    spark.createDataFrame(list(enumerate(LANGUAGES)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f (rowid, text) VALUES (?, ?)", enumerate(LANGUAGES))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, row)")
    assert {(r.token, r.n_docs, r.occurrences) for r in run("postings_stats")} == set(db.execute("SELECT term, doc, cnt FROM v"))
    ranks, holds, counts = {}, set(), {}
    for q, text in enumerate(items):
        a, b, c = text.split()
        match = f'"{a}" OR "{b}" OR "{c}"'
        for n, (i, score) in enumerate(db.execute("SELECT rowid, bm25(f) AS s FROM f WHERE f MATCH ? ORDER BY round(s, 9), rowid LIMIT 8", (match,))):
            ranks[q, i] = n + 1, round(score, 5)
        holds |= {(q, i) for (i,) in db.execute("SELECT rowid FROM f WHERE f MATCH ?", (f'"{text}"',))}
        counts |= {q * 100 + n: held for n, w in enumerate((a, b, c)) if (held := db.execute("SELECT count(*) FROM f WHERE f MATCH ?", (f'"{w}"',)).fetchone()[0])}
    got = {(r.query_id, r.id): (r.rank, r.score) for r in run("bm25_topk")}
    assert got.keys() == ranks.keys() and all(got[k][0] == ranks[k][0] and abs(got[k][1] - ranks[k][1]) < 2e-5 for k in got)
    assert {(r.query_id, r.id) for r in run("phrase_scan")} == holds
    assert {r.query_id: r.candidates for r in run("exact_scan_guard")} == counts


def test_unicode_words_of_documents_are_those_of_fts5(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO f VALUES (?)", [(t,) for t in texts])
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, row)")
    want = {}
    for t in texts:
        for w in T.index_words(t):
            want[w] = want.get(w, 0) + 1
    assert want == dict(db.execute("SELECT term, cnt FROM v"))


def test_native_words_are_the_plain_ones(spark):
    texts = [*LANGUAGES, "", "İstanbul ŒUVRE ǅ x̂y a_b 1½ ①", *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").select("text", C.index_words(F.col("text")).alias("words"), C.search_parts(F.col("text")).alias("parts"))
    assert not [r.text for r in rows.collect() if r.words != T.index_words(r.text) or r.parts != T.query_phrases(r.text)]


def test_phrases_of_repeated_words(spark):
    records = spark.createDataFrame([(1, ["a", "a", "a", "b"]), (2, ["a", "b", "a"]), (3, [])], "chunk_id long, words array<string>")
    phrases = spark.createDataFrame([(1, 0, ["a", "a"]), (1, 1, ["a", "b"]), (2, 0, ["a", "b"]), (2, 1, ["b"]), (2, 2, ["c"])], "query_id int, phrase_no int, words array<string>")
    for index in (R.postings(records, F.col("words")), R.postings(records, F.col("words"), phrases=phrases)):
        assert {tuple(r) for r in R.phrase_hits(index, phrases).collect()} == {(1, 0, 1, 2, 4), (1, 1, 1, 1, 4), (1, 1, 2, 1, 3), (2, 0, 1, 1, 4), (2, 0, 2, 1, 3), (2, 1, 1, 1, 4), (2, 1, 2, 1, 3)}


@pytest.mark.parametrize("block_words", [R.BLOCK_WORDS, 3])
def test_phrase_scans_are_index_lookups(spark, block_words):
    texts = ["a a a b", "a b a", "", None, "long a b a long a b a b", "b long a", "x a b a long", "a", "the long word stands last", "the long word stands last"]
    rows = [*enumerate(texts), (9, texts[9]), (0, "b a a")]  # a repeated row and one of another length
    records = spark.createDataFrame(rows, "chunk_id long, text string")
    items = ["a a", "a b", "a b", "b", "c", "long a b a", "b a long", "word stands last", "a a a b b", "a b a long a b a b", ""]
    phrases = spark.createDataFrame([(q, 0, i.split()) for q, i in enumerate(items)], "query_id int, phrase_no int, words array<string>")
    want = {}
    for i, words in {(i, tuple(t.split())) for i, t in rows if t}:
        for q, item in enumerate(items):
            p = tuple(item.split())
            if p and (f := sum(words[n : n + len(p)] == p for n in range(len(words)))):
                want[q, 0, i, len(words)] = f
    found = R.phrase_scan(records, C.index_words(F.col("text")), phrases, block_words=block_words).collect()
    assert {(r.query_id, r.phrase_no, r.id, r.dl): r.f for r in found} == want and len(found) == len(want)
    unique = records.where("text IS NOT NULL").dropDuplicates(["chunk_id"])
    index = R.postings(unique, C.index_words(F.col("text")))
    scanned = R.phrase_scan(unique, C.index_words(F.col("text")), phrases, block_words=block_words)
    assert sorted(scanned.collect()) == sorted(R.phrase_hits(index, phrases).collect())
    assert R.phrase_scan(records, C.index_words(F.col("text")), phrases.where("false"), block_words=block_words).count() == 0


def test_phrase_scan_shuffles_no_postings(spark, tmp_path):
    import __spark_entry__ as entry

    word = F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda n: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", n), F.lit(40))))
    texts = spark.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", word).alias("text"))  # 8 files, so they aren't spread again
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    first = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id = 7").first().text.split()
    items = [" ".join(first[n : n + 30]) for n in range(0, 300, 30)] + [" ".join(f"w{n}" for n in range(40))]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sc = spark.sparkContext

    def written():
        """Shuffle bytes that all stages have written so far."""
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))

    before = written()
    found = {(r.query_id, r.id, r.f) for r in entry.queries()["phrase_scan"](spark, str(tmp_path)).collect()}
    assert found == {(q, 7, 1) for q in range(10)}
    assert written() - before < 100_000  # 600,000 words


def test_inspection(spark):
    documents = spark.createDataFrame([("d", "Name"), ("e", "Other")], "document_id string, document_name string")
    pages = spark.createDataFrame([("d", n, str(n), f"text {n}", None) for n in (3, 1, 2)], "document_id string, page int, page_label string, raw_text string, table_markdown string")
    wanted = lambda *rows: spark.createDataFrame(list(rows), "query_id int, document_id string, page_from int, page_to int")
    got = {r.query_id: [p.page for p in r.pages] for r in R.inspect(documents, pages, wanted((1, "d", None, None), (2, "d", 2, None), (3, "d", None, 1), (4, "e", 1, 9))).collect()}
    assert got == {1: [1, 2, 3], 2: [2, 3], 3: [1], 4: []}
    with pytest.raises(Exception, match="unknown document: x"):
        R.inspect(documents, pages, wanted((1, "x", None, None))).collect()
    with pytest.raises(ValueError, match="mode"):
        R.search("fuzzy", pages)
