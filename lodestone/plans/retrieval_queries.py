"""Dense, lexical and fused search, exact scans, neighbours and quality over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.columns import index_words
from lodestone.operators import retrieval as R
from lodestone.plans.registry import query
from lodestone.plans.tables import item_phrases, query_phrases, query_vectors, spread, table, turns, vectors

_DOT = "list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: p[1] * p[2]))"


def _dense_sql(k: int, where: str = "", label: str = "dense") -> str:
    return f"""{label} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
    (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT}, 9) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 {where}) QUALIFY rank <= {k})"""


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+')"


def _hits_sql(phrases: str) -> str:
    """words, stats, phrases (query_id, phrase_no, p) and hits, of the given phrases."""
    return f"""words AS (SELECT doc_id AS id, {_words_sql("text")} AS w FROM documents), stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM words),
tokens AS (SELECT id, len(w) AS dl, unnest(w) AS token, unnest(range(len(w))) AS position FROM words),
phrases AS (SELECT * FROM ({phrases}) WHERE len(p) > 0),
parts AS (SELECT p, len(p) AS n, unnest(p) AS token, unnest(range(len(p))) AS place FROM (SELECT DISTINCT p FROM phrases)),
starts AS (SELECT p, id, dl FROM parts JOIN tokens USING (token) GROUP BY p, n, id, dl, position - place HAVING count(*) = n),
found AS (SELECT p, id, dl, count(*) AS f FROM starts GROUP BY ALL),
hits AS (SELECT query_id, phrase_no, id, dl, f FROM phrases JOIN found USING (p))"""


_QUERY_PHRASES = f"""SELECT query_id, phrase_no, {_words_sql("part")} AS p FROM (SELECT item_id AS query_id, unnest(range(len(t))) AS phrase_no, unnest(t) AS part
  FROM (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_.$%+-]+')[1:24] AS t FROM benchmark))"""
_ITEM_PHRASES = f"SELECT item_id AS query_id, 0 AS phrase_no, {_words_sql('text')} AS p FROM benchmark"

_LEXICAL = f"""{_hits_sql(_QUERY_PHRASES)}, freq AS (SELECT query_id, phrase_no, count(*) AS n FROM hits GROUP BY ALL),
bm AS (SELECT query_id, id, round(-sum((CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM hits JOIN freq USING (query_id, phrase_no), stats GROUP BY query_id, id)"""


def _index(spark, sf, phrases=None):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    words = index_words(F.col("text"))
    return R.postings(docs, words, "doc_id", phrases), R.corpus_stats(docs, words)


def _lexical(spark, sf):
    """Index (of the query's tokens), phrases and statistics."""
    phrases = query_phrases(spark, sf)
    index, stats = _index(spark, sf, phrases)
    return index, phrases, stats


@query("dense_topk", f"WITH {_dense_sql(10)} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM dense")
def dense_topk(spark, sf):
    return R.dense_topk(vectors(spark, sf), query_vectors(spark, sf), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("dense_topk_filtered", f"WITH {_dense_sql(10, 'AND v.label IN (1, 3)')} SELECT query_id, id, CAST(rank AS INT) AS rank FROM dense")
def dense_topk_filtered(spark, sf):
    allowed = table(spark, sf, "embeddings").where(F.col("label").isin(1, 3)).select(F.col("vec_id").alias("id"))
    return R.dense_topk(vectors(spark, sf), query_vectors(spark, sf), 10, allowed).select("query_id", "id", "rank")


@query("delete_then_search", f"WITH {_dense_sql(5, 'AND v.vec_id % 3 <> 0')} SELECT query_id, id, CAST(rank AS INT) AS rank FROM dense")
def delete_then_search(spark, sf):
    gone = table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    return R.dense_topk(vectors(spark, sf).join(gone, "id", "left_anti"), query_vectors(spark, sf), 5).select("query_id", "id", "rank")


@query("l2_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM embeddings")
def l2_norms(spark, sf):
    from lodestone.functions.columns import dot, l2_normalize

    unit = table(spark, sf, "embeddings").select("vec_id", l2_normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return unit.select("vec_id", F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 5).alias("norm"))


@query("id_membership", "SELECT doc_id, doc_id IN (SELECT vec_id FROM embeddings) AS present FROM documents")
def id_membership(spark, sf):
    known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("present"))
    return table(spark, sf, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("present", F.lit(False)).alias("present"))


@query("postings_stats", f"WITH w AS (SELECT doc_id, unnest({_words_sql('text')}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS occurrences FROM w GROUP BY token")
def postings_stats(spark, sf):
    index, _ = _index(spark, sf)
    return index.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("occurrences"))


@query("bm25_topk", f"WITH {_LEXICAL} SELECT query_id, id, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INT) AS rank FROM bm QUALIFY rank <= 8")
def bm25_topk(spark, sf):
    return R.lexical_topk(*_lexical(spark, sf), 8).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(
    "bm25_topk_filtered",
    f"""WITH {_LEXICAL}, first AS (SELECT query_id, id, score FROM bm JOIN documents d ON d.doc_id = id WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= 32)
    SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INT) AS rank FROM first WHERE id % 2 = 0 QUALIFY rank <= 8""",
)
def bm25_topk_filtered(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return R.lexical_topk(*_lexical(spark, sf), 8, docs.where("lang = 'en'"), docs.where("id % 2 = 0")).select("query_id", "id", "rank")


_FUSED = f"""{_dense_sql(24)}, {_LEXICAL}, lexical AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM bm QUALIFY rank <= 24),
    q AS (SELECT query_id * 50 AS query_id, id, score, rank FROM lexical), fused AS (SELECT query_id, id, d.score AS dense_score, q.score AS lexical_score, d.rank AS dense_rank, q.rank AS lexical_rank,
    round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + q.rank), 0), 9) AS score FROM dense d FULL JOIN q USING (query_id, id))"""


@query("rrf_fusion", f"WITH {_FUSED} SELECT query_id, id, round(score, 7) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM fused QUALIFY rank <= 8")
def rrf_fusion(spark, sf):
    index, phrases, stats = _lexical(spark, sf)
    found = R.hybrid_topk(vectors(spark, sf), query_vectors(spark, sf), index, phrases.withColumn("query_id", F.col("query_id") * 50), stats, 8)
    return found.select("query_id", "id", F.round("score", 7).alias("score"), "rank")


def _search_records(spark, sf):
    """Documents as records of a search: one record a document."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("document_name"), F.lit(1).alias("page"), F.lit("1").alias("page_label"), F.col("text").alias("normalized_text"), F.sha2("text", 256).alias("sha256")
    )


_HIT_SQL = """'{mode}' AS retrieval_mode, doc_id AS document_id, source AS document_name, 1 AS page, '1' AS page_label,
    CASE WHEN length(text) > 280 THEN substr(text, 1, 277) || '…' ELSE text END AS preview, sha256(text) AS sha256"""


@query(
    "search_hybrid",
    f"""WITH {_FUSED}, top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM fused QUALIFY rank <= 8)
    SELECT query_id, rank, id AS chunk_id, round(score, 7) AS score, round(dense_score, 7) AS dense_score, round(lexical_score, 7) AS lexical_score, CAST(dense_rank AS INT) AS dense_rank, CAST(lexical_rank AS INT) AS lexical_rank,
    {_HIT_SQL.format(mode="hybrid")} FROM top JOIN documents ON doc_id = id""",
)
def search_hybrid(spark, sf):
    index, phrases, stats = _lexical(spark, sf)
    return R.search("hybrid", _search_records(spark, sf), 8, vectors(spark, sf), query_vectors(spark, sf), index, phrases.withColumn("query_id", F.col("query_id") * 50), stats)


@query(
    "search_lexical",
    f"""WITH {_LEXICAL}, lexical AS (SELECT query_id, id, score AS s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS INT) AS rank FROM bm QUALIFY rank <= 20)
    SELECT query_id, rank, id AS chunk_id, round(1.0 / (60 + rank), 7) AS score, CAST(NULL AS DOUBLE) AS dense_score, round(s, 7) AS lexical_score, CAST(NULL AS INT) AS dense_rank, rank AS lexical_rank,
    {_HIT_SQL.format(mode="lexical")} FROM lexical JOIN documents ON doc_id = id""",
)
def search_lexical(spark, sf):
    """More results are asked for than a search gives."""
    index, phrases, stats = _lexical(spark, sf)
    return R.search("lexical", _search_records(spark, sf), 50, index=index, phrases=phrases, stats=stats)


@query(
    "search_dense_filtered",
    f"""WITH {_dense_sql(8, "AND v.vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id % 3 > 0)")}
    SELECT query_id, CAST(rank AS INT) AS rank, id AS chunk_id, round(score, 7) AS score, round(score, 7) AS dense_score, CAST(NULL AS DOUBLE) AS lexical_score, CAST(rank AS INT) AS dense_rank, CAST(NULL AS INT) AS lexical_rank,
    {_HIT_SQL.format(mode="dense")} FROM dense JOIN documents ON doc_id = id""",
)
def search_dense_filtered(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return R.search("dense", _search_records(spark, sf), 8, vectors(spark, sf), query_vectors(spark, sf), allowed=docs.where("lang IN ('en', 'de')"), dated=docs.where("id % 3 > 0"))


@query("phrase_scan", f"WITH {_hits_sql(_ITEM_PHRASES)} SELECT query_id, id, f FROM hits")
def phrase_scan(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return R.phrase_scan(docs, index_words(F.col("text")), item_phrases(spark, sf), "doc_id").select("query_id", "id", "f")


@query(
    "exact_scan_guard",
    f"""WITH {_hits_sql(_QUERY_PHRASES)} SELECT query_id * 100 + phrase_no AS query_id, count(*) AS candidates, sum(length(text)) AS characters, CASE WHEN count(*) > 100 OR sum(length(text)) > 200000 THEN 'too_broad' ELSE 'complete' END AS outcome
    FROM hits JOIN documents d ON d.doc_id = id GROUP BY 1""",
)
def exact_scan_guard(spark, sf):
    """A scan for each search phrase of each benchmark item."""
    index, phrases, _ = _lexical(spark, sf)
    hits = R.phrase_hits(index, phrases).withColumn("query_id", F.col("query_id") * 100 + F.col("phrase_no"))
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("characters"))
    return R.scan_guard(hits.join(sizes, "id"), 100, 200_000)


@query(
    "candidate_filter",
    """WITH dated AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS reporting, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS publication FROM orders)
    SELECT o_orderkey AS id FROM dated WHERE coalesce(reporting, publication) BETWEEN '1995-01-01' AND '1996-06-30' AND o_custkey % 2 = 0""",
)
def candidate_filter(spark, sf):
    orders = table(spark, sf, "orders").withColumn("document_id", F.col("o_orderkey").cast("string"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    documents = orders.where("o_custkey % 2 = 0").select(
        "document_id", F.when(F.col("o_orderkey") % 3 != 0, day(F.col("o_orderdate"))).alias("reporting_period_date"),
        F.when(F.col("o_orderkey") % 5 != 0, day(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))).alias("publication_date"), F.lit(None).cast("string").alias("file_creation_date"),
    )
    records = orders.select("document_id", F.col("o_orderkey").alias("chunk_id"))
    return R.candidates(records, documents, None, "1995-01-01", "1996-06-30")


@query(
    "chunk_lookup",
    """WITH wanted AS (SELECT 'c' || conv_id || 't' || turn AS chunk_id, min(user_id) AS ordinal FROM conversations JOIN events ON event_id % 97 = conv_id GROUP BY 1)
    SELECT chunk_id, ordinal FROM wanted""",
)
def chunk_lookup(spark, sf):
    pairs = table(spark, sf, "conversations").join(table(spark, sf, "events"), F.col("event_id") % 97 == F.col("conv_id"))
    wanted = pairs.select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), F.col("turn")).alias("chunk_id"), F.col("user_id").alias("ordinal"))
    wanted = wanted.unionByName(spark.createDataFrame([("c-1t0", 0)], "chunk_id string, ordinal long"))
    return R.lookup(turns(spark, sf), wanted).select("chunk_id", "ordinal")


@query(
    "neighbor_radius",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), s AS (SELECT conv_id, n FROM t WHERE n = 2)
    SELECT t.conv_id AS query_id, 'c' || t.conv_id || 't' || t.turn AS id FROM t JOIN s ON t.conv_id = s.conv_id AND abs(t.n - s.n) <= 2""",
)
def neighbor_radius(spark, sf):
    rows = turns(spark, sf)
    seeds = rows.where("previous_chunk_id is not null").groupBy("conv_id").agg(F.min_by("chunk_id", "turn").alias("chunk_id")).select(F.col("conv_id").alias("query_id"), "chunk_id", F.lit(0).alias("ordinal"))
    return R.neighbours(rows, seeds, 2).select("query_id", "id")


@query(
    "recall_mrr",
    f"""WITH {_dense_sql(8)}, relevant AS (SELECT q.vec_id AS query_id, min(v.vec_id) AS id FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1),
    best AS (SELECT r.query_id, min(rank) AS rank FROM relevant r LEFT JOIN dense d ON r.query_id = d.query_id AND r.id = d.id GROUP BY 1)
    SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5,
    round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0.0 END), 6) AS recall_8, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM best""",
)
def recall_mrr(spark, sf):
    hits = R.dense_topk(vectors(spark, sf), query_vectors(spark, sf), 8)
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    pairs = e.where("vec_id % 50 = 0").alias("q").join(e.alias("v"), F.expr("q.label = v.label AND q.vec_id <> v.vec_id"))
    relevant = pairs.groupBy(F.col("q.vec_id").alias("query_id")).agg(F.min("v.vec_id").alias("id"))
    return R.recall_at(hits, relevant)


@query("benchmark_in_documents", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_in_documents(spark, sf):
    from lodestone.operators.containment import contained_passages

    return contained_passages(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage")))
