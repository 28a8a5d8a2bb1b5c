"""Ids, normalization, chunking, links, integrity over the driver's documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import arrow
from lodestone.functions import columns as C
from lodestone.operators import chunking, retrieval
from lodestone.plans.registry import query
from lodestone.plans.tables import chunk_records, spread, table, turns


@query("token_estimate", "SELECT doc_id, greatest(1, CAST(round(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) * 1.32) AS INT)) AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.token_estimate(F.col("text")).alias("tokens"))


@query("sha_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("chunk_id", "SELECT doc_id, 'chk_' || substr(sha256(doc_id || ':1:0'), 1, 16) AS chunk_id FROM documents")
def chunk_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.chunk_id(F.col("doc_id"), F.lit(1), F.lit(0)).alias("chunk_id"))


@query("chunk_id_round_trip", "SELECT doc_id, true AS valid, 'chk_' || substr(sha256(doc_id || ':1:0'), 1, 16) AS chunk_id FROM documents")
def chunk_id_round_trip(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id", C.chunk_id(F.col("doc_id"), F.lit(1), F.lit(0)).alias("c"))
    back = F.concat(F.lit("chk_"), F.lpad(F.lower(F.conv(C.chunk_number(F.col("c")).cast("string"), 10, 16)), 16, "0"))
    return ids.select("doc_id", C.is_chunk_id(F.col("c")).alias("valid"), back.alias("chunk_id"))


@query("document_id", """SELECT doc_id, 'doc_' || substr(sha256('{"include_pages":[1,' || (doc_id % 7) || '],"source_sha256":"' || sha256(text) || '"}'), 1, 24) AS document_id FROM documents""")
def document_id(spark, sf):
    pages = F.array(F.lit(1).cast("long"), F.col("doc_id") % 7)
    return table(spark, sf, "documents").select("doc_id", C.document_id(F.sha2("text", 256), pages).alias("document_id"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 277) || '…' ELSE text END AS preview FROM documents")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query(
    "paragraph_split",
    """WITH b AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t\\n\\x0B\\f\\r]*\\n+'), lambda p: regexp_replace(p, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda p: p <> '') AS parts FROM documents)
    SELECT doc_id, CASE WHEN len(parts) > 1 THEN len(parts) ELSE len(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda p: regexp_replace(p, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda p: p <> '')) END AS paragraphs FROM b""",
)
def paragraph_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(C.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query(
    "word_windows",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
    k AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(greatest(len(w) - 530, 0) / 470.0) AS BIGINT) + 1)) AS n FROM w)
    SELECT doc_id, CAST(n AS INT) AS n, md5(array_to_string(w[n * 470 + 1 : n * 470 + 530], ' ')) AS digest FROM k""",
)
def word_windows(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(C.word_windows(F.col("text"))).alias("n", "window"))
    return rows.select("doc_id", "n", F.md5("window").alias("digest"))


@query(
    "table_rows",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(role || '  ' || turn || '   ' || length(text) || chr(10) || 'total  ' || conv_id || chr(10) || text, chr(10))) AS line FROM conversations),
    c AS (SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(trim(line), '[ \\t\\n\\x0B\\f\\r]{2,}'), lambda x: trim(x)), lambda x: x <> '')) AS cells FROM l)
    SELECT conv_id, turn, count(*) + 1 AS table_lines FROM c WHERE cells >= 2 GROUP BY ALL HAVING count(*) >= 2""",
)
def table_rows(spark, sf):
    made = F.concat_ws("\n", F.concat_ws("  ", "role", "turn", F.concat(F.lit(" "), F.length("text").cast("string"))), F.concat(F.lit("total  "), F.col("conv_id").cast("string")), "text")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", C.table_markdown(made).alias("md")).where("md is not null")
    return rows.select("conv_id", "turn", F.size(F.split("md", "\n")).cast("long").alias("table_lines"))


@query("session_digest", "SELECT event_id, regexp_full_match('session-' || lpad(CAST(user_id AS VARCHAR), 40, '0'), '[A-Za-z0-9_-]{40,128}') AS valid, sha256('session-' || lpad(CAST(user_id AS VARCHAR), 40, '0')) AS digest FROM events")
def session_digest(spark, sf):
    token = F.concat(F.lit("session-"), F.lpad(F.col("user_id").cast("string"), 40, "0"))
    return table(spark, sf, "events").select("event_id", C.valid_session(token).alias("valid"), C.session_digest(token).alias("digest"))


@query("normalized_documents")
def normalized_documents(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", arrow.normalize_evidence("text").alias("normalized"))


@query("chunk_counts")
def chunk_counts(spark, sf):
    return chunk_records(spark, sf).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"), F.max("token_estimate").alias("largest"))


@query("chunk_links")
def chunk_links(spark, sf):
    return chunking.with_links(chunk_records(spark, sf)).select("document_id", "chunk_position", "chunk_id", "previous_chunk_id", "next_chunk_id")


@query(
    "turn_links",
    """SELECT 'c' || conv_id || 't' || turn AS chunk_id, 'c' || conv_id || 't' || lag(turn) OVER w AS previous_chunk_id, 'c' || conv_id || 't' || lead(turn) OVER w AS next_chunk_id
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def turn_links(spark, sf):
    return turns(spark, sf).select("chunk_id", "previous_chunk_id", "next_chunk_id")


@query("collision_check", "SELECT 'chk_' || substr(sha256(conv_id || ':1:0'), 1, 16) AS chunk_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def collision_check(spark, sf):
    return chunking.collisions(table(spark, sf, "conversations").select(C.chunk_id(F.col("conv_id"), F.lit(1), F.lit(0)).alias("chunk_id")))


@query("duplicate_chunks_by_sha", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_chunks_by_sha(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("id_set_reconcile", "SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'unknown', doc_id FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def id_set_reconcile(spark, sf):
    from lodestone.sources.corpus import reconcile_ids

    return reconcile_ids(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"))


@query(
    "chunk_digest",
    """SELECT sha256('[' || string_agg('{"digest":"' || sha256(text) || '","id":"d' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '"}', ',' ORDER BY doc_id) || ']') AS digest, count(*) AS n FROM documents""",
)
def chunk_digest(spark, sf):
    from lodestone.sources.corpus import ordered_digest

    ident = F.format_string("d%012d", "doc_id")
    canonical = F.format_string('{"digest":"%s","id":"%s"}', F.sha2("text", 256), ident)
    return ordered_digest(table(spark, sf, "documents").select(ident.alias("id"), canonical.alias("canonical")))


@query(
    "corpus_summary",
    "SELECT count(*) AS documents, sum(length(text)) AS characters, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, max(length(text)) AS longest FROM documents",
)
def corpus_summary(spark, sf):
    return table(spark, sf, "documents").agg(
        F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages"), F.max(F.length("text")).cast("long").alias("longest")
    )


def _pages(spark, sf):
    """Conversations as documents, their turns as pages."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.col("role").alias("page_label"), F.col("text").alias("raw_text"), C.table_markdown(F.col("text")).alias("table_markdown"))


def _page_requests(spark, sf):
    """For each conversation its pages 1 to 3; every third is asked from page 2 on without an end."""
    third = F.col("document_id") % 3 == 0
    rows = _pages(spark, sf).select("document_id").distinct()
    return rows.select(F.col("document_id").alias("query_id"), "document_id", F.when(third, 2).otherwise(1).alias("page_from"), F.when(~third, 3).alias("page_to"))


@query(
    "inspect_pages",
    """SELECT conv_id AS document_id, 'conversation ' || conv_id AS document_name, coalesce(string_agg(turn || ':' || role || ':' || sha256(text), '|' ORDER BY turn) FILTER (CASE WHEN conv_id % 3 = 0 THEN turn >= 2 ELSE turn BETWEEN 1 AND 3 END), '') AS pages
    FROM conversations GROUP BY conv_id""",
)
def inspect_pages(spark, sf):
    documents = _pages(spark, sf).select("document_id").distinct().withColumn("document_name", F.concat(F.lit("conversation "), "document_id"))
    found = retrieval.inspect(documents, _pages(spark, sf), _page_requests(spark, sf))
    shown = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p.page, p.page_label, p.sha256)), "|")
    return found.select("document_id", "document_name", shown.alias("pages"))


@query(
    "page_range",
    """SELECT conv_id AS query_id, 'c' || conv_id || 't' || turn AS chunk_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS nth FROM conversations WHERE turn BETWEEN 1 AND 3""",
)
def page_range(spark, sf):
    rows = turns(spark, sf).select("chunk_id", F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.lit(0).alias("chunk_position"))
    wanted = rows.select("document_id").distinct().select(F.col("document_id").alias("query_id"), "document_id", F.lit(1).alias("page_from"), F.lit(3).alias("page_to"))
    return retrieval.page_range(rows, wanted)


@query("ordered_chunks", "SELECT 'c' || conv_id || 't' || turn AS chunk_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS nth FROM conversations")
def ordered_chunks(spark, sf):
    rows = turns(spark, sf).select("chunk_id", F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.lit(0).alias("chunk_position"))
    return retrieval.ordered_chunks(rows).select("chunk_id", "nth")


@query("source_files", "SELECT doc_id AS document_id, 'corpus/documents/' || source || '.txt' AS path FROM documents")
def source_files(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".txt")).alias("source_file"))
    return retrieval.source_file(documents, documents, "corpus/")


@query("document_suffixes", "SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after_chars FROM conversations")
def document_suffixes(spark, sf):
    rest = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(rest), F.lit(0)).alias("after_chars"))
