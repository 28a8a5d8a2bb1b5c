"""Batch retrieval: dense, lexical (BM25) and fused top-k, exact phrase scans, neighbours.

Every operator takes a table of queries and answers all of them in one plan. Ties are broken by id throughout.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import dot, index_words, preview, search_parts

#: Constants of BM25 and of rank fusion.
K1, B, LEAST_IDF, FUSION = 1.2, 0.75, 1e-6, 60
#: Results, at most; of an exact scan, chunks and characters.
MOST_RESULTS, MOST_CANDIDATES, MOST_CHARACTERS = 20, 1000, 5_000_000
#: Words, on average at most, of the phrases that one pass of a phrase scan looks for.
BLOCK_WORDS = 1_000_000


def clamp_k(k: Column) -> Column:
    return F.least(F.greatest(k, F.lit(1)), F.lit(MOST_RESULTS))


def postings(records: DataFrame, words: Column, id_col: str = "chunk_id", phrases: DataFrame | None = None) -> DataFrame:
    """token, id, positions (from 0) and dl (words of the record). With phrases (words): of their tokens only."""
    sized = records.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("dl", F.size("words"))  # before the explosion, whose rows then don't carry the words
    each = sized.select("id", "dl", F.posexplode("words").alias("position", "token"))
    if phrases is not None:
        each = each.join(phrases.select(F.explode("words").alias("token")).distinct(), "token", "left_semi")
    return each.groupBy("token", "id").agg(F.sort_array(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl"))


def corpus_stats(records: DataFrame, words: Column) -> DataFrame:
    """One row: n_docs and avgdl of the whole corpus."""
    return records.agg(F.count("*").alias("n_docs"), F.avg(F.size(words)).alias("avgdl"))


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, phrase_no and words: the search phrases of queries (query_id, text). A part of a query that holds no index word is none."""
    parts = queries.select("query_id", F.posexplode(search_parts(F.col("text"))).alias("phrase_no", "part"))
    return parts.select("query_id", "phrase_no", index_words(F.col("part")).alias("words")).where(F.size("words") > 0)


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, phrase_no, id, f (occurrences) and dl. phrases: query_id, phrase_no, words.

    Equal phrases are looked up once. A phrase of one word is its postings; one of several words is an equi-join of its
    words' postings on the record, each word's positions moved back by its place: occurrences are the starts that all share.
    """
    wanted = phrases.where(F.size("words") > 0)
    each = wanted.select("words").distinct()
    one = each.where(F.size("words") == 1).withColumn("token", F.element_at("words", 1)).join(index, "token").select("words", "id", F.size("positions").cast("long").alias("f"), "dl")
    parts = each.where(F.size("words") > 1).select("words", F.posexplode("words").alias("place", "token"))
    starts = parts.join(index, "token").select("words", "id", "dl", F.transform("positions", lambda p: p - F.col("place")).alias("starts"))
    whole = starts.groupBy("words", "id").agg(F.collect_list("starts").alias("all"), F.first("dl").alias("dl")).where(F.size("all") == F.size("words"))
    shared = F.aggregate(F.slice("all", F.lit(2), F.size("all") - 1), F.element_at("all", 1), lambda a, b: F.array_intersect(a, b))
    several = whole.select("words", "id", F.size(shared).cast("long").alias("f"), "dl").where("f > 0")
    return wanted.join(one.unionByName(several), "words").select("query_id", "phrase_no", "id", "f", "dl")


def phrase_scan(records: DataFrame, words: Column, phrases: DataFrame, id_col: str = "chunk_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """query_id, phrase_no, id, f (occurrences) and dl of phrases (query_id, phrase_no, words), by a scan of the records without postings.

    Long phrases hold common words, whose postings are nearly the whole corpus. Here only a phrase's longest word (the first
    such) is looked up, among the words of a record as they are read, and the other words are compared where it stands: no
    word is shuffled, only starts that hold the whole phrase. Phrases are sent to all tasks, so they are dealt by hash
    into blocks of about equal size, each in one pass over the records. Rows of one id and dl are one record, in which a start counts once.
    """
    wanted = phrases.where(F.size("words") > 0)
    each = wanted.select(F.col("words").alias("phrase")).distinct()
    longest = F.array_max(F.transform("phrase", lambda w, n: F.struct(F.length(w).alias("length"), (-n).alias("back"), w.alias("token"))))
    keyed = each.withColumn("longest", longest).select("phrase", F.size("phrase").alias("n"), (-F.col("longest.back")).alias("place"), "longest.token")
    sized = records.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("dl", F.size("words"))
    have = sized.select("id", "dl", "words", F.posexplode("words").alias("position", "token"))
    place = F.col("position") - F.col("place")
    holds = F.when(place >= 0, F.slice("words", place + 1, F.col("n")) == F.col("phrase"))
    blocks = max(1, math.ceil((each.agg(F.sum(F.size("phrase"))).first()[0] or 0) / block_words))
    starts = []
    for b in range(blocks):
        block = keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        starts.append(have.join(F.broadcast(block), (have.token == block.token) & holds).select(F.col("phrase").alias("words"), "id", "dl", "position"))
    found = reduce(DataFrame.unionByName, starts).groupBy("words", "id", "dl").agg(F.count_distinct("position").alias("f"))
    return wanted.join(found, "words").select("query_id", "phrase_no", "id", "f", "dl")


def bm25(index: DataFrame, phrases: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, id and score (negative, lower is better) of every record with a phrase."""
    hits = phrase_hits(index, phrases)
    frequency = hits.groupBy("query_id", "phrase_no").agg(F.count("*").alias("n"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(frequency, ["query_id", "phrase_no"]).crossJoin(F.broadcast(stats))  # stats is one row
    return scored.groupBy("query_id", "id").agg((-F.sum(weight)).alias("score"))


def ranked(scores: DataFrame, k: Column | int, descending: bool) -> DataFrame:
    """The k best rows of each query, with rank from 1. Scores are rounded to 9 places first, so rank follows from values alone."""
    value = F.round("score", 9)
    order = Window.partitionBy("query_id").orderBy(value.desc() if descending else value.asc(), F.col("id").asc())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_topk(index: DataFrame, phrases: DataFrame, stats: DataFrame, k: int, allowed: DataFrame | None = None, dated: DataFrame | None = None) -> DataFrame:
    """BM25 top-k. A document filter (allowed: id) narrows the match; a date filter (dated: id) is applied after max(4k, 32) rows were taken."""
    scores = bm25(index, phrases, stats)
    if allowed is not None:
        scores = scores.join(allowed, "id", "left_semi")
    found = ranked(scores, max(4 * k, 32), descending=False)
    if dated is not None:
        found = found.join(dated, "id", "left_semi")
    return ranked(found.drop("rank"), k, descending=False)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, score and rank by inner product. vectors: id, vector; queries: query_id, query_vector (a batch of bounded size)."""
    pool = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
    pairs = pool.join(queries, F.lit(True)).select("query_id", "id", dot(F.col("vector"), F.col("query_vector")).alias("score"))
    return ranked(pairs, k, descending=True)


def fuse(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked tables; a side without the record adds nothing."""
    sides = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(lexical.select("query_id", "id", F.col("rank").alias("lexical_rank")), ["query_id", "id"], "full_outer")
    part = lambda rank: F.coalesce(1 / (F.lit(FUSION) + F.col(rank)), F.lit(0.0))
    return ranked(sides.withColumn("score", part("dense_rank") + part("lexical_rank")), k, descending=True)


def hybrid_topk(vectors: DataFrame, queries: DataFrame, index: DataFrame, phrases: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    depth = max(3 * k, 24)
    return fuse(dense_topk(vectors, queries, depth), lexical_topk(index, phrases, stats, depth), k)


def search(
    mode: str, records: DataFrame, top_k: int = 8, vectors: DataFrame | None = None, queries: DataFrame | None = None, index: DataFrame | None = None, phrases: DataFrame | None = None,
    stats: DataFrame | None = None, allowed: DataFrame | None = None, dated: DataFrame | None = None,
) -> DataFrame:
    """Search of a batch in mode dense, lexical or hybrid: query_id, rank and what is known of each hit.

    records: chunk_id, document_id, document_name, page, page_label, normalized_text, sha256. top_k is clamped to 1 to
    MOST_RESULTS. allowed (id) are records by document, dated (id) by date; null means all. Both narrow the dense side
    before its top-k; on the lexical side dates count only after max(4k, 32) rows were taken. score is the inner product,
    1 / (FUSION + rank), or the sum of both sides' reciprocal ranks; what a side doesn't know is null. Hits without a
    record are left out, ties go by id.
    """
    if mode not in ("dense", "lexical", "hybrid"):
        raise ValueError(f"no search mode {mode}")
    k = max(1, min(top_k, MOST_RESULTS))
    depth = max(3 * k, 24) if mode == "hybrid" else k
    dense = lexical = None
    if mode != "lexical":
        pool = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
        dense = dense_topk(pool, queries, depth, dated).select("query_id", "id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    if mode != "dense":
        lexical = lexical_topk(index, phrases, stats, depth, allowed, dated).select("query_id", "id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    if mode == "hybrid":
        sides = dense.join(lexical, ["query_id", "id"], "full_outer")
    elif mode == "dense":
        sides = dense.withColumns({"lexical_score": F.lit(None).cast("double"), "lexical_rank": F.lit(None).cast("int")})
    else:
        sides = lexical.withColumns({"dense_score": F.lit(None).cast("double"), "dense_rank": F.lit(None).cast("int")})
    part = lambda rank: F.coalesce(1 / (F.lit(FUSION) + F.col(rank)), F.lit(0.0))
    score = F.col("dense_score") if mode == "dense" else part("dense_rank") + part("lexical_rank")
    hits = ranked(sides.withColumn("score", score), k, descending=True).join(records.withColumnRenamed("chunk_id", "id"), "id")
    return hits.select(
        "query_id", "rank", F.col("id").alias("chunk_id"), *[F.round(F.round(c, 9), 7).alias(c) for c in ("score", "dense_score", "lexical_score")], "dense_rank", "lexical_rank", F.lit(mode).alias("retrieval_mode"),
        "document_id", "document_name", "page", "page_label", preview(F.col("normalized_text")).alias("preview"), "sha256",
    )


def ordered_chunks(records: DataFrame) -> DataFrame:
    """All records with nth, their place (from 0) in the order of document, page and position.

    Places come from the counts of the documents before, so only a document's own records are ordered together.
    """
    counts = records.groupBy("document_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("document_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("document_id", F.coalesce(before, F.lit(0)).alias("start"))
    inside = Window.partitionBy("document_id").orderBy("page", "chunk_position")
    return records.join(starts, "document_id").withColumn("nth", F.col("start") + F.row_number().over(inside) - 1).drop("start")


def page_range(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, chunk_id and nth (from 1, by page and position) of the records on wanted pages (query_id, document_id, page_from, page_to; both ends count)."""
    found = records.join(wanted, "document_id").where(F.col("page").between(F.col("page_from"), F.col("page_to")))
    return found.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("page", "chunk_position")).alias("nth"))


def inspect(documents: DataFrame, pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, document_id, document_name and pages (by number) of wanted (query_id, document_id, page_from, page_to; a null end is open).

    A document without a page in the range has no pages; an unknown document is an error.
    """
    known = wanted.join(documents.select("document_id", "document_name", F.lit(True).alias("known")), "document_id", "left")
    name = F.when(F.col("known"), F.col("document_name")).otherwise(F.raise_error(F.concat(F.lit("unknown document: "), F.col("document_id").cast("string"))))
    known = known.select("query_id", "document_id", "page_from", "page_to", name.alias("document_name"))
    page = F.struct("page", "page_label", F.col("raw_text").alias("text"), "table_markdown", F.sha2("raw_text", 256).alias("sha256"))
    inside = (F.col("page") >= F.coalesce("page_from", "page")) & (F.col("page") <= F.coalesce("page_to", "page"))
    found = known.join(pages.select("document_id", "page", page.alias("shown")), "document_id", "left")
    return found.groupBy("query_id", "document_id", "document_name").agg(F.sort_array(F.collect_list(F.when(inside, F.col("shown")))).alias("pages"))


def source_file(documents: DataFrame, document_ids: DataFrame, root: str) -> DataFrame:
    """document_id and path of each wanted document's stored source; an unknown document is an error."""
    found = document_ids.select("document_id").join(documents.select("document_id", "source_file"), "document_id", "left")
    path = F.concat(F.lit(root.rstrip("/") + "/documents/"), F.col("source_file"))
    return found.select("document_id", F.when(F.col("source_file").isNotNull(), path).otherwise(F.raise_error(F.concat(F.lit("unknown document: "), F.col("document_id").cast("string")))).alias("path"))


def candidates(records: DataFrame, documents: DataFrame, document_ids: list[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Chunk ids by document and by the document's first known date. Dates compare as strings; no date fails any bound."""
    kept = documents
    if document_ids is not None:
        kept = kept.where(F.col("document_id").isin(document_ids))
    if date_from is not None or date_to is not None:
        day = F.coalesce("reporting_period_date", "publication_date", "file_creation_date")
        kept = kept.where((F.lit(True) if date_from is None else day >= date_from) & (F.lit(True) if date_to is None else day <= date_to) & day.isNotNull())
    return records.join(kept.select("document_id"), "document_id").select(F.col("chunk_id").alias("id"))


def lookup(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records in the order of wanted (ordinal, chunk_id): first mention counts, unknown ids are dropped."""
    first = wanted.groupBy("chunk_id").agg(F.min("ordinal").alias("ordinal"))
    return records.join(first, "chunk_id")


def neighbours(records: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """query_id, id and nth: seeds first, then the ids that links reach, in rounds; each id once, where it was first seen."""
    links = records.select("chunk_id", "previous_chunk_id", "next_chunk_id")
    seen = seeds.select("query_id", F.col("chunk_id").alias("id"), F.array(F.col("ordinal").cast("int")).alias("path"))
    for _ in range(radius):
        reached = seen.join(links, seen.id == links.chunk_id).select("query_id", F.posexplode(F.array("previous_chunk_id", "next_chunk_id")).alias("side", "id"), "path")
        seen = seen.unionByName(reached.where("id is not null").select("query_id", "id", F.concat("path", F.array(F.col("side").cast("int"))).alias("path")))
        first = Window.partitionBy("query_id", "id").orderBy(F.size("path"), "path")
        seen = seen.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return seen.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.size("path"), "path")).alias("nth"))


def scan_guard(found: DataFrame, most_rows: int = MOST_CANDIDATES, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """query_id, candidates, characters and outcome of an exact scan, counted before any text is read. found: query_id, characters."""
    sums = found.groupBy("query_id").agg(F.count("*").alias("candidates"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"))
    return sums.withColumn("outcome", F.when((F.col("candidates") > most_rows) | (F.col("characters") > most_characters), "too_broad").otherwise("complete"))


def recall_at(hits: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """One row: recall at each depth and mean reciprocal rank. hits: query_id, id, rank; relevant: query_id, id."""
    best = relevant.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    columns = [F.round(F.avg(F.when(F.col("rank") <= d, 1.0).otherwise(0.0)), 6).alias(f"recall_{d}") for d in depths]
    return best.agg(*columns, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def golden_results(cases: DataFrame, hits: DataFrame, records: DataFrame, contains, least: float = 0.95) -> DataFrame:
    """One row: mean recall, passed cases and whether the gate holds. cases: case_id, passages, absent, absence_pages; hits: query_id, id.

    A passage is found if a hit's text holds it; `absent` must not stand on the pages named (all pages where none are).
    """
    texts = hits.join(records.select(F.col("chunk_id").alias("id"), "page", "normalized_text"), "id").select(F.col("query_id").alias("case_id"), "normalized_text")
    wanted = cases.select("case_id", F.posexplode("passages").alias("n", "passage"))
    found = wanted.join(texts, "case_id", "left").groupBy("case_id", "n").agg(F.bool_or(F.coalesce(contains(F.col("passage"), F.col("normalized_text")), F.lit(False))).alias("found"))
    recall = found.groupBy("case_id").agg(F.avg(F.col("found").cast("int")).alias("recall"))
    pages = cases.where("absent IS NOT NULL").join(records.select("page", "normalized_text"), F.coalesce(F.size("absence_pages"), F.lit(0)).isin(0, -1) | F.array_contains("absence_pages", F.col("page")))
    broken = pages.groupBy("case_id").agg(F.bool_or(contains(F.col("absent"), F.col("normalized_text"))).alias("present"))
    each = cases.select("case_id").join(recall, "case_id", "left").join(broken, "case_id", "left").select("case_id", F.coalesce("recall", F.lit(1.0)).alias("recall"), (~F.coalesce("present", F.lit(False))).alias("kept_out"))
    return each.agg(F.avg("recall").alias("recall"), F.count_if((F.col("recall") == 1) & F.col("kept_out")).alias("passed"), ((F.avg("recall") >= least) & F.bool_and((F.col("recall") == 1) & F.col("kept_out"))).alias("holds"))
