"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's sketch is its bottom-m set of shingle hashes (a MinHash sketch without replacement). A document that holds a
share t of the item's q shingles misses at most floor((1 - t) q) of them, so with m one of these and `spare` more, at
least spare + 1 sketch entries are in the document: the search loses nothing. Items and documents are partitioned by
the power of two of their set size; a partition of documents is searched for the items that can fit into it. Survivors
are verified on the shingles themselves. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import let, materialise

#: Words in a shingle; least share of an item's shingles; sketch entries in one block of items, at most.
WORDS, CONTAINMENT, BLOCK_ENTRIES = 5, 0.8, 200_000


def words_of(text: Column) -> Column:
    """Words: runs of letters and digits, lower case (null: none)."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def shingles(words: Column, k: int, make) -> Column:
    """make(k words) at each place; all words where there are fewer than k; none without words."""
    def of(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: make(F.slice(w, i, k)))
        return F.when(n >= k, each).otherwise(F.slice(F.array(make(w)), F.lit(1), F.least(n, F.lit(1))))

    return let(words, of)


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def size_class(size: Column) -> Column:
    """The power of two below a set's size."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def item_sets(items: DataFrame, id_col: str, text_col: str, k: int, containment: float) -> DataFrame:
    """item_id, distinct shingles, their number q, allowed misses, and the sketch. Items without words go: nothing holds them."""
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    rows = rows.select("item_id", F.array_distinct(shingles(F.col("words"), k, _text)).alias("shingles"), F.least(F.size("words"), F.lit(k)).alias("k"))
    rows = rows.withColumn("q", F.size("shingles")).withColumn("misses", F.col("q") - F.ceil(F.col("q") * containment - 1e-9).cast("int"))
    spare = F.least(F.floor(F.col("q") / 16).cast("int"), F.col("q") - F.col("misses") - 1)
    rows = rows.withColumn("need", spare + 1)
    hashes = F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s)))
    return rows.withColumn("sketch", F.slice(hashes, F.lit(1), F.col("misses") + F.col("need")))


def _blocks(sets: DataFrame) -> list[list]:
    """Ids of items, in blocks whose sketches a task can hold: the benchmark may be of any size, a block is bounded."""
    sizes = sets.select("item_no", F.size("sketch").alias("n")).collect()
    blocks, filled = [[]], 0
    for r in sorted(sizes):
        if filled + r.n > BLOCK_ENTRIES and blocks[-1]:
            blocks.append([])
            filled = 0
        blocks[-1].append(r.item_no)
        filled += r.n
    return blocks


def _search(docs: DataFrame, sets: DataFrame, containment: float) -> DataFrame:
    """Pairs (doc_id, item_id) of one block of items. One pass over the documents looks for the entries of every shingle length."""
    entries: dict[int, list[int]] = {}
    for r in sets.select("k", F.explode("sketch").alias("e")).distinct().collect():
        entries.setdefault(r.k, []).append(r.e)
    lengths = sorted(entries)
    hashed = lambda words, k: shingles(words, k, lambda w: F.xxhash64(_text(w)))
    among = lambda k: f"array_distinct(filter(hashes{k}, h -> h in ({','.join(f'{e}L' for e in entries[k])})))"
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text", *[hashed(F.col("words"), k).alias(f"hashes{k}") for k in lengths])
    rows = rows.select("doc_id", "text", *[F.expr(among(k)).alias(f"hits{k}") for k in lengths])
    some = F.lit(False)
    for k in lengths:
        some = some | (F.size(f"hits{k}") > 0)
    hot = materialise(rows.where(some).withColumn("row", F.monotonically_increasing_id()), "leak-candidates")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits{k}").alias("hits")) for k in lengths])
    asked = hot.select("row", "text", F.explode(F.filter(each, lambda e: F.size(e.hits) > 0)).alias("e"))
    size = F.lit(0)
    for k in lengths:
        size = F.when(F.col("e.k") == k, F.size(F.array_distinct(hashed(words_of(F.col("text")), k)))).otherwise(size)
    asked = asked.select("row", F.col("e.k").alias("k"), size_class(size).alias("partition"), F.explode("e.hits").alias("hit"))
    least = size_class(F.ceil(F.col("q") * containment - 1e-9))
    index = sets.select("item_no", "need", "k", least.alias("least"), F.explode("sketch").alias("hit"))
    found = asked.join(index, ["k", "hit"]).where("least <= partition")
    pairs = found.groupBy("row", "item_no").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    checked = pairs.join(hot.select("row", "doc_id", "text"), "row").join(sets.select("item_no", "item_id", "k", "shingles", "q"), "item_no")
    present = F.lit(0)
    for k in lengths:
        present = F.when(F.col("k") == k, F.size(F.array_intersect(F.col("shingles"), shingles(words_of(F.col("text")), k, _text)))).otherwise(present)
    checked = checked.select("doc_id", "item_id", present.alias("shared"), "q").where(F.col("shared") >= F.ceil(F.col("q") * containment - 1e-9))
    return checked.groupBy("doc_id", "item_id").agg(F.max("shared").cast("long").alias("shared"), F.max("q").cast("long").alias("item_shingles"))


def leaks(docs: DataFrame, items: DataFrame, k: int = WORDS, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every (doc_id, item_id) whose document holds at least the given share of the item's distinct shingles.

    Items shorter than k words are one shingle of all their words. Null texts hold nothing and are held by nothing;
    repeated rows of a document count as one; an empty table on either side gives no rows; other columns aren't read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(item_sets(items, item_id, item_text, k, containment).withColumn("item_no", F.monotonically_increasing_id()), "benchmark-items")
    blocks = _blocks(sets)
    out = None
    for block in blocks if blocks[0] else []:
        found = _search(docs, sets if len(blocks) == 1 else sets.where(F.col("item_no").isin(block)), containment)
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema[item_id].dataType), T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])
        out = docs.sparkSession.createDataFrame([], none)
    return out.withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold an item; columns, repeated rows and rows with a null id stay."""
    found = leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(found, docs[id_col] == found["__leaked"], "left_anti")
