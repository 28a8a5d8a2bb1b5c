"""Exact passages inside texts, without comparing every passage with every text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits in a passage's probe.
LEAST_PROBE = 3


def contained_passages(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id and item_id of every passage that stands in a text. texts: doc_id, text; passages: item_id, passage.

    A passage's longest inner word (one with a word on either side, so its ends are fixed) must be a word of the text:
    an equi-join on that word finds the candidates, and containment is then checked on the text itself. Passages
    without such a word meet every text, which only short ones do.
    """
    inner = F.expr("slice(words, 2, greatest(size(words) - 2, 0))")
    words = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0))
    keyed = passages.withColumn("words", words(F.col("passage"))).withColumn("inner", inner)
    longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    keyed = keyed.withColumn("probe", F.when(longest.n >= LEAST_PROBE, longest.w)).select("item_id", "passage", "probe")
    probed, rest = keyed.where("probe is not null"), keyed.where("probe is null")
    have = texts.withColumn("probe", F.explode(F.array_distinct(words(F.col("text")))))
    found = have.join(probed, "probe").where(F.contains("text", "passage")).select("doc_id", "item_id")
    short = texts.join(rest.select("item_id", "passage"), F.contains(texts.text, F.col("passage"))).select("doc_id", "item_id")
    return found.unionByName(short).distinct()


def cited_quotes(quotes: DataFrame, records: DataFrame, cited: DataFrame, contains) -> DataFrame:
    """Each quote challenge (run_id, chunk_id, quote) as verified or rejected: the chunk must be cited by the run and hold the quote."""
    known = quotes.join(cited.select("run_id", "chunk_id", F.lit(True).alias("cited")).distinct(), ["run_id", "chunk_id"], "left")
    held = known.join(records.select("chunk_id", "normalized_text"), "chunk_id", "left")
    ok = F.coalesce("cited", F.lit(False)) & F.coalesce(contains(F.col("quote"), F.col("normalized_text")), F.lit(False))
    return held.select("run_id", "chunk_id", "quote", F.when(ok, "verified").otherwise("rejected").alias("outcome"))
