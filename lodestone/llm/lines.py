"""Line dedup by a deletion-neighbourhood join.

Two lines are near when one unit inserted, deleted or replaced makes them equal and each has at least FEWEST units (one
edit in fewer is a likeness below 0.8). Units are words, which single spaces separate; in a line of fewer than FEWEST
words they are its characters. A line's neighbourhood is the line without each of its units, and the line with a gap at
each place; lines within the bound share a variant at the same place: replaced units two deletions, an inserted unit a
deletion and a gap. A variant is hashed as (hash of the units before the place, hash of the units after it), so each
group needs its earliest deletion and its earliest gap only and no pairs are formed. A line goes when an earlier line
is equal or near. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let, materialise

#: A second hash beside the first one: equal lines are told by both. Units in a line that may be near another, at least.
SEED, FEWEST = 7, 5
#: Stands before a character that is a unit, so that no word equals it.
LETTER = "\u0001"


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """place (doc_id, hash of the text, line number) and line of each non-blank line. Repeated rows are one document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "").select(F.struct("doc_id", "text_hash", "line_no").alias("place"), "line")


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def spaced(line: Column) -> Column:
    """The line's units with a space between them: the line itself, or its characters where it has few words."""
    letters = F.regexp_extract_all(F.replace(line, F.lit(" "), F.lit("\u0002")), F.lit("(?s)."), F.lit(0))
    return F.when(n_words(line) >= FEWEST, line).otherwise(F.array_join(F.transform(letters, lambda c: F.concat(F.lit(LETTER), c)), " "))


def halves(line: Column) -> Column:
    """Hashes of which near lines share one: the first and the last units, floor(n / 2) and floor((n - 1) / 2) of them.

    line: units with a space between them. A change of one unit leaves the shorter line's first or last floor(n / 2)
    units as they were, and the longer line takes as many from that end.
    """
    def of(line: Column, n: Column) -> Column:
        head = lambda k: F.xxhash64(F.lit(0), k, F.call_function("substring_index", line, F.lit(" "), k))
        tail = lambda k: F.xxhash64(F.lit(1), k, F.call_function("substring_index", line, F.lit(" "), -k))
        low, high = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
        both = F.when(low == high, F.array(head(low), tail(low))).otherwise(F.array(head(low), tail(low), head(high), tail(high)))
        return F.when(n >= FEWEST, both).otherwise(F.array().cast("array<bigint>"))

    return let(line, lambda x: let(n_words(x), lambda n: of(x, n)))


def _running(hashes: Column) -> Column:
    """0, then the hash of the first, of the first two, ... of all elements."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("bigint")), lambda seen, h: F.array_append(seen, F.xxhash64(F.element_at(seen, -1), h)))


def variants(words: Column) -> Column:
    """(variant, gap) at each place: the line without a word (gap false), and with room for one more (gap true)."""
    def of(w: Column) -> Column:
        running = F.struct(_running(w).alias("before"), _running(F.reverse(w)).alias("after"))
        return let(running, lambda r: F.concat(_at(r, F.size(w), 1), _at(r, F.size(w), 0)))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def _at(running: Column, n: Column, removed: int) -> Column:
    """Variants with so many words (1, or 0 for a gap) removed at each place."""
    before, after = running["before"], running["after"]
    return F.transform(F.sequence(F.lit(removed), n), lambda i: F.struct(
        F.xxhash64(F.element_at(before, i - removed + 1), i - removed, F.element_at(after, n - i + 1), n - i).alias("variant"), F.lit(removed == 0).alias("gap")
    ))


def within_one_word(a: Column, b: Column) -> Column:
    """Whether the word edit distance is at most one: common start and common end cover all words of the longer but one."""
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False) - 1
    start, end = same(a, b), same(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & ((start < 0) | (start + end >= F.greatest(F.size(a), F.size(b)) - 1))


def line_fates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, line_no and fate ('copy' or 'near') of every line that goes."""
    all_lines = lines_of(docs, id_col, text_col)
    coded = materialise(all_lines.select("place", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(SEED), "line").alias("h2"), halves(spaced(F.col("line"))).alias("halves")), "lines")
    distinct = materialise(coded.groupBy("h", "h2").agg(F.min("place").alias("first"), F.first("halves").alias("halves")), "distinct-lines")
    half = distinct.select(F.explode("halves").alias("half"), "first")
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    suspects = half.join(shared, "half", "left_semi").select(F.col("first").alias("place")).distinct()
    near_to = materialise(all_lines.join(suspects, "place", "left_semi").select("place", F.split(spaced(F.col("line")), " ").alias("words")), "suspect-lines")
    ranged = near_to.repartitionByRange("place").dropDuplicates(["place"]).sortWithinPartitions("place")  # repeated rows give a place more than once
    near_to = materialise(ranged.withColumn("nth", F.monotonically_increasing_id()), "suspect-order")  # nth: a number in the order of places
    keyed = near_to.select("nth", F.explode(variants(F.col("words"))).alias("v")).select("nth", "v.variant", "v.gap")
    groups = keyed.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.when(~F.col("gap"), F.col("nth"))).alias("least"), F.min(F.when(F.col("gap"), F.col("nth"))).alias("gap_least"))
    groups = groups.where("n > 1 AND least IS NOT NULL").drop("n")
    reached = F.when(F.col("gap"), F.col("least")).otherwise(F.least("least", "gap_least"))
    found = keyed.join(groups, "variant").select("nth", reached.alias("earliest")).where("earliest < nth")
    best = found.groupBy("nth").agg(F.min("earliest").alias("earliest"))
    other = near_to.select(F.col("nth").alias("earliest"), F.col("words").alias("other"))
    near = best.join(near_to, "nth").join(other, "earliest").where(within_one_word(F.col("words"), F.col("other")))
    copies = coded.join(distinct.select("h", "h2", "first"), ["h", "h2"]).where("place > first").select("place", F.lit("copy").alias("fate"))
    return copies.unionByName(near.select("place", F.lit("near").alias("fate"))).select("place.*", "fate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its text less the lines that an earlier document, or an earlier line of it, has already.

    Earlier means a smaller doc_id (null first), then a smaller line number; a near copy is one unit inserted, deleted
    or replaced, and every line (also one that goes) makes later copies go. Blank lines stay. Returns doc_id, text,
    n_lines, n_copies and n_near; null texts stay null; fully repeated rows count as one document and all of them get
    its result; other columns aren't read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = line_fates(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.collect_set("line_no").alias("gone"), F.collect_set(F.when(F.col("fate") == "copy", F.col("line_no"))).alias("copies")
    )  # sets: fully repeated rows give each line more than once
    rows = docs.join(gone, docs.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(docs.text) == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("copies"), F.lit(0)).cast("long").alias("n_copies"), F.coalesce(F.size("gone") - F.size("copies"), F.lit(0)).cast("long").alias("n_near"),
    )
