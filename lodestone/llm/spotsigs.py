"""Document fingerprints by SpotSigs.

A text's signatures are the chains of content words that follow its common words: each common word (an anchor) is a
spot, and the next content words, with common words skipped, are its chain. A text without a chain has one signature,
of all its words. A fingerprint is the set of the signatures' hashes. Fingerprints are partitioned by set size: only
those of one or of neighbouring partitions are compared, by Jaccard likeness that is pruned where the sizes rule the
least likeness out. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, literal_array, materialise, rank_in

#: Common words, the anchors: fixed values, by language (English, French, German, Spanish).
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it its not of on or she that the their there they this to was were which will with you "
    "au aux avec ce dans de des du elle en est et il ils la le les ne pas plus pour qui se sur un une "
    "auf aus bei das dem den der die ein eine er es im ist mit nicht sich sie und von wie zu "
    "como con del el ella las lo los no para pero por que su una y"
).split()
#: Content words in a chain; likeness that a comparison tells from none; rows in a bucket of ids; buckets at most.
CHAIN, LEAST, BUCKET_ROWS, MOST_BUCKETS = 3, 0.1, 64, 1 << 14
#: Stands for an anchor.
MARK = "\u0001"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The set of chains' hashes (8 hexadecimal digits each), sorted. Equal texts have equal sets; no word: the empty set."""
    digest = lambda s: F.substring(F.md5(s.cast("binary")), 1, 8)
    pattern = rf"{MARK}(?=((?:{MARK}*+ [^ {MARK}]++){{1,{chain}}}+))"

    def of(words: Column) -> Column:
        marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.lit(MARK)).otherwise(F.concat(F.lit(" "), w))), "")
        chains = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
        hashed = F.transform(chains, lambda c: digest(F.replace(c, F.lit(MARK), F.lit(""))))
        whole = F.slice(F.array(digest(F.array_join(words, " "))), F.lit(1), F.least(F.size(words), F.lit(1)))
        return let(hashed, lambda h: F.when(F.size(h) > 0, h).otherwise(whole))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.sort_array(F.array_distinct(let(words, of)))


def fingerprint(signature_set: Column) -> Column:
    """The set as a string: its size, a colon, the sorted hashes."""
    return F.concat(F.size(signature_set).cast("string"), F.lit(":"), F.array_join(signature_set, ""))


def size_partition(signature_set: Column, least: float) -> Column:
    """Partition of a set: sizes within one partition, or in neighbouring ones, may reach the likeness `least`; others can't."""
    return F.floor(F.log(F.greatest(F.size(signature_set), F.lit(1)).cast("double")) / F.lit(-math.log(least)) + F.lit(1e-9)).cast("int")


def pruned_jaccard(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard likeness of two sets; 0 without a look at the elements where the sizes alone rule `least` out; two empty sets are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small < large * F.lit(float(least))), F.lit(0.0))
        .otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))
    )


def compared(a: Column, b: Column, part_a: Column, part_b: Column, least: float = LEAST) -> Column:
    """Likeness of two fingerprints by their size partitions: those more than one apart aren't compared and are unlike (0)."""
    return F.when(F.abs(part_a - part_b) > 1, F.lit(0.0)).otherwise(pruned_jaccard(a, b, least))


def likely_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents with different fingerprints whose sets have a likeness of at least `least`: doc_id, other_id, likeness.

    Ids are of the smallest document of each fingerprint. Sets of one or of neighbouring partitions meet where their
    rarest signatures do: a set's prefix of n - ceil(least * n) + 1 rarest signatures holds one of any set like it.
    Null and empty texts share the empty fingerprint and pair with none. Repeated rows change nothing.
    """
    sets = docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col)).alias("sigs"))
    sets = sets.withColumn("print", F.md5(fingerprint(F.col("sigs")).cast("binary"))).groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("sigs").alias("sigs"))
    sets = materialise(sets.where(F.size("sigs") > 0).withColumn("part", size_partition(F.col("sigs"), least)), "spotsigs")
    each = sets.select("doc_id", "part", "sigs", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = each.select("doc_id", "part", "sig").join(rarity, "sig").groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("by"))
    keep = F.size("by") - F.ceil(F.size("by") * least - 1e-9).cast("int") + 1
    prefix = ranked.select("doc_id", "part", F.explode(F.slice("by", F.lit(1), keep)).alias("s")).select("doc_id", "part", "s.sig")
    left = prefix.select(F.col("doc_id").alias("a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("doc_id").alias("b"), "sig", "part")
    pairs = left.join(right, ["sig", "part"]).where("a != b").select(F.least("a", "b").alias("doc_id"), F.greatest("a", "b").alias("other_id")).distinct()
    both = pairs.join(sets.select("doc_id", F.col("sigs").alias("x")), "doc_id").join(sets.select(F.col("doc_id").alias("other_id"), F.col("sigs").alias("y")), "other_id")
    scored = both.select("doc_id", "other_id", pruned_jaccard(F.col("x"), F.col("y"), least).alias("likeness"))
    return scored.where(F.col("likeness") >= least)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, sigs, next_text and next_sigs: the document's signatures, and what belongs to the next id (after the last: the first).

    Ids are cut into buckets at quantiles; a bucket's first row also goes to the bucket before it, so one shuffle
    brings neighbours together and no task sorts all rows. Null ids come first, repeated ids follow by their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    buckets = max(1, min(MOST_BUCKETS, ids.n // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], max(10_000, 8 * buckets))).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    at = rank_in(F.col("doc_id"), cuts, "bigint")
    opens = (at > 0) & (F.col("doc_id") == F.element_at(literal_array(cuts, "bigint"), F.greatest(at, F.lit(1)))) if cuts else F.lit(False)
    first = F.col("doc_id").isNull() if ids.nulls else F.col("doc_id").eqNullSafe(F.lit(ids.low))
    place = lambda bucket, role: F.struct(bucket.cast("int").alias("bucket"), F.lit(role).alias("role"))
    places = F.filter(F.array(place(at, 0), F.when(opens, place(at - 1, 1)), F.when(first, place(F.lit(len(cuts)), 2))), lambda p: p.isNotNull())
    dealt = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "place.bucket", "place.role")
    known = dealt.repartition("bucket").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("role", F.col("doc_id").asc_nulls_first(), "text")
    pair = F.lead(F.struct("text", "sigs")).over(order)
    return known.withColumn("next", pair).where("role = 0").select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text (its second half replaced by the next document's start), likenesses
    (0 where the sizes rule LEAST out) and the fingerprint's size partition.

    Null texts count as empty; a single document is its own next one; repeated rows each have a row; an empty table
    gives no rows; other columns aren't read.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_sigs", signatures(F.col("edited")))
    own, changed, following = (size_partition(F.col(c), LEAST) for c in ("sigs", "edited_sigs", "next_sigs"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        F.round(compared(F.col("sigs"), F.col("edited_sigs"), own, changed), 9).alias("near_edited"), F.round(compared(F.col("sigs"), F.col("next_sigs"), own, following), 9).alias("near_next"), own.alias("part"),
    )
