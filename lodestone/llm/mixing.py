"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of near equal word counts are numbered 0, 1, 2, ...; golden-ratio points send each slot through the cumulative
target shares to a source, and the slots of a source are ranked. A source's documents, put in a hashed order and laid
end to end (again from the start at its end), are cut into as many equal blocks as the source has slots, so that they
make up its target exactly; the slot of rank r takes block r. A source that no point meets gets one slot at the end.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, literal_array, materialise, rank_in

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Words in a slot, near enough: the total by SLOTS, within 1 and MOST_WORDS. Rows in a bucket of a source's order, and
#: buckets of a source at most; slots in a run.
SLOTS, MOST_WORDS, BUCKET_ROWS, MOST_BUCKETS, RUN_SLOTS, SEED = 100_000, 4096, 128, 1 << 20, 4096, 20


@dataclass
class Plan:
    """sources: (name, words, target) in code-point order, null last; words: in a slot, near enough."""

    sources: list[tuple[str | None, int, float]]
    words: int

    @property
    def slots(self) -> int:
        return -(-int(sum(t for _, _, t in self.sources)) // self.words)


def reshared_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight that stop at cap times the size; what is over goes to the others by weight, until none is above."""
    targets, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = [i for i in range(len(sizes))]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def make_plan(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> Plan:
    """Targets of all sources. The list of sources, with one sum each, comes to the driver; a corpus has few of them."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(((r.source, int(r.n or 0)) for r in sums), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [n for _, n in rows]
    targets = reshared_targets(sizes, list(itertools.islice(itertools.cycle(weights), len(rows))), share, cap)
    return Plan([(s, n, t) for (s, n), t in zip(rows, targets)], max(1, min(MOST_WORDS, sum(sizes) // SLOTS)))


def schedule(spark, plan: Plan) -> DataFrame:
    """slot, source_no, rank and slots (of its source): slot k goes to the source whose cumulative share holds the k-th golden-ratio point."""
    total, seen, cuts = sum(t for _, _, t in plan.sources), 0.0, []
    for _, _, t in plan.sources[:-1]:
        seen += t / total if total else 0.0
        cuts.append(seen)
    slots = spark.range(plan.slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("point"))
    slots = slots.select("slot", rank_in(F.col("point"), cuts, "double").alias("source_no"))
    met = slots.select("source_no").distinct()
    wanted = spark.createDataFrame([(i, plan.slots + i) for i, (_, _, t) in enumerate(plan.sources) if t > 0], "source_no int, slot long")
    slots = slots.unionByName(wanted.join(met, "source_no", "left_anti").select("slot", "source_no")).withColumn("run", F.floor(F.col("slot") / RUN_SLOTS))
    runs = slots.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    source = Window.partitionBy("source_no")
    before = F.coalesce(F.sum("n").over(source.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("source_no", "run", before.alias("before"), F.sum("n").over(source).alias("slots"))
    nth = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    return slots.join(runs, ["source_no", "run"]).select("slot", "source_no", (F.col("before") + nth).alias("rank"), "slots")


def _cut(target, slots, rank) -> Column:
    """First word of a source's block: its target's words are dealt evenly over its slots."""
    return F.floor(F.round(target) * rank / slots)


def lay_out(sized: DataFrame, plan: Plan) -> DataFrame:
    """sized with source_no and the document's first word in its source's hashed order. No source is sorted in one task."""
    names = [(i, s, n, float(t)) for i, (s, n, t) in enumerate(plan.sources)]
    spark = sized.sparkSession
    known = spark.createDataFrame(names, "source_no int, name string, source_size long, target double")
    buckets = max(1, min(MOST_BUCKETS, sized.count() // BUCKET_ROWS))
    rows = sized.join(known, sized.source.eqNullSafe(known.name)).drop("name").withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(prior(Window.partitionBy("source_no").orderBy("bucket"))), F.lit(0))
    inside = F.coalesce(F.sum("size").over(prior(Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "size"))), F.lit(0))
    return rows.join(sums.select("source_no", "bucket", offset.alias("offset")), ["source_no", "bucket"]).withColumn("start", F.col("offset") + inside)


def words_in(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    A null text has no words, a null source is the last source, a repeated row is a document of its own, an empty
    table gives no rows; other columns aren't read. Reruns agree: order and schedule follow from ids, texts and sizes.
    The words that a source gives are its target, rounded.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)), F.lit(SEED)).alias("order")
    )
    sized = materialise(sized, "mix-sizes")
    plan = make_plan(sized, weights, share, cap)
    if not plan.sources:
        return sized.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    at = lay_out(sized, plan)
    laid = materialise(at.withColumn("row", F.monotonically_increasing_id()), "mix-order")
    slots = materialise(schedule(spark, plan), "mix-schedule")
    many = slots.groupBy("source_no").agg(F.max("slots").alias("slots"))
    goal = F.round("target")
    laps = F.explode(F.sequence(F.lit(0), F.lit(int(cap) - 1 if cap == int(cap) else int(cap))))
    lapped = laid.where("size > 0").join(many, "source_no").select("row", "source_no", "size", "slots", "target", "start", "source_size", laps.alias("lap"))
    lapped = lapped.withColumn("start", F.col("start") + F.col("lap") * F.col("source_size")).where(F.col("start") < goal)
    place = lambda at: F.greatest(F.lit(0), F.least(F.col("slots") - 1, F.floor(at * F.col("slots") / goal)))
    last = F.least(F.col("start") + F.col("size"), goal) - 1
    blocks = F.explode(F.sequence(F.greatest(place(F.col("start")) - 1, F.lit(0)), F.least(place(last) + 1, F.col("slots") - 1)))
    pieces = lapped.select("row", "source_no", "start", "size", "target", blocks.alias("rank"))
    overlap = F.least(F.col("start") + F.col("size"), _cut(F.col("target"), F.col("slots"), F.col("rank") + 1)) - F.greatest("start", _cut(F.col("target"), F.col("slots"), F.col("rank")))
    used = pieces.join(slots.select("source_no", "rank", "slots"), ["source_no", "rank"]).groupBy("row").agg(F.sum(F.greatest(overlap, F.lit(0))).alias("taken"))
    return laid.join(used, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, rounded to whole documents; rows that it doesn't take go.

    A document without words stays once: it costs the mix nothing. Ids must be unique here; repeated ids take the
    largest of their counts. Columns and their order stay.
    """
    taken = mix(docs, id_col=id_col, **options).groupBy("doc_id").agg(F.max("taken").alias("__taken"), F.max("size").alias("__size"))
    times = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.when(F.col("__size") > 0, F.col("__size"))).cast("int")).otherwise(1)
    counts = taken.select(F.col("doc_id").alias("__id"), times.alias("__times"))
    joined = docs.join(counts, docs[id_col].eqNullSafe(counts["__id"]))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select(*[docs[c] for c in docs.columns])
