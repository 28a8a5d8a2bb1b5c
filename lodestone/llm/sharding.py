"""Sharding by sampled splitters.

Records get a key: a hash of the text, then a hash of the id, so that equal texts stand together. A
size-weighted sample of keys gives the quantile boundaries of many fine ranges; one pass measures the
ranges exactly; overfull ranges are sampled again and subdivided; neighbouring ranges make up a shard, and
ranges move from overfull to underfull shards until the sizes are near equal. A text whose copies outweigh a
range is cut by the id's hash, all other groups of equal texts stay within one fine range.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hex16, literal_array, materialise, rank_in, unit_interval

#: Fine ranges for each shard, at least; sampled keys for each fine range; bytes in a fine range, at most.
RANGES_PER_SHARD, SAMPLES_PER_RANGE, RANGE_BYTES, MOST_RANGES = 64, 16, 1 << 28, 1 << 16


@dataclass
class Splitters:
    """bounds: ascending first keys of ranges 1, 2, ...; shard and base: of each range, its shard and first slot."""

    bounds: list[str]
    shard: list[int]
    base: list[int]

    def range_of(self, key: Column) -> Column:
        return rank_in(key, self.bounds, "string")

    def shard_of(self, span: Column) -> Column:
        return F.element_at(literal_array(self.shard, "int"), span + 1)

    def base_of(self, span: Column) -> Column:
        return F.element_at(literal_array(self.base, "bigint"), span + 1)


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def record_key(text: Column, ident: Column) -> Column:
    return F.concat(hex16(F.xxhash64(F.coalesce(text, F.lit("")))), hex16(F.xxhash64(ident)))


def _sample(keyed: DataFrame, per_byte: float, salt: int) -> list[tuple[str, float]]:
    """Keys drawn with a chance in proportion to their size, each with its weight, in key order."""
    weight = F.col("size") * F.lit(per_byte)
    drawn = keyed.where(unit_interval(F.col("key"), F.lit(salt)) < weight).select("key", F.greatest(weight, F.lit(1.0)).alias("w"))
    return sorted((r.key, r.w) for r in drawn.collect())


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """First keys of the parts after the first one. A boundary stands at the start of a group unless the group fills a part."""
    step = sum(w for _, w in sample) / max(parts, 1)
    bounds: list[str] = []
    seen, due, last = 0.0, step, ""
    for key, w in sample:
        if seen + w > due:
            text = key[:16]
            bound = key if text == last else text
            if not bounds or bound > bounds[-1]:
                bounds.append(bound)
            last = text
            while due <= seen + w:
                due += step
        seen += w
    return bounds


def _rebalance(sizes: list[int], shards: int) -> list[int]:
    """A shard for each range: neighbours first, then pieces of overfull shards go to underfull ones."""
    total, seen = sum(sizes), 0
    of: list[int] = []
    for s in sizes:
        of.append(min(shards - 1, int((seen + s / 2) * shards / total)) if total else 0)
        seen += s
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for i, (s, k) in enumerate(zip(sizes, of)):
        load[k] += s
        held[k].append((s, i))
    for _ in range(4 * len(sizes)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        best = min(held[high], key=lambda x: abs(2 * x[0] - gap), default=None)
        if gap * shards * 500 <= total or best is None or best[0] >= gap or best[0] == 0:
            break
        held[high].remove(best)
        held[low].append(best)
        load[high] -= best[0]
        load[low] += best[0]
        of[best[1]] = low
    return of


def choose_splitters(keyed: DataFrame, shards: int) -> Splitters:
    """Splitters for a table with columns key and size. The sample and the list of ranges are bounded; rows aren't collected."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(RANGES_PER_SHARD * shards, -(-total // RANGE_BYTES)))
    if not total:
        return Splitters([], [0], [0])
    per_byte = SAMPLES_PER_RANGE * ranges / total
    bounds = _quantiles(_sample(keyed, per_byte, 0), ranges)
    for salt in itertools.count(1):
        spans = keyed.select("size", rank_in(F.col("key"), bounds, "string").alias("span")).groupBy("span")
        stats = {r.span: (r.bytes, r.n) for r in spans.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        overfull = [k for k, (b, n) in stats.items() if n > 1 and b > 2 * total / ranges]
        if not overfull:
            break
        rows = keyed.withColumn("span", rank_in(F.col("key"), bounds, "string")).where(F.col("span").isin(overfull))
        added = _subdivide(bounds, _sample(rows, 8 * per_byte, salt), overfull, stats, total / ranges)
        if not added - set(bounds):  # what is left can't be cut: rows of one key
            break
        bounds = sorted(set(bounds) | added)
    sizes = [stats.get(k, (0, 0))[0] for k in range(len(bounds) + 1)]
    counts = [stats.get(k, (0, 0))[1] for k in range(len(bounds) + 1)]
    shard, base, filled = _rebalance(sizes, shards), [], [0] * shards
    for k, n in zip(shard, counts):
        base.append(filled[k])
        filled[k] += n
    return Splitters(bounds, shard, base)


def _subdivide(bounds: list[str], sample: list[tuple[str, float]], overfull: list[int], stats: dict, share: float) -> set[str]:
    """More boundaries inside the overfull ranges."""
    inside: dict[int, list[tuple[str, float]]] = {}
    for key, w in sample:
        inside.setdefault(bisect_right(bounds, key), []).append((key, w))
    return {b for k in overfull for b in _quantiles(inside.get(k, []), -(-stats[k][0] // max(1, int(share))))}


def keyed_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and key of each record; the text itself stays behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), record_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record_key(F.col(text_col), F.col(id_col)).alias("key")
    )


def shard_records(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record with its shard (sizes near equal) and its slot (gapless from 0 within the shard).

    Null texts count as empty, null ids are ids like any other, repeated rows each get a slot of their own, an empty
    table gives no rows, and columns other than the two named ones are not read. Reruns agree: every choice is a hash
    of the key.
    """
    keyed = materialise(keyed_records(docs, id_col, text_col), "shard-keys")
    splitters = choose_splitters(keyed, shards)
    placed = keyed.withColumn("span", splitters.range_of(F.col("key")))
    nth = F.row_number().over(Window.partitionBy("span").orderBy("key", "doc_id"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), splitters.shard_of(F.col("span")).alias("shard"),
        (splitters.base_of(F.col("span")) + nth - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def with_shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and a last column shard, which takes the place of one of that name. The texts aren't moved: a
    record's shard follows from its key. Nulls, ties, repeated rows and an empty table as in shard_records; other
    columns pass through.
    """
    splitters = choose_splitters(materialise(keyed_records(docs, id_col, text_col).select("key", "size"), "shard-keys"), shards)
    span = splitters.range_of(record_key(F.col(text_col), F.col(id_col)))
    return docs.select(*[docs[c] for c in docs.columns if c != "shard"], splitters.shard_of(span).alias("shard"))
