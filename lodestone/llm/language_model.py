"""Stupid-backoff scores, computed relationally.

Documents are dealt into blocks. A block's distinct n-grams go to partitions of their hash, each with its count in the
block; a partition adds the counts up (the n-gram count table) and answers every block; the blocks' exploded n-grams
are joined to the answers and their log scores are summed per document. What moves is each block's n-grams once, not
each document's; nothing is collected, and a partition's size follows the number of blocks.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches
from lodestone.llm.mixing import words_in

#: Factor of each step back; order of the model; seed of the words' hashes.
BACKOFF, ORDER, SEED = 0.4, 2, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Block:
    """Words of a block's documents as numbers, and its distinct n-grams of every order with their places."""

    def __init__(self, texts: pa.ChunkedArray, order: int):
        numbers: dict[bytes, int] = {}
        per, sizes = array("i"), []
        for text in texts:
            words = text.as_py().encode().lower().split()
            sizes.append(len(words))
            per.extend([numbers.setdefault(w, len(numbers)) for w in words])
        self.sizes = np.array(sizes, np.int64)
        ids = np.frombuffer(per, np.int32).astype(np.int64) if per else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.nth = np.arange(len(ids)) - starts[self.owner] if len(ids) else np.zeros(0, np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in numbers), np.uint64, len(numbers))
        #: of each order: hash of each distinct n-gram, its count here, and the n-gram that ends at each place (-1: none)
        self.hashes, self.counts, self.at = [hashes], [np.bincount(ids, minlength=len(hashes)).astype(np.int64)], [ids]
        for n in range(2, order + 1):
            before, at = self.at[-1], np.full(len(ids), -1, np.int64)
            places = np.flatnonzero(self.nth >= n - 1)
            pair = before[places - 1] * (len(hashes) + 1) + ids[places]
            distinct, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            at[places] = inverse
            left, right = distinct // (len(hashes) + 1), distinct % (len(hashes) + 1)
            self.hashes.append(_mixed(_mixed(self.hashes[-1][left]) + hashes[right] + np.uint64(n)))
            self.counts.append(count)
            self.at.append(at)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, text, text_hash and block of each row, dealt out by block, and the number of blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)).cast("int")).repartition(parts, "block"), parts


def _in_order(table: pa.Table) -> pa.Table:
    """The block's rows in a fixed order, so that both uses of a block number its n-grams alike."""
    return table.take(pc.sort_indices(table.select(["doc_id", "text_hash"]), sort_keys=[("doc_id", "ascending"), ("text_hash", "ascending")]))


def document_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_score (sum over words) and score (mean) of each row.

    Words are runs of non-blank bytes, A-Z in lower case. Counts are over all documents less the occurrence that is
    scored, so a text is no evidence for itself: S(w | h) = c(h w) / c(h) where c(h w) > 0, else backoff * S(w | h less
    its first word); S(w) = c(w) / N, or backoff / N for a word that occurs once. Null and empty texts have no words and
    the score 0; repeated rows each count; an empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows, parts = _blocks(docs, id_col, text_col)
    n_words = docs.agg(F.sum(words_in(F.col(text_col)))).first()[0] or 0

    def grams(table: pa.Table) -> pa.Table:
        block = Block(_in_order(table).column("text"), order)
        number = table.column("block")[0].as_py()
        out: dict[str, list] = {"block": [], "n": [], "part": [], "hashes": [], "counts": []}
        for n in range(order):
            part = (block.hashes[n] >> np.uint64(17)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
            for p in range(parts):
                some = by[edges[p] : edges[p + 1]]
                if len(some):
                    out["block"].append(number)
                    out["n"].append(n)
                    out["part"].append(p)
                    out["hashes"].append(block.hashes[n][some].tobytes())
                    counts = block.counts[n][some]
                    out["counts"].append(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes())
        kinds = {"block": pa.int32(), "n": pa.int32(), "part": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    def answers(table: pa.Table) -> pa.Table:
        """Total counts of one partition's n-grams, for each block in the order in which it sent them."""
        table = table.combine_chunks()
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        sizes = [len(h) for h in hashes]
        counts = np.concatenate([_wide(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes)])
        flat = np.concatenate(hashes)
        by = np.argsort(flat, kind="stable")
        ordered = flat[by]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        totals = np.repeat(np.add.reduceat(counts[by], heads), np.diff(np.append(heads, len(flat))))
        back = np.empty(len(flat), np.int64)
        back[by] = totals
        edges = np.cumsum([0, *sizes])
        packed = [np.minimum(t, 255).astype(np.uint8).tobytes() + t[t >= 255].astype("<i8").tobytes() for t in (back[a:b] for a, b in zip(edges[:-1], edges[1:]))]
        return pa.table({"block": table.column("block"), "n": table.column("n"), "part": table.column("part"), "totals": pa.array(packed, pa.binary())})

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        table = _in_order(left)
        block = Block(table.column("text"), order)
        sent = {(n, p): t for n, p, t in zip(*(right.column(c).to_pylist() for c in ("n", "part", "totals")))}
        totals = []
        for n in range(order):
            part = (block.hashes[n] >> np.uint64(17)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
            total = np.zeros(len(by), np.int64)
            for p in range(parts):
                some = by[edges[p] : edges[p + 1]]
                if len(some):
                    total[some] = _wide(sent[(n, p)], len(some))
            totals.append(total)
        at = block.at
        c = totals[0][at[0]] - 1
        value = np.where(c > 0, c, backoff) / max(n_words - 1, 1)
        for n in range(1, order):
            here = at[n] >= 0
            seen = np.where(here, totals[n][at[n]] - 1, 0) if len(totals[n]) else np.zeros(len(c), np.int64)
            context = np.concatenate([[1], totals[n - 1][at[n - 1][:-1]] - 1]) if len(c) else c
            value = np.where(here & (seen > 0), seen / np.maximum(context, 1), np.where(here, backoff * value, value))
        sums = np.bincount(block.owner, np.log(value), table.num_rows) if len(c) else np.zeros(table.num_rows)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(block.sizes), "log_score": pa.array(sums)})

    sent = rows.groupBy("block").applyInArrow(grams, "block int, n int, part int, hashes binary, counts binary")
    replied = sent.groupBy("part").applyInArrow(answers, "block int, n int, part int, totals binary")
    found = rows.groupBy("block").cogroup(replied.groupBy("block")).applyInArrow(scores, "doc_id long, n_words long, log_score double")
    return found.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.greatest("n_words", F.lit(1))).otherwise(0.0))


def _wide(packed: bytes, n: int) -> np.ndarray:
    """Counts from a byte each, where 255 stands for the next 64-bit number after the bytes."""
    counts = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    if (large := counts == 255).any():
        counts[large] = np.frombuffer(packed, "<i8", offset=n)
    return counts
