"""Pages to chunks: paragraph packing within a token budget, chunk records, links along a document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestone.functions import text as T
from lodestone.functions.columns import chunk_id, table_markdown

#: Tokens at which a chunk may close, most tokens of a chunk, tokens that the next one repeats.
TARGET, MOST, OVERLAP = 500, 700, 80


def split_paragraphs(text: str) -> list[str]:
    """Blocks between blank lines; where there's one at most, non-blank lines."""
    blocks = [b for b in map(str.strip, re.split(r"\n\s*\n+", text)) if b]
    return blocks if len(blocks) > 1 else [x for x in map(str.strip, text.splitlines()) if x]


def split_oversized(paragraph: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """A paragraph above the budget as windows of words that overlap."""
    if T.estimate_tokens(paragraph) <= most:
        return [paragraph]
    words = paragraph.split()
    width = max(1, int(most / T.TOKENS_PER_WORD))
    step = width - min(width - 1, max(1, int(overlap / T.TOKENS_PER_WORD)))
    count = 1 + max(0, -(-(len(words) - width) // step))
    return [" ".join(words[k * step : k * step + width]) for k in range(count)]


def tail(text: str, budget: int) -> str:
    """The longest run of last words whose estimate is within the budget."""
    words = text.split()
    n = min(len(words), int(max(budget, 0) / T.TOKENS_PER_WORD) + 1)
    while n and (budget <= 0 or max(1, round(T.TOKENS_PER_WORD * n)) > budget):
        n -= 1
    return " ".join(words[len(words) - n :]) if n else ""


def chunk_page(text: str, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Chunks of one page. A chunk closes when the next paragraph would exceed the budget (its tail is then carried
    over) or when it is nine tenths full; a short rest joins the chunk before it where the budget allows."""
    done: list[list[str]] = []
    open_: list[str] = []
    filled = 0
    for part in (s for p in split_paragraphs(text) for s in split_oversized(p, most, overlap)):
        size = T.estimate_tokens(part)
        if open_ and filled + size > most:
            done.append(open_)
            carried = tail("\n\n".join(open_), min(overlap, most - size)).split()
            while carried and T.estimate_tokens(" ".join(carried) + "\n\n" + part) > most:
                del carried[0]
            open_ = [" ".join(carried)] if carried else []
            filled = T.estimate_tokens(open_[0]) if open_ else 0
        open_.append(part)
        filled += size
        if filled >= max(target, 0.9 * most):
            done.append(open_)
            open_, filled = [], 0
    if open_:
        rest = "\n\n".join(open_)
        if done and T.estimate_tokens(rest) < overlap and T.estimate_tokens("\n\n".join([*done[-1], rest])) <= most:
            done[-1] = [*done[-1], rest]
        else:
            done.append(open_)
    return ["\n\n".join(parts) for parts in done]


@udtf(returnType="chunk_position: int, raw_text: string")
class ChunkPage:
    """SQL table function: chunk_page(text) gives position and text of each chunk."""

    def eval(self, text: str):
        for position, part in enumerate(chunk_page(text or "")):
            yield position, part


def chunks(pages: DataFrame) -> DataFrame:
    """Chunk records of pages (document_id, document_name, page, page_label, page_order, raw_text), one Arrow pass.

    Pages that are null or blank give no chunk. Ids follow from document, page and position; digest and estimate are
    of the normalized text; a chunk never crosses a page.
    """
    schema = "document_id string, document_name string, page int, page_label string, page_order int, chunk_position int, raw_text string, normalized_text string, sha256 string, token_estimate int"
    inputs = pages.select(F.col("document_id").cast("string"), F.col("document_name").cast("string"), F.col("page").cast("int"), F.col("page_label").cast("string"), F.col("page_order").cast("int"), "raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, position, raw, tidy = [], [], [], []
            for i, text in enumerate(batch.column("raw_text").to_pylist()):
                parts = chunk_page(text or "")
                row += [i] * len(parts)
                position += range(len(parts))
                raw += parts
                tidy += map(T.normalize, parts)
            kept = batch.drop_columns(["raw_text"]).take(pa.array(row, pa.int64()))
            added = {
                "chunk_position": pa.array(position, pa.int32()), "raw_text": pa.array(raw, pa.string()), "normalized_text": pa.array(tidy, pa.string()),
                "sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in tidy], pa.string()), "token_estimate": pa.array(map(T.estimate_tokens, tidy), pa.int32()),
            }
            yield pa.RecordBatch.from_arrays([*kept.columns, *added.values()], names=[*kept.schema.names, *added])

    return inputs.mapInArrow(run, schema).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("page"), F.col("chunk_position")))


def with_links(records: DataFrame) -> DataFrame:
    """previous_chunk_id and next_chunk_id along each document, in page order as given, then position."""
    order = Window.partitionBy("document_id").orderBy("page_order", "chunk_position")
    return records.withColumns({"previous_chunk_id": F.lag("chunk_id").over(order), "next_chunk_id": F.lead("chunk_id").over(order)})


def collisions(records: DataFrame) -> DataFrame:
    """Chunk ids that more than one record has."""
    return records.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def checked(records: DataFrame) -> DataFrame:
    """records, or an error where a chunk id repeats."""
    return records.withColumn("chunk_id", F.when(F.count("*").over(Window.partitionBy("chunk_id")) == 1, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("chunk id collision: "), "chunk_id"))))


def pages_of_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents as one-page texts: page 1, label '1', no table."""
    return documents.select(
        F.format_string("d%d", F.col("doc_id")).alias("document_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("document_name"),
        F.lit(1).alias("page"), F.lit("1").alias("page_label"), F.lit(0).alias("page_order"), F.col("text").alias("raw_text"), table_markdown(F.col("text")).alias("table_markdown"),
    )
