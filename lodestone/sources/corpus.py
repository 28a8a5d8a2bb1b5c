"""Corpora on disk: definitions, page readers, immutable versions, manifests, integrity."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.columns import document_id, table_markdown

SCHEMA_VERSION = "1.2"
VERSION = re.compile(r"v_[0-9a-f]{16}")
#: Fields that a manifest's digest leaves out.
UNSIGNED = {"manifest_sha256", "corpus_version", "built_at", "embedding_calls"}
DEFINITION = "corpus_id string, display_name string, description string, documents array<struct<path:string,display_name:string,include_pages:array<int>,publication_date:string,reporting_period_date:string,file_creation_date:string,metadata_source:string>>"


def read_definition(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a corpus definition, with its order."""
    rows = spark.read.schema(DEFINITION).option("multiLine", True).json(path)
    return rows.select("corpus_id", F.posexplode("documents").alias("nth", "d")).select("corpus_id", "nth", "d.*")


def source_kind(path: Column) -> Column:
    """'txt' or 'pdf' by suffix; any other suffix is an error."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("txt", "pdf"), suffix).otherwise(F.raise_error(F.concat(F.lit("unsupported source: "), path)))


def read_text_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text files as documents of one page: page 1, label '1'. A blank file is an error."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw_text"))
    checked = F.when(F.col("raw_text").rlike(r"\S"), F.col("raw_text")).otherwise(F.raise_error(F.concat(F.lit("no text in "), F.col("path"))))
    rows = raw.select("path", checked.alias("raw_text")).withColumn("source_sha256", F.sha2("raw_text", 256))
    return rows.select(document_id(F.col("source_sha256")).alias("document_id"), F.regexp_extract("path", "[^/]+$", 0).alias("document_name"), F.lit(1).alias("page"), F.lit("1").alias("page_label"), F.lit(0).alias("page_order"), "raw_text", F.lit(None).cast("string").alias("table_markdown"), "source_sha256")


def read_binary_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], include_pages: list[int] | None = None) -> DataFrame:
    """Pages of binary files by a given extractor (bytes to page texts), numbered from 1, in the order of include_pages.

    A page that doesn't exist, or holds no text, is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("source_sha256"))
    schema = "path string, source_sha256 string, page int, page_order int, raw_text string"

    def pages(batches):
        for batch in batches:
            rows = []
            for where, content, digest in zip(batch.path, batch.content, batch.source_sha256):
                texts = extract(bytes(content))
                for nth, page in enumerate(include_pages or range(1, len(texts) + 1)):
                    if not 1 <= page <= len(texts):
                        raise ValueError(f"{where} has no page {page}")
                    if not texts[page - 1].strip():
                        raise ValueError(f"page {page} of {where} has no text")
                    rows.append((where, digest, page, nth, texts[page - 1]))
            yield pd.DataFrame(rows, columns=["path", "source_sha256", "page", "page_order", "raw_text"])

    found = files.mapInPandas(pages, schema)
    chosen = F.lit(include_pages).cast("array<int>") if include_pages is not None else None
    return found.select(document_id(F.col("source_sha256"), chosen).alias("document_id"), F.regexp_extract("path", "[^/]+$", 0).alias("document_name"), "page", F.col("page").cast("string").alias("page_label"), "page_order", "raw_text", table_markdown(F.col("raw_text")).alias("table_markdown"), "source_sha256")


def embed_batches(records: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = 100) -> DataFrame:
    """chunk_id and vector by a given model, in batches of texts; vectors have length one."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                yield pd.DataFrame({"chunk_id": part.chunk_id, "vector": embed(part.normalized_text.tolist())})

    from lodestone.functions.columns import l2_normalize

    return records.select("chunk_id", "normalized_text").mapInPandas(run, "chunk_id string, vector array<float>").withColumn("vector", l2_normalize(F.col("vector")))


def atomic_write(path: str | Path, text: str) -> None:
    """Write beside the target, sync, rename: readers see the old file or the whole new one."""
    path = Path(path)
    temporary = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        temporary.unlink(missing_ok=True)


def ordered_digest(rows: DataFrame) -> DataFrame:
    """digest and n: sha256 of the canonical list of all records in id order. rows: id, canonical (JSON of a record).

    A digest of one ordered list is one value of all rows; it is taken once, when a version is published.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "canonical"))), lambda r: r.canonical)
    return rows.agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("digest"), F.count("*").alias("n"))


def reconcile_ids(known: DataFrame, other: DataFrame) -> DataFrame:
    """Ids that one side lacks: side 'missing' (of other) or 'unknown' (to known)."""
    column = known.columns[0]
    missing = known.exceptAll(other).select(F.lit("missing").alias("side"), column)
    return missing.unionByName(other.exceptAll(known).select(F.lit("unknown").alias("side"), column))


def manifest_digest(manifest: dict) -> str:
    return T.sha256(T.canonical_json({k: v for k, v in manifest.items() if k not in UNSIGNED}))


def publish(chunks: DataFrame, root: str | Path, corpus_id: str, documents: list[dict], extra: dict | None = None) -> dict:
    """Write chunks as an immutable version named by content, then move the pointer. The same content publishes once.

    Everything is built in a folder of its own; an error leaves neither a version nor a changed pointer.
    """
    root = Path(root)
    build = root / f"_build_{uuid.uuid4().hex}"
    try:
        ordered = chunks.orderBy("chunk_id")
        ordered.write.parquet(str(build / "chunks.parquet"))
        stored = chunks.sparkSession.read.parquet(str(build / "chunks.parquet"))
        if stored.groupBy("chunk_id").count().where("count > 1").count():
            raise ValueError("chunk ids repeat")
        digest, count = ordered_digest(stored.select(F.col("chunk_id").alias("id"), F.to_json(F.struct(*sorted(stored.columns))).alias("canonical"))).first()
        manifest = {"schema_version": SCHEMA_VERSION, "corpus_id": corpus_id, "documents": documents, "counts": {"chunks": count, "documents": len(documents)}, "artifacts": {"chunk_records_sha256": digest}} | (extra or {})
        manifest["manifest_sha256"] = manifest_digest(manifest)
        manifest["corpus_version"] = f"v_{manifest['manifest_sha256'][:16]}"
        manifest["built_at"] = datetime.now(UTC).isoformat()
        target = root / manifest["corpus_version"]
        atomic_write(build / "manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
        if target.exists():
            load_manifest(root, manifest["corpus_version"])
        else:
            os.replace(build, target)
        atomic_write(root / "current.json", T.canonical_json({k: manifest[k] for k in ("corpus_id", "corpus_version", "manifest_sha256")}))
        return manifest
    finally:
        shutil.rmtree(build, ignore_errors=True)


def load_manifest(root: str | Path, version: str) -> dict:
    """A version's manifest, if its name, schema and digest hold."""
    if not VERSION.fullmatch(version):
        raise ValueError("not a corpus version")
    manifest = json.loads((Path(root) / version / "manifest.json").read_text(encoding="utf-8"))
    if manifest.get("schema_version") != SCHEMA_VERSION or manifest.get("corpus_version") != version or manifest.get("manifest_sha256") != manifest_digest(manifest):
        raise ValueError("the manifest doesn't hold")
    return manifest


def load_current(root: str | Path) -> dict:
    """The manifest that the pointer names, if both agree."""
    pointer = json.loads((Path(root) / "current.json").read_text(encoding="utf-8"))
    manifest = load_manifest(root, pointer["corpus_version"])
    if any(pointer.get(k) != manifest[k] for k in ("corpus_id", "manifest_sha256")):
        raise ValueError("the pointer doesn't match its manifest")
    return manifest


def verify_version(spark: SparkSession, root: str | Path, version: str, vectors: DataFrame | None = None) -> list[str]:
    """What doesn't hold of a stored version: counts, digest, ids of the vectors."""
    manifest = load_manifest(root, version)
    stored = spark.read.parquet(str(Path(root) / version / "chunks.parquet"))
    digest, count = ordered_digest(stored.select(F.col("chunk_id").alias("id"), F.to_json(F.struct(*sorted(stored.columns))).alias("canonical"))).first()
    problems = []
    if count != manifest["counts"]["chunks"]:
        problems.append("chunk count")
    if digest != manifest["artifacts"]["chunk_records_sha256"]:
        problems.append("chunk digest")
    if vectors is not None and not reconcile_ids(stored.select("chunk_id"), vectors.select("chunk_id")).isEmpty():
        problems.append("vector ids")
    return problems


def artifacts_match(root: str | Path, documents: list[dict]) -> bool:
    """Whether every stored source lies inside root and has its digest."""
    import hashlib

    base = Path(root).resolve()
    for d in documents:
        path = (base / d["source_file"]).resolve()
        if base not in path.parents or not path.is_file() or hashlib.sha256(path.read_bytes()).hexdigest() != d["source_sha256"]:
            return False
    return True
