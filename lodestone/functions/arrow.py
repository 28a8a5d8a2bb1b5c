"""Arrow-batched Spark functions over `lodestone.functions.text`, and their registration for SQL."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession

from lodestone.functions import text as T
from lodestone.functions.lazy import arrow_function


def _mapped(fn: Callable, kind: str, nulls=None):
    """An Arrow function that applies fn to rows without nulls; a null argument gives `nulls`."""

    @arrow_function(kind)
    def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
        rows = zip(first, *rest)
        return pd.Series([nulls if any(v is None for v in row) else fn(*row) for row in rows], dtype="object")

    return run


normalize_evidence = _mapped(T.normalize, "string")
normalize_operations = _mapped(T.normalize_operations, "array<string>")
metric_key = _mapped(T.metric_key, "string")
metric_tokens = _mapped(lambda t: [x._asdict() for x in T.metric_tokens(t)], "array<struct<value:string,start:int,end:int,kind:string>>")
phrase_variants = _mapped(T.phrase_variants, "array<string>")
sentences = _mapped(T.sentences, "array<string>")
boundaries = _mapped(T.boundaries, "array<int>")
text_matches = _mapped(lambda n, h: [{"start": a, "end": b} for a, b in T.text_matches(n, h)], "array<struct<start:int,end:int>>")
text_contains = _mapped(T.text_contains, "boolean")
word_phrase = _mapped(T.word_phrase, "string")
phrase_spans = _mapped(lambda p, h: [{"start": a, "end": b} for a, b in T.phrase_spans(p, T.normalize(h))], "array<struct<start:int,end:int>>")
index_words = _mapped(T.index_words, "array<string>")


def client_address(peer: str | None, forwarded: str | None, trusted: list[str]) -> str:
    """The forwarded address where the peer is a trusted proxy, else the peer's; 'unknown' without a peer."""
    if not peer:
        return "unknown"
    try:
        address = ipaddress.ip_address(peer)
    except ValueError:
        return peer
    if forwarded and any(address in ipaddress.ip_network(n, strict=False) for n in trusted):
        try:
            return str(ipaddress.ip_address(forwarded.strip()))
        except ValueError:
            return str(address)
    return str(address)


def client_address_udf(trusted: list[str]):
    @arrow_function("string")
    def run(peer: pd.Series, forwarded: pd.Series) -> pd.Series:
        return pd.Series([client_address(p, f, trusted) for p, f in zip(peer, forwarded)], dtype="object")

    return run


def register(spark: SparkSession) -> None:
    """Make the text, numeric and temporal functions and the chunker available to SQL."""
    from lodestone.operators import binding, chunking

    functions = {
        "normalize_evidence": normalize_evidence, "normalize_operations": normalize_operations, "metric_key": metric_key, "metric_tokens": metric_tokens,
        "phrase_variants": phrase_variants, "sentence_fragments": sentences, "text_contains": text_contains, "word_phrase": word_phrase,
        "numeric_signatures": binding.numeric_signatures_udf, "temporal_signature": binding.temporal_signature_udf, "bind_observation": binding.bind_udf,
    }
    for name, fn in functions.items():
        spark.udf.register(name, fn.udf)
    spark.udtf.register("chunk_page", chunking.ChunkPage)
