"""A deterministic hashed embedding, for tests and for corpora without a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import l2_normalize


def hashed_embedding(text: Column, dimensions: int = 128) -> Column:
    """Each token of letters, digits and dots adds 1 and 1/2 at two places of its digest; the vector has length one."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9.]+"), F.lit(0))
    place = lambda t, at: (F.conv(F.substring(F.sha2(t, 256), at, 8), 16, 10).cast("long") % dimensions).cast("int")
    places = F.transform(tokens, lambda t: F.struct(place(t, 1).alias("first"), place(t, 9).alias("second")))
    weight = lambda ps, d: F.aggregate(ps, F.lit(0.0), lambda s, p: s + F.when(p["first"] == d, 1.0).otherwise(0.0) + F.when(p["second"] == d, 0.5).otherwise(0.0))
    vector = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: weight(ps, d).cast("float"))
    return F.when(F.size(tokens) > 0, l2_normalize(F.element_at(F.transform(F.array(places), vector), 1)))
