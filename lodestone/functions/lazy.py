"""Arrow functions that are made when first used, so that modules import without a session, on executors too."""

from __future__ import annotations

from pyspark.sql import functions as F


class ArrowFunction:
    """A pandas_udf of a function over batches; call it with columns."""

    def __init__(self, fn, kind: str):
        self.fn, self.kind, self._made = fn, kind, None

    @property
    def udf(self):
        if self._made is None:
            self._made = F.pandas_udf(self.fn, self.kind)
        return self._made

    def __call__(self, *columns):
        return self.udf(*columns)

    def __reduce__(self):
        return ArrowFunction, (self.fn, self.kind)


def arrow_function(kind: str):
    return lambda fn: ArrowFunction(fn, kind)
