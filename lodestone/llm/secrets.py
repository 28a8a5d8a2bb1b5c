"""Secret scans with multipart credential linking.

Base spans (assignments, access identifiers, long hexadecimal strings) stand by themselves. Weak parts, such as user
names, e-mail addresses, random-looking strings, addresses and endpoints, prove nothing alone: a part is reported only
when its complement lies within reach and in the same scope. Scopes are paragraphs; parts are joined by their intervals:
a part meets the nearest complement that ends before it and the nearest that begins after it, both found in sorted
bounds, so a text of n parts costs n log n however long a part is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

#: Kinds in the order in which equal starts are listed: base kinds, then linked parts.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts, each with the characters without one of which its pattern can't match: names and ids of accounts,
#: secrets of little form, places to use them at.
WEAK = (
    ("identifier", ":=", re.compile(r"""\b(?:access_?key_?id|client_?id|account_?(?:id|name)|tenant_?id|user_?(?:id|name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.I | re.A)),
    ("identifier", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)),
    ("secret", ":=", re.compile(r"""\b(?:pwd|pass|passphrase|private_?key|access_?key|auth|credential|client_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=~!@#$%^&*-]{4,}""", re.I | re.A)),
    ("secret", "", re.compile(r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}", re.A)),
    ("endpoint", ":", re.compile(r"""\b(?:https?|ftps?|sftp|ssh|s3|gs|amqps?|rediss?|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|jdbc:[a-z]+)://[^\s"'<>]{3,}""", re.I | re.A)),
    ("endpoint", ":=", re.compile(r"""\b(?:host|endpoint|server|region|bucket|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}""", re.I | re.A)),
    ("endpoint", ".", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])(?::[0-9]{1,5})?", re.A)),
)
SCOPE_END = re.compile(r"\n[^\S\n]*\n")
#: Code points between complementary parts, at most; length of an assigned value, at least.
REACH, LEAST_VALUE = 400, 6

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans that are reported wherever they stand, in code points, the end exclusive."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


class Parts:
    """Disjoint-interval lookups over parts: by start, and by end. No part crosses a scope's end, as none holds a line break."""

    def __init__(self, parts: list[Span]):
        self.starts, self.ends = sorted(p[0] for p in parts), sorted(p[1] for p in parts)

    def any_near(self, part: Span, low: int, high: int) -> bool:
        """Whether a part that doesn't overlap this one lies within REACH of it and within the scope [low, high]."""
        after, before = bisect_left(self.starts, part[1]), bisect_right(self.ends, part[0]) - 1
        if after < len(self.starts) and self.starts[after] <= min(part[1] + REACH, high - 1):
            return True
        return before >= 0 and self.ends[before] >= max(part[0] - REACH, low + 1)


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Weak parts in order, without secrets that overlap a base span and without parts that an earlier, longer one of their kind covers."""
    starts, ends = sorted(s[0] for s in base), sorted(s[1] for s in base)
    found: set[Span] = set()
    for kind, needs, pattern in WEAK:
        if needs and not any(c in text for c in needs):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            overlapped = bisect_left(starts, b) > bisect_right(ends, a)  # more base spans begin before b than end by a
            if kind != "secret" or not overlapped:
                found.add((a, b, kind))
    out, reach = [], dict.fromkeys(KINDS, -1)
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if b > reach[kind]:
            out.append((a, b, kind))
            reach[kind] = b
    return out


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts whose complement lies in reach: identifiers and endpoints with secrets, secrets with identifiers, access identifiers or endpoints."""
    weak = weak_parts(text, base)
    if not weak:
        return []
    secrets = Parts([s for s in base if s[2] != "access"] + [s for s in weak if s[2] == "secret"])
    places = Parts([s for s in base if s[2] == "access"] + [s for s in weak if s[2] != "secret"])
    if not secrets.starts or not places.starts:
        return []
    cuts = [m.end() for m in SCOPE_END.finditer(text)]
    edges = [0, *cuts, len(text)]

    def kept(part: Span) -> bool:
        scope = bisect_right(cuts, part[0])
        return (places if part[2] == "secret" else secrets).any_near(part, edges[scope], edges[scope + 1])

    return [p for p in weak if kept(p)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans and n_linked (weak parts that their complements confirm) of each row.

    A null text counts as empty and has no spans, a null id stays null, repeated rows are scanned alike, an empty table
    gives no rows, other columns aren't read. No row is moved between tasks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")}
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                linked = linked_spans(text, base)
                kinds = [k for _, _, k in base]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(kinds.count(kind))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(base + linked))
                out["n_linked"].append(len(linked))
            types = {"base_sha256": pa.string(), "spans": pa.string()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})

    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
