"""Native column expressions: ids, estimates, tables, numbers."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T


def token_estimate(text: Column) -> Column:
    """1.32 tokens a word, rounded, at least one."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    return F.greatest(F.lit(1), F.round(words * F.lit(1.32)).cast("int"))


def chunk_id(document: Column, page: Column, position: Column) -> Column:
    key = F.concat_ws(":", document.cast("string"), page.cast("string"), position.cast("string"))
    return F.concat(F.lit("chk_"), F.substring(F.sha2(key, 256), 1, 16))


def document_id(source_sha256: Column, include_pages: Column | None = None) -> Column:
    """Id by content and selected pages: a digest of canonical JSON."""
    pages = F.lit("null") if include_pages is None else F.coalesce(F.concat(F.lit("["), F.array_join(include_pages.cast("array<string>"), ","), F.lit("]")), F.lit("null"))
    canonical = F.concat(F.lit('{"include_pages":'), pages, F.lit(',"source_sha256":"'), source_sha256, F.lit('"}'))
    return F.concat(F.lit("doc_"), F.substring(F.sha2(canonical, 256), 1, 24))


def is_chunk_id(value: Column) -> Column:
    return value.rlike("^chk_[0-9a-f]{16}$")


def chunk_number(value: Column) -> Column:
    """A chunk id's 64 bits as an unsigned number; null where the id isn't one."""
    return F.when(is_chunk_id(value), F.conv(F.substring(value, 5, 16), 16, 10).cast("decimal(20,0)"))


def preview(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def canonical_digits(number: Column) -> Column:
    """Digits without leading zeros of the integer and trailing zeros of the fraction; never a number type."""
    whole = F.regexp_replace(F.split_part(number, F.lit("."), F.lit(1)), "^0+(?=[0-9])", "")
    fraction = F.regexp_replace(F.split_part(number, F.lit("."), F.lit(2)), "0+$", "")
    return F.when(fraction != "", F.concat_ws(".", whole, fraction)).otherwise(whole)


def canonical_unit(unit: Column) -> Column:
    return F.when(unit.isin("bps", "basis point"), "basis points").when(unit == "%", "percent").otherwise(unit)


def kind_accepts_unit(kind: Column, unit: Column) -> Column:
    rate, share = unit.isin("basis point", "basis points", "bps", "percent", "%"), unit == "per share"
    return F.when(kind == "reported_rate", rate).when(kind == "reported_per_share", share).when(kind == "reported_level", ~rate & ~share).otherwise(F.lit(False))


def table_markdown(text: Column) -> Column:
    """Lines of at least two cells (split at two or more blanks) as a Markdown table; null for fewer than two such lines."""
    cells = lambda line: F.filter(F.transform(F.split(F.trim(line), r"\s{2,}"), lambda c: F.trim(c)), lambda c: c != "")
    rows = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), cells), lambda r: F.size(r) >= 2)
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))

    def render(found: Column) -> Column:
        width = F.array_max(F.transform(found, lambda r: F.size(r)))
        padded = F.transform(found, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        rule = line(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, F.lit(2), F.size(padded))), "\n")

    return F.element_at(F.transform(F.array(rows), lambda found: F.when(F.size(found) >= 2, render(found))), 1)


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector is an error."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(squares > 0, F.transform(vector, lambda x: (x / F.sqrt(squares)).cast("float"))).otherwise(F.raise_error(F.lit("a zero vector has no direction")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed; a text of one block gives its non-empty lines."""
    tidy = lambda parts: F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    blocks = tidy(F.split(text, r"\n\s*\n+"))
    return F.when(F.size(blocks) > 1, blocks).otherwise(tidy(F.split(text, r"\r\n|\n|\r")))


def word_windows(text: Column, words: int = 530, step: int = 470) -> Column:
    """An oversized paragraph as overlapping windows of words; the last window reaches the end."""
    of = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    last = lambda w: F.ceil(F.greatest(F.size(w) - words, F.lit(0)) / F.lit(step)).cast("int")
    cut = lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda k: F.array_join(F.slice(w, k * step + 1, words), " "))
    return F.element_at(F.transform(F.array(of), cut), 1)


def valid_session(token: Column) -> Column:
    return token.rlike("^[A-Za-z0-9_-]{40,128}$")


def session_digest(token: Column) -> Column:
    return F.sha2(token, 256)


@functools.cache
def _folding() -> tuple[str, str]:
    """Characters that index words change, and what becomes of them; marks that go stand last, where the second string has ended."""
    kept = {c: b for n in range(128, sys.maxunicode + 1) if not 0xD800 <= n < 0xE000 and (b := T.bare(c := chr(n))) != c}
    letters = [c for c, b in kept.items() if b]
    return "".join(letters + [c for c, b in kept.items() if not b]), "".join(kept[c] for c in letters)


def index_words(text: Column) -> Column:
    """Words of the lexical index, as `text.index_words` gives them: runs of letters and digits, lower case, Latin letters without diacritics."""
    lower = F.lower(text)
    plain = F.when(lower.rlike(r"[^\x00-\x7F]"), F.translate(lower, *_folding())).otherwise(lower)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def search_parts(query: Column) -> Column:
    """Search phrases of a query, as `text.query_phrases` gives them: its first tokens; each is later split into index words."""
    return F.slice(F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_.$%+-]+"), F.lit(0)), 1, T.MOST_QUERY_TOKENS)
