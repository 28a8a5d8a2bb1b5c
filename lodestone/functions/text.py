"""Text semantics as plain functions: normalization, typed metric tokens, sentence boundaries, phrase and text matching.

Offsets are code points of the normalized text. Spark wrappers are in `lodestone.functions.arrow`.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from typing import NamedTuple

# Patterns of the text contract.
HYPHENATED_BREAK = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
WORD = re.compile(r"[^\W_]+")
DOTTED = re.compile(r"(?<!\w)(?:(?:[^\W\d_]\.){2,}|(?:[^\W\d_]\.)+[^\W\d_](?!\w))")
PHRASE_GAP = re.compile(r"[\s/&+'\"()\[\]{}\-‐‑‒–—]+")
SENTENCE_MARKS, CLAUSE_MARKS = ".!?", ".!?;"
#: Phrase variants, at most; tokens in a search query, at most; tokens per word; preview length.
MOST_VARIANTS, MOST_QUERY_TOKENS, TOKENS_PER_WORD, PREVIEW = 64, 24, 1.32, 280

OPERATIONS = ("unicode_nfkc", "pdf_linebreak_dehyphenation", "whitespace_folding")


class Token(NamedTuple):
    """A metric token: kind is 'word' or 'initialism'; value is case-folded, dots removed."""

    value: str
    start: int
    end: int
    kind: str


def normalize_steps(text: str) -> list[str]:
    """The text after each of OPERATIONS."""
    composed = unicodedata.normalize("NFKC", text)
    joined = HYPHENATED_BREAK.sub("", composed)
    return [composed, joined, " ".join(re.split(r"\s+", joined)).strip()]


def normalize(text: str) -> str:
    return normalize_steps(text)[-1]


def normalize_operations(text: str) -> list[str]:
    """Names of the operations that changed the text."""
    steps = [text, *normalize_steps(text)]
    return [name for name, before, after in zip(OPERATIONS, steps, steps[1:]) if before != after]


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def estimate_tokens(text: str) -> int:
    return max(1, round(TOKENS_PER_WORD * len(re.findall(r"\S+", text))))


def _is_compact_initialism(word: str) -> bool:
    return len(word) in (2, 3) and word.isalpha() and word == word.upper() != word.lower()


def metric_tokens(text: str) -> list[Token]:
    """Tokens in order. A dotted initialism is one token; words fill the stretches between dotted ones."""
    tokens, at = [], 0
    dotted = [m.span() for m in DOTTED.finditer(text)] if "." in text else []
    for start, end in [*dotted, (len(text), len(text))]:
        if start < at:
            continue
        for m in WORD.finditer(text, at, start):
            tokens.append(Token(m[0].casefold(), m.start(), m.end(), "initialism" if _is_compact_initialism(m[0]) else "word"))
        if end > start:
            tokens.append(Token(text[start:end].replace(".", "").casefold(), start, end, "initialism"))
        at = end
    return tokens


def metric_key(text: str) -> str:
    """The identity of a metric as one string: words in lower case, initialisms in upper case."""
    return " ".join(t.value.upper() if t.kind == "initialism" else t.value for t in metric_tokens(normalize(text)))


def phrase_variants(text: str, most: int = MOST_VARIANTS) -> list[str] | None:
    """Phrases that a word index may hold for a metric: initialisms compact or spelled out. None: too many; search everything."""
    tokens = metric_tokens(normalize(text))
    spelled = [dict.fromkeys([t.value, " ".join(t.value)]) if t.kind == "initialism" else {t.value: None} for t in tokens]
    if not tokens:
        return []
    if 1 << sum(t.kind == "initialism" for t in tokens) > most:
        return None
    return list(dict.fromkeys(map(" ".join, itertools.product(*spelled))))


def boundaries(text: str, marks: str = CLAUSE_MARKS) -> list[int]:
    """Offsets of marks that end a sentence or clause. A full stop in an initialism or after an abbreviation doesn't."""
    inside = {i for t in metric_tokens(text) if t.kind == "initialism" for i in range(t.start, t.end)} if "." in text else set()
    return [i for i, c in enumerate(text) if c in marks and not (c == "." and (i in inside or _stays_open(text, i)))]


def _stays_open(text: str, stop: int) -> bool:
    rest = text[stop + 1 :]
    if not rest:
        return False
    after = rest.lstrip()
    if len(after) == len(rest):
        return True
    following = after[:1]
    if following.islower() or following.isdigit():
        return True
    before = re.search(r"[^\W\d_]+\Z", text[max(0, stop - 64) : stop])
    return bool(before) and len(before[0]) <= 4 and before[0][0].isupper() and following.isupper()


def sentences(text: str) -> list[str]:
    """Non-blank sentences, each with its closing mark."""
    cuts = [0, *(i + 1 for i in boundaries(text, SENTENCE_MARKS)), len(text)]
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    return [p for p in parts if p.strip()] if len(cuts) > 2 else [text]


def text_matches(needle: str, haystack: str) -> list[tuple[int, int]]:
    """Spans of the normalized haystack that equal the needle under normalization and case folding, also overlapping ones.

    Folding may lengthen a character; a match must begin and end where characters do.
    """
    wanted, source = normalize(needle).casefold(), normalize(haystack)
    if not wanted:
        return []
    folded = [c.casefold() for c in source]
    place = dict(zip(itertools.accumulate(map(len, folded), initial=0), range(len(folded) + 1)))
    joined, found, at = "".join(folded), [], -1
    while (at := joined.find(wanted, at + 1)) >= 0:
        if at in place and at + len(wanted) in place:
            found.append((place[at], place[at + len(wanted)]))
    return found


def text_contains(needle: str, haystack: str) -> bool:
    return bool(text_matches(needle, haystack))


def word_phrase(text: str) -> str:
    """Case-folded words of the normalized text, joined by spaces."""
    return " ".join(WORD.findall(normalize(text).casefold()))


def phrase_spans(phrase: str, text: str, kinds: bool = True) -> list[tuple[int, int]]:
    """Spans of text (already normalized) where the phrase's tokens stand with formatting alone between them.

    kinds: an initialism matches initialisms only (IT isn't It).
    """
    identity = (lambda t: (t.kind, t.value)) if kinds else (lambda t: t.value)
    wanted = [identity(t) for t in metric_tokens(normalize(phrase))]
    tokens = metric_tokens(text)
    found, n = [], len(wanted)
    for i in range(len(tokens) - n + 1) if wanted else ():
        run = tokens[i : i + n]
        if [identity(t) for t in run] == wanted and all(PHRASE_GAP.fullmatch(text, a.end, b.start) for a, b in zip(run, run[1:])):
            found.append((run[0].start, run[-1].end))
    return found


def query_phrases(query: str) -> list[str]:
    """Search phrases of a query: its first tokens; each is later split into index words."""
    return re.findall(r"[\w.$%+-]+", query)[:MOST_QUERY_TOKENS]


class _Bare(dict):
    """Code point to what the index keeps of it: Latin letters lose their diacritics, marks by themselves go, as in FTS5's unicode61."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        parts = unicodedata.normalize("NFD", c)
        self[n] = parts[0] if len(parts) > 1 and "a" <= parts[0] <= "z" else "" if unicodedata.combining(c) else c
        return self[n]


_BARE = _Bare()


def bare(letter: str) -> str:
    return _BARE[ord(letter)]


def index_words(text: str) -> list[str]:
    """Words of the lexical index: runs of letters and digits, lower case, diacritics of Latin letters removed."""
    return WORD.findall(text.lower().translate(_BARE))


def search_signature(query: str, metric: str | None, mode: str, top_k: int, documents: list[str] | None, date_from: str | None, date_to: str | None) -> str:
    """Digest that equal searches share, whatever the order of their words or documents."""
    parts = {
        "query_tokens": sorted(WORD.findall(normalize(query).casefold())), "metric_key": metric_key(metric) if metric else None, "mode": mode, "top_k": top_k,
        "document_ids": sorted(documents) if documents else None, "date_from": date_from, "date_to": date_to,
    }
    return sha256(canonical_json(parts))
