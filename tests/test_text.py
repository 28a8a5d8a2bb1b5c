import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone.functions import text as T
from lodestone.functions.arrow import client_address


def test_normalization():
    raw = "fee-earn-\ning   assets\tunder management"
    assert T.normalize(raw) == "fee-earning assets under management"
    assert T.normalize_operations(raw) == ["pdf_linebreak_dehyphenation", "whitespace_folding"]
    assert T.normalize_operations("ﬁne") == ["unicode_nfkc"]


@given(st.text(max_size=60))
def test_normalization_is_stable(raw):
    once = T.normalize(raw)
    assert T.normalize(once) == once or T.HYPHENATED_BREAK.search(once) is None
    assert once == once.strip() and not re.search(r"\s\s", once)


def test_matches_are_whole_characters():
    assert T.text_matches("STRASSE", "Straße") == [(0, 6)]
    assert T.text_matches("s", "ß") == []
    assert T.text_matches("aa", "aaa") == [(0, 2), (1, 3)]
    assert T.text_matches("", "a") == []


@pytest.mark.parametrize(
    ("raw", "key"), [("Fee-earn-\ning AUM_2026", "fee earning AUM 2026"), ("US revenue", "US revenue"), ("U.S. revenue", "US revenue"), ("us revenue", "us revenue"), ("REVENUE", "revenue")]
)
def test_metric_keys(raw, key):
    assert T.metric_key(raw) == key


def test_phrase_variants():
    assert set(T.phrase_variants("U.S. revenue")) == {"us revenue", "u s revenue"}
    assert T.phrase_variants("It") == ["it"] and set(T.phrase_variants("IT")) == {"it", "i t"}
    assert T.phrase_variants("US " * 7) is None and T.phrase_variants("--") == []


def test_phrases_keep_kinds_and_gaps():
    assert T.phrase_spans("IT", "It was") == [] and T.phrase_spans("IT", "I.T. was") == [(0, 4)]
    assert T.phrase_spans("IT", "It was", kinds=False) == [(0, 2)]
    assert T.phrase_spans("AUM 2026", "AUM_2026") == []
    assert T.phrase_spans("fee related", "Fee-related earnings") == [(0, 11)]


def test_sentences():
    assert T.sentences("One was. Two were? Three.") == ["One was.", " Two were?", " Three."]
    assert T.sentences("In the U.S. market it grew. Then") == ["In the U.S. market it grew.", " Then"]
    assert T.sentences("Mr. Smith left 3.5 behind") == ["Mr. Smith left 3.5 behind"]
    assert T.sentences("no mark") == ["no mark"]


def test_estimates_and_queries():
    assert T.estimate_tokens("") == 1 and T.estimate_tokens("a b c") == 4
    assert T.query_phrases('"US" revenue $2') == ["US", "revenue", "$2"]
    assert T.index_words("Café fee-related_x") == ["cafe", "fee", "related", "x"]
    assert T.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_search_signatures_ignore_order():
    one = T.search_signature("a b", "Revenue", "lexical", 8, ["x", "y"], None, None)
    assert one == T.search_signature("B a", "revenue", "lexical", 8, ["y", "x"], None, None)
    assert one != T.search_signature("B a", "revenue", "lexical", 9, ["y", "x"], None, None)


def test_client_addresses():
    assert client_address("10.0.0.1", "1.2.3.4", ["10.0.0.0/8"]) == "1.2.3.4"
    assert client_address("11.0.0.1", "1.2.3.4", ["10.0.0.0/8"]) == "11.0.0.1"
    assert client_address("10.0.0.1", "nonsense", ["10.0.0.0/8"]) == "10.0.0.1"
    assert client_address(None, None, []) == "unknown" and client_address("testclient", None, []) == "testclient"
