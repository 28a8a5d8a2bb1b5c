import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import budgets, ledger

EVENTS = "run_id string, sequence int, type string, occurred_at string, payload string"


def _receipt(status="completed", kind="run.completed"):
    body = [("run.started", {"x": 1}), (kind, {})]
    events, previous = [], ledger.GENESIS
    for n, (t, payload) in enumerate(body, 1):
        now = ledger.event_hash("run_1", n, t, "2025", payload, previous)
        events.append({"sequence": n, "type": t, "occurred_at": "2025", "payload": payload, "previous_hash": previous, "event_hash": now})
        previous = now
    claim = {"status": "verified", "statement": "a < b", "evidence": [{"chunk_sha256": "1", "source_url": "/api/corpora/v_1/documents/d"}]}
    return ledger.seal({"schema_version": "1.4", "run_id": "run_1", "status": status, "question": "q", "answer": "a", "corpus_version": "v_1", "claims": [claim], "events": events, "openai_calls": [{"sequence": 1}], "provenance": {"event_chain_head": previous}})


def test_valid_and_tampered_receipts(tmp_path):
    good = _receipt()
    assert ledger.receipt_errors(good) == []
    assert ledger.receipt_errors(good | {"answer": "other"}) and ledger.receipt_errors(ledger.seal(good | {"answer": " "}))
    assert ledger.receipt_errors(_receipt("failed")) == ["status: disagrees with the last event"]
    broken = json.loads(json.dumps(good))
    broken["events"][0]["payload"] = {"x": 2}
    assert any("events.1" in e for e in ledger.receipt_errors(ledger.seal(broken)))
    assert ledger.receipt_errors(ledger.seal(good | {"claims": [{"status": "unverified"}]})) == ["claims: a completed receipt has authoritative ones only"]
    path = ledger.publish_receipt(good, tmp_path)
    assert json.loads(path.read_text()) == good
    with pytest.raises(FileExistsError):
        ledger.publish_receipt(good, tmp_path)
    assert "a &lt; b" in ledger.receipt_html(good) and "<h1>Run failed" in ledger.receipt_html(_receipt("failed"))


@settings(max_examples=100)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["schema_version", "events", "claims", "status", "provenance", "openai_calls", "evidence", "sequence"]), x, max_size=4), max_leaves=12))
def test_validation_takes_any_json(value):
    for receipt in (value, {"schema_version": "1.4", "events": value, "claims": value, "status": value, "provenance": value}):
        assert isinstance(ledger.receipt_errors(receipt), list)


def test_chains_verify_in_parallel(spark):
    rows = spark.createDataFrame([("a", 2, "y", "t", "{}"), ("a", 1, "x", "t", '{"k":"é"}'), ("b", 1, "x", "t", "{}")], EVENTS)
    chained = ledger.chain(rows)
    assert all(r.contiguous and r.linked and r.hashed for r in ledger.chain_checks(chained).collect())
    cut = {r.run_id: r for r in ledger.chain_checks(chained.where("NOT (run_id = 'a' AND sequence = 1)")).collect()}
    assert not cut["a"].linked and not cut["a"].contiguous and cut["a"].hashed
    assert {r.run_id: r.last_sequence for r in ledger.chain_heads(chained).collect()} == {"a": 2, "b": 1}


def test_cursors():
    assert ledger.cursor_of(0, 9) == 0 and ledger.cursor_of(None, 9) == 9 and ledger.cursor_of(None, None) == 0


def test_denied_attempts_leave_no_trace(spark):
    w = budgets.Windows(2, 3, 10)
    assert [w.admit("s", "a", t) for t in (0, 1, 2, 9, 10, 11)] == [None, None, "session", "session", "session", None]
    assert w.admit("other", "a", 11) is None and w.admit("third", "a", 11) == "address"
    rows = [(i, "s", "a", float(i)) for i in range(30)]
    got = budgets.admissions(spark.createDataFrame(rows, "attempt_id long, session_id string, address string, at double"), 20, 60, 3600)
    assert [r.admitted for r in got.orderBy("attempt_id").collect()] == [True] * 20 + [False] * 10


def test_reservations():
    step = lambda op, run, tokens, at=0: {"op": op, "run": run, "tokens": tokens, "at": at}
    assert budgets.reservation_replay([step("reserve", "a", 100), step("spend", "a", 60), step("reserve", "b", 10)], 110, 110) == ["admitted", "spent", "admitted"]
    late = [step("reserve", "a", 100), step("spend", "a", 60), step("reserve", "b", 60, 4000), step("reserve", "c", 1, 4000)]
    assert budgets.reservation_replay(late, 100, 10_000) == ["admitted", "spent", "admitted", "hourly"]
    grows = [step("expand", "a", 5), step("reserve", "a", 50), step("reserve", "a", 1), step("spend", "a", 30), step("expand", "a", 20), step("expand", "a", 40), step("expand", "a", 71), step("spend", "a", 90), step("release", "a", 0), step("reserve", "b", 1), step("reserve", "b", 1, 3601)]
    assert budgets.reservation_replay(grows, 100, 10_000) == ["no_reservation", "admitted", "already_reserved", "spent", "admitted", "admitted", "hourly", "spent", "released", "hourly", "admitted"]


def test_reservations_of_budgets(spark):
    rows = [("x", 1, "reserve", "a", 0.0, 60), ("y", 2, "reserve", "a", 0.0, 60), ("x", 3, "reserve", "b", 1.0, 60), ("y", 4, "release", "a", 1.0, None), ("y", 5, "reserve", "b", 2.0, 60)]
    steps = spark.createDataFrame(rows, "budget string, step_id long, op string, run_id string, at double, tokens long").repartition(3)
    assert {tuple(r) for r in budgets.reservations(steps, 100, 100).collect()} == {(1, "admitted"), (2, "admitted"), (3, "hourly"), (4, "released"), (5, "admitted")}
    assert budgets.reservations(steps.where("false")).count() == 0


def test_tool_budgets(spark):
    log = pd.DataFrame([("r", n, "search", f"s{n}", [], [], 0, 0) for n in range(1, 6)] + [("r", 6, "search", "s1", [], [], 0, 0), ("r", 7, "read", "", [f"c{i}" for i in range(51)], [1] * 51, 0, 0), ("r", 8, "inspect", "", [], [], 4, 1)], columns=["run_id", "sequence", "tool", "signature", "chunk_ids", "chunk_tokens", "pages", "characters"])
    got = budgets.tool_outcomes(spark.createDataFrame(log, "run_id string, sequence int, tool string, signature string, chunk_ids array<string>, chunk_tokens array<int>, pages int, characters int"))
    assert [r.outcome for r in got.orderBy("sequence").collect()] == ["ok"] * 4 + ["searches", "ok", "chunks", "inspection"]


def test_envelopes(spark):
    runs = spark.createDataFrame([("a", "completed", "q", "{}"), ("b", "completed", "q", None), ("c", "failed", "q", None)], "run_id string, status string, question string, result_json string")
    legacy = spark.createDataFrame([("b", '{"old":1}')], "run_id string, adapted_json string")
    assert {r.run_id: r.kind for r in ledger.envelopes(runs, legacy).collect()} == {"a": "stored", "b": "adapted", "c": "empty"}


def test_a_session_on_many_addresses_keeps_its_limit(spark):
    rows = [(i, "s", f"a{i % 5}", float(i)) for i in range(25)] + [(100 + i, f"t{i % 3}", "b", float(i)) for i in range(9)] + [(200, "t0", "c", 50.0)]
    attempts = spark.createDataFrame(rows, "attempt_id long, session_id string, address string, at double").repartition(3)
    got = budgets.admissions(attempts, 20, 8, 3600).collect()
    assert sorted(r.attempt_id for r in got if not r.admitted) == [20, 21, 22, 23, 24, 108] and len(got) == 35
    groups = {r.session_id: r.group for r in budgets.linked_groups(attempts).collect()}
    assert groups == {"s": "a0", "t0": "b", "t1": "b", "t2": "b"}
