"""Hash-chained event ledgers, sealed receipts, recovery and replay."""

from __future__ import annotations

import html
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.lazy import arrow_function
from lodestone.operators.verification import AUTHORITATIVE

GENESIS = "0" * 64
# The terminal events that agree with a run's status.
TERMINAL = {"completed": ["run.completed"], "incomplete": ["run.incomplete", "run.timeout"], "cancelled": ["run.cancelled"], "failed": ["run.failed"], "interrupted": ["run.interrupted"]}
RECEIPT_FIELDS = {"schema_version": str, "run_id": str, "status": str, "question": str, "corpus_version": str, "claims": list, "events": list, "openai_calls": list, "provenance": dict, "receipt_sha256": str}


def event_body(run_id: str, sequence: int, kind: str, occurred_at: str, payload, previous: str) -> str:
    return T.canonical_json({"run_id": run_id, "sequence": sequence, "type": kind, "occurred_at": occurred_at, "payload": payload, "previous_hash": previous})


def event_hash(run_id: str, sequence: int, kind: str, occurred_at: str, payload, previous: str) -> str:
    return T.sha256(previous + event_body(run_id, sequence, kind, occurred_at, payload, previous))


def chain(events: DataFrame) -> DataFrame:
    """Append order to a hash chain: run_id, sequence, type, occurred_at, payload (JSON) with previous_hash and event_hash.

    A chain is sequential within a run, so a run is one group; runs are independent.
    """
    schema = "run_id string, sequence int, type string, occurred_at string, payload string, previous_hash string, event_hash string"

    def build(run: pd.DataFrame) -> pd.DataFrame:
        run, previous, rows = run.sort_values("sequence"), GENESIS, []
        for r in run.itertuples(index=False):
            now = event_hash(r.run_id, int(r.sequence), r.type, r.occurred_at, json.loads(r.payload), previous)
            rows.append((r.run_id, r.sequence, r.type, r.occurred_at, r.payload, previous, now))
            previous = now
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return events.groupBy("run_id").applyInPandas(build, schema)


@arrow_function("string")
def _rehash(run_id: pd.Series, sequence: pd.Series, kind: pd.Series, at: pd.Series, payload: pd.Series, previous: pd.Series) -> pd.Series:
    return pd.Series([event_hash(r, int(s), k, o, json.loads(p), h) for r, s, k, o, p, h in zip(run_id, sequence, kind, at, payload, previous)])


def chain_checks(events: DataFrame) -> DataFrame:
    """run_id, n_events, contiguous, linked and hashed of each run. Verification is row by row behind one window."""
    order = Window.partitionBy("run_id").orderBy("sequence")
    rows = events.withColumns({"nth": F.row_number().over(order), "before": F.coalesce(F.lag("event_hash").over(order), F.lit(GENESIS))})
    rows = rows.withColumn("again", _rehash("run_id", "sequence", "type", "occurred_at", "payload", "previous_hash"))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("n_events"), F.bool_and(F.col("sequence") == F.col("nth")).alias("contiguous"), F.bool_and(F.col("previous_hash") == F.col("before")).alias("linked"), F.bool_and(F.col("event_hash") == F.col("again")).alias("hashed")
    )


def chain_heads(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.max_by("event_hash", "sequence").alias("head"), F.max("sequence").alias("last_sequence"))


def terminal_agreement(runs: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, status, last_type and whether a run's last event agrees with its status (a live run needs none)."""
    last = events.groupBy("run_id").agg(F.max_by("type", "sequence").alias("last_type"))
    wanted = F.create_map(*[x for k, v in TERMINAL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    agrees = F.coalesce(F.array_contains(F.element_at(wanted, F.col("status")), F.col("last_type")), ~F.col("status").isin(*TERMINAL))
    return runs.select("run_id", "status").join(last, "run_id", "left").select("run_id", "status", "last_type", F.coalesce(agrees, F.lit(False)).alias("agrees"))


def seal(receipt: dict) -> dict:
    """The receipt with the digest of its canonical content."""
    unsigned = {k: v for k, v in receipt.items() if k != "receipt_sha256"}
    return unsigned | {"receipt_sha256": T.sha256(T.canonical_json(unsigned))}


def receipt_errors(receipt, trusted: dict[tuple[str, str], str] | None = None) -> list[str]:
    """What is wrong with a decoded receipt; any JSON value is accepted as input."""
    if not isinstance(receipt, dict):
        return ["root: not an object"]
    if receipt.get("schema_version") not in ("1.4", "1.2"):
        return ["schema_version: unsupported"]
    errors = [f"{k}: missing or not of its type" for k, kind in RECEIPT_FIELDS.items() if not isinstance(receipt.get(k), kind)]
    if receipt.get("receipt_sha256") != seal(receipt)["receipt_sha256"]:
        errors.append("receipt_sha256: differs from the content's digest")
    events = receipt.get("events")
    if not isinstance(events, list):
        return errors
    previous = GENESIS
    for n, e in enumerate(events, 1):
        if not isinstance(e, dict):
            problem = "not an object"
        elif e.get("sequence") != n:
            problem = "sequence has a gap"
        elif e.get("previous_hash") != previous:
            problem = "previous hash is broken"
        elif e.get("event_hash") != event_hash(receipt.get("run_id"), n, e.get("type"), e.get("occurred_at"), e.get("payload", {}), previous):
            problem = "hash differs from the content"
        else:
            previous = e["event_hash"]
            continue
        errors.append(f"events.{n}: {problem}")
        break
    provenance = receipt.get("provenance") if isinstance(receipt.get("provenance"), dict) else {}
    if provenance.get("event_chain_head") != previous:
        errors.append("provenance.event_chain_head: not the last event's hash")
    source = (provenance.get("source_receipt_sha256"), provenance.get("source_verifier_version"))
    if provenance.get("receipt_derivation") == "contract_migration" and (trusted or {}).get(source) != receipt.get("receipt_sha256"):
        errors.append("provenance: the migration isn't registered")
    if provenance.get("receipt_derivation") == "live" and any(source):
        errors.append("provenance: a live receipt has no source")
    calls = receipt.get("openai_calls")
    if isinstance(calls, list) and [c.get("sequence") if isinstance(c, dict) else None for c in calls] != list(range(1, len(calls) + 1)):
        errors.append("openai_calls: sequence has a gap")
    last, status = events[-1] if events else None, receipt.get("status")
    if isinstance(status, str) and status in TERMINAL and not (isinstance(last, dict) and last.get("type") in TERMINAL[status]):
        errors.append("status: disagrees with the last event")
    claims = receipt.get("claims") if isinstance(receipt.get("claims"), list) else []
    if status == "completed":
        answer = receipt.get("answer")
        if not isinstance(answer, str) or not answer.strip():
            errors.append("answer: a completed receipt needs one")
        if not claims:
            errors.append("claims: a completed receipt needs one")
        elif receipt["schema_version"] == "1.4" and any(not isinstance(c, dict) or c.get("status") not in AUTHORITATIVE for c in claims):
            errors.append("claims: a completed receipt has authoritative ones only")
    for item in (i for c in claims if isinstance(c, dict) and isinstance(c.get("evidence"), list) for i in c["evidence"] if isinstance(i, dict)):
        if not item.get("chunk_sha256"):
            errors.append("evidence: no chunk digest")
        if receipt["schema_version"] == "1.4" and f"/api/corpora/{receipt.get('corpus_version')}/" not in str(item.get("source_url", "")):
            errors.append("evidence: source URL isn't of the corpus version")
    return errors


@arrow_function("array<string>")
def receipt_errors_udf(receipts: pd.Series) -> pd.Series:
    def check(text):
        try:
            return receipt_errors(json.loads(text))
        except (TypeError, ValueError):
            return ["root: not JSON"]

    return pd.Series([check(t) for t in receipts], dtype="object")


def receipt_html(receipt: dict) -> str:
    """A receipt as a page: every value is escaped, the heading follows from the status."""
    heading = "Verified answer" if receipt.get("status") == "completed" else f"Run {receipt.get('status', 'unknown')}"
    claims = "".join(f"<li><b>{html.escape(str(c.get('status')))}</b> {html.escape(str(c.get('statement')))}</li>" for c in receipt.get("claims", []))
    return f"<!doctype html><title>{html.escape(heading)}</title><h1>{html.escape(heading)}</h1><p>{html.escape(str(receipt.get('question', '')))}</p><p>{html.escape(str(receipt.get('answer') or ''))}</p><ul>{claims}</ul><code>{html.escape(str(receipt.get('receipt_sha256')))}</code>"


def publish_receipt(receipt: dict, folder: str | Path) -> Path:
    """Write a sealed, valid receipt once; an existing one is never overwritten."""
    from lodestone.sources.corpus import atomic_write

    sealed = seal(receipt)
    if errors := receipt_errors(sealed):
        raise ValueError("; ".join(errors))
    path = Path(folder) / f"{sealed['run_id']}.json"
    if path.exists():
        raise FileExistsError(path)
    atomic_write(path, json.dumps(sealed, ensure_ascii=False, indent=2))
    return path


def without_empty_references(legacy: DataFrame) -> DataFrame:
    """Claims of the older schema as the current one: references without a chunk go, and each observation gets a kind by its unit."""
    kind = F.when(F.col("value_text").rlike(r"(?i)(basis\s+points?|bps|percent|%)"), "reported_rate").when(F.col("value_text").rlike(r"(?i)per\s+share"), "reported_per_share").otherwise("reported_level")
    return legacy.withColumn("kind", kind).withColumn("evidence", F.filter("evidence", lambda e: F.coalesce(e["chunk_id"], F.lit("")) != ""))


def recovery(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """run_id, outcome and status of each run after a restart. receipts: run_id, valid, receipt_status, temporary (a fault that may pass).

    Live runs with a valid receipt take its status; without one they become interrupted.
    """
    rows = runs.join(receipts, "run_id", "left")
    pending = F.col("status").isin("queued", "running", "interrupted")
    valid = F.coalesce("valid", F.lit(False))
    outcome = F.when(~pending, "not_pending").when(valid, "recovered").when(F.coalesce("temporary", F.lit(False)), "retryable").otherwise("unrecoverable")
    status = F.when(pending & valid, F.col("receipt_status")).when(pending & ~F.coalesce("temporary", F.lit(False)), "interrupted").otherwise(F.col("status"))
    return rows.select("run_id", outcome.alias("outcome"), status.alias("status"))


def cursor_of(query: int | None, header: int | None) -> int:
    """Where a replay starts: the query's cursor, even 0, goes before the header's."""
    return query if query is not None else header if header is not None else 0


def replayable(events: DataFrame, runs: DataFrame, after: int = 0) -> DataFrame:
    """Events past the cursor that a reader may see: a terminal event only if the run's stored status agrees with it."""
    terminal = [t for ts in TERMINAL.values() for t in ts]
    wanted = F.create_map(*[x for k, v in TERMINAL.items() for t in v for x in (F.lit(t), F.lit(k))])
    rows = events.where(F.col("sequence") > after).join(runs.select("run_id", "status"), "run_id")
    return rows.where(~F.col("type").isin(terminal) | F.coalesce(F.element_at(wanted, F.col("type")) == F.col("status"), F.lit(False)))


def rehearsal_matches(recorded: DataFrame, derived: DataFrame) -> DataFrame:
    """run_id and whether the derived claim statuses are those recorded, in order. Both: run_id, ordinal, status."""
    listed = lambda df, name: df.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "status"))).alias(name))
    both = listed(recorded, "a").join(listed(derived, "b"), "run_id", "full_outer")
    return both.select("run_id", F.coalesce(F.col("a.status") == F.col("b.status"), F.lit(False)).alias("identical"))


def owned(runs: DataFrame, session_id: str) -> DataFrame:
    """A session's own runs; others don't exist for it."""
    return runs.where(F.col("session_id") == session_id)


def call_gaps(calls: DataFrame) -> DataFrame:
    """run_id and first missing sequence of logs that don't run 1, 2, 3, ..."""
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("sequence"))
    return calls.withColumn("nth", nth).where("sequence <> nth").groupBy("run_id").agg(F.min("nth").alias("first_missing"))


def envelopes(runs: DataFrame, legacy: DataFrame) -> DataFrame:
    """run_id, kind and body of each run's stored outcome: its result, else its adapted legacy result, else an empty envelope from its row."""
    rows = runs.join(legacy.select("run_id", "adapted_json"), "run_id", "left")
    empty = F.to_json(F.struct("run_id", "status", "question", F.array().cast("array<string>").alias("claims")))
    kind = F.when(F.col("result_json").isNotNull(), "stored").when(F.col("adapted_json").isNotNull(), "adapted").otherwise("empty")
    return rows.select("run_id", kind.alias("kind"), F.coalesce("result_json", "adapted_json", empty).alias("body"))
