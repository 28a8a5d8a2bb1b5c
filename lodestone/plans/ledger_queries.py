"""Ledgers, recovery, replay and budgets over the driver's star schema and event table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import budgets, ledger
from lodestone.plans.registry import query
from lodestone.plans.tables import table


def _events(spark, sf):
    """Events as ledger rows: a user is a run, numbered by time."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("int")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf, "events").select(F.format_string("run_%032d", "user_id").alias("run_id"), nth.alias("sequence"), F.col("event_type").alias("type"), at.alias("occurred_at"), F.col("props").alias("payload"), "event_id", "user_id", "ts")


@query("hash_chain_verify", "SELECT 'run_' || lpad(CAST(user_id AS VARCHAR), 32, '0') AS run_id, count(*) AS n_events, true AS contiguous, true AS linked, true AS hashed FROM events GROUP BY user_id")
def hash_chain_verify(spark, sf):
    return ledger.chain_checks(ledger.chain(_events(spark, sf)))


@query(
    "hash_chain_tamper",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)
    SELECT 'run_' || lpad(CAST(user_id AS VARCHAR), 32, '0') AS run_id, count(*) AS n_events, true AS contiguous, true AS linked, bool_and(NOT (s = 2 AND user_id % 3 = 0)) AS hashed FROM n GROUP BY user_id""",
)
def hash_chain_tamper(spark, sf):
    changed = F.when((F.col("sequence") == 2) & (F.substring("run_id", 5, 32).cast("decimal(32,0)") % 3 == 0), F.lit('{"forged":1}')).otherwise(F.col("payload"))
    return ledger.chain_checks(ledger.chain(_events(spark, sf)).withColumn("payload", changed))


@query(
    "sequence_gaps",
    """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sequence) AS nth FROM n WHERE event_id % 13 <> 0)
    SELECT 'run_' || lpad(CAST(user_id AS VARCHAR), 32, '0') AS run_id, CAST(min(nth) AS INT) AS first_missing FROM k WHERE sequence <> nth GROUP BY user_id""",
)
def sequence_gaps(spark, sf):
    return ledger.call_gaps(_events(spark, sf).where("event_id % 13 <> 0"))


def _runs(spark, sf):
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("F", "completed", "O", "incomplete", "P", "running")]), F.col("o_orderstatus"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), "o_totalprice")


def _run_events(spark, sf):
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("R", "run.completed", "N", "run.incomplete", "A", "tool.called")]), F.col("l_returnflag"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("sequence")).agg(F.max(kind).alias("type"))


_RUN_SQL = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'incomplete' ELSE 'running' END AS status FROM orders),
ev AS (SELECT l_orderkey AS run_id, l_linenumber AS sequence, max(CASE l_returnflag WHEN 'R' THEN 'run.completed' WHEN 'N' THEN 'run.incomplete' ELSE 'tool.called' END) AS type FROM lineitem GROUP BY ALL)"""


@query(
    "terminal_status_agreement",
    f"""WITH {_RUN_SQL}, last AS (SELECT run_id, max_by(type, sequence) AS last_type FROM ev GROUP BY 1)
    SELECT run_id, status, last_type, coalesce(CASE status WHEN 'completed' THEN last_type = 'run.completed' WHEN 'incomplete' THEN last_type IN ('run.incomplete', 'run.timeout') ELSE true END, false) AS agrees FROM runs LEFT JOIN last USING (run_id)""",
)
def terminal_status_agreement(spark, sf):
    return ledger.terminal_agreement(_runs(spark, sf), _run_events(spark, sf))


@query("event_replay", f"WITH {_RUN_SQL} SELECT run_id, sequence, type FROM ev JOIN runs USING (run_id) WHERE sequence > 2 AND (type = 'tool.called' OR type = 'run.' || status)")
def event_replay(spark, sf):
    return ledger.replayable(_run_events(spark, sf), _runs(spark, sf), after=ledger.cursor_of(2, 5)).select("run_id", "sequence", "type")


@query(
    "recovery_outcome",
    f"""WITH {_RUN_SQL}, r AS (SELECT run_id, run_id % 3 = 0 AS valid, run_id % 3 = 1 AS temporary FROM runs WHERE run_id % 4 <> 0)
    SELECT run_id, CASE WHEN status <> 'running' THEN 'not_pending' WHEN coalesce(valid, false) THEN 'recovered' WHEN coalesce(temporary, false) THEN 'retryable' ELSE 'unrecoverable' END AS outcome,
    CASE WHEN status = 'running' AND coalesce(valid, false) THEN 'completed' WHEN status = 'running' AND NOT coalesce(temporary, false) THEN 'interrupted' ELSE status END AS status FROM runs LEFT JOIN r USING (run_id)""",
)
def recovery_outcome(spark, sf):
    runs = _runs(spark, sf)
    receipts = runs.where("run_id % 4 <> 0").select("run_id", (F.col("run_id") % 3 == 0).alias("valid"), (F.col("run_id") % 3 == 1).alias("temporary"), F.lit("completed").alias("receipt_status"))
    return ledger.recovery(runs.select("run_id", "status"), receipts)


@query("owned_runs", f"WITH {_RUN_SQL} SELECT run_id, status FROM runs WHERE session_id = 100")
def owned_runs(spark, sf):
    return ledger.owned(_runs(spark, sf), 100).select("run_id", "status")


@query(
    "rehearsal_match",
    "WITH a AS (SELECT l_orderkey AS run_id, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS s, string_agg(l_linenumber || CASE WHEN l_orderkey % 5 = 0 THEN 'R' ELSE l_returnflag END, ',' ORDER BY l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN 'R' ELSE l_returnflag END) AS t FROM lineitem GROUP BY 1) SELECT run_id, s = t AS identical FROM a",
)
def rehearsal_match(spark, sf):
    recorded = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("status"))
    derived = recorded.withColumn("status", F.when(F.col("run_id") % 5 == 0, "R").otherwise(F.col("status")))
    return ledger.rehearsal_matches(recorded, derived)


@query(
    "committed_tokens",
    """WITH p AS (SELECT l_orderkey AS run_id, sum(CAST(l_quantity AS BIGINT)) AS actual, sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS recent FROM lineitem GROUP BY 1),
    r AS (SELECT o_orderkey AS run_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS reserved FROM orders WHERE o_orderkey % 7 = 0)
    SELECT CAST(sum(coalesce(recent, 0) + greatest(coalesce(reserved, 0) - coalesce(actual, 0), 0)) AS BIGINT) AS committed, CAST(sum(coalesce(recent, 0)) AS BIGINT) AS used FROM p FULL JOIN r USING (run_id)""",
)
def committed_tokens(spark, sf):
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_shipdate").alias("at"))
    reserved = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("run_id"), F.floor(F.col("o_totalprice") / 1000).alias("reserved"))
    return budgets.committed_tokens(calls, reserved, F.lit("1998-01-01").cast("timestamp_ntz"))


@query("orphan_release", f"WITH {_RUN_SQL} SELECT o_orderkey AS run_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS reserved FROM orders WHERE o_orderkey % 7 = 0 AND NOT EXISTS (SELECT 1 FROM runs WHERE run_id = o_orderkey AND status IN ('queued', 'running'))")
def orphan_release(spark, sf):
    reserved = table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("run_id"), F.floor(F.col("o_totalprice") / 1000).alias("reserved"))
    return budgets.orphans(reserved, _runs(spark, sf))


@query("retention_cascade", "SELECT l_returnflag, count(*) AS kept, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01') GROUP BY 1")
def retention_cascade(spark, sf):
    children = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    _, (kept,) = budgets.retained(_runs(spark, sf), [children], F.lit("1995-01-01").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("kept"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query(
    "concurrency_peak",
    """WITH s AS (SELECT o_custkey AS key, o_orderdate AS a, o_orderdate + INTERVAL 60 DAY AS b FROM orders), e AS (SELECT key, a AS t, 1 AS step FROM s UNION ALL SELECT key, b, -1 FROM s),
    o AS (SELECT key, sum(step) OVER (PARTITION BY key ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT key, CAST(max(n) AS BIGINT) AS peak, max(n) > 5 AS "over" FROM o GROUP BY key""",
)
def concurrency_peak(spark, sf):
    return budgets.concurrency_peaks(table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("end")))


@query("admission_replay")
def admission_replay(spark, sf):
    attempts = table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), F.col("user_id").cast("string").alias("session_id"), (F.col("user_id") % 37).cast("string").alias("address"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return budgets.admissions(attempts, per_session=20, per_address=60, window=86400)


@query("reservation_replay")
def reservation_replay(spark, sf):
    """A user is a budget; its events are steps of three runs in turn."""
    op = F.element_at(F.array(*map(F.lit, ("reserve", "expand", "spend", "release"))), (F.col("event_id") % 4 + 1).cast("int"))
    steps = table(spark, sf, "events").select(F.col("user_id").alias("budget"), F.col("event_id").alias("step_id"), op.alias("op"), (F.col("event_id") % 3).cast("string").alias("run_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_id") % 500).alias("tokens"))
    return budgets.reservations(steps, 600, 2000)


@query(
    "opened_budget",
    """WITH f AS (SELECT user_id, event_id, event_type || (event_id % 11) AS item, CAST(event_id % 500 AS BIGINT) AS tokens FROM events), g AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, item ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS new FROM f)
    SELECT user_id AS run_id, event_id AS sequence, CAST(sum(new) OVER w AS BIGINT) AS items, CAST(sum(new * tokens) OVER w AS BIGINT) AS tokens FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id RANGE UNBOUNDED PRECEDING)""",
)
def opened_budget(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), F.concat("event_type", (F.col("event_id") % 11).cast("string")).alias("item"), (F.col("event_id") % 500).alias("tokens"))
    return budgets.opened_budget(log)


@query("tool_budgets")
def tool_budgets(spark, sf):
    log = _events(spark, sf).select(
        "run_id", "sequence", F.element_at(F.array(*map(F.lit, ("search", "read", "inspect", "verify"))), (F.col("event_id") % 4 + 1).cast("int")).alias("tool"), F.concat("type", (F.col("event_id") % 3).cast("string")).alias("signature"),
        F.array(F.concat(F.lit("chk_"), (F.col("event_id") % 60).cast("string"))).alias("chunk_ids"), F.array((F.col("event_id") % 60 * 50).cast("int")).alias("chunk_tokens"), (F.col("event_id") % 4).cast("int").alias("pages"), F.lit(5000).alias("characters"),
    )
    return budgets.tool_outcomes(log)


@query("unique_signatures", "SELECT user_id, count(DISTINCT event_type || '|' || (event_id % 5)) AS signatures FROM events GROUP BY 1")
def unique_signatures(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct(F.concat_ws("|", "event_type", (F.col("event_id") % 5).cast("string"))).alias("signatures"))


@query("token_ceiling", "SELECT conv_id, turn, CAST(strlen(text) + strlen(role) + 20000 AS BIGINT) AS ceiling FROM conversations")
def token_ceiling(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", budgets.token_ceiling(F.col("text"), F.col("role")).cast("long").alias("ceiling"))


@query("token_usage_by_window", "SELECT user_id, date_trunc('hour', ts) AS start, sum(CAST(event_id % 100 AS BIGINT)) AS tokens FROM events GROUP BY ALL")
def token_usage_by_window(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.sum(F.col("event_id") % 100).alias("tokens")).select("user_id", F.col("w.start").alias("start"), "tokens")


@query("stream_event_replay", f"WITH {_RUN_SQL} SELECT run_id, sequence, type FROM ev JOIN runs USING (run_id) WHERE type = 'tool.called' OR type = 'run.' || status")
def stream_event_replay(spark, sf):
    """The same replay as a stream that drains what is there: events are written once, then read as a file stream."""
    from lodestone.streaming import events as streams
    from lodestone.streaming.places import scratch

    base = scratch(spark, "replay")
    source = _run_events(spark, sf)
    source.write.parquet(f"{base}/in")
    replayed = streams.replay_stream(streams.event_stream(spark, f"{base}/in", source.schema), _runs(spark, sf))
    streams.drain(replayed.select("run_id", "sequence", "type"), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("run_id long, sequence int, type string").parquet(f"{base}/out")


@query("stream_admission")
def stream_admission(spark, sf):
    from lodestone.streaming import events as streams
    from lodestone.streaming.places import scratch

    base = scratch(spark, "admission")
    source = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("attempt_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    source.write.parquet(f"{base}/in")
    admitted = streams.admission_stream(streams.event_stream(spark, f"{base}/in", source.schema), per_session=5, window=86400)
    streams.drain(admitted, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema("session_id string, attempt_id long, admitted boolean").parquet(f"{base}/out")
