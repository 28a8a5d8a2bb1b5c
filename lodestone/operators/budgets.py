"""Usage budgets: admission windows, token reservations, retention, tool budgets, concurrency."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.streaming.places import scratch

#: Limits of a run and of its windows.
PER_SESSION, PER_ADDRESS, WINDOW_S = 20, 60, 3600
TOKENS_HOUR, TOKENS_DAY, CONCURRENT = 1_000_000, 5_000_000, 5
CALLS, SEARCHES, CHUNKS, TOKENS, INSPECTIONS, PAGES, CHARACTERS = 12, 4, 50, 50_000, 2, 3, 24_000
OUTPUT_CEILING, REPLY_CEILING = 12_000, 8_000


class Windows:
    """Admissions of the trailing window by key. A denied attempt leaves no trace."""

    def __init__(self, per_session: int = PER_SESSION, per_address: int = PER_ADDRESS, window: float = WINDOW_S):
        self.limits, self.window, self.kept = (per_session, per_address), window, {}

    def admit(self, session: str, address: str, at: float) -> str | None:
        """None where admitted, else the window that is full. An admission exactly one window old still counts."""
        queues = []
        for key, limit, name in ((("s", session), self.limits[0], "session"), (("a", address), self.limits[1], "address")):
            q = self.kept.setdefault(key, deque())
            while q and q[0] < at - self.window:
                q.popleft()
            if len(q) >= limit:
                return name
            queues.append(q)
        for q in queues:
            q.append(at)
        return None


def linked_groups(attempts: DataFrame) -> DataFrame:
    """session_id and group (the least address reachable) of every session: sessions and addresses that share attempts, closed over chains.

    Least addresses travel between sessions and addresses until nothing changes; each round is written to the shared
    folder, so a lost executor costs one round.
    """
    spark = attempts.sparkSession
    edges = attempts.select("session_id", "address").distinct()
    now, before = edges.withColumn("label", F.col("address")), None
    while True:
        by_session = edges.join(now.groupBy("session_id").agg(F.min("label").alias("label")), "session_id")
        by_address = by_session.groupBy("address").agg(F.min("label").alias("label"))
        path = scratch(spark, "admission-groups")
        edges.join(by_address, "address").write.parquet(path)
        now = spark.read.parquet(path)
        state = now.agg(F.sum(F.xxhash64("session_id", "address", "label").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return now.groupBy("session_id").agg(F.min("label").alias("group"))
        before = state


def admissions(attempts: DataFrame, per_session: int = PER_SESSION, per_address: int = PER_ADDRESS, window: float = WINDOW_S, group: Column | None = None) -> DataFrame:
    """Replay of attempts (attempt_id, session_id, address, at in seconds) in time order: attempt_id, admitted, reason.

    Windows of sessions and addresses depend on each other where they share attempts, so attempts are split into groups
    that never share a session or an address: linked_groups, or the given `group` where the caller knows them. No
    session and no address is null.
    """
    if group is None:
        rows = attempts.join(linked_groups(attempts).withColumnRenamed("group", "__group"), "session_id")
    else:
        rows = attempts.withColumn("__group", group)

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        state = Windows(per_session, per_address, window)
        part = part.sort_values(["at", "attempt_id"])
        reasons = [state.admit(s, a, t) for s, a, t in zip(part.session_id, part.address, part["at"])]
        return pd.DataFrame({"attempt_id": part.attempt_id, "admitted": [r is None for r in reasons], "reason": pd.Series(reasons, index=part.index, dtype="object")})

    return rows.groupBy("__group").applyInPandas(replay, "attempt_id long, admitted boolean, reason string")


class Reservations:
    """Token reservations of one budget, replayed in order. Committed tokens of a window are the spending in it plus what
    reservations hold beyond all that their run has spent; both are kept as running sums."""

    def __init__(self, hourly: int = TOKENS_HOUR, daily: int = TOKENS_DAY):
        self.windows = [("hourly", hourly, 3600.0, deque()), ("daily", daily, 86400.0, deque())]
        self.recent, self.held, self.spent, self.open = [0, 0], {}, {}, 0

    def _full(self, more: int, at: float) -> str | None:
        for i, (_, _, window, calls) in enumerate(self.windows):
            while calls and calls[0][0] < at - window:
                self.recent[i] -= calls.popleft()[1]
        return next((name for i, (name, limit, _, _) in enumerate(self.windows) if self.recent[i] + self.open + more > limit), None)

    def _hold(self, run: str, tokens: int | None) -> None:
        beyond = lambda: max(self.held.get(run, 0) - self.spent.get(run, 0), 0)
        self.open -= beyond()
        self.held.pop(run, None) if tokens is None else self.held.__setitem__(run, tokens)
        self.open += beyond()

    def step(self, op: str, run: str, at: float, tokens: int) -> str:
        """reserve: hold tokens for a run, once. expand: hold at least what is spent and tokens more, before a call.
        spend: a call's tokens; the hold is at least all that is spent. release: hold nothing."""
        if op == "reserve":
            if run in self.held:
                return "already_reserved"
            if (full := self._full(tokens, at)) is None:
                self._hold(run, tokens)
            return full or "admitted"
        if op == "expand":
            if run not in self.held:
                return "no_reservation"
            needed = self.spent.get(run, 0) + tokens
            if needed <= self.held[run]:
                return "admitted"
            if (full := self._full(needed - self.held[run], at)) is None:
                self._hold(run, needed)
            return full or "admitted"
        if op == "spend":
            held = self.held.get(run)
            self._hold(run, None)
            self.spent[run] = self.spent.get(run, 0) + tokens
            for i, (_, _, _, calls) in enumerate(self.windows):
                calls.append((at, tokens))
                self.recent[i] += tokens
            if held is not None:
                self._hold(run, max(held, self.spent[run]))
            return "spent"
        self._hold(run, None)
        return "released"


def reservation_replay(requests: list[dict], hourly: int, daily: int) -> list[str]:
    """Outcomes of ordered steps of one budget: op (reserve, expand, spend, release), run, at in seconds, tokens."""
    state = Reservations(hourly, daily)
    return [state.step(s["op"], s["run"], s["at"], s.get("tokens") or 0) for s in requests]


def reservations(steps: DataFrame, hourly: int = TOKENS_HOUR, daily: int = TOKENS_DAY) -> DataFrame:
    """step_id and outcome of every step (budget, step_id, op, run_id, at in seconds, tokens), by time, then step_id.

    Every outcome depends on all earlier steps of its budget, so one budget's steps are one ordered task; budgets run
    beside each other. Null tokens are none.
    """
    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "step_id"])
        state = Reservations(hourly, daily)
        return pd.DataFrame({"step_id": part.step_id, "outcome": [state.step(o, r, t, int(n)) for o, r, t, n in zip(part.op, part.run_id, part["at"], part.tokens.fillna(0))]})

    return steps.select("budget", "step_id", "op", "run_id", "at", "tokens").groupBy("budget").applyInPandas(replay, "step_id long, outcome string")


def committed_tokens(calls: DataFrame, reservations: DataFrame, since: Column) -> DataFrame:
    """One row: tokens committed since a moment. calls: run_id, tokens, at; reservations: run_id, reserved."""
    per_run = calls.groupBy("run_id").agg(F.sum("tokens").alias("actual"), F.sum(F.when(F.col("at") >= since, F.col("tokens")).otherwise(0)).alias("recent"))
    both = per_run.join(reservations.groupBy("run_id").agg(F.max("reserved").alias("reserved")), "run_id", "full_outer")
    held = F.greatest(F.coalesce("reserved", F.lit(0)) - F.coalesce("actual", F.lit(0)), F.lit(0))
    return both.agg(F.sum(F.coalesce("recent", F.lit(0)) + held).alias("committed"), F.sum(F.coalesce("recent", F.lit(0))).alias("used"))


def orphans(reservations: DataFrame, runs: DataFrame) -> DataFrame:
    """Reservations whose run isn't live any more."""
    return reservations.join(runs.where(F.col("status").isin("queued", "running")), "run_id", "left_anti")


def retained(parents: DataFrame, children: list[DataFrame], cutoff: Column, key: str = "run_id", at: str = "created_at") -> tuple[DataFrame, list[DataFrame]]:
    """Rows that stay when parents older than the cutoff go, with the children of what goes."""
    gone = parents.where(F.col(at) < cutoff).select(key)
    return parents.where(F.col(at) >= cutoff), [c.join(gone, key, "left_anti") for c in children]


def concurrency_peaks(spans: DataFrame, most: int = CONCURRENT) -> DataFrame:
    """key, peak and whether more than `most` spans (key, start, end) of a key were open at once."""
    edges = spans.select("key", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("key", "e.at", "e.step")
    open_ = F.sum("step").over(Window.partitionBy("key").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("open", open_).groupBy("key").agg(F.max("open").alias("peak")).withColumn("over", F.col("peak") > most)


def token_ceiling(prompt: Column, request: Column) -> Column:
    """Tokens that a call may cost at most: a byte is a token at worst."""
    return F.octet_length(prompt) + F.octet_length(request) + OUTPUT_CEILING + REPLY_CEILING


def tool_outcomes(log: DataFrame) -> DataFrame:
    """run_id, sequence and outcome of tool calls in order: a call is refused if what it would add breaks a budget.

    log: run_id, sequence, tool (search, read, inspect, verify), signature, chunk_ids, chunk_tokens, pages, characters.
    Chunks and tokens count once for each distinct chunk; refused calls add nothing but a call.
    """
    def fold(run: pd.DataFrame) -> pd.DataFrame:
        calls = inspections = characters = 0
        signatures: set[str] = set()
        opened: dict[str, int] = {}
        out = []
        for r in run.sort_values("sequence").itertuples(index=False):
            calls += 1
            then = opened | dict(zip(list(r.chunk_ids) if r.chunk_ids is not None else [], list(r.chunk_tokens) if r.chunk_tokens is not None else []))
            reason = None
            if calls > CALLS:
                reason = "tool_calls"
            elif r.tool == "search" and len(signatures | {r.signature}) > SEARCHES:
                reason = "searches"
            elif len(then) > CHUNKS:
                reason = "chunks"
            elif sum(then.values()) > TOKENS:
                reason = "tokens"
            elif r.tool == "inspect" and (inspections + 1 > INSPECTIONS or r.pages > PAGES or characters + r.characters > CHARACTERS):
                reason = "inspection"
            else:
                opened = then
                if r.tool == "search":
                    signatures.add(r.signature)
                if r.tool == "inspect":
                    inspections, characters = inspections + 1, characters + r.characters
            out.append((r.run_id, r.sequence, reason or "ok"))
        return pd.DataFrame(out, columns=["run_id", "sequence", "outcome"])

    return log.groupBy("run_id").applyInPandas(fold, "run_id string, sequence int, outcome string")


def opened_budget(log: DataFrame) -> DataFrame:
    """run_id, sequence, distinct items and their tokens so far, for logs without refusals: first mentions, then running sums. log: run_id, sequence, item, tokens."""
    first = F.row_number().over(Window.partitionBy("run_id", "item").orderBy("sequence")) == 1
    rows = log.withColumn("new", first.cast("int"))
    so_far = Window.partitionBy("run_id").orderBy("sequence").rangeBetween(Window.unboundedPreceding, 0)
    return rows.select("run_id", "sequence", F.sum("new").over(so_far).alias("items"), F.sum(F.col("new") * F.col("tokens")).over(so_far).alias("tokens"))
