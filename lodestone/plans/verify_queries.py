"""The binding grammar, claim verification and absence over assertions made from the star schema.

Each row's variant follows from its key, so the expected outcome is a CASE expression.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import absence, binding, verification
from lodestone.plans.registry import query
from lodestone.plans.tables import table

_AMOUNT = "c_custkey % 900 + 2"


def _amount(n: int = 0):
    return F.concat(F.lit("$"), (F.col("c_custkey") % 900 + 2 + n).cast("string"), F.lit(" million"))


def _pick(key, *choices):
    return F.element_at(F.array(*choices), (key % len(choices) + 1).cast("int"))


@query("canonical_digits", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '.' || rtrim(CAST(c_custkey % 100 AS VARCHAR), '0') END AS digits FROM customer")
def canonical_digits(spark, sf):
    text = F.concat(F.lit("00"), F.col("c_custkey").cast("string"), F.lit("."), (F.col("c_custkey") % 100).cast("string"), F.lit("00"))
    return table(spark, sf, "customer").select("c_custkey", C.canonical_digits(text).alias("digits"))


@query("kind_unit_law", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 4 IN (0, 3) WHEN 1 THEN c_custkey % 4 = 1 ELSE c_custkey % 4 = 2 END AS accepted FROM customer")
def kind_unit_law(spark, sf):
    kind = _pick(F.col("c_custkey"), *map(F.lit, ("reported_level", "reported_rate", "reported_per_share")))
    unit = _pick(F.col("c_custkey"), *map(F.lit, ("million", "bps", "per share", "")))
    return table(spark, sf, "customer").select("c_custkey", C.kind_accepts_unit(kind, unit).alias("accepted"))


@query("numeric_signature_counts", f"SELECT c_custkey, 2 AS n, '-' AS sign, '$' AS currency, CAST({_AMOUNT} AS VARCHAR) AS digits, 'million' AS unit, 'basis points' AS second_unit FROM customer")
def numeric_signature_counts(spark, sf):
    text = F.concat(F.lit("Balance was (00"), F.lit("$"), (F.col("c_custkey") % 900 + 2).cast("string"), F.lit(" million), up 12 basis  points."))
    text = F.regexp_replace(text, r"\(00", "(")
    s = table(spark, sf, "customer").select("c_custkey", binding.numeric_signatures_udf(text).alias("s"))
    return s.select("c_custkey", F.size("s").alias("n"), F.col("s")[0].sign.alias("sign"), F.col("s")[0].currency.alias("currency"), F.col("s")[0].digits.alias("digits"), F.col("s")[0].unit.alias("unit"), F.col("s")[1].unit.alias("second_unit"))


@query(
    "bind_generated_assertions",
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'direct_copula' WHEN 2 THEN 'direct_reported' WHEN 5 THEN 'next_sentence_anaphoric' WHEN 6 THEN 'dated_direct' WHEN 7 THEN 'colon' END AS profile,
    CASE WHEN c_custkey % 8 IN (1, 3, 4) THEN 'no_positive_binding_profile' END AS failure_reason FROM customer""",
)
def bind_generated_assertions(spark, sf):
    a = _amount()
    forms = [
        F.concat(F.lit("Account balance was "), a, F.lit(".")), F.concat(F.lit("Forecast account balance was "), a, F.lit(".")), F.concat(F.lit("Account balance reached "), a, F.lit(" as of 31 December 2025.")),
        F.concat(F.lit("Account balance was not "), a, F.lit(".")), F.concat(F.lit("Account balance was "), a, F.lit(" projected.")), F.concat(F.lit("Account balance was stable. It remained at "), a, F.lit(".")),
        F.concat(F.lit("At year end, Account balance was "), a, F.lit(".")), F.concat(F.lit("Account balance: "), a),
    ]
    period = F.when(F.col("c_custkey") % 8 == 2, F.lit("31 December 2025")).when(F.col("c_custkey") % 8 == 6, F.lit("year end"))
    bound = binding.bind_udf(_pick(F.col("c_custkey"), *forms), F.lit("Account balance"), a, F.lit("reported_level"), period)
    return table(spark, sf, "customer").select("c_custkey", bound.alias("b")).select("c_custkey", "b.profile", "b.failure_reason")


@query(
    "temporal_signatures",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'quarter:' || (2000 + c_custkey % 20) || '-q' || (c_custkey % 4 + 1) WHEN 1 THEN 'fiscal-year:' || (2000 + c_custkey % 20) WHEN 2 THEN 'date:' || (2000 + c_custkey % 20) || '-12-31'
    WHEN 3 THEN 'month:' || (2000 + c_custkey % 20) || '-02' WHEN 4 THEN NULL ELSE 'year:' || (2000 + c_custkey % 20) END AS signature FROM customer""",
)
def temporal_signatures(spark, sf):
    year = (F.col("c_custkey") % 20 + 2000).cast("string")
    forms = [
        F.concat(F.lit("Q"), (F.col("c_custkey") % 4 + 1).cast("string"), F.lit(" "), year), F.concat(F.lit("for fiscal year "), year), F.concat(F.lit("as of 31 December "), year),
        F.concat(F.lit("in February "), year), F.concat(F.lit("31 February "), year), F.concat(F.lit("calendar year "), year),
    ]
    return table(spark, sf, "customer").select("c_custkey", binding.temporal_signature_udf(_pick(F.col("c_custkey"), *forms)).alias("signature"))


def _claims(spark, sf):
    """A chunk and a claim for each customer: one or two statements, well formed or not by the key."""
    k = F.col("c_custkey")
    left, right = _amount(), _amount(1)
    statement = lambda v, p: F.concat(F.lit("Account balance was "), v, F.lit(" in "), F.lit(p), F.lit("."))
    first_period = _pick(k, *map(F.lit, ("Q1 2024", "Q1 2025", "Q1", "Q1 2024", "Q1 2024", "Q1 2024")))
    second_period = _pick(k, *map(F.lit, ("Q1 2025", "Q1 2025", "Q1 2025", "Q1 2025", "Q1 2025", "Q1 2025")))
    one = F.concat(F.lit("Account balance was "), left, F.lit(" in "), first_period, F.lit("."))
    two = F.concat(F.lit("Account balance was "), right, F.lit(" in "), second_period, F.lit("."))
    rows = table(spark, sf, "customer").withColumn("chunk_id", C.chunk_id(k, F.lit(1), F.lit(0)))
    chunks = rows.select("chunk_id", k.cast("string").alias("document_id"), F.col("c_name").alias("document_name"), F.lit(1).alias("page"), F.lit("1").alias("page_label"), F.concat_ws(" ", one, two).alias("normalized_text"))
    chunks = chunks.withColumn("sha256", F.sha2("normalized_text", 256))

    def observation(value, period, quote):
        cited = F.when(k % 6 == 4, F.lit("chk_0000000000000000")).otherwise(F.col("chunk_id"))
        relation = F.when(k % 6 == 5, F.lit("context")).otherwise(F.lit("supports"))
        evidence = F.struct(cited.alias("chunk_id"), F.lit("Account balance").alias("metric_anchor"), quote.alias("exact_quote"), quote.alias("exact_assertion"), relation.alias("relation"))
        return F.struct(F.lit("reported_level").alias("kind"), value.alias("value_text"), period.alias("temporal_anchor"), F.array(evidence).alias("evidence"))

    first, second = observation(left, first_period, one), observation(right, second_period, two)
    observations = F.when(k % 6 == 3, F.array(first)).otherwise(F.array(first, second))
    empty = F.slice(F.array(first["evidence"][0]), 1, 0)
    claims = rows.select(k.alias("claim_id"), F.lit("account balance").alias("metric"), F.lit(False).alias("request_absence_probe"), observations.alias("observations"), empty.alias("context_evidence"), "c_nationkey")
    return claims, chunks


_STATUS = """s AS (SELECT c_custkey AS claim_id, c_nationkey, '$' || (c_custkey % 900 + 2) || ' million' AS a, '$' || (c_custkey % 900 + 3) || ' million' AS b, CASE c_custkey % 6 WHEN 0 THEN 'date_variant' WHEN 1 THEN 'conflict' WHEN 2 THEN 'possible_conflict' WHEN 3 THEN 'verified' ELSE 'unverified' END AS status,
CASE c_custkey % 6 WHEN 1 THEN 'Q1 2025' WHEN 2 THEN 'Q1' ELSE 'Q1 2024' END AS p FROM customer),
t AS (SELECT *, CASE status WHEN 'date_variant' THEN 'Account balance is reported at different dates: ' || a || ' (' || p || ') and ' || b || ' (Q1 2025)' WHEN 'conflict' THEN 'Account balance is reported with conflicting values: ' || a || ' (' || p || ') and ' || b || ' (Q1 2025)'
WHEN 'possible_conflict' THEN 'Account balance has unresolved reported values: ' || a || ' (' || p || ') and ' || b || ' (Q1 2025)' WHEN 'verified' THEN 'Account balance: ' || a || ' (' || p || ')' END AS statement FROM s)"""


@query("claim_status", f"WITH {_STATUS} SELECT claim_id, status, CASE WHEN status <> 'unverified' THEN statement ELSE 'Unverified claim about account balance' END AS statement FROM t")
def claim_status(spark, sf):
    claims, chunks = _claims(spark, sf)
    found = verification.claim_statuses(claims, chunks)
    return found.select("claim_id", "status", "statement")


@query(
    "answer_text",
    f"""WITH {_STATUS} SELECT c_nationkey AS run_id, bool_and(status IN ('verified', 'conflict', 'date_variant')) AS all_authoritative, string_agg(statement, chr(10) ORDER BY claim_id) FILTER (status IN ('verified', 'conflict', 'date_variant')) AS answer,
    CASE WHEN bool_and(status IN ('verified', 'conflict', 'date_variant')) THEN 'completed' ELSE 'incomplete' END AS status FROM t GROUP BY 1""",
)
def answer_text(spark, sf):
    claims, chunks = _claims(spark, sf)
    found = verification.claim_statuses(claims, chunks).join(claims.select("claim_id", F.col("c_nationkey").alias("run_id")), "claim_id")
    return verification.batch_outcome(found.withColumn("ordinal", F.col("claim_id")))


@query("authoritative_rate", f"WITH {_STATUS} SELECT status, count(*) AS claims FROM s GROUP BY 1")
def authoritative_rate(spark, sf):
    claims, chunks = _claims(spark, sf)
    return verification.claim_statuses(claims, chunks).groupBy("status").agg(F.count("*").alias("claims"))


@query("quote_challenge", "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 1 THEN 'rejected' ELSE 'verified' END AS outcome FROM customer")
def quote_challenge(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").withColumn("chunk_id", C.chunk_id(k, F.lit(1), F.lit(0)))
    chunks = rows.select("chunk_id", F.concat(F.lit("Customer "), "c_name", F.lit(" holds an account.")).alias("normalized_text"))
    quotes = rows.select(k.alias("run_id"), "chunk_id", F.when(k % 3 == 0, F.lit("something else")).otherwise(F.concat(F.lit("CUSTOMER  "), F.lower("c_name"))).alias("quote"))
    cited = rows.where(k % 2 == 0).select(k.alias("run_id"), "chunk_id")
    return verification.quote_challenges(quotes, chunks, cited).select("run_id", "outcome")


@query(
    "absence_conclusion",
    "SELECT n_nationkey AS metric_id, CASE WHEN n_nationkey % 5 IN (2, 4) THEN 'evidence_requires_review' ELSE 'not_found_in_probe' END AS conclusion FROM nation",
)
def absence_conclusion(spark, sf):
    nations = table(spark, sf, "nation")
    metric = F.concat(F.replace(F.initcap("n_name"), F.lit("_"), F.lit(" ")), F.lit(" headcount"))
    text = _pick(F.col("n_nationkey"), F.concat(F.lit("Question: what was "), metric, F.lit("?")), F.concat(metric, F.lit(".")), F.concat(metric, F.lit(". It was $2 million.")), F.concat(F.lit("The rubric mentions "), metric, F.lit(".")), F.concat(metric, F.lit(" was stable.")))
    chunks = nations.select(C.chunk_id(F.col("n_nationkey"), F.lit(1), F.lit(0)).alias("chunk_id"), F.col("n_nationkey").cast("string").alias("document_id"), F.lit(0).alias("chunk_position"), text.alias("normalized_text"), F.lit(None).cast("string").alias("previous_chunk_id"), F.lit(None).cast("string").alias("next_chunk_id"))
    metrics = nations.select(F.col("n_nationkey").alias("metric_id"), metric.alias("metric"))
    scans = absence.exact_scan(metrics, chunks)
    searched = metrics.join(chunks.withColumn("metric_id", F.col("document_id").cast("int")), "metric_id").select("metric_id", "chunk_id")
    return absence.conclusions(metrics, chunks, searched, scans).select("metric_id", "conclusion")


@query("probe_queries", """SELECT n_nationkey AS metric_id, CAST(i AS INT) AS probe_no, CASE i WHEN 0 THEN n_name WHEN 1 THEN '"' || n_name || '" reported value' WHEN 2 THEN n_name || ' fiscal year period' ELSE n_name || ' total company metric' END AS query FROM nation, range(4) r(i)""")
def probe_queries(spark, sf):
    return absence.probe_queries(table(spark, sf, "nation").select(F.col("n_nationkey").alias("metric_id"), F.col("n_name").alias("metric"))).select("metric_id", "probe_no", "query")
