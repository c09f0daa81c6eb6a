"""Registered queries of rules and plans: the entries that the rules make of a table of facts, and SQL for the same entries.

Facts, one row per customer, are derived from the customer's columns so that every fact takes each of its values and is unknown for
some. The SQL takes conditions and texts from the rules and states by joins how they are resolved: scope, gate, first decision, preconditions,
annotations, joint decisions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry, rules
from .catalogue import query, table

_K = "c_custkey"


def _one_of(step: int, *values: str) -> str:
    """A value that goes round the values with the key over step; NULL is one of them if it is listed."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE CAST(FLOOR({_K} / {step}.0) AS BIGINT) % {len(values)} {cases} END"


def _maybe(a: int, b: int) -> str:
    """True, false or unknown."""
    return f"CASE WHEN ({_K} * {a} + c_nationkey) % {b} = 0 THEN NULL ELSE ({_K} * {a} + c_nationkey) % {b} < {b // 2 + 1} END"


#: Each fact as SQL over customer, for Spark and DuckDB alike.
FACT_SQL = {
    "block": f"CONCAT('A', {_K}, 'B1')", "state_id": "'S0'", "checkpoint": _one_of(1, "'C0'", "'C1'", "'C2'"), "state_scale": _one_of(2, "'linear'", "'log2'", "'linear'", "NULL"),
    "scale_class": _one_of(3, "'continuous_linear'", "'continuous_linear'", "'count_like'", "'continuous_symmetric_or_log_like'", "NULL"), "log_like": _maybe(3, 5),
    "log_transformed": _one_of(5, "'no'", "'yes'", "'no'", "'unknown'", "NULL"), "normalized": "'no'", "any_unconfirmed": f"{_K} % 11 = 0", "slope": f"CASE WHEN {_K} % 9 = 0 THEN NULL ELSE ({_K} % 97 + 1) / 31.0 END",
    "slope_excludes_zero": _maybe(7, 6), "g3_n": f"{_K} % 4", "zeros_present": _maybe(2, 7), "zeros_answer": _one_of(7, "'yes'", "'no'", "'done'", "NULL"), "floor_present": _maybe(4, 9),
    "floor_answer": _one_of(4, "'yes'", "NULL"), "missing_any": _maybe(5, 8), "batch_wide_absent": _maybe(6, 11), "missing_intensity": _one_of(6, "'yes'", "'no'", "'indeterminate'"),
    "missing_batch": _one_of(8, "'yes'", "'no'", "'indeterminate'"), "qc_n": f"{_K} % 8", "run_order_present": _maybe(9, 4), "run_order_drift": _maybe(8, 5), "qc_drift": _maybe(10, 3), "batch_present": f"{_K} % 6 > 0",
    "batch_association": _maybe(11, 7), "batch_small": _maybe(12, 5), "same_r_above": _maybe(13, 9), "contrast_confounded": f"{_K} % 10 = 3", "subject_in_batch": f"{_K} % 13 = 5", "two_confounded": f"{_K} % 17 = 4",
    "medians_differ": _maybe(14, 5), "median_technical": _maybe(15, 7), "median_contrast": _maybe(16, 8), "n_outliers": f"{_K} % 3", "subject_present": f"{_K} % 2 = 0", "n": f"{_K} % 50 + 1.0", "n_eff": f"({_K} % 50 + 1) / 2.0",
    "contrast_variable": _one_of(9, "'Group'", "'Group'", "'none'", "''", "NULL"), "protected_variables": f"CASE WHEN {_K} % 5 = 0 THEN [] ELSE ['Group'] END", "downstream_family": _one_of(11, "'differential_abundance'", "'clustering'", "NULL"),
    "share_complete": f"CASE WHEN {_K} % 12 = 0 THEN NULL ELSE ({_K} % 61) / 61.0 END",
}


def facts(spark: SparkSession, d: str) -> DataFrame:
    lists = lambda sql: re.sub(r"\[(.*?)\]", lambda m: f"CAST(ARRAY({m[1]}) AS ARRAY<STRING>)", sql)
    rows = table(spark, d, "customer").selectExpr(*(f"{lists(sql)} AS {name}" for name, sql in FACT_SQL.items()))
    return rows.select(*(F.col(name).cast(kind) for name, kind in rules.TYPES.items()))


def _said(name: str) -> str:
    kind = rules.TYPES[name]
    if kind == "double":
        return f"COALESCE(regexp_replace(CAST(CASE WHEN {name} = 0 THEN 0.0::DOUBLE ELSE ROUND(CAST({name} AS DOUBLE), CAST(2 - FLOOR(LOG10(ABS({name}))) AS INTEGER)) END AS VARCHAR), '\\.0$', ''), 'n/a')"
    return f"COALESCE(array_to_string({name}, ', '), 'n/a')" if kind.startswith("array") else f"COALESCE(CAST({name} AS VARCHAR), 'n/a')"


def _filled(template: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return "CONCAT(" + ", ".join(_said(p) if i % 2 else quoted(p) for i, p in enumerate(re.split(r"\$([a-z_][a-z0-9_]*)", template))) + ")"


def _plan_sql() -> str:
    groups = [(i, g, registry.STEPS[rules.step_of(g)]) for i, g in enumerate(rules.ORDER) if not g.startswith("C")]
    union = lambda rows, empty: " UNION ALL ".join(rows) if rows else empty
    there = lambda sql: f"COALESCE({sql.replace('size(', 'len(')}, FALSE)"
    hits = [f"SELECT block, '{r.group}' AS grp, '{r.effect}' AS effect, {i} AS ord, '{r.id}' AS id, '{r.status}' AS status, {_filled(r.text)} AS text FROM fx WHERE {there(r.when)}" for i, r in enumerate(rules.RULES)]
    needs = [f"SELECT block, '{g}' AS grp, {i} AS ord, '{n}' AS need FROM fx WHERE NOT {there(registry.NEED_SQL[n])}" for _, g, s in groups if s.kind == "action" for i, n in enumerate(s.needs)]
    broken = [f"SELECT block, '{g}' AS grp FROM fx WHERE NOT {there(sql)}" for _, g, s in groups for sql, _ in s.preconditions]
    candidates = [f"('{r.id}', {i * 100 + j}, {repr(c.op) if c.op else 'NULL'}, {repr(c.status) if c.status else 'NULL'}, {c.joint}, {rules.TOLERATES.get(c.op, False)}, {len(c.params)})" for i, r in enumerate(rules.RULES) for j, c in enumerate(r.candidates)]
    restatus = [f"('{r.id}', '{op}', '{new}')" for r in rules.RULES for op, new in r.restatus]
    cases = " ".join(f"WHEN {k.when.replace('tolerates', 'takes_gaps')} THEN '{k.id}'" for k in rules.JOINT)
    refused = next(k for k in rules.JOINT if k.status == "Do not automate")
    return f""", fx AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in FACT_SQL.items())} FROM customer),
gr AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{s.id}')" for _, g, s in groups)}) t(grp, step)),
ht AS ({union(hits, "")}), nd AS ({union(needs, "")}), br AS ({union(broken, "")}),
hs AS (SELECT block, grp, arg_min(id, ord) FILTER (effect = 'scope') AS scope, arg_min(id, ord) FILTER (effect = 'decide') AS decided, COUNT(*) FILTER (effect = 'annotate') AS n_notes FROM ht GROUP BY 1, 2),
ns AS (SELECT block, grp, string_agg(need, ', ' ORDER BY ord) AS needs FROM nd GROUP BY 1, 2), bs AS (SELECT block, grp, COUNT(*) AS n FROM br GROUP BY 1, 2),
en AS (SELECT fx.block, gr.grp, step, scope, needs, COALESCE(bs.n, 0) AS n_broken, COALESCE(n_notes, 0) AS n_notes, COALESCE(scope, CASE WHEN needs IS NULL THEN decided END) AS rule, missing_any FROM fx CROSS JOIN gr LEFT JOIN hs ON hs.block = fx.block AND hs.grp = gr.grp LEFT JOIN ns ON ns.block = fx.block AND ns.grp = gr.grp LEFT JOIN bs ON bs.block = fx.block AND bs.grp = gr.grp),
es AS (SELECT en.*, ht.text, CASE WHEN ht.status = 'Recommended' AND n_broken > 0 THEN 'Alternative' WHEN ht.status IS NOT NULL THEN ht.status WHEN needs IS NOT NULL THEN 'Insufficient metadata' END AS status, rule IS NOT NULL AND scope IS NULL AS chosen FROM en LEFT JOIN ht ON ht.block = en.block AND ht.id = rule),
cd AS (SELECT * FROM (VALUES {", ".join(candidates)}) t(id, ord, op, own, joint, takes_gaps, n_params)), rs AS (SELECT * FROM (VALUES {", ".join(restatus)}) t(id, op, new)),
cs AS (SELECT es.block, es.grp, cd.ord, cd.op, n_params, COALESCE(own, es.status) AS status, CASE WHEN joint THEN CASE {cases} END END AS joint_case, EXISTS (SELECT 1 FROM ht a JOIN rs ON rs.id = a.id WHERE a.block = es.block AND a.grp = es.grp AND rs.op = cd.op) AS restated
  FROM es JOIN ht ON ht.block = es.block AND ht.grp = es.grp AND (ht.id = es.rule OR ht.effect = 'annotate') JOIN cd ON cd.id = ht.id WHERE chosen),
cf AS (SELECT block, grp, ord, op, n_params, joint_case, CASE WHEN restated OR joint_case = '{refused.id}' THEN 'Do not automate' ELSE status END AS status FROM cs),
rf AS (SELECT block, grp, COUNT(*) FILTER (joint_case = '{refused.id}') AS n_refused FROM cf GROUP BY 1, 2)"""


@query(_plan_sql() + """ SELECT es.block, es.grp, step, status, rule, CASE WHEN rule IS NULL THEN CONCAT('needs ', needs) ELSE text END AS text, CAST(1 + CASE WHEN chosen THEN n_notes + CASE WHEN n_broken > 0 THEN 1 ELSE 0 END ELSE 0 END + COALESCE(n_refused, 0) AS INTEGER) AS n_because FROM es LEFT JOIN rf ON rf.block = es.block AND rf.grp = es.grp WHERE status IS NOT NULL""")
def plan_entries(spark, d):
    e = rules.plan_entries(facts(spark, d))
    return e.select("block", F.col("group").alias("grp"), "step", "status", "rule", F.col("because")[0].alias("text"), F.size("because").alias("n_because"))


@query(_plan_sql() + """ SELECT block, grp, COALESCE(op, 'none') AS op, status, joint_case, CAST(n_params AS INTEGER) AS n_params FROM cf""")
def plan_candidates(spark, d):
    c = rules.plan_entries(facts(spark, d)).select("block", F.col("group").alias("grp"), F.explode("candidates").alias("c"))
    return c.select("block", "grp", F.coalesce("c.op", F.lit("none")).alias("op"), "c.status", F.col("c.joint.id").alias("joint_case"), F.size("c.params").alias("n_params"))


@query(f""", fx AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in FACT_SQL.items())} FROM customer), op AS (SELECT * FROM (VALUES {", ".join(f"('{o}', {t})" for o, t in rules.TOLERATES.items())}) t(op, takes_gaps))
SELECT block, op, CASE WHEN missing_any IS NULL OR NOT missing_any THEN 'D2.no_missing' WHEN takes_gaps THEN 'D2.tolerant_first' ELSE 'D2.combat_incomplete' END AS joint_case, CASE WHEN missing_any AND NOT takes_gaps THEN 'Do not automate' ELSE 'Recommended' END AS status,
CASE WHEN missing_any AND NOT takes_gaps THEN '' WHEN missing_any THEN 'correction_that_takes_gaps,hand_on' ELSE 'batch_correction' END AS steps, CASE WHEN missing_any AND NOT takes_gaps THEN 2 ELSE 0 END AS n_instead, ROUND(CAST(share_complete AS DOUBLE), 6) AS share_complete FROM fx, op""")
def joint_decisions(spark, d):
    """Every method of batch correction against every block: the method, whether something is missing, and how many features are complete."""
    of = F.array(*(F.struct(F.lit(c.op).alias("op"), rules.joint(c).alias("j")) for c in (rules.CENTER, rules.COMBAT, rules.LOESS)))
    j = facts(spark, d).select("block", F.explode(of).alias("x"))
    return j.select("block", "x.op", F.col("x.j.id").alias("joint_case"), F.col("x.j.status").alias("status"), F.array_join("x.j.order", ",").alias("steps"), F.size("x.j.instead").alias("n_instead"), (F.round("x.j.share_complete", 6) + F.lit(0.0)).alias("share_complete"))


@query(f""", fx AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in FACT_SQL.items())} FROM customer)
SELECT block, 'M-R1' AS note FROM fx WHERE NOT missing_any AND NOT floor_present UNION ALL SELECT block, 'M-R5' FROM fx WHERE missing_intensity = 'yes'""")
def plan_notes(spark, d):
    return rules.plan_notes(facts(spark, d)).select("block", "note")


#: Typed conditions, as a rule file would state them, with SQL for the same; the first is nested.
CONDITIONS = (
    ({"all": [{"fact": "scale_class", "op": "in", "value": ["continuous_linear", "count_like"]}, {"any": [{"fact": "qc_n", "op": "ge", "value": 5}, {"fact": "run_order_present", "op": "is_true"}]}]}, "scale_class IN ('continuous_linear', 'count_like') AND (qc_n >= 5 OR COALESCE(run_order_present, FALSE))"),
    ({"fact": "missing_any", "op": "is_false"}, "NOT missing_any"), ({"fact": "missing_any", "op": "ne", "value": True}, "missing_any <> TRUE"), ({"fact": "zeros_answer", "op": "exists"}, "zeros_answer IS NOT NULL"),
    ({"fact": "zeros_answer", "op": "exists", "value": False}, "zeros_answer IS NULL"), ({"fact": "contrast_variable", "op": "nonempty"}, "LENGTH(contrast_variable) > 0"), ({"fact": "slope", "op": "gt", "value": 1.5}, "slope > 1.5"),
    ({"fact": "slope", "op": "le", "value": 1.5}, "slope <= 1.5"), ({"fact": "state_scale", "op": "not_in", "value": ["linear"]}, "state_scale NOT IN ('linear')"), ({"fact": "n_eff", "op": "lt", "value": 4}, "n_eff < 4"),
)


@query(f""", fx AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in FACT_SQL.items())} FROM customer)
SELECT block, {" + ".join(f"CASE WHEN COALESCE({sql}, FALSE) THEN {1 << i} ELSE 0 END" for i, (_, sql) in enumerate(CONDITIONS))} AS holds FROM fx""")
def typed_conditions(spark, d):
    """Which of the conditions hold for each block, a bit each; on what is unknown none holds but that it doesn't exist."""
    bits = [F.when(rules.condition(c), 1 << i).otherwise(0) for i, (c, _) in enumerate(CONDITIONS)]
    return facts(spark, d).select("block", sum(bits[1:], bits[0]).alias("holds"))
