"""Rules over facts, one row of facts per block, evaluated as SQL predicates: what is unknown is NULL, and NULL never holds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import registry

STATUSES = ("Recommended", "Alternative", "Do not automate", "Insufficient metadata", "Not applicable")
ORDER = ("G3", "G7-zeros", "G7-floor", "G5", "G6", "S1", "C1", "S2", "S3", "S4", "C2")

#: The facts that rules may name, with their types.
FACTS = (
    "block string, state_id string, checkpoint string, state_scale string, scale_class string, log_like boolean, log_transformed string, normalized string, any_unconfirmed boolean, "
    "slope double, slope_excludes_zero boolean, g3_n long, zeros_present boolean, zeros_answer string, floor_present boolean, floor_answer string, missing_any boolean, "
    "batch_wide_absent boolean, missing_intensity string, missing_batch string, qc_n long, run_order_present boolean, run_order_drift boolean, qc_drift boolean, batch_present boolean, "
    "batch_association boolean, batch_small boolean, same_r_above boolean, contrast_confounded boolean, subject_in_batch boolean, two_confounded boolean, medians_differ boolean, "
    "median_technical boolean, median_contrast boolean, n_outliers long, subject_present boolean, n double, n_eff double, contrast_variable string, protected_variables array<string>, downstream_family string, share_complete double"
)
TYPES = dict(x.split(" ") for x in FACTS.split(", "))
#: Names in parameters that aren't facts but tables of the sample information; a study looks them up.
TABLES = ("batch_mapping", "run_order_mapping", "qc_samples")


@dataclass(frozen=True)
class Candidate:
    """params: names and templates. joint: what is missing decides with it, see JOINT."""

    op: str | None
    label: str
    status: str | None = None
    params: tuple[tuple[str, str], ...] = ()
    joint: bool = False


@dataclass(frozen=True)
class Rule:
    """effect scope: before the gate; decide: the first that holds; annotate: adds to what was decided. restatus: op -> status. In a text, $name
    stands for a fact."""

    id: str
    group: str
    effect: str
    when: str
    text: str
    status: str = ""
    candidates: tuple[Candidate, ...] = ()
    restatus: tuple[tuple[str, str], ...] = ()
    level: str = "convention"


@dataclass(frozen=True)
class Case:
    """A case of a joint decision: when, over facts and `tolerates` (whether the operation takes gaps); what then is done, in order, or instead."""

    id: str
    when: str
    status: str
    order: tuple[str, ...]
    instead: tuple[str, ...]
    text: str


#: Operations of batch correction, and whether they take gaps.
TOLERATES = {"batch_center": True, "drift_sample_loess": True, "batch_combat": False}
#: Batch correction and missing values, decided together; the first case that holds.
JOINT = (
    Case("D2.no_missing", "not coalesce(missing_any, false)", "Recommended", ("batch_correction",), (), "nothing is missing: batch correction is decided by itself"),
    Case("D2.tolerant_first", "coalesce(missing_any, false) and tolerates", "Recommended", ("correction_that_takes_gaps", "hand_on"), (), "correct first, with a method that takes gaps; what must be complete later is imputed after that, within batches, elsewhere"),
    Case("D2.combat_incomplete", "coalesce(missing_any, false) and not tolerates", "Do not automate", (), ("batch_center", "remove_features"), "this correction takes no gaps ($share_complete of the features have none): centre batches, or remove features with gaps, at the cost told"),
)

MEANS = (("batch", "$batch_mapping"), ("stat", "median"))
DRIFT = (("batch", "$batch_mapping"), ("run_order", "$run_order_mapping"))
LOG, SINH = Candidate("log_transform", "log2(x + c), c half of the smallest positive value", params=(("base", "2"), ("offset_rule", "half_min"))), Candidate("arcsinh_transform", "arcsinh(x / cofactor), with a justified cofactor", "Alternative")
CENTER, COMBAT = Candidate("batch_center", "centre each batch by its median", params=MEANS, joint=True), Candidate("batch_combat", "parametric empirical Bayes", "Alternative", (("batch", "$batch_mapping"),), True)
LOESS = Candidate("drift_sample_loess", "local regression on run order within batch, span 0.75", params=DRIFT, joint=True)
MEDIAN, QUANTILE = Candidate("normalize_median", "centre samples by their median"), Candidate("normalize_quantile", "quantile normalization", "Alternative")

RULES = (
    Rule("G-R6", "G3", "decide", "g3_n > 0", "$g3_n classes of flagged records can be removed, class by class, once approved", "Recommended", (Candidate("remove_features", "remove a flagged class"),)),
    Rule("G7-zeros-yes", "G7-zeros", "decide", "zeros_present and zeros_answer = 'yes'", "zeros were said to stand for missing values", "Recommended", (Candidate("recode_zero_as_missing", "make zeros missing", params=(("answer", "$zeros_answer"),)),)),
    Rule("G7-zeros-ask", "G7-zeros", "decide", "zeros_present and zeros_answer is null", "do zeros stand for missing values?", "Insufficient metadata"),
    Rule("M-R2", "G7-floor", "decide", "floor_present and floor_answer is null", "are values at a feature's floor below a detection limit?", "Insufficient metadata"),
    Rule("G-R3", "G5", "scope", "scale_class in ('count_like', 'proportion_like', 'compositional_like', 'continuous_signed')", "only positive continuous values on a linear scale are logged", "Not applicable"),
    Rule("G-R1", "G5", "scope", "any_unconfirmed", "the processing state must be confirmed first", "Insufficient metadata"),
    Rule("G-R4", "G5", "decide", "log_transformed = 'yes' or state_scale in ('log2', 'log10', 'ln', 'arcsinh')", "the values are logged already: twice would be an error", "Do not automate"),
    Rule("G-R2", "G5", "decide", "scale_class = 'continuous_linear' and slope_excludes_zero and log_transformed = 'no'", "spread grows with the mean (slope $slope)", "Recommended", (LOG, SINH), level="expert_guidance"),
    Rule("G-R2b", "G5", "decide", "scale_class = 'continuous_linear' and log_transformed = 'no'", "that spread grows with the mean is not shown", "Alternative", (LOG,)),
    Rule("G-R5", "G6", "decide", "qc_n >= 5 and run_order_present and qc_drift", "QC samples ($qc_n) drift with run order", "Recommended", (Candidate("drift_qc_loess", "local regression on QC samples over run order", params=(("qc_samples", "$qc_samples"), ("run_order", "$run_order_mapping"))),), level="unverified"),
    Rule("S1-node-contrast", "S1", "decide", "medians_differ and median_contrast", "sample medians go with $contrast_variable, the contrast: normalizing could remove what is asked for", "Do not automate", level="expert_guidance"),
    Rule("R2", "S1", "decide", "medians_differ and median_technical and not median_contrast", "sample medians go with a technical variable and not with the contrast", "Recommended", (MEDIAN, QUANTILE), level="expert_guidance"),
    Rule("S1-untracked", "S1", "decide", "medians_differ", "sample medians differ, not shown for technical reasons", "Alternative", (MEDIAN, QUANTILE), level="expert_guidance"),
    Rule("S1-similar", "S1", "decide", "not medians_differ", "sample medians are close", "Alternative", (MEDIAN,), level="heuristic"),
    Rule("R3", "S1", "annotate", "n_outliers > 0", "$n_outliers unusual samples may be informative", restatus=(("normalize_quantile", "Do not automate"),), level="expert_guidance"),
    Rule("R13", "S2", "scope", "not batch_present and not run_order_present", "there is no batch variable", "Insufficient metadata", level="expert_guidance"),
    Rule("R10", "S2", "decide", "contrast_confounded", "a technical factor and the contrast can't be told apart", "Do not automate", level="expert_guidance"),
    Rule("S5-nesting", "S2", "decide", "subject_in_batch", "subjects lie within batches: correcting would absorb them", "Do not automate", level="expert_guidance"),
    Rule("R9", "S2", "decide", "two_confounded", "two technical factors can't be told apart: choose one", "Insufficient metadata", level="expert_guidance"),
    Rule("R4", "S2", "decide", "checkpoint in ('C1', 'C2') and not batch_association and not same_r_above", "batches no longer show: leave the data", "Recommended", (Candidate(None, "no correction"),), level="expert_guidance"),
    Rule("R5", "S2", "decide", "run_order_drift and batch_present", "samples drift with run order: smooth first, then centre", "Recommended", (LOESS, CENTER), level="expert_guidance"),
    Rule("R6", "S2", "decide", "batch_association", "batches are shifted", "Recommended", (CENTER, COMBAT), level="expert_guidance"),
    Rule("S2-none", "S2", "decide", "not batch_association", "no batch shows", "Alternative", (Candidate(None, "no correction"),), level="expert_guidance"),
    Rule("R11", "S2", "annotate", "batch_small", "some batches have few samples: estimates are unsteady", level="heuristic"),
    Rule("R12", "S2", "annotate", "downstream_family = 'differential_abundance' and batch_present", "the final model can hold the batch as a covariate", candidates=(Candidate(None, "batch as a covariate, no change to the data", "Alternative"),), level="expert_guidance"),
    Rule("M-R3", "S2", "annotate", "batch_wide_absent", "features are absent from whole batches", restatus=(("batch_combat", "Do not automate"),), level="literature_independent"),
    Rule("M-R4", "S2", "annotate", "missing_batch = 'yes'", "missing values go with the batch: correct with a method that takes gaps, then hand on", level="literature_independent"),
    Rule("S3-table", "S3", "decide", "missing_any", "the cost of each completeness threshold is told, none is chosen", "Alternative", (Candidate("remove_features", "remove features below a threshold"),)),
    Rule("R3-S4", "S4", "decide", "n_outliers > 0", "$n_outliers unusual samples are listed: each removal is yours", "Do not automate", (Candidate("remove_samples", "remove a sample"),), level="heuristic"),
)
NOTES = (("M-R1", "not missing_any and not floor_present", "nothing is missing and nothing is tied at a floor"), ("M-R5", "missing_intensity = 'yes'", "what is missing depends on intensity: the families that fit are handed on, nothing is imputed"))


def step_of(group: str) -> str:
    return group.split("-")[0]


def holds(sql: str) -> Column:
    return F.coalesce(F.expr(sql), F.lit(False))


def said(name: str) -> Column:
    """A fact as text: numbers to three significant digits, lists joined, n/a if unknown."""
    c, kind = F.col(name), TYPES[name]
    if kind.startswith("array"):
        text = F.array_join(c, ", ")
    else:
        text = F.regexp_replace(S.significant(c, 3).cast("string"), r"\.0$", "") if kind == "double" else c.cast("string")
    return F.coalesce(text, F.lit("n/a"))


def filled(template: str) -> Column:
    """A template with each $name replaced by that fact; what isn't a fact is an error."""
    parts = re.split(r"\$([a-z_][a-z0-9_]*)", template)
    if unknown := [p for p in parts[1::2] if p not in TYPES]:
        raise ValueError(f"no fact {unknown[0]!r} in {template!r}")
    return F.concat(*(said(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p)) if parts != [""] else F.lit("")


def parameters(c: Candidate) -> Column:
    """A candidate's parameters as texts: templates are filled, names of TABLES stay for a study to look up."""
    pairs = [(F.lit(k), F.lit(v) if v.startswith("$") and v[1:] in TABLES else filled(v)) for k, v in c.params]
    return F.create_map(*(x for p in pairs for x in p)) if pairs else F.create_map().cast("map<string,string>")


def joint(c: Candidate) -> Column:
    """What JOINT decides for a candidate."""
    kind = "struct<id:string,status:string,order:array<string>,instead:array<string>,text:string,share_complete:double>"
    if not c.joint:
        return F.lit(None).cast(kind)
    many = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    one = lambda k: F.struct(F.lit(k.id).alias("id"), F.lit(k.status).alias("status"), many(k.order).alias("order"), many(k.instead).alias("instead"), filled(k.text).alias("text"), F.col("share_complete").alias("share_complete"))
    return F.coalesce(*(F.when(holds(re.sub(r"\btolerates\b", str(TOLERATES[c.op]).lower(), k.when)), one(k)) for k in JOINT)).cast(kind)


def condition(c: dict) -> Column:
    """A typed condition {fact, op, value}, or {all: [...]} / {any: [...]}, as a predicate; on a missing fact only `exists: false` holds."""
    for key, join in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if key in c:
            return reduce(join, [condition(x) for x in c[key]], F.lit(key == "all"))
    f, op, v = F.col(c["fact"]), c["op"], c.get("value")
    made = {
        "exists": lambda: f.isNotNull() if v in (None, True) else f.isNull(), "eq": lambda: f == v, "ne": lambda: f != v, "in": lambda: f.isin(*v), "not_in": lambda: ~f.isin(*v),
        "is_true": lambda: f == F.lit(True), "is_false": lambda: f == F.lit(False), "nonempty": lambda: F.length(f.cast("string")) > 0, "gt": lambda: f > v, "ge": lambda: f >= v, "lt": lambda: f < v, "le": lambda: f <= v,
    }
    if op not in made:
        raise ValueError(f"no condition {op!r}")
    return F.coalesce(made[op](), F.lit(False))


def plan_entries(facts: DataFrame) -> DataFrame:
    """(block, pos, group, step, status, rule, because, blocked_by, candidates) of every block: scope, gate, first decision, annotations,
    then preconditions, which turn Recommended into Alternative. Groups that no rule decides have no entry. One pass over the facts."""
    entries = []
    for pos, group in enumerate(ORDER):
        if group.startswith("C"):
            continue
        step = registry.STEPS[step_of(group)]
        rules = [r for r in RULES if r.group == group]
        of = lambda effect: [r for r in rules if r.effect == effect]  # noqa: E731, B023
        pick = lambda rs, value: F.coalesce(*(F.when(holds(r.when), value(r)) for r in rs), F.lit(None)) if rs else F.lit(None)
        scope, decided = pick(of("scope"), lambda r: F.lit(r.id)), pick(of("decide"), lambda r: F.lit(r.id))
        unmet = F.array_compact(F.array(*(F.when(~holds(registry.NEED_SQL[n]), F.lit(f"needs:{n}")) for n in step.needs))) if step.kind == "action" else F.array().cast("array<string>")
        gated = F.size(unmet) > 0
        rule = F.coalesce(scope, F.when(~gated, decided))
        broken = F.array_compact(F.array(*(F.when(~holds(sql), F.lit(said)) for sql, said in step.preconditions))) if step.preconditions else F.array().cast("array<string>")
        by_id = {r.id: r for r in rules}
        status = F.coalesce(*(F.when(rule == r.id, F.lit(r.status)) for r in rules if r.effect != "annotate"), F.when(gated, F.lit("Insufficient metadata")))
        status = F.when((status == "Recommended") & (F.size(broken) > 0), F.lit("Alternative")).otherwise(status)
        text = F.coalesce(*(F.when(rule == r.id, filled(r.text)) for r in rules if r.effect != "annotate"), F.concat(F.lit("needs "), F.array_join(F.transform(unmet, lambda u: F.substring(u, 7, 100)), ", ")))
        chosen = rule.isNotNull() & scope.isNull()
        notes = [F.when(chosen & holds(r.when), filled(r.text)) for r in of("annotate")]
        refused = [F.when(chosen & (rule == r.id) & (joint(c)["status"] == "Do not automate"), joint(c)["text"]) for r in rules if r.effect == "decide" for c in r.candidates if c.joint]
        because = F.array_compact(F.array(text, *notes, *refused, F.when(chosen & (F.size(broken) > 0), F.concat(F.lit("not established: "), F.array_join(broken, "; ")))))
        candidates = []
        for r in by_id.values():
            here = chosen & (rule == r.id) if r.effect == "decide" else chosen & holds(r.when)
            for c in r.candidates:
                s = F.lit(c.status) if c.status else status
                for a in of("annotate"):
                    for op, new in a.restatus:
                        if op == c.op:
                            s = F.when(holds(a.when), F.lit(new)).otherwise(s)
                if c.joint:
                    s = F.when(joint(c)["status"] == "Do not automate", F.lit("Do not automate")).otherwise(s)
                candidates.append(F.when(here, F.struct(F.lit(c.op).cast("string").alias("op"), F.lit(c.label).alias("label"), s.alias("status"), parameters(c).alias("params"), joint(c).alias("joint"))))
        none = F.struct(*(F.lit(None).cast("string").alias(x) for x in ("op", "label", "status")), F.create_map().cast("map<string,string>").alias("params"), joint(MEDIAN).alias("joint"))
        listed = F.array_compact(F.array(*(candidates or [F.when(F.lit(False), none)])))
        entry = F.struct(F.lit(pos).alias("pos"), F.lit(group).alias("group"), F.lit(step.id).alias("step"), status.alias("status"), rule.cast("string").alias("rule"), because.alias("because"), unmet.alias("blocked_by"), listed.alias("candidates"))
        entries.append(F.when(status.isNotNull(), entry))
    return facts.select("block", "state_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("block", "state_id", "e.*")


def plan_notes(facts: DataFrame) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(holds(sql), F.struct(F.lit(i).alias("note"), filled(t).alias("text"))) for i, sql, t in NOTES)))
    return facts.select("block", F.explode(hits).alias("n")).select("block", "n.*")
