"""The steps of a plan, the evidence behind them, and a check that all of it hangs together."""

from __future__ import annotations

from dataclasses import dataclass

LEVELS = ("literature_independent", "expert_guidance", "convention", "heuristic", "unverified")
NEEDS = ("data", "technical_metadata", "qc_samples", "run_order", "batch_variable", "contrast_variable", "protected_variables", "downstream_family", "subject", "confirmed_processing_state")


@dataclass(frozen=True)
class Step:
    """requires: what the gate asks for; preconditions: SQL over facts, and what they say."""

    id: str
    name: str
    kind: str
    scope: str
    needs: tuple[str, ...] = ("data",)
    ops: tuple[str, ...] = ()
    preconditions: tuple[tuple[str, str], ...] = ()
    built: bool = True


LOGGED = ("log_like", "the data are on a log scale")
STEPS = {s.id: s for s in (
    Step("G1", "integrity", "audit", "global"),
    Step("G2", "history and scale", "audit", "global"),
    Step("G3", "cleaning of technical records", "action", "global", ops=("remove_features",), preconditions=(("g3_n > 0", "a class of technical records is flagged"),)),
    Step("G4", "initial assessment", "audit", "global"),
    Step("G5", "transform", "action", "global", ("data", "confirmed_processing_state"), ("log_transform", "arcsinh_transform"), (("scale_class = 'continuous_linear'", "the scale is continuous and linear"), ("log_transformed = 'no'", "the values are confirmed not to be logged"))),
    Step("G6", "QC drift", "action", "global", ("data", "qc_samples", "run_order"), ("drift_qc_loess",), (("qc_n >= 5", "there are five QC samples"), ("run_order_present", "the run order is known"))),
    Step("G7", "missingness", "audit", "global", ops=("recode_zero_as_missing",)),
    Step("S1", "normalization", "action", "study", ("data", "confirmed_processing_state", "contrast_variable"), ("normalize_median", "normalize_quantile"), (LOGGED,)),
    Step("S2", "batch correction", "action", "study", ("data", "batch_variable", "contrast_variable", "protected_variables"), ("drift_sample_loess", "batch_center", "batch_combat", "correct_batch_effects"), (LOGGED,)),
    Step("S3", "filtering", "action", "study", ("data", "contrast_variable"), ("remove_features",)),
    Step("S4", "sample exclusion", "action", "study", ("data", "contrast_variable"), ("remove_samples",)),
    Step("S5", "repeated measures", "constraint", "study", ("data", "subject")),
    Step("S6", "imputation", "action", "study", ("data", "downstream_family"), built=False),
    Step("S7", "feature summaries", "action", "study", built=False),
    Step("S8", "differential design", "action", "study", built=False),
    Step("S9", "reporting", "action", "study", built=False),
    Step("S10", "confounding", "audit", "study", ("data", "contrast_variable")),
)}

#: What the gate asks, as SQL over facts.
NEED_SQL = {
    "data": "true", "technical_metadata": "batch_present or run_order_present", "qc_samples": "qc_n > 0", "run_order": "run_order_present",
    "batch_variable": "batch_present", "contrast_variable": "contrast_variable <> ''", "protected_variables": "size(protected_variables) > 0 or contrast_variable = 'none'",
    "downstream_family": "downstream_family <> ''", "subject": "subject_present", "confirmed_processing_state": "not any_unconfirmed and log_transformed in ('yes', 'no')",
}


def validate(x, schema: dict, at: str = "$") -> list[str]:
    """Problems of x under a subset of JSON Schema: type, enum, required, properties, additionalProperties, items, minimum."""
    kinds = {"object": dict, "array": (list, tuple), "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    out, kind = [], schema.get("type")
    if kind:
        options = [kind] if isinstance(kind, str) else kind
        if not any(isinstance(x, kinds[k]) and not (isinstance(x, bool) and k in ("number", "integer")) for k in options):
            return [f"{at}: not {' or '.join(options)}"]
    if "enum" in schema and x not in schema["enum"]:
        out.append(f"{at}: {x!r} is none of {schema['enum']}")
    if "minimum" in schema and isinstance(x, (int, float)) and x < schema["minimum"]:
        out.append(f"{at}: below {schema['minimum']}")
    if isinstance(x, dict):
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in x]
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            out += [f"{at}: unknown {k}" for k in x if k not in known]
        for k, sub in known.items():
            if k in x:
                out += validate(x[k], sub, f"{at}.{k}")
    if isinstance(x, (list, tuple)) and "items" in schema:
        for i, v in enumerate(x):
            out += validate(v, schema["items"], f"{at}[{i}]")
    return out


def grid() -> dict[tuple[str, str], list[str]]:
    """Steps by kind and scope."""
    out: dict = {}
    for s in STEPS.values():
        out.setdefault((s.kind, s.scope), []).append(s.id)
    return out


def check() -> list[str]:
    """What does not hang together: unknown needs, operations, evidence levels or steps."""
    from . import executor, rules

    out = [f"{s.id}: no need {n}" for s in STEPS.values() for n in s.needs if n not in NEED_SQL]
    out += [f"{s.id}: no operation {o}" for s in STEPS.values() for o in s.ops if o not in executor.OPS]
    out += [f"{o.name}: no step {x}" for o in executor.OPS.values() for x in o.steps if o.name not in STEPS[x].ops]
    out += [f"{r.id}: no evidence level {r.level}" for r in rules.RULES if r.level not in LEVELS]
    out += [f"{r.id}: no step for {r.group}" for r in rules.RULES if rules.step_of(r.group) not in STEPS]
    return out + [f"{r.id}: no operation {c.op}" for r in rules.RULES for c in r.candidates if c.op and c.op not in executor.OPS]
