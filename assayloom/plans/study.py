"""A study: audit, intake, plan, approvals, new states, verification and replay."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fits
from ..operators import missing as M
from ..sources.states import StateStore
from . import executor, rules
from .audit import CHECKPOINT, Audit, cleaned

# The intake's fields and answers.
INTAKE = ("contrast_variable", "protected_variables", "nuisance_variables", "question_type", "downstream_family")
QUESTION_TYPES = ("global_untargeted", "targeted_features")
LOG_SCALES = ("log2", "log10", "ln", "arcsinh")
FAMILIES = ("differential_abundance", "clustering_exploration", "prediction", "integration", "unsure")


class Study:
    """From confirmed decisions, or from an Audit that is made already. folder: where states go; all executors must reach it."""

    def __init__(self, source, folder: str, params: dict | None = None):
        self.first = source if isinstance(source, Audit) else Audit.of(source, params=params)
        self.spark, self.params = self.first.spark, params
        self.store = StateStore(self.spark, folder)
        self.audits: dict[str, Audit] = {}
        self.values: dict = {}
        self.history: list[dict] = []
        self.answers: dict[str, str] = {}
        self.decisions: list[dict] = []
        self.planned: tuple[str, list[dict]] | None = None

    # ---------------------------------------------------------------- audit and intake

    def audit(self) -> DataFrame:
        out = self.first.run_all()
        root = self.store.add(self.first.full.select("block", "feature", "sample", "value"), scales={b: self.first.effective_scale(b) for b in self.first.blocks})
        self.audits[root] = self.first
        return out

    def set_intake(self, **fields) -> dict:
        names = [v["name"] for v in self.first.variables()]
        for k, v in fields.items():
            if k not in INTAKE:
                raise ValueError(f"no field {k!r}: {INTAKE}")
            listed = [v] if isinstance(v, str) else list(v)
            if k == "contrast_variable" and v != "none" and v not in names or k.endswith("_variables") and not set(listed) <= set(names):
                raise ValueError(f"{k}: one of {names}")
            if k == "question_type" and v not in QUESTION_TYPES or k == "downstream_family" and v not in FAMILIES:
                raise ValueError(f"{k}: {v!r} is no answer")
            self.values[k] = listed if k.endswith("_variables") else v
        self.history.append({"at": datetime.now(UTC).isoformat(), "intake": dict(self.values)})
        return self.intake()

    def intake(self) -> dict:
        """With defaults: the contrast is protected, the batch variables are nuisance."""
        contrast = self.values.get("contrast_variable")
        default = {"protected_variables": [contrast] if contrast and contrast != "none" else [], "nuisance_variables": [v["name"] for v in self.first.variables() if v["kind"] == "batch"]}
        return default | self.values

    def answer_question(self, kind: str, value: str) -> None:
        """kind: zeros or floor_censored; value: yes or no."""
        if kind not in ("zeros", "floor_censored") or value not in ("yes", "no"):
            raise ValueError("zeros or floor_censored; yes or no")
        self.answers[kind] = value

    def questions(self) -> list:
        asked = [("processing_state", *q) for q in self.first.questions()]
        facts = self.facts()
        asked += [("zeros", f["block"]) for f in facts if f["zeros_present"] and f["zeros_answer"] is None]
        return asked + [("floor_censored", f["block"]) for f in facts if f["floor_present"] and f["floor_answer"] is None]

    def confirm_processing_state(self, block: str, item: str, value: str) -> None:
        self.first.confirm_processing_state(block, item, value)

    def sample_mapping(self, column: str) -> dict[str, str]:
        rows = self.first.samples.select("sample", F.col(f"`{column}`").cast("string").alias("v")).collect()  # a row per sample
        return {r["sample"]: (r.v or "").strip() for r in rows}

    def qc_samples(self) -> list[str]:
        return [r["sample"] for r in self.first.samples.where("sample_type in ('qc', 'pool')").select("sample").orderBy("sample").collect()]

    # ---------------------------------------------------------------- facts and plan

    def checkpoint(self, sid: str | None = None) -> str:
        """C0 at the root, C1 after an operation before batch correction, C2 after that."""
        steps = [(s["op"] or {}).get("step") for s in self.store.chain(sid)]
        return "C2" if "S2" in steps else "C1" if len(steps) > 1 else "C0"

    def audit_at(self, sid: str) -> Audit:
        if sid not in self.audits:
            a = self.first
            features = a.features.join(self.store.data(sid).select("feature").distinct(), "feature", "left_semi")
            new = Audit(self.store.data(sid), a.samples, features, a.kinds, a.history, self.params, a.overrides, a.controls)
            scales = self.store.meta(sid)["scales"]
            new.scale()
            new.classes |= {b: "continuous_symmetric_or_log_like" for b in new.blocks if scales.get(b) in LOG_SCALES}
            new.state = a.state
            new.run_all(CHECKPOINT[1:])
            self.audits[sid] = new
        return self.audits[sid]

    def _measures(self, check: str, block: str, sid: str) -> dict:
        """The check's measures at sid, or at the nearest state before it; the processing state is always the root's."""
        for s in [self.store.chain(sid)[0]] if check == "A13" else reversed(self.store.chain(sid)):
            a = self.audit_at(s["state_id"])
            for f in a.found.get(check, []):
                if f.block == block:
                    return f.measures
        return {}

    def facts(self, sid: str | None = None) -> list[dict]:
        sid = sid or self.store.head
        self.audit_at(sid)
        meta, intake, out = self.store.meta(sid), self.intake(), []
        contrast = intake.get("contrast_variable")
        alpha = self.first.params["alpha"]
        hit = lambda rows: any(r.get("q") is not None and r["q"] <= alpha for r in rows) if rows else None
        done = {(s["op"]["op"], b) for s in self.store.chain(sid) if s["op"] for b in s["op"]["blocks"]}
        for b in self.first.blocks:
            m = lambda c: self._measures(c, b, sid)  # noqa: E731, B023
            a2, a13, a3, a12, a4, a6, a7, a8, a5, a11 = map(m, ("A2", "A13", "A3", "A12", "A4", "A6", "A7", "A8", "A5", "A11"))
            items = a13.get("items", {})
            effective = {k: v["effective"] for k, v in items.items()}
            ci, enc, pat = (a3.get("mean_sd") or {}).get("ci95"), a12.get("cell_encoding"), a12.get("pattern", {})
            order, shift = a6.get("run_order"), a3.get("median_shift", {})
            rows = a7.get("associations") or []
            relation = (a7.get("relationship") or [{}])[0].get("effect")
            structure = a7.get("structure") or []
            batches = (a7.get("variables") or {}).get("batch") or []
            coverage = a12.get("coverage", {}).get("batch_wide_absent")
            subject = bool((a8.get("design") or {}).get("n_subjects"))
            contrast_rows = [r for r in shift.get("associations") or [] if r["variable"] == contrast]
            out.append({
                "block": b, "state_id": sid, "checkpoint": self.checkpoint(sid), "state_scale": meta["scales"][b], "scale_class": a2.get("class"),
                "log_like": meta["scales"][b] in LOG_SCALES or effective.get("log_transformed") == "yes",
                "log_transformed": effective.get("log_transformed"), "normalized": effective.get("normalized"), "any_unconfirmed": any(v["match"] == "does_not_match" and v["confirmed"] is None for v in items.values()),
                "slope": (a3.get("mean_sd") or {}).get("slope"), "slope_excludes_zero": bool(ci[0] > 0 or ci[1] < 0) if ci else None,
                "g3_n": self.audit_at(sid).cleaning_candidates()[b].select("class").distinct().count(), "zeros_present": bool(enc.get("zero")) if enc is not None else None,
                "zeros_answer": "done" if ("recode_zero_as_missing", b) in done else self.answers.get("zeros"), "floor_present": a4["floor_ties"]["share"] >= self.first.params["floor_tie_share_indicator"] if "floor_ties" in a4 else None,
                "floor_answer": self.answers.get("floor_censored"), "missing_any": enc.get("missing", 0) > 0 if enc is not None else None, "batch_wide_absent": coverage > 0 if coverage is not None else None,
                "missing_intensity": pat.get("intensity_dependence"), "missing_batch": pat.get("batch_association"), "qc_n": sum((a6.get("sample_types") or {}).get(k, 0) for k in ("qc", "pool")),
                "run_order_present": bool(order and order.get("n_used")), "run_order_drift": abs(order["spearman_median"]) >= self.first.params["run_order_rho_indicator"] if order and order.get("spearman_median") is not None else None,
                "qc_drift": order["qc_trend_share"] >= self.first.params["qc_drift_share"] if order and order.get("qc_trend_share") is not None else None, "batch_present": bool(batches),
                "batch_association": hit([r for r in rows if r.get("role") == "batch"]) if rows else None, "batch_small": any(x["below"] for x in a7.get("samples_per_batch") or []), "same_r_above": relation > 0 if relation is not None else None,
                "contrast_confounded": False if contrast == "none" else any(x["code"] == "confounded" and x["design"] == contrast for x in structure) if contrast and structure else None,
                "subject_in_batch": any(x["code"] == "nested" and x["design"] == "subject" for x in structure), "two_confounded": any(x["code"] == "confounded" and x["design"] in batches for x in structure),
                "medians_differ": shift.get("medians_differ"), "median_technical": hit([r for r in shift.get("associations") or [] if r["role"] == "batch"]), "median_contrast": False if contrast == "none" else hit(contrast_rows),
                "n_outliers": len(a11.get("samples") or {}), "subject_present": subject, "n": float(a5["n"]) if "n" in a5 else None, "n_eff": a5.get("n_eff"),
                "contrast_variable": contrast, "protected_variables": intake["protected_variables"], "downstream_family": intake.get("downstream_family"),
                "share_complete": (a12.get("shares") or {}).get("0.0"),
            })
        return out

    def build_plan(self) -> list[dict]:
        """The entries at HEAD, each with candidates whose parameters are filled in."""
        facts = self.spark.createDataFrame([cleaned(f) for f in self.facts()], rules.FACTS)
        entries = [r.asDict(True) for r in rules.plan_entries(facts).orderBy("block", "pos").collect()]  # some per block
        whole = []
        for e in entries:
            for item in self._items(e) or [None]:
                one = e | {"entry": f"{e['block']}:{e['group']}" + (f":{item['name']}" if item else ""), "item": item, "candidates": [dict(c) for c in e["candidates"]]}
                for c in one["candidates"]:
                    c["params"] = self._looked_up(c["params"] or {}) | ({k: item[k] for k in ("ids", "reason")} if item and c["op"] in ("remove_features", "remove_samples") else {})
                whole.append(one)
        self.planned = (self.store.head, whole)
        return whole

    def _items(self, entry: dict) -> list[dict]:
        """What an entry is about, one by one: each class of technical records, each unusual sample, each threshold of completeness. The
        ids are what a person approves to remove, so the plan lists them."""
        b = entry["block"]
        if entry["group"] == "G3":
            rows = self.audit_at(self.store.head).cleaning_candidates()[b].groupBy("class").agg(F.sort_array(F.collect_set("feature")).alias("ids")).orderBy("class").collect()
            return [{"name": r["class"], "ids": list(r["ids"]), "reason": r["class"]} for r in rows]
        if entry["group"] == "S4":
            return [{"name": n, "ids": [n], "reason": ", ".join(why)} for n, why in sorted((self._measures("A11", b, self.store.head).get("samples") or {}).items())]
        if entry["group"] == "S3":
            return [{"name": f"{t}%", "ids": ids, "reason": f"observed in fewer than {t} % of the samples"} for t in M.THRESHOLDS if (ids := self.removed_at(b, t))]
        return []

    def notes(self) -> list[dict]:
        facts = self.spark.createDataFrame([cleaned(f) for f in self.facts()], rules.FACTS)
        return [r.asDict() for r in rules.plan_notes(facts).collect()]

    def _looked_up(self, params: dict[str, str]) -> dict:
        """A candidate's parameters as values: tables of the sample information for their names, numbers for texts that are numbers."""
        kinds = {v["kind"]: v["name"] for v in reversed(self.first.variables())}
        table = {
            "$batch_mapping": lambda: self.sample_mapping(kinds["batch"]) if "batch" in kinds else {},
            "$run_order_mapping": lambda: self.sample_mapping(kinds["run_order"]) if "run_order" in kinds else {},
            "$qc_samples": self.qc_samples,
        }
        number = lambda v: json.loads(v) if re.fullmatch(r"-?\d+(\.\d+)?", v) else v
        return {k: table[v]() if v in table else number(v) for k, v in params.items()}

    def completeness(self, block: str) -> DataFrame:
        """Features kept at each threshold, overall and within the best level of the contrast."""
        study = self.first.samples.where("is_study_sample").select("sample")
        cells = self.store.data().where(F.col("block") == block).join(study, "sample", "left_semi")
        out = M.completeness(cells).withColumnRenamed("n_kept", "n_kept_overall")
        contrast = self.intake().get("contrast_variable")
        if contrast and contrast != "none":
            groups = self.spark.createDataFrame([(s, v) for s, v in self.sample_mapping(contrast).items() if v], "sample string, level string")
            out = out.join(M.completeness(cells, groups).withColumnRenamed("n_kept", "n_kept_within_a_level"), "threshold")
        subjects = self.first.samples.where("is_study_sample and subject <> ''").select("sample", "subject")
        if not subjects.isEmpty():
            out = out.join(M.completeness_by_cluster(cells, subjects).withColumnRenamed("n_kept", "n_kept_by_subject"), "threshold")
        return out

    def removed_at(self, block: str, threshold: float) -> list[str]:
        """The features that a completeness threshold would remove: within the contrast's levels where there is a contrast, else overall."""
        study = self.first.samples.where("is_study_sample").select("sample")
        cells = self.store.data().where(F.col("block") == block).join(study, "sample", "left_semi")
        contrast = self.intake().get("contrast_variable")
        groups = self.spark.createDataFrame([(s, v) for s, v in self.sample_mapping(contrast).items() if v], "sample string, level string") if contrast and contrast != "none" else None
        return [r.feature for r in M.below_threshold(cells, threshold, groups).orderBy("feature").collect()]  # what is to be approved

    def design_constraints(self) -> list[dict]:
        return [{"block": f["block"], "n": f["n"], "n_eff": f["n_eff"], "subject_in_batch": f["subject_in_batch"], "rules": ["batch correction must not absorb subjects", "filtering counts values per subject where there are subjects"]} for f in self.facts()]

    # ---------------------------------------------------------------- decisions

    def approve(self, entry: str, candidate: int = 0, user: str = "you", params: dict | None = None) -> str:
        """Runs a candidate of the current plan. A plan made for another state, and candidates not to be automated, are refused."""
        if self.planned is None or self.planned[0] != self.store.head:
            raise ValueError("the plan is for another state: build it anew")
        e = next((x for x in self.planned[1] if x["entry"] == entry), None)
        if e is None:
            raise KeyError(entry)
        if candidate >= len(e["candidates"]):
            raise ValueError(f"{entry} ({e['status']}) has no such candidate")
        c = e["candidates"][candidate]
        if c["op"] is None or c["status"] not in ("Recommended", "Alternative") and e["step"] != "S4":
            raise ValueError(f"{c['label']}: {c['status']}")
        f = next(x for x in self.facts() if x["block"] == e["block"])
        new = executor.apply(self.store, c["op"], c["params"] | (params or {}), {"user": user, "entry": entry}, e["step"], {"class": f["scale_class"]}, scope=e["block"])
        self.decisions.append({"at": datetime.now(UTC).isoformat(), "entry": entry, "decision": "approve", "op": c["op"], "user": user, "state_id": new})
        return new

    def reject(self, entry: str, reason: str = "", user: str = "you") -> None:
        self.decisions.append({"at": datetime.now(UTC).isoformat(), "entry": entry, "decision": "reject", "reason": reason, "user": user})

    def instrument(self, sid: str) -> list[tuple[str, str, float | None]]:
        """(measure, block, value) of a state, always measured alike: batches and designs in PERMANOVA, correlation within and between classes, control
        features' slopes, QC spread, gaps, complete features, variance within groups, shares of the variance."""
        a, out = self.audit_at(sid), []
        contrast = self.intake().get("contrast_variable")
        for b in self.first.blocks:
            a7, a12 = self._measures("A7", b, sid), self._measures("A12", b, sid)
            out += [(f"permanova r2 {r['variable']}", b, r["r2"]) for r in a7.get("associations") or [] if r["test"] == "permanova"]
            out += [(f"permanova p {r['variable']}", b, r["p"]) for r in a7.get("associations") or [] if r["test"] == "permanova" and r["role"] == "batch"]
            out += [(f"same-batch effect {r['variable']}", b, r["effect"]) for r in a7.get("relationship") or []]
            out += [(f"control slope {f}", b, v) for f, v in sorted((a7.get("controls") or {}).items())]
            out.append(("qc spread", b, self._measures("A6", b, sid).get("qc", {}).get("median")))
            out.append(("gaps", b, float((a12.get("cell_encoding") or {}).get("missing", 0))))
            out.append(("complete features", b, (a12.get("shares") or {}).get("0.0")))
            if contrast and contrast != "none":
                g = self.spark.createDataFrame([(s, v) for s, v in self.sample_mapping(contrast).items() if v], "sample string, level string")
                out.append(("variance within groups", b, M.group_variance(a.diagnostic(b).withColumn("value", F.col("y")), g).agg(F.median("variance").alias("v")).first()["v"]))
            factors = [v["name"] for v in a.variables() if v["role"] == "batch" and not v["numeric"]][:2] + [contrast] * bool(contrast and contrast != "none")
            if factors:
                out += [(f"share of variance {t}", b, v) for t, v in self.variance_components(b, factors, sid, least=0.0).items()]
        return out

    def verify(self, before: str | None = None, after: str | None = None) -> DataFrame:
        """(measure, block, before, after) of two states, by default the root and HEAD. Told, not ranked."""
        ends = {"before": before or self.store.chain()[0]["state_id"], "after": after or self.store.head}
        rows: dict = {}
        for end, sid in ends.items():
            for measure, b, v in self.instrument(sid):
                rows.setdefault((measure, b), {})[end] = v
        return self.spark.createDataFrame([(*k, v.get("before"), v.get("after")) for k, v in rows.items()], "measure string, block string, before double, after double")

    def checkpoints(self) -> dict[str, str]:
        """The states that a verification holds to each other: the root (C0), the last state before batch correction (C1), and HEAD where batches
        have been corrected (C2)."""
        out = {}
        for s in self.store.chain():
            out[self.checkpoint(s["state_id"])] = s["state_id"]
        return out

    def verification(self) -> DataFrame:
        """(checkpoint, state_id, measure, block, value, against_c0, against_c1, control, met): the instrument at every checkpoint, held to
        those before it.

        control names what a measure must show for the correction to have worked: negative ones that batches no longer group samples (p above alpha, no more
        correlation within a batch than between), positive ones that nothing was filled (no fewer gaps removed than features went) and that the QC
        spread didn't grow against C1. met is NULL where there is nothing to hold it to. Checks the plan; never ranks methods.
        """
        at, alpha, rows = self.checkpoints(), self.first.params["alpha"], []
        seen = {c: {(m, b): v for m, b, v in self.instrument(sid)} for c, sid in at.items()}
        for c, sid in at.items():
            for (m, b), v in seen[c].items():
                c0, c1 = seen["C0"].get((m, b)) if c != "C0" else None, seen.get("C1", {}).get((m, b)) if c == "C2" else None
                less = lambda x, v=v: None if v is None or x is None else v - x
                control, met = None, None
                if m.startswith("permanova p "):
                    control, met = "negative", None if v is None else v > alpha
                elif m.startswith("same-batch effect "):
                    control, met = "negative", None if v is None else v <= 0
                elif m == "qc spread" and c1 is not None:
                    control, met = "positive", None if v is None else v <= c1 * (1 + 1e-9)
                elif m == "gaps" and c0 is not None:
                    control, met = "positive", v <= c0 + 1e-9
                rows.append((c, sid, m, b, v, less(c0), less(c1), control, met))
        return self.spark.createDataFrame(rows, "checkpoint string, state_id string, measure string, block string, value double, against_c0 double, against_c1 double, control string, met boolean")

    def variance_components(self, block: str, factors: list[str], sid: str | None = None, least: float = 0.01) -> dict[str, float]:
        """How a state's variance between samples divides among factors, pairs of them ("a:b") and "residual"; where several are under
        `least`, their sum stands for them as "below"."""
        d, _ = self.audit_at(sid or self.store.head).matrix(block)
        maps = {f: self.sample_mapping(f) for f in factors}
        names = sorted({s for m in maps.values() for s in m})
        samples = self.spark.createDataFrame([(s, *(maps[f].get(s) for f in factors)) for s in names], ", ".join(["sample string", *(f"`{f}` string" for f in factors)]))
        shares = {r.term: r.share or 0.0 for r in fits.variance_components(d, samples, factors).collect()}  # a row per term
        small = [t for t, v in shares.items() if v < least]
        return shares if len(small) < 2 else {t: v for t, v in shares.items() if t not in small} | {"below": sum(shares[t] for t in small)}

    def replay(self) -> dict:
        return executor.replay(self.store)

    def states(self) -> DataFrame:
        return self.store.table()

    def save(self, folder: str) -> str:
        """Plan, constraints, decisions, intake and overrides, a JSON text each."""
        parts = {"plan": self.planned[1] if self.planned else None, "design_constraints": self.design_constraints(), "decisions": self.decisions, "intake": {"values": self.intake(), "history": self.history}, "overrides": self.first.overrides}
        rows = [(k, json.dumps(cleaned(v), default=str)) for k, v in parts.items()]
        self.spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").partitionBy("name").text(f"{folder}/study")
        return folder

    def load_overrides(self, folder: str) -> dict[str, str]:
        """The overrides that save() wrote, settled anew."""
        return self.first.load_overrides(f"{folder}/study")
