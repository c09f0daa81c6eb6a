"""The audit: checks that measure and never change data. Each gives findings: a status, sentences and measures, per block.

Cells are read once per audit (persisted); each check is a few aggregates over them. What reaches the driver is a row per block, per
sample or per feature class, or the samples' Gram matrix.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cells as C
from ..operators import fits, spectra
from ..operators import missing as M
from ..operators import stats as T

# Thresholds of the checks.
PARAMS = {
    "sentinel_share": 0.01, "sentinel_min_cells": 3, "min_observed": 3, "median_scaling_mad": 0.5, "narrow_median_spread": 0.05,
    "floor_min_observed": 5, "floor_tie_share_indicator": 0.01, "compositional_cv": 0.001, "abundance_rho_indicator": -0.1,
    "a12_min_level_n": 3, "a12_min_partial_features": 50, "a12_bootstrap": 200, "a12_b1_negligible": 0.1, "a12_batch_absence_share": 0.01,
    "a12_low_abundance_fraction": 0.3333, "a12_feature_permutations": 999, "bootstrap": 999, "sample_median_spread_mad": 0.1,
    "rsd_levels": (20, 30), "run_order_rho_indicator": 0.3, "qc_drift_share": 0.2, "diag_min_features": 20, "diag_min_share": 0.1,
    "diag_sample_missing_max": 0.5, "categorical_max_levels": 20, "time_ordered_max_levels": 12, "max_pcs": 5, "modified_z_cutoff": 3.5,
    "icc_indicator": 0.5, "batch_min_samples": 25, "blank_dominated_ratio": 0.5, "neff_ratio_note": 0.5, "seed": 0, "permutations": 999,
    "exhaustive_max": 10_000, "alpha": 0.05,
}
#: Names of columns that a vendor's quality control makes.
VENDOR = re.compile(r"(?i)(^|[^a-z])(qc|cv|rsd|lod|lloq|loq|detect|call ?rate|missing|score|fdr|q[-_ ]?value|pep|snr|quality|pass|fail)([^a-z]|$)")
#: Of statuses of one kind the worst counts; the neutral ones only where there is no other.
ORDER, NEUTRAL = ("ok", "note", "problem"), ("not_applicable", "not_assessed", "insufficient_data")
BATCH_KINDS, GROUP_KINDS = ("batch", "run_order"), ("subject_id", "timepoint", "group", "sample_type", "covariate")
OUT_OF_SCOPE = ("count_like", "proportion_like", "compositional_like")


def worst(statuses: list[str]) -> str:
    real = [s for s in statuses if s in ORDER]
    return max(real, key=ORDER.index) if real else (statuses[0] if statuses else "not_assessed")


@dataclass
class Finding:
    check: str
    block: str
    status: str = "ok"
    sentences: list[str] = field(default_factory=list)
    measures: dict = field(default_factory=dict)

    def say(self, status: str, sentence: str) -> None:
        self.status = worst([self.status, status]) if status in ORDER else status if self.status not in ORDER[1:] else self.status
        self.sentences.append(sentence)


def cleaned(x):
    """JSON-safe: NaN and infinities as null, numbers to 10 significant digits."""
    if isinstance(x, dict):
        return {str(k): cleaned(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [cleaned(v) for v in x]
    if isinstance(x, np.generic):
        x = x.item()
    return (float(f"{x:.10g}") if math.isfinite(x) else None) if isinstance(x, float) else x


def first(df: DataFrame) -> dict:
    r = df.first()
    return r.asDict() if r else {}


class Audit:
    """cells: block, feature, sample, raw, value. samples: sample, sample_type, is_study_sample, subject, time, run_order and more.
    features: feature, flagged, flag_reason. kinds: sample columns by kind. history: answers per question."""

    def __init__(self, cells: DataFrame, samples: DataFrame, features: DataFrame, kinds: dict[str, str] | None = None, history: dict[str, str] | None = None, params: dict | None = None, overrides: dict | None = None, controls: list[str] | None = None):
        self.spark, self.params = cells.sparkSession, PARAMS | (params or {})
        self.full, self.samples, self.features = cells.persist(), samples.persist(), features
        self.kinds, self.history, self.overrides, self.controls = kinds or {}, history or {}, dict(overrides or {}), controls or []
        self.set = C.audit_set(self.full, samples, features).withColumn("value", S.finite(F.col("value"))).persist()
        self.blocks = [r.block for r in self.full.select("block").distinct().orderBy("block").collect()]
        self.found: dict[str, list[Finding]] = {}
        self.classes: dict[str, str] = {}
        self.state: dict[str, dict] = {}
        self.signs: dict[str, dict] = {}

    @classmethod
    def of(cls, schema, **more) -> Audit:
        """From confirmed decisions; refused while anything is open."""
        schema.need_complete()
        answers = {q: a for said in schema.history_answers.values() for q, a in said.items()}
        return cls(schema.cells(), schema.sample_table(), schema.feature_metadata(), schema.variables(), answers, **more)

    def _keep(self, check: str, findings: list[Finding]) -> list[Finding]:
        for f in findings:
            f.measures = cleaned(f.measures)
        self.found[check] = findings
        return findings

    def _block(self, block: str, full: bool = False) -> DataFrame:
        return (self.full if full else self.set).where(F.col("block") == block)

    def _each(self, check: str, fn) -> list[Finding]:
        """fn per block; blocks whose scale is out of scope are not applicable."""
        out = []
        for b in self.blocks:
            if self.scale_class(b) in OUT_OF_SCOPE:
                out.append(Finding(check, b, "not_applicable", [f"{self.classes[b]} data are out of scope for this check"]))
            else:
                out.append(fn(b))
        return self._keep(check, out)

    def scale_class(self, block: str) -> str:
        if block not in self.classes:
            self.scale()
        return self.classes[block]

    def effective_scale(self, block: str) -> str:
        """linear, log2 or unknown, from what the processing state settles."""
        if not self.state:
            self.processing_state()
        said = self.state[block].get("log_transformed")
        return {"yes": "log2", "no": "linear"}.get(said, "unknown")

    def diagnostic(self, block: str) -> DataFrame:
        linear = self.scale_class(block) == "continuous_linear"
        if linear and block not in self.signs:
            self.signs[block] = first(C.signs(self._block(block)))
        return C.diagnostic_copy(self._block(block), linear, self.signs.get(block))

    def matrix(self, block: str) -> tuple[DataFrame, dict]:
        p = self.params
        return C.default_matrix(self.diagnostic(block), p["diag_min_features"], p["diag_min_share"], sample_missing_max=p["diag_sample_missing_max"])

    def variables(self) -> list[dict]:
        """Sample variables that vary: name, kind, role (batch or design), numeric, and values by study sample (a row per sample)."""
        columns = [c for c in dict.fromkeys([*self.kinds, "subject", "time"]) if c in self.samples.columns]
        rows = self.samples.where("is_study_sample").select("sample", *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).orderBy("sample").collect()
        out = []
        for c in columns:
            kind = {"subject": "subject_id", "time": "timepoint"}.get(c) or self.kinds[c]
            values = {r["sample"]: (r[c] or "").strip() for r in rows}
            said = [v for v in values.values() if v]
            if len(set(said)) < 2 or kind not in (*BATCH_KINDS, *GROUP_KINDS):
                continue
            numeric = kind in ("run_order", "covariate") and all(_is_number(v) for v in said)
            if numeric or len(set(said)) <= self.params["categorical_max_levels"] or kind == "subject_id":
                out.append({"name": c, "kind": kind, "role": "batch" if kind in BATCH_KINDS else "design", "numeric": numeric, "values": values})
        return out

    def _levels(self, v: dict) -> DataFrame:
        return self.spark.createDataFrame(list(v["values"].items()) or [("", "")], "sample string, level string")

    def _associations(self, response: dict[str, float], key: str) -> list[dict]:
        """The samples' numbers against every variable, with q-values over the tests that could be made."""
        names, p = sorted(response), self.params
        subject = next((v["values"] for v in self.variables() if v["kind"] == "subject_id"), None)
        rows = []
        for v in self.variables():
            if v["kind"] == "subject_id":
                continue
            who = [subject.get(n) for n in names] if subject else None
            got = T.association([response[n] for n in names], [v["values"].get(n) for n in names], v["numeric"], who, p["permutations"], p["exhaustive_max"], p["seed"], f"{key}|{v['name']}")
            rows.append({"variable": v["name"], "role": v["role"], **got})
        for r, q in zip(rows, q_values([r.get("p") for r in rows]), strict=True):
            r["q"] = q
        return rows

    # ---------------------------------------------------------------- the checks

    def integrity(self) -> list[Finding]:
        """A1: text that is no number, infinities, repeated or empty features and samples, constants, identical vectors, sentinels."""
        out, p = [], self.params
        for b in self.blocks:
            f, cells = Finding("A1", b), self._block(b, True)
            v, raw = F.col("value"), F.col("raw") if "raw" in cells.columns else F.lit("")
            bad = first(cells.agg(F.count_if(v.isNull() & ~S.is_missing(raw)).alias("no_number"), F.count_if(F.abs(v) == float("inf")).alias("infinite")))
            per = self._block(b).groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            rows = first(per.agg(F.count_if(F.expr(f"n < {p['min_observed']}")).alias("sparse"), F.count_if(F.expr("n >= 2 and lo = hi")).alias("constant"), F.count("*").alias("features")))
            empty = first(self._block(b).groupBy("sample").agg(F.count("value").alias("n")).agg(F.count_if(F.expr("n = 0")).alias("empty_samples")))
            twice = cells.groupBy("feature", "sample").count().where("count > 1").select("feature").distinct().count()
            same = M.identical_vectors(self._block(b), "sample", "feature").count()
            top = first(M.sentinel(self._block(b)))
            f.measures = {**bad, **rows, **empty, "repeated_features": twice, "identical_samples": same, "sentinel": top}
            for k, text in (("no_number", "cells are text that is no number"), ("infinite", "cells are infinite"), ("empty_samples", "samples have no value"), ("repeated_features", "feature ids repeat")):
                if f.measures[k]:
                    f.say("problem", f"{f.measures[k]} {text}")
            for k, text in (("sparse", f"features have fewer than {p['min_observed']} values"), ("constant", "features are constant"), ("identical_samples", "groups of samples are identical")):
                if f.measures[k]:
                    f.say("note", f"{f.measures[k]} {text}")
            if top and top["share"] >= p["sentinel_share"] and top["n"] >= p["sentinel_min_cells"]:
                f.say("note", f"the value {top['value']:g} fills {top['n']} cells: it may stand for something else")
            out.append(f)
        return self._keep("A1", out)

    def scale(self) -> list[Finding]:
        """A2: the scale class, by the first rule that fits."""
        out = []
        for b in self.blocks:
            cells, v = self._block(b), F.col("value")
            facts = first(cells.agg(F.count(v).alias("n"), F.every(v == F.floor(v)).alias("whole"), F.min(v).alias("min"), F.max(v).alias("max"), F.bool_or(v == 0).alias("zeros"), F.percentile(v, F.lit(0.01)).alias("p1"), F.percentile(v, F.lit(0.99)).alias("p99")))
            sums = first(cells.groupBy("sample").agg(F.sum(v).alias("s")).agg(F.try_divide(F.stddev_pop("s"), F.abs(F.avg("s"))).alias("sum_cv")))
            logged = C.diagnostic_copy(cells, True).groupBy("feature").agg(T.skewness(v).alias("a"), T.skewness(F.col("y")).alias("b"))
            skew = first(logged.agg(F.median("a").alias("skew"), F.median("b").alias("skew_log")))
            if not facts["n"]:
                c = "unknown"
            elif facts["whole"] and facts["min"] >= 0:
                c = "count_like"
            elif facts["min"] >= 0 and facts["max"] <= 1:
                c = "proportion_like"
            elif facts["min"] >= 0 and sums["sum_cv"] is not None and sums["sum_cv"] <= self.params["compositional_cv"]:
                c = "compositional_like"
            elif facts["min"] < 0:
                c = "continuous_signed"
            elif None not in skew.values() and abs(skew["skew_log"]) < abs(skew["skew"]):
                c = "continuous_linear"
            else:
                c = "continuous_symmetric_or_log_like"
            self.classes[b] = c
            f = Finding("A2", b, measures={**facts, **sums, **skew, "class": c, "median_scaling": first(M.median_scaling(cells))})
            f.say("not_applicable" if c in OUT_OF_SCOPE else "ok", f"the values look {c.replace('_', ' ')}")
            out.append(f)
        return self._keep("A2", out)

    def processing_state(self) -> list[Finding]:
        """A13: what the user said of the past against what the values show; the effective answer, and the questions left."""
        out, p = [], self.params
        for b in self.blocks:
            c, f = self.scale_class(b), Finding("A13", b)
            floor = first(C.floor_marks(self._block(b), p["floor_min_observed"]).groupBy("feature").agg(F.bool_or("at_floor").alias("t"), F.count("value").alias("n")).where(f"n >= {p['floor_min_observed']}").agg(F.avg(F.col("t").cast("double")).alias("share")))
            share = floor.get("share") or 0.0
            shared = (first(M.median_scaling(self._block(b))).get("mad") or math.inf) < p["median_scaling_mad"]
            spread = first(M.median_shift(self.diagnostic(b).where("y is not null"))).get("mad")
            narrow = spread is not None and spread < p["narrow_median_spread"]
            gaps = not self._block(b).where("value is null").isEmpty()
            items = {}
            for item in ("log_transformed", "normalized", "imputed", "batch_corrected", "features_or_samples_removed_before_upload"):
                said, match = self.history.get(item), "not_assessed"
                if item == "log_transformed" and said in ("yes", "no") and c.startswith("continuous"):
                    match = "matches" if (said == "yes") == (c != "continuous_linear") else "does_not_match"
                elif item == "normalized" and said == "no":
                    match = "does_not_match" if shared or narrow else "matches"
                elif item == "normalized" and said == "yes" and (shared or narrow):
                    match = "matches"
                elif item == "imputed" and said == "no":
                    match = "does_not_match" if share >= p["floor_tie_share_indicator"] else "matches"
                elif item == "imputed" and said == "yes" and (share >= p["floor_tie_share_indicator"] or not gaps):
                    match = "matches"
                sure = self.overrides.get(f"{b}:{item}")
                effective = sure if sure in ("yes", "no") else said if match == "matches" else None
                ask = sure is None and (match == "does_not_match" or item in ("log_transformed", "normalized") and said in (None, "not_sure"))
                items[item] = {"declared": said, "match": match, "confirmed": sure, "effective": effective, "question": ask}
                if ask:
                    f.say("note", f"please confirm: {item.replace('_', ' ')}?")
            self.state[b] = {k: x["effective"] for k, x in items.items()}
            f.measures = {"items": items, "floor_share": share, "shared_median": shared, "median_spread": spread}
            out.append(f)
        return self._keep("A13", out)

    def questions(self) -> list[tuple[str, str]]:
        return [(f.block, k) for f in self.found.get("A13", []) for k, x in f.measures["items"].items() if x["question"]]

    def confirm_processing_state(self, block: str, item: str, value: str) -> None:
        if value not in ("yes", "no"):
            raise ValueError("yes or no")
        self.overrides[f"{block}:{item}"] = value
        self.processing_state()

    def missingness(self) -> list[Finding]:
        """A4: rates per feature and sample, zeros apart, floor ties, and whether low features miss more."""

        def run(b: str) -> Finding:
            f, cells = Finding("A4", b), C.floor_marks(self.diagnostic(b), self.params["floor_min_observed"])
            per = cells.groupBy("feature").agg((1 - F.count("value") / F.count("*")).alias("rate"), F.avg(F.when(~F.col("at_floor"), F.col("y"))).alias("mean"), F.count_if("at_floor").alias("ties"), F.count("value").alias("n"))
            ties = first(per.agg(F.count_if(F.expr("ties > 0")).alias("n_features"), F.count_if(F.expr(f"n >= {self.params['floor_min_observed']}")).alias("n_eligible"), F.sum("ties").alias("n_cells")))
            rho = first(T.spearman(per.where("mean is not null").withColumn("all", F.lit(1)), ["all"], "rate", "mean"))
            f.measures = {"features": first(M.rate_summary(M.rates(cells, ["feature"]))), "samples": first(M.rate_summary(M.rates(cells, ["sample"]))), "zero_share": first(cells.agg((F.count_if(F.col("value") == 0) / F.count("*")).alias("z")))["z"], "floor_ties": {**ties, "share": ties["n_features"] / ties["n_eligible"] if ties["n_eligible"] else 0.0}, "abundance_rho": rho.get("rho")}
            if (rho.get("rho") or 0) <= self.params["abundance_rho_indicator"]:
                f.say("note", f"features of low abundance miss more (rho {rho['rho']:.2f}): consistent with a detection limit")
            if f.measures["floor_ties"]["share"] >= self.params["floor_tie_share_indicator"]:
                f.say("note", f"{ties['n_features']} features have values tied at their minimum")
            return f

        return self._each("A4", run)

    def missingness_profile(self) -> list[Finding]:
        """A12: cell classes, rates by variable, absence in whole batches, the detection curve, feature classes and the pattern; and
        which families of imputation fit, unranked. Nothing is imputed."""

        def run(b: str) -> Finding:
            f, p, cells = Finding("A12", b), self.params, self.diagnostic(b)
            enc = {r.cell_class: r.n for r in M.encoding_counts(cells, p["floor_min_observed"]).collect()}
            shares = {r.at_most: r.share for r in M.missing_shares(cells).collect()}
            batch = next((v for v in self.variables() if v["kind"] == "batch"), None)
            f.measures = {"cell_encoding": enc, "shares": shares, "by_level": {}}
            for v in self.variables():
                if not v["numeric"] and v["kind"] != "subject_id":
                    rows = M.rate_by_level(cells, self._levels(v).withColumn("name", F.lit(v["name"]))).collect()
                    f.measures["by_level"][v["name"]] = {r.level: r.missing_rate for r in rows}
            n = cells.select("sample").distinct().count()
            per = cells.groupBy("feature").agg(F.count("y").alias("d"), F.avg("y").alias("m")).persist()
            absent = self.spark.createDataFrame([], "feature string, absent_levels long, lowest long")
            if batch:
                absent = M.level_coverage(cells, self._levels(batch).withColumnRenamed("level", "batch"), p["a12_min_level_n"]).persist()
                f.measures["coverage"] = first(M.coverage_shares(absent))
            low = first(per.where("d > 0").agg(F.percentile("m", F.lit(p["a12_low_abundance_fraction"])).alias("q")))["q"]
            low = None if low is None else low + 1e-12 * max(1.0, abs(low))  # means that are equal but for their last bits go together
            kind = F.when(F.col("d") == n, "complete").when(F.coalesce(F.col("absent_levels"), F.lit(0)) > 0, "batch_wide_absent").when(F.col("m") <= F.lit(low), "low_abundance_pattern").otherwise("scattered")
            classes = {r.kind: r.n for r in per.join(absent, "feature", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
            f.measures["feature_classes"] = classes
            some = per.where(f"d > 0 and d < {n}").count()
            intensity = "indeterminate"
            if some >= p["a12_min_partial_features"]:
                _, b1, drawn = fits.detection_curve(per.select("feature", F.col("m").alias("mean"), F.col("d").alias("detected")), n, p["a12_bootstrap"], p["seed"])
                lo, hi = fits.interval(drawn)
                inside = -p["a12_b1_negligible"] <= lo and hi <= p["a12_b1_negligible"]
                intensity = "no" if inside else "yes" if lo > 0 or hi < 0 else "indeterminate"
                f.measures["detection_curve"] = {"b1": b1, "ci95": [lo, hi], "n_partial": some}
            per.unpersist()
            absent.unpersist()
            by_batch = "indeterminate"
            if batch:
                share = f.measures["coverage"]["batch_wide_absent"] or 0.0
                hits = self._batch_tests(cells, batch)
                by_batch = "yes" if share > p["a12_batch_absence_share"] or hits else "no"
                f.measures["batch_tests"] = {"n_significant": hits}
            none = not enc.get("missing")
            pattern = "none" if none else "mixed" if intensity == by_batch == "yes" else "mostly_intensity_dependent" if intensity == "yes" else "batch_associated" if by_batch == "yes" else "insufficient_data"
            f.measures["pattern"] = {"pattern_class": pattern, "intensity_dependence": intensity, "batch_association": by_batch}
            total = sum(v for k, v in classes.items() if k != "complete")
            f.measures["imputation_families"] = imputation_families(pattern, by_batch, classes, total)
            f.say("ok" if none else "note", f"missing pattern: {pattern.replace('_', ' ')}")
            return f

        return self._each("A12", run)

    def _batch_tests(self, cells: DataFrame, batch: dict) -> int:
        """Features whose missing cells go with the batch: chi-square against seeded permutations of the samples' labels, Benjamini-Hochberg.
        Features that miss the same samples share a test. The permutations are few numbers per sample; the patterns meet them in their tasks."""
        names = sorted(n for n, v in batch["values"].items() if v)
        codes = np.unique([batch["values"][n] for n in names], return_inverse=True)[1]
        rng = np.random.default_rng([self.params["seed"], 26])
        perms = np.stack([codes] + [rng.permutation(codes) for _ in range(self.params["a12_feature_permutations"])])
        levels, sizes = codes.max() + 1, np.bincount(codes).astype(float)
        hot = np.concatenate([perms == k for k in range(levels)]).astype(np.float32).T  # samples x (levels x permutations)
        at_once = max(1, (1 << 18) // hot.shape[1])
        at = self.spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample string, i int")  # a row per sample
        gaps = cells.where("y is null").join(F.broadcast(at), "sample", "left").groupBy("feature").agg(F.array_sort(F.collect_list("i")).alias("gone"))

        def test(batches):
            import pyarrow as pa

            for pattern in batches:
                lengths, gone = pattern["gone"].value_lengths().to_numpy(), pattern["gone"].flatten().to_numpy()
                missed = np.zeros((len(lengths), len(names)), np.float32)
                missed[np.repeat(np.arange(len(lengths)), lengths), gone] = 1
                total, p = missed.sum(axis=1), np.ones(len(lengths))
                some = np.flatnonzero((total > 0) & (total < len(names)))
                for rows in np.split(some, range(at_once, len(some), at_once)):
                    share = (total[rows] / len(names)).astype(float)[:, None, None]
                    expect = share * len(names) * sizes[:, None] / len(names)
                    chi = (((missed[rows] @ hot).reshape(len(rows), levels, -1) - expect) ** 2 / (expect * (1 - share))).sum(axis=1)
                    p[rows] = (1 + (chi[:, 1:] >= chi[:, :1] - 1e-9).sum(axis=1)) / chi.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(p), pattern["n"]], ["p", "n"])

        tests = gaps.groupBy("gone").agg(F.count("*").alias("n")).mapInArrow(test, "p double, n long").persist()
        hits = T.bh(tests, n="n").where(F.col("q") <= self.params["alpha"]).agg(F.sum("n")).first()[0]
        tests.unpersist()
        return hits or 0

    def distribution(self) -> list[Finding]:
        """A3: how spread grows with the mean, skewness, and whether sample medians differ and with what."""

        def run(b: str) -> Finding:
            f, p, y = Finding("A3", b), self.params, self.diagnostic(b)
            per = self._block(b).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).where("n >= 3 and m > 0 and s > 0").select("feature", F.ln("m").alias("x"), F.ln("s").alias("y"))
            if self.scale_class(b) == "continuous_linear" and per.count() >= 10:
                slope, drawn = fits.slopes(per, "x", "y", n=p["bootstrap"], seed=p["seed"])
                f.measures["mean_sd"] = {"slope": slope, "ci95": list(fits.interval(drawn))}
            spread = y.groupBy("feature").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).where("s is not null").withColumn("all", F.lit(1))
            f.measures["spearman_rho"] = first(T.spearman(spread, ["all"], "m", "s")).get("rho")
            profile = {r["sample"]: r["median"] for r in M.sample_profile(y.where("y is not null")).collect()}  # a row per sample
            mad = first(M.median_shift(y.where("y is not null"))).get("mad")
            rows = self._associations(profile, f"A3|{b}")
            f.measures["median_shift"] = {"mad": mad, "medians_differ": mad is not None and mad >= p["sample_median_spread_mad"], "associations": rows}
            for r in rows:
                if r["q"] is not None and r["q"] <= p["alpha"]:
                    f.say("note", f"sample medians go with {r['variable']} (q {r['q']:.3g})")
            return f

        return self._each("A3", run)

    def quality(self) -> list[Finding]:
        """A6: QC repeatability, blanks, run-order drift, samples against the median profile, flagged features against the others."""

        def run(b: str) -> Finding:
            f, p = Finding("A6", b), self.params
            linear = self.scale_class(b) == "continuous_linear"
            kinds = {r.sample_type: r.n for r in self.samples.groupBy("sample_type").agg(F.count("*").alias("n")).collect()}
            plain = self._block(b, True).join(self.features.where("flagged").select("feature"), "feature", "left_anti")
            qc = M.qc_spread(plain, self.samples.where("sample_type in ('qc', 'pool')").select("sample"), linear)
            f.measures = {"sample_types": kinds, "qc": first(qc.agg(F.count("*").alias("n"), F.median("spread").alias("median"), *(F.avg((F.col("spread") > x).cast("double")).alias(f"above_{x}") for x in p["rsd_levels"])))}
            if kinds.get("blank") and linear:
                f.measures["blank_ratio"] = first(M.blank_ratio(plain, self.samples).agg(F.median("ratio").alias("median")))
            order = next((v for v in self.variables() if v["kind"] == "run_order" and v["numeric"]), None)
            y = self.diagnostic(b)
            if order:
                o = self.spark.createDataFrame([(s, float(v)) for s, v in order["values"].items() if v], "sample string, run_order double")
                med = y.groupBy("sample").agg(F.median("y").alias("m")).join(o, "sample").orderBy("run_order").toArrow()  # a row per sample
                x, m = med["run_order"].to_numpy(), med["m"].to_numpy()
                fit = T.local_regression(x, m, degree=1)
                rho = first(T.spearman(self.spark.createDataFrame([(1, float(a), float(c)) for a, c in zip(x, m, strict=True)], "all int, a double, c double"), ["all"], "a", "c")).get("rho")
                f.measures["run_order"] = {"n_used": len(x), "spearman_median": rho, "slope": float(np.polyfit(x, m, 1)[0]) if len(x) > 1 else None, "lowess_range": float(np.nanmax(fit) - np.nanmin(fit)) if len(x) else None}
                if rho is not None and abs(rho) >= p["run_order_rho_indicator"]:
                    f.say("note", f"sample medians drift with run order (rho {rho:.2f})")
                every = self.samples.where("sample_type in ('qc', 'pool')").select("sample", F.col(f"`{order['name']}`").try_cast("double").alias("run_order")).where("run_order is not null")
                if every.count() >= 4:
                    t = T.spearman(plain.join(every, "sample"), ["feature"], "value", "run_order", 4)
                    f.measures["run_order"]["qc_trend_share"] = first(t.where("rho is not null").agg(F.avg((F.abs("rho") > 0.5).cast("double")).alias("s")))["s"]
            middle = y.groupBy("feature").agg(F.median("y").alias("mid"), F.count("y").alias("n"), F.count("*").alias("of")).where("n = of").select("feature", "mid")
            r = y.join(middle, "feature").groupBy("sample").agg(T.correlation(F.col("y"), F.col("mid")).alias("r"))
            low = r.where("r is not null").agg(F.min("r").alias("r"), F.min_by("sample", "r").alias("sample"))
            f.measures["lowest_profile_r"] = first(low)
            f.measures["vendor_qc"] = self.vendor_columns()
            flagged = self._block(b, True).join(self.features.select("feature", "flagged"), "feature").groupBy("flagged").agg(F.count_distinct("feature").alias("n"), F.median("value").alias("median"), (1 - F.count("value") / F.count("*")).alias("missing"))
            f.measures["flagged"] = {str(x.flagged): [x.n, x.median, x.missing] for x in flagged.collect()}
            return f

        return self._each("A6", run)

    def vendor_columns(self) -> dict[str, dict]:
        """Feature columns that a vendor's own quality control made, by their names: a summary of numbers, or the 20 most common texts."""
        out = {}
        for c in self.features.columns:
            if c in ("feature", "feature_idx", "flagged", "flag_reason") or not VENDOR.search(c):
                continue
            number = S.number(F.col(f"`{c}`").cast("string"))
            got = first(self.features.select(number.alias("v")).agg(*T.summary("v")))
            if got.get("n"):
                out[c] = got
            else:
                top = self.features.groupBy(S.stripped(F.col(f"`{c}`").cast("string")).alias("t")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(20)
                out[c] = {"levels": {r.t: r.n for r in top.collect()}}
        return out

    def load_overrides(self, path: str) -> dict[str, str]:
        """What a study saved as its overrides, read back; the processing state is settled anew."""
        said = self.spark.read.text(path).where("name = 'overrides'").first()
        self.overrides |= {k: v for k, v in json.loads(said["value"]).items() if v in ("yes", "no")}
        self.processing_state()
        return self.overrides

    def batch_structure(self) -> list[Finding]:
        """A7: how batches and design meet, batch sizes, principal components and PERMANOVA against variables, and same-batch correlation."""

        def run(b: str) -> Finding:
            f, p, vs = Finding("A7", b), self.params, self.variables()
            batches, design = [v for v in vs if v["role"] == "batch" and not v["numeric"]], [v for v in vs if v["role"] == "design" and not v["numeric"]]
            f.measures["variables"] = {"batch": [v["name"] for v in batches], "run_order": [v["name"] for v in vs if v["kind"] == "run_order"]}
            f.measures["structure"] = []
            for one in batches:
                for two in [*design, *(x for x in batches if x["name"] > one["name"])]:
                    t = self._levels(one).withColumnRenamed("level", "b").join(self._levels(two).withColumnRenamed("level", "d"), "sample").where("b <> '' and d <> ''")
                    if not t.isEmpty():
                        f.measures["structure"].append({"batch": one["name"], "design": two["name"], "code": T.design_structure(t, "b", "d").first().structure, "v": first(T.cramers_v(t, "b", "d"))["v"]})
                sizes = list(np.unique([x for x in one["values"].values() if x], return_counts=True)[1])
                f.measures.setdefault("samples_per_batch", []).append({"variable": one["name"], "min": int(min(sizes)), "below": bool(min(sizes) < p["batch_min_samples"])})
            d, report = self.matrix(b)
            f.measures["matrix"] = report
            if report["n_features_used"] >= 2:
                features = spectra.Features(d)
                names, (scores, shares) = features.names, spectra.components(features, p["max_pcs"])
                f.measures["pca"] = {"shares": shares.tolist()}
                rows = []
                for v in vs:
                    use = [i for i, n in enumerate(names) if v["values"].get(n)]
                    if v["kind"] == "subject_id" or len(use) < 4 or len({v["values"][names[i]] for i in use}) < 2:
                        continue
                    sub = features if len(use) == len(names) else features.only(use)
                    said = [v["values"][names[i]] for i in use]
                    codes = np.array([float(x) for x in said]) if v["numeric"] else np.unique(said, return_inverse=True)[1]
                    plan = T.exchange(codes, None, p["permutations"], p["exhaustive_max"], p["seed"], f"A7|{b}|{v['name']}")
                    r2, stat = spectra.permanova(sub, np.vstack([codes, plan.of(codes)]), v["numeric"])
                    pv, least = plan.p_value(stat[1:], float(stat[0]))
                    rows.append({"variable": v["name"], "role": v["role"], "test": "permanova", "r2": float(r2[0]), "f": float(stat[0]), "p": pv, "p_min": least})
                features.close()
                for j in range(scores.shape[1]):
                    for r in self._associations(dict(zip(names, scores[:, j].tolist(), strict=True)), f"A7|{b}|PC{j + 1}"):
                        rows.append({**r, "test": f"PC{j + 1} {r['test']}"})
                for r, q in zip(rows, q_values([r.get("p") for r in rows]), strict=True):
                    r["q"] = q
                f.measures["associations"] = rows
                hits = sorted({r["variable"] for r in rows if r["role"] == "batch" and r["q"] is not None and r["q"] <= p["alpha"]})
                if hits:
                    f.say("note", f"samples go with {', '.join(hits)}")
            pairs = T.sample_pairs(self.diagnostic(b)).persist()
            for v in batches:
                r = {x.same: x.median_r for x in T.relationship(pairs, self._levels(v)).collect()}
                if r.get(True) is not None and r.get(False) is not None:
                    f.measures.setdefault("relationship", []).append({"variable": v["name"], "same": r[True], "different": r[False], "effect": r[True] - r[False]})
            pairs.unpersist()
            if self.controls and (order := next((v for v in vs if v["kind"] == "run_order"), None)):
                o = self.spark.createDataFrame([(s, float(x)) for s, x in order["values"].items() if x], "sample string, run_order double")
                c = self.spark.createDataFrame([(x,) for x in self.controls], "feature string")
                f.measures["controls"] = {r.feature: r.slope for r in M.control_trend(self._block(b, True), c, o).collect()}
            return f

        return self._each("A7", run)

    def sensitivity(self, block: str, variable: str) -> dict:
        """Whether PERMANOVA's answer for a variable depends on how gaps and floors are treated; no variant is preferred."""
        v = next(x for x in self.variables() if x["name"] == variable)

        def conclude(d: DataFrame) -> str | None:
            features = spectra.Features(d)
            said = [v["values"].get(n) or "" for n in features.names]
            if len(said) < 4 or "" in said or len(set(said)) < 2:
                return features.close()
            codes = np.array([float(x) for x in said]) if v["numeric"] else np.unique(said, return_inverse=True)[1]
            plan = T.exchange(codes, None, self.params["permutations"], self.params["exhaustive_max"], self.params["seed"], f"sensitivity|{block}|{variable}")
            _, stat = spectra.permanova(features, np.vstack([codes, plan.of(codes)]), v["numeric"])
            features.close()
            p, _ = plan.p_value(stat[1:], float(stat[0]))
            return "associated" if p <= self.params["alpha"] else "not associated"

        return C.sensitivity(C.variants(self.diagnostic(block), self.params["floor_min_observed"]), conclude)

    def repeated_measures(self) -> list[Finding]:
        """A8: subjects and times, what is constant within a subject, and how much of the variance lies between subjects."""

        def run(b: str) -> Finding:
            f = Finding("A8", b)
            s = self.samples.where("is_study_sample").select("sample", "subject", "time")
            facts = first(M.cluster_facts(s))
            if not facts.get("n_subjects") or facts["largest"] < 2:
                return Finding("A8", b, "not_applicable", ["no subject has several samples"])
            icc = T.icc1(self.diagnostic(b).join(s, "sample").where("subject <> ''"), "feature", "subject", "y")
            mid = first(icc.agg(F.median("icc").alias("m"), F.count("icc").alias("n")))
            f.measures = {"design": facts, "icc": mid, "constant_within_subject": {v["name"]: first(M.constant_within(self._levels(v).join(s.select("sample", "subject"), "sample").where("subject <> ''"), "subject", "level"))["constant"] for v in self.variables() if v["kind"] != "subject_id"}}
            if (mid["m"] or 0) >= self.params["icc_indicator"]:
                f.say("note", f"samples of a subject are alike (median ICC {mid['m']:.2f})")
            return f

        return self._each("A8", run)

    def dimensionality(self) -> list[Finding]:
        """A5: features and samples, the smallest cell of the design, sparsity, and the effective number of samples."""
        if "A8" not in self.found:
            self.repeated_measures()

        def run(b: str) -> Finding:
            f, cells = Finding("A5", b), self._block(b)
            base = first(cells.agg(F.count_distinct("feature").alias("p"), F.count_distinct("sample").alias("n"), (1 - F.count("value") / F.count("*")).alias("sparsity")))
            groups = [v for v in self.variables() if v["kind"] == "group"]
            cell = min((int(np.unique([x for x in v["values"].values() if x], return_counts=True)[1].min()) for v in groups), default=None)
            a8 = next((x.measures for x in self.found["A8"] if x.block == b), {})
            f.measures = {**base, "smallest_cell": cell}
            if icc := (a8.get("icc") or {}).get("m"):
                m = base["n"] / a8["design"]["n_subjects"]
                deff = 1 + (m - 1) * max(0.0, icc)
                f.measures |= {"design_effect": deff, "n_eff": base["n"] / deff}
                if 1 / deff < self.params["neff_ratio_note"]:
                    f.say("note", f"{base['n']} samples count as about {base['n'] / deff:.1f}")
            return f

        return self._each("A5", run)

    def outliers(self) -> list[Finding]:
        """A11: samples far from the median profile or extreme on the first components, and the most extreme cells."""

        def run(b: str) -> Finding:
            f, cut, y = Finding("A11", b), self.params["modified_z_cutoff"], self.diagnostic(b)
            d, report = self.matrix(b)
            f.measures["matrix"] = report
            flagged: dict[str, list[str]] = {}
            if report["n_features_used"] >= 2:
                mid = d.groupBy("feature").agg(F.median("y").alias("mid"))
                far = {r["sample"]: r.d for r in d.join(mid, "feature").groupBy("sample").agg(F.sqrt(F.sum(F.pow(F.col("y") - F.col("mid"), F.lit(2.0)))).alias("d")).collect()}  # a row per sample
                features = spectra.Features(d)
                names, (scores, _) = features.names, spectra.components(features, 2)
                features.close()
                for label, values, two_sided in [("distance", [far[n] for n in names], False), *((f"PC{j + 1}", scores[:, j], True) for j in range(scores.shape[1]))]:
                    for n, z in zip(names, modified_z(values), strict=True):
                        if (abs(z) if two_sided else z) > cut:
                            flagged.setdefault(n, []).append(label)
            z = T.with_modified_z(y, ["feature"], "y").where(F.abs("z") > cut)
            f.measures |= {"samples": flagged, "n_cells": z.count(), "cells": [[r.feature, r["sample"], r.z] for r in z.orderBy(F.abs("z").desc(), "feature", "sample").limit(50).collect()]}
            order = next((v for v in self.variables() if v["kind"] == "run_order" and v["numeric"]), None)
            if flagged and order:
                known = sorted((float(v), n) for n, v in order["values"].items() if v)
                f.measures["in_run_order"] = T.clustered_in_order([n in flagged for _, n in known], [x for x, _ in known], self.params["permutations"], self.params["seed"])
            if flagged:
                f.say("note", f"unusual samples: {', '.join(sorted(flagged))}")
            return f

        return self._each("A11", run)

    def cleaning_candidates(self) -> dict[str, DataFrame]:
        """G3: (class, feature) per block: flagged, all missing, no variance, too few values, mostly blank. Removed only after approval."""
        out = {}
        for b in self.blocks:
            cells = self._block(b, True)
            per = cells.join(self.samples.where("is_study_sample").select("sample"), "sample", "left_semi").groupBy("feature").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
            blank = M.blank_ratio(cells, self.samples)
            kinds = F.array_compact(F.array(
                F.when(F.col("flagged"), F.concat(F.lit("flagged: "), F.col("flag_reason"))), F.when(F.col("n") == 0, F.lit("all_missing")), F.when(F.col("sd") == 0, F.lit("sd_zero")),
                F.when((F.col("n") > 0) & (F.col("n") < 3), F.lit("fewer_than_3")), F.when(F.col("ratio") >= self.params["blank_dominated_ratio"], F.lit("blank_dominated")),
            ))
            out[b] = per.join(self.features.select("feature", "flagged", "flag_reason"), "feature", "left").join(blank, "feature", "left").select(F.explode(kinds).alias("class"), "feature")
        return out

    def run_all(self, checks: tuple[str, ...] | None = None) -> DataFrame:
        """The battery in order: what a later check needs comes first."""
        battery = {"A1": self.integrity, "A2": self.scale, "A13": self.processing_state, "A3": self.distribution, "A6": self.quality, "A4": self.missingness, "A12": self.missingness_profile, "A7": self.batch_structure, "A8": self.repeated_measures, "A5": self.dimensionality, "A11": self.outliers}
        for name, run in battery.items():
            if checks is None or name in checks:
                run()
        return self.summary()

    def summary(self) -> DataFrame:
        rows = [(f.check, f.block, f.status, "; ".join(f.sentences)) for fs in self.found.values() for f in fs]
        return self.spark.createDataFrame(rows, "check string, block string, status string, sentence string")

    def measures(self) -> DataFrame:
        """(check, block, path, value, text): every measure, flat."""
        rows = []

        def walk(f, path, x):
            if isinstance(x, dict):
                for k, v in x.items():
                    walk(f, f"{path}.{k}" if path else str(k), v)
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    walk(f, f"{path}[{i}]", v)
            else:
                number = isinstance(x, (int, float)) and not isinstance(x, bool)
                rows.append((f.check, f.block, path, float(x) if number else None, None if number or x is None else str(x)))

        for f in [f for fs in self.found.values() for f in fs]:
            walk(f, "", f.measures)
        return self.spark.createDataFrame(rows, "check string, block string, path string, value double, text string")

    def to_dict(self) -> list[dict]:
        return [asdict(f) for fs in self.found.values() for f in fs]


#: The checks at each checkpoint after the first.
CHECKPOINT = ("A2", "A3", "A6", "A4", "A12", "A7", "A8", "A5", "A11")


@dataclass(frozen=True)
class Family:
    """Methods that fill gaps in one way: why they may fit, what speaks for them and what to mind."""

    name: str
    methods: tuple[str, ...]
    fits: str
    level: str
    evidence: str
    caveat: str
    takes_batch_wide_gaps: bool = False


FAMILIES = (
    Family("left_censored", ("min_prob", "half of the minimum", "quantile regression of the left tail"), "gaps depend on intensity", "literature_independent", "values below a detection limit are low ones", "lowers variance among low values, and misleads where gaps are scattered"),
    Family("local_similarity", ("knn", "local least squares"), "most gaps are scattered", "literature_independent", "features that move together tell each other's values", "draws low values up where gaps depend on intensity; needs neighbours that were seen"),
    Family("global_structure", ("principal components", "singular value thresholding"), "most gaps are scattered, and few components hold the variance", "literature_independent", "samples lie near a few components", "the number of components decides; batches are components too"),
    Family("mixed_by_class", ("min_prob for low features, knn for the others",), "gaps depend on intensity and on batches", "expert_guidance", "each feature class has gaps of its own kind", "the border between classes is drawn by a threshold"),
    Family("within_batch", ("any of these, batch by batch, after correction",), "gaps go with batches, or features are absent from whole batches", "literature_independent", "values of another batch carry its shift", "features absent from a whole batch stay absent: nothing there can tell"),
    Family("random_forest", ("iterated trees over features",), "most gaps are scattered, and there are few features", "literature_independent", "takes dependence of any form", "slow for many features; flattens extremes"),
    Family("model_without_imputation", ("mixed models", "hurdle models", "rank tests on what is observed"), "always", "expert_guidance", "the later model can take gaps itself", "compares only what was observed, unless it models the gaps", True),
)


def imputation_families(pattern: str, by_batch: str, classes: dict[str, int], total: int) -> list[dict]:
    """What a method-selection stage may look at: every family, with what speaks for and against it and whether it fits the profile. Listed in a fixed
    order, never ranked or run here; nothing where nothing is missing."""
    scattered = total > 0 and classes.get("scattered", 0) / total > 0.5
    batches = by_batch == "yes" or classes.get("batch_wide_absent", 0) > 0
    fits = {
        "left_censored": pattern in ("mostly_intensity_dependent", "mixed"), "local_similarity": scattered, "global_structure": scattered, "mixed_by_class": pattern == "mixed",
        "within_batch": batches, "random_forest": scattered, "model_without_imputation": True,
    }
    return [] if pattern == "none" else [{**asdict(f), "methods": list(f.methods), "fits_profile": fits[f.name]} for f in FAMILIES]


def modified_z(values) -> np.ndarray:
    x = np.asarray(values, float)
    dev = x - np.median(x)
    mad, mean = np.median(np.abs(dev)), np.abs(dev).mean()
    return 0.6745 * dev / mad if mad > 0 else dev / (1.253314 * mean) if mean > 0 else dev * 0


def q_values(ps: list[float | None]) -> list[float | None]:
    """Benjamini-Hochberg over a few tests on the driver; None stays None."""
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None and p == p)
    out: list[float | None] = [None] * len(ps)
    low = 1.0
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        low = min(low, p * len(known) / rank)
        out[i] = low
    return out


def _is_number(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False
