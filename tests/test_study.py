"""From text files to a replayable study, on tables with planted properties."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import fits, stats, transforms
from assayloom.plans import audit, executor, registry, rules
from assayloom.plans import schema as schemas
from assayloom.plans.audit import Audit, worst
from assayloom.plans.digest import digest
from assayloom.plans.grouping import checked
from assayloom.plans.layout import propose_layout
from assayloom.plans.proposer import ByRules, Falling, Mock, ProposerError
from assayloom.plans.study import Study
from assayloom.sources import delimited
from assayloom.sources.states import StateStore, content_hash


def write(path, rows, sep=","):
    path.write_text("\n".join(sep.join(map(str, r)) for r in rows) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """120 features x 16 study samples and 3 QC: plate B is doubled, low features miss more, one feature is a flagged control."""
    rng, d = np.random.default_rng(11), tmp_path_factory.mktemp("planted")
    names = [f"S{j:02}" for j in range(16)] + ["QC_1", "QC_2", "QC_3"]
    base = rng.normal(12, 2, 120)
    x = 2 ** (base[:, None] + rng.normal(0, 0.3, (120, 19)))
    plate = np.array(["A", "B"] * 8 + ["A", "B", "A"])
    x[:, plate == "B"] *= 2
    x[rng.random(x.shape) < 1 / (1 + np.exp(1.5 * (base[:, None] - 9.5)))] = np.nan
    rows = [["SeqId", "Type", *names]] + [[f"P{i:03}", "Control" if i == 119 else "Protein", *("" if v != v else repr(float(v)) for v in r)] for i, r in enumerate(x)]
    info = [["Sample", "Plate", "RunOrder", "Group"]] + [[n, plate[j], j + 1, ["case", "control"][(j // 2) % 2]] for j, n in enumerate(names)]
    return write(d / "data.csv", rows), write(d / "info.tsv", info, "\t"), d


def decided(spark, planted):
    s = schemas.from_layout(propose_layout(delimited.read(spark, planted[0])))
    for step in (s.confirm_all, s.confirm_layout, s.confirm_feature_id, s.confirm_values):
        step()
    s.flag_rows("Type", prefixes=["Control"])
    s.confirm_flags()
    assert s.set_sample_type("QC*", "qc") == 3
    s.confirm_samples()
    assert s.add_sample_info(planted[1]) == {"matched": 19, "only_samples": 0, "only_info": 0, "repeated": 0}
    for c, k in (("Plate", "batch"), ("RunOrder", "run_order"), ("Group", "group")):
        s.set_info_column(c, k)
    s.confirm_sample_info()
    s.confirm_design()
    s.answer_history(normalized="no", log_transformed="no", imputed="no", batch_corrected="no", features_or_samples_removed_before_upload="no")
    return s


def test_text_is_kept(spark, tmp_path):
    t = delimited.read(spark, write(tmp_path / "a.csv", [["ID", "Gene", "S1", "S2"], ["001", "1E5", "1.5", "NA"], ["002", "MARCH1", "", "3"], ["003", "x", "2", "4"]]))
    assert [tuple(r) for r in t.data.orderBy(delimited.ROW).select("ID", "Gene", "S1", "S2").collect()][0] == ("001", "1E5", "1.5", "NA")
    facts = t.facts
    assert [facts[c]["kind"] for c in t.names] == ["numeric", "text", "numeric", "numeric"] and facts["S1"]["n_missing"] == facts["S2"]["n_missing"] == 1
    assert facts["Gene"]["example"] == "1E5" and t.shape == (3, 4) and "comma" in t.describe()


@pytest.mark.parametrize("sep", ["\t", ";", ","])
def test_delimiters(spark, tmp_path, sep):
    assert delimited.read(spark, write(tmp_path / "a.txt", [["id", "x"], ["a", 1], ["b", 2]], sep)).delimiter == sep


def test_layouts(spark, tmp_path):
    rows = [["ID", "Group", *(f"L_{k}" for k in range(50))]] + [[f"s{i}", i % 2, *np.arange(50) * 0.1 + i] for i in range(20)]
    lay = propose_layout(delimited.read(spark, write(tmp_path / "a.csv", rows)))
    assert lay.orientation == "samples_in_rows" and lay.id_column == "ID" and lay.annotations == ("Group",)
    cells = lay.cells()
    assert cells.count() == 1000 and cells.where("feature = 'L_3' and sample = 's4'").first().value == pytest.approx(4.3)
    assert lay.set(annotations=["Group", "L_0"]).roles()["L_0"] == "annotation"
    with pytest.raises(ValueError):
        lay.set(id_column="nope")


def test_long_tables(spark, tmp_path):
    rows = [["SampleID", "OlinkID", "NPX"], ["s1", "o1", 1.5], ["s2", "o1", -2], ["s1", "o2", 3]]
    table = delimited.read(spark, write(tmp_path / "a.csv", rows))
    s = schemas.Schema(table, checked(table, {"layout": "long", "groups": [{"columns": ["SampleID"], "role": "sample_id"}, {"columns": ["OlinkID"], "role": "feature_id"}, {"columns": ["NPX"], "role": "value"}]}))
    got = {(r.feature, r["sample"]): r.value for r in s.cells().collect()}
    assert got == {("o1", "s1"): 1.5, ("o1", "s2"): -2, ("o2", "s1"): 3, ("o2", "s2"): None} and s.sample_names() == ["s1", "s2"]
    twice = delimited.read(spark, write(tmp_path / "b.csv", [*rows, ["s1", "o1", 9]]))
    with pytest.raises(ValueError, match="o1 / s1"):
        schemas.Schema(twice, checked(twice, {"layout": "long", "groups": [{"columns": ["SampleID"], "role": "sample_id"}, {"columns": ["OlinkID"], "role": "feature_id"}, {"columns": ["NPX"], "role": "value"}]})).cells()


def test_digest_holds_no_rows(spark, planted):
    table = delimited.read(spark, planted[0])
    d = digest(table, propose_layout(table))
    assert [t["template"] for t in d["templates"]] == ["S#", "QC_#"] and "P005" not in json.dumps(d)
    assert {c["name"]: c.get("values") for c in d["columns"]}["Type"] == [{"value": "Protein", "n": 119}, {"value": "Control", "n": 1}]
    assert "values" not in json.dumps(digest(table, None, examples=False))


def test_answers_are_checked(spark, planted):
    table = delimited.read(spark, planted[0])
    g = checked(table, {"layout": "sideways", "groups": [{"columns": ["S#"], "role": "value", "label": "v"}, {"columns": ["QC_#", "S01"], "role": "value", "label": "v"}, {"columns": ["Nope"], "role": "king"}]})
    assert g.layout is None and len(g.rejected) == 4 and [x.role for x in g.groups] == ["unresolved", "unresolved", "value"] and len(g.groups[2].columns) == 19
    s = schemas.start(table, Mock({"layout": "samples_in_columns", "groups": [{"columns": ["S#", "QC_#"], "role": "value"}]}))
    new = s.split("g3", ["QC_1"], role="ignore")
    assert s.group(new).columns == ("QC_1",) and s.merge("g3", new, role="value") == "g3" and len(s.group("g3").columns) == 19
    with pytest.raises(ValueError):
        s.confirm("g1")
    assert {g["role"] for g in schemas.start(table, ByRules()).groups()} == {"feature_id", "feature_annotation", "value"}


def test_proposers_fall_back():
    waits, calls = [], []

    def ask(model, *_):
        calls.append(model)
        if model == "a":
            raise ProposerError("busy", 429, 2.0) if len(calls) < 3 else ProposerError("gone", 404)
        return {"ok": 1}

    assert Falling(ask, ["a", "b"], waits.append).ask("", "", {}) == {"ok": 1} and waits == [2.0, 2.0] and calls == ["a", "a", "a", "b"]


def test_saved_decisions(spark, planted, tmp_path):
    s = decided(spark, planted)
    assert s.todo() == []
    s.save(str(tmp_path / "out"))
    manifest = s.export(str(tmp_path / "csv"))
    assert manifest["n_features"] == {"A1B1": 120} and manifest["n_samples"] == 19 and manifest["n_flagged"] == 1 and "value_matrix_A1_B1" in manifest["files"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/value_matrix_A1_B1")).count() == 120
    assert s.units() == {"A1B1": "A1"} and s.assays_table().count() == 1 and {r["column"]: r.n for r in s.flag_counts().collect()} == {"Type": 1}
    again, warnings = schemas.load(str(tmp_path / "out"), delimited.read(spark, planted[0]))
    assert again.todo() == [] and warnings == [] and again.sample_table().where("sample_type = 'qc'").count() == 3
    assert spark.read.parquet(str(tmp_path / "out/features")).where("flagged").collect()[0].feature == "P119"
    s.unflag("Type")
    s.layout_confirmed = False
    with pytest.raises(ValueError, match="layout"):
        s.save(str(tmp_path / "no"))


@pytest.fixture(scope="module")
def study(spark, planted):
    st = Study(decided(spark, planted), str(planted[2] / "states"), {"a12_bootstrap": 30, "bootstrap": 99, "permutations": 199})
    st.audit()
    return st


def test_audit_sees_what_was_planted(study):
    a = study.first
    assert a.classes == {"A1B1": "continuous_linear"} and a.effective_scale("A1B1") == "linear"
    one = lambda c: a.found[c][0].measures
    assert one("A4")["abundance_rho"] < -0.4 and one("A12")["pattern"]["intensity_dependence"] == "yes"
    assert one("A12")["detection_curve"]["b1"] == pytest.approx(1.5, abs=0.5)
    batch = [r for r in one("A7")["associations"] if r["variable"] == "Plate" and r["test"] == "permanova"][0]
    assert batch["r2"] > 0.3 and batch["q"] <= 0.05 and one("A7")["relationship"][0]["effect"] > -1
    assert one("A3")["mean_sd"]["ci95"][0] > 0 and one("A3")["median_shift"]["medians_differ"]
    assert one("A6")["sample_types"] == {"study": 16, "qc": 3} and one("A5")["n"] == 16 and a.found["A8"][0].status == "not_applicable"
    assert {r["class"] for r in a.cleaning_candidates()["A1B1"].collect()} >= {"flagged: Type"}
    assert a.sensitivity("A1B1", "Plate")["variants"][0]["conclusion"] == "associated"
    assert a.measures().count() > 50 and worst(["ok", "note"]) == "note" and worst(["not_assessed"]) == "not_assessed"


def test_plan_to_replay(study, planted):
    with pytest.raises(ValueError):
        study.set_intake(contrast_variable="Nope")
    plan = study.build_plan()
    entries = {e["group"]: e for e in plan}
    flagged = next(e for e in plan if e["entry"] == "A1B1:G3:flagged: Type")
    assert flagged["candidates"][0]["params"] == {"ids": ["P119"], "reason": "flagged: Type"}
    assert entries["S2"]["status"] == "Insufficient metadata" and "needs:contrast_variable" in entries["S2"]["blocked_by"]
    assert entries["G5"]["status"] == "Recommended" and entries["G5"]["rule"] == "G-R2"
    study.set_intake(contrast_variable="Group", downstream_family="differential_abundance")
    study.build_plan()
    root = study.store.head
    logged = study.approve("A1B1:G5")
    with pytest.raises(ValueError, match="another state"):
        study.approve("A1B1:G5")
    assert study.store.meta()["scales"] == {"A1B1": "log2"} and study.store.data(root).where("value > 100").count() > 0
    entries = {e["group"]: e for e in study.build_plan()}
    assert entries["G5"]["status"] == "Do not automate" and entries["S2"]["rule"] == "R6"
    with pytest.raises(ValueError):
        study.approve("A1B1:G5")
    by_op = {c["op"]: c["status"] for c in entries["S2"]["candidates"]}
    assert by_op["batch_center"] == "Recommended" and by_op["batch_combat"] == "Do not automate"
    study.approve("A1B1:S2")
    assert study.checkpoint() == "C2" and [s["op"]["op"] for s in study.store.chain()[1:]] == ["log_transform", "batch_center"]
    told = {r.measure: (r.before, r.after) for r in study.verify().collect()}
    assert told["permanova r2 Plate"][1] < 0.1 < told["permanova r2 Plate"][0]
    held = {(r.checkpoint, r.measure): r for r in study.verification().collect()}
    assert {c for c, _ in held} == {"C0", "C1", "C2"} and held["C2", "permanova r2 Plate"].against_c1 < 0 and held["C1", "permanova r2 Plate"].against_c1 is None
    assert held["C0", "permanova p Plate"].control == "negative" and not held["C0", "permanova p Plate"].met and held["C2", "permanova p Plate"].met and held["C2", "gaps"].met
    again = study.replay()
    assert again["identical"] and again["steps"] == 2 and logged in study.store.states
    study.reject("A1B1:S1", "not needed")
    some = [e for e in study.build_plan() if e["group"] == "S3"]
    assert [e["item"]["name"] for e in some] == [f"{t}%" for t in (100, 90, 75, 50, 25) if study.removed_at("A1B1", t)] and all(e["candidates"][0]["params"]["ids"] for e in some)
    study.first.overrides["A1B1:imputed"] = "no"
    study.save(str(planted[2] / "saved"))
    study.first.overrides.clear()
    assert study.load_overrides(str(planted[2] / "saved")) == {"A1B1:imputed": "no"}
    study.first.overrides.clear()
    assert len(study.decisions) == 3 and study.completeness("A1B1").count() == 5
    parts = study.variance_components("A1B1", ["Plate", "Group"])
    assert sum(parts.values()) == pytest.approx(1) and set(parts) <= {"Plate", "Group", "Plate:Group", "residual", "below"}
    assert set(study.variance_components("A1B1", ["Plate", "Group"], least=0)) == {"Plate", "Group", "Plate:Group", "residual"}


def test_states_do_not_depend_on_partitions(spark, study, tmp_path):
    cells = study.store.data()
    assert content_hash(cells.repartition(7, "sample")) == content_hash(cells.coalesce(1))
    store = StateStore(spark, str(tmp_path))
    one = store.add(cells.repartition(3))
    assert store.add(cells.coalesce(1)) == one and len(store.states) == 1
    assert StateStore(spark, str(tmp_path)).load().head == one


def test_vendor_columns(spark, study):
    a = study.first
    features = a.features.withColumn("CV %", F.lit("7.5")).withColumn("QC call", F.when(F.col("feature") < "P010", "FAIL").otherwise("PASS"))
    try:
        a.features, kept = features, a.features
        got = a.vendor_columns()
    finally:
        a.features = kept
    assert set(got) == {"CV %", "QC call"} and got["CV %"]["median"] == 7.5 and got["QC call"] == {"levels": {"PASS": 110, "FAIL": 10}}


def test_refusals(spark, study):
    store, yes = study.store, {"user": "me", "entry": "x"}
    with pytest.raises(executor.ExecutorError, match="approval"):
        executor.apply(store, "normalize_median", {}, {})
    with pytest.raises(executor.ExecutorError, match="linear"):
        executor.apply(store, "log_transform", {}, yes)
    with pytest.raises(executor.ExecutorError, match="batch"):
        executor.apply(store, "batch_center", {}, yes)
    with pytest.raises(executor.ExecutorError, match="missing values"):
        executor.apply(store, "batch_combat", {"batch": study.sample_mapping("Plate")}, yes)
    with pytest.raises(executor.ExecutorError, match="unexpected"):
        executor.apply(store, "normalize_median", {"x": 1}, yes)
    with pytest.raises(executor.ExecutorError):
        executor.register(executor.Op("impute_all", lambda c: c, ("S6",)))
    executor.OPS["fill"] = executor.Op("fill", lambda c: c.fillna(0.0, ["value"]), ("S1",))
    head = store.head
    with pytest.raises(executor.ExecutorError, match="invariant"):
        executor.apply(store, "fill", {}, yes)
    del executor.OPS["fill"]
    assert store.head == head


def test_filled_states(spark, tmp_path):
    rng = np.random.default_rng(14)
    rows = [("A1B1", f"f{i}", f"s{j}", None if (i + j) % 5 == 0 else float(rng.normal(10, 1))) for i in range(12) for j in range(6)] + [("A1B2", f"f{i}", f"s{j}", None) for i in range(2) for j in range(6)]
    store = StateStore(spark, str(tmp_path))
    root = store.add(spark.createDataFrame(rows, "block string, feature string, sample string, value double"), scales={"A1B1": "log2", "A1B2": "log2"})
    for method, p in (("knn", {"k": 3}), ("min_prob", {"batch": {f"s{j}": "ab"[j % 2] for j in range(6)}}), ("knn", {"batch": {f"s{j}": "ab"[j % 2] for j in range(6)}})):
        new = executor.impute(store, method, p, {"user": "me"}, scope="A1B1")
        assert store.head == root and store.data(new).where("block = 'A1B1' and value is null").isEmpty() and store.data(new).where("block = 'A1B2' and value is not null").isEmpty()
        assert transforms.violations(store.data(root), store.data(new), may_fill=True).first().asDict() == {"lost": 0, "added": 0, "gap_changed": 0, "new_infinite": 0, "changed_outside": 0}
        said = store.meta(new)["op"]
        assert said["experimental"] and said["gaps_before"] > 0 == said["gaps_after"] and executor.replay(store, new)["identical"]
    with pytest.raises(executor.ExecutorError, match="approval"):
        executor.impute(store, "knn", {}, {})
    with pytest.raises(executor.ExecutorError, match="no method"):
        executor.impute(store, "mean", {}, {"user": "me"})
    executor.FILLS["bad"] = executor.Op("bad", lambda c: c.withColumn("value", F.lit(1.0)), ("S6",))
    with pytest.raises(executor.ExecutorError, match="invariant"):
        executor.impute(store, "bad", {}, {"user": "me"})
    del executor.FILLS["bad"]
    assert not any("imput" in o for o in executor.OPS)


def test_families_are_listed_with_what_speaks_against_them():
    some = {f["name"]: f for f in audit.imputation_families("mixed", "yes", {"scattered": 2, "low_abundance_pattern": 8}, 10)}
    assert len(some) == 7 and all(f["evidence"] and f["caveat"] and f["methods"] for f in some.values())
    assert {n for n, f in some.items() if f["fits_profile"]} == {"left_censored", "mixed_by_class", "within_batch", "model_without_imputation"}
    assert audit.imputation_families("none", "no", {}, 0) == []


def test_batch_switch(study, monkeypatch):
    monkeypatch.setenv(executor.BATCH_SWITCH, "off")
    with pytest.raises(executor.ExecutorError, match="switched off"):
        executor.apply(study.store, "batch_center", {"batch": study.sample_mapping("Plate")}, {"user": "me", "entry": "x"})


def test_conditions(spark):
    df = spark.createDataFrame([(1, None, "a", True)], "x int, y int, s string, b boolean")
    hold = lambda c: df.select(rules.condition(c).alias("h")).first().h
    yes = [{"fact": "x", "op": "eq", "value": 1}, {"fact": "y", "op": "exists", "value": False}, {"fact": "s", "op": "in", "value": ["a"]}, {"fact": "b", "op": "is_true"}, {"fact": "s", "op": "nonempty"}, {"fact": "x", "op": "ge", "value": 1}]
    no = [{"fact": "y", "op": op, "value": v} for op, v in (("eq", 1), ("ne", 1), ("in", [1]), ("not_in", [1]), ("gt", 0), ("le", 5), ("exists", True))] + [{"fact": "b", "op": "is_false"}]
    assert all(map(hold, yes)) and not any(map(hold, no))
    assert hold({"all": yes}) and hold({"any": [no[0], yes[0]]}) and not hold({"all": [yes[0], no[0]]})


def test_registry_hangs_together():
    assert registry.check() == [] and registry.grid()[("action", "study")][0] == "S1"
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"enum": ["x"]}}, "additionalProperties": False}
    assert registry.validate({"a": 1, "b": "x"}, schema) == []
    assert len(registry.validate({"a": 0, "b": "y", "c": 1}, schema)) == 3 and registry.validate({"a": True}, schema) == ["$.a: not integer"]


def test_integrity_tells_bad_cells(spark):
    rows = [("A1B1", f"f{i}", f"s{j}", "x" if (i, j) == (0, 0) else "1", None if (i, j) == (0, 0) else float("inf") if (i, j) == (1, 1) else 1.0 + (j > 1) * i) for i in range(6) for j in range(4)]
    cells = spark.createDataFrame(rows, "block string, feature string, sample string, raw string, value double")
    samples = spark.createDataFrame([(f"s{j}", "study", True, "", "") for j in range(4)], "sample string, sample_type string, is_study_sample boolean, subject string, time string")
    a = Audit(cells, samples, spark.createDataFrame([(f"f{i}", False, "") for i in range(6)], "feature string, flagged boolean, flag_reason string"))
    m = a.integrity()[0]
    assert m.status == "problem" and m.measures["no_number"] == 1 and m.measures["infinite"] == 1 and m.measures["identical_samples"] == 1


def test_an_entry_changes_its_unit_alone(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(b, f"f{i}", f"s{j}", float(2 ** rng.normal(10, 1))) for b in ("A1B1", "A1B2") for i in range(12) for j in range(6)]
    cells = spark.createDataFrame(rows, "block string, feature string, sample string, value double")
    store, yes = StateStore(spark, str(tmp_path)), {"user": "me", "entry": "A1B2:G5"}
    root = store.add(cells, scales={"A1B1": "linear", "A1B2": "linear"})
    new = executor.apply(store, "log_transform", {}, yes, scope="A1B2")
    assert store.meta(new)["scales"] == {"A1B1": "linear", "A1B2": "log2"}
    assert store.data(new).where("block = 'A1B1'").exceptAll(store.data(root).where("block = 'A1B1'")).isEmpty() and store.data(new).where("block = 'A1B2' and value > 50").isEmpty()
    with pytest.raises(executor.ExecutorError, match="log2"):
        executor.apply(store, "normalize_median", {}, yes, scope="A1B1")
    executor.apply(store, "normalize_median", {}, yes, scope="A1B2")
    assert executor.replay(store)["identical"] and len(store.states) == 3
    executor.OPS["leak"] = executor.Op("leak", lambda c: c.withColumn("block", F.lit("A1B1")), ("S1",))
    with pytest.raises(executor.ExecutorError, match="invariant"):
        executor.apply(store, "leak", {}, yes, scope="A1B2")
    del executor.OPS["leak"]
    assert len(StateStore(spark, str(tmp_path)).load().states) == 3


def test_missing_profile_of_many_features(spark, monkeypatch):
    """A12: features that miss the same samples share a test, the curve takes few passes, and no join has a block as its only key."""
    rng = np.random.default_rng(41)
    n, batches = 12, np.repeat([0, 1, 2], 4)
    level = rng.normal(20, 2, 400)
    gone = rng.random((400, n)) > 1 / (1 + np.exp(-(level[:, None] - 18)))
    gone[:150] = batches == 1  # features that a batch lacks
    gone[150:190] = np.arange(n) < 2
    value = np.where(gone, np.nan, 2 ** (level[:, None] + rng.normal(0, 0.3, (400, n))))
    rows = [("A1B1", f"f{i}", f"s{j:02}", "", float(value[i, j]) if not gone[i, j] else None) for i in range(400) for j in range(n)]
    cells = spark.createDataFrame(rows, "block string, feature string, sample string, raw string, value double")
    # the last sample has no batch: the tests leave it out
    samples = spark.createDataFrame([(f"s{j:02}", "study", True, None, None, "abc"[batches[j]] if j < 11 else "") for j in range(n)], "sample string, sample_type string, is_study_sample boolean, subject string, time string, batch string")
    a = Audit(cells, samples, spark.createDataFrame([(f"f{i}", False, "") for i in range(400)], "feature string, flagged boolean, flag_reason string"), {"batch": "batch"})
    a.classes = {"A1B1": "continuous_linear"}
    assert "Join" not in a.diagnostic("A1B1").where("y > 0")._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    passes, tested = [], []
    sums, bh = fits._sums, stats.bh
    monkeypatch.setattr(fits, "_sums", lambda *args: passes.append(1) or sums(*args))
    monkeypatch.setattr(stats, "bh", lambda df, **more: tested.append(df.count()) or bh(df, **more))
    found = a.missingness_profile()[0].measures

    names, codes = range(11), batches[:11]
    draw = np.random.default_rng([0, 26])
    perms = np.stack([codes] + [draw.permutation(codes) for _ in range(999)])
    p = []
    for r in gone[gone.any(axis=1)][:, list(names)].astype(float):
        if r.sum() in (0, 11):
            p.append(1.0)
            continue
        size = np.bincount(codes)
        expect = r.sum() * size / 11
        chi = sum((((perms == k) @ r) - expect[k]) ** 2 / (expect[k] * (1 - r.mean())) for k in range(3))
        p.append((1 + (chi[1:] >= chi[0] - 1e-9).sum()) / 1000)
    ranked = np.sort(p)
    ok = np.flatnonzero(ranked * len(p) / np.arange(1, len(p) + 1) <= 0.05)
    hits = int((np.array(p) <= ranked[ok[-1]]).sum()) if len(ok) else 0
    assert found["batch_tests"]["n_significant"] == hits >= 150
    assert tested == [len({tuple(r) for r in gone[gone.any(axis=1)][:, list(names)]})]
    assert found["detection_curve"]["ci95"][0] < found["detection_curve"]["b1"] < found["detection_curve"]["ci95"][1] and len(passes) <= 16
    assert found["feature_classes"]["complete"] == int((~gone).all(axis=1).sum())
