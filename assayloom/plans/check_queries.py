"""Registered queries of files, layouts, the audit's checks and saved states: what a check measures on a planted table, and SQL for the same measures.

The table: parts x nations of the catalogue's m2, spread as powers of two; cells of every 97th part in CHINA are text that is no number.
Samples have types, subjects, times and a run order; parts of a small size are flagged. Checks run whole; the queries
give the measures that SQL can state, not those of bootstraps, permutations, components and fits.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import stats, transforms
from ..sources import delimited
from ..sources.states import StateStore, content_hash
from . import catalogue, layout, plan_queries  # noqa: F401 (plan_queries registers its queries)
from . import digest as digests
from .audit import Audit, modified_z
from .catalogue import m2, query, rank_sql, rounded, samples, table

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL

SQL = """, sa AS (SELECT sample, batch, subject, CAST(run_order % 4 AS VARCHAR) AS time, run_order, CASE WHEN run_order % 3 = 1 THEN 'qc' WHEN run_order % 12 = 2 THEN 'blank' ELSE 'study' END AS sample_type FROM smp),
fe AS (SELECT CAST(p_partkey AS VARCHAR) AS feature, p_size < 5 AS flagged FROM part),
au AS (SELECT feature, sample, CASE WHEN CAST(feature AS BIGINT) % 97 = 0 AND sample = 'CHINA' THEN NULL ELSE POW(2.0, value / 8) END AS value FROM m2),
st AS (SELECT au.*, LOG2(value) AS y, batch, subject, time, run_order FROM au JOIN sa USING (sample) WHERE sample_type = 'study' AND feature IN (SELECT feature FROM fe WHERE NOT flagged)),
fm AS (SELECT *, COALESCE(value = lo AND COUNT(value) OVER w >= 5 AND SUM(CASE WHEN value = lo THEN 1 ELSE 0 END) OVER w >= 2, FALSE) AS at_floor FROM (SELECT *, MIN(value) OVER (PARTITION BY feature) AS lo FROM st) WINDOW w AS (PARTITION BY feature))"""


def paths(**sql: str) -> str:
    """SQL for (path, value) rows: a scalar subquery per path; __ in a name is a dot."""
    return " UNION ALL ".join(f"SELECT '{p.replace('__', '.')}' AS path, ROUND(CAST(({q}) AS DOUBLE), 6) AS value" for p, q in sql.items())


def audited(spark: SparkSession, d: str) -> Audit:
    bad = (F.col("feature").cast("long") % 97 == 0) & (F.col("sample") == "CHINA")
    value = F.when(~bad, F.pow(F.lit(2.0), F.col("value") / 8))
    cells = m2(spark, d).select(F.lit("A1B1").alias("block"), "feature", "sample", F.when(bad, "bad").otherwise(F.col("value").cast("string")).alias("raw"), value.alias("value"))
    kind = F.when(F.col("run_order") % 3 == 1, "qc").when(F.col("run_order") % 12 == 2, "blank").otherwise("study")
    s = samples(spark, d).withColumns({"sample_type": kind, "is_study_sample": kind == "study", "time": (F.col("run_order") % 4).cast("string")})
    flagged = F.col("p_size") < 5
    f = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("feature"), flagged.alias("flagged"), F.when(flagged, "p_size").otherwise("").alias("flag_reason"))
    return Audit(cells, s, f, {"batch": "batch", "run_order": "run_order"}, {"log_transformed": "no", "normalized": "not_sure", "imputed": "no"})


def measured(audit: Audit, *prefixes: str, check: str | None = None) -> DataFrame:
    """The numbers that the checks (or one of them) measured, of the paths that begin with one of the prefixes."""
    kept = F.lit(False)
    for p in prefixes:
        kept = kept | F.col("path").startswith(p)
    found = audit.measures().where(kept & (F.col("check") == check if check else F.lit(True)))
    return rounded(found.select("path", F.coalesce("value", F.when(F.col("text") == "True", 1.0).when(F.col("text") == "False", 0.0)).alias("value")), "value")


@query(f"{SQL} " + paths(
    no_number="SELECT COUNT(*) FROM m2 WHERE CAST(feature AS BIGINT) % 97 = 0 AND sample = 'CHINA'", infinite="SELECT COUNT(*) FROM au WHERE ISINF(value)",
    sparse="SELECT COUNT(*) FROM (SELECT feature FROM st GROUP BY 1 HAVING COUNT(value) < 3)", constant="SELECT COUNT(*) FROM (SELECT feature FROM st GROUP BY 1 HAVING COUNT(value) >= 2 AND MIN(value) = MAX(value))",
    features="SELECT COUNT(DISTINCT feature) FROM st", empty_samples="SELECT COUNT(*) FROM (SELECT sample FROM st GROUP BY 1 HAVING COUNT(value) = 0)",
    repeated_features="SELECT COUNT(DISTINCT feature) FROM (SELECT feature FROM au GROUP BY feature, sample HAVING COUNT(*) > 1)",
    identical_samples="SELECT COUNT(*) FROM (SELECT v FROM (SELECT sample, LIST(COALESCE(CAST(value AS VARCHAR), '?') ORDER BY feature) AS v FROM st GROUP BY 1) GROUP BY 1 HAVING COUNT(*) > 1)",
    sentinel__value="SELECT value FROM st WHERE value IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, value LIMIT 1", sentinel__n="SELECT COUNT(*) AS n FROM st WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC LIMIT 1",
    sentinel__share="SELECT COUNT(*) / (SELECT COUNT(value) FROM st) AS n FROM st WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC LIMIT 1"))
def check_integrity(spark, d):
    a = audited(spark, d)
    a.integrity()
    return measured(a, "")


SKEW = """, sk AS (SELECT feature, CASE WHEN COUNT(value) >= 3 AND VAR_POP(value) > 0 THEN AVG(POW(value - mv, 3)) / POW(VAR_POP(value), 1.5) END AS a, CASE WHEN COUNT(y) >= 3 AND VAR_POP(y) > 0 THEN AVG(POW(y - my, 3)) / POW(VAR_POP(y), 1.5) END AS b
FROM (SELECT *, AVG(value) OVER (PARTITION BY feature) AS mv, AVG(y) OVER (PARTITION BY feature) AS my FROM st) GROUP BY 1), fd AS (SELECT LOG2(MEDIAN(value)) AS m FROM st GROUP BY feature)"""


@query(f"{SQL}{SKEW} SELECT path, value FROM (" + paths(
    n="SELECT COUNT(value) FROM st", whole="SELECT CASE WHEN BOOL_AND(value = FLOOR(value)) THEN 1 ELSE 0 END FROM st", min="SELECT MIN(value) FROM st", max="SELECT ROUND(q, CAST(9 - FLOOR(LOG10(q)) AS INTEGER)) FROM (SELECT MAX(value) AS q FROM st)", zeros="SELECT 0",
    p1="SELECT QUANTILE_CONT(value, 0.01) FROM st", p99="SELECT ROUND(q, CAST(9 - FLOOR(LOG10(q)) AS INTEGER)) FROM (SELECT QUANTILE_CONT(value, 0.99) AS q FROM st)", sum_cv="SELECT STDDEV_POP(s) / AVG(s) FROM (SELECT SUM(value) AS s FROM st GROUP BY sample)",
    skew="SELECT MEDIAN(a) FROM sk", skew_log="SELECT MEDIAN(b) FROM sk", median_scaling__n="SELECT COUNT(m) FROM fd", median_scaling__mad="SELECT MEDIAN(ABS(m - (SELECT MEDIAN(m) FROM fd))) FROM fd") + ")")
def check_scale(spark, d):
    a = audited(spark, d)
    a.scale()
    return measured(a, "").where("path <> 'class'")


@query(f"{SQL}{SKEW} SELECT 'A1B1' AS block, CASE WHEN ABS((SELECT MEDIAN(b) FROM sk)) < ABS((SELECT MEDIAN(a) FROM sk)) THEN 'continuous_linear' ELSE 'continuous_symmetric_or_log_like' END AS scale_class")
def check_scale_class(spark, d):
    a = audited(spark, d)
    a.scale()
    return a.measures().where("path = 'class'").select("block", F.col("text").alias("scale_class"))


MEDIANS = ", rl AS (SELECT sample, y - MEDIAN(y) OVER (PARTITION BY feature) AS r FROM st WHERE y IS NOT NULL), sm AS (SELECT sample, MEDIAN(r) AS m FROM rl GROUP BY sample), fd AS (SELECT LOG2(MEDIAN(value)) AS m FROM st GROUP BY feature)"


@query(f"{SQL}{MEDIANS} " + paths(
    floor_share="SELECT AVG(CASE WHEN t THEN 1.0 ELSE 0.0 END) FROM (SELECT BOOL_OR(at_floor) AS t FROM fm GROUP BY feature HAVING COUNT(value) >= 5)",
    shared_median="SELECT CASE WHEN MEDIAN(ABS(m - (SELECT MEDIAN(m) FROM fd))) < 0.5 THEN 1 ELSE 0 END FROM fd", median_spread="SELECT MEDIAN(ABS(m - (SELECT MEDIAN(m) FROM sm))) FROM sm"))
def check_processing_state(spark, d):
    a = audited(spark, d)
    a.processing_state()
    return measured(a, "floor_share", "shared_median", "median_spread")


def _summary(name: str, by: str) -> dict[str, str]:
    rate = f"(SELECT 1 - COUNT(value) / COUNT(*) AS r FROM st GROUP BY {by})"
    return {f"{name}__{k}": f"SELECT {f} FROM {rate}" for k, f in (("min", "MIN(r)"), ("median", "MEDIAN(r)"), ("p90", "QUANTILE_CONT(r, 0.9)"), ("max", "MAX(r)"))}


TIES = "(SELECT COUNT(*) FILTER (at_floor) AS ties, COUNT(value) AS n FROM fm GROUP BY feature)"


@query(f"""{SQL}, pf AS (SELECT feature, 1 - COUNT(value) / COUNT(*) AS rate, AVG(y) FILTER (NOT at_floor) AS mean FROM fm GROUP BY 1),
rk AS (SELECT {rank_sql('rate', '1')} AS a, {rank_sql('mean', '1')} AS b FROM pf WHERE mean IS NOT NULL) """ + paths(
    **_summary("features", "feature"), **_summary("samples", "sample"), zero_share="SELECT COUNT(*) FILTER (value = 0) / COUNT(*) FROM st",
    floor_ties__n_features=f"SELECT COUNT(*) FILTER (ties > 0) FROM {TIES}", floor_ties__n_eligible=f"SELECT COUNT(*) FILTER (n >= 5) FROM {TIES}", floor_ties__n_cells=f"SELECT SUM(ties) FROM {TIES}",
    floor_ties__share=f"SELECT COUNT(*) FILTER (ties > 0) / COUNT(*) FILTER (n >= 5) FROM {TIES}", abundance_rho="SELECT ROUND(CORR(a, b), 2) FROM rk"))
def check_missingness(spark, d):
    a = audited(spark, d)
    a.missingness()
    found = measured(a, "", check="A4")  # sums may differ in their last bits, and so ranks of equal means
    return found.withColumn("value", F.when(F.col("path") == "abundance_rho", F.round("value", 2)).otherwise(F.col("value")))


@query(f"""{SQL}, ns AS (SELECT COUNT(DISTINCT sample) AS n FROM st), cv AS (SELECT feature, COUNT(*) FILTER (seen = 0 AND size >= 3) AS absent, MIN(seen) AS lowest FROM (SELECT feature, batch, COUNT(value) AS seen, COUNT(*) AS size FROM st GROUP BY 1, 2) GROUP BY 1),
pf AS (SELECT feature, COUNT(y) AS d, AVG(y) AS m FROM st GROUP BY 1), cl AS (SELECT CASE WHEN d = n THEN 'complete' WHEN absent > 0 THEN 'batch_wide_absent' WHEN m <= (SELECT QUANTILE_CONT(m, 0.3333) FROM pf WHERE d > 0) THEN 'low_abundance_pattern' ELSE 'scattered' END AS kind FROM pf JOIN cv USING (feature), ns)
SELECT 'cell_encoding.' || CASE WHEN value IS NULL THEN 'missing' WHEN value = 0 THEN 'zero' WHEN at_floor THEN 'floor_tied' ELSE 'observed' END AS path, CAST(COUNT(*) AS DOUBLE) AS value FROM fm GROUP BY 1
UNION ALL SELECT 'shares.' || l, ROUND(COUNT(*) FILTER (r <= CAST(l AS DOUBLE)) / COUNT(*), 6) FROM (SELECT 1 - COUNT(value) / COUNT(*) AS r FROM st GROUP BY feature), (VALUES ('0.0'), ('0.1'), ('0.25'), ('0.5')) t(l) GROUP BY l
UNION ALL SELECT 'by_level.batch.' || batch, ROUND(1 - COUNT(value) / COUNT(*), 6) FROM st GROUP BY batch UNION ALL SELECT 'by_level.time.' || time, ROUND(1 - COUNT(value) / COUNT(*), 6) FROM st GROUP BY time
UNION ALL SELECT 'feature_classes.' || kind, COUNT(*) FROM cl GROUP BY kind UNION ALL """ + paths(
    coverage__batch_wide_absent="SELECT COUNT(*) FILTER (absent > 0) / COUNT(*) FROM cv", coverage__one_in_every_level="SELECT COUNT(*) FILTER (lowest >= 1) / COUNT(*) FROM cv", coverage__two_in_every_level="SELECT COUNT(*) FILTER (lowest >= 2) / COUNT(*) FROM cv"))
def check_missing_profile(spark, d):
    a = audited(spark, d)
    a.missingness_profile()
    return measured(a, "cell_encoding.", "shares.", "by_level.", "feature_classes.", "coverage.")


@query(f"""{SQL}{MEDIANS}, ms AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS s FROM st GROUP BY feature HAVING COUNT(value) >= 3), sy AS (SELECT AVG(y) AS m, STDDEV_SAMP(y) AS s FROM st GROUP BY feature HAVING COUNT(y) >= 2),
rk AS (SELECT {rank_sql('m', '1')} AS a, {rank_sql('s', '1')} AS b FROM sy), sd AS (SELECT MEDIAN(ABS(m - (SELECT MEDIAN(m) FROM sm))) AS mad FROM sm) """ + paths(
    mean_sd__slope="SELECT REGR_SLOPE(LN(s), LN(m)) FROM ms WHERE s > 0", spearman_rho="SELECT ROUND(CORR(a, b), 2) FROM rk", median_shift__mad="SELECT mad FROM sd", median_shift__medians_differ="SELECT CASE WHEN mad >= 0.1 THEN 1 ELSE 0 END FROM sd"))
def check_distribution(spark, d):
    a = audited(spark, d)
    a.distribution()
    found = measured(a, "mean_sd.slope", "spearman_rho", "median_shift.mad", "median_shift.medians_differ", check="A3")  # ranks as in check_missingness
    return found.withColumn("value", F.when(F.col("path") == "spearman_rho", F.round("value", 2)).otherwise(F.col("value")))


def _v(other: str) -> str:
    """SQL for Cramer's V of batch and another column of the study samples."""
    o, r, c = (f"(SELECT {k}, COUNT(*) AS n FROM ss GROUP BY ALL)" for k in (f"batch, {other}", "batch", other))
    chi2 = f"(SELECT SUM(POW(COALESCE(o.n, 0) - r.n * c.n / t.n, 2) / (r.n * c.n / t.n)) AS chi2 FROM {r} r CROSS JOIN {c} c CROSS JOIN (SELECT COUNT(*) * 1.0::DOUBLE AS n FROM ss) t LEFT JOIN {o} o ON o.batch = r.batch AND o.{other} = c.{other})"
    return f"SELECT SQRT(chi2 / (SELECT COUNT(*) * (LEAST(COUNT(DISTINCT batch), COUNT(DISTINCT {other})) - 1) FROM ss)) FROM {chi2}"


@query(f"""{SQL}, ss AS (SELECT * FROM sa WHERE sample_type = 'study'), bs AS (SELECT MIN(n) AS n FROM (SELECT COUNT(*) AS n FROM ss GROUP BY batch)),
pr AS (SELECT a.batch = b.batch AS same, CASE WHEN COUNT(*) >= 3 AND STDDEV_POP(a.y) > 0 AND STDDEV_POP(b.y) > 0 THEN COVAR_POP(a.y, b.y) / (STDDEV_POP(a.y) * STDDEV_POP(b.y)) END AS r FROM st a JOIN st b USING (feature) WHERE a.sample < b.sample AND a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY a.sample, b.sample, 1),
rs AS (SELECT MEDIAN(r) FILTER (same) AS s, MEDIAN(r) FILTER (NOT same) AS o FROM pr)
SELECT path, value FROM (SELECT 'structure[0].v' AS path, ROUND(({_v('subject')}), 6) AS value UNION ALL SELECT 'structure[1].v', ROUND(({_v('time')}), 6) UNION ALL SELECT 'samples_per_batch[0].min', n FROM bs UNION ALL SELECT 'samples_per_batch[0].below', CASE WHEN n < 25 THEN 1 ELSE 0 END FROM bs
UNION ALL SELECT 'relationship[0].same', ROUND(s, 6) FROM rs UNION ALL SELECT 'relationship[0].different', ROUND(o, 6) FROM rs UNION ALL SELECT 'relationship[0].effect', ROUND(s - o, 6) FROM rs) WHERE path NOT LIKE 'relationship%' OR (SELECT s + o FROM rs) IS NOT NULL""")
def check_batch_structure(spark, d):
    a = audited(spark, d)
    a.batch_structure()
    found = measured(a, "structure[", "samples_per_batch[", "relationship[", check="A7")
    return found.where(F.col("path").rlike(r"\.(v|min|below|same|different|effect)$"))


@query(f"""{SQL}, qc AS (SELECT feature, 100 * STDDEV_SAMP(value) / AVG(value) AS s FROM au WHERE sample IN (SELECT sample FROM sa WHERE sample_type = 'qc') AND feature NOT IN (SELECT feature FROM fe WHERE flagged) GROUP BY 1 HAVING COUNT(value) >= 3),
bl AS (SELECT feature, AVG(value) FILTER (sample_type = 'blank') / AVG(value) FILTER (sample_type = 'study') AS ratio FROM au JOIN sa USING (sample) WHERE feature NOT IN (SELECT feature FROM fe WHERE flagged) GROUP BY 1),
om AS (SELECT sample, run_order, MEDIAN(y) AS m FROM st GROUP BY 1, 2), ok AS (SELECT {rank_sql('m', '1')} AS a, {rank_sql('run_order', '1')} AS b, m, run_order FROM om),
mi AS (SELECT feature, MEDIAN(y) AS mid FROM st GROUP BY 1 HAVING COUNT(y) = COUNT(*)), pr AS (SELECT sample, CORR(y, mid) AS r FROM st JOIN mi USING (feature) GROUP BY 1)
SELECT 'sample_types.' || sample_type AS path, CAST(COUNT(*) AS DOUBLE) AS value FROM sa GROUP BY 1
UNION ALL SELECT 'flagged.' || k || i, ROUND(CASE i WHEN '[0]' THEN n WHEN '[1]' THEN m ELSE g END, 6) FROM (SELECT CASE WHEN flagged THEN 'True' ELSE 'False' END AS k, COUNT(DISTINCT feature) AS n, MEDIAN(value) AS m, 1 - COUNT(value) / COUNT(*) AS g FROM au JOIN fe USING (feature) GROUP BY 1), (VALUES ('[0]'), ('[1]'), ('[2]')) t(i) UNION ALL """ + paths(
    qc__n="SELECT COUNT(*) FROM qc", qc__median="SELECT MEDIAN(s) FROM qc", qc__above_20="SELECT AVG(CASE WHEN s > 20 THEN 1.0 ELSE 0.0 END) FROM qc", qc__above_30="SELECT AVG(CASE WHEN s > 30 THEN 1.0 ELSE 0.0 END) FROM qc",
    blank_ratio__median="SELECT MEDIAN(ratio) FROM bl", run_order__n_used="SELECT COUNT(*) FROM om", run_order__spearman_median="SELECT CORR(a, b) FROM ok", run_order__slope="SELECT REGR_SLOPE(m, run_order) FROM om",
    lowest_profile_r__r="SELECT MIN(r) FROM pr WHERE NOT ISNAN(r)"))
def check_quality(spark, d):
    a = audited(spark, d)
    a.quality()
    return measured(a, "sample_types.", "qc.", "blank_ratio.", "run_order.n_used", "run_order.spearman", "run_order.slope", "lowest_profile_r.r", "flagged.")


ICC = """, sj AS (SELECT feature, subject, CAST(COUNT(y) AS DOUBLE) AS c, AVG(y) AS m, VAR_POP(y) AS v FROM st WHERE y IS NOT NULL GROUP BY 1, 2 HAVING COUNT(y) >= 2),
ts AS (SELECT feature, CAST(COUNT(*) AS DOUBLE) AS a, SUM(c) AS n, SUM(c * c) AS c2, SUM(c * m) AS cm, SUM(c * m * m) AS cm2, SUM(c * v) AS w FROM sj GROUP BY 1),
us AS (SELECT feature, (cm2 - cm * cm / n) / (a - 1) AS msb, w / (n - a) AS msw, (n - c2 / n) / (a - 1) AS k0 FROM ts WHERE a >= 3 AND n - a >= 3), ic AS (SELECT (msb - msw) / NULLIF(msb + (k0 - 1) * msw, 0) AS icc FROM us),
ss AS (SELECT * FROM sa WHERE sample_type = 'study'), su AS (SELECT subject, COUNT(*) AS n, COUNT(DISTINCT batch) AS b, COUNT(DISTINCT time) AS t, COUNT(DISTINCT run_order) AS o FROM ss GROUP BY 1)"""


@query(f"{SQL}{ICC} " + paths(
    design__n_subjects="SELECT COUNT(*) FROM su", design__n_samples="SELECT SUM(n) FROM su", design__smallest="SELECT MIN(n) FROM su", design__largest="SELECT MAX(n) FROM su", design__balanced="SELECT CASE WHEN MIN(n) = MAX(n) THEN 1 ELSE 0 END FROM su",
    design__repeated="SELECT COUNT(*) FROM (SELECT 1 FROM ss GROUP BY subject, time HAVING COUNT(*) > 1)", icc__m="SELECT MEDIAN(icc) FROM ic", icc__n="SELECT COUNT(icc) FROM ic",
    **{f"constant_within_subject__{v}": f"SELECT CASE WHEN MAX({c}) = 1 THEN 1 ELSE 0 END FROM su" for v, c in (("batch", "b"), ("run_order", "o"), ("time", "t"))}))
def check_repeated_measures(spark, d):
    a = audited(spark, d)
    a.repeated_measures()
    return measured(a, "", check="A8")


@query(f"{SQL}{ICC}, de AS (SELECT (SELECT COUNT(DISTINCT sample) FROM st) AS n, 1 + ((SELECT COUNT(DISTINCT sample) FROM st) / (SELECT COUNT(*) FROM su) - 1) * GREATEST(0.0, (SELECT MEDIAN(icc) FROM ic)) AS deff) SELECT path, value FROM (" + paths(
    p="SELECT COUNT(DISTINCT feature) FROM st", n="SELECT n FROM de", sparsity="SELECT 1 - COUNT(value) / COUNT(*) FROM st", smallest_cell="SELECT NULL", design_effect="SELECT deff FROM de", n_eff="SELECT n / deff FROM de") + ") WHERE path NOT IN ('design_effect', 'n_eff') OR (SELECT MEDIAN(icc) FROM ic) <> 0")
def check_dimensionality(spark, d):
    a = audited(spark, d)
    a.dimensionality()
    return measured(a, "", check="A5")


@query(f"""{SQL}, md AS (SELECT feature, sample, y, y - MEDIAN(y) OVER (PARTITION BY feature) AS x FROM st), sp AS (SELECT feature, MEDIAN(ABS(x)) AS mad, AVG(ABS(x)) AS ad FROM md GROUP BY 1),
zz AS (SELECT feature, sample, CASE WHEN mad > 0 THEN 0.6745 * x / mad WHEN ad > 0 THEN x / (1.253314 * ad) ELSE 0 END AS z FROM md JOIN sp USING (feature) WHERE y IS NOT NULL) """ + paths(
    n_cells="SELECT COUNT(*) FROM zz WHERE ABS(z) > 3.5", n_listed="SELECT LEAST(50, COUNT(*)) FROM zz WHERE ABS(z) > 3.5", largest="SELECT MAX(ABS(z)) FROM zz WHERE ABS(z) > 3.5"))
def check_outlier_cells(spark, d):
    a = audited(spark, d)
    a.outliers()
    found = a.measures()
    listed = found.where(F.col("path").rlike(r"^cells\[\d+\]\[2\]$")).agg(F.count("*").cast("double").alias("n_listed"), F.max(F.abs("value")).alias("largest"))
    return measured(a, "n_cells").unionByName(rounded(listed.select(F.explode(F.expr("map('n_listed', n_listed, 'largest', largest)")).alias("path", "value")), "value"))


@query(f"""{SQL}, pf AS (SELECT feature, COUNT(value) AS n, STDDEV_SAMP(value) AS sd FROM au WHERE sample IN (SELECT sample FROM sa WHERE sample_type = 'study') GROUP BY 1),
bl AS (SELECT feature, AVG(value) FILTER (sample_type = 'blank') / AVG(value) FILTER (sample_type = 'study') AS ratio FROM au JOIN sa USING (sample) GROUP BY 1)
SELECT 'flagged: p_size' AS class, feature FROM pf JOIN fe USING (feature) WHERE flagged UNION ALL SELECT 'all_missing', feature FROM pf WHERE n = 0 UNION ALL SELECT 'sd_zero', feature FROM pf WHERE sd = 0
UNION ALL SELECT 'fewer_than_3', feature FROM pf WHERE n > 0 AND n < 3 UNION ALL SELECT 'blank_dominated', feature FROM pf JOIN bl USING (feature) WHERE ratio >= 0.5""")
def check_cleaning_candidates(spark, d):
    return audited(spark, d).cleaning_candidates()["A1B1"]


# ---------------------------------------------------------------- states


def state_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors reach: under spark.checkpoint.dir, or, where that is unset, a temporary one with a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{shared.rstrip('/')}/states-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="states-")



@query("SELECT 'A1B1' AS block, feature, sample, ROUND(LOG2(value), 6) AS value FROM m2 WHERE feature NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 10)")
def state_chain(spark, d):
    """A root state and two more, written, loaded again from the folder, and the cells at HEAD read back."""
    folder = state_folder(spark)
    store = StateStore(spark, folder)
    root = store.add(m2(spark, d).select(F.lit("A1B1").alias("block"), "feature", "sample", F.col("value").cast("double").alias("value")))
    small = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("feature"))
    kept = store.add(transforms.remove_features(store.data(root), small), root, {"op": "remove_features", "step": "G3", "params": {"reason": "p_size"}})
    store.add(store.data(kept).withColumn("value", F.log2("value")), kept, {"op": "log_transform", "step": "G5", "params": {"base": "2"}})
    again = StateStore(spark, folder).load()
    return rounded(again.data(), "value").select("block", "feature", "sample", "value")


@query("SELECT * FROM (VALUES (1, NULL, TRUE, TRUE), (2, 'remove_features', TRUE, FALSE), (3, 'log_transform', TRUE, FALSE)) t(place, op, hash_holds, is_root)")
def state_names(spark, d):
    """The chain from root to HEAD after a load; whether each state's content still has the hash it is named by; the same cells in
    other partitions and order get the same name."""
    folder = state_folder(spark)
    store = StateStore(spark, folder)
    cells = m2(spark, d).select(F.lit("A1B1").alias("block"), "feature", "sample", F.col("value").cast("double").alias("value"))
    root = store.add(cells)
    if store.add(cells.repartition(3).sortWithinPartitions(F.desc("feature")), move_head=False) != root:
        raise AssertionError("equal states have different names")
    kept = store.add(store.data(root).where("feature <> '1'"), root, {"op": "remove_features", "step": "G3", "params": {"ids": ["1"]}})
    store.add(store.data(kept).withColumn("value", F.log2("value")), kept, {"op": "log_transform", "step": "G5", "params": {"base": "2"}})
    again = StateStore(spark, folder).load()
    rows = [(i + 1, (s["op"] or {}).get("op"), content_hash(again.data(s["state_id"])) == s["hashes"], s["parent"] is None) for i, s in enumerate(again.chain())]  # a row per state
    return spark.createDataFrame(rows, "place int, op string, hash_holds boolean, is_root boolean")


# ---------------------------------------------------------------- files


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, ';' AS delimiter FROM part")
def read_delimited(spark, d):
    """Parts written as text with semicolons, and read back with the delimiter that the first lines suggest."""
    folder = f"{state_folder(spark)}/csv"
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").write.option("header", True).option("sep", ";").csv(folder)
    t = delimited.read(spark, folder)
    return t.data.drop(delimited.ROW).withColumn("delimiter", F.lit(t.delimiter))


SUMMARIES = " UNION ALL ".join(f"SELECT '{c}' AS name, '{kind}' AS kind, COUNT(*) - COUNT({c}) AS n_missing, COUNT(DISTINCT {c}) AS n_unique FROM customer" for c, kind in (("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "text")))


@query(SUMMARIES)
def table_summary(spark, d):
    """Facts of every column of a table that is read as texts."""
    return delimited.read(spark, f"{d}/customer.parquet").summary().drop("example")


@query("""SELECT name, CASE WHEN name = key THEN 'id' WHEN name IN ('c_custkey', 'c_nationkey', 'c_acctbal') THEN 'measurement' ELSE 'annotation' END AS role, 'samples_in_columns' AS layout
FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(name), (SELECT CASE WHEN COUNT(*) = COUNT(DISTINCT c_name) THEN 'c_name' ELSE 'c_custkey' END AS key FROM customer)""")
def proposed_layout(spark, d):
    """Which column names a table's rows, which hold values and which describe them."""
    found = layout.propose_layout(delimited.read(spark, f"{d}/customer.parquet"))
    roles = [(c, role, found.orientation) for c, role in found.roles().items()]  # a row per column
    return spark.createDataFrame(roles, "name string, role string, layout string")


@query("SELECT 'A1B1' AS block, c_name AS feature, s AS sample, CASE s WHEN 'c_custkey' THEN c_custkey WHEN 'c_nationkey' THEN c_nationkey ELSE c_acctbal END AS value FROM customer, (VALUES ('c_custkey'), ('c_nationkey'), ('c_acctbal')) t(s)")
def layout_cells(spark, d):
    """The long cells of a proposed layout."""
    cells = layout.propose_layout(delimited.read(spark, f"{d}/customer.parquet")).cells()
    return cells.select("block", "feature", "sample", "value")


# ---------------------------------------------------------------- labels, digests and numbers per sample


@query(""", lb AS (SELECT c_name AS label FROM customer UNION SELECT p_brand FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT CONCAT('t', p_size, '.5 h') FROM part)
SELECT label, TRY_CAST(regexp_replace(label, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS number, regexp_replace(label, '[0-9]+', '#', 'g') AS template, LEFT(regexp_replace(regexp_replace(TRIM(label), '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 40) AS shape FROM lb""")
def label_parts(spark, d):
    """Labels of four columns: the number that each holds, its template and its shape."""
    c, p = table(spark, d, "customer").select(F.col("c_name").alias("label")), table(spark, d, "part")
    labels = c.union(p.select("p_brand")).union(table(spark, d, "orders").select("o_orderpriority")).union(p.select(F.concat(F.lit("t"), "p_size", F.lit(".5 h")))).distinct()
    return labels.select("label", S.label_number(F.col("label")).alias("number"), S.name_template(F.col("label")).alias("template"), S.shape(F.col("label")).alias("shape"))


@query(""" SELECT 'c_name' AS name, 'text' AS kind, COUNT(*) FILTER (TRIM(c_name) = '') AS n_missing, COUNT(DISTINCT c_name) AS n_unique, MIN(LENGTH(c_name)) AS shortest, MAX(LENGTH(c_name)) AS longest, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM customer
UNION ALL SELECT 'c_mktsegment', 'text', COUNT(*) FILTER (TRIM(c_mktsegment) = ''), COUNT(DISTINCT c_mktsegment), MIN(LENGTH(c_mktsegment)), MAX(LENGTH(c_mktsegment)), NULL, NULL FROM customer
UNION ALL SELECT 'c_custkey', 'numeric', COUNT(*) FILTER (c_custkey IS NULL), COUNT(DISTINCT c_custkey), NULL, NULL, MIN(c_custkey), MAX(c_custkey) FROM customer
UNION ALL SELECT 'c_nationkey', 'numeric', COUNT(*) FILTER (c_nationkey IS NULL), COUNT(DISTINCT c_nationkey), NULL, NULL, MIN(c_nationkey), MAX(c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', 'numeric', COUNT(*) FILTER (c_acctbal IS NULL), COUNT(DISTINCT c_acctbal), NULL, NULL, ROUND(MIN(c_acctbal), 1), ROUND(MAX(c_acctbal), 0) FROM customer""")
def table_digest(spark, d):
    """What a proposer sees of each column of a table: lengths of texts, and ends of numbers to four digits."""
    out = digests.digest(delimited.read(spark, f"{d}/customer.parquet"), examples=False)["columns"]
    rows = [(c["name"], c["kind"], c["n_missing"], c["n_unique"], *(c["length"] if c["kind"] == "text" else (None, None)), *((float(c["numbers"][k]) for k in ("min", "max")) if "numbers" in c and c["kind"] == "numeric" else (None, None))) for c in out]  # a row per column
    return spark.createDataFrame(rows, "name string, kind string, n_missing long, n_unique long, shortest long, longest long, low double, high double")


@query(""", md AS (SELECT sample, MEDIAN(value) AS x FROM m2 GROUP BY 1), de AS (SELECT sample, x, x - (SELECT MEDIAN(x) FROM md) AS dev FROM md),
sc AS (SELECT MEDIAN(ABS(dev)) AS mad, AVG(ABS(dev)) AS mean FROM de) SELECT sample, ROUND(CASE WHEN mad > 0 THEN 0.6745 * dev / mad WHEN mean > 0 THEN dev / (1.253314 * mean) ELSE 0 END, 6) AS z FROM de, sc""")
def sample_modified_z(spark, d):
    """How far each sample's median lies from the others'."""
    rows = m2(spark, d).groupBy("sample").agg(F.median("value").alias("x")).orderBy("sample").collect()  # a row per sample
    return rounded(spark.createDataFrame([(r["sample"], float(z)) for r, z in zip(rows, modified_z([r.x for r in rows]), strict=True)], "sample string, z double"), "z")


@query(""", rk AS (SELECT batch, RANK() OVER (ORDER BY run_order) AS r FROM smp), pr AS (SELECT a.batch, AVG(ABS(a.r - b.r)) AS spread FROM rk a JOIN rk b ON a.batch = b.batch AND a.r < b.r GROUP BY 1) SELECT batch, ROUND(spread, 6) AS spread FROM pr""")
def spread_in_run_order(spark, d):
    """The mean distance in run order between the samples of a batch."""
    rows = samples(spark, d).orderBy("run_order").collect()  # a row per sample
    batches, order = sorted({r.batch for r in rows}), [float(r.run_order) for r in rows]
    found = [(b, stats.clustered_in_order([r.batch == b for r in rows], order, n=9).get("spread")) for b in batches]
    return rounded(spark.createDataFrame(found, "batch string, spread double").where("spread is not null"), "spread")
