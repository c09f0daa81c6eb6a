"""Missingness, detection and repeated measures: counts and rates over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C

THRESHOLDS = (100, 90, 75, 50, 25)


def rates(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_observed, n, missing_rate, zero_rate)."""
    v = F.col("value")
    return cells.groupBy(*by).agg(F.count(v).alias("n_observed"), F.count("*").alias("n"), (1 - F.count(v) / F.count("*")).alias("missing_rate"), (F.count_if(v == 0) / F.count("*")).alias("zero_rate"))


def rate_summary(rate: DataFrame, value: str = "missing_rate") -> DataFrame:
    v = F.col(value)
    return rate.agg(F.min(v).alias("min"), F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90"), F.max(v).alias("max"))


def missing_shares(cells: DataFrame, limits: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5)) -> DataFrame:
    """Share of features that miss at most each limit of their samples."""
    r = rates(cells, ["feature"])
    return r.select("missing_rate", F.explode(F.array(*map(F.lit, limits))).alias("at_most")).groupBy("at_most").agg((F.count_if(F.col("missing_rate") <= F.col("at_most")) / F.count("*")).alias("share"))


def encoding_counts(cells: DataFrame, least: int = 5) -> DataFrame:
    return C.floor_marks(cells, least).groupBy(C.encoding(cells).alias("cell_class")).agg(F.count("*").alias("n"))


def rate_by_level(cells: DataFrame, variables: DataFrame) -> DataFrame:
    """Missing rate by variable and level; variables: (sample, name, level)."""
    joined = cells.join(variables.where("level is not null and level <> ''"), "sample")
    return joined.groupBy("name", "level").agg((1 - F.count("value") / F.count("*")).alias("missing_rate"), F.count_distinct("sample").alias("n_samples"))


def level_coverage(cells: DataFrame, batches: DataFrame, least: int = 3) -> DataFrame:
    """(feature, absent_levels, lowest): batch levels of at least `least` samples in which the feature is never seen, and the fewest values in a level."""
    per = cells.join(batches, "sample").groupBy("feature", "batch").agg(F.count("value").alias("seen"), F.count("*").alias("size"))  # on the complete grid
    return per.groupBy("feature").agg(F.count_if((F.col("seen") == 0) & (F.col("size") >= least)).alias("absent_levels"), F.min("seen").alias("lowest"))


def coverage_shares(coverage: DataFrame) -> DataFrame:
    return coverage.agg((F.count_if(F.expr("absent_levels > 0")) / F.count("*")).alias("batch_wide_absent"), (F.count_if(F.expr("lowest >= 1")) / F.count("*")).alias("one_in_every_level"), (F.count_if(F.expr("lowest >= 2")) / F.count("*")).alias("two_in_every_level"))


def completeness(cells: DataFrame, groups: DataFrame | None = None, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, n_kept): features observed in at least so many percent of the samples, or, with groups (sample, level), of some level's."""
    if groups is None:
        share = cells.groupBy("feature").agg((100 * F.count("value") / F.count("*")).alias("share"))
    else:
        per = cells.join(groups, "sample").groupBy("feature", "level").agg((100 * F.count("value") / F.count("*")).alias("s"))
        share = per.groupBy("feature").agg(F.max("s").alias("share"))
    return share.select("feature", "share", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("share") >= F.col("threshold") - 1e-9).alias("n_kept"))


def completeness_by_cluster(cells: DataFrame, subjects: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, n_kept): features observed in at least so many percent of the subjects (in any of a subject's samples); subjects: (sample, subject)."""
    per = cells.join(subjects.where("subject <> ''"), "sample").groupBy("feature", "subject").agg((F.count("value") > 0).alias("seen"))
    share = per.groupBy("feature").agg((100 * F.count_if("seen") / F.count("*")).alias("share"))
    return share.select("share", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("share") >= F.col("threshold") - 1e-9).alias("n_kept"))


def below_threshold(cells: DataFrame, threshold: float, groups: DataFrame | None = None) -> DataFrame:
    """(feature): what a completeness threshold would remove: features under it overall or, with groups (sample, level), in every level."""
    share = lambda by: cells.join(groups, "sample").groupBy(*by) if groups is not None else cells.groupBy(*by)
    rate = share(["feature", "level"] if groups is not None else ["feature"]).agg((100 * F.count("value") / F.count("*")).alias("s"))
    return rate.groupBy("feature").agg(F.max("s").alias("s")).where(F.col("s") < threshold - 1e-9).select("feature")


def identical_vectors(cells: DataFrame, key: str, along: str) -> DataFrame:
    """(vector, n, members): groups of samples (or features) with the very same values, missing ones too. Hashes of whole vectors are compared, never pairs."""
    text = F.coalesce(F.when(F.col("value") == 0, F.lit("0.0")).otherwise(F.col("value").cast("string")), F.lit("?"))
    vector = cells.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col(along), text.alias("v"))))), 256).alias("vector"))
    return vector.groupBy("vector").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("members")).where("n > 1")


def sentinel(cells: DataFrame) -> DataFrame:
    """The most common non-zero value (ties: the smallest), its count and its share of the values."""
    counts = cells.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("of"))
    top = counts.where("value <> 0").orderBy(F.desc("n"), "value").limit(1)
    return top.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("of")).alias("share"))


def qc_spread(cells: DataFrame, qc: DataFrame, linear: bool = True, least: int = 3) -> DataFrame:
    """(feature, n, spread): RSD in percent of linear values, SD of logged ones, over the QC samples."""
    sd = F.stddev_samp("value")
    return cells.join(qc, "sample", "left_semi").groupBy("feature").agg(F.count("value").alias("n"), (100 * F.try_divide(sd, F.nullif(F.avg("value"), F.lit(0.0))) if linear else sd).alias("spread")).where(F.col("n") >= least)


def blank_ratio(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(feature, ratio): mean over blanks by mean over study samples; samples: (sample, sample_type)."""
    t = cells.join(samples.select("sample", "sample_type"), "sample")
    return t.groupBy("feature").agg(F.try_divide(F.avg(F.when(F.col("sample_type") == "blank", F.col("value"))), F.nullif(F.avg(F.when(F.col("sample_type") == "study", F.col("value"))), F.lit(0.0))).alias("ratio"))


def cluster_facts(samples: DataFrame) -> DataFrame:
    """(n_subjects, n_samples, smallest, largest, balanced, repeated): samples (sample, subject, time) by subject."""
    per = samples.where("subject <> ''").groupBy("subject").agg(F.count("*").alias("n"))
    twice = samples.where("subject <> '' and time <> ''").groupBy("subject", "time").count().where("count > 1").agg(F.count("*").alias("repeated"))
    return per.agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n_samples"), F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.min("n") == F.max("n")).alias("balanced")).crossJoin(F.broadcast(twice))


def subject_gaps(samples: DataFrame) -> DataFrame:
    """(subject, time, gap): the distance to the subject's time before; samples (subject, time as a number)."""
    return samples.select("subject", "time", (F.col("time") - F.lag("time").over(Window.partitionBy("subject").orderBy("time"))).alias("gap")).where("gap is not null")


def constant_within(samples: DataFrame, subject: str, variable: str) -> DataFrame:
    """(constant, determined): whether the variable has one value in each subject, and so nests."""
    return samples.groupBy(subject).agg(F.count_distinct(variable).alias("k")).agg((F.max("k") == 1).alias("constant"), F.count_if(F.expr("k > 1")).alias("varying"))


def sample_profile(cells: DataFrame) -> DataFrame:
    """(sample, median, iqr) of values less their feature's median: relative log expression on a log scale."""
    centred = cells.join(cells.groupBy("feature").agg(F.median("y").alias("m")), "feature").withColumn("r", F.col("y") - F.col("m"))
    return centred.groupBy("sample").agg(F.median("r").alias("median"), (F.percentile("r", F.lit(0.75)) - F.percentile("r", F.lit(0.25))).alias("iqr"))


def median_shift(cells: DataFrame) -> DataFrame:
    """(mad): the median absolute deviation of the samples' centred medians."""
    m = sample_profile(cells).select("median")
    mid = m.agg(F.median("median").alias("mid"))
    return m.crossJoin(F.broadcast(mid)).agg(F.median(F.abs(F.col("median") - F.col("mid"))).alias("mad"))


def median_scaling(cells: DataFrame, least: int = 3) -> DataFrame:
    """(n, mad) of log2 feature medians: small where features were scaled to a common median; NULL under `least` positive medians."""
    m = cells.groupBy("feature").agg(F.median("value").alias("m")).where("m > 0").select(F.log2("m").alias("m"))
    mid = m.agg(F.median("m").alias("mid"))
    return m.crossJoin(F.broadcast(mid)).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.median(F.abs(F.col("m") - F.col("mid")))).alias("mad"))


def feature_cv(cells: DataFrame, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """Coefficient of variation of each feature (by batch, if asked), of at least `least` values."""
    return cells.groupBy("feature", *(by or [])).agg(F.count("value").alias("n"), F.try_divide(F.stddev_samp("value"), F.nullif(F.avg("value"), F.lit(0.0))).alias("cv")).where(F.col("n") >= least)


def batch_boundaries(samples: DataFrame) -> DataFrame:
    """(run_order, batch): where the batch changes in run order."""
    w = Window.orderBy("run_order")  # samples, not cells
    return samples.withColumn("before", F.lag("batch").over(w)).where("before is not null and before <> batch").select("run_order", "batch")


def group_variance(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(feature, variance): mean of the levels' variances."""
    per = cells.join(groups, "sample").groupBy("feature", "level").agg(F.var_samp("value").alias("v"))
    return per.groupBy("feature").agg(F.avg("v").alias("variance"))


def control_trend(cells: DataFrame, controls: DataFrame, order: DataFrame) -> DataFrame:
    """(feature, slope) of control features over the run order."""
    return cells.join(controls, "feature", "left_semi").join(order, "sample").groupBy("feature").agg(F.regr_slope("value", "run_order").alias("slope"))
