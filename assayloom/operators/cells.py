"""The long cells table (block, feature, sample, value): made from the three layouts, completed, filtered, and written out again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

CELLS = ("block", "feature_idx", "feature", "sample_idx", "sample", "raw", "value")


def from_samples_in_columns(table: DataFrame, id_col: str, samples: dict[str, str], row: str, block: str = "A1B1") -> DataFrame:
    """Features in rows. samples: column -> sample name; row: the column with the file order."""
    wide = F.array(*(F.struct(F.lit(k).alias("i"), F.lit(s).alias("s"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("raw")) for k, (c, s) in enumerate(samples.items())))
    out = table.select(F.col(f"`{row}`").cast("long").alias("feature_idx"), S.stripped(F.col(f"`{id_col}`").cast("string")).alias("feature"), F.explode(wide).alias("c"))
    return out.select(F.lit(block).alias("block"), "feature_idx", "feature", F.col("c.i").cast("long").alias("sample_idx"), F.col("c.s").alias("sample"), F.col("c.raw").alias("raw"), S.number(F.col("c.raw")).alias("value"))


def from_samples_in_rows(table: DataFrame, id_col: str, features: list[str], row: str, block: str = "A1B1") -> DataFrame:
    """Samples in rows: the same with the roles changed."""
    out = from_samples_in_columns(table, id_col, {f: f for f in features}, row, block)
    return out.select("block", F.col("sample_idx").alias("feature_idx"), F.col("sample").alias("feature"), F.col("feature_idx").alias("sample_idx"), F.col("feature").alias("sample"), "raw", "value")


def long_duplicates(table: DataFrame, feature: str, sample: str) -> DataFrame:
    """(feature, sample, n) of the pairs that a long table has more than once."""
    pair = table.select(S.stripped(F.col(f"`{feature}`").cast("string")).alias("feature"), S.stripped(F.col(f"`{sample}`").cast("string")).alias("sample"))
    return pair.groupBy("feature", "sample").agg(F.count("*").alias("n")).where("n > 1")


def from_long(table: DataFrame, feature: str, sample: str, value: str, row: str, block: str = "A1B1") -> DataFrame:
    """A long table as cells over its complete grid, features and samples in order of first appearance. Repeated pairs are refused."""
    if bad := long_duplicates(table, feature, sample).orderBy("feature", "sample").take(5):
        raise ValueError("repeated (feature, sample) pairs: " + ", ".join(f"{r.feature} / {r.sample} ({r.n})" for r in bad))
    rows = table.select(F.col(f"`{row}`").cast("long").alias("i"), *(S.stripped(F.col(f"`{c}`").cast("string")).alias(n) for c, n in ((feature, "feature"), (sample, "sample"))), F.coalesce(F.col(f"`{value}`").cast("string"), F.lit("")).alias("raw"))
    out = complete_grid(rows.select("i", "feature", "sample", "raw"), ["raw"], order="i")
    return out.select(F.lit(block).alias("block"), "feature_idx", "feature", "sample_idx", "sample", F.coalesce("raw", F.lit("")).alias("raw"), S.number(F.col("raw")).alias("value"))


def in_order(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with name: 0, 1, ... in the order of `by`. Rows are dealt to tasks by range; each task counts its own, and starts behind those of the
    ranges before it (a row per range). Rows that are equal in `by` come in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % (1 << 33)}).persist()
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()
    before, n = [], 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before.append((r["__part"], n))
        n += r.n
    starts = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def stacked(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of a unit one below the other: (row, sample, value), and whose rows they are: (row, block, feature). Rows are numbered from 0 by block
    and feature, so that blocks which share feature ids stay apart."""
    keys = in_order(cells.select("block", "feature").distinct(), ["block", "feature"], "row").select("row", "block", "feature")
    return cells.join(keys, ["block", "feature"]).select("row", "sample", "value"), keys


def unstacked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The blocks of a stacked matrix, whose values may have changed. A row that has no key is an error; rows that are gone stay gone."""
    whose = F.when(F.col("block").isNull(), F.raise_error(F.concat(F.lit("no key for row "), F.col("row").cast("string")))).otherwise(F.col("block"))
    return rows.join(keys, "row", "left").select(whose.alias("block"), "feature", "sample", "value")


def complete_grid(pairs: DataFrame, values: list[str], order: str | None = None) -> DataFrame:
    """Every feature with every sample: absent pairs have NULL values. The distinct samples are the small side; their number is
    checked by the planner before it is broadcast. The product is the grid itself, not a step on the way to fewer rows."""
    def keys(c: str, i: str) -> DataFrame:
        first = pairs.groupBy(c).agg(F.min(order if order else c).alias("o"))
        return in_order(first, ["o", c], i).select(c, i) if order else first.select(c)

    grid = keys("feature", "feature_idx").crossJoin(keys("sample", "sample_idx"))
    return grid.join(pairs.select("feature", "sample", *values), ["feature", "sample"], "left")


def to_matrix(cells: DataFrame, samples: list[str]) -> DataFrame:
    """Features in rows, a column per sample: for export only."""
    return cells.groupBy("feature").pivot("sample", samples).agg(F.first("value"))


def flags(features: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """features with flagged and flag_reason. rules: (column, "is" or "prefix", values), reasons joined in the rules' order by "; "."""
    hits = []
    for column, how, values in rules:
        cell = S.stripped(F.col(f"`{column}`").cast("string"))
        hit = cell.isin(*values) if how == "is" else reduce(lambda a, b: a | b, [cell.startswith(v) for v in values])
        hits.append(F.when(hit, F.lit(column)))
    reason = F.concat_ws("; ", *hits) if hits else F.lit("")
    return features.withColumns({"flagged": reason != "", "flag_reason": reason})


def sample_types(samples: DataFrame, rules: list[tuple[str, list[str]]], default: str = "study", typed: str | None = None) -> DataFrame:
    """samples with sample_type: the type column's word first, then the first rule (type, patterns) whose pattern fits, else default."""
    out = F.when(S.stripped(F.col(typed)) != "", S.stripped(F.col(typed))) if typed else F.when(F.lit(False), "")
    for kind, patterns in rules:
        out = out.when(reduce(lambda a, b: a | b, [S.matches_glob(F.col("sample"), p) for p in patterns]), kind)
    kind = out.otherwise(default)
    return samples.withColumns({"sample_type": kind, "is_study_sample": kind == "study"})


def first_per_key(table: DataFrame, key: str, row: str) -> DataFrame:
    """The first row of each key in file order."""
    rank = F.row_number().over(Window.partitionBy(F.col(f"`{key}`")).orderBy(F.col(f"`{row}`")))
    return table.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_sample_info(samples: DataFrame, info: DataFrame, key: str, row: str) -> DataFrame:
    """samples with the columns of an information file, matched on the stripped id, first row of an id counting; names that clash
    get " (info)". Samples without a row keep NULLs."""
    first = first_per_key(info.withColumn("__key", S.stripped(F.col(f"`{key}`").cast("string"))), "__key", row).drop(key, row)
    renamed = first.select("__key", *(F.col(f"`{c}`").alias(f"{c} (info)" if c in samples.columns else c) for c in first.columns if c != "__key"))
    return samples.join(renamed, S.stripped(F.col("sample")) == F.col("__key"), "left").drop("__key")


def match_report(samples: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """matched, only_samples, only_info, repeated: how the ids of the two sides meet."""
    counts = info.groupBy(S.stripped(F.col(f"`{key}`").cast("string")).alias("k")).agg(F.count("*").alias("n"))
    met = samples.select(S.stripped(F.col("sample")).alias("s")).distinct().join(counts, F.col("s") == F.col("k"), "full")
    return met.agg(F.count_if(F.expr("s is not null and k is not null")).alias("matched"), F.count_if(F.expr("k is null")).alias("only_samples"), F.count_if(F.expr("s is null")).alias("only_info"), F.count_if(F.expr("n > 1")).alias("repeated"))


def id_overlap(samples: DataFrame, info: DataFrame, columns: list[str]) -> DataFrame:
    """For each column of an information file, how many distinct samples its values name: the best is the id column."""
    values = F.array(*(F.struct(F.lit(c).alias("column"), S.stripped(F.col(f"`{c}`").cast("string")).alias("v")) for c in columns))
    cells = info.select(F.explode(values).alias("x")).select("x.column", "x.v").distinct()
    hits = cells.join(samples.select(S.stripped(F.col("sample")).alias("v")).distinct(), "v", "left_semi").groupBy("column").agg(F.count("*").alias("n_matched"))
    return cells.select("column").distinct().join(hits, "column", "left").select("column", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def audit_set(cells: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """The cells of study samples and unflagged features."""
    return cells.join(samples.where("is_study_sample").select("sample"), "sample", "left_semi").join(features.where("flagged").select("feature"), "feature", "left_anti")


def half_minimum(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """half of the smallest positive value per group (1.0 without any), as `offset`."""
    return cells.groupBy(*(by or [])).agg(F.coalesce(F.min(F.when(F.col("value") > 0, F.col("value"))) / 2, F.lit(1.0)).alias("offset"))


def signs(cells: DataFrame) -> DataFrame:
    """(block, zeros, negative, half): whether a block has zeros and negative values, and half of its smallest positive one."""
    return cells.groupBy("block").agg(F.bool_or(F.col("value") == 0).alias("zeros"), F.bool_or(F.col("value") < 0).alias("negative"), (F.min(F.when(F.col("value") > 0, F.col("value"))) / 2).alias("half"))


def diagnostic_copy(cells: DataFrame, linear: bool, known: dict | None = None) -> DataFrame:
    """cells with y: log2 of linear values (plus half the smallest positive where zeros occur), else the value. Never saved as data.
    known: the row of signs() if the cells are of one block, so that they needn't be read for it."""
    value = S.finite(F.col("value"))
    if not linear:
        return cells.withColumn("y", value)
    if known is None:
        cells = cells.join(F.broadcast(signs(cells)), "block")  # a row per block
        zeros, negative, half = F.col("zeros"), F.col("negative"), F.col("half")
    else:
        zeros, negative, half = (F.lit(known.get(c)).cast(t) for c, t in (("zeros", "boolean"), ("negative", "boolean"), ("half", "double")))
    shifted = value + F.when(zeros, half).otherwise(0.0)
    return cells.withColumn("y", F.when(negative, value).otherwise(F.when(shifted > 0, F.log2(shifted)))).drop("zeros", "negative", "half")


def floor_marks(cells: DataFrame, least: int = 5, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """cells with at_floor: the value is its feature's minimum, which at least two samples share among `least` observed ones."""
    w = Window.partitionBy(*by)
    v, low = F.col("value"), F.min("value").over(w)
    n_low = F.sum((v == F.col("__low")).cast("int")).over(w)
    marked = cells.withColumn("__low", low).withColumn("__ties", n_low).withColumn("__n", F.count("value").over(w))
    return marked.withColumn("at_floor", F.coalesce((F.col("__ties") >= 2) & (F.col("__n") >= least) & (v == F.col("__low")), F.lit(False))).drop("__low", "__ties", "__n")


def encoding(marked: DataFrame) -> Column:
    """missing, zero, floor_tied or observed: each cell is exactly one."""
    v = F.col("value")
    return F.when(v.isNull(), "missing").when(v == 0, "zero").when(F.col("at_floor"), "floor_tied").otherwise("observed")


def diagnostic_matrix(cells: DataFrame, policy: str = "complete_features", q: float = 100, sample_missing_max: float = 0.5, value: str = "y") -> DataFrame:
    """The cells of a matrix without gaps; nothing is filled.

    all_observed: refused if a value is missing. complete_features: features observed everywhere (q 100); below, samples that miss
    more than sample_missing_max are dropped, then features observed in q % of all samples and in every kept one stay.
    exclude_floor: without features that have floor ties; floor_censored: floor-tied cells count as missing. Both need at_floor.
    """
    y = F.col(value)
    if policy == "floor_censored":
        cells = cells.withColumn(value, F.when(~F.col("at_floor"), y))
    if policy == "all_observed":
        if not cells.where(y.isNull()).isEmpty():
            raise ValueError("all_observed is for matrices without missing values")
        return cells
    kept = cells
    if q < 100:
        good = cells.groupBy("sample").agg((1 - F.count(y) / F.count("*")).alias("rate")).where(F.col("rate") <= sample_missing_max)
        kept = cells.join(good, "sample", "left_semi")
        whole = kept.groupBy("feature").agg(F.count(y).alias("n"), F.count("*").alias("of")).where("n = of").select("feature")
        share = cells.groupBy("feature").agg((100 * F.count(y) / F.count("*")).alias("share")).where(F.col("share") >= q - 1e-9)
        rows = share.join(whole, "feature").select("feature")
    else:
        rows = cells.groupBy("feature").agg(F.count(y).alias("n"), F.count("*").alias("of")).where("n = of").select("feature")
    if policy == "exclude_floor":
        rows = rows.join(cells.where("at_floor").select("feature"), "feature", "left_anti")
    return kept.join(rows, "feature", "left_semi")


LADDER = (100, 75, 50)


def default_matrix(cells: DataFrame, least: int = 20, least_share: float = 0.1, policy: str = "complete_features", **how) -> tuple[DataFrame, dict]:
    """The first rung of 100, 75, 50 that keeps enough features, else the largest; and a report of the rungs tried."""
    total = cells.select("feature").distinct().count()
    tried, best = [], None
    for q in LADDER:
        d = diagnostic_matrix(cells, policy, q, **how)
        n = d.select("feature").distinct().count()
        tried.append({"q": q, "n_features": n, "n_samples": d.select("sample").distinct().count()})
        if best is None or n > best[1]:
            best = (d, n, q)
        if n >= least and n >= least_share * total:
            return d, {"policy": policy, "q": q, "n_features_used": n, "of": total, "fallback": tried if q != 100 else [], "below_minimum": False}
    return best[0], {"policy": policy, "q": best[2], "n_features_used": best[1], "of": total, "fallback": tried, "below_minimum": True}


def variants(cells: DataFrame, least_observed: int = 5, **how) -> list[tuple[str, DataFrame, dict]]:
    """The default matrix, and the others that a finding should not depend on: without floor-tied features, with floor-tied cells
    missing, and the other rungs of the ladder."""
    base, report = default_matrix(cells, **how)
    out = [("base", base, report)]
    marked = floor_marks(cells, least_observed)
    if not marked.where("at_floor").isEmpty():
        out += [(p, diagnostic_matrix(marked, p, report["q"]), {"policy": p, "q": report["q"]}) for p in ("exclude_floor", "floor_censored")]
    return out + [(f"q{q}", diagnostic_matrix(cells, q=q), {"policy": "complete_features", "q": q}) for q in LADDER if q != report["q"]]


def sensitivity(found: list[tuple[str, DataFrame, dict]], conclude) -> dict:
    """What conclude (a function of a matrix, None where it can't tell) says of each variant, and whether it depends on the variant."""
    rows = [{"variant": name, **report, "conclusion": conclude(d)} for name, d, report in found]
    said = {str(r["conclusion"]) for r in rows if r["conclusion"] is not None}
    return {"variants": rows, "same_conclusion": len(said) <= 1, "depends": len(said) > 1}
