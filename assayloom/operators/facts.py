"""What a table's columns hold: facts per column, value and shape counts, templates and name patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

DELIMITERS = ("_", "-", ".", " ", ":", "/")


def melted(table: DataFrame, columns: list[str] | None = None, row: str | None = None) -> DataFrame:
    """(row_idx, column, cell): each cell as text, NULL as the empty text. row: the column that holds the file order."""
    columns = [c for c in (columns or table.columns) if c != row]
    order = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("cell")) for c in columns))
    return table.select(order.alias("row_idx"), F.explode(cells).alias("c")).select("row_idx", "c.column", "c.cell")


def column_facts(cells: DataFrame) -> DataFrame:
    """One row per column of melted cells: kind (numeric, text, empty), n_missing, n_unique, example (the first present cell)."""
    cell = S.stripped(F.col("cell"))
    marked = cells.select("column", "row_idx", cell.alias("cell"), S.is_missing(F.col("cell")).alias("missing"), S.is_number(F.col("cell")).alias("numeric"))
    here = ~F.col("missing")
    return marked.groupBy("column").agg(
        F.when(~F.bool_or(here), "empty").when(F.every(F.col("missing") | F.col("numeric")), "numeric").otherwise("text").alias("kind"),
        F.count_if("missing").alias("n_missing"),
        F.count_distinct(F.when(here, F.col("cell"))).alias("n_unique"),
        F.coalesce(F.min_by("cell", F.when(here, F.col("row_idx"))), F.lit("")).alias("example"),
    )


def numeric_facts(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per group of numbers: n, min, median, max, frac_zero, frac_negative, integer_valued and log10_span of the positive ones."""
    v, positive = F.col(value), F.when(F.col(value) > 0, F.col(value))
    return values.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.median(v).alias("median"), F.max(v).alias("max"),
        F.avg((v == 0).cast("double")).alias("frac_zero"), F.avg((v < 0).cast("double")).alias("frac_negative"),
        F.every(v == F.floor(v)).alias("integer_valued"), (F.log10(F.max(positive)) - F.log10(F.min(positive))).alias("log10_span"),
    )


def top_values(cells: DataFrame, by: list[str], value: Column | str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value. Counts come first, so only distinct values are ranked."""
    counts = cells.groupBy(*by, (F.col(value) if isinstance(value, str) else value).alias("value")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def text_facts(cells: DataFrame, top: int = 12, shapes: int = 3, unique_cut: float = 0.5) -> DataFrame:
    """Per column: unique_ratio, shortest and longest present text, top shapes, and top values unless more than unique_cut of the
    values are unique (then none are told: rows stay private)."""
    here = cells.where(~S.is_missing(F.col("cell"))).select("column", S.stripped(F.col("cell")).alias("cell"))
    basic = here.groupBy("column").agg((F.count_distinct("cell") / F.count("*")).alias("unique_ratio"), F.min(F.length("cell")).alias("shortest"), F.max(F.length("cell")).alias("longest"))
    listed = lambda df, name: df.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(name))
    out = basic.join(listed(top_values(here, ["column"], S.shape(F.col("cell")), shapes), "shapes"), "column")
    out = out.join(listed(top_values(here, ["column"], "cell", top), "values"), "column")
    return out.withColumn("values", F.when(F.col("unique_ratio") <= unique_cut, F.col("values")))


def prefix_counts(cells: DataFrame, prefixes: list[str]) -> DataFrame:
    """Per column, how many present cells begin with each prefix."""
    here = cells.where(~S.is_missing(F.col("cell"))).select("column", S.stripped(F.col("cell")).alias("cell"))
    return here.groupBy("column").agg(*(F.count_if(F.col("cell").startswith(p)).alias(p) for p in prefixes))


def numeric_templates(names: DataFrame) -> DataFrame:
    """Groups of at least two names (column `column`) that are equal but for their digits: template, n_columns, and first and last by name."""
    return names.groupBy(S.name_template(F.col("column")).alias("template")).agg(F.count("*").alias("n_columns"), F.min("column").alias("first"), F.max("column").alias("last")).where("n_columns >= 2")


def template_facts(facts: DataFrame) -> DataFrame:
    """numeric_facts of templated columns (column, ...) over each template: upper median of the medians, and the extremes."""
    ordered = F.array_sort(F.collect_list("median"))
    return facts.groupBy(S.name_template(F.col("column")).alias("template")).agg(
        F.count("*").alias("n_columns"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")).alias("median_of_medians"), F.avg("frac_zero").alias("frac_zero"),
    ).where("n_columns >= 2")


def name_patterns(names: DataFrame, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """For each delimiter and side (first, last): how many names split there and how many distinct parts stand left and right."""
    c = F.col("name")
    ways = [F.struct(F.lit(d).alias("delimiter"), F.lit(side).alias("side"), left.alias("left"), right.alias("right")) for d in delimiters for side, (left, right) in (("first", S.split_first(c, d)), ("last", S.split_last(c, d)))]
    split = names.select(F.explode(F.array(*ways)).alias("s")).select("s.*").where("left is not null")
    return split.groupBy("delimiter", "side").agg(F.count("*").alias("n_split"), F.count_distinct("left").alias("n_left"), F.count_distinct("right").alias("n_right"))


def id_check(table: DataFrame, column: str, examples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(missing, distinct, repeated) counts of an id column, and the most repeated ids."""
    ids = table.select(S.stripped(F.col(f"`{column}`").cast("string")).alias("id"), S.is_missing(F.col(f"`{column}`").cast("string")).alias("missing"))
    counts = ids.where("not missing").groupBy("id").agg(F.count("*").alias("n"))
    summary = counts.agg(F.count("*").alias("n_distinct"), F.count_if(F.expr("n > 1")).alias("n_repeated")).join(ids.agg(F.count_if("missing").alias("n_missing")))
    return summary, counts.where("n > 1").orderBy(F.desc("n"), "id").limit(examples)


def block_facts(cells: DataFrame) -> DataFrame:
    """Per block: features, samples, missing share, zeros, negatives and the median."""
    v = F.col("value")
    return cells.groupBy("block").agg(
        F.count_distinct("feature").alias("n_features"), F.count_distinct("sample").alias("n_samples"),
        (1 - F.count(v) / F.count("*")).alias("missing_share"), F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.median(v).alias("median"),
    )


def history_hints(cells: DataFrame) -> DataFrame:
    """What a block's numbers say about its past: any_negative, below_50 (maximum under 50), steady_medians (the samples' medians
    vary by under 2 % of their mean), nothing_missing_no_zero."""
    v = F.col("value")
    medians = cells.groupBy("block", "sample").agg(F.median(v).alias("m")).groupBy("block").agg(F.try_divide(F.stddev_pop("m"), F.abs(F.avg("m"))).alias("cv"))
    overall = cells.groupBy("block").agg(F.coalesce(F.bool_or(v < 0), F.lit(False)).alias("any_negative"), F.coalesce(F.max(v) < 50, F.lit(False)).alias("below_50"), ((F.count(v) == F.count("*")) & (F.count_if(v == 0) == 0)).alias("nothing_missing_no_zero"))
    return overall.join(medians, "block").select("block", "any_negative", "below_50", F.coalesce(F.col("cv") < 0.02, F.lit(False)).alias("steady_medians"), "nothing_missing_no_zero")
