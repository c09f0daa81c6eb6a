"""Registered queries over the test tables, each with the SQL that states the same result.

Stand-ins for feature x sample tables: m1, part brands x suppliers, complete; m2, parts x supplier nations on the complete grid, with
gaps; m3, part brands and types x nations; samples of m2 and m3 are nations, their batch the region. Values are sums of quantities: whole numbers, so that sums don't depend on
their order; derived numbers are rounded on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cells as C
from ..operators import facts, fits, missing, spectra, stats, transforms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {VIEWS} {sql}"
        return f

    return register


VIEWS = """
li AS (SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
m1 AS (SELECT p_brand AS feature, CAST(l_suppkey AS VARCHAR) AS sample, SUM(l_quantity) AS value FROM li JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m2p AS (SELECT CAST(l_partkey AS VARCHAR) AS feature, n_name AS sample, SUM(l_quantity) AS value FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
m2 AS (SELECT f.feature, s.sample, p.value FROM (SELECT DISTINCT feature FROM m2p) f CROSS JOIN (SELECT DISTINCT sample FROM m2p) s LEFT JOIN m2p p ON p.feature = f.feature AND p.sample = s.sample),
smp AS (SELECT n_name AS sample, r_name AS batch, CAST(n_nationkey % 8 AS VARCHAR) AS subject, n_nationkey AS run_order FROM nation JOIN region ON n_regionkey = r_regionkey),
dx AS (SELECT feature, sample, LOG2(value) AS y FROM m2),
m3p AS (SELECT p_brand || ' ' || p_type AS feature, n_name AS sample, SUM(l_quantity) AS value FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m3 AS (SELECT f.feature, s.sample, LOG2(p.value) AS y FROM (SELECT DISTINCT feature FROM m3p) f CROSS JOIN (SELECT DISTINCT sample FROM m3p) s LEFT JOIN m3p p ON p.feature = f.feature AND p.sample = s.sample),
bx AS (SELECT 'A1B1' AS block, feature, sample, y AS value FROM dx UNION ALL SELECT 'A1B2', feature, sample, 2 * y + 1 FROM dx WHERE CAST(feature AS BIGINT) % 2 = 0),
cm AS (SELECT feature, sample, y FROM m3 WHERE feature IN (SELECT feature FROM m3 GROUP BY 1 HAVING COUNT(y) = COUNT(*)))
"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def m1(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    by = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))  # combined before the join
    brand = table(spark, d, "part").select("p_partkey", "p_brand")
    return by.join(brand, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), F.col("l_suppkey").cast("string").alias("sample")).agg(F.sum("q").alias("value"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sample"), F.col("r_name").alias("batch"), (F.col("n_nationkey") % 8).cast("string").alias("subject"), F.col("n_nationkey").alias("run_order"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    where = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("sample"))
    return li.join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").cast("string").alias("feature"), "sample").agg(F.sum("l_quantity").alias("value"))


def m2(spark: SparkSession, d: str) -> DataFrame:
    return C.complete_grid(pairs(spark, d), ["value"])


def logged(spark: SparkSession, d: str) -> DataFrame:
    return m2(spark, d).withColumn("y", F.log2("value"))


def complete(spark: SparkSession, d: str) -> DataFrame:
    """m3, brands and types x nations, without the features that have gaps."""
    kinds = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("feature"), F.concat_ws(" ", "p_brand", "p_type").alias("kind"))
    sums = pairs(spark, d).join(kinds, "feature").groupBy(F.col("kind").alias("feature"), "sample").agg(F.sum("value").alias("value"))
    return C.diagnostic_matrix(C.complete_grid(sums, ["value"]).withColumn("y", F.log2("value")))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns as doubles, rounded; -0 is 0."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def text_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


# ---------------------------------------------------------------- columns and values


@query("""SELECT column_name, kind, n_missing, n_unique FROM (
  SELECT 'c_custkey' AS column_name, 'numeric' AS kind, CAST(COUNT(*) FILTER (c_custkey IS NULL) AS BIGINT) AS n_missing, CAST(COUNT(DISTINCT c_custkey) AS BIGINT) AS n_unique FROM customer
  UNION ALL SELECT 'c_name', 'text', COUNT(*) FILTER (TRIM(c_name) IN ('', 'NA', 'N/A', 'NaN', 'nan', 'null', 'NULL', 'None')), COUNT(DISTINCT c_name) FROM customer
  UNION ALL SELECT 'c_acctbal', 'numeric', COUNT(*) FILTER (c_acctbal IS NULL), COUNT(DISTINCT c_acctbal) FROM customer
  UNION ALL SELECT 'c_mktsegment', 'text', COUNT(*) FILTER (TRIM(c_mktsegment) = ''), COUNT(DISTINCT c_mktsegment) FROM customer
  UNION ALL SELECT 'c_nationkey', 'numeric', COUNT(*) FILTER (c_nationkey IS NULL), COUNT(DISTINCT c_nationkey) FROM customer)""")
def column_facts(spark, d):
    return facts.column_facts(facts.melted(text_table(spark, d), row=None)).select(F.col("column").alias("column_name"), "kind", "n_missing", "n_unique")


@query("""SELECT feature, n, ROUND(min, 6) AS min, ROUND(median, 6) AS median, ROUND(max, 6) AS max, ROUND(frac_zero, 6) AS frac_zero, ROUND(frac_negative, 6) AS frac_negative, integer_valued, ROUND(span, 6) AS log10_span FROM (
  SELECT c_mktsegment AS feature, COUNT(*) AS n, MIN(c_acctbal) AS min, MEDIAN(c_acctbal) AS median, MAX(c_acctbal) AS max, AVG(CASE WHEN c_acctbal = 0 THEN 1.0 ELSE 0.0 END) AS frac_zero,
    AVG(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS frac_negative, BOOL_AND(c_acctbal = FLOOR(c_acctbal)) AS integer_valued, LOG10(MAX(c_acctbal) FILTER (c_acctbal > 0)) - LOG10(MIN(c_acctbal) FILTER (c_acctbal > 0)) AS span FROM customer GROUP BY 1)""")
def numeric_facts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("feature"), F.col("c_acctbal").alias("value"))
    return rounded(facts.numeric_facts(c, ["feature"]), "min", "median", "max", "frac_zero", "frac_negative", "log10_span")


@query("""SELECT value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT p_type AS value, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, p_type) AS rank FROM part GROUP BY 1) WHERE rank <= 12""")
def value_counts_topk(spark, d):
    cells = table(spark, d, "part").select(F.lit("p_type").alias("column"), F.col("p_type").alias("cell"))
    return facts.top_values(cells, ["column"], "cell", 12).select("value", "n", "rank")


@query("""SELECT shape, COUNT(*) AS n FROM (SELECT SUBSTR(REGEXP_REPLACE(REGEXP_REPLACE(TRIM(p_name), '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 1, 40) AS shape FROM part) GROUP BY 1""")
def value_shapes(spark, d):
    return table(spark, d, "part").groupBy(S.shape(F.col("p_name")).alias("shape")).agg(F.count("*").alias("n"))


@query("""SELECT template, COUNT(*) AS n_columns, MIN(name) AS first, MAX(name) AS last FROM (SELECT c_name AS name, REGEXP_REPLACE(c_name, '[0-9]+', '#', 'g') AS template FROM customer) GROUP BY 1 HAVING COUNT(*) >= 2""")
def name_templates(spark, d):
    return facts.numeric_templates(table(spark, d, "customer").select(F.col("c_name").alias("column")))


@query("""SELECT delimiter, side, CAST(COUNT(*) AS BIGINT) AS n_split, CAST(COUNT(DISTINCT l) AS BIGINT) AS n_left, CAST(COUNT(DISTINCT r) AS BIGINT) AS n_right FROM (
  SELECT d AS delimiter, 'first' AS side, SUBSTR(p_name, 1, INSTR(p_name, d) - 1) AS l, SUBSTR(p_name, INSTR(p_name, d) + 1) AS r FROM part, (VALUES ('_'), ('-'), ('.'), (' '), (':'), ('/')) t(d) WHERE INSTR(p_name, d) > 1 AND INSTR(p_name, d) < LENGTH(p_name)
  UNION ALL SELECT d AS delimiter, 'last' AS side, SUBSTR(p_name, 1, LENGTH(p_name) - INSTR(REVERSE(p_name), d)) AS l, SUBSTR(p_name, LENGTH(p_name) - INSTR(REVERSE(p_name), d) + 2) AS r FROM part, (VALUES ('_'), ('-'), ('.'), (' '), (':'), ('/')) t(d) WHERE INSTR(REVERSE(p_name), d) > 1 AND INSTR(REVERSE(p_name), d) < LENGTH(p_name)) GROUP BY 1, 2""")
def name_patterns(spark, d):
    return facts.name_patterns(table(spark, d, "part").select(F.col("p_name").alias("name")))


@query("""SELECT (SELECT COUNT(DISTINCT c_mktsegment) FROM customer) AS n_distinct, (SELECT COUNT(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING COUNT(*) > 1)) AS n_repeated, (SELECT COUNT(*) FROM customer WHERE c_mktsegment IS NULL) AS n_missing""")
def id_check(spark, d):
    return facts.id_check(table(spark, d, "customer"), "c_mktsegment")[0]


@query("""SELECT c_mktsegment AS id, COUNT(*) AS n FROM customer GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY n DESC, id LIMIT 5""")
def id_check_examples(spark, d):
    return facts.id_check(table(spark, d, "customer"), "c_mktsegment")[1]


@query("""SELECT 'p_type' AS "column", COUNT(*) FILTER (p_type LIKE 'PROMO%') AS "PROMO", COUNT(*) FILTER (p_type LIKE 'STANDARD%') AS "STANDARD" FROM part UNION ALL SELECT 'p_name', COUNT(*) FILTER (p_name LIKE 'PROMO%'), COUNT(*) FILTER (p_name LIKE 'STANDARD%') FROM part""")
def prefix_counts(spark, d):
    cells = facts.melted(table(spark, d, "part").select("p_type", "p_name"), row=None)
    return facts.prefix_counts(cells, ["PROMO", "STANDARD"])


@query("""SELECT template, COUNT(*) AS n_columns, MIN(lo) AS min, MAX(hi) AS max, LIST_SORT(LIST(med))[CAST(FLOOR(COUNT(*) / 2) AS BIGINT) + 1] AS median_of_medians, ROUND(AVG(z), 6) AS frac_zero
FROM (SELECT REGEXP_REPLACE(p_brand, '[0-9]+', '#', 'g') AS template, MIN(p_size) * 1.0::DOUBLE AS lo, MAX(p_size) * 1.0::DOUBLE AS hi, MEDIAN(p_size) AS med, AVG(CASE WHEN p_size = 0 THEN 1.0 ELSE 0.0 END) AS z FROM part GROUP BY p_brand) GROUP BY 1 HAVING COUNT(*) >= 2""")
def template_facts(spark, d):
    per = facts.numeric_facts(table(spark, d, "part").select(F.col("p_brand").alias("column"), F.col("p_size").cast("double").alias("value")), ["column"])
    return rounded(facts.template_facts(per), "frac_zero")


@query("""SELECT label, ROW_NUMBER() OVER (ORDER BY TRY_CAST(label AS DOUBLE) NULLS LAST, label) AS place FROM (SELECT CAST(p_size AS VARCHAR) AS label FROM part UNION SELECT p_type FROM part UNION SELECT CAST(p_size / 4.0 AS VARCHAR) FROM part WHERE p_size % 4 > 0)""")
def natural_order(spark, d):
    """Sizes, quarters of sizes and types as labels: numbers by value, then texts."""
    from pyspark.sql import Window

    p = table(spark, d, "part")
    labels = p.select(F.col("p_size").cast("string").alias("label")).union(p.select("p_type")).union(p.where("p_size % 4 > 0").select((F.col("p_size") / 4.0).cast("string"))).distinct()
    return labels.select("label", F.row_number().over(Window.orderBy(S.natural_key(F.col("label")))).cast("long").alias("place"))


@query("""SELECT l_suppkey, ROUND(AVG(l_quantity), 6) AS back, ROUND(AVG(CASE WHEN l_discount IS NOT NULL THEN 1 / (1 + EXP(-l_discount)) END), 6) AS p, ROUND(AVG(LN(EXP(l_discount) + EXP(l_tax))), 6) AS both_logs FROM lineitem GROUP BY 1""")
def scalar_pieces(spark, d):
    li = table(spark, d, "lineitem")
    logs = S.unlog(S.log_base(F.col("l_quantity"), 2, 1.0), 2, 1.0)
    return rounded(li.groupBy("l_suppkey").agg(F.avg(logs).alias("back"), F.avg(S.logistic(F.col("l_discount"))).alias("p"), F.avg(S.log_add_exp(F.col("l_discount"), F.col("l_tax"))).alias("both_logs")), "back", "p", "both_logs")


@query("""SELECT 'A1B1' AS block, COUNT(DISTINCT feature) AS n_features, COUNT(DISTINCT sample) AS n_samples, ROUND(1 - COUNT(value) / COUNT(*), 6) AS missing_share, COUNT(*) FILTER (value = 0) AS n_zero, COUNT(*) FILTER (value < 0) AS n_negative, MEDIAN(value) AS median FROM m2""")
def block_facts(spark, d):
    return rounded(facts.block_facts(m2(spark, d).withColumn("block", F.lit("A1B1"))), "missing_share")


@query("""SELECT 'A1B1' AS block, COALESCE(BOOL_OR(value < 0), FALSE) AS any_negative, MAX(value) < 50 AS below_50, (SELECT STDDEV_POP(m) / ABS(AVG(m)) < 0.02 FROM (SELECT MEDIAN(value) AS m FROM m2 GROUP BY sample)) AS steady_medians, COUNT(value) = COUNT(*) AND COUNT(*) FILTER (value = 0) = 0 AS nothing_missing_no_zero FROM m2""")
def history_hints(spark, d):
    return facts.history_hints(m2(spark, d).withColumn("block", F.lit("A1B1")))


@query("""SELECT o_orderkey, ROUND(CASE WHEN o_totalprice = 0 THEN 0 ELSE ROUND(o_totalprice * POW(10, 3 - FLOOR(LOG10(ABS(o_totalprice))))) / POW(10, 3 - FLOOR(LOG10(ABS(o_totalprice)))) END, 4) AS v FROM orders""")
def significant_digits(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.significant(F.col("o_totalprice"), 4), 4).alias("v"))


# ---------------------------------------------------------------- cells


@query("SELECT feature, sample, value FROM m2")
def cells_grid(spark, d):
    return m2(spark, d)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS feature, s.sample, CASE s.sample WHEN 'c_acctbal' THEN c_acctbal ELSE c_nationkey END AS value FROM customer CROSS JOIN (VALUES ('c_acctbal'), ('c_nationkey')) s(sample)""")
def cells_unpivot(spark, d):
    t = table(spark, d, "customer")
    return C.from_samples_in_columns(t, "c_custkey", {"c_acctbal": "c_acctbal", "c_nationkey": "c_nationkey"}, "c_custkey").select("feature", "sample", "value")


@query("""SELECT event_type AS feature, CAST(user_id AS VARCHAR) AS sample, COUNT(*) AS n FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def long_duplicate_pairs(spark, d):
    return C.long_duplicates(table(spark, d, "events"), "event_type", "user_id")


@query(f"""SELECT feature, {", ".join(f"MAX(value) FILTER (sample = 'NATION_{i}') AS nation_{i}" for i in range(25))} FROM m2 GROUP BY 1""")
def pivot_export(spark, d):
    names = {r.n_name: f"nation_{r.n_nationkey}" for r in table(spark, d, "nation").orderBy("n_nationkey").collect()}  # a row per sample
    return C.to_matrix(m2(spark, d), list(names)).select("feature", *(F.col(k).alias(v) for k, v in names.items()))


FLAG_RULES = [("p_type", "prefix", ["PROMO", "STANDARD"]), ("p_brand", "is", ["Brand#11", "Brand#22"])]


@query("""SELECT p_partkey, reason <> '' AS flagged, reason AS flag_reason FROM (SELECT p_partkey, CONCAT_WS('; ', CASE WHEN TRIM(p_type) LIKE 'PROMO%' OR TRIM(p_type) LIKE 'STANDARD%' THEN 'p_type' END, CASE WHEN p_brand IN ('Brand#11', 'Brand#22') THEN 'p_brand' END) AS reason FROM part)""")
def flag_reasons(spark, d):
    return C.flags(table(spark, d, "part"), FLAG_RULES).select("p_partkey", "flagged", "flag_reason")


@query("""SELECT sample, sample_type, sample_type = 'study' AS is_study_sample FROM (SELECT n_name AS sample, CASE WHEN n_name LIKE 'A%' OR n_name LIKE 'B%' THEN 'qc' WHEN n_name LIKE '%A' THEN 'blank' ELSE 'study' END AS sample_type FROM nation)""")
def sample_glob_types(spark, d):
    return C.sample_types(samples(spark, d).select("sample"), [("qc", ["A*", "B*"]), ("blank", ["*A"])])


@query("""SELECT feature, sample, value FROM m2 WHERE sample NOT LIKE 'A%' AND feature NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE TRIM(p_type) LIKE 'PROMO%')""")
def audit_set(spark, d):
    s = C.sample_types(samples(spark, d), [("qc", ["A*"])])
    f = C.flags(table(spark, d, "part"), [("p_type", "prefix", ["PROMO"])]).select(F.col("p_partkey").cast("string").alias("feature"), "flagged")
    return C.audit_set(m2(spark, d), s, f)


@query("""SELECT s.sample, s.batch, i."batch (info)" FROM smp s LEFT JOIN (SELECT n_name, s_name AS "batch (info)" FROM (SELECT n_name, s_name, ROW_NUMBER() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3) WHERE k = 1) i ON s.sample = i.n_name""")
def sample_table_join(spark, d):
    info = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("id"), F.col("s_name").alias("batch"), "s_suppkey")
    return C.with_sample_info(samples(spark, d).select("sample", "batch"), info, "id", "s_suppkey")


@query("""SELECT CAST(COUNT(*) FILTER (s.sample IS NOT NULL AND i.k IS NOT NULL) AS BIGINT) AS matched, CAST(COUNT(*) FILTER (i.k IS NULL) AS BIGINT) AS only_samples, CAST(COUNT(*) FILTER (s.sample IS NULL) AS BIGINT) AS only_info, CAST(COUNT(*) FILTER (i.n > 1) AS BIGINT) AS repeated
FROM smp s FULL JOIN (SELECT n_name AS k, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY 1) i ON s.sample = i.k""")
def info_match(spark, d):
    info = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("id"))
    return C.match_report(samples(spark, d), info, "id")


@query("""SELECT 'n_name' AS "column", COUNT(DISTINCT TRIM(n_name)) AS n_matched FROM nation WHERE TRIM(n_name) IN (SELECT sample FROM smp) UNION ALL SELECT 'n_regionkey', COUNT(DISTINCT CAST(n_regionkey AS VARCHAR)) FROM nation WHERE CAST(n_regionkey AS VARCHAR) IN (SELECT sample FROM smp)""")
def id_overlap(spark, d):
    return C.id_overlap(samples(spark, d), table(spark, d, "nation"), ["n_name", "n_regionkey"])


@query("""SELECT feature, (SELECT COUNT(*) FROM nation WHERE n_name IN (SELECT sample FROM m2p)) AS both, (SELECT COUNT(*) FROM nation) - COUNT(DISTINCT sample) AS only_nation FROM m2p GROUP BY 1""")
def set_ops_samples(spark, d):
    """Nations that are samples at all, and for each part those that it lacks."""
    p, n = pairs(spark, d).select("feature", "sample"), table(spark, d, "nation").select(F.col("n_name").alias("sample"))
    both = n.intersect(p.select("sample")).agg(F.count("*").alias("both"))
    features = p.select("feature").distinct()
    only = features.crossJoin(F.broadcast(n)).subtract(p).groupBy("feature").agg(F.count("*").alias("only_nation"))  # n: a row per nation
    return features.join(only, "feature", "left").crossJoin(F.broadcast(both)).select("feature", "both", F.coalesce("only_nation", F.lit(0)).alias("only_nation"))


@query("""SELECT value, n, ROUND(n / (SELECT COUNT(value) FROM m2), 6) AS share FROM (SELECT value, COUNT(*) AS n FROM m2 WHERE value <> 0 GROUP BY 1 ORDER BY n DESC, value LIMIT 1)""")
def sentinel_value(spark, d):
    return rounded(missing.sentinel(m2(spark, d)), "share")


@query("""SELECT n, COUNT(*) AS n_groups FROM (SELECT v, COUNT(*) AS n FROM (SELECT feature, LIST(value IS NULL ORDER BY sample) AS v FROM m2 GROUP BY 1) GROUP BY 1 HAVING COUNT(*) > 1) GROUP BY 1""")
def identical_vectors(spark, d):
    """Features that were observed in the very same samples."""
    seen = m2(spark, d).withColumn("value", F.when(F.col("value").isNotNull(), 1.0))
    return missing.identical_vectors(seen, "feature", "sample").groupBy("n").agg(F.count("*").alias("n_groups"))


@query("""SELECT feature, COUNT(value) AS n_observed, COUNT(*) AS n, ROUND(1 - COUNT(value) / COUNT(*), 6) AS missing_rate, ROUND(COUNT(*) FILTER (value = 0) / COUNT(*), 6) AS zero_rate FROM m2 GROUP BY 1""")
def missing_rates(spark, d):
    return rounded(missing.rates(m2(spark, d), ["feature"]), "missing_rate", "zero_rate")


@query("""SELECT sample, COUNT(value) AS n_observed, COUNT(*) AS n, ROUND(1 - COUNT(value) / COUNT(*), 6) AS missing_rate, ROUND(COUNT(*) FILTER (value = 0) / COUNT(*), 6) AS zero_rate FROM m2 GROUP BY 1""")
def missing_rates_by_sample(spark, d):
    return rounded(missing.rates(m2(spark, d), ["sample"]), "missing_rate", "zero_rate")


@query("""SELECT ROUND(MIN(r), 6) AS min, ROUND(MEDIAN(r), 6) AS median, ROUND(QUANTILE_CONT(r, 0.9), 6) AS p90, ROUND(MAX(r), 6) AS max FROM (SELECT 1 - COUNT(value) / COUNT(*) AS r FROM m2 GROUP BY feature)""")
def missing_rate_summary(spark, d):
    return rounded(missing.rate_summary(missing.rates(m2(spark, d), ["feature"])), "min", "median", "p90", "max")


@query("""SELECT at_most, ROUND(COUNT(*) FILTER (r <= at_most) / COUNT(*), 6) AS share FROM (SELECT 1 - COUNT(value) / COUNT(*) AS r FROM m2 GROUP BY feature), (VALUES (0.0::DOUBLE), (0.1), (0.25), (0.5)) t(at_most) GROUP BY 1""")
def missing_shares(spark, d):
    return rounded(missing.missing_shares(m2(spark, d)), "share")


FLOOR_SQL = "fl AS (SELECT *, COALESCE(value = MIN(value) OVER w AND COUNT(value) OVER w >= 5 AND SUM(CASE WHEN value = lo THEN 1 ELSE 0 END) OVER w >= 2, FALSE) AS at_floor FROM (SELECT *, MIN(value) OVER (PARTITION BY feature) AS lo FROM m2) WINDOW w AS (PARTITION BY feature))"


@query(f", {FLOOR_SQL} SELECT CASE WHEN value IS NULL THEN 'missing' WHEN value = 0 THEN 'zero' WHEN at_floor THEN 'floor_tied' ELSE 'observed' END AS cell_class, COUNT(*) AS n FROM fl GROUP BY 1")
def cell_encoding(spark, d):
    return missing.encoding_counts(m2(spark, d))


@query(f", {FLOOR_SQL} SELECT feature, COUNT(*) FILTER (at_floor) AS n_floor FROM fl GROUP BY 1 HAVING COUNT(*) FILTER (at_floor) > 0")
def floor_ties(spark, d):
    return C.floor_marks(m2(spark, d)).where("at_floor").groupBy("feature").agg(F.count("*").alias("n_floor"))


@query("""SELECT batch AS level, ROUND(1 - COUNT(value) / COUNT(*), 6) AS missing_rate, COUNT(DISTINCT sample) AS n_samples FROM m2 JOIN smp USING (sample) GROUP BY 1""")
def missing_by_batch(spark, d):
    v = samples(spark, d).select("sample", F.lit("batch").alias("name"), F.col("batch").alias("level"))
    return rounded(missing.rate_by_level(m2(spark, d), v), "missing_rate").drop("name")


COVER_SQL = ", cv AS (SELECT feature, COUNT(*) FILTER (seen = 0 AND size >= 3) AS absent_levels, MIN(seen) AS lowest FROM (SELECT feature, batch, COUNT(value) AS seen, COUNT(*) AS size FROM m2 JOIN smp USING (sample) GROUP BY 1, 2) GROUP BY 1)"


@query(f"{COVER_SQL} SELECT feature, absent_levels, lowest FROM cv")
def batch_wide_absence(spark, d):
    return missing.level_coverage(m2(spark, d), samples(spark, d).select("sample", "batch"))


@query(f"{COVER_SQL} SELECT ROUND(COUNT(*) FILTER (absent_levels > 0) / COUNT(*), 6) AS batch_wide_absent, ROUND(COUNT(*) FILTER (lowest >= 1) / COUNT(*), 6) AS one_in_every_level, ROUND(COUNT(*) FILTER (lowest >= 2) / COUNT(*), 6) AS two_in_every_level FROM cv")
def batch_coverage(spark, d):
    c = missing.level_coverage(m2(spark, d), samples(spark, d).select("sample", "batch"))
    return rounded(missing.coverage_shares(c), "batch_wide_absent", "one_in_every_level", "two_in_every_level")


@query("""SELECT threshold, COUNT(*) FILTER (share >= threshold - 1e-9) AS n_kept FROM (SELECT feature, 100 * COUNT(value) / COUNT(*) AS share FROM m2 GROUP BY 1), (VALUES (100), (90), (75), (50), (25)) t(threshold) GROUP BY 1""")
def completeness_overall(spark, d):
    return missing.completeness(m2(spark, d))


@query("""SELECT threshold, COUNT(*) FILTER (share >= threshold - 1e-9) AS n_kept FROM (SELECT feature, MAX(s) AS share FROM (SELECT feature, batch, 100 * COUNT(value) / COUNT(*) AS s FROM m2 JOIN smp USING (sample) GROUP BY 1, 2) GROUP BY 1), (VALUES (100), (90), (75), (50), (25)) t(threshold) GROUP BY 1""")
def completeness_within_group(spark, d):
    return missing.completeness(m2(spark, d), samples(spark, d).select("sample", F.col("batch").alias("level")))


@query("""SELECT feature, ROUND(CASE WHEN n >= 3 AND v > 1e-12 THEN m3 / POW(v, 1.5) END, 5) AS skew FROM (SELECT a.feature, COUNT(a.value) AS n, AVG(POW(a.value - b.m, 2)) AS v, AVG(POW(a.value - b.m, 3)) AS m3 FROM m2 a JOIN (SELECT feature, AVG(value) AS m FROM m2 GROUP BY 1) b USING (feature) GROUP BY 1)""")
def skew_rows(spark, d):
    return rounded(m2(spark, d).groupBy("feature").agg(stats.skewness(F.col("value")).alias("skew")), "skew", digits=5)


@query("""SELECT COUNT(*) AS n, ROUND(MEDIAN(ABS(m - (SELECT MEDIAN(LOG2(v)) FROM (SELECT MEDIAN(value) AS v FROM m2 GROUP BY feature) WHERE v > 0))), 6) AS mad FROM (SELECT LOG2(v) AS m FROM (SELECT MEDIAN(value) AS v FROM m2 GROUP BY feature) WHERE v > 0)""")
def median_scaling(spark, d):
    return rounded(missing.median_scaling(m2(spark, d)), "mad")


# ---------------------------------------------------------------- distribution, quality, outliers

RLE_SQL = ", rle AS (SELECT sample, y - MEDIAN(y) OVER (PARTITION BY feature) AS r FROM dx WHERE y IS NOT NULL)"


@query(f"{RLE_SQL} SELECT sample, ROUND(MEDIAN(r), 6) AS median, ROUND(QUANTILE_CONT(r, 0.75) - QUANTILE_CONT(r, 0.25), 6) AS iqr FROM rle GROUP BY 1")
def relative_log_expression(spark, d):
    return rounded(missing.sample_profile(logged(spark, d).where("y is not null")), "median", "iqr")


@query(f"{RLE_SQL}, sm AS (SELECT MEDIAN(r) AS m FROM rle GROUP BY sample) SELECT ROUND(MEDIAN(ABS(m - (SELECT MEDIAN(m) FROM sm))), 6) AS mad FROM sm")
def median_shift(spark, d):
    return rounded(missing.median_shift(logged(spark, d).where("y is not null")), "mad")


Z_SQL = """, md AS (SELECT feature, MEDIAN(y) AS med FROM dx GROUP BY 1), dv AS (SELECT feature, sample, y, y - med AS x FROM dx JOIN md USING (feature)),
sp AS (SELECT feature, MEDIAN(ABS(x)) AS mad, AVG(ABS(x)) AS ad FROM dv GROUP BY 1),
zz AS (SELECT feature, sample, CASE WHEN mad > 0 THEN 0.6745 * x / mad WHEN ad > 0 THEN x / (1.253314 * ad) ELSE 0 END AS z FROM dv JOIN sp USING (feature) WHERE y IS NOT NULL)"""


@query(f"{Z_SQL} SELECT feature, sample, ROUND(z, 6) AS z FROM zz")
def modified_z_cells(spark, d):
    return rounded(stats.with_modified_z(logged(spark, d), ["feature"], "y").where("z is not null").select("feature", "sample", "z"), "z")


@query(f"{Z_SQL} SELECT feature, sample, ROUND(z, 6) AS z FROM zz ORDER BY ROUND(ABS(z), 9) DESC, feature, sample LIMIT 50")
def topk_outlier_cells(spark, d):
    z = stats.with_modified_z(logged(spark, d), ["feature"], "y").where("z is not null")
    return rounded(z.orderBy(F.round(F.abs("z"), 9).desc(), "feature", "sample").limit(50).select("feature", "sample", "z"), "z")


@query("""SELECT feature, MAX(CASE WHEN value IS NULL THEN 0 ELSE run END) AS longest_run FROM (SELECT feature, value, COUNT(value) OVER (PARTITION BY feature, g) AS run FROM (SELECT feature, value, SUM(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY feature ORDER BY run_order) AS g FROM m2 JOIN smp USING (sample))) GROUP BY 1""")
def longest_run(spark, d):
    return stats.longest_run(m2(spark, d).join(samples(spark, d), "sample"), ["feature"], "run_order")


@query("""SELECT feature, n, ROUND(100 * sd / mean, 6) AS spread FROM (SELECT feature, COUNT(value) AS n, STDDEV_SAMP(value) AS sd, AVG(value) AS mean FROM m2 WHERE sample IN (SELECT sample FROM smp WHERE batch = 'ASIA') GROUP BY 1) WHERE n >= 3""")
def qc_rsd(spark, d):
    return rounded(missing.qc_spread(m2(spark, d), samples(spark, d).where("batch = 'ASIA'").select("sample")), "spread")


@query("""SELECT feature, ROUND(AVG(value) FILTER (batch = 'AFRICA') / AVG(value) FILTER (batch <> 'AFRICA'), 6) AS ratio FROM m2 JOIN smp USING (sample) GROUP BY 1""")
def blank_ratio(spark, d):
    kinds = samples(spark, d).select("sample", F.when(F.col("batch") == "AFRICA", "blank").otherwise("study").alias("sample_type"))
    return rounded(missing.blank_ratio(m2(spark, d), kinds), "ratio")


@query("""SELECT feature, batch, COUNT(value) AS n, ROUND(STDDEV_SAMP(value) / AVG(value), 6) AS cv FROM m2 JOIN smp USING (sample) GROUP BY 1, 2 HAVING COUNT(value) >= 3""")
def feature_cv_by_batch(spark, d):
    return rounded(missing.feature_cv(m2(spark, d).join(samples(spark, d), "sample"), ["batch"]), "cv")


@query("""SELECT run_order, batch FROM (SELECT run_order, batch, LAG(batch) OVER (ORDER BY run_order) AS b FROM smp) WHERE b <> batch""")
def batch_boundaries(spark, d):
    return missing.batch_boundaries(samples(spark, d))


@query("""SELECT sample, MIN(value) AS min, QUANTILE_CONT(value, 0.25) AS p25, MEDIAN(value) AS median, QUANTILE_CONT(value, 0.75) AS p75, MAX(value) AS max, COUNT(value) AS n, ROUND(AVG(value), 6) AS mean FROM m2 GROUP BY 1""")
def sample_five_numbers(spark, d):
    return rounded(m2(spark, d).groupBy("sample").agg(*stats.summary("value")), "mean")


@query("""SELECT bin, COUNT(*) AS n FROM (SELECT CAST(LEAST(30, FLOOR((value - (SELECT MIN(value) FROM m1)) / ((SELECT MAX(value) - MIN(value) FROM m1) / 30)) + 1) AS INTEGER) AS bin FROM m1) GROUP BY 1""")
def histogram(spark, d):
    return stats.histogram(m1(spark, d), "value").select("bin", "n")


# ---------------------------------------------------------------- statistics


def rank_sql(value: str, by: str = "feature") -> str:
    return f"RANK() OVER (PARTITION BY {by} ORDER BY {value}) + (COUNT(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0"


@query(f"SELECT feature, sample, CAST({rank_sql('value')} AS DOUBLE) AS rank FROM m2 WHERE value IS NOT NULL")
def average_ranks(spark, d):
    return stats.ranked(m2(spark, d), ["feature"], "value").select("feature", "sample", "rank")


@query(f""", rk AS (SELECT feature, {rank_sql('value')} AS a, {rank_sql('run_order')} AS b FROM m2 JOIN smp USING (sample) WHERE value IS NOT NULL)
SELECT feature, COUNT(*) AS n, ROUND(CASE WHEN COUNT(*) >= 3 AND STDDEV_POP(a) > 0 AND STDDEV_POP(b) > 0 THEN COVAR_POP(a, b) / (STDDEV_POP(a) * STDDEV_POP(b)) END, 6) AS rho FROM rk GROUP BY 1""")
def spearman(spark, d):
    return rounded(stats.spearman(m2(spark, d).join(samples(spark, d), "sample"), ["feature"], "value", "run_order"), "rho")


@query(f""", rk AS (SELECT feature, batch, value, {rank_sql('value')} AS r FROM m2 JOIN smp USING (sample) WHERE value IS NOT NULL),
gs AS (SELECT feature, SUM(s * s / c) AS q, SUM(c) AS n, COUNT(*) AS k FROM (SELECT feature, batch, SUM(r) AS s, COUNT(*) AS c FROM rk GROUP BY 1, 2) GROUP BY 1),
ts AS (SELECT feature, SUM(t * t * t - t) AS ties FROM (SELECT feature, value, CAST(COUNT(*) AS DOUBLE) AS t FROM rk GROUP BY 1, 2) GROUP BY 1)
SELECT feature, CAST(n AS BIGINT) AS n, k, ROUND(CASE WHEN n > 1 AND 1 - ties / (n * n * n - n) > 0 THEN (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) ELSE 0 END, 5) AS h FROM gs JOIN ts USING (feature)""")
def kruskal_h(spark, d):
    k = stats.kruskal(m2(spark, d).join(samples(spark, d), "sample"), ["feature"], "value", "batch")
    return rounded(k, "h", digits=5).select("feature", "n", "k", "h")


@query(""", g AS (SELECT feature, batch, SUM(value) AS s, COUNT(value) AS c, SUM(value * value) AS ss FROM m2 JOIN smp USING (sample) WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT feature, SUM(s * s / c) AS b, SUM(s) AS s, SUM(c) AS n, SUM(ss) AS ss FROM g GROUP BY 1)
SELECT feature, ROUND(CASE WHEN ss - s * s / n > 0 THEN (b - s * s / n) / (ss - s * s / n) ELSE 0 END, 6) AS eta2 FROM t""")
def eta_squared(spark, d):
    return rounded(stats.eta_squared(m2(spark, d).join(samples(spark, d), "sample"), ["feature"], "value", "batch"), "eta2")


@query("""SELECT feature, ROUND(REGR_SLOPE(value, run_order), 6) AS slope FROM m1 JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS sample, s_suppkey AS run_order FROM supplier) USING (sample) GROUP BY 1""")
def ols_slopes(spark, d):
    o = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sample"), F.col("s_suppkey").alias("run_order"))
    return rounded(missing.control_trend(m1(spark, d), m1(spark, d).select("feature").distinct(), o), "slope")


@query(""", ps AS (SELECT p_partkey AS id, (p_partkey * 7919 % 1009) / 1009.0 AS p FROM part), rk AS (SELECT id, p, COUNT(*) OVER () AS m, ROW_NUMBER() OVER (ORDER BY p, id) AS k FROM ps)
SELECT id, ROUND(LEAST(1.0, MIN(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM rk""")
def bh_qvalues(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 1009 / 1009.0).alias("p"))
    return rounded(stats.bh(p), "q").select("id", "q")


PAIR_SQL = ", pr AS (SELECT a.sample AS s1, b.sample AS s2, COUNT(*) AS n, CASE WHEN COUNT(*) >= 3 AND STDDEV_POP(a.y) > 0 AND STDDEV_POP(b.y) > 0 THEN COVAR_POP(a.y, b.y) / (STDDEV_POP(a.y) * STDDEV_POP(b.y)) END AS r FROM dx a JOIN dx b USING (feature) WHERE a.sample < b.sample AND a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY 1, 2)"


@query(f"{PAIR_SQL} SELECT s1, s2, n, ROUND(r, 6) AS r FROM pr")
def pairwise_correlation(spark, d):
    return rounded(stats.sample_pairs(logged(spark, d)), "r")


@query(f"{PAIR_SQL} SELECT a.batch = b.batch AS same, COUNT(r) AS n_pairs, ROUND(MEDIAN(r), 6) AS median_r FROM pr JOIN smp a ON s1 = a.sample JOIN smp b ON s2 = b.sample GROUP BY 1")
def relationship_correlation(spark, d):
    return rounded(stats.relationship(stats.sample_pairs(logged(spark, d)), samples(spark, d).select("sample", F.col("batch").alias("level"))), "median_r")


@query(", ct AS (SELECT sample, feature, y - AVG(y) OVER (PARTITION BY feature) AS v FROM cm) SELECT a.sample AS s1, b.sample AS s2, ROUND(SUM(a.v * b.v), 5) AS g FROM ct a JOIN ct b USING (feature) WHERE a.sample <= b.sample GROUP BY 1, 2")
def gram_matrix(spark, d):
    return rounded(stats.gram(complete(spark, d)), "g", digits=5)


@query("SELECT feature, sample, ROUND(y, 6) AS y FROM cm")
def diagnostic_matrix(spark, d):
    return rounded(complete(spark, d).select("feature", "sample", "y"), "y")


@query(""", o AS (SELECT batch, subject, COUNT(*) AS o FROM smp GROUP BY 1, 2), e AS (SELECT r.batch, c.subject, r.n * c.n * 1.0 / (SELECT COUNT(*) FROM smp) AS e FROM (SELECT batch, COUNT(*) AS n FROM smp GROUP BY 1) r CROSS JOIN (SELECT subject, COUNT(*) AS n FROM smp GROUP BY 1) c),
x AS (SELECT SUM(POW(COALESCE(o, 0) - e, 2) / e) AS chi2 FROM e LEFT JOIN o USING (batch, subject)) SELECT n::DOUBLE AS n, ROUND(chi2, 6) AS chi2, ROUND(SQRT(chi2 / (n * (LEAST(nb, ns) - 1))), 6) AS v FROM x, (SELECT COUNT(*) AS n, COUNT(DISTINCT batch) AS nb, COUNT(DISTINCT subject) AS ns FROM smp)""")
def contingency_cramers_v(spark, d):
    return rounded(stats.cramers_v(samples(spark, d), "batch", "subject"), "chi2", "v")


@query(""", pr AS (SELECT 'region by nation' AS pair, batch AS b, sample AS d FROM smp UNION ALL SELECT 'region by subject', batch, subject FROM smp UNION ALL SELECT 'nation by nation', sample, sample FROM smp UNION ALL SELECT 'flag by status', l_returnflag, CAST(l_linenumber AS VARCHAR) FROM lineitem),
ce AS (SELECT pair, b, d, COUNT(*) AS n FROM pr GROUP BY 1, 2, 3), mb AS (SELECT pair, MAX(k) AS k FROM (SELECT pair, d, COUNT(*) AS k FROM ce GROUP BY 1, 2) GROUP BY 1), md AS (SELECT pair, MAX(k) AS k FROM (SELECT pair, b, COUNT(*) AS k FROM ce GROUP BY 1, 2) GROUP BY 1)
SELECT pair, CASE WHEN mb.k = 1 AND md.k = 1 THEN 'confounded' WHEN mb.k = 1 OR md.k = 1 THEN 'nested' WHEN filled = nb * nd AND lo = hi THEN 'crossed_balanced' ELSE 'partially_confounded' END AS structure
FROM mb JOIN md USING (pair) JOIN (SELECT pair, COUNT(*) AS filled, COUNT(DISTINCT b) AS nb, COUNT(DISTINCT d) AS nd, MIN(n) AS lo, MAX(n) AS hi FROM ce GROUP BY 1) USING (pair)""")
def design_structure(spark, d):
    s, li = samples(spark, d), table(spark, d, "lineitem")
    pairs_of = {"region by nation": (s, "batch", "sample"), "region by subject": (s, "batch", "subject"), "nation by nation": (s.withColumn("again", F.col("sample")), "sample", "again"), "flag by status": (li, "l_returnflag", "l_linenumber")}
    found = [stats.design_structure(*how).select(F.lit(pair).alias("pair"), "structure") for pair, how in pairs_of.items()]
    return reduce(DataFrame.unionByName, found)


@query(""", s AS (SELECT feature, subject, CAST(COUNT(y) AS DOUBLE) AS c, AVG(y) AS m, VAR_POP(y) AS v FROM dx JOIN smp USING (sample) WHERE y IS NOT NULL GROUP BY 1, 2 HAVING COUNT(y) >= 2),
t AS (SELECT feature, CAST(COUNT(*) AS DOUBLE) AS a, SUM(c) AS n, SUM(c * c) AS c2, SUM(c * m) AS cm, SUM(c * m * m) AS cm2, SUM(c * v) AS w FROM s GROUP BY 1),
u AS (SELECT feature, (cm2 - cm * cm / n) / (a - 1) AS msb, w / (n - a) AS msw, (n - c2 / n) / (a - 1) AS k0 FROM t WHERE a >= 3 AND n - a >= 3)
SELECT feature, ROUND((msb - msw) / (msb + (k0 - 1) * msw), 5) AS icc FROM u""")
def icc1(spark, d):
    return rounded(stats.icc1(logged(spark, d).join(samples(spark, d), "sample"), "feature", "subject", "y"), "icc", digits=5).where("icc is not null")


@query("""SELECT COUNT(*) AS n_subjects, CAST(SUM(n) AS BIGINT) AS n_samples, MIN(n) AS smallest, MAX(n) AS largest, MIN(n) = MAX(n) AS balanced, (SELECT COUNT(*) FROM (SELECT subject, batch FROM smp GROUP BY 1, 2 HAVING COUNT(*) > 1)) AS repeated FROM (SELECT subject, COUNT(*) AS n FROM smp GROUP BY 1)""")
def cluster_sizes(spark, d):
    return missing.cluster_facts(samples(spark, d).select("sample", "subject", F.col("batch").alias("time")))


@query("""SELECT subject, time, gap FROM (SELECT subject, run_order AS time, run_order - LAG(run_order) OVER (PARTITION BY subject ORDER BY run_order) AS gap FROM smp) WHERE gap IS NOT NULL""")
def subject_gaps(spark, d):
    return missing.subject_gaps(samples(spark, d).select("subject", F.col("run_order").alias("time")))


@query("""SELECT MAX(k) = 1 AS constant, COUNT(*) FILTER (k > 1) AS varying FROM (SELECT subject, COUNT(DISTINCT batch) AS k FROM smp GROUP BY 1)""")
def nesting(spark, d):
    return missing.constant_within(samples(spark, d), "subject", "batch")


@query("""SELECT feature, ROUND(AVG(v), 6) AS variance FROM (SELECT feature, batch, VAR_SAMP(y) AS v FROM dx JOIN smp USING (sample) GROUP BY 1, 2) GROUP BY 1""")
def group_variance(spark, d):
    return rounded(missing.group_variance(logged(spark, d).withColumn("value", F.col("y")), samples(spark, d).select("sample", F.col("batch").alias("level"))), "variance")


# ---------------------------------------------------------------- operations that change data


@query("""SELECT feature, sample, ROUND(LOG2(value + (SELECT MIN(value) / 2 FROM m2 WHERE value > 0)), 6) AS value FROM m2""")
def log_half_min(spark, d):
    t = transforms.log_transform(m2(spark, d).withColumn("block", F.lit("A1B1")))
    return rounded(t, "value").select("feature", "sample", "value")


@query("""SELECT feature, sample, ROUND(ASINH(value / 5.0), 6) AS value FROM m2""")
def arcsinh(spark, d):
    return rounded(transforms.arcsinh_transform(m2(spark, d), 5.0), "value")


@query("""SELECT feature, sample, NULLIF(value - 30, 0) AS value FROM m2""")
def recode_zero(spark, d):
    return transforms.recode_zero(m2(spark, d).withColumn("value", F.col("value") - 30))


@query("""SELECT feature, sample, value FROM m2 WHERE feature NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 10) AND sample NOT IN ('CHINA', 'FRANCE')""")
def remove_features_and_samples(spark, d):
    gone = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("feature"))
    two = table(spark, d, "nation").where(F.col("n_name").isin("CHINA", "FRANCE")).select(F.col("n_name").alias("sample"))
    return transforms.remove_samples(transforms.remove_features(m2(spark, d), gone), two)


@query("""SELECT feature, sample, ROUND(y - MEDIAN(y) OVER (PARTITION BY sample) + (SELECT MEDIAN(y) FROM dx), 6) AS value FROM dx""")
def median_normalize(spark, d):
    return rounded(transforms.normalize_median(logged(spark, d).select("feature", "sample", F.col("y").alias("value"))), "value").select("feature", "sample", "value")


@query(f""", rk AS (SELECT feature, sample, {rank_sql('value', 'sample')} - 1 AS r, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY value) - 1 AS i, value FROM m1),
ref AS (SELECT i, AVG(value) AS v FROM rk GROUP BY 1)
SELECT feature, sample, ROUND(a.v + (r - FLOOR(r)) * (COALESCE(b.v, a.v) - a.v), 6) AS value FROM rk JOIN ref a ON a.i = FLOOR(r) LEFT JOIN ref b ON b.i = FLOOR(r) + 1""")
def quantile_normalize_dense(spark, d):
    return rounded(transforms.normalize_quantile(m1(spark, d)), "value").select("feature", "sample", "value")


@query("""SELECT feature, sample, ROUND(y - COALESCE(MEDIAN(y) OVER (PARTITION BY feature, batch) - MEDIAN(y) OVER (PARTITION BY feature), 0), 6) AS value FROM dx JOIN smp USING (sample)""")
def batch_center_median(spark, d):
    return rounded(transforms.batch_center(logged(spark, d).select("feature", "sample", F.col("y").alias("value")), samples(spark, d)), "value").select("feature", "sample", "value")


@query("""SELECT feature, sample, ROUND(y - COALESCE(AVG(y) OVER (PARTITION BY feature, batch) - AVG(y) OVER (PARTITION BY feature), 0), 6) AS value FROM dx JOIN smp USING (sample)""")
def batch_center_mean(spark, d):
    return rounded(transforms.batch_center(logged(spark, d).select("feature", "sample", F.col("y").alias("value")), samples(spark, d), "mean"), "value").select("feature", "sample", "value")


@query("""SELECT (SELECT COUNT(*) FROM m2 WHERE sample = 'CHINA') AS lost, 0::BIGINT AS added, (SELECT COUNT(*) FROM m2 WHERE value = 30 AND sample <> 'CHINA') AS gap_changed, 0::BIGINT AS new_infinite,
(SELECT COUNT(*) FROM m2 WHERE sample <> 'CHINA' AND (value = 30 OR (value IS NOT NULL AND sample = 'FRANCE')) AND sample <> 'PERU') AS changed_outside""")
def invariants(spark, d):
    old = m2(spark, d).select("feature", "sample", (F.col("value") - 30).alias("value"))
    new = transforms.recode_zero(old).where("sample <> 'CHINA'").withColumn("value", F.when(F.col("sample") == "FRANCE", F.col("value") + 1).otherwise(F.col("value")))
    return transforms.violations(old, new, touched=F.col("sample") == "PERU")


# ---------------------------------------------------------------- two blocks of the same samples and partly the same features


def two_blocks(spark: SparkSession, d: str) -> DataFrame:
    one = logged(spark, d).select(F.lit("A1B1").alias("block"), "feature", "sample", F.col("y").alias("value"))
    return one.unionByName(one.where("cast(feature as long) % 2 = 0").select(F.lit("A1B2").alias("block"), "feature", "sample", (2 * F.col("value") + 1).alias("value")))


@query("""SELECT block, feature, sample, ROUND(value - MEDIAN(value) OVER (PARTITION BY block, sample) + MEDIAN(value) OVER (PARTITION BY block), 6) AS value FROM bx""")
def blocks_normalize_median(spark, d):
    return rounded(transforms.normalize_median(two_blocks(spark, d)), "value").select("block", "feature", "sample", "value")


@query(""", rk AS (SELECT block, feature, sample, value, ROW_NUMBER() OVER (PARTITION BY block, sample ORDER BY value) AS k, COUNT(*) OVER (PARTITION BY block, sample) AS m, RANK() OVER (PARTITION BY block, sample ORDER BY value) + (COUNT(*) OVER (PARTITION BY block, sample, value) - 1) / 2.0 AS r FROM bx WHERE value IS NOT NULL),
pp AS (SELECT block, COUNT(DISTINCT feature) AS p FROM bx GROUP BY 1), ms AS (SELECT DISTINCT block, sample, m, p FROM rk JOIN pp USING (block)),
gr AS (SELECT block, sample, m, p, j, j * 1.0::DOUBLE / (p - 1) * m + 0.5 AS pos FROM ms, UNNEST(RANGE(0, p)) t(j)),
gk AS (SELECT *, LEAST(m, GREATEST(1, CAST(FLOOR(pos) AS BIGINT))) AS k0, CASE WHEN pos < 1 OR pos >= m THEN 0 ELSE pos - FLOOR(pos) END AS f FROM gr),
rf AS (SELECT gk.block, j, AVG(a.value + f * (COALESCE(b.value, a.value) - a.value)) AS v FROM gk JOIN rk a ON a.block = gk.block AND a.sample = gk.sample AND a.k = k0 LEFT JOIN rk b ON b.block = gk.block AND b.sample = gk.sample AND b.k = k0 + 1 GROUP BY 1, 2),
pl AS (SELECT rk.*, (r - 0.5) / m * (p - 1) AS spot FROM rk JOIN pp USING (block)),
qn AS (SELECT pl.block, feature, sample, a.v + (spot - FLOOR(spot)) * (COALESCE(b.v, a.v) - a.v) AS v FROM pl JOIN rf a ON a.block = pl.block AND a.j = FLOOR(spot) LEFT JOIN rf b ON b.block = pl.block AND b.j = FLOOR(spot) + 1)
SELECT bx.block, bx.feature, bx.sample, ROUND(v, 5) AS value FROM bx LEFT JOIN qn ON qn.block = bx.block AND qn.feature = bx.feature AND qn.sample = bx.sample""")
def blocks_normalize_quantile(spark, d):
    return rounded(transforms.normalize_quantile(two_blocks(spark, d)), "value", digits=5).select("block", "feature", "sample", "value")


@query("""SELECT block, feature, sample, ROUND(value - COALESCE(MEDIAN(value) OVER (PARTITION BY block, feature, batch) - MEDIAN(value) OVER (PARTITION BY block, feature), 0), 6) AS value FROM bx JOIN smp USING (sample)""")
def blocks_batch_center(spark, d):
    return rounded(transforms.batch_center(two_blocks(spark, d), samples(spark, d)), "value").select("block", "feature", "sample", "value")


@query("""SELECT block, feature, sample, ROUND(LOG2(value + (SELECT MIN(b.value) / 2 FROM bx b WHERE b.block = bx.block AND b.value > 0)), 6) AS value FROM bx""")
def blocks_log_half_min(spark, d):
    return rounded(transforms.log_transform(two_blocks(spark, d)), "value").select("block", "feature", "sample", "value")


@query("""SELECT CAST(ROW_NUMBER() OVER (ORDER BY block, feature) - 1 AS BIGINT) AS row, block, feature FROM (SELECT DISTINCT block, feature FROM bx)""")
def blocks_stacked_keys(spark, d):
    return C.stacked(two_blocks(spark, d))[1]


@query("""SELECT block, feature, sample, ROUND(value - AVG(value) OVER (PARTITION BY sample), 6) AS value FROM bx""")
def blocks_unstacked(spark, d):
    """Both blocks as one matrix, centred by sample over all of its rows, and taken apart again."""
    rows, keys = C.stacked(two_blocks(spark, d))
    mean = rows.groupBy("sample").agg(F.avg("value").alias("m"))
    centred = rows.join(mean, "sample").select("row", "sample", (F.col("value") - F.col("m")).alias("value"))
    return rounded(C.unstacked(centred, keys), "value")


@query("""SELECT (SELECT COUNT(*) FROM bx WHERE sample = 'CHINA' AND block = 'A1B2') AS lost, 0::BIGINT AS added, 0::BIGINT AS gap_changed, 0::BIGINT AS new_infinite, (SELECT COUNT(value) FROM bx WHERE block = 'A1B1' AND sample = 'PERU') AS changed_outside""")
def blocks_invariants(spark, d):
    old = two_blocks(spark, d)
    new = old.where("not (sample = 'CHINA' and block = 'A1B2')").withColumn("value", F.when(F.col("sample") == "PERU", F.col("value") + 1).otherwise(F.col("value")))
    return transforms.violations(old, new, touched=F.col("block") == "A1B2")


@query("""SELECT a.block AS one, b.block AS two, COUNT(*) AS n FROM (SELECT DISTINCT block, feature FROM bx) a JOIN (SELECT DISTINCT block, feature FROM bx) b ON a.feature = b.feature AND a.block < b.block GROUP BY 1, 2""")
def blocks_shared_keys(spark, d):
    return transforms.shared_keys(two_blocks(spark, d))


@query(""", ub AS (SELECT 'A' || (1 + CAST(feature AS BIGINT) % 2) || 'B' || (1 + CAST(feature AS BIGINT) % 6) AS block, feature, sample FROM dx UNION ALL SELECT 'A2B9', feature, sample FROM dx WHERE CAST(feature AS BIGINT) % 3 = 0),
kb AS (SELECT SPLIT_PART(block, 'B', 1) AS assay, feature, COUNT(DISTINCT block) AS k FROM ub GROUP BY 1, 2), ap AS (SELECT assay, MAX(k) = 1 AS apart FROM kb GROUP BY 1)
SELECT DISTINCT block, CASE WHEN apart THEN assay ELSE block END AS unit FROM ub JOIN ap ON assay = SPLIT_PART(block, 'B', 1)""")
def blocks_units(spark, d):
    n = F.col("feature").cast("long")
    cells = logged(spark, d).select(F.concat(F.lit("A"), (1 + n % 2).cast("string"), F.lit("B"), (1 + n % 6).cast("string")).alias("block"), "feature", "sample")
    return transforms.units(cells.unionByName(cells.where("cast(feature as long) % 3 = 0").withColumn("block", F.lit("A2B9"))))


@query("""SELECT ROUND(r2, 6) AS r2, ROUND((r2 / (nb - 1)) / ((1 - r2) / (n - nb)), 5) AS f FROM (SELECT COUNT(DISTINCT sample) AS n, COUNT(DISTINCT batch) AS nb FROM cm JOIN smp USING (sample)), (SELECT 1 - SUM(w) / SUM(t) AS r2 FROM (SELECT VAR_POP(y) * COUNT(*) AS t, feature FROM cm GROUP BY feature) JOIN (SELECT feature, SUM(v) AS w FROM (SELECT feature, batch, VAR_POP(y) * COUNT(*) AS v FROM cm JOIN smp USING (sample) GROUP BY 1, 2) GROUP BY 1) USING (feature))""")
def permanova_r2(spark, d):
    features = spectra.Features(complete(spark, d))
    r2, f = spectra.permanova(features, batch_codes(spark, d, features))
    features.close()
    return rounded(spark.createDataFrame([(float(r2[0]), float(f[0]))], "r2 double, f double"), "r2").withColumn("f", F.round("f", 5))


def batch_codes(spark, d, features):
    import numpy as np

    batch = {r["sample"]: r.batch for r in samples(spark, d).collect()}  # one row per sample
    return np.unique([batch[n] for n in features.names], return_inverse=True)[1]


@query(""", mr AS (SELECT sample, batch, run_order, 1 - COUNT(value) / COUNT(*) AS y FROM m2 JOIN smp USING (sample) GROUP BY 1, 2, 3),
rk AS (SELECT *, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS r, RANK() OVER (ORDER BY run_order) AS o FROM mr),
tt AS (SELECT SUM(t * t * t - t) AS ties FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS t FROM mr GROUP BY y)), gs AS (SELECT SUM(s * s / c) AS q, CAST(SUM(c) AS DOUBLE) AS n, MIN(c) AS least, COUNT(*) AS levels FROM (SELECT SUM(r) AS s, COUNT(*) AS c FROM rk GROUP BY batch))
SELECT 'batch' AS variable, CASE WHEN levels >= 2 AND least >= 2 THEN ROUND((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) END AS value FROM gs, tt UNION ALL SELECT 'run_order', ROUND(CORR(r, o), 5) FROM rk""")
def association_values(spark, d):
    return rounded(associations(spark, d).select("variable", "value"), "value", digits=5)


@query(""", q AS (SELECT sample, QUANTILE_CONT(value, 0.1) AS p10, QUANTILE_CONT(value, 0.25) AS p25, QUANTILE_CONT(value, 0.5) AS p50, QUANTILE_CONT(value, 0.75) AS p75, QUANTILE_CONT(value, 0.9) AS p90 FROM m2 GROUP BY 1) SELECT sample, ROUND(p10, 6) AS p10, ROUND(p25, 6) AS p25, ROUND(p50, 6) AS p50, ROUND(p75, 6) AS p75, ROUND(p90, 6) AS p90 FROM q""")
def quantiles(spark, d):
    return rounded(m2(spark, d).groupBy("sample").agg(*stats.quantiles("value")), "p10", "p25", "p50", "p75", "p90")


@query(""", fp AS (SELECT a.feature AS f1, b.feature AS f2, LEFT(a.feature, 8) = LEFT(b.feature, 8) AS same_parent, CORR(a.y, b.y) AS r, COUNT(*) AS n FROM cm a JOIN cm b USING (sample) WHERE a.feature < b.feature GROUP BY 1, 2, 3)
SELECT f1, f2, same_parent, ROUND(CASE WHEN n >= 3 AND NOT ISNAN(r) THEN r END, 5) AS r FROM fp""")
def feature_correlation(spark, d):
    c = complete(spark, d)
    return rounded(stats.feature_pairs(c, c.select("feature", F.substring("feature", 1, 8).alias("parent")).distinct()), "r", digits=5)


@query(""", fp AS (SELECT a.feature, b.feature AS other, LEFT(a.feature, 8) = LEFT(b.feature, 8) AS same_parent, CORR(a.y, b.y) AS r FROM cm a JOIN cm b USING (sample) WHERE a.feature <> b.feature GROUP BY 1, 2, 3)
SELECT feature, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY ABS(r) DESC, other) AS INTEGER) AS rank, other, same_parent, ROUND(r, 5) AS r FROM fp WHERE NOT ISNAN(r) AND ABS(r) >= 0.4 QUALIFY rank <= 3""")
def closest_features(spark, d):
    c = complete(spark, d)
    return rounded(spectra.feature_links(c, c.select("feature", F.substring("feature", 1, 8).alias("parent")).distinct(), 0.4, 3), "r", digits=5)


@query("""SELECT feature, COALESCE(MIN(value) FILTER (value > 0) / 2, 1.0) AS "offset" FROM m2 GROUP BY 1""")
def half_minimum(spark, d):
    return C.half_minimum(m2(spark, d), ["feature"])


@query("""SELECT threshold, COUNT(*) FILTER (share >= threshold - 1e-9) AS n_kept FROM (SELECT feature, 100.0 * COUNT(*) FILTER (seen > 0) / COUNT(*) AS share FROM (SELECT feature, subject, COUNT(value) AS seen FROM m2 JOIN smp USING (sample) GROUP BY 1, 2) GROUP BY 1), (VALUES (100), (90), (75), (50), (25)) t(threshold) GROUP BY 1""")
def completeness_by_subject(spark, d):
    return missing.completeness_by_cluster(m2(spark, d), samples(spark, d).select("sample", "subject"))


# ---------------------------------------------------------------- fits


def loess_sql(points: str, places: str) -> str:
    """SQL for local quadratic fits: lf (feature, place, fit) of points (feature, x, y) at places (feature, place); tricube weights over the
    nearest three quarters of the points, a lower degree where fewer than three points weigh anything."""
    return f""", lo AS (SELECT feature, x, y, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, COUNT(*) OVER (PARTITION BY feature) AS n FROM {points}),
ln AS (SELECT *, LEAST(n, GREATEST(CAST(FLOOR(n * 0.75 + 1e-9) AS BIGINT), 3)) AS q FROM lo), lp AS (SELECT feature, CAST(place AS DOUBLE) AS place FROM {places}),
lw AS (SELECT p.feature, place, ANY_VALUE(a.q) AS q, COUNT(*) FILTER (a.x + b.x < 2 * place) AS k FROM lp p JOIN ln a ON a.feature = p.feature LEFT JOIN ln b ON b.feature = a.feature AND b.i = a.i + a.q GROUP BY 1, 2),
lr AS (SELECT w.feature, place, GREATEST(ABS(place - a.x), ABS(b.x - place)) AS reach FROM lw w JOIN ln a ON a.feature = w.feature AND a.i = w.k JOIN ln b ON b.feature = w.feature AND b.i = w.k + w.q - 1),
lu AS (SELECT r.feature, place, (x - place) / reach AS u, y, POW(GREATEST(0, 1 - POW(ABS((x - place) / reach), 3)), 3) AS w FROM lr r JOIN ln USING (feature)),
lm AS (SELECT feature, place, COUNT(*) FILTER (w > 0) AS k, SUM(w) AS s0, SUM(w * u) AS s1, SUM(w * u * u) AS s2, SUM(w * u * u * u) AS s3, SUM(w * u * u * u * u) AS s4, SUM(w * y) AS t0, SUM(w * u * y) AS t1, SUM(w * u * u * y) AS t2 FROM lu GROUP BY 1, 2),
lf AS (SELECT feature, place, CASE WHEN k = 1 THEN t0 / s0 WHEN k = 2 THEN (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1)
ELSE (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) END AS fit FROM lm)"""


SMOOTH_SQL = (
    """, ru AS (SELECT feature, MAX(k) AS longest FROM (SELECT feature, COUNT(y) AS k FROM (SELECT feature, y, SUM(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY feature ORDER BY run_order) AS g FROM dx JOIN smp USING (sample)) GROUP BY feature, g) GROUP BY 1),
ob AS (SELECT feature, CAST(run_order AS DOUBLE) AS x, y FROM dx JOIN smp USING (sample) JOIN ru USING (feature) WHERE y IS NOT NULL AND longest >= 8), pl AS (SELECT feature, x AS place FROM ob)"""
    + loess_sql("ob", "pl")
    + """ SELECT feature, sample, ROUND(y + COALESCE(AVG(CASE WHEN y IS NOT NULL THEN fit END) OVER (PARTITION BY feature) - fit, 0), 5) AS value FROM dx JOIN smp USING (sample) LEFT JOIN lf ON lf.feature = dx.feature AND lf.place = run_order"""
).replace("SELECT feature, sample, ROUND(y +", "SELECT dx.feature, sample, ROUND(y +").replace("OVER (PARTITION BY feature) - fit", "OVER (PARTITION BY dx.feature) - fit")


_HEAD, _LAST = re.sub(r"\bdx\b", "db", SMOOTH_SQL).rsplit(" SELECT db.feature", 1)


@query(
    """, db AS (SELECT CONCAT(feature, '|', run_order % 2) AS feature, sample, y FROM dx JOIN smp USING (sample))"""
    + _HEAD
    + ", sm AS (SELECT db.feature"
    + _LAST.replace("ROUND(y +", "(y +").replace(", 5) AS value", ") AS value")
    + """), sp AS (SELECT split_part(feature, '|', 1) AS feature, split_part(feature, '|', 2) AS half, sample, value FROM sm)
SELECT feature, sample, ROUND(value - COALESCE(MEDIAN(value) OVER (PARTITION BY feature, half) - MEDIAN(value) OVER (PARTITION BY feature), 0), 5) AS value FROM sp"""
)
def corrected_batches(spark, d):
    """Drift within batches of every other sample, then centring of the batches."""
    order = samples(spark, d).select("sample", "run_order", (F.col("run_order") % 2).cast("string").alias("batch"))
    return rounded(transforms.correct_batch_effects(logged(spark, d).select("feature", "sample", F.col("y").alias("value")), order), "value", digits=5)


@query(SMOOTH_SQL)
def loess_drift(spark, d):
    order = samples(spark, d).select("sample", "run_order", F.lit("one").alias("batch"))
    return rounded(transforms.drift_sample_loess(logged(spark, d).select("feature", "sample", F.col("y").alias("value")), order), "value", digits=5)


@query(
    """, ob AS (SELECT feature, x, y FROM (SELECT feature, CAST(run_order AS DOUBLE) AS x, y, COUNT(y) OVER (PARTITION BY feature) AS known FROM dx JOIN smp USING (sample) WHERE batch IN ('ASIA', 'EUROPE') AND y IS NOT NULL) WHERE known >= 5),
en AS (SELECT feature, MIN(x) AS lo, MAX(x) AS hi FROM ob GROUP BY 1), al AS (SELECT feature, sample, y, LEAST(hi, GREATEST(lo, run_order)) AS place FROM dx JOIN smp USING (sample) LEFT JOIN en USING (feature)),
pl AS (SELECT DISTINCT feature, place FROM al WHERE feature IN (SELECT feature FROM en))"""
    + loess_sql("ob", "pl")
    + """, ow AS (SELECT ob.feature, AVG(fit) AS own FROM ob JOIN lf ON lf.feature = ob.feature AND lf.place = ob.x GROUP BY 1)
SELECT al.feature, sample, ROUND(y + COALESCE(own - fit, 0), 5) AS value FROM al LEFT JOIN lf ON lf.feature = al.feature AND lf.place = al.place LEFT JOIN ow ON ow.feature = al.feature"""
)
def qc_drift(spark, d):
    s = samples(spark, d)
    t = transforms.drift_qc_loess(logged(spark, d).select("feature", "sample", F.col("y").alias("value")), s.select("sample", "run_order"), s.where("batch in ('ASIA', 'EUROPE')").select("sample"))
    return rounded(t, "value", digits=5)


@query(""", rk AS (SELECT feature, sample, y, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY y) AS k, COUNT(*) OVER (PARTITION BY sample) AS m, RANK() OVER (PARTITION BY sample ORDER BY y) + (COUNT(*) OVER (PARTITION BY sample, y) - 1) / 2.0 AS r FROM dx WHERE y IS NOT NULL),
pp AS (SELECT COUNT(DISTINCT feature) AS p FROM dx), ms AS (SELECT DISTINCT sample, m, p FROM rk, pp), gr AS (SELECT sample, m, p, j, j * 1.0::DOUBLE / (p - 1) * m + 0.5 AS pos FROM ms, UNNEST(RANGE(0, p)) t(j)),
gk AS (SELECT *, LEAST(m, GREATEST(1, CAST(FLOOR(pos) AS BIGINT))) AS k0, CASE WHEN pos < 1 OR pos >= m THEN 0 ELSE pos - FLOOR(pos) END AS f FROM gr),
rf AS (SELECT j, AVG(a.y + f * (COALESCE(b.y, a.y) - a.y)) AS v FROM gk JOIN rk a ON a.sample = gk.sample AND a.k = k0 LEFT JOIN rk b ON b.sample = gk.sample AND b.k = k0 + 1 GROUP BY 1),
ps AS (SELECT rk.*, (r - 0.5) / m * (p - 1) AS spot FROM rk, pp), qn AS (SELECT ps.feature, sample, a.v + (spot - FLOOR(spot)) * (COALESCE(b.v, a.v) - a.v) AS v FROM ps JOIN rf a ON a.j = FLOOR(spot) LEFT JOIN rf b ON b.j = FLOOR(spot) + 1)
SELECT dx.feature, dx.sample, ROUND(v, 5) AS value FROM dx LEFT JOIN qn ON qn.feature = dx.feature AND qn.sample = dx.sample""")
def quantile_normalize_gaps(spark, d):
    return rounded(transforms.normalize_quantile(logged(spark, d).select("feature", "sample", F.col("y").alias("value"))), "value", digits=5)


#: The steps of the fixed point are listed up to 100; a batch stops at the first step at which all of its features stand still.
COMBAT_STEPS = """cp AS (SELECT feature, batch, CAST(COUNT(*) AS DOUBLE) AS n, AVG(y) AS m, VAR_POP(y) AS v FROM cm JOIN smp USING (sample) GROUP BY 1, 2),
cf AS (SELECT feature, SUM(n * m) / SUM(n) AS grand, SUM(n * v) / SUM(n) AS pooled FROM cp GROUP BY 1 HAVING MIN(v) > 0),
cz AS (SELECT feature, batch, n, grand, SQRT(pooled) AS scale, (m - grand) / SQRT(pooled) AS g, n * v / pooled AS ss, n * v / pooled / (n - 1) AS d FROM cp JOIN cf USING (feature)),
cb AS (SELECT batch, AVG(g) AS pg, VAR_SAMP(g) AS pt, AVG(d) AS mean, VAR_SAMP(d) AS var FROM cz GROUP BY 1),
ca AS (SELECT cz.*, pg, pt, (2 * var + mean * mean) / var AS a, (mean * var + mean * mean * mean) / var AS s FROM cz JOIN cb USING (batch)),
it AS (SELECT feature, batch, 0 AS step, g AS shift, d AS spread, 1.0::DOUBLE AS moved, n, g, ss, pg, pt, a, s FROM ca UNION ALL
  SELECT feature, batch, step + 1, nw, wide, GREATEST(ABS(nw - shift) / ABS(shift), ABS(wide - spread) / spread), n, g, ss, pg, pt, a, s FROM (SELECT *, (0.5 * (ss + n * (g - nw) * (g - nw)) + s) / (n / 2 + a - 1) AS wide FROM (SELECT *, (pt * n * g + spread * pg) / (pt * n + spread) AS nw FROM it WHERE step < 100))),
cr AS (SELECT batch, MAX(took) AS rounds FROM (SELECT feature, batch, MIN(step) AS took FROM it WHERE step > 0 AND moved <= 1e-4 GROUP BY 1, 2) GROUP BY 1),
ck AS (SELECT feature, batch, grand, scale, shift, SQRT(spread) AS spread FROM it JOIN cr USING (batch) JOIN (SELECT feature, batch, grand, scale FROM ca) USING (feature, batch) WHERE step = rounds)"""


@query(f""", {COMBAT_STEPS} SELECT feature, sample, ROUND(COALESCE(((y - grand) / scale - shift) / spread * scale + grand, y), 5) AS value FROM cm JOIN smp USING (sample) LEFT JOIN ck USING (feature, batch)""")
def combat(spark, d):
    return rounded(transforms.combat(complete(spark, d).select("feature", "sample", F.col("y").alias("value")), samples(spark, d)), "value", digits=5)




# ---------------------------------------------------------------- no SQL: permutations, linear algebra


#: Eigenvectors by repeated multiplication, one after the other, each time of what the ones before leave of the Gram matrix.
_POWER = """k{j} AS MATERIALIZED ({matrix}), p{j} AS (SELECT 0 AS step, list_transform(k, lambda r, i: 1.0 + ((i * 7919 + {j} * 104729) % 1009) / 1009) AS v FROM k{j} UNION ALL SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT step, list_transform(k, lambda r: list_inner_product(r, v)) AS w FROM p{j}, k{j}) WHERE step < {steps}),
e{j} AS MATERIALIZED (SELECT v, list_inner_product(v, list_transform(k, lambda r: list_inner_product(r, v))) AS l, k FROM p{j}, k{j} WHERE step = {steps})"""
_GRAM = """SELECT list(r ORDER BY s1) AS k FROM (SELECT a.sample AS s1, list(g ORDER BY b.sample) AS r FROM (SELECT DISTINCT sample FROM ct) a, (SELECT DISTINCT sample FROM ct) b JOIN LATERAL (SELECT SUM(x.c * y.c) AS g FROM ct x JOIN ct y USING (feature) WHERE x.sample = a.sample AND y.sample = b.sample) ON TRUE GROUP BY 1)"""
_DEFLATED = "SELECT list_transform(k, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS k FROM e{before}"


@query(
    ", ct AS (SELECT feature, sample, y - AVG(y) OVER (PARTITION BY feature) AS c FROM cm), "
    + ", ".join(_POWER.format(j=j, steps=3000, matrix=_GRAM if j == 1 else _DEFLATED.format(before=j - 1)) for j in (1, 2, 3))
    + """, al AS (SELECT 1 AS pc, v, l FROM e1 UNION ALL SELECT 2, v, l FROM e2 UNION ALL SELECT 3, v, l FROM e3), nm AS (SELECT list(sample ORDER BY sample) AS names FROM (SELECT DISTINCT sample FROM ct)), tr AS (SELECT SUM(c * c) AS total FROM ct)
SELECT names[i] AS sample, CAST(pc AS INTEGER) AS pc, ROUND(v[i] * sqrt(l) * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END, 5) + 0.0 AS score, ROUND(l / total, 5) AS share FROM al, nm, tr, UNNEST(range(1, len(names) + 1)) u(i)"""
)
def principal_components(spark, d):
    features = spectra.Features(complete(spark, d))
    scores, shares = spectra.components(features, 3)
    features.close()
    rows = [(n, j + 1, float(scores[i, j]), float(shares[j])) for i, n in enumerate(features.names) for j in range(scores.shape[1])]
    return rounded(spark.createDataFrame(rows, "sample string, pc int, score double, share double"), "score", "share", digits=5)




@query(""", ct AS (SELECT feature, sample, y FROM cm), ds AS MATERIALIZED (SELECT a.sample AS s1, b.sample AS s2, SQRT(SUM((a.y - b.y) * (a.y - b.y))) AS d FROM ct a JOIN ct b USING (feature) WHERE a.sample <> b.sample GROUP BY 1, 2),
nb AS MATERIALIZED (SELECT sample, ROW_NUMBER() OVER (ORDER BY sample) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT sample FROM ct)),
mg AS (SELECT 0::BIGINT AS step, sample, i AS cluster, n, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS h FROM nb UNION ALL
  SELECT step + 1, sample, CASE WHEN cluster = best.a OR cluster = best.b THEN n + step ELSE cluster END, n, best.a, best.b, best.h FROM mg, (SELECT arg_min(a, h) AS a, arg_min(b, h) AS b, MIN(h) AS h FROM (SELECT x.cluster AS a, y.cluster AS b, MAX(d) AS h FROM mg x JOIN ds ON x.sample = s1 JOIN mg y ON y.sample = s2 WHERE x.cluster < y.cluster GROUP BY 1, 2)) best WHERE step < n - 1)
SELECT CAST(step - 1 AS INTEGER) AS step, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, ROUND(h, 5) AS height, CAST(COUNT(*) FILTER (cluster = n + step - 1) AS INTEGER) AS size FROM mg WHERE step > 0 GROUP BY step, a, b, h""")
def sample_clusters(spark, d):
    return rounded(stats.clusters(stats.gram(complete(spark, d))), "height", digits=5)


@query()
def permanova(spark, d):
    import numpy as np

    features = spectra.Features(complete(spark, d))
    codes = batch_codes(spark, d, features)
    plan = stats.exchange(codes, key="permanova|batch")
    r2, f = spectra.permanova(features, np.vstack([codes, plan.of(codes)]))
    features.close()
    p, least = plan.p_value(f[1:], float(f[0]))
    return spark.createDataFrame([("batch", float(r2[0]), float(f[0]), p, least)], "variable string, r2 double, f double, p double, p_min double")


@query()
def associations(spark, d):
    """Each sample's missing rate against its batch and its run order."""
    rows = missing.rates(m2(spark, d), ["sample"]).join(samples(spark, d), "sample").orderBy("sample").collect()  # one row per sample
    rate = [r.missing_rate for r in rows]
    found = [("batch", stats.association(rate, [r.batch for r in rows], False, key="batch")), ("run_order", stats.association(rate, [r.run_order for r in rows], True, key="run_order"))]
    tests = spark.createDataFrame([(n, a["test"], a.get("value"), a.get("p"), a["n_used"]) for n, a in found], "variable string, test string, value double, p double, n_used int")
    return stats.bh(tests)


#: Newton's steps, each from the sums over all features at the step before, until nothing moves.
CURVE_SQL = """, ft AS (SELECT feature, AVG(y) AS m, COUNT(y) AS d FROM dx GROUP BY 1 HAVING COUNT(y) > 0), ns AS (SELECT COUNT(DISTINCT sample)::DOUBLE AS n FROM dx), ce AS (SELECT AVG(m) AS c, LEAST(0.95, GREATEST(0.05, AVG(d) / ANY_VALUE(n))) AS s FROM ft, ns),
nw AS (SELECT 0 AS step, LN(s / (1 - s)) AS b0, 0.0::DOUBLE AS b1 FROM ce UNION ALL
  SELECT step + 1, b0 + (h11 * s0 - h01 * s1) / (h00 * h11 - h01 * h01), b1 + (h00 * s1 - h01 * s0) / (h00 * h11 - h01 * h01) FROM (
    SELECT step, b0, b1, SUM(r) AS s0, SUM(r * x) AS s1, SUM(w) AS h00, SUM(w * x) AS h01, SUM(w * x * x) AS h11 FROM (
      SELECT step, b0, b1, x, d - n * p / seen AS r, n * p * (1 - p) / seen - (n * p / seen) * (n * p / seen) * (1 - seen) AS w FROM (
        SELECT step, b0, b1, m - c AS x, d, n, 1 / (1 + EXP(-(b0 + b1 * (m - c)))) AS p, 1 - POW(1 - 1 / (1 + EXP(-(b0 + b1 * (m - c)))), n) AS seen FROM nw, ft, ns, ce)) GROUP BY 1, 2, 3) WHERE step < 40)
SELECT ROUND(b0 - b1 * c, 5) AS b0, ROUND(b1, 5) AS b1 FROM nw, ce WHERE step = 40"""


@query(CURVE_SQL)
def detection_curve(spark, d):
    per = logged(spark, d).groupBy("feature").agg(F.avg("y").alias("mean"), F.count("y").alias("detected"))
    n = logged(spark, d).select("sample").distinct().count()
    b0, b1, _ = fits.detection_curve(per, n)
    return rounded(spark.createDataFrame([(b0, b1)], "b0 double, b1 double"), "b0", "b1", digits=5)


@query(""", pf AS (SELECT feature, LN(AVG(value)) AS x, LN(STDDEV_SAMP(value)) AS y FROM m2 GROUP BY 1 HAVING COUNT(value) >= 3 AND STDDEV_SAMP(value) > 0) SELECT ROUND(REGR_SLOPE(y, x), 5) AS slope, TRUE AS inside FROM pf""")
def mean_spread_slope(spark, d):
    """The slope over all features, and whether its resampled interval holds it."""
    per = m2(spark, d).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).where("n >= 3 and s > 0")
    slope, drawn = fits.slopes(per.select("feature", F.ln("m").alias("x"), F.ln("s").alias("y")), "x", "y", n=199)
    low, high = fits.interval(drawn)
    return rounded(spark.createDataFrame([(slope, low <= slope <= high)], "slope double, inside boolean"), "slope", digits=5)


@query(""", an AS (SELECT feature, batch, COUNT(*) AS k, AVG(y) AS m, VAR_POP(y) * COUNT(*) AS w FROM cm JOIN smp USING (sample) GROUP BY 1, 2),
sq AS (SELECT feature, SUM(k) AS n, COUNT(*) AS levels, MIN(k) AS least, MAX(k) AS most, SUM(w) AS inside, VAR_POP(m) * SUM(k) AS across FROM an GROUP BY 1),
vc AS (SELECT feature, inside / (n - levels) AS msw, (across / (levels - 1) - inside / (n - levels)) / most AS vb, (inside + across) / (n - 1) AS pooled FROM sq WHERE least = most)
SELECT feature, ROUND(GREATEST(0, vb), 5) AS between_batches, ROUND(CASE WHEN vb > 0 THEN msw ELSE pooled END, 5) AS residual FROM vc""")
def variance_by_feature(spark, d):
    """Restricted likelihood for one term, feature by feature; with equally many samples in each batch that is the analysis of variance."""
    found = fits.variance_fits(complete(spark, d).join(samples(spark, d), "sample"), ["feature"], ["batch"])
    wide = found.groupBy("feature").agg(F.max(F.when(F.col("term") == "batch", F.col("variance"))).alias("between_batches"), F.max(F.when(F.col("term") == "residual", F.col("variance"))).alias("residual"))
    return rounded(wide, "between_batches", "residual", digits=5)


@query()
def variance_components(spark, d):
    return fits.variance_components(complete(spark, d), samples(spark, d), ["batch", "subject"])


for _name in ("combat", "principal_components", "sample_clusters", "detection_curve"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)
