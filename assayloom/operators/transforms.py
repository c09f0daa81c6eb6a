"""The operations that change data: each takes cells and gives cells. Missing values stay missing; nothing is filled.

A unit is what one operation looks at as a whole: the blocks that `units` puts together, or one block. Every operation works within
units, so two blocks of the same samples never mix. Cells without a column `unit` are units by their block; without that, one unit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def unit_keys(cells: DataFrame) -> list[str]:
    return ["unit"] if "unit" in cells.columns else ["block"] if "block" in cells.columns else []


def shared_keys(cells: DataFrame) -> DataFrame:
    """(one, two, n): pairs of blocks that have feature ids in common, and how many; blocks whose keys are disjoint give no row."""
    keys = cells.select("block", "feature").distinct()
    pairs = keys.toDF("one", "feature").join(keys.toDF("two", "feature"), "feature").where("one < two")
    return pairs.groupBy("one", "two").agg(F.count("*").alias("n"))


def units(cells: DataFrame) -> DataFrame:
    """(block, unit): an assay's blocks are one unit where their feature ids are disjoint and their samples the same, else a unit each.

    A block's assay is what stands before the B of its name. Samples are compared by a hash of their set, so nothing but a row per
    block meets in one place."""
    assay = F.substring_index("block", "B", 1)
    keys = cells.select("block", "feature").distinct()
    once = keys.groupBy(assay.alias("assay"), "feature").agg(F.count("*").alias("times"))
    apart = once.groupBy("assay").agg((F.max("times") == 1).alias("disjoint"))
    sets = cells.select("block", "sample").distinct().groupBy("block").agg(F.sum(F.xxhash64("sample").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    same = sets.groupBy(assay.alias("assay")).agg((F.count_distinct("h", "n") == 1).alias("same"))
    joined = sets.select("block", assay.alias("assay")).join(F.broadcast(apart.join(same, "assay")), "assay")  # a row per assay
    return joined.select("block", F.when(F.col("disjoint") & F.col("same"), F.col("assay")).otherwise(F.col("block")).alias("unit"))


def with_units(cells: DataFrame) -> DataFrame:
    return cells.join(F.broadcast(units(cells)), "block")  # a row per block


def remove_features(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """cells without the features of ids (a column feature)."""
    return cells.join(ids, "feature", "left_anti")


def remove_samples(cells: DataFrame, ids: DataFrame) -> DataFrame:
    return cells.join(ids, "sample", "left_anti")


def recode_zero(cells: DataFrame) -> DataFrame:
    """Exact zeros become missing: the one operation that may change which cells are missing."""
    return cells.withColumn("value", F.when(F.col("value") != 0, F.col("value")))


def _per_unit(cells: DataFrame, small: DataFrame) -> DataFrame:
    """cells with the columns of small, a row per unit."""
    keys = unit_keys(cells)
    return cells.join(F.broadcast(small), keys) if keys else cells.crossJoin(F.broadcast(small))


def log_transform(cells: DataFrame, base: float | str = 2, rule: str = "half_min", offset: float = 0.0) -> DataFrame:
    """log of value + c. rule none: c = 0; half_min: half of the unit's smallest positive value (1 without any); fixed: offset; plus_one: 1."""
    value = F.col("value")
    if rule == "half_min":
        low = cells.groupBy(*unit_keys(cells)).agg(F.coalesce(F.min(F.when(value > 0, value)) / 2, F.lit(1.0)).alias("__c"))
        cells, c = _per_unit(cells, low), F.col("__c")
    else:
        c = F.lit({"none": 0.0, "fixed": float(offset), "plus_one": 1.0}[rule])
    x = value + c
    log = F.log2(x) if base == 2 else F.log10(x) if base == 10 else F.ln(x)
    return cells.withColumn("value", F.when(x > 0, log)).drop("__c")


def arcsinh_transform(cells: DataFrame, cofactor: float) -> DataFrame:
    return cells.withColumn("value", F.asinh(F.col("value") / cofactor))


def normalize_median(cells: DataFrame) -> DataFrame:
    """Each sample's median moves to the median of all values of its unit. An error, when it runs, if a sample has no value."""
    keys = unit_keys(cells)
    here = F.count("value") > 0
    per = cells.groupBy(*keys, "sample").agg(F.when(here, F.median("value")).otherwise(F.raise_error(F.lit("a sample has no value")).cast("double")).alias("__s"))
    total = stats.exact_median(cells, keys, "value").withColumnRenamed("median", "__t")
    return _per_unit(cells.join(per, [*keys, "sample"]), total).withColumn("value", F.col("value") - F.col("__s") + F.col("__t")).drop("__s", "__t")


def _profile(cells: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """(keys, i, v): the mean sorted profile of a unit's samples; at each rank where the samples are whole, else read at __grid places over [0, 1].

    A sample's k-th of m sorted values stands at (k - 0.5) / m. Each value covers the places from its own to the next one's, so a
    sample gives one row per place and nothing is gathered."""
    w = Window.partitionBy(*keys, "sample").orderBy("value")
    v = F.col("value")
    ordered = cells.where(v.isNotNull()).select(*keys, "sample", "value", "__grid", F.row_number().over(w).alias("k"), F.lead("value").over(w).alias("__next"))
    if whole:
        return ordered.groupBy(*keys, (F.col("k") - 1).alias("i")).agg(F.avg("value").alias("v"))
    m, last = F.count("*").over(Window.partitionBy(*keys, "sample")), F.col("__grid") - 1
    place = lambda k: F.ceil((k - 0.5) / F.col("__m") * last).cast("int")
    spans = ordered.withColumn("__m", m).withColumns({
        "__from": F.when(F.col("k") == 1, 0).otherwise(place(F.col("k"))),
        "__to": F.when(F.col("k") == F.col("__m"), last).otherwise(place(F.col("k") + 1) - 1).cast("int"),
    }).where("__from <= __to")
    at = spans.withColumn("i", F.explode(F.sequence("__from", "__to")))
    beyond = F.col("i") / last.cast("double") * F.col("__m") - (F.col("k") - 0.5)
    read = v + F.when(beyond <= 0, 0.0).otherwise(beyond) * (F.coalesce("__next", v) - v)
    return at.groupBy(*keys, "i").agg(F.avg(read).alias("v"))


def normalize_quantile(cells: DataFrame) -> DataFrame:
    """Each sample gets its unit's mean sorted profile, read at its values' average ranks.

    Complete units: the profile has a value per rank. With gaps: each sample's sorted values are read at p points over [0, 1]
    (p: the unit's features) and averaged; a value of rank r among n is read at (r - 0.5) / n. Ranks between points are interpolated.
    All units go through one plan, in which the unit is a key and the number of points a column.
    """
    keys = unit_keys(cells)
    shape = cells.groupBy(*keys).agg(F.count_distinct("feature").alias("p"), F.count_if(F.col("value").isNull()).alias("gaps"))
    shape = shape.select(*keys, F.when(F.col("gaps") > 0, F.greatest("p", F.lit(2))).cast("int").alias("__grid"))
    shaped, out = _per_unit(cells, shape), []
    for whole in (True, False):
        one = shaped.where(F.col("__grid").isNull() if whole else F.col("__grid").isNotNull())
        ranks = stats.ranked(one, [*keys, "sample"], "value", "__r")
        at = F.col("__r") - 1 if whole else (F.col("__r") - 0.5) / F.count("*").over(Window.partitionBy(*keys, "sample")) * (F.col("__grid") - 1)
        placed = ranks.withColumn("__at", at).withColumn("__lo", F.floor("__at").cast("int"))
        profile = _profile(one, keys, whole)
        lo = profile.select(*keys, F.col("i").alias("__lo"), F.col("v").alias("__vlo"))
        hi = profile.select(*keys, (F.col("i") - 1).alias("__lo"), F.col("v").alias("__vhi"))
        value = F.col("__vlo") + (F.col("__at") - F.col("__lo")) * (F.coalesce("__vhi", "__vlo") - F.col("__vlo"))
        out.append(placed.join(lo, [*keys, "__lo"]).join(hi, [*keys, "__lo"], "left").withColumn("value", value).select(*cells.columns))
    return out[0].unionByName(out[1]).unionByName(cells.where("value is null"))


def _middle(stat: str, c: Column) -> Column:
    return F.median(c) if stat == "median" else F.avg(c)


def batch_center(cells: DataFrame, batches: DataFrame, stat: str = "median", exclude: Column | None = None) -> DataFrame:
    """Each feature's batches move to its middle over all: x - stat(batch) + stat(all), within units. batches: (sample, batch).

    Samples without a batch and batches without a value stay. exclude: cells that the middle leaves out but that move all the same.
    Both middles are windows over the feature's cells: one shuffle, and the input is read once.
    """
    keys = [*unit_keys(cells), "feature"]
    used = F.col("value") if exclude is None else F.when(~F.coalesce(exclude, F.lit(False)), F.col("value"))
    tagged = cells.join(batches.where("batch is not null and batch <> ''").select("sample", "batch"), "sample", "left").withColumn("__u", used)
    middles = tagged.withColumn("__a", _middle(stat, F.col("__u")).over(Window.partitionBy(*keys))).withColumn("__b", _middle(stat, F.col("__u")).over(Window.partitionBy(*keys, "batch")))
    shift = F.when(F.col("batch").isNotNull(), F.col("__b") - F.col("__a"))
    return middles.withColumn("value", F.col("value") - F.coalesce(shift, F.lit(0.0))).select(*cells.columns)


def _steps(pdf, rounds: np.ndarray | None, tolerance: float, most: int):
    """Posterior shift and variance of each row (a feature in a batch), and after how many steps they stand still.

    Each step takes the means of the two conditional posteriors. Without rounds, a row goes on until its own change is at most
    tolerance; with rounds, for exactly so many steps."""
    n, g, ss, prior_g, prior_t, a, s = (pdf[c].to_numpy(float) for c in ("n", "g", "ss", "prior_g", "prior_t", "a", "s"))
    shift, spread, took = g.copy(), pdf["d"].to_numpy(float).copy(), np.zeros(len(g), np.int64)
    todo = np.arange(len(g))
    for step in range(1, most + 1):
        i = todo
        new = (prior_t[i] * n[i] * g[i] + spread[i] * prior_g[i]) / (prior_t[i] * n[i] + spread[i])
        wide = (0.5 * (ss[i] + n[i] * (g[i] - new) ** 2) + s[i]) / (n[i] / 2 + a[i] - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            moved = np.fmax(np.abs(new - shift[i]) / np.abs(shift[i]), np.abs(wide - spread[i]) / spread[i])
        shift[i], spread[i], took[i] = new, wide, step
        todo = i[moved > tolerance] if rounds is None else i[step < rounds[i]]
        if not len(todo):
            break
    return shift, spread, took


def combat(cells: DataFrame, batches: DataFrame, tolerance: float = 1e-4, most: int = 10_000) -> DataFrame:
    """Parametric empirical Bayes for location and scale of batches, without covariates, within units.

    Standardised by the feature's mean and the variance within batches (divided by n). The posteriors' fixed point needs only each
    feature's and batch's count, mean and variance, so everything is aggregates and joins on features and batches in Spark; the
    steps run over those rows in Arrow batches. All features of a batch take as many steps as the slowest needs, as if iterated
    together. Refused with missing values, a sample without a batch, or a batch of one sample. A feature without variance in some
    batch stays.
    """
    keys = unit_keys(cells)
    tagged = cells.join(batches.where("batch is not null and batch <> ''").select("sample", "batch"), "sample", "left")
    per = tagged.groupBy(*keys, "feature", "batch").agg(F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count_if(F.col("value").isNull()).alias("gaps"))
    bad = per.agg(F.sum("gaps").alias("gaps"), F.count_if(F.col("batch").isNull()).alias("loose"), F.min("n").alias("least")).first()
    if bad["gaps"]:
        raise ValueError("combat needs complete data")
    if bad["loose"] or (bad["least"] is not None and bad["least"] < 2):
        raise ValueError("combat needs a batch for each sample and two samples in each batch")
    feature, batch = Window.partitionBy(*keys, "feature"), Window.partitionBy(*keys, "batch")
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    z = per.withColumns({
        "total": F.sum("n").over(feature), "flat": F.min("v").over(feature) <= 0, "grand": F.sum(n * m).over(feature) / F.sum("n").over(feature), "pooled": F.sum(n * v).over(feature) / F.sum("n").over(feature),
    }).where("not flat").withColumn("scale", F.sqrt("pooled"))
    z = z.select(*keys, "feature", "batch", "n", "grand", "scale", ((m - F.col("grand")) / F.col("scale")).alias("g"), (n * v / F.col("pooled")).alias("ss"), (n * v / F.col("pooled") / (n - 1)).alias("d"))
    mean, var = F.avg("d").over(batch), F.var_samp("d").over(batch)
    z = z.withColumns({
        "prior_g": F.avg("g").over(batch), "prior_t": F.var_samp("g").over(batch), "a": (2 * var + mean * mean) / F.nullif(var, F.lit(0.0)), "s": (mean * var + mean * mean * mean) / F.nullif(var, F.lit(0.0)),
    })
    kind = [f for f in z.schema.fields if f.name in (*keys, "feature", "batch", "grand", "scale")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    names = [f.name for f in kind]

    def counted(frames):
        for pdf in frames:
            yield pdf[[*keys, "batch"]].assign(rounds=_steps(pdf, None, tolerance, most)[2])

    def fitted(frames):
        for pdf in frames:
            shift, wide, _ = _steps(pdf, pdf["rounds"].to_numpy(), tolerance, most)
            yield pdf[names].assign(shift=shift, spread=np.sqrt(wide))

    usable = z.where("prior_t > 0 and a is not null")  # a single feature has no prior
    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind if f.name in (*keys, "batch"))
    slowest = usable.mapInPandas(counted, f"{keyed}, rounds long").groupBy(*keys, "batch").agg(F.max("rounds").alias("rounds"))
    fits = usable.join(F.broadcast(slowest), [*keys, "batch"]).mapInPandas(fitted, f"{ddl}, shift double, spread double")  # a row per batch
    plain = z.where("prior_t is null or prior_t <= 0 or a is null").select(*names, F.col("g").alias("shift"), F.sqrt(F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).alias("spread"))
    out = tagged.join(fits.unionByName(plain), [*keys, "feature", "batch"], "left")
    adjusted = ((F.col("value") - F.col("grand")) / F.col("scale") - F.col("shift")) / F.col("spread") * F.col("scale") + F.col("grand")
    return out.withColumn("value", F.coalesce(adjusted, F.col("value"))).select(*cells.columns)


def _whole_curves(frames):
    """The rows of Arrow batches as tables that hold whole curves; __k numbers a curve's rows from 1."""
    import pyarrow as pa

    held = []
    for frame in frames:
        begins = np.flatnonzero(frame.column("__k").to_numpy() == 1)
        if len(begins) and held:
            yield pa.Table.from_batches([*held, frame.slice(0, begins[-1])]).combine_chunks()
            held = []
        elif len(begins) and begins[-1]:
            yield pa.Table.from_batches([frame.slice(0, begins[-1])])
        held.append(frame.slice(begins[-1]) if len(begins) else frame)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _levelled(cells: DataFrame, ordered: DataFrame, keys: list[str], pick, span: float, degree: int) -> DataFrame:
    """cells with values x + (mean of the curve at its own points - the curve at x's place), flat beyond the points; ordered has the cells with their run_order.

    pick(seen, begins, lengths, table) tells which rows are a curve's points; curves without points stay, and so do cells without a
    run order. A task takes its curves in a row, sorted, and fits those of an Arrow batch together.
    """
    kind = cells.schema
    place = Window.partitionBy(*keys).orderBy("run_order", "sample")

    def fit(frames):
        import pyarrow as pa

        for table in _whole_curves(frames):
            if not table.num_rows:
                continue
            begins = np.flatnonzero(table["__k"].to_numpy() == 1)
            x, value = (table[c].cast(pa.float64()).to_numpy() for c in ("run_order", "value"))
            lengths = np.diff(np.append(begins, len(x)))
            of = np.repeat(np.arange(len(begins)), lengths)
            seen = ~np.isnan(x) & ~np.isnan(value)
            points = pick(seen, begins, lengths, table)
            n = np.bincount(of[points], minlength=len(begins))
            to = seen & (n > 0)[of]
            last = np.cumsum(n)[of[to]]
            at = np.clip(x[to], x[points][last - n[of[to]]], x[points][last - 1])
            curve = np.full(len(x), np.nan)
            curve[to] = stats.local_regressions(x[points], value[points], n, at, np.bincount(of[to], minlength=len(begins)), span, degree)
            own = points & ~np.isnan(curve)
            with np.errstate(invalid="ignore"):
                mean = np.bincount(of[own], curve[own], len(begins)) / np.bincount(of[own], minlength=len(begins))
            value = np.where(to, value + mean[of] - curve, value)
            new = pa.array(value, from_pandas=True).cast(table.schema.field("value").type)
            yield from pa.table([new if f == "value" else table[f] for f in kind.names], names=kind.names).to_batches()

    return ordered.withColumn("__k", F.row_number().over(place)).mapInArrow(fit, kind)


def drift_qc_loess(cells: DataFrame, order: DataFrame, qc: DataFrame, span: float = 0.75, degree: int = 2, least: int = 5) -> DataFrame:
    """x + (mean of the QC fit - the fit at x's place), per feature of a unit; the curve is fitted on QC samples over the run order.

    order: (sample, run_order), qc: (sample). Features with fewer than `least` QC values stay. The fit is flat outside the QC range.
    """
    plan = order.join(qc.withColumn("__qc", F.lit(True)), "sample", "left").select("sample", F.col("run_order").cast("double"), F.coalesce("__qc", F.lit(False)).alias("__qc"))
    if plan.where("__qc").count() < least:
        raise ValueError("too few QC samples")

    def pick(seen, begins, lengths, table):
        known = seen & table["__qc"].to_numpy()
        return known & np.repeat(np.add.reduceat(known, begins, dtype=int) >= least, lengths)

    return _levelled(cells, cells.join(plan, "sample"), [*unit_keys(cells), "feature"], pick, span, degree)


def drift_sample_loess(cells: DataFrame, order: DataFrame, span: float = 0.75, degree: int = 2, least: int = 8) -> DataFrame:
    """The same within each batch, fitted on the samples themselves. order: (sample, run_order, batch). A feature's batch without
    `least` values in a row stays."""

    def pick(seen, begins, lengths, _):
        at = np.arange(len(seen))
        gap = np.maximum.accumulate(np.maximum(np.where(seen, -1, at), np.repeat(begins - 1, lengths)))  # the last gap, or the row before the curve
        return seen & np.repeat(np.maximum.reduceat(at - gap, begins) >= least, lengths)

    joined = cells.join(order.select("sample", F.col("run_order").cast("double"), "batch"), "sample")
    return _levelled(cells, joined, [*unit_keys(cells), "feature", "batch"], pick, span, degree)


def correct_batch_effects(cells: DataFrame, order: DataFrame, method: str = "median", **loess) -> DataFrame:
    """Continuous, then discrete: drift_sample_loess, then centring by median or mean, or combat."""
    smooth, batches = drift_sample_loess(cells, order, **loess), order.select("sample", "batch")
    return combat(smooth, batches) if method == "combat" else batch_center(smooth, batches, method)


def violations(parent: DataFrame, child: DataFrame, may_remove: bool = False, may_blank_zero: bool = False, touched: Column | None = None, may_fill: bool = False) -> DataFrame:
    """(lost, added, gap_changed, new_infinite, changed_outside): what an operation broke; all 0 or the state is refused.

    lost: cells gone, unless it removes. gap_changed: missing cells filled or values blanked (zeros may be, if so declared; with may_fill gaps
    may be filled, and then nothing else may change).
    changed_outside: values changed where touched (a predicate over block, feature and sample) does not hold, or by a removal.
    """
    keys = [c for c in ("block", "feature", "sample") if c in parent.columns]
    old, new = F.col("old"), F.col("new")
    both = parent.select(*keys, F.col("value").alias("old"), F.lit(True).alias("p")).join(child.select(*keys, F.col("value").alias("new"), F.lit(True).alias("c")), keys, "full")
    kept = F.col("p").isNotNull() & F.col("c").isNotNull()
    gap = kept & (old.isNull() != new.isNull())
    if may_blank_zero:
        gap = gap & ~(F.coalesce(old == 0, F.lit(False)) & new.isNull())
    if may_fill:
        gap = gap & new.isNull()
    infinite = kept & F.coalesce((F.abs("new") == float("inf")) & (F.abs("old") != float("inf")), F.lit(False))
    allowed = F.lit(False) if may_remove else F.lit(True) if touched is None else F.coalesce(touched, F.lit(False))
    if may_fill:
        allowed = allowed & old.isNull()
    outside = kept & ~old.eqNullSafe(new) & ~allowed
    return both.agg(F.count_if(F.col("c").isNull() & F.lit(not may_remove)).alias("lost"), F.count_if(F.col("p").isNull()).alias("added"), F.count_if(gap).alias("gap_changed"), F.count_if(infinite).alias("new_infinite"), F.count_if(outside).alias("changed_outside"))
