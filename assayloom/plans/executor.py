"""Running the operations that change data: registered, checked, approved, verified, recorded.

An operation is a function of cells and keyword parameters; its signature is its parameter list. It sees only the unit that the
approved entry names (all units without one); the state's other cells pass through untouched, and that is verified.
"""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imputation
from ..operators import transforms as X
from ..sources.states import StateStore, content_hash, state_id

#: Set to "off" to refuse the batch corrections.
BATCH_SWITCH = "ASSAYLOOM_BATCH"


class ExecutorError(RuntimeError):
    pass


@dataclass(frozen=True)
class Op:
    """fn(cells, **parameters) -> cells. check(cells, parameters, context) says why not, or nothing. context: the unit's scale and class."""

    name: str
    fn: Callable[..., DataFrame]
    steps: tuple[str, ...]
    check: Callable[[DataFrame, dict, dict], str | None] | None = None
    removes: bool = False
    blanks_zeros: bool = False
    scale_after: Callable[[dict], str] | None = None
    batch: bool = False

    def bound(self, given: dict) -> dict:
        """All parameters with the defaults of the operation's signature; what the signature doesn't take is an error."""
        try:
            call = inspect.signature(self.fn).bind(None, **given)
        except TypeError as e:
            raise ExecutorError(f"{self.name}: {e}") from e
        call.apply_defaults()
        return dict(call.kwargs)


OPS: dict[str, Op] = {}


def register(op: Op) -> Op:
    """Adds an operation; one that fills missing values is refused by its name."""
    if "imput" in op.name.lower():
        raise ExecutorError("operations that fill in missing values are not registered")
    OPS[op.name] = op
    return op


def operation(*steps: str, **how):
    """Registers a function under its own name."""

    def add(fn):
        register(Op(fn.__name__, fn, steps, **how))
        return fn

    return add


def _ids(cells: DataFrame, ids: list[str], column: str) -> DataFrame:
    return cells.sparkSession.createDataFrame([(i,) for i in ids], f"{column} string")


def _mapping(cells: DataFrame, mapping: dict, name: str, kind: str = "string") -> DataFrame:
    cast = float if kind == "double" else str
    return cells.sparkSession.createDataFrame([(str(k), cast(v)) for k, v in mapping.items() if v not in (None, "")], f"sample string, {name} {kind}")


# ---------------------------------------------------------------- conditions


def _known(column: str, remain: int = 0):
    def check(cells: DataFrame, p: dict, ctx: dict) -> str | None:
        if not p["ids"] or not p["reason"]:
            return "needs ids and a reason"
        have, asked = cells.select(column).distinct(), set(p["ids"])
        if have.join(_ids(cells, sorted(asked), column), column, "left_semi").count() < len(asked):
            return f"some ids are no {column}"
        return f"fewer than {remain} would remain" if remain and have.count() - len(asked) < remain else None

    return check


def _on(*scales: str):
    return lambda cells, p, ctx: None if ctx.get("scale") in scales else f"needs a state on a {' or '.join(scales)} scale"


_log2, _log_like, _linear = _on("log2"), _on("log2", "arcsinh"), _on("linear")


def _two_batches(cells, p, ctx):
    return _log2(cells, p, ctx) or ("needs two batches" if len({v for v in (p["batch"] or {}).values() if v}) < 2 else None)


def _complete(cells, p, ctx):
    return _two_batches(cells, p, ctx) or ("there are missing values" if not cells.where("value is null").isEmpty() else None)


def _can_log(cells, p, ctx):
    if why := _linear(cells, p, ctx):
        return why
    if ctx.get("class") not in (None, "continuous_linear"):
        return f"{ctx['class']} data are not log-transformed"
    if p["base"] not in (2, 10, "e") or p["offset_rule"] not in ("none", "half_min", "fixed", "plus_one"):
        return "base 2, 10 or e; offset rule none, half_min, fixed or plus_one"
    if p["offset_rule"] == "fixed" and not p["offset"] > 0:
        return "a fixed offset must be positive"
    low = cells.agg(F.count_if(F.col("value") < 0).alias("negative"), F.count_if(F.col("value") == 0).alias("zero")).first()
    return "there are negative values" if low["negative"] else "zeros need an offset" if p["offset_rule"] == "none" and low["zero"] else None


def _justified(cells, p, ctx):
    return _linear(cells, p, ctx) or (None if p["cofactor"] and p["cofactor"] > 0 and str(p["justification"]).strip() else "needs a positive cofactor and its justification")


def _zeros(cells, p, ctx):
    return "needs the answer yes" if p["answer"] != "yes" else "there are no zeros" if cells.where("value = 0").isEmpty() else None


def _qc_cover(cells, p, ctx):
    if why := _log_like(cells, p, ctx):
        return why
    order, qc = {k: float(v) for k, v in p["run_order"].items() if v not in (None, "")}, p["qc_samples"]
    names = {r["sample"] for r in cells.select("sample").distinct().collect()}  # samples, not cells
    if not names <= set(order):
        return "the run order is not complete"
    at, every = sorted(order[s] for s in qc if s in names), sorted(order[s] for s in names)
    if len(at) < p["min_qc"]:
        return f"fewer than {p['min_qc']} QC samples"
    low, high = every[int(0.1 * (len(every) - 1))], every[round(0.9 * (len(every) - 1))]
    return None if at[0] <= low and at[-1] >= high else "the QC samples do not span the run"


# ---------------------------------------------------------------- operations: names, steps, parameters and defaults are fixed values


@operation("G3", "S3", check=_known("feature"), removes=True)
def remove_features(cells, *, ids, reason):
    return X.remove_features(cells, _ids(cells, ids, "feature"))


@operation("S4", check=_known("sample", 3), removes=True)
def remove_samples(cells, *, ids, reason):
    return X.remove_samples(cells, _ids(cells, ids, "sample"))


@operation("G7", check=_zeros, blanks_zeros=True)
def recode_zero_as_missing(cells, *, answer):
    return X.recode_zero(cells)


@operation("G5", check=_can_log, scale_after=lambda p: {2: "log2", 10: "log10", "e": "ln"}[p["base"]])
def log_transform(cells, *, base=2, offset_rule="half_min", offset=0.0):
    return X.log_transform(cells, base, offset_rule, offset)


@operation("G5", check=_justified, scale_after=lambda p: "arcsinh")
def arcsinh_transform(cells, *, cofactor, justification):
    return X.arcsinh_transform(cells, cofactor)


@operation("G6", check=_qc_cover)
def drift_qc_loess(cells, *, qc_samples, run_order, span=0.75, degree=2, min_qc=5, min_qc_per_feature=5):
    return X.drift_qc_loess(cells, _mapping(cells, run_order, "run_order", "double"), _ids(cells, qc_samples, "sample"), span, degree, min_qc_per_feature)


@operation("S1", check=_log2)
def normalize_median(cells):
    return X.normalize_median(cells)


@operation("S1", check=_log2)
def normalize_quantile(cells):
    return X.normalize_quantile(cells)


@operation("S2", check=_two_batches, batch=True)
def batch_center(cells, *, batch, stat="median"):
    return X.batch_center(cells, _mapping(cells, batch, "batch"), stat)


@operation("S2", check=_complete, batch=True)
def batch_combat(cells, *, batch):
    return X.combat(cells, _mapping(cells, batch, "batch"))


@operation("S2", check=_log2, batch=True)
def drift_sample_loess(cells, *, batch, run_order, span=0.75, degree=2, min_measurements=8):
    order = _mapping(cells, run_order, "run_order", "double").join(_mapping(cells, batch, "batch"), "sample")
    return X.drift_sample_loess(cells, order, span, degree, min_measurements)


@operation("S2", check=_two_batches, batch=True)
def correct_batch_effects(cells, *, batch, run_order, method="median", span=0.75, degree=2, min_measurements=8):
    order = _mapping(cells, run_order, "run_order", "double").join(_mapping(cells, batch, "batch"), "sample")
    return X.correct_batch_effects(cells, order, method, span=span, degree=degree, least=min_measurements)


#: What fills missing cells: outside the registered operations and the plan, run by impute() alone.
FILLS: dict[str, Op] = {}


def _by_batch(cells: DataFrame, batch: dict | None) -> tuple[DataFrame, list[str]]:
    """Cells with the unit, and the batch where it counts, as keys."""
    keys = X.unit_keys(cells)
    return (cells.join(F.broadcast(_mapping(cells, batch, "__batch")), "sample", "left"), [*keys, "__batch"]) if batch else (cells, keys)  # a row per sample


def _min_prob(cells, *, shift=1.8, scale=0.3, batch=None, seed=0):
    own, keys = _by_batch(cells, batch)
    return imputation.min_prob(own, keys, shift, scale, seed)


def _knn(cells, *, k=5, batch=None):
    own, keys = _by_batch(cells, batch)
    return imputation.knn(own, keys, k)


FILLS |= {"min_prob": Op("min_prob", _min_prob, ("S6",)), "knn": Op("knn", _knn, ("S6",))}


# ---------------------------------------------------------------- running


def blocks_of(cells: DataFrame, scope: str | None) -> dict[str, str]:
    """block -> unit, of the units that scope (an assay, a unit or a block of it; None: all) names."""
    every = {r["block"]: r["unit"] for r in X.units(cells).collect()}  # a row per block
    if scope is None:
        return every
    named = {every[scope]} if scope in every else {u for b, u in every.items() if scope in (u, b.split("B")[0])}
    if not named:
        raise ExecutorError(f"no unit {scope}")
    return {b: u for b, u in every.items() if u in named}


def run(op: Op, cells: DataFrame, p: dict, inside: dict[str, str]) -> DataFrame:
    """The operation on the blocks of inside, unit by unit; other blocks as they are."""
    unit = F.element_at(F.create_map(*(F.lit(x) for pair in inside.items() for x in pair)), F.col("block"))
    here = F.col("block").isin(*inside)
    columns = ["block", "feature", "sample", "value"]
    changed = op.fn(cells.where(here).select(*columns).withColumn("unit", unit), **p)
    return changed.select(*columns).unionByName(cells.where(~here).select(*columns))


def apply(store: StateStore, name: str, params: dict | None, approval: dict, step: str | None = None, context: dict | None = None, parent: str | None = None, move_head: bool = True, scope: str | None = None) -> str:
    """Runs an approved operation on the units of scope and adds the state it gives. Refused if a condition fails or an invariant
    breaks: the rows are written as a draft and held against the parent before the draft becomes a state."""
    if name not in OPS:
        raise ExecutorError(f"no operation {name}")
    if not (approval or {}).get("user") or "entry" not in approval:
        raise ExecutorError("needs an approval: who, and of which plan entry")
    op, meta = OPS[name], store.meta(parent)
    step = step or op.steps[0]
    if step not in op.steps:
        raise ExecutorError(f"{name} is no operation of {step}")
    if op.batch and os.environ.get(BATCH_SWITCH, "on") == "off":
        raise ExecutorError("batch corrections are switched off")
    p, cells = op.bound(params or {}), store.data(parent)
    inside = blocks_of(cells, scope)
    scales = {meta["scales"][b] for b in inside}
    context = {"scale": scales.pop() if len(scales) == 1 else "mixed", **(context or {})}
    if why := op.check and op.check(cells.where(F.col("block").isin(*inside)), p, context):
        raise ExecutorError(f"{name}: {why}")
    after = op.scale_after(p) if op.scale_after else None
    record = {"op": name, "step": step, "params": p, "seed": 0, "entry": approval["entry"], "blocks": inside, "approval": approval}
    try:
        draft = store.draft(run(op, cells, p, inside))
    except (SparkRuntimeException, ValueError) as e:
        raise ExecutorError(f"{name}: {e}") from e
    broken = X.violations(cells, draft.cells, op.removes, op.blanks_zeros, F.col("block").isin(*inside)).first().asDict()
    if op.removes:
        gone = cells.join(draft.cells, ["block", "feature", "sample"], "left_anti").where(~F.col("block").isin(*inside))
        broken["lost"] += gone.count()
    if any(broken.values()):
        draft.discard()
        raise ExecutorError(f"{name} broke an invariant: {broken}")
    return store.keep(draft, meta["state_id"], record, meta["scales"] | ({b: after for b in inside} if after else {}), move_head)


def impute(store: StateStore, method: str, params: dict | None, approval: dict, parent: str | None = None, scope: str | None = None, move_head: bool = False) -> str:
    """Experimental: a state whose missing cells a method has filled. It isn't reachable from a plan; who runs it says so in the approval, as for any
    operation, and HEAD stays where it is unless asked. Observed values, and which cells there are, must come out as they were, or the
    state is refused."""
    if method not in FILLS:
        raise ExecutorError(f"no method {method}: {', '.join(FILLS)}")
    if not (approval or {}).get("user"):
        raise ExecutorError("needs an approval: who")
    op, meta, cells = FILLS[method], store.meta(parent), store.data(parent)
    p, inside = op.bound(params or {}), blocks_of(cells, scope)
    gaps = lambda c: c.where(F.col("value").isNull() & F.col("block").isin(*inside)).count()
    try:
        draft = store.draft(run(op, cells, p, inside))
    except (SparkRuntimeException, ValueError) as e:
        raise ExecutorError(f"{method}: {e}") from e
    broken = X.violations(cells, draft.cells, touched=F.col("block").isin(*inside), may_fill=True).first().asDict()
    if any(broken.values()):
        draft.discard()
        raise ExecutorError(f"{method} broke an invariant: {broken}")
    record = {"op": f"impute:{method}", "step": "S6", "params": p, "seed": p.get("seed", 0), "entry": approval.get("entry", ""), "blocks": inside, "approval": approval, "experimental": True, "gaps_before": gaps(cells), "gaps_after": gaps(draft.cells)}
    return store.keep(draft, meta["state_id"], record, meta["scales"], move_head)


def _op(name: str) -> Op:
    return FILLS[name.removeprefix("impute:")] if name.startswith("impute:") else OPS[name]


def replay(store: StateStore, sid: str | None = None) -> dict:
    """Runs a state's chain again from its root, without writing a state, and compares the names. Values are compared by the digits
    that name states, for sums may end differently."""
    chain = store.chain(sid)
    at, cells, same, held = chain[0]["state_id"], store.data(chain[0]["state_id"]), True, []
    for s in chain[1:]:
        cells = run(_op(s["op"]["op"]), cells, s["op"]["params"], s["op"]["blocks"]).persist()
        held.append(cells)
        at = state_id(at, s["op"], content_hash(cells))
        same = same and at == s["state_id"]
    for c in held:
        c.unpersist()
    return {"identical": same, "state_id": at, "steps": len(chain) - 1}
