"""What a proposer may see of a table: counts, shapes and templates, never rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import facts
from ..sources.delimited import ROW, Table
from .layout import Layout

#: Characters that a digest may have.
LIMIT = 300_000


def digest(table: Table, layout: Layout | None = None, examples: bool = True) -> dict:
    """Templates of numeric columns and facts of the others, from aggregates over the melted table; one entry per column or template.

    examples False leaves out every value. Values are also left out where more than half of them are unique.
    """
    import re

    numeric = [c for c, f in table.facts.items() if f["kind"] == "numeric"]
    groups: dict[str, list[str]] = {}
    for c in numeric:
        groups.setdefault(re.sub(r"\d+", "#", c), []).append(c)
    templates = {t: names for t, names in groups.items() if len(names) >= 2}
    templated = {c for names in templates.values() for c in names}
    cells = facts.melted(table.data, table.names, ROW)
    values = cells.where(F.col("column").isin(numeric)).select("column", S.finite(S.number(F.col("cell"))).alias("value")) if numeric else None
    numbers = {r["column"]: r.asDict() for r in facts.numeric_facts(values, ["column"]).collect()} if numeric else {}
    others = [c for c in table.names if c not in templated]
    texts = {r["column"]: r.asDict(True) for r in facts.text_facts(cells.where(F.col("column").isin(others))).collect()} if others else {}
    out = {"n_rows": table.data.count(), "n_columns": len(table.names), "layout_hint": layout.orientation if layout else None, "templates": [], "columns": []}
    for t, names in templates.items():
        of = [numbers[c] for c in names if c in numbers]
        medians = sorted(x["median"] for x in of)
        out["templates"].append({"template": t, "n_columns": len(names), "first": names[0], "last": names[-1], "n_missing": sum(table.facts[c]["n_missing"] for c in names), "min": min((x["min"] for x in of), default=None), "median": medians[len(medians) // 2] if medians else None, "max": max((x["max"] for x in of), default=None)})
    for c in others:
        f, entry = table.facts[c], {"name": c}
        entry |= {k: f[k] for k in ("kind", "n_missing", "n_unique")}
        if c in numbers:
            entry["numbers"] = {k: round_to(v) for k, v in numbers[c].items() if k != "column"}
        if c in texts:
            t = texts[c]
            entry |= {"unique_ratio": round_to(t["unique_ratio"]), "length": [t["shortest"], t["longest"]], "shapes": t["shapes"]}
            if examples and t["values"]:
                entry["values"] = t["values"]
        out["columns"].append(entry)
    return out


def round_to(x, digits: int = 4):
    if isinstance(x, bool) or x is None or not isinstance(x, float):
        return x
    return float(f"{x:.{digits}g}")


def show(d: dict, most: int | None = 4000) -> str:
    said = json.dumps(d, indent=1, default=str)
    said = said if most is None or len(said) <= most else said[:most] + "\n..."
    print(said)
    return said


def checked_size(d: dict) -> str:
    """The digest as JSON; refused above LIMIT."""
    said = json.dumps(d, default=str)
    if len(said) > LIMIT:
        raise ValueError(f"the digest has {len(said)} characters; at most {LIMIT} may leave")
    return said
