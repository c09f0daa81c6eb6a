"""Groups of columns that are one thing: checking a proposer's answer against the table, and editing the groups."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from ..sources.delimited import Table
from .digest import checked_size, digest
from .layout import Layout, propose_layout

# Closed vocabularies.
ROLES = ("feature_id", "feature_annotation", "value", "sample_id", "sample_metadata", "ignore", "unresolved")
AUDIT_KINDS = ("subject_id", "timepoint", "batch", "run_order", "technical_replicate", "sample_type", "group", "covariate", "other")
SAMPLE_TYPES = ("study", "qc", "blank", "pool", "calibrator", "reference", "other")
TIME_UNITS = ("minutes", "hours", "days", "weeks", "months", "years", "visit_index")
PROVENANCE = ("computed", "ai_proposed", "ai_proposed_confirmed", "ai_proposed_corrected", "user_set")

SYSTEM = "You see a description of a table, never its rows. Group the columns that are one thing and give each group a role. Answer in JSON."
ANSWER = {"type": "object", "required": ["layout", "groups"], "properties": {"layout": {"type": "string"}, "groups": {"type": "array", "items": {"type": "object", "required": ["columns", "role"]}}}}


@dataclass(frozen=True)
class Group:
    gid: str
    columns: tuple[str, ...]
    role: str
    label: str = ""
    audit_kind: str | None = None
    assay: str | None = None
    provenance: str = "ai_proposed"

    @property
    def decided(self) -> bool:
        return self.role != "unresolved" and self.provenance != "ai_proposed"


@dataclass
class Grouping:
    layout: str | None
    groups: list[Group]
    rejected: list[dict] = field(default_factory=list)

    def columns(self) -> dict[str, str]:
        return {c: g.gid for g in self.groups for c in g.columns}

    def unresolved(self) -> list[Group]:
        return [g for g in self.groups if g.role == "unresolved"]


def expand(name: str, columns: list[str]) -> list[str]:
    """The columns that a name or a template (# for digits) stands for, in file order."""
    if name in columns:
        return [name]
    if "#" not in name:
        return []
    pattern = re.compile("^" + r"\d+".join(map(re.escape, name.split("#"))) + "$")
    return [c for c in columns if pattern.match(c)]


def checked(table: Table, answer: dict) -> Grouping:
    """The answer as groups that hold against the table: unknown columns, roles and second claims are rejected with the reason;
    columns that nobody claims are unresolved; value groups of the same label merge; ids follow the file order."""
    taken: dict[str, int] = {}
    kept, rejected = [], []
    for raw in answer.get("groups", []):
        role = raw.get("role") if raw.get("role") in ROLES else "unresolved"
        if role != raw.get("role"):
            rejected.append({"group": raw.get("label"), "reason": f"no role {raw.get('role')!r}"})
        kind = raw.get("audit_kind")
        if kind is not None and kind not in AUDIT_KINDS:
            rejected.append({"group": raw.get("label"), "reason": f"no kind {kind!r}"})
            kind = None
        mine = []
        for name in raw.get("columns", []):
            found = expand(name, table.names)
            if not found:
                rejected.append({"column": name, "reason": "not a column of the table"})
            for c in found:
                if c in taken:
                    rejected.append({"column": c, "reason": "already in an earlier group"})
                else:
                    taken[c] = len(kept)
                    mine.append(c)
        if mine:
            kept.append(Group("", tuple(mine), role, raw.get("label") or mine[0], kind, raw.get("assay")))
    merged: list[Group] = []
    for g in kept:
        twin = next((i for i, m in enumerate(merged) if g.role == m.role == "value" and (g.label, g.assay) == (m.label, m.assay)), None)
        if twin is None:
            merged.append(g)
        else:
            merged[twin] = replace(merged[twin], columns=(*merged[twin].columns, *g.columns))
    merged += [Group("", (c,), "unresolved", c) for c in table.names if c not in taken]
    order = {c: i for i, c in enumerate(table.names)}
    merged = [replace(g, columns=tuple(sorted(g.columns, key=order.get))) for g in merged]
    merged.sort(key=lambda g: order[g.columns[0]])
    layout = answer.get("layout") if answer.get("layout") in ("samples_in_columns", "samples_in_rows", "long") else None
    if layout is None:
        rejected.append({"layout": answer.get("layout"), "reason": "no such layout"})
    return Grouping(layout, [replace(g, gid=f"g{i + 1}") for i, g in enumerate(merged)], rejected)


def propose_groups(table: Table, proposer, layout: Layout | None = None, examples: bool = True) -> Grouping:
    layout = layout or propose_layout(table)
    said = checked_size(digest(table, layout, examples))
    answer = proposer.ask(SYSTEM, said, ANSWER)
    return checked(table, answer if isinstance(answer, dict) else json.loads(answer))
