"""Which columns are ids, measurements and annotations: proposed from column facts, corrected by the user."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cells
from ..sources.delimited import ROW, Table

ORIENTATIONS = ("samples_in_columns", "samples_in_rows", "long")
#: Whole-number columns with so few levels are codes, not measurements; more numeric columns than this times the rows mean samples in rows.
CODE_LEVELS, WIDE = 5, 2


@dataclass(frozen=True)
class Layout:
    table: Table = field(repr=False)
    orientation: str
    id_column: str | None
    measurements: tuple[str, ...]
    annotations: tuple[str, ...]
    reasons: tuple[str, ...] = ()

    def set(self, orientation: str | None = None, id_column: str | None = None, measurements=None, annotations=None) -> Layout:
        """The layout with corrections. Columns named as annotations or id stop being measurements."""
        names = set(self.table.names)
        for c in [*(measurements or []), *(annotations or []), *([id_column] if id_column else [])]:
            if c not in names:
                raise ValueError(f"no column {c!r}")
        if orientation and orientation not in ORIENTATIONS:
            raise ValueError(f"orientation: one of {ORIENTATIONS}")
        key = id_column or self.id_column
        notes = tuple(annotations) if annotations is not None else self.annotations
        values = tuple(measurements) if measurements is not None else self.measurements
        values = tuple(c for c in values if c != key and not (annotations is not None and c in notes))
        left = tuple(c for c in self.table.names if c != key and c not in values)
        return replace(self, orientation=orientation or self.orientation, id_column=key, measurements=values, annotations=left, reasons=(*self.reasons, "set by the user"))

    def roles(self) -> dict[str, str]:
        return {c: "id" if c == self.id_column else "measurement" if c in self.measurements else "annotation" for c in self.table.names}

    def cells(self, block: str = "A1B1") -> DataFrame:
        """The measurements as long cells; row numbers stand for ids where there is no id column."""
        data, key = self.table.data, self.id_column
        if key is None:
            key, data = "__id", data.withColumn("__id", (F.col(ROW) + 1).cast("string"))
        if self.orientation == "samples_in_rows":
            return cells.from_samples_in_rows(data, key, list(self.measurements), ROW, block)
        return cells.from_samples_in_columns(data, key, {c: c for c in self.measurements}, ROW, block)

    def describe(self) -> str:
        return f"{self.orientation}; id column {self.id_column or 'none (row numbers)'}; {len(self.measurements)} measurements, {len(self.annotations)} annotations"


def whole_numbers(table: Table, columns: list[str]) -> dict[str, bool]:
    """Whether all present values of each column are whole: one pass over the columns asked."""
    if not columns:
        return {}
    v = lambda c: S.number(F.col(f"`{c}`"))
    row = table.data.agg(*(F.coalesce(F.every(v(c).isNull() | (v(c) == F.floor(v(c)))), F.lit(True)).alias(str(i)) for i, c in enumerate(columns))).first()
    return {c: row[str(i)] for i, c in enumerate(columns)}


def pick_id(table: Table) -> tuple[str | None, str]:
    """The first text column without gaps or repeats; a numeric one only if it is the table's first and whole."""
    rows = table.data.count()
    unique = [c for c, f in table.facts.items() if f["n_missing"] == 0 and f["n_unique"] == rows and rows]
    for c in unique:
        if table.facts[c]["kind"] == "text":
            return c, f"{c!r}: the first text column that is complete and unique"
    if unique and unique[0] == table.names[0] and whole_numbers(table, unique[:1])[unique[0]]:
        return unique[0], f"{unique[0]!r}: the first column, of unique whole numbers"
    return None, "no complete and unique column: rows are numbered"


def propose_layout(table: Table) -> Layout:
    key, why = pick_id(table)
    numeric = [c for c, f in table.facts.items() if f["kind"] == "numeric" and c != key]
    rows = table.data.count()
    in_rows = len(numeric) > WIDE * rows
    reasons = [why, f"{len(numeric)} numeric columns and {rows} rows: samples in {'rows' if in_rows else 'columns'}"]
    few = [c for c in numeric if table.facts[c]["n_unique"] <= CODE_LEVELS] if in_rows else []
    codes = [c for c, whole in whole_numbers(table, few).items() if whole]
    if codes:
        reasons.append(f"codes, not measurements: {', '.join(codes[:5])}")
    values = tuple(c for c in numeric if c not in codes)
    return Layout(table, "samples_in_rows" if in_rows else "samples_in_columns", key, values, tuple(c for c in table.names if c != key and c not in values), tuple(reasons))
