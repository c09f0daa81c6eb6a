"""Data states: immutable, named by their content, replayable. A state is a folder of Parquet cells and one row of metadata."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits that count for a state's name: sums may differ in their last bits from run to run, so states that differ beyond share a name.
DIGITS = 12


def canonical(x) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)


def content_hash(cells: DataFrame) -> dict[str, str]:
    """A hash per block over feature, sample and value, whatever the order and partitions of the rows: each row is hashed, and the
    rows' hashes are added up as four integers (so the sums combine before the shuffle)."""
    value = F.coalesce(F.format_string(f"%.{DIGITS - 1}e", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))), F.lit("missing"))
    row = F.sha2(F.to_json(F.struct("feature", "sample", value.alias("value"))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias(str(i)) for i in range(4)]
    rows = cells.groupBy("block").agg(F.count("*").cast("string").alias("n"), *parts).collect()  # a row per block
    return {r["block"]: hashlib.sha256(canonical(r.asDict()).encode()).hexdigest() for r in sorted(rows, key=lambda r: r["block"])}


def state_id(parent: str | None, op: dict | None, hashes: dict[str, str]) -> str:
    """Names a state by its parent, what was done (not by whom or when) and its content."""
    done = {k: op.get(k) for k in ("op", "step", "params", "seed", "entry", "blocks")} if op else None
    return hashlib.sha256(canonical({"parent": parent, "op": done, "matrices": hashes}).encode()).hexdigest()


class StateError(RuntimeError):
    pass


@dataclass(frozen=True)
class Draft:
    store: StateStore
    path: str
    cells: DataFrame

    def discard(self) -> None:
        where = self.store.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.store.spark._jsc.hadoopConfiguration()).delete(where, True)


class StateStore:
    """States under a folder that all executors can reach. Cells are written first and metadata last, so a folder without metadata is no state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.states, self.head = spark, folder.rstrip("/"), {}, None

    def _path(self, sid: str) -> str:
        return f"{self.folder}/{sid}"

    def draft(self, cells: DataFrame) -> Draft:
        """cells written beside the states, named by their content, but not yet a state."""
        path = f"{self.folder}/_draft-{uuid.uuid4().hex}"
        cells.select("block", "feature", "sample", "value").write.partitionBy("block").parquet(path)
        return Draft(self, path, self._read(path))

    def keep(self, draft: Draft, parent: str | None = None, op: dict | None = None, scales: dict[str, str] | None = None, move_head: bool = True) -> str:
        """Makes a draft a state. The very same state again is verified, not rewritten. Metadata is written last."""
        if parent is not None and parent not in self.states:
            raise StateError(f"no state {parent}")
        hashes = content_hash(draft.cells)
        sid = state_id(parent, op, hashes)
        scales = {b: (scales or {}).get(b, "unknown") for b in hashes}
        path, p = self._path(sid), self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(p(f"{path}/meta")):
            if content_hash(self._cells(sid)) != hashes:
                raise StateError(f"state {sid} on disk is not what it says")
            draft.discard()
        else:
            fs.mkdirs(p(path))
            fs.rename(p(draft.path), p(f"{path}/cells"))
            meta = {"state_id": sid, "parent": parent, "op": op, "scales": scales, "hashes": hashes, "at": datetime.now(UTC).isoformat()}
            self.spark.createDataFrame([(canonical(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self.states[sid] = {"state_id": sid, "parent": parent, "op": op, "scales": scales, "hashes": hashes}
        if move_head:
            self.head = sid
        return sid

    def add(self, cells: DataFrame, parent: str | None = None, op: dict | None = None, scales: dict[str, str] | None = None, move_head: bool = True) -> str:
        return self.keep(self.draft(cells), parent, op, scales, move_head)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("feature string, sample string, value double, block string").parquet(path)

    def _cells(self, sid: str) -> DataFrame:
        return self._read(f"{self._path(sid)}/cells")

    def data(self, sid: str | None = None) -> DataFrame:
        return self._cells(sid or self.head)

    def meta(self, sid: str | None = None) -> dict:
        return self.states[sid or self.head]

    def chain(self, sid: str | None = None) -> list[dict]:
        """The states from the root to sid."""
        out, at = [], sid or self.head
        while at is not None:
            out.append(self.states[at])
            at = self.states[at]["parent"]
        return out[::-1]

    def load(self) -> StateStore:
        """Reads the metadata of the states in the folder."""
        for r in self.spark.read.text(f"{self.folder}/*/meta").collect():  # a row per state
            m = json.loads(r.value)
            self.states[m["state_id"]] = {k: m[k] for k in ("state_id", "parent", "op", "scales", "hashes")}
        parents = {s["parent"] for s in self.states.values()}
        self.head = next((s for s in self.states if s not in parents), None)
        return self

    def table(self) -> DataFrame:
        rows = [(s["state_id"], s["parent"], (s["op"] or {}).get("op"), (s["op"] or {}).get("step"), canonical((s["op"] or {}).get("params")), s["scales"]) for s in self.states.values()]
        return self.spark.createDataFrame(rows, "state_id string, parent string, op string, step string, params string, scales map<string,string>")
