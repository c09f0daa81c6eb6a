"""Reading tables: delimited text, cell by cell as written, and Parquet."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facts

#: Tried in this order when two fit equally; lines looked at; the name of the column with the file order.
DELIMITERS, LINES, ROW = (",", "\t", ";"), 20, "__row"


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first lines suggest; if none is clear, the one most frequent in the first line."""
    lines = [r.value for r in spark.read.text(path).limit(LINES).collect()]
    if lines:
        lines[0] = lines[0].lstrip("﻿")
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        return max(DELIMITERS, key=(lines[0] if lines else "").count)


def numbered(df: DataFrame) -> DataFrame:
    """df with ROW: 0, 1, ... in the order in which Spark reads the files. Each partition counts its own rows; offsets are per partition."""
    marked = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33))
    sizes = marked.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return marked.join(F.broadcast(before), "__part").withColumn(ROW, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")  # a row per partition


@dataclass
class Table:
    """A table of texts with the file order, and facts about each column (asked of Spark once)."""

    data: DataFrame
    path: str
    delimiter: str | None

    def __post_init__(self):
        self.names = [c for c in self.data.columns if c != ROW]
        self._facts: dict | None = None

    @property
    def facts(self) -> dict[str, dict]:
        if self._facts is None:
            cells = facts.melted(self.data, self.names, ROW)
            found = {r["column"]: r.asDict() for r in facts.column_facts(cells).collect()}  # one row per column
            empty = {"kind": "empty", "n_missing": 0, "n_unique": 0, "example": ""}
            self._facts = {c: found.get(c, {"column": c, **empty}) for c in self.names}
        return self._facts

    def summary(self) -> DataFrame:
        rows = [(f["column"], f["kind"], f["n_missing"], f["n_unique"], f["example"]) for f in self.facts.values()]
        return self.data.sparkSession.createDataFrame(rows, "name string, kind string, n_missing long, n_unique long, example string")

    def counts(self) -> dict[str, int]:
        kinds = [f["kind"] for f in self.facts.values()]
        return {k: kinds.count(k) for k in ("numeric", "text", "empty")}

    @property
    def shape(self) -> tuple[int, int]:
        return self.data.count(), len(self.names)

    def describe(self) -> str:
        rows, columns = self.shape
        said = {",": "comma", "\t": "tab", ";": "semicolon"}.get(self.delimiter, str(self.delimiter))
        return f"{rows} rows x {columns} columns, {said}-separated; " + ", ".join(f"{n} {k}" for k, n in self.counts().items())


def _borders(batches, starts: dict | None):
    """Lines (value, file, start of the split, and an ascending id) in the order in which a task reads them, each with where it stands.

    Without starts: a row per split, (file, start, whether its quotes are odd in number, records that begin in it if it begins outside quotes, and
    if inside). With starts, what each split follows, (inside quotes, records before it): (file, record, line, alone, value) for each
    line; a record that is a line by itself is alone. A line begins a record if an even number of quotes stands before it and it isn't blank.
    """
    at, odd, n, line = None, False, [0, 0], 0
    for batch in batches:
        values = batch.column("value")
        odd_lines = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_numpy(zero_copy_only=False).astype(bool)
        blank = pc.match_substring_regex(values, r"^\s*$").to_numpy(zero_copy_only=False)
        files, splits = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        out = []
        for i in range(len(batch)):
            if (files[i], splits[i]) != at:
                if at is not None and starts is None:
                    out.append((*at, odd, *n))
                at, line = (files[i], splits[i]), 0
                odd, n = (False, [0, 0]) if starts is None else (starts[at][0], [starts[at][1]])
            if starts is None:
                n[odd] += not blank[i]
            else:
                begins = not odd and not blank[i]
                n[0] += begins
                if begins or odd:
                    out.append((at[0], n[0] - 1, (at[1] << 32) + line, begins and not odd_lines[i], i))
            odd ^= bool(odd_lines[i])
            line += 1
        if starts is None:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], _SPLIT)
        elif out:
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:4], values.take(columns[4])], _LINE)
    if starts is None and at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, odd, *n)], _SPLIT)


_SPLIT, _LINE = ["file", "start", "odd", "outside", "inside"], ["file", "record", "line", "alone", "value"]


def records(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(file, record, value) of delimited text, quoted line ends and all, and how many records each file has. Files are cut into splits like
    any text, whatever their quotes: each split tells how many quotes and records it has (a row per split), from which follows how every split begins; then
    each line knows its record, and only lines of records that hold line ends are brought together. Quotes are taken in pairs."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"))
    found = lines.mapInArrow(lambda b: _borders(b, None), "file string, start long, odd boolean, outside long, inside long").collect()
    starts, counts, last = {}, {}, None
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        odd, n = (False, 0) if r.file != last else (odd, n)  # noqa: F821 (a file's first split sets them)
        starts[r.file, r.start] = (odd, n)
        odd, n, last = odd ^ r.odd, n + (r.inside if odd else r.outside), r.file
        counts[r.file] = n
    placed = lines.mapInArrow(lambda b: _borders(b, starts), "file string, record long, line long, alone boolean, value string")
    many = placed.where("not alone").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("value"))
    whole = placed.where("alone").select("file", "record", "value").unionByName(many)
    return whole.withColumn("value", F.regexp_replace("value", r"\r\z", "")), counts


def _names(header: str, mark: str) -> list[str]:
    """Column names from a header: unnamed columns are _c and their place, names that repeat take their place as an ending."""
    said = next(csv.reader(io.StringIO(header.lstrip("\ufeff"), newline=""), delimiter=mark), [])
    folded = [x.lower() for x in said]
    return [f"_c{i}" if not x else f"{x}{i}" if folded.count(x.lower()) > 1 else x for i, x in enumerate(said)]


def read(spark: SparkSession, path: str, delimiter: str | None = None) -> Table:
    """A CSV, TSV or semicolon file, every cell a text as written ("" where empty); or a Parquet folder, cells cast to text. A large file is read by many
    tasks, also where quoted cells hold line ends. Of several files, each with a header, rows follow each other in the order of names."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return Table(numbered(df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))), path, None)
    mark = delimiter or detect_delimiter(spark, path)
    rows, counts = records(spark, path)
    if not counts or not any(counts.values()):
        return Table(spark.createDataFrame([], f"{ROW} long"), path, mark)
    before, n = {}, 0
    for file in sorted(counts):
        before[file], n = n - 1, n + max(0, counts[file] - 1)
    first = next(f for f in sorted(counts) if counts[f])
    names = _names(rows.where((F.col("file") == first) & (F.col("record") == 0)).first()["value"], mark)
    how = {"sep": mark, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": "", "maxColumns": str(len(names) + 1)}
    cells = rows.where("record > 0").select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), how).alias("c"), "file", "record")
    offset = spark.createDataFrame(list(before.items()), "file string, before long")  # a row per file
    placed = cells.join(F.broadcast(offset), "file")
    return Table(placed.select(*(F.coalesce(F.col(f"c.c{i}"), F.lit("")).alias(c) for i, c in enumerate(names)), (F.col("before") + F.col("record")).alias(ROW)), path, mark)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, of any size, from any file system that Spark reads: the stream passes through the digest in pieces of 1 MiB."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(where.getFileSystem(conf).open(where), sink, 1 << 20, True)
    return bytes(digest.digest()).hex()
