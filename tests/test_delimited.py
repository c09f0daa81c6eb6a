"""Delimited files read by many tasks, and digests of large files."""

import csv
import hashlib
import random

import pytest

from assayloom.sources import delimited


def write(path, rows, end="\r\n", mark=",", bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        csv.writer(f, delimiter=mark, lineterminator=end).writerows(rows)
    return str(path)


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "997")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(table):
    return [tuple(r)[:-1] for r in table.data.orderBy(delimited.ROW).select(*table.names, delimited.ROW).collect()]


@pytest.mark.parametrize("end, mark, seed", [("\n", ",", 1), ("\r\n", ";", 2), ("\n", "\t", 3)])
def test_many_tasks_read_what_one_reads(spark, tmp_path, small_splits, end, mark, seed):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "1.5", "NA", "plain text", 'said "so", twice', "two\nlines", "a\n\nb\n", "x" * rng.randint(0, 2500), " é \r\n ü ", "a,b;c\td", '"', '""\n""'])
    rows = [["ID", "one", "two"], *([f"r{i}", cell(), cell()] for i in range(400))]
    path = write(tmp_path / "t.csv", rows, end, mark)
    t = delimited.read(spark, path, mark)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 50
    assert t.names == rows[0] and rows_of(t) == [tuple(r) for r in rows[1:]]
    assert [r[delimited.ROW] for r in t.data.orderBy(delimited.ROW).collect()] == list(range(400))


def test_headers_blank_lines_and_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", [["ID", "", "x", "X"], ["1", "2", "3", "4"], [], ["5", "6"]], bom=True)
    write(folder / "b.csv", [["ID", "", "x", "X"], ["7", "8\n9", "10", "11", "12"]])
    t = delimited.read(spark, str(folder), ",")
    assert t.names == ["ID", "_c1", "x2", "X3"]
    assert rows_of(t) == [("1", "2", "3", "4"), ("5", "6", "", ""), ("7", "8\n9", "10", "11")]
    (tmp_path / "none.csv").write_text("")
    assert delimited.read(spark, str(tmp_path / "none.csv"), ",").data.count() == 0
    assert delimited.read(spark, write(tmp_path / "head.csv", [["ID", "a"]]), ",").shape == (0, 2)
    (tmp_path / "open.csv").write_text('ID,a\n1,"never closed\n2,x\n')
    assert delimited.read(spark, str(tmp_path / "open.csv"), ",").data.count() == 1


def test_digest_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.write(b"head")
        f.truncate(2_300_000_000)
        f.seek(0, 2)
        f.write(b"tail")
    with open(path, "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert delimited.file_digest(spark, str(path)) == want
