"""The filter audit against one document at a time, in every order."""

import itertools
import re

import pytest

from assayloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask string, n int"


def fails(text, doc, table):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    out["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in table)
    return {k for k, v in out.items() if v}


def brute(table, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(d, s or "", fails(t or "", d, table)) for d, t, s, *_ in table]
    out = {}
    for part in {p for _, p, _ in rows}:
        own = [(d, f) for d, p, f in rows if p == part]
        removed_ever = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_ever[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(removed_ever[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"word{i}" for i in range(80))
TABLE = [
    (1, LONG, "a"), (2, LONG, "b"), (3, "a b c", "a"), (4, "a b c", None), (5, None, "a"), (6, "", ""), (None, LONG, "a"), (None, "x # y", "b"),
    (7, LONG + " #", "a"), (8, " ".join(["same"] * 60), "b"), (9, "SHOUT " * 70, "a"), (2, LONG, "b"), (2, LONG, "a"), (1, LONG, "a"), (10, "é" * 50_000 + " |", "a"),
    (-4, "a b c", "b"), (11, " ".join(f"w{i}" for i in range(60)), "a"), (12, LONG.upper(), "c"), (13, "w\x0b" * 49 + "w", "c"), (14, "a b c", "c"), (15, LONG + " more", "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (None, 1, 1), (9, None, 1), (99, 1, 1), (14, 1, 0)]


def report(spark, table, labels, parts=3):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in table], SCHEMA).repartition(parts)
    rows = filter_audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("parts", [1, 4])
def test_against_brute_force(spark, parts):
    assert report(spark, TABLE, LABELS, parts) == brute(TABLE, LABELS)


def test_one_task_sends_a_large_group_once(monkeypatch):
    rows = [(i, "s", "copy " * 60) for i in range(500, 0, -1)]
    sent = list(filter_audit._local(filter_audit.text_mask)(rows))
    assert sum(r[1][0] is not None for r in sent) == 1 and len(sent) == 500
    monkeypatch.setattr(filter_audit, "HOLD_BYTES", 900)  # held texts go out early: the same decisions
    rows = [(i % 7 + 1, "s", f"text {i % 5} " * 10) for i in range(70)]
    early = sorted((r for r in filter_audit._local(filter_audit.text_mask)(rows) if r[1][0] is not None), key=lambda r: r[0])
    monkeypatch.undo()
    late = sorted((r for r in filter_audit._local(filter_audit.text_mask)(rows) if r[1][0] is not None), key=lambda r: r[0])
    kept = lambda records: {(d, p) for d, p, m, _ in filter_audit._chains(records) if not m & filter_audit.COPY}
    assert len(early) > len(late) and kept(early) == kept(late)


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    class Same:
        @staticmethod
        def xxh3_64_intdigest(raw):
            return 7

    monkeypatch.setattr(filter_audit, "xxhash", Same)
    records = list(filter_audit._local(filter_audit.text_mask)([(3, "s", "b"), (1, "s", "a")])) + list(filter_audit._local(filter_audit.text_mask)([(5, "s", "a")]))
    assert [(d, bool(m & filter_audit.COPY)) for d, _, m, _ in filter_audit._chains(sorted(records, key=lambda r: r[0]))] == [(1, False), (3, False), (5, True)]


def test_copies_and_empty_tables(spark):
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in TABLE], SCHEMA)
    assert sorted(r.id for r in filter_audit.copies(docs).collect()) == sorted({d for d, t, _ in TABLE if "E" in fails(t or "", d, TABLE)})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(docs.limit(0), none).count() == 0
    assert report(spark, TABLE[:4], []) == brute(TABLE[:4], [])
