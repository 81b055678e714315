"""Decontamination against a search for every window."""

import random
import re

import pytest

from tabweave.llm import decontaminate as d
from tabweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    windows = []
    for name, text in items:
        w = words(text)
        if 0 < len(w) < window:
            windows.append((name, w))
        windows += [(name, w[i:i + window]) for i in range(len(w) - window + 1)]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for name, win in windows:
            for i in at.get(win[0], ()):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(name)
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def collected(df):
    return [(r.doc_id, r.n_words, sum(b - a + 1 for a, b in r.spans), r["items"]) for r in df.collect()]


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_against_search(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(d, "GROUP_BYTES", group_bytes)
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("a b c é D".split()) for _ in range(n))
    items = [(i, text(r.choice([0, 2, 3, 4, 9]))) for i in range(12)] + [(3, "a b! c"), (None, "é é d"), (77, None)]
    docs = [(i, text(r.choice([0, 1, 5, 40, 200]))) for i in range(40)] + [(7, None), (None, "x"), (9, "a,B-c"), (9, "a,B-c")]
    left = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, spans int")
    right = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, items int")
    key = lambda row: (row[0] is None, row[0] or 0, row)
    assert sorted(collected(d.match_items(left, right, 4)), key=key) == sorted(brute(docs, items, 4), key=key)
    assert all(x[2] == 0 for x in collected(d.match_items(left, right.limit(0), 4)))
    assert d.match_items(left.limit(0), right, 4).count() == 0


def test_removal(spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Lead words here and one, TWO three\nfour. The tail is long", 9, "x"), (2, "one two three four", 18, None),
        (3, None, None, "x"), (4, "", 0, "y"), (5, "clean text", 10, "z"), (5, "clean text", 10, "z")],
        "doc_id long, text string, n_chars long, _spans string")
    out = d.remove_items(docs, items, 4)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, "Lead words here and . The tail is long", 38, "x"), (3, None, None, "x"), (4, "", 0, "y"),
        (5, "clean text", 10, "z"), (5, "clean text", 10, "z")], key=str)
    assert d.remove_items(docs.limit(0), items).count() == 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(x[0], x[1], x[2], len(x[3]), x[2] > 0) for x in brute(docs, items, 10)}
    got = QUERIES["op1_decontamination"](spark, FOLDER).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == want
    assert any(r.contaminated for r in got)
