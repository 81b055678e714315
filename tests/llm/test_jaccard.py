"""The similarity join and components against comparing everything."""

import random

import pytest

from tabweave.llm import jaccard
from tabweave.llm.components import components


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> class, links, group."""
    classes = {}
    for doc, text in rows:
        classes.setdefault(" ".join((text or "").lower().split()), []).append(doc)
    names = {k: min(x for x in v if x is not None) for k, v in classes.items()}
    sets = {k: grams(k) for k in classes}
    keys = list(classes)
    links = {k: [j for j in keys if j != k and sets[k] and sets[j]
                 and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])] for k in keys}
    group = {}
    for k in keys:
        todo, seen = [k], {k}
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        group[k] = min(names[j] for j in seen)
    return {d: (names[k], len(links[k]), group[k]) for k, v in classes.items() for d in v}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([60, 120, 200]))]
        for _ in range(r.choice([1, 3, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["", None, " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    r.shuffle(out)
    return list(enumerate(out))


def test_bands():
    bands, rows = jaccard.bands_for(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL and bands * rows <= jaccard.MOST_HASHES


@pytest.mark.parametrize("block", [256, 4])
def test_join(spark, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_links int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard.similar_texts(docs).collect()}
    assert got == brute(rows)


def test_keep_one(spark, rows):
    more = [*rows, (rows[0][0], rows[0][1]), (None, "a b c d e"), (None, "quite alone in here now"), (None, None)]
    docs = spark.createDataFrame([(t, d, 1) for d, t in more], "text string, doc_id long, crc int")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    want = brute(rows)
    by_id = dict(rows)
    kept = sorted((r.doc_id for r in out.collect() if r.doc_id is not None))
    wordless = {d for d, t in rows if not (t or "").split()}
    assert kept == sorted({w[2] for d, w in want.items() if d not in wordless} | wordless)
    assert sorted(r.text or "" for r in out.collect() if r.doc_id is None) == ["", "quite alone in here now"]
    assert by_id and jaccard.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500), (None, 3)]
    edges += [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(180)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
