"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabweave.llm import merkle
from tabweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, text, lang, source, n):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)))


def levels(digests, k):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + k])) for i in range(0, len(out[-1]), k)])
    return out


def siblings(tree, rank, k):
    """Per level the place in the run and the others of the run."""
    out = []
    for row in tree[:-1]:
        at = rank - rank % k
        run = row[at:at + k]
        out.append((rank - at, run[:rank - at] + run[rank - at + 1:]))
        rank //= k
    return out


def plain(rows, k=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels([x[2] for x in groups[g]], k)
    top = levels([trees[g][-1][0] for g in order], k)
    out = []
    for i, g in enumerate(order):
        for rank, (_, _, digest, r) in enumerate(groups[g]):
            proof = siblings(trees[g], rank, k) + siblings(top, i, k)
            doc, text, lang, source, n = r[:5]
            now = digest
            if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None:
                now = leaf(doc, text, lang, source, n + 1)
            for place, others in proof:
                now = sha("".join([*others[:place], now, *others[place:]]))
            out.append((doc, digest, trees[g][-1][0], top[-1][0], sha("".join(d for _, o in proof for d in o)), now,
                        now == top[-1][0]))
    return sorted(out, key=str)


def rows_of(spark, rows, k=2, parts=3):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 0
    values = [F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*values[:3], F.col("n_chars") + 1, values[4]]
    made = merkle.manifest(docs, merkle.leaf_digest(*values), F.when(tampered, merkle.leaf_digest(*more)), fan_out=k)
    got = merkle.row_proofs(made).collect()
    return sorted([(r.id, r.leaf, r.subroot, r.root, sha("".join(d for s in r.proof for d in s.others)), r.folded_root,
                    r.verified) for r in got], key=str)


@pytest.fixture
def odd():
    rows = [(i, f"text {i} é" * (i % 4), ["en", "de", None, "é", "z"][i % 5 if i % 3 else 0], f"s{i % 3}", i) for i in range(150)]
    rows += [(None, None, None, None, None)] * 2 + [(500, "same", "en", "a", 4)] * 90
    rows += [(7, "", "en", None, None), (501, "x" * 300_000, "lone", "", 2), (-3, "n", "en", "q", None)]
    return rows


@pytest.mark.parametrize("k,feet", [(2, 8), (3, 9), (2, 256), (5, 4)])
def test_against_plain_tree(spark, odd, monkeypatch, k, feet):
    monkeypatch.setattr(merkle, "PAGE_FEET", feet)
    got = rows_of(spark, odd, k)
    assert got == plain(odd, k)
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9])
def test_small_trees(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "PAGE_FEET", 4)
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    assert rows_of(spark, rows) == plain(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, folder).collect()), key=str)
    assert got == plain([tuple(r) for r in docs])
