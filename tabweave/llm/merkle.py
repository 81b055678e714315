"""Merkle manifest: a tree of digests per group of rows, and a tree over their roots.

Trees are kept as pages.  A page is what lies below one node, ``PAGE_FEET``
nodes wide at most, as records from a digest to its children, and is found by
the digest of its top.  Its content alone fixes that digest, so equal pages are
stored once.

Proofs are found from the top.  Requests descend page by page and, inside a
page, child by child along the digits of the leaf's rank; the children that are
not taken are the proof.  The way down to a page is found once for all leaves
below it.  Segments come highest first and are reversed at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.core.scan import attach_measured, row_numbers
from tabweave.llm.text import batch, map_batches
from tabweave.session import cut_lineage

FAN_OUT = 2
PAGE_FEET = 256  # nodes at the foot of a page, at most

_STEP = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])
_STEPS_SQL = "array<struct<place:int, others:array<string>>>"
_RECORDS = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))
_PAGE = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()),
                   ("records", _RECORDS)])
_PAGE_SQL = "tree long, size long, rank long, digest string, records array<struct<digest:string, children:array<string>>>"
_WAY = pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("rank", pa.int64()), ("digest", pa.string()),
                  ("subroot", pa.string()), ("way", pa.list_(_STEP))])
_WAY_SQL = f"tree long, size long, rank long, digest string, subroot string, way {_STEPS_SQL}"
_PROOF = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof", pa.list_(_STEP)),
                    ("folded_root", pa.string())])
_PROOF_SQL = f"id long, leaf string, subroot string, proof {_STEPS_SQL}, folded_root string"


def node(children: list[str]) -> str:
    """The digest of a node: sha256 of its children's digests as hex text."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values in a row, each as its UTF-8 byte count, ``:`` and itself; a null is ``-``."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)).cast("binary"), 256)


def height(n: int, fan_out: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_out), levels + 1
    return levels


def page_height(fan_out: int) -> int:
    """Levels of a page, one at least."""
    levels = 1
    while fan_out ** (levels + 1) <= PAGE_FEET:
        levels += 1
    return levels


def raise_nodes(digests: list[str], levels: int, fan_out: int) -> tuple[str, list[dict]]:
    """The node ``levels`` above the digests, and the records of all nodes on the way."""
    records = []
    for _ in range(levels):
        runs = [digests[at:at + fan_out] for at in range(0, len(digests), fan_out)]
        digests = [node(run) for run in runs]
        records += [{"digest": d, "children": run} for d, run in zip(digests, runs)]
    return digests[0], records


def descend(top: str, children: dict[str, list[str]], levels: int) -> list[tuple[str, list[dict]]]:
    """Every node ``levels`` below a page's top, by rank: its digest and its way, highest step first.

    Requests below one node go on together; a rank's digit is the ``place`` of
    the child that it takes, and ``others`` are the children that it leaves.
    """
    reached = [(top, [])]
    for _ in range(levels):
        reached = [(child, [*way, {"place": place, "others": run[:place] + run[place + 1:]}])
                   for digest, way in reached for run in [children[digest]] for place, child in enumerate(run)]
    return reached


def fold(leaf: str, proof: list[dict]) -> str:
    """The root that a leaf and its proof, lowest step first, lead to."""
    for step in proof:
        leaf = node([*step["others"][:step["place"]], leaf, *step["others"][step["place"]:]])
    return leaf


@dataclass(frozen=True)
class Forest:
    """Trees over ranked leaves.

    ``pages``, lowest level first, hold per page ``tree, size`` (leaves of the
    tree), ``rank`` (of the page in its level), ``digest`` and ``records``.
    ``roots``: ``tree, size, digest``.
    """

    pages: list[DataFrame]
    roots: DataFrame
    fan_out: int


def plant(leaves: DataFrame, fan_out: int = FAN_OUT) -> Forest:
    """The trees over ``tree, size, rank, digest``, with ranks from 0 to ``size`` - 1 in each tree.

    While several nodes remain, every ``fan_out`` consecutive ones (the last
    run: fewer, even one) become the node above; a lone leaf is its own root.
    No rows, no trees.
    """
    if fan_out < 2:
        raise ValueError("fan_out must be 2 or more")
    step = page_height(fan_out)
    largest = leaves.agg(F.max("size")).first()[0] or 0
    now, pages = leaves.select("tree", "size", "rank", "digest"), []
    roots = now.where("size = 1")
    for k in range(-(-height(largest, fan_out) // step)):
        def build(batches: Iterator[pa.RecordBatch], below: int = k * step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    levels = min(step, height(r["size"], fan_out) - below)
                    top, records = raise_nodes([x["digest"] for x in r["nodes"]], levels, fan_out)
                    yield batch(_PAGE, [r["tree"]], [r["size"]], [r["rank"]], [top], [records])

        # the nodes of one page
        runs = now.where(F.col("size") > fan_out ** (k * step)).groupBy(
            "tree", "size", F.expr(f"rank div {fan_out ** step}").alias("page")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        pages.append(cut_lineage(map_batches(runs.withColumnRenamed("page", "rank"), build, _PAGE_SQL)))
        now = pages[-1].select("tree", "size", "rank", "digest")
        roots = roots.union(now.where(F.col("size").between(fan_out ** (k * step) + 1, fan_out ** ((k + 1) * step))))
    return Forest(pages, roots.select("tree", "size", "digest"), fan_out)


def prove(forest: Forest, requests: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``id, leaf, subroot, proof, folded_root`` for requests ``tree, size, rank, id, claimed``, one per leaf.

    ``proof`` leads from the leaf to the tree's root and on along ``tops``
    (``tree, way``, highest step first).  ``folded_root`` is what the claimed
    digest, or the stored leaf where it is null, leads to by that proof.
    """
    fan_out, step = forest.fan_out, page_height(forest.fan_out)
    feet = fan_out ** step
    start = forest.roots
    start = (start.withColumn("way", F.expr(f"cast(array() as {_STEPS_SQL})")) if tops is None
             else attach_measured(start, tops, ["tree"])).select(
        "tree", "size", F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("subroot"), "way")

    def below_page(r: dict, below: int) -> list[tuple[int, str, list[dict]]]:
        children = {x["digest"]: x["children"] for x in r["records"]}
        found = descend(r["digest"], children, min(step, height(r["size"], fan_out) - below))
        return [(r["rank"] * feet + i, digest, r["way"] + way) for i, (digest, way) in enumerate(found)]

    def with_records(ways: DataFrame, k: int) -> DataFrame:
        """Look the pages up by digest; equal pages are one record."""
        stored = forest.pages[k].groupBy("digest").agg(F.first("records").alias("records"))
        return ways.join(stored, "digest").select("tree", "size", "rank", "digest", "subroot", "way", "records")

    ways = start.where("false")
    for k in reversed(range(len(forest.pages))):
        # trees that end on this level of pages join here
        ways = ways.union(start.where(F.col("size").between(fan_out ** (k * step) + 1, fan_out ** ((k + 1) * step))))
        if k:
            def open_page(batches: Iterator[pa.RecordBatch], below: int = k * step) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(b.num_rows):
                        r = b.slice(i, 1).to_pylist()[0]
                        rank, digest, way = (list(x) for x in zip(*below_page(r, below)))
                        n = len(rank)
                        yield batch(_WAY, [r["tree"]] * n, [r["size"]] * n, rank, digest, [r["subroot"]] * n, way)

            ways = cut_lineage(map_batches(with_records(ways, k), open_page, _WAY_SQL))
    lone = start.where("size = 1").withColumn("records", F.expr("cast(null as array<struct<digest:string, children:array<string>>>)"))
    opened = with_records(ways, 0).union(lone) if forest.pages else lone
    # the requests of one page, at most one a leaf
    asked = requests.groupBy("tree", F.expr(f"rank div {feet}").alias("rank")).agg(
        F.collect_list(F.struct("rank", "id", "claimed")).alias("asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                reached = {0: (r["digest"], r["way"])} if r["records"] is None else {
                    rank: (digest, way) for rank, digest, way in below_page(r, 0)}
                out = []
                for x in r["asked"]:
                    leaf, way = reached[x["rank"]]
                    proof = way[::-1]
                    out.append((x["id"], leaf, r["subroot"], proof, fold(x["claimed"] or leaf, proof)))
                yield batch(_PROOF, *map(list, zip(*out)))

    return map_batches(opened.join(asked, ["tree", "rank"]), answer, _PROOF_SQL)


@dataclass(frozen=True)
class Manifest:
    """``rows``: ``tree, size, rank, id, digest, claimed`` per row; a tree per group; a tree over their roots."""

    rows: DataFrame
    groups: Forest
    top: Forest

    @property
    def root(self) -> str | None:
        """The digest over everything; null without rows."""
        row = self.top.roots.first()
        return row and row["digest"]


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None, group: str = "lang", key: str = "doc_id",
             fan_out: int = FAN_OUT) -> Manifest:
    """The manifest of a table.

    Rows of a group are leaves in ascending order of ``key``, null first, equal
    keys by digest; the groups' roots, null first, then by the UTF-8 bytes of
    ``group``, are the leaves of the top tree.  Null values, empty and long
    texts and repeated rows are leaves like others, a null ``claimed`` claims
    the row's own digest, and further columns are not read unless ``leaf`` does.
    Only digests leave the rows' tasks, so a text's length costs its hash alone.
    """
    named = docs.select(c(group).alias("grp"), c(key).cast("long").alias("id"), leaf.alias("digest"),
                        (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.col("claimed")]
    numbered = cut_lineage(row_numbers(named, order, "number"))
    groups = row_numbers(numbered.groupBy("grp").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size")),
                         [F.col("grp").asc_nulls_first()], "tree")
    rows = attach_measured(numbered, groups, ["grp"]).select(
        "tree", "size", (F.col("number") - F.col("first")).alias("rank"), "id", "digest", "claimed")
    forest = plant(rows, fan_out)
    roots = cut_lineage(forest.roots)
    total = roots.agg(F.count(F.lit(1)).alias("size"))
    # one row
    top = plant(roots.crossJoin(F.broadcast(total.select(F.col("size").alias("trees")))).select(
        F.lit(0).cast("long").alias("tree"), F.col("trees").alias("size"), F.col("tree").alias("rank"), "digest"), fan_out)
    return Manifest(rows, Forest(forest.pages, roots, fan_out), top)


def row_proofs(made: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded_root, verified`` of every row of a manifest."""
    trees = made.groups.roots.count()
    of_roots = prove(made.top, made.groups.roots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.col("tree").alias("rank"),
        F.col("tree").alias("id"), F.lit(None).cast("string").alias("claimed")))
    tops = of_roots.select(F.col("id").alias("tree"), F.reverse("proof").alias("way"))
    root = F.lit(made.root).cast("string")
    return prove(made.groups, made.rows.select("tree", "size", "rank", "id", "claimed"), tops).select(
        "id", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def documents_manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of a documents table over ``doc_id, source, lang, n_chars, text``; rows where
    ``tampered`` holds claim a digest whose ``n_chars``, unless null, is one more."""
    values = [c("doc_id"), c("source"), c("lang"), c("n_chars"), c("text")]
    more = [*values[:3], c("n_chars").cast("decimal(38,0)") + 1, values[4]]
    return manifest(docs, leaf_digest(*values), None if tampered is None else F.when(tampered, leaf_digest(*more)))
