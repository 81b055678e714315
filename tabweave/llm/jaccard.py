"""All pairs of texts whose sets of word n-grams are similar: a MinHash join.

Copies (texts of the same words) are one class, and only classes are compared.
Band hashes of MinHash signatures bring candidates together: in each bucket all
members point at the smallest, so a bucket of any size gives one edge a member.
Connected candidates are then compared on their full n-gram sets, every
pair once, in blocks of bounded size.  Links leave the tasks as counts and
spanning edges, never as all pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.components import components
from tabweave.llm.text import batch, map_batches, space_words, text_hashes, utf8
from tabweave.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 144
# classes of one block of a large candidate group, and classes that share a task's call
BLOCK = 256
BIN = 128
_SEED = 20_240_601
_MIX = np.uint64(0x9E3779B97F4A7C15)

_SIGNED = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])
_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def bands_for(similarity: float, recall: float = RECALL, hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most selective bands that still find a pair of this
    similarity with the wanted probability, within a number of hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-p)))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = self[word] = xxh64_intdigest(word)
        return value


_KNOWN = _Words()


def shingles(texts: list[list[bytes]], n: int = WORDS) -> list[np.ndarray]:
    """The hashed n-grams of each text, repeats included; a text of fewer words,
    but not none, is one n-gram."""
    if len(_KNOWN) > 1_000_000:
        _KNOWN.clear()
    flat = np.fromiter((h for words in texts for h in map(_KNOWN.__getitem__, words)), np.uint64)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    joint = np.zeros(max(len(flat) - n + 1, 0), np.uint64)
    for k, f in enumerate(factors):
        joint += flat[k:len(flat) - n + 1 + k] * f if len(joint) else joint
    joint ^= joint >> np.uint64(29)
    joint *= _MIX
    joint ^= joint >> np.uint64(32)
    out, at = [], 0
    for words in texts:
        size = len(words)
        if size >= n:
            out.append(joint[at:at + size - n + 1])
        elif size:
            out.append(np.array([zlib.crc32(b" ".join(words)) * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


class Signer:
    """Band hashes of a batch of n-gram lists."""

    def __init__(self, bands: int, rows: int):
        r = np.random.default_rng(_SEED)
        self.bands, self.rows = bands, rows
        self.a = r.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, np.uint64)

    def sign(self, lists: list[np.ndarray]) -> np.ndarray:
        """A row a list, a column a band; lists must not be empty."""
        starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
        flat = np.concatenate(lists)
        out = np.zeros((len(lists), self.bands), np.uint64)
        for k in range(self.bands * self.rows):
            least = np.minimum.reduceat(flat * self.a[k] + self.b[k], starts)
            band = out[:, k // self.rows]
            band ^= least + _MIX + (band << np.uint64(6)) + (band >> np.uint64(2))
        # a bucket belongs to one band
        out = (out ^ (out >> np.uint64(31))) * _MIX + np.arange(self.bands, dtype=np.uint64)
        return out.view(np.int64)


def signatures(docs: DataFrame, id_column: str, text_column: str, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, crc, node, bands`` of each row: the text's checksum, the hash of
    its words (the class) and its band hashes (none for a text without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        signer = Signer(bands, rows)
        for b in batches:
            data = utf8(b.column(1))
            texts = [space_words(d) for d in data]
            lists = shingles(texts, n)
            held = [i for i, x in enumerate(lists) if len(x)]
            signed = [[] for _ in lists]
            if held:
                for i, row in zip(held, signer.sign([lists[i] for i in held])):
                    signed[i] = row
            nodes = np.array([xxh3_64_intdigest(b" ".join(w)) for w in texts], np.uint64).view(np.int64)
            yield batch(_SIGNED, b.column(0), text_hashes(data), nodes, signed)

    return map_batches(docs.select(c(id_column).cast("long").alias("doc_id"), c(text_column).cast("string").alias("text")),
                       run, "doc_id long, crc long, node long, bands array<long>")


def _linked(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of a left and a right set are similar; sets are distinct n-grams."""
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = code[shared], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    code = np.cumsum(np.append(0, code[1:] != code[:-1])) if len(code) else code
    common = np.zeros((len(left), len(right)), np.float32)
    row = np.full((2, len(lists)), -1)
    row[0, left], row[1, right] = np.arange(len(left)), np.arange(len(right))
    step = 8192
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [at, at + step])
        sides = []
        for k, m in ((0, len(left)), (1, len(right))):
            here = row[k, owner[a:b]]
            side = np.zeros((m, step), np.float32)
            side[here[here >= 0], code[a:b][here >= 0] - at] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    size = np.array([len(x) for x in lists], np.float64)
    return common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-6


def _compare(n: int, similarity: float):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        out: list[tuple] = []
        nodes, blocks = group.column("node").to_numpy(), group.column("block").to_pylist()
        cells = list(zip(*(group.column(x).to_pylist() for x in ("component", "i", "j"))))
        lists = [np.unique(x) for x in shingles([space_words(t) for t in utf8(group.column("text").combine_chunks())], n)]
        together: dict[tuple, list[int]] = {}
        seen = set()
        for k, cell in enumerate(cells):
            # rows that repeat id and text stand for one class
            if (cell, nodes[k]) not in seen:
                seen.add((cell, nodes[k]))
                together.setdefault(cell, []).append(k)
        for (_, i, j), members in together.items():
            if len(members) < 2:
                continue
            sets = [lists[m] for m in members]
            left = np.array([k for k, m in enumerate(members) if blocks[m] == i])
            right = left if i == j else np.array([k for k, m in enumerate(members) if blocks[m] == j])
            if not len(left) or not len(right):
                continue
            hit = _linked(sets, left, right, similarity)
            if i == j:
                np.fill_diagonal(hit, False)
            ids = nodes[members]
            # spanning edges of the links found here, by a small union-find
            root = list(range(len(members)))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(*np.nonzero(hit)):
                x, y = find(int(left[a])), find(int(right[b]))
                root[max(x, y)] = min(x, y)
            counts = np.zeros(len(members), np.int64)
            counts[left] += hit.sum(1)
            if i != j:
                counts[right] += hit.sum(0)
            out += [(int(ids[k]), int(counts[k]), int(ids[find(k)])) for k in np.flatnonzero(counts).tolist()]
        return pa.Table.from_arrays(
            [pa.array(x, t.type) for x, t in zip(zip(*out) if out else [[]] * 3, _LINKS)], schema=_LINKS)
    return run


def similar_texts(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, crc, class_id, n_links, group_id, group_node, has_words`` of each row.

    Words lie between white space, A-Z in lower case.  Rows with the same words are one
    class, named by its smallest id; ``n_links`` is the number of other
    classes whose n-gram sets have at least this Jaccard ``similarity``;
    ``group_id`` is the smallest class of those linked directly or through
    others, and ``group_node`` a number of that group.  ``crc`` is that of the text.  Null and empty texts are one class
    without links; a text of fewer than ``n`` words is one n-gram; null ids sort
    after others; repeated rows repeat; other columns are not read; an empty
    table gives no rows.
    """
    bands, rows = bands_for(similarity, recall)
    signed = cut_lineage(signatures(docs, id_column, text_column, n, bands, rows))
    # one row of a class stands for it; a null id sorts last
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")
    classes = signed.groupBy("node").agg(F.min(place).alias("first"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.select("node", F.col("first.doc_id").alias("class_id"), F.col("first.crc").alias("crc"),
                                         "bands"))
    members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = members.join(buckets, "bucket").where("node <> least").select("node", "least").distinct()
    candidates = components(edges, "node", "least")
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = candidates.join(sizes, "component").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = cut_lineage(placed.join(classes.select("node", "class_id", "crc"), "node"))
    copies = placed.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    texts = docs.select(c(id_column).cast("long").alias("doc_id"), F.coalesce(c(text_column).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_crc", F.xxhash64("text"))
    chosen = placed.join(texts, placed.class_id.eqNullSafe(texts.doc_id) & (placed.crc == texts.text_crc))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = chosen.select("node", "component", "block", "text", other).select(
        "node", "component", "block", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    bins = max(copies // BIN, 1)
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("component", "i", "j"), F.lit(bins)))
    links = cut_lineage(dealt.groupBy("bin").applyInArrow(_compare(n, similarity), "node long, links long, root long"))
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    groups = components(links, "node", "root")
    named = groups.join(classes.select("node", "class_id"), "node")
    first = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    known = counts.join(groups, "node").join(first, "component").select("node", "n_links", "group_id", "component")
    by_class = classes.select("node", "class_id").join(known, "node", "left")
    return signed.select("doc_id", "crc", "node", (F.size("bands") > 0).alias("has_words")).join(by_class, "node").select(
        "doc_id", "crc", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("component", "node").alias("group_node"), "has_words")


def keep_one(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """The documents, with their own columns, one of each group of similar ones.

    The smallest id stays, of equal ids the smallest checksum of the text.
    Texts without words are no group: all of them stay.  Of rows that repeat a
    kept id and text one stays.  An empty table stays empty.
    """
    found = cut_lineage(similar_texts(docs, n, similarity, id_column=id_column, text_column=text_column))
    worded = found.where("has_words")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "crc")
    kept = worded.groupBy("group_node").agg(F.min(place).alias("first")).select(
        F.col("first.doc_id").alias("_doc_id"), F.col("first.crc").alias("_crc"))
    wordless = found.where("not has_words").select(F.col("doc_id").alias("_doc_id"), F.col("crc").alias("_crc")).distinct()
    names = [f"_c{i}" for i in range(len(docs.columns))]
    of = {k: F.col(names[docs.columns.index(k)]) for k in (id_column, text_column)}
    plain = docs.toDF(*names).withColumns({
        "_row_id": of[id_column].cast("long"),
        "_row_crc": F.xxhash64(F.coalesce(of[text_column].cast("string"), F.lit("")))})
    same = F.col("_row_id").eqNullSafe(F.col("_doc_id")) & (F.col("_row_crc") == F.col("_crc"))
    out = plain.join(kept.union(wordless), same, "left_semi")
    # seldom: rows that repeat id and text
    if worded.groupBy("doc_id", "crc").count().where("count > 1").limit(1).count():
        wordless_row = F.trim(F.translate(of[text_column], "\t\n\x0b\x0c\r", "     ")) == ""
        bare = F.coalesce(wordless_row, F.lit(True))
        out = out.where(~bare).dropDuplicates(["_row_id", "_row_crc"]).union(out.where(bare))
    return out.select(*names).toDF(*docs.columns)
