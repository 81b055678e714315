"""Counting the n-grams of a whole corpus that occur often enough.

An n-gram can occur k times only if both n-grams of one word less do.  So each
length is counted by tasks that leave out what a sieve of the length before
rules out; the sieve is a Bloom filter of bounded size and may let some through,
but what is let through is counted exactly.

Tasks hand on stripes: a prefix once, with a counter of the words after it.
Stripes travel as the text of a whole bucket of prefixes, and merging adds them
word by word.  The stripe of a prefix that makes up more than 1/``HEAD`` of the
corpus is dealt to all buckets, by the next word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.text import batch, map_batches
from tabweave.session import cut_lineage

HEAD = 4096
# buckets that stripes are dealt to, at least
BUCKETS = 1024
# tokens that a task gathers before it hands stripes on
GATHERED = 2_000_000
# texts are split into tokens in pieces of about so many bytes
PIECE_BYTES = 1 << 20
# a sieve's bits: 16 for each n-gram, at most 8 MB
SIEVE_BITS = 16
MOST_SIEVE_BITS = 1 << 26
# a token that separates: no n-gram reaches across it
BREAK = b" "

#: all groups of a batch, with the tokens of their texts, ``BREAK`` between texts
Tokens = Callable[[pa.RecordBatch, int], Iterator[tuple[str, list[bytes]]]]

# a word never holds a space, tab or line end: those part the entries, prefixes and stripes of
# a bucket, and this one a word from its count
COUNT = b"\x0b"
_STRIPES = pa.schema([("grp", pa.string()), ("bucket", pa.int32()), ("stripes", pa.string())])
_STRIPES_SQL = "grp string, bucket int, stripes string"
_PLACE = pa.schema([("place", pa.int64())])


def pieces(data: bytes, stop: re.Pattern, split: Callable[[bytes], list[bytes]], overlap: int) -> Iterator[list[bytes]]:
    """The tokens of a long text in lists of bounded size, cut where ``stop`` matches; each list
    starts with the last ``overlap`` tokens of the one before, so an n-gram of one word more is in one list."""
    at, tail = 0, []
    while True:
        cut = stop.search(data, at + PIECE_BYTES)
        end = cut.end() if cut else len(data)
        tokens = tail + split(data[at:end])
        yield tokens
        if not cut:
            return
        tail = tokens[-overlap:] if overlap else []
        at = end


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(group: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(group.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(0xC2B2AE3D27D4EB4F) + second)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a sieve for each hash."""
    mask = np.uint64(bits - 1)
    return _mixed(h) & mask, _mixed(h ^ np.uint64(0xD6E8FEB86659FD93)) & mask


def in_sieve(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _places(h, len(sieve) * 8)
    return ((sieve[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8))
            & (sieve[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def make_sieve(kept: DataFrame, words: int, n: int) -> np.ndarray:
    """The sieve of the ``n`` n-grams ``grp, prefix, next`` of 1 or 2 words: a bitmap
    of at most ``MOST_SIEVE_BITS``, put together by tasks."""
    bits = _sieve_bits(n)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_group = defaultdict(list)
            for grp, prefix, following in zip(*(x.to_pylist() for x in b.columns)):
                by_group[grp].append((prefix.encode(), following.encode()))
            for grp, grams in by_group.items():
                h = word_hashes(grp, [w for _, w in grams])
                if words == 2:
                    h = pair_hashes(word_hashes(grp, [w for w, _ in grams]), h)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(h, bits)).astype(np.int64))], schema=_PLACE)

    return _sieve(map_batches(kept.select("grp", "prefix", "next"), places, "place long"), bits)


def key_sieve(keys: DataFrame, n: int) -> np.ndarray:
    """The sieve of a column of ``n`` 64-bit numbers."""
    bits = _sieve_bits(n)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch(_PLACE, np.concatenate(_places(h, bits)).astype(np.int64))

    return _sieve(map_batches(keys, places, "place long"), bits)


def _sieve_bits(n: int) -> int:
    return 1 << max(15, min(MOST_SIEVE_BITS.bit_length() - 1, (n * SIEVE_BITS).bit_length()))


def _sieve(places: DataFrame, bits: int) -> np.ndarray:
    # Spark counts places from 1, and so its pages
    place = F.col("place") + 1
    pages = places.groupBy(
        F.bitmap_bucket_number(place).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    size = 4096  # bytes of a bitmap of Spark's
    # at most MOST_SIEVE_BITS in all
    for r in pages.toLocalIterator():
        at = (r["page"] - 1) * size
        out[at:at + size] = np.frombuffer(bytes(r["bits"]), np.uint8)[:len(out) - at]
    return out


def _stripes(group: str, tokens: pa.DictionaryArray, words: int, sieve: np.ndarray | None,
             heads: set[tuple[str, str]], buckets: int) -> Iterator[pa.RecordBatch]:
    """The stripes of one group's tokens, by bucket: counters of n-grams of ``words`` words by prefix."""
    names = tokens.dictionary
    ids = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(names)
    listed = names.to_pylist()
    word = np.array([w != BREAK for w in listed], bool)
    if words == 1:
        counts = np.bincount(ids, minlength=size)
        last = np.flatnonzero(word & (counts > 0))
        counts = counts[last]
        prefix = np.zeros(len(last), np.int64)
        prefixes = lambda k: ""
    elif words == 2:
        known = word & in_sieve(sieve, word_hashes(group, listed))
        here = known[ids]
        found, counts = np.unique((ids[:-1] * size + ids[1:])[here[:-1] & here[1:]], return_counts=True)
        prefix, last = found // size, found % size
        prefixes = lambda k: listed[k].decode()
    else:
        h = word_hashes(group, listed)
        pairs, inverse = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        first, second = pairs // size, pairs % size
        known = word[first] & word[second] & in_sieve(sieve, pair_hashes(h[first], h[second]))
        here = known[inverse]
        found, counts = np.unique((inverse[:-1] * size + ids[2:])[here[:-1] & here[1:]], return_counts=True)
        prefix, last = found // size, found % size
        prefixes = lambda k: (listed[first[k]] + b" " + listed[second[k]]).decode()
    if not len(last):
        return
    # one stripe a prefix; a head's entries go to stripes of their own in many buckets
    edges = np.flatnonzero(np.diff(prefix, prepend=-1, append=-1))
    spelled = [prefixes(k) for k in prefix[edges[:-1]]]
    bucket = (word_hashes(group, [x.encode() for x in spelled]) % np.uint64(buckets)).astype(np.int64).repeat(np.diff(edges))
    split = np.array([(group, x) in heads for x in spelled]).repeat(np.diff(edges))
    if split.any():
        next_hash = (word_hashes("", listed) % np.uint64(buckets)).astype(np.int64)
        bucket[split] = (bucket[split] + next_hash[last[split]]) % buckets
    number = np.arange(len(spelled)).repeat(np.diff(edges))
    order = np.argsort(bucket, kind="stable")
    bucket, number, last, counts = bucket[order], number[order], last[order], counts[order]
    edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1) | np.diff(bucket, prepend=-1, append=-1))
    entries = pc.binary_join_element_wise(names.cast(pa.string()).take(pa.array(last)), pa.array(counts).cast(pa.string()),
                                          COUNT.decode())
    lines = pc.binary_join_element_wise(
        pa.array(spelled, pa.string()).take(pa.array(number[edges[:-1]])),
        pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), entries), " "), "\t")
    bucket = bucket[edges[:-1]]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), lines), "\n")
    for at in range(0, len(rows), 64):
        part = rows.slice(at, 64)
        yield batch(_STRIPES, [group] * len(part), bucket[edges[at:at + len(part)]], part)


def merged_stripes(docs: DataFrame, tokens: Tokens, words: int, sieve: np.ndarray | None = None,
                   heads: list[tuple[str, str]] = (("", ""),)) -> DataFrame:
    """``grp, prefix, next, n``: how often each n-gram of 1, 2 or 3 ``words`` occurs.

    ``docs`` has the columns that ``tokens`` reads.  ``sieve`` is that of the
    n-grams of one word less; n-grams that it rules out are missing.  ``heads``
    are the prefixes (group, prefix) whose stripes are dealt to all buckets.
    """
    held: Broadcast = docs.sparkSession.sparkContext.broadcast((sieve, set(heads)))
    buckets = max(BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, heads = held.value
        gathered, size = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, parts in gathered.items():
                whole = pa.chunked_array(parts).unify_dictionaries()
                ids = pa.concat_arrays([x.indices for x in whole.chunks])
                yield from _stripes(group, pa.DictionaryArray.from_arrays(ids, whole.chunk(0).dictionary), words, sieve,
                                    heads if words > 1 else {(group, "")}, buckets)
            gathered.clear()

        for b in batches:
            for group, found in tokens(b, words - 1):
                found.append(BREAK)
                size += len(found)
                gathered[group].append(pa.array(found, pa.binary()).dictionary_encode())
                if size >= GATHERED:
                    yield from flush()
                    size = 0
        yield from flush()

    lines = map_batches(docs, run, _STRIPES_SQL).repartition("grp", "bucket").select(
        "grp", "bucket", F.explode(F.split("stripes", "\n")).alias("line"))
    entries = lines.select("grp", "bucket", F.substring_index("line", "\t", 1).alias("prefix"),
                           F.explode(F.split(F.substring_index("line", "\t", -1), " ")).alias("entry"))
    return entries.groupBy("grp", "bucket", "prefix", F.substring_index("entry", COUNT.decode(), 1).alias("next")).agg(
        F.sum(F.substring_index("entry", COUNT.decode(), -1).cast("long")).alias("n")).drop("bucket")


def frequent_ngrams(docs: DataFrame, tokens: Tokens, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Per length 1 to ``longest`` (3 at most): ``grp, prefix, next, n`` of the n-grams
    that occur ``least`` times, exactly counted; and ``grp, n`` of all words."""
    words = cut_lineage(merged_stripes(docs, tokens, 1))
    totals = words.groupBy("grp").agg(F.sum("n").alias("n"))
    out = [words.where(F.col("n") >= least)]
    everything = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for length in range(2, longest + 1):
        n = out[-1].count()
        sieve = make_sieve(out[-1], length - 1, n)
        name = F.concat_ws(" ", F.when(F.col("prefix") != "", F.col("prefix")), F.col("next"))
        # fewer than HEAD words hold such a share, and as few pairs
        heads = [(r[0], r[1]) for r in out[-1].where(F.col("n") * HEAD > everything).select("grp", name).collect()]
        counted = merged_stripes(docs, tokens, length, sieve, heads)
        out.append(cut_lineage(counted.where(F.col("n") >= least)))
    return out, totals
