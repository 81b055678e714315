"""Phrase collocation mining by stripes.

One table of stripes holds all that is asked for: the prefix of a stripe and a
word after it are a phrase, its count is in the stripe, the count of a part is
the entry of that part in a shorter stripe, and the largest count among the
entries of a stripe is what its prefix may be subsumed by.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.core.scan import attach_measured
from tabweave.llm.ngrams import BREAK, frequent_ngrams, pieces
from tabweave.llm.text import ASCII_LOWER, utf8
from tabweave.session import cut_lineage

LEAST = 10
SUBSUMED_PERCENT = 50
MOST = 2000
NO_LANGUAGE = "und"
SCALE = 1_000_000
# the parts in which a group's best phrases are looked for before they meet
TOP_PARTS = 64

# A-Z in lower case; . , ; : ! ? and x0A-x0D end a piece, space and tab separate words
_LOW = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else ASCII_LOWER[b] for b in range(256))
_STOP = re.compile(rb"[ .]")


def _split(data: bytes) -> list[bytes]:
    return [BREAK if w == b"." else w for w in data.replace(b".", b" . ").split(b" ") if w]


def language_tokens(b: pa.RecordBatch, overlap: int) -> Iterator[tuple[str, list[bytes]]]:
    """Per language of a batch (``lang, text``) the words of its texts, with ``BREAK`` between pieces and texts."""
    found = defaultdict(list)
    for lang, data in zip(b.column(0).to_pylist(), utf8(b.column(1))):
        for tokens in pieces(data.translate(_LOW), _STOP, _split, overlap):
            found[lang] += tokens
            found[lang].append(BREAK)
            if len(found[lang]) > 1 << 18:
                yield lang, found.pop(lang)
    yield from found.items()


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)) in 38-digit whole numbers."""
    wide = "decimal(19,0)"
    over = F.lit(SCALE).cast("decimal(7,0)") * (a.cast("decimal(15,0)") * a.cast("decimal(15,0)")).cast("decimal(30,0)")
    under = left.cast(wide) * right.cast(wide)
    return F.call_function("div", over, under)


def collocations(docs: DataFrame, least: int = LEAST, subsumed_percent: int = SUBSUMED_PERCENT, most: int = MOST,
                 group: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of 2 and 3 words of each language.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends and into words
    at spaces and tabs, A-Z in lower case.  ``a`` counts a phrase inside
    pieces, overlaps included; phrases with fewer than ``least`` are not
    looked at.  A cut in two gives ``l`` and ``r``, the counts of the parts,
    and floor(10**6 * a * a / (l * r)); the lowest-scoring cut counts, the
    first one of equals.  A phrase goes if a longer one around it has at least
    ``subsumed_percent`` of its count.  ``n`` counts all words of a language.
    The first ``most`` by score, count (both descending) and phrase (UTF-8
    bytes) stay.

    A null language is ``und``, together with a language of that name; null
    and empty texts have no words; repeated rows count again; long texts are
    read in pieces; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(c(group).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       c(text).cast("string").alias("text"))
    (words, pairs, triples), totals = frequent_ngrams(rows, language_tokens, 3, least)
    word = words.select("grp", F.col("next").alias("w"), F.col("n").alias("f"))

    def count_of(df: DataFrame, name: str, out: str) -> DataFrame:
        return attach_measured(df, word.select("grp", F.col("w").alias(name), F.col("f").alias(out)), ["grp", name])

    two = count_of(count_of(pairs.select("grp", F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.col("n").alias("a")),
                            "w1", "f1"), "w2", "f2")
    two = cut_lineage(two)
    three = triples.select("grp", F.substring_index("prefix", " ", 1).alias("w1"), F.substring_index("prefix", " ", -1).alias("w2"),
                           F.col("next").alias("w3"), F.col("n").alias("a"))
    three = count_of(three, "w3", "f3")
    three = attach_measured(three, two.select("grp", "w1", "w2", F.col("f1"), F.col("a").alias("f12")), ["grp", "w1", "w2"])
    three = attach_measured(three, two.select("grp", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")),
                            ["grp", "w2", "w3"])
    three = cut_lineage(three)
    # the largest count among what a pair is extended by, on either side
    around = three.select("grp", "w1", "w2", "a").union(three.select("grp", "w2", "w3", "a")).groupBy("grp", "w1", "w2").agg(
        F.max("a").alias("most"))
    kept = attach_measured(two, around, ["grp", "w1", "w2"]).where(
        "most is null or 100 * most < " + f"{int(subsumed_percent)} * a")
    early, late = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    scored = kept.select("grp", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                         _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score")).union(
        three.withColumns({"s1": early, "s2": late}).select(
            "grp", F.concat_ws(" ", "w1", "w2", "w3"), "a", F.when(F.expr("s1 <= s2"), F.col("f1")).otherwise(F.col("f12")),
            F.when(F.expr("s1 <= s2"), F.col("f23")).otherwise(F.col("f3")), F.least("s1", "s2")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))).where(
        F.col("rank") <= most)
    # TOP_PARTS * most phrases a language at most
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= most)
    return attach_measured(ranked, totals, ["grp"]).select(
        F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
