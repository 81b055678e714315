"""Language identification: parsing against plain search, odd texts, held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import language
from tabweave.llm.queries import QUERIES


def part(lang, sample):
    codes = [ord(x) for x in sample]
    return (lang, len(codes), *language.shared_rows(language.suffix_automaton(codes)))


def plain_phrases(sample, text):
    """Greedy longest phrases by substring search, each block of the text from a fresh start."""
    n = 0
    for at in range(0, len(text), language.PARSED_BLOCK):
        block = text[at:at + language.PARSED_BLOCK]
        i = 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i:j + 1] in sample:
                j += 1
            i, n = j, n + 1
    return n


def test_parsing_against_substring_search():
    r = random.Random(2)
    letters = ["abc ", "abcdé", "ab日本語 ", "xyz"]
    samples = ["".join(r.choice(a) for _ in range(n)) for a, n in zip(letters, (400, 900, 50, 1))] + [""]
    texts = ["".join(r.choice(r.choice(letters)) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["", "a", samples[0], samples[1] * 5, "\U0001d400zz", "q" * 3000]
    pack = language.Pack.of([part(str(i), s) for i, s in enumerate(samples)])
    got = pack.phrases([np.array([ord(x) for x in t], np.int64) for t in texts])
    want = [[plain_phrases(s, t) for t in texts] for s in samples]
    assert got.tolist() == want


def test_many_lanes(monkeypatch):
    monkeypatch.setattr(language, "LANES", 3)
    monkeypatch.setattr(language, "PARSED_BLOCK", 5)
    pack = language.Pack.of([part("a", "abcabdabcabe"), part("b", "bbcab")])
    texts = ["abcabdabe" * 4, "", "zzab", "abc" * 7, "cab"]
    got = pack.phrases([np.array([ord(x) for x in t], np.int64) for t in texts])
    assert got.tolist() == [[plain_phrases(s, t) for t in texts] for s in ("abcabdabcabe", "bbcab")]


def test_normalised():
    read = lambda t: "".join(map(chr, language.normalised(t)))
    assert read("  Ab, 12\tĆÉ!") == " ab ćé "
    assert read("") == "" and read("123") == " "


ODD = [(None, "the cat and the dog", "en"), (1, None, "en"), (2, "", "de"), (3, "12 ?! ́", "en"), (4, "the dog", None),
       (5, "der hund und die katze", "de"), (8, "the cat sat with the dog " * 20_000, "en"), (9, "日本", "ja")]


@pytest.mark.parametrize("pack", [32, 1])
def test_odd_rows(spark, monkeypatch, pack):
    monkeypatch.setattr(language, "PACK", pack)
    docs = spark.createDataFrame([(*x, 1.0, "s") for x in ODD + ODD[:1] * 30],
                                 "doc_id long, text string, lang string, score double, bits string").repartition(3)
    model = language.fit(docs, F.lit(True))
    assert model.langs == ["de", "en", "ja"]
    got = language.predict(docs, model).collect()
    assert len(got) == len(ODD) + 30
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (None, 1, 2, 3, 4, 5, 8, 9)] == ["en", "und", "und", "und", "en", "de", "en", "ja"]
    assert all(0 <= r.score <= 1 for r in got) and by_id[1].score == by_id[3].score == 0
    nothing = language.fit(docs, F.lit(False))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, nothing).collect()} == {("und", 0)}
    one = language.predict(docs, language.fit(docs, F.col("lang") == "de")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0), ("de", 1)}
    assert language.predict(docs.limit(0), model).count() == 0


def test_sample_is_bounded_and_copies_count_once(spark):
    """A text with a third of all rows is one text of the sample."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(3000)), "x") for i in range(120)] + [(7, "zq " * 1000, "x")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    row = language.fit(docs, F.lit(True)).parts.first()
    assert language.SAMPLE * 0.8 < row.length <= language.SAMPLE + 2 * 256


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES["op11_language"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    row = got.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert row.n > 200 and row.right > 0.98
