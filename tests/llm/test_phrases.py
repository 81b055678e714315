"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabweave.llm import ngrams, phrases


def plain(rows, least, percent=50, most=2000):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                count[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            longer = max((b for h, b in f.items() if len(h) == len(g) + 1 and b >= least and g in (h[1:], h[:-1])), default=0)
            if longer and 100 * longer >= percent * a:
                continue
            score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["a", "B", "b", "of", "the", "é", "x\x0by", "don't", "\x1c", "日本"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; "]
    out = [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 40))))
           for _ in range(200)]
    return out + [("en", None), ("en", ""), (None, "..."), ("en", "of the a " * 3000)] + [("de", "b é of the")] * 90


@pytest.mark.parametrize("least,percent,most", [(10, 50, 2000), (2, 80, 25), (40, 50, 3)])
def test_against_plain_counts(spark, rows, least, percent, most):
    docs = spark.createDataFrame([(*x, "c", 1, 2) for x in rows], "lang string, text string, grp string, n int, a int")
    got = phrases.collocations(docs.repartition(5), least, percent, most).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, percent, most)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0


def test_score_beyond_64_bits(spark):
    big = 900_000_000_000_123
    df = spark.createDataFrame([(big, big + 7, big + 1000)], "a long, l long, r long")
    row = df.select(phrases._score(df.a, df.l, df.r)).first()
    assert row[0] == 10**6 * big * big // ((big + 7) * (big + 1000))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(ngrams, "PIECE_BYTES", 7)
    data = b"one two three. four  five,six seventeen eight nine ten eleven twelve"
    low = data.translate(phrases._LOW)
    whole = phrases._split(low)
    for overlap in (0, 1, 2):
        parts = list(ngrams.pieces(low, phrases._STOP, phrases._split, overlap))
        assert len(parts) > 3
        grams = lambda t: [tuple(t[i:i + overlap + 1]) for i in range(len(t) - overlap)]
        assert Counter(g for p in parts for g in grams(p)) == Counter(grams(whole))


def test_sieve_holds_what_it_was_given(spark):
    df = spark.createDataFrame([("g" if i % 2 else "", f"p{i}", f"n{i}", 3) for i in range(3000)],
                               "grp string, prefix string, next string, n long")
    for words in (1, 2):
        sieve = ngrams.make_sieve(df, words, 3000)
        for grp, odd in (("g", 1), ("", 0)):
            given = range(odd, 3000, 2)
            h = ngrams.word_hashes(grp, [b"n%d" % i for i in given])
            if words == 2:
                h = ngrams.pair_hashes(ngrams.word_hashes(grp, [b"p%d" % i for i in given]), h)
            assert ngrams.in_sieve(sieve, h).all()
            assert ngrams.in_sieve(sieve, h + np.uint64(12345)).mean() < 0.2
    assert not ngrams.make_sieve(df.limit(0), 1, 0).any()
