"""Language-model scores against a plain model without automaton or joins."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from tabweave.llm import lm

SMALL = {"common": 20, "least_common": 3, "vocabulary": 20, "ngrams": 100_000, "least_ngram": 2}


def tokens(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


class Plain:
    """Backoff by recursion over dictionaries."""

    def __init__(self, rows, common, least_common, vocabulary, ngrams, least_ngram):
        everything, self.c = Counter(), Counter()
        for doc, text in rows:
            everything.update(tokens(text))
            if not held(doc):
                self.c.update(tokens(text))
        self.n, self.v = sum(self.c.values()), len(self.c)
        total = sum(everything.values())
        common = {w for w, k in everything.items() if k >= max(least_common, total / common)}
        frequent = {w for w in common if everything[w] >= total / vocabulary}
        self.grams = Counter()
        for doc, text in rows:
            if not held(doc):
                t = [None, *tokens(text)]
                ok = lambda w: w is None or w in frequent
                for n in (2, 3):
                    self.grams.update(tuple(t[i:i + n]) for i in range(len(t) - n + 1) if all(map(ok, t[i:i + n])))
        if "<end>" not in common:
            self.grams = Counter({g: k for g, k in self.grams.items() if g[0] is not None})
        self.grams = {g: k for g, k in self.grams.items() if k >= max(least_ngram, self.n / ngrams)}

    def unigram(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, h, w):
        if not h:
            return self.unigram(w)
        follow = {g[-1]: k for g, k in self.grams.items() if g[:-1] == h}
        if not follow:
            return self.p(h[1:], w)
        total = self.c["<end>"] if h == (None,) else self.c[h[0]] if len(h) == 1 else self.grams[h]
        if w in follow:
            return (follow[w] - 0.75) / total
        left = 1 - sum((k - 0.75) / total for k in follow.values())
        return left / (1 - sum(self.p(h[1:], x) for x in follow)) * self.p(h[1:], w)

    def score(self, text):
        t = [None, *tokens(text)]
        return sum(math.log10(self.p(tuple(t[max(0, i - 2):i]), t[i])) for i in range(1, len(t)))

    def base(self, text):
        return sum(math.log10(self.unigram(w)) for w in tokens(text))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["a", "B", "b", "c", "d", "é"]
    texts = [" ".join(r.choice(words) if r.random() < 0.8 else f"r{r.randint(0, 60)}" for _ in range(r.randint(0, 25)))
             for _ in range(120)]
    return [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (None, "a b zz"), (5, texts[5]), (5, texts[5]),
                                                     (7, "x\ta\x0bb c")]


def test_against_plain_model(spark, rows):
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int").repartition(3)
    plain = Plain(rows, **SMALL)
    model = lm.fit(docs, **SMALL)
    assert any(len(g) == 3 for g in plain.grams)
    got = lm.score(docs, model).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[4], 6))
    want = sorted([(d, held(d), len(tokens(t)), sum(plain.c[w] > 0 for w in tokens(t)), plain.base(t), plain.score(t))
                   for d, t in rows], key=key)
    have = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], key=key)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    assert {r.train_tokens for r in got} == {plain.n}
    # the probabilities after any context sum to 1
    for h in [(), (None,), ("a",), ("a", "b"), ("b", "c"), ("é",)]:
        assert sum(plain.p(h, w) for w in plain.c) + plain.p(h, "never seen") == pytest.approx(1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, lm.fit(docs)).count() == 0


def test_tokens_beat_unigrams_on_unseen_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs, lm.fit(docs)).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_every_frequent_enough_ngram_counts(spark, rows):
    """N-grams of rare tokens, and those that tasks do not hold, count like others."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = Plain(rows, 10**9, 1, 10**9, 10**9, 2)
    assert any(w and w.startswith("r") for g in plain.grams for w in g)
    for held in (1, 20):
        model = lm.fit(docs, common=20, least_common=3, least_ngram=2, held=held)
        got = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in lm.score(docs, model).collect())
        want = sorted((d or 0, len(tokens(t)), plain.score(t)) for d, t in rows)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_hot_text_long_text_and_clashing_columns(spark, rows):
    """One row repeated on a third of the table, a long text, and columns named like the model's own."""
    many = rows + [(9, "a b c a b")] * 70 + [(300, "a b c d " * 20_000)]
    docs = spark.createDataFrame([(*x, 1, "k") for x in many], "doc_id long, text string, block int, key string")
    plain = Plain(many, 10**9, 1, 10**9, 10**9, 2)
    model = lm.fit(docs, common=20, least_common=3, least_ngram=2, held=30)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.score) for r in lm.score(docs, model).collect())
    seen = {text: plain.score(text) for text in {t for _, t in rows} | {"a b c a b"}}
    want = sorted((d or 0, len(tokens(t)), sum(plain.c[w] > 0 for w in tokens(t)), seen[t]) for d, t in many if d != 300)
    assert [x[:3] for x in got if x[0] != 300] == [x[:3] for x in want]
    assert [x[3] for x in got if x[0] != 300] == pytest.approx([x[3] for x in want])
    # the long text is one cycle
    cycle = [math.log10(plain.p(h, w)) for h, w in ((("c", "d"), "a"), (("d", "a"), "b"), (("a", "b"), "c"), (("b", "c"), "d"))]
    long = next(x for x in got if x[0] == 300)
    assert long[1] == 80_001 and long[3] == pytest.approx(20_000 * sum(cycle), abs=20)


def test_automaton_states_and_failure_arcs():
    """Of ``x y`` and ``x y z`` kept: the states are x and x y; a miss fails to the shorter context."""
    block = lm.Block.of([b"x y z", b"x y y"])
    hashes = lm.token_hashes(block.words)
    x, y, z = (hashes[[block.words.index(w)]] for w in (b"x", b"y", b"z"))
    keys = [int(k[0]) for k in (lm.ngram_keys(x), lm.ngram_keys(x, y), lm.ngram_keys(x, y, z))]
    order = sorted(range(3), key=keys.__getitem__)
    arcs, backs = (0.0, -0.2, -0.1), (-0.5, -0.7, 0.0)
    weights = lm.Weights(*[lm.np.array([v[i] for i in order]) for v in (keys, arcs, backs)])
    a = lm.build_automaton(block, hashes, lm.np.full(len(hashes), -2.0), [weights])
    assert a.failures == [0, 0, 0] and a.backs == [0.0, -0.5, -0.7]
    read = lambda text: a.read([block.words.index(w) for w in text])
    # x, x y and x y z by arcs; the end after no context
    assert read([b"x", b"y", b"z", b""]) == pytest.approx(-2 - 0.2 - 0.1 - 2)
    # x y fails over its own weight
    assert read([b"x", b"y", b"y", b""]) == pytest.approx(-2 - 0.2 - 0.7 - 2 - 2)
    assert read([b"x", b"x", b""]) == pytest.approx(-2 - 0.5 - 2 - 0.5 - 2)


def test_all_words_of_a_block_step_at_once(spark, rows):
    """The traversal agrees with one that follows arcs word by word, also across the texts of a block."""
    texts = [(t or "").encode() for _, t in rows]
    block = lm.Block.of(texts)
    hashes = lm.token_hashes(block.words)
    two, _, three, _ = block.ngrams()
    keys = lm.ngram_keys_of(block, hashes, two, three)
    r = lm.np.random.default_rng(3)
    pair = [k for k, p in zip(keys[1].tolist(), two.tolist()) if p % len(block.words) and r.random() < 0.5]
    kept = {*pair, *keys[0].tolist()}  # the first token of a kept pair is a state
    size, place = len(block.words), {p: k for p, k in enumerate(keys[1].tolist())}
    kept |= {k for k, t in zip(keys[2].tolist(), three.tolist()) if r.random() < 0.5 and place[t // size] in kept
             and dict(zip(two.tolist(), keys[1].tolist())).get(two[t // size] % size * size + t % size) in kept}
    held = lm.np.sort(lm.np.array(list(kept)))
    weights = lm.Weights(held, -r.random(len(held)), -r.random(len(held)))
    a = lm.build_automaton(block, hashes, -1 - r.random(size), [weights])
    arcs = dict(zip(a.codes.tolist(), range(len(a.codes))))

    def walk(text):
        state, total = a.start, 0.0
        for w in text:
            while (arc := arcs.get(state * size + w)) is None:
                total, state = total + a.back[state], a.failure[state]
            total, state = total + a.logs[arc], a.targets[arc]
        return total

    steps, at = lm.np.append(0.0, a.steps(block.ids)), 0
    for k in block.lengths.tolist():
        text = block.ids[at + 1:at + k].tolist()
        assert steps[at + 1:at + k].sum() == pytest.approx(walk(text)) == a.read(text)
        at += k


def test_texts_are_scored_in_waves(spark, rows, monkeypatch):
    """What is asked for is on disk for one share of the texts at a time, and shuffle files go with their job."""
    key, seen, asked = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], lm.asked_keys
    before = spark.conf.get(key)

    def noted(rows, model):
        seen.append((spark.conf.get(key), rows.count()))
        return asked(rows, model)

    monkeypatch.setattr(lm, "asked_keys", noted)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.score(docs, lm.fit(docs, **SMALL)).count() == len(rows)
    assert len(seen) == lm.WAVES and all(on == "true" and n < len(rows) / 2 for on, n in seen)
    assert sum(n for _, n in seen) == len(rows) and spark.conf.get(key) == before
