"""Token counts, packing and id files against the libraries' own answers."""

import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")

from tabweave.llm import packing, planes, token_counts  # noqa: E402
from tabweave.llm.tokens import WordEncoder  # noqa: E402
from tabweave.session import scratch_path  # noqa: E402

ODD = [None, "", " ", "a ", " a", "a  b", "\n", "a\n b", "x　y z", "<|endoftext|> a b", "a<|endoftext|>b c",
       "▁ a ▁b", "é́ A", "don't  'll", "a\tb \tc", "Σας ΣΑΣ ς", "a ́b", "x<s> </s> y", "A\nB\n", "\n\nq", "İ ǅ",
       "q\x1cz w\x1c e", "a\r\nb c", "the end. Next one! " * 40, "word " * 3000, "z" * 5000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "other") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def library(name, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder(name):
    texts = [t or "" for t in ODD]
    got = WordEncoder(name).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library(name, texts)


def test_counts(spark, docs, monkeypatch):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = sorted((i if i != 5 else -1, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(ODD))
    got = token_counts.count_tokens(docs, "piece_bpe_32k.model", limit=100).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    for text in [*ODD, "a  b c ▁ d  e f"]:
        parts = token_counts.split_safely(text or "", 4)
        assert sum(map(len, model.encode(parts))) == len(model.encode(text or ""))
    assert token_counts.count_tokens(docs.limit(0), "piece_bpe_32k.model").count() == 0


def test_packing(spark, docs):
    ids = library("byte_bpe_50k.json", ODD)
    window = 64
    rows = packing.pack_documents(docs, "byte_bpe_50k.json", window=window).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, want in enumerate(ids):
        pieces = sorted(by_doc[i if i != 5 else None], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == np.array([*want, 1], "<u4").tobytes()
        assert all(p.doc_tokens == len(want) + 1 for p in pieces)
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        length = sum(p.length for p in pieces)
        assert length <= window
        padding += 0 if length & (length - 1) == 0 else window - length
    assert padding < 0.1 * sum(len(x) + 1 for x in ids)
    assert packing.pack_documents(docs.limit(0), "byte_bpe_50k.json").count() == 0


@pytest.mark.parametrize("window", [1, 16, 31])
def test_small_windows(spark, docs, window):
    pieces = packing.pack_documents(docs, "byte_bpe_50k.json", window).collect()
    lengths = {}
    for r in pieces:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= window
    assert sum(lengths.values()) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_cuts_are_optimal():
    """The monotone queue against all choices."""
    r = np.random.default_rng(3)
    for _ in range(30):
        places = np.unique(np.concatenate(([0], r.integers(1, 900, 40), np.arange(100, 1000, 100))))
        cost = r.choice([0.0, 1.0, 4.0], len(places))
        window = 128
        best = [0.0] + [np.inf] * (len(places) - 1)
        for b in range(1, len(places)):
            for a in range(b):
                n = places[b] - places[a]
                if n <= window:
                    free = n >= 64 and n & (n - 1) == 0
                    best[b] = min(best[b], best[a] + (0 if free else window - n) + cost[b] + packing.WINDOW)
        cuts = packing.best_cuts(places, cost, window)
        total, at = 0.0, 0
        for cut in cuts:
            n = cut - at
            total += (0 if n >= 64 and n & (n - 1) == 0 else window - n) + cost[list(places).index(cut)] + packing.WINDOW
            at = cut
        assert cuts[-1] == places[-1] and total == pytest.approx(best[-1])


def test_planes():
    r = np.random.default_rng(1)
    for ids in ([], [0], [0, 0, 0], [2**32 - 1, 1], r.integers(0, 50000, 1000)):
        a = np.asarray(ids, "<u4")
        assert (planes.from_planes(planes.to_planes(a), len(a)) == a).all()


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_files(spark, docs, block):
    folder = scratch_path(spark, "ids")
    planes.write_ids(docs, folder, "word_bpe_49k.json", block_ids=block)
    got = {}
    for r in planes.read_ids(spark, folder).collect():
        got[-1 if r.doc_id is None else r.doc_id] = (r.start, r.n_tokens, zlib.crc32(r.ids))
    ids = library("word_bpe_49k.json", ODD)
    start = 0
    for i in [5, *(i for i in range(len(ODD)) if i != 5)]:
        data = np.array([*ids[i], 1], "<u4").tobytes()
        assert got[i if i != 5 else -1] == (start, len(ids[i]) + 1, zlib.crc32(data))
        start += len(ids[i]) + 1
    index = spark.read.parquet(f"{folder}/index").orderBy("start").collect()
    assert [r.start for r in index] == [sum(x.n_ids for x in index[:k]) for k in range(len(index))]


def test_empty_files(spark, docs):
    folder = scratch_path(spark, "ids")
    planes.write_ids(docs.limit(0), folder, "word_bpe_49k.json")
    assert planes.read_ids(spark, folder).count() == 0
