"""Language-model scores by a weighted backoff automaton.

Counts are taken over all training texts, those of n-grams by length behind
sieves of the shorter ones.  The model is a trigram model with
absolute discounting whose unigrams are smoothed by adding 0.1.  Every n-gram
of any tokens that occurs at least ``LEAST_NGRAM`` times is kept, whatever the
corpus; the backoff weights make the probabilities after any context sum to 1.

Kept contexts are the states of an automaton and kept n-grams its arcs; a failure
arc costs the state's backoff weight and leads to the context without its first
token.  All arcs live in one table by n-gram hash.  Texts are dealt to blocks; a
block fetches the arcs that its texts can meet by one join, builds that part of the
automaton, and every text is read on it once, from left to right.  Tasks hold the
frequent entries: tokens that make up 1/``COMMON`` of the corpus and n-grams that
occur once in ``HELD`` tokens, so no key of the join is frequent; a sieve of the
kept n-grams keeps most others from being asked for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.ngrams import BREAK, PIECE_BYTES, frequent_ngrams, in_sieve, key_sieve, pieces
from tabweave.llm.text import batch, crc_mod_of, map_batches, space_words, utf8
from tabweave.session import cut_lineage, scratch_path, short_shuffles

COMMON = 500_000
LEAST_COMMON = 50  # and common tokens occur so often at least
HELD = 1_000_000
LEAST_NGRAM = 5  # kept n-grams occur so often at least
DISCOUNT = 0.75
ADD = 0.1
HELD_OUT_OF = 10
END = b""  # no word is empty
START = b" "  # no word is a space
# entries that a task gathers before it hands them on
GATHERED = 400_000
# texts of one block, about
BLOCK_BYTES = 4 << 20
# keys that a task gathers before it asks for them
ASKED = 2_000_000
# shares of the blocks that are scored one after the other, so that what they ask for and fetch is not on disk at once
WAVES = 4

_COUNT = pa.schema([("token", pa.int64()), ("n_all", pa.int64()), ("n_train", pa.int64())])
_NGRAM = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])
_ASKED = pa.schema([("block", pa.int32()), ("key", pa.int64())])
_SCORED = pa.schema([("text_a", pa.int64()), ("text_b", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "text_a long, text_b long, n_tokens long, n_known long, base_score double, score double"


def token_hashes(words) -> np.ndarray:
    """A 64-bit number for each token; it stands for the token everywhere."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def ngram_keys(*tokens: np.ndarray) -> np.ndarray:
    """A 64-bit number for each n-gram, from the numbers of its tokens."""
    key = np.full(len(tokens[0]), len(tokens), np.uint64)
    for t in tokens:
        key = (key ^ t.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def find_sorted(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys among ascending ones, and which of them are there; keys are looked up in
    ascending order, as steps to and fro cost more than sorting."""
    if not len(held):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(held, keys[order])
    at = np.minimum(at, len(held) - 1)
    return at, held[at] == keys


@dataclass
class Unigrams:
    """The common tokens, by ascending hash, with their training counts."""

    tokens: np.ndarray
    counts: np.ndarray
    frequent: np.ndarray | None  # which of them take part in n-grams; None: these and all rare ones
    total: int  # training tokens
    distinct: int  # distinct training tokens
    ids: dict = field(default_factory=dict)  # of words met so far

    def __getstate__(self):
        return {**self.__dict__, "ids": {}}

    def log_weight(self, count) -> np.ndarray:
        return np.log10((count + ADD) / (self.total + ADD * (self.distinct + 1)))

    def look_up(self, words: list[bytes]) -> list[int]:
        """The number of each token, -1 for a rare one."""
        out = list(map(self.ids.get, words))
        if None in out:
            unknown = list({w for w, i in zip(words, out) if i is None})
            h = token_hashes(unknown)
            at = np.minimum(np.searchsorted(self.tokens, h), max(len(self.tokens) - 1, 0))
            common = self.tokens[at] == h if len(self.tokens) else np.zeros(len(h), bool)
            # only common words are remembered, so the memory has their bound
            self.ids.update((w, int(i)) for w, i, ok in zip(unknown, at, common) if ok)
            out = [-1 if i is None else i for i in map(self.ids.get, words)]
        return out


@dataclass
class Weights:
    """N-grams by ascending key: the log10 probability of each as an arc, and
    its backoff weight as a context."""

    keys: np.ndarray
    arcs: np.ndarray
    backs: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which of them are held."""
        return find_sorted(self.keys, keys)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(c(id_column).cast("long").alias("doc_id"), c(text_column).cast("string").alias("text"))


def token_counts(rows: DataFrame, held_out_of: int) -> DataFrame:
    """``token, n_all, n_train`` over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, held = Counter(), Counter()

        def hand_on():
            for counts, of in ((train, 1), (held, 0)):
                n = np.fromiter(counts.values(), np.int64, len(counts))
                yield batch(_COUNT, token_hashes(counts.keys()), n, n * of)
                counts.clear()

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                counts = train if crc_mod_of(doc, held_out_of) else held
                counts.update(space_words(data))
                counts[END] += 1
            if len(train) + len(held) > GATHERED:
                yield from hand_on()
        yield from hand_on()

    counted = map_batches(rows, run, "token long, n_all long, n_train long")
    return counted.groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


_STOP = re.compile(rb"[\x20\x09-\x0D]")
# the ends of a text inside n-grams that are still text: characters that no word holds
_START, _END = b"\x0c", b"\r"


def _text_tokens(held_out_of: int):
    def tokens(b: pa.RecordBatch, overlap: int) -> Iterator[tuple[str, list[bytes]]]:
        """The training texts of a batch (``doc_id, text``), all in one group."""
        found: list[bytes] = []
        for doc, data in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            if not crc_mod_of(doc, held_out_of):
                continue
            found.append(_START)
            for part in pieces(data, _STOP, space_words, 0):
                # what a piece holds goes on after the piece before it, so n-grams reach across
                found += part
                if len(found) > PIECE_BYTES:
                    tail = found[len(found) - overlap:] if overlap else []
                    yield "", found
                    found = tail
            found += (_END, BREAK)
        if found:
            yield "", found
    return tokens


def ngram_counts(rows: DataFrame, unigrams: Unigrams, held_out_of: int, least: int) -> DataFrame:
    """``a, b, c, n``: the bigrams (``c`` is null) and trigrams that occur ``least`` times in the training texts."""
    counted, _ = frequent_ngrams(rows, _text_tokens(held_out_of), 3, least)
    start, end = token_hashes([START])[0], token_hashes([END])[0]
    allowed = None if unigrams.frequent is None else np.append(unigrams.tokens[unigrams.frequent], start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(words: list[str]) -> np.ndarray:
            raw = [w.encode() for w in words]
            out = token_hashes(raw)
            out[[w == _START for w in raw]] = start
            out[[w == _END for w in raw]] = end
            return out

        for b in batches:
            prefixes = [p.split(" ") for p in b.column(0).to_pylist()]
            x = [numbers([p[k] for p in prefixes]) for k in range(len(prefixes[0]))] if prefixes else []
            x.append(numbers(b.column(1).to_pylist()))
            ok = np.ones(b.num_rows, bool) if allowed is None else np.all([np.isin(v, allowed) for v in x], axis=0)
            x = [pa.array(v) for v in x] + [pa.nulls(b.num_rows, pa.int64())] * (3 - len(x))
            yield pa.RecordBatch.from_arrays([*x, b.column(2)], schema=_NGRAM).filter(pa.array(ok))

    two, three = (map_batches(x.select("prefix", "next", "n"), run, "a long, b long, c long, n long") for x in counted[1:])
    return two.union(three)


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, with the key of the n-gram in these columns."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = ngram_keys(*[b.column(names.index(k)).to_numpy(zero_copy_only=False) for k in columns])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*names, "key"])

    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return map_batches(df, run, f"{kinds}, key long")


def ngram_weights(kept: DataFrame, counts: DataFrame, unigrams: Unigrams, texts: int) -> DataFrame:
    """``key, n, arc, back`` of each kept n-gram and of each token that is a context:
    its log10 probability and its log10 backoff weight."""
    start = int(token_hashes([START])[0])
    seen = counts.where("n_train > 0")
    totals = seen.select(F.col("token").alias("a"), F.col("n_train").alias("total")).union(
        kept.sparkSession.createDataFrame([(start, texts)], "a long, total long"))
    below = seen.select(F.col("token").alias("b"), ((F.col("n_train") + F.lit(ADD)) / F.lit(
        unigrams.total + ADD * (unigrams.distinct + 1))).alias("q"))

    def back(p: str, q: str) -> Column:
        # what the kept followers leave over, spread as after the shorter context
        least = F.lit(1e-9)
        return F.log10(F.greatest(1 - F.sum(p), least) / F.greatest(1 - F.sum(q), least))

    share = F.greatest(F.col("n") - DISCOUNT, F.lit(1e-9)) / F.col("total")
    two = cut_lineage(kept.where("c is null").join(totals, "a").join(below, "b").select("a", "b", "n", share.alias("p"), "q"))
    three = kept.where("c is not null").join(two.select("a", "b", F.col("n").alias("total")), ["a", "b"]).join(
        two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("p").alias("q")), ["b", "c"])
    three = cut_lineage(three.select("a", "b", "c", "n", share.alias("p"), "q"))
    one = two.groupBy("a").agg(back("p", "q").alias("back"), F.sum("n").alias("n"))
    pair = three.groupBy("a", "b").agg(back("p", "q").alias("back"))
    log = F.log10("p").alias("arc")
    backs = F.coalesce("after", F.lit(0.0)).alias("back")
    arcs2 = two.select("a", "b", "n", log).join(
        pair.withColumnRenamed("back", "after"), ["a", "b"], "left").select("a", "b", "n", "arc", backs)
    arcs3 = three.select("a", "b", "c", "n", log, F.lit(0.0).alias("back"))
    single = one.select("a", "n", F.lit(0.0).alias("arc"), "back")
    parts = [_keyed(x, k).select("key", "n", "arc", "back") for x, k in ((single, ["a"]), (arcs2, ["a", "b"]),
                                                                         (arcs3, ["a", "b", "c"]))]
    return parts[0].union(parts[1]).union(parts[2])


@dataclass
class LanguageModel:
    unigrams: Unigrams
    weights: Weights
    counts_path: str  # the counts of all tokens
    weights_path: str  # the weights of all n-grams
    sieve: np.ndarray  # of the keys of all n-grams


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out_of: int = HELD_OUT_OF,
        common: int = COMMON, least_common: int = LEAST_COMMON, vocabulary: int | None = None, ngrams: int | None = None,
        least_ngram: int = LEAST_NGRAM, held: int = HELD) -> LanguageModel:
    """Learn from the rows whose ``crc32(doc_id) mod held_out_of`` is not 0.
    Null and empty texts are an end alone; repeated rows count each time.

    ``vocabulary`` and ``ngrams``, if given, keep only n-grams of common tokens
    with a share of at least 1/``vocabulary``, or that occur once in ``ngrams`` tokens.
    """
    with short_shuffles(docs.sparkSession):
        return _fit(_rows(docs, id_column, text_column), held_out_of, common, least_common, vocabulary, ngrams, least_ngram, held)


def _fit(rows: DataFrame, held_out_of: int, common: int, least_common: int, vocabulary: int | None, ngrams: int | None,
         least_ngram: int, held: int) -> LanguageModel:
    spark = rows.sparkSession
    path = scratch_path(spark, "token-counts")
    token_counts(rows, held_out_of).write.parquet(path)
    counts = spark.read.schema("token long, n_all long, n_train long").parquet(path)
    end = int(token_hashes([END])[0])
    everything, total, distinct, texts = counts.agg(
        F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)),
        F.count(F.when(F.col("n_train") > 0, 1)),
        F.coalesce(F.sum(F.when(F.col("token") == end, F.col("n_train"))), F.lit(0))).first()
    # at most ``common`` tokens have that share
    top = counts.where(F.col("n_all") >= max(least_common, everything / common)).toArrow().sort_by("token")
    frequent = None if vocabulary is None else top.column("n_all").to_numpy() >= everything / vocabulary
    unigrams = Unigrams(top.column("token").to_numpy(), top.column("n_train").to_numpy(), frequent, total, distinct)
    least = least_ngram if ngrams is None else max(least_ngram, math.ceil(total / ngrams))
    kept = cut_lineage(ngram_counts(rows, unigrams, held_out_of, least))
    weights_path = scratch_path(spark, "ngram-weights")
    ngram_weights(kept, counts, unigrams, texts).write.parquet(weights_path)
    # at most ``held`` n-grams of each order are that frequent
    grams = spark.read.schema("key long, n long, arc double, back double").parquet(weights_path)
    often = grams.where(F.col("n") >= total / held).drop("n").toArrow().sort_by("key")
    weights = Weights(*[often.column(x).to_numpy() for x in ("key", "arc", "back")])
    return LanguageModel(unigrams, weights, path, weights_path, key_sieve(grams.select("key"), grams.count()))


@dataclass
class Block:
    """Texts as numbers of their words: each text is a start, its words and an end."""

    words: list[bytes]  # by number; the start is 0, the end 1
    ids: np.ndarray
    lengths: np.ndarray  # numbers of each text, with both ends

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        numbers = {START: 0, END: 1}
        found = [[0, *[numbers.setdefault(w, len(numbers)) for w in space_words(data)], 1] for data in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.int64, int(lengths.sum()))
        return cls(list(numbers), ids, lengths)

    def ngrams(self):
        """Distinct bigrams as ``first * words + second``, ascending, and trigrams as
        ``bigram's place * words + third``; and which of them ends at each number.
        Those across two texts are among them, as they are no n-grams of the model."""
        size = len(self.words)
        two, at_two = np.unique(self.ids[:-1] * size + self.ids[1:], return_inverse=True)
        three, at_three = np.unique(at_two[:-1] * size + self.ids[2:], return_inverse=True)
        return two, at_two, three, at_three


def ngram_keys_of(block: Block, hashes: np.ndarray, two: np.ndarray, three: np.ndarray) -> list[np.ndarray]:
    """The keys of a block's words as contexts, of its bigrams and of its trigrams."""
    size = len(block.words)
    first, second = hashes[two // size], hashes[two % size]
    pair = three // size
    return [ngram_keys(hashes), ngram_keys(first, second), ngram_keys(first[pair], second[pair], hashes[three % size])]


def asked_keys(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``block, key`` of the rare tokens of a block's texts and of the n-grams
    that the sieve lets through and tasks do not hold, once a task or more often."""
    held = rows.sparkSession.sparkContext.broadcast((model.unigrams, model.weights, model.sieve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, sieve = held.value
        gathered: list[tuple[np.ndarray, np.ndarray]] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not gathered:
                return
            place, key = map(np.concatenate, zip(*gathered))
            gathered.clear()
            order = np.lexsort((place, key))
            place, key = place[order], key[order]
            new = np.append(True, (place[1:] != place[:-1]) | (key[1:] != key[:-1]))
            place, key = place[new], key[new]
            for i in range(0, len(key), 1 << 20):
                yield batch(_ASKED, place[i:i + (1 << 20)], key[i:i + (1 << 20)])

        for b in batches:
            block = Block.of(utf8(b.column(1)))
            if not len(block.ids):
                continue
            of = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), block.lengths)
            hashes = token_hashes(block.words)
            two, at_two, three, at_three = block.ngrams()
            rare = np.array(known.look_up(block.words)) < 0
            rare[0] = False  # the start is no token
            groups = [(hashes, rare, block.ids, of)]
            for keys, at, end in zip(ngram_keys_of(block, hashes, two, three), (block.ids, at_two, at_three), (0, 1, 2)):
                groups.append((keys, ~weights.find(keys)[1] & in_sieve(sieve, keys.view(np.uint64)), at, of[end:]))
            for keys, wanted, at, place in groups:
                here = wanted[at]
                found = np.unique(place[here] * len(keys) + at[here])
                if len(found):
                    gathered.append(((found // len(keys)).astype(np.int32), keys[found % len(keys)]))
            if sum(len(x[0]) for x in gathered) > ASKED:
                yield from hand_on()
        yield from hand_on()

    return map_batches(rows.select("block", "text"), run, "block int, key long")


@dataclass
class Automaton:
    """What a block's texts can meet: state 0 is the empty context; an arc's
    code is ``state * words + word``, and arcs lie by ascending code."""

    words: int
    codes: np.ndarray
    logs: np.ndarray  # log10 probability of each arc
    targets: np.ndarray  # the state that each arc leads to
    failure: np.ndarray  # each state's context without its first token
    back: np.ndarray  # what the failure arc adds
    start: int

    @property
    def failures(self) -> list[int]:
        return self.failure.tolist()

    @property
    def backs(self) -> list[float]:
        return self.back.tolist()

    def _arcs(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of these words from these states, and which of them exist."""
        return find_sorted(self.codes, states * self.words + words)

    def steps(self, ids: np.ndarray) -> np.ndarray:
        """The log10 probability of each word but the first after those before it, all words at once.

        A state holds two tokens at most, so the state after a word follows from the word and the one before:
        the target of its arc from the state of that one alone, else its own state."""
        last, word = ids[:-1], ids[1:]
        alone = self.targets[:self.words]  # the empty context has an arc for every word, before all others
        short, found = self._arcs(alone[last], word)
        after = np.concatenate([alone[ids[:1]], np.where(found, self.targets[short], alone[word])])
        state, total, left = after[:-1].copy(), np.zeros(len(word)), np.arange(len(word))
        while len(left):
            arc, found = self._arcs(state[left], word[left])
            total[left[found]] += self.logs[arc[found]]
            left = left[~found]
            total[left] += self.back[state[left]]
            state[left] = self.failure[state[left]]
        return total

    def read(self, text: list[int]) -> float:
        """The log10 probability of the words and the end of a text."""
        return float(self.steps(np.array([0, *text], np.int64)).sum())


def build_automaton(block: Block, hashes: np.ndarray, unigram_logs: np.ndarray, tables: list[Weights]) -> Automaton:
    """The states and arcs of the n-grams in a block that one of the tables holds."""
    size = len(block.words)
    two, _, three, _ = block.ngrams()

    def find(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept, log, back = np.zeros(len(keys), bool), np.zeros(len(keys)), np.zeros(len(keys))
        for t in tables:
            at, ok = t.find(keys)
            if ok.any():
                kept |= ok
                log[ok], back[ok] = t.arcs[at[ok]], t.backs[at[ok]]
        return kept, log, back

    (is_state, _, back1), (kept2, log2, back2), (kept3, log3, _) = map(find, ngram_keys_of(block, hashes, two, three))
    token_state = np.where(is_state, np.cumsum(is_state), 0)
    pair_state = np.where(kept2, int(is_state.sum()) + np.cumsum(kept2), 0)
    second = two % size
    # a kept trigram's last two tokens are a kept bigram
    pair, third = three[kept3] // size, three[kept3] % size
    after, _ = find_sorted(two, second[pair] * size + third)
    codes = np.concatenate([np.arange(size), token_state[two[kept2] // size] * size + second[kept2],
                            pair_state[pair] * size + third])
    order = np.argsort(codes, kind="stable")
    return Automaton(size, codes[order], np.concatenate([unigram_logs, log2[kept2], log3[kept3]])[order],
                     np.concatenate([token_state, pair_state[kept2], pair_state[after]])[order],
                     np.concatenate([np.zeros(1 + int(is_state.sum()), np.int64), token_state[second[kept2]]]),
                     np.concatenate([[0.0], back1[is_state], back2[kept2]]), int(token_state[0]))


def score_block(texts: list[bytes], known: Unigrams, held: Weights, fetched: Weights, counts: Weights):
    """Per text: tokens, known tokens, log10 probability by unigrams and by the
    automaton; ``counts`` holds the counts of rare tokens as its ``arcs``."""
    block = Block.of(texts)
    hashes = token_hashes(block.words)
    n = np.zeros(len(hashes), np.int64)
    common = np.array(known.look_up(block.words))
    n[common >= 0] = known.counts[common[common >= 0]]
    at, ok = counts.find(hashes)
    rare = ok & (common < 0)
    n[rare] = counts.arcs[at[rare]]
    logs = known.log_weight(n)
    automaton = build_automaton(block, hashes, logs, [held, fetched])
    edges = np.cumsum(block.lengths) - block.lengths
    is_known, weight = n > 0, logs.copy()
    is_known[0], weight[0] = False, 0.0  # the start is no token
    steps = np.append(0.0, automaton.steps(block.ids))
    steps[edges] = 0.0  # the start of a text is no token
    scores = np.add.reduceat(steps, edges)
    return (block.lengths - 1, np.add.reduceat(is_known[block.ids].astype(np.int64), edges),
            np.add.reduceat(weight[block.ids], edges), scores)


def score(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text",
          held_out_of: int = HELD_OUT_OF) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of each row.

    Tokens are runs of other than white space, A-Z in lower case, and one end.
    ``score`` is the model's log10 probability of the text, ``base_score`` that
    of the smoothed unigrams alone.  Equal texts are read once, so a text that
    fills a third of the table is one row of its block.  Null and empty texts are an end alone; a
    null id is held out; repeated rows repeat; other columns are not read; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    named = _rows(docs, id_column, text_column).withColumn("text", F.coalesce("text", F.lit("")))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // BLOCK_BYTES + 1
    # texts are told apart by two 64-bit hashes
    named = named.withColumns({"text_a": F.xxhash64("text"), "text_b": F.xxhash64(F.lit(1), "text")})
    rows = named.withColumn("block", F.pmod("text_a", F.lit(blocks)).cast("int"))
    counts = spark.read.schema("token long, n_all long, n_train long").parquet(model.counts_path).where("n_train > 0")
    grams = spark.read.schema("key long, n long, arc double, back double").parquet(model.weights_path)
    table = counts.select(F.col("token").alias("key"), "n_train", F.lit(0.0).alias("arc"), F.lit(0.0).alias("back")).union(
        grams.select("key", F.lit(0).cast("long"), "arc", "back"))
    held = spark.sparkContext.broadcast((model.unigrams, model.weights))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _SCORED.empty_table()
        known, weights = held.value
        key, n, arc, back = (found.column(k).to_numpy() for k in ("key", "n_train", "arc", "back"))
        order = np.argsort(key)
        key, n, arc, back = key[order], n[order], arc[order], back[order]
        gram = n == 0
        scored = score_block(utf8(texts.column("text").combine_chunks()), known, weights,
                             Weights(key[gram], arc[gram], back[gram]), Weights(key[~gram], n[~gram], back[~gram]))
        columns = [texts.column("text_a"), texts.column("text_b"), *scored]
        return pa.table([pa.array(x, t.type) if not isinstance(x, pa.ChunkedArray) else x
                         for x, t in zip(columns, _SCORED)], schema=_SCORED)

    path = scratch_path(spark, "scored-texts")
    with short_shuffles(spark):
        for wave in range(WAVES):
            mine = rows.where(F.col("block") % WAVES == wave)
            fetched = asked_keys(mine, model).join(table, "key").select("block", "key", "n_train", "arc", "back")
            once = mine.groupBy("block", "text_a", "text_b").agg(F.first("text").alias("text"))
            once.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(run, _SCORED_SQL).write.mode("append").parquet(path)
    scored = spark.read.schema(_SCORED_SQL).parquet(path)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return named.select("doc_id", "text_a", "text_b").join(scored, ["text_a", "text_b"]).select(
        "doc_id", (F.crc32(key) % held_out_of == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.unigrams.total).cast("long").alias("train_tokens"), "base_score", "score")
