"""Language identification by cross-parsing.

A text is cut into the longest phrases that occur in a language's sample, from
left to right; a character that does not occur is a phrase of its own.  The
suffix automaton of the sample finds them: a phrase ends where the automaton
has no arc.  Each phrase names a place of the sample or a character, so it
costs log2(sample length + alphabet) bits, and the language whose phrases cost
least wins.

Automata are kept as shared rows, so that numpy parses many texts by all
languages in step: the arc of state s by character x lies in slot base[s] + x,
if that slot's ``owner`` is s, and leads to the slot's ``target``.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.core.scan import attach_measured
from tabweave.llm.text import batch, crc_mod, map_batches, strings
from tabweave.session import cut_lineage

HELD_OUT_OF, HELD_OUT = 3, 1
UNKNOWN = "und"
SAMPLE = 65_536  # characters of a language that its automaton holds
SAMPLE_BLOCK = 256  # drawn in blocks of so many characters
PARSED_BLOCK = 1024  # characters that are parsed from a fresh start
LANES = 2048  # blocks parsed in step
PACK = 32  # languages held at once

SPACE = 32
_NEVER = 1  # a character of no text: it stands between the blocks of a sample
# choices of a phrase beside the places of the sample
LITERALS = 256
_PARTS_SQL = "lang string, length long, base binary, owner binary, target binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("bits", pa.float64()), ("second", pa.float64()), ("lang_pred", pa.string())])
_FOUND_SQL = "doc_id long, bits double, second double, lang_pred string"


@functools.cache
def _characters() -> np.ndarray:
    """Per code point: itself for letters and the marks on them, space for all else."""
    out = np.full(sys.maxunicode + 1, SPACE, np.int64)
    for x in range(sys.maxunicode + 1):
        if unicodedata.category(chr(x))[0] in "LM":
            out[x] = x
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def normalised(text: str) -> np.ndarray:
    """The code points of a text in lower case, with one space for whatever lies between letters."""
    codes = _characters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    space = codes == SPACE
    return codes[~(space & np.concatenate(([False], space[:-1])))] if len(codes) else codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The arcs of each state; state 0 is the start."""
    arcs: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for x in codes:
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and x not in arcs[p]:
            arcs[p][x] = new
            p = link[p]
        if p != -1:
            q = arcs[p][x]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and arcs[p].get(x) == q:
                    arcs[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return arcs


def shared_rows(arcs: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, owner, target``: the rows of all states laid over each other, so that no two
    arcs share a slot.  Slots up to the largest character, and others without an arc, have the owner -1."""
    first = max((x for a in arcs for x in a), default=0) + 1
    taken = bytearray(first)
    base = np.full(len(arcs), 0, np.int64)
    start = {1: first}
    # long rows first; rows of one length are tried from where the last one went
    for s in sorted(range(len(arcs)), key=lambda s: -len(arcs[s])):
        keys = sorted(arcs[s])
        if not keys:
            break
        at = start.get(len(keys), first)
        while True:
            offset = at - keys[0]
            if len(taken) <= offset + keys[-1]:
                taken.extend(bytes(offset + keys[-1] + 1 - len(taken)))
            if not any(taken[offset + x] for x in keys):
                break
            at = taken.find(0, at + 1)
            if at < 0:
                at = len(taken)
        start[len(keys)] = at
        base[s] = offset
        for x in keys:
            taken[offset + x] = 1
    owner, target = np.full(len(taken), -1, np.int64), np.zeros(len(taken), np.int64)
    for s, a in enumerate(arcs):
        for x, t in a.items():
            owner[base[s] + x], target[base[s] + x] = s, t
    return base, owner, target


@dataclass(frozen=True)
class Pack:
    """The automata of several languages in one set of rows; the last state has no arcs."""

    langs: list[str]
    cost: np.ndarray  # bits of a phrase, per language
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    start: np.ndarray  # per language and character: the state after a phrase's first character

    @staticmethod
    def of(parts: list[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]) -> Pack:
        bases, owners, targets, starts = [], [], [], []
        states = slots = most = 0
        for _, _, base, owner, target in parts:
            # every character of a sample starts a phrase
            most = max(most, int(np.max(np.flatnonzero(owner == 0) - base[0], initial=0)))
            bases.append(base + slots)
            owners.append(np.where(owner < 0, -1, owner + states))
            targets.append(target + states)
            starts.append(states)
            states, slots = states + len(base), slots + len(owner)
        dead = states
        most += 1  # stands for the characters beyond those of all samples
        base = np.concatenate([*bases, [0]])
        owner = np.concatenate([*owners, np.full(most + 1, -1)])
        target = np.concatenate([*targets, np.zeros(most + 1, np.int64)])
        slots = base[starts][:, None] + np.arange(most + 1)[None, :]
        start = np.where(owner[slots] == np.array(starts)[:, None], target[slots], dead)
        cost = np.array([np.log2(length + LITERALS) for _, length, *_ in parts])
        return Pack([p[0] for p in parts], cost, base, owner, target, start)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Per language and text, the phrases of its blocks."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        lanes: list[tuple[int, np.ndarray]] = []
        for i, codes in enumerate(texts):
            for at in range(0, len(codes), PARSED_BLOCK):
                lanes.append((i, codes[at:at + PARSED_BLOCK]))
                if len(lanes) == LANES:
                    self._parse(lanes, out)
                    lanes = []
        if lanes:
            self._parse(lanes, out)
        return out

    def _parse(self, lanes: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        lanes.sort(key=lambda lane: -len(lane[1]))
        sizes = np.array([len(codes) for _, codes in lanes])
        text = np.zeros((sizes[0], len(lanes)), np.int64)
        for k, (_, codes) in enumerate(lanes):
            text[:len(codes), k] = codes
        np.minimum(text, self.start.shape[1] - 1, out=text)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than t
        state = np.full((len(self.langs), len(lanes)), len(self.base) - 1)
        hits = np.zeros(state.shape, np.int64)
        for t, k in enumerate(active):
            x = text[t, :k]
            now = state[:, :k]
            slot = self.base.take(now) + x
            hit = self.owner.take(slot) == now
            state[:, :k] = np.where(hit, self.target.take(slot), self.start.take(x, axis=1))
            hits[:, :k] += hit
        np.add.at(out, (slice(None), np.array([i for i, _ in lanes])), sizes - hits)


def _fit(rows) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of sample blocks, in the order of their hashes."""
    codes: list[int] = []
    for block in rows:
        found = normalised(block)
        if len(codes) + len(found) > SAMPLE:
            break
        codes += [*found.tolist(), _NEVER]
    return (len(codes), *shared_rows(suffix_automaton(codes)))


@dataclass(frozen=True)
class Model:
    """The automata of the learned languages, a row each, and their names in ascending order."""

    parts: DataFrame
    langs: list[str]

    def pack(self, langs: list[str]) -> Pack:
        """At most ``PACK`` automata of ``SAMPLE`` characters each."""
        rows = {r["lang"]: r for r in self.parts.where(F.col("lang").isin(langs)).collect()}
        read = lambda x: np.frombuffer(bytes(x), "<i4").astype(np.int64)
        return Pack.of([(lang, rows[lang]["length"], *(read(rows[lang][k]) for k in ("base", "owner", "target")))
                        for lang in langs])


def learned(doc_id: Column) -> Column:
    """Documents that a language may be learned from; a null id counts as empty text."""
    return crc_mod(doc_id, HELD_OUT_OF) != HELD_OUT


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> Model:
    """An automaton for each value of ``lang`` in the rows where ``learn`` holds.

    Each holds ``SAMPLE`` characters at most, in blocks of ``SAMPLE_BLOCK``
    drawn by hash from anywhere in the language's different texts, whole texts
    if they are fewer.  Rows with a null language, null or empty texts teach
    nothing; copies count once; a long text is as likely a source as its length
    says.  No rows, no languages.
    """
    rows = docs.where(learn).select(c(lang).cast("string").alias("lang"), c(text).cast("string").alias("text")).where(
        "lang is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    blocks = F.ceil(F.length("text") / SAMPLE_BLOCK).cast("long")
    sizes = rows.groupBy("lang", "h").agg(F.first(blocks).alias("n")).groupBy("lang").agg(F.sum("n").alias("blocks"))
    drawn = attach_measured(rows, sizes, ["lang"]).withColumn("at", F.explode(F.filter(
        F.sequence(F.lit(0).cast("long"), blocks - 1),
        # twice what is used, as some blocks shrink to nothing
        lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) * F.col("blocks") < F.lit((2 * SAMPLE // SAMPLE_BLOCK) << 30))))
    picked = drawn.select("lang", F.xxhash64("h", "at").alias("order"), F.expr(
        f"substring(text, cast(at * {SAMPLE_BLOCK} + 1 as int), {SAMPLE_BLOCK})").alias("block")).groupBy(
        "lang", "order").agg(F.min("block").alias("block"))

    def automaton(key, pdf):
        import pandas as pd
        length, *arrays = _fit(pdf.sort_values("order")["block"])
        return pd.DataFrame([[key[0], length, *(a.astype("<i4").tobytes() for a in arrays)]],
                            columns=["lang", "length", "base", "owner", "target"])

    # some 2 * SAMPLE / SAMPLE_BLOCK blocks in a group
    parts = cut_lineage(picked.groupBy("lang").applyInPandas(automaton, _PARTS_SQL))
    return Model(parts, sorted((r[0] for r in parts.select("lang").collect()), key=lambda x: x.encode()))


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each row.

    ``score`` is by how much the best language's bits lie below the next best's,
    as a share of those: 0 on a tie (the first language in UTF-8 order is
    taken), 1 if only one language is known.  Null and empty texts, texts
    without a letter, and all texts if no language is known, are ``und`` with
    the score 0.  Whole texts are parsed, in blocks of ``PARSED_BLOCK``
    characters; repeated rows repeat; other columns are not read.
    """
    rows = docs.select(c(id_column).cast("long").alias("doc_id"), F.lit(np.inf).alias("bits"), F.lit(np.inf).alias("second"),
                       F.lit(UNKNOWN).alias("lang_pred"), c(text).cast("string").alias("text"))
    packs = [model.langs[i:i + PACK] for i in range(0, len(model.langs), PACK)]
    for k, langs in enumerate(packs):
        last = k == len(packs) - 1
        held = docs.sparkSession.sparkContext.broadcast(model.pack(langs))

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = strings(b.column(4))
                bits = held.value.phrases([normalised(f" {t} ") for t in texts]) * held.value.cost[:, None]
                # the languages of earlier packs come first in order, so they win ties
                both = np.concatenate([[b.column(1).to_numpy()], bits])
                rank = np.argsort(both, axis=0, kind="stable")
                best = np.take_along_axis(both, rank[:1], 0)[0]
                second = np.minimum(np.take_along_axis(both, rank[1:2], 0)[0], b.column(2).to_numpy())
                names = [old if i == 0 else held.value.langs[i - 1] for i, old in zip(rank[0], b.column(3).to_pylist())]
                known = [has_letter(t) for t in texts]
                out = batch(_FOUND, b.column(0), [x if ok else None for x, ok in zip(best, known)], second,
                            [x if ok else UNKNOWN for x, ok in zip(names, known)])
                yield out if last else pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(best), pa.array(second), pa.array(names, pa.string()), b.column(4)],
                    names=b.schema.names)

        rows = map_batches(rows, run, _FOUND_SQL if last else rows.schema)
        if not last:
            # one pack at a time in memory
            rows = cut_lineage(rows)
    sure = F.when((F.col("lang_pred") == UNKNOWN) & F.col("bits").isNull(), 0.0).when(F.col("second") == np.inf, 1.0).otherwise(
        1 - F.col("bits") / F.col("second"))
    return rows.select("doc_id", "lang_pred", (sure if packs else F.lit(0.0)).alias("score"))
