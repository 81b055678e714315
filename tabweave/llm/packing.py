"""Order-preserving packing of documents into training sequences.

The ids of the documents, in table order, are one long tape.  Cuts may lie at
document ends, at sentence ends and, at a higher price, every ``GRID`` ids
inside a longer sentence.  Dynamic programming over these places picks the cuts
with the least padding plus truncation penalties; the best start of a window
comes from a monotone queue, so each place costs constant time.  Each task packs
its own part of the table, a block of the tape at a time; the last, unfilled
window of a block is carried into the next one.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.text import batch, map_batches
from tabweave.llm.tokens import encoder, tokenizer_path

GRID = 32
# ids in a block: about 250 windows of 2048
BLOCK = 1 << 19
# penalties, in padded ids
SENTENCE_CUT = 1.0
INNER_CUT = 4.0
WINDOW = 0.25
# shortest power of two that a window is cut to on purpose, but for the tail
LEAST_EXACT = 64

_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                  ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def sentence_ends(tokenizer: str) -> np.ndarray:
    """A flag for each id: its text ends a sentence (a line end, or . ! ?)."""
    with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 2, bool)
    for token, i in vocab.items():
        # in the byte-level alphabet a line end is written U+010A
        out[i] = token.removesuffix("</w>").rstrip("\"')»”")[-1:] in (".", "!", "?", "Ċ")
    return out


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """The places where a cut may lie, ``grid`` ids apart at most, with its penalty.
    ``ends`` are the document ends; the first place is 0."""
    marks = np.flatnonzero(sentence[np.minimum(ids, len(sentence) - 1)]) + 1
    natural = np.union1d(marks, np.concatenate(([0], ends)))
    gaps = np.diff(natural)
    inside = np.maximum((gaps - 1) // grid, 0)
    if inside.sum():
        starts = np.repeat(natural[:-1], inside)
        step = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside) + 1
        places = np.concatenate((natural, starts + step * grid))
        cost = np.concatenate((np.full(len(natural), SENTENCE_CUT), np.full(inside.sum(), INNER_CUT)))
        order = np.argsort(places, kind="stable")
        places, cost = places[order], cost[order]
    else:
        places, cost = natural, np.full(len(natural), SENTENCE_CUT)
    cost[np.searchsorted(places, ends)] = 0.0
    cost[0] = 0.0
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """The chosen places (without the first), left to right.

    A window from place a to b costs ``window - (b - a)`` of padding, none if
    its length is a power of two, plus the penalty of the cut at b.  With
    f(a) = best(a) + a the first case is a sliding minimum over f, which a
    monotone queue holds; the powers of two are exact steps back.
    """
    n = len(places)
    exact: dict[int, list[int]] = {}
    size = window // 2
    while size >= LEAST_EXACT:
        j = np.minimum(np.searchsorted(places, places - size), n - 1)
        for b in np.flatnonzero((places >= size) & (places[j] == places - size)).tolist():
            exact.setdefault(b, []).append(int(j[b]))
        size //= 2
    at, price = places.tolist(), cost.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for b in range(1, n):
        here = at[b]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        f, a = queue[0]
        value = f + window - here
        if b in exact:
            for e in exact[b]:
                if best[e] < value:
                    value, a = best[e], e
        value += price[b] + WINDOW
        best[b], back[b] = value, a
        f = value + here
        while queue and queue[-1][0] >= f:
            queue.pop()
        queue.append((f, b))
    cuts, b = [], n - 1
    while b > 0:
        cuts.append(at[b])
        b = back[b]
    return cuts[::-1]


def last_window(length: int, window: int) -> list[int]:
    """How the tail of a tape is cut: into powers of two, as far as the padding
    saved is worth the cuts."""
    out = []
    while length:
        power = 1 << (length.bit_length() - 1)
        if power == length or (window - length) <= bin(length).count("1") * (INNER_CUT + WINDOW):
            out.append(length)
            break
        out.append(power)
        length -= power
    return out


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of all documents, in sequences of at most ``window`` ids.

    A document's ids are those of its whole text and ``end_id``.  Columns:
    ``doc_id, start`` (ids of the document before the piece), ``length``,
    ``ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id,
    offset``.  Each id lies in one piece.  Null and empty texts are the end id
    alone; repeated rows and null ids are packed like others; other columns
    are not read; an empty table gives no piece.
    """
    window = int(window)
    if window < 1:
        raise ValueError("window must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentence = sentence_ends(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        held: list[list] = []  # doc_id, ids, start of what is left
        size = 0

        def solve(last: bool) -> pa.RecordBatch | None:
            nonlocal held, size, sequence
            parts = [np.frombuffer(d, "<u4")[s:] for _, d, s in held]
            tape = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            cuts = best_cuts(*cut_places(tape, ends, sentence, min(GRID, window)), window)
            if len(cuts) > 1 or last:
                final = cuts.pop()
                begin = cuts[-1] if cuts else 0
                if last:
                    for step in last_window(final - begin, window):
                        begin += step
                        cuts.append(begin)
            rows: list[tuple] = []
            k, at, done = 0, 0, 0  # document, tape position, ids of the document used
            for cut in cuts:
                offset = 0
                while at < cut:
                    doc, data, start = held[k]
                    n = min(int(ends[k]), cut) - at
                    first = start + done
                    rows.append((doc, first, n, data[first * 4:(first + n) * 4], len(data) // 4, sequence, offset))
                    at, offset, done = at + n, offset + n, done + n
                    if at == ends[k]:
                        k, done = k + 1, 0
                sequence += 1
            held = held[k:]
            if held and done:
                held[0] = [held[0][0], held[0][1], held[0][2] + done]
            size = len(tape) - at
            return batch(_OUT, *zip(*rows)) if rows else None

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(),
                                encoder(tokenizer).encode([t or "" for t in b.column(1).to_pylist()])):
                held.append([doc, ids + end, 0])
                size += len(ids) // 4 + 1
                if size >= max(BLOCK, 4 * window):
                    out = solve(False)
                    if out is not None:
                        yield out
        if held:
            yield solve(True)

    return map_batches(docs.select(c(id_column).cast("long").alias("doc_id"),
                                   F.coalesce(c(text_column).cast("string"), F.lit("")).alias("text")), run, SCHEMA)
