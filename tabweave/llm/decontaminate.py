"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items build one automaton.  The words of a document
stream through it; at each word the automaton knows the longest run of words
that ends here and lies in some item.  A run as long as a window is a hit.

Items are taken in groups of at most ``GROUP_BYTES``, measured before anything
is sent out; each group is one automaton and one pass of the documents through
it, so a large benchmark costs passes, not memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.text import WORD_BYTES, batch, map_batches, text_words, utf8

WINDOW = 10
GROUP_BYTES = 1 << 20
_WORD = re.compile(rb"[^ ]+")


class ItemAutomaton:
    """The suffix automaton of several word lists."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        # the shortest run that can be a hit
        self.least = min([window, *(len(ids) for _, ids in coded)], default=window)
        self.items: dict[int, set[str]] = {}  # of the windows of full length, by the state that holds them
        self.short: dict[int, list[tuple[int, str | None]]] = {}  # items shorter than a window: length and name
        for name, ids in coded:
            if len(ids) < window:
                self.short.setdefault(self._walk(ids), []).append((len(ids), name))
                continue
            state = size = 0
            for w in ids:
                state, size = self._step(state, size, w)
                if size >= window:
                    held = self.items.setdefault(self.anchor(state), set())
                    if name is not None:
                        held.add(name)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # seen in an earlier item
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _walk(self, ids: list[int]) -> int:
        state = 0
        for w in ids:
            state = self.next[state][w]
        return state

    def _step(self, state: int, size: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, size + 1)

    def anchor(self, state: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The hit runs ``[first, last]`` of a text, apart and ascending, and
        the items with an occurring window."""
        found: set[str] = set()
        out: list[list[int]] = []
        known = bytes(map(self.words.__contains__, words))
        for run in re.finditer(rb"\x01{%d,}" % self.least, known):
            state = size = 0
            for i in range(run.start(), run.end()):
                state, size = self._step(state, size, self.words[words[i]])
                if size < self.least:
                    continue
                hit = 0
                if size >= self.window:
                    hit = self.window
                    found |= self.items[self.anchor(state)]
                if self.short:
                    s, matched = state, size
                    while s > 0:
                        for length, name in self.short.get(s, ()):
                            if length <= matched:
                                hit = max(hit, length)
                                if name is not None:
                                    found.add(name)
                        s = self.link[s]
                        matched = self.length[s]
                if hit:
                    first = i - hit + 1
                    while out and out[-1][0] >= first:
                        out.pop()
                    if out and first <= out[-1][1] + 1:
                        out[-1][1] = i
                    else:
                        out.append([first, i])
        return out, found


def item_groups(items: DataFrame, id_column: str, text_column: str) -> list[Callable[[], ItemAutomaton]]:
    """What makes the automaton of each group; a group's size is known to be bounded."""
    rows = items.select(c(id_column).cast("string").alias("id"),
                        F.coalesce(c(text_column).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0))).first()[0]
    groups = total // GROUP_BYTES + 1

    def automaton(g: int, window: int) -> ItemAutomaton:
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(groups)) == g)
        return ItemAutomaton([(r.id, text_words(r.text.encode())) for r in part.collect()], window)

    return [partial(automaton, g) for g in range(groups)]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def without_spans(data: bytes, spans: list[list[int]], shortest: int) -> bytes:
    """A text without the spans of at least ``shortest`` words."""
    words = [m.span() for m in _WORD.finditer(data.translate(WORD_BYTES))]
    out, at = [], 0
    for first, last in spans:
        if last - first + 1 >= shortest:
            out.append(data[at:words[first][0]])
            at = words[last][1]
    out.append(data[at:])
    return b"".join(out)


_SPAN, _NAMES = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())
_NO_SPANS, _NO_ITEMS = "cast(array() as array<array<int>>)", "cast(array() as array<string>)"


def _through(rows: DataFrame, automata: list, window: int, at: int, finish: Callable, schema) -> DataFrame:
    """The rows, whose last two columns are spans and items, through all
    automata; the last pass hands each batch to ``finish``."""
    for k, make in enumerate(automata):
        held = rows.sparkSession.sparkContext.broadcast(make(window))
        last = k == len(automata) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            match = held.value.spans
            for b in batches:
                spans, items = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                counts = []
                for i, data in enumerate(utf8(b.column(at))):
                    words = text_words(data)
                    counts.append(len(words))
                    more, found = match(words)
                    if more:
                        spans[i] = _merged(spans[i] + more)
                        items[i] = sorted(found.union(items[i]))
                if last:
                    yield finish(b, counts, spans, items)
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(spans, _SPAN), pa.array(items, _NAMES)],
                                                     names=b.schema.names)

        rows = map_batches(rows, run, schema if last else rows.schema)
    return rows


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
                text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items`` of each row.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower
    case.  ``spans`` are the hit runs ``[first, last]`` of word numbers, apart
    and ascending; a word is hit if it lies in an occurrence of ``window``
    consecutive item words, or of a whole item of fewer.  ``items`` are the
    item ids, as text, with such an occurrence; an item with a null id is
    matched but not listed, a null or empty item matches nothing.  Null and
    empty documents have no words.  Repeated rows repeat; other columns are
    not read; an empty table on either side gives no hits.
    """
    rows = docs.select(c(id_column).cast("long").alias("doc_id"), c(text_column).cast("string").alias("text"),
                       F.expr(_NO_SPANS).alias("spans"), F.expr(_NO_ITEMS).alias("items"))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN), ("items", _NAMES)])

    def finish(b, counts, spans, items):
        return batch(out, b.column(0), counts, spans, items)

    return _through(rows, item_groups(items, item_column, item_text), window, 1, finish,
                    "doc_id long, n_words long, spans array<array<int>>, items array<string>")


def remove_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, shortest_span: int = 1,
                 most_coverage: float = 0.5, text_column: str = "text", length_column: str = "n_chars",
                 item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with their own columns, without what lies in the items.

    Spans of at least ``shortest_span`` words are cut out of the text;
    ``length_column``, if there is one, becomes the new length.  A document
    with more than ``most_coverage`` of its words hit goes.  All other rows
    stay as they are, null and empty texts and repeated rows too; an empty
    table gives an empty table.
    """
    names = docs.columns
    at = names.index(text_column)
    size = names.index(length_column) if length_column in names else None
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = plain.withColumns({"_spans": F.expr(_NO_SPANS), "_items": F.expr(_NO_ITEMS)})

    def finish(b, counts, spans, items):
        columns = list(b.columns[:-2])
        keep = [True] * b.num_rows
        if any(spans):
            texts = columns[at].to_pylist()
            sizes = columns[size].to_pylist() if size is not None else [None] * b.num_rows
            for i, found in enumerate(spans):
                if found:
                    keep[i] = sum(last - first + 1 for first, last in found) <= most_coverage * counts[i]
                    left = without_spans(texts[i].encode(), found, shortest_span).decode()
                    if left != texts[i]:
                        texts[i], sizes[i] = left, len(left)
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                columns[size] = pa.array(sizes, columns[size].type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return _through(rows, item_groups(items, item_column, item_text), window, at, finish, plain.schema).toDF(*names)
