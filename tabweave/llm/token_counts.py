"""Token counts of whole texts.

Arrow batches go to the tokenizer in calls of about equal bytes, and only
numbers come back.  Texts of more than ``SPLIT_CHARS`` characters are cut at
borders where the tokens of the parts provably add up to those of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.core.checks import c
from tabweave.llm.text import batch, map_batches
from tabweave.llm.tokens import encoder, tokenizer_path

CALL_BYTES = 1 << 20
SPLIT_CHARS = 1 << 18

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_MODELS: dict = {}


def _pieces(name: str):
    """The sentencepiece model, and whether single spaces are safe borders: no
    piece holds the space mark after its start and texts are not rewritten."""
    if name not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        safe = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        safe = safe and model.decode(model.encode(" a  b ")) == " a  b " and model.encode("a", out_type=str)[0][0] == "▁"
        _MODELS[name] = model, safe
    return _MODELS[name]


def split_safely(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters, cut at single spaces between other
    characters; the space goes, as the tokenizer puts one before each part."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if text[cut - 1] not in " ▁" and text[cut + 1] not in " ▁":
                break
            cut += 1
        if cut < 0:
            break
        parts.append(text[start:cut])
        start = cut + 1
    parts.append(text[start:])
    return parts


def _piece_counts(texts: list[str], name: str) -> list[int]:
    model, safe = _pieces(name)
    counts = [0] * len(texts)
    call: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for i, ids in zip(owners, model.encode(call, num_threads=1)):
            counts[i] += len(ids)
        call.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in split_safely(text, SPLIT_CHARS) if safe and len(text) > SPLIT_CHARS else [text]:
            call.append(part)
            owners.append(i)
            held += len(part)
            if held >= CALL_BYTES:
                flush()
                held = 0
    flush()
    return counts


def count_tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
                 limit: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` (and ``over_limit``) of each row.

    ``tokenizer`` is a path or the name of a public file: ``.model`` for
    sentencepiece, ``.json`` for a byte-level BPE of the tokenizers library.
    No begin, end or added special tokens, no truncation.  One row out for each
    row in, so repeated rows repeat; null and empty texts have 0 bytes and 0
    tokens; a null id stays null; other columns are not read.  An empty table
    gives an empty table.
    """
    pieces = tokenizer.endswith(".model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            if pieces:
                counts = _piece_counts(texts, tokenizer)
            else:
                counts = [len(ids) // 4 for ids in encoder(tokenizer).encode(texts)]
            yield batch(_OUT, b.column(0), [len(t) if t.isascii() else len(t.encode()) for t in texts], counts)

    out = map_batches(docs.select(c(id_column).cast("long").alias("doc_id"), c(text_column).cast("string").alias("text")),
                      run, "doc_id long, n_bytes long, n_tokens long")
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
