"""Exact token ids at the speed of a lookup.

The tokenizers cut a text into words that never influence each other.  A task
has the library encode each distinct word once, a group at a time, and looks
repeated words up.  A text with word borders that are not provably safe goes to
the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import islice

import numpy as np

# words that one Python worker remembers; beyond it the later half is forgotten
REMEMBERED = 1_000_000
# words that the library gets in one call
GROUP = 50


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is, or the place of a file of the public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, as the
    tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, name: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end = spec["model"].get("end_of_word_suffix") or ""
        # words with an end mark drop white space, others carry the space before them
        self.drops_space = end != ""
        sizes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in spec["model"]["vocab"].items():
            sizes[i] = len(token.removesuffix(end)) if end and token != end else len(token)
        self.sizes = sizes  # bytes of each id: the byte-level alphabet has a character a byte
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.safe = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]
                            for t in spec["added_tokens"])
        # what the library must see alone: special strings, and white space if it vanishes
        self.odd = re.compile("|".join([*map(re.escape, self.special), *([r"\s"] if self.drops_space else [])]) or "(?!)")
        self.known: dict[str, bytes | None] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encoded]

    def _plain(self, word: str) -> bool:
        """May a word beyond ASCII share a call with others?  Its length must not change."""
        return not self.drops_space or (unicodedata.is_normalized("NFC", word)
                                        and len(word.lower().encode()) == len(word.encode()))

    def _learn(self, words: set[str]) -> None:
        known, odd = self.known, self.odd.search
        plain, alone = [], []
        for key in words.difference(known):
            if self.drops_space:
                word = key
            else:
                body = key[1:] if key[:1] == "\n" else key
                if body == "" or body[0].isspace() or body[-1].isspace():
                    known[key] = None  # an unsafe border
                    continue
                word = key if body is not key else " " + key
            if odd(word) is None and (word.isascii() or self._plain(word)):
                plain.append((key, word))
            else:
                alone.append((key, word))
        joint = " " if self.drops_space else ""
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        encoded = self.library.encode_batch_fast([joint.join([w for _, w in g]) for g in groups],
                                                 add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.asarray(e.ids, "<u4")
            reached = self.sizes[ids].cumsum()
            ends = np.fromiter([len(w) if w.isascii() else len(w.encode()) for _, w in group],
                               np.int64, len(group)).cumsum()
            cuts = reached.searchsorted(ends)
            # every word must end where a token ends
            if len(ids) and reached[-1] == ends[-1] and (reached[cuts] == ends).all():
                data, start = ids.tobytes(), 0
                for (key, _), stop in zip(group, ((cuts + 1) * 4).tolist()):
                    known[key] = data[start:stop]
                    start = stop
            else:
                alone += group
        if alone:
            known.update(zip([k for k, _ in alone], self.whole([w for _, w in alone])))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.safe:
            return self.whole(texts)
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
        known = self.known
        if self.drops_space:
            words = [t.replace("\n", " ").split(" ") for t in texts]
            known[""] = b""
            self._learn(set().union(*words))
            return [b"".join(map(known.__getitem__, w)) for w in words]
        words = [t.replace("\n", " \n").split(" ") for t in texts]
        # the first word of a text has no space before it
        heads = self.whole([w[0] for w in words])
        self._learn(set().union(*(w[1:] for w in words)))
        out = []
        for t, w, head in zip(texts, words, heads):
            try:
                if len(w) > 1 and (not w[0] or w[0][0].isspace() or w[0][-1].isspace()):
                    raise TypeError
                out.append(head + b"".join(map(known.__getitem__, w[1:])))
            except TypeError:  # an untrusted border
                out.append(self.whole([t])[0])
        return out


_KEPT: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """The encoder of this Python worker; tasks that follow each other share it."""
    if name not in _KEPT:
        _KEPT[name] = WordEncoder(name)
    return _KEPT[name]
