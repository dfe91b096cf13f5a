"""Token ids of whole texts, as little-endian unsigned 32-bit bytes.

The tokenizer file is a parameter; it is read where the tasks run and never copied. A word-end BPE encodes each
white-space word on its own, so a bounded memo of words replaces most calls of the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

WORDS_KEPT = 400_000
LONGEST_KEPT = 64
SEPARATOR = "\x01"
#: Special tokens, and white space on which Python and the tokenizer differ: such texts are encoded whole.
_WHOLE = re.compile("[\x01\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Stops that end a word. Both patterns begin with a set of characters, which the search skips to.
_STOPS = re.compile(r"[.,](?<=[a-z][.,])[.,]*(?=\s|$)")
MARK = "<|"


class WordTokenizer:
    """Ids of texts under a tokenizer that drops white space and never joins words (such as `word_bpe_49k.json`)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, equal to encoding each text whole."""
        parts = [
            None if MARK in t or _WHOLE.search(t) else _STOPS.sub(r" \g<0>", t.encode("utf-8", "replace").lower().decode()).split()
            for t in texts
        ]
        if len(self.memo) > WORDS_KEPT:  # words that are met again come back from the older half
            self.memo, self.older = {}, self.memo
        memo, extra = self.memo, {}
        new = set().union(*(p for p in parts if p)) - memo.keys()
        known = new & self.older.keys()
        memo.update(zip(known, map(self.older.__getitem__, known)))
        new = sorted(new - known)
        for i in range(0, len(new), 2_000):
            block = new[i : i + 2_000]
            ids = np.array(
                self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(block)], add_special_tokens=False)[0].ids, "<u4"
            )
            ends = np.append(np.flatnonzero(ids == self.separator), len(ids)).tolist()
            data, start = ids.tobytes(), 0
            for word, end in zip(block, ends):
                (memo if len(word) <= LONGEST_KEPT else extra)[word] = data[4 * start : 4 * end]
                start = end + 1
        if extra:
            look = lambda w: memo[w] if w in memo else extra[w]
        else:
            look = memo.__getitem__
        return [self.whole(t) if p is None else b"".join(map(look, p)) for t, p in zip(texts, parts)]


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


def encoded(batch, path: str, end_id: int | None, rows: int = 512):
    """(doc_id, id bytes) of a batch with `doc_id` and `text`, a few hundred texts at a time."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        texts = [t or "" for t in part.column("text").to_pylist()]
        for doc, ids in zip(part.column("doc_id").to_pylist(), tokenizer(path).encode(texts)):
            yield doc, ids + tail
