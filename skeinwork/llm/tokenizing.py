"""Exact ids of a `tokenizers` vocabulary, through a cache of blank-separated chunks.

A vocabulary whose pre-tokenizer drops white space never makes a token across a
blank or a line feed, and neither do its normaliser or its special tokens.  The
ids of a text are then the ids of its chunks, in order.  Chunks repeat, so almost
all of them come from a bounded dictionary; the library itself encodes the rest.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Chunks a Python worker remembers; it forgets all of them when there are more.
CACHE_CHUNKS = 1_200_000
#: Letters, then ASCII marks; not the apostrophe, which the pattern may join with letters.
LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
#: Texts whose unknown chunks are encoded together.
TOGETHER = 64


class ChunkEncoder:
    """``encode_all(texts)`` gives each text's ids as little-endian unsigned 32-bit integers; a null text has none."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[str, bytes] = {"": b""}
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        pre = self.tokenizer.pre_tokenizer
        # "a b" must fall apart into "a" and "b" without a trace of the blank
        probe = [t for t, _ in pre.pre_tokenize_str("a b\nc")] if pre else []
        if probe != ["a", "b", "c"]:
            raise ValueError("the pre-tokenizer of this vocabulary keeps white space; chunks can't be encoded alone")

    def _learn(self, chunks: set[str]) -> None:
        """Make all of ``chunks`` known."""
        known = self.known
        if len(known) > self.most:
            known.clear()
            known[""] = b""
        new = [c for c in chunks if c not in known]
        heads, whole = {}, []
        for c in new:
            # letters, with or without marks after them, are one or two words of the pattern
            word, mark = c, ""
            if not c.isalpha() and (m := LETTERS_AND_MARKS.fullmatch(c)):
                word, mark = m.groups()
            if word.isalpha():
                heads[c] = (word, mark)
                if mark and mark not in known:
                    whole.append(mark)
                    known[mark] = b""  # until it is encoded below
            else:
                whole.append(c)
        for c, e in zip(whole, self.batch(whole, add_special_tokens=False), strict=True):
            known[c] = np.asarray(e.ids, "<u4").tobytes()
        words = list({w for w, _ in heads.values() if w not in known})
        if words:
            # all words in one text: a word ends with the first token that ends a word
            ids = np.asarray(self.batch([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
                raw, at = ids.tobytes(), 0
                for w, e in zip(words, (4 * ends).tolist(), strict=True):
                    known[w] = raw[at:e]
                    at = e
            else:  # letters to Python, but not to the vocabulary's pattern
                for w, e in zip(words, self.batch(words, add_special_tokens=False), strict=True):
                    known[w] = np.asarray(e.ids, "<u4").tobytes()
        for c, (w, mark) in heads.items():
            if mark:
                known[c] = known[w] + known[mark]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        for lo in range(0, len(texts), TOGETHER):
            again, unknown = [], set()
            get = self.known.__getitem__
            for k in range(lo, min(lo + TOGETHER, len(texts))):
                if text := texts[k]:
                    chunks = text.replace("\n", " ").split(" ")
                    try:
                        out[k] = b"".join(map(get, chunks))
                    except KeyError:
                        again.append((k, chunks))
                        unknown.update(chunks)
            if again:
                self._learn(unknown)
                for k, chunks in again:
                    out[k] = b"".join(map(get, chunks))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return ChunkEncoder(path)


@functools.cache
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
