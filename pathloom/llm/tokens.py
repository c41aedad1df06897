"""Token ids of whole texts by the word-level BPE tokenizer, at several times the library's own pace.

The tokenizer's pre-tokens never span white space, so a text's ids are those of
its space-separated chunks, one after the other. Chunks repeat; their ids are
kept in a table of bounded size, as little-endian unsigned 32-bit bytes. Unknown
chunks that are letters followed by punctuation are split there (the tokenizer
splits at the same place) and all unknown words of a batch are encoded by the
library in one call, as a single text whose word ends are marked by the ids
themselves. Anything else goes to the library as it is.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Entries in the table of chunks: about 150 MB with their ids. When full, it starts anew.
TABLE_SIZE = 600_000
END_ID = 1

# Lower-casing A-Z before normalisation is safe unless a combining mark follows; Latin text has none.
_ODD = re.compile("[^\x00-˿Ḁ-ỿ‐-⁄₠-₿]")
_MARKS = b"!#$%&()*+,-./:;=?_"


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self._ends = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab().items():
            self._ends[i] = token.endswith("</w>")
        self._table: dict[bytes, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, found: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(found).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(found):
            return [self._plain(w.decode()) for w in found]
        data, cuts = ids.tobytes(), (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _learn(self, chunks: set[bytes]) -> None:
        table, parts, wanted = self._table, [], {}
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            if not word.isalpha():  # more than ASCII letters: other letters, or none
                text = word.decode()
                if not text.isalpha() or _ODD.search(text):
                    table[chunk] = self._plain(chunk.decode()) if chunk else b""
                    continue
            rest = chunk[len(word) :]
            parts.append((chunk, word, rest))
            if word not in table:
                wanted[word] = None
            if rest and rest not in table:
                wanted[rest] = None
        alike = [w for w in wanted if w[-1] >= 97]  # letters; the rest is punctuation
        if alike:
            table.update(zip(alike, self._words(alike)))
        for part in wanted:
            if part not in table:
                table[part] = self._plain(part.decode())
        for chunk, word, rest in parts:
            table[chunk] = table[word] + (table[rest] if rest else b"")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        split: list[list[bytes] | bytes] = []
        for text in texts:
            if not text:
                split.append([])
            elif "<|" in text or "\x00" in text:
                split.append(self._plain(text))
            else:
                data = text.encode("utf-8", "surrogatepass")
                if text.isascii() or not _ODD.search(text):
                    data = data.lower()
                split.append(data.replace(b"\n", b" ").split(b" "))
        if len(self._table) > TABLE_SIZE:
            self._table.clear()
        table = self._table
        unknown = set(chain.from_iterable(s for s in split if isinstance(s, list))).difference(table)
        if unknown:
            self._learn(unknown)
        get = table.__getitem__
        return [s if isinstance(s, bytes) else b"".join(map(get, s)) for s in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
