"""Token ids of whole texts, through a memory of white-space separated chunks.

The vocabulary cuts texts at white space first, so the ids of a text are those of its chunks one
after the other. Chunks repeat; each task keeps those it has met, up to a bound, and starts anew
when that is reached. A chunk of letters, with a full stop or comma behind it or not, is one word to
the vocabulary: its ids come from the merge rules directly. All other chunks, and texts that may name
a special token, take the tokenizer's whole way.
"""

from __future__ import annotations

import os
from array import array

import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Letters below this sign are lower-cased and composed alike by Python and the tokenizer.
BEYOND_LATIN = "ɐ"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if visible, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)]


class ChunkIds(dict):
    """Chunk bytes to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, most: int = 1 << 19) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        self.signs = byte_signs()
        self.most = most

    def of(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk that is one run of letters; None for other chunks."""
        if chunk.isalpha():  # ASCII letters stand for themselves
            return array("I", [t.id for t in self.model.tokenize(chunk.decode())]).tobytes()
        text = chunk.decode().lower()
        if not text.isalpha() or max(text) >= BEYOND_LATIN:
            return None
        signs = self.signs
        return array("I", [t.id for t in self.model.tokenize("".join([signs[b] for b in text.encode()]))]).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = None
        if len(chunk) <= 64:
            if chunk[-1] in b".," and len(chunk) > 1:
                ids = self.word(chunk[:-1])
                ids = ids and ids + self[chunk[-1:]]
            else:
                ids = self.word(chunk)
        ids = ids or self.of(chunk.decode())
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:  # may hold the name of a special token, which is told by its case
            return self.of(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))

    def count(self, text: bytes) -> int:
        return len(self.encode(text)) // 4
