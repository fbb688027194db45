"""Token ids of texts, for use inside Python tasks."""

from __future__ import annotations

import string
import struct
from collections.abc import Callable, Iterable, Iterator

import regex

# Fixed value: how the tokenizer's file splits lower-case text before it merges.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

# Entries that a task remembers; it forgets all of them when there are more.
REMEMBERED = 250_000

# Below it no letters combine and each is lowered by itself, so lowering and splitting are plain.
PLAIN = "\u0250"


def byte_letters() -> dict[int, str]:
    """How byte-level merges write bytes: printable ones as themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Remembered(dict):
    """Results of a function by its argument; all are forgotten when there are too many."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[key] = self.make(key)
        return found


class TextTokenizer:
    """Ids as bytes of little-endian unsigned 32-bit numbers, the same as of whole texts.

    The tokenizer drops white space and no token crosses it, so the ids of a text are those of its
    pieces between blanks and line feeds. Pieces repeat, hence their ids are remembered. A piece in
    Latin letters goes to the merge model word by word; any other goes to the whole tokenizer, and
    so does a text that may hold a special token.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces = Remembered(self.piece)
        self.words = Remembered(self.word)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.model.tokenize(written)])

    def piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if not (piece.isprintable() and (piece.isascii() or max(piece) < PLAIN)):
            return self.whole(piece)
        lower = piece.lower()
        # Most pieces are a word and what is written right after it.
        word = lower.rstrip(string.punctuation)
        if word.isalpha():
            rest = lower[len(word) :]
            return self.words[word] + self.words[rest] if rest else self.words[word]
        return b"".join(map(self.words.__getitem__, WORDS.findall(lower)))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if "<|" in text:
                yield self.whole(text)
            else:
                yield b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
