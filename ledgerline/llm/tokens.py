"""Token ids of whole texts, by a public tokenizer file.

`Encoder` gives what `Tokenizer.encode(text, add_special_tokens=False)` gives. Words
of plain texts are encoded once and kept: the file's normaliser and splitter never
join what white space parts. A text with any sign that those rules treat specially
goes to the library whole.
"""

from __future__ import annotations

import re

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Texts of these signs are in normal form already, and lower-casing them is one to one.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
_KEPT_WORDS = 800_000
_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Words to the bytes of their ids (little-endian, 32 bits); filled as words come."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.by_word = path.endswith(WORD_BPE)

    def __missing__(self, word: str) -> bytes:
        found = b"".join(map(self.piece, self.split(word)))
        self[word] = found
        return found

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.signs)
            found = self.pieces[piece] = np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        if not self.by_word or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > _KEPT_WORDS:
            self.clear()
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


def encoder(path: str) -> Encoder:
    """The one encoder of this Python process for that file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
