"""Token ids of whole texts by a public tokenizer file.

White space never lies inside a token of this vocabulary, so the ids of a text are the ids of
its white-space-bounded chunks in order. Chunks repeat, so a task remembers the ids of the
chunks, and of the pieces inside them, that it has met (a bounded number). A new chunk of
Latin letters is cut with the file's own pattern and only its new pieces go to the file's
merge model; any other chunk goes to the tokenizer whole. Texts with special-token strings or
with control characters that Python and the tokenizer class differently go there whole too.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

#: Characters that composition leaves alone and lower-casing treats one by one.
_LATIN = re.compile("[\x21-ɏ]+")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of every byte: itself where it is visible in Latin-1, else the
    next free code point from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {b: 256 + n for n, b in enumerate(rest)}


class _Chunks(dict):
    """Chunk -> ids. Lower-case letter runs and single marks are chunks as well, so the pieces
    of longer chunks are remembered here too."""

    def __init__(self, owner: TokenIds, limit: int):
        self.tokenize, self.whole, self.pattern = owner.tokenizer.model.tokenize, owner.whole, owner.pattern
        self.limit, self.letters = limit, _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(owner.tokenizer.get_vocab_size())]

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(shown)])

    def __missing__(self, chunk: str) -> bytes:
        if not chunk.isascii() and not _LATIN.fullmatch(chunk):
            out = self.whole(chunk)
        else:
            low = chunk.lower()
            # letters only, or letters and one closing mark, need no pattern
            if low.isalpha():
                out = self.piece(low) if low == chunk else self[low]
            elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                out = self[low[:-1]] + self.piece(low[-1])
            else:
                out = b"".join(map(self.piece, self.pattern.findall(low)))
        if len(self) < self.limit:
            self[chunk] = out
        return out


def _odd(text: str) -> bool:
    """Special-token strings or control characters somewhere; plain searches are far faster than
    a pattern over the whole text."""
    return "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


class TokenIds:
    """Text to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:  # a library's own file, beside the code on every machine
            pre = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(pre[0]["pattern"]["Regex"])
        self.chunks = _Chunks(self, limit)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; NULL has none."""
        get = self.chunks.__getitem__
        return [b"" if t is None else self.whole(t) if _odd(t) else b"".join(map(get, t.split())) for t in texts]
