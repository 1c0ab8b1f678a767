"""Public tokenizers with a memory of words, for whole texts."""

from __future__ import annotations

import base64
import os
import unicodedata

import numpy as np

from chronolex.llm.common import no_threads

#: Folder of the vocabulary files; a parameter of every operator that tokenizes.
FOLDER = "/opt/tokenizers"
MEMORY = 600_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids by piece; a piece that is not there is encoded on the first look."""

    def __init__(self, of):
        super().__init__({"": b""})
        self.of = of

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.of(piece)
        return ids


class WordBPE:
    """Ids of a `tokenizers` file whose vocabulary drops white space, as little-endian unsigned 32-bit bytes.

    Texts are cut at spaces and line feeds only, which its normaliser and its pre-tokenizer both keep apart, and each distinct
    piece is encoded once while it is remembered. Letters with a mark behind them, the common pieces, go straight to the
    vocabulary's merges; all others through the whole library. Memory is bounded: beyond `memory` pieces it starts afresh.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        no_threads()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.memory = memory
        self.known = _Pieces(self.piece)

    def whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        core, mark = (piece[:-1], piece[-1]) if piece[-1] in ".,;:!?" else (piece, "")
        if not core.isalpha() or "\u03a3" in core:  # a capital sigma's lower case depends on its place
            return self.whole(piece)
        low = core.lower()
        if mark or low != core:
            return self.known[low] + (self.known[mark] if mark else b"") if low.isalpha() else self.whole(piece)
        if not low.isascii():
            if not unicodedata.is_normalized("NFC", low):
                return self.whole(piece)
            low = low.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.merge(low))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.memory:
            self.known = _Pieces(self.piece)
        get = self.known.__getitem__
        return [b"".join(map(get, (t or "").replace("\n", " ").split(" "))) for t in texts]


class RankBPE:
    """Token counts of a `tiktoken` rank file. Long texts are encoded in parts that end before a letter's space."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


_loaded: dict[tuple, WordBPE | RankBPE] = {}


def word_bpe(folder: str = FOLDER, name: str = "word_bpe_49k.json") -> WordBPE:
    """One for each worker process and file."""
    key = (folder, name)
    if key not in _loaded:
        _loaded[key] = WordBPE(os.path.join(folder, name))
    return _loaded[key]


# Fixed value: the pattern that the rank files of the vocabulary folder are made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_bpe(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> RankBPE:
    key = (folder, name)
    if key not in _loaded:
        _loaded[key] = RankBPE(os.path.join(folder, name), PATTERN)
    return _loaded[key]
