"""Token ids of whole texts in Spark tasks, by the vocabulary files of public tokenizers (their paths are parameters).

A text may be cut before a space that follows a non-space: the pre-token pattern never joins across such a place. Texts
are cut there, equal pieces are encoded once per worker by the tokenizers library, and ids are joined as bytes. Pieces of
plain characters are cut into their pre-tokens, whose ids are kept too, so that a word costs the library's merges once
whatever marks stand around it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers
import regex

#: Distinct pieces whose ids a worker keeps: the first that it meets, which holds the frequent ones. Others are made each time.
KEPT_PIECES = 400_000
_RUNS = re.compile(r"\s[ ]")
_CUT = re.compile(r"(?<=\S) ")
#: Letters, printable ASCII and line ends: white space is the same here for every regular expression engine.
_PLAIN = regex.compile(r"[\p{L}\x20-\x7e\n]*+")
_encoders: dict[str, PieceEncoder] = {}


class _Pieces(dict):
    """ids of a text piece that follows a space (the space is part of the ids, not of the key), made when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.pre_tokens = regex.compile(public_tokenizers.PATTERN).findall
        self.code = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        # the byte alphabet of such vocabularies: printable bytes stand for themselves, the others follow from 256 on in order
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.alphabet = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}

    def one(self, pre_token: str) -> bytes:
        return array(self.code, [t.id for t in self.merge(pre_token.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def any(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece):
            return b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.one(p) for p in self.pre_tokens(piece)])
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.one(f" {piece}") if piece.isalpha() else self.any(f" {piece}")
        if len(self) < KEPT_PIECES:
            self[piece] = ids
        return ids


class PieceEncoder:
    """ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces = _Pieces(self.tokenizer)
        self.dtype = np.dtype("<u2" if self.pieces.code == "H" else "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        out, find = [], self.pieces.__getitem__
        for t in texts:
            parts = _CUT.split(t) if _RUNS.search(t) else t.split(" ")
            head = self.pieces.any(parts[0]) if parts[0] else b""  # empty: the text begins with the space of its next piece
            del parts[0]
            out.append(head + b"".join(map(find, parts)))
        return out


def encoder(vocabulary: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = PieceEncoder(vocabulary)
    return _encoders[vocabulary]
