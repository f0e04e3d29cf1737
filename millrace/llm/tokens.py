"""Exact token ids from public tokenizer files, fast: texts are cut at safe boundaries and what pieces give is remembered.

A boundary is safe if the tokenizer can never join what stands on both sides of it:

* dropped spaces (`word_bpe`): the vocabulary drops white space, so every space and line feed is one;
* leading spaces (`byte_bpe`): a token may take one space in front, so a space between two non-spaces starts a piece,
  and so does a line feed between two non-spaces, which is a token of its own;
* both: a letter followed by ASCII punctuation (without apostrophes) at the end of a piece. Where the tokenizer normalises, only
  an ASCII letter will do: what another letter becomes in lower case may end in a mark, which joins the punctuation.

Texts with other white space are encoded whole. Words of Latin letters go straight to the library's BPE model, which their
pre-tokens would reach unchanged; other new pieces go through the whole tokenizer. A worker remembers a bounded number of pieces,
the ones last used, so its memory does not grow with the corpus.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces in each of the two generations that a worker remembers.
KEPT_PIECES = 150_000
#: Pieces beyond this many characters are encoded but not remembered.
LONGEST_KEPT = 64
#: Punctuation that ends a piece after a letter and never joins it.
TAIL = ".,!%$#&*|;:?"

_encoders: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as the characters from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
SPACE_LETTER = BYTE_LETTERS[0x20]


class Recent(dict):
    """What `make` gives for keys, remembered in two generations: `age` makes the present one the older one when it is full, and what
    is asked for from the older one moves over."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = found
        return found

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids(texts) gives for each text its token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, spaces_lead: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenize, self.spaces_lead = self.tokenizer.model.tokenize, spaces_lead
        self.known, self.tails = Recent(self._piece, KEPT_PIECES), Recent(self._whole, KEPT_PIECES // 10)
        self.last_letter = "ɏ" if spaces_lead else "\x7f"

    def _whole(self, text: str) -> bytes:
        return self._batch([text])[0]

    def _batch(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes | None:
        """With leading spaces, a piece stands for itself with one space before, or without if it starts with a line feed. None if it
        is no safe piece."""
        if piece.isascii() and piece.isalpha():  # most new pieces
            if self.spaces_lead:
                return array("I", [t.id for t in self.tokenize(SPACE_LETTER + piece)]).tobytes()
            if piece.islower():
                return array("I", [t.id for t in self.tokenize(piece)]).tobytes()
            return self.known[piece.lower()]
        if self.spaces_lead:
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or body[0].isspace() or body[-1].isspace():
                return None
        core = piece.rstrip(TAIL)
        if core and len(core) < len(piece) and core[-1] <= self.last_letter and core[-1].isalpha():
            return self.known[core] + self.tails[piece[len(core) :]]
        if self.spaces_lead:
            return self.tails["\n"] + self._part(body) if piece[0] == "\n" else self._part(piece, " ")
        if piece.isascii() and "<|" not in piece and piece != (low := piece.lower()):  # special strings count only as they are written
            return self.known[low]
        return self._part(piece)

    def _part(self, word: str, lead: str = "") -> bytes:
        """A word of Latin letters, with a space before or without, by the BPE model itself; others by the whole tokenizer."""
        plain = word.isalpha() and (word.isascii() or max(word) <= "ɏ")
        if plain and not self.spaces_lead:
            plain = word == word.lower() and (word.isascii() or unicodedata.is_normalized("NFC", word))
        if not plain:
            return self._whole(lead + word)
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenize(SPACE_LETTER + letters if lead else letters)]).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.spaces_lead:
            cut = [t.replace("\n", " \n").split(" ") for t in texts]
            heads = [c.pop(0) for c in cut]
        else:
            cut, heads = [t.replace("\n", " ").split(" ") for t in texts], []
        known = self.known
        found = [list(map(known.__getitem__, c)) for c in cut]
        known.age()
        self.tails.age()
        whole = {i for i, f in enumerate(found) if None in f}
        whole |= {i for i, h in enumerate(heads) if h and h[-1].isspace() or not h and cut[i]}
        if heads:
            plain = [i for i in range(len(texts)) if i not in whole]
            for i, x in zip(plain, self._batch([heads[i] for i in plain]), strict=True):
                found[i].insert(0, x)
        for i, x in zip(whole, self._batch([texts[i] for i in whole]), strict=True):
            found[i] = [x]
        return [b"".join(f) for f in found]


def encoder(path: str, spaces_lead: bool) -> Encoder:
    """One for each worker process, kept from task to task; that of another file is dropped."""
    key = (path, spaces_lead)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]
