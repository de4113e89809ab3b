"""Token ids of whole texts by a public tokenizer file, with a cache of pieces.

Both vocabularies used here never join characters across the start of a
white-space run, nor letters with the marks that end a word, so a text's ids are
the ids of its pieces (a word with the one space before it, the marks after it, or
a run of white space) in order. Words recur, so most pieces come from a cache.
Texts with characters whose standing as white space differs between libraries, or
with the marks of special tokens, are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Pieces kept per worker, about 200 bytes each.
CACHED = 500_000

_S = " \t\n\r\x0b\x0c"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_MARKS = ".,!?;:%*#$&|"
_PIECE = re.compile(f" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]")
_BREAK = re.compile(f"[{_S}]")
_MARKED = re.compile(f"( ?[{_LETTERS}]+)([{_MARKS}]*)")
_LETTER_SET = frozenset(c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c))
_FOUR_BYTES = array("I").itemsize == 4
_WHOLE = re.compile(
    "<\\||[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _forget_older(cache: dict) -> None:
    """Drop the half of a cache that came first."""
    for key in list(islice(cache, (len(cache) + 1) // 2)):
        del cache[key]


def _packed(ids: list[int]) -> bytes:
    if sys.byteorder == "little" and _FOUR_BYTES:
        return array("I", ids).tobytes()  # much less to set up than for numpy
    return np.array(ids, dtype="<u4").tobytes()


class CachedEncoder(dict):
    """Ids as bytes, four to an id, the lowest first; a dict from pieces to their ids."""

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cached = cached
        self.spaced = SpacedWords(self)
        self.drops_space = not self.tokenizer.encode(" \n", add_special_tokens=False).ids
        # A run of letters is one word to the model, written in the alphabet of bytes.
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if re.match(f"[ {_LETTERS}]", chr(c))]
        self.alphabet = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in letters}

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """The ids of a run of letters, with or without a space before it."""
        plain = word.strip().lower() if self.drops_space else word
        if not plain.isascii():
            plain = plain.translate(self.alphabet)
        elif plain[0] == " ":  # ASCII letters stand for themselves in the alphabet of bytes
            plain = self.alphabet[32] + plain[1:]
        return _packed([token.id for token in self.tokenizer.model.tokenize(plain)])

    def __missing__(self, piece: str) -> bytes:
        """The ids of a new piece; a word with marks is not kept, only its two parts are."""
        if split := _parts(piece, self):
            return split[0] + self[split[1]]
        found = _MARKED.fullmatch(piece)
        if found and found[2]:
            return self[found[1]] + self[found[2]]
        if len(self) >= self.cached:
            _forget_older(self)
        ids = self[piece] = self.word(piece) if found else self.whole(piece)
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text; a null text is empty.

        The texts are cut together, and a part that recurs among them is looked up once.
        """
        texts = [text or "" for text in texts]
        whole = [_odd(text) for text in texts]
        if self.drops_space:
            together = [text for text, odd in zip(texts, whole, strict=True) if not odd]
            parts = pc.ascii_split_whitespace(pc.ascii_lower(_texts(together)))
            skipped, lookup = 0, self.__getitem__
        else:  # all parts but the first come after one space
            together = [t for t, odd in zip(texts, whole, strict=True) if not odd and "  " not in t]
            parts = pc.split_pattern(_texts(together), " ")
            skipped, lookup = 1, self.spaced.__getitem__
        spans = _ids_of_parts(parts, lookup, skipped)
        for text, odd in zip(texts, whole, strict=True):
            if odd:
                yield self.whole(text)
            elif self.drops_space:
                yield next(spans)
            elif "  " in text:
                yield self._pieces(text)
            else:
                yield self._pieces(text.partition(" ")[0]) + next(spans)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


def _texts(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string())


def _ids_of_parts(parts: pa.Array, lookup: Callable[[str], bytes], skip: int) -> Iterator[bytes]:
    """The joined ids of each list's parts without the first ``skip``."""
    offsets = parts.offsets.to_numpy()
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    distinct = flat.dictionary.to_numpy(zero_copy_only=False)
    ids = pa.array(list(map(lookup, distinct)), pa.large_binary())
    found = ids.take(flat.indices)
    _, ends, joined = found.buffers()
    ends = np.frombuffer(ends, np.int64) if len(found) else np.zeros(1, np.int64)
    joined = memoryview(joined or b"")
    borders = offsets - offsets[0]
    for first, last in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        yield bytes(joined[ends[first + skip] : ends[last]])


class SpacedWords(dict):
    """The ids of a text's parts between single spaces, each with the space before it."""

    def __init__(self, pieces: CachedEncoder):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, part: str) -> bytes:
        if split := _parts(part, self):
            return split[0] + self.pieces[split[1]]
        found = _MARKED.fullmatch(part)
        if found and found[2]:
            return self[found[1]] + self.pieces[found[2]]
        if not found and _BREAK.search(part):  # a line break, a tab
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(" " + part)))
        if len(self) >= self.pieces.cached:
            _forget_older(self)
        piece = " " + part
        ids = self[part] = self.pieces.word(piece) if found else self.pieces.whole(piece)
        return ids


def _parts(piece: str, known: dict[str, bytes]) -> tuple[bytes, str] | None:
    """The ids of a known word and the marks after it, if ``piece`` is that."""
    word = piece.rstrip(_MARKS)
    if len(word) == len(piece) or word[-1:] not in _LETTER_SET or word not in known:
        return None
    return known[word], piece[len(word) :]


def _odd(text: str) -> bool:
    """Whether a text has to be encoded whole."""
    if text.isascii():
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _WHOLE.search(text) is not None


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]
