"""Token ids of whole texts by the tokenizers library, with a memory of pieces.

For the two makes of tokenizer below a text may be cut at certain places that neither
the normaliser nor the pattern ever joins. Arrow cuts many texts at a time and numbers
their distinct pieces; the library is asked for each piece not remembered, and numpy
strings the texts together from its answers. A piece of Latin-1 letters alone is one word by either pattern and goes to the
library's model, spelt as the vocabulary spells its bytes; any other piece takes the
library's whole chain.

* "words": white space becomes one space and is dropped by the pattern, so words
  between ASCII white space don't know of each other.
* "space first": every match of the pattern is white space, or at most one space
  and then none; a run of white space before a word gives up its last character.
* In both no match goes on from a Latin-1 letter to an ASCII mark.

A tokenizer counts as one of these only if its normaliser, pre-tokenizer and the
flags of its model equal the values here to the letter; any other gets whole texts.
So do texts that hold an added token's string or, for "space first", white space
beyond ASCII."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 250_000
GROUP = 1 << 22
SPAN = 1 << 19
LONG_PIECE = 256
#: The parts of the two makes of tokenizer file whose cutting places are known.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_PIECES = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_PATTERN}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL, "use_regex": False}]}
MAKES = {"words": (_WORD_NORMALIZER, _WORD_PIECES), "space first": (None, {**_BYTE_LEVEL, "use_regex": True})}
#: Code points that some engine takes for white space, beyond ASCII's six.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
_ODD_LATIN = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0"]
_PLAIN_RUNS = ["  ", "\n\n", " \n", "\n ", "\t", "\r", "\v", "\f"]
_SPACE_FIRST = re.compile(r" ?[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+(?![^ \t\n\r\v\f])|[ \t\n\r\v\f]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: how byte-level vocabularies spell bytes: visible Latin-1 characters as they are, the others from U+0100 on
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_SPACE = chr(_SPELT[32])


def make_of(spec: dict) -> str:
    """The name in MAKES, or "whole"."""
    model = spec.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    plain = plain and not spec.get("truncation") and not spec.get("padding") and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or [])
    found = [k for k, parts in MAKES.items() if (spec.get("normalizer"), spec.get("pre_tokenizer")) == parts]
    return found[0] if plain and found else "whole"


def is_latin(text: str) -> bool:
    """Whether all code points are under 256: no marks that combine, and lowering one
    character never makes two."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Pieces(dict):
    """Ids of pieces, each standing after `before`; asked for when first met. What is
    not met again while as many others are as the encoder's cache holds is forgotten."""

    def __init__(self, encoder: Encoder, before: str = ""):
        super().__init__()
        self.encoder, self.before, self.older = encoder, before, {}

    def __missing__(self, piece: str) -> bytes:
        if not piece:
            return b""
        ids = self.older.get(piece)
        if ids is None:
            stem = piece.rstrip(_MARKS) if piece[-1] in _MARKS else ""
            if stem and _LATIN_WORD.fullmatch(stem[-1]):
                ids = self[stem] + self.encoder.bare[piece[len(stem) :]]
            elif piece[0] == "\n" and self.before:
                ids = self.encoder.bare["\n"] + self.encoder.bare[piece[1:]] if len(piece) > 1 else self.encoder.bare["\n"]
            else:
                ids = self.encoder.ask(self.before + piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.encoder.cache:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, source: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        spec = json.loads(source)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.kind = make_of(spec)
        self.model = self.tokenizer.model
        self.bare, self.spaced = Pieces(self), Pieces(self, " ")

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ask(self, piece: str) -> bytes:
        first, word = ("", piece) if piece[0] != " " else (_SPACE, piece[1:])
        plain = word.isascii() and word.isalpha()
        if not plain and not _LATIN_WORD.fullmatch(word):
            return self.whole(piece)
        spelt = word.lower() if self.kind == "words" else word
        spelt = first + (spelt if plain else spelt.encode().decode("latin-1").translate(_SPELT))
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _way(self, text: str) -> tuple[bytes | None, str]:
        """A text's ids, or else None and the text as Arrow may cut it."""
        latin = is_latin(text)
        lower = text.lower() if self.kind == "words" and latin else text  # as the normaliser does
        if self.kind == "whole" or any(a in lower for a in self.added):
            return self.whole(text), ""
        if self.kind == "words":
            return None, lower
        if any(map(text.__contains__, _ODD_LATIN)) if latin else _ODD_SPACE.search(text):
            return self.whole(text), ""
        if not text or any(map(text.__contains__, _PLAIN_RUNS)) or text.strip(" \n") != text:
            return b"".join(map(self.bare.__getitem__, _SPACE_FIRST.findall(text))), ""
        return None, text.replace("\n", " \n")  # each piece but the first follows a space or is a line's first

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that pieces between white space make up."""
        rows = pa.array(texts, pa.string())
        lists = pc.ascii_split_whitespace(rows) if self.kind == "words" else pc.split_pattern(rows, " ")
        numbered = lists.flatten().dictionary_encode()
        heads, at, distinct = lists.offsets.to_numpy(), numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "words":
            parts = [self.bare[p] for p in distinct]
        else:
            parts = [self.spaced[p] for p in distinct] + [self.bare[distinct[i]] for i in at[heads[:-1]]]
            at = at.copy()
            at[heads[:-1]] = np.arange(len(distinct), len(parts))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(parts), self.dtype), np.cumsum(size) - size
        ends = np.concatenate([[0], np.cumsum(size[at])])
        out = np.empty(ends[-1], self.dtype)
        for i in range(0, len(at), SPAN):  # some pieces at a time, however long a text is
            own, j = at[i : i + SPAN], min(i + SPAN, len(at))
            out[ends[i] : ends[j]] = flat[np.repeat(first[own] - ends[i:j], size[own]) + np.arange(ends[i], ends[j])]
        bounds = ends[heads]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = []
        cut: list[str] = []
        for text in texts:
            ids, rest = self._way(text)
            out.append(None if ids is None else np.frombuffer(ids, self.dtype))
            if ids is None:
                cut.append(rest)
        found = iter(self._cut(cut) if cut else ())
        return [next(found) if x is None else x for x in out]

    def encode_one(self, text: str) -> np.ndarray:
        return self.encode([text])[0]

    def groups(self, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        """A batch in parts of about GROUP bytes of text, with the ids of their texts."""
        before = np.cumsum(pc.binary_length(batch.column(column)).to_numpy())
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(before, (before[i - 1] if i else 0) + GROUP, side="right")))
            part = batch.slice(i, j - i)
            yield part, self.encode(part.column(column).to_pylist())
            i = j


def tokenizer_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
