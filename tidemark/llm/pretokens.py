"""Pre-tokens of two kinds of byte-pair tokenizers, cut by regular expressions, and worker caches of what each encodes to.

A text of common characters is cut here; what holds any other character is given to the library, run by run, so that its
own normalisation and Unicode tables decide. Texts for a tokenizer of another kind are given to it whole. Either way the
ids are the library's.
"""

from __future__ import annotations

import json
import re
import unicodedata
from pathlib import Path

import numpy as np

#: White space as the tokenizers' regular expressions have it.
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Typographic signs that are neither letters, digits nor white space.
SIGNS = "\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u2026\u20ac"
#: Entries of each of the two generations of a worker's cache, and the longest key that it keeps; 200 bytes each or so.
CACHE_ENTRIES, CACHED_CHARS = 200_000, 64


def _common(kinds: str) -> str:
    """Characters below U+0180 of these categories that no normalisation alters but by simple lower case."""
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] in kinds and c not in (0xA0, 0xAD, 0x130))


LETTER, DIGIT = _common("L"), _common("N")
#: Finds a character that is not common.
OTHER = re.compile(f"[^{LETTER}{DIGIT}{_common('PS')}{SIGNS}\x09-\x0d\x20]")

#: Pre-tokens in lower case, white space dropped, digits one by one.
WORD_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
WORD_RUN = re.compile("[^\x09-\x0d\x20]+")
#: Pre-tokens that keep a space before them.
BYTE_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BYTE_RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


# Normaliser and pre-tokeniser of the two kinds of tokenizer files whose texts are cut here.
KINDS = {
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
}


def kind_of(path: str) -> str | None:
    """The kind of a tokenizer file; None for any other normaliser, pre-tokeniser, model or special tokens with rules of their own."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    plain = told["model"].get("type") == "BPE" and not told["model"].get("dropout") and not told.get("truncation")
    plain = plain and not any(t.get(k) for t in told["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word"))
    found = (told.get("normalizer"), told.get("pre_tokenizer"))
    return next((k for k, v in KINDS.items() if plain and v == found), None)


class Cutter:
    """Cuts texts for a tokenizer file: at the strings of special tokens, then to pre-tokens; not at all for an unknown kind."""

    def __init__(self, path: str):
        self.kind = kind_of(path)
        self.special = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()} if self.kind else {}
        self.pretokens = {"word": word_pretokens, "byte": byte_pretokens, None: lambda text: [text]}[self.kind]
        self._at = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._marked = all(x.startswith("<|") for x in self.special)  # then a text without that needs no search

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which are parts of their own."""
        return [text] if self._at is None or (self._marked and "<|" not in text) else self._at.split(text)


class Remembering(dict):
    """A cache in two generations: a full one becomes the older, from which what is met again returns; the rest goes."""

    def __init__(self, make, entries: int | None = None):
        super().__init__()
        self.make, self.older, self.entries = make, {}, entries or CACHE_ENTRIES

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > CACHED_CHARS:
            return value
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict = {}


def kept(kind: str, path: str, make):
    """What make() gives, kept by the worker for its next task of the same kind; one kind at a time, so that memory stays bounded."""
    if (kind, path) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, path] = make()
    return _KEPT[kind, path]


def lengths(path: str, frequent: dict[str, int]) -> Remembering:
    """Pre-token (or run of characters) to its number of tokens: from the table of frequent ones, else encoded when first met."""
    whole, model, letters, known = tokenizer(path).encode, tokenizer(path).model, _byte_letters(), kind_of(path) is not None

    def length(key: str) -> int:
        if (n := frequent.get(key)) is not None:
            return n
        if known and OTHER.search(key) is None:  # cut here, so it is in lower case and needs no further cutting
            return len(model.tokenize(key.translate(letters)))
        return len(whole(key, add_special_tokens=False).ids)

    return Remembering(length)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write a common character's UTF-8 bytes: visible Latin-1 characters stand
    for themselves, the other bytes, in order, for the characters from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in visible]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    common = [*map(chr, range(0x180)), *SIGNS]
    return {ord(c): "".join(letter[b] for b in c.encode()) for c in common}


def id_bytes(path: str) -> Remembering:
    """Pre-token (or run of characters) to its ids as little-endian unsigned 32-bit numbers.

    A pre-token of common characters goes to the library's model at once; its text needs no further cutting.
    """
    whole, model, letters, known = tokenizer(path).encode, tokenizer(path).model, _byte_letters(), kind_of(path) is not None

    def ids(key: str) -> bytes:
        if known and OTHER.search(key) is None:
            found = [t.id for t in model.tokenize(key.translate(letters))]
        else:
            found = whole(key, add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()

    return Remembering(ids)


def word_pretokens(text: str) -> list[str]:
    """Pre-tokens of a text without special strings; runs with other than common characters come whole, as they are."""
    if OTHER.search(text) is None:
        return WORD_CUT.findall(text.lower())
    out: list[str] = []
    for run in WORD_RUN.findall(text):
        if OTHER.search(run) is None:
            out += WORD_CUT.findall(run.lower())
        else:
            out.append(run)
    return out


def byte_pretokens(text: str) -> list[str]:
    if OTHER.search(text) is None:
        return BYTE_CUT.findall(text)
    out: list[str] = []
    for run in BYTE_RUN.findall(text):
        if OTHER.search(run) is None:
            out += BYTE_CUT.findall(run)
        else:
            out.append(run)
    return out
