"""Splitting texts into the words inside which byte-level vocabularies merge, and encoding by word.

Byte-level tokenizers split a text by a fixed pattern and merge within each piece only, so equal
pieces have equal ids wherever they stand. An encoder that remembers pieces encodes each distinct
one once per worker and joins the remembered ids for the rest.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

MAX_REMEMBERED = 1_000_000
CHUNK_CHARS = 400_000


def _char_class(test) -> str:
    spans: list[list[int]] = []
    for c in range(0x10000):
        if test(chr(c)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in spans)


@functools.cache
def splitter() -> re.Pattern:
    """The split pattern of byte-level vocabularies for texts without `unusual` characters.

    Same pieces as the published pattern, spelled with explicit classes, which the standard module
    matches faster than the property classes of the `regex` package.
    """
    letter = _char_class(lambda c: unicodedata.category(c)[0] == "L")
    number = _char_class(lambda c: unicodedata.category(c)[0] == "N")
    space = _char_class(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")
    return re.compile(
        rf" ?[{letter}]++| ?[{number}]++|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]++"
        rf"|[{space}]+(?![^{space}])|[{space}]++"
    )


@functools.cache
def unusual() -> re.Pattern:
    """Characters beyond the basic plane or unknown to this Python: libraries may class them differently."""
    return re.compile(rf"[\U00010000-\U0010ffff{_char_class(lambda c: unicodedata.category(c) == 'Cn')}]")


def is_usual(text: str) -> bool:
    return text.isascii() or not unusual().search(text)


def chunks(texts: Iterable[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in lists of about `chars` characters; a longer text comes alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def file_digest(path: str) -> str:
    """Names a tokenizer version: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class JsonEncoder:
    """Ids of a `tokenizers` file as little-endian unsigned 32-bit bytes.

    A byte-level file goes by remembered pieces, each encoded by the library. Texts that hold an
    added token or an unusual character, and files of another kind, are encoded whole by it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.most = MAX_REMEMBERED

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() if len(e.ids) > 8 else b"".join([i.to_bytes(4, "little") for i in e.ids]) for e in encoded]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split, pending, whole = splitter(), [], []
        for k, text in enumerate(texts):
            if self.by_piece and is_usual(text) and not any(a in text for a in self.added):
                pending.append((k, split.findall(text)))
            else:
                whole.append(k)
        known = self.known
        if len(known) > self.most:
            known.clear()
        # difference() looks the few new pieces up in the many known ones, never the other way round
        new = list(set().union(*(pieces for _, pieces in pending)).difference(known))
        known.update(zip(new, self._library(new)))
        for k, pieces in pending:
            out[k] = b"".join(map(known.__getitem__, pieces))
        for k in whole:
            out[k] = self._library([texts[k]])[0]
        return out


class PieceEncoder:
    """Ids of a `sentencepiece` model, whole texts by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.model.encode(texts, num_threads=1)
        return [np.array(one, "<u4").tobytes() for one in ids]


@functools.cache
def encoder(path: str) -> JsonEncoder | PieceEncoder:
    """One encoder per worker process and file; what it remembers outlives a task."""
    return PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
