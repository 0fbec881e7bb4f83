"""Encoding by a public tokenizer's file, with what it takes to do so fast and exactly on any text.

A text is cut where no pre-token can go across; each piece is encoded once and remembered. A single pre-token that is
too long to remember is encoded by tree concatenation (bpe.py)."""

from __future__ import annotations

import json
import re
import struct

import numpy as np

#: Letters of which it is certain that the tokenizers' pattern counts them as letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: After such a letter, a blank, line end or one of these marks always begins another pre-token.
AFTER = r"(?=[ \n\r\t.,;:!?])"
#: White space other than the four kinds above: a text with any is encoded whole.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
BYTE_PIECES = re.compile(rf" ?[{LETTERS}]+{AFTER}|\n(?=[{LETTERS}])|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
WORD_PIECES = re.compile(rf"[{LETTERS}]+{AFTER}|[^ \n\r\t]+")
#: Remembered pieces of one generation, of two, and the longest piece to remember.
KEEP, KEEP_CHARS = 300_000, 48


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others for letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in sorted(shown)} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids as little-endian unsigned 32-bit integers; `long_pieces` encodes pre-tokens of over `leaf` bytes (byte-level files only)."""

    def __init__(self, path: str, leaf: int = 4096):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        spec = json.loads(self.t.to_str())
        self.byte_level = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.lower = not self.byte_level
        if not self.byte_level and [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("neither a byte-level file nor one of lower-case words")
        self.pattern = BYTE_PIECES if self.byte_level else WORD_PIECES
        self.one = re.compile(rf" ?[{LETTERS}]+" if self.byte_level else rf"[{LETTERS}]+").fullmatch
        self.table = byte_letters()
        self.model = self.t.model.tokenize
        self.leaf = leaf
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.get = _Memo(self).__getitem__
        self.pieces = self.pattern.findall  # in turn, of a text that `divides`
        self.joins = 0  # halves that were joined

    def bpe(self, raw: bytes) -> list[int]:
        """One pre-token's bytes, merged by the model alone."""
        return [x.id for x in self.model(raw.decode("latin-1").translate(self.table))]

    def piece(self, text: str) -> bytes:
        if self.one(text) and len(text) <= self.leaf:
            ids = self.bpe((text.lower() if self.lower else text).encode())
        elif self.byte_level and len(text) > self.leaf:
            return self.long(text)
        else:
            ids = self.t.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def pretokens(self, text: str):
        """(special id or None, pre-token) in turn."""
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                yield self.special[part], part
            elif part:
                for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(part):
                    yield None, part[a:b]

    def long(self, text: str) -> bytes:
        from lakeloom.llm.bpe import tree_encode

        out: list[np.ndarray] = []
        short: list[str] = []

        def flush():
            if short:
                out.append(np.array(self.t.encode("".join(short), add_special_tokens=False).ids, "<u4"))
                short.clear()

        for special, p in self.pretokens(text):
            if special is not None:
                flush()
                out.append(np.array([special], "<u4"))
            elif len(p) > self.leaf:
                flush()
                out.append(tree_encode(self, p.encode(), self.leaf))
            else:
                short.append(p)
        flush()
        return b"".join(x.astype("<u4").tobytes() for x in out)

    def divides(self, text: str) -> bool:
        """Whether a text may be cut in pieces."""
        return not ODD_SPACE.search(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return self.long(text) if self.byte_level and len(text) > self.leaf else struct.pack(f"<{len(i := self.t.encode(text, add_special_tokens=False).ids)}I", *i)
        return b"".join(map(self.get, self.pieces(text)))

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id of a byte-level vocabulary."""
        back = {v: k for k, v in self.table.items()}
        size = self.t.get_vocab_size(with_added_tokens=True)
        return [bytes(back[c] for c in s) if (s := self.t.id_to_token(i)) is not None and all(c in back for c in s) else (s or "").encode() for i in range(size)]


class _Memo(dict):
    """Two generations: when the young one is full it becomes the old one, so memory is bounded and frequent pieces stay."""

    def __init__(self, owner: Encoder):
        self.owner, self.old = owner, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.owner.piece(key)
        if len(key) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, leaf: int = 4096) -> Encoder:
    """One for each file and worker process."""
    if (path, leaf) not in _encoders:
        _encoders[path, leaf] = Encoder(path, leaf)
    return _encoders[path, leaf]
