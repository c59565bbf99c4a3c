"""Byte-level BPE ids of whole texts, with a bounded cache of words."""

from __future__ import annotations

import json
import re

import numpy as np

#: Words kept with their ids in one Python worker; the cache starts anew beyond that.
CACHE_WORDS = 800_000
#: Where single spaces and line feeds aren't the only white space, or two of them touch, words depend on one another.
_UNEVEN = re.compile(r"[^\S \n]|[ \n][ \n]")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.encode(word if word[:1] == "\n" else " " + word), dtype="<u4").tobytes()
        self[word] = ids
        return ids


class ByteBpe:
    """ids of the tokenizers file at path, as encode(text, add_special_tokens=False) returns them.

    A single space or line feed between other characters always begins a new word of the pattern, so a text is the
    sequence of its words, and words repeat. Texts with other white space are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        letters = _byte_letters()
        self.special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = _Words(self.encoding.encode_ordinary)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.split and any(s in text for s in self.special):
            return b"".join(self.special[part] if part in self.special else self._plain(part) for part in self.split.split(text) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _UNEVEN.search(text):
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        head = np.array(self.encoding.encode_ordinary(first), dtype="<u4").tobytes()
        return head + b"".join(map(self.words.__getitem__, rest))


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One instance for each Python worker and path."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
