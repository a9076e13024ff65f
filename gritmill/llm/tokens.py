"""Token ids of whole texts by the `tokenizers` library, with a bounded cache of pieces.

Both supported pre-tokenizers cut at white space, so a text's ids are those of its pieces in turn. A piece is looked up;
a new one made of ASCII and Latin-1 letters, digits and signs is cut as the pre-tokenizer cuts it and its parts go to the
library's BPE model, and any other piece goes through the library's whole `encode`.
"""

from __future__ import annotations

import json
import re
from array import array

_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_SPACE = r"\x09-\x0d\x20"
_PLAIN = re.compile(rf"[{_LETTERS}{_SPACE}!-;=-~]*")  # no "<": special tokens are found by the library
_CACHE = 500_000
_SPACES = re.compile(r"\s")
_found: dict = {}


def _byte_names() -> list[str]:
    """The printable character that byte-level BPE uses for each byte, by its published rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, n = [""] * 256, 0
    for b in range(256):
        if b in keep:
            names[b] = chr(b)
        else:
            names[b], n = chr(256 + n), n + 1
    return names


class Pieces:
    """ids(text) as little-endian bytes of `width` bytes an id (2 if the vocabulary allows, else 4)."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(self.tokenizer.to_str())
        kinds = json.dumps(spec["pre_tokenizer"]), json.dumps(spec["normalizer"])
        self.words = '"Lowercase"' in kinds[1] and '"Removed"' in kinds[0]  # white space is dropped
        known = self.words or (spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"])
        if not known:
            raise ValueError(f"{path}: this tokenizer may not cut at white space")
        suffix = "'s|'t|'re|'ve|'m|'ll|'d|"
        if self.words:
            self.parts = re.compile(rf"{suffix}[{_LETTERS}]+|[0-9]|[^{_SPACE}{_LETTERS}0-9]+").findall
        else:
            self.parts = re.compile(rf"{suffix} ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+").findall
            self.split = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self.names = _byte_names()
        self.cache: dict = {}
        self.old: dict = {}
        self.small: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.small.get(part)
        if found is None:
            if len(self.small) >= _CACHE:
                self.small.clear()
            names = self.names
            found = self.small[part] = self._pack([t.id for t in self.model.tokenize("".join([names[b] for b in part.encode()]))])
        return found

    def _piece(self, key, piece) -> bytes:
        found = self.cache.get(key) or self.old.get(key)
        if found is None:
            text = piece.decode() if self.words else piece
            if _PLAIN.fullmatch(text):
                found = b"".join([self._part(x) for x in self.parts(text.lower() if self.words else text)])
            else:
                found = self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.cache) >= _CACHE:
            self.old = dict(self.cache)
            self.cache.clear()  # the same dict stays, as callers hold its get
        self.cache[key] = found
        return found

    def _after_space(self, word: str) -> bytes:
        """Ids of a blank and what stands before the next blank; white space in it is cut as in the whole text."""
        if word and not _SPACES.search(word):
            return self._piece(word, " " + word)
        get = self.cache.get
        return b"".join([(get(p[1:]) if p[0] == " " and len(p) > 1 else None) or self._piece(p[1:] if p[0] == " " and len(p) > 1 else "\n" + p, p) for p in self.split(" " + word)])

    def ids(self, text: bytes) -> bytes:
        get = self.cache.get
        if self.words:
            piece = self._piece
            return b"".join([get(p) or piece(p, p) for p in text.split()])
        plain = text.decode()
        if "  " in plain or plain[:1].isspace() or plain[-1:].isspace():
            return b"".join([self._piece("\n" + p, p) for p in self.split(plain)])
        # a blank belongs to the word after it: words after one blank are keyed without it, anything else after a line feed
        after = self._after_space
        first, *rest = plain.split(" ")
        return b"".join([*(self._piece("\n" + p, p) for p in self.split(first)), *[get(w) or after(w) for w in rest]])


def release() -> None:
    """Gives back the caches' memory, for a worker that goes on to other work."""
    if _found:
        import gc

        import pyarrow

        _found.clear()
        gc.collect()
        pyarrow.default_memory_pool().release_unused()


def pieces(path: str) -> Pieces:
    """One instance for each Python worker and path."""
    if path not in _found:
        _found[path] = Pieces(path)
    return _found[path]
