"""Tokenizing with the ``tokenizers`` library, each distinct piece of text once per worker.

The library works on pre-tokens: it splits a text by a fixed pattern and merges bytes within each part alone.  So a
text may be cut at any pre-token border and its ids joined again.  Texts repeat their words a lot, hence a bounded
memo of pieces saves most of the work.  Three ways of cutting, all exact:

* plain texts (ASCII without apostrophes, Latin letters, single white space) are cut into pre-tokens,
* other texts of usual white space are cut before each run of white space,
* texts with unusual white space are not cut.

A vocabulary file whose normalizer or splitter is not the one that a style stands for is used without cutting at all.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"  # each one sign in lower case too
_UNUSUAL = re.compile(rf"[^ -&(-~\n{_LETTERS}]|[ \n]{{2}}")
#: The same test for texts of Latin-1, by deleting what is usual: far faster than a pattern.
_USUAL_BYTES = bytes(i for i in range(256) if not _UNUSUAL.search(chr(i)))
_DOUBLE_SPACES = ("  ", "\n\n", " \n", "\n ")
_ODD_SPACE = re.compile("[\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
_COARSE = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_PRETOKEN = {
    "spaced": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s"),
    "bare": re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+"),
}


#: What the files of a style say of normalizing and splitting.
_SETTINGS = {
    "spaced": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None),
    "bare": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "</w>",
    ),
}


def cuts_as(settings: dict, style: str) -> bool:
    """Whether a vocabulary file normalizes, splits and merges as the style says."""
    model = settings["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return plain and (settings["normalizer"], settings["pre_tokenizer"], model.get("end_of_word_suffix")) == _SETTINGS[style]


def _byte_signs() -> dict[int, str]:
    """The vocabulary's spelling of characters: one printable sign for each UTF-8 byte, others moved up past 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    return {i: "".join(sign[b] for b in chr(i).encode()) for i in range(0x250) if chr(i) != "\n"}


_SPELLED = _byte_signs()


def is_plain(text: str) -> bool:
    """Whether a text may be cut into pre-tokens by the simple patterns."""
    try:
        usual = not text.encode("latin-1").translate(None, _USUAL_BYTES)
    except UnicodeEncodeError:
        return not _UNUSUAL.search(text)
    return usual and not any(d in text for d in _DOUBLE_SPACES)


class Encoder:
    """Ids of whole texts, as little-endian unsigned 16-bit (or 32-bit) bytes.

    ``style`` is ``spaced`` if the vocabulary's pre-tokens take a leading space with them and ``bare`` if letters are
    lower-cased and white space is dropped.  Pre-tokens go to the library's model itself, in its spelling, which spares
    its normalizing and splitting.  The memo has a young and an old half of ``memo_size`` pieces
    each; a full young half becomes the old one, so that frequent pieces stay.
    """

    def __init__(self, path: str, style: str, memo_size: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.vocab = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self.style, self.memo_size = style, memo_size
        self.cuts = cuts_as(json.loads(self.tok.to_str()), style)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn_pretokens(self, pieces: list[str]) -> None:
        text = "\n".join(pieces)
        spelled = (text if self.style == "spaced" else text.lower()).translate(_SPELLED).split("\n")
        model, memo, code = self.tok.model, self.memo, "H" if self.dtype.itemsize == 2 else "I"
        for p, word in zip(pieces, spelled, strict=True):
            ids = array(code, [t.id for t in model.tokenize(word)])
            if sys.byteorder == "big":
                ids.byteswap()
            memo[p] = ids.tobytes()

    def _learn(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
            self.memo[p] = np.array(e.ids, dtype=self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null counts as empty."""
        if not text:
            return b""
        plain = self.cuts and is_plain(text)
        if plain:
            pieces = _PRETOKEN[self.style].findall(text)
        elif not self.cuts or _ODD_SPACE.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        else:
            pieces = _COARSE.findall(text)
        memo = self.memo
        if len(memo) > self.memo_size:
            self.old, self.memo = memo, (memo := {})
        if new := [p for p in set(pieces) if p not in memo]:
            old = self.old
            memo.update((p, old[p]) for p in new if p in old)
            new = [p for p in new if p not in old]
            if plain:
                if words := [p for p in new if not p.isspace()]:
                    self._learn_pretokens(words)
                new = [p for p in new if p.isspace()]
            if new:
                self._learn(new)
        return b"".join([memo[p] for p in pieces])

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)

    def batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]


@functools.cache
def encoder(path: str, style: str) -> Encoder:
    """One encoder for each worker process, so that its memo serves all of the worker's tasks."""
    return Encoder(path, style)
