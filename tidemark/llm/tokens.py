"""Fast exact encoding with a public byte-level BPE vocabulary of the tokenizers library."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from tidemark.llm.common import worker_cache

_RUN = re.compile(r"\s\s")


def tokenizer_json(path: str) -> str:
    """The vocabulary file as text, read once by the driver and sent with the tasks (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def id_type(spec: str) -> str:
    """The type that holds every id of a vocabulary, added tokens included: two bytes where they do."""
    known = json.loads(spec)
    return "<u2" if len({*known["model"]["vocab"], *(t["content"] for t in known.get("added_tokens", ()))}) <= 1 << 16 else "<u4"


class _Pieces(dict):
    """chunk of text -> the bytes of its ids; ``prefix`` stands before each chunk.

    Two generations bound the memory: a full one becomes the old one, from which
    chunks that are met again come back.
    """

    def __init__(self, coder: "Coder", prefix: str):
        self.coder, self.prefix, self.old = coder, prefix, {}
        self.lead = coder.byte_map[32] if prefix else ""

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            tail = self.coder.marks.get(chunk[-1:])
            if tail and chunk[:-1].isalpha():  # a run of letters ends before a mark
                ids = self[chunk[:-1]] + tail
            elif chunk.isascii() and chunk.isalpha():  # one piece, whose bytes but the blank are named as they are
                ids = array(self.coder.code, [t.id for t in self.coder.model.tokenize(self.lead + chunk)]).tobytes()
            else:
                ids = self.coder.ids(self.prefix + chunk)
        if len(self) >= self.coder.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class Coder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes (2 where the vocabulary allows it).

    The vocabulary's pre-tokeniser never joins a space-led word with what stands
    before it, so that words between single spaces and single line breaks can be
    encoded once and remembered: Latin words go straight to the library's BPE model, all else through its
    pre-tokeniser first.  A text with any run of two or more white-space
    characters, or with an added token of the vocabulary (``<|endoftext|>``), is encoded as a whole.  ``most`` bounds the remembered words.
    """

    most = 300_000

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype(id_type(spec))
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # ids of machine order; the files say little-endian
        self.byte_map = {}
        for c in map(chr, range(256)):  # the library's own name of each byte
            if c.isascii():
                self.byte_map[ord(c)] = level.pre_tokenize_str(c)[0][0]
        for c in map(chr, range(0x80, 0x800)):
            named = level.pre_tokenize_str(c)[0][0]
            for byte, name in zip(c.encode(), named, strict=True):
                self.byte_map[byte] = name
        self.marks = {c: self.ids(c) for c in ".,"}
        self.bare, self.spaced = _Pieces(self, ""), _Pieces(self, " ")
        self.line = self.ids("\n")

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        word = text[1:] if text[0] == " " else text
        if word.isalpha() and max(word) < "\u0250":  # one piece of the pre-tokeniser
            named = text.encode().decode("latin-1").translate(self.byte_map)
            return array(self.code, [t.id for t in self.model.tokenize(named)]).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The bytes of a text's ids; null is as empty."""
        if not text:
            return b""
        if _RUN.search(text) or self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        out: list[bytes] = []
        bare, spaced = self.bare, self.spaced.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(bare[words[0]])
            out.extend(map(spaced, words[1:]))
            out.append(self.line)
        out.pop()
        return b"".join(out)


def coder(spec: str) -> Coder:
    return worker_cache(f"coder-{hash(spec)}", lambda: Coder(spec))
