"""Encoding with the tokenizers library, with each distinct piece of a text encoded once per worker.

A text may be cut before a space or line feed that follows a character that is no white space: both tokenizers used here
split there whatever stands around, so the ids of the pieces, joined, are the ids of the text. A text that holds the string
of a special token is given to the library whole, so that it is encoded as the library by default does."""

from __future__ import annotations

import json
import os
import re
import struct

from veilgrid.llm.common import Known, remembering

#: Distinct pieces that a worker remembers, about 200 bytes each. Beyond it the memory starts anew.
CACHE_PIECES = 600_000
#: A space or line feed, letters that have one form and one lower case, then nothing or what begins with an ASCII mark.
_WORD = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~].*)?", re.DOTALL)
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_ENCODERS: dict[tuple[str, int], "PieceEncoder"] = {}


def _byte_letter(b: int) -> str:
    """The letter that stands for a byte above 0x7E in byte-level vocabularies: bytes that print stand for themselves, the
    others for letters from 0x100 on, after the 33 that stand for 0x00 to 0x20."""
    if b == 0xAD:
        return chr(0x143)
    return chr(b) if b > 0xA0 else chr(0x121 + b - 0x7F)


class PieceEncoder:
    """``encode(texts)`` gives for each text its ids as little-endian unsigned 32-bit integers. Null counts as empty."""

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in steps["added_tokens"]]
        self.sign = os.path.commonprefix(self.special)  # one search tells most texts apart
        self.limit = limit
        self.known = Known(self._find)
        self.tails: dict[str, bytes] = {"": b""}
        # most pieces are a word of plain letters: its tokens come from the library's model at once, past the steps
        # before it, where those are known to leave such a word alone but for its case and the space before it
        before = steps["pre_tokenizer"] or {}
        self.lower = "Lowercase" in json.dumps(steps["normalizer"])
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not steps["normalizer"]:
            self.lead = {"": ("", b""), " ": ("\u0120", b""), "\n": ("", self._raw(["\n"])[0])}
        elif self.lower and before.get("type") == "Sequence" and self._raw([" ", "\n"]) == [b"", b""]:
            self.lead = {"": ("", b""), " ": ("", b""), "\n": ("", b"")}
        else:
            self.lead = None
        self.model = self.tokenizer.model
        self.letters = {c: "".join(_byte_letter(b) for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}

    def _word(self, piece: str) -> bytes | None:
        """The ids of a piece that is a word with marks after it; None if it is something else."""
        found = _WORD.fullmatch(piece) if self.lead else None
        if not found:
            return None
        space, word, tail = found[1], found[2], found[3] or ""
        sign, ids = self.lead[space]
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = "".join(self.letters.get(c, c) for c in word)
        if tail not in self.tails:
            if len(self.tails) > self.limit // 20:
                self.tails = {"": b""}
            self.tails[tail] = self._raw([tail])[0]
        tokens = [t.id for t in self.model.tokenize(sign + word)]
        return ids + struct.pack(f"<{len(tokens)}I", *tokens) + self.tails[tail]

    def _raw(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    @staticmethod
    def _keys(text: str) -> list[str] | None:
        """Keys of a text's pieces: a piece begins with a space, or with a line feed where the key begins with NUL; the
        first piece has a key that begins with SOH. None if the text can't be cut this way."""
        if "\0" in text or "\1" in text:
            return None
        keys = text.replace("\n", " \0").split(" ")
        keys[0] = "\1" + keys[0]
        if len(keys) > 1 and not keys[-1]:
            keys[-1] = "\1 "  # a last space alone
        return keys

    @staticmethod
    def _piece(key: str) -> str | None:
        """The text of a key, or None if no cut is allowed after it."""
        if key[:1] == "\1":
            return None if key[-1:].isspace() and key != "\1 " else key[1:]
        body = key[1:] if key[:1] == "\0" else key
        if not body or body[-1].isspace():
            return None
        return ("\n" if key[:1] == "\0" else " ") + body

    def _find(self, key: str) -> bytes | None:
        """The ids of a key's piece; None if no cut is allowed after it."""
        piece = self._piece(key)
        if piece is None:
            return None
        ids = self._word(piece)
        return self._raw([piece])[0] if ids is None else ids

    def _has_special(self, text: str) -> bool:
        return self.sign in text and any(x in text for x in self.special)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        out, get = [], self.known.__getitem__
        for text in texts:
            if not text:
                out.append(b"")
            elif self._has_special(text):
                out += self._raw([text])
            elif (keys := self._keys(text)) is None:
                out.append(self._careful(text))
            else:
                try:
                    out.append(b"".join(map(get, keys)))
                except TypeError:  # some piece ends in white space
                    out.append(self._careful(text))
        return out

    def _careful(self, text: str) -> bytes:
        pieces = _SAFE_CUT.split(text)
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self._raw(distinct)))
        return b"".join(map(ids.__getitem__, pieces))


def encoder(path: str, limit: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder per worker process and file."""
    remembering(f"pieces {path}", _ENCODERS.clear)
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = PieceEncoder(path, limit)
    return _ENCODERS[path, limit]
