"""Ids of whole texts by the tokenizers library, at the cost of the distinct words.

Both tokenizer kinds used here cut a text before every run of white space that
follows other characters, whatever stands on either side: no token spans that
place and no rule looks across it. So a text's ids are those of its pieces
" word" in order, and each worker keeps the ids of short pieces in a bounded table.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from itertools import chain

MAX_ENTRIES = 400_000   # of a generation of a table, per worker
MAX_PIECE = 48          # longer pieces are encoded each time
CUT = re.compile(r"(?<=\S)(?=[ \n])")
# a plain word: Latin-1 letters, then ASCII punctuation; both kinds split it just there
WORD = re.compile(r"([ \n]?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")


def cuts_at_space(spec: dict) -> bool:
    """Whether a tokenizer's file describes one of the kinds that the cuts are exact for."""
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel":
        ok = norm is None and pre.get("use_regex") and not pre.get("add_prefix_space")
    else:
        steps = pre.get("pretokenizers") or [{}]
        ok = (steps[0].get("type") == "Split" and steps[0].get("invert")
              and steps[0].get("behavior") == "Removed"
              and {n["type"] for n in (norm or {}).get("normalizers", [])}
              <= {"NFC", "Replace", "Lowercase"})
    return bool(ok) and not any(
        re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"]
        for t in spec.get("added_tokens", []))


def _byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = _byte_alphabet()


class Memo(dict):
    """piece -> value, computed when missing. Holds two generations of at most
    ``MAX_ENTRIES``: what is used again outlives a full table."""

    def __init__(self, make, prefix: str = ""):
        self.make, self.prefix, self.old = make, prefix, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(self.prefix + piece)
            if len(piece) > MAX_PIECE:
                return value
        if len(self) >= MAX_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


def evenly_spaced(text: str) -> bool:
    """Whether all white space is single blanks and line ends between words: as many as there are
    gaps, and with the words the whole text. Three times as fast as a pattern."""
    words, n = text.split(), text.count(" ") + text.count("\n")
    return len(words) == n + 1 and sum(map(len, words)) + n == len(text)


def single_blanks(text: str) -> bool:
    """Whether a text's blanks stand one by one between other characters, none after a line end, and
    all other white space is line ends, none of them first."""
    return ("  " not in text and "\n " not in text and not text.endswith((" ", " \n"))
            and not text[:1].isspace()
            and sum(map(len, text.split())) + text.count(" ") + text.count("\n") == len(text))


class PieceMap:
    """Applies ``make`` to the pieces of texts; gives the list of its values in order."""

    def __init__(self, make, exact_at_space: bool = True):
        self.make, self.exact = make, exact_at_space
        self.spaced, self.raw, self.line = Memo(make, " "), Memo(make), Memo(make, "\n")

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if not self.exact:
            return [self.make(text)]
        if not evenly_spaced(text):
            return list(map(self.raw.__getitem__, CUT.split(text)))
        out, spaced = [], self.spaced.__getitem__
        first = self.raw
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(first[head])
            out.extend(map(spaced, rest))
            first = self.line
        return out


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = max(chain(spec["model"]["vocab"].values(),
                                    (t["id"] for t in spec.get("added_tokens", [])))) + 1
        self.byte_level = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.parts = PieceMap(self._make, cuts_at_space(spec))
        self.cores, self.tails = Memo(self._core), Memo(self._encode)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, word: str) -> bytes:
        """Ids of one pre-token given in the model's own byte alphabet."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _make(self, piece: str) -> bytes:
        m = WORD.fullmatch(piece) if self.parts.exact else None
        if not m:
            return self._encode(piece)
        space, word, tail = m.groups()
        if self.byte_level:
            front = self.tails["\n"] if space == "\n" else b""
            lead = BYTES[32] if space == " " else ""
        else:  # white space is dropped, case folded
            front, word, lead = b"", word.lower(), ""
        key = lead + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTES))
        if not tail and not front and key not in self.cores:
            return self._core(key)   # the table of pieces keeps it
        return front + self.cores[key] + (self.tails[tail] if tail else b"")

    def __call__(self, text: str | None) -> bytes:
        return b"".join(self.parts(text)) if text else b""


@cache
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each file and worker process."""
    return TextEncoder(path)
