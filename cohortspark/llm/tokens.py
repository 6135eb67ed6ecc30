"""Token ids of whole texts under a public tokenizer file, with a bounded memory of words.

The tokenizers used here cut at white space before anything else, so a text's ids are those
of its white-space separated pieces in order. Every worker remembers the ids of the pieces it
met lately and encodes only new ones: a new piece is normalised and cut by the file's own
pattern, unless it holds ASCII letters alone, and a pre-token goes through the merges once while
it is remembered.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import pyarrow as pa
import regex

REMEMBERED = 600_000  # pieces in each of two generations


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The visible characters that byte-level models write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memory(dict):
    """Piece to ids (little-endian 16 bit), in two generations: what is used stays."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = [t["content"] for t in parts["added_tokens"]]
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in steps]
        plain = kinds == ["Split", "ByteLevel"] and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        pattern = steps[0]["pattern"]["Regex"] if plain else ""
        self.cut = regex.compile(pattern).findall if plain else None
        steps = (parts.get("normalizer") or {}).get("normalizers", [])
        self.lowers = any(n["type"] == "Lowercase" for n in steps)
        # printable ASCII without spaces is normalised in its case only
        self.cases = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} for n in steps)
        # ASCII letters are one pre-token: what the pattern looks for before a run of letters begins with an apostrophe
        before, run, _ = f"{pattern}|".partition(r"[\p{L}]+|")
        self.whole = bool(run) and all(x.startswith("'") for x in before.split("|")[:-1]) and not before.split("|")[-1]
        self.letters = _byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}  # pre-token to ids

    def age(self) -> None:
        """Make room: what is not used until the next time goes."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(self.merged) > REMEMBERED:
            self.merged.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._encoded(piece)
        self[piece] = ids
        return ids

    def _merged(self, text: str) -> bytes:
        """Ids of a pre-token in the model's letters."""
        return array("H", [t.id for t in self.tokenize(text)]).tobytes()

    def _encoded(self, piece: str) -> bytes:
        if not piece:
            return b""
        special = False
        for s in self.special:
            special = special or s in piece
        if special or not self.cut or not piece.isprintable():  # control characters: patterns differ on which are white space
            return self._by_tokenizer(piece)
        if self.cases and piece.isascii():
            folded = piece.lower() if self.lowers else piece
            if self.whole and folded.isalpha():
                return self._merged(folded)
        else:
            folded = self.tokenizer.normalizer.normalize_str(piece)
            if " " in folded:  # a piece that is normalised to several
                return self._by_tokenizer(piece)
        merged, found = self.merged, b""
        for token in self.cut(folded):
            ids = merged.get(token)
            if ids is None:
                ids = merged[token] = self._merged(token if token.isascii() else "".join([self.letters[b] for b in token.encode()]))
            found = found + ids if found else ids
        return found

    def _by_tokenizer(self, piece: str) -> bytes:
        return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def _memory(path: str) -> _Memory:
    return _Memory(path)


def _spaced(text: str | None, lowers: bool) -> str:
    """The text with spaces for other ASCII white space; in lower case where that is sure to change no id."""
    if not text:
        return ""
    if lowers and "<|" not in text:
        try:  # up to U+00FF case is one to one and composition changes nothing
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    for c in "\t\n\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return text


def encoded(texts: pa.Array, path: str) -> list[bytes]:
    """Per row the ids as little-endian 16-bit bytes; a null text has none."""
    memory, out = _memory(path), []
    for text in texts.to_pylist():
        out.append(b"".join(map(memory.__getitem__, _spaced(text, memory.lowers).split(" "))))
        memory.age()
    return out
