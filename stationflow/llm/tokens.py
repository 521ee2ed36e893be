"""Token ids of whole texts by a public tokenizer, with a memory of words seen before."""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
# Words held per Python worker, some 200 bytes each: 80 MB.
MOST_KEPT = 400_000
TOGETHER = 256
# White space other than spaces and line feeds, as one set of characters: searched several times faster than `[^\S \n]`.
_OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
# Bytes that byte-level vocabularies write as themselves. Fixed values.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTED} | {
    chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTED)
}
_MARKS = ".,!?;:%*$&|#)"


def plain_spaces(text: str) -> bool:
    """Whether all white space is single spaces and line feeds inside the text."""
    return not (text.startswith((" ", "\n")) or text.endswith((" ", "\n")) or any(p in text for p in _PAIRS) or _OTHER_SPACE.search(text))


class Encoder:
    """``ids(texts)``: for each text its ids as little-endian unsigned 32-bit bytes.

    The strings of special tokens are ordinary text. A byte-level tokenizer always cuts
    before a space or line feed that stands alone between other characters, so the ids
    of a text with no other white space are those of its words, each with the space
    before it, and of its line feeds. Words are remembered. It also cuts between a
    letter or digit and a mark, so a word with marks at its end needs no new encoding
    when the word is known. New words are encoded together, one per line: no word holds
    a line feed, so its ids stand between those of line feeds. Where the vocabulary's ids
    rank its merges, new words are merged by the faster library over the same vocabulary.
    """

    most_kept = MOST_KEPT

    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(DEFAULT))
        self.tokenizer.encode_special_tokens = True
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.line = self._whole("\n")
        pieces = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = pieces == "ByteLevel" and self.tokenizer.normalizer is None and len(self.line) == 4
        self.merger = self._merger() if self.by_word else None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _merger(self) -> tiktoken.Encoding | None:
        """The same merges in the faster library, where ids rank the merges as there."""
        model = json.loads(self.tokenizer.to_str())["model"]
        raw = {token: self._bytes(token) for token in model["vocab"]}
        base = [k for token, k in model["vocab"].items() if len(token) == 1]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if len(base) != 256 or made != list(range(256, 256 + len(made))) or sorted(base) != list(range(256)):
            return None
        ranks = {raw[t]: k for t, k in model["vocab"].items() if k < 256 + len(made)}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes(token: str) -> bytes:
        """Byte-level vocabularies write bytes that do not print as characters from 256 on, in order."""
        return bytes(_BYTE_OF.get(c, 0) for c in token)

    def _encode(self, known: dict[str, bytes], before: str, words: list[str]) -> None:
        line = np.frombuffer(self.line, np.uint32)[0]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            together = "\n".join([before + w for w in part])
            raw = np.array(self.merger.encode_ordinary(together), np.uint32).tobytes() if self.merger else self._whole(together)
            ids, begin = np.frombuffer(raw, np.uint32), 0
            ends = np.append(np.flatnonzero(ids == line), len(ids)) * 4
            for w, end in zip(part, ends.tolist(), strict=True):
                known[w] = raw[begin:end]
                begin = end + 4

    def _learn(self, known: dict[str, bytes], before: str, words: set[str]) -> None:
        stems, marks, marked = set(), set(), []
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem and len(stem) < len(w) and stem[-1].isalnum():
                mark = w[len(stem) :]
                marked.append((w, stem, mark))
                if stem not in known:
                    stems.add(stem)
                if mark not in self.bare:
                    marks.add(mark)
            elif w not in known:
                stems.add(w)
        self._encode(known, before, list(stems))
        self._encode(self.bare, "", [m for m in marks if m not in self.bare])
        for w, stem, mark in marked:
            known[w] = known[stem] + self.bare[mark]

    def _lines(self, text: str) -> list[tuple[list[str], list]]:
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            ids = list(map(self.spaced.get, words))
            ids[0] = self.bare.get(words[0])
            out.append((words, ids))
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.bare) + len(self.spaced) > self.most_kept:
            self.bare.clear()
            self.spaced.clear()
        out: list[bytes | None] = [None] * len(texts)
        held: dict[int, list[list]] = {}
        gaps: list[tuple[list[str], list, list[int]]] = []
        bare: set[str] = set()
        spaced: set[str] = set()
        for k, text in enumerate(texts):
            text = text or ""
            if not text or not self.by_word or not plain_spaces(text):
                out[k] = self._whole(text)
                continue
            lines = self._lines(text)
            held[k] = [ids for _, ids in lines]
            for words, ids in lines:
                if None in ids:
                    new = [i for i, v in enumerate(ids) if v is None]
                    gaps.append((words, ids, new))
                    if new[0] == 0:
                        bare.add(words[0])
                    spaced.update([words[i] for i in new if i])
        self._learn(self.bare, "", bare)
        self._learn(self.spaced, " ", spaced)
        # Only the words that were new are looked up again.
        for words, ids, new in gaps:
            for i in new:
                ids[i] = (self.spaced if i else self.bare)[words[i]]
        for k, lines in held.items():
            out[k] = self.line.join([b"".join(ids) for ids in lines])
        return out


def encoder(path: str | None = None, most_kept: int = MOST_KEPT) -> Encoder:
    """The encoder of this Python worker, which outlives a task when Spark reuses the worker."""
    held = sys.modules.setdefault("_stationflow_encoders", types.ModuleType("_stationflow_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    held[path].most_kept = most_kept
    return held[path]
