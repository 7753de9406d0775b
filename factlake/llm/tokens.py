"""Token ids and token counts of whole texts.

Both cut a text at places where every tokenizer used here cuts as well and remember what each piece gave: between a run
of plain letters and what follows it, before one space, around a line end. Texts that the pattern of such pieces doesn't
cover wholly are cut only before single spaces, and texts in which a special string may stand are not cut at all, so
that the tokenizer itself handles both. The memory is bounded by CACHED pieces.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable, Iterable

import numpy as np

#: Pieces remembered by one Python worker, and the longest one that is remembered, in characters.
CACHED, LONGEST = 300_000, 48

# Letters of Latin-1, which are letters for every tokenizer; what follows a piece must be ASCII, as it can't join then.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(rf" ?[{_LETTER}]++(?![^ -~\n{_LETTER}])| ?[!-&(-@\[-`{{-~]++(?![^ -~\n{_LETTER}]|')|\n(?=[!-~{_LETTER}])")
_CUT = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")

_RUN = re.compile(rf" ?[{_LETTER}]+")

# The alphabet of byte-level vocabularies: a byte that is visible in Latin-1 stands for itself, the others follow 255.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


def pieces(text: str) -> list[str]:
    """Pieces of a text whose tokens, one after the other, are the tokens of the text."""
    if "<|" in text:
        return [text]
    out = _PIECES.findall(text)
    return out if sum(map(len, out)) == len(text) else _CUT.split(text)


class Encoder:
    """Little-endian 32-bit ids of whole texts by a file of the tokenizers library, without added special tokens.

    A piece that is a run of plain letters is one word for byte-level vocabularies, so the library's model gets it
    directly; any other new piece goes through the whole tokenizer. Whether words may go directly, and whether their
    case and their space count, is tried out on PROBES first.
    """

    PROBES = ["the", " the", " Été", "ÀÉÎ", " straße", "Œuvre"[1:], " nderful", "Þing", " x", "y", " ofthehe", "ingtiaño"]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._known: dict[str, bytes] = {}
        self._word = next((f for f in (self._as_is, self._folded) if self._agrees(f)), None)

    def _encode(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _as_is(self, piece: str) -> bytes:
        return pack([t.id for t in self._model.tokenize("".join(map(_ALPHABET.__getitem__, piece.encode())))])

    def _folded(self, piece: str) -> bytes:
        return self._as_is(piece.lstrip(" ").lower())

    def _agrees(self, word: Callable[[str], bytes]) -> bool:
        try:
            return all(word(p) == self._encode(p) for p in self.PROBES)
        except Exception:  # a model that doesn't know the alphabet
            return False

    def encoded(self, texts: Iterable[str | None]) -> list[bytes]:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size > 1 << 20:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str | None]) -> list[bytes]:
        known, word, encode = self._known, self._word, self._encode
        if len(known) > CACHED:
            known.clear()
        cut = [pieces(t) if t else [] for t in texts]
        odd = {}
        for x in set().union(*cut).difference(known):
            (known if len(x) <= LONGEST else odd)[x] = word(x) if word and _RUN.fullmatch(x) else encode(x)
        if not odd:
            return [b"".join(map(known.__getitem__, p)) for p in cut]
        return [b"".join([odd[x] if x in odd else known[x] for x in p]) for p in cut]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Remembered(dict):
    """dict of piece to result that asks for what it lacks."""

    def __init__(self, make: Callable[[str], int]):
        self.make = make

    def __missing__(self, piece: str) -> int:
        out = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = out
        return out


# Fixed pattern of byte-level vocabularies.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeCounter:
    """Counts the tokens of byte-level BPE without making any id.

    A word is a linked list of symbols and a heap of its adjacent pairs. The pair of lowest rank, leftmost of equals,
    is popped and merged, and the pairs it makes with its neighbours are pushed; entries whose symbols have changed
    since are passed over. The count is initial symbols minus merges.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = regex.compile(_WORDS)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        names = {s: i for i, s in enumerate(spec["model"]["vocab"])}
        self.symbols = [names[_ALPHABET[b]] for b in range(256)]
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[names[left], names[right]] = (rank, names[left + right])
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def word(self, data: bytes) -> int:
        symbol = [self.symbols[b] for b in data]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            if m := merges.get((symbol[i], symbol[i + 1])):
                heap.append((m[0], i, symbol[i], symbol[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i] if symbol[i] == left else len(data)
            if j >= len(data) or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            n -= 1
            if k < len(data):
                before[k] = i
                if m := merges.get((made, symbol[k])):
                    heapq.heappush(heap, (m[0], i, made, symbol[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbol[h], made))):
                heapq.heappush(heap, (m[0], h, symbol[h], made, m[1]))
        return n

    def plain(self, text: str) -> int:
        return sum(self.word(w.encode()) for w in self.words.findall(text))

    def piece(self, text: str) -> int:
        """Tokens of a piece; each special string in it is one."""
        if self.special is None:
            return self.plain(text)
        found = self.special.findall(text)
        return len(found) + sum(map(self.plain, self.special.split(text))) if found else self.plain(text)


_counters: dict[str, Remembered] = {}


def counter(path: str) -> Remembered:
    if path not in _counters:
        _counters[path] = Remembered(MergeCounter(path).piece)
    return _counters[path]


def counted(text: str | None, memory: Remembered) -> int:
    return sum(map(memory.__getitem__, pieces(text))) if text else 0
