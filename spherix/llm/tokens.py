"""Exact token ids by the tokenizers library, with the ids of words kept.

A byte-level BPE vocabulary with the usual pre-tokenizer never lets a piece run on past a letter, digit or
sign into a following space, so a text's ids are those of its words, each with the space before it, in a row.
The exceptions are a space between two other white spaces, white space other than tab, line ends and the
plain space, and added tokens such as <|endoftext|>; stretches of text with one go to the library whole. The
words of many texts are looked up at once in a table that holds their very bytes, so no two words can be taken
for each other; the library encodes each word that isn't there or is too long for it. The table's size is
fixed: when it is full it is emptied.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_RARE_SPACE = "\x0b\x0c\x1c-\x1f\x85\xa0  -     　"
_RARE = re.compile(f"[{_RARE_SPACE}]").search
#: A space at which a text can always be cut.
_CUT = re.compile(rf"(?<=[^\s{_RARE_SPACE}]) (?=[^\s{_RARE_SPACE}])")
#: Bytes that a rare white space has.
_SUSPECT = np.zeros(256, dtype=bool)
_SUSPECT[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Where words are cut besides: between a letter and a sign, and before a line end after either.
_LETTER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True
#: Characters of a stretch; bytes that are looked up at once.
STRETCH, CHUNK = 1 << 16, 1 << 20
#: Words that a Python worker keeps, at most; bytes of such a word; words that are encoded as one text.
KEPT_WORDS, LANES, TOGETHER = 3 << 18, 3, 256
SLOTS = 1 << 21
_SHIFT = np.uint64(64 - (SLOTS - 1).bit_length())
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F)]
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class Words:
    """A hash table from words, as rows of LANES numbers of 8 bytes and the length, to runs of ids."""

    def __init__(self):
        self.row = np.full(SLOTS, -1, dtype=np.int32)
        self.words = np.zeros((KEPT_WORDS, LANES + 1), dtype=np.uint64)
        self.start, self.count = np.zeros(KEPT_WORDS, dtype=np.int64), np.zeros(KEPT_WORDS, dtype=np.int32)
        self.ids, self.rows, self.used = np.zeros(1 << 20, dtype=np.uint32), 0, 0

    @staticmethod
    def _slots(words: np.ndarray) -> np.ndarray:
        h = words[:, LANES].copy()
        for k in range(LANES):
            h = (h ^ words[:, k]) * _MIX[k]
            h ^= h >> np.uint64(29)
        return (h * _MIX[3] >> _SHIFT).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Row of each word, or -1. A word is compared with the rows from its slot on up to a free slot."""
        slot = self._slots(words)
        row = self.row[slot]
        rest = np.nonzero(row >= 0)[0]
        while len(rest):
            rest = rest[(self.words[row[rest]] != words[rest]).any(axis=1)]
            slot[rest] = slot[rest] + 1 & SLOTS - 1
            row[rest] = self.row[slot[rest]]
            rest = rest[row[rest] >= 0]
        return row

    def put(self, data: bytes) -> int:
        """Ids behind those in use; their place. They are lost unless rows are added for them."""
        n = len(data) // 4
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(1 << 18, n), dtype=np.uint32)])
        self.ids[self.used : self.used + n] = np.frombuffer(data, dtype="<u4")
        return self.used

    def add(self, words: np.ndarray, start: np.ndarray, count: np.ndarray, total: int) -> None:
        """New, distinct words and the places of their ids, of which `total` were put; empties the table if it is full."""
        n = len(words)
        if self.rows + n > KEPT_WORDS:
            self.row[:], self.rows, self.used = -1, 0, 0
            self.ids = np.zeros(1 << 20, dtype=np.uint32)
            return
        own = np.arange(self.rows, self.rows + n, dtype=np.int32)
        self.words[own], self.start[own], self.count[own] = words, start, count
        self.rows, self.used = self.rows + n, self.used + total
        slot, rest = self._slots(words), np.arange(n)
        while len(rest):
            free = self.row[slot[rest]] < 0
            self.row[slot[rest[free]]] = own[rest[free]]
            rest = rest[self.row[slot[rest]] != own[rest]]
            slot[rest] = slot[rest] + 1 & SLOTS - 1


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.by_word = self.by_word and not any(" " in a for a in added)  # a cut at a space could part it
        if self.by_word:
            self.known = Words()
            self.size = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # bytes of a token: a character of its name each
            for name, k in spec["model"]["vocab"].items():
                self.size[k] = len(name)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words. Those put in a row stay apart at their first spaces, and are told apart by their bytes."""
        fit = [w[:1] in (b" ", b"\n") and len(w) > 1 and w[-1] not in b"\t\n\r " for w in words]
        row = [w for w, x in zip(words, fit) if x]
        data = b"".join(self._library([b"".join(row[i : i + TOGETHER]).decode() for i in range(0, len(row), TOGETHER)]))
        ends = np.cumsum(self.size[np.frombuffer(data, dtype="<u4")])
        cuts = (4 * (np.searchsorted(ends, np.cumsum([len(w) for w in row])) + 1)).tolist()
        many, one = iter([data[a:b] for a, b in zip([0, *cuts], cuts)]), iter(self._library([w.decode() for w, x in zip(words, fit) if not x]))
        return [next(many) if x else next(one) for x in fit]

    def _stretches(self, text: str) -> list[str]:
        """text, cut at spaces where every piece ends."""
        if len(text) <= STRETCH:
            return [text]
        out, lo = [], 0
        while len(text) - lo > STRETCH and (m := _CUT.search(text, lo + STRETCH)):
            out.append(text[lo : m.start()])
            lo = m.start()
        return [*out, text[lo:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        runs: list[list[bytes]] = []
        own, size = [], 0
        for text in texts:
            stretches = self._stretches(text) if self.by_word else [text]
            slots = [b""] * len(stretches)
            runs.append(slots)
            for k, s in enumerate(stretches):
                raw = s.encode()
                if not self.by_word or self.added(s):
                    slots[k] = self._library([s])[0]
                elif raw:
                    if size + len(raw) > CHUNK and own:
                        self._by_words(own)
                        own, size = [], 0
                    own.append((slots, k, s, raw))
                    size += len(raw)
        if own:
            self._by_words(own)
        return [x[0] if len(x) == 1 else b"".join(x) for x in runs]

    def _by_words(self, own: list[tuple]) -> None:
        """Fill the slots of stretches (slots, place, text, its bytes), none empty."""
        joined = b"".join([x[3] for x in own])
        data = np.frombuffer(joined + bytes(8 * LANES), dtype=np.uint8)
        lane = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        n = len(joined)
        data = data[:n]
        ends = np.cumsum([len(x[3]) for x in own])
        starts = ends - [len(x[3]) for x in own]
        space, blank = data == 32, _BLANK[data]
        inner = space.copy()
        inner[1:] &= blank[:-1]
        inner[:-1] &= blank[1:]
        inner[starts] = inner[ends - 1] = False
        odd = np.zeros(len(own), dtype=bool)
        odd[np.searchsorted(ends, np.nonzero(inner)[0], side="right")] = True
        for k in np.unique(np.searchsorted(ends, np.nonzero(_SUSPECT[data])[0], side="right")):
            odd[k] = odd[k] or _RARE(own[k][2]) is not None
        letter, sign = _LETTER[data], _SIGN[data]
        space[1:] |= sign[1:] & letter[:-1] | (data[1:] == 10) & (letter | sign)[:-1]
        space[starts] = True
        begin = np.nonzero(space)[0]
        size = np.append(begin[1:], n) - begin
        of = np.searchsorted(begin, np.append(starts, n))  # first word of each stretch
        words = np.empty((len(begin), LANES + 1), dtype=np.uint64)
        for k in range(LANES):
            words[:, k] = lane[np.minimum(begin + 8 * k, n)] & _MASK[np.clip(size - 8 * k, 0, 8)]
        words[:, LANES] = size
        short = size <= 8 * LANES
        row = np.where(short, self.known.find(words), -1)
        row[np.repeat(odd, np.diff(of))] = -2  # not asked for
        there = np.nonzero(row >= 0)[0]
        start, count = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        start[there], count[there] = self.known.start[row[there]], self.known.count[row[there]]
        missing = np.nonzero(row == -1)[0]
        if len(missing):
            places: dict[bytes, int] = {}
            k = np.array([places.setdefault(joined[a:b], len(places)) for a, b in zip(begin[missing].tolist(), (begin + size)[missing].tolist())])
            runs = self._encode_words(list(places))
            own_count = np.array([len(x) // 4 for x in runs], dtype=np.int64)
            own_start = self.known.put(b"".join(runs)) + np.cumsum(own_count) - own_count
            start[missing], count[missing] = own_start[k], own_count[k]
        place = np.cumsum(count) - count
        ids = self.known.ids[np.repeat(start - place, count) + np.arange(count.sum())]
        if len(missing):
            first = np.zeros(len(places), dtype=np.int64)
            first[k[::-1]] = missing[::-1]
            keep = np.nonzero(short[first])[0]
            self.known.add(words[first[keep]], own_start[keep], own_count[keep], int(own_count.sum()))
        flat, cuts = ids.astype("<u4", copy=False).tobytes(), (4 * np.append(place, len(ids))[of]).tolist()
        for j, (slots, k, s, _) in enumerate(own):
            slots[k] = self._library([s])[0] if odd[j] else flat[cuts[j] : cuts[j + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
