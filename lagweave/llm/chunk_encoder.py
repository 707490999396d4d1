"""Token ids of many texts, with each distinct stretch of text encoded once.

A vocabulary's pre-tokenizer splits a text before any merge, so a text may be cut wherever that split always has a
border, and the stretches encoded apart. The cuts of a slice of texts are found in numpy, Arrow's dictionary encoding
leaves the distinct stretches, and the library's own `encode` runs on those that this worker has not met. Ids are then
gathered by number.

Which cuts are safe depends on the normalizer and pre-tokenizer that the vocabulary's file names. For files with others
the texts are not cut at all, nor are texts in which one of the file's added tokens is spelt out. Long stretches are
encoded without being remembered, and the memory of known ones is bounded by entries and by the size of an entry.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from lagweave.llm import kernels as K

KNOWN, LONG_BYTES, LEARN, RECENT = 300_000, 64, 4096, 60_000

# What the files of the two known kinds of pre-tokenizers say.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# Text between stretches that are encoded in one call: a border on both sides, one id that no other character gives.
BYTE_LEVEL_BREAK, WORD_BREAK = "\n", " \x01 "

_SPACE, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[i for i in range(0x21, 0x7F) if not _KIND[i]]] = _MARK


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a white space character outside ASCII."""
    found = np.zeros(len(data), bool)
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(lead):
        return found
    a, b, c = data[lead], data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | (
        (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))))
    found[lead[two | three]] = True
    found[lead[two | three] + 1] = True
    found[lead[three] + 2] = True
    return found


def _changes(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where an ASCII letter, digit or mark is followed by one of another kind, apart from what follows an apostrophe."""
    return (kind[:-1] > _SPACE) & (kind[1:] > _SPACE) & (kind[:-1] != kind[1:]) & (data[:-1] != 0x27)


def byte_level_cuts(data: np.ndarray) -> np.ndarray:
    """Marks the bytes before which the byte-level pattern always has a border, whatever stands around: before and after a lone
    line break, before a lone space, between ASCII letters, digits and marks (but not after an apostrophe, which may
    open a contraction)."""
    kind = _KIND[data]
    wide = wide_spaces(data)
    solid = (kind != _SPACE) & ~wide
    cut = np.zeros(len(data), bool)
    lone = np.zeros(len(data), bool)
    lone[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A) | (data[1:-1] == 0x0D) | (data[1:-1] == 0x09)) & solid[:-2] & solid[2:]
    cut |= lone
    cut[1:] |= lone[:-1] & (data[:-1] != 0x20)
    cut[1:] |= _changes(data, kind)
    return cut


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Marks the starts of words after ASCII white space, and of ASCII letters, digits and marks after one another, for
    vocabularies that drop white space and lower-case each character alone."""
    kind = _KIND[data]
    space = (kind == _SPACE) & ((data < 0x1C) | (data == 0x20))
    cut = np.zeros(len(data), bool)
    cut[1:] = (space[:-1] & ~space[1:]) | _changes(data, kind)
    return cut


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that such a vocabulary sees, and which of them it drops: ASCII letters in lower case (where no other
    character follows that could change them first), without ASCII white space."""
    low = K.LOWER[data]
    before_wide = np.flatnonzero(data[1:] >= 0x80)
    low[before_wide] = data[before_wide]
    return low, (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def cuts_of(config: dict) -> Callable[[np.ndarray], np.ndarray] | None:
    """The safe cuts for a vocabulary file's normalizer and pre-tokenizer; None if they are of no known kind."""
    normalizer, split = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if normalizer is None and all(split.get(k) == v for k, v in BYTE_LEVEL.items()):
        return byte_level_cuts
    steps = split.get("pretokenizers", [])
    if ((normalizer or {}).get("type") == "Sequence" and [x["type"] for x in normalizer["normalizers"]] == WORD_NORMALIZERS
            and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_PATTERN}
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"]):
        return word_cuts
    return None


class Known:
    """Stretches with their ids, numbered from 0, found by a hash of their bytes and confirmed by the bytes themselves. All
    of it lies in flat arrays: the table is searched in two sorted parts, a large one and one of recent entries."""

    def __init__(self) -> None:
        self.text, self.ends = bytearray(), array("Q", [0])
        self.ids, self.starts = array("I"), array("Q", [0])
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.again = np.zeros(KNOWN, bool)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def find(self, data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of stretches of `data` (-1: unknown), and which of them share their hash with another stretch."""
        number = np.full(len(hashes), -1, np.int64)
        for held, numbers in self.parts:
            if len(held):
                at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
                same = held[at] == hashes
                number[same] = numbers[at[same]]
        hit = np.flatnonzero(number >= 0)
        ends = np.frombuffer(self.ends, np.uint64).astype(np.int64)
        size = np.diff(bounds)[hit]
        wrong = np.diff(ends)[number[hit]] != size
        right, size = hit[~wrong], size[~wrong]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = np.frombuffer(self.text, np.uint8)[at + np.repeat(ends[number[right]], size)] != data[at + np.repeat(bounds[right], size)]
        bad = np.concatenate((hit[wrong], right[np.unique(np.repeat(np.arange(len(right)), size)[differs])]))
        number[bad] = -1
        clash = np.zeros(len(hashes), bool)
        clash[bad] = True
        return number, clash

    def add(self, texts: bytes, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """Enters stretches that follow one another in `texts`; their ids are appended by the caller."""
        first = len(self)
        ends = len(self.text) + np.cumsum(sizes)
        self.text += texts
        self.ends.frombytes(ends.astype(np.uint64).tobytes())
        large, recent = self.parts
        hashes, numbers = np.concatenate((recent[0], hashes)), np.concatenate((recent[1], np.arange(first, first + len(sizes))))
        if len(hashes) > RECENT:
            hashes, numbers = np.concatenate((large[0], hashes)), np.concatenate((large[1], numbers))
        order = np.argsort(hashes)
        made = hashes[order], numbers[order]
        self.parts = [large, made] if len(hashes) <= RECENT else [made, (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def fresh(self) -> Known:
        """A table of what was met again since this one began, if that is less than half of what it may hold."""
        out, keep = Known(), np.flatnonzero(self.again[:len(self)])
        if len(keep) <= KNOWN // 2:
            ends, starts = np.array(self.ends, np.int64), np.array(self.starts, np.int64)
            at, _ = _spans(ends, keep)
            texts = np.frombuffer(self.text, np.uint8)[at]
            sizes = np.diff(ends)[keep]
            out.add(texts.tobytes(), sizes, _hashes(texts, np.concatenate(([0], np.cumsum(sizes)))))
            at, id_ends = _spans(starts, keep)
            out.ids, out.starts = array("I", np.array(self.ids, np.uint32)[at].tobytes()), array("Q", id_ends.astype(np.uint64).tobytes())
        return out


def _hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return K.mixed(K.span_hashes(K.prefix_hashes(data), bounds[:-1], bounds[1:]))


class ChunkEncoder:
    """Encodes slices of texts; `end_id` closes each text."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.cuts, self.end_id = cuts_of(config), end_id
        self.added = [x["content"].encode() for x in config.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.between = BYTE_LEVEL_BREAK if self.cuts is byte_level_cuts else WORD_BREAK
        mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.mark = mark[0] if self.cuts is not None and len(mark) == 1 else None
        self.known = Known()

    def _learn(self, parts: list[str]) -> None:
        """Appends the ids of the parts, many encoded in a call with the text between them. It is a border on both sides
        unless white space meets white space; such parts, and those that hold it, are encoded alone."""
        sign, known = self.between.strip(" "), self.known
        for a in range(0, len(parts), LEARN):
            some = parts[a:a + LEARN]
            joined = self.between.join(some)
            if (self.mark is None or joined.count(sign) != len(some) - 1 or any(x.decode() in joined for x in self.added)
                    or self.cuts is byte_level_cuts and any(map(_open_ended, some))):
                for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                    known.ids.extend(x.ids)
                    known.starts.append(len(known.ids))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            last = np.append(np.flatnonzero(ids == self.mark), len(ids))
            ends = len(known.ids) + last - np.arange(len(last))
            known.ids.frombytes(ids[ids != self.mark].tobytes())
            known.starts.frombytes(ends.astype(np.uint64).tobytes())

    def _numbers(self, parts: pa.LargeStringArray) -> np.ndarray:
        """The number of each stretch among the stored id lists. Those that are not remembered (long, or no room) are
        stored behind all others until the next call."""
        if len(self.known) > KNOWN // 2 and len(self.known) + len(parts) > KNOWN:
            self.known = self.known.fresh()
        data, bounds = K.text_bytes(parts)
        hashes = _hashes(data, bounds)
        numbers, clash = self.known.find(data, bounds, hashes)
        self.known.again[numbers[numbers >= 0]] = True
        new = np.flatnonzero(numbers < 0)
        if not len(new):
            return numbers
        texts = parts.take(pa.array(new)).to_pylist()
        size = np.diff(bounds)[new]
        short = (size <= LONG_BYTES) & ~clash[new]
        # Open-ended parts go last, so that they do not keep others from being encoded together.
        turn = np.lexsort((np.fromiter(map(_open_ended, texts), bool, len(texts)), ~short))
        n = min(int(short.sum()), KNOWN - len(self.known))
        stay = new[turn[:n]]
        at, _ = _spans(bounds, stay)
        numbers[new[turn]] = len(self.known) + np.arange(len(new))
        self.known.add(data[at].tobytes(), size[turn[:n]], hashes[stay])
        self._learn([texts[i] for i in turn.tolist()])
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of the texts whose UTF-8 bytes stand in `data`, each closed by the end id, and n + 1
        offsets of the texts' ids."""
        n, edges = len(offsets) - 1, offsets.astype(np.int64)
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts is not None and len(data):
            cut[:-1] = self.cuts(data)
            seen, dropped = word_bytes(data) if self.cuts is word_cuts else (data, np.zeros(len(data), bool))
            raw = data.tobytes()
            if any(x in raw for x in self.added):
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    if any(x in raw[a:b] for x in self.added):
                        cut[a:b] = dropped[a:b] = False
                        if seen is not data:
                            seen[a:b] = data[a:b]
            if dropped.any():
                cut[edges] = True
                before = np.concatenate(([0], np.cumsum(~dropped)))
                seen, edges, marks = seen[~dropped], before[edges], before[np.flatnonzero(cut)]
                cut = np.zeros(len(seen) + 1, bool)
                cut[marks] = True
            data = seen
        cut[edges] = True
        bounds = np.flatnonzero(cut)
        stretches = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = stretches.dictionary_encode()
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy()] if len(bounds) > 1 else np.zeros(0, np.int64)
        known = self.known
        starts, ids = np.array(known.starts, np.int64), np.array(known.ids, np.uint32)
        del known.starts[len(known) + 1:], known.ids[known.starts[-1]:]
        at, ends = _spans(starts, numbers)
        out = np.full(len(at) + n, self.end_id, np.uint32)
        per_text = ends[np.searchsorted(bounds, edges)] + np.arange(n + 1)
        inside = np.ones(len(out), bool)
        inside[per_text[1:] - 1] = False
        out[inside] = ids[at]
        return out, per_text


def _open_ended(part: str) -> bool:
    """Whether white space at an end of the part could join with white space beside it. Texts rarely have such parts; they
    are learnt after the others."""
    return part[-1].isspace() or part[:2].isspace()


def _spans(starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the elements of lists `numbers`, one list after another, and their n + 1 offsets."""
    size = starts[numbers + 1] - starts[numbers]
    ends = np.concatenate(([0], np.cumsum(size)))
    return np.arange(ends[-1]) + np.repeat(starts[numbers] - ends[:-1], size), ends
