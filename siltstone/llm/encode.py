"""Token ids of whole texts by a tokenizer file, each distinct piece of text encoded once.

A text is split at safe boundaries: before white space that follows something else, before a mark of `,.!?;:` that
follows an ASCII letter, and before an ideographic or fullwidth mark that follows a Han or kana letter. The pre-tokenizer of a byte-level
BPE never crosses these, so the ids of the pieces in order are the ids of the text. No boundary is taken after white space
outside ASCII (or the control characters 1C to 1F), nor inside an added token. Whether a tokenizer file is of this kind is
checked when it is loaded; with any other, each text is one piece. A run of letters without any boundary can't be split safely and
is one piece, whatever its length.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from siltstone.llm import words

#: White space by Unicode that isn't ASCII's, and what only some libraries call white space.
_ODD_POINTS = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
ODD = re.compile("[" + "".join(map(chr, _ODD_POINTS)) + "]")
_MAYBE_ODD = np.zeros(256, bool)
_MAYBE_ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: UTF-8 of the ideographic comma and stop and of the fullwidth comma, stop, marks, colon and semicolon, as numbers.
_WIDE_STOP = np.array(sorted(int.from_bytes(c.encode(), "big") for c in "、。，．！？：；"))
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ",.!?;:"]] = True
#: First and last letter (UTF-8 as numbers) of the runs after which such a mark always begins a token: Hiragana, Katakana, its length and iteration marks, Han.
_LETTERS = [tuple(int.from_bytes(chr(c).encode(), "big") for c in run) for run in ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x4E00, 0x9FA5))]
#: Bytes encoded together; distinct pieces kept by a worker before it starts anew.
BATCH_BYTES, MOST_PIECES = 1 << 20, 1 << 20


class Encoder:
    """Ids of texts; keeps the ids of the pieces that it has seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        self.mark, self.mark_id = next(((t.content, i) for i, t in added.items() if t.special), ("", -1))
        self.splits = self._safe(json.loads(self.tokenizer.to_str()), added.values())
        self._forget()

    @staticmethod
    def _safe(told: dict, added) -> bool:
        """Is it a byte-level BPE with the usual pattern, whose added tokens stand for themselves and hold none of our boundaries?"""
        kind = told["pre_tokenizer"] or {}
        plain = told["normalizer"] is None and told["model"]["type"] == "BPE" and not told["model"].get("continuing_subword_prefix") and not told["model"].get("end_of_word_suffix")
        own = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) and not re.search(r"[\s,.!?;:\x1c-\x1f、。，．！？：；]", t.content) for t in added)
        return plain and own and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")

    def _forget(self) -> None:
        self.index = words.HashIndex(MOST_PIECES)
        self.count = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece, many pieces a call: the special token between them is its own id and splits the rest."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        alone = [i for i, p in enumerate(pieces) if self.mark_id < 0 or not self.splits or any(m in p for m in self.marks)]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        apart = set(alone)
        rest = [i for i in range(len(pieces)) if i not in apart] if apart else range(len(pieces))
        runs = [rest[i : i + 512] for i in range(0, len(rest), 512)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([self.mark.join(pieces[i] for i in run) for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark_id)
            for i, b, e in zip(run, np.append(0, cut + 1).tolist(), np.append(cut, len(ids)).tolist()):
                out[i] = ids[b:e]
        return out

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        keys, at = np.unique(keys, return_index=True)
        raw = data.tobytes()
        got = self._encode([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        self.index.add(keys)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(sizes) - sizes)
        self.count = np.append(self.count, sizes)
        self.ids = np.concatenate([self.ids, *got])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(data), bool)
        if self.splits:
            space = words.SPACES[data]
            edge[1:] = space[1:] & ~space[:-1]
            edge[1:] |= _STOP[data[1:]] & words.ASCII_LETTER[data[:-1]]
            if _MAYBE_ODD[data].any():
                edge[self._after_odd(data, offsets)] = False
            lead = np.flatnonzero((data[3:-2] == 0xE3) | (data[3:-2] == 0xEF)) + 3 if len(data) > 5 else np.zeros(0, np.int64)
            point = data[lead].astype(np.int64) << 16 | data[lead + 1].astype(np.int64) << 8 | data[lead + 2]
            lead = lead[np.isin(point, _WIDE_STOP)]
            before = data[lead - 3].astype(np.int64) << 16 | data[lead - 2].astype(np.int64) << 8 | data[lead - 1]
            edge[lead[np.any([(before >= a) & (before <= b) for a, b in _LETTERS], axis=0)]] = True
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(edge)

    def _after_odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the byte after an odd white space stands, if it is in the data."""
        maybe = np.flatnonzero(_MAYBE_ODD[data])
        out = []
        for i in np.unique(np.searchsorted(offsets, maybe, side="right") - 1).tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            if ODD.search(text):
                ends = [m.end() for m in ODD.finditer(text)]
                size = np.cumsum(np.fromiter((len(text[a:b].encode()) for a, b in zip([0, *ends], ends)), np.int64, len(ends)))
                out.append(offsets[i] + size)
        at = np.concatenate([np.zeros(0, np.int64), *out])
        return at[at < len(data)]

    def encode(self, column: pa.Array, want_ids: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of ids of each row and, if wanted, the ids of each row as uint32."""
        data, offsets = words.utf8(column)
        counts, ids = np.zeros(len(offsets) - 1, np.int64), []
        for lo, hi in words.runs(offsets, BATCH_BYTES):
            own = self._run(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], want_ids)
            counts[lo:hi] = own[0]
            ids += own[1]
        return counts, ids

    def _run(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64), [np.zeros(0, np.uint32)] * n * want_ids
        starts = self._pieces(data, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.append(starts[1:], len(data))
        keys = words.span_hash(data, starts, words.BYTE_CODE)
        found = self.index.find(keys)
        if len(new := np.flatnonzero(found < 0)):
            if self.index.size + len(new) > self.index.most:
                self._forget()
                new = np.arange(len(keys))
            self._learn(data, keys[new], starts[new], ends[new])
            found = self.index.find(keys)
        sizes = self.count[found]
        counts = np.bincount(row, sizes, n).astype(np.int64)
        if not want_ids:
            return counts, []
        before = np.cumsum(sizes) - sizes
        flat = self.ids[np.repeat(self.first[found] - before, sizes) + np.arange(int(sizes.sum()))]
        split = np.split(flat, np.cumsum(np.bincount(row, sizes, n).astype(np.int64))[:-1])
        return counts, split


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
