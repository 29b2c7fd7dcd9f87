"""Encoding by chunks: the pieces of a text whose encodings only need to be joined are encoded once and remembered."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trailspan.llm.common import ranges

#: Encodes many chunks: all ids one after the other, and how many each chunk has.
EncodeMany = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class ChunkCoder:
    """Remembers the ids of each chunk seen, up to ``limit`` chunks; then it starts afresh. Long chunks are not kept.

    ``chunks_of`` cuts any text. Where ``odd``, a regular expression, is not
    found in a text, its chunks are its words between single spaces, each with
    the space before it; the first has none if ``bare``.
    """

    def __init__(self, encode_many: EncodeMany, chunks_of: Callable[[str], list[str]], odd: str, bare: bool, limit: int = 700_000, longest: int = 48):
        self.encode_many, self.chunks_of, self.odd, self.bare, self.limit, self.longest = encode_many, chunks_of, odd, bare, limit, longest
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)

    def _add(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            ids, sizes = self.encode_many(some)
            need, have = self.used + len(ids), len(self.code)
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, self.used), np.int32)])
            while have + len(some) > len(self.start):
                self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
            self.flat[self.used : need] = ids
            self.start[have : have + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.count[have : have + len(some)] = sizes
            self.code.update(zip(some, range(have, have + len(some))))
            self.used = need

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column without nulls, one text after the other, and how many each has."""
        if len(self.code) > self.limit:
            self.clear()
        n = len(column)
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
        lists = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.dictionary_encode() if len(lists) else None
        spaced = [" " + w for w in words.dictionary.to_pylist()] if words is not None else []
        firsts = lists.values.take(pa.array(offsets[:-1])).to_pylist() if self.bare and len(lists) else []
        cut = [self.chunks_of(t) for t in column.filter(pa.array(odd)).to_pylist()]
        code = self.code
        new = {c for some in (spaced, firsts, *cut) for c in some if c not in code}
        if new:
            self._add(sorted(new, key=lambda c: len(c) > self.longest))
        at = np.zeros(0, np.int64)
        if words is not None:
            at = np.fromiter(map(code.__getitem__, spaced), np.int64, len(spaced))[words.indices.to_numpy()]
            if self.bare:
                at[offsets[:-1]] = np.fromiter(map(code.__getitem__, firsts), np.int64, len(firsts))
        more = np.fromiter((code[c] for some in cut for c in some), np.int64)
        chunks = np.zeros(n, np.int64)
        chunks[~odd], chunks[odd] = np.diff(offsets), [len(some) for some in cut]
        begin = np.zeros(n, np.int64)
        begin[~odd] = offsets[:-1]
        begin[odd] = len(at) + np.cumsum(chunks[odd]) - chunks[odd]
        which = np.concatenate([at, more])[ranges(begin, chunks)]
        sizes = self.count[which]
        ids = self.flat[ranges(self.start[which], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(np.concatenate([[0], total[np.cumsum(chunks)]])) if n else np.zeros(0, np.int64)
        long = [c for c in new if len(c) > self.longest]
        for c in long:  # they have the last codes
            del code[c]
        if long:
            self.used = int(self.start[len(code) - 1] + self.count[len(code) - 1]) if code else 0
        return ids, counts
