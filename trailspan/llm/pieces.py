"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.llm.chunks import ChunkCoder
from trailspan.llm.common import for_texts, gathered, own_names, slices, table, texts_of

SPACE = "▁"
#: Chunks between which every segmentation has a border, as no piece has a space after another character.
RUNS = re.compile(r" +[^ ]*|[^ ]+")
#: Texts with more than one space at a place, or one at a rim, or nothing, are cut by RUNS.
ODD = r"  |^ | $|^$"
_MODELS: dict[str, PieceModel] = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Bytes of text that a task encodes at once: ids, chunks and places of a run take some 50 times that.
RUN_BYTES = 1 << 20
#: Characters of a text without spaces that are segmented in one pass, and somewhat more where no cut is free.
PART = 1 << 17


class PieceModel:
    """Pieces of a model file with the score of each.

    Files of the unigram kind carry log probabilities, which are used as they
    are. Files of the BPE kind carry merge ranks, whose sums mean nothing; a
    piece of rank r gets -log(r + 2.7), the shape of a Zipf law. Characters
    that are no piece by themselves fall back to byte pieces, each scored
    below every piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in usual}
        ranked = all(s == int(s) for s in raw.values())
        self.score = {i: -log(k + 2.7) if ranked else raw[i] for k, i in enumerate(usual)}
        self.byte_score = min(self.score.values(), default=0.0) - 10
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.pieces = {sp.id_to_piece(i): i for i in usual}
        self.text = [b""] * n
        for p, i in self.pieces.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.automaton.add_word(p, (i, len(p), self.score[i]))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.pieces), default=1)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces are ``SPACE``; of equal ones, that with the longest last pieces.

        A text without spaces may be very long, and a pass over it holds three
        lists of its length. So it is taken in parts: what is best up to a place
        that no piece reaches over does not depend on what follows, and such a
        place is looked for behind every PART characters.
        """
        if len(text) <= PART:
            return self._segment(text)[0]
        out: list[int] = []
        at, score = 0, 0.0
        while at < len(text):
            stop = self._free_cut(text, min(at + PART, len(text)))
            ids, score = self._segment(text[at:stop], score)
            out += ids
            at = stop
        return out

    def _free_cut(self, text: str, near: int) -> int:
        """The first place from ``near`` on that no piece reaches over; the end if there is none."""
        for cut in range(near, len(text)):
            low = max(0, cut - self.longest + 1)
            if all(end - length + 1 >= cut - low or end + 1 <= cut - low for end, (_, length, _) in self.automaton.iter(text[low : cut + self.longest - 1])):
                return cut
        return len(text)

    def _segment(self, text: str, score: float = 0.0) -> tuple[list[int], float]:
        """(ids, score) of one pass from left to right: the automaton names, at each position, every piece that ends there by its
        output links, which relaxes all edges. ``score`` is that of what came before, so that sums round alike in parts."""
        n = len(text)
        best = [-1e300] * (n + 1)
        best[0] = score
        back: list[tuple[int, ...]] = [()] * (n + 1)
        size = [0] * (n + 1)
        odd = [] if self.single.issuperset(text) else [i for i, c in enumerate(text) if c not in self.single or c == "\x00"]
        k = 0
        for end, (piece, length, gain) in self.automaton.iter(text):
            while k < len(odd) and odd[k] <= end:
                self._fall_back(text, odd[k], best, back, size)
                k += 1
            s = best[end + 1 - length] + gain
            if s > best[end + 1] or (s == best[end + 1] and length > size[end + 1]):
                best[end + 1], back[end + 1], size[end + 1] = s, (piece,), length
        while k < len(odd):
            self._fall_back(text, odd[k], best, back, size)
            k += 1
        out: list[int] = []
        at = n
        while at:
            out += reversed(back[at])
            at -= size[at]
        return out[::-1], best[n]

    def _fall_back(self, text: str, i: int, best: list, back: list, size: list) -> None:
        raw = text[i].encode("utf-8", "surrogatepass")
        s = best[i] + self.byte_score * len(raw)
        if s > best[i + 1]:
            best[i + 1], back[i + 1], size[i + 1] = s, tuple(self.bytes.get(b, self.unknown) for b in raw), 1

    def encode_chunk(self, chunk: str) -> list[int]:
        """A space stands for the space mark; a space mark in the text itself is spelled in bytes, so that decoding restores it."""
        if SPACE not in chunk:
            return self.segment(chunk.replace(" ", SPACE))
        out: list[int] = []
        for i, part in enumerate(chunk.split(SPACE)):
            if i:
                out += [self.bytes.get(b, self.unknown) for b in SPACE.encode()]
            out += self.segment(part.replace(" ", SPACE))
        return out

    def chunks(self, text: str) -> list[str]:
        """With the customary space in front."""
        if not text:
            return []
        text = " " + text
        return RUNS.findall(text) if self.chunked else [text]

    def encode_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.encode_chunk(c) for c in chunks]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.int64, int(sizes.sum())), sizes

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.text[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def model(path: str) -> tuple[PieceModel, ChunkCoder]:
    """The model of a file and its memory of chunks, kept by the worker for its later tasks."""
    if path not in _MODELS:
        m = PieceModel(path)
        _MODELS[path] = (m, ChunkCoder(m.encode_many, m.chunks, ODD if m.chunked else "", bare=False, limit=120_000))
    return _MODELS[path]


def with_pieces(docs: DataFrame, columns: list[str], path: str | None = None, arrays: bool = True) -> DataFrame:
    """``columns`` of ``docs`` (text among them) with n_pieces, n_bytes (byte pieces), pieces_crc32 (unsigned crc32 of the
    ids as little-endian unsigned 32-bit integers), round_trip (decoding gives the text again) and, with ``arrays``, pieces.

    A null or empty text has no piece and decodes to the empty text. Every row
    is encoded by itself, however long, and repeated rows alike; an empty table
    gives no rows; columns that are not asked for are ignored, and one that is
    asked for under the name of a result raises a ValueError.
    """
    names = ["n_pieces", "n_bytes", "pieces_crc32", "round_trip", *(["pieces"] if arrays else [])]
    own_names(columns, *names)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, coder = model(path)
        is_byte = np.zeros(len(m.text), bool)
        is_byte[list(m.bytes.values())] = True
        for batch in gathered(batches, "text", RUN_BYTES):
            for part in slices(batch, "text", RUN_BYTES):
                texts = texts_of(part)
                ids, counts = coder.encode(pa.array(texts, pa.string()))
                ends = np.cumsum(counts)
                each = [ids[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]
                fallen = np.concatenate([[0], np.cumsum(is_byte[ids])])
                found = [
                    pa.array(counts), pa.array(fallen[ends] - fallen[ends - counts]), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                    pa.array([m.decode(x) == t for x, t in zip(each, texts)], pa.bool_()),
                ]
                if arrays:
                    found.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *names])

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BooleanType(), *([T.ArrayType(T.IntegerType())] if arrays else [])]
    some = for_texts(docs).select(*columns)
    return some.mapInArrow(run, T.StructType([*some.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def decoded(encoded: DataFrame, columns: list[str], path: str | None = None) -> DataFrame:
    """``columns`` of ``encoded`` (pieces among them) with the decoded text as ``text``; null pieces decode to null, an
    empty table gives no rows, and a column that is asked for under the name ``text`` raises a ValueError."""
    own_names(columns, "text")
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _ = model(path)
        for batch in batches:
            texts = [None if p is None else m.decode(np.array(p, np.int64)) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    some = encoded.select(*columns)
    return some.mapInArrow(run, T.StructType([*some.schema.fields, T.StructField("text", T.StringType())]))


def op9_viterbi_pieces(spark, sf_dir: str) -> DataFrame:
    out = with_pieces(table(spark, sf_dir, "documents"), ["doc_id", "text"], arrays=False)
    return out.select("doc_id", "n_pieces", "n_bytes", "pieces_crc32", "round_trip", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
