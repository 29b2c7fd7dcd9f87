"""Token files: ids of each document as one zstandard frame, all frames under one trained dictionary.

A shard is ``MAGIC``, the sha256 of the dictionary, the frames one after the
other, then the index (doc_id int64, flag uint8 for a null doc_id, frame offset
uint64, id count uint32, each as one array) and a footer with the number of
documents, the index's offset and the width of an id in bytes. One document is
read from the footer, the index and its own frame.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspan.llm.chunks import ChunkCoder, EncodeMany
from trailspan.llm.common import fitted, for_texts, gathered, ranges, sampled, slices, table
from trailspan.shared import shared_folder

MAGIC = b"TSTOKEN1"
FOOTER = "<QQB"
#: A space before a character that is no white space always begins a pre-token of the byte-level pattern.
BREAK = re.compile(r"(?= \S)")
#: Texts with a space before other white space are cut by BREAK.
ODD = r" [\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"
#: Chunks of one space and then no white space at either end.
PLAIN = r"(?s)^ [^\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ](.*[^\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ])?\z"
_CODERS: dict[str, ChunkCoder] = {}
_WHOLE: dict[str, tuple] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coder(path: str) -> ChunkCoder:
    """The tokenizer of a file, kept by the worker for its later tasks."""
    if path not in _CODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _CODERS[path] = ChunkCoder(joined(t), lambda text: BREAK.split(text) if text else [], ODD, bare=True, limit=1_200_000)
    return _CODERS[path]


def whole(path: str) -> tuple:
    """The tokenizer of a file as it is, and a pattern that finds its added tokens; None if there are none."""
    if path not in _WHOLE:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        words = [x.content for x in t.get_added_tokens_decoder().values() if x.content]
        _WHOLE[path] = t, re.compile("|".join(map(re.escape, words))) if words else None
    return _WHOLE[path]


def joined(t) -> EncodeMany:
    """Encodes chunks that begin with a space as one long text, as they are pre-tokens there as well; a token's bytes tell
    which chunk it is of, since the byte-level alphabet has one character for each byte."""
    size = np.zeros(max(t.get_vocab().values(), default=0) + 1, np.int64)
    for word, i in t.get_vocab().items():
        size[i] = len(word)

    def encode_many(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(chunks, pa.string())
        spaced = pc.match_substring_regex(column, PLAIN).to_numpy(zero_copy_only=False)
        text = "".join(chunks if spaced.all() else [c for c, s in zip(chunks, spaced) if s])
        ids = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(pc.binary_length(column).to_numpy()[spaced])
        upto = np.searchsorted(np.cumsum(size[ids]), ends, "right")
        counts = np.zeros(len(chunks), np.int64)
        counts[spaced] = np.diff(np.concatenate([[0], upto]))
        rest = [e.ids for e in t.encode_batch_fast([c for c, s in zip(chunks, spaced) if not s], add_special_tokens=False)]
        counts[~spaced] = [len(r) for r in rest]
        begin = np.zeros(len(chunks), np.int64)
        begin[spaced] = np.cumsum(counts[spaced]) - counts[spaced]
        begin[~spaced] = len(ids) + np.cumsum(counts[~spaced]) - counts[~spaced]
        return np.concatenate([ids, np.array([i for r in rest for i in r], np.int64)])[ranges(begin, counts)], counts

    return encode_many


def encode(path: str, texts: pa.Array, end_id: int, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, ``end_id`` after each, and how many each has. With ``added``, an added token written out in a text is
    that token, as the file's tokenizer has it; else it is plain letters. Texts with one are few and encoded whole."""
    texts = pc.fill_null(texts, "")
    ids, counts = coder(path).encode(texts)
    t, pattern = whole(path) if added else (None, None)
    if pattern:
        at = np.flatnonzero(pc.match_substring_regex(texts, pattern.pattern).to_numpy(zero_copy_only=False))
        if len(at):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in at.tolist():
                parts[i] = np.array(t.encode(texts[i].as_py(), add_special_tokens=False).ids, ids.dtype)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def train_dictionary(arrays: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; from few or tiny samples, which cannot be trained on, their plain bytes."""
    arrays = [a for a in arrays if len(a) >= 8]
    if not arrays:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-size:]


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder on the file system that Spark itself resolves it to, with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, dictionary_size: int = 64 << 10, sample: int = 1000, sample_bytes: int = 16 << 20, shard_docs: int = 20_000, level: int = 3) -> dict:
    """Write every text's ids to shards of ascending doc_id below ``folder``; return the manifest.

    The dictionary is trained, in one task of an executor, on the ids of the
    ``sample`` texts of the smallest hash, as far as they hold ``sample_bytes``
    together: a bounded, documented sample; only the dictionary reaches the
    driver. Texts are range-partitioned by doc_id,
    about ``shard_docs`` to a shard, and each task tokenises, compresses and
    writes its shard as a stream; the sampling of the ranges reads texts, but
    tokenises none. A shard appears under its name only when it is whole, so a
    lost task's rest is never read. A null text
    counts as empty (its only id is the end id); null doc_ids come first;
    repeated doc_ids keep all their rows; an empty table has no shard. ``folder``
    is resolved by Spark's default file system; the manifest has it in full.
    """
    path = path or tokenizer_path()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = np.uint16 if width == 2 else np.uint32

    def trained(rows: list[dict]) -> bytes:
        ids, counts = encode(path, pa.array([r["text"] for r in rows], pa.string()), end_id, added=True)
        return train_dictionary([x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if rows else [], dictionary_size)

    raw = fitted(sampled(texts, sample, "doc_id", "text").select("_h", "text").distinct().orderBy("_h", "text"), trained, most=sample_bytes)
    digest = hashlib.sha256(raw).digest()
    folder = qualified(docs.sparkSession, folder)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary-{digest.hex()}.zdict") as out:
        out.write(raw)
    spark = docs.sparkSession
    rows = docs.count()
    parts = max(1, -(-rows // shard_docs), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, top = pafs.FileSystem.from_uri(folder)
        name, at = f"{top}/shard-{part:06d}.tok", len(MAGIC) + 32
        index: list[tuple] = []
        out = None
        d = _dict(raw)
        z = zstandard.ZstdCompressor(level=level, write_content_size=True, **({"dict_data": d} if d else {}))
        for piece in (p for batch in gathered(batches, "text", 32 << 20) for p in slices(batch, "text", 16 << 20)):
            if out is None:
                out = store.open_output_stream(f"{name}.{attempt}")
                out.write(MAGIC + digest)
            found, sizes = encode(path, piece.column("text"), end_id, added=True)
            flat, cuts = found.astype(kind).tobytes(), np.cumsum(sizes) * width
            for doc, n, e in zip(piece.column("doc_id").to_pylist(), sizes.tolist(), cuts.tolist()):
                blob = z.compress(flat[e - n * width : e])
                out.write(blob)
                index.append((doc, at, n))
                at += len(blob)
        if out is not None:
            ids, offs, ns = zip(*index)
            out.write(np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes())
            out.write(np.array(offs, "<u8").tobytes() + np.array(ns, "<u4").tobytes() + struct.pack(FOOTER, len(index), at, width))
            out.close()
            store.move(f"{name}.{attempt}", name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(index)]), pa.array([int(sum(ns))]), pa.array([ids[0]], pa.int64()), pa.array([ids[-1]], pa.int64())], ["shard", "docs", "tokens", "first_id", "last_id"])

    ordered = for_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(ordered.mapInArrow(run, "shard int, docs long, tokens long, first_id long, last_id long").collect())
    start, shards = 0, []
    for r in rows:
        shards.append({**r.asDict(), "start": start})
        start += r.tokens
    return {"folder": folder, "dictionary": digest.hex(), "shards": shards, "tokens": start}


class Shard:
    """Reads one shard; ``dictionary`` must be the one whose hash the shard carries."""

    def __init__(self, folder: str, shard: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.file = self.fs.open_input_file(f"{self.root}/shard-{shard:06d}.tok")
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        with self.fs.open_input_stream(f"{self.root}/dictionary-{head[len(MAGIC) :].hex()}.zdict") as f:
            raw = f.read()
        if hashlib.sha256(raw).digest() != head[len(MAGIC) :]:
            raise ValueError("the dictionary is not the one that the shard was written with")
        d = _dict(raw)
        self.z = zstandard.ZstdDecompressor(**({"dict_data": d} if d else {}))
        size = self.file.size()
        n, self.end, width = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        self.kind = np.uint16 if width == 2 else np.uint32
        index = self.file.read_at(size - struct.calcsize(FOOTER) - self.end, self.end)
        self.ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.offsets = np.append(np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64), self.end)
        self.counts = np.frombuffer(index, "<u4", n, 17 * n).astype(np.int64)

    def document(self, doc_id: int) -> np.ndarray | None:
        """Ids of one document: one small read."""
        at = np.flatnonzero((self.ids == doc_id) & ~self.null)
        if not len(at):
            return None
        a, b = self.offsets[at[0]], self.offsets[at[0] + 1]
        return np.frombuffer(self.z.decompress(self.file.read_at(int(b - a), int(a))), self.kind).astype(np.uint32)

    def blocks(self, size: int = 4 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """First position and the id arrays of runs of documents."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + size, "right")) - 1)
            a = int(self.offsets[i])
            raw = memoryview(self.file.read_at(int(self.offsets[j]) - a, a))
            cuts = (self.offsets[i : j + 1] - a).tolist()
            yield i, [np.frombuffer(self.z.decompress(raw[x:y]), self.kind).astype("<u4") for x, y in zip(cuts, cuts[1:])]
            i = j


def read_tokens(spark: SparkSession, manifest: dict, arrays: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and frame_bytes, one shard a task; with ``arrays``, the ids too.

    Texts that were null or empty have their end id only; null doc_ids come back
    null, repeated ones as often as they were written; long texts come by runs
    of frames; a manifest without shards gives no rows.
    """
    folder, shards = manifest["folder"], manifest["shards"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes", *(["ids"] if arrays else [])]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long" + ", ids array<long>" * arrays
    if not shards:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                s = Shard(folder, shards[k]["shard"])
                starts = shards[k]["start"] + np.cumsum(s.counts) - s.counts
                for i, found in s.blocks():
                    j = i + len(found)
                    sizes = np.array([len(x) for x in found], np.int64)
                    if (sizes != s.counts[i:j]).any():
                        raise ValueError("a frame does not hold as many ids as the index says")
                    columns = [
                        pa.array(s.ids[i:j], pa.int64(), mask=s.null[i:j]), pa.array(starts[i:j]), pa.array(sizes),
                        pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()), pa.array(np.diff(s.offsets[i : j + 1])),
                    ]
                    if arrays:
                        columns.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema)


def op3_zstd_tokens(spark, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"))
    return read_tokens(spark, manifest)
