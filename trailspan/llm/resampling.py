"""Importance resampling towards a target distribution: word tries count hashed n-grams, and walking them again with gains attached
scores each document."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspan.llm.common import for_texts, slices, table
from trailspan.shared import stored

BUCKETS, LONGEST = 10_000, 3
#: Bytes of text of which one trie is built.
TRIE_BYTES = 2 << 20
#: Digits, small letters and all bytes of other characters stay; capital letters become small; the rest separates.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Shift:
    """CRC states moved on by a number of zero bytes: the state of ``a + b`` is that of ``a`` moved by len(b), xor that of ``b``."""

    def __init__(self) -> None:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        #: Images of the 32 bits under a move by 1, 2, 4, ... bytes.
        self.doubling = [(bits >> 8) ^ one[bits & 255]]
        self.bits = bits
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def _spread(images: np.ndarray) -> np.ndarray:
        """Images of all values of each of the four bytes, from those of the 32 bits."""
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte, (np.arange(256) >> bit) & 1 == 1] ^= images[8 * byte + bit]
        return out

    @staticmethod
    def _moved(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
        return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]

    def by(self, n: int) -> np.ndarray:
        """Tables of a move by ``n`` bytes."""
        if n not in self.known:
            images = self.bits
            for k in range(n.bit_length()):
                if k == len(self.doubling):
                    self.doubling.append(self._moved(self._spread(self.doubling[-1]), self.doubling[-1]))
                if n >> k & 1:
                    images = self._moved(self._spread(self.doubling[k]), images)
            if len(self.known) > 4096:
                self.known.clear()
            self.known[n] = self._spread(images)
        return self.known[n]

    def joined(self, states: np.ndarray, lengths: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """CRCs of texts of CRC ``states`` followed by texts of CRC ``tails`` and the given lengths."""
        out = np.empty(len(states), np.uint32)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            out[rows] = self._moved(self.by(int(lengths[rows[0]])), states[rows])
        return out ^ tails


@dataclass
class Trie:
    """Words of a run of texts, and the nodes that are their n-grams: for each depth the node at every position where an n-gram of
    that depth ends (-1: none), its count and its CRC."""

    #: Words of each text, without those that only lead on from the text's part before.
    words: np.ndarray
    text: np.ndarray
    nodes: list[np.ndarray]
    counts: list[np.ndarray]
    crcs: list[np.ndarray]

    @classmethod
    def build(cls, parts: list[tuple[bytes, int]], shift: Shift, depth: int = LONGEST) -> Trie:
        """``parts`` are (folded bytes, words at its beginning that were counted before)."""
        data = np.frombuffer(b" ".join(p for p, _ in parts), np.uint8)
        inside = data != 32
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends_of = np.cumsum([len(p) + 1 for p, _ in parts])
        text = np.searchsorted(ends_of, begin, "right")
        size = end - begin
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
        word = words.indices.to_numpy().astype(np.int64)
        known = words.dictionary.to_pylist()
        crc = np.array([zlib.crc32(w) for w in known], np.uint32)
        spaced = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in known], np.uint32)
        length = np.array([len(w) + 1 for w in known], np.int64)
        first = np.searchsorted(text, np.arange(len(parts)))
        since = np.arange(len(text)) - first[text]
        skip = np.array([s for _, s in parts], np.int64)
        new = since >= skip[text]
        nodes, counts, crcs = [], [], []
        above, above_crc = word, crc  # node of the n-gram that ends at each position, CRC of each node
        for n in range(1, depth + 1):
            if n == 1:
                node = word
            else:
                node = np.full(len(word), -1, np.int64)
                here = np.flatnonzero(since >= n - 1)
                key = above[here - 1] * len(known) + word[here]
                kinds, which = np.unique(key, return_inverse=True)
                node[here] = which
                parent, last = kinds // max(1, len(known)), kinds % max(1, len(known))
                above_crc = shift.joined(above_crc[parent], length[last], spaced[last])
            above = node
            shown = np.where(new, node, -1)
            nodes.append(shown)
            counts.append(np.bincount(shown[shown >= 0], minlength=len(above_crc)))
            crcs.append(above_crc)
        return cls(np.bincount(text[new], minlength=len(parts)), text, nodes, counts, crcs)

    def buckets(self, n: int) -> np.ndarray:
        """Features in each bucket."""
        out = np.zeros(n, np.int64)
        for count, crc in zip(self.counts, self.crcs):
            np.add.at(out, crc % np.uint32(n), count)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, sum of their gains) of each text: each node's gain, once for every position where a walk ends in it."""
        features, total = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for node, crc in zip(self.nodes, self.crcs):
            at = node >= 0
            np.add.at(features, self.text[at], 1)
            np.add.at(total, self.text[at], gains[crc % np.uint32(len(gains))][node[at]])
        return features, total


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def pieces(text: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of about ``limit`` bytes between words; each begins with the last words of the one before, so that
    no n-gram is lost, and says how many these are."""
    at, lead = 0, b""
    while True:
        stop = text.find(b" ", at + limit) if len(text) > at + limit else -1
        part = lead + text[at : stop if stop >= 0 else len(text)]
        yield part, len(lead.split())
        if stop < 0:
            return
        at, lead = stop, b" ".join(_last_words(part, LONGEST - 1)) + b" "


def _last_words(text: bytes, n: int) -> list[bytes]:
    return [w for w in text.rsplit(None, n)[-n:]] if len(text.split(None, n)) > n else text.split()


def tries(batch: pa.RecordBatch, shift: Shift, limit: int = TRIE_BYTES) -> Iterator[tuple[Trie, list[int], pa.RecordBatch]]:
    """(trie, row of each of its texts, rows): tries of runs of whole texts, and of the parts of a text that is long."""
    for run in slices(batch, "text", limit):
        texts = [folded(t) for t in run.column("text").to_pylist()]
        if len(texts) > 1 or not texts or len(texts[0]) <= 2 * limit:
            yield Trie.build([(t, 0) for t in texts], shift), list(range(len(texts))), run
        else:
            for part in pieces(texts[0], limit):
                yield Trie.build([part], shift), [0], run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket. Tasks add up their own tries; one row a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = Shift(), np.zeros(buckets, np.int64)
        for batch in batches:
            for trie, _, _ in tries(batch, shift):
                total += trie.buckets(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = for_texts(texts.select(F.col(text).alias("text"))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row a bucket at most
        out[r.bucket] = r.n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))) for each of n buckets with s of S features here and t of T in the target."""
    n, all_have, all_want = len(have), int(have.sum()), int(want.sum())
    ratio = [(float(t) + 1) * (float(all_have) + n) / ((float(s) + 1) * (float(all_want) + n)) for s, t in zip(have.tolist(), want.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()
        for batch in batches:
            rows, words, features, weight = None, None, None, None
            for trie, at, now in tries(batch, shift):
                if now is not rows:
                    if rows is not None:
                        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])
                    rows, (words, features, weight) = now, (np.zeros(now.num_rows, np.int64) for _ in range(3))
                some, total = trie.sums(gain)
                np.add.at(words, at, trie.words)
                np.add.at(features, at, some)
                np.add.at(weight, at, total)
            if rows is not None:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return for_texts(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw, rounded down: the same for a doc_id in any engine that has sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ...) with ``rank``: 1, 2, ... of the floor(percent * N / 100) highest scores of the N rows
    with at least ``least_words`` words, ties to the smaller doc_id; null for the others. Ranges of the order are cut first,
    each task ranks its own, and only the counts of the ranges are summed up in one place."""
    may = F.col("n_words") >= least_words
    order = [F.asc("out"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_words"), F.asc("weight"), F.asc("n_features")]
    base = stored(scored.withColumn("out", F.when(may, 0).otherwise(1)), "resampling-scores")
    n = base.where("out = 0").count()
    parts = stored(base.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    counts = parts.groupBy("part").count()
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    at = F.col("before") + F.col("own")
    ranked = parts.withColumn("own", own).join(F.broadcast(before), "part")
    return ranked.withColumn("rank", F.when((F.col("out") == 0) & (at <= percent * n // 100), at)).drop("out", "part", "own", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for every row of ``docs`` (doc_id, text), by likeness to ``target`` (text).

    A-Z count as a-z; words are runs of letters, digits and characters beyond
    ASCII, features all runs of one to three words. Null, empty and wordless
    texts have no features and the weight 0; a text of any length is read
    whole, part by part; rows that repeat a doc_id are ranked each, by their
    number of words where scores are equal; a null doc_id draws as an empty one
    and stands last among equals; with an empty target every bucket's gain
    follows from ``docs`` alone; an empty ``docs`` gives no rows; other columns
    are ignored.
    """
    gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, "text", buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op12_trie_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
