"""LM scoring: a class bigram model. Exchange clustering assigns words to classes; class transitions and word emissions give scores.

Exchange runs twice. First over units, the CORE most frequent words and the
others by their last letters, until no unit moves; then over every training
word, as one distributed pass: each word's neighbours are counted by class, and
the word goes to the class where the likelihood gains most while all others
stay. Words unseen in training have the class of their unit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspan.llm.common import for_texts, remainder, slices, table, texts_of
from trailspan.shared import stored

#: Bytes of text that share one local vocabulary.
BLOCK_BYTES = 8 << 20
#: Units of clustering: the end, the CORE most frequent words, and the rest by their last letters.
CORE, TAILS = 512, 1535
ITEMS = 1 + CORE + TAILS
#: Words, the most frequent ones, whose counts and classes tasks hold in memory; those of others are joined.
TOP = 1 << 16
BLOCK_SCHEMA = "block long, doc_ids binary, nulls binary, held binary, sizes binary, ids binary, hashes binary, tails binary, train binary"


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def tail_of(word: bytes) -> int:
    """The unit of a word that is not among the most frequent ones."""
    return 1 + CORE + zlib.crc32(word[-3:]) % TAILS


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of small integers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks of BLOCK_BYTES: the distinct words of each once, and the texts as positions in that list; 0 is the end."""

    def flush(known, docs_, held, ids, seq):
        sizes = np.array([len(x) for x in ids], np.int32)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        learn = np.repeat(~np.array(held, bool), sizes)
        train = np.bincount(flat[learn], minlength=len(known)).astype(np.int64)
        words = list(known)
        row = [
            (TaskContext.get().partitionId() << 24) + seq,
            np.array([d or 0 for d in docs_], np.int64).tobytes(), np.array([d is None for d in docs_], np.uint8).tobytes(), np.array(held, np.uint8).tobytes(),
            sizes.tobytes(), _pack(flat), np.fromiter(map(word_hash, words), np.uint64, len(words)).tobytes(),
            np.fromiter((tail_of(w) if w else 0 for w in words), np.uint16, len(words)).tobytes(), _pack(train),
        ]
        return pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.binary()) for x in row[1:])], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, docs_, held, size, seq = {b"": 0}, [], [], [], 0, 0
        for batch in (part for whole in batches for part in slices(whole, "text")):
            for doc, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), texts_of(batch)):
                raw = text.encode("utf-8", "surrogatepass")
                ids.append(np.array([known.setdefault(w, len(known)) for w in raw.lower().split()] + [0], np.int32))
                docs_.append(doc)
                held.append(out)
                size += len(raw) + 16
                if size >= BLOCK_BYTES:
                    yield flush(known, docs_, held, ids, seq)
                    known, ids, docs_, held, size, seq = {b"": 0}, [], [], [], 0, seq + 1
        if ids:
            yield flush(known, docs_, held, ids, seq)

    return for_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "held", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def train_words(made: DataFrame) -> DataFrame:
    """(hash, n, tail) of every training word of every block."""

    def run(batches):
        for batch in batches:
            for h, t, n in zip(*(batch.column(c).to_pylist() for c in ("hashes", "tails", "train"))):
                n = _unpack(n, np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)[at]), pa.array(n[at]), pa.array(np.frombuffer(t, np.uint16)[at].astype(np.int32))], ["hash", "n", "tail"])

    return made.select("hashes", "tails", "train").mapInArrow(run, "hash long, n long, tail int")


def frequent(vocabulary: DataFrame) -> np.ndarray:
    """Sorted hashes of the words above a count, the least power of 2 ** (1/8) that leaves TOP words at most."""
    by_size = vocabulary.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("v"), F.min("c").alias("least")).orderBy(F.desc("k")).collect()
    words, cut = 0, None
    for r in by_size:
        words += r.v
        if words > TOP:
            break
        cut = r.least
    some = vocabulary.where(F.col("c") >= cut).select("hash").toPandas()["hash"].to_numpy() if cut else np.zeros(0)
    return np.sort(some.astype(np.int64))


def places(top: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted ``top``; -1 if it does not."""
    if not len(top):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(top, hashes), len(top) - 1)
    return np.where(top[at] == hashes, at, -1)


def rare_words(made: DataFrame, top: np.ndarray) -> DataFrame:
    """(hash, block, at) of every word of every block that is not in ``top``."""

    def run(batches):
        for batch in batches:
            for k, h in zip(batch.column("block").to_pylist(), batch.column("hashes").to_pylist()):
                h = np.frombuffer(h, np.int64)
                at = np.flatnonzero(places(top, h) < 0)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(np.full(len(at), k)), pa.array(at.astype(np.int32))], ["hash", "block", "at"])

    return made.select("block", "hashes").mapInArrow(run, "hash long, block long, at int")


def items_of(hashes: np.ndarray, tails: np.ndarray, core: np.ndarray, core_item: np.ndarray) -> np.ndarray:
    """Units of a block's words: ``core`` are the sorted hashes of the frequent ones."""
    items = tails.astype(np.int32)
    if len(core):
        at = np.minimum(np.searchsorted(core, hashes), len(core) - 1)
        items = np.where((core[at] == hashes) & (tails > 0), core_item[at], items)
    return items


def pair_counts(made: DataFrame, core: np.ndarray, core_item: np.ndarray) -> np.ndarray:
    """How often each unit follows each other one in training texts; the end precedes every first word.

    Each task adds up its blocks in one ITEMS x ITEMS table and sends its rows;
    rows of a unit meet in one place. What reaches the driver has a fixed size.
    """

    def count(batches):
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for batch in batches:
            for h, t, held, sizes, ids in zip(*(batch.column(c).to_pylist() for c in ("hashes", "tails", "held", "sizes", "ids"))):
                items = items_of(np.frombuffer(h, np.int64), np.frombuffer(t, np.uint16), core, core_item)
                x = items[_unpack(ids, np.int32)].astype(np.int64)
                before = np.concatenate([[0], x[:-1]])
                learn = np.repeat(np.frombuffer(held, np.uint8) == 0, np.frombuffer(sizes, np.int32))
                total += np.bincount((before * ITEMS + x)[learn], minlength=ITEMS * ITEMS)
        rows = total.reshape(ITEMS, ITEMS)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([_pack(rows[i]) for i in used], pa.binary())], ["item", "row"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("item").to_pylist(), batch.column("row").to_pylist()):
                row = _unpack(raw, np.int64)
                sums[i] = sums[i] + row if i in sums else row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(x) for x in sums.values()], pa.binary())], ["item", "row"])

    parts = made.select("hashes", "tails", "held", "sizes", "ids").mapInArrow(count, "item int, row binary")
    out = np.zeros((ITEMS, ITEMS), np.int64)
    for r in parts.repartition("item").mapInArrow(add, "item int, row binary").collect():
        out[r.item] += _unpack(bytes(r.row), np.int64)
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, passes: int = 8) -> np.ndarray:
    """Class of each unit; unit 0, the end, is alone in class 0.

    The most frequent units start a class each, the others join where the
    likelihood of class bigrams gains most, and then every unit in turn moves to
    its best class until a pass moves none. A tie stays with the lower class.
    """
    n = len(pairs)
    total = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-total, kind="stable")
    order = order[(order != 0) & (total[order] > 0)]
    cls = np.full(n, -1)
    cls[0] = 0
    free = min(classes - 1, len(order))
    cls[order[:free]] = 1 + np.arange(free)
    counts = np.zeros((classes, classes))
    seated = np.flatnonzero(cls >= 0)
    np.add.at(counts, (cls[seated][:, None], cls[seated][None, :]), pairs[np.ix_(seated, seated)])
    todo = [list(order[free:])] + [list(order)] * passes
    for step, units in enumerate(todo):
        moved = 0
        for w in units:
            seat = np.flatnonzero(cls >= 0)
            seat = seat[seat != w]
            right = np.bincount(cls[seat], pairs[w, seat], classes)
            left = np.bincount(cls[seat], pairs[seat, w], classes)
            own = float(pairs[w, w])
            old = cls[w]
            if old >= 0:
                counts[old] -= right
                counts[:, old] -= left
                counts[old, old] -= own
            rows = counts + right[None, :]
            rows[np.arange(classes), np.arange(classes)] += left + own
            gain = (_f(rows) - _f(counts)).sum(1)
            cols = _f(counts + left[:, None]) - _f(counts)
            np.fill_diagonal(cols, 0)
            gain += cols.sum(0)
            out, into = counts.sum(1), counts.sum(0)
            gain -= _f(out + right.sum() + own) - _f(out) + _f(into + left.sum() + own) - _f(into)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if old > 0 and gain[new] <= gain[old] + 1e-9:
                new = int(old)
            moved += new != old
            cls[w] = new
            counts[new] += right
            counts[:, new] += left
            counts[new, new] += own
        if step and not moved:
            break
    cls[cls < 0] = classes - 1
    return cls


def _rows_of(hashes: np.ndarray, old: np.ndarray, row: np.ndarray, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row a word: its entries' slots, a byte each, and their counts, a byte or four each. ``row`` ascends."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(starts[1:], len(row))
    counts = n.astype(np.uint8 if n.max() < 256 else np.uint32)

    def lists(data: np.ndarray) -> pa.Array:
        offsets = (np.append(starts[:1], ends) * data.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

    at = row[starts]
    return pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(old[at].astype(np.int32)), lists(slot.astype(np.uint8)), lists(counts)], ["hash", "old", "slots", "counts"])


def contexts(made: DataFrame, top: np.ndarray, core: np.ndarray, core_item: np.ndarray, unit_cls: np.ndarray, classes: int) -> DataFrame:
    """(hash, old, slots, counts): how often the classes stand before (slots from 0) and after (slots from ``classes``) each
    training word, by units' classes; ``old`` is its own unit's. Words of ``top`` are added up over a task's blocks, in a
    table of fixed size, so a word gives a row a block at most and a frequent one a row a task."""
    wide = 2 * classes

    def run(batches):
        total, old_of = np.zeros((len(top), wide), np.int32), np.zeros(len(top), np.int32)
        for batch in batches:
            for h, t, held, sizes, ids in zip(*(batch.column(c).to_pylist() for c in ("hashes", "tails", "held", "sizes", "ids"))):
                hashes = np.frombuffer(h, np.int64)
                cls = unit_cls[items_of(hashes, np.frombuffer(t, np.uint16), core, core_item)].astype(np.int64)
                ids = _unpack(ids, np.int32)
                learn = np.repeat(np.frombuffer(held, np.uint8) == 0, np.frombuffer(sizes, np.int32))
                word, side = ids.astype(np.int64) * wide, cls[ids]
                before, after = np.concatenate([[0], side[:-1]]), np.concatenate([side[1:], [0]])
                keys, n = np.unique(np.concatenate([(word + before)[learn], (word + classes + after)[learn]]), return_counts=True)
                row, slot = keys // wide, keys % wide
                at = places(top, hashes)
                often = at[row] >= 0
                total[at[row[often]], slot[often]] += n[often].astype(np.int32)
                old_of[at[row[often]]] = cls[row[often]]
                if not often.all():
                    yield _rows_of(hashes, cls, row[~often], slot[~often], n[~often])
        for start in range(0, len(top), 1 << 12):
            part = total[start : start + (1 << 12)]
            row, slot = np.nonzero(part)
            if len(row):
                yield _rows_of(top[start:], old_of[start:], row, slot, part[row, slot])

    return made.select("hashes", "tails", "held", "sizes", "ids").mapInArrow(run, "hash long, old int, slots binary, counts binary")


def best_class(left: np.ndarray, right: np.ndarray, old: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Class of each word by one exchange: where the likelihood of class bigrams gains most while all other words stay.

    ``left`` and ``right`` count the classes before and after each word,
    ``pairs`` all class bigrams with the words in their ``old`` classes. A tie
    stays with the old class, then the lower one; class 0 has the end only. The
    gain is exact but for a word's pairs with itself, whose other half is taken
    to stay behind.
    """
    classes, f_pairs = len(pairs), _f(pairs)
    out, into = pairs.sum(1), pairs.sum(0)
    n_left, n_right = left.sum(1, keepdims=True), right.sum(1, keepdims=True)
    gain = _f(out) - _f(out + n_right) + _f(into) - _f(into + n_left)
    for seen, table_, f_table in ((left, pairs, f_pairs), (right, pairs.T, f_pairs.T)):
        word, k = np.nonzero(seen)
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[first]] += np.add.reduceat(_f(table_[k] + seen[word, k][:, None]) - f_table[k], first)
    own = np.diag(pairs)
    gain += _f(own + left + right) - _f(own + left) - _f(own + right) + _f(own)
    rows = np.arange(len(old))
    less = lambda x: np.maximum(x, 0.0)
    to_old, from_old = pairs.T[old], pairs[old]
    # bigrams between the new class and the old one, from which the word is gone
    for cells, gone, come in ((to_old, left, right[rows, old]), (from_old, right, left[rows, old])):
        come = come[:, None]
        gain += _f(less(cells - gone) + come) - _f(less(cells - gone)) - _f(cells + come) + _f(cells)
    # in its old class the word is counted already: what it adds there is what taking it out would lose
    stay = (_f(to_old) - _f(less(to_old - left)) + _f(from_old) - _f(less(from_old - right))).sum(1)
    mine, l_old, r_old = own[old], left[rows, old], right[rows, old]
    stay += _f(less(mine - l_old)) + _f(less(mine - r_old)) - _f(mine) - _f(less(mine - l_old - r_old))
    stay -= _f(out[old]) - _f(less(out[old] - n_right[:, 0])) + _f(into[old]) - _f(less(into[old] - n_left[:, 0]))
    gain[rows, old] = stay
    gain[:, 0] = -np.inf
    new = gain.argmax(1)
    return np.where((old == 0) | (gain[rows, new] <= stay + 1e-9), old, new)


def assigned(found: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(hash, c, cls) of every training word: its count and its class after the exchange. Rows of a word come one after the
    other and are added up as they come, so a task holds a batch and one word."""
    classes = len(pairs)

    def decided(hashes, old, counts):
        left, right = counts[:, :classes], counts[:, classes:]
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(left.sum(1).astype(np.int64)), pa.array(best_class(left, right, old, pairs).astype(np.int32))], ["hash", "c", "cls"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, old = batch.column("hash").to_numpy(), batch.column("old").to_numpy()
            slots, raw = batch.column("slots").to_pylist(), batch.column("counts").to_pylist()
            sizes = np.array([len(x) for x in slots])
            wide = np.array([len(x) for x in raw]) > sizes
            n = np.zeros(sizes.sum())
            n[np.repeat(wide, sizes)] = np.frombuffer(b"".join(x for x, w in zip(raw, wide) if w), np.uint32)
            n[np.repeat(~wide, sizes)] = np.frombuffer(b"".join(x for x, w in zip(raw, wide) if not w), np.uint8)
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
            at = np.repeat(group, sizes) * 2 * classes + np.frombuffer(b"".join(slots), np.uint8)
            counts = np.bincount(at, n, len(first) * 2 * classes).reshape(len(first), 2 * classes)
            words, olds = hashes[first], old[first].astype(np.int64)
            if kept and kept[0][0] == words[0]:
                counts[0] += kept[2][0]
            elif kept:
                yield decided(*kept)
            if len(words) > 1:
                yield decided(words[:-1], olds[:-1], counts[:-1])
            kept = words[-1:].copy(), olds[-1:].copy(), counts[-1:].copy()
        if kept:
            yield decided(*kept)

    return found.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "hash long, c long, cls int")


@dataclass
class ClassModel:
    """log10 transitions (class before, class)."""

    trans: np.ndarray


@dataclass
class Emissions:
    """What emissions need: discount, log10 of class sizes and of unseen words' share; all tokens, all words."""

    discount: float
    size: np.ndarray
    unseen: np.ndarray
    tokens: int
    kinds: int


def fit_transitions(counts: np.ndarray) -> ClassModel:
    """Transitions of class bigrams, drawn towards class frequencies by a Dirichlet prior; each row adds up to 1."""
    classes, strength = len(counts), 50.0
    share = (counts.sum(0) + 1.0 / classes) / (counts.sum() + 1.0)
    return ClassModel(np.log10((counts + strength * share) / (counts.sum(1, keepdims=True) + strength)))


def fit_emissions(size: np.ndarray, kinds: np.ndarray, n1: int, n2: int) -> Emissions:
    """From the tokens and the distinct words of each class: emissions lose an absolute discount n1 / (n1 + 2 n2), which becomes
    the chance of an unseen word in that class. Over the training words and one unseen word a class, the chances after any
    word add up to 1."""
    d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
    # a class without a training word can emit an unseen one only; the end's class has the end only, whenever that was seen
    unseen = np.where(size > 0, d * kinds / np.maximum(size, 1), 1.0)
    return Emissions(d, np.log10(np.maximum(size, 1)), np.log10(np.maximum(unseen, 1e-12)), int(size.sum()), int(kinds.sum()))


PATH_SCHEMA = "doc_ids binary, nulls binary, held binary, sizes binary, known binary, base binary, emitted binary, path binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def paths(texts: DataFrame, found: DataFrame, m: Emissions, top: np.ndarray, top_c: np.ndarray, top_cls: np.ndarray, unit_of) -> DataFrame:
    """Per block: each text's known tokens, base score and sum of emissions, and the classes of its tokens, a byte each."""
    names = [c.split()[0] for c in PATH_SCHEMA.split(", ")]
    handle = texts.sparkSession.sparkContext.broadcast((m, top, top_c, top_cls, unit_of))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (m, top, top_c, top_cls, (core, core_item, unit_cls)), outs = handle.value, []
        for row in left.to_pylist():
            hashes, tails = np.frombuffer(row["hashes"], np.int64), np.frombuffer(row["tails"], np.uint16)
            counts, cls = np.zeros(len(hashes), np.int64), unit_cls[items_of(hashes, tails, core, core_item)].astype(np.uint8)
            at = places(top, hashes)
            counts[at >= 0], cls[at >= 0] = top_c[at[at >= 0]], top_cls[at[at >= 0]]
            rare = right.column("at").to_numpy()
            counts[rare], cls[rare] = right.column("c").to_numpy(), right.column("cls").to_numpy()
            known = counts > 0
            base = np.log10((counts + 1) / (m.tokens + m.kinds + 1))
            emit = np.where(known, np.log10(np.maximum(counts - m.discount, 1e-12)) - m.size[cls], m.unseen[cls])
            ids, sizes = _unpack(row["ids"], np.int32), np.frombuffer(row["sizes"], np.int32)
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts).tobytes() for x in (known[ids].astype(np.int64), base[ids], emit[ids])]
            outs.append([row["doc_ids"], row["nulls"], row["held"], row["sizes"], *sums, _pack(cls[ids])])
        return pa.table([pa.array([x[i] for x in outs], pa.binary()) for i in range(len(names))], names=names)

    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, PATH_SCHEMA)


def class_pairs(walked: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each other one in training texts: one table a task, added up by Spark."""

    def run(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for held, sizes, path in zip(*(batch.column(c).to_pylist() for c in ("held", "sizes", "path"))):
                x = _unpack(path, np.uint8).astype(np.int64)
                learn = np.repeat(np.frombuffer(held, np.uint8) == 0, np.frombuffer(sizes, np.int32))
                total += np.bincount((np.concatenate([[0], x[:-1]]) * classes + x)[learn], minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(classes * classes)
    for r in walked.select("held", "sizes", "path").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(classes, classes)


def scored(walked: DataFrame, model: ClassModel, tokens: int) -> DataFrame:
    """The texts' rows, their transitions added to their emissions."""
    names = [c.split()[0] for c in SCORE_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                x = _unpack(row["path"], np.uint8)
                # every text ends with the end, of class 0: so the token before a first word is the end
                moves = np.add.reduceat(model.trans[np.concatenate([[0], x[:-1]]), x], np.cumsum(sizes) - sizes)
                docs_ = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
                known, base, emitted = (np.frombuffer(row[c], k) for c, k in (("known", np.int64), ("base", np.float64), ("emitted", np.float64)))
                yield pa.RecordBatch.from_arrays([docs_, pa.array(np.frombuffer(row["held"], np.uint8).astype(bool)), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(emitted + moves)], names)

    return walked.mapInArrow(run, SCORE_SCHEMA)


def score_corpus(docs: DataFrame, held, classes: int = 64) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``held`` is a boolean column; rows where it is true are scored but not
    learned from; ``classes`` is 128 at most. Words are told apart by 64-bit
    hashes. Counts, neighbours' classes and a word's class cross the network
    once a word and block, not once a token; the TOP most frequent words are
    added up in each task and their classes broadcast, so none is a hot key, and
    no task holds more than one block with its counts and a table of fixed size.
    A null text is the empty text, whose only token is the end; repeated rows
    are scored alike and each learned from; without training rows every word is
    unseen. An empty table gives no rows.
    """
    if not 2 <= classes <= 128:
        raise ValueError(f"2 to 128 classes, not {classes}")
    made = stored(blocks(docs.withColumn("held", held)), "lm-blocks")
    vocabulary = stored(train_words(made).groupBy("hash").agg(F.sum("n").alias("c"), F.min("tail").alias("tail")), "lm-vocabulary")
    most = vocabulary.where("tail > 0").orderBy(F.desc("c"), "hash").limit(CORE).collect()
    core = np.array(sorted(r.hash for r in most), np.int64)
    core_item = 1 + np.arange(len(core), dtype=np.int32)
    pairs = pair_counts(made, core, core_item)
    unit_cls = exchange(pairs, classes)
    before = np.zeros((classes, classes))
    np.add.at(before, (unit_cls[:, None], unit_cls[None, :]), pairs)
    top = frequent(vocabulary)
    words = stored(assigned(contexts(made, top, core, core_item, unit_cls, classes), before), "lm-words")
    size, kinds, n1, n2 = np.zeros(classes), np.zeros(classes), 0, 0
    for r in words.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect():
        size[r.cls], kinds[r.cls], n1, n2 = r.n, r.v, n1 + r.n1, n2 + r.n2
    emissions = fit_emissions(size, kinds, n1, n2)
    named = docs.sparkSession.createDataFrame(pa.table({"hash": top}))
    known = words.join(F.broadcast(named), "hash").orderBy("hash").toPandas()  # TOP rows at most
    rare = rare_words(made, top).join(words, "hash").select("block", "at", "c", "cls")
    texts = made.select("block", "doc_ids", "nulls", "held", "sizes", "ids", "hashes", "tails")
    walk = paths(texts, rare, emissions, known["hash"].to_numpy(np.int64), known["c"].to_numpy(np.int64), known["cls"].to_numpy(np.uint8), (core, core_item, unit_cls))
    walked = stored(walk, "lm-paths")
    return scored(walked, fit_transitions(class_pairs(walked, classes)), emissions.tokens)


def op2_brown_lm(spark, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)
