"""Near-duplicate documents: SuperMinHash signatures, banding, verification on whole sets, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspan.llm.common import for_texts, give_back, mix64, slices, table, texts_of
from trailspan.operators.graph import connected_components
from trailspan.shared import stored

#: 32 bands of 4 values: at a similarity of 0.8, two sets share no band with a chance of 5e-8.
VALUES, BANDS = 128, 32
#: Ids that are broadcast at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Equal values of two signatures below which a pair of a mixed bucket is not looked at: at a similarity of 0.8 fewer come
#: with a chance of 1e-9. Rows of a bucket that meet in one task, by their signatures and by their whole sets.
NEED, SIGNED_ROWS, WHOLE_ROWS = 74, 2048, 256
GOLD = 0x9E3779B97F4A7C15


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of every text, one text after the other in ascending order, and how many each has.

    A text of fewer than ``width`` words has one shingle, its whole sequence; a text without words has none.
    """
    known: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split()
        sizes[i] = len(words)
        ids += [known.setdefault(w, len(known)) for w in words]
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    h = word[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)[doc] if len(doc) else doc
    left = ends - np.arange(len(doc))  # words from here to the end of the text
    acc = mix64(h)
    run = np.minimum(sizes[doc], width) if len(doc) else doc
    for k in range(1, width):
        more = np.zeros(len(h), np.uint64)
        more[: len(h) - k] = h[k:]
        acc = np.where(run > k, mix64(acc * np.uint64(GOLD) + more), acc)
    start = left >= run
    acc, doc = acc[start], doc[start]
    order = np.lexsort((acc, doc))
    acc, doc = acc[order], doc[order]
    first = np.ones(len(acc), bool)
    first[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[first], np.bincount(doc[first], minlength=len(texts)).astype(np.int64)


def super_minhash(sets: np.ndarray, counts: np.ndarray, m: int = VALUES) -> np.ndarray:
    """(texts, m) signatures. Every element has its own random permutation of the m places; in round j it offers
    j + a random fraction to the j-th place of its permutation, and a place keeps the least offer. As round j offers
    nothing below j, a text is done as soon as every place has an offer."""
    n = len(counts)
    sig = np.full(n * m, np.inf)
    doc = np.repeat(np.arange(n), counts)
    x = sets
    puts: list[np.ndarray] = []
    held: list[np.ndarray] = []
    perm: np.ndarray | None = None
    for j in range(m):
        if j:
            open_ = np.isinf(sig.reshape(n, m)).any(1)[doc]
            if not open_.any():
                break
            if not open_.all():
                x, doc = x[open_], doc[open_]
                puts, held = [p[open_] for p in puts], [v[open_] for v in held]
                perm = perm[open_] if perm is not None else None
        if not len(x):
            break
        r = mix64(x + np.uint64((GOLD * (j + 1)) & (2**64 - 1)))
        k = j + (mix64(r) % np.uint64(m - j)).astype(np.int64)
        if perm is None and j == 4:
            perm = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
            rows = np.arange(len(x))
            for i in range(4):
                perm[rows, i], perm[rows, puts[i]] = perm[rows, puts[i]], perm[rows, i].copy()
        if perm is not None:
            rows = np.arange(len(x))
            out = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        else:
            out, mine = k.copy(), np.full(len(x), j)
            for p, v in zip(puts, held):
                out = np.where(p == k, v, out)
                mine = np.where(p == j, v, mine)
            puts.append(k)
            held.append(mine)
        np.minimum.at(sig, doc * m + out, j + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53)
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for i in range(bits.shape[2]):
        key = mix64(key * np.uint64(GOLD) + bits[:, :, i])
    return key.view(np.int64)


def fingerprints(sets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets have equal ones."""
    out = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(GOLD * salt & (2**64 - 1))), dtype=np.uint64)])
        ends = np.cumsum(counts)
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out[0], out[1]


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set fingerprint f1, f2, the band keys and a byte of each signature value of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets, counts = shingles(texts_of(part), width)
                sig = super_minhash(sets, counts)
                keys = band_keys(sig)
                small = [row.tobytes() for row in (mix64(sig.view(np.uint64)) & np.uint64(255)).astype(np.uint8)]
                f1, f2 = fingerprints(sets, counts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(f1), pa.array(f2), lists, pa.array(small, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "bands", "sig"])

    return for_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """cid and the shingle hashes of every text, ascending, as 8-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets, counts = shingles(texts_of(part), width)
                f1, f2 = fingerprints(sets, counts)
                ends = np.cumsum(counts)
                raw = [sets[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array(f1), pa.array(f2), pa.array(raw, pa.binary())], ["n_shingles", "f1", "f2", "shingles"])

    return for_texts(docs).select("text").mapInArrow(run, "n_shingles long, f1 long, f2 long, shingles binary").select(_cid().alias("cid"), "shingles")


def _cid() -> Column:
    """One number for a set: a class of documents that have the same shingles."""
    return F.xxhash64("n_shingles", "f1", "f2")


def sets_of(cids: DataFrame, docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """cid and whole set of each class in ``cids``, made anew from its representative's text.

    Representatives are found by doc_id, broadcast while BROADCAST_IDS allows;
    those of classes without any doc_id by the set of their own text.
    """
    some = stored(cids.select("cid").distinct().join(reps.select("cid", "rep"), "cid"), "near-ids")
    ids = some.where("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    n = some.agg(F.count_distinct("rep").alias("ids"), F.count_if(F.col("rep").isNull()).alias("nameless")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(F.broadcast(ids) if n.ids <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    if n.nameless:
        sought = some.where("rep IS NULL").select("cid")
        more = whole_sets(rows.where("doc_id IS NULL"), width).join(sought, "cid", "left_semi")
        return stored(whole_sets(texts, width).unionByName(more).dropDuplicates(["cid"]), "near-sets")
    # a repeated doc_id may bring other texts along; nothing joins their classes
    return stored(whole_sets(texts, width).dropDuplicates(["cid"]), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    a, b = (sets.select(F.col("cid").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each left set is linked with each right one."""
    sizes = np.array([len(x) for x in right], np.int64)
    values, codes = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(values), np.int32)
    out = np.zeros((len(left), len(right)), bool)
    for i, x in enumerate(left):
        at = np.searchsorted(values, x)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == x)]
        mark[at] = 1
        both = np.add.reduceat(mark[codes], starts)
        mark[at] = 0
        out[i] = 100 * both >= percent * (len(x) + sizes - both)
    return out


def dealt(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """Rows (key, cid, label) of both sides with side, and the task cell (cell, sc, mc) in which those of one key meet.

    Keys of ``rows`` rows at most share cells of about that many rows; of a
    larger one, chunks of ``rows`` of each side meet every chunk of the other.
    """
    per = left.groupBy("key").agg(F.count("*").alias("nl")).join(right.groupBy("key").agg(F.count("*").alias("nr")), "key")
    per = stored(per.withColumn("few", F.col("nl") + F.col("nr") <= rows), "near-sizes")
    cells = max(1, -(-(per.where("few").agg(F.sum(F.col("nl") + F.col("nr"))).first()[0] or 0) // rows))
    chunks = lambda n: F.when(F.col("few"), 1).otherwise(F.ceil(F.col(n) / rows)).cast("int")
    cell = F.when(F.col("few"), F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(cells))).otherwise(F.col("key")).alias("cell")
    deal = lambda n: F.pmod(F.xxhash64(F.lit(1), "cid"), chunks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
    columns = ["key", "cid", "label"]
    one = left.join(per, "key").select(*columns, cell, deal("nl").alias("sc"), every("nr").alias("mc"), F.lit(0).alias("side"))
    return one.unionByName(right.join(per, "key").select(*columns, cell, every("nl").alias("sc"), deal("nr").alias("mc"), F.lit(1).alias("side")))


def buckets_in(part: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(left rows, right rows, i, j) for each key of a cell: positions i and j in them of the pairs to look at.

    Those have different labels, sizes that allow a link, and NEED equal values;
    if the key is a bucket's, it is the first that the two share, so that no
    pair is looked at in two of them.
    """
    key, side, label, n = (part.column(c).to_numpy() for c in ("key", "side", "label", "n"))
    bands = np.array(part.column("bands").to_pylist(), np.int64)
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(len(key), -1)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for rows in np.split(order, cuts):
        left, right = rows[side[rows] == 0], rows[side[rows] == 1]
        if not len(left) or not len(right):
            continue
        band = int(np.argmax(bands[rows[0]] == key[rows[0]]))
        step = max(1, (8 << 20) // (len(right) * sig.shape[1]))
        for at in range(0, len(left), step):
            some = left[at : at + step]
            same = (sig[some][:, None, :] == sig[right][None, :, :]).sum(2)
            fits = (same >= NEED) & (label[some][:, None] != label[right][None, :])
            fits &= (100 * n[some][:, None] >= percent * n[right][None, :]) & (100 * n[right][None, :] >= percent * n[some][:, None])
            i, j = np.nonzero(fits)
            if len(i) and band:
                first = ~(bands[some[i], :band] == bands[right[j], :band]).any(1)
                i, j = i[first], j[first]
            if len(i):
                yield some, right, i, j


def links_across(tagged: DataFrame, placed: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) between the labels of different components that meet in a bucket; None where no bucket holds two.

    The most frequent label of a bucket is its main one. The other members meet
    all of the main component, once whatever number of buckets they share with
    it, and each other in the bucket. They are first compared by their
    signatures; whole sets are fetched for those only that may be linked with
    one of another label, and are compared inside the tasks. These return at
    most one link for every two labels; pairs are never written out. ``placed``
    has the label of every class.
    """
    mixed = tagged.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    odd = stored(tagged.join(mixed.select("key", F.col("top.label").alias("main")), "key").where("label <> main").select("key", "cid", "label", "main"), "near-odd")
    if odd.isEmpty():
        return None
    beside = odd.select(F.col("main").alias("key"), "cid", "label").distinct()
    members = placed.join(beside.select(F.col("key").alias("label")).distinct(), "label", "left_semi").select(F.col("label").alias("key"), "cid", "label")
    several = odd.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    inside = odd.join(several, "key", "left_semi").select("key", "cid", "label")
    signs = reps.select("cid", "n", "bands", "sig")
    cell = ["cell", "sc", "mc"]

    def likely(part: pa.Table) -> pa.Table:
        met = [np.unique(np.concatenate([left[i], right[j]])) for left, right, i, j in buckets_in(part, percent)]
        return part.select(["key", "side", "cid", "label"]).take(pa.array(np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)))

    met = dealt(beside.unionByName(inside), members.unionByName(inside), SIGNED_ROWS).join(signs, "cid")
    met = stored(met.groupBy(*cell).applyInArrow(likely, "key long, side int, cid long, label long").distinct(), "near-likely")
    if met.isEmpty():
        return None
    full = dealt(met.where("side = 0"), met.where("side = 1"), WHOLE_ROWS).join(signs, "cid").join(sets_of(met, docs, reps, width), "cid")

    def linked(part: pa.Table) -> pa.Table:
        label, sets = part.column("label").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for c in part.column("shingles").chunks for x in c]
        upper: dict[int, int] = {}
        found = []

        def top(x: int) -> int:
            while upper.get(x, x) != x:
                x = upper[x]
            return x

        for left, right, i, j in buckets_in(part, percent):
            used, spot = np.unique(i, return_inverse=True)
            hit = overlaps([sets[x] for x in left[used]], [sets[x] for x in right], percent)[spot, j]
            for a, b in np.unique(np.stack([label[left[i[hit]]], label[right[j[hit]]]], 1), axis=0).tolist():
                x, y = top(a), top(b)
                if x != y:
                    upper[max(x, y)] = min(x, y)
                    found.append((a, b))
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return full.groupBy(*cell).applyInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Two documents are linked if their sets of ``width``-word shingles have a
    Jaccard similarity of ``percent`` or more; component_id is the smallest
    doc_id that links reach. Documents with equal sets form one class before
    anything else, so thousands of copies cost one row. In a band's bucket the
    classes are first compared to one of them only, which joins most of a group
    of near copies at a cost in proportion to its size. Where that leaves a
    bucket with several components, links_across compares those of its classes
    whose signatures allow a link that could still change a component.

    Null, empty and wordless texts have no shingle, are linked with nothing and
    stay. Rows with the same doc_id are judged by their own texts; a null doc_id
    is never smallest unless a component has nothing else. Extra columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    made = stored(signed(docs, width), "near-signed")
    full = made.where("n_shingles > 0").withColumn("cid", _cid())
    reps = stored(full.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "near-classes")
    buckets = reps.select("cid", "n", F.explode("bands").alias("key"))
    leads = buckets.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", F.col("lead.cid").alias("a"), F.col("lead.n").alias("na"))
    shared = stored(buckets.join(leads, "key"), "near-buckets")
    fits = lambda x, y: (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))
    pairs = stored(shared.where(F.col("cid") != F.col("a")).where(fits("n", "na")).select("a", F.col("cid").alias("b")).distinct(), "near-pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")), docs, reps, width)
    links = stored(confirmed(pairs, sets, percent), "near-links")
    label = stored(connected_components(links, "a", "b"), "near-labels")
    placed = stored(reps.select("cid").join(label.select(F.col("node").alias("cid"), "component"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("label")), "near-placed")
    tagged = stored(shared.select("key", "cid").join(placed, "cid", "left"), "near-tagged")
    more = links_across(tagged, placed, docs, reps, width, percent)
    if more is not None:
        above = connected_components(stored(more, "near-links"), "a", "b").select(F.col("node").alias("label"), F.col("component").alias("top"))
        placed = placed.join(above, "label", "left").select("cid", F.coalesce("top", "label").alias("label"))
    named = reps.select("cid", "rep").join(placed, "cid")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    where = stored(named.join(least, "label").select("cid", "component_id"), "near-components")
    return (
        made.withColumn("cid", F.when(F.col("n_shingles") > 0, _cid()))
        .join(where, "cid", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_super_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
