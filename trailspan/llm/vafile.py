"""Hard negatives by a vector-approximation file: each dimension of a block is quantised into cells, bounds of a score are summed from
tables of what a cell can give, and only rows that may enter an answer are scored exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspan.llm.common import table
from trailspan.llm.topk import largest, matrix
from trailspan.shared import stored

#: Components, and rows at most, of one block and of one pack of anchors.
BLOCK_VALUES, BLOCK_ROWS, PACK_VALUES, PACK_ROWS = 1 << 20, 1 << 14, 1 << 18, 1 << 12
CELLS = 16
#: Anchors whose bounds a task sums up at once, and rows in one step of that sum.
ANCHORS, ROWS = 64, 4096
#: Big labels are met by broadcast up to this number.
BROADCAST_LABELS = 1_000_000
#: Sums of products of longs are exact as doubles below 2**53, and as longs below 2**62.
EXACT, SAFE = 2**53, 2**62
LOW, HIGH = -(2**63), 2**63 - 1


def labelled_vectors(frame: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and v, floor(scale * x) of each component; rows with a null id, label or vector, or with a component that is
    null or not finite, are left out. A component beyond the range of a long takes the nearest long."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e.cast("double")))
    rows = frame.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"))


def cells_of(v: np.ndarray) -> np.ndarray:
    """Cell of every component: CELLS runs of about equally many rows in each dimension, equal components in one cell."""
    n, d = v.shape
    out = np.zeros((d, n), np.uint8)
    for k in range(d):
        cuts = np.unique(np.partition(v[:, k], np.arange(1, CELLS) * n // CELLS)[np.arange(1, CELLS) * n // CELLS]) if n else []
        out[k] = np.searchsorted(cuts, v[:, k], "right")
    return out


class Approximation:
    """One block: exact rows, and of each dimension the cells (one byte a row) with the least and the greatest component in them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, codes: np.ndarray):
        self.ids, self.labels, self.v, self.codes = ids, labels, v, codes
        d = v.shape[1]
        self.least, self.most = np.zeros((d, CELLS + 1)), np.zeros((d, CELLS + 1))
        for k in range(d):
            order = np.argsort(codes[k], kind="stable")
            starts = np.flatnonzero(np.diff(codes[k][order], prepend=255)) if len(order) else order
            used = codes[k][order][starts]
            if len(used):
                x = v[order, k]
                self.least[k, used], self.most[k, used] = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        self.largest = largest(v)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of all rows (down) with the anchors ``q`` (across)."""
        n, d = len(self.ids), self.v.shape[1]
        one, two = q.T[:, None, :] * self.least[:, :, None], q.T[:, None, :] * self.most[:, :, None]
        low, high = np.minimum(one, two), np.maximum(one, two)
        below, above = np.zeros((n, len(q))), np.zeros((n, len(q)))
        for a in range(0, n, ROWS):
            part = slice(a, min(n, a + ROWS))
            for k in range(d):
                below[part] += low[k][self.codes[k, part]]
                above[part] += high[k][self.codes[k, part]]
        size = float(self.largest) * np.abs(q).sum(1)
        slack = np.where(size < EXACT, 0.0, size * 1e-9)  # doubles are not exact beyond
        return np.clip(below - slack, LOW, HIGH), np.clip(above + slack, LOW, HIGH)

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of some rows with one anchor; beyond the range of a long the nearest long."""
        if self.largest * largest(q) * max(1, len(q)) < SAFE:
            return self.v[rows] @ q
        wide = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in self.v[rows]]
        return np.array([min(max(s, LOW), HIGH) for s in wide], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores in order, ties by the smaller id."""
    return np.lexsort((ids, ~scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def of_own_label(block: Approximation, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, scores): the k best other rows of each anchor's label. A row is scored exactly if its upper bound reaches the
    k-th largest lower bound."""
    for a in range(0, len(q), ANCHORS):
        below, above = block.bounds(q[a : a + ANCHORS].astype(float))
        for i in range(below.shape[1]):
            may = np.flatnonzero((block.labels == labels[a + i]) & (block.ids != ids[a + i]))
            may = may[above[may, i] >= kth(below[may, i], k)]
            scores = block.exact(may, q[a + i])
            first = best(block.ids[may], scores, k)
            yield a + i, may[first], scores[first]


def in_windows(block: Approximation, q: np.ndarray, labels: np.ndarray, windows: list[list[int]], k: int, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, rows, scores): the k best rows of other labels whose scores are in each of an anchor's windows, from
    ``percent`` of the window's top up to the top. Bounds tell which rows may be in a window and which surely are; a row is
    scored exactly if it may be and its upper bound reaches the k-th largest lower bound of the sure ones."""
    for a in range(0, len(q), ANCHORS):
        below, above = block.bounds(q[a : a + ANCHORS].astype(float))
        for i in range(below.shape[1]):
            other = block.labels != labels[a + i]
            low, high, known = below[:, i], above[:, i], {}
            tops = windows[a + i]
            for w, top in enumerate(tops):
                if top < 0:  # the window's bottom is above its top
                    continue
                bottom = -(-percent * top // 100)
                may = np.flatnonzero(other & (high >= bottom) & (low <= top))
                sure = low[may[(low[may] >= bottom) & (high[may] <= top)]]
                known[w] = may[high[may] >= kth(sure, k)]
            some = np.unique(np.concatenate(list(known.values()))) if known else np.zeros(0, np.int64)
            scores = block.exact(some, q[a + i])
            for w, rows in known.items():
                s = scores[np.searchsorted(some, rows)]
                top = tops[w]
                inside = (s <= top) & (s >= -(-percent * top // 100))
                rows, s = rows[inside], s[inside]
                first = best(block.ids[rows], s, k)
                yield a + i, w, rows[first], s[first]


def build_file(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(the file, dimensions): (block, label, vec_id, v, code) with one byte of ``code`` a dimension. A block holds rows of one big
    label, or of whole smaller ones; its size follows from the dimensions, however many rows a label has."""
    n = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    size = max(1, min(BLOCK_ROWS, BLOCK_VALUES // n))
    labels = stored(vectors.groupBy("label").agg(F.count("*").alias("n")), "va-labels")
    big = labels.where(F.col("n") > size).select("label", F.ceil(F.col("n") / size).cast("long").alias("deals"))
    few = max(1, -(-(labels.where(F.col("n") <= size).agg(F.sum("n")).first()[0] or 0) // size))
    met = vectors.join(F.broadcast(big) if big.count() <= BROADCAST_LABELS else big, "label", "left")  # at most rows / size of them
    part = F.when(F.col("deals").isNotNull(), F.pmod(F.xxhash64("vec_id", "v"), F.col("deals"))).otherwise(F.pmod(F.xxhash64("label"), F.lit(few)))
    block = F.concat_ws("/", F.when(F.col("deals").isNotNull(), F.col("label").cast("string")).otherwise("few"), part.cast("string"))

    def build(rows: pa.Table) -> pa.Table:
        v = matrix(rows.column("v").combine_chunks())
        codes = np.ascontiguousarray(cells_of(v).T)
        code = pa.array([r.tobytes() for r in codes], pa.binary())
        return rows.select(["block", "label", "vec_id", "v"]).append_column("code", code)

    made = met.select(block.alias("block"), "label", "vec_id", "v").groupBy("block").applyInArrow(build, "block string, label long, vec_id long, v array<bigint>, code binary")
    return stored(made, "va-file"), n


def opened(rows: pa.Table, dims: int) -> Approximation:
    v = matrix(rows.column("v").combine_chunks())
    codes = np.zeros((dims, rows.num_rows), np.uint8)
    for i, code in enumerate(rows.column("code").to_pylist()):
        codes[: len(code), i] = np.frombuffer(code, np.uint8)
    return Approximation(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), np.pad(v, ((0, 0), (0, dims - v.shape[1]))), codes)


def _anchors(rows: pa.Table, dims: int) -> np.ndarray:
    v = matrix(rows.column("v").combine_chunks())
    return np.pad(v, ((0, 0), (0, dims - v.shape[1])))


def mined(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Both hold vec_id, label and v (see labelled_vectors). A row's score is its
    inner product with the anchor; larger ones come first, ties by the smaller
    vec_id. An anchor's positives are its first ``positives`` other rows of the
    same label, and each one's negatives the first ``negatives`` rows of other
    labels that score at least ``percent`` of the positive's score and at most
    that. Rows of the anchor's own vec_id are no positives; anchors that repeat
    a vec_id are asked once, with the smallest of their labels and vectors;
    a row of ``vectors`` that comes twice with all its values counts once; shorter vectors are filled up with
    0; positives without negatives have no rows; an empty table gives none.
    Scores beyond a long take the nearest long. Every block of the file that
    has an anchor's label, or another one, meets the anchor's pack in one task.
    """
    file, dims = build_file(stored(vectors.select("vec_id", "label", "v").distinct(), "va-vectors"))
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", F.expr(f"slice(m.v, 1, {dims})").alias("v"))
    packs = max(1, -(-asked.count() // max(1, min(PACK_ROWS, PACK_VALUES // dims))))
    asked = stored(asked.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int")), "va-anchors")
    held = stored(file.groupBy("block", "label").agg(F.count("*").alias("n")), "va-blocks")
    small = lambda frame: F.broadcast(frame) if frame.count() <= BROADCAST_LABELS else frame
    by_pack = lambda pairs: file.join(stored(pairs.select("block", "pack").distinct(), "va-pairs"), "block").groupBy("block", "pack")

    def own(rows: pa.Table, some: pa.Table) -> pa.Table:
        found = _Found(("anchor_id", "label", "positive_id", "positive_score"))
        if rows.num_rows and some.num_rows:
            block, ids, labels = opened(rows, dims), some.column("vec_id").to_numpy(), some.column("label").to_numpy()
            for i, at, scores in of_own_label(block, _anchors(some, dims), ids, labels, positives):
                found.add(ids[i], labels[i], block.ids[at], scores)
        return found.table()

    near = asked.join(small(held.select("block", "label")), "label")
    got = by_pack(near).cogroup(near.groupBy("block", "pack")).applyInArrow(own, "anchor_id long, label long, positive_id long, positive_score long")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = stored(got.withColumn("place", first).where(F.col("place") <= positives), "va-positives")
    tops = chosen.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score"), asc=False).alias("tops"))
    windowed = stored(asked.join(tops, "vec_id"), "va-windows")

    def others(rows: pa.Table, some: pa.Table) -> pa.Table:
        found = _Found(("anchor_id", "positive_score", "negative_id", "negative_score"))
        if rows.num_rows and some.num_rows:
            block, ids, labels = opened(rows, dims), some.column("vec_id").to_numpy(), some.column("label").to_numpy()
            windows = some.column("tops").to_pylist()
            for i, w, at, scores in in_windows(block, _anchors(some, dims), labels, windows, negatives, percent):
                found.add(ids[i], windows[i][w], block.ids[at], scores)
        return found.table()

    # the stated anchors against all rows, in blocks: a block goes to every pack, but for anchors of its only label
    kinds = held.groupBy("block").agg(F.count("*").alias("kinds"), F.min("label").alias("only"))
    dealt = stored(kinds.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))), "va-dealt")
    far = windowed.join(small(dealt), "pack").where((F.col("kinds") > 1) | (F.col("only") != F.col("label"))).drop("kinds", "only")
    got = by_pack(far).cogroup(far.groupBy("block", "pack")).applyInArrow(others, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = F.row_number().over(Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    kept = got.withColumn("rank", order.cast("int")).where(F.col("rank") <= negatives)
    out = chosen.select("anchor_id", "positive_id", "positive_score").join(kept, ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


class _Found:
    """Rows of (key, key, id, score) as columns of longs."""

    def __init__(self, names: tuple[str, str, str, str]):
        self.names, self.parts = names, [[np.zeros(0, np.int64)] for _ in range(4)]

    def add(self, one: int, two: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for part, x in zip(self.parts, (np.full(len(ids), one), np.full(len(ids), two), ids, scores)):
            part.append(x)

    def table(self) -> pa.Table:
        return pa.table({name: pa.array(np.concatenate(p), pa.int64()) for name, p in zip(self.names, self.parts)})


def op13_va_negatives(spark, sf_dir: str) -> DataFrame:
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mined(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
    n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""
