"""Exact top-k inner products by an impact-ordered index, processed score at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspan.llm.common import table
from trailspan.shared import stored

#: Vectors of one index block, queries that a task processes at once, queries of one task at most. Impacts of a dimension are
#: quantised to LEVELS steps.
BLOCK, PACK, MOST_QUERIES, LEVELS = 8192, 512, 65_536, 12
#: Shares of a query's whole gain after which its possible members are counted, and how many of them end its processing.
STOPS, RESCORE = (0.6, 0.9), 400
#: Queries that try all of STOPS first; the rest count only after those shares at which one of these ended.
PILOT = 32
#: Vectors of the largest norms that every task holds: their scores are the first bound of each query.
SEEDS = 1024
#: Scores are sums of longs; blocks in which one could pass this are scored by unbounded integers and cut to a long's range.
SAFE = 2**62


def whole_vectors(frame: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component; rows whose id, vector or a component is null or not finite are left out.
    A component beyond the range of a long takes the nearest long."""
    x = F.col(vector)
    fine = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e.cast("double")))
    return frame.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column, the shorter ones filled up with 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def largest(x: np.ndarray) -> int:
    """Greatest magnitude, as an unbounded integer."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


@dataclass
class Index:
    """One block: for each dimension the rows in order of their component, cut into segments of equal quantised impact."""

    ids: np.ndarray
    v: np.ndarray
    order: np.ndarray
    dim: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, v: np.ndarray) -> Index:
        n, d = v.shape
        order = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)
        dims, lows, highs, starts, stops = [], [], [], [], []
        for k in range(d):
            x = v[order[k], k]
            step = max(1, -(-int(x[-1] - x[0] + 1) // LEVELS))
            level = (x - x[0]) // step
            cut = np.flatnonzero(np.diff(level)) + 1
            a, b = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
            dims.append(np.full(len(a), k))
            lows.append(x[a])
            highs.append(x[b - 1])
            starts.append(a)
            stops.append(b)
        return cls(ids, v, order, *(np.concatenate(z) if z else np.zeros(0, np.int64) for z in (dims, lows, highs, starts, stops)))

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of the k best rows of each query but those of its own id; ties go to smaller ids.

        A segment's impact for a query is the most that one of its rows can gain
        in its dimension over the dimension's least. Each query processes its
        segments by descending impact, in rounds; what a round adds to all
        scores is one product of the impacts it takes up and the segments'
        postings. A row's score is at most its sum plus, for every dimension in
        which it has not come up, the largest impact left there. A query ends
        as soon as this bound leaves few rows that reach its k-th exact score
        among the leaders, or ``floor_at``, a score that k rows of the table
        have anyway; the others go on. The rows that are left are rescored
        exactly, and no others can be among the k best. A query whose
        ``floor_at`` no row of the block can reach is not processed at all.
        """
        if len(q) <= 4 * PILOT:
            return self._rounds(q, own, k, floor_at, STOPS)[0]
        part = lambda a, b: (q[a:b], own[a:b], k, None if floor_at is None else floor_at[a:b])
        first, ended = self._rounds(*part(0, PILOT), STOPS)
        second, _ = self._rounds(*part(PILOT, len(q)), ended)
        return tuple(np.concatenate([x, y + PILOT if i == 0 else y]) for i, (x, y) in enumerate(zip(first, second)))

    def _rounds(self, q: np.ndarray, own: np.ndarray, k: int, floor_at: np.ndarray | None, stops: tuple[float, ...]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[float, ...]]:
        """The best rows, and the shares at which a query ended."""
        useful: list[float] = []
        n, d = self.v.shape
        q = np.pad(q, ((0, 0), (0, max(0, d - q.shape[1]))))[:, :d]
        least = np.full(len(q), np.iinfo(np.int64).min) if floor_at is None else floor_at
        if largest(self.v) * largest(q) * max(d, 1) >= SAFE:
            return self._plain(q, own, k), stops
        w = q[:, self.dim]
        most = np.maximum(w * self.low, w * self.high)
        starts = np.searchsorted(self.dim, np.arange(d))
        top = np.maximum.reduceat(most, starts, axis=1).sum(1) if d else np.zeros(len(q), np.int64)
        live = np.flatnonzero(top >= least)
        ats, rows = [], []
        if len(live):
            floor = np.minimum.reduceat(most[live], starts, axis=1) if d else most[live]
            impact = most[live] - floor[:, self.dim]
            # sums of whole numbers below 2**24 are exact as single floats, those below 2**53 as doubles
            kind = np.float32 if float(impact.max(initial=0)) * max(d, 1) < 2**24 else np.float64
            postings = np.zeros((len(self.dim), n), kind)
            for s, (f, a, b) in enumerate(zip(self.dim.tolist(), self.start.tolist(), self.stop.tolist())):
                postings[s, self.order[f, a:b]] = 1
            rank = np.argsort(-impact, axis=1, kind="stable")
            gain = np.cumsum(np.take_along_axis(impact * (self.stop - self.start), rank, 1), axis=1)
            place = np.empty_like(rank)
            np.put_along_axis(place, rank, np.broadcast_to(np.arange(len(self.dim)), rank.shape), 1)
            acc = np.zeros((len(live), n), kind)
            before = np.zeros((len(live), 1), np.int64)
            base = floor.sum(1, keepdims=True)
            for stop in (*stops, None):
                upto = np.full((len(live), 1), len(self.dim)) if stop is None or not len(self.dim) else (gain < stop * gain[:, -1:]).sum(1, keepdims=True)
                acc += np.where((place >= before) & (place < upto), impact, 0).astype(kind) @ postings
                done = place < upto
                rest = np.maximum.reduceat(np.where(done, 0, impact), starts, axis=1) if d else impact
                bound = acc + rest.sum(1, keepdims=True) - (np.where(done, rest[:, self.dim], 0).astype(kind) @ postings if rest.any() else 0)
                bound = bound + base
                mine = self.ids[None, :] == own[live][:, None]
                bound[mine] = -np.inf
                lead = np.argpartition(-bound, min(k, n) - 1, axis=1)[:, : min(k, n)]
                scores = np.einsum("qkd,qd->qk", self.v[lead], q[live])
                found = np.where(np.take_along_axis(mine, lead, 1), np.iinfo(np.int64).min, scores).min(1) if n >= k else np.full(len(live), np.iinfo(np.int64).min)
                # doubles above 2**53 may be off in their last places
                reach = np.maximum(found, least[live]).astype(np.float64)[:, None]
                possible = (bound >= reach - np.abs(reach) * 1e-12) & ~mine
                end = (possible.sum(1) <= RESCORE) if stop is not None else np.ones(len(live), bool)
                at, row = np.nonzero(possible & end[:, None])
                if stop is not None and end.any():
                    useful.append(stop)
                ats.append(live[at])
                rows.append(row)
                if end.all():
                    break
                go = ~end
                live, impact, gain, place, acc, base, before = live[go], impact[go], gain[go], place[go], acc[go], base[go], upto[go]
        at, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ats, rows))
        score = np.concatenate([(q[at[i : i + 100_000]] * self.v[row[i : i + 100_000]]).sum(1) for i in range(0, len(at), 100_000)] or [np.zeros(0, np.int64)])
        return self._best(at, row, score, k), tuple(useful)

    def _best(self, at: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[row], ~score, at))
        at, row, score = at[best], row[best], score[best]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[first], self.ids[row[first]], score[first]

    def _plain(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All scores by unbounded integers, cut to the range of a long before they are ranked."""
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        big, parts = self.v.astype(object), []
        for i in range(len(q)):
            score = np.array([min(max(int(x), low), high) for x in big @ q[i].astype(object)], np.int64) if self.v.shape[1] else np.zeros(len(self.ids), np.int64)
            row = np.flatnonzero(self.ids != own[i])
            row = row[np.lexsort((self.ids[row], ~score[row]))[:k]]
            parts.append((np.full(len(row), i), row, score[row]))
        at, row, score = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(3))
        return at, self.ids[row], score

    def pack(self) -> dict[str, bytes]:
        return {"ids": self.ids.astype("<i8").tobytes(), "v": self.v.astype("<i4" if largest(self.v) < 2**31 else "<i8").tobytes(), "ord": self.order.astype("<i4").tobytes(), "seg": np.stack([self.dim, self.low, self.high, self.start, self.stop]).astype("<i8").tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> Index:
        ids = np.frombuffer(row["ids"], "<i8")
        n = max(1, len(ids))
        order = np.frombuffer(row["ord"], "<i4").reshape(-1, n)
        return cls(ids, np.frombuffer(row["v"], "<i8" if len(row["v"]) > 4 * order.size else "<i4").reshape(n, -1).astype(np.int64), order, *np.frombuffer(row["seg"], "<i8").reshape(5, -1))


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """One row for each block of about BLOCK vectors, and the number of blocks; every vector is in one. Vectors of like norms share blocks, so that a
    block's largest impacts say whether a query need look at it; many equal norms are dealt to several blocks by their ids."""

    def run(group: pa.Table) -> pa.Table:
        lists = group.column("v").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        index = Index.build(group.column("vec_id").to_numpy(), matrix(lists))
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), **{k: pa.array([x], pa.binary()) for k, x in index.pack().items()}})

    sized = vectors.withColumn("norm", norm())
    cuts = sorted(set(sized.approxQuantile("norm", [i / 16 for i in range(1, 16)], 0.005)))
    band = F.lit(0)
    for i, c in enumerate(cuts):
        band = F.when(F.col("norm") > c, i + 1).otherwise(band)
    placed = sized.withColumn("band", band)
    counts = {r.band: r["count"] for r in placed.groupBy("band").count().collect()}  # 16 rows at most
    block, blocks = F.lit(0), 0
    for b, n in sorted(counts.items()):
        parts = -(-n // BLOCK)
        block = F.when(F.col("band") == b, blocks + F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts))).otherwise(block)
        blocks += parts
    dealt = placed.select("vec_id", "v", block.cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(run, "block int, ids binary, v binary, ord binary, seg binary"), blocks


def norm():
    return F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def first_bounds(q: np.ndarray, ids: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """A score that k rows of the table reach for sure: the k-th best among the seeds that are not the query's own."""
    low = np.full(len(q), np.iinfo(np.int64).min)
    seed_ids, v = seeds
    d = max(v.shape[1], q.shape[1])
    if len(seed_ids) < k or largest(v) * largest(q) * d >= SAFE:
        return low
    v, q = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (v, q))
    scores = q @ v.T
    scores[ids[:, None] == seed_ids[None, :]] = np.iinfo(np.int64).min
    return np.partition(scores, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]


def top_k(frame: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``queries`` the k largest inner products with rows of ``frame``.

    Both hold vec_id and v (see whole_vectors). Rows of the query's own vec_id
    are no candidates; queries that repeat a vec_id are asked once, with the
    smallest of their vectors. Ties go to the smaller vec_id; fewer than k
    candidates all come; an empty table gives no rows; repeated rows of
    ``frame`` count each. Scores beyond a long take the nearest long. Every
    block of vectors meets every pack of queries in one task, which returns k
    rows a query at most; packs grow with the queries up to MOST_QUERIES, so
    that the index is copied no more than needed.
    """
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    built, blocks = build_index(frame)
    index = stored(built, "topk-index")
    top = frame.withColumn("n", norm()).orderBy(F.desc("n"), "vec_id").limit(SEEDS).select("vec_id", "v").collect()  # SEEDS rows
    size = max((len(r.v) for r in top), default=0)
    seeds = np.array([r.vec_id for r in top], np.int64), np.array([list(r.v) + [0] * (size - len(r.v)) for r in top], np.int64).reshape(len(top), size)
    n = asked.count()
    packs = max(1, -(-n // min(MOST_QUERIES, max(PACK, n // 8))))
    packed = asked.withColumn("pack", F.pmod(F.xxhash64("vec_id"), F.lit(packs)).cast("int")).groupBy("pack").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("v").alias("w"))).alias("queries"))
    met = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Index.unpack({c: batch.column(c)[i].as_py() for c in ("ids", "v", "ord", "seg")})
                items = batch.column("queries")[i].values
                every, lists = items.field("id").to_numpy(zero_copy_only=False), items.field("w")
                for at in range(0, len(items), PACK):
                    ids, q = every[at : at + PACK], matrix(lists.slice(at, PACK))
                    where, found, scores = block.search(q, ids, k, first_bounds(q, ids, seeds, k))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[where]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    pairs = met.join(index, "block").repartition(max(1, blocks * packs), "block", "pack")
    best = pairs.select("queries", "ids", "v", "ord", "seg").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_impact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
