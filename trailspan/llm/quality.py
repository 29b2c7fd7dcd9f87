"""Quality rules: rule statistics of whole texts, judged by an isolation forest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspan.llm.common import slices, table, texts_of, words_of
from trailspan.shared import stored

#: Characters that count as symbols, and the white space of the contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_distinct", "n_lines", "n_digits", "n_upper", "n_other", "max_word")
#: Columns of features() that one forest looks at. A document strange in one respect would drown among ten.
GROUPS = {"symbols": (2, 9), "word_length": (1, 10), "repetition": (3, 4), "variety": (5, 0), "digits_case": (7, 8), "line_length": (6, 0)}


def text_stats(text: str) -> tuple[int, ...]:
    """BASE and EXTRA counts of one whole text."""
    words = words_of(text)
    n = len(words)
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    repeats = 0
    if len(seen) < len(grams):
        covered = bytearray(n)
        for i, g in enumerate(grams):
            if seen[g] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeats = sum(covered)
    lines: set[str] = set()
    dups = full = 0
    for line in text.split("\n"):
        if not line.strip(SPACES):
            continue
        full += 1
        if line in lines:
            dups += 1
        else:
            lines.add(line)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    digits, upper = int(kinds[48:58].sum()), int(kinds[65:91].sum())
    other = int(kinds[33:127].sum()) - digits - upper - int(kinds[97:123].sum())
    symbols = sum(int(kinds[ord(c)]) for c in SYMBOLS)
    spaces = sum(int(kinds[ord(c)]) for c in SPACES)
    return (n, len(text) - spaces, symbols, dups, repeats, len(set(words)), full, digits, upper, other, max(map(len, words), default=0))


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*BASE, *EXTRA]
    for batch in batches:
        for part in slices(batch, "text"):
            got = np.array([text_stats(x) for x in texts_of(part)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[:, i]) for i in range(len(names)))], ["doc_id", *names])


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text; a null text has all counts 0."""
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in [*BASE, *EXTRA])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stat_batches, schema)


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios from the counts, columns in the order BASE + EXTRA."""
    n, chars, symbols, dups, repeats, distinct, lines, digits, upper, other, longest = (stats[:, i].astype(np.float64) for i in range(11))
    w, c, l = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack(
        [np.log1p(n), chars / w, symbols / w, dups / l, repeats / w, distinct / w * np.log1p(n), np.log1p(n / l), digits / c, upper / c, other / c, np.log1p(longest)], 1
    )


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def fit_forest(points: np.ndarray, trees: int, size: int, seed: int) -> dict[str, np.ndarray]:
    """Random splits on ``size`` points a tree. Nodes lie in heap order; path holds a leaf's adjusted depth."""
    rng = np.random.default_rng(seed)
    size = min(size, len(points))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    column = np.full((trees, nodes), -1, np.int32)
    cut = np.zeros((trees, nodes))
    path = np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, points[rng.choice(len(points), size, replace=False)] if size else points)]
        while todo:
            k, d, x = todo.pop()
            low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(points.shape[1]),) * 2
            free = np.flatnonzero(high > low)
            if d == depth or len(x) < 2 or not len(free):
                path[t, k] = d + float(_expected(np.array(len(x))))
                continue
            f = int(rng.choice(free))
            column[t, k], cut[t, k] = f, rng.uniform(low[f], high[f])
            left = x[:, f] < cut[t, k]
            todo += [(2 * k + 1, d + 1, x[left]), (2 * k + 2, d + 1, x[~left])]
    return {"column": column, "cut": cut, "path": path, "depth": np.array(depth), "norm": np.array(max(float(_expected(np.array(size))), 1e-9))}


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for points that few splits set apart."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for column, cut, path in zip(forest["column"], forest["cut"], forest["path"]):
        at = np.zeros(len(x), np.int64)
        for _ in range(int(forest["depth"])):
            f = column[at]
            inner = f >= 0
            at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
        total += path[at]
    return np.exp2(-total / len(forest["column"]) / forest["norm"])


def anomaly_scores(stats: DataFrame, forests: dict[str, dict[str, np.ndarray]]) -> DataFrame:
    """The stats with one anomaly column for each forest."""
    names, found = [*BASE, *EXTRA], [f"anomaly_{k}" for k in forests]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1) if batch.num_rows else np.zeros((0, len(names)))
            x = features(x)
            scores = [pa.array(anomaly(f, x[:, list(GROUPS[k])])) for k, f in forests.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], [*batch.schema.names, *found])

    return stats.select("doc_id", *names).mapInArrow(run, "doc_id long, " + ", ".join([f"{n} long" for n in names] + [f"{n} double" for n in found]))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(
    docs: DataFrame, labels: DataFrame, trees: int = 100, size: int = 256, sample: int = 8192, good_loss: float = 0.002, seed: int = 17
) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``anomalies`` (forests that reject it) and ``kept``.

    One forest for each of GROUPS is fitted on the ``sample`` labelled good rows
    of the smallest hash that pass the base rules (on all rows that do, where
    fewer than 64 are labelled): a bounded, documented sample that takes the
    same share of every source. Each forest's threshold comes from all labelled
    rows that pass the base rules: of a fixed grid of cuts, the one with the
    best bad-caught minus good-lost rate among those that lose at most
    ``good_loss`` of the good rows (two rows in small tables); a forest that finds no such cut rejects
    nothing.

    A null or empty text has counts 0 and fails the base rules. Repeated rows
    each get their verdict; extra columns of ``docs`` are left out. An empty
    table gives no rows.
    """
    stats = stored(rule_stats(docs), "quality-stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).where("q IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("q").alias("q"))
    names = [*BASE, *EXTRA]
    fair = stats.where(~base_failed()).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", *BASE))
    rows = fair.join(known.where("q = 1"), "doc_id").orderBy("h", "doc_id").select(*names).limit(sample).collect()
    if len(rows) < 64:
        rows = fair.orderBy("h", "doc_id").select(*names).limit(sample).collect()
    points = features(np.array([tuple(r) for r in rows], np.int64).reshape(-1, len(names)))
    forests = {k: fit_forest(points[:, list(c)], trees, size, seed + i) for i, (k, c) in enumerate(GROUPS.items())}
    scored = stored(anomaly_scores(stats, forests), "quality-scores")
    steps = 2000
    step = lambda k: F.struct(F.lit(k).alias("k"), F.least(F.lit(steps - 1), F.floor(F.col(f"anomaly_{k}") * steps)).cast("int").alias("step"))
    counts = (
        scored.where(~base_failed())
        .join(known, "doc_id")
        .select("q", F.explode(F.array(*(step(k) for k in forests))).alias("at"))
        .groupBy("at.k", "at.step")
        .agg(F.count_if(F.expr("q = 1")).alias("good"), F.count_if(F.expr("q = 0")).alias("bad"))
        .collect()
    )
    cuts = {}
    for k in forests:
        good, bad = np.zeros(steps), np.zeros(steps)
        for r in counts:
            if r.k == k:
                good[r.step], bad[r.step] = r.good, r.bad
        over = np.cumsum(good[::-1])[::-1]
        lost = over / max(good.sum(), 1)
        caught = np.cumsum(bad[::-1])[::-1] / max(bad.sum(), 1)
        gain = np.where(over <= max(good_loss * good.sum(), 2), caught - lost, -1.0)
        best = int(gain.argmax())
        cuts[k] = best / steps if gain[best] > 0.01 else 2.0
    against = F.array_compact(F.array(*(F.when(F.col(f"anomaly_{k}") >= cuts[k], F.lit(k)) for k in forests)))
    return scored.withColumn("base_failed", base_failed()).withColumn("anomalies", against).withColumn("kept", ~F.col("base_failed") & (F.size("anomalies") == 0))


def op6_isolation_quality(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept", F.array_join("anomalies", ",").alias("anomalies"))
