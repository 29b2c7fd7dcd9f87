"""Toxicity: a linear-chain conditional random field over the words of each line."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.llm.common import fitted, for_texts, give_back, own_names, ranges, remainder, slices, table, texts_of

BITS = 18
WORDS_AND_BREAKS = re.compile(rb"[^\x20\x09-\x0D]+|\n")
WORD_TEXT = re.compile(r"[^\x20\x09-\x0D]+")
#: Token marginals from which a word counts as an offending span.
SPAN_AT = 0.5
NOISE = 0.05


def word_features(word: bytes) -> list[int]:
    """Hashed features of a lower-cased word: itself, its letters only, beginnings and ends."""
    bare = word.strip(b".,;:!?\"'()")
    text = bare.decode("utf-8", "replace")
    found = [b"w" + word, b"b" + bare]
    found += [b"p%d" % n + text[:n].encode("utf-8", "surrogatepass") for n in (3, 4, 5, 6) if len(text) > n]
    found += [b"s%d" % n + text[-n:].encode("utf-8", "surrogatepass") for n in (3, 5) if len(text) > n]
    return [zlib.crc32(x) & ((1 << BITS) - 1) for x in found]


def tokenise(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, word index of each token, tokens of each line, lines of each text. Lines without a word are left out."""
    known: dict[bytes, int] = {}
    ids: list[int] = []
    lines: list[int] = []
    per_text: list[int] = []
    for text in texts:
        n = 0
        for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):
            words = line.split()
            if words:
                ids += [known.setdefault(w, len(known)) for w in words]
                lines.append(len(words))
                n += 1
        per_text.append(n)
    return list(known), np.array(ids, np.int32), np.array(lines, np.int64), np.array(per_text, np.int64)


@dataclass
class Crf:
    """Weights of label 1 against label 0: own features, those of the word before and after, and the transitions."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    trans: np.ndarray
    calib: np.ndarray
    empty: float

    def emissions(self, flat: np.ndarray, counts: np.ndarray, ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Of each token; ``flat`` and ``counts`` are the features of the distinct words that ``ids`` points to."""
        cut = np.cumsum(counts) - counts
        own, before, after = (np.add.reduceat(w[flat], cut) if len(cut) else np.zeros(0) for w in (self.own, self.before, self.after))
        e = own[ids] + self.bias
        first = np.zeros(len(ids), bool)
        first[np.cumsum(lines) - lines] = True
        e[1:] += np.where(first[1:], 0, before[ids[:-1]])
        e[:-1] += np.where(first[1:], 0, after[ids[1:]])
        return e


def feature_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words one after the other, and how many each has."""
    parts, counts = [], []
    for at in range(0, len(words), 4096):
        per = [word_features(w) for w in words[at : at + 4096]]
        counts += map(len, per)
        parts.append(np.fromiter((x for p in per for x in p), np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(counts, np.int64)


def forward_backward(e: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of label 1, expected transition counts, log of the normaliser; one chain a line, all lines side by side."""
    n = len(e)
    order = np.argsort(-lines, kind="stable")
    starts, sizes = (np.cumsum(lines) - lines)[order], lines[order]
    x = np.exp(np.clip(e, -30, 30))
    t = np.exp(trans)
    a0, a1, s = np.empty(n), np.empty(n), np.empty(n)
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    for k, m in enumerate(alive):
        at = starts[:m] + k
        if k:
            p0, p1 = a0[at - 1], a1[at - 1]
            f0, f1 = p0 * t[0, 0] + p1 * t[1, 0], (p0 * t[0, 1] + p1 * t[1, 1]) * x[at]
        else:
            f0, f1 = np.ones(m), x[at]
        total = f0 + f1
        a0[at], a1[at], s[at] = f0 / total, f1 / total, total
    b0, b1 = np.ones(n), np.ones(n)
    pair = np.zeros((2, 2))
    for k in range(len(alive) - 1, 0, -1):
        at = starts[: alive[k]] + k
        r0, r1 = b0[at] / s[at], b1[at] * x[at] / s[at]
        p = at - 1
        pair += np.array([[(a0[p] * r0).sum() * t[0, 0], (a0[p] * r1).sum() * t[0, 1]], [(a1[p] * r0).sum() * t[1, 0], (a1[p] * r1).sum() * t[1, 1]]])
        b0[p], b1[p] = t[0, 0] * r0 + t[0, 1] * r1, t[1, 0] * r0 + t[1, 1] * r1
    return a1 * b1 / (a0 * b0 + a1 * b1), pair, float(np.log(s).sum())


def token_labels(words: list[bytes], ids: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray, odds: float = 3.0, share: float = 0.01) -> np.ndarray:
    """Tokens of toxic texts whose word or beginning is far likelier in toxic texts than elsewhere: the CRF's labelled tokens."""
    keys: list[tuple[int, ...]] = []
    names: dict[bytes, int] = {}
    for w in words:
        bare = w.strip(b".,;:!?\"'()")
        text = bare.decode("utf-8", "replace")
        parts = [b"b" + bare] + [b"p" + text[:n].encode() for n in (4, 5, 6) if len(text) > n]
        keys.append(tuple(names.setdefault(x, len(names)) for x in parts))
    counts = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.fromiter((x for k in keys for x in k), np.int64, int(counts.sum()))
    pairs = np.unique(doc_of.astype(np.int64) * len(words) + ids)
    doc, word = pairs // len(words), pairs % len(words)
    feats = flat[ranges((np.cumsum(counts) - counts)[word], counts[word])]
    both = np.unique(np.repeat(doc, counts[word]) * len(names) + feats)
    doc, key = both // len(names), both % len(names)
    bad = np.bincount(key, toxic[doc], len(names))
    good = np.bincount(key, 1 - toxic[doc], len(names))
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)
    ratio = np.log((bad + 0.3) / (n1 + 0.6)) - np.log((good + 0.3) / (n0 + 0.6))
    marked = (ratio >= odds) & (bad >= max(share * n1, min(3, n1 // 4), 1))
    hit = np.array([any(marked[k] for k in ks) for ks in keys], bool) if keys else np.zeros(0, bool)
    return (hit[ids] & (toxic[doc_of] > 0)).astype(np.float64)


def doc_features(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """From the marginals of each text: largest, log of the expected number of toxic words, their share. Marginals count as far
    as they exceed NOISE, so that the many small ones of a long clean text do not add up."""
    ends = np.cumsum(tokens)
    total = np.concatenate([[0.0], np.cumsum(np.maximum(p - NOISE, 0))])
    expected = total[ends] - total[ends - tokens]
    most = np.zeros(len(tokens))
    full = np.flatnonzero(tokens)
    if len(full):
        most[full] = np.maximum.reduceat(p, (ends - tokens)[full])
    return np.stack([np.ones(len(tokens)), most, np.log1p(expected), expected / np.maximum(tokens, 1)], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def unlike(texts: list[str], size: int = 24, shared: int = 8) -> list[int]:
    """Positions of the texts that share fewer than ``shared`` of their ``size`` smallest hashes of three words with an earlier one.

    Words that only a group of near copies has say nothing about other texts.
    """
    seen: dict[int, list[int]] = {}
    kept = []
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        least = sorted({zlib.crc32(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))})[:size]
        met = Counter(j for h in least for j in seen.get(h, ()))
        if met and met.most_common(1)[0][1] >= min(shared, len(least)):
            continue
        kept.append(i)
        for h in least:
            seen.setdefault(h, []).append(i)
    return kept


def train(texts: list[str], toxic: np.ndarray, prior: float, epochs: int = 6, seed: int = 5) -> Crf:
    """Maximum likelihood by Adagrad on line batches; the document score is a logistic model of its marginals."""
    words, ids, lines, per_text = tokenise(texts)
    zero = np.zeros(1 << BITS, np.float32)
    model = Crf(zero, zero.copy(), zero.copy(), -4.0, np.zeros((2, 2)), np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0, 0, 0]), prior)
    if not len(ids) or not 0 < toxic.sum() < len(toxic):
        return model
    line_doc = np.repeat(np.arange(len(texts)), per_text)
    doc_of = np.repeat(line_doc, lines)
    y = token_labels(words, ids, doc_of, toxic)
    flat, counts = feature_table(words)
    begin = np.cumsum(counts) - counts
    starts = np.cumsum(lines) - lines
    rng = np.random.default_rng(seed)
    marked = np.maximum.reduceat(y, starts) > 0
    pool = np.flatnonzero(marked | (rng.random(len(lines)) < min(1.0, 3 * max(marked.sum(), 200) / len(lines))))
    sums = [np.full(1 << BITS, 1e-3) for _ in range(3)]
    tsum, bsum = np.full((2, 2), 1e-3), 1e-3
    for epoch in range(epochs):
        rng.shuffle(pool)
        for at in range(0, len(pool), 1500):
            some = pool[at : at + 1500]
            size = lines[some]
            tok = ranges(starts[some], size)
            w, ty = ids[tok], y[tok]
            e = model.emissions(flat[ranges(begin[w], counts[w])], counts[w], np.arange(len(w)), size)
            p, pair, _ = forward_backward(e, size, model.trans)
            g = ty - p
            first = np.zeros(len(tok), bool)
            first[np.cumsum(size) - size] = True
            seen = np.zeros((2, 2))
            inner = ~first[1:]
            np.add.at(seen, (ty[:-1][inner].astype(int), ty[1:][inner].astype(int)), 1)
            left, right = np.zeros(len(g)), np.zeros(len(g))
            right[:-1] = np.where(first[1:], 0, g[1:])
            left[1:] = np.where(first[1:], 0, g[:-1])
            for weights, total, grad, rate in ((model.own, sums[0], g, 0.5), (model.before, sums[1], right, 0.08), (model.after, sums[2], left, 0.08)):
                feats = flat[ranges(begin[w], counts[w])]
                full = np.bincount(feats, np.repeat(grad, counts[w]), 1 << BITS) - 0.002 * weights
                total += full * full
                weights += (rate * full / np.sqrt(total)).astype(np.float32)
            d = (seen - pair) - 0.01 * model.trans
            tsum += d * d
            model.trans = model.trans + 0.1 * d / np.sqrt(tsum)
            bsum += g.sum() ** 2
            model.bias += 0.2 * g.sum() / np.sqrt(bsum)
    del flat, counts, begin, y, sums, pool, ids, doc_of, words
    x = np.concatenate([marginals(model, texts[i : i + 200])[2] for i in range(0, len(texts), 200)])
    give_back()
    n1 = toxic.sum()
    weight = np.where(toxic > 0, prior * len(toxic) / n1, (1 - prior) * len(toxic) / (len(toxic) - n1))
    model.calib = logistic(x, toxic, weight, 0.05)
    return model


def marginals(model: Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all tokens, tokens of each text, and doc_features."""
    words, ids, lines, per_text = tokenise(texts)
    tokens = np.bincount(np.repeat(np.arange(len(texts)), per_text), lines, len(texts)).astype(np.int64)
    p = forward_backward(model.emissions(*feature_table(words), ids, lines), lines, model.trans)[0] if len(ids) else np.zeros(0)
    return p, tokens, doc_features(p, tokens)


def score_texts(model: Crf, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Score, number of offending words, and their start:end offsets (code points, end exclusive) for each text."""
    p, tokens, x = marginals(model, texts)
    score = 1 / (1 + np.exp(-np.clip(x @ model.calib, -30, 30)))
    hit = np.concatenate([[0], np.cumsum(p >= SPAN_AT)])
    ends = np.cumsum(tokens)
    count = hit[ends] - hit[ends - tokens] if len(texts) else np.zeros(0, np.int64)
    spans = [""] * len(texts)
    for i in np.flatnonzero(count):
        mine = p[ends[i] - tokens[i] : ends[i]] >= SPAN_AT
        found = [m.span() for m, bad in zip(WORD_TEXT.finditer(texts[i]), mine) if bad]
        spans[i] = ",".join(f"{a}:{b}" for a, b in found)
    return score, count, spans


def fit_toxicity(docs: DataFrame, labels: DataFrame, held: int | None = 2, folds: int = 4, sample: int = 1500, sample_bytes: int = 16 << 20) -> Crf:
    """Train on at most ``sample`` toxic and ``sample`` other labelled rows, those of the smallest hash, equal and like texts once,
    and on at most ``sample_bytes`` of their texts.

    Rows whose crc32(doc_id) mod ``folds`` is ``held`` are never looked at; the
    share of toxic rows comes from all others. Conflicting labels of one doc_id
    count as toxic; labelled rows without a document are ignored. The fit runs
    in a task of an executor. Without labelled rows of both kinds, or without a
    word in them, every text has the share of toxic rows as its score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held is not None:
        known = known.where(remainder(F.col("doc_id"), folds) != held)
    h = F.xxhash64(F.lit(29), "doc_id")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    picked = [known.where(F.col("toxic") == k).orderBy(h, "doc_id").limit(sample) for k in (0, 1)]
    some = picked[0].unionByName(picked[1])
    once = texts.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))

    def fit(rows: list[dict]) -> Crf:
        rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
        rows = [rows[i] for i in unlike([r["text"] for r in rows])]
        return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.float64), prior)

    return fitted(once.orderBy(F.xxhash64(F.lit(31), "text"), "text").limit(2 * sample), fit, most=sample_bytes)


def with_scores(docs: DataFrame, model: Crf, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (text among them) with tox_score, tox_words and tox_spans.

    A null text counts as empty, and an empty text has the score of a text
    without a marked word. Long texts are scored whole, line by line; repeated
    rows come as often as they are there, with equal scores; an empty table
    gives no rows. Columns of ``docs`` that are not asked for are ignored; one
    that is asked for and has the name of a result raises a ValueError.
    """
    own_names(columns, "tox_score", "tox_words", "tox_spans")
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                score, count, spans = score_texts(handle.value, texts_of(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(count.astype(np.int64)), pa.array(spans, pa.string())], [*part.schema.names, "tox_score", "tox_words", "tox_spans"])

    some = for_texts(docs).select(*columns)
    schema = T.StructType([*some.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_words", T.LongType()), T.StructField("tox_spans", T.StringType())])
    return some.mapInArrow(run, schema)


def op8_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    out = with_scores(docs, model, ["doc_id", "text"])
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= 0.3).cast("int").alias("predicted"), F.col("tox_words").alias("n_toxic_words"), F.col("tox_spans").alias("spans"),
    )
