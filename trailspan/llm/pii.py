"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspan.llm.common import fitted, for_texts, own_names, sampled, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9.]+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An address spelled with (at) or [at], and maybe (dot); the patterns miss it, the model may add it.
AT, DOT = r"\s?(?:@|[(\[]\s?(?:at|@)\s?[)\]])\s?", r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)"
SPELLED = re.compile(rf"[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
TRIGGER = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]", re.I)
#: Windows of the model: a text is covered by windows of WIDTH characters, STRIDE apart.
WIDTH, STRIDE = 64, 32
#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@.,-+()_%:;=/\"'|# \n\t"
CLASSES = len(ALPHABET) + 2
_CODE = np.full(0x110000, 1, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 2

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Same matches as the whole pattern from left to right, found from each @ so that long words cost no more."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL_SET:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end(), True
            end = m.end()
        at = text.find("@", max(at + 1, end))


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers with a dot between; of a run of digits and dots, each match begins at the first number that has three more."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        numbers = [m.span() for m in DIGITS.finditer(text, run.start(), run.end())]
        i = 0
        while i + 3 < len(numbers):
            four = numbers[i : i + 4]
            if all(b[0] - a[1] == 1 for a, b in zip(four, four[1:])):
                parts = [text[a:b].lstrip("0") for a, b in four]
                yield four[0][0], four[3][1], all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
                i += 4
            else:
                i += 1


def _cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        yield m.start(), m.end(), 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(kind, start, end) of the matches that pass their check, and of those that fail it; by kind, then start.
    A run of digits too short for any card is no failed card."""
    good: list[Span] = []
    bad: list[Span] = []
    if not TRIGGER.search(text):
        return good, bad
    for k, find in enumerate((_emails, _ips, _cards, _phones)):
        for a, b, ok in find(text):
            if ok:
                good.append((k, a, b))
            elif k != 2 or b - a >= 13:
                bad.append((k, a, b))
    return good, bad


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# The model -----------------------------------------------------------------------------------------


def codes_of(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def windows_of(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit, an @ or an (at). No span that plausible() accepts is without one."""
    hits = {m.start() // STRIDE for m in TRIGGER.finditer(text)}
    return np.array(sorted({k * STRIDE for h in hits for k in (h - 1, h) if k >= 0}), np.int64)


def cut(text: str, starts: np.ndarray) -> np.ndarray:
    """Character classes of each window; 0 beyond the end."""
    codes = np.concatenate([codes_of(text), np.zeros(WIDTH, np.uint8)])
    return codes[starts[:, None] + np.arange(WIDTH)]


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


@dataclass
class BiLstmCrf:
    """Weights by name: f_/b_ for the two directions, out for emissions, trans for tag transitions."""

    hidden: int = 24
    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, hidden: int, seed: int) -> BiLstmCrf:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"{d}_x"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden)).astype(np.float32)
            w[f"{d}_h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            w[f"{d}_b"] = bias
        w["out"] = rng.normal(0, 0.2, (2 * hidden, TAGS)).astype(np.float32)
        w["out_b"] = np.zeros(TAGS, np.float32)
        w["out_b"][0] = 2
        w["trans"] = np.zeros((TAGS, TAGS), np.float32)
        return cls(hidden, w)

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        h = self.hidden
        n, t = x.shape
        order = range(t) if d == "f" else range(t - 1, -1, -1)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, tape = np.empty((n, t, h), np.float32), []
        wx, wh, b = self.w[f"{d}_x"], self.w[f"{d}_h"], self.w[f"{d}_b"]
        for k in order:
            z = wx[x[:, k]] + state @ wh + b
            i, f, o = _sig(z[:, :h]), _sig(z[:, h : 2 * h]), _sig(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before = cell
            cell = f * before + i * g
            th = np.tanh(cell)
            if keep:
                tape.append((k, i, f, o, g, before, th, state))
            state = o * th
            out[:, k] = state
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(windows, WIDTH, TAGS) scores."""
        if not len(x):
            return np.zeros((0, WIDTH, TAGS), np.float32)
        both = np.concatenate([self._run(d, x, False)[0] for d in "fb"], 2)
        return both @ self.w["out"] + self.w["out_b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradients."""
        n = len(x)
        runs = {d: self._run(d, x, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        e = both @ self.w["out"] + self.w["out_b"]
        loss, de, dt = crf_gradient(e, y, self.w["trans"], x > 0)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["trans"] = (dt / n).astype(np.float32)
        de = (de / n).astype(np.float32)
        g["out"] = np.einsum("ntd,ntk->dk", both, de, optimize=True)
        g["out_b"] = de.sum((0, 1))
        dboth = de @ self.w["out"].T
        h = self.hidden
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            wh = self.w[f"{d}_h"]
            for k, i, f, o, gg, before, th, state in reversed(runs[d][1]):
                dh = dh + part[:, k]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                np.add.at(g[f"{d}_x"], x[:, k], dz)
                g[f"{d}_h"] += state.T @ dz
                g[f"{d}_b"] += dz.sum(0)
                dh, dc = dz @ wh.T, dc * f
        return loss / n, g


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the negative log likelihood, by emissions and transitions; positions that are not ``real`` have tag 0 for sure."""
    e = e.astype(np.float64).copy()
    pad = np.full(e.shape[2], -1e4)
    pad[0] = 0
    e[~real] = pad
    n, t, k = e.shape
    a = np.empty((n, t, k))
    a[:, 0] = e[:, 0]
    for i in range(1, t):
        a[:, i] = _lse(a[:, i - 1, :, None] + trans, 1) + e[:, i]
    z = _lse(a[:, -1], 1)
    b = np.zeros((n, t, k))
    dt = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        right = e[:, i] + b[:, i]
        b[:, i - 1] = _lse(trans + right[:, None, :], 2)
        dt += np.exp(a[:, i - 1, :, None] + trans + right[:, None, :] - z[:, None, None]).sum(0)
    p = np.exp(a + b - z[:, None, None])
    rows = np.arange(n)[:, None]
    gold = e[rows, np.arange(t), y].sum() + trans[y[:, :-1], y[:, 1:]].sum()
    p[rows, np.arange(t), y] -= 1
    p[~real] = 0
    np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
    return float(z.sum() - gold), p, dt


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for k, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
    return tags


def variants(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with some spans rewritten in forms the patterns miss; the labels move along."""
    parts, found, at, shift = [], [], 0, 0
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        old = text[a:b]
        new = old
        roll = rng.random()
        if k == 3 and roll < 0.7:
            digits = re.sub(r"[^0-9]", "", old)[-10:]
            new = (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}")[int(rng.integers(3))] if len(digits) == 10 else old
        elif k == 0 and roll < 0.6:
            at_ = (" @ ", "(@)", " @", " (at) ", "(at)", "[at]", " [at] ")[int(rng.integers(7))]
            name, host = old.split("@", 1)
            new = name + at_ + (host.replace(".", (" (dot) ", "[dot]")[int(rng.integers(2))]) if "at" in at_ and rng.random() < 0.5 else host)
        elif k == 2 and roll < 0.4:
            new = (".".join, "  ".join, "_".join)[int(rng.integers(3))]([old[i : i + 4] for i in range(0, len(old), 4)]) if old.isdigit() else old
        parts += [text[at:a], new]
        found.append((k, a + shift, a + shift + len(new)))
        shift += len(new) - len(old)
        at = b
    return "".join(parts) + text[at:], found


def training_windows(texts: list[str], seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows with their tags: labels are the base spans; half of the copies are rewritten. Rejected matches are left out."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text in texts:
        good, bad = base_spans(text)
        for rewrite in (False, True):
            body, spans = variants(text, good, rng) if rewrite and good else (text, good)
            if rewrite and not good:
                continue
            starts = windows_of(body)
            if not rewrite and bad:
                shut = Taken([(a, b) for _, a, b in bad])
                starts = np.array([s for s in starts if not shut.meets(s, s + WIDTH)], np.int64)
            if len(starts):
                tags = np.concatenate([tags_of(len(body), spans), np.zeros(WIDTH, np.int64)])
                xs.append(cut(body, starts))
                ys.append(tags[starts[:, None] + np.arange(WIDTH)])
    if not xs:
        return np.zeros((0, WIDTH), np.uint8), np.zeros((0, WIDTH), np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    order = rng.permutation(len(x))[:most]
    return x[order], y[order]


def train(texts: list[str], hidden: int = 24, epochs: int = 10, batch: int = 64, most: int = 3000, seed: int = 3) -> BiLstmCrf | None:
    """Adam on the windows of the given texts; None where they hold no span."""
    x, y = training_windows(texts, seed, most)
    if not (y > 0).any():
        return None
    model = BiLstmCrf.new(hidden, seed)
    m1 = {k: np.zeros_like(v) for k, v in model.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.w.items()}
    rng, step = np.random.default_rng(seed), 0
    total = epochs * max(1, -(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at : at + batch]
            _, g = model.gradients(x[some], y[some])
            step += 1
            rate = 0.02 * (1 - step / (total + 1)) + 0.001
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            for k, v in g.items():
                v = v * scale
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                model.w[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


#: How much a window's score for a character counts: most in its middle, little at its rims.
TRUST = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)


def viterbi(e: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Best tags of each region; (regions, longest, TAGS) scores."""
    n, t, k = e.shape
    best, back = e[:, 0].copy(), np.zeros((n, t, k), np.int8)
    keep = np.empty((n, t, k), np.float32)
    keep[:, 0] = best
    for i in range(1, t):
        s = best[:, :, None] + trans
        back[:, i] = s.argmax(1)
        best = s.max(1) + e[:, i]
        keep[:, i] = best
    out = []
    for r in range(n):
        path = np.empty(sizes[r], np.int64)
        path[-1] = keep[r, sizes[r] - 1].argmax()
        for i in range(sizes[r] - 1, 0, -1):
            path[i - 1] = back[r, i, path[i]]
        out.append(path)
    return out


#: Characters, filled up, of the stretches that are decoded together.
PADDED = 1 << 17


def alike(sizes: np.ndarray, most: int = 256, room: int = PADDED) -> list[np.ndarray]:
    """Positions of ``sizes`` in groups of like size: ``most`` in one at most, and no more of them than take ``room`` together when all
    are filled up to the longest; what is longer than that is a group of its own."""
    order = np.argsort(sizes, kind="stable")
    cuts, start = [], 0
    for i, size in enumerate(sizes[order].tolist()):
        if i > start and (i - start == most or (i - start + 1) * size > room):
            cuts.append(i)
            start = i
    return np.split(order, cuts)


def decode(model: BiLstmCrf, texts: list[str]) -> list[list[Span]]:
    """Spans of the model. Scores of overlapping windows are averaged, the middle of a window counting most, and each
    connected stretch of windows is decoded as one sequence, so that a span over a window's rim is found whole."""
    starts = [windows_of(t) for t in texts]
    found: list[list[Span]] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    if not len(owner):
        return found
    at = np.concatenate(starts)
    x = np.concatenate([cut(t, s) for t, s in zip(texts, starts) if len(s)])
    trans = model.w["trans"]
    e = np.concatenate([model.emissions(x[i : i + 4096]) for i in range(0, len(x), 4096)])
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > STRIDE)
    region = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    sizes = at[last] + WIDTH - at[first]
    for some in alike(sizes):
        longest = int(sizes[some].max())
        place = np.full(len(sizes), -1)
        place[some] = np.arange(len(some))
        score = np.zeros((len(some), longest, TAGS), np.float32)
        weight = np.zeros((len(some), longest), np.float32)
        for i in np.flatnonzero(place[region] >= 0):
            r, a = place[region[i]], at[i] - at[first[region[i]]]
            score[r, a : a + WIDTH] += e[i] * TRUST[:, None]
            weight[r, a : a + WIDTH] += TRUST
        score /= np.maximum(weight, 1)[:, :, None]
        for r, path in zip(some, viterbi(score, sizes[some], trans)):
            doc, base = int(owner[first[r]]), int(at[first[r]])
            text, i = texts[doc], 0
            while i < len(path):
                if path[i]:
                    k, j = (path[i] - 1) // 2, i + 1
                    while j < len(path) and path[j] == 2 + 2 * k:
                        j += 1
                    if base + j <= len(text):
                        found[doc].append((int(k), base + i, base + j))
                    i = j
                else:
                    i += 1
    return found


def plausible(text: str, span: Span) -> Span | None:
    """The span without white space and punctuation at its rims, if it can be of its kind at all."""
    k, a, b = span
    piece = text[a:b]
    a += len(piece) - len(piece.lstrip(" \t\r\n.,;:"))
    b -= len(piece) - len(piece.rstrip(" \t\r\n.,;:"))
    piece = text[a:b]
    digits = sum("0" <= c <= "9" for c in piece)
    word = lambda c: c.isalnum()
    if not piece or (a and word(text[a - 1]) and word(piece[0])) or (b < len(text) and word(text[b]) and word(piece[-1])):
        return None
    fits = (
        SPELLED.fullmatch(piece) is not None,
        piece.count(".") == 3 and 4 <= digits <= 12 and len(piece) == digits + 3,
        13 <= digits <= 19 and not any(c.isalpha() for c in piece),
        8 <= digits <= 15 and not any(c.isalpha() for c in piece) and digits < len(piece),
    )[k]
    return (k, a, b) if fits else None


class Taken:
    """Stretches of a text, to ask whether another one meets them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b


def find_spans(model: BiLstmCrf | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text. An added span touches no base span, and no match of its own kind that failed the check."""
    based = [base_spans(t) for t in texts]
    extra = decode(model, texts) if model else [[] for _ in texts]
    out = []
    for text, (good, bad), more in zip(texts, based, extra):
        taken = Taken([(a, b) for _, a, b in good])
        failed = [Taken([(a, b) for j, a, b in bad if j == k]) for k in range(len(KINDS))]
        added: list[Span] = []
        for span in sorted({s for s in (plausible(text, m) for m in more) if s}, key=lambda s: (s[1], -s[2])):
            k, a, b = span
            if not taken.meets(a, b) and not failed[k].meets(a, b) and (not added or added[-1][2] <= a):
                added.append(span)
        out.append((good, sorted(good + added)))
    return out


def fit_pii(docs: DataFrame, sample: int = 2000, plain: int = 500, windows: int = 3000, sample_bytes: int = 16 << 20) -> BiLstmCrf | None:
    """Train on at most ``windows`` windows, drawn at random, of at most ``sample`` texts with a digit or @ that hold a base match
    and ``plain`` that hold none, those of the smallest hash, and at most ``sample_bytes`` of them.

    The fit runs in a task of an executor. Null and empty texts are never
    drawn, equal texts once; None where no text holds a base match.
    """
    likely = F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.|\+[0-9][ ().0-9-]{6}|[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9]{13}|([0-9]{4}[ -]){3}")
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    parts = [sampled(some.where(want), n, F.lit(31), "doc_id", "text").select(F.lit(k).alias("part"), "_h", "text") for k, (want, n) in enumerate(((likely, sample), (~likely, plain)))]
    rows = parts[0].unionByName(parts[1]).distinct().orderBy("_h", "part", "text")
    by = lambda r: (r["part"], r["_h"], r["text"])
    return fitted(rows, lambda got: train([r["text"] for r in sorted(got, key=by)], most=windows), most=sample_bytes)


def with_spans(docs: DataFrame, model: BiLstmCrf | None, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (text among them) with pii_base and pii_spans.

    A null text counts as empty and has no span. Long texts are read whole, by
    overlapping windows; repeated rows come as often as they are there; an empty
    table gives no rows. Columns that are not asked for are ignored; one that is
    asked for and has the name of a result raises a ValueError.
    """
    own_names(columns, "pii_base", "pii_spans")
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = find_spans(handle.value, texts_of(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([written(b) for b, _ in got], pa.string()), pa.array([written(s) for _, s in got], pa.string())], [*part.schema.names, "pii_base", "pii_spans"])

    some = for_texts(docs).select(*columns)
    return some.mapInArrow(run, T.StructType([*some.schema.fields, T.StructField("pii_base", T.StringType()), T.StructField("pii_spans", T.StringType())]))


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    parts, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """The same rows and columns, with personal data in ``text`` replaced and ``n_chars`` (if there) counted anew.

    Null and empty texts stay as they are, long ones are read whole, repeated
    rows stay repeated, and an empty table stays empty.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = part.column("text").to_pylist()
                got = find_spans(handle.value, [t or "" for t in raw])
                texts = [None if t is None else redact_text(t, s) for t, (_, s) in zip(raw, got)]
                columns = dict(zip(part.schema.names, part.columns))
                columns["text"] = pa.array(texts, pa.string())
                if counted:
                    old = part.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([n if t == u or u is None else len(u) for n, t, u in zip(old, raw, texts)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return for_texts(docs).mapInArrow(run, docs.schema)


def op10_bilstm_pii(spark, sf_dir: str) -> DataFrame:
    """n_email ... n_phone count the base spans; ``spans`` holds the model's as well."""
    docs = table(spark, sf_dir, "documents")
    out = with_spans(docs, fit_pii(docs), ["doc_id", "text"])
    count = lambda k: F.regexp_count("pii_base", F.lit(f"(^|,){k}:")).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2("pii_base", 256).alias("base_sha256"), F.col("pii_spans").alias("spans"))
