"""A quality classifier by Bradley-Terry pairwise ranking.

Documents get a score w.x + v.g from the whole text: x are shares and ratios of its characters,
words and lines, g its words and pairs of neighbouring words, hashed into WIDTH buckets. The chance
that a document is preferred to another is the logistic function of the difference of their scores,
so w and v are fitted by logistic loss on feature differences of (good, bad) pairs. The threshold is
the quantile of the sample's scores below which the share of bad documents lies; scores are put on a
0 to 1 scale on which that quantile is CUT.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import rounds

#: Labelled rows that are learned from at most, in the order of a hash of their ids.
TRAIN_ROWS = 20_000
#: Pairs: each row of the rarer label meets so many of the other.
PARTNERS = 20
CUT = 0.3
RIDGE = 1e-3
#: Buckets of hashed words and word pairs; what is learned from holds at most TRAIN_ROWS times so many of them.
WIDTH = 4096
STEPS, HISTORY = 100, 10

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "pipe": b"|",
    "mark": b"#*$%&",
    "angle": b"<>{}[]\\/=_~^",
    "bang": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
FEATURES = [*_CLASSES, "log_words", "word_length", "distinct", "adjacent", "distinct_lines", "distinct_sentences", "top_word", "line_words", "sentence_words"]


def features(text: str) -> list[float]:
    """Shares and ratios of a whole text, all finite; an empty text gives zeros."""
    data = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(data)
    shares = [(size - len(data.translate(None, c))) / size for c in _CLASSES.values()]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    sentences = text.split(". ")
    adjacent = sum(map(str.__eq__, words, words[1:]))
    top = Counter(words).most_common(1)[0][1]
    return [
        *shares,
        float(np.log1p(n)),
        min(size / n, 100) / 10,
        len(set(words)) / n,
        adjacent / n,
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        top / n,
        min(n / len(lines), 1000) / 100,
        min(n / len(sentences), 1000) / 100,
    ]


class _Hashes(dict):
    """CRC-32 of words; short ones are remembered, in a table of bounded size."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        if len(word) <= 32:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


def grams(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) of the words and word pairs of a whole text, and how often each occurs, 255 at most."""
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    both = np.concatenate([h, (h[:-1] << np.uint64(32)) | h[1:]]) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.bincount((both >> np.uint64(32)).astype(np.int64) % WIDTH, minlength=WIDTH)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), np.minimum(counts[at], 255).astype(np.uint8)


def weighed(counts: np.ndarray) -> np.ndarray:
    """Logarithms of counts as a vector of length one (or empty)."""
    g = np.log1p(counts.astype(np.float32))
    return g / max(1e-9, float(np.sqrt(g @ g)))


class Grams:
    """Rows of hashed counts as a sparse matrix, in blocks of rows so that products need little room."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], block: int = 1000):
        self.n, self.block, self.parts = len(rows), block, []
        for i in range(0, len(rows), block):
            own = rows[i : i + block]
            row = np.repeat(np.arange(len(own), dtype=np.uint16), [len(at) for at, _ in own])
            self.parts.append((row, np.concatenate([at for at, _ in own]), np.concatenate([weighed(c) for _, c in own])))

    def times(self, v: np.ndarray) -> np.ndarray:
        """The product with a vector of WIDTH."""
        sums = [np.bincount(row, v[at] * g, self.block) for row, at, g in self.parts]
        return np.concatenate(sums)[: self.n] if sums else np.zeros(0)

    def back(self, c: np.ndarray) -> np.ndarray:
        """The transposed product: a vector of WIDTH from one number a row."""
        out = np.zeros(WIDTH)
        for i, (row, at, g) in enumerate(self.parts):
            out += np.bincount(at, c[i * self.block :][row] * g, WIDTH)
        return out


def descend(loss, at: np.ndarray) -> np.ndarray:
    """The minimum of a smooth convex function by limited-memory quasi-Newton steps; ``loss`` gives value and gradient."""
    value, slope = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() < 1e-6:
            break
        way, taken = slope.copy(), []
        for s, y in reversed(moves):
            taken.append((s @ way) / (s @ y))
            way -= taken[-1] * y
        if moves:
            s, y = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(taken)):
            way += (a - (y @ way) / (s @ y)) * s
        size, fall = 1.0, slope @ way
        while size > 1e-8:
            then, turned = loss(at - size * way)
            if then <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = -size * way, turned - slope
        if s @ y > 1e-12:
            moves = [*moves[1 - HISTORY :], (s, y)]
        at, value, slope = at + s, then, turned
    return at


class Ranking:
    """Weights on standardised features and on hashed words, slope and threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray, partners: int = PARTNERS, seed: int = 1, grams: Grams | None = None):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
        spread = x.std(axis=0) if len(x) else np.ones(len(FEATURES))
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        self.w, self.v, self.slope, self.threshold = np.zeros(len(FEATURES)), np.zeros(WIDTH), 1.0, 0.0
        if good.all() or not good.any():
            return  # one label only: no preference to learn from
        grams = grams or Grams([])
        z, n = np.clip((x - self.mean) / self.spread, -8, 8), len(FEATURES)
        a, b = np.flatnonzero(good), np.flatnonzero(~good)
        few, many = (b, a) if len(b) <= len(a) else (a, b)
        mate = many[np.random.default_rng(seed).integers(len(many), size=len(few) * partners)]
        own = np.repeat(few, partners)
        better, worse = (mate, own) if few is b else (own, mate)

        def raw(u: np.ndarray) -> np.ndarray:
            return z @ u[:n] + (grams.times(u[n:]) if grams.n else 0)

        def loss(u: np.ndarray) -> tuple[float, np.ndarray]:
            s = raw(u)
            gap = s[better] - s[worse]
            p = np.exp(-np.logaddexp(0, gap)) / len(gap)
            c = np.bincount(worse, p, len(z)) - np.bincount(better, p, len(z))
            slope = np.concatenate([z.T @ c, grams.back(c)]) + RIDGE * u
            return float(np.logaddexp(0, -gap).mean() + RIDGE / 2 * (u @ u)), slope

        u = descend(loss, np.zeros(n + WIDTH))
        self.w, self.v = u[:n], u[n:]
        s = raw(u)
        self.threshold = float(np.quantile(s, 1 - good.mean()))
        self.slope = float(2 / max(1e-6, s.std()))

    def scores(self, x: np.ndarray, grams: Grams | None = None) -> np.ndarray:
        s = np.clip((x - self.mean) / self.spread, -8, 8) @ self.w
        if grams is not None and grams.n:
            s = s + grams.times(self.v)
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold) + np.log(CUT / (1 - CUT)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ranking:
    """Fit on at most ``rows`` rows of ``docs`` that have a label (doc_id, label 0/1); null labels are left out.

    Labels are taken in the order of a hash of their ids. An id that several rows share brings each of its texts, within ``rows``.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in rounds(batches):
            x, at, counts = [], [], []
            for t in b.column("text").to_pylist():
                x.append(features(t or ""))
                g = grams(t or "", hashes)
                at.append(g[0].astype("<u2").tobytes())
                counts.append(g[1].tobytes())
            arrays = [b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float64())), pa.array(at, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "x", "at", "counts"])

    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").orderBy(*order).limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most `rows` labels
    got = known.mapInArrow(each, "doc_id long, label int, x array<double>, at binary, counts binary").orderBy(*order, "x", "at", "counts").limit(rows).toArrow()
    x = np.array(got["x"].to_pylist()).reshape(-1, len(FEATURES))
    hashed = [(np.frombuffer(a, "<u2"), np.frombuffer(c, np.uint8)) for a, c in zip(got["at"].to_pylist(), got["counts"].to_pylist())]
    return Ranking(x, np.array(got["label"].to_pylist(), dtype=int) == 1, grams=Grams(hashed))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id and score of each row; equal texts get equal scores."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in rounds(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            s = model.scores(x, Grams([grams(t, hashes) for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double")


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted (1 from CUT on) of each row of ``docs`` (doc_id, text, ...).

    ``labels`` (doc_id, label) holds the rows to learn from. Null and empty texts are scored as
    an all-zero description. Without both labels every score is CUT. Extra columns are ignored,
    repeated rows and ties are scored alike, and an empty table gives none.
    """
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
