"""Language identification by partial matching with frozen byte statistics.

For each language a context tree of up to ORDER bytes is counted over a bounded sample of its
documents. A byte is coded in its longest known context; an escape (method C: as likely as
the context has distinct successors) leads to the next shorter one, and past the empty context all bytes
are alike. The language whose tree gives the shortest code for the whole text wins.

A byte's code length depends on the byte and ORDER bytes before it only. So a batch of texts is
one list of such grams; each distinct gram is coded once and its lengths are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import rounds

ORDER = 4
#: The sample: at most so many documents of a language, the first characters of each, and characters of all languages together.
TRAIN_DOCUMENTS, TRAIN_CHARS, TRAIN_TOTAL = 400, 1 << 16, 1 << 26
#: Documents of the sample are cut shorter than this only where a language has one.
LEAST_CHARS = 1000
#: Distinct grams whose code lengths a worker remembers.
GRAMS_HELD = 1_000_000
#: Grams of one step; a long text takes several.
STEP = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")


def grams(data: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, newlines before the start."""
    a = np.frombuffer(b"\n" * order + data, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(order + 1):
        out |= a[order - k : len(a) - k] << np.uint64(8 * k)
    return out


class Tree:
    """Counts of one language: for each context length the grams with their counts and the
    contexts with total and number of distinct successors."""

    def __init__(self, texts: list[str], order: int = ORDER):
        all_ = np.concatenate([grams(t.lower().encode(), order) for t in texts] or [np.zeros(0, np.uint64)])
        self.levels = []
        for k in range(order + 1):
            gram, count = np.unique(all_ & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            context, begin = np.unique(gram >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, begin) if len(begin) else np.zeros(0, np.int64)
            distinct = np.diff(np.append(begin, len(gram)))
            self.levels.append((gram, count.astype(np.float32), context, total.astype(np.float32), distinct.astype(np.float32)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each gram."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(len(self.levels) - 1, -1, -1):
            gram, count, context, total, distinct = self.levels[k]
            if not len(gram) or not len(open_):
                continue
            low = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(context, low >> np.uint64(8)), len(context) - 1)
            g = np.minimum(np.searchsorted(gram, low), len(gram) - 1)
            known, seen = context[c] == low >> np.uint64(8), gram[g] == low
            mass = np.log2(total[c] + distinct[c])
            out[open_] += np.where(seen, mass - np.log2(count[g]), np.where(known, mass - np.log2(distinct[c]), 0.0))
            open_ = open_[~seen]
        out[open_] += 8.0
        return out


class Coder:
    """Code lengths of texts under every language, with a bounded memory of grams."""

    def __init__(self, trees: list[Tree], order: int):
        self.trees, self.order = trees, order
        self.keys, self.costs = np.zeros(0, np.uint64), np.zeros((0, len(trees)), np.float32)

    def _lengths(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == keys[held]
        new = keys[~held]
        if len(new):
            costs = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
            if len(self.keys) + len(new) > GRAMS_HELD:
                self.keys, self.costs = self.keys[:0], self.costs[:0]
                out = np.empty((len(keys), len(self.trees)), np.float32)
                out[~held] = costs
                if held.any():
                    out[held] = np.stack([t.bits(keys[held]) for t in self.trees], axis=1)
                self.keys, self.costs = (keys, out) if len(keys) <= GRAMS_HELD else (self.keys, self.costs)
                return out
            where = np.searchsorted(self.keys, new)
            self.keys, self.costs = np.insert(self.keys, where, new), np.insert(self.costs, where, costs, axis=0)
            at = np.searchsorted(self.keys, keys)
        return self.costs[at]

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language; texts are taken together in steps of bounded size."""
        parts = [grams(t.lower().encode(), self.order) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        out = np.zeros((len(texts), len(self.trees)))
        for at in range(0, len(every), STEP):
            keys, inverse = np.unique(every[at : at + STEP], return_inverse=True)
            costs = self._lengths(keys)
            for j in range(len(self.trees)):
                out[:, j] += np.bincount(owner[at : at + STEP], weights=costs[inverse, j], minlength=len(texts))
        return out


def shares(languages: int, documents: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS, total: int = TRAIN_TOTAL) -> tuple[int, int]:
    """Documents of a language and characters of a document in the sample, so that all languages together stay within ``total`` characters.

    Many languages first shorten their documents to LEAST_CHARS, then have fewer of them, one at least.
    """
    documents = max(1, min(documents, total // (LEAST_CHARS * max(1, languages))))
    return documents, max(1, min(chars, total // (documents * max(1, languages))))


def train(docs: DataFrame, order: int = ORDER, documents: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS, total: int = TRAIN_TOTAL) -> tuple[list[str], list[Tree]]:
    """Languages and their trees from rows of ``docs`` (doc_id, text, lang); rows with a null are left out.

    Every language is learned. Its sample is ``documents`` rows in the order of a hash of their ids, and of each row's text the
    first ``chars`` characters; where languages are many both shrink (``shares``), so that the texts at the driver have
    no more than ``total`` characters and the trees are bounded too. Rows that share doc_id and lang count as one, with the
    least of their texts. Extra columns are ignored; from an empty table nothing is learned.
    """
    spark = docs.sparkSession
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    # a row a language
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()
    if not sizes:
        return [], []
    documents, chars = shares(len(sizes), documents, chars, total)
    # the smallest hashes of each language: all rows below a cut at twice the expected one are candidates, wherever they lie
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    cuts = spark.createDataFrame([(r["lang"], float(1 << 40) * (2 * documents + 100) / r["n"]) for r in sizes], "lang string, cut double")
    near = usable.select("doc_id", "lang", place.alias("at")).join(F.broadcast(cuts), "lang").where(F.col("at") < F.col("cut"))  # a row a language
    # bounded: about 2 * `documents` + 100 ids a language, each once however often it is repeated
    best: dict[str, list] = {}
    for r in near.select("lang", "at", "doc_id").distinct().collect():
        best.setdefault(r["lang"], []).append((r["at"], r["doc_id"]))
    last = [(lang, sorted(x)[:documents][-1][0]) for lang, x in best.items()]
    wanted = spark.createDataFrame(last, "lang string, last long")
    short = F.substring("text", 1, chars)
    sample = usable.select("doc_id", "lang", place.alias("at"), short.alias("text")).join(F.broadcast(wanted), "lang").where("at <= last")
    rows = sample.groupBy("lang", "at", "doc_id").agg(F.min("text").alias("text")).collect()
    # sorted: the trees don't depend on the order in which the sample arrives
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["at"], r["doc_id"])):
        found.setdefault(r["lang"], []).append(r["text"])
    langs = sorted(found)
    return langs, [Tree(found[x][:documents], order) for x in langs]


def identify(docs: DataFrame, langs: list[str], trees: list[Tree], order: int = ORDER) -> DataFrame:
    """doc_id, lang_pred and score of each whole text of ``docs`` (doc_id, text, ...).

    ``und`` with score 0 if the text is null or has no letter, or no language was learned. The
    score is the winner's share of the probability that the code lengths stand for. Equal
    lengths go to the first language in order. Extra columns are ignored, repeated rows are judged
    alike, very long texts are coded whole in steps, and an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value, order)
        for b in rounds(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            bits = coder.lengths(texts) if langs else np.zeros((len(texts), 1))
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            named = [bool(langs) and _LETTER.search(t) is not None for t in texts]
            pred = pa.array([langs[i] if ok else "und" for i, ok in zip(best, named, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pred, pa.array(np.where(named, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, lang_pred string, score double")
