"""Edit-aware token counts.

A document is kept as its pre-tokens (the pieces that the tokenizer's pattern cuts, each
encoded on its own) under a segment tree that sums their characters and tokens. An edit finds
its place by walking down the tree, cuts anew from a few pre-tokens before the edit until a cut
falls on an old one behind it, encodes these pieces only and updates the sums above them.

Special tokens of the vocabulary are pieces of their own: the text is parted at them before it is cut.
``kept`` writes the leaves of a tree as two arrays beside the text, and ``applied`` reads them, so
that a later edit encodes nothing but what it touches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import _BYTE_LEVEL, encoder, rounds

#: Pre-tokens before an edit that are cut anew: a cut depends on two characters behind it at most.
BACK = 3
#: Distinct pre-tokens whose counts a worker holds.
COUNTS_HELD = 300_000

_PATTERN = regex.compile(_BYTE_LEVEL)
#: Cuts before the last three visible characters of a window don't depend on what follows it.
_SETTLED = regex.compile(r"(?:\S\s*){3}$")

#: What redaction replaces, each with a character that a match must hold.
REDACTIONS = (
    ("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]"),
    (".", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "[ip]"),
    ("", r"\+?[0-9][0-9 ().-]{7,}[0-9]", "[number]"),
    ("", r"\b(?:AKIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{12,}", "[key]"),
)
_REDACT = [(sign, regex.compile(pattern), new) for sign, pattern, new in REDACTIONS]
#: A text without these needs no look at the patterns.
_ANY = regex.compile(r"[@0-9]|AKIA|ghp_|sk-|xox[bp]-")

Edit = tuple[int, int, str]


def redactions(text: str) -> list[Edit]:
    """Edits (place, characters to delete, text to insert) that redact a text, last place first, none overlapping."""
    if not _ANY.search(text):
        return []
    found = [(m.start(), m.end() - m.start(), new) for sign, pattern, new in _REDACT if sign in text for m in pattern.finditer(text)]
    out: list[Edit] = []
    for at, n, new in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or at >= out[-1][0] + out[-1][1]:
            out.append((at, n, new))
    return out[::-1]


class Counts(dict):
    """Tokens of a pre-token, encoded when first met, and how a text is cut into them."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = encoder(path).encode
        added = encoder(path).tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("added tokens must stand for themselves, without the white space beside them")
        self.specials = sorted((t.content for t in added), key=len, reverse=True)
        #: Characters of the longest special token.
        self.longest = max(map(len, self.specials), default=0)
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text, special tokens among them."""
        if not any(x in text for x in self.specials):
            return _PATTERN.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*_PATTERN.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + _PATTERN.findall(text[at:])

    def __missing__(self, piece: str) -> int:
        n = len(self.encode([piece])[0]) // 4
        if len(piece) <= 64:
            if len(self) >= COUNTS_HELD:
                self.clear()
            self[piece] = n
        return n


class TokenTree:
    """Pre-tokens of a text under a segment tree of (characters, tokens).

    A leaf holds the pieces that stand in place of one original pre-token: one at first, none or
    several after edits. Node i has the children 2i and 2i + 1.
    """

    def __init__(self, text: str, counts: Counts, kept: tuple[np.ndarray, np.ndarray] | None = None):
        """From a text, or from a text and the characters and tokens of its pre-tokens as ``leaf_sums`` gives them."""
        self.counts, self.encoded = counts, 0
        if kept is None:
            self.leaves = [[x] for x in counts.cut(text)]
            leaf_sums = [len(x) for (x,) in self.leaves], [counts[x] for (x,) in self.leaves]
        else:
            ends = np.cumsum(kept[0]).tolist()
            self.leaves, leaf_sums = [[text[a:b]] for a, b in zip([0, *ends], ends, strict=False)], kept
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        if self.leaves:
            self.sums[self.size : self.size + len(self.leaves)] = np.transpose(leaf_sums)
        else:
            self.leaves = [[]]
        half = self.size
        while half > 1:
            self.sums[half // 2 : half] = self.sums[half : 2 * half].reshape(-1, 2, 2).sum(axis=1)
            half //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    def text(self) -> str:
        return "".join(x for leaf in self.leaves for x in leaf)

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        """(characters, tokens) of each pre-token in order; those of leaves that no edit touched come from the tree."""
        chars, tokens = [], []
        for i, leaf in enumerate(self.leaves):
            chars += map(len, leaf)
            tokens += [int(self.sums[self.size + i, 1])] if len(leaf) == 1 else [self.counts[x] for x in leaf]
        return chars, tokens

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, place of its start) for a character's place."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            left = int(self.sums[i, 0])
            if at >= start + left:
                start, i = start + left, i + 1
        return min(i - self.size, len(self.leaves) - 1), start

    def _set(self, leaf: int, pieces: list[str], tokens: int) -> None:
        self.leaves[leaf] = pieces
        i = leaf + self.size
        self.sums[i] = sum(map(len, pieces)), tokens
        while i > 1:
            i //= 2
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``at`` on; both are cut to the text."""
        at = min(max(at, 0), self.characters)
        delete = min(max(delete, 0), self.characters - at)
        if not delete and not insert:
            return
        first, start = self._find(max(0, at - 1))
        back, hidden = 0, self.counts.longest
        # a special token that the edit completes begins so far before it at most
        while first and (back < BACK or start > at - hidden):
            first -= 1
            start -= int(self.sums[first + self.size, 0])
            back += len(self.leaves[first])
        last, begin, read = first, start, []
        while last < len(self.leaves) and (last == first or begin < at + delete):
            read += self.leaves[last]
            begin += int(self.sums[last + self.size, 0])
            last += 1
        old = "".join(read)
        fixed = old[: at - start] + insert + old[at - start + delete :]
        take, found = 8, None
        while found is None:
            tail, n, k = [], len(fixed), last
            joints = {n: k}  # places in the window where an old leaf begins
            while k < len(self.leaves) and k - last < take:
                tail += self.leaves[k]
                n += int(self.sums[k + self.size, 0])
                k += 1
                joints[n] = k
            window, whole = fixed + "".join(tail), k == len(self.leaves)
            # what may be the beginning of a special token at the window's end settles nothing
            settled = _SETTLED.search(window[: max(0, len(window) - hidden)])
            limit = len(window) if whole else settled.start() if settled else -1
            cut, where = [], 0
            for piece in self.counts.cut(window):
                if where in joints and where <= limit:
                    found = where
                    break
                cut.append(piece)
                where += len(piece)
            else:
                found = where if whole else None
            take *= 2
        self.encoded += found
        self._set(first, cut, sum(self.counts[x] for x in cut))
        for k in range(first + 1, joints[found]):
            if self.leaves[k]:
                self._set(k, [], 0)


def _edits(b: pa.RecordBatch, texts: list[str], find) -> list[list[Edit]]:
    if find:
        return [find(t) for t in texts]
    return [[(e["at"], e["delete"] or 0, e["insert"] or "") for e in x or [] if e is not None and e["at"] is not None] for x in b.column("edits").to_pylist()]


def edited_counts(docs: DataFrame, tokenizer: str, find=None, with_text: bool = False) -> DataFrame:
    """Token counts of each whole text before and after its edits.

    Edits come from ``find(text)`` or from a column ``edits``, array<struct<at, delete, insert>>,
    and are made in their order, each on what the ones before left. A null text counts as
    empty, null edits as none; an edit that is null or has no ``at`` is none either, a null ``delete``
    deletes nothing and a null ``insert`` inserts nothing. Columns: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars,
    n_chars_edited, n_chars_encoded (cut and encoded again for the edits) and, if asked for,
    text. Extra columns are ignored, whatever their names, repeated rows are counted one by one,
    and an empty table gives none. Counts are those of the tokenizers library on the whole text.
    """
    schema = "doc_id long, n_tokens long, n_edits int, n_tokens_edited long, n_chars long, n_chars_edited long, n_chars_encoded long" + ", text string" * with_text
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * with_text]
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokenizer)
        for b in rounds(batches):
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc_id, text, edits in zip(b.column("doc_id").to_pylist(), texts, _edits(b, texts, find), strict=True):
                tree = TokenTree(text, counts)
                before = tree.tokens
                for e in edits:
                    tree.edit(*e)
                rows.append((doc_id, before, len(edits), tree.tokens, len(text), tree.characters, tree.encoded, *[tree.text()] * with_text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select("doc_id", "text", *[] if find else ["edits"]).mapInArrow(each, schema)


def kept(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, chars and tokens (arrays, an entry for each pre-token) of each row: the leaves of its tree, to be written.

    A null text counts as empty and has empty arrays. Extra columns are ignored, whatever their
    names; repeated rows are kept one by one; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokenizer)
        for b in rounds(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            cuts = [counts.cut(t) for t in texts]
            chars, tokens = [[len(x) for x in c] for c in cuts], [[counts[x] for x in c] for c in cuts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *[pa.array(x, pa.list_(pa.int32())) for x in (chars, tokens)]], names=["doc_id", "text", "chars", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, text string, chars array<int>, tokens array<int>")


def applied(trees: DataFrame, tokenizer: str, find=None) -> DataFrame:
    """Rows of ``kept`` with their edits made: doc_id, text, chars, tokens, n_tokens and n_chars_encoded.

    Edits are given as to ``edited_counts``. Nothing is encoded but pre-tokens that the edits
    touch and those beside them; the result can be written and edited again.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(tokenizer)
        for b in rounds(batches):
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            leaves = [[np.asarray(x or [], dtype=np.int64) for x in b.column(c).to_pylist()] for c in ("chars", "tokens")]
            for text, chars, tokens, edits in zip(texts, *leaves, _edits(b, texts, find), strict=True):
                tree = TokenTree(text, counts, (chars, tokens))
                for e in edits:
                    tree.edit(*e)
                rows.append((tree.text(), *tree.leaf_sums(), tree.tokens, tree.encoded))
            types = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "text", "chars", "tokens", "n_tokens", "n_chars_encoded"])

    got = trees.select("doc_id", "text", "chars", "tokens", *[] if find else ["edits"])
    return got.mapInArrow(each, "doc_id long, text string, chars array<int>, tokens array<int>, n_tokens long, n_chars_encoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the column ``edits`` from rows (doc_id, seq, at, delete, insert), in order of seq (null first); edits without a doc_id are left out, and null fields mean what they do to ``edited_counts``."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "at", "delete", "insert"))), lambda e: F.struct(e["at"].alias("at"), e["delete"].alias("delete"), e["insert"].alias("insert")))
    return docs.join(edits.groupBy("doc_id").agg(listed.alias("edits")), "doc_id", "left")
