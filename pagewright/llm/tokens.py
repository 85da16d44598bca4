"""Batched encoding with public tokenizers: exact results, bounded memory.

A vocabulary file of the tokenizers library says everything that byte-pair encoding needs:
its alphabet, its merges in order and the pattern that cuts a text into words. Both kinds of
file here are read into a merge table of the tiktoken library, which merges several times
faster; texts that the shortcut can't carry (a special token's string, odd white space, some
private characters) are encoded by the tokenizers library itself, and tests hold one against
the other.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text of one round of encoding, in bytes; a longer text makes a round of its own.
ROUND_BYTES = 1 << 20

#: Ends a word inside a merge table of bytes: no word holds a blank.
_END = " "
#: Parts the texts of a round; neither a quick nor a slow text holds it.
_PART = "\0"
#: Special tokens, the parting sign, and the one letter whose lower case depends on its neighbours.
_LIBRARY_ONLY = re.compile(r"<\||\0|\u03a3")
#: Anything but blanks, newlines, visible ASCII and Latin letters in composed form with a lower case of one letter.
_NOT_QUICK = re.compile(r"[^ \n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
#: Kinds of the bytes of quick texts: 0 white space, 1 letters (as all bytes of Latin letters), 2 digits, 3 others.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[0, 10, 32]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def _apart(data: bytes) -> bytes:
    """Lower-cased quick texts with a blank behind each word: letters, one digit, other signs, or
    an apostrophe that begins a run of signs with the ending behind it (s t m d re ve ll)."""
    x = np.frombuffer(data, dtype=np.uint8)
    kind = _KIND[x]
    ends = np.empty(len(x), dtype=bool)
    ends[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
    ends[-1:] = True
    ends &= kind != 0
    quote = np.flatnonzero(x == 39)
    if len(quote):
        quote = quote[(quote == 0) | (kind[quote - 1] != 3)]
        ahead = np.concatenate((x, np.zeros(2, np.uint8)))
        a, b = ahead[quote + 1], ahead[quote + 2]
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        ends[quote[one | two]] = False
        ends[quote[one] + 1] = True
        ends[quote[two] + 1] = False
        ends[quote[two] + 2] = True
    out = x.copy()
    out[x == 10] = 32
    at = np.flatnonzero(ends[:-1] & (out[1:] != 32)) + 1
    out = np.insert(out, at, 32)
    return out.tobytes() + b" "


#: Byte-level words as the tokenizers library's ByteLevel step cuts them.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them
    without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, suffix = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        alphabet, end = _byte_of(), _END.encode()

        def raw(token: str) -> bytes:
            if suffix and token.endswith(suffix):
                return bytes(alphabet[c] for c in token[: -len(suffix)]) + end
            return bytes(alphabet[c] for c in token)

        tokens = {bytes([b]): vocab[c] for c, b in alphabet.items()}
        if suffix:
            tokens |= {bytes([b]) + end: vocab[c + suffix] for c, b in sorted(alphabet.items(), key=lambda x: x[1])}
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            tokens.setdefault(raw(left + right), vocab[left + right])
        ranks = {bytes([b]): b for b in range(256)}
        for x in tokens:
            ranks.setdefault(x, len(ranks))
        self.ids = np.zeros(len(ranks), dtype="<u4")
        for x, r in ranks.items():
            self.ids[r] = tokens[x]
        self.pattern = None
        if suffix:
            import regex

            self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        words = f"[^ {_PART}]+ |{_PART}" if suffix else _BYTE_LEVEL
        self.core = tiktoken.Encoding("merges", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _ranks(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, disallowed_special=())

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return [self._library([t])[0] if "<|" in t else self.ids[self._ranks(t)].tobytes() if t else b"" for t in texts]
        whole, slow, quick = [], [], []
        for i, t in enumerate(texts):
            (whole if _LIBRARY_ONLY.search(t) else slow if _NOT_QUICK.search(t) else quick).append(i)
        out: dict[int, bytes] = {}
        if whole:
            out |= zip(whole, self._library([texts[i] for i in whole]), strict=True)
        if quick:
            joined = _PART.join([texts[i].lower() for i in quick]).encode()
            out |= zip(quick, self._parted(_apart(joined).decode()), strict=True)
        if slow:
            words = [" ".join([*self.pattern.findall(unicodedata.normalize("NFC", texts[i]).lower()), ""]) for i in slow]
            out |= zip(slow, self._parted(_PART.join(words)), strict=True)
        return [out[i] for i in range(len(texts))]

    def _parted(self, text: str) -> list[bytes]:
        """Ids of texts whose words each end in a blank."""
        ranks = self._ranks(text)
        ends = [*np.flatnonzero(ranks == 0).tolist(), len(ranks)]
        held, at, out = self.ids[ranks].tobytes(), 0, []
        for end in ends:
            out.append(held[4 * at : 4 * end])
            at = end + 1
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def rounds(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into rounds of bounded text; one very long text is a round of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > ROUND_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
