"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are covered by the words of a product of perfect codes: two binary
Golay codes of length 23 (covering radius 3) and a Hamming code of length 15 (radius 1); three
bits stay free. Each fingerprint has one home anchor, its nearest code word. If two
fingerprints differ in at most two bits, the second lies within radius plus two of the first's
home, with the excess over all three blocks at most two. So each fingerprint is replicated to
every anchor within that reach and compared there with those at home. No pair is missed, and a
fingerprint has about 150 replicas however large the corpus is; the 2**35 anchors keep the
groups small at 10**10 fingerprints.

Copies and equal fingerprints are one node, so a group of copies costs nothing. Components
come from rounds that contract the links, each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Tables, place, stable, whole, written
from pagewright.llm.tokens import rounds

SEED = 42
#: (length, generator polynomial, covering radius, first bit) of each block's code.
BLOCKS = ((23, 0b110001110101, 3, 0), (23, 0b110001110101, 3, 23), (15, 0b10011, 1, 46))
REACH = 2
#: Home fingerprints in a task's hash table, about 50 bytes each.
HOMES_HELD = 1_000_000
#: Shingles whose bits are counted at once.
STEP = 1 << 14


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority of each bit over the XXH64 of word shingles; zero for a text without a word."""
    words = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + STEP], last[at : at + STEP], strict=True)], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each whole text; null counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            fp = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, fp long")


def _remainder(x: np.ndarray, length: int, poly: int) -> np.ndarray:
    degree = poly.bit_length() - 1
    for k in range(length - 1, degree - 1, -1):
        x = np.where(x >> k & 1, x ^ poly << (k - degree), x)
    return x


@cache
def _patterns(length: int, poly: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess 0..REACH over the radius: the flips to a code word, by syndrome, and where each syndrome's begin."""
    out = []
    for excess in range(REACH + 1):
        weights = range(radius + 1) if not excess else [radius + excess]
        flips = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(length), w)], dtype=np.int64)
        syndrome = _remainder(flips, length, poly)
        order = np.argsort(syndrome, kind="stable")
        out.append((flips[order], np.searchsorted(syndrome[order], np.arange((1 << poly.bit_length() - 1) + 1))))
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each fingerprint, index of the fingerprint of each replica, anchor of each replica)."""
    mask = sum(((1 << n) - 1) << at for n, _, _, at in BLOCKS)
    syndromes = [_remainder(fp >> at & (1 << n) - 1, n, poly) for n, poly, _, at in BLOCKS]
    owners, found, home = [], [], None
    spread = [e for e in np.ndindex(*[REACH + 1] * len(BLOCKS)) if sum(e) <= REACH]
    for excesses in spread:
        owner, anchor = np.arange(len(fp)), fp & mask
        for (n, poly, radius, at), syndrome, excess in zip(BLOCKS, syndromes, excesses, strict=True):
            flips, begin = _patterns(n, poly, radius)[excess]
            s = syndrome[owner]
            count = begin[s + 1] - begin[s]
            total = np.cumsum(count)
            place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)
            flip = flips[np.repeat(begin[s], count) + place]
            owner, anchor = np.repeat(owner, count), np.repeat(anchor, count) ^ flip << at
        if not any(excesses):
            home = anchor
        owners.append(owner)
        found.append(anchor)
    return home, np.concatenate(owners), np.concatenate(found)


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b by value of fp, of the distinct fingerprints that differ in REACH bits or fewer."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            home, _, _ = anchors(fp) if len(fp) < 4096 else (np.concatenate([anchors(fp[i : i + 4096])[0] for i in range(0, len(fp), 4096)]), 0, 0)
            yield pa.RecordBatch.from_arrays([pa.array(home), b.column("fp")], names=["anchor", "home"])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            for at in range(0, len(fp), 1024):
                part = fp[at : at + 1024]
                _, owner, anchor = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[owner])], names=["anchor", "fp"])

    homes = nodes.select("fp").mapInArrow(at_home, "anchor long, home long")
    replicas = nodes.select("fp").mapInArrow(covered, "anchor long, fp long")
    near = (F.col("home") < F.col("fp")) & (F.bit_count(F.col("home").bitwiseXOR(F.col("fp"))) <= REACH)
    # a hash table of the homes, one row a fingerprint and so many a task at most; replicas stream past unsorted
    parts = nodes.count() // HOMES_HELD + 1
    if parts > int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        homes, replicas = homes.repartition(parts, "anchor"), replicas.repartition(parts, "anchor")
    met = replicas.join(homes.hint("shuffle_hash"), "anchor").where(near)
    return met.select(F.col("home").alias("a"), F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``edges`` (a, b): label is the smallest node reachable.

    Each round sends a node to its least neighbour's least neighbour and maps the links with
    it; links inside a group vanish and equal ones merge, so their number falls fast and
    rounds grow with the logarithm of a component's width. Every round is a table in the
    shared folder: a join's hot side can be split, and lost executors cost one round.
    """
    held = Tables(edges.sparkSession)
    left = held.written(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        now = Tables(edges.sparkSession)
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        near = now.written(ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("to")))
        jump = near.join(near.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        parents = now.written(jump)
        if labels is None:
            labels = parents.withColumnRenamed("to", "label")
        else:
            moved = labels.join(parents.withColumnRenamed("node", "label"), "label", "left")
            labels = now.written(moved.select("node", F.coalesce("to", "label").alias("label")))
        at_a = left.join(parents.withColumnRenamed("node", "a"), "a").select("b", F.col("to").alias("x"))
        mapped = at_a.join(parents.withColumnRenamed("node", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        left = now.written(mapped.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        held.drop()
        held = now
        if not left.limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of ``docs`` (doc_id, text, ...).

    Fingerprints that differ in at most two bits are linked; component_id is the smallest
    doc_id that links reach. Null and wordless texts have fingerprint zero and link as any
    other. Rows that share a doc_id count as one document. Extra columns are ignored; an empty
    table gives an empty result.
    """
    prints = written(fingerprints(docs, size))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(nodes))
    # a component is named after its least fingerprint; its smallest doc_id is found over the members
    grouped = written(nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    least = written(grouped.groupBy("label").agg(F.min("first").alias("component_id")))
    named = written(grouped.join(least, "label").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The wide signature of ``similar``: words of 64 bits, and tables of a Golay block of its bits each.
LANES, TABLES = 4, 64
#: Smallest shingles, by an order of its own each, that a pair must share besides a table's anchor.
MINIMA = 2
#: Words of a shingle and the least similarity (Jaccard, of the sets of shingles) of near-duplicates.
SHINGLE, LEAST_SIMILAR = 5, 0.8
#: A sketch holds four bits of each of the TABLES * MINIMA smallest shingles in this many longs. Sketches of a pair
#: of 0.8 agree in 104 of 128 places, with a deviation of 4.4; fewer than these 80 have a chance of 3e-8.
SKETCH, LEAST_AGREED = TABLES * MINIMA // 16, 80
#: Bits of the filter that leaves texts of no candidate where they lie, and bits an id: 8 MB however many ids there are.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3
#: Counters of shingles by which the rarest of a set are told.
COUNTERS = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _hashed(text: str | None) -> np.ndarray:
    """XXH64 of each word."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, or one for a shorter text; none for a text without a word."""
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, dtype=np.uint64)
    for k in range(size):
        h = _mix(h + words[k : k + len(h)])
    return h


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(_shingles(words, SHINGLE))


def signature(words: np.ndarray) -> np.ndarray:
    """LANES words of 64 majority bits over the two-word shingles; zeros for a text without a word."""
    h = _shingles(words, 2)
    count = np.zeros(64 * LANES, dtype=np.int64)
    salt = (np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
    for at in range(0, len(h), STEP // LANES):
        x = _mix(h[at : at + STEP // LANES, None] ^ salt)
        count += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(h), bitorder="little").view("<u8")


def _digest(shingles: np.ndarray) -> list[int]:
    """128 bits that name a set of shingles."""
    return [int(_mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64)) for k in (1, 2)]


@cache
def _places() -> np.ndarray:
    """The bits of each table."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(64 * LANES)[: BLOCKS[0][0]] for _ in range(TABLES)])


@cache
def _orders() -> np.ndarray:
    """Odd factors; the products with them order the shingles."""
    return np.random.default_rng(SEED).integers(0, 1 << 63, TABLES * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def home_keys(signatures: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketch). For each document and table: the home anchor of its signature (a row of LANES words) with MINIMA of its shingles, hashed.

    A code of 23 bits has 4,096 anchors, too few for a large corpus on its own; with the
    shingles only documents that share some text meet, however many there are.
    """
    bits = np.unpackbits(np.ascontiguousarray(signatures).view(np.uint8).reshape(len(signatures), -1), axis=1, bitorder="little")[:, _places()]
    n, poly, radius, _ = BLOCKS[0]
    x = bits.astype(np.int64) @ (1 << np.arange(n))
    flips, begin = _patterns(n, poly, radius)[0]
    anchor = (x ^ flips[begin[_remainder(x, n, poly)]]).astype(np.uint64)
    least = np.full((len(sets), TABLES * MINIMA), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i, h in enumerate(sets):
        for at in range(0, len(h), STEP // TABLES):
            np.minimum(least[i], (h[at : at + STEP // TABLES, None] * _orders()).min(axis=0), out=least[i])
    key = _mix(anchor + (np.arange(TABLES, dtype=np.uint64) << np.uint64(n)))
    for k in range(MINIMA):
        key = _mix(key + least[:, k::MINIMA])
    bits = (_mix(least) & np.uint64(15)).astype(np.uint8)
    return key.view(np.int64), np.ascontiguousarray(bits[:, ::2] | bits[:, 1::2] << 4).view("<i8")


def _agreed(one: str, other: str) -> Column:
    """Places in which the sketches in columns ``one``0.. and ``other``0.. agree."""
    apart = F.lit(0)
    for k in range(SKETCH):
        d = F.col(f"{one}{k}").bitwiseXOR(F.col(f"{other}{k}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        apart = apart + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(16 * SKETCH) - apart


def _filter_places(ids: np.ndarray) -> np.ndarray:
    return _mix(ids.view(np.uint64)[:, None] + np.arange(1, FILTER_HASHES + 1, dtype=np.uint64)) % np.uint64(FILTER_BITS)


def _among(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node and text of the rows of the ``stable`` table ``docs`` that ``rows`` (file, at, node) names; a Bloom filter keeps most other texts from being moved.

    Far above ten million rows the filter is full and all texts move; the result is the same.
    """
    name = F.xxhash64("file", "at").alias("name")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _filter_places(b.column("name").to_numpy()).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = rows.select(name).mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _filter_places(b.column("name").to_numpy())
            yield b.filter(pa.array((held[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).all(axis=1))).drop_columns(["name"])

    texts = docs.select(*place(docs), "text").select("file", "at", "text", name)
    return texts.mapInArrow(passed, "file long, at long, text string").join(rows.select("file", "at", "node"), ["file", "at"]).select("node", "text")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return _mix(shingles ^ np.uint64(SEED)) % np.uint64(COUNTERS)


def _rarest(sets: DataFrame) -> DataFrame:
    """(node, part, n, pos, shingle): the rarest shingles of each row of ``sets`` (node, part, shingles), their places from 1 on, and n, the number it has.

    Two sets of n and m shingles that are LEAST_SIMILAR share that part of the larger one at
    least; so in any one order of all shingles the first they share is among the first n - ceil(0.8 n) + 1
    of the one, and likewise of the other. Rare ones come first by counts in a table of bounded
    size: two shingles in one counter only make a group larger.
    """

    def flat(b: pa.RecordBatch) -> np.ndarray:
        return b.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, n = np.unique(_slots(flat(b)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    got = sets.select("shingles").mapInArrow(counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(COUNTERS, dtype=np.uint8)
    level[got.column("slot").to_numpy()] = np.minimum(255, 6 * np.log2(got.column("n").to_numpy()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "part", "n", "pos", "shingle"]
        for b in batches:
            node, part = b.column("node").to_numpy(), b.column("part").to_numpy()
            out, held = [], 0
            for i in range(b.num_rows):
                h = flat(b.slice(i, 1))
                n = len(h)
                take = n - int(np.ceil(LEAST_SIMILAR * n - 1e-9)) + 1 if n else 0
                h = h[np.lexsort((_mix(h), level[_slots(h)]))[:take]].view(np.int64)
                out.append((np.full(take, node[i]), np.full(take, part[i]), np.full(take, n), np.arange(1, take + 1), h))
                held += take
                if held >= STEP or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=names)
                    out, held = [], 0

    return sets.select("node", "part", "shingles").mapInArrow(first, "node long, part long, n long, pos long, shingle long")


def _unsettled(met: DataFrame, labels: DataFrame, held: Tables) -> DataFrame:
    """(node, part): the nodes of keys of ``met`` (key, node, center) whose nodes, the center aside, lie in several components."""
    parts = held.written(met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("part")))
    several = held.written(parts.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("key"))
    return held.written(parts.join(several, "key", "left_semi").select("node", "part").distinct())


def _further_pairs(sets: DataFrame, held: Tables) -> DataFrame:
    """Pairs (center, node) that may be similar, of ``sets`` (node, part, shingles): nodes that met at a key without being its center.

    What links join already needs no pair. Nodes of a key that still lie in several components
    are paired by their rarest shingles, which no similar pair fails to share; so all pairs at a
    key are judged. At the first shingle that a pair shares, what is left of either set bounds
    what they can share at all; so one of the two has it among its first ninth and a bit
    (0.1 / 0.9 at 0.8), and a passage that a large family shares with too little else makes no pair.
    """
    rare = _rarest(sets)
    least = LEAST_SIMILAR / (1 + LEAST_SIMILAR)
    rare = held.written(rare.withColumn("early", F.col("pos") <= (1 - 2 * least) * F.col("n") + 1 + 1e-6))
    # pairs inside the largest component at a shingle are those of copies: left out before rows meet
    groups = rare.groupBy("shingle", "part").agg(F.count("*").alias("rows"), F.max("early").alias("early")).groupBy("shingle")
    groups = groups.agg(F.max_by("part", F.struct("rows", "part")).alias("main"), F.count("*").alias("parts"), F.max("early").alias("early"))
    grouped = held.written(rare.join(held.written(groups.where("parts > 1 AND early").select("shingle", "main")), "shingle"))
    grouped = grouped.withColumn("is_main", F.col("part") == F.col("main")).drop("main")
    a = grouped.where("early").select("shingle", "is_main", F.col("node").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("pos").alias("ia"))
    b = grouped.select("shingle", F.col("is_main").alias("b_main"), F.col("early").alias("b_early"), F.col("node").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("pos").alias("ib"))
    rest = 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    may = (F.col("pa") != F.col("pb")) & (F.least("na", "nb") >= LEAST_SIMILAR * F.greatest("na", "nb")) & (rest >= least * (F.col("na") + F.col("nb")) - 1e-6)
    others = a.where("NOT is_main").join(b, "shingle").where(may & (F.col("b_main") | ~F.col("b_early") | (F.col("a") < F.col("b"))))
    mains = a.where("is_main").join(b.where("NOT b_main AND NOT b_early"), "shingle").where(may)
    found = held.written(others.select("a", "b").union(mains.select("a", "b")))
    return held.written(found.select(F.least("a", "b").alias("center"), F.greatest("a", "b").alias("node")).distinct())


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of documents that links reach; a link is a similarity of five-word shingles of 0.8 or more.

    Candidates: a pair of that similarity differs in about 0.095 of the bits of a
    two-word-shingle signature. It shares the home anchor and the smallest shingles of some of
    the 64 tables with a chance of about 0.99 (truncated, extended and block-replaced copies at just
    0.8, of 300 words) or more (above 0.999 for scattered edits); there each signature is held against the one of the
    smallest doc_id, so a group of n copies gives n - 1 links and not all pairs. Those that this
    leaves in several components are paired among each other by their rarest shingles. All candidates
    are checked on their whole sets of shingles. Equal sets are one node.

    Null and wordless texts are similar to each other only; repeated rows and equal texts have
    one component. Rows without a doc_id link nothing; they have the component of an equal text, else null. A text of fewer than five
    words is one shingle. Extra columns are ignored, whatever their names; an empty table gives none.
    """
    return _similar(stable(docs)).select("doc_id", "component_id")


def _similar(docs: DataFrame) -> DataFrame:
    """file, at, doc_id and component_id of each row of a ``stable`` table."""
    longs = lambda x: pa.array(np.ascontiguousarray(x).view("<i8"))
    sketch = [f"s{k}" for k in range(SKETCH)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            words = [_hashed(t) for t in b.column("text").to_pylist()]
            found = [shingle_set(w) for w in words]
            named = np.array([_digest(x) for x in found], dtype="<u8").reshape(-1, 2)
            signs = np.array([signature(w) for w in words], dtype="<u8").reshape(-1, LANES)
            keys, sketches = home_keys(signs, found)
            made = [longs(named[:, 0]), longs(named[:, 1]), pa.array(list(map(len, found)), pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), *[longs(sketches[:, k]) for k in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "at", "doc_id")), *made], names=["file", "at", "doc_id", "d0", "d1", "n", "keys", *sketch])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rounds(batches):
            found = [shingle_set(_hashed(t)).view("<i8") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(*place(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(texts.mapInArrow(each, "file long, at long, doc_id long, d0 long, d1 long, n long, keys array<long>, " + ", ".join(f"{c} long" for c in sketch)))
    held = Tables(docs.sparkSession)
    # of equal sets that of the smallest doc_id is the node; rows that share a doc_id share the node
    first = signed.where("doc_id IS NOT NULL").groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "file", "at")).alias("f"))
    first = held.written(first.select("d0", "d1", F.col("f.doc_id").alias("node"), "f.file", "f.at"))
    nodes = signed.drop("d0", "d1", "doc_id").join(first.select("file", "at", "node"), ["file", "at"])
    nodes = held.written(nodes)
    keys = nodes.select("node", F.explode("keys").alias("key"))
    # an anchor with one signature links nothing; counts are small next to the keys
    centers = held.written(keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").select("key", "center"))
    met = held.written(keys.join(centers, "key").where("node <> center"))
    pairs = held.written(met.select("center", "node").distinct())
    # pairs far from similar are told by their sketches, before any text moves
    sketches = nodes.select("node", "n", *sketch)
    both = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("center"), F.col("n").alias("m"), *[F.col(c).alias(f"o{c}") for c in sketch]), "center")
    near = (F.least("n", "m") >= LEAST_SIMILAR * F.greatest("n", "m")) & (_agreed("s", "os") >= LEAST_AGREED)
    near = held.written(both.where(near).select("center", "node").distinct())
    rows = nodes.select("file", "at", "node")
    whole_ = held.written(_among(docs, rows.join(_ends(near), "node")).mapInArrow(sets, "node long, shingles array<long>"))

    def linked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
        both = pairs.join(whole, "node").join(whole.select(F.col("node").alias("center"), F.col("shingles").alias("others")), "center")
        shared = both.select("center", "node", F.size(F.array_intersect("shingles", "others")).alias("n"), (F.size("shingles") + F.size("others")).alias("total"))
        alike = shared.where(F.col("n") >= LEAST_SIMILAR * (F.col("total") - F.col("n")))
        # written here, as a distinct behind it would keep a hot center's join from being split
        return held.written(alike.select(F.col("center").alias("a"), F.col("node").alias("b")))

    first_links = linked(near, whole_)
    labels = components(first_links)
    left = _unsettled(met, labels, held)
    others = held.written(_among(docs, rows.join(left.select("node").distinct(), "node")).mapInArrow(sets, "node long, shingles array<long>"))
    further = _further_pairs(others.join(left, "node"), held)
    further = linked(further, others.join(_ends(further), "node", "left_semi"))
    labels = components(first_links.union(further)).withColumnsRenamed({"label": "component_id"})
    named = first.join(labels, "node", "left").select("d0", "d1", F.coalesce("component_id", "node").alias("component_id"))
    named = written(named)
    held.drop()
    return signed.select("file", "at", "doc_id", "d0", "d1").join(named, ["d0", "d1"], "left").select("file", "at", "doc_id", "component_id")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("node").union(pairs.select("center")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest doc_id.

    Rows without a doc_id stay; rows that share a doc_id, as those of a file that is read twice, stay or go together. Columns come back
    unchanged, whatever their names; an empty table stays empty.
    """
    docs = stable(docs)
    gone = _similar(docs).where("doc_id <> component_id").select("file", "at")
    return whole(docs).join(gone, ["file", "at"], "left_anti").select("doc.*")
