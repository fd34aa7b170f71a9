"""SimHash near-dedup with pivot distance tables.

A fingerprint has 64 bits; bit i is 1 if over half of the text's shingle hashes have it.
Fingerprints of texts that differ in a few words differ in a few bits, and two link if
they differ in at most ``most`` bits.

Candidates are pairs of distinct fingerprints that agree on some group of bit blocks: if
the bits are cut into B blocks and at most 4 bits differ, at least B - 4 blocks agree, so
each choice of B - 4 blocks is one grouping, and no link is lost.  B grows with the
number of fingerprints (5 groupings at B = 5, 15 at 6, 35 at 7, ...) so that chance
members of a group stay few.  Each fingerprint has a row of Hamming distances to the
pivots, fixed reference fingerprints, worked out once and carried as bytes.  A candidate pair is discarded if any coordinate
of its rows differs by more than ``most``, since |d(x,p) - d(y,p)| <= d(x,y); the
survivors are verified by their own distance.

Work is on distinct fingerprints.  A group with more than CELL members is dealt into
cells, one for each pair of its parts, so no task holds more than two parts.  A cell
puts out a spanning forest of its links and not the links.

Defined results: null or blank text has fingerprint zero and links like any other; fewer
than 4 words are one shingle; a text of any length is read whole; rows with the same doc_id are rows of their own; a null
doc_id is never a component's id unless all are null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import materialize
from nocturne.llm.components import components
from nocturne.llm.textvec import buffer_of, joined, pieces, words_of

SEED = 42
CELL = 2048
PIVOTS = 24


def majority(hashes: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """uint64 of each row with the bits that over half of its hashes have; ``rows`` rises, a row has ``size`` hashes."""
    ones = np.zeros((len(size), 64), np.int64)
    for low in range(0, len(hashes), 1 << 15):
        part, own = hashes[low : low + (1 << 15)], rows[low : low + (1 << 15)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    bits = (2 * ones > size[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints_of(text: pa.Array, shingle: int) -> np.ndarray:
    """uint64 fingerprint of each text."""
    data, offsets = buffer_of(text)
    w = words_of(data, offsets)
    flat, _, start, end = joined(w, lower=True)
    counts = w.counts
    size = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    total = int(size.sum())
    rows, hashes = np.repeat(np.arange(len(counts)), size), np.zeros(0, np.uint64)
    if total:
        first = np.repeat(w.first[:-1], size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        last = np.minimum(first + shingle, np.repeat(w.first[1:], size)) - 1
        view, digest = memoryview(flat), xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist())), np.uint64, total)
    return majority(hashes, rows, size)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long with the same bits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                fp = fingerprints_of(piece.column(1), shingle).view(np.int64)
                yield pa.record_batch([piece.column(0), pa.array(fp)], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(kernel, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints."""
    return np.random.default_rng(20_240_607).integers(0, 2**64, n, dtype=np.uint64)


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, far): the distances of each fingerprint to the pivots, a byte each."""
    refs = pivots()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            far = np.zeros((len(fp), len(refs)), np.uint8)
            for k, ref in enumerate(refs):
                far[:, k] = np.bitwise_count(fp ^ ref)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(refs)), len(fp), [None, pa.py_buffer(far.tobytes())])
            yield pa.record_batch([batch.column(0), raw.cast(pa.binary())], names=["fp", "far"])

    return fps.select("fp").mapInArrow(kernel, "fp long, far binary")


def groupings(n: int, most: int) -> list[int]:
    """Bit masks, one for each choice of blocks, with about as many key bits as n fingerprints ask for."""
    blocks = most + 1
    while 64 * (blocks - most) / blocks < np.log2(max(n, 2)) and blocks < most + 5:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - most)]


def _pairs(size: np.ndarray, start: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within runs [start, start + size), some at a time."""
    left = np.repeat(start + size - 1, size)
    first = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    n = left - first
    total = np.concatenate(([0], np.cumsum(n)))
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        k = n[low:high]
        a = np.repeat(first[low:high], k)
        yield a, a + 1 + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        low = high


def _forest(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of the components within each cell (rows sorted by cell); ``table`` has a row of pivot distances for each row."""
    n = len(fp)
    cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.append(cut, n))
    table = table.astype(np.int8)
    root = np.arange(n)
    for a, b in _pairs(size, cut):
        far = root[a] != root[b]
        far &= (side[a] == 2) | (side[a] != side[b])
        a, b = a[far], b[far]
        for k in range(table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, k] - table[b, k]) <= most
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most
        a, b = a[near], b[near]
        while len(a):
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while True:
                jump = root[root]
                if np.array_equal(jump, root):
                    break
                root = jump
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
    own = np.flatnonzero(root != np.arange(n))
    return fp[own], fp[root[own]]


def links(fps: DataFrame, most: int = 4, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the same components as all links.

    ``fps`` has one row for each distinct ``fp``.
    """
    masks = groupings(fps.count(), most)
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)]))
    table = materialize(pivot_table(fps), "pivots")
    keyed = table.select("fp", "far", key.alias("k")).select("fp", "far", "k.g", "k.key")
    sizes = keyed.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(sizes, ["g", "key"]).withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    own = F.pmod(F.xxhash64("fp", "g"), F.col("parts")).cast("int")
    members = members.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = members.select("fp", "far", "g", "key", "own", other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte")
    dealt = dealt.select("fp", F.xxhash64("g", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"), "far")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _forest(columns[0].view(np.uint64), columns[1], columns[2], columns[3], most)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new.append(np.frombuffer(pa.concat_arrays([batch.column(3)]).cast(pa.binary(PIVOTS)).buffers()[1] or b"", np.uint8)[: len(batch) * PIVOTS].reshape(-1, PIVOTS))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            whole = int(np.searchsorted(held[1], held[1][-1], "left")) if len(held[1]) else 0
            if whole:
                yield put([x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held is not None and len(held[0]):
            yield put(held)

    dealt = dealt.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(kernel, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps, most))
    label = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # Written, so that the joins are between two shuffles, of which a hot key's can be split.
    ids = materialize(label.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = materialize(label.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
