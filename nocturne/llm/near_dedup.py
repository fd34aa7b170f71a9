"""Near-dedup by Jaccard similarity of word shingles.

A text is the set of its 64-bit hashes of ``shingle`` words in a row, ASCII letters in
lower case.  Two texts link if their sets' Jaccard similarity is ``least`` or more, and
linked texts are one component.

Candidates are sets whose SimHash fingerprints are linked by the operator of that name
(groups of equal bit blocks, pivot distances, at most MOST bits apart).  As few pairs at a
similarity of 0.8 are that close, sets that agree on some band of ROWS minhashes out of
BANDS are candidates too; a pair at similarity s is missed by all bands with probability
(1 - s**ROWS)**BANDS, which is 3 in a million at 0.8 and less above.  Every candidate pair
is verified by its exact similarity unless its members are linked already; no bucket is cut.

Work is on distinct sets, named by a 64-bit hash of the set.  Buckets with the same
members count once.  A bucket with more than CELL members is dealt into cells, one for
each pair of its parts.  A cell puts out a spanning forest of its links.

Defined results: null or blank text is the empty set, and such texts are one component;
fewer than ``shingle`` words are one shingle; rows with the same doc_id are rows of their
own; a null doc_id is never a component's id unless all are null; a text of any length is
one set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm import simhash
from nocturne.llm import textvec as V
from nocturne.llm.common import materialize
from nocturne.llm.components import components

ROWS, BANDS = 4, 24
MOST = 4
CELL = 512
BITS_PER_ID, BITS = 32, (15, 29)
_RNG = np.random.default_rng(20_240_611)
_XOR = _RNG.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def shingles_of(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of each text in rising order."""
    w = V.words_of(*V.buffer_of(text))
    hashes, counts, rows = V.word_hashes(w, lower=True), w.counts, w.rows()
    found, own = [], []
    for size in range(1, shingle + 1):
        windows = V.window_hashes(hashes, size)
        if not len(windows):
            break
        row = rows[: len(windows)]
        ok = row == rows[size - 1 :]
        ok &= counts[row] >= size if size == shingle else counts[row] == size
        found.append(windows[ok])
        own.append(row[ok])
    n = len(counts)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    flat, row = np.concatenate(found), np.concatenate(own)
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    return flat[new], np.searchsorted(row[new], np.arange(n + 1))


def names_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint64 name of each set; 0 for the empty one."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(V.mix(flat ^ np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    return V.mix(total[offsets[1:]] - total[offsets[:-1]])


def bands_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint64 key of each band of each set that is not empty, one row a set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(ROWS * BANDS if len(starts) else 0):
        least = np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], starts)
        band = k // ROWS
        out[:, band] = V.mix(out[:, band] * np.uint64(0xD1342543DE82EF95) + V.mix(least) + np.uint64(band))
    return out


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    return slim, slim.schema["doc_id"].dataType.simpleString()


def banded(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, copy, fp, sim, bands) of every row: the hash of its text, the set's name, SimHash fingerprint and band keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in V.pieces(batch, 1):
                flat, offsets = shingles_of(piece.column(1), shingle)
                keys = bands_of(flat, offsets).reshape(-1).view(np.int64)
                size = np.where(np.diff(offsets) > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(keys))
                names = pa.array(names_of(flat, offsets).view(np.int64))
                held = np.diff(offsets)
                sim = pa.array(simhash.majority(V.mix(flat), np.repeat(np.arange(len(held)), held), held).view(np.int64))
                yield pa.record_batch([piece.column(0), piece.column(2), names, sim, lists], names=["doc_id", "copy", "fp", "sim", "bands"])

    slim, kind = _texts(docs)
    return slim.mapInArrow(kernel, f"doc_id {kind}, copy long, fp long, sim long, bands array<long>")


def bitmap_of(ids: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap): a bit is set for the upper ``bits`` bits of each ``id``; 64 MB at most."""
    bits = int(np.clip(np.ceil(np.log2(BITS_PER_ID * max(ids.count(), 1))), *BITS))
    slot = F.shiftrightunsigned("id", 64 - bits)
    shards = ids.groupBy(F.shiftright(slot, 15).alias("shard")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in shards.collect():
        out[row["shard"] << 12 : (row["shard"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return bits, out


def sets(docs: DataFrame, shingle: int, bits: int, bitmap) -> DataFrame:
    """(fp, shingles) of the rows whose hash of id and text is in the bitmap, shingles as bytes of rising uint64.

    The texts aren't shuffled for this; a row that is in it by chance gives a set too.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value
        for batch in batches:
            slot = (batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            mine = (seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            for piece in V.pieces(batch.filter(pa.array(mine)), 0):
                flat, offsets = shingles_of(piece.column(0), shingle)
                raw = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([pa.array(names_of(flat, offsets).view(np.int64)), pa.array(raw, pa.binary())], names=["fp", "shingles"])

    slim = docs.select("text", F.xxhash64("doc_id", F.xxhash64("text")).alias("id"))
    return slim.mapInArrow(kernel, "fp long, shingles binary")


def forest(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """The root of each set of a cell: sets are linked if they are similar and not both of side 0 or both of side 1."""
    root, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    for i, own in enumerate(sets):
        fit = (root != root[i]) & ((side == 2) | (side != side[i])) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9)
        fit[: i + 1] = False
        others = np.flatnonzero(fit)
        if not len(others):
            continue
        flat = np.concatenate([sets[j] for j in others])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(size[others]) - size[others], dtype=np.int64)
        near = others[both >= least * (size[i] + size[others] - both) - 1e-9]
        if len(near):
            joined = np.append(root[near], root[i])
            root[np.isin(root, joined)] = joined.min()
    return root


def alike(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, key) of each set: the same key for sets whose fingerprints (``sim``) are linked at ``most`` bits or fewer."""
    sims = materialize(fps.select(F.col("sim").alias("fp")).distinct(), "sims")
    roots = components(simhash.links(sims, most))
    return fps.join(roots, fps.sim == roots.node, "left").select(fps.fp, F.xxhash64(F.lit("sim"), F.coalesce("root", "sim")).alias("key"))


def links(docs: DataFrame, fps: DataFrame, shingle: int, least: float, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct sets that give the same components as all verified candidates.

    ``fps`` has one row (fp, least, sim, bands) for each distinct set of ``docs``, least.doc_id and least.copy being of a row that has it.
    """
    close = materialize(alike(fps.where(F.size("bands") > 0)), "alike")
    keyed = close.unionByName(fps.select("fp", F.explode("bands").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")).where("n > 1")
    sizes = sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    members = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int"))
    members = materialize(members.select("fp", "key", "parts", "own"), "members")
    wanted = members.select("fp").distinct()
    ids = materialize(fps.join(wanted, "fp", "left_semi").select(F.xxhash64("least.doc_id", "least.copy").alias("id")), "wanted")
    bits, bitmap = bitmap_of(ids)
    found = sets(docs, shingle, bits, docs.sparkSession.sparkContext.broadcast(bitmap))
    found = found.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    dealt = members.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte")
    dealt = dealt.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        now = None

        def put() -> pa.RecordBatch:
            fp = np.array([x[0] for x in held], np.int64)
            root = forest([np.frombuffer(x[2], np.uint64) for x in held], np.array([x[1] for x in held]), least)
            own = np.flatnonzero(root != np.arange(len(fp)))
            return pa.record_batch([pa.array(fp[own]), pa.array(fp[root[own]])], names=["a", "b"])

        for batch in batches:
            for fp, cell, side, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now and held:
                    yield put()
                    held.clear()
                now = cell
                held.append((fp, side, raw))
        if held:
            yield put()

    rows = dealt.join(found, "fp").select("fp", "cell", "side", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(kernel, "a long, b long")


def near_dedup(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, copy (hash of the text), component_id and kept of every row.

    A component's id is its least doc_id; the row with that id, and of such rows that with
    the least copy, is kept, as are rows equal to it in both.
    """
    rows = materialize(banded(docs, shingle), "bands")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    fps = materialize(rows.groupBy("fp").agg(F.min(first).alias("least"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "distinct")
    roots = components(links(docs, fps, shingle, least))
    label = fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    # Written, so that the joins are between two shuffles, of which a hot key's can be split.
    ids = materialize(label.groupBy("root").agg(F.min("least").alias("best")), "ids")
    named = materialize(label.join(ids, "root").select("fp", "best"), "named")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("copy") == F.col("best.copy"))
    out = rows.select("doc_id", "copy", "fp").join(named, "fp")
    return out.select("doc_id", "copy", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))
