"""Substring dedup with a count-min prefilter.

A window is a run of 50 words of one document.  A word is removed if some window that
covers it has a word sequence that also starts in a document with a smaller id.

First pass: every window is represented by its minimizer, the run of 25 words with the
least hash within it; equal windows have equal minimizers, and neighbouring windows
mostly share theirs, so there are about 13 times fewer of them.  Each task counts its
minimizers (once a document) in a count-min sketch with counters that stop at 2; the
tasks' sketches are merged shard by shard.  A window's estimate is its minimizer's, which
is never less than the number of documents that hold the window.

Second pass: windows with an estimate of 2 or more, and no others, are grouped exactly,
by 96 bits of two independent hashes.  A false estimate costs a row and changes no result, so a sketch that
a corpus overfills makes the second pass larger and loses nothing.  They are shuffled once: of the
equal windows among MOST of a task only those of the least doc_id are sent, as the others
have a smaller one there, so a group has few rows however often its window is found.

The sketch has ROWS * 2**bits counters, ``bits`` following the size of the corpus up to
MAX_BITS; what is sent to the driver and broadcast is a bit for each counter, 64 MB at
most.

Defined results: null text has no words; texts of fewer than 50 words lose nothing; rows
with the same doc_id are judged each for itself and don't make each other lose words; a
text of any length is read whole; a null doc_id is smaller than none and loses nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nocturne.llm.textvec import Words, buffer_of, joined, mix, pieces, window_hashes, window_ok, word_hashes, words_of

ROWS = 2
MIN_BITS, MAX_BITS, SHARD_BITS = 18, 28, 18
BYTES_PER_KEY = 80  # of text, for each minimizer
MOST = 1 << 19  # windows compared at a time before they are sent


def _gram(window: int) -> int:
    return window // 2


def windows_of(text: pa.Array, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word hashes, places of whole windows, each window's minimizer hash)."""
    w = words_of(*buffer_of(text))
    hashes = word_hashes(w)
    n, gram = len(hashes), _gram(window)
    if n < window:
        return w, hashes, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = window_hashes(hashes, gram)
    span, have = window - gram + 1, 1  # minimum over span neighbours, by doubling
    while have * 2 <= span:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    rest = span - have
    if rest:
        best = np.minimum(best[: len(best) - rest], best[rest:])
    at = np.flatnonzero(window_ok(w.first, n, window))
    return w, hashes, at, best[at]


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each key in each row of the sketch."""
    return [(mix(keys + np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(ROWS)]


def sketch(docs: DataFrame, window: int, bits: int) -> np.ndarray:
    """Bitmap of the counters that reach 2, row after row; ``docs`` has the text only."""
    shard_bits = min(bits, SHARD_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(slots: np.ndarray) -> pa.RecordBatch:
            slots, n = np.unique(slots, return_counts=True)
            shard = slots >> shard_bits
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            inner = ((slots & ((1 << shard_bits) - 1)) << 1 | (n > 1)).astype("<u4")
            blocks = [x.tobytes() for x in np.split(inner, cut[1:])]
            return pa.record_batch([pa.array(shard[cut], pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "slots"])

        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, 0):
                w, _, at, keys = windows_of(piece.column(0), window)
                if not len(at):
                    continue
                row = w.rows()[at]
                new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))
                keys, row = keys[new], row[new]
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                keys = keys[np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))]
                held += _slots(keys, bits)
                size += len(keys)
                if size > 1 << 20:
                    yield put(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield put(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard not in planes:
                    planes[shard] = (np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool))
                once, twice = planes[shard]
                codes = np.frombuffer(block, "<u4").astype(np.int64)
                slot = codes >> 1
                twice[slot] |= once[slot] | (codes & 1).astype(bool)
                once[slot] = True
        packed = [np.packbits(twice, bitorder="little").tobytes() for _, twice in planes.values()]
        yield pa.record_batch([pa.array(list(planes), pa.int32()), pa.array(packed, pa.binary())], names=["shard", "slots"])

    parts = docs.mapInArrow(count, "shard int, slots binary").repartition("shard")
    out = np.zeros((ROWS << bits) // 8, np.uint8)
    step = (1 << shard_bits) // 8
    for row in parts.mapInArrow(merge, "shard int, slots binary").collect():
        out[row["shard"] * step : (row["shard"] + 1) * step] = np.frombuffer(row["slots"], np.uint8)
    return out


def _often(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for slot in _slots(keys, bits):
        found &= (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return found


def _ranks(ids: pa.Array, kind: str) -> np.ndarray:
    """Places of ids in Spark's order, equal for equal ids; all equal where the order of their type isn't known to be the same here."""
    if len(ids) and (pa.types.is_integer(ids.type) or kind == "string"):
        return pa.compute.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    return np.zeros(len(ids), np.int64)


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Lists of ``size`` values each, null for none."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(values, pa.int32()), mask=pa.array(size == 0))


def candidates(docs: DataFrame, window: int, bits: int, bitmap, most: int = MOST) -> DataFrame:
    """(doc_id, copy, h, g, at, more): windows estimated repeated, once for each row; (h, g) is 96 bits of hash, ``more`` its other places.

    Some ``most`` windows are compared before they are sent: of equal ones only those of the
    least doc_id are left open, as the others are known to go; these are in ``more`` of one row, with no g.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "copy", "h", "g", "at", "more"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bitmap.value
        ids, copies, held, rows, size = [], [], [], 0, 0

        def put() -> Iterator[pa.RecordBatch]:
            doc, copy = pa.concat_arrays(ids), pa.concat_arrays(copies)
            row, h, g, at = (np.concatenate(x) for x in zip(*held))
            rank = _ranks(doc, kind)[row]
            order = np.argsort(rank, kind="stable")
            order = order[np.argsort(h[order], kind="stable")]  # a collision in h cuts a run, and leaves more open
            one, key, other = row[order], h[order], g[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (other[1:] != other[:-1])))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            known = rank[order] > rank[order[first]]
            head = ~known & (new | np.concatenate(([True], one[1:] != one[:-1])))
            # In the order of the input, in which neighbours have most in common.
            number = np.cumsum(head) - 1
            own = order[head]
            place = np.empty(len(own), np.int64)
            place[np.argsort(own)] = np.arange(len(own))
            extra = np.flatnonzero(~known & ~head)
            to = place[number[extra]]
            extra = at[order[extra[np.argsort(to, kind="stable")]]]
            own = np.sort(own)
            mine = pa.array(row[own])
            more = _lists(extra, np.bincount(to, minlength=len(own)))
            yield pa.record_batch([doc.take(mine), copy.take(mine), pa.array(h[own].view(np.int64)), pa.array(g[own]), pa.array(at[own]), more], names=names)
            gone = np.sort(order[known])
            if len(gone):
                line, n = np.unique(row[gone], return_counts=True)
                mine, none = pa.array(line), pa.nulls(len(line), pa.int32())
                spread = mix(copy.take(mine).to_numpy().view(np.uint64) + line.astype(np.uint64))
                yield pa.record_batch([doc.take(mine), copy.take(mine), pa.array(spread.view(np.int64)), none, none, _lists(at[gone], n)], names=names)

        for batch in batches:
            for piece in pieces(batch, 2):
                w, hashes, at, keys = windows_of(piece.column(2), window)
                row = w.rows()[at]
                hit = _often(seen, keys, bits) & piece.column(0).is_valid().to_numpy(zero_copy_only=False)[row]
                at, row = at[hit], row[hit]
                if not len(at):
                    continue
                first = window_hashes(hashes, window)[at]
                second = window_hashes(word_hashes(w, other=True), window)[at]
                ids.append(piece.column(0))
                copies.append(piece.column(1))
                held.append((row + rows, first, (second >> np.uint64(32)).astype(np.uint32).view(np.int32), (at - w.first[row]).astype(np.int32)))
                rows += piece.num_rows
                size += len(at)
                if size >= most:
                    yield from put()
                    ids, copies, held, rows, size = [], [], [], 0, 0
        if held:
            yield from put()

    return docs.mapInArrow(kernel, f"doc_id {kind}, copy long, h long, g int, at int, more array<int>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, if ``texts``) of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(4 * max(size, 1) / BYTES_PER_KEY)))))
    bitmap = spark.sparkContext.broadcast(sketch(base.select("text"), window, bits))
    found = candidates(base, window, bits, bitmap)
    least = F.min("doc_id").over(Window.partitionBy("h", "g"))
    hits = found.withColumn("least", least).where(F.col("g").isNull() | (F.col("doc_id") > F.col("least")))
    places = hits.groupBy("doc_id", "copy").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("more"))).alias("more"))
    places = places.select("doc_id", "copy", F.concat("at", "more").alias("at"))
    marked = base.join(places, ["doc_id", "copy"], "left").select("doc_id", "text", "at")
    kind = marked.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                w = words_of(*buffer_of(piece.column(1)))
                n = len(w.start)
                row = w.first[:-1]
                at = piece.column(2)
                own = np.repeat(row, pa.compute.fill_null(pa.compute.list_value_length(at), 0).to_numpy(zero_copy_only=False))
                begin = at.flatten().to_numpy(zero_copy_only=False) + own
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + window, -1)
                gone = np.cumsum(step[:n]) > 0
                data, offsets, _, _ = joined(w, ~gone)
                view = memoryview(data)
                kept = [bytes(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                # A row's bytes begin at the end of the row before; only rows with words have any.
                lost = np.concatenate(([0], np.cumsum(gone)))[w.first]
                out = [
                    piece.column(0),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(np.diff(lost).astype(np.int64)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    out, names = [*out, pa.array([x.decode() for x in kept])], [*names, "text"]
                yield pa.record_batch(out, names=names)

    return marked.mapInArrow(kernel, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)
