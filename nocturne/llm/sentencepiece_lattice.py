"""SentencePiece encoding and decoding with a relational lattice.

A word is a run of spaces with what follows it; a piece never spans two words.  The
vocabulary of a corpus is encoded by the lattice: words are exploded into substrings no
longer than the longest piece, the substrings are equi-joined to the piece table (a
broadcast of the model's pieces, whose number is fixed), edges are grouped by word, and a
Spark ``aggregate`` folds them, in order of their start, into the best path to each
position.  A character that no piece matches is an edge of its own and becomes its UTF-8
bytes.

What is best depends on the model's kind.  A unigram model asks for the greatest sum of
scores (Viterbi); ties go to the edge that starts first, and an unmatched character is 10
below the least score.  A merge (BPE) model's scores are ranks, and their sum means
nothing: the best path is the one on which any two neighbours stay apart when merged by
themselves.  There is just one such path to each position that can be reached, so the
same fold finds it: an edge extends the path to its start if the pair (last piece, edge)
is one of those that stay apart.  These pairs are found once for all distinct pairs of
neighbouring edges.

The lattice takes the most frequent words, at most VOCABULARY of them and no longer than
LONGEST characters; their pieces are broadcast as arrays of some MB.  Any other word is
encoded where its document is, since joining every word of every document back would
shuffle several times the input; that is the library's own encoder for a merge model and
the same Viterbi recursion for a unigram model.  The two ways are tested to agree.

Decoding puts the pieces together, bytes included, turns U+2581 into a space and takes off
the space that encoding put in front.  It gives back any text without U+2581.

Defined results: null text is empty; empty text has no pieces; repeated rows have equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import materialize
from nocturne.llm.textvec import buffer_of, pieces, span_hashes

MARK = "▁"
VOCABULARY = 1 << 17
LONGEST = 32
PART = 1 << 18  # bytes of text that are encoded at once, which bounds a Python worker's memory
PENALTY = 10.0
NORMAL, USER, BYTE = 1, 4, 6  # fixed values: kinds of pieces
UNIGRAM, MERGES = 1, 2  # fixed values: kinds of models


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class PieceTable:
    """The pieces of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = UNIGRAM
    source: bytes = b""
    match: dict[str, tuple[int, float]] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=lambda: [-1] * 256)
    unknown: int = 0

    @classmethod
    def load(cls, path: str) -> PieceTable:
        texts, scores, kinds, kind = [], [], [], UNIGRAM
        with open(path, "rb") as f:
            source = f.read()
        for number, value in _fields(source):
            if number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 1:
                own = dict(_fields(value))
                texts.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, NORMAL))
        if kind not in (UNIGRAM, MERGES):
            raise ValueError("neither a unigram nor a merge model")
        return cls(texts, scores, kinds, kind, source)

    def __post_init__(self) -> None:
        for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)):
            if k in (NORMAL, USER):
                self.match[p] = (i, s)
            elif k == BYTE:
                self.bytes_[int(p[3:5], 16)] = i
            elif k == 2:
                self.unknown = i
        if any(MARK in p.lstrip(MARK) or not set("\t\n").isdisjoint(p) for p in self.match):
            raise ValueError("a piece spans two words")
        self.longest = max(map(len, self.match), default=1)
        self.least = min((s for _, s in self.match.values()), default=0.0) - PENALTY
        self.has_bytes = min(self.bytes_) >= 0

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode()] if self.has_bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the pair with the best score, the first of equals, until none is left."""
        parts, match = list(text), self.match
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                hit = match.get(parts[i] + parts[i + 1])
                if hit and (best is None or hit[1] > best):
                    best, where = hit[1], i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when merged by themselves."""
        a, b = self.pieces[left], self.pieces[right]
        return self.merged(a + b) == [a, b]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words (with spaces), each a word of the lattice."""
        if self.kind == UNIGRAM:
            return [self.viterbi(w.replace(" ", MARK)) for w in words]
        if not hasattr(self, "_library"):
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.source)
        # The library puts a space in front.  A word that has none begins with a line end, which no piece joins to a space.
        given = [w[1:] if w.startswith(" ") else w for w in words]
        found = self._library.encode(given, num_threads=1) if given else []
        return [f if w.startswith(" ") else f[1:] for w, f in zip(words, found)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_library"}

    def viterbi(self, word: str) -> list[int]:
        """Best path of one word, marks in place of spaces."""
        n, match, longest = len(word), self.match, self.longest
        best, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            single, base = False, best[s]
            for e in range(s + 1, min(n, s + longest) + 1):
                hit = match.get(word[s:e])
                if hit:
                    single |= e == s + 1
                    if base + hit[1] > best[e]:
                        best[e], back[e] = base + hit[1], (s, hit[0])
            if not single and base + self.least > best[s + 1]:
                best[s + 1], back[s + 1] = base + self.least, (s, -1)
        out: list[list[int]] = []
        while n:
            s, i = back[n]
            out.append([i] if i >= 0 else self.fallback(word[s:n]))
            n = s
        return [i for part in reversed(out) for i in part]

    def decode_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces, and where each begins."""
        raw = [
            bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k in (NORMAL, USER) else b" \xe2\x81\x87 " if k == 2 else b""
            for p, k in zip(self.pieces, self.kinds)
        ]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids) for a table of distinct words, with marks in place of spaces."""
    spark = words.sparkSession
    rows = [(p, i, s) for p, (i, s) in table.match.items()]
    known = F.broadcast(spark.createDataFrame(rows, "piece string, id int, score double"))
    n = F.char_length("word")
    starts = words.select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "n", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("n"), F.col("s") + table.longest))).alias("e"))
    spans = spans.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")))
    edges = spans.join(known, "piece", "left").where("id is not null or e = s + 1")
    if table.has_bytes:
        codes = F.array(*[F.lit(i) for i in table.bytes_])
        hexed = F.hex(F.encode("piece", "UTF-8"))
        spelled = F.transform(
            F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda k: F.get(codes, F.conv(F.substring(hexed, k * 2 + 1, 2), 16, 10).cast("int"))
        )
    else:
        spelled = F.array(F.lit(table.unknown))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(spelled)
    edge = F.struct("s", "e", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(table.least)).alias("score"), ids.alias("ids"))
    grouped = edges.groupBy("word", "n").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return _best_sum(grouped) if table.kind == UNIGRAM else _merge_path(grouped, table)


def _fold(grouped: DataFrame, origin: Column, nowhere: Column, step) -> DataFrame:
    start = F.concat(F.array(origin), F.array_repeat(nowhere, F.col("n")))
    return grouped.select("word", F.aggregate("edges", start, step, lambda best: F.element_at(best, -1)["ids"]).alias("ids"))


_NONE = "cast(array() as array<int>)"


def _best_sum(grouped: DataFrame) -> DataFrame:
    """The path with the greatest sum of scores."""
    state = lambda score: F.struct(F.lit(score).alias("score"), F.expr(_NONE).alias("ids"))

    def step(best: Column, x: Column) -> Column:
        score = F.get(best, x["s"])["score"] + x["score"]
        reached = F.struct(score.alias("score"), F.concat(F.get(best, x["s"])["ids"], x["ids"]).alias("ids"))
        return F.transform(best, lambda old, at: F.when((at == x["e"]) & (score > old["score"]), reached).otherwise(old))

    return _fold(grouped, state(0.0), state(float("-inf")), step)


def _merge_path(grouped: DataFrame, table: PieceTable) -> DataFrame:
    """The path on which all neighbours stay apart."""
    before = F.transform(
        "edges", lambda b: F.transform(F.filter("edges", lambda a: (a["e"] == b["s"]) & (a["id"] >= 0) & (b["id"] >= 0)), lambda a: a["id"])
    )
    edges = grouped.select("word", "n", F.posexplode(F.arrays_zip("edges", before.alias("before"))).alias("at", "x"))
    edges = edges.select("word", "n", "at", F.col("x.edges").alias("edge"), F.explode_outer("x.before").alias("a"))
    shared = grouped.sparkSession.sparkContext.broadcast(table)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [shared.value.apart(x, y) for x, y in zip(a, b)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = edges.where("a is not null").select("a", F.col("edge.id").alias("b")).distinct()
    pairs = materialize(pairs.mapInArrow(judge, "a int, b int"), "pairs")
    fits = edges.join(F.broadcast(pairs), (edges.a == pairs.a) & (edges.edge.id == pairs.b), "left").select("word", "n", "at", "edge", pairs.a.alias("a"))
    fits = fits.groupBy("word", "n", "at").agg(F.first("edge").alias("edge"), F.collect_set("a").alias("after"))
    again = fits.groupBy("word", "n").agg(
        F.array_sort(F.collect_list(F.struct("edge.s", "edge.e", "edge.id", "edge.ids", "after"))).alias("edges")
    )
    state = lambda last: F.struct(F.lit(last).alias("last"), F.expr(_NONE).alias("ids"))

    def step(best: Column, x: Column) -> Column:
        here = F.get(best, x["s"])
        # -1: a character without a piece, or the word's begin, which merge with nothing; -2: not reached.
        fit = (here["last"] == -1) | ((here["last"] >= 0) & ((x["id"] == -1) | F.array_contains(x["after"], here["last"])))
        reached = F.struct(x["id"].alias("last"), F.concat(here["ids"], x["ids"]).alias("ids"))
        return F.transform(best, lambda old, at: F.when((at == x["e"]) & (old["last"] == -2) & fit, reached).otherwise(old))

    return _fold(again, state(-1), state(-2), step)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each row that has text, starts, ends, first word of each row)."""
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 0x20)
    offsets = offsets + np.concatenate(([0], np.cumsum(full)))
    blank = data == 0x20
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][full]] = True
    begins |= (data == 0x09) | (data == 0x0A)  # no piece has them, so a word may begin there
    start = np.flatnonzero(begins)
    return data, start, np.append(start[1:], len(data)), np.searchsorted(start, offsets)


def vocabulary(docs: DataFrame, text_col: str = "text", most: int = VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """(word, n) of the most frequent words: all words down to the least count that keeps them within ``most``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 0):
                data, start, end, _ = _spans(*buffer_of(piece.column(0)))
                short = end - start <= 4 * longest
                start, end = start[short], end[short]
                _, at, n = np.unique(span_hashes(data)(start, end), return_index=True, return_counts=True)
                view = memoryview(data)
                words = [bytes(view[a:b]).decode().replace(" ", MARK) for a, b in zip(start[at].tolist(), end[at].tolist())]
                yield pa.record_batch([pa.array(words, pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    words = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.char_length("word") <= longest)
    words = materialize(words.where("n > 1"), "words")
    level = words.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in level:
        total += row["k"]
        if total > most:
            break
        least = row["level"]
    return words.where(F.floor(F.log2("n") * 8) >= F.lit(least)) if least is not None else words.limit(0)


@dataclass
class Dictionary:
    """Pieces of encoded words, by 64-bit hash of the word."""

    keys: np.ndarray
    start: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def collect(cls, encoded: DataFrame) -> Dictionary:
        table = encoded.toArrow()
        words = [w.replace(MARK, " ").encode() for w in table.column("word").to_pylist()]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in words], np.int64)
        keys = span_hashes(np.frombuffer(b"".join(words), np.uint8))(starts, ends) if words else np.zeros(0, np.uint64)
        lists = table.column("ids").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if words else np.zeros(0, np.int64)
        order = np.argsort(keys)
        return cls(keys[order], (np.cumsum(size) - size)[order], size[order], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))


def _encode(text: pa.Array, known: Dictionary, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows end to end, first id of each row)."""
    data, start, end, first = _spans(*buffer_of(text))
    keys = span_hashes(data)(start, end)
    at = np.searchsorted(known.keys, keys)
    hit = at < len(known.keys)
    hit[hit] = known.keys[at[hit]] == keys[hit]
    begin, size, pool = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [known.ids]
    begin[hit], size[hit] = known.start[at[hit]], known.size[at[hit]]
    rest = np.flatnonzero(~hit)
    _, where, back = np.unique(keys[rest], return_index=True, return_inverse=True)
    view = memoryview(data)
    other = table.encode_words([bytes(view[a:b]).decode() for a, b in zip(start[rest[where]].tolist(), end[rest[where]].tolist())])
    sizes = np.array([len(x) for x in other], np.int64)
    begin[rest], size[rest] = (np.cumsum(sizes) - sizes + len(known.ids))[back], sizes[back]
    pool.append(np.array([i for x in other for i in x], np.int32))
    pool_ids = np.concatenate(pool)
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)
    return pool_ids[place], total[first]


def _decode(ids: np.ndarray, first: np.ndarray, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows end to end, first byte of each row), with the space in front of each."""
    size = (begin[1:] - begin[:-1])[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(total[-1]) - np.repeat(total[:-1] - begin[ids], size)
    return raw[place], total[first]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", ids: bool = True, check: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 (of 32-bit little-endian ids), and on demand ids and round_trip."""
    table = PieceTable.load(model)
    words = vocabulary(docs, text_col)
    known = docs.sparkSession.sparkContext.broadcast((Dictionary.collect(lattice(words.select("word"), table)), table))
    slim = docs.select(*keep, F.col(text_col).alias("_text"))
    width = len(keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, own = known.value
        raw, begin = own.decode_table()
        for batch in batches:
            for piece in pieces(batch, width, PART):
                flat, first = _encode(piece.column(width), dictionary, own)
                view = memoryview(np.ascontiguousarray(flat.astype("<i4")).view(np.uint8))
                at = first.tolist()
                digests = [hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
                out = [piece.column(i) for i in range(width)] + [pa.array(np.diff(first).astype(np.int64)), pa.array(digests)]
                names = [*keep, "n_tokens", "ids_sha256"]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat)))
                    names.append("ids")
                if check:
                    text, edge = _decode(flat, first, raw, begin)
                    data, offsets = buffer_of(piece.column(width))
                    same = []
                    for a, b, c, d in zip(edge[:-1].tolist(), edge[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                        same.append(max(0, b - a - 1) == d - c and text[a + 1 : b].tobytes() == data[c:d].tobytes())
                    out.append(pa.array(same, pa.bool_()))
                    names.append("round_trip")
                yield pa.record_batch(out, names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:width])
    schema += ", n_tokens long, ids_sha256 string" + ", ids array<int>" * ids + ", round_trip boolean" * check
    return slim.mapInArrow(kernel, schema)


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text, from ids; null ids give null text."""
    table = PieceTable.load(model)
    slim = encoded.select(*keep, "ids")
    width = len(keep)
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, begin = shared.value.decode_table()
        for batch in batches:
            lists = batch.column(width)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
            text, edge = _decode(flat, np.concatenate(([0], np.cumsum(size))).astype(np.int64), raw, begin)
            rows = [text[min(a + 1, b) : b].tobytes().decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            rows = [r if v else None for r, v in zip(rows, lists.is_valid().to_pylist())]
            yield pa.record_batch([batch.column(i) for i in range(width)] + [pa.array(rows, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:width])
    return slim.mapInArrow(kernel, schema + ", text string")
