"""EDF recordings as a Spark data source, and a writer for tests and exports.

spark.dataSource.register(EdfSource); spark.read.format("edf").load(folder) gives a row for each
channel: record, channel, fs, unit, n_samples, duration_sec, samples.  With option
mode=annotations it gives the time-stamped annotation lists of EDF+ files instead:
record, onset, duration, description.

Files are read by Spark's own binary reader (read_edf), which reaches every store that
Spark does; the data source form is for folders that the executors share.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNALS = "record string, channel string, fs double, unit string, n_samples long, duration_sec double, samples array<float>"
ANNOTATIONS = "record string, onset double, duration double, description string"
# Annotations without content, names of channels that hold annotations as numbers, and the codes of respiratory ones.
TRIVIAL = ("", "sleep onset", "recording start", "lights off", "lights on", "recording end")
STAGE_CHANNELS, AROUSAL_CHANNELS, OTHER_CHANNELS = ("stage", "sleep", "hypno"), ("arousal", "arsl"), ("resp", "limb")
CHANNEL_CODES = {
    1: "obstructive_apnea", 2: "central_apnea", 3: "mixed_apnea", 4: "obstructive_hypopnea", 5: "central_hypopnea", 6: "mixed_hypopnea", 7: "rera", 8: "apnea_unspecified", 9: "hypopnea_unspecified",
}


def _header(data: bytes) -> dict:
    n = int(data[252:256])
    at, columns = 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("size", 8), ("reserved", 32)):
        columns[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    return columns | {"n": n, "start": int(data[184:192]), "records": int(data[236:244]), "seconds": float(data[244:252])}


def parse_signals(data: bytes, record: str) -> Iterator[tuple]:
    """A row for each ordinary channel; a file that can't be parsed gives none."""
    try:
        h = _header(data)
        sizes = [int(x) for x in h["size"]]
        width = sum(sizes)
        raw = np.frombuffer(data, "<i2", offset=h["start"])
        records = len(raw) // width if h["records"] < 0 else min(h["records"], len(raw) // width)
        raw = raw[: records * width].reshape(records, width)
    except (ValueError, ZeroDivisionError):
        return
    at = 0
    for i, size in enumerate(sizes):
        if h["label"][i] != "EDF Annotations":
            low, high, dlow, dhigh = (float(h[k][i]) for k in ("pmin", "pmax", "dmin", "dmax"))
            scale = (high - low) / (dhigh - dlow) if dhigh != dlow else 1.0
            x = ((raw[:, at : at + size].reshape(-1) - dlow) * scale + low).astype(np.float32)
            fs = size / h["seconds"] if h["seconds"] else 0.0
            yield record, h["label"][i], fs, h["unit"][i], len(x), len(x) / fs if fs else 0.0, x.tolist()
        at += size


_TAL = re.compile(rb"([+-][0-9.]+)(?:\x15([0-9.]*))?\x14([^\x00]*?)\x14?\x00")


def parse_annotations(data: bytes, record: str) -> Iterator[tuple]:
    try:
        h = _header(data)
        sizes = [2 * int(x) for x in h["size"]]
    except ValueError:
        return
    width, at = sum(sizes), 0
    for i, size in enumerate(sizes):
        if h["label"][i] == "EDF Annotations":
            for base in range(h["start"], len(data) - width + 1, width):
                for onset, duration, texts in _TAL.findall(data[base + at : base + at + size]):
                    for text in texts.split(b"\x14"):
                        label = text.decode("utf-8", "replace").strip()
                        if label.lower() not in TRIVIAL:
                            yield record, float(onset), float(duration) if duration else None, label
        at += size


def record_name(path: str) -> str:
    """site/record from a path."""
    folder, name = os.path.split(path)
    return f"{os.path.basename(folder)}/{os.path.splitext(name)[0]}"


def read_edf(spark: SparkSession, path: str, annotations: bool = False) -> DataFrame:
    """Channels (or annotations) of all EDF files below a path, one task a file at least."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][dD][fF]").option("recursiveFileLookup", "true").load(path)
    parse, schema = (parse_annotations, ANNOTATIONS) if annotations else (parse_signals, SIGNALS)
    names = [c.strip().split()[0] for c in schema.split(", ")]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(parse(content, record_name(p))), columns=names)

    return files.select("path", "content").mapInPandas(kernel, schema)


def channel(recordings: DataFrame, name: str) -> DataFrame:
    return recordings.where(F.lower(F.trim("channel")) == name.lower())


def lookup(recordings: DataFrame, names: list[str]) -> DataFrame:
    """(record, name, fs, n_samples, unit, samples): a row for each record and name, null where the record has no such channel."""
    wanted = recordings.sparkSession.createDataFrame([(n, n.lower().strip()) for n in names], "name string, _key string")
    grid = recordings.select("record").distinct().join(F.broadcast(wanted))  # as many rows as names for each record
    have = recordings.select("record", F.lower(F.trim("channel")).alias("_key"), "fs", "n_samples", "unit", "samples")
    return grid.join(have, ["record", "_key"], "left").drop("_key")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, size_bytes) of every EDF file below a folder, in order of the record's name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][dD][fF]").option("recursiveFileLookup", "true").load(path)
    name = F.concat_ws("/", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return files.select("path", name.alias("record"), F.col("length").alias("size_bytes")).orderBy("record", "path")


def channel_annotations(recordings: DataFrame, epoch: float = 30.0, least: float = 1.0) -> DataFrame:
    """(record, onset, duration, description) from channels that hold annotations as numbers.

    Stage channels give a stage for each epoch, the most frequent rounded value (the least
    of equals) named; arousal and limb channels the spans over 0.5; respiratory channels the
    runs of a known code.  Spans shorter than ``least`` seconds are noise; probability
    channels are left out.
    """
    from nocturne.functions.scalar import stage_of_code
    from nocturne.operators.windows import runs

    label = F.lower(F.trim("channel"))
    has = lambda names: F.coalesce(*[F.when(F.contains(label, F.lit(n)), F.lit(True)) for n in names], F.lit(False))
    kind = F.when(F.contains(label, F.lit("prob")), None).when(has(STAGE_CHANNELS), "stage").when(has(AROUSAL_CHANNELS), "arousal").when(has(OTHER_CHANNELS[:1]), "resp").when(has(OTHER_CHANNELS[1:]), "limb_movement")
    rows = recordings.select("record", "channel", "fs", "samples", kind.alias("kind")).where("kind is not null and fs > 0")
    rows = rows.select("record", "channel", "fs", "kind", F.posexplode("samples").alias("pos", "v"))
    good = F.col("v").isNotNull() & ~F.isnan("v")
    n = F.floor(F.col("fs") * epoch).cast("int")
    total = F.max("pos").over(Window.partitionBy("record", "channel"))
    stage = rows.where("kind = 'stage'").withColumn("_all", total + 1).withColumn("e", F.floor(F.col("pos") / n).cast("int")).where((F.col("e") + 1) * n <= F.col("_all"))
    votes = stage.groupBy("record", "channel", "e", F.when(good, F.rint("v").cast("int")).alias("code")).agg(F.count(F.lit(1)).alias("k"))
    best = votes.groupBy("record", "channel", "e").agg(F.max(F.when(F.col("code").isNotNull(), F.struct("k", (-F.col("code")).alias("c")))).alias("b"))
    out = best.select("record", (F.col("e") * epoch).alias("onset"), F.lit(epoch).alias("duration"), F.coalesce(stage_of_code(-F.col("b.c")), F.lit("Unknown")).alias("description"))
    code = F.when(F.col("kind") == "resp", F.rint("v").cast("int")).otherwise((F.col("v") > 0.5).cast("int"))
    spans = rows.where("kind <> 'stage'").withColumn("code", F.coalesce(F.when(good, code), F.lit(0))).withColumn("id", F.concat_ws("|", "record", "channel"))
    spans = spans.withColumns({"a": F.col("pos") / F.col("fs"), "b": (F.col("pos") + 1) / F.col("fs")})
    names = spans.select("id", "record", "kind").distinct()
    found = runs(spans, "id", ["pos"], "code", "a", "b", least).where("code > 0").join(names, "id")
    word = F.when(F.col("kind") == "resp", F.coalesce(*[F.when(F.col("code") == k, F.lit(v)) for k, v in CHANNEL_CODES.items()])).otherwise(F.col("kind"))
    found = found.select("record", F.col("start").alias("onset"), (F.col("end") - F.col("start")).alias("duration"), word.alias("description")).where("description is not null")
    return out.unionByName(found)


def annotations_with_fallback(spark: SparkSession, path: str) -> DataFrame:
    """(record, onset, duration, description, how) of all files: time-stamped lists ("list"), and for records without one what their numeric channels hold ("channel")."""
    lists = read_edf(spark, path, annotations=True).withColumn("how", F.lit("list"))
    rest = read_edf(spark, path).join(lists.select("record").distinct(), "record", "left_anti")
    return lists.unionByName(channel_annotations(rest).withColumn("how", F.lit("channel")))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.annotations = options["path"], options.get("mode") == "annotations"

    def partitions(self) -> list[_File]:
        found = [os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.lower().endswith(".edf")]
        return [_File(p) for p in sorted([self.path] if os.path.isfile(self.path) else found)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        yield from (parse_annotations if self.annotations else parse_signals)(data, record_name(partition.path))


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return ANNOTATIONS if self.options.get("mode") == "annotations" else SIGNALS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def to_edf(channels: dict[str, tuple[float, np.ndarray]], annotations: list[tuple[float, float, str]] = (), unit: str = "uV") -> bytes:
    """An EDF+ file with one-second records."""
    names = [*channels, "EDF Annotations"] if annotations else list(channels)
    seconds = min(len(x) // int(fs) for fs, x in channels.values())
    text = 120
    tals = [b"" for _ in range(seconds)]
    for onset, duration, label in annotations:
        tals[min(int(onset), seconds - 1)] += f"+{onset:g}\x15{duration:g}\x14{label}\x14\x00".encode()
    sizes = [int(channels[c][0]) if c in channels else text for c in names]
    limits = {c: max(1e-6, float(np.abs(x).max())) for c, (_, x) in channels.items()}

    def fixed(values, width: int) -> bytes:
        return b"".join(str(v)[:width].ljust(width).encode("latin-1") for v in values)

    head = fixed(["0"], 8) + fixed(["X"], 80) + fixed(["X"], 80) + b"01.01.2400.00.00" + fixed([256 * (len(names) + 1)], 8) + fixed(["EDF+C"], 44) + fixed([seconds], 8) + fixed([1], 8) + fixed([len(names)], 4)
    head += fixed(names, 16) + fixed([""] * len(names), 80) + fixed([unit if c in channels else "" for c in names], 8)
    head += fixed([f"{-limits[c]:.6g}" if c in channels else -1 for c in names], 8) + fixed([f"{limits[c]:.6g}" if c in channels else 1 for c in names], 8)
    head += fixed([-32768] * len(names), 8) + fixed([32767] * len(names), 8) + fixed([""] * len(names), 80) + fixed(sizes, 8) + fixed([""] * len(names), 32)
    body = b""
    for s in range(seconds):
        for c, size in zip(names, sizes):
            if c in channels:
                low, high = -float(f"{limits[c]:.6g}"), float(f"{limits[c]:.6g}")
                x = channels[c][1][s * size : (s + 1) * size]
                body += np.clip(np.round((x - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2").tobytes()
            else:
                body += (f"+{s}\x14\x14\x00".encode() + tals[s]).ljust(2 * size, b"\x00")[: 2 * size]
    return head + body
