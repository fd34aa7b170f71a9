"""Stateful scans over one recording: sleep cycles, and sequences of phases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CYCLE_SCHEMA = "cycle int, start_idx long, end_idx long, nrem_end_idx long, rem_start_idx long, rem_end_idx long, nrem_min double, rem_min double"


def find_cycles(stages: list[str], minutes: float, least_nrem: float = 15.0) -> list[tuple]:
    """Cycles of a night: a NREM block that bears up to 2 wake segments, then REM that begins within 9 segments.

    Wake at the end of the block, up to 2 segments, belongs to it.  REM ends at the last
    REM before NREM or 3 wake segments in a row.  A block under ``least_nrem`` minutes is
    no cycle.
    """
    kind = ["N" if s in ("N1", "N2", "N3") else "R" if s == "REM" else "W" for s in stages]
    n, at, out = len(kind), 0, []
    while (start := next((j for j in range(at, n) if kind[j] == "N"), None)) is not None:
        end, awake = start, 0
        for j in range(start, n):
            awake = awake + 1 if kind[j] == "W" else 0
            if kind[j] == "R" or awake > 2:
                break
            end = j
        first = last = None
        for j in range(end + 1, min(end + 10, n)):
            if kind[j] == "R":
                first, last = (j if first is None else first), j
            elif first is not None and (kind[j] == "N" or kind[j : j + 3] == ["W"] * 3):
                break
        length = (end - start + 1) * minutes
        if length < least_nrem:
            at = end + 1
            continue
        stop = end if last is None else last
        out.append((len(out) + 1, start, stop, end, first, last, length, 0.0 if last is None else (last - first + 1) * minutes))
        at = stop + 1
    return out


def sleep_cycles(segments: DataFrame, key: str, order: str, stage: str, minutes: float) -> DataFrame:
    """One row for each cycle of each recording; a recording's segments, which a night bounds, are scanned in one piece."""
    kind = segments.schema[key].dataType.simpleString()

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        found = find_cycles(rows.sort_values(order)[stage].tolist(), minutes)
        out = pd.DataFrame(found, columns=[c.split()[0] for c in CYCLE_SCHEMA.split(", ")]).astype({"rem_start_idx": "Int64", "rem_end_idx": "Int64"})
        out.insert(0, key, rows[key].iloc[0])
        return out

    return segments.select(key, order, stage).groupBy(key).applyInPandas(scan, f"{key} {kind}, {CYCLE_SCHEMA}")


def sequences(phases: DataFrame, key: str, start: str, end: str, gap: float, guard: Column, least: int, longest: float, length: Column | None = None) -> DataFrame:
    """Runs of phases no longer than ``longest``, each within ``gap`` of the one before, that no guard row separates.

    ``guard`` marks rows of ``phases`` that are no phases but break a run; one at the very
    start and end of a phase comes before it.  At least ``least`` phases make a sequence.
    ``length`` is a phase's known length; without one it is end less start, which rounding
    can put past ``longest``.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    length = F.col(end) - F.col(start) if length is None else length
    rows = phases.withColumn("_guard", guard).where(F.col("_guard") | (length <= longest))
    rows = rows.withColumn("_breaks", F.sum(F.col("_guard").cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0))).where("not _guard")
    previous, broken = F.lag(end).over(w), F.lag("_breaks").over(w)
    new = previous.isNull() | (F.col(start) - previous > gap) | (broken != F.col("_breaks"))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "_seq").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least).drop("_seq")
