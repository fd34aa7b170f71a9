"""Interval, as-of, nearest-event and band joins, and the segment grid they work on.

Every join is an equi-join on (key, bucket of the time or value axis) with the exact
condition on top, so Spark shuffles by key and bucket, and a key with most of the rows is
spread over its buckets.  A pair that shares several buckets is produced in one of them
only, the later of the two first buckets, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_grid(records: DataFrame, key: str, total: str, length: float, overlap: float = 0.0, drop_short: bool = True) -> DataFrame:
    """(key, segment_idx, start_sec, end_sec, duration_sec, is_complete), segments of ``length`` every ``length - overlap``.

    ``drop_short``: a last segment shorter than half the length is dropped unless it is
    the first.  Without it every started segment is kept.
    """
    step = length - overlap
    if step <= 0:
        raise ValueError("overlap must be less than length")
    n = F.ceil(F.col(total) / F.lit(step)).cast("int")
    grid = records.where(F.col(total) > 0).select(key, F.col(total).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("segment_idx"))
    grid = grid.withColumn("start_sec", F.col("segment_idx") * F.lit(float(step)))
    grid = grid.withColumn("end_sec", F.least(F.col("start_sec") + F.lit(float(length)), "_t")).withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
    if drop_short:
        grid = grid.where((F.col("duration_sec") >= 0.5 * length) | (F.col("segment_idx") == 0))
    return grid.withColumn("is_complete", F.col("duration_sec") >= 0.99 * length).drop("_t")


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def interval_join(
    left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: float, touching: bool = False
) -> DataFrame:
    """Pairs with left.start < right.end and left.end > right.start (<= and >= if ``touching``).

    Columns of both sides; the right side's key is dropped.  ``width`` is the bucket
    length; a typical interval's length is a good choice.
    """
    a, b = left.alias("a"), right.alias("b")
    ls, le, rs, re = (F.col(f"a.{left_span[0]}"), F.col(f"a.{left_span[1]}"), F.col(f"b.{right_span[0]}"), F.col(f"b.{right_span[1]}"))
    a = a.select("a.*", F.explode(_buckets(ls, le, width)).alias("_bucket")).alias("a")
    b = b.select("b.*", F.explode(_buckets(rs, re, width)).alias("_bucket")).alias("b")
    meets = ((ls <= re) & (le >= rs)) if touching else ((ls < re) & (le > rs))
    once = F.col("a._bucket") == F.greatest(F.floor(ls / width), F.floor(rs / width))
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._bucket") == F.col("b._bucket"))
    return a.join(b, same & meets & once).select(
        *[F.col(f"a.{c}") for c in left.columns], *[F.col(f"b.{c}") for c in right.columns if c != key]
    )


def overlap_seconds(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def stage_fractions(segments: DataFrame, epochs: DataFrame, key: str, stages: list[str], width: float) -> DataFrame:
    """Per segment: seconds-weighted share of each stage, dominant stage, its stability and the number of transitions.

    The dominant stage has most overlap; ties go to the stage whose first epoch is first.
    Without any overlap: Unknown, stability 0, unknown share 1.
    """
    pairs = interval_join(segments, epochs.select(key, F.col("start_sec").alias("e_start"), F.col("end_sec").alias("e_end"), "stage"), key, ("start_sec", "end_sec"), ("e_start", "e_end"), width)
    pairs = pairs.withColumn("sec", overlap_seconds("start_sec", "end_sec", "e_start", "e_end"))
    order = Window.partitionBy(key, "segment_idx").orderBy("e_start", "e_end", "stage")
    pairs = pairs.withColumn("_change", (F.col("stage") != F.lag("stage").over(order)).cast("int"))
    per_stage = pairs.groupBy(key, "segment_idx", "stage").agg(F.sum("sec").alias("sec"), F.min("e_start").alias("first"), F.sum(F.coalesce("_change", F.lit(0))).alias("changes"))
    share = [F.sum(F.when(F.col("stage") == s, F.col("sec")).otherwise(0.0)).alias(f"_{s}") for s in stages]
    per_segment = per_stage.groupBy(key, "segment_idx").agg(
        *share,
        F.sum("sec").alias("_total"),
        F.max(F.struct("sec", (-F.col("first")).alias("first"), "stage")).alias("_best"),
        F.sum("changes").alias("_changes"),
    )
    out = segments.join(per_segment, [key, "segment_idx"], "left")
    return out.select(
        key,
        "segment_idx",
        *[(F.coalesce(F.col(f"_{s}"), F.lit(0.0)) / F.col("duration_sec")).alias(f"frac_{s.lower()}") for s in stages],
        F.greatest(F.lit(0.0), 1 - F.coalesce("_total", F.lit(0.0)) / F.col("duration_sec")).alias("frac_unknown"),
        F.coalesce("_best.stage", F.lit("Unknown")).alias("dominant_stage"),
        F.coalesce(F.col("_best.sec") / F.col("_total"), F.lit(0.0)).alias("stability"),
        F.coalesce("_changes", F.lit(0)).cast("long").alias("transitions"),
    )


def event_measures(segments: DataFrame, events: DataFrame, key: str, types: list[str], width: float) -> DataFrame:
    """Per segment and event type: count, clipped seconds, presence and events a minute, as columns."""
    pairs = interval_join(segments, events.select(key, F.col("start_sec").alias("e_start"), F.col("end_sec").alias("e_end"), "event_type"), key, ("start_sec", "end_sec"), ("e_start", "e_end"), width)
    pairs = pairs.withColumn("sec", overlap_seconds("start_sec", "end_sec", "e_start", "e_end"))
    aggs = []
    for t in types:
        own = F.col("event_type") == t
        aggs += [F.count_if(own).alias(f"{t}_count"), F.sum(F.when(own, F.col("sec"))).alias(f"{t}_sec")]
    found = pairs.groupBy(key, "segment_idx").agg(*aggs)
    out = segments.join(found, [key, "segment_idx"], "left")
    columns = []
    for t in types:
        n = F.coalesce(f"{t}_count", F.lit(0)).cast("long")
        columns += [
            n.alias(f"{t}_count"),
            F.coalesce(f"{t}_sec", F.lit(0.0)).alias(f"{t}_duration"),
            (n > 0).cast("int").alias(f"{t}_present"),
            (n / (F.col("duration_sec") / 60.0)).alias(f"{t}_density"),
        ]
    return out.select(key, "segment_idx", *columns)


def _nearest_point(left: DataFrame, points: DataFrame, key: str, at: str, value: Column, out: str, width: float, forward: bool) -> DataFrame:
    """``left`` with ``out``: value of the point nearest to ``at``, behind it (or at it) or, if ``forward``, ahead.

    ``points`` has the key and _t; ``value`` is of these, and of points at one time behind it the
    greatest counts.  Time is cut into buckets of ``width``.  The scan is over the rows of a
    bucket, and what reaches beyond comes from the buckets, of which a key has few.
    """
    a = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"))
    b = points.select(key, "_t", F.lit(0).alias("_side"), F.struct("_t", value.alias("v")).alias("_e"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_t") / width))
    w = Window.partitionBy(key, "_bucket")
    if forward:  # equal times count, so points come before the rows that look ahead only from their far side
        near = F.first("_e", ignorenulls=True).over(w.orderBy("_t", F.desc("_side"), F.desc("_e")).rowsBetween(0, Window.unboundedFollowing))
        pick, beyond = F.min("_e"), Window.partitionBy(key).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
        far = F.first("_p", ignorenulls=True).over(beyond)
    else:
        near = F.last("_e", ignorenulls=True).over(w.orderBy("_t", "_side", "_e").rowsBetween(Window.unboundedPreceding, 0))
        pick, beyond = F.max("_e"), Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        far = F.last("_p", ignorenulls=True).over(beyond)
    per = both.groupBy(key, "_bucket").agg(pick.alias("_p")).select(key, "_bucket", far.alias("_far"))
    found = both.withColumn("_near", near).where("_side = 1").join(per, [key, "_bucket"])
    return found.withColumn(out, F.coalesce("_near", "_far")["v"]).select(*left.columns, out)


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, out: str, clip: bool = True, width: float = 86_400.0) -> DataFrame:
    """For each left row the value of the last right row at or before it; equal times: the greatest value.

    With ``clip`` rows before the first right row of their key have that row's value, else null.
    ``width`` is the length of the buckets that the scan is cut into.
    """
    found = _nearest_point(left, right.select(key, F.col(right_time).alias("_t"), value), key, left_time, F.col(value), out, width, forward=False)
    if not clip:
        return found
    first = right.groupBy(key).agg(F.max(F.struct((-F.col(right_time)).alias("t"), F.col(value).alias("v")))["v"].alias("_first"))
    return found.join(first, key, "left").withColumn(out, F.coalesce(out, "_first")).drop("_first")


def nearest_events(segments: DataFrame, events: DataFrame, key: str, cap: float, touching: DataFrame, width: float = 86_400.0) -> DataFrame:
    """(key, segment_idx, next_dist, prev_dist): seconds from the end to the next start and from the start back to the last end.

    Without such an event the distance is 0 if an event overlaps the segment
    (``touching`` has its key and index) and ``cap`` if none does; at most ``cap``.
    """
    seg = segments.select(key, "segment_idx", "start_sec", "end_sec")
    ahead = _nearest_point(seg, events.select(key, F.col("start_sec").alias("_t")), key, "end_sec", F.col("_t"), "_next", width, forward=True)
    both = _nearest_point(ahead, events.select(key, F.col("end_sec").alias("_t")), key, "start_sec", F.col("_t"), "_prev", width, forward=False)
    held = touching.select(key, "segment_idx").distinct().withColumn("_held", F.lit(True))
    none = F.when(F.col("_held"), 0.0).otherwise(float(cap))
    far = lambda c: F.least(F.coalesce(c, none), F.lit(float(cap)))
    out = both.join(held, [key, "segment_idx"], "left")
    return out.select(key, "segment_idx", far(F.col("_next") - F.col("end_sec")).alias("next_dist"), far(F.col("start_sec") - F.col("_prev")).alias("prev_dist"))


def band_counts(rows: DataFrame, at: str, gap: int, sums: dict[str, Column]) -> DataFrame:
    """Sums over all rows with |at_i - at| <= gap, for each distinct integer ``at``: pre-aggregated, then spread over the band."""
    per = rows.groupBy(at).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    spread = per.select(F.explode(F.sequence(F.col(at) - gap, F.col(at) + gap)).alias(at), *sums)
    near = spread.groupBy(at).agg(*[F.sum(n).alias(n) for n in sums])
    return per.select(at).join(near, at)
