"""Scalar functions as column expressions, and the fixed vocabularies they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stage and event vocabularies, codes, bins and limits.
STAGE_WORDS = {
    "w": "W", "wake": "W", "wakefulness": "W", "sleepstagew": "W", "stagew": "W",
    "n1": "N1", "nrem1": "N1", "stage1": "N1", "sleepstagen1": "N1", "stagen1": "N1", "s1": "N1", "sleepstage1": "N1",
    "n2": "N2", "nrem2": "N2", "stage2": "N2", "sleepstagen2": "N2", "stagen2": "N2", "s2": "N2", "sleepstage2": "N2",
    "n3": "N3", "nrem3": "N3", "stage3": "N3", "stage4": "N3", "sleepstagen3": "N3", "stagen3": "N3", "s3": "N3", "s4": "N3", "sws": "N3",
    "sleepstage3": "N3", "sleepstage4": "N3",
    "rem": "REM", "r": "REM", "stager": "REM", "sleepstagerem": "REM", "stagerem": "REM", "rapideyemovement": "REM",
}
STAGE_IGNORED = (
    "", "unknown", "unavailable", "notavailable", "notscored", "unscored", "movement", "artifact", "artefact", "sleepstage?",
    "sleepstageunknown", "stageunknown", "sleepstage9", "stage9",
)
STAGE_CODES = {1: "N3", 2: "N2", 3: "N1", 4: "REM", 5: "W"}
DEPTH = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 2, "Unknown": 0}
EVENT_WORDS = {
    "arousal": ("arousal", "arsl", "ar "),
    "central_apnea": ("central apnea", "central_apnea", "centralapnea", "ca ", "central ap", "csa"),
    "obstructive_apnea": ("obstructive apnea", "obstructive_apnea", "obstructiveapnea", "oa ", "obst ap", "osa"),
    "mixed_apnea": ("mixed apnea", "mixed_apnea", "mixedapnea", "ma "),
    "hypopnea": ("hypopnea", "hyp ", "hypop", "hypo"),
}
UNAVAILABLE = ("unknown", "unavailable", "declined", "unreported", "nan", "none", "not specified", "prefer not to say")
NOT_HISPANIC = ("not hispanic", "non-hispanic", "non hispanic", "not latino", "non-latino")
RESP_CODES = {
    1: "obstructive_apnea", 2: "central_apnea", 3: "mixed_apnea", 4: "hypopnea", 5: "hypopnea", 6: "hypopnea", 7: "rera", 8: "obstructive_apnea", 9: "hypopnea",
}
AGE_EDGES = (0, 50, 60, 70, 80, 120)
BMI_EDGES = (0, 18.5, 25, 30, 35, 100)
CONFIDENCE_EDGES = (0, 0.3, 0.45, 0.55, 0.7, 1)
AHI_LIMITS, AROUSAL_LIMITS = (5, 15, 30), (10, 25, 50)
NO, YES = ("0", "false", "f", "no", "n"), ("1", "true", "t", "yes", "y")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_channel(c: Column) -> Column:
    return F.trim(F.replace(F.replace(F.replace(F.lower(c), F.lit("_pds"), F.lit("")), F.lit("_eg"), F.lit("")), F.lit(":"), F.lit("-")))


def strip_marks(c: Column) -> Column:
    return F.translate(c, "\"'()[]{} \t", "")


def to_number(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def is_number(c: Column | str) -> Column:
    return to_number(c).isNotNull()


def is_integer(c: Column | str) -> Column:
    return F.coalesce(to_number(c) == F.floor(to_number(c)), F.lit(False))


def is_finite(c: Column | str) -> Column:
    n = to_number(c)
    return n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))


def is_boolean(c: Column | str) -> Column:
    return F.coalesce(F.lower(_col(c)).isin(*NO, *YES), F.lit(False))


def to_flag(c: Column | str) -> Column:
    low = F.lower(_col(c))
    return F.when(low.isin(*NO), 0).when(low.isin(*YES), 1)


def null_if_nan(c: Column) -> Column:
    """NaN and infinities as null: the missing-value rule on entry."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def session_id(c: Column) -> Column:
    """1, 1.0, "1" and "ses-1" are the session "1"; other text stays."""
    bare = F.trim(F.regexp_replace(F.trim(c), "(?i)^ses-", ""))
    number = bare.try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(bare)


def patient_key(site: Column, patient: Column, session: Column) -> Column:
    return F.concat(site, F.lit("/sub-"), site, patient, F.lit("_ses-"), session)


def parse_key(c: str) -> dict[str, Column]:
    return {
        "site": F.split_part(F.col(c), F.lit("/"), F.lit(1)),
        "id": F.regexp_extract(c, "sub-(.{5})(.*)_ses-", 2),
        "site5": F.substring(F.regexp_extract(c, "sub-([^_]*)", 1), 1, 5),
    }


def file_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(c, "/ ", "_-"), "[^A-Za-z0-9._-]", "_"))


def path_tokens(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")))


def _chain(pairs, otherwise=None) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def stage_of_text(c: Column, compat: bool = False) -> Column:
    """Stage named by a text: exact words first, then words contained in it, in order.

    ``compat`` also searches the one-letter words, by which any text with an r is REM.
    """
    k = F.regexp_replace(F.lower(c), "[ _-]", "")
    pairs = [(k.isNull() | k.isin(*STAGE_IGNORED), "Unknown")]
    pairs += [(k == str(n), v) for n, v in STAGE_CODES.items()]
    pairs += [(k == w, v) for w, v in STAGE_WORDS.items()]
    pairs += [(k.contains(w), v) for w, v in STAGE_WORDS.items() if len(w) >= (1 if compat else 2)]
    return _chain(pairs, "Unknown")


def stage_of_code(c: Column) -> Column:
    return _chain([(c == k, v) for k, v in STAGE_CODES.items()], "Unknown")


def depth_of_stage(c: Column) -> Column:
    return _chain([(c == k, v) for k, v in DEPTH.items()], 0)


def event_of_text(c: Column) -> Column:
    low = F.lower(c)
    return _chain([(low.contains(k), v) for v, words in EVENT_WORDS.items() for k in words])


def event_of_code(c: Column) -> Column:
    return _chain([(c == k, v) for k, v in RESP_CODES.items()])


def cut(c: str, edges, right: bool = False) -> Column:
    """Number of the bin [a, b), or (a, b] if ``right``; null outside."""
    x = F.col(c)
    inside = (lambda a, b: (x > a) & (x <= b)) if right else (lambda a, b: (x >= a) & (x < b))
    return _chain([(inside(a, b), i) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def severity(c: str, limits) -> Column:
    x = F.col(c)
    return F.when(x < limits[0], "normal").when(x < limits[1], "mild").when(x < limits[2], "moderate").otherwise("severe")


def one_hot(c: str, values, prefix: str) -> list[Column]:
    return [(F.col(c) == v).cast("int").alias(prefix + v.lower()) for v in values]


def category_codes(df: DataFrame, c: str, out: str) -> DataFrame:
    """Codes 0, 1, ... of the sorted distinct values, fitted once on the frame; the table of values is small by nature."""
    values = df.select(c).distinct().withColumn(out, F.row_number().over(Window.orderBy(c)) - 1)
    return df.join(values, c)


def sex(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.startswith("f"), "Female").when(low.startswith("m"), "Male").otherwise("Unknown")


def _any(c: Column, words) -> Column:
    return F.greatest(*[c.contains(w) for w in words])


def race(c: Column, compat: bool = True) -> Column:
    """``compat``: anything that is not one of the three groups is unavailable, as the empty word is in every text."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.when(_any(low, ("white", "caucasian")), "White").when(_any(low, ("black", "african american")), "Black").when(low.contains("asian"), "Asian")
    if compat:
        return named.otherwise("Unavailable")
    return named.when((low == "") | _any(low, UNAVAILABLE), "Unavailable").otherwise("Others")


def ethnicity(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(_any(low, NOT_HISPANIC), "Not Hispanic").when(_any(low, ("hispanic", "latino")), "Hispanic").otherwise("Unavailable")


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def log_power(c: Column) -> Column:
    return F.log10(c + F.lit(1e-10))


def prior_shift(p: Column, source: Column, target: Column) -> Column:
    """Probability under another prevalence: the odds times the ratio of the prior odds."""
    p, source, target = clip(p, 1e-7, 1 - 1e-7), clip(source, 1e-7, 1 - 1e-7), clip(target, 1e-7, 1 - 1e-7)
    odds = p / (1 - p) * (target / (1 - target)) / (source / (1 - source))
    return odds / (1 + odds)


def mixed_date(c: Column) -> Column:
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def micros_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def year_window(a: Column, b: Column, low: int, high: int) -> Column:
    """Whether b is from low to high years of 365.25 days after a, to the microsecond."""
    year = 365.25 * 86400 * 1_000_000
    return micros_between(a, b).between(low * year, high * year)


def sample_weights(df: DataFrame, label: str, age: str) -> DataFrame:
    """Balanced class weight times sqrt(largest decade / own decade), divided by the mean."""
    bins = df.withColumn("_bin", F.floor(F.col(age) / 10))
    counts = bins.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_most", F.max("_n").over(Window.partitionBy()))
    classes = bins.groupBy(label).agg(F.count(F.lit(1)).alias("_k")).withColumn("_all", F.sum("_k").over(Window.partitionBy()))
    rows = bins.join(F.broadcast(counts), "_bin").join(F.broadcast(classes), label)
    rows = rows.withColumn("_w", F.col("_all") / (2.0 * F.col("_k")) * F.sqrt(F.col("_most") / F.col("_n")))
    mean = rows.agg(F.avg("_w").alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_mean")).select(*df.columns, "weight")
