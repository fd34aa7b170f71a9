"""Queries on scalar functions: names, sanitation, vocabularies, keys, bins, priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from nocturne.functions import scalar as S
from nocturne.plans.base import SC, scored, t
from nocturne.plans.registry import query

r6 = lambda c: F.round(c, 6)


@query("clean_channel", "SELECT p_partkey, trim(replace(replace(replace(lower(' ' || p_name || '_EG:' || p_brand || '_pds '), '_pds', ''), '_eg', ''), ':', '-')) AS name FROM part")
def clean_channel(spark, sf):
    raw = F.concat(F.lit(" "), "p_name", F.lit("_EG:"), "p_brand", F.lit("_pds "))
    return t(spark, sf, "part").select("p_partkey", S.clean_channel(raw).alias("name"))


@query("strip_marks", "SELECT p_partkey, translate('(\"' || p_name || '\") [' || p_type || ']', '\"''()[]{} ' || chr(9), '') AS name FROM part")
def strip_marks(spark, sf):
    raw = F.concat(F.lit('("'), "p_name", F.lit('") ['), "p_type", F.lit("]"))
    return t(spark, sf, "part").select("p_partkey", S.strip_marks(raw).alias("name"))


RAW = "CASE o_orderkey % 12 WHEN 0 THEN 'yes' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN 'true' WHEN 5 THEN 'maybe' WHEN 6 THEN '12.5' WHEN 7 THEN 'n' WHEN 8 THEN '' WHEN 9 THEN 'T' WHEN 10 THEN '-3' END"


def raw_text():
    return F.expr(RAW)


@query(
    "sanitize",
    f"""WITH r AS (SELECT o_orderkey, {RAW} AS x FROM orders)
SELECT o_orderkey, CASE WHEN lower(x) IN ('0', 'false', 'f', 'no', 'n') THEN 0 WHEN lower(x) IN ('1', 'true', 't', 'yes', 'y') THEN 1 END AS flag,
  TRY_CAST(x AS DOUBLE) AS number, coalesce(TRY_CAST(x AS DOUBLE) IS NOT NULL, false) AS is_number,
  coalesce(TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)), false) AS is_integer,
  coalesce(lower(x) IN ('0', 'false', 'f', 'no', 'n', '1', 'true', 't', 'yes', 'y'), false) AS is_boolean FROM r""",
)
def sanitize(spark, sf):
    r = t(spark, sf, "orders").select("o_orderkey", raw_text().alias("x"))
    return r.select("o_orderkey", S.to_flag("x").alias("flag"), S.to_number("x").alias("number"), S.is_number("x").alias("is_number"), S.is_integer("x").alias("is_integer"), S.is_boolean("x").alias("is_boolean"))


SES = "CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN 'ses-1' WHEN 3 THEN 'SES-' || CAST(o_custkey AS VARCHAR) ELSE ' ses-02b ' END"


@query(
    "session_id",
    f"""WITH r AS (SELECT o_orderkey, trim(regexp_replace(trim({SES}), '^ses-', '', 'i')) AS x FROM orders)
SELECT o_orderkey, CASE WHEN TRY_CAST(x AS DOUBLE) = floor(TRY_CAST(x AS DOUBLE)) THEN CAST(CAST(TRY_CAST(x AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE x END AS session FROM r""",
)
def session_id(spark, sf):
    raw = F.expr(SES.replace("VARCHAR", "STRING"))
    return t(spark, sf, "orders").select("o_orderkey", S.session_id(raw).alias("session"))


@query(
    "patient_key",
    """WITH r AS (SELECT c_custkey, 'S000' || CAST(c_nationkey % 7 AS VARCHAR) AS site, CAST(c_custkey AS VARCHAR) AS id FROM customer), k AS (
  SELECT c_custkey, site || '/sub-' || site || id || '_ses-1' AS key FROM r)
SELECT c_custkey, key, split_part(key, '/', 1) AS site, regexp_extract(key, 'sub-(.{5})(.*)_ses-', 2) AS id, substr(regexp_extract(key, 'sub-([^_]*)', 1), 1, 5) AS site5 FROM k""",
)
def patient_key(spark, sf):
    site = F.concat(F.lit("S000"), (F.col("c_nationkey") % 7).cast("string"))
    r = t(spark, sf, "customer").select("c_custkey", S.patient_key(site, F.col("c_custkey").cast("string"), F.lit("1")).alias("key"))
    return r.select("c_custkey", "key", *[c.alias(n) for n, c in S.parse_key("key").items()])


@query(
    "cache_key",
    "SELECT p_partkey, lower(regexp_replace(replace(replace(p_brand || '/' || p_name, '/', '_'), ' ', '-'), '[^A-Za-z0-9._-]', '_', 'g')) AS file_name, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_brand || '/' || p_name), '[^a-z0-9]+'), lambda x: x <> ''))) AS tokens FROM part",
)
def cache_key(spark, sf):
    raw = F.concat("p_brand", F.lit("/"), "p_name")
    return t(spark, sf, "part").select("p_partkey", S.file_name(raw).alias("file_name"), S.path_tokens(raw).alias("tokens"))


STAGE_TEXT = "CASE o_orderkey % 11 WHEN 0 THEN 'Sleep stage N2' WHEN 1 THEN 'Sleep_stage_W' WHEN 2 THEN 'REM' WHEN 3 THEN 'stage 3' WHEN 4 THEN 'arousal' WHEN 5 THEN 'wake' WHEN 6 THEN 'Movement' WHEN 7 THEN 'N1' WHEN 8 THEN 'obstructive_apnea' WHEN 9 THEN '5' END"


def _stage_sql(strict: bool) -> str:
    exact = " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in S.STAGE_WORDS.items())
    exact = " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in S.STAGE_CODES.items()) + " " + exact
    part = " ".join(f"WHEN contains(k, '{k}') THEN '{v}'" for k, v in S.STAGE_WORDS.items() if len(k) >= (2 if strict else 1))
    ignored = ", ".join(f"'{i}'" for i in S.STAGE_IGNORED)
    return f"CASE WHEN k IS NULL OR k IN ({ignored}) THEN 'Unknown' {exact} {part} ELSE 'Unknown' END"


@query(
    "stage_text_map",
    f"""WITH r AS (SELECT o_orderkey, regexp_replace(lower({STAGE_TEXT}), '[ _-]', '', 'g') AS k FROM orders)
SELECT o_orderkey, {_stage_sql(True)} AS stage, {_stage_sql(False)} AS stage_compat FROM r""",
)
def stage_text_map(spark, sf):
    raw = F.expr(STAGE_TEXT)
    return t(spark, sf, "orders").select("o_orderkey", S.stage_of_text(raw).alias("stage"), S.stage_of_text(raw, compat=True).alias("stage_compat"))


@query(
    "stage_code_map",
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'N3' WHEN 2 THEN 'N2' WHEN 3 THEN 'N1' WHEN 4 THEN 'REM' WHEN 5 THEN 'W' ELSE 'Unknown' END AS stage, CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS depth FROM lineitem",
)
def stage_code_map(spark, sf):
    stage = S.stage_of_code(F.col("l_linenumber"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stage.alias("stage"), S.depth_of_stage(stage).alias("depth"))


EVENT_TEXT = "CASE o_orderkey % 10 WHEN 0 THEN 'Central Apnea' WHEN 1 THEN 'obstructive apnea' WHEN 2 THEN 'Hypopnea 4%' WHEN 3 THEN 'RERA arousal' WHEN 4 THEN 'mixed' WHEN 5 THEN 'PLM' WHEN 6 THEN 'artifact' WHEN 7 THEN 'arousal (spontaneous)' WHEN 8 THEN 'oxygen desaturation' END"


@query(
    "event_keyword_map",
    f"""WITH r AS (SELECT o_orderkey, lower({EVENT_TEXT}) AS k FROM orders)
SELECT o_orderkey, CASE {" ".join(f"WHEN contains(k, '{k}') THEN '{v}'" for v, ks in S.EVENT_WORDS.items() for k in ks)} END AS event_type FROM r""",
)
def event_keyword_map(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", S.event_of_text(F.expr(EVENT_TEXT)).alias("event_type"))


@query(
    "resp_code_map",
    "SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS INTEGER) % 11 WHEN 1 THEN 'obstructive_apnea' WHEN 2 THEN 'central_apnea' WHEN 3 THEN 'mixed_apnea' WHEN 4 THEN 'hypopnea' WHEN 5 THEN 'hypopnea' WHEN 6 THEN 'hypopnea' WHEN 7 THEN 'rera' WHEN 8 THEN 'obstructive_apnea' WHEN 9 THEN 'hypopnea' END AS event_type FROM lineitem",
)
def resp_code_map(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.event_of_code(F.col("l_quantity").cast("int") % 11).alias("event_type"))


@query(
    "bins_age_bmi",
    """WITH r AS (SELECT c_custkey, c_acctbal / 100 AS age, abs(c_acctbal) / 200 AS bmi FROM customer)
SELECT c_custkey, CASE WHEN age >= 0 AND age < 50 THEN 0 WHEN age >= 50 AND age < 60 THEN 1 WHEN age >= 60 AND age < 70 THEN 2 WHEN age >= 70 AND age < 80 THEN 3 WHEN age >= 80 AND age < 120 THEN 4 END AS age_bin,
  CASE WHEN bmi < 18.5 THEN 0 WHEN bmi < 25 THEN 1 WHEN bmi < 30 THEN 2 WHEN bmi < 35 THEN 3 WHEN bmi < 100 THEN 4 END AS bmi_bin FROM r""",
)
def bins_age_bmi(spark, sf):
    r = t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("age"), (F.abs("c_acctbal") / 200).alias("bmi"))
    return r.select("c_custkey", S.cut("age", S.AGE_EDGES).alias("age_bin"), S.cut("bmi", S.BMI_EDGES).alias("bmi_bin"))


@query("bins_confidence", f"WITH {SC} SELECT doc_id, CASE WHEN score > 0 AND score <= 0.3 THEN 0 WHEN score > 0.3 AND score <= 0.45 THEN 1 WHEN score > 0.45 AND score <= 0.55 THEN 2 WHEN score > 0.55 AND score <= 0.7 THEN 3 WHEN score > 0.7 AND score <= 1 THEN 4 END AS bin FROM sc")
def bins_confidence(spark, sf):
    return scored(spark, sf).select("doc_id", S.cut("score", S.CONFIDENCE_EDGES, right=True).alias("bin"))


@query(
    "severity_categories",
    """WITH r AS (SELECT s_suppkey, abs(s_acctbal) / 200 AS x FROM supplier)
SELECT s_suppkey, CASE WHEN x < 5 THEN 'normal' WHEN x < 15 THEN 'mild' WHEN x < 30 THEN 'moderate' ELSE 'severe' END AS ahi,
  CASE WHEN x < 10 THEN 'normal' WHEN x < 25 THEN 'mild' WHEN x < 50 THEN 'moderate' ELSE 'severe' END AS arousal FROM r""",
)
def severity_categories(spark, sf):
    r = t(spark, sf, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 200).alias("x"))
    return r.select("s_suppkey", S.severity("x", S.AHI_LIMITS).alias("ahi"), S.severity("x", S.AROUSAL_LIMITS).alias("arousal"))


@query("onehot", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{v}' AS INTEGER) AS seg_{v.lower()}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + ", CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def onehot(spark, sf):
    rows = t(spark, sf, "customer")
    values = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return S.category_codes(rows, "c_mktsegment", "code").select("c_custkey", *S.one_hot("c_mktsegment", values, "seg_"), "code")


@query("demographics_norm", """WITH r AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Female' WHEN 1 THEN 'male' WHEN 2 THEN 'F' WHEN 3 THEN 'm' WHEN 4 THEN '' END AS sex,
  CASE c_custkey % 7 WHEN 0 THEN 'Black or African American' WHEN 1 THEN 'White' WHEN 2 THEN 'Asian' WHEN 3 THEN 'Declined' WHEN 4 THEN 'other race' WHEN 5 THEN 'Unknown' END AS race,
  CASE c_custkey % 4 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic' WHEN 2 THEN '' END AS eth FROM customer)
SELECT c_custkey, CASE WHEN starts_with(lower(sex), 'f') THEN 'Female' WHEN starts_with(lower(sex), 'm') THEN 'Male' ELSE 'Unknown' END AS sex,
 CASE WHEN contains(lower(race), 'white') THEN 'White' WHEN contains(lower(race), 'black') THEN 'Black' WHEN contains(lower(race), 'asian') THEN 'Asian' ELSE 'Unavailable' END AS race,
 CASE WHEN contains(lower(race), 'white') THEN 'White' WHEN contains(lower(race), 'black') THEN 'Black' WHEN contains(lower(race), 'asian') THEN 'Asian'
   WHEN race IS NULL OR race = '' OR contains(lower(race), 'unknown') OR contains(lower(race), 'declined') THEN 'Unavailable' ELSE 'Others' END AS race_strict,
 CASE WHEN contains(lower(eth), 'not hispanic') THEN 'Not Hispanic' WHEN contains(lower(eth), 'hispanic') THEN 'Hispanic' ELSE 'Unavailable' END AS ethnicity FROM r""")
def demographics_norm(spark, sf):
    c = F.col("c_custkey")
    sex = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'Female' WHEN 1 THEN 'male' WHEN 2 THEN 'F' WHEN 3 THEN 'm' WHEN 4 THEN '' END")
    race = F.expr("CASE c_custkey % 7 WHEN 0 THEN 'Black or African American' WHEN 1 THEN 'White' WHEN 2 THEN 'Asian' WHEN 3 THEN 'Declined' WHEN 4 THEN 'other race' WHEN 5 THEN 'Unknown' END")
    eth = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic' WHEN 2 THEN '' END")
    return t(spark, sf, "customer").select(c, S.sex(sex).alias("sex"), S.race(race).alias("race"), S.race(race, compat=False).alias("race_strict"), S.ethnicity(eth).alias("ethnicity"))


@query("prior_shift", f"WITH {SC}, c AS (SELECT doc_id, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM sc), o AS (SELECT doc_id, p / (1 - p) * (0.05 / 0.95) / (0.3 / 0.7) AS o FROM c) SELECT doc_id, round(o / (1 + o), 9) AS p FROM o")
def prior_shift(spark, sf):
    return scored(spark, sf).select("doc_id", F.round(S.prior_shift(F.col("score"), F.lit(0.3), F.lit(0.05)), 9).alias("p"))


@query("date_rules", """SELECT o_orderkey, date_diff('day', TIMESTAMP '1994-01-01', o_orderdate) AS days,
  epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1994-01-01') >= 365.25 * 86400 * 1000000 AND epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1994-01-01') <= 6 * 365.25 * 86400 * 1000000 AS in_window FROM orders""")
def date_rules(spark, sf):
    """Mixed-format dates, whole days and the year window in microseconds."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy HH:mm"))
    at, origin = S.mixed_date(text), F.lit("1994-01-01").cast("timestamp_ntz")
    return t(spark, sf, "orders").select("o_orderkey", F.floor(S.micros_between(origin, at) / 86_400_000_000).alias("days"), S.year_window(origin, at, 1, 6).alias("in_window"))


@query("ratios_logs", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio, round(log10(l_discount + 1e-10), 6) AS log_p, round(log2(l_quantity), 6) AS log2_q,
  round(least(greatest(l_tax, 0.02), 0.06), 6) AS clipped, CAST(sign(l_quantity - 25) AS INTEGER) AS sgn, round((l_quantity - l_tax * 100) / nullif(l_quantity + l_tax * 100, 0), 6) + 0e0 AS asym FROM lineitem""")
def ratios_logs(spark, sf):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    return t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.ratio(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("ratio"), r6(S.log_power(F.col("l_discount"))).alias("log_p"), r6(F.log2(q)).alias("log2_q"),
        r6(S.clip(tax, 0.02, 0.06)).alias("clipped"), F.signum(q - 25).cast("int").alias("sgn"), (r6(S.ratio(q - tax * 100, q + tax * 100)) + 0.0).alias("asym"),
    )


@query("interactions", f"WITH {SC} SELECT doc_id, age * age AS age_sq, round(age * score, 6) AS age_score, round((age - 70) * score, 6) AS centred FROM sc")
def interactions(spark, sf):
    return scored(spark, sf).select("doc_id", (F.col("age") * F.col("age")).alias("age_sq"), r6(F.col("age") * F.col("score")).alias("age_score"), r6((F.col("age") - 70) * F.col("score")).alias("centred"))


@query("sample_weights", f"""WITH {SC}, b AS (SELECT *, CAST(floor(age / 10) AS INTEGER) AS bin FROM sc), n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), c AS (SELECT y2, count(*) AS n FROM b GROUP BY y2),
 w AS (SELECT doc_id, (SELECT count(*) FROM b) / (2e0 * c.n) * sqrt((SELECT max(n) FROM n) / n.n) AS w FROM b JOIN n USING (bin) JOIN c USING (y2))
 SELECT doc_id, round(w / avg(w) OVER (), 6) AS weight FROM w""")
def sample_weights(spark, sf):
    return S.sample_weights(scored(spark, sf), "y2", "age").select("doc_id", r6("weight").alias("weight"))


@query("json_nulls", "SELECT s_suppkey, '{\"k\":' || CAST(s_suppkey AS VARCHAR) || ',\"v\":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE CAST(s_nationkey AS VARCHAR) END || '}' AS js FROM supplier")
def json_nulls(spark, sf):
    value = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_nationkey").cast("double"))
    pair = F.struct(F.col("s_suppkey").alias("k"), S.null_if_nan(value).cast("int").alias("v"))
    return t(spark, sf, "supplier").select("s_suppkey", F.to_json(pair, {"ignoreNullFields": "false"}).alias("js"))
