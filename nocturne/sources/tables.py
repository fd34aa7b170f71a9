"""Readers and writers of the tables around recordings: annotation files, cohort CSVs, feature tables, models' reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Schemas of the cohort files.
DEMOGRAPHICS = (
    "SiteID string, BDSPPatientID string, CreationTime string, BidsFolder string, SessionID string, Age string, Sex string, Race string, Ethnicity string, "
    "BMI string, Time_to_Event string, Cognitive_Impairment string, Last_Known_Visit_Date string, Time_to_Last_Visit string"
)
ICD = "SiteID string, BDSPPatientID string, ICDDate string, ICD9 string, ICD10 string"
DEFAULT_DURATION = 30.0


def read_cohort(spark: SparkSession, path: str, schema: str = DEMOGRAPHICS) -> DataFrame:
    """A CSV with a header, columns by name in the schema's order; a column that the file lacks is null."""
    raw = spark.read.option("header", True).csv(path)
    names = [c.strip().split()[0] for c in schema.split(",")]
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in names])


def _number(c: Column) -> Column:
    return c.try_cast("double")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """path, line, onset, duration, description of annotation files: XML events, or lines with tabs, semicolons, commas or blanks.

    A line is onset, duration, description, or onset and description; the duration is then 30 s.
    Lines without a number in front are headers or remarks and are left out.
    """
    files = spark.read.option("wholetext", True).text(path).select("value", F.input_file_name().alias("path"))
    is_xml = F.ltrim(F.col("value")).startswith("<")
    events = F.regexp_extract_all("value", F.lit(r"(?s)<ScoredEvent>(.*?)</ScoredEvent>"), F.lit(1))
    tag = lambda name: F.regexp_extract("event", f"(?s)<{name}>\\s*(.*?)\\s*</{name}>", 1)
    xml = files.where(is_xml).select("path", F.posexplode(events).alias("line", "event"))
    xml = xml.select("path", "line", _number(tag("Start")).alias("onset"), F.coalesce(_number(tag("Duration")), F.lit(DEFAULT_DURATION)).alias("duration"), tag("EventConcept").alias("description"))
    lines = files.where(~is_xml).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    by = F.when(F.col("text").contains("\t"), "\t").when(F.col("text").contains(";"), ";").when(F.col("text").contains(","), ",").otherwise(" ")
    parts = F.transform(F.split(F.trim("text"), by), lambda x: F.trim(x))
    rows = lines.select("path", "line", parts.alias("p")).withColumn("onset", _number(F.get("p", F.lit(0)))).where("onset is not null and size(p) > 1")
    second = _number(F.get("p", F.lit(1)))
    rest = F.when(second.isNotNull(), F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))).otherwise(F.slice("p", 2, F.size("p") - 1))
    plain = rows.select("path", "line", "onset", F.coalesce(second, F.lit(DEFAULT_DURATION)).alias("duration"), F.array_join(rest, " ").alias("description"))
    return xml.unionByName(plain)


def epochs_of(annotations: DataFrame, key: str, epoch: float = 30.0) -> DataFrame:
    """Sleep epochs from annotations: stage by text, one epoch for each ``epoch`` seconds that an annotation lasts, the first of equals kept."""
    from nocturne.functions.scalar import STAGE_CODES, stage_of_text

    rows = annotations.withColumn("stage_label", stage_of_text(F.col("description"))).where("stage_label <> 'Unknown'")
    n = F.greatest(F.lit(1), F.round(F.coalesce("duration", F.lit(epoch)) / epoch)).cast("int")
    rows = rows.select(key, "onset", F.col("description").alias("stage_raw"), "stage_label", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    start = F.col("onset") + F.col("_i") * epoch
    rows = rows.select(key, F.floor(start / epoch).cast("int").alias("epoch_idx"), start.alias("start_sec"), (start + epoch).alias("end_sec"), F.lit(epoch).alias("duration_sec"), "stage_raw", "stage_label")
    w = Window.partitionBy(key, "epoch_idx").orderBy("start_sec", "stage_raw")
    code = {v: k for k, v in STAGE_CODES.items()}
    numeric = F.coalesce(*[F.when(F.col("stage_label") == s, c) for s, c in code.items()])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").withColumn("stage_numeric", numeric)


def events_of(annotations: DataFrame, key: str) -> DataFrame:
    """Scored events from annotations, one for each type and start."""
    from nocturne.functions.scalar import event_of_text

    rows = annotations.withColumn("event_type", event_of_text(F.col("description"))).where("event_type is not null")
    rows = rows.select(key, "event_type", F.col("onset").alias("start_sec"), (F.col("onset") + F.coalesce("duration", F.lit(0.0))).alias("end_sec"), F.coalesce("duration", F.lit(0.0)).alias("duration_sec"), F.col("description").alias("raw_annotation"))
    w = Window.partitionBy(key, "event_type", "start_sec").orderBy("end_sec", "raw_annotation")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def write_features(df: DataFrame, path: str, key: str = "patient_id") -> None:
    """Feature table, doubles as floats, a folder for each hash of the key so that one subject can be read alone."""
    narrow = df.select(*[F.col(f.name).cast("float").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])
    narrow.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(64)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Chosen columns; those that the table lacks are null.  Files of different width are merged by name; a broken file is an error (see rescue_features)."""
    return _chosen(spark.read.option("mergeSchema", True).parquet(path).drop("bucket"), columns)


def _chosen(df: DataFrame, columns: list[str] | None) -> DataFrame:
    if columns is None:
        return df
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def inspect(spark: SparkSession, path: str, key: str = "patient_id") -> DataFrame:
    """path, size_bytes, modified, valid, n_rows, columns, ids (10 distinct at most) and kind of every Parquet file below a folder.

    Files are opened where they are read, one at a time; of a broken one only the listing is given.
    A file with a segment number has segments, one without has patients; else the name tells.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    schema = "path string, size_bytes long, modified timestamp, valid boolean, n_rows long, columns array<string>, ids array<string>, kind string"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for r in batch.itertuples():
                name = r.path.lower()
                kind = "segment" if "segment" in name else "patient" if "patient" in name else "unknown"
                try:
                    f = pq.ParquetFile(pa.BufferReader(r.content))
                    columns = f.schema_arrow.names
                    ids = sorted({str(v) for v in f.read(columns=[key]).column(0).to_pylist() if v is not None})[:10] if key in columns else []
                    kind = "segment" if "segment_idx" in columns else "patient" if key in columns else kind
                    rows.append((r.path, r.length, r.modificationTime, True, f.metadata.num_rows, columns, ids, kind))
                except Exception:  # whatever a broken file raises, the row says that it is not valid
                    rows.append((r.path, r.length, r.modificationTime, False, None, None, None, kind))
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "modified", "valid", "n_rows", "columns", "ids", "kind"])

    return files.select("path", "length", "modificationTime", "content").mapInPandas(look, schema)


def rescue_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, report): all valid Parquet files, and for a broken one the CSV of the same name beside it, if there is one.

    The report has path, valid and used: "parquet", "csv" or "none".  Files of no bytes are not listed.
    """
    found = inspect(spark, path).select("path", "valid").collect()  # a row for each file
    good, broken = [r.path for r in found if r.valid], [r.path for r in found if not r.valid]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(p: str) -> bool:
        where = jvm.org.apache.hadoop.fs.Path(p)
        return where.getFileSystem(conf).exists(where)

    beside = {p: p[: -len(".parquet")] + ".csv" for p in broken}
    beside = {p: c for p, c in beside.items() if there(c)}
    out = spark.read.option("mergeSchema", True).parquet(*good).drop("bucket") if good else None
    if beside:
        csv = spark.read.option("header", True).option("inferSchema", True).csv(list(beside.values()))
        if out is not None:
            csv = csv.select(*[F.col(c).cast(out.schema[c].dataType) if c in out.columns else F.col(c) for c in csv.columns])
        out = csv if out is None else out.unionByName(csv, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], "patient_id string")
    report = [(p, True, "parquet") for p in good] + [(p, False, "csv" if p in beside else "none") for p in broken]
    return _chosen(out, columns), spark.createDataFrame(report, "path string, valid boolean, used string")


def with_fallback(wanted: DataFrame, cached: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """A row for each wanted key: the cached one, else the one worked out anew, with ``how``; keys with neither are left out."""
    have = cached.join(wanted.select(key).distinct(), key, "left_semi").withColumn("how", F.lit("cached"))
    rest = computed.join(wanted.select(key).distinct(), key, "left_semi").join(have.select(key), key, "left_anti").withColumn("how", F.lit("computed"))
    return have.unionByName(rest, allowMissingColumns=True)


def write_manifest(entries: DataFrame, path: str, key: str = "key", at: str = "cached_at") -> DataFrame:
    """The manifest at ``path`` with ``entries`` in it, the newest entry of each key; a version takes the other's place by a rename.

    Readers see the old manifest or the new one.  Gives the table that was written.
    """
    spark = entries.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    rows = entries.unionByName(spark.read.schema(entries.schema).json(path), allowMissingColumns=True) if fs.exists(where) else entries
    w = Window.partitionBy(key).orderBy(F.desc(at), F.xxhash64(*[c for c in rows.columns]))
    rows = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    fresh, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex}") for x in ("new", "old"))
    rows.write.json(fresh.toString())
    if fs.exists(where):
        fs.rename(where, old)
    if not fs.rename(fresh, where):
        raise OSError(f"can't put the manifest at {path}")
    fs.delete(old, True)
    return spark.read.schema(rows.schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; arrays as JSON."""
    flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_feature_list(df: DataFrame, path: str) -> None:
    """A line of text for each column: its name and number of nulls, those with most nulls first."""
    lines = null_counts(df).orderBy(F.desc("nulls"), "column_name").select(F.format_string("%s\t%d", "column_name", "nulls").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)  # as many lines as columns


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) of every column, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])).alias("r")).select("r.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, record, size_bytes, modified, kind of every Parquet file below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    kind = F.when(F.lower("path").contains("segment"), "segment").when(F.lower("path").contains("patient"), "patient").otherwise("unknown")
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("record"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), kind.alias("kind"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric tables as JSON lines, NaN as null."""
    clean = metrics.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in metrics.schema.fields])
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)
