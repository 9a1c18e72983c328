"""File sources of the domain: card CSV, multi-file ingest, logs, documents, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill import constants as K
from casemill.functions.scalar import age_years, fractional_hour, haversine_km, hour_of_day
from casemill.session import durable

CARD_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in K.PCA_COLS]
    + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())]
)

# Types of the raw business columns; any other column stays text.
RAW_TYPES = {
    "cc_num": "bigint", "lat": "double", "long": "double", "merch_lat": "double", "merch_long": "double",
    "amt": "double", "city_pop": "bigint", "is_fraud": "int",
}

# File name and body layout of a stored report.
REPORT_NAME = r"(?:.*/)?(?:name=)?(.+?)_(interpreta|revisa)_s(\d+)_r(\d+)\.md"
REPORT_BODY = r"(?s)## Informe final\n(.*?)\n---\n\n## Salida del Investigador"


def read_card_csv(spark: SparkSession, path: str) -> DataFrame:
    """Card transactions with the derived hour; a missing path is an error."""
    df = spark.read.schema(CARD_SCHEMA).option("header", True).csv(path)
    return df.withColumn("Hour", hour_of_day(F.col("Time")))


def read_raw_folder(spark: SparkSession, pattern: str, key: str = "trans_num", sep: str = "|") -> DataFrame:
    """Merge delimited files by column name, skipping files whose header lacks ``key``.

    A file's header is its first line: the one with the smallest row number of its first block.
    Lines are matched with the header of their file and parsed by it, one scan per distinct
    header; file names stay in the cluster, only the distinct headers come to the driver.
    Empty lines and lines that repeat the header are no data.
    """
    lines = spark.read.text(pattern).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at")
    )
    first = lines.filter(F.col("file_block_start") == 0).groupBy("file_path").agg(F.min_by("value", "_at").alias("head"))
    heads = durable(first.filter(F.array_contains(F.split("head", f"\\{sep}"), key)))
    layouts = sorted(r["head"] for r in heads.select("head").distinct().collect())
    if not layouts:
        raise FileNotFoundError(f"no transaction files match {pattern}")
    parts = []
    for head in layouts:
        names = head.split(sep)
        schema = ", ".join(f"`{n}` string" for n in names)
        body = lines.join(heads.filter(F.col("head") == head), "file_path").filter((F.col("value") != head) & (F.col("value") != ""))
        raw = body.select(F.from_csv("value", schema, {"sep": sep}).alias("r")).select("r.*")
        parts.append(raw.select(*[F.col(f"`{n}`").cast(RAW_TYPES.get(n, "string")).alias(n) for n in names]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def prepare_business(raw: DataFrame) -> DataFrame:
    """Business transactions: derived columns, final names and order, sorted by time."""
    ts = F.to_timestamp_ntz(F.concat_ws(" ", "trans_date", "trans_time"), F.lit("yyyy-MM-dd HH:mm:ss"))
    born = F.to_date("dob")
    return (
        raw.withColumn("marca_temporal", ts)
        .select(
            "marca_temporal", "trans_num", "cc_num",
            F.regexp_replace("merchant", "^fraud_", "").alias("comercio"),
            F.col("category").alias("categoria"),
            F.col("amt").alias("importe"),
            fractional_hour(F.col("marca_temporal")).alias("hora"),
            F.weekday("marca_temporal").alias("dia_semana"),
            age_years(F.col("marca_temporal"), born).alias("edad"),
            haversine_km(F.col("lat"), F.col("long"), F.col("merch_lat"), F.col("merch_long")).alias("distancia_km"),
            F.col("city_pop").alias("poblacion_ciudad"),
            "city", "state", "job",
            F.col("is_fraud").alias("es_fraude"),
        )
        .orderBy("marca_temporal", "trans_num")
    )


def newest_path(spark: SparkSession, pattern: str) -> str:
    """Of the files that match, the one whose name sorts last; a folder that Spark wrote counts as one file.

    Files are listed, not read: of a binary scan only the path is asked for.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path")
    whole = F.regexp_replace("path", "/part-[^/]*$", "")
    newest = paths.agg(F.max(F.struct(F.substring_index(whole, "/", -1).alias("name"), whole.alias("path")))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no log matches {pattern}")
    return newest["path"]


def read_newest_log(spark: SparkSession, pattern: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Runs without an error from the log whose name sorts last; only that log is read."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(newest_path(spark, pattern))
    return rows.filter(F.col("error").isNull() | (F.col("error") == ""))


def read_metric_documents(spark: SparkSession, pattern: str, split: str = "temporal") -> DataFrame:
    """Metric records of one split from JSON documents (arrays of records)."""
    return spark.read.option("multiLine", True).json(pattern).filter(F.col("split") == split)


def read_window_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(window minutes, occupancy) of every complete window report."""
    schema = "ventana_min double, ocupacion double"
    docs = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return docs.filter(F.col("ventana_min").isNotNull() & F.col("ocupacion").isNotNull())


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Stored reports: fields of the file name and the text between its two headings."""
    files = spark.read.option("recursiveFileLookup", True).text(pattern, wholetext=True)
    rows = files.select("value", F.url_decode("_metadata.file_path").alias("_path"))

    def part(i: int):
        return F.regexp_extract("_path", REPORT_NAME, i)

    out = rows.select(
        F.regexp_replace(part(1), r"^.*[/=]", "").alias("model"),
        part(2).alias("mode"),
        part(3).try_cast("int").alias("seed"),
        part(4).try_cast("int").alias("repetition"),
        F.regexp_extract("value", REPORT_BODY, 1).alias("text"),
    )
    return out.filter((F.col("mode") != "") & (F.col("text") != ""))


def json_verdicts(docs: DataFrame, run: list[str], column: str) -> DataFrame:
    """Verdict objects keyed by case number as rows."""
    parsed = docs.withColumn("_m", F.from_json(column, "map<string,string>"))
    return parsed.select(*run, F.explode("_m").alias("case_no", "verdict")).withColumn(
        "case_no", F.col("case_no").try_cast("long")
    )
