"""Small file formats: topic logs, server settings, translations, test results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldstate.operators.ordered import ROWS_PER_TASK, Ordered
from worldstate.sources.lines import numbered_lines

TOPIC_SCHEMA = "topic string, payload string, ts timestamp, seq bigint"

# shape of one exported test run
RESULTS_SCHEMA = (
    "test_scripts struct<props: map<string, double>, scripts: map<string, struct<"
    "props: map<string, bigint>, tests: map<string, struct<status: string, passing: array<string>, "
    "failing: array<string>, pending: array<string>, orphans: bigint, time_taken: double>>>>>"
)


def read_topics(
    spark: SparkSession,
    path: str | None,
    topics: Sequence[str],
    stream: bool = False,
    kafka: dict[str, str] | None = None,
    max_files_per_trigger: int = 100,
) -> DataFrame:
    """Messages of the given topics: topic, payload, ts, seq. Names match exactly.

    From JSON lines at ``path``, or from Kafka with the given options; as table or as stream.
    """
    if kafka is not None:
        reader = spark.readStream if stream else spark.read
        raw = reader.format("kafka").options(**kafka).option("subscribe", ",".join(topics)).load()
        return raw.select("topic", F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("ts"), F.col("offset").alias("seq"))
    if stream:
        rows = spark.readStream.schema(TOPIC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(path)
    else:
        rows = spark.read.schema(TOPIC_SCHEMA).json(path)
    return rows.filter(F.col("topic").isin(*topics))


def write_topics(df: DataFrame, path: str) -> None:
    """Append messages (topic, payload, ts, seq) as JSON lines."""
    df.select("topic", "payload", "ts", "seq").write.mode("append").json(path)


def read_fleet_config(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Settings of many ini files: file, section, key, value (quotes removed)."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim(F.col("value"), F.lit("\t \r")))
    lines = lines.filter((F.col("value") != "") & ~F.col("value").startswith(";"))
    heading = F.nullif(F.regexp_extract("value", r"^\[(.*)\]$", 1), F.lit(""))
    rows = Ordered(lines, ["file"], ["line_no"], rows_per_task).last_known("section", heading).result()
    pair = F.split("value", "=", 2)
    return rows.filter(F.col("value").contains("=") & F.col("section").isNotNull()).select(
        "file",
        "section",
        F.trim(F.get(pair, F.lit(0))).alias("key"),
        F.regexp_replace(F.trim(F.get(pair, F.lit(1))), '^"|"$', "").alias("value"),
    )


def fleet_table(config: DataFrame, settings: Sequence[str]) -> DataFrame:
    """One row per file with the given ``section.key`` settings as columns ``section_key``."""
    full = F.concat_ws(".", "section", "key")
    aggs = [F.max(F.when(full == s, F.col("value"))).alias(s.replace(".", "_")) for s in settings]
    return config.groupBy("file").agg(*aggs)


def read_translations(spark: SparkSession, path: str, locales: Sequence[str]) -> DataFrame:
    """Wide CSV (keys, one column per locale) as key, locale, text; a blank is null."""
    schema = ", ".join(["keys string", *[f"`{name}` string" for name in locales]])
    wide = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return translations_long(wide.withColumnRenamed("keys", "key"), locales)


def translations_long(wide: DataFrame, locales: Sequence[str]) -> DataFrame:
    long = wide.unpivot("key", list(locales), "locale", "text")
    return long.withColumn("text", F.nullif(F.trim("text"), F.lit("")))


def shown_text(long: DataFrame) -> DataFrame:
    """Adds ``shown``: the text, or the key where it is missing."""
    return long.withColumn("shown", F.coalesce("text", "key"))


def read_test_results(spark: SparkSession, path: str) -> DataFrame:
    """Exported runs (one JSON document per file) as one row per test."""
    runs = spark.read.schema(RESULTS_SCHEMA).option("multiLine", True).json(path)
    suites = runs.select(
        F.col("_metadata.file_path").alias("run"), F.explode("test_scripts.scripts").alias("script", "_s")
    )
    tests = suites.select("run", "script", F.explode("_s.tests").alias("test", "_t"))
    return tests.select("run", "script", "test", "_t.*")


def write_junit(tests: DataFrame, path: str, max_tests: int = 10_000, rows_per_task: int = ROWS_PER_TASK) -> None:
    """JUnit XML from script, test, status, assertions, time and counts per test.

    A script with very many tests becomes several ``testsuite`` elements of the same name.
    """
    junit_suites(tests, max_tests, rows_per_task).write.format("xml").option("rootTag", "testsuites").option(
        "rowTag", "testsuite"
    ).save(path)


def junit_suites(tests: DataFrame, max_tests: int = 10_000, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows shaped like ``testsuite`` elements; fields with an underscore become attributes."""
    numbered = tests.withColumn("_at", F.xxhash64("script", "test").cast("double"))
    numbered = Ordered(numbered, ["script"], ["_at", "test"], rows_per_task).row_number("_n").result()
    case = F.struct(
        F.col("_n"),
        F.struct(
            F.col("test").cast("string").alias("_name"),
            F.col("assertions").alias("_assertions"),
            F.col("status").alias("_status"),
            F.regexp_replace("script", "^res://", "").alias("_classname"),
            F.col("time_taken").alias("_time"),
        ).alias("case"),
    )
    part = F.floor((F.col("_n") - 1) / max_tests)
    grouped = numbered.groupBy("script", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_tests"),
        F.sum("failures").alias("_failures"),
        F.sum("pending").alias("_skipped"),
        F.sum("time_taken").alias("_time"),
        F.transform(F.sort_array(F.collect_list(case)), lambda c: c["case"]).alias("testcase"),
    )
    return grouped.select(
        F.regexp_replace("script", "^res://", "").alias("_name"), "_tests", "_failures", "_skipped", "_time", "testcase"
    )
