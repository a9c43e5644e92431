"""Comparison, expectations, test-run tables."""

from pyspark.sql import functions as F

from worldstate.operators import compare, telemetry
from worldstate.operators.compare import Rule
from worldstate.session import fresh_dir
from worldstate.sources import tables


def test_whole_numbers_and_fractions_differ_in_deep_mode(spark):
    a = spark.createDataFrame([(1, 5)], "k int, v int")
    b = spark.createDataFrame([(1, 5.0)], "k int, v double")
    assert compare.diff_tables(a, b, ["k"]).first()["status"] == "different"
    assert compare.diff_tables(a, b, ["k"], deep=False).first()["status"] == "equal"


def test_missing_keys_and_columns(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2)], "k int, v string, only_a int")
    b = spark.createDataFrame([(2, None, 9), (3, "z", 9)], "k int, v string, only_b int")
    got = {(r["k"], r["column"]): r["status"] for r in compare.diff_tables(a, b, ["k"]).collect()}
    assert got[(1, "v")] == "missing right" and got[(3, "v")] == "missing left" and got[(2, "v")] == "equal"
    assert got[(2, "only_a")] == "missing right" and got[(2, "only_b")] == "missing left"


def test_arrays_of_different_length(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a", "c", "d"]), (2, [], ["q"]), (3, None, [])], "id int, l array<string>, r array<string>")
    got = [(r["id"], r["index"], r["status"]) for r in compare.diff_arrays(df, "l", "r").orderBy("id", "index").collect()]
    assert got == [(1, 0, "equal"), (1, 1, "different"), (1, 2, "missing left"), (2, 0, "missing left")]


def test_top_differences_says_how_many_more(spark):
    a = spark.range(50).select("id", F.lit(1).alias("v"))
    b = spark.range(50).select("id", F.when(F.col("id") < 5, 1).otherwise(2).alias("v"))
    got = compare.top_differences(compare.diff_tables(a, b, ["id"]), ["id"], 30).collect()
    assert [r["id"] for r in got] == list(range(5, 35)) and {r["more"] for r in got} == {15}


def test_rules_at_their_borders(spark):
    df = spark.createDataFrame([(1.0, "Abc", [1], True), (2.0, "", [2], False), (None, None, None, None)], "x double, s string, l array<int>, b boolean")
    rules = {
        Rule("a", "x", "almost_eq", 1.5, 0.5): 2, Rule("b", "x", "almost_ne", 1.5, 0.4): 2, Rule("c", "x", "between", 1.0, 2.0): 2,
        Rule("d", "x", "not_between", 1.0, 2.0): 0, Rule("e", "x", "between", 2.0, 1.0): 0, Rule("f", "s", "contains", "B"): 0,
        Rule("g", "s", "contains", "B", fold_case=True): 1, Rule("h", "s", "contains", ""): 0, Rule("i", "s", "starts_with", "Ab"): 1,
        Rule("j", "s", "ends_with", "bc"): 1, Rule("k", "l", "has", 2): 1, Rule("l", "b", "is_true"): 1, Rule("m", "b", "is_false"): 1,
        Rule("n", "x", "is_null"): 1, Rule("o", "x", "not_null"): 2, Rule("p", "x", "gte", 2.0): 1, Rule("q", "l", "has_not", 2): 1,
    }
    got = {r["rule"]: (r["passed"], r["failed"]) for r in compare.expect(df, list(rules)).collect()}
    assert got == {r.name: (n, 3 - n) for r, n in rules.items()}


def test_status_precedence_differs_from_the_counts(spark):
    """A pending and failing test shows as pending but counts as failing."""
    df = spark.createDataFrame(
        [("s", 1, True, False, 1, 1, 1), ("s", 2, True, False, 0, 0, 0), ("s", 3, False, False, 0, 0, 0), ("s", 4, False, True, 0, 0, 0)],
        "script string, test_id int, was_run boolean, should_skip boolean, pass_n int, fail_n int, pending_n int",
    )
    status = [r["status"] for r in compare.test_status(df).orderBy("test_id").collect()]
    assert status == ["pending", "no asserts", "not run", "skipped"]
    totals = compare.test_run_totals(df).first()
    assert (totals["failing_tests"], totals["passing_tests"], totals["risky"], totals["tests"], totals["scripts"]) == (1, 0, 2, 2, 1)


def test_counter_since_marker(spark):
    rows = [("m", 0, 5, False), ("m", 1, 6, True), ("m", 2, 9, False), ("n", 2, 9, False)]
    df = spark.createDataFrame(rows, "marker string, t int, c int, is_marker boolean")
    got = {(r["marker"], r["t"]): r["since"] for r in telemetry.counter_since(df, ["t"], "c").collect()}
    assert got == {("m", 0): -1, ("m", 1): 0, ("m", 2): 3, ("n", 2): -1}


def test_junit_pages_large_suites(spark):
    df = spark.range(25).select(
        F.lit("res://a.gd").alias("script"), F.col("id").alias("test"), F.lit("passed").alias("status"), F.lit(1).alias("assertions"),
        F.lit(0.5).alias("time_taken"), F.lit(0).cast("bigint").alias("failures"), F.lit(0).cast("bigint").alias("pending"),
    )
    path = fresh_dir(spark, "junit")
    tables.write_junit(df, path, max_tests=10, rows_per_task=8)
    back = spark.read.format("xml").option("rowTag", "testsuite").load(path)
    assert sorted(r["_tests"] for r in back.collect()) == [5, 10, 10]
    cases = back.select("_name", F.explode("testcase").alias("t")).select("_name", "t.*").collect()
    assert len({c["_name"] + str(i) for i, c in enumerate(cases)}) == 25 and {c["_classname"] for c in cases} == {"a.gd"}


def test_read_results_document(spark, tmp_path):
    (tmp_path / "run.json").write_text(
        '{"test_scripts": {"props": {"tests": 2}, "scripts": {"a.gd": {"props": {"tests": 2}, "tests": {'
        '"t1": {"status": "pass", "passing": ["x"], "failing": [], "pending": [], "orphans": 0, "time_taken": 0.25},\n'
        '"t2": {"status": "fail", "passing": [], "failing": ["y", "z"], "pending": [], "orphans": 1, "time_taken": 1}}}}}}'
    )
    got = tables.read_test_results(spark, str(tmp_path)).orderBy("test").collect()
    assert [(r["script"], r["test"], r["status"], len(r["failing"]), r["orphans"], r["time_taken"]) for r in got] == [
        ("a.gd", "t1", "pass", 0, 0, 0.25), ("a.gd", "t2", "fail", 2, 1, 1.0),
    ]
