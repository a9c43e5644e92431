"""Table comparison, expectations and test-run roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL, DIFFERENT = "equal", "different"
MISSING_LEFT, MISSING_RIGHT = "missing left", "missing right"

_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], deep: bool = True) -> DataFrame:
    """One row per key and column: ``left_value, right_value`` (text) and ``status``.

    Columns of different types are different in deep mode, whole numbers and fractions included;
    otherwise numbers compare by value. ``keys`` must be unique on each side.
    """
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    columns = [c for c in a.columns if c not in keys]
    columns += [c for c in b.columns if c not in keys and c not in columns]
    left = a.select(*keys, F.struct(*[c for c in a.columns if c not in keys]).alias("_a"))
    right = b.select(*keys, F.struct(*[c for c in b.columns if c not in keys]).alias("_b"))

    def row(c: str) -> Column:
        here = F.col(f"_a.{c}") if c in kinds_a else F.lit(None)
        there = F.col(f"_b.{c}") if c in kinds_b else F.lit(None)
        status = F.when(F.col("_a").isNull(), MISSING_LEFT).when(F.col("_b").isNull(), MISSING_RIGHT)
        if c not in kinds_a or c not in kinds_b:
            status = status.otherwise(MISSING_LEFT if c not in kinds_a else MISSING_RIGHT)
        elif kinds_a[c] != kinds_b[c] and not (kinds_a[c] in _WHOLE and kinds_b[c] in _WHOLE) and deep:
            status = status.otherwise(DIFFERENT)
        else:
            if (kinds_a[c] == "string") != (kinds_b[c] == "string"):  # by value; a text that is no number differs
                same = F.equal_null(here.try_cast("double"), there.try_cast("double")) & (here.isNull() == there.isNull())
                same = same & (here.try_cast("double").isNotNull() | here.isNull())
            else:
                same = here.eqNullSafe(there)
            status = status.when(same, EQUAL).otherwise(DIFFERENT)
        return F.struct(
            F.lit(c).alias("column"),
            here.cast("string").alias("left_value"),
            there.cast("string").alias("right_value"),
            status.alias("status"),
        )

    joined = left.join(right, list(keys), "full")
    return joined.select(*keys, F.inline(F.array(*[row(c) for c in columns])))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Per column: number of each status and of all compared values."""
    count = lambda s: F.count_if(F.col("status") == s)
    return diff.groupBy("column").agg(
        count(EQUAL).alias("equal"),
        count(DIFFERENT).alias("different"),
        count(MISSING_LEFT).alias("missing_left"),
        count(MISSING_RIGHT).alias("missing_right"),
        F.count(F.lit(1)).alias("total"),
    )


def diff_arrays(df: DataFrame, left: str, right: str) -> DataFrame:
    """Differences of two array columns by index; past the end of one side it is missing."""
    size_a, size_b = F.coalesce(F.size(left), F.lit(0)), F.coalesce(F.size(right), F.lit(0))
    kept = [c for c in df.columns if c not in (left, right)]
    longest = F.greatest(size_a, size_b)
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("index", F.explode(places))
    a, b = F.get(left, F.col("index")), F.get(right, F.col("index"))
    status = (
        F.when(F.col("index") >= size_a, MISSING_LEFT)
        .when(F.col("index") >= size_b, MISSING_RIGHT)
        .when(a.eqNullSafe(b), EQUAL)
        .otherwise(DIFFERENT)
    )
    return rows.select(*kept, "index", a.alias("left_value"), b.alias("right_value"), status.alias("status"))


def top_differences(diff: DataFrame, keys: Sequence[str], n: int = 30) -> DataFrame:
    """The first ``n`` differences in key order, each with the number of ``more`` beyond them."""
    unequal = diff.filter(F.col("status") != EQUAL)
    total = unequal.agg(F.count(F.lit(1)).alias("n")).scalar()
    more = F.greatest(total - n, F.lit(0))
    return unequal.orderBy(*keys, "column").limit(n).withColumn("more", more)


class Rule(NamedTuple):
    """``name`` of the check, ``column``, ``op`` and its operands."""

    name: str
    column: str
    op: str
    a: Any = None
    b: Any = None
    fold_case: bool = False


def _text_rule(column: Column, rule: Rule, test) -> Column:
    text, part = (F.lower(column), str(rule.a).lower()) if rule.fold_case else (column, rule.a)
    return (column != "") & test(text, F.lit(part)) if rule.a else F.lit(False)


def _passes(rule: Rule) -> Column:
    c, a, b = F.col(rule.column), rule.a, rule.b
    checks = {
        "eq": lambda: c.eqNullSafe(F.lit(a)),
        "ne": lambda: ~c.eqNullSafe(F.lit(a)),
        "gt": lambda: c > a,
        "gte": lambda: c >= a,
        "lt": lambda: c < a,
        "lte": lambda: c <= a,
        "almost_eq": lambda: (c >= a - b) & (c <= a + b),
        "almost_ne": lambda: ~((c >= a - b) & (c <= a + b)),
        "between": lambda: (c >= a) & (c <= b) if a <= b else F.lit(False),
        "not_between": lambda: (c < a) | (c > b) if a <= b else F.lit(False),
        "is_null": c.isNull,
        "not_null": c.isNotNull,
        "has": lambda: F.array_contains(c, a),
        "has_not": lambda: ~F.array_contains(c, a),
        "contains": lambda: _text_rule(c, rule, F.contains),
        "starts_with": lambda: _text_rule(c, rule, F.startswith),
        "ends_with": lambda: _text_rule(c, rule, F.endswith),
        "is_true": lambda: c.eqNullSafe(F.lit(True)),
        "is_false": lambda: c.eqNullSafe(F.lit(False)),
    }
    return F.coalesce(checks[rule.op](), F.lit(False))


def expect(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rule, passed, failed`` for every rule, all from one pass over the rows."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(_passes(r)).alias(f"_p{i}") for i, r in enumerate(rules)]
    )
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"), F.col(f"_p{i}").alias("passed"), (F.col("_n") - F.col(f"_p{i}")).alias("failed")
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def expect_almost_vec(df: DataFrame, got: Sequence[str], wanted: Sequence[str], tolerance: float) -> DataFrame:
    """``passed, failed``: rows with every component within the tolerance, bounds included."""
    ok = F.lit(True)
    for g, w in zip(got, wanted):
        ok = ok & (F.col(g) >= F.col(w) - tolerance) & (F.col(g) <= F.col(w) + tolerance)
    ok = F.coalesce(ok, F.lit(False))
    return df.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def test_status(results: DataFrame) -> DataFrame:
    """Adds ``status``: skipped, not run, pending, failed, passed, no asserts; the first that applies."""
    status = (
        F.when(F.col("should_skip"), "skipped")
        .when(~F.col("was_run"), "not run")
        .when(F.col("pending_n") > 0, "pending")
        .when(F.col("fail_n") > 0, "failed")
        .when(F.col("pass_n") > 0, "passed")
        .otherwise("no asserts")
    )
    return results.withColumn("status", status)


def _flags() -> tuple[Column, Column, Column]:
    """(passing, failing, pending); here a failure outranks pending, unlike in the status text."""
    failing = F.col("fail_n") > 0
    pending = (F.col("pending_n") > 0) & ~failing
    passing = (F.col("pass_n") > 0) & ~failing & (F.col("pending_n") == 0)
    return passing, failing, pending


def test_run_totals(results: DataFrame) -> DataFrame:
    """Totals of a run: scripts and tests run, passing and failing tests, asserts, pending, risky."""
    passing, failing, pending = _flags()
    risky = F.col("should_skip") | (F.col("was_run") & ~(passing | failing | pending))
    scripts = results.filter("was_run").agg(F.count_distinct("script").alias("n")).scalar()
    return results.agg(
        F.max(scripts).alias("scripts"),
        F.count_if(F.col("was_run")).alias("tests"),
        F.count_if(passing).alias("passing_tests"),
        F.count_if(failing).alias("failing_tests"),
        F.sum(F.col("pass_n").cast("bigint")).alias("passing"),
        F.sum(F.col("fail_n").cast("bigint")).alias("failing"),
        F.sum(F.col("pending_n").cast("bigint")).alias("pending"),
        F.count_if(risky).alias("risky"),
    )


def suite_time(results: DataFrame) -> DataFrame:
    """Per script, over tests that ran or were skipped: tests, failures, pending, summed time."""
    listed = test_status(results).filter(F.col("status") != "not run")
    return listed.groupBy("script").agg(
        F.count(F.lit(1)).alias("tests"),
        F.sum(F.col("fail_n").cast("bigint")).alias("failures"),
        F.sum(F.col("pending_n").cast("bigint")).alias("skipped"),
        F.sum("time_taken").alias("time"),
    )
