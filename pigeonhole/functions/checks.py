"""Typed findings: ``(code, kind, detail)`` rows. Blockers stop a job, document findings route a row to failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BLOCKER, DOCUMENT, REQUEST = "blocker", "document", "request"
Rule = tuple[str, str, str, Column]


class BlockerError(RuntimeError):
    """Raised when a findings table holds at least one blocker."""


def finding(code: str | Column, kind: str, detail: str) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.lit(kind).alias("kind"), F.lit(detail).alias("detail"))


def failing(condition: Column) -> Column:
    """A predicate is failed unless it is true; null counts as failed."""
    return ~F.coalesce(condition, F.lit(False))


def first_finding(rules: Sequence[Rule]) -> Column:
    """Ordered rules ``(code, kind, detail, must_hold)``: the first that does not hold, else null."""
    chain = None
    for code, kind, detail, must_hold in rules:
        value = finding(code, kind, detail)
        chain = F.when(failing(must_hold), value) if chain is None else chain.when(failing(must_hold), value)
    return chain


def all_findings(rules: Sequence[Rule]) -> Column:
    """Every rule that does not hold, in order."""
    return F.filter(
        F.array(*[F.when(failing(must_hold), finding(code, kind, detail)) for code, kind, detail, must_hold in rules]),
        lambda f: f.isNotNull())


def explode_findings(df: DataFrame, keys: Sequence[str], findings: Column) -> DataFrame:
    return df.select(*keys, F.explode(findings).alias("_f")).select(*keys, "_f.code", "_f.kind", "_f.detail")


def assert_no_blockers(findings: DataFrame) -> None:
    """Explicit action: one row is enough to stop, so only one is fetched."""
    bad = findings.filter(F.col("kind") == BLOCKER).take(1)
    if bad:
        raise BlockerError(f"{bad[0]['code']}: {bad[0]['detail']}")


def unit(c: Column) -> Column:
    """Finite and inside [0, 1]. NaN sorts above every number in Spark, hence the explicit test."""
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)


def safe_count(c: Column, minimum: int = 0) -> Column:
    return c.isNotNull() & (c >= minimum) & (c <= 2**53 - 1)
