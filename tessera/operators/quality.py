"""Data-quality rules, expectations and dead letters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityFailure(RuntimeError):
    """A rule with action fail, or an expectation that must hold, was violated."""


@dataclass(frozen=True)
class Rule:
    """kind: not_null, range (least and most, both allowed) or regex; action: fail, reject or warn."""

    name: str
    column: str
    kind: str
    action: str = "reject"
    least: float | None = None
    most: float | None = None
    pattern: str | None = None

    def violated(self) -> Column:
        x = F.col(self.column)
        if self.kind == "not_null":
            return x.isNull()
        if self.kind == "range":
            low = x < F.lit(self.least) if self.least is not None else F.lit(False)
            high = x > F.lit(self.most) if self.most is not None else F.lit(False)
            return F.coalesce(low | high, F.lit(False))
        if self.kind == "regex":
            return F.coalesce(~x.cast("string").rlike(self.pattern), F.lit(False))
        raise ValueError(f"unknown rule {self.kind!r}")


def check(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, report).  Rejected rows name the rules that they break, with the time.

    The report counts violations of every rule in one pass; reading it is left
    to the caller unless a rule must not fail, which is checked at once.
    """
    tags = F.array_compact(F.array(*[F.when(r.violated(), F.lit(r.name)) for r in rules if r.action == "reject"])) if any(r.action == "reject" for r in rules) else F.array().cast("array<string>")
    marked = df.withColumn("violations", tags)
    report = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(r.violated(), 1)).alias(r.name) for r in rules])
    must = [r for r in rules if r.action == "fail"]
    if must:
        got = df.agg(*[F.count(F.when(r.violated(), 1)).alias(r.name) for r in must]).first()
        broken = {r.name: got[r.name] for r in must if got[r.name]}
        if broken:
            raise QualityFailure(f"rules violated: {broken}")
    accepted = marked.where(F.size("violations") == 0).drop("violations")
    rejected = marked.where(F.size("violations") > 0).withColumn("rejected_at", F.current_timestamp())
    return accepted, rejected, report


def expect(df: DataFrame, name: str, predicate: str, on_violation: str = "drop") -> DataFrame:
    """Rows for which the predicate isn't true are dropped, or fail the run."""
    holds = F.coalesce(F.expr(predicate), F.lit(False))
    if on_violation == "drop":
        return df.where(holds)
    n = df.where(~holds).count()
    if n:
        raise QualityFailure(f"expectation {name} violated by {n} rows")
    return df
