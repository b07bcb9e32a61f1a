"""One findings schema for every audit: media_id, rule, severity, subject_id, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["media_id", "rule", "severity", "subject_id", "detail"]


def findings(rows: DataFrame, checks, subject, media: str = "media_id") -> DataFrame:
    """``checks`` is a list of (rule, severity, condition, {name: column}). One pass over the rows, no shuffle."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    none = F.lit(None).cast("map<string,string>")
    found = []
    for rule, severity, cond, detail in checks:
        pairs = [x for k, v in detail.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.col(v)).cast("string"))]
        made = F.create_map(*pairs) if pairs else none
        found.append(F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), made.alias("detail"))))
    out = rows.select(F.col(media).alias("media_id"), subject.cast("string").alias("subject_id"),
                      F.explode(F.array_compact(F.array(*found))).alias("f"))
    return out.select("media_id", "f.rule", "f.severity", "subject_id", "f.detail")


def verdict(found: DataFrame, items: DataFrame | None = None, media: str = "media_id") -> DataFrame:
    """Errors and warnings per item; ``ok`` when there is no error. ``items`` adds the items without findings."""
    v = found.groupBy("media_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    if items is not None:
        v = items.select(F.col(media).alias("media_id")).distinct().join(v, "media_id", "left").fillna(0, ["errors", "warnings"])
    return v.withColumn("ok", F.col("errors") == 0)


def counts_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("media_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def require_none(found: DataFrame) -> None:
    """Strict mode: raise when there is an error finding. Looks at a few rows only."""
    rows = found.filter("severity = 'error'").take(5)
    if rows:
        raise ValueError("; ".join(f"{r['media_id']} {r['rule']} {r['subject_id']}" for r in rows))
