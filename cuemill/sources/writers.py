"""Writers. Files are partitioned by item and ordered inside it; Spark's committer makes the output whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions import numbers
from cuemill.sources.readers import SUBTITLE_STYLE


def _ordered(df: DataFrame, order, max_records: int) -> tuple[DataFrame, int]:
    """Range partition by item and order, so a very long item is spread over files that sort by name."""
    return df.repartitionByRange("media_id", *order).sortWithinPartitions("media_id", *order), max_records


def write_stamped_text(rows: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """``[start-end] text`` lines; rows need media_id, pos, start_ms, end_ms, text."""
    d, n = _ordered(rows, ["pos"], max_records)
    line = F.format_string("[%.2f-%.2f] %s", F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, F.regexp_replace("text", r"\s+", " "))
    d.select("media_id", line.alias("value")).write.option("maxRecordsPerFile", n).partitionBy("media_id").mode("overwrite").text(path)


def ass_lines(cues: DataFrame, style: str = SUBTITLE_STYLE) -> DataFrame:
    """Subtitle event lines of cues: media_id, cue_no, start_ms, end_ms, text."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}")), F.lit("\n"), F.lit(" "))
    return cues.select("media_id", "cue_no", F.concat(
        F.lit("Dialogue: 1,"), numbers.ass_time("start_ms"), F.lit(","), numbers.ass_time("end_ms"), F.lit(f",{style},,0,0,0,,"), safe).alias("value"))


def write_ass_events(cues: DataFrame, path: str, style: str = SUBTITLE_STYLE, max_records: int = 1_000_000) -> None:
    d, n = _ordered(ass_lines(cues, style), ["cue_no"], max_records)
    d.select("media_id", "value").write.option("maxRecordsPerFile", n).partitionBy("media_id").mode("overwrite").text(path)


def write_report(found: DataFrame, path: str, inputs: DataFrame | None = None) -> None:
    """Findings by rule, their counts, and the hashes of the inputs they were made from."""
    found.write.partitionBy("rule").mode("overwrite").json(f"{path}/findings")
    found.groupBy("media_id", "rule", "severity").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    if inputs is not None:
        inputs.write.mode("overwrite").parquet(f"{path}/inputs")
