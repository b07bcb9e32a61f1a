"""Readers. Each has a path form and, where useful, a form over an already loaded DataFrame. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import numbers, text
from cuemill.operators import articles
from cuemill.session import stage

WORD = "struct<text:string,start_time:double,end_time:double>"
UTTERANCES = f"array<struct<text:string,start_time:double,end_time:double,words:array<{WORD}>>>"
ASR_SCHEMA = (
    f"provider string, resource_id string, ok boolean, text string, utterances {UTTERANCES}, result struct<utterances:{UTTERANCES}>, "
    f"raw struct<utterances:{UTTERANCES},result:struct<utterances:{UTTERANCES}>>")
WHISPER_SCHEMA = "text string, segments array<struct<text:string,start:double,end:double,words:array<struct<word:string,start:double,end:double>>>>"
COMMENT = "struct<author:string,text:string,time:string,likes:bigint,signal:string>"
VIDEO_SCHEMA = (
    "input string, url string, title string, author string, publishedAt string, collectedAt string, likes bigint, comments_count bigint, "
    f"metrics struct<likes:bigint,comments:bigint,collects:bigint,shares:bigint>, comments array<{COMMENT}>, media_urls array<string>, audio_urls array<string>, video_only_urls array<string>")
EVENT_SCHEMA = "run_id string, at timestamp, stage string, status string, exit_code int, message string, _corrupt_record string"
SUBTITLE_STYLE = "Caption"


def media_of(path_column="_metadata.file_path"):
    """Item id of a file: its name without folders and suffix."""
    return F.regexp_extract(F.col(path_column), r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """Word-timed recogniser files, one item each, to utterances: the first list found at utterances,
    result.utterances, raw.utterances or raw.result.utterances."""
    raw = spark.read.schema(ASR_SCHEMA).json(path, multiLine=True).withColumn("media_id", media_of())
    return utterance_rows(raw)


def utterance_rows(raw: DataFrame) -> DataFrame:
    found = F.coalesce("utterances", "result.utterances", "raw.result.utterances", "raw.utterances")
    u = raw.select("media_id", "provider", F.posexplode(found).alias("utt_pos", "u"))
    return u.select("media_id", "provider", "utt_pos", F.col("u.text").alias("text"), F.col("u.start_time").alias("start_time"), F.col("u.end_time").alias("end_time"), F.col("u.words").alias("words"))


def read_whisper(spark: SparkSession, path: str) -> DataFrame:
    return whisper_rows(spark.read.schema(WHISPER_SCHEMA).json(path, multiLine=True).withColumn("media_id", media_of()))


def whisper_rows(raw: DataFrame) -> DataFrame:
    """``segments`` in seconds to the utterance form in ms; segments without text drop out."""
    kept = F.filter("segments", lambda s: text.clean_ends(s["text"]) != "")
    u = raw.select("media_id", F.posexplode(kept).alias("utt_pos", "s"))
    ms = lambda c: F.bround(c * 1000, 0)
    words = F.transform(F.col("s.words"), lambda w: F.struct(F.trim(w["word"]).alias("text"), ms(w["start"]).alias("start_time"), ms(w["end"]).alias("end_time")))
    return u.select("media_id", "utt_pos", text.clean_ends("s.text").alias("text"), ms(F.col("s.start")).alias("start_time"), ms(F.col("s.end")).alias("end_time"), words.alias("words"))


STAMPED = r"^\[(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)\]\s*(.+)$"


def read_stamped_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumn("media_id", media_of())
    return stamped_rows(raw.withColumnRenamed("value", "text"))


def stamped_rows(df: DataFrame, key: str = "media_id", column: str = "text") -> DataFrame:
    """``[start-end] text`` lines to rows; a text without any becomes one row without times."""
    lines = F.filter(F.transform(F.split(column, r"\r?\n"), text.clean_ends), lambda x: x.rlike(STAMPED))
    row = lambda x: F.struct(
        F.regexp_extract(x, STAMPED, 1).cast("double").alias("start"), F.regexp_extract(x, STAMPED, 2).cast("double").alias("end"), text.clean_ends(F.regexp_extract(x, STAMPED, 3)).alias("text"))
    whole = F.array(F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.col(column).alias("text")))
    rows = F.when(F.size(lines) > 0, F.transform(lines, row)).when(text.clean_ends(column) != "", whole)
    return df.select(key, F.posexplode(rows).alias("pos", "r")).select(key, "pos", "r.*")


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    v = spark.read.schema(VIDEO_SCHEMA).json(path, multiLine=True).withColumn("media_id", media_of())
    return with_default_metadata(v)


def with_default_metadata(videos: DataFrame) -> DataFrame:
    """Fill what a failed collection leaves out: address, title, author, publish time, zero counts, no comments."""
    m = lambda n: F.coalesce(F.col(f"metrics.{n}"), F.col(n) if n == "likes" and "likes" in videos.columns else F.lit(None).cast("bigint"), F.lit(0).cast("bigint")).alias(n)
    source = F.coalesce("input", F.lit(""))
    none = F.array().cast(f"array<{COMMENT}>")
    stem = F.regexp_extract(source, r"([^/]+?)(?:\.[^./]*)?/?$", 1)
    return videos.withColumn("metrics", F.struct(m("likes"), m("comments"), m("collects"), m("shares"))).withColumn(
        "url", F.coalesce("url", F.when(source.rlike("^https?://"), source), F.lit(""))).withColumn(
        "title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem)).withColumn("author", F.coalesce("author", F.lit(""))).withColumn(
        "publishedAt", F.coalesce("publishedAt", F.lit(""))).withColumn("comments", F.coalesce("comments", none))


def comment_rows(videos: DataFrame) -> DataFrame:
    """One row per comment in listed order; an item without comments keeps one empty row."""
    c = videos.select("media_id", F.posexplode_outer("comments").alias("pos", "c"))
    return c.select("media_id", "pos", "c.*")


def event_rows(lines: DataFrame) -> DataFrame:
    """Parse text lines (``value``) of the event log. Parsing is by expression and names all columns, so a torn line is
    known as such whichever columns a query uses."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    e = lines.filter(F.trim("value") != "").select(F.from_json("value", EVENT_SCHEMA, options).alias("e")).select("e.*")
    return e.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSONL event log. A torn line, such as a last line cut short, is left out."""
    return event_rows(spark.read.text(path))


def stream_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream over a folder of JSONL files."""
    return event_rows(spark.readStream.text(folder))


def read_ass(spark: SparkSession, path: str, style: str = SUBTITLE_STYLE) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumn("media_id", media_of())
    return ass_rows(raw.withColumnRenamed("value", "text"), style)


def ass_rows(df: DataFrame, style: str = SUBTITLE_STYLE, key: str = "media_id", column: str = "text") -> DataFrame:
    """Dialogue lines of one style: ten fields, the last one free text with escaped braces."""
    lines = df.select(key, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line")).filter(F.col("line").startswith("Dialogue:"))
    f = lines.withColumn("f", F.split("line", ",", 10)).filter((F.size("f") == 10) & (F.trim(F.col("f")[3]) == style))
    body = F.replace(F.replace(F.col("f")[9], F.lit("\\{"), F.lit("{")), F.lit("\\}"), F.lit("}"))
    return f.select(key, "line_no", numbers.parse_ass_time(F.trim(F.regexp_replace(F.col("f")[1], "^.*:(?=\\d+:\\d+:)", ""))).alias("start_ms"),
                    numbers.parse_ass_time(F.trim(F.col("f")[2])).alias("end_ms"), body.alias("text"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files: frontmatter map, body, title and summary."""
    raw = spark.read.text(path, wholetext=True).withColumn("doc_id", media_of()).withColumnRenamed("value", "text")
    return articles.article_meta(raw)


#: Larger files are fingerprinted as a stream of lines: ``binaryFile`` holds a file in memory, and none above 2 GB.
WHOLE_FILE_BYTES = 16 << 20
#: Suffixes of files that the text reader would unpack.
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd|passthrough)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def fingerprint(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, size and sha256 of files. Files above ``WHOLE_FILE_BYTES`` are streamed, one task each, and may have any size; packed
    ones (``PACKED``) are read whole, so keep those of 2 GB and more out with ``glob``."""

    def files(kind: str):
        r = spark.read.format(kind)
        return r.option("pathGlobFilter", glob) if glob else r

    # Conditions on metadata alone leave files out before they are opened.
    streamed = (F.col("_metadata.file_size") > WHOLE_FILE_BYTES) & ~F.col("_metadata.file_path").rlike(PACKED)
    listed = files("binaryFile").load(path)
    small = listed.filter(~streamed).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = listed.filter(streamed).select("path", F.col("length").alias("size_bytes"), F.col("_metadata.file_path").alias("file_path"))
    most = large.agg(F.max("size_bytes")).first()[0]
    if most is None:
        return small
    # A file is one split, and no other shares its partition, so a task gets its lines in order.
    whole_files = {"spark.sql.files.maxPartitionBytes": most, "spark.sql.files.openCostInBytes": most}
    before = {k: spark.conf.get(k) for k in whole_files}
    try:
        for k, v in whole_files.items():
            spark.conf.set(k, str(v))
        line = F.concat(F.col("value").cast("binary"), F.lit(b"\n"))
        lines = files("text").option("lineSep", "\n").load(path).filter(streamed).select("_metadata.file_path", "_metadata.file_size", line.alias("line"))
        found = stage(lines.mapInArrow(line_digests, "file_path string, sha256 string"), "digests")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return small.unionByName(large.join(found, "file_path").select("path", "size_bytes", "sha256"))


def line_digests(batches):
    """(file_path, sha256) of whole files from rows (file_path, file_size, line), the lines in order, each with its line feed. Their
    size tells whether the last one has a line feed in the file, and whether the reader has left out a byte order mark."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    def done(path, size, n, plain, marked):
        for digest, missing in ((plain, size - n), (marked, size - n - len(BYTE_ORDER_MARK))):
            if missing in (0, -1):
                digest.update(b"\n" * (missing + 1))
                return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["file_path", "sha256"])
        raise ValueError(f"{path}: {n} bytes read, {size} expected")

    at = size = None
    for batch in batches:
        paths, sizes, lines = batch.columns
        if pa.types.is_binary(lines.type):
            lines = lines.cast(pa.large_binary())
        files, begin = pc.run_end_encode(paths), 0
        for end, path in zip(files.run_ends.to_pylist(), files.values.to_pylist()):
            if path != at:
                if at is not None:
                    yield done(at, size, n, *digests)
                at, size, n, digests = path, sizes[begin].as_py(), 0, (hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK))
            part = lines.slice(begin, end - begin)
            offsets = memoryview(part.buffers()[1]).cast("B").cast("q")
            data = memoryview(part.buffers()[2])[offsets[part.offset] : offsets[part.offset + len(part)]]
            for digest in digests:
                # The line feed at the end is written when it is known to be in the file.
                if n:
                    digest.update(b"\n")
                digest.update(data[:-1])
            n += len(data)
            begin = end
    if at is not None:
        yield done(at, size, n, *digests)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Path, size and time of files without reading them: the content column is pruned from the scan."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length", "modificationTime")


def sniff_images(df: DataFrame, content: str = "content", size: str | None = None, max_bytes: int = 1024 * 1024) -> DataFrame:
    """Image type from the first bytes and whether a picture must be converted before upload (too large or not JPEG/PNG)."""
    head = F.hex(F.substring(F.col(content), 1, 12))
    kind = (
        F.when(F.length(head) < 24, F.lit(None).cast("string")).when(head.rlike("^52494646.{8}57454250$"), "image/webp").when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("424D"), "image/bmp"))
    n = F.col(size) if size else F.length(content)
    out = df.withColumn("image_type", kind)
    return out.withColumn("needs_conversion", (n > max_bytes) | ~F.coalesce(F.col("image_type").isin("image/jpeg", "image/png"), F.lit(False)))
