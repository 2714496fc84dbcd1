"""Readers and writers: CSV and TSV, JSON lines, Parquet, manifests, reports, and resumable appends."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: Groups of text columns, tried in turn: the first group with any member in a table is taken. Fixed values.
TEXT_COLUMN_GROUPS = (("source", "target", "reference", "references"), ("original_text", "simplified_text"), ("Sentence",), ("text",), ("L5", "L4", "L3"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """With header, quoted line breaks, doubled quotes and a byte order mark, if there is one."""
    reader = spark.read.options(header=True, multiLine=True, sep=sep, quote='"', escape='"', encoding="UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = False, required: Sequence[str] = ()) -> DataFrame:
    """Blank lines are skipped. strict: malformed lines, and those that lack a required field, raise an error that names
    their files and line numbers; without it a malformed line has nulls, and missing required fields raise their counts.

    A missing `references` becomes an empty array where the schema has one.
    """
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    known = [c for c in df.columns if c != "_corrupt_record"]
    absent = [c for c in required if c not in known]
    if strict and (wrong := _wrong_lines(spark, path, df.select(*known).schema, [c for c in required if c in known])):
        raise ValueError(f"no JSON object with the fields asked: {'; '.join(wrong)}")
    if absent:
        raise ValueError(f"{path} has no field {', '.join(absent)}")
    if required and not strict:
        gaps = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).first()
        bad = {c: gaps[c] for c in required if gaps[c]}
        if bad:
            raise ValueError(f"{path} lacks required fields: {bad}")
    if strict:
        df = df.select(*known)
    if "references" in df.columns and isinstance(df.schema["references"].dataType, ArrayType):
        df = df.withColumn("references", F.coalesce("references", F.array().cast(df.schema["references"].dataType)))
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of each line of text files, blank ones too.

    Files are read in splits. A line's place in its split is counted while it is read; the lines of the splits before it
    in the file are added, so no file goes through a single task.
    """
    place = F.monotonically_increasing_id()  # grows by one a line within a task, which reads a split from start to end
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), "value", place.alias("_place"))
    splits = lines.groupBy("file", "_split").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    starts = splits.select("file", "_split", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(starts, ["file", "_split"]).select("file", (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias("line"), "value")


def _wrong_lines(spark: SparkSession, path: str, schema: StructType, required: Sequence[str], most: int = 5) -> list[str]:
    """The first wrong lines as text; lines are numbered only if there is one."""
    with_corrupt = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json("value", with_corrupt, {"columnNameOfCorruptRecord": "_corrupt"})

    def wrong(lines: DataFrame) -> DataFrame:
        read = lines.where(F.trim("value") != "").withColumn("_read", parsed)
        lacking = F.array_compact(F.array(*(F.when(F.col("_read")[c].isNull(), F.lit(c)) for c in required))) if required else F.array().cast("array<string>")
        why = F.when(F.col("_read").isNull() | F.col("_read._corrupt").isNotNull(), "malformed").when(F.size(lacking) > 0, F.concat(F.lit("without "), F.array_join(lacking, ", ")))
        return read.withColumn("why", why).where("why is not null")

    if wrong(spark.read.text(path)).isEmpty():
        return []
    first = wrong(numbered_lines(spark, path)).select("file", "line", "why").orderBy("file", "line").limit(most).collect()
    return [f"{r['file']}: line {r['line']} {r['why']}" for r in first]


def read_any(spark: SparkSession, path: str, **more) -> DataFrame:
    """By suffix: .parquet, .jsonl, .json, .csv or .tsv."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "jsonl":
        return read_jsonl(spark, path, **more)
    if suffix == "json":
        return spark.read.option("multiLine", True).json(path)
    if suffix in ("csv", "tsv"):
        return read_csv(spark, path, sep="\t" if suffix == "tsv" else ",", **more)
    raise ValueError(f"no reader for {path}")


def text_columns(df: DataFrame) -> list[str]:
    for group in TEXT_COLUMN_GROUPS:
        found = [c for c in group if c in df.columns]
        if found:
            return found
    raise ValueError(f"no text column among {df.columns}")


def sentences(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Every non-empty text of the discovered columns, one a row."""
    parts = [c if not isinstance(df.schema[c].dataType, ArrayType) else None for c in text_columns(df)]
    single = F.array(*(F.col(c).cast("string") for c in parts if c)) if any(parts) else F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c, p in zip(text_columns(df), parts, strict=True) if p is None]
    every = F.concat(single, *lists) if lists else single
    ids = [F.col(row_id)] if row_id else []
    return df.select(*ids, F.explode(every).alias("text")).withColumn("text", F.trim("text")).where(F.length("text") > 0)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = lambda t: isinstance(t, ArrayType | StructType | MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if nested(f.dataType) else F.col(f.name) for f in df.schema))


def write_jsonl(df: DataFrame, path: str, sort_by: str | None = None, single_file: bool = False) -> None:
    """Null fields are kept. A sort is global; one file only for small exports."""
    out = df.orderBy(sort_by) if sort_by else df
    (out.coalesce(1) if single_file else out).write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; missing columns are null and types widen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def append_new(df: DataFrame, path: str, key: str, failed: Column | None = None) -> int:
    """Append to a JSON-lines folder the rows whose key it does not hold; rows that failed before are done again. Returns their number.

    An interrupted run leaves whole files only, so a second run adds what is missing.
    """
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = None
    if done is not None:
        if failed is not None:
            done = done.where(~failed)
        df = df.join(done.select(key).distinct(), key, "left_anti")
    df = df.persist()
    try:
        n = df.count()
        if n:
            df.write.mode("append").option("ignoreNullFields", False).json(path)
        return n
    finally:
        df.unpersist()


def manifest(spark: SparkSession, paths: Sequence[str], previous: DataFrame | None = None) -> DataFrame:
    """file, rows, bytes, sha256 of each file, with `source` carried over from the previous manifest.

    Rows are counted by the readers of read_any(), a job a suffix; files of other suffixes have null. Names must differ.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counts = None
    by_suffix: dict[str, list[str]] = {}
    for p in paths:
        by_suffix.setdefault(p.rsplit(".", 1)[-1].lower(), []).append(p)
    for suffix, group in by_suffix.items():
        if suffix in ("parquet", "jsonl", "json", "csv", "tsv"):
            reader = {"parquet": lambda g: spark.read.parquet(*g), "jsonl": lambda g: spark.read.schema("_line string").json(g), "json": lambda g: spark.read.option("multiLine", True).json(g)}.get(suffix, lambda g, s=suffix: read_csv(spark, g, sep="\t" if s == "tsv" else ","))
            part = reader(group).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
            counts = part if counts is None else counts.unionByName(part)
    known = F.element_at(F.split("file", "[.]"), -1).isin("parquet", "jsonl", "json", "csv", "tsv")
    counted = files.join(counts, "file", "left") if counts is not None else files.withColumn("rows", F.lit(None).cast("long"))
    out = counted.select("file", F.when(known, F.coalesce("rows", F.lit(0))).alias("rows"), "bytes", "sha256")
    return out.join(previous.select("file", "source"), "file", "left") if previous is not None else out


def manifest_differences(files: DataFrame, expected: DataFrame) -> DataFrame:
    """file and difference (missing, extra, changed) of the files that are not as the expected manifest says."""
    both = expected.select("file", F.col("sha256").alias("_wanted")).join(files.select("file", F.col("sha256").alias("_found")), "file", "full")
    kind = F.when(F.col("_found").isNull(), "missing").when(F.col("_wanted").isNull(), "extra").when(F.col("_found") != F.col("_wanted"), "changed")
    return both.select("file", kind.alias("difference")).where("difference is not null")


def verify_manifest(files: DataFrame, expected: DataFrame, extra_allowed: bool = True) -> None:
    """Raise unless every expected file is there with its checksum, and no other file if these are not allowed."""
    bad = manifest_differences(files, expected).where("difference <> 'extra'" if extra_allowed else "true").orderBy("file").limit(20).collect()
    if bad:
        raise ValueError(f"files differ from the manifest: {[f'{r['file']} ({r['difference']})' for r in bad]}")


def report_rows(spark: SparkSession, path: str, section: str, row: str) -> DataFrame:
    """Rows of a printed report: `row` is a pattern of (name, number), `section` of a heading that holds until the next.

    Lines are numbered within the file by one reader, as reports are small.
    """
    # The heading of a line is the last one above it: found within the file's own array of lines.
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    heads = lines.select("lines", F.transform("lines", lambda x: F.regexp_extract(x, section, 1)).alias("heads"))
    rows = heads.select("heads", F.posexplode("lines").alias("n", "line")).where(F.regexp_like("line", F.lit(row)))
    above = F.filter(F.slice("heads", 1, F.col("n") + 1), lambda h: F.length(h) > 0)
    name, value = F.trim(F.regexp_extract("line", row, 1)), F.regexp_extract("line", row, 2).cast("double")
    return rows.select(F.try_element_at(above, F.lit(-1)).alias("section"), name.alias("name"), value.alias("value"))


def prefixed_lines(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(prefix))


def read_store(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """Submissions and baselines from folders of JSON files, with the file's name without suffix as `submission`."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json[l]?$", 1)
    return spark.read.schema(schema).json(list(paths)).withColumn("submission", name)


def eval_rows(df: DataFrame, order: str, source: str, references: Sequence[str], prefix: str, expected: int | None = None) -> DataFrame:
    """Rows of a test file as id, source and references; ids are the prefix and the dense number in file order.

    The number is the count of rows before, by ranges: no row waits for a single task. `order` must be unique. Raises on an unexpected number of rows.
    """
    if expected is not None and (n := df.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Ranges are sampled anew by each job, so the numbered rows are written once, to the folder that executors share.
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
    placed = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.shiftright("_mid", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, at = [], 0
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_p long, _start long"))
    numbered = placed.withColumn("_p", F.shiftright("_mid", 33)).join(starts, "_p")
    place = F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    refs = F.filter(F.array(*(F.trim(F.col(r)) for r in references)), lambda r: F.length(r) > 0)
    return numbered.select(F.concat(F.lit(prefix), place.cast("string")).alias("id"), F.trim(F.col(source)).alias("source"), refs.alias("references"))
