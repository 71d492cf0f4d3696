"""JSON records in three layouts, with a stable ``row_idx`` in input order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import not_blank
from spanlake.operators.staging import written
from spanlake.schema import SPAN_ARRAY
from spanlake.sources.documents import document_items

LINES, DOCUMENT, AUTO = "lines", "document", "auto"


# --------------------------------------------------------------------------- layout and order
def with_row_idx(lines: DataFrame, name: str = "row_idx") -> DataFrame:
    """0-based input position for rows read from files (``_file``, ``_block`` columns present).

    Spark packs file splits by size, so ``monotonically_increasing_id`` alone is not input
    order.  Inside one split it is gapless: position = id - first id of the split + rows
    of all earlier splits.  Two parallel passes, no sort.
    """
    rows = lines.withColumn("_mid", F.monotonically_increasing_id())
    splits = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    placed = _placed(rows, splits, F.col("_mid") - F.col("_first"), name)
    return placed.drop("_mid", "_first")


def _placed(rows: DataFrame, splits: DataFrame, inside: Column, name: str) -> DataFrame:
    """Position ``inside`` a split after the rows of all splits before it.

    ``splits`` has one row per input split, fewer than the file listing that Spark keeps on the driver to read
    the path at all, so it is broadcast whatever its size.
    """
    run = W.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(run), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(offsets), ["_file", "_block"]).withColumn(name, F.col("_off") + inside).drop("_off")


def _raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _text_lines(spark: SparkSession, paths: str | Sequence[str], skip_blank: bool = True) -> DataFrame:
    raw = _raw_lines(spark, paths)
    return with_row_idx(raw.filter(not_blank(F.col("value"))) if skip_blank else raw, "_line")


def file_layouts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, layout) of every file that has a line: ``lines`` or ``document``, each file by itself.

    A file whose first non-blank line starts an array, or an object that does not end there, can only be one document;
    any other file is read line by line.  Whatever does not fit its layout is an error when it is read, so a wrong
    guess never drops a record.
    """
    lines = _raw_lines(spark, paths).filter(not_blank(F.col("value"))).withColumn("_mid", F.monotonically_increasing_id())
    first = lines.groupBy("_file").agg(F.min_by(F.trim("value"), F.struct("_block", "_mid")).alias("v"))
    whole = F.col("v").startswith("[") | (F.col("v").startswith("{") & ~_one_value(F.col("v")))
    return first.select(F.col("_file").alias("file"), F.when(whole, DOCUMENT).otherwise(LINES).alias("layout"))


def _one_value(text: Column) -> Column:
    """Is the text exactly one JSON value?  The JSON functions stop after a first value; between brackets, what follows it
    makes the text invalid or a longer array."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce((F.json_array_length(boxed) == 1) & F.try_parse_json(boxed).isNotNull(), F.lit(False))


def _inferred(spark: SparkSession, paths: str | Sequence[str]) -> T.StructType:
    found = spark.read.option("mode", "PERMISSIVE").json(paths).schema
    return T.StructType([f for f in found.fields if f.name != "_corrupt_record"])


def _merged(schemas: Sequence[T.StructType]) -> T.StructType:
    """All fields by name; the first one's type counts."""
    known: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            known.setdefault(f.name, f)
    return T.StructType(list(known.values()))


def _records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None, layout: str) -> tuple[DataFrame, T.StructType]:
    """(_file, row_idx, value) with one JSON object per row, and its schema."""
    lines = whole = None
    if layout == LINES:
        lines = path
    elif layout == DOCUMENT:
        items, counts = document_items(spark, path)
    else:
        layouts = written(file_layouts(spark, path), "file-layouts")
        whole = layouts.filter(F.col("layout") == DOCUMENT)
        if whole.isEmpty():
            lines = path
        else:
            items, counts = document_items(spark, path, whole)
    if schema is None:
        parts = [_inferred(spark, path)] if layout != DOCUMENT else []
        if not lines:  # the names of these files: a schema should be given for millions of them
            names = [r.file for r in whole.select("file").collect()] if whole is not None else path
            found = spark.read.option("multiLine", True).json(names).schema
            parts.insert(0, T.StructType([f for f in found.fields if f.name != "_corrupt_record"]))
        schema = _merged(parts)
    if lines:
        return _text_lines(spark, path).withColumnRenamed("_line", "row_idx").drop("_block"), schema
    rows = items.select("_file", F.lit(0).cast("long").alias("_block"), "value", F.col("item").alias("_mid"))
    sizes = counts.select("_file", F.lit(0).cast("long").alias("_block"), F.col("items").alias("_n"), F.lit(0).cast("long").alias("_first"))
    if whole is not None and not layouts.filter(F.col("layout") == LINES).isEmpty():
        lines = _raw_lines(spark, path).filter(not_blank(F.col("value"))).withColumn("_mid", F.monotonically_increasing_id())
        lines = lines.join(whole.select(F.col("file").alias("_file")), "_file", "left_anti")
        rows = rows.unionByName(lines)
        sizes = sizes.unionByName(lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    placed = _placed(rows, sizes, F.col("_mid") - F.col("_first"), "row_idx")
    return placed.select("_file", "row_idx", "value"), schema


def _parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``r``: the parsed record; a row that is no JSON object raises."""
    bad = T.StructField("_bad", T.StringType())
    parsed = rows.withColumn("r", F.from_json("value", T.StructType([*schema.fields, bad]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    alone = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit("]"))) == 1
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{") | ~F.coalesce(alone, F.lit(False))
    message = F.concat(F.lit("invalid JSON in row "), (F.col("row_idx") + 1).cast("string"), F.lit(" of "), F.col("_file"))
    return parsed.withColumn("r", F.when(wrong, F.raise_error(message)).otherwise(F.col("r")))


# --------------------------------------------------------------------------- readers
def read_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                 layout: str = AUTO, keep_raw: bool = False) -> DataFrame:
    """JSON lines, JSON arrays and single JSON objects as rows with ``row_idx``; the files of a path may differ.

    Blank lines are skipped.  Without ``schema`` one extra pass infers it; give it for large
    inputs, and ``layout="lines"`` where all files are, which saves the pass that finds the layouts.  ``keep_raw`` adds the
    record's JSON as ``_raw``, which tells an absent key from a null one later.  A line that is no
    JSON object, and a document file with anything but one array or object, raise.
    """
    rows, schema = _records(spark, path, schema, layout)
    checked = _parsed(rows, schema)
    return checked.select("row_idx", *([F.col("value").alias("_raw")] if keep_raw else []),
                          *[F.col("r")[f.name].alias(f.name) for f in schema.fields])


def bad_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, line_no, problem) of lines that are not a JSON object; line numbers start at 1 per file."""
    lines = _text_lines(spark, path, skip_blank=False)
    first = lines.groupBy("_file").agg(F.min("_line").alias("_base"))  # one row per file
    return _line_problems(lines).join(first, "_file").select(
        F.col("_file").alias("file"), (F.col("_line") - F.col("_base") + 1).alias("line_no"), "problem")


def _line_problems(lines: DataFrame) -> DataFrame:
    kind = F.when(~_one_value(F.col("value")), "invalid JSONL") \
            .when(~F.trim("value").startswith("{"), "not a JSON object")
    return lines.withColumn("problem", kind).filter(not_blank(F.col("value")) & F.col("problem").isNotNull())


def read_records_strict(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """JSON lines only; the first bad lines are named in the error.

    One check over the lines before any record is returned (a parse to a variant, no numbering); only if it finds
    something are line numbers worked out.
    """
    if not _line_problems(_raw_lines(spark, path)).isEmpty():
        bad = bad_lines(spark, path).orderBy("file", "line_no").limit(5).collect()
        raise ValueError("; ".join(f"{b.file}: {b.problem} at line {b.line_no}" for b in bad))
    return read_records(spark, path, schema, layout=LINES)


def read_many(spark: SparkSession, pattern: str, schema: T.StructType | None = None,
              layout: str = LINES) -> tuple[DataFrame, DataFrame]:
    """(records with ``file``, per-file counts) over a glob, files in name order."""
    rows, schema = _records(spark, pattern, schema, layout)
    rows = _parsed(rows, schema).select("row_idx", F.col("_file").alias("file"), *[F.col("r")[f.name].alias(f.name) for f in schema.fields])
    return rows, rows.groupBy("file").agg(F.count(F.lit(1)).alias("input_rows"))


def ground_truth_violations(df: DataFrame) -> Column:
    """Reason why a row is no valid ground truth, or NULL (columns ``text`` and raw ``spans``)."""
    bad_at = F.array_position(F.transform(F.col("spans"), _span_problem_flag), True) - 1
    at = lambda: F.get(F.col("spans"), bad_at.cast("int"))
    incomplete = at()["start"].try_cast("int").isNull() | at()["end"].try_cast("int").isNull() | at()["label"].isNull()
    return (F.when(~not_blank(F.col("text")), F.lit("missing non-empty 'text'"))
            .when(F.col("spans").isNull(), F.lit("missing list field 'spans'"))
            .when(bad_at >= 0, F.concat(
                F.lit("span["), bad_at.cast("string"),
                F.when(incomplete, F.lit("] missing start/end/label"))
                .otherwise(F.lit("] has invalid range")))))


def _span_problem_flag(s: Column) -> Column:
    start, end = s["start"].try_cast("int"), s["end"].try_cast("int")
    return F.coalesce(start.isNull() | end.isNull() | s["label"].isNull() | (end <= start), F.lit(True))


RAW_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("start", "end", "label")]))


def read_ground_truth(spark: SparkSession, path: str, on_error: str = "raise", layout: str = AUTO) -> DataFrame:
    """Rows with non-blank ``text`` and typed ``spans``.

    ``on_error``: ``raise`` fails on the first bad row naming row and span index, ``quarantine``
    keeps every row and adds the ``problem`` column.
    """
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", RAW_SPAN),
                           T.StructField("sample_id", T.StringType())])
    rows = read_records(spark, path, schema, layout)
    rows = rows.withColumn("problem", ground_truth_violations(rows))
    typed = rows.withColumn("spans", F.transform("spans", lambda s: F.struct(
        s["start"].try_cast("int").alias("start"), s["end"].try_cast("int").alias("end"),
        s["label"].alias("label"))).cast(SPAN_ARRAY))
    if on_error == "quarantine":
        return typed
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(
        F.lit("row "), (F.col("row_idx") + 1).cast("string"), F.lit(": "), F.col("problem"))).cast("string"))
    return typed.withColumn("text", F.coalesce(checked, F.col("text"))).drop("problem")


# --------------------------------------------------------------------------- sample ids
def with_sample_id(df: DataFrame, name: str = "sample_id") -> DataFrame:
    """Fill missing sample ids with ``sample_{row_idx}``."""
    made = F.concat(F.lit("sample_"), F.col("row_idx").cast("string"))
    given = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return df.withColumn(name, F.coalesce(given, made))


def duplicate_ids(df: DataFrame, name: str = "sample_id") -> DataFrame:
    """Sample ids given to more than one record: they will share a leakage group."""
    return (df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))
