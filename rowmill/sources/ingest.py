"""From raw files to repaired source records: line scan, delimiter choice, record assembly, field repair, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import SOURCE_COLUMNS
from ..functions.ids import ID_PATTERN, record_id
from ..functions.text import blank, clean_field, csv_fields, field_counts, let, sanitize_line, split_quoted
from .assembly import CHUNK, line_records

WIDTH, MAX_LINES = 12, 10
DELIMITERS = [",", ";", "\t", "|"]
#: Fixed value: what the repair takes for a link.
LINK = r"(?i)(?:https?://|www\.|[a-zA-Z0-9-]+\.(?:ru|рф|com|org|net|su|by|kz|io))"


def read_strings(spark: SparkSession, paths, schema=None) -> DataFrame:
    """CSV with every column as text; blank is null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(paths)
    return df.select([blank(f"`{x}`").alias(x) for x in df.columns])


def scan_dir(spark: SparkSession, globs, exclude=(), fmt: str = "csv", **options) -> DataFrame:
    """All files that match, with `source_file`, but for those with an excluded part in their path."""
    df = spark.read.format(fmt).options(header=True, **options).load(globs).withColumn("_path", F.col("_metadata.file_path"))
    for part in exclude:
        df = df.where(~F.arrays_overlap(F.split(F.lower("_path"), "/"), F.array(F.lit(part.lower()))))
    return df.withColumn("source_file", F.element_at(F.split("_path", "/"), -1)).drop("_path")


def scan_lines(spark: SparkSession, paths) -> DataFrame:
    """(source_file, line_no, line) of text files, numbered from 1 in each file.

    Files are read in blocks. A block's lines are numbered by the order in which its task reads them, and start after the
    lines of the blocks before.
    """
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.option("lineSep", "\n").text(paths).select(place.alias("at"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return number_lines(lines.select("at.path", "at.block", "_id", "line")).withColumn("source_file", F.element_at(F.split("path", "/"), -1)).select("source_file", "line_no", "line")


def number_lines(lines: DataFrame, file: str = "path", block: str = "block", order: str = "_id") -> DataFrame:
    """lines with line_no from 1 in each file; a block's lines are ordered by `order`, blocks by number. No task gets more than a block."""
    counts = lines.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(file, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = lines.withColumn("_in", F.row_number().over(Window.partitionBy(file, block).orderBy(order)))
    return inside.join(offsets, [file, block]).withColumn("line_no", (F.col("_before") + F.col("_in")).cast("long")).drop("_in", "_before")


def score_delimiters(lines: DataFrame, max_lines: int = 50) -> DataFrame:
    """(source_file, delimiter, score): how steadily each delimiter cuts a file's first lines into about the expected fields."""
    head = lines.where(F.trim("line") != "").withColumn("_i", F.row_number().over(Window.partitionBy("source_file").orderBy("line_no"))).where(F.col("_i") <= max_lines)
    counted = head.select("source_file", F.posexplode(field_counts("line", DELIMITERS)).alias("_order", "n"))
    near = F.count_if((F.col("n") >= 2) & (F.col("n") <= WIDTH + 10))
    score = (near * 10 - (F.max("n") - F.min("n")) + F.avg("n")).alias("score")
    return counted.groupBy("source_file", "_order").agg(score).withColumn("delimiter", F.get(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("_order")))


def best_delimiter(scores: DataFrame) -> DataFrame:
    return scores.groupBy("source_file").agg(F.max_by("delimiter", F.struct("score", -F.col("_order"))).alias("delimiter"))


def assemble_records(lines: DataFrame, delimiter: str = ",", expected: int = WIDTH, max_lines: int = MAX_LINES, chunk: int = CHUNK) -> DataFrame:
    """(source_file, record_no, physical_line, raw_line): physical lines joined until the quotes close, enough delimiters are met, or `max_lines` is reached. Chunks of a file are walked apart; blank records have no number and are left out."""
    begun = line_records(lines, delimiter, expected, max_lines, chunk)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # max_lines at most
    joined = lines.join(begun, ["source_file", "line_no"]).groupBy("source_file", "physical_line").agg(F.min("record_no").alias("record_no"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("raw_line"))
    return joined.where(F.regexp_replace("raw_line", r"(?U)\s", "") != "").select("source_file", "record_no", "physical_line", "raw_line")


def parse_fields(raw, delimiter: str = ",") -> Column:
    """Fields of a record: as a strict CSV reader takes it, without escapes or else with them, else split outside quotes."""
    parsed = let(sanitize_line(raw), lambda t: F.when((t != "") & ~t.contains('"') & ~t.contains("\n"), F.split(t, F.lit("\\Q" + delimiter + "\\E"), -1)).otherwise(F.coalesce(csv_fields(t, delimiter), csv_fields(t, delimiter, escape=True), split_quoted(t, delimiter))))
    return F.transform(parsed, lambda x: clean_field(x))


def _between(a: Column, first: Column, last: Column) -> Column:
    """Elements first..last, from 1; empty where there are none."""
    n = F.greatest(last - first + 1, F.lit(0))
    return F.when(n > 0, F.slice(a, first, n)).otherwise(F.array().cast("array<string>"))


def repair_fields(fields, delimiter: str = ",") -> Column:
    """struct<fields, reason>: exactly 12 fields. The id is the anchor: what is too much before it belongs to the official name, what is too much after it to description or source, around the link."""
    f = F.col(fields) if isinstance(fields, str) else fields
    n = F.size(f)
    has = F.transform(f, lambda x: F.coalesce(x, F.lit("")).rlike(ID_PATTERN))
    at = F.array_position(has, True).cast("int")
    inn = F.regexp_extract(F.get(f, at - 1), ID_PATTERN, 1)
    before, after = _between(f, F.lit(1), at - 1), _between(f, at + 1, n)
    nb, na = at - 1, n - at
    join = lambda a: F.array_join(a, delimiter)
    pad = lambda k: F.array_repeat(F.lit(""), F.greatest(k, F.lit(0)))
    prefix = F.when(nb > 5, F.concat(F.slice(before, 1, 4), F.array(join(_between(before, F.lit(5), nb))))).otherwise(F.concat(pad(5 - nb), before))
    tail = _between(after, F.lit(4), na)
    nt = na - 3
    link = F.array_position(F.transform(tail, lambda x: F.coalesce(x, F.lit("")).rlike(LINK)), True).cast("int")
    around = F.array(join(_between(tail, F.lit(1), link - 1)), F.get(tail, link - 1), join(_between(tail, link + 1, nt)))
    no_link = F.array(join(_between(tail, F.lit(1), nt - 2)), F.get(tail, nt - 2), F.get(tail, nt - 1))
    suffix = F.when(na > 6, F.concat(F.slice(after, 1, 3), F.when(link > 0, around).otherwise(no_link))).otherwise(F.concat(after, pad(6 - na)))
    count = n.cast("string")
    by_anchor = F.struct(F.transform(F.concat(prefix, F.array(inn), suffix), lambda x: clean_field(x)).alias("fields"), F.concat(F.lit("repaired_by_inn_anchor_needs_review_original_cols="), count).alias("reason"))
    merged = F.struct(F.concat(F.slice(f, 1, WIDTH - 1), F.array(join(_between(f, F.lit(WIDTH), n)))).alias("fields"), F.concat(F.lit("merged_excess_into_source_original_cols="), count).alias("reason"))
    padded = F.struct(F.concat(f, pad(WIDTH - n)).alias("fields"), F.concat(F.lit("padded_missing_fields_original_cols="), count).alias("reason"))
    return F.when(n == WIDTH, F.struct(f.alias("fields"), F.lit("parsed_exactly").alias("reason"))).when(at > 0, by_anchor).when(n > WIDTH, merged).otherwise(padded)


def drop_headers(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Records without each file's first row, if it is a header: at least half of the column names in place."""
    names = F.array(*[F.lit(x) for x in SOURCE_COLUMNS])
    same = F.size(F.filter(F.zip_with(fields, names, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    marked = records.withColumn("_header", same >= 6)
    first = F.min(F.when(F.col("_header"), F.col("record_no"))).over(Window.partitionBy("source_file"))
    return marked.withColumn("_first", first).where("not (_header and record_no = _first)").drop("_header", "_first")


def classify_parse(df: DataFrame) -> DataFrame:
    reason = F.col("parse_reason")
    return df.withColumn("parse_status", F.when(reason.contains("needs_review"), "repaired_needs_review").when(reason.contains("parsed_exactly"), "exact").otherwise("repaired"))


def repair_records(records: DataFrame, delimiter: str = ",") -> DataFrame:
    """Source records with provenance from assembled raw records."""
    parsed = records.withColumn("fields", parse_fields("raw_line", delimiter)).withColumn("_r", repair_fields("fields", delimiter))
    parsed = parsed.withColumns({"fields": F.col("_r.fields"), "parse_reason": F.col("_r.reason")}).drop("_r")
    df = classify_parse(drop_headers(parsed))
    df = df.withColumns({x: F.nullif(F.get("fields", F.lit(i)), F.lit("")) for i, x in enumerate(SOURCE_COLUMNS)}).withColumnRenamed("record_no", "source_row_no")
    df = df.withColumn("record_id", record_id("source_file", "source_row_no", "INN", "Sector", "Industry", "Subindustry"))
    return df.select(*SOURCE_COLUMNS, "record_id", "source_file", "source_row_no", "physical_line", "parse_status", "parse_reason", "raw_line")


def ingest_audit(df: DataFrame) -> DataFrame:
    """Records of each file by parse status."""
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("parse_status") == s).alias(s) for s in ("exact", "repaired", "repaired_needs_review")])


def record_audit(df: DataFrame) -> DataFrame:
    """One row for each logical record: where it stood, how its repair went and why, and the id it got."""
    return df.select("source_file", "source_row_no", "physical_line", F.col("parse_status").alias("status"), F.col("parse_reason").alias("reason"), "record_id", F.substring("raw_line", 1, 500).alias("line_start"))
