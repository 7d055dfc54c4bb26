"""Export and import of rows as text: CSV, JSON lines, and plain dumps with COPY blocks. Bytes are written as hex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TYPES, TableSchema


def _plain(df: DataFrame, nested_as_json: bool) -> DataFrame:
    """df with bytes as small hex, and with nested values as JSON text where asked."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.lower(F.hex(c))
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        elif nested_as_json and isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes are doubled; null is an empty cell and an empty string a quoted one."""
    _plain(df, True).write.option("header", "true").option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    _plain(df, False).write.option("ignoreNullFields", "false").json(path)


def _typed(text: Column, kind: str) -> Column:
    """A cell as a value of a column type, null where it is not one."""
    if kind == "str":
        return text
    if kind == "bytes":
        return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))
    if kind == "bool":
        return F.when(F.lower(text).isin("true", "t"), True).when(F.lower(text).isin("false", "f"), False)
    return text.try_cast(TYPES[kind])


def coerce(cells: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of string columns named as the schema's: a reject keeps its cells as JSON, with the reason.

    An empty cell is null where the column may be null and is no string.
    """
    reason, values = F.lit(None).cast("string"), []
    for c in schema.columns:
        text = F.col(f"`{c.name}`")
        if c.type != "str" and c.nullable:
            text = F.when(text != "", text)
        v = _typed(text, c.type)
        needed = not c.nullable or c.name == schema.primary_key
        reason = F.coalesce(reason, F.when(text.isNotNull() & v.isNull(), F.lit(f"{c.name} is no {c.type}")), F.when(text.isNull(), F.lit(f"{c.name} is missing")) if needed else F.lit(None))
        values.append(v.cast(TYPES[c.type]).alias(c.name))
    marked = cells.withColumn("__reason", reason)
    return marked.filter("__reason is null").select(*values), marked.filter("__reason is not null").select(F.to_json(F.struct(*[F.col(f"`{n}`") for n in schema.names])).alias("row"), F.col("__reason").alias("reason"))


def import_csv(spark: SparkSession, path: str, schema: TableSchema, *, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). Strings keep empty cells as empty strings."""
    strings = T.StructType([T.StructField(n, T.StringType()) for n in [*schema.names, "__corrupt"]])
    cells = spark.read.schema(strings).option("header", str(header).lower()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").option("columnPruning", "false").option("quote", '"').option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)
    read = F.coalesce(F.length(F.col(f"`{schema.names[0]}`")), F.lit(0)) >= 0  # always; Spark reads no file for the corrupt column alone
    rows, rejects = coerce(cells.filter(F.col("__corrupt").isNull() & read).drop("__corrupt"), schema)
    return rows, rejects.unionByName(cells.filter(F.col("__corrupt").isNotNull() & read).select(F.col("__corrupt").alias("row"), F.lit("the number of cells differs").alias("reason")))


def import_jsonl(spark: SparkSession, path: str, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects), by name; a missing name is null."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("__v", F.try_parse_json("value"))
    good = parsed.filter(F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)))
    bad = parsed.filter(~F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)))
    cells = good.select(*[F.get_json_object("value", f"$['{n}']").alias(n) for n in schema.names])
    rows, rejects = coerce(cells, schema)
    return rows, rejects.unionByName(bad.select(F.col("value").alias("row"), F.lit("no JSON object").alias("reason")))


_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v"))


def copy_cell(cell: Column) -> Column:
    """A cell of COPY text: \\N is null, backslashes escape."""
    held = F.replace(cell, F.lit("\\\\"), F.lit("\0"))
    for escaped, plain in _ESCAPES:
        held = F.replace(held, F.lit(escaped), F.lit(plain))
    return F.when(cell != "\\N", F.replace(held, F.lit("\0"), F.lit("\\")))


def import_copy(lines: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of lines (value) of COPY text, cells parted by tabs, without the closing \\."""
    cells = lines.filter((F.col("value") != "") & (F.col("value") != "\\.")).select("value", F.split("value", "\t", -1).alias("c"))
    whole = F.size("c") == len(schema.columns)
    rows, rejects = coerce(cells.filter(whole).select(*[copy_cell(F.col("c")[i]).alias(n) for i, n in enumerate(schema.names)]), schema)
    return rows, rejects.unionByName(cells.filter(~whole).select(F.col("value").alias("row"), F.lit("the number of cells differs").alias("reason")))


def dump_blocks(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(value): the lines of a table's COPY blocks in plain dump files. A block lies within one file; each file is read by one task, line by line."""
    def run(batches):
        import pyarrow as pa

        inside, last = False, None
        for batch in batches:
            out = []
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if file != last:
                    inside, last = False, file
                words = line.split()
                if not inside and words[:1] == ["COPY"] and len(words) > 1 and words[1].split("(")[0].split(".")[-1].strip('"') == table and line.rstrip().endswith("FROM stdin;"):
                    inside = True
                elif inside and line == "\\.":
                    inside = False
                elif inside:
                    out.append(line)
            yield pa.record_batch([pa.array(out, pa.string())], ["value"])

    whole = spark.read.option("wholetext", "false").option("lineSep", "\n").text(path)
    numbered = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    return numbered.repartition("file").sortWithinPartitions("file", "block", "n").select("file", "value").mapInArrow(run, "value string")
