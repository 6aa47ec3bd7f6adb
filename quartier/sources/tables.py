"""Table scans and file sources. All give DataFrames; nothing is read on the driver but the first bytes of a file, and those through Spark."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartier.functions import fonts
from quartier.functions import normalize as N

#: Byte-order marks and the encodings they stand for.
MARKS = ((b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"), (b"\xef\xbb\xbf", "UTF-8"))
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(df: DataFrame, text: str, gold: str | None, id_: str | None = None, limit: int | None = None) -> DataFrame:
    """id, raw_address and standard_address of any table; without an id column rows are numbered, and the numbers hold for one reading only."""
    own = F.col(id_) if id_ and id_ in df.columns else F.monotonically_increasing_id()
    out = df.select(own.alias("id"), F.col(text).alias("raw_address"), (F.col(gold) if gold else F.lit(None).cast("string")).alias("standard_address"))
    return out.limit(limit) if limit is not None else out


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct values of a column that aren't null."""
    out = df.filter(F.col(column).isNotNull()).select(column).distinct()
    return out.limit(limit) if limit is not None else out


def encoding_of(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The encoding of text files: that of a byte-order mark, else the first that all lines are valid in.

    windows-1252 is taken where no byte is one that it leaves undefined, ISO-8859-1 fits anything.
    """
    start = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 3).alias("b")).first()
    if start is None:
        return encodings[0]
    for mark, name in MARKS:
        if bytes(start.b).startswith(mark):
            return name
    lines = spark.read.text(path).select(F.col("value").cast("binary").alias("b"))
    bad_utf8 = ~F.is_valid_utf8(F.col("b").cast("string"))
    # a byte read as Latin-1 is the character of its number, so undefined ones can be looked for by a pattern
    undefined = F.decode("b", "ISO-8859-1").rlike("[\\x81\\x8d\\x8f\\x90\\x9d]")
    found = lines.agg(F.coalesce(F.bool_or(bad_utf8), F.lit(False)).alias("UTF-8"), F.coalesce(F.bool_or(undefined), F.lit(False)).alias("windows-1252")).first()
    return next((e for e in encodings if e not in ("UTF-8", "windows-1252") or not found[e]), encodings[-1])


def csv_with_encodings(spark: SparkSession, path: str, schema: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """A CSV source with a header in the encoding that its bytes are valid in; malformed lines are dropped."""
    encoding = encoding_of(spark, path, encodings)
    # Spark reads no windows-1252: its texts are read as Latin-1, from which it differs in 27 letters. UTF-16 has no line breaks that a byte-wise reader finds
    read_as = "ISO-8859-1" if encoding == "windows-1252" else encoding
    df = spark.read.csv(path, schema=schema, header=True, encoding=read_as, mode="DROPMALFORMED", multiLine=encoding == "UTF-16")
    if encoding != "windows-1252":
        return df
    letters = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return df.select(*[N.decoded(F.col(f.name), letters).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def font_csv(spark: SparkSession, path: str, names: Sequence[str], table_: dict[int, str] = fonts.SHEET_FONT) -> DataFrame:
    """A CSV with a header in a legacy font: columns are renamed by place, and texts decoded by the font's table."""
    df = spark.read.csv(path, header=True, encoding="ISO-8859-1")
    df = df.toDF(*names, *df.columns[len(names) :])
    return df.select(*[N.decoded(F.col(c), table_).alias(c) for c in names])


def json_lines(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    """JSON lines, bad ones skipped, and of the others those that a condition holds for."""
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return df if where is None else df.filter(where)


def xml_rows(spark: SparkSession, path: str, schema: str, tag: str = "TABLE") -> DataFrame:
    """A row for each element with a tag, whatever it stands in."""
    return spark.read.schema(schema).option("rowTag", tag).xml(path)


def queue_csv(spark: SparkSession, path: str, columns: str, json_columns: Sequence[str], status: str = "processing_status") -> DataFrame:
    """A CSV for the processing queue: columns of JSON are null where they aren't valid, and a missing status is PENDING."""
    df = spark.read.csv(path, schema=columns, header=True, escape='"', multiLine=True)
    valid = {c: F.when(F.expr(f"try_parse_json(`{c}`)").isNotNull(), F.col(c)) for c in json_columns}
    return df.withColumns(valid | {status: F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("PENDING"))})


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table by JDBC, read in ranges of a number column where its bounds are given. The driver's jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def cloned(df: DataFrame, path: str) -> DataFrame:
    """A copy of a table as Parquet, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeded(df: DataFrame, path: str, name: str, type_name: str) -> DataFrame:
    """A master table written anew, its names without their types."""
    return cloned(df.withColumn(name, N.unit_name(F.col(name), F.col(type_name))), path)


def new_tasks(tasks: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Tasks whose text isn't known yet, each text once, by the least id."""
    once = tasks.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min_by(F.struct(*[c for c in tasks.columns if c != text]), "id").alias("r"))
    return once.join(known.select(text), text, "left_anti").select(text, "r.*").select(*tasks.columns)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; where that is unset, in a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
