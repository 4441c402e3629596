"""Reading sources by URI, writing exports, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File formats by ending.
FORMATS = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "avro": "avro"}
#: Names of export formats, in any case -> format and, of text, its header and
#: separator.  JSON is one array of objects, JSONEachRow an object a line.
EXPORTS = {
    "parquet": ("parquet",), "orc": ("orc",), "json": ("array",), "jsoneachrow": ("json",), "ndjson": ("json",), "csv": ("csv", "false", ","), "csvwithnames": ("csv", "true", ","), "tsv": ("csv", "false", "\t"), "tsvwithnames": ("csv", "true", "\t"),
    "tabseparated": ("csv", "false", "\t"), "tabseparatedwithnames": ("csv", "true", "\t"),
}
#: The format of an export that only its ending tells; .json files hold an object
#: a line, as Spark reads them.
BY_ENDING = {"parquet": "parquet", "csv": "csvwithnames", "tsv": "tsvwithnames", "json": "jsoneachrow", "jsonl": "jsoneachrow", "ndjson": "jsoneachrow", "orc": "orc"}
SCHEMES = {"s3://": "s3a://", "gs://": "gs://", "azure://": "abfss://"}


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df into the shared folder and read it back; cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ending(uri: str) -> str:
    return uri.rstrip("/").rsplit(".", 1)[-1].lower() if "." in uri.rsplit("/", 1)[-1] else ""


def read_source(spark: SparkSession, uri: str, options: dict | None = None) -> DataFrame:
    """A frame from a source URI: files by ending, lakehouse tables by prefix,
    `table_function:` as SQL, `view:` as a table or view."""
    options = dict(options or {})
    if uri.startswith("table_function:"):
        return spark.sql(uri.removeprefix("table_function:"))
    if uri.startswith("view:"):
        return spark.table(uri.removeprefix("view:"))
    for kind in ("iceberg", "delta"):
        if uri.startswith(f"{kind}+"):
            return spark.read.format(kind).options(**options).load(uri.removeprefix(f"{kind}+").removeprefix("local://"))
    for old, new in SCHEMES.items():
        if uri.startswith(old):
            uri = new + uri.removeprefix(old)
    kind = options.pop("format", None) or FORMATS.get(ending(uri), "parquet")
    if kind == "csv":
        options = {"header": "true", "inferSchema": "true", "sep": "\t" if ending(uri) == "tsv" else ","} | options
    return spark.read.format(kind).options(**options).load(uri)


def write_export(df: DataFrame, dest: str, fmt: str | None = None, options: dict | None = None, mode: str = "overwrite") -> str:
    """Write a result.  The format is given or told by the ending."""
    options = {k: str(v) for k, v in (options or {}).items()}
    name = fmt.lower().replace("_", "") if fmt else BY_ENDING.get(ending(dest), "parquet" if not ending(dest) else "")
    if name not in EXPORTS:
        raise ValueError(f"unknown export format {fmt or ending(dest)!r}")
    kind, *text = EXPORTS[name]
    if text:
        options = {"header": text[0], "sep": text[1]} | options
    if kind == "array":
        def framed(batches):
            """One array over all rows, streamed: an object a line."""
            head = "["
            for b in batches:
                for i in range(0, b.num_rows, 1000):
                    lines = b.column(0).slice(i, 1000).drop_null().to_pylist()
                    if not lines:
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([(head if k == 0 else ",") + x for k, x in enumerate(lines)])], ["value"])
                    head = ","
            yield pa.RecordBatch.from_arrays([pa.array(["[]" if head == "[" else "]"])], ["value"])

        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        end = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # there is a task even for no rows
        rows.union(end).coalesce(1).mapInArrow(framed, "value string").write.options(**options).mode(mode).text(dest)
        return dest
    df.write.format(kind).options(**options).mode(mode).save(dest)
    return dest
