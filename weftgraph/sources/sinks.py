"""Where results go, and how own sources are added: audit reports, metrics for a scraper, and a data source of Spark's for records behind a dotted path."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .paged import PagedSource


def write_audit(rows: DataFrame, folder: str) -> None:
    """The same audit as JSON lines and as CSV with a header, each replaced as a whole."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """(value): lines of the text format from metrics (name, labels map, value, help): a HELP and a TYPE line for each name, then its samples in order; labels are escaped."""
    name = F.regexp_replace("name", r"[^a-zA-Z0-9_:]", "_")
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    tags = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    sample = F.concat(name, tags, F.lit(" "), F.col("value").cast("string"))
    per = metrics.select(name.alias("n"), sample.alias("s"), "help").groupBy("n").agg(F.max("help").alias("h"), F.array_join(F.array_sort(F.collect_list("s")), "\n").alias("b"))
    head = F.concat(F.lit("# HELP "), F.col("n"), F.lit(" "), F.coalesce("h", F.lit("")), F.lit("\n# TYPE "), F.col("n"), F.lit(" gauge\n"))
    return per.orderBy("n").select(F.concat(head, F.col("b")).alias("value"))


def write_textfile(metrics: DataFrame, path: str) -> None:
    """Writes the bounded text of some metrics under another name and renames it, so that a scraper never reads half a file."""
    spark = metrics.sparkSession
    text = "\n".join(r["value"] for r in prometheus_text(metrics).collect()) + "\n"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


class RecordSource(DataSource):
    """``spark.read.format("weft_records")``: rows of JSON lists.  Options: paths (comma between them), records (dotted path of the list), fields (name=path;...)."""

    @classmethod
    def name(cls) -> str:
        return "weft_records"

    def schema(self) -> str:
        return ", ".join(f"`{f.split('=')[0]}` string" for f in self.options["fields"].split(";"))

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


class _RecordReader(DataSourceReader):
    def __init__(self, options):
        self._paths = options["paths"].split(",")
        self._records = options.get("records", "")
        self._fields = [f.split("=", 1)[1] for f in options["fields"].split(";")]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self._paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs as pafs

        from .web import dig

        where = partition.value if re.match(r"[a-z0-9+]+://", partition.value) else f"file://{partition.value}"
        fs, path = pafs.FileSystem.from_uri(where)
        with fs.open_input_stream(path) as f:
            data = dig(json.loads(f.read()), self._records)
        for record in data if isinstance(data, list) else []:
            values = (dig(record, path) for path in self._fields)
            yield tuple(None if v is None else v if isinstance(v, str) else json.dumps(v) for v in values)


def register_sources(spark: SparkSession, group: str = "weftgraph.sources") -> list[str]:
    """Registers the built-in data sources and those that installed packages name under an entry-point group; one that cannot be loaded is left out.  The names."""
    own = (RecordSource, PagedSource)
    for source in own:
        spark.dataSource.register(source)
    names = [source.name() for source in own]
    for point in entry_points(group=group):
        try:
            found = point.load()
        except Exception:  # a plugin of someone else must not stop the others
            continue
        if isinstance(found, type) and issubclass(found, DataSource):
            spark.dataSource.register(found)
            names.append(found.name())
    return names
