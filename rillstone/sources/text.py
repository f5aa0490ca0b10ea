"""Text sources and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite, tokens


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc, line, tokens of text files; a line is a sentence. `paths` may be one string
    of paths between white space; files that don't exist are skipped."""
    names = paths.split() if isinstance(paths, str) else list(paths)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(conf).globStatus(path)
        if found:
            there.append(name)
    if not there:
        return spark.createDataFrame([], "doc string, line bigint, tokens array<string>")
    lines = spark.read.text(there)
    return lines.select(F.input_file_name().alias("doc"), F.monotonically_increasing_id().alias("line"), tokens(F.col("value")).alias("tokens"))


def lines_of(table: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, line, tokens of a column of texts cut at newlines."""
    return table.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "value")).select("doc", "line", tokens(F.col("value")).alias("tokens"))


def token_rows(lines: DataFrame) -> DataFrame:
    return lines.select("doc", "line", F.posexplode("tokens").alias("pos", "token"))


def report(params: dict, results: dict[str, Column], source: DataFrame) -> DataFrame:
    """One row with the JSON document {params, results}; NaN and infinities are null.
    `results` are columns over the one-row table `source`."""
    types = dict(source.select(*[c.alias(k) for k, c in results.items()]).dtypes)
    shown = [(finite(c) if types[k] in ("double", "float") else F.transform(c, finite) if types[k] in ("array<double>", "array<float>") else c).alias(k) for k, c in results.items()]
    fixed = [F.lit(v).alias(k) for k, v in params.items()]
    return source.select(F.to_json(F.struct(F.struct(*fixed).alias("params"), F.struct(*shown).alias("results")), {"ignoreNullFields": "false"}).alias("json"))
