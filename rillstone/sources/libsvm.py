"""Sparse examples: the LIBSVM text reader, scans and samples.

An example is a row (seq, label, features): seq orders the stream, features is an
array of (key, value) in the order written, with repeated keys allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import WHITE, normal_label

FEATURES = "array<struct<key:bigint,value:float>>"


def _integer_prefix(text: Column) -> Column:
    return F.try_to_number(F.regexp_extract(text, r"^\+?(-?\d+)", 1), F.lit("S999999999999999999")).cast("bigint")


def parse(lines: DataFrame, line: str = "value", strict: bool = True) -> DataFrame:
    """Adds label and features to a table of lines.

    The label is the line's integer prefix (+1 is 1, 3.7 is 3, -1 becomes 0). A token
    without a colon is both key and value. Blank lines, and tokens that are no
    numbers, are errors in strict mode and dropped otherwise.
    """
    parts = F.filter(F.split(F.col(line), WHITE), lambda t: t != "")
    cut = lines.withColumn("__parts", parts).withColumn("__label", _integer_prefix(F.get("__parts", F.lit(0))))

    def feature(t: Column) -> Column:
        at = F.instr(t, ":")
        name = F.when(at > 0, t.substr(F.lit(1), at - 1)).otherwise(t)
        value = F.when(at > 0, t.substr(at + 1, F.length(t))).otherwise(t)
        key = F.pmod(F.regexp_extract(name, r"^\+?(-?\d+)", 1).try_cast("bigint"), F.lit(1 << 32))
        return F.struct(key.alias("key"), value.try_cast("float").alias("value"))

    rest = F.slice("__parts", 2, F.greatest(F.size("__parts") - 1, F.lit(0)))
    cut = cut.withColumn("features", F.transform(rest, feature))
    wrong = F.col("__label").isNull() | F.exists("features", lambda f: f["key"].isNull() | f["value"].isNull())
    if strict:
        good = F.assert_true(~wrong, F.concat(F.lit("not a LIBSVM line: "), F.col(line)))
        cut = cut.withColumn("features", F.when(good.isNull(), F.col("features")))
    else:
        cut = cut.where("__label is not null").withColumn("features", F.filter("features", lambda f: f["key"].isNotNull() & f["value"].isNotNull()))
    return cut.withColumn("label", normal_label(F.col("__label")).cast("int")).drop("__parts", "__label")


def read_libsvm(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """seq, label, features, place of a text file or folder.

    place (file, seq) is the order of files by name and of lines within a file, which
    `fit` sorts by. seq alone orders the lines of one file: the splits of a file are
    numbered in order, and a line's number holds its partition and place in it.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value", F.input_file_name().alias("file"))
    return parse(lines.withColumn("place", F.struct("file", "seq")), strict=strict).select("seq", "label", "features", "place")


def numbered(rows: DataFrame, by: str, *ties: str, buckets: int = 4096) -> DataFrame:
    """Adds n, the place from 0 in order of the integer column `by` (then `ties`). Rows
    are numbered in ranges of `by`, and the sizes of at most `buckets` ranges, which are
    fixed by its least and greatest value, reach the driver; no task gets all rows."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return rows.withColumn("n", F.lit(None).cast("bigint")).limit(0)
    step = (high - low) // buckets + 1
    ranged = rows.withColumn("__range", F.floor((F.col(by) - low) / step).cast("int"))
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, at = [], 0
    for i in range(buckets):
        before.append(at)
        at += sizes.get(i, 0)
    own = F.row_number().over(Window.partitionBy("__range").orderBy(by, *ties)) - 1
    return ranged.withColumn("n", (own + F.get(F.lit(before), F.col("__range"))).cast("bigint")).drop("__range")


def numbered_lines(examples: DataFrame) -> DataFrame:
    """Adds n, the place from 0 in order of `place` (see `read_libsvm`): lines are counted
    within their split of the file; of each split its size is gathered."""
    file, seq = F.col("place.file"), F.col("place.seq")
    keyed = examples.withColumn("__f", file).withColumn("__s", F.shiftright(seq, 33))
    parts = keyed.groupBy("__f", "__s").agg(F.count("*").alias("n"), F.min(seq).alias("low")).collect()
    rows, at = [], 0
    for r in sorted(parts, key=lambda r: (r["__f"], r["low"])):
        rows.append((r["__f"], r["__s"], at))
        at += r["n"]
    before = examples.sparkSession.createDataFrame(rows, "__f string, __s bigint, __before bigint")
    own = F.row_number().over(Window.partitionBy("__f", "__s").orderBy(seq)) - 1
    return keyed.withColumn("__own", own).join(F.broadcast(before), ["__f", "__s"]).withColumn("n", F.col("__own") + F.col("__before")).drop("__f", "__s", "__own", "__before")


def feature_dim(examples: DataFrame) -> DataFrame:
    return examples.select(F.max(F.array_max(F.transform("features", lambda f: f["key"]))).alias("m")).select((F.coalesce("m", F.lit(-1)) + 1).alias("feature_dim"))


def epochs(examples: DataFrame, n: int) -> DataFrame:
    """The stream scanned n times: rows gain an epoch and sort by (epoch, seq)."""
    return examples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sample_with_replacement(examples: DataFrame, iters: int, index: Column, by: str = "seq") -> DataFrame:
    """`iters` draws: draw i takes the example of number `index` (a column over `i`),
    counted by `by` from 0. Rows gain the draw as epoch 0 and seq i."""
    spark = examples.sparkSession
    draws = spark.range(iters).withColumnRenamed("id", "i").withColumn("__n", index)
    # examples numbered from 0 without gaps join directly; others need a dense rank
    return draws.join(examples.withColumnRenamed(by, "__n"), "__n").withColumnRenamed("i", "draw").withColumnRenamed("__n", by)
