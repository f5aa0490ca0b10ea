"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from importlib import resources
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Class loaders by application and name of a compiled class.
_compiled: dict[tuple[str, str], JavaObject] = {}
#: Long texts make batches of the default sizes a burden: Arrow's on both sides, and the
#: Parquet reader's in the executors' heaps.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application, and
    bound the batches of rows where the session does not say otherwise."""
    sc = spark.sparkContext
    for key, most in BATCHES.items():
        if not sc.getConf().contains(key):
            spark.conf.set(key, most)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.suffix != ".zip" and root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="rillstone-")) / "rillstone.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"rillstone/{f.relative_to(root)}")
        sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def compiled(spark: SparkSession, name: str) -> JavaObject:
    """A loader of the Java class in operators/{name}.java, which Spark's own compiler
    (Janino) compiles and all executors get, once for each application."""
    sc = spark.sparkContext
    at = sc.applicationId, name
    if at not in _compiled:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(resources.files("rillstone.operators").joinpath(f"{name}.java").read_text())
        path = Path(tempfile.mkdtemp(prefix="rillstone-")) / f"{name}.jar"
        with zipfile.ZipFile(path, "w") as z:
            for made, code in compiler.getBytecodes().items():
                z.writestr(made.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(str(path))
        _compiled[at] = compiler.getClassLoader()
    return _compiled[at]


def kernel(spark: SparkSession, name: str, *args: str) -> JavaObject:
    """A new object of a compiled class."""
    sc = spark.sparkContext
    given = sc._gateway.new_array(sc._jvm.Object, len(args))
    for i, x in enumerate(args):
        given[i] = x
    return compiled(spark, name).loadClass(f"rillstone.{name}").getConstructors()[0].newInstance(given)


def local_files(spark: SparkSession) -> dict[str, str]:
    """Options of a writer by which files in a local folder are made without starting a
    process for each (see LocalFiles.java). Other stores take no notice."""
    loader = compiled(spark, "LocalFiles")
    spark._jsc.hadoopConfiguration().setClassLoader(loader)
    return {"fs.file.impl": "rillstone.LocalFiles", "fs.file.impl.disable.cache": "true"}


def map_rows(rows: DataFrame, run: JavaObject, schema: str) -> DataFrame:
    """Each partition's rows through a kernel, in their order."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.spark.sql.types.StructType.fromDDL(schema)
    return DataFrame(rows._jdf.mapPartitions(run, jvm.org.apache.spark.sql.Encoders.row(kind)), spark)
