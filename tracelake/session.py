"""Session settings and table access shared by all queries."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "tracelake", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application: they need it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "tracelake_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def use_utc(spark: SparkSession) -> None:
    """TIMESTAMP_NTZ values mean UTC; casts to instants go through the session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    use_utc(spark)
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def still_there(spark: SparkSession, path: str) -> bool:
    """Whether a written table has not been deleted meanwhile."""
    files, where = file_system(spark, path)
    return files.exists(where)


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every file of a table: another tuple once any of them is written anew."""
    files, where = file_system(spark, path)
    found, out = files.listFiles(where, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); unset is an error but on a local master, where one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tracelake/{spark.sparkContext.applicationId}"


def kept_folder(spark: SparkSession, name: str) -> str:
    """A named folder of the application in the shared folder, for what its queries share and extend."""
    files, where = file_system(spark, _own_folder(spark))
    files.deleteOnExit(where)
    return f"{_own_folder(spark)}/{name}"


def write_shared(df: DataFrame) -> str:
    """Write rows to the shared folder; the application's tables there are deleted when its JVM ends."""
    spark = df.sparkSession
    folder = _own_folder(spark)
    files, where = file_system(spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    files.deleteOnExit(where)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts the lineage, survives a lost executor."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df))


def clean_shared(spark: SparkSession) -> None:
    """Remove all tables of this application from the shared folder; results not yet read need them."""
    from tracelake.plans import traces

    traces.forget()
    files, where = file_system(spark, _own_folder(spark))
    files.delete(where, True)
