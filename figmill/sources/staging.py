"""Tables written to the shared folder of the cluster.

Staging cuts lineage in a way that survives lost executors, computes a result that
several branches need only once, and gives Spark the true size of the table, so it
broadcasts small sides and sort-merges large ones without a hint.
"""

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a scratch folder in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="figmill-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(_written(df, label))


def _written(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/figmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)  # nothing is left behind when the application ends
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """Path for a table in the shared folder, gone when the application ends."""
    parent = f"{shared_folder(spark)}/figmill-{label}-{uuid.uuid4().hex}"
    files, place = _files(spark, parent)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{parent}/data"


def removed(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is not there."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    return [entry.getPath().getName() for entry in files.listStatus(place)]


def moved(spark: SparkSession, renames: list[tuple[str, str]]) -> None:
    """Rename files, given by their escaped locations, making the folders they go to. Only names
    change hands, not data. The file system and the classes are looked up once, not for every file."""
    if not renames:
        return
    files, _ = _files(spark, renames[0][1])
    jvm, made = spark.sparkContext._jvm, set()
    place, address = jvm.org.apache.hadoop.fs.Path, jvm.java.net.URI
    for old, new in renames:
        parent = new.rpartition("/")[0]
        if parent not in made:
            files.mkdirs(place(parent))
            made.add(parent)
        if not files.rename(place(address(old)), place(new)):
            raise OSError(f"Could not rename '{old}' to '{new}'.")


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path as it wants it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def changed_at(spark: SparkSession, folder: str) -> int:
    """Latest change of a folder's tables, so that a rewritten source is staged anew."""
    files, place = _files(spark, folder)
    if not files.exists(place):
        return 0
    return max((entry.getModificationTime() for entry in files.listStatus(place)), default=0)


_TABLES: dict[tuple, tuple] = {}


def stage_once(spark: SparkSession, label: str, folder: str, build) -> DataFrame:
    """Stage a table derived from a folder the first time an application asks for it, then
    reuse it until the folder's tables change."""
    full = (spark.sparkContext.applicationId, label, folder, changed_at(spark, folder))
    if full in _TABLES:
        schema, path = _TABLES[full]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass  # The folder was cleaned meanwhile.
    df = build()
    _TABLES[full] = (df.schema, _written(df, label))
    schema, path = _TABLES[full]
    return spark.read.schema(schema).parquet(path)
