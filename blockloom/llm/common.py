"""What the corpus operators share: names, the word rule and the place for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the runs of other characters than these, the ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns of the given names under others, and the way back for withColumnsRenamed."""
    clash = [c for c in docs.columns if c.lower() in names]
    new = fresh(docs, *clash)
    return docs.withColumnsRenamed(dict(zip(clash, new, strict=True))), dict(zip(new, clash, strict=True))


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Point the context at the cluster's checkpoint folder; where none is named, a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="blockloom-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, as Spark writes its paths."""
    ready_to_checkpoint(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed now and cut from its lineage, in files that outlive any executor."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: for rows too large to checkpoint uncompressed, and for what dropped() can delete."""
    path = f"{shared_folder(df.sparkSession)}/blockloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _files(df.sparkSession, path, "deleteOnExit")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what written() has put down, where nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            _files(df.sparkSession, path, "delete", True)


def _files(spark: SparkSession, path: str, call: str, *more: bool) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), call)(at, *more)


#: Rows of one key above which looked_up() sends the key's value to all tasks, and how many keys can have so many at most.
HOT_ROWS, HOT_KEYS = 500, 50_000


def looked_up(df: DataFrame, key: str, values: DataFrame, n: int | None = None) -> DataFrame:
    """df with the columns of values, whose rows are unique in key; null where values has none.

    df is read twice, so it should be written or checkpointed; n is its number of rows. Keys with over n / HOT_KEYS rows
    (and over HOT_ROWS) cannot be more than HOT_KEYS, so their values are broadcast and their rows stay where
    they are. The others are joined by key, and no key brings a task more rows than that.
    """
    least = max(HOT_ROWS, (df.count() if n is None else n) // HOT_KEYS)
    often = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(key)
    hot = checkpointed(often.join(values, key, "left"))
    if hot.isEmpty():
        return df.join(values, key, "left")
    added = [c for c in values.columns if c != key]
    hot = F.broadcast(hot)
    many = df.join(hot, key).select(*df.columns, *added)
    return df.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key, "left").select(*df.columns, *added).unionByName(many)
