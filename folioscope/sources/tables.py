"""Reading the project's tables, and the two dirt rules that hold for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has so few files that most would idle; the same rows either way. A table of many files isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df


def sent_once(df: DataFrame, key: str) -> DataFrame:
    """Drop rows that were sent again.

    A repeat is the whole row under the same id, with only a later load time, so any of
    them may be kept. Select the columns needed before calling: the row is shuffled.
    Rows whose id is null are all kept, as nothing says that they are one row.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key!r} among {df.columns}")
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.filter(F.col(key).isNull()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, for what all executors must see.

    Where none is set, a temporary one, made once, if driver and executors are one process;
    on a cluster that would be a folder of one machine, so there an error is raised.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="folioscope-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by files that all executors share, in shared_folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as Parquet in shared_folder, which takes less room than a checkpoint's files where rows are wide."""
    from uuid import uuid4

    folder = f"{shared_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
