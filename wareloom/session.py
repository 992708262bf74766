"""Shared-folder tables that cut lineage between the stages of a run."""

import re
import tempfile
import uuid

from pyspark.sql import Observation

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark):
    """Folder all executors share, as named by the cluster.

    A machine-local folder is made up only for a local master, where driver and
    executors are one process; anywhere else an unset folder is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wareloom-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


class RunTables:
    """Intermediate parquet tables of one run.

    Written tables survive lost executors, carry real sizes for join planning and
    keep column pruning, which a row-based checkpoint does not.
    """

    def __init__(self, spark, label):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/wareloom/{label}-{uuid.uuid4().hex}"

    def path(self, name):
        return f"{self.root}/{name}"

    def write(self, df, name):
        """Write `df` once and return a DataFrame that reads it back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_counted(self, df, name, counts):
        """Like `write`; also returns the values of the aggregates `counts`, taken by the job that writes."""
        seen = Observation()
        return self.write(df.observe(seen, *counts), name), seen.get

    def drop(self):
        """Delete the run's folder; only after its results are stored elsewhere."""
        delete_path(self.spark, self.root)


def _hadoop_path(spark, path):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark, path):
    fs, hadoop_path = _hadoop_path(spark, path)
    return fs.exists(hadoop_path)


def folder_names(spark, path):
    """Names in a folder; none if it does not exist."""
    if not path_exists(spark, path):
        return []
    fs, hadoop_path = _hadoop_path(spark, path)
    return [entry.getPath().getName() for entry in fs.listStatus(hadoop_path)]


def make_folder(spark, path):
    fs, hadoop_path = _hadoop_path(spark, path)
    fs.mkdirs(hadoop_path)


def delete_path(spark, path):
    fs, hadoop_path = _hadoop_path(spark, path)
    fs.delete(hadoop_path, True)
