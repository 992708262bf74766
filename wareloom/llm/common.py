"""Small helpers the corpus operators share."""

import os
import tempfile
import zipfile
from pathlib import Path

import wareloom
from wareloom.session import RunTables

# ASCII white space as the word pattern [^\x20\x09-\x0D]+ has it; bytes.split() cuts at the same characters.
SPACES = b" \t\n\r\x0b\x0c"


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_tables(df, label):
    """Intermediate tables in the shared checkpoint folder; they cut lineage and survive lost executors."""
    ship_code(df.sparkSession)
    return RunTables(df.sparkSession, label)


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text):
    """Words of a whole text as UTF-8 bytes; no text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ship_code(spark):
    """Send the package to the Python workers once per context, for clusters where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_wareloom_shipped", False):
        return
    package = Path(wareloom.__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="wareloom-code-"), "wareloom.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._wareloom_shipped = True
