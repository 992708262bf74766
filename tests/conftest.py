import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from wareloom.schemas import CAPTURES, column_names  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def captures(spark):
    """Build a captures table from dictionaries; text bodies are encoded."""
    defaults = dict(
        status_code=200, status_text="200 OK", content_type="", content_encoding="", fetch_error=None, delay_ms=0,
        duration_ms=0, batch_id=0, seq=0, body=b"", final_url=None,
    )

    def build(*rows):
        filled = []
        for place, row in enumerate(rows):
            values = {**defaults, "seq": place, **row}
            body = values["body"]
            values["body"] = body.encode() if isinstance(body, str) else body
            filled.append(tuple(values[name] for name in column_names(CAPTURES)))
        return spark.createDataFrame(filled, CAPTURES)

    return build


@pytest.fixture
def run_dir(tmp_path):
    return str(tmp_path)
