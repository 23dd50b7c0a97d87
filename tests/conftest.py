import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from occugrid.session import get_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "occugrid-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF_DIR}/events.parquet'")
    return connection


@pytest.fixture
def make_features(spark):
    """Feature table from (row_id, lat, lon, taxon_id) records."""
    from occugrid import schemas
    from occugrid.plans import feature_build

    def build(records, taxa=None):
        frame = spark.createDataFrame(records, schemas.OBSERVATIONS)
        names = spark.createDataFrame(taxa, schemas.TAXA) if taxa else None
        return feature_build.train_features(frame, taxa=names)

    return build
