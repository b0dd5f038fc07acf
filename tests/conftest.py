import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


from weftline.session import spark_session  # noqa: E402

# made here, so that tests can write Columns in their parameters
SESSION = spark_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def value(spark):
    """The value of a Column over one row."""

    def get(column, **row):
        row = row or {"_": 1}
        schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items())
        return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]

    return get
