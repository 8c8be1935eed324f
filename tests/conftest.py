import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from figmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "4g", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one column over one row of inputs."""

    def evaluate(build, **inputs):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return row.select(build.alias("out")).first()["out"]

    return evaluate
