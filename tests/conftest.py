import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from monthmark.schema import PANEL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("monthmark-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "6g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def panel_of(spark):
    """A panel from dicts; columns not given are filled with plain values."""
    from datetime import date

    plain = {"inforce_yy": 2018, "inforce_mm": 1, "policy": "00000001",
             "policy_expiry_date": date(2019, 1, 1), "client_tenure_days": 10,
             "vehicle_no": "01", "vehicle_vin": "VIN1", "vehicle_type": "Sedan",
             "model_year": 2015, "driver_no": "01", "driver_license_no": "L1",
             "driver_name": "A B", "driver_type": "adult", "assignment_type": "primary",
             "exposure_factor": 1.0, "driver_age": 40, "premium_rate": 100.0,
             "premium_paid": 100.0}

    def build(rows):
        data = [tuple({**plain, **r}[f.name] for f in PANEL) for r in rows]
        return spark.createDataFrame(data, PANEL)

    return build
