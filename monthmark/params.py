"""Rating, exposure and calendar parameters.

All values live on the driver: they are the knobs of a run, a few dozen numbers, and
are turned into column expressions or small factor tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Default rating tables.
DEFAULT_AGE_FACTORS = {
    16: 2.5, 17: 2.3, 18: 2.1, 19: 1.9, 20: 1.7, 21: 1.5, 22: 1.3, 23: 1.2,
    24: 1.1, 25: 1.0, 30: 0.95, 35: 0.9, 40: 0.85, 45: 0.8, 50: 0.75, 55: 0.7,
    60: 0.65, 64: 0.6, 65: 0.65, 70: 0.75, 75: 0.85, 80: 1.0, 85: 1.2,
}
DEFAULT_VEHICLE_FACTORS = {
    "Sedan": 1.0, "Hatchback": 0.95, "Wagon": 0.95, "Crossover": 1.05, "SUV": 1.1,
    "Truck": 1.15, "Minivan": 1.05, "Coupe": 1.2, "Convertible": 1.3, "Sports Car": 1.5,
}
DEFAULT_ROLE_FACTORS = {"primary": 1.0, "secondary": 0.5}
DEFAULT_MULTI_VEHICLE_DISCOUNTS = {1: 0.0, 2: 0.1, 3: 0.15, 4: 0.2}


@dataclass(frozen=True)
class Exposures:
    """Exposure shares (fixed values)."""

    primary_solo: float = 1.0
    primary_shared: float = 0.6
    secondary_adult: float = 0.5
    teen_secondary: float = 0.35
    teen_primary: float = 1.0


@dataclass(frozen=True)
class Params:
    """Everything an operator may need beside its input tables."""

    start: date = date(2018, 1, 1)
    end: date = date(2025, 6, 30)
    base_amount: float = 1500.0
    minimum_premium: float = 100.0
    inflation: float = 0.05
    base_year: int = 2018
    as_of_year: int = 2024
    teen_max_age: int = 24
    max_drivers_per_vehicle: int = 3
    term_days: int = 365
    tolerance: float = 0.01
    age_factors: dict = field(default_factory=lambda: dict(DEFAULT_AGE_FACTORS))
    vehicle_factors: dict = field(default_factory=lambda: dict(DEFAULT_VEHICLE_FACTORS))
    role_factors: dict = field(default_factory=lambda: dict(DEFAULT_ROLE_FACTORS))
    multi_vehicle_discounts: dict = field(
        default_factory=lambda: dict(DEFAULT_MULTI_VEHICLE_DISCOUNTS))
    exposures: Exposures = Exposures()

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    @property
    def vehicle_types(self) -> list[str]:
        return sorted(self.vehicle_factors)


def params_from_dict(conf: dict) -> Params:
    """Build Params from a nested configuration mapping (the YAML layout of a run)."""
    base = Params()
    span = conf.get("date_range", {})
    money = conf.get("policies", {}).get("premium", {})
    calc = money.get("calculation", {})
    assign = conf.get("driver_assignment", {})
    start = span.get("start_date", base.start)
    end = span.get("end_date", base.end)
    as_date = lambda v: v if isinstance(v, date) else date.fromisoformat(str(v))
    start, end = as_date(start), as_date(end)
    return Params(
        start=start,
        end=end,
        base_amount=float(money.get("base_amount", base.base_amount)),
        inflation=float(money.get("annual_inflation_rate", base.inflation)),
        max_drivers_per_vehicle=int(
            assign.get("max_drivers_per_vehicle", base.max_drivers_per_vehicle)),
        age_factors={int(k): float(v)
                     for k, v in calc.get("driver_age_factors", base.age_factors).items()},
        vehicle_factors={str(k): float(v) for k, v in
                         calc.get("vehicle_type_factors", base.vehicle_factors).items()},
        role_factors={str(k): float(v)
                      for k, v in calc.get("driver_type_factors", base.role_factors).items()},
        multi_vehicle_discounts={
            int(k): float(v) for k, v in
            calc.get("multi_vehicle_discounts", base.multi_vehicle_discounts).items()},
        exposures=Exposures(**assign.get("exposure_allocations", {})),
    )


def load_params(path: str, spark: SparkSession | None = None) -> Params:
    """Read Params from a YAML file (JSON is YAML); needs PyYAML.

    With a session Spark reads the path, which may then be in any store or be a folder of one file.
    """
    try:
        import yaml
    except ImportError as exc:  # optional dependency
        raise RuntimeError("reading YAML parameters needs PyYAML") from exc
    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    return params_from_dict(yaml.safe_load(text) or {})


def factor_table(spark: SparkSession, factors: dict, key: str, key_type: str) -> DataFrame:
    """A parameter mapping as a (key, factor) DataFrame."""
    return spark.createDataFrame(list(factors.items()), f"{key} {key_type}, factor double")
