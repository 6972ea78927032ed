"""Table schemas (fixed values: column names, order and types of the data model)."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "s": T.StringType(), "d": T.DoubleType(),
             "D": T.DateType(), "b": T.BooleanType()}
    fields = []
    for item in spec.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


PANEL = _struct(
    "inforce_yy:i inforce_mm:i policy:s policy_expiry_date:D client_tenure_days:i "
    "vehicle_no:s vehicle_vin:s vehicle_type:s model_year:i driver_no:s "
    "driver_license_no:s driver_name:s driver_type:s assignment_type:s "
    "exposure_factor:d driver_age:i premium_rate:d premium_paid:d")

FAMILIES = _struct(
    "family_id:s family_type:s adults:i teens:i vehicles:i max_vehicles:i start_date:D status:s")
POLICIES = _struct(
    "policy_no:s family_id:s start_date:D current_expiry_date:D premium_paid:d "
    "client_tenure_days:i family_type:s status:s")
VEHICLES = _struct(
    "vehicle_no:s family_id:s vin:s vehicle_type:s model_year:i effective_date:D status:s "
    "removal_date:D")
DRIVERS = _struct(
    "driver_no:s family_id:s license_no:s driver_license_no:s driver_name:s driver_type:s age:i "
    "age_at_issuance:i birthday:D effective_date:D status:s")
ASSIGNMENTS = _struct(
    "assignment_id:s family_id:s vehicle_no:s driver_no:s assignment_type:s exposure_factor:d "
    "effective_date:D end_date:D status:s annual_premium_rate:d annual_premium_paid:d")
CHANGES_LOG = _struct(
    "change_type:s date:D family_id:s reason:s vehicle_no:s vehicle_type:s old_vehicle_type:s "
    "new_vehicle_type:s coverage_gap:b tenure_reset:b driver_no:s driver_name:s policy_no:s "
    "old_expiry_date:D new_expiry_date:D")

MASTERS = {
    "families": FAMILIES,
    "policies": POLICIES,
    "vehicles": VEHICLES,
    "drivers": DRIVERS,
    "assignments": ASSIGNMENTS,
    "changes_log": CHANGES_LOG,
}

PANEL_COLUMNS = PANEL.fieldNames()
POLICY_MONTH = ["policy", "inforce_yy", "inforce_mm"]
