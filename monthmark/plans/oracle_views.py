"""DuckDB texts of the fixture views, used as CTEs by the oracle queries."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name: str, text: str, needs: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (text.strip(), needs)


view("fx_base", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS od,
       CAST(year(o_orderdate) AS INT) AS inforce_yy,
       CAST(month(o_orderdate) AS INT) AS inforce_mm,
       lpad(CAST(o_custkey AS VARCHAR(20)), CAST(greatest(length(CAST(o_custkey AS VARCHAR(20))), 8) AS INTEGER), '0') AS policy,
       concat('FAM', lpad(CAST(o_custkey AS VARCHAR(20)), CAST(greatest(length(CAST(o_custkey AS VARCHAR(20))), 6) AS INTEGER), '0')) AS family_id,
       min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS start_date,
       lpad(CAST(l_partkey % 2 + 1 AS VARCHAR(20)), 2, '0') AS vehicle_no,
       lpad(CAST(l_suppkey % 2 + 1 AS VARCHAR(20)), 2, '0') AS driver_no,
       l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
       l_returnflag, p_type, p_size, s_name
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
""")

view("fx_panel", """
SELECT inforce_yy, inforce_mm, policy,
       start_date + 365 AS policy_expiry_date,
       CAST(datediff('day', start_date, last_day(od)) AS INT) AS client_tenure_days,
       vehicle_no,
       concat('VIN', lpad(CAST(l_partkey AS VARCHAR(20)), CAST(greatest(length(CAST(l_partkey AS VARCHAR(20))), 14) AS INTEGER), '0')) AS vehicle_vin,
       p_type AS vehicle_type,
       CAST(1970 + p_size AS INT) AS model_year,
       driver_no,
       concat('LIC', lpad(CAST(l_suppkey AS VARCHAR(20)), CAST(greatest(length(CAST(l_suppkey AS VARCHAR(20))), 6) AS INTEGER), '0')) AS driver_license_no,
       s_name AS driver_name,
       CASE WHEN 15 + l_quantity <= 24 THEN 'teen' ELSE 'adult' END AS driver_type,
       CASE l_returnflag WHEN 'R' THEN 'primary' WHEN 'A' THEN 'secondary_adult'
            ELSE 'secondary_teen' END AS assignment_type,
       CAST(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.35 END AS DOUBLE)
            AS exposure_factor,
       CAST(15 + l_quantity AS INT) AS driver_age,
       l_extendedprice AS premium_rate,
       CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(CASE l_returnflag
            WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.5 ELSE 0.35 END AS DECIMAL(4,2)), 2) AS DOUBLE)
            AS premium_paid
FROM fx_base
""", ("fx_base",))

view("fx_policies", """
SELECT policy AS policy_no, family_id, start_date,
       start_date + 365 AS current_expiry_date,
       round(sum(l_extendedprice), 2) AS premium_paid,
       CASE WHEN max(od) < DATE '2001-01-01' THEN 'cancelled' ELSE 'active' END AS status,
       max(od) AS last_date
FROM fx_base
GROUP BY policy, family_id, start_date
""", ("fx_base",))

view("fx_changes_log", """
SELECT 'policy_cancellation' AS change_type, last_date + 45 AS date, family_id,
       CAST(NULL AS VARCHAR(2)) AS vehicle_no, 'all_vehicles_removed' AS reason
FROM fx_policies WHERE status = 'cancelled'
UNION ALL
SELECT 'vehicle_removal', max(od), family_id, vehicle_no, 'sale'
FROM fx_base WHERE vehicle_no = '02' AND o_custkey % 5 = 0
GROUP BY family_id, vehicle_no
""", ("fx_base", "fx_policies"))

view("fx_vehicles", """
SELECT vehicle_no, family_id,
       concat('VIN', lpad(CAST(min(l_partkey) AS VARCHAR(20)), CAST(greatest(length(CAST(min(l_partkey) AS VARCHAR(20))), 14) AS INTEGER), '0')) AS vin,
       min(p_type) AS vehicle_type,
       CAST(1970 + min(p_size) AS INT) AS model_year,
       min(od) AS effective_date,
       CASE WHEN vehicle_no = '02' AND o_custkey % 5 = 0 THEN 'removed' ELSE 'active' END AS status,
       CASE WHEN vehicle_no = '02' AND o_custkey % 5 = 0 THEN max(od) END AS removal_date
FROM fx_base
GROUP BY vehicle_no, family_id, o_custkey
""", ("fx_base",))

view("fx_drivers", """
SELECT driver_no, family_id,
       concat('LIC', lpad(CAST(min(l_suppkey) AS VARCHAR(20)), CAST(greatest(length(CAST(min(l_suppkey) AS VARCHAR(20))), 6) AS INTEGER), '0')) AS license_no,
       min(s_name) AS driver_name,
       CASE WHEN 16 + (o_custkey * 7 + CAST(driver_no AS INT) * 31) % 70 <= 24
            THEN 'teen' ELSE 'adult' END AS driver_type,
       CAST(16 + (o_custkey * 7 + CAST(driver_no AS INT) * 31) % 70 AS INT) AS age_at_issuance,
       CAST(17 + (o_custkey * 7 + CAST(driver_no AS INT) * 31) % 70 AS INT) AS age,
       make_date(CAST(1995 - (16 + (o_custkey * 7 + CAST(driver_no AS INT) * 31) % 70) AS INT),
                 CAST(1 + o_custkey % 12 AS INT), CAST(1 + o_custkey % 28 AS INT)) AS birthday,
       min(od) AS effective_date, 'active' AS status
FROM fx_base
GROUP BY driver_no, family_id, o_custkey
""", ("fx_base",))

view("fx_assignments", """
SELECT concat('ASS', a.family_id, a.vehicle_no, a.driver_no) AS assignment_id,
       a.family_id, a.vehicle_no, a.driver_no,
       CASE WHEN a.driver_no = '01' THEN 'primary'
            WHEN d.age_at_issuance <= 24 THEN 'secondary_teen'
            ELSE 'secondary_adult' END AS assignment_type,
       CAST(CASE WHEN a.driver_no = '01' THEN 1.0
            WHEN d.age_at_issuance <= 24 THEN 0.35 ELSE 0.5 END AS DOUBLE) AS exposure_factor,
       a.effective_date, a.end_date,
       CASE WHEN a.end_date IS NULL THEN 'active' ELSE 'removed' END AS status,
       a.annual_premium_paid
FROM (SELECT b.family_id, b.vehicle_no, b.driver_no, b.od AS effective_date, n.next_od AS end_date,
             round(sum(b.l_extendedprice), 2) AS annual_premium_paid
      FROM fx_base b
      JOIN (SELECT family_id, od, lead(od) OVER (PARTITION BY family_id ORDER BY od) AS next_od
            FROM (SELECT DISTINCT family_id, od FROM fx_base) x) n
        ON b.family_id = n.family_id AND b.od = n.od
      GROUP BY b.family_id, b.vehicle_no, b.driver_no, b.od, n.next_od) a
JOIN fx_drivers d ON a.family_id = d.family_id AND a.driver_no = d.driver_no
""", ("fx_base", "fx_drivers"))

# Change flags in their plain form: sorted sets, compared with the previous present month.
view("ov_sets", """
SELECT policy, inforce_yy, inforce_mm,
       coalesce(string_agg(DISTINCT vehicle_no || '_' || driver_no, ','
                ORDER BY vehicle_no || '_' || driver_no), '') AS items
FROM fx_panel GROUP BY policy, inforce_yy, inforce_mm
""", ("fx_panel",))

view("ov_flags", """
SELECT policy, inforce_yy, inforce_mm,
       coalesce(items <> lag(items) OVER (PARTITION BY policy ORDER BY inforce_yy, inforce_mm),
                false) AS major_change
FROM ov_sets
""", ("ov_sets",))

view("ov_flagged", """
SELECT p.*, f.major_change FROM fx_panel p
JOIN ov_flags f USING (policy, inforce_yy, inforce_mm)
""", ("fx_panel", "ov_flags"))


def _ordered(names, seen):
    for name in names:
        if name in seen:
            continue
        yield from _ordered(VIEWS[name][1], seen)
        if name not in seen:
            seen.append(name)
            yield name


def with_views(sql: str) -> str:
    """Prepend the views a text mentions as CTEs."""
    sql = sql.strip()
    used = [name for name in VIEWS if name in sql]
    ctes = [f"{name} AS (\n{VIEWS[name][0]}\n)" for name in _ordered(used, [])]
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.upper().startswith(head):
            return head + ",\n".join([*ctes, sql[len(head):].lstrip()])
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql
