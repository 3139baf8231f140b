"""Oracle SQL of the scalar-function, load, change, audit, backfill and token queries."""

from __future__ import annotations

from fleetbook.functions.periods import DATE_RE, MONTH_NAMES, MONTH_RE, WEEK_RE
from fleetbook.plans.oracle import ENTRY_LIST, FALLBACK, LABEL, S, Z, oracle  # noqa: F401
from fleetbook.plans.params import OWNER, SQL_DRIVER, SQL_MONTH

AS_OF_DAY, AS_OF_WEEK, AS_OF_MONTH = "1997-03-05", "1997-W10", "1997-03"


# --- SQL macros (DuckDB) -------------------------------------------------------

# Stated here, not imported: the number a text begins with, and the blanks that trimming removes.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"


def TRIM(t: str) -> str:
    return f"trim({t}, {BLANKS})"


def PARSE(t: str) -> str:
    tt = TRIM(t)
    x = f"(CASE WHEN contains({tt}, ',') THEN replace(replace({tt}, '.', ''), ',', '.') ELSE {tt} END)"
    number = f"NULLIF(regexp_extract({x}, '{NUMBER}', 0), '')"
    return (f"(CASE WHEN {number} IS NULL THEN CAST(0 AS DECIMAL(12,2)) "
            f"ELSE TRY_CAST(ROUND(TRY_CAST({number} AS DECIMAL(38,18)), 2) AS DECIMAL(12,2)) END)")


def PINT(t: str) -> str:
    return f"COALESCE(TRY_CAST(regexp_extract({TRIM(t)}, '^[+-]?[0-9]+', 0) AS BIGINT), 0)"


def VALID(t: str, pattern: str, default: str) -> str:
    return f"(CASE WHEN {t} IS NOT NULL AND regexp_matches({t}, '{pattern}') THEN {t} ELSE '{default}' END)"


def ENUM(t: str, allowed: tuple[str, ...], default: str) -> str:
    lst = ", ".join(f"'{a}'" for a in allowed)
    return f"(CASE WHEN {t} IN ({lst}) THEN {t} ELSE '{default}' END)"


def WS(w: str) -> str:
    """Monday of ISO week text ``YYYY-Www`` (weeks roll over)."""
    return (f"(CAST(date_trunc('week', make_date(CAST(substr({w}, 1, 4) AS INT), 1, 4)) AS DATE)"
            f" + (CAST(substr({w}, 7, 2) AS INT) - 1) * 7)")


def MONTH_LABEL(d: str) -> str:
    names = ", ".join(f"'{n}'" for n in MONTH_NAMES)
    return f"([{names}][month({d})] || ' ' || CAST(year({d}) AS VARCHAR))"


def NUM(x: str, decimals: int) -> str:
    if decimals == 0:
        return f"translate(format('{{:,}}', CAST(ROUND({x}, 0) AS BIGINT)), ',', '.')"
    return f"translate(format('{{:,.{decimals}f}}', CAST(ROUND({x}, {decimals}) AS DOUBLE)), ',.', '.,')"


# --- stand-in batches (same derivations as fleetbook.sources.standins) ---------

ENTRY_FORMS = """
SELECT l_orderkey * 10 + l_linenumber AS form_seq,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_linenumber <= 3 THEN ta.id
       ELSE CAST(l_orderkey % (SELECT COUNT(*) FROM customer) + 1 AS BIGINT) END AS posted_by,
  CASE WHEN l_returnflag = 'R' THEN 'week' WHEN l_returnflag = 'A' THEN 'day' ELSE 'daily' END AS period_type_text,
  CASE WHEN l_linenumber = 7 THEN substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 8) || '31'
       WHEN l_linenumber = 6 THEN 'ayer' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS entry_date_text,
  CAST(YEAR(l_shipdate) AS VARCHAR) || '-W' || lpad(CAST(l_linenumber * 8 AS VARCHAR), 2, '0') AS entry_week_text,
  CAST(l_suppkey + 1 AS VARCHAR) AS driver_id_text,
  CASE WHEN l_linenumber = 5 THEN '' WHEN l_linenumber <= 3 THEN CAST(d.owner_user_id + l_partkey // 5 * 5 AS VARCHAR)
       ELSE CAST(l_partkey + 2 AS VARCHAR) END AS car_id_text,
  ' ' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS gross_text,
  replace(CAST(CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)) AS VARCHAR), '.', ',') AS app_text,
  '' AS cash_text,
  CAST(CAST(l_quantity * 1000 AS BIGINT) AS VARCHAR) AS rental_text,
  CAST(CAST(l_quantity * 10 AS BIGINT) AS VARCHAR) || 'abc' AS fuel_text,
  CAST(l_quantity AS VARCHAR) AS km_text,
  CASE WHEN l_linestatus = 'F' THEN 'invoiced' ELSE 'facturado' END AS status_text,
  '  ' || l_returnflag || ' ' AS observations_text
FROM lineitem LEFT JOIN drivers d ON d.id = l_suppkey + 1
LEFT JOIN (SELECT owner_user_id, MIN(id) AS id FROM users WHERE role = 'admin' GROUP BY 1) ta ON ta.owner_user_id = d.owner_user_id"""

EXPENSE_FORMS = """
SELECT o_orderkey + 1 AS form_seq, o_custkey + 1 AS posted_by,
  CASE WHEN o_orderstatus = 'P' THEN '01/02/1997' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS expense_date_text,
  CASE WHEN o_orderpriority = '5-LOW' THEN '0'
       WHEN o_orderpriority = '3-MEDIUM' THEN replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',')
       ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS amount_text,
  ' ' || o_orderpriority || ' ' AS observations_text
FROM orders"""

DRIVER_FORMS = """
SELECT c_custkey + 1 AS form_seq, c_custkey + 1 AS posted_by, '  ' || c_name || ' ' AS full_name_text,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(30000000 + c_custkey % 97 AS VARCHAR) END AS dni_text,
  CASE WHEN c_acctbal < 100 THEN 'inactive' ELSE 'activo' END AS status_text
FROM customer"""

CAR_FORMS = """
SELECT p_partkey + 1 AS form_seq, p_partkey * 13 % (SELECT COUNT(*) FROM customer) + 1 AS posted_by,
  ' ' || p_brand AS brand_text,
  CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS model_text,
  ' p' || CAST(p_partkey AS VARCHAR) || ' ' AS plate_text,
  CASE WHEN p_size > 40 THEN '' ELSE CAST(1990 + p_size AS VARCHAR) END AS year_text,
  CASE WHEN p_size % 3 = 0 THEN 'inactive' ELSE 'active' END AS status_text
FROM part"""

TOKEN_DETAILS = """
SELECT event_id AS id,
  CASE WHEN event_type = 'error' THEN upper(substr(sha256(CAST(event_id AS VARCHAR)), 1, 24))
       ELSE substr(sha256(CAST(event_id AS VARCHAR)), 1, 24) END AS selector,
  CASE WHEN event_type = 'view' THEN props ELSE sha256(CAST(event_id AS VARCHAR)) END AS token_hash,
  repeat(event_type || CASE WHEN event_id % 3 = 0 THEN ' ñ€😀 ' ELSE ' ' END, 40) AS user_agent,
  repeat(props, 5) AS ip_address
FROM events"""

SPOILT = "(car_id * 7 + driver_id + dayofyear(entry_date))"
IMPORTED = f"""
SELECT * REPLACE (
  CASE WHEN {SPOILT} % 50 = 0 THEN 1000000 + driver_id ELSE driver_id END AS driver_id,
  CASE WHEN {SPOILT} % 70 = 1 THEN 1000000 + car_id % 97 ELSE car_id END AS car_id,
  CASE WHEN {SPOILT} % 90 = 2 THEN 1000000 + created_by % 89 ELSE created_by END AS created_by,
  CAST(CASE WHEN {SPOILT} % 40 = 3 THEN week_number % 52 + 1 ELSE week_number END AS INT) AS week_number,
  CAST(CASE WHEN {SPOILT} % 60 = 4 THEN year_number + 1 ELSE year_number END AS INT) AS year_number)
FROM daily_entries"""

# --- scalar functions, filters, display ---------------------------------------

DATES = "SELECT DISTINCT entry_date FROM daily_entries"
oracle("period_columns", f"""
SELECT entry_date, CAST(WEEKOFYEAR(entry_date) AS INT) AS week_number, CAST(MONTH(entry_date) AS INT) AS month_number,
       CAST(YEAR(entry_date) AS INT) AS year_number, CAST(isoyear(entry_date) AS INT) AS iso_year,
       CAST(DATE_TRUNC('week', entry_date) AS DATE) AS week_start
FROM ({DATES}) d""")
oracle("iso_week_text", f"""
SELECT entry_date, strftime(entry_date, '%G-W%V') AS week_text,
       'Semana ' || substr(strftime(entry_date, '%G-W%V'), 7, 2) || ', ' || substr(strftime(entry_date, '%G-W%V'), 1, 4) AS week_label
FROM ({DATES}) d""")
oracle("week_bounds", f"""
SELECT week_text, {WS('week_text')} AS week_start, {WS('week_text')} + 6 AS week_end
FROM (SELECT DISTINCT entry_week_text AS week_text FROM entry_forms) w""", entry_forms=ENTRY_FORMS)
oracle("month_bounds", f"""
SELECT month_text, month_start, last_day(month_start) AS month_end, {MONTH_LABEL('month_start')} AS month_label
FROM (SELECT month_text, CAST(month_text || '-01' AS DATE) AS month_start
      FROM (SELECT DISTINCT strftime(expense_date, '%Y-%m') AS month_text FROM general_expenses) m) t""")
oracle("clean_periods", f"""
SELECT form_seq, {VALID('entry_date_text', DATE_RE, AS_OF_DAY)} AS day,
       {VALID('entry_week_text', WEEK_RE, AS_OF_WEEK)} AS week,
       {VALID('substr(entry_date_text, 1, 7)', MONTH_RE, AS_OF_MONTH)} AS month
FROM entry_forms""", entry_forms=ENTRY_FORMS)
oracle("format_money", f"""
SELECT period_type, entry_date, driver_id, car_id, gross_income, created_by,
       '$ ' || {NUM('net_total', 0)} AS net_text, '$ ' || {NUM('total_expenses', 0)} AS expenses_text,
       '$ ' || {NUM('gross_income', 2)} AS gross_text, {NUM('distance_km', 2)} AS km_text
FROM daily_entries""")
oracle("format_dates", f"""
SELECT id, COALESCE(strftime(expense_date, '%d/%m/%Y'), '-') AS date_text,
       {MONTH_LABEL('expense_date')} AS month_label, strftime(expense_date, '%Y-%m') AS month_key
FROM general_expenses""")
oracle("car_labels", f"SELECT id, {LABEL('label')} FROM cars")
oracle("parse_amounts", f"SELECT l_orderkey, l_linenumber, amount_text, {PARSE('amount_text')} AS amount FROM raw_amounts")
oracle("clean_enums", f"""
SELECT form_seq, period_type_text, status_text,
       {ENUM('period_type_text', ('day', 'week'), 'day')} AS period_type,
       {ENUM('status_text', ('pending', 'invoiced'), 'pending')} AS rental_billing_status
FROM entry_forms""", entry_forms=ENTRY_FORMS)
oracle("pattern_flags", f"""
SELECT id, COALESCE(regexp_matches(selector, '^[0-9A-Fa-f]{{24}}$'), FALSE) AS selector_ok,
       COALESCE(regexp_matches(token_hash, '^[0-9A-Fa-f]{{64}}$'), FALSE) AS hash_is_legacy
FROM token_details""", token_details=TOKEN_DETAILS)
oracle("hash_column", "SELECT id, username, sha256(username) AS username_sha256 FROM users")
def CLIP(t: str, most: int) -> str:
    """The longest beginning of whole characters that has at most so many bytes."""
    return f"left({t}, list_max(list_filter(range(0, {most} + 1), lambda n: strlen(left({t}, n)) <= {most})))"


oracle("access_audit", """
SELECT id, user_agent, ip_address, CAST(strlen(user_agent) AS INTEGER) AS user_agent_len, CAST(strlen(ip_address) AS INTEGER) AS ip_address_len
FROM clipped""", token_details=TOKEN_DETAILS,
       clipped=f"SELECT id, {CLIP('user_agent', 255)} AS user_agent, {CLIP('ip_address', 45)} AS ip_address FROM token_details")
oracle("scope_owner", f"SELECT * FROM cars WHERE owner_user_id = {OWNER}")
oracle("scope_driver", f"SELECT * FROM daily_entries WHERE driver_id = {SQL_DRIVER}")
oracle("scope_entry", f"SELECT * FROM daily_entries WHERE owner_user_id = {OWNER} AND driver_id = {SQL_DRIVER}")
oracle("scope_cases", f"""
SELECT 'admin' AS scope, COUNT(*) FILTER (WHERE owner_user_id = {OWNER}) AS entries FROM daily_entries
UNION ALL SELECT 'admin without a tenant', 0
UNION ALL SELECT 'admin, negative driver', 0
UNION ALL SELECT 'admin, one driver', COUNT(*) FROM daily_entries WHERE owner_user_id = {OWNER} AND driver_id = {SQL_DRIVER}
UNION ALL SELECT 'driver user', COUNT(*) FROM daily_entries WHERE driver_id = {SQL_DRIVER}
UNION ALL SELECT 'unlinked driver user', 0""")
oracle("period_column_mismatches", """
SELECT * FROM imported WHERE year_number IS DISTINCT FROM CAST(strftime(entry_date, '%Y') AS INT)
  OR month_number IS DISTINCT FROM CAST(strftime(entry_date, '%m') AS INT)
  OR week_number IS DISTINCT FROM CAST(strftime(entry_date, '%V') AS INT)""", imported=IMPORTED)
oracle("entries_by_status", f"""
SELECT * FROM daily_entries WHERE owner_user_id = {OWNER} AND entry_date BETWEEN {SQL_MONTH}
  AND rental_billing_status = 'invoiced'""")
oracle("active_drivers", f"""
SELECT id, full_name FROM drivers WHERE status = 'active' AND owner_user_id = {OWNER} ORDER BY full_name""")
oracle("billable_entries", "SELECT * FROM listed WHERE rental_amount > 0", listed=ENTRY_LIST)
oracle("lookup_by_key", f"SELECT * FROM drivers WHERE owner_user_id = {OWNER} AND id = {SQL_DRIVER}")

# --- loads -----------------------------------------------------------------------

EF1 = f"""
SELECT f.*, u.role AS p_role, COALESCE(u.owner_user_id, u.id) AS p_tenant, u.driver_id AS p_driver,
       {ENUM('f.period_type_text', ('day', 'week'), 'day')} AS period_type,
       {VALID('f.entry_date_text', DATE_RE, AS_OF_DAY)} AS date_txt,
       {VALID('f.entry_week_text', WEEK_RE, AS_OF_WEEK)} AS week_txt
FROM entry_forms f LEFT JOIN users u ON u.id = f.posted_by"""
EF2 = f"""
SELECT form_seq, posted_by, p_role, p_tenant, p_driver, period_type,
  CASE WHEN period_type = 'week' THEN {WS('week_txt')} ELSE TRY_CAST(date_txt AS DATE) END AS entry_date,
  CASE WHEN period_type = 'week' THEN week_txt ELSE strftime(TRY_CAST(date_txt AS DATE), '%G-W%V') END AS entry_week,
  CASE WHEN p_role = 'driver' THEN COALESCE(p_driver, 0) ELSE {PINT('driver_id_text')} END AS driver_id,
  {PINT('car_id_text')} AS car_id,
  {PARSE('gross_text')} AS gross_income, {PARSE('app_text')} AS app_expenses,
  {PARSE('cash_text')} AS cash_collected, {PARSE('rental_text')} AS rental_amount,
  CASE WHEN p_role = 'admin' THEN {ENUM('status_text', ('pending', 'invoiced'), 'pending')} ELSE 'pending' END
    AS rental_billing_status,
  {PARSE('fuel_text')} AS fuel_cost, TRY_CAST({PARSE('km_text')} AS DECIMAL(10,2)) AS distance_km,
  {TRIM('observations_text')} AS observations
FROM ef1"""
EV = """
SELECT e.*, concat_ws(',',
  CASE WHEN e.p_role IS NULL THEN 'no_session' END,
  CASE WHEN e.driver_id <= 0 THEN 'no_driver' END,
  CASE WHEN e.car_id <= 0 THEN 'no_car' END,
  CASE WHEN e.p_role = 'driver' AND e.driver_id <> COALESCE(e.p_driver, 0) THEN 'other_driver' END,
  CASE WHEN e.p_role = 'admin' AND e.driver_id > 0 AND e.car_id > 0
        AND (SELECT COUNT(*) FROM drivers d WHERE d.id = e.driver_id AND d.owner_user_id = e.p_tenant
                                           AND d.status = 'active') = 0 THEN 'driver_not_in_owner' END,
  CASE WHEN e.p_role = 'admin' AND e.driver_id > 0 AND e.car_id > 0
        AND (SELECT COUNT(*) FROM cars c WHERE c.id = e.car_id AND c.owner_user_id = e.p_tenant
                                        AND c.status = 'active') = 0 THEN 'car_not_in_owner' END,
  CASE WHEN e.p_role = 'driver' AND e.driver_id > 0 AND e.car_id > 0 AND e.driver_id = COALESCE(e.p_driver, 0)
        AND (SELECT COUNT(*) FROM cars c WHERE c.id = e.car_id AND c.current_driver_id = e.driver_id
                                        AND c.status = 'active') = 0 THEN 'car_not_assigned' END,
  CASE WHEN e.entry_date IS NULL THEN 'bad_date' END,
  CASE WHEN e.gross_income IS NULL OR e.app_expenses IS NULL OR e.cash_collected IS NULL OR e.rental_amount IS NULL
        OR e.fuel_cost IS NULL OR e.distance_km IS NULL THEN 'bad_amount' END) AS reasons
FROM ef2 e"""
OKC = """
SELECT ok.*, CASE
  WHEN EXISTS (SELECT 1 FROM entries_unique x WHERE x.period_type = ok.period_type AND x.entry_date = ok.entry_date
                  AND x.driver_id = ok.driver_id AND x.car_id = ok.car_id) THEN 'duplicate'
  WHEN ROW_NUMBER() OVER (PARTITION BY ok.period_type, ok.entry_date, ok.driver_id, ok.car_id ORDER BY ok.form_seq) > 1
       THEN 'duplicate' END AS conflict
FROM ev ok WHERE ok.reasons = ''"""
ACCEPTED = """
SELECT form_seq, posted_by, period_type, entry_date, driver_id, car_id, gross_income, app_expenses, cash_collected,
  rental_amount, rental_billing_status, fuel_cost, distance_km, observations,
  p_tenant AS owner_user_id, posted_by AS created_by, posted_by AS updated_by,
  CAST(ROUND(app_expenses + cash_collected + rental_amount, 2) AS DECIMAL(12,2)) AS total_expenses,
  CAST(ROUND(gross_income - (app_expenses + cash_collected + rental_amount), 2) AS DECIMAL(12,2)) AS net_total,
  CAST(WEEKOFYEAR(entry_date) AS INT) AS week_number, CAST(MONTH(entry_date) AS INT) AS month_number,
  CAST(YEAR(entry_date) AS INT) AS year_number
FROM okc WHERE conflict IS NULL"""
LOADS = dict(entry_forms=ENTRY_FORMS, ef1=EF1, ef2=EF2, ev=EV, okc=OKC, accepted=ACCEPTED)
ENTRY_COLS = ("owner_user_id, period_type, entry_date, driver_id, car_id, gross_income, app_expenses, cash_collected, "
              "rental_amount, rental_billing_status, fuel_cost, distance_km, created_by, total_expenses, net_total, "
              "week_number, month_number, year_number")

oracle("entry_math", "SELECT * FROM daily_entries")
oracle("normalize_entry_date", "SELECT form_seq, period_type, entry_date, entry_week FROM ef2",
       entry_forms=ENTRY_FORMS, ef1=EF1, ef2=EF2)
oracle("entry_rejects", """
SELECT form_seq, posted_by, reasons FROM ev WHERE reasons <> ''
UNION ALL SELECT form_seq, posted_by, conflict AS reasons FROM okc WHERE conflict IS NOT NULL""", **LOADS)
oracle("entry_accepted", "SELECT * FROM accepted", **LOADS)
oracle("append_entries", f"""
SELECT {ENTRY_COLS} FROM entries_unique UNION ALL SELECT {ENTRY_COLS} FROM accepted""", **LOADS)

EXC = f"""
SELECT f.form_seq, f.posted_by, COALESCE(u.owner_user_id, u.id) AS owner_user_id,
  TRY_CAST({VALID('f.expense_date_text', DATE_RE, AS_OF_DAY)} AS DATE) AS expense_date,
  {PARSE('f.amount_text')} AS amount, {TRIM('f.observations_text')} AS observations,
  concat_ws(',', CASE WHEN u.role IS NULL THEN 'no_session' END, CASE WHEN u.role = 'driver' THEN 'not_admin' END,
            CASE WHEN {PARSE('f.amount_text')} <= 0 THEN 'no_amount' END,
            CASE WHEN {PARSE('f.amount_text')} IS NULL THEN 'bad_amount' END) AS reasons
FROM expense_forms f LEFT JOIN users u ON u.id = f.posted_by"""
oracle("append_expenses", """
SELECT id, owner_user_id, expense_date, amount, observations, created_by FROM general_expenses
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM general_expenses) + form_seq, owner_user_id, expense_date, amount,
       observations, posted_by FROM exc WHERE reasons = ''""", expense_forms=EXPENSE_FORMS, exc=EXC)

DRC = f"""
SELECT f.form_seq, f.posted_by, COALESCE(u.owner_user_id, u.id) AS owner_user_id, {TRIM('f.full_name_text')} AS full_name,
  NULLIF({TRIM('f.dni_text')}, '') AS dni,
  CASE WHEN f.status_text IN ('active', 'inactive') THEN f.status_text ELSE 'active' END AS status,
  concat_ws(',', CASE WHEN u.role IS NULL THEN 'no_session' END, CASE WHEN u.role = 'driver' THEN 'not_admin' END,
            CASE WHEN {TRIM('f.full_name_text')} = '' THEN 'no_name' END) AS reasons
FROM driver_forms f LEFT JOIN users u ON u.id = f.posted_by"""
oracle("append_dimension", """
SELECT id, owner_user_id, full_name, dni, status FROM drivers
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM drivers) + ok.form_seq, ok.owner_user_id, ok.full_name, ok.dni, ok.status
FROM drc ok
WHERE ok.reasons = '' AND (ok.dni IS NULL OR (
  NOT EXISTS (SELECT 1 FROM drc o2 WHERE o2.reasons = '' AND o2.owner_user_id = ok.owner_user_id AND o2.dni = ok.dni
              AND o2.form_seq < ok.form_seq)
  AND NOT EXISTS (SELECT 1 FROM drivers d WHERE d.owner_user_id = ok.owner_user_id AND d.dni = ok.dni)))""",
       driver_forms=DRIVER_FORMS, drc=DRC)
oracle("clean_drivers", "SELECT form_seq, owner_user_id, full_name, dni, status, reasons FROM drc",
       driver_forms=DRIVER_FORMS, drc=DRC)
oracle("clean_dimension", f"""
SELECT form_seq, {TRIM('brand_text')} AS brand, {TRIM('model_text')} AS model, upper({TRIM('plate_text')}) AS plate,
  CASE WHEN {TRIM('year_text')} = '' THEN NULL ELSE CAST({PINT('year_text')} AS INT) END AS year,
  CASE WHEN status_text IN ('active', 'inactive') THEN status_text ELSE 'active' END AS status,
  concat_ws(',', CASE WHEN {TRIM('brand_text')} = '' OR {TRIM('model_text')} = '' OR upper({TRIM('plate_text')}) = ''
                      THEN 'missing_fields' END) AS reasons
FROM car_forms""", car_forms=CAR_FORMS)

# --- change batches (same derivations as fleetbook.sources.standins) --------------

NCUST = "(SELECT COUNT(*) FROM customer)"
NSUP = "(SELECT COUNT(*) FROM supplier)"
KEY = ("period_type", "entry_date", "driver_id", "car_id")


def KEYMATCH(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in KEY)


NPART = "(SELECT COUNT(*) FROM part)"
ADMIN_OF = "(SELECT owner_user_id AS o, MIN(id) AS tenant_admin FROM users WHERE role = 'admin' GROUP BY 1)"
POSTED_ENTRIES = f"""
SELECT e.* EXCLUDE (observations, updated_by), CASE WHEN e.id % 8 = 1 THEN e.driver_id + {NSUP} WHEN e.id % 8 = 2 THEN e.id % {NCUST} + 1
       ELSE a.tenant_admin END AS posted_by
FROM entries e LEFT JOIN {ADMIN_OF} a ON a.o = e.owner_user_id"""
ENTRY_EDITS = f"""
SELECT change_seq, entry_id AS id, posted_by, kind AS period_type, day AS entry_date, driver_id, car AS car_id,
  CAST(ROUND(gross_income * rate, 2) AS DECIMAL(12,2)) AS gross_income, app_expenses, CAST(0 AS DECIMAL(12,2)) AS cash_collected,
  rental_amount, fuel_cost, distance_km, status_text, 'edit ' || CAST(change_seq AS VARCHAR) AS observations
FROM (
  SELECT e.*, id * 2 AS change_seq, CASE WHEN id % 100 = 99 THEN id + 1 ELSE id END AS entry_id,
    CASE WHEN id % 5 = 0 THEN 'week' ELSE 'day' END AS kind, CAST(date_trunc('month', entry_date) AS DATE) AS day,
    CAST(1.1 AS DECIMAL(2,1)) AS rate, 'invoiced' AS status_text,
    CASE WHEN id % 8 = 1 THEN driver_id + {NSUP} * (1 + id % 3) ELSE owner_user_id + 5 * (car_id % 9) END AS car
  FROM posted_entries e
  UNION ALL
  SELECT e.*, (id + 20 * ({NSUP} + 1) * ({NPART} + 1)) * 2 + 1, id, 'day', CAST(date_trunc('month', entry_date) AS DATE) + 1,
    CAST(1.2 AS DECIMAL(2,1)), 'facturado',
    CASE WHEN id % 8 = 1 THEN driver_id + {NSUP} * (1 + id % 3) ELSE owner_user_id + 5 * (car_id % 9) END
  FROM posted_entries e WHERE id % 3 = 0) x"""
BILLING_CHANGES = """
SELECT id * 2 AS change_seq, id, CASE WHEN rental_billing_status = 'pending' THEN 'invoiced' ELSE 'facturado' END AS status_text,
  posted_by FROM posted_entries
UNION ALL SELECT id * 2 + 1, id, 'pending', posted_by FROM posted_entries WHERE id % 3 = 0"""
ENTRY_DELETES = "SELECT id, posted_by FROM posted_entries WHERE period_type = 'week'"


def SETTLED(posts: str, stored: str, guard: str = "TRUE", rounds: int = 12) -> dict[str, str]:
    """CTEs that judge posts (seq, row, may, writes, wants, ...) in the order of seq.

    ``stored`` gives (row, key). Every round judges all posts from the decisions of
    the round before; ``verdict`` (seq, why) is the last round's.
    """
    moves = "(ok AND writes AND had IS DISTINCT FROM wants)"
    return {
        "m_stored": stored,
        "m_posts": f"""SELECT p.*, b.key AS base, COALESCE(h.n, 0) AS holders FROM ({posts}) p
                       LEFT JOIN m_stored b ON b.row = p.row
                       LEFT JOIN (SELECT key, COUNT(*) AS n FROM m_stored GROUP BY 1) h ON h.key = p.wants""",
        "rounds": f"""
SELECT 0 AS r, seq, may AS ok, CAST(NULL AS VARCHAR) AS why FROM m_posts
UNION ALL
SELECT r + 1, seq, may AND why IS NULL, why FROM (
  SELECT r, seq, may, CASE WHEN NOT COALESCE({guard}, FALSE) THEN 'guarded' WHEN may AND writes AND wants IS NOT NULL
         AND holders + moved - CASE WHEN had IS NOT DISTINCT FROM wants THEN 1 ELSE 0 END > 0 THEN 'taken' END AS why
  FROM (SELECT *, COALESCE(SUM(ev.d) OVER (PARTITION BY ev.k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved
        FROM (SELECT *, unnest([{{'k': wants, 'd': CASE WHEN {moves} THEN 1 ELSE 0 END, 'asks': TRUE}},
                                {{'k': CASE WHEN {moves} THEN had END, 'd': CASE WHEN {moves} THEN -1 ELSE 0 END, 'asks': FALSE}}]) AS ev
              FROM (SELECT *, CASE WHEN set_to IS NULL THEN base ELSE set_to.k END AS had
                    FROM (SELECT k.r, k.ok, p.*, last_value(CASE WHEN k.ok AND p.writes THEN {{'k': p.wants}} END IGNORE NULLS)
                                 OVER (PARTITION BY p.row ORDER BY p.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS set_to
                          FROM rounds k JOIN m_posts p ON p.seq = k.seq) a) b) c) d
  WHERE ev.asks) x WHERE r < {rounds}""",
        "verdict": f"SELECT seq, why FROM rounds WHERE r = {rounds}",
    }


STATUS_CHANGES = f"""
SELECT id, CASE WHEN status = 'active' THEN 'inactivo' ELSE 'active' END AS status_text,
  id * 3 % {NCUST} + 1 AS posted_by
FROM drivers"""
NOTE_POSTS = """
SELECT o_orderkey + 1 AS change_seq, o_custkey + 1 AS posted_by,
  CAST(isoyear(CAST(o_orderdate AS DATE)) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week_text,
  CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE ' posted ' || CAST(o_orderkey AS VARCHAR) END AS notes_text
FROM orders WHERE o_orderpriority = '2-HIGH'"""
ASSIGNMENTS = f"""
SELECT l_orderkey * 10 + l_linenumber AS change_seq, l_orderkey % {NCUST} + 1 AS posted_by, l_suppkey + 1 AS driver_id,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey + 1 END AS car_id
FROM lineitem"""
MANAGER_ID = """(SELECT id FROM users WHERE role = 'admin'
  AND username = (SELECT MIN(username) FROM users WHERE role = 'admin'))"""
USER_EDITS = f"""
SELECT {NCUST} + 1 - id AS change_seq, id,
  CASE WHEN id % 5 = 0 THEN id WHEN id % 3 = 0 THEN id + 1 ELSE {MANAGER_ID} END AS posted_by, upper(full_name) AS full_name_text,
  CASE WHEN id % 7 = 1 THEN username || '.x' WHEN id % 7 = 0 THEN 'customer#' || lpad(CAST(id AS VARCHAR), 9, '0') ELSE username END
    AS username_text,
  CASE WHEN role = 'admin' THEN 'driver' ELSE 'admin' END AS role_text,
  CASE WHEN role = 'admin' THEN id % {NSUP} + 1 END AS driver_id,
  CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS is_active
FROM users"""
DRIVER_EDITS = f"""
SELECT c_custkey + 1 AS change_seq, c_custkey % {NSUP} + 1 AS id,
  CASE WHEN c_custkey % 10 = 0 THEN c_custkey * 11 % {NCUST} + 1 ELSE a.tenant_admin END AS posted_by,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE upper(c_name) END AS full_name_text,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(30000000 + c_custkey * 7 % 90 AS VARCHAR) END AS dni_text,
  CASE WHEN c_acctbal > 5000 THEN 'inactive' ELSE 'active' END AS status_text
FROM customer LEFT JOIN drivers d ON d.id = c_custkey % {NSUP} + 1 LEFT JOIN {ADMIN_OF} a ON a.o = d.owner_user_id"""
CAR_EDITS = f"""
SELECT {NPART} - p_partkey AS form_seq, p_partkey + 1 AS id,
  CASE WHEN p_partkey % 10 = 0 THEN p_partkey * 13 % {NCUST} + 1 ELSE a.tenant_admin END AS posted_by,
  ' ' || p_brand AS brand_text, CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS model_text,
  CASE p_partkey % 3 WHEN 1 THEN 'n' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN ' p' || CAST(p_partkey + 5 AS VARCHAR)
       ELSE 'P' || CAST(p_partkey + 10 AS VARCHAR) || ' ' END AS plate_text,
  CASE WHEN p_size > 40 THEN '' ELSE CAST(1990 + p_size AS VARCHAR) END AS year_text,
  CASE WHEN p_size % 3 = 0 THEN 'inactive' ELSE 'active' END AS status_text
FROM part LEFT JOIN {ADMIN_OF} a ON a.o = p_partkey % 5 + 1"""
LEGACY_DRIVERS = "SELECT * REPLACE (CASE WHEN id = 2 THEN 'Chofer Demo' ELSE full_name END AS full_name) FROM drivers"
LEGACY_CARS = "SELECT * REPLACE (CASE WHEN id = 2 THEN 'AA000AA' ELSE plate END AS plate) FROM cars"
LEGACY_USERS = """
SELECT id, full_name, CASE id WHEN 2 THEN 'admin' WHEN 3 THEN 'chofer' WHEN 5 THEN 'personal' ELSE username END AS username, role, driver_id,
  CASE WHEN is_active = 0 THEN NULL ELSE owner_user_id END AS owner_user_id, is_active
FROM users"""
TOKEN_REQUESTS = "SELECT user_id + 1 AS user_id FROM events WHERE event_type = 'signup' AND value > 200"
TOKEN_RESETS = "SELECT user_id + 1 AS user_id FROM events WHERE event_type = 'purchase' AND value > 250"


def JUDGED(batch: str, admin_only: bool) -> str:
    """Posts on entries by id, with session, target and reason."""
    not_admin = "CASE WHEN p.role = 'driver' THEN 'not_admin' END," if admin_only else ""
    tenant = "COALESCE(p.owner_user_id, p.id)"
    return f"""
SELECT b.*, concat_ws(',', CASE WHEN p.role IS NULL THEN 'no_session' END, {not_admin}
    CASE WHEN p.role IS NOT NULL AND t.owner_user_id IS NULL THEN 'not_found' END,
    CASE WHEN t.owner_user_id IS NOT NULL AND t.owner_user_id <> {tenant} THEN 'other_owner' END,
    CASE WHEN t.owner_user_id IS NOT NULL AND p.role = 'driver' AND t.driver_id <> COALESCE(p.driver_id, 0)
         THEN 'other_driver' END) AS reasons
FROM {batch} b LEFT JOIN users p ON p.id = b.posted_by LEFT JOIN entries t ON t.id = b.id"""


AMTS = ("gross_income", "app_expenses", "cash_collected", "rental_amount", "fuel_cost", "distance_km")
# the edited form as it would be saved: a driver user's own driver, a weekly entry's Monday, an admin's status
EE_FORM = f"""
SELECT b.change_seq, b.id, b.posted_by, p.role AS p_role, COALESCE(p.owner_user_id, p.id) AS p_tenant, p.driver_id AS p_driver,
  t.owner_user_id AS t_owner, b.period_type,
  CASE WHEN b.period_type = 'week' THEN CAST(date_trunc('week', b.entry_date) AS DATE) ELSE b.entry_date END AS entry_date,
  CASE WHEN p.role = 'driver' THEN COALESCE(p.driver_id, 0) ELSE b.driver_id END AS driver_id, b.car_id,
  {', '.join(f'b.{c}' for c in AMTS)}, b.observations,
  CASE WHEN p.role = 'admin' THEN {ENUM('b.status_text', ('pending', 'invoiced'), 'pending')} END AS rental_billing_status
FROM ee b LEFT JOIN users p ON p.id = b.posted_by LEFT JOIN entries t ON t.id = b.id"""
EE_RULES = """
SELECT f.*, concat_ws(',', CASE WHEN f.p_role IS NULL THEN 'no_session' END,
    CASE WHEN f.p_role IS NOT NULL AND f.t_owner IS NULL THEN 'not_found' END,
    CASE WHEN f.t_owner IS NOT NULL AND f.t_owner <> f.p_tenant THEN 'other_owner' END) AS early,
  concat_ws(',', CASE WHEN NOT COALESCE(f.driver_id > 0, FALSE) THEN 'no_driver' END, CASE WHEN NOT COALESCE(f.car_id > 0, FALSE) THEN 'no_car' END,
    CASE WHEN f.driver_id > 0 AND f.car_id > 0 AND f.p_role = 'admin' AND NOT EXISTS (SELECT 1 FROM drivers x WHERE x.id = f.driver_id
         AND x.owner_user_id = f.p_tenant AND x.status = 'active') THEN 'driver_not_in_owner' END,
    CASE WHEN f.driver_id > 0 AND f.car_id > 0 AND f.p_role = 'admin' AND NOT EXISTS (SELECT 1 FROM cars x WHERE x.id = f.car_id
         AND x.owner_user_id = f.p_tenant AND x.status = 'active') THEN 'car_not_in_owner' END,
    CASE WHEN f.driver_id > 0 AND f.car_id > 0 AND f.p_role = 'driver' AND NOT EXISTS (SELECT 1 FROM cars x WHERE x.id = f.car_id
         AND x.current_driver_id = f.driver_id AND x.status = 'active') THEN 'car_not_assigned' END) AS form
FROM ee_form f"""


def KEY_TEXT(t: str) -> str:
    return " || '|' || ".join(f"CAST({t}.{k} AS VARCHAR)" for k in KEY)


EE = dict(
    posted_entries=POSTED_ENTRIES, ee=ENTRY_EDITS, ee_form=EE_FORM, ee_rules=EE_RULES,
    **SETTLED(f"""SELECT e.change_seq AS seq, e.id AS row, e.early = '' AND e.form = '' AS may, TRUE AS writes, {KEY_TEXT('e')} AS wants,
                  e.p_role, e.p_driver FROM ee_rules e""",
              f"SELECT e.id AS row, {KEY_TEXT('e')} AS key FROM entries e",
              guard="(COALESCE(p_role, '') <> 'driver' OR split_part(had, '|', 3) = CAST(p_driver AS VARCHAR))"),
    ee_judged="""
SELECT e.*, CASE WHEN e.early <> '' THEN e.early WHEN v.why = 'guarded' THEN 'other_driver' WHEN e.form <> '' THEN e.form
  WHEN v.why = 'taken' THEN 'duplicate' ELSE '' END AS reasons
FROM ee_rules e JOIN verdict v ON v.seq = e.change_seq""")
GIVEN = (*KEY, *AMTS, "observations")
HIT = "n.change_seq IS NOT NULL"
oracle("apply_entry_updates", f"""
SELECT e.id, e.owner_user_id, {', '.join(f'CASE WHEN {HIT} THEN n.{c} ELSE e.{c} END AS {c}' for c in GIVEN)},
  COALESCE(s.rental_billing_status, e.rental_billing_status) AS rental_billing_status, e.created_by,
  CASE WHEN {HIT} THEN n.posted_by ELSE e.updated_by END AS updated_by,
  CASE WHEN {HIT} THEN CAST(n.app_expenses + n.cash_collected + n.rental_amount AS DECIMAL(12,2)) ELSE e.total_expenses END AS total_expenses,
  CASE WHEN {HIT} THEN CAST(n.gross_income - (n.app_expenses + n.cash_collected + n.rental_amount) AS DECIMAL(12,2)) ELSE e.net_total END AS net_total,
  CASE WHEN {HIT} THEN CAST(strftime(n.entry_date, '%V') AS INT) ELSE e.week_number END AS week_number,
  CASE WHEN {HIT} THEN CAST(MONTH(n.entry_date) AS INT) ELSE e.month_number END AS month_number,
  CASE WHEN {HIT} THEN CAST(YEAR(n.entry_date) AS INT) ELSE e.year_number END AS year_number
FROM entries e LEFT JOIN newest n ON n.id = e.id LEFT JOIN newest_status s ON s.id = e.id""", **EE,
       newest="""SELECT j.* FROM ee_judged j WHERE reasons = '' AND change_seq =
                 (SELECT MAX(change_seq) FROM ee_judged k WHERE k.id = j.id AND k.reasons = '')""",
       newest_status="""SELECT id, arg_max(rental_billing_status, change_seq) AS rental_billing_status FROM ee_judged
                        WHERE reasons = '' AND rental_billing_status IS NOT NULL GROUP BY id""")
BILLING = dict(posted_entries=POSTED_ENTRIES, bc=BILLING_CHANGES, judged=JUDGED("bc", True))
BILLING_STATUS = ENUM('status_text', ('pending', 'invoiced'), 'pending')
oracle("apply_billing_status", """
SELECT e.* REPLACE (COALESCE(n.n_status, e.rental_billing_status) AS rental_billing_status, COALESCE(n.n_by, e.updated_by) AS updated_by)
FROM entries e LEFT JOIN newest n ON n.id = e.id""", **BILLING,
       newest=f"""SELECT id, arg_max({BILLING_STATUS}, change_seq) AS n_status, arg_max(posted_by, change_seq) AS n_by
                  FROM judged WHERE reasons = '' GROUP BY id""")
oracle("billing_change_audit", f"""
SELECT j.change_seq, j.id, j.posted_by, {BILLING_STATUS} AS rental_billing_status,
  CASE WHEN j.reasons <> '' THEN j.reasons
       WHEN EXISTS (SELECT 1 FROM judged k WHERE k.id = j.id AND k.reasons = '' AND k.change_seq > j.change_seq) THEN 'superseded'
       ELSE 'applied' END AS outcome
FROM judged j""", **BILLING)
oracle("apply_deletes", """
SELECT e.* FROM entries e WHERE e.id NOT IN (SELECT j.id FROM judged j WHERE j.reasons = '')""",
       posted_entries=POSTED_ENTRIES, ed=ENTRY_DELETES, judged=JUDGED("ed", False))
oracle("change_rejects", """
SELECT 'update' AS change, id, posted_by, reasons FROM ee_judged WHERE reasons <> ''
UNION ALL
SELECT 'delete' AS change, id, posted_by, reasons FROM jd WHERE reasons <> ''""",
       **EE, ed=ENTRY_DELETES, jd=JUDGED("ed", False))
oracle("apply_status", """
SELECT d.id, d.owner_user_id, d.full_name, d.dni,
  CASE WHEN ok.id IS NOT NULL THEN ok.n_status ELSE d.status END AS status
FROM drivers d LEFT JOIN ok ON ok.id = d.id AND ok.n_owner = d.owner_user_id""",
       sc=STATUS_CHANGES,
       ok="""SELECT s.id, COALESCE(u.owner_user_id, u.id) AS n_owner,
             MAX(CASE WHEN s.status_text = 'active' THEN 'active' ELSE 'inactive' END) AS n_status
             FROM sc s JOIN users u ON u.id = s.posted_by WHERE u.role = 'admin' GROUP BY 1, 2""")
oracle("upsert_notes", """
SELECT COALESCE(w.owner_user_id, n.owner_user_id) AS owner_user_id, COALESCE(w.week_start, n.week_start) AS week_start,
  CASE WHEN n.owner_user_id IS NOT NULL THEN n.n_end ELSE w.week_end END AS week_end,
  CASE WHEN n.owner_user_id IS NOT NULL THEN n.n_notes ELSE w.notes END AS notes,
  CASE WHEN w.owner_user_id IS NOT NULL THEN CAST(NULL AS BIGINT) ELSE n.n_by END AS created_by,
  CASE WHEN n.owner_user_id IS NOT NULL THEN n.n_by ELSE w.updated_by END AS updated_by
FROM weekly_money_notes w FULL OUTER JOIN newest n ON n.owner_user_id = w.owner_user_id AND n.week_start = w.week_start""",
       np=NOTE_POSTS,
       ok=f"""SELECT COALESCE(u.owner_user_id, u.id) AS owner_user_id,
              {WS(VALID('p.week_text', WEEK_RE, AS_OF_WEEK))} AS week_start,
              {WS(VALID('p.week_text', WEEK_RE, AS_OF_WEEK))} + 6 AS n_end,
              trim(p.notes_text) AS n_notes, p.posted_by AS n_by, p.change_seq
              FROM np p LEFT JOIN users u ON u.id = p.posted_by
              WHERE u.role = 'admin' AND trim(p.notes_text) <> ''""",
       newest="""SELECT * FROM (SELECT ok.*, ROW_NUMBER() OVER (PARTITION BY owner_user_id, week_start
                 ORDER BY change_seq DESC, n_end DESC, n_notes DESC, n_by DESC) AS rn FROM ok) x WHERE rn = 1""")
ASG_P = """SELECT a.*, u.role AS p_role, COALESCE(u.owner_user_id, u.id) AS p_tenant,
  (a.car_id IS NULL OR EXISTS (SELECT 1 FROM cars c WHERE c.id = a.car_id
      AND c.owner_user_id = COALESCE(u.owner_user_id, u.id) AND c.status = 'active')) AS car_ok
FROM asg a LEFT JOIN users u ON u.id = a.posted_by"""
oracle("apply_assignments", """
SELECT c1.id, c1.owner_user_id, c1.brand, c1.model, c1.plate, c1.status,
  CASE WHEN lp.lp_seq IS NOT NULL AND (c1.since IS NULL OR lp.lp_seq > c1.since) THEN NULL ELSE c1.holder END
    AS current_driver_id
FROM c1 LEFT JOIN last_post lp ON lp.lp_owner = c1.owner_user_id AND lp.lp_driver = c1.holder""",
       asg=ASSIGNMENTS, ap=ASG_P,
       valid="SELECT * FROM ap WHERE p_role = 'admin' AND car_ok",
       last_post="SELECT p_tenant AS lp_owner, driver_id AS lp_driver, MAX(change_seq) AS lp_seq FROM valid GROUP BY 1, 2",
       last_set="""SELECT car_id AS ls_car, driver_id AS ls_driver, change_seq AS ls_seq FROM (
                   SELECT v.*, ROW_NUMBER() OVER (PARTITION BY car_id ORDER BY change_seq DESC, driver_id DESC) AS rn
                   FROM valid v WHERE car_id IS NOT NULL) x WHERE rn = 1""",
       c1="""SELECT c.*, CASE WHEN ls.ls_car IS NOT NULL THEN ls.ls_driver ELSE c.current_driver_id END AS holder,
             ls.ls_seq AS since FROM cars c LEFT JOIN last_set ls ON ls.ls_car = c.id""")
oracle("assignment_rejects", """
SELECT change_seq, posted_by, driver_id, car_id, reasons FROM (
  SELECT ap.*, concat_ws(',', CASE WHEN p_role IS NULL THEN 'no_session' END,
                              CASE WHEN p_role = 'driver' THEN 'not_admin' END,
                              CASE WHEN NOT car_ok THEN 'car_unavailable' END) AS reasons FROM ap) x
WHERE reasons <> ''""", asg=ASSIGNMENTS, ap=ASG_P)
DE_RULES = f"""
SELECT e.change_seq, e.id, e.posted_by, COALESCE(u.owner_user_id, u.id) AS p_tenant, {TRIM('e.full_name_text')} AS full_name,
  NULLIF({TRIM('e.dni_text')}, '') AS dni, {ENUM('e.status_text', ('active', 'inactive'), 'active')} AS status,
  concat_ws(',', CASE WHEN u.role IS NULL THEN 'no_session' END, CASE WHEN u.role = 'driver' THEN 'not_admin' END,
    CASE WHEN u.role IS NOT NULL AND NOT EXISTS (SELECT 1 FROM drivers t WHERE t.id = e.id
         AND t.owner_user_id = COALESCE(u.owner_user_id, u.id)) THEN 'other_owner' END,
    CASE WHEN {TRIM('e.full_name_text')} = '' THEN 'no_name' END) AS rules
FROM de e LEFT JOIN users u ON u.id = e.posted_by"""
STORED_DNI = "SELECT id AS row, CAST(owner_user_id AS VARCHAR) || '|' || dni AS key FROM drivers"
DE = dict(de=DRIVER_EDITS, de_rules=DE_RULES,
          **SETTLED("""SELECT change_seq AS seq, id AS row, rules = '' AS may, TRUE AS writes,
                       CAST(p_tenant AS VARCHAR) || '|' || dni AS wants FROM de_rules""", STORED_DNI),
          judged="""SELECT e.change_seq, e.id, e.posted_by, e.full_name, e.dni, e.status,
                    CASE WHEN v.why = 'taken' THEN 'duplicate_dni' ELSE e.rules END AS reasons
                    FROM de_rules e JOIN verdict v ON v.seq = e.change_seq""")
oracle("apply_dimension_updates", """
SELECT d.id, d.owner_user_id,
  CASE WHEN n.id IS NOT NULL THEN n.full_name ELSE d.full_name END AS full_name,
  CASE WHEN n.id IS NOT NULL THEN n.dni ELSE d.dni END AS dni,
  CASE WHEN n.id IS NOT NULL THEN n.status ELSE d.status END AS status
FROM drivers d LEFT JOIN newest n ON n.id = d.id""", **DE,
       newest="""SELECT * FROM judged j WHERE reasons = '' AND NOT EXISTS
                 (SELECT 1 FROM judged k WHERE k.id = j.id AND k.reasons = '' AND k.change_seq > j.change_seq)""")
oracle("driver_edit_rejects", "SELECT * FROM judged WHERE reasons <> ''", **DE)
UE_RULES = """
SELECT j.change_seq, j.id, j.posted_by, trim(j.full_name_text) AS full_name, trim(j.username_text) AS username, j.role,
  j.linked_driver AS driver_id, j.is_active, concat_ws(',',
  CASE WHEN NOT COALESCE(j.p_role = 'admin' AND j.m_username = (SELECT MIN(username) FROM users WHERE role = 'admin'), FALSE) THEN 'not_user_manager' END,
  CASE WHEN trim(j.full_name_text) = '' OR trim(j.username_text) = '' THEN 'missing_fields' END,
  CASE WHEN j.linked_driver IS NOT NULL AND NOT EXISTS (SELECT 1 FROM drivers d WHERE d.id = j.linked_driver
       AND d.owner_user_id = j.p_tenant) THEN 'driver_not_in_owner' END,
  CASE WHEN j.id = j.posted_by AND (j.role <> 'admin' OR j.is_active <> 1) THEN 'self_lock' END,
  CASE WHEN NOT EXISTS (SELECT 1 FROM users t WHERE t.id = j.id AND t.owner_user_id = j.p_tenant)
       THEN 'user_not_in_owner' END) AS rules
FROM uj j"""
USER_EDIT_CTES = dict(ue=USER_EDITS, uj=f"""SELECT e.*, p.role AS p_role, COALESCE(p.owner_user_id, p.id) AS p_tenant, p.username AS m_username,
              {ENUM('e.role_text', ('admin', 'driver'), 'driver')} AS role,
              CASE WHEN {ENUM('e.role_text', ('admin', 'driver'), 'driver')} = 'admin' THEN NULL ELSE e.driver_id END
                AS linked_driver
              FROM ue e LEFT JOIN users p ON p.id = e.posted_by""", ue_rules=UE_RULES,
              **SETTLED("SELECT change_seq AS seq, id AS row, rules = '' AS may, TRUE AS writes, username AS wants FROM ue_rules",
                        "SELECT id AS row, username AS key FROM users"),
              uej="""SELECT e.* EXCLUDE (rules), CASE WHEN v.why = 'taken' THEN 'duplicate_username' ELSE e.rules END AS reasons
                     FROM ue_rules e JOIN verdict v ON v.seq = e.change_seq""")
oracle("user_rejects", "SELECT * FROM uej WHERE reasons <> ''", **USER_EDIT_CTES)
oracle("apply_user_edits", """
SELECT u.id, CASE WHEN e.id IS NULL THEN u.full_name ELSE e.full_name END AS full_name,
  CASE WHEN e.id IS NULL THEN u.username ELSE e.username END AS username,
  CASE WHEN e.id IS NULL THEN u.role ELSE e.role END AS role,
  CASE WHEN e.id IS NULL THEN u.driver_id ELSE e.driver_id END AS driver_id, u.owner_user_id,
  CASE WHEN e.id IS NULL THEN u.is_active ELSE e.is_active END AS is_active
FROM users u LEFT JOIN (SELECT * FROM uej WHERE reasons = '') e ON e.id = u.id""", **USER_EDIT_CTES)

# --- audits ----------------------------------------------------------------------

oracle("duplicate_entries", f"""
SELECT {', '.join(KEY)}, COUNT(*) AS rows FROM daily_entries
WHERE {' AND '.join(f'{k} IS NOT NULL' for k in KEY)}
GROUP BY {', '.join(KEY)} HAVING COUNT(*) > 1""")
oracle("duplicate_dni", """
SELECT owner_user_id, dni, COUNT(*) AS rows FROM drivers
WHERE owner_user_id IS NOT NULL AND dni IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1""")
FKS = [("daily_entries", "driver_id", "drivers"), ("daily_entries", "car_id", "cars"),
       ("daily_entries", "created_by", "users"), ("cars", "current_driver_id", "drivers"),
       ("users", "driver_id", "drivers"), ("general_expenses", "created_by", "users"),
       ("weekly_money_notes", "updated_by", "users"), ("access_tokens", "user_id", "users")]
oracle("orphan_entries", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS child_table, '{fk}' AS fk_column, '{p}' AS parent_table, x.{fk} AS value, COUNT(*) AS rows,
        {'CAST(NULL AS BIGINT)' if c == 'access_tokens' else 'COUNT(DISTINCT x.owner_user_id)'} AS owners
        FROM {'imported' if c == 'daily_entries' else c} x WHERE x.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} q WHERE q.id = x.{fk})
        GROUP BY x.{fk}""" for c, fk, p in FKS), imported=IMPORTED)
oracle("delete_effects", """
SELECT r.id, COALESCE(e.n, 0) AS entries_count, COALESCE(c.n, 0) AS cars_unlinked, COALESCE(u.n, 0) AS users_unlinked,
  COALESCE(e.n, 0) > 0 AS blocked
FROM (SELECT id FROM drivers WHERE status = 'inactive') r
LEFT JOIN (SELECT driver_id, COUNT(*) AS n FROM daily_entries GROUP BY 1) e ON e.driver_id = r.id
LEFT JOIN (SELECT current_driver_id, COUNT(*) AS n FROM cars GROUP BY 1) c ON c.current_driver_id = r.id
LEFT JOIN (SELECT driver_id, COUNT(*) AS n FROM users GROUP BY 1) u ON u.driver_id = r.id""")

# --- backfills ---------------------------------------------------------------------

EVOLVED = """
SELECT *, CAST(0 AS DECIMAL(12,2)) AS cash_collected, CAST(0 AS DECIMAL(12,2)) AS rental_amount,
  'pending' AS rental_billing_status, CAST(0 AS DECIMAL(12,2)) AS fuel_cost, CAST(0 AS DECIMAL(10,2)) AS distance_km
FROM legacy_entries"""
LEG = ("(COALESCE(wash_cost, 0) + COALESCE(tolls_cost, 0) + COALESCE(maintenance_cost, 0)"
       " + COALESCE(other_expenses, 0))")
CLEAN_COMMON = """
  CAST(COALESCE(cash_collected, 0) AS DECIMAL(12,2)) AS cash_collected,
  CAST(COALESCE(rental_amount, 0) AS DECIMAL(12,2)) AS rental_amount,
  CASE WHEN rental_billing_status = 'invoiced' THEN 'invoiced' ELSE 'pending' END AS rental_billing_status,
  fuel_cost, CAST(COALESCE(distance_km, 0) AS DECIMAL(10,2)) AS distance_km"""
oracle("evolve_schema", "SELECT * FROM evolved", evolved=EVOLVED)
oracle("fold_legacy_costs", f"""
SELECT owner_user_id, CASE WHEN period_type = 'week' THEN 'week' ELSE 'day' END AS period_type, entry_date,
  driver_id, car_id, gross_income,
  CAST(CASE WHEN app_expenses = 0 THEN {LEG} ELSE app_expenses END AS DECIMAL(12,2)) AS app_expenses,
  wash_cost, tolls_cost, maintenance_cost, other_expenses,
  CAST(CASE WHEN total_expenses = 0 THEN {LEG} ELSE total_expenses END AS DECIMAL(12,2)) AS total_expenses,
  CAST(CASE WHEN net_total = 0 THEN gross_income - {LEG} ELSE net_total END AS DECIMAL(12,2)) AS net_total,
  {CLEAN_COMMON}
FROM evolved""", evolved=EVOLVED)
oracle("clean_entries", f"""
SELECT owner_user_id, CASE WHEN period_type = 'week' THEN 'week' ELSE 'day' END AS period_type, entry_date,
  driver_id, car_id, gross_income,
  CAST(COALESCE(app_expenses, 0) AS DECIMAL(12,2)) AS app_expenses,
  CAST(COALESCE(total_expenses, 0) AS DECIMAL(12,2)) AS total_expenses,
  CAST(CASE WHEN net_total = 0 THEN gross_income - CAST(COALESCE(total_expenses, 0) AS DECIMAL(12,2))
            ELSE net_total END AS DECIMAL(12,2)) AS net_total,
  {CLEAN_COMMON}
FROM evolved""", evolved=EVOLVED.replace("SELECT *,", "SELECT * EXCLUDE (wash_cost, tolls_cost, maintenance_cost, other_expenses),"))


def ADM(users: str) -> str:
    return f"COALESCE((SELECT MIN(id) FROM {users} WHERE username = 'admin'), 1)"


U1 = f"""
SELECT id, full_name, username, role, driver_id,
  CAST(CASE WHEN username IN ('admin', 'chofer') THEN {ADM('legacy_users')}
            WHEN username = 'personal' AND (SELECT MIN(id) FROM legacy_users WHERE username = 'personal') IS NOT NULL
              THEN (SELECT MIN(id) FROM legacy_users WHERE username = 'personal')
            ELSE COALESCE(owner_user_id, id) END AS BIGINT) AS owner_user_id,
  is_active
FROM legacy_users"""


def OWNERS(key: str) -> str:
    return f"""SELECT e.{key} AS k, MIN(COALESCE(u.owner_user_id, e.created_by, {ADM('u1')})) AS o
               FROM daily_entries e LEFT JOIN u1 u ON u.id = e.created_by
               WHERE e.created_by IS NOT NULL GROUP BY e.{key}"""


D1 = f"""
SELECT d.id, CAST(CASE WHEN d.full_name = 'Chofer Demo' THEN {ADM('u1')} ELSE COALESCE(o.o, {ADM('u1')}) END AS BIGINT)
  AS owner_user_id, d.full_name, d.dni, d.status
FROM legacy_drivers d LEFT JOIN ({OWNERS('driver_id')}) o ON o.k = d.id"""
C1 = f"""
SELECT c.id, CAST(CASE WHEN c.plate = 'AA000AA' THEN {ADM('u1')} ELSE COALESCE(o.o, {ADM('u1')}) END AS BIGINT)
  AS owner_user_id, c.brand, c.model, c.plate, c.status, c.current_driver_id
FROM legacy_cars c LEFT JOIN ({OWNERS('car_id')}) o ON o.k = c.id"""
E1 = f"""
SELECT CAST(COALESCE(u.owner_user_id, d.owner_user_id, {ADM('u1')}) AS BIGINT) AS owner_user_id,
  e.* EXCLUDE (owner_user_id)
FROM daily_entries e LEFT JOIN u1 u ON u.id = e.created_by LEFT JOIN d1 d ON d.id = e.driver_id"""
U2 = """
SELECT u.id, u.full_name, u.username, u.role, u.driver_id,
  CAST(CASE WHEN u.role = 'driver' AND d.id IS NOT NULL THEN d.owner_user_id ELSE u.owner_user_id END AS BIGINT)
    AS owner_user_id, u.is_active
FROM u1 u LEFT JOIN d1 d ON d.id = u.driver_id"""
X1 = f"""
SELECT ge.id, CAST(COALESCE(u.owner_user_id, {ADM('u2')}) AS BIGINT) AS owner_user_id, ge.expense_date, ge.amount,
  ge.observations, ge.created_by
FROM general_expenses ge LEFT JOIN u2 u ON u.id = ge.created_by"""
MIG = dict(legacy_users=LEGACY_USERS, legacy_drivers=LEGACY_DRIVERS, legacy_cars=LEGACY_CARS, u1=U1, d1=D1, c1=C1, e1=E1, u2=U2, x1=X1)
oracle("backfill_users", "SELECT * FROM u1", legacy_users=LEGACY_USERS, u1=U1)
oracle("backfill_drivers", "SELECT * FROM d1", **MIG)
oracle("backfill_cars", "SELECT * FROM c1", **MIG)
oracle("backfill_entries", "SELECT * FROM e1", **MIG)
oracle("backfill_driver_users", "SELECT * FROM u2", **MIG)
oracle("backfill_expenses", "SELECT * FROM x1", **MIG)

# --- access tokens -------------------------------------------------------------------

oracle("valid_tokens", """
SELECT t.*, u.username, u.role FROM access_tokens t JOIN users u ON u.id = t.user_id
WHERE u.is_active = 1 AND t.expires_at > TIMESTAMP '2024-02-15 00:00:00'
  AND (t.kind = 'remember' OR t.used_at IS NULL)""")
oracle("purge_tokens", """
SELECT t.* FROM access_tokens t
WHERE NOT (t.kind = 'remember' AND t.user_id IN (SELECT user_id FROM token_resets))
  AND NOT (t.kind = 'reset' AND t.used_at IS NULL AND t.user_id IN (SELECT user_id FROM token_requests))""",
       token_requests=TOKEN_REQUESTS, token_resets=TOKEN_RESETS)
oracle("last_access", """
SELECT u.*, l.last_used AS last_login_at,
  COALESCE(strftime(l.last_used, '%d/%m/%Y %H:%M'), '-') AS last_login_text FROM users u
LEFT JOIN (SELECT user_id, MAX(used_at) AS last_used FROM access_tokens WHERE used_at IS NOT NULL GROUP BY 1) l
  ON l.user_id = u.id""")
oracle("token_expiry", """
SELECT id, user_id, created_at, created_at + INTERVAL 30 DAY AS remember_expires_at,
  created_at + INTERVAL 1 HOUR AS reset_expires_at
FROM access_tokens""")

# --- list counts -----------------------------------------------------------------------

oracle("list_counts", f"""
SELECT 'entries' AS list, COUNT(*) AS rows FROM listed
UNION ALL SELECT 'expenses', COUNT(*) FROM general_expenses
  WHERE owner_user_id = {OWNER} AND expense_date BETWEEN {SQL_MONTH}
UNION ALL SELECT 'days', COUNT(DISTINCT entry_date) FROM daily_entries
  WHERE owner_user_id = {OWNER} AND entry_date BETWEEN {SQL_MONTH}
UNION ALL SELECT 'drivers', COUNT(*) FROM drivers WHERE owner_user_id = {OWNER}
UNION ALL SELECT 'cars', COUNT(*) FROM cars WHERE owner_user_id = {OWNER}
UNION ALL SELECT 'users', COUNT(*) FROM users WHERE owner_user_id = {OWNER}""", listed=ENTRY_LIST)


# --- more changes, unique keys, driver-user rosters ----------------------------------------

oracle("apply_status_cars", """
SELECT c.id, c.owner_user_id, c.brand, c.model, c.plate,
  CASE WHEN ok.id IS NOT NULL THEN ok.n_status ELSE c.status END AS status, c.current_driver_id
FROM cars c LEFT JOIN ok ON ok.id = c.id AND ok.n_owner = c.owner_user_id""",
       sc=f"""SELECT id, CASE WHEN status = 'active' THEN 'inactive' ELSE 'active' END AS status_text,
              id * 5 % {NCUST} + 1 AS posted_by FROM cars""",
       ok="""SELECT s.id, COALESCE(u.owner_user_id, u.id) AS n_owner,
             MAX(CASE WHEN s.status_text = 'active' THEN 'active' ELSE 'inactive' END) AS n_status
             FROM sc s JOIN users u ON u.id = s.posted_by WHERE u.role = 'admin' GROUP BY 1, 2""")
oracle("apply_expense_deletes", """
SELECT ge.* FROM general_expenses ge
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = ge.id AND g.owner = ge.owner_user_id)""",
       xd="SELECT id, created_by AS posted_by FROM general_expenses WHERE observations = ''",
       gone="""SELECT DISTINCT x.id, COALESCE(u.owner_user_id, u.id) AS owner FROM xd x
               JOIN users u ON u.id = x.posted_by WHERE u.role = 'admin'""")
oracle("apply_note_deletes", """
SELECT w.* FROM weekly_money_notes w
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.owner_user_id = w.owner_user_id AND g.week_start = w.week_start)""",
       nd="""SELECT o_custkey + 1 AS posted_by,
             CAST(isoyear(CAST(o_orderdate AS DATE)) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week_text
             FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""",
       gone=f"""SELECT DISTINCT COALESCE(u.owner_user_id, u.id) AS owner_user_id,
                {WS(VALID('nd.week_text', WEEK_RE, AS_OF_WEEK))} AS week_start
                FROM nd JOIN users u ON u.id = nd.posted_by WHERE u.role = 'admin'""")
CE_RULES = f"""
SELECT f.form_seq, f.id, f.posted_by, COALESCE(u.owner_user_id, u.id) AS p_tenant, {TRIM('brand_text')} AS brand,
  {TRIM('model_text')} AS model, upper({TRIM('plate_text')}) AS plate,
  CASE WHEN {TRIM('year_text')} = '' THEN NULL ELSE CAST({PINT('year_text')} AS INT) END AS year,
  CASE WHEN f.status_text IN ('active', 'inactive') THEN f.status_text ELSE 'active' END AS status,
  concat_ws(',', CASE WHEN u.role IS NULL THEN 'no_session' END, CASE WHEN u.role = 'driver' THEN 'not_admin' END,
    CASE WHEN u.role IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cars t WHERE t.id = f.id
         AND t.owner_user_id = COALESCE(u.owner_user_id, u.id)) THEN 'other_owner' END,
    CASE WHEN {TRIM('brand_text')} = '' OR {TRIM('model_text')} = '' OR upper({TRIM('plate_text')}) = ''
         THEN 'missing_fields' END) AS rules
FROM ce f LEFT JOIN users u ON u.id = f.posted_by"""
CARS_EDIT = dict(ce=CAR_EDITS, ce_rules=CE_RULES,
                 **SETTLED("""SELECT form_seq AS seq, id AS row, rules = '' AS may, TRUE AS writes,
                              CAST(p_tenant AS VARCHAR) || '|' || plate AS wants FROM ce_rules""",
                           "SELECT id AS row, CAST(owner_user_id AS VARCHAR) || '|' || plate AS key FROM cars"),
                 cjudged="""SELECT e.* EXCLUDE (rules, p_tenant), CASE WHEN v.why = 'taken' THEN 'duplicate_plate' ELSE e.rules END AS reasons
                            FROM ce_rules e JOIN verdict v ON v.seq = e.form_seq""")
oracle("apply_car_edits", """
SELECT c.id, c.owner_user_id,
  CASE WHEN n.id IS NOT NULL THEN n.brand ELSE c.brand END AS brand,
  CASE WHEN n.id IS NOT NULL THEN n.model ELSE c.model END AS model,
  CASE WHEN n.id IS NOT NULL THEN n.plate ELSE c.plate END AS plate,
  CASE WHEN n.id IS NOT NULL THEN n.status ELSE c.status END AS status,
  c.current_driver_id
FROM cars c LEFT JOIN (SELECT * FROM cjudged WHERE reasons = '') n ON n.id = c.id""", **CARS_EDIT)
oracle("car_edit_rejects", "SELECT * FROM cjudged WHERE reasons <> ''", **CARS_EDIT)

UKEYS = [("daily_entries", KEY), ("drivers", ("owner_user_id", "dni")), ("cars", ("owner_user_id", "plate")),
         ("users", ("username",)), ("weekly_money_notes", ("owner_user_id", "week_start"))]
oracle("unique_violations", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS table_name, '{",".join(k)}' AS key_columns,
        concat_ws('|', {", ".join(f"CAST({c} AS VARCHAR)" for c in k)}) AS key_value, COUNT(*) AS rows
        FROM {t} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in k)}
        GROUP BY {", ".join(k)} HAVING COUNT(*) > 1""" for t, k in UKEYS))

oracle("delete_effects_cars", """
SELECT r.id, COALESCE(e.n, 0) AS entries_count, COALESCE(e.n, 0) > 0 AS blocked
FROM (SELECT id FROM cars WHERE status = 'inactive') r
LEFT JOIN (SELECT car_id, COUNT(*) AS n FROM daily_entries GROUP BY 1) e ON e.car_id = r.id""")
oracle("delete_effects_users", """
SELECT r.id, COALESCE(t.n, 0) AS tokens_deleted, COALESCE(e.n, 0) AS entries_unlinked,
  COALESCE(x.n, 0) AS expenses_unlinked, COALESCE(w.n, 0) AS notes_unlinked, FALSE AS blocked
FROM (SELECT id FROM users WHERE is_active = 0) r
LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM access_tokens GROUP BY 1) t ON t.user_id = r.id
LEFT JOIN (SELECT created_by, COUNT(*) AS n FROM daily_entries GROUP BY 1) e ON e.created_by = r.id
LEFT JOIN (SELECT created_by, COUNT(*) AS n FROM general_expenses GROUP BY 1) x ON x.created_by = r.id
LEFT JOIN (SELECT updated_by, COUNT(*) AS n FROM weekly_money_notes GROUP BY 1) w ON w.updated_by = r.id""")

oracle("note_rejects", """
SELECT * FROM (
  SELECT p.*, concat_ws(',', CASE WHEN u.role IS NULL THEN 'no_session' END,
                             CASE WHEN u.role = 'driver' THEN 'not_admin' END,
                             CASE WHEN trim(p.notes_text) = '' THEN 'empty_note' END) AS reasons
  FROM np p LEFT JOIN users u ON u.id = p.posted_by) x
WHERE reasons <> ''""", np=NOTE_POSTS)

# --- appended cars and users ------------------------------------------------------------

NCF = f"""
SELECT f.form_seq, f.posted_by, COALESCE(u.owner_user_id, u.id) AS owner_user_id, {TRIM('f.brand_text')} AS brand,
  {TRIM('f.model_text')} AS model, upper({TRIM('f.plate_text')}) AS plate,
  CASE WHEN {TRIM('f.year_text')} = '' THEN NULL ELSE CAST({PINT('f.year_text')} AS INT) END AS year,
  CASE WHEN f.status_text IN ('active', 'inactive') THEN f.status_text ELSE 'active' END AS status,
  concat_ws(',', CASE WHEN u.role IS NULL THEN 'no_session' END, CASE WHEN u.role = 'driver' THEN 'not_admin' END,
            CASE WHEN {TRIM('f.brand_text')} = '' OR {TRIM('f.model_text')} = '' OR upper({TRIM('f.plate_text')}) = ''
                 THEN 'missing_fields' END) AS base_reasons
FROM car_forms f LEFT JOIN users u ON u.id = f.posted_by"""
NCJ = """
SELECT n.form_seq, n.posted_by, n.owner_user_id, n.brand, n.model, n.plate, n.year, n.status,
  concat_ws(',', CASE WHEN n.base_reasons <> '' THEN n.base_reasons END,
    CASE WHEN n.base_reasons = '' AND EXISTS (SELECT 1 FROM cars c WHERE c.owner_user_id = n.owner_user_id
                                              AND c.plate = n.plate) THEN 'duplicate'
         WHEN n.base_reasons = '' AND EXISTS (SELECT 1 FROM ncf o WHERE o.base_reasons = '' AND o.form_seq < n.form_seq
                                              AND o.owner_user_id = n.owner_user_id AND o.plate = n.plate)
         THEN 'duplicate' END) AS reasons
FROM ncf n"""
NEW_CARS = dict(car_forms=CAR_FORMS, ncf=NCF, ncj=NCJ)
oracle("append_cars", """
SELECT id, owner_user_id, brand, model, plate, status, current_driver_id FROM cars
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM cars) + form_seq, owner_user_id, brand, model, plate, status,
       CAST(NULL AS BIGINT) FROM ncj WHERE reasons = ''""", **NEW_CARS)
oracle("new_car_rejects", "SELECT * FROM ncj WHERE reasons <> ''", **NEW_CARS)

USER_FORMS = f"""
SELECT c_custkey + 1 AS form_seq, CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1 ELSE {MANAGER_ID} END AS posted_by,
  ' ' || c_name || ' Jr' AS full_name_text,
  CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '.jr' ELSE lower(c_name) END AS username_text,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'secret' END AS password_text,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'chofer' END AS role_text,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % {NSUP} + 1 AS VARCHAR) END AS driver_id_text,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS is_active
FROM customer"""
ROLE = ENUM('f.role_text', ('admin', 'driver'), 'driver')
NUJ = f"""
SELECT f.*, p.role AS p_role, COALESCE(p.owner_user_id, p.id) AS owner_user_id, p.username AS m_username,
  {ROLE} AS role,
  CASE WHEN {ROLE} = 'admin' THEN NULL WHEN {TRIM('f.driver_id_text')} = '' THEN NULL
       ELSE {PINT('f.driver_id_text')} END AS driver_id,
  {TRIM('f.full_name_text')} AS full_name, {TRIM('f.username_text')} AS username
FROM uf f LEFT JOIN users p ON p.id = f.posted_by"""
NUB = """
SELECT u.*, concat_ws(',',
  CASE WHEN NOT COALESCE(u.p_role = 'admin' AND u.m_username = (SELECT MIN(username) FROM users WHERE role = 'admin'), FALSE) THEN 'not_user_manager' END,
  CASE WHEN u.full_name = '' OR u.username = '' THEN 'missing_fields' END,
  CASE WHEN COALESCE(u.password_text, '') = '' THEN 'no_password' END,
  CASE WHEN u.driver_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM drivers d WHERE d.id = u.driver_id
       AND d.owner_user_id = u.owner_user_id) THEN 'driver_not_in_owner' END) AS base_reasons
FROM nuj u"""
NUR = """
SELECT n.form_seq, n.posted_by, n.full_name, n.username, n.role, n.driver_id, n.owner_user_id, n.is_active,
  concat_ws(',', CASE WHEN n.base_reasons <> '' THEN n.base_reasons END,
    CASE WHEN n.base_reasons = '' AND (EXISTS (SELECT 1 FROM users x WHERE x.username = n.username)
         OR EXISTS (SELECT 1 FROM nub o WHERE o.base_reasons = '' AND o.username = n.username
                    AND o.form_seq < n.form_seq))
         THEN 'duplicate_username' END) AS reasons
FROM nub n"""
NEW_USERS = dict(uf=USER_FORMS, nuj=NUJ, nub=NUB, nur=NUR)
oracle("append_users", """
SELECT id, full_name, username, role, driver_id, owner_user_id, is_active FROM users
UNION ALL
SELECT (SELECT COALESCE(MAX(id), 0) FROM users) + form_seq, full_name, username, role, driver_id, owner_user_id,
       is_active FROM nur WHERE reasons = ''""", **NEW_USERS)
oracle("new_user_rejects", "SELECT * FROM nur WHERE reasons <> ''", **NEW_USERS)

# --- driver form saves --------------------------------------------------------------------

DRIVER_SAVES = f"""
SELECT c_custkey + 1 AS change_seq,
  CASE WHEN c_custkey % 10 = 0 THEN c_custkey * 11 % {NCUST} + 1 ELSE a.tenant_admin END AS posted_by,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(0 AS BIGINT) ELSE c_custkey % {NSUP} + 1 END AS id,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name || ' ' END AS full_name_text,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE CAST(30000000 + c_custkey * 7 % 90 AS VARCHAR) END AS dni_text,
  CASE WHEN c_acctbal > 5000 THEN 'inactive' ELSE 'active' END AS status_text,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN CAST(c_custkey * 17 % {NPART} + 1 AS VARCHAR)
       ELSE CAST(d.owner_user_id + 5 * (c_custkey % 30) AS VARCHAR) END AS assigned_car_text
FROM customer LEFT JOIN drivers d ON d.id = c_custkey % {NSUP} + 1 LEFT JOIN {ADMIN_OF} a ON a.o = d.owner_user_id"""
DSP = f"""
SELECT s.*, u.role AS p_role, COALESCE(u.owner_user_id, u.id) AS p_tenant,
  trim(s.full_name_text) AS full_name, NULLIF(trim(s.dni_text), '') AS dni,
  CASE WHEN trim(s.assigned_car_text) = '' THEN NULL ELSE TRY_CAST(trim(s.assigned_car_text) AS BIGINT) END AS car_id,
  {ENUM('s.status_text', ('active', 'inactive'), 'active')} AS status
FROM ds s LEFT JOIN users u ON u.id = s.posted_by"""
DSQ = """
SELECT d.*,
  (d.car_id IS NULL OR EXISTS (SELECT 1 FROM cars c WHERE c.id = d.car_id AND c.owner_user_id = d.p_tenant
                                AND c.status = 'active')) AS car_ok,
  (d.id = 0 OR EXISTS (SELECT 1 FROM drivers x WHERE x.id = d.id AND x.owner_user_id = d.p_tenant)) AS writes_driver
FROM dsp d"""
DSW = """
SELECT d.*, concat_ws(',',
    CASE WHEN d.p_role IS NULL THEN 'no_session' END,
    CASE WHEN d.p_role = 'driver' THEN 'not_admin' END,
    CASE WHEN d.p_role = 'admin' AND d.full_name = '' THEN 'no_name' END,
    CASE WHEN d.p_role = 'admin' AND d.full_name <> '' AND NOT d.car_ok THEN 'car_unavailable' END) AS rules
FROM dsq d"""
DSJ = """
SELECT d.change_seq, d.posted_by, d.id, d.p_tenant AS owner_user_id, d.full_name, d.dni, d.status, d.car_id,
  d.writes_driver, CASE WHEN v.why = 'taken' THEN 'duplicate_dni' ELSE d.rules END AS reasons
FROM dsw d JOIN verdict v ON v.seq = d.change_seq"""
SAVES = dict(ds=DRIVER_SAVES, dsp=DSP, dsq=DSQ, dsw=DSW,
             **SETTLED("""SELECT change_seq AS seq, CASE WHEN id > 0 THEN id ELSE -change_seq END AS row, rules = '' AS may,
                          writes_driver AS writes, CASE WHEN writes_driver THEN CAST(p_tenant AS VARCHAR) || '|' || dni END AS wants
                          FROM dsw""", STORED_DNI),
             dsj=DSJ,
             ok="SELECT * FROM dsj WHERE reasons = ''",
             top="SELECT COALESCE(MAX(id), 0) AS top FROM drivers")
oracle("driver_save_rejects", """
SELECT change_seq, posted_by, id, owner_user_id, full_name, dni, status, car_id, reasons FROM dsj
WHERE reasons <> ''""", **SAVES)
DRIVERS_SAVED = """
SELECT d.id, d.owner_user_id,
  CASE WHEN e.id IS NOT NULL THEN e.full_name ELSE d.full_name END AS full_name,
  CASE WHEN e.id IS NOT NULL THEN e.dni ELSE d.dni END AS dni,
  CASE WHEN e.id IS NOT NULL THEN e.status ELSE d.status END AS status
FROM drivers d LEFT JOIN edits e ON e.id = d.id
UNION ALL
SELECT (SELECT top FROM top) + change_seq, owner_user_id, full_name, dni, status FROM ok WHERE id = 0"""
SAVED_EDITS = """SELECT * FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY id ORDER BY change_seq DESC,
                full_name DESC NULLS LAST, dni DESC NULLS LAST, status DESC NULLS LAST) AS rn
                FROM ok o WHERE o.id > 0 AND o.writes_driver) x WHERE rn = 1"""
oracle("driver_saves", DRIVERS_SAVED, **SAVES, edits=SAVED_EDITS)
CARS_SAVED = """
SELECT c1.id, c1.owner_user_id, c1.brand, c1.model, c1.plate, c1.status,
  CASE WHEN lp.lp_seq IS NOT NULL AND (c1.since IS NULL OR lp.lp_seq > c1.since) THEN NULL ELSE c1.holder END
    AS current_driver_id
FROM c1 LEFT JOIN last_post lp ON lp.lp_owner = c1.owner_user_id AND lp.lp_driver = c1.holder"""
SAVED_ASSIGNMENTS = dict(
       asg="""SELECT change_seq, posted_by, CASE WHEN id > 0 THEN id ELSE (SELECT top FROM top) + change_seq END
              AS driver_id, car_id FROM ok""",
       ap=ASG_P,
       valid="SELECT * FROM ap WHERE p_role = 'admin' AND car_ok",
       last_post="SELECT p_tenant AS lp_owner, driver_id AS lp_driver, MAX(change_seq) AS lp_seq FROM valid GROUP BY 1, 2",
       last_set="""SELECT car_id AS ls_car, driver_id AS ls_driver, change_seq AS ls_seq FROM (
                   SELECT v.*, ROW_NUMBER() OVER (PARTITION BY car_id ORDER BY change_seq DESC, driver_id DESC) AS rn
                   FROM valid v WHERE car_id IS NOT NULL) x WHERE rn = 1""",
       c1="""SELECT c.*, CASE WHEN ls.ls_car IS NOT NULL THEN ls.ls_driver ELSE c.current_driver_id END AS holder,
             ls.ls_seq AS since FROM cars c LEFT JOIN last_set ls ON ls.ls_car = c.id""")
oracle("driver_save_cars", CARS_SAVED, **SAVES, **SAVED_ASSIGNMENTS)

# --- deletes with their referential actions -------------------------------------------------

DELETES = dict(
    **SAVES, edits=SAVED_EDITS, **SAVED_ASSIGNMENTS, saved_drivers=DRIVERS_SAVED, saved_cars=CARS_SAVED,
    out_users="SELECT id FROM users WHERE is_active = 0",
    out_cars="SELECT id FROM saved_cars WHERE status = 'inactive' AND id NOT IN (SELECT car_id FROM daily_entries)",
    out_drivers="SELECT id FROM saved_drivers WHERE status = 'inactive' AND id NOT IN (SELECT driver_id FROM daily_entries)")
oracle("delete_outcomes", """
SELECT 'drivers' AS table_name, id, CASE WHEN id IN (SELECT id FROM out_drivers) THEN 'deleted' ELSE 'restricted' END AS outcome
FROM saved_drivers WHERE status = 'inactive'
UNION ALL SELECT 'cars', id, CASE WHEN id IN (SELECT id FROM out_cars) THEN 'deleted' ELSE 'restricted' END FROM saved_cars WHERE status = 'inactive'
UNION ALL SELECT 'users', id, 'deleted' FROM out_users""", **DELETES)


def CLEARED(col: str, out: str) -> str:
    return f"CASE WHEN {col} NOT IN (SELECT id FROM {out}) THEN {col} END AS {col}"


oracle("deleted_drivers", "SELECT * FROM saved_drivers WHERE id NOT IN (SELECT id FROM out_drivers)", **DELETES)
oracle("deleted_cars", f"""
SELECT * REPLACE ({CLEARED('current_driver_id', 'out_drivers')}) FROM saved_cars WHERE id NOT IN (SELECT id FROM out_cars)""", **DELETES)
oracle("deleted_users", f"""
SELECT * REPLACE ({CLEARED('driver_id', 'out_drivers')}) FROM users WHERE id NOT IN (SELECT id FROM out_users)""", **DELETES)
oracle("deleted_tokens", "SELECT * FROM access_tokens WHERE user_id NOT IN (SELECT id FROM out_users)", **DELETES)
oracle("deleted_entries", f"SELECT * REPLACE ({CLEARED('created_by', 'out_users')}) FROM daily_entries", **DELETES)
oracle("deleted_expenses", f"SELECT * REPLACE ({CLEARED('created_by', 'out_users')}) FROM general_expenses", **DELETES)
oracle("deleted_notes", f"SELECT * REPLACE ({CLEARED('updated_by', 'out_users')}) FROM weekly_money_notes", **DELETES)

# --- names as the source database compares them ----------------------------------------------

ACCOUNT_NAMES = """
SELECT c_custkey + 1 AS id, CASE c_custkey % 4
  WHEN 0 THEN upper('josé pérez ' || CAST(c_custkey % 400 AS VARCHAR))
  WHEN 1 THEN 'jose perez ' || CAST(c_custkey % 400 AS VARCHAR) || '  '
  WHEN 2 THEN 'José Pérez ' || CAST(c_custkey % 400 AS VARCHAR)
  ELSE 'ñandú ' || CAST(c_custkey % 300 AS VARCHAR) END AS username
FROM customer"""
PLAIN = "lower(strip_accents(rtrim(username)))"
oracle("unique_names", f"SELECT MIN(id) AS first_id, COUNT(*) AS rows FROM names GROUP BY {PLAIN} HAVING COUNT(*) > 1", names=ACCOUNT_NAMES)
oracle("names_in_order", f"SELECT id, username, DENSE_RANK() OVER (ORDER BY {PLAIN}) AS place FROM names", names=ACCOUNT_NAMES)

# --- requested periods ------------------------------------------------------------------------

REQUESTS = f"""
SELECT c_custkey + 1 AS request_id, c_custkey % 5 + 1 AS owner_user_id,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % {NSUP} + 1 END AS driver_id,
  CASE WHEN c_custkey % 7 = 0 THEN 'year' WHEN c_custkey % 3 = 0 THEN 'day' WHEN c_custkey % 3 = 1 THEN 'week' ELSE 'month' END AS period_text,
  CASE WHEN c_custkey % 11 = 0 THEN '1997-02-31' WHEN c_custkey % 13 = 0 THEN 'hoy' ELSE strftime(d, '%Y-%m-%d') END AS date_text,
  strftime(d, '%G-W%V') AS week_text, CASE WHEN c_custkey % 17 = 0 THEN '1997-13' ELSE strftime(d, '%Y-%m') END AS month_text
FROM (SELECT c_custkey, DATE '1996-12-20' + CAST(c_custkey % 800 AS INT) AS d FROM customer) x"""
RANGES = f"""
SELECT request_id, owner_user_id, driver_id, period,
  CASE period WHEN 'day' THEN TRY_CAST(d AS DATE) WHEN 'week' THEN {WS('w')} ELSE TRY_CAST(m || '-01' AS DATE) END AS start_date,
  CASE period WHEN 'day' THEN TRY_CAST(d AS DATE) WHEN 'week' THEN {WS('w')} + 6 ELSE last_day(TRY_CAST(m || '-01' AS DATE)) END AS end_date
FROM (SELECT *, CASE WHEN period_text IN ('day', 'month') THEN period_text ELSE 'week' END AS period,
             {VALID('date_text', DATE_RE, AS_OF_DAY)} AS d, {VALID('week_text', WEEK_RE, AS_OF_WEEK)} AS w, {VALID('month_text', MONTH_RE, AS_OF_MONTH)} AS m
      FROM requests) x"""
oracle("requested_totals", f"""
SELECT r.request_id, r.period, r.start_date, r.end_date, COUNT(e.entry_date) AS entries, COUNT(DISTINCT e.entry_date) AS days,
  {Z('SUM(e.gross_income)', 'gross')}, {Z('SUM(e.net_total)', 'net')}
FROM ranges r LEFT JOIN daily_entries e ON e.owner_user_id = r.owner_user_id AND e.entry_date BETWEEN r.start_date AND r.end_date
  AND (r.driver_id IS NULL OR e.driver_id = r.driver_id)
GROUP BY r.request_id, r.period, r.start_date, r.end_date""", requests=REQUESTS, ranges=RANGES)
