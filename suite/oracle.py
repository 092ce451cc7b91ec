"""The same results in SQL on the same tables, written independently of the operators."""

from __future__ import annotations

from suite.fixtures import BANDS, LINE_ORDER

_ORDER = ", ".join(LINE_ORDER)
_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
_DISC = "CAST(l_discount AS DECIMAL(4,2))"
_TAX = "CAST(l_tax AS DECIMAL(4,2))"
_ONE = "CAST(1 AS DECIMAL(1,0))"
_HALF = "CAST(0.5 AS DECIMAL(2,1))"
_WS = r"E' \t\n\r'"

NOTE = (
    "CASE WHEN o_orderpriority = '5-LOW' THEN '  ' WHEN o_orderpriority = '1-URGENT' THEN '' "
    "ELSE ' ' || o_orderpriority END"
)
CLEAN_NOTE = "CASE WHEN trim(note) <> '' THEN note END"

STAGES = f"""
WITH first_line AS (
  SELECT l_orderkey, {_ORDER} FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn FROM lineitem) WHERE rn = 1),
stage_1 AS (
  SELECT l_orderkey, l_linenumber, l_returnflag, o_orderpriority, c_mktsegment, n_name, {NOTE} AS note,
         {_PRICE} AS price_list, {_DISC} AS rate_discount
  FROM first_line JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey),
stage_2 AS (
  SELECT l_orderkey, {_PRICE} * ({_ONE} - {_DISC}) AS price_discounted,
         {_PRICE} * ({_ONE} - {_DISC} * {_HALF}) AS price_half_discounted, {_TAX} AS rate_tax
  FROM first_line WHERE l_returnflag <> 'R'),
stage_3 AS (
  SELECT l_orderkey, {_PRICE} * ({_ONE} - {_DISC}) * ({_ONE} + {_TAX}) AS price_taxed,
         {_PRICE} * ({_ONE} - {_DISC} * {_HALF}) * ({_ONE} + {_TAX} * {_HALF}) AS price_half_taxed,
         {_DISC} + {_TAX} AS rate_both
  FROM first_line WHERE l_linestatus <> 'O')"""

MERGED = f"""{STAGES},
merged AS (
  SELECT stage_1.l_orderkey, l_returnflag, o_orderpriority, c_mktsegment, n_name, {CLEAN_NOTE} AS note,
         price_list AS "Net_1", price_discounted AS "Net_2", price_taxed AS "Net_3",
         price_list AS "Net_1_rn", price_half_discounted AS "Net_2_rn", price_half_taxed AS "Net_3_rn",
         rate_discount AS "Rate_1", rate_tax AS "Rate_2", rate_both AS "Rate_3"
  FROM stage_1 JOIN stage_2 ON stage_1.l_orderkey = stage_2.l_orderkey
       JOIN stage_3 ON stage_1.l_orderkey = stage_3.l_orderkey)"""

_STEPS = (("0", "1", "3"), ("1", "1", "2"), ("2", "2", "3"))
_SERIES = (("Net", ""), ("Net", "_rn"), ("Rate", ""))


def _step_columns() -> str:
    parts = []
    for item, rn in _SERIES:
        for step, a, b in _STEPS:
            start, end = f'"{item}_{a}{rn}"', f'"{item}_{b}{rn}"'
            parts.append(f'CAST({end} - {start} AS DOUBLE) AS "diff_{item}_step_{step}{rn}"')
            parts.append(
                f"CASE WHEN {start} <> 0 THEN CAST({end} - {start} AS DOUBLE) / CAST({start} AS DOUBLE) END "
                f'AS "percent_diff_{item}_step_{step}{rn}"'
            )
    return ",\n         ".join(parts)


DIFFS = f"""{MERGED},
diffs AS (
  SELECT l_orderkey, note, "Net_1", "Net_2", "Net_1_rn",
         {_step_columns()}
  FROM merged)"""


_CHOSEN = DIFFS.replace(
    "FROM merged)", "FROM merged WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND (note IS NULL OR note = ' 2-HIGH'))"
)


def _band(value: str) -> str:
    whens = "".join(f" WHEN {value} >= {band.start} THEN '{band.name}'" for band in reversed(BANDS))
    return f"CASE WHEN {value} IS NULL THEN 'Missing' WHEN {value} = 'inf'::DOUBLE THEN 'Out of Range'{whens} ELSE 'Out of Range' END"


_BAND_LIST = ", ".join(f"({n}, '{name}')" for n, name in enumerate([b.name for b in BANDS] + ["Missing", "Out of Range"]))
_STEP_NAMES = {"0": "Overall", "1": "Discounted", "2": "Taxed"}


def _distribution(series: tuple[tuple[str, str], ...], diffs: str = DIFFS) -> str:
    """Counts and shares by item, step, segment and band, zero-filled, as table ``dist``."""
    long = "\n  UNION ALL ".join(
        f"SELECT '{item}' AS item, {step} AS step, '{_STEP_NAMES[step]}' AS step_name, '{'RN' if rn else 'NB'}' AS segment, "
        + _band(f'"percent_diff_{item}_step_{step}{rn}"')
        + " AS band FROM diffs"
        for item, rn in series
        for step, _, _ in _STEPS
    )
    return f"""{diffs},
long AS (
  {long}),
counts AS (SELECT item, step, segment, band, count(*) AS count FROM long GROUP BY ALL),
frame AS (
  SELECT * FROM (SELECT DISTINCT item, step, step_name, segment FROM long)
  CROSS JOIN (VALUES {_BAND_LIST}) AS b(band_order, band)),
dist AS (
  SELECT f.item, f.step, f.step_name, f.segment, f.band_order, f.band, coalesce(c.count, 0) AS count,
         round_even(coalesce(c.count, 0)::DOUBLE / (SELECT count(*) FROM diffs)::DOUBLE * 100 * 100, 0) / 100 AS percentage
  FROM frame f LEFT JOIN counts c ON f.item = c.item AND f.step = c.step AND f.segment = c.segment AND f.band = c.band
  WHERE f.band_order < {len(BANDS)} OR c.count > 0)"""


_RATE_1 = "item = 'Rate' AND step = 1 AND segment = 'NB'"

_TOTALS = f"""{MERGED},
totals AS (
  SELECT item, stage_idx, stage_name, coalesce(total, 0) AS total FROM (
    SELECT 'Net' AS item, 0 AS stage_idx, 'List' AS stage_name, CAST(sum("Net_1") AS DECIMAL(38,6)) AS total FROM merged
    UNION ALL SELECT 'Net', 1, 'Discounted', CAST(sum("Net_2") AS DECIMAL(38,6)) FROM merged
    UNION ALL SELECT 'Net', 2, 'Taxed', CAST(sum("Net_3") AS DECIMAL(38,6)) FROM merged
    UNION ALL SELECT 'Rate', 0, 'List', CAST(sum("Rate_1") AS DECIMAL(38,6)) FROM merged
    UNION ALL SELECT 'Rate', 1, 'Discounted', CAST(sum("Rate_2") AS DECIMAL(38,6)) FROM merged
    UNION ALL SELECT 'Rate', 2, 'Taxed', CAST(sum("Rate_3") AS DECIMAL(38,6)) FROM merged)),
report AS (
  SELECT item, stage_idx, stage_name, CAST(total AS DOUBLE) AS value_total,
         coalesce(CAST(total - lag(total) OVER w AS DOUBLE), 0) AS value_diff,
         CAST(total AS DOUBLE) / nullif(CAST(first_value(total) OVER w AS DOUBLE), 0) AS value_total_percent,
         coalesce(CAST(total - lag(total) OVER w AS DOUBLE)
                  / nullif(CAST(first_value(total) OVER w AS DOUBLE), 0), 0) AS value_diff_percent,
         CAST(total - first_value(total) OVER w AS DOUBLE) AS moved
  FROM totals WINDOW w AS (PARTITION BY item ORDER BY stage_idx))"""

_GROUPED = """
  SELECT '{item}' AS item, {keys}, {level}
         CAST(coalesce(sum("{item}_1"), 0) AS DOUBLE) AS value_total_start,
         CAST(coalesce(sum("{item}_3"), 0) AS DOUBLE) AS value_total_end,
         count(*) AS policy_count,
         CAST(coalesce(sum("{item}_3"), 0) - coalesce(sum("{item}_1"), 0) AS DOUBLE) AS value_diff,
         CASE WHEN coalesce(sum("{item}_1"), 0) = 0 THEN 0 ELSE
           CAST(coalesce(sum("{item}_3"), 0) - coalesce(sum("{item}_1"), 0) AS DOUBLE)
           / CAST(sum("{item}_1") AS DOUBLE) * 100 END AS value_diff_percent
  FROM merged GROUP BY {group}"""


def _grouped(keys: str, group: str, level: str = "") -> str:
    return MERGED + " UNION ALL ".join(
        _GROUPED.format(item=item, keys=keys, group=group, level=level) for item in ("Net", "Rate")
    )


_CODES = """
WITH codes AS (
  SELECT c_custkey, CASE c_custkey % 5
    WHEN 0 THEN '  ' || c_mktsegment || ' ' WHEN 1 THEN lower(c_mktsegment)
    WHEN 2 THEN c_mktsegment || ' ' || c_mktsegment
    WHEN 3 THEN ' ' || substr(c_mktsegment, 1, 4) || E' 12\\t' END AS code FROM customer)"""

_NUMBERS = """
WITH numbers AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 8
    WHEN 0 THEN price WHEN 1 THEN ' -' || price WHEN 2 THEN price || 'e8' WHEN 3 THEN 'x' || price
    WHEN 4 THEN whole WHEN 5 THEN '+' || whole || '.0 ' WHEN 6 THEN whole || '0000000' END AS number
  FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
               CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS whole FROM lineitem)),
parsed AS (SELECT *, TRY_CAST(trim(number) AS DOUBLE) AS x FROM numbers)"""

_AMOUNTS = """
WITH amounts AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) * CASE WHEN l_partkey % 4 = 0 THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END AS amount
  FROM lineitem),
texts AS (SELECT *, rtrim(printf('%.4f', amount), '0') AS text FROM amounts),
counted AS (SELECT *, length(text) - 1 + CASE WHEN text LIKE '%.' THEN 1 ELSE 0 END AS digits FROM texts)"""

_PARTS = """
WITH flags AS (
  SELECT p_partkey, p_retailprice, CAST(p_size > 10 AS INTEGER) AS is_large, CAST(p_size > 25 AS INTEGER) AS is_huge,
         CAST(p_retailprice > 950 AS INTEGER) AS is_costly,
         CASE WHEN p_size <> 30 THEN 1 - p_size % 2 END AS is_even,
         CASE WHEN p_partkey % 3 = 0 THEN 1 END AS is_third FROM part),
arrays AS (
  SELECT p_partkey AS "PART", CAST(CAST(printf('%.4f', p_retailprice) AS DECIMAL(38,4)) AS DOUBLE) AS "PRICE",
         [is_large, is_huge] AS size_values,
         [x for x in [is_costly, is_even, is_third] if x IS NOT NULL] AS price_values,
         [x for x in [CASE WHEN is_large = 1 THEN 'is_large' END, CASE WHEN is_huge = 1 THEN 'is_huge' END]
          if x IS NOT NULL] AS size_names,
         [x for x in [CASE WHEN is_costly = 1 THEN 'is_costly' END, CASE WHEN is_even = 1 THEN 'is_even' END,
                      CASE WHEN is_third = 1 THEN 'is_third' END] if x IS NOT NULL] AS price_names
  FROM flags)"""

_SHIP = "strftime(l_shipdate, '%d/%m/%Y')"
_ID = "l_orderkey, l_linenumber"
_LONG_ID = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"

_CONVERTED_CUSTOMER = """
  c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' WHEN 'MACHINERY' THEN 'MACHINE' ELSE c_mktsegment END AS segment,
  c_acctbal, c_name, c_nationkey"""

ORACLE: dict[str, str] = {
    "scan_csv": """
SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code,
       CASE WHEN c_nationkey NOT IN (3, 4) THEN c_mktsegment END AS segment,
       c_name || ', "x"' AS name, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS balance FROM customer""",
    "scan_csv_split": """
SELECT CAST(o_orderkey AS VARCHAR) AS code,
       CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || E'\\n"' || o_orderstatus || E'",\\n\\n' WHEN 1 THEN o_orderstatus END AS comment,
       CAST(o_custkey AS VARCHAR) AS customer FROM orders""",
    "scan_stages": f"""{STAGES}
SELECT 'stage_1' AS stage_table, 'price_list' AS source, count(*) AS row_count, CAST(sum(price_list) AS DOUBLE) AS total FROM stage_1
UNION ALL SELECT 'stage_2' AS stage_table, 'price_discounted' AS source, count(*) AS row_count, CAST(sum(price_discounted) AS DOUBLE) AS total FROM stage_2
UNION ALL SELECT 'stage_3' AS stage_table, 'price_taxed' AS source, count(*) AS row_count, CAST(sum(price_taxed) AS DOUBLE) AS total FROM stage_3
UNION ALL SELECT 'stage_1' AS stage_table, 'rate_discount' AS source, count(*) AS row_count, CAST(sum(rate_discount) AS DOUBLE) AS total FROM stage_1
UNION ALL SELECT 'stage_2' AS stage_table, 'rate_tax' AS source, count(*) AS row_count, CAST(sum(rate_tax) AS DOUBLE) AS total FROM stage_2
UNION ALL SELECT 'stage_3' AS stage_table, 'rate_both' AS source, count(*) AS row_count, CAST(sum(rate_both) AS DOUBLE) AS total FROM stage_3""",
    "sink_converted": f"""
SELECT CAST(c_custkey AS VARCHAR) AS "ID", segment AS "SEGMENT", CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS "BALANCE",
       c_name AS "NAME", CAST(c_nationkey AS VARCHAR) AS "NATION" FROM (SELECT {_CONVERTED_CUSTOMER} FROM customer)""",
    "sink_impact": _distribution((("Net", ""), ("Rate", ""))) + f""",
totals AS ({'''
  SELECT 'Net/List' AS part, CAST(sum("Net_1") AS DOUBLE) AS value FROM merged
  UNION ALL SELECT 'Net/Discounted', CAST(sum("Net_2") AS DOUBLE) FROM merged
  UNION ALL SELECT 'Net/Taxed', CAST(sum("Net_3") AS DOUBLE) FROM merged
  UNION ALL SELECT 'Rate/List', CAST(sum("Rate_1") AS DOUBLE) FROM merged
  UNION ALL SELECT 'Rate/Discounted', CAST(sum("Rate_2") AS DOUBLE) FROM merged
  UNION ALL SELECT 'Rate/Taxed', CAST(sum("Rate_3") AS DOUBLE) FROM merged'''})
SELECT 'merged_data' AS output, 'rows' AS part, CAST(count(*) AS DOUBLE) AS value FROM merged
UNION ALL SELECT 'merged_data', column_name, total FROM (UNPIVOT (
  SELECT CAST(sum("Net_1") AS DOUBLE) AS "Net_1", CAST(sum("Net_2") AS DOUBLE) AS "Net_2", CAST(sum("Net_3") AS DOUBLE) AS "Net_3",
         CAST(sum("Rate_1") AS DOUBLE) AS "Rate_1", CAST(sum("Rate_2") AS DOUBLE) AS "Rate_2", CAST(sum("Rate_3") AS DOUBLE) AS "Rate_3"
  FROM merged) ON COLUMNS(*) INTO NAME column_name VALUE total)
UNION ALL SELECT 'summary_table', part, value FROM totals
UNION ALL SELECT 'band_distribution', concat_ws('/', item, step, step_name, segment, band, count), percentage FROM dist""",
    "sink_filtered": f"""{DIFFS}
SELECT l_orderkey, note, CAST("Net_1" AS DOUBLE) AS "Net_1", CAST("Net_2" AS DOUBLE) AS "Net_2", "percent_diff_Net_step_1"
FROM diffs WHERE "percent_diff_Net_step_1" BETWEEN -0.055 AND -0.015""",
    "resolve_columns": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "check_required": """
WITH headers AS (
  SELECT table_name, lower(column_name) AS header FROM information_schema.columns WHERE table_name IN ('customer', 'supplier', 'part')
), required(rule_set, source, place) AS (
  VALUES ('customer_rules', 'C CUSTKEY', 1), ('customer_rules', 'c_mktsegment', 2), ('customer_rules', 'c_acctbal', 3),
         ('part_rules', 'p_partkey', 1), ('part_rules', 'p_retailprice', 2)
), sizes AS (
  SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
  UNION ALL SELECT 'part', count(*) FROM part
)
SELECT table_name, rule_set, row_count,
       coalesce(string_agg(source, ',' ORDER BY place) FILTER (WHERE NOT EXISTS (
         SELECT 1 FROM headers h WHERE h.table_name = sizes.table_name AND replace(h.header, '_', ' ') = replace(lower(source), '_', ' '))), '') AS missing
FROM sizes CROSS JOIN required GROUP BY table_name, rule_set, row_count""",
    "project_mapped": """
SELECT c_custkey AS "ID", c_mktsegment AS "SEGMENT", c_acctbal AS "BALANCE", c_name AS "NAME", c_nationkey AS "NATION" FROM customer""",
    "stage_columns": f"""{STAGES}
SELECT l_orderkey, l_linenumber, l_returnflag, o_orderpriority, c_mktsegment, n_name, note,
       CAST(price_list AS DOUBLE) AS "Net_1", CAST(price_list AS DOUBLE) AS "Net_1_rn", CAST(rate_discount AS DOUBLE) AS "Rate_1"
FROM stage_1""",
    "blank_to_null": f"SELECT o_orderkey, {CLEAN_NOTE} AS note FROM (SELECT o_orderkey, {NOTE} AS note FROM orders)",
    "code_required": f"""{_CODES},
checked AS (
  SELECT c_custkey, trim(code, {_WS}) AS text,
         CASE WHEN NOT regexp_full_match(trim(code, {_WS}), '[A-Z0-9\\s]*') THEN 'only upper-case letters, digits and spaces are allowed'
              WHEN length(trim(code, {_WS})) > 12 THEN 'longer than 12 characters' END AS problem FROM codes)
SELECT c_custkey, CASE WHEN problem IS NULL THEN text END AS value, problem FROM checked""",
    "intege_required": f"""{_NUMBERS}
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN abs(trunc(x)) < 1e12 THEN CAST(trunc(x) AS BIGINT) END AS value,
       CASE WHEN number IS NOT NULL AND x IS NULL THEN 'not a number'
            WHEN abs(trunc(x)) >= 1e12 THEN 'more than 12 digits' END AS problem
FROM parsed""",
    "decima_required": f"""{_AMOUNTS}
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN digits <= 12 THEN CAST(CAST(printf('%.4f', amount) AS DECIMAL(38,4)) AS DOUBLE) END AS value,
       CASE WHEN digits > 12 THEN 'more than 12 digits' END AS problem FROM counted""",
    "date_slash": f"SELECT {_LONG_ID}, {_SHIP} AS slash_text FROM lineitem",
    "date_text": f"SELECT {_LONG_ID}, {_SHIP} AS iso_text, {_SHIP} AS us_text, {_SHIP} AS name_text FROM lineitem",
    "date_serial": f"SELECT {_LONG_ID}, {_SHIP} AS serial, {_SHIP} AS serial_text FROM lineitem",
    "code_optional": f"{_CODES} SELECT c_custkey, code AS value FROM codes",
    "intege_optional": f"""{_NUMBERS}
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x = trunc(x) THEN CAST(x AS BIGINT) END AS value,
       CASE WHEN x <> trunc(x) THEN 'not a whole number' END AS problem FROM parsed""",
    "decima_optional": f"{_NUMBERS} SELECT l_orderkey, l_linenumber, l_partkey, x AS value FROM parsed",
    "date_optional": f"""
SELECT {_ID}, CASE WHEN l_orderkey % 6 < 4 THEN {_SHIP} WHEN l_orderkey % 12 = 4 THEN '31/12/9999' END AS value,
       CASE WHEN l_orderkey % 12 = 10 THEN 'not a date' END AS problem FROM lineitem""",
    "map_values": f"""{_CODES},
value_map AS (SELECT * FROM (VALUES ('AUTOMOBILE', 'AUTO'), ('MACHINERY', 'MACHINE'), ('furniture', 'CHAIRS')) AS m(old, new))
SELECT c_custkey, coalesce(new, code) AS code FROM codes LEFT JOIN value_map ON trim(code, {_WS}) = old""",
    "conversion_errors": """
SELECT CAST(p_partkey AS VARCHAR) AS id, 'p_brand' AS "column", 'CODE' AS type, p_brand AS value,
       'only upper-case letters, digits and spaces are allowed' AS reason
FROM part WHERE NOT regexp_full_match(trim(p_brand), '[A-Z0-9 ]*')
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_type', 'CODE', p_type,
       CASE WHEN NOT regexp_full_match(trim(p_type), '[A-Z0-9 ]*') THEN 'only upper-case letters, digits and spaces are allowed'
            ELSE 'longer than 12 characters' END
FROM part WHERE NOT regexp_full_match(trim(p_type), '[A-Z0-9 ]*') OR length(trim(p_type)) > 12
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_name', 'INTEGE', p_name, 'not a number'
FROM part WHERE TRY_CAST(p_name AS DOUBLE) IS NULL
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'price', 'INTEGE', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), 'not a whole number'
FROM part WHERE p_retailprice <> trunc(p_retailprice)
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'flag_text', 'INTEGE', p_brand, 'not in the list: not of the type' FROM part WHERE p_brand IS NOT NULL""",
    "flags_to_list": f"""{_PARTS}
SELECT "PART", CAST(len(price_values) AS INTEGER) AS n, CAST(price_values[1] AS VARCHAR) AS first_item,
       array_to_string(price_values, '|') AS items FROM arrays""",
    "flags_to_names": f"""{_PARTS}
SELECT "PART", CAST(len(price_names) AS INTEGER) AS n, coalesce(array_to_string(price_names, '|'), '') AS items FROM arrays""",
    "list_to_string": f"""{_PARTS}
SELECT "PART", "PRICE", array_to_string(size_values, ';') AS "SIZE_FLAGS",
       coalesce(array_to_string(price_values, ';'), '') AS "PRICE_FLAGS" FROM arrays""",
    "explode_list": f"""{_PARTS},
positions AS (SELECT *, unnest(range(greatest(len(price_names), 1))) AS pos FROM arrays)
SELECT "PART", CASE WHEN pos = 0 THEN "PRICE" END AS "PRICE", coalesce(price_names[pos + 1], '') AS "PRICE_FLAGS" FROM positions""",
    "explode_lists_aligned": f"""{_PARTS},
positions AS (SELECT *, unnest(range(greatest(len(price_names), len(size_names), 1))) AS pos FROM arrays)
SELECT "PART", CASE WHEN pos = 0 THEN "PRICE" END AS "PRICE", coalesce(size_names[pos + 1], '') AS "SIZE_FLAGS",
       coalesce(price_names[pos + 1], '') AS "PRICE_FLAGS" FROM positions""",
    "list_absent": f"""{_PARTS} SELECT "PART", "PRICE", '' AS "FLAGS" FROM arrays""",
    "first_row_per_id": f"{STAGES} SELECT l_orderkey, {_ORDER} FROM first_line",
    "merge_stages": f"""{MERGED}
SELECT l_orderkey, l_returnflag, o_orderpriority, c_mktsegment, n_name, note,
       CAST("Net_1" AS DOUBLE) AS "Net_1", CAST("Net_2" AS DOUBLE) AS "Net_2", CAST("Net_3" AS DOUBLE) AS "Net_3",
       CAST("Rate_1" AS DOUBLE) AS "Rate_1", CAST("Rate_2" AS DOUBLE) AS "Rate_2", CAST("Rate_3" AS DOUBLE) AS "Rate_3"
FROM merged""",
    "merge_stages_raw": " , ".join(
        ["WITH lines AS (SELECT * REPLACE (CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey END AS l_orderkey) FROM lineitem)"]
        + [
            f"s{n} AS (SELECT l_orderkey, l_linenumber, {_PRICE} AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS rn "
            f"FROM lines WHERE {kept})"
            for n, kept in ((1, "true"), (2, "l_returnflag <> 'R'"), (3, "l_linestatus <> 'O'"))
        ]
    )
    + """
SELECT coalesce(s1.l_orderkey, -1) AS l_orderkey, s1.l_linenumber, CAST(s1.price AS DOUBLE) AS "Net_1", CAST(s2.price AS DOUBLE) AS "Net_2", CAST(s3.price AS DOUBLE) AS "Net_3"
FROM s1 JOIN s2 ON s1.l_orderkey IS NOT DISTINCT FROM s2.l_orderkey JOIN s3 ON s1.l_orderkey IS NOT DISTINCT FROM s3.l_orderkey
WHERE s1.rn = 1 AND s2.rn = 1 AND s3.rn = 1""",
    "merge_renewal": f"""{MERGED}
SELECT l_orderkey, CAST("Net_1_rn" AS DOUBLE) AS "Net_1_rn", CAST("Net_2_rn" AS DOUBLE) AS "Net_2_rn",
       CAST("Net_3_rn" AS DOUBLE) AS "Net_3_rn" FROM merged""",
    "diff_overall": f'{DIFFS} SELECT l_orderkey, "diff_Net_step_0", "diff_Rate_step_0" FROM diffs',
    "pct_overall": f'{DIFFS} SELECT l_orderkey, "percent_diff_Net_step_0", "percent_diff_Rate_step_0" FROM diffs',
    "diff_steps": f"""{DIFFS}
SELECT l_orderkey, "diff_Net_step_1", "percent_diff_Net_step_1", "diff_Net_step_2", "percent_diff_Net_step_2",
       "diff_Rate_step_1", "percent_diff_Rate_step_1", "diff_Rate_step_2", "percent_diff_Rate_step_2" FROM diffs""",
    "diff_renewal": f"""{DIFFS}
SELECT l_orderkey, "diff_Net_step_0_rn", "percent_diff_Net_step_0_rn", "diff_Net_step_1_rn", "percent_diff_Net_step_1_rn",
       "diff_Net_step_2_rn", "percent_diff_Net_step_2_rn" FROM diffs""",
    "filter_segments": f"""{MERGED}
SELECT l_orderkey, c_mktsegment, note, CAST("Net_1" AS DOUBLE) AS "Net_1" FROM merged
WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND (note IS NULL OR note = ' 2-HIGH')""",
    "filter_rate_change": f"""{DIFFS}
SELECT l_orderkey, "percent_diff_Net_step_0_rn", CAST("Net_1_rn" AS DOUBLE) AS "Net_1_rn"
FROM diffs WHERE "percent_diff_Net_step_0_rn" BETWEEN -0.04 AND 0.02""",
    "segment_values": f"{MERGED} SELECT DISTINCT coalesce(note, 'NA') AS value FROM merged",
    "assign_band": f"""{DIFFS}
SELECT l_orderkey, {_band('"percent_diff_Net_step_1"')} AS net_band, {_band('"percent_diff_Rate_step_1"')} AS rate_band FROM diffs""",
    "band_distribution": _distribution((("Rate", ""),)) + f" SELECT band, count, percentage FROM dist WHERE {_RATE_1} AND count > 0",
    "band_zero_fill": _distribution((("Rate", ""),)) + f" SELECT band_order, band, count, percentage FROM dist WHERE {_RATE_1}",
    "distribution_all": _distribution((("Net", ""), ("Rate", "")))
    + " SELECT item, step, step_name, segment, band_order, band, count, percentage FROM dist",
    "distribution_counted": _distribution((("Net", ""), ("Rate", "")), _CHOSEN)
    + " SELECT item, step, step_name, segment, band_order, band, count, percentage FROM dist",
    "distribution_renewal": _distribution((("Net", ""), ("Net", "_rn"), ("Rate", "")))
    + """
SELECT item, step, step_name, band_order, band,
       coalesce(max(count) FILTER (segment = 'NB'), 0) AS nb_count, coalesce(max(percentage) FILTER (segment = 'NB'), 0) AS nb_percentage,
       CAST(CASE WHEN item = 'Net' THEN coalesce(max(count) FILTER (segment = 'RN'), 0) END AS DOUBLE) AS rn_count,
       CASE WHEN item = 'Net' THEN coalesce(max(percentage) FILTER (segment = 'RN'), 0) END AS rn_percentage
FROM dist GROUP BY item, step, step_name, band_order, band""",
    "stage_totals": f"""{MERGED}
SELECT CAST(coalesce(sum("Net_1"), 0) AS DOUBLE) AS "Net_1", CAST(coalesce(sum("Net_2"), 0) AS DOUBLE) AS "Net_2",
       CAST(coalesce(sum("Net_3"), 0) AS DOUBLE) AS "Net_3", CAST(coalesce(sum("Rate_1"), 0) AS DOUBLE) AS "Rate_1",
       CAST(coalesce(sum("Rate_2"), 0) AS DOUBLE) AS "Rate_2", CAST(coalesce(sum("Rate_3"), 0) AS DOUBLE) AS "Rate_3" FROM merged""",
    "comparison_summary": f"""{_TOTALS}
SELECT item, stage_idx, stage_name, value_total, value_diff, value_total_percent, value_diff_percent FROM report""",
    "item_stage_pivot": f"""{_TOTALS}
SELECT item, max(value_total) FILTER (stage_idx = 0) AS "List", max(value_total) FILTER (stage_idx = 1) AS "Discounted",
       max(value_total) FILTER (stage_idx = 2) AS "Taxed" FROM report GROUP BY item""",
    "item_stage_pivot_rn": f"""{MERGED}
SELECT 'Net' AS item, CAST(sum("Net_1_rn") AS DOUBLE) AS "List", CAST(sum("Net_2_rn") AS DOUBLE) AS "Discounted",
       CAST(sum("Net_3_rn") AS DOUBLE) AS "Taxed" FROM merged
UNION ALL SELECT 'Rate', 0, 0, 0""",
    "breakdown": _grouped("c_mktsegment, note, l_returnflag, n_name", "c_mktsegment, note, l_returnflag, n_name"),
    "breakdown_named": 'SELECT item AS _item, c_mktsegment AS item, n_name AS policy_count, policy_count AS _policy_count, '
    "value_total_start, value_total_end, value_diff, value_diff_percent FROM (" + _grouped("c_mktsegment, n_name", "c_mktsegment, n_name") + ")",
    "breakdown_rollup": _grouped(
        "c_mktsegment, note, l_returnflag, n_name",
        "ROLLUP (c_mktsegment, note, l_returnflag, n_name)",
        "CASE grouping_id(c_mktsegment, note, l_returnflag, n_name) WHEN 0 THEN 'detail' WHEN 1 THEN 'subtotal_3' "
        "WHEN 3 THEN 'subtotal_2' WHEN 7 THEN 'subtotal_1' ELSE 'grand_total' END AS level,",
    ),
    "waterfall": f"""{_TOTALS}
SELECT item, stage_idx AS point_order, stage_name AS point,
       CASE WHEN stage_idx = 0 THEN value_total_percent ELSE value_diff_percent END * 100 AS percent,
       value_total, value_diff, false AS is_sum FROM report
UNION ALL SELECT item, stage_idx + 1, 'Final', value_total_percent * 100, value_total, moved, true FROM report WHERE stage_idx = 2""",
    "progression_table": f"""{_TOTALS},
metrics AS (
  SELECT item, stage_idx, 0 AS metric_order, 'Total Value' AS metric, value_total AS value FROM report
  UNION ALL SELECT item, stage_idx, 1, 'Value Difference', value_diff FROM report
  UNION ALL SELECT item, stage_idx, 2, 'Difference %', value_diff_percent * 100 FROM report
  UNION ALL SELECT item, stage_idx, 3, 'Total %', value_total_percent * 100 FROM report)
SELECT item, metric_order, metric, max(value) FILTER (stage_idx = 0) AS "List",
       max(value) FILTER (stage_idx = 1) AS "Discounted", max(value) FILTER (stage_idx = 2) AS "Taxed"
FROM metrics GROUP BY item, metric_order, metric""",
}
ORACLE["merge_stages_clustered"] = ORACLE["merge_stages_raw"]
ORACLE["conversion_error_summary"] = f"""
WITH errors AS ({ORACLE["conversion_errors"]}),
lanes AS (
  SELECT "column", type, reason, min(md5(value)) AS digest, count(*) AS n FROM errors
  GROUP BY "column", type, reason, substr(md5(value), 1, 2)),
ids AS (SELECT "column", type, reason, md5(value) AS digest, value, min(id) AS id FROM errors GROUP BY ALL),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY "column", type, reason ORDER BY digest) AS place
  FROM lanes JOIN ids USING ("column", type, reason, digest))
SELECT "column", type, reason, CAST(sum(n) AS BIGINT) AS n_values,
       string_agg(value || '@' || id, '|' ORDER BY place) FILTER (place <= 3) AS examples
FROM kept GROUP BY "column", type, reason"""
