"""SQL for field extraction and records (F1-F7, R1, R3, R4, A10), for another engine on the same tables."""

from __future__ import annotations

from lodestamp.functions import text as T
from lodestamp.operators import fields as X
from lodestamp.plans.parts import absent, charset, clean, colour, country, gas, month_year, number, quoted, unit, year
from lodestamp.sources.fixtures import cte


def part(t: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({t}, '{pattern}', {group}), '')"


def kilograms(x: str) -> str:
    kg = f"CASE WHEN contains({x}, 'LB') OR contains({x}, 'POUND') THEN {number(x)} * {T.KG_PER_LB} ELSE {number(x)} END"
    return f"CASE WHEN ({kg}) > 0 AND ({kg}) < 500 THEN round({kg}, 2) END"


def up_to(x: str, most: int, digits: int) -> str:
    return f"CASE WHEN {number(x)} > 0 AND {number(x)} <= {most} THEN round({number(x)}, {digits}) END"


def centimetres(x: str, expected: tuple[float, float]) -> str:
    fits = lambda v: f"WHEN {v} BETWEEN {expected[0]} AND {expected[1]} THEN round({v}, 2)"
    n = number(x)
    return f"CASE {fits(n)} {fits(f'{n} * 100')} {fits(f'{n} / 10')} {fits(f'{n} * 2.54')} END"


def warned(x: str, expected: tuple[float, float]) -> str:
    """Whether a number isn't in the expected range as it stands."""
    return f"coalesce(NOT ({number(x)} BETWEEN {expected[0]} AND {expected[1]}), false)"


def period(x: str) -> str:
    return f"CASE WHEN NOT {absent(x)} THEN CAST({part(f'''coalesce({clean(x)}, '')''', T.PERIOD, 1)} AS INT) END"


def field_of(label: str) -> str:
    spellings = sorted((-len(a), k, field, a) for k, (field, names) in enumerate(X.LABELS.items()) for a in names)
    return "CASE " + " ".join(f"WHEN contains({label}, '{a}') THEN '{field}'" for _, _, field, a in spellings) + " END"


def labels(breaks: str) -> str:
    """Lines (image_id, line_ord, confidence, text) with the field ``f`` of their label and the ``value`` behind it."""
    label = clean(f"regexp_extract(text, '^([^{breaks}]*)', 1)")
    return f"(SELECT *, {field_of('label')} AS f FROM (SELECT *, {label} AS label, trim(regexp_replace(text, '^[^{breaks}]*[{breaks}]', '')) AS value FROM field_lines WHERE regexp_matches(text, '[{breaks}]')) WHERE label <> '' AND value <> '')"


def items(rules, values: dict[str, str], first_rule: int) -> str:
    rows = []
    for k, (field, column, share, sure, gate) in enumerate(rules):
        gated = f"'{gate}'" if gate else "NULL::VARCHAR"
        rows.append(
            f"struct_pack(rule := {first_rule + k}, field := '{field}', value := CAST({values[column]} AS VARCHAR), share := {share}::DOUBLE, sure := {str(sure).lower()}, gate := {gated})"
        )
    return "[" + ", ".join(rows) + "]"


on = lambda field, x: f"CASE WHEN f = '{field}' THEN {x} END"
LABELLED = {
    "marca": on("marca", f"CASE WHEN NOT {absent('v')} AND v NOT IN ({quoted(X.NOT_BRANDS)}) THEN v END"), "tipo_gas": on("tipo_gas", gas("v")), "color": on("color", colour("v")),
    "made": on("fecha_fabricacion", month_year("v")), "made_year": on("fecha_fabricacion", year("v")), "ph": on("ph", month_year("v")), "period": on("ph", period("v")),
    "peso": on("peso", kilograms("v")), "litros": on("litros", up_to("v", T.MOST_LITRES, 2)), "m3": on("m3", up_to("v", T.MOST_CUBIC, 3)), "unit": on("unidad_medida", unit("v")),
    "country": on("procedencia", country("v")), "diameter": on("ancho_diametro", centimetres("v", T.DIAMETER_CM)), "height": on("largo_altura", centimetres("v", T.HEIGHT_CM)),
}
SHAPED = {
    "kg": kilograms("w"), "kg_unit": "CASE WHEN w IS NOT NULL THEN 'KG' END", "litres": up_to("li", T.MOST_LITRES, 2), "cubic": up_to("cu", T.MOST_CUBIC, 3),
    "cubic_unit": "CASE WHEN cu IS NOT NULL THEN 'M3' END", "gas": gas("t"), "colour": colour("t"), "country": country("t", True),
    "tested": month_year("te"), "made": month_year("ma"),
    "made_year": f"CAST(substr({month_year('ma')}, 1, 4) AS INT)", "oldest": "dates[1]",
    "oldest_year": "CAST(substr(dates[1], 1, 4) AS INT)", "newest": "CASE WHEN len(dates) > 1 THEN dates[-1] END",
    "brand": f"list_filter(regexp_extract_all(t, '{X.BRAND}', 1), lambda z: z NOT IN ({quoted(X.NOT_BRANDS)}))[1]",
}
STATED = f"""
lab AS (SELECT image_id, line_ord, confidence, text, 0 AS pass, value AS raw, unnest({items(X.LABELLED, LABELLED, 0)}) AS i FROM (SELECT *, {clean('value')} AS v FROM {labels(':=')} WHERE f IS NOT NULL)),
cut AS (SELECT *, {part('t', X.WEIGHT, 0)} AS w, {part('t', X.LITRES, 1)} AS li, {part('t', X.CUBIC, 1)} AS cu, {part('t', X.MADE, 1)} AS ma, {part('t', X.TESTED, 1)} AS te,
  list_sort(list_transform(regexp_extract_all(t, '{X.DATE}'), lambda z: {month_year('z')})) AS dates FROM (SELECT *, {clean('text')} AS t FROM field_lines WHERE trim(text) <> '')),
shp AS (SELECT image_id, line_ord, confidence, text, 1 AS pass, text AS raw, unnest({items(X.SHAPED, SHAPED, len(X.LABELLED))}) AS i FROM cut),
said AS (SELECT image_id, raw, i.field AS field, i.value AS value, i.gate AS gate, confidence * i.share AS conf, pass * 1000000000 + line_ord * 1000 + i.rule AS seq FROM (SELECT * FROM lab UNION ALL SELECT * FROM shp) WHERE i.value IS NOT NULL AND (NOT i.sure OR confidence >= {X.SURE})),
gated AS (SELECT *, min(CASE WHEN field = coalesce(gate, field) THEN seq END) OVER (PARTITION BY image_id, coalesce(gate, field)) AS first FROM said),
best AS (SELECT image_id, field, min(struct_pack(c := -conf, s := seq, v := value, r := raw)) AS m FROM gated WHERE gate IS NULL OR CASE WHEN field = gate THEN seq = first ELSE seq - 1 = first END GROUP BY image_id, field),
stated AS (SELECT image_id, field, m.v AS value, round(-m.c + 1e-9, 4) AS confidence, trim(m.r) AS raw FROM best),
wide AS (SELECT image_id, {', '.join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in X.FIELDS)} FROM stated GROUP BY image_id)"""

COVERED = ("peso", "color", "ph", "procedencia", "tipo_gas")
COVERAGE = " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, count(*) AS total, round(count({f}) / count(*), 4) AS share FROM wide" for f in COVERED)

raw = lambda f: f"max(CASE WHEN f = '{f}' THEN value END) AS r_{f}"
unread = lambda f, value: f"CASE WHEN NOT {absent(f'r_{f}')} AND {value} IS NULL THEN '{f}' END"
ISSUES = ", ".join([
    "CASE WHEN length(numero_serie) < 7 THEN 'short_serial' END", unread("fecha_fabricacion", "anio_fabricacion"), unread("tipo_gas", "tipo_gas"), unread("peso", "peso"),
    f"CASE WHEN {warned('r_ancho_diametro', T.DIAMETER_CM)} THEN 'ancho_diametro' END", f"CASE WHEN {warned('r_largo_altura', T.HEIGHT_CM)} THEN 'largo_altura' END",
    unread("color", "color"), unread("ph", "coalesce(ph, ph_periodicidad_anios::VARCHAR)"), unread("procedencia", "procedencia"),
])
RECORD = f"""
first AS (SELECT image_id AS name, f, arg_min(value, struct_pack(l := line_ord, t := text)) AS value FROM {labels(':')} WHERE f IS NOT NULL AND f <> 'numero_serie' GROUP BY image_id, f),
card AS (SELECT name, {', '.join(raw(f) for f in X.RAW[1:])} FROM (SELECT DISTINCT image_id AS name FROM field_lines) LEFT JOIN first USING (name) GROUP BY name),
typed AS (SELECT name, {charset("'19S' || lpad(name::VARCHAR, 6, '0')")} AS numero_serie, CASE WHEN NOT {absent('r_marca')} THEN {clean('r_marca')} END AS marca, {month_year('r_fecha_fabricacion')} AS fecha_fabricacion,
  {year('r_fecha_fabricacion')} AS anio_fabricacion, {gas('r_tipo_gas')} AS tipo_gas, {unit('r_unidad_medida')} AS unidad_medida, {kilograms(clean('r_peso'))} AS peso, {up_to('r_litros', T.MOST_LITRES, 2)} AS litros,
  {up_to('r_m3', T.MOST_CUBIC, 3)} AS m3, {centimetres('r_ancho_diametro', T.DIAMETER_CM)} AS ancho_diametro, {centimetres('r_largo_altura', T.HEIGHT_CM)} AS largo_altura, {colour('r_color')} AS color,
  CASE WHEN NOT {absent('r_ph')} THEN {month_year('r_ph')} END AS ph, {period('r_ph')} AS ph_periodicidad_anios, {country('r_procedencia')} AS procedencia, * EXCLUDE (name) FROM card),
record AS (SELECT name, numero_serie, marca, fecha_fabricacion, anio_fabricacion, tipo_gas, unidad_medida, peso, litros, m3, ancho_diametro, largo_altura, color, ph, ph_periodicidad_anios, procedencia,
  array_to_string(list_filter([{ISSUES}], lambda z: z IS NOT NULL), ',') AS issues FROM typed)"""
date = lambda c: f"substr({c}, 6, 2) || '/' || substr({c}, 1, 4)"
FORM = f"""SELECT numero_serie, CASE tipo_gas {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.GAS_NAMES.items())} END AS tipo_gas, marca, coalesce({date('fecha_fabricacion')}, anio_fabricacion::VARCHAR) AS anio_fabricacion,
  unidad_medida, peso, ancho_diametro, largo_altura, CASE WHEN coalesce(tipo_gas, '') <> 'ACET' THEN litros END AS litros, CASE WHEN tipo_gas = 'ACET' THEN litros END AS contenido, upper(color) AS color,
  coalesce(CASE WHEN ph_periodicidad_anios > 0 THEN 'CADA ' || ph_periodicidad_anios || ' AÑOS PH' END, {date('ph')}, CASE WHEN tipo_gas IN ({quoted(X.FIVE_YEARS)}) THEN 'CADA 5 AÑOS PH' ELSE 'CADA 10 AÑOS PH' END) AS ph, procedencia FROM record"""

LINES = cte("field_lines")
SQL = {
    "f_stated": f"{LINES}, {STATED} SELECT * FROM stated",
    "f7_wide": f"{LINES}, {STATED} SELECT * FROM wide",
    "a10_coverage": f"{LINES}, {STATED} {COVERAGE}",
    "r1_r4_records": f"{LINES}, {RECORD} SELECT * FROM record",
    "a11_issues": f"{LINES}, {RECORD} SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM record) WHERE issue <> '' GROUP BY issue",
    "r3_form": f"{LINES}, {RECORD} {FORM}",
}
