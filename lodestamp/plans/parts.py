"""Pieces of SQL that say what the column expressions say, for another engine on the same tables."""

from __future__ import annotations

from lodestamp.functions import serial as S
from lodestamp.functions import text as T


def quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def clean(x: str) -> str:
    return f"upper(trim(regexp_replace(strip_accents({x}), '\\s+', ' ', 'g')))"


def absent(x: str) -> str:
    return f"(coalesce({clean(x)}, '') IN ({quoted(T.ABSENT)}))"


def first_code(t: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {t} IN ({quoted(n)}) THEN '{c}'" for c, n in table.items() if n) + " END"


def gas(x: str) -> str:
    t = clean(x)
    named = ", ".join(
        "CASE WHEN " + " OR ".join(
            f"contains({t}, '{n}')" for n in names if len(n) >= 3
        ) + f" THEN '{c}' END" if any(len(n) >= 3 for n in names) else "NULL"
        for c, names in T.GASES.items()
    )
    found = f"list_filter([{named}], lambda z: z IS NOT NULL)"
    return f"CASE WHEN {absent(x)} THEN NULL WHEN regexp_matches({t}, '{T.MIXTURE}') THEN 'MIX' ELSE coalesce({first_code(t, T.GASES)}, CASE WHEN len({found}) > 1 THEN 'MIX' WHEN len({found}) = 1 THEN {found}[1] END) END"


def colour(x: str) -> str:
    step = "CASE " + " ".join(
        "WHEN (" + " OR ".join(
            f"contains(chunk, '{n}')" for n in names
        ) + f") AND NOT list_contains(acc, '{c}') THEN list_append(acc, '{c}')"
        for c, names in T.COLOURS.items()
    ) + " ELSE acc END"
    # The first element of the folded list is only its start.
    folded = f"list_reduce(list_transform(string_split_regex({clean(x)}, '{T.COLOUR_BREAK}'), lambda z: [z]), lambda acc, one: list_reduce(list_transform(one, lambda y: [y]), lambda a2, o2: {step.replace('chunk', 'o2[1]').replace('acc', 'a2')}, acc), CAST([] AS VARCHAR[]))"
    return f"CASE WHEN {absent(x)} THEN NULL ELSE nullif(array_to_string({folded}, '/'), '') END"


def country(x: str, strict: bool = False) -> str:
    table = {k: tuple(n for n in names if len(n) > 2 or not strict) for k, names in T.COUNTRIES.items()}
    t = clean(x)
    inside = "CASE " + " ".join(f"WHEN list_has_any(regexp_extract_all({t}, '[A-Z]+'), [{quoted(n)}]) THEN '{c}'" for c, n in table.items()) + " END"
    return f"CASE WHEN {absent(x)} THEN NULL ELSE coalesce({first_code(t, table)}, {inside}) END"


def unit(x: str) -> str:
    t = clean(x)
    return f"CASE WHEN {absent(x)} THEN NULL WHEN regexp_matches({t}, '\\bM3\\b|\\bM\\^?3\\b|METRO.?S? CUBICO') THEN 'M3' WHEN regexp_matches({t}, '\\bKG\\b|KILO') THEN 'KG' END"


def month_year(x: str) -> str:
    t = f"coalesce({clean(x)}, '')"
    m, y, g = "(0?[1-9]|1[0-2])", "((?:19|20)[0-9]{2})", "\\s*[/.\\-]\\s*"
    part = lambda p, k: f"nullif(regexp_extract({t}, '{p}', {k}), '')"
    a, b, c = f"\\b{m}{g}{y}\\b", f"\\b{y}{g}{m}\\b", f"\\b{m}{g}([0-9]{{2}})\\b"
    two = f"CAST({part(c, 2)} AS INT)"
    century = f"CAST(CASE WHEN {two} >= {T.YEAR_PIVOT} THEN {two} + 1900 ELSE {two} + 2000 END AS VARCHAR)"
    return f"coalesce({part(a, 2)} || '-' || lpad({part(a, 1)}, 2, '0'), {part(b, 1)} || '-' || lpad({part(b, 2)}, 2, '0'), CASE WHEN {two} IS NOT NULL THEN {century} || '-' || lpad({part(c, 1)}, 2, '0') END)"


def year(x: str) -> str:
    only = "\\b((?:19|20)[0-9]{2})\\b"
    return f"coalesce(CAST(substr({month_year(x)}, 1, 4) AS INT), CAST(nullif(regexp_extract(coalesce({clean(x)}, ''), '{only}', 1), '') AS INT))"


def number(x: str) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract(replace(coalesce({clean(x)}, ''), ' ', ''), '([0-9]+(?:[.,][0-9]+)?)', 1), ''), ',', '.') AS DOUBLE)"


def charset(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(upper(trim(coalesce({x}, ''))), '^.*:', ''), '{S.LABEL}', ''), '[^A-Z0-9]', '', 'g')"


def marking(x: str) -> str:
    return f"coalesce(regexp_matches(upper({x}), '{S.MARKING}'), false)"


def errors(k: str) -> str:
    return f"CAST(CASE WHEN length({k}) < 6 THEN 0 ELSE length({k}) // 4 END AS INT)"


def canonical(k: str) -> str:
    return f"translate({k}, '{''.join(S.LETTER_TO_DIGIT)}K', '{''.join(S.LETTER_TO_DIGIT.values())}1')"


def distance(a: str, b: str, anywhere: bool) -> str:
    """Rows of the alignment as nested folds; a row is a list."""
    pairs = quoted([p for x, y in S.CONFUSABLE for p in (x + y, y + x)])
    cost = f"CASE WHEN ca = cb THEN 0.0::DOUBLE WHEN (ca || cb) IN ({pairs}) THEN 0.5 ELSE 1.0 END"
    start = f"list_transform(range(length({b}) + 1), lambda z: 0.0::DOUBLE)" if anywhere else f"list_transform(range(length({b}) + 1), lambda z: z::DOUBLE)"
    inner = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j::DOUBLE]), lambda r, jj: list_append(r, least(prev[jj[1]::INT + 1] + 1, r[jj[1]::INT] + 1, prev[jj[1]::INT] + {cost.replace('ca', f'substr({a}, ii[1]::INT, 1)').replace('cb', f'substr({b}, jj[1]::INT, 1)')})), [ii[1]::DOUBLE])"
    rows = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i::DOUBLE]), lambda prev, ii: {inner}, {start})"
    return f"list_min({rows})" if anywhere else f"({rows})[length({b}) + 1]"


ENTRIES = "e AS (SELECT s AS serial, min(ord) AS ord, arg_min(brand, ord) AS brand, arg_min(size, ord) AS size, string_agg(asset_id, ',' ORDER BY ord) AS assets, count(*) AS n FROM (SELECT *, " + charset("serial") + " AS s FROM inventory) WHERE s <> '' GROUP BY s)"
VALUE = "trim(regexp_replace(text, '^[^:=]*[:=]', ''))"
LINES = f"v AS (SELECT *, CASE WHEN regexp_matches(text, '[:=]') THEN {VALUE} END AS value FROM field_lines)"
PARTS = """f AS (SELECT image_id, variant_ord, line_ord, confidence, trim(text) AS raw, unnest(list_prepend(text, string_split_regex(text, '[\\s|/\\\\]+'))) AS fragment,
  generate_subscripts(list_prepend(text, string_split_regex(text, '[\\s|/\\\\]+')), 1) - 1 AS frag_ord FROM readings WHERE text <> '')"""
FRAGMENTS = f"""p AS (SELECT coalesce(min(length(serial)), 5) AS lo, coalesce(max(length(serial)), 14) AS hi FROM e), {PARTS},
k AS (SELECT *, {charset('fragment')} AS t FROM f WHERE NOT {marking('fragment')}),
c AS (SELECT image_id, variant_ord, t AS text, arg_min(struct_pack(confidence := confidence, raw := raw, line_ord := line_ord, frag_ord := frag_ord), line_ord * 1000 + frag_ord) AS m FROM k, p WHERE regexp_matches(t, '[0-9]') AND length(t) BETWEEN lo AND hi GROUP BY ALL)"""
EXACT = f"""hit AS (SELECT r.image_id, r.confidence, e.serial FROM readings r JOIN e ON {charset('r.text')} = e.serial),
best AS (SELECT image_id, arg_max(serial, struct_pack(c := confidence, s := serial)) AS serial, max(confidence) AS confidence FROM hit GROUP BY image_id),
j AS (SELECT t.*, b.serial, coalesce(b.confidence < 0.7, true) AS needs_review FROM truth t LEFT JOIN best b USING (image_id))"""
SAME = f"({charset('serial')} = truth_serial)"
OUTCOME = f"""CASE WHEN truth_serial IS NULL THEN 'no_truth' WHEN coalesce(serial, '') <> '' AND {SAME} AND needs_review THEN 'referred_correct' WHEN coalesce(serial, '') <> '' AND {SAME} THEN 'correct'
 WHEN coalesce(serial, '') <> '' AND needs_review THEN 'referred_wrong' WHEN coalesce(serial, '') <> '' THEN 'silent_error' WHEN needs_review THEN 'referred_unread' ELSE 'not_identified' END"""
SWEEP = """o AS (SELECT coalesce(serial, '') <> '' AS has_read, CAST(floor(CAST(round(coalesce(confidence, 0) * 10000) AS BIGINT) / 100) AS INT) AS b, coalesce(serial = truth_serial, false) AS ok FROM j),
w AS (SELECT g.k, count(*) FILTER (WHERE has_read AND b >= k) AS accepted, count(*) FILTER (WHERE has_read AND b >= k AND ok) AS correct, count(*) AS total FROM o, range(101) g(k) GROUP BY g.k),
s AS (SELECT k / 100.0::DOUBLE AS threshold, accepted, correct, accepted - correct AS silent_errors, round((accepted - correct)::DOUBLE / total, 6) AS silent_error_rate, round(accepted::DOUBLE / total, 6) AS automation_rate, round(CASE WHEN accepted > 0 THEN correct::DOUBLE / accepted ELSE 1.0 END, 6) AS precision FROM w)"""
MY = month_year("text")
PH_ABSENT = absent("text")
HEIGHT_N = number("text")
LB = f"CASE WHEN contains({clean('text')}, 'LB') OR contains({clean('text')}, 'POUND') THEN {number('text')} * {T.KG_PER_LB} ELSE {number('text')} END"
PARSED = f"q AS (SELECT *, {number('text')} AS n, {LB} AS kg0 FROM field_lines)"
LO, HI = T.HEIGHT_CM
BOX = "boxes"
BEST_BOX = """p AS (SELECT image_id, class_id, box_ord AS p_ord, confidence, x1 + shift AS x1, y1, x2 + shift AS x2, y2 FROM boxes),
i AS (SELECT p.image_id, p.class_id, p_ord, p.confidence, t.box_ord AS t_ord, greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS a,
  (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM p LEFT JOIN boxes t ON p.image_id = t.image_id AND p.class_id = t.class_id),
b AS (SELECT *, a / greatest(s - a, 1e-9) AS iou, row_number() OVER (PARTITION BY image_id, class_id, p_ord ORDER BY a / greatest(s - a, 1e-9) DESC, t_ord) AS r FROM i),
m AS (SELECT *, iou >= 0.5 AND row_number() OVER (PARTITION BY image_id, class_id, t_ord ORDER BY confidence DESC, iou DESC, p_ord) = 1 AS is_hit FROM b WHERE r = 1)"""
