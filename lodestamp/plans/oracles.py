"""SQL that says the same as the queries, for another engine on the same tables."""

from __future__ import annotations

from lodestamp.functions import serial as S
from lodestamp.functions import text as T
from lodestamp.plans import cascade_sql, fields_sql
from lodestamp.plans.parts import BEST_BOX, ENTRIES, EXACT, FRAGMENTS, HI, LINES, LO, MY, OUTCOME, PARSED, PARTS, PH_ABSENT, SWEEP, absent, canonical, charset, clean, colour, country, distance, errors, gas, marking, month_year, number, unit, year
from lodestamp.sources.fixtures import cte

CROPS = """l AS (SELECT DISTINCT image_id, image_id % 50 AS group_id FROM boxes), x AS (SELECT image_id, arg_min(x2 - x1, box_ord) AS w, arg_min(y2 - y1, box_ord) AS h FROM boxes WHERE class_id = 1 GROUP BY image_id),
      c AS (SELECT l.*, w, h, CASE WHEN image_id % 5 = 0 THEN 'no_truth' WHEN w IS NULL THEN 'no_box' WHEN image_id % 11 = 3 THEN 'missing_asset' WHEN w < 48 OR h < 12 THEN 'too_small' ELSE 'used' END AS reason,
        CASE group_id % 4 WHEN 0 THEN 'val' WHEN 3 THEN CASE WHEN ('0x' || substr(md5('crop42:' || group_id), 1, 8))::BIGINT % 3 < 2 THEN 'train' ELSE 'val' END ELSE 'train' END AS split FROM l LEFT JOIN x USING (image_id))"""
# The greedy deal of groups by size, one group after the other; then ranks within each size take the splits in their order.
DEAL = """asc_g AS (SELECT *, row_number() OVER (ORDER BY n_items DESC, group_id) AS i FROM groups), tot AS (SELECT sum(n_items)::DOUBLE AS t, count(*) AS k FROM groups),
RECURSIVE_STEP AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS size, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, '' AS s
  UNION ALL
  SELECT q.i, q.n_items, q.a + CASE WHEN q.s = 'train' THEN q.n_items ELSE 0 END, q.b + CASE WHEN q.s = 'val' THEN q.n_items ELSE 0 END, q.c + CASE WHEN q.s = 'test' THEN q.n_items ELSE 0 END, q.s FROM (
    SELECT g.i, g.n_items, r.a, r.b, r.c, CASE WHEN la >= lb AND la >= lc THEN 'train' WHEN lb >= lc THEN 'val' ELSE 'test' END AS s FROM (
      SELECT r.*, (t * 0.7::DOUBLE - a) / (t * 0.7::DOUBLE) AS la, (t * 0.15::DOUBLE - b) / (t * 0.15::DOUBLE) AS lb, (t * 0.15::DOUBLE - c) / (t * 0.15::DOUBLE) AS lc FROM RECURSIVE_STEP r, tot) r JOIN asc_g g ON g.i = r.i + 1) q),
quota AS (SELECT size, count(*) FILTER (WHERE s = 'train') AS n_train, count(*) FILTER (WHERE s = 'val') AS n_val FROM RECURSIVE_STEP WHERE i > 0 GROUP BY size),
ranked AS (SELECT group_id, n_items, row_number() OVER (PARTITION BY n_items ORDER BY md5('42:' || group_id), group_id) AS r FROM groups),
dealt AS (SELECT group_id, n_items, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_val THEN 'val' ELSE 'test' END AS split FROM ranked JOIN quota ON n_items = size)""".replace("RECURSIVE_STEP", "step")
case = lambda table: "CASE substr(k, i, 1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
SWAP_IN, SWAP_OUT = case(S.DIGIT_TO_LETTER), case(S.LETTER_TO_DIGIT)
LOCATED = f"""rr AS (SELECT image_id, variant_ord * 10 + line_ord AS ord, text, confidence, {charset('text')} AS c, {charset('truth_serial')} AS e FROM readings WHERE confidence >= 0.5),
fit AS (SELECT *, length(c) >= 5 AND contains(e, c) AS part FROM rr WHERE c <> '' AND (length(c) >= greatest(4, floor(length(e) * 0.7)) OR (length(c) >= 5 AND contains(e, c)))),
dd AS (SELECT f.*, CASE WHEN contains(c, e) OR part THEN least(d, 0.5) ELSE d END AS distance FROM fit f JOIN (SELECT e, c, {distance('e', 'c', False)} AS d FROM (SELECT DISTINCT e, c FROM fit)) USING (e, c)),
located AS (SELECT image_id, m.o AS ord, m.t AS text, m.d AS distance FROM (SELECT image_id, min(struct_pack(d := distance, o := ord, t := text)) AS m FROM dd WHERE distance < least(3.0, greatest(1.0, length(e) * 0.25)) GROUP BY image_id))"""

SQL = {
    "n1_n14_words": f"{cte('field_lines')}, {LINES} SELECT image_id, line_ord, {clean('value')} AS clean, {absent('value')} AS absent, {gas('value')} AS gas, {colour('value')} AS colour, {country('value')} AS country, {country('value', True)} AS country_strict, {unit('value')} AS unit FROM v",
    "n6_n13_dates": f"{cte('field_lines')} SELECT image_id, line_ord, {MY} AS month_year, {year('text')} AS year, CASE WHEN NOT {PH_ABSENT} THEN {MY} END AS ph_date, CASE WHEN NOT {PH_ABSENT} THEN CAST(nullif(regexp_extract(coalesce({clean('text')}, ''), '{T.PERIOD}', 1), '') AS INT) END AS ph_period FROM field_lines",
    "n8_n11_measures": f"""{cte('field_lines')}, {PARSED} SELECT image_id, line_ord, n AS number, CASE WHEN kg0 > 0 AND kg0 < 500 THEN round(kg0, 2) END AS kg, CASE WHEN n > 0 AND n <= 500 THEN round(n, 2) END AS litres, CASE WHEN n > 0 AND n <= 100 THEN round(n, 3) END AS m3,
      CASE WHEN n BETWEEN {LO} AND {HI} THEN round(n, 2) WHEN n * 100 BETWEEN {LO} AND {HI} THEN round(n * 100, 2) WHEN n / 10 BETWEEN {LO} AND {HI} THEN round(n / 10, 2) WHEN n * 2.54 BETWEEN {LO} AND {HI} THEN round(n * 2.54, 2) END AS height,
      CASE WHEN n IS NULL OR n BETWEEN {LO} AND {HI} THEN NULL WHEN n * 100 BETWEEN {LO} AND {HI} THEN 'read as m' WHEN n / 10 BETWEEN {LO} AND {HI} THEN 'read as mm' WHEN n * 2.54 BETWEEN {LO} AND {HI} THEN 'read as in' ELSE 'out of range' END AS warning FROM q""",
    "k1_k3_k9_serials": f"""{cte('readings')}, s AS (SELECT *, {charset('text')} AS serial FROM readings) SELECT image_id, variant_ord, serial, {marking('text')} AS marking, {errors('serial')} AS budget, {canonical('serial')} AS canonical,
      coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, length(serial)), lambda i: substr({canonical('serial')}, i, 2)))), ' '), '') AS bigrams, translate(regexp_replace(regexp_replace(serial, '[A-Za-z]', 'a', 'g'), '[0-9]', 'D', 'g'), 'a', 'A') AS shape FROM s""",
    "k5_pattern": f"{cte('inventory')}, s AS (SELECT {charset('serial')} AS s FROM inventory WHERE {charset('serial')} <> '') SELECT coalesce(min(length(s)), 5)::INT AS min_length, coalesce(max(length(s)), 14)::INT AS max_length, NULL::VARCHAR AS mask FROM s",
    "k5_mask": f"""{cte('inventory')}, s AS (SELECT '19S' || lpad(regexp_replace(serial, '[^0-9]', '', 'g'), 6, '0') AS s FROM inventory), g AS (SELECT unnest(range(1, length(s) + 1)) AS pos, s FROM s),
      d AS (SELECT pos, CASE WHEN bool_and(regexp_matches(substr(s, pos, 1), '[0-9]')) THEN 'D' WHEN bool_and(regexp_matches(substr(s, pos, 1), '[A-Za-z]')) THEN 'A' ELSE '?' END AS k FROM g GROUP BY pos)
      SELECT min(length(s))::INT AS min_length, max(length(s))::INT AS max_length, CASE WHEN min(length(s)) = max(length(s)) AND count(*) >= 8 THEN (SELECT string_agg(k, '' ORDER BY pos) FROM d) END AS mask FROM s""",
    "k7_candidates": f"{cte('readings', 'inventory')}, {ENTRIES}, {FRAGMENTS} SELECT image_id, variant_ord, text, m.confidence AS confidence, m.raw AS raw, m.line_ord AS line_ord, m.frag_ord::INT AS frag_ord, true AS valid FROM c",
    "k8_k10_distances": f"{cte('readings')}, s AS (SELECT *, {charset('text')} AS k FROM readings), d AS (SELECT DISTINCT k, truth_serial FROM s), x AS (SELECT k, truth_serial, {distance('k', 'truth_serial', False)} AS distance, {distance('truth_serial', 'k', True)} AS inside FROM d) SELECT image_id, variant_ord, distance, inside FROM s JOIN x USING (k, truth_serial)",
    "k11_shapes": f"{cte('inventory')} SELECT translate(regexp_replace(regexp_replace(serial, '[A-Za-z]', 'a', 'g'), '[0-9]', 'D', 'g'), 'a', 'A') AS shape, count(*) AS n FROM inventory GROUP BY 1",
    "a1_entries": f"{cte('inventory')}, {ENTRIES} SELECT serial, ord, brand, size, assets, n > 1 AS is_duplicated, length(serial) < 7 AS is_too_short FROM e",
    "a2_consensus": f"""{cte('readings', 'inventory')}, {ENTRIES}, {FRAGMENTS}, v AS (SELECT image_id, count(DISTINCT variant_ord) AS n_variants FROM readings WHERE text <> '' GROUP BY 1),
      a AS (SELECT image_id, text, count(*) AS n_votes, avg(m.confidence) AS mc, min(struct_pack(v := variant_ord, l := m.line_ord, f := m.frag_ord)) AS seen FROM c GROUP BY 1, 2),
      b AS (SELECT *, round(least(1.0, (0.5 * n_votes / n_variants + 0.5 * mc) * 1.05) + 1e-9, 4) AS score FROM a JOIN v USING (image_id))
      SELECT image_id, text, n_votes, n_variants, round(mc + 1e-9, 4) AS mean_confidence, true AS valid, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, seen, text)::INT AS rank FROM b""",
    "a1_attributes": f"""{cte('inventory')}, r AS (SELECT *, {charset('serial')} AS k FROM inventory), f AS (SELECT * FROM r WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord) = 1)
      SELECT k AS serial, 'brand' AS name, brand AS value FROM f WHERE brand IS NOT NULL UNION ALL SELECT k, 'size', size::VARCHAR FROM f WHERE ord % 3 = 0 AND size IS NOT NULL UNION ALL SELECT k, 'checked', 'true' FROM f WHERE ord % 7 = 0""",
    "a2_masked": f"""{cte('readings', 'inventory')}, every AS (SELECT *, '19S' || lpad(regexp_replace(text, '[^0-9]', '', 'g'), 6, '0') AS same FROM readings), z AS (
      WITH worn AS (SELECT * REPLACE (CASE WHEN image_id % 4 = 0 THEN translate(same, '01', 'OI') WHEN image_id % 4 = 1 THEN '195' || substr(same, 4, 6) WHEN image_id % 4 = 2 THEN same || 'X' WHEN image_id % 8 = 3 THEN substr(same, 1, 8) || 'X' ELSE same END AS text) FROM every),
      {PARTS.replace('FROM readings', 'FROM worn')}, n AS (SELECT *, {charset('fragment')} AS k FROM f WHERE NOT {marking('fragment')}),
      x AS (SELECT *, array_to_string(list_transform(range(1, 10), lambda i: coalesce(CASE WHEN i = 3 THEN {SWAP_IN} ELSE {SWAP_OUT} END, substr(k, i, 1))), '') AS text FROM n WHERE regexp_matches(k, '[0-9]') AND length(k) = 9),
      c AS (SELECT image_id, variant_ord, text, arg_min(confidence, line_ord * 1000 + frag_ord) AS confidence, min(struct_pack(l := line_ord, f := frag_ord)) AS first FROM x GROUP BY 1, 2, 3),
      v AS (SELECT image_id, count(DISTINCT variant_ord) AS n_variants FROM worn WHERE text <> '' GROUP BY 1),
      a AS (SELECT image_id, text, count(*) AS n_votes, avg(confidence) AS mc, min(struct_pack(v := variant_ord, l := first.l, f := first.f)) AS seen, regexp_matches(text, '^[0-9][0-9][A-Za-z][0-9]{{6}}$') AS valid FROM c GROUP BY 1, 2),
      b AS (SELECT *, round(least(1.0, (0.5 * n_votes / n_variants + 0.5 * mc) * CASE WHEN valid THEN 1.05 ELSE 1.0 END) + 1e-9, 4) AS score FROM a JOIN v USING (image_id))
      SELECT image_id, text, n_votes, n_variants, round(mc + 1e-9, 4) AS mean_confidence, valid, score, row_number() OVER (PARTITION BY image_id ORDER BY valid DESC, score DESC, seen, text)::INT AS rank FROM b) SELECT * FROM z""",
    "k7_fragments": f"{cte('readings')}, {PARTS}, k AS (SELECT *, {charset('fragment')} AS serial FROM f WHERE NOT {marking('fragment')}) SELECT image_id, variant_ord, line_ord, frag_ord::INT AS frag_ord, fragment, serial FROM k WHERE regexp_matches(serial, '[0-9]')",
    "j1_exact": f"{cte('readings', 'inventory')}, {ENTRIES} SELECT DISTINCT {charset('r.text')} AS text, e.serial FROM readings r JOIN e ON {charset('r.text')} = e.serial",
    "j2_containing": f"{cte('readings', 'inventory')}, {ENTRIES}, t AS (SELECT DISTINCT {charset('text')} AS text FROM readings) SELECT t.text, e.serial FROM t JOIN e ON length(t.text) >= 6 AND length(e.serial) >= 6 AND (contains(e.serial, t.text) OR contains(t.text, e.serial))",
    "j7_merge": f"{cte('live', 'static')} SELECT *, 'live' AS origin FROM live UNION ALL SELECT *, 'static' AS origin FROM static WHERE serial NOT IN (SELECT serial FROM live)",
    "j8_insertable": f"{cte('inventory', 'live')} SELECT ord, serial FROM inventory WHERE serial IN (SELECT serial FROM inventory GROUP BY serial HAVING count(*) = 1) AND serial NOT IN (SELECT serial FROM live)",
    "j9_j10_enrich": f"""{cte('inventory', 'live', 'static')}, r AS (SELECT ord AS image_id, serial, CASE WHEN ord % 3 = 0 THEN brand END AS brand, NULL::INT AS size FROM inventory),
      c AS (SELECT serial, arg_min(brand, ord) AS brand, arg_min(size, ord) AS size FROM static GROUP BY 1), m AS (SELECT serial, arg_min(brand, ord) AS brand, arg_min(size, ord) AS size FROM live GROUP BY 1)
      SELECT image_id, serial, coalesce(m.brand, r.brand, c.brand) AS brand, CASE WHEN m.brand IS NOT NULL THEN 'backend' WHEN r.brand IS NOT NULL THEN 'ai' WHEN c.brand IS NOT NULL THEN 'catalog' ELSE 'unknown' END AS brand_source,
      coalesce(m.size, r.size, c.size) AS size, CASE WHEN m.size IS NOT NULL THEN 'backend' WHEN r.size IS NOT NULL THEN 'ai' WHEN c.size IS NOT NULL THEN 'catalog' ELSE 'unknown' END AS size_source, m.serial IS NOT NULL AS found
      FROM r LEFT JOIN c USING (serial) LEFT JOIN m USING (serial)""",
    "a11_duplicated": f"{cte('inventory')}, {ENTRIES} SELECT serial, n AS n_assets, assets FROM e WHERE n > 1",
    "a22_alphabet": f"{cte('inventory')}, d AS (SELECT DISTINCT serial, unnest(string_split(serial, '')) AS ch FROM inventory) SELECT ch, count(DISTINCT serial) AS n_serials FROM d WHERE ch NOT IN ('0','1','2','3','4','5','6','7','8','9') GROUP BY ch",
    "a23_sync": f"{cte('live', 'static')} SELECT (SELECT count(DISTINCT serial) FROM live) AS n_live, (SELECT count(DISTINCT serial) FROM static WHERE serial NOT IN (SELECT serial FROM live)) AS n_static_only, (SELECT count(DISTINCT serial) FROM (SELECT serial FROM live UNION SELECT serial FROM static)) AS n_total",
    "a5_duplicates": f"{cte('audit')} SELECT digest, count(*) AS n, min(asset) AS first_asset FROM audit GROUP BY digest HAVING count(*) > 1",
    "a6_counts": f"{cte('audit')} SELECT 'group' AS kind, grp AS name, count(*) AS n FROM audit GROUP BY grp UNION ALL SELECT 'condition', condition, count(*) FROM audit GROUP BY condition",
    "a7_quality": f"{cte('audit')} SELECT round(quantile_cont(blur, 0.5), 2) AS median_blur, round(avg(brightness), 2) AS mean_brightness, round(avg(contrast), 2) AS mean_contrast, round(quantile_cont(width, 0.5) / 1e6, 6) AS median_mp FROM audit",
    "a8_readiness": f"""{cte('audit')}, good AS (SELECT * FROM audit WHERE coalesce(width, 0) >= 40), g AS (SELECT grp, count(*) AS n FROM good GROUP BY grp), one AS (SELECT (SELECT count(*) FROM good) AS n, (SELECT count(DISTINCT condition) FROM good) AS n_conditions, (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM g WHERE n < 5) AS scarce,
      (SELECT count(*) FROM (SELECT digest FROM good GROUP BY digest HAVING count(*) > 1)) AS n_dups, (SELECT count(*) FROM good WHERE blur < 60 OR contrast < 18 OR brightness < 25 OR brightness > 235) AS n_low,
      (SELECT count(DISTINCT grp) FROM audit WHERE grp NOT IN (SELECT grp FROM g)) AS n_empty, (SELECT count(*) FROM audit WHERE coalesce(width, 0) < 40) AS n_corrupt)
      SELECT n, n_groups, n_dups, n_low, n_empty, n_corrupt, round(n_low / greatest(n, 1), 4) AS low_share, concat_ws(',', CASE WHEN n = 0 THEN 'no_assets' END, CASE WHEN n_groups > 0 AND n_groups < 10 THEN 'few_groups' END) AS blockers,
      concat_ws(',', CASE WHEN n > 0 AND n < 300 THEN 'few_assets' END, CASE WHEN scarce > 0 THEN 'scarce_groups' END, CASE WHEN n_empty > 0 THEN 'empty_groups' END, CASE WHEN n_dups > 0 THEN 'duplicates' END, CASE WHEN n_corrupt > 0 THEN 'corrupt' END,
        CASE WHEN n_low > 0 THEN 'low_quality' END, CASE WHEN n_conditions > 0 AND n_conditions < 3 THEN 'few_conditions' END) AS warnings,
      NOT (n = 0 OR (n_groups > 0 AND n_groups < 10)) AS ready FROM one""",
    "p4_low_quality": f"{cte('audit')} SELECT asset FROM audit WHERE blur < 60 OR contrast < 18 OR brightness < 25 OR brightness > 235",
    "a16_error_rate": f"{cte('readings')}, s AS (SELECT condition, truth_serial AS e, {charset('text')} AS r FROM readings) SELECT condition, round(avg(CASE WHEN e = '' THEN CASE WHEN r = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(e, r)::DOUBLE / length(e) END), 4) AS cer, count(*) AS n FROM s GROUP BY condition",
    "a17_latency": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(n) AS n, round(avg(value), 1) AS mean, round(quantile_cont(value, 0.5), 1) AS median, CASE WHEN max(n) >= 20 THEN round(max(CASE WHEN r = floor(n * 0.95) THEN value END), 1) END AS p95 FROM v",
    "g3_normalised": f"{cte('boxes')}, c AS (SELECT image_id, box_ord, greatest(x1, 0) AS a, greatest(y1, 0) AS b, least(x2, 2000.0) AS c, least(y2, 400.0) AS d FROM boxes) SELECT image_id, box_ord, round((a + c) / 2 / 2000, 6) AS cx, round((b + d) / 2 / 400, 6) AS cy, round((c - a) / 2000, 6) AS w, round((d - b) / 400, 6) AS h FROM c",
    "g4_expanded": f"{cte('boxes')} SELECT image_id, box_ord, greatest(0.0, x1 - (x2 - x1) * 0.35::DOUBLE) AS ex1, greatest(0.0, y1 - greatest(y2 - y1, 1) * 0.8::DOUBLE) AS ey1, least(2000.0, x2 + (x2 - x1) * 0.35::DOUBLE) AS ex2, least(400.0, y2 + greatest(y2 - y1, 1) * 2.5::DOUBLE) AS ey2 FROM boxes",
    "g5_crop": f"{cte('boxes')}, c AS (SELECT image_id, box_ord, greatest(0, floor(x1 - (x2 - x1) * 0.15::DOUBLE))::BIGINT AS cx1, greatest(0, floor(y1 - (y2 - y1) * 0.15::DOUBLE))::BIGINT AS cy1, least(2000, floor(x2 + (x2 - x1) * 0.15::DOUBLE))::BIGINT AS cx2, least(400, floor(y2 + (y2 - y1) * 0.9::DOUBLE))::BIGINT AS cy2 FROM boxes) SELECT *, cx2 <= cx1 OR cy2 <= cy1 AS is_empty FROM c",
    "g6_reprojected": f"{cte('boxes')} SELECT image_id, box_ord, x1 * 2.0 + 10 AS rx1, y1 * 0.5 - 3 AS ry1, x2 * 2.0 + 10 AS rx2, y2 * 0.5 - 3 AS ry2 FROM boxes",
    "p1_plausible": f"{cte('boxes')} SELECT image_id, box_ord FROM boxes WHERE (x2 - x1) / greatest(y2 - y1, 1) >= 1.2",
    "j12_pending": f"{cte('audit')} SELECT asset AS image_id, grp AS group_id FROM audit WHERE grp IN ('src0', 'src1', 'src2') AND asset % 3 <> 0",
    "j15_match_boxes": f"{cte('boxes')}, {BEST_BOX} SELECT image_id, class_id, p_ord, t_ord, round(iou, 6) AS iou, is_hit FROM m",
    "a24_pseudo": f"{cte('boxes')} SELECT class_id, box_ord % 3 AS condition, count(*) AS n FROM boxes WHERE confidence >= 0.7 AND class_id IN (0, 1) GROUP BY ALL",
    "w5_top_up": f"""{cte('groups')}, a AS (SELECT group_id, n_labelled, CASE WHEN group_id % 10 = 0 THEN 'val' WHEN group_id % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM groups),
      h AS (SELECT coalesce(sum(n_labelled) FILTER (WHERE split = 'val'), 0) AS have FROM a),
      r AS (SELECT group_id, have + coalesce(sum(n_labelled) OVER (ORDER BY n_labelled, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60 AS moved FROM a, h WHERE split = 'train' AND n_labelled > 0)
      SELECT a.group_id, n_labelled::BIGINT AS n_labelled, CASE WHEN coalesce(moved, false) THEN 'val' ELSE split END AS split, coalesce(moved, false) AS moved FROM a LEFT JOIN r USING (group_id)""",
    "t5_monitor": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY ALL",
    "a13_funnel": f"{cte('boxes')}, {CROPS} SELECT reason, split, count(*) AS n FROM c GROUP BY ALL",
    "a25_assembled": f"{cte('audit')}, r AS (SELECT CASE WHEN asset % 10 < 7 THEN 'train' WHEN asset % 10 < 9 THEN 'val' ELSE 'test' END AS split, count(*) FILTER (WHERE asset % 3 = 0) AS n_labelled, count(*) FILTER (WHERE asset % 3 <> 0) AS n_unlabelled FROM audit GROUP BY 1) SELECT *, CASE WHEN n_labelled = 0 THEN 'not_trainable' WHEN split = 'train' AND n_labelled < 100 THEN 'few_labels' ELSE 'ok' END AS verdict FROM r",
    "w8_work_list": f"{cte('audit')} SELECT asset AS image_id, grp AS group_id FROM audit ORDER BY asset LIMIT 50 OFFSET 10",
    "r2_live": f"""{cte('inventory')} SELECT 'cilindros#' || ord AS name, {charset('serial')} AS numero_serie, upper(brand) AS marca, '2019-0' || (1 + ord % 9) AS fecha_fabricacion, 2019 AS anio_fabricacion, CASE WHEN ord % 2 = 0 THEN 'O2' ELSE 'ACET' END AS tipo_gas, 'KG' AS unidad_medida,
      CASE WHEN size > 0 AND size < 500 THEN size::DOUBLE END AS peso, CASE WHEN ord % 2 = 0 THEN 40.5 ELSE 33.0 END::DOUBLE AS litros, NULL::DOUBLE AS m3, NULL::DOUBLE AS ancho_diametro, NULL::DOUBLE AS largo_altura, 'verde' AS color, NULL::VARCHAR AS ph, 10 AS ph_periodicidad_anios, 'CHN' AS procedencia FROM inventory WHERE {charset('serial')} <> ''""",
    "u2_u4_sets": f"{cte('live', 'static')}, a AS (SELECT DISTINCT serial FROM live), b AS (SELECT DISTINCT serial FROM static) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT count(*) FROM a WHERE serial IN (SELECT serial FROM b)) AS n_both, (SELECT count(*) FROM a WHERE serial NOT IN (SELECT serial FROM b)) AS n_first_only, (SELECT count(*) FROM b WHERE serial NOT IN (SELECT serial FROM a)) AS n_second_only",
    "a13_crops": f"{cte('boxes')}, {CROPS} SELECT count(*) AS n, quantile_cont(w, 0.5) AS median_w, quantile_cont(h, 0.5) AS median_h, (SELECT string_agg(ch, '' ORDER BY ch) FROM (SELECT DISTINCT unnest(string_split('S' || image_id, '')) AS ch FROM c WHERE reason = 'used')) AS alphabet FROM c WHERE reason = 'used'",
    "a6_resolutions": f"{cte('audit')} SELECT concat_ws('x', width::VARCHAR, (width % 7)::VARCHAR) AS resolution, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, resolution LIMIT 10",
    "a9_empty_groups": f"{cte('audit')} SELECT DISTINCT grp FROM audit WHERE grp NOT IN (SELECT grp FROM audit WHERE blur > 425)",
    "a11_undescribed": f"{cte('inventory', 'live')} SELECT DISTINCT asset_id FROM inventory WHERE asset_id NOT IN (SELECT asset_id FROM inventory WHERE ord IN (SELECT ord FROM live))",
    "p2_p3_usable": f"{cte('readings')} SELECT image_id, variant_ord, confidence FROM readings WHERE trim(text) <> '' AND confidence >= 0.6 AND {charset('text')} NOT IN ('PW200', 'PH0225')",
    "a4_best_variant": f"{cte('boxes')} SELECT image_id, class_id AS region_id, arg_max(box_ord % 3, struct_pack(c := confidence, v := -(box_ord % 3))) AS variant_ord, max(confidence) AS confidence FROM boxes GROUP BY image_id, class_id",
    "w3_region_order": f"{cte('boxes')} SELECT image_id, box_ord AS region_id, CASE WHEN class_id = 1 THEN 'serial_text' ELSE 'area' END AS label, confidence, row_number() OVER (PARTITION BY image_id ORDER BY class_id <> 1, confidence DESC, box_ord)::INT AS region_ord FROM boxes",
    "g3_restored": f"{cte('boxes')}, c AS (SELECT image_id, box_ord, greatest(x1, 0) AS a, greatest(y1, 0) AS b, least(x2, 2000.0) AS c, least(y2, 400.0) AS d FROM boxes), n AS (SELECT image_id, box_ord, (a + c) / 2 / 2000 AS cx, (b + d) / 2 / 400 AS cy, (c - a) / 2000 * 0.6::DOUBLE AS w, (d - b) / 400 * 0.6::DOUBLE AS h FROM c) SELECT image_id, box_ord, least(greatest(trunc(round((cx - w) * 2000, 6))::BIGINT, 0), 2000) AS x1, least(greatest(trunc(round((cy - h) * 400, 6))::BIGINT, 0), 400) AS y1, least(greatest(trunc(round((cx + w) * 2000, 6))::BIGINT, 0), 2000) AS x2, least(greatest(trunc(round((cy + h) * 400, 6))::BIGINT, 0), 400) AS y2 FROM n",
    "w8_by_condition": f"{cte('audit')} SELECT asset AS image_id, grp AS group_id, condition FROM audit WHERE condition = 'en' ORDER BY asset LIMIT 40 OFFSET 3",
    "t5_late": "SELECT event_type AS status, count(*) FILTER (WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 30 DAY) AS n_late, count(*) AS n FROM events GROUP BY 1",
    "udf_distances": f"{cte('readings')}, s AS (SELECT *, {charset('text')} AS k FROM readings), d AS (SELECT DISTINCT k, truth_serial FROM s), x AS (SELECT k, truth_serial, {distance('k', 'truth_serial', False)} AS distance, {distance('truth_serial', 'k', True)} AS inside FROM d) SELECT image_id, variant_ord, distance, inside FROM s JOIN x USING (k, truth_serial)",
    "u2_u4_keys": f"{cte('live', 'static')} SELECT serial, a IS NOT NULL AND b IS NOT NULL AS in_both, b IS NULL AS pending, a IS NULL AS stale FROM (SELECT DISTINCT serial, 1 AS a FROM live) FULL JOIN (SELECT DISTINCT serial, 1 AS b FROM static) USING (serial)",
    "w4_split": f"{cte('groups')}, {DEAL} SELECT group_id, n_items, split FROM dealt",
    "a15_manifest": f"{cte('groups')}, {DEAL} SELECT split, count(*) AS n_groups, sum(n_items)::BIGINT AS n_items FROM dealt GROUP BY split",
    "a15_leaks": f"{cte('groups')}, {DEAL} SELECT group_id, count(DISTINCT split) AS n FROM (SELECT group_id, split FROM dealt UNION ALL SELECT group_id, 'val' FROM groups WHERE n_items > 6) GROUP BY group_id HAVING count(DISTINCT split) > 1",
    "k6_corrections": f"{cte('readings')}, s AS (SELECT image_id, variant_ord, {charset('text')} AS k FROM readings), p AS (SELECT *, CASE WHEN length(k) = 9 THEN list_transform(range(1, 10), lambda i: CASE WHEN i = 3 THEN {SWAP_IN} ELSE {SWAP_OUT} END) END AS t FROM s), q AS (SELECT *, CASE WHEN t IS NULL THEN k ELSE array_to_string(list_transform(range(1, 10), lambda i: coalesce(t[i], substr(k, i, 1))), '') END AS text FROM p) SELECT image_id, variant_ord, text, coalesce(array_to_string(list_filter(list_transform(range(1, 10), lambda i: CASE WHEN t[i] IS NOT NULL THEN 'pos ' || (i - 1) || ': ' || substr(k, i, 1) || ' -> ' || t[i] END), lambda z: z IS NOT NULL), ';'), '') AS notes, length(text) = 9 AND regexp_matches(text, '^[0-9][0-9][A-Za-z][0-9]{{6}}$') AS valid FROM q",
    "j14_located": f"{cte('readings')}, {LOCATED} SELECT image_id, ord, text, distance FROM located",
    "a14_weak_coverage": f"{cte('readings', 'truth')}, {LOCATED}, h AS (SELECT t.condition, (l.image_id IS NOT NULL)::INT AS hit FROM truth t LEFT JOIN located l USING (image_id)) SELECT condition, count(*) AS n, sum(hit)::BIGINT AS n_hit, round(avg(hit), 4) AS coverage FROM h GROUP BY GROUPING SETS ((), (condition))",
    "a18_precision": f"{cte('boxes')}, {BEST_BOX}, lv AS (SELECT *, unnest(list_transform(range(10, 20), lambda z: z * 5 / 100)) AS level FROM b WHERE r = 1), h AS (SELECT *, (iou >= level AND row_number() OVER (PARTITION BY level, image_id, class_id, t_ord, iou >= level ORDER BY confidence DESC, iou DESC, p_ord) = 1)::INT AS hit FROM lv), st AS (SELECT class_id, level, confidence, sum(hit) AS tp, count(*) AS n FROM h GROUP BY ALL), cu AS (SELECT *, (sum(tp) OVER w / sum(n) OVER w) AS prec FROM st WINDOW w AS (PARTITION BY class_id, level ORDER BY confidence DESC)), en AS (SELECT *, max(prec) OVER (PARTITION BY class_id, level ORDER BY confidence DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu), nt AS (SELECT class_id, count(*) AS n_truth FROM boxes GROUP BY 1), pl AS (SELECT class_id, level, sum(tp / n_truth * env) AS ap, sum(tp) / sum(n) AS precision, sum(tp) / max(n_truth) AS recall FROM en JOIN nt USING (class_id) GROUP BY ALL) SELECT class_id, round(max(precision) FILTER (WHERE level = 0.5), 4) AS precision, round(max(recall) FILTER (WHERE level = 0.5), 4) AS recall, round(max(ap) FILTER (WHERE level = 0.5), 4) AS ap, round(avg(ap), 4) AS ap_50_95 FROM pl GROUP BY class_id",
}

SQL |= cascade_sql.SQL | fields_sql.SQL
#: DuckDB wants the word once, in front of all definitions.
SQL |= {name: sql.replace('WITH ', 'WITH RECURSIVE ', 1) for name, sql in SQL.items() if 'step AS (' in sql}
