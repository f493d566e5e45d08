"""SQL for the matching cascade (J3-J6, A3, A12, A21, D1), for another engine on the same tables.

Every pair is compared here that a bound on its distance doesn't rule out: merging confusable characters can only bring two texts nearer, so the
plain edit distance of the merged texts, or of the serial to every part of the text that is long enough, is such a bound.
"""

from __future__ import annotations

from lodestamp.functions import serial as S
from lodestamp.plans.parts import ENTRIES, FRAGMENTS, OUTCOME, SWEEP, canonical, charset, distance, errors, quoted
from lodestamp.sources.fixtures import cte


def coarse(x: str) -> str:
    moved = [c for c, low in S.COARSE.items() if c != low]
    return f"translate({x}, '{''.join(moved)}', '{''.join(S.COARSE[c] for c in moved)}')"


def pairs_of(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({canonical(x)}, i, 2)))"


def first_five(c: str) -> str:
    return f"array_to_string(list_transform({c}[1:5], lambda x: x.s), ',')"


WHOLE, INSIDE = distance("t", "serial", False), distance("serial", "t", True)

SEARCH = f"""
said AS (SELECT DISTINCT image_id, text AS raw FROM readings WHERE text <> ''),
raws AS (SELECT raw, {charset('raw')} AS t FROM (SELECT DISTINCT raw FROM said)),
asked AS (SELECT t, {pairs_of('t')} AS bt, {coarse('t')} AS ct FROM (SELECT DISTINCT t FROM raws WHERE t <> '')),
known AS (SELECT serial, {errors('serial')} AS budget, {pairs_of('serial')} AS bs, {coarse('serial')} AS cs FROM e WHERE length(serial) >= 6),
common AS (SELECT t, serial, count(*) AS n FROM (SELECT t, unnest(bt) AS g FROM asked) JOIN (SELECT serial, unnest(bs) AS g FROM known) USING (g) GROUP BY t, serial),
likely AS (SELECT t, serial, budget, ct, cs FROM common JOIN asked USING (t) JOIN known USING (serial) WHERE n >= length(serial) - 3 - 2 * budget AND length(t) >= length(serial) - budget - 1 AND levenshtein(cs, ct) <= 2 * (budget + 1) + length(t) - length(serial)
  UNION SELECT t, serial, budget, ct, cs FROM asked, known WHERE contains(t, serial)),
closer AS (SELECT t, serial, budget FROM likely WHERE list_min(flatten(list_transform(range(1, length(t) + 1), lambda i: list_transform(range(length(serial) - budget - 1, length(serial) + budget + 2), lambda n: levenshtein(cs, substr(ct, i, n)))))) <= budget + 1),
near AS (SELECT * FROM (SELECT t, serial, budget, {INSIDE} AS d FROM closer) WHERE d <= budget + 1),
token AS (SELECT DISTINCT raw, {charset('token')} AS serial FROM (SELECT raw, unnest(string_split_regex(raw, '[\\s|/\\\\]+')) AS token FROM raws)),
pair AS (SELECT raw, serial, budget, d FROM near JOIN raws USING (t) UNION ALL SELECT raw, serial, 0, 0.0::DOUBLE FROM token JOIN e USING (serial) WHERE length(serial) < 6),
met AS (SELECT image_id, serial, budget, min(d) AS d FROM said JOIN pair USING (raw) GROUP BY ALL),
listed AS (SELECT image_id, list(struct_pack(d := d, s := serial, b := budget) ORDER BY d, serial) AS c FROM met GROUP BY image_id),
bested AS (SELECT *, list_filter(c, lambda x: x.d <= x.b)[1] AS best FROM listed),
answer AS (SELECT *, CASE WHEN best IS NULL THEN 'not_found' WHEN list_filter(c, lambda x: x.s <> best.s)[1].d - best.d < 1.0 THEN 'ambiguous' ELSE 'matched' END AS status FROM bested),
usable AS (SELECT image_id, bool_or({charset('raw')} <> '') AS u FROM said GROUP BY image_id),
search AS (SELECT image_id, CASE WHEN NOT u THEN 'not_attempted' ELSE coalesce(status, 'not_found') END AS status, CASE WHEN status = 'matched' THEN best.s END AS serial, best.d AS distance, coalesce({first_five('c')}, '') AS candidates FROM usable LEFT JOIN answer USING (image_id))"""


def resolve(texts: str) -> str:
    """Texts ``t`` of a table to ``resolved``: t, status, serial, distance, score, candidates."""
    return f"""
one AS (SELECT t, 'matched' AS status, serial, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS score, serial AS candidates FROM {texts} JOIN e ON t = serial),
open1 AS (SELECT t FROM {texts} WHERE t <> '' AND t NOT IN (SELECT t FROM one)),
within AS (SELECT t, count(*) AS n, list(struct_pack(o := ord, s := serial) ORDER BY ord, serial) AS c FROM open1, e WHERE length(t) >= 6 AND length(serial) >= 6 AND (contains(serial, t) OR contains(t, serial)) GROUP BY t),
two AS (SELECT t, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN c[1].s END AS serial, CASE WHEN n = 1 THEN abs(length(t) - length(c[1].s)) ELSE 0 END::DOUBLE AS distance,
  CASE WHEN n = 1 THEN round(least(length(t), length(c[1].s)) / greatest(length(t), length(c[1].s)), 4) ELSE 0.5 END::DOUBLE AS score, {first_five('c')} AS candidates FROM within),
open2 AS (SELECT t FROM open1 WHERE t NOT IN (SELECT t FROM two)),
like1 AS (SELECT t, serial, {errors('serial')} AS b FROM open2, e WHERE abs(length(t) - length(serial)) <= {errors('serial')} + 1 AND levenshtein({coarse('t')}, {coarse('serial')}) <= {errors('serial')} + 1),
like2 AS (SELECT * FROM (SELECT t, serial, b, {WHOLE} AS d FROM like1) WHERE d <= b + 1),
like3 AS (SELECT t, list(struct_pack(d := d, s := serial, b := b) ORDER BY d, serial) AS c FROM like2 GROUP BY t),
like4 AS (SELECT *, list_filter(c, lambda x: x.d <= least(2, x.b)) AS w FROM like3),
like5 AS (SELECT *, CASE WHEN len(w) = 0 THEN 'not_found' WHEN w[2].d - w[1].d < 1.0 THEN 'ambiguous' ELSE 'matched' END AS status FROM like4),
three AS (SELECT t, status, CASE WHEN status = 'matched' THEN w[1].s END AS serial, w[1].d AS distance, round(greatest(0.0, 1 - w[1].d / greatest(length(t), 1)), 4) AS score, {first_five('c')} AS candidates FROM like5),
rest AS (SELECT t, CASE WHEN t = '' THEN 'not_attempted' ELSE 'not_found' END AS status, NULL::VARCHAR AS serial, NULL::DOUBLE AS distance, NULL::DOUBLE AS score, '' AS candidates FROM {texts} WHERE t = '' OR (t IN (SELECT t FROM open2) AND t NOT IN (SELECT t FROM three))),
resolved AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM rest)"""


SUPPORT = f"""
backing AS (SELECT r.*, s.serial, {errors('s.serial')} AS budget, {charset('text')} AS t FROM readings r JOIN search s USING (image_id) WHERE s.status = 'matched' AND text <> ''),
measured AS (SELECT b.*, d FROM backing b JOIN (SELECT serial, t, {INSIDE} AS d FROM (SELECT DISTINCT serial, t FROM backing)) USING (serial, t)),
variants AS (SELECT image_id, count(DISTINCT variant_ord) AS n_variants FROM readings WHERE text <> '' GROUP BY image_id),
backed AS (SELECT image_id, count(DISTINCT variant_ord) AS k, sum(round(confidence * 1000000)::BIGINT) / count(*) / 1000000 AS mean, arg_min(text, struct_pack(d := d, c := -confidence, v := variant_ord, l := line_ord)) AS raw FROM measured WHERE d <= budget GROUP BY image_id),
support AS (SELECT image_id, serial, coalesce(round(least(1.0, 0.5 * k / n_variants + 0.5 * mean) + 1e-9, 4), 0.0) AS confidence, trim(coalesce(raw, serial)) AS raw FROM search LEFT JOIN backed USING (image_id) JOIN variants USING (image_id) WHERE status = 'matched')"""

CONSENSUS = """
votes AS (SELECT image_id, text, count(*) AS n_votes, avg(m.confidence) AS mc, min(struct_pack(v := variant_ord, l := m.line_ord, f := m.frag_ord)) AS seen FROM c GROUP BY 1, 2),
scored AS (SELECT *, round(least(1.0, (0.5 * n_votes / n_variants + 0.5 * mc) * 1.05) + 1e-9, 4) AS score FROM votes JOIN variants USING (image_id)),
agreed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, seen, text) AS rank FROM scored)"""

IDENTIFY = f"""
tried AS (SELECT a.*, s.status AS search_status FROM agreed a JOIN search s USING (image_id) WHERE s.status <> 'matched' AND rank <= 25),
trytexts AS (SELECT DISTINCT text AS t FROM tried),
{resolve('trytexts')},
won AS (SELECT image_id, min(struct_pack(r := rank, f := x.serial, t := t, s := tried.score)) AS m FROM tried JOIN resolved x ON tried.text = x.t AND x.status = 'matched' GROUP BY image_id),
proposed AS (SELECT image_id, min(struct_pack(r := rank, t := text, s := score)) AS m FROM agreed WHERE length(text) >= 6 GROUP BY image_id),
identified AS (
  SELECT image_id, 'matched' AS status, serial, {charset('raw')} AS read_text, confidence, 'search' AS stage, NULL::VARCHAR AS reason FROM support
  UNION ALL SELECT image_id, 'matched', m.f, m.t, m.s, 'resolve', NULL FROM won
  UNION ALL SELECT image_id, CASE WHEN s.status = 'not_attempted' THEN 'not_found' ELSE s.status END, NULL, p.m.t, p.m.s, 'proposal',
    CASE WHEN s.status = 'ambiguous' THEN 'ambiguous_catalog_match' WHEN p.m IS NOT NULL THEN 'serial_not_in_catalog' ELSE 'no_serial_detected' END
    FROM search s LEFT JOIN proposed p USING (image_id) WHERE s.status <> 'matched' AND image_id NOT IN (SELECT image_id FROM won)),
identity AS (SELECT i.*, s.candidates FROM identified i JOIN search s USING (image_id))"""

# The review of every image that has a truth: blocking flags of the entry, then the confidence.
DECIDE = """
flagged AS (SELECT i.*, n > 1 AS dup, length(e.serial) < 7 AS short FROM identity i LEFT JOIN e ON i.serial = e.serial),
why AS (SELECT *, list_filter([reason, CASE WHEN dup THEN 'duplicate_serial_in_catalog' END, CASE WHEN short THEN 'serial_too_short' END], lambda x: x IS NOT NULL) AS w FROM flagged),
ruled AS (SELECT *, CASE WHEN coalesce(dup, false) OR coalesce(short, false) OR read_text IS NULL THEN NULL WHEN coalesce(confidence, 0) < 0.6 THEN 'low_ocr_confidence' WHEN status <> 'matched' THEN NULL WHEN coalesce(confidence, 0) < 0.9 THEN 'low_ocr_confidence' END AS added FROM why),
decided AS (SELECT image_id, candidates, status, coalesce(serial, read_text) AS serial, serial IS NOT NULL AS is_resolved, confidence, stage,
  array_to_string(list_sort(list_distinct(list_filter(list_append(w, added), lambda x: x IS NOT NULL))), ',') AS reasons,
  coalesce(dup, false) OR coalesce(short, false) OR read_text IS NULL OR added IS NOT NULL OR status <> 'matched' OR len(w) > 0 AS needs_review FROM ruled),
j AS (SELECT t.*, d.status, d.serial, is_resolved, confidence, stage, reasons, candidates, coalesce(needs_review, true) AS needs_review FROM truth t LEFT JOIN decided d USING (image_id))"""

BASE = cte("readings", "inventory", "truth")
FOUND = f"{BASE}, {ENTRIES}, {SEARCH}"
CASCADE = f"{FOUND}, {SUPPORT}, {FRAGMENTS}, {CONSENSUS}, {IDENTIFY}"


def again(where: str) -> str:
    """The cascade over some of the rows of ``every``."""
    return f"WITH readings AS (SELECT * FROM every WHERE {where}), {ENTRIES}, {SEARCH}, {SUPPORT}, {FRAGMENTS}, {CONSENSUS}, {IDENTIFY} SELECT image_id, status, serial, read_text, confidence, stage, reason, candidates FROM identity"


OPTIONS = """o AS (SELECT coalesce(serial = truth_serial, false) AS hit, coalesce(serial = truth_serial, false) OR coalesce(list_contains(string_split(candidates, ',')[1:4], truth_serial), false) AS among, coalesce(serial <> truth_serial, false) AS wrong FROM {joined})
SELECT count(*) AS n, round(avg(hit::INT), 4) AS proposed, round(avg(among::INT), 4) AS among_four, round(avg(wrong::INT), 4) AS wrong FROM o"""

SQL = {
    "j3_resolve": f"{BASE}, {ENTRIES}, texts AS (SELECT DISTINCT {charset('text')} AS t FROM readings), {resolve('texts')} SELECT t AS text, status, serial, distance, score, candidates FROM resolved",
    "j4_search": f"{FOUND} SELECT image_id, status, serial, distance, candidates FROM search",
    "a3_support": f"{FOUND}, {SUPPORT} SELECT image_id, serial, confidence, raw FROM support",
    "a21_top_k": f"{CASCADE}, q AS (SELECT t.truth_serial, s.serial, s.candidates FROM truth t LEFT JOIN identity s USING (image_id)), " + OPTIONS.format(joined="q"),
    "j5_identify": f"{CASCADE} SELECT image_id, status, serial, read_text, confidence, stage, reason, candidates FROM identity",
    "d1_decisions": f"{CASCADE}, {DECIDE} SELECT image_id, truth_serial, condition, status, serial, is_resolved, confidence, stage, reasons, needs_review, candidates, {OUTCOME} AS outcome FROM j",
    "a12_cascade": f"{CASCADE}, {DECIDE}, x AS (SELECT condition, {OUTCOME} AS outcome FROM j) SELECT condition, outcome, count(*) AS n FROM x GROUP BY GROUPING SETS ((outcome), (condition, outcome))",
    "d5_g7_payload": f"{CASCADE} SELECT image_id, status, serial, confidence, reason FROM identity",
    "a12_outcomes": f"""{CASCADE}, {DECIDE}, partly AS (SELECT * REPLACE (CASE WHEN image_id % 23 <> 22 THEN truth_serial END AS truth_serial) FROM j),
      x AS (SELECT condition, CASE WHEN truth_serial IS NOT NULL AND image_id % 37 = 36 THEN 'missing_file' ELSE {OUTCOME} END AS outcome FROM partly), y AS (SELECT condition, outcome, count(*) AS n FROM x GROUP BY GROUPING SETS ((outcome), (condition, outcome)))
      SELECT *, CASE WHEN outcome NOT IN ('no_truth', 'missing_file') THEN round(n / sum(n) FILTER (WHERE outcome NOT IN ('no_truth', 'missing_file')) OVER (PARTITION BY condition), 4) END AS rate FROM y""",
    "a19_sweep": f"{CASCADE}, {DECIDE}, {SWEEP} SELECT * FROM s",
    "a20_recommend": f"{CASCADE}, {DECIDE}, {SWEEP} SELECT threshold AS auto_accept, greatest(round(threshold - 0.30, 2), 0.0) AS review, automation_rate FROM s WHERE silent_error_rate <= 0.2 ORDER BY automation_rate DESC, threshold LIMIT 1",
    "u5_retry": f"""{BASE}, every AS (SELECT * FROM readings), one AS ({again('variant_ord = 0')}),
      more AS (SELECT DISTINCT image_id FROM every WHERE variant_ord > 0 AND image_id NOT IN (SELECT image_id FROM one WHERE status = 'matched')), two AS ({again('image_id IN (SELECT image_id FROM more)')}),
      adopted AS (SELECT * FROM two WHERE status = 'matched' OR image_id NOT IN (SELECT image_id FROM one))
      SELECT *, 1 AS attempt FROM one WHERE image_id NOT IN (SELECT image_id FROM adopted) UNION ALL SELECT *, 2 FROM adopted""",
}
