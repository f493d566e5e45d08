"""Input tables of the engine, derived from the general tables by SQL that means the same on any engine.

Names in braces are tables. ``frame`` runs a definition on Spark, ``cte`` writes it out for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Definitions by name; each may use tables and earlier definitions.
TABLES = {
    "inventory": """
      SELECT p_partkey AS ord, concat('Asset_', lpad(CAST(p_partkey AS STRING), 6, '0')) AS asset_id,
        CASE WHEN k % 50 = 0 THEN substr(d, 1, 5) WHEN k % 3 = 0 THEN concat('K', substr(d, 1, 7))
             WHEN k % 3 = 1 THEN concat(substr(d, 1, 2), 'S', substr(d, 3, 6)) ELSE substr(d, 1, 9) END AS serial,
        p_brand AS brand, p_size AS size, p_retailprice AS price
      FROM (SELECT *, translate(md5(CAST(k AS STRING)), 'abcdef', '012345') AS d
            FROM (SELECT *, CASE WHEN p_partkey % 97 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS k FROM {part}) a) b""",
    "readings": """
      SELECT image_id, variant_ord, 0 AS line_ord, truth_serial, condition, confidence,
        CASE WHEN variant_ord = 1 AND image_id % 4 = 1 THEN substr(full_text, 1, length(full_text) - 1) ELSE full_text END AS text
      FROM (
        SELECT e.event_id AS image_id, v.variant_ord, i.serial AS truth_serial, e.event_type AS condition,
          CAST(50 + (e.event_id * 7 + v.variant_ord * 13) % 50 AS DOUBLE) / 100 AS confidence,
          CASE e.event_id % 10 WHEN 0 THEN i.serial WHEN 1 THEN replace(i.serial, '5', 'S') WHEN 2 THEN substr(i.serial, 4)
            WHEN 3 THEN concat('X', i.serial, '01') WHEN 4 THEN concat(substr(i.serial, 1, 5), ' ', substr(i.serial, 6))
            WHEN 5 THEN 'PW200' WHEN 6 THEN 'PH 02/25' WHEN 7 THEN replace(replace(i.serial, '8', 'B'), '0', 'O')
            WHEN 8 THEN concat('SERIE ', i.serial) ELSE translate(substr(md5(concat('u', CAST(e.event_id AS STRING))), 1, 9), 'abcdef', '012345') END AS full_text
        FROM {events} e CROSS JOIN (SELECT 0 AS variant_ord UNION ALL SELECT 1 UNION ALL SELECT 2) v
        JOIN {inventory} i ON i.ord = (e.event_id * 31) % (SELECT count(*) FROM {part})) r""",
    "truth": "SELECT DISTINCT image_id, truth_serial, condition FROM {readings}",
    "field_lines": """
      SELECT l_orderkey AS image_id, l_linenumber AS line_ord, CAST(50 + (l_orderkey * 7 + l_linenumber * 13) % 50 AS DOUBLE) / 100 AS confidence, l_partkey AS k,
        CASE l_linenumber
          WHEN 1 THEN concat('PESO: ', CAST(CAST(l_quantity AS INT) AS STRING), CASE WHEN l_partkey % 3 = 0 THEN ' LB' ELSE ' KG' END)
          WHEN 2 THEN concat(CASE WHEN l_partkey % 2 = 0 THEN 'FAB ' ELSE 'Fabricación: ' END, lpad(CAST(month(l_shipdate) AS STRING), 2, '0'), '/', CASE WHEN l_partkey % 5 = 0 THEN substr(CAST(year(l_shipdate) AS STRING), 3) ELSE CAST(year(l_shipdate) AS STRING) END)
          WHEN 3 THEN concat('GAS: ', CASE l_partkey % 8 WHEN 0 THEN 'Oxígeno medicinal' WHEN 1 THEN 'C02' WHEN 2 THEN '80% ARGON 20% CO2' WHEN 3 THEN 'aire comprimido' WHEN 4 THEN 'HELIO Y ARGON' WHEN 5 THEN 'nitrógeno' WHEN 6 THEN 'SN' ELSE 'desconocido' END)
          WHEN 4 THEN concat('COLOR: ', CASE l_partkey % 7 WHEN 0 THEN 'Marrón/Gris' WHEN 1 THEN 'verde con negro' WHEN 2 THEN 'GRIS Y GRIS' WHEN 3 THEN 'anaranjado' WHEN 4 THEN 'S/N' WHEN 5 THEN 'light blue - white' ELSE 'violeta' END)
          WHEN 5 THEN concat('PROCEDENCIA: ', CASE l_partkey % 6 WHEN 0 THEN 'China' WHEN 1 THEN 'DE' WHEN 2 THEN 'hecho en España' WHEN 3 THEN 'Perú' WHEN 4 THEN 'NO' ELSE 'dióxido de carbono' END)
          WHEN 6 THEN concat('PH: ', CASE l_partkey % 5 WHEN 0 THEN '02/2025' WHEN 1 THEN 'CADA 10 AÑOS' WHEN 2 THEN '2019-9' WHEN 3 THEN '11/98 cada 5 años' ELSE 'pendiente' END)
          ELSE concat('ALTURA: ', CASE l_partkey % 5 WHEN 0 THEN '1.21 CM' WHEN 1 THEN '130,5' WHEN 2 THEN '1300 mm' WHEN 3 THEN '55 in' ELSE '9999 CM' END) END AS text
      FROM {lineitem}""",
    "boxes": """
      SELECT l_orderkey AS image_id, l_linenumber AS box_ord, CAST(160 * l_linenumber + l_partkey % 60 AS DOUBLE) AS x1, CAST(100 + 60 * floor((l_linenumber - 1) / 3) AS DOUBLE) AS y1,
        CAST(160 * l_linenumber + l_partkey % 60 + CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 10 ELSE 120 END AS DOUBLE) AS x2, CAST(100 + 60 * floor((l_linenumber - 1) / 3) + 20 + l_suppkey % 20 AS DOUBLE) AS y2,
        l_partkey % 15 AS shift, CAST(50 + (l_suppkey * 7) % 50 AS DOUBLE) / 100 AS confidence, CAST(l_partkey % 2 AS INT) AS class_id
      FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l""",
    "audit": """
      SELECT doc_id AS asset, source AS grp, lang AS condition, sha1 AS digest, n_chars AS width, CAST(doc_id % 260 AS DOUBLE) AS brightness, CAST(10 + doc_id % 60 AS DOUBLE) AS contrast, CAST(30 + doc_id % 400 AS DOUBLE) AS blur
      FROM (SELECT *, md5(text) AS sha1 FROM {documents}) d""",
    "groups": "SELECT conv_id AS group_id, count(*) AS n_items, sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) AS n_labelled FROM {conversations} GROUP BY conv_id",
    "live": "SELECT ord, serial, concat('L-', brand) AS brand, size FROM {inventory} WHERE ord % 4 = 0",
    "static": "SELECT ord, serial, brand, size FROM {inventory} WHERE ord % 5 <> 0",
}


def _needed(*names: str) -> list[str]:
    """The definitions that these ones need, in order."""
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += [other for other in TABLES if f"{{{other}}}" in TABLES[name]]
    return [name for name in TABLES if name in found]


class _Same(dict):
    def __missing__(self, key):
        return key


def cte(*names: str) -> str:
    """WITH ..., for an engine in which the general tables are views."""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format_map(_Same()).replace('AS STRING', 'AS VARCHAR')})" for n in _needed(*names))


GENERAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A definition, or a general table, as a DataFrame: nothing is computed before it is used."""
    if name in GENERAL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    used = {t: frame(spark, sf_dir, t) for t in (*GENERAL, *TABLES) if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)
