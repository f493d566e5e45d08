"""Normalisers and identifier functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from lodestamp.functions import serial as S
from lodestamp.functions import text as T


def each(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (
        S.serial_charset, ["N° DE SERIE: 19S206055", "  19s206055 ", "SERIE 19-S20.6055", None, "S/N 12", ":", "SERIE SERIE X1"],
        ["DESERIE19S206055"[7:], "19S206055", "19S206055", "", "12", "", "X1"]
    ),
    (S.is_marking, ["PW200", "0.5LPW200", "PH300", "BH300BAR", "2021/05", "09/19", "UN1006", "ONU1072", "19S206055", None], [True] * 8 + [False] * 2),
    (S.allowed_errors, ["804", "20640", "K5738060"], [0, 0, 2]),
    (
        T.gas, ["C02", "AIRE COMPRIMIDO", "80% ARGON 20% CO2", "MEZCLA", "Oxígeno", "HELIO Y ARGON", "SN", "", None, "zzz"],
        ["CO2", "AIR", "MIX", "MIX", "O2", "MIX", None, None, None, None]
    ),
    (T.month_year, ["09/2019", "2019/09", "02/25", "09-19", "9.2019", "13/2019", "05/70", None], ["2019-09", "2019-09", "2025-02", "2019-09", "2019-09", None, "1970-05", None]),
    (T.year, ["09/2019", "año 1998", "x"], [2019, 1998, None]),
    (T.weight_kg, ["100 LB", "45,2 KG", "0", "500", "x", None], [45.36, 45.2, None, None, None, None]),
    (T.litres, ["40.4 L", "501"], [40.4, None]),
    (T.colour, ["Marrón/Gris", "verde con negro", "GRIS Y GRIS", "anaranjado", "S/N", "violeta"], ["marron/gris", "verde/negro", "gris", "naranja", None, None]),
    (T.country, ["China", "DE", "hecho en España", "Perú", "NO", "DIÓXIDO DE CARBONO"], ["CHN", "DEU", "ESP", "PER", None, "DEU"]),
    (lambda c: T.country(c, True), ["DIÓXIDO DE CARBONO", "DE", "CHINA"], [None, None, "CHN"]),
    (lambda c: T.hydrostatic(c)["period"], ["CADA 10 AÑOS", "02/2025", None], [10, None, None]),
    (lambda c: T.hydrostatic(c)["date"], ["CADA 10 AÑOS", "02/2025"], [None, "2025-02"]),
    (lambda c: T.length_cm(c, T.HEIGHT_CM)["value"], ["1.21 CM", "9999 CM", "130", None], [121.0, None, 130.0, None]),
    (lambda c: T.length_cm(c, T.HEIGHT_CM)["warning"].isNotNull(), ["1.21 CM", "9999 CM", "130", None], [True, True, False, False]),
    (T.measure_unit, ["m3", "KG", "kilos", "SN"], ["M3", "KG", "KG", None]),
    (T.condition_name, ["1. Frontal ", "Descripción 85", "3_cerca", "poca luz", "6.Poca luz"], ["1.Frontal", "Descripción", "3.Cerca", None, "6.Poca luz"]),
    (T.asset_name, ["Cilindro 7", "cilindro_007", "CILINDRO-1234", "x"], ["Cilindro_007", "Cilindro_007", "Cilindro_1234", None]),
    (T.flat_name, ["a/b/c.jpg"], ["a__b__c.jpg"]),
    (S.shape, ["19S206055", "K12"], ["DDADDDDDD", "ADD"]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_literal(spark, k):
    f, inputs, want = CASES[k]
    assert each(spark, f, inputs) == want


def test_distances(spark):
    pairs = [
        ("19S206055", "195206055", 0.5, None), ("K5738060", "2K5738060", 1.0, 0.0), ("K5738060", "JDK573306001", None, 1.0),
        ("", "abc", 3.0, 0.0), ("abc", "", 3.0, 3.0), ("abc", "abc", 0.0, 0.0)
    ]
    df = spark.createDataFrame(pairs, "a string, b string, d double, s double")
    for r in df.select("*", S.weighted_edit_distance(F.col("a"), F.col("b")).alias("x"), S.substring_distance(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.d is None or r.x == r.d
        assert r.s is None or r.y == r.s


def test_distance_equals_plain_loop():
    import random

    def plain(a, b, anywhere):
        row = [0.0 if anywhere else float(j) for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [float(i)]
            for j, y in enumerate(b, 1):
                c = 0.0 if x == y else 0.5 if x + y in S.CONFUSABLE or y + x in S.CONFUSABLE else 1.0
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + c))
            row = new
        return min(row) if anywhere else row[-1]

    rng = random.Random(1)
    a = ["".join(rng.choice("O0I1S5XK") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    b = ["".join(rng.choice("O0I1S5XK") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for anywhere in (False, True):
        assert S.pair_distances(a, b, anywhere).tolist() == [plain(x, y, anywhere) for x, y in zip(a, b, strict=True)]


def test_corrections(spark):
    df = spark.createDataFrame([("I9520605S",), ("19S206055",), ("SHORT",)], "x string")
    out = [tuple(r.c) for r in df.select(S.corrected(F.col("x"), F.lit("DDADDDDDD")).alias("c")).collect()]
    assert out[0][0] == "19S206055" and len(out[0][1]) == 3 and out[1] == ("19S206055", []) and out[2] == ("SHORT", [])
    assert df.select(S.corrected(F.col("x"), F.lit(None).cast("string"))["text"].alias("t")).first().t == "I9520605S"


def test_accents_of_every_code_point(spark):
    import unicodedata

    import pandas as pd

    from lodestamp.functions import text as T

    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k : k + 50]) for k in range(0, len(every), 50)]  # many at once, so that each path meets all kinds
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    got = {r.t: r.p for r in df.select("t", T.strip_accents(F.col("t")).alias("p")).collect()}
    assert [t for t in texts if got[t] != plain(t)] == []
