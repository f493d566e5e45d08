"""Matching, fields, decisions, data sets and streams."""

import itertools
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from lodestamp.functions import serial as S
from lodestamp.operators import boxes, consensus, datasets, evaluate, fields, fuzzy, inventory, matching
from lodestamp.plans.registry import ORACLES, QUERIES
from lodestamp.sources import tables
from lodestamp.sources.fixtures import frame

SF = "/root/testdata/sf0.001"


def entries(spark, serials):
    return spark.createDataFrame([(i, f"A{i}", s) for i, s in enumerate(serials)], "ord long, asset_id string, serial string").transform(lambda d: inventory.entries(d, ()))


def readings(spark, rows):
    return spark.createDataFrame([(i, v, k, t, c) for k, (i, v, t, c) in enumerate(rows)], "image_id long, variant_ord int, line_ord int, text string, confidence double")


def resolve(spark, texts, serials):
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(S.serial_charset(F.col("text")).alias("text"))
    return {r.text: (r.status, r.serial) for r in matching.resolve(df, entries(spark, serials)).collect()}


def test_resolve(spark):
    got = resolve(spark, ["I9S206055", "19S2060S5", "19s2O6O55", "ZZZZ"], ["19S206055"])
    assert all(v == ("matched", "19S206055") for k, v in got.items() if k != "ZZZZ") and got["ZZZZ"][0] == "not_found"
    assert resolve(spark, ["206055"], ["19S206055", "20S206055"])["206055"][0] == "ambiguous"
    assert resolve(spark, ["19S20605X"], ["19S206055", "19S206054"])["19S20605X"][0] == "ambiguous"
    assert resolve(spark, ["206055"], ["19S206055"])["206055"] == ("matched", "19S206055")


def search(spark, text, serials):
    r = matching.search(readings(spark, [(1, 0, text, 0.9)]), entries(spark, serials)).first()
    return r.status, r.serial


def test_search(spark):
    pair = ["26K010018", "26K01X019"]
    assert search(spark, "26K01O018", ["26K010018", "26K010044"]) == ("matched", "26K010018")
    assert search(spark, "804", ["804", "26K010018"]) == ("matched", "804")
    assert search(spark, "18043", ["804"])[0] == "not_found"
    assert search(spark, "2K5738060", ["K5738060"]) == ("matched", "K5738060")
    assert search(spark, "111111111", ["111111111"]) == ("matched", "111111111")  # few distinct bigrams, but there as it is
    assert search(spark, "SERIE:", pair)[0] == "not_attempted"


def test_search_equals_all_pairs(spark):
    inv = inventory.entries(frame(spark, SF, "inventory"))
    texts = frame(spark, SF, "readings").select(F.col("text").alias("raw")).distinct().limit(120)
    normed = texts.withColumn("text", S.serial_charset(F.col("raw")))
    long = matching.budgets(inv.where("length(serial) >= 6"))
    pairs = normed.join(matching.fuzzy_pairs(normed.select("text").where("text <> ''").distinct(), long, 9, True), "text").select("raw", "serial", "distance")
    got = {(r.raw, r.serial): r.distance for r in pairs.unionByName(matching.whole_tokens(texts, inv).select("raw", "serial", "distance")).collect()}
    raws, serials = [r.raw for r in texts.collect()], [r.serial for r in inv.collect()]
    norm = dict(spark.createDataFrame([(x,) for x in raws], "raw string").select("raw", S.serial_charset(F.col("raw")).alias("t")).collect())
    table = str.maketrans("".join(S.LETTER_TO_DIGIT) + "K", "".join(S.LETTER_TO_DIGIT.values()) + "1")
    grams = lambda t: {t.translate(table)[i : i + 2] for i in range(len(t) - 1)}
    want = {}
    for raw, s in itertools.product(raws, serials):
        budget = 0 if len(s) < 6 else len(s) // 4
        if len(s) >= 6 and (len(grams(s) & grams(norm[raw])) >= len(s) - 3 - 2 * budget or s in norm[raw]):
            d = S.pair_distances([s], [norm[raw]], True)[0]
            if norm[raw] and d <= budget + 1:
                want[raw, s] = d
    assert {k: v for k, v in got.items() if len(k[1]) >= 6} == want


def test_consensus(spark):
    rows = [(1, v, t, c) for v, t, c in [(0, "19S206055", 0.97), (1, "19S20605", 0.99), (2, "SERIE 19S206055", 0.9), (3, "19S206055 PW200", 0.8), (4, "nothing", 0.9)]]
    pattern = spark.createDataFrame([(5, 14, None)], "min_length int, max_length int, mask string")
    out = consensus.consensus(readings(spark, rows), pattern).orderBy("rank").collect()
    assert out[0].text == "19S206055" and out[0].n_votes == 3 and out[0].n_variants == 5


def test_identify_cascade(spark):
    e = entries(spark, ["19S206055", "K5738060", "123456789"])
    pattern = spark.createDataFrame([(8, 9, None)], "min_length int, max_length int, mask string")
    rows = [(1, 0, "X19S206055", 0.9), (2, 0, "PW200", 0.9), (3, 0, "99999999", 0.8), (4, 0, None, 0.9), (1, 1, "19S206O55", 0.7)]
    got = {r.image_id: r for r in matching.identify(readings(spark, rows), e, pattern).collect()}
    assert got[1].serial == "19S206055" and got[1].stage == "search" and got[1].reason is None
    assert got[2].reason == "no_serial_detected" and got[3].reason == "serial_not_in_catalog" and got[3].read_text == "99999999" and 4 not in got


def test_outcomes_of_the_cascade(spark):
    from lodestamp.plans import registry

    inv = spark.createDataFrame([(i, f"A{i}", s) for i, s in enumerate(["19S206055", "K5738060", "123456789"])], "ord long, asset_id string, serial string")
    rows = [(1, 0, "X19S206055", 0.9), (2, 0, "I2345678O", 0.9), (3, 0, "K5738060", 0.9), (4, 0, "PW200", 0.9)]
    truth = spark.createDataFrame(
        [(1, "19S206055", "a"), (2, "123456789", "a"), (3, "K5738060", "b"), (4, "K5738060", "b"), (5, "K5738060", "b")],
        "image_id long, truth_serial string, condition string"
    )
    judged = {r.image_id: r for r in registry.judged(readings(spark, rows), inv, truth).collect()}
    want = {}
    for r in judged.values():
        for key in ((None, r.outcome), (r.condition, r.outcome)):
            want[key] = want.get(key, 0) + 1
    got = {(r.condition, r.outcome): r.n for r in registry.cascade_outcomes(readings(spark, rows), inv, truth).collect()}
    assert got == want and len(judged) == 5
    assert judged[1].outcome in ("correct", "referred_correct") and judged[3].outcome in ("correct", "referred_correct") and judged[5].outcome == "referred_unread"
    assert "a12_cascade" in QUERIES and "a12_cascade" in ORACLES


def test_pattern_and_entries(spark):
    inv = spark.createDataFrame([(i, f"A{i}", f"1{i}S20605{i}") for i in range(8)], "ord long, asset_id string, serial string")
    p = inventory.pattern(inv).first()
    assert (p.min_length, p.max_length, p.mask) == (9, 9, "DDADDDDDD") or p.mask is not None
    assert tuple(inventory.pattern(inv.limit(0)).first()) == (5, 14, None)


def test_fields(spark):
    rows = [
        (1, 0, "MARCA: JP5", 0.9), (1, 0, "PESO: 45,2 KG", 0.8), (1, 0, "09/2019", 0.9), (1, 0, "PH 02/25", 0.9),
        (2, 0, "NORRIS 40.4 L", 0.9), (2, 0, "linca", 0.2), (3, 0, "PH: CADA 10 AÑOS", 0.9)
    ]
    got = {(r.image_id, r.field): (r.value, r.confidence) for r in fields.stated(readings(spark, rows)).collect()}
    assert got[1, "marca"] == ("JP5", 0.9) and got[1, "peso"] == ("45.2", 0.8) and got[1, "fecha_fabricacion"] == ("2019-09", 0.63) and got[1, "anio_fabricacion"][0] == "2019"
    assert got[1, "ph"] == ("2025-02", 0.81) and got[2, "marca"] == ("NORRIS", 0.495) and got[2, "litros"][0] == "40.4" and got[3, "ph_periodicidad_anios"][0] == "10"


def test_records(spark):
    raw = spark.createDataFrame(
        [("a", "N 19S206055", "SN", "pendiente", "CADA 5 AÑOS", "DIÓXIDO DE CARBONO", "1.21 CM"), ("b", "", "x", None, None, None, None)],
        "name string, numero_serie string, marca string, fecha_fabricacion string, ph string, tipo_gas string, largo_altura string"
    )
    got = {r.name: r for r in fields.normalised_record(raw).collect()}
    assert got["a"].tipo_gas == "CO2" and got["a"].marca is None and got["a"].ph_periodicidad_anios == 5 and got["a"].largo_altura == 121.0 and set(got["a"].issues) == {
        "fecha_fabricacion", "largo_altura"
    }
    assert got["b"].numero_serie is None and got["b"].issues == ["numero_serie"]
    form = fields.app_form(fields.normalised_record(raw)).where("numero_serie is not null").first()
    assert form.tipo_gas == "DIÓXIDO DE CARBONO" and form.ph == "CADA 5 AÑOS PH"


def test_decide(spark):
    one = lambda reasons, status, conf, **k: tuple(
        spark.range(1).select(
            evaluate.decide(F.array(*map(F.lit, reasons)).cast("array<string>"), F.lit(status), F.lit(True), F.lit(conf), **k).alias("d")
        ).first().d
    )
    assert one([], "matched", 0.95, calibrated=True) == (False, None)
    assert one([], "matched", 0.95, calibrated=True, accept=1.0) == (True, "confirmation_required")
    assert one(["serial_too_short"], "matched", 0.99, calibrated=False) == (True, None)
    assert one([], "matched", 0.99, calibrated=False) == (True, "thresholds_not_calibrated")
    assert one([], "matched", 0.5, calibrated=True)[1] == "low_ocr_confidence" and one(["x"], "matched", 0.95, calibrated=True) == (True, None)


def test_boxes(spark):
    rows = [
        dict(ord=0, text="060", confidence=0.8, x1=300.0, y1=10.0, x2=380.0, y2=50.0),
        dict(ord=1, text="K5738", confidence=0.9, x1=100.0, y1=12.0, x2=280.0, y2=50.0),
        dict(ord=2, text="far", confidence=0.9, x1=100.0, y1=300.0, x2=280.0, y2=340.0)
    ]
    out = boxes.joined_rows(rows)
    assert [(x["text"], x["confidence"], x["x1"], x["x2"]) for x in out] == [("K5738 060", 0.8, 100.0, 380.0)]
    assert [x["n_boxes"] for x in boxes.merged_rows(rows)] == [2, 1]


def test_split_invariants(spark):
    groups = spark.createDataFrame([(i, 1 + i * 7 % 5) for i in range(60)], "group_id long, n_items long")
    out = datasets.balanced_split(groups).collect()
    assert len(out) == 60 and len({r.group_id for r in out}) == 60
    total = sum(r.n_items for r in out)
    for split, ratio in zip(datasets.SPLITS, (0.7, 0.15, 0.15), strict=True):
        assert abs(sum(r.n_items for r in out if r.split == split) - ratio * total) <= 5
    with pytest.raises(ValueError):
        datasets.split_quotas([(1, 2)], (0.7, 0.15, 0.15))


def dealt_one_by_one(histogram, ratios):
    target, have, taken = [r * sum(s * n for s, n in histogram) for r in ratios], [0, 0, 0], {}
    for size, n in sorted(histogram, reverse=True):
        for _ in range(n):
            lack = [(t - h) / max(t, 1e-9) if t > 0 else float("-inf") for t, h in zip(target, have, strict=True)]
            k = lack.index(max(lack))
            have[k] += size
            taken[size, datasets.SPLITS[k]] = taken.get((size, datasets.SPLITS[k]), 0) + 1
    return taken


def test_split_quotas_in_closed_form():
    rng = random.Random(3)
    for ratios in ((0.7, 0.15, 0.15), (0.5, 0.5, 0.0), (0.0, 0.25, 0.75), (1.0, 0.0, 0.0), (0.4, 0.3, 0.3)):
        for _ in range(60):
            histogram = [(s, rng.choice([1, 2, 3, 10, 200])) for s in rng.sample(range(40), rng.randint(1, 12))] + [(50, 3)]
            taken, before = {}, {}
            for size, last, split in datasets.split_quotas(histogram, ratios):
                taken[size, split] = last - before.get(size, 0)
                before[size] = last
            assert taken == dealt_one_by_one(histogram, ratios)
    runs = datasets.split_quotas([(7, 3_000_000_000), (3, 10)], (0.7, 0.15, 0.15))  # never ends group by group
    assert len(runs) <= 6 and sum(last for size, last, _ in runs if size == 7 and last == 3_000_000_000) == 3_000_000_000


def test_split_deals_every_group_by_cells(spark, monkeypatch):
    monkeypatch.setattr(datasets, "CELL_GROUPS", 20)
    rows = [(i, 4 if i % 3 else 1 + i % 5) for i in range(900)]
    out = datasets.balanced_split(spark.createDataFrame(rows, "group_id long, n_items long").repartition(3)).collect()
    histogram = {}
    for _, size in rows:
        histogram[size] = histogram.get(size, 0) + 1
    taken = {}
    for r in out:
        taken[r.n_items, r.split] = taken.get((r.n_items, r.split), 0) + 1
    assert sorted((r.group_id, r.n_items) for r in out) == rows and taken == dealt_one_by_one(list(histogram.items()), (0.7, 0.15, 0.15))


def test_sources(spark):
    d = tempfile.mkdtemp(prefix="src-", dir="/tmp")
    for name, text in {
        "a.json": '{"version": 1, "cylinders": [{"numero_serie": "X1"}, 5, {"numero_serie": "X2"}]}', "b.json": '[{"numero_serie": "X3"}]',
        "c.json": "{broken"
    }.items():
        open(f"{d}/{name}", "w").write(text)
    assert {(r.ord, r.numero_serie) for r in tables.read_inventory_json(spark, f"{d}/*.json", "numero_serie string").collect()} == {(0, "X1"), (2, "X2"), (0, "X3")}
    open(f"{d}/t.csv", "w").write("imagen,numero_serie\n a.jpg ,19s1\na.jpg,19S2\n,x\nb.jpg,\n")
    assert [(r.image, r.serial) for r in tables.read_truth_csv(spark, f"{d}/t.csv").collect()] == [("a.jpg", "19S2")]
    open(f"{d}/l.txt", "w").write("1 0.5 0.5 0.1\n2 0.5 0.4 0.1 0.1\n1 0.1 0.2 0.3 0.4\n")
    assert tables.read_box_labels(spark, f"{d}/l.txt").first().class_id == 2 and tables.read_box_labels(spark, f"{d}/l.txt", 1).first().w == 0.3
    inv = spark.createDataFrame([(1, "a")], "ord long, serial string")
    tables.write_snapshot(inv, f"{d}/snap", "v1")
    tables.write_snapshot(inv.withColumn("ord", F.lit(2).cast("long")), f"{d}/snap", "v2")
    assert tables.newest_snapshot(spark, f"{d}/snap").first().ord == 2
    with pytest.raises(ValueError):
        tables.insert(inv, "jdbc:x", "t", None, apply=True)


def test_stream_of_split_requests_equals_batch(spark):
    from datetime import datetime
    from pathlib import Path

    from lodestamp.streaming import flow

    d = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    inv = frame(spark, SF, "inventory")
    rows = frame(spark, SF, "readings").where("image_id < 30").select(
        F.col("image_id").alias("request_id"), "variant_ord", "line_ord", "text", "confidence",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("image_id")).alias("ts")
    )
    # Each request in two files, with some rows twice; then a row that moves the watermark on, and one more to close that.
    late = spark.createDataFrame([(900, 0, 0, "19S206055", 0.9, datetime(2023, 11, 15))], rows.schema)
    for k, part in enumerate([rows.where("variant_ord = 0"), rows.where("variant_ord > 0 or request_id % 7 = 0"), late]):
        part.coalesce(1).write.parquet(f"{d}/part{k}")
        next(Path(f"{d}/part{k}").glob("*.parquet")).rename(Path(f"{d}") / f"{k}.parquet")
    (Path(d) / "in").mkdir()
    for k in range(3):
        (Path(d) / f"{k}.parquet").rename(Path(d) / "in" / f"{k}.parquet")
        time.sleep(0.02)
    reads = []
    snapshot = flow.Snapshot(spark, lambda: "v1", lambda v: reads.append(v) or inv)
    stream = flow.read_rows(spark, f"{d}/in", rows.schema, 1)
    q = flow.identify_stream(stream, snapshot, f"{d}/log", f"{d}/cp", availableNow=True)
    q.awaitTermination()
    logged = spark.read.json(f"{d}/log")
    got = sorted(map(str, logged.select("image_id", "status", "serial", "candidates").collect()))
    batch = matching.identify(rows.withColumn("image_id", F.col("request_id")), inventory.entries(inv, ()), inventory.pattern(inv))
    assert got == sorted(map(str, batch.select("image_id", "status", "serial", "candidates").collect())) and reads == ["v1"]
    # A batch that is written again leaves one copy, and retention empties old days.
    name = str(logged.first().batch)
    again = logged.drop("day", "batch").withColumn("ts", F.to_timestamp("ts"))
    tables.append_log(spark.createDataFrame(again.collect(), again.schema), f"{d}/log", name)
    assert spark.read.json(f"{d}/log").count() == 30
    assert tables.purge_log(spark, f"{d}/log", "2023-12-31", 10) == ["2023-11-14"]
    assert not list(Path(f"{d}/log").glob("day=*"))


def test_snapshot_follows_its_version(spark):
    from lodestamp.streaming.flow import Snapshot

    now, pointer, reads, broken = [0.0], ["a"], [], [False]

    def read(v):
        if broken[0]:
            raise OSError("no source")
        reads.append(v)
        return spark.createDataFrame([(k, f"A{k}", f"{v}0000{k}") for k in range(3 if v == "a" else 5)], "ord long, asset_id string, serial string")

    s = Snapshot(spark, lambda: pointer[0], read, 1.0, lambda: now[0])
    seen = []
    for k in range(10):
        now[0] = 3.0 * k  # every other batch is due: the floor is five seconds
        pointer[0] = "a" if k < 5 else "b"
        broken[0] = k == 6
        seen.append(s.current()[0].count())
    assert reads == ["a", "b"] and seen[:6] == [3] * 6 and seen[-1] == 5
    assert 3 in seen[6:8]  # the failed refresh left the last good version
    held = [t.name for t in spark.catalog.listTables() if t.name.startswith("inventory_entries_")]
    pointer[0], now[0] = "c", 100.0
    s.current()
    assert len([t.name for t in spark.catalog.listTables() if t.name.startswith("inventory_entries_")]) <= len(held)


def test_late_rows_of_a_running_stream(spark):
    from datetime import datetime
    from pathlib import Path

    from lodestamp.streaming import flow

    d = Path(tempfile.mkdtemp(prefix="late-", dir="/tmp"))
    (d / "in").mkdir()
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(at(12, 0), "ok"), (at(12, 1), "bad")], [(at(11, 40), "ok"), (at(11, 55), "ok"), (at(11, 30), "bad"), (at(12, 30), "ok")], [(at(12, 15), "ok"), (at(12, 25), "ok")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, status string").coalesce(1).write.parquet(str(d / f"part{k}"))
        next((d / f"part{k}").glob("*.parquet")).rename(d / "in" / f"{k}.parquet")
        time.sleep(0.02)
    counted = flow.late_on_stream(flow.read_rows(spark, str(d / "in"), "ts timestamp, status string", 1), "10 minutes")
    q = counted.writeStream.format("memory").queryName("late_counts").outputMode("update").option("checkpointLocation", str(d / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = spark.table("late_counts").groupBy("status", "part").agg(F.max(F.struct("n", "n_late")).alias("m")).groupBy("status").agg(
        F.sum("m.n").alias("n"), F.sum("m.n_late").alias("n_late")
    )
    assert {(r.status, r.n, r.n_late) for r in newest.collect()} == {("ok", 6, 2), ("bad", 2, 1)}


def test_fuzzy_pairs_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("0O1IS5678BXK2Z") for _ in range(n))
    serials = sorted({word(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 17])) for _ in range(60)})

    def worn(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "0", "8", "X", "S"])
        return word(rng.randint(0, 2)) + "".join(s) + word(rng.randint(0, 2))

    texts = sorted({worn(rng.choice(serials)) for _ in range(150)} - {""})
    frames = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(s,) for s in serials], "serial string")
    budget = lambda s: 0 if len(s) < 6 else len(s) // 4
    known = matching.budgets(frames[1])
    long = matching.budgets(frames[1].where("length(serial) >= 6"))
    grams = lambda x: {"".join(S.LETTER_TO_DIGIT.get(c, "1" if c == "K" else c) for c in x[i : i + 2]) for i in range(len(x) - 1)}
    for errors, tile in ((9, 8192), (2, 8192), (0, 8192), (9, 5)):
        monkeypatch.setattr(fuzzy, "TILE_TEXTS", tile)
        monkeypatch.setattr(fuzzy, "TILE_SERIALS", tile)
        most = lambda s: min(budget(s) + 1, errors)  # noqa: B023, E731
        want = {}
        for t, s in itertools.product(texts, serials):
            d = S.pair_distances([t], [s], False)[0]
            if d <= most(s):
                want[t, s] = d
        got = matching.fuzzy_pairs(frames[0], known, errors, False).collect()
        assert {(r.text, r.serial): r.distance for r in got} == want and len(got) == len(want)
        want = {}
        for t, s in itertools.product(texts, [s for s in serials if len(s) >= 6]):
            d = S.pair_distances([s], [t], True)[0]
            if d <= most(s) and (s in t or len(grams(s) & grams(t)) >= len(s) - 3 - 2 * budget(s)):
                want[t, s] = d
        got = matching.fuzzy_pairs(frames[0], long, errors, True).collect()
        assert {(r.text, r.serial): r.distance for r in got} == want and len(got) == len(want)


def test_merged_distances_equal_the_table():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("0123456789ABKX") for _ in range(n))
    for longest in (16, 30, 64):
        texts, serials = [word(rng.randrange(1, 20)) for _ in range(60)], [word(rng.randrange(1, longest + 1)) for _ in range(60)]
        words, known = fuzzy.Words(pa.array(texts)), fuzzy.Words(pa.array(serials))
        t, s = map(np.ravel, np.meshgrid(range(60), range(60)))
        merge = lambda x: "".join(S.COARSE[c] for c in x)
        for anywhere in (False, True):
            got = fuzzy.merged_distances(words.columns(np.arange(60)), words.sizes, t, fuzzy.Patterns(known), s, anywhere)
            plain = [edits(merge(serials[j]), merge(texts[i]), anywhere) for i, j in zip(t, s, strict=True)]
            assert got.tolist() == plain


def edits(a, b, anywhere):
    row = [0] * (len(b) + 1) if anywhere else list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if anywhere else row[-1]


def test_cuts_are_the_cheapest():
    costs = {"A": 0.5, "B": 0.1, "C": 0.4}, {a + b: {"A": 0.5, "B": 0.1, "C": 0.4}[b] for a in "ABC" for b in "ABC"}
    share = lambda p: costs[0][p[0]] * __import__("math").prod(costs[1][p[i : i + 2]] for i in range(len(p) - 1))
    texts = ["AABACAB", "BBBAAAA", "CCCCCCC", "ACABABA"]
    for text, pieces in zip(texts, fuzzy.cheapest_cuts(texts, 3, costs), strict=True):
        assert "".join(pieces) == text
        sizes = fuzzy.sizes_of_pieces(7, 3)
        every = [(text[:i], text[i:j], text[j:]) for i in range(1, 7) for j in range(i + 1, 7)]
        best = min(sum(map(share, x)) for x in every if all(len(p) in sizes for p in x))
        assert abs(sum(map(share, pieces)) - best) < 1e-12


def test_stages_decide_the_same_as_one(spark, monkeypatch):
    rng = random.Random(5)
    serials = sorted({"".join(rng.choice("0123") for _ in range(rng.choice([6, 8, 9, 12]))) for _ in range(150)})  # so dense that early stages decide
    texts = ["".join(rng.choice("0123") for _ in range(rng.randrange(5, 13))) for _ in range(80)]
    rows, e = readings(spark, [(i // 2, i % 2, t, 0.9) for i, t in enumerate(texts)]), entries(spark, serials)
    named = spark.createDataFrame([(t,) for t in texts], "text string")
    both = lambda: (sorted(map(tuple, matching.search(rows, e).collect())), sorted(map(str, matching.resolve(named, e).collect())))
    one = both()
    monkeypatch.setattr(matching, "DENSE", 1)
    assert matching.stages(matching.budgets(e)) == [2, 3, 4] and both() == one


def test_no_inventory(spark):
    none = entries(spark, ["X"]).limit(0)
    texts = spark.createDataFrame([("19S206055",), ("",)], "text string")
    assert {r.text: (r.status, r.serial) for r in matching.resolve(texts, none).collect()} == {"19S206055": ("no_catalog", "19S206055"), "": ("not_attempted", None)}
    rows = readings(spark, [(1, 0, "19S206055", 0.9), (2, 0, "SERIE:", 0.9)])
    assert {r.image_id: r.status for r in matching.search(rows, none).collect()} == {1: "no_catalog", 2: "not_attempted"}


def test_retry_counts_only_if_it_matches(spark):
    e = entries(spark, ["19S206055", "K5738060"])
    pattern = spark.createDataFrame([(8, 9, None)], "min_length int, max_length int, mask string")
    first = readings(spark, [(1, 0, "19S206055", 0.9), (2, 0, "PW200", 0.9), (3, 0, "99999999", 0.9)])
    retry = readings(spark, [(1, 0, "K5738060", 0.9), (2, 0, "K5738060", 0.8), (3, 0, "77777777", 0.9), (4, 0, "PW100", 0.9)])
    got = {r.image_id: (r.status, r.serial, r.attempt) for r in matching.identify_twice(first, retry, e, pattern).collect()}
    assert got == {1: ("matched", "19S206055", 1), 2: ("matched", "K5738060", 2), 3: ("not_found", None, 1), 4: ("not_found", None, 2)}


def test_usable_readings(spark):
    rows = readings(spark, [(1, 0, "19S206055", 0.3), (2, 0, " pw-200 ", 0.9), (3, 0, "  ", 0.9), (4, 0, None, 0.9), (5, 0, "19S206055", 0.29)])
    assert [r.image_id for r in consensus.usable(rows, ("PW200", "")).collect()] == [1]


def hull(some):
    return {"x1": min(b["x1"] for b in some), "y1": min(b["y1"] for b in some), "x2": max(b["x2"] for b in some), "y2": max(b["y2"] for b in some)}


def continues(some, b):
    """The gap from a chain to a box that may follow it, in the order of rules: near enough, and at the same height."""
    h = hull(some)
    scale = max(h["y2"] - h["y1"], b["y2"] - b["y1"], 1.0)
    gap, off = b["x1"] - h["x2"], abs((b["y1"] + b["y2"]) - (h["y1"] + h["y2"])) / 2
    return gap if -0.5 * scale <= gap <= 2 * scale and off <= 0.6 * scale else None


def beside(some, b):
    """Whether a box belongs to a line that begins with ``some[0]``."""
    first, h = some[0], hull(some)
    high, other = first["y2"] - first["y1"], b["y2"] - b["y1"]
    common = min(first["y2"], b["y2"]) - max(first["y1"], b["y1"])
    return common >= 0.45 * max(min(high, other), 1.0) and max(b["x1"] - h["x2"], h["x1"] - b["x2"]) <= 3 * max(high, other, 1.0)


def members(rows, lines):
    by_text = {b["text"]: b for b in rows}
    return [[by_text[t] for t in line["text"].split()] for line in lines]


def assert_chains(rows, lines):
    """Each next box is the nearest free one that fits, a chain ends where nothing fits, and boxes left alone could start no chain."""
    order = lambda b: (b["x1"], b["ord"])
    found = sorted(members(rows, lines), key=lambda c: order(c[0]))
    taken = [b["ord"] for c in found for b in c]
    assert len(taken) == len(set(taken))
    for b in rows:
        if b["ord"] not in taken:
            found.append([b])
    found.sort(key=lambda c: order(c[0]))
    gone = set()
    for chain in found:
        for k in range(1, 5):
            free = [b for b in rows if b["ord"] not in gone and b["ord"] not in [x["ord"] for x in chain[:k]]]
            fits = sorted((continues(chain[:k], b), order(b)) for b in free if continues(chain[:k], b) is not None)
            if k < len(chain):
                assert fits[0] == (continues(chain[:k], chain[k]), order(chain[k]))
            else:
                assert len(chain) == 4 or not fits
                break
        gone |= {b["ord"] for b in chain} if len(chain) > 1 else set()


def assert_lines(rows, lines):
    """Every box is in one line, the first of those begun before it that it fits; the first box of a line fits none of them."""
    order = lambda b: (b["y1"], b["x1"], b["ord"])
    found = sorted((sorted(x, key=order) for x in members(rows, lines)), key=lambda x: order(x[0]))
    assert sorted(b["ord"] for x in found for b in x) == sorted(b["ord"] for b in rows)
    for n, line in enumerate(found):
        for b in line:
            before = [[x for x in other if order(x) < order(b)] for other in found]
            assert not any(x and beside(x, b) for x in before[:n])
            assert b is line[0] or beside(before[n], b)


def answers(df):
    got = {}
    for r in df.orderBy("image_id", "line_no").collect():
        got.setdefault(r.image_id, []).append(r.asDict())
    return got


SHAPE = "image_id long, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def assert_both(df, rows):
    """The two queries against their defining properties, on every image."""
    chains, lines = answers(boxes.join_split(df)), answers(boxes.merge_fragments(df))
    for i, x in rows.items():
        assert_chains(x, chains.get(i, []))
        named = boxes._one_image(x, boxes.fragments, ("y1", "x1", "ord"), True)
        assert_lines(x, named)
        assert [{**{c: line[c] for c in boxes.SIDES}, "n": line["n_boxes"]} for line in lines[i]] == [{**{c: line[c] for c in boxes.SIDES}, "n": line["n_boxes"]} for line in named]
        for line, own in zip(lines[i], members(x, named), strict=True):
            assert line["confidence"] == round(max(b["confidence"] for b in own), 4) and {c: line[c] for c in boxes.SIDES} == hull(own)
        for line, own in zip(chains.get(i, []), members(x, chains.get(i, [])), strict=True):
            assert line["confidence"] == min(b["confidence"] for b in own) and {c: line[c] for c in boxes.SIDES} == hull(own) and line["n_boxes"] == len(own)


def test_lines_of_boxes_have_their_properties(spark):
    rng = random.Random(4)
    images = {}
    for i in range(120):
        images[i] = []
        for k in range(rng.randint(1, 14)):
            x, y = rng.randint(0, 300), rng.randint(0, 80)
            images[i].append(
                {
                    "ord": k, "text": f"t{k}", "confidence": rng.randint(50, 99) / 100, "x1": float(x), "y1": float(y),
                    "x2": float(x + rng.randint(3, 60)), "y2": float(y + rng.randint(3, 30))
                }
            )
    df = spark.createDataFrame([(i, b["ord"], b["text"], b["confidence"], *[b[c] for c in boxes.SIDES]) for i, x in images.items() for b in x], SHAPE)
    assert_both(df, images)
    assert boxes.join_split(df.limit(0)).count() == 0


def test_literal_lines_of_boxes():
    box = lambda k, x1, y1, x2, y2: {"ord": k, "text": f"t{k}", "confidence": 0.5, "x1": x1, "y1": y1, "x2": x2, "y2": y2}
    said = lambda rows: [line["text"] for line in boxes.joined_rows(rows)]
    assert said([box(0, 0.0, 0.0, 10.0, 10.0), box(1, 12.0, 0.0, 20.0, 10.0)]) == ["t0 t1"]
    assert said([box(0, 0.0, 0.0, 10.0, 10.0), box(1, 31.0, 0.0, 40.0, 10.0)]) == []  # a gap of more than two heights
    assert said([box(0, 0.0, 0.0, 10.0, 10.0), box(1, 12.0, 7.0, 20.0, 17.0)]) == []  # centres 0.7 heights apart
    assert said([box(k, 12.0 * k, 0.0, 12.0 * k + 10, 10.0) for k in range(6)]) == ["t0 t1 t2 t3", "t4 t5"]
    count = lambda rows: [line["n_boxes"] for line in boxes.merged_rows(rows)]
    assert count([box(0, 0.0, 0.0, 10.0, 10.0), box(1, 39.0, 4.0, 50.0, 14.0)]) == [2]
    assert count([box(0, 0.0, 0.0, 10.0, 10.0), box(1, 41.0, 4.0, 50.0, 14.0)]) == [1, 1]  # more than three heights away
    assert count([box(0, 0.0, 0.0, 10.0, 10.0), box(1, 12.0, 6.0, 20.0, 16.0)]) == [1, 1]  # 4 of 10 in common


def test_box_fixture_queries_have_their_properties(spark):
    rows = {}
    for r in frame(spark, SF, "boxes").collect():
        rows.setdefault(r.image_id, []).append({"ord": r.box_ord, "text": f"T{r.box_ord}", "confidence": r.confidence, **{c: r[c] for c in boxes.SIDES}})
    chains = answers(QUERIES["g1_join"](spark, SF))
    for i, x in rows.items():
        assert_chains(x, chains.get(i, []))
        assert_lines(x, boxes._one_image(x, boxes.fragments, ("y1", "x1", "ord"), True))
    merged = answers(QUERIES["g2_merge"](spark, SF))
    assert {i: [line["n_boxes"] for line in x] for i, x in merged.items()} == {i: [line["n_boxes"] for line in boxes.merged_rows(x)] for i, x in rows.items()}


def test_attributes_of_any_record(spark):
    from pathlib import Path

    d = Path(tempfile.mkdtemp(prefix="json-", dir="/tmp"))
    (d / "a.json").write_text('{"cylinders": [{"serial": "19S-1", "gas": {"code": "O2"}, "litres": 40.5}, 7, {"serial": "19S1", "owner": "x"}]}')
    (d / "b.json").write_text('[{"serial": "22S2", "checked": false}]')
    (d / "c.json").write_text('{"cylinders": [')
    rows = tables.read_inventory_json(spark, str(d), "serial string").withColumn("asset_id", F.col("ord").cast("string"))
    found = inventory.attributes(inventory.entries(rows, ("attributes",)))
    assert {(r.serial, r.name, r.value) for r in found.collect()} == {
        ("19S1", "serial", "19S-1"), ("19S1", "gas", '{"code":"O2"}'), ("19S1", "litres", "40.5"), ("22S2", "serial", "22S2"), ("22S2", "checked", "false"),
    }


def test_proposals_of_another_shape_are_marked(spark):
    e, inv = entries(spark, ["19S206055"] * 1 + [f"20S{k:06d}" for k in range(9)]), spark.createDataFrame([(f"20S{k:06d}",) for k in range(9)], "serial string")
    rows = readings(spark, [(1, 0, "77T999999", 0.9), (2, 0, "7XT9999X9", 0.9), (3, 0, "I9S2O6O55", 0.9)])
    got = {r.image_id: (r.status, r.read_text, r.reason) for r in matching.identify(rows, e, inventory.pattern(inv)).collect()}
    assert got[1] == ("not_found", "77T999999", "serial_not_in_catalog")
    assert got[2][0] == "not_found" and got[2][2] == "serial_not_in_catalog+serial_format_invalid"
    assert got[3][0] == "matched"


def test_positions_and_medians(spark):
    rng = random.Random(6)
    for values in (
        [3.0], [1.0, 2.0], [rng.choice([0.0, 1e9, rng.random()]) for _ in range(301)], [5.0] * 40,
        [rng.random() for _ in range(500)] + [1e12], [-1.7e308, 1.7e308, *[rng.random() for _ in range(40)]]
    ):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        import statistics

        assert datasets.median_of(df, "v", "m").first().m == statistics.median(values)
        p = evaluate.latency(df, "v").first()
        assert p.n == len(values) and p.p95 == (round(sorted(values)[int(0.95 * len(values))], 1) if len(values) >= 20 else None)


def test_remaining_sources(spark):
    from pathlib import Path

    d = Path(tempfile.mkdtemp(prefix="src-", dir="/tmp"))
    truth = spark.createDataFrame([("a.jpg", "S1"), ("b.jpg", "S2")], "image string, serial string")
    (d / "list.txt").write_text("a.jpg\n\n  b.jpg \n")
    assert [r.image for r in tables.read_listing(spark, str(d / "list.txt")).collect()] == ["a.jpg", "b.jpg"]
    assert tables.read_listing(spark, str(d / "none.txt"), truth).count() == 2
    for name in ("A1/1.Frontal/x.JPG", "A1/y.png", "z.jpeg", "A2/1.Frontal/notes.txt"):
        (d / "assets" / name).parent.mkdir(parents=True, exist_ok=True)
        (d / "assets" / name).write_bytes(b"1")
    listed = {(r.grp, r.condition) for r in tables.list_assets(spark, str(d / "assets"), digest=True).collect()}
    assert listed == {("A1", "1.Frontal"), ("A1", "(raíz)"), ("(raíz)", "(raíz)")}
    live = spark.createDataFrame([(1, "19s-1"), (2, "19S1"), (3, None)], "id long, numero_serie string")
    assert [r.serial for r in tables.existing_keys(live).collect()] == ["19S1"]
    inv = spark.createDataFrame([("A1", "19S1")], "asset_id string, serial string")
    tables.write_truth(tables.list_assets(spark, str(d / "assets")), inv, str(d / "truth"))
    assert {(r.image, r.serial) for r in tables.read_truth_csv(spark, str(d / "truth")).collect()} == {("A1/1.Frontal/x.JPG", "19S1"), ("A1/y.png", "19S1")}
    tables.write_split_listing(spark.createDataFrame([("a.jpg", "train"), ("b.jpg", "val")], "image string, split string"), str(d / "split"))
    assert [r.value for r in spark.read.text(str(d / "split" / "split=val")).collect()] == ["b.jpg"]
    log = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (2, "2026-02-01 10:00:00"), (3, "2026-02-02 10:00:00")], "n long, ts string").withColumn("ts", F.to_timestamp("ts"))
    tables.append_log(log.where("n < 3"), str(d / "log"))
    tables.append_log(log.where("n = 3"), str(d / "log"))
    (d / "log" / "day=other").mkdir()
    assert tables.purge_log(spark, str(d / "log"), "2026-02-03", 10) == ["2026-01-01"] and (d / "log" / "day=other").exists()
    assert sorted(r.n for r in spark.read.option("basePath", str(d / "log")).json(str(d / "log" / "day=2026*")).collect()) == [2, 3]
    tables.write_report(spark.createDataFrame([("r", "m", "d", 1.0)], "report string, metric string, dims string, value double"), str(d / "report"))
    assert spark.read.json(str(d / "report")).first().value == 1.0
    tables.write_manifest(spark.createDataFrame([("train", "a.jpg", "BA"), ("val", "b.jpg", "CA")], "split string, image string, text string"), str(d / "manifest"))
    assert spark.read.text(str(d / "manifest" / "alphabet")).count() == 3 and spark.read.option("sep", "\t").csv(str(d / "manifest" / "lines" / "split=train")).first()[1] == "BA"


COMPARED = [
    "k1_k3_k9_serials", "a1_entries", "a2_consensus", "a12_outcomes", "a19_sweep", "j2_containing", "j15_match_boxes", "w5_top_up", "j3_resolve", "j4_search", "a3_support",
    "d1_decisions", "f_stated", "r1_r4_records", "r3_form", "w4_split", "k6_corrections", "j14_located", "a18_precision", "a13_crops", "u5_retry", "n6_n13_dates", "a17_latency",
    "a1_attributes", "a2_masked", "k7_fragments", "n1_n14_words",
]


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = c.sql(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(
        map(
            str,
            d[cols].astype(object).where(d[cols].notna(), None).map(
                lambda v: round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else v
            ).itertuples(index=False, name=None)
        )
    )
    assert key(got) == key(want)


def test_entry_survives_without_corpus():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['lodestamp.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'j4_search' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_nearest_pairs_of_a_dense_inventory(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("0158SK") for _ in range(n))
    serials = sorted({word(rng.choice([6, 8, 9, 17])) for _ in range(200)})
    texts = sorted({word(rng.choice([5, 7, 8, 9, 11, 30])) for _ in range(40)})
    known = matching.budgets(spark.createDataFrame([(s,) for s in serials], "serial string"))
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    limit = lambda x: x["distance"] <= x["budget"]
    for tile in (8192, 7):
        monkeypatch.setattr(fuzzy, "TILE_TEXTS", tile)
        monkeypatch.setattr(fuzzy, "TILE_SERIALS", tile)
        every = matching.fuzzy_pairs(asked, known, 3, True).collect()
        few = matching.fuzzy_pairs(asked, known, 3, True, 5)
        got = {r.text: [(x.distance, x.serial) for x in r.c if x.distance <= 3] for r in matching.nearest(few, limit).collect()}
        got = {t: c for t, c in got.items() if c}
        want = {}
        for t in texts:
            c = sorted((r.distance, r.serial, r.budget) for r in every if r.text == t)
            if c:
                near = [x for x in c if x[0] <= x[2]][:2]
                want[t] = [x[:2] for x in c[:5] + [x for x in near if x not in c[:5]]]
        assert got == want and len(every) > 5 * len(texts)


def test_a_serial_within_errors_shares_a_sequence():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("01234") for _ in range(n))
    serials, texts = [word(rng.choice([6, 8])) for _ in range(80)], [word(rng.randrange(4, 12)) for _ in range(80)]
    stored = pa.RecordBatch.from_arrays([pa.array(serials), pa.array(np.full(80, 2, np.int32))], ["serial", "rules"])
    asked = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for anywhere in (False, True):
        own, met = {}, {}
        for held, batches in ((own, fuzzy.keys_of_serials([stored])), (met, fuzzy.keys_of_texts([(6, 2), (8, 2)], anywhere)([asked]))):
            for batch in batches:
                for word_, key in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    held.setdefault(word_, set()).add(key)
        near = [(s, t) for s, t in itertools.product(serials, texts) if edits(s, t, anywhere) <= 2]
        assert near and all(own[s] & met.get(t, set()) for s, t in near)


def test_a_stage_lists_what_is_half_an_error_beyond(spark):
    known = matching.budgets(spark.createDataFrame([("19S206055",), ("29S206055",)], "serial string"))
    asked = spark.createDataFrame([("195207055",)], "text string")
    got = matching.fuzzy_pairs(asked, known, 1, False, 5).select("serial", "distance").distinct().collect()
    assert {(r.serial, r.distance) for r in got} == {("19S206055", 1.5)}
    assert matching.fuzzy_pairs(asked, known, 1, False).isEmpty()


def test_keys_of_the_similarity_join_travel_as_lists(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array(["19S206055", "19S206056", "K5738060", "1"])], ["text"])
    keys_of = lambda batch: fuzzy.text_keys(batch, [(9, 2), (8, 2)], True)
    plain = sorted((int(a), int(k)) for at, key in keys_of(texts) for a, k in zip(at, key, strict=True))
    none = np.zeros(0, np.int64)
    rows = pa.Table.from_batches(list(fuzzy.packed(keys_of, ["text"], 3, none, none, none)([texts])))
    assert rows.num_rows <= 3 < len(plain) and len(set(rows["bucket"].to_pylist())) == rows.num_rows
    (held,), at, key = fuzzy.unpacked(rows, ["text"])
    names = texts.column(0).to_pylist()
    assert sorted((names.index(held[int(a)].as_py()), int(k)) for a, k in zip(at, key, strict=True)) == plain
    assert all(len(set(x)) == len(x) for x in rows["text"].to_pylist())
    # Two sides of heavy cells: every text meets every serial in one tile, once.
    cells = np.unique([k & (fuzzy.CELLS - 1) for _, k in plain])
    three, two = np.full(len(cells), 3), np.full(len(cells), 2)
    sides = [pa.Table.from_batches(list(fuzzy.packed(keys_of, [n], 5, cells, *tiles)([texts]))) for n, tiles in (("text", (three, two)), ("serial", (two, three)))]
    sides = [(t["bucket"].to_numpy().repeat([len(x) for x in t["key"].to_pylist()]), *fuzzy.unpacked(t, [n])) for t, n in zip(sides, ("text", "serial"), strict=True)]
    met = sorted((a.as_py(), b.as_py()) for b1, (h1,), a1, k1 in sides[:1] for b2, (h2,), a2, k2 in sides[1:] for i in range(len(k1)) for j in np.flatnonzero((k2 == k1[i]) & (b2 == b1[i])) for a, b in [(h1[int(a1[i])], h2[int(a2[j])])])
    by_key = {}
    for a, k in plain:
        by_key.setdefault(k, []).append(names[a])
    assert met == sorted((a, b) for c in by_key.values() for a in c for b in c)


def test_average_precision_repeats_no_rows_by_level(spark):
    rows = [(1, 0, k, k % 3, 0.9 - 0.1 * (k % 5), 0.45 + 0.06 * k) for k in range(9)]
    matched = spark.createDataFrame(rows, "image_id long, class_id int, p_ord long, t_ord long, confidence double, iou double")
    truth = spark.createDataFrame([(1, 0, k) for k in range(3)], "image_id long, class_id int, box_ord long")
    got = boxes.average_precision(matched, truth)
    below = got._jdf.queryExecution().optimizedPlan().toString().split("Window [max(iou")
    assert len(below) > 1 and all("Generate" not in part.split("LogicalRDD")[0] for part in below[1:])
    areas = []
    for level in boxes.THRESHOLDS:
        hits, seen = [], set()
        for r in sorted(rows, key=lambda r: (-r[4], -r[5], r[2])):
            hits.append((r[4], r[5] >= level and r[3] not in seen))
            seen |= {r[3]} if r[5] >= level else set()
        steps = sorted({c for c, _ in hits}, reverse=True)
        precision = {c: sum(h for x, h in hits if x >= c) / sum(x >= c for x, _ in hits) for c in steps}
        areas.append(sum(sum(h for x, h in hits if x == c) / 3 * max(precision[x] for x in steps if x <= c) for c in steps))
    assert got.first().ap == round(areas[0], 4) and got.first().ap_50_95 == pytest.approx(sum(areas) / 10, abs=1e-4)


def test_statements_are_shuffled_once_by_image(spark):
    lines = spark.createDataFrame([(1, 1, 0.9, "PESO: 12 KG"), (1, 2, 0.8, "COLOR: verde")], "image_id long, line_ord int, confidence double, text string")
    found = fields.wide(fields.stated(lines))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == 1
    assert found.first().peso is not None and found.first().color is not None


def test_a_plain_stage_adds_what_needs_no_confusion(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("05689SGBOX") for _ in range(n))
    serials = sorted({word(rng.choice([6, 8, 9, 17])) for _ in range(150)}) + ["9Ñ9999999"]
    texts = sorted({word(rng.choice([5, 7, 8, 9, 11, 30])) for _ in range(40)}) + ["9Ü9999999"]
    known = matching.budgets(spark.createDataFrame([(s,) for s in serials], "serial string"))
    asked = spark.createDataFrame([(t,) for t in texts], "text string")
    for anywhere, errors in ((True, 2), (True, 3), (False, 2)):
        every = matching.fuzzy_pairs(asked, known, 9, anywhere).where("distance <= %d" % errors).collect()
        merged = matching.fuzzy_pairs(asked, known, errors - 1, anywhere, 500, beyond=1.0).collect()
        plain = matching.fuzzy_pairs(asked, known, errors, anywhere, 500, True).collect()
        want = {(r.text, r.serial): r.distance for r in every}
        assert {(r.text, r.serial): r.distance for r in (*merged, *plain) if r.distance <= errors} == want
        early = {(r.text, r.serial) for r in merged}
        assert (plain or not anywhere) and all((r.text, r.serial) not in early for r in plain)


def test_plain_stages_follow_merged_ones(spark, monkeypatch):
    known = matching.budgets(spark.createDataFrame([("123456789",), ("987654",)], "serial string"))
    assert matching.half_steps(known) == [(3, False, float("inf"))]
    monkeypatch.setattr(matching, "DENSE", 0.05)
    assert matching.half_steps(known) == [(1, False, 1.5), (2, True, 2.0), (2, False, 2.5), (3, True, float("inf"))]


def test_issues_are_computed_once(spark):
    raw = spark.createDataFrame([("a", "19S206055", "x"), ("b", "19S", "x"), ("c", None, None)], "name string, numero_serie string, peso string")
    log = inventory.issue_log(fields.normalised_record(raw))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("short_serial") == 1
    assert {r.issue: r.n for r in log.collect()} == {"peso": 2, "short_serial": 1, "numero_serie": 1}


def test_merged_lines_are_built_from_columns():
    import sys

    import pyarrow as pa

    kind = pa.list_(pa.struct([("ord", pa.int64()), ("text", pa.string()), ("confidence", pa.float64()), *[(c, pa.float64()) for c in boxes.SIDES]]))
    row = lambda k: {"ord": k, "text": "", "confidence": 0.5 + k / 100, "x1": 0.0, "y1": 100.0 * k, "x2": 50.0, "y2": 100.0 * k + 20}
    lists = pa.array([[row(k) for k in range(4)]] * 500 + [[]], kind)
    calls = [0]

    def count(_frame, event, _arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        lines = boxes.lines_of(lists, boxes.fragments, ("y1", "x1", "ord"), False)
    finally:
        sys.setprofile(None)
    assert len(lines.flatten()) == 2000 and lines[500].as_py() == [] and calls[0] < 2 * 2000
    assert lines[7].as_py()[1] == {"text": None, "confidence": 0.51, "x1": 0.0, "y1": 100.0, "x2": 50.0, "y2": 120.0, "n_boxes": 1}


def test_answers_without_lists_are_the_same(spark, monkeypatch):
    """Who shows no candidates gets the same answers, from fewer errors."""
    rng = random.Random(4)
    some = lambda alphabet, sizes: "".join(rng.choice(alphabet) for _ in range(rng.choice(sizes)))
    serials = sorted({some("01238", [6, 8, 9, 12]) for _ in range(60)} | {some("0123456789", [9, 12]) for _ in range(60)} | {"0123", "K1", "97A53941", "97A53942", "X9462975377W"})
    worn = [x[:k] + rng.choice(["", "O", "7", x[k]]) + x[k + 1 :] for x in serials for k in (rng.randrange(len(x)),)]
    texts = [*serials[::4], *worn, *(some("01238OB", [5, 6, 8, 9, 10, 13]) for _ in range(60)), "97A53943", "X9462975377W", "0123 81", "", "PW 200"]
    monkeypatch.setattr(matching, "DENSE", 10)
    e, asked, real = entries(spark, serials), [], matching.fuzzy_pairs
    monkeypatch.setattr(matching, "fuzzy_pairs", lambda t, k, errors, *rest: asked.append(errors) or real(t, k, errors, *rest))
    said = readings(spark, [(i, v, text if v else text[:-1], 0.9) for i, text in enumerate(texts) for v in (0, 1)])
    known = sorted({(x,) for x in texts if x.isalnum()})
    resolved, found = [], []
    for listed in (matching.LISTED, 0):
        asked.clear()
        rows = matching.resolve(spark.createDataFrame(known, "text string"), e, listed).where("status <> 'not_found'").select("text", "status", "serial", "distance", "score").collect()
        resolved.append((sorted(map(str, rows)), max(asked)))
        asked.clear()
        rows = matching.search(said, e, listed).select("image_id", "status", "serial", "distance").collect()
        found.append((sorted(map(str, rows)), max(asked)))
    assert resolved[0][0] == resolved[1][0] and found[0][0] == found[1][0]
    assert all(any(s in row for row in rows) for s in ("matched", "ambiguous") for rows, _ in (found[0], resolved[0]))
    assert resolved[1][1] == 2 < resolved[0][1] and found[1][1] < found[0][1]


def test_consensus_is_asked_only_about_open_images(spark, monkeypatch):
    """images that the search matches need no consensus, and a text without a break is looked at once."""
    asked, real = [], matching.consensus
    monkeypatch.setattr(matching, "consensus", lambda rows, pattern: asked.append(sorted(r.image_id for r in rows.select("image_id").distinct().collect())) or real(rows, pattern))
    e, pattern = entries(spark, ["19S206055", "12345678"]), spark.createDataFrame([(7, 9, None)], "min_length int, max_length int, mask string")
    rows = readings(spark, [(1, 0, "19S206055", 0.9), (2, 0, "99887766", 0.9), (3, 0, "12345678", 0.9)])
    got = {r.image_id: r.stage for r in matching.identify(rows, e, pattern).collect()}
    assert asked == [[2]] and got == {1: "search", 2: "proposal", 3: "search"}
    found = consensus.candidates(readings(spark, [(1, 0, "AB12345", 0.9), (2, 0, "AB12345 6", 0.9)]), pattern)
    assert sorted((r.image_id, r.text, r.frag_ord) for r in found.collect()) == [(1, "AB12345", 0), (2, "AB12345", 1), (2, "AB123456", 0)]


def test_boxes_are_matched_in_tasks_of_bounded_size(spark, monkeypatch):
    """what a task sorts doesn't grow with the tables."""
    b = frame(spark, SF, "boxes").select("image_id", "box_ord", "class_id", "confidence", "x1", "y1", "x2", "y2")
    want = sorted(map(str, boxes.match_boxes(b, b).collect()))
    monkeypatch.setattr(boxes, "ROWS_IN_TASK", b.count() // 20)
    got = boxes.match_boxes(b, b)
    rows = [r.n for r in got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sorted(map(str, got.collect())) == want and len(rows) >= 15 and max(rows) < len(want) // 5


def test_pairs_are_weighed_in_portions(monkeypatch):
    """What a task of the similarity join holds doesn't grow with the pairs that it finds."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("015") for _ in range(6))
    texts, serials = pa.array(sorted({word() for _ in range(300)})), pa.array(sorted({word() for _ in range(300)}))
    sides = [[np.concatenate(x) for x in zip(*keys, strict=True)] for keys in (
        fuzzy.text_keys(pa.RecordBatch.from_arrays([texts], ["text"]), [(6, 1)], True),
        fuzzy.serial_keys(pa.RecordBatch.from_arrays([serials, pa.array(np.full(len(serials), 1, np.int32))], ["serial", "rules"])),
    )]
    ones = np.ones(len(serials), np.int64)
    seen = []

    def found():
        seen.clear()
        kept = lambda t, s, d: seen.append(len(t)) or np.arange(len(t))
        t, s, d = fuzzy.close(texts, *sides[0], serials, *sides[1], ones, ones, True, False, kept)
        return set(zip(t.tolist(), s.tolist(), d.tolist(), strict=True))

    whole = found()
    assert len(seen) == 1 and len(whole) > 1000
    monkeypatch.setattr(fuzzy, "PAIRS_HELD", 100)
    monkeypatch.setattr(fuzzy, "PAIRS_AT_ONCE", 200)
    assert found() == whole and len(seen) > 10 and max(seen) < 500


def test_lists_leave_the_join_once_for_a_text(spark):
    """Lists of a text are merged before they become rows."""
    known = matching.budgets(spark.createDataFrame([("19S20605%d" % k,) for k in range(8)], "serial string"))
    asked = spark.createDataFrame([("19S206051",), ("X19S206052",)], "text string")
    rows = matching.fuzzy_pairs(asked, known, 2, True, 5, False, 0.5, True).collect()
    assert {r.text: [(x.serial, x.distance) for x in r.c[:2]] for r in rows} == {"19S206051": [("19S206051", 0.0), ("19S206050", 1.0)], "X19S206052": [("19S206052", 0.0), ("19S206050", 1.0)]}
    assert len(rows) == 2 and all(len(r.c) == 5 for r in rows)


def test_rates_compute_judged_rows_once(spark):
    """totals come from the counts."""
    rows = spark.createDataFrame([("a", "correct"), ("a", "no_truth"), ("a", "correct"), ("a", "silent_error"), ("b", "correct"), ("c", "no_truth")], "condition string, outcome string")
    rates = evaluate.outcome_rates(rows.where("condition <> 'z'"))
    assert rates._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 1
    got = {(r.condition, r.outcome): (r.n, r.rate) for r in rates.collect()}
    assert got[None, "correct"] == (3, 0.75) and got["a", "correct"] == (2, 0.6667) and got["b", "correct"] == (1, 1.0)
    assert got["a", "no_truth"] == (1, None) and got["c", "no_truth"] == (1, None) and len(got) == 8
