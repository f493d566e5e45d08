"""All queries of the identification engine by operator, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestamp.functions import serial as S
from lodestamp.functions import text as T
from lodestamp.operators import boxes, consensus, datasets, evaluate, fields, inventory, matching
from lodestamp.plans import oracles
from lodestamp.sources.fixtures import frame
from lodestamp.sources.lineage import materialize

W, H = 2000.0, 400.0  # the frame of the box tables


def on(table: str):
    """A query over one derived table."""

    def wrap(f):
        return lambda spark, sf_dir: f(frame(spark, sf_dir, table))

    return wrap


def both(*tables: str):
    def wrap(f):
        return lambda spark, sf_dir: f(*[frame(spark, sf_dir, t) for t in tables])

    return wrap


def values(df: DataFrame) -> DataFrame:
    """field_lines with the part behind the label."""
    return df.withColumn("value", F.trim(F.get(F.split("text", "[:=]", 2), F.lit(1))))


def resolved_once(rows: DataFrame, text: str, resolve) -> DataFrame:
    """``rows`` with what ``resolve`` makes of their different texts (a column ``t``, cleaned), each of which is looked at once. The text itself goes."""
    said = materialize(rows.select(F.col(text).alias("__text")).distinct())
    said = materialize(resolve(said.select("__text", T.clean_text(F.col("__text")).alias("t"))))
    return rows.join(said, F.col(text).eqNullSafe(F.col("__text"))).drop(text, "__text")


def measured(df: DataFrame) -> DataFrame:
    v = F.col("t")
    kinds = [
        T.number(v).alias("number"), T.weight_kg(v, True).alias("kg"), T.litres(v, True).alias("litres"),
        T.cubic_metres(v, True).alias("m3"), T.length_cm(v, T.HEIGHT_CM, True).alias("h")
    ]
    rows = resolved_once(df.select("image_id", "line_ord", "text"), "text", lambda said: said.select("__text", *kinds))
    return rows.select("image_id", "line_ord", "number", "kg", "litres", "m3", F.col("h.value").alias("height"), F.col("h.warning").alias("warning"))


def dated(df: DataFrame) -> DataFrame:
    v = F.col("t")
    dates = [T.month_year(v, True).alias("month_year"), T.year(v, True).alias("year"), T.hydrostatic(v, True).alias("h")]
    rows = resolved_once(df.select("image_id", "line_ord", "text"), "text", lambda said: said.select("__text", *dates))
    return rows.select("image_id", "line_ord", "month_year", "year", F.col("h.date").alias("ph_date"), F.col("h.period").alias("ph_period"))


def worded(df: DataFrame) -> DataFrame:
    v = F.col("t")
    words = [
        v.alias("clean"), T.is_absent(v, True).alias("absent"), T.gas(v, True).alias("gas"), T.colour(v, True).alias("colour"),
        T.country(v, False, True).alias("country"), T.country(v, True, True).alias("country_strict"), T.measure_unit(v, True).alias("unit")
    ]
    return resolved_once(values(df).select("image_id", "line_ord", "value"), "value", lambda said: said.select("__text", *words))


def serials(df: DataFrame) -> DataFrame:
    k = S.serial_charset(F.col("text"))
    return df.select(
        "image_id", "variant_ord", k.alias("serial"), S.is_marking(F.col("text")).alias("marking"), S.allowed_errors(k).alias("budget"),
        S.canonical(k).alias("canonical"), F.array_join(F.array_sort(S.bigrams(k)), " ").alias("bigrams"), S.shape(k).alias("shape")
    )


def distances(readings: DataFrame) -> DataFrame:
    k = S.serial_charset(F.col("text"))
    return readings.select(
        "image_id", "variant_ord", S.weighted_edit_distance(k, F.col("truth_serial")).alias("distance"),
        S.substring_distance(F.col("truth_serial"), k).alias("inside")
    )


def shapes(inv: DataFrame) -> DataFrame:
    return inv.groupBy(S.shape(F.col("serial")).alias("shape")).agg(F.count("*").alias("n"))


def entry_rows(inv: DataFrame) -> DataFrame:
    e = inventory.entries(inv)
    return e.select("serial", "ord", "brand", "size", F.array_join("assets", ",").alias("assets"), "is_duplicated", "is_too_short")


def same_shape_pattern(inv: DataFrame) -> DataFrame:
    """The pattern of every identifier as far as it has nine characters of one shape: others are cut or continued to that."""
    return inventory.pattern(inv.withColumn("serial", F.concat(F.lit("19S"), F.lpad(F.regexp_replace("serial", "[^0-9]", ""), 6, "0"))))


def corrections(readings: DataFrame) -> DataFrame:
    k = S.serial_charset(F.col("text"))
    fixed = S.corrected(k, F.lit("DDADDDDDD"))
    return readings.select(
        "image_id", "variant_ord", fixed["text"].alias("text"), F.array_join(fixed["notes"], ";").alias("notes"),
        S.matches_pattern(fixed["text"], F.lit("DDADDDDDD"), F.lit(9), F.lit(9)).alias("valid")
    )


def candidate_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return consensus.candidates(readings, inventory.pattern(inv)).select("image_id", "variant_ord", "text", "confidence", "raw", "line_ord", "frag_ord", "valid")


def consensus_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return consensus.consensus(readings, inventory.pattern(inv)).select("image_id", "text", "n_votes", "n_variants", "mean_confidence", "valid", "score", "rank")


def texts_of(readings: DataFrame) -> DataFrame:
    return readings.select(S.serial_charset(F.col("text")).alias("text")).distinct()


def exact_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return matching.exact(texts_of(readings), inventory.entries(inv))


def containing_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return matching.containing(texts_of(readings), inventory.entries(inv)).select("text", "serial")


def resolved_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return matching.resolve(texts_of(readings), inventory.entries(inv))


def searched_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return matching.search(readings, inventory.entries(inv))


def identified(readings: DataFrame, inv: DataFrame) -> DataFrame:
    return matching.identify(readings, inventory.entries(inv), inventory.pattern(inv))


def usable_rows(readings: DataFrame) -> DataFrame:
    return consensus.usable(readings, ("PW200", "PH 02/25"), 0.6).select("image_id", "variant_ord", "confidence")


def identified_twice(readings: DataFrame, inv: DataFrame) -> DataFrame:
    kept = readings.select("image_id", "variant_ord", "line_ord", "text", "confidence")
    return matching.identify_twice(kept.where("variant_ord = 0"), kept.where("variant_ord > 0"), inventory.entries(inv), inventory.pattern(inv))


def regions(b: DataFrame) -> DataFrame:
    return b.select("image_id", F.col("box_ord").alias("region_id"), F.when(F.col("class_id") == 1, "serial_text").otherwise("area").alias("label"), "confidence")


def variants(b: DataFrame) -> DataFrame:
    return boxes.best_variant(b.select("image_id", F.col("class_id").alias("region_id"), (F.col("box_ord") % 3).alias("variant_ord"), "confidence"))


def supported(readings: DataFrame, inv: DataFrame) -> DataFrame:
    e = inventory.entries(inv)
    return matching.support(matching.search(readings, e, 0).where("status = 'matched'"), readings)


def judged(readings: DataFrame, inv: DataFrame, truth: DataFrame, listed: int = 0) -> DataFrame:
    """D6 over the whole cascade; candidates only for who shows them."""
    e = inventory.entries(inv)
    return evaluate.judged(matching.identify(readings, e, inventory.pattern(inv), listed=listed), e, truth)


def cascade_outcomes(readings: DataFrame, inv: DataFrame, truth: DataFrame) -> DataFrame:
    """A12 over the whole cascade."""
    return evaluate.outcomes(judged(readings, inv, truth))


def cascade_rates(readings: DataFrame, inv: DataFrame, truth: DataFrame) -> DataFrame:
    """A12 over the whole cascade, with both codes for what can't be judged: some truths are missing, and so are the files of some images."""
    rows = judged(readings, inv, truth.withColumn("truth_serial", F.when(F.col("image_id") % 23 != 22, F.col("truth_serial"))))
    present = F.col("image_id") % 37 != 36
    return evaluate.outcome_rates(rows.withColumn("outcome", evaluate.outcome(F.col("serial"), F.col("truth_serial"), F.col("needs_review"), present)))


def swept(readings: DataFrame, inv: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate.sweep(evaluate.observations(judged(readings, inv, truth)))


def error_rates(readings: DataFrame) -> DataFrame:
    return readings.groupBy("condition").agg(F.round(F.avg(evaluate.error_rate(F.col("truth_serial"), S.serial_charset(F.col("text")))), 4).alias("cer"), F.count("*").alias("n"))


def enriched_rows(inv: DataFrame, live: DataFrame, static: DataFrame) -> DataFrame:
    rows = inv.select(F.col("ord").alias("image_id"), "serial", F.when(F.col("ord") % 3 == 0, F.col("brand")).alias("brand"), F.lit(None).cast("int").alias("size"))
    first = lambda df: df.groupBy("serial").agg(F.min_by("brand", "ord").alias("brand"), F.min_by("size", "ord").alias("size"))
    return evaluate.enriched(rows, first(static), first(live), ["brand", "size"])


def record_rows(lines: DataFrame) -> DataFrame:
    cards = lines.withColumn("line", F.col("text")).groupBy(F.col("image_id").alias("name")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    cards = cards.withColumn("text", F.concat(F.lit("SERIE: 19S"), F.lpad(F.col("name").cast("string"), 6, "0"), F.lit("\n"), F.col("text")))
    return fields.normalised_record(fields.described(cards))


def record_flat(lines: DataFrame) -> DataFrame:
    return record_rows(lines).withColumn("issues", F.array_join("issues", ","))


def form_rows(lines: DataFrame) -> DataFrame:
    return fields.app_form(record_rows(lines))


def lines_of(b: DataFrame) -> DataFrame:
    return b.select("image_id", F.col("box_ord").alias("ord"), F.concat(F.lit("T"), F.col("box_ord").cast("string")).alias("text"), "confidence", "x1", "y1", "x2", "y2")


def normalised_boxes(b: DataFrame) -> DataFrame:
    return b.select("image_id", "box_ord", *[F.round(c, 6).alias(n) for c, n in zip(boxes.normalised(W, H), ("cx", "cy", "w", "h"), strict=True)])


def predicted(b: DataFrame) -> DataFrame:
    return b.select("image_id", "box_ord", "class_id", "confidence", (F.col("x1") + F.col("shift")).alias("x1"), "y1", (F.col("x2") + F.col("shift")).alias("x2"), "y2")


def matched_boxes(b: DataFrame) -> DataFrame:
    return boxes.match_boxes(predicted(b), b).select("image_id", "class_id", "p_ord", "t_ord", F.round("iou", 6).alias("iou"), "is_hit")


def located(readings: DataFrame, truth: DataFrame) -> DataFrame:
    rows = readings.select(
        "image_id", (F.col("variant_ord") * 10 + F.col("line_ord")).alias("ord"), "text", "confidence", F.lit(100.0).alias("x1"),
        F.lit(10.0).alias("y1"), F.lit(300.0).alias("x2"), F.lit(50.0).alias("y2")
    )
    return boxes.locate_expected(rows, truth.select("image_id", "truth_serial"), 400.0).select("image_id", "ord", "text", "distance")


def weak(readings: DataFrame, truth: DataFrame) -> DataFrame:
    return datasets.weak_coverage(located(readings, truth), truth)


def topped(groups: DataFrame) -> DataFrame:
    start = groups.withColumn("split", F.when(F.col("group_id") % 10 == 0, "val").when(F.col("group_id") % 10 == 1, "test").otherwise("train"))
    return datasets.top_up(start, 60)


def image_rows(audit: DataFrame) -> DataFrame:
    return audit.select(F.col("asset").alias("image_id"), F.col("grp").alias("group_id"))


def pending(audit: DataFrame) -> DataFrame:
    rows = image_rows(audit)
    return datasets.unlabelled(rows, rows.where("image_id % 3 = 0"), rows.where("group_id in ('src0', 'src1', 'src2')"))


def options(readings: DataFrame, inv: DataFrame, truth: DataFrame) -> DataFrame:
    found = identified(readings, inv).select("image_id", "serial", "candidates")
    return evaluate.top_k(truth.join(found, "image_id", "left"))


def cropped(b: DataFrame) -> DataFrame:
    labels = b.select("image_id").distinct().withColumn("group_id", F.col("image_id") % 50)
    truth = labels.where("image_id % 5 <> 0").select("image_id", F.concat(F.lit("S"), F.col("image_id").cast("string")).alias("truth_serial"))
    splits = labels.select("group_id").distinct().where("group_id % 4 <> 3").withColumn("split", F.when(F.col("group_id") % 4 == 0, "val").otherwise("train"))
    return datasets.crops(labels, b.where("class_id = 1"), truth, labels.where("image_id % 11 <> 3"), splits)


def ready(audit: DataFrame) -> DataFrame:
    broken = F.coalesce("width", F.lit(0)) < 40
    return datasets.readiness(audit.where(~broken), audit.select("grp"), audit.where(broken))


def restored(b: DataFrame) -> DataFrame:
    shares = b.select("image_id", "box_ord", *boxes.normalised(W, H))
    return shares.select("image_id", "box_ord", *boxes.denormalised(W, H, 0.1))


def issues(lines: DataFrame) -> DataFrame:
    return inventory.issue_log(record_rows(lines))


def audited_work(a: DataFrame) -> DataFrame:
    return datasets.work_list(a.select(F.col("asset").alias("image_id"), F.col("grp").alias("group_id"), "condition"), 3, 40, "en")


def attribute_rows(inv: DataFrame) -> DataFrame:
    """Records whose attributes differ from one to the next, merged to entries."""
    own = F.struct("brand", F.when(F.col("ord") % 3 == 0, F.col("size")).alias("size"), F.when(F.col("ord") % 7 == 0, F.lit(True)).alias("checked"))
    return inventory.attributes(inventory.entries(inv.select("ord", "asset_id", "serial", F.parse_json(F.to_json(own)).alias("attributes")), ("attributes",)))


def masked(readings: DataFrame, inv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings, with characters that were taken for others, against an inventory of one shape."""
    same = lambda c: F.concat(F.lit("19S"), F.lpad(F.regexp_replace(c, "[^0-9]", ""), 6, "0"))
    worn = F.when(F.col("image_id") % 4 == 0, F.translate(same("text"), "01", "OI")).when(
        F.col("image_id") % 4 == 1, F.concat(F.lit("195"), F.substring(same("text"), 4, 6))
    ).when(F.col("image_id") % 4 == 2, F.concat(same("text"), F.lit("X"))).when(
        F.col("image_id") % 8 == 3, F.concat(F.substring(same("text"), 1, 8), F.lit("X"))
    ).otherwise(same("text"))
    return readings.withColumn("text", worn), inv.withColumn("serial", same("serial"))


def masked_rows(readings: DataFrame, inv: DataFrame) -> DataFrame:
    """K7 and A2 with a mask: corrections, and proposals that have the inventory's shape or not."""
    readings, inv = masked(readings, inv)
    return consensus_rows(readings, inv)


def fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7's fragments by the table function, joined laterally."""
    S.register(spark)
    readings = frame(spark, sf_dir, "readings")
    return spark.sql("SELECT r.image_id, r.variant_ord, r.line_ord, f.frag_ord, f.fragment, f.serial FROM {r} r, LATERAL serial_fragments(r.text) f", r=readings)


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both distances by their names in SQL."""
    S.register(spark)
    rows = frame(spark, sf_dir, "readings").withColumn("k", S.serial_charset(F.col("text")))
    return rows.select(
        "image_id", "variant_ord", F.expr("weighted_edit_distance(k, truth_serial)").alias("distance"),
        F.expr("fuzzy_substring_distance(truth_serial, k)").alias("inside")
    )


def set_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2, U3, U4 row by row: every key with the sets that it is in."""
    both = a.select("serial").distinct().withColumn("in_live", F.lit(True)).join(b.select("serial").distinct().withColumn("in_static", F.lit(True)), "serial", "full")
    here, there = F.coalesce("in_live", F.lit(False)), F.coalesce("in_static", F.lit(False))
    return both.select("serial", (here & there).alias("in_both"), (here & ~there).alias("pending"), (there & ~here).alias("stale"))


def assembled_rows(audit: DataFrame) -> DataFrame:
    rows = image_rows(audit).withColumn("split", F.when(F.col("image_id") % 10 < 7, "train").when(F.col("image_id") % 10 < 9, "val").otherwise("test"))
    return datasets.assembled(rows, rows.where("image_id % 3 = 0"))


def live_rows(inv: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    live = inv.select(
        F.col("ord").alias("id"), F.col("serial").alias("numero_serie"), F.col("brand").alias("marca"),
        F.concat(F.lit("0"), (1 + F.col("ord") % 9).cast("string"), F.lit("/2019")).alias("anio_fabricacion"),
        F.when(F.col("ord") % 2 == 0, "OXÍGENO").otherwise("ACETILENO").alias("tipo_gas"), F.lit("KG").alias("unidad_medida"),
        F.col("size").alias("peso"), none.alias("ancho_diametro"), none.alias("largo_altura"),
        F.when(F.col("ord") % 2 == 0, F.lit(40.5)).alias("litros"), F.lit(33.0).alias("contenido"), F.lit("verde").alias("color"),
        F.lit("CADA 10 AÑOS PH").alias("ph"), F.lit("CHINA").alias("procedencia")
    )
    return fields.live_record(live).drop("issues")


def payloads(readings: DataFrame, inv: DataFrame) -> DataFrame:
    """The audit payload of the cascade's answers, written as JSON and read back."""
    found = matching.identify(readings, inventory.entries(inv), inventory.pattern(inv), listed=0)
    return evaluate.read_payload(evaluate.audit_payload(found))


def late(events: DataFrame) -> DataFrame:
    from lodestamp.streaming.flow import late_rows

    return late_rows(events.select("ts", F.col("event_type").alias("status")), "30 days")


def monitored(events: DataFrame) -> DataFrame:
    from lodestamp.streaming.flow import monitor

    return monitor(events.select("ts", F.col("event_type").alias("status")))


QUERIES = {
    "n1_n14_words": on("field_lines")(worded),
    "n6_n13_dates": on("field_lines")(dated),
    "n8_n11_measures": on("field_lines")(measured),
    "k1_k3_k9_serials": on("readings")(serials),
    "k5_pattern": on("inventory")(inventory.pattern),
    "k5_mask": on("inventory")(same_shape_pattern),
    "k6_corrections": on("readings")(corrections),
    "k7_candidates": both("readings", "inventory")(candidate_rows),
    "k8_k10_distances": on("readings")(distances),
    "k11_shapes": on("inventory")(shapes),
    "f_stated": on("field_lines")(fields.stated),
    "f7_wide": on("field_lines")(lambda df: fields.wide(fields.stated(df))),
    "r1_r4_records": on("field_lines")(record_flat),
    "r3_form": on("field_lines")(form_rows),
    "a1_entries": on("inventory")(entry_rows),
    "a2_consensus": both("readings", "inventory")(consensus_rows),
    "a3_support": both("readings", "inventory")(supported),
    "j1_exact": both("readings", "inventory")(exact_rows),
    "j2_containing": both("readings", "inventory")(containing_rows),
    "j3_resolve": both("readings", "inventory")(resolved_rows),
    "j4_search": both("readings", "inventory")(searched_rows),
    "j5_identify": both("readings", "inventory")(identified),
    "d1_decisions": both("readings", "inventory", "truth")(lambda r, i, t: judged(r, i, t, matching.LISTED)),
    "j7_merge": both("live", "static")(inventory.merge),
    "j8_insertable": both("inventory", "live")(lambda i, e: inventory.insertable(i, e).select("ord", "serial")),
    "j9_j10_enrich": both("inventory", "live", "static")(enriched_rows),
    "a10_coverage": on("field_lines")(lambda df: inventory.coverage(fields.wide(fields.stated(df)), ["peso", "color", "ph", "procedencia", "tipo_gas"])),
    "a11_duplicated": on("inventory")(inventory.duplicated),
    "a11_undescribed": both("inventory", "live")(lambda i, e: inventory.undescribed(i, i.join(e.select("ord"), "ord", "left_semi"))),
    "a11_issues": on("field_lines")(issues),
    "a22_alphabet": on("inventory")(lambda i: inventory.outside_alphabet(i, "0123456789")),
    "a23_sync": both("live", "static")(lambda a, b: inventory.sync_status(inventory.merge(a, b))),
    "a5_duplicates": on("audit")(datasets.duplicates),
    "a6_counts": on("audit")(datasets.counts),
    "a7_quality": on("audit")(datasets.quality_summary),
    "a8_readiness": on("audit")(ready),
    "a6_resolutions": on("audit")(lambda a: datasets.resolutions(a.withColumn("height", F.col("width") % 7))),
    "a9_empty_groups": on("audit")(lambda a: datasets.empty_groups(a, a.where("blur > 425"))),
    "p4_low_quality": on("audit")(lambda a: datasets.low_quality(a).select("asset")),
    "a12_outcomes": both("readings", "inventory", "truth")(cascade_rates),
    "a12_cascade": both("readings", "inventory", "truth")(cascade_outcomes),
    "a16_error_rate": on("readings")(error_rates),
    "a17_latency": on("events")(lambda e: evaluate.latency(e, "value")),
    "a19_sweep": both("readings", "inventory", "truth")(swept),
    "a20_recommend": both("readings", "inventory", "truth")(lambda r, i, t: evaluate.recommend(swept(r, i, t), 0.2)),
    "a21_top_k": both("readings", "inventory", "truth")(options),
    "w4_split": on("groups")(datasets.balanced_split),
    "w5_top_up": on("groups")(topped),
    "a15_manifest": on("groups")(lambda g: datasets.manifest(datasets.balanced_split(g))),
    "g1_join": on("boxes")(lambda b: boxes.join_split(lines_of(b))),
    "g2_merge": on("boxes")(lambda b: boxes.merge_fragments(lines_of(b))),
    "g3_normalised": on("boxes")(normalised_boxes),
    "g4_expanded": on("boxes")(lambda b: b.select("image_id", "box_ord", *boxes.expanded(W, H))),
    "g5_crop": on("boxes")(lambda b: b.select("image_id", "box_ord", *boxes.crop(W, H))),
    "g6_reprojected": on("boxes")(lambda b: b.select("image_id", "box_ord", *boxes.reprojected(F.lit(2.0), F.lit(0.5), F.lit(10.0), F.lit(-3.0)))),
    "p1_plausible": on("boxes")(lambda b: boxes.plausible(b).select("image_id", "box_ord")),
    "j12_pending": on("audit")(pending),
    "j14_located": both("readings", "truth")(located),
    "a14_weak_coverage": both("readings", "truth")(weak),
    "j15_match_boxes": on("boxes")(matched_boxes),
    "a18_precision": on("boxes")(lambda b: boxes.average_precision(boxes.match_boxes(predicted(b), b), b)),
    "a24_pseudo": on("boxes")(lambda b: datasets.pseudo_labels(b.withColumn("condition", F.col("box_ord") % 3))),
    "t5_monitor": on("events")(monitored),
    "a13_funnel": on("boxes")(lambda b: datasets.crop_funnel(cropped(b))),
    "a13_crops": on("boxes")(lambda b: datasets.crop_summary(cropped(b))),
    "a25_assembled": on("audit")(assembled_rows),
    "w8_work_list": on("audit")(lambda a: datasets.work_list(image_rows(a), 10, 50)),
    "p2_p3_usable": on("readings")(usable_rows),
    "a4_best_variant": on("boxes")(variants),
    "w3_region_order": on("boxes")(lambda b: boxes.region_order(regions(b))),
    "u5_retry": both("readings", "inventory")(identified_twice),
    "g3_restored": on("boxes")(restored),
    "a15_leaks": on("groups")(lambda g: datasets.leaks(datasets.balanced_split(g).unionByName(g.where("n_items > 6").select("group_id", "n_items", F.lit("val").alias("split"))))),
    "w8_by_condition": on("audit")(audited_work),
    "t5_late": on("events")(late),
    "udf_distances": spoken,
    "u2_u4_keys": both("live", "static")(set_algebra),
    "r2_live": on("inventory")(live_rows),
    "d5_g7_payload": both("readings", "inventory")(payloads),
    "a1_attributes": on("inventory")(attribute_rows),
    "a2_masked": both("readings", "inventory")(masked_rows),
    "k7_fragments": fragment_rows,
    "u2_u4_sets": both("live", "static")(evaluate.set_sizes),
}

ORACLES = oracles.SQL


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)
