"""Scores, flags, alerts and verdicts as expressions over one row per note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import rounded, truthy_or
from ..params import DEFAULT, Params


def flag_array(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def _unless_empty(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def credibility(fields: DataFrame, p: Params = DEFAULT, duplicate: Column | None = None) -> DataFrame:
    """fields plus credibility_score and credibility_flags: five sub-scores, each rounded before it is weighed."""
    ocr, extraction = F.coalesce("ocr_confidence", F.lit(0.0)), F.coalesce("extraction_confidence", F.lit(0.0))
    present = sum((_unless_empty(c).cast("int") for c in p.required_fields), F.lit(0))
    imo = F.coalesce("imo", F.lit(""))
    bad_imo = (imo != "") & ~imo.rlike("^[0-9]{7}$")
    corrected = X.has_keyword(F.col("raw_text"), p.correction_keywords)
    thick, wet = F.coalesce(F.col("viscosity") > 700, F.lit(False)), F.coalesce(F.col("water_content") > 0.5, F.lit(False))
    start, end = F.coalesce("start_time", F.lit("")), F.coalesce("end_time", F.lit(""))
    reversed_ = (start != "") & (end != "") & (start >= end)
    hours = X.duration_hours(F.col("start_time"), F.col("end_time"))
    q = F.coalesce("quantity_mt", F.lit(0.0))
    short, long = F.coalesce((hours < 0.5) & (q > 200), F.lit(False)), F.coalesce(hours > 12, F.lit(False))
    rate = F.try_divide(q, hours)
    impossible = F.coalesce((hours > 0) & (q > 0) & ((rate < p.min_pump_rate) | (rate > p.max_pump_rate)), F.lit(False))
    font = F.coalesce("font_variance", F.lit(0.0)) >= p.digital_max_variance
    kind = F.coalesce("doc_type", F.lit("DIGITAL"))
    again = F.lit(False) if duplicate is None else F.coalesce(duplicate, F.lit(False))
    less = lambda cond, points: F.when(cond, float(points)).otherwise(0.0)
    floor0 = lambda x: F.greatest(F.lit(0.0), x)
    form = floor0(100 - less(bad_imo, 20))
    for cond, points in ((corrected, 20), (thick, 40), (wet, 40), (impossible, 15), (again, 30)):
        form = floor0(form - less(cond, points))
    sub = {
        "ocr": F.least(ocr / p.ocr_threshold, F.lit(1.0)) * 100,
        "fields": present / len(p.required_fields) * 100,
        "format": form,
        "time": floor0(100 - less(reversed_, 25) - less(short, 20) - less(long, 15)),
        "font": floor0(100 - less(font, 20) - less(kind == "HANDWRITTEN", 25) - less(kind == "SCANNED", 5)),
    }
    marks = flag_array(
        F.when(ocr < p.ocr_threshold, "low_ocr_confidence"),
        F.when(extraction < p.extraction_threshold, "low_extraction_confidence"),
        F.when(present < len(p.required_fields), "missing_required_fields"),
        F.when(bad_imo, "invalid_imo_format"),
        F.when(corrected, "contains_correction_keywords"),
        F.when(thick, "marpol_viscosity_violation"),
        F.when(wet, "marpol_water_content_violation"),
        F.when(reversed_, "reversed_timestamps"),
        F.when(short | long, "suspicious_pumping_duration"),
        F.when(impossible, "quantity_physically_impossible"),
        F.when(font, "font_inconsistency"),
        F.when(kind == "HANDWRITTEN", "handwritten_document"),
        F.when(~_unless_empty("seal_number_vessel") & ~_unless_empty("seal_number_marpol") & ~_unless_empty("seal_number_barge"), "missing_seal_numbers"),
        F.when((kind == "DIGITAL") & ~_unless_empty("barge_sb_number"), "sb_number_absent"),
        F.when(again, "duplicate_bdn_detected"),
    )
    staged = fields.select("*", *[rounded(x, 1).alias(f"sub_{k}") for k, x in sub.items()], marks.alias("credibility_flags"))
    total = sum((F.col(f"sub_{k}") * w for k, w in p.score_weights.items()), F.lit(0.0))
    return staged.withColumn("credibility_score", rounded(total, 1))


def legacy_credibility(fields: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """note_id, score and flags of the older rules: seven fields with the IMO, and fuel limits that cost points."""
    seven = (*p.required_fields, "imo")
    present = sum((_unless_empty(c).cast("int") for c in seven), F.lit(0))
    out_of = {"density_out_of_range": (F.col("density") < 0.82) | (F.col("density") > 1.01), "sulphur_exceeds_limit": F.col("sulphur_content") > 0.5, "flashpoint_below_minimum": F.col("flashpoint") < 60}
    flags = flag_array(F.when(~F.coalesce(F.col("imo").rlike("^[0-9]{7}$"), F.lit(False)), "invalid_imo_format"), *[F.when(c, k) for k, c in out_of.items()])
    penalties = sum((F.when(c, 10.0).otherwise(0.0) for c in out_of.values()), F.lit(0.0))
    return fields.select("note_id", F.greatest(F.lit(0.0), rounded(100.0 * present / len(seven), 1) - penalties).alias("score"), flags.alias("flags"))


def severity(alert_type: Column, p: Params = DEFAULT) -> Column:
    known = F.create_map(*[F.lit(x) for kv in p.severities.items() for x in kv])
    return F.coalesce(F.try_element_at(known, alert_type), F.lit("MEDIUM"))


def _alert(kind: str, explanation: Column | str, p: Params) -> Column:
    text = F.lit(explanation) if isinstance(explanation, str) else explanation
    return F.struct(F.lit(kind).alias("alert_type"), severity(F.lit(kind), p).alias("severity"), text.alias("explanation"))


def alerts(p: Params = DEFAULT) -> Column:
    """Array of alerts from identity_flags, identity_unresolved, barge_flags, barge_ais_missing, is_anomaly, ais_unavailable, credibility_flags."""
    has = lambda c, x: F.array_contains(c, x)
    who = F.concat(F.lit("Vessel '"), F.coalesce("vessel_name", F.lit("?")), F.lit("'"))
    barge = F.concat(F.lit("Barge '"), F.coalesce("barge_name", F.lit("?")), F.lit("'"))
    vessel = (
        F.when(has("identity_flags", "missing_vessel_identity"), _alert("VESSEL_NOT_FOUND", "No vessel name or IMO on the note.", p))
        .when(F.col("identity_unresolved"), _alert("VESSEL_IDENTITY_UNRESOLVED", F.concat(who, F.lit(" and its IMO belong to different registrations.")), p))
        .when(has("identity_flags", "vessel_name_mismatch"), _alert("IMO_MISMATCH", F.concat(who, F.lit(" is not the name registered for the IMO.")), p))
        .when(has("identity_flags", "vessel_name_fuzzy_match"), _alert("NAME_FUZZY_MATCH", F.concat(who, F.lit(" is close to the registered name.")), p))
        .when(has("identity_flags", "vessel_not_in_registry"), _alert("VESSEL_NOT_FOUND", F.concat(who, F.lit(" is in no registry.")), p))
    )
    carrier = (
        F.when(has("barge_flags", "barge_name_missing"), _alert("BARGE_MISSING", "No barge name on the note.", p))
        .when(has("barge_flags", "barge_not_found"), _alert("BARGE_MISSING", F.concat(barge, F.lit(" is in no registry.")), p))
        .when(has("barge_flags", "barge_name_mismatch"), _alert("BARGE_NAME_MISMATCH", F.concat(barge, F.lit(" is not the name registered for the SB number.")), p))
        .when(has("barge_flags", "barge_low_confidence"), _alert("BARGE_UNVERIFIED", F.concat(barge, F.lit(" matched with low confidence.")), p))
        .when(F.col("barge_ais_missing"), _alert("BARGE_AIS_MISSING", F.concat(barge, F.lit(" has no track.")), p))
    )
    ais = F.when(F.col("is_anomaly"), _alert("EXCESSIVE_DISTANCE", "The tracks do not show a delivery.", p)).when(F.col("ais_unavailable"), _alert("AIS_UNAVAILABLE", "No positions for the delivery window.", p))
    by_flag = (("reversed_timestamps", "INVALID_TIMESTAMPS", "The end is before the start."), ("quantity_physically_impossible", "QUANTITY_INFEASIBLE", "The pump rate is not possible."), ("contains_correction_keywords", "SUSPICIOUS_CORRECTIONS", "The note mentions corrections."), ("duplicate_bdn_detected", "DUPLICATE_BDN", "The same vessel, port and date exist."), ("missing_seal_numbers", "MISSING_SEAL_NUMBERS", "No seal numbers on the note."))
    return flag_array(vessel, carrier, ais, *[F.when(has("credibility_flags", f), _alert(a, e, p)) for f, a, e in by_flag])


def overall_risk(found: Column) -> Column:
    n = lambda s: F.size(F.filter(found, lambda a: a["severity"] == s))
    return F.when(n("HIGH") > 0, "HIGH").when(n("MEDIUM") > 0, "MEDIUM").when(n("LOW") > 0, "LOW").otherwise("NONE")


def with_alerts(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """rows plus fraud_alerts, info_alerts, overall_fraud_risk and fraud_review."""
    a = rows.withColumn("alerts", alerts(p))
    a = a.withColumn("fraud_alerts", F.filter("alerts", lambda x: x["severity"] != "INFO")).withColumn("info_alerts", F.filter("alerts", lambda x: x["severity"] == "INFO")).withColumn("overall_fraud_risk", overall_risk(F.col("alerts")))
    return a.withColumn("fraud_review", (F.col("overall_fraud_risk") == "HIGH") | F.col("identity_unresolved"))


def verdicts(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """rows plus confidence, classification, human_review_required, barge_missing, verdict_reason and audit_trail."""
    w = p.confidence_weights
    geo = F.when(F.col("ais_unavailable"), 0.9).otherwise(F.greatest(F.lit(0.0), 1 - truthy_or(F.col("anomaly_score"), 0.5)))
    barge = truthy_or(F.col("barge_confidence"), 0.5)
    dims = {"ocr": F.coalesce("ocr_confidence", F.lit(0.0)), "extraction": F.coalesce("extraction_confidence", F.lit(0.0)), "vessel": F.coalesce("identity_confidence", F.lit(0.0)), "barge": barge, "geo": geo}
    r = rows.select("*", *[x.alias(f"dim_{k}") for k, x in dims.items()])
    r = r.withColumn("confidence", rounded(sum((F.col(f"dim_{k}") * v for k, v in w.items()), F.lit(0.0)), 3))
    missing = F.arrays_overlap("barge_flags", F.array(F.lit("barge_name_missing"), F.lit("barge_not_found")))
    only_missing = F.col("ais_unavailable") & ~F.col("is_anomaly") & (F.size(F.array_except("anomaly_flags", F.array(F.lit("ais_unavailable"), F.lit("barge_ais_missing"), F.lit("synthetic_ais_demo")))) == 0)
    high, medium = F.col("overall_fraud_risk") == "HIGH", F.col("overall_fraud_risk") == "MEDIUM"
    r = r.withColumn("barge_missing", F.coalesce(missing, F.lit(False)))
    label = (
        F.when(F.col("identity_unresolved") | high | F.col("is_anomaly"), "HIGH_RISK")
        .when(F.col("barge_missing"), "SUSPICIOUS")
        .when(only_missing & ~medium, "REVIEW_REQUIRED")
        .when(F.col("confidence") >= 0.75, "VALID")
        .when(F.col("confidence") >= 0.5, "SUSPICIOUS")
        .otherwise("HIGH_RISK")
    )
    r = r.withColumn("classification", label)
    r = r.withColumn("human_review_required", F.col("fraud_review") | F.col("identity_unresolved") | F.col("classification").isin("HIGH_RISK", "REVIEW_REQUIRED"))
    return r.withColumn("verdict_reason", reason()).withColumn("audit_trail", audit_trail(p))


def reason() -> Column:
    c = F.col("classification")
    key = F.slice(F.array_except("credibility_flags", F.array(F.lit("handwritten_document"), F.lit("sb_number_absent"))), 1, 3)
    parts = F.array(
        F.when(c == "VALID", "All checks passed."),
        F.when((c == "VALID") & ~F.col("ais_unavailable"), "The tracks confirm the delivery."),
        F.when(c == "REVIEW_REQUIRED", "No positions in the delivery window."),
        F.when((c == "SUSPICIOUS") & F.col("barge_missing"), "The barge could not be identified."),
        F.when((c == "SUSPICIOUS") & ~F.col("barge_missing"), "Overall confidence is below the threshold."),
        F.when((c == "HIGH_RISK") & F.col("identity_unresolved"), "IMO and name conflict."),
        F.when((c == "HIGH_RISK") & F.col("is_anomaly"), "The tracks are anomalous."),
        F.when((c == "HIGH_RISK") & (F.col("overall_fraud_risk") == "HIGH"), "High-severity alerts."),
        F.when(F.size(key) > 0, F.concat(F.lit("Document flags: "), F.array_join(key, ", "), F.lit("."))),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), " ")


def audit_trail(p: Params = DEFAULT) -> Column:
    step = lambda name, value, limit, passed: F.struct(F.lit(name).alias("step"), rounded(value, 2).alias("result"), F.lit(float(limit)).alias("threshold"), passed.alias("passed"))
    return F.slice(
        F.array(
            step("OCR", F.col("dim_ocr"), p.ocr_threshold, F.col("dim_ocr") >= p.ocr_threshold),
            step("EXTRACTION", F.col("dim_extraction"), 0.5, F.col("dim_extraction") >= 0.5),
            step("VESSEL_IDENTITY", F.col("dim_vessel"), p.name_threshold, ~F.col("identity_unresolved")),
            step("BARGE_IDENTITY", F.col("dim_barge"), 0.7, F.col("dim_barge") >= 0.7),
            step("GEOLOCATION_ML", F.col("dim_geo"), p.anomaly_threshold, ~F.col("is_anomaly") & ~F.col("ais_unavailable")),
        ),
        1,
        50,
    )


def old_verdict(credibility_score: Column, identity_confidence: Column, anomaly_score: Column, unresolved: Column, confirmed: Column, ais_unavailable: Column, is_anomaly: Column) -> Column:
    """struct(classification, confidence) of the older matrix."""
    combined = rounded(credibility_score / 100 * 0.35 + identity_confidence * 0.25 + (1 - truthy_or(anomaly_score, 0.5)) * 0.4, 3)
    high = credibility_score >= 70
    ok = ~unresolved & confirmed
    label = F.when(unresolved | is_anomaly, "HIGH_RISK").when(ais_unavailable, F.when(high & ok, "SUSPICIOUS").otherwise("HIGH_RISK")).when((combined >= 0.75) & high & ok, "VALID").when(combined >= 0.45, "SUSPICIOUS").otherwise("HIGH_RISK")
    return F.struct(label.alias("classification"), combined.alias("confidence"))


def compliance(density: Column, sulphur: Column, flashpoint: Column) -> Column:
    """struct of a badge per limit (PASS, FAIL, MISSING) and the share of known limits that pass."""
    badge = lambda x, ok: F.when(x.isNull(), "MISSING").when(ok, "PASS").otherwise("FAIL")
    d, s, f = badge(density, (density >= 0.82) & (density <= 1.01)), badge(sulphur, sulphur <= 0.5), badge(flashpoint, flashpoint >= 60)
    points = sum((F.when(b == "PASS", w).otherwise(0.0) for b, w in ((d, 0.40), (s, 0.35), (f, 0.25))), F.lit(0.0))
    return F.struct(d.alias("density"), s.alias("sulphur"), f.alias("flashpoint"), rounded(points, 2).alias("score"))


#: What each broken limit takes from the share of limits that hold, and the weights of document, data and limits.
BROKEN, BLEND = {"density": 0.33, "sulphur": 0.33, "flashpoint": 0.34}, {"document": 0.40, "data": 0.35, "limits": 0.25}


def compliance_review(rows: DataFrame) -> DataFrame:
    """rows judged again after an edit: limits, data, overall, new_classification, new_reason and violations.

    rows: density, sulphur_content, flashpoint, ocr_confidence, anomaly_flags, barge_ais_missing, barge_missing, is_anomaly,
    classification, verdict_reason. A broken limit makes a verdict HIGH_RISK; a barge without positions, where it is known which barge it
    is and nothing is unusual, sends a VALID or SUSPICIOUS one to review; all else stays.
    """
    c = compliance(F.col("density"), F.col("sulphur_content"), F.col("flashpoint"))
    r = rows.withColumn("__c", c)
    failed = {k: F.col(f"__c.{k}") == "FAIL" for k in BROKEN}
    any_failed = failed["density"] | failed["sulphur"] | failed["flashpoint"]
    limits = F.greatest(F.lit(0.0), 1 - sum((F.when(x, BROKEN[k]).otherwise(0.0) for k, x in failed.items()), F.lit(0.0)))
    absent = F.coalesce("barge_ais_missing", F.lit(False))
    others = F.size(F.filter(F.coalesce("anomaly_flags", F.array().cast("array<string>")), lambda f: f != "ais_unavailable"))
    data = F.greatest(F.lit(0.0), 1 - F.when(absent, 0.5).otherwise(0.0) - 0.2 * others)
    gap = absent & ~F.coalesce("barge_missing", F.lit(False)) & ~F.coalesce("is_anomaly", F.lit(False))
    label = F.when(any_failed, "HIGH_RISK").when(gap & F.col("classification").isin("VALID", "SUSPICIOUS"), "REVIEW_REQUIRED").otherwise(F.col("classification"))
    overall = F.coalesce("ocr_confidence", F.lit(0.95)) * BLEND["document"] + data * BLEND["data"] + limits * BLEND["limits"]
    reason_ = F.when(any_failed, "A limit for marine fuel is broken.").when(gap & (label == "REVIEW_REQUIRED"), "The barge has no positions for the delivery; nothing unusual was found.").otherwise(F.col("verdict_reason"))
    broken = F.filter(F.array(*[F.when(x, f"marpol_{k}_violation") for k, x in failed.items()]), lambda x: x.isNotNull())
    return r.select(*rows.columns, rounded(limits, 2).alias("limits"), rounded(data, 2).alias("data"), rounded(overall, 4).alias("overall"), label.alias("new_classification"), reason_.alias("new_reason"), broken.alias("violations"))


#: Checks that a flag of the document fails.
FLAG_CHECKS = {
    "no corrections": "contains_correction_keywords",
    "seals given": "missing_seal_numbers",
    "time order": "reversed_timestamps",
    "pumping time": "suspicious_pumping_duration",
    "pump rate": "quantity_physically_impossible",
    "viscosity limit": "marpol_viscosity_violation",
    "water limit": "marpol_water_content_violation",
    "no duplicate": "duplicate_bdn_detected",
}


def check_list(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """note_id, category, check, status, detail: 18 rows of checks for each note."""
    seven = (*p.required_fields, "imo")
    missing = F.lit("missing")
    checks = [("document", f"{c} present", _unless_empty(c), missing) for c in seven] + [
        ("document", "OCR readable", F.col("ocr_confidence") >= p.ocr_threshold, F.lit("low_ocr_confidence")),
        ("document", "credible", (F.col("credibility_score") >= 70) & (F.size("credibility_flags") == 0), F.array_join("credibility_flags", ",")),
        ("document", "quantity given", F.col("quantity_mt").isNotNull(), missing),
    ]
    checks += [("rules", name, ~F.array_contains("credibility_flags", flag), F.lit(flag)) for name, flag in FLAG_CHECKS.items()]
    made = F.array(*[F.struct(F.lit(a).alias("category"), F.lit(b).alias("check"), F.when(c, "ok").otherwise("attention").alias("status"), F.when(c, "").otherwise(d).alias("detail")) for a, b, c, d in checks])
    return rows.select("note_id", F.explode(made).alias("x")).select("note_id", "x.*")


def verdict_checks(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """note_id, category, check, status, detail: up to 18 rows for each judged note, from its document, identity, positions and times.

    rows: the required fields, imo, ocr_confidence, credibility_score and flags, quantity_mt, located and highlighted (fields found on the page, of
    how many; null without boxes), identity_unresolved, identity_confidence, identity_method, ais_unavailable, anomaly_flags, overlap_percent,
    avg_distance_m, port_coordinate_match, anomaly_score, is_anomaly, start_s. A check whose input is null is left out; of the checks of
    positions a note without them has one.
    """
    flag = lambda f: F.array_contains(F.coalesce("anomaly_flags", F.array().cast("array<string>")), f)
    tracked, unresolved = ~F.coalesce("ais_unavailable", F.lit(True)), F.coalesce("identity_unresolved", F.lit(True)) | flag("vessel_identity_unresolved")
    text = lambda x: x.cast("string")
    credible = (F.col("credibility_score") >= 70) & (F.size("credibility_flags") == 0)
    alongside = ~flag("barge_ais_missing") & (F.coalesce("overlap_percent", F.lit(0.0)) >= p.min_overlap_percent)
    # category, check, present, passed, detail
    checks = [("document", f"{c} read", F.lit(True), _unless_empty(c), F.when(_unless_empty(c), F.concat(F.lit("read: "), text(F.col(c)))).otherwise("not read")) for c in (*p.required_fields, "imo")]
    checks += [
        ("document", "text readable", F.lit(True), F.coalesce(F.col("ocr_confidence") >= p.ocr_threshold, F.lit(False)) & ~F.array_contains("credibility_flags", "low_ocr_confidence"), F.concat(F.lit("confidence in percent: "), text(F.floor(F.coalesce("ocr_confidence", F.lit(0.0)) * 100 + 1e-9)))),
        ("document", "credible", F.col("credibility_score").isNotNull(), credible, F.concat_ws("; ", F.concat(F.lit("score "), text(F.col("credibility_score"))), F.nullif(F.array_join(F.array_sort("credibility_flags"), ", "), F.lit("")))),
        ("document", "quantity possible", F.col("quantity_mt").isNotNull(), ~flag("quantity_infeasible"), F.when(flag("quantity_infeasible"), "too much or too little for the time").otherwise("fits the time")),
        ("document", "fields located", F.coalesce("highlighted", F.lit(0)) > 0, F.col("located") >= F.col("highlighted") - 2, F.concat(text(F.col("located")), F.lit(" of "), text(F.col("highlighted")), F.lit(" found on the page"))),
        ("identity", "IMO and name agree", F.lit(True), ~unresolved, F.when(unresolved, "a reviewer must decide").otherwise("one vessel")),
        ("identity", "identity sure", F.col("identity_confidence").isNotNull(), (F.col("identity_confidence") >= p.name_threshold) & ~unresolved, F.concat(text(F.floor(F.col("identity_confidence") * 100 + 1e-9)), F.lit(" percent by "), F.coalesce("identity_method", F.lit("unknown")))),
        ("positions", "positions there", ~tracked, F.lit(False), F.lit("none for the delivery")),
        ("positions", "vessel at rest", tracked, ~flag("vessel_speed_anomaly"), F.when(flag("vessel_speed_anomaly"), "moved too fast").otherwise("track as expected")),
        ("positions", "barge alongside", tracked, alongside, F.when(flag("barge_ais_missing"), "no positions of the barge").otherwise(F.concat(text(F.col("overlap_percent")), F.lit(" percent together, "), text(F.col("avg_distance_m")), F.lit(" m apart")))),
        ("positions", "port as stated", tracked, F.coalesce("port_coordinate_match", F.lit(False)), F.when(F.coalesce("port_coordinate_match", F.lit(False)), "near the port").otherwise("elsewhere or unknown")),
        ("positions", "usual pattern", tracked & F.col("anomaly_score").isNotNull(), ~F.coalesce("is_anomaly", F.lit(False)), F.concat(F.lit("score "), text(F.col("anomaly_score")))),
        ("positions", "times in UTC", F.col("start_s").isNotNull(), F.lit(True), F.lit("by the port's time zone")),
    ]
    made = [F.when(there, F.struct(F.lit(a).alias("category"), F.lit(b).alias("check"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("attention").alias("status"), F.coalesce(d, F.lit("")).alias("detail"))) for a, b, there, ok, d in checks]
    return rows.select("note_id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("note_id", "x.*")


#: Texts for codes; others are shown with blanks for underscores.
DESCRIPTIONS = {
    "VESSEL_NOT_FOUND": "Vessel is in no registry",
    "IMO_MISMATCH": "Name differs from the one registered for the IMO",
    "VESSEL_IDENTITY_UNRESOLVED": "IMO and name belong to different vessels",
    "BARGE_MISSING": "Barge could not be identified",
    "BARGE_NAME_MISMATCH": "Barge name differs from the registered one",
    "MISSING_SEAL_NUMBERS": "No seal numbers on the note",
    "AIS_UNAVAILABLE": "No positions for the delivery window",
    "QUANTITY_INFEASIBLE": "Pump rate is not possible",
    "DUPLICATE_BDN": "Same vessel, port and date as another note",
    "low_ocr_confidence": "Text was hard to read",
    "low_extraction_confidence": "Few fields were found",
    "missing_required_fields": "Required fields are missing",
    "invalid_imo_format": "IMO is not seven digits",
    "contains_correction_keywords": "Text mentions corrections",
    "marpol_viscosity_violation": "Viscosity is above the limit",
    "marpol_water_content_violation": "Water content is above the limit",
    "reversed_timestamps": "End lies before start",
    "suspicious_pumping_duration": "Pumping was unusually short or long",
    "quantity_physically_impossible": "Quantity does not fit the time",
    "font_inconsistency": "Fonts vary",
    "handwritten_document": "Note is handwritten",
    "missing_seal_numbers": "No seal numbers",
    "duplicate_bdn_detected": "Another note is the same",
    "barge_ais_missing": "The barge has no positions for the delivery",
    "vessel_speed_anomaly": "The vessel moved faster than a bunkering allows",
    "co_location_duration_mismatch": "Vessel and barge were not side by side as long as stated",
    "port_coordinate_mismatch": "Positions lie far from the stated port",
    "quantity_infeasible": "No usual pump delivers the quantity in the time",
    "ais_gap_exceeded": "Positions are missing for longer than allowed",
    "ais_unavailable": "No positions could be had, so the place is unverified",
    "vessel_identity_unresolved": "The IMO and the name point to different vessels",
    "pipeline_error": "A step of the check failed",
    "synthetic_ais_demo": "Positions are made up for a demonstration",
    "vessel_name_fuzzy_match": "The name resembles the registered one",
    "vessel_name_embedding_match": "The name means what the registered one means",
}


def describe_flag(code: Column, known: dict[str, str] = DESCRIPTIONS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.replace(code, F.lit("_"), F.lit(" ")))


def document_class(text_length: Column, mean_confidence: Column, variance: Column, words: Column, p: Params = DEFAULT) -> Column:
    """struct(doc_type, confidence): a text layer, or even and confident words, mean DIGITAL."""
    digital = (mean_confidence >= p.digital_min_confidence) & (variance <= p.digital_max_variance) & (variance <= p.handwritten_variance_floor)
    return F.when(text_length > 50, F.struct(F.lit("DIGITAL").alias("doc_type"), F.lit(0.99).alias("confidence"))).when(words < 5, F.struct(F.lit("HANDWRITTEN").alias("doc_type"), F.lit(0.6).alias("confidence"))).otherwise(F.struct(F.when(digital, "DIGITAL").otherwise("HANDWRITTEN").alias("doc_type"), mean_confidence.alias("confidence")))


def legacy_class(mean_confidence: Column, variance: Column, edge_density: Column, p: Params = DEFAULT) -> Column:
    return F.when((mean_confidence >= p.digital_min_confidence) & (variance < p.digital_max_variance), "DIGITAL").when((mean_confidence >= 0.6) & (edge_density >= 0.05), "SCANNED").otherwise("HANDWRITTEN")
