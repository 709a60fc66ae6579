"""Ranked reasons, notes on missing signals, and the rendered report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .fusion import share_of_weight

#: What a high or low reading of a signal says. {fake} and {real} stand for whole percents.
REASONS = {
    "provenance_ai_metadata": ("The file's own metadata identifies it as AI-generated.", "The file's metadata contains no AI-generation marker."),
    "provenance_c2pa": ("Content Credentials (C2PA) failed validation — the file was altered after signing.", "Valid Content Credentials confirm an intact provenance chain."),
    "provenance_camera_metadata": ("Camera metadata is present but inconsistent.", "Camera metadata is present and consistent with a real photograph."),
    "trained_probe": ("Our trained image classifier rates this as likely AI-generated.", "Our trained image classifier found no signs of AI generation."),
    "deep_learning": ("A general deepfake classifier flagged this as likely synthetic ({fake}% fake probability).", "A general deepfake classifier found no signs of synthetic generation ({real}% real probability)."),
    "frequency_analysis": ("Frequency-domain irregularities detected, consistent with GAN/upsampling artifacts.", "No frequency-domain irregularities detected — the spectral profile looks natural."),
    "compression_analysis": ("Inconsistent compression levels detected, suggesting possible splicing or re-editing.", "Compression levels are consistent throughout, with no signs of splicing."),
    "lighting_analysis": ("Lighting and color balance on the face don't match the surrounding scene.", "Lighting and color balance on the face match the surrounding scene."),
    "landmark_instability": ("Facial landmarks show abnormal frame-to-frame instability, beyond natural movement.", "Facial landmarks remained stable across frames, consistent with natural movement."),
    "optical_flow_analysis": ("Motion between frames shows unusual local discontinuities, possibly from blended/composited content.", "Motion between frames is spatially coherent, with no unusual local discontinuities."),
    "temporal_consistency": ("The AI classifier's confidence fluctuates unusually between frames, suggesting inconsistent content across the clip.", "The AI classifier's confidence stayed consistent across frames."),
    "jersey_color_consistency": ("Clothing/jersey color varies unusually across the clip, possibly indicating spliced footage.", "Clothing/jersey color stayed consistent throughout the clip."),
    "scene_consistency": ("The background scene changes abruptly at some point in the clip, possibly indicating spliced-in footage from a different source.", "The background scene stayed consistent throughout the clip."),
    "broadcast_overlay_analysis": ("Broadcast overlay/graphics regions show different compression than the rest of the frame, possibly indicating an edited scoreboard, logo, or ticker.", "Broadcast overlay/graphics regions show consistent compression with the rest of the frame."),
    "crowd_texture_analysis": ("A near-identical crowd texture patch was found repeated elsewhere in the frame, possibly indicating copy-pasted crowd padding.", "No repeated crowd texture patches were found."),
}
#: What a missing signal says; any other signal "was unavailable for this run".
NOTES = {
    "provenance_ai_metadata": "No AI-generation marker found in the file's metadata — this is normal and does NOT indicate the image is genuine, as such markers are easily stripped.",
    "provenance_c2pa": "No Content Credentials (C2PA) attached — the norm for most images, and NOT evidence of manipulation.",
    "provenance_camera_metadata": "No camera metadata present — expected, since platforms strip EXIF on upload.",
    "trained_probe": "Our trained classifier was unavailable for this run — the verdict relies on weaker signals and should be treated with low confidence.",
    "deep_learning": "General deepfake classifier was unavailable for this run — verdict relies on forensic signals only.",
    "frequency_analysis": "Frequency-domain analysis was unavailable for this run.",
    "compression_analysis": "Compression analysis was unavailable for this run.",
    "lighting_analysis": "Lighting analysis was unavailable for this run.",
    "landmark_instability": "Facial landmark instability could not be assessed (needs 2+ frames with a detected face, or the landmark model was unavailable).",
    "optical_flow_analysis": "Optical flow analysis needs 2+ frames (video only) — not applicable here.",
    "temporal_consistency": "Temporal consistency needs 2+ analyzed video frames — not applicable here.",
    "jersey_color_consistency": "Jersey consistency needs 2+ video frames with a detected face — not applicable here.",
    "scene_consistency": "Scene consistency needs 2+ video frames — not applicable here.",
    "broadcast_overlay_analysis": "Broadcast overlay analysis was unavailable for this run.",
    "crowd_texture_analysis": "Crowd texture analysis was unavailable for this run.",
}
#: Fixed value: the only reason where none is decisive.
NOTHING = "No individual signal was strongly conclusive on its own; the verdict reflects their combined weighted signal."

#: Measured quality, and the limits that every report states.
PERFORMANCE = {"roc_auc": "0.7402 (95% CI 0.680-0.796)", "accuracy": "71.3%", "test_set_size": 275}
LIMITATIONS = (
    "This system is correct about 71.3% of the time on a held-out test set of 275 images. Roughly 3 in 10 verdicts are wrong.",
    "It is a research prototype, not a certified forensic tool. This report is NOT proof of manipulation and is not admissible as evidence.",
    "Sports-specific performance is effectively unmeasured (only 10 sports images in the test set). Treat any sports-related verdict with particular caution.",
    "Video analysis is unevaluated -- the measured results above cover still images only.",
    "Absence of metadata or Content Credentials is NOT evidence of manipulation; most genuine photographs carry neither.",
)


def templates(spark: SparkSession, reasons=REASONS) -> DataFrame:
    rows = [(s, b, text) for s, (high, low) in reasons.items() for b, text in (("high", high), ("low", low))]
    return spark.createDataFrame(rows, "signal string, band string, template string")


def rank_reasons(signals: DataFrame, weights: DataFrame, reasons=REASONS) -> DataFrame:
    """media, reasons: texts of decisive signals, by distance from the middle times weight, then by position; signals are a bounded list per media."""
    s = share_of_weight(signals, weights).withColumn("band", C.band(F.col("score")))
    s = s.join(F.broadcast(templates(signals.sparkSession, reasons)), ["signal", "band"])
    pct = lambda x: F.round(x * 100, 0).cast("int").cast("string")
    text = F.replace(F.replace("template", F.lit("{fake}"), pct(F.col("score"))), F.lit("{real}"), pct(1 - F.col("score")))
    key = F.struct((-F.round(F.abs(F.col("score") - 0.5) * F.col("weight"), 9)).alias("k"), F.col("pos"), text.alias("text"))
    return s.groupBy("media").agg(F.transform(F.array_sort(F.collect_list(key)), lambda e: e["text"]).alias("reasons"))


def notes(signals: DataFrame, known=NOTES) -> DataFrame:
    missing = signals.where("score is null")
    dim = signals.sparkSession.createDataFrame(list(known.items()), "signal string, note string")
    text = F.coalesce("note", F.concat("signal", F.lit(" was unavailable for this run.")))
    return missing.join(F.broadcast(dim), "signal", "left").groupBy("media").agg(F.transform(F.array_sort(F.collect_list(F.struct("signal", text.alias("text")))), lambda e: e["text"]).alias("notes"))


def _section(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")


def explain(verdicts: DataFrame, signals: DataFrame, weights: DataFrame) -> DataFrame:
    """verdicts with headline, reasons, notes and the rendered text."""
    none = F.array().cast("array<string>")
    x = verdicts.where("status = 'completed'").join(rank_reasons(signals, weights), "media", "left").join(notes(signals), "media", "left")
    x = x.withColumn("headline", C.headline(F.col("verdict"), F.col("risk"))).withColumn("reasons", F.coalesce("reasons", F.array(F.lit(NOTHING)))).withColumn("notes", F.coalesce("notes", none))
    return x.withColumn("rendered", F.concat("headline", _section("Reasons", F.col("reasons")), _section("Notes", F.col("notes"))))


def technical_summary(verdicts: DataFrame, signals: DataFrame, weights: DataFrame, known=NOTES) -> DataFrame:
    """media, summary: the verdict with its score, the signals that apply by renormalised weight (then by position), and those that do not with their note.

    Only media that have a score; the lists are those of one media's signals, a bounded number.
    """
    fixed = lambda x: F.format_number(F.bround(x, 2), 2)
    line = F.concat(F.lit("  - "), "signal", F.lit(": score="), fixed(F.col("score")), F.lit(", weight="), F.bround(F.col("weight") * 100, 0).cast("int").cast("string"), F.lit("%"))
    entry = F.struct((-F.round("weight", 9)).alias("k"), F.coalesce("pos", F.lit(1 << 30)).alias("pos"), "signal", line.alias("text"))
    lines = share_of_weight(signals, weights).groupBy("media").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]).alias("lines"))
    dim = signals.sparkSession.createDataFrame(list(known.items()), "signal string, note string")
    absent = F.struct("signal", F.concat(F.lit("  - "), "signal", F.lit(": "), F.coalesce("note", F.concat("signal", F.lit(" was unavailable for this run.")))).alias("text"))
    missing = signals.where("score is null").join(F.broadcast(dim), "signal", "left").groupBy("media").agg(F.transform(F.array_sort(F.collect_list(absent)), lambda e: e["text"]).alias("missing"))
    head = F.concat(F.lit("Verdict: "), F.upper("verdict"), F.lit(" (fused suspicion score "), fixed(F.col("fused_score")), F.lit(" on a 0-1 scale)."))
    x = verdicts.where("score is not null").select("media", "verdict", F.col("score").alias("fused_score")).join(lines, "media", "left").join(missing, "media", "left")
    texts = [F.array(head, F.lit("Contributing signals:")), F.coalesce("lines", F.array().cast("array<string>")), F.when(F.col("missing").isNotNull(), F.concat(F.array(F.lit("Signals not available for this analysis:")), "missing")).otherwise(F.array().cast("array<string>"))]
    return x.select("media", F.array_join(F.concat(*texts), "\n").alias("summary"))


def signal_map(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """media, signals: name -> (score, weight) of the signals that apply, weights renormalised; a bounded list per media."""
    entry = F.struct("signal", F.struct(F.round("score", 4).alias("score"), F.round("weight", 4).alias("weight")).alias("value"))
    return share_of_weight(signals, weights).groupBy("media").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("signals"))


def report_json(x: DataFrame, signals: DataFrame, weights: DataFrame) -> DataFrame:
    """media, report: the record's identity, verdict, provenance of the verdict, findings and signals; never without the measured quality and the limits.

    Columns filename, media_type, analysed_at, model_version and pipeline_version are null where x lacks them.
    """
    own = lambda c: F.col(c) if c in x.columns else F.lit(None).cast("string")
    report = F.struct(
        F.col("media").alias("record_id"), own("filename").alias("filename"), own("media_type").alias("media_type"), "verdict", F.round("confidence", 4).alias("confidence_score"),
        F.col("risk").alias("risk_level"), own("analysed_at").alias("analysed_at"),
        F.struct(own("model_version").alias("model_version"), own("pipeline_version").alias("pipeline_version"), F.col("method").alias("fusion_method")).alias("provenance"),
        F.col("reasons").alias("findings"), F.col("notes").alias("unavailable_signals"), F.coalesce("signals", F.create_map().cast("map<string,struct<score:double,weight:double>>")).alias("signals"),
        F.struct(*[F.lit(v).alias(k) for k, v in PERFORMANCE.items()]).alias("system_performance"), F.array(*[F.lit(v) for v in LIMITATIONS]).alias("limitations"), F.current_timestamp().alias("generated_at"),
    )
    return x.join(signal_map(signals, weights), "media", "left").select("media", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def exportable(df: DataFrame, status: str = "status", ready: str = "completed") -> DataFrame:
    return df.where(F.col(status) == ready)
