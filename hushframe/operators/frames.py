"""Joins of page, frame, action and profile tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import vocab
from hushframe.functions import geometry as G
from hushframe.functions import text as X


def flag_sensitive(nodes: DataFrame, flagged: DataFrame, by: str = "page_id") -> DataFrame:
    """nodes with sensitive set where (by, agent_id) is among flagged; no row is added."""
    marks = flagged.select(by, "agent_id").where("agent_id is not null").distinct().withColumn("_hit", F.lit(True))
    return nodes.join(marks, [by, "agent_id"], "left").withColumn("sensitive", F.coalesce("_hit", "sensitive", F.lit(False))).select(nodes.columns)


def drop_acted(nodes: DataFrame, actions: DataFrame, by: str = "run_id") -> DataFrame:
    """nodes without those that a run has clicked or typed into."""
    acted = actions.where(F.col("action").isin("click", "type")).select(by, F.col("target_id").alias("agent_id")).distinct()
    return nodes.join(acted, [by, "agent_id"], "left_anti").select(nodes.columns)


def merge_frames(reports: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved, dropped) of frame reports (page_id, frame_id, token, ok, agent_id, x, y, w, h): boxes in top-frame coordinates, and rows with a reason.

    tokens: page_id, token, dx, dy, connected. Only an ok report with a connected token and a finite offset is moved.
    """
    offsets = tokens.select("page_id", "token", "dx", "dy", "connected").dropDuplicates(["page_id", "token"])
    df = reports.join(offsets, ["page_id", "token"], "left")
    reason = (
        F.when(~F.coalesce("ok", F.lit(False)), "report_failed").when(F.col("token").isNull(), "no_token").when(~F.coalesce("connected", F.lit(False)), "token_not_connected")
        .when(~G.is_finite(F.col("dx"), F.col("dy")), "offset_unresolved").when(~G.is_finite(*G.columns()), "bbox_not_finite")
    )
    df = df.withColumn("reason", reason)
    x, y, w, h = G.translate(G.columns(), F.col("dx"), F.col("dy"))
    moved = df.where("reason is null").select("page_id", "frame_id", "token", "agent_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    return moved, df.where("reason is not null").select("page_id", "frame_id", "token", "agent_id", "reason")


def defensive_regions(iframes: DataFrame, merged: DataFrame) -> DataFrame:
    """iframes (page_id, token, x, y, w, h) with area that no merged report stands for: whole rectangles to redact."""
    return iframes.where("w > 0 and h > 0").join(merged.select("page_id", "token").distinct(), ["page_id", "token"], "left_anti").select("page_id", "token", *"xywh")


def frame_counts(iframes: DataFrame, reports: DataFrame, moved: DataFrame) -> DataFrame:
    """(page_id, reported, merged, dropped, defensive) by page."""
    frames = reports.groupBy("page_id").agg(F.countDistinct("frame_id").alias("reported"))
    merged = moved.groupBy("page_id").agg(F.countDistinct("frame_id").alias("merged"))
    whole = defensive_regions(iframes, moved).groupBy("page_id").agg(F.count(F.lit(1)).alias("defensive"))
    df = frames.join(merged, "page_id", "left").join(whole, "page_id", "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("reported", "merged", "defensive")}
    return df.select("page_id", n["reported"].alias("reported"), n["merged"].alias("merged"), (n["reported"] - n["merged"]).alias("dropped"), n["defensive"].alias("defensive"))


def resolve_targets(actions: DataFrame, nodes: DataFrame, by: str = "run_id") -> DataFrame:
    """actions with their node's columns (n_*) and resolution: null if found, else TARGET_NOT_FOUND or TARGET_DETACHED."""
    cols = [c for c in nodes.columns if c not in (by, "agent_id")]
    known = nodes.select(by, F.col("agent_id").alias("target_id"), F.lit(True).alias("_found"), *[F.col(c).alias(f"n_{c}") for c in cols]).dropDuplicates([by, "target_id"])
    df = actions.join(known, [by, "target_id"], "left")
    gone = F.lit(None).cast("string") if "n_connected" not in df.columns else F.when(~F.coalesce("n_connected", F.lit(True)), "TARGET_DETACHED")
    return df.withColumn("resolution", F.when(F.col("_found").isNull(), "TARGET_NOT_FOUND").otherwise(gone)).drop("_found")


def guard_actions(actions: DataFrame, nodes: DataFrame, profiles: DataFrame, risk: Callable[[], Column], allow_sensitive: Column | None = None, allow_irreversible: Column | None = None) -> DataFrame:
    """(run_id, step, verdict, reasons): the first rule that an action fails, or ok.

    nodes: run_id, agent_id, connected, sensitive and what risk reads (as n_*). profiles: run_id, field, value. risk gives the
    array of reasons why an action is irreversible.
    """
    df = resolve_targets(actions, nodes)
    filled = profiles.select("run_id", F.col("field").alias("profile_field"), X.blank_to_null(F.col("value")).isNotNull().alias("_filled")).dropDuplicates(["run_id", "profile_field"])
    df = df.join(filled, ["run_id", "profile_field"], "left").withColumn("reasons", risk())
    action = F.col("action")
    free = action.isin("scroll", "done")
    page = F.col("target_id") == vocab.PAGE_TARGET
    no = F.lit(False)
    sensitive = F.coalesce(F.col("n_sensitive"), no) & (action != "fill_profile") & ~(allow_sensitive if allow_sensitive is not None else no)
    irreversible = (F.size("reasons") > 0) & ~(allow_irreversible if allow_irreversible is not None else no)
    verdict = (
        F.when(~F.coalesce(action.isin(vocab.ACTION_TYPES), no), "UNKNOWN_ACTION")
        .when(F.coalesce("target_id", F.lit("")) == "", "MISSING_TARGET_ID")
        .when(page & ~free, "INVALID_TARGET_FOR_ACTION")
        .when((action == "fill_profile") & ~F.coalesce(F.col("profile_field").isin(vocab.PROFILE_FIELDS), no), "INVALID_PROFILE_FIELD")
        .when(free & page, "ok")
        .when(F.col("resolution").isNotNull(), F.col("resolution"))
        .when(sensitive, "SENSITIVE_TARGET_BLOCKED")
        .when(irreversible, "IRREVERSIBLE_ACTION_BLOCKED")
        .when((action == "fill_profile") & ~F.coalesce("_filled", no), "PROFILE_FIELD_EMPTY")
        .otherwise("ok")
    )
    return df.select("run_id", "step", verdict.alias("verdict"), "reasons")


def long_profiles(profiles: DataFrame) -> DataFrame:
    """(user_id, field, value) of profiles (user_id, full_name, email, phone): trimmed, blank ones left out."""
    long = profiles.select("user_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), X.blank_to_null(F.col(c)).alias("value")) for c in vocab.PROFILE_FIELDS])).alias("p"))
    return long.select("user_id", "p.field", "p.value").where("value is not null")


def fill_profile(actions: DataFrame, profiles: DataFrame) -> DataFrame:
    """(run_id, step, user_id, field, status, value_length) of fill_profile actions; the value itself never leaves the join."""
    want = actions.where("action = 'fill_profile'").select("run_id", "step", "user_id", F.col("profile_field").alias("field"))
    df = want.join(profiles.select("user_id", "field", "value"), ["user_id", "field"], "left")
    filled = X.blank_to_null(F.col("value"))
    return df.select("run_id", "step", "user_id", "field", F.when(filled.isNull(), "PROFILE_FIELD_EMPTY").otherwise("filled").alias("status"), F.coalesce(F.length(filled), F.lit(0)).alias("value_length"))
