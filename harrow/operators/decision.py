"""Decisions over scored rows and the advisories that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels in order; what a life stage does to them; thresholds of confidence and of the affected share.
LEVELS = ("none", "info", "watch", "warning", "critical")
STAGE_SHIFT = {"egg": 0, "larva": 1, "nymph": 1, "adult": -1}
STAGE_ACTION = {"egg": "scout_and_time_treatment", "larva": "treat_affected_plants", "nymph": "treat_affected_plants", "adult": "monitor_and_count"}
ACTIONABLE = ("disease", "pest", "deficiency", "abiotic")
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.55, 0.85
WIDESPREAD, SPOT = 0.10, 0.02
MOST_TTL, USUAL_TTL = 72, 48
#: Constraint flags in order of consequence, with their kinds and phrases.
FLAGS = {
    "suspend": ("veto", "Do not water until this is sorted out."),
    "drain": ("drainage", "Drain the standing water first."),
    "no_overhead": ("method", "Do not wet the leaves - water at the base."),
    "prefer_furrow": ("method", "Water in the furrows or by drip, not over the crop."),
    "morning_only": ("timing", "Water early in the morning so the crop dries by evening."),
    "no_evening": ("timing", "Do not water in the evening."),
    "short_frequent": ("timing", "Split the watering into shorter turns."),
    "alternate_wet_dry": ("timing", "Let the field dry between waterings instead of keeping it flooded."),
    "no_late_season": ("timing", "Stop watering - do not stretch the crop any longer."),
    "avoid_stress": ("hint", "Do not let the crop go dry."),
}


def constants(m: dict, value=lambda v: v) -> Column:
    return F.create_map(*[F.lit(x) for k, v in m.items() for x in (k, value(v))])


def rank(level: Column) -> Column:
    """A level's place in LEVELS, from 0; unknown levels are 'watch'."""
    return F.coalesce(F.try_element_at(constants({n: i for i, n in enumerate(LEVELS)}), level), F.lit(2))


def level_name(r: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in LEVELS]), r)


def bump(r: Column, by) -> Column:
    """A rank moved by some steps, held inside the levels."""
    return F.least(F.greatest(r + by, F.lit(0)), F.lit(len(LEVELS) - 1))


def actionable(category: Column) -> Column:
    return F.coalesce(category.isin(*ACTIONABLE), F.lit(False))


def display_name(crop: Column, name: Column) -> Column:
    return F.when(crop.isNull() | (crop == "any"), name).otherwise(F.concat(F.initcap(crop), F.lit(" - "), name))


def urgency_rank(base: Column, category: Column, spread: Column, confidence: Column, severity: Column, fraction: Column, stage: Column) -> Column:
    """The urgency ladder: confidence, severity, affected share, life stage; each step is clamped before the next. Null inputs take no step."""
    acts = actionable(category)
    r = bump(rank(base), F.when(confidence < LOW_CONFIDENCE, -1).when((confidence >= HIGH_CONFIDENCE) & (spread >= 3), 1).otherwise(0))
    r = bump(r, F.when((severity == "severe") & acts, 1).otherwise(0))
    r = bump(r, F.when(acts & (fraction >= WIDESPREAD), 1).when(acts & (fraction <= SPOT), -1).otherwise(0))
    return bump(r, F.when(category == "pest", F.coalesce(F.try_element_at(constants(STAGE_SHIFT), stage), F.lit(0))).otherwise(0))


def advise(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (class_id, confidence, severity, affected_fraction, life_stage, ...) with the class's urgency, action, confirmation, constraint and notes.

    Classes are joined to themselves for the name of the pest that spreads them. Rows of unknown classes get an advisory to retake the picture.
    """
    vectors = classes.select(F.col("class_id").alias("vector"), F.lower("name").alias("vector_name"))
    known = rows.join(classes.join(vectors, "vector", "left"), "class_id", "left")
    r = urgency_rank(F.col("urgency"), F.col("category"), F.col("spread_rank"), F.col("confidence"), F.col("severity"), F.col("affected_fraction"), F.col("life_stage"))
    found, pest, low = F.col("category").isNotNull(), F.coalesce(F.col("category") == "pest", F.lit(False)), F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False))
    acts, share = actionable(F.col("category")), F.concat(F.round(F.col("affected_fraction") * 100).cast("int").cast("string"), F.lit("%"))
    notes = F.array_compact(F.array(
        F.when(low, "low confidence: take a second photo"), F.when((F.col("severity") == "severe") & acts, "severe: treat as a field-level problem"),
        F.when(acts & (F.col("affected_fraction") >= WIDESPREAD), F.concat(share, F.lit(" affected: field-wide"))).when(acts & (F.col("affected_fraction") <= SPOT), F.concat(share, F.lit(" affected: spot-treat"))),
        F.when(pest & F.col("life_stage").isin(*STAGE_SHIFT), F.concat(F.lit("stage: "), F.col("life_stage"))), F.concat(F.lit("spread by "), F.col("vector_name")),
        F.concat(F.lit("threshold "), F.col("etl_threshold").cast("int").cast("string"), F.lit(" "), F.replace("etl_unit", F.lit("_"), F.lit(" "))),
    ))
    out = known.withColumn("urgency_rank", F.when(found, r).otherwise(1)).withColumn("notes", F.when(found, notes).otherwise(F.array().cast("array<string>")))
    return out.withColumns({
        "level": level_name(F.col("urgency_rank")), "needs_confirmation": ~found | low | F.coalesce(F.col("spread_rank") >= 4, F.lit(False)),
        "final_action": F.when(~found, "retake_or_escalate").otherwise(F.coalesce(F.when(pest, F.try_element_at(constants(STAGE_ACTION), F.col("life_stage"))), "action", F.lit("scout_and_confirm"))),
        "display": F.when(found, display_name(F.col("crop"), F.col("name"))).otherwise("Not identified"),
        "ttl_hours": F.least(F.coalesce(F.nullif("recheck_hours", F.lit(0)), F.lit(USUAL_TTL)), F.lit(MOST_TTL)),
    })


def decide(scored: DataFrame, thresholds: DataFrame, least=0.30, margin=0.0, abstain="unknown") -> DataFrame:
    """scored (pred, p1, p2, is_novel) with accepted, reason and decided: novelty first, then the class's or the global threshold, then the margin.

    thresholds (pred, threshold) has rows only for classes with their own; it is joined from the left.
    """
    rows = scored.join(thresholds, "pred", "left").withColumn("threshold", F.coalesce("threshold", F.lit(least)))
    reason = F.when(F.col("is_novel"), "novel").when(F.col("p1") < F.col("threshold"), "below threshold").when((F.lit(margin) > 0) & (F.col("p1") - F.col("p2") < margin), "small margin").otherwise("")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "").withColumn("decided", F.when(F.col("accepted"), F.col("pred").cast("string")).otherwise(abstain))


def tile_grid(frames: DataFrame, tile=224, overlap=0.2, most=12) -> DataFrame:
    """(frame, i, l, t, r, b) for frames (frame, w, h): overlapping tiles, clamped to the edges, each once, thinned evenly to `most`.

    A grid is generated in the row; nothing is shuffled.
    """
    step = max(1, int(tile * (1 - overlap)))
    at = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(size - tile + step - 1, F.lit(0)), F.lit(step)), lambda x: F.least(x, F.greatest(size - tile, F.lit(0)))))
    w, h = F.col("w").cast("int"), F.col("h").cast("int")
    boxes = F.flatten(F.transform(at(h), lambda t: F.transform(at(w), lambda l: F.struct(l.alias("l"), t.alias("t"), F.least(l + tile, w).alias("r"), F.least(t + tile, h).alias("b")))))
    rows = frames.select("frame", boxes.alias("x")).withColumn("n", F.size("x"))
    keep = F.when(F.col("n") <= most, F.col("x")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("x", F.floor(i * (F.col("n") / F.lit(float(most)))).cast("int"))))
    return rows.select("frame", F.posexplode(keep).alias("i", "b")).select("frame", "i", "b.*")


def roll_up_frames(tiles: DataFrame) -> DataFrame:
    """(frame, tiles, tiles_actionable, dominant_class, affected_fraction, mean_confidence) of tiles (frame, class_id, confidence, acts); a frame with none that acts has no dominant class and share 0."""
    totals = tiles.groupBy("frame").agg(F.count(F.lit(1)).alias("tiles"), F.count_if("acts").alias("tiles_actionable"))
    each = tiles.where("acts").groupBy("frame", "class_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"), F.avg("confidence").alias("mean"))
    best = each.groupBy("frame").agg(F.max_by(F.struct("class_id", "n", "mean"), F.struct("n", "top", "class_id")).alias("b"))
    return totals.join(best, "frame", "left").select("frame", "tiles", "tiles_actionable", F.col("b.class_id").alias("dominant_class"), F.coalesce(F.col("b.n") / F.col("tiles"), F.lit(0.0)).alias("affected_fraction"), F.col("b.mean").alias("mean_confidence"))


def shorten(text: Column, limit=160) -> Column:
    """A text of at most limit characters, cut at the last space, without punctuation at the cut, and '...'."""
    head = F.substring(text, 1, limit - 3)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"[ ,.;:]+$", ""), F.lit("...")))


def category_note(reason: Column, category: Column, confidence: Column, least=0.30) -> Column:
    """What an abstained row may still say: its category, if that is sure and not healthy; a novel row says nothing."""
    say = ~reason.isin("", "novel") & (category != "healthy") & (confidence >= least)
    return F.when(say, F.concat(F.lit("treat as a "), category, F.lit(" problem"))).otherwise("")


def gated_heads(category: Column, severity: Column, life_stage: Column) -> tuple[Column, Column]:
    """The severity only for what can be acted on, the life stage only for pests; else null."""
    return F.when(category.isin(*ACTIONABLE), severity), F.when(category == "pest", life_stage)


def closest_note(names: list[Column], probabilities: list[Column]) -> Column:
    """The candidates of an uncertain row, best first, with their probabilities in percent; a missing candidate is left out."""
    each = [F.when(n.isNotNull() & p.isNotNull(), F.format_string("%s (%d%%)", n, F.round(p * 100).cast("int"))) for n, p in zip(names, probabilities)]
    return F.concat(F.lit("Closest matches: "), F.concat_ws(", ", *each), F.lit("."))


def spoken(headline: Column, phrase: Column, message: Column) -> Column:
    """Up to three different lines: headline, first constraint phrase, first sentence."""
    first = F.concat(F.trim(F.split_part(message, F.lit("."), F.lit(1))), F.lit("."))
    return F.slice(F.array_distinct(F.array_compact(F.array(F.nullif(headline, F.lit("")), F.nullif(phrase, F.lit("")), first))), 1, 3)


def composed_message(category: Column, crop: Column, name: Column, agent: Column, symptoms: Column) -> Column:
    """What to tell a farmer about a class that has no written message."""
    sign = F.regexp_replace(F.trim(F.split_part(symptoms, F.lit(";"), F.lit(1))), r"\.+$", "")
    by = F.when(agent.isNotNull() & category.isin("disease", "pest"), F.concat(F.lit(" ("), agent, F.lit(")"))).otherwise("")
    healthy = F.concat(F.when(crop == "any", "The crop").otherwise(F.initcap(crop)), F.lit(" looks healthy. Continue normal monitoring."))
    return F.when(category == "healthy", healthy).when(category == "background", "No crop leaf detected in the photo.").otherwise(F.concat(display_name(crop, name), F.lit(" detected"), by, F.lit(". Signs to confirm: "), sign, F.lit(".")))


def localised(keys: DataFrame, messages: DataFrame, default="en") -> DataFrame:
    """keys (key, lang) with text: in the language, else in the default one, else the key's words. messages (key, lang, text)."""
    fallback = messages.where(F.col("lang") == default).select("key", F.col("text").alias("_default"))
    return keys.join(messages, ["key", "lang"], "left").join(fallback, "key", "left").withColumn("text", F.coalesce("text", "_default", F.replace("key", F.lit("_"), F.lit(" ")))).drop("_default")
