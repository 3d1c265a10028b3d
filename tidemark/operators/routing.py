"""How a release gets its subtitle: a flow of stages over many releases, each of which only those reach that are still open.

Every stage evaluates ranked candidates by some evidence: in waves, best names first, until one is good enough. A source track
that fits what was said vouches for a target track by their times; a source that no target fits is set aside, by id and by
content, and the next one is tried. Then a track in another language that fits the activity may vouch; then activity alone
decides, by a higher bar where a trusted track has already rejected the targets; then a translation of the first source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .flow import OVERRIDE_ADDS, OVERRIDE_BAR, OVERRIDE_RANK, OVERRIDE_STEP, SOURCES
from .release import seats

# Candidates looked at, how far above the bar ends a search at once and where that counts in any case, waves that go on after the first accepted one, weights of confidence and rank.
LOOKED_AT, STRONG_STEP, STRONG, MORE_WAVES, BY_CONFIDENCE, BY_SCORE = 10, 15, 90, 1, 0.82, 0.18
CANDIDATE = ["release", "position", "candidate", "content", "provider", "score", "confidence", "settles"]


def winner(positions: list, providers: list, scores: list, confidences: list, bar: int):
    """The position of the candidate that a search in waves ends with, or None."""
    places = seats(providers, 3)
    accepted, stop = [], None
    for i in sorted(range(len(positions)), key=lambda i: places[i]):
        wave = places[i][0]
        if stop is not None and wave > stop:
            break
        if confidences[i] >= bar:
            accepted.append(i)
        if accepted:
            first = places[accepted[0]][0]
            strong = max(confidences[k] for k in accepted if places[k][0] == first) >= min(STRONG, bar + STRONG_STEP)
            stop = first if strong else first + MORE_WAVES
    return positions[max(accepted, key=lambda i: (BY_CONFIDENCE * confidences[i] + BY_SCORE * scores[i], -places[i][0], -places[i][1]))] if accepted else None


def evaluated(candidates: DataFrame, bar: int) -> DataFrame:
    """candidates (CANDIDATE; position ranks a release's candidates) to the one of each release that wins, if any does. A release's list is cut to LOOKED_AT, so it is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            best = [winner(*[[x[c] for x in listed] for c in ("position", "provider", "score", "confidence")], bar) for listed in rows["listed"]]
            yield pd.DataFrame({"release": rows["release"], "position": pd.array(best, dtype="Int64")})

    each = F.struct("position", "provider", "score", "confidence")
    listed = candidates.groupBy("release").agg(F.slice(F.array_sort(F.collect_list(each)), 1, LOOKED_AT).alias("listed"))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    best = listed.mapInPandas(run, f"release {kinds['release']}, position {kinds['position']}").where("position is not null")
    return candidates.select(CANDIDATE).join(best, ["release", "position"])


def without(candidates: DataFrame, barred: DataFrame | None) -> DataFrame:
    """Candidates whose id and content are not among barred (release, what); places in the ranking stay."""
    if barred is None:
        return candidates
    left = candidates
    for c in ("candidate", "content"):
        left = left.join(barred.where(F.col("kind") == c).select("release", F.col("what").alias(c)), ["release", c], "left_anti")
    return left.select(candidates.columns)


def complete(requests: DataFrame, sources: DataFrame, targets: DataFrame, fallbacks: DataFrame, against: Callable[[DataFrame, DataFrame], DataFrame], bar: int = 58, activity_bar: int = 70) -> DataFrame:
    """(release, outcome, route, candidate, confidence, attempts, reason) of every request.

    requests: release, cached, spoken (the target language is the spoken one), asked (for a translation), mode (of
    translation: off, manual or auto), translation_settles. sources, targets, fallbacks: CANDIDATE, with confidence by what
    was said for sources and by activity for the others; settles: whether its times, once found, stand on the speech.
    against(chosen, targets): targets with their confidence against the chosen track of their release.
    """
    told = ["outcome", "route", "candidate", "confidence", "attempts", "reason"]

    def out(df: DataFrame, outcome: str, route: str | None, confidence, attempts, reason=None) -> DataFrame:
        values = [F.lit(outcome), F.lit(route).cast("string"), F.col("candidate") if "candidate" in df.columns else F.lit(None).cast("string"), confidence, attempts, F.lit(reason).cast("string") if not hasattr(reason, "alias") else reason]
        kinds = ["string", "string", "string", "int", "int", "string"]
        return df.select("release", *[v.cast(k).alias(c) for v, k, c in zip(values, kinds, told)])

    none = F.lit(None)
    lesser = F.least("confidence", "vouched")
    done = [out(requests.where("cached"), "cached", None, none, F.lit(0))]
    new = requests.where("not cached")
    open_ = new.where("not asked").select("release", "spoken")
    vouching = lambda chosen: chosen.select("release", F.col("confidence").alias("vouched"))
    barred, left = None, []
    for k in range(1, SOURCES + 1):
        chosen = cut(evaluated(without(sources.join(open_.select("release"), "release", "left_semi"), barred), bar).join(open_, "release"))
        left.append(open_.join(chosen.select("release"), "release", "left_anti").select("release", F.lit(k - 1).alias("attempts")))
        itself = chosen.where("spoken and settles")
        rest = chosen.where("not (spoken and settles)")
        fit = cut(evaluated(against(rest, targets), bar).where("settles").join(vouching(rest), "release"))
        done += [out(itself, "direct", "source", F.col("confidence"), F.lit(k)), out(fit, "direct", "source", lesser, F.lit(k))]
        open_ = rest.join(fit.select("release"), "release", "left_anti").select("release", "spoken")
        tried = rest.select("release", F.explode(F.array(F.struct(F.lit("candidate").alias("kind"), F.col("candidate").alias("what")), F.struct(F.lit("content").alias("kind"), F.col("content").alias("what")))).alias("b")).select("release", "b.*").where("what is not null")
        barred = tried if barred is None else barred.union(tried)
    left.append(open_.select("release", F.lit(SOURCES).alias("attempts")))
    unresolved = left[0]
    for more in left[1:]:
        unresolved = unresolved.union(more)
    unresolved = cut(unresolved)

    # Tracks of other languages vouch, by activity; then activity alone.
    here = lambda df: df.join(unresolved.select("release"), "release", "left_semi")
    reference = cut(evaluated(here(fallbacks), activity_bar))
    matched = cut(evaluated(against(reference, targets), bar).join(vouching(reference), "release").join(unresolved, "release"))
    done.append(out(matched.where("settles"), "direct", "reference", lesser, F.col("attempts")))
    heard = unresolved.join(matched.select("release"), "release", "left_anti").join(reference.select("release", F.lit(True).alias("referenced")), "release", "left")
    heard = heard.withColumn("trusted", (F.col("attempts") > 0) | F.col("referenced").isNotNull())
    trusted, alone = heard.where("trusted").select("release", "attempts"), heard.where("not trusted").select("release", "attempts")
    over = evaluated(targets.join(trusted, "release", "left_semi"), max(OVERRIDE_BAR, activity_bar + OVERRIDE_STEP)).where(F.col("score") >= OVERRIDE_RANK).join(trusted, "release")
    lone = evaluated(targets.join(alone, "release", "left_semi"), activity_bar).join(alone, "release")
    by_audio = cut(over.withColumn("sure", F.least("confidence", F.col("score") + OVERRIDE_ADDS)).union(lone.withColumn("sure", F.col("confidence"))).where("settles"))
    done.append(out(by_audio, "direct", "audio", F.col("sure"), F.col("attempts")))

    # A translation of the first source, or a refusal.
    served = matched.where("settles").select("release").union(by_audio.select("release"))
    late = unresolved.join(served, "release", "left_anti").union(new.where("asked").select("release", F.lit(0).alias("attempts")))
    late = cut(late.join(new.drop("cached"), "release"))
    first = evaluated(sources.join(late.select("release"), "release", "left_semi"), bar)
    both = late.join(first.select("release", "candidate", "confidence"), "release", "left")
    reason = (
        F.when(F.col("candidate").isNull(), "no source matched")
        .when((F.col("mode") == "off") | ((F.col("mode") == "manual") & ~F.col("asked")), "translation not requested")
        .when(F.col("spoken"), "same language")
        .when(~F.col("translation_settles"), "translation off the speech")
    )
    both = cut(both.withColumn("why", reason))
    done.append(out(both.where("why is null"), "translated", "source", F.col("confidence"), F.col("attempts")))
    done.append(out(both.where("why is not null").drop("candidate"), "failed", None, none, F.col("attempts"), F.col("why")))
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    return whole
