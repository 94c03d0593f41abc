"""Column rules for frame rates and timecodes; bad values give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RATE = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(df|drop|ndf|nd)?\s*$"
_CODE = r"^\s*(\d+):(\d{1,2}):(\d{1,2})[:;.](\d{1,3})\s*$"


def parse_rate(spec: Column) -> Column:
    """``struct<fps, nominal, drop>``; pulldown rates snap to n*1000/1001, drop frame needs a multiple of 30."""
    fps = F.regexp_extract(spec, _RATE, 1).try_cast("double")
    drop = F.lower(F.regexp_extract(spec, _RATE, 2)).isin("df", "drop")
    nominal = F.bround(fps).cast("int")
    pulldown = nominal * 1000.0 / 1001.0
    ok = (nominal > 0) & (~drop | (nominal % 30 == 0))
    return F.when(ok, F.struct(F.when(F.abs(fps - pulldown) < 0.02, pulldown).otherwise(fps).alias("fps"), nominal.alias("nominal"), drop.alias("drop")))


def _dropped(rate: Column) -> Column:
    return F.when(rate["drop"], F.floor(rate["nominal"] / 15)).otherwise(F.lit(0)).cast("long")


def timecode_to_frames(code: Column, rate: Column) -> Column:
    h, m, s, f = (F.regexp_extract(code, _CODE, k).try_cast("long") for k in (1, 2, 3, 4))
    d, minutes = _dropped(rate), h * 60 + m
    total = (minutes * 60 + s) * rate["nominal"] + f - d * (minutes - F.floor(minutes / 10))
    return F.when((f < rate["nominal"]) & ~((d > 0) & (s == 0) & (minutes % 10 != 0) & (f < d)), total)


def frames_to_timecode(frames: Column, rate: Column) -> Column:
    d, n = _dropped(rate), rate["nominal"].cast("long")
    ten, one = n * 600 - d * 9, n * 60 - d
    rest = frames % ten
    label = frames + d * 9 * F.floor(frames / ten) + F.when(rest >= d, d * F.floor((rest - d) / one)).otherwise(F.lit(0))
    label = F.when(d > 0, label).otherwise(frames)
    t = F.floor(label / n)
    return F.when(frames >= 0, F.format_string("%02d:%02d:%02d%s%02d", F.floor(t / 3600), F.floor(t / 60) % 60, t % 60, F.when(rate["drop"], ";").otherwise(":"), label % n))


def seconds_to_frames(seconds: Column, rate: Column, mode: str = "round") -> Column:
    """Half to even, down or up; nothing below zero."""
    exact = seconds * rate["fps"]
    turned = {"round": F.bround(exact), "floor": F.floor(exact), "ceil": F.ceil(exact)}[mode]
    return F.when(seconds <= 0, F.lit(0)).otherwise(turned).cast("long")


def duration_frames(seconds: Column, stored: Column, code: Column, frames: Column, rate: Column) -> Column:
    """Frames of a clip: of its duration, else as stored, else of its duration timecode, else of its frames as text, else none.

    A source that gives none, or not above zero, hands on to the next.
    """
    known = [seconds_to_frames(seconds, rate, "floor"), stored.cast("long"), timecode_to_frames(code, rate), F.trim(frames).try_cast("long")]
    return F.coalesce(F.get(F.filter(F.array(*known), lambda x: x > 0), F.lit(0)), F.lit(0).cast("long"))


def source_range(duration: Column, lead: Column, trail: Column, rate: Column, trim: bool = True, pad: float = 0.04) -> Column:
    """``struct<first, last>`` of the frames to place, last exclusive; unknown is one frame."""
    total = seconds_to_frames(duration, rate, "floor")
    first = F.least(total - 1, F.floor(F.greatest(lead - pad, F.lit(0.0)) * rate["fps"]))
    last = F.least(total, F.ceil((duration - F.greatest(trail - pad, F.lit(0.0))) * rate["fps"]))
    whole = F.struct(F.lit(0).cast("long").alias("first"), total.alias("last"))
    cut = F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))
    unknown = F.struct(F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("last"))
    usable = F.lit(trim) & lead.isNotNull() & trail.isNotNull() & (first < last)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, unknown).when(usable, cut).otherwise(whole)
