"""Scalar functions over columns: token cost, budgets, time codes, links, ladders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: pixels of a visual token's edge; longest edge that is not scaled down
PATCH = 28
LONG_EDGE, LONG_EDGE_HIGHRES = 1568, 2576
FRAMES_PER_CALL = 8
#: fixed values: moments a minute, least and most moments of a series
PER_MINUTE, LEAST_MOMENTS, MOST_MOMENTS = 6.0, 40, 600
#: fixed values: seconds under which a series is short, and the parts it is then cut into
SHORT_SERIES, SHORT_PARTS = 180.0, 12.0
#: fixed values: waits of a client before each try, clients in order, lower heights, bytes of a range, days
WAITS = (0, 5, 15, 45)
CLIENTS = ("default", "android", "ios", "web_safari")
LOWER_HEIGHTS = (720, 480, 360)
RANGE_BYTES = 32 << 20
STALE_DAYS = 120


def image_tokens(width: Column, height: Column) -> Column:
    """Visual tokens of an image; sizes that are not positive raise an error."""
    n = F.ceil(width / PATCH) * F.ceil(height / PATCH)
    return F.when((width > 0) & (height > 0), n).otherwise(F.raise_error(F.lit("image sizes must be positive")).cast("bigint"))


def fit_to_tier(width: Column, height: Column, highres: bool = False) -> tuple[Column, Column]:
    """Sizes after the long edge is brought to the tier's limit; fractions are cut, 1 at least."""
    limit = LONG_EDGE_HIGHRES if highres else LONG_EDGE
    edge = F.greatest(width, height)
    side = lambda x: F.when(edge <= limit, x.cast("int")).otherwise(F.greatest(F.lit(1), (x * (F.lit(float(limit)) / edge)).cast("int")))
    return side(width), side(height)


def effective_tokens(width: Column, height: Column, highres: bool = False) -> Column:
    return image_tokens(*fit_to_tier(width, height, highres))


def scaled_height(source_width: Column, source_height: Column, width: Column) -> Column:
    """Height at a width: rounded half to even, then made even, 2 at least."""
    h = F.rint(source_height * width / source_width).cast("int")
    return F.greatest(F.lit(2), h - F.pmod(h, F.lit(2)))


def budget_plan(moments: Column, width: Column, source_width: Column, source_height: Column, highres: bool = False) -> Column:
    """What showing so many moments costs, as a struct."""
    height = scaled_height(source_width, source_height, width)
    per = effective_tokens(width, height, highres)
    return F.struct(width.alias("width"), height.alias("height"), per.alias("tokens"), moments.alias("moments"), (per * moments).alias("tokens_all"), (per * FRAMES_PER_CALL).alias("tokens_call"))


def moment_budget(seconds: Column) -> Column:
    return F.least(F.lit(MOST_MOMENTS), F.greatest(F.lit(LEAST_MOMENTS), F.rint(seconds / 60 * PER_MINUTE).cast("int")))


def gap_target(seconds: Column, max_gap: float) -> Column:
    """The longest stretch that may stay without a moment, less on short series."""
    return F.when(seconds < SHORT_SERIES, F.least(F.lit(max_gap), F.greatest(F.lit(1.0), seconds / SHORT_PARTS))).otherwise(F.lit(max_gap))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def timecode(seconds: Column) -> Column:
    """``H:MM:SS.s`` or ``M:SS.s``; a null is ``?``. Tenths are rounded half to even after hours and minutes are cut."""
    s = F.abs(seconds)
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60)
    tenths = F.rint(F.pmod(s, F.lit(60.0)) * 10).cast("bigint")
    rest = F.concat(_two(F.floor(tenths / 10)), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    text = F.when(hours > 0, F.concat_ws(":", hours.cast("string"), _two(minutes), rest)).otherwise(F.concat_ws(":", minutes.cast("string"), rest))
    return F.when(seconds.isNull(), "?").otherwise(F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def timecode_short(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS`` of seconds rounded half to even."""
    s = F.rint(seconds).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    text = F.when(hours > 0, F.concat_ws(":", hours.cast("string"), _two(minutes), _two(rest))).otherwise(F.concat_ws(":", minutes.cast("string"), _two(rest)))
    return F.when(seconds.isNotNull(), text)


def parse_timecode(value: Column, strict: bool = False) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S``, each with a fraction or not; others are null, or raise if ``strict``."""
    v = F.trim(value.cast("string"))
    parts = F.transform(F.split(v, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    bad = F.raise_error(F.concat(F.lit("not a time code: "), v)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(v.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){0,2}$"), total).otherwise(F.when(v.isNotNull(), bad))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function gives."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def slug(text: Column, limit: int = 60, composed: bool = True) -> Column:
    """A folder name: letters of any script stay, signs go, spaces become hyphens. ``composed`` brings texts to NFKC first."""
    t = nfkc(text) if composed else text
    t = F.regexp_replace(F.trim(t), r"(?U)[^\w\s-]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_]+", "-"), r"^-+|-+$", "")
    t = F.regexp_replace(F.substring(t, 1, limit), r"-+$", "")
    return F.lower(F.when(t == "", "video").otherwise(t))


def moment_link(url: Column, seconds: Column) -> Column:
    """A link to a moment: ``?t=`` or ``&t=`` where the host knows it, else ``#t=``."""
    s = seconds.cast("bigint").cast("string")
    hosted = url.contains("youtube.com") | url.contains("youtu.be")
    return F.when(hosted, F.concat(url, F.when(url.contains("?"), "&t=").otherwise("?t="), s)).otherwise(F.concat(F.coalesce(url, F.lit("")), F.lit("#t="), s))


def ratio(value: Column) -> Column:
    """A number or a fraction as text; 0 where it is neither."""
    whole = F.when(value.contains("/"), F.try_divide(F.split_part(value, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(value, F.lit("/"), F.lit(2)).try_cast("double"))).otherwise(value.try_cast("double"))
    return F.coalesce(whole, F.lit(0.0))


def variable_rate(rate: Column, average: Column) -> Column:
    """Whether two frame rates differ by more than one in a hundred."""
    return F.coalesce(F.try_divide(F.abs(average - rate), F.greatest(average, rate)) > 0.01, F.lit(False))


def iso_duration(value: Column) -> Column:
    """Seconds of ``PT#H#M#S``; days are read over; 0 where it is no such text."""
    pattern = r"^P(?:\d+D)?T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?"
    part = lambda i: F.coalesce(F.regexp_extract(value, pattern, i).try_cast("double"), F.lit(0.0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0.0))


def cue_midpoint(start_ms: Column, end_ms: Column) -> Column:
    """Middle of a cue, of its first six seconds at most, in milliseconds rounded half to even."""
    return F.rint((start_ms + F.least(end_ms, start_ms + 6000)) / 2).cast("bigint")


def range_plan(done: Column, size: Column, step: int = RANGE_BYTES) -> Column:
    """Byte ranges, ends included, that are left of a download; what is beyond the size starts anew."""
    first = F.when(done > size, F.lit(0)).otherwise(done).cast("bigint")
    starts = F.when(first < size, F.sequence(first, size.cast("bigint") - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda a: F.struct(a.alias("first"), (F.least(a + step, size.cast("bigint")) - 1).alias("last")))


def is_rate_limit(message: Column) -> Column:
    return message.rlike("429|Too Many Requests")


def is_forbidden(message: Column) -> Column:
    return message.rlike("403|Forbidden")


def video_formats(max_height: Column) -> Column:
    """Formats to try in turn: by height, then lower ones."""
    h = max_height.cast("string")
    first = F.array(F.concat(F.lit("bv*[height<="), h, F.lit("][ext=mp4]")), F.concat(F.lit("bv*[height<="), h, F.lit("]")), F.concat(F.lit("b[height<="), h, F.lit("]")))
    lower = F.filter(F.array(*[F.lit(x) for x in LOWER_HEIGHTS]), lambda x: x < max_height)
    return F.concat(first, F.transform(lower, lambda x: F.concat(F.lit("b[height<="), x.cast("string"), F.lit("]"))))


def audio_formats() -> Column:
    return F.array(F.lit("ba"), F.lit("bestaudio"), F.lit("best"))


def retry_schedule(spark: SparkSession) -> DataFrame:
    """``attempt, client, wait``: all waits of one client, then the next one's."""
    steps = [(i * len(WAITS) + j, c, w) for i, c in enumerate(CLIENTS) for j, w in enumerate(WAITS)]
    return spark.createDataFrame(steps, "attempt int, client string, wait int")


def is_stale(version: Column, today: Column) -> Column:
    """Whether a version ``YYYY.MM.DD`` is over STALE_DAYS old; other versions never are."""
    day = F.try_to_timestamp(F.regexp_extract(version, r"^(\d{4}\.\d{1,2}\.\d{1,2})", 1), F.lit("yyyy.M.d")).cast("date")
    return F.coalesce(F.datediff(today, day) > STALE_DAYS, F.lit(False))


def short_line(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)
