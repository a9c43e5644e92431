"""Player names, chat lines, zone labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: characters allowed in names, length limits
NAME_FORBIDDEN = "[^a-zA-Z0-9- _éèàçùâêîôûäëïöüÿ]"
NAME_SPACES = " {2,}"
NAME_MIN, NAME_MAX = 4, 32
# fixed values: channels in enum order, and the colour of each channel number
CHANNELS = ("GENERAL", "DIRECT_MESSAGE", "GROUP", "ALLIANCE", "REGION", "UNSPECIFIED")
CHANNEL_COLORS = {"0": "FFFFFF", "5": "AAAAAA", "2": "27C8F5", "3": "D327F5", "4": "F7F3B5", "1": "79F25E"}
UNSPECIFIED = 5
# fixed value: a bound at this distance counts as unlimited
UNLIMITED = 10000000.0


def clean_player_name(raw: Column) -> Column:
    """Drop characters outside the allowed set, then shrink runs of spaces to one."""
    return F.regexp_replace(F.regexp_replace(raw, NAME_FORBIDDEN, ""), NAME_SPACES, " ")


def accept_player_name(name: Column, default: Column | str) -> Column:
    """First 32 characters of a non-blank name of at least 4; else the name kept so far."""
    keep = F.lit(default) if isinstance(default, str) else default
    good = (F.trim(name) != "") & (F.length(name) >= NAME_MIN)
    return F.when(good, F.substring(name, 1, NAME_MAX)).otherwise(keep)


def number_text(value: Column) -> Column:
    """Shortest text that reads back as the same DOUBLE, with at least one digit after the point.

    Without exponent from 1e-20 up to 1e20; beyond that the exponent stays.
    """

    def plain(kind: str) -> Column:
        digits = F.rtrim(text.try_cast(kind).cast("string"), F.lit("0"))
        return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    text, size = value.cast("string"), F.abs(value)
    return F.when((size >= 1e7) & (size < 1e20), plain("decimal(38,17)")).when((size < 1e-3) & (size >= 1e-20), plain("decimal(38,37)")).otherwise(text)


def zone_label(df: DataFrame, name: str = "label") -> DataFrame:
    """Text of the zone bounds; an unlimited bound prints as ∞."""

    def bound(column: str) -> Column:
        value = F.col(column)
        return F.when(F.abs(value) == UNLIMITED, F.lit("∞")).otherwise(number_text(value))

    parts: list[Column] = [F.lit("Server zone")]
    for axis in "xyz":
        parts += [F.lit(f" | {axis} "), bound(f"{axis}_start"), F.lit(" -> "), bound(f"{axis}_end")]
    return df.withColumn(name, F.concat(*parts, F.lit(" |")))


def text_color(text: Column) -> Column:
    """Fixed colour for channel numbers, else the first six hex digits of the text's SHA-256."""
    fixed = F.create_map(*[F.lit(v) for pair in CHANNEL_COLORS.items() for v in pair])
    return F.coalesce(F.try_element_at(fixed, text), F.substring(F.sha2(text, 256), 1, 6))


def format_chat_line(
    df: DataFrame,
    name: str = "line",
    at: str = "ts",
    author: str = "author",
    channel: str = "channel",
    content: str = "content",
) -> DataFrame:
    """``[hh:mm:ss] : author (CHANNEL) content``; no tag for UNSPECIFIED and unknown channels."""
    names = F.create_map(*[F.lit(v) for pair in enumerate(CHANNELS) for v in pair])
    tag = F.when(F.col(channel) == UNSPECIFIED, F.lit("")).otherwise(
        F.coalesce(F.concat(F.lit("("), F.try_element_at(names, F.col(channel).cast("int")), F.lit(") ")), F.lit(""))
    )
    stamp = F.date_format(F.col(at), "HH:mm:ss")
    line = F.concat(F.lit("["), stamp, F.lit("] : "), F.col(author), F.lit(" "), tag, F.col(content))
    return df.withColumn(name, line)
