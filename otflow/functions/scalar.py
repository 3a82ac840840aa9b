"""Column functions of the domain. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def filled(c, default: float = 0.0) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default)).cast("double")


def safe_duration(c: Column, eps: float = 0.001) -> Column:
    return F.when(c == 0, eps).otherwise(c)


def over_one_more(x: Column, y: Column) -> Column:
    """x / (y + 1)."""
    return F.try_divide(x, y + 1)


def over_at_least(x: Column, y: Column, least: float = 1.0) -> Column:
    """x / max(y, least)."""
    return x / F.greatest(y, F.lit(least))


def confidence(v: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.lit(0.5)
    return F.least(F.greatest(0.5 + 0.5 * (v - low) / (high - low), F.lit(0.5)), F.lit(1.0))


def sigmoid(x: Column, k: float = 0.5, middle: float = 3.0) -> Column:
    return 1 / (1 + F.exp(-k * (x - middle)))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """NULL, NaN and infinities to 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | x.isin(INF, -INF), 0.0).otherwise(x)


def sanitize(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def severity_from_score(score: Column, anomalous: Column) -> Column:
    a = F.abs(score)
    return F.when(~anomalous, "NORMAL").when(a > 0.6, "CRITICAL").when(a > 0.5, "HIGH").when(a > 0.4, "MEDIUM").otherwise("LOW")


def zone_of_port(port: Column) -> Column:
    return F.when(port.isin(502, 20000), "Level 1 - Process Control").when(port.isin(44818, 2222), "Level 1 - Field Devices").when(port.isin(80, 443, 8080), "Level 2 - Supervisory Control").otherwise("Level 3 - Enterprise Network")


def zone_severity(port: Column, score: Column) -> Column:
    a = F.abs(score)
    base = F.when(port.isin(502, 20000), "CRITICAL").when(port.isin(44818, 2222), "HIGH").when(port.isin(80, 443, 8080), "MEDIUM").otherwise("LOW")
    return F.when(a > 0.6, "CRITICAL").when(a > 0.5, "HIGH").otherwise(base)


def recommended_action(severity: Column, anomalous: Column) -> Column:
    # fixed values: the texts of the actions
    return (
        F.when(~anomalous, "No action required - normal traffic")
        .when(severity == "CRITICAL", "IMMEDIATE: Isolate affected zone, activate incident response")
        .when(severity == "HIGH", "Investigate immediately, consider traffic blocking")
        .when(severity == "MEDIUM", "Monitor closely, log for investigation")
        .when(severity == "LOW", "Log and review during routine audit")
        .otherwise("Monitor and log")
    )


def cvss_severity(score: Column) -> Column:
    return F.when(score.isNull(), "UNKNOWN").when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def cvss_to_sl(score: Column) -> Column:
    """Bands closed on both sides; the higher one wins where they meet."""
    return F.when(score.isNull(), "SL-1").when(score.between(9, 10), "SL-4").when(score.between(7, 9), "SL-3").when(score.between(4, 7), "SL-2").otherwise("SL-1")


def byte_at(payload: Column, at: int) -> Column:
    """Unsigned byte, counted from 0; null beyond the end."""
    return F.when(F.length(payload) > at, F.conv(F.hex(F.substring(payload, at + 1, 1)), 16, 10).cast("int"))


def u16be(payload: Column, at: int) -> Column:
    return byte_at(payload, at) * 256 + byte_at(payload, at + 1)


def u16le(payload: Column, at: int) -> Column:
    return byte_at(payload, at + 1) * 256 + byte_at(payload, at)


def hex_label(x: Column) -> Column:
    return F.format_string("0x%02X", x)


def title(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def cut(x: Column, n: int) -> Column:
    """The first n letters."""
    return F.substring(x, 1, n)


def percent_text(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double; TIMESTAMP_NTZ is taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def parse_timestamp(text: Column) -> Column:
    """Failures are null."""
    return F.try_to_timestamp(text)


def entropy_hist(values: Column, bins: int = 10) -> Column:
    """Entropy in bits of ``bins`` equal bins between the least and largest of an array; 0 below two values or without spread."""
    low, high, n = F.array_min(values), F.array_max(values), F.size(values)
    index = F.transform(values, lambda x: F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(index, lambda i: i == b)) / n)
    total = F.aggregate(F.filter(counts, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when((n < 2) | (low == high) | low.isNull(), 0.0).otherwise(total)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Like :func:`rounded`, in plain double arithmetic with ties a hair above the half, so that other engines agree on exact ties."""
    step = float(10**digits)
    return df.select(*[(F.floor(F.col(f"`{c}`") * step + 0.5000001) / step).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
