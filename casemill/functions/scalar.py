"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemill import constants as K


def risk_tier(prob: Column) -> Column:
    return (
        F.when(prob >= K.HIGH_FROM, K.TIER_HIGH)
        .when(prob >= K.MEDIUM_FROM, K.TIER_MEDIUM)
        .otherwise(K.TIER_LOW)
    )


def hour_of_day(seconds: Column) -> Column:
    return (seconds / 3600.0) % 24.0


def fractional_hour(ts: Column) -> Column:
    """Hour plus minutes; seconds are ignored on purpose."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def age_years(at: Column, born: Column) -> Column:
    return F.datediff(at, born) / F.lit(365.25)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def ratio(num: Column, den: Column) -> Column:
    """``num / max(den, 1)``."""
    return num / F.greatest(den, F.lit(1))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def direction(contribution: Column) -> Column:
    """Zero counts as legitimate."""
    return F.when(contribution > 0, "hacia FRAUDE").otherwise("hacia LEGITIMA")


def action_for(verdict: Column) -> Column:
    return (
        F.when(verdict == K.DISMISSED, "Archivar")
        .when(verdict == K.CONFIRMED, "Bloquear tarjeta")
        .otherwise("Revisar manualmente")
    )


def verdict_label(verdict: Column) -> Column:
    return (
        F.when(verdict == K.DISMISSED, "Descartado")
        .when(verdict == K.CONFIRMED, "Confirmado")
        .otherwise("Sin veredicto")
    )


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """Fixed-point text, with a leading plus when ``signed``.

    Ties are decided on the exact binary value, as C and Python do; ``format_string``
    would round the shortest decimal form instead.
    """
    form = "0." + "0" * digits
    pattern = f"+{form};-{form}" if signed else form
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def right_aligned(text: Column, width: int) -> Column:
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))
