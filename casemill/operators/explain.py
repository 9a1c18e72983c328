"""Additive contributions: linear scorer, ranking, masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIAS = "sesgo_base"


def linear_contributions(
    df: DataFrame, weights: Mapping[str, float], base: DataFrame | None = None
) -> DataFrame:
    """Add ``contributions`` (var, value, contrib), ``bias`` and ``margin`` of a linear scorer.

    A contribution is weight times distance to the mean of ``base`` (default: all rows),
    the exact additive attribution of a linear model; the parts add up to the margin.
    """
    names = list(weights)
    source = df if base is None else base
    means = source.agg(F.struct(*[F.avg(c).alias(c) for c in names])).scalar()
    staged = df.withColumn("_means", means)
    parts = [
        F.struct(
            F.lit(c).alias("var"),
            F.col(c).cast("double").alias("value"),
            (F.lit(float(w)) * (F.col(c) - F.col(f"_means.{c}"))).alias("contrib"),
        )
        for c, w in weights.items()
    ]
    bias = sum((F.lit(float(w)) * F.col(f"_means.{c}") for c, w in weights.items()), F.lit(0.0))
    margin = sum((F.lit(float(w)) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return staged.withColumns(
        {"contributions": F.array(*parts), "bias": bias, "margin": margin}
    ).drop("_means")


def ranked(contributions: Column, top: int, bias: Column | None = None) -> Column:
    """The ``top`` entries by magnitude; the bias competes with them when given."""
    entries = contributions
    if bias is not None:
        extra = F.struct(
            F.lit(BIAS).alias("var"), F.lit(None).cast("double").alias("value"), bias.alias("contrib")
        )
        entries = F.concat(contributions, F.array(extra))
    keyed = F.transform(
        entries,
        lambda e, i: F.struct(
            (-F.abs(e["contrib"])).alias("key"), i.alias("pos"), e["var"].alias("var"),
            e["value"].alias("value"), e["contrib"].alias("contrib"),
        ),
    )
    return F.transform(
        F.slice(F.sort_array(keyed), 1, top),
        lambda e: F.struct(e["var"].alias("var"), e["value"].alias("value"), e["contrib"].alias("contrib")),
    )


def masked_names(entries: Column, business: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """Rename business variables ``var_1..k`` in rank order; the rest keep their names."""

    def is_business(name: Column) -> Column:
        hit = name.isin(list(business))
        for p in prefixes:
            hit = hit | name.startswith(p)
        return hit

    return F.transform(
        entries,
        lambda e, i: F.struct(
            F.when(
                is_business(e["var"]),
                F.concat(
                    F.lit("var_"),
                    F.size(F.filter(F.slice(entries, 1, i + 1), lambda x: is_business(x["var"]))).cast("string"),
                ),
            ).otherwise(e["var"]).alias("var"),
            e["value"].alias("value"),
            e["contrib"].alias("contrib"),
        ),
    )
