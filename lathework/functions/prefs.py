"""Preferences, providers' models and token slots as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import NUMBER_PREFS, clamp_pref, let, to_bool

# Preferences that are switches or texts, and their defaults.
BOOL_PREFS = (
    ("sendGpsDate", True), ("usePathHint", False), ("dryRun", False), ("singleKeywordPerPhoto", False), ("clusterBursts", False), ("clusterUseStacks", True), ("showDetectionReport", False),
)
TEXT_PREFS = (("provider", "openai"), ("model", "gpt-4o"), ("promptAddition", ""))


def normalized(raw: Column) -> Column:
    """All preferences of a map of raw texts, as a struct in the order of the tables: absent ones have their defaults, others are clamped or coerced.

    A number that is no number gives the default; a text is taken as it is.
    """
    out = []
    for name, _, _, _, default in NUMBER_PREFS:
        value = raw[name]
        out.append(F.when(value.isNull(), F.lit(default)).otherwise(clamp_pref(F.lit(name), F.trim(value).try_cast("double"))).alias(name))
    out += [F.when(raw[n].isNull(), F.lit(d)).otherwise(to_bool(raw[n])).alias(n) for n, d in BOOL_PREFS]
    out += [F.coalesce(raw[n], F.lit(d)).alias(n) for n, d in TEXT_PREFS]
    return F.struct(*out)


def reconciled(chosen: DataFrame, models: DataFrame) -> DataFrame:
    """``chosen`` (provider, model, ...) with the model that stands: none or one that only another provider offers gives way to the provider's first.

    ``models`` is the catalog (provider, model, place). A model that no provider offers is the user's own and stays. An unknown provider has no first one.
    """
    first = models.groupBy("provider").agg(F.min_by("model", "place").alias("_first"))
    own = models.select("provider", "model", F.lit(True).alias("_own")).distinct()
    known = models.select("model", F.lit(True).alias("_known")).distinct()
    joined = chosen.join(own, ["provider", "model"], "left").join(known, "model", "left").join(first, "provider", "left")
    stays = (F.col("model") != "") & (F.col("_own").isNotNull() | F.col("_known").isNull())
    return joined.withColumn("model", F.when(stays, F.col("model")).otherwise(F.col("_first"))).select(*chosen.columns)


def is_valid_model(provider_known: Column, model: Column) -> Column:
    """Any text will do for a provider that is known."""
    return F.coalesce(provider_known & (model != ""), F.lit(False))


def token_status(read: Column, value: Column) -> Column:
    """keychain_error where the store could not be read, else set or absent."""
    return F.when(~F.coalesce(read, F.lit(False)), "keychain_error").when(value != "", "set").otherwise("absent")


def token_key(provider: Column, slot: Column) -> Column:
    """The name of a provider's token in a slot from 1 up; null for what is no whole number of at least 1."""
    whole = (slot == F.floor(slot)) & (slot >= 1)
    base = F.concat(provider, F.lit("_api_token"))
    return F.when(whole, let(base, lambda b: F.when(slot == 1, b).otherwise(F.concat(b, F.lit("_"), slot.cast("long").cast("string")))))


def needs_migration(order: Column, slot1: Column) -> Column:
    """Whether a token was stored before slots had an order."""
    return order.isNull() & (slot1 == "set")
