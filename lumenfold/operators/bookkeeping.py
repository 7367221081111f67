"""Batch bookkeeping: what is current, what collides, what must go, which settings are wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranged, running


def first_mismatch(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold; null if all do.  An unknown outcome does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def binding_mismatch(stored: DataFrame, decoded: DataFrame, key: str, fields: Sequence[str], halved: Sequence[str]) -> DataFrame:
    """Stored model bindings against the current decode: (key, reason) with the first field that differs.

    The halved fields may also be half of the full size, an odd pixel rounded up, where the binding says half size.
    """
    j = stored.alias("s").join(decoded.alias("d"), key, "left")
    rules = [(f, F.col(f"s.{f}").eqNullSafe(F.col(f"d.{f}"))) for f in fields]
    for f in halved:
        s, d = F.col(f"s.{f}"), F.col(f"d.{f}")
        half = F.col("s.half_size") & (s > 0) & ((d == s * 2) | (d + 1 == s * 2))
        rules.append((f, (~F.col("s.half_size") & (s == d)) | half))
    return j.select(key, first_mismatch(rules).alias("reason"))


def current_outputs(inventory: DataFrame, state: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Inventory rows with `current`: the stored stamp, fingerprint and output match in every field; unknown is stale."""
    renamed = state.select(key, *[F.col(c).alias(f"_{c}") for c in same])
    j = inventory.join(renamed, key, "left")
    ok = F.lit(True)
    for c in same:
        ok = ok & (F.col(c) == F.col(f"_{c}"))
    return j.select(*inventory.columns, F.coalesce(ok, F.lit(False)).alias("current"))


def stale_inputs(inventory: DataFrame, state: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Only what must be processed, found before any content is read."""
    return inventory.join(state.select(key, *same), [key, *same], "left_anti")


def collisions(outputs: DataFrame, output: str) -> DataFrame:
    """Rows whose output path another row has too."""
    return outputs.join(outputs.groupBy(output).agg(F.count("*").alias("n")).filter("n > 1").select(output), output, "left_semi")


def retention(entries: DataFrame, budget: int, group: str | None = None) -> DataFrame:
    """Entries with `delete`: the oldest go until what is left fits the budget.  One cache of any size is dealt by ranges."""
    by = [group] if group else []
    rows = running(ranged(entries, by, ["modified", "entry"]), by, ["modified", "entry"], F.col("size"), "_upto")
    total = entries.groupBy(*by).agg(F.sum("size").alias("_total"))
    j = rows.join(total, by) if by else rows.crossJoin(F.broadcast(total))
    return j.select(*entries.columns, (F.col("_total") - (F.col("_upto") - F.col("size")) > budget).alias("delete"))


def validate_settings(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """(run, key, reason) of the first broken rule of each setting; settings(run, key, value), rules(key, kind, minimum, maximum, choices)."""
    j = settings.join(F.broadcast(rules), "key", "left")
    number = F.col("value").try_cast("double")
    numeric = F.col("kind").isin("number", "integer")
    auto = (F.col("kind") == "auto_or_number") & (F.col("value") == "auto")
    needs_number = numeric | ((F.col("kind") == "auto_or_number") & ~auto)
    reason = (
        F.when(F.col("kind").isNull(), "unknown key")
        .when((F.col("kind") == "enum") & ~F.array_contains("choices", F.col("value")), "not a choice")
        .when((F.col("kind") == "boolean") & ~F.col("value").isin("true", "false"), "not a boolean")
        .when(needs_number & (number.isNull() | F.isnan(number)), "not a number")
        .when((F.col("kind") == "integer") & (number != F.floor(number)), "not an integer")
        .when(needs_number & ((number < F.col("minimum")) | (number > F.col("maximum"))), "out of range")
    )
    return j.select("run", "key", reason.alias("reason")).filter("reason IS NOT NULL")


def failure_throttle(failures: DataFrame, window_seconds: int = 300, most: int = 8, lock_seconds: int = 60) -> DataFrame:
    """Batch twin of the streaming throttle: failures(client, event_id, at) with how long the client is locked after each one.

    A failure locks when with it the client has `most` in the window; the window is open at its old end.  Failures of
    one instant come one after another, by event_id.
    """
    us = F.unix_micros(F.col("at").cast("timestamp"))
    w = Window.partitionBy("client").orderBy("us").rangeBetween(-(window_seconds * 1_000_000 - 1), 0)
    tied = Window.partitionBy("client", "us")
    later = F.count("*").over(tied) - F.row_number().over(tied.orderBy("event_id"))
    rows = failures.withColumn("us", us)
    return rows.withColumn("recent", F.count("*").over(w) - later).withColumn("locked_seconds", F.when(F.col("recent") >= most, lock_seconds).otherwise(0)).drop("us")


def idle_sessions(activity: DataFrame, now: Column, protected: DataFrame, idle_seconds: int = 86_400) -> DataFrame:
    """Sessions whose last activity is older than the limit and that are not protected."""
    last = activity.groupBy("session").agg(F.max("at").alias("last"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.filter(age > idle_seconds * 1_000_000).join(protected, "session", "left_anti")
