"""Gain-map metadata payloads: decoding of the fixed byte layout, and conformance under two profiles with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.expr import rational_value, signed_byte_number, unsigned_byte_number

#: Flag bits: three channels, base colour space, common denominator, backward direction.
CHANNELS3, BASE_SPACE, COMMON, BACKWARD = 0x80, 0x40, 0x08, 0x04
FIELDS = ("gain_min", "gain_max", "gamma", "base_offset", "alternate_offset")
SIGNED = {"gain_min", "gain_max", "base_offset", "alternate_offset"}
HEAD = 6


def _number(data: Column, at: int, signed: bool = True) -> Column:
    return signed_byte_number(data, at, 4) if signed else unsigned_byte_number(data, at, 4)


def _ratio(n: Column, d: Column) -> Column:
    return F.struct(n.alias("numerator"), d.alias("denominator"))


def decode_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds versions, flags, base and alternate headroom and a channels array; lengths that do not fit give null fields."""
    p = F.col(payload)
    flags = unsigned_byte_number(p, 5, 1)
    x = payloads.withColumn("flags", flags).withColumn("minimum_version", unsigned_byte_number(p, 1, 2)).withColumn("writer_version", unsigned_byte_number(p, 3, 2))
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    count = F.when(has(CHANNELS3), 3).otherwise(1)
    x = x.withColumn("common", has(COMMON)).withColumn("channel_count", count)
    x = x.withColumn("expected_bytes", F.when(F.col("common"), HEAD + 12 + 20 * F.col("channel_count")).otherwise(HEAD + 16 + 40 * F.col("channel_count")))
    fits = F.octet_length(p) == F.col("expected_bytes")

    def field(common_at: int, own_at: int) -> Column:
        shared = _ratio(_number(p, common_at), _number(p, HEAD, False))
        own = _ratio(_number(p, own_at), _number(p, own_at + 4, False))
        return F.when(fits & F.col("common"), shared).when(fits, own)

    channels = [
        F.struct(*[field(HEAD + 12 + 20 * k + 4 * j, HEAD + 16 + 40 * k + 8 * j).alias(f) for j, f in enumerate(FIELDS)]) for k in range(3)
    ]
    return x.select(
        *payloads.columns, "minimum_version", "writer_version", "flags", "common", "channel_count", fits.alias("exact_length"),
        (F.octet_length(p) >= HEAD).alias("has_head"), (unsigned_byte_number(p, 0, 1)).alias("version"),
        field(HEAD + 4, HEAD).alias("base_headroom"), field(HEAD + 8, HEAD + 8).alias("alternate_headroom"),
        F.slice(F.array(*channels), F.lit(1), F.col("channel_count")).alias("channels"),
    )


def rejection(profile: str) -> Column:
    """First reason why a decoded payload does not conform to `iso` or `apple_strict`; null if it does."""
    base, alternate = rational_value(F.col("base_headroom")), rational_value(F.col("alternate_headroom"))
    bad = lambda f: F.exists("channels", f)
    v = lambda c, f: rational_value(c[f])
    broken = bad(lambda c: sum(((F.coalesce(F.abs(v(c, f)) > 64, F.lit(True))).cast("int") for f in FIELDS), F.lit(0)) > 0)
    order = bad(lambda c: v(c, "gain_max") < v(c, "gain_min"))
    gamma = bad(lambda c: ~(v(c, "gamma") > 0))
    rules = [
        ("too short", F.coalesce(F.col("has_head"), F.lit(False))),
        ("version", (F.col("version") == 0) & (F.col("minimum_version") == 0) & (F.col("writer_version") == 0)),
        ("backward direction", F.col("flags").bitwiseAND(F.lit(BACKWARD)) == 0),
        ("reserved flags", F.col("flags").bitwiseAND(F.lit(0xFF & ~(CHANNELS3 | BASE_SPACE | COMMON))) == 0),
        ("length", F.col("exact_length")),
        ("headroom", (base >= 0) & (alternate >= 0)),
        ("channel range", ~broken),
        ("gain order", ~order),
        ("gamma", ~gamma),
    ]
    if profile == "apple_strict":
        rules.append(("gain max against headroom", ~bad(lambda c: F.abs(v(c, "gain_max") - alternate) > 1e-6)))
        rules.append(("several channels", F.col("channel_count") == 1))
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def profile_regression(payloads: DataFrame) -> DataFrame:
    """(corpus, profile, reason, n): accepted payloads have reason `accepted`.  Equal payloads are counted first and decoded once."""
    decoded = decode_payloads(payloads.groupBy("corpus", "payload").agg(F.count("*").alias("copies")))
    profiles = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.coalesce(rejection(p), F.lit("accepted")).alias("reason")) for p in ("iso", "apple_strict")])).alias("e")
    return decoded.select("corpus", "copies", profiles).groupBy("corpus", F.col("e.profile").alias("profile"), F.col("e.reason").alias("reason")).agg(F.sum("copies").alias("n"))


def compare_nodes(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("fixture_id", "headroom"), tolerance: float = 1e-3) -> DataFrame:
    """Two implementations' arrays position by position: compared, missing on either side, worst and mean difference."""
    left = a.select(*keys, F.posexplode("rgb").alias("k", "u"))
    right = b.select(*keys, F.posexplode("rgb").alias("k", "v"))
    j = left.join(right, [*keys, "k"], "full_outer")
    d = F.abs(F.col("u") - F.col("v"))
    return j.groupBy(*keys).agg(
        F.count(d).alias("compared"), F.count_if(F.col("u").isNull()).alias("missing_left"), F.count_if(F.col("v").isNull()).alias("missing_right"),
        F.max(d).alias("worst"), F.avg(d).alias("mean"), F.count_if(d > tolerance).alias("beyond"),
    )
