"""Column expressions that the jobs share: guarded arithmetic, colour, transfer curves, rationals, bits, dates.

All are built from Spark functions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rec. 709 and Display P3 luminance weights, and linear-light matrices between primaries.
P3_LUMA = (0.2289746, 0.6917385, 0.0792869)
P3_TO_709 = ((1.22494018, -0.22494018, 0.0), (-0.04205695, 1.04205695, 0.0), (-0.01963755, -0.07863605, 1.09827360))
P3_TO_2020 = ((0.7538330, 0.1985974, 0.0475696), (0.0457439, 0.9417772, 0.0124789), (-0.0012103, 0.0176017, 0.9836086))
REC709_TO_P3 = ((0.82246197, 0.17753803, 0.0), (0.03319420, 0.96680580, 0.0), (0.01708263, 0.07239741, 0.91051996))
REC2020_TO_P3 = ((1.3435783, -0.2821797, -0.0613986), (-0.0652975, 1.0757879, -0.0104905), (0.0028218, -0.0195985, 1.0167767))


def lit(x: float) -> Column:
    return F.lit(float(x))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < lit(float("inf")))


def positive_finite(x: Column) -> Column:
    return finite(x) & (x > 0)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else lit(low)
    high = high if isinstance(high, Column) else lit(high)
    return F.greatest(F.least(x, high), low)


def clamp_finite(x: Column, low: float, high: float, fallback: float) -> Column:
    return F.when(finite(x), clamp(x, low, high)).otherwise(lit(fallback))


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), lit(0.0))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def exp2(x: Column) -> Column:
    return F.pow(lit(2.0), x)


def apply_matrix(m, r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return tuple(lit(k[0]) * r + lit(k[1]) * g + lit(k[2]) * b for k in m)


def p3_luminance(r: Column, g: Column, b: Column) -> Column:
    return lit(P3_LUMA[0]) * r + lit(P3_LUMA[1]) * g + lit(P3_LUMA[2]) * b


def outside_709(r: Column, g: Column, b: Column, slack: float = 1e-4) -> Column:
    """A colour that Rec. 709 primaries cannot make without a negative component."""
    return F.least(*apply_matrix(P3_TO_709, r, g, b)) < -slack


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, lit(1 / 2.4)) - 0.055)


def bt709_to_linear(v: Column) -> Column:
    return F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, lit(1 / 0.45)))


def linear_to_bt709(v: Column) -> Column:
    return F.when(v < 0.018, v * 4.5).otherwise(1.099 * F.pow(v, lit(0.45)) - 0.099)


# Fixed values of SMPTE ST 2084 and of hybrid log-gamma.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073


def linear_to_pq(nits: Column) -> Column:
    y = F.pow(F.greatest(nits, lit(0.0)) / 10000.0, lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * y) / (1.0 + PQ_C3 * y), lit(PQ_M2))


def pq_to_linear(code: Column) -> Column:
    x = F.pow(F.greatest(code, lit(0.0)), lit(1 / PQ_M2))
    return 10000.0 * F.pow(F.greatest(x - PQ_C1, lit(0.0)) / (PQ_C2 - PQ_C3 * x), lit(1 / PQ_M1))


def linear_to_hlg(v: Column) -> Column:
    return F.when(v <= 1 / 12, F.sqrt(3.0 * F.greatest(v, lit(0.0)))).otherwise(HLG_A * F.log(F.greatest(12.0 * v - HLG_B, lit(1e-12))) + HLG_C)


def hlg_to_linear(v: Column) -> Column:
    return F.when(v <= 0.5, v * v / 3.0).otherwise((F.exp((v - HLG_C) / HLG_A) + HLG_B) / 12.0)


#: Diffuse white, and the nominal peak and system gamma of an HLG display.
WHITE_NITS, HLG_PEAK_NITS, HLG_GAMMA = 203.0, 1000.0, 1.2


def hlg_signal(light: Column) -> Column:
    """HLG signal of light relative to diffuse white: the display's rendering is undone first, so white lands at 0.75."""
    return linear_to_hlg(F.pow(clamp(light * (WHITE_NITS / HLG_PEAK_NITS), 0.0, 1.0), lit(1 / HLG_GAMMA)))


def hlg_light(signal: Column) -> Column:
    """Light relative to diffuse white of an HLG signal on the nominal display."""
    return F.pow(hlg_to_linear(F.greatest(signal, lit(0.0))), lit(HLG_GAMMA)) * (HLG_PEAK_NITS / WHITE_NITS)


def known_transfer(code: Column) -> Column:
    return code.isin(0, 1, 2, 4, 5, 6, 8, 11, 12, 13, 14, 15, 16, 18)


def linear_by_transfer(code: Column, v: Column) -> Column:
    """Linear light by transfer characteristics code, unstated ones as sRGB; null for codes that are not known."""
    return (
        F.when(code.isin(1, 6, 11, 12, 14, 15), bt709_to_linear(v))
        .when(code.isin(0, 2, 13), srgb_to_linear(v))
        .when(code == 4, F.pow(F.greatest(v, lit(0.0)), lit(2.2)))
        .when(code == 5, F.pow(F.greatest(v, lit(0.0)), lit(2.8)))
        .when(code == 8, v)
        .when(code == 16, pq_to_linear(v) / WHITE_NITS)
        .when(code == 18, hlg_light(v))
    )


def rational(x: Column, denominator: int = 1_000_000) -> Column:
    return F.struct(F.round(x * denominator).cast("long").alias("numerator"), F.lit(denominator).cast("long").alias("denominator"))


def common_denominator(values: dict[str, Column], denominator: int = 1_000_000) -> Column:
    """A struct of whole numerators over one denominator for several numbers."""
    return F.struct(F.lit(denominator).cast("long").alias("denominator"), *[F.round(v * denominator).cast("long").alias(n) for n, v in values.items()])


def rational_value(q: Column) -> Column:
    return F.try_divide(q["numerator"].cast("double"), q["denominator"].cast("double"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def split_multiply32(v: Column, c: int) -> Column:
    """(v * c) modulo 2^32 on non-negative BIGINTs, in halves so that nothing overflows."""
    high = F.shiftright(v, 16) * F.lit(c)
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + v.bitwiseAND(F.lit(0xFFFF)) * F.lit(c)).bitwiseAND(F.lit(0xFFFFFFFF))


def signed_byte_number(data: Column, at: int, size: int) -> Column:
    """Big-endian two's complement number in a binary column; at counts from 0."""
    raw = F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("decimal(20,0)").cast("long")
    top = 1 << (8 * size - 1)
    return F.when(raw >= top, raw - (1 << (8 * size))).otherwise(raw)


def unsigned_byte_number(data: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def exif_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def xmp_headroom(text: Column) -> Column:
    """The headroom number of either written form, attribute or element; null without one."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(text, r'HDRGainMapHeadroom\s*=\s*"([^"]*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"HDRGainMapHeadroom>\s*([^<]*?)\s*<", 1), F.lit("")),
    )
    return found.try_cast("double")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
