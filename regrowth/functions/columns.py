"""Column expressions shared by the operators (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scale factors and limits of the surface products.
ST_SCALE, ST_OFFSET, KELVIN = 0.00341802, 149.0, 273.15
SR_SCALE, SR_OFFSET = 2.75e-5, -0.2
CLEAR_BITS = 0b111110

# Quality gates of a clean unit.
MAX_REDISTURBED, MIN_CONTROLS, MIN_FOREST = 0.05, 30, 0.6

# Words that decide the trigger, first hit wins.
TRIGGER_WORDS = [
    ("地震", "earthquake"),
    ("颱風", "typhoon_rain"),
    ("豪雨", "rainfall"),
    ("熱帶低壓", "rainfall"),
    ("堰塞湖", "other"),
]
LIST_MARK, AND_MARK, ZERO_WIDTH = "、", "暨", "​"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(x) -> Column:
    """Round to the nearest integer, halves to the even neighbour."""
    return F.rint(c(x)).cast("long")


def event_time(mid, t_event) -> Column:
    return half_even(c(mid) - c(t_event))


def clean_flag(redist="redist_frac", n_ctrl="n_ctrl", forest="forest2000_frac") -> Column:
    """False, never NULL, when an input is missing."""
    flag = (c(redist) < MAX_REDISTURBED) & (c(n_ctrl) >= MIN_CONTROLS) & (c(forest) > MIN_FOREST)
    return F.coalesce(flag, F.lit(False))


def after_event(max_age: float | None = 22.0, age="age", is_pre="is_pre", clean="clean") -> Column:
    cond = (~c(is_pre)) & c(clean) & (c(age) > 0.6)
    return cond if max_age is None else cond & (c(age) <= max_age)


def straddles(age="age", is_pre="is_pre") -> Column:
    """The period that contains the event: neither clearly before nor clearly after."""
    return (~c(is_pre)) & (c(age) > -0.30) & (c(age) < 0.7)


def pre_tag(year, t_event, first_year: int, last_year: int, mid_of_year: float = 0.62) -> Column:
    """Tag of the last full period before the event, '' where there is none."""
    before = c(year) - 1
    usable = c(year).between(first_year, last_year) & (before + F.lit(mid_of_year) + F.lit(0.21) <= c(t_event))
    return F.when(usable, period_tag(before)).otherwise(F.lit(""))


def period_tag(year) -> Column:
    return F.concat(F.lit("c"), F.lpad((c(year) % 100).cast("string"), 2, "0"))


def period_year(tag, century: int = 2000) -> Column:
    return F.substring(c(tag), 2, 2).cast("int") + F.lit(century)


def contains_or_false(text, word: str) -> Column:
    return F.coalesce(c(text).contains(word), F.lit(False))


def trigger_of(text) -> Column:
    out = None
    for word, label in TRIGGER_WORDS:
        hit = F.coalesce(c(text), F.lit("")).contains(word)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit("unknown"))


def tidy_text(text) -> Column:
    return F.replace(F.trim(c(text)), F.lit(ZERO_WIDTH), F.lit(""))


def parse_date(text) -> Column:
    """First of three layouts that fits, else NULL (never an error)."""
    s = F.substring(tidy_text(text), 1, 10)
    return F.coalesce(
        *[F.try_to_timestamp(s, F.lit(fmt)).cast("date") for fmt in ("yyyyMMdd", "yyyy/M/d", "yyyy-M-d")]
    )


def decimal_year(d) -> Column:
    return F.year(c(d)) + (F.dayofyear(c(d)) - F.lit(0.5)) / F.lit(365.25)


def date_of_decimal_year(t) -> Column:
    year = F.floor(c(t)).cast("int")
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), half_even((c(t) - F.floor(c(t))) * 365.25).cast("int"))


def clear_sky(qa) -> Column:
    return (c(qa) != 0) & (c(qa).bitwiseAND(F.lit(CLEAR_BITS)) == 0)


def surface_celsius(st) -> Column:
    return c(st) * F.lit(ST_SCALE) + F.lit(ST_OFFSET) - F.lit(KELVIN)


def reflectance(sr) -> Column:
    return c(sr) * F.lit(SR_SCALE) + F.lit(SR_OFFSET)


def greenness(red, nir) -> Column:
    den = reflectance(nir) + reflectance(red)
    return F.when(F.abs(den) > 1e-6, (reflectance(nir) - reflectance(red)) / den)


def db_gap(unit_power, control_power) -> Column:
    ok = (c(unit_power) > 0) & (c(control_power) > 0)
    return F.when(ok, 10 * F.log10(c(unit_power)) - 10 * F.log10(c(control_power)))


def illumination(slope_deg, eastness, northness, azimuth: float = 107.5, altitude: float = 62.5) -> Column:
    """Cosine of the sun's incidence angle on the slope."""
    tilt, az, alt = F.radians(c(slope_deg)), F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    facing = F.atan2(c(eastness), c(northness))
    return F.cos(tilt) * F.sin(alt) + F.sin(tilt) * F.cos(alt) * F.cos(az - facing)


def standard_error(x) -> Column:
    return F.stddev_samp(c(x)) / F.sqrt(F.count(c(x)))


def gated(n, least: int, value) -> Column:
    return F.when(c(n) >= least, c(value))


def utc_micros(df, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; zone-less values are taken as UTC whatever the session zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(name)


def utc_day(instant) -> Column:
    """Calendar day of an instant in UTC."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(c(instant)) / 86400).cast("int"))
