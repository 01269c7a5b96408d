"""Column expressions for NMEA 0183 sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checksum(body: Column) -> Column:
    """The exclusive or of the characters between ``$`` and ``*``."""
    return F.aggregate(
        F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a.bitwiseXOR(x)
    )


def framed(body: Column) -> Column:
    """A whole sentence of a body."""
    return F.concat(F.lit("$"), body, F.lit("*"), F.lpad(F.hex(checksum(body)), 2, "0"))


def body(line: Column) -> Column:
    """What stands between the start and ``*``, or the end of the line."""
    return F.regexp_extract(line, r"(?s)^[$!]([^*]*)", 1)


#: The faults of a sentence, in the order that they are looked for.
FAULTS = ("empty", "too_long", "no_start", "too_short", "bad_character", "bad_checksum_hex", "no_checksum", "too_many_fields", "bad_checksum")


def parsed(lines: DataFrame, line: str = "line", most_bytes: int = 256, most_fields: int = 40) -> DataFrame:
    """lines with ``body``, ``fields`` (0: talker and type) and ``status`` (ok, or the first of FAULTS); each is computed once."""
    said = F.regexp_extract(line, r"\*([0-9A-Fa-f]{2})", 1)
    cut = lines.withColumn("body", F.coalesce(body(F.col(line)), F.lit(""))).withColumn("fields", F.split("body", ",")).withColumn("_said", said)
    sum_ = F.lpad(F.hex(checksum(F.col("body"))), 2, "0")
    status = (
        F.when(F.coalesce(F.col(line), F.lit("")) == "", FAULTS[0])
        .when(F.octet_length(line) > most_bytes, FAULTS[1])
        .when(~F.col(line).rlike("^[$!]"), FAULTS[2])
        .when(F.length("body") < 5, FAULTS[3])
        .when(F.col("body").rlike("[^ -~]"), FAULTS[4])
        .when(F.instr(F.col(line), "*") > 0, F.when(F.col("_said") == "", FAULTS[5]))
        .otherwise(FAULTS[6])
    )
    late = (
        F.when(F.length(F.col("fields")[0]) < 5, FAULTS[3])
        .when(F.size("fields") - 1 > most_fields, FAULTS[7])
        .when(F.upper("_said") != sum_, FAULTS[8])
        .otherwise("ok")
    )
    return cut.withColumn("status", F.coalesce(status, late)).drop("_said")


def field(i: int) -> Column:
    """Field i of ``fields`` (0: talker and type), null where it is empty or missing."""
    return F.nullif(F.try_element_at(F.col("fields"), F.lit(i + 1)), F.lit(""))


def number(i: int) -> Column:
    return field(i).try_cast("double")


def kind() -> Column:
    """GGA, RMC, ...; null for proprietary sentences."""
    address = F.col("fields")[0]
    return F.when(~address.startswith("P"), F.substring(address, 3, 9))


def degrees(value: Column, side: Column) -> Column:
    """Degrees of ``ddmm.mm`` and a hemisphere."""
    v = value.try_cast("double")
    whole = F.floor(v / 100)
    return (whole + (v - 100 * whole) / 60) * F.when(side.isin("S", "W"), -1.0).otherwise(1.0)


def second_of_day(value: Column) -> Column:
    """Seconds of ``hhmmss.ss``."""
    number = lambda a, n: F.substring(value, a, n).try_cast("double")
    return number(1, 2) * 3600 + number(3, 2) * 60 + number(5, 12)


#: Names of fixes, from the least to the best, with (default sigma in metres, pose quality, confidence).
FIXES = {"none": (100.0, "invalid", 0.0), "single": (2.0, "poor", 0.35), "dgps": (0.5, "fair", 0.55), "rtk_float": (0.3, "fair", 0.7), "rtk_fixed": (0.02, "good", 1.0)}
#: GGA quality digits and RMC mode characters.
GGA_FIX = {1: "single", 2: "dgps", 3: "single", 4: "rtk_fixed", 5: "rtk_float", 8: "single"}
MODE_FIX = {"A": "single", "D": "dgps", "R": "rtk_fixed", "F": "rtk_float", "P": "single", "S": "single"}


def _looked_up(key: Column, table: dict, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def fix_of(digit: Column) -> Column:
    """The fix of a GGA quality digit."""
    return _looked_up(digit, GGA_FIX, "none")


def fix_of_mode(mode: Column) -> Column:
    """The fix of an RMC mode character."""
    return _looked_up(F.upper(F.substring(mode, 1, 1)), MODE_FIX, "none")


def rank_of(fix: Column) -> Column:
    return _looked_up(fix, {f: i for i, f in enumerate(FIXES)}, 0)


def sigma_of(fix: Column) -> Column:
    return _looked_up(fix, {f: v[0] for f, v in FIXES.items()}, FIXES["none"][0])


def quality_of(fix: Column) -> Column:
    return _looked_up(fix, {f: v[1] for f, v in FIXES.items()}, "invalid")


def confidence_of(fix: Column) -> Column:
    return _looked_up(fix, {f: v[2] for f, v in FIXES.items()}, 0.0)


def date_of(value: Column) -> Column:
    """The date of ``ddmmyy``; two-digit years below 80 are of this century."""
    n = lambda a: F.substring(value, a, 2).try_cast("int")
    year = n(5) + F.when(n(5) < 80, 2000).otherwise(1900)
    good = value.rlike("^[0-9]{6}$") & n(1).between(1, 31) & n(3).between(1, 12)
    return F.when(good, F.date_add(F.make_date(year, n(3), F.lit(1)), n(1) - 1))


def unix_nanos(date: Column, second: Column) -> Column:
    """Nanoseconds since 1970 of a date and a second of the day."""
    return F.when(second.between(0, 86400.999999999), F.unix_date(date).cast("long") * 86_400_000_000_000 + F.floor(second * 1e9 + 0.5).cast("long"))


def gga() -> dict[str, Column]:
    lat, lon = degrees(field(2), field(3)), degrees(field(4), field(5))
    placed = lat.isNotNull() & lon.isNotNull()
    return {
        "sod": second_of_day(field(1)), "lat": F.when(placed, lat), "lon": F.when(placed, lon),
        "quality": F.coalesce(field(6).try_cast("int"), F.lit(0)),
        "fix": F.when(placed, fix_of(F.coalesce(field(6).try_cast("int"), F.lit(0)))).otherwise("none"),
        "satellites": field(7).try_cast("int"), "hdop": number(8), "alt": number(9), "geoid": number(11), "age": number(13), "station": field(14).try_cast("int"),
    }


def rmc() -> dict[str, Column]:
    """An invalid one has no fix."""
    lat, lon = degrees(field(3), field(4)), degrees(field(5), field(6))
    placed = lat.isNotNull() & lon.isNotNull()
    valid = F.coalesce(F.upper(field(2)).startswith("A"), F.lit(False))
    return {
        "sod": second_of_day(field(1)), "valid": valid, "lat": F.when(placed, lat), "lon": F.when(placed, lon),
        "fix": F.when(valid & placed, fix_of_mode(F.coalesce(field(12), F.lit("N")))).otherwise("none"),
        "knots": number(7), "course": number(8), "date": date_of(field(9)),
    }


def gst() -> dict[str, Column]:
    """Sigmas in metres."""
    return {
        "sod": second_of_day(field(1)), "rms": number(2), "major": number(3), "minor": number(4), "orientation": number(5),
        "lat_sigma": number(6), "lon_sigma": number(7), "alt_sigma": number(8),
    }


def gsa() -> dict[str, Column]:
    return {
        "mode": F.substring(field(1), 1, 1), "dimension": field(2).try_cast("int"),
        "satellites_used": F.size(F.filter(F.slice("fields", 4, 12), lambda x: x != "")), "pdop": number(15), "hdop": number(16), "vdop": number(17),
    }


def vtg() -> dict[str, Column]:
    """Of knots and km/h one gives the other."""
    return {
        "course": number(1), "course_magnetic": number(3),
        "knots": F.coalesce(number(5), number(7) / 1.852), "kmh": F.coalesce(number(7), number(5) * 1.852),
    }


#: Each decoder and the fewest fields that its sentence must have.
DECODERS = {"GGA": (gga, 6), "RMC": (rmc, 9), "GST": (gst, 8), "GSA": (gsa, 17), "VTG": (vtg, 8)}


def decoded(lines: DataFrame) -> DataFrame:
    """The ok sentences of parsed() that a decoder knows, with ``kind`` and a struct for each decoder, null in other kinds' rows."""
    known = lines.withColumn("kind", kind()).where((F.col("status") == "ok") & F.col("kind").isin(*DECODERS))
    fits = F.lit(False)
    for name, (_, least) in DECODERS.items():
        fits = fits | ((F.col("kind") == name) & (F.size("fields") > least))
    structs = {name.lower(): F.when(F.col("kind") == name, F.struct(*[c.alias(n) for n, c in of().items()])) for name, (of, _) in DECODERS.items()}
    return known.where(fits).withColumns(structs)
