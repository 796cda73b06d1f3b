"""NMEA 0183 sentences as columns: checksum, fields, positions and times of GGA and RMC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(sentence: Column) -> Column:
    return F.regexp_extract(sentence, r"^\$([^*]*)\*?[0-9A-Fa-f]{0,2}\s*$", 1)


def checksum(sentence: Column) -> Column:
    """The exclusive or of the characters between $ and *."""
    codes = F.transform(F.filter(F.split(body(sentence), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: a.bitwiseXOR(c))


def valid(sentence: Column) -> Column:
    given = F.regexp_extract(sentence, r"\*([0-9A-Fa-f]{2})\s*$", 1)
    return (given != "") & (F.conv(given, 16, 10).cast("int") == checksum(sentence))


def fields(sentence: Column) -> Column:
    return F.split(body(sentence), ",")


def degrees(value: Column, side: Column) -> Column:
    """dddmm.mmmm and N, S, E or W as signed degrees; null where empty."""
    v = F.try_to_number(value, F.lit("99999.999999")).cast("double")
    d = F.floor(v / 100)
    return F.when(side.isin("S", "W"), -1.0).otherwise(1.0) * (d + (v - d * 100) / 60)


def seconds_of_day(value: Column) -> Column:
    """hhmmss.sss as seconds."""
    return F.substring(value, 1, 2).cast("int") * 3600 + F.substring(value, 3, 2).cast("int") * 60 + F.substring(value, 5, 10).cast("double")


def position(sentence: Column) -> Column:
    """Of a valid GGA or RMC sentence: seconds, latitude, longitude; null for any other."""
    f = fields(sentence)
    kind = F.substring(F.get(f, 0), 3, 3)
    gga = F.struct(seconds_of_day(F.get(f, 1)).alias("seconds"), degrees(F.get(f, 2), F.get(f, 3)).alias("latitude"), degrees(F.get(f, 4), F.get(f, 5)).alias("longitude"))
    rmc = F.struct(seconds_of_day(F.get(f, 1)).alias("seconds"), degrees(F.get(f, 3), F.get(f, 4)).alias("latitude"), degrees(F.get(f, 5), F.get(f, 6)).alias("longitude"))
    return F.when(valid(sentence) & (kind == "GGA"), gga).when(valid(sentence) & (kind == "RMC"), rmc)
