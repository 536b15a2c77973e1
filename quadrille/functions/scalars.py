"""Scalar functions of the engine, as expressions that Spark compiles. [X-01..X-18]"""

from __future__ import annotations

import colorsys
import unicodedata
import urllib.parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BOOLEAN, DATE, DATE_TIME, DOUBLE, DURATION, INTEGER, JSON, LANG_STRING, SHORT_BYTES, SHORT_STRING, STRING, TIME, UNKNOWN, XML

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ends of a prefixed datatype and the value type that each means.  xsd:dateTime is taken in both spellings.
DATATYPE_ENDS = [
    (INTEGER, [":integer", ":int", ":long", ":short", ":byte", ":nonNegativeInteger", ":positiveInteger"]),
    (BOOLEAN, [":boolean"]),
    (DOUBLE, [":decimal", ":float", ":double"]),
    (DATE, [":date"]),
    (DATE_TIME, [":datetime", ":dateTime"]),
    (TIME, [":time"]),
    (DURATION, [":duration"]),
    (XML, [":XMLLiteral"]),
    (JSON, [":JSON"]),
]


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only. [X-02]"""
    return F.translate(c, _UPPER, _LOWER)


def to_long(c: Column) -> Column:
    """The integer that the text is, with no blanks around; else 0. [X-05, O-02]"""
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")), F.lit(0).cast("bigint"))


def to_double(c: Column) -> Column:
    """The number that the text is; else 0. [X-05, O-03]"""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def byte_length(c: Column) -> Column:
    return F.octet_length(c)  # [X-04]


def value_type(value: Column, lang: Column, datatype: Column) -> Column:
    """The bit of a literal. [N-10]"""
    plain = F.when(F.octet_length(value) < SHORT_BYTES, SHORT_STRING).otherwise(STRING)
    made = F.when(lang.isNotNull(), LANG_STRING).when(datatype.isNull() | datatype.endswith(":string"), plain)
    for bit, ends in DATATYPE_ENDS:
        for end in ends:
            made = made.when(datatype.endswith(end), bit)
    return made.otherwise(UNKNOWN).cast("int")


def short_iri(iri: Column) -> Column:
    """What follows the last '#', else the last '/', else the first ':'. [P-14]"""
    after_colon = F.when(F.instr(iri, ":") > 0, F.substring(iri, F.instr(iri, ":") + 1, F.length(iri))).otherwise(iri)
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).when(F.contains(iri, F.lit("/")), F.substring_index(iri, "/", -1)).otherwise(after_colon)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """column between 0 and 1; all equal: 0. [X-11, M-07]"""
    span = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(span)).withColumn(column, F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def lerp(value: Column, low: float, high: float) -> Column:
    """0..1 to low..high. [X-12, M-12]"""
    return F.lit(low) + value * (high - low)


def level(value: Column, steps: int = 10) -> Column:
    """0..1 to 1..steps. [X-12]"""
    return F.round(value * (steps - 1) + 1).cast("int")


def area_radius(count: Column, least: Column, most: Column, small: float, large: float) -> Column:
    """A radius whose area grows with count. [X-13]"""
    share = F.when(most == least, 0.0).otherwise((count - least) / (most - least))
    return F.sqrt(F.lit(small * small) + share * (large * large - small * small))


def smooth_invert(x: Column) -> Column:
    """1 less the smoother step 6x^5-15x^4+10x^3 of x held between 0 and 1. [X-14]"""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.lit(1.0) - x * x * x * (x * (x * 6 - 15) + 10)


def fixed(c: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))  # [X-16]


def distinct_colour(i: int) -> str:
    """The i-th of ever so many colours, hues a golden ratio apart. [X-15]"""
    r, g, b = colorsys.hls_to_rgb((i * 0.618033988749895) % 1.0, 0.5, 0.65)
    return f"#{round(r * 255):02x}{round(g * 255):02x}{round(b * 255):02x}"


def slugify(text: str) -> str:
    """Lower case letters and digits, anything else one '-'. [X-07]"""
    plain = unicodedata.normalize("NFKD", text.replace("ß", "ss")).encode("ascii", "ignore").decode().lower()
    return "-".join("".join(c if c.isalnum() else " " for c in plain).split())


def slug(c: Column) -> Column:
    """slugify() of a column of ASCII texts. [X-07]"""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def percent_encoded(c: Column) -> Column:
    """percent_encode() of a column: url_encode() and the five marks that it leaves. [X-08]"""
    c = F.url_encode(c)
    for mark, code in (("+", "%20"), ("-", "%2D"), (".", "%2E"), ("*", "%2A"), ("_", "%5F")):
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def percent_encode(text: str) -> str:
    """All but ASCII letters and digits as %XX. [X-08]"""
    return "".join(chr(b) if chr(b).isalnum() and b < 128 else f"%{b:02X}" for b in text.encode())


def form_encode(fields: dict[str, str]) -> str:
    return urllib.parse.urlencode(fields)  # [X-17]


def char_name(c: str) -> str:
    return unicodedata.name(c, "")  # [X-18]


def base62(n: int) -> str:
    digits, out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ""
    while True:
        n, r = divmod(n, 62)
        out = digits[r] + out
        if not n:
            return out


def file_hash(name: str) -> str:
    """A short name of a file. [X-09]"""
    import xxhash

    return base62(xxhash.xxh3_64_intdigest(name.encode()))
