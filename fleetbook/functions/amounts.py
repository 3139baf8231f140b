"""Input cleaning as Column expressions: amounts, enums, text, flags, hashes.

All of it is built-in Spark expressions (no Python UDF), so cleaning a
billion-row load batch stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbook.schemas import ENUMS, MONEY

# The number that PHP's float cast reads at a text's beginning (sign, digits,
# optional fraction, optional exponent) and the token / legacy-hash formats. The replacement writes
# the sign, a zero and the number, so that a text without a number reads 0.
NUMBER_RE = r"(?s)^([+-]?)((?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)?.*$"
NUMBER_OUT = "$10$2"
LONG_EXPONENT_RE = r"[eE][+-]?[0-9]{3,}"
# Token formats ignore letter case.
TOKEN_RE = r"(?i)^[a-f0-9]{24}$"
LEGACY_HASH_RE = r"(?i)^[a-f0-9]{64}$"
# Fixed value: the characters that trimming removes.
TRIM_CHARS = " \t\n\r\0\x0b"
# Clip lengths, in bytes, of user agent and ip address columns.
USER_AGENT_LEN = 255
IP_ADDRESS_LEN = 45


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(value) -> Column:
    """Text without space, tab, line feed, return, NUL and vertical tab at its ends."""
    return F.btrim(_c(value), F.lit(TRIM_CHARS))


def parse_amount(text) -> Column:
    """es-AR amount text to decimal(12,2).

    Trimmed; empty is 0. When the text has a comma, dots are thousands marks
    and the comma is the decimal mark. Only the numeric prefix counts
    (``'12abc'`` is 12, ``'abc'`` is 0), and the value is rounded to cents,
    halves away from zero (decimal rounding, not binary floating point).
    NULL when the number is out of the column's range: the row is the one
    that fails (``bad_amount``), not the job.
    """
    t = trim(_c(text).cast("string"))
    # one pass takes the dots out and makes the comma a dot
    plain = F.when(F.contains(t, F.lit(",")), F.translate(t, ",.", ".")).otherwise(t)
    number = F.regexp_replace(plain, NUMBER_RE, NUMBER_OUT)
    # an exponent of three digits or more would make a decimal of as many: such a number is huge or nothing
    by_exponent = F.when(number.rlike(LONG_EXPONENT_RE), number.try_cast("double").try_cast("decimal(38,18)")).otherwise(number.try_cast("decimal(38,18)"))
    exact = F.when(F.contains(t, F.lit("e")) | F.contains(t, F.lit("E")), by_exponent).otherwise(number.try_cast("decimal(38,18)"))
    return F.when(t.isNull(), F.lit(0).cast(MONEY)).otherwise(F.round(exact, 2).try_cast(MONEY))


def clean_enum(value, enum: str) -> Column:
    """Allow-list with default: a value outside the list becomes the default."""
    allowed, default = ENUMS[enum]
    v = _c(value)
    return F.when(v.isin(*allowed), v).otherwise(F.lit(default))


def empty_to_null(value) -> Column:
    """Trimmed text, NULL when empty."""
    return F.nullif(trim(value), F.lit(""))


def upper_trim(value) -> Column:
    return F.upper(trim(value))


def clip(value, length: int) -> Column:
    """The longest beginning of at most ``length`` UTF-8 bytes that cuts no character in two."""
    raw = F.encode(_c(value), "UTF-8")
    # the hex digits of the byte at a place; bytes 80 to BF continue a character
    goes_on = lambda place: F.substring(F.hex(F.substring(raw, place, 1)), 1, 1).isin("8", "9", "A", "B")
    end = F.lit(max(0, length - 3))
    for short in (2, 1, 0):
        end = F.when(~F.coalesce(goes_on(length - short + 1), F.lit(False)), F.lit(length - short)).otherwise(end)
    return F.when(F.octet_length(_c(value)) <= length, _c(value)).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def is_token_format(value) -> Column:
    return F.coalesce(_c(value).rlike(TOKEN_RE), F.lit(False))


def is_legacy_hash(value) -> Column:
    return F.coalesce(_c(value).rlike(LEGACY_HASH_RE), F.lit(False))


def sha256_hex(value) -> Column:
    return F.sha2(_c(value).cast("string"), 256)


def is_blank(value) -> Column:
    """PHP's falsy test for text: NULL, empty or the string ``'0'``."""
    v = _c(value).cast("string")
    return v.isNull() | v.isin("", "0")
