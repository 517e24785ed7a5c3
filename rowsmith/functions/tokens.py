"""Column expressions that read one text value as a boolean, number, UUID or timestamp.

Every function takes and returns a ``Column`` made of built-in expressions, so the
work stays inside whole-stage code generation. A value that does not fit is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The boolean words of each load profile.
TRUE_TOKENS = ("true", "t", "1", "yes", "y", "on", "enabled", "active")
FALSE_TOKENS = ("false", "f", "0", "no", "n", "off", "disabled", "inactive")
BOOLEAN_TOKENS = {
    "generic": (TRUE_TOKENS, FALSE_TOKENS),
    "workbook": (("true", "1", "yes"), ("false", "0", "no")),
    "dump": (("true", "1", "yes"), ("false", "0", "no")),
    "sqlite": (("true", "1", "yes", "y"), ("false", "0", "no", "n")),
}

# Spellings of the special doubles.
POSITIVE_INFINITY_TOKENS = ("inf", "+inf", "infinity", "+infinity")
NEGATIVE_INFINITY_TOKENS = ("-inf", "-infinity")
NAN_TOKENS = ("nan", "#num!")

# The largest epoch read as seconds, and as milliseconds (2100-01-01).
MAX_EPOCH_SECONDS = 4102444800
MAX_EPOCH_MILLIS = 4102444800000

WHITESPACE = " \t\n\r\f\x0b\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)

# The shapes of identifiers, numbers, clocks and dates, and the white space that is trimmed above.
UUID_PATTERN = r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
STRICT_UUID_PATTERN = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
)
INTEGER_PATTERN = r"^[+-]?\d+$"
HEX_PATTERN = r"^[+-]?0[xX][0-9a-fA-F]{1,16}$"
DOUBLE_PATTERN = r"^[+-]?(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][+-]?\d+)?$"

CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
TIME_PATTERN = r"^\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?$"
SLASH_PATTERN = rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}(?:[ T]{CLOCK})?$"
DOT_PATTERN = rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}(?:[ T]{CLOCK})?$"
PLAIN_ISO_PATTERN = (
    r"^\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(Z|[+-]\d\d:\d\d)?)?$"
)
# Everything ISO-like: signed years, compact digits, comma fractions, short offsets.
LOOSE_ISO_PATTERN = (
    r"^([+-]?\d{4,6}(?=-)|[+-]?\d{4})-?(\d\d)-?(\d\d)"
    r"(?:[ T](\d\d)(?::?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?)?"
    r"(?: ?([zZ]|[+-]\d\d(?::?\d\d)?))?)?$"
)
TEMPORAL_SHAPE_PATTERN = (
    r"^(?:\d{4}-\d{1,2}-\d{1,2}(?:[ T]|$)"
    r"|\d{1,2}/\d{1,2}/\d{4}(?:[ T]|$)"
    r"|\d{1,2}\.\d{1,2}\.\d{4}(?:[ T]|$)"
    r"|\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?$)"
)


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks.

    Text that begins and ends with visible ASCII, which is most text, is passed on as is.
    """
    visible = (value >= "!") & (value < "\x7f") & F.right(value, F.lit(1)).between("!", "~")
    return F.when(visible, value).otherwise(F.trim(value, F.lit(WHITESPACE)))


def blank_to_null(value: Column) -> Column:
    text = strip(value)
    return F.when(text != "", text)


# The parsers below take text that is already stripped: strip a column once in an
# earlier projection, then parse it.


def parse_boolean(text: Column, profile: str = "generic") -> Column:
    word = F.lower(text)
    yes, no = BOOLEAN_TOKENS[profile]
    return F.when(word.isin(*yes), F.lit(True)).when(word.isin(*no), F.lit(False))


def parse_integer(text: Column) -> Column:
    """A 64-bit integer: decimal digits or ``0x`` digits; out-of-range digits are NULL."""
    from_hex = F.conv(F.regexp_replace(text, "^([+-]?)0[xX]", "$1"), 16, -10)
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint")).when(
        text.rlike(HEX_PATTERN), from_hex.try_cast("bigint")
    )


def parse_double(text: Column) -> Column:
    word = F.lower(text)
    # The pattern keeps out suffixed forms such as ``1d`` that a bare cast would take.
    return (
        F.when(text.rlike(DOUBLE_PATTERN), text.try_cast("double"))
        .when(word.isin(*POSITIVE_INFINITY_TOKENS), F.lit(float("inf")))
        .when(word.isin(*NEGATIVE_INFINITY_TOKENS), F.lit(float("-inf")))
        .when(word.isin(*NAN_TOKENS), F.lit(float("nan")))
    )


def is_uuid(text: Column, strict: bool = False) -> Column:
    return (F.length(text) == 36) & text.rlike(STRICT_UUID_PATTERN if strict else UUID_PATTERN)


def epoch_to_timestamp(number: Column) -> Column:
    return F.when(
        number.between(0, MAX_EPOCH_SECONDS), F.timestamp_seconds(number)
    ).when(number.between(0, MAX_EPOCH_MILLIS), F.timestamp_millis(number))


def _loose_iso(text: Column) -> Column:
    """ISO text outside the plain shape; a component that is too large rolls over."""

    def part(group: int, default: int) -> Column:
        digits = F.regexp_extract(text, LOOSE_ISO_PATTERN, group)
        return F.coalesce(digits.try_cast("int"), F.lit(default))

    # ``+02:30`` becomes the signed number 230, then minutes.
    zone = F.regexp_replace(F.regexp_extract(text, LOOSE_ISO_PATTERN, 8), "[:zZ]", "")
    zone = F.coalesce(F.rpad(F.nullif(zone, F.lit("")), 5, "0").try_cast("int"), F.lit(0))
    offset = F.floor(F.abs(zone) / 100).cast("int") * 60 + F.abs(zone) % 100
    fraction = F.concat(F.lit("0."), F.regexp_extract(text, LOOSE_ISO_PATTERN, 7), F.lit("0"))
    micros = F.floor(fraction.try_cast("decimal(38,9)") * 1000000)
    start = F.try_make_timestamp(
        part(1, 0), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    )
    return start + F.make_interval(
        F.lit(0), part(2, 1) - 1, F.lit(0), part(3, 1) - 1, part(4, 0),
        part(5, 0) - F.signum(zone).cast("int") * offset,
        (part(6, 0) + micros.cast("decimal(18,6)") / 1000000).cast("decimal(18,6)"),
    )


def parse_day_first_or_clock(text: Column) -> Column:
    """Month/day/year, day.month.year, or a clock on 1970-01-01."""
    return (
        F.when(
            text.rlike(SLASH_PATTERN),
            F.regexp_replace(text, r"^(\d+)/(\d+)/(\d{4})", "$3-$1-$2"),
        )
        .when(
            text.rlike(DOT_PATTERN),
            F.regexp_replace(text, r"^(\d+)\.(\d+)\.(\d{4})", "$3-$2-$1"),
        )
        .when(text.rlike(TIME_PATTERN), F.concat(F.lit("1970-01-01 "), text))
    ).try_cast("timestamp")


def parse_timestamp(text: Column, allow_epoch: bool = True) -> Column:
    """A UTC instant from ISO, month/day/year, day.month.year, clock or epoch text.

    Text without a zone is UTC; clock-only text falls on 1970-01-01.
    """
    plain = F.when(text.rlike(PLAIN_ISO_PATTERN), text.try_cast("timestamp"))
    loose = F.when(text.rlike(LOOSE_ISO_PATTERN), _loose_iso(text))
    forms = [plain, loose, parse_day_first_or_clock(text)]
    if allow_epoch:
        number = F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))
        forms.append(epoch_to_timestamp(number))
    return F.coalesce(*forms)


def parse_iso_timestamp(text: Column) -> Column:
    plain = F.when(text.rlike(PLAIN_ISO_PATTERN), text.try_cast("timestamp"))
    return F.coalesce(plain, F.when(text.rlike(LOOSE_ISO_PATTERN), _loose_iso(text)))
