"""Column-level functions: tolerant casts, JSON access, readable sizes, result codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit names of the two readable scales.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
COUNT_UNITS = ("", "тыс", "млн", "млрд", "трлн", "птлн")

# Text timestamp layouts accepted by the best-effort parser.
TIME_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]",
    "dd.MM.yyyy HH:mm:ss",
    "yyyy-MM-dd",
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def try_int(c) -> Column:
    """Text to bigint; empty or malformed text is NULL."""
    return blank_to_null(c).try_cast("bigint")


def try_timestamp(c) -> Column:
    """Text to timestamp; empty or malformed text is NULL, and so is a bare number."""
    text = blank_to_null(c)
    return F.when(text.rlike(r"^\s*\d{4}-\d"), text.try_cast("timestamp"))


def try_json(c) -> Column:
    """Text to VARIANT; malformed text is NULL.

    The parser stops after the first value, so the text is also read inside brackets and inside
    an object: only one complete value fits both.
    """
    text = col(c)
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(alone, F.try_variant_get(boxed, "$.v", "variant"))


def is_valid_json(c) -> Column:
    return F.coalesce(try_json(c).isNotNull(), F.lit(False)) & col(c).isNotNull()


def best_effort_timestamp(c) -> Column:
    """First layout that fits wins; anything else is NULL."""
    text = blank_to_null(F.trim(col(c)))
    tries = [try_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_LAYOUTS]
    return F.coalesce(*tries)


def xml_time(c) -> Column:
    """xsd:dateTime with any length of fraction and an optional zone, cut to microseconds."""
    text = F.regexp_replace(F.trim(col(c)), r"(\.\d{6})\d+", "$1")
    return blank_to_null(text).try_cast("timestamp")


def canonical_json(c) -> Column:
    """JSON text with sorted keys and no spacing, so equal documents compare equal."""
    return F.to_json(try_json(c))


def field(c, path: str) -> Column:
    return F.get_json_object(col(c), f"$.{path}")


def readable(x, base: int = 1024, largest: str | None = None) -> Column:
    """Human-readable size with sign and one decimal; ``largest`` names the last unit to use."""
    names = BYTE_UNITS if base == 1024 else COUNT_UNITS
    if largest is not None:
        names = names[: names.index(largest) + 1]
    value = col(x).cast("double")
    size = F.abs(value)
    # Powers are compared instead of taking a logarithm: exact at the unit boundaries.
    step = sum(
        (F.when(size >= float(base) ** i, 1).otherwise(0) for i in range(1, len(names))),
        F.lit(0),
    )
    scaled = F.round((size / F.pow(F.lit(float(base)), step)).cast("decimal(38,10)"), 1)
    unit = F.element_at(F.array(*[F.lit(n) for n in names]), step + 1)
    text = F.concat(F.when(value < 0, "-").otherwise(""), scaled.cast("string"), F.lit(" "), unit)
    return F.when(value.isNull() | (value == 0), F.lit("0 " + names[0])).otherwise(text)


def grouped(x) -> Column:
    """Integer with thousands separators."""
    return F.format_number(col(x).cast("bigint"), 0)


# Leading words and message fragments behind the numeric result codes.
LEADING_WORD_CODES = (("ok", 1), ("no", 0), ("empty", -1), ("expire", -3))
FRAGMENT_CODES = (
    ("query_canceled or statement_timeout", -2),
    ("uniq check error", -4),
    ("ztest error", -5),
    ("Ошибка качества данных", -5),
    ("pxf server error", -8),
)
UNHANDLED_CODE = -7
OTHER_CODE = -9


def result_code(text, unhandled=None) -> Column:
    """Numeric code of a result text; a JSON answer may carry the code itself."""
    raw = F.coalesce(col(text), F.lit(""))
    low = F.lower(raw)
    word = F.substring_index(F.concat(low, F.lit(" ")), " ", 1)
    code = F.when(raw == "", 1)
    for name, value in LEADING_WORD_CODES:
        code = code.when(word == name, value)
    for part, value in FRAGMENT_CODES:
        # Fragments in lower case match any case, the others as they are written.
        code = code.when(F.instr(low if part == part.lower() else raw, part) > 0, value)
    code = code.otherwise(OTHER_CODE)
    doc = try_json(raw)
    out = F.coalesce(
        F.try_variant_get(doc, "$.result", "int"), F.try_variant_get(doc, "$.res", "int"), code
    )
    return out if unhandled is None else F.when(col(unhandled), UNHANDLED_CODE).otherwise(out)


def hub_metric(zscore, key_date, as_of: Column) -> Column:
    """Quality number 0..100 with its business date; a fixed default where no test ran."""
    tested = F.struct(
        F.date_format(col(key_date), "dd.MM.yyyy").alias("business_date"),
        F.lit("Z_TEST").alias("metric"),
        F.greatest(F.round(F.lit(100.0) - F.abs(col(zscore).cast("double"))), F.lit(0.0))
        .cast("bigint").alias("number"),
    )
    default = F.struct(
        F.date_format(F.date_sub(as_of.cast("date"), 1), "dd.MM.yyyy").alias("business_date"),
        F.lit("S_TEST").alias("metric"),
        F.lit(99).cast("bigint").alias("number"),
    )
    return F.when(col(key_date).isNotNull(), tested).otherwise(default)


def seconds_between(later, earlier) -> Column:
    """Difference of two timestamps in seconds, with fraction."""
    micros = F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def sanitize(c, removals: list[tuple[str, str]]) -> Column:
    """Apply literal replacements one after another (separators, tabs, newlines, backslashes)."""
    out = col(c)
    for old, new in removals:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def sanitize_array(c, removals: list[tuple[str, str]]) -> Column:
    return F.transform(col(c), lambda x: sanitize(x, removals))


def array_text(c) -> Column:
    """Array in brace notation with NULL spelled out."""
    body = F.array_join(F.transform(col(c), lambda x: x.cast("string")), ",", "NULL")
    return F.when(col(c).isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))
