"""Text functions as Column expressions. Two Unicode normal forms have no built-in and run as Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Character ranges, white space and digit classes, flag tokens that results depend on.
YI_BLOCK = "\\uA000-\\uA4CF"
YI_SYLLABLES = "\\uA000-\\uA48C"
HAN = "\\u4E00-\\u9FFF"
ASCII_LETTERS = "A-Za-z"
#: The 29 code points that count as white space.
WHITE_SPACE = "\\s\\x1c-\\x1f\\x85\\p{Z}"
#: Decimal digits and the other digits (superscripts, subscripts, circled and such) that have a digit value.
DIGITS = (
    "\\p{Nd}\\u00B2\\u00B3\\u00B9\\u1369-\\u1371\\u19DA\\u2070\\u2074-\\u2079\\u2080-\\u2089\\u2460-\\u2468\\u2474-\\u247C\\u2488-\\u2490\\u24EA"
    "\\u24F5-\\u24FD\\u24FF\\u2776-\\u277E\\u2780-\\u2788\\u278A-\\u2792\\x{10A40}-\\x{10A43}\\x{10E60}-\\x{10E68}\\x{11052}-\\x{1105A}\\x{1F100}-\\x{1F10A}"
)
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
LATEX_TOKENS = ("\\(", "\\)", "\\frac", "\\underset", "\\cdot", "\\mathrm", "^{", "_{")
REPLACEMENT = "�"
LONG_RUN, LONG_LEAST, LONG_TIMES = 20, 120, 4


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITE_SPACE}]", "")


def keep(text: Column, characters: str) -> Column:
    """The text's characters of a class, in order."""
    return F.regexp_replace(text, f"[^{characters}]", "")


def keep_digits(text: Column) -> Column:
    return keep(text, DIGITS)


#: Texts that are held as Python strings at once.
AT_ONCE = 64


def _normal(form: str):
    @arrow_udf(T.StringType())
    def normalise(texts: pa.Array) -> pa.Array:
        done = [pa.array([None if t is None else t if t.isascii() else unicodedata.normalize(form, t) for t in texts.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return normalise


def nfc_ws(text: Column) -> Column:
    """Composed form, then without white space."""
    return strip_ws(_normal("NFC")(text))


def nfkc_ws(text: Column) -> Column:
    """Compatibility form, then without white space."""
    return strip_ws(_normal("NFKC")(text))


def distance(a: Column, b: Column) -> Column:
    """Edit distance over code points; equal texts skip the table."""
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b))


def ned(a: Column, b: Column, dist: Column | None = None) -> Column:
    """Distance over the longer length; 0 where both are empty."""
    return (distance(a, b) if dist is None else dist) / F.greatest(F.length(a), F.length(b), F.lit(1))


def has_any(text: Column, tokens: Sequence[str]) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(text, F.lit(t)) for t in tokens))


def has_latex(text: Column) -> Column:
    return has_any(text, LATEX_TOKENS)


def is_long(pred: Column, gt: Column) -> Column:
    run = F.contains(pred, F.lit(REPLACEMENT * LONG_RUN))
    return run | (F.length(pred) >= F.greatest(F.lit(LONG_LEAST), LONG_TIMES * F.length(gt)))


def flags(pred: Column, gt: Column) -> dict[str, Column]:
    """The seven review flags, in their order."""
    pred_letter, gt_letter = pred.rlike(f"[{ASCII_LETTERS}]"), gt.rlike(f"[{ASCII_LETTERS}]")
    return {
        "replacement": F.contains(pred, F.lit(REPLACEMENT)),
        "latex": has_latex(pred),
        "ascii_letter": pred_letter,
        "gt_ascii_letter": gt_letter,
        "extra_ascii_letter": pred_letter & ~gt_letter,
        "ascii_any": pred.rlike("[\\x00-\\x7f]"),
        "long_pred": is_long(pred, gt),
    }


def line_count(text: Column) -> Column:
    """Number of lines, counting every Unicode line end; a line end at the very end opens no further line."""
    unified = F.regexp_replace(F.regexp_replace(text, LINE_ENDS, "\n"), "\\n\\z", "")
    return F.when(text == "", F.lit(0)).otherwise(F.length(unified) - F.length(F.replace(unified, F.lit("\n"), F.lit(""))) + 1)


def prompt_without_image(text: Column) -> Column:
    return F.replace(text, F.lit("<image>"), F.lit(""))


def lines_to_target(lines: Column) -> Column:
    """Lines joined and ended by line feeds."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def count_of(text: Column, symbols: str) -> Column:
    """How many characters of the text are among symbols."""
    return F.length(text) - F.length(F.translate(text, symbols, ""))


def unexpected(text: Column, allowed: Column) -> Column:
    """The distinct characters outside the allowed ones, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(F.split(text, "")), F.split(allowed, "")))


def adjacent_positions(text: Column, characters: str) -> Column:
    """Every 0-based place where two neighbours are of the class."""
    last = F.length(text) - 2
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(text, i + 1, F.lit(2)).rlike(f"^[{characters}]{{2}}$"))


def splice(text: Column, place: Column, piece: Column, replaced: int = 0) -> Column:
    """The text with `replaced` characters from the 0-based place on replaced by piece."""
    return F.overlay(text, piece, place + 1, F.lit(replaced))


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def code_point(char: Column) -> Column:
    """U+XXXX of a character."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(char)), 4, "0"))


def padded(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def class_key(profile: Column, operations: Column, ink_mode: Column) -> Column:
    """profile|a -> b|ink mode or none."""
    return F.concat_ws("|", profile, F.array_join(operations, " -> "), F.coalesce(ink_mode, F.lit("none")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON of the columns in sorted order, nulls written."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def escaped(text: Column) -> Column:
    """HTML escape of text and attribute values."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def six_decimals(value: Column) -> Column:
    """A float with six decimals, rounded by its exact binary value, ties to even, a missing one as an empty text."""
    return F.when(value.isNull() | F.isnan(value), F.lit("")).otherwise(F.call_function("format_number", value.cast("double"), F.lit("0.000000")))


def matches_whole(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})\\z")


def contains_any_case(text: Column, tokens: Sequence[str]) -> Column:
    return has_any(F.lower(text), [t.lower() for t in tokens])
