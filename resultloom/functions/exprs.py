"""Column expressions shared by the operators: number text, casting, cleaning, labels.

All are built from Spark's own functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from . import fixed

_FLOAT = r"^[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+(?:_\d+)*)?$"
_PAGE_NUM = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill(template: str, **parts) -> Column:
    """A sentence with its {gaps} filled by columns; null as soon as one gap is null."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = [F.lit(p) if i % 2 == 0 else col(parts[p]).cast("string") for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*out)


def one_of(c, values) -> Column:
    return col(c).isin(*values)


# --- numbers from text ----------------------------------------------------------------------------
def to_float(c) -> Column:
    """Number typed by a user, decimal comma allowed; anything else or non-finite is null."""
    text = F.trim(F.regexp_replace(col(c).cast("string"), ",", "."))
    value = F.regexp_replace(text, "_", "").try_cast("double")
    return F.when(text.rlike(_FLOAT) & (F.abs(value) < F.lit(float("inf"))), value)


def page_num(c) -> Column:
    """Stricter variant of the page: plain decimal or exponent notation only."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), ",", ".")
    return F.when(text.rlike(_PAGE_NUM), text.try_cast("double"))


def positive(c) -> Column:
    return F.when(col(c) > 0, col(c))


# --- text from numbers ----------------------------------------------------------------------------
def _shape(c, pattern: str) -> Column:
    return F.call_function("format_number", col(c), F.lit(pattern))


def fixed_text(c, digits: int) -> Column:
    """Value with a fixed number of decimals, rounded half to even on the exact value."""
    return _shape(c, "0." + "0" * digits if digits else "0")


def grouped_text(c, digits: int = 0) -> Column:
    return F.format_number(col(c), digits)


def _even(c, digits: int) -> Column:
    """Whole numbers without the digits that are not shown, a tie going to the even digit: the number format would round such ties up."""
    v, a = col(c), F.abs(col(c))
    step = F.pow(F.lit(10.0), F.char_length(a.try_cast("long").cast("string")) - digits)
    rest = a % step
    up = (2 * rest > step) | ((2 * rest == step) & (((a - rest) / step) % 2 == 1))
    whole = (a % 1 == 0) & (a >= 10.0 ** digits) & (a < 2.0 ** 53)
    return F.when(whole, F.signum(v) * (a - rest + F.when(up, step).otherwise(0.0))).otherwise(v)


def _scientific(c, digits: int) -> Column:
    return _shape(_even(c, digits), "0." + "0" * (digits - 1) + "E0")


def round_sig(c, digits: int = 3) -> Column:
    """Value rounded to a number of significant digits; null if it is not finite."""
    return _scientific(c, digits).try_cast("double")


def _once(value: Column, text) -> Column:
    """``text`` of a value that is computed once per row, however often the text mentions it: a fold over an array of one, which
    Spark evaluates outside generated code, so that the methods of long sentences stay small enough to be compiled."""
    return F.aggregate(F.array(value), F.lit(None).cast("string"), lambda _, v: text(v))


def _positional(v) -> Column:
    """Text of a rounded value without an exponent: between 1e-3 and 1e7 its plain cast has none, the rare rest goes through a number format."""
    cast = F.regexp_replace(v.cast("string"), r"\.0$", "")
    return F.when(F.abs(v).between(1e-3, 9_999_999), cast).otherwise(_shape(v, "0." + "#" * 330))


def sig_text(c, digits: int = 3) -> Column:
    """Positional text with the given number of significant digits and no trailing zeros."""
    return _once(round_sig(c, digits), lambda v: F.when(v == 0, F.lit("0")).otherwise(_positional(v)))


def general_text(c, digits: int = 6) -> Column:
    """Shortest of positional and exponent notation with `digits` significant digits (C's %g)."""
    def text(shown):
        v, parts = shown.try_cast("double"), F.split(shown, "E")
        e = F.try_element_at(parts, F.lit(2)).try_cast("int")
        power = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(e) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(e).cast("string"))
        return (F.when(v == 0, F.lit("0")).when((F.abs(v) >= 1e-4) & (F.abs(v) < 10.0 ** digits), _positional(v))
                .otherwise(F.concat(F.regexp_replace(F.element_at(parts, 1), r"\.?0+$", ""), power)))
    return _once(_scientific(c, digits), text)


def mm_text(c, mode: str = "sig3") -> Column:
    """Deformation for a sentence: three significant digits, or whole / two decimals."""
    if mode == "sig3":
        return _once(round_sig(c, 3), general_text)
    return F.when(col(c) >= 1, fixed_text(c, 0)).otherwise(fixed_text(c, 2))


def mpa_text(c) -> Column:
    return F.when(col(c) >= 100, fixed_text(c, 0)).otherwise(fixed_text(c, 1))


# --- cleaning ----------------------------------------------------------------------------------------
#: blanks of all scripts, the no-break space and the separators among the control characters as well
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(col(c), _BLANK + "+", " "))


def clean(c) -> Column:
    """Collapsed text without dots at the end; null becomes empty."""
    return F.regexp_replace(collapse_ws(F.coalesce(col(c), F.lit(""))), r"\.+$", "")


def clean_kind(c) -> Column:
    """Result name reduced to plain characters, at most 60 of them."""
    plain = F.regexp_replace(col(c), r"[^A-Za-z0-9 ()/.+\-]", "")
    return F.left(F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"^[ \-.]+|[ \-.]+$", ""), F.lit(60))


def slug(c, empty: str = "report") -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.lit("FEA_Report_"), F.when(text == "", F.lit(empty)).otherwise(text))


def xml_safe(c) -> Column:
    """Text without characters that an XML document cannot hold."""
    return F.regexp_replace(col(c), r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def xml_safe_all(df, except_for=("path", "image", "output")):
    """Control characters removed from every text column but the path columns."""
    kinds = dict(df.dtypes)
    pick = {"string": lambda n: xml_safe(n), "array<string>": lambda n: F.transform(n, xml_safe)}
    return df.select(*[pick[kinds[n]](n).alias(n) if kinds[n] in pick and n not in except_for else F.col(n) for n in df.columns])


def shorten(c, limit: int = 400) -> Column:
    text = col(c)
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.regexp_replace(F.left(text, F.lit(limit)), _BLANK + "+$", ""), F.lit("...")))


def glue_units(c) -> Column:
    """No-break space between a number and its unit."""
    return F.regexp_replace(col(c), rf"(?<=\d) (?={fixed.UNITS}(?![A-Za-z]))", "\u00a0")


# --- file and model names --------------------------------------------------------------------------
def stem(c) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^.*[/\\](?=[^/\\])|[/\\]+$", ""), r"^(.+)\.[^.]*$", "$1")


def view_hint(c) -> Column:
    """'section' or 'detail' told by the file name, else null."""
    name = F.lower(stem(c))
    return (F.when(name.rlike(fixed.NAME_SECTION), F.lit("section")).when(name.rlike(fixed.NAME_DETAIL), F.lit("detail")))


def norm_model(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[_\s]+", " "))


def common_prefix(a, b) -> Column:
    """Number of leading characters two texts share, null if one is null: blocks of halving size behind what is known to be equal are compared, so each
    character is looked at a few times, however long the texts."""
    a, b = col(a), col(b)
    n = F.least(F.char_length(a), F.char_length(b))

    def further(known, step):
        equal = (known + step <= n) & (F.substring(a, known + 1, step) == F.substring(b, known + 1, step))
        return F.when(equal, known + step).otherwise(known)

    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda step: step <= n)
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(steps, F.lit(0), further)).cast("long")


def with_common_prefix(df, a: str, b: str, out: str, width: int = 64):
    """Column with the number of leading characters two text columns share (null counts as empty), by halving steps.

    Each step compares one block of characters behind what is known to be equal, in generated code. Only texts that agree beyond the first block go on with ``common_prefix``.
    """
    x, y = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    df = df.withColumn(out, F.lit(0))
    step = width // 2
    while step:
        n = F.col(out)
        equal = (F.substring(x, n + 1, F.lit(step)) == F.substring(y, n + 1, F.lit(step))) & (F.char_length(x) >= n + step) & (F.char_length(y) >= n + step)
        df = df.withColumn(out, F.when(equal, n + step).otherwise(n))
        step //= 2
    return df.withColumn(out, F.when(F.col(out) == width - 1, common_prefix(x, y)).otherwise(F.col(out)).cast("int"))


def base_role(c="role") -> Column:
    return F.regexp_replace(col(c), "^x_", "")


# --- labels --------------------------------------------------------------------------------------------
def ordinal_date(c) -> Column:
    """3rd Sept 2024"""
    day = F.dayofmonth(col(c))
    ending = F.when(day.between(10, 20), F.lit("th")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ("th", "st", "nd", "rd") + ("th",) * 6]), (day % 10) + 1))
    month = F.element_at(F.array(*[F.lit(m) for m in fixed.MONTHS]), F.month(col(c)))
    return F.concat(day.cast("string"), ending, F.lit(" "), month, F.lit(" "), F.year(col(c)).cast("string"))


def object_label(c) -> Column:
    """First letter as a capital, unless the name is all capitals already."""
    text = col(c)
    all_upper = (F.upper(text) == text) & (F.lower(text) != text)
    return F.when(all_upper, text).otherwise(F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2))))


def ago(now, then) -> Column:
    """Rough age: minutes, hours, days."""
    def half_up(x):
        return F.floor(x + F.lit(0.5)).cast("long")

    minutes = F.greatest(F.lit(0).cast("long"), half_up((F.unix_micros(col(now)) - F.unix_micros(col(then))) / F.lit(60e6)))
    return (F.when(minutes < 1, F.lit("just now")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
            .when(minutes < 1440, F.concat(half_up(minutes / 60).cast("string"), F.lit(" h ago")))
            .otherwise(F.concat(half_up(minutes / 1440).cast("string"), F.lit(" days ago"))))


def _letters(n) -> Column:
    """Letters of a long, place by place from the highest."""
    out = []
    for place in range(13, -1, -1):
        first = (26 ** (place + 1) - 1) // 25          # smallest number with a letter at this place
        digit = F.pmod(F.call_function("div", n - F.lit(first), F.lit(26 ** place)), F.lit(26))
        out.append(F.when(n >= first, F.char((65 + digit).cast("int"))).otherwise(F.lit("")))
    return F.concat(*out)


def list_letter(c) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, 703 -> AAA, also for decimals beyond a long, as far as 2 * 10^37; nothing for numbers below 1."""
    n, most, places = col(c).cast("decimal(38,0)"), (1 << 63) - 1, 13
    first = (26 ** (places + 1) - 1) // 25 - 26 ** places          # smallest number with so many letters
    rest = n - F.lit(first).cast("decimal(20,0)")                  # what is left of them counts the names of so many letters from 0
    block = F.lit(26 ** places).cast("decimal(20,0)")
    low = (rest % block).cast("long") + F.lit(first)
    return F.when(n > most, F.concat(_letters(F.call_function("div", rest, block)), _letters(low))).otherwise(_letters(n.cast("long")))
