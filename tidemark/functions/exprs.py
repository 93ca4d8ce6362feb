"""Scalar expressions: null-strict extremes, safe division, cents, day counts, ladders, branch labels, formats."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Ladder = Sequence[tuple[str, int | None]]


def any_null(*values: Column) -> Column:
    return reduce(lambda a, b: a | b, [v.isNull() for v in values])


def nmax(*values: Column) -> Column:
    """The largest; null if any is null, so a missing operand is not taken for the smallest."""
    return F.when(~any_null(*values), F.greatest(*values))


def nmin(*values: Column) -> Column:
    """The smallest; null if any is null."""
    return F.when(~any_null(*values), F.least(*values))


def safe_div(a: Column, b: Column) -> Column:
    """a / b in double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def cents(value: Column) -> Column:
    """Rounded half away from zero to two digits; value is a decimal, as doubles hold no exact half cents."""
    return F.round(value, 2).cast("decimal(38,2)")


def amount(value: Column) -> Column:
    """A rounded amount as it is filed: exact cents, given as double."""
    return cents(value).cast("double")


def days_between(anchor: Column, field: Column) -> Column:
    """Whole days from anchor to field; an open (null) date counts 0."""
    return F.coalesce(F.datediff(field, anchor), F.lit(0))


def date_bucket(anchor: Column, field: Column, ladder: Ladder) -> Column:
    """`open` for an open date, else the first bucket of the ladder with days <= its maximum; None is unbounded."""
    days = F.datediff(field, anchor)
    out = F.when(field.isNull(), F.lit("open"))
    for name, most in ladder:
        out = out.when(days <= most, name) if most is not None else out.otherwise(name)
    return out


def ladder_ordinal(bucket: Column, ladder: Ladder) -> Column:
    """Place of a bucket in its ladder, `open` first; null for another value."""
    out = F.when(bucket == "open", 0)
    for i, (name, _) in enumerate(ladder):
        out = out.when(bucket == name, i + 1)
    return out


def case_value(branches: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Value of the first true branch."""
    out = reduce(lambda w, b: w.when(*b), branches[1:], F.when(*branches[0]))
    return out if default is None else out.otherwise(default)


def case_branch(conditions: Sequence[Column], has_else: bool) -> Column:
    """Which branch fired: `branch n`, `else` or `no branch matched`."""
    out = F.when(conditions[0], "branch 1")
    for i, c in enumerate(conditions[1:], 2):
        out = out.when(c, f"branch {i}")
    return out.otherwise("else" if has_else else "no branch matched")


def truth(condition: Column) -> Column:
    """A condition as 1 or 0."""
    return condition.cast("int")


def fixed(value: Column, digits: int) -> Column:
    """A decimal as text with so many digits after the point, rounded half away from zero, without thousands marks."""
    return F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")


def signed_text(value: Column, text: Column) -> Column:
    return F.concat(F.when(value > 0, F.lit("+")).otherwise(F.lit("")), text)


def formatted(value: Column, fmt: str) -> Column:
    """A decimal as a report shows it: percent_1dp, percent_2dp, usd, usd_mm, bps, number, tick or delta; null as a dash."""
    grouped = lambda v, n: F.format_number(F.round(v, n), n)
    shapes = {
        "percent_1dp": lambda: F.concat(fixed(value, 1), F.lit("%")),
        "percent_2dp": lambda: F.concat(fixed(value, 2), F.lit("%")),
        "usd": lambda: F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), grouped(F.abs(value), 0)),
        "usd_mm": lambda: F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), fixed(F.abs(value) / 1_000_000, 1), F.lit("mm")),
        "bps": lambda: F.concat(fixed(value, 0), F.lit(" bps")),
        "number": lambda: grouped(value, 2),
        "tick": lambda: F.when(F.abs(value) >= 1_000_000, F.concat(fixed(value / 1_000_000, 0), F.lit("m"))).when(F.abs(value) >= 1000, F.concat(fixed(value / 1000, 0), F.lit("k"))).otherwise(fixed(value, 0)),
        "delta": lambda: signed_text(value, fixed(value, 2)),
    }
    return F.when(value.isNull(), F.lit("-")).otherwise(shapes[fmt]())


def between_effective(day: Column, start: Column, end: Column) -> Column:
    """In force on a day: [start, end), an open end never ends."""
    return (day >= start) & (end.isNull() | (day < end))


#: Formats that measures may declare, with the unit and the decimals that they show; all others are plain numbers.
PERCENTAGES = {f"percent_{n}dp": n for n in range(10)}
DOLLARS = "currency_usd"


def unit_of(fmt: Column) -> Column:
    """The unit that a measure's format states: percent, USD (of all dollar formats) or number."""
    return F.when(fmt.isin(*PERCENTAGES), "percent").when(F.left(fmt, F.lit(len(DOLLARS))) == DOLLARS, "USD").otherwise("number")


def precision_of(fmt: Column) -> Column:
    """The decimals that a measure's format states; 0 unless it is a percentage."""
    shown = F.create_map(*[F.lit(x) for pair in PERCENTAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(shown, fmt), F.lit(0))


def denominator_of(expression: Column) -> Column:
    """The column that a ratio divides by, where its expression names one outright, guarded against zero or not; else null.

    What follows each division is looked at in turn: an opening guard is taken off, and the first word is the column unless
    it begins like a number."""
    blank = F.lit(" \t\r\n")

    def named(part: Column) -> Column:
        plain = F.btrim(part, blank)
        opening = F.lower(F.btrim(F.substring_index(plain, "(", 1), blank))
        guarded = plain.contains("(") & (opening == "nullif")
        inside = F.btrim(F.substring(plain, F.instr(plain, "(") + 1, F.length(plain)), blank)
        word = F.element_at(F.split(F.when(guarded, inside).otherwise(plain), "[^A-Za-z0-9_]"), 1)
        return F.when((word != "") & ~F.left(word, F.lit(1)).between("0", "9"), word)

    sides = F.split(expression, "/")
    found = F.transform(F.slice(sides, F.lit(2), F.greatest(F.size(sides), F.lit(1))), named)
    return F.try_element_at(F.array_compact(found), F.lit(1))
