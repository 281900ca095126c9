"""Reading decorated text: numbers, percentages, dates, flags, labels and period labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that stand for "no value".
EMPTY_MARKS = ("", "-", "--", "–", "—", "na", "n/a", "n.a.", "n.a", "nil", "null", "none", "nan")
_OTHER_DIGITS = "０１２３４５６７８９०१२३४५६७८९"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: The rupee sign, also as it looks when read with a wrong encoding.
_CURRENCY = r"(?:₹|rs\.?|inr|\$|â‚¹|â\x{82}¹|‚çπ|‚Çπ|γé╣|Γé╣|ã¢â€šâ¹|Ã¢â€šÂ¹)"

_NUMBER = r"^[-+]?\s?(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:e[-+]?\d{1,3})?$"
_DATES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)


def tidy(value: Column) -> Column:
    """Trimmed, with every kind of space as one blank and ASCII digits and minus."""
    x = F.regexp_replace(value, r"[\s\x{00a0}\x{2007}\x{202f}\x{200b}]+", " ")
    x = F.translate(x, _OTHER_DIGITS + "−", "01234567890123456789-")
    return F.trim(x)


def present(value: Column) -> Column:
    """The tidy value, null if it is only an empty mark."""
    return let(tidy(value), lambda x: F.when(~F.lower(x).isin(*EMPTY_MARKS), x))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def _plain_number(x: Column) -> Column:
    """One number in digits, Indian or western grouping, sign, brackets for minus, exponent."""
    y = F.regexp_replace(F.lower(x), rf"^([(\-+ ]*){_CURRENCY}\s*", "$1")
    y = F.trim(F.regexp_replace(y, r"\s*[*†‡#^]+$", ""))
    y = F.regexp_replace(y, r"\s*(?:cr\.?|crores?|nos\.?|units?|days?)$", "")

    def signed(y: Column) -> Column:
        inner = F.regexp_replace(y, r"^\(\s*(.*?)\s*\)$", "$1")
        sign = F.when(y.startswith("("), -1.0).otherwise(1.0)
        return let(inner, lambda z: F.when(z.rlike(_NUMBER), F.regexp_replace(z, r"[,\s]", "").try_cast("double") * sign))

    return let(y, signed)


def _percent(x: Column) -> Column:
    return _plain_number(F.regexp_replace(F.lower(x), r"\s*(?:%|pct\.?|per\s?cent)\s*(\)?)\s*$", "$1"))


def _date(x: Column) -> Column:
    parsed = [F.when(x.rlike(pattern), F.try_to_timestamp(x, F.lit(form)).cast("date")) for pattern, form in _DATES]
    millis = F.date_from_unix_date(F.floor(x.try_cast("bigint") / 86_400_000).cast("int"))
    return F.coalesce(*parsed, F.when(x.rlike(r"^-?\d{1,15}$"), millis))


def _flag(x: Column) -> Column:
    y = F.lower(F.regexp_replace(x, r"[.\s]+$", ""))
    return let(y, lambda z: F.when(z.isin("yes", "y", "true", "t", "1"), True).when(z.isin("no", "n", "false", "f", "0"), False))


def read_number(value: Column) -> Column:
    return let(present(value), _plain_number)


def read_percent(value: Column) -> Column:
    """One percentage, with or without its sign or word."""
    return let(present(value), _percent)


def read_date(value: Column) -> Column:
    """One valid calendar date; with slashes the day stands first, a bare integer counts milliseconds."""
    return let(present(value), _date)


def read_flag(value: Column) -> Column:
    return let(present(value), _flag)


def read_typed(value: Column, value_type: Column) -> Column:
    """The value read in its type as a struct (number, day, flag, text); null if it can't be read. Only
    the reader of the type runs."""

    def read(v: Column) -> Column:
        number = F.when(value_type == "number", _plain_number(v)).when(value_type == "percent", _percent(v))
        return F.struct(
            number.alias("number"), F.when(value_type == "date", _date(v)).alias("day"),
            F.when(value_type == "flag", _flag(v)).alias("flag"), F.when(value_type == "text", v).alias("text"),
        )

    def filled(s: Column) -> Column:
        return F.when(s["number"].isNotNull() | s["day"].isNotNull() | s["flag"].isNotNull() | s["text"].isNotNull(), s)

    return let(let(present(value), read), filled)


def label_key(label: Column) -> Column:
    """What identifies a label: letters and digits only, without bracketed units."""
    x = F.regexp_replace(F.lower(label), r"[(\[{][^)\]}]*[)\]}]", " ")
    return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")


def period_month(label: Column) -> Column:
    """``yyyy-MM`` of a period label such as ``Mar 2024``, ``Mar-24``, ``31 Mar 2024``, ``2024-03``."""
    named = r"^(?:\d{1,2}[ -])?([a-z]{3})[a-z]*[ ,'-]+(\d{4}|\d{2})$"

    def by_name(x: Column) -> Column:
        at = F.instr(F.lit(_MONTHS), F.regexp_extract(x, named, 1))
        year = F.lpad(F.regexp_extract(x, named, 2), 4, "20")
        month = F.lpad(((at - 1) / 3 + 1).cast("int").cast("string"), 2, "0")
        return F.when(x.rlike(named) & (at > 0) & ((at - 1) % 3 == 0), F.concat(year, F.lit("-"), month))

    iso = r"^\d{4}-(?:0[1-9]|1[0-2])(?:-\d{2})?$"
    return let(F.lower(tidy(label)), lambda x: F.when(x.rlike(iso), F.substring(x, 1, 7)).otherwise(by_name(x)))
