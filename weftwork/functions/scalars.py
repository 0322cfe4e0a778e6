"""Column functions with the string, null and date rules of JavaScript, on Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what JavaScript takes for white space and for the end of a line, as the inside of a character class
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
JS_LINE_END = r"\n\r\x{2028}\x{2029}"
#: The same white space, each character once.
_JS_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The start of a line (JavaScript's ^ with the m flag); Java's own would begin one after U+0085 too.
JS_LINE_START = f"(?<![^{JS_LINE_END}])"
#: What stands for half of a character beyond U+FFFF, as JavaScript's encoders write it.
HALF = "\ufffd"


def quoted(text: str) -> str:
    """text as a pattern that matches itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def js_trim(s: Column) -> Column:
    """Strips JavaScript's white space, where Spark's trim strips blanks alone."""
    return F.btrim(s, F.lit(_JS_SPACES))


def js_split(s: Column, separator: str) -> Column:
    """Split at a text, not a pattern; empty parts at the end stay."""
    return F.split(s, quoted(separator), -1)


def replace_first(s: Column, what: str, by: str) -> Column:
    """Replaces the first occurrence only."""
    at = F.instr(s, F.lit(what))
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(by), F.substring(s, at + len(what), F.length(s)))).otherwise(s)


def index_of(s: Column, what: str) -> Column:
    """Position from 0, in UTF-16 units; -1 where there is none."""
    at = F.instr(s, F.lit(what))
    return F.when(at > 0, utf16_length(F.substring(s, F.lit(1), at - 1))).otherwise(at - 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _between_units(s: Column, low: Column, high: Column) -> Column:
    """Units low to high, low < high, of a text that has characters beyond U+FFFF."""

    def half_at(u: Column, unit: Column, first: str, last: str) -> Column:
        return F.substring(u, 2 * unit + 1, F.lit(1)).between(F.unhex(F.lit(first)), F.unhex(F.lit(last)))

    def made(x: Column) -> Column:
        # a second half at the start and a first half at the end are read alone
        starts, ends = half_at(x["units"], x["low"], "DC", "DF"), half_at(x["units"], x["high"] - 1, "D8", "DB")
        first, last = x["low"] + starts.cast("int"), x["high"] - ends.cast("int")
        whole = F.decode(F.substring(x["units"], 2 * first + 1, 2 * (last - first)), "UTF-16BE")
        return F.concat(F.when(starts, HALF).otherwise(""), whole, F.when(ends, HALF).otherwise(""))

    return _let(F.struct(F.encode(s, "UTF-16BE").alias("units"), low.cast("int").alias("low"), high.cast("int").alias("high")), made)


def js_substring(s: Column, start: Column, end: Column | None = None) -> Column:
    """UTF-16 units from start up to end, from 0. Ends out of range are moved in and reversed ends change places; half a character reads U+FFFD."""
    a = F.greatest(F.lit(0), start)
    b = F.lit(2**31 - 1) if end is None else F.greatest(F.lit(0), end)
    ends = F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), utf16_length(s).alias("n"))

    def made(x: Column) -> Column:
        low, high = F.least(x["low"], x["n"]), F.least(x["high"], x["n"])
        return F.when(x["n"] == F.length(s), F.substring(s, low + 1, high - low)).when(low == high, F.lit("")).otherwise(_between_units(s, low, high))

    return _let(ends, made)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF, four bytes each in UTF-8, count twice."""
    n = F.length(s)
    return F.when(F.octet_length(s) == n, n).otherwise(F.floor(F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int"))


def text_plus(*parts: Column) -> Column:
    """Concatenation in which null reads `null`."""
    return F.concat(*(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))


def falsy_or(s: Column, other: Column) -> Column:
    """other where s is null or empty."""
    return F.coalesce(F.nullif(s, F.lit("")), other)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def slug(s: Column) -> Column:
    """Lower case, underscores to dashes, then only a-z, 0-9 and dashes."""
    return F.regexp_replace(F.replace(F.lower(s), F.lit("_"), F.lit("-")), "[^a-z0-9-]", "")


def dash_slug(s: Column) -> Column:
    """Lower case, runs of white space to one dash; punctuation stays."""
    return F.regexp_replace(F.lower(s), f"[{JS_SPACE}]+", "-")


def replace_matches(s: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """Each match m replaced by by(m). The texts between matches and the matches are put together in turn."""
    between = F.split(s, pattern, -1)
    matches = F.concat(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, F.transform(matches, lambda m: F.when(m == "", m).otherwise(by(m))), lambda a, b: F.concat(a, b)), "")


def without(array: Column, value: Column) -> Column:
    """All equal items go; a null array stays null."""
    return F.filter(array, lambda x: ~x.eqNullSafe(value))


def append(array: Column, value: Column) -> Column:
    return F.concat(array, F.array(value))


def inner_items(array: Column) -> Column:
    """Without the first and the last item; empty where there are no others."""
    return F.when(F.size(array) > 2, F.slice(array, F.lit(2), F.greatest(F.size(array) - 2, F.lit(0)))).otherwise(F.slice(array, 1, 0))


def sendable(text: Column, busy: Column) -> Column:
    """Whether there is text beside white space and nothing is under way; null text is none, null busy is not."""
    return F.coalesce(js_trim(text) != "", F.lit(False)) & ~F.coalesce(busy, F.lit(False))


def by_flag(flag: Column, yes: Column, no: Column) -> Column:
    """yes where the flag is true, no where it is false or null."""
    return F.when(flag, yes).otherwise(no)


def lookup(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """The value of the first equal key; the default, else null, where none is equal."""
    found = F.lit(None).cast("string") if default is None else default
    for k, v in reversed(values.items()):
        found = F.when(key == k, v).otherwise(found)
    return found


def with_field(record: Column, name: Column, value: Column) -> Column:
    """A map with one field set, whose name is a value of the row. A null name changes nothing."""
    changed = F.map_concat(F.map_filter(record, lambda k, _: k != name), F.create_map(name, value))
    return F.when(name.isNull(), record).otherwise(changed)


def has_items(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def long_date(ts: Column) -> Column:
    """March 5, 2023."""
    return F.date_format(ts, "MMMM d, yyyy")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def now_iso() -> Column:
    """The time of the query as ISO text in UTC; one value a query."""
    return iso_text(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def now_millis(plus: int = 0) -> Column:
    """Milliseconds from 1970 to the time of the query."""
    return F.unix_millis(F.current_timestamp()) + F.lit(plus)


def current_year() -> Column:
    """In the time zone of the session."""
    return F.year(F.current_date())


def header_map(headers: dict[str, str | Column]) -> Column:
    """A map from names to texts or columns."""
    return F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def video_id(url: Column) -> Column:
    """The eleven characters that name a video in the usual forms of its address; null for other addresses."""
    # fixed value: the forms of address
    forms = r"^.*((youtu.be\/)|(v\/)|(\/u\/\w\/)|(embed\/)|(watch\?))\??v?=?([^#&?]*).*"
    found = F.regexp_extract(url, forms, 7)
    return F.when(F.length(found) == 11, found)


def thumbnail(video: Column) -> Column:
    # fixed value: the address of a preview
    return F.when(F.length(video) > 0, F.concat(F.lit("https://img.youtube.com/vi/"), video, F.lit("/hqdefault.jpg")))


def is_internal(link: Column) -> Column:
    return F.coalesce(F.startswith(link, F.lit("/")), F.lit(False))
