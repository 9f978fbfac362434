"""Text functions with the edge cases that log lines need. All are Columns: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x01\x02"  # stands between captured groups
MAP = "map<string,string>"
_SPACES = "".join(map(chr, range(0x21)))


def strip(x: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (tabs and control characters too)."""
    # Trimming by a set costs far more than a look at both ends, and most texts have nothing to trim.
    return F.when((x >= "!") & (F.substring(x, -1, 1) >= "!"), x).otherwise(F.btrim(x, F.lit(_SPACES)))


def has_text(x: Column) -> Column:
    """Whether there is more than white space; null for null."""
    return F.when(x >= "!", True).otherwise(x.rlike(r"\S"))  # no pattern where the first character says it


def blank(x: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(~has_text(x), F.lit(True))


def whole(pattern: str, flags: str = "") -> str:
    """A pattern for rlike that has to match the entire value."""
    return f"{f'(?{flags})' if flags else ''}\\A(?:{pattern})\\z"


def captured(x: Column, pattern: str, groups: int, flags: str = "") -> Column:
    """All groups of a whole match as an array, by one run of the pattern; unmatched groups are empty strings. The control
    character that ends ``SEP`` counts as a space, in ``matched`` too."""
    out = SEP.join(f"${i}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(F.replace(x, F.lit(SEP[-1]), F.lit(" ")), whole(pattern, flags), out), SEP, -1)


def matched(x: Column, pattern: str, flags: str = "") -> Column:
    """Whether ``captured`` finds the groups."""
    return F.replace(x, F.lit(SEP[-1]), F.lit(" ")).rlike(whole(pattern, flags))


def those(kind: str, *given: tuple[Column | None, Column]) -> Column:
    """The values, of the type ``kind``, whose condition holds (None: always), as an array. Unlike a filter of an array, this is compiled with its conditions."""
    none = F.array().cast(f"array<{kind}>")
    return F.concat(none, *[F.array(v) if c is None else F.when(c, F.array(v)).otherwise(none) for c, v in given])


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def columns_split(x: Column) -> Column:
    """Comma-separated columns, trailing empty ones dropped."""
    return F.split(F.rtrim(x, F.lit(",")), ",", -1)


def n_columns(x: Column) -> Column:
    """How many columns a line has, trailing empty ones not counted; 1 without a comma."""
    kept = F.rtrim(x, F.lit(","))
    return F.when(x.contains(","), F.char_length(kept) - F.char_length(F.replace(kept, F.lit(","), F.lit(""))) + 1).otherwise(1)


def to_map(keys: Column, values: Column) -> Column:
    """A map in which the last of equal keys wins, in time that grows with the pairs (and the sorting of lines that repeat a key)."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    numbered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v"))))
    # The sorted pairs stand in an array of one, so that a name is bound to them and they aren't sorted for every pair.
    last = F.flatten(F.transform(F.array(numbered), lambda s: F.filter(s, lambda p, i: ~p["k"].eqNullSafe(F.get(s, i + 1)["k"]))))
    plain = F.transform(last, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    return F.map_from_entries(F.when(F.size(keys) == F.size(F.array_distinct(keys)), pairs).otherwise(plain))


def first_of(m: Column, *keys: str) -> Column:
    return F.coalesce(*[m[k] for k in keys]) if len(keys) > 1 else m[keys[0]]


def integer(x: Column) -> Column:
    """A signed decimal number that fits 32 bits, else null; no spaces."""
    return F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("int"))


def port(x: Column) -> Column:
    n = integer(x)
    return F.when(n.between(0, 65535), n)


def iso(ts: Column) -> Column:
    """A timestamp as ISO text in UTC, with micros only where there are any."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def bsd_time(month: Column, day: Column, clock: Column, received: Column) -> Column:
    """Month, day and clock in the year of ``received``, as ISO text; ``received`` where that is no time."""
    text = F.concat_ws(" ", F.year(received).cast("string"), month, F.lpad(day, 2, "0"), clock)
    found = F.when(month.rlike("^[A-Z][a-z]{2}$"), F.try_to_timestamp(text, F.lit("yyyy MMM dd HH:mm:ss")))
    return F.coalesce(iso(found), iso(received))


#: Words that decide an action; the first list is tested first.
BLOCKED = ("deny", "denied", "block", "drop", "reject")
ALLOWED = ("permit", "allow", "accept", "pass")


def action(x: Column, blocked: tuple[str, ...] = BLOCKED, allowed: tuple[str, ...] = ALLOWED) -> Column:
    low = F.lower(x)
    any_of = lambda words: F.expr("false") if not words else low.rlike("|".join(words))
    return F.when(any_of(blocked), "blocked").when(any_of(allowed), "allowed").otherwise(low)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_QUAD = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"
_INSIDE = r"\A0*(?:(?:10|127)\.|172\.0*(?:1[6-9]|2[0-9]|3[01])\.|192\.0*168\.|169\.0*254\.|100\.0*(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)"
_INSIDE_TEXT = r"\A(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])(?:\.|\z))"
_V6 = r"\A[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*\z"
_INSIDE_V6 = r"(?i)\A(?:::1|0*(?::0*){6}:0*1|fe[89a-f][0-9a-f]:.*)\z"


def internal(ip: Column) -> Column:
    """Whether an address is private, loopback, link-local or carrier-grade NAT. Text that is no address goes by how it begins;
    names are never looked up."""
    x = strip(ip)
    known = F.when(x.rlike(_QUAD), x.rlike(_INSIDE)).when(x.rlike(_V6), x.rlike(_INSIDE_V6)).otherwise(x.rlike(_INSIDE_TEXT))
    return F.when(blank(ip) | ip.isin("0.0.0.0", "::"), False).otherwise(known)


def address_category(ip: Column) -> Column:
    return F.when(blank(ip), "UNKNOWN").when(internal(ip), "PRIVATE_RFC1918").otherwise("PUBLIC_INTERNET")
