"""Cleaners of e-mails, URLs, IPv4 addresses, telephone numbers, amounts, JSON and dates, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_null

#: What an unquoted local part is made of, beside dots (RFC 5322, atext), and a domain label (RFC 1035).
ATEXT = "abcdefghijklmnopqrstuvwxyz0123456789!#$%&'*+-/=?^_`{|}~"
LABEL = "abcdefghijklmnopqrstuvwxyz0123456789-"
PHONE = r"^\s*(?:\+?1[-. ]*)?\(?([2-9][0-9]{2})\)?[-. ]*([0-9A-Za-z]{3})[-. ]*([0-9A-Za-z]{4})(?:\s*(?:#|x|ext)\.?\s*(\d+))?\s*$"
#: Names of query parameters that carry credentials.
AUTH = ("access_token", "auth_key", "auth", "password", "username", "login", "token", "passcode", "access-token", "auth-key", "authentication", "authentication-key")
CODES = "0 null, 1 not valid, 2 changed, 3 unchanged"


def coded(c: Column, value: Column) -> Column:
    """What became of a cell: see CODES."""
    return F.when(is_null(c), 0).when(value.isNull(), 1).when(value.cast("string") == c.cast("string"), 3).otherwise(2)


def report(df: DataFrame, column: str) -> DataFrame:
    """(code, count) of a cleaned column."""
    return df.groupBy(coded(F.col(f"`{column}`"), F.col(f"`{column}_clean`")).alias("code")).agg(F.count("*").alias("count"))


def _add(df: DataFrame, column: str, value: Column, errors: str) -> DataFrame:
    c = F.col(f"`{column}`")
    bad = {"coerce": F.lit(None), "ignore": c.cast("string"), "raise": F.when(is_null(c), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not valid: "), c.cast("string"))))}[errors]
    return df.withColumn(f"{column}_clean", F.coalesce(value, bad))


def email(c: Column, remove_whitespace: bool = False) -> Column:
    t = F.lower(c.cast("string"))
    t = F.regexp_replace(t, r"\s+", "") if remove_whitespace else t
    parts = F.split(t, "@")
    user, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    atoms, labels = F.split(user, r"\."), F.split(domain, r"\.")
    only = lambda x, chars: F.translate(x, chars, "") == ""
    user_ok = F.forall(atoms, lambda x: (x != "") & only(x, ATEXT)) & (F.octet_length(user) <= 64)
    label_ok = lambda x: F.char_length(x).between(1, 63) & only(x, LABEL) & ~x.startswith("-") & ~x.endswith("-")
    domain_ok = (F.size(labels) >= 2) & F.forall(labels, label_ok) & (F.char_length(F.element_at(labels, -1)) >= 2)
    return F.when(~is_null(c) & (F.size(parts) == 2) & user_ok & domain_ok, t)


def clean_email(df: DataFrame, column: str, remove_whitespace: bool = False, split: bool = False, errors: str = "coerce") -> DataFrame:
    value = email(F.col(f"`{column}`"), remove_whitespace)
    return df.withColumns({"username": F.split_part(value, F.lit("@"), F.lit(1)), "domain": F.split_part(value, F.lit("@"), F.lit(-1))}) if split else _add(df, column, value, errors)


def url(c: Column, remove_auth: bool | list[str] = False) -> Column:
    """struct(scheme, host, url_clean, queries), or null."""
    t = F.regexp_replace(F.coalesce(F.try_url_decode(c.cast("string")), c.cast("string")), r"\s+", "")
    scheme, host = F.try_parse_url(t, F.lit("PROTOCOL")), F.try_parse_url(t, F.lit("HOST"))
    drop = [] if remove_auth is False else [*AUTH, *([] if remove_auth is True else remove_auth)]
    query = F.try_parse_url(t, F.lit("QUERY"))
    pairs = F.map_filter(F.str_to_map(query, F.lit("&"), F.lit("=")), lambda k, v: ~k.isin(drop)) if drop else F.str_to_map(query, F.lit("&"), F.lit("="))
    bare = F.concat(scheme, F.lit("://"), host, F.coalesce(F.try_parse_url(t, F.lit("PATH")), F.lit("")))
    return F.when(~is_null(c) & scheme.isin("http", "https") & host.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.struct(scheme.alias("scheme"), host.alias("host"), bare.alias("url_clean"), pairs.alias("queries")))


def clean_url(df: DataFrame, column: str, remove_auth: bool | list[str] = False, split: bool = False) -> DataFrame:
    u = url(F.col(f"`{column}`"), remove_auth)
    return df.withColumns({"scheme": u["scheme"], "host": u["host"], f"{column}_clean": u["url_clean"], "queries": u["queries"]}) if split else df.withColumn(f"{column}_details", u)


def ipv4(c: Column, output_format: str = "compressed") -> Column:
    t = F.trim(c.cast("string"))
    n = t.try_cast("long")
    t = F.when(n.between(0, 2**32 - 1) & ~t.contains("."), F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])).otherwise(t)
    parts = F.split(t, r"\.")
    part = [F.coalesce(F.get(parts, k).try_cast("int"), F.lit(0)) for k in range(4)]
    ok = t.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    number = sum((p.cast("long") * 256 ** (3 - k) for k, p in enumerate(part)), F.lit(0).cast("long"))
    out = {"compressed": t, "full": F.concat_ws(".", *[F.lpad(p.cast("string"), 4, "0") for p in part]), "binary": F.lpad(F.bin(number), 32, "0"), "hexa": F.concat(F.lit("0x"), F.lower(F.hex(number))), "integer": number.cast("string"), "packed": F.hex(number)}[output_format]
    return F.when(ok, out)


def phone(c: Column, output_format: str = "nanp") -> Column:
    """North American numbers; letters stand for digits."""
    t = c.cast("string")
    g = lambda k: F.translate(F.upper(F.regexp_extract(t, PHONE, k)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
    ext = F.regexp_extract(t, PHONE, 4)
    body = {"nanp": F.concat_ws("-", g(1), g(2), g(3)), "e164": F.concat(F.lit("+1"), g(1), g(2), g(3)), "national": F.concat(F.lit("("), g(1), F.lit(") "), g(2), F.lit("-"), g(3))}[output_format]
    return F.when(~is_null(c) & t.rlike(PHONE), F.concat(body, F.when(ext != "", F.concat(F.lit(" ext. "), ext)).otherwise("")))


def amount(c: Column, n_round: int = 2, rate: float = 1.0) -> Column:
    """A money amount as a number, its symbol or code and thousands commas dropped; rate converts."""
    t = F.regexp_replace(c.cast("string"), r"(?U)[\p{Sc}\s,]|^[A-Z]{3}|[A-Z]{3}$", "")
    return F.round(t.try_cast("double") * rate, n_round)


def flattened_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds a column for each field of a DDL schema; rows that aren't JSON get nulls."""
    return df.withColumn("__j", F.from_json(F.col(f"`{column}`"), schema)).select(*df.columns, "__j.*")


#: The shapes of dates that are read, and the format of each; a day or month first stands as D/M and is settled for the whole column.
DATES = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{4}\.\d{1,2}\.\d{1,2}", "yyyy.M.d"), (r"\d{8}", "yyyyMMdd"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "D/M/yyyy"), (r"\d{1,2}-\d{1,2}-\d{4}", "D-M-yyyy"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "D.M.yyyy"),
    (r"[A-Za-z]{4,} \d{1,2},? \d{4}", "MMMM d yyyy"), (r"[A-Za-z]{3} \d{1,2},? \d{4}", "MMM d yyyy"), (r"\d{1,2} [A-Za-z]{4,},? \d{4}", "d MMMM yyyy"), (r"\d{1,2} [A-Za-z]{3},? \d{4}", "d MMM yyyy"),
]
TIMES = [("", ""), (r"[ T]\d{1,2}:\d{1,2}:\d{1,2}", " H:m:s"), (r"[ T]\d{1,2}:\d{1,2}", " H:m"), (r" \d{1,2}:\d{1,2}:\d{1,2} ?[AaPp][Mm]", " h:m:s a"), (r" \d{1,2}:\d{1,2} ?[AaPp][Mm]", " h:m a"), (r" \d{1,2} ?[AaPp][Mm]", " h a")]
PARTIAL = [(r"\d{4}", "yyyy", "M-d"), (r"\d{4}-\d{1,2}", "yyyy-M", "d"), (r"[A-Za-z]{4,} \d{4}", "MMMM yyyy", "d"), (r"[A-Za-z]{3} \d{4}", "MMM yyyy", "d")]


def is_day_first(df: DataFrame, column: str) -> bool:
    """Whether some value's first number can only be a day: one pass over the column."""
    first = F.regexp_extract(F.col(f"`{column}`").cast("string"), r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-]\d{4}", 1).try_cast("int")
    return (df.agg(F.max(first)).first()[0] or 0) > 12


def timestamp(c: Column, day_first: bool = False, fix_missing: str | None = None) -> Column:
    """A date or time in any of the known shapes; the shape is told first, so that each text is parsed once.

    fix_missing says what stands for the month and day of a text that lacks them: minimum (the first) or current (today's); by default it is no date.
    """
    t = F.trim(F.regexp_replace(c.cast("string"), r"(?i)(\d)(st|nd|rd|th)\b", "$1"))
    t = F.regexp_replace(t, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    day = F.regexp_extract(t, r"^(.*?)(?:[ T]\d{1,2}(?::\d{1,2}){0,2} ?(?:[AaPp][Mm])?)?$", 1)
    clock = F.substring(t, F.char_length(day) + 1, F.lit(32))
    day = F.replace(day, F.lit(","), F.lit(""))
    own = "d/M" if day_first else "M/d"
    swap = lambda f: f.replace("D/M", own).replace("D-M", own.replace("/", "-")).replace("D.M", own.replace("/", "."))
    day_format = F.coalesce(*[F.when(day.rlike(f"^{shape.replace(',?', '')}$"), swap(f)) for shape, f in DATES])
    clock_format = F.coalesce(*[F.when(clock.rlike(f"^{shape}$"), f) for shape, f in TIMES])
    clock = F.upper(F.regexp_replace(F.regexp_replace(clock, "^T", " "), r"(\d)([AaPp])", "$1 $2"))
    found = F.try_to_timestamp(F.concat(day, clock), F.concat(day_format, clock_format))
    if fix_missing is None:
        return found
    rest = {"minimum": {"M-d": F.lit("1-1"), "d": F.lit("1")}, "current": {"M-d": F.date_format(F.current_date(), "M-d"), "d": F.date_format(F.current_date(), "d")}}[fix_missing]
    whole = [F.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(F.concat(t, F.lit("-"), rest[lack]), F.lit(f"{f}-{lack}"))) for shape, f, lack in PARTIAL]
    return F.coalesce(*whole, found)


def clean_date(df: DataFrame, column: str, output_format: str = "yyyy-MM-dd HH:mm:ss", infer_day_first: bool = True, errors: str = "coerce", input_timezone: str | None = None, output_timezone: str | None = None, fix_missing: str | None = None) -> DataFrame:
    """Adds <column>_clean; output_format is a pattern of datetime fields, and another one raises ValueError."""
    if re.search(r"[A-Za-z]", re.sub(r"'[^']*'|[yMdHhmsSaEGDuQLVzOXxkKBnN]", "", output_format)):
        raise ValueError(f"not a format of dates: {output_format}")
    c = F.col(f"`{column}`")
    ts = F.when(~is_null(c), timestamp(c, infer_day_first and is_day_first(df, column), fix_missing))
    if output_timezone:
        ts = F.convert_timezone(F.lit(input_timezone or "UTC"), F.lit(output_timezone), ts.cast("timestamp_ntz"))
    return _add(df, column, F.date_format(ts, output_format), errors)


def ipv6(c: Column, output_format: str = "compressed") -> Column:
    """An IPv6 address in full, compressed or hexadecimal form."""
    t = F.lower(F.trim(c.cast("string")))
    sides = F.split(t, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    lack = F.lit(8) - F.size(left) - F.size(right)
    all_groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(lack, F.lit(0))), right)
    shape = t.rlike("^[0-9a-f:]+$") & ~t.rlike(":::|^:[^:]|[^:]:$") & (F.size(sides) <= 2) & F.when(F.size(sides) == 2, lack >= 1).otherwise(lack == 0)
    ok = shape & F.forall(all_groups, lambda g: F.char_length(g) <= 4)
    full = F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), ":")
    short = F.array_join(F.transform(all_groups, lambda g: F.when(g.rlike("^0+$"), "0").otherwise(F.regexp_replace(g, "^0+", ""))), ":")
    runs = [F.when(F.concat(F.lit(":"), short, F.lit(":")).contains(":" + "0:" * k), F.regexp_replace(short, rf"^(?:(.*?):)??{':'.join(['0'] * k)}(?::(.*))?$", "$1::$2")) for k in range(8, 1, -1)]
    out = {"full": full, "compressed": F.coalesce(*runs, short), "hexa": F.concat(F.lit("0x"), F.replace(full, F.lit(":"), F.lit("")))}[output_format]
    return F.when(ok, out)


#: Whether a value is valid, by kind.
VALID = {"email": email, "url": url, "ip": lambda c: F.coalesce(ipv4(c), ipv6(c)), "ipv4": ipv4, "ipv6": ipv6, "phone": phone, "date": timestamp}


def validate(c: Column, kind: str) -> Column:
    """True where a value is valid of its kind; missing ones aren't."""
    return F.coalesce(~is_null(c) & VALID[kind](c).isNotNull(), F.lit(False))
