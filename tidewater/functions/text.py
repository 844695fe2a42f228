"""Scalar functions on text as Columns: case, blanks, numbers, URLs, dates, codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import values as V

# Names of states and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
    "calif": "CA", "calif.": "CA", "tex": "TX", "tex.": "TX", "fla": "FL", "fla.": "FL", "mich": "MI", "mich.": "MI",
}
# Names of countries and their codes.
COUNTRIES = {
    "united states": "US", "usa": "US", "u.s.a.": "US", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "canada": "CA", "australia": "AU", "germany": "DE",
    "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "switzerland": "CH", "austria": "AT",
    "belgium": "BE", "ireland": "IE", "new zealand": "NZ", "singapore": "SG", "japan": "JP", "india": "IN", "brazil": "BR", "mexico": "MX", "israel": "IL", "south africa": "ZA",
    "uae": "AE", "united arab emirates": "AE",
}
#: Date formats that are tried in turn, before relative phrases.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d")


def entries(table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def clean_whitespace(c: Column) -> Column:
    return V.trim(F.regexp_replace(c.cast("string"), rf"{V.SPACE}+", " "))


def normalize_case(c: Column, style: str = "lower") -> Column:
    """lower, upper, title (a capital at the start and behind white space, - and /) or sentence."""
    if style == "upper":
        return F.upper(c)
    if style == "title":
        low = F.lower(c)
        before = F.concat(F.lit(" "), low)
        letters = F.transform(F.filter(F.split(low, ""), lambda x: x != ""), lambda x, i: F.when(F.substring(before, i + 1, F.lit(1)).rlike(r"[\s\-/]"), F.upper(x)).otherwise(x))
        return F.when(low == "", low).otherwise(F.array_join(letters, ""))
    if style == "sentence":
        return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))
    return F.lower(c)


def parse_number(c: Column) -> Column:
    """Money and counts: currency signs, K/M/B/T, commas; a leading - or ( is negative."""
    t = F.regexp_replace(c.cast("string"), r"[$€£¥\s]", "")
    last = F.upper(F.right(t, F.lit(1)))
    times = F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).when(last == "T", 1e12).otherwise(1.0)
    body = F.regexp_replace(F.when(last.isin("K", "M", "B", "T"), F.left(t, F.length(t) - 1)).otherwise(t), ",", "")
    value = V.leading_number(F.regexp_replace(body, r"[()\-]", "")) * times
    return F.when(body.rlike(r"^[-(]"), -value).otherwise(value)


def numeric_parse(c: Column) -> Column:
    """Whole number as text: middle of a range, K/M/B suffix, or plain; else null."""
    t = F.regexp_replace(c, r"[$,\s]", "")
    n, span, suffixed = r"(\d+(?:\.\d+)?)", r"^(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)$", r"^(\d+(?:\.\d+)?)([kmbKMB])$"
    unit = F.lower(F.regexp_extract(t, suffixed, 2))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1e9)
    value = (
        F.when(t.rlike(span), (F.regexp_extract(t, span, 1).cast("double") + F.regexp_extract(t, span, 2).cast("double")) / 2)
        .when(t.rlike(suffixed), F.regexp_extract(t, suffixed, 1).cast("double") * times)
        .when(t.rlike(f"^{n}$"), F.regexp_extract(t, f"^{n}$", 1).cast("double"))
    )
    return F.floor(value + 0.5).cast("string")


def extract_domain(c: Column) -> Column:
    """Host of a URL or bare domain, in lower case, without one leading "www."."""
    def of(t: Column) -> Column:
        return F.when(t != "", V.let(F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t)), host))

    def host(url: Column) -> Column:
        loose = V.let(F.regexp_extract(url, r"(?i)(?:https?://)?(?:www\.)?([^/\s]+)", 1), lambda x: F.when(x != "", x))
        return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), loose)), r"^www\.", "")

    return V.let(V.trim(c.cast("string")), of)


def domain_format(c: Column) -> Column:
    """Like extract_domain, but text that is no URL is returned in lower case."""
    t = V.text(c)
    host = F.try_parse_url(F.when(t.startswith("http"), t).otherwise(F.concat(F.lit("https://"), t)), F.lit("HOST"))
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lower(V.trim(F.regexp_replace(t, r"^www\.", ""))))


def url_canonical(c: Column) -> Column:
    """The URL with a scheme and a lower-case host; a path of / where there is none; else null."""
    t = V.text(c)
    url = F.when(t.startswith("http"), t).otherwise(F.concat(F.lit("https://"), t))
    part = lambda name: F.try_parse_url(url, F.lit(name))
    rest = F.regexp_replace(url, r"^[A-Za-z]+://[^/?#]+", "")
    return F.when(part("HOST").isNotNull(), F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(part("AUTHORITY")), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def linkedin_url(c: Column) -> Column:
    slug = F.regexp_extract(c, r"(?i)linkedin\.com/(?:in|company)/([^/?]+)", 1)
    return F.when(slug != "", F.concat(F.when(c.contains("/company/"), F.lit("https://www.linkedin.com/company/")).otherwise(F.lit("https://www.linkedin.com/in/")), slug))


def linkedin_id(c: Column) -> Column:
    """Slug of a profile in lower case, for comparison."""
    slug = F.lower(F.regexp_extract(c, r"(?i)linkedin\.com/(?:in|company)/([^/?]+)", 1))
    return F.when(slug != "", slug)


def email_lowercase(c: Column) -> Column:
    return V.trim(F.lower(V.text(c)))


def match_pattern(c: Column, pattern: str, groups: int) -> Column:
    """matched, groups and fullMatch of the first match of a pattern."""
    hit = F.coalesce(c.rlike(pattern), F.lit(False))
    found = F.array(*(F.regexp_extract(c, pattern, k) for k in range(1, groups + 1))).cast("array<string>")
    return F.struct(hit.alias("matched"), F.when(hit, found).otherwise(F.array().cast("array<string>")).alias("groups"), F.when(hit, F.regexp_extract(c, pattern, 0)).alias("fullMatch"))


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor blank, as it is."""
    return F.coalesce(*(V.filled(c) for c in cs))


# Names of units and days, numbers in words.
UNITS = {"second": "sec(?:ond)?s?", "minute": "min(?:ute)?s?", "hour": "h(?:ou)?rs?", "day": "days?", "week": "weeks?", "month": "months?", "year": "ye?a?rs?"}
DAYS = ("sun(?:day)?", "mon(?:day)?", "tue(?:s|sday)?", "wed(?:nesday)?", "thu(?:r|rs|rsday)?", "fri(?:day)?", "sat(?:urday)?")
COUNTS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}


def _moved(now: Column, n: Column, unit: Column) -> Column:
    """An instant n units later; months and years keep the day where the month has it."""
    count = lambda *names: F.when(unit.isin(*names), n).otherwise(0)
    return now + F.make_interval(count("year"), count("month"), count("week"), count("day"), count("hour"), count("minute"), count("second"))


def relative_date(c: Column, now: Column) -> Column:
    """The instant that an English phrase means at a given present; null for anything else.

    now, today, tomorrow, yesterday; "3 days ago", "in two weeks", "a month from now"; last, past, next, this with a unit
    ("this" with a week, month or year is its first day); a weekday, alone the nearest one, or with last, next or this, at noon.  All but weekdays keep the time of day.
    """
    phrase = F.regexp_replace(F.lower(V.trim(c.cast("string"))), r"[\s,]+", " ")
    return V.let(F.struct(phrase.alias("t"), now.cast("timestamp").alias("now")), lambda x: _meant(x["t"], x["now"]))  # each is computed once, however often it is looked at


def _meant(t: Column, now: Column) -> Column:
    units = "|".join(UNITS.values())
    number = "(" + "|".join([r"\d{1,4}", *sorted(COUNTS, key=len, reverse=True)]) + ")"

    def unit(found: Column) -> Column:
        out = None
        for name, p in UNITS.items():
            out = F.when(found.rlike(f"^(?:{p})$"), name) if out is None else out.when(found.rlike(f"^(?:{p})$"), name)
        return out

    def counted(pattern: str, sign: int) -> Column:
        word = F.regexp_extract(t, pattern, 1)
        n = F.coalesce(entries({k: str(v) for k, v in COUNTS.items()})[word], word).try_cast("int") * sign
        return F.when(t.rlike(pattern), _moved(now, n, unit(F.regexp_extract(t, pattern, 2))))

    step = rf"^(last|past|previous|next|this) ({units})$"
    sign = F.when(F.regexp_extract(t, step, 1) == "next", 1).when(F.regexp_extract(t, step, 1) == "this", 0).otherwise(-1)
    kind = unit(F.regexp_extract(t, step, 2))
    first = F.when(kind == "week", F.date_sub(F.to_date(now), F.dayofweek(now) - 1)).when(kind == "month", F.trunc(now, "month")).when(kind == "year", F.trunc(now, "year"))
    time = now - F.date_trunc("day", now)
    stepped = F.when(t.rlike(step), F.when((sign == 0) & first.isNotNull(), first.cast("timestamp") + time).otherwise(_moved(now, sign, kind)))

    named = rf"^(?:(last|past|next|this|on) )?({'|'.join(DAYS)})$"
    which = F.regexp_extract(t, named, 2)
    wanted = None
    for k, p in enumerate(DAYS):
        wanted = F.when(which.rlike(f"^(?:{p})$"), k) if wanted is None else wanted.when(which.rlike(f"^(?:{p})$"), k)
    today, how = F.dayofweek(now) - 1, F.regexp_extract(t, named, 1)
    ahead = F.pmod(wanted - today, F.lit(7))
    back = F.pmod(today - wanted, F.lit(7))
    closest = F.when(ahead <= back, ahead).otherwise(-back)
    next_ = F.when(today == 0, F.when(wanted == 0, 7).otherwise(wanted)).when(today == 6, F.when(wanted == 6, 7).when(wanted == 0, 8).otherwise(wanted + 1)).when((wanted < today) & (wanted != 0), ahead).otherwise(ahead + 7)
    days = F.when(how == "this", ahead).when(how.isin("last", "past"), F.when(back == 0, -7).otherwise(-back)).when(how == "next", next_).otherwise(closest)
    weekday = F.when(t.rlike(named), F.date_add(F.to_date(now), days).cast("timestamp") + F.expr("INTERVAL 12 HOURS"))

    plain = F.when(t.isin("now", "today"), now).when(t == "tomorrow", now + F.expr("INTERVAL 1 DAY")).when(t == "yesterday", now - F.expr("INTERVAL 1 DAY"))
    ago = counted(rf"^{number} ({units}) (?:ago|before|earlier)$", -1)
    later = F.coalesce(counted(rf"^in {number} ({units})$", 1), counted(rf"^{number} ({units}) (?:from now|later|hence)$", 1))
    return F.coalesce(plain, ago, later, stepped, weekday)


def parse_date(c: Column, style: str = "iso", now: Column | None = None) -> Column:
    """iso, date, timestamp (milliseconds) or components of an English date; phrases such as "3 days ago" are told from ``now``, by default the present."""
    t = F.coalesce(*(F.try_to_timestamp(V.trim(c), F.lit(f)) for f in DATE_FORMATS), relative_date(c, F.current_timestamp() if now is None else now))
    if style == "date":
        return F.date_format(t, "yyyy-MM-dd")
    if style == "timestamp":
        return F.unix_millis(t)
    if style == "components":
        return F.when(t.isNotNull(), F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day")))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def employee_range(c: Column) -> Column:
    n = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    out = F.when(n.isNull(), c).when(n <= 1, "1")
    for low, high in ((2, 10), (11, 50), (51, 200), (201, 500), (501, 1000), (1001, 5000), (5001, 10000)):
        out = out.when(n <= high, f"{low}-{high}")
    return out.otherwise("10001+")


def state_abbreviate(c: Column) -> Column:
    t = V.trim(V.text(c))
    return F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)).otherwise(F.coalesce(entries(STATES)[F.lower(t)], c))


def country_code(c: Column) -> Column:
    t = V.trim(V.text(c))
    return F.coalesce(entries(COUNTRIES)[F.lower(t)], F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)).otherwise(t))


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
