"""Phone numbers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import values as V

STYLES = ("e164_compact", "e164_dashes", "e164_spaces", "e164_international", "e164_formatted", "e164_grouped", "national")
# Numbering plans by country code: lengths of national numbers, the trunk prefix that is dialled at home only, and usual groups (what is left over stands last).
PLANS = {
    "1": ((10,), "1", (3, 3)), "7": ((10,), "8", (3, 3, 2)), "20": ((8, 9, 10), "0", (2, 4)), "27": ((9,), "0", (2, 3)), "30": ((10,), "", (3, 3)), "31": ((9,), "0", (2, 3)), "32": ((8, 9), "0", (3, 2, 2)), "33": ((9,), "0", (1, 2, 2, 2)),
    "34": ((9,), "", (3, 2, 2)), "36": ((8, 9), "06", (2, 3)), "39": ((6, 7, 8, 9, 10, 11), "", (3, 3)), "40": ((9,), "0", (3, 3)), "41": ((9,), "0", (2, 3, 2)), "43": ((7, 8, 9, 10, 11, 12, 13), "0", (3, 3)), "44": ((9, 10), "0", (2, 4)),
    "45": ((8,), "", (2, 2, 2)), "46": ((7, 8, 9, 10), "0", (2, 3, 2)), "47": ((8,), "", (3, 2)), "48": ((9,), "", (3, 3)), "49": ((6, 7, 8, 9, 10, 11, 12, 13), "0", (3, 3)), "51": ((8, 9), "0", (3, 3)), "52": ((10,), "", (2, 4)), "54": ((10, 11), "0", (2, 4)),
    "55": ((10, 11), "0", (2, 5)), "56": ((9,), "", (1, 4)), "57": ((10,), "", (3, 3)), "60": ((8, 9, 10), "0", (2, 3)), "61": ((9,), "0", (1, 4)), "62": ((8, 9, 10, 11, 12), "0", (3, 4)), "63": ((10,), "0", (3, 3)), "64": ((8, 9, 10), "0", (1, 3)),
    "65": ((8,), "", (4,)), "66": ((8, 9), "0", (2, 3)), "81": ((9, 10), "0", (2, 4)), "82": ((8, 9, 10), "0", (2, 4)), "84": ((9, 10), "0", (2, 3)), "86": ((10, 11), "0", (3, 4)), "90": ((10,), "0", (3, 3, 2)), "91": ((10,), "0", (5,)), "92": ((10,), "0", (3,)),
    "212": ((9,), "0", (3, 2, 2)), "234": ((8, 10), "0", (3, 3)), "254": ((9,), "0", (3, 3)), "351": ((9,), "", (3, 3)), "353": ((7, 8, 9), "0", (2, 3)), "354": ((7,), "", (3,)), "358": ((5, 6, 7, 8, 9, 10, 11, 12), "0", (2, 3)), "359": ((8, 9), "0", (2, 3)),
    "370": ((8,), "0", (3, 2)), "371": ((8,), "", (2, 3)), "372": ((7, 8), "", (4,)), "380": ((9,), "0", (2, 3, 2)), "385": ((8, 9), "0", (2, 3)), "386": ((8,), "0", (2, 3)), "420": ((9,), "", (3, 3)), "421": ((9,), "0", (3, 3)), "852": ((8,), "", (4,)),
    "886": ((8, 9), "0", (3, 3)), "966": ((9,), "0", (2, 3)), "971": ((8, 9), "0", (2, 3)), "972": ((8, 9), "0", (2, 3)),
}
#: Letters of a keypad, and their digits.
KEYS, KEY_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999"


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def _cut(c: Column, *lengths: int, by: str = " ") -> Column:
    parts, at = [], 1
    for n in lengths:
        parts.append(F.substring(c, at, n))
        at += n
    return F.concat_ws(by, *parts, F.substr(c, F.lit(at)))


def format_phone(c: Column, region: str = "US") -> Column:
    """US and UK layouts; any other region: + and the digits, from seven on."""
    d = digits(c)
    if region.upper() == "US":
        n = F.when((F.length(d) == 11) & d.startswith("1"), F.substr(d, F.lit(2))).otherwise(d)
        full = F.concat(F.lit("+1 ("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 3), F.lit("-"), F.substr(n, F.lit(7)))
        return F.when(d != "", F.when(F.length(n) == 10, full).otherwise(F.concat(F.lit("+1 "), d)))
    if region.upper() == "UK":
        n = F.regexp_replace(F.regexp_replace(d, "^44", ""), "^0", "")
        own = F.when(F.length(n) == 10, _cut(n, 2, 4)).when(F.length(n) == 9, _cut(n, 2, 3)).otherwise(d)
        return F.when(d != "", F.concat(F.lit("+44 "), own))
    return F.when(F.length(d) >= 7, F.concat(F.lit("+"), d))


def grouped(country: Column, n: Column) -> Column:
    """National part in groups: UK 2-4-4, Australia 1-4-4, else threes from the right and up to four in front."""
    lead = F.length(n) % 3
    first = F.when(F.length(n) <= 4, F.length(n)).when(lead == 1, F.lit(4)).when(lead == 0, F.lit(3)).otherwise(lead)
    rest = F.substr(n, first + 1)
    spaced = F.rtrim(F.concat_ws(" ", F.left(n, first), F.rtrim(F.regexp_replace(rest, r"(\d{3})", "$1 "))))
    return F.when((country == "44") & (F.length(n) == 10), _cut(n, 2, 4)).when((country == "61") & (F.length(n) == 9), _cut(n, 1, 4)).otherwise(spaced)


def _table(of) -> Column:
    return F.create_map(*(x for code, plan in PLANS.items() for x in (F.lit(code), of(plan))))


def planned(d: Column) -> Column:
    """Struct (code, n) of international digits by the country code that they begin with, no two of which begin alike; the
    trunk prefix goes where the rest has a length of the plan.  Null where no plan fits."""
    lengths, trunks = _table(lambda p: F.array(*map(F.lit, p[0]))), _table(lambda p: F.lit(p[1]))
    fits = lambda code, n: F.array_contains(lengths[code], F.length(n))

    def told(code: Column) -> Column:
        def cut(x: Column) -> Column:
            bare = F.substr(x["n"], F.length(x["trunk"]) + 1)
            dialled = (x["trunk"] != "") & x["n"].startswith(x["trunk"]) & fits(code, bare)
            n = F.when(dialled, bare).when(fits(code, x["n"]), x["n"])
            return F.when(n.isNotNull() & ((code != "1") | n.rlike(r"^[2-9]\d\d[2-9]")), F.struct(code.alias("code"), n.alias("n")))

        return F.when(code.isNotNull(), V.let(F.struct(F.substr(d, F.length(code) + 1).alias("n"), trunks[code].alias("trunk")), cut))

    codes = _table(lambda p: F.lit(True))
    return V.let(F.coalesce(*(F.when(F.map_contains_key(codes, F.left(d, F.lit(k))), F.left(d, F.lit(k))) for k in (1, 2, 3))), told)


def _plan_groups(code: Column, n: Column) -> Column:
    """National number in the groups of its plan; plans with the same groups are one case."""
    out = None
    for lengths in sorted({p[2] for p in PLANS.values()}):
        when, cut = code.isin([c for c, p in PLANS.items() if p[2] == lengths]), _cut(n, *lengths)
        out = F.when(when, cut) if out is None else out.when(when, cut)
    return out.otherwise(n)


def e164(c: Column, style: str = "e164_compact", country: str = "1", strip_extensions: bool = True) -> Column:
    """E.164 number in one of seven styles; too short or too long: null.

    ``e164_formatted`` and ``e164_grouped`` go by the numbering plans where one fits the number's digits, as dialled from
    abroad, and have the national number in one piece or in the plan's groups; where none fits, and for the other styles, a country code is told by its first digits.
    """
    if style not in STYLES:
        raise ValueError(style)
    t = V.text(c)
    if strip_extensions:
        t = F.regexp_replace(t, r"(?i)\s*(x|ext\.?|extension|#)\s*\d+$", "")

    def parsed(t: Column) -> Column:
        """Digits, country code and national number; each step is computed once."""
        t = V.trim(F.translate(F.when(t.rlike("[A-Za-z]"), F.upper(t)).otherwise(t), KEYS, KEY_DIGITS))
        return V.let(F.when(t.rlike("^1[ -]"), F.concat(F.lit("+"), t)).otherwise(t), lambda t: V.let(F.struct(digits(t).alias("d"), t.startswith("+").alias("plus")), told))

    def told(x: Column) -> Column:
        d = x["d"]
        plus = x["plus"] & (F.length(d) <= 15)
        known = F.when((F.length(d) == 11) & d.startswith("1"), "1").when(d.rlike("^(44|61|33|49)"), F.left(d, F.lit(2))).when((F.length(d) >= 8) & ~d.startswith("0"), F.left(d, F.lit(1)))
        code = F.when(plus, F.coalesce(known, F.lit(country))).otherwise(F.lit(country))
        cut = F.when(plus, F.coalesce(F.length(known), F.lit(0))).when((F.length(d) == 11) & d.startswith(country[0]), 1).otherwise(0)
        return V.let(F.struct(F.length(d).alias("size"), code.alias("code"), F.substr(d, cut + 1).alias("n"), d.alias("d")), written)

    def written(x: Column) -> Column:
        code, n = x["code"], x["n"]
        us = (code == "1") & (F.length(n) == 10)
        area, mid, end = F.substring(n, 1, 3), F.substring(n, 4, 3), F.substr(n, F.lit(7))
        brackets = F.concat(F.lit("("), area, F.lit(") "), mid, F.lit("-"), end)
        lead = F.concat(F.lit("+"), code)
        if style == "national":
            return F.when(x["size"] >= 7, F.when(F.length(n) == 10, brackets).otherwise(n))
        if style == "e164_compact":
            out = F.concat(lead, n)
        elif style in ("e164_international", "e164_formatted", "e164_grouped"):
            out = F.concat(lead, F.lit(" "), F.when(us, brackets).otherwise(n))
            if style != "e164_international":
                own = lambda p: F.when(p["code"] == "1", F.concat(F.lit("+1 ("), F.left(p["n"], F.lit(3)), F.lit(") "), F.substring(p["n"], 4, 3), F.lit("-"), F.substr(p["n"], F.lit(7)))).otherwise(F.concat(F.lit("+"), p["code"], F.lit(" "), p["n"] if style == "e164_formatted" else _plan_groups(p["code"], p["n"])))
                out = F.coalesce(V.let(planned(x["d"]), lambda p: F.when(p.isNotNull(), own(p))), out)
        else:
            by = "-" if style == "e164_dashes" else " "
            out = F.concat(lead, F.lit(" "), F.when(us, F.concat_ws(by, area, mid, end)).otherwise(F.replace(grouped(code, n), F.lit(" "), F.lit(by))))
        return F.when((x["size"] >= 7) & (F.length(code) + F.length(n) <= 15), out)

    return V.let(t, parsed)


def is_e164(c: Column) -> Column:
    """Whether a number is in compact international form already; null is not."""
    return F.coalesce(F.trim(c).rlike(r"^\+[1-9][0-9]{6,14}$"), F.lit(False))
