"""Casing of names: company titles word by word, tokens of persons' names, and how sure the result is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater import values as V
from tidewater.functions.similarity import similarity

# Words that stay small inside a title.
CONJUNCTIONS = ("and", "or", "the", "of", "in", "for", "with", "at", "by", "to", "a", "an", "but", "nor", "so", "yet", "as")
# Legal forms and generic ends of company names, as written and in their standard form.
COMPANY_ENDS = {
    "incorporated": "Inc", "inc.": "Inc", "inc": "Inc", "corporation": "Corp", "corp.": "Corp", "corp": "Corp", "limited": "Ltd", "ltd.": "Ltd", "ltd": "Ltd",
    "llc": "LLC", "l.l.c": "LLC", "l.l.c.": "LLC", "plc": "PLC", "p.l.c": "PLC", "company": "Co", "co.": "Co", "co": "Co",
    "group": "Group", "holdings": "Holdings", "international": "International", "technologies": "Technologies", "technology": "Technology", "tech": "Tech",
    "solutions": "Solutions", "services": "Services", "systems": "Systems", "enterprises": "Enterprises", "industries": "Industries",
}
# Ends of persons' names in their standard form.
PERSON_ENDS = {
    "jr.": "Jr", "jr": "Jr", "sr.": "Sr", "sr": "Sr", "ii": "II", "iii": "III", "iv": "IV", "v": "V", "esq.": "Esq", "esq": "Esq",
    "phd": "PhD", "ph.d": "PhD", "ph.d.": "PhD", "md": "MD", "m.d": "MD", "m.d.": "MD",
}
# Particles before a surname.
PARTICLES = ("van", "von", "de", "di", "du", "da", "del", "della", "le", "la", "der")

TOKENS = r"\s+|[()/-]|[^\s()/-]+"


def capital(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def words_capital(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\s+"), capital), " ")


def smart_title_case(c: Column, exceptions: dict[str, str] | None = None, brands: dict[str, str] | None = None, conjunctions: tuple[str, ...] = CONJUNCTIONS) -> Column:
    """A company name in title case that keeps what looks meant.

    ``exceptions`` (lower case to form) replaces whole names, ``brands`` single
    words.  Small words stay small but in front and behind a hyphen.  Kept are:
    up to three capitals, dotted capitals, four or five capitals if the name
    has small letters too, words with digits, and brand casing such as eBay
    and FedEx.  Blanks become one.  Blank text stays as it is.
    """
    text = V.trim(c)
    mixed = text.rlike("[a-z]") & text.rlike("[A-Z]")

    def cased(tokens: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            low, behind = F.lower(x), F.coalesce(F.get(tokens, i - 1) == "-", F.lit(False))
            kept = x.rlike(r"^[A-Z]{1,3}$|^[A-Z](\.[A-Z])+\.?$|\d|^[A-Z]?[a-z]+[A-Z][a-z]+$") | (x.rlike("^[A-Z]{4,5}$") & mixed)
            out = F.when(x.rlike(r"^\s+$"), " ").when(x.rlike("^[()/&,.-]$"), x)
            if brands:
                known = F.create_map(*(F.lit(v) for pair in brands.items() for v in pair))
                out = out.when(known[low].isNotNull(), known[low])
            small = low.isin(*conjunctions)
            return out.when(small & ~((i == 0) | behind), low).when(kept & ~small, x).otherwise(capital(low))

        return F.array_join(F.transform(tokens, one), "")

    made = V.let(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), cased)
    if exceptions:
        known = F.create_map(*(F.lit(v) for pair in exceptions.items() for v in pair))
        made = F.coalesce(known[F.lower(text)], made)
    return F.when(text == "", c).otherwise(made)


def is_smart_title_case(c: Column) -> Column:
    return F.coalesce(smart_title_case(c) == c, F.lit(False))


def is_canonical_linkedin(c: Column) -> Column:
    """https://www.linkedin.com/company/ and a slug, without a slash at the end."""
    return F.coalesce(V.trim(c).rlike(r"^https://www\.linkedin\.com/company/[^/?]+$"), F.lit(False))


def _standard_end(c: Column, ends: dict[str, str], how: str) -> tuple[Column, Column]:
    """The text with its last word removed or in standard form if it is one of the ends, and that end (null: none)."""
    last = F.lower(F.regexp_extract(c, r"\s(\S+?),?\s*$", 1))
    known = F.create_map(*(F.lit(v) for pair in ends.items() for v in pair))
    body = F.regexp_replace(c, r"\s+\S+?,?\s*$", "")
    form = known[last]
    return F.when(form.isNotNull(), body if how == "remove" else F.concat(body, F.lit(" "), form)).otherwise(c), F.when(form.isNotNull(), last)


def confidence(original: Column, made: Column, steps: Column) -> Column:
    """How sure a normalized name is, from 0 to 1: less after a change of casing, many steps, or if little of the name is left."""
    has = lambda s: F.array_contains(steps, s)
    start = 1.0 - F.when(has("from_capitals"), 0.1).otherwise(0.0) - F.when(has("from_small_letters"), 0.05).otherwise(0.0)
    start = F.when((F.size(steps) <= 2) & has("blanks"), 0.95).otherwise(start)
    start = start - F.when(F.size(steps) > 5, 0.15).otherwise(0.0) - F.when(similarity(original, made) < 0.7, 0.2).otherwise(0.0)
    return F.least(F.greatest(V.round_half_up(start, 4), F.lit(0.0)), F.lit(1.0))


def _result(c: Column, made: Column, steps: Column, registered: Column | None, threshold: float) -> Column:
    """(output, confidence, source, queued, steps) of a name; a registered form beats the rules; blank text passes through."""
    sure = confidence(c, made, steps)
    none = F.array().cast("array<string>")
    row = lambda out, conf, source, queued, how: F.struct(out.alias("output"), conf.cast("double").alias("confidence"), F.lit(source).alias("source"), queued.alias("queued"), how.alias("steps"))
    ruled = row(made, sure, "rules", sure < threshold, steps)
    if registered is not None:
        ruled = F.when(registered.isNotNull(), row(registered, F.lit(1.0), "registry", F.lit(False), none)).otherwise(ruled)
    return F.when(V.is_blank(c), row(F.lit(""), F.lit(0.0), "passthrough", F.lit(False), none)).otherwise(ruled)


def _steps(*marks: tuple[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(when, F.lit(name)) for name, when in marks)), lambda x: x.isNotNull())


def company_name(c: Column, ends: str = "standardize", casing: str = "title", registered: Column | None = None, threshold: float = 0.85) -> Column:
    """A company's name by rules: single blanks, no shouting, its legal form kept, removed or standardized, and upper or lower case if asked.

    ``registered`` is the form that a registry has for the name (null: none).
    Steps are rules, blanks, from_capitals, end and casing.
    """
    recased = {"title": lambda x: x, "upper": F.upper, "lower": F.lower}[casing]

    def ruled(one: Column) -> Column:
        shouts = (one == F.upper(one)) & (F.length(one) > 3)

        def ended(quiet: Column) -> Column:
            body, end = _standard_end(quiet, COMPANY_ENDS, ends) if ends != "keep" else (quiet, F.lit(None).cast("string"))
            steps = _steps(("rules", F.lit(True)), ("blanks", F.lit(True)), ("from_capitals", shouts), ("end", end.isNotNull()), ("casing", F.lit(casing != "title")))
            return V.let(F.struct(recased(body).alias("made"), steps.alias("steps")), lambda x: _result(c, x["made"], x["steps"], registered, threshold))

        return V.let(F.when(shouts, words_capital(one)).otherwise(one), ended)

    return V.let(F.regexp_replace(V.trim(c), r"\s+", " "), ruled)


def surname(c: Column) -> Column:
    """Casing of surnames: McDonald, MacDonald, O'Brien, van der Berg, ibn Saud, al-Assad, el-Sisi, else capitals."""
    behind = lambda lead, n: F.concat(F.lit(lead), capital(F.substring(c, n, 1 << 30)))
    words, low, n = F.split(c, r"\s+"), F.lower(c), F.length(c)
    particle = F.array_join(F.transform(words, lambda w, i: F.when((i < F.size(words) - 1) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(capital(w))), " ")
    ibn = F.concat(F.lit("ibn "), F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), capital), " "))
    return (
        F.when(low.startswith("mc") & (n > 3), behind("Mc", 3)).when(low.startswith("mac") & (n > 4), behind("Mac", 4)).when(low.startswith("o'") & (n > 3), behind("O'", 3))
        .when(low.rlike(rf"^({'|'.join(PARTICLES[:-1])})\s"), particle).when(low.rlike(r"^ibn\s"), ibn)
        .when(low.rlike(r"^al[-\s]"), behind("al-", 4)).when(low.rlike(r"^el[-\s]"), behind("el-", 4)).otherwise(words_capital(c))
    )


def person_name(c: Column, last: bool, ends: str = "standardize", registered: Column | None = None, threshold: float = 0.85) -> Column:
    """A first or last name by rules, as company_name has it for companies.  Steps may be from_small_letters and prefix too."""

    def ruled(one: Column) -> Column:
        shouts, whispers = (one == F.upper(one)) & (F.length(one) > 2), one == F.lower(one)

        def ended(x: Column) -> Column:
            made, end = _standard_end(x["cased"], PERSON_ENDS, ends) if ends != "keep" else (x["cased"], F.lit(None).cast("string"))
            steps = _steps(("rules", F.lit(True)), ("blanks", F.lit(True)), ("from_capitals", shouts), ("from_small_letters", whispers & ~shouts), ("prefix", x["special"]), ("end", end.isNotNull()))
            return V.let(F.struct(made.alias("made"), steps.alias("steps")), lambda y: _result(c, y["made"], y["steps"], registered, threshold))

        def cased(quiet: Column) -> Column:
            special = F.lower(quiet).rlike(rf"^(mc..|mac..|o'..|al[-\s]|el[-\s]|ibn\s|({'|'.join(PARTICLES[:-1])})\s)") if last else F.lit(False)
            return V.let(F.struct((surname(quiet) if last else words_capital(quiet)).alias("cased"), special.alias("special")), ended)

        return V.let(F.when(shouts | whispers, words_capital(one)).otherwise(one), cased)

    return V.let(F.regexp_replace(V.trim(c), r"\s+", " "), ruled)
