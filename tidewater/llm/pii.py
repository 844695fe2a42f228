"""Personal data by weak supervision: regex, gazetteer and context labelers, aggregated by EM.

Only built-in DataFrame expressions touch the texts.  Spans come from a
pattern's matches and the pieces between them.  Four labelers vote on each
candidate: a strict form of the kind with its checksum, a gazetteer, the words
before it, and the characters around it; what is gathered is the number of candidates for each pattern of
votes, some hundred rows whatever the size of the corpus.  On these counts
expectation-maximisation estimates how reliable each labeler is, and a
logistic classifier of spans is fitted to the posteriors.  Its weights return
to Spark as literals of one expression.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spare
from .quality import let

#: Kinds in the order of the contract, then those that the method alone adds.
KINDS = ("email", "ip", "card", "phone", "email_at", "account", "phone_local", "iban")
BASE = 4

# The patterns of the base kinds.  Guards such as (?:\G|(?<![0-9])) and possessive
# quantifiers leave the matches as they are; they keep a long run of characters from being tried
# at each of its places, and Java from recursing.  A card pattern of 12 to 19 digits that no digit
# continues is the base pattern with the digits counted.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<!{LOCAL}){LOCAL}{{1,64}}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z]{{2,24}}",
    r"(?<![0-9A-Za-z])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9A-Za-z])",
    r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,5}\)|00[1-9][0-9]{0,2}|0[1-9][0-9]{1,4})[\x20./-]?[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
)
#: Every match of a pattern holds one of these; a text with none of them needs no search.
NEEDS = (("@",), None, None, ("+",), ("[at", "[AT", "(at", "(AT"), None, ("(", "0"), None)
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# Gazetteers, fixed values: mail domains' ends, card issuers' first digits, country calling codes, bank countries.
ENDS = "com org net edu gov int info biz io co me de fr es uk at ch be nl it pt eu us ca au br mx ar".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|35|6)"
CALLING = r"^\+\D?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
BANKS = "AT BE CH CY CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
# Context, fixed values: words that speak for a kind, and words that speak for another number.
HINTS = (
    r"(?i)(?:e-?mail|mail|contact|kontakt|courriel|correo|write to)",
    r"(?i)(?:\bip\b|address|adresse|dirección|host|server|login|from)",
    r"(?i)(?:card|karte|carte|tarjeta|visa|credit|kredit|payment)",
    r"(?i)(?:phone|tel|call|fax|mobile|handy|mobil|téléphone|teléfono|appel)",
    r"(?i)(?:e-?mail|mail|contact|kontakt|courriel|correo)",
    r"(?i)(?:account|konto|compte|cuenta|card|karte|carte|tarjeta|customer|kunde)",
    r"(?i)(?:phone|tel|call|fax|mobile|handy|mobil|téléphone|teléfono|appel)",
    r"(?i)(?:iban|bank|account|konto|compte|cuenta)",
)
AGAINST = r"(?i)(?:version|isbn|invoice|rechnung|facture|factura|order|bestell|section|page|seite|serial|build|\bno\.)\W*$"

VOTERS = ("form", "gazetteer", "context", "border")


def found(text: Column, pattern: str, need: tuple[str, ...] | None) -> Column:
    """Matches in order: array of (s, e, m, pre, post), in code points, with up to 40 and 8 characters around."""
    kind = "array<struct<s:int,e:int,m:string,pre:string,post:string>>"
    none = F.from_json(F.lit("[]"), kind)

    def spans(matches: Column) -> Column:
        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: let(starts(matches, pieces), lambda at: F.transform(matches, lambda m, i: F.struct(
            F.get(at, i).alias("s"), (F.get(at, i) + F.length(m)).cast("int").alias("e"), m.alias("m"), F.right(F.get(pieces, i), F.lit(40)).alias("pre"), F.left(F.get(pieces, i + 1), F.lit(8)).alias("post"))))))

    searched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(reduce(or_, (F.instr(text, x) > 0 for x in need)), searched).otherwise(none) if need else searched


def starts(matches: Column, pieces: Column, block: int = 256) -> Column:
    """Start of each match: running sum of the lengths before it, in blocks, as appending copies the list."""
    steps = F.transform(matches, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("g"), F.length(m).alias("n")))
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda k: F.slice(x, k * block + 1, F.lit(block)))
    empty = F.from_json(F.lit("[]"), "array<int>")

    def inner(state: Column, x: Column) -> Column:
        at = (state["pos"] + x["g"]).cast("int")
        return F.struct((at + x["n"]).cast("int").alias("pos"), F.concat(state["out"], F.array(at)).alias("out"))

    def outer(state: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(state["pos"].alias("pos"), empty.alias("out")), inner)
        return let(done, lambda d: F.struct(d["pos"].alias("pos"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    first = F.struct(F.lit(0).alias("pos"), F.from_json(F.lit("[]"), "array<array<int>>").alias("out"))
    return F.flatten(let(steps, lambda x: F.aggregate(blocks(x), first, outer))["out"])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    each = F.filter(F.split(F.reverse(digits(m)), "", -1), lambda d: d != "")
    value = lambda d, i: let(d.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: int, m: Column) -> Column:
    """The base rule that a match of a base pattern must pass."""
    n = F.length(digits(m))
    return (F.lit(True), m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), n.between(12, 19) & luhn(m), n.between(9, 15))[kind]


def gazetteer(kind: int, m: Column) -> Column:
    end = F.lower(F.substring_index(m, ".", -1))
    known = (
        end.isin(ENDS), ~m.rlike(r"^(?:0|22[4-9]|23|24|25[0-5])\."), digits(m).rlike(ISSUERS), m.rlike(CALLING),
        end.isin(ENDS), digits(m).rlike(ISSUERS), ~digits(m).rlike(r"^(?:0{3}|(.)\1+$)"), F.left(m, F.lit(2)).isin(BANKS),
    )[kind]
    return F.when(known, 1).otherwise(-1)


def mod97(m: Column) -> Column:
    """Whether a bank account number passes its check: its first four characters moved to the end, letters as 10 to 35, is 1 mod 97."""
    turned = let(F.regexp_replace(m, " ", ""), lambda x: F.concat(F.substring(x, 5, 64), F.left(x, F.lit(4))))
    places = F.transform(F.filter(F.split(turned, "", -1), lambda c: c != ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(places, F.lit(0), lambda a, x: ((a * F.when(x > 9, 100).otherwise(10) + x) % 97).cast("int")) == 1


def form(kind: int, m: Column) -> Column:
    """Whether a match has the strict form of its kind, which its pattern does not ask for, and passes the kind's checksum."""
    n = F.length(digits(m))
    strict = (
        m.rlike(r"\.[A-Za-z]{2,24}$") & ~m.rlike(r"^[._%+-]|\.\.|\.@|@-|-\.|\.-"),
        ~m.rlike(r"(?:^|\.)0[0-9]"),
        m.rlike(r"^(?:[0-9]{12,19}|[0-9]{4}([\x20-])[0-9]{4}(?:\1[0-9]{4})+(?:\1[0-9]{1,3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$"),
        m.rlike(r"^\+[1-9][0-9]{0,3}[\x20.-]?(?:\([0-9]{1,5}\)|[0-9]+)(?:[\x20.-]?[0-9]{2,})*$"),
        m.rlike(r"\[(?:at|AT)\]|\((?:at|AT)\)") & m.rlike(r"(?:\[(?:dot|DOT)\]|\((?:dot|DOT)\))"),
        luhn(m),
        n.between(7, 13) & m.rlike(r"^(?:\([0-9]+\)|[0-9]+)([\x20./-]?)[0-9]+(?:\1[0-9]+|\x20[0-9]+|-[0-9]+)*$"),
        mod97(m),
    )[kind]
    return F.when(strict, 1).otherwise(-1)


def votes_of(t: Column, kind: int) -> Column:
    """The candidates of one kind with their votes."""
    spans = found(t, PATTERNS[kind], NEEDS[kind])
    if kind < BASE:
        spans = F.filter(spans, lambda x: valid(kind, x["m"]))
    return F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), F.lit(kind < BASE).alias("base"),
        form(kind, x["m"]).alias("form"), gazetteer(kind, x["m"]).alias("gazetteer"),
        F.when(x["pre"].rlike(AGAINST), -1).when(x["pre"].rlike(HINTS[kind]), 1).otherwise(0).alias("context"),
        F.when(x["pre"].rlike(r"[\p{L}\p{N}_]$") | x["post"].rlike(r"^[\p{L}\p{N}_]"), -1).otherwise(1).alias("border"),
        F.least(F.floor((x["e"] - x["s"]) / 8), F.lit(3)).cast("int").alias("size")))


def candidates(text: Column) -> Column:
    """All candidates of a text: base spans, then looser ones that overlap none of them."""
    t = F.coalesce(text, F.lit(""))
    lists = [votes_of(t, kind) for kind in range(len(KINDS))]
    base, loose = F.concat(*lists[:BASE]), F.concat(*lists[BASE:])
    return let(base, lambda b: F.concat(b, F.filter(loose, lambda x: ~F.exists(b, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))))


def estimate(counts: list[tuple[int, tuple[int, ...], float]], rounds: int = 30) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior that a candidate is personal data, by (kind, votes).

    counts: (kind, votes, number), votes 1, -1 or 0.  A two-class model with a
    prior for each kind and, for each labeler and class, the chance of each
    vote; EM from labelers that are right four times in five.
    """
    kinds = sorted({k for k, _, _ in counts})
    prior = {k: 0.9 if k < BASE else 0.5 for k in kinds}
    voters = len(VOTERS)
    rate = [[{1: 0.6, 0: 0.25, -1: 0.15}, {1: 0.15, 0: 0.25, -1: 0.6}] for _ in range(voters)]
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for k, votes, _ in counts:
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for v, vote in enumerate(votes):
                yes += math.log(rate[v][0][vote])
                no += math.log(rate[v][1][vote])
            post[k, votes] = 1 / (1 + math.exp(min(50.0, no - yes)))
        for k in kinds:
            own = [(post[k, votes], n) for kk, votes, n in counts if kk == k]
            prior[k] = min(0.98, max(0.02, (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))))
        for v in range(voters):
            for c in (0, 1):
                total = {x: 1.0 for x in (1, 0, -1)}
                for k, votes, n in counts:
                    total[votes[v]] += n * (post[k, votes] if c == 0 else 1 - post[k, votes])
                whole = sum(total.values())
                rate[v][c] = {x: y / whole for x, y in total.items()}
        for v in range(voters):  # class 0 stays the one that labelers vote for
            if rate[v][0][1] + rate[v][1][-1] < rate[v][0][-1] + rate[v][1][1]:
                rate[v] = [dict(rate[v][1]), dict(rate[v][0])]
    return post


def features(kind: int, votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *map(float, votes), *(float(size == s) for s in range(4))]


def fit(cells: list[tuple[int, tuple[int, ...], int, float]], post: dict, steps: int = 300) -> list[float]:
    """Weights of a logistic classifier of spans, fitted to the posteriors of counted cells."""
    rows = [(features(k, votes, size), post[k, votes], n) for k, votes, size, n in cells]
    total = sum(n for *_, n in rows) or 1.0
    w = [0.0] * len(features(0, (0,) * len(VOTERS), 0))
    for _ in range(steps):
        grad = [0.01 * x for x in w]
        for x, p, n in rows:
            d = (1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(w, x)))))) - p) * n / total
            for i, v in enumerate(x):
                if v:
                    grad[i] += d * v
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def train(found_table: DataFrame) -> list[float]:
    """Count the votes of all candidates, in the column ``c``; estimate; fit.  Without candidates all weights are 0."""
    one = found_table.select(F.explode("c").alias("x")).select("x.*")
    cells = one.groupBy("k", *VOTERS, "size").agg(F.count("*").alias("n")).collect()  # at most kinds x 3^voters x 4 rows
    rows = sorted((r["k"], tuple(r[v] for v in VOTERS), r["size"], float(r["n"])) for r in cells)
    merged: dict[tuple[int, tuple[int, ...]], float] = {}
    for k, votes, _, n in rows:
        merged[k, votes] = merged.get((k, votes), 0.0) + n
    return fit(rows, estimate([(k, votes, n) for (k, votes), n in merged.items()]))


def accepted(c: Column, weights: list[float]) -> Column:
    """Base spans, and those others for which the classifier says yes, in order of start and kind."""
    at = 1 + len(KINDS)

    def yes(x: Column) -> Column:
        score = F.lit(weights[0]) + F.get(F.array(*map(F.lit, weights[1:at])), x["k"])
        for i, v in enumerate(VOTERS):
            score = score + F.lit(weights[at + i]) * x[v]
        return x["base"] | (score + F.get(F.array(*map(F.lit, weights[at + len(VOTERS) :])), x["size"]) > 0)

    return F.sort_array(F.transform(F.filter(c, yes), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all), and found, the spans as an array.

    A null or empty text has no spans: counts 0, the digest of the empty
    string, an empty list.  Rows alike have the same result.  Of an empty
    table nothing comes out.  Other columns are dropped.
    """
    table = Scratch(docs.sparkSession, "pii").write(docs.select(id, candidates(F.col(text)).alias("c")), "candidates")
    out = table.withColumn("found", accepted(F.col("c"), train(table)))
    base = F.filter("found", lambda x: x["base"])
    number = lambda kind: F.size(F.filter("found", lambda x: x["k"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")
    return out.select(id, *map(number, range(BASE)),
                      F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, text: str = "text", mask: str = "<{}>") -> DataFrame:
    """The rows with each accepted span replaced by the name of its kind; null stays null.  Overlapping spans make one mask.

    The candidates are stored with the rows, so each text is searched once.
    All columns stay as they are, whatever their names.
    """
    own, spans = spare("candidates", docs.columns), spare("spans", docs.columns)
    table = Scratch(docs.sparkSession, "pii").write(docs.withColumn(own, candidates(F.col(text))), "candidates")
    weights = train(table.select(F.col(own).alias("c")))
    names = F.array(*(F.lit(mask.format(k.upper())) for k in KINDS))
    pieces = F.from_json(F.lit("[]"), "array<string>")

    def step(state: Column, x: Column) -> Column:
        cut = F.concat(F.substring(F.col(text), state["pos"] + 1, F.greatest(x["s"] - state["pos"], F.lit(0))), F.when(x["s"] >= state["pos"], F.get(names, x["k"])).otherwise(F.lit("")))
        return F.struct(F.greatest(state["pos"], x["e"]).cast("int").alias("pos"), F.concat(state["out"], F.array(cut)).alias("out"))

    first = F.struct(F.lit(0).alias("pos"), pieces.alias("out"))
    out = table.withColumn(spans, accepted(F.col(own), weights))
    done = let(F.aggregate(F.col(spans), first, step), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(F.col(text), d["pos"] + 1, F.length(F.col(text)))))
    return out.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).select(docs.columns)
