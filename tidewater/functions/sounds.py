"""Double metaphone: how an English word sounds, and how it may sound.

Each letter has an ordered list of rules: a pattern that is matched at the
letter, with what stands before and behind it, the code of the first sound, and
that of the second where it differs.  What a pattern consumes is done with.
The first rule that fits is taken; a character without rules is passed over.
Words are coded once for each batch, in Arrow batches.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LENGTH = 4
VOWEL = "[AEIOUY]"
END = r"(?= *\Z)"
# The published rules by letter as (pattern, first code, second code, property that the word must have; ! must not).
RULES = {
    **{v: [(rf"\A{v}", "A"), (v, "")] for v in "AEIOUY"},
    "B": [("BB?", "P")],
    "Ç": [("Ç", "S")],
    "C": [
        (r"(?<=[^AEIOUY]A)CH(?![IE])|(?<=[BM]A)CH(?=ER)", "K"), (r"\ACA(?=ESAR)", "S"), ("CH(?=IA)", "K"), ("(?<=.)CH(?=AE)", "K", "X"), (r"\ACH(?=ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K"),
        ("CH", "K", None, "germanic"), (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[TS])|(?:(?<=[AOUE])|\A)CH(?=[LRNMBHFVW ])", "K"), ("(?<=.)CH", "K", None, "mc"), ("(?<=.)CH", "X", "K"), ("CH", "X"),
        ("(?<!WI)CZ", "S", "X"), ("CCI(?=A)", "X"), (r"(?<=\AA)CC(?!HU)[IEH]|(?<=U)CCE(?=[ES])", "KS"), (r"(?<!\AM)CC(?!HU)[IEH]", "X"), (r"(?<!\AM)CC", "K"), ("C[KGQ]", "K"), ("CI(?=[OEA])", "S", "X"), ("C[IEY]", "S"),
        ("C [CQG]", "K"), ("C(?!C[EI])[CKQ]", "K"), ("C", "K"),
    ],
    "D": [("DG[IEY]", "J"), ("DG", "TK"), ("D[TD]?", "T")],
    "F": [("FF?", "F")],
    "G": [
        ("(?<=[^AEIOUY])GH", "K"), (r"\AGH(?=I)", "J"), (r"\AGH", "K"), ("(?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH", ""), ("(?<=[CGLRT].U)GH", "F"), ("(?<=[^I])GH", "K"), ("GH", ""),
        (r"(?<=\A[AEIOUY])GN", "KN", "N", "!slavic"), ("GN(?!EY)", "N", "KN", "!slavic"), ("GN", "KN"), ("GL(?=I)", "KL", "L", "!slavic"),
        (r"\AGE(?=[SPBLYIR])|\AGI(?=[BLNE])|\AGY", "K", "J"), ("(?<![EI])GE(?=R)|(?<![EIRO])GY", "K", "J", "!danger"),
        ("G[EIY]|(?<=[AO])GG(?=I)", "K", None, "germanic"), ("GE(?=T)", "K"), ("GI(?=ER )", "J"), ("G[EIY]|(?<=[AO])GG(?=I)", "J", "K"), ("GG?", "K"),
    ],
    "H": [(rf"(?:\A|(?<={VOWEL}))H{VOWEL}", "H"), ("H", "")],
    "J": [
        ("J", "H", None, "san"), (r"\AJ(?=OSE )", "H"), ("J(?=OSE)", "J", "H"), (r"\AJJ?", "J", "A"), (rf"(?<={VOWEL})J(?=[AO])", "J", "H", "!slavic"), ("J" + END, "J", ""),
        ("(?<![SKL])J(?![LTKSNMBZ])J?", "J"), ("JJ?", ""),
    ],
    "K": [("KK?", "K")],
    "L": [(r"(?<=I)LL(?=[OA] *\Z)|(?<=A)LL(?=E *\Z)|(?<=A)LL(?=E.*[AO]S? *\Z)", "L", ""), ("LL?", "L")],
    "M": [(r"(?<=U)MB(?= *\Z|ER)", "M"), ("MM?", "M")],
    "N": [("NN?", "N")],
    "Ñ": [("Ñ", "N")],
    "P": [("PH", "F"), ("P[PB]?", "P")],
    "Q": [("QQ?", "K")],
    "R": [("(?<!MEIE)(?<!MAIE)(?<=IE)R" + END, "", "R", "!slavic"), ("RR?", "R")],
    "S": [
        ("(?<=[IY])S(?=L)", ""), (r"\AS(?=UGAR)", "X", "S"), ("SH(?=EIM|OEK|OLM|OLZ)", "S"), ("SH", "X"), ("SI[OA]", "S", "X", "!slavic"), ("SI[OA]", "S"), (r"\AS(?=[MNLW])|SZ", "S", "X"),
        ("SCH(?=E[RN])", "X", "SK"), ("SCH(?=OO|UY|E[DM])", "SK"), (r"\ASCH(?![AEIOUYW])", "X", "S"), ("SCH", "X"), ("SC[IEY]", "S"), ("SC.", "SK"), ("(?<=[AO]I)S" + END, "", "S"), ("S[SZ]?", "S"),
    ],
    "T": [("TIO(?=N)", "X"), ("TIA|TCH", "X"), ("TH(?=[OA]M)", "T"), ("TH|TT(?=H)", "T", None, "germanic"), ("TH|TT(?=H)", "0", "T"), ("T[TD]?", "T")],
    "V": [("VV?", "F")],
    "W": [
        ("WR", "R"), (r"\AWI[CT]Z", "ATS", "FFX"), (rf"\AW(?={VOWEL})", "A", "F"), (r"\AW(?=H)", "A"), (rf"(?<={VOWEL})W{END}|(?<=[EO])W(?=SK[IY])", "", "F"), ("W", "", "F", "sch"), ("WI[CT]Z", "TS", "FX"), ("W", ""),
    ],
    "X": [(r"\AX", "S"), (rf"(?<=[IE]AU)X{END}|(?<=[AO]U)X{END}", ""), ("X[CX]?", "KS")],
    "Z": [("ZH", "J"), ("ZZ(?=[OIA])", "S", "TS"), ("(?<=[^T])ZZ?", "S", "TS", "slavic"), ("ZZ?", "S")],
}
# First letters that are silent before the next.
SILENT = ("GN", "KN", "PN", "WR", "PS")

_COMPILED = {letter: [(re.compile(r[0]), r[1], r[1] if len(r) < 3 or r[2] is None else r[2], r[3] if len(r) > 3 else "") for r in rules] for letter, rules in RULES.items()}


def _properties(word: str) -> set[str]:
    found = {"slavic"} if re.search("[WK]|CZ|WITZ", word) else set()
    for name, starts in (("germanic", ("VAN ", "VON ", "SCH")), ("mc", ("MC",)), ("san", ("SAN ",)), ("sch", ("SCH",)), ("danger", ("DANGER", "RANGER", "MANGER"))):
        if word.startswith(starts):
            found.add(name)
    return found


@lru_cache(maxsize=100_000)
def codes(word: str) -> tuple[str, str]:
    """The two codes of a word or phrase, of up to four letters each; empty without a letter."""
    text = word.upper() + "     "
    has, at, first, second = _properties(text), 1 if text.startswith(SILENT) else 0, "", ""
    while at < len(text) and min(len(first), len(second)) < LENGTH:
        for pattern, one, other, needs in _COMPILED.get(text[at], ()):
            if needs and (needs[1:] in has if needs[0] == "!" else needs not in has):
                continue
            if m := pattern.match(text, at):
                first, second, at = first + one, second + other, m.end()
                break
        else:
            at += 1
    return first[:LENGTH], second[:LENGTH]


def _coded(words: pd.Series) -> pd.DataFrame:
    which, distinct = pd.factorize(words)
    found = [codes(w) for w in distinct]
    return pd.DataFrame({k: [found[i][n] if i >= 0 else None for i in which] for n, k in enumerate(("first", "second"))})


_CODED = F.pandas_udf(_coded, StructType([StructField("first", StringType()), StructField("second", StringType())]))


def double_metaphone(c: Column) -> Column:
    """Struct of first and second code; both null for a null."""
    return _CODED(c)
