"""Double metaphone against published codes."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions.sounds import codes, double_metaphone
from tidewater.operators import lookup

# Words with their first and second code.
PUBLISHED = """
smith SM0 XMT | schmidt XMT SMT | thomas TMS TMS | thumb 0M TM | jose HS HS | knight NT NT | xavier SF SFR | catherine K0RN KTRN | richard RXRT RKRT | michael MKL MXL | czerny SRN XRN | wright RT RT | bajador PJTR PHTR
cabrillo KPRL KPR | gallegos KLKS KKS | edgar ATKR ATKR | edge AJ AJ | laugh LF LF | cough KF KF | hugh H H | broughton PRTN PRTN | caesar SSR SSR | chianti KNT KNT | island ALNT ALNT | wasserman ASRM FSRM | zhao J J | dumb TM TM
arnow ARN ARNF | filipowicz FLPT FLPF | breaux PR PR | pizza PS PTS | succeed SKST SKST | focaccia FKX FKX | mcclelland MKLL MKLL | bacher PKR PKR | macher MKR MKR | architect ARKT ARKT | chorus KRS KRS | chemistry KMST KMST
orchestra ARKS ARKS | mchugh MK MK | accident AKST AKST | bertucci PRTX PRTX | tagliaro TKLR TLR | ghislane JLN JLN | danger TNJR TNKR | biaggi PJ PK | resnais RSN RSNS | artois ART ARTS | sugar XKR SKR | snider SNTR XNTR
school SKL SKL | schooner SKNR SKNR | schermerhorn XRMR SKRM | rogier RJ RJR | hochmeier HKMR HKMR | manager MNKR MNJR | campbell KMPL KMPL | raspberry RSPR RSPR | vasquez FSKS FSKS | phone FN FN | jankelowicz JNKL ANKL
"""
CASES = [c.split() for line in PUBLISHED.strip().splitlines() for c in line.split("|")]


@pytest.mark.parametrize("word,first,second", CASES)
def test_published_codes(word, first, second):
    assert codes(word) == (first, second) == codes(word.upper())


def test_column(spark):
    rows = spark.createDataFrame([(w,) for w, _, _ in CASES] * 3 + [(None,), ("",), ("12 #",), ("Çağ",), ("x" * 50_000,)], "w string").repartition(3)
    got = {r["w"]: (r["s"]["first"], r["s"]["second"]) for r in rows.select("w", double_metaphone(F.col("w")).alias("s")).collect()}
    assert all(got[w] == (a, b) for w, a, b in CASES)
    assert got[None] == (None, None) and got[""] == got["12 #"] == ("", "") and got["Çağ"][0] == "S" and got["x" * 50_000][0] == "SKSK"


def test_sound_tier_is_the_last_and_takes_eligible_rows(spark):
    ref = [("Filips", "exact", None, True, True), ("Phillips", "common", None, True, True), ("Phillips", "own", "o", True, True), ("Knight", "closed", None, True, False), ("Nait", "inactive", None, False, True), ("12", "digits", None, True, True)]
    reference = spark.createDataFrame(ref, "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    values = spark.createDataFrame([("filips ",), ("Filipps",), ("Nite",), ("34",), (None,), ("Filipps",)], "v string")
    got = {r["value"]: (r["canonical"], r["match_type"], r["confidence"]) for r in lookup.lookup(values, reference, org="o", sounds=True).collect()}
    assert got == {"filips ": ("exact", "exact", 100), "Filipps": ("own", "phonetic", 65), "Nite": (None, "none", 0), "34": (None, "none", 0)}
    assert {r["match_type"] for r in lookup.lookup(values, reference, org="o").collect()} == {"exact", "none"}
