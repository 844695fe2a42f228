import datetime as dt
import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.functions.similarity import jaro_winkler
from tidewater.operators import dedup, lookup, matching, resolve, sampling, scoring, survivorship
from tidewater.plans import rules
from tidewater.sources import tables
from tidewater.storage import Scratch
from tidewater.streaming import events

COMPANY = "id string, name string, domain string, phone string, industry string, linkedin string"


def pairs(spark, a, b):
    records = spark.createDataFrame([("a", *a), ("b", *b)], COMPANY)
    return dedup.with_records(spark.createDataFrame([("a", "b")], "a string, b string"), records)


@pytest.mark.parametrize("a,b,score,grade,signals", [
    (("X", "x.com", None, None, None), ("Other name", "x.com", None, None, None), 95, "A", ["domain"]),
    (("X", "x.com", None, None, "linkedin.com/company/x"), ("Y y y", "x.com.au", None, None, "linkedin.com/company/X"), 75, "C", ["linkedin", "tld_mismatch"]),
    (("Acme Works", None, "310-387-9598", "Tech", None), ("acme works", None, "(310) 387 9598", "tech", None), 55, "D", ["phone", "name", "name_industry"]),
    ((None, None, None, None, None), (None, None, None, None, None), 0, "D", []),
])
def test_company_pairs(spark, a, b, score, grade, signals):
    r = dedup.score_companies(pairs(spark, a, b)).first()
    assert (r["confidence"], r["grade"], [s["type"] for s in r["signals"]]) == (score, grade, signals)


def test_contact_pairs(spark):
    schema = "id string, email string, name string, company string, phone string, linkedin string"
    records = spark.createDataFrame([("a", "X@a.com", "Jo Do", "Acme", "3103879598", None), ("b", "x@a.com ", "Zed", None, None, None), ("c", None, "Jo Do", "Acme", "310 387 9598", None)], schema)
    found = dedup.candidate_pairs(records, dedup.contact_keys(F.col("email"), F.col("phone"), F.col("linkedin")))
    got = {(r["a_id"], r["b_id"]): (r["confidence"], r["grade"]) for r in dedup.score_contacts(dedup.with_records(found, records)).collect()}
    assert got == {("a", "b"): (95.0, "A"), ("a", "c"): (85.0, "A")}


def _jaro_winkler(a, b):
    """A plain loop: letters of one text take the first free equal letter of the other within reach."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    a, b = a.lower(), b.lower()
    reach = max(len(a), len(b)) // 2 - 1
    if reach < 0:
        return 0.0
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(len(a), len(b), 4) and a[prefix] == b[prefix]:
        prefix += 1
    return min(1.0, jaro + prefix * 0.1 * (1 - jaro))


def test_jaro_winkler_against_a_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcA ") for _ in range(rng.randrange(14))) for _ in range(400)]
    rows = spark.createDataFrame(list(zip(texts[:200], texts[200:])), "a string, b string")
    for r in rows.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == pytest.approx(_jaro_winkler(r["a"], r["b"]))


def test_signal_groups_and_composite(spark):
    p = pairs(spark, ("Acme  Co", "x.com", "310 387 9598", "t", None), ("ACME co", "y.com", "(310)387-9598", "t", None))
    groups = [{"id": "g1", "conditions": [{"field": "domain", "match_type": "exact", "weight": 1}]}, {"id": "g2", "conditions": [{"field": "name", "match_type": "normalized", "weight": 2}, {"field": "phone", "match_type": "normalized", "weight": 1}]}]
    r = dedup.score_by_groups(p, groups).first()
    assert (r["group"], r["confidence"], r["grade"]) == ("g2", 100.0, "A")


def test_components(spark):
    made = spark.createDataFrame([("a", "b", "B"), ("b", "c", "A"), ("d", "e", "C")], "a_id string, b_id string, grade string")
    got = {r["cluster"]: (r["record_ids"], r["pairs"], r["grade"]) for r in dedup.clusters(made).collect()}
    assert got == {"a": (["a", "b", "c"], 2, "A"), "d": (["d", "e"], 1, "C")}
    assert dedup.clusters(made.limit(0)).count() == 0


CANDIDATE = "record_id int, field string, provider string, value string, retrieved_at timestamp, position int"


def candidates(spark, *rows):
    return spark.createDataFrame([(1, "f", p, v, dt.datetime(2024, 1, d), k) for k, (p, v, d) in enumerate(rows)], CANDIDATE)


def test_waterfalls(spark):
    c = candidates(spark, ("zulu", None, 1), ("alpha", "Software", 2), ("charlie", "Tech", 3))
    assert tuple(resolve.waterfall(c).first())[2:] == ("Software", "alpha")
    current = spark.createDataFrame([(1, "f", "Existing Value"), (2, "f", None)], "record_id int, field string, value string")
    got = {r["record_id"]: (r["value"], r["source"]) for r in resolve.waterfall(c, current, mode="fill_empty").collect()}
    assert got[1] == ("Existing Value", "existing")


def test_resolution(spark):
    c = candidates(spark, ("a", "x", 1), ("b", "y", 3), ("c", "x", 2), ("d", " ", 9))
    assert resolve.priority(c, ["b", "a"]).first()["value"] == "y"
    assert resolve.recency(c).first()["value"] == "y"
    assert tuple(resolve.consensus(c).first())[2:] == ("x", 2)
    assert resolve.conservative(candidates(spark, ("a", "30", 1), ("b", "7", 1))).first()["value"] == "7"
    assert resolve.conservative(candidates(spark, ("a", "long text", 1), ("b", "tiny", 1))).first()["value"] == "tiny"
    assert resolve.cluster_average(candidates(spark, ("a", "100", 1), ("b", "110", 1), ("c", "105", 1), ("d", "1000", 1))).first()["value"] == 105


def test_cache_and_prospects(spark):
    now = dt.datetime(2024, 5, 1)
    rows = spark.createDataFrame([(1, "a", now - dt.timedelta(days=1), "old", 5), (1, "b", now + dt.timedelta(days=1), "new", None), (1, "c", now + dt.timedelta(days=9), "third", 7)], "record_id int, provider string, ttl_expires_at timestamp, name string, size int")
    assert tuple(resolve.cached_rows(rows, ["name", "size"], ["a", "b", "c"], F.lit(now)).first()) == (1, "new", "7")
    p = spark.createDataFrame([("alpha", "x.com", "A", None, ["t1"]), ("zulu", "x.com", None, 5, ["t2", "t1"])], "provider string, domain string, name string, size int, technologies array<string>")
    r = resolve.merge_prospects(p, ["zulu", "alpha"], ["name", "size"]).first()
    assert (r["name"], r["size"], r["technologies"], r["provider"]) == ("A", 5, ["t1", "t2"], "zulu+alpha")


def test_survivorship(spark):
    row = spark.createDataFrame([("false", "true", "a", None)], "m string, d string, x string, y string")
    got = row.select(survivorship.choose("boolean_union", F.col("m"), F.col("d")).alias("u"), survivorship.fold([("prefer_nonempty", {}), ("append", {})], F.col("x"), F.col("y")).alias("f")).first()
    assert (got["u"], got["f"]) == ("true", "a")
    groups = [{"priority": 2, "conditions": [{"field": "v", "operator": "gt", "value": 5}]}, {"priority": 1, "conditions": [{"field": "v", "operator": "is_populated"}]}]
    rows = spark.createDataFrame([(1, ("9",), ("3",)), (2, ("0",), ("3",)), (3, ("7",), ("8",)), (4, (None,), (None,))], "n int, a struct<v:string>, b struct<v:string>")
    assert [r["w"] for r in rows.orderBy("n").select(survivorship.group_winner(groups).alias("w")).collect()] == ["a", "b", None, None]


def test_owners(spark):
    rows = spark.createDataFrame([("x", "y", True, True), ("x", "y", False, True), ("x", "y", False, False), (None, None, None, None)], "m string, d string, ma boolean, da boolean")
    how = [r["o"]["how"] for r in rows.select(survivorship.owner(F.col("m"), F.col("d"), F.col("ma"), F.col("da"), None).alias("o")).collect()]
    assert how == ["kept_active", "fallback", "kept_inactive", "unassigned"]


def test_lookup_tiers(spark):
    ref = spark.createDataFrame([("software", "Software", None, True, True), ("software", "Own", "o1", True, True), ("computer hardware", "Hardware", None, True, True), ("robert", "Bob", None, True, True), ("nite", "closed", None, True, False)], "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    values = spark.createDataFrame([("Software ",), ("computer hardwares",), ("Rupert",), ("Knight",), ("zzz",), (None,)], "v string")
    got = {r["value"]: (r["canonical"], r["match_type"], r["confidence"]) for r in lookup.lookup(values, ref, org="o1", threshold=0.7, sounds=True).collect()}
    assert got["Software "] == ("Own", "exact", 100) and got["computer hardwares"][:2] == ("Hardware", "fuzzy") and got["Rupert"] == ("Bob", "phonetic", 65) and got["Knight"] == got["zzz"] == (None, "none", 0)
    compound = lookup.classify_compound(spark.createDataFrame([("zzz; software",), ("nothing",)], "v string"), ref)
    assert {r["value"]: r["canonical"] for r in compound.collect()} == {"zzz; software": "Software", "nothing": None}


def test_crosswalk_registry_relationship(spark):
    table = spark.createDataFrame([("11", "Farms", "farming", "AGRI"), ("22", "Power", "utilities", "UTIL")], "naics_code string, naics_label string, source_label string, crm_value string")
    rows = spark.createDataFrame([(1, "11", None, None), (2, None, "POWER", None), (3, "99", "x", "Farming"), (4, None, None, None)], "n int, naics_code string, naics_label string, provider_label string")
    assert {r["n"]: (r["value"], r["matched_by"]) for r in lookup.crosswalk(rows, table).collect()} == {1: ("AGRI", "naics_code"), 2: ("UTIL", "naics_label"), 3: ("AGRI", "provider_label"), 4: (None, "miss")}
    registry = spark.createDataFrame([("acme", "ACME", None, "active"), ("acme", "Acme!", "o1", "active"), ("ibm", "IBM", None, "active"), ("old", "Old", None, "retired")], "input_token string, canonical_form string, org_id string, status string")
    tokens = spark.createDataFrame([("acme",), ("ibm",), ("old",)], "t string")
    assert {r["token"]: (r["canonical_form"], r["scope"]) for r in lookup.registry_lookup(tokens, registry, "o1").collect()} == {"acme": ("Acme!", "org"), "ibm": ("IBM", "global"), "old": (None, None)}
    records = spark.createDataFrame([("p", None), ("c1", "p"), ("c2", "p"), ("d", "q"), ("e", None)], "id string, parent_id string")
    made = spark.createDataFrame([("p", "c1"), ("c1", "c2"), ("c1", "d"), ("c1", "e"), ("p", "e")], "a string, b string")
    assert {(r["a"], r["b"]): r["relationship"] for r in lookup.relationship(made, records).collect()} == {("p", "c1"): "directly_linked", ("c1", "c2"): "same_parent", ("c1", "d"): "sibling", ("c1", "e"): "one_has_parent", ("p", "e"): "no_hierarchy"}


def test_greedy_assignment(spark):
    groups = spark.createDataFrame([("a", 10), ("b", 6), ("c", 5), ("d", 1)], "key string, n int")
    got = {r["key"]: r["owner"] for r in matching.assign_groups(groups, {"x": 0.5, "y": 0.5}).collect()}
    assert got == {"a": "x", "b": "y", "c": "y", "d": "x"}


def _dealt(groups, shares):
    """A plain loop over all groups, in exact fractions."""
    share = {o: Fraction(str(x)) / sum(Fraction(str(y)) for y in shares.values()) for o, x in shares.items()}
    total, have, out = sum(n for _, n in groups), dict.fromkeys(shares, 0), {}
    for key, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        o = max(shares, key=lambda o: total * share[o] - have[o])
        have[o] += n
        out[key] = o
    return out


@pytest.mark.parametrize("shares", [{"x": 0.5, "y": 0.5}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.05, "b": 0.9, "c": 0.05, "d": 0.1}, {"one": 1}])
def test_assignment_against_a_loop(spark, shares):
    rng = random.Random(len(shares))
    rows = [(c, f"{c}-{k:04d}", rng.choice([1, 1, 1, 2, 3, 7, 40])) for c in ("p", None) for k in range(400)]
    table = spark.createDataFrame(rows, "campaign string, key string, n int").repartition(5)
    got = {r["key"]: r["owner"] for r in matching.assign_groups(table, shares, by="campaign").collect()}
    want = {**_dealt([(k, n) for c, k, n in rows if c], shares), **_dealt([(k, n) for c, k, n in rows if not c], shares)}
    assert got == want


def test_turns_against_single_steps():
    rng = random.Random(4)
    for _ in range(300):
        k, n, m = rng.randrange(1, 5), rng.randrange(1, 6), rng.randrange(1, 40)
        target = [Fraction(rng.randrange(0, 60), rng.choice([1, 2, 3])) for _ in range(k)]
        have, one = [Fraction(0)] * k, [Fraction(0)] * k
        got = [turn[(r - a) % len(turn)] for a, b, turn in matching.rotations(target, have, n, m) for r in range(a, b + 1)]
        want = []
        for _ in range(m):
            o = max(range(k), key=lambda o: target[o] - one[o])
            one[o] += n
            want.append(o)
        assert got == want and have == one


def test_company_matches_against_all_pairs(spark):
    names = ["Acme Works", "Acme Work", "Acorn", "Zeta Labs", "Zeto Labs"]
    records = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "id int, name string, domain string")
    rows = spark.createDataFrame([(k, n.upper() + " Inc", "") for k, n in enumerate(names)] + [(9, "Qqq", "")], "row_id int, company string, email string")
    got = {r["row_id"]: (r["id"], r["action"]) for r in matching.match_companies(rows, records).collect()}
    for k, n in enumerate(names):
        scores = {j: _jaro_winkler(n.lower(), m.lower()) for j, m in enumerate(names) if m[:3].lower() == n[:3].lower()}
        assert got[k] == (max(scores, key=scores.get), "match")
    assert got[9] == (None, "none")


def test_gate(spark):
    """By domain, else by name; somebody's child is skipped, a known record is itself, a weak match is new."""
    schema = "name string, domain string, phone string, industry string, employees string"
    records = spark.createDataFrame([(1, None, "Acme", "acme.com", "1", "x", "10"), (2, None, "Beta", None, "22", "x", "60"), (3, 1, "Child", "child.io", None, None, None), (4, None, "Gamma", None, None, None, None)], f"id int, parent_id int, {schema}")
    rows = spark.createDataFrame([
        (1, None, "Acme Inc", "www.acme.com", "1", "x", "12"), (2, None, "BETA Inc.", None, "22", "x", "60"), (3, None, "New", "new.io", None, None, None), (4, None, " ", None, None, None, None),
        (5, None, "Child", "child.io", None, None, None), (6, 4, "Gamma", "gamma.io", None, None, None), (7, 4, "Other", "acme.com", None, None, None),
    ], f"row_id int, known_id int, {schema}")
    got = {r["row_id"]: (r["action"], r["id"], r["score"]) for r in matching.gate(rows, records).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: ("review", 1), 2: ("insert", None), 3: ("insert", None), 4: ("insert", None), 5: ("skip", 3), 6: ("upsert", 4), 7: ("upsert", 4)}
    assert got[1][2] == pytest.approx(0.5 + 0.25 * 0.5 + 0.1 + 0.08 + 0.035) and got[3][2] is None
    assert got[7][2] is None  # below the least, a known record's rival is not named


def test_gate_by_relation(spark):
    """A known record is warned of a near one, but not of its parent or child; shared domains are nobody's."""
    schema = "name string, domain string, phone string, industry string, employees string"
    same = ("acme.com", "1", "x", "10")
    records = spark.createDataFrame([(1, None, "Acme", *same), (2, 1, "Acme", "child.io", "1", "x", "10"), (3, None, "Acme", "child.io", "1", "x", "10"), (4, None, "Solo", "gmail.com", "1", "x", "10")], f"id int, parent_id int, {schema}")
    rows = spark.createDataFrame([(1, 9, "Acme", *same), (2, 2, "Acme", *same), (3, 1, "Acme", "child.io", "1", "x", "10"), (4, None, "Other", "gmail.com", "1", "x", "10"), (5, None, "Acme", "child.io", "1", "x", "10")], f"row_id int, known_id int, {schema}")
    got = {r["row_id"]: (r["action"], r["id"], r["score"], r["warning"]) for r in matching.gate(rows, records).collect()}
    assert got[1] == ("upsert", 9, 1.0, "Potential duplicate found: Acme (100% similar)")
    assert got[2] == ("upsert", 2, None, None) and got[3] == ("upsert", 1, None, None) and got[4] == ("insert", None, None, None)
    assert got[5] == ("skip", 2, 1.0, "Parent-child suppression: matched company 2 is a child of 1. Manual review required.")


def test_stratified_sample(spark):
    rows = spark.createDataFrame([(k, "big" if k < 90 else "small" if k < 99 else "one") for k in range(100)], "id int, s string")
    first = sampling.stratified(rows, "s", "id", 20).collect()
    assert len(first) == 20 and {r["s"] for r in first} == {"big", "small", "one"}
    assert {r["id"] for r in first} == {r["id"] for r in sampling.stratified(rows.repartition(5), "s", "id", 20).collect()}
    assert [sampling.sample_size(n) for n in (10, 300, 3000, 10**6)] == [10, 50, 100, 400]


def test_scoring_and_calibration(spark):
    row = spark.createDataFrame([("Software", 30, "US", "CA", ["Aws", "x"])], "i string, n int, c string, s string, t array<string>")
    fit = lambda **p: tuple(row.select(scoring.profile_score(p, F.col("i"), F.col("n"), F.lit("Oslo"), F.col("s"), F.col("c"), F.col("t")).alias("f")).select("f.*").first())
    assert fit() == (95, 35, 25, 20, 15)
    assert fit(industries=["soft", "software"], employee_min=40, states=["ca"], technologies=["aws", "gcp"]) == (63, 21, 19, 16, 8)
    assert fit(industries=["retail"], employee_max=10, cities=["bergen"], countries=["us"], technologies=["gcp"]) == (12, 0, 0, 12, 0)
    d = spark.createDataFrame([("name", True)] * 4 + [("name", False)] + [("tld", True), ("tld", False)] * 2, "signal string, longer boolean")
    assert [(r["signal"], r["prefers"]) for r in scoring.consistency(d, "signal", "longer").collect()] == [("name", True)]


def test_rule_specifications(spark):
    for spec in queries.SPECS:
        assert rules.run_tests(spark, spec) == []
    bad = {**queries.SPECS[0], "tests": [{"name": "x", "input": "ACME Inc.", "expected": "wrong"}]}
    assert [c["got"] for c in rules.run_tests(spark, bad)] == ["Acme"]
    with pytest.raises(ValueError, match="on_error"):
        rules.checked({**queries.SPECS[0], "on_error": "maybe"})
    assert rules.version_key("1.10.0") > rules.version_key("1.9.3")


def test_rule_error_policies(spark):
    base = {"id": "n", "version": "1", "field": "v", "rules": [{"id": "r1", "transform": "try_cast($value AS int) * 2"}, {"id": "r2", "transform": "'other'"}]}
    rows = spark.createDataFrame([("4",), ("x",)], "v string")
    run = lambda spec: [r["x"] for r in rows.select(rules.cascade(spec)[0].alias("x")).collect()]
    assert run(base) == ["8", "other"]
    assert run({**base, "on_error": "fail_default", "rules": [{**base["rules"][0], "default": 0}]}) == ["8", "0"]
    with pytest.raises(Exception, match="no result"):
        run({**base, "on_error": "fail_loud"})
    out = rules.chain(rows, [base], "v").collect()
    assert [(r["v"], r["applied"]) for r in out] == [("8", ["n@1"]), ("other", ["n@1"])]


def test_rules_from_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: low\nversion: 1.0.0\nfield: v\nrules:\n  - id: r\n    transform: lower($value)\ntests:\n  - {name: t, input: ABC, expected: abc}\n")
    loaded = rules.load(str(tmp_path))
    assert list(loaded) == ["low"] and rules.run_tests(spark, loaded["low"]) == []
    library = {"a": {"id": "a", "field": "v", "category": "x", "tags": ["t"]}, "b": {"id": "b", "field": "v", "category": "y"}}
    assert list(rules.chosen(library, field="v")) == ["a", "b"] and list(rules.chosen(library, category="y")) == ["b"] and list(rules.chosen(library, tag="t")) == ["a"]
    assert rules.summary(library, "category") == {"x": 1, "y": 1}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=x", 'say "hi", ok', None), ("a", "line\nbreak", "b")], "`Company Name` string, note string, `E-Mail` string")
    tables.write_csv(df, f"{tmp_path}/out")
    back = tables.read_csv(spark, f"{tmp_path}/out")
    assert back.columns == ["company_name", "note", "e_mail"]
    assert sorted(r["company_name"] for r in back.collect()) == ["'=x", "a"] and sorted(r["note"] for r in back.collect()) == ["line\nbreak", 'say "hi", ok']
    kinds = tables.column_kinds(spark.createDataFrame([("a@b.com", "x"), ("c@d.org", "y")], "contact string, name string"))
    assert kinds == {"contact": "email", "name": "name"}


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("handler", F.when(F.col("value") > 60, "merge").when(F.col("value") < 20, "deletion").otherwise("change"))
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    got = {}

    def keep(df, _):
        for r in df.collect():
            got[r["user_id"]] = (r["status"], r["version"])

    stream = events.source(spark, f"{tmp_path}/in", batch.schema)
    events.drain(events.lifecycle(stream, "user_id"), keep, f"{tmp_path}/c1", "update")
    assert got == {r["user_id"]: (r["status"], r["version"]) for r in events.lifecycle(batch, "user_id").collect()}

    seen = []
    stream = events.source(spark, f"{tmp_path}/in", batch.schema)
    doubled = stream.unionByName(events.source(spark, f"{tmp_path}/in", batch.schema))
    events.drain(events.once(doubled, ["event_id"], late="365 days"), lambda df, _: seen.extend(r["event_id"] for r in df.collect()), f"{tmp_path}/c2")
    assert sorted(seen) == sorted(r["event_id"] for r in batch.select("event_id").distinct().collect())


def test_stream_upsert_goes_on_behind_its_checkpoint(spark, tmp_path):
    schema = "k int, v int, at timestamp"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(0, [(1, 1, dt.datetime(2024, 1, 1)), (1, 2, dt.datetime(2024, 1, 2))])
    run = lambda: events.drain(events.source(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), events.upsert_sink(f"{tmp_path}/out", ["k"], "at"), f"{tmp_path}/c")
    run()
    put(1, [(2, 5, dt.datetime(2024, 1, 3))])
    run()
    assert sorted((r["batch"], r["k"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 1, 2), (1, 2, 5)]


def test_scan_modes():
    now, day = dt.datetime(2024, 5, 10), dt.timedelta(days=1)
    assert events.scan_mode(None, None, now) == "full" and events.scan_mode(now - 8 * day, now, now) == "full"
    assert events.scan_mode(now - day, now, now) == "incremental" and events.scan_mode(now - day, now, now, undated=1) == "full"


def test_scratch_tables(spark):
    s = Scratch(spark, "t")
    t = s.write(spark.range(3), "a")
    assert t.count() == 3
    s.drop("a")
    with pytest.raises(Exception):
        spark.read.parquet(f"{s.root}/a")


def test_all_pairs_of_a_block(spark):
    records = spark.createDataFrame([(str(k), "acme", "x.com", None, None) for k in range(5)], "id string, name string, domain string, phone string, linkedin string")
    keys = dedup.company_keys(F.col("name"), F.col("domain"), F.col("phone"), F.col("linkedin"))
    assert {(r["a"], r["b"]) for r in dedup.candidate_pairs(records, keys).collect()} == set(combinations("01234", 2))


def test_scratch_tables_are_removed(spark):
    from tidewater import storage

    made = storage.Scratch(spark, "test")
    made.write(spark.range(3), "t")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made.root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    storage.clean(spark)
    assert not files.exists(path) and not storage._roots


def test_company_matches_of_one_crowded_block(spark):
    """Equal names of a block are found without scoring its other names: 6,000 names that begin alike (they took 36 million scores)."""
    records = spark.range(6000).select("id", F.format_string("Supplier#%06d Inc.", "id").alias("name"), F.lit(None).cast("string").alias("domain"))
    rows = spark.range(6000).select(F.col("id").alias("row_id"), F.format_string("supplier#%06d", "id").alias("company"), F.lit("").alias("email"))
    got = matching.match_companies(rows, records.unionByName(records.withColumn("id", F.col("id") + 6000)))
    assert got.filter("id = row_id AND score = 1 AND action = 'match'").count() == got.count() == 6000


def test_company_review_codes_come_again(spark, tmp_path):
    """From group 10,000 on codes begin anew, as in SQL; the first four digits were taken."""
    row = spark.createDataFrame([(k, f"C{k}", 1, 1.0, "BUILDING") for k in (36999, 37000, 69999, 70000)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    row.write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["row_id"]: (r["id"], r["score"]) for r in queries.QUERIES["company_review"](spark, str(tmp_path)).collect()}
    assert got["c000036999"] == ("c000036999", 1.0) and got["c000069999"] == ("c000069999", 1.0)
    assert got["c000070000"][0] == "c000069999" and got["c000037000"][0] == "c000036999"


def test_contact_cascade_beyond_ten_thousand_groups(spark, tmp_path):
    """Groups 23 and 10,023 had firms of one name, so a row of the second went to the first."""
    row = spark.createDataFrame([(k, f"C{k}", 1, 1.0, "BUILDING") for k in (69, 70, 30069, 30070)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    row.write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["row_id"]: r["company_id"] for r in queries.QUERIES["contact_cascade"](spark, str(tmp_path)).collect()}
    assert got["c000030070"] == "c000030069"


def test_lookup_broadcasts_no_values(spark):
    """Many distinct values compress well on disk; none of the joins may take them whole to the driver."""
    values = spark.range(3000).select(F.concat(F.lit("Filips "), "id").alias("value"))
    reference = spark.createDataFrame([("Phillips", "P", None, True, True)], "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    found = lookup.lookup(values, reference, sounds=True)
    assert found.filter("match_type = 'phonetic' AND canonical = 'P'").count() == found.count() == 3000
    joins = [j for j in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftAnti" in j]
    assert joins and all("strategy=merge" in j for j in joins)


def test_sure_pairs_are_the_scored_pairs_from_65_on(spark):
    """Shared domains block nothing, but count once two records meet by phone or name; meeting by host or profile loses none of them."""
    rows = [(i, f"{'Acme' if i % 2 else 'Zeta'} {i % 5}", ("gmail.com", f"c{i % 4}.com", None, "www.gmail.com")[i % 4], (None, "212 555 0001", f"212 555 {i:04d}", "414 777 0000")[i // 3 % 4], ("it", "law")[i % 2], f"linkedin.com/company/x{i // 7}" if i % 3 == 0 else None) for i in range(60)]
    c = spark.createDataFrame(rows, "id int, name string, domain string, phone string, industry string, linkedin string")
    show = lambda df: sorted(map(str, df.select("a_id", "b_id", "confidence", "grade", "signals").collect()))
    keys = dedup.company_keys(*(F.col(x) for x in ("name", "domain", "phone", "linkedin")))
    every = dedup.score_companies(dedup.with_records(dedup.candidate_pairs(c, keys), dedup.comparable(c)))
    assert show(dedup.company_pairs(c)) == show(every)
    assert show(dedup.company_pairs(c, 65)) == show(every.filter("confidence >= 65")) != []


def test_pairs_are_never_shuffled(spark):
    """A pair comes out once, at the first common key: no aggregate over pairs follows the join."""
    index = spark.createDataFrame([(i, kind, f"k{i % m}") for i in range(40) for kind, m in (("a", 3), ("b", 4), ("c", 5))], "id int, kind string, key string")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if any(i % m == j % m for m in (3, 4, 5))}
    got = [tuple(r) for r in dedup.pairs_of(index).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in dedup.pairs_of(index, spark.createDataFrame([(5,), (8,), (8,)], "id int")).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in want if {5, 8} & set(p)}
    plan = dedup.pairs_of(index)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_waterfall_of_equal_positions(spark, tmp_path):
    """Lines 1 and 11 of orders 2 and 1 are at one position: the first row of the table wins, whichever provider it has."""
    import duckdb

    rows = [(1 + (i + p) % 2, p, p * 7 + i, 1 + 10 * ((i + p + 1) % 2), 1.0, 100.0 * (i + 3), dt.datetime(2024, 1, 1)) for i in range(4) for p in range(300)]
    table = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["resolve_waterfall"]).fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["resolve_waterfall"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 300


def test_keys_and_facts_are_made_once_for_each_record(spark, monkeypatch):
    """No filter or branch makes a key again (a host was made up to five times for each key), and pairs are scored with a number of signals beside the list."""
    monkeypatch.setattr(dedup, "extract_domain", lambda c: F.concat(c, F.lit("HOSTMARK")))
    c = spark.createDataFrame([(i, f"Acme {i % 4}", f"c{i % 5}.com", f"212 555 {i % 6:04d}", "it", f"linkedin.com/company/x{i // 3}") for i in range(30)], "id int, name string, domain string, phone string, industry string, linkedin string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    keys = dedup.company_keys(*(F.col(x) for x in ("name", "domain", "phone", "linkedin")))
    for df, sides in ((dedup.candidate_pairs(c, keys), 2), (dedup.company_pairs(c), 4)):
        assert 0 < plan(df).count("HOSTMARK") <= sides
    monkeypatch.undo()
    scored = dedup.company_pairs(c)
    assert scored.filter("signal_count <> size(signals)").isEmpty() and scored.filter("signal_count > 2").count() > 0


def test_cluster_average_where_a_value_is_as_far_as_the_deviation(spark, tmp_path):
    """One value is as far from the median as the deviation, so its last bit decides, which goes by the order of the rows."""
    import random
    from statistics import median

    import duckdb

    rng, groups = random.Random(11), []
    while len(groups) < 150:
        n = [rng.randrange(30) for _ in range(rng.randrange(7, 12))]
        spread = len(n) * sum(x * x for x in n) - sum(n) ** 2  # times the square of the count
        if any((x - median(n)) ** 2 * len(n) ** 2 == spread > 0 for x in n):
            groups.append(n)
    rows = [(2 + 11 * i, p, i, 1, 1.0, 100.0 * groups[p][i], dt.datetime(2024, 1, 1)) for i in range(11) for p in range(150) if i < len(groups[p])]
    table = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    table.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(queries.SQL["resolve_cluster_average"]).fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["resolve_cluster_average"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == 150
    far = con.execute("SELECT l_partkey AS record_id, 'price' AS field, (l_extendedprice / 10)::INT::VARCHAR AS value FROM lineitem").fetchall()
    shapes = [sorted(map(tuple, resolve.cluster_average(spark.createDataFrame(far, "record_id bigint, field string, value string").repartition(k)).collect())) for k in (1, 7)]
    assert shapes[0] == shapes[1]


def test_trigrams_are_not_broadcast(spark, tmp_path):
    """Values that are small on disk have many trigrams; neither side of their joins may be built on the driver."""
    spark.range(3000).select(F.concat(F.lit("Filips "), "id").alias("value")).write.parquet(f"{tmp_path}/values")
    rows = [("filips  123", "P", None, True, True)]
    reference = spark.createDataFrame(rows, "input_value string, canonical_value string, org_id string, is_active boolean, fuzzy_eligible boolean")
    ref = reference.select(F.col("input_value").alias("ref"), F.col("canonical_value").alias("canonical"), "org_id")
    found = lookup.fuzzy_lookup(spark.read.parquet(f"{tmp_path}/values"), ref, 0.95)
    joins = [j for j in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (" in j and "(g#" in j]
    assert len(joins) == 3 and all("strategy=merge" in j for j in joins)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert [r["value"] for r in found.collect()] == ["Filips 123"]
