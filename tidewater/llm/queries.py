"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, divergence, mixing, negatives, neighbours, packing, pii, quality, secrets, simhash, substrings, token_files, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 3, 1, 2, repeating, and share 150 % of all words, none above twice its own."""
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * CAST(2.0 AS DOUBLE) AS cap,
    CAST([3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source),
levels AS (
  SELECT a.source, sum(CASE WHEN b.cap / b.weight < a.cap / a.weight OR b.cap / b.weight = a.cap / a.weight AND b.weight < a.weight THEN b.cap ELSE 0 END) AS capped,
    sum(CASE WHEN b.cap / b.weight < a.cap / a.weight OR b.cap / b.weight = a.cap / a.weight AND b.weight < a.weight THEN 0 ELSE b.weight END) AS rest,
    sum(b.source_size) * CAST(1.5 AS DOUBLE) AS total
  FROM s a, s b GROUP BY a.source),
free AS (SELECT s.*, capped, rest, total, (total - capped) * weight <= cap * rest AS is_free FROM s JOIN levels ON s.source IS NOT DISTINCT FROM levels.source),
first AS (SELECT capped, rest FROM free WHERE is_free ORDER BY capped, rest DESC LIMIT 1),
plan AS (
  SELECT free.source, source_size, CASE WHEN is_free THEN (total - first.capped) * weight / first.rest ELSE cap END AS target
  FROM free LEFT JOIN first ON true),
r AS (
  SELECT doc_id, size, source_size, target, d.source, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two differing bits or fewer."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in rANS frames, and what those say when read."""
    return token_files.tokenize_and_read(documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that occur elsewhere too."""
    cleaned = substrings.remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT r, i, md5(array_to_string(w[i + 1:i + 35], ' ')) AS h FROM p JOIN d USING (r)),
again AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY h) > 1),
covered AS (SELECT DISTINCT r, i + k + 1 AS j FROM again, (SELECT unnest(range(35)) AS k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN covered USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def held_out() -> Column:
    """Rows that are not learned from: crc32 of the doc_id as text is a multiple of 5 (no doc_id: held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the rule table's verdict of every text."""
    judged = quality.assess(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
a AS (
  SELECT doc_id, t, w, len(w) AS n,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) AS tri FROM d),
rep AS (
  SELECT doc_id, tri, unnest(places) AS i FROM (
    SELECT doc_id, tri, list(i) AS places FROM (SELECT doc_id, unnest(tri) AS tri, unnest(range(len(tri))) AS i FROM a) GROUP BY doc_id, tri HAVING count(*) > 1)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (
  SELECT a.doc_id, CAST(a.n AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_sql_list(quality.STOP_WORDS)}))) AS stops,
    len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS uppers
  FROM a LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / word_chars <= 0.05 AND stops / n_words >= 0.02
    AND n_dup_lines / n_lines <= 0.4 AND n_repeat_words / n_words <= 0.5 AND uppers / n_words <= 0.5 AS kept
FROM b
"""


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base kinds of secrets, and random strings at a false-discovery rate of 1 %."""
    return secrets.detect(documents(spark, sf_dir)).drop("found")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), capacity=4096)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    found = neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda id: id % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base kinds of personal data, and what the labelers and the classifier add."""
    return pii.detect(documents(spark, sf_dir)).drop("found")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth vector and its five positives, three rows of other labels at 50 to 95 % of the positive's score."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine(rows, lambda id: id % 50 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""


def op12_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = compression.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and the 200 terms that set each source off most."""
    return divergence.audit(documents(spark, sf_dir))


OP13_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS ln FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM k GROUP BY lang),
g AS (
  SELECT x.lang, x.source, coalesce(y.n, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL) y USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p,
    1 + 1000000000::HUGEINT * (k.ln + 1) // (v.total + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
every AS (
  SELECT * FROM pair UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 finds of the base kinds, which SQL can express."""
    return op10_pii(spark, sf_dir).drop("spans")


def secrets_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 finds of the base kinds, which SQL can express."""
    return op7_secrets(spark, sf_dir).drop("spans")


def _base_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """Spans of kinds, {name: (pattern, test of a match m)}, by the lengths of matches and of the pieces between them."""
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS m{k}, string_split_regex(t, '{p}') AS p{k}" for k, (p, _) in enumerate(kinds.values()))
    spans = ", ".join(
        f"list_transform(list_filter(list_transform(range(len(m{k})), lambda i: {{'s': list_sum(list_transform(p{k}[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i], lambda x: length(x))), 0), 'm': m{k}[i + 1]}}), lambda y: {test.format(m='y.m')}), lambda y: {{'s': y.s, 'k': {k}, 'e': y.s + length(y.m)}}) AS s{k}"
        for k, (_, test) in enumerate(kinds.values())
    )
    names = ", ".join(f"'{x}'" for x in kinds)
    every = " || ".join(f"s{k}" for k in range(len(kinds)))
    counts = ", ".join(f"len(s{k}) AS n_{x}" for k, x in enumerate(kinds))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, t, {found} FROM d), g AS (SELECT doc_id, {spans} FROM f)
SELECT doc_id, {counts}, sha256(array_to_string(list_transform(list_sort({every}), lambda y: ([{names}])[y.k + 1] || ':' || y.s::BIGINT::VARCHAR || ':' || y.e::BIGINT::VARCHAR), ',')) AS base_sha256 FROM g"""


_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN ({_DIGITS})[length({_DIGITS}) - j]::INT WHEN 2 * ({_DIGITS})[length({_DIGITS}) - j]::INT > 9 THEN 2 * ({_DIGITS})[length({_DIGITS}) - j]::INT - 9 ELSE 2 * ({_DIGITS})[length({_DIGITS}) - j]::INT END)) % 10 = 0"
PII_SQL = _base_sql({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split({m}, '.'), lambda x: length(ltrim(x, '0')) > 3 OR try_cast(x AS BIGINT) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
})
_KEY = "(?:" + "|".join("".join("_?" if c == "_" else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_key")) + ")"
_ASSIGN = _KEY + r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRETS_SQL = _base_sql({"assign": (_ASSIGN, f"length(regexp_extract({{m}}, '{_ASSIGN}', 1)) >= 6"), "access": ("AKIA[A-Z0-9]+", "length({m}) >= 20"), "hex": ("[0-9a-f]+", "length({m}) >= 24")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mix": op1_mix, "op2_simhash": op2_simhash, "op3_token_files": op3_token_files, "op4_substrings": op4_substrings, "op5_toxicity": op5_toxicity, "op6_quality": op6_quality, "op7_secrets": op7_secrets, "op8_pack": op8_pack, "op9_neighbours": op9_neighbours, "op10_pii": op10_pii, "op11_negatives": op11_negatives, "op12_compressed": op12_compressed, "op13_divergence": op13_divergence, "pii_base_spans": pii_base_spans, "secrets_base_spans": secrets_base_spans}
ORACLE_SQL: dict[str, str] = {"op1_mix": OP1_SQL, "op4_substrings": OP4_SQL, "op6_quality": OP6_SQL, "op11_negatives": OP11_SQL, "op13_divergence": OP13_SQL, "pii_base_spans": PII_SQL, "secrets_base_spans": SECRETS_SQL}
