"""The thin queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import balls, edits, exact, licenses, lines, mixing, packing, ppm, ranking, resample, simhash, store, urls
from pagewright.llm.common import scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after redaction."""
    return edits.edited_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), edits.redactions)


def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    store.write(table(spark, sf_dir, "documents"), at, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return store.verify(spark, at).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


#: Fixed rules, host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: The list has the hosts of the corpus with one of these in their name, and those of which the rules block this share of the pages or more.
LISTED_TERMS = ("adult", "ads-", "bets", "casino", "pills", "spam")
BLOCKED_SHARE = 0.5


def listed_hosts(pages: DataFrame) -> DataFrame:
    """The blocklist that the pages themselves give, a table of hosts."""
    host = urls.host(F.col("url"))
    _, verdict = urls.rule_verdict(F.col("host"), F.col("path"), URL_RULES)
    parsed = pages.select(host.alias("host"), urls.path(F.col("url")).alias("path"))
    counts = parsed.groupBy("host").agg(F.count_if(verdict == "block").alias("blocked"), F.count("*").alias("n"))
    return counts.where(F.rlike("host", F.lit("|".join(LISTED_TERMS))) | (F.col("blocked") >= BLOCKED_SHARE * F.col("n"))).select("host")


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES, listed_hosts(pages))


def op6_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _fold(n: int):
    """CRC-32 of the doc_id's digits, modulo ``n``."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, trees = ppm.train(docs.where(_fold(4) != 2))
    found = ppm.identify(docs, langs, trees)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.pack(parts, 1024)


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    ranked = ranking.rank(table(spark, sf_dir, "documents"), labels)
    return ranked.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op11_ball_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.clusters(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_csr_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_token_counts": op1_edit_token_counts,
    "op2_simhash_anchors": op2_simhash_anchors,
    "op3_block_naming": op3_block_naming,
    "op4_content_store": op4_content_store,
    "op5_bloom_cascade": op5_bloom_cascade,
    "op6_sainte_lague": op6_sainte_lague,
    "op7_ppm_language": op7_ppm_language,
    "op8_line_frequency": op8_line_frequency,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_bradley_terry": op10_bradley_terry,
    "op11_ball_k_means": op11_ball_k_means,
    "op12_license_templates": op12_license_templates,
    "op13_csr_resampling": op13_csr_resampling,
}

_OP3 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_OP5 = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, p.host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id
JOIN (SELECT host, regexp_matches(host, 'adult|ads-|bets|casino|pills|spam') OR count(*) FILTER (verdict = 'block') >= 0.5 * count(*) AS listed
      FROM p LEFT JOIN fit ON fit.page_id = p.page_id GROUP BY host) h ON h.host = p.host
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n >= 2
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), l AS (
  SELECT doc_id, source, line, lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), hashed AS (
  SELECT l.*, md5(norm) AS h, md5(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS copy FROM l JOIN d USING (doc_id)
), host AS (
  SELECT source, count(DISTINCT copy) AS texts FROM hashed GROUP BY source
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (SELECT count(*) - count(DISTINCT line) FROM l WHERE l.doc_id = d.doc_id) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats r ON r.doc_id = d.doc_id
), often AS (
  SELECT source, h FROM hashed JOIN host USING (source)
  GROUP BY source, h, texts HAVING count(DISTINCT copy) > greatest(20, 0.005 * texts)
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f.base_failed,
       n_words - coalesce(x.n, 0) AS n_left,
       NOT f.base_failed AND n_words - coalesce(x.n, 0) >= 0.3 * n_words AS kept
FROM base b
JOIN (SELECT doc_id, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base) f ON f.doc_id = b.doc_id
LEFT JOIN (SELECT l.doc_id, sum(l.n)::BIGINT AS n FROM hashed l JOIN often o ON o.source = l.source AND o.h = l.h GROUP BY 1) x ON x.doc_id = b.doc_id
"""

def _op11(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    near = "a{r} AS MATERIALIZED (SELECT vec_id, q, (m).n AS cluster, (m).d AS distance FROM (SELECT v.vec_id, v.q, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))), 'n': n}}) AS m FROM v, c{r} c GROUP BY v.vec_id, v.q))"
    mean = "c{s} AS MATERIALIZED (SELECT n, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT cluster, list((t - ((t % w) + w) % w) // w ORDER BY i) AS q FROM (SELECT cluster, i, sum(x)::BIGINT AS t, count(*) AS w FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.n)"
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [mean.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS n, q FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.n = cluster
"""


#: A-Z in lower case, then runs of digits, ASCII letters and all characters beyond ASCII.
_TEXT_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op12() -> str:
    by_label: dict[str, list[str]] = {}
    for label, template in licenses.TEMPLATES:
        by_label.setdefault(label, []).append(licenses.pattern(template))
    own = ", ".join(f"CASE WHEN regexp_matches(s, ' (?:{'|'.join(p)})') THEN '{label}' END" for label, p in by_label.items())
    stands = lambda phrase: " AND ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(phrase.split(), 1))
    return f"""
WITH t AS (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, list_transform(range(len(w)), lambda i: CASE {" ".join(f"WHEN {stands(x)} THEN '{label}'" for label, x in licenses.PHRASES)} END) AS b FROM t),
f AS (SELECT doc_id, len(w) AS n_words, list_filter(range(len(w)), lambda i: b[i + 1] IS NOT NULL) AS places, list_distinct(list_filter(b, lambda x: x IS NOT NULL)) AS basic, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, array_to_string(list_sort(basic), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(basic, own))), ',') AS labels, CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(basic) > 0 THEN 0.5 ELSE 0.0 END AS score
FROM f
"""


_OP13 = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), d AS (SELECT row_number() OVER () AS row, doc_id, {_TEXT_WORDS} AS w FROM documents),
e AS (SELECT unnest({_TEXT_WORDS}) AS word FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d),
vocabulary AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM e)), crc
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM e JOIN vocabulary USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN vocabulary USING (word) JOIN g USING (bucket) GROUP BY row),
x AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.row = d.row),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features, weight, score, rank FROM y LEFT JOIN (SELECT * FROM z WHERE rank <= (SELECT 10 * count(*) // 100 FROM z)) z ON z.doc_id = y.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_block_naming": _OP3, "op5_bloom_cascade": _OP5, "op8_line_frequency": _OP8, "op11_ball_k_means": _op11(), "op12_license_templates": _op12(), "op13_csr_resampling": _OP13,
}
