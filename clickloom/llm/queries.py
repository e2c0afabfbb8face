"""The corpus queries: each applies its operator to whole tables, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import centroids, decontam, langid, mixing, ngram_lm, quality, secret_scan, simhash, spelling, token_counts, topk, toxicity, url_filter
from clickloom.llm.text import remainder

QUERIES = {}
SQL: dict[str, str] = {}
TOKEN_LIMIT = 1024


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    scored = toxicity.with_toxicity(docs, model)
    score = F.col("toxicity.score")
    predicted = (score >= toxicity.THRESHOLD).cast("int")
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), score.alias("score"), predicted.alias("predicted"), "toxicity.n_hits"
    )


@_query
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op3_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))

    def number(keep) -> F.Column:
        return F.size(F.filter("spans", keep)).cast("long")

    def of_kind(kind: int) -> F.Column:  # a second parameter of the function would be the element's index
        return number(lambda s: s["kind"] == kind)

    kinds = [of_kind(i).alias(f"n_{name}") for i, name in enumerate(secret_scan.ORDER[:3])]
    base = secret_scan.listed("spans", lambda s: s["kind"] < 3)
    spans = secret_scan.listed("spans", lambda s: (s["kind"] < 3) | s["live"])
    live = number(lambda s: s["live"])
    return found.select("doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), live.alias("n_live"))


@_query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.learn(docs.where(remainder("doc_id", 4) != 2))
    told = langid.with_language(docs.select("doc_id", "text"), trees)
    return told.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score", "language.bits")


@_query
def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    met = decontam.with_matches(docs, _table(spark, sf_dir, "benchmark"))
    items = F.col("matches.items")
    return met.select(
        "doc_id",
        F.col("matches.n_words").alias("n_words"),
        decontam.n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL["op6_decontam"] = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w, row_number() OVER () AS pos FROM documents),
places AS (
  SELECT pos, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT pos, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT pos, i, p.n, item_id FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
hits AS (SELECT pos, count(DISTINCT k) AS n_hit FROM (SELECT pos, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT pos, i, n FROM found)) GROUP BY pos),
named AS (SELECT pos, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT pos, item_id FROM found) GROUP BY pos)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (pos) LEFT JOIN named USING (pos)"""


@_query
def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mixed_sizes(_table(spark, sf_dir, "documents"))
    return taken.withColumn("shards", F.array_join(F.transform("shards", lambda s: s.cast("string")), ","))


@_query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


# Pages without a rule are allowed here: no page of the given tables names a canonical url or a redirect.
SQL["op10_url_filter"] = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS pos
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT pos, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY pos)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (pos)"""


@_query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    """The assignment to the centroids c{n}; for the first rounds also the centroids that follow."""
    assigned = f"""
a{n} AS (SELECT pos, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT pos, c, list_sum(list_transform(list_zip(v.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{n}) GROUP BY pos)"""
    if n == centroids.ROUNDS:
        return assigned
    return f"""{assigned},
m{n} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{n} JOIN v USING (pos)) GROUP BY c, i)
  GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))"""


SQL["op11_centroids"] = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS pos, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY name, v) - 1 AS c, v FROM (
    SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS name, v FROM v ORDER BY name, v LIMIT 16)),
{",".join(_round(n) for n in range(centroids.ROUNDS + 1))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{centroids.ROUNDS}.v, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN v USING (pos) JOIN c{centroids.ROUNDS} USING (c)"""


@_query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def _beyond(measure: str, slack: int) -> str:
    high = f"{measure} > any_value(q75 + {quality.SPREAD} * (q75 - q50) + {slack}) FILTER (measure = '{measure}')"
    low = f"{measure} < any_value(q25 - {quality.SPREAD} * (q50 - q25) - {slack}) FILTER (measure = '{measure}')"
    return f"CASE WHEN {high}{f' OR {low}' if measure in quality.LOW else ''} THEN '{measure}' END"


_NAMES = list(quality.MEASURES)
SQL["op12_quality"] = f"""
WITH docs AS (SELECT row_number() OVER () AS pos, doc_id, coalesce('=' || lang, '?') AS lang, coalesce('=' || source, '?') AS source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT pos, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT pos, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT pos, w, unnest(range(1, len(w) - 6)) AS i FROM parts)),
twice AS (SELECT pos, unnest(range(i, i + 8)) AS k FROM (SELECT pos, i, count(*) OVER (PARTITION BY pos, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT pos, count(DISTINCT k) AS n FROM twice GROUP BY pos),
counts AS (
  SELECT d.pos, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM docs d JOIN parts USING (pos) LEFT JOIN repeats USING (pos)),
told AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // nullif(word_chars, 0) AS symbols,
         1000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines, 1000 * n_repeat_words // nullif(n_words, 0) AS repeats, 1000 * word_chars // nullif(n_words, 0) AS word_length
  FROM counts),
long AS (SELECT lang, source, unnest({_NAMES}) AS measure, unnest([{', '.join(_NAMES)}]) AS value FROM told WHERE NOT base_failed),
cut AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 8, 0)) << greatest(length(bin(value)) - 8, 0) AS value FROM long WHERE value IS NOT NULL),
levels AS (
  SELECT 0 AS level, * FROM cut UNION ALL SELECT 1, lang, '', measure, value FROM cut UNION ALL SELECT 2, '', '', measure, value FROM cut),
quartiles AS (
  SELECT level, lang, source, measure, max(docs) AS docs, {', '.join(f'min(value) FILTER (100 * below >= {q} * docs) AS q{q}' for q in quality.QUARTILES)}
  FROM (SELECT *, count(*) OVER (g ORDER BY value) AS below, count(*) OVER g AS docs FROM levels WINDOW g AS (PARTITION BY level, lang, source, measure))
  GROUP BY ALL),
fit AS (
  SELECT o.lang, o.source, o.measure, arg_min(struct_pack(q25 := q.q25, q50 := q.q50, q75 := q.q75), q.level) AS q
  FROM quartiles o JOIN quartiles q ON q.measure = o.measure AND q.lang IN (o.lang, '') AND q.source IN (o.source, '')
    AND (q.level = 2 OR q.docs >= {quality.LEAST_GROUP}) AND (q.level <> 1 OR q.lang = o.lang)
  WHERE o.level = 0 GROUP BY ALL),
limits AS (SELECT lang, source, measure, q.q25 AS q25, q.q50 AS q50, q.q75 AS q75 FROM fit),
beyond AS (
  SELECT pos, concat_ws(',', {', '.join(_beyond(m, s) for m, s in quality.MEASURES.items())}) AS beyond
  FROM told JOIN limits USING (lang, source) WHERE NOT base_failed GROUP BY pos, {', '.join(_NAMES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(beyond, '') = '' AS kept, coalesce(beyond, '') AS beyond
FROM told LEFT JOIN beyond USING (pos)"""


@_query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


# crc32 by its table of 256 entries, which the first steps compute. Near words share what is left without one letter.
SQL["op13_spelling"] = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, sum(n) AS n FROM (
    SELECT doc_id, run, count(*) AS n FROM (SELECT row_number() OVER () AS pos, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    GROUP BY doc_id, run) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(id || ':' || run)), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT * FROM runs WHERE length(run) >= 7), crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, last) AS (SELECT word, word FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON c.last = t.word WHERE t.form IS NOT NULL)
SELECT t.word, form, last AS root, n, n_near, form_n
FROM told t JOIN (SELECT c.word, last FROM chain c JOIN told e ON c.last = e.word WHERE e.form IS NULL) USING (word)"""
