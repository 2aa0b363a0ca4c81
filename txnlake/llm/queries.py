"""The registered training-data queries (and their DuckDB SQL where it can express them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.llm import (
    chat,
    collocations,
    decontam,
    langid,
    pieces,
    quality,
    secret_scan,
    simhash,
    spelling,
    token_counts,
    topk,
    toxicity,
    url_filter,
)
from txnlake.llm.common import table

# The rules of the URL query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"),
             ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
             ("block", "com", "/de/")]


#: The vocabulary of the piece queries.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


# The added conversation of the chat query.
TRICKY_ID, TRICKY_TEXT = -7, r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(TRICKY_ID, i, role, TRICKY_TEXT)
                                   for i, role in enumerate(("user", "assistant"))],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionAll(added)))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


#: The categories of the toxicity chain, in its order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1",
              "toxic_low_quality": "toxic = 1 AND quality = 0"}


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.classify(docs, chain)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"),
                               table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_language_id,
                                  op4_chat_format, op5_exact_topk, op6_secret_scan,
                                  op7_toxicity_chain, op8_decontamination, op9_token_counts,
                                  op10_simhash_dedup, op11_quality,
                                  op12_spelling_variants, op13_collocations)}

#: crc32 over the bits of the bytes; single characters for the letters beyond ASCII, so that the
#: edit distance, which counts bytes, counts letters.
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_ASCII = "".join(map(chr, [*range(0x21, 0x5B), *range(0x5B, 0x61)]))[:64].replace("'", "\x7f")

ORACLES = {
    "op12_spelling_variants": f"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
c AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY d, w),
b AS (
  SELECT *, flatten(list_transform(string_split(d || ':' || w, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x), 0, 0, 0, 0, 0, 0, 0]
    ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(x) - 64, 0, 0, 0, 0, 0, 0, 0] END)) AS bits FROM c),
h AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(bits, lambda x: x::BIGINT)),
    lambda a, e: xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384))) AS h FROM b),
v AS (
  SELECT word, sum(n)::BIGINT AS n, translate(word, '{_LATIN}', '{_ASCII}') AS one FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT)
           || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (
  SELECT a.word, b.word AS other, b.n AS m
  FROM v a JOIN v b ON length(b.word) = length(a.word) AND levenshtein(a.one, b.one) = 1
  UNION ALL SELECT a.word, b.word, b.n
  FROM v a JOIN v b ON length(b.word) = length(a.word) + 1 AND levenshtein(a.one, b.one) = 1
  UNION ALL SELECT a.word, b.word, b.n
  FROM v a JOIN v b ON length(b.word) = length(a.word) - 1 AND levenshtein(a.one, b.one) = 1),
g AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form,
         CASE WHEN m >= 5 * v.n THEN m END AS form_n
  FROM v LEFT JOIN g USING (word)),
s(word, cur, step) AS (
  SELECT word, word, 0 FROM f
  UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.cur WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n
FROM f JOIN (SELECT word, arg_max(cur, step) AS root FROM s GROUP BY word) USING (word)
""",
    "op13_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^ \t]+') AS w FROM p),
f1 AS (SELECT lang, x AS w1, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS (
  SELECT lang, x.a AS w1, x.b AS w2, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: {a: w[i], b: w[i + 1]})) AS x
    FROM w) GROUP BY ALL HAVING f >= 10),
f3 AS (
  SELECT lang, x.a AS w1, x.b AS w2, x.c AS w3, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {a: w[i], b: w[i + 1], c: w[i + 2]})) AS x
    FROM w) GROUP BY ALL HAVING f >= 10),
c AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l USING (lang, w1) JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 x WHERE x.lang = c.lang AND 100 * x.f >= 50 * c.f
    AND x.w1 = c.w1 AND x.w2 = c.w2)
    AND NOT EXISTS (SELECT 1 FROM f3 x WHERE x.lang = c.lang AND 100 * x.f >= 50 * c.f
    AND x.w2 = c.w1 AND x.w3 = c.w2)
  UNION ALL
  SELECT lang, w1 || ' ' || c.w2 || ' ' || w3, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l USING (lang, w1) JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || c.w3, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l USING (lang, w1, w2) JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3),
s AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER q AS rank, phrase, a, l, r, n, score FROM s JOIN t USING (lang)
WINDOW q AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER q <= 2000
""",
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
s AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 END
            + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 8 AS chars,
         lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                  FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(coalesce(CASE role WHEN 'system' THEN before IS NULL
                              WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                              WHEN 'assistant' THEN before = 'user' END, false)
           AND (NOT last OR role = 'assistant')) AS valid
FROM s GROUP BY conv_id
""",
    "op5_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op2_url_filter": """
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
""",
}
