"""Registered queries of the text operators and the SQL that checks them where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import auction, chat, forest, language, minhash, mixing, ngram_lm, packing, pieces, sitestyle, suffixes, topk, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_harmonic_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.harmonic_pack(table(spark, sf_dir, "documents"), tokenizer_path(), remembered=500_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


MIX_SQL = r"""WITH RECURSIVE d AS (
SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, [1.0, 2.0, 3.0][1 + CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY source),
-- reshare the excess until nobody is above the stop
r(round, source, source_size, w, stopped) AS (
  SELECT 0, source, source_size, w, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, stopped OR w * (sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ())
      / nullif(sum(CASE WHEN stopped THEN 0 ELSE w END) OVER (), 0) > 3 * source_size
  FROM r WHERE round < (SELECT count(*) FROM s)),
e AS (SELECT * FROM r WHERE round = (SELECT max(round) FROM r)),
t AS (SELECT source, source_size, CASE WHEN stopped THEN 3 * source_size ELSE w * (sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN stopped THEN 0 ELSE w END) OVER (), 0) END AS target FROM e),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(size) OVER (PARTITION BY d.source, h) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN rest > 0 AND 2 * upto - here <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""


@query("op2_source_mixing", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), "taken")


TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(embedding) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op8_exact_topk", TOPK_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.exact_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.select("doc_id", "text", "lang").where(~language.held_out()))
    guessed = language.predict(docs.select("doc_id", "text"), model)
    return guessed.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op7_minhash_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_repeated_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("words").alias("n_words"), F.col("later").alias("removable"))


@query("op3_embedding_near_duplicates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitestyle.extract(table(spark, sf_dir, "pages"))


LM_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT w3, count(*) AS c FROM t GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS c FROM t WHERE i > 1 GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM t WHERE i > 2 GROUP BY ALL),
s AS (SELECT r, CASE WHEN c3.c >= 2 THEN ln(c3.c / p2.c) WHEN c2.c >= 2 THEN ln(c2.c / p1.c) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(c1.c / n.n) + least(i - 1, 2) * ln(0.4) END AS v,
  CASE WHEN c3.c >= 2 THEN 3 WHEN c2.c >= 2 THEN 2 ELSE 1 END AS o
  FROM t CROSS JOIN n JOIN c1 ON t.w3 = c1.w3 LEFT JOIN c2 ON t.w2 = c2.w2 AND t.w3 = c2.w3
  LEFT JOIN c3 ON t.w1 = c3.w1 AND t.w2 = c3.w2 AND t.w3 = c3.w3 LEFT JOIN c1 p1 ON t.w2 = p1.w3
  LEFT JOIN c2 p2 ON t.w1 = p2.w2 AND t.w2 = p2.w3)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(sum(v), 0), 4) AS log_score,
  count(*) FILTER (o = 1) AS by_one, count(*) FILTER (o = 2) AS by_two, count(*) FILTER (o = 3) AS by_three
FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r, d.doc_id, d.w"""


@query("op4_backoff_scores", LM_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_lm.score(table(spark, sf_dir, "documents"))
    hits = [F.get("hits", F.lit(i)).alias(n) for i, n in enumerate(("by_one", "by_two", "by_three"))]
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), *hits)


@query("op6_chat_repair")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))



STRUCTURE_SQL = r"""WITH RECURSIVE
t256 AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind FROM raw CROSS JOIN t256),
turns AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] WHEN kind = 0 THEN [] ELSE [1] END) AS copy FROM kinds)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i FROM turns),
seen AS (SELECT *, substr(role, 1, 1) AS r, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS shown,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM placed),
rows_ AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN again THEN 'd' WHEN shown NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (r0 IS NOT NULL AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
-- from the last turn back: the cheapest (cost, letters) with nothing, a system, a user or an assistant turn before
best AS (
  SELECT conv_id, n AS i, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] AS s FROM counts
  UNION ALL
  SELECT conv_id, i - 1, [list_min([x[q], {'c': x[nx[q]].c + 2, 'a': 'I' || x[nx[q]].a}, {'c': x[nx[nx[q]]].c + 4, 'a': 'II' || x[nx[nx[q]]].a}]) for q in [1, 2, 3, 4]]
  FROM (SELECT conv_id, i, nx, [list_min([{'c': s[q].c + 3, 'a': 'D' || s[q].a},
      {'c': CASE WHEN gone OR nxk[q] = 0 THEN 1000000000 ELSE s[greatest(nxk[q], 1)].c + late END, 'a': 'K' || s[greatest(nxk[q], 1)].a},
      {'c': CASE WHEN gone THEN 1000000000 ELSE s[nx[q]].c + 2 + late END, 'a': 'R' || s[nx[q]].a}]) for q in [1, 2, 3, 4]] AS x
    FROM (SELECT b.conv_id, b.i, b.s, [3, 3, 4, 3] AS nx, w.fault IN ('b', 'd') AS gone, CASE WHEN w.fault = 't' THEN 1 ELSE 0 END AS late,
        CASE w.r WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS nxk
      FROM best b JOIN rows_ w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i))),
done AS (SELECT conv_id, s[1].c AS cost, s[1].a AS audit FROM best WHERE i = 0),
letters AS (SELECT conv_id, audit, p, substr(audit, CAST(p AS INTEGER), 1) AS e, length(regexp_replace(substr(audit, 1, CAST(p AS INTEGER)), 'I', '', 'g')) AS i,
  length(regexp_replace(substr(audit, 1, CAST(p AS INTEGER)), 'D', '', 'g')) AS k FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM done)),
heads AS (SELECT l.conv_id FROM letters l JOIN rows_ w ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i WHERE l.e = 'K' AND l.k = 1 AND w.r = 's'),
lines AS (SELECT l.conv_id, l.p, CASE WHEN e = 'K' THEN w.role WHEN (k - CASE WHEN EXISTS (SELECT 1 FROM heads h WHERE h.conv_id IS NOT DISTINCT FROM l.conv_id) THEN 1 ELSE 0 END) % 2 = 1
    THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE w.text END AS line
  FROM letters l LEFT JOIN rows_ w ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i AND l.e <> 'I' WHERE e <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM lines GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op11_conversation_repair", STRUCTURE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = auction.repair(auction.damage(table(spark, sf_dir, "conversations")), "id", live=F.col("live"))
    return found.withColumnRenamed("id", "conv_id")


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model_path())
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
