"""The registered queries of this folder, and the SQL of those that SQL expresses."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assay.llm import bpe, collocations, conversation_repair, exact_dedup, jaccard_join, language_id, main_text, near_dups, packing, repeated_passages, token_output, topk, urls
from assay.sources.tables import read_table

#: Vocabularies of the registered queries; operators take any path.
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.repeat_digest(read_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_windows(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read_table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(read_table(spark, sf_dir, "pages"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digest(conversation_repair.damaged(read_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_exact_dedup, op3_language_id, op4_substring_dedup,
                                   op5_url_filter, op6_packing, op7_token_output, op8_jaccard_join, op9_top_k, op10_main_text, op11_minhash, op12_collocations,
                                   op13_conversation_repair)}

#: A-Z lower-cased, as the operators compare texts.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP_SQL = f"""
WITH t AS (SELECT doc_id, {LOWER} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def groups_sql(n: int, kept: str) -> str:
    """Groups of documents linked by their runs of n words."""
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS g FROM t),
     z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
           JOIN z x ON x.doc_id = a.doc_id JOIN z y ON y.doc_id = b.doc_id
           WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
           GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
     l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
     r(doc_id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT t.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id{kept}
FROM t LEFT JOIN z ON z.doc_id = t.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = t.doc_id"""


COLLOCATIONS_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
     s AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM w),
     g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM s),
     f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY lang, m, g),
     n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
     c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
     k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
     h AS (SELECT k.lang, k.g, k.a, k.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
           FROM k JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.g = array_to_string(k.w[1:k.k], ' ')
                  JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.g = array_to_string(k.w[k.k + 1:], ' ')),
     b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
     i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda z: list_transform(range(1, m - z + 2), lambda j: array_to_string(w[j:j + z - 1], ' '))))) AS g
           FROM c WHERE m > 2),
     j AS (SELECT lang, g, max(a) AS longer FROM i GROUP BY lang, g),
     o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
           FROM b LEFT JOIN j ON j.lang = b.lang AND j.g = b.g WHERE j.longer IS NULL OR 100 * j.longer < 80 * b.a)
SELECT o.lang, o.rank, o.g AS phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000"""


ORACLE_SQL = {"op2_exact_dedup": EXACT_DEDUP_SQL, "op9_top_k": TOP_K_SQL,
              "op8_jaccard_join": groups_sql(5, ""),
              "op12_collocations": COLLOCATIONS_SQL,
              "op11_minhash": groups_sql(2, ", t.doc_id = c.component_id AS kept")}
