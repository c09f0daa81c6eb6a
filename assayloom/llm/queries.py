"""The registered queries of the corpus operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, embedding_dedup, filter_audit, html, language, lexical_search, minhash, mixing, pieces, quality, secrets, token_counts, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


#: op2: three-word shingles at 0.85; 26 bands of 5 miss a pair at 0.85 with a chance of 3e-7.
OP2_BANDING = minhash.Banding(shingle=3, percent=85, bands=26, rows=5)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), banding=OP2_BANDING)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages), keep=("page_id", "url"))


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encoded_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_by_id(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_sampling": op1_sentencepiece_sampling,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_html_text": op3_html_text,
    "op4_ann_search": op4_ann_search,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_output": op9_token_output,
    "op10_secret_scan": op10_secret_scan,
    "op11_language_id": op11_language_id,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical_search": op13_lexical_search,
}

#: The smallest id reachable over links (a, b) from each node of `nodes` (id).
_CLOSURE = "reach AS (SELECT id AS node, id AS c FROM nodes UNION SELECT l.a, r.c FROM reach r JOIN links l ON l.b = r.node), comp AS (SELECT node, MIN(c) AS c FROM reach GROUP BY 1)"
ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: hash(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END) AS h FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS n_both FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT doc_id AS id FROM documents), {_CLOSURE}
SELECT doc_id, COALESCE(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents JOIN comp ON node = doc_id LEFT JOIN n USING (doc_id)""",
    "op5_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_CLOSURE}
SELECT vec_id, (SELECT COUNT(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN comp ON node = vec_id""",
    "op12_filter_audit": """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
least_id AS (SELECT t, MIN(doc_id) AS first FROM d GROUP BY 1),
m AS (SELECT d.doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS f,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS bad FROM d JOIN least_id USING (t)),
five AS (SELECT UNNEST(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS p FROM five a, five b, five c, five e, five g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: 'ABCDE'[i]), '') AS filter_order, i AS step, p[i] AS x, p[1 : i - 1] AS before FROM o, five),
c AS (SELECT part, f, COUNT(*) AS n, COUNT(*) FILTER (WHERE good) AS g, COUNT(*) FILTER (WHERE bad) AS b FROM m GROUP BY 1, 2),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
  SUM(CASE WHEN NOT f[x] AND NOT list_bool_or([false] || list_transform(before, lambda i: f[i])) THEN n ELSE 0 END)::BIGINT AS kept,
  SUM(CASE WHEN f[x] AND NOT list_bool_or([false] || list_transform(before, lambda i: f[i])) THEN n ELSE 0 END)::BIGINT AS removed,
  SUM(CASE WHEN f[x] AND list_bool_or([false] || list_transform(before, lambda i: f[i])) THEN n ELSE 0 END)::BIGINT AS redundant,
  SUM(CASE WHEN f[x] AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  SUM(CASE WHEN f[x] AND NOT list_bool_or([false] || list_transform(before, lambda i: f[i])) THEN g ELSE 0 END)::BIGINT AS good_lost,
  SUM(CASE WHEN f[x] AND NOT list_bool_or([false] || list_transform(before, lambda i: f[i])) THEN b ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r""",
    "op13_lexical_search": """WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
a AS (SELECT COUNT(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(SUM(len(ts)) AS BIGINT) AS n_terms FROM t),
p AS (SELECT doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * n_docs) // n_terms AS m, UNNEST(ts) AS term FROM t, a),
f AS (SELECT doc_id, m, term, COUNT(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, COUNT(*) AS df FROM f GROUP BY 1), a),
q AS (SELECT item_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
