"""Catalogue entries of the text operators: thin queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm import (decontam, embed_dedup, html_extract, langid, line_dedup, lm, packing, simhash, token_count, token_files,
                           toxicity, vector_codes, whitening)
from facsimile.llm.common import is_fold
from facsimile.session import scratch_path

#: Tokenizer files; their place is public_tokenizers.path(name).
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
CAPACITY = 4096
WINDOW = 10
MIN_COSINE = 0.95


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(mod: int, fold: int):
    return is_fold(F.col("doc_id"), mod, fold)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the fold crc32 mod 4 = 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~_fold(4, 2)))
    out = langid.predict(docs.select("doc_id", _fold(4, 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.fit(pages)).select("page_id", "url", "text", "n_chars")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram pieces of every document under the scores of a public vocabulary."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = token_count.Vocabulary.from_sentencepiece(public_tokenizers.path(PIECES))
    return token_count.count_tokens(docs, vocab).select("doc_id", "n_tokens", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash class of every document: three-word shingles, two bits."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=3, max_bits=2)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, read back from the written files."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "token_files")
    token_files.write_ids(docs, path, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_files.read_ids(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector at a cosine of 0.95."""
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), MIN_COSINE)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = packing.pack(docs, public_tokenizers.path(WORD_BPE), end_id=1, capacity=CAPACITY)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         "sequence_id", "offset")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learned outside the fold crc32 mod 7 = 2."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", _fold(7, 2).alias("held_out"))
    return lm.score(docs, "held_out", stable=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words of benchmark items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"), WINDOW)
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the fold crc32 mod 5 = 0."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~_fold(5, 0))
    model = toxicity.fit(docs.where(~_fold(5, 0)), labels)
    out = toxicity.predict(docs.select("doc_id", _fold(5, 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped that five documents or more repeat, and a digest of the rest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=5, min_chars=40).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector, at most 32 of them."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors, components=32))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector: four parts of 256 entries, four rounds."""
    return vector_codes.quantise(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents table."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_SQL_OP6 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

_SQL_OP9 = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
size AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM i WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, s.n, array_to_string(i.w[p:p + s.n - 1], ' ') AS win
  FROM i JOIN size s ON s.n = least(len(i.w), {WINDOW}), unnest(range(1, len(i.w) - s.n + 2)) AS t(p)),
dw AS (
  SELECT doc_id, s.n, p, array_to_string(d.w[p:p + s.n - 1], ' ') AS win
  FROM d JOIN size s ON len(d.w) >= s.n, unnest(range(1, len(d.w) - s.n + 2)) AS t(p)),
hit AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.win = dw.win),
word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(word.n_hit, 0)::BIGINT AS n_hit,
  coalesce(item.n_items, 0)::BIGINT AS n_items, sha256(coalesce(item.ids, '')) AS items_sha256,
  coalesce(word.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word ON word.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""


_SQL_OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, p, lines[p] AS line FROM d, unnest(range(1, len(lines) + 1)) AS t(p)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (
  SELECT key, max(doc_id) AS last_id FROM (SELECT DISTINCT r, doc_id, key FROM k WHERE length(key) >= 40)
  GROUP BY key HAVING count(*) >= 5),
m AS (SELECT k.r, k.p, k.line, o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.last_id AS gone
      FROM k LEFT JOIN often o ON o.key = k.key)
SELECT any_value(d.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d ON d.r = m.r GROUP BY m.r
"""


def _sql_op13(codes: int = 256, rounds: int = 4) -> str:
    """The rounds of the codebooks written out one after the other."""
    ctes = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """p AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(x) // 4) AS part, (i - 1) % (len(x) // 4) AS pos, x[i] AS val FROM v, unnest(range(1, len(x) + 1)) AS t(i))""",
        f"""b0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, pos, val FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM v) USING (vec_id)
  WHERE r <= {codes})"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(dist * {codes} + entry) AS best FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.val - b.val) * (p.val - b.val))::BIGINT AS dist
    FROM p JOIN b{k} b ON b.part = p.part AND b.pos = p.pos GROUP BY p.vec_id, p.part, b.entry) GROUP BY vec_id, part)""")
        if k < rounds:
            ctes.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.val, b.val) AS val FROM b{k} b LEFT JOIN (
    SELECT p.part, a.best % {codes} AS entry, p.pos, floor(sum(p.val) / count(*))::BIGINT AS val
    FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY p.part, a.best % {codes}, p.pos) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    ctes.append(f"""c AS (
  SELECT vec_id, string_agg(lpad(to_hex(best % {codes}), 2, '0'), '' ORDER BY part) AS code, sum(best // {codes})::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT c.vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN v ON v.vec_id = c.vec_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    own = (op1_language_id, op2_html_extraction, op3_token_counts, op4_simhash, op5_token_files, op6_embedding_dedup,
           op7_best_fit_packing, op8_lm_scores, op9_decontamination, op10_toxicity, op11_line_dedup,
           op12_embedding_whitening, op13_vector_codes, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB twins of the queries that SQL can say."""
    import corpus_pipeline
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {"op6_embedding_dedup": _SQL_OP6, "op9_decontamination": _SQL_OP9, "op11_line_dedup": _SQL_OP11,
            "op13_vector_codes": _sql_op13()} | whole
