"""The registered queries of this package: one thin query per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import align, decontaminate, embedding_dedup, filter_audit, langid, licenses, line_dedup, lm_score, minhash_dedup, packing, quality, toxicity, warc
from tidewheel.llm._store import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 85 of 100: (doc_id, n_shingles, component_id, kept) per document."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_quality, p_toxic, toxic) per document."""
    return toxicity.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["quality", "toxic"], target="toxic")


@query
def op10_line_edit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, n_chars, rep_doc_id, rep_line_no) per line that repeats an earlier one within two edits."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


@query
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, consistency) per benchmark item a document holds."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece, sequences of 2048 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_pivot_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector at a cosine of 0.9."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def remainder(by: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


@query
def op8_viterbi_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(remainder(4) != 2))
    return langid.label(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, warc.archive_folder(pages))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, ...) per document."""
    return lm_score.score(table(spark, sf_dir, "documents"), remainder(5) != 1)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, own_license, cosine, license, inherited_from) per document.

    A document lies in the folder source, source/thousand or
    source/thousand/language, by its id; one that ends with its license
    statement speaks for its folder.
    """
    level = F.pmod("doc_id", F.lit(3))
    path = F.concat_ws("/", "source", F.when(level > 0, F.floor(F.col("doc_id") / 1000).cast("string")), F.when(level > 1, F.col("lang")),
                       F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), id_col="doc_id", path=path, license_file=F.col("last"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): five filters in all 120 orders."""
    tallies = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    masks = filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tallies)
    return filter_audit.audit(masks, list("ABCDE"), list(tallies), F.col("part"))


@query
def op12_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document, learned from labels of those not held out."""
    rows = quality.with_statistics(table(spark, sf_dir, "documents"))
    model = quality.learn(rows.filter(remainder(5) != 0), table(spark, sf_dir, "labels"), F.col("quality"))
    held_out = F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out")
    return quality.score(rows, model).select("doc_id", held_out, "score", "predicted")


@query
def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps) per document."""
    return align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_TEMPLATE_ROWS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(licenses.TEMPLATES))
_TERMS = "regexp_extract_all(lower({0}), '[a-z0-9]+')".format
SQL["op4_license_scan"] = f"""
WITH templates(template, license, text) AS (VALUES {_TEMPLATE_ROWS}),
size AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((n + 1.0) / (count(*) + 1)) + 1 AS idf FROM (
          SELECT unnest(list_distinct({_TERMS("text")})) AS term FROM documents), size GROUP BY term, n),
tf AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_TERMS("text")}) AS term FROM templates) GROUP BY ALL),
w AS (SELECT template, license, term, tf * coalesce(idf, ln(n + 1.0) + 1) AS w FROM tf LEFT JOIN idf USING (term), size),
unit AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM w),
files AS (SELECT doc_id, text, regexp_replace(text, '{licenses.COPYRIGHT}', chr(10), 'g') AS kept,
            concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN CAST(CAST(floor(doc_id / 1000.0) AS BIGINT) AS VARCHAR) END,
                      CASE WHEN doc_id % 3 > 1 THEN lang END, CAST(doc_id AS VARCHAR)) AS path FROM documents),
split AS (SELECT doc_id, 0 AS kind, string_split(text, chr(10)) AS pieces FROM files
          UNION ALL SELECT doc_id, 1, string_split_regex(kept, '{licenses.BLANK}') FROM files
          UNION ALL SELECT doc_id, 2, [kept] FROM files),
each AS (SELECT doc_id, kind, len(pieces) AS n, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM split),
units AS (SELECT doc_id, kind, pos, pos = n - 1 AS last, {_TERMS("piece")} AS words FROM each),
longest AS (SELECT max(len({_TERMS("text")})) * {licenses.LENGTH} AS most FROM templates),
counted AS (SELECT doc_id, kind, pos, last, term, count(*) AS tf FROM (
              SELECT doc_id, kind, pos, last, unnest(words) AS term FROM units, longest WHERE len(words) <= most) GROUP BY ALL),
weighed AS (SELECT doc_id, kind, pos, last, term, tf * idf AS w FROM counted JOIN idf USING (term)),
norms AS (SELECT doc_id, kind, pos, last, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT doc_id, kind, pos, template, license, sum(w * weight) AS dot FROM weighed JOIN unit USING (term) GROUP BY ALL),
best AS (SELECT doc_id, kind, pos, last, license, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (doc_id, kind, pos)
         WHERE round(dot / norm, 6) >= {licenses.COSINE}),
own AS (SELECT doc_id, license AS own_license, cosine, last FROM best
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, kind DESC, pos, license) = 1),
placed AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS dir, own_license, cosine, last FROM files f LEFT JOIN own USING (doc_id)),
licensed AS (SELECT dir AS src, own_license AS given FROM (SELECT dir, own_license, count(*) AS n FROM placed WHERE last GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, own_license) = 1),
nearest AS (SELECT p.dir, src, given FROM (SELECT DISTINCT dir FROM placed) p JOIN licensed ON p.dir = src OR starts_with(p.dir, src || '/')
            QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(src) DESC) = 1)
SELECT doc_id, path, own_license, cosine, coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN src END AS inherited_from
FROM placed LEFT JOIN nearest USING (dir)"""


def _base32(digest: str) -> str:
    """DuckDB's hexadecimal SHA-1 as base32: 20 bits make four letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return " || ".join(f"substr({letters}, 1 + ((CAST('0x' || substr({digest}, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31), 1)"
                       for k in range(8) for s in (15, 10, 5, 0))


SQL["op7_dictionary_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, payload_bytes, {_base32('d')} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

SQL["op5_pivot_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)"""

SQL["op11_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT w.part, len(words) < 200 AS "A", 100 * len(list_distinct(words)) < 50 * len(words) AS "B",
                 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * length(w.text) AS "C", regexp_matches(w.text, '[#$%&*|]') AS "D",
                 coalesce(w.doc_id > first, false) AS "E", coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM w JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = w.doc_id),
n AS (SELECT *, count(*) AS n FROM flags GROUP BY ALL),
long AS (SELECT row_number() OVER () AS row, * FROM n),
fails AS (SELECT row, unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([CAST("A" AS INTEGER), CAST("B" AS INTEGER), CAST("C" AS INTEGER), CAST("D" AS INTEGER), CAST("E" AS INTEGER)]) AS x FROM long),
alone AS (SELECT row, sum(x) AS total FROM fails GROUP BY row),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
placed AS (SELECT filter_order, step, steps.f, row, x, total, coalesce(max(x) OVER (PARTITION BY filter_order, row ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM steps JOIN fails ON fails.f = steps.f JOIN alone USING (row)),
counted AS (SELECT part, filter_order, step, placed.f, CAST(sum(n * (1 - greatest(x, before))) AS BIGINT) AS kept, CAST(sum(n * x * (1 - before)) AS BIGINT) AS removed,
                   CAST(sum(n * x * before) AS BIGINT) AS redundant, CAST(sum(CASE WHEN total = 1 THEN n * x ELSE 0 END) AS BIGINT) AS unique_fails,
                   CAST(sum(n * x * (1 - before) * good) AS BIGINT) AS good_lost, CAST(sum(n * x * (1 - before) * toxic) AS BIGINT) AS toxic_lost
            FROM placed JOIN long USING (row) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted"""
