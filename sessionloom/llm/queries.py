"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionloom.llm import bpe_heap, bpe_matrix, collocations, decontaminate, html_text, jaccard_join, language_model, line_dedup, neighbours, periodic_runs, quality, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of all documents by one random order; law ``rows``.

    Whole documents are shuffled; size and digest are taken from the shuffled records.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    docs = table(spark, sf_dir, "documents").withColumn("size", size)
    return sharding.shuffle_shards(docs, 40, size="size").select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_heap.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.score(table(spark, sf_dir, "documents"), held_out)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_matrix.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page, with their blocks."""
    records = warc.responses(table(spark, sf_dir, "pages"))
    return warc.derivatives(records, "page_id", "long")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents; a tenth of them, chosen by the checksum of the id, has its words made periodic first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("a", F.when(F.size("words") > 0, F.expr("g % size(words)")))
    docs = docs.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    looped = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    found = periodic_runs.with_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text")))

    def first_by_exponent(x, y):
        mine, other = x["length"] * y["period"], y["length"] * x["period"]
        tie = F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).otherwise(1))
        return F.when(mine > other, -1).when(mine < other, 1).otherwise(tie)

    best = F.get(F.array_sort("runs", first_by_exponent), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: batches in which a table's files are added
LINE_BATCHES = 6


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.drop_common(docs, line_dedup.batches_of(docs, LINE_BATCHES))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_neighbours": op6_neighbours,
    "op7_html_text": op7_html_text,
    "op8_language_model": op8_language_model,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_collocations": op13_collocations,
}

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES: dict[str, str] = {
    "op3_jaccard_join": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS meet FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * meet >= 85 * (a.n + b.n - meet)
        ), edges AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach(x, y) AS (
            SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
        )
        SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(y), d.doc_id)) AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id
    """,
    "op5_decontamination": rf"""
        WITH dw AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), bw AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), item_windows AS (
            SELECT item_id, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p, w FROM bw WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS words FROM item_windows
        ), doc_windows AS (
            SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM dw, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
        ), hits AS (
            SELECT d.doc_id, d.p, d.k, i.item_id
            FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS words FROM doc_windows) d
            JOIN windows i ON i.k = d.k AND i.words = d.words
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
        )
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items i USING (doc_id)
    """,
    "op12_line_dedup": rf"""
        WITH d AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d
        ), k AS (
            SELECT doc_id, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {LOWER}) AS key FROM l
        ), common AS (
            SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN common c ON c.key = k.key GROUP BY k.doc_id
    """,
    "op13_collocations": rf"""
        WITH pieces AS (
            SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
            FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {LOWER}) AS t FROM documents)
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), f AS (
            SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)
            GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30
        ), cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')
        ), weakest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
        ), inside AS (
            SELECT lang, array_to_string(ws[p:p + m - 1], ' ') AS phrase, max(f) AS held
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS p FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2
        ), ranked AS (
            SELECT x.lang, x.phrase, a, l, r, score, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
            FROM weakest x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase WHERE held IS NULL OR 100 * held < 80 * a
        )
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
