"""The operators over the shared test tables, one query each, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html_extract, jaccard_join, line_dedup, mixing, secret_scan, token_output, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary of 50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def held_out(doc_id: str) -> Column:
    """Whether a document's labels must not be learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokenize_and_read(_table(spark, sf_dir, "documents"), tokenizer_path(), added_tokens=True)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.linked_documents(docs, words=4, percent=85).drop("class_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    c = F.col("contamination")
    scored = decontaminate.contaminate_columns(docs, _table(spark, sf_dir, "benchmark"), window=10)
    return scored.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: Rules by host and path.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = secret_scan.fit(secret_scan.made_findings(spark))
    return secret_scan.scan(docs, model).select("doc_id", "ordinal", "candidate", "score", "is_secret")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, quantiser = ann.build(_table(spark, sf_dir, "embeddings"))
    queries = index.where(F.col("id") % 100 == 0).select("id", "vector")
    return ann.search(index, quantiser, queries, k=10)


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_toxicity": op2_toxicity,
    "op3_token_output": op3_token_output,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_secret_scan": op9_secret_scan,
    "op10_ann": op10_ann,
}

_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES = {
    "op4_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM parts),
        keyed AS (SELECT *, {_LOWERED.format(f"trim(line, {_STRIP})")} AS key FROM lines),
        common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id""",
    "op6_decontaminate": rf"""
        WITH items AS (SELECT item_id, regexp_extract_all({_LOWERED.format("text")}, '{_ALNUM}') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
        docs AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED.format("text")}, '{_ALNUM}'), []) AS w FROM documents),
        places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, win)),
        marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size)::DOUBLE AS ceiling,
                1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, ceiling / weight AS ratio,
                (sum(source_size) OVER () - coalesce(sum(ceiling) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
            FROM sources WINDOW o AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        water AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
        aims AS (
            SELECT source, source_size, least(ceiling, water.level * weight) AS target,
                CASE WHEN source_size > 0 THEN floor(least(ceiling, water.level * weight) / source_size)::BIGINT ELSE 0 END AS times
            FROM levels, water),
        ordered AS (
            SELECT s.*, a.source_size, a.target, a.times, sum(size) OVER (PARTITION BY s.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY s.source, place) AS own
            FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
        SELECT doc_id, size, source_size, target,
            (size * (times + CASE WHEN upto - own / 2.0 <= target - times * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM ordered""",
}
