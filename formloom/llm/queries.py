"""Registered queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import (
    bpe, centroids, chat_format, embedding_dedup, exact_dedup, language_id, ngram_join, packing, piece_bpe, sharding,
    token_counts, url_reputation, whitening,
)
from formloom.session import local_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@register(
    "op4_exact_dedup",
    sql=r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256
    FROM (SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY points DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY s) AS group_size FROM n) x""",
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).drop("n_chunks")


@register("op8_lpt_shards")
def op8_lpt_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@register(
    "op9_chat_format",
    sql=r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS et,
        regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') AS er FROM c)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
      CAST(sum(length(er) + length(et) + 20) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id""",
)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = local_table(
        spark, [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string"
    )
    formatted = chat_format.format_conversations(chat_format.log_of_rows(rows.unionByName(planted)))
    read = formatted.select(
        "conv_id", "formatted",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss(F.col("segments")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_LEVEL_SQL = r"""
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL AND quality IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    h0 AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS x,
        regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p LEFT JOIN o ON o.doc_id = p.page_id GROUP BY host),
    h AS (SELECT host, n, x, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') AS domain, string_split(bare, '.')[-1] AS suffix FROM h0),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY domain, suffix),
    s AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY suffix),
    t AS (SELECT (sum(x) + 1.0) / (sum(n) + 2.0) AS m FROM s),
    ks AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 1.0 ELSE 1.0 / least(greatest((sum(pow(x - n * m, 2)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.999) - 1.0 END AS k FROM s, t),
    ds AS (SELECT d.*, (s.x + k * t.m) / (s.n + k) AS m FROM d JOIN s USING (suffix), t, ks),
    kd AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 1.0 ELSE 1.0 / least(greatest((sum(pow(x - n * m, 2)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.999) - 1.0 END AS k FROM ds),
    hd AS (SELECT h.host, h.n, h.x, (ds.x + k * ds.m) / (ds.n + k) AS m FROM h JOIN ds USING (domain), kd),
    kh AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 1.0 ELSE 1.0 / least(greatest((sum(pow(x - n * m, 2)) - sum(n * m * (1 - m))) / sum(n * (n - 1) * m * (1 - m)), 0.001), 0.999) - 1.0 END AS k FROM hd),
    r AS (SELECT host, (x + k * m) / (n + k) AS rate, n + k + 1 AS w FROM hd, kh)
    SELECT page_id, p.host, path, rule,
      CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
        ELSE CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / w) > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
    FROM (SELECT *, CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p) p JOIN r ON r.host = p.host"""


@register("op10_url_reputation", sql=_LEVEL_SQL)
def op10_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = url_reputation.page_outcomes(table(spark, folder, "labels"))
    judged = url_reputation.judge_urls(table(spark, folder, "pages"), outcomes)
    return judged.drop("bad_rate", "lower_bound")


WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Place of a public tokenizer file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_forced_boundary_bpe")
def op1_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    coded = bpe.round_trip(table(spark, folder, "documents"), path, keep=["doc_id"])
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op3_sum_of_squares_packing")
def op3_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack_texts(table(spark, folder, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


MAX_TOKENS = 2048


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


@register("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    # Only the text goes into a prediction.
    predicted = language_id.predict(docs.select("doc_id", "text"), learned, keep=["doc_id"])
    return predicted.select(
        F.col("row.doc_id").alias("doc_id"), language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


@register("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, folder, "documents")).drop("class_id")


@register("op2_nn_descent_dedup")
def op2_nn_descent_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


PIECE_BPE = "piece_bpe_32k.model"


@register("op11_offset_piece_bpe")
def op11_offset_piece_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = piece_bpe.encode(
        table(spark, folder, "documents"), tokenizer_path(PIECE_BPE), add_end=True, keep=["doc_id"], made=("ids", "ends", "decoded")
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).alias("covered_bytes"),
    )


@register("op12_cholesky_jacobi_whitening")
def op12_cholesky_jacobi_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """Common table expressions of the rounds, from centroids c0 and vectors v to the last assignment."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT rid, min(struct_pack(d := d, c := c)) AS best FROM (
            SELECT rid, c, CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
            FROM v, c{i}) y GROUP BY rid)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, pos, CAST(floor_of(sum(val), count(*)) AS BIGINT) AS val FROM (
                SELECT best.c AS c, unnest(x) AS val, unnest(range(len(x))) AS pos FROM a{i} JOIN v USING (rid)) z GROUP BY c, pos),
            c{i + 1} AS (SELECT c{i}.c AS c, coalesce(n.m, c{i}.m) AS m FROM c{i}
                LEFT JOIN (SELECT c, list(val ORDER BY pos) AS m FROM s{i} GROUP BY c) n ON n.c = c{i}.c)""")
    made = ", ".join(parts)
    return made.replace("floor_of(sum(val), count(*))", "(sum(val) - ((sum(val) % count(*)) + count(*)) % count(*)) // count(*)")


@register(
    "op13_geometric_centroids",
    sql=f"""
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x AS m
        FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 16) f),
    {_rounds_sql(3)},
    t AS (SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS total FROM a3 GROUP BY best.c)
    SELECT vec_id, a3.best.c AS cluster, a3.best.d AS distance, t.total AS cluster_inertia,
        (SELECT CAST(sum(total) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(c3.m, ',')) AS centroid_sha256
    FROM a3 JOIN v USING (rid) JOIN t ON t.c = a3.best.c JOIN c3 ON c3.c = a3.best.c""",
)
def op13_geometric_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"))
