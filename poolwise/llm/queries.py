"""The queries of these operators and their expected SQL, for the driver's entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwise.llm import (
    common, conversations, dac, exact_dedup, jaccard, mixing, neighbours, packing, secrets, sharding, spelling, substrings,
    tokens, toxicity)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(common.documents(spark, sf_dir))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_ids(dac.write_ids(common.documents(spark, sf_dir)), with_ids=False)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(common.documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.documents(spark, sf_dir)).drop("found")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.rated(common.documents(spark, sf_dir))
    return rows.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(common.documents(spark, sf_dir)).drop("file", "row")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut, repeated or given to the user, by the hash of their id and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(F.coalesce("text", F.lit(" ")), "[.!?]", ""))
            .otherwise(F.coalesce("text", F.lit(" "))))
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = conversations.Repair(damaged(rows)).conversations().withColumnRenamed("conv_id", "of")
    figures = [c for c in repaired.columns if c != "of"]
    without = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    joined = rows.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.select("conv_id", *[F.coalesce(F.col(c), without.get(c, F.lit(0).cast("long"))).alias(c) for c in figures])


def spelled_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least 7 letters that occur twice, after some have lost a letter by the hash of the
    document's id and the word."""
    runs = F.regexp_extract_all(exact_dedup.normal(F.col("text")), F.lit("[a-z\u00C0-\u00FF]{7,}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    hashed = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("run")))
    rows = rows.select("run", hashed.alias("h"), (hashed % F.length("run")).cast("int").alias("at"))
    shorter = F.concat(F.left("run", F.col("at")), F.substr("run", F.col("at") + 2))
    words = rows.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= 7).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelled_words(common.documents(spark, sf_dir)))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_token_counts, op2_nearest_neighbours, op3_token_ids, op4_ngram_jaccard_join, op5_toxicity, op6_secrets,
             op7_best_fit_packing, op8_source_mixing, op9_sharding, op10_exact_dedup, op11_conversation_repair, op12_spelling_variants, op13_substring_dedup, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op12_spelling_variants": r"""
            WITH RECURSIVE crc AS (
                SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
            ), runs AS (
                SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
            ), long AS (SELECT DISTINCT doc_id, run, hex(concat(coalesce(doc_id::VARCHAR, 'null'), ':', run)) AS h FROM runs WHERE length(run) >= 7),
            hashed AS (
                SELECT doc_id, run, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2),
                       lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS h
                FROM long, crc
            ), words AS (
                SELECT word, count(*) AS n FROM (
                    SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2))
                           ELSE run END AS word
                    FROM runs JOIN hashed USING (run) WHERE runs.doc_id IS NOT DISTINCT FROM hashed.doc_id)
                WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
            ), cuts AS (
                SELECT word, n, i, concat(substr(word, 1, i::INT - 1), substr(word, i::INT + 1)) AS cut
                FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
            ), near AS (
                -- A replaced letter leaves equal rests at one place; an inserted one leaves the other word.
                SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
                UNION ALL SELECT DISTINCT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
                UNION ALL SELECT DISTINCT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
            ), best AS (
                SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r FROM near
            ), formed AS (
                SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
                       CASE WHEN m >= 10 * w.n THEN m END AS form_n
                FROM words w LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.word = w.word
            ), path AS (
                SELECT word, word AS here, form AS next FROM formed
                UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN formed f ON f.word = p.next
            )
            SELECT f.word, f.form, p.here AS root, f.n, f.n_near, f.form_n FROM formed f JOIN path p ON p.word = f.word AND p.next IS NULL""",
        "op13_substring_dedup": r"""
            WITH d AS (
                SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), windows AS (
                SELECT id, doc_id, i, array_to_string(w[i:i + 49], ' ') AS t FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS i FROM d)
            ), repeated AS (
                SELECT id, i FROM (SELECT id, i, doc_id, min(doc_id) OVER (PARTITION BY t) AS least FROM windows) WHERE doc_id > least
            ), words AS (
                SELECT x.id, x.p, x.word, count(r.i) OVER (PARTITION BY x.id ORDER BY x.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
                FROM (SELECT id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) x LEFT JOIN repeated r ON r.id = x.id AND r.i = x.p
            ), kept AS (
                SELECT id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM words GROUP BY id
            )
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
            FROM d LEFT JOIN kept k USING (id)""",
        "op2_nearest_neighbours": """
            WITH v AS (
                SELECT row_number() OVER () AS place, vec_id, embedding::DOUBLE[] AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), pairs AS (
                SELECT q.place, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(generate_series(1, len(q.e)),
                           lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
                FROM v q JOIN v c ON q.place <> c.place AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY place ORDER BY score, vec_id)::INT AS rank FROM pairs
            )
            SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
        "op8_source_mixing": r"""
            WITH RECURSIVE sized AS (
                SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
                FROM documents
            ), sources AS (
                SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
                       [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
                FROM sized GROUP BY source
            ), goal AS (SELECT sum(source_size)::DOUBLE * 1.5 AS total FROM sources),
            rounds AS (
                -- Each round caps the sources whose share by weight is above their cap, until none is.
                SELECT 0 AS step, source, false AS capped FROM sources
                UNION ALL
                SELECT step + 1, source, capped OR level * weight > cap FROM (
                    SELECT r.step, r.source, r.capped, s.weight, s.cap,
                           ((SELECT total FROM goal) - sum(CASE WHEN r.capped THEN s.cap ELSE 0 END) OVER ())
                           / nullif(sum(CASE WHEN r.capped THEN 0 ELSE s.weight END) OVER (), 0) AS level
                    FROM rounds r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source
                ) WHERE step < 64
            ), last AS (SELECT source, capped FROM rounds WHERE step = 64),
            level AS (
                SELECT ((SELECT total FROM goal) - coalesce(sum(cap) FILTER (WHERE capped), 0))
                       / nullif(sum(weight) FILTER (WHERE NOT capped), 0) AS level
                FROM last JOIN sources s ON last.source IS NOT DISTINCT FROM s.source
            ), targets AS (
                SELECT s.source, s.source_size,
                       CASE WHEN capped THEN cap::DOUBLE ELSE (SELECT level FROM level) * weight END AS target
                FROM last JOIN sources s ON last.source IS NOT DISTINCT FROM s.source
            ), rated AS (
                SELECT doc_id, size, source_size, target,
                       CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size::DOUBLE END AS rate,
                       ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size::VARCHAR
                           || CASE WHEN occurrence > 1 THEN '|' || occurrence::VARCHAR ELSE '' END), 1, 8))::BIGINT
                       / 4294967296.0::DOUBLE AS uniform
                FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) AS occurrence FROM sized) sized JOIN targets t ON sized.source IS NOT DISTINCT FROM t.source
            )
            SELECT doc_id, size, source_size, target,
                   (floor(rate)::BIGINT + CASE WHEN uniform < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
            FROM rated""",
        "op10_exact_dedup": """
            WITH n AS (
                SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                FROM documents
            ), g AS (
                SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
                FROM n
            )
            SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g""",
    }
