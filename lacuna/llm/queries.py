"""The registered queries of this subpackage, and the SQL that some of them agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    collocations,
    decontaminate,
    divergence,
    exact_dedup,
    lm_scoring,
    quality,
    sentence_pieces,
    sharding,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return found.withColumnRenamed("id", "doc_id")


# The text without white space, as the contract has it; DuckDB's strings are UTF-8.
BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"


@query(f"""
    SELECT doc_id,
           first_value(doc_id) OVER same AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER same = 1 AS kept,
           text_sha256
    FROM (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({BARE}) AS text_sha256 FROM documents)
    WINDOW same AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# A-Z in lower case, then the words of the contract.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""
    WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark),
    item_window AS (
        SELECT DISTINCT item_id, list_slice(w, k, k + 12) AS win
        FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM item WHERE len(w) > 0)
    ),
    size AS (SELECT DISTINCT len(win) AS n FROM item_window),
    doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
    place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM doc),
    hit AS (
        SELECT doc_id, k, n, item_id
        FROM (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win FROM place, size WHERE k + n - 1 <= len(w)) p
        JOIN item_window USING (win)
    ),
    word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM hit) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op4_decontaminate(spark, sf_dir):
    found = decontaminate.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query()
def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.scores(docs, labels, usable=~toxicity.held_out())
    return found.withColumnRenamed("id", "doc_id").select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query()
def op10_sentence_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = docs.select("doc_id", "text", sentence_pieces.encoded(F.col("text"), F.col("doc_id"), model).alias("ids"))
    back = ids.withColumn("back", sentence_pieces.decoded(F.col("ids"), model))
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        F.sha2("back", 256).alias("text_sha256"),
        (F.col("back") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


CONTROL = "</s>[INST] ok [/INST]"


def escaped(c: str) -> str:
    """The template's escape: a backslash more between ``<`` and ``|``."""
    return rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"


@query(rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
    ),
    shown AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
               coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
               CAST(sum(length({escaped("role")}) + length({escaped("text")}) + {len(chat.TURN + chat.TEXT + chat.END)}) AS BIGINT)
                   AS formatted_chars
        FROM turns GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
    FROM shown
""")
def op7_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.formatted(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op8_hash_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = sharding.sharded(docs, sharding.layout(24), sharding.layout(25))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query()
def op9_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.scores(docs, labels, usable=~quality.held_out()).withColumnRenamed("id", "doc_id")
    return found.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


@query()
def op3_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


# Windows of 20 words; one that is not the first with its words is repeated, and so are the words under it.
@query(r"""
    WITH doc AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    place AS (
        SELECT row, doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS win
        FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc WHERE len(w) >= 20)
    ),
    repeated AS (SELECT row, k FROM place QUALIFY rank() OVER (PARTITION BY win ORDER BY doc_id, k) > 1),
    gone AS (SELECT DISTINCT row, unnest(range(k, k + 20)) AS k FROM repeated),
    word AS (SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM doc),
    kept AS (SELECT row, string_agg(x, ' ' ORDER BY k) AS rest, count(*) AS n FROM word ANTI JOIN gone USING (row, k) GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM doc LEFT JOIN kept USING (row)
""")
def op6_substring_dedup(spark, sf_dir):
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), width=20)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


# Phrases of up to three words within pieces, with their counts; words hold no blank, so a phrase is its text.
@query(rf"""
    WITH piece AS (
        SELECT lang, regexp_extract_all(unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
    ),
    place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM piece),
    gram AS (
        SELECT lang, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS p, count(*) AS f
        FROM place, (VALUES (1), (2), (3)) size(m) WHERE k + m - 1 <= len(w) GROUP BY ALL
    ),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE m = 1 GROUP BY lang),
    candidate AS (SELECT * FROM gram WHERE m > 1 AND f >= 10),
    cut AS (
        SELECT lang, m, p, f, k,
               array_to_string(string_split(p, ' ')[1:k], ' ') AS head, array_to_string(string_split(p, ' ')[k + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, m)) AS k FROM candidate)
    ),
    scored AS (
        SELECT cut.*, h.f AS l, t.f AS r,
               CAST((CAST(1000000 AS HUGEINT) * cut.f * cut.f) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
        FROM cut JOIN gram h ON h.lang = cut.lang AND h.p = head JOIN gram t ON t.lang = cut.lang AND t.p = tail
    ),
    worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    longer AS (
        SELECT lang, p, max(f) AS f
        FROM (SELECT lang, f, unnest([array_to_string(string_split(p, ' ')[1:2], ' '), array_to_string(string_split(p, ' ')[2:3], ' ')]) AS p
              FROM candidate WHERE m = 3)
        GROUP BY lang, p
    )
    SELECT worst.lang, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, worst.f DESC, worst.p) AS rank,
           worst.p AS phrase, worst.f AS a, l, r, n, score
    FROM worst JOIN total USING (lang) LEFT JOIN longer ON longer.lang = worst.lang AND longer.p = worst.p
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * worst.f
    QUALIFY rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, covered=50, top=2_000)


# Shares and distances in whole numbers; products of shares stay below 2**63.
@query(rf"""
    WITH doc AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
               regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents
    ),
    word AS (SELECT lang, source, row, unnest(w) AS t FROM doc),
    kept AS (SELECT lang, t FROM word GROUP BY lang, t HAVING count(DISTINCT row) >= 10),
    grp AS (SELECT DISTINCT lang, source FROM doc),
    size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    found AS (SELECT lang, source, t, count(*) AS n FROM word JOIN kept USING (lang, t) GROUP BY ALL),
    cell AS (
        SELECT g.lang, g.source, k.t, coalesce(f.n, 0) AS n, v
        FROM grp g JOIN kept k USING (lang) JOIN size USING (lang)
        LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.t = k.t
    ),
    share AS (
        SELECT *, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p
        FROM cell
    ),
    whole AS (
        SELECT lang, t, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q
        FROM (SELECT lang, t, sum(n) AS n, any_value(v) AS v FROM cell GROUP BY lang, t)
    ),
    apart AS (
        SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
        FROM share a JOIN share b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL
    ),
    item AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
        UNION ALL
        SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM share JOIN whole USING (lang, t) WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM item QUALIFY part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


@query()
def op13_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lm_scoring.scores(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")
