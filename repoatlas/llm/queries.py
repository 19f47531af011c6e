"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.llm import chat, language, secrets, token_files, warc
from repoatlas.llm.ann import nearest_neighbours
from repoatlas.llm.common import table
from repoatlas.llm.embedding_dedup import near_duplicates
from repoatlas.llm.filter_audit import audit_filters
from repoatlas.llm.lexical_search import ranked_search
from repoatlas.llm.mix import mix_sources
from repoatlas.llm.ngram_join import similar_groups
from repoatlas.llm.pack import pack_documents
from repoatlas.llm.suffix_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.archive_pages(table(spark, sf_dir, "pages")), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op2_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
    SELECT vec_id AS node, vec_id AS root FROM v
    UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
), roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM v LEFT JOIN counted ON a = vec_id JOIN roots ON node = vec_id
"""


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mix_sources(table(spark, sf_dir, "documents")).taken()
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLES["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(array_to_string(words[i : i + 3], ' ')) AS g
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS MATERIALIZED (
    SELECT p.a, p.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams AS x JOIN grams AS y USING (g)
        WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) AS p
    JOIN sizes AS s ON s.doc_id = p.a JOIN sizes AS t ON t.doc_id = p.b
    WHERE 100 * c >= 85 * (s.n + t.n - c)
), reached AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION SELECT links.b, reached.root FROM reached JOIN links ON links.a = reached.node
), roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM documents AS d LEFT JOIN sizes USING (doc_id) JOIN roots ON node = d.doc_id
"""


MARKED = "\\### Assistant: </turn> ok"


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKED).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = chat.conversation_records(rows.unionByName(extra))
    read = chat.read_formatted(chat.format_records(records, "record"))
    line = F.lit("\n")
    turns = F.transform("read_turns", lambda t: F.concat(t.role, line, t.text, line))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op6_chat_formatting"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, 4 + length(role) + 2 + 8
        + length(text) + (length(text) - length(replace(replace(text, '\', ''), '#', '')))
        + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""".replace("\\\\", "\\")


@query
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs)
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long")
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )
    base = F.filter("secret_spans", lambda s: s.kind.isin(*secrets.BASE))
    return found.select(
        "doc_id", *[n(kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secret_spans")).alias("spans"),
    )


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(docs)
    return language.identify_language(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text that remains follows, without characters that a cut goes through
    kept = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    return remove_repeats(table(spark, sf_dir, "documents")).withColumn("text", kept).drop("spans", "kept")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT doc_id, part,
        (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM d
), cells AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), x(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
    FROM x AS p, x AS q, x AS r, x AS s, x AS t WHERE p.b | q.b | r.b | s.b | t.b = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit,
        coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS g(step)
), counted AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


@query
def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_token_files(
        token_files.encode_corpus(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2))


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), docs AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), m AS MATERIALIZED (
    SELECT doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM docs, total
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tf, total GROUP BY term, n_docs
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
