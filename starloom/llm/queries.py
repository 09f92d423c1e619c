"""Named queries of this folder: each maps given tables to an operator and its rows back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm import chat_format, fertility, language, mixing, near_duplicates, neighbours, packed_output, prefix_trie, quality_model, ranked_search, token_counts, url_filter, vector_packing
from starloom.session import configure, materialize, new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Vocabulary files of public tokenizers, read where they are installed.
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(configure(spark), folder)
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(documents: DataFrame) -> DataFrame:
    """Documents in the form of a staging table."""
    return documents.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("nombre_raw"), F.col("source").alias("archivo_origen")
    )


def remainder(key: str, divisor: int) -> Column:
    """The fold of a row: a checksum of its key as text."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor))


URL_RULES = (
    url_filter.Rule("com", "/", url_filter.ALLOW),
    url_filter.Rule("example.com", "/en/", url_filter.BLOCK),
    url_filter.Rule("www.example.com", "/en/", url_filter.ALLOW),
    url_filter.Rule("net", "/es/", url_filter.BLOCK),
    url_filter.Rule("net", "/fr/", url_filter.BLOCK),
)


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, "url", "page_id").select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op2_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    found = neighbours.search(embeddings, embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding")
    return found.withColumnRenamed("neighbour_id", "vec_id")


def packed_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).withColumnRenamed("record_tokens", "doc_tokens")
    return digest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")


@query
def op3_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digest(vector_packing.pack(table(spark, folder, "documents"), WORDS, "doc_id", "text"))


LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def labelled_languages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of domains: the language of the documents that have labels."""
    return documents.where(F.col("lang").isNotNull()).select("doc_id", "lang").join(labels.select("doc_id").distinct(), "doc_id")


def present(weights: dict[str, float], model: mixing.DomainModel) -> dict[str, float]:
    return {d: w for d, w in weights.items() if d in model.domains}


@query
def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labelled = labelled_languages(documents, table(spark, folder, "labels"))
    model = mixing.fit(documents, labelled, "text", "lang", "doc_id")
    mixed = mixing.mix(documents, model, present(LANGUAGE_WEIGHTS, model), "doc_id", "text")
    return mixed.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), "domain", "posterior", "rate", "copies")


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 3) == 1).alias("held_out"))
    model = language.fit(documents.where(~F.col("held_out")), "text", "lang", "doc_id")
    return language.predict(documents, model, "text").select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    packed = packed_output.pack(table(spark, folder, "documents"), WORDS, "doc_id", "text")
    return packed.withColumnRenamed("keys", "doc_ids")


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark)
    places = token_counts.flatten(table(spark, folder, "documents"), WORDS, path, "doc_id", "text")
    counted = token_counts.count(spark, path).withColumn("part", token_counts.part_number())
    return counted.join(places, ["part", "document"], "left").select("doc_id", "part", "document", "first_token", "n_tokens", "complete")


@query
def op8_tokenizer_fertility(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    judged = fertility.judge(fertility.measure(documents, PIECES, "text"))
    return judged.drop("text")


@query
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.find(table(spark, folder, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id_tomado", "component_id")


SQL["op9_minhash_near_dedup"] = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS run FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
           coalesce(m.b, d.doc_id) >= d.doc_id AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = quality_model.fit(documents, labels.where(remainder("doc_id", 5) != 0), "text", "quality", "doc_id")
    return quality_model.predict(documents, model, "text").select("doc_id", "held_out", "score", "predicted")


# Texts that look like the marks of a template, as a conversation of their own.
MARKED = "</s>[INST] ok [/INST]"


@query
def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)], conversations.schema)
    columns = ("conv_id", "turn", "role", "text")
    formatted = chat_format.format_turns(conversations.unionByName(marked), *columns, template=chat_format.CHAT)
    return chat_format.digest(formatted, "conv_id", chat_format.CHAT)


def _escaped_sql(column: str) -> str:
    """A text with the backslashes that the template puts in."""
    out = f"replace({column}, '\\', '\\\\')"
    for mark in chat_format.CHAT.marks:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


SQL["op12_chat_format"] = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}'),
    o AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM t
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    e AS (SELECT *, length({_escaped_sql("text")}) AS body, {len("[INST]" "[/INST]" "</s>")} + length({_escaped_sql("role")}) AS head FROM o)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
           cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           cast(sum(body + CASE WHEN before IS DISTINCT FROM role THEN head ELSE {len("[NEXT]")} END) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
"""


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coded turns of the rebuilt conversations, and the ids of all of them.

    The first ``h`` turns of conversation ``c`` are those of ``c - c % 20``, the others its own.
    """
    coded = prefix_trie.coded(conversations, "conv_id", "turn", "role", "text").where("key is not null")
    place = F.row_number().over(Window.partitionBy("key").orderBy("turn", "code"))
    numbered = materialize(coded.select("key", "code", "words", place.alias("turn")))
    ids = numbered.where("turn = 1").select("key", remainder("key", 4).alias("h"), (F.col("key") - F.col("key") % 20).alias("base"))
    own = numbered.where(F.col("turn") > remainder("key", 4)).select("key", "turn", "code", "words")
    heads = numbered.where("key % 20 = 0 and turn <= 3").withColumnRenamed("key", "base")
    first = ids.join(heads, "base").where("turn <= h").select("key", "turn", "code", "words")
    return own.unionByName(first), ids.select("key")


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    trie = prefix_trie.build(*rebuilt_turns(table(spark, folder, "conversations")))
    ends = F.coalesce("ends_digest", F.sha2(F.lit("").cast("binary"), 256))
    return trie.nodes.join(prefix_trie.ends_digests(trie), "node", "left").select(
        F.col("first_id").alias("conv_id"),
        "depth",
        F.col("parent_first_id").alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        "saved_tokens",
        ends.alias("ends_sha256"),
    )


@query
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = ranked_search.search(documents, items, "doc_id", "text", "item_id", "text")
    return found.select(F.col("request").alias("item_id"), "rank", "doc_id", "score")


SQL["op11_ranked_search"] = r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
    s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY ALL),
    c AS (SELECT item_id, term, count(*) AS often FROM q GROUP BY ALL),
    i AS (SELECT item_id, doc_id, often * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
                 * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms)))) AS impact
          FROM c JOIN p USING (term) JOIN f USING (term) JOIN d USING (doc_id) CROSS JOIN s),
    r AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM i GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM r WHERE score > 0 QUALIFY rank <= 20
"""
