"""One query opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import nearest_neighbours
from .chat_format import format_chats, read_back, streamed_events
from .embedding_dedup import embedding_near_dedup
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .piece_codec import decode_pieces, encode_pieces
from .pii import KINDS, redact_personal_data
from .prefix_trie import prefix_trie, rebuilt_conversations
from .sharding import shard_rows
from .substring_dedup import remove_repeats
from .token_alignment import align_tokenizers
from .toxicity import fit, held_out, score_toxicity

#: Target weights of the mix: four domains (source number modulo 4), languages,
#: and the sources of each language alike.
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "fr": 20, "de": 20, "es": 10}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_levels() -> dict:
    """The mix's tree: domain, language, source."""
    number = F.expr("coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0)")
    return {"domain": F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 16 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return shard_rows(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their class and number of links."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of documents: counts and digest of the base, all spans."""
    found = redact_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("redacted_crc32"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated passages: where, whose stay, what is left."""
    cut = remove_repeats(table(spark, sf_dir, "documents"), edges=True).where(F.size("removed_spans") > 0)
    return cut.select(
        "doc_id",
        F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removed_spans"),
        F.array_sort(F.array_distinct(F.col("removed_spans.first_doc_id"))).alias("first_doc_ids"),
        F.length("text").cast("long").alias("kept_chars"),
        F.crc32(F.col("text").cast("binary")).alias("kept_crc32"),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with links and components at cosine 0.98."""
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations formatted and read back, with one that holds control strings."""
    said = r"\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    logs = streamed_events(turns)
    back = read_back(format_chats(logs))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for the mix, once for each epoch that takes them."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, mix_levels())
    return mixed.select("doc_id", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of documents, learnt from labels that are not held out."""
    documents = table(spark, sf_dir, "documents")
    scored = score_toxicity(documents.select("doc_id", "text"), fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"), F.size("toxic_segments").alias("n_segments"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as SentencePiece ids, and decoded from them again."""
    encoded = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return decode_pieces(encoded).select("doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that share first turns."""
    return prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in each of documents."""
    return align_tokenizers(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_two_pass_shuffle,
        op2_ngram_jaccard_join,
        op3_personal_data,
        op4_repeated_passages,
        op5_embedding_near_dedup,
        op6_nearest_neighbours,
        op7_chat_format,
        op8_mix_sources,
        op9_pack_sequences,
        op10_toxicity,
        op11_piece_codec,
        op12_prefix_trie,
        op13_token_alignment,
    )
}

_ESC = r"replace(replace(replace({0}, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')"

#: DuckDB SQL of the queries that SQL can express: similarity and links by joining
#: all shingles or vectors, reachability by recursion, chats without rendering.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.8),
c(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.i, p.j FROM c JOIN p ON c.j = p.i),
k AS (SELECT i, min(j) AS class_id FROM c GROUP BY i), l AS (SELECT i, count(*) AS n FROM p GROUP BY i)
SELECT s.doc_id, k.class_id, CASE WHEN len(s) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY s.s) END AS copy_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM s JOIN k ON s.doc_id = k.i LEFT JOIN l ON s.doc_id = l.i""",
    "op5_embedding_near_dedup": """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
c(i, j) AS (SELECT vec_id, vec_id FROM e UNION SELECT c.i, p.j FROM c JOIN p ON c.j = p.i),
k AS (SELECT i, min(j) AS component_id FROM c GROUP BY i), l AS (SELECT i, count(*) AS n FROM p GROUP BY i)
SELECT k.i AS vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, k.component_id, k.i = k.component_id AS kept FROM k LEFT JOIN l ON k.i = l.i""",
    "op7_chat_format": rf"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(14 + length(replace({_ESC.format("role")}, ':', ':\')) + length({_ESC.format("text")})) AS BIGINT) AS formatted_chars FROM a GROUP BY conv_id""",
    # crc32 bit by bit; nodes are the prefixes themselves
    "op12_prefix_trie": """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM t),
h AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
b AS (SELECT c, 0 AS side, nth, role, text FROM h JOIN o ON o.conv_id = base AND nth <= h UNION ALL SELECT c, 1, nth, role, text FROM h JOIN o ON o.conv_id = c AND nth > h),
w AS (SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY side, nth) FILTER (WHERE nth IS NOT NULL), []) AS turns FROM h LEFT JOIN b ON b.c = h.c GROUP BY h.c),
m AS (SELECT c, d, turns[1:d] AS p, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM w)),
n AS (SELECT p, d, p[1:d - 1] AS up, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY p, d),
k AS (SELECT up AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
x AS (SELECT n.p, n.d, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.p[n.d].text)) END AS saved FROM n LEFT JOIN k ON k.p = n.p),
s AS (SELECT p[1:a] AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS a FROM x) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.p = n.p LEFT JOIN k ON k.p = n.p LEFT JOIN n u ON n.d > 0 AND u.p = n.up""",
}
