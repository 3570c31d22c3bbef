"""The registered queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, embeddings, htmltext, langid, lm, minhash, packing, phrases, quality, secrets, sharding
from .common import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: The tokenizer file of the queries; the operators take a path.
BPE_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_chat_format(spark, sf_dir):
    """Maximal conversations of ``conversations``, rendered turn by turn."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLE["op6_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w - 1 AS position FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT *, md5(string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), '')
    OVER (PARTITION BY conv_id ORDER BY position)) AS h,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
kept AS (
  SELECT min(conv_id) AS conv_id, position + 1 AS n_turns, count(*) AS n_logs, h FROM p WHERE position + 1 = n_turns
  GROUP BY position, h HAVING (position + 1, h) NOT IN (SELECT (position + 1, h) FROM p WHERE position + 1 < n_turns)),
s AS (
  SELECT conv_id, position, '{chat.TURN_START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment FROM p)
SELECT s.conv_id, s.position, kept.n_turns, kept.n_logs, s.segment,
  CAST(coalesce(sum(length(s.segment)) OVER (PARTITION BY s.conv_id ORDER BY s.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM s JOIN kept ON s.conv_id IS NOT DISTINCT FROM kept.conv_id
"""


@query
def op9_byte_shards(spark, sf_dir):
    """All ``documents`` in 24 contiguous shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.byte_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.byte_shards(docs, 24, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_quality_rules(spark, sf_dir):
    """Statistics of all ``documents``, the base rule and the decision list learned from ``labels``."""
    stats = pin(quality.statistics(table(spark, sf_dir, "documents")), "quality")
    rules = quality.learn(stats, table(spark, sf_dir, "labels"))
    return quality.judge(stats, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


@query
def op10_language_id(spark, sf_dir):
    """Language of all ``documents`` by a network trained on those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    net = langid.learn(docs.where(F.coalesce(~held, F.lit(True))))
    return langid.predict(docs, net).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_secret_scan(spark, sf_dir):
    """Spans of secrets in all ``documents``, found through the trigram index."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = tuple(r.kind for r in secrets.BASE_RULES)
    return found.select("doc_id", *[secrets.count_kind(k).alias(f"n_{k}") for k in base],
                        F.sha2(secrets.span_text(kinds=base), 256).alias("base_sha256"), secrets.span_text().alias("spans"))


@query
def op4_best_fit_packing(spark, sf_dir):
    """All ``documents`` as token pieces in sequences of 1024."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_bpe_encode_decode(spark, sf_dir):
    """All whole ``documents`` texts to ids with chunk reuse, and back."""
    done = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op1_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all ``documents`` on 3-word shingles at 85 %."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_embedding_dedup(spark, sf_dir):
    """Links and components of all ``embeddings`` at cosine 0.9."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_lm_score(spark, sf_dir):
    """Unigram and context-mixing scores of all ``documents``, learned from those whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return lm.score_texts(docs.withColumn("_held", held), "_held")


@query
def op11_token_alignment(spark, sf_dir):
    """Groups, links and corpus-wide pair counts of the tokens of all ``documents`` under two tokenizers."""
    return alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


@query
def op13_html_extraction(spark, sf_dir):
    """Main text of all ``pages``."""
    return htmltext.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


# The pages of the tables mark their article by an element: its headings and paragraphs, tags and references replaced.
ORACLE["op13_html_extraction"] = r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(
      replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a),
c AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(
      array_to_string(parts, chr(10)), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""


@query
def op12_phrase_mining(spark, sf_dir):
    """The first 2000 collocations of each language of all ``documents``."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_phrase_mining"] = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) sizes(m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
cut AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c),
sc AS (
  SELECT cut.lang, cut.phrase, cut.m AS m, cut.a AS a, cut.k AS k, x.f AS l, y.f AS r, CAST((CAST(a AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[1:cut.k], ' ')
    JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[cut.k + 1:cut.m], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 80 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT * FROM (
  SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN total ON total.lang = kept.lang) WHERE rank <= 2000
"""
