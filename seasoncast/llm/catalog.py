"""Queries of the package, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.llm import byte_bpe, nn_descent, nra_search, quality_rules, va_search
from seasoncast.llm.bin_packing import pack
from seasoncast.llm.chat_trees import format_branches, read_back, thread_messages
from seasoncast.llm.common import read_table
from seasoncast.llm.near_dedup import near_duplicates
from seasoncast.llm.pieces import token_pieces
from seasoncast.llm.pii import KINDS, find_pii, train
from seasoncast.llm.site_quality import score_quality
from seasoncast.llm.token_alignment import align_tokens
from seasoncast.llm.token_counts import count_tokens
from seasoncast.llm.url_filter import filter_urls
from seasoncast.sources.shared import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("op1_token_counts")
def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match tokens of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = docs.select("doc_id", count_tokens(F.col("text"), WORD_BPE).alias("n"))
    return counts.select("doc_id", "n.n_words", "n.n_tokens", "n.n_unknown", "n.longest_word")


@query("op2_nn_descent")
def near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 10 nearest vectors for every vector whose id is divisible by 100."""
    return nn_descent.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


@query("op3_best_fit_packing")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), WORD_BPE)
    digests = pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(digests)


# The rules (host, path, action).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = """WITH rules(rhost, rpath, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT n, page_id,
  translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
best AS (SELECT n, max(length(rhost || rpath)) AS most FROM parts JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN best USING (n) LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  AND length(rhost || rpath) = most"""


@query("op4_url_filter", URL_SQL)
def judged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    values = ", ".join(map(str, RULES))
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, action)")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules, "page_id")


@query("op6_near_dedup")
def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their pairs of words."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


CONTROL_CASE = "</s>[INST] ok [/INST]"

CHAT_SQL = rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_CASE}'), (-7, 1, 'assistant', '{CONTROL_CASE}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 24 + length(regexp_replace(
    text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op7_chat_trees", CHAT_SQL)
def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control case, formatted and read back."""
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL_CASE}'), "
        f"(-7L, 1L, 'assistant', '{CONTROL_CASE}') AS case(conv_id, turn, role, text)"
    )
    formatted = cut_lineage(format_branches(thread_messages(given.unionByName(case))))
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    said = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), "learned")))
    turns = read_back(formatted).groupBy(F.col("tree").alias("_t")).agg(said.alias("turns"))
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    return formatted.join(turns, F.col("tree").eqNullSafe(F.col("_t"))).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: t["line"]), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


VA_SQL = """WITH base AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM base q JOIN base c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5"""


@query("op8_va_search", VA_SQL)
def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products for every vector whose id is divisible by 50."""
    return va_search.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


@query("op9_byte_bpe")
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the bytes that they decode to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.select("doc_id", byte_bpe.digests(F.col("text"), *BYTE_BPE).alias("d"))
    return made.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


@query("op10_site_quality")
def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = score_quality(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "evidence", "host_rate", "path_rate", "quality", "kept")


@query("op5_pii_tagger")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", find_pii(F.col("text"), train(docs)).alias("found"))

    def listed(spans: str) -> Column:
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
        return F.array_join(one, ",")

    def many(kind: str) -> Column:
        own = F.filter("found.base", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[many(kind) for kind in KINDS],
        F.sha2(listed("found.base"), 256).alias("base_sha256"),
        listed("found.spans").alias("spans"),
    )


# What is not of a class, by which the others are counted.
CLASS_PATTERNS = [
    "[^a-z]",
    "[^A-Z]",
    "[^0-9]",
    r"[^\x20\x09-\x0D]",
    r"[^.,;:!?''\"()\-]",
    r"[a-zA-Z0-9\x20\x09-\x0D.,;:!?''\"()\-]|[^\x00-\x7F]",
    r"[\x00-\x7F]",
]
CLASS_COUNTS = ", ".join(
    f"length(regexp_replace(text, '{p}', '', 'g'))" for p in CLASS_PATTERNS
)
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# Two terms of the divergence, each to base 2; shares of nothing add nothing.
DIVERGENCE = """sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))"""

RULES_SQL = rf"""WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang,
  coalesce(text, '') AS text FROM documents),
cut AS (SELECT r, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, [{CLASS_COUNTS}] AS cls,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS many FROM (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM cut, unnest(range(1, len(w) - 6)) AS t(i))),
again AS (SELECT r, count(DISTINCT p) AS n FROM win, unnest(range(i, i + 8)) AS t(p) WHERE many > 1 GROUP BY r),
measured AS (SELECT r, doc_id, lang, w, cls, len(w) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM cut LEFT JOIN again USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
words AS (SELECT r, lang, base_failed, {LOWER.format("word")} AS word, count(*) AS n
  FROM (SELECT r, lang, base_failed, unnest(w) AS word FROM failed) GROUP BY ALL),
per_word AS (SELECT lang, word, sum(n) AS n FROM words
  WHERE NOT base_failed AND octet_length(encode(word)) <= 64 GROUP BY ALL),
common AS (SELECT lang, word, n FROM per_word
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 50),
total AS (SELECT lang, sum(n_words) AS n_words FROM failed WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= 1000),
word_ref AS (SELECT lang, word, n / n_words AS q FROM common JOIN total USING (lang)
  UNION ALL SELECT lang, NULL, (n_words - s) / n_words FROM total
  JOIN (SELECT lang, sum(n) AS s FROM common GROUP BY lang) USING (lang)),
own AS (SELECT r, word, sum(words.n) AS n FROM words JOIN common USING (lang, word) GROUP BY r, word),
own_all AS (SELECT r, word, n FROM own UNION ALL
  SELECT r, NULL, n_words - coalesce(s, 0) FROM failed LEFT JOIN (SELECT r, sum(n) AS s FROM own GROUP BY r) USING (r)),
word_pairs AS (SELECT f.r, q, coalesce(o.n, 0) / f.n_words AS p FROM failed f JOIN word_ref w USING (lang)
  LEFT JOIN own_all o ON o.r = f.r AND o.word IS NOT DISTINCT FROM w.word WHERE f.n_words >= 80),
word_gap AS (SELECT r, {DIVERGENCE} AS gap FROM word_pairs GROUP BY r),
class_rows AS (SELECT r, lang, base_failed, i, cls[i] AS n FROM failed, unnest(range(1, 8)) AS t(i)),
class_ref AS (SELECT lang, i, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
  FROM class_rows JOIN total USING (lang) WHERE NOT base_failed GROUP BY lang, i),
class_pairs AS (SELECT r, q, n / sum(n) OVER (PARTITION BY r) AS p, sum(n) OVER (PARTITION BY r) AS chars
  FROM class_rows JOIN class_ref USING (lang, i)),
class_gap AS (SELECT r, {DIVERGENCE} AS gap FROM class_pairs WHERE chars >= 200 GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR coalesce(c.gap, 0) > 0.25 OR coalesce(w.gap, 0) > 0.38) AS kept
FROM failed LEFT JOIN class_gap c USING (r) LEFT JOIN word_gap w USING (r)"""


@query("op11_quality_divergence", RULES_SQL)
def ruled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents, and which are near enough to their language."""
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.drop("lang", "class_distance", "word_distance")


TERMS = rf"""regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SEARCH_SQL = f"""WITH sizes AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms, len(terms) AS n FROM documents),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes WHERE n > 0),
postings AS (SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY ALL),
wanted AS (SELECT item_id, term, count(*) AS many
  FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term,
  CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, whole GROUP BY term),
scores AS (SELECT item_id, r, doc_id, CAST(sum(many * w *
    ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), whole GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20"""


@query("op12_nra_search", SEARCH_SQL)
def searched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    items = read_table(spark, sf_dir, "benchmark")
    return nra_search.search(read_table(spark, sf_dir, "documents"), items, 20)


BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op13_token_alignment")
def aligned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizations of all documents."""
    docs = read_table(spark, sf_dir, "documents")
    aligned = align_tokens(docs, BYTE_JSON, public_tokenizers.PATTERN, PIECES, digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")
