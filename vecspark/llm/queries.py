"""The registered queries of the corpus operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bound_batches, load, written


def _ready(spark: SparkSession) -> SparkSession:
    bound_batches(spark)
    return ship(spark)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    vectors = quantised(load(_ready(spark), sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_dedup

    return near_dedup(load(_ready(spark), sf_dir, "embeddings"), least=0.9)


OP3_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN degree d USING (vec_id)
"""

def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(load(_ready(spark), sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, list_sort(s) AS s FROM shingles),
classes AS (SELECT min(doc_id) AS rep, any_value(n_shingles) AS n, s FROM sizes WHERE n_shingles > 0 GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.rep <> b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT z.doc_id, z.n_shingles, coalesce(k.component_id, z.doc_id) AS component_id
FROM sizes z LEFT JOIN classes c ON z.s = c.s AND z.n_shingles > 0 LEFT JOIN component k USING (rep)
""".replace("\\\\", "\\")

def vocabulary_path(name: str) -> str:
    """Path of a public tokenizer's file, the default of the queries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_codec import round_trip

    return round_trip(load(_ready(spark), sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), 2)


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_shares

    return mix_shares(load(_ready(spark), sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS place FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS r
  FROM docs GROUP BY source),
sized AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM sources),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, cap, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY cap / w, cap, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () AS total FROM sized),
levels AS (SELECT *, (total * 1.5::DOUBLE - used) / rest AS level FROM filled),
final AS (SELECT (SELECT level FROM levels WHERE level * w < cap ORDER BY used, level LIMIT 1) AS level),
targets AS (SELECT source, source_size, coalesce(least(cap, f.level * w), cap) AS target FROM levels, final f),
queue AS (
  SELECT d.*, t.source_size, t.target,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
packets AS (SELECT *, unnest(range(0, greatest(1, (size + 127) // 128))) AS packet FROM queue),
entries AS (
  SELECT q.*, r AS round, least(128, size - 128 * packet) AS length,
    coalesce(CAST(ahead + 128 * packet + least(128, size - 128 * packet) + source_size * r AS DOUBLE) / CASE WHEN target > 0 THEN target END, 0) AS finish
  FROM packets q, (VALUES (0), (1)) t(r)),
placed AS (
  SELECT *, coalesce(sum(length) OVER (ORDER BY finish, source IS NULL, source, place, doc_id, round, packet, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM entries),
budget AS (SELECT CAST(floor(coalesce(sum(target), 0) + 1e-3::DOUBLE) AS BIGINT) AS budget FROM targets)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(greatest(0, least(length, budget - position))) AS BIGINT) AS taken FROM placed, budget GROUP BY doc_id
""".replace("\\\\", "\\")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    return find_secrets(load(_ready(spark), sf_dir, "documents"))


#: The rules of the registered URL query.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, judge_urls

    return judge_urls(load(_ready(spark), sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


OP9_SQL = r"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest FROM pages),
tags AS (
  SELECT url, host, path, rest, unnest(list_distinct(list_concat(
    list_transform(regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|''[^''>]*\bcanonical\b|canonical\b)[^>]*>', 0, 'is'), lambda t: regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')),
    list_transform(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), lambda t: regexp_extract(t, '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is'))))) AS goal
  FROM p WHERE contains(url, '://')),
goals AS (
  SELECT host || rest AS a, CASE
    WHEN goal = '' THEN NULL
    WHEN regexp_matches(goal, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN goal
    WHEN starts_with(goal, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || goal
    WHEN starts_with(goal, '/') THEN regexp_extract(url, '^.*?://[^/?#]*', 0, 's') || goal
    WHEN regexp_matches(goal, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
    WHEN starts_with(goal, '?') THEN regexp_extract(url, '^.*?://[^/?#]*', 0, 's') || path || goal
    ELSE regexp_extract(url, '^.*?://[^/?#]*', 0, 's') || CASE WHEN regexp_extract(path, '^.*/', 0, 's') = '' THEN '/' ELSE regexp_extract(path, '^.*/', 0, 's') END || goal END AS goal FROM tags),
half AS (
  SELECT a, translate(regexp_extract(goal, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(goal, '^.*?://[^/?#]*([^#]*)', 1, 's') AS b
  FROM goals WHERE goal IS NOT NULL AND contains(goal, '://')),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
best AS (
  SELECT x.host, x.path, first(r.verdict ORDER BY length(rhost || rpath) DESC, r.verdict = 'block') AS verdict,
    first(rhost || rpath ORDER BY length(rhost || rpath) DESC, r.verdict = 'block') AS rule
  FROM (SELECT DISTINCT host, path FROM p UNION SELECT regexp_extract(b, '^[^/?#]*', 0, 's'), regexp_extract(b, '^[^/?#]*([^?#]*)', 1, 's') FROM links) x
  JOIN rules r ON (x.host = rhost OR ends_with(x.host, '.' || rhost)) AND starts_with(x.path, rpath) GROUP BY ALL),
alias AS (
  SELECT r.a, bool_or(b.verdict = 'block') AND NOT bool_or(b.verdict = 'allow') AS blocked FROM reach r
  JOIN best b ON b.host = regexp_extract(r.b, '^[^/?#]*', 0, 's') AND b.path = regexp_extract(r.b, '^[^/?#]*([^?#]*)', 1, 's') GROUP BY r.a)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN a.blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN alias a ON a.a = p.host || p.rest
""".replace("\\\\", "\\")


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(load(_ready(spark), sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), 0)


def op2_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(load(_ready(spark), sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(load(_ready(spark), sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_align import align

    return align(load(_ready(spark), sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(load(_ready(spark), sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
found AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
summed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM found, crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM summed GROUP BY 1 HAVING sum(n) >= 2),
counted AS (SELECT * FROM words WHERE length(word) >= 7),
skipped AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT *, unnest(range(length(word))) AS i FROM counted)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM skipped a JOIN skipped b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skipped a JOIN counted b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM skipped a JOIN counted b ON a.v = b.word),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS m FROM pairs GROUP BY a),
forms AS (
  SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * c.n THEN best END AS form, CASE WHEN m >= 10 * c.n THEN m END AS form_n
  FROM counted c LEFT JOIN near USING (word)),
follow(word, goal) AS (SELECT word, word FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON f.goal = g.word WHERE g.form IS NOT NULL),
roots AS (SELECT f.word, f.goal AS root FROM follow f JOIN forms g ON f.goal = g.word WHERE g.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""


#: The conversation that the chat query adds: control strings in both its turns.
ODD_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back

    turns = load(_ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    windows = written(format_chats(turns.union(more), vocabulary_path("byte_bpe_50k.json")), "chat-windows")
    return read_back(windows)


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
named AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS name FROM turns),
sized AS (
  SELECT *, 24 + list_sum(list_transform([name, text], lambda x: length(regexp_replace(regexp_replace(x,
    '<(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')))) AS size FROM named)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_masked_lm_score": op2_masked_lm_score,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_token_rans": op4_token_rans,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_weighted_mix": op7_weighted_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_filter": op9_url_filter,
    "op10_pack_documents": op10_pack_documents,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_chat_windows": op13_chat_windows,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op3_embedding_near_dedup": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op7_weighted_mix": OP7_SQL,
    "op9_url_filter": OP9_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_chat_windows": OP13_SQL,
}
