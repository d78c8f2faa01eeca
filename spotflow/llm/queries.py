"""Registered queries of the corpus operators and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .pieces import SPACE, as_unigrams, encode, load_model, unit_paths
from . import quality
from .lmscore import score_texts
from .simjoin import jaccard_components
from .substr import deduplicate
from .chat import conversations, link_quotes, with_quotes
from .langid import held_out, identify, train
from .media import document_media, interleaved, media_store, read_features
from .decontam import contamination
from .repair import damaged, repaired_parts, summaries
from .rules import COVERED_PERCENT, LONGEST, REPEAT_WORDS, repetition
from .tokens import count_tokens
from .whiten import by_component, whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, list_slice(ws, i, i + least(10, len(ws)) - 1) AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), w AS (
  SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)
), h AS (
  SELECT w.doc_id, w.i, w.n, p.item_id FROM w JOIN p ON w.n = p.n AND w.win = p.win
), c AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))


@query
def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of `pages`, their media resolved among the payloads of `documents`: how many items of which sort, and the texts."""
    features = read_features(media_store(table(spark, sf_dir, "documents")))
    made = interleaved(table(spark, sf_dir, "pages").select("page_id", "html"), stored(features, "features"))
    texts = F.filter("sequence", lambda i: i["kind"] == "text")
    media = F.filter("sequence", lambda i: i["ref"].isNotNull())
    return made.select("page_id", F.size("sequence").alias("n_items"), F.size(texts).alias("n_texts"), F.size(media).alias("n_media"), F.sha2(F.concat_ws("\n", F.transform(texts, lambda i: i["text"])), 256).alias("texts_sha256"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nobody quotes in `conversations`: with_quotes() lets every message quote up to three before it, at as many levels."""
    linked = link_quotes(with_quotes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    made = conversations(linked)
    return made.select("conv_id", "part", "n_messages", "n_linked", F.concat_ws(",", F.col("turns").cast("array<string>")).alias("turns"), F.sha2("chat", 256).alias("chat_sha256"))


ORACLES["op5_chat_format"] = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS own, turn % 4 AS depth,
         lag(text, 1) OVER o AS q1, lag(text, 2) OVER o AS q2, lag(text, 3) OVER o AS q3
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)
), body AS (
  SELECT conv_id, turn, role, trim(own, E' \t\n\r') AS content FROM m
), said AS (
  SELECT conv_id, turn, 0 AS kind, content AS part FROM body
  UNION ALL SELECT conv_id, turn, 1, unnest(regexp_split_to_array(content, '\n\s*\n')) FROM body
  UNION ALL SELECT conv_id, turn, 2, unnest(string_split(content, chr(10))) FROM body
), said_normal AS (
  SELECT conv_id, turn, kind, trim(trim(regexp_replace(lower(part), '\s+', ' ', 'g')), '"''“”„«»‚‘’ ….') AS part FROM said
), first_said AS (
  SELECT conv_id, part, min(turn) AS first_turn, arg_min(kind, turn * 3 + kind) AS kind FROM said_normal WHERE part <> '' GROUP BY conv_id, part
), quoted AS (
  SELECT conv_id, turn, 1 AS level, trim(q1, E' \t\n\r') AS passage FROM m WHERE depth >= 1 AND q1 IS NOT NULL
  UNION ALL SELECT conv_id, turn, 2, trim(q2, E' \t\n\r') FROM m WHERE depth >= 2 AND q2 IS NOT NULL
  UNION ALL SELECT conv_id, turn, 3, trim(q3, E' \t\n\r') FROM m WHERE depth >= 3 AND q3 IS NOT NULL
), asked AS (
  SELECT conv_id, turn, level, passage AS part FROM quoted
  UNION SELECT conv_id, turn, level, unnest(regexp_split_to_array(passage, '\n\s*\n')) FROM quoted
  UNION SELECT conv_id, turn, level, unnest(string_split(passage, chr(10))) FROM quoted
), asked_normal AS (
  SELECT conv_id, turn, level, trim(trim(regexp_replace(lower(part), '\s+', ' ', 'g')), '"''“”„«»‚‘’ ….') AS part FROM asked
), best AS (
  SELECT a.conv_id, a.turn, min(row(a.level, f.kind, f.first_turn)) AS b
  FROM asked_normal a JOIN first_said f ON a.conv_id = f.conv_id AND a.part = f.part AND f.first_turn < a.turn GROUP BY a.conv_id, a.turn
), linked AS (
  SELECT body.*, (b).f3 AS reply_to FROM body LEFT JOIN (SELECT conv_id, turn, struct_pack(f1 := b[1], f2 := b[2], f3 := b[3]) AS b FROM best) USING (conv_id, turn)
), walk(conv_id, turn, path) AS (
  SELECT conv_id, turn, [turn] FROM linked WHERE reply_to IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, list_append(w.path, l.turn) FROM linked l JOIN walk w ON l.conv_id = w.conv_id AND l.reply_to = w.turn
), placed AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS place FROM walk
), slots AS (
  SELECT conv_id, turn // 256 AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM linked
)
SELECT l.conv_id, CAST(s.part AS BIGINT) AS part, count(*) AS n_messages, count(l.reply_to) AS n_linked,
       string_agg(CAST(l.turn AS VARCHAR), ',' ORDER BY p.place) AS turns,
       sha256(string_agg('<|' || coalesce(l.role, '') || '|>' || chr(10) || l.content, chr(10) ORDER BY p.place)) AS chat_sha256
FROM linked l JOIN placed p ON l.conv_id = p.conv_id AND l.turn = p.turn JOIN slots s ON s.conv_id = p.conv_id AND s.place = p.place
GROUP BY l.conv_id, s.part
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op6_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, i, list_slice(ws, i, i + 12) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)
), m AS (
  SELECT win, min(doc_id) AS first_doc FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, pos FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 13)) AS pos FROM w JOIN m ON w.win = m.win WHERE m.first_doc < w.doc_id)
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d) p
  LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos WHERE g.pos IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + least(4, len(ws)) - 1) AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reached) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.quality_scores(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "ids_sha256", "round_trip")


@query
def viterbi_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viterbi as the fold: the best path of every distinct word of `documents` and `benchmark`, the model's scores read as log weights by rank."""
    model = load_model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "benchmark").select("text"))
    words = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("word")).where("word <> ''").distinct()
    return unit_paths(words.select(F.lit(0).alias("number"), F.concat(F.lit(SPACE), "word").alias("unit"), F.lit(None).cast("binary").alias("whole")), as_unigrams(model))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(*repaired_parts(damaged(table(spark, sf_dir, "conversations"))))


#: crc32 by its table; then a program over the rows of each conversation, the best (cost, audit) of each state carried on.
ORACLES["op12_conversation_repair"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(0, 256) r(b))
), h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda x, c: xor(x // 256, t[xor(x & 255, c) + 1])), 4294967295) % 20 AS way
  FROM conversations, tab
), d AS (
  SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
         CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(0, 2) c(copy) WHERE way <> 0 AND (copy = 0 OR way = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         rtrim(text, E' \t\n\r\x0b\x0c') AS body
  FROM o
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n
), counted AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), w(conv_id, i, b) AS (
  SELECT conv_id, CAST(0 AS BIGINT), [struct_pack(q := 0, cost := CAST(0 AS BIGINT), audit := '', said := CAST([] AS VARCHAR[])),
    struct_pack(q := 2, cost := 3, audit := 'I', said := ['user:']), struct_pack(q := 3, cost := 6, audit := 'II', said := ['user:', 'assistant:'])] FROM counted
  UNION ALL
  SELECT conv_id, i, b FROM (
    WITH e AS (
      SELECT f.conv_id, f.i, f.role, f.text, f.c, f.fault, unnest(w.b) AS s FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    ), moved AS (
      SELECT conv_id, i, s.q AS q, s.cost + 4 AS cost, s.audit || 'D' AS audit, s.said AS said FROM e
      UNION ALL SELECT conv_id, i, CASE WHEN c = 's' THEN 1 WHEN c = 'u' THEN 2 ELSE 3 END, s.cost + CASE fault WHEN 't' THEN 3 ELSE 0 END, s.audit || 'K', list_append(s.said, role || ':' || text)
        FROM e WHERE fault NOT IN ('b', 'd') AND (c = 's' AND s.q = 0 OR c = 'u' AND s.q <> 2 OR c = 'a' AND s.q = 2)
      UNION ALL SELECT conv_id, i, CASE WHEN s.q = 2 THEN 3 ELSE 2 END, s.cost + 3 + CASE fault WHEN 't' THEN 3 ELSE 0 END, s.audit || 'R', list_append(s.said, CASE WHEN s.q = 2 THEN 'assistant:' ELSE 'user:' END || text)
        FROM e WHERE fault NOT IN ('b', 'd')
    ), put AS (
      SELECT * FROM moved
      UNION ALL SELECT conv_id, i, CASE WHEN q = 2 THEN 3 ELSE 2 END, cost + 3, audit || 'I', list_append(said, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END) FROM moved
      UNION ALL SELECT conv_id, i, CASE WHEN q = 2 THEN 2 ELSE 3 END, cost + 6, audit || 'II', list_concat(said, CASE WHEN q = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) FROM moved
    ), best AS (
      SELECT conv_id, i, q, min(struct_pack(q := q, cost := cost, audit := audit, said := said)) AS s FROM put GROUP BY conv_id, i, q
    )
    SELECT conv_id, i, list(s) AS b FROM best GROUP BY conv_id, i
  )
), done AS (
  SELECT w.conv_id, min(struct_pack(cost := s.cost, audit := s.audit, said := s.said)) AS s
  FROM (SELECT conv_id, i, unnest(b) AS s FROM w) w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rows = w.i WHERE s.q IN (0, 3) GROUP BY w.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit, sha256(coalesce(array_to_string(s.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", (F.col("longest_repeat") > LONGEST).alias("too_long"))


ORACLES["op13_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), w AS (
  SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (VALUES (3), ({REPEAT_WORDS}), ({LONGEST + 1})) v(k) WHERE len(ws) >= k)
), t AS (
  SELECT doc_id, k, list(i) AS places FROM w GROUP BY doc_id, k, win HAVING count(*) > 1
), c AS (
  SELECT doc_id, k, count(DISTINCT p) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM (SELECT doc_id, k, unnest(places) AS i FROM t)) GROUP BY doc_id, k
), n AS (
  SELECT doc_id, coalesce(max(n) FILTER (k = 3), 0) AS n_repeat_words, coalesce(max(n) FILTER (k = {REPEAT_WORDS}), 0) AS n_covered, coalesce(max(n) FILTER (k = {LONGEST + 1}), 0) > 0 AS too_long FROM c GROUP BY doc_id
), r AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(too_long, false) AS too_long
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= {COVERED_PERCENT} * n_words AND NOT too_long AS kept FROM r
"""
