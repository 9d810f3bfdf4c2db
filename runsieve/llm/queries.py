"""The operators as registered queries over the given tables, with SQL where SQL can state the result.

Every query reads its whole tables and gets its rows through its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.llm import (
    collocations,
    compression,
    conversations,
    cover_tree,
    decontam,
    language_mix,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    pii,
    sharding,
    warc,
)
from runsieve.llm.common import LOWER, UPPER, read_table

#: Fixed values of the contracts.
QUALITY_CUT, QUALITY_FOLDS, QUALITY_HELD = 0.7, 4, 2
LANGUAGE_FOLDS, LANGUAGE_HELD = 3, 1
COSINE = 0.95
JOIN_WORDS, JOIN_PERCENT = 3, 90
LINE_DOCS = 10
SHARDS = 24
TOKENIZER = "word_bpe_49k.json"

_LOWER = f"'{UPPER}', '{LOWER}'"


def _fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def _held(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(_fold(doc_id, folds) == held, F.lit(False))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), _held(F.col("doc_id"), QUALITY_FOLDS, QUALITY_HELD)
    scores = compression.quality_scores(docs, read_table(spark, sf_dir, "labels").filter(~held))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), _held(F.col("doc_id"), LANGUAGE_FOLDS, LANGUAGE_HELD)
    found = language_mix.languages(docs, docs.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.linked_vectors(read_table(spark, sf_dir, "embeddings"), COSINE)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    kinds = F.col("pii.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, name))).cast("bigint").alias(f"n_{name}") for name in pii.BASE_KINDS]
    base = pii.span_list(F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS)))
    score = F.round(F.coalesce(F.array_max("pii.score"), F.lit(0.0)), 2)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans"), score.alias("top_score"))


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("_t")


def common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"), LINE_DOCS)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read_table(spark, sf_dir, "documents"), JOIN_WORDS, JOIN_PERCENT)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(read_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"),
    )


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage; a dropped row stays as a marker so that its conversation stays known."""
    blank = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))), F.lit(20))
    text = F.coalesce("text", blank)
    harmed = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return harmed.drop("copy")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(damaged(read_table(spark, sf_dir, "conversations"))).drop("rows")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compression_quality": quality,
    "op2_language_mixture": language,
    "op3_poisson_mixing": mixed,
    "op4_cover_tree": near_vectors,
    "op5_pii": personal_data,
    "op6_warc_chain": archives,
    "op7_positional_index": benchmark_hits,
    "op8_line_dedup": common_lines,
    "op9_ngram_join": near_documents,
    "op10_two_pass_shards": shards,
    "op11_harmonic_packing": packed,
    "op12_phrase_collocations": phrases,
    "op13_conversation_repair": repaired,
}

_REACH = """reach AS (
  SELECT id, id AS other FROM nodes
  UNION
  SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a
)"""

ORACLES: dict[str, str] = {
    "op3_poisson_mixing": f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source
), whole AS (SELECT sum(bytes)::DOUBLE AS total FROM sizes),
weights AS (SELECT source, bytes, CASE WHEN bytes > 0 THEN pow(bytes / total, {mixing.TEMPERATURE}) ELSE 0 END AS w FROM sizes, whole),
mass AS (SELECT sum(w) AS m FROM weights),
rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN {mixing.EPOCHS} * w / m * total / bytes ELSE {mixing.EPOCHS} END AS rate FROM weights, mass, whole
), parts AS (SELECT source, rate, greatest(ceil(rate / {mixing.PART_RATE}), 1)::INT AS parts FROM rates),
cdf AS (
  SELECT source, parts, rate / parts AS r, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c FROM parts
  UNION ALL
  SELECT source, parts, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k < ceil(r + 10 * sqrt(r) + 40)
), tables AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, parts),
keys AS (
  SELECT documents.*, cs, unnest(range(1, parts + 1)) AS part FROM documents JOIN tables ON documents.source IS NOT DISTINCT FROM tables.source
), draws AS (
  SELECT doc_id, len(list_filter(cs, lambda c: ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 >= c)) AS n
  FROM keys
), counts AS (SELECT doc_id, sum(n)::INT AS n FROM draws GROUP BY doc_id)
SELECT documents.*, unnest(range(0, n))::INT AS copy FROM documents JOIN counts ON documents.doc_id IS NOT DISTINCT FROM counts.doc_id""",
    "op4_cover_tree": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x, nodes y WHERE x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= {COSINE}
), {_REACH},
groups AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM groups LEFT JOIN counts ON id = a""",
    "op6_warc_chain": """
WITH alphabet AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc),
hashed AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
coded AS (
  SELECT page_id, html, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda n: substr(abc, ((('0x' || substr(hex, i * 5 + 1, 5))::INT >> n) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM hashed, alphabet
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM coded)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts""",
    "op7_positional_index": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least({decontam.WINDOW}, len(w)) AS n, list_aggregate(w[i:i + least({decontam.WINDOW}, len(w)) - 1], 'string_agg', ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least({decontam.WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
which AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * {decontam.HIT_SHARE} >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN which USING (doc_id)""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS k FROM lines
), common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {LINE_DOCS})
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY doc_id""",
    "op9_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {JOIN_WORDS} THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - {JOIN_WORDS} + 2), lambda i: list_aggregate(w[i:i + {JOIN_WORDS} - 1], 'string_agg', ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM both_ JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {JOIN_PERCENT} * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n ON id = n.doc_id GROUP BY id""",
    "op12_phrase_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS s FROM documents
), words AS (SELECT lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, k, list_aggregate(p, 'string_agg', ' ') AS phrase, count(*) AS f, any_value(p) AS p FROM (
    SELECT lang, k, w[i:i + k - 1] AS p FROM (
      SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, {collocations.MAX_WORDS + 1})) AS k) WHERE len(w) >= k))
  GROUP BY lang, k, phrase HAVING count(*) >= {collocations.MIN_COUNT}
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, n, j, (1000 * c.f::HUGEINT * n) // (h.f::HUGEINT * t.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN totals USING (lang)
  JOIN f h ON h.lang = c.lang AND h.phrase = list_aggregate(c.p[1:j], 'string_agg', ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = list_aggregate(c.p[j + 1:c.k], 'string_agg', ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, f, list_aggregate(p[i:i + m - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))
), longer AS (SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY lang, phrase),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < {collocations.SUBSUMED_PERCENT} * a, true)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {collocations.TOP}""",
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT c AS first, list_reduce(range(0, 8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, c) AS code
  FROM (SELECT unnest(range(0, 256)) AS c)
), table_ AS (SELECT list(code ORDER BY first) AS codes FROM crc),
keyed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT),
      lambda x, b: xor(x >> 8, codes[(xor(x, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM keyed, table_
), harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END))
  FROM marked WHERE kind <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
judged AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed
), r AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS m
  FROM r GROUP BY conv_id
), places(q, next, role, edits) AS (
  -- 0 nothing yet, 1 after a system row, 2 after user, 3 after assistant; up to two inserted rows before the next edit.
  VALUES (0, 2, 'user', ''), (1, 2, 'user', ''), (2, 3, 'assistant', ''), (3, 2, 'user', '')
), jumps AS (
  SELECT q AS p, q, 0 AS cost, '' AS edits, '' AS added FROM places
  UNION ALL SELECT q, next, 3, 'I', chr(10) || role || ':' FROM places
  UNION ALL SELECT x.q, y.next, 6, 'II', chr(10) || x.role || ':' || chr(10) || y.role || ':' FROM places x JOIN places y ON x.next = y.q
), search AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': '', 'said': ''} AS best FROM counts
  UNION ALL
  SELECT conv_id, i + 1, q, min({'cost': cost, 'audit': audit, 'said': said}) FROM (
    SELECT s.conv_id, s.i, CASE e WHEN 'D' THEN j.q WHEN 'R' THEN p.next ELSE CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
      s.best.cost + j.cost + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 3 ELSE 0 END AS cost,
      s.best.audit || j.edits || e AS audit,
      s.best.said || j.added || CASE e WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || p.role || ':' || r.text ELSE chr(10) || r.role || ':' || r.text END AS said
    FROM search s JOIN jumps j ON s.q = j.p JOIN places p ON p.q = j.q JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
      CROSS JOIN (SELECT unnest(['D', 'K', 'R']) AS e)
    WHERE e = 'D' OR (fault NOT IN ('b', 'd') AND (e = 'R' OR (j.q = 0 AND initial IN ('s', 'u')) OR (j.q IN (1, 3) AND initial = 'u') OR (j.q = 2 AND initial = 'a')))
  ) GROUP BY conv_id, i, q
), ends AS (
  SELECT s.conv_id, min({'cost': s.best.cost + j.cost, 'audit': s.best.audit || j.edits, 'said': s.best.said || j.added}) AS best
  FROM search s JOIN jumps j ON s.q = j.p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.m = s.i WHERE j.q IN (0, 3) GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.said, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
