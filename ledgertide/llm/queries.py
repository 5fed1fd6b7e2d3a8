"""Registered queries of the operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgertide.llm import (
    conversation_repair, exact_dedup, jaccard_join, licenses, lm_scoring, mixing, packing, pii, quality_rules, topk, toxicity,
    warc, whitening,
)
from ledgertide.llm.work import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(prepare(spark), folder)
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_exact_dedup", """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size
      FROM documents WINDOW same AS (PARTITION BY coalesce(text, '')))""")
def op1(spark, folder):
    found = exact_dedup.find_copies(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_jaccard_join")
def op2(spark, folder):
    found = jaccard_join.similar(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links")


@query("op3_lm_scoring")
def op3(spark, folder):
    return lm_scoring.score(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_pii")
def op4(spark, folder):
    found = pii.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spelled(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query("op5_mixing")
def op5(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), mixing.Target(entropy=0.95))
    return mixed.select("doc_id", "source", "tokens", "weight", "copy", "begin", "position", "entropy", "met")


@query("op6_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""")
def op6(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


@query("op7_licenses")
def op7(spark, folder):
    return licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_toxicity")
def op8(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc.doc_id", toxicity.held_out(F.col("doc.doc_id").cast("string")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentence_start", "sentence_end", "sentence_score",
    )


@query("op9_packing")
def op9(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), as_bytes=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
b AS (SELECT *, list_transform(range(1, 41), lambda k: CAST(strpos('0123456789abcdef', x[k]) - 1 AS INTEGER)) AS n FROM d),
q AS (SELECT *, flatten(list_transform(n, lambda v: [v // 8, (v // 4) % 2, (v // 2) % 2, v % 2])) AS bits FROM b)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         16 * bits[5*j+1] + 8 * bits[5*j+2] + 4 * bits[5*j+3] + 2 * bits[5*j+4] + bits[5*j+5] + 1 AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q""")
def op10(spark, folder):
    archive = warc.write_archive(table(spark, folder, "pages").select("page_id", "url", "html"))
    return warc.read_summary(archive)


def _quality_sql() -> str:
    """The rules and their ladders as rows, tested with the exact binomial sum."""
    ladder, rules = [], quality_rules.RULES
    for k, rule in enumerate(rules):
        for place, cutoff in enumerate(rule.cutoffs):
            sides = f"{rule.factor} * {rule.signal} {'<' if rule.low else '>'} {cutoff} * {rule.base}"
            ladder.append(f"SELECT doc_id, g, {k} AS rule, {place} AS place, {sides} AS rejects FROM m")
    share, level = f"({quality_rules.LIMIT}::DOUBLE / {len(rules)})", f"{quality_rules.DELTA}::DOUBLE / {len(rules)}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS g, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
v AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM w, unnest(range(1, greatest(len(w) - 6, 1))) AS u(i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM v),
p AS (SELECT r, sum(least(8, coalesce(next_i - i, 8)))::BIGINT AS n FROM
      (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next_i FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, g, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals, len(list_distinct(w))::BIGINT AS n_distinct,
      len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(p.n, 0)::BIGINT AS n_repeat_words, w.r FROM w LEFT JOIN p USING (r)),
a AS ({' UNION ALL '.join(ladder)}),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
h AS (SELECT g, rule, place, doc_id, bool_or(rejects) AS rejects FROM a JOIN good USING (doc_id) GROUP BY ALL),
k AS (SELECT g, rule, place, count(*) AS n, count(*) FILTER (rejects) AS k FROM h GROUP BY ALL),
s AS (SELECT count(DISTINCT coalesce(g, '(none)')) AS strata FROM k),
q AS (SELECT *, CASE WHEN k >= n * {share} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS p
      FROM k),
o AS (SELECT g, rule, place, bool_and(p <= {level} / strata) OVER (PARTITION BY g, rule ORDER BY place) AS held FROM q, s),
b AS (SELECT g, rule, max(place) AS place FROM o WHERE held GROUP BY ALL),
bad AS (SELECT DISTINCT m.r FROM m JOIN b ON m.g IS NOT DISTINCT FROM b.g
        WHERE {" OR ".join(
            f"(rule = {k} AND place = {place} AND {rule.factor} * {rule.signal} {'<' if rule.low else '>'} {cutoff} * {rule.base})"
            for k, rule in enumerate(rules) for place, cutoff in enumerate(rule.cutoffs))}),
f AS (SELECT *, n_words < {quality_rules.LEAST_WORDS}
      OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f"""


@query("op11_quality_rules", _quality_sql())
def op11(spark, folder):
    found = quality_rules.scan(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: CRC-32 of a text's bytes, its table worked out from the polynomial.
CRC_SQL = """
t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, j:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t)"""


@query("op12_conversation_repair", f"""
WITH RECURSIVE {CRC_SQL.strip()},
k AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: xor(c // 256, t.t[xor(c % 256, x) + 1]), 4294967295::BIGINT)) % 20 AS k
      FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), t),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM k, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
      left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS initial_before FROM o),
c AS (SELECT DISTINCT conv_id FROM conversations),
moves(before, initial, after, name) AS (VALUES ('', 's', 's', ''), ('', 'u', 'u', 'user'), ('s', 'u', 'u', 'user'),
      ('a', 'u', 'u', 'user'), ('u', 'a', 'a', 'assistant')),
-- turns put in before a row, then what becomes of it
put(before, here, letters, said) AS (VALUES ('', '', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
      ('', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']), ('a', 'u', 'I', ['user:']),
      ('', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])),
walk AS (SELECT conv_id, 0::BIGINT AS n, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM c
  UNION ALL
  SELECT conv_id, n, state, best.cost, best.audit, best.said FROM (
    SELECT conv_id, n, state, min({{'cost': cost, 'audit': audit, 'said': said}}) AS best FROM (
      SELECT w.conv_id, f.n, p.here AS state, w.cost + 5 * len(p.letters) + 2 AS cost, w.audit || p.letters || 'D' AS audit,
             list_concat(w.said, p.said) AS said
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN put p ON p.before = w.state
      UNION ALL
      SELECT w.conv_id, f.n, m.after, w.cost + 5 * len(p.letters) + x.cost + CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END,
             w.audit || p.letters || x.edit,
             list_concat(list_concat(w.said, p.said), [CASE x.edit WHEN 'K' THEN f.role ELSE m.name END || ':' || f.text])
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN put p ON p.before = w.state
      JOIN moves m ON m.before = p.here
      JOIN (VALUES ('K', 0), ('R', 1)) AS x(edit, cost) ON x.edit = 'R' AND m.name <> '' OR x.edit = 'K' AND m.initial = f.initial
      WHERE f.fault NOT IN ('blank', 'duplicate')) GROUP BY conv_id, n, state)),
last AS (SELECT w.conv_id, min({{'cost': w.cost + 5 * len(p.letters), 'audit': w.audit || p.letters,
                                'said': list_concat(w.said, p.said)}}) AS best
  FROM walk w LEFT JOIN (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN put p ON p.before = w.state AND p.here IN ('', 'a') WHERE w.n = coalesce(e.n, 0) GROUP BY w.conv_id),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (initial_before IS NOT NULL AND initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM last l LEFT JOIN faults x ON x.conv_id IS NOT DISTINCT FROM l.conv_id""")
def op12(spark, folder):
    rows = conversation_repair.marked(conversation_repair.damage(table(spark, folder, "conversations")))
    return conversation_repair.summary(rows)


@query("op13_whitening")
def op13(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
