"""The registered query of each operator, with production parameters over whole tables, and its DuckDB form where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, decontam, licenses, line_dedup, quality_pu, quality_rules, runs, simhash, suffix_dedup, toxicity, vectors, warc
from .common import cut, scratch
from .features import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), shorter=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (c.k IS NOT NULL AND c.keeper <> l.doc_id) AS gone
  FROM keyed l LEFT JOIN common c ON l.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, archive = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(_table(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, archive)
    records = cut(warc.read_warc(spark, archive, payloads=False), "records")
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p
), bits AS (
  SELECT *, list_reduce(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', hex[i]) - 1), 4)), lambda a, b: a || b) AS b FROM d
), named AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5*i+1]::INT + 8 * b[5*i+2]::INT + 4 * b[5*i+3]::INT + 2 * b[5*i+4]::INT + b[5*i+5]::INT]),
         lambda x, y: x || y) AS payload_digest FROM bits
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM named
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to
FROM firsts
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = bpe.share(spark, tokenizer_path())
    df = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), shared)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _verdicts(toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))), 0.5)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suffix_dedup.strip_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM d, unnest(range(0, n - 199)) AS t(i)
), starts AS (
  SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM starts
), islands AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM islands GROUP BY doc_id, g
), cuts AS (
  SELECT s.*, d.h, coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) AS last FROM spans s JOIN d USING (doc_id)
), kept AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS k
  FROM cuts GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win FROM w, unnest(range(1, len(ws) - 6)) AS t(i)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1
), cover AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id
), bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN n_repeat_words * 10 > n_words * 3 THEN 2 ELSE 0 END + CASE WHEN n_symbols * 4 > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines > 10 AND n_dup_lines > n_lines - n_dup_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < n_words * 2 THEN 16 ELSE 0 END
    + CASE WHEN word_chars > n_words * 40 THEN 32 ELSE 0 END + CASE WHEN n_words >= 20 AND n_upper * 4 > word_chars * 3 THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept
FROM bits
"""


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_pu.measure(_table(spark, sf_dir, "documents"))
    network = quality_pu.train_measured(measured, _table(spark, sf_dir, "labels"))
    return _verdicts(quality_pu.score_measured(measured, network), 0.3)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


OP11_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(r, c) AS (
  SELECT r, vec_id FROM v UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.r
), least AS (
  SELECT r, min(c) AS component_id FROM reach GROUP BY r
), counted AS (
  SELECT x AS r, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN counted USING (r)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures, turns = conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")), copies="copies")
    digests = conversations.text_digests(turns).withColumnRenamed("conv_id", "c")
    out = figures.join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *conversations.FIGURES, "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The CRC-32 of a text of ASCII characters, bit by bit: the polynomial of zlib.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda z, y: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)))"""

OP12_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT *, """ + CRC.format("k") + r""" % 20 AS what FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text) AS i FROM damaged
), f AS (
  SELECT *, lag(left(role, 1)) OVER c || left(role, 1) AS pair, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen
  FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY i)
), g AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS x FROM f
), e AS (
  SELECT *, fault IN ('b', 'd') AS gone, (fault = 't')::INT AS cut FROM g
), costs AS (
  -- lightest (cost, audit) by last initial kept: none, s, u, a; insertions come before the next turn
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS p0, {'c': 1000000000::BIGINT, 'a': ''} AS p1, {'c': 1000000000::BIGINT, 'a': ''} AS p2, {'c': 1000000000::BIGINT, 'a': ''} AS p3
  FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT n.conv_id, n.i, {'c': p0.c + 3, 'a': p0.a || 'D'},
         list_min([{'c': p1.c + 3, 'a': p1.a || 'D'}, {'c': CASE WHEN x = 's' AND NOT gone THEN p0.c + cut ELSE 1000000000 END, 'a': p0.a || 'K'}]),
         list_min([{'c': c2.c + 3, 'a': c2.a || 'D'}, {'c': CASE WHEN x = 'u' AND NOT gone THEN o.c + cut ELSE 1000000000 END, 'a': o.a || 'K'}, {'c': CASE WHEN NOT gone THEN o.c + cut + 2 ELSE 1000000000 END, 'a': o.a || 'R'}]),
         list_min([{'c': c3.c + 3, 'a': c3.a || 'D'}, {'c': CASE WHEN x = 'a' AND NOT gone THEN c2.c + cut ELSE 1000000000 END, 'a': c2.a || 'K'}, {'c': CASE WHEN NOT gone THEN c2.c + cut + 2 ELSE 1000000000 END, 'a': c2.a || 'R'}])
  FROM (
    SELECT *, list_min([p3, {'c': c2.c + 2, 'a': c2.a || 'I'}]) AS c3, list_min([p0, p1, list_min([p3, {'c': c2.c + 2, 'a': c2.a || 'I'}])]) AS o
    FROM (SELECT *, list_min([p2, {'c': p0.c + 2, 'a': p0.a || 'I'}, {'c': p1.c + 2, 'a': p1.a || 'I'}, {'c': p3.c + 2, 'a': p3.a || 'I'}]) AS c2 FROM costs)
  ) s JOIN e n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.i = s.i + 1
), best AS (
  SELECT conv_id, list_min([p0, p3, {'c': p2.c + 2, 'a': p2.a || 'I'}, {'c': p1.c + 4, 'a': p1.a || 'II'}]) AS b FROM costs
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), walk AS (
  SELECT conv_id, b.a AS audit, 0::BIGINT AS k, 0::BIGINT AS i, '' AS q, ''::VARCHAR AS lines FROM best
  UNION ALL
  SELECT w.conv_id, audit, k + 1, w.i + (step <> 'I')::INT, CASE WHEN step = 'D' THEN q WHEN step = 'K' THEN x ELSE nxt END,
         CASE WHEN step = 'D' THEN lines ELSE lines || CASE WHEN lines = '' THEN '' ELSE chr(10) END
           || CASE WHEN step = 'K' THEN role WHEN nxt = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN step = 'I' THEN '' ELSE text END END
  FROM (SELECT *, audit[k + 1] AS step, CASE WHEN q = 'u' THEN 'a' ELSE 'u' END AS nxt FROM walk WHERE k < length(audit)) w
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1
), told AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM e GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(w.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN told d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.k = length(w.audit)
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(runs.plant(_table(spark, sf_dir, "documents")))
    best = runs.longest(F.col("runs"))
    df = found.withColumn("best", best)
    length = -F.col("best.l")
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, """ + CRC.format("doc_id::VARCHAR") + r""" AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n, ws, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d
), raw AS (
  SELECT r, i, ws[i + 1] AS w FROM s, unnest(range(n)) AS u(i)
), places AS (
  SELECT r, n, i, CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END AS j FROM s, unnest(range(n)) AS u(i)
), w AS (
  SELECT p.r, p.n, p.i, raw.w FROM places p JOIN raw ON raw.r = p.r AND raw.i = p.j
), eq AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * 4 <= x.n
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM eq) GROUP BY r, q, grp
  HAVING count(*) + q >= greatest(6, 4 * q)
), found AS (
  SELECT * FROM stretches a WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.r = a.r AND b.q < a.q AND b.start <= a.start AND b.start + b.length >= a.start + a.length)
), gone AS (
  SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM found
), kept AS (
  SELECT w.r, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN gone ON gone.r = w.r AND gone.i = w.i GROUP BY w.r
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed,
         min({'l': -length, 's': start, 'q': q}) AS b FROM found GROUP BY r
)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, -b.l AS length, b.q AS period, 1000 * -b.l // b.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM s LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_line_dedup, op3_warc, op4_bpe, op5_toxicity, op6_suffix_dedup, op7_license_scan, op8_quality_rules, op9_quality_pu,
        op10_simhash_near_dedup, op11_embedding_near_dedup, op12_conversation_repair, op13_periodic_runs,
    )
}
ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL, "op11_embedding_near_dedup": OP11_SQL,
    "op12_conversation_repair": OP12_SQL, "op13_periodic_runs": OP13_SQL,
}
