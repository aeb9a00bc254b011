"""Statute queries: versions, tags, parsing, chunks and statistics, over texts and JSON that Spark makes from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import CIRCLED, clean, extract_tags
from ..operators import chunk, parse, versions
from .retrieval import table

QUERIES, SQL = {}, {}
TODAY = "2026-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH v AS (
  SELECT 'law ' || o_custkey AS name, strftime(o_orderdate, '%Y%m%d') AS eff, strftime(o_orderdate - to_days((o_orderkey % 3)::INT), '%Y%m%d') AS prom, o_orderkey AS serial FROM orders
), r AS (
  SELECT c_custkey * 3 + i AS request_id, 'law' || c_custkey AS name, ['19960101', '19980615', '20010101'][i + 1] AS on_date FROM customer, unnest(range(3)) AS t(i)
), m AS (
  SELECT r.request_id, v.*, row_number() OVER (PARTITION BY r.request_id ORDER BY eff DESC, prom DESC, serial DESC) AS n
  FROM r JOIN v ON replace(v.name, ' ', '') = r.name AND v.eff <= r.on_date
)
SELECT r.request_id, r.on_date, CASE WHEN m.serial IS NULL THEN 'skipped' ELSE 'chosen' END AS status, m.serial::VARCHAR AS serial, m.eff AS effective, r.name || '_' || m.eff || '.json' AS file_name
FROM r LEFT JOIN m ON m.request_id = r.request_id AND m.n = 1
""")
def version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of one law per customer, as of three dates each."""
    o = table(spark, sf_dir, "orders")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    v = o.select(
        F.concat(F.lit("law "), F.col("o_custkey").cast("string")).alias("name"), F.col("o_custkey").cast("string").alias("law_id"), F.col("o_orderkey").cast("string").alias("serial"),
        day(F.col("o_orderdate")).alias("effective"), day(F.date_sub(F.col("o_orderdate"), (F.col("o_orderkey") % 3).cast("int"))).alias("promulgated"), F.col("o_orderkey").alias("pos"),
    )
    dates = F.array(*map(F.lit, ("19960101", "19980615", "20010101")))
    r = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(dates).alias("i", "on_date"))
    r = r.select((F.col("c_custkey") * 3 + F.col("i")).alias("request_id"), F.concat(F.lit("law"), F.col("c_custkey").cast("string")).alias("name"), "on_date")
    plan = versions.fetch_plan(versions.pick_versions(v, r))
    return plan.select("request_id", "on_date", "status", "version.serial", "version.effective", "file_name")


@query(r"""
WITH t AS (SELECT doc_id, '<개정 2017.8.9, 2022.11.30>  ' || text || ' ' || chr(9) || chr(10) || ' ' || chr(10) || '<신설 2016.6.7> ' || chr(12288) || '<b>' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '<[^<>]*\d{4}\.\d{1,2}\.\d{1,2}[^<>]*>', '', 'g') AS a, regexp_extract_all(t, '<([^<>]*\d{4}\.\d{1,2}\.\d{1,2}[^<>]*)>', 1) AS tags FROM t),
b AS (SELECT doc_id, tags, regexp_replace(regexp_replace(regexp_replace(a, '[ \t　]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS b FROM a)
SELECT doc_id, md5(b) AS cleaned_md5, length(b)::BIGINT AS n_chars, array_to_string(tags, '|') AS tags FROM b
""")
def clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts between dated tags, cleaned; their tags."""
    text = F.concat(F.lit("<개정 2017.8.9, 2022.11.30>  "), F.col("text"), F.lit(" \t\n \n<신설 2016.6.7> 　<b>"))
    df = table(spark, sf_dir, "documents").select("doc_id", clean(text).alias("c"), extract_tags(text).alias("t"))
    return df.select("doc_id", F.md5("c").alias("cleaned_md5"), F.length("c").cast("long").alias("n_chars"), F.array_join("t", "|").alias("tags"))


@query("""
WITH l AS (SELECT length(text) AS len FROM documents WHERE text IS NOT NULL), r AS (SELECT len, row_number() OVER (ORDER BY len) AS i, count(*) OVER () AS n FROM l)
SELECT max(n) AS n_lengths, min(len)::INT AS len_min, min(len) FILTER (i = n // 2 + 1)::INT AS len_median, min(len) FILTER (i = (9 * (n - 1)) // 10 + 1)::INT AS len_p90, max(len)::INT AS len_max, count(*) FILTER (len > 1000) AS len_over_1000 FROM r
""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.length_picks(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.length("text").alias("length")))


@query(r"""
WITH p AS (
  SELECT doc_id, source, i AS n, ls[i] AS line, length(ls[i]) % 7 = 0 AS dead FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
), live AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM p WHERE NOT dead),
w AS (SELECT doc_id, any_value(source) AS source, any_value(m) AS m, string_agg(line, chr(10) ORDER BY n) FILTER (line <> '') AS body FROM live GROUP BY doc_id),
d AS (SELECT *, source || ' 제' || doc_id || '조' AS header FROM w), s AS (SELECT *, length(header) + length(coalesce(body, '')) <= 1000 OR m <= 1 AS whole FROM d),
c AS (
  SELECT doc_id, doc_id::VARCHAR || ':' || doc_id AS chunk_id, NULL::INT AS paragraph_no, header AS citation, header || chr(10) || coalesce(body, '') AS t FROM s WHERE whole
  UNION ALL
  SELECT s.doc_id, s.doc_id::VARCHAR || ':' || s.doc_id || ':p' || CASE WHEN l.n % 5 = 0 THEN l.k ELSE l.n END, CASE WHEN l.n % 5 <> 0 THEN l.n END::INT, header || CASE WHEN l.n % 5 = 0 THEN '' ELSE ' 제' || l.n || '항' END,
         header || CASE WHEN l.n % 5 = 0 THEN '' ELSE ' 제' || l.n || '항' END || chr(10) || l.line FROM s JOIN live l ON l.doc_id = s.doc_id WHERE NOT whole
)
SELECT doc_id, chunk_id, paragraph_no, citation, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS text_md5 FROM c
""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles and their lines as paragraphs, some deleted and some without a number."""
    d, line = F.col("doc_id").cast("string"), F.split("text", "\n", -1)
    none = F.array().cast("array<struct<no:string,text:string,children:array<struct<no:string,text:string>>>>")
    para = lambda x, i: F.struct(
        F.lit(None).cast("string").alias("no"), F.when((i + 1) % 5 != 0, i + 1).alias("number"), x.alias("text"), none.alias("items"), F.array().cast("array<string>").alias("amendments"),
        (F.length(x) % 7 == 0).alias("deleted"), F.lit(False).alias("expired"),
    )
    articles = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        d.alias("doc_key"), F.struct(d.alias("law_id"), F.col("source").alias("name"), d.alias("law_key")).alias("law"), F.lit(0).alias("pos"), d.alias("key"),
        F.concat(F.lit("제"), d, F.lit("조")).alias("label"), F.lit("").alias("title"), F.lit(None).cast("string").alias("chapter"), F.lit("").alias("head"), F.lit("valid").alias("status"),
        F.lit("").alias("effective_date"), F.transform(line, para).alias("paragraphs"),
    )
    c = chunk.chunk_articles(articles)
    return c.select(F.col("doc_key").cast("long").alias("doc_id"), "chunk_id", "paragraph_no", "citation", F.md5("text").alias("text_md5"))


#: The relations that statute_json() turns into JSON: a unit per order, a paragraph per line item.
UNITS = """
u AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey % 5 = 1 AS heading, o_orderkey % 900 + 1 AS num, CASE WHEN o_orderkey % 7 = 0 THEN 2 END AS br, o_orderkey % 6 AS note FROM orders
), a AS (
  SELECT *, '제' || num || '조' || CASE WHEN br = 2 THEN '의2' ELSE '' END AS label,
         last_value(CASE WHEN heading THEN CASE WHEN o_orderkey % 10 = 1 THEN '제' || num || '장 ' || o_orderpriority END END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY pos) AS chapter FROM u
), arts AS (SELECT *, o_orderkey % 11 = 0 AS dead FROM a WHERE NOT heading),
p AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 13 = 0 AS gone FROM lineitem l),
x AS (
  SELECT arts.*, (SELECT count(*) FROM p WHERE p.l_orderkey = arts.o_orderkey) AS n_paras, coalesce((SELECT bool_or(n IN (1, 3)) FROM p WHERE p.l_orderkey = arts.o_orderkey), false) AS hit FROM arts
), st AS (
  SELECT *, CASE WHEN dead THEN 'deleted' WHEN note = 1 THEN 'expired' WHEN note = 2 AND hit THEN 'partially_expired' ELSE 'valid' END AS status,
         CASE note WHEN 1 THEN 'article' WHEN 2 THEN 'paragraphs' WHEN 3 THEN 'partial' WHEN 4 THEN 'unknown' WHEN 5 THEN 'article' END AS scope FROM x
)
"""


def statute_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, doc): a statute per customer. Headings, branch articles, deleted articles and paragraphs, notes of every
    scope; paragraphs as a list, one object or nothing, texts plain or as lists. Rows are dealt out as they are, and JSON, which is
    much longer, is written where its document is put together."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    s = lambda c: c.cast("string")
    said = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    quoted = lambda c: F.when(c.rlike(r'["\\\x00-\x1F]'), F.btrim(F.to_json(F.array(c)), F.lit("[]"))).otherwise(said(c))
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("ls"))

    def para(x: Column, i: Column) -> Column:
        circled = F.substring(F.lit(CIRCLED), i + 1, F.lit(1))
        body = F.when(x["l_partkey"] % 13 == 0, F.concat(circled, F.lit(" 삭제 <2022.11.30>"))).otherwise(F.concat(circled, F.lit("  부품 "), s(x["l_partkey"]), F.lit(" <개정 2020.2."), s(x["l_suppkey"] % 9 + 1), F.lit(">")))
        text = F.when(x["l_partkey"] % 3 == 0, F.concat(F.lit("["), said(body), F.lit(',"",["끝"]]'))).otherwise(said(body))
        item = obj(pair("호번호", F.lit('"9의2. "')), pair("호내용", quoted(F.concat(F.lit(" 종류 "), x["l_returnflag"]))), pair("목", obj(pair("목번호", F.lit('"가."')), pair("목내용", said(s(x["l_suppkey"]))))))
        return obj(pair("항번호", said(circled)), pair("항내용", text), F.when(x["l_suppkey"] % 2 == 0, pair("호", item)))

    num, br = s(F.col("o_orderkey") % 900 + 1), F.col("o_orderkey") % 7 == 0
    label = F.concat(F.lit("제"), num, F.lit("조"), F.when(br, "의2").otherwise(""))
    k = F.col("o_orderkey")
    content = F.when(k % 5 == 1, F.when(k % 10 == 1, F.concat(F.lit(" 제"), num, F.lit("장  "), F.col("o_orderpriority"), F.lit(" <개정 2016.6.7>"))).otherwise("  ")).when(
        k % 11 == 0, F.concat(label, F.lit(" 삭제 <2013.10.2>"))
    ).otherwise(F.concat(label, F.lit("("), F.col("o_orderpriority"), F.lit(") 머리 "), F.col("o_orderstatus"), F.lit(" <개정 2017.8.9>")))
    until = F.lit("의 개정규정은 2022년 12월 31일까지 유효함]")
    note = (
        F.when(k % 6 == 1, F.concat(F.lit("[법 제1조 및 "), label, until)).when(k % 6 == 2, F.concat(F.lit("["), label, F.lit("제1항, "), label, F.lit("제3항"), until))
        .when(k % 6 == 3, F.concat(F.lit("[이 조 제2항제1호"), until)).when(k % 6 == 4, F.concat(F.lit("[법 "), label, until)).when(k % 6 == 5, F.concat(F.lit("["), label, F.lit("의 개정규정은 2030년 1월 5일까지 효력]")))
    )
    listed = lambda n, parts: F.concat(F.when(n > 1, "[").otherwise(""), F.array_join(parts, ","), F.when(n > 1, "]").otherwise(""))
    hang = F.when(F.size("ls") > 0, pair("항", listed(F.size("ls"), F.transform("ls", para))))
    unit = obj(
        pair("조문번호", said(num)), F.when(br, pair("조문가지번호", F.lit("2"))), pair("조문키", said(s(k))), pair("조문제목", quoted(F.col("o_orderpriority"))), pair("조문내용", quoted(content)),
        pair("조문여부", F.when(k % 5 == 1, F.lit('"전문"')).otherwise(F.lit('"조문"'))), pair("조문변경여부", F.lit('"Y"')), F.when(note.isNotNull(), pair("조문참고자료", said(note))), hang,
    )
    units = o.join(lines, F.col("l_orderkey") == k, "left").repartition("o_custkey").select("o_custkey", "o_orderkey", unit.alias("unit"))
    docs = units.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "unit"))).alias("us"))
    base = obj(pair("법령ID", said(s(F.col("o_custkey")))), pair("법령명_한글", said(F.concat(F.lit("법률 "), s(F.col("o_custkey"))))), pair("소관부처", F.lit('{"content":"부처"}')))
    text = F.concat(F.lit('{"법령":'), obj(pair("법령키", said(s(F.col("o_custkey")))), pair("기본정보", base), pair("조문", obj(pair("조문단위", listed(F.size("us"), F.col("us.unit")))))), F.lit("}"))
    # Out of a generator, as a filter would else be moved below the parser and parse a document for each of its conditions.
    return docs.select(s(F.col("o_custkey")).alias("doc_key"), F.explode(F.array(F.parse_json(text))).alias("doc"))


@query(f"""WITH {UNITS} SELECT o_orderkey AS key, '법률 ' || o_custkey AS law_name, label, br AS branch, chapter, status, scope, n_paras::INT AS n_paragraphs,
  coalesce((SELECT count(*) FROM p WHERE l_orderkey = o_orderkey AND gone AND l_partkey % 3 <> 0), 0)::INT AS n_deleted,
  CASE WHEN status = 'partially_expired' THEN (SELECT count(*) FROM p WHERE l_orderkey = o_orderkey AND n IN (1, 3)) ELSE 0 END::INT AS n_expired,
  CASE WHEN dead THEN '2013.10.2' ELSE '개정 2017.8.9' END AS first_tag,
  1 + (SELECT count(DISTINCT CASE WHEN gone THEN 'x' ELSE (l_suppkey % 9)::VARCHAR END) FROM p WHERE l_orderkey = o_orderkey) AS n_tags,
  CASE WHEN dead THEN '삭제' ELSE '머리 ' || o_orderstatus END || coalesce((SELECT string_agg(chr(10) ||
    substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', n, 1) || CASE WHEN gone THEN ' 삭제' ELSE ' 부품 ' || l_partkey END || CASE WHEN l_partkey % 3 = 0 THEN chr(10) || '끝' ELSE '' END
    || CASE WHEN l_suppkey % 2 = 0 THEN chr(10) || '종류 ' || l_returnflag || chr(10) || l_suppkey ELSE '' END, '' ORDER BY n) FROM p WHERE l_orderkey = o_orderkey AND NOT (gone AND l_partkey % 3 <> 0)), '') AS text
  FROM st""")
def parse_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a statute per customer, out of polymorphic JSON."""
    a = parse.parse_documents(parse.split_errors(statute_json(spark, sf_dir))[0], TODAY)[1]
    return a.select(
        F.col("key").cast("long").alias("key"), F.col("law.name").alias("law_name"), "label", "branch", "chapter", "status", F.col("expiry.scope").alias("scope"), F.size("paragraphs").alias("n_paragraphs"),
        F.size(F.filter("paragraphs", lambda p: p["deleted"])).alias("n_deleted"), F.size(F.filter("paragraphs", lambda p: p["expired"])).alias("n_expired"), F.col("amendments")[0].alias("first_tag"),
        F.size("amendments").cast("long").alias("n_tags"), "text",
    )


@query(f"""WITH {UNITS} SELECT count(*) AS articles, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'expired') AS expired,
  count(*) FILTER (status = 'partially_expired') AS partially_expired, count(*) FILTER (note <> 0) AS with_note, count(*) FILTER (br = 2) AS with_branch, count(DISTINCT chapter) AS chapters FROM st""")
def article_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunk.summarize(parse.parse_articles(statute_json(spark, sf_dir), TODAY))
    return s.select("articles", "valid", "deleted", "expired", "partially_expired", "with_note", "with_branch", "chapters")


@query(f"""WITH {UNITS} SELECT o_orderkey AS key, status, CASE scope WHEN 'paragraphs' THEN 'paragraphs 1, 3' ELSE scope END AS scope, CASE WHEN note = 5 THEN DATE '2030-01-05' ELSE DATE '2022-12-31' END::VARCHAR AS until, note <> 5 AS expired FROM st WHERE scope IS NOT NULL""")
def expiry_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = parse.parse_articles(statute_json(spark, sf_dir), TODAY)
    marked = a.withColumn("title", F.col("key"))  # the review names articles by title
    r = chunk.expiry_review(marked)
    return r.select(F.col("title").cast("long").alias("key"), "status", "scope", F.col("until").cast("string").alias("until"), "expired")
