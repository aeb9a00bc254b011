"""Answer queries: prompts, citation checks, messages and scores, over replies that Spark makes from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import answers, evaluate
from .retrieval import FAMILY, table

QUERIES, SQL = {}, {}
W = answers.Wording()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH c AS (SELECT conv_id AS qid, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE turn > 0),
q AS (SELECT DISTINCT conv_id AS qid FROM conversations), f AS (SELECT conv_id AS qid, text FROM conversations WHERE turn = 0),
b AS (SELECT qid, string_agg('[조문 ' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS blocks FROM c GROUP BY qid)
SELECT q.qid, md5(coalesce(b.blocks, '') || chr(10) || chr(10) || '{W.question}' || chr(10) || coalesce(f.text, '') || chr(10) || chr(10) || '{W.reminder}') AS prompt_md5
FROM q LEFT JOIN f USING (qid) LEFT JOIN b USING (qid)
""")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a conversation is the question, its other turns are the context."""
    c = table(spark, sf_dir, "conversations")
    questions = c.groupBy(F.col("conv_id").alias("qid")).agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("question"))
    contexts = c.where("turn > 0").select(F.col("conv_id").alias("qid"), F.col("turn").cast("int").alias("rank"), "text")
    return answers.build_prompts(questions, contexts, W).select("qid", F.md5("prompt").alias("prompt_md5"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per turn: valid, fenced, truncated, refusing, citing outside of what was retrieved, or citing in the text only."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 100 + F.col("turn")
    m, a = n % 8, (n % 90 + 1).cast("string")
    cite = lambda law, article: F.concat(F.lit(law + " 제"), article, F.lit("조"))
    listed = F.when(m.isin(0, 1, 2), F.array(F.concat(cite("보기나무법", a), F.lit(" 제1항")), cite("보기나무법시행령", a))).when(m == 3, F.array(cite("보기나무법", F.concat(a, F.lit("9"))))).otherwise(F.array().cast("array<string>"))
    answer = F.when(m == 5, F.lit(" ")).when(m == 6, F.concat(F.lit("휴일 안내 ["), cite("보기나무법", a), F.lit("의2] 참고"))).otherwise(F.concat(F.lit("안내 "), a))
    flag = F.when(m == 4, False).otherwise(True)
    body = F.to_json(F.struct(flag.alias("answerable"), F.when(m == 4, "범위 밖").otherwise("").alias("reason"), answer.alias("answer"), listed.alias("citations")))
    raw = F.when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(m == 7, F.substring(body, 1, 20)).otherwise(body)
    ref = lambda law, article: F.struct(F.lit(law).alias("law"), F.concat(F.lit("제"), a, F.lit(article)).alias("article"))
    return c.select(n.alias("qid"), raw.alias("raw"), F.array(ref("보기나무법", "조"), ref("보기나무법", "조의2")).alias("retrieved"))


#: The same verdicts, from the numbers alone.
VERDICTS = """
r AS (SELECT conv_id * 100 + turn AS qid, (conv_id * 100 + turn) % 8 AS m, (conv_id * 100 + turn) % 90 + 1 AS a FROM conversations),
v AS (
  SELECT qid, m, a, m IN (0, 1, 2, 6) AS answerable, m = 7 AS parse_error, m = 3 AS downgraded,
         CASE WHEN m IN (0, 1, 2) THEN '보기나무법 제' || a || '조' WHEN m = 6 THEN '보기나무법 제' || a || '조의2' ELSE '' END AS citations,
         CASE WHEN m IN (0, 1, 2) THEN '보기나무법 시행령 제' || a || '조' WHEN m = 3 THEN '보기나무법 제' || a || '9조' ELSE '' END AS invalid_citations,
         CASE WHEN m IN (0, 1, 2) THEN '안내 ' || a WHEN m = 6 THEN '휴일 안내 [보기나무법 제' || a || '조의2] 참고' ELSE '' END AS answer,
         CASE m WHEN 7 THEN '{bad}' WHEN 3 THEN '{none}' WHEN 4 THEN '범위 밖' ELSE '' END AS reason FROM r
)
""".replace("{bad}", W.bad_format).replace("{none}", W.no_source)


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.verify_answers(replies(spark, sf_dir), FAMILY, W)


@query(f"WITH {VERDICTS} SELECT qid, answerable, answer, reason, citations, invalid_citations, parse_error, downgraded FROM v")
def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["law"], F.lit(" "), r["article"])), ", ").alias(c)
    return _verified(spark, sf_dir).select("qid", "answerable", "answer", "reason", flat("citations"), flat("invalid_citations"), "parse_error", "downgraded")


@query(f"""WITH {VERDICTS} SELECT qid, CASE WHEN answerable THEN answer || chr(10) || chr(10) || '{W.sources}' || chr(10) || '- ' || citations || CASE WHEN m = 6 THEN '' ELSE '(제목)' END
  ELSE '{W.refusal}' || CASE WHEN reason <> '' THEN ' (' || reason || ')' ELSE '' END END || CASE WHEN invalid_citations <> '' THEN chr(10) || chr(10) || '{W.warning}' || invalid_citations ELSE '' END
  || chr(10) || chr(10) || '{W.disclaimer}' AS message FROM v""")
def render_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verified(spark, sf_dir)
    first = F.col("retrieved")[0]
    sources = v.select("qid", F.lit(1).alias("rank"), first["law"].alias("law"), first["article"].alias("article"), F.concat(first["law"], F.lit(" "), first["article"], F.lit("(제목) 제3항")).alias("citation"))
    return answers.render_answers(v, sources, W)


@query(f"""WITH {VERDICTS}, s AS (SELECT *, m <> 4 OR a % 2 = 0 AS scoped, a % 3 <> 0 AS gold_ok FROM v)
SELECT count(*) FILTER (scoped) AS in_scope, count(*) FILTER (NOT scoped) AS out_of_scope, count(*) FILTER (NOT scoped AND NOT answerable) AS refused, count(*) FILTER (scoped AND NOT answerable) AS false_refused,
  count(*) FILTER (scoped AND gold_ok AND m IN (0, 1, 2)) AS gold_cited, count(*) FILTER (scoped AND gold_ok) AS gold_in_context, count(*) FILTER (invalid_citations <> '') AS with_invalid,
  count(*) FILTER (parse_error) AS parse_errors, count(*) FILTER (downgraded) AS downgraded, round(count(*) FILTER (scoped AND NOT answerable) / count(*) FILTER (scoped), 9) AS false_refusal_rate FROM s""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verified(spark, sf_dir)
    a, m = F.col("qid") % 90 + 1, F.col("qid") % 8
    gold = F.struct(F.lit("보기나무법").alias("law"), F.concat(F.lit("제"), F.when(a % 3 != 0, a).otherwise(0).cast("string"), F.lit("조")).alias("article"))
    questions = v.select("qid", F.when((m == 4) & (a % 2 != 0), "refuse").alias("expected"), F.array(gold).alias("gold"))
    s = evaluate.score_answers(answers.answer_rows(questions, v))
    return s.select("in_scope", "out_of_scope", "refused", "false_refused", "gold_cited", "gold_in_context", "with_invalid", "parse_errors", "downgraded", F.round("false_refusal_rate", 9).alias("false_refusal_rate"))


@query("""
WITH q AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, (doc_id // 2 * 2)::VARCHAR AS id, text AS question, doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
k AS (SELECT *, toxic IS NOT DISTINCT FROM 1 AS refuse FROM q)
SELECT 'duplicate_id' AS rule, id AS subject FROM k GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'question_in_both_splits', trim(question, ' ') FROM k GROUP BY trim(question, ' ') HAVING count(DISTINCT split) > 1
UNION ALL SELECT DISTINCT 'gold_not_indexed', id FROM k WHERE doc_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = k.doc_id)
UNION ALL SELECT 'in_scope_without_gold', id FROM k WHERE NOT refuse AND doc_id % 4 = 0
UNION ALL SELECT 'refusal_with_gold', id FROM k WHERE refuse AND doc_id % 4 <> 0
UNION ALL SELECT 'few_in_scope', split FROM k GROUP BY split HAVING count(*) FILTER (NOT refuse) < 30
UNION ALL SELECT 'few_refusals', split FROM k GROUP BY split HAVING count(*) FILTER (refuse) < 5
""")
def set_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions, gold where the id is not divisible by 4, labelled documents as indexed articles."""
    labels = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    gold = F.when(d % 4 != 0, F.array(F.struct(F.lit("law").alias("law"), d.cast("string").alias("article")))).otherwise(F.array().cast("array<struct<law:string,article:string>>"))
    questions = table(spark, sf_dir, "documents").join(labels.select("doc_id", "toxic"), "doc_id", "left").select(
        F.when(d % 2 == 0, "dev").otherwise("test").alias("split"), (F.floor(d / 2) * 2).cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("toxic") == 1, "refuse").alias("expected"), gold.alias("gold"),
    )
    articles = labels.select(F.lit("law").alias("law"), d.cast("string").alias("article")).distinct()
    return evaluate.check_question_sets(questions, articles)
