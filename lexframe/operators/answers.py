"""Grounded answers in batches: prompts, generation through a hook, and citation checks in code."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import variants as V
from ..functions.text import strip
from .lookup import DECREE, RULE, LawFamily

REFS = "array<struct<law:string,article:string>>"


@dataclass(frozen=True)
class Wording:
    """All texts that prompts and answers are made of."""

    block: str = "[조문 {n}]"
    question: str = "[질문]"
    reminder: str = "제공된 조문만 근거로 정해진 JSON 객체 하나로 답하시오."
    bad_format: str = "응답 형식이 올바르지 않음"
    no_source: str = "확인된 근거 조문이 없음"
    refusal: str = "답변을 드릴 수 없습니다."
    sources: str = "[근거]"
    warning: str = "[주의] 제공되지 않은 조문의 인용은 제외함: "
    disclaimer: str = "※ 이 안내는 법률 자문이 아닙니다."


def build_prompts(questions: DataFrame, contexts: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """(qid, prompt): the numbered context of each question by rank, the question, a reminder of the format."""
    before, _, after = wording.block.partition("{n}")
    lists = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    block = lambda c, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after + "\n"), c["text"])
    blocks = F.array_join(F.transform(F.coalesce("_c", F.array().cast("array<struct<rank:int,text:string>>")), block), "\n\n")
    df = questions.join(lists.withColumn("_c", F.col("_c").cast("array<struct<rank:int,text:string>>")), "qid", "left")
    return df.select("qid", F.concat(blocks, F.lit(f"\n\n{wording.question}\n"), F.coalesce("question", F.lit("")), F.lit(f"\n\n{wording.reminder}")).alias("prompt"))


def generate(prompts: DataFrame, make_generator: Callable[[], Callable[[str, str], str]], system: str, partitions: int | None = None) -> DataFrame:
    """(qid, raw): replies of generate(system, prompt); the generator is made once per task."""
    prompts = prompts.select("qid", "prompt")
    kind = dict(prompts.dtypes)["qid"]
    prompts = prompts.repartition(partitions) if partitions else prompts

    def run(batches):
        ask = None
        for b in batches:
            ask = ask or make_generator()
            yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array([ask(system, p) for p in b.column("prompt").to_pylist()], pa.string())], ["qid", "raw"])

    return prompts.mapInArrow(run, f"qid {kind}, raw string")


def extract_json(raw: Column) -> Column:
    """The object at the first opening brace, whatever follows it; null if there is none or it is not valid."""
    at = F.instr(raw, "{")
    return F.when(at > 0, F.try_parse_json(F.substring(raw, at, F.length(raw))))


def parse_citation(text: Column, family: LawFamily) -> Column:
    """(law, article) of the first citation of a law of the family in a text; what follows the article is dropped."""
    pattern = rf"(?U){family.main}\s*({DECREE}|{RULE})?\s*(제\d+조(?:의\d+)?)"
    kind, article = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    law = F.when(kind == DECREE, family.decree).when(kind == RULE, family.rule).otherwise(family.main)
    return F.when(article != "", F.struct(law.alias("law"), article.alias("article")))


def collect_citations(obj: Column, family: LawFamily) -> Column:
    """Citations of the list, then those in square brackets of the answer; each once, in order."""
    listed = F.filter(F.coalesce(V.key(obj, "citations", "array<string>"), F.array().cast("array<string>")), lambda c: c != "")
    inside = F.regexp_extract_all(V.text(obj, "answer"), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    refs = F.transform(F.concat(listed, inside), lambda t: parse_citation(t, family))
    return F.array_distinct(F.filter(refs, lambda r: r.isNotNull()))


def truthy(v: Column) -> Column:
    """As Python takes a JSON value: false, 0, empty and null ones are false."""
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(v.isNull() | F.is_variant_null(v), False).when(kind == "BOOLEAN", V.get(v, "$", "boolean")).when(kind == "STRING", V.get(v, "$", "string") != "")
        .when(kind.startswith("ARRAY"), F.size(V.get(v, "$", "array<variant>")) > 0).when(kind.startswith("OBJECT"), V.get(v, "$", "string") != "{}")
        .otherwise(V.get(v, "$", "double") != 0),
        F.lit(False),
    )


def verify_answers(replies: DataFrame, family: LawFamily, wording: Wording = Wording()) -> DataFrame:
    """replies (qid, raw, retrieved) with answerable, answer, reason, citations, invalid_citations, parse_error, downgraded.

    retrieved is the array of (law, article) that the question was given. An answer needs its flag, a text and one citation
    among them, or it becomes a refusal; replies that cannot be parsed are refusals. Row-local.
    """
    df = replies.withColumn("_o", extract_json(F.col("raw"))).withColumn("_refs", F.coalesce(collect_citations(F.col("_o"), family), F.array().cast(REFS)))
    allowed = F.coalesce(F.col("retrieved"), F.array().cast(REFS))
    df = df.withColumns({
        "parse_error": F.col("_o").isNull(), "citations": F.filter("_refs", lambda r: F.array_contains(allowed, r)), "invalid_citations": F.filter("_refs", lambda r: ~F.array_contains(allowed, r)),
        "_said": strip(V.text(F.col("_o"), "answer")),
    }).withColumn("_wants", truthy(V.key(F.col("_o"), "answerable")) & (F.col("_said") != ""))
    answerable = F.col("_wants") & (F.size("citations") > 0)
    reason = F.when(F.col("parse_error"), wording.bad_format).when(F.col("_wants") & ~answerable, wording.no_source).otherwise(strip(V.text(F.col("_o"), "reason")))
    df = df.withColumns({"answerable": answerable, "answer": F.when(answerable, F.col("_said")).otherwise(""), "reason": reason, "downgraded": F.col("_wants") & ~answerable})
    return df.drop("_o", "_refs", "_said", "_wants")


def render_answers(verified: DataFrame, sources: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """(qid, message) of verified answers; sources (qid, rank, law, article, citation) give the first title of each article,
    without a paragraph, as citations are checked by article."""
    title = F.regexp_replace("citation", r"(?U)\s*제\d+항$", "")
    first = sources.groupBy("qid", "law", "article").agg(F.min_by(title, "rank").alias("title"))
    titles = first.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("law", "article"), "title"))).alias("_t"))
    df = verified.join(titles, "qid", "left")
    plain = lambda r: F.concat(r["law"], F.lit(" "), r["article"])
    named = F.transform("citations", lambda r: F.concat(F.lit("- "), F.coalesce(F.try_element_at("_t", r), plain(r))))
    answer = F.concat(F.col("answer"), F.lit(f"\n\n{wording.sources}\n"), F.array_join(named, "\n"))
    refusal = F.concat(F.lit(wording.refusal), F.when(F.col("reason") != "", F.concat(F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise(""))
    warning = F.when(F.size("invalid_citations") > 0, F.concat(F.lit("\n\n" + wording.warning), F.array_join(F.transform("invalid_citations", plain), ", "))).otherwise("")
    return df.select("qid", F.concat(F.when(F.col("answerable"), answer).otherwise(refusal), warning, F.lit("\n\n" + wording.disclaimer)).alias("message"))


def answer_rows(questions: DataFrame, verified: DataFrame) -> DataFrame:
    """Flat result rows: a missing `expected` is "answer", gold is sorted."""
    df = questions.join(verified, "qid")
    return df.withColumns({"expected": F.coalesce("expected", F.lit("answer")), "gold": F.array_sort(F.array_distinct("gold"))})
