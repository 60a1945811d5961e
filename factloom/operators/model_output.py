"""What a language model is sent and what it gives back, as DataFrame plans: prompts, parsing, normalisation, fallbacks.

The model itself stays outside: a caller brings its answers as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.functions.values import lookup

#: Names that models give metrics.
MODEL_METRICS = {
    "归母净利润": "net_profit_parent", "归属于上市公司股东的净利润": "net_profit_parent", "归属于母公司股东的净利润": "net_profit_parent", "归属于母公司所有者的净利润": "net_profit_parent",
    "净利润": "net_profit", "扣非净利润": "net_profit_deducted", "扣除非经常性损益后的净利润": "net_profit_deducted", "扣除非经常性损益的净利润": "net_profit_deducted",
    "研发费用": "R&D_expenditure", "研发投入": "R&D_total_spending", "研发投入合计": "R&D_total_spending", "营业收入": "revenue", "营业总收入": "revenue", "营收": "revenue",
    "产能": "production_capacity", "产量": "production_volume", "销量": "sales_volume",
}
PROMPT_CHUNKS, PROMPT_CHARS = 8, 1200
#: What rewritten retrieval queries end in, and the made facts of runs without a model.
REWRITE_SUFFIX = " 公开披露 财务指标 经营风险"
MOCK_FACT = {"metric_name": "R&D_and_operation_signal", "value": "公开资料可见持续投入与风险提示", "period": "近三年"}
FACT = "claim:string,metric_name:string,value:string,period:string,source_id:string,chunk_id:string,confidence:string"


def model_period(period: Column) -> Column:
    """The first year 20xx, also in Chinese digits; else the text itself."""
    raw = strip(period)
    plain, spelled = (F.regexp_extract(x, r"20\d{2}", 0) for x in (raw, F.translate(raw, "零一二三四五六七八九", "0123456789")))
    return F.when(plain != "", plain).when(spelled != "", spelled).otherwise(raw)


def model_metric(metric: Column) -> Column:
    """Standard name of a metric; unknown names stay."""
    key = strip(metric)
    return lookup(key, MODEL_METRICS, key)


def unfenced(answer: Column) -> Column:
    """An answer without the code fence that models put round JSON."""
    text = strip(F.coalesce(answer, F.lit("")))
    return F.when(F.startswith(text, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(text, r"^`+|`+$", ""), "^json", ""))).otherwise(text)


def parsed_facts(answers: DataFrame, chunks: DataFrame, by: str, normalised: bool = True) -> DataFrame:
    """(by, source_id, chunk_id, claim, metric_name, value, period, confidence, pos) of answers (by, answer).

    Only facts of the chunks (by, source_id, chunk_id) that the model was given count: a semi join. Normalised answers have
    their metric and period mapped, confidence 1 and each fact once; others keep what the model says, confidence 0.5
    where it says none. Answers that aren't JSON give nothing.
    """
    text = unfenced(F.col("answer")) if normalised else F.col("answer")
    rows = answers.select(by, F.posexplode(F.from_json(text, f"struct<facts:array<struct<{FACT}>>>")["facts"]).alias("pos", "f")).select(by, "pos", "f.*")
    rows = rows.where("source_id IS NOT NULL AND chunk_id IS NOT NULL").withColumn("claim", strip(F.coalesce("claim", F.lit("")))).where("claim <> ''")
    rows = rows.withColumns({"source_id": F.trim("source_id"), "chunk_id": F.trim("chunk_id")}).join(chunks.select(by, "source_id", "chunk_id").distinct(), [by, "source_id", "chunk_id"], "left_semi")
    if not normalised:
        given = F.when(F.col("confidence").isNull(), 0.5).otherwise(F.col("confidence").try_cast("double"))
        return rows.withColumn("confidence", given).where("confidence BETWEEN 0 AND 1")
    rows = rows.withColumns({"metric_name": model_metric(F.col("metric_name")), "period": model_period(F.col("period"))})
    keys = [by, "source_id", "chunk_id", "metric_name", "period", "value"]
    one = rows.groupBy(*keys).agg(F.min(F.struct("pos", "claim")).alias("x"))
    return one.select(*keys, "x.claim", F.lit(1.0).alias("confidence"), "x.pos")


def ranked_chunks(chunks: DataFrame, by: str, score: Column, words: tuple[str, ...], most: int = 10) -> DataFrame:
    """The best `most` chunks (text, pos) of each `by` that hold one of the words; the cheap filter comes before the score."""
    named = chunks.where(F.lower("text").rlike("|".join(f"\\Q{w.lower()}\\E" for w in words))) if words else chunks
    ranked = named.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("rank") <= most)


def merged_facts(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Rule facts, then those of a model that no rule found: the first of each (source, metric, period, value)."""
    keys = ["source_id", "metric_name", "period", "value"]
    return rules.unionByName(model.join(rules.select(*keys).distinct(), keys, "left_anti"))


def extraction_prompt(chunks: DataFrame, by: str, instructions: str) -> DataFrame:
    """(by, prompt): the first chunks (source_id, chunk_id, text, pos) of each `by`, cut, behind the instructions."""
    first = chunks.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("n") <= PROMPT_CHUNKS)
    lines = first.select(by, "n", F.concat(F.lit("["), "source_id", F.lit("/"), "chunk_id", F.lit("] "), cut(F.col("text"), PROMPT_CHARS)).alias("line"))
    g = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return g.select(by, F.concat_ws("\n", F.lit(instructions), F.transform("x", lambda x: x["line"])).alias("prompt"))


def cut(c: Column, limit: int) -> Column:
    """A text of at most `limit` characters and an ellipsis; nothing for a limit under 1."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.lit("") if limit <= 0 else F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def rewritten_query(question: Column, rewrite: bool) -> Column:
    """A query for retrieval: with a fixed suffix, or as it is."""
    return F.concat(strip(question), F.lit(REWRITE_SUFFIX)) if rewrite else question


def mock_facts(chunks: DataFrame, company: Column, by: str) -> DataFrame:
    """One made fact per chunk (source_id, chunk_id, pos), for runs without a model."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("pos"))
    claim = F.concat(company, F.lit(" 公开资料片段#"), n.cast("string"), F.lit("提到研发与经营风险信息"))
    return chunks.select(by, "source_id", "chunk_id", claim.alias("claim"), *[F.lit(v).alias(k) for k, v in MOCK_FACT.items()], F.lit(0.75).alias("confidence"))


def streamed_text(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """(by, text): what a model's stream of `data: ` lines says, up to `[DONE]`; other lines and broken JSON say nothing."""
    done = lines.where(F.trim(line) == "data: [DONE]").groupBy(by).agg(F.min(order).alias("done"))
    rows = lines.where(F.startswith(F.col(line), F.lit("data: "))).join(done, by, "left").where(F.col("done").isNull() | (F.col(order) < F.col("done")))
    said = F.get_json_object(F.regexp_replace(line, "^data: ", ""), "$.choices[0].delta.content")
    g = rows.select(by, F.col(order).alias("n"), said.alias("said")).where("said IS NOT NULL").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("n", "said"))).alias("x"))
    return g.select(by, F.array_join(F.transform("x", lambda x: x["said"]), "").alias("text"))
