"""Which facts answer a question directly: points by rule, the best of each metric and period, the newest completed years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.selection import CHINESE_DIGITS

#: Words of questions by intent; (intent, points, starts of metrics, words in metrics, words in claims); starts of metrics that
#: keep their own family; place of families by intent; units and factors by preference.
INTENTS = {
    "rd": ("研发", "r&d", "rd", "research"),
    "revenue_structure": ("收入结构", "营收结构", "分业务", "业务结构", "收入构成"),
    "revenue": ("收入", "营收", "营业收入", "revenue"),
    "capacity": ("产能", "扩张", "产量", "销量", "capacity", "production"),
    "profit": ("净利润", "利润", "profit"),
    "risk": ("风险", "不确定", "risk"),
    "business": ("主要业务", "主营业务", "业务板块", "业务范围", "具体业务", "经营范围", "产品服务", "business"),
}
CAPACITY, BUSINESS = ("production_capacity", "production_volume", "sales_volume"), ("business", "industry", "operation_scope")
POINTS = (
    ("rd", 3, ("r&d",), (), ("研发",)),
    ("revenue_structure", 3, ("revenue_segment",), (), ("收入结构", "分业务")),
    ("capacity", 3, CAPACITY, (), ("产能", "产量", "销量", "扩张")),
    ("profit", 2, (), ("profit",), ("利润",)),
    ("risk", 2, (), (), ("风险", "不确定", "波动", "冲突")),
    ("business", 3, BUSINESS, (), ("主营", "主要业务", "业务板块", "业务范围", "经营范围", "所属行业", "行业为", "产品", "服务", "软件开发", "系统集成", "技术开发", "技术服务")),
)
PLACES = (("revenue", ("revenue",)), ("profit", ("profit",)), ("rd", ("rd",)), ("revenue_structure", ("revenue_segment",)), ("capacity", CAPACITY), ("business", BUSINESS))
FACTORS = (("万亿", 1e12), ("亿元", 1e8), ("亿", 1e8), ("万元", 1e4), ("千元", 1e3))
CORE = 2


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def intents(question: Column) -> Column:
    """Sorted intents that a question names; revenue structure suppresses revenue."""
    q = F.lower(F.coalesce(question, F.lit("")))
    found = F.array_compact(F.array(*[F.when(_any([F.contains(q, F.lit(w)) for w in words]), F.lit(name)) for name, words in sorted(INTENTS.items())]))
    return F.when(F.array_contains(found, "revenue_structure"), F.array_remove(found, "revenue")).otherwise(found)


def points(metric: Column, claim: Column, wanted: Column) -> Column:
    """Points of a fact for the wanted intents; 2 make it a core fact."""
    m, c = F.lower(F.coalesce(metric, F.lit(""))), F.lower(F.coalesce(claim, F.lit("")))
    total = F.when(F.array_contains(wanted, "revenue") & ((m == "revenue") | F.contains(c, F.lit("营业收入"))), 2).otherwise(0)
    for name, worth, starts, inside, words in POINTS:
        fits = _any([*(F.startswith(m, F.lit(s)) for s in starts), *(F.contains(m, F.lit(s)) for s in inside), *(F.contains(c, F.lit(w)) for w in words)])
        total = total + F.when(F.array_contains(wanted, name) & fits, worth).otherwise(0)
    return total


def family(metric: Column) -> Column:
    m = F.lower(F.coalesce(metric, F.lit("")))
    out = F.when(m == "revenue", m).when(F.contains(m, F.lit("profit")), "profit").when(F.startswith(m, F.lit("r&d")), "rd").when(F.startswith(m, F.lit("revenue_segment")), "revenue_segment")
    return out.when(_any([F.startswith(m, F.lit(s)) for s in CAPACITY + BUSINESS]), F.substring_index(m, ":", 1)).when(m == "", "unknown").otherwise(m)


def period_rank(period: Column) -> Column:
    """Year of a period, 0 without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(period, F.lit("")), r"(20\d{2})", 1).try_cast("int"), F.lit(0))


def fact_quality(period: Column, value: Column, confidence: Column) -> Column:
    """A year counts most, then the value in units, then the confidence."""
    text = F.coalesce(value, F.lit(""))
    factor = F.lit(1.0)
    for unit, by in reversed(FACTORS):
        factor = F.when(F.contains(text, F.lit(unit)), by).otherwise(factor)
    number = F.coalesce(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    return F.when(period_rank(period) > 0, 1e9).otherwise(0.0) + number * factor + F.coalesce(confidence, F.lit(0.0))


def year_window(question: Column) -> Column:
    """How many recent years a question asks for, 1 to 10; null if it doesn't say."""
    q = F.replace(F.coalesce(question, F.lit("")), F.lit(" "), F.lit(""))
    digits = F.regexp_extract(q, r"近(\d{1,2})年", 1).try_cast("int")
    word = F.regexp_extract(q, f"近([{''.join(CHINESE_DIGITS)}])年", 1)
    spelled = F.when(F.lit(False), F.lit(0))
    for w, n in CHINESE_DIGITS.items():
        spelled = spelled.when(word == w, n)
    return F.when(digits.isNotNull(), F.greatest(F.lit(1), F.least(digits, F.lit(10)))).otherwise(spelled)


def relevant_facts(questions: DataFrame, facts: DataFrame, by: str, as_of: int) -> DataFrame:
    """(by, fact_id, part, rank) of facts (by, fact_id, metric_name, claim, period, value, confidence, pos): `core` ones and `supporting` ones.

    Core facts are the best of each (family, period); those without a year go where their family has years; newest first, then by
    place of the family and quality. Where a question asks for recent years, only the newest completed ones before `as_of`
    stay, if there are enough. A question without a known intent has all its facts as core, in their order. Everything but
    the final numbering is grouped aggregates.
    """
    asked = questions.select(by, intents(F.col("question")).alias("_wanted"), year_window(F.col("question")).alias("_window"))
    rows = facts.join(asked, by).withColumns({"_family": family(F.col("metric_name")), "_year": period_rank(F.col("period")), "_quality": fact_quality(F.col("period"), F.col("value"), F.col("confidence"))})
    rows = rows.withColumn("_core", (F.size("_wanted") == 0) | (points(F.col("metric_name"), F.col("claim"), F.col("_wanted")) >= CORE))
    rest = rows.where("NOT _core").select(by, "fact_id", F.lit("supporting").alias("part"), F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0.0).alias("q"), F.col("pos").cast("long").alias("p")).alias("at"))
    plain = rows.where("_core AND size(_wanted) = 0").select(by, "fact_id", F.lit("core").alias("part"), F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0.0).alias("q"), F.col("pos").cast("long").alias("p")).alias("at"))
    core = rows.where("_core AND size(_wanted) > 0").withColumn("_period", F.when(F.coalesce("period", F.lit("")) == "", "unknown_period").otherwise(F.col("period")))
    best = core.groupBy(by, "_family", "_period").agg(F.min_by(F.struct("fact_id", "_year", "_quality", "_wanted", "_window"), F.struct((-F.col("_quality")).alias("q"), "pos")).alias("x"), F.min("pos").cast("long").alias("first")).select(by, "_family", "x.*", "first")
    known = best.groupBy(by, "_family").agg(F.max(F.col("_year") > 0).alias("_known"))
    best = best.join(known, [by, "_family"]).where((F.col("_year") > 0) | ~F.col("_known"))
    done = (F.col("_year") > 0) & (F.col("_year") < as_of)
    years = best.groupBy(by).agg(F.array_sort(F.collect_set(F.when(done, -F.col("_year")))).alias("_years"))
    best = best.join(years, by).withColumn("_latest", F.slice("_years", 1, F.coalesce("_window", F.lit(1))))
    enough = F.col("_window").isNotNull() & (F.size("_years") > 0) & (F.size("_latest") >= F.least("_window", F.lit(2)))
    best = best.where(~enough | (done & F.array_contains("_latest", -F.col("_year"))))
    place = F.lit(9)
    for i, (name, members) in reversed(list(enumerate(PLACES))):
        place = F.when(F.array_contains("_wanted", name) & F.col("_family").isin(*members), i).otherwise(place)
    core = best.select(by, "fact_id", F.lit("core").alias("part"), F.struct((-F.col("_year")).alias("y"), place.alias("m"), (-F.col("_quality")).alias("q"), F.col("first").alias("p")).alias("at"))
    ranked = core.unionByName(plain).unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy(by, "part").orderBy("at")))
    return ranked.select(by, "fact_id", "part", "rank")
