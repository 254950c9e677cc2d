"""The dictionary as a table: production filter, overrides, policies, blacklist.

Entries have zh (the term), en, part_of_speech, meaning, phonetic, priority,
context_rules, context_hints and ord (input order).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.context import candidate_id, is_production_entry

# Terms that the default policy blocks.
POLICY_BLOCKED = (
    "给小", "打电", "下定", "口香", "巧克", "地平", "大理", "人行", "在别", "在下", "活下", "最下",
    "用拳", "在左", "在室", "有分", "有规", "不光", "小部", "小卖", "五分", "四分", "八分", "一打",
    "一针", "大字", "长途", "洗脸", "国际", "公共", "超级", "外国", "小型", "集体", "承担", "商品",
    "旅游", "雇佣", "果实", "周日", "官方", "权利", "强壮", "深刻", "跳起", "通道", "领域", "体育",
    "优美", "超越", "可靠", "准确", "身材", "相互", "锐利", "最小", "设备", "方案", "隐蔽", "求助",
    "爱好", "指挥", "使劲", "开发", "发起", "无线", "钱财", "粗鲁", "调味", "传播", "讽刺", "小雨",
    "极度", "发芽", "最初", "无疑", "严厉", "不喜", "名词", "有知", "教诲", "抚恤", "执行", "指导",
    "搬运", "半年", "门把", "害怕", "期待", "艰难", "低声", "弯腰", "增加", "询问", "停住", "讨厌",
    "青年", "成熟", "神秘", "震动", "明确", "幸运", "愉快", "寒冷", "舒适", "落后", "严格", "便利",
    "独立", "纯净", "给予", "伸向", "露天", "推进", "满口", "保守", "搜集", "描写", "储备", "构成",
    "转变", "企图", "招待", "花费", "欣喜", "发问", "残余", "最少",
)
# Terms that need a neighbour as evidence, with the text that must end before them or begin after them.
POLICY_CONTEXTUAL = {
    "把手": {"leftSuffix": ("门", "车门", "抽屉", "柜门", "窗户", "握住", "抓住", "拧动", "转动", "拉住", "扶住"), "rightPrefix": ("坏了", "断了", "松了")},
    "旁边": {"leftSuffix": ("在", "到", "从", "站在", "坐在", "走到"), "rightPrefix": ()},
    "小心翼翼": {"leftSuffix": (), "rightPrefix": ("地", "觑", "道", "走", "看")},
    "相当": {"leftSuffix": (), "rightPrefix": ("平淡", "不错", "严重", "重要")},
    "自由": {"leftSuffix": ("获得", "获得了", "恢复", "恢复了", "争取", "争取到", "享受", "拥有", "追求", "失去"), "rightPrefix": ("下坠", "落体", "活动", "出入", "行动")},
    "样子": {"leftSuffix": ("看",), "rightPrefix": ("很", "不错", "一样")},
}
# Terms that are fit for use without a clean side.
FLOATING_TERMS = (
    "学校", "相当", "自然", "控制", "银行", "女儿", "认为", "普通", "感情", "说笑", "厨房", "吃饭",
    "颤抖", "安慰", "意识到", "注意到", "发现", "继续", "直接", "身体", "终于", "听见", "单位", "表现出",
    "儿子", "中心", "感谢", "大陆", "建立", "手指", "带来", "朋友", "读者", "草莓", "遭遇", "方面",
    "实现", "挑战", "评论", "沙漠", "王国", "宿舍", "同志", "声音", "明天", "有点", "蚊子", "专门",
    "建议", "很可能", "十分", "甚至", "剩下", "增援", "犯人", "回来", "重重", "卡车", "重新", "仅仅",
    "肌肉", "介绍", "简直", "手套", "冲动", "事情", "准备", "玻璃", "对付", "泄露", "变成", "电子",
    "天气", "奶油", "航班", "估计", "任务", "奴隶", "必然", "兄弟", "谋反", "闪闪", "丈夫", "得到",
    "心情", "外衣", "小心", "讨论", "关上", "包括", "属于", "方向", "能力", "地板", "冰箱",
)

ENTRY = "zh string, en string, part_of_speech string, meaning string, phonetic string, priority int, context_rules array<struct<kind:string,value:string>>, context_hints array<string>, ord int"


def dictionary(entries: DataFrame, blacklist: DataFrame | None = None, production: Column | None = None) -> DataFrame:
    """Entries fit for use, the first of each (zh, en, part_of_speech).

    The blacklist (column term) removes by term or by translation with two
    anti joins, which plan as hash joins where one disjunction would not.
    """
    rule = is_production_entry(F.col("zh"), F.col("en")) if production is None else production
    good = entries.where(rule)
    if blacklist is not None:
        for side in ("zh", "en"):
            good = good.join(blacklist.select(F.col("term").alias(side)).distinct(), side, "left_anti")
    first = F.row_number().over(Window.partitionBy("zh", "en", "part_of_speech").orderBy("ord"))
    return good.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("candidate_id", candidate_id(F.col("zh"), F.col("en"), F.col("part_of_speech")))


def grouped(entries: DataFrame) -> DataFrame:
    """One row per term with its senses in input order."""
    fields = [c for c in entries.columns if c != "zh"]
    return entries.groupBy("zh").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"]))).alias("senses"))


def with_overrides(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated entries take the place of all entries of their term, if the source has the term.

    A missing phonetic is filled from the source's same sense; overrides come
    last in order.
    """
    untouched = entries.join(overrides.select("zh").distinct(), "zh", "left_anti")
    spoken = entries.where("phonetic <> ''").groupBy("zh", "en", "part_of_speech").agg(F.min_by("phonetic", "ord").alias("__said"))
    known = overrides.join(entries.select("zh").distinct(), "zh", "left_semi").join(spoken, ["zh", "en", "part_of_speech"], "left")
    filled = known.withColumn("phonetic", F.coalesce(F.when(F.col("phonetic") != "", F.col("phonetic")), "__said")).drop("__said")
    last = F.lit(1 << 30) + F.col("ord")
    return untouched.unionByName(filled.withColumn("ord", last.cast("int")).select(untouched.columns))


def with_mode(rows: DataFrame, policy: DataFrame, term: str = "zh") -> DataFrame:
    """Adds mode: blocked, contextual or (without a row in the policy) stable."""
    return rows.join(policy.select(F.col("term").alias(term), "mode"), term, "left").withColumn("mode", F.coalesce("mode", F.lit("stable")))


def default_policy(spark: SparkSession) -> DataFrame:
    """Rows (term, mode, allow) of the policy for the production lexicon."""
    rows = [(term, "blocked", None) for term in POLICY_BLOCKED]
    rows += [(term, "contextual", [(kind, value) for kind, values in allow.items() for value in values]) for term, allow in POLICY_CONTEXTUAL.items()]
    return spark.createDataFrame(rows, "term string, mode string, allow array<struct<kind:string,value:string>>")


def floating_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(term,) for term in FLOATING_TERMS], "term string")


def listed_ids(lines: DataFrame, text: str = "text") -> DataFrame:
    """Rows (candidate_id): the quoted ids zh:en:part-of-speech that lines of source text hold, one row each time."""
    found = F.regexp_extract_all(F.col(text), F.lit('"([^"\\n]+:[^"\\n]+:[^"\\n]+)"'), F.lit(1))
    return lines.select(F.explode(found).alias("candidate_id"))


def fragment_warnings(entries: DataFrame, phrases: list[str], most: int = 2) -> DataFrame:
    """Entries of at most so many characters whose meaning holds one of the longer phrases that they may be cut from."""
    return entries.where((F.length("zh") <= most) & F.coalesce(F.col("meaning"), F.lit("")).rlike("|".join(re.escape(p) for p in phrases)))


def overlap_terms(terms: DataFrame, term: str = "zh") -> DataFrame:
    """Terms that have a shorter term as a proper prefix: an equi-join on exploded prefixes."""
    every = terms.select(F.col(term).alias("t")).distinct()
    prefixes = every.where(F.length("t") > 1).select("t", F.explode(F.sequence(F.lit(1), F.length("t") - 1)).alias("n")).select(F.col("t").alias("whole"), F.substring("t", F.lit(1), F.col("n")).alias("t"))
    return prefixes.join(every, "t", "left_semi").select(F.col("whole").alias(term)).distinct()


def approved_union(batches: list[DataFrame], blocked: DataFrame) -> DataFrame:
    """Distinct candidate ids of all batches whose term is not blocked (column term)."""
    every = reduce(DataFrame.unionByName, batches).distinct().withColumn("term", F.element_at(F.split("candidate_id", ":"), 1))
    return every.join(blocked.select("term"), "term", "left_anti").select("candidate_id", "term")


def missing_sources(approved: DataFrame, entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Approved ids without an entry of that id and without an override of their term."""
    ids = entries.select(candidate_id(F.col("zh"), F.col("en"), F.col("part_of_speech")).alias("candidate_id"))
    return approved.join(ids, "candidate_id", "left_anti").join(overrides.select(F.col("zh").alias("term")).distinct(), "term", "left_anti")
