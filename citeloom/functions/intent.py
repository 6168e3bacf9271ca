"""Question routing: dialogue, rule and context layers as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.evidence import iso_date
from citeloom.functions.text import as_col, normalize_scope, squeeze

# Wording of the routing rules, in order of precedence.
DIALOGUE = (
    (
        "model",
        r"(?:你(?:现在|目前)?(?:用|使用)(?:的)?(?:是)?什么(?:大语言|语言|ai)?模型|"
        r"你是什么(?:大语言|语言|ai)?模型|你的(?:底层)?模型(?:是什么|叫什么)|"
        r"你(?:是|用的是)(?:哪种|哪个|什么)模型)",
    ),
    (
        "identity",
        r"(?:你(?:是(?:谁|什么(?:ai|人工智能|助手|机器人)?)|叫什么(?:名字)?|"
        r"是(?:ai|人工智能|机器人|智能体|agent)吗)|介绍(?:一下)?(?:你自己|自己)|"
        r"你能介绍一下自己吗|whoareyou)",
    ),
    (
        "capabilities",
        r"(?:你(?:都)?(?:能|可以)(?:做什么|干什么|帮我做什么|帮我干什么|帮我什么)|"
        r"你有什么(?:功能|能力)|你能帮我学习吗|怎么使用你|如何使用你)",
    ),
    ("upload", r"(?:怎么|如何)(?:上传|添加|导入)(?:课程)?资料(?:到资料库)?"),
    ("greeting", r"(?:你好|您好|嗨|哈喽|hello|hi|早上好|晚上好|在吗|你在吗)"),
    ("thanks", r"(?:谢谢(?:你|您)?|感谢(?:你|您)?|多谢|辛苦了|thanks|thankyou)"),
)
SCENARIOS = (
    ("考试", ("考试", "期中", "期末", "测验", "考场", "开卷", "闭卷")),
    ("实验", ("实验", "实验室", "实训")),
    ("作业", ("作业", "习题", "报告")),
    ("课堂", ("课堂", "上课", "课上")),
)
CHAPTER = r"第\s*[0-9一二三四五六七八九十]+\s*章"
CONTEXTUAL = r"(?:那|这个|刚才|上面|前者|后者|同样|按刚才|照刚才)"
COMPARE = (
    r"(?:新旧|两个|不同).{0,8}(?:版本|版).{0,8}(?:对比|区别|差异)|"
    r"(?:版本|版).{0,8}(?:对比|区别|差异)"
)
RULE_QUERY = r"(?:是否|能不能|可不可以|可以吗|规定|要求|适用|生效|失效|现行|最新版|最新)"
CONCEPT = r"(?:是什么|定义|原理|公式|推导|性质|含义)"
GENERATE = (
    r"(?:(?:给我|帮我|请)(?:出|生成|创建|来|命制|组|做成)|"
    r"(?:给我|帮我)(?:几|[一二三四五六七八九十\d]+)(?:个|道|份)?|"
    r"(?:出|生成|创建|来|命制|组|做成))"
    r"(?:几|[一二三四五六七八九十\d]+)?(?:个|道|份)?[^，。！？]{0,24}"
    r"(?:练习题|题目|试题|大题|小题|选择题|填空题|简答题|试卷|卷子)"
)
MODES = ("qa", "concept", "chapter")
CONTEXT_TASKS = ("qa", "concept", "chapter", "rule_query", "version_compare", "question_generate")
RATIONALE = {
    "conversation": "身份、能力或礼貌交流，不需要课程取证",
    "question_generate": "命中出题或组卷表达，建立受证据约束的任务",
    "version_compare": "命中版本对比表达",
    "chapter": "命中章节概览表达",
    "rule_query": "命中规则、场景或时效表达",
    "concept": "命中知识点表达",
    "context": "根据会话中最近已确认的意图继承范围",
    "default": "普通问答，使用默认检索",
}
VISUAL_QUERY = (
    r"(?i)图(?:表|像|中|\s*\d)|曲线|坐标|横轴|纵轴|图例|趋势|峰值|谷值|"
    r"波数|反射率|透射率|高于|低于|以上还是以下|随.+变化"
)


def classify_dialogue(text: Column | str) -> Column:
    """Kind of small talk when the whole text is one; NULL otherwise."""
    bare = F.btrim(F.lower(squeeze(text)), F.lit("。！？!?，,.~～"))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(DIALOGUE):
        out = F.when(bare.rlike(rf"^(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


def extract_scenario(text: Column | str) -> Column:
    low = F.lower(as_col(text))
    out = F.lit(None).cast("string")
    for name, words in reversed(SCENARIOS):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def _decision(task, mode, scenario, as_of, confidence, layer, why) -> Column:
    def text(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("string")

    return F.struct(
        text(task).alias("task"),
        text(mode).alias("mode"),
        text(scenario).alias("scenario"),
        text(as_of).alias("as_of"),
        F.lit(confidence).cast("double").alias("confidence"),
        text(layer).alias("layer"),
        text(why).alias("rationale"),
    )


def rule_intent(question: Column | str, today: Column | None = None) -> Column:
    """Decision of the rule layer, NULL when no rule applies."""
    q = as_col(question)
    scenario, as_of = extract_scenario(q), iso_date(q)
    today = F.date_format(F.current_date(), "yyyy-MM-dd") if today is None else today
    latest = q.contains("最新") | q.contains("现行")

    def rule(task, mode, confidence, scope=True, date=None):
        return _decision(
            task, mode, scenario if scope else None,
            (as_of if date is None else date) if scope else None,
            confidence, "rule", RATIONALE[task],
        )

    return (
        F.when(q.rlike(GENERATE) | q.contains("组卷"), rule("question_generate", "qa", 0.98))
        .when(q.rlike(COMPARE), rule("version_compare", "qa", 0.97))
        .when(
            q.rlike(CHAPTER) | q.contains("章节概览") | q.contains("本章概述"),
            rule("chapter", "chapter", 0.96),
        )
        .when(
            scenario.isNotNull() | as_of.isNotNull() | q.rlike(RULE_QUERY),
            rule("rule_query", "qa", 0.91, date=F.coalesce(as_of, F.when(latest, today))),
        )
        .when(q.rlike(CONCEPT), rule("concept", "concept", 0.82, scope=False))
    )


def default_intent() -> Column:
    return _decision("qa", "qa", None, None, 0.40, "default", RATIONALE["default"])


def is_contextual(question: Column | str) -> Column:
    return as_col(question).rlike(CONTEXTUAL)


def defers_to_context(question: Column | str) -> Column:
    """A generic rule word in a follow-up gives way to the previous intent."""
    q = as_col(question)
    return (
        is_contextual(q) & extract_scenario(q).isNull() & iso_date(q).isNull()
    )


def context_intent(question: Column | str, previous: Column) -> Column:
    """Decision inherited from the previous intent of a follow-up, else NULL."""
    ok = previous.isNotNull() & is_contextual(question)
    task = F.when(previous["task"].isin(*CONTEXT_TASKS), previous["task"]).otherwise("qa")
    mode = F.when(previous["mode"].isin(*MODES), previous["mode"]).otherwise("qa")
    return F.when(
        ok,
        _decision(
            task, mode, F.nullif(previous["scenario"], F.lit("")),
            F.nullif(previous["as_of"], F.lit("")), 0.76, "context", RATIONALE["context"],
        ),
    )


def resolve_intent(
    question: Column | str,
    previous: Column | None = None,
    *,
    requested_mode: Column | None = None,
    scenario: Column | None = None,
    as_of: Column | None = None,
    model_intent: Column | None = None,
    today: Column | None = None,
) -> Column:
    """Dialogue, rule, context, model, default; explicit arguments override.

    ``model_intent`` is an already validated struct (or NULL) from a model call.
    """
    q = as_col(question)
    rule = rule_intent(q, today)
    inherited = None if previous is None else context_intent(q, previous)
    steps = []
    if inherited is not None:
        generic = (rule["task"] == "rule_query") & defers_to_context(q)
        steps.append(F.when(rule.isNotNull() & generic & previous.isNotNull(), inherited))
    steps.append(rule)
    steps += [s for s in (inherited, model_intent) if s is not None]
    decided = F.coalesce(*steps, default_intent())
    decided = F.when(
        classify_dialogue(q).isNotNull(),
        _decision("conversation", "qa", None, None, 1.0, "rule", RATIONALE["conversation"]),
    ).otherwise(decided)
    talk = decided["task"] == "conversation"
    out = decided
    if requested_mode is not None:
        out = F.when(
            ~talk & requested_mode.isin(*MODES), out.withField("mode", requested_mode)
        ).otherwise(out)
    if scenario is not None:
        given = F.nullif(scenario, F.lit(""))
        out = F.when(
            ~talk & given.isNotNull(), out.withField("scenario", normalize_scope(given))
        ).otherwise(out)
    if as_of is not None:
        given = F.nullif(as_of, F.lit(""))
        out = F.when(~talk & given.isNotNull(), out.withField("as_of", given)).otherwise(out)
    return out


def valid_model_intent(raw: Column | str) -> Column:
    """Checked struct from a model's JSON plan; NULL on any violation."""
    body = F.regexp_replace(F.btrim(as_col(raw)), r"^```json|```$", "")
    v = F.from_json(
        body, "task string, mode string, scenario string, as_of string, confidence double"
    )
    day = F.nullif(v["as_of"], F.lit(""))
    ok = (
        v["task"].isin(*CONTEXT_TASKS)
        & v["mode"].isin(*MODES)
        & (day.isNull() | F.try_to_date(day, "yyyy-MM-dd").isNotNull())
    )
    sure = F.when(v["confidence"].between(0, 1), v["confidence"]).otherwise(0.60)
    scope = F.when(F.coalesce(v["scenario"], F.lit("")) != "", normalize_scope(v["scenario"]))
    return F.when(
        ok,
        F.struct(
            v["task"].alias("task"), v["mode"].alias("mode"), scope.alias("scenario"),
            day.alias("as_of"), sure.alias("confidence"), F.lit("llm_fallback").alias("layer"),
            F.lit("复杂指代由受约束 LLM 生成意图计划").alias("rationale"),
        ),
    )


# Wording that grants, denies or questions a save permission.
QUOTED = r'“[^”]*”|「[^」]*」|"[^"\n]*"'
SAVE_DENIED = r"(?:不要|不必|先不|不)保存|仅预览|只预览"
SAVE_ASKED = r"(?:为什么|能不能|可不可以|是否|怎么|如何|能否).{0,24}(?:保存|存入|加入题库)"
SAVE_GRANTED = (
    r"(?:^|[，。；;！\s]|并(?:且)?|然后|请(?:你)?|帮我|同时)"
    r"(?:(?:把|将)[^，。；]{0,30})?(?:保存|存入|加入题库)"
)


def save_authorization(text: Column | str, previous: Column | None = None) -> Column:
    """Whether the text grants saving; quoted data and questions do not count."""
    bare = F.regexp_replace(as_col(text), QUOTED, "")
    before = F.lit(False) if previous is None else previous
    return (
        F.when(bare.rlike(SAVE_DENIED), F.lit(False))
        .when(bare.rlike(SAVE_ASKED), before)
        .when(bare.rlike(SAVE_GRANTED), F.lit(True))
        .otherwise(before)
    )
