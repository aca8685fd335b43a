"""Vocabulary and matching rules as parameters.

Every operator that needs a word list or a pattern takes a :class:`RuleSet`. ``NEWSPAPER_RULES`` holds the
values of the two-newspaper workload; other source pairs pass their own set, built in code or read from rule
tables with :meth:`RuleSet.from_tables`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AnchorRule:
    """One named anchor: the pattern that finds it and the score its presence is worth."""

    canonical: str
    pattern: str
    score: float
    headline_only: bool = False
    clusterable: bool = False


@dataclass(frozen=True)
class TopicRule:
    """A topic family: all patterns must be found in the given field (``text`` or ``headline``)."""

    family: str
    field: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class RuleSet:
    generic_terms: tuple[str, ...] = ()
    generic_judge_terms: tuple[str, ...] = ()
    military_cues: tuple[str, ...] = ()
    policy_cues: tuple[str, ...] = ()
    slogan_cues: tuple[str, ...] = ()
    anchors: tuple[AnchorRule, ...] = ()
    # (pattern, score) tried in order for a term that is no configured anchor, then the default.
    anchor_score_patterns: tuple[tuple[str, float], ...] = ()
    anchor_score_default: float = 0.34
    # Event phrases used as anchors of the candidate stage and as scoring anchors.
    event_pattern: str | None = None
    scoring_event_pattern: str | None = None
    scoring_anchors: tuple[tuple[str, str], ...] = ()
    topics: tuple[TopicRule, ...] = ()
    policy_family: str | None = None
    ignorable_titles: tuple[str, ...] = ()
    title_labels: tuple[str, ...] = ()
    publisher_prefixes: tuple[str, ...] = ()
    stray_title_prefix: str | None = None
    likely_pattern: str = "[㐀-鿿A-Za-z0-9]{2,18}"
    likely_limit: int | None = None
    # None reads the whole text. The newspaper workload reads 3,000 and 4,000 characters.
    likely_text_chars: int | None = None
    anchor_text_chars: int | None = None
    labels: dict[tuple[str, str], str] = field(default_factory=dict)

    @property
    def clusterable(self) -> tuple[str, ...]:
        return tuple(a.canonical for a in self.anchors if a.clusterable)

    def to_tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The rule set as small tables, the form in which users keep and edit it."""
        terms = [("scoring", t) for t in self.generic_terms] + [("judge", t) for t in self.generic_judge_terms]
        cues = (
            [("military", c) for c in self.military_cues]
            + [("policy", c) for c in self.policy_cues]
            + [("slogan", c) for c in self.slogan_cues]
        )
        anchors = [(i, a.canonical, a.pattern, a.score, a.headline_only, a.clusterable) for i, a in enumerate(self.anchors)]
        topics = [(i, t.family, t.field, list(t.patterns)) for i, t in enumerate(self.topics)]
        return {
            "lex_generic": spark.createDataFrame(terms, "list string, term string"),
            "lex_cues": spark.createDataFrame(cues, "kind string, cue string"),
            "anchor_rules": spark.createDataFrame(
                anchors,
                "pos int, canonical string, pattern string, score double, headline_only boolean, clusterable boolean",
            ),
            "topic_rules": spark.createDataFrame(topics, "pos int, family string, field string, patterns array<string>"),
            "title_labels": spark.createDataFrame([(t,) for t in self.title_labels], "label string"),
            "ignorable_titles": spark.createDataFrame([(t,) for t in self.ignorable_titles], "title string"),
            "publisher_prefixes": spark.createDataFrame([(t,) for t in self.publisher_prefixes], "pattern string"),
        }

    @staticmethod
    def from_tables(tables: dict[str, DataFrame], max_rules: int = 10_000, **other) -> RuleSet:
        """Read a rule set from its tables; a table above ``max_rules`` rows is refused, never cut."""

        def rows(name: str, order: str | None = None):
            if name not in tables:
                return []
            table = tables[name]
            found = (table.orderBy(order) if order else table).limit(max_rules + 1).collect()
            if len(found) > max_rules:
                raise ValueError(f"rule table {name} has more than {max_rules} rows")
            return found

        generic, cues = rows("lex_generic"), rows("lex_cues")
        return RuleSet(
            generic_terms=tuple(r.term for r in generic if r.list == "scoring"),
            generic_judge_terms=tuple(r.term for r in generic if r.list == "judge"),
            military_cues=tuple(r.cue for r in cues if r.kind == "military"),
            policy_cues=tuple(r.cue for r in cues if r.kind == "policy"),
            slogan_cues=tuple(r.cue for r in cues if r.kind == "slogan"),
            anchors=tuple(
                AnchorRule(r.canonical, r.pattern, r.score, r.headline_only, r.clusterable)
                for r in rows("anchor_rules", "pos")
            ),
            topics=tuple(TopicRule(r.family, r.field, tuple(r.patterns)) for r in rows("topic_rules", "pos")),
            title_labels=tuple(r.label for r in rows("title_labels")),
            ignorable_titles=tuple(r.title for r in rows("ignorable_titles")),
            publisher_prefixes=tuple(r.pattern for r in rows("publisher_prefixes")),
            **other,
        )

    def label_table(self, spark: SparkSession) -> DataFrame:
        rows = [(kind, code, text) for (kind, code), text in self.labels.items()]
        return F.broadcast(spark.createDataFrame(rows, "kind string, code string, label string"))


# ---------------------------------------------------------------------------------------------------------
# Fixed values of the newspaper workload. They decide the results and are data, not logic.

GENERIC_SCORING_TERMS = (
    "习近平", "党中央", "新时代", "新征程", "中国式现代化", "高质量发展", "贯彻落实", "人民", "群众", "发展",
    "工作", "建设", "重要", "推动",
)

GENERIC_JUDGE_TERMS = (
    "习近平", "中国", "人民", "国家", "发展", "工作", "建设", "重要", "推进", "推动", "坚持", "全面", "新时代",
    "高质量发展", "中国式现代化", "共同繁荣", "合作共赢", "和平共处", "相互尊重",
)

MILITARY_CUES = (
    "军", "部队", "官兵", "战斗力", "备战", "打仗", "训练", "演训", "作战", "指挥", "军委", "强军", "战场",
    "任务场", "训练场", "政治建军",
)

POLICY_CUES = (
    "政策", "部署", "战略", "治理", "改革", "制度", "体系", "标准", "条例", "考核", "现代化", "生产力", "民生",
    "公共服务", "高质量",
)

SLOGAN_CUES = ("思想", "精神", "观", "路线", "方针", "中国式现代化", "高质量发展")

IGNORABLE_TITLES = ("图片", "图片报道", "导读", "短讯")

TITLE_LABELS = (
    "社论", "短评", "快评", "评论", "评论员文章", "本报评论员", "权威发布", "图片报道", "导读", "今日谈",
    "记者手记", "人民论坛", "钟声", "和音",
)

PUBLISHER_PREFIXES = ("^中央宣传部\\s*[、,，和与及]*\\s*全国总工会\\s*(?=联合发布|发布|表彰|授予)",)

# Name, pattern, score, whether it is looked for in headlines only, whether it may name a cluster.
ANCHORS = (
    AnchorRule("粮食安全保障法", "粮食安全保障法", 0.96),
    AnchorRule("粮食安全保障法执法检查", "粮食安全保障法.{0,12}执法检查|执法检查.{0,12}粮食安全保障法", 1.0, clusterable=True),
    AnchorRule("全国人大常委会执法检查", "全国人大常委会.{0,16}执法检查", 0.88, clusterable=True),
    AnchorRule("中美经贸磋商", "中美.{0,8}经贸磋商|美中.{0,8}经贸磋商", 1.0, clusterable=True),
    AnchorRule("中国-加州经贸论坛", "中国[\\-—－]加州经贸论坛|中国.{0,4}加州.{0,4}经贸论坛", 1.0, clusterable=True),
    AnchorRule("中美关系", "中美.{0,4}关系|美中.{0,4}关系", 0.42),
    AnchorRule("中美经贸关系", "中美.{0,6}经贸关系|美中.{0,6}经贸关系", 0.54),
    AnchorRule("中美地方经贸交流", "中美.{0,8}地方.{0,8}经贸交流|美中.{0,8}地方.{0,8}经贸交流", 0.58),
    AnchorRule("中美民间交往", "中美.{0,10}民间交往|美中.{0,10}民间交往", 0.54),
    AnchorRule("中美人文交流", "中美.{0,10}人文交流|美中.{0,10}人文交流", 0.54),
    AnchorRule("正确相处之道", "正确相处之道", 0.54),
    AnchorRule("特朗普国事访问", "特朗普.{0,40}国事访问|国事访问.{0,40}特朗普", 0.62),
    AnchorRule("中美元首会晤", "中美.{0,8}元首会晤|美中.{0,8}元首会晤|元首会晤", 0.62),
    AnchorRule("靖国神社", "靖国神社", 0.96, clusterable=True),
    AnchorRule("莫桑比克查波会谈", "莫桑比克.{0,24}查波.{0,12}会谈|查波.{0,24}莫桑比克.{0,12}会谈", 1.0, clusterable=True),
    AnchorRule("查波会谈", "查波.{0,12}会谈|会谈.{0,12}查波", 0.94, clusterable=True),
    AnchorRule("老挝沙伦赛会见", "老挝.{0,24}沙伦赛.{0,12}会见|沙伦赛.{0,24}老挝.{0,12}会见", 1.0, clusterable=True),
    AnchorRule("沙伦赛会见", "沙伦赛.{0,12}会见|会见.{0,12}沙伦赛", 0.94, clusterable=True),
    AnchorRule("中莫命运共同体联合声明", "中莫命运共同体.{0,10}联合声明|莫桑比克共和国.{0,24}联合声明", 0.62),
    AnchorRule("联合声明", "联合声明", 0.58),
    AnchorRule("向新向好稳中有进", "向新向好.{0,4}稳中有进", 0.92, clusterable=True),
    AnchorRule("向新向好", "向新向好", 0.76),
    AnchorRule("稳中有进", "稳中有进", 0.76),
    AnchorRule("树立和践行正确政绩观", "树立和践行正确政绩观|正确政绩观", 0.86, headline_only=True),
    AnchorRule("形式主义基层减负", "形式主义.{0,14}基层减负|基层减负.{0,14}形式主义", 0.8, headline_only=True),
    AnchorRule("干事创业", "干事创业", 0.64, headline_only=True),
    AnchorRule("五四主题团日活动", "五四主题团日活动", 0.9, clusterable=True),
    AnchorRule("人工智能科技伦理审查与服务先导计划", "人工智能科技伦理审查与服务先导计划", 0.96, clusterable=True),
    AnchorRule("造船统计发布", "造船.{0,16}(?:完工量|新接订单量|手持订单量|三大指标|同比增|全面增长)", 0.92, clusterable=True),
)

ANCHOR_SCORE_PATTERNS = (
    ("法|执法检查|经贸磋商|经贸论坛|论坛|专项行动|正确政绩观|主题团日|科技伦理|造船统计", 0.78),
    ("中美|美中|特朗普|经贸|民间|人文", 0.48),
)

EVENT_PATTERN = (
    "[㐀-鿿A-Za-z0-9\\-—－]{2,26}(?:法|执法检查|经贸磋商|经贸论坛|论坛|会议|会晤|会见|会谈|国事访问|访问|"
    "发布会|联合声明|声明|行动计划|专项行动|研讨会|联谊赛|工程|清单|制度)"
)

SCORING_EVENT_PATTERN = (
    "[㐀-鿿A-Za-z0-9-]{2,24}(?:法|执法检查|经贸磋商|经贸论坛|论坛|会议|会晤|会见|国事访问|访问|发布会|"
    "行动计划|专项行动|研讨会|联谊赛|工程|清单|制度)"
)

SCORING_ANCHORS = (
    ("粮食安全保障法", "粮食安全保障法"),
    ("粮食安全保障法执法检查", "粮食安全保障法.{0,18}执法检查|执法检查.{0,18}粮食安全保障法"),
    ("中美经贸磋商", "中美.{0,8}经贸磋商|美中.{0,8}经贸磋商"),
    ("中国-加州经贸论坛", "中国-加州经贸论坛|中国.{0,4}加州.{0,4}经贸论坛"),
    ("中美关系", "中美.{0,4}关系|美中.{0,4}关系"),
    ("中美经贸关系", "中美.{0,6}经贸关系|美中.{0,6}经贸关系"),
    ("中美民间交往", "中美.{0,10}民间交往|美中.{0,10}民间交往"),
    ("正确相处之道", "正确相处之道"),
    ("特朗普国事访问", "特朗普.{0,40}国事访问|国事访问.{0,40}特朗普"),
    ("树立和践行正确政绩观", "树立和践行正确政绩观|正确政绩观"),
    ("形式主义基层减负", "形式主义.{0,14}基层减负|基层减负.{0,14}形式主义"),
)

TOPICS = (
    ("food_security_law", "text", ("粮食安全保障法",)),
    ("correct_political_achievement", "headline", ("正确政绩观|树立和践行正确政绩观",)),
    ("youth_day_league_activity", "text", ("五四主题团日活动",)),
    ("ai_ethics_review", "text", ("人工智能科技伦理审查与服务先导计划",)),
    ("shipbuilding_industry_stats", "text", ("造船", "完工量|新接订单量|手持订单量|三大指标|同比增|全面增长")),
    (
        "china_us_relations",
        "text",
        (
            "中美|美中",
            "关系|经贸|民间|人文|青年|友谊|正确相处之道|特朗普|美国企业|加州|经贸磋商|元首会晤|访华|国事访问|匹克球",
        ),
    ),
)

LABELS = {
    ("source", "left"): "人民日報",
    ("source", "right"): "解放軍報",
    ("source_short", "left"): "人民",
    ("source_short", "right"): "軍報",
    ("match_type", "same_event"): "同一事件",
    ("match_type", "same_policy"): "同一政策",
    ("match_type", "policy_to_military"): "政策から軍事実装",
    ("match_type", "same_slogan_different_case"): "同一スローガン・別事例",
    ("match_type", "one_sided"): "片側のみ",
    ("match_type", "syndicated_or_reprint"): "転載・同文",
    ("claim", "common_ground"): "Common ground / 共通基盤",
    ("claim", "frame_shift"): "Frame shift / フレーム",
    ("claim", "actor_shift"): "Actor shift / 主役",
    ("claim", "goal_shift"): "Goal shift / 目標",
    ("claim", "threat_shift"): "Threat shift / 問題設定",
    ("claim", "solution_shift"): "Solution shift / 解決策",
    ("claim", "authority_shift"): "Authority shift / 権威源",
    ("claim", "lexical_contrast"): "Lexical contrast / 語彙",
    ("claim", "silence_map"): "Silence map / 沈黙",
    ("basis", "lexical"): "語彙",
    ("basis", "narrative"): "ナラティブ",
    ("basis", "metadata"): "メタデータ",
    ("signal", "date_and_page_prominence"): "日付・版面",
    ("signal", "policy_to_military_bridge"): "政策から軍事語彙への接続",
    ("signal", "shared_named_or_policy_terms"): "共有固有名/政策語",
    ("signal", "slogan_overlap_discounted"): "共有スローガン",
    ("signal", "text_overlap"): "本文/抜粋の重なり",
    ("signal", "title_similarity"): "タイトル一致",
    ("signal", "exact_title_match"): "完全タイトル一致",
    ("signal", "strong_title_phrase_match"): "強いタイトル/政策語一致",
    ("signal", "llm_adjudication"): "LLM判定",
    ("signal", "llm_topic_component"): "LLMトピック束",
    ("signal", "anchor_topic_component"): "アンカートピック束",
    ("signal", "local_high_precision_match"): "ローカル高精度判定",
    ("signal", "unmatched"): "片側のみ",
    ("signal", "unmatched_after_llm"): "MATCHED非採用",
    ("family", "china_us_relations"): "中美关系议题",
    ("family", "food_security_law"): "粮食安全保障法议题",
    ("family", "correct_political_achievement"): "正确政绩观议题",
    ("family", "youth_day_league_activity"): "五四主题团日活动",
    ("family", "ai_ethics_review"): "人工智能科技伦理审查先导计划",
    ("family", "shipbuilding_industry_stats"): "造船统计发布",
}

NEWSPAPER_RULES = RuleSet(
    generic_terms=GENERIC_SCORING_TERMS,
    generic_judge_terms=GENERIC_JUDGE_TERMS,
    military_cues=MILITARY_CUES,
    policy_cues=POLICY_CUES,
    slogan_cues=SLOGAN_CUES,
    anchors=ANCHORS,
    anchor_score_patterns=ANCHOR_SCORE_PATTERNS,
    event_pattern=EVENT_PATTERN,
    scoring_event_pattern=SCORING_EVENT_PATTERN,
    scoring_anchors=SCORING_ANCHORS,
    topics=tuple(TopicRule(*row) for row in TOPICS),
    policy_family="food_security_law",
    ignorable_titles=IGNORABLE_TITLES,
    title_labels=TITLE_LABELS,
    publisher_prefixes=PUBLISHER_PREFIXES,
    stray_title_prefix="动",
    labels=LABELS,
)
