"""Settings and fixed values of retrieval, lifecycle and ingest, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# Entry types (content and assets share "rule"), tracks, conflict classes, relations.
CONTENT_TYPES = ("lesson", "fact", "decision", "result", "insight", "principle", "info", "instruction", "correction", "record", "idea", "estimate", "rule")
ASSET_TYPES = ("spec", "skill", "cron", "workflow", "rule", "benchmark", "asset", "monitor", "design", "research", "script", "config", "reference")
VALID_TYPES = tuple(dict.fromkeys(CONTENT_TYPES + ASSET_TYPES))
TRACKS = ("semantic", "episodic")
CONFLICT_TYPES = ("independent", "extension", "conflict")
CONFLICT_SUBTYPES = ("conflict_summary_conclusion", "conflict_event_fact", "conflict_rule_semantic")
SEMANTIC_RELATIONS = ("proposes", "decides", "implements", "develops", "depends_on", "uses", "part_of", "conflicts", "related_to", "event_occurred")
BANNED_RELATIONS = ("supports", "same_type")
GRAPH_RELATIONS = ("keyword_overlap", "semantic_similar", "same_agent")
ENTITY_RELATION_WEIGHTS = {"alias_of": 1.0, "shared_entry": 0.8, "same_agent": 0.6, "same_type": 0.7, "keyword_overlap": 0.7, "semantic_similar": 0.8, "part_of": 0.9, "depends_on": 0.9}

# Complexity of an entry by type; 0.5 for all others.
TYPE_COMPLEXITY = {
    "research": 1.0, "correction": 0.95, "principle": 0.9, "method": 0.9, "methodology": 0.9, "lesson": 0.85, "decision": 0.8,
    "instruction": 0.8, "digest": 0.75, "insight": 0.7, "estimate": 0.65, "result": 0.6, "record": 0.55, "fact": 0.5, "info": 0.45,
    "context": 0.4, "l4b": 0.85, "qa": 0.7, "benchmark": 0.9, "rule": 0.9, "spec": 0.85, "workflow": 0.85, "skill": 0.8, "asset": 0.7,
    "monitor": 0.7, "cron": 0.6, "design": 0.85, "script": 0.6, "config": 0.5, "reference": 0.6,
}

# Patterns that a summary or an address must not match.
BANNED_SUMMARIES = (r"^(test|测试|忽略|delete|remove)\s*$", r"^你是一个AI(助手|助理|模型)", r"system prompt", r"^#+\s*$")
DENIED_URLS = ("login", "signin", "sign-in", "paywall", "subscribe", "登录", "付费", "会员", "个人数据", "隐私", "账号")
STOCK_PHRASES = ("你好", "好的", "收到", "明白了", "嗯", "ok", "好的收到", "了解", "知道了", "没问题", "谢谢", "再见", "好的好的")
STOP_CHARS = "的了是在与和及或就都也很于这那之而以对其为因由被把"
STOP_WORDS = (
    "一个", "这个", "那个", "可以", "需要", "应该", "必须", "进行", "通过", "我们", "你们", "他们", "相关", "以及", "并且", "因为", "所以",
    "如果", "但是", "还是", "或者", "对于", "关于", "同时", "目前", "已经", "正在", "the", "a", "an", "of", "to", "in", "on", "for", "and",
    "or", "is", "are", "was", "were", "be", "been", "with", "that", "this", "it",
)
NEGATIONS = (
    "不", "未", "无", "非", "勿", "别", "莫", "禁", "禁止", "避免", "不可", "不能", "不得", "不要", "无法", "不应该", "不需要", "没必要",
    "never", "not", "no", "don't", "dont", "cannot", "can't", "cant", "shouldn't", "shouldnt", "mustn't", "mustnt", "won't", "wont",
)
RULE_WORDS = ("规则", "应该", "必须", "禁止", "不要", "允许", "需要", "务必", "always", "never", "must", "should", "shall", "required", "do not", "don't", "dont")
ANTONYMS = (
    ("提高", "降低"), ("提升", "下降"), ("增加", "减少"), ("上升", "下降"), ("上涨", "下跌"), ("成功", "失败"), ("正确", "错误"),
    ("有效", "无效"), ("启用", "禁用"), ("开启", "关闭"), ("允许", "禁止"), ("支持", "反对"), ("增强", "削弱"), ("加速", "减速"),
    ("扩张", "收缩"), ("买入", "卖出"), ("应该", "不应该"), ("必须", "禁止"), ("快", "慢"), ("多", "少"), ("高", "低"), ("大", "小"),
    ("好", "坏"), ("安全", "危险"), ("涨", "跌"), ("开", "关"), ("新", "旧"), ("强", "弱"),
)
# Units; numbers clash only if both texts count in one of them.
UNITS = ("万", "元", "人", "日", "年", "月", "天", "小时", "分钟", "秒", "%", "％", "倍", "次", "个", "台", "家", "公里", "米", "斤", "吨", "度", "层", "版", "期", "号", "点")
DEDUP_NEGATION_CHARS = "不没非勿无别禁否停拒免莫未休"
DEDUP_NEGATION_TOKENS = ("取消", "删除", "撤销", "关闭", "停止", "禁止", "拒绝", "无法", "不能", "不会", "不要", "无需", "不得", "不可", "不准", "尚未")
# Words that deny or correct, in the order in which they are looked for, and limits of the contradiction rules.
INSTRUCTION_HINTS = ("规则", "流程", "模式", "步骤", "必须", "禁止", "任何", "先", "SOP", "规范", "纪律", "铁律", "要求", "建议", "如何", "要不要", "该不该", "怎么")
CONTRADICTION_SIGNALS = ("不是", "误判", "纠正", "实为", "推翻", "而非", "≠", "作废", "假阳性", "不应", "不能用", "不适用", "否定", "别用")
OBJECT_CHARS, OBJECT_LIMIT, SAME_LIMIT = 24, 0.35, 0.85
# Router words.
ROUTER_ID = r"[A-Za-z]{2,}[-_][A-Za-z0-9]+|\d{4,}|[\w.-]+\.(?:py|json|yaml|yml|sh|db|md|log|conf|plist|toml|bak)\b"
ROUTER_FAST = ("cron", "launchd", "brew", "sqlite", "python", "node", "npm", "nginx", "docker", "redis", "kafka", "mysql", "error", "debug", "fix", "api", "sdk", "cli", "yaml", "json")
ROUTER_TOOLS = ("报错", "崩溃", "修复", "补丁", "版本", "配置", "日志", "权限", "升级", "安装", "删除", "备份", "恢复", "迁移", "脚本", "命令", "进程", "端口", "文件", "目录", "失败")
ROUTER_FUZZY = ("什么", "怎么", "为什么", "如何", "哪些", "哪个", "有没有", "是否", "多少", "那个", "上次", "之前", "记得", "关于", "所有", "全部", "总结", "概述", "是什么", "什么是", "怎么办", "介绍", "区别", "对比")

#: The instant that stands for "now" wherever a query needs one.
NOW = "2026-09-01T00:00:00Z"


@dataclass(frozen=True)
class Search:
    """Settings of one search."""

    top_k: int = 5
    rrf_k: int = 60
    weights: dict = field(default_factory=lambda: {"fts": 1.3, "emb": 0.6, "graph": 1.0})
    baseline_weights: dict = field(default_factory=lambda: {"fts": 1.5, "emb": 0.7, "graph": 1.0})
    confidence_boost: float = 0.3
    default_confidence: float = 0.5
    candidates: int = 200
    backfill: int = 40
    note_score: float = 8.0
    forget_days: int = 90
    forget_age_days: int = 30
    forget_factor: float = 0.6
    quality: tuple = (0.10, 0.03, 0.01)
    fts_scale: float = 300.0
    now: str = NOW
    router: bool = False
    gate: bool = False
    time: bool = False
    graph: bool = False
    contradictions: bool = False
    instructions: bool = False
    rerank: bool = False
    rerank_pool: int = 20
    soft_line: float = 4.6329  # below this best score of the words alone, a routed query is asked in full
    graph_seeds: int = 30
    graph_per_seed: int = 3
    graph_top: int = 15
    graph_gate: float = 0.35
    time_top: int = 15
    time_days: int = 30
    probes: int = 0  # cells of a vector index to open; 0: as many as it measured to be needed

    @property
    def weight_factor(self) -> float:
        return sum(self.baseline_weights.values()) / sum(self.weights.values())
