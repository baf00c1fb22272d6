"""Extraction: event dates, entities, relations, key data. Column functions where regular expressions suffice."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of explicit dates, time signals and key data.
ISO_DATE = r"(?<!\d)((?:19|20)\d{2})-(0?[1-9]|1[0-2])-([12]\d|3[01]|0?[1-9])(?![\dT])"
SLASH_DATE = r"((?:19|20)\d{2})/(0?[1-9]|1[0-2])/([12]\d|3[01]|0?[1-9])(?!\d)"
CJK_DATE = r"(?<!\d)((?:19|20)\d{2})\s*年\s*(0?[1-9]|1[0-2])\s*月\s*([12]\d|3[01]|0?[1-9])\s*日?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NAMED_DATE = (
    r"\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?)"
    r"\s+([12]?\d|3[01])(?:st|nd|rd|th)?(?:,?\s*((?:19|20)\d{2}))?\b"
)
SIGNAL = (
    r"(?i)\b(?:19|20)\d{2}\b|(?:19|20)\d{2}[/\-年]|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b|"
    r"昨|今|前天|上周|上个月|去年|前年|天后|天前|周后|周前|月后|月前|年前|次日|"
    r"yesterday|ago|later|today|last\s+(?:night|week|month|year|tuesday|wednesday|thursday|friday|saturday|sunday|monday)|"
    r"this\s+(?:morning|afternoon|week|month)|tonight|tomorrow|\d+\s*(?:day|days|week|weeks|month|months|year|years)\b"
)
# Spans of time with a number, and which way they go; words for a day, in the order in which they are looked for; days of a unit.
SPANS = (
    (r"(?i)(\d+)\s*(day|week|month|year)s?\s+ago", -1),
    (r"(?i)(?<![a-zA-Z])in\s+(\d+)\s*(day|week|month|year)s?\b", 1),
    (r"(\d+)\s*(天|周|个月|年)\s*前", -1),
    (r"(\d+)\s*(天|周|个月|年)\s*(?:后|之后)", 1),
)
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365, "天": 1, "周": 7, "个月": 30, "年": 365}
BEFORE_WEEKDAY = (
    (r"(?i)\btoday\b", 0), (r"(?i)\byesterday\b", -1), (r"(?i)\btomorrow\b", 1),
    (r"(?i)\btonight\b|\bthis\s+morning\b|\bthis\s+afternoon\b", 0), (r"(?i)\blast\s+night\b", -1),
)
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
AFTER_WEEKDAY = ((r"昨\s*天", -1), (r"前天", -2), (r"去年", -365), (r"上个月", -30), (r"上周", -7), (r"今年", 0))
KEY_DATA = (
    ("percent", r"\d+(?:\.\d+)?\s*%"),
    ("money", r"\d+(?:\.\d+)?\s*(?:万|亿|元|块|k|K)"),
    ("date", r"\d{4}\s*[-/年]\s*\d{1,2}\s*(?:[-/月]\s*\d{1,2}\s*日?)?|\d{1,2}\s*月\s*\d{1,2}\s*日"),
    ("number", r"\d+(?:\.\d+)?"),
    ("conclusion", r"(?:通过|失败|成功|完成|修复|解决|根因|原因|上线|部署|拒绝|回滚|禁止|必须|不得|允许|PASS|FAIL|approved|rejected)"),
)
ENTITY_TOLD = r"([\x{4e00}-\x{9fff}A-Za-z0-9_\-]{2,40}（(?:系统|项目|模型|平台|方案|工具|库|模块)）)"
ENTITY_SUFFIX = r"([\x{4e00}-\x{9fff}A-Za-z0-9_]{2,30}(?:系统|平台|引擎|模型|库|框架|工具|项目))"
ENTITY_QUOTED = r"[《「『\"“]([\x{4e00}-\x{9fff}A-Za-z0-9_\-]{2,40})[」』\"”》]"
# Verbs of each relation and the confidence that each gives; those that a scan of a text leaves out; words that vote for no relation.
VERBS = {
    "decides": (("拍板", 0.95), ("决定", 0.90), ("批准", 0.90), ("否决", 0.90), ("裁定", 0.85), ("指示", 0.85), ("拍板定案", 0.95), ("确认", 0.80), ("定下", 0.85)),
    "proposes": (("提出", 0.90), ("建议", 0.85), ("提议", 0.85), ("推荐", 0.80)),
    "implements": (("实现", 0.90), ("落地", 0.85), ("部署", 0.85), ("上线", 0.85), ("发布", 0.80), ("建成", 0.85), ("完成", 0.75), ("修复", 0.80), ("整改", 0.80)),
    "develops": (("开发", 0.90), ("负责", 0.85), ("创建", 0.85), ("设计", 0.80), ("重构", 0.80), ("编写", 0.75), ("搭建", 0.80)),
    "depends_on": (("依赖", 0.90), ("基于", 0.85), ("建立在", 0.85), ("依托", 0.80), ("指向", 0.80)),
    "related_to": (("根因", 0.85), ("相关", 0.80), ("关联", 0.80), ("涉及", 0.80)),
    "uses": (("使用", 0.85), ("采用", 0.85), ("复用", 0.85), ("调用", 0.80), ("利用", 0.80), ("选用", 0.80)),
    "part_of": (("属于", 0.90), ("组成部分", 0.90), ("隶属", 0.85), ("包含", 0.80)),
    "conflicts": (("冲突", 0.85), ("矛盾", 0.85), ("相反", 0.85), ("不一致", 0.80), ("相悖", 0.85)),
    "event_occurred": (("发生", 0.85), ("出现", 0.75), ("爆发", 0.85), ("实施", 0.75), ("执行", 0.70), ("启动", 0.75), ("进行", 0.65), ("召开", 0.85)),
}
UNSCANNED = ("修复", "整改", "指向", "根因", "相关", "关联", "涉及", "组成部分")
SUBJECT_LEADS = ("已", "并", "不", "需", "应", "要", "将", "再", "可", "须", "都", "还", "就", "且", "则", "才", "也", "请", "建议", "务必", "必须", "应当", "应该", "可以", "能", "会")
OBJECT_LEADS = ("了", "的", "并", "且", "然后", "同时", "其中", "此外", "但是", "以及", "还有", "需要", "必须", "务必", "需重启", "需", "待", "等")
OBJECT_ENDS = ("并", "且", "然后", "同时", "其中", "此外", "但是", "以及", "还有")
CHECKED = ("完成", "通过", "一致", "无误", "OK")  # what is confirmed without being decided


def _parts(col: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.regexp_extract(col, pattern, i) for i in groups]


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _named(col: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) as texts of the first date with a month's name; the year may be empty."""
    name, day, year = _parts(col, NAMED_DATE, 1, 2, 3)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(F.lower(name), 1, 3)).cast("string")
    return year, month, day


def explicit_date(col: Column) -> Column:
    """The first full date of a text, numbers before names; null if none is valid."""
    return F.coalesce(*[_day(*_parts(col, p, 1, 2, 3)) for p in (ISO_DATE, SLASH_DATE, CJK_DATE)], _day(*_named(col)))


def yearless_date(col: Column, anchor: Column) -> Column:
    """A month and a day without a year: in the anchor's year, or the one before if the month is later than the anchor's."""
    year, month, day = _named(col)
    own = F.year(anchor) - F.when(month.cast("int") > F.month(anchor), 1).otherwise(0)
    return F.when((year == "") & (day != ""), _day(own.cast("string"), month, day))


def relative_date(col: Column, anchor: Column) -> Column:
    """A day told from the anchor: a number of days, weeks, months or years, then a word for a day, a weekday, a week, a month or a year."""
    units = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])
    found = []
    for pattern, way in SPANS:
        n, unit = _parts(col, pattern, 1, 2)
        found.append(n.try_cast("int") * F.try_element_at(units, F.lower(unit)) * way)
    weekday = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.lower(F.regexp_extract(col, r"(?i)\blast\s+(tuesday|wednesday|thursday|friday|saturday|sunday|monday)", 1))) - 1
    back = F.pmod(F.weekday(anchor) - weekday, F.lit(7))
    found += [F.when(col.rlike(pattern), days) for pattern, days in BEFORE_WEEKDAY]
    found.append(F.when(weekday >= 0, -F.when(back == 0, 7).otherwise(back)))
    found += [F.when(col.rlike(pattern), days) for pattern, days in AFTER_WEEKDAY]
    return F.date_add(anchor, F.coalesce(*found).cast("int"))


def event_date(col: Column, anchor: Column) -> Column:
    """(day, confidence) of a text: full dates 0.95, those told from the anchor 0.85; texts without a signal are not searched."""
    full, near = explicit_date(col), F.coalesce(yearless_date(col, anchor), relative_date(col, anchor))
    found = F.struct(F.coalesce(full, near).alias("day"), F.when(full.isNotNull(), 0.95).when(near.isNotNull(), 0.85).alias("confidence"))
    return F.when(col.rlike(SIGNAL), found)


def entities(col: Column) -> Column:
    """Names that brackets tell the kind of, names in quotation or book-title marks, and names with a known suffix, 2 to 60 characters, once each."""
    told = F.regexp_extract_all(col, F.lit(ENTITY_TOLD), 1)
    quoted = F.regexp_extract_all(col, F.lit(ENTITY_QUOTED), 1)
    suffixed = F.regexp_extract_all(col, F.lit(ENTITY_SUFFIX), 1)
    return F.array_distinct(F.filter(F.concat(told, quoted, suffixed), lambda n: F.length(n).between(2, 60)))


_TRIPLE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("subject", "relation", "object")] + [T.StructField("confidence", T.DoubleType())]))
_RELATION = {verb: (relation, sure) for relation, own in VERBS.items() for verb, sure in own if verb not in UNSCANNED}


def _any(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, sorted(words, key=len, reverse=True)))


_VERB = re.compile(_any(tuple(_RELATION)))
_CUT = re.compile(r"[。；！？\n:：;，,）)]")
_LEADS = re.compile(f"(?:{_any(SUBJECT_LEADS)})+")
_OBJECT_LEADS = re.compile(f"(?:{_any(OBJECT_LEADS)})+")
_OBJECT_ENDS = re.compile(f"(?<=.)(?:{_any(OBJECT_ENDS)})(?=.)", re.DOTALL)
_MARKS = re.compile(r"[\s，。；、()【】《》\"'“”‘’：:,.·\-_/]")
_BEFORE, _AROUND, _BESIDE = frozenset(" 、（(【\""), frozenset(" 、）)】\""), " 、"
# What tells of an event, at or before its verb; beginnings of a subject that are no names.
EVENT_SIGNAL = r"(?:19|20)\d{2}|发生|出现|爆发|召开|上线|发布|启动|完成|通过"
NO_SUBJECT = r"\d{1,4}(?:\s|:|$)|\d{2}:\d{2}"
_SIGNAL, _NO_SUBJECT = re.compile(EVENT_SIGNAL), re.compile(NO_SUBJECT)
#: Characters of a subject and an object at most, and of the piece in which an object must end: an object behind more leading words than that is none.
SUBJECT, OBJECT, PIECE = 40, 60, 400


@dataclass(frozen=True)
class Rules:
    """What a deployment knows of its own names: (pattern, name or group) for subjects and objects, the first that is found counts, and phrases
    (pattern, relation, subject, object) without a verb, where a number is a group and a text stands for itself."""

    subjects: tuple[tuple[str, str | int], ...] = ()
    objects: tuple[tuple[str, str | int], ...] = ()
    phrases: tuple[tuple[str, str, str | int, str | int], ...] = ()


def _called(name: str, rules: tuple[tuple[str, str | int], ...]) -> str:
    for pattern, to in rules:
        m = re.search(pattern, name)
        if m:
            return m[to] if isinstance(to, int) else re.sub(pattern, to, name)
    return name


def _plain(subject: str, obj: str) -> bool:
    """Whether both can be names: no times or numbers, chains of steps or brackets."""
    return bool(subject) and len(obj) >= 2 and not _NO_SUBJECT.match(subject) and "→" not in subject and "->" not in subject and not obj.startswith(("（", "("))


def _key(name: str) -> str:
    return _MARKS.sub("", name).lower()


def _clauses(text: str):
    """(start, end, first verb, verbs) of each clause that holds verbs: the marks and the verbs of a text are each found once."""
    verbs, at = list(_VERB.finditer(text)), 0
    start = 0
    for cut in [*(m.start() for m in _CUT.finditer(text)), len(text)]:
        first = at
        while at < len(verbs) and verbs[at].start() < cut:
            at += 1
        if at > first:
            yield start, cut, verbs[first:at]
        start = cut + 1


def _subject_start(text: str, start: int, end: int) -> int:
    """Where a clause's subject begins, behind opening marks and leading words."""
    for skip in (_BEFORE, None, _AROUND):
        if skip is None:
            m = _LEADS.match(text, start, end)
            start = m.end() if m else start
        else:
            while start < end and text[start] in skip:
                start += 1
    return start


def _object(piece: str) -> str:
    piece = piece.strip(_BESIDE)
    m = _OBJECT_LEADS.match(piece)
    return _OBJECT_ENDS.split(piece[m.end() :] if m else piece, maxsplit=1)[0].strip(_BESIDE)


def scan_triples(text: str | None, rules: Rules = Rules()) -> list[tuple[str, str, str, float]]:
    """(subject, relation, object, confidence) around each verb; both sides end at the nearest mark.

    Left out: a subject that holds a verb itself or is nothing but leading words, an object of one character, one that is its own
    subject, what was merely found to be complete or passed, events that nothing tells of before, names that are times, chains or brackets, and repeats.
    A text is read once, however many verbs a clause has.
    """
    text, out, known = text or "", [], set()
    told = _SIGNAL.search(text)
    since = told.end() if told else len(text) + 1

    def put(subject: str, relation: str, obj: str, sure: float) -> None:
        subject, obj = _called(subject, rules.subjects), _called(obj, rules.objects)
        if (key := (relation, _key(subject), _key(obj))) not in known:
            known.add(key)
            out.append((subject, relation, obj, sure))

    for start, stop, verbs in _clauses(text):
        begin = _subject_start(text, start, verbs[-1].start())
        for m in verbs:
            relation, sure = _RELATION[m[0]]
            end = m.start()
            while end > begin and (text[end - 1] in _AROUND or text[end - 1] in _BEFORE):
                end -= 1
            if not 0 < end - begin <= SUBJECT:
                continue
            subject, obj = text[begin:end], _object(text[m.end() : min(stop, m.end() + PIECE)])
            if len(obj) > OBJECT or not _plain(subject, obj) or _VERB.search(subject) or (m[0] == "确认" and obj.startswith(CHECKED)):
                continue
            if _key(subject) == _key(obj) or (relation == "event_occurred" and since > m.end()):
                continue
            put(subject, relation, obj, sure)
    for pattern, relation, who, what in rules.phrases:
        for m in re.finditer(pattern, text):
            subject, obj = ((m[x] if isinstance(x, int) else x).strip("，、：:()【】") for x in (who, what))
            if _plain(subject, obj):
                put(subject, relation, obj, 0.85)
    return out


@F.pandas_udf(_TRIPLE)
def triples(col: pd.Series) -> pd.Series:
    """Relations of a text: overlapping heuristics around verbs, which no JVM function expresses."""
    return col.map(scan_triples)


# Days and months in a question, in figures or words.
ASKED_DAY = r"(?<!\d)((?:19|20)\d{2})\s*[-/年.]\s*(\d{1,2})\s*[-/月.]\s*(\d{1,2})\s*日?"
ASKED_MONTH = r"(?<!\d)((?:19|20)\d{2})\s*[-/年.]\s*(\d{1,2})\s*月?(?!\s*[-/年.]?\s*\d)"


def asked_window(col: Column) -> tuple[Column, Column]:
    """(first, last) ISO day that a question names; months, by their first day, only where it names no day. Months and days that do not exist do not count, years lie between 1970 and 2100."""

    def named(pattern: str, groups: int) -> Column:
        parts = [F.regexp_extract_all(col, F.lit(pattern), g) for g in range(1, groups + 1)]
        rows = F.arrays_zip(*[p.alias(c) for p, c in zip(parts, "ymd", strict=False)])
        year, month = (lambda r: r["y"].cast("int")), (lambda r: r["m"].cast("int"))
        day = (lambda r: r["d"].cast("int")) if groups == 3 else (lambda r: F.lit(1))
        real = F.filter(rows, lambda r: year(r).between(1970, 2100) & month(r).between(1, 12) & day(r).between(1, 31))
        return F.transform(real, lambda r: F.format_string("%04d-%02d-%02d", year(r), month(r), day(r)))

    days, months = named(ASKED_DAY, 3), named(ASKED_MONTH, 2)
    found = F.when(F.size(days) > 0, days).otherwise(months)
    return F.array_min(found), F.array_max(found)


def name_key(col: Column) -> Column:
    """A name without white space, marks and cases, for tests of equality and containment."""
    return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s，。；、()【】《》\"'“”‘’：:,.·\-_/]", ""))


# Words of a question, what joins its subjects, marks around them; words of an evaluated question that say nothing.
QUESTION = r"为什么|怎么|如何|区别|差异|选哪个|哪个好|选什么|选一个|要不要|该不该|会不会|是否|值得|带来什么|有什么影响|有什么问题|失效|对比|还是|好还是"
SUBJECTS = r"[和与或、，,／/]|vs\.?|还是|跟|及"
AROUND = " 的了吗呢吧啊：:，,。.!！?？"
EMPTY_WORDS = (
    "帮我", "请", "的", "了", "是", "怎么", "什么", "多少", "吗", "呢", "哪个", "写", "做", "推荐", "翻译", "一首", "一部", "一个", "一条", "给我", "成", "今天",
    "明天", "最近", "一下", "如何", "为什么", "要不要", "该不该", "先", "还是", "用", "在", "有", "到", "从", "和", "与", "或", "中", "上", "下", "时",
)


def _bare(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{AROUND}]+|[{AROUND}]+\z", "")


def question_subjects(col: Column) -> Column:
    """Distinct subjects of a question, sorted: runs of Latin letters and digits, and what else stands between the words that join, without leading question words; two characters at least."""
    text = F.coalesce(col, F.lit(""))
    latin = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9+#.\-]*|\d+(?:\.\d+)?)"), 1)
    rest = F.transform(F.split(text, SUBJECTS), lambda s: _bare(F.regexp_replace(_bare(F.regexp_replace(s, f"^(?:{QUESTION})+", "")), r"[A-Za-z0-9+#.\-]", "")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(latin, rest), lambda s: F.length(s) >= 2)))


def question_complexity(col: Column, concepts: Column | int = 0) -> Column:
    """(level, entities, question): a question is complex with two subjects or concepts and a word that asks, or with three."""
    n = F.size(question_subjects(col)) + concepts
    asks = F.coalesce(col, F.lit("")).rlike(QUESTION)
    level = F.when(((n >= 2) & asks) | (n >= 3), "complex").otherwise("simple")
    return F.struct(level.alias("level"), n.cast("long").alias("entities"), asks.alias("question"))


def content_words(col: Column) -> Column:
    """Runs of two CJK or three Latin letters and more, in order, without words that say nothing."""
    return F.filter(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"([\x{4e00}-\x{9fff}]{2,}|[A-Za-z]{3,})"), 1), lambda w: ~w.isin(*EMPTY_WORDS))


_KEYS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
# a number is tried from its first digit only, and never given back digit by digit
_KEY_PATTERNS = [(kind, re.compile(p.replace(r"\d+(?:\.\d+)?\s*", r"(?<!\d)\d++(?:\.\d++)?\s*+"))) for kind, p in KEY_DATA]


def key_tokens(text: str | None) -> list[tuple[str, str]]:
    """Percentages, amounts, dates, numbers and conclusions, none inside another."""
    text = text or ""
    taken, out = bytearray(len(text)), []
    for kind, pattern in _KEY_PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span()
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, kind, m[0].strip()))
    return [(kind, value) for _, kind, value in sorted(out)]


@F.pandas_udf(_KEYS)
def key_data(col: pd.Series) -> pd.Series:
    return col.map(key_tokens)


def verified(keys: Column, content: Column, summary: Column) -> Column:
    """(passed, total): tokens other than conclusions that stand in an entry."""
    strict = F.filter(keys, lambda k: k["kind"] != "conclusion")
    whole = F.concat(F.coalesce(content, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    return F.struct(F.size(F.filter(strict, lambda k: F.contains(whole, k["value"]))).alias("passed"), F.size(strict).alias("total"))
