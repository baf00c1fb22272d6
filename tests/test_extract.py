"""Relations and key data of texts: as plain forms of the rules have them, in one pass over long texts."""

import random
import re
import time

import pytest

from lodestore.functions import extract as E

PIECES = ["系统", "依赖", "数据库", "，", "。", "已", "建议", "采用", "并且", "2024", "团队", "发生", "故障", " ", "、", "（", "）", "12:30", "→", "使用", "了", "缓存", "确认", "完成", "进行", "中", "属于", "a b", "\n", "同时", "平台"]


def plain_triples(text):
    """The same rules on copies of the text before and behind each verb."""
    out, known = [], set()
    for m in E._VERB.finditer(text):
        relation, sure = E._RELATION[m[0]]
        subject = E._CUT.split(text[: m.start()])[-1].lstrip(" 、（(【\"")
        lead = E._LEADS.match(subject)
        subject = (subject[lead.end() :] if lead else subject).lstrip(" 、）)】\"").rstrip(" 、（(【\"）)】")
        obj = E._object(E._CUT.split(text[m.end() :], maxsplit=1)[0])
        if not (1 <= len(subject) <= 40 and 2 <= len(obj) <= 60) or not E._plain(subject, obj) or E._VERB.search(subject) or (m[0] == "确认" and obj.startswith(E.CHECKED)):
            continue
        if E._key(subject) == E._key(obj) or (relation == "event_occurred" and not re.search(E.EVENT_SIGNAL, text[: m.end()])):
            continue
        if (key := (relation, E._key(subject), E._key(obj))) not in known:
            known.add(key)
            out.append((subject, relation, obj, sure))
    return out


def test_triples_equal_the_plain_form():
    r, found = random.Random(6), 0
    for _ in range(4000):
        text = "".join(r.choice(PIECES) for _ in range(r.randrange(1, 25)))
        assert E.scan_triples(text) == plain_triples(text), text
        found += len(plain_triples(text))
    assert found > 500


def test_events_need_a_signal_and_names_are_names():
    assert E.scan_triples("机房进行巡检") == []
    assert E.scan_triples("2024年机房进行巡检") == [("2024年机房", "event_occurred", "巡检", 0.65)]
    assert E.scan_triples("12:30 系统使用缓存") == [] and E.scan_triples("甲→乙使用缓存") == [] and E.scan_triples("系统使用（新）缓存") == []


def test_a_deployment_s_own_names_and_phrases():
    rules = E.Rules(subjects=((r"([a-z_]+\.py)", 1), (r"旧平台", "平台")), objects=((r"大?缓存", "缓存"),), phrases=((r"([^，。]{1,20}?)会导致([^，。]{1,20}?)冲突", "conflicts", 1, 2), (r"教训[:：]([^，。]{2,40})", "decides", "维护者", 1)))
    assert E.scan_triples("每日 sync_all.py 使用大缓存。旧平台依赖数据库", rules) == [("sync_all.py", "uses", "缓存", 0.85), ("平台", "depends_on", "数据库", 0.9)]
    assert E.scan_triples("并发写会导致写锁冲突。教训：先加锁", rules) == [("并发写", "conflicts", "写锁", 0.85), ("维护者", "decides", "先加锁", 0.85)]


def plain_keys(text):
    taken, out = [], []
    for kind, pattern in E.KEY_DATA:
        for m in re.finditer(pattern, text):
            if not any(m.start() < b and a < m.end() for a, b in taken):
                taken.append(m.span())
                out.append((m.start(), kind, m[0].strip()))
    return [(kind, value) for _, kind, value in sorted(out)]


def test_key_data_equal_the_plain_form():
    r = random.Random(2)
    pieces = ["1", "22", ".", "5", "%", " ", "万", "2024", "-", "/", "年", "3", "月", "日", "通过", "k", "x", "\n"]
    for _ in range(6000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(1, 20)))
        assert E.key_tokens(text) == plain_keys(text), text


@pytest.mark.parametrize("piece", ["系统依赖数据库", "依赖", "已", "使用了", "12 ", "1", "3.5 ", "通过", "2024-", " 、", "同时使用"])
def test_long_texts_take_a_moment(piece):
    text = piece * (500_000 // len(piece))
    began = time.time()
    E.scan_triples(text)
    E.key_tokens(text)
    assert time.time() - began < 10
