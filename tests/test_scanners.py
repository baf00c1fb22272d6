"""Asset scanners over real trees of files."""

import json

import pytest

from lodestore.sources import scanners as S
from lodestore.sources.files import read_texts

FILES = {
    "skills/plan/SKILL.md": "---\nname: planner\ndescription: \"plans things\"\n---\n# Body\n",
    "skills/bare/SKILL.md": "# A bare skill\ntext\n",
    "skills/_off/SKILL.md": "# off\n",
    "skills/.hid/SKILL.md": "# hidden\n",
    "skills/old.bak/SKILL.md": "# old\n",
    "skills/plan/deep/SKILL.md": "# too deep\n",
    "skills/empty/SKILL.md": "",
    "docs/flows/release.md": "# How to release\n",
    "docs/flows/notes.txt": "no\n",
    "docs/flows/sub/inner.md": "# not direct\n",
    "docs/spec.md": "# One\ntext\n## Two\n### three\n" + "x\n" * 60 + "# Late\n",
    "docs/plain.md": "just a line of words\n",
    "bench/bank.json": json.dumps({"cases": [{"q": 1}, {"q": 2}, {"q": 3}]}),
    "bench/list.json": "[1, 2]",
    "bench/broken.json": "{no json",
    "scripts/gate.py": "# decides who may pass\nx = 1\n",
    "scripts/tool.py": "",
    "profiles/a/config.yaml": "k: 1\n",
    "profiles/b/config.yaml": "k: 2\n",
    "profiles/c/other.yaml": "k: 3\n",
    "models/readme.md": "# Models of the house\n",
    "models/run.sh": "# runs all\n",
    "models/.hidden.md": "# no\n",
    "models/weights.bin": "0\n",
    "models/small/README.md": "# A small model\n",
    "models/large/part.bin": "1\n",
    "models/run-log/README.md": "# no\n",
    "conf/site.yaml": "a: 1\n",
    "conf/部署方案.md": "# 如何部署\n",
    "conf/市场调研.html": "survey text\n",
    "conf/readme.JSON": "{}\n",
    "conf/sub/deploy.sh": "# deploys it\n",
    "conf/backup/site.yaml": "a: 0\n",
    "conf/x/.git/config.yaml": "a: 0\n",
    "conf/site.yaml.bak.md": "no\n",
    "conf/.env.yaml": "no\n",
    "conf/body.txt": "no\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    texts = spark.createDataFrame([(f"file:{root}/{name}", text or None) for name, text in FILES.items()], "path string, value string")
    return texts, str(root)


def told(df, root):
    assert df.columns == list(S.ENTRY)
    return {r["source_ref"].removeprefix(root + "/"): (r["type"], r["name"], r["summary"].split("：", 1)[1]) for r in df.collect()}


def wanted(spark, root, *rows):
    return spark.createDataFrame([(t, n, f"{root}/{p}", h) for t, n, p, h in rows], S.WANTED)


def test_skills_and_workflows(tree):
    texts, root = tree
    want = {"skills/plan/SKILL.md": ("skill", "planner", "plans things"), "skills/bare/SKILL.md": ("skill", "bare", "A bare skill"), "skills/empty/SKILL.md": ("skill", "empty", "技能包")}
    assert told(S.skills(texts, f"{root}/skills"), root) == want
    flows = told(S.workflows(texts, f"{root}/skills/", ("plan", "absent"), f"{root}/docs/flows"), root)
    assert flows == {"skills/plan/SKILL.md": ("workflow", "planner", "plans things"), "docs/flows/release.md": ("workflow", "release", "How to release")}


def test_listed_files(spark, tree):
    texts, root = tree
    docs = wanted(spark, root, ("spec", "S", "docs/spec.md", "the spec"), ("spec", "P", "docs/plain.md", "plain"), ("spec", "N", "docs/none.md", "missing"))
    rows = {r["name"]: r for r in S.specs(texts, docs).collect()}
    assert rows.keys() == {"S", "P"} and rows["S"]["content"].endswith("\n章节要点: One；Two") and rows["P"]["content"].endswith(": just a line of words")
    bench = wanted(spark, root, *[("benchmark", n, f"bench/{n}.json", "cases") for n in ("bank", "list", "broken")], ("rule", "gate", "scripts/gate.py", "a gate"), ("rule", "none", "scripts/none.py", "missing"))
    found = S.listed(texts, bench)
    got = told(found, root)
    assert {k: v[2] for k, v in got.items()} == {"bench/bank.json": "cases；用例数 3", "bench/list.json": "cases；用例数 2", "bench/broken.json": "cases", "scripts/gate.py": "a gate"}
    assert found.where("name = 'gate'").first()["content"] == f"路径: {root}/scripts/gate.py\n说明: a gate\n摘要: decides who may pass"
    tools = wanted(spark, root, ("script", "gate", "scripts/gate.py", "again"), ("script", "tool", "scripts/tool.py", "a tool"))
    scripts = S.listed(texts, tools, found)
    assert told(scripts, root) == {"scripts/tool.py": ("script", "tool", "a tool")} and scripts.first()["content"].endswith("\n摘要: a tool")


def test_folders_and_profiles(spark, tree):
    texts, root = tree
    dirs = wanted(spark, root, ("research", "docs", "docs", "papers"), ("reference", "models", "models", "all models"), ("design", "none", "none", "missing"))
    got = told(S.folders(texts, dirs), root)
    assert got == {"docs": ("research", "docs", "papers；含 3 个文件（目录级）"), "models": ("reference", "models", "all models；含 6 个文件（目录级）")}
    assert told(S.profiles(texts, f"{root}/profiles", "all"), root) == {"profiles": ("config", "all", "config.yaml；含 2 个 profile config（目录级）")}
    assert S.profiles(texts, f"{root}/none", "all").count() == 0


def test_models_and_config_documents(tree):
    texts, root = tree
    assert told(S.models(texts, f"{root}/models"), root) == {
        "models/readme.md": ("asset", "readme", "Models of the house"), "models/run.sh": ("asset", "run.sh", "runs all"),
        "models/small": ("asset", "small", "A small model"), "models/large": ("asset", "large", "模型训练资产目录"),
    }
    got = told(S.config_documents(texts, f"{root}/conf"), root)
    assert {k: v[0] for k, v in got.items()} == {"conf/site.yaml": "config", "conf/部署方案.md": "design", "conf/市场调研.html": "research", "conf/readme.JSON": "reference", "conf/sub/deploy.sh": "config"}
    assert got["conf/部署方案.md"][1:] == ("部署方案", "如何部署")


def test_read_from_disk_and_empty(spark, tree):
    texts, root = tree
    read = read_texts(spark, f"file://{root}/models")
    assert told(S.models(read, f"{root}/models"), root) == told(S.models(texts, f"{root}/models"), root)
    conf = S.config_documents(read_texts(spark, f"file://{root}/conf"), f"{root}/conf")
    assert {r["source_ref"] for r in conf.collect()} == {r["source_ref"] for r in S.config_documents(texts, f"{root}/conf").collect()}
    none = texts.limit(0)
    for df in (S.skills(none, root), S.workflows(none, root, ("a",), root), S.models(none, root), S.config_documents(none, root), S.folders(none, wanted(spark, root, ("a", "b", "c", "d"))), S.listed(none, wanted(spark, root, ("a", "b", "c", "d")))):
        assert df.count() == 0
