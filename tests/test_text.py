import re

import pytest
from pyspark.sql import functions as F

from quire.functions import rules, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [("第一行\r\n第二行\r第三行", "第一行\n第二行\n第三行"), ("多个    空格    和\t制表符", "多个 空格 和 制表符"), ("文本\x00\x01\x02内容", "文本内容"), ("", ""), (None, ""), ("a\n \n \nb", "a\n\n\nb"), ("a\r\rb\r\n", "a\n\nb"), ("　全角　", "全角"), ("  \t", "")],
)
def test_clean_structure(spark, given, want):
    assert one(spark, given, text.clean_structure) == want


def test_simplified(spark):
    got = one(spark, "這是繁體中文，包含壹些複雜的字", lambda c: text.simplified(spark, c))
    assert "这是" in got and "复杂" in got


def test_rules(spark):
    rule = [rules.Rule("r", "测试替换", "替换成功")]
    assert one(spark, "这是测试替换的内容", lambda c: rules.apply_rules(c, rule)) == "这是替换成功的内容"
    assert one(spark, " 12 ", rules.apply_rules) == ""
    assert one(spark, "a\n12\nb", rules.apply_rules) == "a\n12\nb"
    swap = [rules.Rule("s", "(a)(b)", r"\2\n\1")]
    assert one(spark, "ab", lambda c: rules.apply_rules(c, swap)) == "b\na"


@pytest.mark.parametrize(("a", "b", "passed", "issues"), [("这是一段正常的文本内容，长度足够通过检查。",) * 2 + (True, 0), ("x", "短", False, 1), ("x" * 9, "清洗后", False, 1), (None, None, False, 1), ("x" * 20, "�" * 5 + "正常" * 3, False, 1)])
def test_quality(spark, a, b, passed, issues):
    q = spark.createDataFrame([(a, b)], "a string, b string").select(text.quality_report(F.col("a"), F.col("b")).alias("q")).first()["q"]
    assert (q["passed"], len(q["issues"])) == (passed, issues)


def test_scan_lines(spark):
    got = one(spark, "这是一个com-\nputer示例，还有tele-\nphone。", text.join_hyphens)
    assert "com-\nputer" not in got and "tele-\nphone" not in got
    assert one(spark, "这是第一行\n这是第二行\n这是第三行。\n\n新段落开始\n继续新段落。", text.merge_lines) == "这是第一行 这是第二行 这是第三行。\n\n新段落开始 继续新段落。"
    assert one(spark, "", text.merge_lines) == ""


def merged(s):
    """Lines joined one after the other."""
    out, now, blank = [], "", True
    for line in s.split("\n"):
        line = line.strip()
        if not line:
            blank = True
            continue
        if now and not blank and not re.search(r"[.。!！?？;；:：]$", now) and not (line[0].isupper() or line[0].isdigit()):
            now += " " + line
        else:
            if now:
                out.append(now)
            now = line
        blank = False
    return re.sub(" +", " ", "\n\n".join([*out, now])).strip()


@pytest.mark.parametrize("s", ["a\nb\nC\nd.\ne\n\n\nf", "x  y\n z", "\n\n", "1\n2\na", "Ä\nö;\nü"])
def test_merge_lines_is_the_sequential_fold(spark, s):
    assert one(spark, s, text.merge_lines) == merged(s)


def test_tokens(spark):
    assert one(spark, "Été ABC 12测试x9", text.tokens) == ["t", "abc", "x", "测", "试", "12", "9"]
