"""Text rules by cases that are written down, not computed by the library."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import library


def one(spark, f, *given):
    df = spark.createDataFrame([(x,) for x in given], "x string")
    return [r[0] for r in df.select(f(df.x)).collect()]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("编码器先把句子切成 token[1706.03762:p0001:s0003]。", "编码器先把句子切成 token。"), ("提出了多头注意力 1706.03762:p0002:s0001 用来并行看不同位置。", "提出了多头注意力 用来并行看不同位置。"),
        ("这篇论文提出了 Transformer[1706.03762:p0001]。", "这篇论文提出了 Transformer。"), ("相关性高 [abc:c0001]。", "相关性高。"), ("[12] [c12] x:p12 stays", "[12] [c12] x:p12 stays"), (None, ""),
    ],
)
def test_places_of_chunks(spark, given, want):
    assert one(spark, text.without_markers, given) == [want]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Abstract", "abstract"), ("## ABSTRACT: we show that", "abstract"), ("摘要：本文", "abstract"), ("abstracts", ""), ("1. Introduction", "introduction"), ("XIV) introduction and aims", "introduction"),
        ("# 2、引言", "introduction"), ("Introductory", ""), ("References", "references"), ("IX. Reference ", "references"), ("References follow", ""), ("参考文献", "references"), ("Bibliography:", ""), (None, ""),
    ],
)
def test_headings(spark, given, want):
    df = spark.createDataFrame([(given,)], "x string")
    row = df.select(*[text.is_heading(df.x, k).alias(k) for k in ("abstract", "introduction", "references")]).first()
    assert [k for k in row.asDict() if row[k]] == ([want] if want else [])


def test_names(spark):
    assert one(spark, text.safe_name, "论文：一/二", "a b", "", None, "x" * 200, "é_1-2.3", "²½") == ["论文_一_二", "a_b", "paper", "paper", "x" * 160, "é_1-2.3", "²½"]


def test_latex(spark):
    given = [
        r"The \textit{PIMAEX} reward", r"achieves 88.5\% of", r"at \href{https://a}{https://b}", r"C:\Users\Admin", r"\d+\w*\s", r"\d{2,4}", r"\Users{Admin}", r"vs.\ exploitation", r"\textbf{\textit{X}}", r"$\textbf{x}$ \textbf{y}",
        r"\textitX{a}", "\\textbf{two\nlines}", r"\alpha \lambda", r"\{x\} \$5", r"\(\emph{a}\) \[\emph{b}\] \emph{c}", r"\text{t} \mbox{m}",
    ]
    want = [
        "The PIMAEX reward", "achieves 88.5% of", "at https://b", r"C:\Users\Admin", r"\d+\w*\s", r"\d{2,4}", r"\Users{Admin}", "vs. exploitation", "X", r"$\textbf{x}$ y",
        r"\textitX{a}", "\\textbf{two\nlines}", r"\alpha \lambda", r"\{x\} \$5", r"\(\emph{a}\) \[\emph{b}\] c", "t m",
    ]
    assert one(spark, text.plain_latex, *given) == want


def test_paths_and_sentences(spark):
    assert one(spark, text.collapsed_path, "https://a/2502.20217v1/2502.20217v1/x.png", "/a/a/b", "h://x/1.2/1.2", None) == ["https://a/2502.20217v1/x.png", "/a/a/b", "h://x/1.2/1.2", None]
    assert one(spark, lambda x: text.neighbour_snippet(x, False), "It is 3.14 here. Two! Three?", "只有一句", "", "一。二！三") == ["It is 3.14 here. Two!", "只有一句", "", "一。 二！"]
    assert one(spark, lambda x: text.neighbour_snippet(x, True), "It is 3.14 here. Two! Three?", "一。二！三") == ["Two! Three?", "二！ 三"]
    assert one(spark, text.math_share, "𝑆𝛼", "a=b", "", "∑ x") == [1.0, 0.0, 0.0, 0.5]
    assert one(spark, text.is_math_line, "𝑖", "𝑆𝛼", "5") == [False, True, False]


def test_references(spark):
    row = spark.range(1).select(
        text.gbt_reference(F.array(F.lit("张三"), F.lit("李四"), F.lit("王五"), F.lit("赵六")), F.lit("T"), F.lit("V"), F.lit("2020-05"), F.lit("10.1/x"), F.lit(3), F.lit("2"), F.lit("1-9"), F.lit("Book"), F.lit("http://u")).alias("a"),
        text.gbt_reference(F.lit(None).cast("array<string>"), F.lit("T"), F.lit(None), F.lit(None), F.lit(""), None, F.lit(4), None, F.lit("Preprint"), F.lit("http://u")).alias("b"),
    ).first()
    assert row.a == "张三, 李四, 王五，等. T[M]. V, 2020, 3(2): 1-9. DOI: 10.1/x."
    assert row.b == "T[EB/OL], (4). http://u."


def test_call_pairs(spark):
    kinds = "c int, n int, role string, call_ids array<string>, call_id string, content string"
    rows = [
        (1, 1, "user", None, None, "q"), (1, 2, "assistant", ["x1"], None, "我来精读。"),  # no answer: its text stays
        (2, 1, "assistant", ["x1"], None, " "),  # nor text: a note
        (3, 1, "tool", None, "orphan", "孤儿"), (3, 2, "assistant", [], None, "正文"),
        (4, 1, "assistant", ["a", "b"], None, ""), (4, 2, "tool", None, "a", "one"), (4, 3, "tool", None, "a", "again"), (4, 4, "tool", None, None, "no id"),
        (5, 1, "tool", None, "z", "early"), (5, 2, "assistant", ["z"], None, ""), (5, 3, "tool", None, "z", "late"),
    ]
    got = {(r.c, r.n): (r.call_ids, r.content) for r in library.call_pairs(spark.createDataFrame(rows, kinds), "c", "n").collect()}
    assert got == {
        (1, 1): (None, "q"), (1, 2): ([], "我来精读。"), (2, 1): ([], library.INTERRUPTED), (3, 2): ([], "正文"), (4, 1): (["a"], ""), (4, 2): (None, "one"), (4, 3): (None, "again"), (5, 2): (["z"], ""), (5, 3): (None, "late"),
    }
    assert "中断" in library.INTERRUPTED
