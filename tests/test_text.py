import random
import time

from pyspark.sql import functions as F

from corpusdiff.functions import labels as lb
from corpusdiff.functions import text as t
from corpusdiff.operators import graph as g
from corpusdiff.operators import scoring as sc
from corpusdiff.operators import signals as sg
from corpusdiff.operators.articles import MAX_PAGE, normalize_articles
from corpusdiff.rules import NEWSPAPER_RULES as R
from corpusdiff.rules import RuleSet
from corpusdiff.sources.html import coordinate_pairs


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return list(row) if len(row) > 1 else row[0]


def lit(x):
    return F.lit(x)


def test_normal_forms(spark):
    assert one(spark, t.norm_term(lit("《a b》：c　 d"))) == "abcd"
    assert one(spark, t.norm_anchor(lit("中国—加州－x"))) == "中国-加州-x"
    assert one(spark, t.collapse_ws(lit("　a \n b﻿"))) == "a b"
    assert one(spark, t.string_value(lit(" 　 "))) is None


def test_entities_are_decoded_once(spark):
    assert one(spark, t.decode_entities(lit("&amp;lt; &#38;lt; &copy; &#x4e2d;&#20013; &#abc; &quot;"))) == '&lt; &lt; &copy; 中中 &#abc; "'


def test_paragraphs_and_excerpt(spark):
    html = "<script>var t='</p>'</script><p>a<br>b</p><p> </p><p>&amp;amp;</p>"
    assert one(spark, t.paragraph_text(lit(html))) == "a b &"
    assert one(spark, t.paragraph_text(lit("<b>x</b> y"))) == "x y"
    short, empty, mid, long = one(spark, *[t.excerpt(lit("x" * n), 180) for n in (71, 0, 100, 1000)])
    assert short == t.SHORT_TEXT_NOTICE and empty == ""
    assert (len(mid), len(long)) == (73, 180) and mid.endswith("…")


def test_between_and_truncate(spark):
    assert one(spark, t.between(lit("aXbYc"), "X", "Y"), t.between(lit("aXb"), "X", "Y")) == ["b", None]
    assert one(spark, t.truncate(lit("ab  cdef"), 5)) == "ab c…"
    assert one(spark, t.truncate(lit("abcdefghij"), 6, "...")) == "abc..."


def test_canonical_titles(spark):
    def canon(x):
        return tuple(one(spark, t.canonical_title(lit(x), R)))

    assert canon("2026年全国防灾减灾日暨防灾减灾宣传周主场活动举行") == ("全国防灾减灾日暨防灾减灾宣传周主场活动举行", "2026")
    assert canon("中央宣传部、全国总工会联合发布2026年“最美职工”") == ("联合发布2026年最美职工", None)
    assert canon("第十三批在韩")[0] == "第13批在韩"
    assert canon("第二十届（ 社论 ）第百次")[0] == "第20届第百次"
    assert canon("在新征程上（社论）")[0] == "在新征程上"
    assert canon("ＡＢ<br/>c&nbsp;d")[0] == "ABcd"
    assert one(spark, t.year_conflict(lit("2025"), lit("2026")), t.year_conflict(lit("2025"), lit(None))) == [True, False]


def test_shingles(spark):
    assert one(spark, *[t.shingles(lit(x), 2) for x in ("abcd", "a", "")]) == [["ab", "bc", "cd"], ["a"], []]
    sizes = one(spark, *[F.size(t.shingle_codes(lit(x), 3)) for x in ("abcd", "ab", "", "aaaaaa", "𠀀bcd")])
    assert sizes == [2, 1, 0, 1, 2]
    assert one(spark, t.longest_common_substring(lit("abcxyz"), lit("zxyzabc"))) == "abc"


def test_term_values(spark):
    weights = one(spark, *[F.round(sg.term_weight(lit(x), R), 4) for x in ("发展", "部队训练", "abcdef", "ab")])
    assert weights == [0.35, 1.2, 1.0, 0.45]
    scores = one(spark, *[sg.anchor_score(lit(x), R) for x in ("靖国神社", "反垄断法", "经贸", "其他")])
    assert scores == [0.96, 0.78, 0.48, 0.34]
    assert one(spark, sg.is_strong_short(lit("靖国神社"), R), sg.is_high_value(lit("经贸"), R)) == [True, False]


def test_scores(spark):
    def title(a, b):
        x, y = t.norm_comparable(lit(a)), t.norm_comparable(lit(b))
        return one(spark, sc.title_score(x, y, t.shingles(lit(a), 2), t.shingles(lit(b), 2)))

    assert [title("abcd", "abcd"), title("abc", "abcd"), round(title("abcd", "abxy"), 6), title("", "abc")] == [1, 0.84, 0.2, 0]
    base = lit("2026-05-01").cast("date")
    assert one(spark, *[sc.date_proximity(base, F.date_add(base, n)) for n in (0, 1, 3, 7, 14, 15)]) == [1, 0.9, 0.75, 0.52, 0.26, 0.08]
    assert one(spark, sc.date_proximity(base, lit(None).cast("date"))) == 0.5
    assert one(spark, *[sg.page_prominence(lit(n)) for n in (1, 3, 7, 8, MAX_PAGE)]) == [1, 0.8, 0.56, 0.34, 0.45]
    assert round(one(spark, sc.metadata_score(lit(1.0), lit(1.0), lit(0.56))), 4) == 0.9384
    assert one(spark, *[g.normalize_metric(lit(x).cast("double")) for x in (None, 0.5, 1.0, 3.0)]) == [0.45, 0.5, 0.25, 0.5]


def test_points_and_labels(spark):
    found = one(spark, coordinate_pairs(F.split(lit("1,2,x,4,5"), ",")))
    assert [(p.x, p.y) for p in found] == [(1.0, 2.0)]
    a, b = lit("2026-05-01").cast("date"), lit("2026-05-03").cast("date")
    assert one(spark, lb.fmt_date_range(a, a), lb.fmt_date_range(a, b)) == ["2026.05.01", "2026.05.01 - 2026.05.03"]
    assert one(spark, lb.fmt_percent(lit(0.125)), lb.confidence_tone(lit(0.7)), lb.page_level(lit(4))) == ["13%", "中", 2]


def test_article_shapes(spark):
    rows = spark.createDataFrame(
        [
            (None, "", "H", "3版", ("X", "sub", "E", ["部队"])),
            ("i2", None, None, "x", (None, None, None, None)),
        ],
        "id string, title string, headline string, page string, extraction struct<source_article_id:string,subtitle:string,text:string,keywords:array<string>>",
    )
    first, second = normalize_articles(rows, R).collect()
    assert (first.id, first.title, first.page_number, first.article_text, first.keywords) == ("X", "", 3, "sub E", ["部队"])
    assert (second.id, second.title, second.judge_title, second.page_number) == ("i2", "", "Untitled", MAX_PAGE)


def test_rule_tables_round_trip(spark):
    tables = R.to_tables(spark)
    again = RuleSet.from_tables(tables)
    assert again.anchors == R.anchors and again.topics == R.topics and set(again.military_cues) == set(R.military_cues)


def test_newspaper_anchors(spark):
    text = lit("全国人大常委会启动粮食安全保障法执法检查，中国—加州经贸论坛举行")
    found = one(spark, sg.anchor_terms(text, lit(""), R))
    assert found[:4] == ["粮食安全保障法", "粮食安全保障法执法检查", "全国人大常委会执法检查", "中国-加州经贸论坛"]
    assert one(spark, sg.topic_families(t.norm_anchor(text), lit(""), R)) == ["food_security_law"]


def test_numeric_entities_of_any_length(spark):
    def decoded(text):
        return one(spark, t.decode_entities(lit(text)))

    assert decoded("&#x000000041;&#00000000065;&#x1F600;&#128512;") == "AA😀😀"
    for kept in ("&#x110000;", "&#9999999999;", "&#xFFFFFFFF;", "&#xD800;", "&#57343;", "&#x;", "&#;", "&#99999999999999999999;"):
        assert decoded(f"a {kept} b") == f"a {kept} b"


def test_long_numbers_are_not_cut(spark):
    assert one(spark, t.parse_int(lit(" 12345678901"))) is None
    assert one(spark, t.parse_int(lit("1234567890x"))) == 1234567890
    assert one(spark, t.parse_int(lit("-12 3"))) == -12


def plain_common(a, b):
    for size in range(min(len(a), len(b)), 0, -1):
        for at in range(len(a) - size + 1):
            if a[at : at + size] in b:
                return a[at : at + size]
    return ""


def test_longest_common_part_equals_trying_all_parts(spark):
    rng = random.Random(4)
    texts = ["", "a", "aaaa", "aaaaaaab", "abcabcabc", "漢字と漢字", "😀x😀"] + ["".join(rng.choice("ab漢") for _ in range(rng.randint(0, 25))) for _ in range(60)]
    for a in texts:
        for b in texts[::3]:
            assert t.SuffixAutomaton(b).longest_part(a) == plain_common(a, b)
    rows = [(rng.choice([*texts, None]), rng.choice([*texts, None])) for _ in range(300)]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", t.longest_common_substring("a", "b").alias("c")).collect()
    for r in found:
        assert r["c"] == (None if r["a"] is None or r["b"] is None else plain_common(r["a"], r["b"])) or "" in (r["a"], r["b"])


def test_long_titles_take_milliseconds():
    rng = random.Random(5)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(10_000)) for _ in range(2))
    start = time.time()
    part = t.SuffixAutomaton(b).longest_part(a)
    assert part in a and part in b and time.time() - start < 0.5
