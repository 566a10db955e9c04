"""Fields of covers: each step worked out once a text, and cheap tests before patterns that change no result."""

import pytest
from pyspark.sql import functions as F

from stackloom import queries
from stackloom.functions import patent, standard, text
from stackloom.plans import jobs

TABLES = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["note_metadata", "note_files"])
def test_patent_number_is_read_once(spark, name):
    plan = _plan(queries.QUERIES[name](spark, TABLES))
    # Three parts of each pattern, once; of an empty date the plan asks again.
    assert plan.count(patent.NUMBERS[0]) <= 3
    assert plan.count(patent.FILED) <= 2


@pytest.mark.parametrize("name", ["standard_detect", "note_metadata", "note_files"])
def test_standard_number_is_read_once(spark, name):
    plan = _plan(queries.QUERIES[name](spark, TABLES))
    # One place looks for all parts of a domestic number, each at most twice.
    assert plan.count(standard.DOMESTIC) <= 12


def test_strip_takes_all_white_space(spark):
    chars = [chr(c) for c in [*range(0x3100), 0xFEFF, 0xFFFD, 0x1F600]]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", text.strip(F.concat("c", F.lit("a b"), "c", "c")).alias("new"), F.regexp_replace(F.concat("c", F.lit("a b"), "c", "c"), r"(?U)^\s+|\s+$", "").alias("old"))
    assert rows.filter("new <> old").count() == 0 and rows.filter("new = 'a b'").count() == 25


def test_marks_and_fields_with_white_space_inside(spark):
    national = "中 华 人 民\n共 和 国 国 家 标 准\nGB/T 16　2-2008\nGB/T 1677．1—2008\r\n增塑剂环氧值的测定\n2008-05-15 发\n布\n2008-11-01 实施\n国家 环境保护总局\n中国标准出版社"
    head = spark.createDataFrame([(1, national), (2, "INTERNATIONAL\nstandard\nics\t6\nISO 12-1:2000"), (3, None), (4, "topics of an international standard")], "i int, head string")
    h = F.col("head")
    rows = {r["i"]: r for r in head.select("i", standard.marks(h).alias("m"), standard.fields(h).alias("f"), jobs.detect(h)["doc_type"].alias("kind")).collect()}
    assert [rows[i]["m"] for i in (1, 2, 3, 4)] == [4, 2, 0, 1]
    f = rows[1]["f"]
    assert (f["doc_no"], f["title"], f["issued"], f["effective"], f["issuer"], f["publisher"]) == ("GB/T 1677.1-2008", "增塑剂环氧值的测定", "", "2008-11-01", "国家环境保护总局", "中国标准出版社")
    assert rows[2]["f"]["doc_no"] == "ISO 12-1:2000" and rows[3]["f"] is None and rows[4]["f"] is None
    assert [rows[i]["kind"] for i in (1, 2, 3, 4)] == ["standard", "standard", "", ""]


def test_notes_read_texts_once_and_only_what_they_show(spark):
    df = queries.note_files(spark, TABLES)
    plan = _plan(df)
    # The images' files and the papers' images are joined; papers are not joined with themselves.
    assert plan.count("Join ") == 2 and plan.count("text#") > 0
    assert patent.INVENTORS not in plan and patent.FILED not in plan and standard.ISSUERS not in plan
    assert patent.NUMBERS[0] in plan and standard.DOMESTIC in plan
    # An analysis is parsed once a paper.
    assert plan.count("parseJson") == 1
    assert patent.NUMBERS[0] not in _plan(queries.rescan_types(spark, TABLES))


HEADS = [
    queries.PATENT_COVER + "text",
    queries.STANDARD_COVER + "text",
    "(21) APPL. NO 12/345\n(22) fiLED: Jun. 3, 2016\nUS 10,000,001 B2",
    "uNITED States\nPATENT\neuropean patent application",
    "(21) Appl. No. 5 and 22) Filed",
    "INTERNATIONAL\nstandarD ics 6\nISO 12-1:2000",
    "National Standard of the People, ICS 6\nEN 1-2:1999",
    "ICS 6, a topic",
    "中华人民共和国标准\n2008-05-15 发布\n犌犅<i>/</i>T <b>16</b>77．1—<b>2008</b>\n增塑剂环氧值的测定\n中国标准出版社",
    "本标准规定了\n标准化技术委员会\nISO 9:2001\nGB/T 5—1999 代替 GB/T 5—1981",
    "申请公布号 CN 1122334455 A 摘要 (57)摘要",
    "申请号",
    "",
    None,
]


def test_cheap_tests_and_named_fields_change_no_result(spark):
    h = F.col("head")
    heads = spark.createDataFrame(list(enumerate(HEADS)), "i int, head string")
    told = heads.select("i", patent.marks(h).alias("pm"), standard.marks(h).alias("sm"), patent.cover(h).alias("pc"), standard.cover(h).alias("sc"), jobs.detected_type(h).alias("kind"), jobs.detect(h).alias("d"), patent.fields(h).alias("p"), standard.fields(h).alias("s"))
    few = heads.select(*[jobs.detect(h, [c]).alias(c) for c in jobs.DETECTED], *[patent.fields(h, [c]).alias(f"p_{c}") for c in patent.FIELDS], *[standard.fields(h, [c]).alias(f"s_{c}") for c in standard.FIELDS], "i")
    one = {r["i"]: r for r in few.collect()}
    kinds = []
    for r in told.orderBy("i").collect():
        assert (r["pc"], r["sc"]) == (r["pm"] >= 2, r["sm"] >= 2)
        assert r["kind"] == r["d"]["doc_type"] == ("patent" if r["pc"] else "standard" if r["sc"] else "")
        assert all(one[r["i"]][c] == (r["kind"], r["d"][c]) for c in jobs.DETECTED)
        for whole, sign, names in ((r["p"], "p_", patent.FIELDS), (r["s"], "s_", standard.FIELDS)):
            assert all(one[r["i"]][sign + c] == (whole and (whole[c],)) for c in names)
        kinds.append((r["kind"], r["d"]["patent_no"] + r["d"]["doc_no"]))
    assert kinds == [("patent", "CN112856361B"), ("standard", "GB/T 1677-2008"), ("patent", "US10000001B2"), ("patent", ""), ("", ""), ("standard", "ISO 12-1:2000"), ("standard", "EN 1-2:1999"), ("", ""), ("standard", "GB/T 1677.1-2008"), ("standard", "ISO 9:2001"), ("patent", "CN1122334455A"), ("", ""), ("", ""), ("", "")]
