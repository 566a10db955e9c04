"""Patents: recognition of a title page and its fields, stage and term."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.functions.text import COVER_WORDS, first_nonempty, let, nonempty, strip

# Marks of a title page, of which two are needed.
MARKS = [
    r"\(\s*21\s*\)\s*申请号",
    r"\(\s*22\s*\)\s*申请日",
    r"\(\s*54\s*\)\s*(?:发明名称|实用新型名称|发明创造名称)",
    r"\(\s*57\s*\)\s*摘要",
    r"\(\s*72\s*\)\s*发明人",
    r"\(\s*71\s*\)\s*申请人",
    r"\(\s*73\s*\)\s*专利权人",
    r"申请公布号",
    r"授权公告号",
    r"\(\s*74\s*\)\s*专利代理机构",
    r"United\s+States\s+Patent",
    r"Patent\s+Application\s+Publication",
    r"\(\s*21\s*\)\s*Appl\.?\s*No",
    r"\(\s*22\s*\)\s*Filed",
    r"\(\s*45\s*\)\s*Date\s+of\s+Patent",
    r"European\s+Patent\s+(?:Application|Specification)",
]
LEAST_MARKS = 2
# What each mark holds, in small letters.
HELD = ["申请号", "申请日", "名称", "摘要", "发明人", "申请人", "专利权人", "申请公布号", "授权公告号", "专利代理机构", "patent", "patent", "appl", "filed", "patent", "patent"]
# Patterns of numbers (country, digits, kind), the granted one first, and of fields.
NUMBERS = [
    r"授权公告号\s*([A-Z]{2})\s*([\d\s]{5,15}?)\s*([A-Z]\d?)\b",
    r"申请公布号\s*([A-Z]{2})\s*([\d\s]{5,15}?)\s*([A-Z]\d?)\b",
    r"(?i)Patent\s+(?:No\.?|Number)\s*[:：]?\s*(US)\s*([\d,\s]{6,14}?)\s*([AB]\d?)\b",
    r"\b(CN|US|EP|JP|KR|WO|DE|GB|FR)\s?([\d,\s]{5,15}?)\s?([A-Z]\d?)\b",
]
FILED = r"\(\s*22\s*\)\s*申请日\s*[:：]?\s*([\d\s./\-]{8,16})"
FILED_US = r"\(\s*22\s*\)\s*Filed\s*[:：]?\s*([A-Za-z]{3,9}\.?\s+\d{1,2}\s*,\s*\d{4})"
APPLICATION = r"\(\s*21\s*\)\s*申请号\s*[:：]?\s*([\d\s.]{8,20})"
INVENTORS = r"\(\s*72\s*\)\s*发明人\s*[:：]?\s*([^\n]+)"
OWNER = r"\(\s*73\s*\)\s*专利权人\s*[:：]?\s*([^\n]+)"
APPLICANT = r"\(\s*71\s*\)\s*申请人\s*[:：]?\s*([^\n]+)"
TITLE = r"\(\s*54\s*\)\s*(?:发明名称|实用新型名称|发明创造名称)\s*[:：]?\s*([^\n]*)"
IPC = r"\b([A-H]\d{2}[A-Z]\s?\d{1,4}\s?/\s?\d{1,4})"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Years of protection by the first letter of the kind, and stages: of US and European patents, and by the first letter of others.
TERM_YEARS = {"A": 20, "B": 20, "C": 20, "U": 10, "Y": 10, "S": 15}
PENDING, GRANTED, UNKNOWN = "申请公开（审查中）", "已授权", "未知"
STAGES = {"A": "申请公布（审查中）", "B": "发明专利已授权", "C": "发明专利已授权（更正）", "U": "实用新型已授权", "Y": "实用新型已授权", "S": "外观设计已授权"}


#: The fields of a title page.
FIELDS = ("patent_no", "app_no", "filing_date", "title", "inventors", "assignee", "ipc", "stage", "expiry", "marks")


def marks(head: Column) -> Column:
    """How many of the marks occur."""
    total = lambda hits: reduce(lambda a, b: a + b, hits)
    # A pattern is only tried on texts that have what it holds, which is much cheaper to look for; each word is looked for once.
    tried = lambda word: total([head.rlike(f"(?i){p}").cast("int") for p, w in zip(MARKS, HELD, strict=True) if w == word])
    return let(F.lower(head), lambda low: total([F.when(low.contains(w), tried(w)).otherwise(0) for w in dict.fromkeys(HELD)]))


def cover(head: Column, words: Column | None = None) -> Column:
    """Whether a text has the marks of a title page; ``words``: whether it has any of ``COVER_WORDS``, where that is known."""
    held = reduce(lambda a, b: a | b, [head.contains(w) for w in HELD if not w.isascii()])
    return F.when(held | (head.rlike(COVER_WORDS) if words is None else words), marks(head) >= LEAST_MARKS).otherwise(False)


def number(text: Column) -> Column:
    """Country, digits and kind of the first number by precedence; '' if none."""
    made = [let(F.concat(F.upper(F.regexp_extract(text, p, 1)), F.regexp_replace(F.regexp_extract(text, p, 2), "[^0-9]", ""), F.upper(F.regexp_extract(text, p, 3))), nonempty) for p in NUMBERS]
    return F.coalesce(*made, F.lit(""))


def kind(no: Column) -> Column:
    return F.regexp_extract(F.upper(F.coalesce(no, F.lit(""))), r"([A-Z]\d?)$", 1)


def stage(no: Column) -> Column:
    """How far the printed document had come, told by its kind; not its legal status."""
    k, country = kind(no), F.upper(F.left(F.coalesce(no, F.lit("")), F.lit(2)))
    first = F.left(k, F.lit(1))
    us = F.when((first == "A") & (k != "A"), PENDING).otherwise(GRANTED)
    ep = F.when(first == "A", PENDING).otherwise(GRANTED)
    other = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), first), F.lit(UNKNOWN))
    return F.when(k == "", UNKNOWN).when(country == "US", us).when(country == "EP", ep).otherwise(other)


def date_text(raw: Column) -> Column:
    """YYYY-MM-DD of the first date written in digits, with or without separators, or of an English one at the start.

    '' where there is none, or where digits give no date of the years 1900 to 2100.
    """
    text = strip(F.coalesce(raw, F.lit("")))
    words = r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})\s*,\s*(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(F.regexp_extract(text, words, 1), F.lit(3))))
    english = F.concat_ws("-", F.regexp_extract(text, words, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, words, 2), 2, "0"))
    tight = F.regexp_replace(text, r"(?U)\s+", "")
    split, solid = r"(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})", r"(\d{4})(\d{2})(\d{2})"
    y, m, d = (F.when(tight.rlike(split), F.regexp_extract(tight, split, k)).otherwise(F.regexp_extract(tight, solid, k)) for k in (1, 2, 3))
    ok = y.try_cast("int").between(1900, 2100) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    digits = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(text.rlike(r"^\p{L}"), F.when(month > 0, english).otherwise("")).when(ok, digits).otherwise("")


def expiry(no: Column, filed: Column) -> Column:
    """The end of the term by arithmetic; a day that the month lacks falls back by one."""
    years = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TERM_YEARS.items() for x in kv]), F.left(kind(no), F.lit(1))), F.lit(20))
    y, m, d = (F.split(filed, "-")[k] if k == 0 else F.try_element_at(F.split(filed, "-"), F.lit(k + 1)) for k in range(3))
    made = lambda back: F.try_to_date(F.concat_ws("-", (y.try_cast("int") + years).cast("string"), m, F.lpad((d.try_cast("int") - back).cast("string"), 2, "0")))
    out = F.coalesce(made(0), made(1)).cast("string")
    return F.coalesce(F.when(filed.rlike(r"^\d{4}-\d{2}-\d{2}$"), out), F.lit(""))


def expired(no: Column, filed: Column, today: Column) -> Column:
    end = expiry(no, filed)
    return (end != "") & (end < today.cast("string"))


def organisation(raw: Column) -> Column:
    """The name before the address that is printed behind it."""
    return F.regexp_replace(F.regexp_replace(F.split(F.coalesce(raw, F.lit("")), r"地\s*址|Address", 2)[0], r"(?U)\s+", " "), r"^[ ,;，；]+|[ ,;，；]+$", "")


def fields(head: Column, names: Sequence[str] = FIELDS) -> Column:
    """The named fields of a title page, null if ``head`` is none."""
    return F.when(cover(head), read(head, names))


def read(head: Column, names: Sequence[str] = FIELDS) -> Column:
    """The named fields of a title page; only what they need is worked out."""
    # Number and date are worked out once.
    printed = first_nonempty(F.regexp_extract(head, FILED, 1), F.regexp_extract(head, FILED_US, 1))
    no = number(head) if {"patent_no", "stage", "expiry"} & {*names} else F.lit("")
    filed = let(printed, date_text) if {"filing_date", "expiry"} & {*names} else F.lit("")
    made = lambda told: F.struct(*[told[c].alias(c) for c in names])
    return let(F.struct(no.alias("no"), filed.alias("filed")), lambda s: made(_fields(head, s["no"], s["filed"])))


def _fields(head: Column, no: Column, filed: Column) -> dict[str, Column]:
    squeeze = lambda p: F.regexp_replace(F.regexp_extract(head, p, 1), r"(?U)\s+", "")
    below = F.regexp_extract(head, TITLE.replace(r"([^\n]*)", r"\n+([^\n]*)"), 1)
    ipc = F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(IPC), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)\s+", "")))
    return {
        "patent_no": no,
        "app_no": squeeze(APPLICATION),
        "filing_date": filed,
        "title": first_nonempty(strip(F.regexp_extract(head, TITLE, 1)), strip(below)),
        "inventors": strip(F.regexp_replace(F.regexp_extract(head, INVENTORS, 1), r"(?U)\s+", " ")),
        "assignee": organisation(first_nonempty(F.regexp_extract(head, OWNER, 1), F.regexp_extract(head, APPLICANT, 1))),
        "ipc": F.left(F.array_join(ipc, "; "), F.lit(300)),
        "stage": stage(no),
        "expiry": expiry(no, filed),
        "marks": marks(head),
    }


def describe(no: Column, filed: Column, status: Column, checked: Column, today: Column) -> Column:
    """One line: what is printed, and what a person has verified."""
    end = expiry(no, filed)
    term = F.when(end != "", F.concat(F.lit("保护期至 "), end, F.when(expired(no, filed, today), "（已过期）").otherwise("")))
    known = F.when(nonempty(status).isNotNull(), F.concat(F.lit("法律状态 "), status, F.coalesce(F.concat(F.lit("（"), nonempty(checked), F.lit(" 核实）")), F.lit(""))))
    return F.concat_ws(" | ", F.concat(F.lit("出版阶段 "), stage(no)), term, F.coalesce(known, F.lit("法律状态 未核实")))
