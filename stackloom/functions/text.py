"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of images, headings of reference lists, and section headings.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
IMAGE_TAG = r"(?i)<img\b[^>]*>"
REFERENCES_LINE = r"(?md)^#{0,6}\s*(?:参考文献|References|REFERENCES|Bibliography)\s*[:：]?\s*$"
SECTIONS = [
    r"(?sid)(?:^|\n)#{1,3}\s*(?:abstract|摘要).{0,20}\n(.*?)(?=\n#{1,3}\s|\z)",
    r"(?sid)(?:^|\n)#{1,3}\s*(?:introduction|引言|背景|research background).{0,20}\n(.*?)(?=\n#{1,3}\s|\z)",
    r"(?sid)(?:^|\n)#{1,3}\s*(?:method|方法|methodology|approach).{0,20}\n(.*?)(?=\n#{1,3}\s|\z)",
    r"(?sid)(?:^|\n)#{1,3}\s*(?:result|结果|experiment|实验).{0,20}\n(.*?)(?=\n#{1,3}\s|\z)",
    r"(?sid)(?:^|\n)#{1,3}\s*(?:conclusion|结论|discussion|讨论).{0,20}\n(.*?)(?=\n#{1,3}\s|\z)",
]
ABSTRACTS = [
    r"(?sid)(?:^|\n)#{1,3}\s*(?:abstract|摘要|📌\s*摘要|🎯\s*摘要).{0,20}\n(.*?)(?=\n#{1,3}\s|\z)",
    r"(?sid)(?:^|\n)(?:［|\[)\s*摘\s*要\s*(?:］|\])\s*(.*?)(?=\n|$)",
    r"(?sid)(?:^|\n)摘\s*要\s*[:：]\s*(.*?)(?=\n|$)",
    r"(?sid)(?:^|\n)Abstract\s*[:：]\s*(.*?)(?=\n|$)",
]
OMITTED = "\n\n[... 中间内容已省略 ...]\n\n"
DOI = r"10\.\d{4,9}/[^\s\"<>\]]+"
DOI_TAIL = ".,;:)）。，；"
#: What two marks of a title page or cover without Chinese characters hold; a set first, as it is quick to pass over other letters.
COVER_WORDS = "[pPfFsS](?i:atent|iled|tandard)"
#: All white space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_nonempty(*columns: Column) -> Column:
    """The first column that is neither null nor empty; '' if none is."""
    return F.coalesce(*[nonempty(c) for c in columns], F.lit(""))


def clean_markdown(md: Column) -> Column:
    """Without images, without a reference list in the last 40 %, without runs of blank lines."""
    text = F.regexp_replace(F.regexp_replace(md, IMAGE, ""), IMAGE_TAG, "")
    # The text before the last heading of a reference list: all pieces but the last, with their headings.
    tail = F.element_at(F.split(text, REFERENCES_LINE), -1)
    heads = F.regexp_extract_all(text, F.lit(REFERENCES_LINE), F.lit(0))
    start = F.length(text) - F.length(tail) - F.length(F.try_element_at(heads, F.lit(-1)))
    cut = F.when((F.size(heads) > 0) & (start > F.length(text) * F.lit(0.6).cast("double")), F.substr(text, F.lit(1), start)).otherwise(text)
    return strip(F.regexp_replace(cut, r"\n{3,}", "\n\n"))


def content_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def too_short(md: Column, least: int = 200) -> Column:
    return F.length(strip(F.coalesce(md, F.lit("")))) < least


def abstract(text: Column) -> Column:
    """The abstract that the text itself has, by the first of four layouts that gives one."""
    return first_nonempty(*[strip(F.regexp_extract(text, p, 1)) for p in ABSTRACTS])


def key_sections(text: Column, limit: int = 40_000) -> Column:
    """The main sections; without any, head and tail of a long text."""
    found = [nonempty(strip(F.regexp_extract(text, p, 0))) for p in SECTIONS]
    joined = F.concat_ws("\n\n", *found)
    head, tail = limit * 2 // 3, limit - limit * 2 // 3
    rest = F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(OMITTED), F.right(text, F.lit(tail))))
    return F.when(joined != "", F.left(joined, F.lit(limit))).otherwise(rest)


def cjk_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^一-鿿]", "")) / F.nullif(F.length(text), F.lit(0))


def looks_chinese(text: Column) -> Column:
    """More than a fifth Chinese characters; also true of an empty text."""
    return F.coalesce(cjk_ratio(text) > 0.2, F.lit(True))


def doi(text: Column) -> Column:
    """The first DOI, without punctuation behind it."""
    return F.regexp_replace(F.regexp_extract(text, DOI, 0), f"[{DOI_TAIL}]+$", "")


def caption(text: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def safe_title(title: Column, default: str = "Untitled_Paper") -> Column:
    return first_nonempty(strip(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N} _-]", "")), F.lit(default))


def strip_wrappers(html: Column) -> Column:
    """Without span, div, figure and caption tags, and without runs of line ends."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)</?(?:span|div|figure|figcaption)\b[^>]*>", ""), r"\n{3,}", "\n\n")


def images(md: Column) -> Column:
    """(alt, source) of the images written in Markdown, then of those written as tags."""
    pair = lambda alt, src: F.arrays_zip(alt.alias("alt"), src.alias("src"))
    written = [F.regexp_extract_all(md, F.lit(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"), F.lit(k)) for k in (1, 2)]
    tags = F.regexp_extract_all(md, F.lit(IMAGE_TAG), F.lit(0))
    value = lambda name: F.transform(tags, lambda t: F.regexp_extract(t, rf"(?i)\b{name}=[\"']([^\"']*)", 1))
    return F.concat(pair(*written), pair(value("alt"), value("src")))


def strip_backlinks(md: Column) -> Column:
    return F.regexp_replace(md, r"(?md) \[\[[^\]]+\]\]$", "")


def clamp_score(score: Column, low: int = 1, high: int = 10) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(score, F.lit(0)).cast("int")))


def word_budget(total: Column, sections: Column) -> Column:
    """Words of introduction (12 %), conclusion (15 %), and of each section (the rest)."""
    intro, end = F.floor(total * F.lit(0.12).cast("double")), F.floor(total * F.lit(0.15).cast("double"))
    return F.struct(intro.alias("intro"), end.alias("conclusion"), F.floor((total - intro - end) / F.greatest(sections, F.lit(1))).alias("section"))


def transient_error(error: Column, model: bool = False) -> Column:
    """Whether an error is worth another try."""
    words = "timeout|network|rate limit|connection|try again|busy" if model else "parsing failed|try again later|timeout"
    return F.coalesce(F.lower(error).rlike(words), F.lit(False))


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop of either script, without empty ones."""
    return F.filter(F.split(text, r"(?<=[。！？；.!?])"), lambda s: s != "")
