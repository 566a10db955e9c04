"""Citation markers: validity, numbering over a whole review, and reference lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom import vocab
from stackloom.checkpoints import running_total
from stackloom.functions.text import first_nonempty, nonempty, safe_title, strip

# A citation, and an author's name behind a file title.
MARKER = r"\[@([0-9a-f]{8,12})\]"
NAME_BEHIND = r"_([一-龥]{2,4})$"


def marked(sections: DataFrame) -> DataFrame:
    """(section_no, pos, prefix) of every marker in ``sections(section_no, markdown)``."""
    found = F.regexp_extract_all("markdown", F.lit(MARKER), F.lit(1))
    return sections.select("section_no", F.posexplode(found).alias("pos", "prefix"))


def valid(markers: DataFrame, docs: DataFrame) -> DataFrame:
    """Markers that are the first eight characters of a document's id; of equal prefixes the largest id counts."""
    known = docs.groupBy(F.left("doc_id", F.lit(8)).alias("prefix")).agg(F.max("doc_id").alias("doc_id"))
    return markers.join(known, "prefix")


def numbered(markers: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, prefix, n): documents numbered by first appearance."""
    first = valid(markers, docs).groupBy("doc_id", "prefix").agg(F.min(F.struct("section_no", "pos")).alias("at"))
    return running_total(first.repartitionByRange("at"), F.lit(1), ["at"], "_before").select("doc_id", "prefix", (F.col("_before") + 1).alias("n"))


def renumber(sections: DataFrame, numbers: DataFrame) -> DataFrame:
    """Sections with their markers as numbers; markers without one are removed."""
    found = F.regexp_extract_all("markdown", F.lit(MARKER), F.lit(1))
    pieces = F.arrays_zip(F.split("markdown", MARKER, -1).alias("text"), found.alias("prefix"))
    each = sections.select("section_no", F.posexplode(pieces).alias("pos", "p")).select("section_no", "pos", "p.text", "p.prefix")
    told = each.join(numbers.select("prefix", "n"), "prefix", "left")
    text = F.concat("text", F.coalesce(F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")), F.lit("")))
    # A section's own pieces.
    joined = told.groupBy("section_no").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))).alias("all"))
    return joined.select("section_no", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("markdown"))


def short_authors(authors: Column, title: Column, chinese: Column) -> Column:
    """Up to three authors and 'and others'; without any, the name behind a file title, or unknown."""
    names = F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), "[,，;；]"), strip), lambda x: x != "")
    more = F.when(F.size(names) <= 3, "").when(chinese, ", 等").otherwise(", et al")
    none = F.coalesce(F.concat(nonempty(F.regexp_extract(title, NAME_BEHIND, 1)), F.lit(", 等")), F.when(chinese, "作者不详").otherwise("Unknown"))
    return F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, 3), ", "), more)).otherwise(none)


def best_title(title: Column, title_zh: Column, title_en: Column, chinese: Column) -> Column:
    """The title in the document's language; else the file title without the name behind it, or unknown."""
    own = F.when(chinese, nonempty(title_zh)).otherwise(nonempty(title_en))
    return F.coalesce(own, F.regexp_replace(title, NAME_BEHIND, ""), F.lit("未知文献"))


def imprint(place: Column, publisher: Column, year: Column) -> Column:
    house = F.concat_ws(": ", nonempty(place), nonempty(publisher))
    whole = F.concat_ws(", ", nonempty(house), nonempty(year))
    return F.when(whole == "", "").otherwise(F.concat(F.lit(" "), whole, F.lit(".")))


def reference(n: Column, doc_id: Column, m) -> Column:
    """The reference line of a document; ``m(name)`` gives a column of its metadata."""
    code = vocab.code(m("doc_type"))
    chinese = first_nonempty(m("language"), F.lit("zh")) == "zh"
    title = best_title(m("title"), m("title_zh"), m("title_en"), chinese)
    lead = F.concat(short_authors(m("authors"), m("title"), chinese), F.lit(". "))
    optional = F.when(first_nonempty(m("authors")) != "", lead).otherwise("")
    dotted = lambda c: F.coalesce(F.concat(F.lit(" "), nonempty(c), F.lit(".")), F.lit(""))
    link = F.concat(F.lit(" [["), safe_title(m("title")), F.lit("_"), F.left(doc_id, F.lit(8)), F.lit("]]"))
    start = F.concat(F.lit("["), n.cast("string"), F.lit("] "))
    printed = imprint(m("pub_place"), m("publisher"), m("year"))
    book = F.concat(start, lead, title, F.lit("[M]."), dotted(m("edition")), printed)
    patent = F.concat(start, lead, title, F.coalesce(F.concat(F.lit(": "), nonempty(m("patent_no"))), F.lit("")), F.lit("[P]."), dotted(first_nonempty(m("filing_date"), m("year"))), link)
    standard = F.concat(start, optional, title, F.coalesce(F.concat(F.lit(": "), nonempty(m("doc_no"))), F.lit("")), F.lit("[S]."), printed, link)
    web = F.concat(start, optional, title, F.lit("[EB/OL]."), dotted(m("year")), dotted(m("url")))
    long = F.concat(start, lead, title, F.lit("["), code, F.lit("]."), printed, link)
    source = F.concat_ws(", ", nonempty(m("journal")), nonempty(m("year")))
    paper = F.concat(start, lead, title, F.lit("[J]."), dotted(source), F.coalesce(F.concat(F.lit(" DOI: "), nonempty(m("doi")), F.lit(".")), F.lit("")), link)
    return F.when(code == "M", book).when(code == "P", patent).when(code == "S", standard).when(code == "EB/OL", web).when(code.isin("R", "D", "C"), long).otherwise(paper)
