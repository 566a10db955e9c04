"""Writers: tables by swap, request files, logs and notes."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom import schemas, vocab
from stackloom.functions.text import nonempty, safe_title


def swap(df: DataFrame, path: str) -> None:
    """Replaces a Parquet table that ``df`` may read: a new folder is written, then renamed into place."""
    spark = df.sparkSession
    fresh, old = (f"{path}.{uuid.uuid4().hex}" for _ in range(2))
    df.write.parquet(fresh)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(paths(path))
    if had:
        fs.rename(paths(path), paths(old))
    fs.rename(paths(fresh), paths(path))
    if had:
        fs.delete(paths(old), True)


def requests(papers: DataFrame, prompt: str, model: str) -> DataFrame:
    """(value): one request line a paper, with its id as the custom id."""
    message = F.struct(F.lit("user").alias("role"), F.concat(F.lit(prompt), F.lit("\n\n"), "markdown").alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"))
    return papers.filter("markdown is not null").select(F.to_json(F.struct(F.col("id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def event_lines(rows: DataFrame) -> DataFrame:
    """(value): a JSON line an event of ``rows(ts, mode, event, title, doc_id, status, error, extra)``, in their order.

    Missing columns and null values take their defaults, success and empty text.  ``extra`` is a JSON object of further keys, any of
    which wins over the event's own; what is no object adds nothing.
    """
    defaults = {"ts": "", "mode": "", "event": "", "title": "", "doc_id": "", "status": "success", "error": ""}
    value = lambda c, d: (F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in rows.columns else F.lit(d)).alias(c)
    kind = "map<string,variant>"
    own = F.from_json(F.to_json(F.struct(*[value(c, d) for c, d in defaults.items()])), kind)
    more = F.from_json("extra", kind) if "extra" in rows.columns else F.lit(None).cast(kind)
    told = rows.select(own.alias("own"), F.coalesce(more, F.create_map().cast(kind)).alias("more"))
    kept = F.map_filter("own", lambda k, _: ~F.map_contains_key("more", k))
    return told.select(F.to_json(F.map_concat(kept, "more")).alias("value"))


def append_events(events: DataFrame, path: str) -> None:
    """Appends events to the log in the folder ``path``, in the order of their partitions and of the rows in each.

    ``events`` are JSON lines ``value``, or rows whose columns are the keys.  The files are written aside and then renamed, so that their names tell
    when they were written and their order in one write, whatever happens to their times later.  One writer at a time.
    """
    lines = events if events.columns == ["value"] else events.select(F.to_json(F.struct("*")).alias("value"))
    spark = events.sparkSession
    aside = f"{path}/_{uuid.uuid4().hex}"
    lines.write.text(aside)
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stamp = time.time_ns()
    parts = sorted(f.getPath().getName() for f in fs.listStatus(to(aside)) if f.getLen())
    for k, name in enumerate(n for n in parts if n.startswith("part-")):
        fs.rename(to(f"{aside}/{name}"), to(f"{path}/{stamp}-{k:06}.json"))
    fs.delete(to(aside), True)


def note_name(title: Column, doc_id: Column) -> Column:
    return F.concat(safe_title(title), F.lit("_"), F.left(doc_id, F.lit(8)), F.lit(".md"))


# What a note calls the source of each type, and the column that has it.
SOURCES = {
    "paper": ("期刊/会议", "journal"),
    "conf": ("会议", "journal"),
    "patent": ("专利号", "patent_no"),
    "standard": ("标准号", "doc_no"),
    "book": ("出版社", "publisher"),
    "report": ("发布机构", "publisher"),
    "thesis": ("授予单位", "publisher"),
    "web": ("网址", "url"),
}
MISSING = "未提取"
NO_IMAGES = "*暂无提取的图表*"
# Fixed value: a note; names in braces are filled in.
NOTE = """---
aliases: []
tags:
  - "#{doc_type}"
  - "#{language}"
date: "{date}"
title: "{title}"
document_type: "{label}"
authors: "{authors}"
year: "{year}"
journal: "{journal}"
source: "{source}"
---

# {title}

> **类型**: {label}  |  **作者/责任者**: {authors}  |  **年份**: {year}  |  **{source_label}**: {source}

## 💡 核心摘要 / TL;DR
{tldr}

## 📄 原始摘要 / Original Abstract
{abstract}

## 🎯 研究背景与动机
{background}

## 🧪 核心方法与公式
{methods}

## 📊 实验数据与结果
{results}

## 📝 结论与个人启发
{conclusion}

## 📎 附件与图表
{images}"""


def notes(papers: DataFrame, today: Column, images: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(id, file_name, content, copies): a note a paper, and (source, target) of the images it shows.

    ``papers`` has id, title and result_json, the analysis, and what of language, doc_type, authors, journal, abstract, patent_no, doc_no, publisher
    and url there is.  Ten fields come from the analysis where it has them; it goes before the paper's own but for the abstract
    as empty as that.  ``images(id, pos, path)`` are shown in the order of ``pos``, under the note's attachments; those not in ``files(path)``
    are left out.
    """
    told = lambda c: nonempty(F.try_variant_get("_analysis", f"$.{c}", "string"))
    own = lambda c: nonempty(F.col(c).cast("string")) if c in papers.columns else F.lit(None).cast("string")
    kind = F.col("_kind")
    of_kind = lambda values, rest: F.coalesce(*[F.when(kind == k, v) for k, v in values.items()], rest)
    empty = F.lit("")
    value = {
        "doc_type": kind,
        "label": vocab.label(kind),
        "source_label": of_kind({t: F.lit(label) for t, (label, _) in SOURCES.items()}, F.lit("来源")),
        "source": F.coalesce(of_kind({t: own(c) for t, (_, c) in SOURCES.items()}, told("journal")), F.lit(MISSING)),
        "language": F.coalesce(told("language"), own("language"), F.lit("en")),
        "date": today.cast("string"),
        "title": F.coalesce("title", F.lit("Unknown Title")),
        "authors": F.coalesce(told("authors"), own("authors"), F.lit(MISSING)),
        "year": F.coalesce(told("year"), F.left(today.cast("string"), F.lit(4))),
        "journal": F.coalesce(told("journal"), own("journal"), F.lit(MISSING)),
        "abstract": F.coalesce(told("abstract"), own("abstract"), empty),
        **{c: F.coalesce(told(c), empty) for c in ("tldr", "background", "methods", "results", "conclusion")},
        "images": F.col("_shown"),
    }
    rows = papers
    link = F.struct("pos", F.col("path").alias("source"), F.concat(F.lit("attachments/"), "id", F.lit("/"), F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1)).alias("target"))
    if images is not None:
        there = images if files is None else images.join(files.select("path").distinct(), "path", "left_semi")
        # A paper's own images.
        rows = rows.join(there.groupBy("id").agg(F.sort_array(F.collect_list(link)).alias("_images")), "id", "left")
    else:
        rows = rows.withColumn("_images", F.lit(None).cast("array<struct<pos:int,source:string,target:string>>"))
    shown = F.array_join(F.transform("_images", lambda i: F.concat(F.lit("![图表]("), i["target"], F.lit(")"))), "\n")
    # Worked out once a paper.
    rows = rows.withColumns({"_shown": F.coalesce(nonempty(shown), F.lit(NO_IMAGES)), "_analysis": F.try_parse_json("result_json"), "_kind": F.coalesce(nonempty(vocab.normalize(own("doc_type"))), F.lit(vocab.DEFAULT_TYPE))})
    content = F.concat(*[value[part] if k % 2 else F.lit(part) for k, part in enumerate(re.split(r"\{(\w+)\}", NOTE))])
    copies = F.coalesce(F.transform("_images", lambda i: F.struct(i["source"].alias("source"), i["target"].alias("target"))), F.array().cast("array<struct<source:string,target:string>>"))
    return rows.select("id", note_name(F.coalesce("title", F.lit("Untitled")), F.col("id")).alias("file_name"), content.alias("content"), copies.alias("copies"))


def review(sections: DataFrame, references: DataFrame, title: str) -> DataFrame:
    """(content): one review with numbered headings and its reference list; a single text."""
    body = sections.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "title", "markdown"))), lambda s: F.concat(F.lit("## "), s["section_no"].cast("string"), F.lit(". "), s["title"], F.lit("\n\n"), s["markdown"])), "\n\n").alias("body"))
    refs = references.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("refs"))
    return body.join(refs, F.lit(True)).select(F.concat(F.lit(f"# {title}\n\n"), "body", F.lit("\n\n## 参考文献\n\n"), "refs").alias("content"))


def save_ids(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Adds the ids of ``new(id)`` to the stored table of processed ids, each once."""
    kept = schemas.load(spark, path, schemas.IDS)
    swap(kept.union(new.select("id")).filter("id is not null").distinct(), path)
