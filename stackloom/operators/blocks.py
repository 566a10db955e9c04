"""Layout blocks of parsed documents: (doc_id, pos, type, text, text_level, img_path, page_idx, captions, items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.text import caption, doi, strip

FIGURES, TABLES = ("image", "chart"), ("table",)


def captions(caption_map: Column) -> Column:
    """All lists whose name ends in _caption, in the order of names, joined by a space."""
    named = F.sort_array(F.map_entries(F.map_filter(caption_map, lambda k, _: k.endswith("_caption"))))
    return strip(F.array_join(F.flatten(F.transform(named, lambda e: e["value"])), " "))


def path(folder: Column, img: Column) -> Column:
    return F.concat_ws("/", F.nullif(F.regexp_replace(folder, "/+$", ""), F.lit("")), F.replace(img, F.lit("\\"), F.lit("/")))


def below(img: Column, root: Column) -> Column:
    """A file's path below ``root``, with plain slashes; a path elsewhere stays."""
    plain, top = F.replace(img, F.lit("\\"), F.lit("/")), F.concat(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    return F.when(plain.startswith(top), F.substr(plain, F.length(top) + 1)).otherwise(plain)


def title(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the first text block of level 1."""
    return blocks.filter("type = 'text' and text_level = 1 and trim(text) <> ''").groupBy("doc_id").agg(F.min_by(strip(F.col("text")), "pos").alias("title"))


def dois(blocks: DataFrame) -> DataFrame:
    """(doc_id, doi): of the first block with one."""
    return blocks.withColumn("doi", doi(F.coalesce("text", F.lit("")))).filter("doi <> ''").groupBy("doc_id").agg(F.min_by("doi", "pos").alias("doi"))


def assets(blocks: DataFrame) -> DataFrame:
    """(doc_id, asset_type, img_path, caption, page_idx) of pictures and tables that have a file."""
    kind = F.when(F.col("type").isin(*FIGURES), "figure").when(F.col("type").isin(*TABLES), "table")
    rows = blocks.withColumn("asset_type", kind).filter("asset_type is not null and img_path is not null and img_path <> ''")
    return rows.select("doc_id", "asset_type", F.replace("img_path", F.lit("\\"), F.lit("/")).alias("img_path"), captions(F.col("captions")).alias("caption"), "page_idx")


def captioned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("caption", caption(F.col("caption"))).filter("caption <> ''")


def references(blocks: DataFrame) -> DataFrame:
    """(doc_id, ref_index, raw_text): items of reference lists, numbered from 1 over the document."""
    items = blocks.filter("type = 'list' and sub_type = 'ref_text'").select("doc_id", "pos", F.posexplode("items").alias("k", "raw")).withColumn("raw_text", strip(F.col("raw"))).filter("raw_text <> ''")
    return items.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")).alias("ref_index"), "raw_text")


def counts(asset_rows: DataFrame, reference_rows: DataFrame) -> DataFrame:
    """(doc_id, n_figures, n_tables, n_refs)."""
    a = asset_rows.groupBy("doc_id").agg(F.count_if(F.col("asset_type") == "figure").alias("n_figures"), F.count_if(F.col("asset_type") == "table").alias("n_tables"))
    b = reference_rows.groupBy("doc_id").agg(F.count("*").alias("n_refs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return a.join(b, "doc_id", "full").select("doc_id", zero("n_figures"), zero("n_tables"), zero("n_refs"))


def stitch_pages(parts: DataFrame, pages: int) -> DataFrame:
    """Blocks of a split document with page numbers over the whole: part i starts at (i - 1) * pages."""
    return parts.withColumn("page_idx", F.col("page_idx") + (F.col("part") - 1) * pages)


def stitch_text(parts: DataFrame) -> DataFrame:
    """(doc_id, markdown): the non-empty texts of all parts in order."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", strip(F.col("markdown")).alias("text")))), lambda s: s["text"])
    return parts.filter("markdown is not null").groupBy("doc_id").agg(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n").alias("markdown"))


def page_ranges(books: DataFrame, pages: int) -> DataFrame:
    """(doc_id, part, first_page, last_page) of ``books(doc_id, n_pages)`` cut into parts."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_pages") - 1, F.lit(0)), F.lit(pages))
    rows = books.filter("n_pages > 0").select("doc_id", "n_pages", F.posexplode(starts).alias("k", "first_page"))
    return rows.select("doc_id", (F.col("k") + 1).alias("part"), "first_page", (F.least(F.col("first_page") + pages, "n_pages") - 1).alias("last_page"))
