"""Readers of files, logs and batch results."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom import schemas
from stackloom.checkpoints import running_total
from stackloom.functions.text import strip

# An ISBN, and a year.
ISBN = r"ISBN[\s:：]*([0-9][0-9\-\s]{8,16}[0-9Xx])"
YEAR = r"(19|20)\d{2}"
EMPTY = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, extension, length) of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), "length")


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, id, length) with the SHA-256 of the content as id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.sha2("content", 256).alias("id"), "length")


def unsupported(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many files are no PDFs, and their extensions in order."""
    rows = listing(spark, folder).filter("extension <> '.pdf'")
    return rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("extension")).alias("extensions"))


def largest(files: DataFrame, extension: str) -> DataFrame:
    """(doc_id, path): each document's largest file of a kind."""
    return files.filter(F.col("extension") == extension).groupBy("doc_id").agg(F.max_by("path", F.struct("length", "path")).alias("path"))


def layout_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of all layout lists in a folder, for ``operators.blocks``; second versions are passed over."""
    kind = T.ArrayType(T.MapType(T.StringType(), T.VariantType()))
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*_content_list.json").option("recursiveFileLookup", True).text(folder)
    files = files.select(F.col("_metadata.file_name").alias("file"), "value").filter(~F.col("file").contains("_v2"))
    rows = files.select(F.regexp_replace("file", r"_content_list\.json$", "").alias("doc_id"), F.posexplode(F.from_json("value", kind)).alias("pos", "b"))
    text = lambda k: F.try_variant_get(F.col("b")[k], "$", "string").alias(k)
    number = lambda k: F.try_variant_get(F.col("b")[k], "$", "int").alias(k)
    lists = F.map_filter("b", lambda k, _: k.endswith("_caption"))
    captions = F.transform_values(lists, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string"))))
    items = F.try_variant_get(F.col("b")["list_items"], "$", "array<string>").alias("items")
    return rows.select("doc_id", "pos", text("type"), text("sub_type"), text("text"), number("text_level"), text("img_path"), number("page_idx"), captions.alias("captions"), items)


#: Names that ``sinks.append_events`` gives: time in nanoseconds, and the part of one write.
WRITTEN = r"^(\d{19,})-(\d+)\.json"


def events(spark: SparkSession, path: str) -> DataFrame:
    """The event log without unreadable lines; ``ord`` orders its lines as they were written.

    ``path`` is a file or a folder of files.  ``ord`` has the time of a file (of its name where
    ``append_events`` gave it, else of its last change), its name, the start of the block that a task reads, and the line's place among
    the task's.  So it does not depend on how Spark packs files into tasks.
    """
    kind = T.StructType([*schemas.EVENTS, T.StructField("timestamp", T.StringType()), T.StructField("_bad", T.StringType())])
    try:
        rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if e.getCondition() not in EMPTY:
            raise
        order = "struct<time:timestamp,file:string,start:bigint,line:bigint>"
        return spark.createDataFrame([], schemas.EVENTS).withColumn("ord", F.lit(None).cast(order))
    name = F.col("_metadata.file_name")
    stamp = F.regexp_extract(name, WRITTEN, 1)
    time = F.when(stamp != "", F.timestamp_micros(F.substr(stamp, F.lit(1), F.length(stamp) - 3).cast("long"))).otherwise(F.col("_metadata.file_modification_time"))
    place = F.struct(time.alias("time"), name.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    rows = rows.withColumns({"ord": place, "ts": F.coalesce("ts", "timestamp")})
    return rows.filter("_bad is null and ts is not null").select(*schemas.EVENTS.names, "ord")


def numbered(log: DataFrame) -> DataFrame:
    """``events`` with ``n``, the number of each line over the whole log, from 1."""
    return running_total(log.repartitionByRange("ord"), F.lit(1), ["ord"], "n").withColumn("n", F.col("n") + 1)


def batch_results(lines: DataFrame) -> DataFrame:
    """(id, content, error) of result lines ``value`` of either provider; unreadable lines are kept as errors."""
    doc = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(doc, p, "string")
    content = F.coalesce(get("$.response.body.choices[0].message.content"), get("$.response.candidates[0].content.parts[0].text"))
    error = F.when(doc.isNull(), "unreadable line").when(content.isNull(), F.coalesce(get("$.error.message"), F.lit("no content")))
    return lines.filter("trim(value) <> ''").select(F.coalesce(get("$.custom_id"), get("$.id")).alias("id"), content.alias("content"), error.alias("error"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a JSON list of processed ids; none where it is missing or broken."""
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return spark.createDataFrame([], "id string")
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("id")).filter("id is not null").distinct()


def outline(lines: DataFrame) -> DataFrame:
    """(section_no, section, question) of an outline in small Markdown: # title, ## section, - question."""
    from pyspark.sql import Window

    text = F.trim("line")
    told = lines.select("pos", text.alias("line")).withColumn("is_section", F.col("line").startswith("## ").cast("int"))
    # One outline: a short list.
    order = Window.orderBy("pos")
    told = told.withColumn("section_no", F.sum("is_section").over(order)).withColumn("section", F.last(F.when(F.col("is_section") == 1, F.substr("line", F.lit(4))), ignorenulls=True).over(order))
    return told.filter(F.col("line").startswith("- ") & (F.col("section_no") > 0)).select("section_no", "section", F.trim(F.substr("line", F.lit(3))).alias("question"))


def outline_title(lines: DataFrame) -> DataFrame:
    """One row (title) of an outline in small Markdown: its last line with one #; null where there is none."""
    text = F.trim("line")
    return lines.filter(text.startswith("# ")).agg(F.max_by(F.trim(F.substr(text, F.lit(3))), "pos").alias("title"))


def outline_json(text: DataFrame) -> DataFrame:
    """(title, section_no, section, question) of outlines ``text(value)`` in JSON; a section without questions has a null one."""
    kind = "title string, sections array<struct<heading:string,questions:array<string>>>"
    told = text.select(F.from_json("value", kind).alias("o")).select("o.title", F.posexplode("o.sections").alias("k", "s"))
    return told.select("title", (F.col("k") + 1).alias("section_no"), F.col("s.heading").alias("section"), F.explode_outer("s.questions").alias("question"))


def book_meta(path: Column, head: Column) -> Column:
    """Title, ISBN and year of a book by its file's name and the first pages."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    found = lambda p, k: F.regexp_extract(F.coalesce(head, F.lit("")), p, k)
    return F.struct(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("title"), F.trim(found(ISBN, 1)).alias("isbn"), found(YEAR, 0).alias("year"), F.lit("book").alias("doc_type"))


def json_object(text: Column) -> Column:
    """JSON of a model's answer: the whole text, or the first object in it whose braces balance; null if neither parses.

    Braces inside strings do not count.
    """
    inside = F.substr(text, F.instr(text, "{"))
    tokens = F.regexp_extract_all(inside, F.lit(r'"(?:[^"\\]|\\.)*"|["{}]|[^"{}]+'), F.lit(0))
    # depth: open braces; -1 once the object has ended, or a string that never ends has begun.
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("whole"))

    def step(s: Column, t: Column) -> Column:
        depth = F.when(s["depth"] < 0, -1).when(t == '"', -1).when(t == "{", s["depth"] + 1).when(t == "}", s["depth"] - 1).otherwise(s["depth"])
        ended = (s["depth"] == 1) & (t == "}")
        size = F.when(s["depth"] < 0, s["size"]).otherwise(s["size"] + F.length(t))
        return F.struct(F.when(ended, -1).otherwise(depth).alias("depth"), size.alias("size"), (s["whole"] | ended).alias("whole"))

    found = F.aggregate(tokens, state, step, lambda s: F.when(s["whole"], F.left(inside, s["size"])))
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.when(F.instr(text, "{") > 0, found)))


def epub_package(opf: Column) -> Column:
    """Title, creator, publisher, date and ISBN of a package file's XML."""
    field = lambda n: F.xpath_string(opf, F.lit(f"//*[local-name()='{n}']"))
    ids = F.xpath(opf, F.lit("//*[local-name()='identifier']/text()"))
    digits = F.transform(ids, lambda i: F.struct(i.alias("raw"), F.regexp_replace(i, "[^0-9Xx]", "").alias("digits")))
    isbn = F.try_element_at(F.filter(digits, lambda s: F.lower(s["raw"]).contains("isbn") | F.length(s["digits"]).isin(10, 13)), F.lit(1))["digits"]
    return F.struct(field("title").alias("title"), field("creator").alias("creator"), field("publisher").alias("publisher"), field("date").alias("date"), F.coalesce(isbn, F.lit("")).alias("isbn"))


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, opf): the package file of each EPUB, null where the archive or its container file cannot be read."""
    for batch in batches:
        found = [_package(x) for x in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], names=["path", "opf"])


def _package(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
            named = next(e.get("full-path") for e in container.iter() if e.tag.rpartition("}")[2] == "rootfile")
            root = ElementTree.fromstring(archive.read(named))
        return ElementTree.tostring(root, encoding="unicode")
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, ValueError, RuntimeError, NotImplementedError, OSError, EOFError, zlib.error):
        return None


def epubs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, authors, publisher, year, isbn) of the EPUB files of a folder.

    Each task opens the archives of its files and hands on their package file; the fields are read from its XML.  Where an archive is
    broken the title is the file's name and the rest is empty.  Archives are read whole, one at a time.
    """
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.{epub,EPUB}").load(folder).select("path", "content")
    told = content.mapInArrow(_packages, "path string, opf string")
    texts = lambda n: F.filter(F.transform(F.coalesce(F.xpath("opf", F.lit(f"//*[local-name()='{n}']/text()")), F.array().cast("array<string>")), strip), lambda x: x != "")
    first = lambda x: F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))
    digits = lambda i: F.regexp_replace(i, "[^0-9Xx]", "")
    isbn = first(F.filter(texts("identifier"), lambda i: F.lower(i).contains("isbn") | F.length(digits(i)).isin(10, 13)))
    year = first(F.filter(F.transform(texts("date"), lambda d: F.regexp_extract(d, YEAR, 0)), lambda y: y != ""))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    return told.select("path", F.coalesce(F.try_element_at(texts("title"), F.lit(1)), name).alias("title"), F.array_join(texts("creator"), ", ").alias("authors"), first(texts("publisher")).alias("publisher"), year.alias("year"), strip(F.substring_index(isbn, ":", -1)).alias("isbn"))
