"""Sources: pages, chunk and tagged JSON, text artefacts, libraries and storage, all lazy and by Spark's own readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_MARK = "===== PAGE "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are fewer: work that costs much a row begins behind a scan of few tasks. A table of
    many files stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def page_range(pages: DataFrame, start: int | None = None, end: int | None = None, page: str = "page_num", text: str = "text") -> DataFrame:
    """Pages start..end (1-based, clamped to what there is) whose text is not blank."""
    low = max(1, start or 1)
    out = pages.where(F.col(page) >= low)
    if end is not None:
        out = out.where(F.col(page) <= max(end, low))
    return out.where(F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "")) > 0)


def page_records(pages: DataFrame, page: str = "page_num", cleaned: str = "text") -> DataFrame:
    """A record for every page, kept or not."""
    size = F.length(F.trim(F.coalesce(F.col(cleaned), F.lit(""))))
    return pages.select(F.col(page).alias("source_page"), size.alias("cleaned_char_count"), (size > 0).alias("kept"))


def rich_or_plain(rich: Column, plain: Column) -> Column:
    """The rich text unless it is blank."""
    return F.when(F.length(F.trim(rich)) > 0, rich).otherwise(plain)


def reading_order(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks with seq: by page, top to bottom, left to right; y and x rounded half-even to one digit as drawn."""
    order = Window.partitionBy(doc).orderBy("page_idx", F.bround("y0", 1), F.bround("x0", 1), "block_no")
    return blocks.withColumn("seq", F.row_number().over(order))


def lines_of_blocks(lines: DataFrame, glue: str = "\n") -> DataFrame:
    """One text per block of (doc_id, page_num, block_no, line_no, text)."""
    return lines.groupBy("doc_id", "page_num", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), glue).alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON that holds a list of pages or {"pages": [...]}."""
    raw = spark.read.text(path, wholetext=True)
    page = "array<struct<page_num:int,text:string>>"
    # an object read as an array is an array of it: the form is told by the first character
    listed = F.when(F.col("value").rlike(r"^\s*\{"), F.from_json(F.get_json_object("value", "$.pages"), page)).otherwise(F.from_json("value", page))
    return raw.select(F.inline(listed))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Tagged blocks by the number in the file's name (none: 0); the tag is under "tag" or "type", body if neither."""
    raw = spark.read.text(path, wholetext=True).withColumn("name", F.col("_metadata.file_name"))
    number = F.coalesce(F.nullif(F.regexp_extract("name", r"(\d+)\.json$", 1), F.lit("")).cast("int"), F.lit(0))
    rows = raw.select(number.alias("file_no"), F.posexplode(F.from_json("value", "array<struct<tag:string,type:string,content:string>>")).alias("seq", "b"))
    return rows.select("file_no", "seq", F.coalesce("b.tag", "b.type", F.lit("body")).alias("tag"), "b.content")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Every readable */meta.json, the newest first, with its size."""
    found = spark.read.option("mode", "DROPMALFORMED").option("multiLine", True).json(f"{path}/*/meta.json")
    return found.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("bytes")).orderBy(F.desc("modified"), "bytes")


def read_artifact_lines(spark: SparkSession, path: str, contains: str | None = None, limit: int = 40) -> DataFrame:
    """The first lines of a text artefact, or of those that contain a string whatever its case (a preview: the limit is the feature)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    if contains:
        lines = lines.where(F.contains(F.lower("line"), F.lit(contains.lower())))
    return lines.orderBy("line_no").limit(limit)


def storage_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def split_page_marks(text: Column) -> Column:
    """array<struct<page_num, text>> of a text with page marks; what stands before the first mark is left out."""
    parts = F.slice(F.split(text, PAGE_MARK), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("page_num"), F.regexp_replace(F.regexp_replace(p, r"^\d+[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text")))


def parse_files(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """(path, page_num, text, error) of binary documents, by a parser that gives the texts of a file's pages; none is built
    in. A file that it can't read is a row with the error. Files come whole to a worker, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "page_num", "text", "error"]
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                try:
                    pages = parser(batch.column(1)[k].as_py())
                    rows = [[name] * len(pages), list(range(1, len(pages) + 1)), pages, [None] * len(pages)]
                except Exception as e:
                    rows = [[name], [None], [None], [str(e)]]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.int32(), pa.string(), pa.string()))], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, page_num int, text string, error string")


def document_info(pages: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """page_count and last_page; with metadata (doc_id, title, author, subject) those too, empty where there are none."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.max("page_num").alias("last_page"))
    if metadata is None:
        return counts
    named = counts.join(metadata.select("doc_id", "title", "author", "subject"), "doc_id", "left")
    return named.select("doc_id", "page_count", "last_page", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author", "subject")])


def rich_reader(rich: Callable[[bytes], list[str]], plain: Callable[[bytes], list[str]]) -> Callable[[bytes], list[str]]:
    """A parser for parse_files: each page's rich text, or its plain one where that is blank or the rich reader fails."""

    def read(content: bytes) -> list[str]:
        pages = plain(content)
        try:
            found = rich(content)
        except Exception:
            return pages
        return [found[k] if k < len(found) and found[k].strip() else page for k, page in enumerate(pages)]

    return read


def is_upload(name: Column) -> Column:
    """Names of files that are taken: PDFs, whatever the case of their ending."""
    return F.lower(name).endswith(".pdf")


def docx_blocks(content: bytes) -> Iterator[tuple[str, str, list[list[str]]]]:
    """(kind, text, rows) of the body of a DOCX file: paragraphs and tables in order."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    forms = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    text = lambda p: "".join(forms[e.tag](e) for e in p.iter() if e.tag in forms)
    for child in [] if body is None else body:
        if child.tag == f"{w}p":
            yield "paragraph", text(child), []
        elif child.tag == f"{w}tbl":
            rows = [["\n".join(text(p) for p in cell.iter(f"{w}p")) for cell in row.findall(f"{w}tc")] for row in child.findall(f"{w}tr")]
            yield "table", "", rows


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, block_no, kind, text, rows, error) of DOCX files: paragraphs and tables as they stand in the body. A file that
    can't be read is a row with the error. Files come whole to a worker, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block_no", "kind", "text", "rows", "error"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                try:
                    made = [(name, n, *b, None) for n, b in enumerate(docx_blocks(batch.column(1)[k].as_py()))]
                except Exception as e:
                    made = [(name, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, block_no int, kind string, text string, rows array<array<string>>, error string")


def tagged_or_body(pages: DataFrame, tagged: str = "tagged", text: str = "text") -> DataFrame:
    """(doc_id, page_num, seq, tag, content): what a tagger gave for each page, or the page's text as one body block where it
    failed (null)."""
    block = "array<struct<tag:string,content:string>>"
    whole = F.array(F.struct(F.lit("body").alias("tag"), F.col(text).alias("content"))).cast(block)
    return pages.select("doc_id", "page_num", F.posexplode(F.coalesce(F.col(tagged).cast(block), whole)).alias("seq", "b")).select("doc_id", "page_num", "seq", "b.tag", "b.content")


def opening_pages(pages: DataFrame, first: int = 30, glue: str = "\n\n") -> DataFrame:
    """One text of each document's first pages."""
    few = pages.where(F.col("page_num") <= first)
    return few.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda p: p["text"]), glue).alias("text"))
