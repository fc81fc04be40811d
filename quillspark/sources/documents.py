"""Documents from base64 payloads or files: decoding, type detection, text pages. Bad input becomes an error column."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as T
from quillspark.functions.images import image_header
from quillspark.operators.chunking import split_pages
from quillspark.sources.pdf import pdf_pages

PAGES = "fingerprint string, filename string, page_number int, text string, load_error string"


def decode_payload(c: Column, max_bytes: int = 50 << 20) -> Column:
    """struct(content, error) of a base64 text."""
    content = F.try_to_binary(c, F.lit("base64"))
    size = F.octet_length(content)
    error = (
        F.when(F.coalesce(c, F.lit("")) == "", "no document was given")
        .when(content.isNull(), "the payload is not valid base64")
        .when(size == 0, "the document is empty")
        .when(size > max_bytes, f"the document is larger than {max_bytes >> 20} MB")
    )
    return F.struct(F.when(error.isNull(), content).alias("content"), error.alias("error"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^.\\/]+)$", 1))


def mime(name: Column, content: Column) -> Column:
    """By extension, else by leading bytes, else octet-stream."""
    table = F.create_map(*[F.lit(x) for kv in C.MIME_BY_EXTENSION.items() for x in kv])
    head = F.hex(F.substring(content, 1, 16))
    found = F.when(F.startswith(head, F.lit(C.MAGIC[0][0])), C.MAGIC[0][1])
    for magic, kind in C.MAGIC[1:]:
        found = found.when(F.startswith(head, F.lit(magic)), kind)
    found = found.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    found = found.when(F.startswith(head, F.lit("504B")) & (extension(name) == "docx"), C.MIME_BY_EXTENSION["docx"])
    return F.coalesce(F.try_element_at(table, extension(name)), found, F.lit("application/octet-stream"))


def reader_kind(name: Column, kind: Column) -> Column:
    return F.when((kind == "application/pdf"), "pdf").when(F.startswith(kind, F.lit("image/")), "image").when(kind == C.MIME_BY_EXTENSION["docx"], "docx").when(F.startswith(kind, F.lit("text/")), "text").otherwise("unsupported")


def decode_text(content: Column) -> Column:
    """UTF-8, else Windows-1256. The session must allow Java charsets."""
    as_text = F.decode(content, "UTF-8")
    return F.when(F.is_valid_utf8(content.cast("string")), as_text).otherwise(F.decode(content, "windows-1256"))


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs, then each table row as its non-blank cells."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    lines = [said(p) for p in body.findall(f"{w}p")]
    for row in body.iter(f"{w}tr"):
        lines.append(" | ".join(c for c in (said(cell) for cell in row.findall(f"{w}tc")) if c))
    return "\n".join(x for x in lines if x)


def _binary_pages(read: Callable[[bytes], list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    rows += [(r.fingerprint, r.filename, i, t, None) for i, t in enumerate(read(bytes(r.content)), 1)]
                except Exception as e:  # a bad file is a row with its error
                    rows.append((r.fingerprint, r.filename, 0, None, f"unreadable: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["fingerprint", "filename", "page_number", "text", "load_error"])

    return run


def load(files: DataFrame, max_pages: int = 120, page_chars: int = 3500, pdf: Callable[[bytes, int], list[str]] = pdf_pages) -> DataFrame:
    """Pages (fingerprint, filename, page_number, text, load_error) of files (filename, content, optional error).
    ``pdf``: from a PDF file and the most pages to the page texts. Images have no text layer and are rejected; every
    rejected file is one row with page_number 0 and its error."""
    named = T.settled(files, "filename", T.sanitize_filename(F.col("filename")))  # named by every branch
    d = named.select("filename", "content", (F.col("error") if "error" in files.columns else F.lit(None).cast("string")).alias("error"))
    d = d.withColumns({"fingerprint": F.sha2("content", 256), "kind": F.when(F.col("error").isNotNull(), "bad").otherwise(reader_kind(F.col("filename"), mime(F.col("filename"), F.col("content"))))})
    text = d.where("kind = 'text'").withColumn("text", decode_text(F.col("content"))).withColumn("key", F.struct("fingerprint", "filename"))
    text_pages = split_pages(text, page_chars, key="key").select("key.fingerprint", "key.filename", "page_number", "text", F.lit(None).cast("string").alias("load_error"))
    pdfs = d.where("kind = 'pdf'").select("fingerprint", "filename", "content").mapInPandas(_binary_pages(lambda data: pdf(data, max_pages)), PAGES)
    docx = d.where("kind = 'docx'").select("fingerprint", "filename", "content").mapInPandas(_binary_pages(lambda data: [docx_text(data)]), PAGES)
    docx_ok = docx.where("load_error is null").withColumn("key", F.struct("fingerprint", "filename"))
    docx_pages = split_pages(docx_ok, page_chars, key="key").select("key.fingerprint", "key.filename", "page_number", "text", F.lit(None).cast("string").alias("load_error"))
    why = F.when(F.col("kind") == "image", "images have no text layer").when(F.col("kind") == "bad", F.col("error")).otherwise("unsupported file type")
    bad = d.where("kind in ('image', 'unsupported', 'bad')").select("fingerprint", "filename", F.lit(0).alias("page_number"), F.lit(None).cast("string").alias("text"), why.alias("load_error"))
    return text_pages.unionByName(pdfs).unionByName(docx_pages).unionByName(docx.where("load_error is not null")).unionByName(bad)


def extract(pages: DataFrame) -> DataFrame:
    """Cleaned page texts without repeated lines; a file without enough text is one row with its error."""
    ok = pages.where("load_error is null").withColumn("text", T.dedupe_lines(T.clean_text(F.col("text"))))
    chars = ok.groupBy("fingerprint", "filename").agg(F.sum(F.length(T.strip(F.col("text")))).alias("chars"))
    pdf = F.endswith(F.lower("filename"), F.lit(".pdf"))
    poor = chars.where(F.col("chars") < F.when(pdf, 40).otherwise(1))
    errors = poor.select("fingerprint", "filename", F.lit(0).alias("page_number"), F.lit(None).cast("string").alias("text"), F.lit("the document has no digital text").alias("load_error"))
    return ok.join(poor, ["fingerprint", "filename"], "left_anti").unionByName(errors).unionByName(pages.where("load_error is not null"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """filename, content of the files below a folder; hidden ones are skipped."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return d.select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "path", "content")


def find_files(spark: SparkSession, path: str, query: str, extensions: list[str] | None = None, most: int = 50) -> DataFrame:
    """Paths whose file name contains ``query`` in any case; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    ok = F.contains(name, F.lit(query.lower())) & (extension(name).isin(*extensions) if extensions else F.lit(True))
    return d.where(ok).orderBy("path").limit(most)


def images(files: DataFrame) -> DataFrame:
    """fingerprint, filename, kind, width, height and mode of the image files among ``files`` (filename, content)."""
    d = T.settled(files.select(F.col("filename"), "content"), "filename", T.sanitize_filename(F.col("filename")))
    d = T.settled(d, "_kind", reader_kind(F.col("filename"), mime(F.col("filename"), F.col("content")))).where("_kind = 'image'")
    return T.settled(d.withColumn("fingerprint", F.sha2("content", 256)), "image", image_header(F.col("content"))).select("fingerprint", "filename", "image.kind", "image.width", "image.height", "image.mode")


#: Finds up to so many results (title, snippet, link) for a text.
SearchProvider = Callable[[str, int], list[dict]]
RESULTS = "rank int, title string, snippet string, link string, search_error string"


def search(queries: DataFrame, provider: SearchProvider, most: int = 5, block: int = 100, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """query_id, rank, title, snippet, link, search_error: what a provider finds for each of ``queries`` (query_id, text).

    The provider is called in tasks, ``block`` queries each. A query that fails ``attempts`` times is one row with rank 0
    and its error; others are not disturbed. A blank query finds nothing."""
    kind = queries.schema["query_id"].dataType.simpleString()
    n = max(1, -(-queries.count() // block))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["query_id"], b["text"], strict=True):
                for left in range(attempts - 1, -1, -1):
                    try:
                        found = provider(t, most) if t and t.strip() else []
                        rows += [(i, k, r.get("title"), r.get("snippet"), r.get("link"), None) for k, r in enumerate(found[:most], 1)]
                        break
                    except Exception as e:  # a query that cannot be answered is a row with its error
                        if not left:
                            rows.append((i, 0, None, None, None, f"{type(e).__name__}: {e}"))
                        else:
                            time.sleep(pause)
            yield pd.DataFrame(rows, columns=["query_id", "rank", "title", "snippet", "link", "search_error"])

    return queries.select("query_id", "text").repartition(n).mapInPandas(run, f"query_id {kind}, {RESULTS}")


def stored_search(queries: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """As ``search``, from stored results (query text, rank, title, snippet, link) of the same texts."""
    r = results.where(F.col("rank").between(1, most)).select("query", F.col("rank").cast("int").alias("rank"), "title", "snippet", "link")
    return queries.join(r, F.col("text") == F.col("query")).select("query_id", "rank", "title", "snippet", "link", F.lit(None).cast("string").alias("search_error"))


def search_results_text(results: DataFrame, most: int = 5) -> DataFrame:
    """query_id, text: titles, snippets and links of the first ``most`` results (query_id, rank, title, snippet, link)."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("snippet", F.lit("")), F.lit("\n"), F.coalesce("link", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("p"))))
    return results.where(F.col("rank").between(1, most)).groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["p"]), "\n\n").alias("text"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A multi-line JSON report."""
    return spark.read.json(path, multiLine=True)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append result rows as JSON lines."""
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Replace a report by ``rows``, as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, path: str, append: bool = False) -> None:
    """Write one string column as lines of text."""
    rows.write.mode("append" if append else "overwrite").text(path)
