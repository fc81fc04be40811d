"""Page splitting and the four chunking strategies, as array folds inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V

CHUNKS = ["fingerprint", "filename", "chunk_id", "ordinal", "page_start", "page_end", "text"]


def split_pages(docs: DataFrame, page_chars: int = 3500, renumber: bool = True, key: str = "doc_id") -> DataFrame:
    """key, page_number, text: slices of ``page_chars``, trimmed, blank ones dropped. ``renumber``: consecutive numbers
    from 1, else by position. Slices are numbered inside the array, so nothing is shuffled."""
    body = T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"))
    d = docs.select(key, body.alias("body"))
    n = F.ceil(F.length("body") / page_chars).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("page_number"), T.strip(F.substring(F.col("body"), (i - 1) * page_chars + 1, F.lit(page_chars))).alias("text")))
    kept = F.filter(F.when(n > 0, cut).otherwise(F.array().cast("array<struct<page_number:int,text:string>>")), lambda p: p["text"] != "")
    if renumber:
        kept = F.transform(kept, lambda p, i: F.struct((i + 1).alias("page_number"), p["text"].alias("text")))
    return d.select(key, F.explode(kept).alias("p")).select(key, "p.page_number", "p.text")


def full_text(pages: DataFrame, *by: str) -> DataFrame:
    """``by``, full_text: non-blank pages in order, each after its page mark, a blank line between."""
    marked = F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), T.strip(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("page_number", marked.alias("text"))))
    return pages.where(~T.blank(F.col("text"))).groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("full_text"))


def spans(c: Column, size: int, overlap: int) -> Column:
    """Texts of sliding windows: a window ends after its last blank line or space if that lies past its half; the next
    one begins ``overlap`` before the end. ``overlap`` is at most half of ``size``, so every step moves on."""
    if not 0 <= overlap <= size // 2:
        raise ValueError("overlap must lie between 0 and half of size")

    def last_break(w: Column) -> Column:
        space = lambda back: F.when(F.instr(back, " ") > 0, F.length(w) - F.instr(back, " ")).otherwise(-1)
        line = lambda back: F.when(F.instr(back, "\n\n") > 0, F.length(w) - F.instr(back, "\n\n") - 1).otherwise(-1)
        return T.let(F.reverse(w), lambda back: F.greatest(space(back), line(back)))

    def folded(v: Column) -> Column:
        def moved(acc: Column, w: Column, take: Column) -> Column:
            end = acc["start"] + take
            return F.struct(F.when(end >= F.length(v), F.lit(-1)).otherwise(F.greatest(F.lit(0), end - overlap)).alias("start"), F.concat(acc["out"], F.array(F.substring(w, F.lit(1), take))).alias("out"))

        def cut(acc: Column, w: Column) -> Column:
            inner = acc["start"] + F.length(w) < F.length(v)
            return T.let(last_break(w), lambda at: T.let(F.when(inner & (at > size // 2), at + 1).otherwise(F.length(w)), lambda take: moved(acc, w, take)))

        def step(acc: Column, _: Column) -> Column:
            return F.when(acc["start"] < 0, acc).otherwise(T.let(F.substring(v, acc["start"] + 1, F.lit(size)), lambda w: cut(acc, w)))

        zero = F.struct(F.when(F.length(v) > 0, F.lit(0)).otherwise(F.lit(-1)).alias("start"), F.array().cast("array<string>").alias("out"))
        most = F.ceil(F.length(v) / (size // 2 + 1 - min(overlap, size // 2))).cast("int") + 1
        return F.aggregate(F.sequence(F.lit(1), most), zero, step)["out"]

    return F.filter(F.transform(T.let(c, folded), T.strip), lambda t: t != "")


def split_text(c: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Chunk texts of one text."""
    return spans(T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\n{3,}", "\n\n")), size, overlap)


def _numbered(pieces: DataFrame, strategy: str) -> DataFrame:
    """Ordinals and ids of pieces (fingerprint, filename, page_number, pos, text)."""
    order = Window.partitionBy("fingerprint").orderBy("page_number", "pos")
    d = pieces.withColumn("ordinal", F.row_number().over(order) - 1)
    key = F.coalesce(F.when(F.col("fingerprint") != "", F.col("fingerprint")), F.col("filename"))
    return d.select("fingerprint", "filename", T.chunk_id(key, F.col("page_number"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "ordinal", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "text", F.lit(strategy).alias("strategy"))


def _labelled(c: Column) -> Column:
    return F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("]\n"), c)


def recursive(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Sliding windows over the whole text of a document (fingerprint, filename, page_number, text)."""
    docs = full_text(pages, "fingerprint", "filename").select("fingerprint", "filename", F.posexplode(split_text(F.col("full_text"), size, overlap)).alias("ordinal", "text"))
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\[Page\s+(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    first, last = F.coalesce(F.array_min(found), F.lit(0)), F.coalesce(F.array_max(found), F.lit(0))
    key = F.coalesce(F.when(F.col("fingerprint") != "", F.col("fingerprint")), F.col("filename"))
    return docs.withColumns({"page_start": first, "page_end": last}).select("fingerprint", "filename", T.chunk_id(key, F.col("page_start"), F.col("ordinal"), F.col("text")).alias("chunk_id"), "ordinal", "page_start", "page_end", "text", F.lit("recursive").alias("strategy"))


def page_aware(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """A page that fits is one chunk; a longer one is split by itself. Only the first piece of a page has its mark."""
    marked = _labelled(T.strip(F.col("text")))
    d = pages.where(~T.blank(F.col("text"))).select("fingerprint", "filename", "page_number", marked.alias("marked"))
    parts = F.when(F.length("marked") <= size, F.array("marked")).otherwise(split_text(F.col("marked"), size, overlap))
    return _numbered(d.select("fingerprint", "filename", "page_number", F.posexplode(parts).alias("pos", "text")), "page_aware")


def packed_blocks(blocks: Column, size: int) -> Column:
    """Consecutive blocks joined by a line feed while they fit; a block longer than ``size`` stands alone."""

    def step(acc: Column, b: Column) -> Column:
        both = F.when(acc["buffer"] == "", b).otherwise(F.concat(acc["buffer"], F.lit("\n"), b))
        fits = F.length(both) <= size
        flushed = F.when(acc["buffer"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buffer"])))
        return F.struct(F.when(fits, both).otherwise(b).alias("buffer"), F.when(fits, acc["out"]).otherwise(flushed).alias("out"))

    zero = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(blocks, zero, step, lambda acc: F.when(acc["buffer"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buffer"]))))


def layout_aware(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """HTML blocks packed up to ``size`` (tags included), then stripped. Documents without HTML are chunked by page."""
    has = F.max(~T.blank(F.col("html"))).over(Window.partitionBy("fingerprint"))
    d = pages.withColumn("has_html", has)
    html, text = T.strip(F.coalesce("html", F.lit(""))), T.strip(F.coalesce("text", F.lit("")))
    source = F.when(html != "", html).otherwise(text)
    blocks = F.transform(T.html_blocks(html), T.strip)
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(source))
    e = d.where("has_html").where(source != "").select("fingerprint", "filename", "page_number", F.posexplode(packed_blocks(blocks, size)).alias("pos", "raw"))
    laid = _numbered(e.select("fingerprint", "filename", "page_number", "pos", _labelled(T.html_strip(F.col("raw"))).alias("text")), "layout_aware")
    return laid.unionByName(page_aware(d.where("not has_html").drop("has_html"), size, overlap))


def merged_sentences(sentences: Column, dots: Column, size: int, threshold: float) -> Column:
    """Neighbouring sentences joined while their vectors agree (``dots[i]``: with the sentence before) and they fit."""

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["buffer"] != "") & (x["dot"] >= threshold) & (F.length(acc["buffer"]) + 1 + F.length(x["s"]) <= size)
        out = F.when(joins | (acc["buffer"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buffer"])))
        return F.struct(F.when(joins, F.concat(acc["buffer"], F.lit(" "), x["s"])).otherwise(x["s"]).alias("buffer"), out.alias("out"))

    zero = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("out"))
    both = F.zip_with(sentences, dots, lambda s, d: F.struct(s.alias("s"), F.coalesce(d, F.lit(0.0)).alias("dot")))
    return F.aggregate(both, zero, step, lambda acc: F.when(acc["buffer"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buffer"]))))


def semantic(pages: DataFrame, embed, size: int = 1200, threshold: float = 0.55) -> DataFrame:
    """Sentences merged while neighbouring embeddings agree. ``embed``: Column of tokens to Column of unit vectors; with
    an ``agreement`` of its own a page stays one row and no vector is shuffled. A page that fits or has one sentence is
    one chunk."""
    d = T.settled(pages.select("fingerprint", "filename", "page_number", "text"), "body", T.strip(F.col("text"))).where("body <> ''").drop("text")
    d = T.settled(d, "sentences", T.sentences(F.col("body")))
    whole = (F.size("sentences") <= 1) | (F.length("body") <= size)
    if hasattr(embed, "agreement"):
        d = T.settled(d, "tokens", F.when(~whole, F.transform("sentences", lambda s: T.tokenize(s)))).withColumn("dots", embed.agreement(F.col("tokens")))
        pieces = F.when(F.col("dots").isNull(), F.array("body")).otherwise(merged_sentences(F.col("sentences"), F.col("dots"), size, threshold))
        return _numbered(d.select("fingerprint", "filename", "page_number", F.posexplode(pieces).alias("pos", "body")).withColumn("text", _labelled(F.col("body"))), "semantic")
    one = d.where(whole).select("fingerprint", "filename", "page_number", F.lit(0).alias("pos"), "body")
    rows = d.where(~whole).select("fingerprint", "filename", "page_number", F.posexplode("sentences").alias("i", "s"))
    rows = T.settled(rows, "tokens", T.tokenize(F.col("s"))).withColumn("v", embed(F.col("tokens")))
    near = rows.withColumn("dot", V.dot(F.lag("v").over(Window.partitionBy("fingerprint", "filename", "page_number").orderBy("i")), F.col("v")))
    lists = near.groupBy("fingerprint", "filename", "page_number").agg(F.array_sort(F.collect_list(F.struct("i", "s", "dot"))).alias("r"))
    merged = merged_sentences(F.transform("r", lambda x: x["s"]), F.transform("r", lambda x: x["dot"]), size, threshold)
    many = lists.select("fingerprint", "filename", "page_number", F.posexplode(merged).alias("pos", "body"))
    return _numbered(one.unionByName(many).select("fingerprint", "filename", "page_number", "pos", _labelled(F.col("body")).alias("text")), "semantic")


def chunk(pages: DataFrame, strategy: str = "page_aware", size: int = 1200, overlap: int = 200, embed=None) -> DataFrame:
    """Chunks by strategy name."""
    if strategy == "semantic":
        return semantic(pages, embed or V.hashed_embedding(), size)
    known = {"recursive": recursive, "page_aware": page_aware, "layout_aware": layout_aware}
    if strategy not in known:
        raise ValueError(f"unknown chunk strategy: {strategy}")
    return known[strategy](pages, size, overlap)
