"""Documents: partitioning, chunking, routing, and lineage of SQL statements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that end a sentence.
ENDS = "。？！.?!\n"


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of overlapping chunks; a chunk ends behind its last line end if that lies past its middle."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            line = text.rfind("\n", at, end + 1)
            if line - at > size / 2:
                end = line + 1
        yield at, end
        if end >= len(text):
            return
        at = end - overlap if end - overlap > at else end


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk, start, text) of docs (doc_id, text): chunks of `size` characters, `overlap` of them shared. Null and empty texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(spans(text or "", size, overlap))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc_id] * len(found), pa.int64()), "chunk": pa.array(range(len(found)), pa.int32()), "start": pa.array([a for a, _ in found], pa.int32()), "text": pa.array([text[a:b] for a, b in found], pa.string())}
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk int, start int, text string")


def sentences_of(text: Column, size: int) -> Column:
    """Sentences with what ends them; one longer than `size` is cut in pieces of it."""
    whole = F.filter(F.split(text, f"(?<=[{ENDS}])"), lambda s: s != "")
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda i: F.substring(s, i * size + 1, F.lit(size)))
    return F.flatten(F.transform(whole, pieces))


def packed(parts: Column, sizes: Column, size: int, joint: str) -> Column:
    """Parts joined in order to the fewest runs whose sizes (and a joint between parts) stay within `size`; a larger part is a run of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0.0).alias("n"))
    pairs = F.zip_with(parts, sizes, lambda p, s: F.struct(p.alias("p"), s.cast("double").alias("s")))

    def step(a: Column, x: Column) -> Column:
        fits = a["now"].isNotNull() & (a["n"] + len(joint) + x["s"] <= size)
        return F.struct(
            F.when(fits | a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])).alias("done"),
            F.when(fits, F.concat(a["now"], F.lit(joint), x["p"])).otherwise(x["p"]).alias("now"),
            F.when(fits, a["n"] + len(joint) + x["s"]).otherwise(x["s"]).alias("n"),
        )

    return F.aggregate(pairs, start, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def by_sentences(text: Column, size: int) -> Column:
    """A text in chunks of whole sentences within `size` characters, joined by line ends; a text that fits is one chunk."""
    s = sentences_of(text, size)
    return F.when(F.length(text) <= size, F.filter(F.array(text), lambda t: t != "")).otherwise(packed(s, F.transform(s, lambda x: F.length(x)), size, "\n"))


def adaptive_size(total: Column) -> Column:
    """Characters a chunk by a document's size."""
    return F.when(total > 50_000, 2500).when(total > 20_000, 1800).otherwise(1200)


def estimated_tokens(text: Column) -> Column:
    """Half a token for each CJK character, one for each word."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.floor(F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fa5}]")) * 0.5 + words).cast("long")


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})(?: |$)", 1))


def elements(docs: DataFrame) -> DataFrame:
    """(doc_id, element, type, text, path) of Markdown texts: TITLE, TABLE, CODE_BLOCK, NARRATIVE_TEXT in order; path: the headings above, joined by ' > '.

    Lines are rows; windows over a document's lines tell fenced code, runs of table rows and paragraphs, and
    the last heading of each level that no later one of a higher level has closed. An open fence runs to the end.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).withColumn("line", F.rtrim("raw"))
    order = Window.partitionBy("doc_id").orderBy("i")
    fence = F.startswith("line", F.lit("```"))
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(order)).withColumn("fence", fence)
    code = (F.col("fences") % 2 == 1) | F.col("fence")
    lines = lines.withColumn("level", F.when(code, 0).otherwise(heading_level(F.col("line"))))
    kind = F.when(code, "CODE_BLOCK").when(F.col("level") > 0, "TITLE").when(F.startswith("line", F.lit("|")), "TABLE").when(F.col("line") == "", "BLANK").otherwise("NARRATIVE_TEXT")
    lines = lines.withColumn("type", kind)
    # a title is an element of its own; an opening fence starts one; otherwise a change of type does
    starts = (F.col("type") == "TITLE") | (F.col("fence") & (F.col("fences") % 2 == 1)) | ~F.col("type").eqNullSafe(F.lag("type").over(order))
    lines = lines.withColumn("element", F.sum(starts.cast("int")).over(order))
    title = F.trim(F.expr("substring(line, level + 1)"))
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = [F.last(F.when(F.col("level") == k, F.struct("i", title.alias("t"))), ignorenulls=True).over(past) for k in range(1, 7)]
    lines = lines.withColumns({f"h{k}": h for k, h in enumerate(heads, 1)})
    open_ = [F.when(F.col(f"h{k}.i") > F.greatest(F.lit(-1), F.lit(-2), *[F.coalesce(F.col(f"h{j}.i"), F.lit(-1)) for j in range(1, k)]), F.col(f"h{k}.t")) for k in range(1, 7)]
    lines = lines.withColumn("path", F.concat_ws(" > ", *open_)).where("type <> 'BLANK' and not (fence and type = 'CODE_BLOCK')")
    text = F.when(F.col("type") == "TITLE", title).when(F.col("type") == "CODE_BLOCK", F.col("raw")).otherwise(F.col("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "\n")
    return lines.groupBy("doc_id", "element").agg(F.first("type").alias("type"), joined.alias("text"), F.first("path").alias("path"))


def structured_chunks(parts: DataFrame, size: int) -> DataFrame:
    """(doc_id, section, chunk, text) of elements: tables and code alone, runs of other elements under one heading path together.

    Longer sections are cut by sentences. Text is prefixed by its heading path in brackets.
    """
    order = Window.partitionBy("doc_id").orderBy("element")
    alone = F.col("type").isin("TABLE", "CODE_BLOCK")
    top = (F.col("type") == "TITLE") & ~F.contains("path", F.lit(" > "))
    cut = alone | top | F.coalesce(F.lag(alone).over(order), F.lit(True)) | ~F.col("path").eqNullSafe(F.lag("path").over(order))
    rows = parts.withColumn("alone", alone).withColumn("top", top).withColumn("cut", cut.cast("int")).withColumn("section", F.sum("cut").over(order)).where("not top")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "text"))), lambda x: x["text"]), "\n")
    sections = rows.groupBy("doc_id", "section").agg(text.alias("text"), F.first("path").alias("path"), F.first("alone").alias("alone"))
    pieces = F.when(F.col("alone"), F.array("text")).otherwise(by_sentences(F.col("text"), size))
    prefix = F.when(F.col("path") != "", F.concat(F.lit("["), F.col("path"), F.lit("]\n"))).otherwise("")
    return sections.select("doc_id", "section", F.posexplode(pieces).alias("chunk", "piece"), prefix.alias("prefix")).select("doc_id", "section", "chunk", F.concat("prefix", "piece").alias("text"))


def heading_chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk, text): sections from heading to heading ('# x' or '1.2 x'), packed up to `size` estimated tokens."""
    sections = F.filter(F.split("text", r"(?m)(?=^#{1,6}\s+\S)|(?=^\d+(?:\.\d+)*\s+\S)"), lambda s: s != "")
    parts = packed(sections, F.transform(sections, estimated_tokens), size, "")
    return docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("chunk", "text"))


def tier(pdf: Column, text: Column, pages: Column) -> Column:
    """How a document is read: OCR for a PDF with hardly any text, LAYOUT for tables or many pages, else FAST."""
    table = F.coalesce(text, F.lit("")).rlike(r"(?m)^\|.*\n\|")
    return F.when(pdf & (F.length(F.coalesce(text, F.lit(""))) < 1000), "OCR").when(table | (pages > 5), "LAYOUT").otherwise("FAST")


def layout_confidence(confidence: Column, filled: Column, total: Column, tables: Column) -> Column:
    """Confidence x share of filled elements, a tenth more where there are tables, in [0, 1]."""
    share = F.when(total > 0, filled / total).otherwise(0.0)
    return F.least(F.greatest(confidence * share + F.when(tables > 0, 0.1).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def parser_for(mime: Column, size: Column, large: int = 50_000_000) -> Column:
    """Parser by MIME type; files over `large` bytes go to the streaming one."""
    kind = F.lower(mime)
    return F.when(size > large, "stream").when(kind.contains("pdf"), "pdf").when(kind.rlike("word|sheet|excel"), "office").when(kind.startswith("image/"), "ocr").when(kind.rlike("html|xml"), "markup").otherwise("text")


_NAME = r"[`\"]?([A-Za-z_][\w.]*)[`\"]?"


def statement_lineage(sql: Column) -> Column:
    """Struct of a statement's type, read, written and joined tables, and written columns; names lower-cased, sorted, distinct.

    Placeholders of mappers (#{x}, ${x}) and their tags are blanked first. A subquery's tables count as read.
    """
    plain = F.regexp_replace(F.regexp_replace(sql, r"[#$]\{[^}]*\}", "?"), r"<[^>]+>", " ")
    names = lambda p: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(1)), F.lower)))
    kind = F.upper(F.regexp_extract(plain, r"(?i)^\s*(select|insert|update|delete|merge|with)\b", 1))
    written = names(r"(?i)\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+" + _NAME)
    inserted = F.regexp_extract(plain, r"(?i)\binsert\s+into\s+[`\"]?[\w.]+[`\"]?\s*\(([^)]*)\)", 1)
    assigned = F.regexp_extract_all(F.regexp_extract(plain, r"(?is)\bset\b(.*?)(?:\bwhere\b|$)", 1), F.lit(r"(?i)([A-Za-z_][\w.]*)\s*="), F.lit(1))
    columns = F.concat(F.filter(F.transform(F.split(inserted, ","), lambda c: F.trim(c)), lambda c: c != ""), assigned)
    return F.struct(
        F.when(kind == "WITH", "SELECT").otherwise(kind).alias("type"), F.array_except(names(r"(?i)\b(?:from|join)\s+" + _NAME), F.when(kind == "DELETE", written).otherwise(F.array().cast("array<string>"))).alias("reads"), written.alias("writes"),
        names(r"(?i)\bjoin\s+" + _NAME).alias("joins"), F.array_sort(F.array_distinct(F.transform(columns, F.lower))).alias("columns"),
    )


def mapper_statements(mappers: DataFrame) -> DataFrame:
    """(id, kind, sql) of mapper XML texts (column xml): statements named namespace.id, included fragments put in their place."""
    rows = mappers.select(F.regexp_extract("xml", r'<mapper[^>]*namespace="([^"]+)"', 1).alias("ns"), "xml")
    found = rows.select("ns", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)(<(?:select|insert|update|delete|sql)\b.*?</(?:select|insert|update|delete|sql)>)"), F.lit(1))).alias("tag"))
    found = found.select("ns", F.regexp_extract("tag", r"^<(\w+)", 1).alias("kind"), F.regexp_extract("tag", r'\bid="([^"]+)"', 1).alias("name"), F.trim(F.regexp_extract("tag", r"(?s)^<[^>]*>(.*)</\w+>$", 1)).alias("body"))
    fragments = found.where("kind = 'sql'").groupBy("ns").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "body")))).alias("fragments"))
    whole = found.where("kind <> 'sql'").join(fragments, "ns", "left")
    parts = F.split("body", r'(?=<include\s)|(?<=/>)')
    name = lambda p: F.regexp_extract(p, r'^<include\s+refid="([^"]+)"', 1)
    put = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<include"), F.coalesce(F.try_element_at("fragments", name(p)), F.lit(""))).otherwise(p)), "")
    return whole.select(F.concat_ws(".", "ns", "name").alias("id"), "kind", F.trim(F.regexp_replace(put, r"\s+", " ")).alias("sql"))
