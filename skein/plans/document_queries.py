"""Queries of skein.operators.documents."""

from pyspark.sql import functions as F

from skein.operators import documents as D
from skein.plans.registry import query

_TEXTS = "text is not null"


@query("D1_fixed_chunks", None)
def _(d):
    return D.fixed_chunks(d.documents, 1000, 100).select("doc_id", "chunk", "start", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def _markdown(d):
    """Documents as Markdown: a title, their lines, a table and a fenced block."""
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n## "), F.col("lang"), F.lit("\n"), "text", F.lit("\n\n| a | b |\n| 1 | 2 |\n\n## Code\n```sql\nselect 1\n\n# not a title\n```\nend."))
    return d.documents.where(_TEXTS).select("doc_id", text.alias("text"))


@query("D6_elements", None)
def _(d):
    return D.elements(_markdown(d))


@query("D2_structured_chunks", None)
def _(d):
    return D.structured_chunks(D.elements(_markdown(d)), 1200).select("doc_id", "section", "chunk", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("D3_sentence_chunks", None)
def _(d):
    return d.documents.where(_TEXTS).select("doc_id", F.posexplode(D.by_sentences(F.col("text"), 800)).alias("chunk", "text")).select("doc_id", "chunk", F.length("text").alias("chars"))


@query("D4_adaptive_sizes", "select doc_id, case when length(text) > 50000 then 2500 when length(text) > 20000 then 1800 else 1200 end size from documents where text is not null")
def _(d):
    return d.documents.where(_TEXTS).select("doc_id", D.adaptive_size(F.length("text")).alias("size"))


@query("D5_estimated_tokens", "select doc_id, cast(floor(0.5 * len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fa5}]')) + len(list_filter(regexp_split_to_array(text, '[\\s\\v]+'), lambda w: w <> ''))) as bigint) tokens from documents where text is not null")
def _(d):
    return d.documents.where(_TEXTS).select("doc_id", D.estimated_tokens(F.regexp_replace("text", "\x0b", " ")).alias("tokens"))


@query("D5_heading_chunks", None)
def _(d):
    return D.heading_chunks(_markdown(d), 400).select("doc_id", "chunk", F.length("text").alias("chars"))


@query("D8_tiers", "select page_id, case when page_id % 3 = 0 and length(html) < 1000 then 'OCR' when page_id % 10 > 5 then 'LAYOUT' else 'FAST' end tier from (select page_id, coalesce(html, '') html from pages) p where not regexp_matches(html, '(^|\\n)\\|[^\\n]*\\n\\|')")
def _(d):
    p = d.pages.where(~F.coalesce("html", F.lit("")).rlike(r"(?m)^\|.*\n\|"))
    return p.select("page_id", D.tier(F.col("page_id") % 3 == 0, F.col("html"), F.col("page_id") % 10).alias("tier"))


_SQLS = """select o_orderkey, case o_orderkey % 4 when 0 then concat('SELECT a.x FROM t', cast(o_custkey % 9 as string), ' a JOIN `u', cast(o_custkey % 5 as string), '` b ON a.id = b.id WHERE a.y = #{{y}}')
    when 1 then concat('insert into t', cast(o_custkey % 9 as string), ' (a, B) select p, q from v', cast(o_custkey % 3 as string)) when 2 then concat('update t', cast(o_custkey % 9 as string), ' set a = 1, c = ${{z}} where id in (select id from w)') else concat('<if>delete from</if> t', cast(o_custkey % 9 as string), ' where id = 1') end q from {orders}"""


@query(
    "D12_statement_lineage",
    """select o_orderkey, case o_orderkey % 4 when 0 then 'SELECT' when 1 then 'INSERT' when 2 then 'UPDATE' else 'DELETE' end type, case o_orderkey % 4 when 0 then concat('t', o_custkey % 9, ',u', o_custkey % 5) when 1 then concat('v', o_custkey % 3) when 2 then 'w' else '' end reads,
    case when o_orderkey % 4 = 0 then '' else concat('t', o_custkey % 9) end writes, case when o_orderkey % 4 = 0 then concat('u', o_custkey % 5) else '' end joins, case o_orderkey % 4 when 1 then 'a,b' when 2 then 'a,c' else '' end "columns" from orders""",
)
def _(d):
    made = d.spark.sql(_SQLS, orders=d.orders)
    out = made.select("o_orderkey", D.statement_lineage(F.col("q")).alias("l")).select("o_orderkey", "l.*")
    return out.select("o_orderkey", "type", *[F.array_join(c, ",").alias(c) for c in ("reads", "writes", "joins", "columns")])


@query("D13_mapper_statements", "select concat('com.m', p_partkey, '.', s) id, s kind, case s when 'select' then concat('select id, p', p_partkey, ' from t') else concat('update t set x = ', p_size) end \"sql\" from part, (values ('select'), ('update')) v(s)")
def _(d):
    k = F.col("p_partkey").cast("string")
    xml = F.concat(
        F.lit('<mapper namespace="com.m'), k, F.lit('">\n<sql id="cols">id, p'), k, F.lit('</sql>\n<select id="select" resultType="x">\n select <include refid="cols"/>\n from t</select>\n<update id="update">update t set x = '), F.col("p_size").cast("string"), F.lit("</update></mapper>")
    )
    return D.mapper_statements(d.part.select(xml.alias("xml")))


@query("D16_layout_confidence", "select l_orderkey, l_linenumber, l_partkey, least(greatest(l_discount * 10 * case when l_quantity > 0 then least(l_linenumber, l_quantity) / l_quantity else 0 end + case when l_returnflag = 'R' then 0.1 else 0 end, 0), 1) confidence from lineitem")
def _(d):
    c = D.layout_confidence(F.col("l_discount") * 10, F.least(F.col("l_linenumber").cast("double"), "l_quantity"), F.col("l_quantity"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c.alias("confidence"))


@query("D17_parsers", "select page_id, case when page_id % 7 = 0 then 'stream' when page_id % 5 = 0 then 'pdf' when page_id % 5 = 1 then 'office' when page_id % 5 = 2 then 'ocr' when page_id % 5 = 3 then 'markup' else 'text' end parser from pages")
def _(d):
    mime = F.element_at(F.lit(["application/PDF", "application/msword", "image/png", "text/html", "text/plain"]), (F.col("page_id") % 5 + 1).cast("int"))
    return d.pages.select("page_id", D.parser_for(mime, F.when(F.col("page_id") % 7 == 0, 60_000_000).otherwise(10)).alias("parser"))
