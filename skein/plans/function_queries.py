"""Queries of skein.functions.text."""

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators.retrieval import cosine, dot
from skein.plans.registry import query

_FQN = "concat(package, '.', class_name)"


@query(
    "X1_conditionals",
    """select id, coalesce(nullif(evidence_ids, ''), 'none') evidence, case when confidence is null then 'unknown' when confidence >= 0.8 then 'high' else 'low' end grade, status in ('CONFIRMED', 'APPROVED') confirmed,
    source_type like 'DOC%' from_doc, contains(source_type, 'AI') by_ai from nodes""",
    "nodes",
)
def _(d):
    c = F.col
    grade = F.when(c("confidence").isNull(), "unknown").when(c("confidence") >= 0.8, "high").otherwise("low")
    return d.nodes.select("id", F.coalesce(F.nullif("evidence_ids", F.lit("")), F.lit("none")).alias("evidence"), grade.alias("grade"), c("status").isin("CONFIRMED", "APPROVED").alias("confirmed"), c("source_type").startswith("DOC").alias("from_doc"), c("source_type").contains("AI").alias("by_ai"))


@query("X2_substring_and_date", "select event_id, left(props, 4) head, cast(user_id as varchar) user_text, cast(ts as date) \"day\" from events")
def _(d):
    return d.events.select("event_id", F.substring("props", 1, 4).alias("head"), F.col("user_id").cast("string").alias("user_text"), F.to_date("ts").alias("day"))


@query("X3_lists", "select src, len(list(dst)) n, len(list_filter(list(edge_type), lambda t: t = 'CALLS')) calls from edges group by src", "edges")
def _(d):
    g = d.edges.groupBy("src").agg(F.collect_list("dst").alias("d"), F.collect_list("edge_type").alias("t"))
    return g.select("src", F.size("d").cast("long").alias("n"), F.size(F.filter("t", lambda t: t == "CALLS")).cast("long").alias("calls"))


@query("X4_strings", "select id, lower(trim(node_name)) low, trim(coalesce(node_name, '')) = '' is_blank, contains(node_key, '#') keyed, length(node_key) - strpos(reverse(node_key), '.') last_dot from nodes", "nodes")
def _(d):
    last = F.length("node_key") - F.instr(F.reverse("node_key"), ".")
    return d.nodes.select("id", F.lower(F.trim("node_name")).alias("low"), (F.trim(F.coalesce("node_name", F.lit(""))) == "").alias("is_blank"), F.col("node_key").contains("#").alias("keyed"), last.cast("long").alias("last_dot"))


@query("X5_packages", f"select id, package from classes union all select id, case when contains(source_path, '/') then null else source_path end from nodes where node_type = 'Controller'", "classes nodes")
def _(d):
    named = d.classes.select("id", X.package_of(F.concat_ws(".", "package", "class_name")).alias("package"))
    return named.union(d.nodes.where("node_type = 'Controller'").select("id", X.package_of(F.col("source_path"))))


@query("X6_simple_names", "select id, class_name simple, regexp_replace(class_name, '(ServiceImpl|Controller|Service|Mapper|Repository|Entity|Impl)$', '') entity from classes", "classes")
def _(d):
    return d.classes.select("id", X.simple_name(F.concat(F.col("package"), F.lit("."), F.col("class_name"), F.lit("#m(int)"))).alias("simple"), X.entity_name(F.col("class_name")).alias("entity"))


@query("X7_plain_paths", "select page_id, concat('GET ', regexp_replace(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/(:[^/]+|\\$\\{[^/}]+\\})', '/{id}', 'g'), '\\{[^/}]+\\}', '{id}', 'g')) \"key\" from (select page_id, concat(url, '/{x}/:y') url from pages) p".replace("concat(url, '/{x}/:y')", "concat(regexp_replace(url, '[?#].*$', ''), '/{x}/:y/${z}?q=1')"))
def _(d):
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/{x}/:y/${z}?q=1"))
    return d.pages.select("page_id", X.api_key(F.lit("get"), url).alias("key"))


@query("X8_snake_case", "select id, lower(regexp_replace(class_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) snake, concat(upper(left(package, 1)), substring(package, 2)) capital from classes", "classes")
def _(d):
    return d.classes.select("id", X.snake_case(F.col("class_name")).alias("snake"), X.capitalised(F.col("package")).alias("capital"))


@query("X9_short_keys", "select id, left(sha256(concat(package, '|', class_name)), 8) \"key\" from classes", "classes")
def _(d):
    return d.classes.select("id", X.short_key(F.col("package"), F.col("class_name")).alias("key"))


@query("X10_normal_ids", "select id, lower(regexp_replace(id, '[^A-Za-z0-9]+', '-', 'g')) normal from nodes", "nodes")
def _(d):
    return d.nodes.select("id", F.lower(F.regexp_replace("id", "[^A-Za-z0-9]+", "-")).alias("normal"))


@query("X11_operations", "select id, 'GET' \"method\", concat('/c/', cast(k as varchar)) \"path\" from nodes where node_type = 'ApiEndpoint'", "nodes")
def _(d):
    o = X.operation(F.concat(F.lit("  get "), F.regexp_replace("node_name", "^GET ", "")))
    return d.nodes.where("node_type = 'ApiEndpoint'").select("id", o["method"].alias("method"), o["path"].alias("path"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query("X12_tokens", f"select conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda w: length(w) >= 2 and not list_contains({_STOP}, w))), ' ') tokens from conversations where text is not null")
def _(d):
    return d.conversations.where("text is not null").select("conv_id", "turn", F.array_join(F.array_sort(X.tokens(F.col("text"))), " ").alias("tokens"))


@query("X13_sentences", "select doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[。？！.?!;；\n]+'), lambda s: trim(s)), lambda s: length(s) > 2)) n from documents where text is not null")
def _(d):
    return d.documents.where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("X14_ratios", "select node_type, case when count(*) = 0 then 0 else round(cast(count(*) filter (where status = 'CONFIRMED') as double) / count(*), 4) end share from nodes group by node_type", "nodes")
def _(d):
    return d.nodes.groupBy("node_type").agg(X.ratio(F.count_if(F.col("status") == "CONFIRMED"), F.count("*")).alias("share"))


@query("X15_math", "select s_suppkey, least(greatest(s_acctbal / 5000, 0), 1) clamped, ln(1 + abs(s_acctbal)) log_e, log2(1 + abs(s_acctbal)) log_two, pow(s_acctbal / 1000, 2) squared, sqrt(abs(s_acctbal)) root from supplier")
def _(d):
    b = F.col("s_acctbal")
    return d.supplier.select("s_suppkey", X.clamped(b / 5000).alias("clamped"), F.log1p(F.abs(b)).alias("log_e"), F.log2(1 + F.abs(b)).alias("log_two"), F.pow(b / 1000, F.lit(2.0)).alias("squared"), F.sqrt(F.abs(b)).alias("root"))


@query("X16_durations", "select user_id, cast(epoch(max(ts)) as bigint) - cast(epoch(min(ts)) as bigint) \"seconds\" from (select user_id, date_trunc('second', ts) ts from events) e group by user_id")
def _(d):
    e = d.events.groupBy("user_id").agg(F.unix_timestamp(F.max("ts")).alias("b"), F.unix_timestamp(F.min("ts")).alias("a"))
    return e.select("user_id", (F.col("b") - F.col("a")).alias("seconds"))


@query("X16_spelled_durations", "select p_partkey, concat(case when p_partkey * 7 >= 3600 then concat(cast(p_partkey * 7 // 3600 as varchar), 'h') else '' end, case when p_partkey * 7 >= 60 then concat(cast(p_partkey * 7 % 3600 // 60 as varchar), 'm') else '' end, cast(p_partkey * 7 % 60 as varchar), 's') spelled from part")
def _(d):
    return d.part.select("p_partkey", X.spelled_duration(F.col("p_partkey") * 7).alias("spelled"))


@query("X17_json", "select event_id, cast(json_extract(props, '$.k') as bigint) k, concat('[\"a\",\"', event_type, '\",\"b\"]') merged from events")
def _(d):
    both = X.merged_lists(F.concat(F.lit('["a","'), F.col("event_type"), F.lit('"]')), F.concat(F.lit('["b","a","'), F.col("event_type"), F.lit('"]')))
    return d.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), both.alias("merged"))


@query("X18_regex", "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) \"host\", regexp_replace(url, '[0-9]+', '#', 'g') shape, regexp_matches(url, '\\.html$') is_html from pages")
def _(d):
    return d.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace("url", "[0-9]+", "#").alias("shape"), F.col("url").rlike(r"\.html$").alias("is_html"))


@query("X19_grouped_concat", "select l_orderkey, string_agg(cast(l_partkey as varchar), ';' order by l_linenumber, l_partkey) parts from lineitem group by l_orderkey")
def _(d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))  # an order's lines, a few
    return d.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_partkey"].cast("string")), ";").alias("parts"))


_COLS = "select concat(case p_size % 7 when 0 then 'user_id' when 1 then 'order_status' when 2 then 'pay_type' when 3 then 'is_deleted' when 4 then 'created_at' when 5 then 'phone_no' else 'remark' end, case when p_partkey % 9 = 0 then '_x' else '' end) c, p_partkey id from {part}"


@query(
    "X20_column_kinds",
    f"""select id, case when regexp_matches(c, '_id$|^id$') then 'id' when regexp_matches(c, 'status|state') then 'status' when regexp_matches(c, 'type|category') then 'type' when regexp_matches(c, 'delete|del_flag|is_deleted') then 'deleted'
    when regexp_matches(c, 'create|update|_at$|_time$') then 'audit' else 'plain' end kind from ({_COLS.format(part="part")}) x""",
)
def _(d):
    return d.spark.sql(_COLS, part=d.part).select("id", X.column_kind(F.col("c")).alias("kind"))


@query("X21_sensitive_columns", f"select id from ({_COLS.format(part='part')}) x where regexp_matches(c, 'password|passwd|pwd|secret|token|credential|private_key|privatekey|phone|mobile|email|mail|id_card|idcard|bank_card|bankcard|salary|wages')")
def _(d):
    return d.spark.sql(_COLS, part=d.part).where(X.is_sensitive(F.col("c"))).select("id")


@query("X22_node_types", "select id, case when node_type = 'Entity' then 'BusinessObject' else node_type end inferred from classes", "classes")
def _(d):
    return d.classes.select("id", X.node_type_of(F.col("class_name")).alias("inferred"))


@query("X23_labels", "select id, case status when 'CONFIRMED' then 'Confirmed' when 'PENDING' then 'Waiting' else status end label from edges", "edges")
def _(d):
    return d.edges.select("id", X.labelled(F.col("status"), {"CONFIRMED": "Confirmed", "PENDING": "Waiting"}).alias("label"))


@query(
    "X24_vector_math",
    "select a.vec_id, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) dot, sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))) norm, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def _(d):
    b = d.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    e, o = F.col("embedding"), F.col("other")
    return d.embeddings.join(b, "vec_id").select("vec_id", dot(e, o).alias("dot"), F.sqrt(dot(e, e)).alias("norm"), cosine(e, o).alias("cosine"))


_MASK = [
    (r"(?i)(sk-[a-zA-Z0-9]{36,}|[a-z0-9]{32,}\.[a-z0-9]{32,}\.[a-z0-9]{32,})", "[MASKED_API_KEY]"),
    (r"(jdbc:.*://[^\s]+|postgres://[^\s]+|mysql://[^\s]+)", "[MASKED_CONNECTION]"),
    (r"""(?i)(password|passwd|pwd|secret|token|key)(\s*)([=:])\s*['"]?[^\s'"]{4,}['"]?""", r"\1\2\3 [MASKED]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[MASKED_EMAIL]"),
    (r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "[MASKED_PHONE]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[MASKED_IP]"),
]


def _masking(column: str) -> str:
    for pattern, put in _MASK:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return column


@query("D9_masked_texts", f"select doc_id, sha256({_masking('text')}) masked from documents where text is not null")
def _(d):
    return d.documents.where("text is not null").select("doc_id", F.sha2(X.masked(F.col("text")).cast("binary"), 256).alias("masked"))


@query(
    "D10_redacted_provenance",
    "select id, role, case role when 'admin' then source_path when 'analyst' then regexp_extract(source_path, '[^/]+$') else '[redacted]' end \"path\", case when role = 'guest' then null else evidence_ids end evidence from nodes, (values ('admin'), ('analyst'), ('guest')) r(role) where node_type = 'Service'",
    "nodes",
)
def _(d):
    role = F.explode(F.array(*map(F.lit, ("admin", "analyst", "guest"))))
    n = d.nodes.where("node_type = 'Service'").withColumn("role", role)
    path = F.when(F.col("role") == "admin", F.col("source_path")).when(F.col("role") == "analyst", F.substring_index("source_path", "/", -1)).otherwise("[redacted]")
    return n.select("id", "role", path.alias("path"), F.when(F.col("role") != "guest", F.col("evidence_ids")).alias("evidence"))


@query("D11_evidence_hashes", "select sha256(concat(source, '|', left(text, 80))) hash, min(doc_id) first_doc, count(*) n from documents where text is not null group by 1")
def _(d):
    h = F.sha2(F.concat_ws("|", "source", F.substring("text", 1, 80)).cast("binary"), 256)
    return d.documents.where("text is not null").groupBy(h.alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("D14_references", None)
def _(d):
    made = F.concat_ws(" ", F.col("text"), F.concat(F.lit("see `"), F.col("source"), F.lit("` in src/main/App.java, com.example.Order and GET /api/v1/orders")))
    return d.documents.select("doc_id", F.array_join(X.references(made), " ").alias("refs"))


#: Capitalised words that name nothing in particular.
COMMON = ["The", "This", "That", "These", "Those", "What", "When", "Where", "Why", "How", "Which", "Who", "There", "Here", "Service", "Controller", "Mapper", "Table", "Entity", "Result", "List", "Map", "Set", "JSON", "HTTP", "POST", "GET", "PUT", "DELETE", "API"]


@query(
    "D15_answer_claims",
    f"""select conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(answer, '[\\w\\-/]+\\.[a-z]{{1,5}}\\b'), regexp_extract_all(answer, '\\b[A-Z][a-zA-Z0-9]{{2,}}\\b'))), lambda c: not list_contains([{", ".join(f"'{w}'" for w in COMMON)}], c))), ' ') claims
    from (select conv_id, turn, concat('In src/app/Order.java the OrderService reads ', regexp_replace(question, '[^ -~]', '?', 'g')) answer from qa where question is not null) x""",
    "qa",
)
def _(d):
    answer = F.concat(F.lit("In src/app/Order.java the OrderService reads "), F.regexp_replace("question", "[^ -~]", "?"))
    return d.qa.where("question is not null").select("conv_id", "turn", F.array_join(F.array_sort(X.claims_in(answer, COMMON)), " ").alias("claims"))


# names of classes and features


@query("E2_blocking_names", "select distinct class_name, regexp_replace(regexp_replace(lower(class_name), '[^a-z0-9]', '', 'g'), 'controller|service|mapper|dao|impl|entity|dto|vo', '', 'g') normal from classes", "classes")
def _(d):
    return d.classes.select("class_name", X.blocking_name(F.col("class_name")).alias("normal")).distinct()


@query("E3_bigrams", "select b bigram, count(*) n from (select unnest(list_transform(range(1, length(class_name)), lambda i: substring(class_name, i, 2))) b from classes) x group by b", "classes")
def _(d):
    return d.classes.select(F.explode(X.bigrams(F.col("class_name"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query(
    "E20_name_tokens",
    """with w as (select id, unnest(regexp_split_to_array(lower(regexp_replace(concat(class_name, ' Policies boxes ', package), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) t from classes),
    s as (select distinct id, case when length(t) < 4 then t when t like '%ies' then concat(left(t, length(t) - 3), 'y') when t like '%ses' or t like '%xes' then left(t, length(t) - 2) when t like '%s' and t not like '%ss' then left(t, length(t) - 1) else t end t from w where length(t) >= 2) select id, string_agg(t, ' ' order by t) tokens from s group by id""",
    "classes",
)
def _(d):
    return d.classes.select("id", F.array_join(X.split_words(F.concat("class_name", F.lit(" Policies boxes "), "package")), " ").alias("tokens"))


@query("E23_stripped_suffixes", "select distinct class_name, regexp_replace(class_name, '(ServiceImpl|Controller|Service|Mapper|Entity)$', '') core from classes", "classes")
def _(d):
    return d.classes.select("class_name", X.without_suffix(F.col("class_name"), ["Service", "ServiceImpl", "Controller", "Mapper", "Entity"]).alias("core")).distinct()


@query("E24_feature_keys", "select id, trim(regexp_replace(lower(regexp_replace(concat(class_name, ' (', package, ')'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '-') \"key\" from classes", "classes")
def _(d):
    return d.classes.select("id", X.feature_key(F.concat("class_name", F.lit(" ("), "package", F.lit(")"))).alias("key"))


@query("T11_process_keys", "select distinct user_id, concat('proc', cast(user_id % 5 as varchar)) process from events")
def _(d):
    defined = F.concat(F.lit("proc"), (F.col("user_id") % 5).cast("string"), F.lit(":3:"), F.col("event_id").cast("string"))
    return d.events.select("user_id", F.substring_index(defined, ":", 1).alias("process")).distinct()
