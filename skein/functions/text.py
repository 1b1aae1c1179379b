"""Scalar functions on names, keys, paths and texts, as expressions of built-in functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say what layer a class belongs to.
LAYERS = "controller|service|mapper|dao|impl|entity|dto|vo"
#: What personal and secret data look like, in the order they are masked.
SECRETS = (
    ("api_key", r"(?i)(sk-[a-zA-Z0-9]{36,}|[a-z0-9]{32,}\.[a-z0-9]{32,}\.[a-z0-9]{32,})"),
    ("connection", r"(jdbc:.*://[^\s]+|postgres://[^\s]+|mysql://[^\s]+)"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
PASSWORD = r"""(?i)(password|passwd|pwd|secret|token|key)(\s*)([=:])\s*['"]?[^\s'"]{4,}['"]?"""
#: Words that carry no meaning of their own.
STOP_WORDS = ("the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "to", "and", "or", "for", "with", "by", "this", "that", "it")


def before_last(text: Column, mark: str) -> Column:
    """What stands before the last `mark`; null where there is none."""
    n = F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.lit(1), n))


def package_of(name: Column) -> Column:
    """The package of a qualified name; null for a bare name or a path."""
    return F.when(~name.contains("/") & ~name.contains("\\"), before_last(name, "."))


def simple_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "#", 1), ".", -1)


def entity_name(class_name: Column) -> Column:
    """A class's name without what says its layer."""
    return F.regexp_replace(class_name, r"(?i)(ServiceImpl|Controller|Service|Mapper|Repository|Entity|Impl)$", "")


def plain_path(path: Column) -> Column:
    """A URL path without query and fragment, its variables written {id}."""
    cut = F.regexp_replace(F.trim(path), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(cut, r"/(:[^/]+|\$\{[^/}]+\})", "/{id}"), r"\{[^/}]+\}", "{id}")


def api_key(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", F.upper(method), plain_path(path))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def capitalised(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def short_key(*parts: Column) -> Column:
    """First eight hex digits of the SHA-256 of the parts, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 8)


def operation(name: Column) -> Column:
    """(method, path) of an operation name such as 'GET /x'; the method is null where there is none."""
    parts = F.split(F.trim(name), r"\s+", 2)
    return F.struct(F.when(F.size(parts) == 2, F.upper(parts[0])).alias("method"), F.when(F.size(parts) == 2, F.get(parts, 1)).otherwise(parts[0]).alias("path"))


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS, least: int = 2) -> Column:
    """Distinct lower-case words of at least `least` letters or digits, without stop words, in order of occurrence."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_except(F.array_distinct(words), F.lit(list(stop_words)))


def sentences(text: Column) -> Column:
    """Sentences of more than two characters, trimmed."""
    return F.filter(F.transform(F.split(text, "[。？！.?!;；\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 2)


def ratio(part: Column, whole: Column, scale: int = 4) -> Column:
    """part / whole, half up; 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, scale))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def spelled_duration(seconds: Column) -> Column:
    """Whole seconds as 1h2m3s, without leading zero parts."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    text = lambda x, u: F.concat(x.cast("long").cast("string"), F.lit(u))
    return F.concat(F.when(h > 0, text(h, "h")).otherwise(""), F.when((h > 0) | (m > 0), text(m, "m")).otherwise(""), text(s, "s"))


def merged_lists(a: Column, b: Column) -> Column:
    """Union of two JSON arrays of strings, in order, as JSON; null and malformed ones count as empty."""
    read = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.array_distinct(F.concat(read(a), read(b))))


#: What in a column's name or comment tells its kind, in order of precedence; the comment's words after the bar.
STATUS_WORDS, STATUS_COMMENTS = ("status", "state"), ("状态", "enum", "字典")
TYPE_WORDS, TYPE_COMMENTS = ("type", "category"), ("类型", "category")
DELETED_WORDS = ("delete", "del_flag", "is_deleted")
AUDIT_WORDS, AUDIT_ENDINGS = ("create", "update"), ("_at", "_time")
#: Parts of names of columns that hold personal or secret data, and kinds that say so.
SENSITIVE_WORDS = ("password", "passwd", "pwd", "secret", "token", "credential", "private_key", "privatekey", "身份证", "手机号", "phone", "mobile", "email", "mail", "id_card", "idcard", "bank_card", "bankcard", "salary", "wages")
SENSITIVE_KINDS = ("pii", "sensitive")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def column_kind(name: Column, comment: Column | None = None) -> Column:
    """What a column's name and comment say of it: id, status, type, deleted, audit or plain."""
    n, c = F.lower(name), F.lower(F.coalesce(comment if comment is not None else F.lit(""), F.lit("")))
    holds = lambda words, said=(): _any([*(n.contains(w) for w in words), *(c.contains(w) for w in said)])
    audit = _any([*(n.contains(w) for w in AUDIT_WORDS), *(n.endswith(w) for w in AUDIT_ENDINGS)])
    return (
        F.when(n.endswith("_id") | (n == "id"), "id").when(holds(STATUS_WORDS, STATUS_COMMENTS), "status").when(holds(TYPE_WORDS, TYPE_COMMENTS), "type")
        .when(holds(DELETED_WORDS), "deleted").when(audit, "audit").otherwise("plain")
    )


def is_sensitive(name: Column, kind: Column | None = None) -> Column:
    """Whether a column's name, or its kind, says that it holds personal or secret data."""
    found = _any([F.lower(name).contains(w) for w in SENSITIVE_WORDS])
    return found if kind is None else found | F.coalesce(F.lower(kind).isin(*SENSITIVE_KINDS), F.lit(False))


def node_type_of(class_name: Column) -> Column:
    """Node type by the ending of a class's name."""
    return (
        F.when(class_name.rlike("Controller$"), "Controller").when(class_name.rlike("(Service|ServiceImpl)$"), "Service")
        .when(class_name.rlike("(Mapper|Repository|Dao)$"), "Mapper").when(class_name.rlike("(Entity|DTO|VO)$"), "BusinessObject").otherwise("Class")
    )


def labelled(value: Column, labels: Mapping[str, str]) -> Column:
    """A value's label, or the value where the dictionary has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), value), value)


def masked(text: Column) -> Column:
    """Text whose keys, connection strings, passwords, addresses and numbers are masked; a password's name stays."""
    for kind, pattern in SECRETS[:2]:
        text = F.regexp_replace(text, pattern, f"[MASKED_{kind.upper()}]")
    text = F.regexp_replace(text, PASSWORD, "$1$2$3 [MASKED]")
    for kind, pattern in SECRETS[2:]:
        text = F.regexp_replace(text, pattern, f"[MASKED_{kind.upper()}]")
    return text


def references(text: Column) -> Column:
    """Distinct explicit references in a text: dotted names, URL paths, file paths and what stands in backticks."""
    every = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    dotted = every(r"(?<![\w.])[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*){1,}(?![\w.])")
    return F.array_distinct(F.concat(dotted, every(r"(?<!\w)/[a-zA-Z][\w\-/]*"), every(r"(?:[\w\-/]+/)+[\w\-]+\.[a-zA-Z]{1,8}"), every("`([^`]+)`", 1)))


def claims_in(answer: Column, stop_words: Sequence[str]) -> Column:
    """What an answer claims to exist: file paths and capitalised identifiers, without stop words."""
    found = lambda p: F.regexp_extract_all(answer, F.lit(p), F.lit(0))
    return F.array_except(F.array_distinct(F.concat(found(r"[\w\-/]+\.[a-z]{1,5}\b"), found(r"\b[A-Z][a-zA-Z0-9]{2,}\b"))), F.lit(list(stop_words)))


# names of classes and features


def blocking_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), LAYERS, "")


def bigrams(text: Column) -> Column:
    """Neighbouring pairs of characters in order; none for fewer than two."""
    at = F.when(F.length(text) >= 2, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(text, i, 2))


def split_words(name: Column) -> Column:
    """Distinct lower-case words of a camel-case or separated name, of two letters or more, plural endings dropped."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    one = lambda w: (
        F.when(F.length(w) < 4, w).when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("[sx]es$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)
    )
    return F.array_sort(F.array_distinct(F.transform(words, one)))


def feature_key(name: Column) -> Column:
    """A feature's key: lower-case words joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2")), "[^a-z0-9]+", "-"), F.lit("-"))


def without_suffix(name: Column, suffixes: Sequence[str]) -> Column:
    """A name without its longest matching ending; names that would vanish stay."""
    ends = "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))
    return F.regexp_replace(name, f"(?<=.)({ends})$", "")
