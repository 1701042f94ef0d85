"""Functions of one string: statements, routes, topics, names, packages. Columns in, columns out."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed values.
#: Leading path segments that name no entity, and those that end the search.
TRANSPARENT = ["api", "internal", "public", "external"]
INFRASTRUCTURE = [
    "auth", "login", "logout", "health", "healthz", "livez", "readyz", "metrics", "ping", "status", "swagger", "docs", "debug",
]
ACRONYMS = ["id", "url", "api", "sql", "db", "http", "json", "jwt", "otp", "grpc"]
LAYER = r"^(use ?cases?|uc|handlers?|services?|svc|repositor(y|ies)|repo|impl|delivery|controllers?|servers?|v\d+|http|grpc|api)\z"
QUERY_BYTES, EXPRESSION_BYTES, COLLAPSED_NAMES = 4000, 60, 24

_IDENT = r"^[0-9A-Za-z_]+\z"


def _ident(x: Column) -> Column:
    return x.rlike(_IDENT)


# ---------------------------------------------------------------- statements


def sql_access(detail: Column) -> Column:
    """(verb, table) of a statement; both empty where it is none, table empty where it has no plain name."""
    s = F.trim(F.regexp_replace(detail, r"^\s+|\s+$", ""))
    verb = F.upper(F.regexp_extract(s, r"(?i)^(select|with|insert|update|delete)", 1))
    name = r"""([\w."'`]+)"""
    target = (
        F.when(verb.isin("SELECT", "WITH", "DELETE"), F.regexp_extract(s, rf"(?i)\bFROM\s+{name}", 1))
        .when(verb == "INSERT", F.regexp_extract(s, rf"(?i)\bINTO\s+{name}", 1))
        .when(verb == "UPDATE", F.regexp_extract(s, rf"(?i)^UPDATE\s+{name}", 1))
        .otherwise("")
    )
    bare = F.regexp_extract(F.regexp_replace(target, "^[\"'`]+|[\"'`]+$", ""), r"([^.]*)$", 1)
    words = {"SELECT": "reads", "WITH": "reads", "INSERT": "creates", "UPDATE": "updates", "DELETE": "deletes"}
    said = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), verb), F.lit(""))
    return F.struct(said.alias("verb"), F.when(_ident(bare), F.lower(bare)).otherwise("").alias("table"))


def compact_query(sql: Column) -> Column:
    """White space squeezed; at most QUERY_BYTES bytes, the last three of a longer text being dots.

    A character is never cut: one that would cross the limit goes whole.
    """
    text = F.trim(F.regexp_replace(sql, r"\s+", " "))
    return F.when(F.octet_length(text) <= QUERY_BYTES, text).otherwise(F.concat(_bytes_of(text, QUERY_BYTES - 3), F.lit("...")))


def _bytes_of(text: Column, n: int) -> Column:
    """The longest beginning of whole characters within n bytes."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.substr(text, F.lit(1), F.length(F.regexp_replace(cut, "�+$", "")))


def topic_expression(text: Column) -> Column:
    """A source text as a hint, at most EXPRESSION_BYTES bytes."""
    return F.when(F.octet_length(text) <= EXPRESSION_BYTES, text).otherwise(F.concat(_bytes_of(text, EXPRESSION_BYTES - 3), F.lit("...")))


# ---------------------------------------------------------------- entities


def path_entity(path: Column) -> Column:
    """The first noun of a URL path in lower case, empty where that is no evidence."""
    known = F.array(*map(F.lit, TRANSPARENT))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~F.lower(x).rlike(r"^v[0-9]+\z") & ~F.array_contains(known, F.lower(x)))
    first = F.coalesce(F.get(segments, F.lit(0)), F.lit(""))
    return F.when(F.lower(first).isin(INFRASTRUCTURE) | ~_ident(first), "").otherwise(F.lower(first))


def topic_prefix(topic: Column) -> Column:
    """The first part of a topic of two or more, in lower case."""
    parts = F.filter(F.split(topic, "[._-]"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    return F.when((F.size(parts) >= 2) & _ident(first), F.lower(first)).otherwise("")


def singular(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when((n > 3) & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & word.rlike("(ses|xes|zes|ches|shes)$"), F.substr(word, F.lit(1), n - 2))
        .when((n > 1) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), F.substr(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def entity_key(raw: Column) -> Column:
    """Lower case with the last part singular."""
    low = F.lower(raw)
    head = F.regexp_extract(low, r"(?s)^(.*_)", 1)
    return F.concat(head, singular(F.substr(low, F.length(head) + 1)))


def humanize(key: Column) -> Column:
    words = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def split_identifier(word: Column) -> Column:
    spaced = F.regexp_replace(F.replace(word, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])", "$1$3 $2$4")
    return F.filter(F.split(spaced, r"\s+"), lambda x: x != "")


def flow_title(function: Column, module_root: Column) -> Column:
    """A handler's name in words; a single word borrows its receiver or package, unless that is a layer or the module."""
    method = function.rlike(r"^\(\*?.+\)\.\w+\z")
    last = F.regexp_extract(function, r"([^/]*)\z", 1)
    receiver = F.regexp_extract(F.regexp_extract(function, r"^\(\*?(.+)\)\.\w+\z", 1), r"([^/.]*)\z", 1)
    name = F.when(method, F.regexp_extract(function, r"\)\.(\w+)\z", 1)).otherwise(F.regexp_extract(last, r"([^.]*)\z", 1))
    qualifier = F.when(method, receiver).otherwise(F.regexp_extract(last, r"^(.*)\.[^.]*\z", 1))
    words = split_identifier(name)
    q = F.lower(F.array_join(split_identifier(qualifier), " "))
    borrow = (F.size(words) == 1) & (q != "") & (q != F.lower(F.get(words, F.lit(0)))) & (q != F.lower(module_root)) & ~q.rlike(LAYER)
    words = F.when(borrow, F.concat(words, F.array(q))).otherwise(words)
    told = F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(ACRONYMS), F.upper(w)).otherwise(F.lower(w))), " ")
    return F.when(told == "", function).otherwise(F.concat(F.upper(F.substring(told, 1, 1)), F.substr(told, F.lit(2))))


def access_rank(access: Column) -> Column:
    """The place of an access kind in lists."""
    return (
        F.when(access == "creates", 0).when(access == "reads", 1).when(access == "updates", 2)
        .when(access == "deletes", 3).when(access.startswith("publishes"), 4).otherwise(5)
    )


def sort_access(accesses: Column) -> Column:
    ranked = F.array_sort(F.transform(F.array_distinct(accesses), lambda a: F.struct(access_rank(a).alias("r"), a.alias("a"))))
    return F.transform(ranked, lambda x: x["a"])


# ---------------------------------------------------------------- routes and ids


def normalize_route(path: Column) -> Column:
    """Colon and star segments in braces; for routers that write parameters so."""

    def one(s: Column) -> Column:
        return (
            F.when(s.startswith(":"), F.concat(F.lit("{"), F.substr(s, F.lit(2)), F.lit("}")))
            .when(s.startswith("*") | s.startswith("+"), F.concat(F.lit("{"), s, F.lit("}")))
            .otherwise(s)
        )

    return F.array_join(F.transform(F.split(path, "/", -1), one), "/")


def normalize_id(flow_id: Column) -> Column:
    """An id as a user may type it, with its route normalized; the counter behind # stays."""
    parts = r"(?s)^(http:[^:]*:)(.*?)(#[^#]*)?\z"
    found = F.concat(F.regexp_extract(flow_id, parts, 1), normalize_route(F.regexp_extract(flow_id, parts, 2)), F.regexp_extract(flow_id, parts, 3))
    return F.when(flow_id.rlike(r"^http:[^:]*:"), found).otherwise(flow_id)


def entrypoint_id(kind: Column, method: Column, path: Column, topic: Column, name: Column, module: Column) -> Column:
    """The id of an entrypoint before collisions are counted."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when((kind == "http") & (some(path) != ""), F.concat(F.lit("http:"), F.coalesce(F.nullif(method, F.lit("")), F.lit("ANY")), F.lit(":"), path))
        .when((kind == "grpc") & (some(path) != ""), F.concat(F.lit("grpc:"), path))
        .when(kind == "kafka", F.concat(F.lit("kafka:"), F.coalesce(F.nullif(topic, F.lit("")), F.lit("?")), F.lit(":"), trim_module(name, module)))
        .otherwise(F.concat(F.lit("func:"), name))
    )


def file_name(flow_id: Column) -> Column:
    return F.regexp_replace(flow_id, r"[^A-Za-z0-9._-]", "-")


# ---------------------------------------------------------------- packages and names


def strip_version(package: Column) -> Column:
    return F.regexp_replace(package, r"/v[0-9]+\z", "")


def trim_module(name: Column, module: Column) -> Column:
    return F.replace(name, F.concat(module, F.lit("/")), F.lit(""))


def base_name(package: Column) -> Column:
    """The last segment of a package path."""
    return F.regexp_extract(package, r"([^/]*)/*\z", 1)


def is_standard(package: Column) -> Column:
    """Of the standard library: the first segment has no dot."""
    return (package != "") & ~F.regexp_extract(package, r"^([^/]*)", 1).contains(".")


def in_module(package: Column, module: Column) -> Column:
    return (module != "") & ((package == module) | package.startswith(F.concat(module, F.lit("/"))))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: a star stops at a slash, but a last one, if the only special sign, does not."""
    if pattern.endswith("*") and not re.search(r"[*?\[]", pattern[:-1]):
        return f"(?s)^{re.escape(pattern[:-1])}.*\\z"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            out += pattern[i : end + 1]
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out}|{re.escape(pattern)})\\z"


def glob(text: Column, pattern: str) -> Column:
    return F.lit(True) if pattern == "*" else text.rlike(glob_regex(pattern))


def package_matches(package: Column, pattern: str, module: Column) -> Column:
    """A package pattern; std: keeps to the standard library, dep: to what is neither that nor the module."""
    scope, _, rest = pattern.partition(":")
    if scope == "std":
        return is_standard(package) & glob(package, rest)
    if scope == "dep":
        return (package != "") & ~is_standard(package) & ~in_module(package, module) & glob(package, rest)
    return glob(package, pattern)


def collapsed_name(package: Column, short_name: Column) -> Column:
    return F.concat(base_name(package), F.lit("."), short_name)


def collapsed_list(names: Column, most: int = COLLAPSED_NAMES) -> Column:
    """Sorted and distinct, with a count in place of what is beyond ``most``."""
    unique = F.array_sort(F.array_distinct(names))
    more = F.concat(F.lit("... (+"), (F.size(unique) - most).cast("string"), F.lit(" more)"))
    return F.when(F.size(unique) > most, F.concat(F.slice(unique, 1, most), F.array(more))).otherwise(unique)


def function_base_name(short_name: Column, name: Column) -> Column:
    """The short name; of a made-up node the text after the last dot."""
    return F.coalesce(short_name, F.regexp_extract(name, r"([^.]*)\z", 1))


def position(file: Column, line: Column) -> Column:
    return F.when(file.isNull(), "").otherwise(F.concat_ws(":", file, line))


def camel_words(name: Column) -> Column:
    """MinLength to min length."""
    return F.lower(F.concat(F.substring(name, 1, 1), F.regexp_replace(F.substr(name, F.lit(2)), "([A-Z])", " $1")))


def file_class(path: Column, header: Column) -> Column:
    """vendor, generated or normal."""
    made = path.rlike(r"(_gen\.go|\.pb\.go)\z") | F.coalesce(header, F.lit("")).rlike(r"Code generated .* DO NOT EDIT")
    return F.when(F.concat(F.lit("/"), path).contains("/vendor/"), "vendor").when(made, "generated").otherwise("normal")
