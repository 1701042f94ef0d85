"""Entrypoints of a program: call sites that register handlers or consume messages.

call_site columns used here: encl_fn, site, pos, callee_pkg, callee_type, callee_name, is_static, and the
resolved arguments: args, an array (receiver left out) of (text, fns, impl), with text the constant string,
texts the constant strings of a literal list, fns the functions of a literal list of handlers (or the one
function), fn the function itself, type_pkg and type_name the concrete type behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom import tables
from flowloom.functions.text import entrypoint_id, normalize_route, strip_version, trim_module

# Fixed values.
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "CONNECT", "TRACE"]
CHI, FIBER, GORILLA = "github.com/go-chi/chi", "github.com/gofiber/fiber", "github.com/gorilla/mux"
CHI_HOPS, GORILLA_HOPS, FORWARD_HOPS, FIBER_HOPS = 8, 24, 6, 8
#: Links of a route chain that change neither path nor methods.
GORILLA_PLAIN = [
    "Subrouter", "NewRoute", "Name", "Queries", "Host", "Schemes", "Headers", "HeadersRegexp", "MatcherFunc", "BuildVarsFunc",
    "StrictSlash", "SkipClean", "UseEncodedPath", "Handle", "HandleFunc", "Handler", "HandlerFunc",
]
SARAMA = ["github.com/IBM/sarama", "github.com/Shopify/sarama"]
HANDLER_PACKAGES = r"(^|/)(handlers?|controllers?|api|http|rest|server|transport|delivery)$"

ARG = "struct<text:string,texts:array<string>,fn:string,fns:array<string>,type_pkg:string,type_name:string>"


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _arg(n: int | Column) -> Column:
    return F.get("args", F.lit(n) if isinstance(n, int) else n)


def _row(kind: str, method: Column, path: Column, handler: Column, topic: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), method.alias("method"), path.alias("path"), (F.lit(None).cast("string") if topic is None else topic).alias("topic"), handler.alias("fn"))


def _verb_of(name: Column) -> Column:
    """Get, Post, ... as routers with capitalised methods write them."""
    return F.when(F.upper(name).isin(VERBS) & (name != F.upper(name)), F.upper(name))


def http_matches() -> Column:
    """The registration that a call site is, null if none, for the routers whose path needs no chain.

    Handlers that are values with ServeHTTP are resolved afterwards (fn null, see served_by).
    """
    pkg, bare, kind, name = _s("callee_pkg"), strip_version(_s("callee_pkg")), _s("callee_type"), _s("callee_name")
    text = lambda n: F.coalesce(_arg(n)["text"], F.lit(""))
    pattern = text(0)
    verb = F.regexp_extract(pattern, rf"^({'|'.join(VERBS)}) ", 1)
    stdlib = _row("http", verb, F.trim(F.when(verb != "", F.substr(pattern, F.length(verb) + 2)).otherwise(pattern)), _arg(1)["fn"])
    handle = name == "Handle"
    skip = F.when(handle, 1).otherwise(0)
    gin_method = F.when(name == "Any", "").when(handle, text(0)).otherwise(name)
    gin = _row("http", gin_method, normalize_route(F.coalesce(_arg(skip)["text"], F.lit(""))), F.try_element_at(_arg(skip + 1)["fns"], F.lit(-1)))
    echo = _row("http", F.when(name == "Any", "").otherwise(name), normalize_route(text(0)), _arg(1)["fn"])
    return (
        F.when((pkg == "net/http") & name.isin("Handle", "HandleFunc") & kind.isin("", "ServeMux") & (F.size("args") >= 2), stdlib)
        .when((pkg == "github.com/gin-gonic/gin") & kind.isin("Engine", "RouterGroup") & (name.isin(*VERBS, "Any") | handle) & (F.size("args") >= skip + 2), gin)
        .when((bare == "github.com/labstack/echo") & kind.isin("Echo", "Group") & name.isin(*VERBS, "Any") & (F.size("args") >= 2), echo)
    )


def consumer_matches() -> Column:
    """Consumers whose function is the entrypoint: readers and pollers; topic from reader_topic."""
    pkg, kind, name = _s("callee_pkg"), _s("callee_type"), _s("callee_name")
    reader = (pkg == "github.com/segmentio/kafka-go") & (kind == "Reader") & name.isin("ReadMessage", "FetchMessage")
    poller = pkg.startswith("github.com/confluentinc/confluent-kafka-go") & (kind == "Consumer") & name.isin("ReadMessage", "Poll")
    none = F.lit(None).cast("string")
    return F.when(reader, _row("kafka", none, none, F.col("encl_fn"), F.col("reader_topic"))).when(poller, _row("kafka", none, none, F.col("encl_fn")))


def group_prefixes(callbacks: DataFrame, hops: int) -> DataFrame:
    """fn_id and prefix: prefixes of the callbacks a function is nested in, outermost first.

    callbacks: fn_id (the callback), outer_fn (the function that registers it), prefix. A callback that is
    registered twice, or from nowhere, has no prefix.
    """
    once = callbacks.groupBy("fn_id").agg(F.count("*").alias("n"), F.first("outer_fn").alias("outer_fn"), F.first("prefix").alias("prefix")).where("n = 1").drop("n")
    once = tables.keep(once, "callbacks")
    now = once.select("fn_id", F.col("outer_fn").alias("at"), "prefix")
    upper = once.select(F.col("fn_id").alias("at"), F.col("outer_fn").alias("next"), F.col("prefix").alias("more"))
    for _ in range(hops - 1):
        now = tables.keep(now.join(upper, "at", "left").select("fn_id", F.col("next").alias("at"), F.concat(F.coalesce("more", F.lit("")), "prefix").alias("prefix")), "prefixes")
        if now.where("at is not null").isEmpty():
            break
    return now.select("fn_id", "prefix")


def chi_matches(sites: DataFrame, prefixes: DataFrame) -> DataFrame:
    """chi registrations; the prefix of the enclosing callbacks leads."""
    name = _s("callee_name")
    two = name.isin("Method", "MethodFunc")
    verb = _verb_of(name)
    skip = F.when(two, 1).otherwise(0)
    ours = (strip_version(_s("callee_pkg")) == CHI) & _s("callee_type").isin("Mux", "Router") & (verb.isNotNull() | two | name.isin("Handle", "HandleFunc")) & (F.size("args") >= skip + 2)
    rows = sites.where(ours).join(prefixes.withColumnRenamed("fn_id", "encl_fn"), "encl_fn", "left")
    method = F.coalesce(verb, F.when(two, _arg(0)["text"]), F.lit(""))
    path = F.concat(F.coalesce("prefix", F.lit("")), F.coalesce(_arg(skip)["text"], F.lit("")))
    served = _arg(skip + 1)
    return rows.select("site", _row("http", method, path, served["fn"]).alias("e"), served["type_pkg"].alias("type_pkg"), served["type_name"].alias("type_name"))


def fold_chain(links: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """For each start: path, methods and whether every link was understood, along its chain outward.

    links: at, next (null: the chain ends), kind (prefix, methods, plain, unknown), text; starts: site, at.
    Paths nearer the root lead; the innermost methods count.
    """
    now = tables.keep(starts.select("site", "at").withColumns({"path": F.lit(""), "methods": F.lit(None).cast("string"), "resolved": F.lit(True)}), "chain")
    done = None
    for _ in range(hops):
        step = now.join(links, "at", "left")
        step = step.select(
            "site",
            F.col("next").alias("at"),
            F.when(F.col("kind") == "prefix", F.concat(F.coalesce("text", F.lit("")), "path")).otherwise(F.col("path")).alias("path"),
            F.coalesce("methods", F.when(F.col("kind") == "methods", F.col("text"))).alias("methods"),
            (F.col("resolved") & ~F.coalesce((F.col("kind") == "unknown") | ((F.col("kind") == "prefix") & F.col("text").isNull()), F.lit(False))).alias("resolved"),
        )
        step = tables.keep(step, "chain")
        ended = step.where("at is null or not resolved").drop("at")
        done = ended if done is None else done.unionByName(ended)
        now = step.where("at is not null and resolved")
        if now.isEmpty():
            return done
    return done.unionByName(now.drop("at").withColumn("resolved", F.lit(False)))


def gorilla_links(calls: DataFrame, moves: DataFrame) -> DataFrame:
    """Links for :func:`fold_chain` of router and route values.

    calls: at (the call's value), next (its receiver), callee_pkg, callee_name, args; moves: at, next, for values that are
    another one (loads, conversions, parameters with one caller). A new router, and whatever is no call of the library, ends a chain.
    """
    name = _s("callee_name")
    kind = F.when(name.isin("Path", "PathPrefix"), "prefix").when(name == "Methods", "methods").when(name.isin(GORILLA_PLAIN), "plain").otherwise("unknown")
    text = F.when(kind == "prefix", _arg(0)["text"]).when(kind == "methods", F.nullif(F.array_join(_arg(0)["texts"], ","), F.lit("")))
    rows = calls.where((_s("callee_pkg") == GORILLA) & (name != "NewRouter")).select("at", "next", kind.alias("kind"), text.alias("text"))
    return rows.unionByName(moves.select("at", "next", F.lit("plain").alias("kind"), F.lit(None).cast("string").alias("text")))


def fiber_links(calls: DataFrame, moves: DataFrame, callbacks: DataFrame) -> DataFrame:
    """Links of router values: groups and routes give a prefix (nothing if it is not constant), other calls hand back their router.

    calls and moves as for :func:`gorilla_links`; callbacks: at (the router parameter of a callback), next (the receiver of
    the call that registers it), text (its prefix).
    """
    group = _s("callee_name").isin("Group", "Route")
    prefix = F.when(group, F.coalesce(_arg(0)["text"], F.lit("")))
    rows = calls.where(strip_version(_s("callee_pkg")) == FIBER).select("at", "next", F.when(group, "prefix").otherwise("plain").alias("kind"), prefix.alias("text"))
    rows = rows.unionByName(moves.select("at", "next", F.lit("plain").alias("kind"), F.lit(None).cast("string").alias("text")))
    return rows.unionByName(callbacks.select("at", "next", F.lit("prefix").alias("kind"), F.coalesce("text", F.lit("")).alias("text")))


def fiber_prefixes(links: DataFrame, starts: DataFrame) -> DataFrame:
    """site and the prefix of its receiver (starts: site, at): what its groups give, outermost first, within FIBER_HOPS links."""
    return fold_chain(links, starts, FIBER_HOPS).select("site", F.col("path").alias("prefix"))


def gorilla_matches(sites: DataFrame, chains: DataFrame, forward: DataFrame) -> DataFrame:
    """gorilla registrations; chains: as of fold_chain, forward: site and methods set after the handler."""
    name, kind = _s("callee_name"), _s("callee_type")
    router = (kind == "Router") & name.isin("Handle", "HandleFunc") & (F.size("args") >= 2)
    route = (kind == "Route") & name.isin("Handler", "HandlerFunc") & (F.size("args") >= 1)
    rows = sites.where((_s("callee_pkg") == GORILLA) & (router | route)).join(chains, "site", "left").join(forward.select("site", F.col("methods").alias("later")), "site", "left")
    served = _arg(F.when(router, 1).otherwise(0))
    own = F.when(router, _arg(0)["text"])
    methods = F.coalesce("later", "methods", F.lit(""))
    known = F.coalesce("resolved", F.lit(True))
    prefix = F.when(known, F.coalesce("path", F.lit(""))).otherwise("")
    path = F.when(router, F.coalesce(F.concat(prefix, own), F.lit(""))).otherwise(prefix)
    methods = F.when(router & own.isNull(), "").otherwise(methods)
    return rows.select("site", _row("http", methods, path, served["fn"]).alias("e"), served["type_pkg"].alias("type_pkg"), served["type_name"].alias("type_name"))


def fiber_matches(sites: DataFrame, prefixes: DataFrame) -> DataFrame:
    """fiber registrations; prefixes: site and the prefix of its receiver. From version 3 on the first handler is the endpoint."""
    name = _s("callee_name")
    verb = _verb_of(name)
    add = name == "Add"
    skip = F.when(add, 1).otherwise(0)
    ours = (strip_version(_s("callee_pkg")) == FIBER) & _s("callee_type").isin("App", "Group", "Router") & (verb.isNotNull() | add | (name == "All")) & (F.size("args") >= skip + 2)
    rows = sites.where(ours).join(prefixes, "site", "left")
    method = F.coalesce(verb, F.when(add, F.coalesce(_arg(0)["text"], F.array_join(_arg(0)["texts"], ","))), F.lit(""))
    path = F.coalesce(normalize_route(F.concat(F.coalesce("prefix", F.lit("")), _arg(skip)["text"])), F.lit(""))
    handlers = F.flatten(F.transform(F.slice("args", skip + 2, F.size("args")), lambda a: F.coalesce(a["fns"], F.when(a["fn"].isNotNull(), F.array(a["fn"])), F.array().cast("array<string>"))))
    major = F.coalesce(F.regexp_extract(_s("callee_pkg"), r"/v([0-9]+)\z", 1).try_cast("int"), F.lit(1))
    fn = F.when(major >= 3, F.get(handlers, F.lit(0))).otherwise(F.try_element_at(handlers, F.lit(-1)))
    return rows.select("site", _row("http", method, path, fn).alias("e"))


def grpc_matches(sites: DataFrame, interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """A row for each exported method of the service that a generated Register<Service>Server call gets.

    sites also has iface_pkg and iface_name, the type of the second parameter.
    """
    ours = F.col("is_static") & (_s("callee_type") == "") & _s("callee_name").rlike(r"^Register.*Server\z") & (F.size("args") == 2)
    rows = sites.where(ours).select("site", F.regexp_extract("callee_name", r"^Register(.*)Server\z", 1).alias("service"), "iface_pkg", "iface_name", _arg(1)["type_pkg"].alias("type_pkg"), _arg(1)["type_name"].alias("type_name"))
    rows = rows.join(interfaces.where("exported"), ["iface_pkg", "iface_name"]).join(methods, ["type_pkg", "type_name", "method"])
    return rows.select("site", _row("grpc", F.col("method"), F.concat_ws("/", "service", "method"), F.col("fn_id")).alias("e"))


def sarama_matches(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """Consumer groups: the handler's ConsumeClaim, topics joined by commas."""
    ours = _s("callee_pkg").isin(SARAMA) & (_s("callee_type") == "ConsumerGroup") & (_s("callee_name") == "Consume") & (F.size("args") >= 3)
    rows = sites.where(ours).select("site", F.array_join(_arg(1)["texts"], ",").alias("topic"), _arg(2)["type_pkg"].alias("type_pkg"), _arg(2)["type_name"].alias("type_name"))
    claim = methods.where("method = 'ConsumeClaim'").select("type_pkg", "type_name", "fn_id")
    none = F.lit(None).cast("string")
    return rows.join(claim, ["type_pkg", "type_name"]).select("site", _row("kafka", none, none, F.col("fn_id"), F.col("topic")).alias("e"))


def served_by(found: DataFrame, methods: DataFrame) -> DataFrame:
    """Registrations without a function get the ServeHTTP method of the value's type."""
    serve = methods.where("method = 'ServeHTTP'").select("type_pkg", "type_name", F.col("fn_id").alias("serve"))
    return found.join(serve, ["type_pkg", "type_name"], "left").select("site", F.col("e").withField("fn", F.coalesce("e.fn", "serve")).alias("e"))


def callers(calls: DataFrame) -> DataFrame:
    """callee and its call site, for functions called from exactly one."""
    return calls.groupBy("callee").agg(F.count("*").alias("n"), F.first("site").alias("site")).where("n = 1").drop("n")


def with_collision_numbers(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids that occur again get #2, #3, ... in order. Numbers are dealt within each id."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(id_col, F.when(F.col("_n") > 1, F.concat(id_col, F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(id_col))).drop("_n")


def discover(sites: DataFrame, functions: DataFrame, methods: DataFrame, interfaces: DataFrame, callbacks: DataFrame, chains: DataFrame, forward: DataFrame, fiber_prefixes: DataFrame, module: str) -> DataFrame:
    """All entrypoints: id, kind, method, path, topic, fn_id, pos, in order of id.

    functions: fn_id, display_name, pos, file_class, in_module, has_body. Only functions of normal files of the
    module register and handle.
    """
    own = functions.where("in_module and file_class = 'normal' and has_body")
    ours = tables.keep(sites.join(own.select(F.col("fn_id").alias("encl_fn")), "encl_fn", "left_semi"), "sites")
    plain = ours.withColumn("e", F.coalesce(http_matches(), consumer_matches())).where("e is not null")
    plain = plain.select("site", "e", _arg(1)["type_pkg"].alias("type_pkg"), _arg(1)["type_name"].alias("type_name"))
    http = plain.where("e.kind = 'http'").unionByName(chi_matches(ours, group_prefixes(callbacks, CHI_HOPS))).unionByName(gorilla_matches(ours, chains, forward))
    found = served_by(http, methods).unionByName(plain.where("e.kind != 'http'").select("site", "e"))
    for more in (fiber_matches(ours, fiber_prefixes), grpc_matches(ours, interfaces, methods), sarama_matches(ours, methods)):
        found = found.unionByName(more)
    rows = found.select("e.*").where("fn is not null").distinct().withColumnRenamed("fn", "fn_id").join(own.select("fn_id", "display_name", "pos"), "fn_id")
    named = rows.withColumn("id", entrypoint_id(F.col("kind"), F.col("method"), F.col("path"), F.col("topic"), F.col("display_name"), F.lit(module)))
    numbered = with_collision_numbers(named, "id", ["pos", "fn_id"])
    return numbered.select("id", "kind", "method", "path", "topic", "fn_id", "pos").orderBy("id")


def resolve(wanted: DataFrame, names: DataFrame, module: str) -> DataFrame:
    """wanted (one column) with n, status (none, one, many) and sorted candidates among names (one column).

    A name fits if it ends with what is wanted, or is it without the module. Endings are compared by
    equi-joins on each ending that is as long as some wanted text; wanted texts are few and short.
    """
    lengths = [r[0] for r in wanted.select(F.length(wanted.columns[0])).distinct().collect()]
    n = names.columns[0]
    name = F.col(n)
    ends = F.array_distinct(F.concat(F.array(*(F.when(F.length(name) >= k, F.substr(name, F.length(name) - k + 1)) for k in lengths)), F.array(trim_module(name, F.lit(module)))))
    fits = names.select(n, F.explode(ends).alias("end")).join(wanted.select(F.col(wanted.columns[0]).alias("end")), "end")
    by = fits.groupBy("end").agg(F.array_sort(F.collect_set(n)).alias("candidates"))
    rows = wanted.join(by.withColumnRenamed("end", wanted.columns[0]), wanted.columns[0], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    size = F.size("candidates")
    return rows.withColumn("n", size).withColumn("status", F.when(size == 0, "none").when(size == 1, "one").otherwise("many"))


def example_handlers(functions: DataFrame) -> DataFrame:
    """is_method and the least name of each kind, from packages that look like handlers' if there are any."""
    handlerish = ~F.col("pkg").rlike(HANDLER_PACKAGES)
    return functions.groupBy("is_method").agg(F.min_by("display_name", F.struct(handlerish, "display_name")).alias("example"))


def forward_methods(starts: DataFrame, uses: DataFrame, hops: int = FORWARD_HOPS) -> DataFrame:
    """site and methods set on a route after its handler: the nearest within ``hops`` links.

    starts: site, at (a route value); uses: at, next (the call's value), kind (methods or link), text. A methods call whose
    texts are not constant is passed over.
    """
    front, found = tables.keep(starts.select("site", "at"), "forward"), None
    for hop in range(hops):
        step = tables.keep(front.join(uses, "at"), "forward")
        hit = step.where("kind = 'methods' and text is not null").groupBy("site").agg(F.min("text").alias("methods")).withColumn("hop", F.lit(hop))
        found = hit if found is None else found.unionByName(hit)
        front = step.where("kind = 'link'").select("site", F.col("next").alias("at"))
        if front.isEmpty():
            break
    return found.groupBy("site").agg(F.min_by("methods", "hop").alias("methods"))


def closure_bindings(bindings: DataFrame) -> DataFrame:
    """free_var and bound, for free variables that one closure binds (bindings: free_var, bound)."""
    return bindings.groupBy("free_var").agg(F.count("*").alias("n"), F.first("bound").alias("bound")).where("n = 1").drop("n")


def resolved_sites(sites: DataFrame, constants: DataFrame, pack_texts: DataFrame, functions: DataFrame, pack_functions: DataFrame, types: DataFrame) -> DataFrame:
    """Call sites whose args (value ids, arg_offset of them the receiver) become what discovery reads.

    constants: value_id, text; pack_texts: pack_id, texts; functions: value_id, fn_id; pack_functions: pack_id, fns; types: value_id,
    type_pkg, type_name. Each is joined once by value, for all arguments together.
    """
    own = F.slice("args", F.col("arg_offset") + 1, F.greatest(F.lit(0), F.size("args") - F.col("arg_offset")))
    each = sites.select("site_id", F.posexplode(own).alias("n", "value_id"))
    for table, key in ((constants, "value_id"), (pack_texts, "pack_id"), (functions, "value_id"), (pack_functions, "pack_id"), (types, "value_id")):
        each = each.join(table.withColumnRenamed(key, "value_id"), "value_id", "left")
    one = F.struct("n", F.struct("text", "texts", F.col("fn_id").alias("fn"), "fns", "type_pkg", "type_name").cast(ARG).alias("a"))
    args = each.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["a"]).alias("resolved"))
    rows = sites.join(args, "site_id", "left").withColumn("args", F.coalesce("resolved", F.array().cast(f"array<{ARG}>"))).drop("resolved")
    return rows.withColumnRenamed("site_id", "site").withColumnRenamed("fn_id", "encl_fn")
