"""Named heuristics that rules can ask for: columns over a row of function facts.

The row has pkg, short_name, recv_type, recv_chain (receiver types of the function and of the
functions it is nested in), parent_fn, params and results (arrays of structs with pkg and type,
results also is_error and is_bool), and counts of its body: n_blocks, n_instrs, n_calls (calls of
any form), n_control (branches, jumps, panics), n_invoke (interface calls), n_module_calls (static
calls into the module that are not logging or metrics), n_unknown_calls (calls without a static
callee) and call_pkgs (packages of static callees). A row without function facts (short_name
null) matches none but the package heuristics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from flowloom.functions.text import base_name

# Fixed values.
LEVELS = [
    "Debug", "Debugf", "Debugw", "Debugln", "Info", "Infof", "Infow", "Infoln", "Warn", "Warnf", "Warnw", "Warnln", "Warning", "Warningf",
    "Error", "Errorf", "Errorw", "Errorln", "Trace", "Tracef", "Fatal", "Fatalf", "Fatalln", "Panic", "Panicf", "Panicln",
    "Print", "Printf", "Println", "Log", "Logf",
]
LOGGERS = ["log", "slog", "zap", "logrus", "zerolog", "logger", "logging", "logx"]
METRICS = ["metrics", "metric", "telemetry", "tracing", "trace", "stats", "monitoring", "prometheus", "instrumentation", "otel"]
METRICS_PREFIXES = ["github.com/prometheus/", "go.opentelemetry.io/", "go.opencensus.io/", "contrib.go.opencensus.io/"]
METRICS_RECEIVERS = ["timing", "metric", "telemetr", "tracer", "stopwatch", "profil"]
CONFIGS = ["config", "configs", "conf", "cfg", "settings", "env", "flags"]
VALIDATIONS = ["validate", "check", "verify", "ensure", "assert", "isvalid", "iserr"]
MAPPER_PREFIXES = ["To", "From", "Map", "to", "from"]
MAPPER_SUFFIXES = ["FromModel", "ToModel", "FromDTO", "ToDTO", "ToResponse", "FromRequest", "ToProto", "FromProto", "ToDoc", "ToEntity"]
GETTERS = ["Get", "Is", "Has", "Len", "Name", "String", "ID"]
ERROR_PACKAGES = ["fmt", "errors", "github.com/pkg/errors"]
GETTER_INSTRUCTIONS, CONSTRUCTOR_INSTRUCTIONS, WRAPPER_BLOCKS = 8, 10, 3


def _c(name: str) -> Column:
    return F.col(name)


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _results() -> Column:
    return F.coalesce(F.size("results"), F.lit(0))


def logger_package() -> Column:
    return base_name(_empty("pkg")).isin(LOGGERS)


def logger_method() -> Column:
    return _c("short_name").isin(LEVELS) & (logger_package() | F.lower(_empty("recv_type")).contains("log"))


def logger_factory() -> Column:
    return F.exists("results", lambda r: base_name(F.coalesce(r["pkg"], F.lit(""))).isin(LOGGERS))


def metrics_tracing() -> Column:
    by_package = base_name(_empty("pkg")).isin(METRICS)
    for prefix in METRICS_PREFIXES:
        by_package = by_package | _empty("pkg").startswith(prefix)
    return by_package | F.coalesce(F.exists("recv_chain", lambda r: F.lower(r).rlike("|".join(METRICS_RECEIVERS))), F.lit(False))


def config_reader() -> Column:
    return base_name(_empty("pkg")).isin(CONFIGS)


def validation_helper() -> Column:
    named = F.lower(_c("short_name")).rlike(f"^({'|'.join(VALIDATIONS)})")
    only = F.get("results", F.lit(0))
    return named & (_results() == 1) & (only["is_error"] | only["is_bool"])


def trivial_wrapper() -> Column:
    return (_c("n_blocks") == 1) & (_c("n_calls") == 1) & (_c("n_control") == 0)


def dto_mapper() -> Column:
    named = _c("short_name").rlike(f"^({'|'.join(MAPPER_PREFIXES)})[A-Z]") | _c("short_name").rlike(f"({'|'.join(MAPPER_SUFFIXES)})$")
    return named & F.exists("results", lambda r: ~r["is_error"])


def respond_helper() -> Column:
    writes = F.exists("params", lambda p: (p["pkg"] == "net/http") & (p["type"] == "ResponseWriter"))
    return F.lower(_c("short_name")).rlike("respond|json|write") & writes


def inline_closure() -> Column:
    return _c("parent_fn").isNotNull() & (_c("n_invoke") == 0) & (_c("n_module_calls") <= 1)


def trivial_constructor() -> Column:
    first = F.get("results", F.lit(0))
    return _c("short_name").rlike("^[nN]ew") & (_c("n_blocks") == 1) & (_results() > 0) & ~first["is_error"] & (_c("n_instrs") <= CONSTRUCTOR_INSTRUCTIONS) & (_c("n_calls") == 0)


def getter() -> Column:
    named = _c("short_name").rlike(f"^({'|'.join(GETTERS)})")
    return _c("has_recv") & (_c("n_blocks") == 1) & (_c("n_instrs") <= GETTER_INSTRUCTIONS) & (_c("n_calls") == 0) & named


def error_wrapper() -> Column:
    only = F.get("results", F.lit(0))
    known = F.forall("call_pkgs", lambda p: p.isin(ERROR_PACKAGES)) & (_c("n_unknown_calls") == 0)
    return (_c("n_blocks") <= WRAPPER_BLOCKS) & (_results() == 1) & only["is_error"] & (_c("n_calls") > 0) & known


REGISTRY: dict[str, Callable[[], Column]] = {
    "logger-method": logger_method,
    "logger-package": logger_package,
    "logger-factory": logger_factory,
    "metrics-tracing": metrics_tracing,
    "config-reader": config_reader,
    "validation-helper": validation_helper,
    "trivial-wrapper": trivial_wrapper,
    "dto-mapper": dto_mapper,
    "respond-helper": respond_helper,
    "inline-closure": inline_closure,
    "trivial-constructor": trivial_constructor,
    "getter": getter,
    "error-wrapper": error_wrapper,
}


def heuristic(name: str) -> Column:
    """The named heuristic; false where facts are missing."""
    return F.coalesce(REGISTRY[name](), F.lit(False))


# ---------------------------------------------------------------- other tests of a function


def worth_visiting() -> Column:
    """Has a body and belongs to the module (column in_module)."""
    return _c("has_body") & _c("in_module")


def dependency_function_type(pkg: Column, module_package: Column) -> Column:
    """A named function type declared outside the module."""
    return pkg.isNotNull() & (pkg != "") & ~module_package


def handler_shaped() -> Column:
    """One context parameter of a web framework, or a response writer and a request."""
    first, second = F.get("params", F.lit(0)), F.get("params", F.lit(1))
    context = (F.size("params") == 1) & (first["pkg"] != "context") & first["type"].rlike(r"^\*?(Ctx|Context)\z")
    plain = (F.size("params") == 2) & (first["type"] == "ResponseWriter") & second["type"].rlike(r"^\*?Request\z")
    return F.coalesce(context | plain, F.lit(False))
