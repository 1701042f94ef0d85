"""Tables of program facts: schemas, readers, and the functions that derive what operators read.

The facts come from a frontend that reads a program; they are JSON lines or Parquet, one table each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom import tables
from flowloom.functions.predicates import LEVELS, LOGGERS
from flowloom.functions.text import base_name, file_class

_RESULT = "struct<pkg:string,type:string,is_error:boolean,is_bool:boolean>"
SCHEMAS = {
    "program": "module string, dir string, warnings array<string>",
    "module_pkg": "pkg string",
    "source_file": "file string, pkg string, class string",
    "function": "fn_id string, display_name string, short_name string, pkg string, file string, line int, pos int, recv_type string, parent_fn string, origin_fn string, declared_fn string, "
    f"synthetic boolean, has_body boolean, n_blocks int, n_instrs int, params array<struct<pkg:string,type:string>>, results array<{_RESULT}>",
    "block": "fn_id string, b int, pre int, post int, preds array<int>, succs array<int>",
    "instr": "fn_id string, b int, i int, op string, value_id string, operands array<string>, type string, pos int, const_kind string, const_str string, const_int bigint",
    "call_site": "fn_id string, site_id string, b int, i int, pos int, mode string, is_go boolean, is_defer boolean, callee_fn string, callee_pkg string, callee_type string, callee_name string, arg_offset int, args array<string>",
    "call_edge": "algo string, caller string, site_id string, callee string",
    "method_set": "type_pkg string, type_name string, method string, fn_id string",
    "iface_method": "iface_pkg string, iface_name string, method string, exported boolean, ord int",
    "value_def": "value_id string, kind string, x string, idx int, text string, owner_type string, field int",
    "store": "fn_id string, b int, i int, addr_id string, val_id string, owner_type string, field int",
    "if_stmt": "file string, pos int, end int, body_start int, body_end int, else_start int, else_end int, cond_text string",
    "struct_field": "type_pkg string, type_name string, ord int, name string, tag string, type string, exported boolean, embedded boolean",
}
#: Warnings of a load that are kept.
WARNINGS = 20


def read_facts(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All fact tables of a folder by name; the schema is given, never inferred."""
    return {name: spark.read.schema(schema).format(fmt).load(f"{folder}/{name}.{fmt}") for name, schema in SCHEMAS.items()}


def load_warnings(warnings: Column, most: int = WARNINGS) -> Column:
    more = F.concat(F.lit("... and "), (F.size(warnings) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(warnings) > most, F.concat(F.slice(warnings, 1, most), F.array(more))).otherwise(warnings)


def classify_files(files: DataFrame) -> DataFrame:
    """file, pkg and class of sources (file, pkg, header); tests are left out."""
    return files.where(~F.col("file").endswith("_test.go")).select("file", "pkg", file_class(F.col("file"), F.col("header")).alias("class"))


def function_classes(functions: DataFrame, files: DataFrame) -> DataFrame:
    """functions with the class of the file that declares them; normal without one."""
    return functions.join(files.select("file", "class"), "file", "left").withColumn("file_class", F.coalesce("class", F.lit("normal"))).drop("class")


def module_functions(functions: DataFrame, module_pkg: DataFrame) -> DataFrame:
    """functions with in_module: the package is one of the module's."""
    own = module_pkg.distinct().withColumn("in_module", F.lit(True))
    return functions.join(own, "pkg", "left").withColumn("in_module", F.coalesce("in_module", F.lit(False)))


def generated_ratio(classes: DataFrame) -> DataFrame:
    """generated, total and the whole percentage of generated rows (class); warn: more than half."""
    row = classes.agg(F.count_if(F.col("class") == "generated").alias("generated"), F.count("*").alias("total"))
    pct = F.when(F.col("total") > 0, F.floor(F.col("generated") * 100 / F.col("total"))).otherwise(0).cast("long")
    return row.withColumn("pct", pct).withColumn("warn", F.col("generated") * 2 > F.col("total"))


def receiver_chains(functions: DataFrame) -> DataFrame:
    """functions with recv_chain: receiver types of the function and of those it is nested in, up to the outermost."""
    up = functions.select(F.col("fn_id").alias("_at"), F.col("parent_fn").alias("_next"), F.col("recv_type").alias("_recv"))
    rows = functions.withColumn("recv_chain", F.array_compact(F.array("recv_type"))).withColumn("_p", F.col("parent_fn"))
    while not rows.where("_p is not null").isEmpty():
        rows = rows.join(up, rows["_p"] == up["_at"], "left").withColumn("recv_chain", F.array_compact(F.array_append("recv_chain", F.col("_recv")))).withColumn("_p", F.col("_next")).drop("_at", "_next", "_recv")
        rows = tables.keep(rows, "receivers")
    return rows.drop("_p")


def body_facts(functions: DataFrame, instrs: DataFrame, sites: DataFrame, in_module: DataFrame) -> DataFrame:
    """functions with the counts that heuristics read, from one aggregation of instructions and one of call sites.

    in_module: pkg of the module's packages.
    """
    control = instrs.groupBy("fn_id").agg(F.count_if(F.col("op").isin("If", "Jump", "Panic")).cast("int").alias("n_control"))
    callee = functions.select(F.col("fn_id").alias("callee_fn"), F.col("pkg").alias("_pkg"), F.col("short_name").alias("_name"), F.lower(F.coalesce("recv_type", F.lit(""))).alias("_recv"))
    rows = sites.where("mode != 'builtin'").join(callee, "callee_fn", "left").join(in_module.select(F.col("pkg").alias("_pkg"), F.lit(True).alias("_own")), "_pkg", "left")
    noise = base_name(F.coalesce("_pkg", F.lit(""))).isin(LOGGERS) | (F.col("_name").isin(LEVELS) & F.col("_recv").contains("log"))
    calls = rows.groupBy("fn_id").agg(
        F.count("*").cast("int").alias("n_calls"),
        F.count_if(F.col("mode") == "invoke").cast("int").alias("n_invoke"),
        F.count_if((F.col("mode") == "static") & F.col("_own") & ~noise).cast("int").alias("n_module_calls"),
        F.count_if(F.col("mode") != "static").cast("int").alias("n_unknown_calls"),
        F.collect_set(F.when(F.col("mode") == "static", F.coalesce("_pkg", "callee_pkg"))).alias("call_pkgs"),
    )
    joined = functions.join(control, "fn_id", "left").join(calls, "fn_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_control", "n_calls", "n_invoke", "n_module_calls", "n_unknown_calls")}
    return joined.withColumns(zero | {"call_pkgs": F.coalesce("call_pkgs", F.array().cast("array<string>")), "has_recv": F.col("recv_type").isNotNull()})
