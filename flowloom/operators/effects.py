"""Effects of call sites: the first detector that matches a call says what the call does.

call_site columns: callee_pkg, callee_type, callee_name; arguments are resolved beforehand into
text_args, an array of (is_string, value, template) in argument order (value null: not constant; template:
the format string that builds it), topic (constant topic of a writer or message, null if none) and
topic_source (the text of the first argument).
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.functions.text import compact_query, strip_version, topic_expression

EFFECT = "struct<type:string,detail:string,topic:string,topic_expr:string>"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _pkg() -> Column:
    return strip_version(_text("callee_pkg"))


def _name() -> Column:
    return _text("callee_name")


def _type() -> Column:
    return _text("callee_type")


def _effect(type_: str, detail: Column | str, topic: Column | None = None, hint: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(type_).alias("type"), detail.alias("detail"), (none if topic is None else topic).alias("topic"), (none if hint is None else hint).alias("topic_expr"))


def _statement() -> Column:
    """The text of the first string argument if it is constant, else the method."""
    first = F.get(F.filter("text_args", lambda a: a["is_string"]), F.lit(0))["value"]
    return _effect("sql", F.coalesce(compact_query(first), _name()))


def _method_as(type_: str) -> Callable[[], Column]:
    return lambda: _effect(type_, _name())


def _rpc() -> Column:
    full = F.get(F.filter("text_args", lambda a: a["value"].startswith("/")), F.lit(0))["value"]
    return _effect("grpc", F.coalesce(full, _name()))


def _request() -> Column:
    """METHOD and URL (or the format that builds it) of a request; of other calls the name and the first absolute URL."""
    at = F.when(_name() == "NewRequestWithContext", 2).otherwise(1)
    method = F.coalesce(F.get("text_args", at - 1)["value"], F.lit("request"))
    url = F.get("text_args", at)
    made = F.concat_ws(" ", method, F.coalesce(url["value"], url["template"]))
    there = F.get(F.filter("text_args", lambda a: a["value"].contains("://")), F.lit(0))["value"]
    return _effect("http", F.when(_name().startswith("NewRequest"), made).otherwise(F.concat_ws(" ", _name(), there)))


def _produce(constant: Callable[[], Column] | None = None, hint: Callable[[], Column] | None = None) -> Callable[[], Column]:
    def build() -> Column:
        topic = F.when(F.lit(True) if constant is None else constant(), F.nullif("topic", F.lit("")))
        said = F.when(topic.isNull() & (F.lit(True) if hint is None else hint()), topic_expression(F.col("topic_source")))
        return _effect("kafka", _name(), topic, said)

    return build


@dataclass(frozen=True)
class Detector:
    name: str
    matches: Callable[[], Column]
    build: Callable[[], Column]


# Packages, types and method names of the libraries.
_XORM = [
    "Insert", "InsertOne", "Update", "Delete", "Truncate", "Get", "Find", "FindAndCount", "Count", "Exist",
    "Exec", "Query", "QueryString", "QueryInterface", "Iterate", "Rows", "Sum", "SumInt", "Sums",
]
_GORM = ["Find", "First", "Last", "Take", "Create", "Save", "Update", "Updates", "Delete", "Raw", "Exec", "Scan", "Count", "Pluck"]
_REDIS_OTHER = ["Close", "Options", "AddHook", "String", "WithTimeout", "WithContext", "Context"]
_S3 = r"^github\.com/aws/aws-sdk-go(-v2)?/service/s3"

#: In order: the first that matches decides.
DETECTORS = [
    Detector("database/sql", lambda: (_text("callee_pkg") == "database/sql") & _type().isin("DB", "Conn", "Tx", "Stmt") & _name().rlike("^(Query|Exec|Prepare)"), _statement),
    Detector(
        "pgx",
        lambda: ((_pkg() == "github.com/jackc/pgx") | _text("callee_pkg").startswith("github.com/jackc/pgx/"))
        & _name().isin("Query", "QueryRow", "Exec", "SendBatch", "Begin", "BeginTx", "CopyFrom"),
        _statement,
    ),
    Detector("sqlx", lambda: (_text("callee_pkg") == "github.com/jmoiron/sqlx") & _name().rlike("^(Get|Select|Query|Exec|NamedQuery|NamedExec|MustExec)"), _statement),
    Detector("gorm", lambda: (_text("callee_pkg") == "gorm.io/gorm") & (_type() == "DB") & _name().isin(_GORM), _method_as("sql")),
    Detector(
        "xorm",
        lambda: _text("callee_pkg").startswith("xorm.io/xorm") & _type().isin("Session", "Engine", "EngineGroup", "Interface", "EngineInterface") & _name().isin(_XORM),
        _method_as("sql"),
    ),
    Detector(
        "redis",
        lambda: _pkg().isin("github.com/redis/go-redis", "github.com/go-redis/redis")
        & _type().isin("Client", "ClusterClient", "Ring", "Conn", "Tx", "Pipeline")
        & ~_name().isin(_REDIS_OTHER)
        & _name().rlike("^[A-Z]"),
        _method_as("redis"),
    ),
    Detector(
        "http",
        lambda: (_text("callee_pkg") == "net/http")
        & (
            ((_type() == "Client") & _name().isin("Do", "Get", "Post", "PostForm", "Head"))
            | ((_type() == "") & _name().isin("Get", "Post", "PostForm", "Head", "NewRequest", "NewRequestWithContext"))
        ),
        _request,
    ),
    Detector("grpc", lambda: (_text("callee_pkg") == "google.golang.org/grpc") & (_type() == "ClientConn") & _name().isin("Invoke", "NewStream"), _rpc),
    Detector("kafka-go", lambda: (_text("callee_pkg") == "github.com/segmentio/kafka-go") & (_type() == "Writer") & (_name() == "WriteMessages"), _produce()),
    Detector(
        "sarama",
        lambda: _text("callee_pkg").isin("github.com/IBM/sarama", "github.com/Shopify/sarama")
        & (((_type() == "SyncProducer") & _name().isin("SendMessage", "SendMessages")) | ((_type() == "AsyncProducer") & (_name() == "Input"))),
        _produce(lambda: _name() == "SendMessage", lambda: _name() != "Input"),
    ),
    Detector("confluent", lambda: _text("callee_pkg").startswith("github.com/confluentinc/confluent-kafka-go") & (_type() == "Producer") & (_name() == "Produce"), _produce()),
    Detector(
        "passwords",
        lambda: ((_pkg() == "golang.org/x/crypto/bcrypt") & (_name().startswith("CompareHash") | (_name() == "GenerateFromPassword")))
        | (_pkg().isin("golang.org/x/crypto/argon2", "golang.org/x/crypto/scrypt") & _name().isin("IDKey", "Key")),
        lambda: _effect("security", F.when(_name().startswith("CompareHash"), "verifies password").otherwise("hashes password")),
    ),
    Detector("jwt", lambda: _pkg().isin("github.com/golang-jwt/jwt", "github.com/dgrijalva/jwt-go") & (_name() == "SignedString"), lambda: _effect("security", "issues token")),
    Detector(
        "object storage",
        lambda: (_name() != "") & (((_pkg() == "github.com/minio/minio-go") & (_type() == "Client")) | (_pkg().rlike(_S3) & _type().isin("Client", "S3", "PresignClient"))),
        _method_as("storage"),
    ),
]


def detect(sites: DataFrame) -> DataFrame:
    """sites with detector and effect (null: none), by the first detector that matches."""
    name, effect = F.lit(None).cast("string"), F.lit(None).cast(EFFECT)
    for d in reversed(DETECTORS):
        hit = F.coalesce(d.matches(), F.lit(False))
        name, effect = F.when(hit, F.lit(d.name)).otherwise(name), F.when(hit, d.build()).otherwise(effect)
    return sites.withColumn("detector", name).withColumn("effect", effect)
