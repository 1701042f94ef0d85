"""Rule files and settings: YAML on the driver, small tables for the plans."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from flowloom.functions.predicates import REGISTRY

ACTIONS = ("drop", "collapse")

#: The rules that apply unless others are given. The order decides.
DEFAULT_RULES = """\
version: 1
rules:
  - {id: "default:context", action: drop, match: {pkg: "std:context"}}
  - {id: "default:stdlib", action: drop, match: {pkg: "std:*"}}
  - {id: "default:third-party", action: drop, match: {pkg: "dep:*"}}
  - {id: "default:logging", action: drop, match: {heuristic: logger-method}}
  - {id: "default:logging-packages", action: drop, match: {heuristic: logger-package}}
  - {id: "default:logging-factories", action: drop, match: {heuristic: logger-factory}}
  - {id: "default:metrics", action: drop, match: {heuristic: metrics-tracing}}
  - {id: "default:config", action: drop, match: {heuristic: config-reader}}
  - {id: "default:validation", action: drop, match: {heuristic: validation-helper}}
  - {id: "default:error-wrapper", action: collapse, match: {heuristic: error-wrapper}}
  - {id: "default:trivial-wrapper", action: collapse, match: {heuristic: trivial-wrapper}}
  - {id: "default:dto-mapper", action: collapse, match: {heuristic: dto-mapper}}
  - {id: "default:respond-helper", action: drop, match: {heuristic: respond-helper}}
  - {id: "default:inline-closure", action: collapse, match: {heuristic: inline-closure}}
  - {id: "default:trivial-constructor", action: collapse, match: {heuristic: trivial-constructor}}
  - {id: "default:getter", action: collapse, match: {heuristic: getter}}
"""


@dataclass(frozen=True)
class Rule:
    """A rule: its criteria must all hold, of each list one pattern."""

    id: str
    action: str
    pkg: tuple[str, ...] = ()
    func: tuple[str, ...] = ()
    heuristic: str = ""


def parse_rules(text: str) -> list[Rule]:
    """The rules of a file in order; ValueError says what is wrong with it."""
    try:
        entries = (yaml.safe_load(text) or {}).get("rules") or []
    except (yaml.YAMLError, AttributeError) as e:
        raise ValueError(f"rules can't be parsed: {e}") from e
    several = lambda x: (x,) if isinstance(x, str) else tuple(x or ())
    rules: list[Rule] = []
    for n, entry in enumerate(entries, 1):
        match = entry.get("match") or {}
        rule = Rule(entry.get("id") or "", entry.get("action") or "", several(match.get("pkg")), several(match.get("func")), match.get("heuristic") or "")
        if not rule.id:
            raise ValueError(f"rule {n} has no id")
        if any(rule.id == r.id for r in rules):
            raise ValueError(f"rule id {rule.id!r} is used twice")
        if rule.action not in ACTIONS:
            raise ValueError(f"rule {rule.id!r}: the action is drop or collapse, not {rule.action!r}")
        if not (rule.pkg or rule.func or rule.heuristic):
            raise ValueError(f"rule {rule.id!r} matches nothing: it needs pkg, func or heuristic")
        if rule.heuristic and rule.heuristic not in REGISTRY:
            raise ValueError(f"rule {rule.id!r}: no heuristic {rule.heuristic!r}; there are {', '.join(sorted(REGISTRY))}")
        rules.append(rule)
    return rules


def default_rules() -> list[Rule]:
    return parse_rules(DEFAULT_RULES)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.id, r.action, list(r.pkg), list(r.func), r.heuristic) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, id string, action string, pkg array<string>, func array<string>, heuristic string")


@dataclass
class Settings:
    """Labels by suffix, entity names by key, and satellites by the entity they belong to."""

    overrides: dict[str, str] = field(default_factory=dict)
    entities: dict[str, str] = field(default_factory=dict)
    merge: dict[str, list[str]] = field(default_factory=dict)


def read_settings(path: str) -> tuple[Settings, list[str]]:
    """Settings of a file, and warnings: a missing file is empty, a malformed one is empty with a warning."""
    try:
        with open(path, encoding="utf-8") as file:
            found = yaml.safe_load(file) or {}
        return Settings(**{k: dict(found.get(k) or {}) for k in ("overrides", "entities", "merge")}), []
    except FileNotFoundError:
        return Settings(), []
    except (yaml.YAMLError, AttributeError, TypeError, ValueError) as e:
        return Settings(), [f"settings ignored: {e}"]


def settings_tables(spark: SparkSession, settings: Settings) -> dict[str, DataFrame]:
    return {
        "override": spark.createDataFrame(list(settings.overrides.items()), "key string, label string"),
        "entity_name": spark.createDataFrame(list(settings.entities.items()), "key string, name string"),
        "merge": spark.createDataFrame([(t, s) for t, names in settings.merge.items() for s in names], "target string, satellite string"),
    }
