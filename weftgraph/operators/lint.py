"""Diagnostics and lint: rules, the plug-in base, filters, severities, the summary."""

from __future__ import annotations

import importlib.util
import tomllib
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import matches_any, unqualified, uri_path

SEVERITIES = ("error", "warning", "information", "hint")
#: Rules of the indexer and resolver, and what they are unless configured otherwise.
RULES = {
    "ParseError": "error", "ParseWarning": "warning", "DynamicConstantReference": "hint", "DynamicSingletonDefinition": "hint", "DynamicAncestor": "hint",
    "TopLevelMixinSelf": "warning", "InvalidConstantVisibility": "warning", "InvalidMethodVisibility": "warning",
    "UndefinedConstantVisibilityTarget": "warning", "UndefinedMethodVisibilityTarget": "warning",
}
DIAGNOSTIC = "rule string, uri string, start int, end int, line int, message string"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class RuleConfig:
    enabled: bool = True
    exclude: tuple[str, ...] = ()
    severity: str | None = None


@dataclass(frozen=True)
class Config:
    exclude: tuple[str, ...] = ()
    rules: dict[str, RuleConfig] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Config:
        """From TOML: [graph] exclude, and [linter.rules.NAME] enabled, exclude, severity; nothing else is known."""
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError(str(e)) from e

        def only(table: dict, *keys: str, where: str) -> dict:
            if not isinstance(table, dict) or set(table) - set(keys):
                raise ConfigError(f"unknown setting in {where or 'the file'}: {', '.join(sorted(set(table) - set(keys)))}")
            return table

        def strings(value, where: str) -> tuple[str, ...]:
            if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                raise ConfigError(f"{where} must be a list of strings")
            return tuple(value)

        only(raw, "graph", "linter", where="")
        graph = only(raw.get("graph", {}), "exclude", where="graph")
        linter = only(raw.get("linter", {}), "rules", where="linter")
        rules = {}
        for name, r in linter.get("rules", {}).items():
            only(r, "enabled", "exclude", "severity", where=f"linter.rules.{name}")
            if r.get("severity") not in (None, *SEVERITIES):
                raise ConfigError(f"unknown severity {r['severity']!r} of {name}")
            if not isinstance(r.get("enabled", True), bool):
                raise ConfigError(f"enabled of {name} must be true or false")
            rules[name] = RuleConfig(r.get("enabled", True), strings(r.get("exclude", []), f"exclude of {name}"), r.get("severity"))
        return cls(strings(graph.get("exclude", []), "graph.exclude"), rules)

    @classmethod
    def load(cls, path: str) -> Config:
        p = Path(path)
        return cls.parse(p.read_text()) if p.exists() else cls()


class Rule(ABC):
    """A custom rule: give it a name and a severity, and return diagnostics."""

    name = ""
    severity = "warning"

    @abstractmethod
    def lint(self, graph) -> DataFrame:
        """Rows of DIAGNOSTIC about a code graph."""

    def child_classes(self, graph, of: str) -> DataFrame:
        """(name) of the classes that descend from a class, without itself."""
        chain = graph.ancestors.where((F.col("ancestor") == of) & (F.col("name") != of)).select("name")
        return graph.declarations.where("kind = 'Class'").select("name").join(chain, "name", "left_semi")

    def missing_method(self, graph, classes: DataFrame, method: str) -> DataFrame:
        """(name) of the classes that don't define a method themselves."""
        have = graph.members.where(F.col("member") == method).select(F.col("owner").alias("name"))
        return classes.join(have, "name", "left_anti")

    def outside_namespace(self, classes: DataFrame, namespace: str) -> DataFrame:
        return classes.where(~F.col("name").startswith(namespace + "::"))

    def at_definitions(self, graph, names: DataFrame, message: str) -> DataFrame:
        """A diagnostic at the first definition of each name; {} in the message is its unqualified name."""
        own = graph.definitions.join(names.select(F.col("name").alias("declaration")), "declaration", "left_semi")
        first = own.groupBy("declaration").agg(F.min_by(F.struct("uri", "start", "end", "line"), F.struct("uri", "start")).alias("d"))
        text = F.replace(F.lit(message), F.lit("{}"), unqualified("declaration"))
        return first.select(F.lit(self.name).alias("rule"), "d.uri", "d.start", "d.end", "d.line", text.alias("message"))


def load_rules(*globs: str) -> list[Rule]:
    """The rules in Python files that the globs find, each class once, by name."""
    found: dict[str, Rule] = {}
    for g in globs:
        root = Path(g).anchor or "."
        for path in sorted(Path(root).glob(str(Path(g).relative_to(root)) if Path(g).is_absolute() else g)):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            for x in vars(module).values():
                if isinstance(x, type) and issubclass(x, Rule) and x is not Rule and x.name:
                    found.setdefault(x.name, x())
    return [found[k] for k in sorted(found)]


def severities(spark: SparkSession, rules: dict[str, str], config: Config) -> DataFrame:
    rows = [(n, (config.rules.get(n, RuleConfig()).severity or s)) for n, s in sorted(rules.items())]
    return spark.createDataFrame(rows, "rule string, severity string")


def lint(diagnostics: DataFrame, config: Config, workspace: str, dependencies: tuple[str, ...] = (), rules: dict[str, str] | None = None) -> DataFrame:
    """(rule, severity, path, line, start, end, message): what is left of the diagnostics, sorted.

    Left out are disabled rules, and files outside the workspace, excluded by the rule or in a dependency's folder; URIs that name no file stay.
    """
    rules = RULES if rules is None else rules
    path = uri_path("uri")
    root = workspace.rstrip("/") + "/"
    is_file = F.col("uri").startswith("file://")
    inside = F.substring(path, len(root) + 1, 1 << 20)
    keep = ~is_file | path.startswith(root)
    for d in dependencies:
        keep = keep & ~(is_file & path.startswith(d.rstrip("/") + "/"))
    for name, r in config.rules.items():
        if not r.enabled:
            keep = keep & (F.col("rule") != name)
        elif r.exclude:
            keep = keep & ~((F.col("rule") == name) & is_file & matches_any(inside, list(r.exclude)))
    known = severities(diagnostics.sparkSession, rules, config)
    out = diagnostics.where(keep).join(F.broadcast(known), "rule", "left")
    out = out.select("rule", F.coalesce("severity", F.lit("warning")).alias("severity"), F.when(is_file & path.startswith(root), inside).otherwise(F.col("uri")).alias("path"), "line", "start", "end", "message")
    return out.orderBy("path", "line", "start", "end", "rule", "severity", "message")


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


def unknown_rules(config: Config, known: list[str]) -> list[str]:
    return sorted(set(config.rules) - set(known))
