"""Rule-set model: frozen dataclasses loaded from the JSON rule document.

A rule set is KB-sized and lives on the driver; it is compiled into column
expressions (``tabvet.plans.compile``) and never distributed as data. Every check
that can fail late in the reference (bad regex, bad date format, chunk size) is
rejected here, when the rules are loaded.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Mapping

from tabvet.functions.dates import FormatError, compile_strptime
from tabvet.plans.regex import PatternError, python_regex_to_java


class RuleError(ValueError):
    """The rule document is malformed or uses something this engine does not support."""


FIELD_TYPES = ("string", "integer", "float", "enum", "phone", "date", "datetime")
CROSS_TYPES = ("date_order", "future_tolerance")


@dataclass(frozen=True)
class Reference:
    dataset: str
    field: str


@dataclass(frozen=True)
class FieldRule:
    name: str
    type: str = "string"
    required: bool = False
    constraints: Mapping[str, Any] = field(default_factory=dict)
    region_column: str | None = None
    default_region: str | None = None

    @property
    def unique(self) -> bool:
        return bool(self.constraints.get("unique"))

    @property
    def reference(self) -> Reference | None:
        ref = self.constraints.get("references")
        return Reference(ref["dataset"], ref["field"]) if ref else None

    @property
    def formats(self) -> list[str] | None:
        return self.constraints.get("formats")


@dataclass(frozen=True)
class CrossCheck:
    type: str
    params: Mapping[str, Any] = field(default_factory=dict)

    def get(self, key, default=None):
        return self.params.get(key, default)


@dataclass(frozen=True)
class GlobalRules:
    default_country: str = "US"
    default_country_column: str | None = None
    country_phone_rules: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleSet:
    dataset: str
    fields: tuple[FieldRule, ...]
    cross_checks: tuple[CrossCheck, ...] = ()
    globals: GlobalRules = GlobalRules()
    name: str = ""

    def field(self, name: str) -> FieldRule | None:
        for f in self.fields:
            if f.name == name:
                return f
        return None

    def with_fields(self, names) -> "RuleSet":
        """A rule set restricted to some fields (cross checks on them are kept)."""
        keep = tuple(f for f in self.fields if f.name in set(names))
        kept = {f.name for f in keep}
        cross = tuple(c for c in self.cross_checks
                      if {c.get("left"), c.get("right"), c.get("field")} - {None} <= kept)
        return RuleSet(self.dataset, keep, cross, self.globals, self.name)

    def with_constraint(self, field_name: str, key: str, value) -> "RuleSet":
        fields = tuple(
            FieldRule(f.name, f.type, f.required, {**f.constraints, key: value}, f.region_column, f.default_region)
            if f.name == field_name else f for f in self.fields)
        return RuleSet(self.dataset, fields, self.cross_checks, self.globals, self.name)


def _field(raw: Mapping[str, Any], dataset: str) -> FieldRule:
    if "name" not in raw:
        raise RuleError(f"{dataset}: a field rule has no name")
    name = raw["name"]
    ftype = raw.get("type", "string")
    if ftype not in FIELD_TYPES:
        raise RuleError(f"{dataset}.{name}: unknown type {ftype!r}")
    cons = dict(raw.get("constraints") or {})
    if "regex" in cons:
        try:
            python_regex_to_java(cons["regex"])
        except PatternError as exc:
            raise RuleError(f"{dataset}.{name}: bad regex {cons['regex']!r}: {exc}") from exc
    for key in ("min", "max", "min_length", "max_length"):
        if key in cons and (isinstance(cons[key], bool) or not isinstance(cons[key], (int, float))):
            raise RuleError(f"{dataset}.{name}: {key} must be a number")
    if "formats" in cons:
        if not isinstance(cons["formats"], list):
            raise RuleError(f"{dataset}.{name}: formats must be a list")
        for fmt in cons["formats"]:
            try:
                compile_strptime(fmt)
            except FormatError as exc:
                raise RuleError(f"{dataset}.{name}: {exc}") from exc
    if "allowed" in cons and not isinstance(cons["allowed"], list):
        raise RuleError(f"{dataset}.{name}: allowed must be a list")
    ref = cons.get("references")
    if ref is not None and not (isinstance(ref, Mapping) and "dataset" in ref and "field" in ref):
        raise RuleError(f"{dataset}.{name}: references needs dataset and field")
    return FieldRule(name, ftype, bool(raw.get("required", False)), cons,
                     raw.get("region_column"), raw.get("default_region"))


def rules_from_dict(doc: Mapping[str, Any], dataset: str) -> RuleSet:
    datasets = doc.get("datasets", {})
    ds = datasets.get(dataset)
    if not ds:
        raise RuleError(f"No rules for dataset type: {dataset}")
    fields = tuple(_field(f, dataset) for f in ds.get("fields", []))
    seen: set[str] = set()
    for f in fields:
        if f.name in seen:
            raise RuleError(f"{dataset}: field {f.name!r} is declared twice")
        seen.add(f.name)
    cross = []
    for c in ds.get("cross_field_checks", []):
        ctype = c.get("type")
        if ctype == "date_order" and not ({"left", "right"} <= set(c)):
            raise RuleError(f"{dataset}: date_order needs left and right")
        if ctype == "future_tolerance" and "field" not in c:
            raise RuleError(f"{dataset}: future_tolerance needs field")
        # Unknown cross-check types are ignored, as in the reference.
        if ctype in CROSS_TYPES:
            cross.append(CrossCheck(ctype, {k: v for k, v in c.items() if k != "type"}))
    g = doc.get("global", {}) or {}
    glob = GlobalRules(g.get("default_country", "US"), g.get("default_country_column"),
                       dict(g.get("country_phone_rules", {}) or {}))
    return RuleSet(dataset, fields, tuple(cross), glob, doc.get("name", ""))


def load_rules(source: str | Path | Mapping[str, Any], dataset: str) -> RuleSet:
    """Load the rules of one dataset from a JSON file path, JSON text or a dict."""
    if isinstance(source, Mapping):
        doc = source
    else:
        text = str(source)
        if text.lstrip().startswith("{"):
            doc = json.loads(text)
        else:
            with open(text, encoding="utf-8") as fh:
                doc = json.load(fh)
    return rules_from_dict(doc, dataset)
