"""Declared field mappings: validation, additive evolution, document checks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime

from docsail.errors import bad_request

TYPES = ("keyword", "text", "boolean", "long", "double", "datetime", "vector", "object")
ANALYZERS = ("standard", "english", "korean", "japanese")
SIMILARITIES = ("cosine", "dot_product", "l2_norm", "max_inner_product")
RESERVED = ("_walId", "_doc", "_values", ".")
SORTABLE = ("keyword", "long", "double", "datetime")
MIN_DIMENSIONS, MAX_DIMENSIONS = 17, 1024
MAX_KEYWORD = 4096


@dataclass(frozen=True)
class Field:
    """One declared field; children are those of an object (none: an opaque one)."""

    kind: str
    analyzers: tuple[str, ...] = ()
    dimensions: int | None = None
    similarity: str | None = None
    children: dict[str, Field] = field(default_factory=dict)

    def to_json(self) -> dict:
        out: dict = {"type": self.kind}
        if self.analyzers:
            out["analyzers"] = list(self.analyzers)
        if self.kind == "vector":
            out |= {"dimensions": self.dimensions, "similarity": self.similarity}
        if self.children:
            out["objectMapping"] = {k: f.to_json() for k, f in self.children.items()}
        return out


class Mapping:
    """Fields by name, ``id`` always among them; ``flat`` has every leaf by its dotted path."""

    def __init__(self, fields: dict[str, Field]):
        self.fields = {"id": Field("keyword")} | fields
        self.flat: dict[str, Field] = {}
        self._flatten("", self.fields)

    def _flatten(self, prefix: str, fields: dict[str, Field]) -> None:
        for name, f in fields.items():
            if f.kind == "object":
                self._flatten(f"{prefix}{name}.", f.children)
            else:
                self.flat[prefix + name] = f

    @classmethod
    def parse(cls, declared: dict) -> Mapping:
        if not isinstance(declared, dict) or not declared:
            raise bad_request("mappings must be a non-empty object")
        return cls({name: _parse_field(name, spec) for name, spec in declared.items()})

    def to_json(self) -> dict:
        return {name: f.to_json() for name, f in self.fields.items()}

    def extended(self, declared: dict) -> Mapping:
        """The mapping after an update, which repeats every field as it was and may add others."""
        new = Mapping.parse(declared)
        _check_extension(self.fields, new.fields, "")
        return new

    def leaf(self, path: str) -> Field | None:
        return self.flat.get(path)


def _parse_field(name: str, spec: dict) -> Field:
    if name in RESERVED or not name or "." in name:
        raise bad_request(f"field name '{name}' is reserved or holds a dot")
    if not isinstance(spec, dict) or spec.get("type") not in TYPES:
        raise bad_request(f"field '{name}' needs a type among {', '.join(TYPES)}")
    kind, rest = spec["type"], {k: v for k, v in spec.items() if k != "type" and v is not None}
    if name == "id" and kind != "keyword":
        raise bad_request("the type of 'id' must be keyword")
    allowed = {"text": {"analyzers"}, "vector": {"dimensions", "similarity"}, "object": {"objectMapping"}}.get(kind, set())
    if extra := set(rest) - allowed:
        raise bad_request(f"field '{name}' of type {kind} can't have {', '.join(sorted(extra))}")
    if kind == "text":
        analyzers = tuple(dict.fromkeys(str(a).lower() for a in rest.get("analyzers") or ["standard"]))
        if unknown := [a for a in analyzers if a not in ANALYZERS]:
            raise bad_request(f"unknown analyzer '{unknown[0]}' in field '{name}'")
        return Field(kind, analyzers)
    if kind == "vector":
        n, similarity = rest.get("dimensions"), str(rest.get("similarity") or "cosine").lower()
        if not isinstance(n, int) or not MIN_DIMENSIONS <= n <= MAX_DIMENSIONS:
            raise bad_request(f"dimensions of '{name}' must be from {MIN_DIMENSIONS} to {MAX_DIMENSIONS}")
        if similarity not in SIMILARITIES:
            raise bad_request(f"unknown similarity '{similarity}' in field '{name}'")
        return Field(kind, dimensions=n, similarity=similarity)
    if kind == "object":
        return Field(kind, children={k: _parse_field(k, v) for k, v in (rest.get("objectMapping") or {}).items()})
    return Field(kind)


def _check_extension(old: dict[str, Field], new: dict[str, Field], prefix: str) -> None:
    for name, was in old.items():
        now = new.get(name)
        if now is None:
            raise bad_request(f"field '{prefix}{name}' can't be dropped")
        for what in ("kind", "analyzers", "dimensions", "similarity"):
            if getattr(was, what) != getattr(now, what):
                raise bad_request(f"{'type' if what == 'kind' else what} of '{prefix}{name}' can't change")
        _check_extension(was.children, now.children, f"{prefix}{name}.")


_ISO = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)$")


def parse_instant(text: str) -> datetime:
    """An ISO date-time with its offset, to the millisecond."""
    if not isinstance(text, str) or not _ISO.match(text):
        raise bad_request(f"'{text}' is not an ISO date-time with an offset")
    try:
        at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text))
    except ValueError:
        raise bad_request(f"'{text}' is not an ISO date-time with an offset") from None
    return at.replace(microsecond=at.microsecond // 1000 * 1000)


def document_error(doc: object, mapping: Mapping) -> str | None:
    """Why a document can't be stored, or None. Undeclared fields are kept unchecked; declared ones may be missing, not null."""
    if not isinstance(doc, dict):
        return "a document must be an object"
    if "id" in doc and (not isinstance(doc["id"], str) or not doc["id"]):
        return "id must be a non-empty string"
    return _fields_error(doc, mapping.fields, "")


def _fields_error(doc: dict, fields: dict[str, Field], prefix: str) -> str | None:
    for name, f in fields.items():
        if name in doc and (why := _value_error(doc[name], f, prefix + name)):
            return why
    return None


def _value_error(v: object, f: Field, path: str) -> str | None:
    scalar = isinstance(v, (str, int, float, bool))
    if v is None:
        return f"{path} must not be null"
    if f.kind == "text":
        return None if scalar else f"{path} must be a string"
    if f.kind == "keyword":
        ok = scalar or (isinstance(v, list) and all(isinstance(x, (str, int, float, bool)) for x in v))
        return None if ok else f"{path} must be a keyword or an array of keywords"
    if f.kind == "boolean":
        return None if scalar and str(v).lower() in ("true", "false") else f"{path} must be a boolean"
    if f.kind == "long":
        ok = isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63
        return None if ok else f"{path} must be a long"
    if f.kind == "double":
        try:
            return None if scalar and not isinstance(v, bool) and float(v) is not None else f"{path} must be a double"
        except ValueError:
            return f"{path} must be a double"
    if f.kind == "datetime":
        try:
            parse_instant(v)
        except Exception as e:
            return f"{path}: {e}"
        return None
    if f.kind == "vector":
        ok = isinstance(v, list) and len(v) == f.dimensions and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v)
        return None if ok else f"{path} must be an array of {f.dimensions} numbers"
    if not isinstance(v, dict):
        return f"{path} must be an object"
    return _fields_error(v, f.children, path + ".")


def json_error(text: str | None, mapping: Mapping) -> str | None:
    try:
        return document_error(json.loads(text or ""), mapping)
    except ValueError:
        return "malformed JSON"
