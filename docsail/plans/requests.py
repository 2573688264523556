"""The JSON query language: validated requests to query trees."""

from __future__ import annotations

from docsail.errors import bad_request
from docsail.plans.grammar import MAX_CLAUSES, parse, with_field
from docsail.plans.nodes import FILTER, MUST, MUST_NOT, SHOULD, Boolean, Boost, Everything, Match, Nearest, Node, Term
from docsail.schema import Mapping

OCCURS = (MUST, SHOULD, MUST_NOT, FILTER)
MAX_CANDIDATES = 5000


def read_query(query: dict, mapping: Mapping) -> Node:
    """One of bool, queryString or knn, the first present in this order."""
    if not isinstance(query, dict):
        raise bad_request("query must be an object")
    if "bool" in query:
        return _bool(query["bool"], mapping)
    if "queryString" in query:
        return _query_string(query["queryString"], mapping)
    if "knn" in query:
        return _nearest(query["knn"], mapping)
    raise bad_request("query needs one of bool, queryString or knn")


def _boosted(node: Node, spec: dict) -> Node:
    boost = spec.get("boost")
    if boost is None:
        return node
    if isinstance(boost, bool) or not isinstance(boost, (int, float)) or boost < 0:
        raise bad_request("boost must be a number of at least 0")
    return Boost(node, float(boost))


def _bool(clauses: list, mapping: Mapping) -> Node:
    if not isinstance(clauses, list) or not clauses:
        raise bad_request("bool must be a non-empty array")
    if len(clauses) > MAX_CLAUSES:
        raise bad_request(f"more than {MAX_CLAUSES} clauses")
    out = []
    for clause in clauses:
        if not isinstance(clause, dict):
            raise bad_request("a clause must be an object")
        occur = str(clause.get("occur") or SHOULD).upper()
        if occur not in OCCURS:
            raise bad_request(f"occur must be one of {', '.join(OCCURS)}")
        kind = next((k for k in ("bool", "knn", "queryString") if k in clause), None)
        if kind is None:
            raise bad_request("a clause needs one of bool, knn or queryString")
        out.append((occur, _boosted(read_query({kind: clause[kind]}, mapping), clause)))
    return Boolean(tuple(out))


def _query_string(spec: dict, mapping: Mapping) -> Node:
    if not isinstance(spec, dict) or not isinstance(spec.get("query"), str) or not spec["query"].strip():
        raise bad_request("query must not be empty")
    text, default = spec["query"], spec.get("defaultField")
    if default is not None and mapping.leaf(default) is None:
        raise bad_request(f"unknown default field '{default}'")
    if text.strip() == "*:*":
        return Everything()  # a boost beside it has no effect
    if spec.get("skipSyntax"):
        if default is None:
            raise bad_request("skipSyntax needs defaultField")
        return Match(default, text)
    return _boosted(resolved(parse(text), mapping, default), spec)


def resolved(node: Node, mapping: Mapping, default: str | None) -> Node:
    """The tree with the default field filled in; an undeclared x:y is the words x y on that field, and an error without one."""
    if isinstance(node, Boolean):
        return Boolean(tuple((o, resolved(n, mapping, default)) for o, n in node.clauses))
    if isinstance(node, Boost):
        return Boost(resolved(node.node, mapping, default), node.factor)
    if not hasattr(node, "field"):
        return node
    if node.field is not None and mapping.leaf(node.field) is not None:
        return node
    if default is None:
        raise bad_request(f"unknown field '{node.field}'" if node.field else "a word without a field needs defaultField")
    if node.field is None:
        return with_field(node, default)
    if isinstance(node, Term):
        return Term(default, f"{node.field} {node.text}")
    raise bad_request(f"unknown field '{node.field}'")


def _nearest(spec: dict, mapping: Mapping) -> Node:
    if not isinstance(spec, dict):
        raise bad_request("knn must be an object")
    field, vector, k = spec.get("field"), spec.get("queryVector"), spec.get("k")
    declared = mapping.leaf(field) if isinstance(field, str) else None
    if declared is None or declared.kind != "vector":
        raise bad_request(f"'{field}' is not a vector field")
    if not isinstance(vector, list) or len(vector) != declared.dimensions:
        raise bad_request(f"queryVector must have {declared.dimensions} numbers")
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise bad_request("k must be above 0")
    candidates = spec.get("numCandidates")
    if not k <= (k if candidates is None else candidates) <= MAX_CANDIDATES:
        raise bad_request(f"numCandidates must be from k to {MAX_CANDIDATES}")
    chosen = spec.get("filter")
    if chosen is not None:
        kind = next((x for x in ("queryString", "bool") if x in chosen), None)
        if kind is None:
            raise bad_request("filter needs queryString or bool")
        chosen = read_query({kind: chosen[kind]}, mapping)
    return _boosted(Nearest(field, tuple(float(x) for x in vector), k, chosen), spec)
