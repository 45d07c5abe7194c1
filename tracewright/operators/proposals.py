"""Causal models proposed as free text: the JSON in it, nodes that the feature table knows, and edges that may stay."""

from __future__ import annotations

import json
import re

from ..model import LogError
from .features import ALLOWED, OPERATIONS, CausalNode

ROLES = ("observable", "latent", "outcome")


def payload(answer: str) -> dict:
    """The object of a fenced block, or else what stands between the first and the last brace."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S | re.I)
    text = fence[1] if fence else answer
    inner = re.search(r"\{.*\}", text, re.S)
    try:
        found = json.loads(inner[0] if inner else text)
    except ValueError as e:
        raise LogError("the answer holds no JSON") from e
    if not isinstance(found, dict):
        raise LogError("the answer isn't a JSON object")
    return found


def prune(nodes: list[CausalNode], edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Edges, in their order, that join two nodes of roles that may be joined, once each, and close no cycle."""
    role, kept = {n.id: n.role for n in nodes}, []
    after: dict[str, set[str]] = {n.id: {n.id} for n in nodes}  # each node and all that it leads to
    for a, b in edges:
        if (role.get(a), role.get(b)) not in ALLOWED or a in after[b] or (a, b) in kept:
            continue
        kept.append((a, b))
        for reached in after.values():
            if a in reached:
                reached |= after[b]
    return kept


def read(answer: str, features: list[str]) -> tuple[list[CausalNode], list[tuple[str, str]]]:
    """Nodes and edges of a proposal: nodes without a known role, or observed ones without a known feature, go; ids are
    given anew; unknown operations become ``identity``. LogError if no node is left."""
    found, nodes, names = payload(answer), [], {}
    rows = lambda key: [r for r in found[key] if isinstance(r, dict)] if isinstance(found.get(key), list) else []
    for r in rows("nodes"):
        role, feature = str(r.get("role") or "").strip().lower(), str(r.get("feature") or "").strip()
        if role not in ROLES or role != "latent" and feature not in features:
            continue
        number = sum(n.role == role for n in nodes) + 1
        own = str(r.get("id") or r.get("label") or f"{role}-{len(nodes) + 1}")
        label = str(r.get("label") or r.get("name") or own).strip()
        operation = OPERATIONS.get(str(r.get("operation") or "").strip().lower(), "identity")
        node = CausalNode(f"{role}-{number}", role, None if role == "latent" else feature, "identity" if role == "latent" else operation, label)
        nodes.append(node)
        names |= {own: node.id, label: node.id}
    if not nodes:
        raise LogError("the answer has no node that can be used")
    edges = [(names.get(str(r.get("source"))), names.get(str(r.get("target")))) for r in rows("edges")]
    return nodes, prune(nodes, [(a, b) for a, b in edges if a and b])
