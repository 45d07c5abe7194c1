"""Requests of all endpoints: from a dict or JSON to checked arguments.

Unknown keys are let through unread. A missing key takes its default, and an error if it has none; so does null where
a value may be missing, and nowhere else. Whole numbers aren't negative, and those with bounds are moved to them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .model import LogError

_NO = object()


@dataclass(frozen=True)
class Field:
    read: Callable[[str, Any], Any]
    default: Any = _NO
    optional: bool = False  # null is as good as missing


def text(where: str, x) -> str:
    if not isinstance(x, str):
        raise LogError(f"'{where}' isn't a text")
    return x


def flag(where: str, x) -> bool:
    if not isinstance(x, bool):
        raise LogError(f"'{where}' is neither true nor false")
    return x


def whole(least: int | None = 0, most: int | None = None, low: int | None = None):
    """Numbers from ``least`` on; those outside ``low`` to ``most`` are moved there."""

    def read(where: str, x) -> int:
        if isinstance(x, bool) or not isinstance(x, int) or least is not None and x < least or abs(x) >= 2**63:
            raise LogError(f"'{where}' isn't a whole number" + (f" from {least} on" if least is not None else ""))
        return max(x if low is None else low, x) if most is None else min(max(x, low or 0), most)

    return read


def listed(read: Callable[[str, Any], Any]):
    def each(where: str, x) -> list:
        if not isinstance(x, list):
            raise LogError(f"'{where}' isn't a list")
        return [read(f"{where}[{i}]", y) for i, y in enumerate(x)]

    return each


def shaped(fields: dict[str, Field]):
    def read(where: str, x) -> dict:
        if not isinstance(x, dict):
            raise LogError(f"'{where}' isn't an object")
        return _fields(fields, x, f"{where}.")

    return read


def _fields(fields: dict[str, Field], found: dict, where: str = "") -> dict:
    out = {}
    for name, f in fields.items():
        if name not in found or found[name] is None and f.optional:
            if f.default is _NO:
                raise LogError(f"missing field '{where}{name}'")
            out[name] = f.default() if callable(f.default) else f.default
        else:
            out[name] = f.read(where + name, found[name])
    return out


def _maybe(read) -> Field:
    return Field(read, None, True)


_TEXTS = Field(listed(text), list)
_EDGES = Field(listed(shaped({"source": Field(text), "target": Field(text)})), list)
_MAP = {
    "object_type": Field(text), "window_size": Field(whole(most=30, low=1), 4, True), "som_width": _maybe(whole()), "som_height": _maybe(whole()),
    "epochs": Field(whole(most=500, low=10), 120, True), "color_attribute": _maybe(text),
}
#: Fields of each endpoint's request.
REQUESTS: dict[str, dict[str, Field]] = {
    "apply_filter": {
        "event_types": _TEXTS, "object_types": _TEXTS, "time_range": _maybe(shaped({"start_ms": _maybe(whole(None)), "end_ms": _maybe(whole(None))})), "df_nodes": _TEXTS, "df_edges": _EDGES,
        "text_attributes": Field(listed(shaped({"scope": Field(text, "event"), "name": Field(text), "values": _TEXTS})), list),
        "patterns": Field(listed(shaped({"family": Field(text, ""), "leading_object_type": Field(text, ""), "state": _maybe(text), "from_state": _maybe(text), "to_state": _maybe(text), "sequence": _TEXTS, "eo_edges": _EDGES, "oo_edges": _EDGES})), list),
    },
    "object_centric_graph": {"object_types": _maybe(listed(text)), "min_activity_frequency": Field(whole(), 0, True), "min_path_frequency": Field(whole(), 0, True)},
    "directly_follows_graph": {"object_type": Field(text)},
    "state_detection": _MAP,
    "state_detection_cell": _MAP | {"cell_x": Field(whole()), "cell_y": Field(whole())},
    "causal_feature_table": {"object_type": Field(text)},
    "time_perspective": {"object_type": _maybe(text), "from_state": _maybe(text), "to_state": _maybe(text), "roundtrip": Field(flag, False), "buckets": Field(whole(most=96, low=4), 24, True)},
    "state_transition_kpis": {"object_type": _maybe(text), "stuck_limit": Field(whole(most=100, low=1), 15, True)},
    "object_search": {"object_type": _maybe(text), "query": Field(text, "", True), "limit": Field(whole(most=200, low=1), 30, True)},
    "object_lifecycle_detail": {"object_id": Field(text)},
    "fit_causal_model": {
        "object_type": Field(text), "edges": _EDGES,
        "nodes": Field(listed(shaped({"id": Field(text), "label": Field(text), "role": Field(text), "feature": _maybe(text), "operation": Field(text, "")})), list),
    },
    "state_patterns": {}, "state_correlations": {}, "summary": {}, "filter_options": {},
}
REQUESTS["state_aware_graph"] = REQUESTS["object_centric_graph"]


def decode(endpoint: str, request: dict | str | bytes | None) -> dict:
    """The arguments of an endpoint, each with its value or default. LogError names the first field that is wrong."""
    if endpoint not in REQUESTS:
        raise LogError(f"no endpoint '{endpoint}'")
    if isinstance(request, str | bytes):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise LogError("the request isn't valid JSON") from e
    if not isinstance(request if request is not None else {}, dict):
        raise LogError("the request isn't an object")
    return _fields(REQUESTS[endpoint], request or {})
