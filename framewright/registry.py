"""Operators by name, so that methods, formats and reports can be added from outside."""

from __future__ import annotations

from collections.abc import Callable

from framewright import report
from framewright.operators import convert, dedup

_kinds: dict[str, dict[str, Callable]] = {
    "duplicates": {"dhash": dedup.duplicates},
    "converter": {"voc:yolo": convert.voc_to_yolo, "yolo:voc": convert.voc_records},
    "report": {"image": report.text_report},
}


def register(kind: str, name: str, operator: Callable) -> None:
    """Adds or replaces an operator of a kind."""
    _kinds.setdefault(kind, {})[name] = operator


def lookup(kind: str, name: str) -> Callable:
    """The operator of a kind and name; an unknown one is an error that names the known."""
    try:
        return _kinds[kind][name]
    except KeyError:
        raise ValueError(f"there is no {kind} {name!r}; known: {', '.join(sorted(_kinds.get(kind, {})))}") from None
