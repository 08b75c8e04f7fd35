"""Request envelopes {RequestType, CorrelationId, Data} and the registry that serves them in process."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

_handlers: dict[str, Callable[..., Any]] = {}


def handles(request_type: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    def put(f: Callable[..., Any]) -> Callable[..., Any]:
        _handlers[request_type] = f
        return f

    return put


def dispatch(envelope: dict[str, Any], **context: Any) -> dict[str, Any]:
    """Success with the handler's value, or the error; an unknown type is an error too."""
    reply = {"CorrelationId": envelope.get("CorrelationId") or str(uuid.uuid4())}
    handler = _handlers.get(envelope.get("RequestType", ""))
    if handler is None:
        return reply | {"Success": False, "Error": f"Unknown request type {envelope.get('RequestType')}"}
    try:
        return reply | {"Success": True, "Data": handler(**(envelope.get("Data") or {}), **context)}
    except Exception as error:  # the envelope carries every failure back to the caller
        return reply | {"Success": False, "Error": str(error)}
