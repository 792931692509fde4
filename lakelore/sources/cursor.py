"""Cursors of incremental sources: opaque strings that hold JSON."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable


class CursorError(ValueError):
    pass


class Cursor:
    """Encodes a cursor's fields; decoding an unknown or broken string gives ``fresh``, unless strict."""

    def __init__(self, name: str, normalise: Callable[[dict], dict], fresh: dict | None = None):
        self.name, self.normalise, self.fresh = name, normalise, fresh or {}

    def encode(self, fields: dict) -> str:
        return base64.b64encode(json.dumps(self.normalise(fields), sort_keys=True, separators=(",", ":")).encode()).decode()

    def decode(self, text: str | None, strict: bool = False) -> dict:
        if not text:
            return dict(self.fresh)
        try:
            return self.normalise(json.loads(base64.b64decode(text, validate=True)))
        except (ValueError, TypeError, KeyError, AttributeError) as e:
            if strict:
                raise CursorError(f"{self.name}: {e}") from e
            return dict(self.fresh)
