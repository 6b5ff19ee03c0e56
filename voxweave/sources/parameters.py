"""Flat reading of parameter files."""

from __future__ import annotations

import ast


def read_parameters(path: str) -> dict:
    """``key: value`` lines, nested sections flattened; comments and section heads are skipped."""
    out = {}
    with open(path) as f:
        for raw in f:
            line = raw.split("#", 1)[0].strip()
            key, sep, value = line.partition(":")
            if not sep or not value.strip():
                continue
            text = value.strip().strip('"')
            try:
                out[key.strip()] = {"true": True, "false": False}.get(text.lower(), None)
                if out[key.strip()] is None:
                    out[key.strip()] = ast.literal_eval(text)
            except (ValueError, SyntaxError):
                out[key.strip()] = text
    return out
