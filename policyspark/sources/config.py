"""Run settings from a mapping or a file: nested maps of plain values, as YAML writes them, or JSON."""

from __future__ import annotations

import json
from dataclasses import fields

from policyspark.operators.model import Options

PROVIDERS = ("ollama", "rules", "replay")


def scalar(text: str) -> object:
    """A plain YAML value: quoted or bare text, number, true, false, null, a list in brackets."""
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false", "null", "~", ""):
        return {"true": True, "false": False}.get(text.lower())
    for kind in (int, float):
        try:
            return kind(text.replace("_", ""))
        except ValueError:
            continue
    return text


def parse(text: str) -> dict:
    """Nested maps by indentation, lists of plain values under `- `; JSON too. Comments and blank lines are skipped."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    open_: list[tuple[int, dict | list, dict | None, str | None]] = [(-1, root, None, None)]
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not bare.strip():
            continue
        indent = len(bare) - len(bare.lstrip())
        while open_[-1][0] >= indent and not (bare.lstrip().startswith("- ") and open_[-1][0] == indent and isinstance(open_[-1][1], dict) and not open_[-1][1]):
            open_.pop()
        _, held, above, key = open_[-1]
        item = bare.strip()
        if item.startswith("- "):
            if isinstance(held, dict) and not held and above is not None:
                held = above[key] = []
                open_[-1] = (open_[-1][0], held, above, key)
            if not isinstance(held, list):
                raise ValueError(f"line {number}: a list item without a list")
            held.append(scalar(item[2:]))
        elif ":" in item and isinstance(held, dict):
            name, _, value = item.partition(":")
            if value.strip():
                held[name.strip()] = scalar(value)
            else:
                held[name.strip()] = {}
                open_.append((indent, held[name.strip()], held, name.strip()))
        else:
            raise ValueError(f"line {number}: neither a key nor a list item")
    return root


def options(settings: dict) -> Options:
    """The model options of a configuration: `provider`, `model`, and the maps `execution` and `service`. Unknown providers and keys are errors."""
    if settings.get("provider") not in PROVIDERS:
        raise ValueError(f"provider has to be one of {', '.join(PROVIDERS)}")
    given: dict = {}
    for part in ("execution", "service"):
        held = settings.get(part) or {}
        if not isinstance(held, dict):
            raise ValueError(f"{part} has to be a map")
        given |= held
    known = {f.name for f in fields(Options)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Options(**given)


def read(path: str) -> dict:
    """Settings of a file on any file system that Arrow knows; what is missing is an error."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_stream(inner) as f:
        return parse(f.read().decode("utf-8"))
