"""Configuration files: JSON, or the plain subset of YAML that holds maps, lists and scalars by indentation."""

from __future__ import annotations

import json
import re
from typing import Any


def scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text.replace("_", ""))
        except ValueError:
            pass
    return text


def parse(text: str) -> Any:
    """The value of a document; comments and blank lines say nothing."""
    if text.lstrip()[:1] in ("{", "["):
        return json.loads(text)
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (re.sub(r"(^|\s)#.*$", "", raw).rstrip() for raw in text.split("\n")) if x.strip()]

    def block(at: int, indent: int) -> tuple[Any, int]:
        out: Any = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if isinstance(out, list):
                rest = line[1:].strip()
                if m := re.fullmatch(r"([\w.-]+):(?:\s+(.*))?", rest):
                    inner = indent + len(line) - len(rest)
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                    out.append(value)
                    continue
                out.append(scalar(rest))
                at += 1
                continue
            key, _, rest = line.partition(":")
            at += 1
            if rest.strip():
                out[scalar(key)] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                out[scalar(key)], at = block(at, lines[at][0])
            else:
                out[scalar(key)] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load(path: str) -> Any:
    with open(path, encoding="utf-8") as file:
        return parse(file.read())


def ladder_of(config: dict) -> list[tuple[float, float]]:
    """The (alpha, delta) rungs of a risk configuration, in order."""
    return [(float(r["alpha"]), float(r["delta"])) for r in config["alpha_delta_ladder"]]
