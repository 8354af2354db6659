"""Text templates: {{ expression }}, {% if %}, {% elif %}, {% else %}, {% endif %}, {% for x in %}, {% endfor %}, {% set x = %}.

Expressions are Python's without calls but range and len, attributes, or assignments; they read the values given and nothing else.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Mapping
from typing import Any

PART = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
CALLS = {"range": range, "len": len}
BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
COMPARE: dict[type, Callable] = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not,
}


def value_of(text: str, values: Mapping[str, Any]) -> Any:
    """An expression's value; names that aren't given are an error."""

    def walk(n: ast.AST) -> Any:
        match n:
            case ast.Expression():
                return walk(n.body)
            case ast.Constant():
                return n.value
            case ast.Name():
                if n.id.lower() in ("true", "false", "none"):
                    return {"true": True, "false": False, "none": None}[n.id.lower()]
                if n.id not in values:
                    raise ValueError(f"no value for {n.id}")
                return values[n.id]
            case ast.List() | ast.Tuple():
                return [walk(x) for x in n.elts]
            case ast.Subscript():
                return walk(n.value)[walk(n.slice)]
            case ast.BoolOp():
                found = None
                for x in n.values:
                    found = walk(x)
                    if bool(found) == isinstance(n.op, ast.Or):
                        break
                return found
            case ast.UnaryOp(op=ast.Not()):
                return not walk(n.operand)
            case ast.UnaryOp(op=ast.USub()):
                return -walk(n.operand)
            case ast.IfExp():
                return walk(n.body if walk(n.test) else n.orelse)
            case ast.BinOp() if type(n.op) in BINARY:
                return BINARY[type(n.op)](walk(n.left), walk(n.right))
            case ast.Compare():
                left = walk(n.left)
                for op, x in zip(n.ops, n.comparators, strict=True):
                    right = walk(x)
                    if not COMPARE[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.Call(func=ast.Name(id=name), keywords=[]) if name in CALLS:
                return CALLS[name](*map(walk, n.args))
        raise ValueError(f"not allowed in a template: {text.strip()}")

    return walk(ast.parse(text.strip(), mode="eval"))


def render(text: str, **values: Any) -> str:
    """The text with its conditions, loops and expressions worked out."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in PART.finditer(text):
        parts.append(("text", text[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            parts.append(("value", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
    parts.append(("text", text[at:]))
    out, end = _block(parts, 0, dict(values), True)
    if end < len(parts):
        raise ValueError(f"{parts[end][1]} without its beginning")
    return out


def _block(parts: list[tuple[str, str]], at: int, values: dict[str, Any], live: bool) -> tuple[str, int]:
    """The text up to a tag that ends or parts a block, and that tag's place."""
    out = []
    while at < len(parts):
        kind, text = parts[at]
        word = text.split(None, 1)[0] if kind == "tag" and text else ""
        if word in ("elif", "else", "endif", "endfor"):
            break
        at += 1
        if kind == "text":
            out.append(text if live else "")
        elif kind == "value":
            out.append(str(value_of(text, values)) if live else "")
        elif word == "set":
            name, _, what = text[3:].partition("=")
            if live:
                values[name.strip()] = value_of(what, values)
        elif word == "if":
            done = False
            test = text[2:]
            while True:
                take = live and not done and (test is None or bool(value_of(test, values)))
                found, at = _block(parts, at, values, take)
                out.append(found)
                done |= take
                if at == len(parts) or parts[at][1].startswith("endfor"):
                    raise ValueError("if without endif")
                tag = parts[at][1]
                at += 1
                if tag.startswith("endif"):
                    break
                test = tag[4:] if tag.startswith("elif") else None
        elif word == "for":
            name, _, what = text[3:].partition(" in ")
            start = at
            for x in value_of(what, values) if live else ():
                found, at = _block(parts, start, values | {name.strip(): x}, True)
                out.append(found)
            if at == start:
                _, at = _block(parts, start, values, False)
            if at == len(parts) or not parts[at][1].startswith("endfor"):
                raise ValueError("for without endfor")
            at += 1
        else:
            raise ValueError(f"unknown tag {text}")
    return "".join(out), at
