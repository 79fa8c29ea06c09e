"""Stringified NBT: a reader and a writer that give back what they read."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SCALAR = re.compile(r"[^\s,:{}\[\]\"'#]+")
_GAP = re.compile(r"(?:[\s,]+|#[^\n]*|//[^\n]*)*")
_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)([bBsSlLfFdD]?)\Z")
_TYPED = re.compile(r"\[\s*([BIL])\s*;")
_PLAIN = {q: re.compile(rf"[^{q}\\]*") for q in "\"'"}
_HEX = re.compile(r"[0-9a-fA-F]{4}")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class SnbtError(ValueError):
    pass


@dataclass(frozen=True)
class Tagged:
    """A number with its type's letter, or a word that is no number and no boolean."""

    text: str

    def __str__(self) -> str:
        return self.text


class TypedArray(list):
    """[B; ...], [I; ...] or [L; ...]."""

    def __init__(self, kind: str, items: list):
        super().__init__(items)
        self.kind = kind


def loads(source: str):
    """The document: dictionaries, lists, strings, booleans, numbers, Tagged and TypedArray. Commas may be missing; # and // begin comments."""
    value, at = _value(source, _skip(source, 0))
    if _skip(source, at) != len(source):
        raise SnbtError(f"more text at {at}")
    return value


def _skip(s: str, at: int) -> int:
    return _GAP.match(s, at).end()


def _value(s: str, at: int):
    """Iterative, so that depth isn't bounded by the interpreter's stack."""
    stack: list[tuple[object, object]] = []
    key = None
    while True:
        if at >= len(s):
            raise SnbtError("ends within a value")
        c = s[at]
        if stack and c == ("}" if isinstance(stack[-1][0], dict) else "]"):
            if key is not None:
                raise SnbtError(f"no value at {at}")
            done, key = stack.pop()
            at += 1
        else:
            if stack and isinstance(stack[-1][0], dict) and key is None:
                key, at = _key(s, at)
                at = _skip(s, at)
                continue
            if c == "{":
                stack.append(({}, key))
                key, at = None, _skip(s, at + 1)
                continue
            if c == "[":
                kind = _TYPED.match(s, at)
                stack.append((TypedArray(kind[1], []) if kind else [], key))
                key, at = None, _skip(s, kind.end() if kind else at + 1)
                continue
            done, at = _scalar(s, at)
        if not stack:
            return done, at
        holder = stack[-1][0]
        if isinstance(holder, dict):
            holder[key] = done
        else:
            holder.append(done)
        key, at = None, _skip(s, at)


def _key(s: str, at: int) -> tuple[str, int]:
    if s[at] in "\"'":
        name, at = _string(s, at)
    else:
        m = _SCALAR.match(s, at)
        if not m:
            raise SnbtError(f"no key at {at}")
        name, at = m[0], m.end()
    at = _skip(s, at)
    if at >= len(s) or s[at] not in ":=":
        raise SnbtError(f"no colon at {at}")
    return name, at + 1


def _string(s: str, at: int) -> tuple[str, int]:
    q, out, i = s[at], [], at + 1
    while True:
        end = _PLAIN[q].match(s, i).end()
        out.append(s[i:end])
        if end < len(s) and s[end] == q:
            return "".join(out), end + 1
        if end + 1 >= len(s):
            raise SnbtError(f"string without end at {at}")
        n = s[end + 1]
        if n == "u" and _HEX.match(s, end + 2):
            out.append(chr(int(s[end + 2 : end + 6], 16)))
            i = end + 6
        else:
            out.append(_ESCAPES.get(n, n))
            i = end + 2


def _scalar(s: str, at: int):
    if s[at] in "\"'":
        return _string(s, at)
    m = _SCALAR.match(s, at)
    if not m:
        raise SnbtError(f"no value at {at}")
    w = m[0]
    if w in ("true", "false"):
        return w == "true", m.end()
    n = _NUMBER.match(w)
    if n and not n[2]:
        return (int(n[1]) if re.fullmatch(r"[+-]?\d+", n[1]) else float(n[1])), m.end()
    return Tagged(w), m.end()


def quoted(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f")):
        text = text.replace(a, b)
    return f'"{text}"'


def dumps(value, level: int = 0, commas: bool = False) -> str:
    """Indented by tabs; a list of one scalar stays on its line; commas between entries if wanted."""
    pad, end = "\t" * (level + 1), ("," if commas else "")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, dict):
        if not value:
            return "{ }"
        rows = [f"{pad}{k if re.fullmatch(r'[A-Za-z0-9_.+-]+', k) else quoted(k)}: {dumps(v, level + 1, commas)}" for k, v in value.items()]
        return "{\n" + f"{end}\n".join(rows) + "\n" + pad[:-1] + "}"
    if isinstance(value, TypedArray):
        return f"[{value.kind};" + ",".join(" " + dumps(v, level + 1) for v in value) + "]"
    if isinstance(value, list):
        if not value:
            return "[ ]"
        if len(value) == 1 and not isinstance(value[0], (dict, list)):
            return f"[{dumps(value[0], level, commas)}]"
        return "[\n" + f"{end}\n".join(pad + dumps(v, level + 1, commas) for v in value) + "\n" + pad[:-1] + "]"
    return str(value)
