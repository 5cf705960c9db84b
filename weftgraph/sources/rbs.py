"""A reader of signature files (.rbs): declarations of types to the same facts as source files give.

Declarations are read as logical lines: a line goes on while a bracket is open or the next one begins
with '|'. Type aliases, interfaces, type variables and instance variables' types give no facts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .ruby import Reader, _Frame

_PATH = r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*"
_NAME = r"[A-Za-z_]\w*[?!=]?|`[^`]+`|\[\]=?|[-+*/%<>=!~^&|]+@?"
_OPEN, _CLOSE = "([{", ")]}"


def strip_comments(source: str) -> str:
    """The source with comments, strings and annotations' texts blanked, of the same length."""
    out, i, n = list(source), 0, len(source)
    while i < n:
        c = source[i]
        if c == "#":
            j = source.find("\n", i)
            j = n if j < 0 else j
        elif c in "\"'":
            j = i + 1
            while j < n and source[j] not in (c, "\n"):
                j += 2 if source[j] == "\\" else 1
            j = min(n, j + 1)
        else:
            i += 1
            continue
        for k in range(i, j):
            if source[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out)


def logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """(offset, statement) of the statements."""
    begin, held, depth = None, "", 0
    at = 0
    for line in [*text.split("\n"), ""]:
        more = depth > 0 or line.lstrip().startswith("|") or held.rstrip().endswith(("->", ":", "|", ",", "<"))
        if held.strip() and not more:
            lead = len(held) - len(held.lstrip())
            yield begin + lead, held.strip()
            held, begin, depth = "", None, 0
        if begin is None:
            begin, held = at, line
        else:
            held += "\n" + line
        plain = re.sub(r"->|[<>=]+", "  ", line)
        depth += sum(c in _OPEN for c in plain) - sum(c in _CLOSE for c in plain)
        at += len(line) + 1
    if held.strip():
        yield begin + len(held) - len(held.lstrip()), held.strip()


def split_top(text: str, sign: str) -> list[str]:
    """The parts of text between signs that are outside all brackets."""
    parts, depth, last = [], 0, 0
    masked = text.replace("->", "  ")
    for i, c in enumerate(masked):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif c == sign and not depth:
            parts.append(text[last:i])
            last = i + 1
    return [*parts, text[last:]]


def inside(text: str, at: int) -> str:
    """What stands between the bracket at a place and the one that closes it."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] in _OPEN) - (text[i] in _CLOSE)
        if not depth:
            return text[at + 1 : i]
    return text[at + 1 :]


def parameters(signature: str) -> list[dict]:
    """(kind, name) of the parameters of one signature; a block last."""
    sig = signature.strip()
    if sig.startswith("["):
        sig = sig[len(inside(sig, 0)) + 2 :].strip()
    out: list[dict] = []
    places, rest = 0, sig
    keys: dict[str, list[dict]] = {"required_keyword": [], "optional_keyword": []}
    tail: list[dict] = []
    if sig.startswith("("):
        body = inside(sig, 0)
        rest = sig[len(body) + 2 :]
        seen_rest = False
        for p in [x.strip() for x in split_top(body, ",") if x.strip()]:
            if p == "?":
                return []
            named = re.search(r"(?<![\w:])([a-z_]\w*)$", p)
            bare = named is None or re.fullmatch(r"[*?]*[a-z_]\w*", p) is not None
            if p.startswith("**"):
                tail.append({"kind": "rest_keyword", "name": "kwargs" if bare else named[1]})
            elif p.startswith("*"):
                out.append({"kind": "rest_positional", "name": "args" if bare else named[1]})
                seen_rest = True
            elif m := re.match(r"(\?)?([a-z_A-Z]\w*[?!]?)\s*:(?!:)", p):
                kind = "optional_keyword" if m[1] else "required_keyword"
                keys[kind].append({"kind": kind, "name": m[2]})
            else:
                kind = "optional_positional" if p.startswith("?") else "post" if seen_rest or any(x["kind"] == "optional_positional" for x in out) else "required_positional"
                out.append({"kind": kind, "name": f"arg{places}" if bare else named[1]})
                places += 1
    found = [*out, *keys["required_keyword"], *keys["optional_keyword"], *tail]
    return [*found, {"kind": "block", "name": "block"}] if re.match(r"\s*\??\s*\{", rest) else found


class SignatureReader(Reader):
    def read(self) -> list[dict]:
        text = strip_comments(self.source)
        frames: list[_Frame] = [_Frame("top", None, "public")]
        lines = self.source.split("\n")
        deprecated = False
        for at, s in logical_lines(text):
            line = self.source.count("\n", 0, at)
            while m := re.match(r"%a(\{[^}]*\}|\([^)]*\)|\[[^\]]*\])\s*", s):
                note = self.source[at + 3 : at + m.end(1) - 1]
                deprecated |= note == "deprecated" or note.startswith("deprecated:")
                s, at = s[m.end() :], at + m.end()
            if not s:
                continue
            k = self.source.count("\n", 0, at) - 1
            comments: list[str] = []
            while k >= 0 and lines[k].strip().startswith(("#", "%a")):
                comments = ([lines[k].strip()] if lines[k].strip().startswith("#") else []) + comments
                k -= 1
            self._declaration(s, at, line + 1, frames, {"comments": comments, "deprecated": deprecated})
            deprecated = False
        if len(frames) > 1:
            self._add("diagnostic", "ParseError", "unexpected end of file", 0, 0, 1, frames)
        return self.rows

    def _refer(self, path: str, at: int, line: int, frames: list[_Frame]) -> None:
        parts = path.split("::")
        for k in range(1, len(parts) + 1):
            sub = "::".join(parts[:k])
            if sub:
                self._add("constant", "ref", sub, at, at + len(sub), line, frames)

    def _declaration(self, s: str, at: int, line: int, frames: list[_Frame], common: dict) -> None:
        space = self._space(frames)
        if re.match(r"end\b", s):
            if len(frames) > 1:
                frames.pop()
            else:
                self._add("diagnostic", "ParseError", "unexpected 'end'", at, at + 3, line, frames)
        elif re.match(r"(?:type|use)\b", s) or re.match(rf"(?:class|module)\s+{_PATH}\s*=", s):
            return
        elif re.match(r"interface\b", s):
            frames.append(_Frame("block", None))
        elif any(f.kind == "block" for f in frames):
            return
        elif m := re.match(rf"(class|module)\s+({_PATH})\s*(?:\[[^\]]*\])?\s*(?:<\s*({_PATH}))?", s):
            head = m[2].rpartition("::")[0]
            if head:
                self._refer(head, at + m.start(2), line, frames)
            up = m[3] if m[1] == "class" else None
            if up:
                self._refer(up, at + m.start(3), line, frames)
            row = self._add("definition", m[1].capitalize(), m[2], at, at + len(s), line, frames, superclass=up, **common)
            if not re.search(r"\bend$", s):
                frames.append(_Frame(m[1], row["id"]))
        elif m := re.match(rf"(include|prepend|extend)\s+({_PATH})", s):
            if space.id is not None:
                self.by_id[space.id]["mixins"].append({"kind": m[1], "target": m[2]})
                self._refer(m[2], at + m.start(2), line, frames)
        elif m := re.fullmatch(r"(public|private)", s):
            space.visibility = m[1]
        elif m := re.match(rf"alias\s+(self\.)?({_NAME})\s+(?:self\.)?({_NAME})", s):
            self._add("definition", "AliasMethod", f"{m[2]}()", at, at + len(s), line, frames, old=f"{m[3]}()", singleton=bool(m[1]), **common)
        elif m := re.match(r"(?:(public|private)\s+)?attr_(reader|writer|accessor)\s+(self\.)?(\w+[?!]?)", s):
            seen = m[1] or ("public" if m[3] else space.visibility)
            for name, params in ((m[4], []), (m[4] + "=", [{"kind": "required_positional", "name": m[4]}])):
                if m[2] == "accessor" or (m[2] == "writer") == name.endswith("="):
                    self._add("definition", "Method", f"{name}()", at, at + len(s), line, frames, visibility=seen, params=params, receiver="self" if m[3] else None, singleton=bool(m[3]), **common)
        elif m := re.match(rf"(?:(public|private)\s+)?def\s+(self\??\.)?({_NAME})\s*:\s*(.*)$", s, re.S):
            params: list[dict] = []
            for i, sig in enumerate(x for x in split_top(m[4], "|") if x.strip() not in ("", "...")):
                params += ([{"kind": "overload", "name": str(i)}] if i else []) + parameters(sig)
            both = m[2] == "self?."
            for singleton in (True, False) if both else (bool(m[2]),):
                seen = ("public" if singleton else "private") if both else m[1] or ("public" if singleton else space.visibility)
                self._add("definition", "Method", f"{m[3].strip('`')}()", at, at + len(s), line, frames, visibility=seen, params=params, receiver="self" if singleton else None, singleton=singleton, **common)
        elif m := re.match(r"(\$\w+)\s*:", s):
            self._add("definition", "GlobalVariable", m[1], at, at + len(s), line, frames, **common)
        elif m := re.match(rf"({_PATH})\s*:(?!:)", s):
            head = m[1].rpartition("::")[0]
            if head:
                self._refer(head, at, line, frames)
            self._add("definition", "Constant", m[1], at, at + len(s), line, frames, promotable=True, **common)
        elif not re.match(r"@@?\w+\s*:|self\.@", s):
            self._add("diagnostic", "ParseError", "not a declaration", at, at + len(s), line, frames)
