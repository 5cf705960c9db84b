"""A line-oriented reader of a subset of Ruby: source text to facts.

It reads namespaces, methods with their parameters, accessors, mixins, constants, aliases,
visibility, variables, comments and constant and method references; strings, comments and heredocs are
blanked first. The grammar's rest (one-line blocks, operators, interpolation) is passed over
without harm to what surrounds it. Each file is read on its own, inside a mapInArrow task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: One row for each definition, reference or diagnostic. scope: ids of the enclosing definitions, outermost first.
FACTS = (
    "uri string, id long, fact string, kind string, path string, start int, end int, line int, scope array<long>, singleton boolean, visibility string, "
    "deprecated boolean, promotable boolean, old string, target string, superclass string, mixins array<struct<kind: string, target: string>>, params array<struct<kind: string, name: string>>, comments array<string>, receiver string, lexical array<string>"
)
_PATH = r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*"
_OPENERS = re.compile(r"^\s*(?:if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|(?:^|=|\()\s*(?:if|unless|case|begin|while)\b(?!.*\bend\b)")


_MARK = re.compile("[#\"'`<=]")
_HEREDOC = re.compile(r"<<[~-]?(['\"]?)([A-Z_]+)\1")


def blank(source: str) -> str:
    """The source with strings and comments overwritten by spaces, of the same length."""
    out, i, n = list(source), 0, len(source)
    while mark := _MARK.search(source, i):
        i = mark.start()
        c = source[i]
        if source.startswith("=begin", i) and (i == 0 or source[i - 1] == "\n"):
            j = source.find("\n=end", i)
            j = n if j < 0 else j + 5
        elif c == "#":
            j = source.find("\n", i)
            j = n if j < 0 else j
        elif c in "\"'`" and not (i and source[i - 1] in "$?"):
            j = i + 1
            while j < n and source[j] != c:
                j += 2 if source[j] == "\\" else 1
            j = min(n, j + 1)
        elif m := _HEREDOC.match(source, i):
            eol = source.find("\n", i)
            stop = re.compile(rf"^\s*{m[2]}\s*$", re.M).search(source, eol) if eol >= 0 else None
            if stop:
                for k in range(eol + 1, stop.end()):
                    if source[k] != "\n":
                        out[k] = " "
            i = m.end()
            continue
        else:
            i += 1
            continue
        for k in range(i, j):
            if source[k] != "\n":
                out[k] = " "
        i = j
    return "".join(out)


@dataclass
class _Frame:
    kind: str  # class, module, singleton, def, block
    id: int | None
    visibility: str = "public"


@dataclass
class Reader:
    uri: str
    source: str
    rows: list[dict] = field(default_factory=list)
    by_id: dict[int, dict] = field(default_factory=dict)

    def read(self) -> list[dict]:
        text = blank(self.source)
        frames: list[_Frame] = [_Frame("top", None, "private")]
        comments: list[str] = []
        at = 0
        raw_lines = self.source.split("\n")
        for no, line in enumerate(text.split("\n")):
            raw = raw_lines[no] if no < len(raw_lines) else ""
            if raw.strip().startswith("#"):
                comments.append(raw.strip())
            elif line.strip():
                rest = line
                for part in self._statements(rest):
                    offset, stmt = part
                    self._statement(stmt, at + offset, no + 1, frames, comments, raw)
                comments = []
            elif not raw.strip():
                comments = []
            at += len(line) + 1
        if len(frames) > 1:
            self._add("diagnostic", "ParseError", "unexpected end of file", len(self.source), len(self.source), len(raw_lines), frames)
        return self.rows

    @staticmethod
    def _statements(line: str) -> Iterator[tuple[int, str]]:
        at = 0
        for part in line.split(";"):
            if part.strip():
                yield at + len(part) - len(part.lstrip()), part.strip()
            at += len(part) + 1

    def _byte(self, at: int) -> int:
        return len(self.source[:at].encode()) if not self.source.isascii() else at

    def _add(self, fact: str, kind: str, path: str | None, start: int, end: int, line: int, frames: list[_Frame], **more) -> dict:
        scope = [f.id for f in frames if f.id is not None and f.kind in ("class", "module", "singleton")]
        row = {"uri": self.uri, "fact": fact, "kind": kind, "path": path, "start": self._byte(start), "end": self._byte(end), "line": line, "scope": scope, "singleton": False, "deprecated": False, "promotable": False, "mixins": [], "params": [], "comments": [], **more}
        # The scopes' names, if each is what its text says: a first guess for the resolver.
        names: list[str] = []
        for r in (self.by_id[i] for i in scope):
            own = r["path"].removeprefix("::")
            if r["kind"] == "SingletonClass":
                of = names[-1] if own == "self" and names else own
                names.append(f"{of}::<{of.split('::')[-1]}>")
            else:
                names.append(own if not names or r["path"].startswith("::") else f"{names[-1]}::{own}")
        row["lexical"] = names
        row["id"] = _identity(self.uri, row["start"], fact, kind, path or "", str(len(self.rows)))
        self.rows.append(row)
        self.by_id[row["id"]] = row
        return row

    def _space(self, frames: list[_Frame]) -> _Frame:
        return next(f for f in reversed(frames) if f.kind in ("class", "module", "singleton", "top"))

    def _refs(self, text: str, at: int, line: int, frames: list[_Frame]) -> None:
        for m in re.finditer(rf"(?<![\w@$:.]){_PATH}", text):
            path = m.group()
            parts = path.split("::")
            for k in range(1, len(parts) + 1):
                sub = "::".join(parts[:k])
                if sub:
                    self._add("constant", "ref", sub, at + m.start(), at + m.start() + len(sub), line, frames)
        for m in re.finditer(rf"(?:({_PATH}|[\w@$]+)\s*(?:&\.|\.))?([a-z_]\w*[?!]?)\s*(?=\()|({_PATH}|[\w@$]+)(?:&\.|\.)([a-z_]\w*[?!]?)", text):
            name, receiver = (m[2], m[1]) if m[2] else (m[4], m[3])
            if name not in _WORDS:
                self._add("call", "ref", name, at + m.start(), at + m.end(), line, frames, receiver=receiver if receiver and re.fullmatch(_PATH, receiver) else None)

    def _head(self, path: str, at: int, line: int, frames: list[_Frame]) -> None:
        """References to what a defined path stands in."""
        head = path.rpartition("::")[0]
        if head:
            self._refs(head, at, line, frames)

    def _variables(self, text: str, at: int, line: int, frames: list[_Frame]) -> None:
        in_method = any(f.kind == "def" for f in frames)
        for m in re.finditer(r"(@@|@|\$)([A-Za-z_]\w*)\s*(?:\|\||&&|[-+*/|&])?=(?![=~>])", text):
            kind = {"@@": "ClassVariable", "@": "InstanceVariable", "$": "GlobalVariable"}[m[1]]
            self._add("definition", kind, m[1] + m[2], at + m.start(), at + m.end(), line, frames, singleton=kind == "InstanceVariable" and not in_method)

    def _statement(self, s: str, at: int, line: int, frames: list[_Frame], comments: list[str], raw: str) -> None:
        deprecated = any(re.match(r"#\s*@deprecated", c) for c in comments)
        common = {"comments": list(comments), "deprecated": deprecated}
        space = self._space(frames)
        if re.match(r"end\b", s):
            if len(frames) > 1:
                frames.pop()
            else:
                self._add("diagnostic", "ParseError", "unexpected 'end'", at, at + 3, line, frames)
            return
        if m := re.match(rf"class\s+<<\s*(self|{_PATH})\s*$", s):
            row = self._add("definition", "SingletonClass", m[1], at, at + len(s), line, frames, **common)
            frames.append(_Frame("singleton", row["id"]))
            return
        if re.match(r"class\s+<<", s):
            self._add("diagnostic", "DynamicSingletonDefinition", "singleton class of an expression", at, at + len(s), line, frames)
            frames.append(_Frame("block", None))
            return
        if m := re.match(rf"(class|module)\s+({_PATH})\s*(?:<\s*(.+?))?\s*$", s):
            up = None
            self._head(m[2], at + m.start(2), line, frames)
            if m[1] == "class" and m[3]:
                if c := re.match(_PATH, m[3]):
                    up = c.group()
                    self._refs(up, at + m.start(3), line, frames)
                else:
                    self._add("diagnostic", "DynamicAncestor", "the superclass is no constant", at + m.start(3), at + m.end(3), line, frames)
            row = self._add("definition", m[1].capitalize(), m[2], at, at + len(s), line, frames, superclass=up, **common)
            frames.append(_Frame(m[1], row["id"]))
            return
        if m := re.match(rf"({_PATH})\s*=\s*(Class|Module)\.new(?:\(({_PATH})\))?(\s+do)?\s*$", s):
            row = self._add("definition", m[2], m[1], at, at + len(s), line, frames, superclass=m[3], **common)
            if m[4]:
                frames.append(_Frame(m[2].lower(), row["id"]))
            return
        inline = re.match(r"(private|protected|public|module_function|private_class_method|public_class_method)\s+(?=def\b|attr)", s)
        vis = space.visibility
        if inline:
            vis = inline[1]
            at, s = at + inline.end(), s[inline.end() :]
        if m := re.match(rf"def\s+(?:(self|{_PATH})\.)?([A-Za-z_]\w*[?!=]?|[-+*/%<>=!~^&|\[\]]+)\s*(\(.*?\)|\s[^=].*)?\s*(=.*)?$", s):
            singleton = bool(m[1])
            seen = "public" if singleton and not vis.endswith("_class_method") else vis.replace("_class_method", "")
            self._add("definition", "Method", f"{m[2]}()", at, at + len(s), line, frames, visibility=seen, params=_params(m[3] or ""), receiver=m[1], singleton=singleton, **common)
            if m[4]:
                self._refs(m[4], at + m.start(4), line, frames)
            else:
                frames.append(_Frame("def", None))
                if re.search(r"\bend$", s):
                    frames.pop()
            return
        if m := re.match(r"(attr_accessor|attr_reader|attr_writer|attr)\b\s*\(?(.*?)\)?$", s):
            kind = {"attr_accessor": "AttrAccessor", "attr_writer": "AttrWriter"}.get(m[1], "AttrReader")
            names = self.source[at + m.start(2) : at + m.end(2)] if len(self.source) > at else m[2]
            for n in re.findall(r"(?::|[\"'])([A-Za-z_]\w*[?!]?)[\"']?", names):
                self._add("definition", kind, f"{n}()", at, at + len(s), line, frames, visibility="private" if vis == "module_function" else vis, **common)
            return
        if m := re.match(r"(include|prepend|extend)\b\s*\(?(.*?)\)?$", s):
            if space.id is None:
                if "self" in m[2]:
                    self._add("diagnostic", "TopLevelMixinSelf", "self can't be mixed in at the top level", at, at + len(s), line, frames)
                self._refs(m[2], at + m.start(2), line, frames)
                return
            owner = self.by_id[space.id]
            found = [x.strip() for x in m[2].split(",") if x.strip()]
            for x in reversed(found):
                if re.fullmatch(_PATH, x):
                    owner["mixins"].append({"kind": m[1], "target": x})
                elif x != "self":
                    self._add("diagnostic", "DynamicAncestor", "what is mixed in is no constant", at, at + len(s), line, frames)
            self._refs(m[2], at + m.start(2), line, frames)
            return
        if m := re.match(r"(private|protected|public|module_function)\s*$", s):
            space.visibility = m[1]
            return
        if m := re.match(r"(private|protected|public|module_function|private_class_method|public_class_method)\b\s*\(?(.+?)\)?$", s):
            names = re.findall(r":([A-Za-z_]\w*[?!=]?)", m[2])
            if not names:
                self._add("diagnostic", "InvalidMethodVisibility", "no literal names", at, at + len(s), line, frames)
            for n in names:
                self._add("definition", "MethodVisibility", f"{n}()", at, at + len(s), line, frames, visibility=m[1].replace("_class_method", ""), singleton=m[1].endswith("_class_method"))
            return
        if m := re.match(r"(private|public)_constant\b\s*\(?(.+?)\)?$", s):
            names = re.findall(r":([A-Z]\w*)", m[2])
            if not names or space.id is None:
                self._add("diagnostic", "InvalidConstantVisibility", "no literal names in a namespace", at, at + len(s), line, frames)
            for n in names if space.id is not None else []:
                self._add("definition", "ConstantVisibility", n, at, at + len(s), line, frames, visibility=m[1])
            return
        if m := re.match(r"alias\s+(\$\w+)\s+(\$\w+)", s):
            self._add("definition", "GlobalVariableAlias", m[1], at, at + len(s), line, frames, old=m[2])
            return
        if m := re.match(r"alias\s+:?([\w?!=]+)\s+:?([\w?!=]+)", s) or re.match(r"alias_method\b\s*\(?\s*:([\w?!=]+)\s*,\s*:([\w?!=]+)\s*\)?$", s):
            self._add("definition", "AliasMethod", f"{m[1]}()", at, at + len(s), line, frames, old=f"{m[2]}()", **common)
            self._add("call", "ref", f"{m[2]}()", at, at + len(s), line, frames)
            return
        if m := re.match(rf"((?:{_PATH}\s*,\s*)*{_PATH})\s*(\|\|)?=(?![=~>])\s*(.*)$", s):
            value = m[3].strip()
            for n in [x.strip() for x in m[1].split(",")]:
                self._head(n, at, line, frames)
                if re.fullmatch(_PATH, value):
                    self._add("definition", "ConstantAlias", n, at, at + len(s), line, frames, target=value, **common)
                else:
                    call = bool(re.match(rf"(?:{_PATH}|[a-z_]\w*)(?:\.\w+)*[.(]?", value)) and not re.search(r"^[\d\"'\[{:]", value)
                    self._add("definition", "Constant", n, at, at + len(s), line, frames, promotable=call and bool(value), **common)
            self._refs(m[3], at + m.start(3), line, frames)
            if _OPENERS.search(value):
                frames.append(_Frame("block", None))
            return
        self._variables(s, at, line, frames)
        self._refs(s, at, line, frames)
        if _OPENERS.search(s) and not re.search(r"\bend\b", s):
            frames.append(_Frame("block", None))


_WORDS = {"if", "unless", "while", "until", "case", "when", "and", "or", "not", "return", "yield", "super", "self", "def", "class", "module", "end", "do", "then", "else", "elsif", "in", "defined"}


def _identity(*parts) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh64("\0".join(map(str, parts)).encode(), seed=42).digest(), "big", signed=True)


def _params(text: str) -> list[dict]:
    out, rest = [], False
    for p in [x.strip() for x in text.strip().strip("()").split(",") if x.strip()]:
        if p.startswith("**"):
            kind, name = "rest_keyword", p[2:]
        elif p.startswith("*"):
            kind, name, rest = "rest_positional", p[1:], True
        elif p.startswith("&"):
            kind, name = "block", p[1:]
        elif p == "...":
            kind, name = "forward", "..."
        elif m := re.match(r"(\w+):(.*)$", p):
            kind, name = ("optional_keyword" if m[2].strip() else "required_keyword"), m[1]
        elif "=" in p:
            kind, name = "optional_positional", p.split("=")[0].strip()
        else:
            kind, name = ("post" if rest else "required_positional"), p
        out.append({"kind": kind, "name": name})
    return out
