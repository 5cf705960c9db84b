"""Names, paths, locations and matching: the scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unqualified(name: Column | str) -> Column:
    """What follows the last '::', and in that the last '#'."""
    return F.element_at(F.split(F.element_at(F.split(_c(name), "::"), -1), "#"), -1)


def strip_top(name: Column | str) -> Column:
    """A name without one leading '::'."""
    return F.regexp_replace(_c(name), "^::", "")


def constant_name(owner: Column, name: Column) -> Column:
    return F.when(owner.isNull() | (owner == "Object"), name).otherwise(F.concat(owner, F.lit("::"), name))


def member_name(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("#"), name)


def singleton_name(owner: Column) -> Column:
    return F.concat(owner, F.lit("::<"), unqualified(owner), F.lit(">"))


def fuzzy_pattern(query: str) -> str:
    """A pattern that matches where the query's characters occur in order, ASCII letters in either case."""
    return "(?is)^" + "".join(".*?" + re.escape(c) for c in query)


def fuzzy_score(name: Column | str, query: str) -> Column:
    """Matched characters: all of the query's, or 0."""
    return F.when(_c(name).rlike(fuzzy_pattern(query)), F.lit(len(query))).otherwise(F.lit(0))


def _head(text: Column | str, offset: Column) -> Column:
    """The first bytes of a text, each as one character."""
    return F.decode(F.substring(F.encode(_c(text), "UTF-8"), F.lit(1), offset.cast("int")), "ISO-8859-1")


def line_of(text: Column | str, offset: Column) -> Column:
    """1-based line of a byte offset."""
    head = _head(text, offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column | str, offset: Column) -> Column:
    """1-based byte column of a byte offset, which may lie inside a character."""
    return F.length(F.element_at(F.split(_head(text, offset), "\n"), -1)) + 1


def display_range(l1: Column, c1: Column, l2: Column, c2: Column) -> Column:
    return F.format_string("%d:%d-%d:%d", l1, c1, l2, c2)


def uri_path(uri: Column | str) -> Column:
    """The decoded path of a file URI; any other URI as it is."""
    u = _c(uri)
    return F.when(u.startswith("file://"), F.try_url_decode(F.replace(F.substring(u, 8, 1 << 20), F.lit("+"), F.lit("%2B")))).otherwise(u)


def uri_name(uri: Column | str) -> Column:
    """The last part of the path, or the URI itself."""
    parts = F.filter(F.split(F.regexp_replace(uri_path(uri), "^[a-z]+://", ""), "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), _c(uri))


def require_path(path: Column, load_path: Column) -> Column:
    """path relative to load_path, without any trailing '.rb'; null if it isn't under it."""
    root = F.regexp_replace(load_path, "/+$", "")
    inside = F.substring(path, F.length(root) + 2, F.length(path))
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.regexp_replace(inside, "(\\.rb)+$", ""))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 20)).otherwise(path)


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: '**' crosses directories, '*' and '?' don't, '{a,b}' and '[...]' choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unbalanced braces in {glob!r}")
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path meets one of the globs; globs that can't be read are left out."""
    test = F.lit(False)
    for g in globs:
        try:
            pattern = glob_pattern(g)
            re.compile(pattern)
        except (ValueError, re.error):
            continue
        test = test | path.rlike(pattern)
    return test


def html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def comment_text(line: Column) -> Column:
    return F.regexp_replace(line, "^# ?", "")


def name_depth(path: Column | str, nesting: Column | str) -> Column:
    """Depth of a name: one for itself, plus the depths of what stands before it and of the scope around it.

    Every part of a path stands in the same scope, so a path of m parts in a scope of depth d has m * (1 + d).
    """
    parts = lambda p: F.size(F.filter(F.split(p, "::"), lambda x: x != ""))
    around = F.aggregate(_c(nesting), F.lit(0), lambda d, p: parts(p) * (1 + d))
    return parts(_c(path)) * (1 + around)


#: Groups of a signature's parameters, in order.
GROUPS = ("required_positional", "optional_positional", "rest_positional", "post", "required_keyword", "optional_keyword", "rest_keyword", "block", "forward")


def signature(params: Column | str) -> Column:
    """The names of a signature's parameters by group; of several signatures the first."""
    own = _c(params)
    others = F.array_position(F.transform(own, lambda p: p["kind"]), F.lit("overload"))
    first = F.when(others > 0, F.slice(own, 1, (others - 1).cast("int"))).otherwise(own)
    of = lambda g: F.transform(F.filter(first, lambda p: p["kind"] == g), lambda p: p["name"]).alias(g)
    return F.struct(*map(of, GROUPS))
