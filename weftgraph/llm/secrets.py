"""Secret scans with a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold. Every batch of documents is an index segment: its bytes' trigrams, as far as any rule asks
for them, give postings (trigram -> sorted rows); a rule's query is answered by intersecting and
uniting postings, and the expression itself runs on the candidates only. Rules from which no
mandatory trigram follows scan every document. A rule that takes a letter in either case asks for
trigrams in lower case, which are looked up in a second segment of the bytes in lower case.
Segments are independent, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import chunks
from .common import kind_of, pick


def either(word: str) -> str:
    """The pattern of a word in ASCII letters of any case; what (?i) adds beyond ASCII differs between Python and RE2."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else re.escape(c) for c in word)


#: Patterns whose meaning is the same in Python and in RE2.
RULES: dict[str, str] = {
    "aws_key": "(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": "gh[pousr]_[A-Za-z0-9]{36}",
    "private_key": "-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "slack_token": "xox[baprs]-[0-9A-Za-z-]{10,}",
    "google_key": "AIza[0-9A-Za-z_-]{35}",
    "stripe_key": "sk_live_[0-9A-Za-z]{16,}",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}(?:[.][A-Za-z0-9_-]+)?",
    "assigned": f"(?:{'|'.join(map(either, ('token', 'secret', 'password', 'api_key', 'apikey', 'passwd')))})" + " ?[=:] ?[\"'][A-Za-z0-9_/+.=-]{8,}[\"']",
    "basic_auth": "[a-z]{3,6}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]{3,}@",
    "hex_key": "[0-9A-Fa-f]{40}",
}

#: A query is True (anything), ("tri", t), ("and", [...]) or ("or", [...]).
MOST_STRINGS = 64


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list):
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of(string: bytes):
    return _all([("tri", string[i : i + 3]) for i in range(len(string) - 2)])


def _strings(found: set[bytes]):
    return _any([_of(s) for s in sorted(found)])


def _settle(info: tuple):
    """From (exact strings or None, prefixes, suffixes, query): the query with what exact strings say."""
    exact, _, _, query = info
    return _all([query, _strings(exact)]) if exact is not None else query


def _concat(a: tuple, b: tuple) -> tuple:
    if a[0] is not None and b[0] is not None and len(a[0]) * len(b[0]) <= MOST_STRINGS:
        both = {x + y for x in a[0] for y in b[0]}
        return both, both, both, _all([a[3], b[3]])
    ends, starts = (a[0] if a[0] is not None else a[2]), (b[0] if b[0] is not None else b[1])
    across = True
    if len(ends) * len(starts) <= MOST_STRINGS:
        across = _strings({x + y for x in ends for y in starts})
    query = _all([_settle(a), _settle(b), across])
    prefix = {x + y for x in a[0] for y in b[1]} if a[0] is not None and len(a[0]) * len(b[1]) <= MOST_STRINGS else a[1]
    suffix = {x + y for x in a[2] for y in b[0]} if b[0] is not None and len(b[0]) * len(a[2]) <= MOST_STRINGS else b[2]
    return None, prefix, suffix, query


NOTHING = ({b""}, {b""}, {b""}, True)
ANYTHING = (None, {b""}, {b""}, True)


#: ASCII letters that (?i) also finds in other characters (the long s, the Kelvin sign, the Turkish i's).
BEYOND = frozenset("ksi")


def _info(items, fold: bool = False, ignore: bool = False) -> tuple:
    """fold: of matches in lower case (ASCII letters only); ignore: inside (?i)."""
    out = NOTHING
    lower = (lambda s: s.lower()) if fold else (lambda s: s)
    for op, value in items:
        chars = [chr(value)] if op is K.LITERAL else [chr(v) for o, v in value if o is K.LITERAL] if op is K.IN else []
        if ignore and any(not c.isascii() or c.lower() in BEYOND for c in chars):
            one = ANYTHING
        elif op is K.LITERAL or op is K.IN and len(chars) == len(value) <= 8:
            s = {lower(c.encode()) for c in chars}
            one = (s, s, s, True)
        elif op is K.SUBPATTERN:
            inside = ignore or bool(value[1] & re.IGNORECASE)
            one = ANYTHING if inside and not fold else _info(value[3], fold, inside)
        elif op is K.BRANCH:
            parts = [_info(b, fold, ignore) for b in value[1]]
            if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= MOST_STRINGS:
                s = set().union(*(p[0] for p in parts))
                one = (s, s, s, _any([_all([p[3], _strings(p[0])]) for p in parts]))
            else:
                one = (None, *({x for p in parts for x in p[i]} for i in (1, 2)), _any([_settle(p) for p in parts]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = value
            inner = _info(body, fold, ignore)
            if low == 0:
                one = ({b""} | inner[0],) * 3 + (True,) if high == 1 and inner[0] is not None else ANYTHING
            else:
                one = NOTHING
                for _ in range(min(low, 8)):
                    one = _concat(one, inner)
                if (low, high) != (min(low, 8),) * 2:
                    one = _concat(one, ANYTHING)
        elif op is K.AT:
            one = NOTHING
        else:
            one = ANYTHING
        out = _concat(out, one)
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query that follows from a regular expression; True if nothing does."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return True
    return _settle(_info(parsed))


def folded_query(pattern: str):
    """The trigram query, in lower case, that every match must hold once its ASCII letters are in lower case; (?i) is taken too."""
    parsed = _parser.parse(pattern)
    return _settle(_info(parsed, True, bool(parsed.state.flags & re.IGNORECASE)))


def caseless(items) -> bool:
    """Does the parsed expression ask for (?i) or for a letter in either case, such as [Tt]?"""
    for op, value in items:
        if op is K.SUBPATTERN:
            if value[1] & re.IGNORECASE or caseless(value[3]):
                return True
        elif op is K.BRANCH:
            if any(map(caseless, value[1])):
                return True
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            if caseless(value[2]):
                return True
        elif op is K.IN and all(o is K.LITERAL for o, _ in value):
            found = {chr(v) for _, v in value}
            if any(c.isascii() and c.isalpha() and c.swapcase() in found for c in found):
                return True
    return False


def ask(pattern: str) -> tuple[bool, object]:
    """(are the trigrams looked up in the folded segment, the query)."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE or caseless(parsed):
        return True, folded_query(pattern)
    return False, trigram_query(pattern)


def vocabulary(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(vocabulary(q) for q in query[1]))


def answer(query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Sorted rows that meet the query."""
    if query is True:
        return everything
    if query[0] == "tri":
        return postings[query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate([answer(q, postings, everything) for q in query[1]]))
    out = None
    for part in sorted((answer(q, postings, everything) for q in query[1]), key=len):
        out = part if out is None else np.intersect1d(out, part, assume_unique=True)
    return out


def segment(raw: np.ndarray, at: np.ndarray, wanted: dict[bytes, int], flags: np.ndarray) -> dict[bytes, np.ndarray]:
    """Postings of the wanted trigrams; flags holds, for each 24-bit code, 0 or the number of a wanted one."""
    empty = np.empty(0, np.int64)
    out = dict.fromkeys(wanted, empty)
    if len(raw) < 3 or not wanted:
        return out
    code = raw[:-2].astype(np.uint32)
    code <<= 8
    code |= raw[1:-1]
    code <<= 8
    code |= raw[2:]
    number = flags[code]
    places = np.flatnonzero(number)
    row = np.searchsorted(at, places, "right") - 1
    inside = places + 3 <= at[row + 1]
    row, number = row[inside], number[places[inside]]
    pairs = np.unique(number.astype(np.int64) * len(at) + row)
    which, row = pairs // len(at), pairs % len(at)
    cuts = np.searchsorted(which, np.arange(len(wanted) + 2))
    for t, k in wanted.items():
        out[t] = row[cuts[k] : cuts[k + 1]]
    return out


def scan(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A row for each match: doc_id, rule, match_no (from 1), start and length in characters, md5 of the match.

    Matches of a rule don't overlap and are found from left to right over the whole text; the
    secret itself is not repeated. Defined cases: null and empty texts have no matches; a null
    doc_id stays null; repeated rows are scanned each for itself; matches of several rules at one
    place are all reported; an empty table gives no rows; extra columns are ignored; doc_id keeps
    its type.
    """
    asks = {name: ask(p) for name, p in rules.items()}
    wanted: dict[bool, dict[bytes, int]] = {}
    for fold in (False, True):
        words = sorted(set().union(*(vocabulary(q) for f, q in asks.values() if f == fold)))
        if len(words) > 65_000:
            raise ValueError("the rules ask for too many trigrams")
        wanted[fold] = {t: i + 1 for i, t in enumerate(words)}
    # Capitals to small letters; all other bytes as they are.
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = {fold: np.zeros(1 << 24, np.uint16) for fold, own in wanted.items() if own}
        for fold, own in flags.items():
            for t, i in wanted[fold].items():
                own[int.from_bytes(t, "big")] = i
        compiled = {name: re.compile(p) for name, p in rules.items()}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for lo, hi, raw, at in chunks(texts):
                postings, everything = {fold: segment(lower[raw] if fold else raw, at, wanted[fold], own) for fold, own in flags.items()}, np.arange(hi - lo)
                decoded: dict[int, str] = {}
                for name, (fold, query) in asks.items():
                    for row in answer(query, postings.get(fold, {}), everything).tolist():
                        text = decoded.get(row)
                        if text is None:
                            text = decoded[row] = raw[at[row] : at[row + 1]].tobytes().decode()
                        for no, m in enumerate(compiled[name].finditer(text), 1):
                            out.append((lo + row, name, no, m.start(), m.end() - m.start(), hashlib.md5(m.group().encode()).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            of, *rest = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([ids.take(of), *rest], ["doc_id", "rule", "match_no", "start", "length", "md5"])

    own = pick(docs, "doc_id", "text").where(F.col("text").isNotNull())
    return own.mapInArrow(run, f"doc_id {kind_of(own, 'doc_id')}, rule string, match_no long, start long, length long, md5 string")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in RULES.items())
    return " UNION ALL ".join(
        f"""SELECT doc_id, {quote(k)} AS rule, n AS match_no,
        list_sum(list_transform(p[1:n], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:n-1], lambda x: length(x)))::BIGINT, 0) AS start,
        length(m[n]) AS length, md5(m[n]) AS md5
        FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS n FROM
        (SELECT doc_id, regexp_extract_all(text, {quote(v)}) AS m, regexp_split_to_array(text, {quote(v)}) AS p FROM documents WHERE regexp_matches(text, {quote(v)})))"""
        for k, v in RULES.items()
    )


ORACLE = _oracle()
