"""What ``find`` finds in plain texts, row by row in Python: the same spans as by Columns, without a shuffle or a written table.

A plain text holds blanks, tabs, line feeds and printable ASCII alone; in such a text the patterns of ``recognize`` and
``lines`` mean the same to Python's ``re``, where letters, digits and words are those of ASCII. Patterns, guards' patterns
and word lists are those of the Columns. A whole batch is searched for a wider form of each pattern at once (RE2, which
has no lookaround), and only the texts that hold it are searched for the pattern itself.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as texts
from ..functions.vocabulary import ENTITIES, FIELD_KINDS, FIELD_WORDS, ISSUERS, NOT_NAMES, PAIRED, PARTICLES, STRONG, TITLES
from . import lines, recognize

#: What no plain text holds, for Java and for RE2.
OTHER = r"[^\t\n\x20-\x7E]"
#: Texts that are held as Python values at once.
ROWS = 1024
_CLASSES = {"Alnum": "A-Za-z0-9", "Alpha": "A-Za-z", "Upper": "A-Z", "Lower": "a-z", "Lu": "A-Z", "Ll": "a-z", "L": "A-Za-z", "Nd": "0-9", "N": "0-9", "M": ""}


def python_pattern(java: str) -> str:
    """A pattern as Python writes it: classes of ASCII, named groups, and a flag within its group as a group of its own."""
    out, at, inside, flags = [], 0, False, [0]
    while at < len(java):
        if java.startswith(r"\p{", at):
            end = java.index("}", at)
            own = _CLASSES[java[at + 3 : end]]
            out.append(own if inside else f"[{own}]")
            at = end + 1
        elif java.startswith(r"\k<", at):
            end = java.index(">", at)
            out.append(f"(?P={java[at + 3 : end]})")
            at = end + 1
        elif java[at] == "\\":
            out.append(java[at : at + 2])
            at += 2
        elif inside or java[at] == "[":
            inside = java[at] != "]"
            out.append(java[at])
            at += 1
        elif java.startswith("(?i)", at):
            out.append("(?i:")
            flags[-1] += 1
            at += 4
        elif java[at] == ")":
            out.append(")" * (flags.pop() + 1))
            at += 1
        else:
            if java[at] == "(":
                flags.append(0)
            named = re.match(r"\(\?<(?=[A-Za-z])", java[at:])
            out.append("(?P<" if named else java[at])
            at += 3 if named else 1
    return "".join(out) + ")" * flags[0]


def _closed(pattern: str, at: int) -> int:
    """Where the group that begins at a place ends."""
    depth, inside = 0, False
    while True:
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at + 1
        at += 1


def wider(pattern: str) -> str:
    """A pattern of Python without what RE2 has not: what it finds is in every text in which the pattern finds something."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "\\":
            out.append(pattern[at : at + 2])
            at += 2
        elif pattern[at] == "[":
            end = at + 1
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(pattern[at : end + 1])
            at = end + 1
        elif pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), at):
            at = _closed(pattern, at)
        elif pattern.startswith("(?P=", at):
            out.append("(?s:.*)")
            at = _closed(pattern, at)
        elif pattern[at] == "$":  # before a last line feed it is no end for RE2
            at += 1
        else:
            out.append(pattern[at])
            at += 1
    return "".join(out)


def compiled(java: str) -> re.Pattern:
    """A pattern of the Columns for plain texts."""
    return re.compile(python_pattern(java), re.ASCII)


# ---- checks of values ----


def _digits(v: str) -> str:
    return re.sub(r"[^0-9]+", "", v)


def card(v: str) -> bool:
    d = _digits(v)
    if not (13 <= len(d) <= 19 and d[0] in "23456"):
        return False
    twice = (int(c) * 2 for c in d[-2::-2])
    return (sum(map(int, d[::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def iban(v: str) -> bool:
    s = re.sub(r"\s", "", v, flags=re.ASCII).upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn(v: str) -> bool:
    d = _digits(v)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000" and d not in ("123456789", "078051120", "219099999")


def national_id(v: str) -> bool:
    d = _digits(v)
    if len(d) != 10 or d == d[0] * 10:
        return False
    rest = sum(int(d[i]) * (10 - i) for i in range(9)) % 11
    return int(d[9]) == (rest if rest < 2 else 11 - rest)


def entropy(v: str) -> float:
    out = 0.0
    for c in dict.fromkeys(v):
        share = v.count(c) / len(v)
        out -= share * (math.log(share) / math.log(2))
    return out


def ipv4(v: str) -> bool:
    parts = v.split(".")
    return len(parts) == 4 and all(re.fullmatch("0|[1-9][0-9]{0,2}", p) and int(p) <= 255 for p in parts) and not v.startswith("0.")


def ipv6(v: str) -> bool:
    parts = v.split(":")
    full = sum(p != "" for p in parts)
    if "::" in v:
        return not re.search(":::|::.*::|^:[^:]|[^:]:$", v) and 1 <= full <= 7
    return len(parts) == 8 and full == 8


_TITLE = re.compile(rf"(?:|[A-Z]|{'|'.join(TITLES)})")
_NOT_NAMES, _PARTICLES, _FOLDED = frozenset(NOT_NAMES), frozenset(PARTICLES), frozenset(lines._FOLDED)


def plausible_name(v: str) -> bool:
    own = [t for t in (re.sub("^[.,]+|[.,]+$", "", t) for t in re.split("[ \t]+", v.strip(" "))) if not _TITLE.fullmatch(t)]
    return bool(own) and all(t.lower() not in _NOT_NAMES for t in own)


def name_shape(v: str) -> bool:
    tokens = [t for t in (re.sub("^[.,;:]+|[.,;:]+$", "", t) for t in re.split("[ \t]+", v.strip(" "))) if t]
    own = [t for t in tokens if len(t) > 1 and t.lower() not in _PARTICLES]
    return 1 <= len(tokens) <= 5 and all(re.fullmatch("[A-Za-z][A-Za-z'-]*", t) for t in tokens) and all(t.lower() not in _FOLDED for t in own) and any(len(t) >= 3 for t in own)


_OTHER_WORDS = re.compile(rf"(?i:(?:[ \t]+[.,]*(?:{'|'.join(NOT_NAMES)})[.,]*)+$)", re.ASCII)


def name_head(v: str) -> str:
    return _OTHER_WORDS.sub("", v)


_NUMBER_ELSE = compiled(rf"^(?:{recognize._ANY_DATE}|\d{{1,3}}(?:\.\d{{1,3}}){{3}})$")
_RANDOM = [re.compile(p, re.ASCII) for p in ("^[A-Za-z0-9_+/=-]+$", "[a-z]", "[A-Z]", "[0-9]")]
#: The guards of the rules, by name.
GUARDS: dict[str, Callable[[str], bool]] = {
    "email_lenient": lambda v: re.search("(?=.*[A-Za-z]).{4,}", v.rpartition("@")[2]) is not None,
    "card": card, "iban": iban, "ssn": ssn, "ssn_label": ssn, "ipv4": ipv4, "ipv6": ipv6, "national_id": national_id,
    "phone_plus": lambda v: 8 <= len(_digits(v)) <= 15,
    "entropy_token": lambda v: all(p.search(v) for p in _RANDOM) and entropy(v) >= 4.0,
    "id_label": lambda v: len(_digits(v)) >= 3,
    "long_number": lambda v: not _NUMBER_ELSE.search(v),
    "salutation": plausible_name, "titled_name": plausible_name, "closing": plausible_name, "name_label": plausible_name, "name_field": name_shape,
}


class Rule:
    """A rule of ``recognize`` for plain texts."""

    def __init__(self, rule: recognize.Rule) -> None:
        self.view, self.rest = rule.view, (rule.entity, rule.score, rule.source)
        self.pattern = compiled(f"{rule.prefix}(?:{rule.pattern})")
        self.wide = wider(self.pattern.pattern)
        self.before = compiled(f"^{rule.prefix}(?=(?:{rule.pattern})$)") if rule.prefix else None
        self.head = name_head if rule.head else None
        self.guard = GUARDS[rule.name] if rule.guard else None

    def spans(self, t: str) -> Iterator[tuple]:
        for m in self.pattern.finditer(t):
            start, v = m.start(), m[0]
            if self.before and (b := self.before.match(v)):
                start, v = start + b.end(), v[b.end() :]
            if self.head:
                v = self.head(v)
            if not self.guard or self.guard(v):
                yield (start, start + len(v), *self.rest)


_BETWEEN = r"[ \-./()]"
_CONFUSED = [(d, re.compile(rf"(?:(?<=[0-9])|(?<=[0-9]{_BETWEEN}))[{re.escape(c)}](?={_BETWEEN}?[0-9])")) for d, c in texts.CONFUSED.items()]
_CONFUSING = rf"[0-9]{_BETWEEN}?[{re.escape(''.join(texts.CONFUSED.values()))}]{_BETWEEN}?[0-9]"


def numeric_view(t: str) -> str:
    for digit, pattern in _CONFUSED:
        t = pattern.sub(digit, t)
    return t


def found(column: pa.Array, own: list[str], rules: list[Rule]) -> list[list[tuple]]:
    """The spans of the rules in texts, in the order of the rules, then of the text."""
    views = {"text": (column, own)}
    if any(r.view == "numeric" for r in rules):
        numeric = list(own)
        odd = np.flatnonzero(pc.match_substring_regex(column, _CONFUSING).to_numpy(zero_copy_only=False))
        for i in odd:
            numeric[i] = numeric_view(own[i])
        views["numeric"] = (pa.array(numeric, column.type) if len(odd) else column, numeric)
    out: list[list[tuple]] = [[] for _ in own]
    for r in rules:
        where, said = views[r.view]
        for i in np.flatnonzero(pc.match_substring_regex(where, r.wide).to_numpy(zero_copy_only=False)):
            out[i].extend(r.spans(said[i]))
    return out


# ---- lines ----

_WORDS = {w: [k for k in PAIRED if w in FIELD_WORDS[k].split()] for w in (*FIELD_KINDS, "prenoms", "delivrance")}
_FULL_DATE, _BARE = compiled(lines.FULL_DATE), compiled(lines.BARE_NAME)
_FIRST, _DIGIT = re.compile("[^A-Za-z]*([A-Za-z]+)"), re.compile("[0-9]")


def header_kind(line: str) -> str | None:
    first = _FIRST.match(line)
    if not first or first[1].lower() not in _WORDS or _DIGIT.search(line):
        return None
    words = re.findall("[a-z]+", line.lower())
    if len(words) > 12 or not all(w in _WORDS for w in words) or (len(words) == 1 and words[0] not in STRONG):
        return None
    return next((k for k in PAIRED if any(k in _WORDS[w] for w in words)), "HEADER")


def header_value(kind: str, line: str) -> tuple[str, str] | None:
    """Entity and value of the line under a header of a kind, if it fits."""
    v = line.strip(" ")
    if header_kind(line) or len(v) > 60:
        return None
    if kind == "DOC_NO":
        compact = re.sub("[^A-Za-z0-9]", "", v)
        entity = "ID_NUMBER" if len(compact) <= 16 and len(_digits(compact)) >= 5 else None
    elif kind in ("DOB", "ISSUE", "EXPIRY"):
        dated = _FULL_DATE.search(re.sub("[.,;]+$", "", v))
        entity = ("DATE_OF_BIRTH" if kind == "DOB" else "DATE") if dated else None
    else:
        entity = "PERSON" if name_shape(v) else None
    return (entity, v) if entity else None


_BRACKETS = str.maketrans("()[]{}", "<<<<<<")
_FILLERS = re.compile("(?<=K)K|K(?=K)|(?<=L)L|L(?=L)|(?<=C)C|C(?=C)|(?:(?<=<)|(?<=KK)|(?<=LL)|(?<=CC))[KLC](?=<)")
_BLANKS = re.compile(r"\s+", re.ASCII)


def zone_line(line: str) -> tuple[str, str] | None:
    """Kind and compact form of a line of a machine-readable zone."""
    if len(line) < 28:
        return None
    compact = _BLANKS.sub("", line).upper()
    if len(compact) < 28:
        return None
    fixed = _FILLERS.sub("<", compact.translate(_BRACKETS))
    if not re.fullmatch("[A-Z0-9<]+", fixed):
        return None
    if re.match("[PIVCA][<O0][A-Z0-9<]{5,}", fixed) or ("<<" in fixed and re.fullmatch("[A-Z<]+", fixed)):
        return "name", fixed
    digits = len(_digits(fixed))
    if digits >= 10 and re.search("[MF<][0-9]{6}|[A-Z]{3}", fixed) and ("<" in fixed or digits >= 20):
        return "data", fixed
    return None


_STATES = re.compile("|".join(ISSUERS))


def zone_fields(zone: list[tuple[str, str]]) -> dict[tuple[str, str], None]:
    """Tokens and entities that the lines of a text's zone say."""
    states = {z[10:13] for kind, z in zone if kind == "data" and re.fullmatch("[A-Z]{3}", z[10:13])}
    out = []
    for kind, z in zone:
        if kind == "name":
            said = z
            if re.match("[PIVCA][<O0][A-Z0-9<]{5,}", z):
                said = z[2:]
                if re.match(".{3}[A-Z].", said) and (said[:3] in ISSUERS or said[:3] in states):
                    said = said[3:]
            parts = [p for p in re.split("<{2,}", said) if p][:2]
            names = (p.replace("<", " ").strip(" ") for p in parts)
            out += [(p, "PERSON") for p in names if len(p) >= 3 and re.fullmatch("[A-Z' -]+", p)]
        else:
            numbers = (p.replace("<", "") for p in (z[:9], z[5:14] if len(z) >= 14 else ""))
            out += [(p, "ID_NUMBER") for p in numbers if len(_digits(p)) >= 5 and not _STATES.search(p) and not any(s in p for s in states)]
    return dict.fromkeys(out)


_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def whole_words(t: str, token: str) -> list[tuple[int, int]]:
    """Where a token stands in a text between signs that no word holds."""
    out, at = [], t.find(token)
    while at >= 0:
        end = at + len(token)
        if (at == 0 or t[at - 1] not in _WORD) and (end == len(t) or t[end] not in _WORD):
            out.append((at, end))
            at = t.find(token, end)
        else:
            at = t.find(token, at + 1)
    return out


def spaced_words(t: str, token: str) -> list[tuple[int, int]]:
    """The same for a token of letters with blanks and tabs between them."""
    place = [i for i, c in enumerate(t) if c not in " \t"]
    dense, out = "".join(t[i] for i in place), []
    at = dense.find(token)
    while at >= 0:
        start, end = place[at], place[at + len(token) - 1] + 1
        if (start == 0 or t[start - 1] not in _WORD) and (end == len(t) or t[end] not in _WORD):
            out.append((start, end))
            at = dense.find(token, at + len(token))
        else:
            at = dense.find(token, at + 1)
    return out


def line_spans(t: str, spans: list[tuple], scores: dict[str, float]) -> tuple[list[tuple], list[tuple], dict[str, None]]:
    """What lines say (spans), header lines (start, end) and names, of a text in which the rules found spans."""
    said, heads, names = [], [], {}
    own, starts, at = t.split("\n"), [], 0
    for line in own:
        starts.append(at)
        at += len(line) + 1
    following, zone = None, []  # the next line with text
    for i in range(len(own) - 1, -1, -1):
        line = own[i]
        if kind := header_kind(line):
            heads.append((starts[i], starts[i] + len(line)))
            if kind in PAIRED and following is not None and (v := header_value(kind, own[following])):
                start = starts[following] + len(own[following]) - len(own[following].lstrip(" "))
                said.append((start, start + len(v[1]), v[0], scores["HEADER"], "header_pair"))
                if v[0] == "PERSON":
                    names[v[1]] = None
        if z := zone_line(line):
            said.append((starts[i], starts[i] + len(line), "MRZ", scores["ZONE"], "mrz"))
            zone.append(z)
        if line.strip(" "):
            following = i
    if zone:
        small = t.lower()
        for token, entity in zone_fields(zone):
            met = whole_words(small, token.lower())
            if not met and entity == "PERSON" and len(token) >= 5 and re.fullmatch("[A-Z]+", token):
                met = spaced_words(small, token.lower())
            for a, b in met:
                said.append((a, b, entity, scores["ECHO"], "mrz_coref"))
                if entity == "PERSON":
                    names[t[a:b]] = None
    contacts = {bisect_right(starts, s[0]) - 1 for s in spans if s[2] in ("PHONE", "EMAIL")}
    for i in {c + d for c in contacts for d in (-2, -1, 1, 2)}:
        if 0 <= i < len(own) and _BARE.search(own[i]):
            v = re.sub("[ \t]*,$", "", own[i].strip(" \t"))
            if plausible_name(v):
                start = starts[i] + len(own[i]) - len(own[i].lstrip(" \t"))
                said.append((start, start + len(v), "PERSON", scores["CONTACT"], "context"))
                names[v] = None
    return said, heads, names


_PRIORITY = {e: p for e, (_, p) in ENTITIES.items()}


def merged(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):  # equal ones in the given order
        if out and s[0] < out[-1][1]:
            o = out[-1]
            mine, theirs = _PRIORITY.get(s[2], 0), _PRIORITY.get(o[2], 0)
            wins = s if mine > theirs or (mine == theirs and s[3] > o[3]) else o
            out[-1] = (o[0], max(o[1], s[1]), wins[2], max(o[3], s[3]), wins[4])
        else:
            out.append(s)
    return out


def trimmed(t: str, spans: list[tuple]) -> list[tuple]:
    out = []
    for s in spans:
        v = t[s[0] : s[1]]
        start, end = s[0] + len(v) - len(v.lstrip(" \t\n,;:")), s[1] - len(v) + len(v.rstrip(" \t\n,;:."))
        if start < end:
            out.append((start, end, *s[2:]))
    return out


def every_span(t: str, spans: list[tuple], scores: dict[str, float], entities: frozenset[str] | None) -> list[tuple]:
    """All spans of a text, merged and trimmed."""
    said, heads, names = line_spans(t, spans, scores)
    people = dict.fromkeys(t[s[0] : s[1]] for s in spans if s[2] == "PERSON") | names
    again = [(a, b, "PERSON", scores["REPEATED"], "coreference") for n in people if len(n) >= 4 and " " in n for a, b in whole_words(t, n)]
    kept = spans + sorted(said + again)
    if heads:
        heads.sort()
        begins = [h[0] for h in heads]
        # header lines lie apart: only the last that begins before a span can hold it
        kept = [s for s in kept if (h := bisect_right(begins, s[0]) - 1) < 0 or heads[h][1] < s[1]]
    if entities is not None:
        kept = [s for s in kept if s[2] in entities]
    return trimmed(t, merged(kept))


_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("score", pa.float64()), ("source", pa.string())]
_TYPE = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("entity", StringType()), StructField("score", DoubleType()), StructField("source", StringType())]))


def ship_code(spark: SparkSession) -> None:
    """Lets Python workers import this package where they share the driver's disk."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def find(docs: DataFrame, scores: dict[str, float], entities: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """docs (a key and a plain text, or null) with spans."""
    ship_code(docs.sparkSession)
    order = [r.name for r in recognize.RULES if names is None or r.name in names]
    kept = None if entities is None else frozenset(entities)
    schema = StructType([*docs.schema.fields, StructField("spans", _TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [BY_NAME[n] for n in order]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                column = pc.fill_null(b.column(1), "")
                own = column.to_pylist()
                spans = [every_span(t, s, scores, kept) for t, s in zip(own, found(column, own, rules), strict=True)]
                flat = list(zip(*(s for x in spans for s in x), strict=True)) or [()] * len(_FIELDS)
                items = pa.StructArray.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(flat, _FIELDS, strict=True)], [n for n, _ in _FIELDS])
                ends = np.cumsum([0, *map(len, spans)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=[*b.schema.names, "spans"])

    return docs.mapInArrow(run, schema)


BY_NAME = {r.name: Rule(r) for r in recognize.RULES}
