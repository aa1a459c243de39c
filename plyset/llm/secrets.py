"""Secret scans: patterns, and an assignment-aware lexer that judges literals by their targets' names.

The lexer reads source code and configuration alike as a sequence of name-literal pairs
(``name = "literal"``, ``name: literal``, ``"name" => 'literal'``, ``NAME=literal``,
``<name>literal</name>``). A right-hand side can be a quoted string, several joined by ``+``, a
bare value, or a name or ``$NAME`` that was given a literal before: such constants are propagated,
so that ``x = "..."`` followed by ``db_password = x`` marks the literal of ``x``. A pair's score is
the sensitivity of the target's words times the strength of the literal (length and variety;
placeholders score nothing); literals that score at least ``threshold`` are spans of kind ``named``.

The patterns' spans (``assign``, ``access``, ``hex``) are kept whatever the lexer finds.

It is one pass over whole texts without a shuffle; work is linear in a text's length, and nothing in
it has a fixed length: names, padding, literals, elements, and the parts of a joined value.
Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; ids
may be null and repeat; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.text import batches

KINDS = ("assign", "access", "hex", "named")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

OPERATOR = re.compile(r"[=:]")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-$")
QUOTED = re.compile(r"""[rbfuRBFU]{0,2}(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)""")
BARE = re.compile(r"""[^\s"'`,;#<>(){}\[\]]+""")
REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|([A-Za-z_][\w.]*)(?=[ \t]*(?:[;,)}\n+]|$))")
JOIN = re.compile(r"[ \t]*[+.][ \t]*")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\n]++)</\1>")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How much each word of a target's name says that its value is secret; pairs count as joined words.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 1.0,
    "encryptionkey": 1.0, "authkey": 0.9, "bearer": 0.9, "auth": 0.6, "salt": 0.6, "key": 0.5,
}
#: Words that say that a value only names or describes a secret.
HARMLESS = {"id", "name", "path", "file", "url", "uri", "field", "type", "length", "len", "count", "min", "max", "expires", "ttl", "hint", "label", "prompt", "policy", "regex", "public", "header", "column", "format", "version"}
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|0+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\}|null|none|nil|true|false|undefined|todo|change_?me|(?:your|my|the)[-_ ].*|.*(?:example|placeholder|redacted|dummy).*)$", re.IGNORECASE)


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    pairs = words + [a + b for a, b in zip(words, words[1:])]
    best = max((SENSITIVE.get(w, 0.0) for w in pairs), default=0.0)
    return best * (0.3 if any(w in HARMLESS for w in words) else 1.0)


def strength(literal: str) -> float:
    """0 to 1: how unlike a plain word or placeholder a literal is."""
    n = len(literal)
    if n < 6 or PLACEHOLDER.match(literal):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    bits = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    spaces = literal.count(" ")
    score = min(1.0, bits / 3.2) * min(1.0, 0.25 + 0.25 * kinds) * min(1.0, 0.4 + n / 20)
    return score * (0.4 if spaces and spaces * 8 > n else 1.0)


def back(text: str, p: int, chars: str) -> int:
    """Where the characters before ``p`` begin that are all of ``chars``."""
    while p and text[p - 1] in chars:
        p -= 1
    return p


def target(text: str, p: int) -> str | None:
    """The name that the operator at ``p`` gives a value to."""
    p = back(text, p, " \t")
    if p and text[p - 1] in ":=!<>+*/|&~":
        if text[p - 1] != ":":
            return None
        p = back(text, p - 1, " \t")
    end = first = back(text, back(text, back(text, p, "\"'"), "] \t"), "\"'")
    while first and text[first - 1] in NAME:
        first -= 1
    while first < end and text[first] in "0123456789.-":
        first += 1
    return text[first:end] or None


Part = tuple[int, int] | int


def lex(text: str) -> list[tuple[str, list[Part]]]:
    """Name-literal pairs in order: the target's name, and spans or the numbers of earlier pairs whose value it takes up."""
    found: list[tuple[str, list[Part]]] = []
    known: dict[str, int] = {}
    free = 0
    for m in OPERATOR.finditer(text):
        p = m.start()
        if p < free:
            continue
        name = target(text, p)
        if not name:
            continue
        at = p + 1
        while at < len(text) and text[at] in " \t=>:":
            if text[at] == "=" and text[at - 1] == "=":
                break  # a comparison
            at += 1
        if at < len(text) and text[at] == "=":
            free = at + 1
            continue
        parts: list[Part] = []
        while at < len(text):
            q = QUOTED.match(text, at)
            if q:
                parts.append(q.span(q.lastindex))
                at = q.end()
            else:
                r = REFERENCE.match(text, at)
                key = (r[1] or r[2]) if r else None
                if key in known:
                    parts.append(known[key])
                    at = r.end()
                else:
                    b = BARE.match(text, at)
                    if not b or parts:
                        break
                    parts.append(b.span())
                    at = b.end()
            j = JOIN.match(text, at)
            if not j:
                break
            at = j.end()
        if parts:
            free = at
            known[name.lstrip("$")] = len(found)
            found.append((name, parts))
    if "</" in text:
        found += [(m[1], [m.span(2)]) for m in ELEMENT.finditer(text)]
    return found


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Name-literal pairs in order: the target's name and the spans of what it holds, constants resolved, each once."""
    found = lex(text)
    out = []
    for name, parts in found:
        spans: dict[tuple[int, int], None] = {}
        seen, todo = set(), parts[::-1]
        while todo:
            x = todo.pop()
            if not isinstance(x, int):
                spans[x] = None
            elif x not in seen:
                seen.add(x)
                todo += found[x][1][::-1]
        out.append((name, list(spans)))
    return out


def named_spans(text: str, threshold: float) -> list[tuple[int, int]]:
    """Spans of literals that score at least ``threshold`` for a name that holds them, itself or through constants."""
    found = lex(text)
    most = [sensitivity(name) for name, _ in found]
    named = []
    for i in range(len(found) - 1, -1, -1):  # a pair takes up earlier ones only
        if most[i] < threshold:
            continue
        for x in found[i][1]:
            if isinstance(x, int):
                most[x] = max(most[x], most[i])
            elif most[i] * strength(text[x[0] : x[1]]) >= threshold:
                named.append(x)
    return list(dict.fromkeys(named))


def scan(text: str, threshold: float = 0.5) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then by kind in the order of KINDS."""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        spans += [("named", a, b) for a, b in named_spans(text, threshold)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and the spans of each document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(stream):
        for part in batches(stream, "text", 2 << 20):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py() or "", threshold)] for t in part.column("text")]
            ids = part.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the patterns' spans, and all spans as text."""
    show = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind != 'named')"
    count = {k: F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS}
    return found.select(
        "doc_id", count["assign"], count["access"], count["hex"], F.sha2(F.encode(F.expr(show.format(base)), "UTF-8"), 256).alias("base_sha256"),
        F.expr(show.format("spans")).alias("spans"), count["named"],
    )
