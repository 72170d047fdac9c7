"""Secrets in whole texts: fixed patterns, and literals that reach a sensitive name through assignments.

Each text is lexed as source code or configuration: strings, names, references and operators. Assignments become nodes
(a target name, and the literals and names of its value), in the order of the text. A name in a value refers to the
latest assignment before it, so constants flow along chains and concatenations. From every target whose name is
sensitive the literals behind it are reached once, each judged with the whole value it is part of.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, texts

#: Fixed patterns, in the order that kinds are listed; a match counts from so many characters of its group.
PATTERNS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: Kinds that the lexer adds: a literal beside its sensitive name, and one that reached it through other names.
LITERAL, CONSTANT = "literal", "constant"
KINDS = {kind: i for i, kind in enumerate([*(p[0] for p in PATTERNS), LITERAL, CONSTANT])}

#: Words of a name and how strongly they speak for a secret (the strongest counts).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0,
    "credential": 1.0, "credentials": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 1.0,
    "encryptionkey": 1.0, "bearer": 0.8, "auth": 0.7, "key": 0.6, "pin": 0.6, "pass": 0.8, "salt": 0.6, "signature": 0.6, "cookie": 0.6,
}
#: Last words of names that describe a secret rather than hold one.
DESCRIBES = set("count length len size limit max min type kind format url uri path file filename dir name field label title header id ids index ttl expiry expires policy regex pattern hint prompt enabled required valid izer".split())
#: Parts of values that stand in for a secret.
PLACEHOLDERS = re.compile(r"change.?me|example|placeholder|dummy|your[_-]|todo|redacted|^(?:none|null|nil|true|false|undefined|test|default|password|secret|token)$|^(.)\1*$|^<.*>$|^\*+$|^x+$", re.I)
#: Least product of name and value.
MIN_SCORE = 0.45
#: A call of one of these passes its argument on.
PASSES = {"str", "bytes", "String", "strip", "trim", "b64decode", "encode", "decode", "quote", "Secret", "SecretStr"}

_TOKEN = re.compile(
    r"""
    (?P<string>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<ref>\$\{[A-Za-z_][\w.]*\}|\$[A-Za-z_]\w*)
  | (?P<flag>(?<!\S)--?[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*)
  | (?P<tag><[A-Za-z_][\w.-]*>)
  | (?P<name>[^\W\d]\w*(?:-(?=[^\W\d])\w+)*)
  | (?P<op>:=|=>|->|==|!=|<=|>=|\+=|::|[=:+.,;()\[\]{}])
  | (?P<end>\n)
  | (?P<bare>[^\s"'`,;()\[\]{}<>]+)
    """,
    re.X,
)
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>]+")
_INNER = re.compile(r"\$\{([A-Za-z_]\w*)\}|\{([A-Za-z_]\w*)\}")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_ASSIGNS = {"=", ":", ":=", "=>"}
_SITES = re.compile(r"[:=]|(?<!\S)--?[A-Za-z]|</|\(\s*[\"']")


def name_weight(name: str) -> float:
    """How much a target name speaks for a secret: 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in DESCRIBES:
        return 0.0
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in (*parts, *pairs)), default=0.0)


@dataclass
class Value:
    """What is known of a constant: length and counts of characters, which add up over its parts."""

    size: float = 0.0
    counts: Counter = field(default_factory=Counter)

    def add(self, other: Value) -> None:
        # Far above any text; keeps sums of doubled constants finite.
        self.size = min(1e12, self.size + other.size)
        for c, n in other.counts.items():
            self.counts[c] = min(1e12, self.counts[c] + n)

    def weight(self, quoted: bool) -> float:
        """How much the value looks like a secret: 0 to 1. Bare words need letters and digits."""
        n = sum(self.counts.values())
        if self.size < 6 or not n:
            return 0.0
        entropy = -sum(k / n * math.log2(k / n) for k in self.counts.values())
        letters, digits = any(c.isalpha() for c in self.counts), any(c.isdigit() for c in self.counts)
        if not quoted and not (letters and digits and self.size >= 8):
            return 0.0
        # A phrase in quotes is text rather than a key, unless it is short.
        words = self.counts.get(" ", 0) + 1
        mixed = 1.0 if letters and digits else 0.7
        return mixed * min(1.0, entropy / 3.0) * (1.0 if words <= 4 else 4 / words)


def _value(text: str) -> Value:
    return Value(len(text), Counter(text))


@dataclass
class Node:
    """One assignment: its target, the literals (start, end) in its value, and the assignments it refers to."""

    target: str
    value: Value = field(default_factory=Value)
    literals: list[tuple[int, int]] = field(default_factory=list)
    sources: list[Node] = field(default_factory=list)
    quoted: bool = False


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(text: str) -> list[Token]:
    """Tokens of the lines that may assign something; other lines are left out."""
    out: list[Token] = []
    reach = 0
    for site in _SITES.finditer(text):
        if site.start() < reach:
            continue
        start = max(reach, text.rfind("\n", 0, site.start()) + 1)
        stop = text.find("\n", site.start())
        stop = len(text) if stop < 0 else stop + 1
        for match in _TOKEN.finditer(text, start):
            if match.start() >= stop:
                break
            out.append(Token(match.lastgroup or "", match.group(), match.start(), match.end()))
            stop = max(stop, match.end())
        out.append(Token("end", "\n", stop, stop))
        reach = stop
    return out


def _inside(token: Token) -> tuple[int, int]:
    width = 3 if token.text[:3] in ('"""', "'''") else 1
    return token.start + width, token.end - width


class _Parser:
    """Assignments of a token list, linked by the names that their values use."""

    def __init__(self, text: str):
        self.text, self.tokens = text, lex(text)
        self.latest: dict[str, Node] = {}
        self.nodes: list[Node] = []

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def op(self, i: int) -> str:
        return self.tokens[i].text if self.kind(i) == "op" else ""

    def content(self, i: int) -> str:
        """The name that token i spells, as a name or as a quoted key; else ''."""
        if self.kind(i) == "name":
            return self.tokens[i].text
        if self.kind(i) == "string":
            a, b = _inside(self.tokens[i])
            if 0 < b - a <= 80 and re.fullmatch(r"[\w.-]+", self.text[a:b]):
                return self.text[a:b]
        return ""

    def target(self, i: int) -> str:
        """The name left of the operator at i: name, "key", table["key"], or name: Type."""
        if self.op(i - 1) == "]" and self.op(i - 3) == "[":
            return self.content(i - 2)
        name = self.content(i - 1)
        if self.op(i) == "=" and self.kind(i - 1) == "name" and self.op(i - 2) == ":" and self.content(i - 3):
            return self.content(i - 3)
        return name

    def literal(self, node: Node, start: int, end: int, quoted: bool) -> None:
        text = self.text[start:end]
        for match in _INNER.finditer(text):
            self.refer(node, match.group(1) or match.group(2))
        plain = _INNER.sub("", text)
        if plain:
            node.literals.append((start, end))
            node.quoted |= quoted
            node.value.add(_value(plain) if not PLACEHOLDERS.search(plain) else Value())

    def refer(self, node: Node, name: str) -> bool:
        source = self.latest.get(name)
        if source is None:
            return False
        node.sources.append(source)
        node.value.add(source.value)
        node.quoted |= source.quoted
        return True

    def operand(self, node: Node, i: int, alone: bool) -> int:
        """Read one operand of a value at i; the place after it, or i if there is none."""
        kind, token = self.kind(i), self.tokens[i] if i < len(self.tokens) else None
        if kind == "string":
            self.literal(node, *_inside(token), quoted=True)
            return i + 1
        if kind == "ref":
            self.refer(node, token.text.strip("${}"))
            return i + 1
        if kind == "name" and self.kind(i + 1) == "string" and token.end == self.tokens[i + 1].start and len(token.text) <= 2:
            return self.operand(node, i + 1, alone)  # b"..", f"..", r".."
        if kind == "name" and self.op(i + 1) == "(":
            return self.operand(node, i + 2, False) if token.text in PASSES else i
        if kind == "name" and self.op(i + 1) != "." and self.refer(node, token.text):
            return i + 1
        if kind in ("name", "bare") and alone:
            match = _BARE.match(self.text, token.start)
            self.literal(node, match.start(), match.end(), quoted=False)
            while self.kind(i) not in ("", "end") and self.tokens[i].start < match.end():
                i += 1
        return i

    def expression(self, name: str, i: int) -> int:
        """Read the value at i for a target; the place after it."""
        if name:
            node, begin = Node(name), i
            i = self.operand(node, i, True)
            while i > begin and (self.op(i) in ("+", ".") or self.kind(i) == "string"):
                begin = i
                i = self.operand(node, i + (self.kind(i) == "op"), False)
            if node.literals or node.sources:
                self.nodes.append(node)
                self.latest[name] = node
        return i

    def parse(self) -> list[Node]:
        i = 0
        while i < len(self.tokens):
            token, after = self.tokens[i], i + 1
            if token.kind == "op" and token.text in _ASSIGNS:
                typed = token.text == ":" and self.kind(i + 1) == "name" and self.op(i + 2) == "="
                after = i + 1 if typed else max(i + 1, self.expression(self.target(i), i + 1))
            elif token.kind == "op" and token.text == "+=" and self.content(i - 1):
                node = Node(self.content(i - 1))
                self.refer(node, node.target)
                after = max(i + 1, self.operand(node, i + 1, False))
                self.nodes.append(node)
                self.latest[node.target] = node
            elif token.kind == "op" and token.text == "," and self.op(i - 2) == "(" and self.kind(i - 1) == "string":
                after = max(i + 1, self.expression(self.content(i - 1), i + 1))  # put("name", "literal")
            elif token.kind == "op" and token.text == "(" and self.kind(i - 1) == "name" and re.match("set[A-Z_]", self.tokens[i - 1].text):
                after = max(i + 1, self.expression(self.tokens[i - 1].text[3:], i + 1))  # setName("literal")
            elif token.kind == "flag" and self.op(i + 1) not in _ASSIGNS:
                after = max(i + 1, self.expression(token.text.lstrip("-"), i + 1))  # --name literal
            elif token.kind == "flag":
                after = max(i + 2, self.expression(token.text.lstrip("-"), i + 2))  # --name=literal
            elif token.kind == "tag":
                stop = self.text.find("<", token.end)
                if stop > 0 and self.text.startswith("</" + token.text[1:], stop):
                    node = Node(token.text[1:-1])
                    self.literal(node, token.end, stop, quoted=True)
                    self.nodes.append(node)
            i = after
        return self.nodes


def sensitive_literals(text: str) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, target, score) of the literals that reach a sensitive name.

    Targets are taken by falling score, and each assignment is entered once, so the work grows with the text alone.
    """
    scored = []
    for node in _Parser(text).parse():
        weight = name_weight(node.target)
        score = weight * node.value.weight(node.quoted) if weight else 0.0
        if score >= MIN_SCORE:
            scored.append((score, node))
    found: dict[tuple[int, int], tuple[str, int, int, str, float]] = {}
    entered: set[int] = set()
    for score, node in sorted(scored, key=lambda s: -s[0]):
        for start, end in node.literals:
            found[start, end] = (LITERAL, start, end, node.target, score)
        left = [s for s in node.sources]
        while left:
            source = left.pop()
            if id(source) in entered:
                continue
            entered.add(id(source))
            left += source.sources
            for span in source.literals:
                found.setdefault(span, (CONSTANT, *span, node.target, score))
    return list(found.values())


def _compiled() -> list[tuple[str, re.Pattern, int, int]]:
    """The patterns; a run of one class is looked for from its least length on, which finds the same runs faster."""
    out = []
    for kind, pattern, group, least in PATTERNS:
        if kind == "access":
            pattern = "AKIA[A-Z0-9]{%d,}" % (least - 4)
        elif kind == "hex":
            pattern = "[0-9a-f]{%d,}" % least
        # ASCII: letters there match in either case, but no other letter that folds to one of them.
        out.append((kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least))
    return out


_COMPILED = _compiled()
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")


def scan(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, target, score) of a text, by start, then kind as listed; places in code points."""
    out: list[tuple[str, int, int, str | None, float]] = []
    small = text.lower()
    for kind, pattern, group, least in _COMPILED:
        if kind == "assign" and not any(n in small for n in _NAMED):
            continue
        out += [(kind, *m.span(), None, 1.0) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if _SITES.search(text):
        covered = sorted((s[1], s[2]) for s in out)
        out += [s for s in sensitive_literals(text) if not any(a <= s[1] and s[2] <= b for a, b in covered)]
    return sorted(out, key=lambda s: (s[1], KINDS[s[0]], s[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string()), ("score", pa.float64())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPAN.value_type]
    for batch, documents in texts(batches, "text"):
        spans = [[dict(zip(names, s, strict=True)) for s in scan(t.decode("utf-8", "replace"))] for t in documents]
        yield pa.record_batch([batch.column("id"), pa.array(spans, _SPAN)], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, and spans (kind, start, end, target, score) in whole texts.

    Kinds assign, access and hex are matches of the fixed patterns (the whole match; null target, score 1). Kinds literal
    and constant are what the lexer adds: literals behind a sensitive target, unless such a match already covers them.
    Null and empty texts have no spans. Null ids stay; repeated rows give repeated, equal results; an empty table gives
    an empty one. A text is never cut, and memory is bounded by the longest text. Other columns of docs are not read.
    """
    return keyed(docs, id_col, text_col).mapInArrow(_scanned, "id long, spans array<struct<kind string, start long, end long, target string, score double>>")
