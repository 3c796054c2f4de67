"""Secret scans (operator 9): base patterns, and an assignment-aware lexer for source and configuration syntax."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._common import slices, texts


class Span(NamedTuple):
    kind: str
    start: int
    end: int  # exclusive, in code points
    literal_start: int
    literal_end: int


# The base patterns and the least lengths that the contract states.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: How strongly a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.6, "key": 0.5, "access": 0.3, "signature": 0.5, "salt": 0.5, "session": 0.4, "cookie": 0.4, "dsn": 0.5,
}
#: Parts that say that a value only names or describes something.
HARMLESS = {"name": 0.5, "file": 0.5, "path": 0.5, "type": 0.5, "length": 0.7, "count": 0.7, "public": 0.6, "url": 0.3, "field": 0.5, "label": 0.6, "id": 0.2}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|undefined|example|changeme|change_me|todo|your[_-].*|<.*>|\$\{.*\}|%\(.*\).*|\{\{.*\}\})$")

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-][A-Za-z0-9_$]+)*"
_WORD_AT = re.compile(_NAME)
#: Operators; those of the first group assign nothing.
_OP = re.compile(r"(?P<none>={2,}|[!<>]=|=~|::+)|:=|=>|(?:\+|\?\??|\|\|)?=|:")
#: What stands before an operator, read backwards: a subscript's end, then a quoted or a bare name.
_BEFORE = re.compile(r"[ \t]*[?!]?(?:\][^\[\]\"'`\n]*\[|\][ \t]*(?=[\"'`]))?[ \t]*(?:(?P<quote>[\"'`])|(?P<name>[A-Za-z0-9_$]+(?:[.\-][A-Za-z0-9_$]+)*))")
_RUN_BACK = re.compile(r"[\w$.\-]*+")  # a name whose opening quote is missing, read backwards
_TYPED = re.compile(rf"\s*(?:export\s+)?(?:var|const)\s+({_NAME})\s+[*\[\]\w.]+\s*\Z")  # Go: the type stands after the name
_UNIT = r"[&*]*(?:'\w+[ ]+)?(?:(?:mut|const|dyn)[ ]+)?[A-Za-z_][\w.]*+(?:<[^=\n]{0,200}>|\[[^=\n]{0,200}\])*[?!]?"
_ANNOTATION = re.compile(rf"[ \t]*{_UNIT}(?:[ \t]*[|&][ \t]*{_UNIT}){{0,20}}(?:[ \t]+=(?![=>~])[ \t]*(?=\S)|=(?=[A-Za-z@$]{{0,2}}[\"'`]))")
_STRING = re.compile(
    r"""(?:[A-Za-z]{1,2}|[@$]{1,2})?(?:\"\"\"(?P<t>.*?)\"\"\"|\'\'\'(?P<u>.*?)\'\'\'|"(?P<d>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<s>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`(?P<b>[^`\\]*+(?:\\.[^`\\]*+)*+)`)""",
    re.DOTALL,
)
#: A quoted value over several lines; its end is followed by nothing or by a separator.
_LINES = re.compile(r"""(?:"(?P<d>[^"\\]*+(?:\\.[^"\\]*+)*+)"|'(?P<s>[^'\\]*+(?:\\.[^'\\]*+)*+)')(?=[ \t]*(?:[,;)\]}+\n]|\Z))""", re.DOTALL)
_BLOCK = re.compile(r"[ \t]*[|>][+\-0-9]{0,2}[ \t]*(?:\#[^\n]*)?\n")
_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*")
_NEXT_LINE = re.compile(r"\s*(?:\(\s*)*(?=[A-Za-z@$]{0,2}[\"'`])")
_NEXT_BARE = re.compile(r"[ \t]*\r?\n([ \t]+)(?=[^\s\"'`#\-][^\s]*[ \t]*(?:\r?\n|\Z))")
_PLUS = re.compile(r"(?:\s|\\\n)*\+(?:\s|\\\n)*")
_BESIDE = re.compile(r"(?:\s|\\\n)*(?=[A-Za-z@$]{0,2}[\"'`])")
_KEY_AFTER = re.compile(r"[ \t]*(?::|=)")
_RUN_END = re.compile(r"\s|\Z")
#: What ends an unquoted value within a run: a separator before a space, a quote, a bracket or the next pair; a closing tag.
_SEPARATOR = re.compile(rf"[,;](?=\s|\Z|[\"'`()\[\]{{}}]|{_NAME}[ ]?[=:])|</")
_CALL = re.compile(rf"{_NAME}(?:(?:->|::)[\w$]+)*(?:\([^\n]{{0,300}}?\)|\[[^\n]{{0,300}}?\])(?![^\s;,.)\]}}(\[])")
_NUMBER = re.compile(r"[0-9][A-Za-z0-9+/_.=-]*")
_REF_END = re.compile(r"[ \t]*(?:\+|[;,)\]}]|\r?\n|\Z|[ \t](?!\S*[=:]))")
_CHAINED = re.compile(r"[ \t]+(?::=|=(?![=>~]))")
_PROSE = re.compile(r"[^\W\d_]+[.!?]+")
_WRAP = re.compile(r"\\?\r?\n[ \t]*")
_CLOSERS = {")": "(", "]": "[", "}": "{", ">": "<"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_score(name: str) -> float:
    """0 to 1: the most sensitive part of the name, less what its harmless parts take away."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    joined = ["".join(parts[i : i + 2]) for i in range(len(parts) - 1)]
    best = max((SENSITIVE.get(w, 0.0) for w in parts + joined), default=0.0)
    return max(0.0, best - max((HARMLESS.get(w, 0.0) for w in parts), default=0.0))


def literal_score(text: str) -> float:
    """0 to 1: how much a literal looks like generated key material."""
    return 0.0 if len(text) < 8 or PLACEHOLDER.match(text) else _counts_score(Counter(text))


def _counts_score(counts: Mapping[str, float]) -> float:
    """The score of a text by its characters' counts: entropy, classes of characters, and whether there is white space."""
    n = sum(counts.values())
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(any(map(test, counts)) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    spaced = 0.5 if any(map(str.isspace, counts)) else 1.0
    return spaced * min(1.0, entropy / 3.5) * min(1.0, 0.4 + 0.3 * (classes - 1) if classes else 0.0)


#: Values up to this length are held against placeholders.
SHORT = 256


class Assignment:
    """A name and what its value is built from: spans of literals, without quotes, and earlier assignments, which aren't copied."""

    __slots__ = ("name", "parts", "text", "_measure")

    def __init__(self, name: str, parts: list[tuple[int, int] | Assignment], text: str) -> None:
        parts = tuple(dict.fromkeys(parts))
        self.name, self.text, self._measure = name, text, None
        self.parts = parts[0].parts if len(parts) == 1 and isinstance(parts[0], Assignment) else parts

    @property
    def literals(self) -> tuple[tuple[int, int], ...]:
        """All literals that reach the name, in order, each once."""
        found: dict[tuple[int, int], None] = {}
        seen, open_parts = set(), [iter(self.parts)]
        while open_parts:
            part = next(open_parts[-1], None)
            if part is None:
                open_parts.pop()
            elif not isinstance(part, Assignment):
                found[part] = None
            elif id(part) not in seen:
                seen.add(id(part))
                open_parts.append(iter(part.parts))
        return tuple(found)

    def score(self) -> float:
        """How much the value looks like key material. Characters' counts are added up along the references and kept, so
        that a chain of names takes linear time; only a short value is put together, to be held against placeholders."""
        open_: list[Assignment] = [self]
        while open_:
            one = open_[-1]
            todo = [p for p in one.parts if isinstance(p, Assignment) and p._measure is None] if one._measure is None else []
            if todo:
                open_ += todo
                continue
            open_.pop()
            if one._measure is None:
                counts: Counter[str] = Counter()
                short = ""
                for part in one.parts:
                    if isinstance(part, Assignment):
                        counts.update(part._measure[0])
                        short = short + part._measure[1] if short is not None and part._measure[1] is not None else None
                    else:
                        literal = _WRAP.sub("", one.text[part[0] : part[1]])
                        counts.update(literal)
                        short = short + literal if short is not None else None
                    short = None if short is not None and len(short) > SHORT else short
                if sum(counts.values()) > 1e12:  # a value that is added to itself again and again: only shares count
                    counts = Counter({c: max(1.0, n * 1e-6) for c, n in counts.items()})
                one._measure = (counts, short)
        counts, short = self._measure
        return literal_score(short) if short is not None else _counts_score(counts)

    @property
    def value(self) -> str:
        """The literals together; where one is wrapped, the line breaks aren't part of it."""
        return "".join(_WRAP.sub("", self.text[s:e]) for s, e in self.literals)


class _Values:
    """Reads what stands after an operator. Ends that were found are kept, so the values of a text take linear time together."""

    def __init__(self, text: str, known: dict[str, Assignment]) -> None:
        self.text, self.known = text, known
        self.run_from = self.run_to = self.cut_from = self.cut_at = -1
        self.places: dict[str, list[int]] = {}
        self.open = dict.fromkeys(('"""', "'''", '"', "'", "`"), len(text))  # from there on a quote isn't closed any more

    def string(self, at: int, lines: bool = False) -> tuple[tuple[int, int], int] | None:
        """(span without quotes and outer space, end) of the string literal at `at`."""
        begin = at
        while begin < len(self.text) and begin < at + 3 and self.text[begin] not in "\"'`":
            begin += 1
        mark = self.text[begin : begin + 1]
        if not mark or mark not in "\"'`":
            return None
        if mark * 3 in self.open and self.text.startswith(mark * 3, begin):
            mark *= 3
        if lines and begin >= self.open[mark]:
            return None
        m = _STRING.match(self.text, at)
        if m is None and lines and begin == at:
            m = _LINES.match(self.text, at)
            if m is None and self.text.find(mark, begin + len(mark)) < 0:
                self.open[mark] = min(self.open[mark], begin)
        if m is None:
            return None
        s, e = m.span(m.lastgroup)
        if len(mark) == 3 or "\n" in self.text[s:e]:
            e -= len(self.text[s:e]) - len(self.text[s:e].rstrip())
            s += len(self.text[s:e]) - len(self.text[s:e].lstrip())
        return (s, e), m.end()

    def within(self, mark: str, start: int, end: int) -> tuple[int, int]:
        """(how often the character stands in text[start:end], its first place there or `end`); a text is searched once."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.text)]
        held = self.places[mark]
        first, last = bisect.bisect_left(held, start), bisect.bisect_left(held, end)
        return last - first, held[first] if first < last else end

    def run(self, at: int) -> int:
        """Where the unquoted value at `at` ends: at white space, or at a separator that something follows."""
        if not self.run_from <= at <= self.run_to:
            self.run_from, self.run_to = at, _RUN_END.search(self.text, at).start()
        if not self.cut_from <= at <= self.cut_at:
            m = _SEPARATOR.search(self.text, at, min(len(self.text), self.run_to + 1))
            self.cut_from, self.cut_at = at, m.start() if m and m.start() < self.run_to else self.run_to
        return min(self.run_to, self.cut_at)

    def bare(self, at: int, query: bool) -> tuple[int, int] | None:
        """The span of an unquoted value, without closing quotes and brackets that were opened before it."""
        s, e = at, self.run(at)
        if query:  # a parameter of an address
            e = min(self.within(c, s, e)[1] for c in "&#")
        if s < e and self.text[s] in "\"'`":  # the quote isn't closed
            s += 1
        if _CALL.match(self.text, s):
            return None
        while s < e and (c := self.text[e - 1]) in "\"'`)]}>":
            if c in _CLOSERS and self.within(c, s, e)[0] <= self.within(_CLOSERS[c], s, e)[0] or c not in _CLOSERS and self.within(c, s, e)[0] % 2 == 0:
                break
            e -= 1
        if _PROSE.fullmatch(self.text, s, e):
            while self.text[e - 1] in ".!?":
                e -= 1
        return (s, e) if s < e else None

    def block(self, at: int, indent: int) -> tuple[list[tuple[int, int]], int]:
        """The lines of a block scalar: those that are indented further than its name."""
        spans = []
        while at < len(self.text):
            e = self.text.find("\n", at)
            e = e if e >= 0 else len(self.text)
            line = self.text[at:e]
            if line.strip():
                if len(line) - len(line.lstrip(" \t")) <= indent:
                    break
                spans.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip())))
            at = e + 1
        return spans, at

    def parts(self, at: int, op: str, indent: int, query: bool) -> tuple[list[tuple[int, int] | Assignment], int, int]:
        """(what the value is built from, where it begins, where it ends)."""
        text = self.text
        if op == ":":
            if m := _BLOCK.match(text, at):
                spans, end = self.block(m.end(), indent)
                return spans, m.end(), end
            if m := _ANNOTATION.match(text, at):
                at = m.end()
        at = _GAP.match(text, at).end()
        within = False
        if at < len(text) and text[at] in "\r\n(" and (m := _NEXT_LINE.match(text, at)) and m[0].count("\n") < 3:
            first = self.string(m.end())
            if "(" in m[0] or first and not _KEY_AFTER.match(text, first[1]):
                within, at = "(" in m[0], m.end()
        if op == ":" and (m := _NEXT_BARE.match(text, at)) and len(m[1].expandtabs()) > indent:
            at = m.end()
        begin = at
        spans: list[tuple[int, int] | Assignment] = []
        while at < len(text):
            found = self.string(at, lines=not spans)
            name = None if found else _WORD_AT.match(text, at)
            if found:
                spans.append(found[0])
                at = found[1]
            elif name and name[0] in self.known and _REF_END.match(text, name.end()):
                spans.append(self.known[name[0]])
                at = name.end()
            elif name and (plus := _PLUS.match(text, name.end())) and (plus[0] != "+" or _STRING.match(text, plus.end())):
                at = name.end()  # a name without a known value
            elif at == begin:
                if text[at].isspace() or name and _CHAINED.match(text, name.end()):
                    return [], begin, begin
                bare = self.bare(at, query)
                if bare is None:
                    return [], begin, begin
                spans.append(bare)
                at = bare[1]
            elif m := _NUMBER.match(text, at):
                spans.append(m.span())
                at = m.end()
            else:
                break
            if m := _PLUS.match(text, at):
                at = m.end()
                continue
            m = _BESIDE.match(text, at) if found else None
            if m is None or m[0] == "" and not text[at : at + 1] in ("\"", "'"):
                break
            if "\n" in m[0] and not within and "\\\n" not in m[0]:
                if len(m[0].rsplit("\n", 1)[1].expandtabs()) <= indent:
                    break
            beside = self.string(m.end())
            if beside is None or _KEY_AFTER.match(text, beside[1]):
                break
            at = m.end()
        return spans, begin, at


def _name_before(text: str, begin: int, end: int) -> tuple[str, int] | None:
    """(the name that ends before `end`, its first position), looking back to `begin`."""
    part = text[begin:end]
    if typed := _TYPED.match(part):
        return typed[1], begin + typed.start(1)
    m = _BEFORE.match(part[::-1])
    if m is None:
        return None
    if m["quote"]:
        close = len(part) - m.end()
        open_ = part.rfind(m["quote"], 0, close)
        name = part[open_ + 1 : close] if open_ >= 0 else _RUN_BACK.match(part[close - 1 :: -1] if close else "")[0][::-1]
        return (name, begin + close - len(name)) if name else None
    name = m["name"][::-1]
    start = _WORD_AT.search(name)
    return (name[start.start() :], end - m.end() + start.start()) if start else None


def assignments(text: str) -> Iterator[Assignment]:
    """Name-literal pairs in order, in code, configuration, strings and comments, with constants and concatenations propagated.

    A value is one or more strings (also triple-quoted, over several lines or continued), names of known values, a block
    scalar, or an unquoted run up to white space. Type annotations are stepped over. A literal that reaches a name on
    several ways counts once in its value, so a value never outgrows the text however often a name is added to itself;
    values are put together only when they are asked for, so memory is linear in the text.
    """
    known: dict[str, Assignment] = {}
    values = _Values(text, known)
    last, resume = 0, 0
    chained: list[str] = []
    chained_at = -1
    line = line_end = 0
    for m in _OP.finditer(text):
        if m["none"] or m.start() < resume:
            continue
        if m.start() >= line_end:
            line = text.rfind("\n", last, m.start()) + 1 or line
            line_end = text.find("\n", m.start())
            line_end = line_end if line_end >= 0 else len(text)
        found = _name_before(text, max(line, last), m.start())
        last = m.end()
        if found is None:
            continue
        name, at = found
        indent = len(text[line : line + 200]) - len(text[line : line + 200].lstrip(" \t-"))
        spans, begin, end = values.parts(m.end(), m[0], indent, text[at - 1 : at] in ("?", "&"))
        targets = [*chained, name] if at == chained_at else [name]
        chained, chained_at = [], -1
        if not spans:
            if m[0] == "=" and (word := _WORD_AT.match(text, begin)) and _CHAINED.match(text, word.end()):
                chained, chained_at = targets, begin
            continue
        if m[0] == "+=" and name in known:
            spans = [known[name], *spans]
        secret = False
        for target in targets:
            known[target] = Assignment(target, spans, text)
            secret = secret or name_score(target) > 0
            yield known[target]
        if secret:
            resume = last = end  # else pairs within the value count as well


_QUOTED = r"""(?:"(?P<d>[^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'(?P<s>[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)')"""
_LABEL = r"""["'](?P<name>[\w$.\-]{1,100})["']"""
#: Pairs without an assignment operator, by what stands around them, and the name where the form itself is the name.
_FORMS = (
    (re.compile(rf"(?P<name>[A-Za-z_$][\w$]{{2,99}}+)\(\s{{0,20}}{_QUOTED}\s{{0,20}}\)"), None),  # setPassphrase("...")
    (re.compile(rf"\(\s{{0,20}}{_LABEL}\s{{0,20}},\s{{0,20}}{_QUOTED}"), None),  # set("name", "..."), getenv("NAME", "...")
    (re.compile(rf"\b(?:key|name|id)\s{{0,5}}=\s{{0,5}}{_LABEL}\s{{1,20}}value\s{{0,5}}=\s{{0,5}}{_QUOTED}"), None),  # <add key="name" value="..."/>
    (re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]{0,99}+)(?:\s[^<>\n]{0,300})?>\s{0,20}(?P<d>[^<>\s][^<>\n]{0,1000}?)\s{0,20}</(?P=name)\s{0,5}>"), None),  # <password>...</password>
    (re.compile(rf"\#[ \t]{{0,5}}define[ \t]{{1,9}}(?P<name>\w{{1,100}})[ \t]{{1,40}}(?:{_QUOTED}|(?P<b>[^\s\"'()]+))"), None),  # #define NAME "..."
    (re.compile(rf"(?P<name>[A-Za-z_$][\w$.\-]{{0,99}}+)[ \t]{{0,20}}(?::=|=(?!=)|:(?!:))[^\"'\n=]{{1,200}}?(?:\bor\b|\|\||\?\?|\?:)\s{{0,20}}{_QUOTED}"), None),  # name = f(x) or "..."
    (re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{0,20}+://[^\s/:@\"'<>]{0,200}+:(?P<d>[^\s/@\"'<>]{1,500}+)@"), "password"),  # scheme://user:...@host
    (re.compile(r"(?i:authorization)[\"']?[ \t]{0,5}[:=,][ \t]{0,5}[\"']?(?i:bearer|basic|token)[ \t]{1,5}(?P<d>[A-Za-z0-9+/_.=~\-]++)"), "authorization"),
)


def formed_pairs(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """(name, span of the literal) of calls, labelled arguments, elements, attributes, macros, defaults, addresses, headers."""
    for pattern, fixed in _FORMS:
        for m in pattern.finditer(text):
            groups = m.groupdict()
            kind = next((g for g in ("d", "s", "b") if groups.get(g) is not None), None)
            if kind:
                yield fixed or m["name"], m.span(kind)


def method_spans(text: str, threshold: float = 0.5) -> list[Span]:
    """Literals that reach a sensitive name and look like a secret: name score times literal score at the threshold or over."""
    spans = set()
    if "=" in text or ":" in text:
        told: set[int] = set()  # assignments whose literals are all there
        held = []
        for one in assignments(text):
            held.append(one)  # keeps the identities apart
            weight = name_score(one.name)
            if not weight or weight * one.score() < threshold:
                continue
            open_: list[Assignment] = [one]
            while open_:
                now = open_.pop()
                if id(now) in told:
                    continue
                told.add(id(now))
                for part in now.parts:
                    if isinstance(part, Assignment):
                        open_.append(part)
                    elif part[1] > part[0]:
                        spans.add(Span("literal", *part, *part))
    if "(" in text or "</" in text or "//" in text or "#" in text or "value" in text or ":" in text or "=" in text:
        for name, (s, e) in formed_pairs(text):
            weight = name_score(name)
            if weight and weight * literal_score(text[s:e]) >= threshold:
                spans.add(Span("literal", s, e, s, e))
    return sorted(spans, key=lambda s: (s.start, s.end))


def base_spans(text: str) -> list[Span]:
    """The stated patterns over the whole text, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [Span("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [Span("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the lexer's literals join the base spans unless a base span has the same ends."""
    base = base_spans(text)
    ends = {(s.literal_start, s.literal_end) for s in base} | {(s.start, s.end) for s in base}
    added = [s for s in method_spans(text) if (s.start, s.end) not in ends]
    return base, sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every literal replaced; overlapping literals become one mark."""
    if not spans:
        return text
    out, at = [], 0
    for s, e in _merged([(s.literal_start, s.literal_end) for s in spans]):
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            bisect.insort(out, (s, e))
    return out


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
            for text in texts(batch.column(1)):
                base, every = scan(text)
                kinds = Counter(s.kind for s in base)
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(kinds[k])
                out["base_sha256"].append(hashlib.sha256(_shown(base).encode()).hexdigest())
                out["spans"].append(_shown(every))
                out["n_added"].append(len(every) - len(base))
            columns = [pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *out])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts, digest and spans of every row. Null texts count as empty; repeated rows give repeated results;
    further columns are ignored; an empty table gives an empty one. Very long texts are read whole, a row at a time; work is
    linear in the text, chains of names included, as what a name holds is added up once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_digest_rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret literal replaced by [SECRET] and n_chars, if there is such a column, set anew; null texts stay null."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t is None else redact(t, scan(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(rows, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op9_assign_secrets(docs: DataFrame) -> DataFrame:
    return secret_spans(docs)
