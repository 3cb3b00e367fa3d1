"""Secret scan: assignment-aware lexing of source and configuration text.

Three fixed patterns give the base spans. The method adds spans. A lexer splits lines that hold an assignment sign,
and those that go on from one, into strings, words, signs and marks, none of which is read
twice. A parser makes name-literal pairs of them: assignments, mappings, annotated and chained
ones, subscripts, markup elements and attributes, and blocks of text under a key. Names on the
right are replaced by the literals that the same text last gave them, also in `$K` and in
concatenations, and a literal is scored by how sensitive its target name is and how random it
looks. Calls and elements (`f("x")`, `environ["X"]`) are no literals.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts, small_batches

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for 24 at once finds the same ones.
_HEX = re.compile(r"[0-9a-f]{24,}")
#: The lexer's tokens.
_TOKEN = re.compile(
    r"""(?P<text>"(?:[^"\\\n]++|\\[^\n])*+"|'(?:[^'\\\n]++|\\[^\n])*+'|`(?:[^`\\\n]++|\\[^\n])*+`)"""
    r"""|(?P<sign>:=|[!<>]=|={2,}|[=:])|(?P<word>(?:[^\s"'`\\,;(){}\[\]<>=:!]++|\\[^\s]|!(?!=))++)|(?P<mark>[,;(){}\[\]<>"'`\\])|(?P<line>\n)"""
)
_SIGN = re.compile("[=:]")
_USED = re.compile(r"\$(?:\{(\w+)\}|\((\w+)\)|(\w+))")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:[ \t][^<>]*+)?>([^<>]+)</")
_PLUS = ("+", ".", "..", "&")
#: A longer constant is no secret and is not put into other values, so that these cannot grow without bound.
MAX_CONSTANT = 4096
#: How sensitive a part of a target name is; fixed values.
NAME_WEIGHT = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.7, "auth": 0.6, "key": 0.5, "access": 0.4, "signature": 0.4, "cert": 0.3, "salt": 0.4}
#: Names whose literals are public by intent; fixed values.
NAME_PUBLIC = {"public", "id", "name", "url", "uri", "path", "file", "type", "length", "count", "expires", "ttl", "host", "port"}


def name_score(name: str) -> float:
    """0 to 1: how likely a target of this name holds a secret."""
    parts = re.findall(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*", name)
    words = [p.lower() for p in parts]
    joined = {"".join(words[k : k + 2]) for k in range(len(words))}
    score = max((NAME_WEIGHT.get(w, 0.0) for w in {*words, *joined}), default=0.0)
    return score * (0.4 if NAME_PUBLIC & set(words) else 1.0)


def literal_score(value: str) -> float:
    """0 to 1: how random a literal looks, by length, character entropy and classes."""
    if len(value) < 8 or re.search(r"\s", value) or len(set(value)) < 5:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 4.0) * (0.5 + 0.5 * min(1.0, (classes - 1) / 2))


@dataclass(slots=True)
class _Token:
    kind: str
    start: int
    end: int
    run: int = 0  # where the run of words and signs without a gap ends that it is in


@dataclass
class _Literal:
    text: str = ""
    start: int = -1
    end: int = -1

    def add(self, text: str, start: int, end: int) -> None:
        """One more part; the span goes from the first part of this place to the last."""
        self.text += text
        self.start, self.end = (start, end) if self.start < 0 else (min(self.start, start), max(self.end, end))


class _Pairs:
    """The name-literal pairs of one text, and the constants that it has given so far."""

    def __init__(self, text: str, least: float):
        self.text, self.least = text, least
        self.constants: dict[str, tuple[str, int, int]] = {}
        self.found: list[tuple[int, int, str, float]] = []
        self.block_end = 0

    def tokens(self, begin: int, stop: int) -> list[_Token]:
        out = [_Token(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(self.text, begin, stop)]
        end = at = -1
        for t in reversed(out):
            glued = t.kind in ("word", "sign") and t.end == at
            t.run = end = end if glued else t.end
            at = t.start if t.kind in ("word", "sign") else -1
        return out

    def of(self, t: _Token) -> str:
        return self.text[t.start + 1 : t.end - 1] if t.kind == "text" else self.text[t.start : t.end]

    def pair(self, names: list[str], value: _Literal) -> bool:
        """Keep a literal as a constant of its names; True if it is found to be a secret."""
        if value.start < 0 or not names:
            return False
        if len(value.text) <= MAX_CONSTANT:
            self.constants.update((n, (value.text, value.start, value.end)) for n in names)
        name = max(names, key=name_score)
        if (weight := name_score(name)) and (score := weight * literal_score(value.text)) >= self.least:
            self.found.append((value.start, value.end, name, score))
            return True
        return False

    def expanded(self, text: str) -> str:
        if "$" not in text:
            return text
        return _USED.sub(lambda m: self.constants.get(m[m.lastindex], (m[0],))[0], text)

    def names(self, tokens: list[_Token], i: int) -> list[str]:
        """What the sign at i assigns to: the word or string before it, or the key of an element."""
        k = i - 1
        if k >= 2 and self.of(tokens[k]) == "]" and tokens[k].kind == "mark":
            k -= 1
        if k < 0 or tokens[k].kind not in ("word", "text"):
            return []
        found = self.of(tokens[k])
        name = found if tokens[k].kind == "text" else re.split(r"[^\w$@.\-]", found)[-1].lstrip("-.$@")
        return [name] if any(map(str.isalpha, name[:MAX_CONSTANT])) else []

    def value(self, tokens: list[_Token], j: int) -> tuple[_Literal, int]:
        """The literal from token j on, through concatenations, and the token after it; none for calls and elements."""
        value, inside, k = _Literal(), False, j
        while k < len(tokens) and tokens[k].kind == "mark" and self.of(tokens[k]) == "(":
            inside, k = True, k + 1
        joined = True
        while k < len(tokens):
            t = tokens[k]
            if t.kind == "line" and (inside or joined and value.start >= 0):
                k += 1
            elif t.kind == "mark" and self.of(t) == "\\" and k + 1 < len(tokens) and tokens[k + 1].kind == "line":
                k += 2
            elif t.kind == "text" and (joined or tokens[k - 1].kind in ("text", "line")):
                value.add(self.expanded(self.of(t)), t.start + 1, t.end - 1)
                joined, k = False, k + 1
            elif t.kind == "word":
                word = self.of(t)
                follows = tokens[k + 1] if k + 1 < len(tokens) else None
                if word in _PLUS and value.start >= 0:
                    joined, k = True, k + 1
                    continue
                if not joined and not word.startswith("+"):
                    break
                if follows and follows.start == t.end and self.of(follows) in ("(", "["):
                    return _Literal(), k
                parts = word.split("+") if value.start >= 0 or word.strip("+") not in self.constants and "+" in word and all(p in self.constants for p in word.split("+")) else [word]
                for part in parts:
                    name = part.lstrip("$@")
                    if name in self.constants:
                        value.add(*(self.constants[name] if value.start < 0 else (self.constants[name][0], value.start, value.end)))
                    elif value.start < 0 and part:
                        value.add(self.expanded(part), t.start, t.end)
                        if follows and follows.kind == "sign" and follows.start == t.end and follows.run == follows.end:
                            value.add(self.of(follows), t.end, follows.end)  # padding
                            k += 1
                joined, k = word.endswith("+") and len(word) > 1, k + 1
            else:
                break
        return value, k

    def block(self, tokens: list[_Token], j: int) -> _Literal:
        """A block of text under a key, if `|` or `>` stands at token j before the line's end."""
        value, start = _Literal(), tokens[j].start
        end = self.text.find("\n", start, start + MAX_CONSTANT)
        if start < self.block_end or end < 0 or self.text[start:end].strip() not in ("|", ">", "|-", ">-", "|+", ">+"):
            return value
        line = self.text.rfind("\n", 0, start) + 1
        indent = len(self.text[line:start]) - len(self.text[line:start].lstrip(" \t"))
        body = re.compile(rf"(?:\n(?:[ \t]*(?=\n|\Z)|[ \t]{{{indent + 1},}}[^\n]*+))*+").match(self.text, end)
        self.block_end = body.end()
        for m in re.finditer(r"\S[^\n]*", body[0]):
            value.add(m[0].rstrip(), end + m.start(), end + m.start() + len(m[0].rstrip()))
        return value

    def read(self, begin: int, stop: int) -> None:
        """Read whole lines of the text."""
        tokens = self.tokens(begin, stop)
        carried: list[str] = []  # names of a sign whose value begins with another name and sign
        key, tried, after, i = None, -1, -1, 0
        while i < len(tokens):
            t = tokens[i]
            i += 1
            if t.kind == "line" or t.kind == "mark" and self.of(t) == ">":
                if not (t.kind == "mark" and self.text[t.start - 1 : t.start] == "="):
                    carried, key = [], None
                continue
            if t.kind != "sign" or t.start < after or self.of(t) not in ("=", ":", ":="):
                continue
            direct = self.names(tokens, i - 1)
            names = [*direct, *sorted((c for c in carried if c not in direct), key=name_score)[-1:]]
            carried = []
            if i < len(tokens) and tokens[i].kind == "mark" and self.of(tokens[i]) == ">" and tokens[i].start == t.end:
                i += 1  # the sign is an arrow
            if not names or i >= len(tokens):
                continue
            first, second = tokens[i], tokens[i + 1] if i + 1 < len(tokens) else None
            if first.kind == "word" and second is not None and second.kind == "sign" and not (second.start == first.end and second.run == second.end and (i + 2 >= len(tokens) or tokens[i + 2].kind != "text")):
                if first.run > first.end and first.run != tried and any(map(name_score, names)):
                    tried = first.run
                    if self.pair(names, _Literal(self.expanded(self.text[first.start : first.run]), first.start, first.run)):
                        after = first.run
                        continue
                carried = names
                continue
            if first.kind == "word" and second is not None and second.kind == "mark" and self.of(second) == "[" and second.start == first.end and t.start + 1 == t.end and self.of(t) == ":":
                carried = names  # an annotation
            value, end = self.value(tokens, i)
            if any(map(name_score, names)) and (held := self.block(tokens, i)).start >= 0:
                value = held
            if key and names[0].lower() in ("value", "content"):
                names = [*names, key]
            key = value.text if names[0].lower() in ("key", "name", "id") and value.start >= 0 else None
            self.pair(names, value)
            i = max(i, end)


def lexed(text: str, least: float = 0.4) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, target name, score) of literals that reach `least`; ends are exclusive.

    Work is in proportion to the text, whatever it holds.
    """
    pairs, at = _Pairs(text, least), 0
    while m := _SIGN.search(text, at):
        begin, at = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        while 0 <= at < len(text) - 1 and (text[at - 1] in "+\\(=" or text[at + 1 : at + 40].lstrip(" \t")[:1] in ("+", '"', "'")):
            at = text.find("\n", at + 1)
        at = len(text) if at < 0 else at
        pairs.read(begin, at + 1)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            literal = m[2].strip()
            start = m.start(2) + m[2].find(literal)
            pairs.pair([m[1]], _Literal(literal, start, start + len(literal)) if literal else _Literal())
    yield from pairs.found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the three fixed patterns."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in ("passw", "secret", "token", "api")) else []
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.4) -> DataFrame:
    """One row a document: doc_id and its spans, by start and then kind.

    spans: array of (kind, start, end, name, score), offsets in code points, ends exclusive.
    Base spans stay whatever the method finds; a literal inside a base span is not repeated.
    Null and empty texts have none. Repeated rows are scanned each; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8 << 20):
            out = []
            for text in batch["text"].to_pylist():
                base = base_spans(text)
                found = {(s, k, e): (None, 1.0) for s, k, e in base}
                starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
                for s, e, name, score in lexed(text, least):
                    before = bisect.bisect_right(starts, s)
                    if not before or reach[before - 1] < e:
                        found.setdefault((s, 3, e), (name, score))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "name": found[s, k, e][0], "score": found[s, k, e][1]} for s, k, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return doc_texts(docs, id_col, text_col).mapInArrow(find, f"doc_id {id_type}, spans array<struct<kind:string,start:long,end:long,name:string,score:double>>")
