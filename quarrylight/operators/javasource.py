"""Declarations, entry candidates, folds and written relations of one Java source file.

A lexer and a member-level parser, without type inference: what a file does not say itself stays
unresolved, with a reason.  Places are UTF-8 bytes, lines count line feeds from 1.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from quarrylight.functions.identity import framed_digest

MOST_BYTES = 1 << 20

# Annotations that make entry candidates.
ENTRY_ANNOTATIONS = {
    "org.springframework.web.bind.annotation.RequestMapping": "HTTP_MAPPING",
    "org.springframework.web.bind.annotation.GetMapping": "HTTP_MAPPING",
    "org.springframework.web.bind.annotation.PostMapping": "HTTP_MAPPING",
    "org.springframework.web.bind.annotation.PutMapping": "HTTP_MAPPING",
    "org.springframework.web.bind.annotation.DeleteMapping": "HTTP_MAPPING",
    "org.springframework.web.bind.annotation.PatchMapping": "HTTP_MAPPING",
    "org.springframework.scheduling.annotation.Scheduled": "SCHEDULED",
    "org.springframework.amqp.rabbit.annotation.RabbitListener": "RABBIT_LISTENER",
}
# Annotations that are evidence of frameworks.
FRAMEWORK_ANNOTATIONS = {
    "org.springframework.web.bind.annotation.RequestMapping": ("HTTP_EVIDENCE", "spring.request-mapping"),
    "org.springframework.web.bind.annotation.GetMapping": ("HTTP_EVIDENCE", "spring.get-mapping"),
    "org.springframework.web.bind.annotation.PostMapping": ("HTTP_EVIDENCE", "spring.post-mapping"),
    "org.springframework.web.bind.annotation.PutMapping": ("HTTP_EVIDENCE", "spring.put-mapping"),
    "org.springframework.web.bind.annotation.DeleteMapping": ("HTTP_EVIDENCE", "spring.delete-mapping"),
    "org.springframework.web.bind.annotation.PatchMapping": ("HTTP_EVIDENCE", "spring.patch-mapping"),
    "org.springframework.cloud.openfeign.FeignClient": ("HTTP_EVIDENCE", "spring.feign-client"),
    "org.springframework.kafka.annotation.KafkaListener": ("EVENT_EVIDENCE", "spring.kafka-listener"),
    "org.springframework.amqp.rabbit.annotation.RabbitListener": ("EVENT_EVIDENCE", "spring.rabbit-listener"),
    "javax.persistence.Entity": ("DB_EVIDENCE", "jpa.javax-entity"),
    "javax.persistence.Table": ("DB_EVIDENCE", "jpa.javax-table"),
    "jakarta.persistence.Entity": ("DB_EVIDENCE", "jpa.jakarta-entity"),
    "jakarta.persistence.Table": ("DB_EVIDENCE", "jpa.jakarta-table"),
    "org.springframework.data.jpa.repository.Query": ("DB_EVIDENCE", "spring-data-jpa-query"),
    "org.apache.ibatis.annotations.Select": ("DB_EVIDENCE", "mybatis-select"),
    "org.apache.ibatis.annotations.Insert": ("DB_EVIDENCE", "mybatis-insert"),
    "org.apache.ibatis.annotations.Update": ("DB_EVIDENCE", "mybatis-update"),
    "org.apache.ibatis.annotations.Delete": ("DB_EVIDENCE", "mybatis-delete"),
}

# Framework calls by type and method: kind of evidence, rule, roles of leading arguments.
FRAMEWORK_CALLS = {
    ("java.sql.Connection", "prepareStatement"): ("DB_EVIDENCE", "jdbc-connection-sql", ("sql",)),
    ("java.sql.Connection", "prepareCall"): ("DB_EVIDENCE", "jdbc-connection-sql", ("sql",)),
    ("java.sql.Statement", "executeQuery"): ("DB_EVIDENCE", "jdbc-statement-sql", ("sql",)),
    ("java.sql.Statement", "executeUpdate"): ("DB_EVIDENCE", "jdbc-statement-sql", ("sql",)),
    ("java.sql.Statement", "executeLargeUpdate"): ("DB_EVIDENCE", "jdbc-statement-sql", ("sql",)),
    ("java.sql.Statement", "execute"): ("DB_EVIDENCE", "jdbc-statement-sql", ("sql",)),
    ("java.sql.Statement", "addBatch"): ("DB_EVIDENCE", "jdbc-statement-sql", ("sql",)),
    ("org.springframework.kafka.core.KafkaTemplate", "send"): ("EVENT_EVIDENCE", "spring-kafka-send", ("topic",)),
    ("org.springframework.amqp.rabbit.core.RabbitTemplate", "convertAndSend"): ("EVENT_EVIDENCE", "spring-rabbit-convert-and-send", ("exchange", "routingKey")),
}

_LEX = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.[^\']*|[^\'\\\n])\')'
    r"|(?P<num>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|@|[-+*/%&|^!~<>=?:;,.(){}\[\]])", re.S)  # fmt: skip
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
_NO_CALL = frozenset("if for while switch catch synchronized return throw new assert super this try else do case yield".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class SyntaxFailure(ValueError):
    """The file is no Java that this parser can follow."""

    def __init__(self, code: str, at: int):
        super().__init__(code)
        self.code, self.at = code, at


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Parsed:
    status: str = "PARSED"
    diagnostics: list = field(default_factory=list)
    declarations: list = field(default_factory=list)
    candidates: list = field(default_factory=list)
    folds: list = field(default_factory=list)
    relations: list = field(default_factory=list)


def tokens_of(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise SyntaxFailure("LEXICAL", at)
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


class Extractor:
    """Reads one file; ``run`` never raises for bad sources."""

    def __init__(self, generation: str, path: str, source: str):
        self.generation, self.path, self.source = generation, path, source
        self.out = Parsed()
        self.package, self.imports, self.local_types = "", [], set()
        self.variables: dict[str, set[str]] = {}
        self._bytes: list[int] | None = None
        if not source.isascii():
            self._bytes = [0]
            for c in source:
                self._bytes.append(self._bytes[-1] + len(c.encode()))
        self._feeds = [i for i, c in enumerate(source) if c == "\n"]

    # places

    def byte(self, at: int) -> int:
        return at if self._bytes is None else self._bytes[at]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self._feeds, at) + 1

    def span(self, start: int, end: int) -> dict:
        return {"start_byte": self.byte(start), "end_byte": self.byte(end), "start_line": self.line(start), "end_line": self.line(max(start, end - 1))}

    def run(self) -> Parsed:
        if len(self.source.encode()) > MOST_BYTES:
            return Parsed("TOO_LARGE")
        if not self.path.endswith(".java"):
            return Parsed("UNSUPPORTED")
        try:
            self.t = tokens_of(self.source)
            self.match = self._pairs()
            self._unit()
        except SyntaxFailure as e:
            return Parsed("PARSE_FAILED", [{"code": e.code, "line": self.line(e.at)}])
        return self.out

    def _pairs(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.t):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                if not stack or _OPEN[self.t[stack[-1]].text] != t.text:
                    raise SyntaxFailure("UNBALANCED", t.start)
                out[stack.pop()] = i
        if stack:
            raise SyntaxFailure("UNBALANCED", self.t[stack[-1]].start)
        return out

    def at(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def _name(self, i: int) -> tuple[str, int]:
        parts = []
        while i < len(self.t) and self.t[i].kind == "id":
            parts.append(self.t[i].text)
            i += 1
            if self.at(i) != ".":
                break
            i += 1
        return ".".join(parts), i

    def _generic(self, i: int) -> int:
        """After a balanced <...> that begins at i."""
        depth = 0
        while i < len(self.t):
            if self.at(i) == "<":
                depth += 1
            elif self.at(i) == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif self.at(i) in ("(", ")", "{", "}", ";"):
                break
            i += 1
        raise SyntaxFailure("GENERIC", self.t[min(i, len(self.t) - 1)].start)

    def _type(self, i: int) -> int | None:
        """After a type that begins at i, or None."""
        while self.at(i) == "@" and self.at(i + 1) != "interface":
            _, i = self._annotation(i)
        if i >= len(self.t) or self.t[i].kind != "id" or self.at(i) in _NO_CALL:
            return None
        while True:
            i += 1
            if self.at(i) == "<":
                i = self._generic(i)
            if self.at(i) == "." and i + 1 < len(self.t) and self.t[i + 1].kind == "id":
                i += 1
                continue
            break
        while self.at(i) == "[" and self.at(i + 1) == "]":
            i += 2
        return i + 1 if self.at(i) == "..." else i

    def _annotation(self, i: int) -> tuple[dict, int]:
        name, j = self._name(i + 1)
        body = None
        if self.at(j) == "(":
            body, j = (j + 1, self.match[j]), self.match[j] + 1
        return {"name": name, "body": body, "start": self.t[i].start, "end": self.t[j - 1].end}, j

    def _modifiers(self, i: int) -> tuple[list[dict], list[str], int]:
        notes, words = [], []
        while True:
            if self.at(i) == "@" and self.at(i + 1) != "interface":
                note, i = self._annotation(i)
                notes.append(note)
            elif self.at(i) in _MODIFIERS and not (self.at(i) == "sealed" and self.at(i + 1) in ("(", "=", ";")):
                words.append(self.at(i))
                i += 1
            elif self.at(i) == "non" and self.at(i + 1) == "-" and self.at(i + 2) == "sealed":
                words.append("non-sealed")
                i += 3
            else:
                return notes, words, i

    # structure

    def _unit(self) -> None:
        i = 0
        notes, _, j = self._modifiers(i)
        if self.at(j) == "package":
            self.package, i = self._name(j + 1)
            i += 1
        while self.at(i) == "import":
            static = self.at(i + 1) == "static"
            name, j = self._name(i + 1 + static)
            wild = self.at(j) == "*"
            self.imports.append((name + (".*" if wild else ""), static))
            i = j + wild + 1
        for k in range(len(self.t) - 1):
            if (self.at(k) in _TYPES or self.at(k) == "interface") and self.t[k + 1].kind == "id" and (k == 0 or self.at(k - 1) != "."):
                self.local_types.add(self.at(k + 1))
        self._variables()
        self._members(i, len(self.t), self.package, None, None, top=True)

    def _variables(self) -> None:
        """Written types by the names of fields, parameters and locals: a name with two types proves nothing."""
        for k in range(len(self.t) - 1):
            if self.t[k].kind == "id" and self.t[k].text[:1].isupper() and (k == 0 or self.at(k - 1) != "new"):
                try:
                    j = self._type(k)
                except SyntaxFailure:
                    continue
                if j is not None and j < len(self.t) and self.t[j].kind == "id" and self.at(j + 1) in ("=", ";", ",", ")", ":"):
                    self.variables.setdefault(self.at(j), set()).add(self._name(k)[0])

    def _is_type(self, i: int) -> bool:
        word = self.at(i)
        if word == "@" and self.at(i + 1) == "interface":
            return True
        if word not in _TYPES or i + 1 >= len(self.t) or self.t[i + 1].kind != "id":
            return False
        return word != "record" or self.at(i + 2) in ("(", "<")

    def _members(self, i: int, end: int, owner: str, parent: str | None, type_name: str | None, top: bool = False, kind: str = "CLASS") -> None:
        while i < end:
            if self.at(i) == ";":
                i += 1
                continue
            begin = i
            notes, words, i = self._modifiers(i)
            if i >= end:
                raise SyntaxFailure("MEMBER", self.t[begin].start)
            if self._is_type(i):
                i = self._type_declaration(begin, i, notes, owner, parent)
            elif self.at(i) == "{":
                close = self.match[i]
                self._code(i + 1, close, f"{owner}#{'static-initializer' if 'static' in words else 'initializer'}@{self.byte(self.t[begin].start)}", parent)
                i = close + 1
            elif top:
                raise SyntaxFailure("MEMBER", self.t[i].start)
            else:
                i = self._member(begin, i, notes, words, owner, parent, type_name, kind)

    def _declare(self, kind: str, name: Token, start: int, end: int, body: int, owner: str, parent: str | None, notes: list[dict], arity: int | None = None) -> str:
        place = self.byte(name.start)
        symbol = framed_digest(self.generation, self.path, kind, str(place))
        skip = [(n["start"], n["end"]) for n in notes]
        signature = " ".join(t.text for t in self.t if start <= t.start < body and not any(a <= t.start < b for a, b in skip))
        signature = re.sub(r" ?([.,()\[\]<>;@]|\.\.\.) ?", r"\1", signature).replace(",", ", ")
        self.out.declarations.append({"symbol_id": symbol, "path": self.path, "name": name.text, "kind": kind, "owner": owner, "parent_id": parent, "start_byte": self.byte(start), "name_start_byte": place,
                                      "range": self.span(start, end), "name_range": self.span(name.start, name.end), "signature": signature.strip(), "arity": arity})
        for n in notes:
            self._note(symbol, n)
        return symbol

    def _type_declaration(self, begin: int, i: int, notes: list[dict], owner: str, parent: str | None, local: bool = False) -> int:
        annotation = self.at(i) == "@"
        kind = "ANNOTATION_TYPE" if annotation else _TYPES[self.at(i)]
        i += 1 + annotation
        name = self.t[i]
        i += 1
        if self.at(i) == "<":
            i = self._generic(i)
        components = None
        if kind == "RECORD":
            components, i = (i + 1, self.match[i]), self.match[i] + 1
        clauses = []
        while self.at(i) in ("extends", "implements", "permits"):
            word, i = self.at(i), i + 1
            while True:
                j = self._type(i)
                if j is None:
                    raise SyntaxFailure("TYPE", self.t[i].start)
                if word != "permits":
                    clauses.append(("IMPLEMENTS" if word == "implements" else "EXTENDS", i, j))
                i = j
                if self.at(i) != ",":
                    break
                i += 1
        if self.at(i) != "{":
            raise SyntaxFailure("TYPE", self.t[min(i, len(self.t) - 1)].start)
        close = self.match[i]
        start = self.t[begin].start
        symbol = self._declare(kind, name, start, self.t[close].end, self.t[i].start, owner, parent, notes)
        own = f"{owner}#local:{name.text}@{self.byte(start)}" if local else f"{owner}.{name.text}" if owner else name.text
        for k, a, b in clauses:
            self._relate(k, a, b, symbol, self._name(a)[0], None)
        if components:
            for a, b in self._split(*components):
                notes_, _, a = self._modifiers(a)
                self._declare("RECORD_COMPONENT", self.t[b - 1], self.t[a].start, self.t[b - 1].end, self.t[b - 1].end, own, symbol, notes_)
        first = i + 1
        if kind == "ENUM":
            first = self._constants(first, close, own, symbol)
        self._members(first, close, own, symbol, name.text, kind=kind)
        return close + 1

    def _constants(self, i: int, end: int, owner: str, parent: str) -> int:
        while i < end and self.at(i) != ";":
            begin = i
            notes, _, i = self._modifiers(i)
            name = self.t[i]
            if name.kind != "id":
                raise SyntaxFailure("CONSTANT", name.start)
            i += 1
            if self.at(i) == "(":
                self._code(i + 1, self.match[i], owner, parent)
                i = self.match[i] + 1
            body = None
            if self.at(i) == "{":
                body, i = i, self.match[i] + 1
            symbol = self._declare("ENUM_CONSTANT", name, self.t[begin].start, self.t[i - 1].end, self.t[body].start if body else self.t[i - 1].end, owner, parent, notes)
            if body:
                self._members(body + 1, i - 1, f"{owner}#enum-constant:{name.text}@{self.byte(self.t[begin].start)}", symbol, None)
            if self.at(i) == ",":
                i += 1
        return i

    def _split(self, i: int, end: int) -> list[tuple[int, int]]:
        """Parts between commas at this level."""
        out, begin, depth = [], i, 0
        while i < end:
            if i in self.match:
                i = self.match[i]
            elif self.at(i) == "<":
                depth += 1
            elif self.at(i) == ">":
                depth -= 1
            elif self.at(i) == "," and depth <= 0:
                out.append((begin, i))
                begin = i + 1
            i += 1
        return [*out, (begin, end)] if begin < end else out

    def _member(self, begin: int, i: int, notes: list[dict], words: list[str], owner: str, parent: str | None, type_name: str | None, kind: str) -> int:
        start = self.t[begin].start
        if self.at(i) == "<":
            i = self._generic(i)
        if type_name and self.at(i) == type_name and self.at(i + 1) in ("(", "{"):
            name, compact = self.t[i], self.at(i + 1) == "{"
            after = i + 1 if compact else self.match[i + 1] + 1
            return self._method("CONSTRUCTOR", name, start, None if compact else i + 1, after, notes, words, owner, parent, ("compact-constructor:" if compact else "constructor:") + name.text)
        j = self._type(i)
        if j is None or j >= len(self.t) or self.t[j].kind != "id":
            raise SyntaxFailure("MEMBER", self.t[i].start)
        name = self.t[j]
        if self.at(j + 1) == "(":
            return self._method("ANNOTATION_MEMBER" if kind == "ANNOTATION_TYPE" else "METHOD", name, start, j + 1, self.match[j + 1] + 1, notes, words, owner, parent, "method:" + name.text, self.at(i))
        while True:
            k = j + 1
            while k < len(self.t) and self.at(k) not in (",", ";"):
                k = self.match[k] + 1 if k in self.match else self._generic(k) if self.at(k) == "<" and self.t[k - 1].kind == "id" and self._is_generic(k) else k + 1
            if k >= len(self.t):
                raise SyntaxFailure("FIELD", name.start)
            symbol = self._declare("FIELD", self.t[j], start, self.t[k].end if self.at(k) == ";" else self.t[k - 1].end, self.t[j].end, owner, parent, notes)
            self._code(j + 1, k, f"{owner}#field:{self.t[j].text}@{self.byte(start)}", symbol)
            if self.at(k) == ";":
                return k + 1
            j = k + 1
            if j >= len(self.t) or self.t[j].kind != "id":
                raise SyntaxFailure("FIELD", self.t[k].start)

    def _is_generic(self, k: int) -> bool:
        try:
            j = self._generic(k)
        except SyntaxFailure:
            return False
        return self.at(j) in ("(", ">", ",", "::", "[", ".") and self.at(k - 1)[:1].isupper()

    def _method(self, kind: str, name: Token, start: int, params: int | None, i: int, notes: list[dict], words: list[str], owner: str, parent: str | None, scope: str, returns: str = "") -> int:
        while i < len(self.t) and self.at(i) not in ("{", ";"):
            i += 1
        if i >= len(self.t):
            raise SyntaxFailure("METHOD", name.start)
        body = i if self.at(i) == "{" else None
        close = self.match[i] if body is not None else i
        parts = self._split(params + 1, self.match[params]) if params is not None else []
        symbol = self._declare(kind, name, start, self.t[close].end, self.t[i].start, owner, parent, notes, len(parts))
        if body is not None:
            if self.t[close].start > self.t[body].end:
                self.out.folds.append({"symbol_id": symbol, "path": self.path, "kind": kind, "start_byte": self.byte(start), "interior": self.span(self.t[body].end, self.t[close].start)})
            self._code(body + 1, close, f"{owner}#{scope}@{self.byte(start)}", symbol)
        if kind == "METHOD" and name.text == "main" and {"public", "static"} <= set(words) and returns == "void" and len(parts) == 1:
            text = "".join(self.at(k) for k in range(*parts[0]) if self.at(k) != "final")
            if re.fullmatch(r"(?:java\.lang\.)?String(?:\[\]|\.\.\.)[\w$]+|(?:java\.lang\.)?String[\w$]+\[\]", text):
                self._candidate(symbol, "MAIN", "MAIN_SIGNATURE", None, {}, [], self.span(start, self.t[close].end))
        return close + 1

    def _code(self, i: int, end: int, owner: str, parent: str | None) -> None:
        """Expressions and statements: nested types, anonymous bodies, calls, constructions, references."""
        while i < end:
            t = self.t[i]
            if t.text == "new" and t.kind == "id":
                j = self._type(i + 1)
                if j is not None and self.at(j) == "(":
                    self._relate("CONSTRUCT", i, j, parent, self._name(i + 1)[0], len(self._split(j + 1, self.match[j])))
                    self._code(j + 1, self.match[j], owner, parent)
                    j = self.match[j] + 1
                    if self.at(j) == "{":
                        self._members(j + 1, self.match[j], f"{owner}#anonymous@{self.byte(t.start)}", parent, None)
                        j = self.match[j] + 1
                    i = j
                    continue
            elif self._is_type(i) and self.at(i - 1) != ".":
                i = self._type_declaration(i, i, [], owner, parent, local=True)
                continue
            elif t.kind == "id" and self.at(i + 1) == "(" and t.text not in _NO_CALL:
                receiver = self.at(i - 2) if self.at(i - 1) == "." else None
                self._relate("CALL", i, i + 1, parent, t.text, len(self._split(i + 2, self.match[i + 1])), receiver)
                self.out.relations[-1]["receiver_type"] = self._receiver_type(receiver) if receiver and self.at(i - 3) != "." else None
                self._framework_call(i, parent, receiver)
            elif t.text == "::" and i + 1 < end and (self.t[i + 1].kind == "id"):
                self._relate("METHOD_REFERENCE", i - 1, i + 2, parent, self.at(i + 1), None, self.at(i - 1))
            i += 1

    def _relate(self, kind: str, a: int, b: int, container: str | None, written: str, arity: int | None, receiver: str | None = None) -> None:
        s = self.span(self.t[a].start, self.t[b - 1].end)
        self.out.relations.append({"relation_id": framed_digest(self.generation, self.path, str(s["start_byte"]), str(s["end_byte"]), kind, written), "path": self.path, "kind": kind, "start_byte": s["start_byte"], "end_byte": s["end_byte"],
                                   "container_symbol_id": container, "written_target": written, "receiver": receiver, "receiver_type": None, "arity": arity, "rule": None})

    def _receiver_type(self, receiver: str) -> str | None:
        """The written type of a variable whose name has one type in this file, or the type that a name itself may be."""
        types = self.variables.get(receiver, set())
        if len(types) == 1:
            return next(iter(types))
        return receiver if not types and receiver[:1].isupper() else None

    def _framework_call(self, i: int, parent: str | None, receiver: str | None) -> None:
        types = self.variables.get(receiver or "", set())
        if len(types) != 1:
            return
        (written,) = types
        known = self._evidence(written, sorted({q for q, m in FRAMEWORK_CALLS if m == self.at(i)}))
        if known is None or known[1] == "AMBIGUOUS_SIMPLE":
            return
        kind, rule, roles = FRAMEWORK_CALLS[known[0], self.at(i)]
        parts = self._split(i + 2, self.match[i + 1])
        if rule == "spring-rabbit-convert-and-send" and len(parts) == 2:
            roles = roles[1:]  # the default exchange
        values = [f"{role}={v[0]}" for role, (a, b) in zip(roles, parts) if (v := self._literals(a, b)) and len(v) == 1 and not re.search(r"[$#]\{", v[0])]
        s = self.span(self.t[i].start, self.t[i].end)
        self.out.relations.append({"relation_id": framed_digest(self.generation, self.path, str(s["start_byte"]), str(s["end_byte"]), kind, known[0]), "path": self.path, "kind": kind, "start_byte": s["start_byte"], "end_byte": s["end_byte"],
                                   "container_symbol_id": parent, "written_target": ".".join((known[0], self.at(i))), "receiver": ",".join(values) or None, "receiver_type": None, "arity": len(parts), "rule": rule})

    # annotations

    def _evidence(self, written: str, names: list[str]) -> tuple[str, str] | None:
        """(qualified name, how it is known) of a written annotation among supported ones."""
        if written in names:
            return written, "FULLY_QUALIFIED"
        if "." in written:
            return None
        direct = [n for n, static in self.imports if not static and not n.endswith(".*") and n.rpartition(".")[2] == written]
        if len(set(direct)) == 1 and written not in self.local_types:
            return (direct[0], "DIRECT_IMPORT") if direct[0] in names else None
        simple = [n for n in names if n.rpartition(".")[2] == written]
        if not simple or direct and not set(direct) & set(simple):
            return None
        return simple[0], "AMBIGUOUS_SIMPLE"

    def _note(self, symbol: str, note: dict) -> None:
        entry = self._evidence(note["name"], list(ENTRY_ANNOTATIONS))
        if entry:
            values, open_ = self._values(note["body"])
            self._candidate(symbol, ENTRY_ANNOTATIONS[entry[0]], entry[1], entry[0] if entry[1] != "AMBIGUOUS_SIMPLE" else note["name"], values, open_, self.span(note["start"], note["end"]))
        rule = self._evidence(note["name"], list(FRAMEWORK_ANNOTATIONS))
        if rule and rule[1] != "AMBIGUOUS_SIMPLE":
            kind, name = FRAMEWORK_ANNOTATIONS[rule[0]]
            s = self.span(note["start"], note["end"])
            self.out.relations.append({"relation_id": framed_digest(self.generation, self.path, str(s["start_byte"]), str(s["end_byte"]), kind, rule[0]), "path": self.path, "kind": kind, "start_byte": s["start_byte"], "end_byte": s["end_byte"],
                                       "container_symbol_id": symbol, "written_target": rule[0], "receiver": None, "receiver_type": None, "arity": None, "rule": name})

    def _candidate(self, symbol: str, kind: str, evidence: str, annotation: str | None, values: dict, open_: list[str], span: dict) -> None:
        self.out.candidates.append({"candidate_id": framed_digest(self.generation, symbol, kind, str(span["start_byte"])), "symbol_id": symbol, "kind": kind, "path": self.path, "start_byte": span["start_byte"],
                                    "evidence": {"kind": evidence, "annotation": annotation, "literal_values": values, "unresolved_members": open_, "range": span}})

    def _values(self, body: tuple[int, int] | None) -> tuple[dict[str, list[str]], list[str]]:
        values: dict[str, list[str]] = {}
        open_: set[str] = set()
        for a, b in self._split(*body) if body else ():
            name = "value"
            if self.at(a + 1) == "=" and self.at(a + 2) != "=":
                name, a = self.at(a), a + 2
            found = self._literals(a, b)
            if found is None or name in values or name in open_:
                open_.add(name)
                values.pop(name, None)
            else:
                values[name] = found
        return values, sorted(open_)

    def _literals(self, a: int, b: int) -> list[str] | None:
        if self.at(a) == "{" and self.match[a] == b - 1:
            parts = [self._literals(x, y) for x, y in self._split(a + 1, b - 1)]
            return None if any(p is None for p in parts) else [v for p in parts for v in p]
        if self.at(a) in ("+", "-") and b - a == 2 and self.t[a + 1].kind == "num":
            return [self.at(a) + self.at(a + 1)]
        if b - a != 1:
            return None
        t = self.t[a]
        if t.kind == "text" and not t.text.startswith('"""') or t.kind == "char":
            return [re.sub(r"\\(u+[0-9a-fA-F]{4}|[0-7]{1,3}|.)", _escape, t.text[1:-1])]
        return [t.text] if t.kind == "num" or t.text in ("true", "false", "null") else None


def _escape(m: re.Match) -> str:
    e = m[1]
    if e[0] == "u":
        return chr(int(e.lstrip("u"), 16))
    if e[0] in "01234567":
        return chr(int(e, 8))
    return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " "}.get(e, e)


def extract(generation: str, path: str, source: str) -> Parsed:
    return Extractor(generation, path, source).run()
