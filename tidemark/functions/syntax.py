"""Definitions in source texts of six languages, found by a scanner: comments and strings are
blanked, headers matched at the starts of statements, and bodies ended by their closing bracket
(or keyword). No grammar is needed; texts whose brackets don't close are refused."""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = r"[A-Za-z_$][\w$]*"
_NOT_METHODS = frozenset("if for while switch catch function return with super new await typeof else do try match synchronized throw case".split())
_OPEN, _CLOSE = "([{", ")]}"


@dataclass
class Definition:
    start: int
    end: int
    kind: str
    name: str


def blanked(source: str, language: str) -> str:
    """The text with comments and the insides of strings as spaces; lengths and line ends stay."""
    out, i, n = list(source), 0, len(source)
    before = ""  # the last character of code, for telling a regular expression from a division

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def until(mark: str, at: int, escapes: bool = True) -> int:
        while at < n:
            if escapes and source[at] == "\\":
                at += 2
            elif source.startswith(mark, at):
                return at + len(mark)
            else:
                at += 1
        return n

    while i < n:
        c, two = source[i], source[i : i + 2]
        if language == "ruby":
            if c == "#":
                to = until("\n", i, False)
                to -= to <= n and source[to - 1 : to] == "\n"
            elif source.startswith("=begin", i) and (i == 0 or source[i - 1] == "\n"):
                to = until("\n=end", i, False)
            elif c in "\"'`":
                to = until(c, i + 1)
            else:
                before, i = c, i + 1
                continue
        elif two == "//":
            to = until("\n", i, False)
            to -= source[to - 1 : to] == "\n"
        elif two == "/*":
            to, deep = i + 2, 1
            while to < n and deep:
                if source.startswith("*/", to):
                    deep, to = deep - 1, to + 2
                elif language == "rust" and source.startswith("/*", to):
                    deep, to = deep + 1, to + 2
                else:
                    to += 1
        elif language == "rust" and (raw := re.compile(r'b?r(#*)"').match(source, i)) and not (i and (source[i - 1].isalnum() or source[i - 1] == "_")):
            to = until('"' + raw.group(1), raw.end(), False)
        elif language == "java" and source.startswith('"""', i):
            to = until('"""', i + 3)
        elif c == '"' or (c == "'" and language not in ("rust",)) or (c == "`" and language in ("javascript", "typescript", "go")):
            to = until(c, i + 1, not (c == "`" and language == "go"))
        elif c == "'" and (char := re.compile(r"'(?:\\.[^']*|[^'\\])'").match(source, i)):
            to = char.end()  # a character; a lifetime has no closing mark
        elif c == "/" and language in ("javascript", "typescript") and (before in "" or before in "(,=:[!&|?{};+-*%<>~^") and (rx := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(source, i)):
            to = rx.end()
        else:
            before = c if not c.isspace() else before
            i += 1
            continue
        blank(i, to)
        before, i = "x" if c in "\"'`/" else before, to
    return "".join(out)


def brackets(code: str) -> tuple[dict[int, int], list[int]]:
    """(closing place of each opening bracket, the innermost open brace at each place or -1)."""
    stack: list[int] = []
    ends: dict[int, int] = {}
    braces: list[int] = []
    within = []
    for i, c in enumerate(code):
        within.append(braces[-1] if braces else -1)
        if c in _OPEN:
            stack.append(i)
            if c == "{":
                braces.append(i)
        elif c in _CLOSE:
            if not stack or _OPEN.index(code[stack[-1]]) != _CLOSE.index(c):
                raise ValueError("brackets don't match")
            at = stack.pop()
            ends[at] = i
            if c == "}":
                braces.pop()
    if stack:
        raise ValueError("a bracket isn't closed")
    return ends, within


_JS = [
    ("function", re.compile(rf"(?P<def>(?:async\s+)?function\s*(?P<star>\*)?\s*(?P<name>{_WORD}))\s*[(<]")),
    ("class_declaration", re.compile(rf"(?P<def>(?:abstract\s+)?class\s+(?P<name>{_WORD}))")),
]
_TS = [
    *_JS,
    ("interface_declaration", re.compile(rf"(?P<def>interface\s+(?P<name>{_WORD}))")),
    ("enum_declaration", re.compile(rf"(?P<def>(?:const\s+)?enum\s+(?P<name>{_WORD}))")),
    ("type_alias_declaration", re.compile(rf"(?P<def>type\s+(?P<name>{_WORD}))\s*(?:<[^=;]*>)?\s*=")),
]
_HEADERS = {
    "javascript": _JS,
    "typescript": _TS,
    "go": [
        ("method_declaration", re.compile(r"(?P<def>func\s*\([^)]*\)\s*(?P<name>\w+))\s*[(\[]")),
        ("function_declaration", re.compile(r"(?P<def>func\s+(?P<name>\w+))\s*[(\[]")),
        ("type_declaration", re.compile(r"(?P<def>type\s+(?:\w+|\())")),
    ],
    "rust": [
        ("function_item", re.compile(r"(?P<def>(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+))")),
        *((f"{k}_item", re.compile(rf"(?P<def>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{k}\s+(?P<name>\w+))")) for k in ("struct", "enum", "trait", "mod")),
        ("impl_item", re.compile(r"(?P<def>(?:unsafe\s+)?impl\b)")),
    ],
    "java": [(f"{k}_declaration", re.compile(rf"(?P<def>{k}\s+(?P<name>\w+))\s*(?:[<({{]|extends|implements|permits)")) for k in ("class", "interface", "enum", "record")],
}
_JS_METHOD = re.compile(rf"(?P<def>(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract)\s+)*(?:\*\s*)?(?P<name>#?{_WORD}))\s*(?:<[^(){{}};]*>)?\s*\(")
_JAVA_METHOD = re.compile(r"(?P<name>[A-Za-z_$][\w$]*)\s*\(")


def _statement_start(code: str, at: int) -> int:
    """Where the statement that holds `at` begins: after the last ; { or } before it."""
    cut = max(code.rfind(c, 0, at) for c in ";{}") + 1
    return cut + len(code[cut:at]) - len(code[cut:at].lstrip())


def _body_end(code: str, ends: dict[int, int], at: int, language: str) -> int | None:
    """The end of a definition whose header ends at `at`: past its body, or its semicolon."""
    i, n = at, len(code)
    while i < n:
        c = code[i]
        if c == "{":
            return ends[i] + 1
        if c == ";":
            return i + 1
        if c in "([":
            i = ends[i]
        elif c == "\n" and language == "go" and code[at:i].strip() and code[i - 1] not in "({[,":
            return i
        elif c == "}":
            return None
        i += 1
    return n if language == "go" else None


def _braced(source: str, language: str) -> list[Definition]:
    code = blanked(source, language)
    ends, within = brackets(code)
    found: dict[int, Definition] = {}
    containers: dict[int, str] = {}  # the opening brace of a class-like body: its name

    def add(start: int, end: int | None, kind: str, name: str) -> None:
        if end is not None and start not in found:
            found[start] = Definition(start, end, kind, name)

    for kind, pattern in _HEADERS[language]:
        for m in pattern.finditer(code):
            start = m.start("def")
            lead = code[_statement_start(code, start) : start]
            if re.fullmatch(r"(?:\s|@[\w.]+(?:\([^)]*\))?|#!?\[[^\]]*\]|\b(?:export|default|declare|abstract|public|private|protected|static|final|sealed|non-sealed|strictfp)\b)*", lead) is None:
                # statements may also be parted by line ends alone
                line = code[code.rfind("\n", 0, start) + 1 : start]
                if re.fullmatch(r"\s*(?:(?:export|default|declare)\s+)*", line) is None or lead.rstrip()[-1:] in "=(,:?&|+.":
                    continue
            name = m.groupdict().get("name")
            if kind == "function":
                kind_ = "generator_function_declaration" if m.group("star") else "function_declaration"
            else:
                kind_ = kind
            end = _body_end(code, ends, m.end("def"), language)
            if kind == "type_alias_declaration":
                end = _alias_end(code, ends, m.end())
            if kind == "type_declaration" and code[m.end() - 1] == "(":
                end = ends[m.end() - 1] + 1
            if language == "java":
                start = _statement_start(code, start)
            add(start, end, kind_, name or kind_)
            body = code.find("{", m.end("def"))
            if kind_ in ("class_declaration", "interface_declaration", "enum_declaration", "record_declaration") and end is not None and 0 <= body < end:
                containers[body] = name or kind_
    if language in ("javascript", "typescript"):
        for m in _JS_METHOD.finditer(code):
            name, paren = m.group("name"), m.end() - 1
            before = code[: m.start()].rstrip()[-1:]
            line = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
            if name in _NOT_METHODS or paren not in ends or within[m.start()] < 0 or not (before in "{};," or (not line.strip() and before not in "=(:?&|+.")):
                continue
            after = re.compile(r"\s*(?::[^={};]*?)?\s*\{").match(code, ends[paren] + 1)
            if after and (within[m.start()] in containers or ":" not in after.group()):
                add(m.start(), ends[after.end() - 1] + 1, "method_definition", name)
    if language == "java":
        for m in _JAVA_METHOD.finditer(code):
            name, paren, home = m.group("name"), m.end() - 1, within[m.start()]
            if home not in containers or name in _NOT_METHODS:
                continue
            start = _statement_start(code, m.start())
            lead = re.sub(r"@[\w.]+(?:\([^)]*\))?", " ", code[start : m.start()])
            after = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws[\w\s.,]+)?(?:default[^;]*)?([{;])").match(code, ends[paren] + 1)
            if "=" in lead or "." in lead[-1:] or "(" in lead or not after or re.search(r"\b(?:new|return|throw)\s*$", lead):
                continue
            while (plain := re.sub(r"<[^<>()]*>", " ", lead)) != lead:
                lead = plain
            typed = re.sub(r"\b(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\b", " ", lead).strip()
            if not typed and (name != containers[home] or after.group(1) == ";"):
                continue
            end = ends[after.end() - 1] + 1 if after.group(1) == "{" else after.end()
            add(start, end, "method_declaration" if typed else "constructor_declaration", name)
    return list(found.values())


def _alias_end(code: str, ends: dict[int, int], at: int) -> int:
    i = at
    while i < len(code):
        if code[i] in _OPEN:
            i = ends[i]
        elif code[i] == ";":
            return i + 1
        elif code[i] == "\n" and code[at:i].strip() and code[:i].rstrip()[-1:] not in "|&=," and code[i:].lstrip()[:1] not in "|&":
            return i
        i += 1
    return len(code)


_RUBY_DEF = re.compile(r"\s*(?P<word>def|class|module)\s+(?P<name>self\.[\w?!=]+|[\w:]+\.[\w?!=]+|[\w:]+[?!=]?|<<\s*\w+|[+\-*/<=>\[\]%!~^&|]+)")
_RUBY_OPEN = re.compile(r"\s*(?:(?:if|unless|while|until|case|begin|for)\b|[\w@.\[\]]+\s*(?:\|\||&&|[+\-*/])?=\s*(?:if|unless|case|begin|while)\b)")
_RUBY_KINDS = {"class": "class", "module": "module"}


def _ruby(source: str) -> list[Definition]:
    code = blanked(source, "ruby")
    found, stack, at = [], [], 0
    for line in code.split("\n"):
        for piece in re.split(r"(;)", line):
            head = _RUBY_DEF.match(piece)
            endless = head and head.group("word") == "def" and re.match(r"\s*(?:\([^)]*\))?\s*=\s", piece[head.end() :])
            if head:
                name = head.group("name")
                single = head.group("word") == "def" and "." in name
                kind = _RUBY_KINDS.get(head.group("word"), "singleton_method" if single else "method")
                start = at + head.start("word")
                plain = kind if name.startswith("<<") else name.rsplit(".", 1)[-1] if single else name
                if endless:
                    found.append(Definition(start, at + len(piece), kind, plain))
                else:
                    stack.append((start, kind, plain))
            elif _RUBY_OPEN.match(piece):
                stack.append(None)
            loop = re.match(r"\s*(?:while|until|for)\b", piece)
            if re.search(r"\bdo\b\s*(?:\|[^|]*\|)?\s*$", piece) and not loop:
                stack.append(None)
            for m in re.finditer(r"(?<![\w.:@$])end\b(?![?!:=\w])", piece):
                if not stack:
                    raise ValueError("an end without a beginning")
                top = stack.pop()
                if top is not None:
                    found.append(Definition(top[0], at + m.end(), top[1], top[2]))
            at += len(piece)
        at += 1
    if stack:
        raise ValueError("a definition isn't ended")
    return found


LANGUAGES = ("javascript", "typescript", "go", "rust", "ruby", "java")


def definitions(source: str, language: str) -> list[tuple[Definition, list[str]]]:
    """The innermost definitions of a text in order, each with the names of those around it and its
    own. ValueError if the text's brackets or ends don't match."""
    found = sorted(_ruby(source) if language == "ruby" else _braced(source, language), key=lambda d: (d.start, -d.end))
    out: list[tuple[Definition, list[str]]] = []
    around: list[Definition] = []
    holds: set[int] = set()
    trails = []
    for d in found:
        while around and around[-1].end <= d.start:
            around.pop()
        holds.update(id(x) for x in around)
        trails.append((d, [*(x.name for x in around), d.name]))
        around.append(d)
    for d, trail in trails:
        if id(d) not in holds:
            out.append((d, trail))
    return out
