"""Text-to-rows extractors for source files: symbols and imports per language, in plain Python.

The leaves of the engine: one call per file, applied over Arrow batches by ``operators.parse``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# --- fixed values: file extensions and their languages, the document languages, the line patterns of each language
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "vue": "vue",
    "svelte": "svelte", "php": "php", "rb": "ruby", "cs": "csharp", "md": "markdown", "markdown": "markdown",
    "yaml": "yaml", "yml": "yaml", "txt": "text",
}
DOCUMENT_LANGUAGES = ("markdown", "yaml", "text")

SYMBOL_PATTERNS = {
    "java": [
        ("class", r"^[ \t]*(?:(?:public|protected|private|static|abstract|final|sealed|non-sealed)\s+)*(?:class|interface|enum|record|@interface)\s+(\w+)"),
        ("method", r"^[ \t]+(?:(?:public|protected|private|static|abstract|final|synchronized|default|native)\s+)*(?:<[^>]+>\s+)?(?:void|boolean|int|long|double|float|String|[\w][\w.<>, \[\]]*?)\s+(\w+)\s*\("),
    ],
    "kotlin": [
        ("class", r"^[ \t]*(?:(?:public|private|protected|internal|abstract|open|sealed|data|inner|inline|value|annotation|enum)\s+)*(?:class|interface|object)\s+(\w+)"),
        ("function", r"^[ \t]*(?:(?:public|private|protected|internal|override|abstract|open|suspend|inline|operator|infix|tailrec|external)\s+)*fun\s+(?:<[^>]+>\s+)?(\w+)\s*[(<]"),
    ],
    "python": [("class", r"^class\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)")],
    "php": [
        ("class", r"^(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum)\s+(\w+)"),
        ("function", r"^[ \t]*(?:(?:public|protected|private|static|abstract|final)\s+)*function\s+(\w+)\s*\("),
    ],
    "ruby": [("class", r"^[ \t]*(?:(?:module|class)\s+(\w+))"), ("method", r"^[ \t]*def\s+(?:self\.)?(\w+[?!]?)")],
    "csharp": [
        ("class", r"^[ \t]*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly)\s+)*(?:class|interface|struct|enum|record)\s+(\w+)"),
        ("method", r"^[ \t]*(?:(?:public|private|protected|internal|static|abstract|virtual|override|async|extern|sealed|new)\s+)*(?:<[^>]+>\s+)?[\w\[\]<>?,\s]+\s+(\w+)\s*\("),
    ],
    "go": [("class", r"^type\s+(\w+)\s+(?:struct|interface)"), ("function", r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*[(<[]")],
    "rust": [
        ("class", r"^(?:pub(?:\([^)]+\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)"),
        ("function", r"^(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
        ("variable", r"^(?:pub(?:\([^)]+\))?\s+)?(?:type|const|static)\s+(\w+)"),
    ],
}
IMPORT_PATTERNS = {
    "java": r"^import\s+(?:static\s+)?([^;]+);",
    "kotlin": r"^import\s+([\w.]+)(?:\s+as\s+\w+)?",
    "python_from": r"^from\s+(\S+)\s+import\s+(.+)",
    "python": r"^import\s+(\S+)",
    "php": r"^use\s+([^;]+);",
    "ruby": r"^[ \t]*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "csharp": r"^using(?:\s+static)?\s+([\w.]+);",
    "go": r"^import\s+\"([^\"]+)\"",
    "go_block": r"^import\s*\(([^)]+)\)",
    "rust": r"^use\s+([\w:*{}]+(?:::\{[^}]+\})?)\s*;",
}
ROUTE_METHODS = frozenset(["get", "post", "put", "patch", "delete", "head", "options"])
SIGNATURE_CUT, TYPE_CUT = 80, 50
# --- end of fixed values

# The patterns follow ECMAScript: \w is ASCII, \s knows the Unicode spaces, a dot stops at any line end.
_SPACES = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_TRIM = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def ecma(pattern: str) -> re.Pattern:
    """Compile an ECMAScript pattern of the kind above."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            body = _SPACES if in_class else f"[{'^' if two == chr(92) + 'S' else ''}{_SPACES}]"
            out.append(body)
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        if two[0] == "[" and not in_class:
            in_class = True
            out.append("[")
            i += 1
            continue
        if two[0] == "[":
            out.append(r"\[")
            i += 1
            continue
        in_class = in_class and two[0] != "]"
        out.append("[^\\n\\r\\u2028\\u2029]" if two[0] == "." and not in_class else two[0])
        i += 1
    return re.compile("".join(out), re.M | re.A)


_SYMBOLS = {lang: [(kind, ecma(p)) for kind, p in ps] for lang, ps in SYMBOL_PATTERNS.items()}
_IMPORTS = {k: ecma(p) for k, p in IMPORT_PATTERNS.items()}
_AS = ecma(r"\s+as\s+")
_GO_QUOTED = re.compile('"([^"]+)"')
_MANY_SPACES = ecma(r"\s+")
_SCRIPT = re.compile(rf"<script(?:[{_SPACES}][^>]*)?>([\s\S]*?)</script>", re.I)


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str
    start_line: int
    end_line: int
    is_exported: bool
    is_async: bool = False
    has_try_catch: bool = False


@dataclass
class Import:
    source: str
    symbols: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    language: str
    symbols: list[Symbol]
    imports: list[Import]


def language_of(path: str) -> str:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower(), "unknown")


def collapse(text: str) -> str:
    return _MANY_SPACES.sub(" ", text.strip(_TRIM))


def utf16_cut(text: str, units: int) -> str:
    """The first so many UTF-16 units of a text."""
    if len(text) * 2 <= units or text.isascii():
        return text[:units]
    return text.encode("utf-16-le", "surrogatepass")[: 2 * units].decode("utf-16-le", "replace")


# --- line patterns


def pattern_symbols(language: str, content: str) -> list[Symbol]:
    """Pattern by pattern, in order of appearance; the line is that on which the match begins."""
    lines = content.split("\n")
    out = []
    for kind, pattern in _SYMBOLS[language]:
        line, seen = 1, 0
        for m in pattern.finditer(content):
            line += content.count("\n", seen, m.start())
            seen = m.start()
            out.append(Symbol(m.group(1), kind, utf16_cut(collapse(lines[line - 1]), SIGNATURE_CUT), line, line, True))
    return out


def _dotted(content: str, key: str, separator: str, star: bool) -> Iterator[Import]:
    for m in _IMPORTS[key].finditer(content):
        source, _, last = m.group(1).strip(_TRIM).rpartition(separator)
        yield Import(source, [] if star and last == "*" else [last])


def pattern_imports(language: str, content: str) -> list[Import]:
    if language in ("java", "kotlin"):
        return list(_dotted(content, language, ".", True))
    if language == "csharp":
        return list(_dotted(content, language, ".", False))
    if language == "php":
        return list(_dotted(content, language, "\\", False))
    if language == "python":
        named = [
            Import(m.group(1), [s for s in (_AS.split(x.strip(_TRIM))[0].strip(_TRIM) for x in m.group(2).split(",")) if s])
            for m in _IMPORTS["python_from"].finditer(content)
        ]
        return named + [Import(m.group(1)) for m in _IMPORTS["python"].finditer(content)]
    if language == "go":
        blocks = (q for m in _IMPORTS["go_block"].finditer(content) for q in _GO_QUOTED.findall(m.group(1)))
        return [*(Import(m.group(1)) for m in _IMPORTS["go"].finditer(content)), *map(Import, blocks)]
    return [Import(m.group(1)) for m in _IMPORTS[language].finditer(content)]


# --- TypeScript


@dataclass
class Token:
    kind: str  # name, number, string, template, regex, punct
    text: str
    start: int
    end: int
    line: int


_LEX = re.compile(
    r"(?P<space>[\s\ufeff]+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<name>[#@]?[\w$]+)"
    r"|(?P<string>'(?:[^'\\\n]|\\[\s\S])*'?|\"(?:[^\"\\\n]|\\[\s\S])*\"?)|(?P<tick>`)|(?P<slash>/)"
    r"|(?P<punct>=>|\?\.|\.\.\.|[\s\S])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
#: What a brace follows that opens an object literal, and words that look like a method where it is a block after all.
_BEFORE_OBJECT = frozenset("= ( , : [ ? & | return".split())
_NO_METHOD = frozenset("if for while switch catch with function return do else try finally class".split())
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else await yield instanceof".split())


def _template_end(text: str, i: int) -> int:
    """Index after the backtick that closes the template begun before i."""
    n = len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, i = 1, i + 2
            while i < n and depth:
                m = _LEX.match(text, i)
                if m.lastgroup == "tick":
                    i = _template_end(text, m.end())
                    continue
                depth += {"{": 1, "}": -1}.get(m.group(), 0) if m.lastgroup == "punct" else 0
                i = m.end()
        else:
            i += 1
    return n


def tokenize(text: str) -> list[Token]:
    """Tokens of TypeScript source, without comments and white space."""
    out: list[Token] = []
    i, line = 0, 1
    while i < len(text):
        m = _LEX.match(text, i)
        kind, end = m.lastgroup, m.end()
        if kind == "tick":
            kind, end = "template", _template_end(text, end)
        elif kind == "slash":
            last = out[-1] if out else None
            value = last and (last.kind in ("number", "string", "template", "regex") or last.text in (")", "]", "}") or last.kind == "name" and last.text not in _BEFORE_REGEX)
            r = None if value else _REGEX.match(text, i)
            kind, end = ("regex", r.end()) if r else ("punct", end)
        if kind not in ("space", "comment"):
            word = text[i:end]
            out.append(Token("number" if kind == "name" and word[0].isdigit() else kind, word, i, end, line))
        line += text.count("\n", i, end)
        i = end
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class TypeScript:
    """Top-level declarations, class methods, exported constants, routes and imports, found from tokens."""

    def __init__(self, text: str):
        self.text, self.t = text, tokenize(text)
        self.pair = self._pairs()

    def _pairs(self) -> dict[int, int]:
        pair, stack = {}, []
        for i, x in enumerate(self.t):
            if x.kind == "punct" and x.text in _OPEN:
                stack.append(i)
            elif x.kind == "punct" and x.text in _CLOSE:
                while stack:
                    j = stack.pop()
                    if _OPEN[self.t[j].text] == x.text:
                        pair[j] = i
                        break
        for j in stack:
            pair[j] = len(self.t) - 1
        return pair

    def at(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def after(self, i: int) -> int:
        """The index past the token, or past the bracket it opens."""
        return self.pair.get(i, i) + 1

    def has_try(self, a: int, b: int) -> bool:
        return any(x.text == "try" and x.kind == "name" and self.at(k + 1) == "{" and self.at(k - 1) not in (".", "?.") for k, x in enumerate(self.t[a:b], a))

    def line_of_end(self, i: int) -> int:
        x = self.t[min(i, len(self.t) - 1)]
        return x.line + x.text.count("\n")

    def angles(self, i: int) -> int:
        """Past the type parameters that begin at i, if any."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            depth += {"<": 1, ">": -1}.get(self.at(i), 0)
            i = self.after(i) if self.at(i) in _OPEN else i + 1
            if not depth:
                break
        return i

    def type_end(self, i: int, stops: tuple[str, ...]) -> int:
        """Past a type that begins at i: up to a stop at its own level, or a line that cannot continue it. A brace
        belongs to the type at its begin and after an operator."""
        begin, depth = i, 0
        while i < len(self.t):
            x = self.at(i)
            fresh = i == begin or self.at(i - 1) in ("|", "&", ":", "=", "=>", "extends", "?", "<", ",", "is", "keyof", "readonly")
            if not depth and x in stops and not (x == "{" and fresh):
                break
            if not depth and not fresh and self.t[i].line > self.line_of_end(i - 1) and x not in ("|", "&", "?", ":", "=>", "extends", "[", ">", "."):
                break
            depth += {"<": 1, ">": -1}.get(x, 0)
            i = self.after(i) if x in _OPEN else i + 1
        return i

    def callable_at(self, name: int, a: int) -> tuple[str, int] | None:
        """Signature and the index past the body of a function or method whose name is at ``name`` and that began at
        a; None without a body."""
        i = self.angles(name + 1)
        if self.at(i) == "?":
            i = self.angles(i + 1)
        if self.at(i) != "(":
            return None
        close = self.pair.get(i, i)
        end = close + 1
        if self.at(end) == ":":
            end = self.type_end(end + 1, ("{", ";"))
        if self.at(end) != "{":
            return None
        spoken = self.t[name].text + self.text[self.t[i].start : self.t[close].end]
        if self.at(close + 1) == ":":
            spoken += self.text[self.t[close + 1].start : self.t[end - 1].end]
        return collapse(spoken), self.after(end)

    def methods(self, a: int, b: int) -> list[Symbol]:
        """Methods with a body among the members of a class between a and b, and those of the object literals inside it,
        in order."""
        found = list(self.members(a, b))
        for i in range(a, b):
            if self.at(i) == "{" and self.at(i - 1) in _BEFORE_OBJECT and self.t[i].kind == "punct":
                found += ((k, s) for k, s in self.members(i + 1, self.pair.get(i, i)) if s.name not in _NO_METHOD)
        return [s for _, s in sorted(found, key=lambda x: x[0])]

    def members(self, a: int, b: int) -> Iterator[tuple[int, Symbol]]:
        """(place, method) of the methods with a body between a and b, at that level."""
        i, begin = a, a
        while i < b:
            x = self.t[i]
            if x.text in (";", "}", ",") or (x.text == "@" or x.text.startswith("@")):
                i += 1
                if x.text.startswith("@"):  # a decorator with its arguments
                    while self.at(i) == ".":
                        i += 2
                    if self.at(i) == "(":
                        i = self.after(i)
                begin = i
                continue
            if x.kind in ("name", "string", "number") and self.at(i + 1) in ("(", "<", "?") or x.text == "[" and self.at(self.after(i)) in ("(", "<"):
                name = i
                found = self.callable_at(name, begin) if x.text != "[" else None
                if found:
                    words = [w.text for w in self.t[begin:name]]
                    if x.text != "constructor":
                        yield begin, Symbol(x.text, "method", found[0], self.t[begin].line, self.line_of_end(found[1] - 1), False, "async" in words, self.has_try(begin, found[1]))
                    i = begin = found[1]
                    continue
            if x.text in ("=", ":"):  # a property: skip its value or type
                i += 1
                while i < b and self.at(i) not in (";", ",") and not (self.t[i].line > self.line_of_end(i - 1) and self.at(i - 1) not in ("=", "=>", ":", "|", "&", "+", "?") and self.at(i) not in ("|", "&", "=", "=>", ".", "?", ":", "+", "(")):
                    i = self.after(i)
                begin = i
                continue
            i = self.after(i)
            if i < b and self.t[i].line > self.line_of_end(i - 1) and self.t[i - 1].text not in ("static", "async", "public", "private", "protected", "readonly", "override", "get", "set", "abstract"):
                begin = i

    def statement_end(self, i: int) -> int:
        """Past the statement that begins at i."""
        while i < len(self.t):
            if self.at(i) == ";":
                return i + 1
            n = self.after(i)
            if n < len(self.t) and self.t[n].line > self.line_of_end(n - 1):
                last, nxt = self.t[n - 1], self.t[n]
                open_ended = last.kind == "punct" and last.text not in (")", "]", "}") or last.text in _BEFORE_REGEX
                if not open_ended and not (nxt.kind == "punct" and nxt.text not in ("{", ";", "@", "+", "-", "!", "~")) and nxt.text not in ("instanceof", "in", "as", "satisfies"):
                    return n
            i = n
        return i

    def declaration(self, a: int, i: int, exported: bool) -> tuple[list[Symbol], int] | None:
        """Symbols of the declaration whose keyword is at i, its statement having begun at a."""
        k, flags = i, set()
        if self.at(k) == "async" and self.at(k + 1) == "function":
            flags.add("async")
            k += 1
        word, name = self.at(k), self.at(k + 1)
        line = self.t[i].line
        if word == "function":
            if name in ("*", "("):
                return None
            found = self.callable_at(k + 1, i)
            if not found:
                return None
            sig, end = found
            return [Symbol(name, "function", sig, line, self.line_of_end(end - 1), exported, "async" in flags, self.has_try(i, end))], end
        if word == "const" and name == "enum":
            k, word, name = k + 1, "enum", self.at(k + 2)
        if word in ("class", "interface", "enum") and k + 1 < len(self.t) and self.t[k + 1].kind == "name" and name not in ("extends", "implements"):
            j = self.angles(k + 2)
            while j < len(self.t) and self.at(j) != "{":
                j = self.angles(j) if self.at(j) == "<" else self.after(j)
            end = self.after(j)
            own = Symbol(name, word, f"{word} {name}", line, self.line_of_end(end - 1), exported, False, self.has_try(i, end))
            return [own, *(self.methods(j + 1, end - 1) if word == "class" else ())], end
        if word == "type" and k + 1 < len(self.t) and self.t[k + 1].kind == "name" and self.t[k + 1].line == self.t[k].line:
            j = self.angles(k + 2)
            if self.at(j) != "=":
                return None
            end = self.type_end(j + 1, (";",))
            value = self.text[self.t[j + 1].start : self.t[end - 1].end] if end > j + 1 else "..."
            if len(value.encode("utf-16-le")) // 2 > TYPE_CUT:
                value = utf16_cut(value, TYPE_CUT - 3) + "..."
            return [Symbol(name, "type", f"type {name} = {value}", line, self.line_of_end(end - 1), exported)], end + (self.at(end) == ";")
        if exported and word in ("const", "let", "var"):
            end = self.statement_end(k)
            last = self.line_of_end(end - 1)
            out, j = [], k + 1
            while j < end and self.at(j) != ";":
                title, stop = j, j
                while stop < end and self.at(stop) not in (",", ";"):
                    stop = self.angles(stop) if self.at(stop) == "<" and stop > title and self.at(stop - 1) in (title, ":") else self.after(stop)
                eq = title
                while eq < stop and self.at(eq) != "=":
                    eq = self.after(eq)
                spoken = self.text[self.t[title].start : self.t[self.after(title) - 1].end]
                out.append(Symbol(spoken, "const", spoken, line, last, True, eq + 1 < stop and self.at(eq + 1) == "async", eq < stop and self.has_try(eq, stop)))
                j = stop + 1
            return out, end
        return None

    def route(self, a: int, b: int) -> Symbol | None:
        """The route that the expression statement between a and b registers."""
        end = b - 1 if self.at(b - 1) == ";" else b
        if self.at(end - 1) != ")" or self.at(a) in ("await", "new", "void", "delete"):
            return None
        i = a
        call = None
        while i < end:  # the last call at the statement's own level
            if self.at(i) == "(":
                call = i
            elif self.t[i].kind == "punct" and self.at(i) not in (".", "?.", "[", "{", "<", ">"):
                return None
            i = self.after(i)
        if call is None or self.pair.get(call) != end - 1 or call - 2 < a or self.at(call - 2) not in (".", "?."):
            return None
        method = self.at(call - 1).lower()
        if method not in ROUTE_METHODS:
            return None
        args, j, begin = [], call + 1, call + 1
        while j < end - 1:
            if self.at(j) == ",":
                args.append((begin, j))
                begin = j = j + 1
            else:
                j = self.after(j)
        if begin < end - 1:
            args.append((begin, end - 1))
        if not args:
            return None
        path = re.sub(r"^['\"`]|['\"`]$", "", self.text[self.t[args[0][0]].start : self.t[args[0][1] - 1].end])
        if not path.startswith("/"):
            return None
        x, y = args[-1]
        title = f"{method.upper()} {path}"
        return Symbol(title, "route", title, self.t[a].line, self.line_of_end(b - 1), False, self.at(x) == "async", self.has_try(x, y))

    def imported(self, a: int, b: int) -> Import | None:
        source = next((x for x in reversed(self.t[a:b]) if x.kind == "string"), None)
        if source is None or "=" in [x.text for x in self.t[a:b]] or self.at(a + 1) in ("(", "."):
            return None
        names = []
        for i in range(a, b):
            if self.at(i) == "{":
                j = i + 1
                while j < self.pair.get(i, i):
                    k = j + 1 if self.at(j) == "type" and self.at(j + 1) not in (",", "}", "as") else j
                    names.append(self.at(k))
                    while j < self.pair[i] and self.at(j) != ",":
                        j += 1
                    j += 1
                break
        return Import(re.sub(r"^['\"`]|['\"`]$", "", source.text), [n for n in names if n])

    def parse(self) -> tuple[list[Symbol], list[Import]]:
        symbols: list[Symbol] = []
        imports: list[Import] = []
        i = 0
        while i < len(self.t):
            a, word = i, self.at(i)
            if word.startswith("@"):
                i += 1
                while self.at(i) == ".":
                    i += 2
                i = self.after(i) if self.at(i) == "(" else i
                continue
            if word == "import" and self.at(i + 1) not in ("(", "."):
                i = self.statement_end(i)
                found = self.imported(a, i)
                imports += [found] if found else []
                continue
            exported = word == "export"
            if exported:
                i += 2 if self.at(i + 1) == "default" else 1
            made = self.declaration(a, i, exported)
            if made:
                symbols += made[0]
                i = max(made[1], a + 1)
                continue
            i = max(self.statement_end(i), a + 1)
            if not exported:
                found = self.route(a, i)
                symbols += [found] if found else []
        return symbols, imports


def script_block(content: str) -> str:
    """The first script block of a single-file component."""
    m = _SCRIPT.search(content)
    return m.group(1) if m else ""


def parse_file(path: str, content: str | None) -> Parsed:
    """Symbols and imports of one file; a file that cannot be parsed has none."""
    language = language_of(path)
    if not content:
        return Parsed(language, [], [])
    try:
        if language in _SYMBOLS:
            return Parsed(language, pattern_symbols(language, content), pattern_imports(language, content))
        if language in ("vue", "svelte"):
            content = script_block(content)
        elif language not in ("typescript", "tsx"):
            return Parsed(language, [], [])
        return Parsed(language, *TypeScript(content).parse())
    except (IndexError, RecursionError, KeyError):
        return Parsed(language, [], [])
