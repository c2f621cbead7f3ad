"""Symbols of a source file: functions, methods, classes and interfaces with their spans, parents and leading comments.

Python is parsed by the standard library. The other languages are read from a copy of the text in which comments and
the insides of strings are blanked, so that brackets can be paired; declarations are found by their heads, bodies by
their brackets (or by `end`). A syntax error costs no file: what can't be paired is left out.

Where a full syntax tree would name a thing oddly, the plain name is given: a Go type has its own name, a C function that
returns a pointer the name alone, and a C struct counts where it is defined, not where it is used.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
from dataclasses import dataclass

ANONYMOUS = "<anonymous>"


@dataclass
class Symbol:
    kind: str
    name: str
    start: int  # places in the text, in characters
    end: int
    doc: str | None = None
    parent: str | None = None


def symbols(text: str, language: str) -> list[Symbol]:
    """All symbols in order of their starts, outer ones first; those inside a class or interface have it as parent."""
    find = _FINDERS.get(language)
    if find is None or not text:
        return []
    found = sorted(find(text), key=lambda s: (s.start, -s.end))
    open_: list[Symbol] = []
    for s in found:
        while open_ and open_[-1].end <= s.start:
            open_.pop()
        s.parent = next((o.name for o in reversed(open_) if o.kind in ("class", "interface") and o.end >= s.end), None)
        open_.append(s)
    return found


# ---- text with comments and strings blanked


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


_LINE, _BLOCK, _HASH = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"#[^\n]*"
_DOUBLE, _SINGLE, _BACK = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"`(?:\\.|[^`\\])*`"
_CHAR = r"'(?:\\[^\n']+|[^'\\\n])'"
_SCRIPT = re.compile("|".join((_LINE, _BLOCK, _DOUBLE, _SINGLE, _BACK)), re.DOTALL)
_MASKS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "tsx": _SCRIPT,
    "go": re.compile("|".join((_LINE, _BLOCK, _DOUBLE, _CHAR, r"`[^`]*`")), re.DOTALL),
    "rust": re.compile("|".join((_LINE, _BLOCK, r'r(#+)".*?"\1', _DOUBLE.replace(r"[^\"\\\n]", r'[^"\\]'), _CHAR)), re.DOTALL),
    "java": re.compile("|".join((_LINE, _BLOCK, r'"""(?:\\.|[^\\])*?"""', _DOUBLE, _CHAR)), re.DOTALL),
    "c": re.compile("|".join((_LINE, _BLOCK, _DOUBLE, _CHAR)), re.DOTALL),
    "cpp": re.compile("|".join((_LINE, _BLOCK, _DOUBLE, _CHAR)), re.DOTALL),
    "ruby": re.compile("|".join((r"^=begin.*?^=end[^\n]*", _HASH, _DOUBLE, _SINGLE)), re.DOTALL | re.MULTILINE),
    "elixir": re.compile("|".join((r'"""(?:\\.|[^\\])*?"""', _HASH, _DOUBLE, _SINGLE)), re.DOTALL),
    "hcl": re.compile("|".join((_LINE, _BLOCK, _HASH, _DOUBLE, r"<<-?(\w+)\n.*?^\s*\1$")), re.DOTALL | re.MULTILINE),
}
_COMMENT = ("//", "/*", "#", "=begin")


class Masked:
    """A text, its blanked copy, its comments and the pairs of its brackets."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.comments: list[tuple[int, int]] = []

        def blank(m: re.Match) -> str:
            if m[0].startswith(_COMMENT):
                self.comments.append(m.span())
            return _blank(m)

        self.code = _MASKS[language].sub(blank, text)
        self.close: dict[int, int] = {}
        self.open: dict[int, int] = {}
        waiting: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            if m[0] in "({[":
                waiting.append(m.start())
                continue
            want = {")": "(", "}": "{", "]": "["}[m[0]]
            while waiting and self.code[waiting[-1]] != want:
                waiting.pop()
            if waiting:
                self.close[waiting[-1]] = m.start()
                self.open[m.start()] = waiting.pop()
        self._heads = [a for a, _ in self.comments]

    def comment_in(self, body: int) -> str | None:
        """The first comment that stands in the bracketed body itself, not in brackets inside it."""
        end = self.close.get(body)
        if end is None:
            return None
        at = body + 1
        for a, b in self.comments[bisect.bisect_left(self._heads, body) :]:
            if a > end:
                return None
            while at < a:
                at = self.close.get(at, at) + 1 if self.code[at] in "({[" else at + 1
            if at == a:
                return comment(self.text[a:b])
            if at > a:
                continue
        return None

    def before(self, at: int) -> int:
        """The place of the last character of code before at, -1 if there is none."""
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return at

    def after(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at


def comment(raw: str) -> str:
    return raw.lstrip("/# ").strip()


# ---- Python


def _python(text: str) -> list[Symbol]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_indent(text)
    data = text.encode("utf-8", "surrogatepass")
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", data))]
    plain = text.isascii()

    def place(line: int, column: int) -> int:
        at = starts[line - 1] + column
        return at if plain else len(data[:at].decode("utf-8", "surrogatepass"))

    try:
        notes = [(t.start, t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, IndentationError, SyntaxError):
        notes = []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            s = Symbol("class" if isinstance(node, ast.ClassDef) else "function", node.name, place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset))
            said = [((x.lineno, x.col_offset), text[place(x.lineno, x.col_offset) : place(x.end_lineno, x.end_col_offset)].strip("\"' \n\t").strip()) for x in node.body if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)]
            held = [(x.lineno, x.end_lineno) for x in node.body if x.lineno != x.end_lineno]
            first = node.body[0]
            head = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
            said += [(at, comment(n)) for at, n in notes if node.lineno < at[0] <= node.end_lineno and at[0] >= min(head, node.lineno + 1) and not any(a <= at[0] <= b for a, b in held)]
            s.doc = min(said)[1] if said else None
            found.append(s)
    return found


_PY_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.MULTILINE)


def _python_by_indent(text: str) -> list[Symbol]:
    """Of a file that can't be parsed: a symbol ends before the first line that stands no further in."""
    found = []
    for m in _PY_HEAD.finditer(text):
        end = len(text)
        for line in re.finditer(r"^([ \t]*)\S[^\n]*", text[m.end() :], re.MULTILINE):
            if line.start() and len(line[1]) <= len(m[1]) and not line[0].lstrip().startswith((")", "#")):
                end = m.end() + line.start()
                break
        body = text[m.start() + len(m[1]) : end].rstrip()
        doc = re.search(r':\s*\n\s*[rbuRBU]?("""|\'\'\'|"|\')(.*?)\1', body, re.DOTALL)
        found.append(Symbol("class" if m[2] == "class" else "function", m[3], m.start() + len(m[1]), m.start() + len(m[1]) + len(body), doc[2].strip() if doc else None))
    return found


# ---- languages of braces


def _braced(m: Masked, at: int, stop: str = ";") -> int | None:
    """The first brace from at on that opens a body, before any of stop; brackets on the way are stepped over."""
    n = len(m.code)
    while at < n:
        c = m.code[at]
        if c == "{":
            return at
        if c in stop or c in ")]}":
            return None
        at = m.close.get(at, n) + 1 if c in "([" else at + 1
    return None


def _of_body(m: Masked, kind: str, name: str, start: int, body: int) -> Symbol | None:
    end = m.close.get(body)
    return Symbol(kind, name, start, end + 1, m.comment_in(body)) if end is not None else None


_NAME = r"[A-Za-z_$][\w$]*"
_NOT_METHODS = frozenset("if for while switch catch function with return await typeof new super constructor_ else do".split())
_JS_FUNCTION = re.compile(rf"(?<![\w$.])(?:async\s+)?function\b\s*(\*?)\s*({_NAME})?\s*(?=[<(])")
_JS_CLASS = re.compile(rf"(?<![\w$.])(abstract\s+)?class\s+({_NAME})")
_TS_INTERFACE = re.compile(rf"(?<![\w$.])interface\s+({_NAME})")
_JS_METHOD = re.compile(rf"(?<![\w$.#])((?:(?:public|private|protected|static|override|readonly|async|get|set)\s+(?=[\w$#*\[])|\*\s*)*)(#?{_NAME}|\[[^\]\n]*\])\s*(?:<[^<>(){{}}]*>)?\s*(?=\()")
_JS_DECLARED = re.compile(r"(?:^|[;{}\n]|\bexport|\bdefault|\*/)\s*$")


def _script(text: str, language: str) -> list[Symbol]:
    m = Masked(text, language)
    found: list[Symbol | None] = []
    for x in _JS_FUNCTION.finditer(m.code):
        declared = bool(x[2]) and bool(_JS_DECLARED.search(m.code[max(0, x.start() - 40) : x.start()]))
        if x[1] or (language == "tsx" and not declared):
            continue
        paren = m.code.find("(", x.end())
        if paren >= 0 and paren in m.close and (body := _braced(m, m.close[paren] + 1)) is not None:
            found.append(_of_body(m, "function", x[2] or ANONYMOUS, x.start(), body))
    for x in _JS_CLASS.finditer(m.code):
        last = m.code[m.before(x.start())] if m.before(x.start()) >= 0 else ""
        if not x[1] and last not in "=(,:?[&|" + "." * (not last) and (body := _braced(m, x.end())) is not None:
            found.append(_of_body(m, "class", x[2], x.start(), body))
    if language == "typescript":
        for x in _TS_INTERFACE.finditer(m.code):
            if (body := _braced(m, x.end())) is not None:
                found.append(_of_body(m, "interface", x[1], x.start(), body))
    for x in _JS_METHOD.finditer(m.code):
        last = m.before(x.start())
        if x[2] in _NOT_METHODS or x.end() not in m.close or (last >= 0 and m.code[last] not in "{};,)*/" and not m.code[last].isalnum()):
            continue
        if last >= 0 and re.search(r"(?:\b(?:function|new|return|await|typeof|case|else|of|in|extends)|function\s*\*|=>)$", m.code[max(0, last - 12) : last + 1]):
            continue
        body = _braced(m, m.close[x.end()] + 1, ";=,\n" if language == "javascript" else ";=,")
        if body is not None and re.fullmatch(r"\s*(?::[^;{}=]*)?", m.code[m.close[x.end()] + 1 : body]):
            found.append(_of_body(m, "method", x[2], x.start(), body))
    found += _arrows(m, language)
    return [s for s in found if s]


_ARROW_HEAD = re.compile(rf"(?:({_NAME})|\)\s*(?::[^=;{{}}()]*)?)\s*$")


def _arrows(m: Masked, language: str) -> list[Symbol]:
    found = []
    for x in re.finditer("=>", m.code):
        head = _ARROW_HEAD.search(m.code, max(0, x.start() - 300), x.start())
        if not head:
            continue
        if head[1]:
            start, name = head.start(1), head[1]
        else:
            start, name = m.open.get(head.start(), -1), ANONYMOUS
            if start < 0:
                continue
        before = m.before(start)
        if m.code[max(0, before - 4) : before + 1] == "async":
            start, before = before - 4, m.before(before - 4)
        if language != "javascript" and before >= 0 and m.code[before] in ":|&<" and not _in_literal(m, start):
            continue  # the type of a function
        at = m.after(x.end())
        if at < len(m.code) and m.code[at] == "{" and at in m.close:
            found.append(Symbol("function", name, start, m.close[at] + 1, m.comment_in(at)))
            continue
        end = at
        while end < len(m.code) and m.code[end] not in ",;)]}\n":
            end = m.close.get(end, end) + 1 if m.code[end] in "({[" else end + 1
        if end > at:
            found.append(Symbol("function", name, start, end))
    return found


def _in_literal(m: Masked, at: int) -> bool:
    """Whether the innermost bracket around at is the brace of an object."""
    around = max((o for o, c in m.close.items() if o < at <= c), default=None)
    if around is None or m.code[around] != "{":
        return False
    last = m.before(around)
    return last >= 0 and (m.code[last] in "=([,:?>" or m.code[max(0, last - 5) : last + 1] == "return")


_GO_FUNC = re.compile(r"^func\s*(\([^)\n]*\)\s*)?(\w+)\s*(?=[\[(])", re.MULTILINE)
_GO_TYPE = re.compile(r"^type\s+(?:(\w+)|(?=\())", re.MULTILINE)


def _go(text: str) -> list[Symbol]:
    m = Masked(text, "go")
    found: list[Symbol | None] = []
    for x in _GO_FUNC.finditer(m.code):
        body = _braced(m, x.end(), "\0")
        line = m.code.find("\n", m.close.get(x.end(), x.end()))
        if body is not None and (line < 0 or body < line):
            found.append(_of_body(m, "method" if x[1] else "function", x[2], x.start(), body))
    for x in _GO_TYPE.finditer(m.code):
        if x[1]:
            line = m.code.find("\n", x.end())
            line = len(m.code) if line < 0 else line
            brace = m.code.find("{", x.end(), line)
            end = m.close.get(brace, line - 1) + 1 if brace >= 0 else line
            found.append(Symbol("class", x[1], x.start(), end))
        elif (open_ := m.code.find("(", x.end() - 1)) in m.close:
            first = re.search(r"\w+", m.code[open_:])
            found.append(Symbol("class", first[0] if first else ANONYMOUS, x.start(), m.close[open_] + 1))
    return [s for s in found if s]


_RUST = re.compile(r"(?<![\w.])(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*(fn|struct|trait|impl)\b")


def _rust(text: str) -> list[Symbol]:
    m = Masked(text, "rust")
    found: list[Symbol | None] = []
    for x in _RUST.finditer(m.code):
        at = x.end()
        kind = {"fn": "function", "struct": "class", "trait": "interface", "impl": "class"}[x[1]]
        if x[1] == "impl":
            at = _past_angles(m.code, m.after(at))
        name = re.compile(r"\s*(?:&|dyn\s+|!)*\s*((?:\w+::)*)(\w+)").match(m.code, at)
        if not name or (x[1] == "impl" and m.before(x.start()) >= 0 and m.code[m.before(x.start())] in ":>(,&+"):
            continue  # impl in the place of a type
        body = _braced(m, name.end())
        if body is not None:
            found.append(_of_body(m, kind, name[2], x.start(), body))
        elif x[1] == "struct" and (end := m.code.find(";", name.end())) >= 0:
            found.append(Symbol(kind, name[2], x.start(), end + 1))
    return [s for s in found if s]


def _past_angles(code: str, at: int) -> int:
    if at < len(code) and code[at] == "<":
        depth = 0
        for k in range(at, len(code)):
            depth += (code[k] == "<") - (code[k] == ">" and code[k - 1] != "-")
            if not depth:
                return k + 1
    return at


_JAVA_TYPE = re.compile(r"((?:(?:public|private|protected|static|final|abstract|sealed|strictfp|non-sealed)\s+|@\w[\w.]*(?:\([^)]*\))?\s+)*)(?<![\w.@])(class|interface)\s+(\w+)")
_JAVA_METHOD = re.compile(r"((?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+|@\w[\w.]*(?:\([^)]*\))?\s+)*)(?:<[^<>(){}]*(?:<[^<>]*>[^<>(){}]*)*>\s*)?(?:([\w.]+(?:\s*<[^(){};=]*>)?(?:\s*\[\s*\])*)\s+)?(?<![\w.])(\w+)\s*(?=\()")
_JAVA_WORDS = frozenset("if for while switch catch return new throw else do try synchronized super this assert case".split())


def _java(text: str) -> list[Symbol]:
    m = Masked(text, "java")
    found: list[Symbol | None] = []
    bodies: dict[int, str] = {}
    for x in _JAVA_TYPE.finditer(m.code):
        if (body := _braced(m, x.end())) is not None:
            found.append(_of_body(m, x[2], x[3], x.start(), body))
            bodies[body] = x[3]
    for body, owner in bodies.items():
        at, end = body + 1, m.close.get(body, body)
        while at < end:  # the members of this body
            x = _JAVA_METHOD.search(m.code, at, end)
            inner = m.code.find("{", at, end)
            if inner >= 0 and (not x or inner < x.start()):
                at = m.close.get(inner, end) + 1
                continue
            if not x:
                break
            paren = x.end()
            if x[3] in _JAVA_WORDS or x[2] in _JAVA_WORDS or paren not in m.close:
                at = m.close.get(paren, paren) + 1
                continue
            tail = re.compile(r"\s*(?:\[\s*\])*\s*(?:throws\s+[\w.,\s<>]+?)?\s*(?:default\s+[^;]*)?([{;])").match(m.code, m.close[paren] + 1)
            last = m.before(x.start())
            if not tail or (last >= 0 and m.code[last] in "=.,(&|+"):
                at = m.close[paren] + 1
                continue
            if x[2] is None and x[3] != owner:
                at = m.close[paren] + 1
                continue
            kind = "method" if x[2] else "function"
            if tail[1] == "{":
                s = _of_body(m, kind, x[3], x.start(), tail.end() - 1)
                found.append(s)
                at = s.end if s else end
            else:
                if x[2]:
                    found.append(Symbol(kind, x[3], x.start(), tail.end()))
                at = tail.end()
    return [s for s in found if s]


_C_TYPE = re.compile(r"(?<![\w.])(struct|class)\s+(?:\w+\s*\([^)]*\)\s*)?([A-Za-z_]\w*)?")
_C_FUNCTION = re.compile(r"^[ \t]*((?!(?:else|return|typedef|case|new|delete|throw|goto|using|namespace|if|for|while|switch|do)\b)[A-Za-z_~][\w:<>,*&\s~]{0,400}?[\s*&]|)(~?[A-Za-z_]\w*(?:::~?\w+)*|operator[^\s(]+)\s*(?=\()", re.MULTILINE)
_C_WORDS = frozenset("if for while switch return sizeof catch do else case defined".split())


def _c(text: str, language: str) -> list[Symbol]:
    m = Masked(text, language)
    code = re.sub(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", _blank, m.code, flags=re.MULTILINE)
    found: list[Symbol | None] = []
    types: set[str] = set()
    for x in _C_TYPE.finditer(code):
        if x[1] == "class" and language == "c":
            continue
        body = _braced(m, x.end(), ";=),")
        if body is not None and re.fullmatch(r"\s*(?:final\s*)?(?::[^{};]*)?", code[x.end() : body]):
            found.append(_of_body(m, "class", x[2] or ANONYMOUS, x.start(), body))
            types.add(x[2] or "")
    for x in _C_FUNCTION.finditer(code):
        paren = x.end()
        name = x[2].rpartition("::")[2]
        if name in _C_WORDS or paren not in m.close or (not x[1].strip() and "::" not in x[2] and name.lstrip("~") not in types):
            continue
        tail = re.compile(r"\s*(?:const|noexcept|override|final|volatile|&|\s)*(?:->\s*[\w:<>*&\s]+)?(?::[^{};]*)?\s*\{").match(code, m.close[paren] + 1)
        if tail:
            label = re.match(r"\s*(?:(?:public|private|protected)\s*:\s*)*", x[0])  # an access label is no part of what follows
            found.append(_of_body(m, "function", x[2], x.start() + label.end(), tail.end() - 1))
    return [s for s in found if s]


# ---- languages of do and end

_RUBY_WORD = re.compile(r"(?<![\w.:@$?!])(class|module|def|if|unless|while|until|for|case|begin|do|end)\b(?![?!:=]|\s*=>)")


def _ruby(text: str) -> list[Symbol]:
    m = Masked(text, "ruby")
    found: list[Symbol] = []
    waiting: list[tuple[str, int, str | None]] = []
    loop = -1  # the end of the line of a while, until or for, whose do opens nothing more
    for x in _RUBY_WORD.finditer(m.code):
        word, line = x[1], m.code.rfind("\n", 0, x.start()) + 1
        first = not m.code[line : x.start()].strip()
        if word == "end":
            if waiting:
                kind, start, name = waiting.pop()
                if name is not None:
                    body = m.code.find("\n", start)
                    found.append(Symbol("method" if kind == "def" else "class", name, start, x.end(), _ruby_comment(m, body, x.start())))
        elif word in ("if", "unless", "while", "until"):
            if first or re.search(r"(?:[=(,]|\b(?:return|then|do|else))\s*$", m.code[line : x.start()]):
                waiting.append((word, x.start(), None))
                loop = _line_end(m.code, x.end()) if word in ("while", "until") else loop
        elif word == "do":
            if x.start() > loop:
                waiting.append((word, x.start(), None))
        elif word in ("class", "module"):
            name = re.compile(r"\s+((?:\w+::)*\w+)").match(m.code, x.end())
            if name:
                waiting.append((word, x.start(), name[1]))
            elif re.compile(r"\s*<<").match(m.code, x.end()):
                waiting.append((word, x.start(), None))
        elif word == "def":
            name = re.compile(r"\s+(?:[\w]+\.)?([\w]+[?!=]?|[-+*/<>=!~^%&|\[\]]+)").match(m.code, x.end())
            if not name:
                continue
            after = re.compile(r"\s*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[ \t]*=(?![=~>])").match(m.code, name.end())
            if after:  # a method of one expression
                found.append(Symbol("method", name[1], x.start(), _line_end(m.code, after.end())))
            else:
                waiting.append((word, x.start(), name[1]))
        else:
            waiting.append((word, x.start(), None))
            loop = _line_end(m.code, x.end()) if word == "for" else loop
    return found


def _line_end(code: str, at: int) -> int:
    end = code.find("\n", at)
    return len(code) if end < 0 else end


def _ruby_comment(m: Masked, start: int, end: int) -> str | None:
    """A comment that is the first thing in a body."""
    for a, b in m.comments:
        if start <= a < end and not m.code[start:a].strip():
            return comment(m.text[a:b])
    return None


# Elixir's words of definition and what they make.
ELIXIR = {"defmodule": "class", "defprotocol": "interface", "defimpl": "class", "def": "function", "defp": "function", "defmacro": "function", "defmacrop": "function", "defguard": "function", "defguardp": "function", "defdelegate": "function"}
_EX_WORD = re.compile(r"(?<![\w.:@&?!])(" + "|".join(sorted(ELIXIR, key=len, reverse=True)) + r"|quote|do|fn|end)\b(?![?!])(:?)")


def _elixir(text: str) -> list[Symbol]:
    m = Masked(text, "elixir")
    found: list[Symbol] = []
    waiting: list[list] = []  # word, start, name, whether inside a quote
    heads: list[list] = []  # definitions whose do hasn't come
    for x in _EX_WORD.finditer(m.code):
        word, short = x[1], x[2] == ":"
        quoted = any(w[0] == "quote" for w in waiting)
        while heads and x.start() > heads[-1][4]:
            heads.pop()
        if word in ELIXIR or word == "quote":
            if short or (word != "quote" and m.code[m.code.rfind("\n", 0, x.start()) + 1 : x.start()].strip()):
                continue
            name = re.compile(r"[ \t(]+([A-Za-z_][\w.]*[?!]?)").match(m.code, x.end())
            heads.append([word, x.start(), name[1] if name else ANONYMOUS, quoted, _head_end(m, x.end())])
            if word in ("defguard", "defguardp", "defdelegate") and not quoted:
                found.append(Symbol(ELIXIR[word], heads[-1][2], x.start(), heads.pop()[4]))
        elif word == "do" and short:
            if heads:
                w, start, name, inside, end = heads.pop()
                if w in ELIXIR and not inside:
                    found.append(Symbol(ELIXIR[w], name, start, _expression_end(m, x.end(), end)))
        elif word == "do":
            waiting.append(heads.pop()[:4] if heads else ["do", x.start(), None, quoted])
        elif word == "fn":
            waiting.append(["fn", x.start(), None, quoted])
        elif not short and waiting:
            w, start, name, inside = waiting.pop()
            if w in ELIXIR and not inside:
                found.append(Symbol(ELIXIR[w], name, start, x.end()))
    return found


def _head_end(m: Masked, at: int) -> int:
    """Where the call that begins before at ends: the end of its line, further on after a comma or inside brackets."""
    while True:
        end = at
        while end < len(m.code) and m.code[end] != "\n":
            end = m.close.get(end, end) + 1 if m.code[end] in "([{" else end + 1
        last = m.before(end)
        if end >= len(m.code) or last < 0 or not (m.code[last] in ",|=" or re.search(r"\b(?:when|and|or)$", m.code[max(0, last - 4) : last + 1])):
            if not re.compile(r"\s*(?:when\b|do:)").match(m.code, end):
                return end
        at = end + 1


def _expression_end(m: Masked, at: int, least: int) -> int:
    end = max(_head_end(m, at), least)
    return m.before(end) + 1


# Terraform's blocks and what they make.
HCL = {"resource": "class", "data": "class", "module": "class", "provider": "class", "variable": "function", "output": "function", "locals": "function"}
_HCL_BLOCK = re.compile(rf"^[ \t]*({'|'.join(HCL)})((?:[ \t]+\"[^\"\n]*\")*)[ \t]*\{{", re.MULTILINE)


def _hcl(text: str) -> list[Symbol]:
    m = Masked(text, "hcl")
    found = []
    for x in _HCL_BLOCK.finditer(text):
        body, start = x.end() - 1, x.start(1)
        if m.code[start] != text[start] or body not in m.close:
            continue  # in a comment or a string
        labels = re.findall(r'"([^"\n]*)"', x[2])
        name = ANONYMOUS if not labels else ".".join(labels) if x[1] in ("resource", "data") else labels[-1]
        found.append(Symbol(HCL[x[1]], name, start, m.close[body] + 1, m.comment_in(body)))
    return found


_FINDERS = {
    "python": _python,
    "javascript": lambda t: _script(t, "javascript"),
    "typescript": lambda t: _script(t, "typescript"),
    "tsx": lambda t: _script(t, "tsx"),
    "go": _go,
    "rust": _rust,
    "java": _java,
    "c": lambda t: _c(t, "c"),
    "cpp": lambda t: _c(t, "cpp"),
    "ruby": _ruby,
    "elixir": _elixir,
    "hcl": _hcl,
}
