"""What counts as a symbol and as an edge in each language; see extract.py for the rows."""

from __future__ import annotations

import ast
import keyword
import re
from dataclasses import dataclass

from .text import Source

CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "unsafe", "synchronized", "using", "lock", "foreach", "fixed", "sizeof", "function", "func", "fn", "new", "defer", "go", "select", "super", "this", "in", "of", "typeof", "await", "yield", "throw", "finally", "when", "where", "catch", "alignof", "decltype", "static_assert", "case", "not", "and", "or", "delete", "void", "import", "require_once", "async"}


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    container: str = ""  # the receiver, where the declaration names it
    holds: bool = False  # does it give its name to what it contains?


@dataclass
class Edge:
    kind: str  # import, call, extends, implements
    symbol: str
    at: int


def _block_end(src: Source, at: int) -> int | None:
    """End of the block that begins at the first brace from `at`, or None if a `;` or the end comes first."""
    m = re.compile(r"[{;]").search(src.code, at)
    return src.close[m.start()] + 1 if m and m[0] == "{" else None


def _statement_end(src: Source, at: int, newline: bool = True) -> int:
    """End of the statement at `at`: its `;` (not included), or the first line end outside brackets."""
    depth = 0
    for i in range(at, len(src.code)):
        c = src.code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            if depth == 0:
                return i
            depth -= 1
        elif depth == 0 and (c == ";" or newline and c == "\n"):
            return i
    return len(src.code)


# Go


def go_symbols(src: Source) -> list[Symbol]:
    out, code = [], src.code
    for m in re.finditer(r"^[ \t]*func[ \t]*(\()?", code, re.M):
        at, receiver = m.end(), ""
        if m[1]:
            at = src.balanced(m.end() - 1)
            receiver = code[m.end() : at - 1].split()[-1].lstrip("*") if code[m.end() : at - 1].split() else ""
        name = re.compile(r"\s*(\w+)\s*(\[[^\]]*\])?\s*\(").match(code, at)
        if not name:
            continue
        after = src.balanced(name.end() - 1)
        body = after
        while body < len(code) and code[body] not in "{;\n":
            if code[body] == "(":
                body = src.balanced(body)
                continue
            empty = re.compile(r"(interface|struct)\s*\{").match(code, body)
            body = src.close[empty.end() - 1] + 1 if empty else body + 1
        if body < len(code) and code[body] == "{":
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            out.append(Symbol(name[1], "method" if m[1] else "function", start, src.close[body] + 1, receiver))
    for m in re.finditer(r"^[ \t]*(type|const|var)\b[ \t]*(\()?", code, re.M):
        word, start = m[1], m.start() + len(m[0]) - len(m[0].lstrip())
        if m[2]:
            end = src.balanced(m.end() - 1)
            at = m.end()
            specs = []
            while at < end - 1:
                stop = min(_statement_end(src, at), end - 1)
                specs.append((at, stop))
                at = stop + 1
        else:
            end = _statement_end(src, m.end())
            specs = [(m.end(), end)]
        for a, z in specs:
            spec = code[a:z]
            if word == "type":
                t = re.match(r"\s*(\w+)(\[[^\]]*\])?\s+(struct|interface|func)\b|\s*(\w+)(\[[^\]]*\])?\s+(\w+)\s*$", spec)
                if t:
                    name, what = (t[1], t[3]) if t[3] else (t[4], "named")
                    if what != "named" or t[6] not in ("map", "chan"):
                        out.append(Symbol(name, "interface" if what == "interface" else "type", start, end))
                continue
            t = re.match(r"\s*(\w+(?:\s*,\s*\w+)*)\b([^=\n]*)(=)?", spec)
            if t and t[1] and (word == "var" or t[3]):
                out += [Symbol(n.strip(), "variable", start, end) for n in t[1].split(",") if n.strip() != ""]
    return out


def go_edges(src: Source) -> list[Edge]:
    out = []
    for m in re.finditer(r"^[ \t]*import\s*(\(.*?\)|[^\n]*)", src.text, re.M | re.S):
        out += [Edge("import", s[1], m.start() + s.start()) for s in re.finditer(r'"([^"\n]+)"', m[0])]
    return out + _plain_calls(src, r"(?<!\bfunc\s)(?<!\)\s)")


def _plain_calls(src: Source, before: str = "") -> list[Edge]:
    """Calls of a bare name."""
    found = re.finditer(rf"(?<![\w.$]){before}([A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]]*>)?\(", src.code)
    spans = [(m.end() - 1, src.close[m.end() - 1]) for m in re.finditer(r"\binterface\b[^{;()]*\{", src.code)]
    return [Edge("call", m[1], m.start(1)) for m in found if m[1] not in CONTROL and not any(a < m.start() < z for a, z in spans)]


def _headers(src: Source, symbols: list[Symbol]) -> list[tuple[int, int]]:
    """The headers of the functions: what looks like a call in them declares a name or initialises a member."""
    out = []
    for s in symbols:
        if s.kind in ("function", "method"):
            brace = src.code.find("{", s.start)
            out.append((s.start, brace if brace >= 0 else s.end))
    return out


def _member_levels(src: Source, symbols: list[Symbol]) -> list[tuple[int, int]]:
    """The stretches directly inside a type, outside the blocks of its members."""
    out = []
    for s in symbols:
        if s.kind in ("class", "interface", "type"):
            at = src.code.find("{", s.start) + 1
            while 0 < at < s.end:
                brace = src.code.find("{", at, s.end - 1)
                out.append((at, brace if brace >= 0 else s.end))
                at = src.close[brace] + 1 if brace >= 0 else s.end
    return out


# TypeScript and JavaScript

_ARROW = re.compile(r"(?:async\s+)?(?:<[^>]*>\s*)?(?:\w+|\()")
_METHOD_HEAD = re.compile(r"(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*\*?\s*(#?[\w$]+)\s*(?:<[^>]*>)?\s*\(")


def _is_arrow(src: Source, at: int) -> bool:
    m = _ARROW.match(src.code, at)
    if not m:
        return False
    after = src.balanced(m.end() - 1) if m[0].endswith("(") else m.end()
    rest = src.code[after : after + 400]
    return bool(re.match(r"\s*(:\s*[^=;{]*(\{[^}]*\})?[^=;{]*)?=>", rest))


def script_symbols(src: Source) -> list[Symbol]:
    out, code, typed = [], src.code, src.language != "javascript"
    for m in re.finditer(r"\b(?:async\s+)?function\s+([\w$]+)\s*(?:<[^>]*>)?\s*\(", code):
        after = src.balanced(m.end() - 1)
        head = re.compile(r"[^{;]*(\{[^{}]*\}[^{;]*)?(?=\{)").match(code, after) if re.match(r"\s*:\s*\{", code[after:]) else re.compile(r"[^{;]*(?=\{)").match(code, after)
        if head:
            out.append(Symbol(m[1], "function", m.start(), src.close[head.end()] + 1))
    for m in re.finditer(r"(\babstract\s+)?\bclass\s+([A-Za-z_$][\w$]*)[^{;()]*(?:\([^)]*\)[^{;]*)?(?=\{)", code):
        if m[1] and typed:
            continue
        end = src.close[m.end()] + 1
        out.append(Symbol(m[2], "class", m.start(), end, holds=True))
        at = m.end() + 1
        while at < end - 1:  # the members at the first level of the class
            skip = re.compile(r"[\s;]*(?:@[\w.]+(?:\([^)]*\))?\s*)*").match(code, at)
            at = skip.end()
            head = _METHOD_HEAD.match(code, at)
            if head and head[1] not in CONTROL and at < end - 1:
                after = src.balanced(head.end() - 1)
                body = re.compile(r"\s*(?::[^;{}]*(?:\{[^{}]*\}[^;{}]*)?)?(\{)").match(code, after)
                if body and body.end() <= end:
                    close = src.close[body.end() - 1] + 1
                    out.append(Symbol(head[1], "method", at, close))
                    at = close
                    continue
            at = max(_statement_end(src, at) + 1, at + 1)
    for m in re.finditer(r"(\bexport\s+)?\b((?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=(?!=)\s*)", code):
        end = _statement_end(src, m.end(2), newline=False)
        line_end = _statement_end(src, m.end(2))
        end = min(end, line_end) if code[line_end : line_end + 1] == "\n" and not re.match(r"\s*[.?:+\-*/&|=]", code[line_end + 1 : line_end + 80]) else end
        end += code[end : end + 1] == ";"
        if m[1]:
            out.append(Symbol(m[3], "variable", m.start(2), end))
        elif _is_arrow(src, m.end(2)):
            out.append(Symbol(m[3], "function", m.start(2), end))
    if typed:
        for m in re.finditer(r"\binterface\s+([A-Za-z_$][\w$]*)[^{;]*(?=\{)", code):
            out.append(Symbol(m[1], "interface", m.start(), src.close[m.end()] + 1))
        for m in re.finditer(r"(?<![\w.])type\s+([A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*=(?!=)", code):
            end = _statement_end(src, m.end(), newline=False)
            out.append(Symbol(m[1], "type", m.start(), end + (code[end : end + 1] == ";")))
    return out


def script_edges(src: Source) -> list[Edge]:
    out = [Edge("import", m[2], m.start()) for m in re.finditer(r"\bimport\s+(?:[\w*{}\s,$]+\s+from\s+)?(['\"])([^'\"\n]+)\1", src.text) if src.code[m.start()] == "i"]
    if src.language == "javascript":
        out += [Edge("import", m[2], m.start()) for m in re.finditer(r"\brequire\s*\(\s*(['\"])([^'\"\n]+)\1", src.text) if src.code[m.start()] == "r"]
    declared = r"(?<!\bfunction\s)(?<!\bfunction\*\s)"
    heads = {s.start for s in script_symbols(src) if s.kind == "method"}
    out += [e for e in _plain_calls(src, declared) if not any(h <= e.at <= h + 40 and src.code[h : e.at].strip() in ("", "async", "private", "public", "static", "protected", "private async", "public async") for h in heads)]
    for m in re.finditer(r"\bclass\s+[\w$]+\s*(?:<[^>{]*>)?\s*(?:extends\s+([\w$]+))?[^{]*?(?:\bimplements\s+([^{]+))?\{", src.code):
        if m[1]:
            out.append(Edge("extends", m[1], m.start()))
        for name in (m[2] or "").split(","):
            if re.fullmatch(r"\s*[\w$]+\s*", name):
                out.append(Edge("implements", name.strip(), m.start()))
    return out


# Rust


def rust_symbols(src: Source) -> list[Symbol]:
    out, code = [], src.code
    for m in re.finditer(r"\bfn\s+(\w+)", code):
        end = _block_end(src, m.end())
        if end:
            out.append(Symbol(m[1], "function", _line_head(src, m.start()), end))
    for m in re.finditer(r"\b(struct|enum|trait|union)\s+(\w+)", code):
        end = _block_end(src, m.end())
        if end is None and m[1] == "struct":
            end = _statement_end(src, m.end(), newline=False) + 1
        if end and m[1] != "union":
            out.append(Symbol(m[2], "interface" if m[1] == "trait" else "type", _line_head(src, m.start()), end))
    for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b\s*(<[^{]*?>)?\s*([^{;]*?)(?=\{)", code, re.M):
        target = re.sub(r"\bwhere\b.*", "", m[2].split(" for ")[-1], flags=re.S).strip()
        if target:
            kind = "class" if re.fullmatch(r"\w+", target) else ""
            out.append(Symbol(target, kind, m.start() + len(m[0]) - len(m[0].lstrip()), src.close[m.end()] + 1, holds=True))
    for m in re.finditer(r"\b(?:(type)\s+(\w+)\s*(?:<[^=]*>)?\s*=|(?:const|static)\s+(?:mut\s+)?(\w+)\s*:[^=;]*=)", code):
        end = _statement_end(src, m.end(), newline=False) + 1
        out.append(Symbol(m[2] or m[3], "type" if m[1] else "variable", _line_head(src, m.start()), end))
    return out


def _line_head(src: Source, at: int) -> int:
    """The first character of the line of `at` if only modifiers stand before it, else `at`."""
    start = src.line_starts[src.line(at) - 1]
    lead = src.code[start:at]
    return start + len(lead) - len(lead.lstrip()) if re.fullmatch(r'[\w\s()":,]*', lead) else at


def rust_edges(src: Source) -> list[Edge]:
    out = [Edge("import", re.sub(r"\s+", " ", m[1]).strip(), m.start()) for m in re.finditer(r"\buse\s+([^;]+);", src.code)]
    calls = re.finditer(r"(?<![\w:])((?:\w+::)*\w+)\s*(?:::<[^>]*>)?\(", src.code)
    return out + [Edge("call", m[1], m.start()) for m in calls if m[1] not in CONTROL and not re.search(r"\bfn\s+$", src.code[max(0, m.start() - 8) : m.start()])]


# Java, C#, C and C++: by the header of each block


def _called(header: str) -> re.Match | None:
    """The name and parameter list at the end of a function's header."""
    return re.search(r"([~\w]+(?:\s*::\s*~?\w+)*)\s*(?:<[^()]*>)?\s*\((?:[^()]|\([^()]*\))*\)\s*(?:(?:throws\s+[\w.,\s<>]+|const|noexcept|override|final|volatile|&&?|->\s*[\w:<>&*\s]+|where\s+[\w\s:,<>()]+|:\s*.+)\s*)*$", header, re.S)


def _function_name(header: str) -> str | None:
    m = _called(header)
    if not m or m[1].split("::")[-1].strip() in CONTROL:
        return None
    lead = header[: m.start()]
    if "=" in re.sub(r"[=!<>]=|operator\s*\S*|<[^<>]*>", "", re.sub(r"\([^()]*\)", "", lead)) or re.search(r"\b(new|return|else|throw|case)\b|[.]\s*$", lead):
        return None
    return re.sub(r"\s", "", m[1])


def java_symbols(src: Source) -> list[Symbol]:
    out = []
    for start, header, _, end in src.blocks():
        m = re.search(r"\b(class|interface|enum)\s+(\w+)", header)
        if m and not re.search(r"[=(]\s*new\b|\breturn\b", header[: m.start()]):
            kind = {"class": "class", "interface": "interface", "enum": "type"}[m[1]]
            out.append(Symbol(m[2], kind, start, end, holds=kind == "class"))
        elif (name := _function_name(header)) and (re.match(r"(@\w|public|private|protected|static|final|abstract|synchronized|native|default|<|\w[\w<>\[\].,?\s]*\s+\w+\s*\()", header) or re.match(rf"{re.escape(name)}\s*\(", header)):
            out.append(Symbol(name, "method", start, end))
    return out + _fields(src, out, need_value=True)


def csharp_symbols(src: Source) -> list[Symbol]:
    out = []
    for start, header, brace, end in src.blocks():
        m = re.search(r"\b(class|interface|struct|enum)\s+(\w+)", header)
        if m and "(" not in header[: m.start()]:
            kind = {"class": "class", "interface": "interface"}.get(m[1], "type")
            out.append(Symbol(m[2], kind, start, end, holds=kind == "class"))
        elif name := _function_name(header):
            if re.match(r"(\[|public|private|protected|internal|static|async|override|virtual|sealed|unsafe|partial|\w[\w<>\[\].,?\s]*\s+\w+)", header):
                out.append(Symbol(name, "method", start, end))
        elif (p := re.search(r"[\w<>\[\]?.,]+\s+(\w+)$", header)) and re.match(r"\s*(\w+\s+)*(get|set|init)\b", src.code[brace + 1 : end]) and "namespace" not in header:
            out.append(Symbol(p[1], "variable", start, end))
    return out + _fields(src, out, need_value=False)


def _fields(src: Source, found: list[Symbol], need_value: bool) -> list[Symbol]:
    """Fields: statements at the first level of a class."""
    out = []
    for holder in (s for s in found if s.kind == "class"):
        at = src.code.find("{", holder.start) + 1
        while 0 < at < holder.end - 1:
            lead = re.compile(r"\s*").match(src.code, at).end()
            stop = re.compile(r"[;{}]").search(src.code, lead)
            if not stop or stop.start() >= holder.end - 1:
                break
            statement = src.code[lead : stop.start()]
            if stop[0] == "{":
                at = src.close[stop.start()] + 1
                if "=" in statement and re.search(r"=\s*(new\b[^;]*)?$", statement):  # an initialiser in braces
                    stop_at = src.code.find(";", at)
                    m = re.match(r"(?:(?:@\w+(?:\([^)]*\))?|\[[^\]]*\])\s*)*[\w<>\[\].,?\s]+?\s(\w+)\s*=", statement)
                    if m and 0 < stop_at < holder.end:
                        out.append(Symbol(m[1], "variable", lead, stop_at + 1))
                        at = stop_at + 1
                continue
            m = re.match(r"(?:(?:@\w+(?:\([^)]*\))?|\[[^\]]*\])\s*)*[\w<>\[\].,?\s]+?\s(\w+)\s*(=|$|,)", statement)
            if m and (m[2] == "=" or not need_value) and not re.match(r"(return|package|import|using|throw)\b", statement):
                out.append(Symbol(m[1], "variable", lead, stop.start() + 1))
            at = stop.end()
    return out


def c_symbols(src: Source) -> list[Symbol]:
    out, cpp = [], src.language == "cpp"
    for start, header, _, end in src.blocks():
        bare = re.sub(r"^template\s*<[^{;]*?>\s*(?=\w)", "", header)
        m = re.search(r"\b(class|struct|enum(?:\s+class)?|union)\s+(?:\[\[[^\]]*\]\]\s*)?(\w+)\s*(?:final\s*)?(?::[^:].*)?$", bare, re.S)
        if m and "(" not in bare[: m.start()]:
            if m[1] == "union" or m[1] == "class" and not cpp:
                continue
            out.append(Symbol(m[2], "class" if m[1] == "class" else "type", start, end, holds=cpp and not m[1].startswith("enum")))
        elif name := _function_name(bare):
            parts = name.split("::")
            if len(parts) > 1 and not cpp or re.match(r"(namespace|extern)\b", bare):
                continue
            if len(bare) > len(name) and re.match(r"[\w~]", bare):
                out.append(Symbol(parts[-1], "method" if len(parts) > 1 else "function", start, end))
    if not cpp:
        for m in re.finditer(r"\btypedef\b", src.code):
            end = _statement_end(src, m.end(), newline=False)
            name = re.search(r"(\w+)\s*$", src.code[m.end() : end])
            if name:
                out.append(Symbol(name[1], "type", m.start(), end + 1))
    else:
        for m in re.finditer(r"\busing\s+(\w+)\s*=", src.code):
            out.append(Symbol(m[1], "type", m.start(), _statement_end(src, m.end(), newline=False) + 1))
    return out


def c_edges(src: Source) -> list[Edge]:
    out = [Edge("import", m[1].strip('"'), m.start()) for m in re.finditer(r'^[ \t]*#\s*include\s*(<[^>\n]+>|"[^"\n]+")', src.text, re.M)]
    if src.language == "cpp":
        out += [Edge("import", m[1].strip(), m.start()) for m in re.finditer(r"\busing\s+(?!namespace\b|\w+\s*=)([\w:]+)\s*;", src.code)]
        for m in re.finditer(r"\bclass\s+\w+\s*(?:final\s*)?:([^:{;][^{;]*)\{", src.code):
            out += [Edge("extends", b.split()[-1], m.start()) for b in m[1].split(",") if b.split() and re.fullmatch(r"\w+", b.split()[-1])]
    heads = _headers(src, c_symbols(src))
    for m in re.finditer(r"(?<![\w:])((?:\w+::)*\w+)\s*\(", src.code):
        if m[1] not in CONTROL and not m[1].isdigit() and not any(a <= m.start() < z for a, z in heads):
            out.append(Edge("call", m[1], m.start()))
    return out


def _object_edges(src: Source, symbols: list[Symbol]) -> list[Edge]:
    """Calls of Java and C#: the name of every invocation, and the type of every `new`."""
    heads, levels = _headers(src, symbols), _member_levels(src, symbols)
    out = []
    for m in re.finditer(r"(\bnew\s+)?\b(\w+)\s*(?:<[\w\s,.?\[\]]*>)?\s*\(", src.code):
        if m[2] in CONTROL or m[2].isdigit() or src.code[max(0, m.start() - 1)] == "@" or any(a <= m.start() < z for a, z in heads):
            continue
        declares = any(a <= m.start() < z and "=" not in re.split(r"[;{}]", src.code[a : m.start()])[-1] for a, z in levels)
        if not declares:
            out.append(Edge("call", m[2], m.start(2)))
    return out


def java_edges(src: Source) -> list[Edge]:
    out = [Edge("import", m[1], m.start()) for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+)", src.code, re.M)]
    out += _object_edges(src, java_symbols(src))
    for m in re.finditer(r"\bclass\s+\w+\s*(?:<[^{]*?>)?\s*(?:extends\s+(\w+)(?:<[^{]*?>)?)?\s*(?:implements\s+([^{]+))?\{", src.code):
        if m[1]:
            out.append(Edge("extends", m[1], m.start()))
        out += [Edge("implements", n.strip(), m.start()) for n in (m[2] or "").split(",") if re.fullmatch(r"\s*\w+\s*", n)]
    return out


def csharp_edges(src: Source) -> list[Edge]:
    out = [Edge("import", m[1], m.start()) for m in re.finditer(r"^[ \t]*using\s+([\w.]+)\s*;", src.code, re.M)]
    out += _object_edges(src, csharp_symbols(src))
    for m in re.finditer(r"\bclass\s+\w+\s*(?:<[^{]*?>)?\s*:([^{]+)\{", src.code):
        for n in m[1].split(","):
            if re.fullmatch(r"\s*\w+\s*", n):  # the syntax does not tell a base class from an interface: both
                out += [Edge("extends", n.strip(), m.start()), Edge("implements", n.strip(), m.start())]
    return out


# Python


def python_tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_symbols(text: str, tree: ast.Module) -> list[tuple[str, str, str, int, int, str]]:
    """(name, kind, parent class, first line, last line, code)."""
    lines, out = text.splitlines(keepends=True), []

    def code(node: ast.AST) -> str:
        part = lines[node.lineno - 1 : node.end_lineno]
        head = part[0].encode()[node.col_offset :].decode(errors="replace")
        if node.lineno == node.end_lineno:
            return part[0].encode()[node.col_offset : node.end_col_offset].decode(errors="replace")
        return head + "".join(part[1:-1]) + part[-1].encode()[: node.end_col_offset].decode(errors="replace")

    def visit(node: ast.AST, parent: str, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((child.name, "method" if parent else "function", parent, child.lineno, child.end_lineno, code(child)))
                visit(child, parent, False)
            elif isinstance(child, ast.ClassDef):
                out.append((child.name, "class", parent, child.lineno, child.end_lineno, code(child)))
                visit(child, child.name, False)
            else:
                if top and isinstance(child, (ast.Assign, ast.AnnAssign)) and child.value is not None:
                    target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                    if isinstance(target, ast.Name):
                        out.append((target.id, "variable", "", child.lineno, child.end_lineno, code(child)))
                visit(child, parent, False)

    visit(tree, "", True)
    return out


def python_edges(tree: ast.Module) -> list[tuple[str, str, int]]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            out.append(("import", node.module, node.lineno))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            out.append(("call", node.func.id, node.lineno))
    return out


_PY_BLANK = re.compile(r"""#[^\n]*|(\"{3}|'{3}).*?(?:\1|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S)
_PY_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)


def _python_code(text: str) -> str:
    """The text with comments and strings blanked."""
    return _PY_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def broken_python_symbols(text: str) -> list[tuple[str, str, str, int, int, str]]:
    """python_symbols() of a text that does not parse: a header's block ends before the next line indented no deeper."""
    code, lines, out = _python_code(text), text.splitlines(keepends=True), []
    indent = [len(x) - len(x.lstrip(" \t")) if x.strip() else None for x in code.splitlines()]
    open_blocks: list[tuple[int, int, str, str]] = []  # last line, indent, kind, name
    for m in _PY_HEAD.finditer(code):
        first, depth = code.count("\n", 0, m.start()), len(m[1])
        after = next((i for i in range(first + 1, len(indent)) if indent[i] is not None and indent[i] <= depth), len(indent))
        last = max((i for i in range(first, after) if indent[i] is not None), default=first)
        open_blocks = [b for b in open_blocks if b[0] >= first and b[1] < depth]
        parent = next((b[3] for b in reversed(open_blocks) if b[2] == "class"), "")
        kind = "class" if m[2] == "class" else "method" if parent else "function"
        out.append((m[3], kind, parent, first + 1, last + 1, "".join(lines[first : last + 1])[depth:].rstrip("\n")))
        open_blocks.append((last, depth, m[2], m[3]))
    for m in re.finditer(r"^(\w+)[ \t]*(?::[^=\n]+)?=(?!=)", code, re.M):
        line = code.count("\n", 0, m.start())
        out.append((m[1], "variable", "", line + 1, line + 1, lines[line].rstrip("\n")))
    return out


def broken_python_edges(text: str) -> list[tuple[str, str, int]]:
    """python_edges() of a text that does not parse."""
    code, out = _python_code(text), []
    for m in re.finditer(r"^[ \t]*import[ \t]+([\w., \t]+)", code, re.M):
        out += [("import", n.split()[0], code.count("\n", 0, m.start()) + 1) for n in m[1].split(",") if n.strip()]
    out += [("import", m[1], code.count("\n", 0, m.start()) + 1) for m in re.finditer(r"^[ \t]*from[ \t]+(\w[\w.]*)[ \t]+import\b", code, re.M)]
    calls = re.finditer(r"(?<![\w.])([A-Za-z_]\w*)[ \t]*\(", code)
    heads = {m.end() for m in _PY_HEAD.finditer(code)}
    return out + [("call", m[1], code.count("\n", 0, m.start()) + 1) for m in calls if not keyword.iskeyword(m[1]) and m.end(1) not in heads]


SYMBOLS = {"go": go_symbols, "typescript": script_symbols, "tsx": script_symbols, "javascript": script_symbols, "rust": rust_symbols, "java": java_symbols, "c": c_symbols, "cpp": c_symbols, "csharp": csharp_symbols}
EDGES = {"go": go_edges, "typescript": script_edges, "tsx": script_edges, "javascript": script_edges, "rust": rust_edges, "java": java_edges, "c": c_edges, "cpp": c_edges, "csharp": csharp_edges}
