"""Structure of source files: symbols, syntax facts and chunks.

Python is read by the standard library's parser, so ranges are exact; the other languages by a scanner that blanks out
strings and comments, matches brackets and recognises declarations, clauses and calls. `extract` is a plain function of
one file; `extract_files` maps it over the rows of a scan.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions.identity import stable_id

CLASS_KINDS = {"class", "interface", "mixin", "extension", "enum"}
MAX_CLASS_BYTES = 20_000
#: How configuration keys are read, by language.
_KEY = r"['\"](?P<key>[A-Za-z_][A-Za-z0-9_.:-]{0,127})['\"]"
CONFIGURATION = {
    "python": [r"(?:\bos\.)?getenv\(\s*" + _KEY, r"\bos\.environ(?:\.get\(\s*|\[\s*)" + _KEY, r"\b(?:config|settings)\.get\(\s*" + _KEY],
    "javascript": [r"\bprocess\.env\.(?P<key>[A-Za-z_][A-Za-z0-9_]{0,127})\b", r"\bprocess\.env\[\s*" + _KEY + r"\s*\]", r"\b(?:config|settings|Deno\.env)\.get\(\s*" + _KEY],
    "dart": [r"\b(?:String|bool|int)\.fromEnvironment\(\s*" + _KEY],
}
CONFIGURATION["typescript"] = CONFIGURATION["tsx"] = CONFIGURATION["javascript"]


def looks_like_route(text: str) -> bool:
    t = text.lower().strip()
    return bool(re.search(r"\.(get|post|put|patch|delete|route)", t) or re.match(r"@*(get|post|put|patch|delete|route)\(", t))


class _File:
    """Collects what is found in one file; ranges are byte offsets."""

    def __init__(self, path: str, language: str, source: bytes):
        self.path, self.language, self.source = path, language, source
        self.lines = [0] + [m.end() for m in re.finditer(b"\n", source)]
        self.symbols: list[dict] = []
        self.facts: list[dict] = []
        self.turns: dict[str, int] = {}
        self.errors = 0
        self.keys = [re.compile(p.encode()) for p in CONFIGURATION.get(language, ())]

    def text(self, a: int, b: int) -> str:
        return self.source[a:b].decode("utf-8", "replace")

    def span(self, a: int, b: int) -> dict:
        i, j = bisect.bisect_right(self.lines, a) - 1, bisect.bisect_right(self.lines, b) - 1
        return {"start_byte": a, "end_byte": b, "start_line": i + 1, "end_line": j + 1, "start_column": a - self.lines[i], "end_column": b - self.lines[j]}

    def symbol(self, kind: str, name: str, a: int, b: int, body: int | None, parent: dict | None, parameters: list[str] = (), returns: str | None = None, doc: str | None = None, metadata: dict | None = None) -> dict:
        qualified = f"{parent['qualified_name']}.{name}" if parent else name
        signature = " ".join(self.text(a, body if body is not None else b).split())
        base = stable_id("symbol", self.path, self.language, kind, qualified, signature)
        turn = self.turns.get(base, 0)
        self.turns[base] = turn + 1
        more = dict(metadata or {})
        if name.startswith("test") or name.endswith(("Test", "Tests")):
            more["is_test"] = "true"
            kind = "test"
        own = {"id": base if not turn else stable_id(base, turn), "kind": kind, "name": name, "qualified_name": qualified, "signature": signature, "parameters": list(parameters), "return_type": returns, "docstring": doc, "metadata": more}
        self.symbols.append(own | self.span(a, b))
        return self.symbols[-1]

    def fact(self, kind: str, target: str, a: int, b: int, parent: dict | None, metadata: dict | None = None) -> None:
        target = target.strip()
        owner = parent["id"] if parent else None
        self.facts.append({"id": stable_id("fact", self.path, kind, owner or "", target, a), "kind": kind, "target_text": target, "source_symbol_id": owner, "metadata": dict(metadata or {})} | self.span(a, b))

    def is_configuration(self, a: int, b: int) -> bool:
        return any(p.search(self.source[a:b]) for p in self.keys)

    def receiver(self, target: str, scope: str | None) -> dict:
        """The type of a call's receiver if the enclosing function declares or constructs exactly one."""
        names = re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", target)
        if scope is None or len(names) < 2 or names[-2] in ("self", "this", "super"):
            return {}
        q = re.escape(names[-2])
        types = re.findall(rf"\b{q}\s*:\s*([A-Za-z_$][A-Za-z0-9_$.]*)", scope)
        types += re.findall(rf"\b{q}\s*(?::[^=\n]+)?=\s*(?:new\s+)?([A-Z][A-Za-z0-9_$.]*)\s*\(", scope)
        leaves = {t.rstrip(".").split(".")[-1] for t in types}
        return {"receiver_type": leaves.pop()} if len(leaves) == 1 else {}

    def finish(self) -> dict:
        seen = set()
        for pattern in self.keys:
            for m in pattern.finditer(self.source):
                key = m["key"].decode()
                if (m.start(), m.end(), key) in seen:
                    continue
                seen.add((m.start(), m.end(), key))
                around = [s for s in self.symbols if s["start_byte"] <= m.start() and s["end_byte"] >= m.end()]
                owner = min(around, key=lambda s: (s["end_byte"] - s["start_byte"], s["id"]), default=None)
                self.fact("configuration", key, m.start(), m.end(), owner, {"configuration_key": "true"})
        self.symbols.sort(key=lambda s: (s["start_byte"], s["id"]))
        self.facts.sort(key=lambda f: (f["start_byte"], f["id"]))
        return {"symbols": self.symbols, "facts": self.facts, "chunks": self.chunks(), "error_count": self.errors}

    def chunks(self) -> list[dict]:
        out, seen = [], set()
        kinds = {"function": "function", "method": "method", "constructor": "method", "test": "test"}
        for s in self.symbols:
            kind = kinds.get(s["kind"]) or ("class" if s["kind"] in CLASS_KINDS and s["end_byte"] - s["start_byte"] <= MAX_CLASS_BYTES else None)
            if kind is None:
                continue
            text = self.text(s["start_byte"], s["end_byte"])
            digest = hashlib.sha256(text.encode()).hexdigest()
            if digest not in seen:
                seen.add(digest)
                own = {k: s[k] for k in ("start_byte", "end_byte", "start_line", "end_line", "start_column", "end_column")}
                out.append({"id": stable_id("chunk", self.path, s["id"], digest), "kind": kind, "content_hash": digest, "source_text": text, "symbol_id": s["id"], "metadata": {}} | own)
        top = [f"{s['kind']} {s['qualified_name']}: {s['signature']}" for s in self.symbols if "." not in s["qualified_name"]]
        if top:
            text = "\n".join(top)
            digest = hashlib.sha256(text.encode()).hexdigest()
            whole = {"start_byte": 0, "end_byte": len(self.source), "start_line": 1, "end_line": len(self.lines), "start_column": 0, "end_column": 0}
            out.append({"id": stable_id("module-summary", self.path, digest), "kind": "module_summary", "content_hash": digest, "source_text": text, "symbol_id": None, "metadata": {"generated": "true"}} | whole)
        return out


# --- Python ---------------------------------------------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self, file: _File):
        self.f = file
        self.parent: dict | None = None
        self.scope: str | None = None

    def at(self, node: ast.AST) -> tuple[int, int]:
        return self.f.lines[node.lineno - 1] + node.col_offset, self.f.lines[node.end_lineno - 1] + node.end_col_offset

    def inside(self, parent: dict | None, nodes: list[ast.AST], scope: str | None = None) -> None:
        before = self.parent, self.scope
        self.parent, self.scope = parent or self.parent, scope if scope is not None else self.scope
        for n in nodes:
            self.visit(n)
        self.parent, self.scope = before

    def body_at(self, node: ast.AST) -> int:
        first = node.body[0]
        a, _ = self.at(first)
        if getattr(first, "decorator_list", None):
            a = self.f.source.rfind(b"@", 0, self.at(first.decorator_list[0])[0])
        return a

    def decorators(self, node: ast.AST) -> tuple[bool, list[str]]:
        texts = []
        for d in node.decorator_list:
            a, b = self.at(d)
            a = self.f.source.rfind(b"@", 0, a)
            text = self.f.text(a, b)
            texts.append(text)
            self.f.fact("route" if looks_like_route(text) else "decorator", text, a, b, self.parent)
            self.visit(d)
        return any(map(looks_like_route, texts)), texts

    def documentation(self, node: ast.AST) -> str | None:
        first = node.body[0]
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            return self.f.text(*self.at(first.value)).strip("\"'")
        return None

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        route, _ = self.decorators(node)
        a, b = self.at(node)
        own = self.f.symbol("class", node.name, a, b, self.body_at(node), self.parent, doc=self.documentation(node), metadata={"is_route": "true"} if route else None)
        if node.bases or node.keywords:
            i = self.f.source.index(b"(", a)
            last = max(self.at(x)[1] for x in [*node.bases, *[k.value for k in node.keywords]])
            j = self.f.source.index(b")", last) + 1
            self.f.fact("inherits", self.f.text(i, j), i, j, own)
        self.inside(own, [*node.bases, *node.keywords, *node.body])

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        route, _ = self.decorators(node)
        a, b = self.at(node)
        args = node.args
        plain = [*args.posonlyargs, *args.args]
        missing = len(plain) - len(args.defaults)
        given = {id(x): d for x, d in zip(plain[missing:], args.defaults)} | {id(x): d for x, d in zip(args.kwonlyargs, args.kw_defaults) if d}
        listed = []
        for x in sorted([*plain, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))], key=lambda x: self.at(x)):
            i, j = self.at(x)
            star = "**" if x is args.kwarg else "*" if x is args.vararg else ""
            listed.append(star + self.f.text(i, self.at(given[id(x)])[1] if id(x) in given else j))
        in_class = self.parent is not None and self.parent["kind"] in CLASS_KINDS
        returns = self.f.text(*self.at(node.returns)) if node.returns else None
        own = self.f.symbol("method" if in_class else "function", node.name, a, b, self.body_at(node), self.parent, listed, returns, self.documentation(node), {"is_route": "true"} if route else None)
        if route:
            for x in plain:
                if x.annotation and id(x) not in given:
                    self.f.fact("schema", self.f.text(*self.at(x.annotation)), *self.at(x), own)
        self.inside(own, [args, *([node.returns] if node.returns else []), *node.body], self.f.text(a, b))

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self.inside(None, [node.args, node.body], self.f.text(*self.at(node)))

    def _assigned(self, node: ast.AST, target: ast.AST, rest: list[ast.AST]) -> None:
        if isinstance(target, ast.Name) and target.id.isupper():
            own = self.f.symbol("constant", target.id, *self.at(node), None, self.parent)
            self.inside(own, rest)
        else:
            self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assigned(node, node.targets[0], [*node.targets[1:], node.value])

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned(node, node.target, [node.annotation, *([node.value] if node.value else [])])

    def _import(self, node: ast.AST) -> None:
        a, b = self.at(node)
        self.f.fact("import", self.f.text(a, b), a, b, self.parent)

    visit_Import = visit_ImportFrom = _import

    def visit_Call(self, node: ast.Call) -> None:
        a, b = self.at(node)
        if not self.f.is_configuration(a, b):
            target = self.f.text(*self.at(node.func))
            self.f.fact("call", target, a, b, self.parent, self.f.receiver(target, self.scope))
        self.generic_visit(node)


# --- languages with braces ------------------------------------------------------------------------------------------

_LEX = re.compile(rb"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_ID = rb"[A-Za-z_$][A-Za-z0-9_$]*"
_KEYWORDS = {b"if", b"for", b"while", b"switch", b"catch", b"return", b"function", b"super", b"await", b"new", b"typeof", b"func", b"go", b"defer", b"else", b"do", b"in", b"of", b"assert", b"rethrow", b"range", b"select", b"case", b"with", b"import", b"export", b"throw", b"yield", b"void", b"delete", b"interface", b"struct", b"map", b"chan"}


class _Braces:
    """Declarations of JavaScript, TypeScript, Dart and Go by patterns over source without strings and comments."""

    def __init__(self, file: _File):
        self.f, self.lang = file, file.language
        blank = bytearray(file.source)
        for m in _LEX.finditer(file.source):
            keep = m.group()[:1] in b"\"'`"
            inner = slice(m.start() + keep, m.end() - keep)
            blank[inner] = re.sub(rb"[^\n]", b" ", bytes(blank[inner]))
        self.s = bytes(blank)
        self.pairs: dict[int, int] = {}
        stack: list[tuple[int, int]] = []
        closing = {ord(")"): ord("("), ord("]"): ord("["), ord("}"): ord("{")}
        for i, c in enumerate(self.s):
            if c in b"([{":
                stack.append((c, i))
            elif c in closing:
                if stack and stack[-1][0] == closing[c]:
                    self.pairs[stack.pop()[1]] = i
                else:
                    file.errors += 1
        file.errors += len(stack)
        self.found: list[dict] = []

    def end(self, i: int) -> tuple[int, int]:
        """Where a body that follows place i opens and where the declaration ends."""
        m = re.compile(rb"[^{};]*?(\{|;|=>|\Z)", re.S).match(self.s, i)
        if m and m[1] == b"{":
            return m.start(1), self.pairs.get(m.start(1), len(self.s) - 1) + 1
        if m and m[1] == b"=>":
            brace = re.compile(rb"\s*\{").match(self.s, m.end(1))
            if brace and self.lang != "dart":
                return brace.end() - 1, self.pairs.get(brace.end() - 1, len(self.s) - 1) + 1
            stop = re.compile(rb"[;\n]").search(self.s, m.end(1))
            return m.start(1), stop.start() + 1 if stop else len(self.s)
        return (m.end(), m.end()) if m else (i, i)

    def add(self, kind: str, name: bytes, a: int, body: int, b: int, params: int | None = None, returns: bytes | None = None) -> None:
        listed = []
        if params is not None and params in self.pairs:
            depth, start = 0, params + 1
            for i in range(params + 1, self.pairs[params] + 1):
                c = self.s[i]
                if c in b"([{<":
                    depth += 1
                elif c in b")]}>" and depth:
                    depth -= 1
                elif c in b",)" and not depth:
                    if part := self.f.text(start, i).strip():
                        listed.append(part)
                    start = i + 1
        self.found.append({"kind": kind, "name": name.decode(), "a": a, "b": max(b, a + 1), "body": body, "params": listed, "returns": returns.decode().strip() or None if returns else None})

    def each(self, pattern: bytes) -> Iterator[re.Match]:
        return re.compile(pattern, re.M).finditer(self.s)

    def javascript(self) -> None:
        ts = self.lang != "javascript"
        for m in self.each(rb"\b(?:abstract\s+)?class\s+(" + _ID + rb")"):
            body, b = self.end(m.end())
            self.add("class", m[1], m.start(), body, b)
        if ts:
            for m in self.each(rb"\b(interface|enum)\s+(" + _ID + rb")"):
                body, b = self.end(m.end())
                self.add(m[1].decode(), m[2], m.start(), body, b)
            for m in self.each(rb"^\s*(?:export\s+)?(type)\s+(" + _ID + rb")[^=\n]*="):
                stop = self.s.find(b";", m.end())
                b = stop + 1 if stop >= 0 else len(self.s)
                self.add("type_alias", m[2], m.start(1), b, b)
        for m in self.each(rb"\b(?:async\s+)?function\s*\*?\s*(" + _ID + rb")\s*(?:<[^>]*>)?\s*(\()"):
            close = self.pairs.get(m.start(2), m.end())
            body, b = self.end(close + 1)
            self.add("function", m[1], m.start(), body, b, m.start(2), self.s[close + 1 : body].lstrip(b" :"))
        for m in self.each(rb"\b(const|let|var)\s+(" + _ID + rb")\s*(?::[^=;\n]+)?=\s*"):
            rest = self.s[m.end() : m.end() + 400]
            arrow = re.match(rb"(?:async\s*)?(?:function\b|\(|" + _ID + rb"\s*=>)", rest)
            opened = self.s.find(b"(", m.end())
            is_function = bool(arrow) and (b"function" in arrow.group() or b"=>" in arrow.group() or (opened in self.pairs and re.match(rb"\s*(?::[^={]+)?=>", self.s[self.pairs[opened] + 1 : self.pairs[opened] + 200])))
            if is_function:
                after = self.pairs[opened] + 1 if opened in self.pairs and b"=>" not in arrow.group() else m.end()
                body, b = self.end(after)
                self.add("function", m[2], m.start(2), body, b, opened if b"=>" not in arrow.group() else None)
            elif m[1] == b"const":
                stop = re.compile(rb";|\n").search(self.s, m.end())
                b = stop.start() if stop else len(self.s)
                self.add("constant", m[2], m.start(2), b, b)
        for m in self.each(rb"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(#?" + _ID + rb")\s*(?:<[^>]*>)?(\()"):
            close = self.pairs.get(m.start(2))
            if m[1] in _KEYWORDS or close is None or not re.match(rb"\s*(?::[^{;=]+)?\{", self.s[close + 1 : close + 300]):
                continue
            body, b = self.end(close + 1)
            self.add("constructor" if m[1] == b"constructor" else "method", m[1], m.start() + len(m.group()) - len(m.group().lstrip()), body, b, m.start(2), self.s[close + 1 : body].lstrip(b" :"))
        for m in self.each(rb"\b(it|test|specify)\s*(\()\s*(['\"`])"):
            quote = self.f.source.find(m[3], m.end())
            b = self.pairs.get(m.start(2), len(self.s) - 1) + 1
            self.add("test", self.f.source[m.end() : quote], m.start(), b, b)

    def dart(self) -> None:
        for m in self.each(rb"\b(?:abstract\s+)?(class|mixin|extension|enum)\s+(" + _ID + rb")"):
            body, b = self.end(m.end())
            self.add(m[1].decode(), m[2], m.start(), body, b)
        for m in self.each(rb"^[ \t]*(?:static\s+|external\s+|const\s+|factory\s+|final\s+)*((?:[A-Za-z_][A-Za-z0-9_<>?,. ]*\s+)?)(" + _ID + rb"(?:\." + _ID + rb")?)\s*(\()"):
            close = self.pairs.get(m.start(3))
            if m[2] in _KEYWORDS or m[1].split()[:1] in ([b"return"], [b"await"], [b"new"]) or close is None or not re.match(rb"\s*(?:async\*?\s*|sync\*\s*)?(?:\{|=>|:[^:])", self.s[close + 1 : close + 40]):
                continue
            body, b = self.end(close + 1)
            self.add("method", m[2], m.start() + len(m.group()) - len(m.group().lstrip()), body, b, m.start(3), m[1])
        for m in self.each(rb"\bstatic\s+(?:final|const)\s+(?:[A-Za-z_][A-Za-z0-9_<>?]*\s+)?(" + _ID + rb")\s*="):
            b = self.s.find(b";", m.end()) + 1 or len(self.s)
            self.add("constant", m[1], m.start(), b, b)

    def go(self) -> None:
        for m in self.each(rb"^\s*type\s+(" + _ID + rb")\s+(interface|struct)?"):
            body, b = self.end(m.end())
            self.add("interface" if m[2] == b"interface" else "class", m[1], m.start(1), body, b)
        for m in self.each(rb"^func\s*(\([^)]*\)\s*)?(" + _ID + rb")\s*(\()"):
            close = self.pairs.get(m.start(3), m.end())
            body, b = self.end(close + 1)
            self.add("method" if m[1] else "function", m[2], m.start(), body, b, m.start(3), self.s[close + 1 : body])
        for m in self.each(rb"^(?:const|var)\s+(" + _ID + rb")\b"):
            stop = self.s.find(b"\n", m.end())
            b = stop if stop >= 0 else len(self.s)
            self.add("constant", m[1], m.start(1), b, b)

    def run(self) -> None:
        {"dart": self.dart, "go": self.go}.get(self.lang, self.javascript)()
        self.found.sort(key=lambda d: (d["a"], -d["b"]))
        stack: list[tuple[int, dict, int, int]] = []
        scopes: list[tuple[int, int, dict]] = []
        for d in self.found:
            while stack and stack[-1][0] <= d["a"]:
                stack.pop()
            parent = stack[-1][1] if stack else None
            kind = d["kind"]
            inside = parent is not None and parent["kind"] in CLASS_KINDS
            if kind == "method" and not inside and self.lang != "go":
                if self.lang != "dart":
                    continue  # a call with a block, not a declaration
                kind = "function"
            if self.lang == "dart" and kind == "method" and inside and d["name"].split(".")[0] == parent["name"]:
                kind = "constructor"
            own = self.f.symbol(kind, d["name"], d["a"], d["b"], d["body"] if d["body"] < d["b"] else None, parent, d["params"], d["returns"])
            if kind == "test" or (self.lang == "go" and d["name"].startswith("Test")):
                own["kind"], own["metadata"] = "test", {"is_test": "true"}
            if d["b"] > d["a"]:
                stack.append((d["b"], own, d["a"], d["b"]))
                scopes.append((d["a"], d["b"], own))
        self.facts(scopes)

    def facts(self, scopes: list[tuple[int, int, dict]]) -> None:
        def owner(i: int) -> dict | None:
            around = [s for s in scopes if s[0] <= i < s[1]]
            return min(around, key=lambda s: s[1] - s[0])[2] if around else None

        def add(kind: str, a: int, b: int, target: str | None = None, metadata: dict | None = None, by: int | None = None) -> None:
            self.f.fact(kind, target if target is not None else self.f.text(a, b), a, b, owner(a if by is None else by), metadata)

        if self.lang == "go":
            for m in self.each(rb"^import\s+(?:\([^)]*\)|\"[^\"]*\")"):
                add("import", m.start(), m.end())
        else:
            for m in self.each(rb"^[ \t]*(import|export)\b[^;{}\n]*(?:\{[^}]*\}[^;\n]*)?;?"):
                text = self.f.text(m.start(), m.end())
                if m[1] == b"import" or re.search(r"\bfrom\s+['\"]", text):
                    a = m.start() + len(m.group()) - len(m.group().lstrip())
                    add(m[1].decode(), a, m.end())
            if self.lang != "dart":
                for m in self.each(rb"\b(?:const|let|var)\s+" + _ID + rb"\s*=\s*require\([^)]*\)"):
                    add("import", m.start(), m.end())
            for m in self.each(rb"\bclass\s+" + _ID + rb"(?:<[^>{]*>)?\s+([^{]*)\{"):
                clause = m[1].decode("utf-8", "replace")
                a = m.start(1)
                if re.search(r"\b(extends|with)\b", clause):
                    add("inherits", a, m.end(1), re.split(r"\bimplements\b", clause)[0], by=m.start())
                if hit := re.search(r"\bimplements\b.*", clause, re.S):
                    add("implements", a + hit.start(), m.end(1), hit.group(), by=m.start())
        starts = {s[0] for s in scopes}
        declared = {(s[2]["name"], s[0]) for s in scopes}
        for m in self.each(rb"(?<![A-Za-z0-9_$.])((?:new\s+)?" + _ID + rb"(?:\s*\(\s*\))?(?:\s*\??\.\s*" + _ID + rb"(?:\(\))?)*)\s*(\()"):
            name = re.findall(_ID, m[1])[-1]
            if name in _KEYWORDS or m.start(2) not in self.pairs:
                continue
            before = self.s[: m.start()].rstrip().rsplit(None, 1)[-1:] if m.start() else []
            method = self.lang == "go" and re.search(rb"\bfunc\s*\([^)]*\)\s*$", self.s[max(0, m.start() - 500) : m.start()])
            if method or before and before[0] in (b"function", b"func") or any(n == name.decode() and a <= m.start() <= a + 120 and b"(" not in self.s[a : m.start()] for n, a in declared if a in starts and a <= m.start()):
                continue
            a, b = m.start(), self.pairs[m.start(2)] + 1
            target = re.sub(r"^new\s+", "", self.f.text(a, m.end(1)))
            if self.f.is_configuration(a, b) or name in (b"require", b"it", b"test", b"specify", b"describe"):
                continue
            if self.lang not in ("dart", "go") and looks_like_route(target):
                add("route", a, b, target)
                continue
            around = owner(a)
            scope = self.f.text(around["start_byte"], around["end_byte"]) if around else None
            add("call", a, b, target, self.f.receiver(target, scope))


def extract(language: str, path: str, source: bytes) -> dict:
    """{symbols, facts, chunks, error_count} of one file; source must be strict UTF-8 (else UnicodeDecodeError)."""
    text = source.decode("utf-8")
    file = _File(path, language, source)
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            file.errors += 1
            tree = _longest_valid(text)
        if tree is not None:
            walker = _Python(file)
            for node in tree.body:
                walker.visit(node)
    else:
        _Braces(file).run()
    return file.finish()


def _longest_valid(text: str) -> ast.Module | None:
    """The tree of a broken file's top-level statements that parse by themselves, at their own lines."""
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if x and not x[0].isspace() and x[0] not in ")]}#"] + [len(lines)]
    body: list[ast.stmt] = []
    for a, b in zip(starts, starts[1:], strict=False):
        try:
            body += ast.parse("\n" * a + "\n".join(lines[a:b])).body
        except (SyntaxError, ValueError):
            continue
    return ast.Module(body=body, type_ignores=[])


_SPAN = [(n, pa.int64()) for n in ("start_byte", "end_byte")] + [(n, pa.int32()) for n in ("start_line", "end_line", "start_column", "end_column")]
_MAP = pa.map_(pa.string(), pa.string())
_SYMBOL = pa.struct([("id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("signature", pa.string()), ("parameters", pa.list_(pa.string())), ("return_type", pa.string()), ("docstring", pa.string()), ("metadata", _MAP), *_SPAN])
_FACT = pa.struct([("id", pa.string()), ("kind", pa.string()), ("target_text", pa.string()), ("source_symbol_id", pa.string()), ("metadata", _MAP), *_SPAN])
_CHUNK = pa.struct([("id", pa.string()), ("kind", pa.string()), ("content_hash", pa.string()), ("source_text", pa.string()), ("symbol_id", pa.string()), ("metadata", _MAP), *_SPAN])
_SPAN_SQL = "start_byte:bigint,end_byte:bigint,start_line:int,end_line:int,start_column:int,end_column:int"
EXTRACTED = (
    "relative_path string, language string, content_hash string, parse_status string, error_count int, "
    f"symbols array<struct<id:string,kind:string,name:string,qualified_name:string,signature:string,parameters:array<string>,return_type:string,docstring:string,metadata:map<string,string>,{_SPAN_SQL}>>, "
    f"facts array<struct<id:string,kind:string,target_text:string,source_symbol_id:string,metadata:map<string,string>,{_SPAN_SQL}>>, "
    f"chunks array<struct<id:string,kind:string,content_hash:string,source_text:string,symbol_id:string,metadata:map<string,string>,{_SPAN_SQL}>>"
)


def extract_files(scanned: DataFrame) -> DataFrame:
    """One row for each readable file of a scan with its symbols, facts and chunks; undecodable ones are `failed` and empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    got = extract(r["language"], r["relative_path"], r["content"])
                    status = "parsed_with_errors" if got["error_count"] else "parsed"
                except UnicodeDecodeError:
                    got, status = {"symbols": [], "facts": [], "chunks": [], "error_count": 0}, "failed"
                rows.append((r["relative_path"], r["language"], r["content_hash"], status, got["error_count"], got["symbols"], got["facts"], got["chunks"]))
            c = list(zip(*rows, strict=True)) or [()] * 8
            pairs = lambda items: [[x | {"metadata": list(x["metadata"].items())} for x in own] for own in items]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int32()), pa.array(pairs(c[5]), pa.list_(_SYMBOL)), pa.array(pairs(c[6]), pa.list_(_FACT)), pa.array(pairs(c[7]), pa.list_(_CHUNK))],
                ["relative_path", "language", "content_hash", "parse_status", "error_count", "symbols", "facts", "chunks"],
            )

    return scanned.where("skip is null").select("relative_path", "language", "content", "content_hash").mapInArrow(run, EXTRACTED)
