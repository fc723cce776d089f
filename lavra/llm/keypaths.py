"""Values of configuration formats with their key paths and places.

`leaves` reads JSON (with comments and trailing commas), XML, and the formats of lines: YAML, INI, TOML, properties and dotenv.
A path holds every name from the root to the value; items of lists are numbered. Where a mapping or element names its value by
a sibling (name: x, value: y), the name x stands in the path before it. A file that is cut off gives what stands before the cut.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Names of values that say nothing, and of siblings that name such a value.
GENERIC = {"value", "valor", "default", "data", "conteudo", "content", "stringdata"}
NAMING = {"name", "nome", "key", "chave", "id", "variable", "variavel"}
# Fixed value: share of the lines that must be understood for a file to be of a format of lines.
LEAST_SHARE = 0.7

FLOW = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*)|(?P<open>[{\[])|(?P<close>[}\]])|(?P<mark>[:,=])|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.|'')*')|"
    r"(?P<bare>[^\s,:=\[\]{}\"'#](?:[^\n,\[\]{}\"':=]|=+(?=\s*[,\]}])|[:=](?=[^\s,\]}\"'{\[]))*)"
)
XML = re.compile(
    r"<!--[\s\S]*?(?:-->|$)|<!\[CDATA\[(?P<cdata>[\s\S]*?)(?:\]\]>|$)|<\?[\s\S]*?\?>|<![^<>]*>|"
    r"<(?P<end>/?)(?P<tag>[A-Za-z_][\w:.-]*)(?P<attributes>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<single>/?)>"
)
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')")
SECTION = re.compile(r"^\s*\[{1,2}\s*([^\[\]{},]+?)\s*\]{1,2}\s*(?:[#;].*)?$")
KEY = re.compile(
    r"(?:(?:export|set|ENV|ARG)\s+)?(?!(?:class|def|if|elif|else|for|while|with|try|except|case|return|import|from|const|let|var|function|public|private|protected|static)\b)"
    r"(?P<key>\"[^\"\n]+\"|'[^'\n]+'|[A-Za-z0-9_À-ÿ][\w./$-]*(?: [\w./$-]+){0,4}?)\s*(?P<sep>:(?=\s|$)|=(?![=>])|(?<=[\w.-]):(?!//|:))[ \t]*"
)
SCALAR = re.compile(r"(?P<quoted>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.|'')*')\s*,?\s*(?:[#;].*)?$")


class Leaf(NamedTuple):
    path: tuple[str, ...]
    value: str
    spans: tuple[tuple[int, int], ...]
    needs_quotes: bool


class _Out:
    """Leaves as they come: each component with the number of the mapping it is a key of."""

    def __init__(self) -> None:
        self.rows: list[tuple[tuple[tuple[str, int], ...], str, tuple[tuple[int, int], ...], bool]] = []
        self.groups = 0

    def group(self) -> int:
        self.groups += 1
        return self.groups

    def add(self, path, value: str, spans, needs_quotes: bool = False) -> None:
        self.rows.append((tuple(path), value, tuple(spans), needs_quotes))

    def leaves(self) -> list[Leaf]:
        names: dict[int, str] = {}
        secret: set[int] = set()
        for path, value, _, _ in self.rows:
            own = path[:-1] if len(path) > 1 and path[-1][0] == "value" and path[-2][0].lower() in {*NAMING, "kind"} else path
            if own and own[-1][0].lower() in NAMING and value:
                names.setdefault(own[-1][1], value)
            if own and own[-1][0].lower() == "kind" and value == "Secret":
                secret.add(own[-1][1])
        out = []
        for path, value, spans, needs_quotes in self.rows:
            full: list[str] = []
            for name, group in path:
                if name.lower() in GENERIC and group in names:
                    full.append(names[group])
                if name.lower() in ("data", "stringdata") and group in secret:
                    full.append("secrets")
                full.append(name)
            out.append(Leaf(tuple(full), value, spans, needs_quotes))
        return out


def _flow(text: str, at: int, base: list[tuple[str, int]], out: _Out, json: bool = True) -> tuple[int, bool]:
    """Read one bracketed value; its end, and whether it ended well."""
    stack: list[list] = []  # closing mark, key or index, group, whether a value is awaited
    while at < len(text):
        m = FLOW.match(text, at)
        if not m:
            return at, False
        at = m.end()
        if m.group("skip"):
            continue
        top = stack[-1] if stack else None
        if m.group("open"):
            if top and not top[3]:
                return at, False
            mapping = m.group("open") == "{"
            stack.append(["}" if mapping else "]", "0", out.group(), not mapping])
        elif m.group("close"):
            if not top or top[0] != m.group("close"):
                return at, False
            stack.pop()
            if not stack:
                return at, True
            stack[-1][3] = False
        elif not top:
            return at, False
        elif m.group("mark") == ",":
            if top[0] == "]":
                top[1] = str(int(top[1]) + 1)
            top[3] = top[0] == "]"
        elif m.group("mark"):
            if top[0] == "]":
                return at, False
            top[3] = True
        else:
            start, end = m.span()
            token = m.group().rstrip()
            bare = m.group("bare") is not None
            if bare:
                token = re.sub(r"\s+#.*$", "", token)
                end = start + len(token)
            else:
                start, end, token = start + 1, end - 1, token[1:-1]
            if not top[3] and bare and top[0] == "}" and (cut := re.match(r"([\w.-]+):(?=\S)", token)):
                top[1], token, start = cut.group(1), token[cut.end() :], start + cut.end()
                top[3] = True
            if not top[3]:
                if top[0] == "]":
                    return at, False
                top[1] = token
            elif json and bare and not re.fullmatch(r"-?[\d.]+(?:[eE][+-]?\d+)?|true|false|null", token):
                return at, False
            else:
                path = base + [(f[1], f[2]) for f in stack]
                out.add(path, token, [(start, end)], json and bare)
                top[3] = False
    return at, False


def _json(text: str, out: _Out) -> bool:
    """One JSON value, or several one after the other."""
    at, any_read = 0, False
    while m := re.compile(r"(?:\s|,|//[^\n]*|/\*[\s\S]*?\*/)*(?=[{\[])").match(text, at):
        if m.end() >= len(text):
            break
        at, well = _flow(text, m.end(), [], out)
        any_read = any_read or well or bool(out.rows)
        if not well:
            break
    return any_read


def _xml(text: str, out: _Out) -> None:
    stack: list[tuple[str, int, int]] = []  # tag, group it stands in, group of what is in it
    at, root = 0, out.group()
    closed = {t.rpartition(":")[2] for t in re.findall(r"</([\w:.-]+)", text)}

    def leaf(start: int, end: int) -> None:
        value = text[start:end]
        if stack and value.strip():
            start += len(value) - len(value.lstrip())
            value = value.strip()
            out.add([(t, g) for t, g, _ in stack] + [("value", stack[-1][2])], value, [(start, start + len(value))])

    for m in XML.finditer(text):
        leaf(at, m.start())
        at = m.end()
        if m.group("cdata") is not None:
            leaf(*m.span("cdata"))
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.rpartition(":")[2]
        if m.group("end"):
            if any(t == tag for t, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        inner = out.group()
        stack.append((tag, stack[-1][2] if stack else root, inner))
        for a in ATTRIBUTE.finditer(text, *m.span("attributes")):
            g = 2 if a.group(2) is not None else 3
            out.add([(t, k) for t, k, _ in stack] + [(a.group(1).rpartition(":")[2], inner)], a.group(g), [a.span(g)])
        if m.group("single") or tag not in closed:
            stack.pop()


def _lines(text: str, out: _Out) -> float:
    """YAML, INI, TOML, properties, dotenv; the share of lines understood."""
    rows, at = [], 0
    for line in text.split("\n"):
        rows.append((at, line.rstrip("\r")))
        at += len(line) + 1
    starts = [s for s, _ in rows]
    section: list[tuple[str, int]] = []
    root = out.group()
    stack: list[tuple[int, str, int, int, bool]] = []  # indentation, name, group it stands in, group of what is in it, whether an item
    ink = understood = 0
    most = (1 - LEAST_SHARE) * sum(bool(r.strip()) for _, r in rows)
    toml = any(SECTION.match(r) for _, r in rows) and re.search(r"(?m)^[^\n=#;]*=\s*[\"'\[{]", text) is not None
    k = 0
    while k < len(rows):
        start, line = rows[k]
        k += 1
        if not line.strip():
            continue
        if ink - understood > most:
            return 0.0
        ink += 1
        body = line.lstrip()
        if body[0] in "#;%" or re.match(r"(?:---|\.\.\.)(?:\s|$)|!(?!\S*[=:])", body):
            understood += 1
            continue
        if m := SECTION.match(line):
            root = out.group()
            section = [(p.strip("\"' "), 0) for p in re.split(r"[.\s:]+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", m.group(1)) if p.strip("\"' ")]
            stack.clear()
            understood += 1
            continue
        deep = len(line) - len(body)
        while m := re.match(r"-(?:\s+|$)", body):
            while stack and (stack[-1][0] > deep or stack[-1][0] == deep and stack[-1][4]):
                stack.pop()
            stack.append((deep, "0", stack[-1][3] if stack else root, out.group(), True))
            deep += m.end()
            body = body[m.end() :]
        if not body:
            understood += 1
            continue
        m = KEY.match(body)
        if m:
            while stack and stack[-1][0] >= deep:
                stack.pop()
            group = stack[-1][3] if stack else root
            base = section + [(n, g) for _, n, g, _, _ in stack]
            key = m.group("key")
            names = [(key[1:-1], group)] if key[0] in "\"'" else [(p, group) for p in key.split(".") if p]
            path = base + names
            value, place = body[m.end() :], start + len(line) - len(body) + m.end()
        else:
            while stack and stack[-1][0] > deep:
                stack.pop()
            path = section + [(n, g) for _, n, g, _, _ in stack]
            value, place = body, start + len(line) - len(body)
            if not stack or not (stack[-1][4] or deep > stack[-1][0]):
                continue
        if tag := re.match(r"(?:(?:&\S+|!!\S+)\s+)+", value):
            value, place = value[tag.end() :], place + tag.end()
        if value.startswith(("!", "*")) and " " in value.strip() or value.startswith("*"):
            understood += 1
            continue
        if not value or re.match(r"[#;]", value):
            if m:
                stack.append((deep, ".".join(n for n, _ in names), group, out.group(), False))
            understood += 1
            continue
        if re.match(r"[|>][+-]?\d*[+-]?\s*(?:#.*)?$", value) and m:
            understood += 1
            spans = []
            while k < len(rows) and (not rows[k][1].strip() or len(rows[k][1]) - len(rows[k][1].lstrip()) > len(line) - len(line.lstrip())):
                s, row = rows[k]
                if row.strip():
                    spans.append((s + len(row) - len(row.lstrip()), s + len(row.rstrip())))
                    ink += 1
                    understood += 1
                k += 1
            if spans:
                out.add(path, "\n".join(text[a:b] for a, b in spans), spans)
            continue
        if value[:3] in ('"""', "'''"):
            close = text.find(value[:3], place + 3)
            close = len(text) if close < 0 else close
            spans = [(place + 3 + x.start(), place + 3 + x.end()) for x in re.finditer(r"[^\s](?:[^\n]*[^\s])?", text[place + 3 : close])]
            understood += 1
            while k < len(rows) and starts[k] <= close:
                ink += bool(rows[k][1].strip())
                understood += bool(rows[k][1].strip())
                k += 1
            if spans:
                out.add(path, "\n".join(text[a:b] for a, b in spans), spans)
            continue
        if value[0] in "{[" and not value.startswith("{{"):
            kept = len(out.rows)
            end, well = _flow(text, place, path, out, json=False)
            if well:
                understood += 1
                while k < len(rows) and starts[k] < end:
                    ink += bool(rows[k][1].strip())
                    understood += bool(rows[k][1].strip())
                    k += 1
                continue
            del out.rows[kept:]
        if q := SCALAR.match(value):
            out.add(path, q.group("quoted")[1:-1], [(place + 1, place + q.end("quoted") - 1)])
            understood += 1
            continue
        bare = re.sub(r"(?:\s+[#;].*|,)?\s*$", "", value)
        if re.match(r"\(?\s*[\"'`]", bare) or re.search(r"[{}();]", bare) and re.search(r"\w\(|[;{}]\s*$", bare):
            continue
        understood += 1
        if bare.endswith("\\"):
            bare = bare[:-1].rstrip()
            if m:
                stack.append((deep, ".".join(n for n, _ in names), group, out.group(), False))
        parts = list(re.finditer(r"[^\s,](?:[^,]|,(?!\s))*", bare)) if re.search(r",\s", bare) else []
        if len(parts) > 1 and not any(re.search(r"\s", p.group().strip()) for p in parts):
            for i, p in enumerate(parts):
                out.add(path + [(str(i), 0)], p.group().strip(), [(place + p.start(), place + p.start() + len(p.group().strip()))])
        elif bare:
            numeric = toml and bool(m) and m.group("sep") == "=" and re.fullmatch(r"\d+", bare) is not None
            out.add(path, bare, [(place, place + len(bare))], numeric)
    return understood / ink if ink else 0.0


def leaves(text: str) -> list[Leaf]:
    """Values of a configuration file, in order; none if the text is of no format known here."""
    head = text.lstrip("﻿ \t\r\n")[:2000]
    if head[:1] in ("{", "[") or head[:2] in ("//", "/*"):
        out = _Out()
        if _json(text.replace("﻿", " ", 1) if text.startswith("﻿") else text, out) and out.rows:
            return out.leaves()
    if re.match(r"<(?:\?xml\b|!--|[A-Za-z_])", head) and not re.match(r"(?i)<(?:html|script|body|head)\b", head) and "<?php" not in head:
        out = _Out()
        _xml(text, out)
        return out.leaves()
    out = _Out()
    return out.leaves() if _lines(text, out) >= LEAST_SHARE else []
