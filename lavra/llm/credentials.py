"""Credentials written into source code and configuration files.

`scan` reads one file as key paths with the place of each value (`keypaths`: JSON, YAML, INI, TOML, dotenv, properties, XML), tests every
name on the path, and the own names of assignments, object fields and arguments in code; it tests value shapes, and adds what needs no key: provider tokens, signed
tokens, private keys, credentials in URLs, headers, commands, connection strings and comments. `redact` splices a mark over
each value in the original bytes, so quotes, indentation, line ends and line numbers stay.

A file is scanned on its own and whole, so there is no shuffle and no task depends on how often a file is repeated.

Cases: null or blank contents give no rows (redaction keeps them); repeated files give their rows each; ids may repeat; the
stated language is not trusted and may be null, the contents decide; CRLF and one-line files are as any other.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions.arrow import map_arrow
from lavra.llm import lexicon
from lavra.llm.keypaths import GENERIC, leaves
from lavra.session import spread

MARK = "REDACTED"
COMMON_WORDS = frozenset(w for words in lexicon.COMMON.values() for w in words)

# Words of key names that hold credentials, words that make a key harmless, and values to be filled in.
SENSITIVE = set(
    (
    "senha senhas password passwd passphrase passcode pwd pass secret segredo token credencial credential credentials "
    "authtoken apikey apitoken apisecret accesstoken accesskey secretkey privatekey clientsecret authkey refreshtoken "
    "webhooksecret chaveapi chavesecreta"
    ).split()
)
SENSITIVE_PAIRS = {
    ("api", "key"), ("access", "key"), ("secret", "key"), ("private", "key"), ("auth", "key"), ("encryption", "key"), ("signing", "key"),
    ("chave", "api"), ("chave", "secreta"), ("chave", "privada"), ("chave", "acesso"), ("master", "key"), ("account", "key"), ("shared", "key"),
}
HARMLESS = set(
    (
    "length len min max minimo maximo limit limite hint dica label rotulo msg mensagem message count type tipo id ids file arquivo path caminho "
    "name nome expires expira expiry ttl policy politica regex pattern field campo header title titulo placeholder prompt hash digest size tamanho "
    "public publica publico format formato url uri required enabled policy rotation visible help ajuda text texto tokenizer tokens budget days dias "
    "attempts tentativas column coluna"
    ).split()
)
# Names that hold credentials only as the name of a section or list, and names beside the credentials of a section.
SECTIONS = set("secrets segredos senhas passwords passwds pwds passphrases passcodes credentials credenciais tokens apikeys authtokens apitokens accesskeys secretkeys privatekeys".split())
SECTION_PAIRS = {(a, b + "s") for a, b in SENSITIVE_PAIRS if b == "key"} | {("chaves", b) for a, b in SENSITIVE_PAIRS if a == "chave"} | {("chaves", "privadas"), ("chaves", "secretas")}
BESIDE = HARMLESS - {"tokens"} | set(
    (
        "user users username usuario usuarios login email mail host hostname server servidor port porta region regiao zone provider issuer audience scope scopes realm algorithm algoritmo alg cipher "
        "encoding iterations rounds timeout lifetime duration duracao validade expiration version versao description descricao source target external driver engine backend store ref refs kind class "
        "mode metodo method created updated status state environment ambiente owner comment comentario"
    ).split()
)
# Values that are no credential unless their own name says so: short numbers, spans of time, versions, dates, hosts, addresses.
PLAIN = re.compile(r"\d{1,5}[A-Za-z]{0,3}|v?\d+(?:\.\d+)+\S{0,8}|\d{4}-\d\d-\d\d\S*|(?:[a-z][a-z0-9-]*|[0-9-]+)(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?::\d+)?|[^@\s]+@[\w-]+(?:\.[\w-]+)+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
FILL_IN = re.compile(
    r"(?i)^(?:change[-_ ]?(?:me|it|this)|troque.*|trocar.*|todo|tbd|fixme|insira.*|coloque.*|preencha.*|sua?[-_].*|seu[-_].*|your[-_ ]?.*|my[-_](?:password|secret|token|key).*|"
    r"<.*>|\[.*\]|.*_here|.*-here|.*aqui|example.*|exemplo.*|placeholder.*|dummy.*|fake.*|none|null|nil|undefined|true|false|sim|nao|não|yes|no|on|off|"
    r"(?:redacted)+|removed|hidden|masked|secret|senha|password|token|n/?a|[x*.\-_#?•0]+|\W+)$"
)
REFERENCE = re.compile(
    r"(?i)\$\{|\$\(|\{\{|%\(|%[A-Z_]+%|<%|#\{|^\$[A-Za-z_]\w*$|^@|!vault|\bvault[:/]|process\.env|environ|getenv|env\.|ENV\[|secrets?\.|^(?:file|env|ssm|arn|ref|vault|secret|keyring|op):|"
    r"/run/secrets|^(?:\.{0,2}/|~/|[A-Za-z]:\\)|\.(?:pem|key|crt|md|txt|json|ya?ml|env)$|^sha(?:1|256|384|512)[-:]|^data:|secretKeyRef|valueFrom"
)
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[A-Za-z0-9_-]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|"
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{24,}|ya29\.[\w-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|hf_[A-Za-z0-9]{24,}|"
    r"SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{10,})"
)
# What every such token holds, in lower case.
TOKEN_MARKS = ("akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "sk-", "aiza", "ya29.", "npm_", "pypi-", "hf_", "sg.", "eyj")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
# A line of a key, also in a comment or a string; lines end with a line feed or its escape.
BODY_LINE = re.compile(r"^(?P<lead>\s*(?:(?://+|#+|\*+|--|;+|%|>|REM\b)\s*)?[\"'`(]*)(?P<run>=?(?=[+/]*[A-Za-z0-9])[A-Za-z0-9+/]+={0,2})(?P<tail>[\"'`)]*\s*[+.,;\\]*\s*\)?\s*)$")
LONG_RUN = re.compile(r"(?:^|[\s\"'`>|:])[A-Za-z0-9+/]{40,}={0,2}[\"'`)]*\s*[+.,;\\]*\s*$")
LINE_END = re.compile(r"\r?\n|(?:\\r)?\\n")
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----[\s\S]*?-----END [A-Z0-9 ]+-----")
EMBEDDED = re.compile(r"data:[\w./+-]+;base64,[A-Za-z0-9+/=]*|sha(?:1|256|384|512)-[A-Za-z0-9+/=]{20,}")
URL = re.compile(r"(?i)\b[a-z][a-z0-9+.-]*://([^\s:/@'\"<>`]*):([^\s/@'\"<>`]+)@[^\s'\"<>`]")
HEADER = re.compile(r"(?i)\b(?:(?:proxy-)?authorization\s*[:=]\s*[\"']?\s*(?:bearer|basic|token|apikey)\s+|(?:x-)?(?:api-key|auth-token|access-token|vault-token|gitlab-token)\s*:\s*)([^\s'\"`;,]+)")
DSN = re.compile(r"(?i)(?:^|[;\s'\"`])(?:password|pwd|accountkey|sharedaccesskey|senha)\s*=\s*([^;'\"`\s]+)\s*;|;\s*(?:password|pwd|accountkey|sharedaccesskey)\s*=\s*([^;'\"`\s]+)")
FLAG = re.compile(r"(?i)(?:^|\s)--?([a-z][a-z0-9_-]*)(?:=|\s+)([\"']?)([^\s\"'`]+)\2")
USERPASS = re.compile(r"(?:^|\s)(?:-u|--user)(?:=|\s+)[\"']?([^\s:\"']+):([^\s\"']+)")
SSHPASS = re.compile(r"\bsshpass\s+-p\s*[\"']?([^\s\"']+)")
QUERY = re.compile(r"[?&]([A-Za-z_][\w.-]*)=([^\s&#'\"`<>]+)")
SQL = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\S+\s+)?by|with\s+(?:encrypted\s+)?password|set\s+password\s*=|password)\s+(?:=\s*)?['\"]([^'\"\n]+)['\"]")
CONNECT = re.compile(r"(?i)\b(?:getConnection|connect|mysqli|PDO|login|authenticate|basic_?auth|HTTPBasicAuth|new\s+NetworkCredential)\s*\(([^()\n]*)\)")
STRING = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)")
SPOKEN = re.compile(
    r"(?i)(?:\b(?:senha|password|passwd|pwd|token|segredo|api[ _-]?key|chave)\b(?:\s+(?:do|da|de|for|of|is|é)\s+[\w.@-]+){0,2}\s*[:=]\s*|\blogin\s*[:=]?\s*\S+\s*[/,|]\s*(?:senha|password|pass|pwd)\s*[:=]?\s*|\b(?:user|usuario|usuário)\s*[:=]?\s*\S+\s*[/,|]\s*(?:senha|password|pass|pwd)\s*[:=]?\s*)"
    r"([^\s\"'`;,()<>{}]{4,})\s*(?:-->|\*/)?\s*$"
)
COMMENT = re.compile(r"^\s*(?:#|//|--|;|<!--|/?\*+|%|REM\b|\"\"\")|\s(?:#|//|--)\s")
ASSIGN = re.compile(
    r"(?P<key>[\"'`]?[A-Za-z_$@:][\w.$-]*[\"'`]?|\[[\"'][\w.-]+[\"']\])\s*\]?\s*"
    r"(?::\s*[A-Za-z_][\w<>\[\]|. ]*\s*=(?!=)|:=|=>|=(?!=)|:(?!:|//))\s*(?:\w+\s*\(\s*)?\(?\s*(?:[bfruBFRU]{1,2}(?=[\"']))?"
    r"(?P<q>\"\"\"|'''|[\"'`])(?P<value>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)"
)
BARE = re.compile(r"^(?P<lead>\s*(?:(?:#|//|;|--)\s*(?:old\s+)?)?(?:-\s+)?(?:export\s+|ENV\s+|ARG\s+|set\s+)?)(?P<key>[\"']?[A-Za-z_][\w.-]*[\"']?)(?P<sep>\s*[:=]\s*|\s+(?=\S+\s*$))(?P<value>[^\s\"'`#].*?)\s*,?\s*$")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
MORE = re.compile(r"(?:\s*(?:\+|\.|\\|\|\|)?\s*|\s*(?:\+|\.|\\)?\s*\n\s*(?:\+|\.)?\s*)([\"'])((?:(?!\1)[^\\\n]|\\.)+)\1")
BLOCK = re.compile(r"^(?P<indent>\s*)(?:-\s+)?(?P<key>[\"']?[A-Za-z_][\w.-]*[\"']?)\s*:\s*[|>][+-]?\d*\s*$")
DASH = re.compile(" -")
HINTS = ("senha", "pass", "pwd", "secret", "segredo", "token", "credencia", "credential", "key", "chave")
HINT = re.compile("(?i)" + "|".join(HINTS))
GENERIC_KEY = re.compile(r"(?i)[\"']?\b(?:" + "|".join(sorted(GENERIC)) + r")\b[\"']?\s*[:=]")
ENDING = re.compile(r"(?:senha|password|passwd|secret|segredo|token|credencial|apikey|authtoken)$")
MYSQL = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\n|;&]*?\s-p([^\s\"'-][^\s\"']*)")
CAMEL = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-zà-ÿ]+|[A-Z]+|\d+")
CONFIG_LINE = re.compile(r"^\s*(?:[#;].*|\[[^\]]*\]|---|(?:-\s+)?(?:export\s+|ENV\s+|ARG\s+|RUN\s+|FROM\s+|LABEL\s+)?[\"']?[A-Za-z_][\w./ -]*[\"']?\s*(?::|=)\s*[^(){};]*|-\s+\S.*|(?:RUN|FROM|CMD|COPY|WORKDIR|EXPOSE|ENV)\b.*)$")


class Finding(NamedTuple):
    line: int
    start: int
    end: int
    kind: str
    path: str


def key_words(key: str) -> list[str]:
    return [w.lower() for part in re.split(r"[^A-Za-z0-9à-ÿ]+", key) for w in CAMEL.findall(part)]


def sensitive_key(key: str) -> bool:
    words = key_words(key)
    if not words or any(w in HARMLESS for w in words):
        return False
    if any(w in SENSITIVE for w in words) or any(p in SENSITIVE_PAIRS for p in zip(words, words[1:])):
        return True
    joined = "".join(w for w in words if not w.isdigit())
    if joined in SENSITIVE:
        return True
    # Capitals have no inner word bounds: the end of a word decides.
    if not key.isupper():
        return False
    return any(ENDING.search(w) for w in words) or any(a.endswith(p) and b == q for a, b in zip(words, words[1:]) for p, q in SENSITIVE_PAIRS)


def literal_value(value: str, least: int = 4) -> bool:
    """Whether a value is a credential itself, not a reference, a message or something to be filled in."""
    v = value.strip()
    if len(v) < least or re.search(r"\s", v) or FILL_IN.match(v) or REFERENCE.search(v):
        return False
    if re.fullmatch(r"[A-Za-z0-9+/]{6,}={1,2}", v):
        try:
            return literal_value(base64.b64decode(v, validate=True).decode("utf-8"))
        except ValueError:
            return True
    return "://" not in v


def passphrase(value: str) -> bool:
    """Whether a value of several words is a password rather than a message: no common word, none that names a credential, and one with letters and digits mixed."""
    words = value.split()
    if not 2 <= len(words) <= 8 or FILL_IN.match(value) or REFERENCE.search(value):
        return False
    plain = [re.sub(r"\W+", "", w.lower()) for w in words]
    return not any(not w or w in COMMON_WORDS or HINT.search(w) for w in plain) and any(re.search(r"\d", w) and re.search(r"[^\W\d]", w) for w in plain)


def sensitive_path(path: tuple[str, ...], value: str) -> bool:
    """Whether a value is a credential by any name on its path: its own, or that of a section or list it stands in, unless a name between says otherwise."""
    names = [p for p in path if not p.isdigit() and p.lower() not in GENERIC]
    if not names:
        return False
    if sensitive_key(names[-1]):
        return literal_value(value) or passphrase(value)
    if not literal_value(value) or PLAIN.fullmatch(value) or (sensitive_key(value) and re.fullmatch(r"[A-Za-z_.-]+(?:v?\d{1,2})?", value)):
        return False
    own = path[-1] == names[-1]
    for name in reversed(names):
        words = key_words(name)
        if any(w in BESIDE for w in words):
            return False
        if any(w in SECTIONS for w in words) or any(p in SECTION_PAIRS for p in zip(words, words[1:])):
            return not own or (_mixed(value) and not value.isdigit())
        if sensitive_key(name):
            return _mixed(value)
        own = False
    return False


class _Taken:
    """Spans that are spoken for; those taken do not overlap, those merely covered may."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return not k or self.ends[k - 1] <= start

    def take(self, start: int, end: int) -> bool:
        if not self.free(start, end):
            return False
        self.cover(start, end)
        return True

    def cover(self, start: int, end: int) -> None:
        """Merge the span with those it overlaps."""
        i, j = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


def _config_like(lines: list[str]) -> bool:
    ink = [x for x in lines if x.strip()]
    return bool(ink) and sum(bool(CONFIG_LINE.match(x)) for x in ink) >= 0.7 * len(ink)


def scan(text: str | None) -> list[Finding]:
    """Credentials of one file, in order of their place; one line may have several."""
    if not text or not text.strip():
        return []
    out: list[Finding] = []
    taken = _Taken()
    line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
    low = text.lower()

    def has(*words: str) -> bool:
        return any(w in low for w in words)

    def add(start: int, end: int, kind: str, path: str = "", line_at: int | None = None) -> bool:
        if start >= end or not taken.take(start, end):
            return False
        out.append(Finding(bisect_right(line_starts, start if line_at is None else line_at), start, end, kind, path))
        return True

    def continued(start: int, end: int, path: str) -> None:
        if start < end and taken.take(start, end):
            out.append(Finding(0, start, end, "continued", path))

    # Each rule is asked only where the text holds what all its matches hold.
    for m in PRIVATE.finditer(text) if has("private key") else ():
        close = PRIVATE_END.search(text, m.end())
        again = PRIVATE.search(text, m.end())
        if close and not (again and again.start() < close.start()):
            stop = close.start()
        else:
            stop = _body_end(text, m.end(), again.start() if again else len(text))
        body = text[m.end() : stop]
        if BODY.search(body):
            add(m.end(), stop, "private_key", line_at=m.start())
    for m in ARMOUR.finditer(text) if has("-----begin ") else ():
        if "PRIVATE KEY" not in m.group(0)[:60]:
            taken.cover(*m.span())
    for m in EMBEDDED.finditer(text) if has(";base64,", "sha1-", "sha256-", "sha384-", "sha512-") else ():
        taken.cover(*m.span())
    for m in URL.finditer(text) if has("://") and has("@") else ():
        if literal_value(m.group(2), 3) or (len(m.group(2)) >= 3 and not FILL_IN.match(m.group(2)) and not REFERENCE.search(m.group(2))):
            add(*m.span(2), "url")
    for m in HEADER.finditer(text) if has("authorization", "api-key", "auth-token", "access-token", "vault-token", "gitlab-token") else ():
        if literal_value(m.group(1), 6):
            add(*m.span(1), "header")
    for m in TOKENS.finditer(text) if has(*TOKEN_MARKS) else ():
        if not FILL_IN.match(m.group(0)):
            add(*m.span(), "provider_token")
    for m in DSN.finditer(text) if has(";") and has("password", "pwd", "accountkey", "sharedaccesskey", "senha") else ():
        g = 1 if m.group(1) else 2
        if literal_value(m.group(g)):
            add(*m.span(g), "connection_string")
    # Every word that makes a name sensitive holds a hint: without one in the whole file no path can be sensitive.
    hints = sorted({at for w in HINTS for at in _places(low, w)}) if len(low) == len(text) else [m.start() for m in HINT.finditer(text)]
    for leaf in leaves(text) if hints else ():
        values = [(text[s:e], s, e) for s, e in leaf.spans]
        first = True
        for value, s, e in values:
            if sensitive_path(leaf.path, value):
                if first:
                    first = not add(s, e, "number" if leaf.needs_quotes else "assignment", ".".join(leaf.path))
                else:
                    continued(s, e, ".".join(leaf.path))
    starts = {_key_start(text, at) for at in hints} | (set(_generic_keys(text, low)) if hints else set())
    outer = _Outer(text)
    passed = 0
    for place in sorted(starts):
        m = ASSIGN.match(text, place) if place >= passed else None
        if not m:
            continue
        passed = m.end("key")
        key = m.group("key").strip("\"'`[]$@: ")
        if sensitive_key(key) or (key.lower() in GENERIC and sensitive_path((*outer.at(m.start()), key), m.group("value"))):
            value = m.group("value")
            spans = [m.span("value")]
            at = m.end()
            while (nxt := MORE.match(text, at)) and ("+" in text[at : nxt.start(1)] or "(" in text[m.start() : m.start("q")] or "\\" in text[at : nxt.start(1)] or "." in text[at : nxt.start(1)]):
                value += nxt.group(2)
                spans.append(nxt.span(2))
                at = nxt.end()
            if literal_value(value) or (sensitive_key(key) and passphrase(value)):
                first = True
                for s, e in spans:
                    if first:
                        first = not add(s, e, "assignment", key)
                    else:
                        continued(s, e, key)
    for m in ELEMENT.finditer(text) if hints and has("</") else ():
        if sensitive_key(m.group(1)) and literal_value(m.group(2)):
            add(*m.span(2), "assignment", m.group(1))
    for m in QUERY.finditer(text) if hints and has("?", "&") else ():
        if sensitive_key(m.group(1)) and literal_value(m.group(2)):
            add(*m.span(2), "url")
    for m in SQL.finditer(text) if has("identified", "password") else ():
        if literal_value(m.group(1)):
            add(*m.span(1), "statement")
    for m in CONNECT.finditer(text) if has("connect", "mysqli", "pdo", "login", "authenticate", "auth", "networkcredential") else ():
        strings = [s for s in STRING.finditer(m.group(1))]
        plain = [a.strip() for a in m.group(1).split(",")]
        if len(strings) >= 2 and len(plain) == len(strings) and all(a[:1] in "\"'" for a in plain):
            s = strings[-1]
            if literal_value(s.group(0)[1:-1]) and not re.fullmatch(r"[\w-]+(\.[\w-]+)+", s.group(0)[1:-1]):
                add(m.start(1) + s.start() + 1, m.start(1) + s.end() - 1, "call")
    lines = text.split("\n")
    config: bool | None = None
    # Each rule below needs one of the hints or a flag; `leaves` covers values under a path.
    wanted = {bisect_right(line_starts, at) - 1 for at in hints} | {bisect_right(line_starts, m.start()) - 1 for m in DASH.finditer(text)}
    for k in sorted(wanted):
        line, at = lines[k], line_starts[k]
        body = line.rstrip("\r")
        comment = COMMENT.search(body)
        if comment:
            m = SPOKEN.search(body)
            if m and literal_value(m.group(1), 6) and _mixed(m.group(1)):
                add(at + m.start(1), at + m.end(1), "comment")
        for m in FLAG.finditer(body):
            if sensitive_key(m.group(1)) and literal_value(m.group(3)):
                add(at + m.start(3), at + m.end(3), "command", m.group(1))
        for rule in (USERPASS, SSHPASS, MYSQL):
            for m in rule.finditer(body):
                g = rule.groups
                if literal_value(m.group(g)):
                    add(at + m.start(g), at + m.end(g), "command")
        m = BARE.match(body)
        if m:
            key = m.group("key").strip("\"'")
            value = m.group("value")
            separated = m.group("sep").strip() or re.match(r"\s*(?:ENV|ARG)\s", body)
            cut = re.match(r"(\S+?)(?:\s+#.*)?$", value)
            if separated and cut and sensitive_key(key) and literal_value(cut.group(1)) and not re.search(r"[(){}\[\];]", cut.group(1)):
                shell = re.match(r"\s*(?:export|ENV|ARG)\s", body)
                if config is None:
                    config = _config_like(lines)
                if config and not comment or shell or _mixed(cut.group(1)):
                    add(at + m.start("value"), at + m.start("value") + len(cut.group(1)), "assignment", key)
        m = BLOCK.match(body)
        if m and sensitive_key(m.group("key").strip("\"'")):
            deep = len(m.group("indent"))
            nxt = at + len(line) + 1
            while nxt < len(text):
                stop = text.find("\n", nxt)
                stop = len(text) if stop < 0 else stop
                row = text[nxt:stop].rstrip("\r")
                if row.strip() and len(row) - len(row.lstrip()) <= deep:
                    break
                if row.strip() and literal_value(row.strip()):
                    add(nxt + len(row) - len(row.lstrip()), nxt + len(row.rstrip()), "assignment", m.group("key"))
                    break
                nxt = stop + 1
    return sorted(out, key=lambda f: f.start)


def _body_end(text: str, at: int, bound: int) -> int:
    """Where the key-shaped lines of a private key without an end mark end."""
    stop, read = at, False
    while at < bound:
        m = LINE_END.search(text, at, bound)
        end = m.start() if m else bound
        line = text[at:end]
        shape = BODY_LINE.match(line)
        run = shape.group("run") if shape else ""
        if LONG_RUN.search(line) or len(run) >= 16 and re.search(r"[0-9+/=]", run):
            stop, read = end, True
        elif read and run and (end == len(text) or re.search(r"[0-9+/=]|[a-z][A-Z]", run)):
            return end
        elif line.strip(" \t\r#/*;%>\"'`+.,") and (read or not re.search(r"[A-Za-z-]+: ", line)):
            break
        at = m.end() if m else bound
    return stop


def _blank_body(body: str) -> str:
    """A mark over every line of a key. A last line of one byte (xx==) stays."""
    out, at = [], 0
    while at <= len(body):
        m = LINE_END.search(body, at)
        line = body[at : m.start()] if m else body[at:]
        shape = BODY_LINE.match(line)
        if shape and not re.fullmatch(r"[^=]{2}==", shape.group("run")):
            line = shape.group("lead") + MARK + shape.group("tail")
        elif not shape:
            line = re.sub(r"[A-Za-z0-9+/=]{8,}", MARK, line)
        out += [line, m.group() if m else ""]
        if not m:
            break
        at = m.end()
    return "".join(out)


def _key_start(text: str, at: int) -> int:
    """Start of the name, with its quote, that holds a place."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_$.-"):
        at -= 1
    while at < len(text) and text[at] in ".-" or (at < len(text) and text[at].isdigit()):
        at += 1
    return at - 1 if at and text[at - 1] in "\"'`@:" else at


def _places(low: str, word: str) -> Iterator[int]:
    at = low.find(word)
    while at >= 0:
        yield at
        at = low.find(word, at + 1)


def _generic_keys(text: str, low: str) -> Iterator[int]:
    """Starts, with their quotes, of names such as value that take their meaning from the block they stand in."""
    if len(low) != len(text):
        yield from (m.start() for m in GENERIC_KEY.finditer(text))
        return
    for word in GENERIC:
        for at in _places(low, word):
            if GENERIC_KEY.match(text, at):
                yield at - 1 if at and text[at - 1] in "\"'" else at


def _mixed(v: str) -> bool:
    """Whether a bare word looks like a password rather than a word of prose."""
    return bool(re.search(r"\d", v)) or bool(re.search(r"[^\w.,:/-]", v)) or v.count("-") >= 2 or bool(re.search(r"[a-z][A-Z]", v))


class _Outer:
    """Names of the blocks around places asked for in order: braces, and indented blocks under a line that ends in a colon."""

    TOKEN = re.compile(r"(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|[{}]|\n(?P<indent>[ \t]*)(?=[^\s])|(?P<colon>:[ \t]*\r?(?=\n))|<(?P<close>/?)(?P<tag>[A-Za-z_][\w.-]*)>")
    NAME = re.compile(r"(?:[\"']?([A-Za-z_][\w.-]*)[\"']?\s*(?:=>|[:=])|[\"']([A-Za-z_][\w.-]*)[\"'])\s*$")

    def __init__(self, text: str) -> None:
        self.text, self.passed, self.deep = text, 0, 0
        self.tokens = self.TOKEN.finditer(text)
        self.waiting = None
        self.closed = set(re.findall(r"</([\w.-]+)>", text))
        self.stack: list[tuple[str, int, str]] = []  # kind, indentation, name

    def at(self, place: int) -> list[str]:
        while (m := self.waiting or next(self.tokens, None)) and m.start() < place:
            self.waiting = None
            self._take(m)
        self.waiting = m
        return [name for _, _, name in self.stack if name]

    def _take(self, m: re.Match) -> None:
        kind = m.group()[:1]
        if m.group("string"):
            return
        if kind == "\n":
            self.deep = len(m.group("indent"))
            while self.stack and self.stack[-1][0] == ":" and self.stack[-1][1] >= self.deep:
                self.stack.pop()
        elif kind == "}":
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "{":
                    del self.stack[i:]
                    break
        elif m.group("tag"):
            if not m.group("close") and m.group("tag") in self.closed:
                self.stack.append(("<", 0, m.group("tag")))
            elif any(k == "<" and n == m.group("tag") for k, _, n in self.stack):
                while self.stack.pop()[2] != m.group("tag"):
                    pass
        else:
            end = m.start() + (kind == ":")
            name = self.NAME.search(self.text[max(0, end - 200) : end].rpartition("\n")[2])
            self.stack.append((kind, self.deep, (name.group(1) or name.group(2)) if name else ""))


def redact(text: str | None) -> str | None:
    """The text with every credential replaced by MARK, spliced into its bytes; the bodies of private keys line by line."""
    if not text:
        return text
    found = scan(text)
    if not found:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    parts, last_char, last_byte = [], 0, 0
    for f in found:
        start = last_byte + len(text[last_char : f.start].encode("utf-8", "surrogatepass"))
        end = start + len(text[f.start : f.end].encode("utf-8", "surrogatepass"))
        parts += [raw[last_byte:start], _blank_body(text[f.start : f.end]).encode("utf-8", "surrogatepass") if f.kind == "private_key" else f'"{MARK}"'.encode() if f.kind == "number" else MARK.encode()]
        last_char, last_byte = f.end, end
    return b"".join([*parts, raw[last_byte:]]).decode("utf-8", "surrogatepass")


def find_credentials(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 1), byte_start, byte_end (from 0), kind, path: one row for each credential."""
    files = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = files.schema["id"].dataType.simpleString()
    names = ["id", "line", "byte_start", "byte_end", "kind", "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                for f in scan(text):
                    if f.line:
                        start = len(text[: f.start].encode("utf-8", "surrogatepass"))
                        rows.append((f.line, start, start + len(text[f.start : f.end].encode("utf-8", "surrogatepass")), f.kind, f.path))
                        at.append(i)
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, types)], names)

    return map_arrow(spread(files), run, f"id {id_type}, line int, byte_start long, byte_end long, kind string, path string")


def redact_files(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text: every row, with its credentials replaced."""
    files = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = files.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([redact(t) for t in batch.column("text").to_pylist()], pa.string())], ["id", "text"])

    return map_arrow(spread(files), run, f"id {id_type}, text string")
