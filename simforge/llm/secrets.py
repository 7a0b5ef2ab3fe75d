"""Secret scans: base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer walks statements such as ``name = "literal"``, ``name: literal``,
``name => literal`` and ``export NAME=literal``, line by line, and forms that may
go over lines: ``<name>literal</name>``, ``--name literal``, literals in brackets,
below the name, or joined by a sign at a line's end, texts between three quotes,
indented blocks, targets in brackets, and literals in braces or indented below a
name, whose name is then both. It keeps the constants of a text by name, so that
``a = "..."`` followed by ``password = a`` and ``"..." + a`` leads to the literal
that the sensitive name gets. A literal is reported if the score of its target's
name and of its own shape reaches the threshold.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, freed, small_batches, texts

KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINT = re.compile(r"(?i)passw|secret|token|api_?key")
#: What a sensitive name scores, by the words that it ends with.
NAME_PARTS = {
    "password": 4, "passwd": 4, "passphrase": 4, "passcode": 3, "pass": 3, "pwd": 3, "secret": 4, "token": 3, "apikey": 4, "privatekey": 4, "accesskey": 4, "credential": 3, "auth": 2, "authorization": 2,
    "clientkey": 3, "signingkey": 4, "encryptionkey": 4, "secretkey": 4, "bearer": 3,
}
#: Parts that a word in one piece may end with, such as dbpassword.
ENDINGS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "privatekey", "accesskey", "secretkey", "signingkey", "encryptionkey", "sshkey", "credential")
#: Words after the one that says what a thing is.
QUALIFIERS = frozenset("value val str string text plain plaintext raw b64 base64 hex encoded prod production dev development staging stage test testing live old new current backup main default admin root user env var literal".split())
#: Keys that open nothing.
HARMLESS_KEYS = frozenset(
    "primary foreign public sort partition cache row hash index unique order group join lookup map dict object natural composite candidate super translation message locale routing shard distribution cluster column field property json config settings registry enter shift ctrl control alt tab arrow escape hot function keyboard answer legend route feature item data node tree min max first last next prev previous start end left right any each this that the no".split()
)
WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A quick look for any name that scores, with what names may hold between its characters: texts without one need no lexer.
NAMED = re.compile("(?ai)" + "|".join(r"[_$.:-]*+".join(part) for part in ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")))
#: Values that tell where a secret is, or who has it: addresses, paths, names of files, and numbers.
ELSEWHERE = re.compile(
    r"""(?ax)^(?:
      [\w.+-]+@[\w-]+(?:\.[\w-]+)+
    | [A-Za-z][A-Za-z0-9+.-]*://[^@\s]*
    | (?:~|\.{1,2})?(?:/[A-Za-z_][A-Za-z_.-]*)+/?
    | [\w./-]+\.(?:json|ya?ml|txt|pem|key|crt|cer|pub|py|js|ts|java|go|rs|html?|xml|csv|md|cfg|conf|ini|toml|log|so|dll|jar|sh|env|model|bin)
    | [+-]?[0-9][0-9_,]{0,15}(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,3})?
    )$"""
)
#: A name of something else, where a value has no quotes.
REFERENCE = re.compile(r"(?a)^[A-Za-z_$][A-Za-z_$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)+$")
TOKEN = re.compile(
    r"""(?ax)
    (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<arrow>=>|:=|\?=|==|!=|<=|>=)
  | (?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)
  | (?P<number>[0-9][A-Za-z0-9_.]*)
  | (?P<space>[\x20\t]+)
  | (?P<other>.)
    """
)
#: What follows a target in configuration, unquoted, up to white space or a delimiter.
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{6,}")
#: An element with text alone. No try goes beyond the next "<" (of CDATA, the next CDATA), so that all tries together are linear.
ELEMENT = re.compile(r"(?a)<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[((?:[^\]<]|\](?!\]>)|<(?!!\[CDATA\[))*+)\]\]>|([^<]*+))\s*</\1\s*>")
#: A flag and the argument after it, on the command line or as items of a list.
FLAG = re.compile(
    r"""(?ax)
    (?<![A-Za-z0-9_-])--(?P<name>[A-Za-z][\w.-]*+)
    (?: (?:[\x20\t]|\\\r?\n)+ (?: (?P<quoted>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+') | (?P<bare>(?!-)[A-Za-z0-9+/_.=~!@#$%^&*{}-]{2,}) )
      | ["']\s*+,\s*+ (?: (?P<item>"(?!-)(?:[^"\\\n]|\\.)*+"|'(?!-)(?:[^'\\\n]|\\.)*+') | (?P<ref>[A-Za-z_$][A-Za-z0-9_$]*+)(?=\s*+[],)]) ) )
    """
)
_STRING = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
_TARGET = r"""(?<![\w$.-])(?P<q>["']?)(?P<name>[A-Za-z_$][\w$.-]*+)(?P=q)[\x20\t]*+(?:=>|:=|\?=|=(?!=)|:(?!:))[\x20\t]*+"""
#: Literals that a target gets in brackets, below it, or joined over lines.
CONTINUED = re.compile(
    rf"""(?a){_TARGET}(?:[(\[]\s*+(?P<inside>(?:{_STRING}[\s+.\\]*+)++)|(?P<below>\\?\r?\n\s*+{_STRING}(?:[\x20\t]*+[+.]\s*+{_STRING})*+)|(?P<joined>{_STRING}(?:[\x20\t]*+(?:[+.][\x20\t]*+\\?|\\)\r?\n\s*+{_STRING})++))"""
)
STRING = re.compile(_STRING)
#: A text between three quotes, and a block of indented lines after | or >.
QUOTED = re.compile(rf"""(?a){_TARGET}[rbuRBU]?(?:\"\"\"(?P<double>(?:[^"\\]|\\.|"(?!""))*+)\"\"\"|\'\'\'(?P<single>(?:[^'\\]|\\.|'(?!''))*+)\'\'\')""", re.S)
BLOCK = re.compile(r"(?am)^[\x20\t-]*+(?P<name>[A-Za-z_][\w.-]*+)[\x20\t]*+:[\x20\t]*+[|>][+-]?[\x20\t]*+\r?\n(?P<lines>(?:[\x20\t]++[^\s][^\n]*+(?:\n|\Z))++)")
#: A target in brackets: os.environ["NAME"] = "literal".
SUBSCRIPT = re.compile(rf"""(?a)\[[\x20\t]*+["'](?P<name>[A-Za-z_][\w.-]*+)["'][\x20\t]*+\][\x20\t]*+=(?!=)[\x20\t]*+(?P<value>{_STRING})""")
#: Names and literals in braces below a name, and a name whose values are indented below it.
NESTED = re.compile(r"""(?a)(?<![\w$.-])["']?(?P<name>[A-Za-z_$][\w$.-]*+)["']?\s*+(?::|=>?)\s*+\{(?P<body>[^{}]*+)\}""")
INNER = re.compile(rf"""(?a)(?<![\w$.-])["']?(?P<name>[A-Za-z_$][\w$.-]*+)["']?\s*+(?::|=>?)\s*+(?P<value>{_STRING})""")
HEAD = re.compile(r"(?a)[\x20\t]*+(?:-[\x20\t]++)?[\"']?(?P<name>[A-Za-z_][\w.-]*+)[\"']?[\x20\t]*+:[\x20\t\r]*+$")
PLACEHOLDER = re.compile(r"(?ai)^(?:x+|\*+|\.+|changeme|example|placeholder|none|null|true|false|your[_-].*|<.*>|\$\{?.*|%\(?.*)$")
PLAIN = re.compile(r"^[a-z]+$|^[A-Z][a-z]+$|^[0-9.]{1,8}$")


@functools.lru_cache(100_000)
def name_score(name: str) -> int:
    """By the words of a name, in any spelling, up to the one that says what is meant: a client_secret, an apiKey and a DB_PASS_PROD score, a tokenizer, a secretary, an authority, a token_url and a primary_key don't."""
    words = [w.lower() for w in WORDS.findall(name)]
    while len(words) > 1 and (words[-1] in QUALIFIERS or words[-1].isdigit()):
        words.pop()
    if not words:
        return 0
    best = 0
    for last in {words[-1], words[-1].removesuffix("s")}:
        joined = ""
        for w in (last, *reversed(words[:-1])):
            joined = w + joined
            best = max(best, NAME_PARTS.get(joined, 0))
            if len(joined) > 20:
                break
        if last.endswith(ENDINGS):
            best = max(best, 3)
    if not best and words[-1] in ("key", "keys") and len(words) > 1 and words[-2] not in HARMLESS_KEYS and len(words[-2]) > 1:
        best = 3
    return best


def value_score(value: str, counts: Counter | None = None) -> int:
    """Length, kinds of characters and entropy; below zero for placeholders, plain words, and what only tells where a secret is. counts: the characters of the whole value, if value is no more than its beginning and end."""
    n = len(value) if counts is None else sum(counts.values())
    if n < 6 or PLACEHOLDER.match(value):
        return -9
    if PLAIN.match(value) or ELSEWHERE.match(value):
        return -3
    counts = Counter(value) if counts is None else counts
    kinds = sum(any(re.match(c, x) for x in counts) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    return (n >= 12) + (kinds >= 2) + (entropy >= 3)


def lexed(line: str) -> list[tuple[str, str, int]]:
    return [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(line) if m.lastgroup != "space"]


def pairs(line: str) -> Iterator[tuple[str, list[tuple[str, str, int]], int]]:
    """(target name, the tokens of its value, where the value starts) of each assignment on a line."""
    tokens = lexed(line)
    i, n = 0, len(tokens)
    while i + 1 < n:
        kind, text, at = tokens[i]
        target = text if kind == "name" else text[1:-1] if kind == "string" and re.fullmatch(r"(?a)[A-Za-z_][\w.-]*", text[1:-1]) else None
        op = tokens[i + 1][1]
        if target and op in ("=", ":", "=>", ":=", "?="):
            j = i + 2
            # `name: type = value` assigns to the name, not to its type
            if op == ":" and j + 1 < n and tokens[j][0] == "name" and tokens[j + 1][1] == "=":
                j += 2
            k = j
            while k < n and tokens[k][1] not in (",", ";", "}", ")", "]", "#") and not (k > j and tokens[k - 1][1] != "+" and tokens[k][1] != "+"):
                k += 1
            if k > j:
                yield target, tokens[j:k], tokens[j][2]
            i = max(k, i + 1)
        else:
            i += 1


#: Characters of a joined value that are put together; of a longer one, which doubling makes of any length, they are counted.
JOINED = 4096


def spread(parts: list) -> tuple[list[tuple[str, int, int]], int]:
    """The different literals of parts, which are literals and lists of parts, and the score of the value that they make, each literal as often as it stands there."""
    met: set = set()
    order: list = []
    todo: list = [(parts, False)]
    while todo:
        x, done = todo.pop()
        if done:
            order.append(x)
        elif id(x) not in met:
            met.add(id(x))
            todo.append((x, True))
            todo += [(y, False) for y in reversed(x) if isinstance(y, list)]
    # How often each list stands in the whole, from the whole down.
    times: dict = Counter({id(parts): 1})
    literals: dict = Counter()
    for x in reversed(order):
        for y in x:
            if isinstance(y, list):
                times[id(y)] += times[id(x)]
            else:
                literals[y] += times[id(x)]
    # The length of each list's value, and the last piece of it.
    size: dict = {}
    end: dict = {}
    for x in order:
        of = [(size[id(y)], end[id(y)]) if isinstance(y, list) else (len(y[0]), y[0]) for y in x]
        size[id(x)] = sum(n for n, _ in of)
        end[id(x)] = next((e for n, e in reversed(of) if n), "")
    found = list(dict.fromkeys(sorted((y for x in order for y in x if not isinstance(y, list)), key=lambda y: y[1:])))
    text, left, todo = [], JOINED, [parts]
    while todo and left > 0:
        x = todo.pop()
        if isinstance(x, list):
            todo += [y for y in reversed(x) if not isinstance(y, list) or size[id(y)]]
        else:
            text.append(x[0])
            left -= len(x[0])
    if size[id(parts)] <= JOINED:
        return found, value_score("".join(text))
    counts: Counter = Counter()
    for y, k in literals.items():
        for c, n in Counter(y[0]).items():
            counts[c] += n * k
    return found, value_score("".join(text)[:JOINED] + end[id(parts)], counts)


def named_spans(text: str, threshold: int = 5) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names are given, directly or by way of constants."""
    if not NAMED.search(text):
        return []
    # Of each constant its literals and the lists of the constants it is built of: chains share them.
    constants: dict[str, list] = {}
    found: set[tuple[int, int]] = set()

    def given(target: str, parts: list) -> None:
        score = name_score(target)
        if score < 2:
            return
        literals, value = spread(parts)
        if score + value >= threshold:
            found.update((a, b) for _, a, b in literals if b > a)

    for m in ELEMENT.finditer(text) if "</" in text else ():
        k = 2 if m.group(2) is not None else 3
        value = m.group(k).strip()
        at = m.start(k) + m.group(k).find(value)
        if name_score(m.group(1)) > 2 or not re.search(r"\s", value):
            given(m.group(1), [(value, at, at + len(value))])
    for m in CONTINUED.finditer(text):
        at = m.start(m.lastgroup)
        given(m.group("name"), [(x.group()[1:-1], at + x.start() + 1, at + x.end() - 1) for x in STRING.finditer(m.group(m.lastgroup))])
    for m in QUOTED.finditer(text) if '"""' in text or "'''" in text else ():
        value = m.group(m.lastgroup).strip()
        at = m.start(m.lastgroup) + m.group(m.lastgroup).find(value)
        if not re.search(r"[\x20\t]", value):
            given(m.group("name"), [(value, at, at + len(value))])
    for m in BLOCK.finditer(text) if "|" in text or ">" in text else ():
        rows = [(x.group(), m.start("lines") + x.start(), m.start("lines") + x.end()) for x in re.finditer(r"\S[^\n]*\S|\S", m.group("lines"))]
        if not any(re.search(r"\s", x[0]) for x in rows):
            given(m.group("name"), rows)
    for m in SUBSCRIPT.finditer(text) if "]" in text else ():
        given(m.group("name"), [(m.group("value")[1:-1], m.start("value") + 1, m.end("value") - 1)])
    for m in NESTED.finditer(text) if "{" in text else ():
        for x in INNER.finditer(m.group("body")):
            at = m.start("body") + x.start("value")
            given(f"{m.group('name')}_{x.group('name')}", [(x.group("value")[1:-1], at + 1, at + len(x.group("value")) - 1)])
    flags = list(FLAG.finditer(text))[::-1] if "--" in text else []
    start = 0
    # Names that head what is indented below them.
    heads: list[tuple[int, str]] = []
    for line in text.split("\n"):
        if ("=" in line or ":" in line) and line.strip():
            depth = len(line) - len(line.lstrip(" \t"))
            while heads and heads[-1][0] >= depth:
                heads.pop()
            head = HEAD.match(line)
            if head:
                heads.append((depth, head.group("name")))
            for target, value, at in pairs(line):
                literals: list = []
                for kind, tok, pos in value:
                    if kind == "string":
                        literals.append((tok[1:-1], start + pos + 1, start + pos + len(tok) - 1))
                    elif kind == "name" and tok in constants:
                        literals.append(constants[tok])
                if not literals and value[0][0] in ("name", "number", "other"):
                    m = BARE.match(line, at)
                    # What goes on with a bracket is a call or a place in something; a name with dots is a name.
                    if m and line[m.end() : m.end() + 1] not in ("(", "[") and not REFERENCE.match(m.group()):
                        literals = [(m.group(), start + m.start(), start + m.end())]
                if not literals:
                    continue
                given(target, literals)
                if heads:
                    given(f"{heads[-1][1]}_{target}", literals)
                constants[target] = literals
        start += len(line) + 1
        while flags and flags[-1].start() < start:
            m = flags.pop()
            k = m.lastgroup
            cut = k in ("quoted", "item")
            value, at = m.group(k)[cut : len(m.group(k)) - cut], m.start(k) + cut
            known = constants.get(value.strip("${}"))
            if known or k != "ref" and (cut or BARE.fullmatch(value)):
                given(m.group("name"), known or [(value, at, at + len(value))])
    return sorted(found)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of each span, in code points, sorted."""
    out = []
    if HINT.search(text):
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= 6:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(a, 3, b) for a, b in named_spans(text)]
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs, made where the row lies, without a shuffle.

    A null or empty text has no spans. Rows with equal texts get equal results. Base
    spans and named spans may overlap. Texts without a sensitive name skip the lexer.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [secret_spans(t) for t in b.column(1).to_pylist()]
            base = [[s for s in r if s[1] < 3] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in range(3)], pa.array([hashlib.sha256(listed(r).encode()).hexdigest() for r in base]), pa.array([listed(r) for r in rows], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return texts(docs).mapInArrow(freed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, mask: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced; of an assignment, its value alone."""
    spans = []
    for a, k, b in secret_spans(text):
        spans.append((ASSIGN.match(text, a).start(2), b) if k == 0 else (a, b))
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and n_chars following; every document stays, rows without a secret unchanged."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [None if t is None else redacted(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([n if t == u else len(u) for t, u, n in zip(old, new, columns[count].to_pylist())], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(freed(run), docs.schema)


def op8_secret_scans(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir))
