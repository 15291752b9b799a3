"""Secret scans by assignment-aware lexing.

Two passes over a text. The first finds fixed shapes: a sensitive word assigned a value, access keys, long hexadecimal
runs. The second reads source and configuration syntax into pairs of a name and a value: ``name = "literal"``, ``"name": 'literal'``,
``name := literal``, ``name => literal``, ``NAME=bare``, ``table["name"] = ...``, ``a, b = ..., ...``, ``<name>text</name>``, and blocks
after ``name: |``. A value is made of literals, names and bare words: joined by ``+``, side by side, by ``"".join([...])``, put into ``f"{...}"``
or `${...}`, within brackets, as arguments of a call or as one of several alternatives. The name of a called function is never a
value, nor is the key that something is looked up by. Literals and names may have any length; brackets nest up to DEPTH deep.

A table of the whole text's names, dotted or not, carries literals on to where they are used, before or after the line that
assigns them: the last assignment before a use, else the first one after it. Parts are judged as the whole they make. A literal is a secret when
the best sensitive name it reaches and the look of the best whole it is in score SECRET or more.

Offsets count code points, ends are exclusive. Defined results: null and empty texts have no spans; equal spans of one
kind are listed once; a name assigned to itself, in a circle too, stands for nothing there. Repeated rows and null ids are rows like any
other; an empty table gives none. Texts are read whole, in time linear in their length (times DEPTH at worst).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docnest.llm.frames import mapped

# Fixed patterns of the base scan. The third value is the least length, the fourth the group that has it.
KINDS = ("assign", "access", "hex", "literal")
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
)
#: What a text must hold before a pattern is run over it; lower case.
_HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",)}
_NOT_HEX = bytes(32 if chr(c) not in "0123456789abcdef" else 120 for c in range(256))

#: Sensitive parts of names and their scores.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "secrets": 3, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "authkey": 3,
    "signature": 1, "auth": 2, "bearer": 2, "salt": 2, "pass": 2, "key": 1, "private": 1, "access": 1, "api": 1, "encryption": 1, "signing": 1,
}
SECRET = 5
_PLACEHOLDER = re.compile(r"^(?:change_?me.*|your[_-].*|example.*|placeholder|none|null|true|false|undefined|x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$", re.I)

# Possessive, so that a name or literal of any length is read once and never given back. A bare name starts at the first part of a
# run such as --a.b that starts like one.
_BARE_NAME = r"""(?<![\w.\-$])[.\-]*+(?:[^\WA-Za-z_][\w$]*+[.\-]++)*+(?P<bare>[A-Za-z_$][\w.\-$]*+)"""
_QUOTED = r""""[\w.\- ]++"|'[\w.\- ]++'"""
_ASSIGNED = re.compile(
    rf"""(?:(?<=[\w$)\]])\[[ \t]*+(?P<held>{_QUOTED})[ \t]*+\]|(?<![\w$])(?P<quoted>{_QUOTED})|{_BARE_NAME})[ \t]*+"""
    r"""(?::[ \t]{0,4}[A-Za-z_][\w.\[\], ]{0,40}?[ \t]{0,4}(?==))?(?::=|=>|=(?!=)|:(?!:|//))[ \t]*+"""
    r"""|<(?P<element>[A-Za-z_][\w.\-]*+)(?:[ \t][^<>]*+)?>[ \t]*+(?=[^<>\s])"""
)
#: Names before the one next to the sign, of an assignment of several at once.
_FORMER = re.compile(r"(?:[A-Za-z_$][\w.$]{0,200}[ \t]{0,4},[ \t]{0,4}){1,20}$")
_STRING = re.compile(
    r"""(?P<prefix>[rRbBuUfF]{0,2})(?:\"\"\"(?P<lines2>[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+)\"\"\"|\'\'\'(?P<lines1>[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+)\'\'\'"""
    r"""|`(?P<tick>[^`\\]*+(?:\\.[^`\\]*+)*+)`|"(?P<two>[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+)"|'(?P<one>[^'\\\n]*+(?:\\[^\n][^'\\\n]*+)*+)')""",
    re.S,
)
_BARE = re.compile(r"""[^\s"'`;,(){}\[\]<>]++""")
_CALLED = re.compile(r"[A-Za-z_$][\w.$]*+(?=[(\[])")
_JOIN = re.compile(r"""[ \t]*+\+(?!=)\s*+|\s*\n[ \t]+\+[ \t]*(?=["'`])""")
_OR = re.compile(r"""[ \t]*+(?:\|\||\?\?|or\b)[ \t]*+""")
_BESIDE = re.compile(r"""[ \t]*+(?=["'])""")
_BESIDE_INSIDE = re.compile(r"""\s*+(?=["'])""")
_JOINED_LIST = re.compile(r"\.join\(\s*+(?=[(\[])")
_BLOCK = re.compile(r"[|>][-+0-9]*+[ \t]*+(?:\#[^\n]*+)?\n")
_ANCHOR = re.compile(r"&[\w.\-]++[ \t]++")
_PUT_IN = re.compile(r"\$?\{[ \t]*+([A-Za-z_$][\w.$]*+)")
#: Functions that look something up: their first argument is its key.
_LOOKUP = re.compile(r"(?:get|getenv|env|environ|pop|setdefault|lookup|fetch|find|config|setting|settings|header|headers|param|params|option)$", re.I)
_BRACKETS = re.compile(r""""[^"\n]*+"|'[^'\n]*+'|[()\[\]{}]""")
_PARTNER = {")": "(", "]": "[", "}": "{"}
_COMMA = re.compile(r"[ \t]*+,[ \t]*+")
_OPENS = re.compile(r"[(\[{\n]")
_OTHER = re.compile(r"""[^\s,(){}\[\]"'`]++|.""", re.S)
_NAME = re.compile(r"[A-Za-z_$][\w.$]*+")
_NAMED = re.compile(r"[*$]?\{?([A-Za-z_$][\w.\-$]*+)\}?")
#: How deep brackets may nest to be followed; what is inside of deeper ones is still read assignment by assignment.
DEPTH = 20


def _followed(text: str) -> dict[int, int]:
    """Place of the partner of every bracket that has one and holds at most DEPTH levels of others: so no place is in more than DEPTH of them."""
    found: dict[int, int] = {}
    stack: list[list] = []
    for m in _BRACKETS.finditer(text):
        c = m[0]
        if c in "([{":
            stack.append([c, m.start(), 0])
        elif len(c) == 1 and stack and stack[-1][0] == _PARTNER[c]:
            _, start, height = stack.pop()
            if height < DEPTH:
                found[start] = m.start()
            if stack:
                stack[-1][2] = max(stack[-1][2], height + 1)
    return found
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed shapes, by kind."""
    found: list[Span] = []
    low = text.lower()
    for kind, pattern, least, group in BASE:
        if kind in _HINTS and not any(h in low for h in _HINTS[kind]):
            continue
        if kind == "hex" and b"x" * least not in text.encode("utf-8", "replace").translate(_NOT_HEX):
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def name_score(name: str) -> int:
    """How sensitive a name is: its best part, or the sum of two weak neighbours such as access and key."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [SENSITIVE.get(a, 0) + SENSITIVE.get(b, 0) for a, b in zip(parts, parts[1:], strict=False)]
    return min(3, max([0, *pairs, *(SENSITIVE.get(p, 0) for p in parts), *(SENSITIVE.get(a + b, 0) for a, b in zip(parts, parts[1:], strict=False))]))


#: No placeholder made by joining is longer.
LONGEST_TEXT = 4096


class Value:
    """A literal of the text (no parts), or values joined. A join keeps its text up to LONGEST_TEXT characters, and of any length the
    counts of its characters, so joins of joins cost no more than they have parts."""

    __slots__ = ("start", "end", "parts", "text", "counts", "pem", "reached")

    def __init__(self, start: int, end: int, text: str | None, parts: list[Value]):
        self.start, self.end, self.text, self.parts, self.reached = start, end, text, parts, 0
        self.pem = text is not None and bool(_PEM.search(text))
        self.counts = Counter(text or "")

    def made_of(self, parts: list[Value]) -> None:
        """A join of values that are complete themselves."""
        self.parts = parts
        self.pem = any(p.pem for p in parts)
        self.counts = Counter()
        for p in parts:
            self.counts.update(p.counts)
        if self.counts.total() > 1 << 60:  # joins doubled again and again: only the shares matter
            self.counts = Counter({c: max(1, n >> 30) for c, n in self.counts.items()})
        known = all(p.text is not None for p in parts) and sum(len(p.text) for p in parts) <= LONGEST_TEXT
        self.text = "".join(p.text for p in parts) if known else None


def value_score(value: Value) -> int:
    """How much a value looks like a secret: length, mixed characters, no prose unless a key block, no placeholder."""
    counts, total = value.counts, value.counts.total()
    if total < 8 or value.text is not None and _PLACEHOLDER.match(value.text) or not value.pem and any(c.isspace() for c in counts):
        return 0
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    chars = "".join(counts)
    classes = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 1 + (classes >= 2) + (entropy >= 3.0)


class _Reader:
    """Values of one text: literals, and wholes made of values or of names still to be found."""

    def __init__(self, text: str):
        self.text = text
        self.followed = _followed(text)
        self.literals: list[Value] = []
        self.wholes: list[tuple[Value, list]] = []  # what they are made of: values and (name, place)

    def literal(self, start: int, end: int, told: str | None = None) -> Value:
        self.literals.append(Value(start, end, self.text[start:end] if told is None else told, []))
        return self.literals[-1]

    def whole(self, parts: list) -> Value:
        """One value of several; of one value, itself."""
        if len(parts) == 1 and isinstance(parts[0], Value):
            return parts[0]
        made = Value(0, 0, None, [])
        self.wholes.append((made, parts))
        return made

    def string(self, m: re.Match) -> Value:
        start, end = m.span(m.lastgroup)
        made = self.literal(start, end)
        if "{" in made.text and (m.lastgroup == "tick" or m["prefix"].lower().strip("rbu") or "${" in made.text):
            names = [([n], m.start()) for n in _PUT_IN.findall(made.text)]
            return self.whole([made, *names]) if names else made
        return made

    def block(self, start: int, line: int) -> tuple[Value | None, int]:
        """The indented lines after ``name: |``; ``line`` is where the name's line starts."""
        text = self.text
        indent = len(text[line:start]) - len(text[line:start].lstrip(" \t-"))
        at = first = last = start
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            row = text[at:end]
            if row.strip():
                if len(row) - len(row.lstrip(" \t")) <= indent:
                    break
                first = at + len(row) - len(row.lstrip(" \t")) if last == start else first
                last = at + len(row.rstrip())
            at = end + 1
        return (self.literal(first, last) if last > start else None), min(at, len(text))

    def bracket(self, at: int) -> tuple[list[Value], int]:
        """The values between a followed bracket at ``at`` and its partner, and the place after it."""
        text, out, last = self.text, [], self.followed[at]
        at += 1
        while at < last:
            if text[at].isspace() or text[at] == ",":
                at += 1
                continue
            found, after = self.value(at, True)
            out += found
            at = after if after > at else _OTHER.match(text, at).end()  # nothing a value starts with
        return out, max(at, last + 1)

    def term(self, at: int) -> tuple[list, int]:
        """Parts that start at a place - values, names (name, place), bare words (names in it, start, end) - and where they end."""
        text = self.text
        if m := _STRING.match(text, at):
            made, at = self.string(m), m.end()
            if (j := _JOINED_LIST.match(text, at)) and j.end() in self.followed:
                inner, at = self.bracket(j.end())
                between = [made] if made.text else []
                parts = [x for i, v in enumerate(inner) for x in ([*between, v] if i else [v])]
                return ([self.whole(parts)] if parts else []), at + (text[at : at + 1] == ")")
            return [made], at
        if text[at : at + 1] in ("(", "["):
            return self.bracket(at) if at in self.followed else ([], at)
        if m := _CALLED.match(text, at):
            if m.end() not in self.followed:
                return [], at
            inner, after = self.bracket(m.end())
            if text[m.end()] == "[":  # something looked up
                inner = []
            elif _LOOKUP.search(m[0]):
                inner = inner[1:]
            return [v for v in inner if self.strong(v)], after
        if m := _BARE.match(text, at):
            word, end = m[0], m.end()
            if word[-1] == "+" and len(word) > 1 and re.match(r"""[ \t]*["'`\w]""", text[end : end + 20]):
                word, end = word[:-1], end - 1
            bare = word.rstrip(".:")
            pieces = [w for w in word.split("+") if w]
            if not all(_NAME.fullmatch(w) for w in pieces):
                pieces = [n[1]] if (n := _NAMED.fullmatch(word)) else []
            return ([(pieces, at, at + len(bare))] if bare else []), end
        return [], at

    def strong(self, v: Value) -> bool:
        """Whether an argument is more than a word."""
        return v.text is None or any(c.isdigit() for c in v.text) or v.pem

    def value(self, at: int, inside: bool = False) -> tuple[list[Value], int]:
        """The alternatives that a value at a place has, each a whole; and where to read on. ``inside``: of a bracket."""
        text, out, stop = self.text, [], at
        parts: list = []
        while True:
            several = text[at : at + 1] in ("(", "[") or bool(_CALLED.match(text, at))
            found, end = self.term(at)
            if end == at:
                break
            if several and len(found) > 1:  # each of them is a value of its own
                out += found
            else:
                parts += found
            stop = end
            beside = (_BESIDE_INSIDE if inside else _BESIDE).match(text, stop)
            if beside and text[stop - 1] in "\"'`" and _STRING.match(text, beside.end()):
                at = beside.end()
            elif m := _JOIN.match(text, stop):
                at = m.end()
                if "\n" in m[0] and not inside and not _STRING.match(text, at):
                    word = _BARE.match(text, at)
                    if not word or text[word.end() : word.end() + 3].lstrip(" ")[:1] in ("=", ":") or "=" in word[0]:
                        break
            elif m := _OR.match(text, stop):
                out += [self.whole(_told(parts))] if parts else []
                parts, at = [], m.end()
            else:
                break
        if len(parts) > 1 or out:
            parts = _told(parts)
        return [*([self.whole(parts)] if parts else []), *out], stop


def _told(parts: list) -> list:
    """Parts of something more: bare words among them are names, or nothing."""
    return [p if isinstance(p, Value) else (p[0], p[1]) for p in parts]


def _linked_values(reader: _Reader, table: dict[str, list[tuple[int, Value]]]) -> list[Value]:
    """All values, parts before wholes; names become the values they stand for, or, alone and unknown, bare words."""
    made = {id(v): parts for v, parts in reader.wholes}

    def meaning(name: str, place: int) -> Value | None:
        found = table.get(name) or table.get(name.rsplit(".", 1)[-1])
        if not found:
            return None
        at = bisect.bisect_left(found, place, key=lambda f: f[0])
        return found[at - 1][1] if at else found[0][1]

    for v, parts in reader.wholes:
        resolved = []
        for p in parts:
            if isinstance(p, Value):
                resolved.append(p)
                continue
            known = [value for name in p[0] if (value := meaning(name, p[1])) is not None]
            if not known and len(p) == 3:  # a bare word of its own
                known = [reader.literal(p[1], p[2])]
            resolved += known
        made[id(v)] = v.parts = resolved
    order: list[Value] = []
    state: dict[int, int] = {}
    for root in [*reader.literals, *(v for v, _ in reader.wholes)]:
        stack = [(root, iter(root.parts))] if id(root) not in state else []
        state.setdefault(id(root), 1)
        while stack:
            v, rest = stack[-1]
            for p in rest:
                if id(p) not in state:
                    state[id(p)] = 1
                    stack.append((p, iter(p.parts)))
                    break
            else:
                stack.pop()
                state[id(v)] = 2
                order.append(v)
    place = {id(v): i for i, v in enumerate(order)}
    for v in order:  # a part that comes later is a circle
        v.parts = [p for p in v.parts if place[id(p)] < place[id(v)]]
        if id(v) in made:
            v.made_of(v.parts)
    return order


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    reader = _Reader(text)
    table: dict[str, list[tuple[int, Value]]] = {}
    named: list[tuple[str, Value]] = []
    at = 0

    def assign(name: str, place: int, values: list[Value]) -> None:
        if values:
            for key in {name, name.rsplit(".", 1)[-1]}:
                table.setdefault(key, []).append((place, values[0]))
            named.extend((name, v) for v in values)

    while m := _ASSIGNED.search(text, at):
        at = m.end()
        if name := m["element"]:
            end = text.find("<", at)
            if end > 0 and text.startswith(f"</{name}", end):
                assign(name, m.start(), [reader.literal(at, at + len(text[at:end].rstrip()))])
                at = end
            continue
        quoted = m["held"] or m["quoted"]
        name = quoted[1:-1] if quoted else m["bare"]
        line = text.rfind("\n", 0, m.start()) + 1
        if block := _BLOCK.match(text, at):
            value, at = reader.block(block.end(), line)
            assign(name, m.start(), [value] if value else [])
            continue
        if anchor := _ANCHOR.match(text, at):
            at = anchor.end()
            values, stop = reader.value(at)
            assign(anchor[0].strip(" \t&"), m.start(), values)
        else:
            values, stop = reader.value(at)
        before = _FORMER.search(text[max(line, m.start("bare") - 4000) : m.start("bare")]) if m["bare"] else None
        names = [*(n.strip() for n in before[0].split(",") if n.strip()), name] if before else [name]
        if len(names) > 1:
            each, end = [values], stop
            while len(each) < len(names) and (comma := _COMMA.match(text, end)):
                more, end = reader.value(comma.end())
                each.append(more)
            if len(each) == len(names):
                for n, v in zip(names, each, strict=True):
                    assign(n, m.start(), v)
                at = max(at, end)
                continue
        assign(name, m.start(), values)
        # assignments within brackets and blocks of text count as well
        inner = _OPENS.search(text, at, stop) if stop > at else None
        at = inner.start() if inner else max(at, stop)
    order = _linked_values(reader, table)
    for name, value in named:
        if (score := name_score(name)) and (looks := value_score(value)):
            value.reached = max(value.reached, score + looks)
    for value in reversed(order):
        for part in value.parts:
            part.reached = max(part.reached, value.reached)
    return [("literal", v.start, v.end) for v in reader.literals if v.end > v.start and v.reached >= SECRET]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def printed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered(spans))


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in ordered(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            counts = Counter(kind for kind, _, _ in base)
            digest = hashlib.sha256(printed(base).encode()).hexdigest()
            rows.append((counts["assign"], counts["access"], counts["hex"], digest, printed(base + literal_spans(text))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return mapped(asked, _scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        clean = [t and redacted(t, base_spans(t) + literal_spans(t)) for t in texts]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, batch.schema.field("text").type))


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by a mark; all rows and columns stay."""
    return mapped(docs, _cleaned, docs.schema)
