"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, URL schemes and identifier cues. A
deterministic parser for each anchor then expands to the left and right and validates what it found. Numbers without an
anchor of their own (IP addresses, cards, phones) come from linear-time patterns.

Base kinds (always kept): email, ip, card, phone. Kinds that the method adds: `login` (user and password between a
scheme and its host), `account` (the value that follows a cue such as "iban", "passport no." or "password=").
Spans are (kind, start, end) in code points, end exclusive. Null or empty text has none. All work is linear in the
text: no pattern backtracks over a run of digits or letters, so a very long text or word costs no more than its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm.common import map_rows, schema_of, str_texts, values

KINDS = ("email", "ip", "card", "phone", "login", "account")
BASE_KINDS = KINDS[:4]
#: Identifier cues, lower case; a cue counts only as a whole word.
CUES = (
    "iban", "ssn", "passport", "passwort", "password", "passwd", "pwd", "account", "acct", "konto", "kontonummer", "cuenta", "compte",
    "token", "secret", "api_key", "apikey", "api-key", "access_key", "username", "user_id", "userid", "login", "license no", "licence no", "tax id",
)
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "smtp://", "postgres://", "mysql://", "redis://")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:\"'<>]{1,256}:[^\s/?#@\"'<>]{1,256}@(?=[A-Za-z0-9\[])")
#: What may stand between a cue and its value, then the value; a value needs a digit and six characters.
VALUE = re.compile(r"(?:\s?(?:no|nr|number|id|code|is)\b\.?)?\s{0,2}[:=#]\s{0,2}[\"']?([A-Za-z0-9](?:[A-Za-z0-9_+/.-]*[A-Za-z0-9=])?)")
IBAN = re.compile(r"[:=#]?\s{0,2}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")
NON_DIGITS = re.compile(r"[^0-9]+")


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    made.add_word("@", ("@", 1))
    for s in SCHEMES:
        made.add_word(s, ("scheme", len(s)))
    for c in CUES:
        made.add_word(c, ("cue", len(c)))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    flat = value.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expand_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around text[at] == '@' that begins at or after floor: the longest run of local characters before it."""
    start, step = at, 64
    while start > floor:  # in blocks, so a long run costs its length once
        low = max(floor, start - step)
        if not (m := LOCAL_END.search(text, low, start)):
            break
        start = m.start()
        if start > low:
            break
        step *= 2
    m = DOMAIN.match(text, at + 1) if start < at else None
    return (start, m.end()) if m else None


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind as listed."""
    out: list[tuple[str, int, int]] = []
    email_end = 0
    lower = text.translate(LOWER) if not text.isascii() else text.lower()
    for end, (kind, size) in anchors.iter(lower):
        start, end = end + 1 - size, end + 1
        if kind == "@":
            if start >= email_end and (span := expand_email(text, start, email_end)):
                out.append(("email", *span))
                email_end = span[1]
        elif kind == "scheme":
            if m := LOGIN.match(text, end):
                out.append(("login", end, m.end() - 1))
        elif not (start and (text[start - 1].isalnum() or text[start - 1] == "_")) and not (end < len(text) and (text[end].isalnum() or text[end] == "_")):
            out += [("account", *span) for span in [account(text, end, lower[start:end])] if span]
    if has_digit(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := NON_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NON_DIGITS.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    accounts = [s for s in dict.fromkeys(out) if s[0] == "account"]
    out = [s for s in dict.fromkeys(out) if s[0] != "account"]
    taken = sorted((s, e) for _, s, e in out)
    starts = [s for s, _ in taken]
    reach: list[int] = []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))
    for span in accounts:  # a value that is already an email, a card and so on isn't named again
        i = bisect_right(starts, span[2] - 1)
        if not i or reach[i - 1] <= span[1]:
            out.append(span)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def has_digit(text: str, found=re.compile(r"[0-9]").search) -> bool:
    return found(text) is not None


def account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier whose cue ends at text[at - 1]."""
    if cue == "iban" and (m := IBAN.match(text, at)) and iban_ok(m[1]):
        return m.span(1)
    m = VALUE.match(text, at)
    if m and m.end(1) - m.start(1) >= 6 and has_digit(m[1]):
        return m.span(1)
    return None


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every document; one pass, no shuffle."""
    schema = T.StructType([docs.schema[id_column], T.StructField("spans", SPAN)])

    def make():
        anchors = automaton()

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = [find(t, anchors) for t in str_texts(batch, text_column)]
            return {id_column: values(batch, id_column), "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]}

        return step

    return map_rows(docs, [id_column, text_column], make, schema)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span becomes <KIND>; of overlapping ones the first, and the longest of those that start together, names the whole."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with every span of the text replaced; null stays null; other columns, whatever their names, are carried."""
    own = docs.columns
    packed = docs.toDF(*[f"c{i}" for i in range(len(own))])
    mine = f"c{own.index(text_column)}"
    done = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])

    def make():
        anchors = automaton()

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [t if t is None else redact_text(t, find(t, anchors)) for t in values(batch, mine)]
            return {f.name: texts if f.name == mine else values(batch, f.name) for f in batch.schema}

        return step

    return map_rows(packed, packed.columns, make, done).toDF(*own)


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, the hash of their spans, and all spans."""
    schema = schema_of("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_login bigint, n_account bigint")
    schema = T.StructType([docs.schema["doc_id"], *schema])

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            found = [[(x["kind"], x["start"], x["end"]) for x in spans] for spans in values(batch, "spans")]
            base = [[s for s in x if s[0] in BASE_KINDS] for x in found]
            counts = {f"n_{k}": [sum(s[0] == k for s in x) for x in found] for k in KINDS}
            return {"doc_id": values(batch, "doc_id"), **counts, "base_sha256": [hashlib.sha256(digest(x).encode()).hexdigest() for x in base], "spans": [digest(x) for x in found]}

        return step

    return map_rows(detect(docs), ["doc_id", "spans"], make, schema)
