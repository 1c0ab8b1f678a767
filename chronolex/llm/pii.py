"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, URL schemes, bracketed "at"s, identifier and
credential cues, and how keys begin) in one pass; a deterministic parser then expands each anchor to its boundaries and
validates it. A credential needs a name, an assignment and a value that mixes letters and digits at random; keys with a
well-known beginning need only their own length and letters.

Defined results: a null or empty text has no spans. Positions are code points, ends exclusive. Rows are independent, so
ties and repeated rows give equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import cache
from math import log2

from pyspark.sql import DataFrame

from chronolex.llm.common import id_type, map_texts, texts

#: Base kinds in the order in which they are listed, then those that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("account", "login", "masked", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+")
USERINFO = re.compile(r"[^\s/@:<>\"']+:[^\s/@<>\"']+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
IBAN = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30})(?![A-Za-z0-9])")
SSN = re.compile(r"[\s:#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
MASKED_DOMAIN = re.compile(r"\s{0,2}([A-Za-z0-9-]+(?:\s{0,2}(?:\.|[\[(](?:dot|DOT)[\])])\s{0,2}[A-Za-z0-9-]+)+)")
#: What may stand between a credential's name and its value, and the values.
ASSIGNED = re.compile(r"[A-Za-z0-9_-]{0,16}[\"'`]?\s{0,3}(?:=>|:=|[=:])\s{0,3}(?:[Bb]earer\s{1,3})?[\"'`]?")
VALUE = re.compile(r"[A-Za-z0-9+/_.~=-]{16,}")
PASSWORD = re.compile(r"[^\s\"'`,;<>]{6,64}")
BEARER = re.compile(r"\s{1,3}([A-Za-z0-9+/_.~=-]{16,})")
# Beginnings of keys of public services, and what follows them.
KEYS = {
    "AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "AIza": "[A-Za-z0-9_-]{35}", "ghp_": "[A-Za-z0-9]{36,}", "gho_": "[A-Za-z0-9]{36,}", "ghs_": "[A-Za-z0-9]{36,}",
    "github_pat_": "[A-Za-z0-9_]{36,}", "glpat-": "[A-Za-z0-9_-]{20,}", "xoxb-": "[A-Za-z0-9-]{20,}", "xoxp-": "[A-Za-z0-9-]{20,}", "sk_live_": "[A-Za-z0-9]{16,}",
    "rk_live_": "[A-Za-z0-9]{16,}", "eyJ": r"[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
KEY_PATTERNS = {start: re.compile(f"{rest}(?![A-Za-z0-9])") for start, rest in KEYS.items()}
BLOCK = re.compile(r"[A-Z0-9 ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]*")
BLOCK_END = re.compile(r"-----END [A-Z0-9 ]{0,20}PRIVATE KEY-----")
SECRET_CUES = ("token", "secret", "api_key", "apikey", "api-key", "api key", "access_key", "access-key", "accesskey", "private_key", "auth_key", "credential", "signing_key", "encryption_key")
PASSWORD_CUES = ("password", "passwd", "passphrase", "pwd")
#: Bits of information that a letter of a key has at least.
LEAST_BITS = 3.0
SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, "digit")
    for cue, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("(at)", "masked"), ("[at]", "masked"), ("(AT)", "masked"), ("[AT]", "masked")):
        a.add_word(cue, kind)
    for cue in ("IBAN", "Iban", "iban"):
        a.add_word(cue, "iban")
    for cue in ("SSN", "ssn", "Social Security", "social security"):
        a.add_word(cue, "ssn")
    for cues, kind in ((SECRET_CUES, "secret"), (PASSWORD_CUES, "password"), (("bearer",), "bearer")):
        for cue in cues:
            for form in (cue, cue.capitalize(), cue.upper(), cue.title()):
                a.add_word(form, kind)
    for cue in KEYS:
        a.add_word(cue, f"key {cue}")
    a.add_word("-----BEGIN ", "block")
    a.make_automaton()
    return a


CHANGE = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")


def random_like(value: str) -> bool:
    """Letters and digits that change places at least twice, and as many bits of information a letter as random keys have."""
    n = len(value)
    return n >= 16 and len(CHANGE.findall(value)) >= 2 and -sum(k / n * log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def credential(text: str, at: int, kind: str) -> tuple[int, int] | None:
    """The span of the value that belongs to a credential cue which ends before `at`."""
    if kind == "bearer":
        m = BEARER.match(text, at)
        value = m[1].rstrip(".") if m else ""
        return (m.start(1), m.start(1) + len(value)) if random_like(value) else None
    assigned = ASSIGNED.match(text, at)
    if not assigned:
        return None
    m = (PASSWORD if kind == "password" else VALUE).match(text, assigned.end())
    if not m:
        return None
    value = m[0].rstrip(".")
    ok = any(c.isalpha() for c in value) and any(c.isdigit() for c in value) if kind == "password" else random_like(value)
    return (m.start(), m.start() + len(value)) if ok else None


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x *= 2
            x -= 9 * (x > 9)
        total += x
    return total % 10 == 0


def byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
    if not text:
        return found
    email_end = dotted_end = number_end = secret_end = 0
    block_end = BLOCK_END.match("-----END PRIVATE KEY-----")  # before the first letter: looked for when a block begins
    for last, kind in automaton().iter(text):
        if kind == "digit":
            if last >= dotted_end:
                m = DOTTED.match(text, last)
                dotted_end = m.end()
                if dotted_end - last > 6 and text.find(".", last, dotted_end) > 0:
                    parts, at = m.group().split("."), last
                    for k in range(0, len(parts) - 3, 4):
                        end = at + sum(map(len, parts[k : k + 4])) + 3
                        if all(map(byte_part, parts[k : k + 4])):
                            found["ip"].append((at, end))
                        at = end + 1
            if last >= number_end:
                m = NUMBER.match(text, last)
                number_end = m.end()
                if number_end - last >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((last, number_end))
        elif kind == "at":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found["email"].append((start, email_end))
        elif kind == "plus":
            if m := DIAL.match(text, last):
                end = last + len(m.group().rstrip(" ().-"))
                if end - last >= 4 and 9 <= sum(c.isdigit() for c in text[last:end]) <= 15:
                    found["phone"].append((last, end))
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) and mod97(m[1]):
                found["account"].append(m.span(1))
        elif kind == "ssn":
            if (m := SSN.match(text, last + 1)) and m[1][:3] not in ("000", "666") and m[1][0] != "9" and m[1][4:6] != "00" and m[1][7:] != "0000":
                found["account"].append(m.span(1))
        elif kind in ("secret", "password", "bearer"):
            if (span := credential(text, last + 1, kind)) and span[0] >= secret_end:
                found["secret"].append(span)
                secret_end = span[1]
        elif kind.startswith("key "):
            start = last + 1 - len(kind) + 4
            if start >= secret_end and not (start and text[start - 1].isalnum()) and (m := KEY_PATTERNS[kind[4:]].match(text, last + 1)):
                found["secret"].append((start, m.end()))
                secret_end = m.end()
        elif kind == "block":
            if block_end is not None and block_end.start() <= last:
                block_end = BLOCK_END.search(text, last)
            if block_end and last >= secret_end and BLOCK.fullmatch(text, last + 1, block_end.start()):
                found["secret"].append((last - 10, block_end.end()))
                secret_end = block_end.end()
        elif kind == "scheme":
            if m := USERINFO.match(text, last + 1):
                found["login"].append((last + 1, m.end()))
        else:
            end = last - 3
            while end > 0 and text[end - 1] == " ":
                end -= 1
            start = end
            while start > 0 and text[start - 1] in LOCAL:
                start -= 1
            if start < end and (m := MASKED_DOMAIN.match(text, last + 1)):
                found["masked"].append((start, m.end()))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def scan(text: str | None) -> tuple:
    found = find(text)
    base = joined(found, BASE)
    added = joined(found, ADDED)
    spans = ",".join(x for x in (base, added) if x)
    return (*(len(found[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), spans, sum(len(found[k]) for k in ADDED), len(found["secret"]), sum(map(len, found.values())))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, counts of the base kinds, digest of the base spans, all spans, numbers of added
    spans, of secrets among them and of all spans."""
    names = [x.split()[0] for x in SPANS.split(", ")]

    def make():
        def f(rows):
            out = zip(*map(scan, rows["text"]), strict=True)
            return {"doc_id": rows["doc_id"], **dict(zip(names, map(list, out), strict=True))}

        return f

    return map_texts(texts(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, {SPANS}")


def redact(text: str | None, mask: str = "[{kind}]") -> str | None:
    """The text with every span replaced; overlapping spans are merged under the first one's kind."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, spans in find(text).items() for a, b in spans):
        if a >= at:
            out += [text[at:a], mask.format(kind=kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])
