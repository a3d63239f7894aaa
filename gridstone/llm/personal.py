"""Personal data: Aho-Corasick anchors, expanded and validated by local parsers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import prepare

#: In order of the base kinds; the kinds that the method adds follow.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret", "address")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | DIGITS | frozenset("+.-")

#: Cues in English, German, French and Spanish, and what stands around them (fixed values).
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "kontonummer", "reisepass", "compte", "passeport", "cuenta", "pasaporte")
SECRET_CUES = ("token", "password", "secret", "api_key", "apikey", "passwort", "kennwort", "mot de passe", "contraseña", "clave")
STREET_CUES = ("street", "avenue", "road", "lane", "boulevard", "drive", "straße", "strasse", "weg", "platz", "allee", "gasse", "rue", "place", "chemin", "calle", "avenida", "plaza", "paseo")
#: Groups of letters and digits, each with a digit and parted by one space or hyphen: a word without a digit ends the number.
ACCOUNT = re.compile(r"(?:\s+(?:no|number|nr|nummer|num|numéro|número)\b\.?)?\s*[:=#]?\s*([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z]{0,4}[0-9][A-Za-z0-9]*)*)", re.I)
ACCOUNT_DIGITS = 5
SOCIAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
BANK = re.compile(r"[A-Za-z]{2}[0-9]{2}")
SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9+/=_-]{16,})")
STREET = re.compile(r"\b[0-9]+[A-Za-z]?(?:\x20[A-Z][a-z]+){1,3}\x20[A-Za-z]+\Z")
#: Behind a street's cue: a house number; or a name, of which the Spanish form has the number behind it.
HOUSE = re.compile(r"\x20[0-9]+[A-Za-z]?\b")
NAME = re.compile(r"(?:\x20(?:de|du|des|del|la|las|le|les|los|el))*\x20(?:[ld]')?[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[-\x20][^\W\d_a-zß-öø-ÿ][^\W\d_]+)*")
NAME_HOUSE = re.compile(r",?\x20(?:n[.º°]?\x20?)?[0-9]+[A-Za-z]?\b")
HOUSE_BEFORE = re.compile(r"\b[0-9]+[A-Za-z]?(?:\x20(?:bis|ter))?,?\x20\Z")
URL_TAIL = re.compile(r"[^\s\"'<>|]+")

Span = tuple[str, int, int]


def _automaton() -> ahocorasick.Automaton:
    """At-signs, plus signs, digits, schemes and cues; each leads to its kind and length."""
    a = ahocorasick.Automaton()
    for kind, words in (("@", ("@",)), ("+", ("+",)), ("0", tuple(sorted(DIGITS))), ("://", ("://",)), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("street", STREET_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str, anchors: list[int]) -> Iterator[Span]:
    """From each at-sign left over the local part, back to the last match at most, and right over the domain."""
    free = 0
    for at in anchors:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield "email", start, free


def _matches(text: str, anchors: list[int], pattern: re.Pattern[str]) -> Iterator[re.Match[str]]:
    """Leftmost matches that begin at an anchor, without overlap."""
    free = 0
    for at in anchors:
        if at >= free and (m := pattern.match(text, at)):
            free = m.end()
            yield m


def _runs(anchors: list[int]) -> list[int]:
    """The first of each run of adjacent anchors."""
    return [a for k, a in enumerate(anchors) if not k or anchors[k - 1] + 1 != a]


def base_spans(text: str, anchors: dict[str, list[int]]) -> list[Span]:
    """The contract's spans, by start and kind."""
    digits = anchors.get("0", [])
    runs = _runs(digits)
    out = list(_emails(text, anchors.get("@", [])))
    # Both patterns eat whole runs of digits, so a match begins at the first digit of a run or nowhere in it.
    for m in _matches(text, runs, IP):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _matches(text, runs, CARD):
        d = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _matches(text, anchors.get("+", []), PHONE):
        if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def account_end(number: str) -> int:
    """How much of the groups behind a cue is the number; 0 if it has too few digits for one.

    A social security number ends after its nine digits. Groups that begin like
    an IBAN end with the first of them whose check digits are right (mod 97),
    if there is one; other numbers keep all groups.
    """
    if m := SOCIAL.match(number):
        return m.end()
    if BANK.match(number):
        for gap in re.finditer(r"[ -]|\Z", number):
            own = re.sub(r"[ -]", "", number[: gap.start()])
            if len(own) > 34:
                break
            if len(own) >= 15 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1:
                return gap.start()
    return len(number) if sum(c in DIGITS for c in number) >= ACCOUNT_DIGITS else 0


def address(text: str, at: int) -> tuple[int, int] | None:
    """The street address around the cue that ends at a place: number, names and cue; cue and number behind it, the cue
    being the end of a name or a word after one; number, cue and name; or cue, name and number."""
    # Before the cue's end stand the cue, one to three names and the number, each parted by one space.
    low = at
    for _ in range(5):
        low = text.rfind(" ", 0, low)
        if low < 0:
            break
    if m := STREET.search(text, low + 1, at):
        return m.start(), at
    start = at
    while start > 0 and (text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    if (m := HOUSE.match(text, at)) and text[start].isupper():
        # A cue alone takes the name before it along.
        if text[start:at].lower() in STREET_CUES and start > 1 and text[start - 1] == " ":
            first = start - 1
            while first > 0 and (text[first - 1].isalpha() or text[first - 1] == "-"):
                first -= 1
            if first < start - 1 and text[first].isupper():
                start = first
        return start, m.end()
    if name := NAME.match(text, at):
        if m := HOUSE_BEFORE.search(text, max(0, start - 16), start):
            return m.start(), name.end()
        if m := NAME_HOUSE.match(text, name.end()):
            return start, m.end()
    return None


def added_spans(text: str, anchors: dict[str, list[int]], base: list[Span]) -> list[Span]:
    """URLs, accounts, secrets and street addresses around their anchors, where they do not overlap a base span of theirs."""
    out: list[Span] = []
    for at in anchors.get("://", []):
        start = at
        while start > 0 and text[start - 1] in SCHEME:
            start -= 1
        while start < at and text[start] not in LETTERS:
            start += 1
        tail = URL_TAIL.match(text, at + 3)
        if start < at and tail:
            end = at + 3 + len(tail[0].rstrip(".,;:!?)]}"))
            if end > at + 3:
                out.append(("url", start, end))
    starts, ends = [], []  # of the base spans' union, in order
    for a, b in sorted((s[1], s[2]) for s in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free_of_base(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k < 0 or ends[k] <= a

    for at in anchors.get("account", []):
        if (m := ACCOUNT.match(text, at)) and (end := account_end(m[1])) and free_of_base(m.start(1), m.start(1) + end):
            out.append(("account", m.start(1), m.start(1) + end))
    for at in anchors.get("secret", []):
        if (m := SECRET.match(text, at)) and free_of_base(*m.span(1)):
            out.append(("secret", *m.span(1)))
    for at in anchors.get("street", []):
        if not text[at : at + 1].isalpha() and (found := address(text, at)):
            out.append(("address", *found))
    free: dict[str, int] = {}
    kept = []
    for s in sorted(out, key=_order):
        if s[1] >= free.get(s[0], 0):
            free[s[0]] = s[2]
            kept.append(s)
    return kept


def anchors_of(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[int]]:
    """Places by kind of anchor: of its first character for signs and digits, just after it for cues."""
    found: dict[str, list[int]] = {}
    for end, (kind, length) in automaton.iter(text):
        found.setdefault(kind, []).append(end + 1 if kind in ("account", "secret", "street") else end - length + 1)
    return found


def personal_spans(text: str | None, automaton: ahocorasick.Automaton) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans); code points, end exclusive. Null and empty texts have none."""
    if not text:
        return [], []
    anchors = anchors_of(text, automaton)
    # Cues count whatever their case. Dotted capital I is the only character that lower() makes longer, which would move places.
    if (low := text.replace("\u0130", "i").lower()) != text:
        anchors |= {k: v for k, v in anchors_of(low, automaton).items() if k in ("account", "secret", "street")}
    base = base_spans(text, anchors)
    return base, sorted(base + added_spans(text, anchors, base), key=_order)


FOUND = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    automaton = _automaton()
    for texts in batches:
        rows = []
        for text in texts.to_pylist():
            base, spans = personal_spans(text, automaton)
            own = set(base)
            rows.append([{"kind": k, "start": a, "end": b, "base": (k, a, b) in own} for k, a, b in spans])
        yield pa.array(rows, type=_FOUND)


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``personal``, an array of (kind, start, end, base) in order; each row on its own, no shuffle.

    Null and empty texts get an empty array; a column named personal is replaced.
    """
    prepare(docs.sparkSession)
    return docs.withColumn("personal", F.arrow_udf(_find, FOUND)(F.col(text)))


def personal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, then n_url, n_account, n_secret, n_address and n_spans."""
    found = find_personal(docs.select("doc_id", "text")).select("doc_id", "personal")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    own = F.sha2(joined(F.filter("personal", lambda s: s["base"])), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, BASE_KINDS), own, joined(F.col("personal")).alias("spans"), *map(count, KINDS[len(BASE_KINDS) :]), F.size("personal").cast("bigint").alias("n_spans"))
