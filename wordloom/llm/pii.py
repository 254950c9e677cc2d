"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, URL schemes and
identifier cues (in any case).  Deterministic local parsers
expand each anchor to the boundaries of an email, phone number, URL, secret,
account or street address.  Numbers without a cue (IP addresses, payment cards)
are anchored at their digits by linear scans.  No parser looks at a character
more than a bounded number of times, whatever the text.

Kinds email, ip, card and phone are the base; url, secret, account and address
are added spans.  Spans are in code points, end exclusive, ordered by kind as
listed in KINDS, then by start.

Defined cases: null and empty texts have no spans; repeated rows are handled
one by one; an empty table gives no rows; texts are read whole, however long;
``find_pii`` reads key and text alone, so other columns can't clash; ``redact``
passes them through and leaves texts without spans unchanged, nulls included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.plans.workers import lean

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account", "address")

# Cues and schemes.
SCHEMES = ("http://", "https://", "ftp://")
SECRET_CUES = ("token", "secret", "password", "passwd", "passwort", "kennwort", "mot de passe", "contraseña", "api_key", "api-key", "api key", "apikey", "access_key", "access-key", "access key")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn")
SHORT_STREET_CUES = (" st", " ave", " rd", " blvd", " ln", " dr")
MONTHS = frozenset((
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "januar", "februar", "märz", "mai", "juni", "juli", "oktober", "dezember",
    "janvier", "février", "mars", "avril", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre",
    "enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
))
YEAR_CUES = frozenset(("in", "since", "by", "until", "till", "from", "of", "year", "im", "seit", "jahr", "bis", "en", "depuis", "an", "année", "desde", "hasta", "año"))
STREET_CUES = ("street", "avenue", "road", "boulevard", "straße", "strasse", "rue ", "calle ")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>]++")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SECRET = re.compile(r"[\"']?(?:\s{0,3}[:=]\s{0,3}|\s{1,3}(?:is|ist|est|es)\s{1,3})[\"']?([A-Za-z0-9_\-./+=]{12,})")
_ACCOUNT_GAP = re.compile(r"(?:\s{0,3}(?:no|nr|number|id)\b)?(?:\s{1,3}is\b)?[\s.:#=]{1,5}", re.IGNORECASE)
_ACCOUNT = re.compile(r"[A-Za-z]{0,2}[0-9][A-Za-z0-9]{5,33}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_GROUPS = re.compile(r"[A-Za-z]{0,2}[0-9]{1,6}([ -])[0-9]{1,6}(?:\1[0-9]{1,6}){0,16}(?![A-Za-z0-9])|[A-Z]{1,2}[ -][0-9]{5,14}(?![A-Za-z0-9])|[0-9]{7,20}(?:-[0-9]{1,6}){1,4}(?![A-Za-z0-9])")
_DATE = re.compile(r"[0-9]{4}([ -])[0-9]{2}\1[0-9]{2}|[0-9]{2}([ -])[0-9]{2}\2[0-9]{4}")
# Street names: a word, one that is no lower-case Latin at its start, small words between, a day (rue du 8 Mai 1945).
_WORD = r"(?:[^\W\d_]{1,30}(?:['’.-][^\W\d_]{1,30}){0,5}\.?|[0-9]{1,3}(?:st|nd|rd|th))"
_PROPER = r"(?:(?:[ldLD]['’])?[^\W\d_a-zß-öø-ÿ][^\W\d_]{0,30}(?:['’.-][^\W\d_]{1,30}){0,5}\.?|[0-9]{1,3}(?:st|nd|rd|th))"
_SMALL = r"(?:de|du|des|del|la|le|les|los|las|el|et|y|of|the|von|der|den|dem|zu|am)"
_DAY = rf"[0-9]{{1,2}}(?:er)? {_WORD}(?: [0-9]{{4}}(?![0-9]))?"
_STREET_NAME = rf"(?:{_SMALL} )*(?:{_DAY}|{_PROPER})(?: (?:{_SMALL} )*{_PROPER})*"
_NUMBER = r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]?"
_NUMBER_BEFORE = re.compile(rf"{_NUMBER}(?: (?:bis|ter|quater|[a-zA-Z]))?,? \Z")
_NAME_AFTER = re.compile(rf" ?{_STREET_NAME}| (?:{_SMALL} )+{_WORD}")
_LOW_NAME_AFTER = re.compile(rf"(?:{_SMALL} )*(?:[ld]['’])?{_WORD}")
_HOUSE_BEFORE = re.compile(rf"{_NUMBER},? (?:(?:{_WORD} ){{1,3}}|{_PROPER} (?:(?:{_SMALL} )*{_PROPER} )+)\Z")
_SHORT_BEFORE = re.compile(rf"{_NUMBER},? (?:{_PROPER} ){{1,5}}\Z")
_HOUSE_AFTER = re.compile(rf"[^\W\d_]{{0,30}},? [0-9]{{1,5}}[a-z]?(?![A-Za-z0-9])|(?:(?:{_WORD} ){{0,2}}{_WORD}|{_STREET_NAME}),? [0-9]{{1,5}}[a-z]?(?![A-Za-z0-9])")
_BARE_NUMBER = re.compile(r",? [0-9]")
_PROPER_BEFORE = re.compile(rf"(?<![^\W_])(?:{_PROPER} )+\Z")
_COMPOUND_BEFORE = re.compile(r"(?<![^\W_])[^\W\d_]{1,40}(?:-[^\W\d_]{1,40}){0,5}-?\Z")
# Letters that a street's name and number may take on either side of the cue.
_NEAR = 200


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether a value without separators has the check digits of an IBAN."""
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, end: int, only_iban: bool) -> tuple[int, int] | None:
    """The account value after a cue that ends at ``end``: an IBAN with right check digits, digits in groups, or one run."""
    gap = _ACCOUNT_GAP.match(text, end)
    if not gap:
        return None
    at = gap.end()
    if m := _IBAN.match(text, at):
        for stop in range(m.end(), at + 14, -1):
            if text[stop - 1] not in " -" and not (stop < len(text) and text[stop] in _ALNUM) and iban(text[at:stop].replace(" ", "").replace("-", "")):
                return at, stop
    if only_iban:
        return None
    if m := _GROUPS.match(text, at):
        digits = sum(c in "0123456789" for c in m[0])
        # Years and dates have eight digits: as few as that need more than a space after the cue.
        stated = gap[0].strip() != "" or m[0][0] not in "0123456789"
        if digits >= 9 or stated and digits >= 5 + 3 * (m[1] is not None) and not _DATE.fullmatch(m[0]):
            return m.span()
    if (m := _ACCOUNT.match(text, at)) and sum(c in "0123456789" for c in m[0]) >= 4:
        return m.span()
    return None


def _is_date(text: str, low: int, found: re.Match) -> bool:
    """Whether the number of a find is a day before a month or a year after a word of time: 5 December the road, in 2019 Wall Street."""
    words = found[0].replace(",", " ").split()
    if len(words) > 1 and words[1].rstrip(".").lower() in MONTHS:
        return True
    before = text[max(low, found.start() - 12) : found.start()].split()
    return len(words[0]) == 4 and words[0][:2] in ("18", "19", "20", "21") and bool(before) and before[-1].lower() in YEAR_CUES


def _address(text: str, low: int, start: int, end: int) -> tuple[int, int] | None:
    """The street address around a cue: number and street, street and name, or street and number."""
    compound = text[start].lower() == "s" and text[start + 3].lower() == "a"  # Straße
    if not compound and start and text[start - 1].isalnum():
        return None
    left = max(low, start - _NEAR)
    right = min(len(text), end + _NEAR)
    spaced = text[end - 1] == " "
    if m := _NUMBER_BEFORE.search(text, left, start):
        if after := _NAME_AFTER.match(text, end, right) or spaced and _LOW_NAME_AFTER.match(text, end, right):
            return m.start(), after.end() - (text[after.end() - 1] == ".")
    if (m := _HOUSE_BEFORE.search(text, left, start)) and not _is_date(text, low, m):
        return m.start(), end - spaced
    if not compound and not spaced and text[start].islower() and _BARE_NUMBER.match(text, end, right):
        return None  # the road 66
    if after := _HOUSE_AFTER.match(text, end, right):
        if compound and (m := _COMPOUND_BEFORE.search(text, left, start) or _PROPER_BEFORE.search(text, left, start)):
            start = m.start()
        return start, after.end()
    return None


def _short_address(text: str, low: int, start: int, end: int) -> tuple[int, int] | None:
    """Number, name and a shortened cue that is written as a word: 12 Main St."""
    if not text[start + 1].isupper() or end < len(text) and text[end].isalnum():
        return None
    m = _SHORT_BEFORE.search(text, max(low, start - _NEAR), start + 1)
    # a number and a month are a date: on 12 May St. Peter
    return (m.start(), end) if m and m[0].split()[-1].lower() not in MONTHS and not _is_date(text, low, m) else None


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, cues in (("email", "@"), ("phone", "+"), ("url", SCHEMES), ("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("address", STREET_CUES), ("short address", SHORT_STREET_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, cue))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """The text in lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


_machine = None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text."""
    global _machine
    if not text:
        return []
    if _machine is None:
        _machine = _automaton()
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, cue) in _machine.iter(_lower(text)):
        start, end = last + 1 - len(cue), last + 1
        parser, kind = kind, "address" if kind == "short address" else kind
        low = done[kind]
        if start < low:
            continue
        got = None
        if kind == "email":
            left = start
            while left > low and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, start)):
                got = (left, m.end())
        elif kind == "phone":
            if m := _PHONE.match(text, start):
                done[kind] = m.end()
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans[kind].append(m.span())
        elif kind == "url":
            if (m := _URL.match(text, end)) and _HOST.match(text, end, m.end()):
                got = (start, end + len(m[0].rstrip(".,;:!?)]}")))
        elif kind == "secret":
            if (m := _SECRET.match(text, end)) and any(c in "0123456789" for c in m[1]):
                got = m.start(1), m.start(1) + len(m[1].rstrip("."))
        elif kind == "account":
            got = _account(text, end, cue == "iban")
        elif parser == "short address":
            got = _short_address(text, low, start, end)
        else:
            got = _address(text, low, start, end)
        if got:
            spans[kind].append(got)
            done[kind] = got[1]
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            spans["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans["card"].append(m.span())
    return [(kind, *span) for kind in KINDS for span in spans[kind]]


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span as <KIND>; of overlapping spans the first and longest names the whole."""
    if not spans:
        return text
    parts, at = [], 0
    merged: list[list] = []
    for start, minus_end, kind in sorted((s, -e, k) for k, s, e in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], -minus_end)
        else:
            merged.append([start, -minus_end, kind])
    for start, end, kind in merged:
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(parts) + text[at:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, spans array<struct<kind, start, end>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(x.as_py())] for x in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found, _SPANS)], [key, "spans"])

    source = docs.select(F.col(key), F.col(text))
    return source.mapInArrow(lean(run), f"`{key}` {source.schema[0].dataType.simpleString()}, spans array<struct<kind: string, start: int, `end`: int>>")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of its texts masked; other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            clean = pa.array([mask(t, find(t)) for t in batch[at].to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(lean(run), docs.schema)


def spans_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
