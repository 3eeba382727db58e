"""Personal information inside free text: offset-preserving normalisation, detection, typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.session import spread

KINDS = ("email", "phone", "id_number", "address", "person_name")

# --- transducers: normalised text plus, for each of its characters, the source span it stands for ---------------

# fixed values: letters of other scripts that look like Latin ones
HOMOGLYPHS = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕԁԛѡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνι",
    "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXaopvi",
) | {0xFF01 + k: 0x21 + k for k in range(94)} | {c: 0x20 for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)} | {c: 0x2D for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212)} | {0x2019: 0x27, 0x201D: 0x22, 0x201C: 0x22}
NOTHING = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "(?:" + "|".join(DIGIT_WORDS) + ")"
DISGUISES = re.compile(
    rf"(?P<drop>[{NOTHING}]+)"
    r"|(?P<at>\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|(?<=[\w+])\ at\ (?=[\w-]+(?:\ dot\ [\w-]+)+))"
    r"|(?P<dot>(?<=\w)\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?(?=\w))"
    rf"|(?P<spelled>\b{_DIGIT}(?:[ -]{_DIGIT}){{5,}}\b)",
    re.I,
)
PLAIN_AT = re.compile(r"@[\w-]+(?:(?:\.| dot )[\w-]+)*")
PLAIN_DOT = re.compile(r" dot ", re.I)


def normalise(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """(normalised text, first, last): source offsets of each normalised character; None where both texts align."""
    text = text.translate(HOMOGLYPHS)  # one character each, offsets stay
    if not DISGUISES.search(text):
        return text, None, None
    out: list[str] = []
    first: list[int] = []
    last: list[int] = []

    def put(chars: str, b: int, e: int) -> None:
        out.append(chars)
        first.extend([b] * len(chars))
        last.extend([e] * len(chars))

    def copy(b: int, e: int) -> None:
        out.append(text[b:e])
        first.extend(range(b, e))
        last.extend(range(b + 1, e + 1))

    at = 0
    for m in DISGUISES.finditer(text):
        if m.start() < at:
            continue
        copy(at, m.start())
        at = m.end()
        if m["at"]:
            put("@", m.start(), m.end())
            host = re.compile(r"[\w-]+(?: dot [\w-]+)+", re.I).match(text, m.end())
            if host and m["at"].strip().lower() == "at":  # a host spelled with dots after a spelled at
                p = m.end()
                for d in PLAIN_DOT.finditer(text, m.end(), host.end()):
                    copy(p, d.start())
                    put(".", d.start(), d.end())
                    p = d.end()
                copy(p, host.end())
                at = host.end()
        elif m["dot"]:
            put(".", m.start(), m.end())
        elif m["spelled"]:
            for w in re.compile(_DIGIT, re.I).finditer(text, m.start(), m.end()):
                put(DIGIT_WORDS[w[0].lower()], w.start(), w.end())
    copy(at, len(text))
    return "".join(out), first, last


# --- detectors over the normalised text -----------------------------------------------------------------------

EMAIL = re.compile(r"(?<![\w.+%@/-])[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-]|\.\w|:[\w/~.-]|@)")

_US = r"(?:\+?1[-. ]?)?(?:\(\d{3}\)[ -]?|\d{3}[-. ])\d{3}[-. ]\d{4}(?:,? (?:ext\.?|x) ?\d{1,5})?"
_US_RUN = r"\+?1[2-9]\d{2}[2-9]\d{6}"
_FAR = r"(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0\) ?\d{1,4}(?: ?[/-] ?|[ .-])\d{3,8}(?:-\d{1,4})?|\d{1,4}(?: \d{2,4}){1,4}|\d{1,4} ?[/-] ?\d{3,8}(?:-\d{1,4})?|\d{8,12}|\d{1,4} \d{5,9})"
PHONE = re.compile(rf"(?<![\w.+#/(-])(?:{_FAR}|{_US}|{_US_RUN})(?![\w]|[.-]\d|/\d)|(?<=\()(?:{_FAR}|{_US}|{_US_RUN})(?=\))")

_NO = r"(?:\s*(?:no\.?|number|nr\.?|#))?\s*[:=#]?\s*"
IDS = [
    re.compile(r"(?<![\w.-])(?P<n>\d{3}-\d{2}-\d{4})(?![\w-]|\.\d)"),
    re.compile(r"(?<![\w./-])(?P<n>\d{2}/\d{3}/\d{5})(?![\w/-])"),
    re.compile(r"(?<![\w.-])(?P<n>\d{6}[-+]\d{4})(?![\w-]|\.\d)"),
    re.compile(r"(?<![\w-])(?P<n>[A-Z]{2}\d{6}[A-Z]\d{2})(?![\w-])"),
    re.compile(r"(?<![\w-])(?P<n>[XYZ]\d{7}[A-Z])(?![\w-])"),
    re.compile(rf"(?i:\bpassport){_NO}(?P<n>[A-Z]{{1,2}}\d{{6,8}})(?![\w-])"),
    re.compile(r"(?<![\w-])(?P<n>[A-Z]\d{8})(?![\w-])"),
    re.compile(rf"(?i:\b(?:national|identity)\ (?:id|card|number)){_NO}(?P<n>\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}})(?![\w-])"),
    re.compile(r"(?<![\w.:-])(?<!\d )(?P<n>0\d{3} \d{4} \d{4})(?![\w-]| \d)"),
]

_STREET = r"(?:Street|St\b\.?|Avenue|Ave\b\.?|Lane|Ln\b\.?|Road|Rd\b\.?|Boulevard|Blvd\b\.?|Way|Drive|Dr\b\.?|Court|Ct\b\.?|Close|Crescent|Grove|Gardens|Walk|Mews|Parkway|Highway|Alley|Quay|Circle|Trail|Square|Terrace|Place)"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite)\ \d+[A-Za-z]?"
_TOWN = r"(?:(?:,\ |\n)[A-Z][a-z]+(?:\ \d{5})?(?=[\s.,;\"')]|$)(?!\ [A-Z]))?"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:{_UNIT},\ )?\d{{1,5}}[A-Za-z]?\ (?:[A-Z][a-z]+\ ){{1,3}}{_STREET}(?!\ View)(?![A-Za-z])(?:,\ {_UNIT})?{_TOWN}"
    r"|(?<![\w-])[A-Z][a-z]+(?:strasse|straße|str\.|weg|gasse|allee|platz)\ \d{1,4}\ ?[a-z]?(?![\w-])(?:,\ \d{5}\ [A-Z][a-z]+)?"
)

#: Capital and small letters of Latin names, accented ones among them.
_UP, _LOW = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽȘȚ", r"a-zß-öø-ÿāăąćčďđēęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžșț"
_GIVEN = rf"[{_UP}][{_LOW}]+"
_SURNAME = rf"(?:(?:van|von|de|del|da|la|ter)[- ])?(?:O['’]|Mc|Mac|D['’])?[{_UP}][{_UP}{_LOW}]+(?:-(?:(?:van|von|de|O['’])-?)?[{_UP}][{_UP}{_LOW}]+)*"
_SURNAME = rf"(?:{_SURNAME}|[a-z]{{2,3}}-[{_UP}][{_UP}{_LOW}]+(?:-[{_UP}][{_UP}{_LOW}]+)*)"
_NAME = rf"(?:{_GIVEN}(?:\ [{_UP}]\.)?\ {_SURNAME}|{_SURNAME},\ {_GIVEN}(?:\ [{_UP}]\.)?)"
NAME = re.compile(rf"(?<![\w'-]){_NAME}(?![\w'-])")
#: Places that announce a person, as regular expressions around a name.
ANNOUNCED = [
    re.compile(rf"(?:^|(?<=[\n \"#/*>]))(?:Signed-off-by|Reviewed-by|Acked-by|Tested-by|Co-authored-by|Reported-by|Author|Maintainer|Contact|Owner|owner|From|Cc|cc):?\ (?P<n>{_NAME})(?![\w'-])", re.M),
    re.compile(rf"(?:[Rr]eported by|[Aa]ccording to|[Tt]hanks to|\b[Aa]sk|\bHi|\bDear|\bHello|go to|[Cc]all(?:ed)? by|written by|[Pp]ing)\ (?P<n>{_NAME})(?=[ ,.;:(!?\n]|$)"),
    re.compile(rf"(?:\b(?:Dr|Mr|Mrs|Ms|Prof)\.?)\ (?P<n>{_NAME})(?![\w'-])"),
    re.compile(rf"\"name\"\s*:\s*\"(?P<n>{_NAME})\""),
    re.compile(rf"\w+\.add\(\"(?P<n>{_NAME})\","),
    re.compile(rf"(?:Best|Regards|Cheers|Thanks|Sincerely|-- ?),?\n(?P<n>{_NAME})(?=\s*(?:\n|$))"),
    re.compile(rf"(?<![\w'-])(?P<n>{_NAME})(?=\ (?:moved to the|found this|signed (?:the|off)|wrote on|joined the|left the))"),
    re.compile(rf"(?:^|(?<=\s))(?P<n>{_NAME})(?=;[^\s;]+@)", re.M),
    re.compile(rf"\bcc {_NAME}[;,]\ (?P<n>{_NAME})(?![\w'-])"),
]
#: Capitalised words that open a sentence or a label and are no given names.
OPENERS = {"Ask", "Hi", "Dear", "Hello", "Thanks", "Best", "Reported", "Contact", "Call", "Author", "Maintainer", "Owner", "The", "This", "That", "Row", "See", "If", "Each", "Old", "Both", "No", "Two", "Merge", "Grade", "Dr", "Mr", "Mrs", "Ms", "Prof", "Ping", "Cc", "From", "To", "In", "On", "At", "After", "Note", "Fixed", "Version", "Does", "We", "Flat", "Apt"}
_PART = re.compile(rf"[{_UP}{_LOW}][{_LOW}]{{2,}}|[{_UP}]{{3,}}")


def _names(text: str, known: set[str]) -> Iterator[tuple[int, int]]:
    for rx in ANNOUNCED:
        for m in rx.finditer(text):
            if m["n"].split()[0] not in OPENERS:
                yield m.span("n")
    if known:
        at = 0
        while m := NAME.search(text, at):
            words = m[0].split()
            at = m.end()
            if words[0].rstrip(",") in OPENERS:
                at = m.start() + len(words[0])
            elif any(p.lower() in known for p in _PART.findall(m[0])):
                yield m.span()
            else:
                at = m.start() + len(words[0])


def find_spans(text: str | None, known: set[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each occurrence by source offset, in order and without overlap."""
    if not text:
        return []
    plain, first, last = normalise(text)
    taken = bytearray(len(plain))
    found: list[tuple[int, int, str]] = []

    def take(b: int, e: int, kind: str) -> None:
        if b < e and not any(taken[b:e]):
            taken[b:e] = b"\1" * (e - b)
            found.append((b, e, kind))

    if "@" in plain:
        for m in EMAIL.finditer(plain):
            if m[0].partition("@")[0] != "git" and not plain[: m.start()].endswith("://"):
                take(*m.span(), "email")
    for rx in IDS:
        for m in rx.finditer(plain):
            take(*m.span("n"), "id_number")
    for m in PHONE.finditer(plain):
        b, e = m.span()
        take(b, e, "phone")
    for m in ADDRESS.finditer(plain):
        take(*m.span(), "address")
    for b, e in sorted(set(_names(plain, known)), key=lambda s: (s[0] - s[1], s)):
        take(b, e, "person_name")
    found.sort()
    return found if first is None else [(first[b], last[e - 1], k) for b, e, k in found]


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with ``[KIND]`` in place of each span, all else unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for b, e, kind in spans:
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


MAX_NAME_PARTS = 200_000
RESULT = "doc_id bigint, masked string, spans array<struct<begin_at:bigint,end_at:bigint,pii_kind:string>>"


def mask_documents(documents: DataFrame, known_names: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, masked, spans): each text with typed placeholders, and what was found by source offset.

    Transducers first bring look-alike letters, wide characters, odd blanks, spelled digits and at/dot disguises to
    plain form and remember for every character where it came from; detectors run on the plain form and their spans
    are mapped back. Persons are found where the text announces them, or by a part listed in ``known_names``.

    One pass, no shuffle but for spreading a small scan. Whole texts are read. Null text gives null and no spans, an
    empty text itself; repeated rows give repeated rows; an empty table an empty result; other columns are ignored.
    The list of name parts is sent to all executors and must have at most MAX_NAME_PARTS rows.
    """
    parts = [r[0] for r in known_names.select(F.lower("name_part")).where("name_part is not null").distinct().limit(MAX_NAME_PARTS + 1).collect()]
    if len(parts) > MAX_NAME_PARTS:
        raise ValueError("too many name parts to send to the executors")
    known = documents.sparkSession.sparkContext.broadcast(set(parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [find_spans(t, known.value) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "masked": [masked(t, s) for t, s in zip(pdf["text"], spans)] if with_text else None, "spans": [[{"begin_at": b, "end_at": e, "pii_kind": k} for b, e, k in s] for s in spans]})

    return spread(documents.select("doc_id", "text"), "doc_id").mapInPandas(run, RESULT)
