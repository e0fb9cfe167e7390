"""Personal information in free text: detection, typed placeholders and keyed surrogates.

Detection runs where the rows lie, one pass over both fields. Placeholders need nothing else. Surrogates replace *units*:
a word of a name, or the whole of any other value. A unit has one surrogate wherever it occurs, so "Anna Berg", "BERG,
Anna" and "Ms Berg" go on naming one person. Listed given names are permuted within their gender by the key; all else is
drawn from a keyed hash in the unit's script and format, and drawn again while it equals another unit's surrogate or any
value that really occurs.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltra.llm.common import materialize
from siltra.llm.pairs import FUNCTION_WORDS
from siltra.llm.tokenizing import common_words

KINDS = ("person", "email", "phone", "id_number", "address")

# Common given names by gender, titles, cue words and street words of the languages handled.
FEMALE = """ada alice amara amelia ana anna anja astrid beatriz carla carmen caroline catherine charlotte clara elena elif elise
elizabeth emily emma eva farah fatima francesca freya giulia hana hannah helena ida ilse ines ingrid isabel jana jane julia judith
karin katarina katrin laura leila lena linda lisa lucia lucy luisa mara maria marie marta mary maya mei mia nadia nina noor nora olga
olivia paula petra priya rosa ruth sanne sara sarah signe silvia simone sofia sofie sophie susan teresa ursula vera yasmin yuki
zora zoe""".split()
MALE = """adam ahmed alan albert alejandro alex ali anders andreas andrew antonio ben bernd bruno carl carlos charles chen daniel
david diego dmitri emeka emil erik felix fernando finn francisco frank franz george hans harry hassan heinz henrik henry hugo ivan
jack jakob james javier jens john jonas jorge jose josef juan karim karl kenji klaus kofi kwame lars leo louis luca lucas luis
lukas manuel marco mario martin mateo matthew max michael miguel mohamed nils noah oliver omar oscar oskar otto pablo paul
pavel pedro peter philip pierre rafael ravi robert samuel sergei simon stefan sven thomas tim tom tomas viktor walter wei werner
william wolfgang yusuf""".split()
SURNAME_ENDINGS = """bach baum berg berger borg brand burg cescu chenko dahl dottir dze escu feld gaard grad guez heim helm hoff huber
ian iev ing kamp kov kowski kvist land lund man mann meyer moto nen nez oglu opoulos ova owicz poulos quist qvist rossi schmidt shvili
ska ski sky son sen stad stein strand ström svili thal vic vich weiler yan zadeh""".split()
#: Words between given name and surname, and words after a name at a sentence's start that tell it from other nouns.
PARTICLES = "van von der den de del della da di dos la le bin ibn al el ter ten zu".split()
PERSON_VERBS = """signed said says lives lived called calls wrote writes asked asks works worked moved paid pays owns rents rented may can is was has had
will would and or booked stays stayed confirmed agreed arrived left needs wants received sent told replied""".split()
TITLES = "mr mrs ms miss mx dr prof professor herr frau señor señora sr sra srta don doña mme mlle madame monsieur".split()
#: Words that follow or precede a name but are none.
PLAIN = set("""a about above after am an and antes are as asked at auf aus before bei below both but by call called cc contact dear del
der des die du el en est et extended file follow für from guest guide ha has hat have he her his home ich im in insured interview is
ist la le les lives los mail mit name named not notes of on only opens or para par por present pour present ring room said senden
shares she signed since sleeps street tenant thanks that the their they this to tour und una under until via vom von war was we were
when where which who will with write y you your zu zum zur applicant emergency lamp lease resume cv guest insured applicant
road avenue lane court order letter invoice report itinerary payslip foods clinic insurance institute analytics software rail press
mutual lettings logistics energy housewares bank desk trust club centre center company ltd inc gmbh ag co group hotel school choir
museum project team model server branch station river harbour harbor bay island mountain lake bridge tower park square dossier
mobile phone tel telephone email fax passport address residence status remark form item lot rate latency issuer carrier quantity
departs arrives destination amount due check closing opening date time number national identity tax driving social pension
january february march april may june july august september october november december monday tuesday wednesday thursday friday
saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag""".split())
NAMES = frozenset(FEMALE) | frozenset(MALE)
_TITLE_SET = frozenset(TITLES)
# Words that announce an identity number, with what has to stand before them where they say too little.
ID_CUES = {
    **dict.fromkeys(
        """passport reisepass pasaporte passeport ausweis personalausweis identity identité identita identidad dni nie nif ssn
        steuernummer steueridentifikationsnummer steuerid sozialversicherungsnummer sozialversicherung rentenversicherungsnummer
        rentenversicherung führerschein führerscheinnummer personalausweisnummer reisepassnummer""".split(),
        "",
    ),
    "id": r"(?:tax|steuer|fiscal|personal|national)\W{1,3}$",
    "number": r"(?:tax|personal|national)\W{1,3}$",
    "no": r"(?:tax|personal|national)\W{1,3}$",
    "nr": r"(?:steuer|personal)\W{1,3}$",
    "nummer": r"(?:steuer|personal)\W{1,3}$",
    "fiscal": r"(?:id|identificación|numéro|número)\W{1,3}$",
    "security": r"social\W{1,3}$",
    "insurance": r"(?:social|national|pension)\W{1,3}$",
    "social": r"(?:seguridad|seguro)\W{1,3}$",
    "sociale": r"(?:sécurité|assurance)\W{1,3}$",
    "licence": r"(?:driv\w+|driver.?s?)\W{1,3}$",
    "license": r"(?:driv\w+|driver.?s?)\W{1,3}$",
    "conduire": r"permis\W+de\W{1,3}$",
    "conducir": r"(?:permiso|licencia|carn[eé]t?)\W+de\W{1,3}$",
}
ID_CUES = {w: re.compile(r, re.I) if r else None for w, r in ID_CUES.items()}
_ID_WORDS = frozenset(ID_CUES)
NO_ID_CUE = r"invoice|order|parcel|meter|petition|case|build|ticket|lot|tracking|factura|rechnung|facture|pedido|paket|zähler|auftrag|contrato|reading"
STREET_EN = "street road avenue lane row drive terrace close court place square crescent gardens grove mews walk way hill boulevard".split()
#: Only with a capital.
STREET_SHORT = "st ave rd blvd ln".split()
STREET_IT = "Via Viale Piazza Corso Largo".split()
_EN_SET = frozenset(STREET_EN)
_SHORT_SET = frozenset(STREET_SHORT)
STREET_FR = "rue avenue impasse boulevard place chemin quai allée cours passage".split()
STREET_ES = "calle avenida plaza paseo camino carrera ronda travesía".split()
NO_STREET = """km entries by on in at of from to for the and people minutes days months years hours months pages tables chunks rows
members parking drive reading photos questions guests forms votes words weeks volts kg inr eur usd gbp chf sek is was a an our we
parcel check late every each per""".split()

_SP = r"[^\S\n]*\n?[^\S\n]*"  # blanks with one line end at most
_GAP = r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)"
EMAIL = re.compile(
    r"[\w.+%-]*[\w+]" + r"(?:@|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s(?=[\w-]+\sdot\s))" + r"[\w-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)[\w-]*\w)+", re.I
)
PHONE = re.compile(
    r"[+(\d](?<![\w.,/:+-].)(?:"
    r"(?<=\+)\d{1,3}(?:(?:[\s.\-]{1,2}|/)?(?:\(0\))?\d+){1,6}"
    r"|(?<=\()\+?\d{2,5}\)[\s\-/]{0,3}\d{2,4}(?:[\s.\-]{1,2}\d{2,4}){1,3}"
    r"|(?<=0)0\d{2,3}[\s.\-/]{1,2}\d{2,4}[\s.\-/]{1,2}\d{3,6}(?:[\s.\-]\d{2,4})?"
    r"|(?<=0)\d{2,4}[\s/\-]{1,2}\d{3,8}(?:[\s\-]{1,2}\d{2,5}){0,3}"
    r"|(?<=[2-9])\d{2}-\d{4}"
    r")(?![\w]|[-/.,]\d)(?:[\s]{0,3}(?:ext|durchwahl|poste)\.?\s{0,3}\d{1,5}\b)?",
    re.I,
)
_ID_VALUE = r"(?=[A-Z0-9 \-/.\s]{0,6}\d)[A-Z]{0,3}\d[\dA-Z]*(?:[\s\-/.]{1,2}\d[\dA-Z]*){0,5}"
ID_AFTER = re.compile(rf"(?![^\W\d_]*@)[^\d\n;|]{{0,28}}?[:#,\s]\s{{0,3}}(?P<v>{_ID_VALUE})(?![\w])", re.I)
_NO_ID = re.compile(rf"\b(?:{NO_ID_CUE})\b", re.I)
_SEGMENT = re.compile(r"[\n;|]|\. ")
_POST_EN = r"[A-Z]{1,2}\d[A-Z\d]?\s{1,2}\d[A-Z]{2}"
_TOWN = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*"
_TAIL = rf"(?:,?{_SP}(?:\d{{5}}{_GAP}{_TOWN}|{_TOWN}(?:{_GAP}{_POST_EN})|(?<=,)\s(?-i:[A-Z]){_TOWN}|(?<=,\s)(?-i:[A-Z]){_TOWN}))?"
_NOT = "|".join(sorted(set(NO_STREET)))
_WORDS_BETWEEN = rf"(?!(?:{_NOT})\b)(?:[^\W\d_][\w'’]*{_GAP}(?!(?:{_NOT})\b))"
#: What stands before the street word and after it.
EN_BEFORE = re.compile(rf"(?:\bflat{_GAP}\d+\w?,?{_GAP})?\d(?<![\w:.,/-].)\d{{0,3}}[a-z]?,?{_GAP}{_WORDS_BETWEEN}{{1,3}}$", re.I)
TAIL = re.compile(_TAIL, re.I)
_NO_STREET_AFTER = re.compile(r"[\s\-_]+(?:orders?|of|names?|takes?|costs?)\b")
_DE_ENDS = tuple("straße strasse str weg platz allee gasse ring damm ufer markt steig".split())
_DE_NUMBER = rf"{_GAP}\d{{1,4}}(?:{_SP}[a-z])?\b(?![.:/]\d|{_GAP}(?:uhr|januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember))"
DE_STREET = re.compile(rf"(?:stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|ring|damm|ufer|markt|steig){_DE_NUMBER}{_TAIL}", re.I)
_DE_NO = "Jahr|Jahre|Seite|Kapitel|Abschnitt|Punkt|Tag|Tagen|Monat|Monaten|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Zimmer|Fall|Artikel|Absatz|Teil"
DE_LEAD = re.compile(rf"\b(?:am|an{_GAP}de[rn]|im|zum|zur|auf{_GAP}de[mr]|unter{_GAP}den|hinter{_GAP}de[mr]){_GAP}(?!(?:{_DE_NO})\b)(?-i:[A-ZÄÖÜ])[^\W\d_]+{_DE_NUMBER}{_TAIL}", re.I)
_DE_LEADS = frozenset("am im zum zur dem den der".split())
ADDRESS_IT = re.compile(rf"\b(?:{'|'.join(STREET_IT)}){_GAP}(?:(?:de[il]|della|delle){_GAP})?[A-ZÀ-Þ][^\W\d_]+(?:{_GAP}[A-ZÀ-Þ][^\W\d_]+){{0,2}},?{_GAP}\d{{1,4}}\b(?![.:/]\d|\w)(?:,?{_SP}(?:\d{{5}}{_GAP})?[A-ZÀ-Þ][^\W\d_]+)?")
_DIRECTION = re.compile(rf"\.?(?:{_GAP}(?:NE|NW|SE|SW|N|S|E|W)\b)?")
_LAST_WORD = re.compile(r"[^\W\d_]*$")
ADDRESS_FR = re.compile(rf"\d(?<![\w:.,/-].)\d{{0,3}}(?:{_GAP}?(?:bis|ter))?,?{_GAP}(?:{'|'.join(STREET_FR)}){_GAP}(?:(?:de{_GAP}la|de{_GAP}l['’]|des|du|de|d['’]){_GAP}?)?[^\W\d_][\w'’-]*{_TAIL}", re.I)
ADDRESS_ES = re.compile(rf"(?<![\w-])(?:{'|'.join(STREET_ES)}|c/){_GAP}(?:(?:de{_GAP}la|de{_GAP}los|del|de){_GAP})?[^\W\d_][\w'’-]*(?:{_GAP}[^\W\d_][\w'’-]*){{0,2}},?{_GAP}(?:n[º°.o]\.?{_GAP}?)?\d{{1,4}}\b(?![.:/]\d){_TAIL}", re.I)
_FR_SET, _ES_SET, _IT_SET = frozenset(STREET_FR), frozenset(STREET_ES), frozenset(w.lower() for w in STREET_IT)
_STREETS = _EN_SET | _SHORT_SET | _FR_SET | _ES_SET | _IT_SET
_WORD = re.compile(r"[^\W\d_]+")
_NAME = r"[^\W\d_][^\W\d_'’]*(?:['’][^\W\d_]+)?(?:-[^\W\d_]+)*"
_NAME_RE = re.compile(_NAME)
_ENDS = tuple(SURNAME_ENDINGS)
_INITIAL = re.compile(rf"{_GAP}[^\W\d_]\.(?:{_GAP}?[^\W\d_]\.)*(?={_GAP})", re.I)
_BLANK = re.compile(_GAP)
_AT = re.compile(r"[(\[{]\s?at\s?[)\]}]")
_CV = re.compile(r"(?:cv|resume|lebenslauf|curriculum)\b", re.I)
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./]\d{1,2}|\d{1,2}[-./](?:0?[1-9]|1[0-2])[-./](?:19|20)\d\d)(?:\D+\d{0,2})?")
#: All that is no letter, to a blank.
_TO_BLANK = {c: " " for c in range(0x3100) if not chr(c).isalpha()}


def _surname_like(word: str, cased: bool, title: bool = False) -> bool:
    """Whether ``word`` may be a surname: no plain word or given name, and, in a text whose case tells names apart, a
    capital, else a surname's ending or (without capitals, in capitals only, or as ``title`` says) a word no vocabulary has."""
    low = word.lower()
    first = low.partition("-")[0]
    if len(low) < 3 or low in PLAIN or first in PLAIN or first in _TITLE_SET:
        return False
    if first.endswith(_ENDS) or low.endswith(_ENDS) or (cased and word[0].isupper() and low not in NAMES):
        return True
    parts = low.split("-")
    common = common_words()
    return (
        (word.islower() or word.isupper() or title) and len(parts[0]) > 4 and low not in NAMES and low not in _FUNCTION
        and all(w.isalpha() for w in parts) and parts[0] not in common
    )


#: Function words of the languages handled, which are no surnames in a text without capitals.
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words)
_GERMAN, _ENGLISH = frozenset(FUNCTION_WORDS["de"]), frozenset(FUNCTION_WORDS["en"])
_CAP = r"(?:[A-ZÀ-Þ][^\W\dA-Z_]+(?:[-'’][A-ZÀ-Þ][^\W\d_]+)*|[A-Z]['’][A-ZÀ-Þ][^\W\d_]+)"
_SHAPE = re.compile(rf"(?<![\w.@/+-]){_CAP}(?:[ \xa0]+(?:(?:{'|'.join(PARTICLES)})[ \xa0]+)?{_CAP}){{1,2}}(?![\w@/+-])")
_OPENS = re.compile(r"(?:^|[.!?:;\n|])\W*$")
_ABOUT = re.compile(rf"(?:['’]s\b|,? (?:{'|'.join(PERSON_VERBS)})\b|[ ,]*\()")


def _unlisted(text: str) -> Iterator[tuple[int, int]]:
    """Names by their shape: two or three capitalised words, none of them a plain word, inside a sentence or before
    what persons do."""
    for m in _SHAPE.finditer(text):
        words = [w.lower() for w in re.findall(r"[^\W\d_]{2,}", m[0])]
        if any(w in PLAIN or w in common_words() or w in _STREETS or w.endswith(_DE_ENDS) for w in words if w not in PARTICLES):
            continue
        after = text[m.end():m.end() + 24]
        if _OPENS.search(text, max(0, m.start() - 12), m.start()) and not _ABOUT.match(after):
            continue
        nearby = re.match(r"[\s,]*([^\W\d_]+)", after)
        around = re.findall(r"[^\W\d_]+", text[max(0, m.start() - 100):m.start()] + " " + text[m.end():m.end() + 100])
        if nearby and nearby[1][0].isupper() or 2 * sum(w[0].islower() for w in around) < len(around):
            continue  # part of a longer name, of a firm say, or of a text where capitals tell nothing
        if sum(w in _GERMAN for w in around) > sum(w in _ENGLISH for w in around):
            continue  # capitals mark all nouns there
        yield m.span()


def _is_given(word: str) -> bool:
    """Whether ``word`` is a listed given name or a hyphenated compound of them."""
    return all(w in NAMES for w in word.lower().split("-"))


def _is_cased(around: str) -> bool:
    """Whether capitals mark names here: some, but less than a third of the letters around are capitals."""
    up = sum(map(str.isupper, around))
    return 0 < up < sum(map(str.isalpha, around)) / 3


def _places(words: set[str], low: str) -> list[tuple[int, int]]:
    """Where the given whole words stand, left to right."""
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            end = at + len(w)
            if not (at and low[at - 1].isalpha()) and not (end < len(low) and low[end].isalpha()):
                out.append((at, end))
            at = low.find(w, end)
    return sorted(out)


_BEFORE = re.compile(rf"({_NAME})(,?{_GAP})$")
_TITLED = re.compile(rf"(?<![\w-])((?:(?:{'|'.join(TITLES)})\b\.?{_GAP})+)$", re.I)
_AFTER_TITLE = re.compile(rf"\.?{_GAP}(?:(?:{'|'.join(TITLES)})\b\.?{_GAP})*(?:[^\W\d_]\.{_GAP}?)*(?P<n>{_NAME})", re.I)


def _persons(text: str, low: str, toks: set[str], is_file: bool) -> Iterator[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    done = -1
    for s, e in _places(toks & NAMES, low):
        if e < len(text) and text[e] == "-" and (c := _NAME_RE.match(text, s)) and _is_given(c[0]):
            e = c.end()  # Anna-Maria
        if s < done or (s and text[s - 1] in "@_./\\+") or (e < len(text) and text[e] in "@_-+"):
            continue
        if s > 1 and text[s - 1] == "-" and text[s - 2].isalpha():
            continue
        cased = _is_cased(text[max(0, s - 150):e + 150])
        start = end = e
        has = more = False
        # forward: more given names and initials, then the surname
        while True:
            i = _INITIAL.match(text, end)
            if i:
                end = i.end()
                continue
            g = _BLANK.match(text, end)
            n = g and _NAME_RE.match(text, g.end())
            if n and _is_given(n[0]):
                end, more = n.end(), more or "\n" not in g[0]
                continue
            if n and _surname_like(n[0], cased and "\n" not in g[0], is_file):
                end, has = n.end(), True
            break
        start = s
        # backward: "SURNAME, Given" or "surname given"
        if not has:
            b = _BEFORE.search(text, max(0, s - 60), s)
            if b and b[1].lower() not in NAMES and _surname_like(b[1], cased and "," in b[2], is_file):
                start, has = b.start(1), True
                end = e if not _INITIAL.match(text, e) and end == e else end
            elif more:  # the last of several given names is the surname
                has = True
        if has:
            t = _TITLED.search(text, max(0, start - 24), start)
            spans.append((start - len(t[1]) if t else start, end))
            done = end
    for s, e in _places(toks & _TITLE_SET, low):
        if any(a < e and s < b for a, b in spans) or text[max(0, s - 4):s].rstrip()[-1:].isdigit():  # a unit: 12 ms
            continue
        m = _AFTER_TITLE.match(text, e)
        if m and _surname_like(m["n"], text[s].isupper() and _is_cased(text[max(0, s - 150):e + 150])):
            spans.append((s, m.end()))
    yield from spans


def _clean_source_email(value: str) -> int:
    """Characters of a file name's leading parts that an address in it has swallowed."""
    lead = re.match(r"(?:\d+_)?(?:(?:mail|e-mail|email|letter|note|from|to|cc|re|fwd|of|copy)_)*", value, re.I)
    return lead.end()


def find(text: str | None, is_file: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the values in ``text``, left to right, none overlapping. ``is_file``: a file name."""
    if not text:
        return []
    if is_file:
        stem = text.rsplit(".", 1)[0] if re.search(r"\.\w{1,5}$", text) else text
        text = stem
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    toks = set(low.translate(_TO_BLANK).split())
    taken: list[tuple[int, int, str]] = []

    def add(s: int, e: int, kind: str) -> None:
        if e > s and not any(a < e and s < b for a, b, _ in taken):
            taken.append((s, e, kind))

    if "@" in low or "at" in toks and ("dot" in toks or _AT.search(low)):
        for m in EMAIL.finditer(text):
            s = m.start() + (_clean_source_email(m[0]) if is_file else 0)
            add(s, m.end(), "email")
    shown = text
    if is_file:
        shown = text.replace("_", " ")
        if _CV.match(shown):
            shown = shown.replace("-", " ")
    low_shown = low if shown is text else shown.lower()
    for at, end in _places(toks & (_EN_SET | _SHORT_SET), low_shown):
        short = low_shown[at:end] in _SHORT_SET
        if short and not (shown[at].isupper() and shown[at + 1].islower()):
            continue
        m = EN_BEFORE.search(shown, max(0, at - 80), at)
        if m and not _NO_STREET_AFTER.match(low_shown, end):
            end = _DIRECTION.match(shown, end).end() if short else end
            add(m.start(), TAIL.match(shown, end).end(), "address")
    if not toks.isdisjoint(_FR_SET):
        for m in ADDRESS_FR.finditer(shown):
            add(*m.span(), "address")
    if not toks.isdisjoint(_ES_SET) or "c/" in low:
        for m in ADDRESS_ES.finditer(shown):
            add(*m.span(), "address")
    if not toks.isdisjoint(_IT_SET):
        for m in ADDRESS_IT.finditer(shown):
            add(*m.span(), "address")
    if any(w.endswith(_DE_ENDS) for w in toks):
        for m in DE_STREET.finditer(shown):
            stem = _LAST_WORD.search(shown, max(0, m.start() - 40), m.start())
            if stem[0]:
                add(stem.start(), m.end(), "address")
    if not toks.isdisjoint(_DE_LEADS):
        for m in DE_LEAD.finditer(shown):
            add(*m.span(), "address")
    for at, end in _places(toks & _ID_WORDS, low_shown):
        need = ID_CUES[low_shown[at:end]]
        if need and not need.search(low_shown, max(0, at - 24), at):
            continue
        m = ID_AFTER.match(shown, end)
        if m and sum(map(str.isdigit, m["v"])) >= 6 and not _DATE.fullmatch(m["v"]) and not _NO_ID.search(_SEGMENT.split(shown[max(0, at - 16):at])[-1] + shown[end:m.start("v")]):
            add(*m.span("v"), "id_number")
    for m in PHONE.finditer(shown):
        s, e = m.span()
        if m[0].endswith(")") and "(" not in m[0]:
            e -= 1
        lead = shown[max(0, s - 16):s]
        if 7 <= sum(map(str.isdigit, m[0])) <= 17 and not _DATE.fullmatch(m[0]) and not _NO_ID.search(lead.rpartition(". ")[2]):
            add(s, e, "phone")
    if not toks.isdisjoint(NAMES) or not toks.isdisjoint(_TITLE_SET):
        for s, e in _persons(shown, low_shown, toks, is_file):
            add(s, e, "person")
    if not is_file:
        for s, e in _unlisted(shown):
            add(s, e, "person")
    return sorted(taken)


def detect_rows(df: DataFrame, fields: tuple[str, ...] = ("text", "source"), key: str = "chunk_no", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, field, pii_kind, nth, start, end, value) of every value in ``fields``; the field ``source`` is a file
    name, ``carry`` names long columns that come along.

    nth counts the values of a kind in a field from 1, left to right. Null and empty fields have none. Repeated rows
    are searched each; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_words()  # without a vocabulary no row is searched, whether it needs the words or not
        cached = lru_cache(maxsize=4096)(lambda t: find(t, True))  # file names recur
        for b in batches:
            out: list[list] = [[] for _ in names]
            heads = list(zip(*(b.column(i).to_pylist() for i in range(1 + len(carry)))))
            for n, field in enumerate(fields, 1 + len(carry)):
                for head, t in zip(heads, b.column(n).to_pylist()):
                    nth: dict[str, int] = {}
                    for s, e, kind in (cached(t) if field == "source" else find(t)) if t else ():
                        nth[kind] = nth.get(kind, 0) + 1
                        for c, v in zip(out, (*head, field, kind, nth[kind], s, e, t[s:e])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in texts else pa.int64()) for c, n in zip(out, names)], names=names)

    names, texts = ["key", *carry, "field", "pii_kind", "nth", "start", "end", "value"], ("field", "pii_kind", "value")
    rows = df.select(F.col(key).cast("long").alias("key"), *carry, *(F.col(f).cast("string").alias(f) for f in fields))
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n in texts else 'long'}" for n in names)).withColumnRenamed("key", key)


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, new in spans:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def _put_back(new: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text before :func:`_replace`, from the new text and (start, end, surrogate, value) of the old one."""
    moved, shift = [], 0
    for s, e, put, value in spans:
        moved.append((s + shift, s + shift + len(put), value))
        shift += len(put) - (e - s)
    return _replace(new, moved)


def redact(df: DataFrame, fields: tuple[str, ...] = ("text", "source"), key: str = "chunk_no") -> DataFrame:
    """(key, fields) with each value replaced by a typed placeholder such as ``[PERSON]``; all else is unchanged. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_words()
        for b in batches:
            cols = [b.column(0)]
            for n, field in enumerate(fields, 1):
                cols.append(pa.array([t and _replace(t, [(s, e, f"[{k.upper()}]") for s, e, k in find(t, field == "source")]) for t in b.column(n).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", *fields])

    rows = df.select(F.col(key).cast("long").alias("key"), *(F.col(f).cast("string").alias(f) for f in fields))
    return rows.mapInArrow(run, "key long, " + ", ".join(f"{f} string" for f in fields)).withColumnRenamed("key", key)


# ---- surrogates -----------------------------------------------------------------------------------------------------

#: Draws of a unit's own format; each further one is a character longer, so that no number space can be full.
DRAWS = 16
HOT_PARTS = 1000


def units_of(kind: str, value: str) -> list[str]:
    """What is replaced alike wherever it occurs, whatever its spelling: the words of a name that are no listed given
    names, titles or initials; else the whole value."""
    low = value.lower()
    if kind == "person":
        return [w for w in dict.fromkeys(_WORD.findall(low)) if w not in _TITLE_SET and len(w) > 1 and w not in NAMES and w not in PARTICLES]
    if kind == "email":
        low = re.sub(r"\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s", "@", low)
        return [re.sub(r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s", ".", low)]
    if kind == "phone":
        return [re.sub(r"\D", "", low)]
    return [" ".join(re.findall(r"[^\W_]+", low)) if kind == "address" else re.sub(r"[\W_]", "", low)]


class _Draw:
    """Endless keyed choices for one unit and attempt."""

    def __init__(self, key: bytes, kind: str, unit: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\x00{unit}\x00{attempt}".encode(), "sha256").digest()
        self.i = 0

    def below(self, n: int) -> int:
        self.i += 1
        return int.from_bytes(blake2b(self.i.to_bytes(4, "big"), key=self.seed, digest_size=8).digest(), "big") % n


_ONSET = "b br d dr f fl g gr h k kl l m n p pr r s st t tr v w".split()
_VOWEL = "a e i o u au ei ie".split()
#: Letters of other scripts for names written in them.
_SCRIPTS = {"CYRILLIC": "абвгдезиклмнопрстуя", "GREEK": "αβγδεηικλμνοπρστυ", "ARABIC": "ابتدرزسعفقكلمنهوي", "HEBREW": "אבגדהוזחטיכלמנסעפצקרשת"}


def _invent(d: _Draw, word: str, syllables: int = 2, ending: bool = True) -> str:
    import unicodedata

    script = unicodedata.name(word[:1] or "a", "LATIN").split()[0]
    if script in _SCRIPTS:
        return "".join(_SCRIPTS[script][d.below(len(_SCRIPTS[script]))] for _ in range(max(4, len(word)) + syllables - 2))
    if ord(word[:1] or "a") > 0x2E7F:
        return "".join(chr(0x4E00 + d.below(0x2000)) for _ in range(len(word) + syllables - 2))
    return "".join(_ONSET[d.below(len(_ONSET))] + _VOWEL[d.below(len(_VOWEL))] for _ in range(syllables)) + (SURNAME_ENDINGS[d.below(len(SURNAME_ENDINGS))] if ending else "n")


def _like(model: str, new: str) -> str:
    return new.upper() if model.isupper() and len(model) > 1 else new.title() if model[:1].isupper() else new


@lru_cache(maxsize=64)
def _turned(key: bytes, names: tuple[str, ...]) -> dict[str, str]:
    """A keyed permutation of listed words in which none stays as it is."""
    order = sorted(set(names), key=lambda w: hmac.new(key, w.encode(), "sha256").digest())
    return dict(zip(order, order[1:] + order[:1]))


def _initial(key: bytes, letter: str) -> str:
    return _turned(key, tuple("abcdefghijklmnopqrstuvwxyz")).get(letter, letter)


def _street(d: _Draw, word: str, syllables: int) -> str:
    """A word of an address: kinds of streets and their endings stay, numbers keep their length."""
    if word in _STREET_WORDS:
        return word
    if any(map(str.isdigit, word)):
        return _scramble(d, word)
    end = max((e for e in _DE_ENDS if word.endswith(e) and len(word) > len(e) + 1), key=len, default="")
    return _invent(d, word, syllables, not end) + end


def draw(kind: str, unit: str, key: bytes, attempt: int) -> str:
    """The surrogate of a unit at an attempt, in lower case and with as many words as the unit."""
    d = _Draw(key, kind, unit, attempt)
    more = max(0, attempt - DRAWS)
    syllables = 2 + attempt // 4
    if kind == "person":
        return _invent(d, unit, syllables)
    if kind == "email":
        return f"{_invent(d, 'a', syllables)}{d.below(1000)}@mail{d.below(10_000)}.example"
    if kind == "address":
        words = unit.split()
        return " ".join(_street(d, w, syllables) for w in words) + "".join(str(d.below(10)) for _ in range(more))
    return _scramble(d, unit) + "".join(str(d.below(10)) for _ in range(more))


_STREET_WORDS = _STREETS | frozenset(PARTICLES) | {"flat", "des", "du", "am", "an", "im", "zum", "zur", "auf", "dem", "unter", "nw", "ne", "sw", "se"}


def _scramble(d: _Draw, s: str) -> str:
    """Digits for digits and letters for letters; zeros in front of a number stay, as they are its format."""
    body = s.lstrip("0")
    if len(body) < len(s) // 2:
        body = s[1:]
    return s[:len(s) - len(body)] + "".join(str(d.below(10)) if c.isdigit() else chr(97 + d.below(26)) if c.isalpha() else c for c in body)


def render(kind: str, value: str, new: dict[str, str], key: bytes) -> str:
    """``value`` with its units replaced, in its own format: word order, case, separators, written-out forms, titles."""
    if kind == "person":
        female, male = _turned(key, tuple(FEMALE)), _turned(key, tuple(MALE))

        def word(m: re.Match) -> str:
            w = m[0].lower()
            if w in _TITLE_SET or w in PARTICLES:
                return m[0]
            return _like(m[0], new.get(w) or female.get(w) or male.get(w) or (_initial(key, w) if len(w) == 1 else w))

        return _WORD.sub(word, value)
    (got,) = new.values()
    if kind == "email":
        at = re.search(r"@|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s", value)
        dot = re.search(r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s", value)
        name, _, host = got.partition("@")
        out = name + (at[0] if at else "@") + (host.replace(".", dot[0]) if dot else host)
        return out.upper() if value.isupper() else out
    if kind == "address":
        words = iter(got.split())
        return re.sub(r"[^\W_]+", lambda m: _like(m[0], next(words, m[0])), value)
    chars = iter(got)
    wanted = str.isdigit if kind == "phone" else str.isalnum
    out = "".join((c := next(chars, v)).upper() * v.isupper() or c if wanted(v) else v for v in value)
    return out + "".join(chars)


def mentions(df: DataFrame, fields: tuple[str, ...] = ("text", "source"), key: str = "chunk_no") -> DataFrame:
    """:func:`detect_rows` once for each different row of a key, with ``content`` (hash of its fields) and ``units``."""
    rows = df.select(F.col(key).cast("long").alias("key"), *(F.col(f).cast("string").alias(f) for f in fields))
    found = detect_rows(rows.withColumn("content", F.xxhash64(*fields)), fields, "key", ("content",))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values = b.column(b.schema.get_field_index("pii_kind")).to_pylist(), b.column(b.schema.get_field_index("value")).to_pylist()
            units = pa.array([units_of(k, v) for k, v in zip(kinds, values)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, units], names=[*b.schema.names, "units"])

    return found.mapInArrow(split, ", ".join(f"{n} {t}" for n, t in found.dtypes) + ", units array<string>")


def surrogates(units: DataFrame, secret: str) -> DataFrame:
    """(pii_kind, unit, new): one surrogate for each of the distinct ``units`` (pii_kind, unit), none shared within a kind
    and none equal to a unit.

    What equals a unit or a settled surrogate, or is drawn twice in a round (the least unit keeps it), is drawn again;
    settled ones are never touched again, so later rounds are as small as the clashes. After DRAWS rounds a draw is a
    character longer each time, so the rounds end however full a format's space is.
    """
    key = secret.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [draw(k, u, key, a) for k, u, a in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["pii_kind", "unit", "attempt", "new"])

    todo, done = units.select("pii_kind", "unit").withColumn("attempt", F.lit(0)), None
    real = units.select("pii_kind", F.col("unit").alias("new"))
    while True:
        drawn = materialize(todo.mapInArrow(run, "pii_kind string, unit string, attempt int, new string"), "drawn")
        taken = real if done is None else real.unionByName(done.select("pii_kind", "new"))
        free = drawn.groupBy("pii_kind", "new").agg(F.min("unit").alias("unit")).join(taken, ["pii_kind", "new"], "left_anti")
        won = materialize(free.select("pii_kind", "unit", "new"), "surrogates")
        done = won if done is None else done.unionByName(won)
        lost = drawn.join(won.select("pii_kind", "unit"), ["pii_kind", "unit"], "left_anti")
        todo = lost.select("pii_kind", "unit", (F.col("attempt") + 1).alias("attempt"))
        if lost.isEmpty():
            return done


def replaced(df: DataFrame, secret: str, fields: tuple[str, ...] = ("text", "source"), key: str = "chunk_no") -> tuple[DataFrame, DataFrame]:
    """(values, surrogates): (key, content, field, pii_kind, nth, start, end, value, new) of every value, each with its
    surrogate, and the table of :func:`surrogates`.

    Units are reduced before they are shuffled; the at most HOT_PARTS units that more than a 1 / HOT_PARTS part of all
    mentions hold get theirs by broadcast, the others by a join.
    """
    found = materialize(mentions(df, fields, key), "pii")
    units = materialize(found.select("pii_kind", F.explode("units").alias("unit")).groupBy("pii_kind", "unit").agg(F.count(F.lit(1)).alias("n")), "units")
    drawn = surrogates(units, secret)
    often = max(int(units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT_PARTS, 1000)
    told = drawn.join(units, ["pii_kind", "unit"])
    place = ["key", "content", "field", "pii_kind", "nth", "start", "end", "value"]
    rows = found.select(*place, F.explode_outer("units").alias("unit"))
    hot = F.broadcast(units.where(F.col("n") > often).select("pii_kind", "unit", F.lit(True).alias("hot")))
    marked = rows.join(hot, ["pii_kind", "unit"], "left")
    warm = marked.where("hot").drop("hot").join(F.broadcast(told.where(F.col("n") > often).drop("n")), ["pii_kind", "unit"])
    cold = marked.where("hot is null").drop("hot").join(told.where(F.col("n") <= often).drop("n"), ["pii_kind", "unit"], "left")
    whole = warm.unionByName(cold).groupBy("key", "content").agg(F.collect_list(F.struct(*place[2:], "unit", "new")).alias("all"))
    code = secret.encode()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(n, pa.int64() if n in ("key", "content", "nth", "start", "end") else pa.string()) for n in [*place, "new"]])
        for b in batches:
            out = []
            for k, c, row in zip(*(x.to_pylist() for x in b.columns)):
                values: dict[tuple, dict[str, str]] = {}
                for x in row:
                    got = values.setdefault(tuple(x[n] for n in place[2:]), {})
                    if x["unit"] is not None:
                        got[x["unit"]] = x["new"]
                out += [(k, c, *v, render(v[1], v[5], new, code)) for v, new in values.items()]
            cols = list(zip(*out)) if out else [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, shape.types)], schema=shape)

    return whole.mapInArrow(put, ", ".join(f"{n} {'long' if n in ('key', 'content', 'nth', 'start', 'end') else 'string'}" for n in [*place, "new"])), drawn


def pseudonymise(df: DataFrame, secret: str, fields: tuple[str, ...] = ("text", "source"), key: str = "chunk_no", back: bool = False) -> DataFrame:
    """(key, fields) with each value replaced by its surrogate in the value's own format; all else is unchanged.

    Rows of one key stay apart. Rows without a value are as they were, null fields stay null. With ``back`` the values are
    put back where their surrogates stand in the new text: the original comes out, if nothing else was touched.
    """
    new, _ = replaced(df, secret, fields, key)
    spans = new.groupBy("key", "content").agg(F.collect_list(F.struct("field", "start", "end", "value", "new")).alias("_spans"))
    rows = df.select(F.col(key).cast("long").alias("key"), *(F.col(f).cast("string").alias(f) for f in fields)).withColumn("content", F.xxhash64(*fields))
    rows = rows.join(spans, ["key", "content"], "left").select("key", *fields, "_spans")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(fields) + 1).to_pylist()
            cols = [b.column(0)]
            for i, f in enumerate(fields, 1):
                own = [sorted((x["start"], x["end"], x["new"], x["value"]) for x in s or () if x["field"] == f) for s in spans]
                new = [t and _replace(t, [x[:3] for x in s]) for t, s in zip(b.column(i).to_pylist(), own)]
                cols.append(pa.array([t and _put_back(t, s) for t, s in zip(new, own)] if back else new, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", *fields])

    return rows.mapInArrow(swap, "key long, " + ", ".join(f"{f} string" for f in fields)).withColumnRenamed("key", key)


def clashes(drawn: DataFrame) -> DataFrame:
    """(pii_kind, shared, real): surrogates that two units have, and surrogates that are units themselves; both must be 0."""
    units = drawn.select("pii_kind", F.col("unit").alias("new"), F.lit(1).alias("real"))
    return drawn.groupBy("pii_kind", "new").agg(F.count(F.lit(1)).alias("n")).join(units, ["pii_kind", "new"], "left").groupBy("pii_kind").agg(
        F.sum(F.col("n") - 1).alias("shared"), F.coalesce(F.sum("real"), F.lit(0)).cast("long").alias("real")
    )
