"""Personal information in free text: weak supervision.

Candidate spans are found by generous patterns: anything written like an
address, a long number, a run of capitalised words. For each kind several
labelers (pattern, gazetteer and context rules) vote for, against or abstain.
The votes of all documents are counted by pattern, and
expectation-maximisation estimates how reliable each labeler is and with it
how likely each pattern is right. These estimates label a bounded sample of
spans, on whose tokens, shape and context a logistic span classifier is
trained; it decides every span. So a name, street or number that is in no list
is found by how it is written and what stands beside it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.session import cut

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person": "[PERSON]"}

# Common given names of several languages: the default gazetteer of one labeler; candidates do not depend on it.
GIVEN_NAMES = frozenset(
    """adam adrian ahmed albert alejandro alex alexander alice amelia ana andrea andreas andrew angela anna anne antonio
    arthur barbara ben bernard brian camille carla carlos carmen carol catherine charles charlotte chloe christian christine
    clara claire claude daniel david diana dmitri edward elena elizabeth emily emma eric erik ernst eva fatima felix fiona
    francisco frank franz george greta hanna hannah heidi helen helena henry hiroshi ian ibrahim ingrid isabel jack jacques
    james jan jane jennifer joan joao john jorge jose joseph juan julia julio karen karl katya kenji kofi laura leo liam
    liesel linda lisa louise lucas lucia luis luisa manuel marc marco margaret maria marie mark marta martin mary matteo
    matthew max mei michael miguel mohammed monica nadia nancy natalia nicolas nicole nina noah oliver olga oscar otto pablo
    patricia paul paula pedro peter philip pierre priya quentin rachel rafael ralf raul rebecca richard robert roberto rosa
    ruth sabine samuel sandra sara sarah sebastian simon sofia sophia sophie stefan stephen susan svetlana sylvie teresa
    thomas tim tomas ursula valentina vera victor victoria vincent walter wanda wei werner william wolfgang xavier yuki
    yusuf yvonne zoe""".split()
)

_L, _U = "a-zß-öø-ÿāăąćčďđēęěğīłńňōőœřśşšťūůűźżž", "A-ZÀ-ÖØ-ÞĀĆČĐĘŁŃŒŚŞŠŹŻŽ"
_CAP = f"[{_U}][{_L}'’]+"
_SUR = f"(?:(?:Mc|Mac|O['’]|D['’])?{_CAP}(?:-{_CAP})*|[{_U}]{{2,}}(?:-[{_U}]{{2,}})*)"
_PARTICLE = r"(?:von|van|de|del|della|di|da|du|le|la|der|den|ten|zu|bin|al)"
#: Characters beside a span that context rules and features may look at.
CONTEXT = 64

_EMAIL = re.compile(
    r"""[A-Za-z0-9][\w.+%-]*(?:
      (?:@|\&\#0*64;|\&\#[xX]40;|\&commat;)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}
    | [ ]@[ ](?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}
    | [ ]?(?:[(\[{][ ]?(?:at|AT|@|arroba)[ ]?[)\]}]|[ ](?:AT|at)[ ])[ ]?[A-Za-z0-9-]+(?:(?:\.|[ ]?[(\[{][ ]?(?:dot|DOT|punkt|point|punto)[ ]?[)\]}][ ]?|[ ](?:DOT|dot)[ ])[A-Za-z0-9-]+)+
    )""",
    re.X,
)
_EMAIL_SIGN = re.compile(r"@|&#0*64;|&#[xX]40;|&commat;|[(\[{] ?(?:at|AT|arroba) ?[)\]}]| AT | at (?=[\w-]+ dot )")
_LOCAL = re.compile(r"[\w.+%-]")
_NUMBER = re.compile(r"(?<![\w.@/#+-])(?:\+|\(\+?)?\d(?:[ .()/–-]{0,3}\d){7,17}(?:[ ]?(?:ext|x|Durchwahl|poste)\.?[ ]?\d{1,5})?(?!\w|[.-]\d)")
_PHONE_FORM = re.compile(
    r"""(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ ./-]?\d){6,11}
    | 1?[ .-]?\(?[2-9]\d{2}\)?[ .-]?\d{3}[ .-]?\d{4}(?:[ ]?(?:ext|x)\.?[ ]?\d+)?
    | 0\d(?:[ .]\d\d){4} | 0\d{2,4}[ ]\d{3,4}[ ]\d{3,4} | \(?0\d{2,5}\)?[ ]?/[ ]?\d{3,8}(?:-\d{1,5})? | [6-9]\d{2}[ ]\d{2,3}[ ]\d{2,3}(?:[ ]\d{2,3})?
    | 1[2-9]\d{9}""",
    re.X,
)
_ID_CUE = re.compile(
    r"(?i)(?:passport|passeport|pasaporte|reisepass|\bID[ -]?card|identity|identit|ausweis|\bDNI\b|\bNIE\b|\bNIF\b|\bSSN\b|social security|tax[ -]?(?:id|number|no)|\bTIN\b|steuer|insurance|versicherung|sécurité sociale|seguridad social|national id|licen[cs]e|führerschein|permis de conduire|carnet de conducir|\bNHS\b|\bNINO\b)[^\n\d]{0,24}$"
)
_ID_VALUE = re.compile(r"(?<![\w.@/+-])#?(?:[A-Z]{1,5}(?=\d)|[A-Z]{2} (?=\d\d ?\d\d ?\d\d ?[A-Z]))?\d(?:[ -]?\d){4,13}(?:[ -]?[A-Z])?(?!\w|[.-]\d)")
_ID_FORM = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{5}\d{7}|[A-Z]{1,2}\d{6,9}|\d{8}[A-Z]|\d{6}-\d{5}-[A-Z]|\d{2} \d{3} \d{3} \d{3}|#?\d{9}")
_OTHER_CUE = re.compile(r"(?i)(?:\bISBN|\bISSN|ticket|\bpages?|\bbuild|\bversion|commit|total|coordinates|order|invoice|\bline|\bsize|issue|count|edition|\bbox|chapter|section|since|in the year)[\s:#.-]*(?:no\.?|nr\.?)?[ ]?$")
_OTHER_AFTER = re.compile(r"[ ]?(?:%|°)|[ ](?:pages|items|pieces|copies|km|kg|cm|mm|EUR|USD|of)\b")
_PHONE_CUE = re.compile(r"(?i)(?:\bt(?:el|él|elefon|eléfono|éléphone)?\b|phone|mobile|handy|fax|\btext\b|\bcall|\bring|llamar|rückruf|anrufen|appeler|reach|dial|\bnumber)\W{0,3}(?:\w{1,6}[ ])?$")
_NEAR_START = re.compile(r"(?:^|\n)[\s>*|-]*(?:<[^<>]*>)*[ ]*$")

_STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Drive|Court|Ct|Way|Boulevard|Blvd|Place|Square|Terrace|Crescent|Gardens|Row|Hill|Walk|Parade)"
_WAY = r"(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Cc]hemin|[Pp]lace|[Aa]llée|[Ii]mpasse|[Qq]uai|[Rr]oute|[Cc]ours|[Cc]alle|[Aa]venida|Avda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|C/|[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Rr]ua|[Tt]ravessa|[Uu]l\.|[Uu]lica)"
_OF = r"(?:(?:de[ ]la|de[ ]l['’]|de[ ]los|des|del|della|de|du|da|do|dos|di)[ ]|d['’])?"
# What is written like an address: a box with its number, or a number beside capitalised words or a word for a way.
_ADDRESS = re.compile(
    rf"""(?<![\w.])(?:
      (?P<box>P\.?[ ]?O\.?[ ]?Box|Post[ ]Office[ ]Box|Postfach|Apartado(?:[ ]de[ ][Cc]orreos)?|Bo[iî]te[ ]postale|B\.?P\.)[ ]*(?:n[.º°]?[ ]?)?\d+
    | (?:(?:Flat|Apt\.?|Apartment|Suite|Unit)[ ]\d+[A-Za-z]?,[ ](?:{_CAP}[ ](?:House|Court|Building),[ ])?)?\d{{1,5}}[A-Za-z]?(?:[ ](?:bis|ter|quater))?,?[ ](?:{_WAY}[ ]{_OF}[{_U}][\w'’-]+|{_CAP}(?:[ ]{_CAP}){{0,3}})
    | {_WAY}[ ]{_OF}{_CAP}(?:[ ](?:{_OF}){_CAP}){{0,2}},?[ ](?:n\.?[º°]?[ ]?)?\d{{1,5}}[A-Za-z]?(?!\w)
    | {_CAP}(?:[ ]{_CAP}){{0,2}}\.?[ ]\d{{1,4}}[ ]?[a-z]?(?![\w.:%/-]\w|\w)
    )""",
    re.X,
)
_NUMBERED_LINE = re.compile(r"(?m)^[^\n\d]*\d[^\n]*")
_STREETLIKE = re.compile(rf"[{_L}](?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|gatan|vägen|straat|laan|gracht|vej|gade)[ ]\d|(?<![\w]){_WAY}[ ]|[ ]{_STREET}(?:\b|\.)")
_ADDRESS_CUE = re.compile(r"(?i)(?:\bhome|address\w*|adresse|dirección|domici\w+|wohnhaft|\bwohnt|deliver|lieferung|\bship|moved|\bsend\w*|\blives?|living|anschrift|senden|schicken|envoyer|enviar|vive|habite|located|visit)\W{0,3}(?:(?:go[ ])?(?:at|to|in|an|à|en|nach|bei|is|:)[ :]*)?$|\b(?:go|come)[ ]to[ ]$")
_TOWN = re.compile(rf"\.?,?[ .]*(?:(?:House|Apt\.? \d+|\d+\.º [A-Z]|Rd\.),? ?)*(?:[ ]?\d{{4,5}})?[, ]+{_CAP}")
_NOT_PLACE = re.compile(r"[ .](?:survey|map|chart|station|edition|page|units|note|report)s?\b")
_NOT_NUMBER = re.compile(r"(?i)(?:page|section|chapter|line|version|build|in the year|since|in|table|figure|part|vol\.?|no\.?)[ ]$")
_NUMBERED = re.compile(r"(?i)(?:page|section|chapter|line|version|build|table|figure|part|volume|vol|issue|total|step|item|note|january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\b")

_TITLES = ("Dr", "Mr", "Mrs", "Ms", "Miss", "Prof", "Mme", "Mlle", "Herr", "Frau", "Sr", "Sra", "Srta", "Don", "Doña", "Sir", "Dame", "Señor", "Señora")
_TOKEN = rf"(?:(?:{'|'.join(_TITLES)})\.|(?:[{_U}]\.)+|{_SUR})"
# A run of capitalised words, initials and titles on one line, particles inside it.
_RUN = re.compile(rf"(?<![\w@.&#/-]){_TOKEN}(?:[ ](?:{_PARTICLE}[ ]){{0,2}}{_TOKEN})+(?![\w@]|[.]\w)")
_COMMA = re.compile(rf",[ ](?=[{_U}][{_L}])")
_NAME_SIGN = re.compile(rf"[{_L}{_U}'’-]")
_REVERSED = re.compile(rf"(?<![\w@.-])({_SUR}),[ ]({_CAP})(?:[ ][{_U}]\.)*(?!\w)")
_PERSON_CUE = re.compile(r"(?i:\b(?:author|by|von|par|por|thanks to|thank|ask|meet|meeting|met|call(?:ed)?|tell|told|firmado|signé|signed|gezeichnet|gez\.|autor|auteur|verfasser|contact|kontakt|contacto|and|with|mit|avec|con|from|to|dear|hello|hi|regards|fragen sie|demander à)[ :,]*|(?:^|\n)-- ?)$")
_MARK = re.compile(r"<[^<>]*>")
_PERSON_AFTER = re.compile(r"(?:[ ](?:said|says|wrote|writes|called|asked|agreed|noted|told|thinks|lives|lived|joined|will|dijo|sagte|dit|a écrit|escribió|schrieb|hat|has|had|was|is)\b)")
_PLACE_BEFORE = re.compile(r"\b(?:Port|Saint|St\.?|Sankt|San|Santa|Mount|Mt\.?|Lake|Cape|Fort|Point|Camp|Isla|Île|Villa|Rue|rue de|Calle|Institute|University of|Bay of|the|The)[ ]$")
_PLACE_FIRST = ("port ", "saint ", "st. ", "sankt ", "san ", "santa ", "mount ", "mt. ", "lake ", "cape ", "fort ", "point ", "camp ", "isla ", "île ", "villa ", "rue ", "calle ", "via ", "rua ")
_PLACE = frozenset("bay street avenue lane road river lake island valley harbour house bridge park college university institute foundation museum library prize award press handbook festival survey square station archive mountain peninsula railway conference commission committee department association laboratory observatory monastery reservoir collection society company ministry office school church county district".split())
# Words that begin sentences or sections and are no part of a name: articles, pronouns, prepositions, conjunctions,
# question words, and words of the outer form of texts.
_COMMON = frozenset(
    """the a an in on at it its is are was we he she they this that these those and or but if near later notes read each nobody what
    between under after before during since with without for from to by as every which who where when why how see no not our my your his her
    there then here some any all both many most other another such only also just than until while although because so yet still once
    der die das den dem des ein eine einen einem einer und oder aber bei danach warum wenn nach vor im am zu zum zur mit von vom auf aus für über
    unter durch gegen ohne um wer was wie wo jede jeder jedes diese dieser dieses kein keine nicht ich wir sie er es
    la le les un une des et ou mais vers chaque pourquoi dans sur el los las entre par pour avec sans sous chez qui que quoi où quand comment ce cette ces il elle nous vous ils
    una y o pero cerca cada por para en con sin sobre desde hasta quién qué cuándo dónde cómo este esta estos estas ese esa su sus
    house street lane road avenue box bay build version page section chapter part appendix figure table total home ask call contact thanks thank dear hello hi
    author autor auteur verfasser written reported signed signé firmado gezeichnet by samples deliver write reply draft form""".split()
)

#: Labelers by kind; a vote is 1 for, -1 against, 0 no opinion.
N_VOTES = {"email": 5, "phone": 4, "id_number": 5, "address": 5, "person": 7}

#: Weight of the belief that labelers beat chance, as a share of the rarer kind of spans, true or false.
PRIOR_SHARE = 0.3
#: Spans of each kind the classifier is trained on: about so many of the lowest hashes, never more.
TRAIN_SPANS = 20_000
#: Spans of the training sample a feature must stand in.
LEAST_SPANS = 3
#: Turns of classifier and labels.
TURNS = 4


def _line_starts(text: str) -> list[int]:
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def _vote(yes: object, no: object = False) -> int:
    return -1 if no else 1 if yes else 0


@lru_cache(50_000)
def _form(span: str) -> str:
    """How a span is written: runs of capitals, small letters and digits by one sign, the rest as it is."""
    out: list[str] = []
    for c in span:
        sign = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != sign or sign == "9":
            out.append(sign)
    return "".join(out)[:40]


def _beside(before: str, after: str) -> tuple[str, str]:
    """The word or sign before and after a span; '^' and '$' at the ends of a line."""
    b, a = before.rstrip(" >*|_"), after.lstrip(" <*|_")
    if not b or b[-1] == "\n":
        left = "^"
    elif b[-1].isalnum():
        left = re.split(r"[^\w'’]", b)[-1].lower()
    else:
        left = b[-1]
    if not a or a[0] in "\r\n":
        right = "$"
    elif a[0].isalnum():
        right = re.match(r"[\w'’]+", a)[0].lower()
    else:
        right = a[0]
    return left, right


def _features(kind: str, span: str, left: str, right: str) -> str:
    """The features of a span besides its votes: tokens, shape and neighbours, joined by tabs."""
    words = re.findall(r"[^\W\d_]+", span)
    out = ["p=" + left, "n=" + right, "f=" + _form(span), "b=" + left + " " + right]
    if kind in ("person", "address") and words:
        out += ["t=" + words[0].lower(), "u=" + words[-1].lower(), "s=" + words[-1][-3:].lower(), "k=" + str(min(5, len(words)))]
        out += ["w=" + w.lower() for w in words[1:-1]]
    elif words:
        out.append("t=" + words[0][:4])
    return "\t".join(out)


Span = tuple[str, int, int, tuple[int, ...], int, str]


def candidates(text: str, given: frozenset[str] = GIVEN_NAMES) -> list[Span]:
    """(kind, start, end, votes, shape, features) of every candidate span of ``text``."""
    out: list[Span] = []
    mails: list[tuple[int, int]] = []

    def add(kind: str, s: int, e: int, votes: tuple[int, ...], shape: int, before: str, after: str) -> None:
        out.append((kind, s, e, votes, shape, _features(kind, text[s:e], *_beside(before, after))))

    for sign in _EMAIL_SIGN.finditer(text):
        s = sign.start()
        while s > 0 and text[s - 1] == " ":
            s -= 1
        least = mails[-1][1] if mails else 0
        while s > least and _LOCAL.match(text[s - 1]):
            s -= 1
        while s < sign.start() and not (text[s].isascii() and text[s].isalnum()):
            s += 1
        m = _EMAIL.match(text, s)
        if not m or s == sign.start() or m.end() <= sign.start():
            continue
        e = m.end()
        spoken = "@" not in m[0] and "&" not in m[0]
        dotted = re.search(r"(?i)dot|punkt|point|punto", m[0]) is not None
        bare = spoken and not re.search(r"[(\[{]", m[0])
        if bare and not dotted:
            continue
        before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        votes = (
            _vote(not spoken or dotted or "." in m[0], bare and not re.search(r"[ ](?:AT|at)[ ].*[ ](?:DOT|dot)[ ]", m[0])),
            _vote("@" in m[0] and " " not in m[0]),
            _vote(re.search(r"(?i)(?:mail|contact\w*|kontakt|write to|reply-to|écrire à|escribir a|an|to|,)[\s:]*$", before) or _NEAR_START.search(before)),
            _vote(False, before.endswith(("://", "/", "="))),
            _vote(True, re.search(r"(?i)\.(?:png|jpe?g|md|js|py|css|html?)$", m[0])),
        )
        add("email", s, e, votes, int(spoken), before, after)
        mails.append((s, e))
    taken = bytearray(len(text))  # what an earlier kind has claimed; one look-up per span, however long the text
    named = bytearray(len(text))
    mail_ends = {b for _, b in mails}

    def claim(mask: bytearray, s: int, e: int) -> None:
        mask[s:e] = b"\1" * (min(e, len(mask)) - s)

    def claimed(mask: bytearray, s: int, e: int) -> bool:
        return mask.find(1, s, e) >= 0

    for s, e in mails:
        claim(taken, s, e)
        claim(named, s, e)
    numbered = [m.span() for m in _NUMBERED_LINE.finditer(text)]
    if numbered:
        for m in (m for s, e in numbered for m in _ADDRESS.finditer(text, s, e)):
            s, e = m.span()
            before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
            box = m["box"] is not None
            street = box or _STREETLIKE.search(m[0]) is not None
            near = _NEAR_START.search(before) is not None
            cue = _ADDRESS_CUE.search(before) is not None
            town = _TOWN.match(after)
            ends = re.match(r"[ ]*(?:<|\\\\|\r?\n|$|,)", after) is not None
            if not street and not ((near or cue or before.endswith((": ", ", "))) and (ends or town)):
                continue
            votes = (
                _vote(street, not street and not (near or cue)),
                _vote(box or cue),
                _vote(near and (ends or town)),
                _vote(town, _NOT_PLACE.match(after)),
                _vote(False, _NOT_NUMBER.search(before) or _NUMBERED.search(m[0])),
            )
            add("address", s, e, votes, box + 2 * street, before, after)
            if street:
                claim(named, s, e)
                t = re.match(rf"(?:\.?,?[ ](?:Apt\.?[ ]\d+|\d+\.[º°][ ][A-Z]))?,?(?:[ ]\d{{4,5}})?,?[ ]{_CAP}(?:[ ]\d{{4,5}})?", after)
                claim(taken, s, e + (t.end() if t else 0))
        for m in _ID_VALUE.finditer(text):
            s, e = m.span()
            if claimed(taken, s, e):
                continue
            before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
            cue = _ID_CUE.search(before) is not None
            form = _ID_FORM.fullmatch(m[0]) is not None
            if not cue and not form:
                continue
            phone = _PHONE_FORM.fullmatch(m[0]) is not None
            votes = (
                _vote(cue),
                _vote(form),
                _vote(False, _OTHER_CUE.search(before) or _OTHER_AFTER.match(after)),
                _vote(cue, not cue and (phone or _PHONE_CUE.search(before))),
                _vote(re.search(r"[A-Za-z]|-", m[0]) and cue, not cue and not re.fullmatch(r"\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]", m[0])),
            )
            add("id_number", s, e, votes, int(form) + 2 * cue, before, after)
            if cue:
                claim(taken, s, e)
        for m in _NUMBER.finditer(text):
            s, e = m.span()
            if claimed(taken, s, e):
                continue
            digits = sum(c.isdigit() for c in m[0])
            form = _PHONE_FORM.fullmatch(m[0]) is not None
            before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
            cue = _PHONE_CUE.search(before) is not None
            if not form and not cue:
                continue
            beside = before.rstrip().endswith(",") and any(s - gap in mail_ends for gap in range(4))
            votes = (
                _vote(form, not form),
                _vote(cue or beside or _NEAR_START.search(before)),
                _vote(False, _OTHER_CUE.search(before) or _OTHER_AFTER.match(after) or _ID_CUE.search(before)),
                _vote(9 <= digits <= 13, digits > 15 or digits < 7 or re.fullmatch(r"(?:19|20)\d\d[-./]\d\d[-./]\d\d.*", m[0])),
            )
            add("phone", s, e, votes, int(m[0][0] == "+"), before, after)

    # where contact data begin: a person often stands right above or before them
    contacts = sorted([s for s, _ in mails] + [c[1] for c in out if c[0] == "phone" or (c[0] == "address" and c[4])])

    def on_card(e: int) -> bool:
        i = bisect_right(contacts, e)
        return i < len(contacts) and contacts[i] - e <= CONTEXT and sum(map(str.isalpha, _MARK.sub("", text[e : contacts[i]]))) <= 10

    def person(s: int, e: int, name: str, titled: bool, first: bool, initial: bool) -> None:
        if claimed(named, s, e):
            return
        before, after = text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]
        near = _NEAR_START.search(before) is not None
        alone = near and re.match(r"[ ]*(?:<|\\\\|\r?\n|$|,)", after) is not None
        votes = (
            _vote(first),
            _vote(titled or initial),
            _vote(_PERSON_CUE.search(before)),
            _vote(alone),
            _vote(on_card(e) or _PERSON_AFTER.match(after)),
            _vote(False, _PLACE_BEFORE.search(before) or text[s:e].lower().startswith(_PLACE_FIRST) or not _PLACE.isdisjoint(text[s:e].lower().split())),
            _vote(titled or first, name.lower() in _COMMON or len(name) < 3),
        )
        add("person", s, e, votes, titled + 2 * initial + 4 * (text[s:e].count(" ") > 2), before, after)
        claim(named, s, e)

    least = 0
    for comma in _COMMA.finditer(text):
        s = comma.start()
        while s > least and _NAME_SIGN.match(text[s - 1]):
            s -= 1
        least = comma.end()
        m = _REVERSED.match(text, s)
        if not m:
            continue
        e = m.end()
        first = m[2].lower() in given
        if m[1].lower() in _COMMON or m[1].lower() in given or not (first or _NEAR_START.search(text, max(0, s - CONTEXT), s)):
            continue
        person(s, e, m[1], False, first, False)
    for m in _RUN.finditer(text):
        tokens = [(t[0], m.start() + t.start(), m.start() + t.end()) for t in re.finditer(r"[^ ]+", m[0])]
        words = [t[0].rstrip(".") for t in tokens]
        titles = [w in _TITLES for w in words]
        firsts = [w.lower() in given and not w.islower() for w in words]
        n = len(tokens)
        if True in titles[: n - 1]:
            at = titles.index(True)
        elif True in firsts[: n - 1]:
            at = firsts.index(True)
        else:
            at = next((i for i, (t, w) in enumerate(zip(tokens, words, strict=True)) if t[0].endswith(".") or (not w.islower() and w.lower() not in _COMMON)), n)
        if n - at < 2:
            continue
        initial = any(t[0].endswith(".") and not title for t, title in zip(tokens[at:], titles[at:], strict=True))
        person(tokens[at][1], tokens[-1][2] - (tokens[-1][0].endswith(".")), words[-1], titles[at], any(firsts[at : n - 1]), initial)
    return out


def _encode(votes: tuple[int, ...], shape: int) -> str:
    return "".join("-0+"[v + 1] for v in votes) + str(shape)


_PARTS = {"kind": pa.string(), "line_no": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "pattern": pa.string(), "features": pa.string()}


def _lists(rows: list[list[tuple]]) -> list[pa.Array]:
    """Parallel list columns of the spans of each row."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
    flat = list(zip(*[x for r in rows for x in r], strict=True)) or [()] * len(_PARTS)
    return [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(flat, _PARTS.values(), strict=True)]


def _scanned(docs: DataFrame, key: str, text: str, given: frozenset[str], with_text: bool) -> DataFrame:
    """One row per text: its candidates as parallel arrays, the text itself if asked for; written once."""
    key_type = docs.schema[key].dataType.simpleString()
    arrays = ", ".join(f"{n} array<{'int' if k == pa.int32() else 'string'}>" for n, k in _PARTS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = candidates(t, given) if t else []
                starts = _line_starts(t) if found else []
                rows.append([(kind, bisect_right(starts, s), s, e, _encode(votes, shape), features) for kind, s, e, votes, shape, features in found])
            columns = [batch.column(0), *([batch.column(1)] if with_text else []), *_lists(rows)]
            out = pa.RecordBatch.from_arrays(columns, [key, *(["text"] if with_text else []), *_PARTS])
            yield out if with_text else out.filter(pa.array([bool(r) for r in rows]))

    rows = docs.select(key, docs[text].cast("string").alias("text"))
    rows = rows if with_text else rows.filter("text IS NOT NULL")
    return cut(rows.mapInArrow(run, f"`{key}` {key_type}, {'text string, ' if with_text else ''}{arrays}"))


def _flat(scanned: DataFrame, key: str) -> DataFrame:
    return scanned.select(key, F.explode(F.arrays_zip(*_PARTS)).alias("s")).select(key, "s.*")


def span_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", given: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """(key, kind, line_no, start_char, end_char, pattern, features): all candidates with their votes."""
    return _flat(_scanned(docs, key, text, given, False), key)


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote row, reliability [labeler, truth, vote]) by expectation-maximisation.

    votes: rows of -1, 0, 1; weight: how many spans voted so. Labelers are
    taken as independent given the truth, and a Dirichlet prior holds them to
    be better than chance, so that rules which exclude one another do not
    split the true spans in two. It starts from the sum of the votes.
    """
    better = np.array([[0.35, 0.55, 0.10], [0.02, 0.43, 0.55]])
    score = votes.sum(1)
    p = np.select([score > 1, score > 0], [0.95, 0.3], 0.05)
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        prior = min(0.99, max(0.01, float((p * weight).sum() / weight.sum())))
        logs = np.tile(np.log([1 - prior, prior]), (len(votes), 1))
        believed = PRIOR_SHARE * min((p * weight).sum(), ((1 - p) * weight).sum()) * better
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                on = votes[:, j] == v
                table[j, 1, v + 1] = (p * weight)[on].sum() + believed[1, v + 1] + 0.5
                table[j, 0, v + 1] = ((1 - p) * weight)[on].sum() + believed[0, v + 1] + 0.5
            table[j] /= table[j].sum(1, keepdims=True)
            logs += np.log(table[j][:, votes[:, j] + 1]).T
        top = logs.max(1, keepdims=True)
        new = np.exp(logs - top)
        new = new[:, 1] / new.sum(1)
        if np.abs(new - p).max() < 1e-6:
            p = new
            break
        p = new
    return p, table


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows])
    return np.repeat(np.arange(len(rows)), n), np.fromiter((f for r in rows for f in r), np.int64, int(n.sum()))


def scores(rows: list[list[int]], w: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    at, of = _sparse(rows)
    return np.bincount(at, w[of], len(rows)) + w[-1]


def train(rows: list[list[int]], target: np.ndarray, width: int, ridge: float = 0.3, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic classifier with soft targets over rows of feature numbers; the last weight is the bias.

    All rows together, by gradient steps scaled per weight (Adam), so the
    result does not depend on the order of the rows.
    """
    at, of = _sparse(rows)
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, w[of], len(rows)) + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(of, miss[at], width), miss.sum())
        grad[:-1] += ridge * w[:-1]
        grad /= len(rows)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w


def reliabilities(counts: list[tuple[str, str, int]]) -> dict[str, dict[str, tuple[float, float]]]:
    """By kind, of each vote pattern: how likely it is right, and its log likelihood ratio, from (kind, pattern, spans)."""
    out: dict[str, dict[str, tuple[float, float]]] = {k: {} for k in KINDS}
    for kind in KINDS:
        rows = sorted((p, n) for k, p, n in counts if k == kind)
        if rows:
            votes = np.array([["-0+".index(c) - 1 for c in p[: N_VOTES[kind]]] for p, _ in rows])
            p, table = estimate(votes, np.array([float(n) for _, n in rows]))
            ratio = sum(np.log(table[j, 1] / table[j, 0])[votes[:, j] + 1] for j in range(votes.shape[1]))
            out[kind] = {pattern: (float(q), float(x)) for (pattern, _), q, x in zip(rows, p, ratio, strict=True)}
    return out


class Classifier:
    """A logistic span classifier of each kind: feature to weight, and a bias.

    The estimates of the labelers are the first labels. Then classifier and
    labels are worked out in turn: the classifier's belief in a span, from its
    tokens and context, is the prior on which the votes are weighed to label
    the span anew. So what true spans have in common carries over to spans on
    which no gazetteer has an opinion.
    """

    def __init__(self, counts: list[tuple[str, str, int]], sample: list[tuple[str, str, str]], least: int = LEAST_SPANS, turns: int = TURNS):
        """Reliabilities come from ``counts`` of all spans, features from a ``sample`` of (kind, pattern, features)."""
        self.votes = reliabilities(counts)
        self.weights: dict[str, dict[str, float]] = {k: {} for k in KINDS}
        self.bias = dict.fromkeys(KINDS, -30.0)
        for kind in KINDS:
            spans = sorted((p, f.split("\t")) for k, p, f in sample if k == kind)
            if not spans:
                continue
            common = sorted(f for f, n in Counter(f for _, fs in spans for f in set(fs)).items() if n >= min(least, len(spans)))
            number = {f: i for i, f in enumerate(common)}
            rows = [[number[f] for f in fs if f in number] for _, fs in spans]
            target, ratio = np.array([self.votes[kind][p] for p, _ in spans]).T
            for turn in range(turns):
                w = train(rows, target, len(common))
                target = 1 / (1 + np.exp(-np.clip(scores(rows, w) + ratio, -30, 30)))
            self.weights[kind] = {f: float(x) for f, x in zip(common, w, strict=False)}
            self.bias[kind] = float(w[-1])

    def accepts(self, kind: str, pattern: str, features: str) -> bool:
        get = self.weights[kind].get
        return self.bias[kind] + self.votes[kind][pattern][1] + sum(get(f, 0.0) for f in features.split("\t")) > 0


def _trained(spans: DataFrame, key: str) -> Classifier:
    """The classifier: votes counted over all spans, trained on at most TRAIN_SPANS of each kind.

    The vote table that reaches the driver has at most kinds * 3^labelers *
    shapes rows, whatever the corpus.
    """
    counts = [(r[0], r[1], r[2]) for r in spans.groupBy("kind", "pattern").count().collect()]
    of_kind = Counter()
    for kind, _, n in counts:
        of_kind[kind] += n
    # a share of the hashes, known from the counts, so that no task sends more than its part of the sample
    part = 1_000_003
    share = [(F.col("kind") == k) & (F.col("h") < int(part * min(1.0, TRAIN_SPANS / n)) + 1) for k, n in sorted(of_kind.items())]
    if not share:
        return Classifier(counts, [])
    order = F.pmod(F.xxhash64(F.col(key).cast("string"), "start_char", "features"), F.lit(part))
    rows = spans.select("kind", "pattern", "features", order.alias("h")).filter(reduce(lambda x, y: x | y, share)).collect()
    taken, sample = Counter(), []
    for kind, pattern, features, _ in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        taken[kind] += 1
        if taken[kind] <= TRAIN_SPANS:
            sample.append((kind, pattern, features))
    return Classifier(counts, sample)


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", given: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """(key, kind, line_no, start_char, end_char): the accepted spans.

    Texts are read whole; NULL and empty texts have none. Offsets count
    characters from 0, lines from 1, split at line feeds. Candidates are
    written once, with their votes and features; their vote patterns are
    counted over all documents, the classifier is trained, and the written
    candidates are decided.
    """
    scanned = _scanned(docs, key, text, given, False)
    model = _trained(_flat(scanned, key), key)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([model.accepts(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "pattern", "features")), strict=True)], pa.bool_())
            yield batch.select([key, "kind", "line_no", "start_char", "end_char"]).filter(keep)

    return _flat(scanned, key).mapInArrow(run, f"`{key}` {key_type}, kind string, line_no int, start_char int, end_char int")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", given: frozenset[str] = GIVEN_NAMES) -> DataFrame:
    """(key, clean, n_spans): texts with typed placeholders, all else as it was.

    Texts are scanned once and written with their candidates, so that after
    training they are neither scanned again nor shuffled. Of overlapping spans
    the earlier, then longer one is replaced. NULL stays NULL with 0 spans.
    """
    scanned = _scanned(docs, key, text, given, True)
    model = _trained(_flat(scanned, key), key)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, n_spans = [], []
            for t, *found in zip(*(batch.column(c).to_pylist() for c in ("text", "start_char", "end_char", "kind", "pattern", "features")), strict=True):
                spans = sorted((s, -e, k) for s, e, k, p, f in zip(*found, strict=True) if model.accepts(k, p, f))
                parts, at, n = [], 0, 0
                for s, e, k in spans:
                    if s >= at:
                        parts += [t[at:s], PLACEHOLDER[k]]
                        at, n = -e, n + 1
                clean.append(None if t is None else "".join(parts) + t[at:])
                n_spans.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(n_spans, pa.int32())], [key, "clean", "n_spans"])

    return scanned.mapInArrow(run, f"`{key}` {key_type}, clean string, n_spans int")
