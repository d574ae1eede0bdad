"""Finding personal information in free text: e-mail and street addresses, phone and identity numbers, names."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import regex

KINDS = ("email", "id_number", "phone", "address", "person")

_DOT = r"(?:\.|[ ]?[(\[][ ]?dot[ ]?[)\]][ ]?|[ ]dot[ ])"
_LABEL = r"[\p{Latin}0-9](?:[\p{Latin}0-9-]*[\p{Latin}0-9])?"
#: Every e-mail address has one of these; what stands before and after it is then looked at, however long it is.
_EMAIL_AT = regex.compile(rf"@|[ ]?[(\[][ ]?at[ ]?[)\]][ ]?|(?P<word>[ ]at[ ])(?={_LABEL}[ ]dot[ ])", regex.I)
_LOCAL_RUN = regex.compile(r"(?r)[\p{Latin}0-9._%+'’-]+")
_LOCAL = regex.compile(r"(?<![\p{Latin}0-9._%+-])[\p{Latin}0-9](?:[\p{Latin}0-9._%+'’-]*[\p{Latin}0-9_+-])?$")
_DOMAIN = regex.compile(rf"(?:{_LABEL}{_DOT})+\p{{Latin}}{{2,}}(?![\p{{Latin}}0-9])", regex.I)
_SPOKEN_DOMAIN = regex.compile(rf"(?:{_LABEL}[ ]dot[ ])+\p{{Latin}}{{2,}}(?![\p{{Latin}}0-9])", regex.I)

#: Shapes of phone numbers, as they are written in the countries that write them so.
_PHONES = (
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){1,2}(?:[ .-]?\d{2,5}){1,5}",  # +49 30 23125 958, +14155550123
    r"00\d{2}[ .-]\d{2,5}[ .-]\d{3,8}(?:[ .-]\d{2,4})?",  # 0044 1632 960203
    r"\(0\d{1,5}\)[ ]?\d{3,8}(?:[ -]\d{3,4})?",  # (02) 5550 2393, (01632) 960125
    r"\(\d{3}\)[ ]?\d{3}[-. ]\d{4}",  # (415) 555-0121
    r"0\d{2,5}[ ]?/[ ]?\d{3,8}(?:[ -]\d{1,4})?",  # 030 / 23125-540
    r"0\d{4}[ ]\d{3}[ ]?\d{3}",  # 01632 960 073
    r"0\d{2}[ ]\d{4}[ ]\d{4}",  # 020 7946 0958
    r"0\d{3}[ ]\d{3}[ ]\d{4}",  # 0161 496 0123
    r"0\d(?:(?P<a>[ .-])\d\d)(?:(?P=a)\d\d){3}",  # 01 99 00 56 59
    r"(?:1[ .-])?\d{3}(?P<b>[.-])\d{3}(?P=b)\d{4}",  # 415-555-0121, 512.555.0127
)
PHONE = regex.compile(
    "(?<![\\p{L}\\p{N}.,/+-])(?<![\\d][ ])(?:" + "|".join(_PHONES) + ")(?![\\p{L}\\p{N}]|[-./]\\d)"
)
#: The fewest and most digits of a phone number.
PHONE_DIGITS = (9, 15)

#: Words that say that an identity number of a person follows.
_ID_LABELS = (
    r"SSN|social security(?: (?:no\.?|number))?|(?:passport|id|identity|employee|personnel|national id|tax)(?: (?:no\.?|number|card))?"
    r"|national insurance(?: (?:no\.?|number))?|nino|Ausweis(?:nummer|-Nr\.?)?|Personalausweis(?:nummer)?|Passnummer|Sozialversicherungsnummer"
    r"|Documento de identidad|DNI|NIE|N[uú]mero de identidad|pasaporte(?: n\.?[º°])?"
    r"|Num[eé]ro d['’]identit[eé]|carte d['’]identit[eé]|passeport(?: n[º°])?|マイナンバー|身分証番号|個人番号"
)
_ID_SHAPE = (
    r"(?:\p{Lu}{2}[ ]?\d\d[ ]?\d\d[ ]?\d\d[ ]?\p{Lu}|\p{Lu}{1,2}\d{4}-\d{4}|\p{Lu}{1,3}\d{6,9}|\d{3}(?P<c>[- ]?)\d{2}(?P=c)\d{4}|\d{7,9}-?\p{Lu}|\d{8,11})"
)
ID_NUMBER = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?i:{_ID_LABELS})(?:[ ]?(?:on file|given|is|no\.?|number))?[ ]?[:#]?[ \n]{{1,3}}(?P<id>{_ID_SHAPE})(?![\p{{L}}\p{{N}}]|-\d)"
)
#: Numbers that no other kind of number has the form of; a label in front of a device, order or part takes them out.
BARE_ID = regex.compile(
    r"(?<![\p{L}\p{N}-])(?<!(?i:part|number|no\.?|order|serial|lot|batch|s/n|p/n|checksum)[ ]?[:#]?[ \n])"
    r"(?:[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]|\d{3}([- ])\d{2}\1\d{4})(?![\p{L}\p{N}]|-\d)"
)

_STREETS = r"Street|St\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Court|Ct\.?|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd\.?"
_EN_STREET = rf"(?:{_STREETS}|{_STREETS.upper()})"
_CAP = r"\p{Lu}[\p{L}'’-]+"
_PLACE = rf"{_CAP}(?:[ ]{_CAP}){{0,2}}"
_NUMBER = r"\d{1,4}(?:[-–]\d{1,4})?[A-Za-z]?"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Wohnung|Piso|Appt\.?)[ ]\d{1,4}[A-Za-z]?"
# an English place ends at its postcode, or at the text that goes on in small letters or with another sentence
_AFTER_PLACE = r"(?=[.,;:!?)\n]|[ ]\p{Ll}|[ ]*$)"
_EN = (
    rf"(?:{_UNIT},[ ])?{_NUMBER}[ ](?:{_CAP}[ ]){{1,3}}?{_EN_STREET}(?![\p{{L}}\p{{N}}])"
    rf"(?:,[ ]{_UNIT})?(?:,[ ](?:{_PLACE}[ ]\d{{5}}|{_PLACE}{_AFTER_PLACE}))?"
)
_POSTCODE_PLACE = rf"(?:,[ ]\d{{5}}[ ]{_CAP}(?:[ ]{_CAP}(?=[.,;\n]|[ ]\p{{Ll}}|[ ]*$))?)?"
_FR_OF = r"(?i:de la|du|des|de|d['’]|de l['’])[ ]?"
_FR = rf"{_NUMBER},?[ ](?:(?i:rue|chemin|impasse|quai|all[ée]e)[ ](?:{_FR_OF})?|(?i:avenue|boulevard|place)[ ]{_FR_OF}){_CAP}(?:[ ]{_CAP}){{0,2}}{_POSTCODE_PLACE}"
_ES = rf"(?i:Calle|Avenida|Plaza|Paseo|Camino)[ ](?:(?i:de la|del|de los|de las|de)[ ])?{_CAP}(?:[ ]{_CAP}){{0,3}}[ ]{_NUMBER}{_POSTCODE_PLACE}"
_DE = (
    rf"(?:(?i:Am|Zum|Zur|Im|An der|An den|Auf der|In der)[ ]{_CAP}|(?:{_CAP}[ ])?\p{{Lu}}[\p{{L}}-]*(?i:allee|weg|straße|strasse|str\.|gasse|platz|ring|ufer|damm|hang))"
    rf"[ ]{_NUMBER}(?![\p{{L}}\p{{N}}]){_POSTCODE_PLACE}"
)
ADDRESS = regex.compile(rf"(?<![\p{{L}}\p{{N}}-])(?:{_EN}|{_FR}|{_ES})")
GERMAN_ADDRESS = regex.compile(rf"(?<![\p{{L}}\p{{N}}-])(?:{_DE})")

_WORD = r"\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}'’]*)*"
_FULL = r"\p{L}[\p{L}\p{M}'’]+(?:-\p{L}[\p{L}\p{M}'’]+)*"
_INITIAL = r"\p{L}\.(?:[ ]?-?\p{L}\.)*"
_GIVEN = rf"(?:{_INITIAL}|{_FULL}(?:[ ]{_INITIAL})?)"
NAME = rf"(?:{_FULL},[ ]{_GIVEN}(?<![ ])|{_GIVEN}[ ]{_FULL})"
#: Forms of address, by the gender they tell.
_MALE_TITLES, _FEMALE_TITLES = r"Mr|Herr|Hr|Monsieur|Sr|Señor", r"Mrs|Ms|Miss|Frau|Fr|Madame|Mme|Mlle|Sra|Srta|Señora"
# a lone M. is a title only before two words of a name, else it is an initial
_TITLE = rf"(?:(?:(?i:{_MALE_TITLES}|{_FEMALE_TITLES}|Dr|Prof|Ing)\.?|M\.?(?=[ ]\p{{Lu}}[\p{{L}}\p{{M}}'’.-]*,?[ ]\p{{Lu}}))[ ])*"
_MALE = regex.compile(rf"(?i:(?<!\p{{L}})(?:{_MALE_TITLES}|M)\.?[ ](?:(?:Dr|Prof|Ing)\.?[ ])*$)")
_FEMALE = regex.compile(rf"(?i:(?<!\p{{L}})(?:{_FEMALE_TITLES})\.?[ ](?:(?:Dr|Prof|Ing)\.?[ ])*$)")
#: How far before a name its titles are looked for.
_TITLE_ROOM = 40
#: Texts before a person's name; each ends where the name (or its title) begins.
_BEFORE = (
    r"(?i:signed off by|approved by|reviewed[- ]by:?|checked by|witness(?:ed by)?:?|visitor|ask|call|contact|employee:|operator(?: on shift)?:"
    r"|site pass of|attn\.?:?|prepared by|inspected by|name:|report to)[ ]"
    r"|(?i:bediener|ansprechpartner|pr[üu]fer|mitarbeiter)(?:in)?[ ]?:[ ]|(?i:freigabe durch|r[üu]ckfragen (?:bitte )?an)[ ]"
    r"|(?i:op[ée]rateur|op[ée]ratrice|contact|responsable)[ ]?:[ ]|(?i:contacter|valid[ée] par|sign[ée] par)[ ]"
    r"|(?i:operador|operadora|responsable|t[ée]cnico)[ ]?:[ ]|(?i:llamar a|firmado por|preguntar a)[ ]"
)
#: Texts before a name that stand before much else as well: there a name must begin its words with capitals.
_BEFORE_CAPITALS = (
    r"(?i:my name is|his name is|her name is|speak (?:to|with)|talk to|write to|e?-?mail(?: to)?|phone|ring|reach(?: out to)?|meet|ask for|thanks(?: to)?|thank you|on behalf of|handed (?:over )?to|given to"
    r"|assigned to|reported by|performed by|calibrated by|tested by|verified by|released by|issued by|written by|signed by|signed|installed by|repaired by|requested by|received by|issued to"
    r"|technician|engineer|supervisor|manager|inspector|auditor|foreman|apprentice|owner|author|assignee|requester|customer contact|dear|hello|hi|from|cc|to|attention)[ ]?[:,]?[ ]"
    r"|(?i:(?:(?:kind|best|warm) regards|regards|best wishes|best|sincerely|yours(?: sincerely| faithfully| truly)?|cheers|thanks|thank you|mit freundlichen gr[üu](?:ß|ss)en|viele gr[üu](?:ß|ss)e|gru(?:ß|ss)"
    r"|cordialement|bien à vous|saludos|un saludo|atentamente),?[ ]?\n{1,3}[ ]?)"
    r"|(?i:ich hei(?:ß|ss)e|mein name ist|gez\.|geprüft von|erstellt von|je m['’]appelle|rédigé par|vérifié par|me llamo|mi nombre es|revisado por|realizado por)[ ]"
)
#: The same in a script that puts no space between words.
_BEFORE_CJK = r"(?:担当者?|氏名|名前|責任者|作業者|連絡担当|検査員|承認者?|確認者|报告人|负责人|联系人|姓名|담당자|이름|성명)[ ]?[::][ ]?"
_NAME_CJK = r"(?:\p{Han}{1,4}(?:[ 　]\p{Han}{1,3})?|[\p{Katakana}ー]+[・=＝ 　][\p{Katakana}ー]+|\p{Hangul}{2,4})"
#: What may follow a name: the end of a clause, or a word that goes on about it.
_AFTER = (
    r"(?=[ ]*(?:[,;|<>()\[\]{}:!?。、]|\.(?:[\s。]|$)|$|\n|--)"
    r"|[ ](?i:on|at|about|for|before|and|or|was|is|has|will|approved|watched|signed|called|noted|unter|per|am|wurde|au|par|al|en|y|et|und|a|le|the|via|if)\b)"
)
CUED = regex.compile(rf"(?<![\p{{Latin}}\p{{N}}])(?:{_BEFORE}){_TITLE}(?P<name>{NAME}){_AFTER}", regex.M)
CUED_CJK = regex.compile(rf"{_BEFORE_CJK}{_TITLE}(?:(?P<name>{NAME}){_AFTER}|(?P<name>{_NAME_CJK})(?=[ 　]*(?:さん|様|氏|先生|씨|님|[^\p{{L}}]|$)))", regex.M)
_CAPITAL = r"\p{Lu}[\p{Ll}\p{M}'’]+(?:[\p{Lu}][\p{Ll}\p{M}]+)?(?:-\p{Lu}[\p{Ll}\p{M}'’]+)*"
CAPITALS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}'’-])(?:{_CAPITAL},[ ]{_CAPITAL}|(?:{_CAPITAL}|\p{{Lu}}\.)(?:[ ]\p{{Lu}}\.)?(?:[ ]{_CAPITAL}){{1,2}})(?![\p{{L}}\p{{N}}'’-])(?![ ](?:\p{{Lu}}\p{{Ll}}|\d))"
)
_CUE_OF_CAPITALS = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{_BEFORE_CAPITALS}){_TITLE}$")
TITLED = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Hr|Fr|Mme|Mlle|Sr|Sra)\.?[ ](?P<name>{NAME}){_AFTER}", regex.M
)
FOLLOWED = regex.compile(
    rf"(?:^|(?<=[.!?。>\d\]][ ])|(?<=\n))(?P<name>(?:\p{{Lu}}[\p{{L}}'’-]+,[ ])?(?:\p{{Lu}}\.|{_FULL}(?:[ ]\p{{L}}\.)?)(?:[ ]{_FULL})?)[ ](?:approved|signed off|countersigned|reported|waived)[ ]the\b",
    regex.M,
)
SIGNATURE = regex.compile(rf"--[ ]?\n[ ]*(?P<name>{NAME})[ ]*(?=\n|$)")
#: Words no name begins or ends with (small words that can stand after a cue or before what follows a name).
_NOT_NAMES = frozenset(
    "the a an our this that these every please him her them us me all any it its your my his their on at about for before after and or was is has"
    " der die das den dem ein eine und unter le la les un une et au el los las en y al".split()
)
#: Where a costly pattern can match at all; it is then tried at the words before that.
_MAYBE_GERMAN = regex.compile(r"(?i:allee|weg|straße|strasse|str\.|gasse|platz|ring|ufer|damm|hang)[ ]\d|\b(?i:am|zum|zur|im|der|den)[ ]\p{Lu}[\p{L}'’-]+[ ]\d")
_MAYBE_FOLLOWED = regex.compile(r"[ ](?:approved|signed off|countersigned|reported|waived)[ ]the\b")
#: Room before a name for its titles, and for the longest of the cues with them.
_TITLE_ROOM, _CUE_ROOM = 40, 80
_WORDS_BEFORE = regex.compile(r"(?r)(?:[\p{L}\p{M}'’.,-]+[ ]){0,4}[\p{L}\p{M}'’.,-]*")
_WORD_START = regex.compile(r"(?<![\p{L}\p{N}-])\p{L}|(?<=[ ])\p{L}")


@dataclass(frozen=True, slots=True)
class Entity:
    kind: str
    start: int
    end: int
    text: str
    gender: str = ""


def _near(anchor: regex.Pattern, pattern: regex.Pattern, text: str):
    """Matches of a costly pattern that cover an anchor, tried at the starts of the up to five words before it."""
    done = 0
    for at in anchor.finditer(text):
        before = _WORDS_BEFORE.search(text, 0, at.start())
        begin = max(done, before.start() if before else at.start())
        for word in _WORD_START.finditer(text, begin, at.end()):
            found = pattern.match(text, word.start())
            if found and found.end() > at.start():
                done = found.end()
                yield found
                break


def _emails(text: str):
    for at in _EMAIL_AT.finditer(text):
        run = _LOCAL_RUN.match(text, 0, at.start())
        local = _LOCAL.search(run.group()) if run else None
        domain = local and (_SPOKEN_DOMAIN if at.group("word") else _DOMAIN).match(text, at.end())
        if domain:
            start = run.start() + local.start()
            yield Entity("email", start, domain.end(), text[start : domain.end()])


def _gender(text: str, start: int) -> str:
    """What the title before a name tells: m, f or nothing."""
    before = text[max(0, start - _TITLE_ROOM) : start]
    return "m" if _MALE.search(before) else "f" if _FEMALE.search(before) else ""


def _after_cues(text: str):
    """Names in capitals that a cue stands before."""
    for found in CAPITALS.finditer(text, overlapped=True):
        if _CUE_OF_CAPITALS.search(text, max(0, found.start() - _CUE_ROOM), found.start()):
            yield found.start(), found.end()


def _names(text: str):
    found = [
        (m.start("name"), m.end("name"))
        for matches in (CUED.finditer(text), CUED_CJK.finditer(text), TITLED.finditer(text), SIGNATURE.finditer(text), _near(_MAYBE_FOLLOWED, FOLLOWED, text))
        for m in matches
    ]
    for start, end in [*found, *_after_cues(text)]:
        name = text[start:end]
        words = name.lower().replace(",", " ").split()
        if (len(words) < 2 and not _CJK.search(name)) or words[0] in _NOT_NAMES or words[-1] in _NOT_NAMES:
            continue
        yield Entity("person", start, end, name, _gender(text, start))


_CJK = regex.compile(r"[\p{Han}\p{Katakana}\p{Hangul}]")


def find(text: str | None) -> list[Entity]:
    """Entities of a text from left to right, none overlapping another; the earlier kinds of KINDS win."""
    if not text:
        return []
    found: list[Entity] = list(_emails(text))
    found += [Entity("id_number", m.start("id"), m.end("id"), m.group("id")) for m in ID_NUMBER.finditer(text)]
    found += [Entity("id_number", m.start(), m.end(), m.group()) for m in BARE_ID.finditer(text)]
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m.group()) <= PHONE_DIGITS[1]:
            found.append(Entity("phone", m.start(), m.end(), m.group()))
    found += [Entity("address", m.start(), m.end(), m.group()) for m in ADDRESS.finditer(text)]
    found += [Entity("address", m.start(), m.end(), m.group()) for m in _near(_MAYBE_GERMAN, GERMAN_ADDRESS, text)]
    found += _names(text)
    rank = {kind: i for i, kind in enumerate(KINDS)}
    taken: list[Entity] = []
    starts: list[int] = []
    for e in sorted(found, key=lambda e: (rank[e.kind], e.start, e.start - e.end)):
        at = bisect.bisect_left(starts, e.start)
        if (at == 0 or taken[at - 1].end <= e.start) and (at == len(taken) or taken[at].start >= e.end):
            starts.insert(at, e.start)
            taken.insert(at, e)
    return taken
