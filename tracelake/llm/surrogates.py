"""Keyed replacements of entities: same type, format and script, gender kept, the same one for the same entity.

Numbers, e-mail and street addresses are permuted inside their own format: the characters that may change are read as
one number in mixed radix and a keyed permutation without fixed points is applied, so nothing stays as it was and no two
of a format get the same. Words of names become readable words of the same length, beginning with the letter that a
keyed permutation without fixed points gives for the old one (initials agree with full names) and ending as names of
the person's gender do; those can collide, so `pii.surrogate_table` checks them.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from functools import lru_cache

import regex

#: Used where no key is given and no secret; queries take theirs from the session, see `pii.session_key`.
KEY = b"an example, no secret"
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Sounds that readable Latin words are made of, by number of letters.
_ONSETS = {1: "b d f g h k l m n p r s t v w".split(), 2: "br dr fr gr kr tr bl fl gl kl pl sl st sk sm sn sp sw".split(), 3: "str spr skr spl".split()}
_MIDDLES = {1: "b d f g k l m n p r s t v z".split(), 2: "nd st rt ll nn ss rk ld lm rn mb nt rs lt tt mm rd".split(), 3: "ndr str ntr mbr rst lst ldr".split()}
_CODAS = {1: "n r s l k t m d".split(), 2: "nd st rt ck ns ld rn ll ss".split(), 3: "rst nst rnd lst".split()}
_ENDINGS = {"f": "a e".split(), "m": "o n r s k".split()}
#: Given names whose ending does not tell the gender, and the endings of ideographic given names.
FEMALE_NAMES = frozenset("ann carmen doris edith ellen esther grace helen ingrid isabel janet jean joan judith karen kathleen megan miriam pilar rachel ruth susan yasmin".split())
MALE_NAMES = frozenset("andrea jose luca nikita mike steve george dave joe pierre philippe antoine bruce duane andre ole uwe arne luke kyle wayne pete ilya misha".split())
_HAN_FEMALE, _HAN_MALE = "子美花香恵愛優奈玲芳丽娟", "郎男夫雄健一太翔强伟军明"
#: Ideographs that are frequent in names.
HAN_NAMES = "".join(dict.fromkeys("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗田中山本村川佐藤鈴木橋伊渡辺小松井石原清水森池和太郎美子健花明志文华芳"))
_WORD = regex.compile(r"[\p{L}\p{M}'’]+")
_INITIAL = regex.compile(r"\p{L}\.")
#: Words of a street address that tell its type, and the last part of an e-mail domain: kept if something else can change.
_KEPT = {
    "address": regex.compile(
        r"(?i)(?<![\p{L}])(?:street|st|road|rd|drive|dr|lane|ln|avenue|ave|close|court|ct|way|place|square|terrace|crescent|boulevard|blvd|flat|apt|apartment|unit|suite"
        r"|rue|chemin|quai|impasse|calle|avenida|plaza|paseo|camino|de|la|del|des|du|les|los|las|am|zum|zur|im|an|auf|der|den)(?![\p{L}])"
        r"|(?:allee|weg|straße|strasse|gasse|platz|ring|ufer|damm|hang)(?![\p{L}])"
    ),
    "email": regex.compile(r"(?<=\.)\p{L}+$"),
}


class Stream:
    """Endless keyed bytes for one entity."""

    def __init__(self, key: bytes, label: str) -> None:
        self.key, self.label, self.block, self.bytes = key, label, 0, b""

    def number(self, below: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, f"{self.block}|{self.label}".encode(), hashlib.sha256).digest()
            self.block += 1
        head, self.bytes = self.bytes[:4], self.bytes[4:]
        return int.from_bytes(head, "big") % below

    def of(self, choices):
        return choices[self.number(len(choices))]


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters c may become, c among them, the same for each of them: its digits, vowels, consonants or script."""
    if unicodedata.decimal(c, None) is not None:
        return "".join(chr(ord(c) - unicodedata.decimal(c) + k) for k in range(10))
    parts = unicodedata.normalize("NFD", c)
    base, marks = parts[0].lower(), parts[1:]
    for letters in (VOWELS, CONSONANTS):
        if base in letters:
            composed = [unicodedata.normalize("NFC", x + marks) for x in letters]
            own = "".join(x for x in composed if len(x) == 1)
            return own.upper() if c.isupper() and len(own.upper()) == len(own) else own
    if 0x4E00 <= ord(c) <= 0x9FFF:
        return HAN_NAMES if c in HAN_NAMES else _pool(0x4E00, 0x9FFF, "Lo")
    for low, high in ((0x0410, 0x042F), (0x0430, 0x044F)):
        if low <= ord(c) <= high:
            return "".join(chr(k) for k in range(low, high + 1))
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return _pool(0xAC00, 0xD7A3, "Lo")
    low = ord(c) & ~0x7F
    own = _pool(low, low + 0x7F, unicodedata.category(c))
    return own if len(own) > 1 else c


@lru_cache(maxsize=256)
def _pool(low: int, high: int, category: str) -> str:
    """Letters of a category in a range that don't fall apart when composed or change length with their case."""
    fine = lambda x: unicodedata.category(x) == category and unicodedata.normalize("NFD", x) == x and len(x.upper()) == len(x.lower()) == 1
    letters = [x for x in map(chr, range(low, high + 1)) if x not in HAN_NAMES and not "А" <= x <= "я"]
    return "".join(x for x in letters if fine(x) or (low == 0xAC00 and unicodedata.category(x) == category))


def _mix(key: bytes, label: str, step: int, value: int, bits: int) -> int:
    body = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    size = (bits + 7) // 8
    out = hashlib.shake_256(len(key).to_bytes(4, "big") + key + f"{step}|{label}|".encode() + body).digest(size)
    return int.from_bytes(out, "big") & ((1 << bits) - 1)


def _permute(value: int, size: int, key: bytes, label: str, forward: bool) -> int:
    """A keyed permutation of 0 .. size-1: eight Feistel rounds, walked on until the value is in range again."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for step in range(8) if forward else range(7, -1, -1):
            if forward:
                left, right = right, left ^ _mix(key, label, step, right, half)
            else:
                left, right = right ^ _mix(key, label, step, left, half), left
        value = (left << half) | right
        if value < size:
            return value


def deranged(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0 .. size-1 (at least two) that leaves no value as it is: one step on a keyed cycle."""
    return _permute((_permute(value, size, key, label, False) + 1) % size, size, key, label, True)


def _of_format(kind: str, atom: str, key: bytes) -> str:
    """The atom's characters permuted inside its format."""
    kept = {i for m in _KEPT[kind].finditer(atom) for i in range(m.start(), m.end())} if kind in _KEPT else set()
    for fixed in (kept, set()):
        pools = [alphabet(c) if c.isalnum() and i not in fixed else c for i, c in enumerate(atom)]
        for i, c in enumerate(atom[:2] if kind == "phone" else ""):
            if pools[i] != c and unicodedata.decimal(c, None) is not None:  # trunk zeros stay, and none is added
                pools[i] = c if c == pools[i][0] else pools[i][1:]
        pools = [p if c in p else c for p, c in zip(pools, atom)]
        size = 1
        for p in pools:
            size *= len(p)
        if size > 1:
            break
    if size < 2:  # nothing of it has another form: letters of the key instead
        stream = Stream(key, f"{kind}|bare|{atom}")
        return "".join(stream.of(CONSONANTS) if c.isalnum() else c for c in atom)
    value = 0
    for p, c in zip(pools, atom):
        value = value * len(p) + p.index(c)
    shape = "".join(p[0] if len(p) > 1 else p + "\0" for p in pools)
    value = deranged(value, size, key, f"{kind}|{shape}")
    out = []
    for p in reversed(pools):
        value, at = divmod(value, len(p))
        out.append(p[at])
    return "".join(reversed(out))


@lru_cache(maxsize=4096)
def first_letter(key: bytes, c: str) -> str:
    """The letter a name's first letter becomes: a keyed permutation of its kind of letters that changes every one."""
    letters = alphabet(c)
    return letters[deranged(letters.index(c), len(letters), key, "first")] if c in letters and len(letters) > 1 else "x" if c != "x" else "k"


def gender_of(atom: str) -> str:
    """What a given name itself tells (f, m or nothing): known names, else the ending."""
    if atom in FEMALE_NAMES or atom[-1:] in _HAN_FEMALE and len(atom) > 1:
        return "f"
    if atom in MALE_NAMES or atom[-1:] in _HAN_MALE and len(atom) > 1:
        return "m"
    last = unicodedata.normalize("NFD", atom[-1:])[:1]
    return "f" if last in ("a", "а", "я", "η", "α") else "m" if last == "o" else ""


def _latin_word(atom: str, stream: Stream, head: str, gender: str) -> str:
    """A readable word with the vowels and consonants of the old one where they are, and the ending of a gender."""
    plain = [unicodedata.normalize("NFD", c)[0] for c in atom]
    runs, at = [], 0
    while at < len(plain):
        end = at + 1
        kind = plain[at] in VOWELS + "y"
        while end < len(plain) and (plain[end] in VOWELS + "y") == kind:
            end += 1
        runs.append((kind, end - at))
        at = end
    out = ""
    for i, (vowel, n) in enumerate(runs):
        table = _ONSETS if i == 0 else _CODAS if i == len(runs) - 1 else _MIDDLES
        while n:
            k = 1 if vowel else min(n, 3)
            if i == 0 and not vowel:  # the first letter is given: what may follow it
                out += head + ("" if k == 1 else stream.of(("r", "l", "w")) if k == 2 else stream.of(("ch", "hr", "hl")))
            else:
                out += stream.of(VOWELS) if vowel else stream.of(table[k])
            n -= k
    out = head + out[1:]
    if len(out) > 1:
        last = stream.of(_ENDINGS[gender]) if gender else VOWELS[stream.number(5)] if runs[-1][0] else None
        out = out[:-1] + last if last else out
    return out


def _word(atom: str, attempt: int, key: bytes, gender: str) -> str:
    """One word of a name; later attempts give longer ones, so that a free one is always found."""
    lead = next((i for i, c in enumerate(atom) if c.isalpha()), len(atom))
    if lead:  # signs before the first letter stay
        return atom[:lead] + (_word(atom[lead:], attempt, key, gender) if lead < len(atom) else "")
    stream = Stream(key, f"person|{attempt}|{gender}|{atom}")
    head = first_letter(key, atom[0])
    if all(regex.match(r"[\p{Latin}\p{M}'’]", c) for c in atom):
        new = _latin_word(regex.sub(r"[\p{M}'’]", "", unicodedata.normalize("NFC", atom)) or atom[0], stream, head, gender)
        grown = "".join(stream.of(_MIDDLES[1]) + stream.of(VOWELS) for _ in range(max(0, attempt - 1)))
        new = new[:1] + new[1:-1] + grown + new[-1:] if len(new) > 1 else new + grown
        signs = [(i, c) for i, c in enumerate(atom) if c in "'’"]
        for i, c in signs:
            new = new[:i] + c + new[i:]
        return new
    out = head
    for c in atom[1:]:
        out += stream.of(HAN_NAMES if 0x4E00 <= ord(c) <= 0x9FFF else alphabet(c) if c.isalpha() else c)
    ideograms = _HAN_FEMALE if gender == "f" else _HAN_MALE
    if gender and len(out) > 1 and 0x4E00 <= ord(atom[-1]) <= 0x9FFF:
        out = out[:-1] + stream.of(ideograms)
    letters = alphabet(atom[-1]) if atom[-1].isalpha() else alphabet(atom[0])
    return out + "".join(stream.of(letters) for _ in range(max(0, attempt - 1)))


def atoms(kind: str, text: str) -> list[str]:
    """What of an entity is replaced as a whole, in the form that other spellings of it share."""
    if kind == "person":
        return _WORD.findall(text.lower())
    if kind == "phone":
        digits = "".join(c for c in text if c.isdigit())
        return [digits[2:] if digits.startswith("00") else digits]
    if kind == "id_number":
        return ["".join(c for c in text if c.isalnum()).upper()]
    if kind == "email":
        plain = regex.sub(r"(?i)\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+", "@", text)
        return [regex.sub(r"(?i)\s*[(\[]\s*dot\s*[)\]]\s*|\s+dot\s+", ".", plain).lower()]
    return [text.lower()]


def genders(kind: str, text: str, told: str) -> list[str]:
    """For each atom of an entity the gender its place tells: of given names what the title told ('?' if nothing), else ''."""
    words = _WORD.findall(text)
    if kind != "person":
        return [""]
    given = len(_WORD.findall(text.split(",")[0])) if "," in text else 0
    place = range(given, len(words)) if "," in text else range(max(1, len(words) - 1))
    return [(told or "?") if i in place and len(w) > 1 else "" for i, w in enumerate(words)]


def replace_atom(kind: str, atom: str, attempt: int = 0, key: bytes = KEY, gender: str = "") -> str:
    """The replacement of an atom; of a name's word attempt n gives another one where those before collide."""
    if kind != "person":
        return _of_format(kind, atom, key)
    if len(atom) == 1:
        return first_letter(key, atom)
    return _word(atom, attempt, key, gender)


def _pour(text: str, chars: str, skip: set[int]) -> str:
    """text with its letters and digits, but those at skip, replaced in turn by chars, the case of text kept."""
    source = iter(chars)
    out = []
    for i, c in enumerate(text):
        if c.isalnum() and i not in skip:
            new = next(source, "")
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join([*out, *source])


def render(kind: str, text: str, replaced: list[str]) -> str:
    """An entity in its own format with its atoms' replacements."""
    if kind == "person":
        words = iter(replaced)

        def one(m: regex.Match) -> str:
            word, new = m.group(), next(words, m.group())
            return new.upper() if word.isupper() and len(word) > 1 else new.capitalize() if word[0].isupper() else new

        return _WORD.sub(one, text)
    if kind == "phone":
        digits, out = list(replaced[0]), []
        for c in reversed(text):
            out.append(digits.pop() if c.isdigit() and digits else c)
        return "".join(reversed(out))
    skip: set[int] = set()
    if kind == "email":
        skip = {i for m in regex.finditer(r"(?i)[(\[]\s*(?:at|dot)\s*[)\]]|\s(?:at|dot)\s", text) for i in range(m.start(), m.end())}
    return _pour(text, "".join(c for c in replaced[0] if c.isalnum()), skip)


def tag(kind: str, atoms_: list[str], key: bytes = KEY) -> str:
    """A typed placeholder, the same for every spelling of an entity."""
    digest = hmac.new(key, f"tag|{kind}|{'|'.join(atoms_ if kind != 'person' else sorted(atoms_))}".encode(), hashlib.sha256)
    return f"[{kind.upper()}_{digest.hexdigest()[:16]}]"
