"""Surrogates for personal data: each detected entity is replaced by a keyed one of its own type and format.

Detected: e-mail addresses (with their domains as entities of their own), phone numbers (in groups, international ones in
any groups of 8 to 15 digits behind a plus, ten bare digits), IPv4 and IPv6 addresses, card numbers (Luhn-valid), IBANs
(of a country's length, with valid check digits), US social security numbers, secrets (AWS key ids; values of token,
secret, password or key settings) and person names (after a form of address or a degree, a known given name before a
capitalised word, Chinese, Japanese and Korean ones with an honorific, behind a label or alone, and wherever the same
document has a name so found).

An entity is its canonical form: digits of a phone number, lower case of an address, a name's parts one by one. All
mentions of an entity, in any layout and any document, get the same surrogate, laid out as the mention is, so
coreference stays ("John Smith", "Mr Smith"). A given name is one entity whatever stands before it ("Prof. Kim Weber",
"Mr Kim Weber"); its gender is the one that its mentions agree on, and where they don't its surrogate suits either. A
surrogate has the type's form: letters for letters, digits for digits,
a valid check digit, for a name a made-up one of the same gender and script with as many hyphenated parts. Made-up names
are as many as the corpus needs, and apart from the names by which detection goes.

Surrogates come from HMAC-SHA256 over the kind, the entity and an attempt. They are checked on Spark against all
surrogates and all entities of the corpus; an entity makes several draws a round and keeps its first one that is free,
so different entities stay different and no surrogate is a real entity; given names and surnames are checked against each
other too. An entity of a form of which nearly all are taken (after ROUNDS rounds) gets a mark of its kind and a keyed
digest in place of one ("<phone-...>"). Texts are searched once; documents with mentions
are shuffled by row.

Null and empty texts have no mentions and stay as they are; so do all other columns, whatever their names, and repeated
rows. An empty table stays empty. A very long text is searched as a whole in time that follows its length.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import free_name, parts_of, text_batches
from dossierlake.workspace import materialize

# Common given names by gender and script, forms of address by gender, and syllables of made-up surnames.
GIVEN = {
    ("m", "latin"): "James John Robert Michael David William Thomas Daniel Paul Peter Mark George Frank Hans Karl Klaus Pierre Jean Luis Carlos Miguel Antonio Adam Alexander Andrew Anthony Benjamin Brian Charles Christopher Edward Eric Gary Henry Jacob Jason Jeffrey Jonathan Joseph Joshua Kenneth Kevin Matthew Nicholas Patrick Philip Richard Ronald Ryan Samuel Stephen Steven Timothy Andreas Christian Dieter Fritz Günter Heinz Helmut Jens Johannes Jürgen Lukas Manfred Markus Matthias Rainer Sebastian Stefan Tobias Uwe Werner Wolfgang Alain Bernard Étienne François Gérard Guillaume Henri Jacques Julien Laurent Louis Marcel Mathieu Michel Nicolas Olivier Philippe Thierry Alejandro Álvaro Diego Fernando Francisco Javier Jorge José Juan Manuel Pablo Pedro Rafael Ricardo Sergio Giovanni Giuseppe Marco Mohammed Ahmed Omar Ali".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Anna Laura Emma Julia Sophie Claire Ingrid Petra Maria Carmen Lucia Isabel Elena Alice Amanda Amy Andrea Angela Ashley Barbara Betty Carol Caroline Catherine Christine Cynthia Deborah Diana Dorothy Emily Hannah Helen Jane Janet Judith Julie Katherine Kathleen Kelly Kimberly Lisa Margaret Martha Megan Melissa Michelle Nancy Nicole Olivia Pamela Rachel Rebecca Sandra Sharon Stephanie Teresa Angelika Birgit Brigitte Charlotte Christina Gisela Hannelore Heike Helga Katharina Lena Monika Renate Sabine Silke Susanne Ursula Amélie Camille Cécile Chantal Élodie Florence Françoise Hélène Isabelle Jeanne Léa Manon Marie Nathalie Simone Sylvie Valérie Véronique Adriana Ana Beatriz Cristina Dolores Inés Josefa Lucía María Pilar Raquel Rocío Fatima Aisha".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Олег Александр Антон Артём Борис Василий Виктор Владимир Григорий Денис Евгений Игорь Кирилл Максим Никита Роман Степан Юрий".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Юлия Вера Александра Алина Анастасия Валентина Виктория Галина Дарья Евгения Екатерина Ксения Людмила Марина Надежда Оксана Полина София Тамара".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Mme": "f", "Madame": "f", "Sr": "m", "Sra": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Miss": "f", "Sir": "m", "Don": "m", "Doña": "f", "Profesora": "f", "Доктор": "n", "Профессор": "n"} | dict.fromkeys("Dr Prof Doctor Professor Docteur Professeur Doktor Profesor".split(), "n")
SYLLABLES = {
    "latin": "bar bel cor dan del fen gar hol jan kel lan mar nor pel ros sen tal vin wes zan".split(),
    "cyrillic": "бар вел гор дан лен мар нов рос сан тол".split(),
    "greek": "βαρ γελ δαν θεο καλ λαμ μαρ νικ παν ρεν σολ ταν φιλ χαρ".split(),
}
#: Endings of made-up given names by gender.
ENDINGS = {
    "latin": {"m": "o an en us or ik as in".split(), "f": "a ia ina elle ette isa ora".split()},
    "cyrillic": {"m": "ан ей ий ор ил ин".split(), "f": "а ия ина ана ела".split()},
    "greek": {"m": "ος ης ας".split(), "f": "α η ία ούλα".split()},
}
#: Prefixes of secrets that stay.
PREFIXES = "AKIA ASIA ghp_ gho_ ghu_ ghs_ ghr_ sk- xoxa- xoxb- xoxp- xoxr- xoxs- AIza eyJ".split()

KNOWN = {name: (gender, script) for (gender, script), names in GIVEN.items() for name in names}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@((?:[A-Za-z0-9-]{1,63}\.){1,8})([A-Za-z]{2,24})(?![A-Za-z0-9-])")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)")
INTERNATIONAL = re.compile(r"(?<![\w+])\+[1-9](?:[ .()/-]{0,2}\d){7,14}(?!\w)")
#: Ten bare digits, eleven as of Chinese mobiles, pairs as in France, and an area code before a longer number.
NATIONAL = re.compile(r"(?<![\w+.,/-])(?:[2-9]\d{9}|1[3-9]\d{9}|0[1-9](?:[ .-]\d\d){4}|0\d{2,4}[ /-]\d{6,8})(?![\w/]|[.,-]\d)")
IPV4 = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?= ?[A-Z0-9])")
IBAN_SIZES = {"AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KZ": 20, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29}
CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
SECRET = re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{8,})", re.IGNORECASE)
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")
TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,})")
#: A word of a name, with hyphens and apostrophes inside but no possessive s.
NAME = r"[^\W\d_]+(?:[-'’](?!s(?!\w))[^\W\d_]+)*"
#: Without a word boundary in front, which would slow the search down; whole_word() looks.
TITLED = re.compile(r"({0})(?:\.? (?:{0}))*\.? ({1})(?: ({1}))?".format("|".join(TITLES), NAME))
NAMED = re.compile(r"(" + "|".join(KNOWN) + r") (" + NAME + ")")
WHOLE_NAME, NAME_PART = re.compile(r"(?<!\w)" + NAME + r"(?!\w)"), re.compile(r"[^\W\d_]+")
#: Han, kana and Hangul; common Chinese surnames (fixed values), honorifics behind a name and labels before one.
EAST = "㐀-䶿一-鿿぀-ヿ가-힣"
FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
EASTERN = [
    re.compile(rf"([{FAMILIES}][一-鿿]{{1,2}})(?=先生|女士|小姐|老师|教授|博士|同学)"),
    re.compile(r"(?<![一-鿿])([一-鿿]{1,4})(?=さん|様|氏(?![一-鿿]))"),
    re.compile(r"([가-힣]{2,4}) ?(?=씨|님)"),
    re.compile(r"(?:姓名|联系人|负责人|氏名|이름)\s{0,3}[:：]\s{0,3}([一-鿿가-힣]{2,4})(?![一-鿿가-힣])"),
    re.compile(rf"(?<!\w)([{FAMILIES}][一-鿿]{{2}})(?!\w)"),
]
HAS_EAST = re.compile(f"[{EAST}]")
SPANS = "array<struct<begin:int,stop:int,kind:string,canonical:string>>"
#: Draws of an entity in a round, rounds at most, and the attempt from which surrogates of free length grow.
DRAWS, ROUNDS, LONGER = 8, 30, 6


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(odd)) % 10 == 0


def script_of(word: str) -> str:
    first = word[0]
    if "Ѐ" <= first <= "ӿ":
        return "cyrillic"
    if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῿":
        return "greek"
    return "latin" if first < "ʰ" or "Ḁ" <= first <= "ỿ" else "other"


def kindred(letter: str, pick: Callable[[int], int]) -> str:
    """Another letter of the same kind from the same part of the character table."""
    start, kind = ord(letter) & ~63, unicodedata.category(letter)
    others = [c for c in map(chr, range(start, start + 64)) if unicodedata.category(c) == kind and c != letter]
    return others[pick(len(others))] if others else letter


def checked(iban: str) -> int:
    """What an account number without spaces leaves by 97: 1 if its check digits are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def account(text: str, start: int) -> tuple[int, str] | None:
    """(end, canonical) of the IBAN that starts there, if one does."""
    size, at, found = IBAN_SIZES.get(text[start : start + 2]), start, ""
    while size and len(found) < size and at < len(text):
        if text[at] != " ":
            found += text[at]
        elif text[at - 1] == " ":
            return None
        at += 1
    if not size or not re.fullmatch(rf"[A-Z0-9]{{{size}}}", found) or text[at : at + 1].isalnum() or checked(found) != 1:
        return None
    return at, found


def address6(mention: str) -> str | None:
    """The full form of an IPv6 address that has a digit and isn't a machine's own."""
    try:
        found = ipaddress.IPv6Address(mention)
    except ValueError:
        return None
    return None if found.is_loopback or found.is_unspecified or not re.search(r"\d", mention) else found.exploded


def whole_word(text: str, m: re.Match) -> bool:
    return m.start() == 0 or not text[m.start() - 1].isalnum()


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of the mentions, in order and without overlaps; the earlier, then longer one wins."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            found.append((*m.span(), "email", m[0].lower()))
    if re.search(r"\d", text):
        for m in PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 9 <= len(digits) <= 15:
                found.append((*m.span(), "phone", ("+" if m[0][0] == "+" else "") + digits))
        starts = {x[0] for x in found if x[2] == "phone"}
        for m in [*(INTERNATIONAL.finditer(text) if "+" in text else ()), *NATIONAL.finditer(text)]:
            if m.start() not in starts:
                found.append((*m.span(), "phone", ("+" if m[0][0] == "+" else "") + re.sub(r"\D", "", m[0])))
        for m in IPV4.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                found.append((*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split("."))))
        if text.count(":") > 1:
            for m in IPV6.finditer(text):
                if full := address6(m[0]):
                    found.append((*m.span(), "ipv6", full))
        for m in IBAN.finditer(text):
            if own := account(text, m.start()):
                found.append((m.start(), own[0], "iban", own[1]))
        for m in CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if luhn(digits) and int(digits):
                found.append((*m.span(), "card", digits))
        for m in SSN.finditer(text):
            found.append((*m.span(), "ssn", m[0].replace("-", "")))
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            found.append((*m.span(1), "secret", m[1]))
    if "IA" in text:
        for m in ACCESS_KEY.finditer(text):
            found.append((*m.span(), "secret", m[0]))
    if "_" in text or "-" in text or "eyJ" in text:
        for m in TOKEN.finditer(text):
            found.append((*m.span(), "secret", m[0]))
    for m in TITLED.finditer(text):
        first, last = m[2], m[3]
        caseless = first[0].upper() == first[0].lower() and (len(first) <= 4 or not HAS_EAST.match(first))
        if not (first[0].isupper() or caseless) or first in TITLES or not whole_word(text, m):
            continue
        gender = TITLES[m[1]]
        if gender == "n" and first in KNOWN:
            gender = KNOWN[first][0]
        if last and last[0].isupper():
            found.append((*m.span(2), f"given.{gender}", first.lower()))
            found.append((*m.span(3), "surname", last.lower()))
        else:
            found.append((*m.span(2), "surname", first.lower()))
    for m in NAMED.finditer(text):
        if m[2][0].isupper() and whole_word(text, m):
            found.append((*m.span(1), f"given.{KNOWN[m[1]][0]}", m[1].lower()))
            found.append((*m.span(2), "surname", m[2].lower()))
    if HAS_EAST.search(text):
        east = {(*m.span(1), m[1]) for pattern in EASTERN for m in pattern.finditer(text)}
        found += [(a, b, "surname", name) for a, b, name in east]
        whole = {name for _, _, name in east if len(name) > 2}  # also where no space or honorific sets them apart
        for size in {len(name) for name in whole}:
            found += [(i, i + size, "surname", text[i : i + size]) for i in range(len(text) - size + 1) if text[i : i + size] in whole]
    names = {text[a:b]: (kind, name) for a, b, kind, name in found if is_name(kind)}
    if names:  # the same names without a form of address, also in capitals or as a part of a longer one
        names = {n.upper(): v for n, v in names.items() if len(n) > 1} | names
        for m in WHOLE_NAME.finditer(text):
            if m[0] in names:
                found.append((*m.span(), *names[m[0]]))
            elif len(m[0]) > 2:
                parts = [p for p in NAME_PART.finditer(text, *m.span()) if p[0] in names and p[0] != m[0]]
                found += [(*p.span(), *names[p[0]]) for p in parts]
    out, end = [], 0
    for mention in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if mention[0] >= end:
            out.append(mention)
            end = mention[1]
    return out


def entities(kind: str, canonical: str) -> list[tuple[str, str]]:
    """The entities of a mention: an address has its domain besides."""
    return [(kind, canonical), ("domain", canonical.rpartition("@")[2])] if kind == "email" else [(kind, canonical)]


def randoms(key: bytes, *parts: object) -> Callable[[int], int]:
    """A keyed stream of numbers below n."""
    seed = "\0".join(map(str, parts)).encode()
    blocks = (hmac.new(key, seed + i.to_bytes(4, "big"), hashlib.sha256).digest() for i in count())
    numbers = (int.from_bytes(b[j : j + 4], "big") for b in blocks for j in range(0, 32, 4))
    return lambda n: next(numbers) % n


def alike(text: str, pick: Callable[[int], int]) -> str:
    """Letters for letters (hexadecimal ones for such), digits for digits, the rest kept."""
    digits = any(c.isdigit() for c in text)
    low = "abcdef" if digits and not re.search(r"[^0-9a-f\W_]", text) else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for c in text:
        if c.isascii() and c.isdigit():
            out.append(str(pick(10)))
        elif c.isascii() and c.isalpha():
            out.append(low[pick(len(low))] if c.islower() else low[pick(len(low))].upper())
        else:
            out.append(c)
    return "".join(out)


def number(digits: str, keep: int, pick: Callable[[int], int]) -> str:
    """Other digits behind the first ``keep``; the first drawn one isn't 0 unless it was."""
    rest = [str(pick(10)) for _ in digits[keep:]]
    if rest and digits[keep] != "0":
        rest[0] = str(1 + pick(9))
    return digits[:keep] + "".join(rest)


def draw(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical surrogate of an entity at an attempt."""
    pick = randoms(key, kind, canonical, attempt)
    extra = max(0, attempt - LONGER)
    if kind == "email":
        local, _, domain = canonical.rpartition("@")
        return alike(local + "x" * extra, pick) + "@" + domain
    if kind == "domain":
        head, _, top = canonical.rpartition(".")
        return alike(head + "x" * extra, pick) + "." + top
    if kind == "phone":
        international = canonical.startswith("+")
        digits = canonical.lstrip("+")
        if not international and re.fullmatch(r"1[3-9]\d{9}", digits):
            return f"1{3 + pick(7)}" + "".join(str(pick(10)) for _ in range(9))
        keep = (1 if digits[0] in "17" else 2) if international else 0
        return "+" * international + number(digits, keep, pick)
    if kind == "ip":
        return ".".join(str(1 + pick(223 if i == 0 else 254)) for i in range(4))
    if kind == "ipv6":
        groups = [f"{1 + pick(0xFFFF):04x}" if extra or g != "0000" else g for g in canonical.split(":")]
        return ":".join([canonical[:2] + groups[0][2:], *groups[1:]]) if canonical[:2] != "00" else ":".join(groups)
    if kind == "iban":
        body = canonical[:2] + "00" + alike(canonical[4:], pick)
        return body[:2] + f"{98 - checked(body):02d}" + body[4:]
    if kind == "card":
        body = number(canonical[:-1], 1, pick)
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind == "ssn":
        return number(canonical, 0, pick)
    if kind == "secret":
        fixed = next((len(p) for p in PREFIXES if canonical.startswith(p)), 0)
        return canonical[:fixed] + alike(canonical[fixed:] + "x" * extra, pick)
    parts = re.split(r"([-'’])", canonical)
    parts[::2] = [made_up(kind, part, extra, pick) for part in parts[::2]]
    return "".join(parts)


def made_up(kind: str, part: str, extra: int, pick: Callable[[int], int]) -> str:
    """A name in place of one part of a name, with ``extra`` syllables or letters more."""
    script = script_of(part)
    if script == "other":
        return "".join(kindred(c, pick) for c in part + part[-1] * extra)
    own = SYLLABLES[script]
    if kind == "surname":
        word = "".join(own[pick(len(own))] for _ in range(3 + extra))
        if script == "cyrillic":
            word += "ова" if part.endswith("а") else "ов"
        if script == "greek":
            word += "οπούλου" if part.endswith("ου") else "όπουλος"
        return word
    endings = [x for g, own in ENDINGS[script].items() if kind.partition(".")[2] in (g, "n") for x in own]
    return "".join(own[pick(len(own))] for _ in range(2 + extra)) + endings[pick(len(endings))]


def is_name(kind: str) -> bool:
    return kind == "surname" or kind.startswith("given")


def entity_kind(kind: str) -> str:
    """The kind of entity that a mention is of: a given name is the same one whatever its mention tells of gender."""
    return kind.partition(".")[0]


def in_place_of(key: bytes, kind: str, canonical: str) -> str:
    """What an entity gets for which no surrogate of its form is free; different for different entities, as digests are."""
    return f"<{entity_kind(kind)}-{hmac.new(key, f'{kind}{chr(0)}{canonical}'.encode(), hashlib.sha256).hexdigest()[:32]}>"


def assign(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """kind, canonical, surrogate for distinct entities (kind, canonical), with no two alike and none an entity."""
    pending, done = found.select("kind", "canonical"), None

    def draws(first: int | None):
        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(zip(b.column("kind").to_pylist(), b.column("canonical").to_pylist()))
                if first is None:
                    each = [(k, c, 0, in_place_of(key, k, c)) for k, c in rows]
                else:
                    each = [(k, c, n, draw(key, k, c, n)) for k, c in rows for n in range(first, first + DRAWS)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
                arrays = [pa.array([x[i] for x in each], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "canonical", "attempt", "surrogate"])

        return drawn

    schema = "kind string, canonical string, attempt int, surrogate string"
    # names of any kind must differ from each other
    space = F.when((F.col("kind") == "surname") | F.col("kind").startswith("given"), "name").otherwise(F.col("kind")).alias("space")
    real = found.select(space, F.col("canonical").alias("surrogate")).distinct()
    for turn in range(rounds):
        new = pending.mapInArrow(draws(turn * DRAWS), schema)
        taken = real if done is None else real.unionByName(done.select(space, "surrogate"))
        # each free surrogate goes to who drew it first, and each entity keeps the first one that it gets
        claims = new.groupBy(space, "surrogate").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("by"))
        claims = claims.join(taken, ["space", "surrogate"], "left_anti")
        won = claims.groupBy("by.kind", "by.canonical").agg(F.min(F.struct("by.attempt", "surrogate")).alias("own"))
        won = materialize(won.select("kind", "canonical", "own.surrogate"), "pii-draws")
        done = won if done is None else done.unionByName(won)
        pending = materialize(pending.join(won, ["kind", "canonical"], "left_anti"), "pii-pending")
        if pending.isEmpty():
            return done
    return done.unionByName(pending.mapInArrow(draws(None), schema).drop("attempt"))


def lay_out(mention: str, kind: str, surrogates: dict[tuple[str, str], str], canonical: str) -> str:
    """The surrogate in the mention's own layout and case."""
    new = surrogates[entity_kind(kind), canonical]
    if new.startswith("<"):
        return new
    if kind == "email":
        new = new.rpartition("@")[0] + "@" + surrogates["domain", canonical.rpartition("@")[2]]
        return new.upper() if mention.isupper() else new
    if kind in ("phone", "card", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        signs = iter(new)
        return "".join(next(signs) if c != " " else c for c in mention)
    if kind == "ipv6":
        new = str(ipaddress.IPv6Address(new)) if "::" in mention else new
        return new.upper() if re.search("[A-F]", mention) else new
    if is_name(kind):
        return new.upper() if len(mention) > 1 and mention.isupper() else re.sub(r"[^\W\d_]+", lambda p: p[0].capitalize(), new)
    return new


def replace_entities(
    docs: DataFrame, key: bytes, text_column: str = "text", counted: str = "n_entities"
) -> DataFrame:
    """``docs`` with surrogates in its texts, and a column ``counted`` (mentions replaced) behind its own columns.

    A column of that name is replaced. Row order isn't kept.
    """
    text_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != counted]
    docs = docs.select(*columns)
    row, mentions, known = (free_name(docs, n) for n in ("__pii_row", "__pii_mentions", "__pii_known"))

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        names = ("begin", "stop", "kind", "canonical")
        rows = [[dict(zip(names, m)) for m in detect(t)] for part in parts_of(texts) for t in part]
        return pa.array(rows, pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int32(), pa.string(), pa.string()))))))

    searched = docs.withColumn(mentions, found(F.col(text_column))).withColumn(row, F.monotonically_increasing_id())
    searched = materialize(searched, "pii-searched", compression="zstd")
    hits = searched.where(F.size(mentions) > 0)
    each = hits.select(row, F.explode(mentions).alias("m")).select(row, "m.kind", "m.canonical")
    domain = F.substring_index("canonical", "@", -1)
    own = each.unionByName(each.where("kind = 'email'").select(row, F.lit("domain").alias("kind"), domain.alias("canonical")))
    own = own.distinct()
    told = own.select(F.substring_index("kind", ".", 1).alias("entity"), "kind", "canonical").distinct()
    man, woman = (F.bool_or(F.col("kind") == f"given.{g}") for g in "mf")
    form = F.when(F.col("entity") != "given", F.col("entity")).when(man & ~woman, "given.m").when(woman & ~man, "given.f").otherwise("given.n")
    known_entities = materialize(told.groupBy("entity", "canonical").agg(form.alias("kind")), "pii-entities")
    surrogates = assign(known_entities.select("kind", "canonical"), key).withColumn("kind", F.substring_index("kind", ".", 1))
    by_row = (
        own.withColumn("kind", F.substring_index("kind", ".", 1)).distinct().join(surrogates, ["kind", "canonical"])
        .groupBy(row)
        .agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias(known))
    )

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, spans: pa.Array, pairs: pa.Array) -> pa.Array:
        out = []
        for part in zip(parts_of(texts), parts_of(spans), parts_of(pairs), strict=True):
            for text, own, given in zip(*part, strict=True):
                mapping = {(g["kind"], g["canonical"]): g["surrogate"] for g in given}
                pieces, at = [], 0
                for m in own:
                    new = lay_out(text[m["begin"] : m["stop"]], m["kind"], mapping, m["canonical"])
                    pieces += [text[at : m["begin"]], new]
                    at = m["stop"]
                out.append("".join(pieces) + text[at:])
        return pa.array(out, pa.string())

    done = hits.join(by_row, row).withColumn(text_column, replaced(text_column, mentions, known))
    done = done.select(*columns, F.size(mentions).cast("long").alias(counted))
    clean = searched.where(F.size(mentions) == 0).select(*columns, F.lit(0).cast("long").alias(counted))
    return done.unionByName(clean)
