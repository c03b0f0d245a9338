"""Personal information in free text: offset-preserving deobfuscation, detection, typed placeholders.

Transducers rewrite disguises into plain characters (Latin look-alikes from other scripts,
full-width and invisible characters, spelled-out digits, written-out at signs and dots) while keeping,
for each character written, the span of the source it came from. Detectors run on the plain
text; their spans are mapped back, so positions and replacements refer to the source text.

Kinds: ``email``, ``phone``, ``id_number`` (PESEL with a valid date and check digit; identity card of
three letters and six digits), ``address`` (street type, name and house number), ``person`` (given
name or initial with surname, in either order). Earlier kinds take precedence where spans
overlap. Street patrons, and numbers of offers, registers, parcels, accounts and amounts, are no mentions.

Defined results
---------------
* null or empty text: no mentions; its redacted text is the same null or empty text.
* texts of any length are read whole; repeated documents are reported under each of their ids.
* empty tables give empty results; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from calendar import monthrange

import pyarrow as pa
from pyspark.sql import DataFrame

from plotwright.functions.text import fold_py
from plotwright.session import spread

KINDS = ("email", "phone", "id_number", "address", "person")

# Words for the digits 0 to 9 in Polish, English and German.
DIGIT_WORDS = {
    "zero": "0", "jeden": "1", "jedna": "1", "dwa": "2", "dwie": "2", "trzy": "3", "cztery": "4", "pięć": "5", "piec": "5", "sześć": "6", "szesc": "6", "siedem": "7", "osiem": "8", "dziewięć": "9", "dziewiec": "9",
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXYIJSaeopcyxijsdhABEZHIKMNOPTYXo"))
# Given names in the nominative (Polish usage).
GIVEN_NAMES = """
Ada Adam Adrian Adrianna Agata Agnieszka Aleksander Aleksandra Alicja Alina Amelia Andrzej Aneta Angelika Anna Antoni Antonina
Arkadiusz Artur Barbara Bartłomiej Bartosz Beata Bernard Błażej Bogdan Bogumił Bogusław Borys Bożena Bronisław Bruno Celina Cezary Cyprian
Cyryl Czesław Dagmara Damian Daniel Daria Dariusz Dawid Dominik Dominika Dorota Edward Edyta Elżbieta Emil Emilia Ernest Eryk Ewa Ewelina
Feliks Filip Franciszek Gabriel Gabriela Grażyna Grzegorz Gustaw Halina Hanna Helena Henryk Hubert Iga Ignacy Igor Irena Ireneusz Iwona Iza
Izabela Jacek Jadwiga Jakub Jan Janina Janusz Jarosław Jerzy Joanna Jolanta Józef Judyta Julia Julian Justyna Kacper Kamil Kamila Karol Karolina
Katarzyna Kazimierz Kinga Klara Klaudia Konrad Krystian Krystyna Krzysztof Laura Lech Lena Leon Leszek Lidia Liliana Lucyna Łucja Ludwik Łukasz
Maciej Magda Magdalena Maja Małgorzata Marcel Marcin Marek Maria Marian Marianna Mariusz Marlena Marta Martyna Mateusz Maurycy Michał Michalina
Mieczysław Mikołaj Milena Mirosław Monika Natalia Natan Nadia Nikodem Nina Norbert Oliwia Olga Oskar Patrycja Patryk Paulina Paweł Piotr Przemysław
Radosław Rafał Renata Robert Roman Róża Ryszard Sabina Sandra Sebastian Seweryn Sławomir Sonia Stanisław Stefan Sylwia Szymon Tadeusz Teresa Tobiasz
Tomasz Tymon Urszula Wacław Waldemar Wanda Weronika Wiesław Wiktor Wiktoria Wioletta Wit Witold Władysław Włodzimierz Wojciech Zbigniew Zdzisław
Zenon Zofia Zuzanna Zygmunt Żaneta
""".split()

# Given names in the nominative (English, German, Ukrainian usage, also in Cyrillic).
OTHER_GIVEN_NAMES = """
Alice Andrew Angela Brian Carol Charles Christine Christopher David Deborah Dennis Donna Elizabeth Emily Emma Eric Frank George Hannah Heather Helen Henry Jack Jacob James Janet Jason
Jennifer Jessica John Jonathan Joseph Joshua Karen Kathleen Kevin Kimberly Laura Linda Lisa Margaret Mark Mary Matthew Melissa Michael Michelle Nancy Nicholas Nicole Oliver Olivia Patricia Patrick
Paul Peter Rachel Rebecca Richard Ronald Ruth Ryan Samuel Sarah Scott Sharon Sophia Stephen Steven Susan Thomas Timothy Victoria William
Andreas Birgit Christian Dieter Florian Friedrich Gisela Günter Hans Heike Heinz Helga Horst Ingrid Jens Johannes Jürgen Karin Katja Klaus Lukas Manfred Markus Matthias Monika Petra
Sabine Stefanie Susanne Tobias Ursula Uwe Wolfgang
Andriy Bohdan Dmytro Halyna Iryna Ivan Kateryna Larysa Liudmyla Maksym Mykhailo Mykola Nadiia Oksana Oleh Oleksandr Olena Petro Serhii Svitlana Taras Tetiana Vasyl Viktor Volodymyr Yulia Yurii
Андрій Богдан Василь Віктор Володимир Галина Дмитро Іван Ірина Катерина Людмила Максим Марія Микола Михайло Надія Наталія Оксана Олег Олександр Олена Ольга Петро Світлана Сергій Тарас Тетяна Юлія Юрій
""".split()
# Words after which a name stands, in folded form.
NAME_CUES = ("kontakt", "contact", "call", "ask for", "mr", "mrs", "ms", "herr", "herrn", "frau", "pan", "pani", "panem", "pania", "agent", "agentka", "doradca", "opiekun", "ansprechpartner", "ansprechpartnerin", "agentem", "wlasciciel", "wlascicielka", "seller", "owner", "eigentumer", "eigentumerin", "makler", "maklerin")

_U = "A-ZĄĆĘŁŃÓŚŹŻÄÖÜА-ЯІЇЄҐ"
_W = r"[^\W\d_]"
_GAP = "[ \t" + chr(0xA0) + "]"
_ODD = "[" + "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))) + chr(0xFF01) + "-" + chr(0xFF5E) + "]"
_AT_WORD = r"\s*[\[({]\s*(?:at|małpa|malpa|@)\s*[\])}]\s*|(?<=\w) @ (?=\w)|(?<=\w)@ (?=\w)|(?<=\w) @(?=\w)|(?<=[^\W_])\s+(?:małpa|malpa)\s+(?=[\w-]+\s*(?:\.|kropka|dot|[\[(]))|(?<=\w)\s+at\s+(?=[\w-]+(?:\s+dot\s+|\s*[\[({]\s*(?:dot|kropka)))"
_DOT_WORD = r"\s*[\[({]\s*(?:dot|kropka|\.)\s*[\])}]\s*|(?<=[\w-])\s+(?:kropka|dot)\s+(?=\w)"
_DISGUISE = re.compile(f"(?P<at>{_AT_WORD})|(?P<dot>{_DOT_WORD})", re.I)
# Every disguise of an at sign or dot has one of these words, or one of these signs with what is around it.
_DISGUISE_WORDS, _DISGUISE_SIGNS = ("dot", "kropka", "małpa", "malpa"), (re.compile(r"[ \[({]@|@ |@\s*[\])}]"), re.compile(r"[\[({]\s*(?:at|\.)\s*[\])}]"))
_SPELLED = re.compile(r"\b(?:(?:" + "|".join(DIGIT_WORDS) + r")\b[\s,-]*){6,}", re.I)
_SPELLED_LEAST = 6  # words of _SPELLED
_OTHER_SCRIPT = re.compile("[" + chr(0x370) + "-" + chr(0x52F) + "]")
_ODD_RE = re.compile(_ODD)


class Plain:
    """A text after the transducers; ``source(a, b)`` is the span of the source behind ``text[a:b]``."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint spans, given in order, by other text."""
        if not edits:
            return
        old = self.starts or range(len(self.text))
        old_ends = self.ends or range(1, len(self.text) + 1)
        out, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[at:a])
            starts.extend(old[at:a])
            ends.extend(old_ends[at:a])
            out.append(new)
            starts.extend([old[a]] * len(new))
            ends.extend([old_ends[b - 1]] * len(new))
            at = b
        out.append(self.text[at:])
        starts.extend(old[at:])
        ends.extend(old_ends[at:])
        self.text, self.starts, self.ends = "".join(out), starts, ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


def _spelled_digits(m: re.Match) -> str:
    return "".join(DIGIT_WORDS[w] for w in re.findall(r"\w+", _caseless(m.group())))


def _caseless(text: str) -> str:
    """Lower case, with long s and dotted and dotless i as the patterns take them."""
    return text.lower() if text.isascii() else text.upper().lower().replace(chr(0x307), "")


def may_be_disguised(low: str) -> bool:
    """Whether a text, made caseless, can hold a disguised at sign or dot."""
    at, sign = _DISGUISE_SIGNS
    return any(w in low for w in _DISGUISE_WORDS) or "@" in low and at.search(low) is not None or sign.search(low) is not None


def transduce(text: str) -> Plain:
    """Undo the disguises of a text."""
    p = Plain(text)
    if not text.isascii():
        if _ODD_RE.search(text):
            p.rewrite([(m.start(), m.end(), chr(ord(m.group()) - 0xFEE0) if ord(m.group()) > 0xFF00 and ord(m.group()) != 0xFEFF else "") for m in _ODD_RE.finditer(text)])
        if _OTHER_SCRIPT.search(p.text):
            edits = []
            for m in re.finditer(r"[\w.@+-]+", p.text):
                w = m.group()
                if _OTHER_SCRIPT.search(w) and re.search("[A-Za-z]", w):
                    edits += [(m.start() + i, m.start() + i + 1, LOOKALIKES[c]) for i, c in enumerate(w) if c in LOOKALIKES]
            p.rewrite(edits)
    low = _caseless(p.text)
    if sum(map(low.count, DIGIT_WORDS)) >= _SPELLED_LEAST:
        edits = []
        for m in _SPELLED.finditer(p.text):
            tail = len(m.group()) - len(m.group().rstrip(" ,-\t\n" + chr(0xA0)))
            edits.append((m.start(), m.end() - tail, _spelled_digits(m)))
        p.rewrite(edits)
    if may_be_disguised(low):
        p.rewrite([(m.start(), m.end(), "@" if m.group("at") else ".") for m in _DISGUISE.finditer(p.text)])
    return p


_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
# Patterns start with a character class and look behind it, which lets the matcher skip ahead.
_RUN = re.compile("[+(0-9][0-9+ ()./" + chr(0xA0) + "-]{8,}")
_SEP = "[ ." + chr(0xA0) + "-]"
_PHONE = re.compile(
    rf"(?<![\w+/@(])(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00\d{{2}}(?={_SEP}))(?:[ .()/{chr(0xA0)}-]{{0,3}}\d){{7,11}}(?!\d)"
    rf"|(?<![\w+/@.,-])(?<!\d[ {chr(0xA0)}])(?:\(\d{{2}}\){_SEP}?\d{{3}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}"
    rf"|\d{{2}}[ {chr(0xA0)}]\d{{3}}[ {chr(0xA0)}-]\d{{2}}[ {chr(0xA0)}-]\d{{2}}"
    rf"|\d{{3}}(?P<s>{_SEP}?| ?/ ?)\d{{3}}(?P=s)\d{{3}}"
    rf"|\d(?:[ {chr(0xA0)}]\d){{8}})(?![\w/]|[.,-]\d|{_GAP}\d)"
)
_NOT_PHONE = re.compile(r"(?:ref|ofert[ay]?|wp[łl]at[ay]|wp[łl]aty|kont[oa]|rachun\w*|faktur\w*|umow\w*|symbol\w*|sygnatur\w*|kw|nip|regon|krs|wieczyst\w*|ewidencyjn\w*|dzia[łl]k\w*|offer|reference|account|invoice|payment|angebot\w*|konto)\.?\s*(?:nr|numer|no|number)?\.?\s*[:#]?\s*$", re.I)
_AMOUNT = re.compile(rf"{_GAP}*(?:z[łl]\b|z[łl]ot\w+|pln|eur|euro|usd|€|\$|tys|mln|m2|злот\w*)", re.I)
_PESEL = re.compile(r"(?<![\w+])(?<![-/.,]\d)\d{11}(?!\w|[-/]\d)")
_CARD = re.compile(r"\d{3} ?\d{3}(?![\w-])(?! \d)")
_SERIES = re.compile(r"(?<![\w-])([A-Za-z]{3})[ " + chr(0xA0) + "]?$")
_CARD_WORD = re.compile(r"(?:dow[oó]d\w*|dokument\w*|seri[aię]+|id card|identity|personalausweis|паспорт\w*)[^.]{0,30}$", re.I)
_PHONE_WORD = re.compile(r"\b(?:tel|kom|fax|nr|pod|ul|os|al|pl|lok)\.?$", re.I)

# Street types and patrons' titles as they are written in running text.
_TYPE = r"(?i:ulic(?:a|y|ę|e|ą)|ul\.?|alej(?:a|i|e|ę|ą)|alei|al\.?|plac(?:u|em)?|pl\.?|osiedl(?:e|u|a)|os\.?|rondo|rondzie|skwer|bulwar)"
_TYPE_REST = r"(?i:(?<=u)(?:lic(?:a|y|ę|e|ą)|l\.?)|(?<=a)(?:lej(?:a|i|e|ę|ą)|lei|l\.?)|(?<=p)(?:lac(?:u|em)?|l\.?)|(?<=o)(?:siedl(?:e|u|a)|s\.?)|(?<=r)(?:ondo|ondzie)|(?<=s)kwer|(?<=b)ulwar)"
_TITLE = r"(?i:gen|mjr|prof|dr|ks|płk|plk|kpt|por|rtm|marsz|św|sw|bp|abp|kard|inż|inz|im)"
_MONTH = r"(?i:stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|wrzesnia|października|pazdziernika|listopada|grudnia)"
_NAME = rf"(?:\d{{1,2}}{_GAP}+{_MONTH}|[{_U}]{_W}+(?:-[{_U}]{_W}+)?(?:{_GAP}+(?:[{_U}]{_W}+(?:-[{_U}]{_W}+)?|i|[{_U}]\.)){{0,3}}?)"
_ADDRESS = re.compile(
    rf"[uUaApPoOrRsSbB](?<!\w.){_TYPE_REST}(?:(?<=\.){_GAP}*|{_GAP}+)(?:{_TITLE}(?:\.{_GAP}*|{_GAP}+))?(?:[{_U}]\.{_GAP}?)*{_NAME}{_GAP}+(?:(?i:nr|numer)\.?{_GAP}*)?"
    rf"\d{{1,4}}(?:{_GAP}?[A-Za-z](?![\w.]|{_GAP}\d))?(?:{_GAP}?/{_GAP}?\d{{1,4}}|{_GAP}+(?i:m|lok|mieszkanie)\.?{_GAP}*\d{{1,4}})?(?![\d]|,\d|{_GAP}*(?i:minut|metr|m2|zł|km|proc|%|tys|pok|lat\b))"
)
_PATRON = re.compile(rf"(?<!\w){_TYPE}\.?{_GAP}*(?:{_TITLE}\.?{_GAP}*)*(?:[{_U}]\.{_GAP}?)*(?:[{_U}]{_W}+{_GAP}+)?$")
_CAP = re.compile(rf"[{_U}](?<!\w.)(?:{_W}+(?:-[{_U}]{_W}+)?|\.(?={_GAP}?[{_U}]{_W}{{2}}))")
_SURNAME_END = re.compile(r"(?:sk|ck|dzk|zk)(?:i|a|iego|iej|im|iemu|ich)$|(?:czyk|wicz|sz|arz|ak|ek|ik|uk|yk|ec|ka|ko|ra)(?:a|iem|em|owi)?$")
_PLACE = re.compile(rf"(?:\d\d-\d{{3}}|miejscowo\w*|miast\w*|gmin\w*|in|dzielnic\w*|ortsteil|район|місто|obręb|woj|gm|na|to){_GAP}*$", re.I)


def _forms(name: str) -> set[str]:
    """Folded case forms of a given name."""
    n = fold_py(name)
    if n.endswith("a"):
        s = n[:-1]
        return {n, s + "e", s + "y", s + "i", s + "o", s + "ie", s + "ii", s[:-1] + "ze", s[:-1] + "dzie", s[:-1] + "cie"}
    if n.endswith(("y", "i")):
        return {n, n[:-1] + "ego", n[:-1] + "emu", n + "m", n + "ego"}
    s = n[:-2] + n[-1] if n.endswith(("ek", "el")) else n
    return {n, s + "a", s + "owi", s + "em", s + "iem", s + "u", s + "ie"}


GIVEN = {f for n in GIVEN_NAMES for f in _forms(n)} | {fold_py(n) for n in OTHER_GIVEN_NAMES}
_CUE = re.compile(r"(?<!\w)(?:" + "|".join(sorted(NAME_CUES, key=len, reverse=True)) + rf")(?:\.|:|,)?{_GAP}{{1,2}}(?:[–-]{_GAP})?$")
_NAME_END = re.compile(r"(?:sk|ck|dzk|zk)(?:i|a|iego|iej|im|iemu|a)$|(?:czyk|wicz|enko|chuk|shyn|mann|bauer|meier|maier|schmidt|son|smith|er|man|ez|ak|ek|ik|uk|yk)(?:a|iem|em|owi)?$")
# Capitalised words that stand before names or begin sentences.
NOT_SURNAMES = {
    "kontakt", "contact", "seller", "pelnomocnik", "wlascicielem", "wlasciciel", "opiekun", "zapraszam", "prosze", "ask", "mail", "tel", "telefon", "pan", "pani", "panem", "pania", "agent", "doradca", "klucze", "adres", "lokal",
    "prezentacja", "umowe", "dowod", "pesel", "dzwon", "napisz", "polecam", "mieszkanie", "dom", "oferta", "osiedle", "ulica", "dzialka", "dr", "mgr", "inz", "herr", "frau", "mr", "mrs", "ms", "eigentumer", "besichtigung", "viewings", "sprzedaje",
}


def _unlisted(text: str, first: tuple, second: tuple, joined: bool) -> bool:
    """Whether two words read as a given name outside the lists and a surname, by what stands before them."""
    if not joined or second[2][-1] == "." or len(second[2]) < 4:
        return False
    words = fold_py(first[2]), fold_py(second[2])
    if any(w in NOT_SURNAMES or w in NAME_CUES for w in words) or not _NAME_END.search(words[1]):
        return False
    return _CUE.search(fold_py(text[max(0, first[0] - 24) : first[0]])) is not None


def _persons(text: str) -> list[tuple[int, int]]:
    caps = [(m.start(), m.end(), m.group()) for m in _CAP.finditer(text)]
    joined = lambda x, y: re.fullmatch(f"{_GAP}{{1,3}}", text[x[1] : y[0]]) is not None or x[2].endswith(".") and x[1] == y[0]
    given = [c[2][-1] != "." and (f := fold_py(c[2])) in GIVEN or c[2][-1] != "." and "-" in c[2] and fold_py(c[2]).split("-")[0] in GIVEN and fold_py(c[2]).split("-")[1] in GIVEN for c in caps]
    surname = lambda i: len(caps[i][2]) >= 4 and caps[i][2][-1] != "." and fold_py(caps[i][2]) not in NOT_SURNAMES
    out, i, n = [], 0, len(caps)
    while i < n:
        start, end, word = caps[i]
        initial = word[-1] == "."
        if not (given[i] or initial) or _PATRON.search(text, max(0, start - 60), start):
            # A given name that no list has: two capitalised words after a word that announces a person, the second like a surname.
            if not (given[i] or initial) and i + 1 < n and _unlisted(text, caps[i], caps[i + 1], joined(caps[i], caps[i + 1])):
                out.append((start, caps[i + 1][1]))
                i += 1
            i += 1
            continue
        j = i
        while j + 1 < n and joined(caps[j], caps[j + 1]) and (given[j + 1] or caps[j + 1][2][-1] == ".") and j + 2 < n and joined(caps[j + 1], caps[j + 2]):
            j += 1
        if j + 1 < n and joined(caps[j], caps[j + 1]) and surname(j + 1) and not (initial and _PLACE.search(text, max(0, start - 20), start)):
            out.append((start, caps[j + 1][1]))
            i = j + 2
            continue
        if given[i] and i > 0 and joined(caps[i - 1], caps[i]) and surname(i - 1) and not given[i - 1] and (not out or out[-1][1] <= caps[i - 1][0]):
            before = text[max(0, caps[i - 1][0] - 3) : caps[i - 1][0]].rstrip(" \t" + chr(0xA0))
            begins = not before or before[-1] in ".!?\n>•-"
            if (not begins or _SURNAME_END.search(fold_py(caps[i - 1][2]))) and not _PATRON.search(text, max(0, caps[i - 1][0] - 60), caps[i - 1][0]):
                out.append((caps[i - 1][0], end))
        i += 1
    return out


#: Centuries by what is added to the month.
_CENTURIES = {0: 1900, 20: 2000, 40: 2100, 60: 2200, 80: 1800}


def _pesel(digits: str) -> bool:
    """Whether eleven digits hold a day that exists and the right check digit."""
    shift = int(digits[2:4]) // 20 * 20
    year, month, day = _CENTURIES[shift] + int(digits[:2]), int(digits[2:4]) - shift, int(digits[4:6])
    weighted = sum(int(d) * w for d, w in zip(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)))
    return 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1] and (weighted + int(digits[10])) % 10 == 0


def _local_part(t: str, at: int) -> int | None:
    """Where the local part of an address before the at sign at ``at`` begins, however long it is."""
    end = at - (t[max(0, at - 1) : at] == "\n")
    is_word = lambda c: c.isalnum() or c == "_"
    if end == 0 or not is_word(t[end - 1]):
        return None
    start = end
    while start and (is_word(t[start - 1]) or t[start - 1] in ".+-"):
        start -= 1
    while not is_word(t[start]):
        start += 1
    return start


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention in a text, in order, without overlaps."""
    if not text:
        return []
    p = transduce(text)
    t, found = p.text, []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    at = t.find("@")
    while at >= 0:
        local, domain = _local_part(t, at), _DOMAIN.match(t, at + 1)
        if local is not None and domain:
            found.append((local, domain.end(), "email"))
        at = t.find("@", at + 1)
    runs = [(m.start(), m.end()) for m in _RUN.finditer(t)]
    for a, b in runs:
        for m in _PESEL.finditer(t, a, b + 3):
            if _pesel(m.group()):
                found.append((m.start(), m.end(), "id_number"))
    for m in (m for a, b in runs for m in _PHONE.finditer(t, a, b + 3)):
        digits = sum(c.isdigit() for c in m.group())
        abroad = m.group()[0] == "+" or m.group()[:2] in ("(+", "00")
        if (9 <= digits <= 15 if abroad else digits == 9) and free(m.start(), m.end()) and not _NOT_PHONE.search(t, max(0, m.start() - 40), m.start()) and not _AMOUNT.match(t, m.end()):
            found.append((m.start(), m.end(), "phone"))
    for m in _CARD.finditer(t):
        series = _SERIES.search(t, max(0, m.start() - 4), m.start())
        if series and free(series.start(), m.end()) and not _NOT_PHONE.search(t, max(0, series.start() - 40), series.start()):
            said = _CARD_WORD.search(t, max(0, series.start() - 60), series.start())
            if said or series.group(1).isupper() and not _PHONE_WORD.search(series.group(1)):
                found.append((series.start(), m.end(), "id_number"))
    found += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(t) if free(m.start(), m.start() + 3)]
    found += [(a, b, "person") for a, b in _persons(t) if free(a, b)]
    return sorted((*p.source(a, b), kind) for a, b, kind in found)


def redact(text: str | None) -> str | None:
    """The text with every mention replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in mentions(text):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]


def find_mentions(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, start_pos, end_pos``: one row per mention; positions count Unicode characters from 0."""

    def run(batches):
        for b in batches:
            rows = [(d, k, s, e) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for s, e, k in mentions(t)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "kind", "start_pos", "end_pos"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def redact_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: documents with typed placeholders in place of the mentions."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([redact(t) for t in b["text"].to_pylist()], pa.string())], names=["doc_id", "text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, text string")
