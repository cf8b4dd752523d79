"""Personal information in free text: found by anchors, replaced with typed placeholders.

An Aho-Corasick automaton runs once over each text and finds the anchors: at-signs written as signs or
words, schemes of addresses, digits, cues of identity and account numbers, street words, forms of
address, given names, initials, and words that stand beside a person's name. Nothing else reads the
text: at each anchor a deterministic local parser expands to the left and right, as far as the item
goes, and validates what it has found. Texts are read where they lie, in Arrow batches, and whole;
only the items found and one small row per key are shuffled.

The given names are those of a table of people and a fixed list of short forms; surnames need no list.
A name whose given name is in neither is found by its form of address, its initial, or a word beside it
such as in "called" or "my name is". A street in lower case needs a cue within ``CUE_REACH`` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.names import BUSINESS, LEGAL, SHORT

#: Given names that are broadcast at most; with more the finder isn't built, so none is left out unseen.
MOST_NAMES = 500_000
#: Characters from a cue to what it stands for.
CUE_REACH = 32
#: Words that mark streets before or after their name, and words that no name consists of.
STREET_AFTER = "street st road rd avenue ave lane ln close way drive dr court ct terrace boulevard blvd rise place square crescent gardens row hill grove mews parade walk".split()
STREET_BEFORE = "via viale rue calle avenida avenue rua plaza piazza corso paseo camino carrer boulevard chemin impasse".split()
STREET_JOINED = "straße strasse str weg allee platz gasse ring damm ufer".split()
TITLES = "mr mrs ms miss dr prof professor sir madam".split()
#: Words beside a person's name, after it and before it.
PERSON_VERBS = "called phoned emailed texted wrote said asked replied answered signed".split()
PERSON_CUES = ["my name is", "name is", "signed by", "speaking with", "regards,"]
SCHEMES = {"mailto:": "mail", "tel:": "tel", "sms:": "tel", "callto:": "tel", "http://": "url", "https://": "url", "ftp://": "url", "www.": "url"}
ACCOUNTS = ["account", "account no", "account number", "acct", "a/c", "iban", "card", "card number", "card no", "sort code"]
CUES = {"ssn": "ssn", "social": "ssn", "security number": "ssn", "passport": "passport", "insurance no": "ni", "ni number": "ni", "national insurance": "ni"}
COMMON = set(
    "a about after again all also am an and any are as at be because been before but by came can could did do does down else ever for from get go goes got had has have he her here him his how i if in into is it its just "
    "keep last left less like made make may me met more most mr mrs ms much my near next no nor not now of off on once one only onto or other our out over own past per please said same says she should since so some still "
    "than that the their them then there these they this those though to too took two under until up us via wants was we well went were what when where which while who why will with without would yes yet you your".split()
)
_ADDRESS_CUE = re.compile(rf"(?:address|deliver|ship|pick up|moved to|viewing|lives?|flat \w+,|house|visit|send it)[^.!?\n]{{0,{CUE_REACH}}}$", re.I)
_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_NAME_WORD = re.compile(_W)
_DIRECTION = re.compile(r"[NSEW]\.?|North|South|East|West", re.I)
_NUMBER = re.compile(r"\d{1,5}[A-Za-z]?")
_AT_SIGN = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\.)[A-Za-z0-9-]+)+", re.I)
_DOT_WORD = re.compile(r"[\[({]\s*dot|\sdot\s", re.I)
_PHONE = re.compile(
    r"(?<![\w.,#/+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}([.-])\d{3}\1\d{4}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4} \d{3,4} \d{3,4}|[01]\d{10}|0\d{9})"
    r"(?![\w/]|[.,-]\d)(?:,? ?(?:ext\.?|x) ?\d{1,5})?",
    re.I,
)
_DIALLED = re.compile(r"\+?\d[\d().-]{4,18}\d")
_URL = re.compile(r"[^\s<>\"']+")
_SSN = re.compile(r"(?<![\w.,#/-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})(?![\w-])")
_BY_CUE = {
    "ssn": re.compile(rf"[^\d\n]{{0,{CUE_REACH}}}?(?<![\w-])(\d{{9}}|\d{{3}}[ -]\d{{2}}[ -]\d{{4}})(?!\w)"),
    "passport": re.compile(rf"[^\d\n]{{0,{CUE_REACH}}}?(?<![\w-])([A-Za-z]{{1,2}}\d{{6,8}}|\d{{9}})(?!\w)"),
    "ni": re.compile(rf"[^\d\n]{{0,{CUE_REACH}}}?(?<![\w-])([A-Za-z]{{2}} ?\d{{2}} ?\d{{2}} ?\d{{2}} ?[A-Da-d])(?!\w)"),
}
_ACCOUNT = re.compile(r"[ :#.]*+(?:(?:number|no|nr|is|was|reads|ending in)\b[ :#.]*+){0,3}(?<![\w.,/+(-])(\d{2}-\d{2}-\d{2}(?: \d{6,8})?|\d{4}(?:[ -]\d{4}){1,3}(?:[ -]\d{1,3})?|\d{6,18})(?![\w-])", re.I)
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.,#/+-])(?:\d{4}(?:[ -]\d{4}){3}|\d{15,16})(?![\w-])")
_AFTER_STREET = re.compile(rf" (?:(?:del|de la|de los|de|du|des|della|di|da) )?({_W}(?: {_W})?) \d{{1,4}}[A-Za-z]?(?!\w|[.,:]\d)", re.I)
_HOUSE_NO = re.compile(r"\.? \d{1,4}[A-Za-z]?(?!\w|[.,:]\d)")
_SURNAME = re.compile(rf" (?:[A-Za-z]\.? )?({_W})")
_TITLED = re.compile(rf"\.? ({_W}(?: {_W})?)")
_INITIAL = re.compile(rf"(?<![\w.'’@])([A-Za-z])\. ({_W})(?![\w@])")
_FULL_NAME = re.compile(rf" ({_W}) (?:[A-Z]\.? )?({_W})")
_PLACES = {*STREET_AFTER, *STREET_BEFORE, *BUSINESS, *LEGAL, *"monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()}


def _left(text: str, at: int, more: str, letters: bool = False) -> int:
    """Where the run of letters, digits (unless ``letters``) and the signs ``more`` begins that ends at ``at``."""
    while at and ((text[at - 1].isalpha() if letters else text[at - 1].isalnum()) or text[at - 1] in more):
        at -= 1
    return at


def _mod_97(code: str) -> bool:
    """The check of an international account number."""
    code = code.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _luhn(digits: str) -> bool:
    """The check of a card's number."""
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return len(d) > 12 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _is_surname(word: str, shouting: bool, lower: bool) -> bool:
    """Whether ``word`` can be a surname: capitalised, or anything but a common word where nothing is."""
    if word.lower() in COMMON or len(word) < 3:
        return False
    if word[0].isupper():
        return shouting or not word.isupper()
    return lower


class Finder:
    """The automaton and the parsers behind its anchors."""

    def __init__(self, given: list[str]):
        self.given = {g.lower() for g in given} | set(SHORT) | {s for short in SHORT.values() for s in short.split() if len(s) > 2}
        self.given -= COMMON
        self.automaton = None

    def __getstate__(self):
        return {"given": self.given, "automaton": None}

    def _build(self) -> None:
        kinds: dict[str, list[str]] = {}
        groups = {
            "given": self.given, "title": TITLES, "after": STREET_AFTER, "before": STREET_BEFORE, "joined": STREET_JOINED, "cue": CUES, "account": ACCOUNTS, "scheme": SCHEMES, "verb": PERSON_VERBS,
            "person": PERSON_CUES, "at": ["at"], "sign": ["@"], "digit": "0123456789", "initial": [". "],
        }
        for kind, words in groups.items():
            for w in words:
                kinds.setdefault(w, []).append(kind)
        self.automaton = ahocorasick.Automaton()
        for w, k in kinds.items():
            self.automaton.add_word(w, (len(w), w, tuple(k), w[0].isalnum() and w[-1].isalnum() and not w.isdigit() and k[0] != "joined"))
        self.automaton.make_automaton()

    def _anchors(self, low: str) -> dict[str, list[tuple[int, int, str]]]:
        """(begin, end, word) of all anchors by kind; of digits only where a run begins."""
        anchors: dict[str, list[tuple[int, int, str]]] = {}
        n, digit = len(low), -1
        for last, (size, word, kinds, bounded) in self.automaton.iter(low):
            begin, end = last + 1 - size, last + 1
            if kinds[0] == "digit":
                if begin != digit:
                    anchors.setdefault("digit", []).append((begin, end, word))
                digit = end
                continue
            if bounded and (end < n and low[end].isalnum() or begin and low[begin - 1].isalnum()):
                continue
            if kinds[0] == "joined" and end < n and low[end].isalnum():
                continue
            for kind in kinds:
                anchors.setdefault(kind, []).append((begin, end, word))
        return anchors

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, kind) of the items of ``text``, in order and without overlaps."""
        if self.automaton is None:
            self._build()
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        anchors = self._anchors(low)
        found: list[tuple[int, int, str]] = []
        if "at" in anchors or "sign" in anchors:
            self._emails(text, anchors, found)
        if "after" in anchors or "before" in anchors or "joined" in anchors:
            streets: list[tuple[int, int, str]] = []
            self._addresses(text, low, anchors, streets)
            found += sorted(streets, key=lambda x: (x[0], -x[1]))  # of two that begin alike the longer
        if "digit" in anchors:
            self._numbers(text, anchors, found)
        self._names(text, low, anchors, found)
        out: list[tuple[int, int, str]] = []
        taken = bytearray(len(text) if found else 0)
        for begin, end, kind in found:  # a parser's items give way to those of the parsers before it
            if not any(taken[begin:end]):
                taken[begin:end] = b"\1" * (end - begin)
                out.append((begin, end, kind))
        return sorted(out)

    def _emails(self, text, anchors, found) -> None:
        n = len(text)

        def local(at: int) -> int:
            begin = _left(text, at, "_.%+-")
            while begin < at and text[begin] in ".-":
                begin += 1
            return begin

        for begin, _, _ in anchors.get("sign", ()):
            if (start := local(begin)) < begin and (domain := _AT_SIGN.match(text, begin)):
                found.append((start, domain.end(), "email"))
        for begin, end, _ in anchors.get("at", ()):  # as a word, between blanks or in brackets
            a, b = begin, end
            while a and text[a - 1].isspace():
                a -= 1
            while b < n and text[b].isspace():
                b += 1
            bracketed = a > 0 and b < n and text[a - 1] in "[({" and text[b] in "])}"
            if bracketed:
                a, b = a - 1, b + 1
                while a and text[a - 1].isspace():
                    a -= 1
                while b < n and text[b].isspace():
                    b += 1
            elif a == begin or b == end:
                continue
            if (start := local(a)) < a and (domain := _DOMAIN.match(text, b)) and (bracketed or _DOT_WORD.search(domain.group()) and not COMMON & set(domain.group().lower().split())):
                found.append((start, domain.end(), "email"))

    def _addresses(self, text, low, anchors, found) -> None:
        lower = text == low
        cued = lambda at: _ADDRESS_CUE.search(text[max(0, at - 2 * CUE_REACH) : at])
        for begin, end, word in anchors.get("after", ()):
            names, at = [], begin
            while at and text[at - 1] == " " and len(names) < 5:  # word by word to the left, up to the number
                start = text.rfind(" ", 0, at - 1) + 1
                start = max(start, _left(text, at - 1, "'’-."))
                w, at = text[start : at - 1], start
                if _NUMBER.fullmatch(w):
                    break
                if not (_NAME_WORD.fullmatch(w) or _DIRECTION.fullmatch(w)):
                    at = -1
                    break
                names.append(w)
            else:
                at = -1
            if at < 0 or not names or at and (text[at - 1].isalnum() or text[at - 1] in "_.,:#/-"):
                continue
            if len(names) > 3 and not _DIRECTION.fullmatch(names[-1]) or any(not _NAME_WORD.fullmatch(w) for w in names[:-1]):
                continue
            names = [w for w in names if not _DIRECTION.fullmatch(w)]
            if not names or any(w.lower() in COMMON for w in names):
                continue
            proper = all(w[0].isupper() for w in names) and text[begin].isupper()
            if proper or cued(at):
                found.append((at, end + (text[end : end + 1] == "." and len(word) < 5), "street_address"))
        for begin, end, _ in anchors.get("before", ()):
            if (m := _AFTER_STREET.match(text, end)) and not any(w.lower() in COMMON for w in m.group(1).split()):
                if lower or (text[begin].isupper() and m.group(1)[0].isupper()) or cued(begin):
                    found.append((begin, m.end(), "street_address"))
        for begin, end, _ in anchors.get("joined", ()):
            start = _left(text, begin, "-", letters=True)
            if begin - start >= 3 and (m := _HOUSE_NO.match(text, end)) and (lower or text[start].isupper() or cued(start)):
                found.append((start, m.end(), "street_address"))

    def _numbers(self, text, anchors, found) -> None:
        """Identity numbers, accounts and phone numbers, from cues and the beginnings of runs of digits."""
        runs = [begin for begin, _, _ in anchors["digit"]]
        for begin, end, word in anchors.get("cue", ()):
            if m := _BY_CUE[CUES[word]].match(text, end):
                found.append((*m.span(1), "id_number"))
        for begin, end, word in anchors.get("account", ()):
            if m := _ACCOUNT.match(text, end):
                found.append((*m.span(1), "account_number"))
        urls = [(end, m.end(), SCHEMES[word]) for _, end, word in anchors.get("scheme", ()) if (m := _URL.match(text, end))]
        for begin, _, kind in urls:
            if kind == "tel" and (m := _DIALLED.match(text, begin)):
                found.append((*m.span(), "phone"))
        k, past = 0, -1
        ids, accounts, phones = [], [], []
        id_end = account_end = phone_end = -1
        for begin in runs:
            while k < len(urls) and urls[k][0] <= begin:  # digits of a web address are neither
                past = max(past, urls[k][1] if urls[k][2] == "url" else -1)
                k += 1
            if begin < past:
                continue
            if begin >= id_end and (m := _SSN.match(text, begin)):
                ids.append((*m.span(), "id_number"))
                id_end = m.end()
            start = begin - 2
            if begin >= account_end and start >= 0 and text[start:begin].isalpha() and not (start and text[start - 1].isalnum()) and (m := _IBAN.match(text, start)) and (size := self._checked(m.group())):
                accounts.append((start, start + size, "account_number"))
                account_end = start + size
            elif begin >= account_end and (m := _CARD.match(text, begin)) and _luhn(m.group()):
                accounts.append((*m.span(), "account_number"))
                account_end = m.end()
            start = begin - (begin > 0 and text[begin - 1] in "+(")
            if start >= phone_end and (m := _PHONE.match(text, start) or (start < begin and _PHONE.match(text, begin)) or None):
                phones.append((*m.span(), "phone"))
                phone_end = m.end()
        found += ids + accounts + phones

    @staticmethod
    def _checked(code: str) -> int:
        """Characters of ``code`` that are a valid account number; what follows it may look like more of it."""
        while len(code) >= 15:
            if _mod_97(code):
                return len(code)
            code = code[: code.rfind(" ")] if " " in code else ""
        return 0

    def _names(self, text, low, anchors, found) -> None:
        lower, shouting = text == low, text == text.upper()
        ends = -1
        for begin, end, _ in anchors.get("given", ()):
            after = text[end : end + 1]
            if begin < ends or after and after in "@+_" or after == "." and text[end + 1 : end + 2].isalnum() or begin and text[begin - 1] in "@._+-":
                continue
            first_lower = text[begin].islower()
            if first_lower and not lower and not text[begin:end].islower():
                continue
            loose = lower or first_lower
            if (m := _SURNAME.match(text, end)) and _is_surname(m.group(1), shouting, loose) and not (loose and m.group(1).lower() in TITLES):
                found.append((begin, m.end(), "person_name"))
                ends = m.end()
            elif text[begin - 2 : begin] == ", " and (start := self._word_start(text, begin - 2)) < begin - 2 and _is_surname(text[start : begin - 2], shouting, loose):
                found.append((start, end, "person_name"))
        for _, end, _ in anchors.get("title", ()):
            if (m := _TITLED.match(text, end)):
                first, *rest = m.group(1).split()
                if _is_surname(first, shouting, lower or first[0].islower()):
                    stop = m.start(1) + len(first)
                    if rest and rest[0][0].isupper() and _is_surname(rest[0], shouting, False):
                        stop = m.end()
                    found.append((m.start(1), stop, "person_name"))
        for begin, _, _ in anchors.get("initial", ()):
            if begin and (m := _INITIAL.match(text, begin - 1)) and _is_surname(m.group(2), shouting, m.group(1).islower() and m.group(2)[0].islower()) and len(m.group(2)) > 3:
                found.append((*m.span(), "person_name"))
        if shouting:
            return
        for begin, _, _ in anchors.get("verb", ()):  # the two words before it, if no third belongs to them
            last = self._word_start(text, begin - 1) if text[begin - 1 : begin] == " " else begin
            first = self._word_start(text, last - 1) if last < begin - 1 and text[last - 1 : last] == " " else last
            before = text[self._word_start(text, first - 1) : first - 1] if text[first - 1 : first] == " " else ""
            if first < last - 1 and not before[:1].isupper() and all(self._is_name(w) for w in (text[first : last - 1], text[last : begin - 1])):
                found.append((first, begin - 1, "person_name"))
        for _, end, _ in anchors.get("person", ()):
            if (m := _FULL_NAME.match(text, end)) and self._is_name(m.group(1)) and self._is_name(m.group(2)):
                found.append((m.start(1), m.end(), "person_name"))

    @staticmethod
    def _word_start(text: str, at: int) -> int:
        """Where the word of a name begins that ends at ``at``."""
        begin = _left(text, at, "'’-", letters=True)
        while begin < at and not text[begin].isalpha():
            begin += 1
        return begin if begin < at and text[at - 1].isalpha() and not (begin and (text[begin - 1].isdigit() or text[begin - 1] in "_@.")) else at

    @staticmethod
    def _is_name(word: str) -> bool:
        """Whether a word is written as a name and is none of a street, firm or day."""
        return len(word) > 2 and word[0].isupper() and word[1:].islower() and word.lower() not in COMMON and word.lower() not in _PLACES


def redacted(text: str, items: list[tuple[int, int, str]]) -> str:
    """``text`` with a typed placeholder for each item; ``items`` are in order and don't overlap."""
    parts, at = [], 0
    for begin, end, kind in items:
        parts += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def finder(people: DataFrame, name: str = "display_name") -> Finder:
    """A finder with all given names of ``people``, the first words of their names; an error if there are more than MOST_NAMES."""
    first = F.lower(F.regexp_extract(F.trim(F.col(name)), r"^([\p{L}'’-]+)\s+\p{L}", 1))
    given = people.select(first.alias("given")).where(F.length("given") > 2).distinct().limit(MOST_NAMES + 1).collect()
    if len(given) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names can't be broadcast")
    return Finder(sorted(r.given for r in given))


def items(texts: DataFrame, found_by: Finder) -> DataFrame:
    """(field, record_key, received_at, pii_kind, start_pos, length) of every item; ``texts`` has field, record_key, received_at, text."""
    held = texts.sparkSession.sparkContext.broadcast(found_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            at, kinds, begins, sizes = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for begin, end, kind in f.find(text) if text else ():
                    at.append(i)
                    kinds.append(kind)
                    begins.append(begin + 1)
                    sizes.append(end - begin)
            own = batch.select(["field", "record_key", "received_at"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(kinds, pa.string()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())], names=["field", "record_key", "received_at", "pii_kind", "start_pos", "length"])

    return texts.select("field", "record_key", "received_at", "text").mapInArrow(run, "field string, record_key string, received_at bigint, pii_kind string, start_pos bigint, length bigint")


def _received() -> Column:
    return F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(2**63))).alias("received_at")


def _texts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row (field, record_key, received_at, text) for each text of ``df``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields]))
    return df.select(F.col(key).cast("string").alias("record_key"), _received(), pairs.alias("p")).select("p.field", "record_key", "received_at", "p.text").where("text is not null")


def found(df: DataFrame, key: str, fields: list[str], found_by: Finder) -> DataFrame:
    """(field, record_key, pii_kind, start_pos, length): each item in the latest delivery of each key.

    Kinds are email, phone, id_number, street_address, person_name and account_number.

    Positions count from 1 in code points. Null and empty texts have no items; rows that tie as the
    latest give each item once; rows with a null key are one key; an empty table gives no rows; other
    columns are not read. Only the items and each key's latest time are shuffled.
    """
    all_items = items(_texts(df, key, fields), found_by).distinct()
    latest = df.select(F.col(key).alias("k"), _received()).groupBy("k").agg(F.max("received_at").alias("latest")).select(F.col("k").cast("string").alias("latest_key"), "latest")
    mine = all_items.join(latest, F.col("record_key").eqNullSafe(F.col("latest_key")) & (F.col("received_at") == F.col("latest")), "left_semi")
    return mine.select("field", "record_key", "pii_kind", "start_pos", "length")


def cleaned(df: DataFrame, fields: list[str], found_by: Finder) -> DataFrame:
    """``df`` with typed placeholders for the items of the text columns ``fields``; all else is as it was, and nothing is shuffled."""
    held = df.sparkSession.sparkContext.broadcast(found_by)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            columns = [
                pa.array([redacted(t, f.find(t)) if t else t for t in c.to_pylist()], pa.string()) if name in fields else c for name, c in zip(names, batch.columns)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
