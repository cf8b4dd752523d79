"""Variant spellings of people and organisations linked to the spelling they most likely come from.

A noisy channel: spellings that are frequent are candidate canonical forms; each other form goes to
the candidate with the greatest product of its frequency and the likelihood that typing it gives the
form by typos, a nickname, initials, a reordering, a user name or a dropped middle name. The form
itself is a hypothesis, too: that it is a name of its own. It wins over a typo if its words are used in
other names, or if it is used too often for a typo, as with two people of whom one is called John and
the other Joan; so no chain leads over two frequent names. How often typos and abbreviations occur,
and what share of a name's uses a typo has, is estimated from the counts.

Candidates are found by equi-joins on deletion keys, never by comparing all names: two words within
one edit share the word itself or one of its forms with a letter left out. A form is attached only to
one that is more frequent or has a middle name that it lacks, so attachments form trees, and pointer
doubling finds every form's root.

Only distinct spellings and their counts are joined; the counts are combined before the shuffle, so a
label that holds a third of all rows is one row. What is known of words and word pairs stays in tables;
only eleven sums come to the driver.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.turns import NOBODY, OWN
from tidelog.sources import cut

#: Letters from which a word's halves are keys in place of its forms with a letter left out; one edit leaves one half as it is.
LONGEST = 100
#: Log-likelihoods of the channel's ways to write a name before any is counted.
WAYS = {"typo": -4.0, "nickname": -2.3, "initial": -2.5, "user name": -4.0, "dropped": -2.0}
#: What is supposed before any typo is counted: so many typos, of which each has one in ``RARE`` of its name's uses, one typed form in ten names.
SUPPOSED, RARE, TYPED = 40.0, 40.0, 0.1
#: So many names are supposed to have a word of their own before any is counted; a table of fewer says little of how many words are still unseen.
NOVEL = 1000.0
#: Ways to mistype a letter (others in its place or before it, none, swapped); letters of which a word that is no known name is made, and how many such words are names.
MISTYPED, LETTERS, UNKNOWN = 54, 26, 1e6
#: Forms of address, roles after a name, legal forms and what else follows an organisation's name.
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "sir", "madam", "rev", "hon"}
ROLES = {"host", "guest", "moderator", "speaker", "interpreter", "caller", "agent"}
LEGAL = {"inc", "incorporated", "llc", "ltd", "limited", "gmbh", "co", "company", "corp", "corporation", "plc", "ag", "sa", "bv"}
BUSINESS = {
    "law", "office", "clinic", "media", "studio", "studios", "logistics", "robotics", "plumbing", "catering", "insurance", "travel", "software", "dental", "bakery",
    "electric", "transport", "garden", "supply", "bank", "foundation", "school", "university", "hospital", "museum", "consulting", "group", "partners", "services",
}
#: Short forms of given names in common use.
SHORT = {
    "abigail": "abby abbie gail", "alexander": "alex sasha xander sandy al", "amara": "mara", "anthony": "tony ant", "benjamin": "ben benji benny", "bogdan": "bodya", "carmen": "carm",
    "charlotte": "charlie lottie lotte", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "edward": "ed eddie ted ned", "elizabeth": "liz beth lizzie eliza betty",
    "esther": "essie", "fatima": "fati", "francesca": "fran cesca frankie", "frederick": "fred freddie freddy", "gabriel": "gabe", "giulia": "giu", "gregory": "greg", "henrik": "henk rik", "hiroshi": "hiro",
    "isabella": "isa bella izzy", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jonathan": "jon jonny john", "joseph": "joe joey", "katherine": "kate kathy kat kitty katie", "lawrence": "larry",
    "leonardo": "leo", "madeleine": "maddie mad", "margaret": "maggie meg peggy marge", "mariana": "mari", "matthew": "matt", "michael": "mike mick mickey", "nadia": "nadya", "nicholas": "nick nico nicky", "obinna": "obi",
    "oksana": "ksana", "patricia": "pat patty trish", "quentin": "quin", "rebecca": "becky becca", "richard": "rick dick rich richie", "robert": "bob rob bobby robbie", "samuel": "sam sammy", "saskia": "sas",
    "stephanie": "steph", "theodore": "ted theo teddy", "theresa": "tess terri terry", "timothy": "tim timmy", "tomasz": "tomek tom", "valentina": "vale val tina", "victoria": "vicky tori vic", "william": "bill will billy willy",
    "yusuf": "yus", "zachary": "zach zack", "zoltan": "zoli",
}
FORMAL: dict[str, list[str]] = {}
for _name, _shorts in SHORT.items():
    for _short in _shorts.split():
        FORMAL.setdefault(_short, []).append(_name)

_GENERIC = re.compile(r"(?:speaker|spk|s|participant|voice|person)[\s_#.?-]*\d*")
_NOTE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]| - [^-]*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _person(words: list[str], plain: str) -> str | None:
    """The form of a person's words, in the order given names, surname; ``plain`` tells words written together apart."""
    long = [w for w in words if len(w) > 1]
    if len(long) >= 2:
        return "p|" + "|".join([*sorted((long[0], long[-1])), *([" ".join(long[1:-1])] if long[2:] else [])])
    if len(long) == 1:
        if initials := [w for w in words if len(w) == 1]:
            return f"i|{initials[0]}|{long[0]}"
        parts = [p for p in _CAMEL.split(_NOTE.sub(" ", plain).strip()) if len(p) > 1]
        if len(parts) == 2:
            return "p|" + "|".join(sorted(p.casefold() for p in parts))
        return "j|" + long[0]
    return None


def form_of(name: str) -> str | None:
    """The form behind a spelling: 'p|word|word' of a person, with '|middle names' if they are written out,
    'i|letter|word' with an initial, 'j|letters' written together, 'o|words' of an organisation; None for
    labels that name nobody.

    Case, accents, blanks, punctuation, order, titles, roles, middle initials and legal forms fall away.
    """
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).strip(" \t\r\n :>-")
    low = re.sub(r"\s+", " ", plain.casefold())
    if low in OWN or low in NOBODY or _GENERIC.fullmatch(low):
        return None
    bare = _NOTE.sub(" ", low).strip()
    head, _, tail = bare.rpartition(",")
    if head and tail.strip() in ROLES:
        bare = head
    bare = re.sub(r"\b(?:[a-z]\.){2,}", lambda m: m.group().replace(".", ""), bare)  # l.l.c.
    words = [w for w in _WORD.findall(bare) if w not in TITLES]
    if words and (set(words) & LEGAL or set(words[1:]) & BUSINESS or words[-2:] == ["front", "desk"]):
        stem = words[: -2 if words[-2:] == ["front", "desk"] else None]
        while stem and stem[-1] in LEGAL:
            stem.pop()
        stem = stem[1:] if stem[:1] == ["the"] and len(stem) > 1 else stem
        return "o|" + " ".join(stem) if stem else None
    surname, comma, given = bare.partition(",")
    if comma:
        words = [w for part in (given, surname) for w in _WORD.findall(part) if w not in TITLES]
    return _person(words, plain)


def _less(w: str) -> set[str]:
    """Keys of which words within one edit share one: the word and its forms with one letter left out, or, of a long word, its halves."""
    keys = {w}
    if len(w) <= LONGEST + 1:
        keys |= {w[:k] + w[k + 1 :] for k in range(len(w))}
    if len(w) >= LONGEST:
        keys |= {"<" + w[: LONGEST // 2], ">" + w[-(LONGEST // 2) :]}
    return keys


def keys_of(form: str) -> tuple[set[str], set[str]]:
    """(keys as a candidate, keys as a variant) of a form; what may come from a candidate shares a key with it."""
    kind, *parts = form.split("|")
    if kind == "o":
        own = {"o|" + d for d in _less(parts[0].replace(" ", ""))}
        return own, own
    if kind == "i":
        return set(), {f"i|{parts[0]}|{d}" for d in _less(parts[1])}
    if kind == "j":
        return set(), {"j|" + d for d in _less(parts[0])}
    a, b = parts[:2]
    pair = lambda x, y: "p|" + "|".join(sorted((x, y)))
    own = {pair(x, y) for x in _less(a) for y in _less(b)}
    candidate = own | {f"i|{x[0]}|{d}" for x, y in ((a, b), (b, a)) for d in _less(y)} | {"j|" + d for s in (a + b, b + a, a[0] + b, b[0] + a) for d in _less(s)}
    variant = own | {pair(f, d) for x, y in ((a, b), (b, a)) for f in FORMAL.get(x, ()) for d in _less(y)}
    return candidate, variant


def edits(a: str, b: str) -> int:
    """Letters added, dropped, changed or swapped with the next one; beyond one edit, 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) != len(b):
        return 1 if (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]) else 2
    if a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]):
        return 1
    return 2


class Way(NamedTuple):
    """How a candidate gives a variant: the way, the words mistyped and what was typed, and the word that stayed."""

    way: str
    old: tuple[str, ...] = ()
    new: tuple[str, ...] = ()
    stays: str = ""

    @property
    def likelihood(self) -> float:
        return WAYS.get(self.way, 0.0) + WAYS["typo"] * (len(self.old) - (self.way == "typo"))


def _typed(words: list[tuple[str, str]], most: int, way: str = "typo", stays: str = "") -> Way | None:
    """The way by at most one edit in each of ``most`` of the (meant, typed) words; None if that is not enough."""
    n = [edits(x, y) for x, y in words]
    if max(n) > 1 or sum(n) > most:
        return None
    wrong, right = [p for p, e in zip(words, n) if e], [x for (x, _), e in zip(words, n) if not e]
    return Way(way, tuple(x for x, _ in wrong), tuple(y for _, y in wrong), stays or (right[0] if right else ""))


def way_of(variant: str, candidate: str) -> Way | None:
    """The likeliest way from ``candidate``, meant, to ``variant``, typed; None if it hardly gives it."""
    kind, *v = variant.split("|")
    other, *c = candidate.split("|")
    if kind == "o" or other == "o":
        return _typed([(c[0].replace(" ", ""), v[0].replace(" ", ""))], 1) if kind == other else None
    if other != "p":  # written together or with an initial: no whole name
        return None
    orders = ((c[0], c[1]), (c[1], c[0]))
    if kind == "p":
        middle, meant = "".join(v[2:]), "".join(c[2:])
        if middle and middle != meant:  # other middle names are other people, unless all else is equal
            return _typed([(meant, middle)], 1, stays=c[0]) if meant and v[:2] == c[:2] else None
        dropped = "dropped" if meant and not middle else "typo"
        ways = [_typed([(x, v[0]), (y, v[1])], 2 if dropped == "typo" else 1, dropped) for x, y in orders]
        if dropped == "typo":
            ways += [_typed([(y, keep)], 1, "nickname", x) for n, keep in (v[:2], v[1::-1]) for x, y in orders if x in FORMAL.get(n, ())]
    elif kind == "i":
        ways = [_typed([(y, v[1])], 1, "initial") for x, y in orders if x[0] == v[0]]
    else:
        ways = [_typed([(s, v[0])], 1, "user name") for x, y in orders for s in (x + y, x[0] + y)]
    return max((w for w in ways if w), key=lambda w: (w.likelihood, w), default=None)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([form_of(x) for x in batch.column(0).to_pylist()], pa.string())], names=["name", "n", "form"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for form, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for candidate, keys in zip((True, False), keys_of(form)):
                for column, v in zip(rows, ([form] * len(keys), [n] * len(keys), [candidate] * len(keys), list(keys))):
                    column += v
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.bool_(), pa.string()))], names=["form", "n", "candidate", "key"])


_SCORED = pa.schema([("form", pa.string()), ("parent", pa.string()), ("n", pa.int64()), ("parent_n", pa.int64()), ("way", pa.string()), ("typos", pa.int32()), ("places", pa.float64()), ("unknown", pa.float64()), ("unknown_old", pa.float64()), ("old", pa.string()), ("new", pa.string()), ("stays", pa.string()), ("mistyped", pa.list_(pa.string())), ("first_guess", pa.float64())])
_SCORED_DDL = "form string, parent string, n bigint, parent_n bigint, way string, typos int, places double, unknown double, unknown_old double, old string, new string, stays string, mistyped array<string>, first_guess double"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _SCORED]
        for v, c, n, m in zip(*(x.to_pylist() for x in batch.columns)):
            if way := way_of(v, c):
                places = sum(math.log(MISTYPED * len(w)) for w in way.old)
                most = math.inf if v[0] == "o" else math.log(UNKNOWN)  # of an organisation all words are one
                unknown, unknown_old = (-sum(min(len(w) * math.log(LETTERS), most) for w in ws) for ws in (way.new, way.old))
                one = len(way.old) == 1 and way.way == "typo" and v[0] == "p"
                for column, value in zip(rows, (v, c, n, m, way.way, len(way.old), places, unknown, unknown_old, way.old[0] if one else None, way.new[0] if one else None, way.stays if one else None, list(way.new) if v[0] == "p" else [], math.log(m) + way.likelihood)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SCORED)], schema=_SCORED)


def _root(word: Column) -> Column:
    """A word, or the formal name of a short form, so that nicknames of one name don't count as different company."""
    formal = F.create_map(*[F.lit(x) for short, names in FORMAL.items() for x in (short, names[0])])
    return F.coalesce(F.element_at(formal, word), word)


def _attached(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(form, parent) of the forms that come from another: the greatest posterior among the candidates that beat the form itself.

    Against a typo stands a name of its own: as many names as have the unchanged word, times the chance
    that one has the typed word: by the names that have it in other company than the word it would be
    a typo of, or letter by letter if there are none, times the share of names with a word that no other
    name has and no typo explains. That share falls as the names of a large table use up the words there
    are, while ever more names have the unchanged word. The more frequent of the two may be the typo, so
    either may have been meant.
    """
    word = F.explode(F.expr("array(struct(w[1] as word, w[2] as beside), struct(w[2] as word, w[1] as beside))")).alias("x")
    words = counts.where("left(form, 2) = 'p|'").select(F.split("form", r"\|").alias("w")).select(word).select("x.word", "x.beside")
    known = cut(words.groupBy("word").agg(F.count_distinct(_root(F.col("beside"))).alias("company"), F.count(F.lit(1)).alias("names")))
    two = [F.least("old", "new").alias("one"), F.greatest("old", "new").alias("other")]
    shared = pairs.where("old is not null").groupBy(*two).agg(F.count_distinct(_root(F.col("stays"))).alias("shared"))
    beside = lambda word: F.greatest(F.coalesce(F.col(f"{word}_company") - F.col("shared"), F.lit(0)), F.lit(0)).alias(f"{word}_support")
    judged = (
        pairs.withColumns({"one": two[0], "other": two[1]})
        .join(shared, ["one", "other"], "left")
        .join(known.select(F.col("word").alias("new"), F.col("company").alias("new_company")), "new", "left")
        .join(known.select(F.col("word").alias("old"), F.col("company").alias("old_company")), "old", "left")
        .join(known.select(F.col("word").alias("stays"), "names"), "stays", "left")
        .select("form", "parent", "n", "parent_n", "way", "typos", "places", "unknown", "unknown_old", "names", "mistyped", "first_guess", beside("new"), beside("old"))
    )
    judged = cut(judged)
    # Estimates from each form's best candidate; words that are names elsewhere, too, prove nothing about typos.
    best = judged.groupBy("form").agg(F.max_by(F.struct("way", "typos", "new_support", "n", "parent_n"), F.struct("first_guess", "parent")).alias("b")).select("b.*")
    typo = (F.col("way") == "typo") & (F.col("typos") == 1) & (F.col("new_support") == 0)
    sums = best.agg(
        *[F.count_if(F.col("way") == w).alias(w) for w in WAYS if w != "typo"], F.count_if(typo).alias("typo"),
        F.coalesce(F.sum(F.when(typo, -F.log(F.col("parent_n") / (F.col("n") + F.col("parent_n"))))), F.lit(0.0)).alias("shares"),
    ).first()
    forms = counts.agg(F.count(F.lit(1)).alias("forms"), F.max("n").alias("most")).first()
    total = max(forms["forms"], 1)
    lone = known.where("company = 1").join(judged.select(F.explode("mistyped").alias("word")), "word", "left_anti").count()
    novel = F.when(F.expr("left(form, 2) = 'p|'"), math.log((lone + NOVEL) / (total + NOVEL))).otherwise(0.0)
    rarity = (sums["typo"] + SUPPOSED) / (sums["shares"] + SUPPOSED / RARE)  # the shares of typos are Beta(1, rarity)
    rate = {w: math.log((sums[w] + SUPPOSED * (TYPED if w == "typo" else math.exp(WAYS[w]))) / (total + SUPPOSED)) for w in WAYS}
    share = F.col("n") / (F.col("n") + F.col("parent_n"))

    def typed(share: Column, support: str, unknown: str) -> Column:
        """Log-odds that the form with this share of both's uses is a typo, and no name of its own."""
        counted = math.log(rarity) + (rarity - 1) * F.log(1 - share) + F.log(share) + math.log(1 + math.log(forms["most"] or 1))
        elsewhere = F.when(F.col(support) > 0, F.log(F.col(support) / F.lit(total))).otherwise(F.col(unknown) + novel)
        return rate["typo"] * F.col("typos") - F.col("places") + counted - F.coalesce(F.log("names"), F.lit(math.log(total))) - elsewhere

    one = F.greatest(typed(share, "new_support", "unknown"), typed(1 - share, "old_support", "unknown_old"))
    way = F.create_map(*[F.lit(x) for w in WAYS if w != "typo" for x in (w, rate[w])])
    posterior = F.log("parent_n") + F.when(F.col("way") == "typo", WAYS["typo"] * F.col("typos")).otherwise(F.element_at(way, F.col("way")) + WAYS["typo"] * F.col("typos"))
    kept = judged.where((F.col("way") != "typo") | (one > 0)).withColumn("posterior", posterior)
    return kept.groupBy("form").agg(F.max_by("parent", F.struct("posterior", "parent")).alias("parent"))


def linked(names: DataFrame, name: str = "speaker_name") -> DataFrame:
    """(name, n, form, entity): each distinct spelling with its count, its form and its entity's canonical form.

    ``names`` has a row per use. Null and blank names and labels that name nobody are left out; repeated
    rows only count; ties in the posterior go to the form that sorts last; an empty table gives no rows.
    """
    spelled = names.select(F.col(name).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    forms = cut(spelled.mapInArrow(_forms, "name string, n bigint, form string").where("form is not null"))
    # A form becomes a hundred keys: so few bytes that they would lie in one partition are spread before that.
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(forms.groupBy("form").agg(F.sum("n").alias("n")).repartition(parts, "form"))
    keyed = counts.mapInArrow(_keyed, "form string, n bigint, candidate boolean, key string")
    v, c = keyed.where("not candidate").alias("v"), keyed.where("candidate").alias("c")
    # Only to a form of more uses, or of as many and sorting first; forms that are no whole names, or lack a middle name, go to any.
    words = lambda x: F.size(F.split(F.col(f"{x}.form"), r"\|"))
    ahead = (F.col("v.form") != F.col("c.form")) & (F.expr("left(v.form, 2) in ('i|', 'j|')") | (words("v") < words("c")) | ((words("v") == words("c")) & F.expr("c.n > v.n or c.n = v.n and c.form < v.form")))
    pairs = v.join(c, F.col("v.key") == F.col("c.key")).where(ahead).select(F.col("v.form").alias("form"), F.col("c.form").alias("parent"), F.col("v.n").alias("n"), F.col("c.n").alias("parent_n")).distinct()
    best = _attached(counts, pairs.mapInArrow(_scored, _SCORED_DDL))
    links = cut(counts.select("form").join(best, "form", "left").select("form", F.coalesce("parent", "form").alias("parent")))
    while True:  # pointer doubling: a tree of depth d takes log2(d) rounds
        up = links.select(F.col("form").alias("parent"), F.col("parent").alias("above"))
        further = cut(links.join(up, "parent").select("form", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        links = further.select("form", "parent")
        if further.where("moved").isEmpty():
            break
    return forms.join(links, "form").select("name", "n", "form", F.col("parent").alias("entity"))


def same(entities: DataFrame) -> DataFrame:
    """(name_a, name_b): each pair of distinct spellings of one entity, the smaller first in byte order."""
    a, b = entities.select("entity", F.col("name").alias("name_a")), entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
