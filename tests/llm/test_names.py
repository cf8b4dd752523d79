"""Variant spellings of known people, and the candidate search against comparing all forms."""

import itertools
import math
import random

import pytest

from tidelog.llm import names

PEOPLE = ["Robert Holokar", "Victoria Tamomsogi", "Gabriel Norelon", "Zoë Wésillilu", "Leila Kalundlilu", "Lars Kalundlilu"]
VARIANTS = {
    "Robert Holokar": ["Holokar, Bob", "Dr. Robert Holokar", "ROBERT  HOLOKAR:", "Robert Hokokar", "RobertHolokar", "robert.holokar", "rholokar", "R. Holokar", "Robert J. Holokar (guest)", "Holokar Robert", "Roebrt Holokar - Finance", "R Holkar"],
    "Victoria Tamomsogi": ["Tori Tamomsogi", "Vicky Tamomsogi", "Tamomsogi, V.", "Victoria Tamomsogi, host"],
    "Gabriel Norelon": ["Gabe Norelon", "Gabriel Norellon [ext]"],
    "Zoë Wésillilu": ["Zoe Wesillilu", "Zoë Wesilillu"],
    "Leila Kalundlilu": ["Leila Kalundlil"],
    "Lars Kalundlilu": ["larss kalundlilu"],
    "Holokar Law Office Co": ["The Holokar Law Office", "holokar law office l.l.c.", "HOLOKAR LAW OFFICE FRONT DESK", "Holokra Law Office Limited"],
}
NOBODY = ["Speaker 2", "SPEAKER_01", "S3", "you", "Me:", "Unknown", "Noise", "speaker ?", "", "  ", "Spk 4"]
DDL = "speaker_name string, name int, n string, form string"


def uses(spark, counted):
    return spark.createDataFrame([(s, 1, "x", "y") for s, n in counted for _ in range(n)], DDL)


def test_variants(spark):
    counted = [(base, 30) for base in VARIANTS] + [(v, 3) for vs in VARIANTS.values() for v in vs] + [(x, 40) for x in NOBODY] + [(None, 9)]
    got = names.linked(uses(spark, counted))
    entity = {r.name: r.entity for r in got.collect()}
    assert set(entity) == {s for s, _ in counted if s is not None and s not in NOBODY}
    assert len({entity[b] for b in VARIANTS}) == len(VARIANTS)
    for base, vs in VARIANTS.items():
        assert {v: entity[v] for v in vs} == dict.fromkeys(vs, entity[base])
    pairs = {tuple(r) for r in names.same(got).collect()}
    want = {tuple(sorted(p, key=str.encode)) for base, vs in VARIANTS.items() for p in itertools.combinations([base, *vs], 2)}
    assert pairs == want


def test_candidates_are_complete():
    rnd = random.Random(3)
    letters = "abcdefghij"
    word = lambda: "".join(rnd.choices(letters, k=rnd.randint(3, 6)))

    def typed(w):
        k = rnd.randrange(len(w))
        return rnd.choice([w, w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]])

    for _ in range(3000):
        a, b = rnd.choice([*names.SHORT, word(), word()]), word()
        first = rnd.choice([a, *names.SHORT.get(a, "").split()])
        form = rnd.choice(["p|" + "|".join(sorted((first, typed(b)))), "p|" + "|".join(sorted((typed(a), typed(b)))), f"i|{a[0]}|{typed(b)}", "j|" + typed(rnd.choice([a + b, a[0] + b, b + a]))])
        candidate = "p|" + "|".join(sorted((a, b)))
        if names.way_of(form, candidate):
            assert names.keys_of(form)[1] & names.keys_of(candidate)[0], (form, candidate)


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "xabc", 1), ("abc", "abd", 1), ("abcd", "badc", 2), ("abc", "abcde", 2), ("", "a", 1), ("abc", "cab", 2)])
def test_edits(a, b, n):
    assert names.edits(a, b) == names.edits(b, a) == n


APART = [("John Smith", 1000), ("Joan Smith", 999), ("Maria Berg", 40), ("Mario Berg", 39), ("Mary Lee Jones", 20), ("Mary Ann Jones", 18), ("Alexander Lund", 300), ("Alexandra Lund", 290)]


@pytest.mark.parametrize("counted", [APART[:2], APART[2:4], APART[4:6], APART[6:], APART, [("Abcdefgh Lopez", 900), ("Abcdefgx Lopez", 700), ("Abcdefyx Lopez", 500)]])
def test_two_frequent_names_stay_apart(spark, counted):
    assert len({r.entity for r in names.linked(uses(spark, counted)).collect()}) == len(counted)


def test_a_word_of_other_names_is_no_typo(spark):
    counted = [(f"{given} {family}", 30) for given in ("Karin", "Karen") for family in ("Ostolo", "Belvi", "Trumako")] + [("Karin Wesmu", 40), ("Karen Wesmu", 2), ("Krin Wesmu", 2), ("Karen Ulbe", 9), ("Karen Nassi", 9), ("Karen Todova", 9)]
    entity = {r.name: r.entity for r in names.linked(uses(spark, counted)).collect()}
    assert entity["Karin Wesmu"] == entity["Krin Wesmu"] != entity["Karen Wesmu"]


def test_middle_names(spark):
    counted = [("Robert Holokar", 50), ("Robert James Holokar", 3), ("Bob Holokar", 5), ("Holokar, Robert James", 2), ("Robert J. Holokar", 2), ("Mary Jones", 9), ("Mary Lee Jones", 5), ("Mary Ann Jones", 2)]
    entity = {r.name: r.entity for r in names.linked(uses(spark, counted)).collect()}
    assert len({entity[n] for n, _ in counted[:5]}) == 1
    assert entity["Mary Jones"] == entity["Mary Lee Jones"] != entity["Mary Ann Jones"]


def test_chains_long_words_and_empty(spark):
    variants = [("Abcdefgh Lopez", 60), ("Abcdefgx Lopez", 3), ("Abcdefg Lopes", 2)]
    assert len({r.entity for r in names.linked(uses(spark, variants)).collect()}) == 1
    long = "ab" * 70
    twice = [(f"Ida {long}", 40), (f"Ida {long[:20]}x{long[20:]}", 1), (f"Ida {long[:-9]}{long[-8:]}", 1)]
    assert len({r.entity for r in names.linked(uses(spark, twice)).collect()}) == 1
    assert names.linked(uses(spark, [])).count() == names.same(names.linked(uses(spark, []))).count() == 0


def plainly(counted):
    """Entities by comparing all forms, with the same likelihoods; no keys and no joins."""
    n = {}
    for name, k in counted:
        if form := names.form_of(name):
            n[form] = n.get(form, 0) + k
    ahead = lambda v, c: v != c and (v[:2] in ("i|", "j|") or len(v.split("|")) < len(c.split("|")) or len(v.split("|")) == len(c.split("|")) and (n[c] > n[v] or n[c] == n[v] and c < v))
    ways = {(v, c): w for v in n for c in n if ahead(v, c) and (w := names.way_of(v, c))}
    root = lambda w: names.FORMAL.get(w, [w])[0]
    company, having, shared = {}, {}, {}
    for f in n:
        if f[:2] == "p|":
            for x, y in (f.split("|")[1:3], f.split("|")[2:0:-1]):
                company.setdefault(x, set()).add(root(y))
                having[x] = having.get(x, 0) + 1
    lone = lambda v, w: w.way == "typo" and len(w.old) == 1 and v[0] == "p"
    for (v, _), w in ways.items():
        if lone(v, w):
            shared.setdefault(frozenset(w.old + w.new), set()).add(root(w.stays))

    def support(v, w, word):
        return max(0, len(company.get(word[0], ())) - len(shared[frozenset(w.old + w.new)])) if lone(v, w) else 0

    best = {}
    for (v, c), w in ways.items():
        best[v] = max(best.get(v, (-math.inf,)), (math.log(n[c]) + w.likelihood, c, w))
    rare = [(v, c) for v, (_, c, w) in best.items() if w.way == "typo" and len(w.old) == 1 and not support(v, w, w.new)]
    total = len(n)
    rarity = (len(rare) + names.SUPPOSED) / (sum(-math.log(n[c] / (n[v] + n[c])) for v, c in rare) + names.SUPPOSED / names.RARE)
    counts = {way: len(rare) if way == "typo" else sum(w.way == way for *_, w in best.values()) for way in names.WAYS}
    rate = {way: math.log((counts[way] + names.SUPPOSED * (names.TYPED if way == "typo" else math.exp(p))) / (total + names.SUPPOSED)) for way, p in names.WAYS.items()}

    def typo(v, w, share, meant, word):
        letters = [len(x) * math.log(26) for x in word]
        unknown = -sum(letters if v[0] == "o" else [min(x, math.log(1e6)) for x in letters])
        s = support(v, w, word)
        odds = rate["typo"] * len(w.old) - sum(math.log(names.MISTYPED * len(x)) for x in w.old)
        odds += math.log(rarity) + (rarity - 1) * math.log(1 - share) + math.log(share) + math.log(1 + math.log(max(n.values())))
        return odds - math.log(having.get(w.stays, total) if lone(v, w) else total) - (math.log(s / total) if s else unknown)

    parent = {}
    for (v, c), w in ways.items():
        share = n[v] / (n[v] + n[c])
        if w.way != "typo" or max(typo(v, w, share, w.old, w.new), typo(v, w, 1 - share, w.new, w.old)) > 0:
            after = names.WAYS["typo"] * len(w.old) + (0 if w.way == "typo" else rate[w.way])
            parent[v] = max(parent.get(v, (-math.inf,)), (round(math.log(n[c]) + after, 9), c))

    def top(f):
        return top(parent[f][1]) if f in parent else f

    return {name: top(form) for name, _ in counted if (form := names.form_of(name))}


def test_against_comparing_all(spark):
    rnd = random.Random(12)
    given = ["robert", "karin", "karen", "theodore", "edward", "maria", "mario"]
    family = ["".join(rnd.choices("aeioklmnrst", k=rnd.randint(3, 8))) for _ in range(40)]
    people = [f"{rnd.choice(given)} {rnd.choice(family)}" for _ in range(70)]

    def spoilt(name):
        a, b = name.split()
        k = rnd.randrange(len(b))
        typo = rnd.choice([b[:k] + b[k + 1 :], b[:k] + rnd.choice("aeklmn") + b[k:], b[:k] + b[k : k + 2][::-1] + b[k + 2 :]])
        short = rnd.choice(names.SHORT.get(a, a).split())
        return rnd.choice([f"{a} {typo}", f"{short} {b}", f"{a[0]}. {b}", a + b, f"{a} lee {b}", f"{b}, {short}", f"{short} {typo}", f"{typo} media inc", f"{b} media inc"])

    counted = {name: rnd.randint(5, 60) for name in people}
    for _ in range(160):
        name = spoilt(rnd.choice(people))
        counted[name] = rnd.choice([1, 1, 2, 4, 30])
    counted = sorted(counted.items())
    got = {r.name: r.entity for r in names.linked(uses(spark, counted)).collect()}
    want = plainly(counted)
    alike = lambda d: {frozenset(x for x in d if d[x] == e) for e in set(d.values())}
    assert set(got) == set(want) and alike(got) == alike(want), alike(got) ^ alike(want)
    assert 60 < len(alike(got)) < len(got)


def test_typos_in_a_table_with_all_surnames(spark):
    rnd = random.Random(7)
    given = ["robert", "karin", "theodore", "maria", "edward", "samuel", "victoria", "gabriel", "leila", "lars"]
    family = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4000)]
    near = [f"{f[:7]}{'z' if f[7] != 'z' else 'y'}" for f in family[:5]]  # both surnames stand beside other given names, too
    form = lambda a, b: "p|" + "|".join(sorted((a, b)))
    counted = {form(a, b): 50 for a in given for b in family[5:]} | {form(a, b): 50 for a in given[:6] for b in family[:5]} | {form(a, b): 40 for a in given[:3] + given[6:] for b in near}
    typos = {form(a, f"{b[:4]}{b[5:]}"): form(a, b) for a, b in zip(given * 1000, rnd.choices(family[5:], k=10_000))}
    others = {form(a, y): form(a, x) for a in given[:3] for x, y in zip(family, near)}
    counted |= dict.fromkeys(typos, 12)
    counts = spark.createDataFrame(list(counted.items()), "form string, n bigint")
    pairs = spark.createDataFrame([(v, c, counted[v], counted[c]) for v, c in (typos | others).items()], "form string, parent string, n bigint, parent_n bigint")
    got = {r.form: r.parent for r in names._attached(counts, pairs.mapInArrow(names._scored, names._SCORED_DDL)).collect()}
    assert got.items() ^ typos.items() == set()
