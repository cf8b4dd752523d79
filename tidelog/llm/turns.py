"""Speech transcripts into ordered turns, each of one clean speaker and clean text.

A parsing-expression grammar reads each utterance into a tree: ordered choice, no way back into a rule
that has matched, nested annotations from a table of the rule's results at all places::

    utterance  <- (blank / time / label / sound)* speech
    time       <- '[' clock ']' / '(' clock ')' / '<' clock '>' / clock '-->' / clock with seconds
    label      <- bracket numbered closing / numbered (':' / '>' / ' - ') / own ':' / name ':'
    speech     <- (time / sound / hesitation / filler / restart / words)*
    sound      <- annotation, in round brackets only if it isn't part of a sentence
    annotation <- bracket (annotation / other)* closing / '*' other '*' / '♪'+

The tree gives the speaker named in the text and whether anything is said, and the clean text is what
its words leave. Utterances are parsed where they lie, in Arrow batches; what follows are Spark windows
in two levels, so a recording of any length is never in one task: inside (recording, stretch of time)
labels are carried forward and changes of speaker counted, then one row per stretch passes the last
speaker and the number of turns on to the next.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import node_kind
from tidelog.operators.intervals import epoch_ms
from tidelog.sources import latest_delivery

STRETCH_MS = 900_000
WEARER = "wearer"
#: Ways to write the wearer and labels that name nobody.
OWN = {"you", "me", "i", "myself", "self", "user", "wearer", "owner"}
NOBODY = {"", "unknown", "noise", "speaker ?", "?", "unknown speaker", "n/a", "none"}

#: Words before a colon that are no name.
OPENERS = set("note notes question answer reminder update action todo subject re fyi ps quote example warning total result status summary agenda topic today tomorrow yesterday first second third finally also so and but or okay ok right well yes no".split())
#: Words with which a remark in round brackets is part of the sentence and no sound.
REMARKS = "the|a|an|this|that|these|those|which|who|whom|whose|and|or|but|if|because|about|around|roughly|i|we|you|he|she|it|they|my|our|your|his|her|their|not|no|yes|is|was|are|were|at|dot"

# Terminals; blanks are single here.
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_STAMP = rf"(?:\[{_CLOCK}\]|\({_CLOCK}\)|<{_CLOCK}>|{_CLOCK}\s?-->|(?<![\w:.,-])\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?=\s|$))"
_TIME = re.compile(_STAMP)
_NUMBERED = r"(?:speaker|spk|s)[\s_#.-]*0*(\d+)"
_LABEL = re.compile(rf"(?:[\[(<]\s?{_NUMBERED}\s?[\])>]\s?:?|{_NUMBERED}\s?(?::|>|\s-(?=\s))|(you|me)\s?:)", re.I)
_NAME = r"[^\W\d_]+(?:['’.-][^\W\d_]+)*\.?"
_NAMED = re.compile(rf"({_NAME}(?: {_NAME}){{0,3}})\s?:(?=\s|$)")
_LABEL_NAME = re.compile(rf"^{_NUMBERED}$")
_OPEN = re.compile(r"[\[({<*♪]")
_BRACKET = re.compile(r"[\[\](){}<>]")
_CLOSE = {"[": "]", "(": ")", "{": "}", "<": ">"}
_SOUND = re.compile(rf"(?!(?:{REMARKS})\b)[^\W\d]+(?:[ -][^\W\d]+)*", re.I)
_STARRED = re.compile(r"\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*")
_NOTES = re.compile(r"♪(?:\s?♪)*")
# Possessive, so that no run of letters or signs is split in more than one way.
_HESITATION = r"(?:u++h*+m++|u++h++|e++r++m*+|h++m++|m++h++m++|mm++)"
_FILLER = r"(?:well|like|you know|i mean)"
_NEXT = re.compile(
    rf"(?=[\[(<\d])(?P<time>{_STAMP})|\b(?:(?=[uehmUEHM])(?P<hesitation>{_HESITATION})\b(?:\s?(?:\.{{3}}|…|—|,))?|(?P<filler>well|like|you know|i mean|so|okay)\b(?=\s?(?:\.\.\.|[…,—]))|(?P<restart>(\w++)-\s(?=\5\b)))", re.I
)
_SET_OFF = re.compile(r"\s?(\.{3}|…|,|—)")
_OPENING = re.compile(rf"\s?{_FILLER}\s?,", re.I)
_SAID = re.compile(r"[^\W_]")
_SPACE = re.compile(r"\s+")


class Node(NamedTuple):
    """A part of an utterance: its rule, where it stands, the parts inside, and what a label names."""

    rule: str
    begin: int
    end: int
    inside: tuple = ()
    names: str | None = None


def _annotations(s: str) -> dict[int, Node]:
    """The annotation rule's results by the place where they begin, in one pass: a bracket that is never closed is another character."""
    found = {m.start(): Node("annotation", m.start(), m.end()) for p in (_NOTES, _STARRED) for m in p.finditer(s)}
    opened: list[tuple[int, list[Node]]] = []
    count = dict.fromkeys(_CLOSE.values(), 0)
    for m in _BRACKET.finditer(s):
        c = m.group()
        if c in _CLOSE:
            opened.append((m.start(), []))
            count[_CLOSE[c]] += 1
        elif count[c]:
            loose: list[Node] = []
            while True:
                begin, inside = opened.pop()
                count[_CLOSE[s[begin]]] -= 1
                inside += loose
                if _CLOSE[s[begin]] == c:
                    found[begin] = Node("annotation", begin, m.end(), tuple(inside))
                    if opened:
                        opened[-1][1].append(found[begin])
                    break
                loose = inside
    return found


def _is_sound(s: str, node: Node) -> bool:
    """Whether an annotation is a sound and not words said in brackets: round brackets hold both."""
    if s[node.begin] != "(" or node.inside:
        return True
    return not (node.begin and s[node.begin - 1].isalnum()) and _SOUND.fullmatch(s[node.begin + 1 : node.end - 1].strip()) is not None


def _label(s: str, at: int) -> Node | None:
    if m := _LABEL.match(s, at):
        number = m.group(1) or m.group(2)
        return Node("label", at, m.end(), names=f"speaker {int(number)}" if number else m.group(3))
    if ":" in s and (m := _NAMED.match(s, at)) and (words := m.group(1).split()) and words[0].lower().rstrip(".") not in OPENERS and all(w[0].isupper() for w in words):
        return Node("named", at, m.end(), names=m.group(1))
    return None


def parse(content: str) -> tuple[str, Node]:
    """The utterance with single blanks, and its tree: an utterance node with all parts in order."""
    s = _SPACE.sub(" ", content) if "  " in content or not content.isprintable() else content
    table = _annotations(s) if _OPEN.search(s) else {}
    parts: list[Node] = []
    at, n, labelled = 0, len(s), False
    while at < n:  # what stands before the speech
        if s[at] == " ":
            at += 1
            continue
        if m := _TIME.match(s, at):
            node = Node("time", at, m.end())
        elif not labelled and (node := _label(s, at)):
            labelled = True
        elif (node := table.get(at)) and _is_sound(s, node):
            node = node._replace(rule="sound")
        else:
            break
        parts.append(node)
        at = node.end
    sounds = [k for k in sorted(table, reverse=True) if k >= at]
    said = False
    node = _following(s, at)
    while at < n:
        if not said and (opening := _OPENING.match(s, at)):
            parts.append(Node("filler", at, opening.end()))
            at = opening.end()
            said = True
            continue
        while sounds and (sounds[-1] < at or not _is_sound(s, table[sounds[-1]])):
            sounds.pop()
        if node and node.begin < at:
            node = _following(s, at)
        k = min(node.begin if node else n, sounds[-1] if sounds else n)
        if k > at:
            parts.append(Node("words", at, k))
            said = said or _SAID.search(s, at, k) is not None
            at = k
        if k < n:
            part = node if node and k == node.begin else table[k]._replace(rule="sound")
            said = said or part.rule == "restart"
            parts.append(part)
            at = part.end
    return s, Node("utterance", 0, n, tuple(parts))


def _filler(s: str, at: int, m: re.Match) -> tuple[int, int] | None:
    """A filler word that stands between two commas or dashes, or before dots; from ``at`` on."""
    sign, begin = _SET_OFF.match(s, m.end()), m.start()
    mark = sign.group(1)
    before = begin - (begin > at and s[begin - 1] == " ")
    if mark in (",", "—"):
        if before > at and s[before - 1] == mark and (mark == "—" or m.group().lower() not in ("so", "okay")):
            return before - 1, sign.end()
    elif m.group().lower() not in ("so", "okay") and (begin == 0 or s[begin - 1] in ", "):
        return before, sign.end()
    return None


def _following(s: str, at: int) -> Node | None:
    """The next part of the speech from ``at`` on that is neither words nor a sound."""
    look = at
    while m := _NEXT.search(s, look):
        rule, begin, end = m.lastgroup, m.start(), m.end()
        if rule == "filler":
            if not (found := _filler(s, at, m)):
                look = end
                continue
            begin, end = found
        elif rule == "hesitation":  # with a blank, a comma or dashes before it
            begin -= begin > at and s[begin - 1] == " "
            signs = begin
            while signs > at and s[signs - 1] in ",—-":
                signs -= 1
            if signs < begin:
                begin = signs - (signs > at and s[signs - 1] == " ")
        return Node(rule, begin, end)
    return None


def label_of(tree: Node) -> Node | None:
    """The label that stands in the utterance."""
    return next((x for x in tree.inside if x.rule in ("label", "named")), None)


def is_said(s: str, tree: Node) -> bool:
    """Whether the utterance holds speech, and not only hesitations, sounds, times and a label."""
    return any(x.rule in ("words", "filler", "restart") and _SAID.search(s, x.begin, x.end) for x in tree.inside)


def text_of(s: str, tree: Node, kept: Node | None = None) -> str:
    """The clean text: the words without time stamps, sounds, hesitations, filler words and restarts; '' if nothing is said.

    ``kept`` is a label that names nobody here and so is part of the speech. Filler words alone stay.
    """
    if not is_said(s, tree):
        return ""
    keep = lambda x: x.rule == "words" or x is kept
    said = "".join(s[x.begin : x.end] if keep(x) else "" if x.rule == "restart" else " " for x in tree.inside)
    if not _SAID.search(said):
        said = "".join(s[x.begin : x.end] for x in tree.inside if x.rule == "filler")
    said = _BEFORE_SIGN.sub(r"\1", _SPACE.sub(" ", said)).strip(" ,—-")
    return said[:1].upper() + said[1:]


_BEFORE_SIGN = re.compile(r"\s+([,.!?;:])")


def speaker_key(name: str | None) -> str | None:
    """One form for all ways to write a label; None if it names nobody."""
    if name is None:
        return None
    key = _SPACE.sub(" ", unicodedata.normalize("NFKC", name)).strip(" :>-\t").casefold()
    if key in NOBODY:
        return None
    if key in OWN:
        return WEARER
    m = _LABEL_NAME.match(key)
    return f"speaker {int(m.group(1))}" if m else key


def _parser(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}

        def key_of(name: str) -> str | None:
            if name not in known:
                if len(known) > 100_000:
                    known.clear()
                known[name] = speaker_key(name)
            return known[name]

        for batch in batches:
            said, keys, names, texts = [], [], [], []
            for quote, content, name, identifier, wearer in zip(*(batch.column(c).to_pylist() for c in ("quote", "content", "speaker_name", "speaker_identifier", "display_name"))):
                key = text = None
                heard = False
                if quote and content:
                    s, tree = parse(content)
                    label = label_of(tree)
                    if name is not None:
                        key = key_of(name)
                    if identifier is not None and identifier.strip().lower() == "user" or key is not None and wearer is not None and key == key_of(wearer):
                        key = WEARER
                    named = None
                    if label is not None:
                        named = key_of(label.names)
                        if named is not None and wearer is not None and named == key_of(wearer):
                            named = WEARER
                    kept = label if label is not None and label.rule == "named" and key is not None and named != key else None
                    heard = kept is not None or is_said(s, tree)
                    key = (named if key is None else key) if heard else None
                    if with_text and heard:
                        text = text_of(s, tree, kept) or s[label.begin : label.end]
                said.append(heard)
                keys.append(None if key is None else xxhash.xxh3_64_intdigest(key) - 2**63)
                if with_text:
                    names.append(key)
                    texts.append(text)
            columns = [batch.column(c) for c in ("node_id", "lifelog_id", "received_at", "offset_ms", "start_ms")] + [pa.array(said), pa.array(keys, pa.int64())]
            fields = ["node_id", "lifelog_id", "received_at", "offset_ms", "start_ms", "said", "key"]
            if with_text:
                columns += [pa.array(names, pa.string()), pa.array(texts, pa.string())]
                fields += ["speaker", "text"]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return run


def utterances(nodes: DataFrame, wearers: DataFrame, with_text: bool = False) -> DataFrame:
    """(lifelog_id, node_id, at, key[, speaker, text]): the utterances with speech, in latest delivery.

    ``at`` is the start offset; where that is missing, the start time less the recording's true
    start, which most of its nodes agree on, or its first start time if none has both. ``key`` stands
    for the speaker, null without any label.
    """
    rows = nodes.select(
        "node_id", "lifelog_id", "received_at", "content", "speaker_name", "speaker_identifier", "wearer_id",
        F.coalesce(node_kind(F.col("node_type")) == "blockquote", F.lit(False)).alias("quote"), F.col("start_offset_ms").alias("offset_ms"), epoch_ms(F.col("start_time")).alias("start_ms"),
    )
    names = wearers.where("wearer_id is not null").groupBy("wearer_id").agg(F.max("display_name").alias("display_name"))
    joined = rows.join(names, "wearer_id", "left").drop("wearer_id").withColumn("received_at", F.unix_micros(F.col("received_at").cast("timestamp")))
    columns = ["offset_ms", "start_ms", "said", "key"] + (["speaker", "text"] if with_text else [])
    ddl = "node_id bigint, lifelog_id string, received_at bigint, offset_ms bigint, start_ms bigint, said boolean, key bigint" + (", speaker string, text string" if with_text else "")
    parsed = joined.mapInArrow(_parser(with_text), ddl).withColumn("received_at", F.timestamp_micros("received_at"))
    spoken = latest_delivery(parsed, ["node_id", "lifelog_id"], columns).where("said and lifelog_id is not null")
    # Offsets are rarely missing: only recordings that lack one give their true start, counted in two levels.
    differences = rows.withColumn("difference", F.col("start_ms") - F.col("offset_ms")).groupBy("lifelog_id", "difference").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset_ms").isNull()).alias("lacking"), F.min("start_ms").alias("first"))
    most = F.max_by("difference", F.when(F.col("difference").isNotNull(), F.struct("n", -F.col("difference"))))
    start = differences.groupBy("lifelog_id").agg(F.coalesce(most, F.min("first")).alias("true_start"), F.sum("lacking").alias("lacking"))
    joined = spoken.join(start.where("lacking > 0").drop("lacking"), "lifelog_id", "left")
    return joined.withColumn("at", F.coalesce("offset_ms", F.col("start_ms") - F.col("true_start"), F.lit(0))).drop("offset_ms", "start_ms", "said", "true_start")


def numbered(spoken: DataFrame, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """``spoken`` with ``place``, a key of its order in the recording, and ``turn_no``, counted from 1."""
    rows = spoken.withColumn("part", F.floor(F.col("at") / F.lit(stretch_ms)).cast("int"))
    inside = Window.partitionBy("lifelog_id", "part").orderBy("at", "node_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("own", F.last("key", ignorenulls=True).over(so_far)).withColumn("no", F.row_number().over(inside))
    filled = filled.withColumn("change", F.coalesce(F.col("own") != F.lag("own").over(inside), F.lit(False)).cast("long"))
    parts = filled.groupBy("lifelog_id", "part").agg(F.min_by("own", F.when(F.col("own").isNotNull(), F.col("no"))).alias("first_own"), F.max_by("own", "no").alias("last_own"), F.sum("change").alias("changes"), F.min_by(F.col("own").isNull(), "no").alias("opens_unknown"))
    earlier = Window.partitionBy("lifelog_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        parts.withColumn("carried", F.last("last_own", ignorenulls=True).over(earlier))
        .withColumn("opening", (F.col("opens_unknown") & (F.count(F.lit(1)).over(earlier) == 0)).cast("long"))
        .withColumn("entering", (F.col("first_own").isNotNull() & (F.col("carried").isNull() | (F.col("carried") != F.col("first_own")))).cast("long"))
        .withColumn("before", F.coalesce(F.sum(F.col("opening") + F.col("entering") + F.col("changes")).over(earlier), F.lit(0)))
        .select("lifelog_id", "part", "opening", "entering", "before")
    )
    counted = filled.withColumn("changed", F.sum("change").over(so_far))
    turn = F.col("before") + F.col("opening") + F.when(F.col("own").isNotNull(), F.col("entering")).otherwise(0) + F.col("changed")
    place = F.shiftleft(F.col("part").cast("long"), 32) + F.col("no")
    return counted.join(parts, ["lifelog_id", "part"]).withColumn("turn_no", turn).withColumn("place", place).drop("part", "own", "no", "change", "changed", "opening", "entering", "before")


def bounds(nodes: DataFrame, wearers: DataFrame) -> DataFrame:
    """(lifelog_id, turn_no, first_node_id, last_node_id): the turns of every recording.

    Utterances that hold only hesitations, sounds or nothing are left out and end no turn. One with no
    label belongs to the speaker before it; at the start it is a speaker of its own. Ties in the start
    offset go by node id; rows with a null recording id are left out; repeated rows count once;
    recordings without speech have no turn; an empty table has none.
    """
    return numbered(utterances(nodes, wearers)).groupBy("lifelog_id", "turn_no").agg(F.min_by("node_id", "place").alias("first_node_id"), F.max_by("node_id", "place").alias("last_node_id"))


def turns(nodes: DataFrame, wearers: DataFrame) -> DataFrame:
    """(lifelog_id, turn_no, speaker, n_utterances, start_offset_ms, text): :func:`bounds` with one clean speaker and the clean text.

    ``speaker`` is 'wearer', 'speaker N' or a name in lower case, null without any label.
    """
    said = numbered(utterances(nodes, wearers, with_text=True))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return said.groupBy("lifelog_id", "turn_no").agg(F.max("speaker").alias("speaker"), F.count(F.lit(1)).alias("n_utterances"), F.min("at").alias("start_offset_ms"), F.array_join(lines, " ").alias("text"))
