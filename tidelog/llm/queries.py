"""Queries of the problems on training text, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import encode, leakage, names, pii, toxicity, turns
from tidelog.sources import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each speaker's turn in a recording begins and ends."""
    return turns.bounds(table(spark, sf_dir, "lifelog_contents"), table(spark, sf_dir, "wearers"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every recording with one clean speaker and the clean text."""
    return turns.turns(table(spark, sf_dir, "lifelog_contents"), table(spark, sf_dir, "wearers"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of personal information in the latest deliveries of recordings and nodes; numbers of accounts and cards are no kind of these."""
    finder = pii.finder(table(spark, sf_dir, "wearers"))
    logs = pii.found(table(spark, sf_dir, "lifelogs"), "id", ["title", "markdown"], finder)
    nodes = pii.found(table(spark, sf_dir, "lifelog_contents"), "node_id", ["content"], finder)
    return logs.unionByName(nodes).where("pii_kind <> 'account_number'").select("field", "record_key", "pii_kind", "start_pos")


def p3_cleaned_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries of recordings with placeholders in title and markdown."""
    return pii.cleaned(table(spark, sf_dir, "lifelogs"), ["title", "markdown"], pii.finder(table(spark, sf_dir, "wearers")))


def p3_cleaned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries of nodes with placeholders in their content."""
    return pii.cleaned(table(spark, sf_dir, "lifelog_contents"), ["content"], pii.finder(table(spark, sf_dir, "wearers")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of spellings of one person or organisation."""
    return names.same(names.linked(table(spark, sf_dir, "lifelog_contents")))


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its uses and its entity's canonical form."""
    return names.linked(table(spark, sf_dir, "lifelog_contents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the 50k byte-level BPE."""
    return encode.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a stretch of a test item's passage, with the item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each leaked stretch stands in its document."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with leaked stretches, without them."""
    return leakage.cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score for abusive, hateful or sexual content."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, table(spark, sf_dir, "doc_reviews")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with such content."""
    return toxicity.found(p8_scores(spark, sf_dir))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of such documents in each source."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.rates(docs, toxicity.fitted(docs, table(spark, sf_dir, "doc_reviews")))


QUERIES = {f.__name__: f for f in (p2_found, p2_turns, p3_found, p3_cleaned_recordings, p3_cleaned_nodes, p4_found, p4_entities, p6_ids, p7_found, p7_spans, p7_cleaned, p8_found, p8_scores, p8_rates)}

#: Brackets one level deep, as in the tables, can be matched without a grammar.
SQL: dict[str, str] = {
    "p2_found": r"""
with nodes as (select * from (select *, row_number() over (partition by node_id, lifelog_id order by received_at desc nulls last) as rn from lifelog_contents) where rn = 1),
starts as (select lifelog_id, coalesce(mode(epoch_ms(start_time) - start_offset_ms), min(epoch_ms(start_time))) as true_start from lifelog_contents group by lifelog_id),
quotes as (select n.*, coalesce(start_offset_ms, epoch_ms(start_time) - true_start, 0) as at_ms, regexp_replace(replace(coalesce(content, ''), chr(160), ' '), '^\s*(\[\d{1,2}:\d{2}(:\d{2})?([.,]\d{1,3})?\]|\(\d{1,2}:\d{2}(:\d{2})?([.,]\d{1,3})?\)|<\d{1,2}:\d{2}(:\d{2})?([.,]\d{1,3})?>|\d{1,2}:\d{2}(:\d{2})?([.,]\d{1,3})?\s*-->|\d{1,2}:\d{2}:\d{2}([.,]\d{1,3})?(\s|$))\s*', '') as said,
    lower(regexp_replace(trim(regexp_replace(speaker_name, '[\s:>-]+$', '')), '\s+', ' ', 'g')) as label, lower(trim(regexp_replace(display_name, '\s+', ' ', 'g'))) as wearer
  from nodes n left join starts using (lifelog_id) left join (select wearer_id, max(display_name) as display_name from wearers group by wearer_id) using (wearer_id) where lower(trim(node_type)) = 'blockquote'),
spoken as (select *, case when lower(trim(speaker_identifier)) = 'user' or label in ('you', 'me', 'i', 'myself', 'self', 'user', 'wearer', 'owner') or label = wearer then 'wearer'
    when regexp_full_match(label, '(speaker|spk|s)[\s_#.-]*0*(\d+)') then 'speaker ' || cast(cast(regexp_extract(label, '(\d+)$', 1) as int) as varchar)
    when label is not null and label not in ('', 'unknown', 'noise', 'speaker ?', '?') then label
    when regexp_matches(lower(said), '^\s*(\[\s*(speaker|spk|s)[\s_#.-]*0*(\d+)\s*\]|(speaker|spk|s)[\s_#.-]*0*(\d+)\s*(:|>|\s-\s))\s*') then 'speaker ' || cast(cast(regexp_extract(lower(said), '^[^0-9]*(\d+)', 1) as int) as varchar) end as who
  from quotes where regexp_matches(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(said), '\((REMARKS)\b', 'remark ', 'g'), '^\s*(\[\s*(speaker|spk|s)[\s_#.-]*0*(\d+)\s*\]|(speaker|spk|s)[\s_#.-]*0*(\d+)\s*(:|>|\s-\s))\s*', ''), '(\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\(\s*[\p{L}_]+([ -][\p{L}_]+)*\s*\)|\*[^*\n]+\*|♪)', ' ', 'g'), '\b(u+h*m+|u+h+|e+r+m*|h+m+|m+h*m+)\b', ' ', 'g'), '[\p{L}\p{N}]')),
carried as (select *, last_value(who ignore nulls) over (partition by lifelog_id order by at_ms, node_id rows unbounded preceding) as speaker from spoken),
marked as (select *, case when row_number() over w = 1 or speaker is distinct from lag(speaker) over w then 1 else 0 end as opens from carried window w as (partition by lifelog_id order by at_ms, node_id)),
numbered as (select *, sum(opens) over (partition by lifelog_id order by at_ms, node_id rows unbounded preceding) as turn_no from marked)
select lifelog_id, cast(turn_no as bigint) as turn_no, arg_min(node_id, struct_pack(a := at_ms, b := node_id)) as first_node_id, arg_max(node_id, struct_pack(a := at_ms, b := node_id)) as last_node_id from numbered group by lifelog_id, turn_no
""".replace("REMARKS", turns.REMARKS)
}
