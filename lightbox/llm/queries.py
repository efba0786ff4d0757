"""The registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lightbox.llm import (
    conversation_repair, decontamination, exact_dedup, line_dedup, mixing, pii, quality, simhash, token_counts, toxicity, url_filter, warc,
    whitening,
)

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed values of the URL rules.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUNS = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_exact_dedup", rf"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g') as norm
  from documents
)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over w = 1 as kept, sha256(norm) as text_sha256
from n window w as (partition by norm order by n_chars desc, doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy group of every document, by a content sort."""
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_decontamination", f"""
with doc_words as (select doc_id, regexp_extract_all({LOWER}, '{WORDS}') as w from documents),
item_words as (select item_id, regexp_extract_all({LOWER}, '{WORDS}') as w from benchmark),
windows as (
  select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as phrase
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i
        from item_words where len(w) > 0)
),
sizes as (select distinct n from windows),
phrases as (select distinct n, phrase from windows),
places as (
  select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words cross join sizes where len(w) >= n)
),
found as (select doc_id, n, i, phrase from places join phrases using (n, phrase)),
hits as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, item_id::varchar as item from found join windows using (n, phrase)) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hits using (doc_id) left join items using (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, through an FM-index per shard."""
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).drop("spans")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str, model_file: str = TOKENIZER) -> DataFrame:
    """Number of unigram pieces of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.load_vocabulary(model_file))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from trusted and unlabelled ones."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line up to one word."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op8_warc", """
with p as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n,
    min(page_id) over (partition by coalesce(html, '')) as first_id
  from pages
)
select page_id, n as payload_bytes, sha256(body) as payload_digest,
  case when n >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and first_id <> page_id then first_id end as refers_to
from p
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, read back from their archives."""
    return warc.capture_history(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from confirmed and unlabelled ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op10_source_mixing", rf"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{RUNS}')), 0)::bigint as size,
    md5(concat(coalesce(doc_id::varchar, ''), '|', coalesce(text, ''))) as shuffle
  from documents
),
sources as (
  select source, sum(size)::bigint as z, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from docs group by source
),
levels as (
  select *, 3 * z as cap, (sum(z) over () - coalesce(sum(3 * z) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from sources window b as (order by 3 * z / w, source nulls last rows between unbounded preceding and 1 preceding)
),
fixed as (select min(cap / w) as at, arg_min(level, cap / w) as level from levels where cap >= level * w),
targets as (
  select source, z, case when l.cap / w >= f.at then f.level * w else cap::double end as target
  from levels l left join fixed f on true
),
goals as (
  select *, round(target)::bigint // greatest(z, 1) as full_passes, round(target)::bigint % greatest(z, 1) as rest from targets
),
streams as (
  select doc_id, size, source, coalesce(sum(size) over (
    partition by source order by shuffle, size rows between unbounded preceding and 1 preceding), 0) as start
  from docs
)
select doc_id, size, z as source_size, target,
  (full_passes * size + greatest(0, least(start + size, rest) - start))::bigint as taken
from streams s join goals g on s.source is not distinct from g.source
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


# CRC-32 of an ASCII string, bit by bit, and the three ways on from each state of a repair.
CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
STEP = "{{'cost': {q}.cost + {cost}, 'audit': '{edit}' || {q}.audit, 'lines': {line}}}"


def _ways(state: int) -> str:
    """SQL: the cheapest way on at turn ``i`` from a state, without insertions."""
    speak, to = ("assistant", 3) if state == 2 else ("user", 2)
    rest = lambda role, q: f"concat({role}, ':', text, case when {q}.lines = '' then '' else chr(10) end, {q}.lines)"
    ways = [STEP.format(q=f"q{state}", cost=4, edit="D", line=f"q{state}.lines")]
    reroled = STEP.format(q=f"q{to}", cost="3 + extra", edit="R", line=rest(f"'{speak}'", f"q{to}"))
    ways.append(f"case when not gone then {reroled} end")
    for initial, onward in {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state].items():
        kept = STEP.format(q=f"q{onward}", cost="extra", edit="K", line=rest("role", f"q{onward}"))
        ways.append(f"case when not gone and role[1:1] = '{initial}' then {kept} end")
    return f"list_min([{', '.join(ways)}])"


def _inserted(own: str, role: str, other: str) -> str:
    line = f"concat('{role}:', case when {other}.lines = '' then '' else chr(10) end, {other}.lines)"
    return f"list_min([{own}, {STEP.format(q=other, cost=3, edit='I', line=line)}])"


@query("op11_conversation_repair", f"""
with recursive hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC} % 20 as h
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations)
),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when h = 3 then [1, 2] else [1] end) as copy
  from hit where h <> 0
),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from damaged
),
marked as (
  select *, body = '' as blank, row_number() over (partition by conv_id, role, text order by i) > 1 and body <> '' as dup,
    body[-1:] not in ('.', '!', '?') as cut, lag(role) over (partition by conv_id order by i) as r0
  from placed
),
faults as (
  select *, blank or dup as gone, case when cut and not blank and not dup then 3 else 0 end as extra from marked
),
walk as (
  select conv_id, max(i) as i, {{'cost': 0, 'audit': '', 'lines': ''}} as q0, {{'cost': 6, 'audit': 'II', 'lines': 'user:' || chr(10) || 'assistant:'}} as q1,
    {{'cost': 3, 'audit': 'I', 'lines': 'assistant:'}} as q2, {{'cost': 0, 'audit': '', 'lines': ''}} as q3
  from faults group by conv_id
  union all
  select conv_id, i - 1, {_inserted("p0", "user", "p2")}, {_inserted("p1", "user", "p2")}, p2, p3
  from (
    select conv_id, i, p0, p1, {_inserted("p2", "assistant", "p3")} as p2, {_inserted("p3", "user", "p2")} as p3
    from (
      select w.conv_id, w.i, {", ".join(f"{_ways(q)} as p{q}" for q in range(4))}
      from walk w join faults f on w.i = f.i and w.conv_id is not distinct from f.conv_id
    )
  )
),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank,
    count_if(dup) as duplicate, count_if(extra > 0) as truncated,
    count_if(r0 is not null and r0[1:1] || role[1:1] not in ('su', 'ua', 'au')) as illegal
  from faults group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(q0.cost, 0)::bigint as cost,
  coalesce(q0.audit, '') as audit, sha256(coalesce(q0.lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id
  left join (select * from walk where i = 0) w on o.conv_id is not distinct from w.conv_id
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(turns), turns)


@query("op12_personal_data")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base patterns, and what a classifier trained on weak votes adds."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every vector, with exact deviations and the fit's own error."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.train(vectors))
