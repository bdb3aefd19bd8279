"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, hnsw, langid, licenses, lm_scores, mixing, projections, repair, simhash, substring, toxicity, unigram
from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(True))
    labels = table(spark, sf_dir, "labels").where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


#: Every window as text; fit for small tables.
OP7_SQL = """
with w as (
  select doc_id::bigint as doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
named as (
  select doc_id, r, p, array_to_string(ws[p : p + 49], ' ') as s from (select doc_id, r, ws, unnest(range(1, len(ws) - 48)) as p from w where len(ws) >= 50)),
firsts as (select s, min(doc_id) as first from named group by s),
gone as (select distinct r, p + k as at from named join firsts using (s), range(50) as t(k) where first < doc_id),
words as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as at from w),
kept as (
  select words.r, count(gone.at) as n_removed, coalesce(string_agg(case when gone.at is null then word end, ' ' order by words.at), '') as kept
  from words left join gone on gone.r = words.r and gone.at = words.at group by words.r)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join kept using (r)
"""


@query("op7_substring_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


#: Sizes, targets and the seeded choice, for documents of one source each.
MIX_SQL = """
with sized as (
  select doc_id::bigint as doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('11:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from sized group by source),
ranked as (
  select *, row_number() over (order by 3 * source_size / weight, source nulls last) as k from sources),
lefts as (
  select *, (sum(source_size) over ())::bigint - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0)::bigint as l,
    sum(weight) over (order by k rows between current row and unbounded following)::bigint as w
  from ranked),
capped as (select *, l * weight > 3 * source_size * w as over_it from lefts),
stop as (select coalesce(min(k), 0) as k from capped where not over_it),
targets as (
  select c.source, c.source_size, case when c.k < stop.k or stop.k = 0 then (3 * c.source_size)::double
    else (select l from capped x where x.k = stop.k)::double * c.weight / (select w from capped x where x.k = stop.k) end as target
  from capped c, stop),
quotas as (
  select *, least(floor(target + 0.5)::bigint, 3 * source_size) as quota from targets),
ordered as (
  select s.doc_id, s.size, q.source_size, q.target, q.quota,
    coalesce(sum(s.size) over (partition by s.source order by s.place, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as before_it
  from sized s join quotas q on s.source is not distinct from q.source)
select doc_id, size, source_size, target,
  (size * (case when source_size = 0 then 0 else quota // source_size + case when 2 * before_it + size <= 2 * (quota % source_size) then 1 else 0 end end))::bigint as taken
from ordered
"""


@query("op8_mix_sources", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sizes, wanted = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"), mixing.cycle())
    # One row a source; mixing.plan() has bounded their number.
    facts = spark.createDataFrame([([s], sizes[s], wanted[s]) for s in sizes], "members array<string>, source_size long, target double")
    return mixed.join(F.broadcast(facts), mixed.members.eqNullSafe(facts.members)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return unigram.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: All pairs within a label, and their closure.
OP9_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
roots as (select a, min(b) as root from reach group by a),
degrees as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, e.vec_id = root as kept from embeddings e left join roots on roots.a = e.vec_id left join degrees on degrees.a = e.vec_id
"""


@query("op9_embedding_near_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: crc32 of an ASCII string `s`, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: ord(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)))"""


def _cheapest(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _after(cost: str, edit: str, then: str) -> str:
    return f"{{'cost': {cost} + {then}.cost, 'audit': '{edit}' || {then}.audit}}"


#: The state after an inserted or new role, for the states start, s, u, a.
_NEXT = (2, 2, 3, 2)


def _repair_sql() -> str:
    """Suffixes are solved from the last row to the first, as one struct of cost and audit for each of four states."""
    never = "{'cost': 1000000000, 'audit': ''}"
    rows = []
    for s in range(4):
        kept = [f"when ini = '' then {_after('short', 'K', f'v{s}')}", f"when ini = '{'a' if s == 2 else 'u'}' then {_after('short', 'K', f'v{_NEXT[s]}')}"]
        kept += [f"when ini = 's' then {_after('short', 'K', 'v1')}"] if s == 0 else []
        ways = (_after("3", "D", f"v{s}"), f"case when gone then {never} else {_after('2 + short', 'R', f'v{_NEXT[s]}')} end", f"case when gone then {never} {' '.join(kept)} else {never} end")
        rows.append(f"{_cheapest(*ways)} as g{s}")
    ahead = [_cheapest(f"g{s}", _after("2", "I", f"g{_NEXT[s]}"), _after("4", "II", f"g{_NEXT[_NEXT[s]]}")) + f" as v{s}" for s in range(4)]
    return f"""
with recursive fates as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {CRC_SQL.format(s="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate
  from conversations),
damaged as (
  select coalesce(conv_id::varchar, '') as c, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from fates, range(2) as t(k) where fate <> 0 and (k = 0 or fate = 3)),
counted as (select *, row_number() over (partition by c, role, text order by turn nulls first) as again from damaged),
placed as (
  select *, row_number() over (partition by c order by turn nulls first, role, text, again) as pos,
    substr(role, 1, 1) as ini, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last
  from counted),
faults as (
  select *, case when last = '' then 'blank' when again > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault,
    lag(ini) over (partition by c order by pos) as before
  from placed),
facts as (
  select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where before is not null and before || ini not in ('su', 'ua', 'au')) as illegal, max(pos) as n
  from faults group by c),
solved as (
  select c, n + 1 as pos, {{'cost': 0, 'audit': ''}} as v0, {{'cost': 4, 'audit': 'II'}} as v1, {{'cost': 2, 'audit': 'I'}} as v2, {{'cost': 0, 'audit': ''}} as v3 from facts
  union all
  select c, pos, {', '.join(ahead)} from (
    select f.c, f.pos, {', '.join(rows)}
    from (select *, fault is not null and fault <> 'truncated' as gone, case when fault = 'truncated' then 1 else 0 end as short from faults) f
    join solved on solved.c = f.c and solved.pos = f.pos + 1) as one),
audits as (select c, v0.cost as cost, v0.audit as audit from solved where pos = 1),
letters as (select c, i, substr(audit, i, 1) as e from (select c, audit, unnest(range(1, length(audit) + 1)) as i from audits)),
dealt as (select *, sum((e <> 'I')::int) over (partition by c order by i) as pos from letters),
told as (
  select d.c, d.i, d.e, f.role, f.text, sum((d.e in ('I', 'R') or (d.e = 'K' and f.ini in ('u', 'a')))::int) over (partition by d.c order by d.i) % 2 = 1 as by_user
  from dealt d left join faults f on f.c = d.c and f.pos = d.pos and d.e <> 'I'),
lines as (
  select c, i, case e when 'K' then role || ':' || text else case when by_user then 'user:' else 'assistant:' end || coalesce(text, '') end as line from told where e <> 'D'),
digests as (select c, sha256(string_agg(line, chr(10) order by i)) as repaired_sha256 from lines group by c)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, '') as c from conversations) left join facts using (c) left join audits using (c) left join digests using (c)
"""


@query("op13_conversation_repair", _repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


DIVERGENCE_SQL = """
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts
  from documents),
t as (select r, lang, source, unnest(ts) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 30),
langs as (select lang, sum(n)::hugeint as total, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term),
groups as (
  select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join counts using (lang, source) group by lang, source),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.v) as p,
    1 + 1000000000::hugeint * (k.n + 5) // (l.total + 5 * l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(abs(x.p - y.p)) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
parts as (
  select lang, source, 'pair' as part, item, coalesce(value, 0) as value from pairs
  union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_lm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(True))
    found = lm_scores.score(table(spark, sf_dir, "documents"), ~held_out, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumn("held_out", held_out)
