"""Driver queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm.bpe import bpe_round_trip
from kinspark.llm.common import table
from kinspark.llm.embedding_dedup import near_duplicates
from kinspark.llm.exact_dedup import exact_dedup
from kinspark.llm.fill_in_middle import fill_in_middle, restored
from kinspark.llm.language_id import fold, identify_language, training_sample
from kinspark.llm.license_scan import scan_licenses
from kinspark.llm.mixing import cycled, mix_sources
from kinspark.llm.packing import pack_conversations, pack_documents
from kinspark.llm.secret_scan import scan_secrets
from kinspark.llm.set_join import jaccard_components
from kinspark.llm.timestamps import normalise_stamps
from kinspark.llm.token_rollup import TOKENIZERS, Rollup, counted, deleted, inserted, revised
from kinspark.llm.url_filter import judge_urls, rule
from kinspark.llm.workspace import Workspace

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: The listed rules.
URL_RULES = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in sequences of at most 4096 tokens, 64 examples and 4096 tokens that bear loss."""
    return pack_conversations(table(spark, sf_dir, "conversations"), vocabulary_path())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_language(docs, training_sample(docs.filter(fold() != 2)))
    return out.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    starts = F.col("places.start")
    n_base = F.size("places").cast("long")
    cover = F.array_max(F.col("spans.cover"))
    return found.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat(F.col("places.label"), F.col("spans.label"))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).when(F.size("spans") > 0, F.least(cover, F.lit(1.0))).otherwise(F.lit(0.0)).alias("score"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), limit=0.9)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each delivered twice: a provisional count of every document (a quarter of its
    characters), the revision to what the tokenizers count, and the removal of the documents labelled toxic."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    guess = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 4).cast("long")
    provisional = docs.select("source", "lang", guess.alias("tokens"), F.explode(F.array(*map(F.lit, TOKENIZERS))).alias("tokenizer"))
    actual = counted(docs.withColumn("old_tokens", guess), keep=("doc_id", "old_tokens"))
    gone = actual.join(toxic, "doc_id")  # an inner join: a semi join would be pushed below the counting and shuffle the texts
    rollup = Rollup(spark, Workspace(spark, "rollup").root)  # deleted at the driver's end
    for _ in range(2):
        rollup.commit("provisional", inserted(provisional))
        rollup.commit("revision", revised(actual))
        rollup.commit("removal", deleted(gone))
    return rollup.totals()


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), cycled(5, 2, 1))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op13_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_stamps(table(spark, sf_dir, "stamps"))


OP11_SQL = """
with t as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), u as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as g from t
), f as (
  select *, len(units) as n, least(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) as a, greatest(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or g[3] % 100 >= 90 then 'plain'
      when g[4] % 100 < 20 then 'spm' else 'psm' end as form from u
), p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a+1:b], '') as middle, array_to_string(units[b+1:], '') as suffix from f
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""

#: The level is found among the sources in the order in which it reaches their caps; the sample goes down the size classes in a recursion.
OP12_SQL = """
with recursive docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::bigint as size,
    ('0x' || substr(sha256('1' || coalesce(':' || doc_id::varchar, '')), 1, 8))::bigint % 1024 as bucket from documents
), d as (select *, case when size > 0 then length(bin(size)) else 0 end as class from docs),
s as (
  select source, sum(size)::bigint as size, [5, 2, 1][(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1] as w from d group by source
), r as (
  select *, 3 * size as cap, sum(3 * size) over o as caps, sum(w) over o as ws, sum(w) over () as all_w, sum(size) over () as total,
    lead(3 * size / w) over (order by 3 * size / w, source nulls last) as next_ratio from s window o as (order by 3 * size / w, source nulls last)
), levels as (
  select total as p, all_w as q, min(3 * size / w) as reach, 0 as k, false as last from r group by total, all_w
  union all select total - caps, all_w - ws, next_ratio, row_number() over (order by caps, ws), false from r where all_w > ws
), level as (select p, q from levels where reach is null or reach * q > p order by k limit 1),
a as (
  select source, size as source_size, least(cap::double, w::double * (select p from level)::double / (select q from level)::double) as target from r
), aims as (
  select *, case when source_size > 0 then target / source_size else 0.0 end as times from a
), whole as (select *, least(floor(times), 3)::int as whole, case when floor(times) < 3 then times - floor(times) else 0.0 end as part from aims),
cells as (select source, class, bucket, sum(size)::bigint as words from d where size > 0 group by all),
cums as (
  select c.source, c.class, bucket, sum(words) over (partition by c.source, c.class order by bucket)::bigint as cum from cells c
), ladder as (
  select c.source, c.class, row_number() over (partition by c.source order by c.class desc) as step, sum(words)::double as words,
    part, whole, source_size, target from cells c join whole w on c.source is not distinct from w.source group by c.source, c.class, part, whole, source_size, target
), taken as (
  select source, class, step, upto, want - got as carry from (
    select l.source, l.class, l.step, l.part * l.words as want, pick.upto, pick.got from ladder l,
      lateral (select u.upto, u.got from (select 0 as upto, 0 as got union all select bucket + 1, cum from cums q where q.source is not distinct from l.source and q.class = l.class) u
        order by abs(u.got - l.part * l.words), u.got limit 1) pick where l.step = 1)
  union all
  select source, class, step, upto, want - got from (
    select l.source, l.class, l.step, l.part * l.words + t.carry as want, pick.upto, pick.got from taken t join ladder l on l.source is not distinct from t.source and l.step = t.step + 1,
      lateral (select u.upto, u.got from (select 0 as upto, 0 as got union all select bucket + 1, cum from cums q where q.source is not distinct from l.source and q.class = l.class) u
        order by abs(u.got - (l.part * l.words + t.carry)), u.got limit 1) pick)
)
select d.doc_id, d.size, w.source_size, w.target, (d.size * (w.whole + coalesce((d.bucket < t.upto)::int, 0)))::bigint as taken
from d join whole w on d.source is not distinct from w.source left join taken t on d.source is not distinct from t.source and d.class = t.class
"""

#: Offsets of a zone a day before and after a wall time tell a change between; only the way from UTC to a zone is used.
OP13_SQL = """
with t as (select stamp_id, source, zone, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as s from stamps),
m as (
  select *, regexp_full_match(s, '[0-9]{10}|[0-9]{13}') as epoch,
    regexp_extract(s, '^(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})[.]([0-9]{2})[.](20[0-9]{2})|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))(?:[T ].*)?$',
      ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 'a5', 'b5', 'y5']) as g,
    regexp_extract(s, '^(?:20[0-9]{6}|[0-9. /-]{10}|[0-9]{2} [A-Z][a-z]{2} [0-9]{4})(?:([T ])([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?( ?[AP]M)?(?: ?(?:(Z)|([+-])([0-9]{2}):?([0-9]{2})))?)?$', ['sep', 'h', 'mi', 's', 'half', 'z', 'sign', 'oh', 'om']) as c,
    regexp_full_match(s, '(20[0-9]{2}-[0-9]{2}-[0-9]{2}|20[0-9]{6}|[0-9]{2}[.][0-9]{2}[.]20[0-9]{2}|[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}|[0-9]{2}/[0-9]{2}/20[0-9]{2})([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?( ?[AP]M)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?') as fits from t
), n as (
  select *, coalesce(try_cast(c.h as int), 0) as h0, coalesce(try_cast(c.mi as int), 0) as mi, coalesce(try_cast(c.s as int), 0) as sec, trim(c.half) as half,
    case when c.z = 'Z' then 0 when c.sign <> '' then (60 * try_cast(c.oh as int) + try_cast(c.om as int)) * (case c.sign when '-' then -1 else 1 end) end as off,
    case when g.y1 <> '' then g.y1 || '-' || g.m1 || '-' || g.d1 when g.y2 <> '' then g.y2 || '-' || g.m2 || '-' || g.d2 when g.y3 <> '' then g.y3 || '-' || g.m3 || '-' || g.d3
      when g.y4 <> '' then g.y4 || '-' || lpad(((instr('JanFebMarAprMayJunJulAugSepOctNovDec', g.b4) + 2) // 3)::varchar, 2, '0') || '-' || g.d4 end as plain,
    case when g.y5 <> '' then g.y5 || '-' || g.b5 || '-' || g.a5 end as dayfirst, case when g.y5 <> '' then g.y5 || '-' || g.a5 || '-' || g.b5 end as monthfirst from m where fits and not epoch
), ok as (
  select *, case when half = '' then h0 else h0 % 12 + (case half when 'PM' then 12 else 0 end) end as h,
    coalesce(try_cast(plain as date), null) as p, try_cast(dayfirst as date) as df, try_cast(monthfirst as date) as mf from n
  where (half <> '' and h0 between 1 and 12 or half = '' and h0 <= 23) and mi <= 59 and sec <= 59 and (c.sign = '' or try_cast(c.oh as int) <= 14 and try_cast(c.om as int) <= 59)
    and (off is not null or zone in (select name from pg_timezone_names()))
), votes as (
  select source, count(*) filter (where df is not null and mf is null) as dv, count(*) filter (where mf is not null and df is null) as mv from ok group by source
), picked as (
  select o.*, case when df is not null and mf is not null and df <> mf then (case when dv > mv or mv > dv then 'votes' else 'default' end) else 'plain' end as rule,
    case when p is not null then p when df is null then mf when mf is null then df when dv > mv then df else mf end as day
  from ok o join votes v on o.source is not distinct from v.source
), wall as (select *, (day + to_hours(h) + to_minutes(mi) + to_seconds(sec))::timestamp as w from picked where day is not null),
offs as (
  select *, case when off is null then epoch_us(timezone(zone, timezone('UTC', w - interval 1 day))) - epoch_us(w - interval 1 day) end as o1,
    case when off is null then epoch_us(timezone(zone, timezone('UTC', w + interval 1 day))) - epoch_us(w + interval 1 day) end as o2 from wall
), sides as (
  select *, off is null and epoch_us(timezone(zone, timezone('UTC', make_timestamp(epoch_us(w) - o1)))) = epoch_us(w) as v1,
    off is null and epoch_us(timezone(zone, timezone('UTC', make_timestamp(epoch_us(w) - o2)))) = epoch_us(w) as v2 from offs
), found as (
  select stamp_id, case when off is not null then epoch_us(w) - off::bigint * 60000000 when o1 = o2 or v1 = v2 or v1 then epoch_us(w) - o1 else epoch_us(w) - o2 end as utc_us,
    rule, rule <> 'plain' or off is null and o1 <> o2 and v1 = v2 as ambiguous from sides
  union all
  select stamp_id, s::bigint * (case length(s) when 10 then 1000000 else 1000 end), 'epoch', false from m where epoch
)
select * from found
union all select stamp_id, null, 'bad', false from stamps where stamp_id not in (select stamp_id from found)
"""

OP10_SQL = """
with kept as (select * from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)),
t as (
  select source, lang, 'words-1' as tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as n from kept
  union all
  select source, lang, 'bytes-1' as tokenizer, strlen(coalesce(text, '')) as n from kept
)
select source, lang, tokenizer, count(*)::bigint as docs, sum(n)::bigint as tokens from t group by all
"""

OP8_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
), g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from t join g using (norm)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_urls": op2_urls,
        "op3_packing": op3_packing,
        "op4_secrets": op4_secrets,
        "op5_set_join": op5_set_join,
        "op6_language": op6_language,
        "op7_licenses": op7_licenses,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_embeddings": op9_embeddings,
        "op10_token_counts": op10_token_counts,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_mixing": op12_mixing,
        "op13_timestamps": op13_timestamps,
        "instruction_packing": instruction_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op10_token_counts": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_mixing": OP12_SQL, "op13_timestamps": OP13_SQL}
