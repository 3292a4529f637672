"""The numbered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, contamination, lines, lm, mixing, pieces, quality, runs, simhash, substrings, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(own)))


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = audit.masks(_table(spark, sf_dir, "documents"))
    return audit.interactions(audit.mask_counts(flags, _table(spark, sf_dir, "labels")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.periodic_runs(docs.withColumn("text", runs.planted(F.col("doc_id"), F.col("text")))))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_plan(_table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=1.5, most=2.0)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


_ALL = (
    op1_lm_scoring, op2_line_dedup, op3_sentencepiece, op4_simhash_near_dedup, op5_quality_classifier, op6_substring_dedup,
    op7_embedding_near_dedup, op8_decontamination, op9_toxicity, op10_chat_formatting,
    op11_filter_interaction, op12_periodic_runs, op13_source_mixing, pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {}

# Windows of three lines, the first of each kept; windows are judged on the input.
ORACLE_SQL["op2_line_dedup"] = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from documents),
w as (select * from (select doc_id, p, line || chr(10) || lead(line, 1) over d || chr(10) || lead(line, 2) over d as k from l window d as (partition by doc_id order by p)) where k is not null),
f as (select doc_id, p, row_number() over (partition by k order by doc_id, p) as n from w),
g as (select distinct doc_id, unnest([p, p + 1, p + 2]) as p from f where n > 1),
j as (select l.doc_id, l.p, l.line, g.p is not null as gone from l left join g on l.doc_id = g.doc_id and l.p = g.p)
select doc_id, count(*)::int as n_lines, sum(gone::int)::int as n_lines_removed,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""

# Lower-case words of letters and digits; shingles of five words (all words of a shorter item); containment 0.8.
ORACLE_SQL["op8_decontamination"] = r"""
with i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark where text is not null),
d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null),
k as (select item_id, w, least(len(w), 5) as k from i where len(w) > 0),
s as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x : x + k - 1], ' '))) as s from k),
n as (select item_id, count(*) as n from s group by item_id),
t as (select distinct doc_id, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda x: array_to_string(w[x : x + k - 1], ' '))) as s from d, (select distinct k from k))
select doc_id, item_id, n::int as n_shingles, count(*)::int as n_shared, count(*) / n as containment
from s join t using (k, s) join n using (item_id) group by doc_id, item_id, n having count(*) >= ceil(n * 0.8 - 1e-9)
"""

# Windows of thirteen words that also start in a document of smaller id; words that they cover go.
ORACLE_SQL["op6_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
a as (select doc_id, w, unnest(range(len(w) - 12)) as p from d where len(w) >= 13),
k as (select doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') as k from a),
m as (select doc_id, p, min(doc_id) over (partition by k) as least from k),
g as (select distinct doc_id, unnest(range(p, p + 13)) as p from m where least < doc_id),
u as (select doc_id, unnest(range(len(w))) as p, unnest(w) as word from d),
j as (select u.doc_id, u.p, word, g.p is not null as gone from u left join g on g.doc_id = u.doc_id and g.p = u.p),
t as (select doc_id, sum(gone::int)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by p) filter (where not gone), '')) as kept_sha256 from j group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256 from d left join t using (doc_id)
"""

# Cosine of all pairs of one label in double precision, and what is reachable over those at 0.98.
ORACLE_SQL["op7_embedding_near_dedup"] = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as s from embeddings),
n as (select vec_id, label, s, sqrt(list_sum(list_transform(s, lambda x: x * x))) as n from v where label is not null and s is not null and len(list_filter(s, lambda x: x is null or not isfinite(x))) = 0),
e as (select a.vec_id as x, b.vec_id as y from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.s) = len(b.s) where a.n > 0 and b.n > 0 and list_dot_product(a.s, b.s) / (a.n * b.n) >= 0.98),
r as (select vec_id as a, vec_id as b from v union select r.a, e.y from r join e on e.x = r.b), c as (select b as vec_id, min(a) as component_id from r group by 1)
select v.vec_id, (select count(*) from e where e.x = v.vec_id) as n_links, component_id, v.vec_id = component_id as kept from v join c using (vec_id)
"""

# The template: [INST] user [/INST], assistant</s>, <<SYS>>system<</SYS>>, [ROLE=name]text[/ROLE]; a backslash before control strings.
ORACLE_SQL["op10_chat_formatting"] = r"""
with c as (select conv_id, turn, role, text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i from c),
e as (select *, regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE=|\[/ROLE\]|\\)', '\\\1', 'g') as t from r),
f as (select *, case role when 'user' then '[INST] ' || t || ' [/INST]' when 'assistant' then t || '</s>' when 'system' then '<<SYS>>' || t || '<</SYS>>' else '[ROLE=' || regexp_replace(role, '([\\\]\[<])', '\\\1', 'g') || ']' || t || '[/ROLE]' end as f from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256, sum(length(f))::bigint as formatted_chars
from f group by conv_id
"""

# Five filters, all 120 orders: flags of every row, then sums over what fails earlier and now.
ORACLE_SQL["op11_filter_interaction"] = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as least from d),
m as (select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(least < doc_id, false)::int as mask from w),
l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels where doc_id is not null group by 1),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by 1, 2),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as b),
o as (select [a.x, b.x, c.x, d.x, e.x] as xs, [a.b, b.b, c.b, d.b, e.b] as bs from f a, f b, f c, f d, f e where a.b + b.b + c.b + d.b + e.b = 31 and a.b | b.b | c.b | d.b | e.b = 31),
s as (select array_to_string(xs, '') as filter_order, unnest([1, 2, 3, 4, 5]) as step, bs, coalesce(list_sum(bs[1 : step - 1]), 0)::int as before, bs[step] as own from o)
select part, filter_order, step, coalesce(sum(n) filter (where mask & (before | own) = 0), 0)::bigint as kept, coalesce(sum(n) filter (where mask & own <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (where mask & own <> 0 and mask & before <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (where mask = own), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where mask & own <> 0 and mask & before = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where mask & own <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * (120 // nullif(bit_count(mask), 0))) filter (where mask & own <> 0), 0)::bigint as shapley
from c, s group by part, filter_order, step
"""

# The water level in closed form (sources in the order of limit / weight), the seeded order by MD5, then the best fit for the gap.
ORACLE_SQL["op13_source_mixing"] = r"""
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size, md5('mix-1:' || coalesce(doc_id::varchar, '')) as key from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
w as (select source, source_size, ([3.0, 1.0, 2.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, sum(source_size) over ()::double as total from s),
r as (select *, 2.0 * source_size / weight as r from w),
c as (select *, (total * 1.5 - coalesce(sum(2.0 * source_size) over (order by r range between unbounded preceding and current row exclude group), 0)) / sum(weight) over (order by r range between current row and unbounded following) as level from r),
v as (select arg_min(level, r) as level from c where r >= level),
t as (select source, source_size, least(2.0 * source_size, weight * level) as target from w, v),
f as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t),
g as (select *, target - whole * source_size as rest from f),
p as (select d.*, g.source_size, g.target, g.whole, g.rest, sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row) as upto from d join g on d.source is not distinct from g.source),
o as (select *, (rest > 0 and upto <= rest)::int as once, rest - coalesce(max(case when upto <= rest then upto end) over (partition by source), 0) as gap from p),
b as (select source, min(row(abs(size - gap), key, doc_id, size)) as b from o where once = 0 and abs(size - gap) < gap group by 1)
select o.doc_id, o.size, o.source_size, o.target, (o.size * (whole + once + (b.b is not null)::int))::bigint as taken
from o left join b on o.source is not distinct from b.source and o.key = b.b[2] and o.size = b.b[4]
"""
