"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, bpe, collocations, fingerprints, line_dedup, near_embeddings, ngram_join, packing, perplexity, quality_gam, resampling, sharding, warc
from .common import shared_path, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.link_embeddings(table(spark, sf_dir, "embeddings"), 0.93)


def op3_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op4_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.scored(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


def op7_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.with_kept_text(table(spark, sf_dir, "documents"), short=True)
    return rows.select("doc_id", F.col("n_lines").cast("bigint"), F.col("n_gone").cast("bigint"), "n_near", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op8_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path, keep_payload=False)
    return found.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN))


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_projection_forest, op3_prefix_tree, op4_additive_quality, op5_attention_lm, op6_virtual_slots, op7_segment_lines, op8_warc_ranges, op9_best_fit_packing, op10_bottom_k, op11_kneser_ney, op12_phrase_automata, op13_importance_draw)}

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_REACH = """
both_ways as (select x, y from links union all select y, x from links),
reach as (select x as node, x as least from (select distinct x from both_ways) union select b.y, r.least from reach r join both_ways b on b.x = r.node where r.least < b.y),
best as (select node, min(least) as least from reach group by node)
"""

#: SQL states what these queries return; hashes, tokenizers, the learned models and sketches of the others have no SQL.
ORACLE_SQL: dict[str, str] = {
    "op2_projection_forest": f"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
good as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
{_REACH}, n as (select x, count(*) as n from both_ways group by x)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(best.least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(best.least, vec_id)) as kept
from embeddings left join n on n.x = vec_id left join best on best.node = vec_id
""",
    "op3_prefix_tree": rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sets as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) when len(ws) > 0 then [md5(array_to_string(ws, ' '))] else [] end as s from w),
sizes as (select doc_id, len(s) as n from sets),
sh as (select doc_id, unnest(s) as h from sets),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
{_REACH}
select doc_id, n as n_shingles, least(doc_id, coalesce(best.least, doc_id)) as component_id from sizes left join best on best.node = doc_id
""",
    "op8_warc_ranges": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first, unhex(h)::bit::varchar as bits from p)
select page_id, strlen(html) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::int + 8 * substr(bits, i * 5 + 2, 1)::int + 4 * substr(bits, i * 5 + 3, 1)::int + 2 * substr(bits, i * 5 + 4, 1)::int + substr(bits, i * 5 + 5, 1)::int, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from f
""",
    "op12_phrase_automata": rf"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_CAPITALS}), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, range(1, 5) t(k) where len(ws) >= k),
f as (select lang, phrase, count(*)::bigint as f from grams group by lang, phrase),
c as (select lang, phrase, f as a, string_split(phrase, ' ') as ws from f where f >= 30 and contains(phrase, ' ')),
cuts as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as x, array_to_string(ws[k + 1:], ' ') as y from (select *, unnest(range(1, len(ws))) as k from c)),
scored as (select cuts.*, l.f as l, r.f as r, ((2000000::hugeint * a) // (l.f + r.f))::bigint as score from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (select lang, a, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from c, range(2, 4) t(k) where len(ws) > k),
longer as (select lang, phrase, max(a) as a from parts group by lang, phrase)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from (select best.* from best left join longer using (lang, phrase) where longer.a is null or 100 * longer.a::hugeint < 80 * best.a::hugeint) join n using (lang)
qualify rank <= 2000
""",
    "op13_importance_draw": rf"""
with recursive bits as (select b, b as c, 0 as i from range(256) t(b) union all select b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from bits where i < 8),
crc as (select list(c order by b) as t from bits where i = 8),
texts as (select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id::bigint, text from benchmark),
w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
feats as (select kind, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as g from w),
counted as (select kind, id, g, count(*) as n from feats group by kind, id, g),
shaped as (select g, list_transform(range(0, strlen(g)), lambda i: ('0x' || hex(encode(g))[2 * i + 1:2 * i + 2])::bigint) as bytes from (select distinct g from counted)),
hashed as (select g, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from shaped, crc),
f as (select kind, id, bucket, sum(n) as n from counted join hashed using (g) group by kind, id, bucket),
s as (select bucket, sum(n) as s from f where kind = 'd' group by bucket), t as (select bucket, sum(n) as t from f where kind = 'b' group by bucket),
sums as (select coalesce((select sum(s) from s), 0) as su, coalesce((select sum(t) from t), 0) as tu),
gain as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (su + 10000))::double / ((s + 1) * (tu + 10000))::double))::bigint as gain from s left join t using (bucket), sums),
weighed as (select id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from f join gain using (bucket) where kind = 'd' group by id),
noisy as (select doc_id, ('0x' || sha256('7:' || doc_id)[:8])::bigint as h from documents),
scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score, len(ws) >= 20 as eligible
           from noisy join (select id, ws from w where kind = 'd') w on w.id = doc_id left join weighed on weighed.id = doc_id),
placed as (select *, row_number() over (partition by eligible order by score desc, doc_id) as place, count(*) over (partition by eligible) as n from scored)
select doc_id, n_features, weight, score, case when eligible and place <= 25 * n // 100 then place end as rank from placed
""",
}
