"""One query per operator over its whole table, and the SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import bpe, chat, cotrain, decontam, hmm, licenses, linehash, pivots, resample, simhash, spelling, suffix, urls
from starfold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op9_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_line_dedup(spark, sf_dir):
    kept = linehash.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
with lines as (
    select doc_id, pos, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key
    from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos
          from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), held as (
    select line_key, min(doc_id) as first_doc from lines where length(line_key) >= 10
    group by line_key having count(distinct doc_id) > 1
), marked as (
    select l.doc_id, l.pos, l.line, coalesce(h.first_doc <> l.doc_id, false) as dropped
    from lines l left join held h on l.line_key = h.line_key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""


@query
def op7_benchmark_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_byte_bpe(spark, sf_dir):
    ranks = bpe.read_ranks(RANKS)
    return bpe.document_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op3_quality_classifier(spark, sf_dir):
    scored = cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "content_p", "metadata_p", "reject_p", "kept")


@query
def op5_url_filter(spark, sf_dir):
    """The list holds the URLs that were fetched by a referral link; other pages of that URL go too."""
    pages = table(spark, sf_dir, "pages")
    referred = pages.where(F.col("url").rlike(r"[?&]ref=")).select("url")
    return urls.judge(pages.select("page_id", "url"), referred)


ORACLES["op5_url_filter"] = r"""
with cutoff as (
    select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages
), parts as (
    select page_id, url,
           translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from cutoff
), canon as (
    select *, regexp_replace(host, '^www\.', '') || rtrim(path, '/') as canonical,
           case when ('.' || host) like '%.example.org' and path like '/en/1%' then 'example.org/en/1'
                when ('.' || host) like '%.example.org' and path like '/es/%' then 'example.org/es/'
                when ('.' || host) like '%.com' and path like '/fr/%' then 'com/fr/'
                when ('.' || host) like '%.com' and path like '/de/%' then 'com/de/'
                when ('.' || host) like '%.org' and path like '/%' then 'org/' end as rule
    from parts
), listed as (
    select distinct canonical from canon where canonical <> '' and regexp_matches(url, '[?&]ref=')
)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from canon
"""


@query
def op8_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    both = F.array_sort(F.array_union("places.label", "blocks.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)).alias("score"),
    )


@query
def op10_embedding_near_dedup(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op6_hmm_scoring(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark, sf_dir):
    kept = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


CONTROLS = r"\### Assistant: </turn> ok"


@query
def op12_chat_format(spark, sf_dir):
    """Conversation -7 has the template's own control strings in its texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [(-7, 0, "user", CONTROLS), (-7, 1, "assistant", CONTROLS)]
    planted = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(planted)))


@query
def op13_importance_resampling(spark, sf_dir):
    ranked = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)


ORACLES["op8_license_scan"] = rf"""
with lower as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents
), words as (
    select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lower
), phrases as (
    select string_split(phrase, ' ') as p, label from (values {_values(licenses.PHRASES)}) v(phrase, label)
), places as (
    select doc_id, label, i - 1 as start
    from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words) s, phrases
    where w[i] = p[1] and w[i:i + len(p) - 1] = p
), base as (
    select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word,
           string_agg(distinct label, ',' order by label) as base_labels
    from places group by 1
), templates as (
    select row_number() over () as id, label, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t
    from (values {_values(licenses.TEMPLATES)}) v(label, text)
), tokens as (
    select distinct id, label, ceil({licenses.SPAN} * len(t) - 1e-9)::bigint as width, t[i] as one, t[i + 1] as two
    from (select *, unnest(range(1, len(t))) as i from templates)
), sizes as (
    select id, count(*) as n, ceil({licenses.THRESHOLD} * count(*) - 1e-9) as need from tokens group by 1
), hits as (
    select doc_id, i, id, label, width, one || ' ' || two as token
    from (select doc_id, w[i] as a, w[i + 1] as b, i from (select doc_id, w, unnest(range(1, len(w))) as i from words)) join tokens
      on a = one and b = two
), blocks as (
    select x.doc_id, x.label, x.i, count(distinct y.token) / any_value(n)::double as containment
    from hits x join hits y on x.doc_id = y.doc_id and x.id = y.id and y.i between x.i and x.i + x.width - 2 join sizes s on x.id = s.id
    group by x.doc_id, x.label, x.id, x.i having count(distinct y.token) >= any_value(need)
), method as (
    select doc_id, max(containment) as score from blocks group by 1
), labelled as (
    select doc_id, string_agg(distinct label, ',' order by label) as labels
    from (select doc_id, label from places union all select doc_id, label from blocks) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from words left join base using (doc_id) left join labelled using (doc_id) left join method using (doc_id)
"""


ORACLES["op2_suffix_dedup"] = r"""
with docs as (
    select doc_id, encode(coalesce(text, '')) as raw from documents
), windows as (
    select doc_id, i, hash(raw[i + 1:i + 200]) as h
    from (select doc_id, raw, unnest(range(0, octet_length(raw) - 199)) as i from docs)
), repeated as (
    select doc_id, i from windows
    where h in (select h from windows group by h having count(*) > 1)
), marked as (
    select doc_id, i, coalesce(i > lag(i) over w + 200, true)::int as fresh
    from repeated window w as (partition by doc_id order by i)
), spans as (
    select doc_id, span, min(i) as a, max(i) + 200 as b
    from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from marked) group by all
), edges as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans
), cut as (
    select doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, max(b) as last,
           list(raw[before + 1:a] order by a) as parts
    from edges join docs using (doc_id) group by 1
)
select doc_id, octet_length(raw)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(case when n_spans is null then raw
                   else list_reduce(parts, lambda x, y: x || y) || raw[last + 1:] end) as kept_sha256
from docs left join cut using (doc_id)
"""

ORACLES["op10_embedding_near_dedup"] = """
with recursive vectors as (
    select vec_id, embedding::double[] as x from embeddings
), usable as (
    select vec_id, x from vectors
    where len(list_filter(x, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(x, lambda v: v <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
    where list_cosine_similarity(a.x, b.x) >= 0.9
), reached(a, b) as (
    select vec_id, vec_id from vectors union select r.a, l.b from reached r join links l on r.b = l.a
), counted as (
    select a, count(*) as n from links group by 1
)
select vec_id, coalesce(any_value(n), 0) as n_links, min(b) as component_id, vec_id = min(b) as kept
from vectors join reached on vec_id = reached.a left join counted on vec_id = counted.a group by vec_id
"""


# crc32 of the column ``key``: the table of the polynomial, then one step per byte.
CRC = """
crc_table as (
    select list(x order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as x
        from range(256) r(i))
), crc_keys as (
    select key, hex(encode(key)) as h from (select distinct key from keyed)
), crcs as (
    select key, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, [cast('0x' || h[2 * i - 1:2 * i] as bigint) for i in range(1, length(h) // 2 + 1)]),
        lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]))) as crc
    from crc_keys, crc_table
)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_spelling_variants"] = rf"""
with recursive runs as (
    select doc_id, run, count(*) as n
    from (select doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents)
    where length(run) >= 7 group by all
), keyed as (
    select *, coalesce(doc_id::varchar, '') || ':' || run as key from runs
), {CRC}, counted as (
    select word, sum(n)::bigint as n
    from (select n, case when crc % 31 = 0 then substr(run, 1, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2)
                         else run end as word
          from keyed join crcs using (key))
    where length(word) >= 7 group by 1 having sum(n) >= 2
), cuts as (
    select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
    from (select word, n, unnest(range(1, length(word) + 1)) as i from counted)
), near as (
    select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select c.word, s.word, s.n from cuts c join counted s on c.rest = s.word
    union select s.word, c.word, c.n from cuts c join counted s on c.rest = s.word
), best as (
    select word, count(*) as n_near, max(other_n) as best_n from near group by 1
), chosen as (
    select b.word, n_near, best_n, min(other) as best from best b join near x on b.word = x.word and other_n = best_n group by all
), judged as (
    select word, n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * n then best end as form,
           case when best_n >= 10 * n then best_n end as form_n
    from counted left join chosen using (word)
), way(word, last) as (
    select word, word from judged union all select w.word, j.form from way w join judged j on w.last = j.word where j.form is not null
)
select j.word, j.form, w.last as root, j.n, j.n_near, j.form_n
from judged j join way w on j.word = w.word join judged e on w.last = e.word where e.form is null
"""

ORACLES["op12_chat_format"] = rf"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '{CONTROLS}' union all select -7, 1, 'assistant', '{CONTROLS}'
), written as (
    select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>'), ':', '\:') || ': '
           || replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>') || '</turn>' || chr(10) as segment
    from turns
), sized as (
    select *, sum(length(segment)) over (partition by conv_id order by turn nulls first, role, text
                                         rows between unbounded preceding and current row) as so_far from written
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(segment))::bigint as formatted_chars, count(*) filter (where role = 'assistant') as n_examples,
       coalesce(sum(so_far) filter (where role = 'assistant'), 0)::bigint as example_chars
from sized group by conv_id
"""

ORACLES["op13_importance_resampling"] = rf"""
with texts as (
    select doc_id, true as own, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
    union all select null, false, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), keyed as (
    select doc_id, own, unnest(w) as key from texts
), {CRC}, buckets as (
    select doc_id, own, crc % 10000 as bucket, count(*) as n from keyed join crcs using (key) group by all
), sides as (
    select bucket, coalesce(sum(n) filter (where own), 0)::double as s, coalesce(sum(n) filter (where not own), 0)::double as t
    from buckets group by 1
), totals as (
    select sum(s) as s_all, sum(t) as t_all from sides
), gains as (
    select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from sides, totals
), weighed as (
    select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight
    from buckets join gains using (bucket) where own group by 1
), scored as (
    select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || sha256('2024:' || doc_id)[1:8] as bigint) + 0.5::double) / 4294967296)))::bigint
           as score
    from documents left join weighed using (doc_id)
), placed as (
    select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank
from scored left join placed using (doc_id)
"""
