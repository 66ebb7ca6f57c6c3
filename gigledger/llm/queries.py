"""The registered queries of this subpackage and their SQL twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import clustered
from .codes import coded
from .decontaminate import contaminated
from .html_text import extract_pages
from .licenses import PHRASES, TEMPLATES, scan_licenses
from .packing import pack_documents
from .quality import subword_scores
from .repetition import MOST_COVERED, MOST_IN_LINES, repetition_rules
from .simhash import simhash_groups
from .substring import remove_repeated_windows
from .token_counts import derived_edits, edited_token_counts
from .topk import top_products
from .toxicity import nearest_label_scores
from .util import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every fiftieth vector with all others."""
    return top_products(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, which follow from the documents."""
    docs = table(spark, sf_dir, "documents")
    return edited_token_counts(docs.withColumn("edits", derived_edits("text", "doc_id")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that repeat a benchmark item, re-parameterised ones included."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 35-word windows."""
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return subword_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return nearest_label_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents repeat, and which are kept."""
    return repetition_rules(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in four parts of 256 entries after four rounds."""
    return coded(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_token_counts": op2_token_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
    "op11_quality_rules": op11_quality_rules,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_vector_codes": op13_vector_codes,
}


def _values(pairs) -> str:
    return ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(pairs))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _repetition_sql() -> str:
    spans = [(3, "true"), *((n, "s > first") for n in MOST_COVERED)]
    covered = " union all ".join(
        f"select {n} as n, r, unnest(range(s, s + {n})) as p from (select r, s, count(*) over (partition by r, t) as c, min(s) over (partition by r, t) as first"
        f" from (select r, s, array_to_string(ws[s:s + {n - 1}], ' ') as t from (select r, ws, unnest(range(1, len(ws) - {n - 2})) as s from words))) where c > 1 and {test}"
        for n, test in spans
    )
    over = " or ".join([f"dup_line_chars > word_chars * {MOST_IN_LINES}::double", *(f"dup_chars_{n} > word_chars * {share}::double" for n, share in MOST_COVERED.items())])
    sums = ", ".join(f"coalesce(sum(length(w)) filter (n = {n}), 0)::bigint as dup_chars_{n}" for n in MOST_COVERED)
    names = ", ".join(f"coalesce(dup_chars_{n}, 0)::bigint as dup_chars_{n}" for n in MOST_COVERED)
    return rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
words as (
  select r, doc_id, t, case when f = '' then []::varchar[] else string_split(f, ' ') end as ws
  from (select *, trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as f from docs)),
placed as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from words),
covered as (select distinct n, r, p from ({covered})),
spans as (
  select r, (count(*) filter (n = 3))::bigint as n_repeat_words, {sums} from covered join placed using (r, p) group by r),
lines as (
  select r, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars, row_number() over (partition by r, line) as nth
  from (select r, unnest(string_split(t, chr(10))) as line from docs)),
repeats as (select r, count(*) as n, sum(chars) as chars from lines where chars > 0 and nth > 1 group by r),
found as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(repeats.n, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(repeats.chars, 0)::bigint as dup_line_chars, {names}
  from words left join spans using (r) left join repeats using (r)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from found)
select *, not base_failed and not ({over}) as kept from judged
"""


def _whole(scale: int, width: int | None) -> str:
    """CTEs whole(r, vec_id, label, i, x): the components, from 0, of vectors without null or non-finite ones."""
    size = f"and count(*) = {width}" if width else ""
    return f"""
given as (select row_number() over () as r, vec_id, label, embedding from embeddings),
pieces as (select r, vec_id, label, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from given),
fit as (select r from pieces group by r having count(*) = count(x) and bool_and(isfinite(x)) {size}),
whole as materialized (select r, vec_id, label, i, floor({scale} * x)::bigint as x from pieces where r in (select r from fit))"""


def _floor_mean(total: str = "sum(v.x)", n: str = "count(*)") -> str:
    return f"(({total} - (({total} % {n}) + {n}) % {n}) // {n})::bigint"


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""
near{step} as materialized (
  select r, min_by(e, (d, e)) as e, min(d) as d from (
    select v.r, c.e, sum((v.x - c.x) * (v.x - c.x))::bigint as d from whole v join cent{step} c using (i) group by v.r, c.e) group by r)""")
        if step < rounds:
            steps.append(f"""
cent{step + 1} as materialized (
  select c.e, c.i, coalesce(m.x, c.x) as x from cent{step} c left join (
    select n.e, v.i, {_floor_mean()} as x from near{step} n join whole v using (r) group by n.e, v.i) m using (e, i))""")
    return f"""
with {_whole(1024, 64)},
firsts as (select r, row_number() over (order by sha256('3:' || vec_id), r) - 1 as e from (select distinct r, vec_id from whole) qualify e < {k}),
cent0 as materialized (select e, i, x from firsts join whole using (r)),
{",".join(steps)},
digests as (select e, sha256(string_agg(x::varchar, ',' order by i)) as digest from cent{rounds} group by e),
sums as (select e, sum(d)::bigint as inertia, count(*) as n from near{rounds} group by e)
select vec_id, near.e::int as cluster, near.d as distance, sums.inertia as cluster_inertia, (select sum(inertia) from sums)::bigint as inertia,
       digest as centroid_sha256, sums.n::bigint as cluster_size
from near{rounds} near join sums using (e) join digests using (e) join (select distinct r, vec_id from whole) using (r)
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for step in range(rounds + 1):
        steps.append(f"""
near{step} as materialized (
  select r, p, min_by(e, (d, e)) as e, min(d) as d from (
    select v.r, v.p, b.e, sum((v.x - b.x) * (v.x - b.x))::bigint as d from cut v join book{step} b using (p, i) group by v.r, v.p, b.e) group by r, p)""")
        if step < rounds:
            steps.append(f"""
book{step + 1} as materialized (
  select b.p, b.e, b.i, coalesce(m.x, b.x) as x from book{step} b left join (
    select v.p, n.e, v.i, {_floor_mean()} as x from near{step} n join cut v using (r, p) group by v.p, n.e, v.i) m using (p, e, i))""")
    return f"""
with {_whole(1024, None)},
size as (select (max(i) + 1) // {parts} as m from whole),
cut as materialized (select r, i // m as p, i % m as i, x from whole, size),
ids as (select distinct r, vec_id, label from whole),
firsts as (select r, row_number() over (order by vec_id, r) - 1 as e from ids qualify e < {entries}),
book0 as materialized (select p, e, i, x from firsts join cut using (r)),
{",".join(steps)},
codes as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(x::varchar, ',' order by p, e, i)) from book{rounds}) as codebooks_sha256
from codes join ids using (r)
"""


ORACLE: dict[str, str] = {
    "op1_exact_topk": """
with given as (select row_number() over () as r, vec_id, embedding from embeddings),
parts as (
  select r, vec_id, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as x from given),
good as (select r from parts group by r having count(*) = count(x) and bool_and(isfinite(x))),
v as (select r, vec_id, i, floor(256 * x)::bigint as x from parts where r in (select r from good)),
s as (
  select q.r as qr, q.vec_id as query_id, p.r as pr, p.vec_id, sum(q.x * p.x)::bigint as score
  from v q join v p on q.i = p.i and q.r <> p.r where q.vec_id % 50 = 0 group by all)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by qr order by score desc, vec_id, pr) as rank from s) where rank <= 5
""",
    "op6_license_scan": f"""
with d as (select row_number() over () as r, doc_id, {_LOWER} as t from documents),
w as (select r, doc_id, regexp_extract_all(t, '{_WORD}') as ws, t from d),
phrases(i, label, p) as (values {_values([(label, p) for p, label in PHRASES])}),
spots as (select r, ws, unnest(range(1, len(ws) + 1)) as s from w),
places as (
  select r, s - 1 as s, label from spots join phrases
  on array_to_string(ws[s:s + len(string_split(p, ' ')) - 1], ' ') = p),
base as (
  select r, count(*) as n, min(s) as lo, max(s) as hi, string_agg(distinct label, ',' order by label) as labels
  from places group by r),
templates(i, label, t) as (values {_values([(label, t) for label, t, _ in TEMPLATES])}),
tells(i, tell) as (values {", ".join(f"({i}, '{t}')" for i, (_, _, tells) in enumerate(TEMPLATES) for t in tells)}),
tw as (select i, label, unnest(list_distinct(string_split(t, ' '))) as word from templates),
size as (select i, count(*) as n from tw group by i),
step as (select max(len(string_split(t, ' '))) as m from templates),
starts as (select r, ws, m, unnest(range(0, greatest(1, ceil(len(ws) / m)::bigint - 1))) as k from w, step),
blocks as (select r, k, ws[k * m + 1:k * m + 2 * m] as b from starts),
bw as (select distinct r, k, unnest(b) as word from blocks),
shares as (
  select r, k, tw.i, tw.label, count(*)::double / any_value(size.n) as share
  from bw join tw using (word) join size on size.i = tw.i
  group by r, k, tw.i, tw.label having count(*) >= ceil(0.8 * any_value(size.n) - 1e-9)),
held as (
  select s.r, s.label, s.share from shares s join blocks using (r, k)
  where s.i not in (select i from tells)
     or exists (select 1 from tells where tells.i = s.i and contains(' ' || array_to_string(b, ' ') || ' ', ' ' || tell || ' '))),
best as (select r, max(share) as share from held group by r),
every as (
  select r, string_agg(distinct label, ',' order by label) as labels
  from (select r, label from held union select r, label from places) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, lo::bigint as first_word, hi::bigint as last_word,
       coalesce(base.labels, '') as base_labels, coalesce(every.labels, '') as labels,
       greatest(case when n > 0 then 1.0 else 0.0 end, coalesce(share, 0.0))::double as score
from w left join base using (r) left join every using (r) left join best using (r)
""",
    "op4_substring_dedup": r"""
with flat as (
  select row_number() over () as r, doc_id,
         trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as t
  from documents),
words as (select r, doc_id, case when t = '' then []::varchar[] else string_split(t, ' ') end as ws from flat),
wins as (
  select r, s, array_to_string(ws[s:s + 34], ' ') as t
  from (select r, ws, unnest(range(1, len(ws) - 33)) as s from words)),
hits as (select r, s from wins where t in (select t from wins group by t having count(*) > 1)),
gone as (select distinct r, p from (select r, unnest(range(s, s + 35)) as p from hits)),
placed as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from words),
kept as (
  select placed.r, string_agg(w, ' ' order by placed.p) as t, count(*) as n
  from placed left join gone on placed.r = gone.r and placed.p = gone.p where gone.r is null group by placed.r)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept on words.r = kept.r
""",
    "op11_quality_rules": _repetition_sql(),
    "op12_centroid_clustering": _clusters_sql(),
    "op13_vector_codes": _codes_sql(),
}
