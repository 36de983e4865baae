"""DuckDB SQL for those corpus queries that SQL can express."""

from string import ascii_lowercase, ascii_uppercase

SQL: dict[str, str] = {
    "op11_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, sha256(t) as text_sha256
from d window g as (partition by t)""",
    "op12_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and embedding is not null and not list_bool_or(list_transform(embedding, lambda x: coalesce(not isfinite(x), true)))),
scored as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, (row_number() over w)::int as rank, n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on p.anchor_id = n.anchor_id and not n.same and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id)
qualify rank <= 5""",
    "op13_ranked_search": rf"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
lengths as (select doc_id, count(*) as n from t group by all),
total as (select count(*) as docs, sum(n)::bigint as words from lengths),
tf as (select doc_id, term, count(*) as tf from t where term in (select term from q) group by all),
weight as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by term, docs),
impact as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))) as impact
  from tf join weight using (term) join lengths using (doc_id), total),
score as (select item_id, doc_id, sum(times * impact)::bigint as score from q join impact using (term) group by all having sum(times * impact) > 0)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from score qualify rank <= 10""",
}
