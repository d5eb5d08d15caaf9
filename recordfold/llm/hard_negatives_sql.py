"""DuckDB twin of the hard-negative query."""


def oracle() -> str:
    return """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.q, c.q)::bigint as score
  from v a join v c on a.vec_id % 50 = 0),
positives as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r
    from scores where same and vec_id <> anchor_id) where r <= 5),
negatives as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from positives p join scores n on n.anchor_id = p.anchor_id and not n.same
    and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 3
"""
