"""DuckDB twin of the fill-in-the-middle query."""


def oracle() -> str:
    h = ", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))
    return f"""
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, {h} from t),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(units[1:a], ''), '') as pre, coalesce(array_to_string(units[a + 1:b], ''), '') as mid,
    coalesce(array_to_string(units[b + 1:n], ''), '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars,
  case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid
    else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
