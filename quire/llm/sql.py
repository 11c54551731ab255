"""SQL that gives the same rows as the queries of this package, where SQL can express them."""

_NORMAL = r"trim(regexp_replace(lower(content), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


def _shared(left: str, right: str, same: str) -> str:
    """CTEs over t(id, text): n-grams, and pairs (a, b) of ids of left and right with similarity of at least 0.70."""
    return f"""g as materialized (select distinct id, substr(text, cast(i as bigint), 5) as h from (select id, text, unnest(range(1, length(text) - 3)) as i from t)),
    n as materialized (select id, count(*) as n from g group by id),
    o as (select a.id as a, b.id as b, count(*) as shared from g a join g b on a.h = b.h and {same} where a.id in ({left}) and b.id in ({right}) group by 1, 2),
    s as materialized (select a, b from o join n x on x.id = a join n y on y.id = b where shared >= 0.7 * (x.n + y.n - shared) - 1e-9)"""


_CHUNK_PAIRS = f"""t as materialized (select row_number() over () as id, text from (select distinct {_NORMAL} as text from chunks where length(content) >= 80)),
    {_shared("select id from t", "select id from t", "a.id < b.id")}"""

_REFUSED = rf"""
    with recursive r as materialized (select incoming_id, content, row_number() over (order by batch_no, incoming_id) as place, md5(content) as hash, {_NORMAL} as text from incoming_chunks),
    seen as materialized (select distinct lower(content_hash) as hash from encodings where content_hash is not null),
    j as materialized (select *, case when hash in (select hash from seen) then 'known' when content is not null and place > min(place) over (partition by content) then 'copy' end as why from r),
    f as materialized (select place, text from j where why is null and length(content) >= 80),
    h as materialized (select distinct {_NORMAL} as text from chunks where length(content) >= 80 and chunk_id in (select chunk_id from encodings)),
    t as materialized (select row_number() over () as id, text from (select text from f union select text from h)),
    {_shared("select id from t join f using (text)", "select id from t", "a.id <> b.id")},
    near as materialized (select a, b from s union select id, id from t join f using (text)),
    old as materialized (select distinct place from f join t using (text) join near on a = t.id join t u on u.id = b join h on h.text = u.text),
    nodes as materialized (select place, row_number() over (order by place) as rn from f),
    links as materialized (select late, list(rn) as earlier from (select distinct m.rn as late, q.rn from f x join nodes m on m.place = x.place join t on t.text = x.text join near on a = t.id join t u on u.id = b join f y on y.text = u.text join nodes q on q.place = y.place where q.rn < m.rn) group by late),
    walk(rn, gone) as (select 0::bigint, []::bigint[] union all
        select w.rn + 1, case when m.place in (select place from old) or l.late is not null and len(list_filter(l.earlier, lambda x: not list_contains(w.gone, x))) > 0 then list_append(w.gone, w.rn + 1) else w.gone end
        from walk w join nodes m on m.rn = w.rn + 1 left join links l on l.late = w.rn + 1),
    gone as (select unnest(gone) as rn from (select gone from walk order by rn desc limit 1)),
    refused as (select incoming_id, coalesce(why, case when place in (select place from nodes join gone using (rn)) then 'similar' end) as reason from j)
"""

SQL = {
    "p1_found": """
        with reached as materialized (select distinct vec_id, cast(dense_vector as double[]) as v from dense_vectors where dense_vector_path in (select dense_vector_path from encodings) and len(dense_vector) = 64),
        u as materialized (select vec_id, v from reached where list_aggregate(list_transform(v, lambda x: x * x), 'sum') > 0),
        c as materialized (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.v, b.v) as cosine from u a join u b on a.vec_id <> b.vec_id),
        k as (select a, b, cosine, row_number() over (partition by a order by round(cosine, 6) desc, b) as rank from c)
        select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from k where rank <= 5 and cosine >= 0.9
    """,
    "p4_found": f"""
        with {_CHUNK_PAIRS},
        m as materialized (select distinct chunk_id, content, id from chunks join t on t.text = {_NORMAL} where length(content) >= 80),
        p as (select a, b from s union all select id, id from t)
        select distinct least(x.chunk_id, y.chunk_id) as chunk_id_a, greatest(x.chunk_id, y.chunk_id) as chunk_id_b
        from p join m x on x.id = a join m y on y.id = b where x.chunk_id <> y.chunk_id and x.content <> y.content
    """,
    "p6_found": f"{_REFUSED} select incoming_id from refused where reason is not null",
    "p6_refused": f"{_REFUSED} select incoming_id, reason from refused where reason is not null",
    "p2_found": """
        select distinct item_table, item_key from (
            select 'chunks' as item_table, chunk_id as item_key from chunks where length(content) > 500
            union all
            select 'cleaning_results', cast(result_id as varchar) from cleaning_results where length(cleaned_text) > 500)
    """,
}
