"""DuckDB SQL of the engine's queries."""

from __future__ import annotations

from quire.functions.rules import RULES
from quire.operators.tables import MODULES, PRIORITY
from quire.sources.parse import LOADERS

SPACE = r"[\s\p{Z}\x{85}\x0b]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]"


def _sub(x: str, pattern: str, new: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {new}, 'g')"


def _strip(x: str) -> str:
    return _sub(x, f"^{SPACE}+|{SPACE}+$")


def _clean(x: str) -> str:
    x = _sub(f"coalesce({x}, '')", r"\r\n|\r", "chr(10)")
    x = _sub(x, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]")
    x = _sub(x, r"[ \t]+", "' '")
    x = _sub(x, r"\n[ \t]*\n+", "chr(10) || chr(10)")
    return _strip(_sub(x, r"(?m)^[ \t]+|[ \t]+$"))


def _tokens(x: str) -> str:
    return f"list_concat(list_concat(regexp_extract_all(lower({x}), '[a-zA-Z]+'), regexp_extract_all(lower({x}), '[一-鿿]')), regexp_extract_all(lower({x}), '[0-9]+'))"


def _ext(x: str) -> str:
    return rf"lower(regexp_extract({x}, '\.([^./]+)$', 1))"


def _case(x: str, values: dict, other: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in values.items()) + f" else {other} end"


def _rules(x: str, *names: str) -> str:
    for r in sorted(RULES, key=lambda r: r.priority):
        if r.name in names if names else r.enabled:
            x = _sub(x, r.pattern, "chr(10)" if r.replacement == r"\n" else f"'{r.replacement}'")
    return x


_LINKED = "coalesce(content, '') || ' see https://example.org/a?b=1 and me@example.org.'"
_INCOMING = "(select chunk_id, regexp_extract(chunk_id, '^(.*)#', 1) as source_file, content from incoming_chunks)"
CUTOFF = "2025-06-01"
_STATE = f"(select file_path, arg_max(file_hash, struct_pack(a := processed_at, b := file_hash)) as file_hash from file_records where processed_at < '{CUTOFF}' group by file_path)"
_CURRENT = "(select file_path, arg_max(file_hash, struct_pack(a := processed_at, b := file_hash)) as file_hash from file_records group by file_path)"
_FAILED = f"(select f.file_path, s.file_hash from (select distinct filename as file_path from cleaning_results where error is not null and filename is not null) f left join {_STATE} s using (file_path))"
_CLASSIFIED = f"""(select c.file_path, c.file_hash,
    case when c.file_hash is null then 'hash_error'
         when f.file_path is not null and f.file_hash is not distinct from c.file_hash then 'error_skipped'
         when f.file_path is not null then 'modified'
         when s.file_path is null then 'new'
         when s.file_hash is distinct from c.file_hash then 'modified' else 'unchanged' end as reason
    from {_CURRENT} c left join {_STATE} s using (file_path) left join {_FAILED} f on f.file_path = c.file_path)"""
_FILES = f"(select c.file_path, z.size_bytes, c.reason from {_CLASSIFIED} c join (select file_path, max(cast(metadata['size_bytes'] as bigint)) as size_bytes from file_records group by file_path) z using (file_path))"
_TASKS = f"""(select l.file_path, case when f.file_path is not null then 'error' when l.n < 0 then 'skipped' when l.n = 0 then 'processing' else 'completed' end as status
    from (select file_path, arg_max(n, struct_pack(a := processed_at, b := n)) as n from (select *, coalesce(len(chunk_ids), -1) as n from file_records where processed_at < '{CUTOFF}') group by file_path) l
    left join {_FAILED} f using (file_path))"""
_RECORDED = f"""(select t.file_path, coalesce(r.status, t.status) as status, r.error as error, cast(case when r.status = 'error' and r.error is not null then 1 else 0 end as int) as retry_count
    from {_TASKS} t left join (select filename as file_path, case when count(error) > 0 then 'error' else 'completed' end as status, min(error) as error from cleaning_results where filename is not null group by 1) r using (file_path))"""
_PLAN = f"""(select f.file_path, f.reason,
    case when f.size_bytes < 1024 then 'filtered'
         when t.status in ('completed', 'error') then case when f.reason = 'modified' then 'pending' else t.status end
         when t.status = 'skipped' then case when f.reason not in ('unchanged', 'error_skipped') then 'pending' else 'skipped' end
         when t.status = 'processing' then 'pending'
         when t.status is not null then t.status
         when f.reason not in ('unchanged', 'error_skipped') then 'pending' else 'skipped' end as next_status,
    {_case(_ext("f.file_path"), PRIORITY, "99")} as priority
    from {_FILES} f left join {_TASKS} t using (file_path))"""
_MODULE = "case " + " ".join("when " + " or ".join(f"contains(lower(error), '{w}')" for w in words) + f" then '{m}'" for m, words in MODULES) + " else 'unknown' end"
_COUNTS = f"(select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as term from (select doc_id, {_tokens('text')} as t from documents)) group by doc_id, term)"
_BM25 = f"""
    with counts as {_COUNTS},
    stats as (select count(*) as n, avg(len({_tokens("coalesce(text, '')")})) as avgdl from documents),
    vocab as (select term, row_number() over (order by df desc, term) - 1 as term_index, df, ln((n - df + 0.5) / (df + 0.5) + 1) as idf
        from (select term, count(*) as df from counts group by term), stats qualify term_index < 50000),
    weights as (select doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as weight from counts join vocab using (term), stats where weight > 0)
"""
_TERMS = f"select doc_id as query_id, unnest({_tokens('title')}) as term from documents where doc_id % 20 = 0 and title is not null"
_HITS = f"""{_BM25}, terms as (select distinct * from ({_TERMS})),
    hits as (select query_id, doc_id, round(sum(weight), 6) as score from terms join weights using (term) group by query_id, doc_id),
    ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from hits)"""
_SCORES = {
    "cosine": "1 - (1 - list_cosine_similarity(a, b)) / 2",
    "l2": "exp(-pow(list_distance(a, b), 2))",
    "ip": "list_inner_product(a, b)",
}


def _top(space: str, k: int, where: str = "true", name: str = "hits") -> str:
    return f"""(select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
        select q.vec_id as query_id, v.vec_id as vec_id, round({_SCORES[space]}, 6) as score
        from (select vec_id, embedding::double[] as a from embeddings where vec_id % 20 = 0) q, (select vec_id, label, embedding::double[] as b from embeddings where {where}) v) qualify rank <= {k}) {name}"""


_DETAIL = f"""(select query_id, count(distinct item) as n_retrieved, any_value(n_relevant) as n_relevant, count(case when l = label then 1 end) as hits,
    count(case when l = label then 1 end) / count(distinct item) as precision, count(case when l = label then 1 end) / any_value(n_relevant) as recall
    from (select h.query_id, h.vec_id as item, q.label, v.label as l, n.n - 1 as n_relevant from {_top("cosine", 6)}
        join embeddings q on q.vec_id = h.query_id join embeddings v on v.vec_id = h.vec_id join (select label, count(*) as n from embeddings group by label) n on n.label = q.label
        where h.vec_id <> h.query_id) group by query_id)""".replace("h.", "hits.")
_FIRST = "(select doc_id, text, min(doc_id) over (partition by text) as first_id from documents)"
_NGRAMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _simhash(rows: str, key: str, text: str) -> str:
    """(key, fp) of rows with a text: the majority of each bit of the low 8 md5 bytes of the trigrams."""
    bits = ", ".join(f"sum((h >> {i}) & 1) as b{i}" for i in range(64))
    total = " + ".join(f"case when 2 * b{i} > n then {1 << i}::hugeint else 0 end" for i in range(64))
    return f"""(select {key}, cast(case when v >= 9223372036854775808 then v - 18446744073709551616 else v end as bigint) as fp from (
        select {key}, {total} as v from (select {key}, count(*) as n, {bits} from (
            select {key}, cast('0x' || substr(md5(substr({text}, cast(i as bigint), 3)), 17, 16) as ubigint) as h
            from (select {key}, {text}, unnest(range(1, greatest(length({text}) - 2, 1) + 1)) as i from {rows} where {text} is not null)) group by {key})))"""


# Nodes are taken in their order; one goes if an earlier one that is linked to it has stayed.
_WALK = """walk(rn, gone) as (select 0::bigint, []::bigint[] union all
        select w.rn + 1, case when l.late is not null and len(list_filter(l.earlier, lambda x: not list_contains(w.gone, x))) > 0 then list_append(w.gone, w.rn + 1) else w.gone end
        from walk w left join links l on l.late = w.rn + 1 where w.rn < (select count(*) from nodes)),
    gone as (select unnest(gone) as rn from (select gone from walk order by rn desc limit 1))"""


def _near_first(rows: str, key: str, text: str) -> str:
    """With `rows` (a CTE's text) named r: prints(key, fp) and kept rows by SimHash, first ones stay."""
    return f"""with recursive r as materialized ({rows}), prints as materialized (select {key}, fp from {_simhash("r", key, text)}),
    nodes as materialized (select fp, place, row_number() over (order by place) as rn from (select fp, min({key}) as place from prints group by fp)),
    links as materialized (select a.rn as late, list(b.rn) as earlier from nodes a join nodes b on b.rn < a.rn and bit_count(xor(a.fp, b.fp)) <= 3 group by a.rn),
    {_WALK},
    judged as (select p.{key}, p.fp, p.{key} = n.place and n.rn not in (select rn from gone) as kept from prints p join nodes n on n.fp = p.fp)"""


_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

SQL: dict[str, str] = {
    "load_files": """
        with k as (select unnest(['docx', 'pptx', 'xlsx', 'csv', 'html', 'txt', 'pdf']) as kind),
        f as (select s_suppkey || '.' || kind as path, kind, s_name as t, 'key ' || s_suppkey as a, 'nation ' || s_nationkey as b from supplier, k)
        select path, case kind when 'docx' then 'word' when 'pptx' then 'ppt' when 'xlsx' then 'excel' when 'txt' then 'text' else kind end as loader,
            case kind when 'docx' then a || chr(10) || chr(10) || b when 'pptx' then a || chr(10) || chr(10) || b
                when 'xlsx' then '=== Sheet: head ===' || chr(10) || t || chr(10) || '=== Sheet: body ===' || chr(10) || a || chr(10) || b
                when 'csv' then t || ' | ' || a || chr(10) || t || ' | ' || b when 'html' then t || chr(10) || a || chr(10) || b
                when 'txt' then t || chr(10) || a || chr(10) || b else '' end as content,
            case kind when 'pdf' then 'ValueError: pdf needs a recogniser, which isn''t installed' end as error,
            case when kind in ('docx', 'pptx', 'html') then t end as title, case when kind in ('docx', 'pptx') then t end as author,
            case when kind in ('pptx', 'xlsx', 'csv') then '2' end as parts, case when kind in ('csv', 'html', 'txt') then 'utf-8' end as encoding from f
    """,
    "load_slides": "select s_suppkey || '.pptx' as path, 1 as page_num, 'key ' || s_suppkey as content from supplier union all select s_suppkey || '.pptx', 2, 'nation ' || s_nationkey from supplier",
    "page_elements": r"""
        select file_path, page_num, md5(array_to_string(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''), chr(10))) as content_hash
        from (select file_path, page_num, arg_min(content, struct_pack(a := page_id, b := content)) as content from loaded_pages where content is not null group by 1, 2)
        where len(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')) > 0
    """,
    "clean_report": f"""
        select result_id, coalesce(filename, '') as filename, original_text is not null as success, case when original_text is null then 'no text' end as error, md5(c) as cleaned_hash,
            case when original_text is not null then length(c) end as cleaned_length,
            case when original_text is not null then length(c) >= 10 and (length(original_text) = 0 or length(c) / length(original_text) >= 0.1) and (length(c) = 0 or (length(c) - length(replace(c, '�', ''))) / length(c) <= 0.1) end as passed
        from (select result_id, filename, original_text, {_clean('original_text')} as c from cleaning_results)
    """,
    "out_cleaned": """
        select md5(v) as value_hash, cast(length(v) as int) as length from (select '原始文件: ' || coalesce(filename, '') || chr(10) || '原始长度: ' || length(coalesce(original_text, '')) || ' 字符' || chr(10) || '清洗后长度: ' || length(coalesce(cleaned_text, '')) || ' 字符' || chr(10) || repeat('=', 80) || chr(10) || chr(10) || coalesce(cleaned_text, '') as v from cleaning_results)
    """,
    "chunk_metadata": f"select doc_id, lang, source, title from documents where length({_strip('text')}) >= 20",
    "out_dedup_report": f"""
        select '{CUTOFF}' as timestamp, count(*) as original_count, count(distinct text) as kept_count, count(*) - count(distinct text) as removed_count,
            case when count(*) > count(distinct text) then '{{"hash":' || (count(*) - count(distinct text)) || '}}' else '{{}}' end as by_step, round((count(*) - count(distinct text)) / count(*), 4) as dedup_rate from documents
    """,
    "out_embedding_meta": "select count(embedding) as count, case when min(len(embedding)) = max(len(embedding)) then max(len(embedding)) end as dim, 'float' as dtype from embeddings where embedding is not null",
    "task_record": f"select * from {_RECORDED}",
    "task_reset": f"select file_path, case when status = 'error' then 'pending' else status end as status, cast(case when status <> 'error' then error end as varchar) as error, cast(case when status = 'error' then 0 else retry_count end as int) as retry_count from {_RECORDED}",
    "task_statistics": f"""
        select count(*) as total, {", ".join(f"count(case when status = '{x}' then 1 end) as {x}" for x in ("pending", "processing", "completed", "error", "skipped", "filtered"))},
            count(case when status in ('pending', 'processing') then 1 end) = 0 as is_completed from {_RECORDED}
    """,
    "dedup_merge": _near_first("select doc_id, text from documents", "doc_id", "text")
    + """,
        heads as (select j.doc_id, j.kept, coalesce(case when n.rn in (select rn from gone) then (select min(m.place) from nodes m where m.rn not in (select rn from gone) and bit_count(xor(m.fp, n.fp)) <= 3) else n.place end, j.doc_id) as head from judged j join nodes n using (fp)),
        more as (select h.head, string_agg(chr(10) || r.text, '' order by h.doc_id) as text, count(*) as n from heads h join r on r.doc_id = h.doc_id join r f on f.doc_id = h.head where not h.kept and r.text <> f.text group by 1)
        select h.doc_id, cast(coalesce(m.n, 0) as int) as merged_count, cast(length(r.text || coalesce(m.text, '')) as int) as length, md5(r.text || coalesce(m.text, '')) as content_hash
        from heads h join r on r.doc_id = h.doc_id left join more m on m.head = h.doc_id where h.kept
    """,
    "dedup_strategy": "select * from (select 'hash' as step, count(*) as documents from documents where doc_id not in (select min(doc_id) from documents group by text) union all select 'simhash', n from ("
    + _near_first("select min(doc_id) as doc_id, text from documents group by text", "doc_id", "text")
    + " select count(*) as n from judged where not kept)) where documents > 0",
    "hybrid_similarity": f"""
        with v as materialized (select vec_id, cast(any_value(embedding) as double[]) as v from embeddings where embedding is not null group by 1),
        docs as materialized (select doc_id, text from documents where doc_id in (select vec_id from v)),
        c as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest({_tokens('text')}) as term from docs) group by all),
        norm as (select doc_id, sqrt(sum(tf * tf)) as n from c group by 1),
        p as (select distinct x.doc_id as a, x.doc_id + 1 as b from docs x where x.doc_id + 1 in (select doc_id from docs)),
        dots as (select p.a, p.b, sum(x.tf * y.tf) as dot from p join c x on x.doc_id = p.a join c y on y.doc_id = p.b and y.term = x.term group by 1, 2),
        m as (select p.a, p.b, list_cosine_similarity(va.v, vb.v) as dense, coalesce(dot / (na.n * nb.n), 0.0) as sparse
            from p join v va on va.vec_id = p.a join v vb on vb.vec_id = p.b left join dots d on d.a = p.a and d.b = p.b left join norm na on na.doc_id = p.a left join norm nb on nb.doc_id = p.b)
        select a, b, round(dense, 5) as dense, round(sparse, 5) as sparse, round(0.7 * dense + 0.3 * sparse, 5) as hybrid from m
    """,
    "hybrid_search": f"""{_HITS},
        s as (select query_id, doc_id, score / max(score) over (partition by query_id) as sparse from ranked where rank <= 10),
        t as (select query_id, vec_id as doc_id, score as dense from {_top('cosine', 10)}),
        f as (select coalesce(s.query_id, t.query_id) as query_id, coalesce(s.doc_id, t.doc_id) as doc_id, round(0.7 * coalesce(dense, 0) + 0.3 * coalesce(sparse, 0), 6) as score from s full join t on s.query_id = t.query_id and s.doc_id = t.doc_id)
        select query_id, doc_id, round(score, 5) as score from f qualify row_number() over (partition by query_id order by score desc, doc_id) <= 5
    """,
    "simhash_fp": f"select doc_id, fp from {_simhash('documents', 'doc_id', 'text')}",
    "simhash_links": f"""
        with prints as materialized (select doc_id, fp from {_simhash('documents', 'doc_id', 'text')}), f as (select fp, count(*) as documents from prints group by fp)
        select a.fp, a.documents, (select count(*) from f b where b.fp <> a.fp and bit_count(xor(a.fp, b.fp)) <= 3) as links from f a
    """,
    "dedup_simhash": _near_first("select doc_id, text from documents", "doc_id", "text") + " select doc_id, fp, kept from judged",
    "dedup_global": _near_first("select chunk_id, content from (select distinct chunk_id, content from chunks) qualify content is null or chunk_id = min(chunk_id) over (partition by content)", "chunk_id", "content")
    + " select chunk_id from judged where kept union all select chunk_id from r where content is null",
    "dedup_embedding": f"""
        with recursive nodes as materialized (select vec_id, cast(embedding as double[]) as v, row_number() over (order by vec_id) as rn from (select distinct vec_id, embedding from embeddings)),
        links as materialized (select a.rn as late, list(b.rn) as earlier from nodes a join nodes b on b.rn < a.rn and list_cosine_similarity(a.v, b.v) >= 0.95 group by a.rn),
        {_WALK}
        select vec_id, rn not in (select rn from gone) as kept from nodes
    """,
    "chunk_merge_short": r"""
        with recursive parts as materialized (select doc_id, string_split(regexp_replace(text, '([.。!?])[ \t\n\x0b\f\r]*', '\1' || chr(1), 'g'), chr(1)) as p from documents),
        walk(doc_id, i, done, now) as (select doc_id, 1, []::varchar[], p[1] from parts union all
            select w.doc_id, w.i + 1, case when length(w.now) < 20 then w.done else list_append(w.done, w.now) end, case when length(w.now) < 20 then w.now || chr(10) || p[w.i + 1] else p[w.i + 1] end
            from walk w join parts using (doc_id) where w.i < len(p))
        select doc_id, cast(unnest(range(len(done) + 1)) as integer) as chunk_index, unnest(list_append(done, now)) as content from walk w join parts using (doc_id) where w.i = len(p)
    """,
    "html_text": f"""
        select doc_id, array_to_string(list_concat(['t'], list_filter(list_transform(flatten(list_transform(regexp_split_to_array(text, '{_LINES}'), lambda l: string_split({_strip('l')}, '  '))), lambda x: {_strip('x')}), lambda x: x <> '')), chr(10)) as content from documents
    """,
    "scan_filter_ext": f"select distinct file_path, {_ext('file_path')} as ext from file_records where {_ext('file_path')} in ('pdf', 'docx', 'txt', 'md')",
    "loader_registry": f"select {_case(_ext('file_path'), LOADERS, chr(39) + 'none' + chr(39))} as loader, count(*) as files from (select distinct file_path from file_records) group by 1",
    "load_csv_join": "select n_regionkey, string_agg(n_nationkey || ' | ' || n_name || ' | ' || n_regionkey, chr(10) order by n_nationkey) as content, count(*) as row_count from nation group by 1",
    "render_sheet_rows": "select p_partkey, concat_ws(' | ', p_partkey, p_name, p_brand, nullif(p_type, ''), p_size) as line from part",
    "html_title": "select doc_id, regexp_extract('<title>' || coalesce(title, '') || '</title>', '<title>([^<]*)</title>', 1) as title, length('<html><head><title>' || coalesce(title, '') || '</title></head><body><h1>h</h1></body></html>') as raw_length from documents",
    "page_group": "select file_path, count(*) as pages, min(page_num) as first_page, max(page_num) as last_page, cast(coalesce(sum(n), 0) as bigint) as chars from (select distinct page_id, file_path, page_num, length(content) as n from loaded_pages) group by 1",
    "file_metadata": f"select file_path, regexp_extract(file_path, '([^/]*)$', 1) as filename, {_ext('file_path')} as extension, coalesce(cast(metadata['size_bytes'] as bigint), 0) as size_bytes from file_records",
    "failed_rows": "select result_id, filename, error as reason from cleaning_results where error is not null or not success",
    "query_file_key": "select doc_id, substr(md5(title), 1, 8) as file_key from documents where title is not null",
    "clean_structure": f"select result_id, {_clean('original_text')} as cleaned from cleaning_results",
    "clean_quality_report": """
        select result_id, a as original_length, b as cleaned_length, round(r, 6) as length_ratio, v as char_set_valid, b >= 10 as min_length_check, b >= 10 and r >= 0.1 and v as passed,
            concat_ws(',', case when b < 10 then 'too short' end, case when r < 0.1 then 'over-cleaned' end, case when not v then 'invalid characters' end) as issues
        from (select result_id, a, b, case when a > 0 then b / a else 1.0 end as r, case when b > 0 then n / b <= 0.1 else true end as v
            from (select result_id, length(coalesce(original_text, '')) as a, length(coalesce(cleaned_text, '')) as b, length(coalesce(cleaned_text, '')) - length(replace(coalesce(cleaned_text, ''), '�', '')) as n from cleaning_results))
    """,
    "clean_drop_empty": f"select chunk_id from chunks where length({_clean('content')}) > 0",
    "rule_url": f"select chunk_id, {_rules(_LINKED, 'remove_url')} as content from chunks",
    "rule_email": f"select chunk_id, {_rules(_LINKED, 'remove_email')} as content from chunks",
    "rule_page_header": f"select page_id, {_rules('content', 'remove_page_headers')} as content from loaded_pages",
    "rule_page_number": f"select page_id, cast(line_no - 1 as int) as line_no, {_rules('line', 'remove_page_numbers')} as line from (select page_id, unnest(l) as line, generate_subscripts(l, 1) as line_no from (select page_id, string_split(content, chr(10)) as l from loaded_pages))",
    "rules_all": f"select page_id, {_rules('content')} as content from loaded_pages",
    "ocr_dehyphenate": "select page_id, " + _sub(_sub("content", rf"({WORD})-\n({WORD})", r"'\1\2'"), rf"({WORD})-{SPACE}*\n{SPACE}*({WORD})", r"'\1\2'") + " as content from loaded_pages",
    "ocr_merge_lines": "select page_id, "
    + _strip(_sub(_sub(r"""array_to_string(list_transform(l, lambda x, i: case when i = 1 then x.t
            when l[i - 1].i + 1 <> x.i or regexp_matches(l[i - 1].t, '[.。!！?？;；:：]$') or regexp_matches(x.t, '^[\p{Lu}\p{Nd}]') then chr(10) || chr(10) || x.t else ' ' || x.t end), '')""", " +", "' '"), r"\n{3,}", "chr(10) || chr(10)"))
    + f" as content from (select page_id, list_filter(list_transform(string_split(content, chr(10)), lambda x, i: struct_pack(t := {_strip('x')}, i := i)), lambda x: x.t <> '') as l from loaded_pages where content is not null)",
    "ocr_quotes": "select result_id, replace(replace(replace(replace(replace(translate(cleaned_text, '“”‘’', '\"\"'''''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl') as cleaned from cleaning_results",
    "strip_bullets": "select page_id, " + _sub("('• ' || content)", r"(?m)^[ \t]*(?:[•●▪◦*·-]|\d{1,2}[.)])[ \t]+") + " as content from loaded_pages",
    "remove_punct": "select chunk_id, " + _sub("content", r"\p{P}") + " as content from chunks",
    "non_ascii": "select chunk_id, " + _sub("content", r"[^\x00-\x7f]") + " as content from chunks",
    "chunk_fixed": """
        select doc_id, cast(k as int) as chunk_index, cast(k * 450 as int) as start_pos, cast(least(k * 450 + 500, n) as int) as end_pos, substr(text, k * 450 + 1, 500) as content
        from (select doc_id, text, length(text) as n, unnest(range(0, greatest(1, cast(ceil((length(text) - 50) / 450) as bigint)))) as k from documents where length(text) > 0)
    """,
    "chunk_filter_short": "select chunk_id, chunk_index from chunks where length(content) >= 20",
    "content_hash": "select chunk_id, md5(content) as md5, sha256(content) as sha256, coalesce(md5(content) = lower(content_hash), false) as as_stored from chunks",
    "chunk_ids": "select chunk_id, source_file || '#' || chunk_index as rebuilt_id from chunks",
    "chunk_upsert": f"select source_file, chunk_id, content from chunks where source_file not in (select source_file from {_INCOMING}) union all select source_file, chunk_id, content from {_INCOMING}",
    "chunks_by_file": "select source_file, chunk_index, chunk_id from chunks",
    "chunk_delete_file": f"select source_file, chunk_id from chunks where source_file not in (select source_file from {_INCOMING})",
    "chunk_delete_ids": "select chunk_id, source_file from chunks where chunk_id not in (select chunk_id from incoming_chunks)",
    "file_chunk_counts": """
        select file_path, processed_at, count(case when g.chunk_id is null then l.chunk_id end) as chunks
        from (select file_path, processed_at, unnest(case when len(chunk_ids) > 0 then chunk_ids else [null] end) as chunk_id from file_records) l
        left join (select distinct chunk_id from incoming_chunks) g on g.chunk_id = l.chunk_id group by 1, 2
    """,
    "chunk_update": "select c.chunk_id, coalesce(n.content, c.content) as content from chunks c left join (select chunk_id, min(content) as content from incoming_chunks group by 1) n using (chunk_id)",
    "chunk_stats": "select count(*) as rows, count(distinct chunk_id) as chunks, count(distinct source_file) as files, count(distinct content_hash) as contents from chunks",
    "file_unchanged": f"select file_path, coalesce(c.file_hash = s.file_hash, false) as unchanged from {_CURRENT} c left join {_STATE} s using (file_path)",
    "clean_hash_dedup": f"select doc_id, length(cleaned) as cleaned_length, md5(cleaned) as content_hash, doc_id = min(doc_id) over (partition by cleaned) as kept from (select doc_id, {_clean('text')} as cleaned from documents) where length(cleaned) > 0",
    "dedup_exact": f"select doc_id from {_FIRST} where doc_id = first_id",
    "dedup_exact_removed": f"select doc_id, first_id from {_FIRST} where doc_id <> first_id",
    "dedup_stats": "select n as original_count, k as kept_count, n - k as removed_count, coalesce(round((n - k) / n, 4), 0.0) as dedup_rate from (select count(*) as n, count(distinct text) as k from documents)",
    "dedup_incremental": "select min(incoming_id) as incoming_id, md5(content) as hash from incoming_chunks where md5(content) not in (select lower(content_hash) from encodings where content_hash is not null) group by 2",
    "dedup_groups": f"select r.doc_id as removed_id, k.doc_id as kept_id from {_FIRST} r left join (select substr(text, 1, 100) as head, min(doc_id) as doc_id from {_FIRST} where doc_id = first_id group by 1) k on k.head = substr(r.text, 1, 100) where r.doc_id <> r.first_id",
    "tokens": f"select chunk_id, array_to_string({_tokens(chr(99) + 'oalesce(content, ' + chr(39) * 2 + ')')}, ' ') as tokens from chunks",
    "bm25_stats": f"select count(*) as n_docs, round(avg(len({_tokens('text')})), 6) as avgdl from documents",
    "bm25_vocab": f"{_BM25} select term, term_index, df, round(idf, 6) as idf from vocab",
    "bm25_vectors": f"{_BM25} select doc_id, term, round(weight, 6) as weight from weights",
    "tfidf_vectors": f"""
        with w as (select doc_id, {_NGRAMS} as w from documents),
        grams as (select doc_id, unnest(list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x))) as term from w),
        counts as (select doc_id, term, count(*) as tf from grams group by 1, 2),
        n as (select count(*) as n from documents),
        df as (select term, df from (select term, count(*) as df, sum(tf) as seen from counts group by 1), n where df <= 0.95 * n qualify row_number() over (order by seen desc, term) <= 50000),
        raw as (select doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from counts join df using (term), n)
        select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from raw
    """,
    "hybrid_rows": "select chunk_id, content_hash, v.p is not null as has_dense, sparse_vector_path is not null as has_sparse, v.p is not null and sparse_vector_path is not null as is_hybrid from encodings e left join (select dense_vector_path as p from dense_vectors where dense_vector is not null) v on v.p = e.dense_vector_path",
    "sparse_cosine": f"""
        with n as (select incoming_id, chunk_id, term, count(*) as tf from (select incoming_id, chunk_id, unnest({_tokens('content')}) as term from incoming_chunks) group by all),
        o as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest({_tokens('content')}) as term from (select distinct chunk_id, content from chunks)) group by all),
        d as (select incoming_id, n.chunk_id, sum(n.tf * o.tf) as dot from n join o on n.chunk_id = o.chunk_id and n.term = o.term group by all),
        na as (select incoming_id, sqrt(sum(tf * tf)) as a from n group by 1), nb as (select chunk_id, sqrt(sum(tf * tf)) as b from o group by 1)
        select incoming_id, d.chunk_id, round(dot / (a * b), 6) as sparse_cosine, round(0.3 * dot / (a * b), 6) as hybrid from d join na using (incoming_id) join nb on nb.chunk_id = d.chunk_id
    """,
    "encode_cache_miss": "select distinct chunk_id, content_hash from chunks c where not exists (select 1 from encodings e where e.chunk_id = c.chunk_id and lower(e.content_hash) = lower(c.content_hash))",
    "encode_pending": "select distinct chunk_id from chunks where chunk_id not in (select chunk_id from encodings)",
    "vector_dims": "select cast(coalesce(len(dense_vector), 0) as int) as dim, count(*) as vectors from dense_vectors group by 1",
    **{f"topk_{s}": f"select * from {_top(s, 5)}" for s in _SCORES},
    "topk_filtered": f"select * from {_top('cosine', 5, 'label = 3')}",
    "retrieve_threshold": f"select query_id, vec_id, score, rank from {_top('cosine', 10)} where score >= 0.6 and rank <= 5",
    "retrieve_rerank": f"""select query_id, vec_id, s as score, row_number() over (partition by query_id order by s desc, vec_id) as rank from (
        select hits.query_id, hits.vec_id, round(hits.score + case when v.label = q.label then 1 else 0 end, 6) as s from {_top("cosine", 10)} join embeddings q on q.vec_id = hits.query_id join embeddings v on v.vec_id = hits.vec_id) qualify rank <= 5""",
    "bm25_search": f"{_HITS} select query_id, doc_id, score, rank from ranked where rank <= 5",
    "retrieve_preview": f"{_HITS} select query_id, doc_id, round(score, 4) as score, substr(text, 1, 300) as preview from ranked join documents using (doc_id) where rank = 1",
    "store_add_new": "select distinct chunk_id from incoming_chunks where chunk_id not in (select chunk_id from encodings)",
    "store_delete": "select chunk_id, content_hash from encodings where chunk_id in (select chunk_id from chunks)",
    "store_stats": "select metadata['model'] as model, count(*) as rows, count(distinct chunk_id) as chunks from encodings group by 1",
    "meta_flatten": """
        select chunk_id, cast((source_file is not null)::int + (chunk_index is not null)::int + (metadata['lang'] is not null)::int + (metadata['parser'] is not null)::int as int) as entries,
            source_file as source, metadata['lang'] as lang, metadata['parser'] as parser from chunks
    """,
    "eval_retrieval_detail": f"select query_id, n_retrieved, n_relevant, hits, round(precision, 6) as precision, round(recall, 6) as recall from {_DETAIL}",
    "eval_retrieval": f"select round(avg(precision), 6) as context_precision, round(avg(recall), 6) as context_recall from {_DETAIL}",
    "eval_average": f"select round((avg(precision) + avg(recall)) / 2, 6) as average_score from {_DETAIL}",
    "inc_classify": f"select file_path, reason from {_CLASSIFIED}",
    "inc_stats": f"select reason, count(*) as files from {_CLASSIFIED} group by 1",
    "inc_upsert": f"select * from {_STATE} where file_path not in (select file_path from {_CLASSIFIED} where reason in ('new', 'modified')) union all select file_path, file_hash from {_CLASSIFIED} where reason in ('new', 'modified')",
    "inc_orphans": f"select * from {_STATE} where file_path not in (select source_file from chunks where source_file is not null)",
    "task_size_filter": f"select file_path, size_bytes from {_FILES} where size_bytes < 6000",
    "task_plan": f"select * from {_PLAN}",
    "task_pending": f"select file_path, priority from {_PLAN} where next_status = 'pending'",
    "task_status_counts": f"select next_status as status, count(*) as files from {_PLAN} group by 1",
    "log_merge": "select filename as file_path, error as reason, min(result_id) as result_id from cleaning_results where error is not null and filename is not null group by 1, 2",
    "log_module": f"select error, {_MODULE} as module, count(*) as rows from cleaning_results where error is not null group by 1, 2",
    "build_stats": """
        select *, round((total_chunks - unique_chunks) / total_chunks, 4) as dedup_rate from
            (select count(distinct file_path) as total_files from file_records),
            (select count(distinct result_id) as cleaned, count(distinct case when error is not null then result_id end) as errors from cleaning_results),
            (select count(distinct chunk_id) as total_chunks, count(distinct content) as unique_chunks from chunks),
            (select count(distinct chunk_id) as encoded_chunks from encodings)
    """,
}
