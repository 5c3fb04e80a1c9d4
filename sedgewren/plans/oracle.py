"""The registered queries as DuckDB SQL, written from their rules and not from the plans."""

from __future__ import annotations

from sedgewren.functions.text import STOP_WORDS_EN, STOP_WORDS_RU, SUFFIXES
from sedgewren.operators import answering

_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def sentences(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({norm(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0)"


def stem(t: str) -> str:
    cases = " ".join(f"when {t} like '%{s}' and length({t}) - {len(s)} >= 4 then left({t}, length({t}) - {len(s)})" for s in SUFFIXES)
    return f"case {cases} else {t} end"


def tokens(x: str, russian: bool = True) -> str:
    stop = "[" + ", ".join(map(_q, dict.fromkeys([*STOP_WORDS_EN, *(STOP_WORDS_RU if russian else [])]))) + "]"
    other = "[^a-zа-яё0-9]+" if russian else "[^a-z0-9]+"
    kept = f"list_filter(string_split(trim(regexp_replace(lower({x}), '{other}', ' ', 'g')), ' '), lambda t: length(t) > 1 and not list_contains({stop}, t))"
    return f"list_transform({kept}, lambda t: case when regexp_matches(t, '[а-яё]') then t else {stem('t')} end)" if russian else f"list_transform({kept}, lambda t: {stem('t')})"


def bigrams(t: str) -> str:
    return f"case when len({t}) > 1 then list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])) else []::varchar[] end"


def overlap(a: str, b: str) -> str:
    return f"case when len(list_distinct({a})) > 0 then len(list_intersect(list_distinct({a}), {b})) / len(list_distinct({a}))::double else 0.0 end"


def _chunk_ctes(name: str, pages: str) -> str:
    """CTE ``name`` of the chunks of ``pages``(document_id, page_num, text, filename, folder)."""
    step = "case when a.size + x.size > 512 then {'cur': right(trim(a.cur), 50) || ' ' || x.cur, 'size': length(right(trim(a.cur), 50)) + x.size, 'out': case when length(trim(a.cur)) >= 100 then list_append(a.out, trim(a.cur)) else a.out end} else {'cur': a.cur || ' ' || x.cur, 'size': a.size + x.size, 'out': a.out} end"
    return f"""
{name}_s as (select *, {sentences('text')} as s from ({pages}) where length(text) >= 100),
{name}_f as (select *, list_reduce(list_transform(s, lambda x: {{'cur': x, 'size': length(x), 'out': []::varchar[]}}), lambda a, x: {step}) as f from {name}_s where len(s) > 0),
{name}_o as (select document_id, page_num, filename, folder, case when length(trim(f.cur)) >= 100 then list_append(f.out, trim(f.cur)) else f.out end as out from {name}_f),
{name}_u as (select document_id, page_num, filename, folder, unnest(out) as text, unnest(range(len(out))) as pos from {name}_o where len(out) > 0),
{name} as (select document_id || '_p' || page_num || '_c' || chunk_index as chunk_id, * from (select document_id, page_num, filename, folder, text, cast(row_number() over (partition by document_id order by page_num, pos) - 1 as int) as chunk_index from {name}_u))"""


_PAGES = "select doc_id as document_id, 1 as page_num, text, 'doc_' || doc_id || '.pdf' as filename, coalesce(source, '') as folder from documents"
_CONV = "select conv_id as document_id, cast(turn + 1 as int) as page_num, text, 'conv_' || conv_id as filename, '' as folder from conversations"
_CHUNKS = _chunk_ctes("chunks", _PAGES)


def _bm25(prefix: str, source: str, asked: str, pool: int, folder: bool = False, scope: str = "") -> str:
    """CTEs ``prefix``_hits over the chunks of ``source`` for ``asked``(query_id, variant, text[, folder])."""
    scope = "where a.folder = c.folder" if folder else scope
    return f"""
{prefix}_t as (select chunk_id, {tokens('text')} as t from {source}),
{prefix}_l as (select chunk_id, len(t) as dl from {prefix}_t),
{prefix}_p as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest(t) as term from {prefix}_t) group by all),
{prefix}_g as (select count(*) as n, avg(dl) as avgdl from {prefix}_l),
{prefix}_r as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from {prefix}_p, {prefix}_g group by term),
{prefix}_i as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from {prefix}_r) else raw end as idf from {prefix}_r),
{prefix}_a as (select query_id, variant, term, count(*) as qtf from (select query_id, variant, unnest({tokens('text')}) as term from {asked}) group by all),
{prefix}_s as (select query_id, variant, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw from {prefix}_a join {prefix}_i using (term) join {prefix}_p using (term) join {prefix}_l using (chunk_id), {prefix}_g group by all),
{prefix}_c as (select s.*, c.document_id, c.chunk_index, max(s.raw) over (partition by s.query_id, s.variant) as best from {prefix}_s s join {source} c using (chunk_id) join {asked} a using (query_id, variant) {scope}),
{prefix}_hits as (select * from (select query_id, variant, chunk_id, score, row_number() over (partition by query_id, variant order by score desc, document_id, chunk_index) as rank from (select *, round(raw / best, 9) as score from {prefix}_c where best > 0 and raw > 0)) where rank <= {pool})"""


_COS = "(list_dot_product(a::double[], b::double[]) / (sqrt(list_dot_product(a::double[], a::double[])) * sqrt(list_dot_product(b::double[], b::double[]))))"


def cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[]))))"


_ASKED = f"""
words as (select item_id as query_id, string_split({norm('text')}, ' ') as w from benchmark),
cut as (select query_id, 0 as variant, array_to_string(w[:(len(w) + 1) // 2], ' ') as text from words union all select query_id, 1, array_to_string(w[(len(w) + 1) // 2 + 1:], ' ') from words),
asked as (select query_id, variant, cut.text, embedding as vector from cut join embeddings on vec_id = query_id * 2 + variant where cut.text <> '')"""
_BASE = f"with {_CHUNKS}, {_ASKED}, {_bm25('b', 'chunks', 'asked', 125)}"
_VECTOR = f"""{_BASE},
v_hits as (select * from (select *, row_number() over (partition by query_id, variant order by score desc, chunk_id) as rank from (select query_id, variant, c.chunk_id, round({cosine('e.embedding', 'q.vector')}, 9) as score from asked q, embeddings e join chunks c on e.vec_id = (c.document_id * 7 + c.chunk_index) % (select count(*) from embeddings))) where rank <= 125)"""
_FUSED = f"""{_VECTOR},
hits as (select query_id, chunk_id, (variant * 2 + src) * 1000000 + rank as ord, score * case when variant = 0 then 1.0::double else 0.9::double end as s, src from (select *, 0 as src from v_hits union all by name select *, 1 as src from b_hits)),
grouped as (select query_id, chunk_id, list({{'ord': ord, 's': s, 'src': src}} order by ord) as h from hits group by all),
fused as (select query_id, chunk_id, list_reduce(list_transform(h, lambda x: x.s), lambda a, x: least(1.0::double, a + x * 0.25::double)) as score, case when len(list_distinct(list_transform(h, lambda x: x.src))) > 1 then 'hybrid' when h[1].src = 0 then 'vector' else 'bm25' end as source, h[1].ord as ord from grouped)"""
_EXPANDED = f"""{_FUSED},
placed as (select *, row_number() over (partition by query_id order by score desc, ord) as position from fused),
base as (select p.*, c.document_id, c.chunk_index from placed p join chunks c using (chunk_id) where position <= 125),
near as (select b.query_id, c.chunk_id, b.score * 0.6::double as score, 1000000000 + b.position * 2 + case when o.d > 0 then 1 else 0 end as ord from base b, (values (-1), (1)) o(d) join chunks c on c.document_id = b.document_id and c.chunk_index = b.chunk_index + o.d),
firsts as (select query_id, chunk_id, arg_min(score, ord) as score, 'neighbor' as source, min(ord) as ord from near group by all),
expanded as (select query_id, chunk_id, score, source, ord from fused union all select f.query_id, f.chunk_id, f.score, f.source, f.ord from firsts f where not exists (select 1 from fused u where u.query_id = f.query_id and u.chunk_id = f.chunk_id))"""
_EXPANDED = _EXPANDED.replace("from base b, (values (-1), (1)) o(d) join chunks c on", "from (select * from base, (values (-1), (1)) o(d)) b join chunks c on").replace("case when o.d > 0", "case when b.d > 0").replace("b.chunk_index + o.d", "b.chunk_index + b.d")
_CANDIDATES = f"""{_EXPANDED},
numbered as (select e.*, c.document_id, row_number() over (partition by e.query_id order by e.score desc, e.ord) as position from expanded e join chunks c using (chunk_id)),
candidates as (select * from (select *, row_number() over (partition by query_id, document_id order by position) as own from numbered) where position <= 25 or own = 1),
gated as (select query_id, max(score) as best, avg(score) as avg, count(*) as n_hits, max(score) >= 0.30::double as answered from candidates group by query_id)"""
_RERANKED = f"""{_CANDIDATES},
asked0 as (select query_id, text as question, {tokens('text', False)} as qt from asked where variant = 0),
toks as (select c.query_id, c.chunk_id, c.position, c.score, c.source, k.document_id, k.page_num, k.filename, k.text, q.question, q.qt, {tokens('k.text', False)} as tt from candidates c join chunks k using (chunk_id) join asked0 q using (query_id)),
pairs as (select *, {bigrams('qt')} as qb, {bigrams('tt')} as tb from toks),
rated as (select *, round(least(score, 1.0::double) * 0.50::double + ({overlap('qt', 'tt')}) * 0.28::double + ({overlap('qb', 'tb')}) * 0.12::double + (case when contains(lower(text), lower(question)) then 0.15::double else 0.0::double end) * 0.10::double + (case when source = 'hybrid' then 0.05::double else 0.0::double end) * 0.05::double - (case when source = 'neighbor' then 0.05::double else 0.0::double end), 9) as rerank_score from pairs),
reranked as (select * from (select *, row_number() over (partition by query_id order by rerank_score desc, position) as rerank_rank from rated) where rerank_rank <= 5),
answered as (select r.* from reranked r join gated g using (query_id) where g.answered)"""
# three decimals of the exact binary value, halves to even, in whole numbers: a score is a multiple of 2^-70 here
_M = "(cast(abs(rerank_score) * 1180591620717411303424.0::double as hugeint) * 1000)"
_UNIT, _HALF = "1180591620717411303424::hugeint", "590295810358705651712::hugeint"
_EXACT = f"sign(rerank_score) * cast({_M} // {_UNIT} + case when {_M} % {_UNIT} > {_HALF} or ({_M} % {_UNIT} = {_HALF} and ({_M} // {_UNIT}) % 2 = 1) then 1 else 0 end as double) / 1000"
_RAW = f"replace({strip('text')}, chr(10), ' ')"
_SOURCES = f"""{_RERANKED},
picked as (select *, {_RAW} as raw from (select *, row_number() over (partition by query_id, document_id order by rerank_score desc, rerank_rank) as own from answered) where own = 1),
shown as (select *, {_EXACT} as relevance_score from picked),
sources as (select query_id, document_id as document, page_num as page, case when length(raw) > 150 then regexp_replace(left(raw, 150), ' [^ ]*$', '') || '…' else raw end as excerpt, raw as chunk_text, relevance_score, cast(row_number() over (partition by query_id order by relevance_score desc, rerank_rank) as int) as rank from shown)"""
_CONTEXT = f"""{_RERANKED},
multi as (select query_id, count(distinct nullif(filename, '')) > 1 as multi_doc from reranked group by query_id),
entries as (select query_id, rerank_rank, case when multi_doc and filename <> '' then '[' || filename || ' | ' else '[Excerpt ' || rerank_rank || ' | ' end || 'Page ' || page_num || ']' || chr(10) || text as entry from reranked join multi using (query_id)),
fits as (select * from (select *, sum(length(entry)) over (partition by query_id order by rerank_rank rows unbounded preceding) as used from entries) where used <= 12000),
contexts as (select query_id, coalesce(string_agg(f.entry, chr(10) || chr(10) order by f.rerank_rank), '') as context, count(f.entry) as n_entries from (select distinct query_id from reranked) left join fits f using (query_id) group by query_id)"""


def _history(most: int) -> str:
    total = lambda h: f"coalesce(list_sum(list_transform({h}, lambda t: length(t.content))), 0)"
    return f"""
h0 as (select conv_id, list({{'role': role, 'content': text}} order by turn, role, text) as history from conversations group by conv_id),
h1 as (select conv_id, case when len(history) > 4 then history[len(history) - 3:] else history end as h from h0),
h2 as (select conv_id, case when {total('h')} > {most} and len(h) >= 2 then h[3:] else h end as h from h1),
h3 as (select conv_id, case when {total('h')} > {most} and len(h) >= 2 then h[3:] else h end as h from h2)"""


def _prompts(plain: bool = False) -> str:
    """CTE ``texts`` of the prompts; the plain ones are of answered queries only, without history, language and channel."""
    rule = "case language " + " ".join(f"when {_q(k)} then {_q(v)}" for k, v in answering.LANGUAGES.items()) + f" else {_q(answering.ANY_LANGUAGE)} end"
    style = f"case when multi_doc then {_q(answering.STYLE_MANY)} else {_q(answering.STYLE_ONE)} end"
    head, tail = answering.QUESTION.split("{context}")
    mid, rest = tail.split("{question}")
    before, after = rest.split("{hint}")
    language, channel = ("null::varchar", "'web'") if plain else ("case query_id % 3 when 0 then 'en' when 1 then 'ru' end", "case when query_id % 5 = 0 then 'telegram' else 'web' end")
    known = "and query_id in (select query_id from answered)" if plain else ""
    past = "[]::struct(role varchar, content varchar)[]" if plain else "coalesce(h.h, [])"
    return f"""{_CONTEXT}, {_history(8000)},
rows0 as (select q.query_id, q.text as question, {language} as language, {channel} as channel from asked q where variant = 0 {known}),
rows1 as (select r.*, coalesce(m.multi_doc, false) as multi_doc, coalesce(c.context, {_q(answering.NO_CONTEXT)}) as context, {past} as h from rows0 r left join multi m using (query_id) left join contexts c using (query_id) left join h3 h on h.conv_id = r.query_id),
texts as (select *, case when channel = 'telegram' then replace({_q(answering.TELEGRAM)}, '{{language}}', {rule}) else replace(replace({_q(answering.SYSTEM)}, '{{style}}', {style}), '{{language}}', {rule}) || case when multi_doc then {_q(answering.MANY)} else '' end end as system, {_q(head)} || context || {_q(mid)} || question || {_q(before)} || case when multi_doc then {_q(answering.COMPARE_HINT)} else '' end || {_q(after)} as user_text from rows1),
said as (select query_id, h, length(system) + length(user_text) as n_chars, md5(array_to_string(list_concat(list_concat(['system|' || system], list_transform(h, lambda m: m.role || '|' || m.content)), ['user|' || user_text]), '##')) as digest from texts)"""


_ANSWERS = "answers as (select query_id, digest as answer, 'stub' as model, cast(n_chars // 4 as bigint) as prompt_tokens, 10::bigint as completion_tokens, cast(n_chars // 4 + 10 as bigint) as total_tokens from said)"
_HIGHLIGHT = lambda x: f"(case when contains({x}, ' ') and length(regexp_replace({x}, ' [^ ]*$', '')) > 40 then regexp_replace({x}, ' [^ ]*$', '') else {x} end)"


_TRIMMED = "trim(text)"


def _total(h: str) -> str:
    return f"coalesce(list_sum(list_transform({h}, lambda t: length(t.content))), 0)"


def _letter(x: str) -> str:
    return f"cast(length(text) - length(replace(text, '{x}', '')) as double) as {x}"


def _round(c: str) -> str:
    return f"round({c}, 6) as {c}"


def oracle_sql() -> dict[str, str]:
    docs_bm25 = _bm25("d", "(select doc_id as chunk_id, text, doc_id as document_id, 0 as chunk_index, source as folder from documents)", "none", 1)
    docs_bm25 = docs_bm25[: docs_bm25.index("\nd_a as")].rstrip().rstrip(",")
    left = _bm25("b", "(select * from chunks where document_id % 10 <> 3)", "none", 1)
    left = left[: left.index("\nb_a as")].rstrip().rstrip(",")
    line = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    registry = f"with {_CHUNKS}, registry as (select document_id, arg_min(filename, page_num * 1000000 + chunk_index) as filename, arg_min(folder, page_num * 1000000 + chunk_index) as folder, max(page_num) as pages, count(*) as chunks from chunks group by document_id)"
    status = "select doc_id, md5(text) as hash, case when row_number() over (partition by md5(text) order by doc_id) = 1 then 'indexed' else 'skipped' end as status from documents"
    sql = {
        "ingest_dedup_md5": status,
        "batch_status_summary": f"select count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'error') as errors, count(*) as total from ({status})",
        "batch_outcomes": f"with {_CHUNKS}, n as (select document_id, count(*) as made from chunks group by document_id), f as (select coalesce(source, '') || '/doc_' || doc_id || case when doc_id % 7 = 0 then '.txt' else '.pdf' end as path, md5(text) as hash, made, case when doc_id % 7 = 0 then 'Only PDF files supported' when made is null then 'Could not extract text' end as error, case when doc_id % 7 <> 0 then 1 else 0 end as pages from documents left join n on doc_id = document_id), o as (select *, min(path) filter (error is null) over (partition by hash) as first from f) select path, case when error is not null then 'error' when path = first then 'indexed' else 'skipped' end as status, error, cast(pages as int) as pages, case when error is null and path = first then made else 0 end as chunks_created from o",
        "ocr_flag_pages": f"select coalesce(source, '') as folder, count(*) as n_pages, count(*) filter (length({strip('text')}) < 50) as n_ocr, count(*) filter ({strip('text')} = '') as n_empty from documents group by 1",
        "normalize_sentences": f"select doc_id, cast(length({norm('text')}) as int) as n_norm, cast(len({sentences('text')}) as int) as n_sentences, md5(array_to_string({sentences('text')}, '|')) as digest from documents",
        "chunk_documents": f"with {_CHUNKS} select chunk_id, document_id, page_num, chunk_index, cast(length(text) as int) as char_count, md5(text) as digest, folder from chunks",
        "chunk_multi_page": f"with {_chunk_ctes('chunks', _CONV)} select chunk_id, document_id, page_num, chunk_index, cast(length(text) as int) as char_count, md5(text) as digest from chunks",
        "empty_extraction": f"with {_CHUNKS} select doc_id as document_id from documents where doc_id not in (select document_id from chunks)",
        "tokenize_terms": f"select doc_id, cast(len({tokens('text')}) as int) as n_tokens, md5(array_to_string({tokens('text')}, ' ')) as digest from documents",
        "postings": f"with {docs_bm25} select chunk_id, term, tf from d_p",
        "doc_lengths": f"with {docs_bm25} select chunk_id, dl from d_l",
        "term_stats": f"with {docs_bm25} select term, df, {_round('idf')} from d_i",
        "bm25_topk": f"{_BASE} select query_id, cast(variant as int) as variant, chunk_id, cast(rank as int) as rank, {_round('score')} from b_hits",
        "bm25_folder_topk": f"with {_CHUNKS}, {_ASKED}, scoped as (select query_id, variant, text, 'src' || (query_id % 20) as folder from asked where variant = 0), {_bm25('b', 'chunks', 'scoped', 30, True)} select query_id, chunk_id, cast(rank as int) as rank, {_round('score')} from b_hits",
        "cosine_topk": f"select query_id, vec_id, cast(rank as int) as rank, {_round('score')} from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, round({cosine('q.embedding', 'e.embedding')}, 9) as score from embeddings q, embeddings e where q.vec_id % 50 = 0)) where rank <= 30",
        "lexical_segments": f"with {_CHUNKS}, none as (select 0 as query_id, 0 as variant, '' as text), {left} select term, df, {_round('idf')} from b_i",
        "bm25_segments": f"with {_CHUNKS}, {_ASKED}, scoped as (select query_id, variant, text from asked where variant = 0), {_bm25('b', '(select * from chunks where document_id % 10 <> 3)', 'scoped', 30)} select query_id, chunk_id, cast(rank as int) as rank, {_round('score')} from b_hits",
        "cosine_folder_topk": f"select query_id, vec_id, cast(rank as int) as rank, {_round('score')} from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, round({cosine('q.embedding', 'e.embedding')}, 9) as score from embeddings q join embeddings e using (label) where q.vec_id % 50 = 0)) where rank <= 30",
        "fuse_single": f"{_VECTOR}, v0 as (select * from v_hits where variant = 0), b0 as (select * from b_hits where variant = 0) select coalesce(v.query_id, b.query_id) as query_id, coalesce(v.chunk_id, b.chunk_id) as chunk_id, round(case when v.score is not null and b.score is not null then (v.score + b.score) / 2 + 0.05::double else coalesce(v.score, b.score) end, 6) as score, case when v.score is not null and b.score is not null then 'hybrid' when v.score is not null then 'vector' else 'bm25' end as source, coalesce(v.rank, b.rank + 1000000) as ord from v0 v full join b0 b on v.query_id = b.query_id and v.chunk_id = b.chunk_id",
        "fuse_multi_variant": f"{_FUSED} select query_id, chunk_id, {_round('score')}, source, ord from fused",
        "neighbor_expand": f"{_EXPANDED} select query_id, chunk_id, {_round('score')}, source, ord from expanded",
        "doc_guarantee": f"{_CANDIDATES} select query_id, chunk_id, {_round('score')}, source, cast(position as int) as position from candidates",
        "relevance_gate": f"{_CANDIDATES} select query_id, {_round('best')}, {_round('avg')}, n_hits, answered from gated",
        "lexical_rerank": f"{_RERANKED} select query_id, chunk_id, cast(rerank_rank as int) as rerank_rank, {_round('rerank_score')} from reranked",
        "rerank_language_fallback": f"{_CANDIDATES}, m as (select *, case when query_id % 3 = 0 then -10.0::double - position * 0.001::double else score * 4 - 6 end as model from candidates), s as (select *, round(case when max(model) over (partition by query_id) < -5 then score else model end, 9) as rerank_score from m) select query_id, chunk_id, cast(rerank_rank as int) as rerank_rank, {_round('rerank_score')} from (select *, row_number() over (partition by query_id order by rerank_score desc, position) as rerank_rank from s) where rerank_rank <= 5",
        "sources_per_document": f"{_SOURCES} select * from sources",
        "end_to_end_retrieve": f"{_SOURCES} select query_id, document, excerpt, 'doc_' || document as name, cast(cast(floor(relevance_score * 100 + 0.5) as bigint) as varchar) || '%' as percent from sources",
        "highlight_anchor": f"select item_id, case when contains(a, ' ') and length(regexp_replace(a, ' [^ ]*$', '')) > 40 then regexp_replace(a, ' [^ ]*$', '') else a end as anchor, left(text, 100) as preview from (select item_id, text, left({strip('text')}, 120) as a from benchmark)",
        "multi_doc_mode": f"{_CONTEXT} select * from multi",
        "context_budget": f"{_CONTEXT} select query_id, cast(n_entries as int) as n_entries, cast(length(context) as int) as n_chars, md5(context) as digest from contexts",
        "history_trim": f"with {_history(1500)} select conv_id, cast(len(h) as int) as n_turns, array_to_string(list_transform(h, lambda x: x.role || ':' || length(x.content)), ',') as turns from h3",
        "chat_questions": f"""with t as (select cast(conv_id as varchar) as chat_id, turn, role, {_TRIMMED} as text from conversations where {_TRIMMED} <> '' and not starts_with({_TRIMMED}, '/')), p as (select *, coalesce(list({{'role': role, 'content': text}}) over (partition by chat_id order by turn, role, text rows between 4 preceding and 1 preceding), []) as h0 from t), h1 as (select *, case when {_total('h0')} > 8000 and len(h0) >= 2 then h0[3:] else h0 end as h1 from p), h2 as (select *, case when {_total('h1')} > 8000 and len(h1) >= 2 then h1[3:] else h1 end as h2 from h1) select chat_id, 0 as day, md5(text) as asked, cast(len(h2) as int) as n_turns, md5(coalesce(array_to_string(list_transform(h2, lambda x: x.role || ':' || x.content), '##'), '')) as digest from h2 where role = 'user'""",
        "vectors_upserted": "select vec_id, case when vec_id % 10 = 4 then 99 else label end as label, round(case when vec_id % 10 = 4 then -1 else 1 end * list_sum(embedding::double[]), 6) as total from embeddings where vec_id % 7 <> 3",
        "embed_chunks": f"with {_CHUNKS}, n as (select chunk_id, {_letter('a')}, {_letter('b')}, {_letter('c')} from chunks), m as (select *, case when a + b + c > 0 then sqrt(a * a + b * b + c * c) else 1 end as n from n) select chunk_id, round(a / n, 6) as a, round(b / n, 6) as b, round(c / n, 6) as c, null::varchar as error from m",
        "prompt_messages": f"{_prompts()} select query_id, cast(len(h) + 2 as int) as n_messages, digest from said",
        "llm_answer_stub": f"{_prompts(True)}, {_ANSWERS} select * from answers",
        "answer_responses": f"{_prompts(True)}, {_ANSWERS} select b.item_id as query_id, case when g.best is null then 'empty' when g.best >= 0.9 then 'answered' else 'refused' end as status, case when g.best is null then {_q('No relevant information found in the knowledge base.')} when g.best >= 0.9 then a.answer else {_q("I couldn't find relevant information in the knowledge base to answer this question.")} end as answer, cast(case when g.best >= 0.9 then a.total_tokens else 0 end as bigint) as total_tokens from benchmark b left join gated g on g.query_id = b.item_id left join answers a on a.query_id = b.item_id",
        "highlight_offsets": f"with {_CHUNKS}, a as (select chunk_id, document_id, left({strip('text')}, 120) as a from chunks), n as (select chunk_id, document_id, {_HIGHLIGHT('a')} as anchor from a) select chunk_id, cast(instr(lower({norm('d.text')}), lower({norm('anchor')})) - 1 as int) as at, cast(length(anchor) as int) as n_chars from n join documents d on d.doc_id = n.document_id",
        "bm25_document_filter": f"with {_CHUNKS}, {_ASKED}, scoped as (select query_id, variant, text, case when query_id % 2 = 0 then query_id end as document from asked where variant = 0), {_bm25('b', 'chunks', 'scoped', 30, scope='where a.document is null or a.document = c.document_id')} select query_id, chunk_id, cast(rank as int) as rank, {_round('score')} from b_hits",
        "expand_short_query": f"with w as (select item_id, string_split({norm('text')}, ' ') as w from benchmark), r as (select item_id, w, item_id % 4 + 1 as n, unnest(range(0, len(w), item_id % 4 + 1)) as b from w), q as (select item_id, cast(b // n as int) as part, array_to_string(w[b + 1:b + n], ' ') as question from r) select item_id, part, question, len(list_filter(string_split({norm('question')}, ' '), lambda x: x <> '')) <= 2 as short from q",
        "variant_dedup": f"with a as (select item_id, string_split({norm('text')}, ' ') as w from benchmark), b as (select item_id, w, unnest(range(0, len(w), 16)) as b from a), w as (select item_id || ':' || (b // 16) as query_id, w[b + 1:b + 16] as w from b), q as (select query_id, {line(1, 4)} as question, [{line(5, 8)}, translate({line(1, 4)}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), lower({line(5, 8)}), {line(9, 12)}] as lines from w), u as (select query_id, question, unnest(list_concat([{{'pos': 0, 'text': question}}], case when len(string_split(question, ' ')) <= 2 then [] else list_transform(list_filter([{{'pos': 1, 'raw': '1. ' || lines[1], 'text': lines[1]}}, {{'pos': 2, 'raw': '- ' || lines[2], 'text': lines[2]}}, {{'pos': 3, 'raw': '2) ' || lines[3], 'text': lines[3]}}, {{'pos': 4, 'raw': lines[4], 'text': lines[4]}}], lambda x: length(x.raw) > 3), lambda x: {{'pos': x.pos, 'text': regexp_replace(x.text, '^[0-9.\\-) ]+', '')}}) end)) as x from q), f as (select query_id, x.pos as pos, x.text as text from u where x.pos = 0 or (lower(x.text) <> lower(question) and length(x.text) > 3)), o as (select *, row_number() over (partition by query_id, lower(text) order by pos) as own from f) select * from (select query_id, cast(row_number() over (partition by query_id order by pos) - 1 as int) as variant, text from o where own = 1) where variant < 5",
        "registry_rollup": f"{registry} select * from registry",
        "folder_list": "select name, cast(row_number() over (order by name) as int) as place from (select distinct name from (select source as name from documents union all select unnest(['Archive', 'src1'])) where name is not null and name <> '')",
        "folder_rename": "select case when coalesce(source, '') = 'src1' then 'renamed' else coalesce(source, '') end as folder, count(*) as n_docs from documents group by 1",
        "folder_registry": "select distinct name from (select coalesce(source, '') as name from documents union all select unnest(['Archive', 'New']))",
        "document_move": "select doc_id as document_id, case when doc_id = 7 then 'moved' else coalesce(source, '') end as folder from documents",
        "doc_delete": f"with {_CHUNKS} select folder, count(*) as n_chunks, count(distinct document_id) as n_docs from chunks where document_id % 10 <> 3 group by folder",
        "folder_tree": f"{registry}, t as (select case when folder in ('', 'src3') then 'Uncategorized' else folder end as folder, 1 as d, chunks from registry union all select unnest(['Empty', 'src1']), 0, 0), g as (select folder, cast(sum(d) as bigint) as n_docs, cast(sum(chunks) as bigint) as n_chunks from t group by folder) select folder, n_docs, n_chunks, cast(row_number() over (order by folder = 'Uncategorized', folder) as int) as place from g",
        "compare_candidates": f"{registry} select folder, string_agg(filename, ', ' order by filename) as names, count(*) as n_docs, count(*) * 4 as top_k from registry where filename <> '' group by folder having count(*) >= 2",
        "upload_folders": "select doc_id, case when doc_id % 2 = 0 then source || ' / deep' else source end as folder, 'doc_' || doc_id || '.PDF' as name from documents where doc_id % 7 <> 0",
        "cjk_strip": "select doc_id, regexp_replace('東京、' || text || '。ＡＢ', '[\\x{3000}-\\x{9fff}\\x{f900}-\\x{faff}\\x{fe30}-\\x{fe4f}\\x{ff00}-\\x{ffef}]', '', 'g') as clean from documents",
        "filename_shorten": "select page_id, case when length(n) > 22 then left(n, 20) || '...' else n end as short from (select page_id, regexp_replace(regexp_replace(url, '^https?://', '') || case when page_id % 2 = 0 then '.pdf' else '' end, '(?i)\\.pdf$', '') as n from pages)",
        "snapshot_retention": "select event_id from events where ts >= timestamp '2024-01-30 00:00:00' - interval 7 day",
    }
    # an exact search gives the same rows however the vectors are laid out
    return sql | {"cosine_cells_exact": sql["cosine_topk"]}
