"""Oracle SQL (DuckDB) of the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

from sweepline.llm.chat_format import Template
from sweepline.llm.license_texts import DIGESTS, LICENSES, TITLES
from sweepline.llm.licenses import COPYRIGHT_LINE, NOTICE, SPELLINGS
from sweepline.llm.url_filter import RULES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# ---- chat format ---------------------------------------------------------------------------------------------


def chat(extra: str, t: Template = Template()) -> str:
    """Marks: a backslash for each backslash, for each place where ### begins, and for each </turn>."""
    marks = len(t.open) + len(t.close) + len(t.end)
    escapes = r"""(length(text) - length(replace(text, '\', ''))) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) + (length(text) - length(replace(text, '</turn>', ''))) / 7"""
    return f"""with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -7, 0, 'user', {quoted(extra)} union all select -7, 1, 'assistant', {quoted(extra)}),
 g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) whole, coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') loss,
  string_agg(role, ',' order by turn nulls first, role, text) roles, sum({marks} + length(role) + length(text) + {escapes}) chars from t group by conv_id)
 select conv_id, n_turns, sha256(whole) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, chars::bigint formatted_chars, regexp_matches(roles, '^(system,)?user,assistant(,user,assistant)*$') valid from g"""


# ---- URL filters ---------------------------------------------------------------------------------------------


def host_path(url: str) -> str:
    rest = f"case when contains({url}, '://') then substr({url}, position('://' in {url}) + 3) else '' end"
    return f"lower(regexp_extract({rest}, '^[^/?#]*')) host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) path"


def spelled(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^[^:/?#]+://(.*)$', 1)"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return f"""case when regexp_extract({url}, '^([^:/?#]+)://', 1) <> '' then lower(regexp_extract({url}, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract({rest}, '^[^/?#]*')) || case when {path} = '' then '/' else {path} end || regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1) end"""


def urls() -> str:
    """Links without dot segments; reachability by a recursive query."""
    attribute = lambda tag, name: f"regexp_extract({tag}, '(?is)\\b{name}\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)"
    origin, path = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)", "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
    best = "(select {0} from rules r where (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p) order by length(r.h || r.p) desc, length(r.h) desc, r.v limit 1)"
    return f"""with recursive rules(h, p, v) as (values {values(RULES)}),
 tags as (select url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]*>')) tag from pages where url is not null),
 links as (select url, case when regexp_matches(tag, '(?is)^<link') and regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?[^"'']*\\bcanonical\\b') then {attribute('tag', 'href')} when regexp_matches(tag, '(?is)^<meta') and regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') then {attribute('tag', 'url')} end link from tags),
 whole as (select url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') or {origin} = '' then null when starts_with(link, '//') then regexp_extract(url, '^([^:/?#]+:)//', 1) || link
   when starts_with(link, '/') then {origin} || link when starts_with(link, '?') or starts_with(link, '#') then {origin} || {path} || link else {origin} || regexp_extract({path}, '^(.*)/[^/]*$', 1) || '/' || link end target from (select url, replace(link, '&amp;', '&') link from links where link <> '')),
 edges as (select {spelled('url')} a, {spelled('target')} b from whole), e2 as (select a, b from edges where a is not null and b is not null and a <> b union select b, a from edges where a is not null and b is not null and a <> b),
 reach(a, b) as (select a, b from e2 union select r.a, e2.b from reach r join e2 on e2.a = r.b),
 nodes as (select a, b, {host_path('b')} from (select a, b from reach union select a, a from e2)), spread as (select a node, min({best.format('r.v')}) verdict from nodes group by a),
 judged as (select page_id, url, {spelled('url')} node, {host_path("coalesce(url, '')")} from pages)
 select page_id, host, path, {best.format('r.h || r.p')} as rule, coalesce({best.format('r.v')}, spread.verdict, 'allow') verdict from judged left join spread using (node)"""


# ---- licences ------------------------------------------------------------------------------------------------


def canonical_lines(text: str) -> str:
    out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    for pattern, one in SPELLINGS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(one)}, 'g')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def canonical(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '\\s+', ' ', 'g'), ' ')"


def pieces(lines: str) -> str:
    return f"list_filter(list_transform(string_split_regex({lines}, '\\n\\s*\\n'), lambda x: {canonical('x')}), lambda x: x <> '')"


def licenses() -> str:
    titles = [(k, t) for k, of in sorted(TITLES.items()) for t in (k, *of)]
    return f"""with raw(license, text) as (values {values(sorted(LICENSES.items()))}), rp as (select license, {pieces(canonical_lines('text'))} p from raw),
 k0 as (select license, len(p) k, sha256(p[1]) head, sha256(array_to_string(p, ' ')) digest from rp union all select * from (values {values(DIGESTS)}) d(license, k, head, digest)),
 k1 as (select license, k, head, digest from k0 union all select license, 1, digest, digest from k0), known as (select k, head, digest, min(license) license from k1 group by all), texts as (select digest, min(license) license from known group by digest),
 ti(license, title) as (values {values(titles)}), titles as (select sha256(regexp_replace({canonical(canonical_lines('title'))}, ' license$', '')) digest, min(license) license from ti group by all),
 d as (select row_number() over () n, doc_id, {canonical_lines("coalesce(text, '')")} lines from documents), p as (select n, doc_id, lines, {pieces('lines')} pieces from d),
 q as (select n, doc_id, case when len(pieces) > 0 then sha256(array_to_string(pieces, ' ')) end digest from p),
 heads as (select n, pieces, i, sha256(pieces[i]) head from (select n, pieces, unnest(range(1, len(pieces) + 1)) i from p)),
 found as (select n, array_to_string(list_sort(list_distinct(list(license))), ',') parts from heads h join known using (head) where sha256(array_to_string(pieces[i : i + k - 1], ' ')) = known.digest group by n),
 l as (select n, {canonical('line')} line from (select n, unnest(string_split(lines, chr(10))) line from d)), t as (select n, sha256(regexp_replace(regexp_replace(line, {quoted(NOTICE)}, ''), ' license$', '')) digest from l where regexp_matches(line, {quoted(NOTICE)})),
 noticed as (select n, array_to_string(list_sort(list_distinct(list(license))), ',') notices from t join titles using (digest) group by n)
 select doc_id, q.digest, texts.license, coalesce(parts, '') parts, coalesce(notices, '') notices from q left join texts on texts.digest = q.digest left join found using (n) left join noticed using (n)"""


# ---- conversation trie, hard negatives, embeddings ------------------------------------------------------------


def trie() -> str:
    """Every prefix as a list of its turns' digests, members and subtrees by joins over all prefixes."""
    shift = "list_reduce(list_prepend(xor(c, b) & 255, range(8)::bigint[]), lambda r, k: xor(r >> 1, case when r % 2 = 1 then 3988292384 else 0 end))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, {shift})))"
    return f"""with recursive t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) i, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
 h as (select c, {crc} % 4 h from (select distinct c from t)),
 u as (select h.c, t.i, t.r, t.x from h join t on t.c = h.c - h.c % 20 and t.i <= h.h union all select h.c, t.i, t.r, t.x from h join t using (c) where t.i > h.h),
 v as (select c, row_number() over (partition by c order by i) d, sha256(length(r) || ':' || r || x) y, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) w from u),
 l as (select h.c, count(d) n from h left join v using (c) group by h.c),
 m as (select c, d, list(y) over (partition by c order by d) p, w from v union all select c, 0, []::varchar[], 0 from h),
 k as (select p, any_value(d) d, min(m.c) c, count(*) n, any_value(w) w, sha256(coalesce(string_agg(m.c::varchar, ',' order by m.c) filter (l.n = d), '')) e from m join l on l.c = m.c group by p),
 g as (select p[:d - 1] p, count(*) kids from k where d > 0 group by 1),
 s as (select k.p[:a.a] p, sum((n - 1) * w) saved, count(*) filter (g.p is null) leaves from k left join g on g.p = k.p, lateral (select unnest(range(d + 1)) a) a group by 1)
 select k.c conv_id, k.d depth, above.c parent_conv_id, k.n n_convs, coalesce(g.kids, 0) n_children, s.leaves n_leaves, s.saved::bigint saved_tokens, k.e ends_sha256
 from k join s on s.p = k.p left join g on g.p = k.p left join k above on k.d > 0 and above.p = k.p[:k.d - 1]"""


def negatives() -> str:
    return """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding::double[], lambda x: floor(256 * x)) q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id a, a.l al, b.vec_id b, b.l bl, list_dot_product(a.q, b.q)::bigint s from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select a, b, s from s where al = bl qualify row_number() over (partition by a order by s desc, b) <= 5)
 select p.a anchor_id, p.b positive_id, row_number() over (partition by p.a, p.b order by s.s desc, s.b)::int rank, s.b negative_id, p.s positive_score, s.s negative_score
 from p join s on s.a = p.a and s.al <> s.bl and 80 * p.s <= 100 * s.s and 100 * s.s <= 100 * p.s qualify rank <= 5"""


def embedding_groups() -> str:
    return """with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.93 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
 r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on l.a = r.b)
 select vec_id, coalesce(n, 0) n_links, c component_id, vec_id = c kept from embeddings join (select a, min(b) c from r group by a) on a = vec_id left join (select a x, count(*) n from l group by a) on x = vec_id"""
