"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LETTERS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP5 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) s from d where len(w) >= 50),
h as (select doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) k from p),
f as (select k, min(doc_id) least from h group by k),
g as (select distinct doc_id, unnest(range(s, s + 50)) i from h join f using (k) where doc_id > least),
r as (select doc_id, list(i) gone from g group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(gone), 0) as bigint) n_removed,
 sha256(array_to_string(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), ' ')) kept_sha256
from d left join r using (doc_id)
"""

OP10 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all({_LOWER}, {_ALNUM}) v from benchmark where text is not null),
bw as (select distinct item, s place, least(len(v), 10) n, array_to_string(v[s:s + least(len(v), 10) - 1], ' ') k
 from (select item, v, unnest(range(1, len(v) - least(len(v), 10) + 2)) s from b where len(v) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') k
 from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, sizes where len(w) >= n)),
m as (select doc_id, s, place, dw.n, item from dw join bw using (n, k)),
runs as (select doc_id, item, s - place diagonal, s - row_number() over (partition by doc_id, item, s - place order by s) run, n from m),
longest as (select doc_id, max(size) longest from (select doc_id, count(*) + any_value(n) - 1 size from runs group by doc_id, item, diagonal, run) group by doc_id),
covered as (select distinct doc_id, unnest(range(s, s + n)) i from m),
islands as (select doc_id, min(i) - 1 b, max(i) e, count(*) size from (select doc_id, i, i - row_number() over (partition by doc_id order by i) island from covered) group by doc_id, island),
hit as (select doc_id, sum(size) n_hit, string_agg(b || ':' || e, ',' order by b) places from islands group by doc_id),
its as (select doc_id, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') items from m group by doc_id)
select d.doc_id, cast(coalesce(len(w), 0) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
 sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, cast(coalesce(longest, 0) as bigint) longest_match, coalesce(places, '') places
from d left join hit using (doc_id) left join its using (doc_id) left join longest using (doc_id)
"""

#: Prefix filter of one word, by exact counts: the query's own prefix is another.
OP6 = f"""
with l as (select doc_id, unnest(range(len(s))) line, unnest(s) t from (select doc_id, string_split(text, chr(10)) s from documents where text is not null and doc_id is not null)),
w as (select doc_id, line, list_sort(list_distinct(regexp_extract_all(t, {_SPACED}))) w from l),
sets as (select w, len(w) n, min(struct_pack(d := doc_id, l := line)) spot, count(*) copies from w where len(w) > 0 group by w),
one as (select spot, n, unnest(w) word from sets),
df as (select word, count(*) df from one group by word),
ranked as (select spot, n, word, row_number() over (partition by spot order by df, word) place from one join df using (word)),
pre as (select * from ranked where place <= n - ceil(0.8 * n - 1e-9) + 1),
pairs as (select distinct a.spot a, b.spot b from pre a join pre b on a.word = b.word and a.spot < b.spot and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
later as (select distinct b from (select b, len(list_intersect(x.w, y.w)) s, x.n xn, y.n yn from pairs join sets x on x.spot = a join sets y on y.spot = b) where s >= 0.8 * (xn + yn - s) - 1e-9)
select doc_id, cast(line as integer) line, cast(n as bigint) n_words, spot.d first_doc, cast(spot.l as integer) first_line, copies n_copies,
 doc_id <> spot.d or line <> spot.l or b is not null removed
from w join sets using (w) left join later on later.b = spot
"""

OP11 = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') norm from documents),
g as (select norm, min(doc_id) keep_id, count(*) group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(norm) text_sha256 from n join g using (norm)
"""

OP13 = f"""
with w as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_LETTERS})) term from documents),
kept as (select lang, term from w group by lang, term having count(distinct doc_id) >= 10),
v as (select lang, count(*) v from kept group by lang),
c as (select lang, source, term, count(*) n from w join kept using (lang, term) group by lang, source, term),
g as (select distinct coalesce(lang, '') lang, coalesce(source, '') source from documents),
t as (select lang, source, coalesce(total, 0) total, coalesce(v, 0) v from g left join (select lang, source, sum(n) total from c group by lang, source) using (lang, source) left join v using (lang)),
p as (select lang, source, term, cast(1 + (1000000000 * (coalesce(n, 0) + 2)::hugeint) // (total + 2 * v) as bigint) p, coalesce(n, 0) n from t join kept using (lang) left join c using (lang, source, term)),
l as (select lang, term, cast(1 + (1000000000 * (sum(n) + 2)::hugeint) // (any_value(total) + 2 * any_value(v)) as bigint) q
 from c join (select lang, sum(total) total, any_value(v) v from t group by lang) using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source item, 'pair' part, cast(coalesce(f, 0) as bigint) "value" from g a join g b on a.lang = b.lang and a.source <> b.source
 left join (select x.lang x_lang, x.source s, y.source t, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by x.lang, x.source, y.source) on x_lang = a.lang and s = a.source and t = b.source),
terms as (select lang, source, term item, 'term' part, ((p - q) * (p - q)) // (p + q) "value" from p join l using (lang, term) where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by "value" desc, item) as integer) rank from (select * from pairs union all select * from terms))
select lang, source, part, item, "value", rank from ranked where part = 'pair' or rank <= 10
"""

ORACLES = {"op6_lines": OP6, "op5_substring": OP5, "op10_decontamination": OP10, "op11_exact": OP11, "op13_divergence": OP13}
