"""SQL answers of the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = rf"""
with words as (
  select 'd' as kind, doc_id as id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
  union all
  select 'b', item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  from benchmark
),
windows as (
  select id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as gram
  from words, unnest(range(1, len(w) - least(13, len(w)) + 2)) as r(i)
  where kind = 'b' and len(w) > 0
),
lengths as (select distinct n from windows),
grams as (
  select id, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
  from words, lengths, unnest(range(1, len(w) - n + 2)) as r(i)
  where kind = 'd' and len(w) >= n
),
hits as (
  select g.id, g.n, g.i, b.id as item_id from grams g join (select distinct * from windows) b on g.n = b.n and g.gram = b.gram
),
spots as (
  select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from (select distinct id, n, i from hits)) group by id
),
found as (
  select id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct id, item_id from hits) group by id
)
select d.id as doc_id, len(d.w)::bigint as n_words, coalesce(s.n_hit, 0)::bigint as n_hit,
       coalesce(f.n_items, 0)::bigint as n_items, sha256(coalesce(f.ids, '')) as items_sha256,
       coalesce(s.n_hit, 0) > 0 and 20 * coalesce(s.n_hit, 0) >= len(d.w) as contaminated
from words d left join spots s on s.id = d.id left join found f on f.id = d.id
where d.kind = 'd'
"""

BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = f"""
with lines as (
  select doc_id, i, lines[i] as line, translate(trim(lines[i], {BLANKS}), '{UPPER}', '{LOWER}') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), unnest(range(1, len(lines) + 1)) as r(i)
),
often as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select l.*, o.key is not null as gone from lines l left join often o on l.key = o.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP6 = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
    on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9
),
reach(vec_id, other) as (
  select vec_id, vec_id from embeddings
  union
  select r.vec_id, l.b from reach r join links l on r.other = l.a
),
roots as (select vec_id, min(other) as component_id from reach group by vec_id),
counts as (select a as vec_id, count(*) as n from links group by a)
select r.vec_id, coalesce(c.n, 0)::bigint as n_links, r.component_id, r.vec_id = r.component_id as kept
from roots r left join counts c on c.vec_id = r.vec_id
"""

OP8 = """
with hashed as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages
),
nibbles as (
  select *, [instr('0123456789abcdef', substr(h, i, 1)) - 1 for i in range(1, 41)] as x,
         min(page_id) over (partition by h) as first_id
  from hashed
)
select page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((16 * x[(5 * k) // 4 + 1] + x[(5 * k) // 4 + 2]) >> (3 - (5 * k) % 4)) & 31), 1) for k in range(0, 32)], '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to, cast(null as varchar) as error
from nibbles
"""



def _crc_of_nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


_NIBBLES = [_crc_of_nibble(c) for c in range(16)]


def _crc_step(c: str) -> str:
    return f"xor(({c}) >> 4, {_NIBBLES}[(({c}) & 15) + 1])"


OP13 = rf"""
with recursive runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run
  from documents
),
counted as (select doc_id, run, count(*) as n, hex(encode(doc_id::varchar || ':' || run)) as bytes from runs group by doc_id, run),
hashed as (
  select run, n, xor(4294967295, list_reduce(
    [4294967295] || [('0x' || substr(bytes, 2 * i - 1, 2))::bigint for i in range(1, len(bytes) // 2 + 1)],
    lambda c, x: {_crc_step(_crc_step("xor(c, x)"))})) as h
  from counted
),
noisy as (
  select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n
  from hashed
),
words as (select word, sum(n)::bigint as n from noisy group by word having length(word) >= 5 and sum(n) >= 3),
cuts as (select distinct word, n, i, substr(word, 1, i - 1) as head, substr(word, i + 1) as tail from words, unnest(range(1, length(word) + 1)) as r(i)),
pairs as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union
  select a.word, b.word, b.n from cuts a join words b on a.head || a.tail = b.word
  union
  select b.word, a.word, a.n from cuts a join words b on a.head || a.tail = b.word
),
best as (
  select word, count(*) as n_near, max(other_n) as most, min(other) filter (where other_n = top) as other
  from (select *, max(other_n) over (partition by word) as top from pairs) group by word
),
formed as (
  select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near,
         case when b.most >= 2 * w.n then b.other end as form, case when b.most >= 2 * w.n then b.most end as form_n
  from words w left join best b on b.word = w.word
),
chain(word, node) as (
  select word, word from formed
  union
  select c.word, f.form from chain c join formed f on f.word = c.node where f.form is not null
),
roots as (select c.word, c.node as root from chain c join formed f on f.word = c.node where f.form is null)
select f.word, f.n, f.n_near, f.form, f.form_n, r.root from formed f join roots r on r.word = f.word
"""

ORACLE = {
    "op1_decontamination": OP1,
    "op5_line_dedup": OP5,
    "op6_embedding_dedup": OP6,
    "op8_warc": OP8,
    "op13_spelling_variants": OP13,
}
