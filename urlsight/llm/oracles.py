"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
with rows as (
  select doc_id, coalesce(text, '') as text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from rows
window w as (partition by norm order by length(text) desc, doc_id)
"""

WEIGHTED_MIX = r"""
with rows as (
  select doc_id, source, md5(concat('0:', coalesce(cast(doc_id as varchar), ''))) as draw,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
sized as (select source, sum(size)::bigint as source_size from rows group by source),
placed as (
  select *, row_number() over (order by encode(source) nulls last) as place from sized),
weighed as (
  select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from placed),
levels as (
  select *, (3 * source_size)::double as cap,
         ((sum(source_size) over () - coalesce(sum(3 * source_size) over (
             order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0))::double
          / sum(weight) over (order by source_size / weight, place rows between current row and unbounded following)
         ) as level,
         row_number() over (order by source_size / weight, place) as turn
  from weighed),
targets as (
  select l.source, l.place, l.source_size, least(l.cap, s.level * l.weight) as target
  from levels l, (select min_by(level, turn) as level from levels where level * weight <= cap) s),
queued as (
  select r.*, t.place, t.source_size, t.target,
         sum(r.size) over (partition by t.place order by r.draw, r.doc_id, r.size
                           rows between unbounded preceding and current row)::bigint as upto
  from rows r join targets t on r.source is not distinct from t.source),
timed as (
  select q.*, p.pass, ((p.pass * q.source_size + q.upto)::double / q.target) as finish
  from queued q, (select unnest([0, 1, 2])::bigint as pass) p
  where q.target > 0 and p.pass * q.source_size + q.upto - q.size < q.target),
positions as (
  select *, sum(size) over (order by finish, place, draw, doc_id, pass, size
                            rows between unbounded preceding and current row) as position
  from timed),
times as (
  select doc_id, draw, place, count(*) as times from positions
  where position <= (select sum(size) from rows) group by doc_id, draw, place)
select q.doc_id, q.size, q.source_size, q.target, coalesce(t.times, 0) * q.size as taken
from queued q left join times t on q.doc_id = t.doc_id and q.place = t.place
"""

BLOCK_DEDUP = r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
words as (
  select doc_id, words, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) as pos from texts),
windows as (
  select doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 49), ' ')) as content
  from words where pos + 49 <= n),
repeated as (
  select doc_id, pos from (
    select doc_id, pos, min(doc_id) over (partition by content) as least from windows) where least < doc_id),
marked as (
  select w.doc_id, w.word, w.pos,
         max(case when r.pos is not null then 1 else 0 end) over (
           partition by w.doc_id order by w.pos rows between 49 preceding and current row) as removed
  from words w left join repeated r on w.doc_id = r.doc_id and w.pos = r.pos),
kept as (
  select doc_id, sum(removed)::bigint as n_removed,
         coalesce(string_agg(word, ' ' order by pos) filter (where removed = 0), '') as text
  from marked group by doc_id)
select t.doc_id, len(t.words) as n_words, coalesce(k.n_removed, 0) as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id
"""

# Windows are cut from pieces of two window lengths, so that no cut reads a long text from its start.
SUFFIX_DEDUP = """
with texts as (
  select doc_id, hex(encode(coalesce(text, ''))) as hexed, len(hex(encode(coalesce(text, '')))) // 2 as n
  from documents),
pieces as (
  select doc_id, n, k, substr(hexed, 400 * k + 1, 800) as piece
  from (select *, unnest(range(0, n // 200 + 1)) as k from texts)),
windows as (
  select doc_id, 200 * k + o as pos, md5(substr(piece, 2 * o + 1, 400)) as content
  from (select *, unnest(range(0, 200)) as o from pieces) where 200 * k + o + 200 <= n),
starts as (
  select doc_id, pos from windows
  where content in (select content from windows group by content having count(*) > 1)),
opened as (
  select *, case when pos <= lag(pos) over (partition by doc_id order by pos) + 200 then 0 else 1 end as opens from starts),
islands as (
  select *, sum(opens) over (partition by doc_id order by pos) as island from opened),
spans as (
  select doc_id, min(pos) as low, max(pos) + 200 as high from islands group by doc_id, island),
ends as (
  select *, coalesce(lag(high) over (partition by doc_id order by low, high), 0) as before
  from (select doc_id, low, high from spans union all select doc_id, n, n from texts)),
kept as (
  select e.doc_id, sum(e.high - e.low)::bigint as n_removed, (count(*) - 1)::bigint as n_spans,
         string_agg(substr(t.hexed, 2 * e.before + 1, 2 * (e.low - e.before)), '' order by e.low, e.high) as hexed
  from ends e join texts t on t.doc_id = e.doc_id group by e.doc_id)
select t.doc_id, t.n as n_bytes, k.n_removed, k.n_spans, sha256(unhex(k.hexed)) as kept_sha256
from texts t join kept k on t.doc_id = k.doc_id
"""

HARD_NEGATIVES = """
with usable as (
  select row_number() over () as row, vec_id,
         case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as vector
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.row as anchor_row, a.vec_id as anchor_id, r.vec_id, r.label = a.label as alike,
         coalesce(cast(list_sum(list_transform(list_zip(a.vector, r.vector), lambda z: z[1] * z[2])) as bigint), 0) as score
  from usable a join usable r on a.row <> r.row
  where a.vec_id % 100 = 0),
positives as (
  select * from (
    select *, row_number() over (partition by anchor_row order by score desc, vec_id nulls last) as turn
    from scored where alike)
  where turn <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score,
         n.score as negative_score,
         row_number() over (partition by p.anchor_row, p.turn order by n.score desc, n.vec_id nulls last) as rank
  from positives p join scored n on p.anchor_row = n.anchor_row
  where not n.alike and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
from ranked where rank <= 10
"""



def _crc_steps() -> list[int]:
    """The checksum's step for each half byte, from its polynomial."""
    steps = list(range(16))
    for _ in range(4):
        steps = [(s >> 1) ^ (0xEDB88320 if s & 1 else 0) for s in steps]
    return steps


SPELLING = f"""
with runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from documents) group by doc_id, run),
hexed as (select *, hex(encode(concat(doc_id, ':', run))) as digits from runs),
halves as (
  select *, list_transform(range(len(digits)), lambda i:
           cast(instr('0123456789ABCDEF', substr(digits, i + 2 - 2 * (i % 2), 1)) - 1 as bigint)) as half
  from hexed),
checked as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, half), lambda c, x:
           xor(c >> 4, {_crc_steps()}[xor(c & 15, x) + 1]::bigint))) as h
  from halves),
spelled as (
  select times, case when h % 97 = 0
                     then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
  from checked),
words as (
  select word, sum(times)::bigint as n from spelled where length(word) >= 5 group by word having sum(times) >= 3),
gaps as (
  select word, n, pos, substr(word, 1, pos - 1) as head, substr(word, pos + 1) as tail
  from (select word, n, unnest(range(1, length(word) + 1)) as pos from words)),
shorter as (
  select distinct g.word, g.n, w.word as near, w.n as near_n from gaps g join words w on w.word = g.head || g.tail),
pairs as (
  select a.word, a.n, b.word as near, b.n as near_n
  from gaps a join gaps b on a.pos = b.pos and a.head = b.head and a.tail = b.tail and a.word <> b.word
  union all select * from shorter
  union all select near, near_n, word, n from shorter),
ranked as (
  select *, row_number() over (partition by word order by near_n desc, encode(near)) as turn,
         count(*) over (partition by word) as n_near from pairs),
forms as (
  select w.word, w.n, coalesce(r.n_near, 0) as n_near,
         case when r.near_n >= 2 * w.n then r.near end as form, case when r.near_n >= 2 * w.n then r.near_n end as form_n
  from words w left join ranked r on r.word = w.word and r.turn = 1),
recursive_roots as (
  with recursive steps as (
    select word, word as root from forms
    union all select s.word, f.form from steps s join forms f on f.word = s.root where f.form is not null)
  select s.word, s.root from steps s join forms f on f.word = s.root where f.form is null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join recursive_roots r on r.word = f.word
"""

ORACLES: dict[str, str] = {
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_exact_dedup": EXACT_DEDUP,
    "op9_block_dedup": BLOCK_DEDUP,
    "op10_weighted_mix": WEIGHTED_MIX,
    "op12_spelling_variants": SPELLING,
    "op13_hard_negatives": HARD_NEGATIVES,
}
