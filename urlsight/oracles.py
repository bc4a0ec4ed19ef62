"""The registered queries in SQL, for the comparison with another engine.

``VIEWS`` spells the derived inputs and the shared steps, each as ``name: (needs, sql)``;
``oracle_sql`` puts in front of a query the views it needs.
"""

from __future__ import annotations

from urlsight.functions.predicates import METADATA_PHRASES, MONITORED_TLDS
from urlsight.plans.evaluation import CLASS_NAMES, SUMMARY_ROWS, thresholds

#: Names that the queries with a memory by count remember.
RECENT = 700
#: Bytes of a publisher's batch in the query of that name.
MESSAGE_BYTES = 1450

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, tuple[tuple[str, ...], str]] = {}


def _iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when strftime({ts}, '%f') = '000000' "
        f"then '' else '.' || strftime({ts}, '%f') end || '+00:00'"
    )


# ------------------------------------------------------------------ inputs

VIEWS["classified_urls"] = ((), """
select e.event_id, p.url, e.event_type,
       case when e.raw > 0.5 then 'MALICIOUS' else 'BENIGN' end as classification,
       round(e.raw, 2) as score, e.raw, e.ts as time_added,
       case when p.url like '%ads-track%' or p.url like '%adult-x%'
              or p.url like '%free-bets%' then 1 else 0 end as truth
from (select event_id, event_type, ts,
             cast((event_id * 7919) % 10007 as double) / 10007 as raw,
             event_id % (select count(*) from pages) as pid
      from events) e
join pages p on p.page_id = e.pid""")

VIEWS["hosts"] = (("classified_urls",), """
select *, regexp_extract(url, 'https?://([^/]+)', 1) as host from classified_urls""")

VIEWS["url_corpus_raw"] = (("classified_urls",), """
select url || '/v' || cast(event_id // (4 * (select count(*) from pages)) as varchar) as url,
       case when (event_type = 'error' and event_id % 10 < 5) or truth = 1 then 1 else 0 end as label
from classified_urls""")

VIEWS["messy_urls"] = (("classified_urls",), """
select event_id,
       case event_id % 6 when 0 then url when 1 then upper(url)
            when 2 then replace(url, '://', '://www.')
            when 3 then regexp_replace(url, '^https?://', '')
            when 4 then url || '?next=' || url
            else repeat(url, 16) end as url
from classified_urls""")

VIEWS["ct_messages"] = (("hosts",), """
select event_id, time_added as ts,
       case when event_id % 50 = 49 then 'test message'
            when event_type = 'error' then 'heartbeat' else 'certificate_update' end as kind,
       [host, '*.' || host, 'v' || cast(event_id % 7 as varchar) || '.' || host] as domains
from hosts""")

VIEWS["ct_records"] = (("hosts",), """
select time_added as ts, event_id // 2 + 1 as id,
       case when event_id % 7 <> 0
            then host || chr(10) || '*.' || host || chr(10) || ' ' || host || chr(10) end as name_value,
       case when event_id % 3 = 0 then host
            when event_id % 3 = 1 then 'Visit ' || host
            when event_id % 11 = 5 then 'cn.' || host || '.ru'
            else 'cn' || cast(event_id % 11 as varchar) || '.' || host end as common_name
from hosts""")

VIEWS["envelopes"] = (("hosts",), """
select event_id,
       case when event_type = 'error' then 'dead' when event_id % 10 = 7 then 'empty' else 'good' end as kind,
       url, '*.' || host as wildcard
from hosts""")

VIEWS["submitted"] = (("classified_urls",), """
select url, score, classification, time_added
from classified_urls cross join range(2) copies
where event_type <> 'error' and event_id % 20 <> 3""")

# ------------------------------------------------------------------ shared steps

VIEWS["certificates"] = (("ct_records",), """
select ts, id, record,
       case when coalesce(common_name, '') <> '' and not list_contains(names, common_name)
            then list_append(names, common_name) else names end as names
from (select ts, id, common_name,
             md5(concat_ws(chr(31), cast(id as varchar), coalesce(name_value, chr(30)),
                           coalesce(common_name, chr(30)))) as record,
             list_filter(list_transform(string_split(coalesce(name_value, ''), chr(10)),
                                        lambda n: trim(n)), lambda n: n <> '') as names
      from ct_records)""")

VIEWS["cert_names"] = (("certificates",), """
select id, record, unnest(range(len(names))) as pos, unnest(names) as domain from certificates""")

_phrases = " and ".join(f"not contains(lower(domain), '{p}')" for p in METADATA_PHRASES)
_valid = (
    f"domain <> '' and not starts_with(domain, '*.') and contains(domain, '.') "
    f"and not contains(domain, ' ') and {_phrases}"
)
VIEWS["valid_names"] = (("cert_names",), f"select * from cert_names where {_valid}")

VIEWS["fresh_names"] = (("valid_names",), """
select * from (select *, row_number() over (partition by domain order by id, record, pos) as rn
               from valid_names) where rn = 1""")

VIEWS["batches"] = (("fresh_names",), """
select id, record, list(domain order by pos) as urls from fresh_names group by id, record""")

VIEWS["corpus"] = (("url_corpus_raw",), """
select url, min(label) as label from url_corpus_raw group by url""")

VIEWS["balanced"] = (("corpus",), """
select url, label, case when rn <= cast(floor(n * 0.8::double) as bigint) then 'train' else 'test' end as part
from (select *, row_number() over (partition by label order by md5(url || ':42') || url) as rn
      from corpus)
cross join (select min(n) as n from (select count(*) as n from corpus group by label))
where rn <= n""")

VIEWS["train"] = (("balanced",), "select url, label from balanced where part = 'train'")

_normal = r"substr(regexp_replace(lower(url), 'https?://|www\.', '', 'g'), 1, 500)"
_model_text = rf"regexp_replace({_normal}, '[[:punct:]]|\s', '', 'g')"
VIEWS["corpus_text"] = (("corpus",), f"select url, label, {_model_text} as t from corpus")

VIEWS["vocab"] = (("corpus_text",), """
select row_number() over (order by n desc, token desc) + 1 as id, token, n
from (select token, count(*) as n
      from (select unnest(string_split(t, '')) as token from corpus_text where t <> '')
      group by token order by n desc, token desc limit 126)""")

VIEWS["nb_table"] = (("train",), f"""
select gram, pos, neg, ln(((pos + 1) / (p + 2)) / ((neg + 1) / (q + 2))) as log_odds
from (select gram, cast(sum(label) as bigint) as pos, cast(sum(1 - label) as bigint) as neg
      from (select distinct url, label, substr(t, i, 3) as gram
            from (select url, label, t, unnest(range(1, length(t) - 1)) as i
                  from (select url, label, {_model_text} as t from train)))
      group by gram)
cross join (select sum(label) as p, sum(1 - label) as q from train)""")


def _scored(urls: str) -> str:
    """``(url, raw)`` for the distinct URLs of a view, scored with ``nb_table``."""
    return f"""
select u.url, 1 / (1 + exp(-coalesce(s.total, 0))) as raw
from (select distinct url from {urls}) u
left join (select url, sum(log_odds) as total
           from (select distinct url, substr(t, i, 3) as gram
                 from (select url, t, unnest(range(1, length(t) - 1)) as i
                       from (select distinct url, {_model_text} as t from {urls})))
           join nb_table using (gram) group by url) s on s.url = u.url"""


_stored = (
    "round_even(cast(cast(raw as float) as double), 2) as score, "
    "case when raw > 0.5 then 'MALICIOUS' else 'BENIGN' end as classification"
)


VIEWS["scored_rows"] = (("classified_urls",), "select url, truth, raw as score from classified_urls")

VIEWS["conf"] = (("scored_rows",), """
select count(*) filter (truth = 0 and score <= 0.5) as tn,
       count(*) filter (truth = 0 and score > 0.5) as fp,
       count(*) filter (truth = 1 and score <= 0.5) as fn,
       count(*) filter (truth = 1 and score > 0.5) as tp
from scored_rows""")

_rates = """
coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)::double as accuracy,
coalesce(tp / nullif(tp + fp, 0), 0)::double as precision,
coalesce(tp / nullif(tp + fn, 0), 0)::double as recall,
coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::double as f1"""
VIEWS["conf_rates"] = (("conf",), f"select *, {_rates} from conf")

VIEWS["by_score"] = (("scored_rows",), """
select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg,
       lead(pos) over w as next_pos, lead(neg) over w as next_neg,
       row_number() over w as rn
from (select score, count(*) filter (truth = 1) as pos, count(*) filter (truth = 0) as neg
      from scored_rows group by score)
window w as (order by score desc)""")

VIEWS["measured"] = (("conf_rates", "by_score", "scored_rows"), """
select conf_rates.*, 1 - above / ((tp + fn)::double * (tn + fp)) as auc_roc,
       ap / (tp + fn) as average_precision, loss
from conf_rates,
     (select sum(pos * (cum_neg - neg / 2)) as above,
             sum(pos * cum_pos::double / (cum_pos + cum_neg)) as ap from by_score),
     (select avg(case when truth = 1 then -ln(p) else -ln(1 - p) end) as loss
      from (select truth, least(greatest(score, 1e-7::double), 1 - 1e-7::double) as p
            from scored_rows))""")

_limits = ", ".join(f"({t!r}::double)" for t in thresholds())
VIEWS["sweep"] = (("scored_rows",), f"""
select *, {_rates}
from (select threshold, count(*) filter (truth = 0 and score < threshold) as tn,
             count(*) filter (truth = 0 and score >= threshold) as fp,
             count(*) filter (truth = 1 and score < threshold) as fn,
             count(*) filter (truth = 1 and score >= threshold) as tp
      from scored_rows cross join (values {_limits}) limits(threshold)
      group by threshold)""")

VIEWS["outcomes"] = (("scored_rows",), """
select *, case when score > 0.5 then case when truth = 1 then 'TP' else 'FP' end
               when truth = 1 then 'FN' else 'TN' end as outcome from scored_rows""")

# The same steps over rows of which some have no score, which ranks below all others.
VIEWS["hot_rows"] = (("classified_urls",), """
select url, truth, coalesce(case when event_id % 100 >= 5 then 0.25::double
                                 when event_id % 100 >= 2 then raw end, '-inf'::double) as score
from classified_urls""")
VIEWS["hot_scores"] = (("hot_rows",), "select * from hot_rows where score > '-inf'::double")


def _hot(text: str, rows: str = "hot_rows") -> str:
    text = text.replace("scored_rows", rows).replace("by_score", "hot_by_score")
    return text.replace("conf_rates", "hot_rates").replace("from conf", "from hot_conf").replace(
        "by_score, conf", "by_score, hot_conf").replace("measured", "hot_measured").replace(
        "outcomes", "hot_outcomes")


VIEWS["hot_conf"] = (("hot_rows",), _hot(VIEWS["conf"][1]))
VIEWS["hot_rates"] = (("hot_conf",), _hot(VIEWS["conf_rates"][1]))
VIEWS["hot_by_score"] = (("hot_rows",), _hot(VIEWS["by_score"][1]))
VIEWS["hot_measured"] = (("hot_rates", "hot_by_score", "hot_rows"), _hot(VIEWS["measured"][1]))
VIEWS["hot_outcomes"] = (("hot_scores",), _hot(VIEWS["outcomes"][1], "hot_scores"))

# ------------------------------------------------------------------ sources and sinks

ORACLES["src_labelled_lines"] = (("url_corpus_raw",), "select url, label from url_corpus_raw")
ORACLES["src_ct_stream"] = (("ct_messages",), """
select event_id, array_to_string(domains, '|') as domains
from ct_messages where kind = 'certificate_update'""")
ORACLES["src_ct_search"] = (("ct_records",), """
select id, name_value, common_name from ct_records where id % 50 <> 0""")
ORACLES["src_ct_incremental"] = (("ct_records",), """
select id, common_name from ct_records
where id > (select max(id) from ct_records where id <= (select max(id) / 2 from ct_records))""")
_tlds = "|".join(MONITORED_TLDS)
ORACLES["src_ct_offsets"] = (("ct_records",), "select id, common_name from ct_records")
ORACLES["src_tld_filter"] = (("cert_names",), rf"""
select id, domain from cert_names where regexp_matches(lower(domain), '\.({_tlds})$')""")
ORACLES["src_envelope"] = (("envelopes",), """
select event_id, url || '|' || wildcard as urls from envelopes where kind = 'good'""")
ORACLES["src_dead_letter"] = (("envelopes", "ct_messages"), """
select 'envelope' as source, event_id, 'not a JSON object' as error from envelopes where kind = 'dead'
union all
select 'stream', event_id, 'not a JSON object' from ct_messages where kind = 'test message'""")
_rows = f"url, score, classification, {_iso('time_added')} as time_added"
ORACLES["src_classified"] = (("classified_urls",), f"""
select {_rows} from classified_urls
where time_added >= (select max(ts) from events) - interval 7 day""")
ORACLES["sink_url_batches"] = (("batches",), "select cast(to_json({'urls': urls}) as varchar) as value from batches")
ORACLES["sink_classified"] = (("classified_urls",), f"select {_rows} from classified_urls")
ORACLES["sink_layout"] = (("classified_urls",), """
select strftime(time_added, '%Y-%m-%d') as dt, classification, count(*) as n,
       round(sum(score), 6) as total_score
from classified_urls group by all""")
ORACLES["sink_layout_streamed"] = (("classified_urls",), """
select strftime(time_added, '%Y-%m-%d') as dt, count(*) as n, round(sum(score), 6) as total_score, true as few_files
from classified_urls group by all""")
ORACLES["sink_submit"] = (("submitted",), f"select {_rows} from submitted")
ORACLES["sink_metrics_csv"] = (("measured",), """
select metric as "Metric", printf('%.4f', v) as "Value"
from measured, lateral (values ('Accuracy', accuracy), ('Precision', precision),
     ('Recall', recall), ('F1-Score', f1), ('AUC-ROC', auc_roc),
     ('Average Precision', average_precision)) t(metric, v)""")
ORACLES["sink_alerts"] = ORACLES["sink_submit"]


def _by_length(rows: str) -> str:
    return (
        f"select url, (length(url) % 100) / 100 as score, case when (length(url) % 100) / 100 > 0.5 "
        f"then 'MALICIOUS' else 'BENIGN' end as classification from {rows}"
    )


ORACLES["sink_alert_feed"] = ORACLES["sink_alerts"]
ORACLES["sink_all_writers"] = (("envelopes", "classified_urls", "submitted"), f"""
{_by_length("envelopes where kind = 'good'")}
union all select url, score, classification from classified_urls
union all select url, score, classification from submitted""")

_certificate = (
    "case when kind = 'test message' then kind else '{\"message_type\":\"' || kind || "
    "'\",\"data\":{\"leaf_cert\":{\"all_domains\":[' || "
    "array_to_string(list_transform(domains, lambda d: '\"' || d || '\"'), ',') || ']}}}' end"
)
VIEWS["sent"] = (("ct_messages",), f"""
select *, octet_length(encode(value)) as size, sum(octet_length(encode(value))) over (order by number) as upto
from (select row_number() over (order by event_id) - 1 as number, {_certificate} as value from ct_messages)""")
ORACLES["sink_message_batches"] = (("sent",), f"""
, jumps as (
  select a.number, greatest(max(b.number), a.number) + 1 as after
  from sent a left join sent b on b.number between a.number and a.number + 9
                              and b.upto - a.upto + a.size <= {MESSAGE_BYTES}
  group by a.number),
starts as (
  with recursive chain as (
    select number, after from jumps where number = 0
    union all select j.number, j.after from chain c join jumps j on j.number = c.after)
  select * from chain)
select s.number as batch, count(*) as n_messages, sum(m.size)::bigint as n_bytes,
       md5(string_agg(m.value, chr(10) order by m.number)) as messages
from starts s join sent m on m.number >= s.number and m.number < s.after group by s.number""")

# ------------------------------------------------------------------ expressions and ingest

ORACLES["fn_normalize_url"] = (("messy_urls",), f"select event_id, {_normal} as normalized from messy_urls")
ORACLES["fn_char_split"] = (("messy_urls",), f"""
select event_id, array_to_string(string_split({_normal}, ''), ' ') as characters from messy_urls""")
ORACLES["fn_extract_names"] = (("certificates",), """
select id, array_to_string(names, '|') as names from certificates""")
ORACLES["fn_url_length"] = (("messy_urls",), """
select event_id, cast(length(url) as integer) as length from messy_urls""")
_domain = r"nullif(regexp_extract(url, '(?:https?://)?(?:www\.)?([^/]+)', 1), '')"
ORACLES["fn_extract_domain"] = (("messy_urls",), f"select event_id, {_domain} as domain from messy_urls")
ORACLES["fn_round_score"] = (("classified_urls",), """
select event_id, round_even(cast(cast(raw as float) as double), 2) as score from classified_urls""")
ORACLES["fn_label"] = (("classified_urls",), """
select event_id, case when raw > 0.5 then 'MALICIOUS' else 'BENIGN' end as classification
from classified_urls""")
ORACLES["fn_label_to_int"] = (("classified_urls",), """
select event_id, case when classification = 'MALICIOUS' then 1 else 0 end as malicious
from classified_urls""")
ORACLES["fn_prefix80"] = (("messy_urls",), f"""
select event_id, substr(url, 1, 80) as url, substr({_domain}, 1, 50) as domain from messy_urls""")
ORACLES["flt_wildcard"] = (("cert_names",), """
select id, cast(pos as integer) as pos, domain from cert_names where not starts_with(domain, '*.')""")
ORACLES["flt_valid_domain"] = (("valid_names",), """
select id, cast(pos as integer) as pos, domain from valid_names""")
ORACLES["flt_valid_names"] = (("certificates",), f"""
select id, array_to_string(list_filter(names, lambda domain: {_valid}), '|') as names
from certificates""")
ORACLES["dedup_recent"] = (("fresh_names",), """
select domain, id, cast(pos as integer) as pos from fresh_names""")
ORACLES["explode_domains"] = (("ct_messages",), """
select event_id, cast(unnest(range(len(domains))) as integer) as pos, unnest(domains) as domain
from ct_messages where kind = 'certificate_update'""")
ORACLES["regroup_by_cert"] = (("batches",), "select id, array_to_string(urls, '|') as urls from batches")
ORACLES["max_id_mark"] = (("ct_records",), "select max(id) as max_cert_id from ct_records where id <> 0")
ORACLES["ingest_counters"] = (("ct_messages",), """
select count(*) as batches, cast(sum(len(domains)) as bigint) as domains
from ct_messages where kind = 'certificate_update'""")

# ------------------------------------------------------------------ dashboard

ORACLES["dash_stats"] = (("classified_urls",), """
select total_urls, total_malicious, total_urls - total_malicious as total_benign,
       coalesce(round(total_malicious / total_urls * 100, 2), 0) as malicious_rate,
       coalesce(round((total_urls - total_malicious) / total_urls * 100, 2), 0) as benign_rate,
       coalesce(round(avg_m, 3), 0) as avg_malicious_confidence,
       coalesce(round(avg_b, 3), 0) as avg_benign_confidence,
       low_confidence_malicious, low_confidence_benign,
       coalesce(round(low_confidence_benign / total_urls * 100, 2), 0) as false_positive_rate
from (select count(*) as total_urls,
             count(*) filter (classification = 'MALICIOUS') as total_malicious,
             avg(score) filter (classification = 'MALICIOUS') as avg_m,
             avg(score) filter (classification = 'BENIGN') as avg_b,
             count(*) filter (classification = 'MALICIOUS' and score < 0.7) as low_confidence_malicious,
             count(*) filter (classification = 'BENIGN' and score > 0.3) as low_confidence_benign
      from classified_urls)""")
ORACLES["dash_realtime"] = (("classified_urls",), f"""
select count(*) as total_last_hour,
       count(*) filter (classification = 'MALICIOUS') as malicious_last_hour,
       {_iso('max(time_added)')} as latest_detection
from classified_urls where time_added >= (select max(ts) from events) - interval 1 hour""")
ORACLES["dash_confidence"] = (("classified_urls",), """
select case when classification = 'MALICIOUS' then 1 else 0 end as classification,
       case when score >= 0.9 then '0.9-1.0' when score >= 0.7 then '0.7-0.9'
            when score >= 0.5 then '0.5-0.7' when score >= 0.3 then '0.3-0.5'
            when score >= 0.1 then '0.1-0.3' else '0.0-0.1' end as confidence_range,
       count(*) as count
from classified_urls group by all""")
ORACLES["dash_timeline"] = (("classified_urls",), f"""
select {_iso("date_trunc('minute', time_added)")} as time_bucket,
       case when classification = 'MALICIOUS' then 1 else 0 end as classification, count(*) as count
from classified_urls where time_added >= (select max(ts) from events) - interval 30 minute
group by all""")
ORACLES["dash_detection_rate"] = (("classified_urls",), """
select strftime(time_added, '%Y-%m-%d') as date,
       round(count(*) filter (classification = 'MALICIOUS') * 100.0::double / count(*), 2) as detection_rate,
       count(*) as total_urls
from classified_urls where time_added >= (select max(ts) from events) - interval 7 day
group by all""")
ORACLES["dash_top_domains"] = (("classified_urls",), f"""
select domain, count(*) as count, round(avg(score), 6) as avg_confidence
from (select {_domain} as domain, score from classified_urls where classification = 'MALICIOUS')
where domain is not null group by domain order by count desc, domain limit 15""")
ORACLES["dash_url_length"] = (("classified_urls",), """
select case when length(url) < 30 then '0-30' when length(url) < 50 then '30-50'
            when length(url) < 75 then '50-75' when length(url) < 100 then '75-100'
            else '100+' end as length_range,
       case when classification = 'MALICIOUS' then 1 else 0 end as is_phishing, count(*) as count
from classified_urls group by all""")
ORACLES["dash_recent_100"] = (("classified_urls",), f"""
select {_iso('time_added')} as "timestamp", url, classification, coalesce(score, 0) as score
from (select * from classified_urls
      order by time_added desc, url desc, score desc, classification desc limit 100)""")
ORACLES["dash_top_malicious"] = (("classified_urls",), f"""
select url, score as confidence, {_iso('time_added')} as "timestamp"
from (select * from classified_urls where classification = 'MALICIOUS'
      order by score desc, time_added desc, url limit 20)""")

# ------------------------------------------------------------------ corpus

ORACLES["corpus_union"] = (("url_corpus_raw",), "select url, label from url_corpus_raw")
ORACLES["corpus_dedup"] = (("corpus",), "select url, label from corpus")
ORACLES["corpus_dedup_report"] = (("url_corpus_raw",), """
select count(*) as before, count(distinct url) as after, count(*) - count(distinct url) as removed
from url_corpus_raw""")
ORACLES["corpus_class_counts"] = (("corpus",), "select label, count(*) as n from corpus group by label")
ORACLES["corpus_balance_split"] = (("balanced",), "select url, label, part from balanced")
ORACLES["corpus_shuffle"] = (("corpus",), """
select url, label, row_number() over (order by md5(url || ':7') || url) as position from corpus""")
ORACLES["corpus_stratified"] = (("corpus",), """
select url, label, case when rn <= kept then 'train' else 'validation' end as part
from (select *, row_number() over (partition by label order by md5(url || ':42') || url) as rn
      from corpus)
join (select label, base + case when row_number() over (order by base - exact, label)
                                     <= train - sum(base) over () then 1 else 0 end as kept
      from (select label, train, n / total * train as exact, floor(n / total * train) as base
            from (select label, n, sum(n) over ()::double as total,
                         sum(n) over () - ceil(0.2::double * sum(n) over ()) as train
                  from (select label, count(*) as n from corpus group by label)))) using (label)""")
ORACLES["corpus_class_weight"] = (("corpus",), """
select label, n, round(sum(n) over () / (count(*) over () * n), 6)::double as weight
from (select label, count(*) as n from corpus group by label)""")

# ------------------------------------------------------------------ features and models

ORACLES["feat_vocab"] = (("vocab",), "select cast(id as integer) as id, token, n from vocab")
ORACLES["feat_vectorize"] = (("corpus_text", "vocab"), """
select url, array_to_string(list_transform(range(1, 201), lambda i:
           case when i > length(t) then 0 else instr(alphabet, substr(t, i, 1)) + 1 end), ',') as ids
from corpus_text cross join (select string_agg(token, '' order by id) as alphabet from vocab)""")
_grams = " union ".join(
    f"select url, substr(t, i, {w}) as gram "
    f"from (select url, t, unnest(range(1, length(t) - {w - 2})) as i from corpus_text)"
    for w in (3, 5, 7)
)
ORACLES["feat_ngrams"] = (("corpus_text",), f"""
select cast(length(gram) as integer) as width, gram, count(*) as n from ({_grams}) group by gram""")
ORACLES["model_nb_table"] = (("nb_table",), """
select gram, pos, neg, round(log_odds, 6) as log_odds from nb_table""")
ORACLES["model_persist"] = ORACLES["model_nb_table"]
ORACLES["score_urls"] = (("nb_table", "url_corpus_raw"), f"""
select url, {_stored} from url_corpus_raw join ({_scored('url_corpus_raw')}) using (url)""")
ORACLES["score_urls_joined"] = ORACLES["score_urls"]
ORACLES["model_train"] = (("balanced",), """
select url, label, true as is_probability, true as survives_saving from balanced where part = 'test'""")
ORACLES["model_select"] = (("train",), """
select cast(count(*) - ceil(0.2::double * count(*)) as bigint) as n_train,
       cast(ceil(0.2::double * count(*)) as bigint) as n_validation,
       true as rounds_in_bounds, true as best_has_least_loss, true as accurate
from train""")
ORACLES["model_epochs"] = (("train",), """
select cast(count(*) - ceil(0.2::double * count(*)) as bigint) as n_train,
       cast(ceil(0.2::double * count(*)) as bigint) as n_validation,
       true as epochs_in_bounds, true as best_has_least_loss, true as not_worse, true as accurate
from train""")
ORACLES["score_pipeline"] = (("url_corpus_raw",), "select url, true as fits from url_corpus_raw")
ORACLES["score_user_model"] = (("url_corpus_raw",), f"""
select url, round_even(cast(cast(raw as float) as double), 2) as score,
       case when cast(cast(raw as float) as double) > 0.1::double then 'MALICIOUS' else 'BENIGN' end as classification
from (select url, length(regexp_replace({_normal}, '[^0-9]', '', 'g')) / length({_normal}) as raw
      from url_corpus_raw)""")
ORACLES["score_throughput"] = (("nb_table", "messy_urls"), f"""
select classification, count(*) as n, true as keeps_up
from (select url, {_stored} from messy_urls join ({_scored('messy_urls')}) using (url)) group by all""")

# ------------------------------------------------------------------ evaluation

ORACLES["eval_confusion"] = (("conf",), "select tn, fp, fn, tp from conf")
_six = ", ".join(f"round({c}, 6) as {c}" for c in ("accuracy", "precision", "recall", "f1"))
ORACLES["eval_metrics"] = (("measured",), f"""
select tn, fp, fn, tp, {_six}, round(auc_roc, 6) as auc_roc,
       round(average_precision, 6) as average_precision, round(loss, 6) as loss
from measured""")


def _prf(name: str, hit: str, predicted: str, actual: str) -> str:
    return (
        f"select '{name}' as class, round(coalesce({hit} / nullif({predicted}, 0), 0), 6) as precision, "
        f"round(coalesce({hit} / nullif({actual}, 0), 0), 6) as recall, "
        f"round(coalesce(2 * {hit} / nullif({predicted} + {actual}, 0), 0), 6) as f1, "
        f"{actual} as support from conf"
    )


_both = """
select tn / (tn + fn) as p0, tp / (tp + fp) as p1, tn / (tn + fp) as r0, tp / (tp + fn) as r1,
       2 * tn / (2 * tn + fn + fp) as f0, 2 * tp / (2 * tp + fn + fp) as f1,
       tn + fp as n0, tp + fn as n1 from conf"""
ORACLES["eval_class_report"] = (("conf",), f"""
{_prf(CLASS_NAMES[0], 'tn', '(tn + fn)', '(tn + fp)')} union all
{_prf(CLASS_NAMES[1], 'tp', '(tp + fp)', '(tp + fn)')} union all
select 'accuracy', a, a, a, n from (select round((tp + tn) / (tp + tn + fp + fn), 6) as a,
                                           tp + tn + fp + fn as n from conf) union all
select 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6),
       n0 + n1 from ({_both}) union all
select 'weighted avg', round((p0 * n0 + p1 * n1) / (n0 + n1), 6),
       round((r0 * n0 + r1 * n1) / (n0 + n1), 6), round((f0 * n0 + f1 * n1) / (n0 + n1), 6),
       n0 + n1 from ({_both})""")
ORACLES["eval_curves"] = (("by_score", "conf"), """
select 'roc' as curve, round(cum_neg / (tn + fp), 6) as x, round(cum_pos / (tp + fn), 6) as y,
       score as threshold
from by_score, conf
where rn = 1 or next_pos is null or next_pos <> pos or next_neg <> neg
union all select 'roc', 0, 0, 'inf'::double
union all
select 'pr', round(cum_pos / (tp + fn), 6), round(cum_pos / (cum_pos + cum_neg), 6), score
from by_score, conf
union all select 'pr', 0, 1, null""")
ORACLES["eval_curves_thinned"] = (("by_score", "conf"), """
select * from (
  select 'roc' as curve, round(cum_neg / (tn + fp), 6) as x, round(cum_pos / (tp + fn), 6) as y, score as threshold
  from by_score, conf where next_pos is null or pos * next_neg <> neg * next_pos
  union all select 'roc', 0, 0, 'inf'::double
  union all
  select 'pr', round(cum_pos / (tp + fn), 6), round(cum_pos / (cum_pos + cum_neg), 6), score
  from by_score, conf where next_pos is null or pos > 0 or next_pos > 0
  union all select 'pr', 0, 1, null) cross join (values ('plain'), ('bucketed')) forms(form)""")
ORACLES["eval_threshold_sweep"] = (("sweep",), f"""
select round(threshold, 6) as threshold, tn, fp, fn, tp, {_six} from sweep""")
ORACLES["eval_best_threshold"] = (("sweep",), f"""
select round(threshold, 6) as threshold, tn, fp, fn, tp, {_six}
from (select * from sweep order by f1 desc, threshold limit 1)""")
ORACLES["eval_errors"] = (("outcomes",), """
select outcome as kind, round(score, 6) as score, substr(url, 1, 80) as url, n,
       round(mean_score, 6) as mean_score
from (select *, count(*) over (partition by outcome) as n,
             avg(score) over (partition by outcome) as mean_score,
             row_number() over (partition by outcome order by score, url) as rn
      from outcomes where outcome in ('FP', 'FN')) where rn <= 5""")
ORACLES["eval_hist60"] = (("scored_rows",), """
select truth, bin, round(bin_start, 6) as bin_start, round(bin_end, 6) as bin_end,
       (select count(*) from scored_rows s where s.truth = b.truth and s.score >= b.bin_start
          and (s.score < b.bin_end or (b.bin = 59 and s.score <= b.bin_end))) as count
from (select truth, bin, lo + bin * ((hi - lo) / 60) as bin_start,
             case when bin = 59 then hi else lo + (bin + 1) * ((hi - lo) / 60) end as bin_end
      from (select truth, min(score) as lo, max(score) as hi from scored_rows group by truth)
      cross join (select unnest(range(60)) as bin)) b""")
ORACLES["eval_box"] = (("outcomes",), """
select outcome, n, round(mean, 6) as mean, round(q1, 6) as q1, round(median, 6) as median,
       round(q3, 6) as q3,
       round(least(q1, (select min(score) from outcomes o
                        where o.outcome = q.outcome and score >= q1 - 1.5 * (q3 - q1))), 6) as whisker_low,
       round(greatest(q3, (select max(score) from outcomes o
                           where o.outcome = q.outcome and score <= q3 + 1.5 * (q3 - q1))), 6) as whisker_high,
       round(median - 1.57 * (q3 - q1) / sqrt(n), 6) as notch_low,
       round(median + 1.57 * (q3 - q1) / sqrt(n), 6) as notch_high
from (select outcome, count(*) as n, avg(score) as mean, quantile_cont(score, 0.25) as q1,
             quantile_cont(score, 0.5) as median, quantile_cont(score, 0.75) as q3
      from outcomes group by outcome) q""")
ORACLES["eval_metrics_bucketed"] = (("hot_measured",), _hot(ORACLES["eval_metrics"][1]))
ORACLES["eval_curves_bucketed"] = (("hot_by_score", "hot_conf"), f"""
select curve, x, y, nullif(threshold, '-inf'::double) as threshold
from ({_hot(ORACLES["eval_curves"][1])})""")
ORACLES["eval_box_bucketed"] = (("hot_outcomes",), _hot(ORACLES["eval_box"][1]))
_summary = ", ".join(f"('{name}', {column})" for name, column in SUMMARY_ROWS)
ORACLES["eval_summary"] = (("conf",), f"""
select category as "Category", n as "Count"
from (select *, tn + fp + fn + tp as total, tn + fp as negatives, fn + tp as positives from conf),
     lateral (values {_summary}) t(category, n)""")
ORACLES["eval_compare"] = (("conf_rates",), """
select metric as "Metric", round(v, 6) as "Score"
from conf_rates, lateral (values ('Accuracy', accuracy), ('Precision', precision),
     ('Recall', recall), ('F1-Score', f1)) t(metric, v)""")

# ------------------------------------------------------------------ streaming

ORACLES["stream_minute_counts"] = (("classified_urls",), f"""
select {_iso("date_trunc('minute', time_added)")} as time_bucket, classification, count(*) as count
from classified_urls group by all""")
ORACLES["stream_minute_finals"] = ORACLES["stream_minute_counts"]
VIEWS["enveloped"] = (("envelopes",), "select url from envelopes where kind = 'good'")
ORACLES["stream_score"] = (("nb_table", "enveloped"), f"""
select url, {_stored} from enveloped join ({_scored('enveloped')}) using (url)""")
ORACLES["stream_dead_letter"] = (("envelopes",), """
select event_id, 'not a JSON object' as error from envelopes where kind = 'dead'""")
ORACLES["stream_ingest"] = (("ct_messages",), """
select cast(to_json({'urls': domains}) as varchar) as value
from ct_messages where kind = 'certificate_update'""")
VIEWS["searched"] = (("certificates",), f"""
select * from (select ts, id, record, unnest(range(len(names))) as pos, unnest(names) as domain
               from certificates where id % 50 <> 0) where {_valid}""")
ORACLES["stream_ingest_search"] = (("searched", "ct_records"), """
select cast(to_json({'urls': list(domain order by pos)}) as varchar) as value,
       (select max(id) from ct_records where id % 50 <> 0) as mark
from (select *, row_number() over (partition by domain order by ts, record, pos) as rn from searched)
where rn = 1 group by record""")


def _recent(rows: str, order: str) -> str:
    """The names that are published with a memory of the last ``RECENT`` names."""
    return f"""
, offered as (select *, row_number() over (order by {order}) - 1 as number from {rows}),
again as (
  select *, min(number) over (partition by domain order by number
            range between {RECENT} following and unbounded following) as after,
         row_number() over (partition by domain order by number) as rn from offered),
published as (
  with recursive chain as (
    select * exclude (rn) from again where rn = 1
    union all select a.* exclude (rn) from chain c join again a on a.number = c.after)
  select * from chain)"""


ORACLES["dedup_recent_count"] = (("valid_names",), f"""{_recent("valid_names", "id, record, pos")}
select domain, number from published""")
ORACLES["stream_ingest_recent"] = (("searched",), f"""{_recent("searched", "ts, id, record, pos")}
select cast(to_json({{'urls': list(domain order by pos)}}) as varchar) as value from published group by ts, id, record""")
ORACLES["stream_replay_absorbed"] = (("searched",), """
select cast(to_json({'urls': list(domain order by pos)}) as varchar) as value
from (select *, row_number() over (partition by domain order by ts, record, pos) as rn from searched)
where rn = 1 group by record""")
ORACLES["stream_replay"] = (("envelopes",), f"""
{_by_length("envelopes where kind = 'good' and event_id % 2 = 0")} union all
{_by_length("envelopes where kind = 'good'")}""")
ORACLES["stream_counts_replay"] = ORACLES["stream_minute_counts"]
ORACLES["stream_rate_limit"] = ((), "select 4::bigint as batches, count(*) as n, true as paced from events")
ORACLES["stream_resume"] = (("classified_urls",), """
select event_id, url, score, classification from classified_urls""")


def _needed(names: tuple[str, ...], ordered: list[str]) -> list[str]:
    for name in names:
        if name not in ordered:
            _needed(VIEWS[name][0], ordered)
            ordered.append(name)
    return ordered


def oracle_sql() -> dict[str, str]:
    """Full SQL text per query name."""
    texts = {}
    for name, (views, sql) in ORACLES.items():
        steps = [f"{view} as ({VIEWS[view][1].strip()})" for view in _needed(views, [])]
        prefix = "with " + ",\n".join(steps) + "\n" if steps else ""
        texts[name] = prefix + sql.strip()
    return texts
