"""Queries of answers, history, evaluation, limits and feedback."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import limits as L
from ..operators import semantic
from ..shipping import shared_folder
from ..sources.tables import read, spread
from ..streaming.windows import decisions, read_events, write_once
from .catalogue import query

# Turns of a conversation as answers that cite: the sentence ends of a text get numbers by its conversation.
_ANSWER = "concat(replace(replace(text, '. ', concat(' [', cast(conv_id % 9 + 1 as string), '][', cast(turn % 4 + 1 as string), ']. ')), ', ', if(turn % 2 = 0, ' @@@ ', ', ')), ' [', cast((conv_id + turn) % 12 as string), ']')"
_ANSWER_SQL = "replace(replace(text, '. ', ' [' || (conv_id % 9 + 1) || '][' || (turn % 4 + 1) || ']. '), ', ', case when turn % 2 = 0 then ' @@@ ' else ', ' end) || ' [' || ((conv_id + turn) % 12) || ']'"
_A_SQL = f"a as (select conv_id, turn, {_ANSWER_SQL} as t from conversations)"
_CITED_SQL = r"list_sort(list_distinct(list_transform(regexp_extract_all(t, '\[([0-9]{1,2})\]', 1), lambda n: n::int)))"


def _answers(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("t"))


def _trim(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


_SHORT_SQL, _REST_SQL = _trim("left(t, instr(t, '@@@') - 1)"), _trim("substr(t, instr(t, '@@@') + 3)")


@query("answer_split", f"with {_A_SQL} select conv_id, turn, case when instr(t, '@@@') > 0 then {_SHORT_SQL} else '' end as kurz, case when instr(t, '@@@') > 0 then {_REST_SQL} else {_trim('t')} end as lang from a")
def answer_split(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", A.split_answer(F.col("t")).alias("p")).select("conv_id", "turn", "p.kurz", "p.lang")


@query("citations", f"with {_A_SQL} select conv_id, turn, {_CITED_SQL} as nummern from a")
def citations(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", A.citations(F.col("t")).alias("nummern"))


# Each answer has ten sources; their documents repeat.
_SOURCES_SQL = "s as (select n::int as nummer, case when n % 3 = 0 then 'Plenarprotokoll' else 'Drucksache' end as dokumentart, case when n % 4 = 0 then 'Antrag' end as drucksachetyp, '21/' || (n % 4) as dokumentnummer, case when n % 2 = 0 then 'https://u.example/' || n end as pdf_url from range(1, 11) r(n))"


def _sources():
    n = F.sequence(F.lit(1), F.lit(10))
    return F.transform(n, lambda k: F.struct(
        k.alias("nummer"), F.when(k % 3 == 0, "Plenarprotokoll").otherwise("Drucksache").alias("dokumentart"), F.when(k % 4 == 0, "Antrag").alias("drucksachetyp"),
        F.concat(F.lit("21/"), (k % 4).cast("string")).alias("dokumentnummer"), F.when(k % 2 == 0, F.concat(F.lit("https://u.example/"), k.cast("string"))).alias("pdf_url"),
    ))


@query("cited_documents", f"with {_A_SQL}, {_SOURCES_SQL}, c as (select conv_id, turn, {_CITED_SQL} as cs from a), d as (select conv_id, turn, dokumentart || ' ' || dokumentnummer as d, min(nummer) as first from c join s on list_contains(cs, nummer) group by all) select c.conv_id, c.turn, coalesce(list(d order by first) filter (where d is not null), []) as dokumente from c left join d using (conv_id, turn) group by c.conv_id, c.turn")
def cited_documents(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", A.cited_documents(_sources(), A.citations(F.col("t"))).alias("dokumente"))


@query("visible_sources", f"with {_A_SQL}, {_SOURCES_SQL}, c as (select conv_id, turn, {_CITED_SQL} as cs from a) select conv_id, turn, case when len(list_filter(cs, lambda n: n between 1 and 10)) > 0 then list_filter(cs, lambda n: n between 1 and 10) else range(1, 11)::int[] end as nummern from c")
def visible_sources(spark, sf):
    seen = A.visible_sources(_sources(), A.citations(F.col("t")))
    return _answers(spark, sf).select("conv_id", "turn", F.transform(seen, lambda s: s["nummer"]).alias("nummern"))


@query("visible_documents", f"with {_A_SQL}, {_SOURCES_SQL}, c as (select conv_id, turn, {_CITED_SQL} as cs from a), v as (select conv_id, turn, case when len(list_filter(cs, lambda n: n between 1 and 10)) > 0 then list_filter(cs, lambda n: n between 1 and 10) else range(1, 11)::int[] end as ns from c) select conv_id, turn, count(distinct dokumentart || ' ' || dokumentnummer)::int as dokumente from v join s on list_contains(ns, nummer) group by all")
def visible_documents(spark, sf):
    seen = A.visible_sources(_sources(), A.citations(F.col("t")))
    return _answers(spark, sf).select("conv_id", "turn", A.documents_of(seen).alias("dokumente"))


@query("sources_grouped", f"with {_A_SQL}, {_SOURCES_SQL}, c as (select conv_id, turn, {_CITED_SQL} as cs from a) select conv_id, turn, dokumentart || '-' || dokumentnummer as schluessel, min(nummer) as erste, list(nummer order by nummer) as nummern from c join s on list_contains(cs, nummer) group by all")
def sources_grouped(spark, sf):
    rows = _answers(spark, sf).select("conv_id", "turn", F.explode(F.filter(_sources(), lambda s: F.array_contains(A.citations(F.col("t")), s["nummer"]))).alias("s"))
    return A.grouped_by_document(rows.select("conv_id", "turn", "s.*"), ["conv_id", "turn"])


_TIDY = r"trim(regexp_replace(x, '[ \t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query("copy_without_citations", f"with {_A_SQL} select conv_id, turn, {_TIDY} as text from (select conv_id, turn, regexp_replace(t, '\\s*\\[[0-9]{{1,2}}\\]', '', 'g') as x from a)")
def copy_without_citations(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", A.without_citations(F.col("t")).alias("text"))


_NOTE_SQL = "' (' || coalesce(drucksachetyp, dokumentart) || ' ' || dokumentnummer || coalesce(': ' || pdf_url, '') || ')'"


@query("copy_with_sources", f"""with {_A_SQL}, {_SOURCES_SQL}, n as (select map_from_entries(list((nummer, {_NOTE_SQL}))) as notes from s),
p as (select conv_id, turn, notes, regexp_split_to_array(t, '\\[[0-9]{{1,2}}\\]') as parts, list_transform(regexp_extract_all(t, '\\[([0-9]{{1,2}})\\]', 1), lambda x: x) as nums from a, n),
x as (select conv_id, turn, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || case when i > len(nums) then '' else coalesce(notes[nums[i]::int], '[' || nums[i] || ']') end), '') as x from p)
select conv_id, turn, {_TIDY} as text from x""")
def copy_with_sources(spark, sf):
    return _answers(spark, sf).select("conv_id", "turn", A.with_sources(F.col("t"), _sources()).alias("text"))


@query("query_analysis", """select conv_id, turn, case when turn % 4 < 2 then 'Begriffe ' || turn else 'frage ' || conv_id end as suchbegriffe, case turn % 4 when 0 then 'Drucksache' end as dokumentart from conversations""")
def query_analysis(spark, sf):
    raw = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('Gern: {"suchbegriffe": "Begriffe '), F.col("turn").cast("string"), F.lit('", "dokumentart": "Drucksache"} .')))
    raw = raw.when(F.col("turn") % 4 == 1, F.concat(F.lit('{"suchbegriffe": "Begriffe '), F.col("turn").cast("string"), F.lit('", "dokumentart": "Zeitung"}')))
    raw = raw.when(F.col("turn") % 4 == 2, F.lit('{"suchbegriffe": "", "dokumentart": null}')).otherwise("kein JSON")
    asked = F.concat(F.lit("frage "), F.col("conv_id").cast("string"))
    return read(spark, sf, "conversations").select("conv_id", "turn", A.analysis(raw, asked).alias("a")).select("conv_id", "turn", "a.suchbegriffe", "a.dokumentart")


@query("readable_dates", "select o_orderkey, strftime(o_orderdate, '%d.%m.%Y') as datum from orders")
def readable_dates(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", A.readable_date(F.col("o_orderdate")).alias("datum"))


@query("history_dedupe", """with e as (select event_id as id, user_id % 50 as nutzer, case when event_id % 2 = 0 then ' ' || upper(event_type) || ' ' else event_type end || (event_id % 37) as frage, ts as zeitpunkt from events),
d as (select * from e qualify row_number() over (partition by nutzer, lower(trim(frage)) order by zeitpunkt desc, id desc) = 1)
select nutzer, id, frage, (row_number() over (partition by nutzer order by zeitpunkt desc, id desc))::int as platz from d qualify platz <= 20""")
def history_dedupe(spark, sf):
    e = read(spark, sf, "events")
    asked = F.concat(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type")), (F.col("event_id") % 37).cast("string"))
    rows = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("nutzer"), asked.alias("frage"), F.col("ts").alias("zeitpunkt"))
    return A.history(rows, ["nutzer"]).select("nutzer", "id", "frage", "platz")


# ---- evaluation: questions are vectors, a question's targets are all other vectors of its label

_K = 20
_COS = "1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::double * x::double))))"
_EVAL_SQL = f"""ranked as (select a.vec_id as frage_id, b.vec_id as dokument, row_number() over (partition by a.vec_id order by round({_COS}, 9), b.vec_id) as rank from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
ziele as (select a.vec_id as frage_id, b.vec_id as ziel from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
judged as (select q.frage_id, (select min(rank) from ranked r join ziele z on z.frage_id = r.frage_id and z.ziel = r.dokument where r.frage_id = q.frage_id and rank <= {_K}) as first_rank from (select distinct frage_id from ziele) q)"""


def _ranked(spark, sf):
    v = spread(read(spark, sf, "embeddings"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("frage_id"), F.col("embedding").alias("q"))
    found = semantic.nearest_per_query(v, asked.withColumnRenamed("frage_id", "query_id"), _K, places=9, other=True)
    return found.select(F.col("query_id").alias("frage_id"), F.col("vec_id").alias("dokument"), "distance", "rank")


def _judged(spark, sf, ranked):
    """(frage_id, first_rank): labels are joined to what was ranked, so that the pairs of a label are never made."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label").where("label is not null")
    asked = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("frage_id"), F.col("label").alias("asked_label"))
    sizes = labels.groupBy(F.col("label").alias("asked_label")).count().where("count > 1").select("asked_label")
    asked = asked.join(sizes, "asked_label")
    hits = ranked.join(asked, "frage_id").join(labels.withColumnRenamed("vec_id", "dokument"), "dokument").where("label = asked_label")
    found = hits.groupBy("frage_id").agg(F.min("rank").alias("first_rank"))
    return asked.select("frage_id").join(found, "frage_id", "left")


@query("eval_hit_at_k", f"with {_EVAL_SQL} select frage_id, first_rank::int as first_rank, first_rank is not null as treffer from judged")
def eval_hit_at_k(spark, sf):
    return _judged(spark, sf, _ranked(spark, sf)).select("frage_id", "first_rank", F.col("first_rank").isNotNull().alias("treffer"))


@query("eval_median_rank", f"with {_EVAL_SQL} select count(*) as fragen, count(first_rank) as treffer, round(count(first_rank) / count(*), 6) as trefferquote, median(first_rank)::double as median_rang from judged")
def eval_median_rank(spark, sf):
    return E.metrics(_judged(spark, sf, _ranked(spark, sf))).withColumn("trefferquote", F.round("trefferquote", 6))


@query("eval_failures", f"with {_EVAL_SQL} select j.frage_id, list(r.dokument order by rank) as gefunden from judged j join ranked r on r.frage_id = j.frage_id and rank <= 5 where first_rank is null group by j.frage_id")
def eval_failures(spark, sf):
    ranked = _ranked(spark, sf)
    return E.failures(_judged(spark, sf, ranked), ranked)


@query("cache_missing", "select item_id, text as frage from benchmark b where not exists (select 1 from benchmark c where c.text = b.text and c.item_id % 3 = 0)")
def cache_missing(spark, sf):
    q = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("frage"))
    return E.uncached(q, q.where("item_id % 3 = 0").select("frage")).select("item_id", "frage")


# ---- limits: what a kind of event does in an hour


def _requests(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", L.key("ask", F.col("event_type")).alias("kennung"), "ts")


_REQUESTS_SQL = "r as (select event_id, sha256('limit:ask:' || event_type)[1:32] as kennung, ts from events)"


@query("rate_counts", f"with {_REQUESTS_SQL} select kennung, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as fenster, count(*) as anzahl from r group by all")
def rate_counts(spark, sf):
    return L.counts(_requests(spark, sf), "1 hour").select("kennung", F.date_format("fenster", "yyyy-MM-dd HH:mm").alias("fenster"), "anzahl")


@query("rate_decision", f"with {_REQUESTS_SQL}, n as (select *, (row_number() over (partition by kennung, time_bucket(interval 1 hour, ts) order by ts, event_id))::int as anzahl from r) select event_id, anzahl, anzahl <= 3 as erlaubt, greatest(0, 3 - anzahl)::int as verbleibend from n")
def rate_decision(spark, sf):
    return L.decisions(_requests(spark, sf), 3, "1 hour").select("event_id", "anzahl", "erlaubt", "verbleibend")


@query("rate_decision_stream", f"with {_REQUESTS_SQL}, n as (select *, (row_number() over (partition by kennung, time_bucket(interval 1 hour, ts) order by ts, event_id))::int as anzahl from r) select event_id, anzahl, anzahl <= 3 as erlaubt, greatest(0, 3 - anzahl)::int as verbleibend from n")
def rate_decision_stream(spark, sf):
    """``rate_decision`` by a stream over the events, whose counts are state; what it wrote is read back and its files stay."""
    folder = f"{shared_folder(spark)}/limits-{uuid.uuid4().hex}"
    events = read_events(spark, f"{sf}/events.parquet").select("event_id", L.key("ask", F.col("event_type")).alias("kennung"), "ts")
    write_once(decisions(events, 3, "1 hour"), f"{folder}/decided", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/decided").select("event_id", F.col("anzahl").cast("int").alias("anzahl"), "erlaubt", F.col("verbleibend").cast("int").alias("verbleibend"))


@query("rate_retention", f"with {_REQUESTS_SQL}, c as (select kennung, time_bucket(interval 1 hour, ts) as fenster, count(*) as anzahl from r group by all), m as (select max(ts) as now from r) select kennung, strftime(fenster, '%Y-%m-%d %H:%M') as fenster, anzahl from c, m where fenster >= now - interval 24 hour")
def rate_retention(spark, sf):
    r = _requests(spark, sf)
    newest = r.agg(F.max("ts").alias("now"))
    kept = L.retained(L.counts(r, "1 hour").join(F.broadcast(newest)), F.col("now"), "INTERVAL 24 HOURS")
    return kept.select("kennung", F.date_format("fenster", "yyyy-MM-dd HH:mm").alias("fenster"), "anzahl")


@query("feedback_truncate", """select doc_id, doc_id % 2 = 0 as hilfreich, left(text, 2000) as frage, left(text || text, 20000) as antwort, case when doc_id % 3 = 0 then null else left(text, 2000) end as anmerkung from documents where doc_id % 10 <> 0 and trim(text) <> '' and doc_id % 7 <> 0""")
def feedback_truncate(spark, sf):
    d = read(spark, sf, "documents")
    raw = d.select(
        "doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") % 2 == 0).alias("hilfreich"), F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.col("text")).alias("frage"),
        F.lit(None).cast("string").alias("suchbegriffe"), F.concat("text", "text").alias("antwort"), F.lit(None).cast("array<string>").alias("belegte_dokumente"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("anmerkung"),
    )
    return L.feedback(raw).select("doc_id", "hilfreich", "frage", "antwort", "anmerkung")


@query("eval_terms", r"select conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') as terme from conversations")
def eval_terms(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", E.search_terms(F.col("text")).alias("terme"))


_LONGEST = "row_number() over (partition by lang order by length(text) desc, doc_id)"


@query("eval_candidates", f"""with r as (select lang as frage_id, doc_id as chunk_id, {_LONGEST} as rank, text, source from documents where text is not null)
select frage_id, rank, chunk_id, 'D' || chunk_id as dokumentnummer, source as dokumentart, null::varchar as drucksachetyp, left(text, 240) as anriss, left(text, 20) as titel from r where rank <= 40""")
def eval_candidates(spark, sf):
    """The 40 longest documents of each language, as candidates of a question."""
    d = read(spark, sf, "documents").where("text is not null")
    ranked = d.select(F.col("lang").alias("frage_id"), F.col("doc_id").alias("chunk_id"), F.expr(_LONGEST).cast("long").alias("rank")).where("rank <= 40")
    named = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("D"), F.col("doc_id")).alias("dokumentnummer"), F.col("source").alias("dokumentart"), F.lit(None).cast("string").alias("drucksachetyp"), F.left("text", F.lit(20)).alias("titel"))
    return E.candidate_rows(ranked, d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text"), named)
