"""Queries of scans, filters, upserts, resync, queues and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators.segment import chunk_id
from ..profiles import CHUNK_PLACES
from ..shipping import remove, shared_folder
from ..sources import jsonl
from ..sources.tables import bucket_of, read
from .catalogue import query


@query("scan_project_filter", "select c_custkey, c_name, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' and c_acctbal > 0")
def scan_project_filter(spark, sf):
    c = read(spark, sf, "customer").where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0))
    return c.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "c_mktsegment")


@query("date_range_filter", "select o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') as datum from orders where o_orderpriority = '1-URGENT' and o_orderdate::date >= date '1996-01-01' and o_orderdate::date <= date '1996-12-31'")
def date_range_filter(spark, sf):
    o = read(spark, sf, "orders")
    # Bounds on the stored column itself reach the scan.
    day = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")
    kept = o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= day[0]) & (F.col("o_orderdate") < day[1]))
    return kept.select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("datum"))


@query("optional_filter", "select doc_id from documents where ('de' is null or lang = 'de') and (null is null or source = null)")
def optional_filter(spark, sf):
    """A filter that is given and one that is not."""
    kept = read(spark, sf, "documents")
    for column, value in (("lang", "de"), ("source", None)):
        if value is not None:
            kept = kept.where(F.col(column) == value)
    return kept.select("doc_id")


@query("membership", "select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1) as toxic from documents d where doc_id in (select doc_id from labels) and doc_id not in (1, 2, 3)")
def membership(spark, sf):
    d, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    toxic = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return d.where(~F.col("doc_id").isin(1, 2, 3)).join(toxic, "doc_id").select("doc_id", "toxic")


def _raw(spark, sf):
    """Each document as a raw record of some versions: what was edited later has a later date and a longer text."""
    d = read(spark, sf, "documents")
    versions = d.select("*", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("v"))
    text = F.when((F.col("doc_id") % 11 == 0), F.lit("")).otherwise(F.concat("text", F.repeat(F.lit("."), F.col("v"))))
    return versions.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).when(F.col("doc_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.lit("Drucksache")).alias("dokumentart"),
        F.concat(F.lit("21/"), F.col("doc_id").cast("string")).alias("dokumentnummer"), F.lit(None).cast("string").alias("drucksachetyp"),
        F.concat(F.lit(" Titel\r\n"), F.col("v").cast("string"), F.lit(" ")).alias("titel"), F.lit(None).cast("string").alias("datum"), F.lit(21).alias("wahlperiode"),
        F.col("source").alias("herausgeber"), F.concat(F.lit("2025-01-0"), (F.col("v") + 1).cast("string")).alias("aktualisiert"), text.alias("text"),
        F.struct(F.lit("Plenarprotokoll").alias("dokumentart"), F.lit("2025-02-03").alias("datum"), F.concat(F.lit("u/"), F.col("v").cast("string")).alias("pdf_url")).alias("fundstelle"),
        F.col("v").alias("seq"),
    )


_VERSIONS_SQL = """r as (select doc_id, source, unnest(range(0, (doc_id % 3)::int + 1)) as v, text from documents),
raw as (select doc_id as id, v, case when doc_id % 4 in (0, 1) then 'Plenarprotokoll' else 'Drucksache' end as dokumentart, '21/' || doc_id as dokumentnummer, 'Titel ' || v as titel, '2025-02-03' as datum, source as herausgeber,
  '2025-01-0' || (v + 1) as aktualisiert, 'u/' || v as pdf_url, case when doc_id % 11 = 0 then '' else text || repeat('.', v) end as text from r),
inc as (select *, length(text)::int as text_len, case when text = '' then 'pending' else 'fetched' end as status from raw),
newest as (select * from inc qualify row_number() over (partition by id order by v desc) = 1)"""


@query("title_and_fallbacks", f"with {_VERSIONS_SQL} select id, v::int as v, dokumentart, titel, datum, status from inc")
def title_and_fallbacks(spark, sf):
    return M.incoming(_raw(spark, sf)).select("id", F.col("seq").cast("int").alias("v"), "dokumentart", "titel", "datum", "status")


def _stored(spark, sf):
    """What a first harvest of the even documents has left: their first version, all cut."""
    first = M.incoming(_raw(spark, sf).where("seq = 0 and id % 2 = 0")).drop("text", "seq")
    return first.withColumn("chunked_at", F.lit("2025-01-01 00:00:00").cast("timestamp"))


@query("upsert_latest_wins", f"""with {_VERSIONS_SQL},
stored as (select * from inc where v = 0 and id % 2 = 0)
select n.id, n.dokumentart, n.herausgeber, case when ch then n.titel else s.titel end as titel, case when ch then n.pdf_url else s.pdf_url end as pdf_url,
  case when ch then n.aktualisiert else s.aktualisiert end as aktualisiert, case when ch then n.text_len else s.text_len end as text_len, case when ch then n.status else s.status end as status, ch as changed, not ch as cut
from (select n.id as nid, s.id is null or s.aktualisiert <> n.aktualisiert or s.text_len <> n.text_len as ch from newest n left join stored s on s.id = n.id) x
join newest n on n.id = nid left join stored s on s.id = nid""")
def upsert_latest_wins(spark, sf):
    new = M.latest(M.incoming(_raw(spark, sf))).drop("text", "seq")
    out = M.upsert(_stored(spark, sf), new)
    return out.select("id", "dokumentart", "herausgeber", "titel", "pdf_url", "aktualisiert", "text_len", "status", "changed", F.col("chunked_at").isNotNull().alias("cut"))


@query("status_assignment", f"with {_VERSIONS_SQL} select status, count(*)::bigint as n, sum(text_len)::bigint as zeichen from newest group by status")
def status_assignment(spark, sf):
    return M.latest(M.incoming(_raw(spark, sf))).groupBy("status").agg(F.count("*").alias("n"), F.sum("text_len").alias("zeichen"))


def _lines(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.posexplode_outer(F.split("text", "\n", -1)).alias("position", "text"))


_LINES_SQL = "lines as (select doc_id as document_id, (i - 1)::int as position, ls[i] as text from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))"
_TARGET_SQL = "target as (select document_id, position, case when document_id % 7 = 0 and position = 0 then 'x' || text else text end as text from lines where document_id % 5 <> 0 and not (document_id % 3 = 0 and position = 1) union all select -document_id - 1, position, text from lines where document_id % 10 = 0)"


def _target(spark, sf):
    """A serving copy that lacks documents, chunks and an edit, and has documents that are gone."""
    l = _lines(spark, sf)  # noqa: E741
    old = l.where((F.col("document_id") % 5 != 0) & ~((F.col("document_id") % 3 == 0) & (F.col("position") == 1)))
    old = old.withColumn("text", F.when((F.col("document_id") % 7 == 0) & (F.col("position") == 0), F.concat(F.lit("x"), "text")).otherwise(F.col("text")))
    gone = l.where(F.col("document_id") % 10 == 0).withColumn("document_id", -F.col("document_id") - 1)
    return old.unionByName(gone)


def _resync_sql(digest: str) -> str:
    side = lambda t: f"select document_id, {digest} as h from {t} group by document_id"
    return f"with {_LINES_SQL}, {_TARGET_SQL}, s as ({side('lines')}), t as ({side('target')}) select coalesce(s.document_id, t.document_id) as document_id, case when s.document_id is null then 'delete' else 'replace' end as action from s full join t on s.document_id = t.document_id where s.h is distinct from t.h"


query("resync_diff", _resync_sql("string_agg(position || ':' || text, chr(1) order by position)"))(lambda spark, sf: M.resync(_lines(spark, sf), _target(spark, sf)))


@query("resync_tree", _resync_sql("string_agg(position || ':' || text, chr(1) order by position)"))
def resync_tree(spark, sf):
    """``resync_diff`` by digests: buckets first, then the documents of unequal ones."""
    shared_folder(spark)
    kept, bucket = [M.content_hash(c).checkpoint() for c in (_lines(spark, sf), _target(spark, sf))], bucket_of(F.col("document_id"))
    unequal = M.unequal_buckets(*kept, bucket)
    return M.differences(*[d.where(bucket.isin(unequal)) for d in kept])


query("resync_by_count", _resync_sql("count(*)"))(lambda spark, sf: M.resync(_lines(spark, sf), _target(spark, sf), "count"))


@query("replace_changed_docs", f"with {_LINES_SQL}, {_TARGET_SQL}, changed as (select document_id from lines where document_id % 3 = 0) select document_id, position, text from target where document_id not in (select document_id from changed) union all select document_id, position, text from lines where document_id in (select document_id from changed) and position % 2 = 0")
def replace_changed_docs(spark, sf):
    new = _lines(spark, sf).where("position % 2 = 0")
    changed = read(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"))
    return M.replace_chunks(_target(spark, sf), new, changed)


@query("resume_after_max", "select o_orderkey from orders where o_orderkey > (select max(o_orderkey) from orders where o_orderkey % 2 = 0 and o_orderkey < 5000)")
def resume_after_max(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    return M.resume(o, o.where("o_orderkey % 2 = 0 and o_orderkey < 5000"), "o_orderkey")


@query("embed_priority_queue", f"""with {_LINES_SQL},
g as (select document_id, count(*) as n from lines group by document_id)
select document_id * {CHUNK_PLACES} + position as chunk_id, (case when lang = 'de' then 0 when n < 8 then 1 else 2 end)::int as prioritaet
from lines join g using (document_id) join documents on doc_id = document_id where position % 4 <> 0""")
def embed_priority_queue(spark, sf):
    """The whole queue; a limit is an option of the job."""
    c = _lines(spark, sf).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("position")))
    done = c.where("position % 4 = 0").select("chunk_id")
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "de", "Plenarprotokoll").otherwise("Drucksache").alias("dokumentart"))
    return M.embed_queue(c, d, done, small=8)


@query("index_stats", f"with {_VERSIONS_SQL}, {_LINES_SQL} select (select count(*) from newest) as documents, (select count(*) from newest where status = 'pending') as ohne_volltext, (select count(*) from newest where id % 2 = 0 and status <> 'pending') as gechunkt, (select count(*) from lines) as chunks, (select count(*) from lines where position % 2 = 0) as chunks_mit_embedding, (select count(*) from embeddings) as vektoren")
def index_stats(spark, sf):
    d = M.latest(M.incoming(_raw(spark, sf))).withColumn("status", F.when((F.col("status") == "fetched") & (F.col("id") % 2 == 0), "chunked").otherwise(F.col("status")))
    c = _lines(spark, sf).withColumn("embedded", F.col("position") % 2 == 0)
    return M.stats(d, c, read(spark, sf, "embeddings"))


@query("duplicate_positions", f"with {_LINES_SQL}, {_TARGET_SQL}, u as (select * from lines union all select * from target) select document_id, position, count(*)::bigint as n from u group by all having count(*) > 1")
def duplicate_positions(spark, sf):
    return M.duplicate_positions(_lines(spark, sf).unionByName(_target(spark, sf)))


@query("orphan_chunks", f"with {_LINES_SQL}, {_TARGET_SQL} select document_id, position, text from target where document_id not in (select doc_id from documents)")
def orphan_chunks(spark, sf):
    return M.orphans(_target(spark, sf), read(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query("harvest_latest_wins", """select doc_id as id, 'Titel ' || doc_id || case when doc_id % 3 = 0 then ' neu' else '' end as titel, case when doc_id % 3 = 0 then 'b' else 'a' end as aktualisiert, case when doc_id % 3 = 0 then length(text || '!') else length(text) end as text_len from documents where doc_id % 2 = 0
union all select doc_id, 'Titel ' || doc_id, 'a', length(text) from documents where doc_id % 2 = 1""")
def harvest_latest_wins(spark, sf):
    """Two harvests of a kind and one of another, written as JSON lines and read again: the later version of a document stays, other kinds are untouched."""
    d = read(spark, sf, "documents")
    raw = f"{shared_folder(spark)}/harvest-{uuid.uuid4().hex}"

    def records(rows, version, more, end):
        return rows.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Titel "), F.col("doc_id").cast("string"), F.lit(more)).alias("titel"), F.lit(version).alias("aktualisiert"), F.concat("text", F.lit(end)).alias("text"))

    even, odd = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    jsonl.write(records(odd, "a", "", ""), raw, "plenarprotokoll", 21)
    jsonl.write(records(even, "0", " alt", "?"), raw, "drucksache", 21)
    jsonl.write(records(even, "a", "", ""), raw, "drucksache", 21)
    jsonl.write(records(even.where("doc_id % 3 = 0"), "b", " neu", "!"), raw, "drucksache", 21, since="2025-01-01")
    out = M.latest(M.incoming(jsonl.read(spark, raw))).select("id", "titel", "aktualisiert", "text_len").checkpoint()
    remove(spark, raw)
    return out
