"""The jobs as queries: each runs its function twice into one new folder of the shared one, and returns the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import passages, retrieval_report
from spindrift.plans.catalogue import load
from spindrift.plans.queries_retrieval import _STOP_SQL, _tok
from spindrift.shipping import shared_folder


def job1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stream; the second run finds nothing new. The files stay."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        passages.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return passages.current(spark, f"{folder}/output").select("doc_id", "position", "text", "n_chars", "lang", "source")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items over all documents; the second run writes the same again. The files stay."""
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return retrieval_report.judged(spark, folder)


JOB1_SQL = f"""select doc_id, position, p.text, length(p.text)::int as n_chars, lang, source from ({load()["segment_papers"].sql}) p join documents using (doc_id)"""
JOB2_SQL = rf"""
with qw as (select item_id, list_filter(regexp_extract_all(regexp_replace(text, '["''()*:^-]', ' ', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: lower(w) not in ({_STOP_SQL})) as us,
  regexp_extract_all(regexp_replace(text, '["''()*:^-]', ' ', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}') as ws, {_tok('text')} as ts from benchmark),
asked as (select distinct item_id, strip_accents(lower(w)) as term from (select item_id, unnest(list_slice(case when len(us) > 0 then us else ws end, 1, 32)) as w from qw)),
docs as (select doc_id, {_tok('text')} as ts from documents),
size as (select doc_id, len(ts) as size, ' ' || array_to_string(ts, ' ') || ' ' as line from docs),
stats as (select count(*) as n, avg(size) as mean from size),
per as (select doc_id, term, count(*)::double as tf from (select doc_id, unnest(ts) as term from docs) where term in (select term from asked) group by all),
df as (select term, count(*) as df from per group by term),
scores as (select item_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) as score
  from asked join per using (term) join df using (term) join size using (doc_id), stats group by item_id, doc_id),
ranked as (select item_id, doc_id, round(score, 6) as score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from scores qualify rank <= 20),
goals as (select item_id, doc_id from qw join size on contains(line, ' ' || array_to_string(qw.ts, ' ') || ' ') where len(qw.ts) > 0),
counted as (select item_id, count(*) as n_targets, min(rank)::int as first_rank from goals left join ranked using (item_id, doc_id) group by item_id)
select q.item_id, coalesce(n_targets, 0)::bigint as n_targets, first_rank, r.doc_id as best_doc, r.score as best_score,
  case when n_targets is null then 'no_target' when first_rank is null then 'miss' else 'hit' end as outcome
from qw q left join counted using (item_id) left join ranked r on r.item_id = q.item_id and r.rank = 1"""

QUERIES = {"job1_passages": job1_passages, "job2_retrieval_report": job2_retrieval_report}
ORACLES = {"job1_passages": JOB1_SQL, "job2_retrieval_report": JOB2_SQL}
