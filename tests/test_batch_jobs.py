"""The runnable jobs: growing input, repeated and broken runs, odd rows, command lines, and their SQL."""

import json
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from oracle import connection, rows_of, rows_of_sql
from pyspark.sql import functions as F

from jobs import passages, queries, retrieval_report
from jobs.common import options
from spindrift.operators import segment

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql(spark, small, name):
    assert rows_of(queries.QUERIES[name](spark, small)) == rows_of_sql(connection(small), queries.ORACLES[name])


def test_jobs_import_nothing_else():
    assert all("llm" not in p.read_text() and "corpus_pipeline" not in p.read_text() for p in (ROOT / "jobs").glob("*.py"))


# ---- passages


def put(spark, folder, name, rows):
    """A file of documents into a folder, as an upload would put it there."""
    aside = f"{folder}-{name}"
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(aside)
    Path(folder).mkdir(exist_ok=True)
    [part] = Path(aside).glob("part-*.parquet")
    shutil.copy(part, f"{folder}/{name}.parquet")


def doc(k, text, lang="de", source="s"):
    return (k, text, lang, source, None if text is None else len(text))


def long(k, n=40):
    return f"Der Antrag {k} befasst sich mit der Rente. " * n


def expected(spark, rows):
    """Passages of the rows that hold, cut at once."""
    cut = segment.segment_papers(spark.createDataFrame(rows, DOCS), "doc_id", keep=["lang", "source"])
    return sorted((r["document_id"], r["position"], r["text"], r["lang"], r["source"]) for r in cut.collect())


def held(spark, output):
    return sorted((r["doc_id"], r["position"], r["text"], r["lang"], r["source"]) for r in passages.current(spark, output).collect())


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


def test_only_new_files_are_cut(spark, tmp_path):
    docs, output, mark = (str(tmp_path / n) for n in ("docs", "output", "checkpoint"))
    first = [doc(k, long(k)) for k in range(20)] + [doc(30, None), doc(31, ""), doc(32, "zu kurz"), doc(None, long(77)), doc(None, None)]
    put(spark, docs, "1", first)
    assert passages.run(spark, docs, output, mark, 4) == {"batches": 1, "rows": 25, "documents": 23, "passages": len(expected(spark, first[:20])), "rejected": 2}
    assert held(spark, output) == expected(spark, first[:20])
    before = files(output)
    assert passages.run(spark, docs, output, mark, 4)["batches"] == 0 and files(output) == before
    # Changed, emptied, unchanged and new documents; one id twice; other languages.
    second = [doc(3, long("neu", 70), None), doc(4, ""), doc(5, long(5)), doc(50, long(50), "en"), doc(51, long("a")), doc(51, long("b")), doc(52, long(52)), doc(52, long(52)), doc(31, long(31))]
    put(spark, docs, "2", second)
    assert passages.run(spark, docs, output, mark, 4)["documents"] == 6
    assert all(files(output)[p] == t for p, t in before.items())
    got = held(spark, output)
    one = [r for r in second[4:6] if expected(spark, [r]) == [x for x in got if x[0] == 51]]
    now = [r for r in first[:20] if r[0] not in (3, 4)] + [second[0], second[3], *one, second[6], second[8]]
    assert len(one) == 1 and got == expected(spark, now)
    # A later file with the former text of a document counts again.
    put(spark, docs, "3", [first[3]])
    passages.run(spark, docs, output, mark, 4)
    assert held(spark, output) == expected(spark, [r for r in now if r[0] != 3] + [first[3]])


def test_batches_of_files_come_to_the_same(spark, tmp_path):
    docs = str(tmp_path / "docs")
    for n in range(5):
        put(spark, docs, str(n), [doc(k, long(f"{k}-{n}", 30 + n)) for k in range(n, 12, 2)])
        os.utime(f"{docs}/{n}.parquet", (1_700_000_000 + 100 * n, 1_700_000_000 + 100 * n))
    outs = []
    for size in (0, 1, 2):
        out = str(tmp_path / f"out{size}")
        done = passages.run(spark, docs, out, str(tmp_path / f"mark{size}"), 3, size)
        assert done["batches"] == {0: 1, 1: 5, 2: 3}[size]
        outs.append(held(spark, out))
    assert outs[0] == outs[1] == outs[2] == expected(spark, [doc(k, long(f"{k}-{n}", 30 + n)) for k in range(12) for n in [max(m for m in range(5) if k >= m and (k - m) % 2 == 0)]])


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_run_that_broke_off_is_taken_up(spark, tmp_path, monkeypatch, at):
    """The run fails before passages, before documents, or at the end of a batch: readers see the old state, and the next run makes it whole."""
    docs, output, mark = (str(tmp_path / n) for n in ("docs", "output", "checkpoint"))
    put(spark, docs, "1", [doc(k, long(k)) for k in range(6)])
    passages.run(spark, docs, output, mark)
    before = held(spark, output)
    put(spark, docs, "2", [doc(2, long("neu")), doc(9, long(9))])
    whole, calls = passages.stored, []

    def failing(*args):
        calls.append(args)
        if len(calls) == at:
            raise OSError("aus")
        return whole(*args)

    monkeypatch.setattr(passages, "stored", failing)
    with pytest.raises(Exception, match="aus"):
        passages.run(spark, docs, output, mark)
    monkeypatch.setattr(passages, "stored", whole)
    now = expected(spark, [doc(k, long(k)) for k in range(6) if k != 2] + [doc(2, long("neu")), doc(9, long(9))])
    assert held(spark, output) == (now if at == 3 else before)
    assert passages.run(spark, docs, output, mark)["batches"] == 1
    assert held(spark, output) == now


def test_an_empty_table(spark, tmp_path):
    put(spark, str(tmp_path / "docs"), "1", [])
    done = passages.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert done["documents"] == 0 and held(spark, str(tmp_path / "out")) == []


# ---- retrieval report

QUOTE = "die Rente der Bäcker in Ötigheim steigt"


def report(spark, tmp_path, rows, asked, **more):
    docs, questions = str(tmp_path / "d.parquet"), str(tmp_path / "q.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.mode("overwrite").parquet(docs)
    spark.createDataFrame(asked, "item_id long, text string").write.mode("overwrite").parquet(questions)
    return retrieval_report.run(spark, docs, questions, str(tmp_path / "out"), **more)


def judged(spark, tmp_path, label="current"):
    return {r["item_id"]: (r["outcome"], r["n_targets"], r["first_rank"]) for r in retrieval_report.judged(spark, str(tmp_path / "out"), label).collect()}


def test_report_of_odd_rows(spark, tmp_path):
    rows = [(k, f"Ein Satz über {w} und mehr.", "de") for k, w in enumerate(["Miete", "Haushalt", "Wald"] * 10)] + [(100, f"Sie sagte: {QUOTE}. Ja.", "de"), (101, f"Auch: {QUOTE.upper()}!", None), (102, None, "de"), (103, "", "de"), (None, QUOTE, "de")]
    asked = [(1, QUOTE), (2, ""), (3, None), (4, "Wald"), (5, "der die das"), (6, "nirgends steht das"), (None, "Wald"), (7, "Rente Bäcker")]
    told = report(spark, tmp_path, rows, asked, top_k=5)
    got = judged(spark, tmp_path)
    assert got[1] == ("hit", 2, 1) and got[4] == ("hit", 10, 1) and {got[k][0] for k in (2, 3, 5, 6, 7)} == {"no_target"} and len(got) == 7
    assert told["fragen"] == 2 == told["treffer"] and told["documents"] == 34
    ranking = spark.read.parquet(str(tmp_path / "out" / "ranking" / "run=current")).collect()
    assert max(Counter(r["item_id"] for r in ranking).values()) == 5 and all(r["doc_id"] is not None for r in ranking)
    # A target that is not among the first is a miss; another run does not touch this one.
    before = files(tmp_path / "out" / "judged" / "run=current")
    report(spark, tmp_path, [(k, f"Wald Wald {k}", "de") for k in range(9)] + [(50, "der Wald steht hier mit vielen anderen Worten und noch mehr davon", "de")], [(4, "der Wald steht")], label="b", top_k=2)
    assert files(tmp_path / "out" / "judged" / "run=current") == before and judged(spark, tmp_path, "b")[4][0] in ("hit", "miss")
    assert json.loads(next(Path(tmp_path / "out" / "report" / "run=b").glob("part-*")).read_text())["questions"] == 1


def test_a_run_again_writes_the_same(spark, tmp_path):
    rows, asked = [(k, f"wort{k % 5} und wort{k % 3}", "de") for k in range(60)], [(k, f"wort{k}") for k in range(8)]
    first = report(spark, tmp_path, rows, asked), judged(spark, tmp_path)
    assert (report(spark, tmp_path, rows, asked), judged(spark, tmp_path)) == first
    assert report(spark, tmp_path, [], asked)["treffer"] == 0 and {o for o, *_ in judged(spark, tmp_path).values()} == {"no_target"}
    assert report(spark, tmp_path, rows, [])["fragen"] == 0 and judged(spark, tmp_path) == {}


def test_a_set_beyond_the_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval_report, "QUESTIONS", 3)
    with pytest.raises(ValueError, match="sets of at most 3"):
        report(spark, tmp_path, [(1, "a", "de")], [(k, "a") for k in range(4)])


# ---- command lines


def test_options(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": "", "buckets": 16, "label": "x"}))
    assert options(["--documents", "in", "--buckets", "3"], config, "w") == {"documents": "in", "buckets": 3, "label": "x"}
    other = tmp_path / "d.json"
    other.write_text(json.dumps({"documents": "there", "buckets": 1, "label": ""}))
    assert options(["--config", str(other), "--label", "y"], config, "w") == {"documents": "there", "buckets": 1, "label": "y"}
    with pytest.raises(SystemExit):
        options([], config, "w")


def test_command_line(spark, tmp_path):
    put(spark, str(tmp_path / "docs"), "1", [doc(k, long(k)) for k in range(3)])
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_LOCAL_DIRS": str(tmp_path)}
    done = subprocess.run([sys.executable, "-m", "jobs.passages", "--documents", str(tmp_path / "docs"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark"), "--buckets", "2"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 3 rows, cut 3 documents" in done.stderr
    assert spark.read.parquet(str(tmp_path / "out" / "passages")).select(F.count_distinct("doc_id")).first()[0] == 3


def test_scores_are_summed_where_a_document_lies(spark):
    """Only the best of each question leave a task: no pair of question and document is shuffled before its rank."""
    per = spark.createDataFrame([("a", 1, 1.0, 3), ("b", 1, 2.0, 3), ("a", 2, 1.0, 2)], "term string, chunk_id long, tf double, size long")
    asked = spark.createDataFrame([(7, "a"), (7, "b"), (8, "a")], "frage_id long, term string")
    found = retrieval_report.ranked(per, asked, per.groupBy("term").count().withColumnRenamed("count", "ndoc"), 2, 2.5, 1)
    assert sorted((r["frage_id"], r["dokument"]) for r in found.collect()) == [(7, 1), (8, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and not re.search(r"hashpartitioning\(frage_id#\d+L?, chunk_id", plan)
