"""The index and the cells as data changes: against an index that is written anew, and against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import ann, semantic
from spindrift.plans import search
from spindrift.plans.queries_retrieval import chunks as lines
from spindrift.profiles import POSTGRES, SQLITE
from spindrift.sources import index, tables

QUESTIONS = ("the que and src3", "thonre is anly Die", "eins zwei former", "")


def states(spark, small):
    """Chunks before and after, and the ids of changed documents: some get another text, some go, some come."""
    now = lines(spark, small)
    d = F.col("document_id")
    before = now.where(d % 11 != 0).withColumn("text", F.when(d % 7 == 0, F.concat(F.lit("eins zwei former the "), "text")).otherwise(F.col("text")))
    extra = before.where(d == 1).withColumn("document_id", F.lit(10**6).cast("long")).withColumn("chunk_id", F.lit(10**13) + F.col("position"))
    changed = now.select("document_id").where((d % 7 == 0) | (d % 11 == 0)).distinct().union(spark.createDataFrame([(10**6,)], "document_id long"))
    return before.unionByName(extra), now, changed


def found(own, c, profile, q):
    asked = search.asked(c.sparkSession, q, profile)
    return [(r["chunk_id"], round(r["score"], 9)) for r in search.lexical_hits(c, asked, profile, index=own).orderBy("rank").collect()]


@pytest.mark.parametrize("few", [0, 1000])
def test_a_segment_of_changes_gives_the_scores_of_a_new_index(spark, small, tmp_path, few, monkeypatch):
    monkeypatch.setattr(index, "FEW", few)
    before, now, changed = states(spark, small)
    delta, anew = str(tmp_path / "delta"), str(tmp_path / "anew")
    index.write(before, delta, 5, "a")
    index.write(now, anew, 5)
    index.update(now, changed, delta, "b")
    own, fresh = index.read(spark, delta), index.read(spark, anew)
    assert own.segments == (0, 1) and own.state == "b" and (own.count, own.mean) == (fresh.count, fresh.mean)
    for profile in (SQLITE, POSTGRES):
        for q in QUESTIONS:
            assert found(own, now, profile, q) == found(fresh, now, profile, q)
    assert own.of_terms(own.frequency, ["former", "zwei"]).count() == 0
    assert sorted(r["chunk_id"] for r in own.chunks.select("chunk_id").collect()) == sorted(r["chunk_id"] for r in now.select("chunk_id").collect())
    assert own.of_documents([7, 11, 10**6]).count() == now.where("document_id in (7, 11)").count()
    # A second segment for the same documents, and one of no change.
    index.update(before, changed, delta, "c")
    index.update(now, changed, delta, "d")
    index.update(now, changed.where("false"), delta, "e")
    own = index.read(spark, delta)
    assert own.segments == (0, 1, 2, 3) and own.state == "e" and own.count == fresh.count
    index.compact(spark, delta)
    one = index.read(spark, delta)
    assert len(one.segments) == 1 and one.gone is None and (one.count, one.mean) == (fresh.count, fresh.mean)
    for held in (own, one):
        assert found(held, now, SQLITE, QUESTIONS[0]) == found(fresh, now, SQLITE, QUESTIONS[0])
    assert index.sweep(spark, delta) == [0, 1, 2, 3]
    assert found(one, now, POSTGRES, QUESTIONS[1]) == found(fresh, now, POSTGRES, QUESTIONS[1])


def test_texts_are_not_read_for_a_question(spark, small, tmp_path):
    before, now, changed = states(spark, small)
    index.write(before, str(tmp_path / "i"), 5)
    index.update(now, changed, str(tmp_path / "i"))
    own = index.read(spark, str(tmp_path / "i"))
    plan = search.lexical_hits(own.chunks, search.asked(spark, QUESTIONS[0], SQLITE), SQLITE, index=own)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "documents.parquet" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("at", [0, 1])
def test_an_update_that_broke_off_leaves_the_index(spark, small, tmp_path, monkeypatch, at):
    before, now, changed = states(spark, small)
    folder = str(tmp_path / "i")
    index.write(before, folder, 3)
    was = found(index.read(spark, folder), before, SQLITE, QUESTIONS[0])
    monkeypatch.setattr(*[(index, "_frequencies", None), (tables, "replace", None)][at])
    with pytest.raises(TypeError):
        index.update(now, changed, folder)
    monkeypatch.undo()
    assert found(index.read(spark, folder), before, SQLITE, QUESTIONS[0]) == was
    index.update(now, changed, folder)
    index.write(now, str(tmp_path / "anew"), 3)
    assert found(index.read(spark, folder), now, SQLITE, QUESTIONS[0]) == found(index.read(spark, str(tmp_path / "anew")), now, SQLITE, QUESTIONS[0])


def test_words_are_those_of_the_folded_text(spark):
    """One pass over the texts folds words one by one; that is what tokens of the folded text are."""
    rows = [(1, "Ätna naïve İstanbul ΆΣ Ǆ é ΅ straße ẞ Ç-ç ẍ́y", "Müller"), (2, "", None), (3, None, "")]
    c = spark.createDataFrame(rows, "chunk_id long, text string, redner string")
    from spindrift.operators import lexical

    key = lambda r: (r["term"], r["chunk_id"], r["tf"], r["hits"], r["size"])
    assert sorted(map(key, index.terms_of(c).where("kind = 'word'").collect())) == sorted(map(key, lexical.postings(c, sizes=True).collect()))


# ---- cells


def clustered(spark, n=600, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims)) * 3
    rows = [(k, (middle[k % 12] + rng.normal(size=dims) * 0.3).tolist(), "ab"[k % 12 % 2], k % 30) for k in range(n)]
    rows += [(9000, None, "a", 1), (9001, [], "a", 1), (9002, [0.0] * dims, "a", 1), (9003, [float("nan")] * dims, "b", 1), (9004, rows[5][1], None, None), (9005, rows[5][1], "a", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dokumentart string, day int")
    return df.select("vec_id", "embedding", "dokumentart", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("datum")), middle


FILTERS = [{"dokumentart": "a"}, {"dokumentart": "b", "datum_von": "2024-01-10"}, {"datum_von": "2024-01-05", "datum_bis": "2024-01-06"}, {"dokumentart": "keine"}]


def test_a_filtered_search_by_cells_is_exact(spark, tmp_path):
    v, middle = clustered(spark)
    folder = str(tmp_path / "c")
    ann.write(v.where("vec_id % 3 <> 0"), folder, 12)
    ann.append(v.where("vec_id % 3 = 0"), folder)
    own = ann.read(spark, folder)
    assert own.vectors.count() == v.count()
    near = lambda df: [(r["vec_id"], round(r["distance"], 9)) for r in df.collect()]
    asked = v.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for f in FILTERS:
        keep, may = search.filters(**f), search.zones(**f)
        for metric in ("cosine", "l2"):
            sound = v.where("vec_id <> 9003")
            for q, limit in ((middle[3].tolist(), 7), (middle[0].tolist(), 400), ([0.0] * 8, 3)):
                assert near(ann.nearest_filtered(own, q, limit, keep & F.expr("vec_id <> 9003"), metric, may)) == near(semantic.nearest(sound, q, limit, metric, keep))
            got = ann.nearest_filtered_per_query(own, asked, 5, keep & F.expr("vec_id <> 9003"), metric, may, places=9)
            want = semantic.nearest_per_query(sound.where(keep), asked, 5, metric, places=9)
            key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["distance"])
            assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert ann.nearest_filtered(own, [1.0] * 8, 3, F.lit(False)).count() == 0


def test_a_filtered_search_reads_some_cells(spark, tmp_path, monkeypatch):
    v, middle = clustered(spark)
    ann.write(v, str(tmp_path / "c"), 12)
    own, read, whole = ann.read(spark, str(tmp_path / "c")), [], semantic.nearest
    monkeypatch.setattr(semantic, "nearest", lambda rows, *a: (read.append(rows.count()), whole(rows, *a))[1])
    ann.nearest_filtered(own, middle[2].tolist(), 5, search.filters("a"), "cosine", search.zones("a"))
    assert 0 < sum(read) < v.count() / 2
    # Cells of vectors of another kind alone are left out.
    able = ann._able(own, search.zones("a"))
    assert able.sum() < (own.reach[:, 0] > 0).sum()


def test_bounds_hold_for_every_vector(spark, tmp_path):
    v, _ = clustered(spark, 300, 5, 9)
    ann.write(v, str(tmp_path / "c"), 7)
    own = ann.read(spark, str(tmp_path / "c"))
    rows = [(np.array(r["embedding"]), r["cell"]) for r in own.vectors.where("cell >= 0 and vec_id < 9000").collect()]
    q = np.random.default_rng(1).normal(size=(20, 5))
    for metric in ("cosine", "l2"):
        least = ann._bounds(own, q, metric)
        for x, cell in rows:
            d = np.linalg.norm(q - x, axis=1) if metric == "l2" else 1 - q @ x / np.linalg.norm(q, axis=1) / np.linalg.norm(x)
            assert (least[:, cell] <= d + 1e-12).all()


def test_a_word_is_stemmed_once(spark, monkeypatch):
    """The vocabulary goes through Python, not each occurrence: the step of stems stands behind the distinct words."""
    from spindrift.functions import german

    rows = spark.createDataFrame([("häuser",), ("häuser",), ("und",), ("rente",), (None,)], "term string")
    found = german.stems(rows)
    assert sorted(map(tuple, found.collect())) == [("häuser", "haus"), ("rente", "rent")]
    plan = found.where("stem is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate") and "Python" not in plan[plan.index("Aggregate") :]


def test_parts_grow_with_the_table(spark, small, tmp_path, monkeypatch):
    """Tasks take bounded texts and rows, whatever the number of shuffle partitions; which stays as it was, and scores too."""
    now = lines(spark, small)
    index.write(now, str(tmp_path / "a"), 3)
    monkeypatch.setattr(index, "TASK_TEXT", 20_000)
    monkeypatch.setattr(index, "TASK_ROWS", 2_000)
    parts, put, cut = [], index._put, index.terms_of
    monkeypatch.setattr(index, "_put", lambda *a: (parts.append(a[-1]), put(*a))[1])
    monkeypatch.setattr(index, "terms_of", lambda c, parts: (made.append(parts), cut(c, parts=parts))[1])
    made = []
    index.write(now, str(tmp_path / "b"), 3)
    size = now.selectExpr("sum(octet_length(text) + octet_length(redner))").first()[0]
    rows = index.read(spark, str(tmp_path / "b")).postings.count()
    assert made == [-(-size // 20_000)] and parts == [max(4, -(-size // 160_000)), *[-(-rows // 2_000)] * 3] and min(made + parts[1:]) > 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    for profile in (SQLITE, POSTGRES):
        for q in QUESTIONS:
            assert found(index.read(spark, str(tmp_path / "b")), now, profile, q) == found(index.read(spark, str(tmp_path / "a")), now, profile, q)


def test_postings_lie_in_blocks(spark, small, tmp_path):
    """Postings of a term that are cut in one task are a row of bounded size; opened, also after a compaction, they are those of the texts. Stems are those of a join with the vocabulary."""
    from spindrift.functions import german
    from spindrift.functions.text import word_tokens
    from spindrift.operators import lexical

    before, now, changed = states(spark, small)
    folder, anew = str(tmp_path / "i"), str(tmp_path / "anew")
    index.write(before, folder, 3)
    index.update(now, changed, folder)
    index.compact(spark, folder)
    index.write(now, anew, 3)
    key = lambda rows, *c: sorted(tuple(r[x] for x in c) for r in rows.collect())
    words = key(lexical.postings(now, sizes=True), "term", "chunk_id", "tf", "hits", "size")
    stems = key(german.stemmed_postings(lexical.postings(now, tokens=word_tokens)), "term", "chunk_id", "hits")
    for own in (index.read(spark, folder), index.read(spark, anew)):
        assert key(own.postings, "term", "chunk_id", "tf", "hits", "size") == words
        assert key(own.stems, "term", "chunk_id", "hits") == stems
    blocks = spark.read.parquet(f"{anew}/postings")
    told = blocks.selectExpr("max(n)", "sum(n)", "count(*)", "min(first = ids[0])", "sum(total)").first()
    assert 1 < told[0] <= index.BLOCK and told[1] == len(words) and told[2] < len(words) / 2 and told[3] and told[4] == sum(w[3] for w in words)
    assert spark.read.parquet(f"{anew}/stems").where("tf is not null or size is not null").count() == 0


def test_an_index_of_another_format_is_none(spark, small, tmp_path, monkeypatch):
    now, folder = lines(spark, small).where("document_id < 5"), str(tmp_path / "i")
    monkeypatch.setattr(index, "FORMAT", 1)
    index.write(now, folder, 2)
    monkeypatch.undo()
    assert index.read(spark, folder) is None
    index.write(now, folder, 2)
    assert index.read(spark, folder).chunks.count() == now.count()
