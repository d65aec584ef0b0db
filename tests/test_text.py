"""Golden cases and random strings for text repair and segmentation, against plain Python."""

import random
import re
import time

import pytest
from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import segment as S
from spindrift.plans.catalogue import load

GOLDEN = [
    ("Die Früh-\nstartrente kommt.", "Die Frühstartrente kommt."),
    ("Bundes- und\nBundes-\nund Länderebene", "Bundes- und Bundes- und Länderebene"),
    ("Ö\x00entlichkeit", "Öentlichkeit"),
    ("BÜNDNIS\xa090/DIE GRÜNEN", "BÜNDNIS 90/DIE GRÜNEN"),
    ("Soft\xadhyphen", "Softhyphen"),
    ("Inhalt . . . . . . 123\nKapitel", "Inhalt Kapitel"),
    ("Satz eins\ngeht weiter.\nSatz zwei.\n\nAbsatz.\n\n\nDritter.", "Satz eins geht weiter.\nSatz zwei.\nAbsatz.\n\nDritter."),
    ("a\r\nb\rc", "a b c"),
    ("  x  \n\t y", "x y"),
    ("", ""),
    (None, ""),
]


def one(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_normalize(spark):
    assert one(spark, [a for a, _ in GOLDEN], T.normalize(F.col("s"))) == [b for _, b in GOLDEN]


def random_texts(n, alphabet, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_random_reflow_and_strip(spark):
    texts = random_texts(400, list("ab.:! \t\n") + ["\n\n", "Ä", "…"], 1)

    def reflow(t):
        t = re.sub(r"(?<![.!?:;])\n(?!\n)", " ", t)
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", t))
        return "\n".join(x.strip() for x in t.split("\n")).strip()

    assert one(spark, texts, T.reflow(F.col("s"))) == [reflow(t) for t in texts]
    assert one(spark, texts, T.strip_lines(F.col("s"))) == ["\n".join(x.strip() for x in t.split("\n")) for t in texts]
    assert one(spark, texts, T.split_sentences(F.col("s"))) == [re.split(r"(?<=[.!?])\s+", t) for t in texts]
    assert one(spark, texts, T.split_paragraphs(F.col("s"))) == [re.split(r"\n\s*\n", t) for t in texts]


SPEAKERS = [
    ("Präsidentin Julia Klöckner:", ("Julia Klöckner", "Präsidentin", None)),
    ("Lars Klingbeil, Bundesminister der Finanzen:", ("Lars Klingbeil", "Bundesminister", None)),
    ("Max Muster (CDU/CSU):", ("Max Muster", None, "CDU/CSU")),
    ("Dr. A. B (BÜNDNIS 90/DIE GRÜNEN):  ", ("Dr. A. B", None, "BÜNDNIS 90/DIE GRÜNEN")),
    ("Eva Test, Parl. Staatssekretärin beim Bundesminister:", ("Eva Test", "Parl. Staatssekretärin", None)),
    ("Tagesordnungspunkt 3 (Fortsetzung):", None),
    ("Zusatzpunkt 8:", None),
    ("Er sagte: nein", None),
    ("(Beifall bei der SPD)", None),
    ("Vizepräsident Omid X: Danke", None),
]


def test_speaker_lines(spark):
    docs = spark.createDataFrame([(k, line) for k, (line, _) in enumerate(SPEAKERS)], "document_id long, text string")
    rows = {r["document_id"]: r for r in S.speaker_lines(docs).collect()}
    for k, (_, who) in enumerate(SPEAKERS):
        r = rows[k]
        assert r["is_speaker"] == (who is not None)
        if who:
            assert (r["redner"], r["rolle"], r["fraktion"]) == who


def numbered(r, first, chars, ends=True, gap=" "):
    """A piece of about so many characters whose words carry numbers from ``first`` on; the next number."""
    words, size = [], 0
    while size < chars:
        words.append(f"w{first:06d}x" + (r.choice([".", "!", "", "", ""]) if ends else ""))
        size, first = size + len(words[-1]) + len(gap), first + 1
    return gap.join(words), first


def numbers(text):
    return [int(n) for n in re.findall(r"w(\d{6})x", text)]


@pytest.mark.parametrize("ends", [True, False])
def test_what_packing_keeps(spark, ends):
    """Least and greatest sizes, order, all words whole, and overlaps that end the chunk before."""
    r, cases, counts = random.Random(7), [], []
    for _ in range(40):
        first, ps = 0, []
        for _ in range(r.randrange(1, 8)):
            piece, first = numbered(r, first, r.choice([130, 400, 1100, 1900, 2500, 9000]), ends)
            ps.append(r.choice(["", "  ", " \n"]) + piece + r.choice(["", " "]))
        cases.append(ps)
        counts.append(first)
    longest = S.LONG_SENTENCE + S.CHUNK_OVERLAP + 1
    for ps, count, chunks in zip(cases, counts, one(spark, cases, S.pack(F.col("s")), "s array<string>"), strict=True):
        assert all(S.CHUNK_MIN <= len(c) <= longest and c == c.strip() for c in chunks)
        # Above the target: a whole short piece, or one sentence with what leads to it.
        assert all(len(c) <= S.LONG_PIECE or not ends for c in chunks)
        seen = -1
        for before, c in zip(["", *chunks], chunks, strict=False):
            own = numbers(c)
            assert own == list(range(own[0], own[-1] + 1))
            lead = [n for n in own if n <= seen]
            assert lead == numbers(before)[len(numbers(before)) - len(lead) :] and sum(len(f"w{n:06d}x ") for n in lead) <= S.CHUNK_OVERLAP + 8
            assert own[-1] > seen and own[len(lead)] == seen + 1
            seen = own[-1]
        assert seen == count - 1


def test_packing_by_hand(spark):
    a, b, c = "a" * 598, "b" * 600, "c" * 601
    ten = ["x" * 99 + "." for _ in range(10)]
    cases = [
        ([], []),
        (["", "  "], []),
        (["a" * 119], []),
        (["a" * 120], ["a" * 120]),
        ([a, b], [f"{a}\n\n{b}"]),
        ([a, c], [a, c]),
        ([a, "", b, "d" * 120], [f"{a}\n\n{b}", "d" * 120]),
        (["p" * 1920], ["p" * 1920]),
        # Ten sentences of 100 with spaces between are 1009 characters; the twelfth would pass 1200.
        ([" ".join(ten + ten)], [" ".join(ten + ten[:1]), "x" * 98 + ". " + "x" * 99 + ". " + " ".join(ten[:9])]),
        ([a, " ".join(ten * 2), b], [a, " ".join(ten + ten[:1]), "x" * 98 + ". " + "x" * 99 + ". " + " ".join(ten[:9]), b]),
        (["z" * 2500], ["z" * 2400, "z" * 200 + " " + "z" * 100]),
    ]
    assert one(spark, [x for x, _ in cases], S.pack(F.col("s")), "s array<string>") == [y for _, y in cases]
    cut = one(spark, [["z" * 2500], ["k " * 1500], ["s" * 1200 + " " + "t" * 1300], ["s" * 1199 + " " + "t" * 1300], [""]], S.hard_split(F.col("s")), "s array<string>")
    assert [[len(x) for x in parts] for parts in cut] == [[2400, 100], [2399, 600], [1200, 1300], [2400, 100], []]


def test_segment_by_kind(spark):
    long = "Das ist ein Satz mit einigen Wörtern. " * 10
    docs = [
        (1, "Plenarprotokoll", f"Vorab {long}\nPräsidentin Julia Klöckner:\n{long}\nMax Muster (SPD):\nKurz."),
        (2, "Plenarprotokoll", f"Keine Sprecher.\n{long}"),
        (3, "Drucksache", long),
        (4, "Drucksache", None),
        (5, None, "zu kurz"),
    ]
    rows = S.segment(spark.createDataFrame(docs, "document_id long, dokumentart string, text string")).orderBy("document_id", "position").collect()
    assert [(r["document_id"], r["position"], r["redner"]) for r in rows] == [(1, 0, None), (1, 1, "Julia Klöckner"), (2, 0, None), (3, 0, None)]


@pytest.mark.parametrize(("text", "terms"), [("Wie ist das?", ["Wie", "ist", "das"]), ("Was kostet die Miete (in Berlin)?", ["kostet", "Miete", "Berlin"]), ("a b", []), ("", [])])
def test_match_terms(spark, text, terms):
    assert one(spark, [text], T.match_terms(F.col("s"))) == [terms]


def test_fold(spark):
    assert one(spark, ["Müller ÉLAN ñandú groß"], T.fold(F.col("s"))) == ["muller elan nandu groß"]


LONG_TEXTS = [(1, "Ein Satz mit Wort. " * 150 + "Ende"), (2, "kurz " * 30 + "\n" + "y" * 5000 + "\n" + "z" * 130), (3, "wort " * 700 + ". Und mehr. " * 40), (4, "zu kurz"), (5, None), (6, ""), (7, "a\n" * 90 + "b" * 1921 + "\n" + "Ja! " * 800)]


@pytest.mark.parametrize("name", ["pack_chunks", "pack_sentences", "segment_papers"])
def test_long_texts_by_sql(spark, tmp_path, name):
    """Long lines, overlong sentences and empty texts, which the test tables lack, by the query's own SQL."""
    import duckdb

    r, rows = random.Random(3), list(LONG_TEXTS)
    for k in range(60):
        parts = [numbered(r, 0, r.choice([20, 200, 900, 1300, 3000, 6000]), r.random() < 0.7, r.choice([" ", " ", "  "]))[0] for _ in range(r.randrange(1, 6))]
        rows.append((100 + k, r.choice(["\n", "\n\n", ".\n\n\n"]).join(parts)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    q = load()[name]
    got = rows_of(q.run(spark, str(tmp_path)))
    assert got == rows_of_sql(con, q.sql) and len({x[0] for x in got[1]}) > 50


def test_hard_cuts_across_blocks(spark):
    """Runs of white space and of letters that are longer than a block: pieces keep all characters but white space at cuts, start without it and stay in size."""
    n = S._BLOCK
    texts = ["a" * 2399 + " " * (2 * n) + "b" * 3000, " ".join(["wort"] * 9000), "z" * (3 * n + 17), "k " + "m" * (n - 2) + " " * 3 + "q" * 5000, "\u00a0 x" * 7000, ("y" * 1100 + "\n  ") * 40, "s" * n + " ", "\U0001f600" * (n + 5)]
    for text, parts in zip(texts, one(spark, [[t] for t in texts], S.hard_split(F.col("s")), "s array<string>"), strict=True):
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(p and len(p) <= S.LONG_SENTENCE for p in parts) and all(p == p.lstrip() for p in parts[1:])
        assert all(len(p) >= S.LONG_SENTENCE // 2 for p in parts[:-1])


def test_packing_costs_in_proportion_to_the_text(spark):
    """Ten million characters in short paragraphs, in sentences and without an end of a sentence."""
    sentence = "Der Antrag befasst sich mit der Rente und mit der Miete in allen Orten. "
    for unit in (sentence.strip() + "\n\n\n", sentence, "wort "):
        seconds = []
        for size in (1_000_000, 1_000_000, 9_700_000):
            d = spark.createDataFrame([(unit * (size // len(unit)),)], "s string")
            began = time.perf_counter()
            chunks = d.select(F.size(S.pack(T.split_paragraphs(F.col("s")))).alias("n")).first()["n"]
            seconds.append(time.perf_counter() - began)
            assert chunks >= size // S.LONG_SENTENCE
        assert seconds[2] < 10 and seconds[2] < 30 * max(seconds[1], 0.2)


def test_a_chain_of_conjunctions_keeps_its_hyphens(spark):
    """As the reference repairs it, whose test of the conjunction consumes nothing."""
    row = spark.createDataFrame([("das-\nund-\nund ist",)], "t string").select(T.dehyphenate(F.col("t"))).first()
    assert row[0] == "das- und- und ist"
