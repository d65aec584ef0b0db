"""What happens to a model's answer: parsing, citations, sources, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .fusion import MARK_OFF, MARK_ON

# Kinds that a filter may name, the mark between short and long answer, no-hit texts by language.
KINDS = ("Drucksache", "Plenarprotokoll")
SPLIT = "@@@"
CITATION = r"\[(\d{1,2})\]"
LANGUAGES = ("de", "en", "ls")


def analysis(raw: Column, question: Column) -> Column:
    """(suchbegriffe, dokumentart) from a model's answer: its ``{...}``, else the raw question and no filter."""
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "suchbegriffe string, dokumentart string", {"mode": "PERMISSIVE"})
    return F.struct(
        F.coalesce(F.nullif(parsed["suchbegriffe"], F.lit("")), question).alias("suchbegriffe"),
        F.when(parsed["dokumentart"].isin(*KINDS), parsed["dokumentart"]).alias("dokumentart"),
    )


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Each ``{name}`` of a template by its value, literally, its first occurrence only."""
    for name, value in values.items():
        sign = "{" + name + "}"
        at = F.instr(template, sign)
        template = F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), value, F.substring(template, at + len(sign), F.length(template)))).otherwise(template)
    return template


def visible_text(parts: Column) -> Column:
    """Text of a message's parts (text, thought) without thoughts."""
    return F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def split_answer(text: Column, running: Column | bool = False) -> Column:
    """(kurz, lang) at the first ``@@@``. Without one a running answer is still its short part, a finished one all long."""
    live = F.lit(running) if isinstance(running, bool) else running
    at = F.instr(text, SPLIT)
    short = F.when(at > 0, strip(F.substring(text, F.lit(1), at - 1))).when(live, F.regexp_replace(text, r"(?U)^\s+", "")).otherwise("")
    long = F.when(at > 0, strip(F.substring(text, at + len(SPLIT), F.length(text)))).when(live, "").otherwise(strip(text))
    return F.struct(short.alias("kurz"), long.alias("lang"))


def citations(text: Column) -> Column:
    """Distinct numbers ``[n]`` of an answer, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))))


def visible_sources(sources: Column, cited: Column) -> Column:
    """Sources (with ``nummer``) that are cited, or all if none is."""
    hit = F.filter(sources, lambda s: F.array_contains(cited, s["nummer"]))
    return F.when(F.size(hit) > 0, hit).otherwise(sources)


def documents_of(sources: Column) -> Column:
    """How many documents sources are from."""
    return F.size(F.array_distinct(F.transform(sources, lambda s: F.concat(s["dokumentart"], F.lit(" "), s["dokumentnummer"]))))


def cited_documents(sources: Column, cited: Column) -> Column:
    """Distinct ``{dokumentart} {dokumentnummer}`` of cited sources, in order."""
    hit = F.filter(sources, lambda s: F.array_contains(cited, s["nummer"]))
    return F.array_distinct(F.transform(hit, lambda s: F.concat(s["dokumentart"], F.lit(" "), s["dokumentnummer"])))


def grouped_by_document(sources: DataFrame, by: list[str]) -> DataFrame:
    """Sources of one answer by document, in order of first sight: schluessel, erste, nummern."""
    key = F.concat("dokumentart", F.lit("-"), "dokumentnummer").alias("schluessel")
    return sources.groupBy(*by, key).agg(F.min("nummer").alias("erste"), F.array_sort(F.collect_list("nummer")).alias("nummern"))


def marked_runs(text: Column) -> Column:
    """(text, marked) runs of an excerpt that holds one marked sentence at most."""
    before = F.substring_index(text, MARK_ON, 1)
    rest = F.substring(text, F.length(before) + 2, F.length(text))
    inside = F.substring_index(rest, MARK_OFF, 1)
    after = F.substring(rest, F.length(inside) + 2, F.length(rest))
    runs = F.array(F.struct(before.alias("text"), F.lit(False).alias("marked")), F.struct(inside.alias("text"), F.lit(True).alias("marked")), F.struct(after.alias("text"), F.lit(False).alias("marked")))
    return F.when(F.instr(text, MARK_ON) > 0, F.filter(runs, lambda r: r["text"] != "")).otherwise(F.array(F.struct(text.alias("text"), F.lit(False).alias("marked"))))


def _tidy(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def without_citations(text: Column) -> Column:
    return _tidy(F.regexp_replace(text, r"(?U)\s*\[[0-9]{1,2}\]", ""))


def with_sources(text: Column, sources: Column) -> Column:
    """Citations of known sources replaced by `` (label: pdf_url)``, in one pass; unknown ones stay.

    Sources have nummer, drucksachetyp, dokumentart, dokumentnummer and pdf_url.
    """
    between = F.split(text, CITATION.replace("(", "").replace(")", ""), -1)
    numbers = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))

    def note(n: Column) -> Column:
        s = F.try_element_at(F.filter(sources, lambda s: s["nummer"] == n.cast("int")), F.lit(1))
        label = F.concat(F.coalesce(s["drucksachetyp"], s["dokumentart"]), F.lit(" "), s["dokumentnummer"])
        link = F.coalesce(F.concat(F.lit(": "), F.nullif(s["pdf_url"], F.lit(""))), F.lit(""))
        return F.when(s["nummer"].isNotNull(), F.concat(F.lit(" ("), label, link, F.lit(")"))).otherwise(F.concat(F.lit("["), n, F.lit("]")))

    notes = F.concat(F.transform(numbers, note), F.array(F.lit("")))
    return _tidy(F.array_join(F.zip_with(between, notes, lambda a, b: F.concat(a, b)), ""))


def readable_date(date: Column) -> Column:
    return F.date_format(date.cast("date"), "dd.MM.yyyy")


def language(asked: Column) -> Column:
    """A known language of the output, else ``de``."""
    return F.when(asked.isin(*LANGUAGES), asked).otherwise("de")


def history(entries: DataFrame, by: list[str], cap: int = 20) -> DataFrame:
    """Newest first, one entry for each question (trimmed, lower case), ``cap`` at most, with column ``platz``.

    Users' histories are windows of their own; what is kept of each is bounded by the cap.
    """
    same = Window.partitionBy(*by, F.lower(F.trim("frage"))).orderBy(F.col("zeitpunkt").desc(), F.col("id").desc())
    newest = entries.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("zeitpunkt").desc(), F.col("id").desc()))
    return newest.withColumn("platz", place).where(F.col("platz") <= cap)
