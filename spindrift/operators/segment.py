"""Documents into chunks, and transcripts into speeches first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, STRIPPED, normalize, prepare, reflow, split_paragraphs, split_sentences, strip
from ..profiles import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_PLACES, CHUNK_TARGET

# The roles that a speaker line names, and what an agenda line starts with.
ROLES_BEFORE = r"(?:Alterspr|Pr)äsident(?:in)?|Vizepräsident(?:in)?|Bundeskanzler(?:in)?|Bundesminister(?:in)?"
ROLES_AFTER = (
    r"Bundesminister(?:in)?|Bundeskanzler(?:in)?|Staatsminister(?:in)?|Parl\.\s*Staatssekretär(?:in)?|Staatssekretär(?:in)?"
    r"|Senator(?:in)?|Ministerpräsident(?:in)?|Bürgermeister(?:in)?|Wehrbeauftragte[rn]?"
)
AGENDA = r"(?iU)^(?:Tagesordnungspunkt|Zusatzpunkt|Anlage|Einzelplan|Punkt)\b"
SPEAKER = (
    r"(?U)^(?:(" + ROLES_BEFORE + r")\s+([^\n:(]{3,60})"
    r"|([^\n:(]{3,60})\s*\(([^)]{2,45})\)"
    r"|([^\n:(,]{3,60}),\s*(" + ROLES_AFTER + r")[^\n:]{0,60}"
    r"):[ \t]*$"
)
# Arrays that are dear to make are exploded with the outer form and filtered after: the plain form first filters
# on the array's size, which makes it anew.
#: A piece above this is packed by sentences, a sentence above that is cut.
LONG_PIECE, LONG_SENTENCE = int(CHUNK_TARGET * 1.6), 2 * CHUNK_TARGET


def chunk_id(document: Column, position: Column) -> Column:
    """A chunk's id by its document and place: stable, and needs no counter. A place beyond ``CHUNK_PLACES`` is an error, not another document's id."""
    lost = F.raise_error(F.concat(F.lit("too many chunks: document "), document.cast("string"))).cast("long")
    return F.when(position < CHUNK_PLACES, document.cast("long") * CHUNK_PLACES + position).otherwise(lost)


def document_of(chunk: Column) -> Column:
    """The document of a chunk's id, by whole numbers."""
    return F.call_function("div", chunk - F.pmod(chunk, F.lit(CHUNK_PLACES)), F.lit(CHUNK_PLACES))


#: A fold copies its state at every step. So it goes over groups of so many items, and what a group gives is put by before the next.
_GROUP = 256
#: A sentence without an end is cut in blocks of so many characters, so that no step copies what is left of a long text; blocks in a group.
_BLOCK, _BLOCKS = 4 * LONG_SENTENCE, 16


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once."""
    return F.transform(F.array(value), then)[0]


def _fold(items: Column, kind: str, start: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column], size: int = _GROUP) -> Column:
    """Array of ``kind``: what the steps put into ``out`` of struct(out, c) in order, and then ``last`` of the final ``c``, which is ``start`` at first."""

    def run(held: Column) -> Column:
        def group(state: Column, at: Column) -> Column:
            begun = F.struct(F.array().cast(f"array<{kind}>").alias("out"), state["c"].alias("c"))
            return _bound(F.aggregate(F.slice(held, at, size), begun, step), lambda x: F.struct(F.concat(state["out"], F.array(x["out"])).alias("out"), x["c"].alias("c")))

        begun = F.struct(F.array().cast(f"array<array<{kind}>>").alias("out"), start.alias("c"))
        groups = F.when(F.size(held) > 0, F.sequence(F.lit(1), F.size(held), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(groups, begun, group, lambda x: F.concat(F.flatten(x["out"]), last(x["c"])))

    return _bound(items, run)


def _step(state: Column, c: Column, *more: Column) -> Column:
    """A state with another ``c``, and with one more item if there is one."""
    return F.struct((F.concat(state["out"], F.array(*more)) if more else state["out"]).alias("out"), c.alias("c"))


def hard_split(sentences: Column) -> Column:
    """Cuts sentences of more than ``LONG_SENTENCE`` characters at the last space in reach, else right there.

    A cut looks no further than that many characters, so a long sentence is cut block by block.
    """

    def cut(state: Column, _: Column) -> Column:
        rest = state["rest"]
        back = F.instr(F.reverse(F.substring(rest, 1, LONG_SENTENCE)), " ")
        space = F.lit(LONG_SENTENCE) - back
        at = F.when((back > 0) & (space >= LONG_SENTENCE // 2), space).otherwise(F.lit(LONG_SENTENCE))
        tail = lambda n: F.regexp_replace(F.substring(rest, n + 1, F.length(rest)), f"^{SPACE}+", "")
        more = _bound(at, lambda n: F.struct(F.concat(state["out"], F.array(F.substring(rest, F.lit(1), n))).alias("out"), tail(n).alias("rest")))
        return F.when(F.length(rest) > LONG_SENTENCE, more).otherwise(state)

    def block(state: Column, more: Column) -> Column:
        c = state["c"]
        # Where the white space at a cut filled its block, what follows it is stripped too.
        rest = F.when((c["rest"] == "") & c["cut"], F.regexp_replace(more, f"^{SPACE}+", "")).otherwise(F.concat(c["rest"], more))
        begun = F.struct(F.array().cast("array<string>").alias("out"), rest.alias("rest"))
        steps = F.sequence(F.lit(0), F.lit((_BLOCK + LONG_SENTENCE) // (LONG_SENTENCE // 2)))
        return _bound(F.aggregate(steps, begun, cut), lambda x: F.struct(F.concat(state["out"], x["out"]).alias("out"), F.struct(x["rest"].alias("rest"), (c["cut"] | (F.size(x["out"]) > 0)).alias("cut")).alias("c")))

    def parts(s: Column) -> Column:
        blocks = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
        done = _fold(blocks, "string", F.struct(F.lit("").alias("rest"), F.lit(False).alias("cut")), block, lambda c: F.filter(F.array(c["rest"]), lambda r: r != ""), _BLOCKS)
        return F.when(F.length(s) > LONG_SENTENCE, done).when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))

    return F.flatten(F.transform(sentences, parts))


def _by_sentences(piece: Column) -> Column:
    """Chunks of a long piece: sentences up to the target, each chunk led by the end of the one before.

    The fold holds lengths, numbers of sentences and the last characters alone; chunks are joined from their sentences after it.
    """

    def add(state: Column, s: Column) -> Column:
        c = state["c"]
        full = (c["size"] > 0) & (c["size"] + s["n"] + 1 > CHUNK_TARGET)

        def grown(lead: Column, first: Column, size: Column, tail: Column) -> Column:
            """A chunk from sentence ``first`` on with ``lead`` characters before it, of ``size`` characters that end so, with a sentence more."""
            joined = F.when(size > 0, F.concat(tail, F.lit(" "), s["t"])).otherwise(s["t"])
            longer = F.when(size > 0, size + 1).otherwise(F.lit(0)) + s["m"]
            return F.struct(lead.alias("lead"), first.alias("first"), longer.alias("size"), F.substring(joined, -CHUNK_OVERLAP, CHUNK_OVERLAP).alias("tail"), (c["next"] + 1).alias("next"))

        chunk = F.struct(c["lead"].alias("lead"), c["first"].alias("first"), (c["next"] - c["first"]).alias("count"))
        new = _bound(F.regexp_replace(c["tail"], f"^{SPACE}+", ""), lambda lead: _step(state, grown(F.length(lead), c["next"], F.length(lead), lead), chunk))
        return F.when(full, new).otherwise(_step(state, grown(c["lead"], c["first"], c["size"], c["tail"])))

    def chunks(held: Column) -> Column:
        start = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit("").alias("tail"), F.lit(0).alias("next"))
        last = lambda c: F.filter(F.array(F.struct(c["lead"].alias("lead"), c["first"].alias("first"), (c["next"] - c["first"]).alias("count"))), lambda _: c["size"] > 0)
        joined = lambda first, count, what: F.array_join(F.transform(F.slice(held, first + 1, count), lambda x: x[what]), " ")

        def text(c: Column) -> Column:
            # Sentences have a character and a space at least, so the lead is among the last so many of those before.
            back = F.least(c["first"], F.lit(CHUNK_OVERLAP // 2 + 1))
            led = F.concat(F.right(joined(c["first"] - back, back, "end"), c["lead"]), F.lit(" "), joined(c["first"], c["count"], "t"))
            return strip(F.when(c["lead"] > 0, led).otherwise(joined(c["first"], c["count"], "t")))

        return F.transform(_fold(held, "struct<lead:int,first:int,count:int>", start, add, last), text)

    # Sentences start without white space; only cut ones can end with it.
    bare = lambda s: F.when(F.substring(s, -1, 1).rlike(SPACE), F.rtrim(s, F.lit(STRIPPED))).otherwise(s)
    cut = F.transform(hard_split(split_sentences(piece)), lambda s: F.struct(bare(s).alias("t"), F.length(s).alias("n")))
    return _bound(F.transform(cut, lambda s: F.struct(s["t"].alias("t"), s["n"].alias("n"), F.length(s["t"]).alias("m"), F.substring(s["t"], -CHUNK_OVERLAP, CHUNK_OVERLAP).alias("end"))), chunks)


def pack(pieces: Column) -> Column:
    """Array of chunks near the target size from an array of pieces; chunks under the least size are left out. Its cost follows the length of the pieces.

    The fold holds which pieces a chunk is made of; a piece that is packed by sentences stands alone.
    """

    def add(state: Column, p: Column) -> Column:
        c, n = state["c"], p["n"]
        chunk = F.struct(c["first"].alias("first"), (c["next"] - c["first"]).alias("count"), F.lit(False).alias("long"))
        alone = F.struct(c["next"].alias("first"), F.lit(1).alias("count"), F.lit(True).alias("long"))
        after = lambda first, size: F.struct(first.alias("first"), size.alias("size"), (c["next"] + 1).alias("next"))
        begun = after(c["next"], n)
        none = after(c["next"] + 1, F.lit(0))
        long = F.when(c["size"] > 0, _step(state, none, chunk, alone)).otherwise(_step(state, none, alone))
        fits = c["size"] + n + 2 <= CHUNK_TARGET
        return F.when(n > LONG_PIECE, long).when(c["size"] == 0, _step(state, begun)).when(fits, _step(state, after(c["first"], c["size"] + n + 2))).otherwise(_step(state, begun, chunk))

    def chunks(held: Column) -> Column:
        start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).alias("next"))
        last = lambda c: F.filter(F.array(F.struct(c["first"].alias("first"), (c["next"] - c["first"]).alias("count"), F.lit(False).alias("long"))), lambda _: c["size"] > 0)
        plan = _fold(F.transform(held, lambda p: F.struct(F.length(p).alias("n"))), "struct<first:int,count:int,long:boolean>", start, add, last)
        text = lambda c: F.when(c["long"], _by_sentences(F.element_at(held, c["first"] + 1))).otherwise(F.array(F.array_join(F.slice(held, c["first"] + 1, c["count"]), "\n\n")))
        return F.flatten(F.transform(plan, text))

    return F.filter(_bound(F.filter(F.transform(pieces, strip), lambda p: p != ""), chunks), lambda c: F.length(c) >= CHUNK_MIN)


def segment_papers(docs: DataFrame, id_: str = "document_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(document_id, position, text) of papers: normalised, by paragraphs, packed; with the columns ``keep`` of their document. Null and short texts give no rows."""
    return docs.select(F.col(id_).alias("document_id"), *keep, F.posexplode_outer(pack(split_paragraphs(normalize(F.col(text))))).alias("position", "text")).where("position is not null")


def speaker_lines(docs: DataFrame, id_: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, line_no, line, is_speaker, redner, rolle, fraktion) of each line of the prepared text.

    A speaker line stands alone, ends with a colon and has one of three forms; agenda lines are none.
    """
    lines = docs.select(F.col(id_).alias("document_id"), F.posexplode_outer(F.split(prepare(F.col(text)), "\n", -1)).alias("line_no", "line"))
    line = F.col("line")
    hit = line.rlike(SPEAKER) & ~line.rlike(AGENDA)

    def group(k: int) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(line, SPEAKER, k), r"(?U)\s+", " ")), F.lit(""))

    return lines.select(
        "document_id", "line_no", "line", hit.alias("is_speaker"),
        F.when(hit, F.coalesce(group(2), group(3), group(5))).alias("redner"),
        F.when(hit, F.coalesce(group(1), group(6))).alias("rolle"),
        F.when(hit, group(4)).alias("fraktion"),
    )


def speeches(docs: DataFrame, id_: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, speech_no, redner, rolle, fraktion, body): what lies between speaker lines; number 0 is what comes before the first."""
    lines = speaker_lines(docs, id_, text)
    so_far = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("speech_no", F.sum(F.col("is_speaker").cast("int")).over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_speaker"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    who = [F.max(F.when(F.col("is_speaker"), F.col(c))).alias(c) for c in ("redner", "rolle", "fraktion")]
    return numbered.groupBy("document_id", "speech_no").agg(*who, body.alias("body"))


def segment_transcripts(docs: DataFrame, id_: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, position, text, redner, rolle, fraktion) of transcripts; one without speaker lines is cut like a paper."""
    parts = speeches(docs, id_, text)
    parts = parts.withColumn("speakers", F.max("speech_no").over(Window.partitionBy("document_id")))
    said = parts.where("speakers > 0").withColumn("chunks", pack(split_paragraphs(reflow(F.col("body")))))
    before = Window.partitionBy("document_id").orderBy("speech_no").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("offset", F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0)))
    said = said.select("document_id", "offset", "redner", "rolle", "fraktion", F.posexplode("chunks").alias("k", "text"))
    said = said.select("document_id", (F.col("offset") + F.col("k")).cast("int").alias("position"), "text", "redner", "rolle", "fraktion")
    none = [F.lit(None).cast("string").alias(c) for c in ("redner", "rolle", "fraktion")]
    plain = parts.where("speakers = 0").select("document_id", F.posexplode_outer(pack(split_paragraphs(reflow(F.col("body"))))).alias("position", "text"), *none).where("position is not null")
    return said.unionByName(plain)


def segment(docs: DataFrame, kind: str = "dokumentart", id_: str = "document_id", text: str = "text") -> DataFrame:
    """Chunks of all documents by their kind: ``Plenarprotokoll`` are transcripts, all others papers."""
    transcript = F.coalesce(F.col(kind) == "Plenarprotokoll", F.lit(False))
    papers = segment_papers(docs.where(~transcript), id_, text)
    none = [F.lit(None).cast("string").alias(c) for c in ("redner", "rolle", "fraktion")]
    return segment_transcripts(docs.where(transcript), id_, text).unionByName(papers.select("*", *none))
