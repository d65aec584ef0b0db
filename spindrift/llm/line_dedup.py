"""Line dedup over content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table, text_or_empty, with_small

#: Production parameters: lines under the rolling hash, and words above which a line is a passage of its own.
WINDOW, LONG_WORDS = 2, 50
#: Fixed values of the rolling hash over line hashes: base and modulus (products stay below 2^63).
BASE, MODULUS = 1_000_003, 2_147_483_647


def chunks(lines: Column) -> Column:
    """Array of (first, lines) of the chunks of a non-null array of lines, zero-based, in order; two lines at least but for a lone line.

    The hash of a line is 32 bits of its MD5; a polynomial hash rolls over the last ``WINDOW`` of them. A chunk
    ends after a line whose rolling hash is below those of the lines beside it, and in a run of equal lines
    after every second one, but never so that one line is left at either end of the text. So each boundary depends on
    the few lines around it and comes back after an insertion.
    """
    hashed = F.transform(lines, lambda s: F.pmod(F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(MODULUS)))

    # One-element transforms bind what a later step names, else it would be made for each element.
    def bound(value: Column, run) -> Column:
        return F.transform(F.array(value), run)[0]

    def at(values: Column, i: Column) -> Column:
        return F.try_element_at(values, (i + 1).cast("int"))

    def rolled(h: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            value = F.lit(0).cast("long")
            for back in range(WINDOW - 1, -1, -1):
                before = F.when(i >= back, at(h, F.greatest(i - back, F.lit(0)))).otherwise(F.lit(0))
                value = F.pmod(value * BASE + before, F.lit(MODULUS))
            return value

        return F.transform(h, one)

    def places(starts: Column) -> Column:
        """How many equal lines come right before each."""
        size = F.size(lines)
        return F.flatten(F.transform(starts, lambda s, k: F.transform(F.sequence(s, F.coalesce(at(starts, k + 1), size) - 1), lambda i: i - s)))

    def ends(held: Column) -> Column:
        ls, r, p = held["ls"], held["r"], held["p"]

        def end(_: Column, i: Column) -> Column:
            goes_on = at(ls, i) == at(ls, i + 1)
            low = (at(r, i) < at(r, F.greatest(i - 1, F.lit(0)))) & (at(r, i) < at(r, i + 1))
            inner = (i >= 1) & (i <= F.size(ls) - 3)
            return F.when((i == F.size(ls) - 1) | (inner & F.when(goes_on, at(p, i) % 2 == 1).otherwise(low)), i)

        return F.filter(F.transform(ls, end), lambda i: i.isNotNull())

    def cut(e: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.try_element_at(e, k))
        return F.transform(e, lambda x, k: F.struct((before(k) + 1).alias("first"), (x - before(k)).alias("lines")))

    starts = F.filter(F.transform(lines, lambda s, i: F.when((i == 0) | (s != at(lines, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
    held = F.struct(lines.alias("ls"), bound(hashed, rolled).alias("r"), bound(starts, places).alias("p"))
    return bound(bound(held, ends), cut)


def units(lines: Column, long_words: int | None = LONG_WORDS) -> Column:
    """Array of (first, lines) of what can be removed: chunks of several lines, and lines of more than ``long_words`` words (None: no single line).

    Words are counted by spaces, one more than there are. A chunk of several lines may hold such a line: either can go.
    """
    several = F.filter(chunks(lines), lambda c: c["lines"] > 1)
    if long_words is None:
        return several
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    single = F.filter(F.transform(lines, lambda s, i: F.when(spaces(s) >= long_words, F.struct(i.alias("first"), F.lit(1).alias("lines")))), lambda c: c.isNotNull())
    return F.concat(several, single)


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"] + 1, chunk["lines"]), "\n")


def _cut(docs: DataFrame, long_words: int | None) -> DataFrame:
    # The array of lines is bound by a generator, so that no step splits the text again.
    split = docs.withColumn("lines", F.explode(F.array(F.split("body", "\n", -1))))
    return split.withColumn("units", units(F.col("lines"), long_words))


def removals(docs: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs(doc_id, digest, body)`` to (doc_id, digest, gone): the repeated units of each document that has any.

    gone is an array of (first, lines, text): the unit's place and the text of the unit that came first, by (doc_id,
    digest, place), nulls first. What is removed is compared with that text byte by byte.
    """
    marks = F.transform("units", lambda c: F.struct(c["first"].alias("first"), c["lines"].alias("lines"), _md5(_text(F.col("lines"), c)).alias("mark")))
    # The outer form: the plain one would first filter on the size of the array and so make it twice.
    seen = _cut(docs, long_words).select("doc_id", "digest", F.explode_outer(marks).alias("m")).where("m is not null").select("doc_id", "digest", "m.first", "m.lines", "m.mark")
    seen = checkpointed(seen)
    # Repeated rows of one document and digest are the same document: sets take their occurrences once.
    own = F.struct("doc_id", "digest", "first")
    spread = seen.groupBy("mark").agg(F.min(own).alias("head"), F.max(own).alias("last"))
    repeated = checkpointed(spread.where("head <> last").select(F.col("mark").alias("rmark"), "head"))
    found = checkpointed(seen.join(repeated, seen.mark == repeated.rmark).select("doc_id", "digest", "first", "lines", "mark", (own == F.col("head")).alias("is_first")))
    wanted = found.where("is_first").groupBy(F.col("doc_id").alias("wid"), F.col("digest").alias("wdigest")).agg(F.collect_set(F.struct("first", "lines", "mark")).alias("want"))
    wanted = checkpointed(wanted)
    holders = with_small(docs, wanted, docs.doc_id.eqNullSafe(wanted.wid) & (docs.digest == wanted.wdigest), "inner")
    holders = holders.select("want", F.explode(F.array(F.split("body", "\n", -1))).alias("lines"))
    heads = holders.select(F.explode_outer(F.transform("want", lambda w: F.struct(w["mark"].alias("mark"), _text(F.col("lines"), w).alias("text")))).alias("w"))
    heads = heads.select("w.mark", "w.text").groupBy("mark").agg(F.first("text").alias("text"))
    heads = checkpointed(heads.select(F.col("mark").alias("fmark"), F.col("text").alias("ftext")))
    later = found.where("not is_first")
    return later.join(heads, later.mark == heads.fmark).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first", "lines", F.col("ftext").alias("text"))).alias("gone"))


def dedup(docs: DataFrame, text: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` with repeated chunks of lines cut from ``text``, and column ``cut_``: how many lines went.

    Of chunks with the same bytes anywhere in the table the first stays (smallest doc_id, nulls first, then text MD5,
    then place), and so of single lines of more than ``long_words`` words, which are passages in themselves; None leaves
    those to the chunks. Lines that are left keep their order and are joined by line feeds; a document of repeated
    chunks only becomes empty and stays a row. Null texts stay null, empty ones empty. Rows that repeat both doc_id and text
    count as one document and get the same result. A text of any length is cut in time in proportion to it. Other columns
    are kept, whatever their names, but for one named ``cut_``. An empty table gives no rows.
    """
    body = text_or_empty(text)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _md5(body).alias("digest"), body.alias("body"))
    gone = removals(d, long_words).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), _md5(body).alias("own_digest"))
    j = rows.join(gone, rows.own_id.eqNullSafe(gone.gone_id) & (rows.own_digest == gone.gone_digest), "left")
    own = F.col("row")[text]

    def rest(parts: Column) -> Column:
        ls = parts["lines"]
        same = F.filter(parts["gone"], lambda g: g["text"] == _text(ls, g))
        out = F.flatten(F.transform(same, lambda g: F.sequence(g["first"], g["first"] + g["lines"] - 1)))
        # The difference of two arrays keeps the order and takes time in proportion.
        kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), out)
        return F.transform(F.array(kept), lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.try_element_at(ls, i + 1)), "\n").alias("text"), (F.size(ls) - F.size(k)).alias("cut")))[0]

    parts = F.array(F.struct(F.split(own, "\n", -1).alias("lines"), F.col("gone")))
    j = j.withColumn("rest", F.when(F.col("gone").isNotNull(), F.transform(parts, rest)[0]))
    out = [F.coalesce(F.col("rest.text"), own).alias(n) if n == text else F.col("row")[n].alias(n) for n in docs.columns if n != "cut_"]
    return j.select(*out, F.coalesce(F.col("rest.cut"), F.lit(0)).alias("cut_"))


def query(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, cut_lines, kept_chars, kept_sha256 of each document after line dedup."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(text_or_empty(), "\n", -1)).cast("long").alias("n_lines"))
    d = dedup(docs)
    return d.select("doc_id", "n_lines", F.col("cut_").cast("long").alias("cut_lines"), F.length(text_or_empty()).cast("long").alias("kept_chars"), F.sha2(text_or_empty().cast("binary"), 256).alias("kept_sha256"))


QUERY_SQL = f"""
with d as (select distinct doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as digest from documents),
l as (select doc_id, digest, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n from d),
h as (select *, ('0x' || md5(line)[1:8])::bigint % {MODULUS} as h, coalesce(line = lag(line) over w, false) as again, coalesce(line = lead(line) over w, false) as goes_on from l window w as (partition by doc_id, digest order by i)),
r as (select *, (coalesce(lag(h) over w, 0) * {BASE} + h) % {MODULUS} as r, i - max(case when not again then i end) over w as p from h window w as (partition by doc_id, digest order by i)),
e as (select *, i = n or (i between 2 and n - 2 and case when goes_on then p % 2 = 1 else r < lag(r) over w and r < lead(r) over w end) as is_end from r window w as (partition by doc_id, digest order by i)),
k as (select *, coalesce(sum(is_end::int) over (partition by doc_id, digest order by i rows between unbounded preceding and 1 preceding), 0) as k from e),
c as (select doc_id, digest, k, min(i) as first, string_agg(line, chr(10) order by i) as ct from k group by all having count(*) > 1),
gc as (select *, row_number() over (partition by ct order by doc_id nulls first, digest, first) > 1 as chunk_gone from c),
s as (select doc_id, digest, i, row_number() over (partition by line order by doc_id nulls first, digest, i) > 1 as line_gone from l where length(line) - length(replace(line, ' ', '')) >= {LONG_WORDS}),
g as (select k.*, coalesce(chunk_gone, false) or coalesce(line_gone, false) as gone from k left join gc on k.doc_id is not distinct from gc.doc_id and k.digest = gc.digest and k.k = gc.k left join s on k.doc_id is not distinct from s.doc_id and k.digest = s.digest and k.i = s.i),
o as (select doc_id, digest, count(*) as n_lines, count(*) filter (where gone) as cut_lines, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as kept from g group by all)
select x.doc_id, n_lines, cut_lines, length(kept) as kept_chars, sha256(kept) as kept_sha256
from documents x join o on x.doc_id is not distinct from o.doc_id and md5(coalesce(x.text, '')) = o.digest"""
