"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions, table, text_or_empty, with_small

#: What is hashed before a run of words, a paragraph, a section and a root.
LEAF, PARAGRAPH, SECTION, ROOT = "l", "p", "s", "r"
#: A section ends after an empty paragraph and after one whose digest starts with one of these, one in eight.
ENDS = ("0", "1")
#: Runs of words, the leaves of a paragraph: up to a word that ends so, eight words at most; leading spaces are one of their own.
#: Runs follow each other without a gap, so a paragraph's leaves hold for its very bytes.
RUN = r"(?:[^ \n]{0,31}[^ \naehnst.,;:!?|] +){0,7}[^ \n]{1,32} *| +"
#: Parts of the id order for each shuffle partition (many, so that their hashes fill partitions evenly), and the most: their bounds
#: are a literal of the plan. Above the most, parts grow with the table and are sorted on disk.
BUCKETS, MAX_BUCKETS = 32, 32_768
#: Bins of the first count of ids, and bits by which bins that hold more than a part are made finer.
BINS, FINER = 1 << 16, 4
#: Equal rows (id and text) above which their text is shuffled once, with their number.
EQUAL = 1000
#: Bits of a part's number below those of its range.
_SUB = 20


def tree(text: Column) -> Column:
    """The Merkle tree of a non-null text: struct of root, sections, paragraphs and leaves (SHA-256, hexadecimal).

    Paragraphs are the parts between line feeds, leaves (an array for each paragraph) their runs of words. A paragraph's
    digest is that of its leaves, so the root holds for the very bytes of the text: equal roots mean equal texts. Sections are
    content-defined groups of paragraphs; an edit changes the digests of its own runs, paragraphs and sections and of the root.
    """
    leaves = F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), F.lit(0)), lambda r: F.sha2(F.concat(F.lit(LEAF), r).cast("binary"), 256)))
    blank = F.sha2(F.lit(PARAGRAPH).cast("binary"), 256)

    # A transform over an array of one element binds what a later step names, else each use would hash anew.
    def bound(value: Column, run) -> Column:
        return F.transform(F.array(value), run)[0]

    def over_leaves(held: Column) -> Column:
        return bound(F.transform(held, lambda l: F.sha2(F.concat(F.lit(PARAGRAPH), F.array_join(l, "")).cast("binary"), 256)), lambda p: over_paragraphs(held, p))

    def over_paragraphs(held: Column, p: Column) -> Column:
        last = F.filter(
            F.transform(p, lambda h, i: F.when((F.substring(h, 1, 1).isin(*ENDS)) | (h == blank) | (i == F.size(p) - 1), i)),
            lambda i: i.isNotNull(),
        )

        def section(first: Column, end: Column) -> Column:
            return F.sha2(F.concat(F.lit(SECTION), F.array_join(F.slice(p, first + 1, end - first + 1), "")).cast("binary"), 256)

        def cut(ends: Column) -> Column:
            first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(ends, k) + 1)
            return F.struct(F.transform(ends, lambda e, k: section(first(k), e)).alias("s"), ends.alias("e"))

        return bound(bound(last, cut), lambda c: F.struct(F.sha2(F.concat(F.lit(ROOT), F.array_join(c["s"], "")).cast("binary"), 256).alias("root"), c["s"].alias("sections"), c["e"].alias("ends"), p.alias("paragraphs"), held.alias("leaves")))

    return bound(leaves, over_leaves)


def likeness(tree_a: Column, tree_b: Column) -> Column:
    """Twice the nodes that two trees share by all their nodes, each node once, 0 to 1; 1 for equal texts and for them only."""
    common, all_nodes = F.lit(0), F.lit(2)
    for nodes in (lambda t: t["sections"], lambda t: t["paragraphs"], lambda t: F.flatten(t["leaves"])):
        a, b = F.array_distinct(nodes(tree_a)), F.array_distinct(nodes(tree_b))
        both = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.struct(F.size(F.array_intersect(x["a"], x["b"])).alias("c"), (F.size(x["a"]) + F.size(x["b"])).alias("n")))[0]
        common, all_nodes = common + both["c"], all_nodes + both["n"]
    return F.when(tree_a["root"] == tree_b["root"], F.lit(1.0)).otherwise(F.round(2.0 * common / all_nodes, 6))


def _same_head(a: Column, b: Column) -> Column:
    """How many elements at the start of two arrays are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(a)).cast("int")


def edit(tree_a: Column, tree_b: Column) -> Column:
    """Where the second text differs from the first: struct of first (zero-based paragraph) and paragraphs (how many of the first text's), null for equal roots.

    Differing branches are followed down: equal sections at both ends are left aside, then equal paragraphs at both ends of
    the sections between. So moved, repeated and deleted paragraphs have a place too; where text was only added, paragraphs is 0.
    """

    def inner(x: Column) -> Column:
        a, b = x["a"], x["b"]
        head = _same_head(a["sections"], b["sections"])
        return F.struct(a.alias("a"), b.alias("b"), head.alias("head"), F.least(_same_head(F.reverse(a["sections"]), F.reverse(b["sections"])), F.size(a["sections"]) - head, F.size(b["sections"]) - head).alias("tail"))

    def between(x: Column) -> Column:
        first = F.when(x["head"] > 0, F.try_element_at(x["a"]["ends"], x["head"]) + 1).otherwise(F.lit(0))

        def part(t: Column) -> Column:
            until = F.size(t["sections"]) - x["tail"]
            to = F.when(until > 0, F.try_element_at(t["ends"], until) + 1).otherwise(F.lit(0))
            return F.slice(t["paragraphs"], first + 1, F.greatest(to - first, F.lit(0)))

        return F.struct(first.alias("first"), part(x["a"]).alias("a"), part(x["b"]).alias("b"))

    def walked(x: Column) -> Column:
        return F.struct(x["first"].alias("first"), x["a"].alias("a"), x["b"].alias("b"), _same_head(x["a"], x["b"]).alias("head"))

    def placed(x: Column) -> Column:
        tail = F.least(_same_head(F.reverse(x["a"]), F.reverse(x["b"])), F.size(x["a"]) - x["head"], F.size(x["b"]) - x["head"])
        return F.struct((x["first"] + x["head"]).cast("int").alias("first"), (F.size(x["a"]) - x["head"] - tail).cast("int").alias("paragraphs"))

    out = F.struct(tree_a.alias("a"), tree_b.alias("b"))
    for step in (inner, between, walked, placed):
        out = F.transform(F.array(out), step)[0]
    return F.when(tree_a["root"] != tree_b["root"], out)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with column ``tree``. Null texts count as empty, which have one empty paragraph."""
    return docs.withColumn("tree", tree(text_or_empty(text)))


def bounds_of(keys: DataFrame, parts: int) -> tuple[dict[int, int], int]:
    """Where parts of about equal counts begin in the order of ``doc_id``, with how many parts the id itself fills; and the parts of rows without an id.

    Ids are counted in bins of a power of two; bins that hold more than a part are counted again in finer ones, down to single
    ids. So all rows count, and what is gathered is bounded by the number of bins and parts.
    """
    row = keys.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("ids"), F.count("*").alias("n")).first()
    most = max(1, row["n"] // parts)
    unnamed = 1 + (row["n"] - row["ids"]) // most
    if not row["ids"]:
        return {}, unnamed
    shift = 0
    while (row["hi"] >> shift) - (row["lo"] >> shift) >= BINS:
        shift += 1
    done, rows = [], keys.where("doc_id is not null")
    while True:
        counts = rows.groupBy(F.shiftright("doc_id", shift).alias("bin")).count().collect()
        heavy = [r["bin"] for r in counts if r["count"] > most and shift]
        done += [(r["bin"] << shift, shift, r["count"]) for r in counts if r["count"] <= most or not shift]
        if not heavy:
            break
        held = keys.sparkSession.createDataFrame([(b,) for b in heavy], "heavy long")
        rows = rows.join(F.broadcast(held), F.shiftright("doc_id", shift) == F.col("heavy"), "left_semi")
        shift = max(0, shift - FINER)
    times, filled = {}, 0
    for start, width, count in sorted(done):
        if filled and filled + count > most:
            times[start], filled = 1, 0
        if not width and count > most:
            times[start], filled = -(-count // most), most
        else:
            filled += count
    return times, unnamed


def with_next(docs: DataFrame, buckets: int | None = None, equal: int = EQUAL) -> DataFrame:
    """(doc_id, text, text_tree, next_text, next_text_tree, copies) in descending order of doc_id (nulls last); after the last comes the first.

    Rows that share a doc_id follow each other by their text's SHA-256, descending, so the result is
    defined; a lone row is its own next. One shuffle of texts: ids are cut into parts of about equal
    counts, and the first row of each part is copied to the end of the part before. The rows of an id (or of none) that fill several
    parts are cut by their digests. Of more than ``equal`` equal rows one is shuffled, with their number: ``next_text`` is
    that of the last of them. Trees are made after the shuffle and the sort, once for each text and each copy of a part's first row.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    d = d.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    keys = checkpointed(d.select("doc_id", "digest"))
    n = buckets or min(MAX_BUCKETS, BUCKETS * partitions(spark))
    times, unnamed = bounds_of(keys, n)
    bounds = sorted(times)
    steps = max(1, len(bounds)).bit_length()

    def part() -> Column:
        """The part of a row: its range by binary search, then its place among the rows of an id that fills parts."""
        sixteenth = F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
        own = lambda m: F.shiftright(sixteenth * m, 16)
        lone = own(F.lit(unnamed).cast("long")) - F.lit(1 << _SUB)
        if not bounds:
            return F.when(F.col("doc_id").isNull(), lone).otherwise(F.lit(0).cast("long"))
        b, value = F.lit(bounds), F.col("doc_id")

        def step(at: Column, width: Column) -> Column:
            to = (at + width).cast("int")
            return F.when((to <= len(bounds)) & (F.try_element_at(b, F.greatest(to, F.lit(1))) <= value), to).otherwise(at)

        place = F.aggregate(F.lit([1 << k for k in range(steps - 1, -1, -1)]), F.lit(0), step)
        m = F.try_element_at(F.lit([times[x] for x in bounds]), F.greatest(place, F.lit(1))).cast("long")
        # Rows of the bound itself come before those of the greater ids of its range.
        inner = F.when((place > 0) & (F.try_element_at(b, F.greatest(place, F.lit(1))) == value), own(m)).when(place > 0, m).otherwise(F.lit(0))
        return F.when(value.isNull(), lone).otherwise(F.shiftleft(place.cast("long"), _SUB) + inner)

    # The first row of each part by (doc_id, digest): at most one a part, so at most some n of them.
    ranked = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest")
    heads = sorted(keys.groupBy(part().alias("bucket")).agg(F.max(ranked).alias("head")).collect(), key=lambda r: -r["bucket"])
    guests = json.dumps([{"gid": h["head"]["doc_id"], "gdigest": h["head"]["digest"], "guest": heads[k - 1]["bucket"]} for k, h in enumerate(heads)])
    guests = spark.range(1).select(F.explode(F.from_json(F.lit(guests), "array<struct<gid:bigint, gdigest:string, guest:bigint>>")).alias("g")).select("g.*")
    many = checkpointed(keys.groupBy(F.col("doc_id").alias("mid"), F.col("digest").alias("mdigest")).agg(F.count("*").alias("many")).where(F.col("many") > equal))
    if many.isEmpty():
        d = d.withColumn("copies", F.lit(1).cast("long"))
    else:
        j = with_small(d, many, d.doc_id.eqNullSafe(many.mid) & (d.digest == many.mdigest), "left")
        once = j.where("many is not null").groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("many").alias("copies"))
        d = j.where("many is null").select("doc_id", "text", "digest", F.lit(1).cast("long").alias("copies")).unionByName(once)
    d = d.withColumn("bucket", part())
    d = d.join(F.broadcast(guests), d.doc_id.eqNullSafe(guests.gid) & (d.digest == guests.gdigest), "left")
    places = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("copy")), F.struct(F.col("guest").alias("b"), F.lit(1).alias("copy")))
    d = d.select("doc_id", "text", "digest", "copies", F.explode(F.filter(places, lambda p: p["b"].isNotNull())).alias("at"))
    d = d.select("at.b", "at.copy", "doc_id", "digest", "text", "copies")
    order = [F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("digest").desc()]
    # The window takes the rows as they are dealt and sorted here, so that trees are not carried through either.
    d = d.repartition(partitions(spark), "b").sortWithinPartitions("b", *order).withColumn("text_tree", tree(F.col("text")))
    follow = Window.partitionBy("b").orderBy(*order)
    next_ = F.lead(F.struct("text", "text_tree")).over(follow)
    return d.withColumn("next", next_).where("copy = 0").select("doc_id", "text", "text_tree", F.col("next.text").alias("next_text"), F.col("next.text_tree").alias("next_text_tree"), "copies")


def edited_fingerprints(docs: DataFrame, buckets: int | None = None, equal: int = EQUAL) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n_chars / 3) code points are the first of the next document.

    One row for each row, repeated ones too: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and edit_paragraph and edit_paragraphs of ``edit`` (null if the edited text is the
    same). Null texts are empty. Texts of any length are hashed in time in proportion. An empty table gives no rows; other columns are not read.
    """
    d = with_next(docs, buckets, equal)
    # All but the last of equal rows come before themselves. Most rows are alone, and have one turn.
    turn = lambda name, rows: F.struct(F.col(name).alias("next"), F.col(f"{name}_tree").alias("tree"), rows.cast("long").alias("rows"))
    turns = F.when(F.col("copies") > 1, F.array(turn("next_text", F.lit(1)), turn("text", F.col("copies") - 1))).otherwise(F.array(turn("next_text", F.lit(1))))
    d = d.select("doc_id", "text", "text_tree", F.explode(turns).alias("turn"))
    d = d.select("doc_id", "text", "text_tree", F.col("turn.next").alias("next_text"), F.col("turn.tree").alias("next_text_tree"), F.col("turn.rows").alias("rows"))
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - int(floor(n_chars / 3)))"), F.substring(F.col("next_text"), F.lit(1), third)))
    d = d.withColumn("edited_tree", tree(F.col("edited")))
    d = d.withColumn("edit", edit(F.col("text_tree"), F.col("edited_tree")))
    d = d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("text_tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("text_tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("text_tree"), F.col("next_text_tree")).alias("near_next"),
        F.col("edit.first").alias("edit_paragraph"),
        F.col("edit.paragraphs").alias("edit_paragraphs"),
        "rows",
    )
    return d.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("_row", "rows")


_SQL_TREE = """
{t}_l as (select *, list_transform(string_split({t}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{run}'), lambda r: sha256('l' || r))) as {t}_l from {src}),
{t}_p as (select *, list_transform({t}_l, lambda l: sha256('p' || array_to_string(l, ''))) as {t}_p from {t}_l),
{t}_e as (select *, list_filter(range(len({t}_p)), lambda i: {t}_p[i+1][1] in ('0','1') or {t}_p[i+1] = sha256('p') or i = len({t}_p) - 1) as {t}_e from {t}_p),
{t}_s as (select *, list_transform(range(len({t}_e)), lambda k: sha256('s' || array_to_string({t}_p[(case when k = 0 then 0 else {t}_e[k] + 1 end) + 1 : {t}_e[k+1] + 1], ''))) as {t}_s from {t}_e),
{t}_r as (select *, sha256('r' || array_to_string({t}_s, '')) as {t}_r, list_distinct(flatten({t}_l)) as {t}_n from {t}_s)"""


def _sql_like(b: str) -> str:
    both = " + ".join(f"len(list_intersect(text_{k}, {b}_{k}))" for k in "nsp")
    every = " + ".join(f"len(list_distinct({x}_{k}))" for x in ("text", b) for k in "nsp")
    return f"case when text_r = {b}_r then 1.0::double else round(2.0::double * ({both}) / ({every} + 2), 6) end"


def _sql_head(a: str, b: str) -> str:
    """Equal elements at the start of two lists that differ."""
    return f"list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] is not distinct from {b}[i]), false) - 1"


# The edit is stated on the paragraphs alone: sections only tell where to look.
QUERY_SQL = (
    """with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars from documents),
o as (select *, coalesce(lead(text) over w, first_value(text) over w) as next_text from d window w as (order by doc_id desc nulls last, sha256(text) desc rows between unbounded preceding and unbounded following)),
x as (select *, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) as edited from o),"""
    + ",".join(_SQL_TREE.format(t=t, src=src, run=RUN) for t, src in (("text", "x"), ("edited", "text_r"), ("next_text", "edited_r")))
    + f""",
h as (select *, case when text_r <> edited_r then {_sql_head("text_p", "edited_p")} end as head, case when text_r <> edited_r then {_sql_head("list_reverse(text_p)", "list_reverse(edited_p)")} end as tail from next_text_r)
select doc_id, n_chars, sha256(edited) as edited_sha256, text_r as fingerprint, edited_r as edited_fingerprint,
{_sql_like("edited")} as near_edited, {_sql_like("next_text")} as near_next,
head::int as edit_paragraph, case when text_r <> edited_r then len(text_p) - head - least(tail, len(text_p) - head, len(edited_p) - head) end::int as edit_paragraphs
from h"""
)


def query(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
