"""Queries of text repair and segmentation.

The test tables hold clean prose, so artefacts are put in by rules that both sides state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import segment as S
from ..profiles import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_TARGET
from ..sources.tables import read, spread
from .catalogue import query


def _scalar(name: str, dirty: str, dirty_sql: str, clean, clean_sql: str) -> None:
    """A query (doc_id, result) that repairs an artefact which the expressions ``dirty`` put in."""
    sql = f"with d as (select doc_id, {dirty_sql} as t from documents) select doc_id, {clean_sql} as result from d"
    query(name, sql)(lambda spark, sf, c=clean: read(spark, sf, "documents").select("doc_id", F.expr(dirty).alias("t")).select("doc_id", c(F.col("t")).alias("result")))


_scalar("text_unify_newlines", r"replace(replace(text, '. ', '.\r\n'), ', ', ',\r')", "replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13))", T.unify_newlines, "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
_scalar("text_control_strip", "replace(replace(text, 'e', concat('e', chr(1))), 'a', concat(chr(127), 'a'))", "replace(replace(text, 'e', 'e' || chr(1)), 'a', chr(127) || 'a')", T.strip_controls, r"regexp_replace(t, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')")
_scalar("text_space_repair", r"replace(replace(replace(text, ', ', ', '), '. ', '. '), 'th', 't­h')", "replace(replace(replace(text, ', ', ',' || chr(160)), '. ', '.' || chr(8201)), 'th', 't' || chr(173) || 'h')", T.repair_spaces, "replace(replace(replace(t, chr(160), ' '), chr(8201), ' '), chr(173), '')")
_scalar("text_dot_leader", "replace(text, ', ', ' . . . . . 12 ')", "replace(text, ', ', ' . . . . . 12 ')", T.drop_dot_leaders, r"regexp_replace(t, '(?:\s*\.){4,}\s*\d*', ' ', 'g')")

_DIRTY = r"replace(replace(replace(text, ', ', '-\n'), ' of ', '-\nund '), ' de ', '-\n\tOder ')"
_DIRTY_SQL = "replace(replace(replace(text, ', ', '-' || chr(10)), ' of ', '-' || chr(10) || 'und '), ' de ', '-' || chr(10) || chr(9) || 'Oder ')"
_WORD = r"[\p{L}\p{N}_]"
_DEHYPHENATE_SQL = rf"regexp_replace(regexp_replace({{t}}, '({_WORD})-\n[ \t]*((?i:{T.CONJUNCTIONS}))($|[^\p{{L}}\p{{N}}_])', '\1- \2\3', 'g'), '({_WORD})-\n[ \t]*({_WORD})', '\1\2', 'g')"
_scalar("text_dehyphenate", _DIRTY, _DIRTY_SQL, T.dehyphenate, _DEHYPHENATE_SQL.replace("{t}", "t"))
_STRIP_LINES_SQL = "array_to_string(list_transform(string_split({t}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), chr(10))"
_scalar("text_strip_lines", r"replace(replace(text, '. ', ' .\n \t'), '\n', '  \n')", "replace(replace(text, '. ', ' .' || chr(10) || ' ' || chr(9)), chr(10), '  ' || chr(10))", T.strip_lines, _STRIP_LINES_SQL.format(t="t"))
_BREAKS = r"replace(replace(replace(text, ', ', '\n'), '. ', '.\n\n\n'), ' le ', '\n\n')"
_BREAKS_SQL = "replace(replace(replace(text, ', ', chr(10)), '. ', '.' || chr(10) || chr(10) || chr(10)), ' le ', chr(10) || chr(10))"
_NARROW_SQL = rf"trim({_STRIP_LINES_SQL.format(t='''regexp_replace(regexp_replace({t}, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')}, ' ' || chr(10) || chr(9))"


query("text_reflow", f"with d as (select doc_id, {_BREAKS_SQL} as t from documents), c as (select doc_id, string_split(t, '') as l from d), s as (select doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when l[i] = chr(10) and (i = 1 or l[i-1] not in ('.', '!', '?', ':', ';')) and (i = len(l) or l[i+1] <> chr(10)) then ' ' else l[i] end), '') as t from c) select doc_id, {_NARROW_SQL.replace('{t}', 't')} as result from s")(
    lambda spark, sf: spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", T.reflow(F.expr(_BREAKS)).alias("result"))
)

_SENTENCES_SQL = r"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("split_sentences", f"select doc_id, i::int as position, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {_SENTENCES_SQL.format(t='text')} as s from documents))")
def split_sentences(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.posexplode_outer(T.split_sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("position"), "sentence")


_PARAGRAPHS = r"replace(text, '. ', '.\n \n\n')"


@query("split_paragraphs", r"select doc_id, i::int as position, s[i] as paragraph from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, string_split(regexp_replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(10) || chr(10)), '\n\s*\n', chr(1), 'g'), chr(1)) as s from documents))")
def split_paragraphs(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode_outer(T.split_paragraphs(F.expr(_PARAGRAPHS))).alias("p", "paragraph"))
    return rows.select("doc_id", (F.col("p") + 1).alias("position"), "paragraph")


_LONG = S.LONG_SENTENCE
_HARD_SQL = f"""
hs(doc_id, k, piece, rest) as (
  select doc_id, 0, null::varchar, t from src
  union all
  select doc_id, k + 1, left(rest, cut), ltrim(substr(rest, cut + 1), ' ' || chr(9) || chr(10) || chr(13))
  from (select *, case when back > 0 and {_LONG} - back >= {_LONG // 2} then {_LONG} - back else {_LONG} end as cut
        from (select *, instr(reverse(left(rest, {_LONG})), ' ') as back from hs where length(rest) > {_LONG})))"""


def _joined() -> Column:
    """Texts without sentence ends, every third one without spaces too."""
    flat = F.regexp_replace(F.col("text"), r"[.!?\n]", "")
    return F.when(F.col("doc_id") % 3 == 0, F.replace(flat, F.lit(" "), F.lit("_"))).otherwise(flat)


@query("hard_split", rf"""with recursive src as (select doc_id, case when doc_id % 3 = 0 then replace(regexp_replace(text, '[.!?\n]', '', 'g'), ' ', '_') else regexp_replace(text, '[.!?\n]', '', 'g') end as t from documents), {_HARD_SQL}
select doc_id, (row_number() over (partition by doc_id order by ord))::int as position, piece from (
  select doc_id, k as ord, piece from hs where k > 0
  union all select doc_id, k + 1, rest from hs where length(rest) <= {_LONG} and rest <> '')""")
def hard_split(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode_outer(S.hard_split(F.array(_joined()))).alias("p", "piece")).where("p is not null")
    return rows.select("doc_id", (F.col("p") + 1).alias("position"), "piece")


def _pack_sql(pieces: str, keys: str = "doc_id") -> str:
    """CTEs that pack ``pieces(keys, i, piece)``, none empty, numbered from 1: ``packed(keys, ord, text)`` in the order of ord.

    Short pieces are one fold, each long one is a fold over its sentences, of which overlong ones are cut first.
    """
    return rf"""
pc as ({pieces}),
sen as (select {keys}, i, unnest(ss) as s, generate_subscripts(ss, 1) as j from (select {keys}, i, {_SENTENCES_SQL.format(t='piece')} as ss from pc where length(piece) > {S.LONG_PIECE})),
hs({keys}, i, j, k, cut_off, rest) as (
  select {keys}, i, j, 0, null::varchar, s from sen
  union all
  select {keys}, i, j, k + 1, left(rest, cut), ltrim(substr(rest, cut + 1), ' ' || chr(9) || chr(10) || chr(13))
  from (select *, case when back > 0 and {_LONG} - back >= {_LONG // 2} then {_LONG} - back else {_LONG} end as cut
        from (select *, instr(reverse(left(rest, {_LONG})), ' ') as back from hs where length(rest) > {_LONG}))),
cs as (select {keys}, i, j, k, cut_off as s from hs where k > 0 union all select {keys}, i, j, k + 1, rest from hs where length(rest) <= {_LONG} and rest <> ''),
ls as (select {keys}, i, list(s order by j, k) as ss from cs group by {keys}, i),
fs({keys}, i, ss, n, cur, done) as (
  select {keys}, i, ss, 1, '', null::varchar from ls
  union all
  select {keys}, i, ss, n + 1,
    trim(case when cur <> '' and length(cur) + length(ss[n]) + 1 > {CHUNK_TARGET} then ltrim(right(cur, {CHUNK_OVERLAP}), ' ' || chr(10) || chr(9)) else cur end || ' ' || ss[n], ' ' || chr(10) || chr(9)),
    case when cur <> '' and length(cur) + length(ss[n]) + 1 > {CHUNK_TARGET} then cur end
  from fs where n <= len(ss)),
ps as (select {keys}, list(case when length(piece) > {S.LONG_PIECE} then null else piece end order by i) as ps from pc group by {keys}),
fp({keys}, ps, n, cur, done) as (
  select {keys}, ps, 1, '', null::varchar from ps
  union all
  select {keys}, ps, n + 1,
    case when ps[n] is null then '' when cur <> '' and length(cur) + length(ps[n]) + 2 <= {CHUNK_TARGET} then cur || chr(10) || chr(10) || ps[n] else ps[n] end,
    case when cur <> '' and (ps[n] is null or length(cur) + length(ps[n]) + 2 > {CHUNK_TARGET}) then cur end
  from fp where n <= len(ps)),
packed as (
  select {keys}, (n - 1, 0, 0) as ord, done as text from fp where length(done) >= {CHUNK_MIN}
  union all select {keys}, (n, 0, 0), cur from fp where n = len(ps) + 1 and length(cur) >= {CHUNK_MIN}
  union all select {keys}, (i, 1, n), done from fs where length(done) >= {CHUNK_MIN}
  union all select {keys}, (i, 1, n + 1), cur from fs where n = len(ss) + 1 and length(cur) >= {CHUNK_MIN})"""


_POSITION_SQL = "(row_number() over (partition by doc_id order by ord) - 1)::int as position"


def _numbered_sql(pieces: str, keys: str = "doc_id") -> str:
    """``pieces(keys, ps)`` as rows, white space around them and empty ones left out."""
    return f"select {keys}, row_number() over (partition by {keys} order by i) as i, piece from (select {keys}, trim(unnest(ps), ' ' || chr(9) || chr(13) || chr(10)) as piece, generate_subscripts(ps, 1) as i from ({pieces})) where piece <> ''"


@query("pack_chunks", f"with recursive {_pack_sql(_numbered_sql('select doc_id, string_split(text, chr(10)) as ps from documents'))} select doc_id, {_POSITION_SQL}, text from packed")
def pack_chunks(spark, sf):
    """Whole lines as pieces: no line loses its tail, long ones are packed by sentences."""
    rows = spread(read(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode_outer(S.pack(F.split("text", "\n", -1))).alias("position", "text")).where("position is not null")


_FLAT_SQL = r"select doc_id, [replace(regexp_replace(text, '\n', ' ', 'g'), '  ', ' ')] as ps from documents"


@query("pack_sentences", f"with recursive {_pack_sql(_numbered_sql(_FLAT_SQL))} select doc_id, {_POSITION_SQL}, text from packed")
def pack_sentences(spark, sf):
    """Whole documents as one piece each: long ones go by sentences, and sentences that are too long are cut."""
    flat = F.trim(F.replace(F.regexp_replace("text", "\n", " "), F.lit("  "), F.lit(" ")))
    rows = spread(read(spark, sf, "documents").select("doc_id", flat.alias("t")))
    return rows.select("doc_id", F.posexplode_outer(S.pack(F.array("t"))).alias("position", "text")).where("position is not null")


def _reflow_sql(rows: str, keys: str) -> str:
    """CTEs from ``rows(keys, t)`` to ``reflowed(keys, t)``."""
    chars = f"select {keys}, string_split(t, '') as l from ({rows})"
    soft = f"select {keys}, array_to_string(list_transform(range(1, len(l) + 1), lambda i: case when l[i] = chr(10) and (i = 1 or l[i-1] not in ('.', '!', '?', ':', ';')) and (i = len(l) or l[i+1] <> chr(10)) then ' ' else l[i] end), '') as t from ({chars})"
    return f"reflowed as (select {keys}, {_NARROW_SQL.replace('{t}', 't')} as t from ({soft}))"


_PARAGRAPHS_SQL = r"string_split(regexp_replace(t, '\n\s*\n', chr(1), 'g'), chr(1))"
_PREPARED_SQL = rf"""prepared as (select doc_id, {_STRIP_LINES_SQL.format(t=_DEHYPHENATE_SQL.replace('{t}', 't'))} as t from (
  select doc_id, regexp_replace(replace(replace(replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), chr(160), ' '), chr(8201), ' '), chr(173), ''), '(?:\s*\.){{4,}}\s*\d*', ' ', 'g') as t from documents))"""


@query("segment_papers", f"with recursive {_PREPARED_SQL}, {_reflow_sql('select * from prepared', 'doc_id')}, {_pack_sql(_numbered_sql(f'select doc_id, {_PARAGRAPHS_SQL} as ps from reflowed'))} select doc_id, {_POSITION_SQL}, text from packed")
def segment_papers(spark, sf):
    """All repairs and packing over whole documents."""
    return S.segment_papers(spread(read(spark, sf, "documents").select("doc_id", "text")), "doc_id").withColumnRenamed("document_id", "doc_id")


_SPEAKERS = ("Präsidentin Julia Beispiel", "Max Muster (CDU/CSU)", "Lars Probe, Bundesminister der Finanzen", "Tagesordnungspunkt 3 (Fortsetzung)")


def _transcripts(spark, sf):
    """Each conversation as a transcript, its turns under speaker lines that go round by turn."""
    who = F.element_at(F.array(*[F.lit(s) for s in _SPEAKERS]), (F.col("turn") % 4 + 1).cast("int"))
    said = F.concat(who, F.lit(":\n"), F.regexp_replace("text", r"\s+", " "))
    turns = read(spark, sf, "conversations").select("conv_id", "turn", said.alias("said"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), "\n").alias("text"))


_TURNS_SQL = r"""c as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as said from conversations),
n as (select *, sum((turn % 4 <> 3)::int) over (partition by conv_id order by turn, said) as speech_no from c),
t as (select conv_id, turn, speech_no, said, case when turn % 4 = 3 then 'Tagesordnungspunkt 3 (Fortsetzung):' || chr(10) || said else said end as body from n),
turns as (select conv_id, speech_no::bigint as speech_no,
  max(case turn % 4 when 0 then 'Julia Beispiel' when 1 then 'Max Muster' when 2 then 'Lars Probe' end) as redner,
  max(case turn % 4 when 0 then 'Präsidentin' when 2 then 'Bundesminister' end) as rolle,
  max(case turn % 4 when 1 then 'CDU/CSU' end) as fraktion,
  string_agg(body, chr(10) order by turn, said) as body
  from t group by conv_id, speech_no)"""


@query("speaker_turns", f"with {_TURNS_SQL} select * from turns")
def speaker_turns(spark, sf):
    found = S.speeches(_transcripts(spark, sf), "conv_id").where("speech_no > 0 or body <> ''")
    return found.select(F.col("document_id").alias("conv_id"), "speech_no", "redner", "rolle", "fraktion", "body")


# What comes before the first speaker has no chunks, but in a transcript without any speaker.
_SPEECHES_SQL = "select conv_id, speech_no, body as t from turns where speech_no > 0 or conv_id not in (select conv_id from turns where speech_no > 0)"


@query("segment_transcripts", f"""with recursive {_TURNS_SQL}, {_reflow_sql(_SPEECHES_SQL, 'conv_id, speech_no')},
{_pack_sql(_numbered_sql(f'select conv_id, speech_no, {_PARAGRAPHS_SQL} as ps from reflowed', 'conv_id, speech_no'), 'conv_id, speech_no')}
select conv_id, (row_number() over (partition by conv_id order by p.speech_no, ord) - 1)::int as position, text, redner, rolle, fraktion from packed p join turns using (conv_id, speech_no)""")
def segment_transcripts(spark, sf):
    """Chunks of transcripts by speech, with who spoke."""
    return S.segment_transcripts(_transcripts(spark, sf), "conv_id").withColumnRenamed("document_id", "conv_id")


_STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("query_terms", r"select item_id, list_slice(regexp_extract_all(text, '[\p{L}\p{N}]{2,}'), 1, 32) as terms from benchmark")
def query_terms(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))


@query("fts_query_stopwords", rf"""with w as (select item_id, regexp_extract_all(regexp_replace('Wie ist es mit "' || text, '["''()*:^-]', ' ', 'g'), '[\p{{L}}\p{{N}}_]{{2,}}') as ws from benchmark),
f as (select item_id, ws, list_filter(ws, lambda w: lower(w) not in ({_STOP_SQL})) as us from w)
select item_id, array_to_string(list_transform(list_slice(case when len(us) > 0 then us else ws end, 1, 32), lambda w: '"' || w || '"'), ' OR ') as fts_query from f""")
def fts_query_stopwords(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.match_query(F.concat(F.lit('Wie ist es mit "'), "text")).alias("fts_query"))
