"""Registered queries for the rest of the library's surface: storage, the facade, analysis, filters, the query language."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, similarity, stopwords
from ..operators import query as Q
from ..operators.facade import BestOf, Index, LazyDoc
from ..operators.filters import DocsFilter, RangeFilter
from ..operators.index import SearchIndex
from ..operators.planner import Planner
from ..operators.schema import FieldInfos
from ..operators.search import FieldSymbol, Searcher
from ..sources import store
from .registry import _MULTI, _ONE, _PHRASE, _SPLIT, documents, flat, index, register, rounded, scored, searcher, shared_folder, span, term, tokens


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/surface-{uuid.uuid4().hex}"


# Storage
def _directory(spark: SparkSession, d: str) -> DataFrame:
    where = store.Directory(spark, _folder(spark))
    where.touch("a")
    where.touch("b")
    seen = [("touched", where.exists("a") and where.file_count() == 2), ("renamed", where.rename("b", "c") and where.names() == ["a", "c"])]
    seen += [("deleted", where.delete("a") and not where.exists("a")), ("listed", list(where) == ["c"]), ("created once", where.create_new("d") and not where.exists("e"))]
    return spark.createDataFrame(seen, "step string, ok boolean")


def _locks(spark: SparkSession, d: str) -> DataFrame:
    where = store.Directory(spark, _folder(spark))
    with where.lock("commit"):
        seen = [("held", where.locked("commit")), ("others are free", not where.locked("write"))]
        try:
            with where.lock("commit", seconds=0.05):
                seen.append(("second waits in vain", False))
        except store.LockError:
            seen.append(("second waits in vain", True))
    return spark.createDataFrame([*seen, ("released", not where.locked("commit"))], "step string, ok boolean")


def _facts(*names: str) -> str:
    return " union all ".join(f"select '{n}' as step, true as ok" for n in names)


register("directory", _directory, _facts("touched", "renamed", "deleted", "listed", "created once"), False)
register("locks", _locks, _facts("held", "others are free", "second waits in vain", "released"), False)
register("ram_index", lambda spark, d: rounded(Planner(index(spark, d).delete_terms("lang", "xx").cached()).hits(term("und"))), _ONE.format("und"))


def _opened(spark: SparkSession, d: str) -> Index:
    """The facade over an index saved and opened again."""
    path = _folder(spark)
    store.save(index(spark, d), path, codec="zstd")
    return Index(spark, path, analysis.letter_analyzer(), default_field="text", id_field="source")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    store.export_jsonl(index(spark, d).delete_terms("lang", "es"), path)
    return store.import_jsonl(spark, path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents in eleven parts: ten small segments become one, and the eleventh stays."""
    path, docs = _folder(spark), documents(spark, d)
    for k in range(11):
        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(11)) == k)
        store.append(SearchIndex.build(part, FieldInfos().add_field("lang", index="untokenized"), analysis.letter_analyzer(), max_field_length=None), path, merge_factor=10)
    whole = store.load(spark, path, analysis.letter_analyzer())
    n = len(store.segments(spark, path))
    return whole.term_stats.filter("field = 'lang'").select("term", "doc_freq").withColumn("segments", F.lit(n).cast("long"))


register("jsonl_roundtrip", _lines, "select lang, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents where lang is distinct from 'es' group by lang", False)
register("persist_roundtrip", lambda spark, d: rounded(_opened(spark, d).searcher.hits("text:de")), _ONE.format("de"))
register("merge_policy", _segments, "select lang as term, count(*) as doc_freq, cast(2 as bigint) as segments from documents where lang is not null group by lang", False)
register("field_length", lambda spark, d: SearchIndex.build(documents(spark, d).select("doc_id", "text"), analyzer=analysis.letter_analyzer(), max_field_length=50).norms.select("doc_id", F.col("length").cast("long").alias("length")), r"select doc_id, least(51, len(regexp_extract_all(lower(text), '\p{L}+'))) as length from documents where text is not null", False)
register("each_document", lambda spark, d: index(spark, d).delete_terms("lang", "de").docs().select("doc_id", "lang", "source"), "select doc_id, lang, source from documents where lang is distinct from 'de'", False)
register("undelete_all", lambda spark, d: rounded(Planner(index(spark, d).delete_terms("lang", "fr").undelete_all()).hits(term("de"))), _ONE.format("de"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    gone = index(spark, d).delete_terms("lang", ["fr", "es"])
    return spark.createDataFrame([(gone.max_doc, gone.num_docs(), gone.has_deletions())], "max_doc long, num_docs long, deletions boolean")


register("doc_counts", _counts, "select max(doc_id) + 1 as max_doc, count(*) filter (lang is null or lang not in ('fr', 'es')) as num_docs, bool_or(lang in ('fr', 'es')) as deletions from documents", False)
_JSON_TERM = """'{"term":"' || term || '","frequency":' || df || '}'"""
register("term_enum", lambda spark, d: index(spark, d).terms_json("text", "m"), f"select term, {_JSON_TERM} as json from w where field = 'text' and term >= 'm'")
register("term_enum_fast", lambda spark, d: index(spark, d).terms_json("lang", fast=True), """select term, '["' || term || '",' || df || ']' as json from w where field = 'lang'""")
register("term_docs_json", lambda spark, d: index(spark, d).term_docs_json("text", "que"), """select doc_id, '{"document":' || doc_id || ',"frequency":' || freq || ',"positions":[' || array_to_string(positions, ',') || ']}' as json from p where field = 'text' and term = 'que'""")
register(
    "term_offsets",
    lambda spark, d: SearchIndex.build(documents(spark, d).select("doc_id", "text"), analyzer=analysis.whitespace_analyzer(), max_field_length=None).term_offsets("text").select("doc_id", "term", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")),
    r"""with parts as (select doc_id, unnest(t) as part, generate_subscripts(t, 1) as i from (select doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+') as t from documents)),
    placed as (select *, cast(sum(length(part)) over (partition by doc_id order by i) as bigint) as "end" from parts)
    select doc_id, part as term, "end" - length(part) as start, "end" from placed where regexp_matches(part, '[^ \t\n\x0B\f\r]')""",
    False,
)
register(
    "field_infos",
    lambda spark, d: spark.createDataFrame([(s.name, s.index, s.stored, s.term_vectors) for s in FieldInfos.load(index(spark, d).fields.to_json())], "name string, index string, stored boolean, term_vectors boolean"),
    "select * from (values ('text', 'yes', true, true), ('lang', 'untokenized', true, true), ('source', 'untokenized', true, true), ('n_chars', 'untokenized', true, true)) t(name, \"index\", stored, term_vectors)",
    False,
)


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    first = store.save(index(spark, d), path)
    was_latest = store.is_latest(spark, path, first)
    second = store.save(index(spark, d), path)
    found = store.load(spark, path, analysis.letter_analyzer())
    return spark.createDataFrame([(first, was_latest, second, store.is_latest(spark, path, first), ",".join(sorted(found.fields.fields)), ",".join(found.fields.tokenized_fields))], "first long, was_latest boolean, second long, still_latest boolean, fields string, tokenized string")


register("index_metadata", _metadata, "select cast(1 as bigint) as first, true as was_latest, cast(2 as bigint) as second, false as still_latest, 'lang,n_chars,source,text' as fields, 'text' as tokenized", False)


def _compressed(spark: SparkSession, d: str) -> DataFrame:
    """Stored fields with codecs of their own, written and read again."""
    infos = FieldInfos().add_field("text", compression="brotli").add_field("lang", index="untokenized", compression="lz4").add_field("source", index="no", compression="bz2")
    path = _folder(spark)
    store.save(SearchIndex.build(documents(spark, d).select("doc_id", "text", "lang", "source"), infos, analysis.letter_analyzer(), max_field_length=None), path)
    back = store.load(spark, path, analysis.letter_analyzer())
    return back.docs().select("doc_id", F.md5("text").alias("text"), "lang", "source")


register("field_compression", _compressed, "select doc_id, md5(text) as text, lang, source from documents", False)


# The facade
def _lazy(spark: SparkSession, d: str) -> DataFrame:
    """Every document by way of its accessors, in parallel."""

    def of(row) -> tuple:
        doc = LazyDoc(row)
        return doc.number, ",".join(sorted(doc.fields)), doc.fetch("lang", "none"), len(doc.without("text")), ",".join(sorted(doc.select(lambda k, v: isinstance(v, str)))), doc.merge({"lang": "xx"})["lang"]

    made = F.udf(of, "doc_id long, fields string, lang string, others int, strings string, merged string")
    stored = index(spark, d).docs()
    return stored.select(made(F.struct(*stored.columns)).alias("x")).select("x.*")


_NAMES = "array_to_string(list_filter([{}], lambda x: x is not null), ',')"
register(
    "lazy_doc",
    _lazy,
    "select doc_id, " + _NAMES.format("case when lang is not null then 'lang' end, case when n_chars is not null then 'n_chars' end, case when source is not null then 'source' end, case when text is not null then 'text' end") + " as fields, coalesce(lang, 'none') as lang, cast(1 + (lang is not null)::int + (n_chars is not null)::int + (source is not null)::int as integer) as others, "
    + _NAMES.format("case when lang is not null then 'lang' end, case when source is not null then 'source' end, case when text is not null then 'text' end") + " as strings, 'xx' as merged from documents",
    False,
)


def _facade(spark: SparkSession, d: str) -> DataFrame:
    """A new index, filled, changed, optimized and searched."""
    made = Index(spark, analyzer=analysis.letter_analyzer(), fields=FieldInfos().add_field("id", index="untokenized").add_field("lang", index="untokenized"), default_field="text", key="id", max_field_length=None)
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    made.add(docs.withColumn("__given", F.col("id").cast("long")))
    made.query_delete("lang:fr").batch_update(docs.filter("lang = 'es'").withColumn("text", F.lit("nuevo texto")).withColumn("__given", F.col("id").cast("long"))).optimize()
    return made.search("nuevo OR the", limit=None).hits.join(made.state.docs(), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


register("facade", _facade, r"select lang, count(*) as n from documents where lang = 'es' or (lang is distinct from 'fr' and list_contains(regexp_extract_all(lower(text), '\p{L}+'), 'the')) group by lang", False)
register("doc_by_id", lambda spark, d: (lambda i: i.state.docs().join(i._ids(["src1", "src3"]), "doc_id", "left_semi").select("doc_id", "source"))(_opened(spark, d)), "select doc_id, source from documents where source in ('src1', 'src3')", False)
_fq, _fsql = flat(("the", Q.MUST, 1.0), ("and", Q.MUST, 1.0))
register("lifecycle", lambda spark, d: _opened(spark, d).search("+the +and", offset=2, limit=7).hits, _fsql + " select doc_id, score from hits order by score desc, doc_id limit 7 offset 2")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    queue = BestOf(3)
    for x in (5, 1, 9, 7, 3):
        queue.insert(x)
    copy = queue.clone()
    rows = [("size", len(queue)), ("top", queue.top()), ("popped", queue.pop()), ("next", queue.top()), ("kept by the clone", copy.top())]
    queue.clear()
    return spark.createDataFrame([*rows, ("cleared", len(queue))], "step string, value long")


register("priority_queue", _queue, "select step, cast(value as bigint) as value from (values ('size', 3), ('top', 5), ('popped', 5), ('next', 7), ('kept by the clone', 5), ('cleared', 0)) t(step, value)", False)
_top, _tsql = flat(("the", Q.MUST, 1.0), ("of", Q.SHOULD, 1.0))
register("topdocs_json", lambda spark, d: spark.createDataFrame([(searcher(spark, d).search(_top, limit=10).to_json(),)], "json string"), _tsql + """ select '[' || string_agg('{"doc": ' || doc_id || ', "score": ' || cast(score as double) || '}', ', ' order by score desc, doc_id) || ']' as json from (select doc_id, score from hits order by score desc, doc_id limit 10)""")

# Analysis
_PER_FIELD = analysis.PerFieldAnalyzer(analysis.letter_analyzer()).add_field("source", analysis.whitespace_analyzer())
register(
    "per_field",
    lambda spark, d: SearchIndex.build(documents(spark, d).select("doc_id", "text", "source"), analyzer=_PER_FIELD, max_field_length=None).postings.select("doc_id", "field", "term", "freq"),
    r"""with t as (select doc_id, 'text' as field, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from documents union all select doc_id, 'source', unnest(regexp_extract_all(source, '[^ \t\n\x0B\f\r]+')) from documents)
    select doc_id, field, term, cast(count(*) as integer) as freq from t group by 1, 2, 3""",
    False,
)


def _backwards(found):
    for t in found:
        yield analysis.Token(t.start, t.end, t.text[::-1], t.pos_inc)


register("tok_custom", tokens(analysis.Analyzer(analysis.LETTER, (analysis.FunctionFilter(_backwards),))), _SPLIT.format(r"list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: reverse(x))"), False)
for _name, _words in (("fr", stopwords.FRENCH), ("nl", stopwords.DUTCH), ("full_en", stopwords.FULL_ENGLISH)):
    _quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in _words)
    register(f"tok_stop_{_name}", tokens(analysis.Analyzer(analysis.LETTER, (analysis.LowerCaseFilter(), analysis.StopFilter(tuple(_words))))), f"select * from ({_SPLIT.format(r"regexp_extract_all(lower(text), '\p{L}+')")}) where term not in ({_quoted})", False)
register(
    "tok_hyphen",
    tokens(analysis.Analyzer(analysis.WHITESPACE, (analysis.LowerCaseFilter(), analysis.HyphenFilter()))),
    r"""with t as (select doc_id, unnest(x) as w, generate_subscripts(x, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[^ \t\n\x0B\f\r]+') as x from documents)),
    h as (select *, case when regexp_full_match(w, '\p{L}+(-\p{L}*)+') then list_filter(string_split(w, '-'), lambda p: p <> '') end as parts from t),
    s as (select *, i - 1 + cast(coalesce(sum(coalesce(len(parts) - 1, 0)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as place from h)
    select doc_id, case when parts is null then w else replace(w, '-', '') end as term, cast(place as integer) as pos from s
    union all select doc_id, unnest(parts), cast(place + generate_subscripts(parts, 1) - 1 as integer) from s where parts is not null""",
    False,
)
register("multi_mapper", lambda spark, d: documents(spark, d).select("doc_id", F.md5(analysis.MappingFilter((("the", "THE"), ("an", "x"))).text_column(F.col("text"))).alias("mapped")), "select doc_id, md5(replace(replace(text, 'the', 'THE'), 'an', 'x')) as mapped from documents", False)

# Scores
register(
    "norm_limits",
    lambda spark, d: documents(spark, d).select("doc_id", (F.pow(F.lit(10.0), (F.col("doc_id") % 41 - 20).cast("double")) * 1.37).alias("x")).select("doc_id", similarity.stored_norm(F.col("x")).alias("norm")),
    "select doc_id, case when x >= pow(2, 33) then 1.75 * pow(2, 32) when x < pow(2, -31) then 1.25 * pow(2, -31) when x < 1.25 * pow(2, -31) then 0 else floor(4 * x / pow(2, floor(log2(x)))) / 4 * pow(2, floor(log2(x))) end as norm from (select doc_id, pow(10.0, cast(doc_id % 41 - 20 as double)) * 1.37 as x from documents)",
    False,
)
#: A sloppy phrase: from the lowest slot's last position that none of the others' next ones passes, to the highest.
_SLOPPY = """,
    recursive_start as (select doc_id, list(pos order by pos) filter (term = '{a}') as a, list(pos - 1 order by pos) filter (term = '{b}') as b, list(pos - 2 order by pos) filter (term = '{c}') as c from tok where field = 'text' and term in ('{a}', '{b}', '{c}') group by doc_id),
    steps as (
        select doc_id, a, b, c, 0 as n, 0.0::double as add from recursive_start where a is not null and b is not null and c is not null
        union all
        select doc_id, case when low = 1 then list_filter(a, lambda x: x > fence) else a end, case when low = 2 then list_filter(b, lambda x: x > fence) else b end, case when low = 3 then list_filter(c, lambda x: x > fence) else c end, n + 1,
            case when greatest(a[1], b[1], c[1]) - list_max(list_filter(case low when 1 then a when 2 then b else c end, lambda x: x <= fence)) <= {slop}
                then 1.0 / (1 + greatest(a[1], b[1], c[1]) - list_max(list_filter(case low when 1 then a when 2 then b else c end, lambda x: x <= fence))) else 0 end
        from (select *, case when a[1] <= b[1] and a[1] <= c[1] then 1 when b[1] <= c[1] then 2 else 3 end as low, list_sort([a[1], b[1], c[1]])[2] as fence from steps where len(a) > 0 and len(b) > 0 and len(c) > 0)),
    f as (select doc_id, sum(add) as freq from steps group by doc_id having sum(add) > 0), i as (select sum(idf) as idf from w where field = 'text' and term in ('{a}', '{b}', '{c}'))
    select doc_id, round(sqrt(freq) * idf * norm, 6) as score from f cross join i join nrm using (doc_id) where field = 'text'"""
#: Spans of three terms in any order: the lowest goes on to its next position, step by step.
_NEAR = """,
    first as (select doc_id, list(pos order by pos) filter (term = '{a}') as a, list(pos order by pos) filter (term = '{b}') as b, list(pos order by pos) filter (term = '{c}') as c from tok where field = 'text' and term in ('{a}', '{b}', '{c}') group by doc_id),
    steps as (
        select doc_id, a, b, c, 0.0::double as add from first where a is not null and b is not null and c is not null
        union all
        select doc_id, case when low = a[1] then a[2:] else a end, case when low = b[1] then b[2:] else b end, case when low = c[1] then c[2:] else c end, case when high + 1 - low - 3 <= {slop} then 1.0 / (high + 2 - low) else 0 end
        from (select *, least(a[1], b[1], c[1]) as low, greatest(a[1], b[1], c[1]) as high from steps where len(a) > 0 and len(b) > 0 and len(c) > 0)),
    f as (select doc_id, sum(add) as freq from steps group by doc_id having sum(add) > 0), i as (select sum(idf) as idf from w where field = 'text' and term in ('{a}', '{b}', '{c}'))
    select doc_id, round(sqrt(freq) * idf * norm, 6) as score from f cross join i join nrm using (doc_id) where field = 'text'"""
scored("phrase_sloppy", Q.PhraseQuery("text", slop=3).add_term("of").add_term("the").add_term("and"), _SLOPPY.format(a="of", b="the", c="and", slop=3))
scored("span_near_unordered", Q.SpanNearQuery((span("text", "of"), span("text", "the"), span("text", "and")), 5), _NEAR.format(a="of", b="the", c="and", slop=5))
scored(
    "span_near",
    Q.SpanNearQuery((span("text", "of"), span("text", "the")), 3, True),
    """, m as (select x.doc_id, x.pos as a, min(y.pos) as b from tok x join tok y on x.doc_id = y.doc_id and x.field = 'text' and y.field = 'text' and x.term = 'of' and y.term = 'the' and y.pos > x.pos group by 1, 2),
    f as (select doc_id, sum(1.0 / (b + 2 - a)) as freq from m where b + 1 - a - 2 <= 3 group by doc_id), i as (select sum(idf) as idf from w where field = 'text' and term in ('of', 'the'))
    select doc_id, round(sqrt(freq) * idf * norm, 6) as score from f cross join i join nrm using (doc_id) where field = 'text'""",
)
scored("b_single", Q.BooleanQuery(clauses=(Q.BooleanClause(term("de", boost=2.0), Q.MUST),)), _ONE.format("de"))
scored("b_missing_must", Q.BooleanQuery(clauses=(Q.BooleanClause(term("the"), Q.MUST), Q.BooleanClause(term("nosuchword"), Q.MUST))), "select doc_id, 1.0 as score from documents where false")

# Filters
_EN = RangeFilter(Q.RangeQuery("lang", "en", "en"))


def _cached_filter(spark: SparkSession, d: str) -> DataFrame:
    """The same filter twice: worked out once, for both searches."""
    found = Searcher(index(spark, d).cache_filters())
    return rounded(found.hits(term("the"), _EN).unionByName(found.hits(term("de"), _EN)))


_IN_EN = " and doc_id in (select doc_id from documents where lang = 'en')"
register("f_cached", _cached_filter, "select * from (" + _ONE.format("the") + _IN_EN + ") union all select * from (" + _ONE.format("de") + _IN_EN + ")")
register("f_custom", lambda spark, d: rounded(searcher(spark, d).hits(term("the"), DocsFilter(lambda i: i.postings.filter("field = 'text' and freq > 5").select("doc_id")))), _ONE.format("the") + " and doc_id in (select doc_id from p where field = 'text' and freq > 5)")
register("sort_symbol", lambda spark, d: searcher(spark, d).search(term("de"), limit=25, sort=[FieldSymbol("source").string.desc, FieldSymbol("n_chars").integer]).hits, "select doc_id, score from (" + _ONE.format("de") + ") join documents using (doc_id) order by source desc nulls first, n_chars, doc_id limit 25")

# Highlights
register("match_vector", lambda spark, d: searcher(spark, d).match_vector("text:(of the)", "text", breaks=False), """,
    placed as (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as island from tok where field = 'text' and term in ('of', 'the'))
    select doc_id, cast(min(pos) as integer) as first, cast(max(pos) as integer) as last, cast(count(*) as double) as score from placed group by doc_id, island""")  # fmt: skip
register(
    "highlight_whole",
    lambda spark, d: (lambda s: s.highlight("text:und", "text", s.hits("text:und"), excerpt_length=None).select("doc_id", F.md5(F.array_join("excerpts", "|")).alias("marked")))(searcher(spark, d)),
    r"""select doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'), lambda x: case when lower(x) = 'und' then '<b>' || x || '</b>' else x end), '')) as marked from documents where list_contains(regexp_extract_all(lower(text), '\p{L}+'), 'und')""",
    False,
)


# The query language
def _parsed(name: str, text: str, sql: str) -> None:
    register(name, lambda spark, d: rounded(searcher(spark, d).hits(text)), sql)


_parsed("y_word", "text:und", _ONE.format("und"))
_parsed("y_all_fields", "*:en", ", i as (select f.field, coalesce(idf, ln(total) + 1) as idf from (values ('text'), ('lang'), ('source'), ('n_chars')) f(field) cross join nd left join w on w.field = f.field and w.term = 'en'), qn as (select 1 / sqrt(sum(idf * idf)) as qn from i) select doc_id, round(sum(sqrt(freq) * idf * idf * qn * norm) * count(*) / 4, 6) as score from p join i using (field), qn where term = 'en' group by doc_id")
_parsed("y_prefix", "text:thath*", _MULTI.format("select term, 1.0 from w where field = 'text' and term like 'thath%' order by term limit 512"))
_parsed("y_wildcard", "text:th?t*", _MULTI.format("select term, 1.0 from w where field = 'text' and term like 'th_t%' order by term limit 512"))
_parsed("y_phrase", 'text:"of the"', _PHRASE.format(a="'of'", b="'the'"))
_parsed("y_alternatives", 'text:"of|in the|a"', _PHRASE.format(a="'of', 'in'", b="'the', 'a'"))
_parsed("y_range", "lang:[de en}", "select distinct doc_id, 1.0 as score from p where field = 'lang' and term >= 'de' and term < 'en'")
_parsed("y_boost", "text:(+the^2.5 of^0.5)", flat(("the", Q.MUST, 2.5), ("of", Q.SHOULD, 0.5))[1] + " select doc_id, score from hits")
_parsed("y_words", "text:(the OR und OR que)", flat(("the", Q.SHOULD, 1.0), ("und", Q.SHOULD, 1.0), ("que", Q.SHOULD, 1.0))[1] + " select doc_id, score from hits")
_parsed("y_signs", "text:(the AND and NOT with)", flat(("the", Q.MUST, 1.0), ("and", Q.MUST, 1.0), ("with", Q.MUST_NOT, 1.0))[1] + " select doc_id, score from hits")
_parsed("y_escape", r"source:src\1", "select doc_id, round(sqrt(freq) * idf * norm, 6) as score from p join w using (field, term) where field = 'source' and term = 'src1'")
