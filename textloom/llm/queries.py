"""The subpackage's queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_crf, maxent_lm
from ._spark import table, text_of
from .bpe import Tokenizer, encode
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .line_dedup import dedup_lines
from .ngram_join import near_duplicates
from .pii import KINDS, find_spans, listed
from .url_filter import judge_urls, rule
from .warc import resolve_revisits

URL_RULES = [
    rule("allow", "com/"),
    rule("block", "example.com/en/"),
    rule("allow", "www.example.com/en/"),
    rule("block", "net/es/"),
    rule("block", "net/fr/"),
]


def captures(pages: DataFrame) -> DataFrame:
    """Three records for every page: its response, a revisit that names an ETag, and one before it that names a date."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.md5(F.coalesce("html", F.lit(""))).alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    at = F.col("page_id") * 10
    response = F.concat(F.lit("HTTP-Date: none\r\nContent-Type: text/html\r\nContent-Length: "), F.col("size"), F.lit('\r\nETag: "'), F.col("tag"), F.lit('"\r\nLast-Modified: rev '), F.col("page_id") % 7, F.lit("\r\nCache-Control: max-age=60"))
    later = F.concat(F.lit('ETag: W/"'), F.when(F.col("page_id") % 3 == 0, "other").otherwise(F.col("tag")), F.lit('"\r\nContent-Length: 0\r\nCache-Control: max-age=600\r\nCache-Control: max-age=900'))
    earlier = F.concat(F.lit("Last-Modified: rev "), F.col("page_id") % 7, F.lit("\r\nX-Seen: again"))
    made = F.array(
        F.struct((F.col("page_id") * 4).alias("record_id"), "url", at.alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("http_status"), response.alias("headers")),
        F.struct((F.col("page_id") * 4 + 1).alias("record_id"), F.concat("url", F.lit("#part")).alias("url"), (at + 5).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"), later.alias("headers")),
        F.struct((F.col("page_id") * 4 + 2).alias("record_id"), "url", (at - 5).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"), earlier.alias("headers")),
    )
    return p.select(F.inline(made))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    return found.withColumns({"headers": F.array_join("headers", "\n"), "original_id": F.coalesce("original_id", F.lit(-1)), "original_date": F.coalesce("original_date", F.lit(-1))})


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _is_kind(k: int):
    return lambda s: F.when(s["kind"] == k, 1)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_compact(F.transform("base", _is_kind(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = maxent_lm.fit(docs.filter(~held_out(10)).select(text_of().alias("text")))
    found = maxent_lm.score(docs, model, counts)
    return found.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts == 0


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5)))
    found = line_crf.score(docs, model).drop("text")
    return found.select("doc_id", held_out(5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def byte_bpe() -> Tokenizer:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return Tokenizer(file.read())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), decoded="text").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_url_filter, op3_line_crf, op4_bpe, op5_pii, op6_exact_dedup, op7_maxent_lm, op8_ngram_join, op9_decontaminate, op10_line_dedup)}

ORACLES = {
    "op1_warc_revisits": r"""
        with p as (select page_id, coalesce(url, '') as url, md5(coalesce(html, '')) as tag, strlen(coalesce(html, '')) as size from pages),
        cut as (
            select *, regexp_matches(url, '(?is)^[a-z][a-z0-9+.-]*://') as ok,
                regexp_extract(url, '(?is)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)([?][^#]*)?', ['host', 'path', 'query']) as u
            from p),
        canon as (
            select *, case when ok then
                regexp_replace(regexp_replace(translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(?:80|443)?$', ''), '^www\d?\.', '')
                || regexp_replace(u.path, '/$', '')
                || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as c
            from (select *, list_sort(list_filter(string_split(substr(u.query, 2), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(?:utm_[a-z]+|gclid|fbclid|sessionid|jsessionid|phpsessid)=[^&]*$'))) as params from cut)),
        revisits as (
            select page_id * 4 + 1 as record_id, c, page_id * 10 + 5 as date, 'W/"' || case when page_id % 3 = 0 then 'other' else tag end || '"' as etag, null as since,
                'cache-control: max-age=900' as cache, null as seen, 'content-length: 0' as length from canon
            union all
            select page_id * 4 + 2, c, page_id * 10 - 5, null, 'rev ' || (page_id % 7), null, 'x-seen: again', null from canon),
        latest as (
            select r.record_id, any_value(r.c) as c, any_value(r.date) as date, any_value(r.etag) as etag, any_value(r.since) as since, any_value(r.cache) as cache, any_value(r.seen) as seen, any_value(r.length) as length,
                arg_max(o.page_id * 4, o.page_id) as original_id, max(o.page_id) * 10 as original_date, arg_max(o.tag, o.page_id) as tag, arg_max(o.size, o.page_id) as size
            from revisits r left join canon o on o.c = r.c and o.page_id * 10 < r.date group by r.record_id),
        judged as (
            select *, case when original_id is null then 'no_original'
                when etag is not null then case when replace(etag, 'W/', '') = '"' || tag || '"' then 'resolved' else 'mismatch' end
                when since = 'rev ' || ((original_id // 4) % 7) then 'resolved' else 'mismatch' end as status from latest)
        select record_id, c as canonical_url, date, status, coalesce(original_id, -1) as original_id, coalesce(original_date, -1) as original_date,
            case when status = 'resolved' then array_to_string(list_sort(list_filter([
                coalesce(cache, 'cache-control: max-age=60'), 'content-length: ' || size, 'content-type: text/html', 'etag: ' || coalesce(etag, '"' || tag || '"'),
                'http-date: none', 'last-modified: ' || coalesce(since, 'rev ' || ((original_id // 4) % 7)), seen], lambda x: x is not null)), chr(10))
            else array_to_string(list_sort(list_filter([cache, length, 'etag: ' || etag, 'last-modified: ' || since, seen], lambda x: x is not null)), chr(10)) end as headers
        from judged""",
    "op2_url_filter": r"""
        with parts as (
            select page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
            from pages),
        rules(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best as (
            select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
            from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
            group by page_id)
        select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts p left join best using (page_id)""",
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept,
            sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op10_line_dedup": r"""
        with split as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
            from documents),
        keyed as (
            select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from split),
        shared as (select key, max(doc_id) as keep from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
        marked as (select k.doc_id, k.line, k.i, coalesce(k.doc_id < s.keep, false) as lost from keyed k left join shared s on k.key = s.key)
        select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256
        from marked group by doc_id""",
}
