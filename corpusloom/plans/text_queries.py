"""Queries for text search, sections and links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import searchindex as search
from corpusloom.operators import textsearch as op
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views
from corpusloom.sources import links
from corpusloom.sources.stored import save_pages
from corpusloom.sources.tables import shared_folder

_FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_COLUMNS = ("text", "source", "lang", "n_chars")
_TOKENS = "with tok as (" + " union all ".join(
    f"select id, {i} as col, unnest(w) as term, generate_subscripts(w, 1) as pos from (select id, regexp_extract_all({_FOLD.format(f'cast({c} as varchar)')}, '[\\p{{L}}\\p{{N}}]+') as w from txt)" for i, c in enumerate(_COLUMNS)
) + """),
tf as (select id, term, count(*) as tf from tok group by 1, 2), len as (select id, count(*) as length from tok group by 1), size as (select count(*) as n, avg(length) as average from len)"""
#: The documents have no date; this stands for one.
_DAY = "case when id % 7 = 0 then null else id % 50 end"

_INDEXES: dict[tuple[str, str, int, int], str] = {}


def _index(v: Views, fresh: bool = False) -> search.Index:
    """The stored index of a folder's texts: made by the application's first search of them, then read as long as the table stays as it is."""
    path = v.spark._jvm.org.apache.hadoop.fs.Path(f"{v.dir}/documents.parquet")
    files = path.getFileSystem(v.spark.sparkContext._jsc.hadoopConfiguration())
    place = v.spark.sparkContext.applicationId, v.dir, files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()
    if not fresh and place in _INDEXES:
        return search.open_index(v.spark, _INDEXES[place])
    _INDEXES[place] = shared_folder(v.spark)
    return search.save_index(v.txt, _INDEXES[place], "id", *_COLUMNS)


@query(_TOKENS + " select term, count(*) as df, cast(sum(tf) as bigint) as occurrences, min(id) as first_id from tf group by 1")
def search_index(v: Views) -> DataFrame:
    blocks = _index(v, fresh=True).blocks.filter("term != ''")
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("occurrences").alias("occurrences"), F.min(F.array_min("keys")).alias("first_id"))


_BM25 = """, hits as (select id, term as part, tf from tf where term in ('the', 'with', 'er') union all
  select a.id, 'of the', count(*) from tok a join tok b on b.id = a.id and b.col = a.col and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the' group by 1),
df as (select part, count(*) as df from hits group by 1), m as (select id from hits group by 1 having count(*) = 4)"""


@query(_TOKENS + _BM25 + f""", s as (select hits.id, sum(greatest(ln(((select n from size) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (select average from size)))) as raw
from hits join df on df.part = hits.part join len on len.id = hits.id where hits.id in (select id from m) group by 1)
select txt.id, round(raw, 6) as score, {_DAY} as day from s join txt on txt.id = s.id where lang = 'en' order by round(raw, 12) desc, day desc nulls last, txt.id limit 20""".replace("id % 7", "txt.id % 7").replace("else id", "else txt.id"))
def search_bm25(v: Views) -> DataFrame:
    docs = v.txt.withColumn("day", F.expr(_DAY))
    found = search.search_bm25(_index(v), "the WITH of-the (er)", 20, docs, "id", "lang", "en", "day")
    return found.select(F.col("key").alias("id"), "score", F.col("date").alias("day"))


# the forms of the query's stems; every end of a shortest stretch is a word of it, its start the last place by which both have come
_STEMS = r"""with w as (select id, regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') as w from txt),
t as (select id, unnest(w) as term, generate_subscripts(w, 1) as pos from w),
c as (select id, pos, case when regexp_matches(term, '^an(e|es|ed|ing|ingly|edly|ee)$') then 'ane' when regexp_matches(term, '^ha(ed|ing|edly|ingly)?$') then 'ha'
  when regexp_matches(term, '^on(e|es|ed|ing|ingly|edly|ee)$') then 'one' when regexp_matches(term, '^ea(ed|ing|edly|ingly)?$') then 'ea' when regexp_matches(term, '^re(ing|ingly)?$') then 're' end as stem from t),
near as (select a.id, a.stem, b.stem as next from c a join c b on b.id = a.id and b.pos = a.pos + 1),
p as (select id, pos, max(case when stem = 'ane' then pos end) over w as x, max(case when stem = 'ha' then pos end) over w as y from c where stem in ('ane', 'ha') window w as (partition by id order by pos)),
b as (select id, pos, least(x, y) as start, lag(least(x, y)) over (partition by id order by pos) as before from p where x is not null and y is not null),
one as (select id, sum(0.1 / (1 + pos - start + 1 - 2)) as score from b where before is null or start > before group by 1),
r as (select id, score from one where id not in (select id from near where stem = 'ea' and next = 're') union all select id, 0.1 * count(*) from near where stem = 'one' and next = 'one' group by 1),
best as (select id, round(max(cast(score as double)), 6) as score from r group by 1)"""


@query(_STEMS + f" select id, score, day from (select txt.id, score, {_DAY.replace('id %', 'txt.id %')} as day from best join txt on txt.id = best.id) order by score desc, day desc nulls last, id limit 200")
def search_phrase(v: Views) -> DataFrame:
    docs = v.txt.withColumn("day", F.expr(_DAY))
    found = search.search_web(_index(v), 'aned the -"EA re" HAING or "oned one" or -', 200, docs, "id", date="day")
    return found.select(F.col("key").alias("id"), "score", F.col("date").alias("day"))


@query("select id, lang from txt where contains(lower(text), 'tion an') or contains(lower(source), 'tion an')")
def search_substring(v: Views) -> DataFrame:
    return op.search_substring(v.txt, ["text", "source"], "TION an", [F.col("n_chars").desc(), F.col("id")]).select("id", "lang")


@query(_TOKENS + _BM25 + " select count(*) as n from m join txt on txt.id = m.id where lang = 'en'")
def search_count(v: Views) -> DataFrame:
    return search.count_matches(_index(v), search.plain_query("the WITH of-the (er)"), v.txt, "id", "lang", "en")


@query("with l as (select id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as page from txt) select id, cast(page as int) as page, trim(line, ' ') as text from l")
def page_split(v: Views) -> DataFrame:
    marked = v.txt.select("id", F.expr("array_join(transform(split(text, '\n', -1), (x, i) -> concat('[Page ', i + 1, ']', x)), '')").alias("text"))
    return op.page_split(marked, "id", "text")


_LINES = "with l as (select id, unnest(string_split(text, chr(10))) as line, cast(generate_subscripts(string_split(text, chr(10)), 1) as int) as page from txt)"


@query(_LINES + """, f as (select id, min(page) as first from l where regexp_matches(line, '(?i)^the ') group by 1)
select l.id, f.first, coalesce(min(case when page > f.first and regexp_matches(line, '(?i)^(and|of) ') then page end) - 1, max(page)) as last from l join f on f.id = l.id group by 1, 2""")
def section_range(v: Views) -> DataFrame:
    return op.section_range(op.line_pages(v.txt, "id", "text"), "id", "(?i)^the ", "(?i)^(and|of) ")


@query(_LINES + """, k as (select * from l where page >= 3), f as (select id, coalesce(min(case when regexp_matches(line, '^The ') then page end), min(case when regexp_matches(line, 'the') and length(line) <= 120 then page end)) as first from k group by 1)
select k.id, f.first, coalesce(min(case when page > f.first and regexp_matches(line, '^(And|Of) ') then page end) - 1, least(max(page), f.first + 9)) as last from k join f on f.id = k.id where f.first is not null group by 1, 2""")
def section_range_ranked(v: Views) -> DataFrame:
    return op.section_range_ranked(op.line_pages(v.txt, "id", "text"), "id", "^The ", "the", "^(And|Of) ", 3, 120, 10)


@query(_LINES + """, f as (select id, min(page) as first from l where regexp_matches(line, '(?i)^the ') group by 1),
r as (select l.id, f.first, coalesce(min(case when page > f.first and regexp_matches(line, '(?i)^(and|of) ') then page end) - 1, max(page)) as last from l join f on f.id = l.id group by 1, 2)
select r.id, cast(sum(length(line)) as bigint) as chars, count(*) as pages, md5(string_agg(line, chr(10) order by page)) as digest from r join l on l.id = r.id and page between first and last group by 1""")
def stored_pages(v: Views) -> DataFrame:
    """Sections, their density and their text from pages that are stored once, by document."""
    pages = save_pages(op.line_pages(v.txt, "id", "text"), "id")
    found = op.section_range(pages, "id", "(?i)^the ", "(?i)^(and|of) ")
    dense, whole = op.text_density(pages, found, "id", 150), op.section_concat(pages, found, "id", 1)
    return dense.join(whole, "id").select("id", "chars", "pages", "digest")


_SPAN = """, h as (select id, min(page) as a, max(page) as b, count(*) as n from l join (select id as i, max(page) as z from l group by 1) q on q.i = l.id where contains(regexp_replace(lower(line), '\\s+', ' ', 'g'), 'tion of') and (page >= 2 or z <= 2) group by 1), e as (select id, max(page) as z from l group by 1),
s as (select h.id, case when n = 1 then greatest(a - 3, 1) else a end as first, case when n = 1 then least(b + 3, z) else b end as last from h join e on e.id = h.id),
r as (select id, first, least(last, first + 7) as last from s)"""


def _span(v: Views) -> DataFrame:
    return op.phrase_span(op.line_pages(v.txt, "id", "text"), "id", "Tion  OF", 3, 8, 2)


@query(_LINES + _SPAN + " select * from r")
def phrase_span(v: Views) -> DataFrame:
    return _span(v)


@query(_LINES + _SPAN + " select r.id, cast(sum(length(line)) as bigint) as chars, count(*) as pages, sum(length(line)) >= 150 * count(*) as dense from r join l on l.id = r.id and page between first and last group by 1")
def text_density(v: Views) -> DataFrame:
    return op.text_density(op.line_pages(v.txt, "id", "text"), _span(v), "id", 150)


@query(_LINES + _SPAN + ", c as (select r.id, string_agg(line, chr(10) order by page) as t from r join l on l.id = r.id and page between first and last group by 1) select id, md5(t) as digest, left(t, 500) as text from c")
def section_concat(v: Views) -> DataFrame:
    return op.section_concat(op.line_pages(v.txt, "id", "text"), _span(v), "id", 500)


@query(r"""with s as (select id, text, length(text) as n, substr(text, 501, length(text) - 800) as mid from txt), t as (select *, string_split_regex(mid, '(?i)worthless|token') as parts, regexp_extract_all(mid, '(?i)worthless|token') as hits from s where n > 1500),
h as (select id, length(mid) as n, unnest(hits) as hit, unnest(parts[1:len(hits)]) as part, generate_subscripts(hits, 1) as i from t),
e as (select id, n, sum(length(part) + length(hit)) over (partition by id order by i) - length(hit) as start from h),
w as (select id, greatest(start - 100, 0) as a, least(start + 100, n) as b from e),
g as (select id, a, b, coalesce(a > max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding), true) as fresh from w),
k as (select id, a, b, sum(cast(fresh as int)) over (partition by id order by a, b rows unbounded preceding) as g from g),
m as (select id, min(a) as a, max(b) as b from k group by id, g), c as (select id, a, b, coalesce(sum(b - a) over (partition by id order by a rows between unbounded preceding and 1 preceding), 0) as used from m),
x as (select c.id, string_agg(substr(mid, cast(a as bigint) + 1, cast(least(b - a, 700 - used) as bigint)), chr(10) || chr(10) || '[...]' || chr(10) || chr(10) order by a) as middle from c join t on t.id = c.id where used <= 700 group by 1)
select s.id, case when n <= 1500 then text else concat_ws(chr(10) || chr(10) || '[...]' || chr(10) || chr(10), left(text, 500), nullif(middle, ''), right(text, 300)) end as excerpt from s left join x on x.id = s.id""")
def keyword_excerpt(v: Views) -> DataFrame:
    return op.keyword_excerpt(v.txt.select("id", "text"), "id", "text", "(?i)worthless|token", 200, 500, 300, 1500)


@query("select id, md5(text) as digest, min(id) over (partition by md5(text)) as source, id <> min(id) over (partition by md5(text)) as reused from txt")
def dedup_by_hash(v: Views) -> DataFrame:
    return op.dedup_by_hash(v.txt, "id", "text")


# of the tags with links the pages have anchors with a site's path only
_ANCHORS = r"""with a as (select id, url, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)">', 1), regexp_extract_all(html, '<a href="[^"]*">([^<]*)<', 1))) as l,
generate_subscripts(regexp_extract_all(html, '<a href="'), 1) - 1 as position from pg),
t as (select id, regexp_extract(url, '^[a-z]+://[^/?#]*') || l[1] as target, min(position) as position, arg_min(trim(regexp_replace(l[2], '\s+', ' ', 'g')), position) as link_text from a group by 1, 2)"""


@query(_ANCHORS + " select id, target, cast(position as int) as position, link_text from t where starts_with(target, 'http')")
def extract_links(v: Views) -> DataFrame:
    return links.extract_links(v.pg, F.col("target").startswith("http"))


@query(_ANCHORS + """, n as (select *, row_number() over (partition by id order by position) as n from t where starts_with(target, 'http') and not contains(target, '?'))
select id, target, cast(position as int) as position, link_text from n where n <= 3""")
def sub_page_links(v: Views) -> DataFrame:
    return links.sub_page_links(v.pg, "^http", "[?]", 3)


@query("""with u as (select id, unnest(regexp_extract_all(concat('see ', url, '. and ', url, '#top'), 'https?://[^\\s"''<>)\\]]+')) as raw from pg)
select distinct id, regexp_replace(regexp_replace(raw, '#.*$', ''), '[.,;:!?]+$', '') as url from u""")
def mine_urls(v: Views) -> DataFrame:
    return links.mine_urls(v.pg.select("id", F.concat(F.lit("see "), "url", F.lit(". and "), "url", F.lit("#top")).alias("text")), "id", "text")


@query("""with m as (select id, lpad(cast(id % 40 as varchar), 11, 'a') as media_id from pg)
select 'youtube' as platform, 'video' as kind, media_id, count(*) as n_pages, true as hinted, list_slice(list_sort(list(id)), 1, 3) as samples from m group by 3""")
def harvest_media(v: Views) -> DataFrame:
    frame = F.concat(F.col("html"), F.lit('<a href="https://youtu.be/'), F.lpad((F.col("id") % 40).cast("string"), 11, "a"), F.lit('">Board video</a>'))
    return links.harvest_media(v.pg.withColumn("html", frame), "board")
