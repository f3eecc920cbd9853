"""Queries for column expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import expressions as fn
from corpusloom.plans.registry import query
from corpusloom.plans.views import Views

S = lambda c: F.col(c).cast("string")
_JSON = """with j as (select id, case when id % 13 = 0 then '{bad' when id % 11 = 0 then concat('{"a": ', cast(id as varchar), '}') when id % 7 = 0 then '[]'
else concat('[{"a": ', cast(id as varchar), '}, 5, {"b": 1}]') end as payload from doc) """
_NAMED = """with n as (select *, case when id % 7 = 0 then concat('Board_Pack_', strftime(meeting_date, '%m-%d-%Y'), '.pdf') when id % 7 = 1 then concat('agenda.board.', strftime(meeting_date, '%m%d%Y'), '.pdf')
when id % 7 = 2 then concat('minutes-and-agenda-', strftime(meeting_date, '%Y-%m-%d')) when id % 7 = 3 then 'Investment Report' when id % 7 = 4 then concat('IC_Agenda_', strftime(meeting_date, '%-m.%-d.%y'), '.pdf')
when id % 7 = 5 then concat(strftime(meeting_date, '%B-%Y'), '-Board-Highlights.pdf') else concat('Returns ', strftime(meeting_date, '%B %-d, %Y')) end as name from doc) """


def _json(v: Views) -> DataFrame:
    one = F.concat(F.lit('[{"a": '), S("id"), F.lit('}, 5, {"b": 1}]'))
    payload = F.when(F.col("id") % 13 == 0, "{bad").when(F.col("id") % 11 == 0, F.concat(F.lit('{"a": '), S("id"), F.lit("}"))).when(F.col("id") % 7 == 0, "[]").otherwise(one)
    return v.doc.select("id", payload.alias("payload"))


def _named(v: Views) -> DataFrame:
    day = lambda f: F.coalesce(F.date_format("meeting_date", f), F.lit(""))
    shapes = [
        F.concat(F.lit("Board_Pack_"), day("MM-dd-yyyy"), F.lit(".pdf")), F.concat(F.lit("agenda.board."), day("MMddyyyy"), F.lit(".pdf")), F.concat(F.lit("minutes-and-agenda-"), day("yyyy-MM-dd")), F.lit("Investment Report"),
        F.concat(F.lit("IC_Agenda_"), day("M.d.yy"), F.lit(".pdf")), F.concat(day("MMMM-yyyy"), F.lit("-Board-Highlights.pdf")), F.concat(F.lit("Returns "), day("MMMM d, yyyy")),
    ]
    return v.doc.withColumn("name", F.get(F.array(*shapes), (F.col("id") % 7).cast("int")))


#: What each shape of name gives: the day, the day in this century, nothing, or the month's first day.
_KNOWN = """case when id % 7 = 4 then make_date(2000 + year(meeting_date) % 100, month(meeting_date), day(meeting_date)) when id % 7 = 3 then null
when year(meeting_date) between 2000 and 2035 then case when id % 7 = 5 then date_trunc('month', meeting_date)::date else meeting_date end end"""
_KNOWN = f"case when year({_KNOWN}) between 2000 and 2035 then {_KNOWN} end"


@query(_JSON + "select id, case when id % 13 = 0 or id % 11 = 0 or id % 7 = 0 then cast(0 as bigint) else 2 end as n, case when id % 13 = 0 or id % 11 = 0 or id % 7 = 0 then null else id end as a from j")
def json_list_tolerant(v: Views) -> DataFrame:
    rows = _json(v).withColumn("items", fn.json_list_tolerant("payload"))
    return rows.select("id", F.size("items").cast("bigint").alias("n"), F.try_variant_get(F.get("items", F.lit(0)), "$.a", "bigint").alias("a"))


@query("select id, concat('{\"a\": ', cast(id as varchar), '}') as body, id as a from plan")
def json_fence_strip(v: Views) -> DataFrame:
    rows = v.plan.select("id", fn.json_fence_strip(F.concat(F.lit('```json\n{"a": '), S("id"), F.lit("}\n```"))).alias("body"))
    return rows.withColumn("a", F.try_variant_get(F.try_parse_json("body"), "$.a", "bigint"))


@query("select id, case when id % 4 = 0 then null when id % 4 = 1 then null else cast(id as double) / 2 end as number from plan")
def coerce_number(v: Views) -> DataFrame:
    text = F.when(F.col("id") % 4 == 0, "None").when(F.col("id") % 4 == 1, " ").otherwise(F.concat(F.lit(" "), (F.col("id") / 2).cast("string")))
    return v.plan.select("id", fn.coerce_number(text).alias("number"))


@query("select id, md5(text) as digest from txt")
def md5_text(v: Views) -> DataFrame:
    return v.txt.select("id", F.md5("text").alias("digest"))


@query("""select id, sha256(concat('{"id":', cast(id as varchar), ',"region":', coalesce(cast(region_id as varchar), 'null'), '}')) as digest from plan""")
def sha256_json(v: Views) -> DataFrame:
    return v.plan.select("id", fn.sha256_json(region="region_id", id="id").alias("digest"))


@query("""select id, left(sha256(concat_ws('|', cast(plan_id as varchar), coalesce(doc_type, ''), cast(coalesce(meeting_date, downloaded_on) as varchar), concat('h ', cast(id % 9000 as varchar), ' pdf'))), 16) as key from doc""")
def deterministic_id(v: Views) -> DataFrame:
    return v.doc.select("id", fn.deterministic_id("plan_id", "doc_type", ["meeting_date", "downloaded_on"], F.replace("url", F.lit("https://"), F.lit(""))).alias("key"))


@query(_NAMED + "select id, case id % 7 when 0 then 'board_pack' when 1 then 'agenda' when 2 then 'minutes' when 3 then 'performance' when 4 then 'agenda' when 5 then 'board_pack' else 'performance' end as kind from n")
def classify_doc_type(v: Views) -> DataFrame:
    return _named(v).select("id", fn.classify_doc_type("name").alias("kind"))


@query("select id, ['audit', 'investment', 'board', 'actuarial', 'board', 'investment', 'audit'][id % 7 + 1] as kind from txt")
def classify_meeting(v: Views) -> DataFrame:
    names = ["Risk  Committee notes", "the Investment Committee and its actuarial study", "a full board", "Funded Status", "audit of the plan", "Portfolio review", "Audit Committee, Board of Trustees"]
    return v.txt.select("id", fn.classify_meeting("text", F.get(F.array(*map(F.lit, names)), (F.col("id") % 7).cast("int"))).alias("kind"))


_DOC_URLS = ["a.html?f=b.pdf", "x/A.PDF?v=1", "documents/7/download", "media/12/download", "b/DocumentDownload.ashx?id=3", "media/x/download"]


@query("select id, regexp_matches(lower(url), '\\.(html)([?#].*)?$') as is_page, id % 6 in (1, 2, 3, 4) as is_doc, (contains(url, '/en/') or contains(url, '/de/')) and not contains(url, 'utm_') as in_focus from pg")
def is_doc_url(v: Views) -> DataFrame:
    return v.pg.select("id", F.lower("url").rlike(r"\.(html)([?#].*)?$").alias("is_page"), fn.is_doc_url(F.concat(F.lit("https://h/"), F.get(F.array(*map(F.lit, _DOC_URLS)), (F.col("id") % 6).cast("int")))).alias("is_doc"), fn.focus_exclude("url", ["/en/", "/de/"], ["utm_"]).alias("in_focus"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join("null" if x is None else "'" + x.replace("'", "''") + "'" for x in values) + "]"


def _case(values: list, key: str = "id") -> Column:
    """The key's case among the values; ``#`` stands for the key."""
    return F.replace(F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int")), F.lit("#"), S(key))


def _case_sql(values: list, key: str = "id") -> str:
    return f"replace({_sql_list(values)}[{key} % {len(values)} + 1], '#', cast({key} as varchar))"


_FILE_URLS = [
    "https://h/#.pdf", "https://h/a/Board Pack #.DOCX?v=1", "https://h/files/governance/15-2025-acfr-#/open", "https://h/DocumentDownload.ashx?id=#", "https://h/reports/2026-q#/DocumentDownload.ashx",
    "https://h/files/Default.aspx?id=#", "https://h/get-#.php", "https://h/files/april.board.#", "https://h/x/#/", "https://h/", "https://h", "https://h/view", "https://h/réport #/download#top",
    "https://h/a.xls/#.tar.gz", "https://h/a/.hidden#", "https://h/" + "long-" * 20 + "#", "https://h/a/%%%/file", "https://h/DOWNLOAD.aspx", "https://h/a.b/page.html", "https://h/documents/#/download",
]
_LINK_TEXTS = ["", None, "March 2026 Board Materials", " April pack.XLSX ", "see a.docs", "???", "minutes.doc, page 2"]


@query(f"""with c as (select id, {_case_sql(_FILE_URLS)} as url, coalesce({_sql_list(_LINK_TEXTS)}[id % {len(_LINK_TEXTS)} + 1], '') as said from doc),
p as (select *, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as parts from c),
n as (select *, coalesce(parts[-1], '') as name, case when regexp_matches(parts[-1], '^.+\\.[^.]+$') then lower(regexp_extract(parts[-1], '\\.([^.]+)$', 1)) else '' end as ext from p),
s as (select *, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') as stem, regexp_replace(parts[-2], '^(.+)\\.[^.]+$', '\\1') as parent, lower(regexp_extract(said, '(?i)\\.(pdf|docx?|xlsx?)\\b', 1)) as named from n),
w as (select *, case when ext not in ('ashx', 'aspx', 'php', 'cgi', 'jsp', 'do', 'action') and lower(stem) not in ('', 'open', 'download', 'view', 'file', 'default', 'page', 'show', 'documentdownload', 'getdocument', 'documents') then stem
  when len(parts) >= 2 then parent else trim(said) end as source from s),
g as (select *, trim(left(regexp_replace(source, '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), 60), '-') as slug from w)
select id, case when ext in ('pdf', 'docx', 'doc', 'xlsx') then name else concat(case when slug = '' then left(md5(url), 12) else slug end, '.', case when named = '' then 'pdf' else named end) end as filename from g""")
def make_filename(v: Views) -> DataFrame:
    return v.doc.select("id", fn.make_filename(_case(_FILE_URLS), F.get(F.array(*map(F.lit, _LINK_TEXTS)), (F.col("id") % len(_LINK_TEXTS)).cast("int"))).alias("filename"))


@query(_NAMED + f"select id, {_KNOWN} as found from n")
def date_from_name(v: Views) -> DataFrame:
    return _named(v).select("id", fn.date_from_name("name").alias("found"))


@query(_NAMED + f""", i as (select *, {_KNOWN} as found, case when id % 9 = 0 then null else downloaded_on end as loaded, downloaded_on - cast(id % 3000 as int) as worded from n)
select id, coalesce(case when id % 2 = 0 and (loaded is null or (meeting_date <= downloaded_on + 60 and meeting_date >= downloaded_on - 1825)) then meeting_date end,
case when loaded is null or (found <= downloaded_on + 60 and found >= downloaded_on - 1825) then found end, case when id % 4 = 1 then null when loaded is null or worded <= downloaded_on + 60 and worded >= downloaded_on - 1825 then worded end) as inferred from i""")
def date_infer(v: Views) -> DataFrame:
    existing = F.when(F.col("id") % 2 == 0, F.col("meeting_date"))
    worded = F.date_format(F.date_sub("downloaded_on", (F.col("id") % 3000).cast("int")), "MMMM d, yyyy")
    text = F.when(F.col("id") % 4 == 1, F.concat(F.lit("filed 03/04/2001 as 20010304 and "), F.lit("no other date"))).otherwise(F.concat(F.lit("a 20010304 meeting on "), worded, F.lit(" at noon")))
    loaded = F.when(F.col("id") % 9 != 0, F.col("downloaded_on"))
    return _named(v).select("id", existing.alias("existing"), "name", text.alias("text"), loaded.alias("loaded")).select("id", fn.date_infer("existing", "name", "text", "loaded").alias("inferred"))


@query(_NAMED + f""", i as (select *, {_KNOWN} as found, case when id % 3 = 0 then downloaded_on + 90 else meeting_date end as stored from n)
select id, case when stored > downloaded_on + 60 then case when found <= downloaded_on + 60 then found end else stored end as repaired,
case when not coalesce(stored > downloaded_on + 60, false) then 'kept' when found <= downloaded_on + 60 then 'updated' else 'cleared' end as outcome from i""")
def date_repair(v: Views) -> DataFrame:
    stored = F.when(F.col("id") % 3 == 0, F.date_add("downloaded_on", 90)).otherwise(F.col("meeting_date"))
    date, outcome = fn.date_repair("stored", "name", "downloaded_on")
    return _named(v).withColumn("stored", stored).select("id", date.alias("repaired"), outcome.alias("outcome"))


@query("""select id, case when meeting_date is not null then cast(year(meeting_date) as int) else cast([2021, 2024, 2013, 2017, null, 2022][id % 6 + 1] as int) end as year from doc""")
def year_infer(v: Views) -> DataFrame:
    names = ["x 3.14.21", "b 241218", "c 071813", "board 2017 of 2031", "d 351399 9.9.44", "e 4-24_22"]
    return v.doc.select("id", fn.year_infer(F.get(F.array(*map(F.lit, names)), (F.col("id") % 6).cast("int")), "meeting_date").alias("year"))


_YEAR_URLS = ["https://h/files/2024/r_17.pdf", "https://h/1999-report-1985", "https://h/12021x", "https://h/r2031.pdf", "https://h/1989", "no year", "https://h/FY19992005_20319", None, "https://h/2040/2012"]


@query(f"""with c as (select id, {_sql_list(_YEAR_URLS)}[id % {len(_YEAR_URLS)} + 1] as url from doc)
select id, list_max(list_filter(list_transform(regexp_extract_all(url, '20[0-3][0-9]|19[0-9][0-9]'), lambda y: cast(y as int)), lambda y: y >= 1990 and y <= 2027)) as year from c""")
def year_from_url(v: Views) -> DataFrame:
    return v.doc.select("id", fn.year_from_url(F.get(F.array(*map(F.lit, _YEAR_URLS)), (F.col("id") % len(_YEAR_URLS)).cast("int")), 2027).alias("year"))


@query("select id, cast(year(downloaded_on) - case when strftime(downloaded_on, '%m-%d') < '06-30' then 1 else 0 end as int) as year from doc")
def expected_fiscal_year(v: Views) -> DataFrame:
    return v.doc.select("id", fn.expected_fiscal_year("downloaded_on", F.lit("06-30")).alias("year"))


@query("""select id, downloaded_on - cast(case when dayofweek(downloaded_on) = 6 then 7 else dayofweek(downloaded_on) + 1 end as int) as week_end,
cast(date_trunc('month', downloaded_on) - interval 1 month as date) as month_start, cast(date_trunc('month', downloaded_on) - interval 1 day as date) as month_end,
cast(date_trunc('quarter', downloaded_on) - interval 3 month as date) as quarter_start from doc""")
def period_bounds(v: Views) -> DataFrame:
    month, quarter = fn.prior_period("downloaded_on", "month"), fn.prior_period("downloaded_on", "quarter")
    return v.doc.select("id", fn.week_end("downloaded_on").alias("week_end"), month[0].alias("month_start"), month[1].alias("month_end"), quarter[0].alias("quarter_start"))


@query("""with p as (select id, downloaded_on as a, downloaded_on + cast(id % 40 as int) as b from doc)
select id, case when year(a) <> year(b) then strftime(a, '%b %-d, %Y') || ' – ' || strftime(b, '%b %-d, %Y') when month(a) <> month(b) then strftime(a, '%b %-d') || ' – ' || strftime(b, '%b %-d, %Y')
else strftime(a, '%b %-d') || '–' || strftime(b, '%-d, %Y') end as label from p""")
def period_label(v: Views) -> DataFrame:
    return v.doc.select("id", fn.period_label("downloaded_on", F.date_add("downloaded_on", (F.col("id") % 40).cast("int"))).alias("label"))


@query("select id, case when id >= 3600 then concat(cast(id // 3600 as varchar), 'h', lpad(cast(id % 3600 // 60 as varchar), 2, '0'), 'm') else concat(cast(id // 60 as varchar), 'm ', cast(id % 60 as varchar), 's') end as duration from doc")
def duration_text(v: Views) -> DataFrame:
    return v.doc.select("id", fn.duration_text("id").alias("duration"))


@query("""with b as (select extract_id, seq, actual_bp - target_bp as bp from alloc)
select extract_id, seq, case when bp is null then '' else concat(case when bp < 0 then '-' else '+' end, cast(abs(bp) // 100 as varchar), '.', lpad(cast(abs(bp) % 100 as varchar), 2, '0'), '%') end as shown, case when bp is null then '' else concat('$', format('{:,}', bp * 1000003), '.0m') end as amount from b""")
def number_format(v: Views) -> DataFrame:
    return v.alloc.select("extract_id", "seq", fn.signed_percent(F.col("actual_bp") - F.col("target_bp")).alias("shown"), fn.dollars((F.col("actual_bp") - F.col("target_bp")).cast("bigint") * 1000003, "m").alias("amount"))


@query(r"""with c as (select id, case when id % 9 <> 0 then concat(chr(10), ' ', text) end as text from txt), l as (select id, regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\s+|\s+$', '', 'g') as line from c)
select id, case when length(line) <= 80 then line else regexp_replace(left(line, 80), '\s+$', '') || '…' end as excerpt from l""")
def excerpt(v: Views) -> DataFrame:
    text = F.when(F.col("id") % 9 != 0, F.concat(F.lit("\n "), "text"))
    return v.txt.select("id", fn.excerpt(text, 80).alias("excerpt"))


@query(r"""with w as (select id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as words from txt)
select id, case when len(words) > 90 then array_to_string(words[1:90], ' ') || '…' else text end as words, len(words) > 90 as cut from w""")
def truncate_words(v: Views) -> DataFrame:
    return v.txt.select("id", fn.truncate_words("text", 90).alias("t")).select("id", F.col("t.text").alias("words"), F.col("t.cut").alias("cut"))


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?m)^#{{1,6}}\s+', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '(?m)^\s*[0-9]+\.\s+', '', 'g'),
'\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"""

_TRIMMED = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# notes of four kinds around a document's text: with a summary of its own, with a title and a date line, bare, and none
@query("with n as (select id, case id % 4 when 0 then text when 1 then text when 2 then text end as body from txt), p as (select id, " + _TRIMMED.format(x=_STRIPPED.format(x="coalesce(body, '')")) + r""" as plain from n),
c as (select id, plain, left(plain, 700) as cut, length(regexp_extract(left(plain, 700), '(?s)^(.*(?:\.[ \n]|[?!] ))', 1)) - 2 as spot from p)
select id, case when length(plain) <= 700 then plain else regexp_replace(case when spot > 420 then left(cut, spot + 1) else cut end, '\s+$', '') || ' …' end as preview from c""")
def preview(v: Views) -> DataFrame:
    kind = F.col("id") % 4
    own = F.concat(F.lit("# Title\n\nbefore\n\n## tl;dr \n\n"), "text", F.lit("\n## Next\nafter"))
    dated = F.concat(F.lit("# Title\n\n*Generated: 2026-05-02*\n---\n  \n"), "text")
    note = F.when(kind == 0, own).when(kind == 1, dated).when(kind == 2, F.col("text"))
    return v.txt.select("id", fn.preview(note).alias("preview"))


_MARKED = ["## Title #", "**one** and *two* of `three`", "- item [name #](http://x/y)", "  12. numbered #", "a\n\n\n\nb * c", "1.5 stays, **un*closed**", "+ plus\n* star\n###### deep", "####### not a heading"]


@query(f"with m as (select id, concat({_case_sql(_MARKED)}, chr(10), {_case_sql(_MARKED[3:] + _MARKED[:3])}, chr(10), {_case_sql(_MARKED[5:])}) as text from plan) select id, ".replace("\n", "' || chr(10) || '") + _TRIMMED.format(x=_STRIPPED.format(x="text")) + " as plain from m")
def strip_markup(v: Views) -> DataFrame:
    text = F.concat_ws("\n", _case(_MARKED), _case(_MARKED[3:] + _MARKED[:3]), _case(_MARKED[5:]))
    return v.plan.select("id", fn.strip_markup(text).alias("plain"))


@query("select id, regexp_replace(name, '(customer)', '<mark>\\1</mark>', 'gi') as shown from plan")
def highlight(v: Views) -> DataFrame:
    return v.plan.select("id", fn.highlight("name", "customer").alias("shown"))


@query("select id, concat('see [', i, '](/d/', i, ') and [', i, '](/d/', i, ') [7](/d/7)') as linked from (select id, cast(id as varchar) as i from plan) p")
def rewrite_citations(v: Views) -> DataFrame:
    i = S("id")
    return v.plan.select("id", fn.rewrite_citations(F.concat(F.lit("see ["), i, F.lit("] and ["), i, F.lit(", 7]")), "/d").alias("linked"))


_MESSAGES = [
    "ERROR: Video unavailable. This content isn't available, try again later. The session has been rate-limited.", "ERROR: [x] #: Video unavailable", "Private video. Sign in", "This video has been REMOVED by the uploader",
    "HTTP Error 500", "404 Not Found", None, "the account associated with this video has been terminated", "it has been removed by the uploader; rate-limited",
]


@query(f"""with m as (select id, lower({_case_sql(_MESSAGES)}) as m from plan)
select id, case when contains(m, 'rate-limited') or contains(m, 'try again later') then 'transient'
when regexp_matches(m, 'private video|video unavailable|has been removed|account associated with this video has been terminated') then 'gone' else 'transient' end as class from m""")
def error_class(v: Views) -> DataFrame:
    return v.plan.select("id", fn.error_class(_case(_MESSAGES)).alias("class"))


_NAMES = ["Calendar #.pdf", "Board pack.pdf", None, "cover-page.pdf", "roadmap.pdf", "NOTICE_ONLY.pdf", "minutes #.pdf", "bios.doc"]


@query(rf"""with n as (select id, case when id % 10 = 0 then concat(chr(10), left(text, 90), '      ', chr(9)) when id % 10 = 1 then null else text end as text, {_case_sql(_NAMES)} as name from txt)
select id, case when length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 100 then 'insufficient text'
when regexp_matches(lower(name), 'attendance|building|map|calendar|cover.?page|direction|notice.only|parking|visitor|hotel|travel|bio|headshot') then concat('non-substantive filename (', name, ')') end as reason from n""")
def skip_reason(v: Views) -> DataFrame:
    text = F.when(F.col("id") % 10 == 0, F.concat(F.lit("\n"), F.left("text", F.lit(90)), F.lit("      \t"))).when(F.col("id") % 10 != 1, F.col("text"))
    return v.txt.select("id", fn.skip_reason(text, _case(_NAMES)).alias("reason"))


@query("select id, id % 3 = 0 as placeholder from plan")
def placeholder_only(v: Views) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, "[Page 1]\n\n[Page 2]\n").when(F.col("id") % 3 == 1, "[Page 1]\ntext\n")
    return v.plan.select("id", fn.placeholder_only(text).alias("placeholder"))


_TITLES = ["Board of Trustees, March", "Investment  Committee #", "Regular\tMeeting", "Town hall", None, "Quick tip: plan benefits", "Trustee meeting", "trustees MEETING 4", "Pension Boards", "Meeting of the board", "board of regents", "Special meetings #"]


@query(rf"""select id, coalesce(regexp_matches({_case_sql(_TITLES)},
'(?i)board\s+(meeting|of\s+(administration|trustees|directors|managers|education))|(investment|audit|finance|executive|governance)\s+committee|trustees?\s+meeting|(retirement|pension)\s+board|(regular|special|quarterly|annual|committee|public)\s+meeting'), false) as matches from plan""")
def title_match(v: Views) -> DataFrame:
    return v.plan.select("id", fn.title_match(_case(_TITLES)).alias("matches"))


#: url, and its platform, kind, id and canonical url; ``#`` stands for a number.
_MEDIA = [
    ("https://youtu.be/aaaaa#", "youtube", "video", "aaaaa#", "https://youtu.be/aaaaa#"),
    ("https://m.youtube.com/@Board#/videos", "youtube", "directory", "@Board#", "https://www.youtube.com/@Board#"),
    ("https://www.youtube.com/CalPlan#", "youtube", "directory", "CalPlan#", "https://www.youtube.com/CalPlan#"),
    ("https://www.youtube.com/watch?t=1&v=bbbbb#&x=2", "youtube", "video", "bbbbb#", "https://www.youtube.com/watch?t=1&v=bbbbb#&x=2"),
    ("https://youtube.com/playlist?list=PLabcdefgh#", "youtube", "directory", "PLabcdefgh#", "https://www.youtube.com/playlist?list=PLabcdefgh#"),
    ("https://vimeo.com/#", "vimeo", "video", "#", "https://vimeo.com/#"),
    ("https://vimeo.com/plan#/about", "vimeo", "directory", "plan#", "https://vimeo.com/plan#"),
    ("https://vimeo.com/categories", None, None, None, None),
    ("https://city#.granicus.com/MediaPlayer.php?clip_id=3", "granicus", "directory", "city#", "https://city#.granicus.com/ViewPublisher.php?view_id=2"),
    ("http://town#.swagit.com/play/1", "swagit", "directory", "town#", "https://town#.swagit.com/"),
    ("https://us#.zoom.us/rec/share/x", "zoom", "directory", "us#.zoom.us", "https://us#.zoom.us/rec/"),
    ("https://us#.zoom.us/j/5", None, None, None, None),
    ("https://www.facebook.com/Plan#/videos", "facebook", "directory", "Plan#", "https://www.facebook.com/Plan#/"),
    ("https://x/y?u=youtube.com/@no#", None, None, None, None),
]


def _media_sql(i: int) -> str:
    rows = ", ".join("null" if m[i] is None else f"'{m[i]}'" for m in _MEDIA)
    return f"replace([{rows}][id % {len(_MEDIA)} + 1], '#', lpad(cast(id as varchar), 6, '0'))"


@query(f"select id, {_media_sql(1)} as platform, {_media_sql(2)} as kind, {_media_sql(3)} as key, {_media_sql(4)} as canonical from plan")
def url_classify(v: Views) -> DataFrame:
    url = F.replace(F.get(F.array(*(F.lit(m[0]) for m in _MEDIA)), (F.col("id") % len(_MEDIA)).cast("int")), F.lit("#"), F.lpad(S("id"), 6, "0"))
    rows = v.plan.select("id", url.alias("url")).withColumn("c", fn.url_classify("url"))
    return rows.select("id", F.col("c.platform").alias("platform"), F.col("c.kind").alias("kind"), F.col("c.id").alias("key"), F.col("c.canonical").alias("canonical"))


@query("select id, case when id % 3 = 0 then 'https://h/2024/r.pdf' when id % 3 = 1 then 'https://l/acfr-2024.pdf' end as url from plan")
def url_for_year(v: Views) -> DataFrame:
    template = F.when(F.col("id") % 3 == 0, "https://h/{year}/r.pdf")
    linked = F.when(F.col("id") % 3 == 1, "https://l/acfr-2024.pdf")
    return v.plan.select("id", template.alias("t"), linked.alias("l"), F.lit("https://s/2019.pdf").alias("s")).select("id", fn.url_for_year("t", "l", "s", 2024).alias("url"))


_KEYS = ["a b/c#", "../x#", "###", "é#", "v_#-1.mp4"]


@query(f"""with r as (select d.id, p.name, {_case_sql(_KEYS, 'd.id')} as key, case when d.id % 3 <> 0 then d.meeting_date end as met, case when d.id % 5 <> 0 then d.downloaded_on end as made from doc d join plan p on p.id = d.plan_id)
select id, concat(regexp_replace(replace(name, ' ', '_'), '[^A-Za-z0-9._-]+', '', 'g'), '/', coalesce(cast(met as varchar), cast(made as varchar), 'undated'), '_',
coalesce(nullif(regexp_replace(replace(key, ' ', '_'), '[^A-Za-z0-9._-]+', '', 'g'), ''), 'x'), '.mp4') as path from r""")
def safe_path(v: Views) -> DataFrame:
    rows = v.doc.join(v.plan.select(F.col("id").alias("plan_id"), "name"), "plan_id")
    met, made = F.when(F.col("id") % 3 != 0, F.col("meeting_date")), F.when(F.col("id") % 5 != 0, F.col("downloaded_on"))
    return rows.select("id", fn.safe_path("name", _case(_KEYS), met, made, F.lit(".mp4")).alias("path"))


@query("select id, case when id % 2 = 0 then concat(cast(downloaded_on as varchar), 'T10:00:00Z') else concat(cast(downloaded_on as varchar), 'T10:00:00+00:00') end as stamp from doc")
def utc_stamp(v: Views) -> DataFrame:
    naive = F.concat(S("downloaded_on"), F.lit("T10:00:00"))
    return v.doc.select("id", fn.utc_stamp(F.when(F.col("id") % 2 == 0, F.concat(naive, F.lit("Z"))).otherwise(naive)).alias("stamp"))


@query("select id, cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'des') as int) + cast(contains(lower(text), 'que') as int) as score from txt")
def relevance(v: Views) -> DataFrame:
    return v.txt.select("id", fn.relevance("text", ["the", "des", "que"]).alias("score"))


_DOC_URLS = ["a.html?f=b.pdf", "x/A.PDF?v=1", "documents/7/download", "media/12/download", "b/DocumentDownload.ashx?id=3", "media/x/download"]


@query("select id, regexp_matches(lower(url), '/en/|/de/') and not regexp_matches(lower(url), 'utm_|page=') as kept from pg")
def focus_exclude(v: Views) -> DataFrame:
    return v.pg.select("id", fn.focus_exclude("url", ["/en/", "/de/"], ["utm_", "page="]).alias("kept"))


_CENTURY = "make_date(2000 + year(meeting_date) % 100, month(meeting_date), day(meeting_date))"


@query(f"select id, case when id % 4 = 3 then {_CENTURY} else meeting_date end as found from doc")
def date_from_text(v: Views) -> DataFrame:
    shapes = [F.date_format("meeting_date", f) for f in ("MMMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd", "MM-dd-yy")]
    text = F.concat(F.lit("held on "), F.get(F.array(*shapes), (F.col("id") % 4).cast("int")), F.lit(" at noon"))
    return v.doc.select("id", fn.date_from_text(text).alias("found"))


@query(f"select id, case when id % 6 = 5 then {_CENTURY} when year(meeting_date) between 2000 and 2100 then meeting_date end as found from doc")
def date_from_title(v: Views) -> DataFrame:
    shapes = [F.date_format("meeting_date", f) for f in ("MMM. d, yyyy", "d MMMM yyyy", "yyyy/MM/dd", "M-d-yyyy", "MMMM d'th', yyyy", "M/d/yy")]
    title = F.concat(F.lit("Board Meeting 7 - "), F.get(F.array(*shapes), (F.col("id") % 6).cast("int")))
    return v.doc.select("id", fn.date_from_title(title).alias("found"))


_COVERS = [
    "2031. For the Fiscal Year Ended June 30, 2024", "Fiscal Year 2024 ... target 2031", "2022 ACFR, target 2030", "FY2019 and 2025", "Annual Comprehensive\nFinancial Report for 2023, (c) 2026",
    "Fiscal year ending December 31 2095. FY 2020", "2007 and 2026", "19 of 20", None, "for the year ended December 31, 2010, made 2012", "2018 x " + "y" * 50 + " CAFR", "acfrs 2011, 2009", "x" * 5000 + " 2015",
]
_REPORT = r"(annual\s+comprehensive\s+financial\s+report|comprehensive\s+annual\s+financial\s+report|\bacfr\b|\bcafr\b)"
_YEAR_RULES = [
    r"fiscal\s+year\s+end(ed|ing)\s+(january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{1,2},?\s+(20[0-9][0-9])", r"\bfiscal\s+year\s+(20[0-9][0-9])\b",
    r"\bfy\s*(20[0-9][0-9])\b", _REPORT + r"(?s:.{0,40}?)(20[0-9][0-9])", r"(20[0-9][0-9])(?s:.{0,40}?)" + _REPORT,
]


def _years_sql(text: str, rule: str, group: int) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '(?i){rule}', {group}), lambda y: cast(y as int)), lambda y: y between 2000 and 2027)"


@query("with c as (select id, " + _case_sql(_COVERS).replace("\n", "' || chr(10) || '") + " as t from doc) select id, coalesce(" + ", ".join(f"{_years_sql('t', r, g)}[1]" for r, g in zip(_YEAR_RULES, (3, 1, 1, 2, 1), strict=True))
       + ", list_max(" + _years_sql("left(t, 5000)", r"\b(20[0-9][0-9])\b", 1) + ")) as year from c")
def fiscal_year_text(v: Views) -> DataFrame:
    return v.doc.select("id", fn.fiscal_year_text(_case(_COVERS), 2000, 2027).alias("year"))


_CLAIMS = {"id": "cast(id as varchar)", "dollars": "'$1,250.5 million'", "percent": "concat(cast(id as varchar), '.5%')", "bps": "concat(cast(id as varchar), ' basis points')", "vote": "'7-2'", "entity": "concat('Acme ', cast(id as varchar))"}


@query(" union all ".join(f"select id, '{k}' as kind, {x} as value, cast({n} as bigint) as variants from plan" for (k, x), n in zip(_CLAIMS.items(), (1, 6, 3, 3, 1, 1), strict=True)) + " union all select id, 'dollars', '$2.2B', 4 from plan")
def claim_extract(v: Views) -> DataFrame:
    i = S("id")
    text = F.concat(F.lit("**Bottom line:** the board approved **7-2** a plan (doc_id="), i, F.lit(") of **$1,250.5 million**, "), i, F.lit(".5% of all, "), i, F.lit(" basis points more, with **Acme "), i, F.lit("** [source](?doc="), i, F.lit("&p=99%) and **Big Fund (~$2.2B AUM)**, not **3 firms**.\n*Sources: 55% of $9*"))
    claims = v.plan.select("id", F.inline(fn.claim_extract(text)))
    return claims.withColumn("variants", F.size(fn.claim_variants("kind", "value")).cast("bigint"))


_BODIES = ["<title>Just a moment...</title>", "Access Denied", "hello", None, "x" * 4000 + "recaptcha", "RECAPTCHA by DataDome"]
_SERVERS = ["nginx", "AkamaiGHost", "cloudflare"]


@query(f"""with r as (select id, [200, 403, 429, 503, 404][id % 5 + 1] as status, lower(concat('server:', {_sql_list(_SERVERS)}[id % 3 + 1], ' ', case when id % 4 = 0 then 'cloudflare-ray:1' else '' end, chr(10), left(coalesce({_sql_list(_BODIES)}[id % 6 + 1], ''), 4000))) as hay from doc)
select id, case when status in (403, 429, 503) then concat('HTTP ', status, ' (', case when contains(hay, 'cloudflare-ray') then 'cf-ray header' when contains(hay, 'just a moment') then 'Cloudflare ''Just a moment'' challenge'
when contains(hay, 'access denied') then 'generic access-denied page' when contains(hay, 'recaptcha') then 'recaptcha challenge' when contains(hay, 'akamai') then 'Akamai bot mitigation' else 'no WAF fingerprint, but blocked status' end, ')') end as reason from r""")
def block_detect(v: Views) -> DataFrame:
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("id") % n).cast("int"))
    headers = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("Server"), pick(_SERVERS, 3), F.lit("Cloudflare-Ray"), F.lit("1"))).otherwise(F.create_map(F.lit("Server"), pick(_SERVERS, 3)))
    return v.doc.select("id", fn.block_detect(pick([200, 403, 429, 503, 404], 5), headers, pick(_BODIES, 6)).alias("reason"))


@query(r"""with t as (select id, case when id % 3 = 0 then concat('Hedge  fund ', text) when id % 3 = 1 then concat(repeat('x', 5000), ' benchmark ', repeat('y', 15000)) else concat('Real-Estate ', repeat('z', cast(19988 + id % 2 as int))) end as text from txt)
select id, case when length(text) >= 20000 and regexp_matches(lower(left(text, 5000)), 'investment|portfolio|allocation|return|performance|manager|mandate|commitment|private.equity|real.estate|infrastructure|hedge|fixed.income|equity|emerging.market|asset.class|benchmark|alpha|risk') then 'large' else 'small' end as tier from t""")
def route_by_size(v: Views) -> DataFrame:
    kind = F.col("id") % 3
    middle = F.concat(F.repeat(F.lit("x"), F.lit(5000)), F.lit(" benchmark "), F.repeat(F.lit("y"), F.lit(15000)))
    text = F.when(kind == 0, F.concat(F.lit("Hedge  fund "), "text")).when(kind == 1, middle).otherwise(F.concat(F.lit("Real-Estate "), F.repeat(F.lit("z"), (19988 + F.col("id") % 2).cast("int"))))
    return v.txt.select("id", fn.route_by_size(text).alias("tier"))


@query("select id, case id % 4 when 0 then 'https://www.youtube.com/watch?v=' || id when 1 then 'https://vimeo.com/' || id when 2 then 'https://g/' || id else cast(id as varchar) end as url from plan")
def video_url(v: Views) -> DataFrame:
    platform = F.get(F.array(*map(F.lit, ["youtube", "vimeo", "granicus", "swagit"])), (F.col("id") % 4).cast("int"))
    return v.plan.select("id", fn.video_url(platform, S("id"), F.when(F.col("id") % 4 == 3, "").otherwise(F.concat(F.lit("https://g/"), S("id")))).alias("url"))


@query("select id, id as clip, concat('Board ', cast(id as varchar)) as title, date '2024-01-05' as day, 65 as minutes from plan")
def scrape_rows(v: Views) -> DataFrame:
    row = F.concat(F.lit("<tr class='r'><td><b>Board "), S("id"), F.lit("</b></td><td>2024-01-05</td><td>1h 05m</td><td><a href='/p?clip_id="), S("id"), F.lit("'>go</a></td></tr>"))
    html = F.concat(F.lit("<table><tr><th>Name</th></tr>"), row, row, F.lit("</table>"))
    return v.plan.select("id", F.inline(fn.table_rows(html)))


@query("""select plan_id, meeting_date, concat('## ', coalesce(cast(meeting_date as varchar), 'undated'), chr(10), string_agg(concat('- ', coalesce(doc_type, 'document'), ' [', cast(id as varchar), ']'), chr(10) order by id)) as block
from doc group by plan_id, meeting_date""")
def format_blocks(v: Views) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("id", "doc_type")))
    grouped = v.doc.groupBy("plan_id", "meeting_date").agg(items.alias("items"))
    lines = F.transform("items", lambda d: F.concat(F.lit("- "), F.coalesce(d["doc_type"], F.lit("document")), F.lit(" ["), d["id"].cast("string"), F.lit("]")))
    return grouped.select("plan_id", "meeting_date", F.concat(F.lit("## "), F.coalesce(F.col("meeting_date").cast("string"), F.lit("undated")), F.lit("\n"), F.array_join(lines, "\n")).alias("block"))
