"""Column expressions: tolerant parsing, dates from names, classification ladders, formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_list_tolerant(text: Column | str) -> Column:
    """The objects of a JSON array, as variants; empty for null, malformed text and other top types."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(_col(text)), "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda x: F.schema_of_variant(x).like("OBJECT%"))


def json_fence_strip(text: Column | str) -> Column:
    """The text without a Markdown code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(_col(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def coerce_number(text: Column | str) -> Column:
    return F.trim(_col(text)).try_cast("double")


def sha256_json(**fields: Column | str) -> Column:
    """Digest of the fields as JSON with sorted names, nulls included."""
    return F.sha2(F.to_json(F.struct(*(_col(c).alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def deterministic_id(key: Column | str, kind: Column | str, dates: Sequence[str], title: Column | str) -> Column:
    """Sixteen hex digits over key, kind, the first known date and the normalised title."""
    normal = F.trim(F.regexp_replace(F.lower(_col(title)), r"[^a-z0-9]+", " "))
    return F.left(F.sha2(F.concat_ws("|", _col(key).cast("string"), F.coalesce(_col(kind), F.lit("")), F.coalesce(F.coalesce(*dates).cast("string"), F.lit("")), normal), 256), F.lit(16))


def ladder(text: Column | str, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The label of the first rule any of whose keywords the lower-cased text contains."""
    low, out = F.lower(_col(text)), F.lit(default)
    for words, label in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


def regex_ladder(text: Column | str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(_col(text).rlike(pattern), label).otherwise(out)
    return out


#: Ordered keywords of a document's kind; what none of them names is a board pack.
DOC_KINDS = [(["minute"], "minutes"), (["agenda"], "agenda"), (["performance", "return", "investment report"], "performance"), (["pack", "material", "board book"], "board_pack")]
#: Ordered patterns of a meeting's kind.
MEETING_KINDS = [
    (r"(?i)investment\s+committee|investment\s+board|portfolio", "investment"),
    (r"(?i)audit\s+committee|risk\s+committee", "audit"),
    (r"(?i)board\s+of\s+(?:trustees|directors|retirement)|full\s+board", "board"),
    (r"(?i)actuarial|funded\s+status", "actuarial"),
]
#: Extensions of documents, and paths that serve documents without one.
DOC_EXTENSIONS = ["pdf", "docx", "doc", "xlsx"]
DOC_PATHS = [r"/documents/[^/]+/download", r"/media/[0-9]+/download", r"/download\?", r"/files/.*\?", r"documentdownload\.ashx", r"/iip/\w+/file/getfile/", r"/documents/files/governance/"]


def classify_doc_type(text: Column | str) -> Column:
    """The kind that a url with its link's text names: minutes before agenda before performance."""
    return ladder(text, DOC_KINDS, "board_pack")


def classify_meeting(text: Column | str, name: Column | str) -> Column:
    """The kind named in the first 2,000 characters or the file name; ``board`` where none is."""
    return regex_ladder(F.concat_ws(" ", F.substring(_col(text), 1, 2000), _col(name)), MEETING_KINDS, "board")


def is_doc_url(url: Column | str) -> Column:
    """Whether the path ends in a document's extension, or the url has a form that serves documents without one."""
    low = F.lower(_col(url))
    return low.rlike(rf"^[^?#]*\.(?:{'|'.join(DOC_EXTENSIONS)})(?:[?#].*)?$") | low.rlike("|".join(DOC_PATHS))


def focus_exclude(text: Column | str, focus: Sequence[str], excluded: Sequence[str]) -> Column:
    """Some focus word and no excluded word."""
    low = F.lower(_col(text))
    has = lambda words: F.lit(False) if not words else low.rlike("|".join(words))
    return has(focus) & ~has(excluded)


#: Extensions of documents, extensions and names of last segments that say nothing about a document.
DOCUMENT_EXTENSIONS = ["pdf", "docx", "doc", "xlsx"]
HANDLER_EXTENSIONS = ["ashx", "aspx", "php", "cgi", "jsp", "do", "action"]
ROUTER_NAMES = ["open", "download", "view", "file", "default", "page", "show", "documentdownload", "getdocument", "documents"]


def make_filename(url: Column | str, link_text: Column | str) -> Column:
    """A document's file name: the url's last segment where that is a document's; else a slug of it, of its parent where it is
    a handler or a router, of the link's text where there is no parent, or the url's digest. The extension is the one that
    the link's text names, else ``.pdf``."""
    path = F.regexp_replace(F.regexp_replace(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    text = F.coalesce(_col(link_text), F.lit(""))
    stem = lambda c: F.regexp_replace(c, r"^(.+)\.[^.]+$", "$1")
    name = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    vague = extension.isin(*HANDLER_EXTENSIONS) | F.lower(stem(name)).isin("", *ROUTER_NAMES)
    source = F.when(~vague, stem(name)).when(F.size(parts) >= 2, stem(F.get(parts, F.size(parts) - 2))).otherwise(_stripped(text))
    slug = F.regexp_replace(F.left(F.regexp_replace(source, r"(?U)[^\w\-]", "-"), F.lit(60)), "^-+|-+$", "")
    named = F.nullif(F.lower(F.regexp_extract(text, r"(?i)\.(pdf|docx?|xlsx?)\b", 1)), F.lit(""))
    made = F.concat(F.coalesce(F.nullif(slug, F.lit("")), F.left(F.md5(_col(url)), F.lit(12))), F.lit("."), F.coalesce(named, F.lit("pdf")))
    return F.when(extension.isin(*DOCUMENT_EXTENSIONS), name).otherwise(made)


def _stripped(c: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


_MONTHS = "january february march april may june july august september october november december".split()
_LONG, _SHORT = "|".join(_MONTHS), "|".join(m[:3] for m in _MONTHS)


def first_date(text: Column, shapes: Sequence[tuple[str, tuple[int, int, int]]], first_year: int = 2000, last_year: int = 2035) -> Column:
    """The date of the first shape (pattern, groups of year, month and day; group 0: the first day) whose first match is a
    valid date of those years. Months are numbers or names, two-digit years are of this century. Every match is
    taken out once, and one expression makes dates of them all, so the plan stays small."""
    part = lambda pattern, group: F.regexp_extract(text, pattern, group) if group else F.lit("1")
    found = F.array(*(F.struct(*(part(p, g).alias(n) for n, g in zip(("y", "m", "d"), groups, strict=True))) for p, groups in shapes))

    def day(f: Column) -> Column:
        place = F.call_function("locate", F.lower(F.substring(f["m"], 1, 3)), F.lit("".join(m[:3] for m in _MONTHS)))
        month = F.when(f["m"].rlike("^[0-9]"), f["m"]).otherwise(((place + 2) / 3).cast("int").cast("string"))
        year = F.when(F.length(f["y"]) == 2, F.concat(F.lit("20"), f["y"])).otherwise(f["y"])
        date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(f["d"], 2, "0")), "yyyy-MM-dd")
        return F.when((f["y"] != "") & F.year(date).between(first_year, last_year), date)

    return F.get(F.array_compact(F.transform(found, day)), F.lit(0))


#: Shapes of dates in file names, in order, with their groups of year, month and day.
NAME_DATES = [
    (r"(?<![0-9])([0-9]{2})[-_.]?([0-9]{2})[-_.]?([0-9]{4})(?![0-9])", (3, 1, 2)),
    (r"(?<![0-9])([0-9]{1,2})[-./]([0-9]{1,2})[-./]([0-9]{2})(?![0-9])", (3, 1, 2)),
    (r"(?<![0-9])([0-9]{4})[-_.]?([0-9]{2})[-_.]?([0-9]{2})(?![0-9])", (1, 2, 3)),
    (rf"(?i)({_LONG})[\s_-]+([0-9]{{1,2}})[\s_,-]+([0-9]{{4}})", (3, 1, 2)),
    (rf"(?i)({_LONG})[\s_-]+([0-9]{{4}})", (2, 1, 0)),
]
#: Shapes of dates next to a link.
TEXT_DATES = [
    (r"(?<![0-9])([0-9]{4})[_-]([0-9]{2})[_-]([0-9]{2})(?![0-9])", (1, 2, 3)),
    (rf"(?i)\b({_LONG})\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b", (3, 1, 2)),
    (r"(?<![0-9])([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}|[0-9]{2})(?![0-9])", (3, 1, 2)),
]
#: Shapes of dates in titles of recordings.
TITLE_DATES = [
    (rf"(?i)\b({_LONG}|{_SHORT}|sept)\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b", (3, 1, 2)),
    (rf"(?i)\b([0-9]{{1,2}})\s+({_LONG}|{_SHORT}|sept)\.?\s+([0-9]{{4}})\b", (3, 2, 1)),
    (r"\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b", (1, 2, 3)),
    (r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\b", (3, 1, 2)),
    (r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2})\b", (3, 1, 2)),
]
#: Days ahead of the load date, and behind it, that a meeting's date may be.
DAYS_AHEAD, DAYS_BEHIND = 60, 5 * 365


def date_from_name(name: Column | str) -> Column:
    """The date in a file name without its extension, by the first of ``NAME_DATES`` that gives a valid one."""
    return first_date(F.regexp_replace(_col(name), r"\.[a-zA-Z0-9]+$", ""), NAME_DATES)


def date_infer(existing: Column | str, name: Column | str, text: Column | str, loaded: Column | str) -> Column:
    """The first plausible date of: the existing one, the file name's, the first ``Month D, YYYY`` of the first 2,000
    characters. Plausible is near the load date; without one every date is."""
    worded = first_date(F.substring(_col(text), 1, 2000), TEXT_DATES[1:2], 1, 9999)
    near = lambda d: _col(loaded).isNull() | ((d <= F.date_add(_col(loaded), DAYS_AHEAD)) & (d >= F.date_sub(_col(loaded), DAYS_BEHIND)))
    return F.get(F.filter(F.array_compact(F.array(_col(existing), date_from_name(name), worded)), near), F.lit(0))


def date_repair(stored: Column | str, name: Column | str, loaded: Column | str) -> tuple[Column, Column]:
    """(date, outcome): a date too far after the load date is read again from the name (``updated``), or becomes null
    (``cleared``); other dates are ``kept``."""
    last = F.date_add(_col(loaded), DAYS_AHEAD)
    again = F.get(F.filter(F.array_compact(F.array(date_from_name(name))), lambda d: d <= last), F.lit(0))
    late = F.coalesce(_col(stored) > last, F.lit(False))
    date = F.when(late, again).otherwise(_col(stored))
    return date, F.when(~late, "kept").when(again.isNull(), "cleared").otherwise("updated")


def year_from_url(url: Column | str, last: int | Column = 2039) -> Column:
    """The greatest year from 1990 to ``last`` among the string's runs that read as a year of this or the last century, wherever they stand."""
    years = F.transform(F.regexp_extract_all(_col(url), F.lit(r"(20[0-3][0-9]|19[0-9]{2})"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(1990, last)))


def year_infer(name: Column | str, meeting_date: Column | str | None = None) -> Column:
    """The meeting date's year, else from the name: a year from 2000 to 2029, m.d.yy, or six digits as yymmdd or mmddyy."""
    c = _col(name)
    part = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).cast("int")
    four, parted, six = r"(?<![0-9])(20[0-2][0-9])(?![0-9])", r"(?<![0-9])[0-9]{1,2}[._ -][0-9]{1,2}[._ -]([0-9]{2})(?![0-9])", r"(?<![0-9])([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])"
    a, b, d = (part(six, i) for i in (1, 2, 3))
    packed = F.when(a.between(20, 29) & b.between(1, 12) & d.between(1, 31), 2000 + a).when(a.between(1, 12) & b.between(1, 31) & (d <= 29), 2000 + d)
    from_name = F.coalesce(part(four, 1), F.when(part(parted, 1) <= 29, 2000 + part(parted, 1)), packed)
    return from_name if meeting_date is None else F.coalesce(F.year(_col(meeting_date)), from_name)


def expected_fiscal_year(day: Column | str, month_day: Column | str) -> Column:
    """The fiscal year closed as of a day, for years that end on MM-DD."""
    return F.year(_col(day)) - F.when(F.date_format(_col(day), "MM-dd") < _col(month_day), 1).otherwise(0)


def week_end(day: Column | str) -> Column:
    """The Saturday that ended the last complete Sunday-to-Saturday week."""
    return F.date_sub(_col(day), F.when(F.dayofweek(_col(day)) == 7, 7).otherwise(F.dayofweek(_col(day))))


def prior_period(day: Column | str, unit: str) -> tuple[Column, Column]:
    """First and last day of the month, quarter or year before."""
    start = F.trunc(_col(day), unit)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.add_months(start, -months), F.date_sub(start, 1)


def period_label(start: Column | str, end: Column | str) -> Column:
    """``Jan 3–9, 2024``; both months, or both years, where they differ, with blanks around the dash."""
    a, b = _col(start), _col(end)
    same_month = F.date_format(a, "yyyy-MM") == F.date_format(b, "yyyy-MM")
    first = F.when(same_month | (F.year(a) == F.year(b)), F.date_format(a, "MMM d")).otherwise(F.date_format(a, "MMM d, yyyy"))
    return F.when(same_month, F.concat(first, F.lit("–"), F.date_format(b, "d, yyyy"))).otherwise(F.concat(first, F.lit(" – "), F.date_format(b, "MMM d, yyyy")))


def duration_text(seconds: Column | str) -> Column:
    """``1h05m`` from an hour on, else ``2m 3s``."""
    s = _col(seconds).cast("bigint")
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit("m"))
    return F.when(s >= 3600, hours).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def signed_percent(basis_points: Column | str) -> Column:
    """``+1.25%`` from basis points; blank for null."""
    b = _col(basis_points)
    return F.when(b.isNull(), "").otherwise(F.concat(F.when(b < 0, "-").otherwise("+"), F.floor(F.abs(b) / 100).cast("string"), F.lit("."), F.lpad((F.abs(b) % 100).cast("string"), 2, "0"), F.lit("%")))


def dollars(amount: Column | str, unit: str = "") -> Column:
    """``$1,234.5`` and a unit; blank for null."""
    return F.when(_col(amount).isNull(), "").otherwise(F.concat(F.lit("$"), F.format_number(_col(amount), 1), F.lit(unit)))


def excerpt(text: Column | str, chars: int) -> Column:
    """At most so many characters on one line, with an ellipsis if cut; blank for null."""
    line = _stripped(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > chars, F.concat(F.regexp_replace(F.left(line, F.lit(chars)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(line)


def truncate_words(text: Column | str, words: int) -> Column:
    """(text, cut): the text itself if it has so many words at most, else its first ones, joined by single spaces, with an ellipsis."""
    parts = F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")
    cut = F.size(parts) > words
    return F.struct(F.when(cut, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("…"))).otherwise(_col(text)).alias("text"), cut.alias("cut"))


#: Headings of a note's own summary.
SUMMARY_HEADINGS = ["TL;DR", "Summary", "Overview"]


def preview(text: Column | str, chars: int = 700) -> Column:
    """Plain text from a note: its summary section if it has one, else what follows title, date line and rules; cut at
    ``chars``, after the last sentence that ends past 60 % of it, and marked as cut. Blank for null."""
    note = F.coalesce(_col(text), F.lit(""))
    section = F.regexp_extract(note, rf"(?mis)^##\s+(?:{'|'.join(SUMMARY_HEADINGS)})\s*$\s*(.+?)(?=^##\s|\z)", 1)
    line = r"# [^\n]*|---|\*\*\*|___|\*?_?generated:[^\n]*"
    body = F.regexp_replace(note, rf"(?i)\A(?:[^\S\n]*(?:{line})?[^\S\n]*\n)*+(?:[^\S\n]*(?:{line})?[^\S\n]*\z)?", "")
    plain = strip_markup(F.when(_stripped(section) != "", _stripped(section)).otherwise(body))
    return F.get(F.transform(F.array(plain), lambda whole: _cut_at_sentence(whole, chars)), F.lit(0))


def _cut_at_sentence(plain: Column, chars: int) -> Column:
    cut = F.left(plain, F.lit(chars))
    # up to the blank after the last full stop, question or exclamation mark
    sentence = F.length(F.regexp_extract(cut, r"(?s)^(.*(?:\.[ \n]|[?!] ))", 1)) - 2
    ended = F.when(sentence > 0.6 * chars, F.substring(cut, F.lit(1), sentence + 1)).otherwise(cut)
    return F.when(F.length(plain) <= chars, plain).otherwise(F.concat(F.regexp_replace(ended, r"(?U)\s+$", ""), F.lit(" …")))


def strip_markup(text: Column | str) -> Column:
    """Markdown without the marks of headings, bullets, numbered items, links, emphasis and code; at most one blank line in a row."""
    out = _col(text)
    steps = [
        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*[0-9]+\.\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"\n{3,}", "\n\n"),
    ]
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return _stripped(out)


def highlight(text: Column | str, term: str) -> Column:
    """Case-insensitive literal matches between marks, in their own case."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
    return F.regexp_replace(_col(text), f"(?i)({quoted})", "<mark>$1</mark>")


def rewrite_citations(text: Column | str, base: str) -> Column:
    """``[12]`` and each id of ``[12, 15]`` as a link; links stay as they are."""
    # a list of any length: the text between lists stays, every list is parted by itself
    listed = r"\[[0-9]+(?:\s*,\s*[0-9]+)*\](?!\()"
    lists, between = F.regexp_extract_all(_col(text), F.lit(listed), F.lit(0)), F.split(_col(text), listed, -1)
    linked = F.transform(lists, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*,\s*", "] ["), r"\[([0-9]+)\]", rf"[$1]({base}/$1)"))
    return F.array_join(F.transform(F.arrays_zip(between.alias("b"), linked.alias("l")), lambda p: F.concat(p["b"], F.coalesce(p["l"], F.lit("")))), "")


#: What messages of passing and of lasting failures say.
PASSING = ["rate-limited", "try again later"]
LASTING = ["private video", "video unavailable", "has been removed", "account associated with this video has been terminated"]


def error_class(message: Column | str) -> Column:
    """gone for a lasting failure, else transient. A message that also speaks of a passing one is transient."""
    return ladder(F.coalesce(_col(message), F.lit("")), [(PASSING, "transient"), (LASTING, "gone")], "transient")


#: Statuses of a block, and what headers or bodies of blocking services say, with their labels, in order.
BLOCKED = [403, 429, 503]
FINGERPRINTS = {
    "cloudflare-ray": "cf-ray header", "just a moment": "Cloudflare 'Just a moment' challenge", "attention required": "Cloudflare 'Attention Required' challenge",
    "access denied": "generic access-denied page", "recaptcha": "recaptcha challenge", "akamai": "Akamai bot mitigation", "incapsula": "Imperva/Incapsula",
    "perimeterx": "PerimeterX", "datadome": "DataDome",
}


def block_detect(status: Column | str, headers: Column | str, body: Column | str) -> Column:
    """Why a response counts as blocked: its status and the first fingerprint in the headers (a map) or the body's first 4,000
    characters, or that there is none; null for any other status."""
    pairs = F.transform(F.map_entries(_col(headers)), lambda e: F.concat_ws(":", e["key"], e["value"]))
    hay = F.lower(F.concat_ws(" ", pairs, F.lit("\n"), F.left(F.coalesce(_col(body), F.lit("")), F.lit(4000))))
    label = F.coalesce(*(F.when(hay.contains(mark), F.lit(said)) for mark, said in FINGERPRINTS.items()), F.lit("no WAF fingerprint, but blocked status"))
    return F.when(_col(status).isin(*BLOCKED), F.concat(F.lit("HTTP "), _col(status).cast("string"), F.lit(" ("), label, F.lit(")")))


#: Names of files without content; a dot stands for any character.
CONTENTLESS = ["attendance", "building", "map", "calendar", "cover.?page", "direction", "notice.only", "parking", "visitor", "hotel", "travel", "biography", "bio", "headshot"]


def skip_reason(text: Column | str, name: Column | str) -> Column:
    """Why a text is not summarised; null if it is."""
    short = F.length(_stripped(F.coalesce(_col(text), F.lit("")))) < 100
    named = F.coalesce(_col(name), F.lit("")).rlike("(?i)" + "|".join(CONTENTLESS))
    return F.when(short, "insufficient text").when(named, F.concat(F.lit("non-substantive filename ("), _col(name), F.lit(")")))


#: What texts worth the large tier speak of; a dot stands for any character.
VALUABLE = [
    "investment", "portfolio", "allocation", "return", "performance", "manager", "mandate", "commitment", "private.equity", "real.estate", "infrastructure",
    "hedge", "fixed.income", "equity", "emerging.market", "asset.class", "benchmark", "alpha", "risk",
]


def route_by_size(text: Column | str) -> Column:
    """The tier: large for a text from 20,000 characters on whose first 5,000 name something valuable, else small. Agendas and minutes
    have no rule of their own: theirs end below that size."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.when((F.length(t) >= 20_000) & F.left(t, F.lit(5000)).rlike("(?i)" + "|".join(VALUABLE)), "large").otherwise("small")


def placeholder_only(text: Column | str) -> Column:
    """Whether a text has page markers and blanks only."""
    return F.coalesce(_col(text).rlike(r"\A(?:\s*\[Page [0-9]+\]\s*)+\z"), F.lit(False))


#: What titles of meetings' recordings say.
MEETING_TITLES = [
    "board meeting", "board of administration", "board of trustees", "board of directors", "board of managers", "board of education", "investment committee",
    "audit committee", "finance committee", "executive committee", "governance committee", "trustee meeting", "trustees meeting", "retirement board", "pension board",
    "regular meeting", "special meeting", "quarterly meeting", "annual meeting", "committee meeting", "public meeting",
]


def title_match(title: Column | str) -> Column:
    """Whether a recording's title is a meeting's, with any blanks between the words."""
    words = F.regexp_replace(F.lower(F.coalesce(_col(title), F.lit(""))), r"(?U)\s+", " ")
    return words.rlike("|".join(MEETING_TITLES))


#: Fixed values: (platform, kind, pattern of the whole url, canonical url with the id as ``{id}``), in order. A directory
#: lists recordings, a video is one of them.
MEDIA_URLS = [
    ("youtube", "directory", r"(?i)^https?://(?:www\.|m\.)?youtube\.com/((?:channel/UC[0-9A-Za-z_-]{20,})|(?:@|c/|user/)[A-Za-z0-9_.-]+)", "https://www.youtube.com/{id}"),
    ("youtube", "directory", r"(?i)^https?://(?:www\.|m\.)?youtube\.com/playlist\?list=([A-Za-z0-9_-]{10,})", "https://www.youtube.com/playlist?list={id}"),
    ("youtube", "directory", r"(?i)^https?://(?:www\.|m\.)?youtube\.com/(?!(?:watch|embed|shorts|playlist|results|feed|channel|c|user|about|account|t|hashtag|live)(?:[/?#]|$))([A-Za-z0-9_.-]{3,})(?:[/?#]|$)", "https://www.youtube.com/{id}"),
    ("youtube", "video", r"^https?://(?:(?:www\.|m\.)?youtube\.com/(?:.*[?&]v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})", None),
    ("vimeo", "directory", r"(?i)^https?://(?:[a-z0-9-]+\.)*vimeo\.com/(channels/[A-Za-z0-9_-]+|showcase/[0-9]+)(?:[/?#]|$)", "https://vimeo.com/{id}"),
    ("vimeo", "directory", r"(?i)^https?://(?:[a-z0-9-]+\.)*vimeo\.com/(?!(?:events?|watch|explore|categories|channels|showcase|ondemand|stock|features|pricing|upgrade|log_in|join|search|settings|help|manage|live|about|jobs|blog|videos?|api|embed|player|create|home|feed|following|library|tags)(?:[/?#]|$))([a-z][a-z0-9_-]{2,})(?:[/?#]|$)", "https://vimeo.com/{id}"),
    ("vimeo", "video", r"(?i)^https?://(?:[a-z0-9-]+\.)*vimeo\.com/(?:video/)?([0-9]+)/?(?:[?#]|$)", None),
    ("granicus", "directory", r"(?i)^https?://([a-z0-9-]+)\.granicus\.com(?:[/?#:]|$)", "https://{id}.granicus.com/ViewPublisher.php?view_id=2"),
    ("swagit", "directory", r"(?i)^https?://([a-z0-9-]+)\.swagit\.com(?:[/?#:]|$)", "https://{id}.swagit.com/"),
    ("cablecast", "directory", r"(?i)^https?://([a-z0-9.-]+\.cablecast\.tv)(?:[/?#:]|$)", "https://{id}/"),
    ("boxcast", "directory", r"(?i)^https?://(?:www\.)?boxcast\.(?:com|tv)/(?:channel|view|s)/([A-Za-z0-9_-]+)", "https://www.boxcast.com/channel/{id}"),
    ("civicplus", "directory", r"(?i)^https?://([a-z0-9.-]+\.civic(?:clerk|plus)\.com)(?:[/?#:]|$)", "https://{id}/"),
    ("zoom", "directory", r"(?i)^https?://((?:[a-z0-9-]+\.)*zoom\.us)/rec/", "https://{id}/rec/"),
    ("facebook", "directory", r"(?i)^https?://(?:www\.|m\.|web\.)?facebook\.com/(?!(?:videos|live|watch|posts)(?:[/?#]|$))([A-Za-z0-9.-]+)", "https://www.facebook.com/{id}/"),
]


def url_classify(url: Column | str, videos: bool = True) -> Column:
    """(platform, kind, id, canonical) of a media url by the first of ``MEDIA_URLS`` that fits; null for other urls, and
    for single videos where only directories are wanted. A video's canonical url is the url itself."""
    u = _col(url)
    rules = [r for r in MEDIA_URLS if videos or r[1] != "video"]
    found = F.array(*(F.struct(F.lit(platform).alias("platform"), F.lit(kind).alias("kind"), F.regexp_extract(u, pattern, 1).alias("id"), F.lit(canonical).alias("canonical")) for platform, kind, pattern, canonical in rules))
    first = F.filter(found, lambda f: f["id"] != "")
    named = F.transform(first, lambda f: F.struct(f["platform"].alias("platform"), f["kind"].alias("kind"), f["id"].alias("id"), F.coalesce(F.replace(f["canonical"], F.lit("{id}"), f["id"]), u).alias("canonical")))
    return F.get(named, F.lit(0))


def url_for_year(template: Column | str, linked: Column | str, static: Column | str, year: int) -> Column:
    """The template filled in, else a link of that year, else the static url if it names the year."""
    fits = lambda u: F.when(year_from_url(u) == year, _col(u))
    return F.coalesce(F.replace(_col(template), F.lit("{year}"), F.lit(str(year))), fits(linked), fits(static))


def video_url(platform: Column | str, key: Column | str, raw: Column | str) -> Column:
    """The viewer's url; of other platforms the raw one, or the id where there is none."""
    own = F.when(_col(platform) == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), _col(key))).when(_col(platform) == "vimeo", F.concat(F.lit("https://vimeo.com/"), _col(key)))
    return F.coalesce(own, F.nullif(_col(raw), F.lit("")), _col(key))


def safe_path(entity: Column | str, key: Column | str, meeting: Column | str, published: Column | str, extension: Column | str) -> Column:
    """entity/date_id.extension: the meeting's date, else that of publication, else ``undated``; blanks become underscores, and
    other characters than letters, digits, dots, underscores and hyphens go. What is left blank is ``x``."""
    part = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.replace(_stripped(c), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9._\-]+", ""), F.lit("")), F.lit("x"))
    day = F.coalesce(F.date_format(F.coalesce(_col(meeting).cast("date"), _col(published).cast("date")), "yyyy-MM-dd"), F.lit("undated"))
    return F.concat(part(_col(entity).cast("string")), F.lit("/"), day, F.lit("_"), part(_col(key).cast("string")), F.lit("."), F.regexp_replace(_col(extension), r"^\.+", ""))


def utc_stamp(text: Column | str) -> Column:
    """Naive time stamps get ``+00:00``; stamps with a zone stay."""
    return F.when(_col(text).rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), _col(text)).otherwise(F.concat(_col(text), F.lit("+00:00")))


def relevance(text: Column | str, keywords: Sequence[str]) -> Column:
    """How many of the keywords the lower-cased text contains."""
    low = F.lower(_col(text))
    return sum((low.contains(k).cast("int") for k in keywords), F.lit(0))


def date_from_text(text: Column | str) -> Column:
    """The date of a link's text by the first of ``TEXT_DATES``: year first, ``Month D, YYYY``, or M/D/Y."""
    return first_date(_col(text), TEXT_DATES, 1, 9999)


def date_from_title(title: Column | str) -> Column:
    """The date of a recording's title by the first of ``TITLE_DATES`` that gives a valid one."""
    return first_date(_col(title), TITLE_DATES, 2000, 2100)


#: Names of the report whose fiscal year is looked for.
REPORT_NAMES = ["annual comprehensive financial report", "comprehensive annual financial report"]
REPORT_SHORT = ["acfr", "cafr"]


def fiscal_year_text(text: Column | str, first: int = 2000, last: int = 2099) -> Column:
    """The fiscal year of a report's first pages by the first rule that gives one from ``first`` to ``last``: ``fiscal year ended Month D,
    YYYY``, ``fiscal year YYYY``, ``FY YYYY``, the report's name with a year up to 40 characters after, or before it; else
    the greatest such year of the first 5,000 characters."""
    year = "(20[0-9]{2})"
    names = "|".join([*(n.replace(" ", r"\s+") for n in REPORT_NAMES), *(rf"\b{n}\b" for n in REPORT_SHORT)])
    rules = [
        rf"fiscal\s+year\s+end(?:ed|ing)\s+(?:{_LONG})\s+[0-9]{{1,2}},?\s+{year}", rf"\bfiscal\s+year\s+{year}\b", rf"\bfy\s*{year}\b",
        rf"(?:{names})[\s\S]{{0,40}}?{year}", rf"{year}[\s\S]{{0,40}}?(?:{names})",
    ]
    plausible = lambda c, p: F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"(?i){p}"), F.lit(1)), lambda x: x.cast("int")), lambda y: y.between(first, last))
    return F.coalesce(*(F.get(plausible(_col(text), p), F.lit(0)) for p in rules), F.array_max(plausible(F.substring(_col(text), 1, 5000), rf"\b{year}\b")))


#: Kinds of checkable claims and their patterns.
CLAIMS = {
    "id": r"(?:doc_id=|\?doc=)([0-9]+)",
    "dollars": r"(?i)(\$[0-9,]+(?:\.[0-9]+)?(?:\s*(?:trillion|billion|million|thousand|T|B|M|K)\b)?)",
    "percent": r"(-?[0-9]+(?:\.[0-9]+)?%)",
    "bps": r"(?i)(\b[0-9]+(?:\.[0-9]+)?\s*(?:basis\s+points|bps)\b)",
    "vote": r"(?i)\b(?:approved|voted?|passed)\s+\**([0-9]+-[0-9]+)\**\b",
    "entity": r"\*\*([^*]+)\*\*",
}
#: Bold phrases that are headings and no claims, without their colons.
BOLD_HEADINGS = ["bottom line", "practical implication", "sources", "emerging signal — limited data", "emerging signal"]


def claim_extract(text: Column | str) -> Column:
    """Distinct (kind, value) of the claims in a note: document ids anywhere, all else outside link targets and lines of
    sources. A bold phrase is an entity unless it is a heading, starts like a number, or carries its size in brackets."""
    raw = _col(text)
    body = F.regexp_replace(F.regexp_replace(raw, r"\]\([^)]+\)", "]"), r"(?m)^\*Sources:.*$", "")

    def found(kind: str, pattern: str) -> Column:
        values = F.regexp_extract_all(raw if kind == "id" else body, F.lit(pattern), F.lit(1))
        if kind == "entity":
            plain = lambda v: F.rtrim(F.regexp_replace(F.lower(v), r"[:\s]+$", ""))
            values = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (v != "") & ~plain(v).isin(*BOLD_HEADINGS) & ~v.rlike(r"^[0-9$+-]") & ~v.rlike(r"(?i).\(\s*~?\$[0-9,.]+\s*[bmtk][^)]*\)$"))
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    return F.array_distinct(F.concat(*(found(k, p) for k, p in CLAIMS.items())))


def claim_variants(kind: Column | str, value: Column | str) -> Column:
    """The ways in which a text may write a claim: without commas or sign, units long and short, percent and points in words."""
    k, v = _col(kind), _col(value)
    plain = F.regexp_replace(v, ",", "")
    long, short = plain, plain
    for unit in ("trillion", "billion", "million"):
        long = F.regexp_replace(long, rf"(?i)([0-9])\s*{unit[0]}\b", f"$1 {unit}")
        short = F.regexp_replace(short, rf"(?i)\s*{unit}\b", unit[0].upper())
    dollars = F.array(v, plain, long, short, F.ltrim(v, F.lit("$")), F.ltrim(plain, F.lit("$")), F.ltrim(long, F.lit("$")), F.ltrim(short, F.lit("$")))
    percent = F.array(v, F.replace(v, F.lit("%"), F.lit(" percent")), F.replace(v, F.lit("%"), F.lit("pct")))
    number = F.regexp_extract(v, r"^[0-9]+(?:\.[0-9]+)?", 0)
    points = F.array(v, *(F.concat(number, F.lit(u)) for u in (" basis points", " bps", "bps")))
    return F.array_distinct(F.when(k == "dollars", dollars).when(k == "percent", percent).when(k == "bps", points).otherwise(F.array(v)))


def table_rows(html: Column | str) -> Column:
    """(clip, title, day, minutes) of an archive table's rows that link a clip."""
    parts = F.transform(
        F.filter(F.split(_col(html), r"(?i)<tr[^>]*>", -1), lambda r: r.rlike(r"clip_id=[0-9]+")),
        lambda r: F.struct(
            F.regexp_extract(r, r"clip_id=([0-9]+)", 1).cast("bigint").alias("clip"),
            F.trim(F.regexp_replace(F.regexp_extract(r, r"(?is)<td[^>]*>(.*?)</td>", 1), r"<[^>]+>", "")).alias("title"),
            F.try_to_date(F.regexp_extract(r, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd").alias("day"),
            (F.coalesce(F.regexp_extract(r, r"([0-9]+)h\s*[0-9]+m", 1).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.regexp_extract(r, r"([0-9]+)m\b", 1).try_cast("int"), F.lit(0))).alias("minutes"),
        ),
    )
    return F.array_distinct(parts)
