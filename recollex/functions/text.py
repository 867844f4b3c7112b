"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
# Stop words left out of built queries.
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "not", "but", "you", "your", "into", "about", "what", "when", "where", "which", "who", "how", "why"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SEPARATOR), lambda t: t != "")


def long_tokens(text: Column) -> Column:
    """Distinct tokens longer than two characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 2))


def query_terms(query: Column, most: int = 16) -> Column:
    """Distinct lower-cased terms of [a-z0-9_], at most ``most``."""
    terms = F.filter(F.split(F.lower(query), "[^a-z0-9_]+"), lambda t: t != "")
    return F.slice(F.array_distinct(terms), 1, most)


def agent_terms(query: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Distinct terms longer than two that aren't numbers, each with its synonyms."""
    terms = F.array_distinct(F.filter(F.split(F.lower(query), "[^a-z0-9_]+"), lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$")))
    for word, more in sorted((synonyms or {}).items()):
        terms = F.when(F.array_contains(terms, word), F.array_union(terms, F.array(*[F.lit(m) for m in more]))).otherwise(terms)
    return terms


def compact(text: Column, most: int, mark: str = "...") -> Column:
    """White space collapsed, cut to ``most`` characters with a mark."""
    flat = F.regexp_replace(F.trim(text), r"\s+", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(mark))).otherwise(flat)


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"


def estimate_tokens(text: Column) -> Column:
    """Tokens by rule: 1.3 a word, one for each run of punctuation, two for each CJK character; a third of the characters at least."""
    plain = F.regexp_replace(text, CJK, " ")
    words = F.regexp_count(plain, F.lit(r"[\p{L}\p{N}_]+"))
    marks = F.regexp_count(plain, F.lit(r"[^\p{L}\p{N}_\s]+"))
    found = F.ceil(words * F.lit(13) / 10) + marks + 2 * F.regexp_count(text, F.lit(CJK))
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.greatest(found.cast("long"), F.ceil(F.length(text) / 3).cast("long"), F.lit(1).cast("long")))


def memory_type(text: Column) -> tuple[Column, Column]:
    """Type and confidence of a memory by its words."""
    t = F.lower(text)
    has = lambda *words: F.rlike(t, F.lit("|".join(words)))
    kind = F.when(has("decided", "chose", "we will"), "decision").when(has("learned", "turns out", "lesson"), "lesson").when(has("prefer", "likes", "hates"), "preference").otherwise("fact")
    weight = F.when(kind == "decision", 0.6).when(kind == "lesson", 0.6).when(kind == "preference", 0.55).otherwise(0.5)
    return kind, weight


CUES = [" after ", " before ", " and then ", " while ", " vs ", " versus "]


def decompose(query: Column) -> Column:
    """The two parts of a query at the first cue of a fixed order, else the query alone."""
    out = F.array(F.trim(query))
    for cue in reversed(CUES):
        at = F.instr(F.lower(query), cue)
        parts = F.array(F.trim(F.substring(query, F.lit(1), at - 1)), F.trim(F.substring(query, at + len(cue), F.length(query))))
        out = F.when(at > 0, F.filter(parts, lambda p: p != "")).otherwise(out)
    return out


def grade(query: Column, text: Column) -> Column:
    """Share of the query's longer tokens that the text contains; 0.5 for a query without."""
    asked = long_tokens(query)
    low = F.lower(text)
    hits = F.size(F.filter(asked, lambda t: F.contains(low, t)))
    return F.when(F.size(asked) == 0, F.lit(0.5)).otherwise(hits / F.size(asked))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def entities(text: Column) -> Column:
    """Distinct phrases of capitalised words, three characters at least."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda e: F.length(e) >= 3))


def expand_query(query: Column) -> Column:
    """A sentence that an answer to the query might start with."""
    return F.concat(F.lit("A document that answers the question about "), query, F.lit(" would explain: "), query)


def summarize(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.substring(x, 1, 200)), " / ")


def merge_text(old: Column, new: Column) -> Column:
    return F.when(F.contains(old, new), old).otherwise(F.concat(old, F.lit("\n"), new))


def shape_hash(query: Column) -> Column:
    """Byte length of the first word, and whether there are digits or quotes, in eight bits."""
    first = F.octet_length(F.substring_index(F.trim(query), " ", 1))
    digit = query.rlike("[0-9]").cast("int")
    quote = F.contains(query, F.lit('"')).cast("int")
    return (first.bitwiseAND(63) + digit * 64 + quote * 128) % 256


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def gold_query(title: Column, text: Column, chunk_id: Column) -> Column:
    """First eight telling tokens of a text, else its title, else its number."""
    words = F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))
    found = F.array_join(F.slice(words, 1, 8), " ")
    return F.when(found != "", found).when(F.trim(F.coalesce(title, F.lit(""))) != "", F.trim(title)).otherwise(F.concat(F.lit("corpus chunk "), chunk_id.cast("string")))


def scope_path(agent: Column, project: Column, name: Column) -> Column:
    esc = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.concat_ws("/", esc(agent), esc(project), esc(name))


def scope_tag(kind: Column, user: Column, session: Column, project: Column) -> Column:
    return F.when(kind == "user", F.concat(F.lit("user:"), user)).when(kind == "session", F.concat(F.lit("session:"), user, F.lit("/"), session)).when(kind == "project", F.concat(F.lit("project:"), project)).otherwise("global")


def mime(path: Column) -> Column:
    """Kind of a file by its ending."""
    end = F.lower(F.substring_index(path, ".", -1))
    return F.when(end.isin("png", "jpg", "jpeg", "gif", "webp", "bmp"), "image").when(end.isin("mp4", "mov", "mkv", "webm", "avi"), "video").when(end.isin("mp3", "wav", "flac", "ogg", "m4a"), "audio").when(end.isin("txt", "md", "html", "json", "csv"), "text").otherwise("other")


def kind_of_meta(meta: Column) -> Column:
    """Kind of a document by words in its metadata, first match of a fixed order."""
    low = F.lower(F.coalesce(meta, F.lit("")))
    out = F.when(F.contains(low, F.lit("decision")), "decision")
    for word in ("lesson", "preference", "fact", "code", "session"):
        out = out.when(F.contains(low, F.lit(word)), word)
    return out.otherwise("other")


def one_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def first_heading(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+)$", 1)
    return F.when(found != "", F.trim(found))


def auto_title(kind: Column, text: Column) -> Column:
    return F.concat(kind, F.lit(": "), compact(F.coalesce(first_heading(text), one_line(text)), 60))


TIERS = {
    "full": None,
    "signatures": r"^\s*(fn|def|class|struct|enum|trait|impl|interface|function|pub|type|const|import|use|#)\b?",
    "facts": r"[0-9]|:|=|\b(is|are|was|must|should|never|always)\b",
}


def compress(text: Column, tier: str) -> Column:
    """Lines that a tier keeps: all, signatures, facts, or the single longest line."""
    if tier == "one_line":
        lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
        longest = F.array_max(F.transform(lines, F.length))
        return F.get(F.filter(lines, lambda x: F.length(x) == longest), F.lit(0))
    if TIERS[tier] is None:
        return text
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike("(?i)" + TIERS[tier])), "\n")


FRESH_WORDS = ["latest", "newest", "current version", "upgrade", "update", "deprecated", "release", "outdated"]


def freshness_needed(prompt: Column) -> Column:
    return F.rlike(F.lower(prompt), F.lit("|".join(FRESH_WORDS)))


SKILLS = {"test": "testing", "deploy": "deployment", "sql": "database", "graph": "knowledge-graph", "cost": "billing", "error": "debugging"}


def skill_hints(query: Column) -> Column:
    """Names of skills whose key word is in the query, in alphabetical order of the words."""
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(word)), F.lit(SKILLS[word])) for word in sorted(SKILLS)]))


DOCS_URL = {"cargo": ("https://docs.rs/{name}/{version}", "https://docs.rs/{name}"), "npm": ("https://www.npmjs.com/package/{name}/v/{version}", "https://www.npmjs.com/package/{name}"), "pypi": ("https://pypi.org/project/{name}/{version}/", "https://pypi.org/project/{name}/")}


def docs_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """Page of a package, of its version if that is known."""
    out = F.lit(None).cast("string")
    for key, (pinned, latest) in DOCS_URL.items():
        fill = lambda form: F.replace(F.replace(F.lit(form), F.lit("{name}"), F.url_encode(name)), F.lit("{version}"), F.url_encode(F.coalesce(version, F.lit(""))))
        out = F.when(ecosystem == key, F.when(version.isNotNull(), fill(pinned)).otherwise(fill(latest))).otherwise(out)
    return out


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces, common entities are decoded, white space collapses."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def html_title(html: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found).otherwise(fallback)


def video_id(uri: Column) -> Column:
    """Eleven-character id of a video in its address, or the id itself."""
    found = F.regexp_extract(uri, r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found).when(uri.rlike("^[A-Za-z0-9_-]{11}$"), uri)


def transcript_text(vtt: Column) -> Column:
    """Spoken lines of a subtitle file."""
    lines = F.transform(F.split(vtt, r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE|STYLE|Kind:|Language:)|^[0-9]+$|-->"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, "<[^>]*>", "")), " ")
