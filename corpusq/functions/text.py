"""Column expressions over names, labels, text and times. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.taxonomy import PRIMARIES

_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


# --- files and identifiers ----------------------------------------------------

def file_suffix(name: Column) -> Column:
    """Lower-cased last suffix with its dot; '' when there is none."""
    return F.regexp_extract(F.lower(name), r"(?s)^(?:.*/)?[^/]+?(\.[^./]+)\z", 1)


def stored_doc_id(path: Column) -> Column:
    """Document id of a stored file named `<32 or 12 hex chars>_<file name>`."""
    return F.regexp_extract(path, r"(?:^|/)([0-9a-f]{32}|[0-9a-f]{12})_[^/]*$", 1)


def random_doc_id(length: int = 32) -> Column:
    return F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, length)


def derived_doc_id(*parts: Column, length: int = 32) -> Column:
    """Id that a re-run derives again. Parts go in with their lengths, so that no two lists
    of parts read the same; a null part differs from an empty one. Of `length` hex characters
    32 make a collision unthinkable; 12 are what imported registries have."""
    marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-"))
              for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *marked).cast("binary"), 256), 1, length)


def content_hash(content: Column) -> Column:
    """SHA-256 hex of bytes (a string counts as its UTF-8 bytes)."""
    return F.sha2(content.cast("binary"), 256)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("_chunk_"), index.cast("string"))


# --- collections and labels ----------------------------------------------------

def parse_collections(csv: Column) -> Column:
    """Comma list -> trimmed, non-empty, distinct names in order."""
    names = F.transform(F.split(csv, ","), strip)
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def _non_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def resolve_collections(manual: Column, auto: Column, suggested: Column) -> Column:
    """Manual names win; else the suggestion if asked for; else the default."""
    return F.coalesce(
        _non_empty(manual),
        F.when(auto, _non_empty(suggested)),
        F.array(F.lit(fv.DEFAULT_COLLECTION)),
    )


def collections_csv(names: Column) -> Column:
    return F.array_join(names, "|")


def capitalize_name(name: Column) -> Column:
    """First character upper, all others lower (unlike initcap)."""
    return F.concat(F.upper(F.substring(name, 1, 1)),
                    F.lower(name.substr(F.lit(2), F.length(name))))


def slugify_labels(labels: Column) -> Column:
    """Strip, lower-case, blanks to hyphens, quotes dropped; keep 1..50 characters."""
    slugs = F.transform(
        labels,
        lambda x: F.translate(F.replace(F.lower(strip(x)), F.lit(" "), F.lit("-")), "\"'", ""),
    )
    return F.filter(slugs, lambda x: F.length(x).between(1, fv.LABEL_MAX_CHARS))


def fallback_label(reply: Column) -> Column:
    """First primary category, in taxonomy order, named in a free-text reply."""
    plain = F.lower(F.replace(F.translate(reply, "\"'.", ""), F.lit(" "), F.lit("-")))
    named = F.filter(F.array(*[F.lit(p) for p in PRIMARIES]),
                     lambda p: F.contains(plain, p))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(fv.DEFAULT_COLLECTION))


def unfenced_reply(reply: Column) -> Column:
    """Reply without its code fence: the text between the first two fences."""
    whole = strip(reply)
    inside = F.try_element_at(F.split(whole, "```"), F.lit(2))
    return F.when(F.contains(whole, F.lit("```")),
                  strip(F.regexp_replace(inside, r"\Ajson", ""))).otherwise(whole)


def parse_label_reply(reply: Column) -> Column:
    """Classifier reply -> label list; JSON array first, free text second."""
    body = unfenced_reply(F.coalesce(reply, F.lit("")))
    is_array = F.substring(body, 1, 1) == "["
    parsed = slugify_labels(F.filter(F.from_json(F.when(is_array, body), "array<string>"),
                                     lambda x: x.isNotNull()))
    return F.coalesce(_non_empty(parsed), F.array(fallback_label(body)))


# --- snippets, sources, messages ------------------------------------------------

def _last_index(head: Column, mark: str) -> Column:
    """0-based position of the last `mark` in `head`; negative if absent."""
    from_end = F.instr(F.reverse(head), mark[::-1])
    return F.when(from_end > 0, F.length(head) - len(mark) - from_end + 1).otherwise(F.lit(-1))


def smart_truncate(text: Column, max_len: int = fv.SOURCE_SNIPPET_CHARS) -> Column:
    """Cut at a sentence end, else a blank, else hard, keeping over half of the limit."""
    head = F.substring(text, 1, max_len)
    out = F.when(F.length(text) <= max_len, text)
    for mark in fv.SENTENCE_MARKS:
        at = _last_index(head, mark)
        out = out.when(at > max_len / 2, head.substr(F.lit(1), at + 1))
    blank = _last_index(head, " ")
    out = out.when(blank > max_len / 2, F.concat(head.substr(F.lit(1), blank), F.lit("...")))
    return out.otherwise(F.concat(head, F.lit("...")))


def source_line(rank: Column, source_file: Column, page: Column, content: Column) -> Column:
    """`[Source i: file (p.N)]` heading and the passage; pages count from 1."""
    label = F.when(page.isNotNull(), F.concat(F.lit(" (p."), (page + 1).cast("string"), F.lit(")")))
    return F.concat(
        F.lit("[Source "), rank.cast("string"), F.lit(": "),
        F.coalesce(source_file, F.lit("unknown")), F.coalesce(label, F.lit("")),
        F.lit("]\n"), content,
    )


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def size_mb(n_bytes: Column) -> Column:
    """Whole mebibytes, rounded down."""
    return F.floor(n_bytes / F.lit(1024 * 1024)).cast("bigint")


def upload_message(suggested: Column) -> Column:
    return F.concat(
        F.lit(fv.UPLOAD_MESSAGE),
        F.when(F.size(suggested) > 0,
               F.concat(F.lit(fv.SUGGESTED_MESSAGE), F.array_join(suggested, ", ")))
        .otherwise(F.lit("")),
    )


# --- markup ---------------------------------------------------------------------

# (pattern, replacement) in order of use; Java and RE2 read them alike.
HTML_STEPS = [
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<title[^>]*>.*?</title>", " "),
    (r"(?i)</?(p|div|h[1-6]|li|ul|ol|table|tr|article|section|nav|header|footer|"
     r"main|blockquote|pre|br|hr)(\s[^>]*)?/?>", "\n\n"),
    (r"<[^>]*>", ""),
]
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                 ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]
SPACE_STEPS = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n\n"), (r"^[ \n]+|[ \n]+$", "")]
TITLE_PATTERN = r"(?is)<title[^>]*>(.*?)</title>"

MARKDOWN_STEPS = [
    (r"(?m)^[ \t]*```[^\n]*$", ""),
    (r"!\[([^\]]*)\]\([^)]*\)", r"\1"),
    (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$", ""),
    (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"\*\*|__|`", ""),
    (r"\*([^*\n]+)\*", r"\1"),
    (r"\n{3,}", "\n\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]


def _rewrite(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by.replace("\\1", "$1"))
    return c


def html_to_text(html: Column) -> Column:
    """Visible text of a page; block elements end a paragraph."""
    text = _rewrite(html, HTML_STEPS)
    for entity, by in HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    return _rewrite(text, SPACE_STEPS)


def html_title(html: Column) -> Column:
    return strip(F.regexp_extract(html, TITLE_PATTERN, 1))


def markdown_to_text(md: Column) -> Column:
    return _rewrite(md, MARKDOWN_STEPS)


# --- words ------------------------------------------------------------------------

def words(text: Column) -> Column:
    """Lower-cased tokens between white space, without empties."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")
