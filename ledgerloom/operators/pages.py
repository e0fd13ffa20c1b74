"""Page grammar: source links and their anchors, typed edges, claims of a page, titles, tags and other normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.notes import claim_key, section

#: The written forms of a link to a source: wikilink, Markdown link, plain id, each with an anchor or without.
SOURCE_LINK = r"\[\[Sources/(?:[^/\]#|]+/)?src-[0-9a-f]{10}(?:#[^\]|)]+)?(?:\|[^\]]*)?\]\]|\[[^\]]*\]\((?:\.\./)*Sources/(?:[^/)]+/)?src-[0-9a-f]{10}\.md(?:#[^)]*)?\)|src-[0-9a-f]{10}(?:#[\w./=&:%+-]+)?"
#: Predicates of a typed edge, and how it is written.
PREDICATES = ("conforms_to", "extends", "derived_from", "contrasts_with", "supersedes", "superseded_by", "part_of")
EDGE = rf"^\s*-\s+`({'|'.join(PREDICATES)})::`\s+(?:\[\[Concepts/([^/|\]]+)(?:\|[^\]]+)?\]\]|\[[^\]]*\]\((?:\.\./)*Concepts/([^)#]+)\.md(?:#[^)]*)?\))"
#: Other names of source kinds.
KINDS = {"github_repo_snapshot": "github-repo-snapshot", "repo_native": "github-repo-snapshot", "github-repo": "github-repo-snapshot", "pdf": "paper-pdf", "url": "blog", "article": "blog", "web-page": "blog", "file": "local-file", "imported_model_report": "imported-model-report", "imported_model_report_citation": "citation-stub", "other": "local-file"}
#: Names that stand for no author.
NOBODY = ("unknown", "none", "null")


def source_links(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, place, source_id, anchor)``: the distinct source links of a text in order, 1-based; an anchor is null where there is none."""
    found = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(SOURCE_LINK), F.lit(0))).alias("i", "m"))
    parsed = found.select(key, "i", F.regexp_extract("m", "src-[0-9a-f]{10}", 0).alias("source_id"), F.nullif(F.regexp_extract("m", r"src-[0-9a-f]{10}(?:\.md)?#([^\]|)]*)", 1), F.lit("")).alias("anchor"))
    return parsed.groupBy(key, "source_id", "anchor").agg((F.min("i") + 1).alias("place")).select(key, "place", "source_id", "anchor")


def anchor_fields(anchor: Column) -> dict[str, Column]:
    """The fields of an anchor: parts between ``&``, the last of a name counts; numbers that are none are null; closing punctuation is taken off."""
    a = F.regexp_replace(anchor, r"^#+|[.,;)]+$", "")
    part = lambda pattern, group=1: F.nullif(F.regexp_extract(a, rf"^(?:.*&)?{pattern}(?:&.*)?$", group), F.lit(""))
    number = lambda name: part(rf"{name}=(\d+)[.,;)]*").try_cast("int")
    named = lambda name: part(rf"{name}=([^&]*[^&.,;)])[.,;)]*")
    return {
        "page": number("page"), "paragraph": number("paragraph"), "section": named("section"), "quote": named("quote"), "path": named("path"), "commit": named("commit"),
        "line_start": F.coalesce(part(r"L(\d+)(?:=L\d+)?").try_cast("int"), number("(?:line_start|L)")), "line_end": F.coalesce(part(r"L\d+=L(\d+)").try_cast("int"), number("line_end")),
        "segment_id": F.coalesce(named("(?:segment_id|segment)"), part(r"(seg-[^&=]*)")), "extraction_confidence": named("extraction_confidence").try_cast("double"),
    }


def typed_edges(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, predicate, target)`` of list items that name a typed edge to a concept page."""
    line = pages.where(F.col(text).isNotNull()).select(key, F.explode(F.split(text, r"\r?\n")).alias("line")).where(F.col("line").rlike(EDGE))
    return line.select(key, F.regexp_extract("line", EDGE, 1).alias("predicate"), F.coalesce(F.nullif(F.regexp_extract("line", EDGE, 2), F.lit("")), F.regexp_extract("line", EDGE, 3)).alias("target")).distinct()


def plain_claim(c: Column) -> Column:
    """A claim's text without its source links, blanks collapsed, none before punctuation."""
    bare = F.regexp_replace(c, rf"\s*\(?(?:{SOURCE_LINK})\)?", "")
    return F.regexp_replace(F.btrim(F.regexp_replace(bare, r"\s+", " ")), r"\s+([,.;:!?])", "$1")


def page_claims(pages: DataFrame, key: str, concept: str, text: str) -> DataFrame:
    """``(key, claim_index, claim_id, claim_text, n_links)``: the list items under ``Key Claims``, numbered from 0.

    The id is a hash of concept and plain text, so that a claim keeps it when its links change. Pages without concept give no row.
    """
    lines = F.split(section(F.col(text), "Key Claims"), r"\r?\n")
    items = F.filter(F.transform(lines, lambda line: F.regexp_replace(F.btrim(F.regexp_extract(line, r"^\s*[-*]\s+(.*\S.*?)\s*$", 1)), r"\s+", " ")), lambda x: x != "")
    c = pages.where(F.col(key).isNotNull() & F.col(concept).isNotNull() & F.col(text).isNotNull()).select(key, F.col(concept).alias("concept"), F.posexplode(items).alias("claim_index", "raw"))
    return c.select(key, "claim_index", claim_key(F.col("concept"), plain_claim(F.col("raw"))).alias("claim_id"), plain_claim(F.col("raw")).alias("claim_text"), F.size(F.regexp_extract_all("raw", F.lit(SOURCE_LINK), F.lit(0))).alias("n_links"))


def title_of(text: Column) -> Column:
    """The first ``# `` heading; null if there is none."""
    return F.nullif(F.btrim(F.regexp_extract(text, r"(?m)^#[ \t]+(.*\S)[ \t]*\r?$", 1)), F.lit(""))


def summary_of(text: Column, most: int = 280) -> Column:
    """The first paragraph that is no heading, list, table, fence, quote or front matter, blanks collapsed, cut at ``most`` characters; null if there is none."""
    body = F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")
    paragraphs = F.filter(F.transform(F.split(body, r"\r?\n[ \t]*\r?\n"), lambda p: F.btrim(F.regexp_replace(p, r"[ \t\r\n]+", " "))), lambda p: p.rlike(r"^[^#*|`>\s-]"))
    return F.substring(F.get(paragraphs, F.lit(0)), 1, most)


def year_of(*dates: Column) -> Column:
    """The first year from 1900 on that one of the values names, in their order; ``Unknown`` if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(d, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1), F.lit("")) for d in dates), *(F.nullif(F.regexp_extract(d, r"^((?:19|20)\d\d)", 1), F.lit("")) for d in dates), F.lit("Unknown"))


def authors_of(authors: Column, organization: Column) -> Column:
    """Author names and the organization without blanks, repeats and names that stand for nobody."""
    names = F.transform(F.concat(F.coalesce(authors, F.array().cast("array<string>")), F.array(organization)), lambda a: F.btrim(a))
    return F.array_distinct(F.filter(names, lambda a: a.isNotNull() & (a != "") & ~F.lower(a).isin(*NOBODY)))


def kind_of(kind: Column) -> Column:
    """The accepted name of a source kind; unknown ones are kept, null is a local file."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[kind], kind, F.lit("local-file"))


def tags_of(tags: Column, kind: Column, space: str = "vault/") -> Column:
    """Tags without blanks and repeats, in order, the type's own tag among them; a bare type name gets its namespace."""
    own = F.concat(F.lit(space), kind)
    kept = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.btrim(t)), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.transform(kept, lambda t: F.when(t == kind, own).otherwise(t)), F.array(own)), lambda t: t.isNotNull())))


def name_key(name: Column) -> Column:
    """Letters and digits only, lower case, without a plural s: one key for ``A_b``, ``a-B`` and ``Abs``."""
    k = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return F.when(k.endswith("s") & (F.length(k) > 3), F.left(k, F.length(k) - 1)).otherwise(k)


def salvaged_object(text: Column) -> Column:
    """The JSON object a text is, or holds between its first and last brace, as text; null if there is none."""
    part = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    is_object = lambda t: F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT")
    return F.when(is_object(F.btrim(text)), F.btrim(text)).when((part != "") & is_object(part), part)
