"""Markdown notes: frontmatter, sections, bullets, headings, speakers, chunks and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a chunk and between the beginnings of chunks; characters a token stands for.
CHUNK, STEP, TOKEN_CHARS = 10_000, 9_000, 4
#: Line beginnings that try to steer a reader model, and how much of a match is told.
STEERING = (
    r"ignore\s+(?:previous|all|prior)\s+instructions?",
    r"disregard\s+(?:the\s+)?(?:system\s+)?prompt",
    r"you\s+are\s+now\s+",
    r"act\s+as\s+(?:a\s+)?(?:new|different|unrestricted)",
    r"</?SYSTEM>",
    r"###\s*(?:system|instruction|override)\b",
    r"forget\s+everything\s+(?:you\s+)?(?:have\s+)?learned",
    r"jailbreak\b",
)
MATCH_CHARS = 120
#: Parameters that only track a visit.
TRACKING = r"^(?:utm_.*|fbclid|gclid|mc_.*)$"


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and ten hex digits of the SHA-256 over the parts joined by U+001F; null counts as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p, F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 10))


def claim_key(concept: Column, text: Column) -> Column:
    """``clm-`` and ten hex digits of the SHA-256 of ``concept:text`` without blanks around the text; null if either is."""
    return F.concat(F.lit("clm-"), F.substring(F.sha2(F.concat(concept, F.lit(":"), F.btrim(text, F.lit(" \t\r\n"))), 256), 1, 10))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def frontmatter(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(doc_id, …fields)`` of the notes that begin with a ``---`` block; a field it lacks is null, quotes are taken off."""
    head = F.regexp_extract(F.col("text"), r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    value = lambda f: F.regexp_replace(F.regexp_extract(F.col("head"), rf"(?m)^{f}:[ \t]*(.*?)[ \t]*\r?$", 1), r"^['\"]|['\"]$", "")
    return documents.select("doc_id", head.alias("head")).where("head <> ''").select("doc_id", *(F.nullif(value(f), F.lit("")).alias(f) for f in fields))


def front_list(documents: DataFrame, field: str) -> DataFrame:
    """``(doc_id, place, value)``: the items of a list field in the ``---`` block of a note, written one per line or between brackets; quotes are taken off."""
    head = F.regexp_extract(F.col("text"), r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    block = F.split(F.regexp_extract(F.col("head"), rf"(?m)^{field}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|$))+)", 1), r"\r?\n")
    inline = F.split(F.regexp_extract(F.col("head"), rf"(?m)^{field}:[ \t]*\[(.*)\][ \t]*\r?$", 1), ",")
    plain = lambda x: F.regexp_replace(F.btrim(F.regexp_replace(x, r"^[ \t]*-[ \t]+", ""), F.lit(" \t\r")), r"^['\"]|['\"]$", "")
    items = F.filter(F.transform(F.concat(block, inline), plain), lambda x: x != "")
    return documents.select("doc_id", head.alias("head")).where("head <> ''").select("doc_id", F.posexplode(items).alias("i", "value")).select("doc_id", (F.col("i") + 1).alias("place"), "value")


def lines(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` of every text, 1-based; a line's closing carriage return is taken off."""
    split = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return split.select("doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_replace("l", "\r$", "").alias("line"))


def headings(documents: DataFrame) -> DataFrame:
    """``(doc_id, line_no, level, title, parent_line)``: headings with the nearest earlier one of a lesser level.

    One pass over a document's headings: for each level the last heading of that level is carried along,
    and the latest of the shallower ones is the parent.
    """
    h = lines(documents).where(F.col("line").rlike(r"^#{1,6} +\S")).select("doc_id", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.rtrim(F.regexp_extract("line", "^#+ +(.*)$", 1)).alias("title"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.col("line_no")), ignorenulls=True).over(before).alias(f"h{n}") for n in range(1, 6)]
    parent = F.greatest(*(F.when(F.col("level") > n, F.col(f"h{n}")) for n in range(1, 6)))
    return h.select("*", *last).select("doc_id", "line_no", "level", "title", parent.alias("parent_line"))


def section(text: Column, title: str) -> Column:
    """What follows the heading ``## title`` up to the next ``##`` heading or the end; empty if there is none."""
    return F.regexp_extract(text, rf"(?s)(?:\A|\n)## {title}[ \t]*\r?\n(.*?)(?:\n## |\z)", 1)


def bullets(documents: DataFrame, title: str) -> DataFrame:
    """``(doc_id, place, bullet)``: the list items of a section, blanks collapsed, 1-based among the bullets."""
    items = F.filter(F.transform(F.split(section(F.col("text"), title), r"\r?\n"), lambda l: F.regexp_extract(l, r"^[-*] +(.*)$", 1)), lambda b: b != "")
    return documents.where("text IS NOT NULL").select("doc_id", F.posexplode(items).alias("i", "b")).select("doc_id", (F.col("i") + 1).alias("place"), F.btrim(F.regexp_replace("b", r"\s+", " ")).alias("bullet"))


def speaker_turns(documents: DataFrame) -> DataFrame:
    """``(doc_id, speaker, n_turns, n_chars)`` of transcripts with lines ``[mm:ss] NAME: words``."""
    t = lines(documents).select("doc_id", F.regexp_extract("line", r"^\[\d{2}:\d{2}\] ([A-Z]+): ", 1).alias("speaker"), F.length("line").alias("n")).where("speaker <> ''")
    return t.groupBy("doc_id", "speaker").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n").alias("n_chars"))


def chunks(documents: DataFrame) -> DataFrame:
    """``(doc_id, chunk_no, start, n_chars)``: overlapping pieces of every text; a short text is one piece, an empty one none."""
    n = F.length("text")
    starts = F.when(n > CHUNK, F.sequence(F.lit(0), n - 1 - (CHUNK - STEP), F.lit(STEP))).otherwise(F.array(F.lit(0)))
    return documents.where(n > 0).select("doc_id", n.alias("n"), F.posexplode(starts).alias("i", "start")).select("doc_id", (F.col("i") + 1).alias("chunk_no"), "start", F.least(F.lit(CHUNK), F.col("n") - F.col("start")).alias("n_chars"))


def tokens_estimate(n_chars: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(n_chars / TOKEN_CHARS)).cast("bigint")


def steering_report(documents: DataFrame) -> DataFrame:
    """``(pattern, n_matches, n_texts)``: for each pattern, by number, how many distinct texts have a line that begins with it."""
    texts = documents.where("text IS NOT NULL").select("doc_id", "text").distinct()
    hits = texts.agg(F.count(F.lit(1)).alias("n_texts"), *(F.count_if(F.col("text").rlike(rf"(?imdU)^\s*{p}")).alias(f"n{i}") for i, p in enumerate(STEERING, 1)))
    return hits.select(F.explode(F.array(*(F.struct(F.lit(i).alias("pattern"), F.col(f"n{i}").alias("n_matches")) for i in range(1, len(STEERING) + 1)))).alias("x"), "n_texts").select("x.pattern", "x.n_matches", "n_texts")


def steering_matches(documents: DataFrame) -> DataFrame:
    """``(doc_id, matches)`` of the texts with a line that begins like a steering phrase: the first match of each pattern, without blanks around it.

    Case does not count; blanks are Unicode's and only a line feed ends a line.
    """
    first = [F.regexp_extract("text", rf"(?imdU)^\s*{p}", 0) for p in STEERING]
    told = F.transform(F.filter(F.array(*first), lambda m: m != ""), lambda m: F.substring(F.regexp_replace(m, r"(?U)^\s+|\s+$", ""), 1, MATCH_CHARS))
    return documents.where("text IS NOT NULL").select("doc_id", told.alias("matches")).where(F.size("matches") > 0)


def canonical_url(c: Column) -> Column:
    """The address without fragment and tracking parameters; other parameters keep their order and blank values."""
    bare = F.regexp_replace(F.btrim(c, F.lit(" \t\r\n")), "#.*$", "")
    kept = F.filter(F.split(F.get(F.split(bare, r"\?", 2), F.lit(1)), "&"), lambda p: ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING))
    return F.concat(F.split(bare, r"\?", 2)[0], F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def anchor_parts(anchors: DataFrame) -> DataFrame:
    """The anchor mini-language: ``(anchor, kind, first, last)`` of ``page=n``, ``Lx=Ly``, ``Lx``, ``seg-n`` and ``section=s``.

    Numbers that do not fit are null; anything else is kind ``other``.
    """
    a = F.col("anchor")
    page, low, high, seg = (F.regexp_extract(a, p, 1) for p in (r"^page=(\d+)$", r"^L(\d+)(?:=L\d+)?$", r"^L\d+=L(\d+)$", r"^seg-(\d+)$"))
    kind = F.when(page != "", "page").when(low != "", "lines").when(seg != "", "segment").when(a.startswith("section="), "section").otherwise("other")
    first = F.coalesce(*(F.nullif(x, F.lit("")) for x in (page, low, seg))).try_cast("int")
    return anchors.where(a.isNotNull()).select("anchor", kind.alias("kind"), first.alias("first"), F.nullif(high, F.lit("")).try_cast("int").alias("last")).distinct()
