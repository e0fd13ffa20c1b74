"""HTML to text with the standard library."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

#: Elements without text of their own, and elements that end a line.
HIDDEN = ("script", "style", "nav", "footer", "aside", "noscript", "template")
BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "tr", "section", "article", "blockquote", "pre")


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.article: list[str] = []
        self.linked: list[str] = []
        self.hidden = self.inside = 0
        self.data: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script" and ("type", "application/ld+json") in attrs:
            self.data = []
        self.hidden += tag in HIDDEN
        self.inside += tag == "article"
        if tag in BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.data is not None:
            self.linked.append("".join(self.data))
            self.data = None
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self._add("\n")
        if tag == "article" and self.inside:
            self.inside -= 1

    def handle_data(self, data: str) -> None:
        if self.data is not None:
            self.data.append(data)
        elif not self.hidden:
            self._add(data)

    def _add(self, data: str) -> None:
        self.out.append(data)
        if self.inside:
            self.article.append(data)


def _bodies(value: object) -> list[str]:
    """Every ``articleBody`` in a JSON-LD value, however deep."""
    if isinstance(value, dict):
        own = [value["articleBody"]] if isinstance(value.get("articleBody"), str) else []
        return own + [b for v in value.values() for b in _bodies(v)]
    return [b for v in value for b in _bodies(v)] if isinstance(value, list) else []


def _tidy(text: str) -> str:
    return "\n".join(line for line in (" ".join(x.split()) for x in text.split("\n")) if line)


def to_text(html: str) -> str:
    """The longest of: the article element, the JSON-LD article body, all visible text if there is neither."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    found = [_tidy("".join(reader.article))]
    for block in reader.linked:
        try:
            found += map(_tidy, _bodies(json.loads(block)))
        except ValueError:
            continue
    best = max(found, key=len)
    return best or _tidy("".join(reader.out))


#: Tags that name a page's other addresses, and the meta names of bibliographic fields, in the order in which they count.
ADDRESSES = (("link", "rel", "canonical", "href"), ("link", "rel", "amphtml", "href"), ("meta", "property", "og:url", "content"), ("meta", "name", "twitter:url", "content"))
DOI = (("name", "citation_doi"), ("property", "citation_doi"), ("name", "dc.identifier"), ("name", "dc.identifier.doi"))
JOURNAL = (("name", "citation_journal_title"), ("name", "citation_publisher"), ("name", "dc.publisher"))
AUTHOR = (("name", "citation_author"), ("name", "dc.creator"))
DATE = (("name", "citation_date"), ("name", "citation_publication_date"), ("name", "dc.date"), ("name", "dc.date.issued"))


class _Head(HTMLParser):
    """Collects the attributes of link and meta tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict[str, str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("link", "meta"):
            self.tags.append((tag, {k: (v or "").strip() for k, v in attrs}))


def _tags(html: str) -> list[tuple[str, dict[str, str]]]:
    head = _Head()
    head.feed(html)
    head.close()
    return head.tags


def without_tracking(url: str) -> str:
    """The address without parameters that only track a visit; the others keep order and blank values."""
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.startswith("utm_") and k not in ("fbclid", "gclid", "mc_cid", "mc_eid")]
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(kept), parts.fragment))


def candidate_urls(html: str, url: str) -> list[str]:
    """The page's own address and those its head names, without tracking, each once, in that order."""
    tags = _tags(html)
    named = (next((a.get(value) for t, a in tags if t == tag and a.get(key) == is_), None) for tag, key, is_, value in ADDRESSES)
    return list(dict.fromkeys(map(without_tracking, [url, *(urljoin(url, n) for n in named if n)])))


def bibliography(html: str) -> dict[str, str | int | None]:
    """Author, journal, year and DOI from a page's meta tags; null where there is none."""
    metas = [a for t, a in _tags(html) if t == "meta"]

    def all_of(names: tuple[tuple[str, str], ...]) -> list[str]:
        for key, name in names:
            if found := [a["content"] for a in metas if a.get(key) == name and a.get("content")]:
                return found
        return []

    year = next((m.group() for d in all_of(DATE)[:1] if (m := re.search(r"\b(?:19|20)\d{2}\b", d))), None)
    return {"author": ", ".join(all_of(AUTHOR)) or None, "journal": next(iter(all_of(JOURNAL)), None), "year": int(year) if year else None, "doi": next(iter(all_of(DOI)), None)}
