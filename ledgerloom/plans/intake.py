"""Queries about what comes in and goes out: routes of sources, pages, note lists, manifests, shaped results, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.keys import folded, source_key, spelling_key
from ledgerloom.operators import notes
from ledgerloom.plans import knowledge, links
from ledgerloom.plans.knowledge import FLAGGED, latest_registry
from ledgerloom.plans.knowledge_sql import _ALL, _FOLD, _KEY, _LATEST, _SRC, FLAGGED as _F, TOP, _bm25
from ledgerloom.plans.links import _PARENT
from ledgerloom.sources.tables import table
from ledgerloom.sources.vault import html_text as text_of_pages
from ledgerloom.streaming import ledgers

SNIPPET = 200


def source_routes(s, d):
    """How each registered source would be taken in: as a repository, an article, another page or a file."""
    low = F.lower("source")
    host = F.regexp_extract(low, r"^https?://([^/?#\s]+)", 1)
    route = F.when(host == "", "file").when((host == "github.com") & low.rlike(r"^https?://[^/]+/[^/]+/[^/?#]+/?$"), "repository").when(host.rlike(r"(?:^|\.)arxiv\.org$"), "paper").when(host.rlike(r"(?:^|\.)(?:medium|substack)\.com$") | host.startswith("blog."), "article").otherwise("page")
    return table(s, d, "registry").where("id IS NOT NULL AND source IS NOT NULL").select("id", host.alias("host"), route.alias("route")).distinct()


def html_text(s, d):
    """Documents shown as web pages and read back: length and hash of the text that is found."""
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title><style>p {}</style></head><body><nav>menu</nav><article><p>"), F.regexp_replace(esc, r"\r?\n", "</p><p>"), F.lit("</p></article><footer>end</footer></body></html>"))
    docs = table(s, d, "documents").where("kind = 'readme'").where(F.col("text").rlike(r"\S")).where(~F.col("text").rlike(r"[^\x09\x0a\x0d\x20-\x7e]")).select("doc_id", page.alias("html"))
    return text_of_pages(docs, "doc_id", "html").select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def note_tags(s, d):
    return notes.front_list(table(s, d, "documents"), "tags")


def render_manifest(s, d):
    """Which documents are shown and why the others are not, counted by the first reason."""
    flagged = table(s, d, "registry").where(F.coalesce(folded(F.col("source_status")).isin(*FLAGGED), F.lit(False))).select(F.col("id").alias("source_id"), F.lit(1).alias("flagged")).distinct()
    docs = table(s, d, "documents").join(flagged, "source_id", "left")
    reason = F.when(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")) == "", "empty").when(F.col("flagged").isNotNull(), "flagged-source").when(F.col("kind").isNull(), "unknown-kind").otherwise("included")
    return docs.groupBy(reason.alias("state")).agg(F.count(F.lit(1)).alias("n_documents"))


def search_results(s, d):
    """The best documents for every concept title as they are shown: kind, score and the first characters."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.substring(F.regexp_replace("text", r"[ \t\r\n]+", " "), 1, SNIPPET).alias("snippet"))
    return knowledge.bm25_topk(s, d).join(docs, "doc_id").select("query_id", "rank", "doc_id", "kind", "score", F.sha2("snippet", 256).alias("snippet_hash"))


def anchor_lookup(s, d):
    """References of the form ``source#anchor`` and the claims that they lead to."""
    a = table(s, d, "claims").where("claim_id IS NOT NULL").select("claim_id", F.explode("source_anchors").alias("a")).select("claim_id", F.concat_ws("#", source_key(F.col("a.source_id")), F.col("a.anchor")).alias("ref"), F.col("a.anchor").alias("anchor")).where("anchor IS NOT NULL AND startswith(ref, 'src-')")
    return a.groupBy("ref").agg(F.count_distinct("claim_id").alias("n_claims"), F.min("claim_id").alias("first"))


def repeated_ids(s, d):
    """Claims delivered more than once."""
    return table(s, d, "claims").where("claim_id IS NOT NULL").groupBy("claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def corroboration(s, d):
    """Concepts by how many independent origins stand behind them, with the mean confidence of their claims."""
    o = links.independent_origins(s, d)
    c = table(s, d, "claims").where("concept IS NOT NULL AND confidence IS NOT NULL").select(spelling_key(F.col("concept")).alias("owner"), "claim_id", "confidence").distinct().groupBy("owner").agg(F.round(F.avg("confidence"), 10).alias("confidence"))
    return o.join(c, "owner", "left").select("owner", "n_origins", (F.col("n_origins") >= 2).alias("corroborated"), F.col("confidence"))


def public_safety(s, d):
    """Counts that must stay at zero before anything is published."""
    reg = latest_registry(s, d)
    private = F.coalesce(F.col("source").rlike(r"(?i)^(?:file:|/|localhost|https?://(?:localhost|10\.|192\.168\.))"), F.lit(False))
    secret = F.coalesce(F.col("text").rlike(r"(?i)(?:api[_-]?key|secret|password)\s*[:=]\s*\S+"), F.lit(False))
    a = reg.agg(F.count_if(private).alias("n_private_sources"))
    b = table(s, d, "documents").agg(F.count_if(secret).alias("n_secrets"))
    return a.crossJoin(F.broadcast(b)).select("*", ((F.col("n_private_sources") == 0) & (F.col("n_secrets") == 0)).alias("safe"))


def signal_vector(s, d):
    """The six counters of the knowledge base's state."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL").groupBy("claim_id").agg(F.max((F.col("status") == "contested").cast("int")).alias("contested"), F.max((F.size(F.coalesce("source_anchors", F.array())) > 0).cast("int")).alias("anchored"))
    one = c.agg(F.count(F.lit(1)).alias("n_claims"), F.coalesce(F.sum("contested"), F.lit(0)).alias("n_contested"), F.coalesce(F.sum("anchored"), F.lit(0)).alias("n_anchored"))
    probes = table(s, d, "dev_probes").agg(F.count_distinct(F.when(F.coalesce("review_status", F.lit("unreviewed")) == "unreviewed", F.col("id"))).alias("n_unreviewed"))
    reg = table(s, d, "registry").agg(F.count_distinct("id").alias("n_sources"))
    con = table(s, d, "concepts").agg(F.count_if(F.coalesce(F.col("claim_quality").isin("weak", "stale"), F.lit(False))).alias("n_weak_concepts"))
    return one.crossJoin(F.broadcast(probes)).crossJoin(F.broadcast(reg)).crossJoin(F.broadcast(con))


def stream_latest(s, d):
    """The last event of every user, merged batch by batch from a stream."""
    e = table(s, d, "events")
    stream = ledgers.event_stream(s, d, "events", e.schema).select("user_id", "ts", "event_id", "event_type")
    return ledgers.settle_upserts(stream, "user_id", "ts")


QUERIES = {f.__name__: f for f in (source_routes, html_text, note_tags, render_manifest, search_results, anchor_lookup, repeated_ids, corroboration, public_safety, signal_vector, stream_latest)}

_HEADBLOCK = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"

SQL = {
    "source_routes": r"WITH r AS (SELECT DISTINCT id, lower(source) AS u, regexp_extract(lower(source), '^https?://([^/?#\s]+)', 1) AS host FROM registry WHERE id IS NOT NULL AND source IS NOT NULL) SELECT DISTINCT id, host, CASE WHEN host = '' THEN 'file' WHEN host = 'github.com' AND regexp_matches(u, '^https?://[^/]+/[^/]+/[^/?#]+/?$') THEN 'repository' WHEN regexp_matches(host, '(?:^|\.)arxiv\.org$') THEN 'paper' WHEN regexp_matches(host, '(?:^|\.)(?:medium|substack)\.com$') OR starts_with(host, 'blog.') THEN 'article' ELSE 'page' END AS route FROM r",
    "html_text": r"WITH t AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda l: trim(regexp_replace(l, '[ \t\r\n]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS t FROM documents WHERE kind = 'readme' AND regexp_matches(text, '\S') AND NOT regexp_matches(text, '[^\x09\x0a\x0d\x20-\x7e]')) SELECT doc_id, length(t)::INTEGER AS n_chars, sha256(t) AS text_hash FROM t",
    "note_tags": rf"WITH h AS (SELECT doc_id, regexp_extract(text, '{_HEADBLOCK}', 1) AS h FROM documents), i AS (SELECT doc_id, list_filter(list_transform(list_concat(string_split_regex(regexp_extract(h, '(?m)^tags:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|$))+)', 1), '\r?\n'), string_split(regexp_extract(h, '(?m)^tags:[ \t]*\[(.*)\][ \t]*\r?$', 1), ',')), lambda x: regexp_replace(trim(regexp_replace(x, '^[ \t]*-[ \t]+', ''), ' ' || chr(9) || chr(13)), '^[''\"]|[''\"]$', '', 'g')), lambda x: x <> '') AS l FROM h WHERE h <> '') SELECT doc_id, i::INTEGER AS place, l[i] AS value FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM i)",
    "render_manifest": f"SELECT CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN source_id IN (SELECT id FROM registry WHERE {_FOLD.format('source_status')} IN {_F}) THEN 'flagged-source' WHEN kind IS NULL THEN 'unknown-kind' ELSE 'included' END AS state, count(*) AS n_documents FROM documents GROUP BY 1",
    "search_results": _bm25(_ALL) + rf"SELECT query_id, rank, doc_id, coalesce(d.kind, 'unknown') AS kind, score, sha256(substr(regexp_replace(d.text, '[ \t\r\n]+', ' ', 'g'), 1, {SNIPPET})) AS snippet_hash FROM ranked JOIN documents d USING (doc_id) WHERE rank <= {TOP}",
    "anchor_lookup": f"WITH a AS (SELECT claim_id, {_SRC.format('a.source_id')} AS sid, a.anchor AS anchor FROM (SELECT claim_id, unnest(source_anchors) AS a FROM claims WHERE claim_id IS NOT NULL)) SELECT sid || '#' || anchor AS ref, count(DISTINCT claim_id) AS n_claims, min(claim_id) AS first FROM a WHERE sid IS NOT NULL AND anchor IS NOT NULL GROUP BY 1",
    "repeated_ids": "SELECT claim_id, count(*) AS n FROM claims WHERE claim_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "corroboration": _PARENT + f", cs AS (SELECT DISTINCT owner, item FROM (SELECT {_KEY.format('concept')} AS owner, {_SRC.format('u')} AS item FROM (SELECT concept, unnest(source_ids) AS u FROM claims WHERE concept IS NOT NULL)) WHERE item IS NOT NULL), o AS (SELECT owner, count(DISTINCT coalesce(root, item)) AS n_origins FROM cs LEFT JOIN roots ON roots.id = item GROUP BY owner), c AS (SELECT owner, round(avg(confidence), 10) AS confidence FROM (SELECT DISTINCT {_KEY.format('concept')} AS owner, claim_id, confidence FROM claims WHERE concept IS NOT NULL AND confidence IS NOT NULL) GROUP BY owner) SELECT owner, n_origins, n_origins >= 2 AS corroborated, confidence FROM o LEFT JOIN c USING (owner)",
    "public_safety": rf"SELECT *, n_private_sources = 0 AND n_secrets = 0 AS safe FROM (SELECT count(*) FILTER (WHERE regexp_matches(source, '(?i)^(?:file:|/|localhost|https?://(?:localhost|10\.|192\.168\.))')) AS n_private_sources FROM {_LATEST}), (SELECT count(*) FILTER (WHERE regexp_matches(text, '(?i)(?:api[_-]?key|secret|password)\s*[:=]\s*\S+')) AS n_secrets FROM documents)",
    "signal_vector": "WITH c AS (SELECT claim_id, max((status = 'contested')::INTEGER) AS ct, max((len(coalesce(source_anchors, [])) > 0)::INTEGER) AS an FROM claims WHERE claim_id IS NOT NULL GROUP BY 1) SELECT * FROM (SELECT count(*) AS n_claims, coalesce(sum(ct), 0)::BIGINT AS n_contested, coalesce(sum(an), 0)::BIGINT AS n_anchored FROM c), (SELECT count(DISTINCT id) FILTER (WHERE coalesce(review_status, 'unreviewed') = 'unreviewed') AS n_unreviewed FROM dev_probes), (SELECT count(DISTINCT id) AS n_sources FROM registry), (SELECT count(*) FILTER (WHERE claim_quality IN ('weak', 'stale')) AS n_weak_concepts FROM concepts)",
    "stream_latest": "SELECT user_id, ts, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) = 1",
}
