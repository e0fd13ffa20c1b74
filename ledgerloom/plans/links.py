"""Queries over the graph of concepts, claims and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.keys import folded, source_key, spelling_key
from ledgerloom.operators import graph, quality
from ledgerloom.operators.components import components
from ledgerloom.plans.knowledge import FLAGGED
from ledgerloom.sources.tables import table


def concept_sources(s: SparkSession, d: str) -> DataFrame:
    """``(owner, item)``: which concept's claims cite which source."""
    c = table(s, d, "claims").where("concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("owner"), F.explode(F.transform("source_ids", source_key)).alias("item"))
    return c.where("item IS NOT NULL").distinct()


def concept_links(s: SparkSession, d: str) -> DataFrame:
    """``(a, b)``: directed edges from a claim's concept to the concept pages that its page edges name."""
    c = table(s, d, "claims").where("concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("a"), F.explode(F.flatten(F.map_values("page_edges"))).alias("t"))
    return c.where("t IS NOT NULL").select("a", spelling_key(F.regexp_extract("t", r"([^/]+)$", 1)).alias("b")).where("a <> '' AND b <> ''").distinct()


def page_links(s: SparkSession, d: str) -> DataFrame:
    """``(relation, a, b)``: the typed page edges between concept pages."""
    c = table(s, d, "claims").where("concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("a"), F.explode("page_edges").alias("relation", "to")).select("relation", "a", F.explode("to").alias("t")).where("t IS NOT NULL")
    return c.select("relation", "a", spelling_key(F.regexp_extract("t", r"([^/]+)$", 1)).alias("b")).where("a <> '' AND b <> ''").distinct()


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return graph.undirected(concept_links(s, d))


def graph_edges(s, d):
    """All edges of the knowledge graph by relation, counted."""
    c = table(s, d, "claims").where("claim_id IS NOT NULL")
    claim = c.where("concept IS NOT NULL").select(F.lit("has_claim").alias("relation"), spelling_key(F.col("concept")).alias("a"), F.col("claim_id").alias("b"))
    supported = c.select(F.lit("supported_by").alias("relation"), F.col("claim_id").alias("a"), F.explode(F.transform("source_ids", source_key)).alias("b"))
    derived = table(s, d, "registry").where("id IS NOT NULL AND derived_from IS NOT NULL").select(F.lit("derived_from").alias("relation"), F.col("id").alias("a"), F.col("derived_from").alias("b"))
    page = c.where("concept IS NOT NULL").select(spelling_key(F.col("concept")).alias("a"), F.explode("page_edges").alias("relation", "to")).select("relation", "a", F.explode("to").alias("t")).select("relation", "a", spelling_key(F.regexp_extract("t", r"([^/]+)$", 1)).alias("b"))
    e = claim.unionByName(supported).unionByName(derived).unionByName(page).where("b IS NOT NULL").distinct()
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("a").alias("n_from"), F.count_distinct("b").alias("n_to"))


def degree_audit(s, d):
    return graph.degrees(concept_links(s, d))


def hub_outliers(s, d):
    return graph.hubs(graph.degrees(concept_sources(s, d).select(F.col("owner").alias("a"), F.col("item").alias("b"))))


def lineage_roots(s, d):
    r = table(s, d, "registry").where("id IS NOT NULL").select("id", F.col("derived_from").alias("parent"))
    return graph.roots(r)


def independent_origins(s, d):
    """How many origins stand behind the sources of a concept."""
    root = lineage_roots(s, d).select(F.col("id").alias("item"), "root")
    c = concept_sources(s, d).join(root, "item", "left").select("owner", "item", F.coalesce("root", "item").alias("root"))
    return c.groupBy("owner").agg(F.count_distinct("item").alias("n_sources"), F.count_distinct("root").alias("n_origins"))


def blast_radius(s, d):
    """What depends on sources that were deleted: derived sources, claims citing them, their concepts, by least distance."""
    reg = table(s, d, "registry")
    derived = reg.where("derived_from IS NOT NULL AND id IS NOT NULL").select(F.col("derived_from").alias("a"), F.col("id").alias("b"))
    c = table(s, d, "claims").where("claim_id IS NOT NULL")
    cited = c.select(F.explode(F.transform("source_ids", source_key)).alias("a"), F.col("claim_id").alias("b")).where("a IS NOT NULL")
    page = c.where("concept IS NOT NULL").select(F.col("claim_id").alias("a"), spelling_key(F.col("concept")).alias("b"))
    start = reg.where(folded(F.col("source_status")) == "deleted-from-origin").select(F.col("id").alias("node"))
    return graph.reach(derived.unionByName(cited).unionByName(page), start)


def concept_traverse(s, d):
    """Concept pages within two ``supports`` or ``updates`` links, in either direction, of the three shortest names that hold a word."""
    e = page_links(s, d)
    names = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("name"))
    return graph.traverse(e, names, "benchmark", 2, ("supports", "updates"))


def concept_projection(s, d):
    """Weighted concept pairs: one per directed link and one per shared source."""
    link = concept_links(s, d).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1.0).alias("w"))
    shared = graph.shared_neighbours(concept_sources(s, d)).select("a", "b", F.col("shared").cast("double").alias("w"))
    return link.unionByName(shared).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def cocitation_pmi(s, d):
    return graph.pointwise_information(concept_sources(s, d)).where("shared >= 2")


def source_jaccard(s, d):
    return graph.jaccard(concept_sources(s, d), 0.1)


def triadic_closure(s, d):
    return graph.open_triads(_pairs(s, d), 2)


def conceptual_gravity(s, d):
    """Unlinked concepts two or three links apart."""
    return graph.gravity(_pairs(s, d), 0.5)


def spreading_activation(s, d):
    """What the twenty concepts with most links leave on concepts they are not linked with."""
    return graph.seeded_activation(concept_links(s, d))


def missing_backlinks(s, d):
    return graph.one_way_links(concept_links(s, d))


def link_candidates(s, d):
    """Unlinked concept pairs with two signals or more out of co-citation, overlap and activation; only signals that fire count."""
    co = cocitation_pmi(s, d).where("shared >= 2 AND pmi >= 0.5").select("a", "b", (0.4 * F.col("shared") + 0.3 * F.greatest(F.lit(0.0), "pmi")).alias("co"))
    jac = source_jaccard(s, d).where("jaccard >= 0.15")
    act = spreading_activation(s, d).groupBy(F.least("seed", "node").alias("a"), F.greatest("seed", "node").alias("b")).agg(F.max("activation").alias("activation")).where("activation >= 0.05")
    both = co.join(jac, ["a", "b"], "full").join(act, ["a", "b"], "full").join(_pairs(s, d), ["a", "b"], "left_anti")
    signals = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("co", "jaccard", "activation")), F.lit(0))
    score = F.coalesce("co", F.lit(0.0)) + 5 * F.coalesce("jaccard", F.lit(0.0)) + 2 * F.coalesce("activation", F.lit(0.0))
    return both.select("a", "b", signals.alias("n_signals"), F.round(score, 10).alias("score")).where("n_signals >= 2")


def link_components(s, d):
    return components(concept_links(s, d).select(F.col("a"), F.col("b")), "a", "b")


def concept_communities(s, d):
    return graph.communities(concept_projection(s, d))


def community_modularity(s, d):
    """Modularity of the projection with the communities found in it."""
    p = checkpoint(concept_projection(s, d))
    return graph.modularity(p, graph.communities(p))


def project_modularity(s, d):
    """Modularity of the projection with project names (first words) as communities."""
    p = concept_projection(s, d)
    nodes = p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.modularity(p, nodes.select("node", F.substring_index("node", " ", 1).alias("community")))


def project_report(s, d):
    """Projects as communities of the links between concept pages: inner and outer links, bridges, fragile ones."""
    p = _pairs(s, d)
    nodes = p.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return graph.community_report(p, nodes.select("node", F.substring_index("node", " ", 1).alias("community")))


def link_betweenness(s, d):
    return graph.betweenness(_pairs(s, d))


def link_eigenvector(s, d):
    return graph.eigenvector(_pairs(s, d))


def single_source_concepts(s, d):
    """Concepts all of whose citations go to one source."""
    return concept_sources(s, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item")).where("n = 1").select("owner", "item")


def contradiction_groups(s, d):
    """Concepts with contested claims that cite a source in common: how many claims, per concept and source (no pairs are listed)."""
    c = table(s, d, "claims").where("status = 'contested' AND concept IS NOT NULL AND claim_id IS NOT NULL").select("claim_id", spelling_key(F.col("concept")).alias("concept"), F.explode(F.transform("source_ids", source_key)).alias("source_id")).where("source_id IS NOT NULL")
    return c.groupBy("concept", "source_id").agg(F.count_distinct("claim_id").alias("n_claims"), F.min("claim_id").alias("first")).where("n_claims > 1")


def claim_source_states(s, d):
    """Claims by the worst state of the sources they cite."""
    reg = quality.latest(table(s, d, "registry").select("id", "loaded_at", "source_status"), "id", "loaded_at").select(F.col("id").alias("item"), folded(F.col("source_status")).alias("status"))
    c = table(s, d, "claims").where("claim_id IS NOT NULL").select("claim_id", F.explode_outer(F.transform("source_ids", source_key)).alias("item")).distinct()
    state = F.when(F.col("item").isNull(), 0).when(F.col("status").isNull(), 1).when(F.col("status").isin(*FLAGGED), 3).otherwise(2)
    worst = c.join(reg, "item", "left").groupBy("claim_id").agg(F.max(F.when(state == 3, 3).when(state == 1, 2).when(state == 2, 1).otherwise(0)).alias("w"))
    name = F.element_at(F.array(*map(F.lit, ("unsupported", "registered", "unknown", "flagged"))), F.col("w") + 1)
    return worst.groupBy(name.alias("state")).agg(F.count(F.lit(1)).alias("n_claims"))


QUERIES = {f.__name__: f for f in (graph_edges, degree_audit, hub_outliers, lineage_roots, independent_origins, blast_radius, concept_traverse, concept_projection, cocitation_pmi, source_jaccard, triadic_closure, conceptual_gravity, spreading_activation, missing_backlinks, link_candidates, link_components, concept_communities, community_modularity, project_modularity, project_report, link_betweenness, link_eigenvector, single_source_concepts, contradiction_groups, claim_source_states)}

_KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
_SRC = "nullif('src-' || regexp_extract(lower({0}), '(?:^|[^0-9a-z])([0-9a-f]{{10}})(?:$|[^0-9a-z])', 1), 'src-')"
_BASE = f"""
WITH RECURSIVE cs AS (SELECT DISTINCT owner, item FROM (SELECT {_KEY.format('concept')} AS owner, {_SRC.format('u')} AS item FROM (SELECT concept, unnest(source_ids) AS u FROM claims WHERE concept IS NOT NULL)) WHERE item IS NOT NULL),
cl AS (SELECT DISTINCT a, {_KEY.format("regexp_extract(t, '([^/]+)$', 1)")} AS b FROM (SELECT {_KEY.format('concept')} AS a, unnest(flatten(map_values(page_edges))) AS t FROM claims WHERE concept IS NOT NULL) WHERE t IS NOT NULL),
links AS (SELECT * FROM cl WHERE a <> '' AND b <> ''),
pairs AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM links WHERE a <> b),
two AS (SELECT a AS node, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
deg AS (SELECT node, count(*) AS d FROM two GROUP BY node),
size AS (SELECT owner, count(*) AS n FROM cs GROUP BY owner),
sh AS (SELECT x.owner AS a, y.owner AS b, count(*) AS shared FROM cs x JOIN cs y ON x.item = y.item AND x.owner < y.owner GROUP BY ALL),
pmi AS (SELECT a, b, shared, round(log2(shared * (SELECT count(DISTINCT item) FROM cs) / (x.n * y.n)), 3) AS pmi FROM sh JOIN size x ON x.owner = a JOIN size y ON y.owner = b WHERE shared >= 2),
jac AS (SELECT * FROM (SELECT a, b, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM sh JOIN size x ON x.owner = a JOIN size y ON y.owner = b) WHERE jaccard >= 0.1),
wedge AS (SELECT x.node AS a, y.node AS b, count(*) AS wedges FROM two x JOIN two y ON x.other = y.other AND x.node < y.node GROUP BY ALL),
tri AS (SELECT wedge.* FROM wedge ANTI JOIN pairs USING (a, b) WHERE wedges >= 2),
proj AS (SELECT a, b, sum(w) AS weight FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, 1.0::DOUBLE AS w FROM links WHERE a <> b UNION ALL SELECT a, b, shared::DOUBLE FROM sh) GROUP BY ALL)
"""
_ACT = """, e AS (SELECT DISTINCT a, b FROM links WHERE a <> b), od AS (SELECT a AS node, count(*) AS d FROM e GROUP BY a), seeds AS (SELECT node AS seed FROM od ORDER BY d DESC, node LIMIT 20),
m0 AS (SELECT seed, seed AS node, 1.0::DOUBLE AS m FROM seeds),
m1 AS (SELECT seed, node, sum(m) AS m FROM (SELECT * FROM m0 UNION ALL SELECT seed, e.b, m * 0.5 / d FROM m0 JOIN od USING (node) JOIN e ON e.a = node) GROUP BY ALL),
m2 AS (SELECT seed, node, sum(m) AS m FROM (SELECT * FROM m1 UNION ALL SELECT seed, e.b, m * 0.5 / d FROM m1 JOIN od USING (node) JOIN e ON e.a = node) GROUP BY ALL),
m3 AS (SELECT seed, node, sum(m) AS m FROM (SELECT * FROM m2 UNION ALL SELECT seed, e.b, m * 0.5 / d FROM m2 JOIN od USING (node) JOIN e ON e.a = node) GROUP BY ALL),
act AS (SELECT * FROM m3 WHERE seed <> node AND NOT EXISTS (SELECT 1 FROM two WHERE two.node = m3.seed AND two.other = m3.node))
"""
_PARENT = """WITH RECURSIVE p AS (SELECT id, min(derived_from) FILTER (WHERE derived_from <> id) AS parent FROM registry WHERE id IS NOT NULL GROUP BY id),
nodes AS (SELECT id FROM p UNION SELECT parent FROM p WHERE parent IS NOT NULL),
walk AS (SELECT id, id AS tip, 0 AS depth, [id] AS path, false AS cyclic FROM nodes UNION ALL SELECT walk.id, p.parent, depth + 1, list_append(path, p.parent), list_contains(path, p.parent) FROM walk JOIN p ON p.id = walk.tip WHERE p.parent IS NOT NULL AND NOT cyclic),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS r FROM walk),
roots AS (SELECT id, CASE WHEN cyclic THEN list_min(list_slice(path, list_position(path, tip), len(path))) ELSE tip END AS root, CASE WHEN cyclic THEN -1 ELSE depth END::BIGINT AS depth, cyclic FROM last WHERE r = 1)
"""
_REACH = """, reach(node, depth) AS (SELECT node, 0 FROM start UNION SELECT e.b, depth + 1 FROM reach JOIN e ON e.a = reach.node WHERE depth < {0})
SELECT node, min(depth)::INTEGER AS depth FROM reach GROUP BY node"""
_LATEST = "(SELECT id AS item, lower(trim(source_status)) AS status FROM registry WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, source_status DESC NULLS LAST) = 1)"

SQL = {
    "graph_edges": f"""WITH e AS (SELECT DISTINCT relation, a, b FROM (
SELECT 'has_claim' AS relation, {_KEY.format('concept')} AS a, claim_id AS b FROM claims WHERE claim_id IS NOT NULL AND concept IS NOT NULL
UNION ALL SELECT 'supported_by', claim_id, {_SRC.format('u')} FROM (SELECT claim_id, unnest(source_ids) AS u FROM claims WHERE claim_id IS NOT NULL)
UNION ALL SELECT 'derived_from', id, derived_from FROM registry WHERE id IS NOT NULL
UNION ALL SELECT relation, a, {_KEY.format("regexp_extract(t, '([^/]+)$', 1)")} FROM (SELECT a, x.key AS relation, unnest(x.value) AS t FROM (SELECT {_KEY.format('concept')} AS a, unnest(map_entries(page_edges)) AS x FROM claims WHERE claim_id IS NOT NULL AND concept IS NOT NULL))) WHERE b IS NOT NULL)
SELECT relation, count(*) AS n_edges, count(DISTINCT a) AS n_from, count(DISTINCT b) AS n_to FROM e GROUP BY relation""",
    "degree_audit": _BASE + "SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT a AS node, 1 AS o, 0 AS i FROM links UNION ALL SELECT b, 0, 1 FROM links) GROUP BY node",
    "hub_outliers": _BASE + ", g AS (SELECT node, count(*) AS degree FROM (SELECT owner AS node FROM cs UNION ALL SELECT item FROM cs) GROUP BY node) SELECT node, degree FROM g WHERE (SELECT count(*) FROM g) >= 5 AND degree > (SELECT avg(degree) + 2.5 * stddev_pop(degree) FROM g)",
    "lineage_roots": _PARENT + "SELECT * FROM roots",
    "independent_origins": _PARENT + f", cs AS (SELECT DISTINCT owner, item FROM (SELECT {_KEY.format('concept')} AS owner, {_SRC.format('u')} AS item FROM (SELECT concept, unnest(source_ids) AS u FROM claims WHERE concept IS NOT NULL)) WHERE item IS NOT NULL) SELECT owner, count(DISTINCT item) AS n_sources, count(DISTINCT coalesce(root, item)) AS n_origins FROM cs LEFT JOIN roots ON roots.id = item GROUP BY owner",
    "blast_radius": f"""WITH RECURSIVE e AS (SELECT derived_from AS a, id AS b FROM registry WHERE id IS NOT NULL AND derived_from IS NOT NULL UNION SELECT {_SRC.format('u')}, claim_id FROM (SELECT claim_id, unnest(source_ids) AS u FROM claims WHERE claim_id IS NOT NULL) WHERE {_SRC.format('u')} IS NOT NULL UNION SELECT claim_id, {_KEY.format('concept')} FROM claims WHERE claim_id IS NOT NULL AND concept IS NOT NULL),
start AS (SELECT DISTINCT id AS node FROM registry WHERE lower(trim(source_status)) = 'deleted-from-origin' AND id IS NOT NULL)""" + _REACH.format(24),
    "concept_traverse": f"""WITH RECURSIVE pl AS (SELECT DISTINCT relation, a, {_KEY.format("regexp_extract(t, '([^/]+)$', 1)")} AS b FROM (SELECT a, x.key AS relation, unnest(x.value) AS t FROM (SELECT {_KEY.format('concept')} AS a, unnest(map_entries(page_edges)) AS x FROM claims WHERE concept IS NOT NULL)) WHERE t IS NOT NULL),
k AS (SELECT * FROM pl WHERE a <> '' AND b <> ''), e AS (SELECT a, b FROM k WHERE relation IN ('supports', 'updates') UNION SELECT b, a FROM k WHERE relation IN ('supports', 'updates')),
start AS (SELECT node FROM (SELECT a AS node FROM k UNION SELECT b FROM k) WHERE contains(node, 'benchmark') ORDER BY length(node), node LIMIT 3)""" + _REACH.format(2),
    "concept_projection": _BASE + "SELECT * FROM proj",
    "cocitation_pmi": _BASE + "SELECT * FROM pmi",
    "source_jaccard": _BASE + "SELECT * FROM jac",
    "triadic_closure": _BASE + "SELECT * FROM tri",
    "conceptual_gravity": _BASE + """, d2 AS (SELECT a, b FROM wedge ANTI JOIN pairs USING (a, b)), d2b AS (SELECT a AS node, b AS other FROM d2 UNION ALL SELECT b, a FROM d2),
d3 AS (SELECT DISTINCT x.node AS a, y.other AS b FROM d2b x JOIN two y ON x.other = y.node WHERE x.node < y.other),
far AS (SELECT a, b, 4.0::DOUBLE AS q FROM d2 UNION ALL SELECT a, b, 9.0::DOUBLE FROM (SELECT * FROM d3 ANTI JOIN pairs USING (a, b)) t ANTI JOIN d2 USING (a, b))
SELECT a, b, x.d * y.d / q AS gravity FROM far JOIN deg x ON x.node = a JOIN deg y ON y.node = b WHERE x.d * y.d / q >= 0.5""",
    "spreading_activation": _BASE + _ACT + "SELECT seed, node, round(m, 12) AS activation FROM act",
    "missing_backlinks": _BASE + "SELECT l.a, l.b FROM links l WHERE l.a <> l.b AND NOT EXISTS (SELECT 1 FROM links r WHERE r.a = l.b AND r.b = l.a)",
    "link_candidates": _BASE + _ACT + """SELECT a, b, n AS n_signals, round(score, 10) AS score FROM (
SELECT a, b, (co IS NOT NULL)::INTEGER + (jaccard IS NOT NULL)::INTEGER + (activation IS NOT NULL)::INTEGER AS n, coalesce(co, 0) + 5 * coalesce(jaccard, 0) + 2 * coalesce(activation, 0) AS score
FROM (SELECT a, b, 0.4::DOUBLE * shared + 0.3::DOUBLE * greatest(0, pmi) AS co FROM pmi WHERE pmi >= 0.5) FULL JOIN (SELECT * FROM jac WHERE jaccard >= 0.15) USING (a, b)
FULL JOIN (SELECT * FROM (SELECT least(seed, node) AS a, greatest(seed, node) AS b, max(round(m, 12)) AS activation FROM act GROUP BY ALL) WHERE activation >= 0.05) USING (a, b)) t ANTI JOIN pairs USING (a, b) WHERE n >= 2""",
    "link_components": _BASE + ", r(a, b) AS (SELECT node, other FROM two UNION SELECT r.a, two.other FROM r JOIN two ON two.node = r.b) SELECT a AS node, least(a, min(b)) AS label FROM r GROUP BY a",
    "project_modularity": _BASE + ", w AS (SELECT split_part(a, ' ', 1) AS ca, split_part(b, ' ', 1) AS cb, weight FROM proj), m AS (SELECT sum(weight) AS m FROM w), c AS (SELECT c, sum(i) AS i, sum(d) AS d FROM (SELECT ca AS c, CASE WHEN ca = cb THEN weight ELSE 0 END AS i, weight AS d FROM w UNION ALL SELECT cb, 0, weight FROM w) GROUP BY c) SELECT round(sum(i / m - pow(d / (2 * m), 2)), 4) AS modularity FROM c, m",
    "project_report": _BASE + """, l AS (SELECT split_part(a, ' ', 1) AS ca, split_part(b, ' ', 1) AS cb, a, b FROM pairs), ends AS (SELECT a AS node, ca AS c, ca = cb AS i FROM l UNION ALL SELECT b, cb, ca = cb FROM l)
SELECT c AS community, count(DISTINCT node) AS n_nodes, count(*) FILTER (WHERE i) // 2 AS n_inner, count(*) FILTER (WHERE NOT i) AS n_outer, count(DISTINCT node) FILTER (WHERE NOT i) AS n_bridges, count(DISTINCT node) > 1 AND count(*) FILTER (WHERE i) // 2 < count(DISTINCT node) AS fragile FROM ends GROUP BY c""",
    "link_betweenness": _BASE + """, d(s, t, k) AS (SELECT node, node, 0 FROM deg UNION SELECT s, other, k + 1 FROM d JOIN two ON two.node = t WHERE k < 12), dist AS (SELECT s, t, min(k) AS k FROM d GROUP BY ALL),
n(s, t, k, p) AS (SELECT node, node, 0, 1.0::DOUBLE FROM deg UNION ALL SELECT s, t, any_value(k), sum(p) FROM (SELECT n.s, two.other AS t, n.k + 1 AS k, n.p FROM n JOIN two ON two.node = n.t JOIN dist ON dist.s = n.s AND dist.t = two.other AND dist.k = n.k + 1) GROUP BY s, t)
SELECT deg.node, round(coalesce(sum(x), 0) / 2, 4) AS betweenness FROM deg LEFT JOIN (SELECT u.t AS node, u.p * v.p / w.p AS x FROM n u JOIN n v ON u.t = v.s JOIN n w ON w.s = u.s AND w.t = v.t AND w.k = u.k + v.k WHERE u.k > 0 AND v.k > 0) b USING (node) GROUP BY deg.node""",
    "single_source_concepts": _BASE + "SELECT owner, min(item) AS item FROM cs GROUP BY owner HAVING count(*) = 1",
    "contradiction_groups": f"SELECT concept, source_id, count(DISTINCT claim_id) AS n_claims, min(claim_id) AS first FROM (SELECT claim_id, concept, {_SRC.format('u')} AS source_id FROM (SELECT claim_id, {_KEY.format('concept')} AS concept, unnest(source_ids) AS u FROM claims WHERE status = 'contested' AND concept IS NOT NULL AND claim_id IS NOT NULL)) WHERE source_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT claim_id) > 1",
    "claim_source_states": f"WITH c AS (SELECT DISTINCT claim_id, {_SRC.format('u')} AS item FROM (SELECT claim_id, unnest(CASE WHEN len(coalesce(source_ids, [])) = 0 THEN [NULL] ELSE source_ids END) AS u FROM claims WHERE claim_id IS NOT NULL)), w AS (SELECT claim_id, max(CASE WHEN c.item IS NULL THEN 0 WHEN status IS NULL THEN 2 WHEN status IN ('permission-revoked', 'deleted-from-origin', 'do-not-use', 'revoked') THEN 3 ELSE 1 END) AS w FROM c LEFT JOIN {_LATEST} r ON r.item = c.item GROUP BY claim_id) SELECT ['unsupported', 'registered', 'unknown', 'flagged'][w + 1] AS state, count(*) AS n_claims FROM w GROUP BY ALL",
}
