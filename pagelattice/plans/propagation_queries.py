"""Queries on the global URL graph, reference vectors, feature rows, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators import domains, propagation, refmatch
from pagelattice.plans.common import DECORATED_SQL, URL_SQL, decorated_pages, table
from pagelattice.tables import cut


def _urls(spark, sf_dir):
    return decorated_pages(spark, sf_dir).select("url", "page_id")


def _dns(spark, sf_dir):
    from pagelattice.functions.urls import page_domain, registered_domain

    domain = registered_domain(page_domain(F.col("url")))
    return _urls(spark, sf_dir).select(domain.alias("domain")).distinct().select("domain", F.concat(F.lit("10.0."), F.expr("length(domain) % 4"), F.lit("."), F.expr("ascii(domain) % 8")).alias("ip"))


def _graph(spark, sf_dir):
    return propagation.url_graph(_urls(spark, sf_dir), cut(_dns(spark, sf_dir), "dns"))  # vertices and edges each read them


def _labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("label"))
    return _urls(spark, sf_dir).join(labels, "page_id").select(F.col("url").alias("id"), "label")


def _with_similarity(edges):
    """Edges with a similarity that is a plain expression of the ends."""
    return edges.withColumn("sim", F.expr("(length(src) * 7 + length(dst) * 3) % 100 / 100.0D"))


#: Rules as a rule file has them, and names under them.
SUFFIX_RULES = ("com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "example.org", "net")
NAME_TAILS = ("Example.com", "shop.co.uk:8080", "b.kawasaki.jp", "city.kawasaki.jp", "x.ck.", "www.ck", "ck", "10.1.2.3", "a.example.org", "unknown.zone", "kawasaki.jp", "co.uk")
_NAME = "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('u', user_id, '.') END"


def registered_domains(spark, sf_dir):
    """Names of the event table's users under all kinds of suffixes."""
    tail = F.element_at(F.array(*map(F.lit, NAME_TAILS)), (F.col("event_id") % len(NAME_TAILS) + 1).cast("int"))
    names = table(spark, sf_dir, "events").select(F.concat(F.expr(_NAME), tail).alias("name"))
    return domains.registered_domains(names, domains.suffix_rules(spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")))


def url_graph_vertices(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


def url_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


def extend_graph(spark, sf_dir):
    half = _urls(spark, sf_dir).where("url like 'https:%'")
    return propagation.extend_graph(propagation.url_graph(half), _urls(spark, sf_dir))[1]


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def edge_similarity(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    edges = vectors.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 7)).alias("dst"))
    rbf = propagation.edge_similarity(edges, vectors, "rbf").select("src", "dst", F.round("sim", 6).alias("rbf"))
    return rbf.join(propagation.edge_similarity(edges, vectors, "cos").select("src", "dst", F.round("sim", 6).alias("cos")), ["src", "dst"])


def init_beliefs(spark, sf_dir):
    found = propagation.init_beliefs(_graph(spark, sf_dir)[0], _labels(spark, sf_dir))
    return found.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("unknown")))


def _prepared(spark, sf_dir):
    """Weighted edges and beliefs, each written once: a sweep reads them several times."""
    vertices, edges = _graph(spark, sf_dir)
    return cut(_with_similarity(edges), "edges"), cut(propagation.init_beliefs(vertices, _labels(spark, sf_dir)), "beliefs")


def bp_one_step(spark, sf_dir):
    edges, beliefs = _prepared(spark, sf_dir)
    stepped = propagation.bp_step(cut(propagation.initial_messages(edges, beliefs), "messages"), beliefs)
    return stepped.select("src", "dst", F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"))


def bpe_score(spark, sf_dir):
    edges, beliefs = _prepared(spark, sf_dir)
    return propagation.bp_score(propagation.bp_run(edges, beliefs, sweeps=1)).select("id", F.round("score", 5).alias("score"))


def bp_run(spark, sf_dir):
    edges, beliefs = _prepared(spark, sf_dir)
    return propagation.bp_run(edges, beliefs).select("id", F.round("cost0", 5).alias("cost0"), F.round("cost1", 5).alias("cost1"), "map_label")


def bp_run_in_order(spark, sf_dir):
    edges, beliefs = _prepared(spark, sf_dir)
    found = cut(propagation.bp_run_in_order(edges, beliefs), "ordered")  # costs grow with every pass over a cycle: shares of them are compared
    return propagation.bp_score(found).join(found, "id").select("id", F.round("score", 6).alias("score"), "map_label")


def url_graph_colours(spark, sf_dir):
    return propagation.colours(_graph(spark, sf_dir)[1])


def lbp_run(spark, sf_dir):
    edges, beliefs = _prepared(spark, sf_dir)
    return propagation.lbp_score(propagation.lbp_run(edges, beliefs)).select("id", F.round("score", 5).alias("score"))


def _items(spark, sf_dir):
    brand = F.concat(F.lit("brand"), "label")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), brand.alias("brand"), F.expr("CASE WHEN vec_id % 4 = 0 THEN 'phish' ELSE 'benign' END").alias("label"))


def reference_list(spark, sf_dir):
    return refmatch.reference_list(_items(spark, sf_dir)).select("brand", F.array_join("members", " ").alias("members"), "n")


def reference_embeddings(spark, sf_dir):
    found = refmatch.reference_embeddings(_items(spark, sf_dir))
    total = F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return found.select("brand", F.size("vectors").alias("vectors"), F.round(total, 3).alias("total"))


def contrastive_loss(spark, sf_dir):
    items = _items(spark, sf_dir)
    pairs = items.select(F.col("key").alias("a"), "brand").join(items.select((F.col("key") - 1).alias("a"), F.col("key").alias("b"), F.col("brand").alias("other")), "a").select("a", "b", (F.col("brand") != F.col("other")).cast("int").alias("y"))
    return refmatch.contrastive_loss(pairs, items).select("pairs", F.round("loss", 6).alias("loss"))


def contrastive_pairs(spark, sf_dir):
    return refmatch.contrastive_pairs(_items(spark, sf_dir), 400)


def crp_pairs(spark, sf_dir):
    sites = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("url"), F.expr("CASE quality WHEN 0 THEN 'phish' ELSE 'benign' END").alias("label"), F.expr("CASE WHEN doc_id % 3 = 0 THEN toxic = 1 END").alias("crp_found"))
    return refmatch.crp_pairs(sites)


# --- feature rows, models, streams: no SQL form


def feature_row(spark, sf_dir):
    from pagelattice.operators.features import feature_row as build

    return build(decorated_pages(spark, sf_dir))


#: Share of the labelled pages that ``model_scores`` scores and does not train on.
HELD_OUT = 0.2


def _training_rows(spark, sf_dir):
    """page_id, label and the 101 features of labelled pages; a fit reads them many times."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("CASE quality WHEN 0 THEN 'phish' ELSE 'benign' END").alias("label"))
    return cut(feature_row(spark, sf_dir).join(labels.hint("merge"), "page_id"), "training")


def model_scores(spark, sf_dir):
    """Held-out pages, a fifth of all, scored by trees that have not seen them."""
    from pagelattice.operators import models
    from pagelattice.operators.evaluate import train_val_split

    rows = cut(train_val_split(_training_rows(spark, sf_dir), "page_id", HELD_OUT), "parts")
    model = models.fit(rows.where("part = 'train'"), "gbt")
    return models.predict(model, rows.where("part = 'val'").drop("part")).select("page_id", "label", "score", "prediction")


def queue_outcomes(spark, sf_dir):
    from pagelattice.streaming.queue import queue_outcomes as outcomes

    return outcomes(spark, sf_dir)


def cert_stream(spark, sf_dir):
    from pagelattice.streaming.detect import stream_candidates

    return stream_candidates(spark, sf_dir)


_FEATURES = f"WITH {DECORATED_SQL}, {URL_SQL}"
_REG = r"regexp_extract(regexp_replace(lower(domain), ':\d*$', ''), '([^.]+\.[^.]+)$', 1)"
_PIECES = r"list_transform(list_filter(regexp_split_to_array(concat_ws('?', path, nullif(query, '')), '[/\-_.?&=]'), lambda t: length(t) >= 4)[1:5], lambda t: concat('substr:', lower(t)))"
_LINKS = f"""{_FEATURES}, dom AS (SELECT DISTINCT url, {_REG} AS domain, {_PIECES} AS pieces FROM named),
links AS (SELECT url AS u, 'url' AS ut, domain AS v, 'domain' AS vt FROM dom UNION SELECT url, 'url', unnest(pieces), 'substring' FROM dom),
dns AS (SELECT DISTINCT domain AS u, 'domain' AS ut, concat('10.0.', length(domain) % 4, '.', ascii(domain) % 8) AS v, 'ip' AS vt FROM dom),
all_links AS (SELECT * FROM links UNION SELECT * FROM dns),
vertices AS (SELECT id, min(t) AS node_type FROM (SELECT u AS id, ut AS t FROM all_links UNION ALL SELECT v, vt FROM all_links) GROUP BY id),
edges AS (SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM all_links),
labs AS (SELECT url AS id, min(CAST(quality = 0 AS INT)) AS label FROM decorated JOIN labels ON page_id = doc_id GROUP BY url),
beliefs AS (SELECT v.id, l.label, CASE l.label WHEN 1 THEN 0.99 WHEN 0 THEN 0.01 ELSE 0.5 END::DOUBLE AS c0, CASE l.label WHEN 1 THEN 0.01 WHEN 0 THEN 0.99 ELSE 0.5 END::DOUBLE AS c1 FROM vertices v LEFT JOIN labs l USING (id)),
ways AS (SELECT src, dst, ((length(src) * 7 + length(dst) * 3) % 100 / 100.0)::DOUBLE AS sim FROM edges),
sent AS (SELECT src, dst, sim FROM ways UNION ALL SELECT dst, src, sim FROM ways),
msg AS (SELECT s.src, s.dst, s.sim, a.label AS sl, a.c0, a.c1, CASE WHEN a.label = 1 THEN 1.0 ELSE 0 END::DOUBLE AS m0, CASE WHEN a.label = 0 THEN 1.0 ELSE 0 END::DOUBLE AS m1
  FROM sent s JOIN beliefs a ON s.src = a.id JOIN beliefs b ON s.dst = b.id WHERE b.label IS NULL),
sums AS (SELECT dst AS id, sum(m0) AS s0, sum(m1) AS s1 FROM msg GROUP BY dst),
held AS (SELECT m.*, m.c0 + coalesce(s0, 0) - coalesce(b.m0, 0) AS h0, m.c1 + coalesce(s1, 0) - coalesce(b.m1, 0) AS h1
  FROM msg m LEFT JOIN sums ON sums.id = m.src LEFT JOIN msg b ON b.src = m.dst AND b.dst = m.src),
stepped AS (SELECT src, dst, CASE WHEN sl IS NOT NULL THEN m0 ELSE least(h0 + least(0.7, 1 - sim), h1 + greatest(0.7, sim)) END AS m0,
  CASE WHEN sl IS NOT NULL THEN m1 ELSE least(h0 + greatest(0.7, sim), h1 + least(0.7, 1 - sim)) END AS m1 FROM held)"""
_ITEMS = "items AS (SELECT vec_id AS key, embedding AS vector, concat('brand', label) AS brand, CASE WHEN vec_id % 4 = 0 THEN 'phish' ELSE 'benign' END AS label FROM embeddings)"
_GAP = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

ORACLE = {
    "url_graph_vertices": f"{_LINKS} SELECT id, node_type FROM vertices",
    "url_graph_edges": f"{_LINKS} SELECT src, dst FROM edges",
    "extend_graph": f"{_LINKS} SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM links",
    "edge_similarity": f"""WITH e AS (SELECT vec_id AS src, unnest([vec_id + 1, vec_id + 7]) AS dst, embedding AS a FROM embeddings)
        SELECT src, dst, round(coalesce(exp(-{_GAP.format('a', 'embedding')} / 2), 0.5), 6) AS rbf,
          round(coalesce({_DOT.format('a', 'embedding')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('embedding', 'embedding')})), CASE WHEN embedding IS NULL THEN 0.5 ELSE 0 END), 6) AS cos
        FROM e LEFT JOIN embeddings ON vec_id = dst""",
    "init_beliefs": f"{_LINKS} SELECT id, coalesce(CAST(label AS VARCHAR), 'unknown') AS label, c0, c1 FROM beliefs",
    "bp_one_step": f"{_LINKS} SELECT src, dst, round(m0, 6) AS m0, round(m1, 6) AS m1 FROM stepped",
    "bpe_score": f"""{_LINKS}, after AS (SELECT dst AS id, sum(m0) AS s0, sum(m1) AS s1 FROM stepped GROUP BY dst),
        costs AS (SELECT id, c0 + coalesce(s0, 0) AS k0, c1 + coalesce(s1, 0) AS k1 FROM beliefs LEFT JOIN after USING (id))
        SELECT id, round(CASE WHEN k0 + k1 > 0 THEN 1 - k1 / (k0 + k1) ELSE 0.5 END, 5) AS score FROM costs""",
    "reference_list": f"WITH {_ITEMS} SELECT brand, string_agg(key, ' ' ORDER BY key) AS members, count(*) AS n FROM items WHERE label = 'benign' GROUP BY brand",
    "reference_embeddings": f"WITH {_ITEMS} SELECT brand, count(*) AS vectors, round(sum(list_sum(list_transform(vector, lambda x: x::DOUBLE))), 3) AS total FROM items GROUP BY brand",
    "contrastive_loss": f"""WITH {_ITEMS}, p AS (SELECT sqrt({_GAP.format('a.vector', 'b.vector')}) AS d, CAST(a.brand <> b.brand AS INT) AS y FROM items a JOIN items b ON b.key = a.key + 1)
        SELECT count(*) AS pairs, round(avg((1 - y) * d * d / 2 + y * greatest(0, 1 - d) * greatest(0, 1 - d) / 2), 6) AS loss FROM p""",
    "crp_pairs": "SELECT CAST(doc_id AS VARCHAR) AS url, CAST(coalesce(CASE WHEN doc_id % 3 = 0 THEN toxic = 1 END, quality = 0) AS INT) AS y FROM labels",
}


def _sweep(k: int, fixed: bool, same: str, other: str, tol: float | None = None) -> str:
    """SQL of the messages m<k> after one more sweep over m<k - 1>. ``fixed``: labelled senders' messages stay, else they
    send their prior; with ``tol`` a sweep after one that moved no message by as much changes nothing."""
    new = "least(h{0} + {1}, h{2} + {3})"
    m0, m1 = new.format(0, same, 1, other), f"least(h0 + {other}, h1 + {same})"
    held = [f"m.c{n} + coalesce(s.s{n}, 0) - coalesce(b.m{n}, 0)" for n in (0, 1)]
    if fixed:
        m0, m1, moved = f"CASE WHEN sl IS NOT NULL THEN m0 ELSE {m0} END", f"CASE WHEN sl IS NOT NULL THEN m1 ELSE {m1} END", "true"
    else:
        held = [f"m.c{n} + CASE WHEN m.sl IS NULL THEN coalesce(s.s{n}, 0) - coalesce(b.m{n}, 0) ELSE 0 END" for n in (0, 1)]
        m0, m1 = f"round({m0}, 10)", f"round({m1}, 10)"
        moved = f"greatest(abs({m0} - m0), abs({m1} - m1)) >= {tol}"
        m0, m1 = f"CASE WHEN go THEN {m0} ELSE m0 END", f"CASE WHEN go THEN {m1} ELSE m1 END"
    return f"""
    s{k} AS MATERIALIZED (SELECT dst AS id, sum(m0) AS s0, sum(m1) AS s1 FROM m{k - 1} GROUP BY dst),
    m{k} AS MATERIALIZED (SELECT src, dst, sim, sl, c0, c1, {m0} AS m0, {m1} AS m1, go AND {moved} AS moved FROM (
      SELECT m.*, {held[0]} AS h0, {held[1]} AS h1, (SELECT bool_or(moved) FROM m{k - 1}) AS go
      FROM m{k - 1} m LEFT JOIN s{k} s ON s.id = m.src LEFT JOIN m{k - 1} b ON b.src = m.dst AND b.dst = m.src))"""


_BP = f"{_LINKS}, m0 AS MATERIALIZED (SELECT src, dst, sim, sl, c0, c1, m0, m1, true AS moved FROM msg), " + ", ".join(_sweep(k, True, "least(0.7, 1 - sim)", "greatest(0.7, sim)") for k in range(1, 6))
_LBP = f"""{_LINKS}, prior AS (SELECT id, label, CASE label WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE 0.5 END::DOUBLE AS c0, CASE label WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 0.5 END::DOUBLE AS c1 FROM beliefs),
    m0 AS MATERIALIZED (SELECT m.src, m.dst, m.sim, m.sl, p.c0, p.c1, 0::DOUBLE AS m0, 0::DOUBLE AS m1, true AS moved FROM msg m JOIN prior p ON p.id = m.src), """ + ", ".join(_sweep(k, False, "least(0.6, 1 - sim)", "greatest(1.0, sim)", 0.001) for k in range(1, 7))
_COSTS = "costs AS (SELECT id, round(c0 + coalesce(s0, 0), 9) AS k0, round(c1 + coalesce(s1, 0), 9) AS k1 FROM {0} LEFT JOIN (SELECT dst AS id, sum(m0) AS s0, sum(m1) AS s1 FROM {1} GROUP BY dst) USING (id))"

_RULE_ROWS = ", ".join(f"('{r.removeprefix('!').removeprefix('*.')}', {1 if r.startswith('*') else 2 if r.startswith('!') else 0})" for r in SUFFIX_RULES)
ORACLE["registered_domains"] = rf"""WITH rules(suffix, kind) AS (VALUES {_RULE_ROWS}),
    names AS (SELECT DISTINCT concat({_NAME}, [{", ".join(f"'{t}'" for t in NAME_TAILS)}][CAST(event_id % {len(NAME_TAILS)} + 1 AS INT)]) AS name FROM events),
    labels AS (SELECT name, regexp_replace(regexp_replace(lower(name), ':\d*$', ''), '\.+$', '') AS p FROM names),
    split AS (SELECT *, string_split(p, '.') AS l, len(string_split(p, '.')) AS n FROM labels),
    tails AS (SELECT name, n, k, array_to_string(l[n - k + 1:], '.') AS suffix FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM split)),
    found AS (SELECT name, coalesce(max(CASE WHEN kind = 2 THEN k - 1 END), max(CASE WHEN kind = 0 THEN k WHEN kind = 1 AND n > k THEN k + 1 END), 1) AS k FROM tails LEFT JOIN rules USING (suffix) GROUP BY name)
    SELECT name, CASE WHEN NOT regexp_matches(p, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN array_to_string(l[greatest(n - k + 1, 1):], '.') END AS suffix,
      CASE WHEN regexp_matches(p, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') THEN p ELSE array_to_string(l[greatest(n - k, 1):], '.') END AS domain FROM split JOIN found USING (name)"""


def _coloured(links: str, name: str, rounds: int = 40) -> str:
    """SQL of a greedy colouring of ``links`` (src, dst in both directions): each round colours the nodes whose neighbours before them have colours."""
    out = [f"""{name}_rank AS MATERIALIZED (SELECT src AS id, row_number() OVER (ORDER BY count(*) DESC, md5(src), src) AS r FROM {links} GROUP BY src),
    {name}_way AS MATERIALIZED (SELECT l.dst AS id, l.src AS before FROM {links} l JOIN {name}_rank a ON a.id = l.src JOIN {name}_rank b ON b.id = l.dst WHERE a.r < b.r),
    {name}_0 AS MATERIALIZED (SELECT id, CAST(NULL AS BIGINT) AS colour FROM {name}_rank)"""]
    for k in range(1, rounds + 1):
        out.append(f"""{name}_{k} AS MATERIALIZED (SELECT c.id, CASE WHEN c.colour IS NOT NULL THEN c.colour WHEN coalesce(u.ready, true)
      THEN list_min(list_filter(range(len(coalesce(u.used, [])) + 1), lambda x: NOT list_contains(coalesce(u.used, []), x))) END AS colour FROM {name}_{k - 1} c LEFT JOIN (
      SELECT w.id, bool_and(b.colour IS NOT NULL) AS ready, list(DISTINCT b.colour) AS used FROM {name}_way w JOIN {name}_{k - 1} b ON b.id = w.before GROUP BY w.id) u ON u.id = c.id)""")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT id, CAST(colour AS INT) AS colour FROM {name}_{rounds})"])


def _step(k: int, colour: int) -> str:
    """SQL of the messages after the nodes of one colour have sent."""
    held = [f"m.c{n} + coalesce(s.s{n}, 0) - coalesce(b.m{n}, 0)" for n in (0, 1)]
    new = [f"least({held[0]} + {x}, {held[1]} + {y})" for x, y in (("least(0.7, 1 - m.sim)", "greatest(0.7, m.sim)"), ("greatest(0.7, m.sim)", "least(0.7, 1 - m.sim)"))]
    pick = [f"CASE WHEN m.sl IS NULL AND m.colour = {colour} THEN {new[n]} ELSE m.m{n} END AS m{n}" for n in (0, 1)]
    return f"""o{k} AS MATERIALIZED (SELECT m.src, m.dst, m.sim, m.sl, m.c0, m.c1, m.colour, {pick[0]}, {pick[1]} FROM o{k - 1} m
      LEFT JOIN (SELECT dst AS id, sum(m0) AS s0, sum(m1) AS s1 FROM o{k - 1} GROUP BY dst) s ON s.id = m.src LEFT JOIN o{k - 1} b ON b.src = m.dst AND b.dst = m.src)"""


#: Colours that the SQL makes steps for; the test graphs have fewer.
_COLOURS = 6
ORACLE["url_graph_colours"] = f"{_LINKS}, both_links AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), {_coloured('both_links', 'shade')} SELECT id, colour FROM shade"
_ORDERED = f"{_LINKS}, free AS (SELECT src, dst FROM msg WHERE sl IS NULL), {_coloured('free', 'shade')}, o0 AS MATERIALIZED (SELECT m.*, colour FROM msg m LEFT JOIN shade ON shade.id = m.src), " + ", ".join(_step(k + 1, k % _COLOURS) for k in range(5 * _COLOURS))
ORACLE["bp_run_in_order"] = f"{_ORDERED}, {_COSTS.format('beliefs', f'o{5 * _COLOURS}')} SELECT id, round(CASE WHEN k0 + k1 > 0 THEN 1 - k1 / (k0 + k1) ELSE 0.5 END, 6) AS score, CAST(k1 < k0 AS INT) AS map_label FROM costs"
ORACLE["bp_run"] = f"{_BP}, {_COSTS.format('beliefs', 'm5')} SELECT id, round(k0, 5) AS cost0, round(k1, 5) AS cost1, CAST(k1 < k0 AS INT) AS map_label FROM costs"
ORACLE["lbp_run"] = f"{_LBP}, {_COSTS.format('prior', 'm6')} SELECT id, round(CASE WHEN k0 + k1 > 0 THEN 1 - k1 / (k0 + k1) ELSE 0.5 END, 5) AS score FROM costs"
_DRAW = "CAST(concat('0x', substring(md5(concat_ws(':', 42, '{0}', slot)), 1, 8)) AS BIGINT)"
ORACLE["contrastive_pairs"] = f"""WITH {_ITEMS}, ranks AS (SELECT key, dense_rank() OVER (ORDER BY brand) - 1 AS b, row_number() OVER (PARTITION BY brand ORDER BY key) - 1 AS r FROM items),
    sizes AS (SELECT b, count(*) AS n FROM ranks GROUP BY b), brands AS (SELECT count(*) AS n FROM sizes), half AS (SELECT least(400, 2000, 50 * n) // 2 AS half FROM brands),
    slots AS (SELECT unnest(range(2 * half)) AS slot, half FROM half),
    drawn AS (SELECT slot, CAST(slot >= half AS INT) AS y, {_DRAW.format("a")} % n AS ab, ({_DRAW.format("a")} % n + 1 + {_DRAW.format("b")} % greatest(1, n - 1)) % n AS other FROM slots, brands),
    sided AS (SELECT slot, y, ab, CASE WHEN y = 0 THEN ab ELSE other END AS bb FROM drawn),
    placed AS (SELECT slot, y, ab, bb, {_DRAW.format("x")} % sa.n AS ar,
      CASE WHEN y = 1 THEN {_DRAW.format("w")} % sb.n WHEN sa.n > 1 THEN ({_DRAW.format("x")} % sa.n + 1 + {_DRAW.format("z")} % greatest(sa.n - 1, 1)) % sa.n ELSE 0 END AS br
      FROM sided JOIN sizes sa ON sa.b = ab JOIN sizes sb ON sb.b = bb)
    SELECT slot, p.key AS a, q.key AS b, y FROM placed JOIN ranks p ON p.b = ab AND p.r = ar JOIN ranks q ON q.b = bb AND q.r = br"""
ORACLE["cert_stream"] = "SELECT DISTINCT concat('u', user_id, '.test') AS domain, concat('https://u', user_id, '.test/') AS url FROM events WHERE event_type <> 'click'"
ORACLE["queue_outcomes"] = """WITH RECURSIVE seen AS (SELECT concat('u', user_id, '-', event_id % 7, '.test') AS domain, CAST(ts AS TIMESTAMP) AS ts, CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 3600) AS BIGINT) AS tick FROM events),
    firsts AS (SELECT domain, min(ts) AS ts, min(tick) AS tick FROM seen GROUP BY domain),
    ranked AS (SELECT domain, tick, row_number() OVER (PARTITION BY tick ORDER BY ts, domain) - 1 AS r FROM firsts),
    span AS (SELECT min(tick) AS t0, max(tick) AS t1 FROM seen), came AS (SELECT tick, count(*) AS n FROM firsts GROUP BY tick),
    hours AS (SELECT h.tick, coalesce(n, 0) AS n FROM (SELECT unnest(range(t0, t1 + 1)) AS tick FROM span) h LEFT JOIN came USING (tick)),
    sim AS (SELECT tick, 0::BIGINT AS took, least(n, 10) AS entered, least(n, 10) AS size, 0::BIGINT AS took_before, 0::BIGINT AS entered_before FROM hours, span WHERE tick = t0
      UNION ALL SELECT h.tick, least(s.size, 2), least(h.n, 10 - (s.size - least(s.size, 2))), s.size - least(s.size, 2) + least(h.n, 10 - (s.size - least(s.size, 2))), s.took_before + s.took, s.entered_before + s.entered
      FROM sim s JOIN hours h ON h.tick = s.tick + 1)
    SELECT domain, 'dropped' AS status, tick, CAST(NULL AS BIGINT) AS taken_tick FROM ranked JOIN sim USING (tick) WHERE r >= entered
    UNION ALL SELECT domain, 'taken', k.tick, t.tick FROM ranked k JOIN sim s ON s.tick = k.tick AND k.r < s.entered JOIN sim t ON s.entered_before + k.r >= t.took_before AND s.entered_before + k.r < t.took_before + t.took"""
QUERIES = {n: globals()[n] for n in (*ORACLE, "feature_row", "model_scores")}
