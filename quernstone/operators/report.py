"""The graph as a self-contained page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Rows of a page: it is for reading, so it shows the nodes with the most claims.
NODES = 2000

# Fill colors by type.
COLORS = {"concept": "#4e79a7", "method": "#f28e2b", "person": "#e15759", "organization": "#76b7b2", "dataset": "#59a14f", "metric": "#edc948", "unknown": "#9c9c9c"}

# Line colors by relation.
RELATION_COLORS = {"improves_upon": "#2f7d4f", "is_variant_of": "#8e6bbf", "uses": "#7f9fbf", "contradicts": "#cc0000", "evaluates_on": "#b8860b", "related": "#bbbbbb"}


def payload(tables: dict[str, DataFrame], limit: int = NODES) -> dict:
    conflicts = graph.view_conflicts(tables["contradictions"])
    nodes = graph.view_nodes(tables["entities"], tables["claims"], conflicts.select(F.col("existing_claim_entity").alias("e1"), F.col("new_claim_entity").alias("e2")))
    shown = nodes.orderBy(F.desc("claim_count"), "name").limit(limit)
    links = graph.view_links(tables["relationships"], shown)
    as_dicts = lambda df: [r.asDict() for r in df.collect()]
    return {"nodes": as_dicts(shown), "links": as_dicts(links.limit(limit * 5)), "contradictions": as_dicts(conflicts.orderBy("con_seq").limit(limit)), "counts": {"nodes": nodes.count(), "links": links.count(), "contradictions": conflicts.count()}}


def page(tables: dict[str, DataFrame], limit: int = NODES) -> str:
    """HTML with the data inside, escaped so that no text of the graph can end the script or become markup."""
    data = json.dumps(payload(tables, limit) | {"colors": COLORS, "relations": RELATION_COLORS}).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return _PAGE.replace("__DATA__", data)


_PAGE = """<!doctype html>
<html lang="en"><meta charset="utf-8"><title>Belief graph</title>
<style>body{font:14px sans-serif;margin:0;display:flex;height:100vh}svg{flex:1}aside{width:340px;overflow:auto;padding:8px;border-left:1px solid #ccc}text{font-size:10px;pointer-events:none}#legend{list-style:none;padding:0;columns:2}#legend b{display:inline-block;width:12px;height:12px;margin-right:6px}#legend .line{height:3px;vertical-align:middle}</style>
<svg id="view"></svg><aside><p id="counts"></p><ul id="legend"></ul><ol id="conflicts"></ol></aside>
<script>
const data = __DATA__, ns = "http://www.w3.org/2000/svg", view = document.getElementById("view");
const place = new Map(), n = data.nodes.length, size = 40 * Math.sqrt(n + 1);
data.nodes.forEach((d, i) => { const r = 20 * Math.sqrt(i), a = i * 2.39996; place.set(d.name, [size + r * Math.cos(a), size + r * Math.sin(a)]); });
view.setAttribute("viewBox", `0 0 ${2 * size} ${2 * size}`);
const put = (tag, attrs, text) => { const e = document.createElementNS(ns, tag); for (const k in attrs) e.setAttribute(k, attrs[k]); if (text !== undefined) e.textContent = text; view.append(e); return e; };
for (const l of data.links) { const [a, b] = [place.get(l.source), place.get(l.target)]; if (a && b) put("line", {x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: data.relations[l.relation] || data.relations.related, "stroke-width": l.width}); }
for (const d of data.nodes) { const [x, y] = place.get(d.name); const c = put("circle", {cx: x, cy: y, r: d.radius, fill: data.colors[d.type] || data.colors.unknown, opacity: d.opacity}); const t = document.createElementNS(ns, "title"); t.textContent = `${d.name} (${d.type}): ${d.claim_count} claims, ${d.conflict_count} contradictions`; c.append(t); put("text", {x: x + d.radius, y}, d.label); }
document.getElementById("counts").textContent = `${data.counts.nodes} entities, ${data.counts.links} links, ${data.counts.contradictions} contradictions`;
for (const [colors, kind] of [[data.colors, ""], [data.relations, "line"]]) for (const k in colors) { const li = document.createElement("li"), b = document.createElement("b"); b.className = kind; b.style.background = colors[k]; li.append(b, k); document.getElementById("legend").append(li); }
for (const c of data.contradictions) { const li = document.createElement("li"); li.textContent = `${c.relation}: [${c.existing_claim_source}] ${c.existing_claim_text} / [${c.new_claim_source}] ${c.new_claim_text}`; document.getElementById("conflicts").append(li); }
</script></html>
"""
