"""Where documents go: JSON files, an index, one HTML page, listings."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F

from flowloom.operators.documents import pretty

_PAGE = """<!doctype html>
<meta charset="utf-8"><title>__TOOL__</title>
<style>body{font:14px sans-serif;display:flex}nav{width:18em}pre{white-space:pre-wrap}</style>
<nav id="list"></nav><main><pre id="doc"></pre></main>
<script>
const flows = __FLOWS__, index = __INDEX__, list = document.getElementById("list");
for (const f of flows) {
  const a = document.createElement("a"); a.href = "#"; a.textContent = f.label; a.style.display = "block";
  a.onclick = () => { document.getElementById("doc").textContent = JSON.stringify(f.doc, null, 2); return false };
  list.append(a);
}
</script>
"""


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents (flow_id, doc) as a table of JSON lines, one for each flow, by Spark's writer."""
    documents.select("doc").write.text(path)


def write_files(documents: DataFrame, folder: str, limit: int = 100_000) -> list[str]:
    """Documents (file, doc) as indented files in a local folder of the driver; a program has few enough entrypoints for that."""
    rows = documents.select("file", "doc").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} documents: write_documents writes any number")
    os.makedirs(folder, exist_ok=True)
    for r in rows:
        with open(os.path.join(folder, r.file), "w", encoding="utf-8") as file:
            file.write(pretty(r.doc))
    return [r.file for r in rows]


def write_index(index: DataFrame, folder: str) -> str:
    """The index document (one row) as ``index.json`` beside the documents; its JSON."""
    doc = index.select(F.to_json(F.struct(*index.columns)).alias("doc")).first().doc
    with open(os.path.join(folder, "index.json"), "w", encoding="utf-8") as file:
        file.write(pretty(doc))
    return doc


def html_page(flows: list[tuple[str, str]], index: str | None, tool: str = "flowloom") -> str:
    """One page for documents (label, JSON) and the index; data cannot end the script."""
    if not flows:
        raise ValueError("no flows to show")
    data = json.dumps([{"label": label, "doc": json.loads(doc)} for label, doc in flows]).replace("<", "\\u003c")
    return _PAGE.replace("__TOOL__", tool).replace("__INDEX__", (index or "null").replace("<", "\\u003c")).replace("__FLOWS__", data)


def listing(entrypoints: DataFrame) -> DataFrame:
    """One line for each entrypoint: id, function, position."""
    return entrypoints.orderBy("id").select(F.concat_ws("\t", "id", "func", "pos").alias("line"))
