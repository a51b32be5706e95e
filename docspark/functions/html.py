"""HTML to node arrays, one per page, and column helpers on them.

The parser is the standard library's and runs per page inside
``mapInArrow``; everything built on the nodes is a column expression.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..pyship import ship

# Elements without content, and clutter removed before reading.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
        "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"}
CLUTTER = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe"}
#: Elements rendered from their own text, whose inner nodes are not walked.
OPAQUE = {"pre", "tr"}
_CJK = re.compile("[一-龥]")
#: Pages that are parsed at a time: at most so many, and no more once they have so many bytes.
PARSED_PAGES, PARSED_BYTES = 64, 256 * 1024

NODE_TYPE = (
    "array<struct<node_id: int, parent_id: int, end_id: int, depth: int, tag: string, attrs: map<string,string>, "
    "text: string, removed: boolean, opaque_id: int, text_len: int, cjk: int, p_children: int, flat: string>>"
)  # flat: own text of cells, titles and pre; the finished line of table rows
_ARROW = pa.list_(pa.struct([
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("end_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("removed", pa.bool_()), ("opaque_id", pa.int32()),
    ("text_len", pa.int32()), ("cjk", pa.int32()), ("p_children", pa.int32()), ("flat", pa.string()),
]))


class _Nodes(HTMLParser):
    """Elements and texts in document order; end tags close back to their start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.buffer = [], [], []

    def _add(self, tag, attrs=(), text=None):
        up = self.stack[-1] if self.stack else None
        opaque = None
        if up is not None:
            opaque = up["node_id"] if up["tag"] in OPAQUE else up["opaque_id"]
        node = {
            "node_id": len(self.out), "parent_id": up["node_id"] if up else None, "end_id": len(self.out),
            "depth": len(self.stack), "tag": tag, "attrs": list(dict((k, v or "") for k, v in attrs).items()), "text": text,
            "removed": tag in CLUTTER or bool(up and up["removed"]), "opaque_id": opaque,
            "text_len": 0, "cjk": 0, "p_children": 0, "flat": None,
        }
        self.out.append(node)
        return node

    def _flush(self):
        text, self.buffer = "".join(self.buffer), []
        if text:
            self._add("#text", text=text)

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_starttag(self, tag, attrs):
        self._flush()
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        self._flush()
        if any(n["tag"] == tag for n in self.stack):
            while self.stack.pop()["tag"] != tag:
                pass

    def finish(self):
        self.close()
        self._flush()
        nodes = self.out
        pieces = {n["node_id"]: [] for n in nodes if n["tag"] in ("td", "th", "pre", "title")}
        # children come after their parents, so one backward pass sums subtrees
        for n in reversed(nodes):
            up = nodes[n["parent_id"]] if n["parent_id"] is not None else None
            if n["tag"] == "#text" and not n["removed"]:
                bare = n["text"].strip()
                n["text_len"], n["cjk"] = len(bare), len(_CJK.findall(bare))
            if up is None:
                continue
            up["end_id"] = max(up["end_id"], n["end_id"])
            if not n["removed"]:
                up["text_len"] += n["text_len"]
                up["cjk"] += n["cjk"]
                up["p_children"] += n["tag"] == "p"
        if pieces:
            for n in nodes:
                if n["tag"] == "#text" and not n["removed"]:
                    up = n["parent_id"]
                    while up is not None:
                        if up in pieces:
                            pieces[up].append(n["text"])
                        up = nodes[up]["parent_id"]
            for i, texts in pieces.items():
                raw = nodes[i]["tag"] == "pre"
                nodes[i]["flat"] = "".join(t if raw else t.strip() for t in texts)
        rows = {n["node_id"]: [] for n in nodes if n["tag"] == "tr"}
        for n in nodes:
            if n["tag"] in ("td", "th") and n["parent_id"] in rows and not n["removed"]:
                rows[n["parent_id"]].append(n["flat"])
        for i, cells in rows.items():
            nodes[i]["flat"] = f"| {' | '.join(cells)} |"
        return nodes


def parse_nodes(html: str | None) -> list[dict]:
    parser = _Nodes()
    parser.feed(html or "")
    return parser.finish()


def with_nodes(df: DataFrame, html: str, out: str = "nodes") -> DataFrame:
    """Adds the node array of each page; all other columns pass through."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T._parse_datatype_string(NODE_TYPE))])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(html))
            # a few pages of bounded size are made Python objects, parsed and passed on at a time, however long the batch is
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and end - at < PARSED_PAGES and (end == at or size < PARSED_BYTES):
                    size += len(texts[end].as_buffer()) if texts[end].is_valid else 0
                    end += 1
                part = batch.slice(at, end - at)
                nodes = pa.array([parse_nodes(t.as_py()) for t in texts[at:end]], type=_ARROW)
                yield pa.RecordBatch.from_arrays(list(part.columns) + [nodes], names=list(part.schema.names) + [out])
                del part, nodes
                at = end

    return df.mapInArrow(run, schema)


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


# Basic named entities.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def decode_entities(c: Column) -> Column:
    """Basic named entities; the ampersand comes last."""
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


ship(sys.modules[__name__])
