"""The few vectorised UDFs: entity decoding, NFKC and deep JSON-LD.

They take small strings cut out by JVM expressions, never whole pages, except for
text that has to be entity-decoded as a whole.
"""

from __future__ import annotations

import html
import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


_STRINGS = T.ArrayType(T.StringType())
JSONLD_SCHEMA = T.StructType(
    [
        T.StructField("emails", _STRINGS),
        T.StructField("same_as", _STRINGS),
        T.StructField("organization_names", _STRINGS),
        T.StructField("site_names", _STRINGS),
        T.StructField("types", _STRINGS),
        T.StructField("org_name", T.StringType()),
        T.StructField("legal_name", T.StringType()),
        T.StructField("org_count", T.IntegerType()),
        T.StructField("urls", _STRINGS),
    ]
)
_ORG = {"Organization", "Corporation", "LocalBusiness", "Brand"}
_PARTS = ("@graph", "publisher", "author", "brand", "mainEntity")
_ANY_ORG = {
    "organization", "corporation", "localbusiness", "onlinestore", "store", "brand", "website", "ngo",
    "educationalorganization", "sportsorganization",
}


def _types(node) -> list[str]:
    t = node.get("@type")
    return [x for x in ([t] if isinstance(t, str) else t if isinstance(t, list) else []) if isinstance(x, str)]


def _text(value) -> str | None:
    return value.strip() if isinstance(value, str) and value.strip() else None


def _everything(root):
    """Every object below a parsed block, parents first, in document order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def _site_objects(root):
    """Objects reachable through the parts that describe the page's owner."""
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, dict):
            yield node
            stack.extend(node[k] for k in reversed(_PARTS) if k in node)


def _facts(blocks) -> dict:
    out = {"emails": set(), "same_as": [], "organization_names": [], "site_names": [], "types": [], "urls": []}
    names, legal, count = [], [], 0
    for block in blocks if blocks is not None else []:
        try:
            root = json.loads(block.strip())
        except (ValueError, TypeError, RecursionError):
            continue
        for node in _everything(root):
            for key, value in node.items():
                low = str(key).lower()
                if low == "email" and isinstance(value, str):
                    out["emails"].add(value.replace("mailto:", "").strip())
                elif low == "sameas":
                    links = value if isinstance(value, list) else [value]
                    out["same_as"] += [v for v in links if isinstance(v, str)]
            if any(t.lower() in _ANY_ORG for t in _types(node)):
                count += 1
                names += [node["name"]] if isinstance(node.get("name"), str) and node["name"] else []
                legal += [node["legalName"]] if isinstance(node.get("legalName"), str) and node["legalName"] else []
        for node in _site_objects(root):
            kinds = set(_types(node))
            out["types"] += [t.strip() for t in _types(node) if t.strip()]
            for bucket, wanted in (("organization_names", _ORG), ("site_names", {"WebSite"})):
                if kinds & wanted:
                    out[bucket] += [n for n in [_text(node.get("name"))] if n]
                    out["urls"] += [u for u in [_text(node.get("url"))] if u]
    return {
        **out,
        "emails": sorted(out["emails"]),
        "org_name": names[0] if names else None,
        "legal_name": legal[0] if legal else None,
        "org_count": count,
    }


@F.pandas_udf(JSONLD_SCHEMA)
def jsonld_facts(blocks: pd.Series) -> pd.DataFrame:
    """Facts of all JSON-LD blocks of a page, at any depth; broken blocks are ignored."""
    rows = [_facts(b) for b in blocks]
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in JSONLD_SCHEMA.names})
