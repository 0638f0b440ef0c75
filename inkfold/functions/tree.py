"""Small per-page helpers for HTML that needs tag matching; used from Arrow UDFs only."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkfold.functions.html import MAIN_CLASS_TERMS

TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>", re.S)
TOKEN = re.compile(r"<[^>]*>|[^<]+")
TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
NO_END = re.compile(r"^<(?:!|(?:img|br|hr|meta|link|input|source|wbr)\b)|/>\Z", re.I | re.A)
CLASS = re.compile(r"\sclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "ul", "ol", "div"}
CLOSED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CUT_TAGS = {"p", "div", "blockquote"}


def element_end(tags: list, i: int, text: str) -> tuple[int, int]:
    """Inner end and outer end of the element opened by ``tags[i]``, matching nested tags of its name."""
    name, depth = tags[i].group(2).lower(), 0
    for k in range(i, len(tags)):
        t = tags[k]
        if (t.group(2) or "").lower() != name or t.group(0).endswith("/>"):
            continue
        depth += -1 if t.group(1) else 1
        if depth == 0:
            return t.start(), t.end()
    end = enclosing_end(tags, i, text)
    return end, end


def enclosing_end(tags: list, i: int, text: str) -> int:
    """Where an element that is never closed ends: where an element around it is closed, else at the text's end."""
    around: Counter = Counter()
    for k in range(i):
        around[(tags[k].group(2) or "").lower()] += -1 if tags[k].group(1) else 1
    inside: Counter = Counter()
    for k in range(i + 1, len(tags)):
        name = (tags[k].group(2) or "").lower()
        if not tags[k].group(1):
            inside[name] += 1
        elif inside[name] > 0:
            inside[name] -= 1
        elif name and around[name] > 0:
            return tags[k].start()
    return len(text)


def main_fragment(page: str) -> str | None:
    """Inside of the outermost article, else of the first element whose class names main content."""
    tags = list(TAG.finditer(page))
    opens = [(i, t) for i, t in enumerate(tags) if t.group(2) and not t.group(1)]

    def marked(tag: str) -> bool:
        m = CLASS.search(tag)
        value = next((g for g in m.groups() if g), "").lower() if m else ""
        return any(term in value for term in MAIN_CLASS_TERMS)

    pick = next((i for i, t in opens if t.group(2).lower() == "article"), None)
    if pick is None:
        pick = next((i for i, t in opens if marked(t.group(0))), None)
    if pick is None:
        return None
    return page[tags[pick].end():element_end(tags, pick, page)[0]]


def outer_blocks(text: str) -> list[tuple[str, str, str]]:
    """(tag, open tag, source) of every outermost block element, in document order."""
    tags = [t for t in TAG.finditer(text) if (t.group(2) or "").lower() in BLOCKS]
    out, i = [], 0
    while i < len(tags):
        t = tags[i]
        if t.group(1):
            i += 1
            continue
        name = t.group(2).lower()
        if name in CLOSED_BY_BLOCK:
            nxt = tags[i + 1] if i + 1 < len(tags) else None
            closed = nxt is not None and nxt.group(1) and nxt.group(2).lower() == name
            end = (nxt.end() if closed else nxt.start()) if nxt is not None else len(text)
        else:
            end = element_end(tags, i, text)[1]
        out.append((name, t.group(0), text[t.start():end]))
        while i < len(tags) and tags[i].start() < end:
            i += 1
    return out


def visible_words(fragment: str) -> list[str]:
    return re.sub(r"<!--.*?-->|<[^>]*>", " ", fragment, flags=re.S).split()


def budget_blocks(text: str, limit: int) -> str:
    """Whole blocks while the word budget lasts; the first that does not fit is cut if it may be."""
    text = re.sub(r"<(script|style)\b[^>]*>.*?</\1\s*>", "", text, flags=re.I | re.S)
    blocks = outer_blocks(text)
    if not blocks:
        plain = re.sub(r"<!--.*?-->|<[^>]*>", " ", text, flags=re.S)
        parts = [p.strip() for p in re.split(r"\n\s*\n", plain)]
        blocks = [("p", "<p>", f"<p>{p}</p>") for p in parts if p]
    used, out = 0, []
    for name, opening, source in blocks:
        words = visible_words(source)
        if used + len(words) <= limit:
            used += len(words)
            out.append(source)
            continue
        if name in CUT_TAGS and limit > used:
            out.append(f"{opening}{' '.join(words[:limit - used])}...</{name}>")
        break
    return "".join(block + "\n\n" for block in out)


def truncate_words(text: str, limit: int) -> str:
    """Text nodes up to ``limit`` words, the tags before that point and the ends of what is open there.

    An end tag closes the innermost open element if that has its name, and else nothing.
    """
    out, opened, used = [], [], 0
    for token in TOKEN.findall(text):
        if used >= limit and not opened:
            break
        if not token.startswith("<"):
            if used < limit:
                found = token.split()
                fits = used + len(found) <= limit
                out.append(token if fits else " ".join(found[:limit - used]))
                used = used + len(found) if fits else limit
            continue
        name = TAG_NAME.match(token)
        name = name.group(1).lower() if name else ""
        if token.startswith("</") and opened and opened[-1] == name:
            opened.pop()
        elif used >= limit:
            continue
        elif name and not token.startswith("</") and not NO_END.search(token):
            opened.append(name)
        out.append(token)
    return "".join([*out, *[f"</{name}>" for name in reversed(opened)]])


def main_fragment_udf(page: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_fragment, na_action="ignore")

    return run(page)


def budget_blocks_udf(text: Column, limit: int) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: budget_blocks(t, limit), na_action="ignore")

    return run(text)


def truncate_words_udf(text: Column, limit: int) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: truncate_words(t, limit), na_action="ignore")

    return run(text)
