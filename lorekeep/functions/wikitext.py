"""Wikitext to clean pages: citations, templates, infoboxes, quotes, pointers, sections.

The parser is a scanner over nested braces; style apostrophes are never parsed, only removed, as
names full of apostrophes would unbalance them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Templates shown as their text.
SHOWN = "ia iarabic arabic lang nowrap small big transl".split()
#: Templates that go.
DROPPED = [
    "editorial box", "section", "notes", "references", "reflist", "end", "cb",
    "col-begin", "col-break", "col-end", "colbegin", "colend", "year nav",
    "calendar", "today/ad/ah", "about", "otheruses", "disambiguation", "dab",
    "navbox", "portal", "commons", "commonscat", "stub", "clear", "-", "!!",
    "toc", "tocright", "tocleft", "center", "sisterlinks", "shiaislam",
    "authority control", "hijri", "ahref", "enote", "efn", "sfn",
]
#: Templates that point to other pages, and those that hold quotations.
POINTERS = ["main", "see also", "seealso", "further", "fulltext", "main article"]
QUOTES = ["quote box", "quotebox", "pull quote", "pullquote", "centered pull quote", "quote", "cquote", "blockquote", "poem quote"]
FORMAT_TAGS = "onlyinclude|noinclude|includeonly|small|big|br|center|div|span|sup|sub|u|s|b|i|font|nowiki|poem|blockquote|p"
LONG_PARAMETER = 40
INFOBOX = re.compile(r"infobox\b|جعبه", re.I)
BRACES = re.compile(r"\{\{|\}\}")


def templates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, inside) of the outermost {{...}}; unbalanced braces are left alone."""
    depth, begin = 0, 0
    for m in BRACES.finditer(text):
        if m[0] == "{{":
            if not depth:
                begin = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                yield begin, m.end(), text[begin + 2 : m.start()]


def parameters(inside: str) -> tuple[str, list[tuple[str | None, str]]]:
    """A template's name and its parameters (name or None, value); bars in nested braces and links do not count."""
    parts, level, last = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", inside):
        if m[0] == "|":
            if not level:
                parts.append(inside[last : m.start()])
                last = m.end()
        else:
            level += 1 if m[0] in ("{{", "[[") else -1
    parts.append(inside[last:])
    out = []
    for p in parts[1:]:
        k, eq, v = p.partition("=")
        out.append((k.strip(), v.strip()) if eq and not re.search(r"\[\[|\{\{", k) else (None, p.strip()))
    return " ".join(parts[0].replace("_", " ").split()).lower(), out


def strip_links(text: str) -> str:
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", text)
    return re.sub(r"'{2,5}", "", text)


class Collected:
    """What a page's templates give besides text."""

    def __init__(self) -> None:
        self.infobox: dict[str, str] = {}
        self.pointers: set[str] = set()


def inline(text: str) -> str:
    """A value as plain text."""
    return strip_links(resolved(re.sub(r"(?is)<ref[^>/]*/>|<ref.*?</ref>|<[^>]+>", "", text), None)).strip()


def quoted(params: list[tuple[str | None, str]]) -> str:
    named = _named(params)
    body = next((named[k] for k in ("quote", "text", "1") if named.get(k)), "")
    source = next((named[k] for k in ("source", "author", "cite", "2") if named.get(k)), "")
    if not body:
        return ""
    title = f"{inline(named['title'])}: " if named.get("title") else ""
    return f'{title}"{inline(body)}"' + (f" — {inline(source)}" if source else "")


def _named(params: list[tuple[str | None, str]]) -> dict[str, str]:
    named, n = {}, 0
    for k, v in params:
        if k is None:
            n += 1
            k = str(n)
        named[k.lower()] = v
    return named


def read_infobox(params: list[tuple[str | None, str]], into: dict[str, str]) -> None:
    """Named fields with a value; a field's first value wins, also over several boxes."""
    for k, v in params:
        if k and not k.isdigit() and (value := inline(v)) not in ("", "-", "?"):
            into.setdefault(k.replace("_", " ").title(), value)


def resolved(text: str, got: Collected | None) -> str:
    """text with every outermost template replaced by what it stands for."""
    out, last = [], 0
    for begin, end, inside in templates(text):
        out.append(text[last:begin])
        last = end
        name, params = parameters(inside)
        if INFOBOX.match(name):
            if got is not None:
                read_infobox(params, got.infobox)
        elif name in QUOTES:
            out.append(f"\n{quoted(params)}\n")
        elif name in POINTERS:
            if got is not None:
                got.pointers |= {inline(v) for k, v in params if k is None and v}
        elif name in SHOWN:
            out.append(inline(params[-1][1]) if params else "")
        elif name not in DROPPED and not name.startswith("#"):
            longest = max((inline(v) for _, v in params), key=len, default="")
            if len(longest) > LONG_PARAMETER:
                out.append(longest)
    out.append(text[last:])
    return "".join(out)


def citations(text: str) -> tuple[str, list[str]]:
    found = [" ".join(strip_links(re.sub(r"<[^>]+>", "", m)).split()) for m in re.findall(r"(?is)<ref(?:\s[^>/]*)?>(.*?)</ref>", text)]
    return re.sub(r"(?is)<ref[^>]*/>|<ref(?:\s[^>/]*)?>.*?</ref>", "", text), [c for c in found if c]


def body_text(text: str, got: Collected | None) -> str:
    text = re.sub(r"(?s)<!--.*?-->", "", text)
    text = re.sub(r"(?is)<gallery.*?</gallery>", "", text)
    text = resolved(text, got)
    text = re.sub(r"(?ms)^\{\|.*?^\|\}", "", text)
    text = re.sub(r"(?i)\[\[\s*(?:file|image|media)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", "", text)
    text = re.sub(r"(?i)\[\[category:[^\[\]]*\]\]", "", text)
    text = re.sub(rf"(?i)</?(?:{FORMAT_TAGS})\b[^>]*>", "", text)
    text = strip_links(text)
    text = re.sub(r"(?m)^[*#:;]+[ \t]*", "- ", text)
    text = re.sub(r"(?m)^- *$\n?", "", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def sections(text: str) -> tuple[str, list[tuple[list[str], int, str]]]:
    """(lead, [(path of headings, level, body)]) with the stack of headings above each."""
    heads = list(re.finditer(r"(?m)^(={2,6})\s*(.+?)\s*\1\s*$", text))
    lead = text[: heads[0].start()] if heads else text
    out, stack = [], []
    for i, h in enumerate(heads):
        level = len(h[1])
        stack = [x for x in stack if x[0] < level] + [(level, strip_links(h[2]).strip())]
        end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        out.append(([n for _, n in stack], level, text[h.end() : end]))
    return lead, out


def clean_page(wikitext: str) -> dict:
    from lorekeep.operators.chunking import SKIPPED_SECTIONS

    text, cited = citations(wikitext or "")
    got = Collected()
    lead, parts = sections(text)
    summary, kept = body_text(lead, got), []
    for path, level, body in parts:
        clean = body_text(body, got)
        if clean and not any(p.strip().lower() in SKIPPED_SECTIONS for p in path):
            kept.append({"path": path, "level": level, "text": clean})
    return {"summary": summary, "sections": kept, "infobox": [{"k": k, "v": v} for k, v in got.infobox.items()], "pointers": sorted(got.pointers), "citations": cited}


CLEAN_SCHEMA = "page_id long, ns int, title string, url string, categories array<string>, summary string, sections array<struct<path:array<string>,level:int,text:string>>, infobox array<struct<k:string,v:string>>, pointers array<string>, citations array<string>"


def clean_pages(raw: DataFrame) -> DataFrame:
    """Clean pages of raw pages (pageid, ns, title, url, categories, wikitext)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"summary": pa.string(), "sections": pa.list_(pa.struct([("path", pa.list_(pa.string())), ("level", pa.int32()), ("text", pa.string())])), "infobox": pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])), "pointers": pa.list_(pa.string()), "citations": pa.list_(pa.string())}
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                pages = [clean_page(w) for w in part.column("wikitext").to_pylist()]
                cols = [pa.array([p[c] for p in pages], t) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "ns", "title", "url", "categories")), *cols], names=["page_id", "ns", "title", "url", "categories", *types])

    cats = F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.regexp_replace(c, r"(?i)^\s*category\s*:\s*", ""))
    rows = raw.select(F.col("pageid").cast("long").alias("page_id"), F.col("ns").cast("int").alias("ns"), "title", "url", cats.alias("categories"), "wikitext")
    return rows.mapInArrow(run, CLEAN_SCHEMA)


TEMPLATE_SCHEMA = "page_id long, template string, field string, raw string"


def infobox_fields(raw: DataFrame) -> DataFrame:
    """(page_id, template, field, raw): the named fields of every infobox, unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, text in zip(b.column("page_id").to_pylist(), b.column("wikitext").to_pylist(), strict=True):
                for _, _, inside in templates(text or ""):
                    name, params = parameters(inside)
                    if INFOBOX.match(name):
                        rows += [(page, name, k, v) for k, v in params if k and not k.isdigit()] or [(page, name, None, None)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "template", "field", "raw"])

    return raw.select(F.col("pageid").cast("long").alias("page_id"), "wikitext").mapInArrow(run, TEMPLATE_SCHEMA)
