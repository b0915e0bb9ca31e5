"""HTML surface: one parse per page in an Arrow batch, everything after it as columns over the parsed struct."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from serploom.shipping import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose text isn't shown, and those whose links are site chrome. Fixed values.
HIDDEN = frozenset("script style noscript template svg".split())
CHROME = frozenset("header footer nav".split())
CHROME_ROLES = frozenset("banner contentinfo navigation".split())
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "youtube-nocookie.com")
SPACE = re.compile(r"\s+")

SURFACE = (
    "title string, og_title string, meta_desc string, meta_keywords string, "
    "headings array<struct<level: int, text: string>>, p_text string, n_p int, n_tags int, "
    "links array<struct<href: string, host: string, rel: string, text: string, chrome: boolean>>, "
    "alts array<string>, n_img int, has_form boolean, has_video boolean, "
    "jsonld_types array<string>, jsonld_keys array<string>, same_as array<string>, has_jsonld boolean, micro_types array<string>, "
    "body string, full_text string, head_text string, head_words int, "
    "has_author_mark boolean, has_author_link boolean, has_date_mark boolean"
)


class Surface(HTMLParser):
    """Collects what the factors need. Text nodes are stripped and joined by one space."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.open: list[tuple[str, bool]] = []
        self.hidden = self.chrome = 0
        self.title: str | None = None
        self.meta: dict[str, str] = {}
        self.headings: list[tuple[int, str]] = []
        self.links: list[dict] = []
        self.alts: list[str] = []
        self.scripts: list[str] = []
        self.micro: list[str] = []
        self.micro_same: list[str] = []
        self.n = {"p": 0, "img": 0, "tags": 0}
        self.form = self.video = self.author = self.author_link = self.date = False
        self.visible: list[str] = []
        self.all: list[str] = []
        self.paragraphs: list[list[str]] = []
        self.collect: list[tuple[str, int, list[str], dict | None]] = []
        self.json_open = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "p":  # an open paragraph ends where the next begins
            self._close_to("p")
        self.n["tags"] += 1
        if tag in self.n:
            self.n[tag] += 1
        chrome = tag in CHROME or a.get("role", "").strip().lower() in CHROME_ROLES
        if tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            self.meta.setdefault(key, a.get("content", "").strip())
        elif tag == "img":
            if a.get("alt", "").strip():
                self.alts.append(a["alt"].strip())
        elif tag == "form":
            self.form = True
        elif tag == "video" or (tag == "iframe" and any(h in a.get("src", "").lower() for h in VIDEO_HOSTS)):
            self.video = True
        elif tag == "time" and a.get("datetime"):
            self.date = True
        rel = a.get("rel", "").lower()
        if re.search(r"(?i)(?:^|[-_\s])author(?:[-_\s]|$)", a.get("class", "")):
            self.author = True
            self.author_link |= tag == "a"
        if tag == "a" and "author" in rel.split():
            self.author = self.author_link = True
        if a.get("itemtype"):
            self.micro.append(a["itemtype"].rstrip("/").rsplit("/", 1)[-1].lower())
        if a.get("itemprop", "").lower() == "sameas" and (a.get("href") or a.get("content")):
            self.micro_same.append((a.get("href") or a.get("content")).strip())
        if tag in VOID:
            return
        self.open.append((tag, chrome))
        self.hidden += tag in HIDDEN
        self.chrome += chrome
        depth = len(self.open)
        if tag == "script" and "ld+json" in a.get("type", "").lower():
            self.json_open = True
            self.scripts.append("")
        if tag == "title" and self.title is None:
            self.collect.append(("title", depth, [], None))
        if re.fullmatch("h[1-6]", tag):
            self.collect.append((tag, depth, [], None))
        if tag == "p":
            self.collect.append(("p", depth, [], None))
        if tag == "a" and "href" in a:
            link = {"href": a["href"].strip(), "rel": rel, "chrome": self.chrome > 0, "text": ""}
            try:
                link["host"] = (urlsplit(urljoin(self.url, link["href"])).hostname or "").lower()
            except ValueError:
                link["host"] = ""
            self.links.append(link)
            self.collect.append(("a", depth, [], link))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_to(self, tag: str) -> None:
        """An end tag closes what is open inside it; without its start it does nothing. Blocks bound an implied end of p."""
        names = [t for t, _ in self.open]
        if tag not in names:
            return
        while self.open:
            name, chrome = self.open.pop()
            self.hidden -= name in HIDDEN
            self.chrome -= chrome
            while self.collect and self.collect[-1][1] > len(self.open):
                self._finish(*self.collect.pop())
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.json_open = False
        self._close_to(tag)

    def _finish(self, tag: str, _: int, parts: list[str], link: dict | None) -> None:
        text = " ".join(parts)
        if tag == "title":
            self.title = self.title if self.title is not None else text
        elif tag == "p":
            self.paragraphs.append(text)
        elif tag == "a":
            link["text"] = text
        elif text:
            self.headings.append((int(tag[1]), text))

    def handle_data(self, data: str) -> None:
        if self.json_open:
            self.scripts[-1] += data
            return
        part = SPACE.sub(" ", data).strip()
        if not part:
            return
        if not any(t in ("script", "style") for t, _ in self.open[-1:]):
            self.all.append(part)
        if self.hidden:
            return
        self.visible.append(part)
        for c in self.collect:
            c[2].append(part)

    def finish(self) -> None:
        self.close()
        while self.collect:
            self._finish(*self.collect.pop())


def jsonld_nodes(value: object) -> Iterator[dict]:
    """Every object of a JSON-LD value, nested ones and @graph included."""
    if isinstance(value, dict):
        yield value
        for v in value.values():
            yield from jsonld_nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from jsonld_nodes(v)


def _texts(value: object) -> list[str]:
    return [v.strip() for v in (value if isinstance(value, list) else [value]) if isinstance(v, str) and v.strip()]


def parse(html: str | None, url: str | None) -> dict:
    """The surface of one page as a dict of the columns of SURFACE; malformed input gives what was read."""
    html, url = html or "", url or ""
    s = Surface(url)
    s.feed(html)
    s.finish()
    types: dict[str, None] = {}
    keys: dict[str, None] = {}
    same: dict[str, None] = {}
    for raw in s.scripts:
        try:
            nodes = list(jsonld_nodes(json.loads(raw)))
        except (ValueError, RecursionError):
            continue
        for node in nodes:
            types |= dict.fromkeys(t.lower() for t in _texts(node.get("@type", node.get("type"))))
            keys |= dict.fromkeys(k.lower() for k in node)
            same |= dict.fromkeys(_texts(node.get("sameAs")))
    same |= dict.fromkeys(s.micro_same)
    head = html.encode("utf-8", "ignore")[:30720]
    if len(head) < len(html.encode("utf-8", "ignore")):
        h = Surface(url)
        h.feed(head.decode("utf-8", "ignore"))
        h.finish()
        head_text = " ".join(h.visible)
    else:
        head_text = " ".join(s.visible)
    first = s.meta
    by_level = sorted(s.headings, key=lambda h: h[0])
    return {
        "title": s.title or "",
        "og_title": first.get("og:title", ""),
        "meta_desc": first.get("description", ""),
        "meta_keywords": first.get("keywords", ""),
        "headings": [{"level": n, "text": t} for n, t in by_level],
        "p_text": " ".join(t for t in s.paragraphs if t),
        "n_p": s.n["p"],
        "n_tags": s.n["tags"],
        "links": [{k: x[k] for k in ("href", "host", "rel", "text", "chrome")} for x in s.links],
        "alts": s.alts,
        "n_img": s.n["img"],
        "has_form": s.form,
        "has_video": s.video,
        "jsonld_types": list(types),
        "jsonld_keys": list(keys),
        "same_as": list(same),
        "has_jsonld": bool(s.scripts),
        "micro_types": list(dict.fromkeys(s.micro)),
        "body": " ".join(s.visible),
        "full_text": " ".join(s.all),
        "head_text": head_text,
        "head_words": len(re.findall(r"[a-z0-9']+", head_text.lower())),
        "has_author_mark": s.author or any(k in first for k in ("author", "article:author")),
        "has_author_link": s.author_link or any(re.search(r"(?i)author|about", x["href"]) for x in s.links),
        "has_date_mark": s.date or any(k in first for k in ("article:published_time", "article:modified_time")) or bool({"datepublished", "datemodified"} & set(keys)),
    }


def surfaces(pages: DataFrame) -> DataFrame:
    """``pages`` (with url, html) and the columns of SURFACE as struct p; html is kept for factors of the source."""
    ship(pages.sparkSession)
    names = pages.columns
    kinds = dict(pages.dtypes)
    out = pages.sparkSession.createDataFrame([], SURFACE).schema
    struct = to_arrow_type(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                rows = [parse(h, u) for h, u in zip(cols["html"].to_pylist(), cols["url"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(cols[n] for n in names), pa.array(rows, struct)], [*names, "p"])

    return pages.mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"p {out.simpleString()}"]))


def schema_facts(html: str | None, most: int = 12) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(name, type) of named JSON-LD objects, and (name, attribute, value) of up to ``most`` scalars of each."""
    s = Surface("")
    s.feed(html or "")
    s.finish()
    things: dict[tuple[str, str], None] = {}
    facts: list[tuple[str, str, str]] = []
    for raw in s.scripts:
        try:
            nodes = list(jsonld_nodes(json.loads(raw)))
        except (ValueError, RecursionError):
            continue
        for node in nodes:
            name = node.get("name")
            if not isinstance(name, str) or not name.strip():
                continue
            things[name.strip(), ", ".join(_texts(node.get("@type")))] = None
            plain = [(k, str(v)) for k, v in node.items() if isinstance(v, str | int | float) and not k.startswith("@") and k != "name"]
            facts += [(name.strip(), k, v) for k, v in plain[:most]]
    return list(things), facts


def schema_triples(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity, type, attribute, value: one row per fact; entities without any have a null attribute."""
    ship(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            at: list[int] = []
            rows: list[tuple] = []
            for k, h in enumerate(cols["html"].to_pylist()):
                things, facts = schema_facts(h)
                for name, kind in things:
                    own = [(name, kind, a, v) for n, a, v in facts if n == name] or [(name, kind, None, None)]
                    at += [k] * len(own)
                    rows += own
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(cols[k].take(take) for k in keys), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))], [*keys, "entity", "type", "attribute", "value"])

    return pages.select(*keys, "html").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", entity string, type string, attribute string, value string")
