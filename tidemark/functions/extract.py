"""Structure of a page from its HTML: head metadata, main content as sections, links, images, structured data, a verdict.

extract() is pure; page_struct() is the Arrow UDF around it, one call per Arrow batch.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.functions.htmltree import Node, count_words, parse, squeezed
from tidemark.functions.urls import TRACKING

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset(("p", "ul", "ol", "blockquote", "table", "pre", "dl", "figure"))
STRUCTURAL = frozenset((*HEADINGS, *BLOCKS, "div", "section", "article", "main", "header", "footer", "aside", "nav", "li", "img", "br", "hr", "form"))
#: Elements that are no content, and parts of ids and classes that tell the same.
NOISE_TAGS = frozenset(("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "embed", "link", "meta", "button", "input", "select", "textarea"))
NOISE_PARTS = (("id", "cookie"), ("class", "cookie"), ("id", "consent"), ("class", "consent"), ("class", "gdpr"), ("class", "advert"), ("id", "advert"))
CHROME_TAGS = frozenset(("nav", "aside", "form"))
CHROME_ROLES = frozenset(("navigation", "complementary"))
CHROME_CLASSES = frozenset(("share", "sharing", "social", "related", "related-posts", "comments", "newsletter", "author-box"))
CONTENT_CLASSES = ("entry-content", "post-content", "article-content", "article-body", "post-body", "blog-post", "single-post", "post")
SHELL_IDS = frozenset(("root", "__next", "app", "___gatsby", "__nuxt"))
KEPT_ROOTS = frozenset(("html", "body", "main", "article"))

_SKIPPED = re.compile(r"(?i)^(javascript|mailto|tel|data|sms|about|blob):")
_BAD_INDEX = re.compile(r"(?i)\b(noindex|none)\b")
_ASKS_JS = re.compile(r"(?i)enable javascript|requires javascript|javascript is (disabled|required)")
_TRACK = re.compile(TRACKING)

BLOCK_DDL = "array<struct<type:string,text:string,items:array<string>,src:string,alt:string>>"
PAGE_DDL = (
    "title string, meta_description string, canonical_url string, language string, robots string, noindex boolean, og map<string,string>, twitter map<string,string>, charset string, viewport string, "
    "h1 string, headings array<struct<level:int,text:string,order:int>>, "
    f"sections array<struct<key:string,order:int,heading:string,level:int,blocks:{BLOCK_DDL},text:string,word_count:int>>, body_text string, word_count int, "
    "links array<struct<target:string,anchor:string,internal:boolean,in_content:boolean,rel:array<string>,nofollow:boolean>>, "
    "images array<struct<src:string,alt:string,title:string,width:int,height:int,in_content:boolean>>, "
    "json_ld array<struct<types:array<string>,data:string>>, invalid_json_ld int, container string, app_shell boolean, content_hash string"
)


def slug(text: str) -> str:
    parts = re.findall(r"[^\W_]+", unicodedata.normalize("NFKD", text.lower()))
    return "-".join(parts)[:60] or "section"


def slug_column(text):
    """slug() as a column; null is empty."""

    def batch(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: slug(t or ""))

    return F.pandas_udf(batch, "string")(text)


def absolute(raw: str | None, base: str) -> str | None:
    value = (raw or "").strip()
    if not value or value.startswith("#") or _SKIPPED.match(value):
        return None
    try:
        url = urldefrag(urljoin(base, value)).url
        parts = urlsplit(url)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    return url if parts.path or parts.query else url + "/"


def canonical(url: str) -> str:
    parts = urlsplit(url)
    path = re.sub("/{2,}", "/", parts.path) or "/"
    path = path.rstrip("/") or "/"
    pairs = sorted((p for p in parts.query.split("&") if p and not _TRACK.match(p.split("=")[0])), key=lambda p: p.split("=")[0])
    return f"{parts.scheme}://{parts.netloc.lower()}{path}" + ("?" + "&".join(p if "=" in p else p + "=" for p in pairs) if pairs else "")


def site(url: str) -> str:
    return re.sub(r"^www\.", "", (urlsplit(url).hostname or "").lower())


def meta(root: Node, attribute: str, key: str) -> str | None:
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get(attribute, "").lower() == key:
            return squeezed(n.attrs.get("content", "")) or None
    return None


def json_types(value, depth: int = 0) -> list[str]:
    if depth > 3:
        return []
    if isinstance(value, list):
        return [t for v in value for t in json_types(v, depth + 1)]
    if not isinstance(value, dict):
        return []
    own = value.get("@type")
    found = [own] if isinstance(own, str) else [t for t in own if isinstance(t, str)] if isinstance(own, list) else []
    return found + (json_types(value["@graph"], depth + 1) if value.get("@graph") else [])


def json_ld(root: Node) -> tuple[list[dict], int]:
    blocks, invalid = [], 0
    for n in root.find("script"):
        if "application/ld+json" not in n.attrs.get("type", "").lower():
            continue
        raw = re.sub(r"(-->|\]\]>)\s*$", "", re.sub(r"^\s*(<!--|<!\[CDATA\[)", "", n.text())).strip()
        if not raw:
            continue
        try:
            data = json.loads(raw)
            blocks.append({"types": list(dict.fromkeys(json_types(data))), "data": json.dumps(data, sort_keys=True, ensure_ascii=False)})
        except (ValueError, RecursionError):
            invalid += 1
    return blocks, invalid


def anchor(link: Node) -> str:
    """The text of a link, else its first image's, else its own label. Another link ends it, as links don't nest: so all anchors
    of a page together are no longer than the page."""
    texts, image, todo = [], None, link.children[::-1]
    while todo:
        n = todo.pop()
        if n.tag == "a":
            break
        if n.tag == "#text":
            texts.append(n.data)
        elif n.tag == "img" and image is None:
            image = n
        todo.extend(n.children[::-1])
    return squeezed("".join(texts)) or (squeezed(image.attrs.get("alt", "")) if image else "") or squeezed(link.attrs.get("aria-label", link.attrs.get("title", "")))


def is_noise(n: Node) -> bool:
    a = n.attrs
    if n.tag in NOISE_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or "data-ad" in a:
        return True
    style, classes = a.get("style", ""), n.classes()
    if "display:none" in style or "display: none" in style or "ad" in classes or "ads" in classes:
        return True
    if any(part in a.get(name, "").lower() for name, part in NOISE_PARTS) or a.get("id", "").startswith("google_ads"):
        return True
    return n.tag == "ins" and "adsbygoogle" in classes


def is_chrome(n: Node) -> bool:
    return n.tag in CHROME_TAGS or n.attrs.get("role") in CHROME_ROLES or n.attrs.get("id") == "comments" or not CHROME_CLASSES.isdisjoint(n.classes())


def choose(root: Node) -> tuple[Node, str]:
    """The element of the main content, and what it was found by."""
    body = next(iter(root.find("body")), None) or root
    words = max(1, count_words(body.text()))

    def enough(n: Node) -> bool:
        w = count_words(n.text())
        return w >= 50 or w >= words * 0.3

    articles = sorted(((count_words(a.text()), -k, a) for k, a in enumerate(root.find("article"))), key=lambda x: x[:2], reverse=True)
    if articles:
        best, _, node = articles[0]
        listing = len(articles) > 3 and best < sum(w for w, _, _ in articles) * 0.5
        if not listing and enough(node):
            return node, "article"
    tests = [("main", lambda n: n.tag == "main"), ('[role="main"]', lambda n: n.attrs.get("role") == "main"), ('[itemprop="articleBody"]', lambda n: n.attrs.get("itemprop") == "articleBody")]
    tests += [(f".{c}", lambda n, c=c: c in n.classes()) for c in CONTENT_CLASSES]
    tests += [("#content", lambda n: n.attrs.get("id") == "content"), (".content", lambda n: "content" in n.classes()), ("#main", lambda n: n.attrs.get("id") == "main")]
    for label, test in tests:
        node = next((n for n in root.walk() if test(n)), None)
        if node is not None and enough(node):
            return node, label
    return body, "body"


class Sections:
    """Walks content: a heading opens a section, blocks and loose text of some words fill it."""

    def __init__(self, base: str, first: str | None):
        self.base = base
        self.found: list[dict] = [{"heading": first, "level": 1 if first else 0, "blocks": []}]
        self.headings = [{"level": 1, "text": first, "order": 0}] if first else []

    def add(self, kind: str, text: str, items=None, src=None, alt=None) -> None:
        self.found[-1]["blocks"].append({"type": kind, "text": text, "items": items, "src": src, "alt": alt})

    def block(self, n: Node) -> None:
        if n.tag in ("ul", "ol", "table"):
            if n.tag == "table":
                items = [" | ".join(squeezed(c.text()) for c in r.children if c.tag in ("th", "td")) for r in n.find("tr")]
                items = [r for r in items if r.strip("| \t\n")]
            else:
                items = [x for c in n.children if c.tag == "li" and (x := squeezed(c.text()))]
            if items:
                self.add(n.tag, "\n".join(items), items)
        elif n.tag == "figure":
            image = next(iter(n.find("img")), None)
            caption = squeezed("".join(c.text() for c in n.find("figcaption")))
            src = absolute(image.attrs.get("src", image.attrs.get("data-src")), self.base) if image else None
            if src or caption:
                self.add("figure", caption, None, src, image.attrs.get("alt") if src else None)
        elif n.tag == "pre":
            if text := n.text().strip():
                self.add("pre", text)
        elif text := squeezed(n.text()):
            self.add(n.tag if n.tag in ("blockquote", "dl") else "p", text)

    def walk(self, top: Node) -> None:
        todo = top.children[::-1]
        while todo:
            n = todo.pop()
            if n.tag == "#text":
                text = squeezed(n.data)
                if count_words(text) >= 3:
                    self.add("p", text)
            elif n.tag in HEADINGS:
                if text := squeezed(n.text()):
                    level = int(n.tag[1])
                    self.headings.append({"level": level, "text": text, "order": len(self.headings)})
                    self.found.append({"heading": text, "level": level, "blocks": []})
            elif n.tag in BLOCKS and not n.find(*HEADINGS):
                self.block(n)
            elif n.tag == "img":
                if src := absolute(n.attrs.get("src", n.attrs.get("data-src")), self.base):
                    self.add("img", "", None, src, n.attrs.get("alt"))
            elif n.tag not in BLOCKS and not any(d.tag in STRUCTURAL for d in n.walk()) and (n.tag in ("div", "section") or n.tag not in STRUCTURAL):
                text = squeezed(n.text())
                if text and (n.tag in ("div", "section") or count_words(text) >= 3):
                    self.add("p", text)
            else:
                todo.extend(n.children[::-1])

    def rows(self) -> list[dict]:
        out = []
        for s in self.found:
            if s["heading"] is None and not s["blocks"]:
                continue
            text = "\n\n".join(b["text"] for b in s["blocks"] if b["text"])
            order = len(out)
            out.append({"key": f"s{order}-{slug(s['heading']) if s['heading'] else 'intro'}", "order": order, **s, "text": text, "word_count": count_words(f"{s['heading'] or ''} {text}")})
        return out


def extract(html: str | None, page_url: str, header: str | None = None, min_words: int = 50, robots_token: str | None = None) -> dict:
    root = parse(html or "")
    base_tag = next((n for n in root.find("base") if "href" in n.attrs), None)
    base = absolute(base_tag.attrs["href"], page_url) if base_tag else None
    base = base or page_url
    heads = [t for h in root.find("head") for t in h.find("title")] or root.find("title")
    link = next((n for n in root.find("link") if "canonical" in n.attrs.get("rel", "").lower().split()), None)
    page = next(iter(root.find("html")), None)
    robots = [x for x in (meta(root, "name", "robots"), meta(root, "name", robots_token.lower()) if robots_token else None, header) if x]
    og = {k: v for k in ("title", "description", "image", "url", "type") if (v := meta(root, "property", f"og:{k}"))}
    twitter = {k: v for k in ("card", "title", "description", "image") if (v := meta(root, "name", f"twitter:{k}") or meta(root, "property", f"twitter:{k}"))}
    for found, keys in ((og, ("image", "url")), (twitter, ("image",))):
        found.update({k: absolute(found[k], base) or found[k] for k in keys if k in found})
    charset = next((n.attrs["charset"].lower() for n in root.find("meta") if n.attrs.get("charset")), None)
    blocks, invalid = json_ld(root)
    out = {
        "title": squeezed(heads[0].text()) or None if heads else None, "meta_description": meta(root, "name", "description"), "canonical_url": absolute(link.attrs.get("href"), base) if link else None,
        "language": (squeezed(page.attrs.get("lang", "")) if page else "") or meta(root, "http-equiv", "content-language"), "robots": ", ".join(robots) or None, "noindex": bool(_BAD_INDEX.search(", ".join(robots))),
        "og": og, "twitter": twitter, "charset": charset, "viewport": meta(root, "name", "viewport"), "json_ld": blocks, "invalid_json_ld": invalid,
    }
    shell = any(n.attrs.get("id") in SHELL_IDS or "ng-version" in n.attrs or "data-reactroot" in n.attrs or n.tag == "app-root" for n in root.walk())
    shell = shell or bool(_ASKS_JS.search(" ".join(n.text() for n in root.find("noscript"))))

    for n in list(root.walk()):
        if is_noise(n) and n.tag not in KEPT_ROOTS and not n.find("h1"):
            n.remove()
    container, label = choose(root)
    strip = label in ("body", "main", '[role="main"]')

    def outside(n: Node) -> bool:
        """Site chrome: what is in an excluded part, or in a header or footer of no article."""
        for a in n.above():
            if is_chrome(a):
                return True
            if strip and a.tag in ("header", "footer") and not any(x.tag == "article" for x in a.above()):
                return True
        return False

    inside = {id(n) for n in container.find("a", "img") if not outside(n)}
    links, seen = [], set()
    own = site(page_url)
    for n in root.find("a"):
        target = absolute(n.attrs.get("href"), base)
        if not target:
            continue
        internal = site(target) == own
        row = (canonical(target) if internal else target, anchor(n), id(n) in inside)
        if row not in seen:
            seen.add(row)
            rel = n.attrs.get("rel", "").lower().split()
            links.append({"target": row[0], "anchor": row[1], "internal": internal, "in_content": row[2], "rel": rel, "nofollow": "nofollow" in rel})
    images, seen = [], set()
    for n in root.find("img"):
        a = n.attrs
        first = (a.get("srcset") or a.get("data-srcset") or "").split(",")[0].split()
        src = absolute(a.get("src"), base) or absolute(a.get("data-src", a.get("data-lazy-src")), base) or absolute(first[0] if first else None, base)
        if src and (src, id(n) in inside) not in seen:
            seen.add((src, id(n) in inside))
            size = [int(v) if (v := a.get(k, "").strip()).isdigit() and v.isascii() else None for k in ("width", "height")]
            images.append({"src": src, "alt": squeezed(a["alt"]) if "alt" in a else None, "title": squeezed(a.get("title", "")) or None, "width": size[0], "height": size[1], "in_content": id(n) in inside})

    page_h1 = next((t for h in root.find("h1") if not any(x.tag in ("nav", "footer") for x in h.above()) and (t := squeezed(h.text()))), None)
    for n in list(container.walk()):
        if is_chrome(n) or strip and n.tag in ("header", "footer") and not any(x.tag == "article" for x in n.above()):
            n.remove()
    sections = Sections(base, page_h1 if page_h1 and not container.find("h1") else None)
    sections.walk(container)
    rows = sections.rows()
    body = "\n\n".join("\n".join(x for x in (s["heading"], s["text"]) if x) for s in rows)
    words = count_words(body)
    out |= {"h1": next((h["text"] for h in sections.headings if h["level"] == 1), None), "headings": sections.headings, "sections": rows, "body_text": body, "word_count": words, "links": links, "images": images, "container": label, "app_shell": shell and words < min_words}
    return out | {"content_hash": content_hash(out)}


def content_hash(page: dict) -> str:
    """SHA-256 over what matters for content, as JSON with sorted keys: no raw HTML, no site chrome."""
    kept = {k: page[k] for k in ("title", "meta_description", "canonical_url", "robots", "language")}
    kept["headings"] = [[h["level"], h["text"]] for h in page["headings"]]
    kept["sections"] = [{k: s[k] for k in ("heading", "level", "blocks")} for s in page["sections"]]
    kept["links"] = [[x["target"], x["anchor"], x["rel"]] for x in page["links"] if x["in_content"]]
    kept["images"] = [[x["src"], x["alt"]] for x in page["images"] if x["in_content"]]
    kept["json_ld"] = [x["data"] for x in page["json_ld"]]
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


FIELDS = dict(re.findall(r"(\w+) ((?:\w+<.*?>)(?=, \w+ (?:string|int|boolean|array|map)|$)|\w+)(?:, |$)", PAGE_DDL))


#: Pages whose structure is held as Python objects at once, or fewer that have so many characters.
PAGES_AT_ONCE, CHARACTERS_AT_ONCE = 64, 1_000_000


def page_struct(html, url, *fields: str):
    """The page as a struct of the given fields, or of all (PAGE_DDL), one Arrow UDF call per batch of rows. Of a batch, few
    pages are Python objects at a time, and only the given fields of the others are held, in columns."""
    names = list(fields or FIELDS)
    ddl = ", ".join(f"{n} {FIELDS[n]}" for n in names)
    kind = to_arrow_type(StructType.fromDDL(ddl))

    def one(html_: str | None, url_: str | None) -> dict:
        page = extract(html_, url_ or "")
        return {n: list(page[n].items()) if isinstance(page[n], dict) else page[n] for n in names}

    def pages(texts: pa.Array, places: pa.Array) -> pa.Array:
        parts, held, size = [], [], 0
        for text, place in zip(texts, places, strict=True):
            html_ = text.as_py()
            held.append(one(html_, place.as_py()))
            size += len(html_ or "")
            if len(held) == PAGES_AT_ONCE or size >= CHARACTERS_AT_ONCE:
                parts.append(pa.array(held, kind))
                held, size = [], 0
        return pa.concat_arrays([*parts, pa.array(held, kind)])

    return F.arrow_udf(pages, ddl)(html, url)
