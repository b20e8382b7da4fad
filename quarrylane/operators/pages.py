"""Structured records from crawled pages: one parse per page, one vectorised function per kind of page.

A page is parsed into a light tree; records are described by tables of labels, so one scan of the tree collects them.
Dates, money and counts stay as text here and become typed by column functions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarrylane.functions import normalize as nz
from quarrylane.functions import vocabulary as v

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Memo(dict):
    """What a function gives for keys met before; it travels to Python workers empty."""

    def __init__(self, function: Callable, most: int = 4096):
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.function(key)
        return value

    def __reduce__(self):
        return Memo, (self.function, self.most)


#: (tags, classes) as a tuple and a set.
_wanted = Memo(lambda words: (tuple(words[0].split()), frozenset(words[1].split())))


class Node:
    """An element of a tree: its classes, attributes and children (elements and strings).

    Elements are numbered in page order, so those within one are the numbers up to ``end``, and its strings are
    those of the page from ``start`` to ``stop``.
    """

    __slots__ = ("tree", "number", "tag", "attrs", "classes", "end", "start", "stop")

    def __init__(self, tree: Tree, number: int):
        self.tree, self.number, self.tag = tree, number, tree.tags[number]
        self.attrs, self.classes = tree.about[number]
        self.end, self.start, self.stop = tree.ends[number], tree.starts[number], tree.stops[number]

    @property
    def parent(self) -> Node | None:
        return self.tree.node(self.tree.parents[self.number]) if self.number else None

    def elements(self) -> Iterator[Node]:
        """Those right below this one."""
        k = self.number + 1
        while k < self.end:
            yield self.tree.node(k)
            k = self.tree.ends[k]

    @property
    def children(self) -> list[Node | str]:
        out, at = [], self.start
        for c in self.elements():
            out += [*self.tree.texts[at : c.start], c]
            at = c.stop
        return out + self.tree.texts[at : self.stop]

    def walk(self) -> Iterator[Node]:
        return map(self.tree.node, range(self.number + 1, self.end))

    def strings(self) -> list[str]:
        return self.tree.texts[self.start : self.stop]

    def text(self) -> str | None:
        return " ".join("".join(self.tree.texts[self.start : self.stop]).split()) or None

    def within(self, found: list[int]) -> list[int]:
        """Those of some ascending numbers that are inside this element."""
        return found[bisect_left(found, self.number + 1) : bisect_left(found, self.end)] if self.number else found

    def all(self, tags: str = "", classes: str = "") -> list[Node]:
        names, need = _wanted[tags, classes]
        tree = self.tree
        if need:
            found = self.within(min((tree.by_class.get(c, []) for c in need), key=len))
            return [tree.node(k) for k in found if need <= tree.about[k][1] and (not names or tree.tags[k] in names)]
        if len(names) == 1:
            return [tree.node(k) for k in self.within(tree.by_tag.get(names[0], []))]
        return [n for n in self.walk() if not names or n.tag in names]

    def first(self, tags: str = "", classes: str = "") -> Node | None:
        return next(iter(self.all(tags, classes)), None)

    def hinted(self, hint: str, tag: str = "div") -> list[Node]:
        """Elements with the hint in a class."""
        tree = self.tree
        return [tree.node(k) for k in sorted({k for c, found in tree.by_class.items() if hint in c for k in self.within(found) if tree.tags[k] == tag})]

    def up(self, classes: str = "", tag: str = "div") -> Node | None:
        need, node = _wanted["", classes][1], self.parent
        while node and not (node.tag == tag and need <= node.classes):
            node = node.parent
        return node

    def following(self, tag: str = "div") -> Node | None:
        tree, k = self.tree, self.end
        last = tree.ends[tree.parents[self.number]] if self.number else 0
        while k < last:
            if tree.tags[k] == tag:
                return tree.node(k)
            k = tree.ends[k]
        return None

    def urls(self, base: str) -> list[str]:
        return [joined(base, href) for a in self.all("a") if (href := a.attrs.get("href"))]

    def links(self, base: str) -> list[dict]:
        return [{"text": a.text() or "", "url": joined(base, href)} for a in self.all("a") if (href := a.attrs.get("href"))]


_ORIGIN = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:/|$)")
_ROOTED = re.compile(r"/(?:[A-Za-z0-9_~-][A-Za-z0-9_~.-]*/?)*+")
_WHOLE = re.compile(r"https?://[A-Za-z0-9.-]+(?:/[A-Za-z0-9_~./-]*)?")




def joined(base: str, href: str) -> str:
    """urljoin; rooted paths and whole urls of plain characters need no parsing."""
    if _ROOTED.fullmatch(href) and (origin := _ORIGIN.match(base)):
        return origin[1] + href
    return href if _WHOLE.fullmatch(href) else urljoin(base, href)


#: The attributes and classes of an element.
About = tuple[dict[str, str | None], frozenset[str]]


def _about(attrs: dict[str, str | None]) -> About:
    return attrs, frozenset((attrs.get("class") or "").split())


class Tree:
    """The elements and strings of a page in page order, by columns: an element is a number."""

    def __init__(self):
        self.tags, self.about, self.parents, self.ends, self.starts, self.stops = [""], [_about({})], [0], [1], [0], [0]
        self.texts, self.at, self.made = [], 0, {}

    def node(self, number: int) -> Node:
        node = self.made.get(number)
        if node is None:
            node = self.made[number] = Node(self, number)
        return node

    @cached_property
    def by_tag(self) -> dict[str, list[int]]:
        out = defaultdict(list)
        for k, tag in enumerate(self.tags):
            out[tag].append(k)
        return out

    @cached_property
    def by_class(self) -> dict[str, list[int]]:
        out = defaultdict(list)
        for k, (_, classes) in enumerate(self.about):
            for c in classes:
                out[c].append(k)
        return out

    def empty(self, tag: str, about: About) -> int:
        number, text = len(self.tags), len(self.texts)
        self.tags.append(tag)
        self.about.append(about)
        self.parents.append(self.at)
        self.ends.append(number + 1)
        self.starts.append(text)
        self.stops.append(text)
        return number

    def open(self, tag: str, about: About) -> None:
        if tag == "p" and self.tags[self.at] == "p":
            self.leave(self.at)
        number = self.empty(tag, about)
        if tag not in VOID:
            self.at = number

    def leave(self, number: int) -> None:
        """All that is open up to the element ends here."""
        k, end, stop = self.at, len(self.tags), len(self.texts)
        self.at = self.parents[number]
        while k != number:
            self.ends[k], self.stops[k] = end, stop
            k = self.parents[k]
        self.ends[k], self.stops[k] = end, stop

    def close(self, tag: str) -> None:
        number, tags = self.at, self.tags
        while number and tags[number] != tag:
            number = self.parents[number]
        if number:
            self.leave(number)

    def data(self, text: str) -> None:
        if text and self.tags[self.at] not in ("script", "style"):
            self.texts.append(text)

    def done(self) -> Node:
        self.leave(0)
        return self.node(0)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = Tree()

    def handle_starttag(self, tag, attrs):
        self.tree.open(tag, _about(dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.tree.empty(tag, _about(dict(attrs)))

    def handle_endtag(self, tag):
        self.tree.close(tag)

    def handle_data(self, data):
        self.tree.data(data)


def _parsed(page: str) -> Tree:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.tree


_S = r"[ \t\n\r\f]"
#: Tags without attributes or with quoted ones, plain comments and doctypes; no parser reads them in another way.
_PLAIN = re.compile(rf"""<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:{_S}++[a-zA-Z][a-zA-Z0-9:_.-]*+(?:="[^"]*+")?+)*+){_S}*+(/?)>|<!--(?:[^<>-]|-(?!-))*+-->|<!(?i:doctype)[^<>]*+>""")
_ATTRIBUTE = re.compile(rf"""{_S}([a-zA-Z][a-zA-Z0-9:_.-]*+)(?:="([^"]*+)")?+""")
#: Elements whose content may be read in another way.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())


def _read_attributes(plain: str) -> About:
    return _parsed(f"<x{plain}>").about[1] if "&" in plain else _about({m[1].lower(): m[2] for m in _ATTRIBUTE.finditer(plain)})


_attributes = Memo(_read_attributes)


def _plain(page: str) -> Tree | None:
    """The tree of a page that holds nothing but plain tags and text, else None."""
    tree, raw, parts = Tree(), None, _PLAIN.split(page)
    each = iter(parts)
    for text, ending, tag, attrs, empty in zip(each, each, each, each, each, strict=False):
        tag = tag and tag.lower()
        if raw:
            if not ending or tag != raw or "</" in text or raw not in ("script", "style") and ("<" in text or "&" in text):
                return None
            raw = None
        elif "<" in text:
            return None
        if text:
            tree.data(unescape(text) if "&" in text else text)
        if tag is None:
            continue
        if ending:
            if attrs or empty:
                return None
            tree.close(tag)
        elif empty:
            tree.empty(tag, _attributes[attrs])
        else:
            tree.open(tag, _attributes[attrs])
            raw = tag if tag in _RAW else None
    text = parts[-1]
    if raw or "<" in text:
        return None
    tree.data(unescape(text) if "&" in text else text)
    return tree


def parse(page: str | None) -> Node:
    """The root of a page; pages of plain tags take a short way to the tree that the library's parser gives."""
    return (_plain(page or "") or _parsed(page or "")).done()


def pairs(scope: Node, hint: str) -> dict[str, str]:
    """Labels (div with the hint in a class) and the texts of the divs that follow them."""
    out = {}
    for d in scope.hinted(hint):
        if (value := d.following()) and (label := d.text()):
            out[label] = value.text() or ""
    return out


def specs(root: Node) -> dict[str, Node]:
    """Specification blocks: a div whose only class is font-bold, and the div that follows it."""
    return {label: value for d in root.all("div", "font-bold") if d.classes == {"font-bold"} and (label := d.text()) and (value := d.following())}


def quick_facts(root: Node) -> dict[str, str]:
    return {label: value.text() or "" for d in root.all("div", "font-bold leading-snug") if (label := d.text()) and (value := d.following())}


def hero_image(root: Node, name: str | None, base: str) -> str | None:
    same = lambda n: " ".join((n.attrs.get("alt") or "").split()).lower() == (name or "").lower()
    return next((joined(base, n.attrs["src"]) for n in root.all("img") if name and same(n) and n.attrs.get("src")), None)


def classify(root: Node) -> str:
    """area, development, area_index or unknown, by the breadcrumb."""
    for a in root.all("a"):
        href, text = a.attrs.get("href") or "", a.text() or ""
        if href.endswith(v.PATH_PREFIX + v.AREA_INDEX) and "Area Guides" in text:
            return "area"
        if href.endswith(v.PATH_PREFIX + "buildings") and "Building Guides" in text:
            return "development"
    return "area_index" if "Complete list of Dubai's geographical areas" in " ".join("".join(root.strings()).split()) else "unknown"


#: Labels of a transaction panel and the fields they fill.
TRANSACTION = {
    "Transaction ID": "transaction_id", "Date": "date_raw", "Price/sq. ft": "price_per_sqft_raw", "Price/sq m": "price_per_sqm_raw", "Room Type": "room_type", "Property Type": "property_type",
    "Property Sub-type": "property_subtype", "Property Use": "property_use", "Registration Type": "registration_type", "Transaction Type": "transaction_type", "Transaction Group": "transaction_group",
    "Building Name": "building_name_raw", "Project": "project_raw", "Master Project": "master_project_raw", "Area": "area_raw", "No. of Sellers": "sellers_raw", "No. of Buyers": "buyers_raw", "Parking": "parking",
}


def transactions(root: Node, base: str) -> list[dict]:
    out = []
    for panel in root.all("div", "zena-expander"):
        scope = panel.up("relative") or panel
        found = pairs(scope, "text-gray-500")
        price = next((s.attrs.get("data-orig") for s in panel.all("span", "price-val")), None)
        size = next((s.attrs.get("data-sqft") for s in panel.all("span", "ps-area-size-switcher")), None)
        if not found and price is None:
            continue
        guide = [x["url"] for x in scope.links(base) if v.PATH_PREFIX in x["url"]]
        out.append({f: found.get(label) for label, f in TRANSACTION.items()} | {"price_raw": price, "size_raw": size, "guide_url": guide[0] if guide else None})
    return out


def building_cards(root: Node, base: str) -> list[dict]:
    seen: dict[str, dict] = {}
    for d in root.all("div", "line-clamp-2 font-bold"):
        a = d.up(tag="a")
        if a is None or not a.attrs.get("href") or v.PATH_PREFIX not in (url := joined(base, a.attrs["href"])):
            continue
        name, beside = " ".join((a.attrs.get("title") or "").split()) or d.text(), a.following()
        status = beside.text() if beside else None
        icon = beside.first("span") if beside else None
        if icon is not None and status and (mark := icon.text()):
            status = status.removeprefix(mark).strip() or None
        if name:
            seen.setdefault(url, {"name": name, "url": url, "raw_status": status})
    return list(seen.values())


def sub_communities(root: Node, base: str) -> list[dict]:
    seen: dict[str, dict] = {}
    for a in root.all("a", "group"):
        name = a.first("div", "font-bold")
        url = joined(base, a.attrs.get("href") or "")
        if name is None or v.PATH_PREFIX not in url or not name.text():
            continue
        icon, image = a.first("span", "material-icons"), a.first("img")
        beside = icon.parent.children[icon.parent.children.index(icon) + 1 :] if icon else []
        status = next((" ".join(x.split()) for x in beside if isinstance(x, str) and x.strip()), None)
        seen.setdefault(url, {"name": name.text(), "url": url, "raw_status": status, "image_url": joined(base, image.attrs["src"]) if image and image.attrs.get("src") else None})
    return list(seen.values())


DOCUMENTS = {"MASTERPLAN": "masterplan", "CONSTRUCTION PHOTOS": "construction_photos", "DESIGN STAGE": "design_stage"}


def documents(root: Node, base: str) -> list[dict]:
    out = []
    for h in root.all("h2 h3"):
        kind = DOCUMENTS.get((h.text() or "").upper())
        if not kind:
            continue
        block = h.up("ps-3-col-block")
        text = block.following() if block else None
        content = text.following() if text else None
        count = re.search(r"Show all (\d+) photos?", content.text() or "") if content else None
        photos = [joined(base, a.attrs["href"]) for a in content.all("a", "zena-photoswipe-item") if a.attrs.get("href")] if content else []
        out.append({"doc_type": kind, "label": h.text(), "photo_count": int(count[1]) if count else None, "photo_urls": photos})
    return out


#: Section headings that are no categories.
SECTIONS = frozenset({"overview", "latest transactions", "sub-communities", "masterplan", "construction photos", "construction history", "properties on the market", "milestones", "design stage"})


def _categories(root: Node) -> Iterator[tuple[Node, str | None]]:
    """Every element with the category heading that precedes it."""
    at = None
    for n in root.walk():
        if n.tag in ("h2", "h3") and "ps-crosshead" in n.classes:
            at = None if (n.text() or "").lower() in SECTIONS else n.text()
        yield n, at


def amenities(root: Node) -> list[dict]:
    """Outlets, as a name div with the building's link in the next div, or as name and link in one div."""
    out: dict[tuple, dict] = {}
    for a, category in _categories(root):
        if a.tag != "a" or "ps-link" not in a.classes or not a.attrs.get("href") or (box := a.up()) is None:
            continue
        building, whole = a.text() or "", " ".join(" ".join(box.strings()).split())
        siblings = list(box.parent.elements()) if box.parent else []
        bold = next((c for c in reversed(siblings[: siblings.index(box)]) if c.tag == "div" and "font-bold" in c.classes), None) if box in siblings else None
        if bold is not None:
            name, place = bold.text(), whole.replace(building, "", 1).lstrip(", ").strip() or None
        else:
            name, place = (whole[: -len(building)].rstrip(", ").strip() or None) if building and whole.endswith(building) else None, None
        if name:
            out.setdefault((name, category, building), {"name": name, "category": category or "Uncategorized", "building_context": building or None, "distance_text": place})
    return list(out.values())


def schools(root: Node) -> list[dict]:
    out = []
    for d, category in _categories(root):
        if d.tag != "div" or not {"font-bold", "mb-4"} <= d.classes or not d.text():
            continue
        facts, row = {}, d.following()
        while row is not None and (label := row.first("span")) is not None:
            key = label.text() or ""
            if key.endswith(":"):
                facts[key.rstrip(":")] = (row.text() or "").replace(key, "", 1).strip() or None
            row = row.following()
        out.append({"name": d.text(), "curriculum": category, "rating": facts.get("Government rating"), "distance_text": facts.get("Distance"), "fees_text": facts.get("Annual fees"), "location_text": facts.get("Location")})
    return out


def milestones(root: Node) -> list[dict]:
    head = next((d for d in root.all("div", "font-medium mb-4") if (d.text() or "").endswith("Milestones")), None)
    box = head.up("border rounded-xl") if head else None
    cells = [[c for c in row.elements() if c.tag == "div"] for row in box.all("div", "grid-cols-2")] if box else []
    return [{"label": c[0].text(), "date_raw": c[1].text()} for c in cells if len(c) == 2 and c[0].text() and c[1].text()]


ROLES = {"The developer": "Developer", "The architect": "Architect", "The contractor": "Contractor"}


def companies(found: dict[str, Node], base: str) -> list[dict]:
    return [{"role": role, "name": x["text"], "url": x["url"]} for label, role in ROLES.items() if label in found for x in found[label].links(base)]


def timeline(root: Node) -> list[dict]:
    out = []
    for row in root.all("div", "flex-col lg:flex-row"):
        letters, text = row.first("div", "select-none"), next((d for d in row.all("div", "grow") if d.classes == {"grow"}), None)
        raw = re.sub(r"(?<=[A-Za-z])(?=\d)", " ", "".join(s.strip() for s in letters.strings())) if letters else ""
        if raw and text and text.text():
            out.append({"date_raw": raw, "description": text.text()})
    return out


def mentioned_places(root: Node, base: str) -> list[dict]:
    """Links in the transport section, with their paragraph and sub-heading."""
    head = next((h for h in root.all("h2 h3", "ps-crosshead") if re.fullmatch(r"(?i)Transport\s*&\s*Access", h.text() or "")), None)
    block = head.up("ps-3-col-block") if head else None
    while block is not None and (block := block.following()) is not None and "ps-3-col-block" not in block.classes:
        pass
    prose = block.first("div", "ps-prose") if block else None
    out, section = {}, None
    for child in prose.elements() if prose else ():
        if child.tag == "div" and "ps-h3" in child.classes:
            section = child.text()
        elif child.tag == "p":
            for x in child.links(base):
                if x["text"]:
                    out.setdefault((x["text"], x["url"], section), {"name": x["text"], "linked_url": x["url"], "context_sentence": child.text(), "section": section})
    return list(out.values())


SUMMARY = {
    "dev_total": r"currently ([\d,]+) building developments", "dev_completed": r"([\d,]+) are complete", "dev_planned": r"([\d,]+) are at the planning stage",
    "dev_under_construction": r"([\d,]+) are at various stages of construction", "dev_on_hold": r"(\w+) are either on-hold", "dev_cancelled": r"([\d,]+) projects that.*?(?:cancelled|drawing board)",
}
CARDS = {"Buildings": "dld_buildings", "Villas": "dld_villas", "Residential Units": "dld_residential_units", "Commercial Units": "dld_commercial_units"}


class Page:
    """A parsed page and what several of its fields use."""

    def __init__(self, html: str, url: str):
        self.root, self.url = parse(html), url

    @cached_property
    def specs(self) -> dict[str, Node]:
        return specs(self.root)

    @cached_property
    def quick(self) -> dict[str, str]:
        return quick_facts(self.root)

    @cached_property
    def name(self) -> str:
        h1 = self.root.first("h1")
        return (h1.text() if h1 else None) or self.url

    @cached_property
    def whole(self) -> str:
        return " ".join("".join(self.root.strings()).split())

    def spec(self, label: str) -> str | None:
        return self.specs[label].text() if label in self.specs else None

    def links(self, label: str) -> list[dict]:
        return self.specs[label].links(self.url) if label in self.specs else []

    def link(self, label: str) -> str | None:
        found = self.links(label)
        return found[0]["url"] if found else None

    @cached_property
    def widget(self) -> Node | None:
        """The community's box of the land department."""
        label = next((n for n in self.root.walk() if n.end == n.number + 1 and n.text() == "COMMUNITY"), None)
        return label.up("select-none") if label else None

    @cached_property
    def codes(self) -> list[str | None]:
        return [d.text() for d in self.widget.all("div", "font-transport-medium")] if self.widget else []

    @cached_property
    def stats(self) -> dict[str, str]:
        wrap = self.widget.up() if self.widget else None
        return pairs(wrap.following(), "text-gray-700") if wrap and wrap.following() else {}

    @cached_property
    def beside(self) -> dict[str, Node]:
        """The first divs after the labels of the website and the plot."""
        out: dict[str, Node] = {}
        for d in self.root.all("div"):
            if (label := d.text()) in ("Website", "Plot") and label not in out and (value := d.following()):
                out[label] = value
        return out

    def plot(self) -> str | None:
        text = self.beside["Plot"].text() if "Plot" in self.beside else None
        m = re.search(r"(?i)plot\s+([A-Za-z0-9\-]+)", text or "")
        return m[1] if m else text

    def website(self) -> str | None:
        found = self.beside["Website"].links(self.url) if "Website" in self.beside else []
        return found[0]["url"] if found else None

    def summary(self, pattern: str) -> str | None:
        return m[1] if (m := re.search(pattern, self.whole)) else None


Fields = dict[str, Callable[[Page], object]]
_spec = lambda label: lambda p: p.spec(label)
_at = lambda values, k: values[k] if len(values) > k else None

#: Fields of an area page.
AREA: Fields = {
    "kind": lambda p: classify(p.root), "url": lambda p: p.url, "name": lambda p: p.name, "parent_area_name": _spec("Area"), "overview": _spec("Overview"), "developer_raw": _spec("The developer"),
    "also_known_as": _spec("Also known as"), "developer_url": lambda p: p.link("The developer"), "dld_community_code": lambda p: _at(p.codes, 0), "dld_community_name_en": lambda p: _at(p.codes, 1),
    "dld_community_name_ar": lambda p: next((d.text() for d in reversed(p.widget.all("div", "font-din"))), None) if p.widget else None,
    **{field: lambda p, label=label: p.stats.get(label) for label, field in CARDS.items()}, **{field: lambda p, pattern=pattern: p.summary(pattern) for field, pattern in SUMMARY.items()},
    "hero_image_url": lambda p: hero_image(p.root, p.name, p.url), "updated_label": lambda p: next((" ".join(s.split()) for s in p.root.strings() if s.strip().startswith("Updated ")), None),
    "sub_communities": lambda p: sub_communities(p.root, p.url), "building_cards": lambda p: building_cards(p.root, p.url), "transactions": lambda p: transactions(p.root, p.url),
    "documents": lambda p: documents(p.root, p.url), "mentioned_places": lambda p: mentioned_places(p.root, p.url),
}

#: Specification labels of a development page and the fields their texts fill.
DEVELOPMENT = {
    "Area": "area_raw", "Overview": "overview", "The developer": "developer_raw", "Timeline": "timeline_summary", "Units": "units_raw", "Key dates": "key_dates_raw",
    "History": "history", "Project value": "project_value_raw", "Amenities": "amenities_text",
}

#: Fields of a development page.
BUILDING: Fields = {
    "kind": lambda p: classify(p.root), "url": lambda p: p.url, "name": lambda p: p.name, "building_type_raw": lambda p: p.quick.get("Building type"), "raw_status": lambda p: p.quick.get("Status"),
    "storeys_raw": lambda p: p.quick.get("Storeys"), **{field: _spec(label) for label, field in DEVELOPMENT.items()},
    "is_multi_building": lambda p: "multi-building" in (p.quick.get("Building type") or "").lower() or "Sub-buildings" in p.specs,
    "developer_url": lambda p: p.link("The developer"), "master_development_url": lambda p: p.link("Master development"), "sub_buildings": lambda p: p.links("Sub-buildings"), "other_buildings": lambda p: p.links("Other buildings"),
    "official_website": lambda p: p.website(), "plot_reference": lambda p: p.plot(), "hero_image_url": lambda p: hero_image(p.root, p.name, p.url),
    "additional_info": lambda p: [t for d in p.root.all("div", "ps-loc-fact-body") if (t := (d.first("p") or d).text())], "companies": lambda p: companies(p.specs, p.url), "milestones": lambda p: milestones(p.root),
    "timeline": lambda p: timeline(p.root), "transactions": lambda p: transactions(p.root, p.url), "documents": lambda p: documents(p.root, p.url), "mentioned_places": lambda p: mentioned_places(p.root, p.url),
}


def discovered_links(page: str, url: str) -> list[str]:
    """Links of the main part of a page, or of all of it where there is none."""
    root = parse(page)
    return sorted(set((root.first("main") or root).urls(url)))


# -- column functions -------------------------------------------------------------------------------------------------

_TEXT = "string"
_RECORDS = {
    "links": "array<struct<text:string,url:string>>", "sub_communities": "array<struct<name:string,url:string,raw_status:string,image_url:string>>", "building_cards": "array<struct<name:string,url:string,raw_status:string>>",
    "transactions": "array<struct<" + ",".join(f"{f}:string" for f in [*TRANSACTION.values(), "price_raw", "size_raw", "guide_url"]) + ">>", "documents": "array<struct<doc_type:string,label:string,photo_count:int,photo_urls:array<string>>>",
    "mentioned_places": "array<struct<name:string,linked_url:string,context_sentence:string,section:string>>", "companies": "array<struct<role:string,name:string,url:string>>", "milestones": "array<struct<label:string,date_raw:string>>",
    "timeline": "array<struct<date_raw:string,description:string>>", "sub_buildings": "array<struct<text:string,url:string>>", "other_buildings": "array<struct<text:string,url:string>>", "additional_info": "array<string>", "is_multi_building": "boolean",
}


def _schema(fields: list[str]) -> str:
    return "struct<" + ",".join(f"{f}:{_RECORDS.get(f, _TEXT)}" for f in fields) + ">"


def _read(pages: DataFrame, fields: Fields, wanted: list[str], keep: list[str]) -> DataFrame:
    """Columns of pages (url and html among them) with one struct of the wanted fields.

    No expression holds the parse, so no filter that Spark derives from what follows repeats it.
    """
    schema = StructType.fromDDL(f"page {_schema(wanted)}")
    as_arrow, out = to_arrow_schema(schema).field("page").type, StructType([*pages.select(*keep).schema.fields, *schema.fields])
    chosen = {f: fields[f] for f in wanted}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for html, url in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True):
                page = Page(html or "", url or "")
                rows.append({f: value(page) for f, value in chosen.items()})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, as_arrow)], names=[*keep, "page"])

    return pages.select(*dict.fromkeys([*keep, "url", "html"])).mapInArrow(each, out)


def extract(pages: DataFrame, kind: str, fields: list[str] | None = None) -> DataFrame:
    """pages (url, html) with one struct of the records of an area or development page, all or the named ones; the page is parsed once."""
    known = AREA if kind == "area" else BUILDING
    return _read(pages, known, fields or list(known), ["url"])


def areas(pages: DataFrame) -> DataFrame:
    """Typed area rows."""
    records = ("sub_communities", "building_cards", "transactions", "documents", "mentioned_places")
    rows = extract(pages, "area", [f for f in AREA if f not in records]).select("page.*")
    numbers = [*CARDS.values(), *SUMMARY]
    typed = {c: F.coalesce(nz.first_int(c), nz.word_to_int(c).cast("long")) for c in numbers}
    return rows.withColumns(typed).withColumn("area_type", nz.area_type("name"))


def developments(pages: DataFrame) -> DataFrame:
    """Typed development rows; coordinates come from the page's map."""
    keep = ["kind", "name", "building_type_raw", "raw_status", "storeys_raw", *DEVELOPMENT.values(), "is_multi_building", "developer_url", "master_development_url", "official_website", "plot_reference", "hero_image_url"]
    rows = _read(pages, BUILDING, keep, ["url", "html"]).withColumnRenamed("page", "p")
    units, value, at = nz.total_units("p.units_raw"), nz.project_value("p.project_value_raw"), nz.coordinates("html")
    return rows.select("url", *[F.col(f"p.{c}").alias(c) for c in keep], nz.status("p.raw_status").alias("normalized_status"), units["units"].alias("total_units"), value["aed"].alias("project_value_aed"), value["usd"].alias("project_value_usd"), at["lat"].alias("latitude"), at["lng"].alias("longitude"))


def typed_transactions(pages: DataFrame, kind: str = "area") -> DataFrame:
    t = extract(pages, kind, ["transactions"]).select("url", F.inline("page.transactions"))
    comma = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    return t.select("url", "transaction_id", nz.transaction_date("date_raw").alias("transaction_date"), comma("price_raw").alias("price_aed"), nz.money("price_per_sqft_raw").alias("price_per_sqft_aed"), comma("size_raw").alias("size_sqft"), nz.first_int("sellers_raw").alias("sellers"), nz.first_int("buyers_raw").alias("buyers"), "room_type", "property_type", "property_subtype", "transaction_type", "building_name_raw", "project_raw", "area_raw", "guide_url")


def dated(pages: DataFrame, field: str = "milestones") -> DataFrame:
    """Milestones or timeline rows of development pages with their partial date as text."""
    rows = extract(pages, "development", [field]).select("url", F.inline(f"page.{field}"))
    return rows.withColumn("date", nz.fuzzy_date("date_raw"))


def listing(pages: DataFrame, kind: str) -> DataFrame:
    """Amenities or schools of directory pages."""
    one, fields = (amenities, "name string, category string, building_context string, distance_text string") if kind == "amenities" else (schools, "name string, curriculum string, rating string, distance_text string, fees_text string, location_text string")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"url": u} | r for u, h in zip(f["url"], f["html"], strict=True) for r in one(parse(h))]
            yield pd.DataFrame(rows, columns=["url", *[x.split()[0] for x in fields.split(", ")]])

    return pages.select("url", "html").mapInPandas(each, f"url string, {fields}")


def links(pages: DataFrame) -> DataFrame:
    """(source, url) of all links in the main part of pages."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, x) for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True) for x in discovered_links(h or "", u or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["source", "url"])

    return pages.select("url", "html").mapInArrow(each, "source string, url string")


def kinds(pages: DataFrame) -> DataFrame:
    """pages with kind: the supporting page that the url names, else what the breadcrumb says."""
    from quarrylane.functions import urls

    @F.pandas_udf("string")
    def by_content(html: pd.Series) -> pd.Series:
        return html.map(lambda h: classify(parse(h)))

    return pages.withColumn("kind", F.coalesce(urls.area_page("url"), by_content("html")))
