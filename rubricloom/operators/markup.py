"""HTML pages to node rows, style rules and accessibility findings.

HTML is no XML and its tree needs a parser with state, so pages go through Arrow batches in Python, each parsed once;
everything after the node table is columns again. A page is one row, so there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the markup rules.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP_TEXT = {"script", "style", "head", "title", "meta", "link", "noscript", "template"}
INTERACTIVE = {"button", "a", "input", "select", "textarea"}
ROLES = {"button", "link", "checkbox", "radio", "switch", "tab", "menuitem"}
GENERIC_LINKS = {"click here", "here", "read more", "more", "link", "this page", "learn more"}
PLACEHOLDER_ALT = {"image", "photo", "icon", "graphic"}
PLACEHOLDER_TITLES = {"untitled", "untitled document", "document", "new page", "page title"}
LANG = re.compile(r"[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*")
COLORS = {
    "black": (0, 0, 0), "silver": (192, 192, 192), "gray": (128, 128, 128), "grey": (128, 128, 128), "white": (255, 255, 255),
    "maroon": (128, 0, 0), "red": (255, 0, 0), "purple": (128, 0, 128), "fuchsia": (255, 0, 255), "green": (0, 128, 0),
    "lime": (0, 255, 0), "olive": (128, 128, 0), "yellow": (255, 255, 0), "navy": (0, 0, 128), "blue": (0, 0, 255),
    "teal": (0, 128, 128), "aqua": (0, 255, 255), "orange": (255, 165, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
    "pink": (255, 192, 203), "brown": (165, 42, 42), "gold": (255, 215, 0), "indigo": (75, 0, 130), "violet": (238, 130, 238),
    "coral": (255, 127, 80), "salmon": (250, 128, 114), "khaki": (240, 230, 140), "plum": (221, 160, 221), "orchid": (218, 112, 214),
    "tan": (210, 180, 140), "beige": (245, 245, 220), "ivory": (255, 255, 240), "lavender": (230, 230, 250), "crimson": (220, 20, 60),
    "chocolate": (210, 105, 30), "darkgray": (169, 169, 169), "darkgrey": (169, 169, 169), "lightgray": (211, 211, 211),
    "lightgrey": (211, 211, 211), "dimgray": (105, 105, 105), "dimgrey": (105, 105, 105), "slategray": (112, 128, 144),
    "slategrey": (112, 128, 144), "steelblue": (70, 130, 180), "skyblue": (135, 206, 235), "royalblue": (65, 105, 225),
    "dodgerblue": (30, 144, 255), "forestgreen": (34, 139, 34), "seagreen": (46, 139, 87), "darkgreen": (0, 100, 0),
    "lightgreen": (144, 238, 144), "firebrick": (178, 34, 34), "indianred": (205, 92, 92), "hotpink": (255, 105, 180),
    "deeppink": (255, 20, 147), "darkorange": (255, 140, 0), "tomato": (255, 99, 71), "darkred": (139, 0, 0), "darkblue": (0, 0, 139),
    "midnightblue": (25, 25, 112), "whitesmoke": (245, 245, 245), "gainsboro": (220, 220, 220), "darkgoldenrod": (184, 134, 11),
}
#: Labels that stand for one action.
CONTROLS = {"commit": ["save", "save changes", "apply", "apply changes", "submit", "confirm", "update", "done"], "cancel": ["cancel", "dismiss", "close", "discard", "discard changes", "never mind", "no thanks"], "back": ["back", "previous", "go back", "return"]}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "line", "id", "parts", "nth", "counts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, line: int, id_: int) -> None:
        self.tag, self.attrs, self.parent, self.line, self.id = tag, attrs, parent, line, id_
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.counts: dict[str, int] = {}
        self.nth = 1

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or x.tag not in SKIP_TEXT:
                todo.extend(reversed(x.parts))
        return " ".join("".join(out).split())

    def own(self) -> str:
        return " ".join("".join(x for x in self.parts if isinstance(x, str)).split())

    def down(self) -> Iterator[Node]:
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def up(self) -> Iterator[Node]:
        n: Node | None = self
        while n is not None:
            yield n
            n = n.parent

    def get(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()


class _Parser(HTMLParser):
    """Void elements are never open; an end tag closes its nearest open match; end tags without one are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None, 0, -1)
        self.at, self.nodes = self.root, []

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        n = Node(tag, {k.lower(): v or "" for k, v in reversed(attrs)}, self.at, self.getpos()[0], len(self.nodes))
        self.nodes.append(n)
        self.at.children.append(n)
        n.nth = self.at.counts[tag] = self.at.counts.get(tag, 0) + 1
        self.at.parts.append(n)
        if tag not in VOID and not closed:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        for n in self.at.up():
            if n.tag == tag and n.parent is not None:
                self.at = n.parent
                return

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str) -> list[Node]:
    """The nodes of a page in document order."""
    p = _Parser()
    p.feed(html)
    p.close()
    return p.nodes


def rules(css: str) -> tuple[list[tuple[tuple, dict[str, str]]], list[str]]:
    """(specificity and order with compound selector, declarations) of a style sheet, and the bodies of its media blocks."""
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    media, out, plain = [], [], []
    depth, start, head = 0, 0, 0
    for i, c in enumerate(css):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                sel, body = css[head:start].strip(), css[start + 1 : i]
                if sel.startswith("@"):
                    if sel.startswith("@media"):
                        media.append(body)
                else:
                    plain.append((sel, body))
                head = i + 1
    for order, (sel, body) in enumerate(plain):
        for one in sel.split(","):
            m = re.fullmatch(r"\s*([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+)*)\s*", one)
            if m and (m.group(1) or m.group(2)):
                ids, classes = re.findall(r"#([\w-]+)", m.group(2)), re.findall(r"\.([\w-]+)", m.group(2))
                tag = (m.group(1) or "").lower().replace("*", "")
                out.append(((len(ids), len(classes), bool(tag), order, tag, tuple(ids), tuple(classes)), declarations(body)))
    return out, media


def declarations(text: str) -> dict[str, str]:
    """Properties in lower case; the last of repeated ones wins."""
    return {k.strip().lower(): v.strip() for k, _, v in (d.partition(":") for d in text.split(";")) if k.strip() and v.strip()}


class Page:
    """A parsed page with its style rules and the look-ups that the checks share."""

    def __init__(self, html: str) -> None:
        self.nodes = parse(html)
        self.ids = {n.get("id") for n in self.nodes if n.get("id")}
        css = "\n".join("".join(p for p in n.parts if isinstance(p, str)) for n in self.nodes if n.tag == "style")
        self.rules, self.media = rules(css)
        self._style: dict[int, dict[str, str]] = {}

    def style(self, n: Node) -> dict[str, str]:
        """Declared properties of a node: rules by specificity and order, then the inline style."""
        if n.parent is None:
            return {}
        if n.id not in self._style:
            classes, own = set(n.get("class").split()), {}
            for key, decl in sorted((r for r in self.rules if (not r[0][4] or r[0][4] == n.tag) and all(i == n.get("id") for i in r[0][5]) and set(r[0][6]) <= classes), key=lambda r: r[0][:4]):
                own |= decl
            self._style[n.id] = own | declarations(n.get("style"))
        return self._style[n.id]

    def ink(self, n: Node) -> tuple[int, int, int] | None:
        """Text colour: the nearest declared one, black where none is; None where it cannot be told."""
        for x in n.up():
            v = self.style(x).get("color", "").lower()
            if v not in ("", "inherit", "initial", "unset", "currentcolor"):
                return color(v)
        return 0, 0, 0

    def ground(self, n: Node | None) -> tuple[int, int, int] | None:
        """Painted colour behind an element: grounds that are absent or clear show the ancestor's, at last white."""
        for x in n.up() if n else ():
            s = self.style(x)
            v = s.get("background-color", "").lower() or color_token(s.get("background", ""))
            if v not in ("", "transparent", "inherit", "initial", "unset"):
                return color(v)
        return 255, 255, 255

    def edge(self, n: Node) -> tuple[int, int, int] | None:
        """Colour of a drawn border or else outline; None without one, or where it has no style or no width."""
        s = self.style(n)
        for side in ("border", "outline"):
            parts = s.get(side, "").lower().split()
            v = s.get(side + "-color", "").lower() or color_token(s.get(side, ""))
            if v:
                style = s.get(side + "-style", "").lower() or next((t for t in parts if t in LINES), "")
                width = s.get(side + "-width", "").lower() or next((t for t in parts if re.fullmatch(r"[\d.]+[a-z%]*", t)), "")
                flat = re.fullmatch(r"0*\.?0*[a-z%]*", width) and any(c == "0" for c in width)
                return None if style in ("none", "hidden") or flat else color(v)
        return None

    def bold(self, n: Node) -> bool:
        for x in n.up():
            v = self.style(x).get("font-weight", "").lower()
            if v in ("bold", "normal"):
                return v == "bold"
            if re.fullmatch(r"[\d.]+", v):
                return float(v) >= 700
            if x.tag in ("b", "strong"):
                return True
        return False

    def hidden(self, n: Node) -> bool:
        return any("hidden" in x.attrs or x.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", x.get("style").lower()) for x in n.up())

    def size(self, n: Node) -> float:
        """Font size in px; relative sizes follow the ancestors."""
        factor = 1.0
        for x in n.up():
            v = self.style(x).get("font-size", "").lower() if x.parent is not None else ""
            m = re.fullmatch(r"([\d.]+)(px|pt|em|rem|%)", v)
            if m:
                k = float(m.group(1))
                if m.group(2) in ("px", "pt", "rem"):
                    return factor * k * {"px": 1.0, "pt": 4 / 3, "rem": 16.0}[m.group(2)]
                factor *= k / 100 if m.group(2) == "%" else k
        return 16.0 * factor


#: Line styles of borders and outlines.
LINES = {"none", "hidden", "solid", "dashed", "dotted", "double", "groove", "ridge", "inset", "outset"}


def color_token(v: str) -> str:
    """The first part of a shorthand that is a colour, in lower case; empty if there is none."""
    v = v.lower()
    if m := re.search(r"rgba?\([^)]*\)", v):
        return m.group(0)
    return next((t for t in v.split() if t[0] == "#" or t in COLORS or t in ("transparent", "currentcolor")), "")


def color(v: str | None) -> tuple[int, int, int] | None:
    """RGB of a hex, rgb() or named colour; the colour token of a shorthand; None where unknown."""
    for t in re.findall(r"#[0-9a-f]{3,8}\b|rgba?\([^)]*\)|[a-z]+", (v or "").lower()):
        if t[0] == "#" and len(t) in (4, 7):
            h = t[1:] if len(t) == 7 else "".join(c * 2 for c in t[1:])
            return int(h[:2], 16), int(h[2:4], 16), int(h[4:], 16)
        if t.startswith("rgb"):
            p = [float(x[:-1]) * 2.55 if x.endswith("%") else float(x) for x in re.findall(r"[\d.]+%?", t)[:3]]
            if len(p) == 3:
                return tuple(min(255, round(x)) for x in p)
        if t in COLORS:
            return COLORS[t]
    return None


def contrast(a: tuple[int, int, int], b: tuple[int, int, int]) -> float:
    """Contrast ratio of two colours by relative luminance."""

    def lum(c: tuple[int, int, int]) -> float:
        r, g, b_ = ((x / 255 / 12.92) if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in c)
        return 0.2126 * r + 0.7152 * g + 0.0722 * b_

    hi, lo = sorted((lum(a), lum(b)), reverse=True)
    return (hi + 0.05) / (lo + 0.05)


def px(v: str | None) -> float | None:
    m = re.fullmatch(r"\s*([\d.]+)\s*(px|pt)\s*", (v or "").lower())
    return float(m.group(1)) * (1.0 if m.group(2) == "px" else 4 / 3) if m else None


Finding = tuple[str, int, int, str]
_CHECKS: list[Callable[[Page], Iterator[tuple[str, int | None, Node | None, str]]]] = []


def _check(f):
    _CHECKS.append(f)
    return f


@_check
def _alternatives(p: Page):
    for n in p.nodes:
        kind = n.tag in ("img", "area") or n.tag == "input" and n.get("type").lower() == "image" or n.get("role").lower() == "img"
        if not kind or p.hidden(n) or n.get("role").lower() in ("presentation", "none") or n.get("aria-label") or n.get("aria-labelledby"):
            continue
        if n.get("role").lower() == "img" and n.tag not in ("img", "area", "input"):
            yield "WCAG-1.1.1", None, n, "no text alternative"
        elif "alt" not in n.attrs:
            yield "WCAG-1.1.1", None, n, "no alt"
        elif n.get("alt").lower() in PLACEHOLDER_ALT or re.fullmatch(r"\S+\.(png|jpe?g|gif|svg|webp|bmp)", n.get("alt").lower()):
            yield "WCAG-1.1.1", None, n, n.get("alt")


@_check
def _structure(p: Page):
    before = 0
    for n in p.nodes:
        if re.fullmatch("h[1-6]", n.tag) and not p.hidden(n):
            level = int(n.tag[1])
            if before and level > before + 1:
                yield "WCAG-1.3.1", None, n, f"level {before} to {level}"
            before = level
        elif n.tag == "table" and n.get("role").lower() not in ("presentation", "none"):
            rows = [[c for c in r.children if c.tag in ("td", "th")] for r in n.down() if r.tag == "tr"]
            cells = [c for r in rows for c in r]
            if len(rows) >= 2 and max(map(len, rows)) >= 2 and not any(c.tag == "th" or c.get("scope") or c.get("headers") for c in cells):
                yield "WCAG-1.3.1", 3, n, "table without header cells"


@_check
def _text_contrast(p: Page):
    for n in p.nodes:
        if n.tag in SKIP_TEXT or not any(isinstance(x, str) and x.strip() for x in n.parts) or p.hidden(n):
            continue
        a, b = p.ink(n), p.ground(n)
        if a and b:
            size, bold = p.size(n), p.bold(n)
            need, have = 3.0 if size >= 24 or size >= 18.66 and bold else 4.5, contrast(a, b)
            if have < need - 1e-9:
                yield "WCAG-1.4.3", 3 if need - have > 1.0 else 2, n, f"{have:.2f} of {need}"


@_check
def _zoom(p: Page):
    for n in p.nodes:
        if n.tag == "meta" and n.get("name").lower() == "viewport":
            s = dict(re.findall(r"([\w-]+)\s*=\s*([\w.]+)", n.get("content").lower()))
            if s.get("user-scalable") in ("no", "0"):
                yield "WCAG-1.4.4", 3, n, n.get("content")
            elif re.fullmatch(r"[\d.]+", s.get("maximum-scale", "")) and float(s["maximum-scale"]) < 2:
                yield "WCAG-1.4.4", 2, n, n.get("content")
            return


@_check
def _boxes(p: Page):
    for n in p.nodes:
        if n.tag in ("html", "head", "meta", "title", "style", "script") or p.hidden(n):
            continue
        s = p.style(n)
        w = px(s.get("width"))
        if w and w > 320 and not re.search(r"%|v[wh]", s.get("max-width", "")) and not any(re.search(r"width", m) and (f".{c}" in m for c in n.get("class").split() or ["-"]) for m in p.media if n.tag in m or any(f".{c}" in m for c in n.get("class").split())):
            yield "WCAG-1.4.10", 3 if w >= 600 else 2, n, f"{w:g}px wide"
        if px(s.get("height") or s.get("max-height")) is not None and (s.get("overflow") or s.get("overflow-y", "")).lower() in ("hidden", "clip") and n.text():
            yield "WCAG-1.4.12", None, n, "fixed height with clipped text"
        if (n.tag in INTERACTIVE or n.get("role").lower() in ROLES) and not (n.tag == "a" and not n.attrs.get("href")):
            edge, ground = p.edge(n), p.ground(n.parent)
            if edge and ground and (c := contrast(edge, ground)) < 3.0 - 1e-9:
                yield "WCAG-1.4.11", 3 if c < 2.0 else 2, n, f"{c:.2f} of 3.0"


@_check
def _bypass(p: Page):
    if not any(n.tag in ("html", "body") for n in p.nodes) or any(n.tag == "main" or n.get("role").lower() == "main" for n in p.nodes):
        return
    links = [n for n in p.nodes if n.tag == "a" and n.attrs.get("href")]
    if links and links[0].attrs["href"].startswith("#") and links[0].attrs["href"][1:] in p.ids:
        return
    heading = next((n.id for n in p.nodes if re.fullmatch("h[1-6]", n.tag)), len(p.nodes))
    k = sum(n.id < heading and n.tag in INTERACTIVE and not (n.tag == "a" and not n.attrs.get("href")) and not p.hidden(n) for n in p.nodes)
    scope = next((n for n in p.nodes if n.tag == "body"), None) or next(n for n in p.nodes if n.tag == "html")
    yield "WCAG-2.4.1", 3 if k >= 2 else 2, scope, f"{k} stops before the first heading"


@_check
def _title_and_language(p: Page):
    html = next((n for n in p.nodes if n.tag == "html"), None)
    if html is None:
        return
    title = next((n for n in p.nodes if n.tag == "title"), None)
    text = title.text() if title else ""
    if not text:
        yield "WCAG-2.4.2", 3, title or html, "no title"
    elif text.lower() in PLACEHOLDER_TITLES:
        yield "WCAG-2.4.2", 2, title, text
    if not LANG.fullmatch(html.get("lang")):
        other = any(n is not html and LANG.fullmatch(n.get("lang")) for n in p.nodes)
        yield "WCAG-3.1.1", 2 if other else 3, html, html.get("lang") or "no lang"


@_check
def _links_and_names(p: Page):
    for n in p.nodes:
        if p.hidden(n):
            continue
        if n.tag == "a" and n.get("href") and n.text().lower().rstrip(".!…") in GENERIC_LINKS and not (n.get("aria-label") or n.get("aria-labelledby") or n.get("title")):
            yield "WCAG-2.4.4", None, n, n.text()
        if (n.tag in INTERACTIVE or n.get("role").lower() in ROLES) and n.get("aria-label") and n.text() and " ".join(n.text().lower().split()) not in " ".join(n.get("aria-label").lower().split()):
            yield "WCAG-2.5.3", None, n, n.get("aria-label")


@_check
def _labels(p: Page):
    named = {n.get("for") for n in p.nodes if n.tag == "label" and n.get("for")}
    for n in p.nodes:
        field = n.tag in ("select", "textarea") or n.tag == "input" and n.get("type").lower() not in ("hidden", "submit", "button", "reset", "image")
        if not field or p.hidden(n):
            continue
        if n.get("id") in named or any(x.tag == "label" for x in n.up()) or n.get("aria-label") or n.get("title") or set(n.get("aria-labelledby").split()) & p.ids:
            continue
        yield "WCAG-3.3.2", None, n, n.get("name") or n.tag


@_check
def _control_names(p: Page):
    used: dict[str, dict[str, Node]] = {}
    for n in p.nodes:
        raw = n.text() if n.tag == "button" or n.tag == "a" and n.get("href") else n.get("value") if n.tag == "input" and n.get("type").lower() in ("submit", "button", "reset") else ""
        label = " ".join(re.sub(r"(?:\.\.\.|…)\s*$", "", raw.strip()).strip(" .,:;!?\"'“”‘’").casefold().split())
        for group, names in CONTROLS.items():
            if label in names:
                used.setdefault(group, {}).setdefault(label, n)
    for labels in used.values():
        if len(labels) >= 2:
            for label, n in labels.items():
                yield "NNG-H4-CONTROL-NAMING", 3 if len(labels) >= 3 else 2, n, label


#: Boxes whose controls are judged together.
BOXES, BOX_ROLES = {"form", "nav"}, {"toolbar", "menu", "menubar"}
_NO_FIELD = {"hidden", "submit", "button", "reset", "image"}


@_check
def _dead_ends(p: Page):
    """States (sections with an id, two or more) that link to no other state."""
    states: dict[str, Node] = {}
    for n in p.nodes:
        if n.tag == "section" and n.get("id"):
            states.setdefault(n.get("id"), n)
    if len(states) < 2:
        return
    state_of = lambda n: next((x.get("id") for x in n.up() if x.parent is not None and x is not n and x.tag == "section" and x.get("id")), None)
    jumps = [(state_of(n), n.get("href")[1:]) for n in p.nodes if n.tag == "a" and n.get("href")[:1] == "#"]
    jumps = [(a, b) for a, b in jumps if a and b in states and a != b]
    for name, n in states.items():
        if not any(a == name for a, _ in jumps):
            k = sum(b == name for _, b in jumps)
            yield "NNG-H3-DEADEND", 3 if k else 2, n, f"no way on, {k} ways in"


@_check
def _names_on_screen(p: Page):
    """Controls and fields without a visible or accessible name; 3 where a whole box of controls has none."""
    texts = {n.get("for"): n.text() for n in p.nodes if n.tag == "label" and n.get("for") and n.text()}
    found = []
    for n in p.nodes:
        if n.tag == "button" or n.tag == "a" and n.get("href") or n.tag != "a" and n.get("role").lower() in ("button", "link", "menuitem"):
            ok = bool(n.text() or n.get("aria-label") or n.get("aria-labelledby") or n.get("title"))
        elif n.tag in ("select", "textarea") or n.tag == "input" and n.get("type").lower() not in _NO_FIELD:
            around = next((x for x in n.up() if x.tag == "label"), None)
            ok = n.get("id") in texts or around is not None and bool(around.text())
        else:
            continue
        box = next((x.id for x in n.up() if x is not n and x.parent is not None and (x.tag in BOXES or x.get("role").lower() in BOX_ROLES)), -1)
        found.append((n, ok, box))
    named = {box for _, ok, box in found if ok}
    for n, ok, box in found:
        if not ok:
            yield "NNG-H6-LABELED", 2 if box in named else 3, n, n.tag


def place(n: Node) -> str:
    """An element by its id, else by its path of tags with positions among like siblings."""
    if n.get("id"):
        return "#" + n.get("id")
    out = []
    for x in n.up():
        if x.parent is None:
            break
        out.append(x.tag if x.parent.counts[x.tag] == 1 else f"{x.tag}:nth-of-type({x.nth})")
    return " > ".join(reversed(out))


def findings(html: str) -> list[tuple[str, int, str, int, str]]:
    """(criterion, severity, place, line, evidence); where the rule sets no severity, two or more of it make it 3."""
    page = Page(html)
    found = [(c, s, place(n) if n else "page", n.line if n else 0, e) for f in _CHECKS for c, s, n, e in f(page)]
    count: dict[str, int] = {}
    for c, *_ in found:
        count[c] = count.get(c, 0) + 1
    return [(c, s or (3 if count[c] >= 2 else 2), w, line, e) for c, s, w, line, e in found]


_NODES = "doc_id bigint, node_id int, parent_id int, depth int, tag string, attrs map<string,string>, text string, line int, place string"


def _html(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return df.where(F.ltrim(t).startswith("<")).select(F.col(key).cast("long").alias("doc_id"), t.alias("text"))


def nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each element of each page (texts that start with <), in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n.id, n.parent.id, sum(1 for _ in n.up()) - 2, n.tag, list(n.attrs.items()), n.own(), n.line, place(n)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in parse(t)]
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "node_id", "parent_id", "depth", "tag", "attrs", "text", "line", "place"])

    return _html(df, key, text).mapInArrow(run, _NODES)


def check(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Accessibility and control-naming findings of all pages; broken markup never fails a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *f) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in findings(t)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "criterion", "severity", "location", "line", "evidence"])

    return _html(df, key, text).mapInArrow(run, "doc_id bigint, criterion string, severity int, location string, line int, evidence string")
