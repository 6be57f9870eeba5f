"""Visible text of HTML as laid out: a tree with implied tags, rules of visibility, blocks, lists and tables."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows

# Fixed values of the HTML standard: kinds of elements by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes video audio canvas "
                   "datalist base link meta param rp area col colgroup".split())
#: Text of a drawing stands in the first; what is in the second is not drawn; nor are a formula's notes.
DRAWN, UNDRAWN = ("text", "foreignobject"), frozenset("defs desc title metadata symbol clippath mask pattern marker".split())
NOTES = ("annotation", "annotation-xml")
#: Start tags that end a drawing or formula, unless they stand in one of the second.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
                   "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol "
                  "optgroup option p plaintext pre search section summary ul xmp".split())
SPACED = frozenset("blockquote dl dir fieldset figure form h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table "
                   "ul xmp".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre "
                   "search section summary table ul xmp".split())
KEEPS_SPACE = frozenset("pre textarea listing plaintext xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROWS = frozenset("tbody thead tfoot".split())
CELLS = frozenset(("td", "th"))
#: An element is not closed across these.
WALL = frozenset("html table td th caption button template marquee applet object".split())
#: Elements that a start tag closes, where no element of the second set lies between.
IMPLIED = {
    "li": ({"li"}, frozenset("ul ol menu dir".split()) | WALL), "dt": ({"dt", "dd"}, frozenset(("dl",)) | WALL),
    "dd": ({"dt", "dd"}, frozenset(("dl",)) | WALL), "option": ({"option"}, frozenset(("select", "optgroup")) | WALL),
    "optgroup": ({"option", "optgroup"}, frozenset(("select",)) | WALL), "button": ({"button"}, WALL - {"button"}),
    "td": ({"td", "th", "caption", "colgroup"}, frozenset(("table", "tr"))),
    "th": ({"td", "th", "caption", "colgroup"}, frozenset(("table", "tr"))),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, frozenset(("table",))),
    **{x: ({"td", "th", "tr", "caption", "colgroup", *ROWS}, frozenset(("table",)))
       for x in (*ROWS, "caption", "colgroup")}}
#: A column wider than this is not padded, nor does a table inside this many others keep its shape.
WIDE, DEEP = 120, 20

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
MARK = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|[{};]""", re.S)
COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|r?em)\s*\)")
#: Pages are laid out on a screen of so many pixels.
SCREEN = 1280
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: its name, attributes and content (text and elements)."""

    __slots__ = ("name", "attributes", "content")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.content = name, attributes, []


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape("".join(values)))
    return out


class Tree:
    """Builds the tree: start tags close what they imply, end tags close what they match."""

    def __init__(self, source: str):
        self.root = Node("body", {})
        self.open, self.styles = [self.root], []
        self.inside: dict[str, int] = {}  # open elements by name
        self.read(source)

    def read(self, source: str) -> None:
        at, n, quotes = 0, len(source), True
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                self.text(source[at:])
                return
            if begin > at:
                self.text(source[at:begin])
            if source.startswith("<!--", begin):
                if source.startswith((">", "->"), begin + 4):
                    at = source.index(">", begin) + 1
                    continue
                end = source.find("-->", begin + 4)
                at = n if end < 0 else end + 3
            elif source.startswith(("<!", "<?"), begin) or source.startswith("</", begin) and not source[begin + 2:begin + 3].isalpha():
                end = source.find(">", begin)
                at = n if end < 0 else end + 1
            elif m := (TAG if quotes else PLAIN_TAG).match(source, begin):
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self.end(name)
                    continue
                foreign = self.inside.get("svg") or self.inside.get("math")
                self.start(name, given := attributes_of(m[3]) if m[3].strip(" /") else {})
                if foreign and m[3].endswith("/") and self.open[-1].name == name:
                    self.close(len(self.open) - 1)
                elif name in RAW or name in ("title", "textarea"):
                    end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                    inside = source[at:end.start() if end else n]
                    if name == "style":
                        if on_screen(given.get("media", "")):
                            self.styles.append(inside)
                    elif name not in RAW or name == "xmp":
                        self.text(inside if name == "xmp" else entities.unescape(inside), ready=True)
                    close = source.find(">", end.start()) if end else -1
                    at = n if close < 0 else close + 1
                    self.end(name)
                elif name == "plaintext":
                    self.text(source[at:], ready=True)
                    return
            elif source[begin + 1:begin + 2].isalpha() or source.startswith("</", begin):
                if quotes and source.find(">", begin) >= 0:
                    quotes = False  # a quote is never closed: from here on quotes mean nothing
                    at = begin
                else:
                    return  # the source ends inside a tag
            else:
                self.text("<")
                at = begin + 1

    def text(self, text: str, ready: bool = False) -> None:
        if not ready and "&" in text:
            text = entities.unescape(text)
        if self.inside.get("svg") and self.find(("svg",), ("foreignobject",)) and (
                not self.find(DRAWN, ("svg",)) or self.find(UNDRAWN, ("svg",))):
            return
        if self.inside.get("math") and self.find(NOTES, ("math",)):
            return
        parent = self.open[-1]
        if parent.name in ("table", "tr") or parent.name in ROWS:
            if not text.strip():
                return
            self.outside_table().content.append(text)
            return
        parent.content.append(text)

    def outside_table(self) -> Node:
        """A place before the innermost table, for what may not stand in one."""
        at = max(i for i, x in enumerate(self.open) if x.name == "table")
        holder, table = self.open[at - 1].content, self.open[at]
        where = max((i for i, x in enumerate(holder) if x is table), default=len(holder))
        if where and isinstance(holder[where - 1], Node) and holder[where - 1].name == "_moved":
            return holder[where - 1]
        moved = Node("_moved", {})
        holder.insert(where, moved)
        return moved

    def find(self, names, wall) -> int:
        """Place of the innermost open element of these names, or 0."""
        if not any(map(self.inside.get, names)):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in names:
                return i
            if self.open[i].name in wall:
                return 0
        return 0

    def close(self, at: int) -> list[Node]:
        """Closes the elements from a place on; returns the formatting ones, which go on in what follows."""
        gone = [x for x in self.open[at + 1:] if x.name in FORMAT]
        for x in self.open[at:]:
            self.inside[x.name] -= 1
        del self.open[at:]
        return gone

    def push(self, name: str, attributes: dict[str, str], parent: Node | None = None) -> None:
        node = Node(name, attributes)
        (parent or self.open[-1]).content.append(node)
        self.open.append(node)
        self.inside[name] = self.inside.get(name, 0) + 1

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in ("html", "body"):
            for k, v in attributes.items():
                self.root.attributes.setdefault(k, v)
            return
        if name == "image":
            name = "img"
        if name in BREAKS and (at := self.find(("svg", "math"), HOLDS_HTML)):
            self.close(at)
        if name == "text" and self.inside.get("svg"):
            attributes = attributes | {"_apart": ""}
        again: list[Node] = []
        if name in ENDS_P and (at := self.find(("p",), WALL)):
            again = self.close(at)
        if name not in ("head", "title", "meta", "link", "script", "style", "base", "noscript", "template") and (
                at := self.find(("head",), ())):
            self.close(at)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.close(len(self.open) - 1)
        if name in ("a", "nobr") and (at := self.find((name,), WALL)):
            self.end(name)
        if name in IMPLIED:
            names, wall = IMPLIED[name]
            while at := self.find(names, wall):
                again = self.close(at)
        if name in CELLS or name == "tr" or name in ROWS or name in ("caption", "colgroup", "col"):
            if not (table := self.find(("table",), ())):
                return  # parts of a table outside one mean nothing
            if name in CELLS and self.open[-1].name != "tr":
                if not self.find(("tr",), ("table",)):
                    self.start("tr", {})
                else:
                    self.close(self.find(("tr",), ("table",)) + 1)
            elif name == "tr" and self.open[-1].name not in ROWS:
                if not self.find(ROWS, ("table",)):
                    self.close(table + 1)
                    self.push("tbody", {})
                else:
                    self.close(self.find(ROWS, ("table",)) + 1)
            again = []
        elif (parent := self.open[-1].name) in ("table", "tr") or parent in ROWS:
            if name == "form":
                return  # one that begins among rows holds nothing
            if name not in HIDDEN and (name != "input" or attributes.get("type", "").lower() != "hidden"):
                if name == "table":  # a table ends the one it stands in
                    self.end("table")
                    self.push(name, attributes)
                elif name in VOID:
                    self.outside_table().content.append(Node(name, attributes))
                else:
                    self.push(name, attributes, self.outside_table())
                return
        if name in VOID:
            self.open[-1].content.append(Node(name, attributes))
            return
        self.push(name, attributes)
        for x in again:
            if name not in ("table", "ul", "ol"):
                self.push(x.name, x.attributes)

    def end(self, name: str) -> None:
        if name in ("body", "html") or name in VOID and name != "br":
            return
        if name == "br":
            self.open[-1].content.append(Node("br", {}))
            return
        if name == "p":
            if at := self.find(("p",), WALL):
                for x in self.close(at):
                    self.push(x.name, x.attributes)
            else:
                self.open[-1].content.append(Node("p", {}))
            return
        if name in HEADINGS:
            at = self.find(HEADINGS, WALL)
        elif name in FORMAT:
            at = self.find((name,), WALL)
            if at and any(x.name not in FORMAT and x.name != "span" for x in self.open[at + 1:]):
                self.inside[name] -= 1
                del self.open[at]  # the blocks inside stay open
                return
        elif name in CELLS or name == "tr" or name in ROWS or name == "caption":
            at = self.find((name,), ("table",))
        else:
            at = self.find((name,), () if name in ("table", "template") else WALL - {name})
        if at:
            for x in self.close(at):
                if name != "table" and name not in CELLS and name not in ROWS and name != "tr":
                    self.push(x.name, x.attributes)


def on_screen(media: str) -> bool:
    """Whether one of the media queries holds; unknown features do not."""
    def holds(query: str) -> bool:
        negated, query = query.startswith("not "), re.sub(r"^(?:not|only)\s+", "", query)
        for part in re.split(r"\s+and\s+|\s+and(?=\()", query):
            if m := WIDTH.fullmatch(part):
                pixels = float(m[2]) * (1 if m[3] == "px" else 16) if m[2].count(".") < 2 else 0.0
                true = SCREEN >= pixels if m[1] == "min" else SCREEN <= pixels
            elif part.startswith("("):
                return False
            else:
                true = part in ("all", "screen")
            if not true:
                return negated
        return not negated

    return not media.strip() or any(holds(q.strip()) for q in media.lower().split(","))


def rules_of(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in order.

    Blocks of ``@media`` that hold, ``@layer`` and ``@supports`` without ``not`` are read; all
    other at-rules are skipped as a whole, and so are rules nested in a rule.
    """
    sheet = re.sub(r"/\*.*?(?:\*/|$)", " ", sheet, flags=re.S).replace("<!--", " ").replace("-->", " ")
    out: list[tuple[str, str]] = []
    open_: list[list] = []  # kind (group, rule or skip), selectors, declarations
    at = 0
    for m in [*MARK.finditer(sheet), None]:
        if m and m[1]:
            continue
        mark, before, at = (m[0] if m else "", sheet[at:m.start() if m else len(sheet)].strip(), m.end() if m else at)
        kind = open_[-1][0] if open_ else "group"
        if mark == "{":
            name, _, given = before.partition(" ")
            name, _, joined = name.partition("(")
            if kind != "group":
                open_.append(["skip", "", ""])
            elif name.lower() == "@media":
                held = on_screen(f"({joined} {given}" if joined else given)
                open_.append(["group" if held else "skip", "", ""])
            elif name.lower() in ("@layer", "@supports"):
                open_.append(["skip" if given.lower().startswith("not") else "group", "", ""])
            else:
                open_.append(["skip" if name.startswith("@") else "rule", before, ""])
            continue
        if kind == "rule":
            open_[-1][2] += before + ";"
        if mark == "}" and open_:
            kind, selectors, body = open_.pop()
            if kind == "rule":
                out.append((selectors, body))
    return out + [(selectors, body) for kind, selectors, body in open_ if kind == "rule"]


class Styles:
    """What style sheets and attributes say about display, visibility and white space.

    Selectors are names, classes and ids, alone or together; those with
    attributes, pseudo-classes or combinators match nothing.
    """

    def __init__(self, sheets: list[str]):
        #: By an id, class or name it needs: ids and classes of a rule in number, place, name, all it needs, what it says.
        self.rules: dict[str, list[tuple]] = {}
        place = 0
        for sheet in sheets:
            for selectors, body in rules_of(sheet):
                wanted = self.declarations(body)
                for selector in selectors.split(",") if wanted else ():
                    if (selector := selector.strip()) and (m := COMPOUND.fullmatch(selector)):
                        name, needs = (m[1] or "*").lower(), frozenset(re.findall(r"[.#][\w-]+", m[2]))
                        ids = sum(x[0] == "#" for x in needs)
                        place += 1
                        self.rules.setdefault(min(needs, default=name), []).append(
                            ((ids, len(needs) - ids, name != "*", place), name, needs, wanted))

    @staticmethod
    def declarations(body: str) -> dict[str, str]:
        out = {}
        for part in body.split(";"):
            name, _, value = part.partition(":")
            if (name := name.strip().lower()) in ("display", "visibility", "white-space"):
                out[name] = value.replace("!important", "").strip().lower()
        return out

    def of(self, node: Node) -> dict[str, str]:
        """Rules by their ids, classes, names and places, then the element's own style; a later one overrides."""
        out: dict[str, str] = {}
        given = node.attributes
        if self.rules:
            has = {*(f".{c}" for c in given.get("class", "").split()), f"#{given.get('id', '')}"}
            found = [r for key in ("*", node.name, *has) for r in self.rules.get(key, ())
                     if r[1] in ("*", node.name) and r[2] <= has]
            for rule in sorted(found, key=lambda r: r[0]):
                out |= rule[3]
        if "style" in given:
            out |= self.declarations(given["style"])
        return out


class Lines:
    """Lines of a block: words collapse, blocks begin new lines, margins merge."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = self.margin = False
        self.indent, self.lead = 0, ""

    def word(self, text: str) -> None:
        """Text whose white space collapses."""
        if not text:
            return
        parts = SPACE.split(text)
        if parts[0] == "" and self.line:
            self.space = True
        words = [p for p in parts if p]
        if words:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(" ".join(words))
            self.space = parts[-1] == ""

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for part in rest:
            self.feed(keep=True)
            if part:
                self.line.append(part)
        self.space = False

    def feed(self, keep: bool = False) -> None:
        """Ends the line; an empty one stays only if ``keep``."""
        if self.line or keep:
            self.whole("".join(self.line).rstrip() if not keep else "".join(self.line))
        self.line, self.space = [], False

    def whole(self, line: str) -> None:
        if self.margin and self.done:
            self.done.append("")
        self.margin = False
        self.done.append((" " * max(0, self.indent - len(self.lead)) + self.lead + line) if line or self.lead else "")
        self.lead = ""

    def block(self, spaced: bool) -> None:
        """A block begins or ends here."""
        self.feed()
        self.margin = self.margin or spaced


def number(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,6})", text or "")
    return int(m[1]) if m else default


def render(source: str) -> str:
    """The visible text of a page.

    Blocks stand on lines of their own, spaced ones after an empty line; items of
    lists have ``*`` or their number and an indent; cells of a table stand in
    padded columns two blanks apart, each row on as many lines as its tallest
    cell.  Hidden are the head, scripts, styles, templates, embedded media, closed
    details, and what ``hidden``, ``display: none`` or ``visibility: hidden`` (in
    an attribute or a rule for the screen, see ``Styles``) hides.  Formulas and the
    text of drawings are shown, and what an object without data or type holds.
    """
    tree = Tree(source)
    out = Lines()
    flow(tree.root, Styles(tree.styles), out, True, False, 0)
    out.feed()
    return "\n".join(out.done).strip("\n")


def flow(root: Node, styles: Styles, out: Lines, shown: bool, kept: bool, depth: int) -> None:
    """Lays out an element.  The stack holds content still to come and what ends after it."""
    stack: list = [(iter((root,)), shown, kept, None, None)]
    lists: list[list] = []
    while stack:
        content, shown, kept, after, owner = stack[-1]
        node = next(content, None)
        if node is None:
            stack.pop()
            if after:
                after()
            continue
        if isinstance(node, str):
            if shown:
                (out.verbatim if kept else out.word)(node)
            continue
        name, given = node.name, node.attributes
        style = styles.of(node) if styles.rules or "style" in given else {}
        display = style.get("display", "")
        if (name in HIDDEN and name != "col" or name == "object" and ("data" in given or "type" in given) or display == "none" or "hidden" in given and not display
                or name == "dialog" and "open" not in given
                or owner is not None and owner.name == "details" and "open" not in owner.attributes and name != "summary"):
            continue
        if (v := style.get("visibility")) in ("hidden", "collapse"):
            shown = False
        elif v == "visible":
            shown = True
        if name in KEEPS_SPACE or style.get("white-space", "").startswith(("pre", "break-spaces")):
            kept = True
        elif "white-space" in style:
            kept = False
        if name == "br":
            if shown:
                out.feed(keep=True)
        elif name == "wbr" or name == "img":
            continue
        elif name == "hr":
            out.block(True)
        elif name == "input":
            if shown and given.get("type", "text").lower() in ("submit", "reset", "button", "text", "search", "email", "url", "tel"):
                out.word(given.get("value", ""))
        elif name == "select":
            options = [x for x in walk(node, "option")]
            chosen = [x for x in options if "selected" in x.attributes] or options[:1]
            if shown:
                for x in chosen:
                    out.word(" " + "".join(y for y in walk(x, None)) + " ")
        elif name == "table" and display in ("", "table", "inline-table") and depth < DEEP:
            out.block(True)
            table(node, styles, out, shown, kept, depth)
            out.block(True)
        else:
            content = iter(node.content)
            if name == "details" and "open" not in given:
                content = iter([x for x in node.content if isinstance(x, Node)])
            if name == "pre" and node.content and isinstance(node.content[0], str) and node.content[0].startswith("\n"):
                content = iter([node.content[0][1:], *node.content[1:]])
            block = display in ("block", "flex", "grid", "list-item", "flow-root") or (
                not display.startswith("inline") and (name in BLOCK or name in ("table", "tr", "caption", "_moved")))
            if not block:
                if name == "q" and shown:
                    out.line.append(" “" if out.space and out.line else "“")
                    out.space = False
                    stack.append((content, shown, kept, lambda: out.line.append("”"), node))
                else:
                    if name in CELLS or "_apart" in given:
                        out.word(" ")
                    stack.append((content, shown, kept, (lambda: out.word(" ")) if "_apart" in given else None, node))
                continue
            nested = name in ("ul", "ol", "menu", "dir") and lists
            out.block(name in SPACED and not nested)
            stack.append((content, shown, kept, enter(name, given, node, out, lists, shown, nested), node))


def enter(name: str, given: dict, node: Node, out: Lines, lists: list, shown: bool, nested: bool):
    """Begins a block; returns what ends it."""
    indent = out.indent
    if name in ("ul", "menu", "dir", "ol"):
        items = [x for x in node.content if isinstance(x, Node) and x.name == "li"]
        down = "reversed" in given
        at = number(given.get("start"), len(items) if down else 1)
        lists.append([name == "ol", at, -1 if down else 1])
    elif name == "li":
        ordered = bool(lists) and lists[-1][0]
        lead = "* "
        if ordered:
            lists[-1][1] = number(given.get("value"), lists[-1][1])
            lead = f"{lists[-1][1]}. "
            lists[-1][1] += lists[-1][2]
        out.indent = indent + len(lead)
        out.lead = (out.lead + lead if out.lead else lead) if shown else out.lead
    elif name in ("blockquote", "dd"):
        out.indent = indent + 4

    def leave() -> None:
        out.feed()
        if name == "li" and out.lead and shown:
            out.lead = out.lead[:max(0, len(out.lead) - (out.indent - indent))]  # an empty item has no line
        if name in ("ul", "menu", "dir", "ol"):
            lists.pop()
        out.indent = indent
        out.block(name in SPACED and not nested)
    return leave


def walk(node: Node, name: str | None):
    """Elements of a name below one, or its texts, in order."""
    stack = [iter(node.content)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            if name is None:
                yield x
        elif x.name == name:
            yield x
        elif x.name not in HIDDEN:
            stack.append(iter(x.content))


def table(node: Node, styles: Styles, out: Lines, shown: bool, kept: bool, depth: int) -> None:
    """Rows of a table as lines of aligned cells; head rows come first, foot rows last."""
    parts: dict[str, list[Node]] = {"caption": [], "thead": [], "tbody": [], "tfoot": []}
    hides = lambda x: "hidden" in x.attributes or styles.of(x).get("display") == "none"
    for x in node.content:
        if isinstance(x, Node) and x.name in parts and not hides(x):
            parts[x.name].append(x)
    for caption in parts["caption"]:
        inner = Node("div", caption.attributes)
        inner.content = caption.content
        flow(inner, styles, out, shown, kept, depth + 1)
    grid: list[dict[int, tuple[list[str], int]]] = []
    below: dict[int, int] = {}
    for part in parts["thead"] + parts["tbody"] + parts["tfoot"]:
        below.clear()  # a cell does not reach beyond its part
        for row in part.content:
            if not isinstance(row, Node) or row.name != "tr" or hides(row):
                continue
            cells, column = {}, 0
            taken = set(below)
            for cell in row.content:
                if not isinstance(cell, Node) or cell.name not in CELLS or hides(cell):
                    continue
                while column in taken:
                    column += 1
                inner, box = Node("div", cell.attributes), Lines()
                inner.content = cell.content
                flow(inner, styles, box, shown, kept, depth + 1)
                box.feed()
                span = min(max(1, number(cell.attributes.get("colspan"), 1)), 1000)
                cells[column] = (box.done, span)
                down = number(cell.attributes.get("rowspan"), 1)
                if down != 1:
                    for c in range(column, column + span):
                        below[c] = (down if down > 1 else 1 << 30)
                column += span
            for c in [c for c in below]:
                below[c] -= 1
                if below[c] <= 0:
                    del below[c]
            grid.append(cells)
    used = sorted({c for cells in grid for c, (lines, _) in cells.items() if any(lines)})
    width = {c: max((len(line) for cells in grid if c in cells and cells[c][1] == 1 for line in cells[c][0]), default=0)
             for c in used}
    for cells in grid:
        for k in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            line, ahead = "", 0
            for c in used:
                if c in cells and k < len(cells[c][0]) and (text := cells[c][0][k]):
                    line = line + " " * max(ahead - len(line), 2 if line else 0) + text
                ahead += width[c] + 2 if width[c] <= WIDE else 2
            if line.strip():
                out.whole(line.rstrip())


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text of every row's page (null or empty: an empty text).

    Repeated rows give repeated rows; other columns are left out.
    """
    return map_rows(df, lambda: lambda page: (render(page or ""),), [html_col], [id_col],
                    [T.StructField("text", T.StringType())])
