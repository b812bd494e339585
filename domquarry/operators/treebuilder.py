"""Tree construction: tokens to a tree, as browsers do it, by insertion modes.

Each mode is a method of ``TreeBuilder`` that gets a token. What this builder leaves out on purpose: ``template``, scripts that
run, namespaces of attributes. ``noscript`` is raw text (scripting counts as on); elements inserted in foreign content are never
foster-parented.
"""

from __future__ import annotations

from .tokenizer import SPACE, Tokenizer, lower


class Node:
    __slots__ = ("kind", "tag", "ns", "attrs", "data", "parent", "children", "public_id", "system_id")

    def __init__(self, kind: str, tag: str | None = None, ns: str | None = None, attrs: dict | None = None, data: str | None = None, public_id: str | None = None, system_id: str | None = None):
        self.kind, self.tag, self.ns, self.attrs, self.data = kind, tag, ns, attrs, data
        self.public_id, self.system_id = public_id, system_id
        self.parent: Node | None = None
        self.children: list[Node] = []

    def insert(self, at: int, child: Node) -> None:
        """Moves the child there from where it is."""
        if child.parent is not None:
            if child.parent is self and self.children.index(child) < at:
                at -= 1
            child.parent.children.remove(child)
        child.parent = self
        self.children.insert(at, child)

    def append(self, child: Node) -> None:
        if child.parent is not None:
            child.parent.children.remove(child)
        child.parent = self
        self.children.append(child)

    def insert_text(self, at: int, text: str) -> None:
        """Text merges into text that stands before."""
        if at and self.children[at - 1].kind == "text":
            self.children[at - 1].data += text
        else:
            self.insert(at, Node("text", data=text))


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


HEADINGS = _set("h1 h2 h3 h4 h5 h6")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
TABLE_PARTS = _set("table tbody tfoot thead tr")
CELLS_AND_ROWS = _set("caption col colgroup tbody td tfoot th thead tr")
HEAD_CONTENT = _set("base basefont bgsound link meta noframes script style title")
BLOCKS = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main nav ol p section summary ul")
ENDED_BLOCKS = (BLOCKS - {"p"}) | _set("button listing menu pre")
IMPLIED = _set("dd dt li menuitem optgroup option p rp rt")
SPECIAL = _set(
    """ul ol dl dir menu table caption colgroup col thead tbody tfoot tr td th form fieldset select input button textarea isindex keygen
    p div center blockquote pre listing plaintext xmp address article aside details figcaption figure footer header hgroup main nav section
    summary h1 h2 h3 h4 h5 h6 li dd dt body html head title style script link meta base basefont bgsound noscript noframes noembed frame
    frameset iframe applet marquee object embed img area br hr wbr param source track menuitem"""
) - {"isindex"}
MATH_SPECIAL = _set("mi mo mn ms mtext annotation-xml")
SVG_SPECIAL = _set("foreignObject desc title")
SCOPE = _set("applet caption html marquee object table td th")
MATH_TEXT = _set("mi mn mo ms mtext")
BREAKOUT = _set(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby
    s small span strong strike sub sup table tt u ul var"""
)
_SVG_TAGS = {
    x.lower(): x
    for x in """altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite
    feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge
    feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient
    radialGradient textPath""".split()
}
_SVG_ATTRS = {
    x.lower(): x
    for x in """attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform
    gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth
    maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha
    preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent
    spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget
    xChannelSelector yChannelSelector zoomAndPan""".split()
}
_HOT, _ONTO, _OREILLY = "DTD HoTMetaL PRO", "extensions to HTML 4.0", "O'Reilly and Associates//DTD HTML"
_QUIRKY_OF = {
    "IETF": [f"HTML {v}" for v in ("2.0", "2.1E", "3", "3.0", "3.2", "3.2 Final", "Strict", *(f"{k}Level {n}" for k in ("", "Strict ") for n in range(4)))]
    + [f"HTML 2.0 {k}" for k in ("Level 1", "Level 2", "Strict", "Strict Level 1", "Strict Level 2")] + ["HTML"],
    "Microsoft": [f"Internet Explorer {v}.0 {k}" for v in (2, 3) for k in ("HTML", "HTML Strict", "Tables")],
    "Netscape Comm. Corp.": ["HTML", "Strict HTML"],
    "Sun Microsystems Corp.": [f"HotJava {k}HTML" for k in ("", "Strict ")],
    "W3C": ["W3 HTML", *(f"HTML {v}" for v in ("3 1995-03-24", "4.0 Frameset", "4.0 Transitional")), *(f"HTML 3.2{v}" for v in ("", "S Draft", " Draft", " Final")), *(f"HTML Experimental {v}" for v in (970421, 19960712))],
    "W3O": ["W3 HTML 3.0"],
    "WebTechs": [f"Mozilla HTML{v}" for v in ("", " 2.0")],
    "Spyglass": ["HTML 2.0 Extended"],
    "SQ": ["HTML 2.0 HoTMetaL + extensions"],
    "Metrius": ["Metrius Presentational"],
    **dict.fromkeys(("AS", "AdvaSoft Ltd"), ["HTML 3.0 asWedit + extensions"]),
}
_QUIRKY = (
    "+//Silmaril//dtd html Pro v0r11 19970101//",
    *(f"-//{owner}//DTD {kind}//" for owner, kinds in _QUIRKY_OF.items() for kind in kinds),
    *(f"-//{_OREILLY} {kind}//" for kind in ("2.0", *(f"Extended {r}1.0" for r in ("", "Relaxed ")))),
    f"-//SoftQuad Software//{_HOT} 6.0::19990601::{_ONTO}//",
    f"-//SoftQuad//{_HOT} 4.0::19971010::{_ONTO}//",
)
_LOOSE_401 = ("-//W3C//DTD HTML 4.01 Frameset//", "-//W3C//DTD HTML 4.01 Transitional//")
_LOOSE_XHTML = ("-//W3C//DTD XHTML 1.0 Frameset//", "-//W3C//DTD XHTML 1.0 Transitional//")
_KNOWN_TYPES = {
    ("-//W3C//DTD HTML 4.0//EN", None), ("-//W3C//DTD HTML 4.0//EN", "http://www.w3.org/TR/REC-html40/strict.dtd"), ("-//W3C//DTD HTML 4.01//EN", None),
    ("-//W3C//DTD HTML 4.01//EN", "http://www.w3.org/TR/html4/strict.dtd"), ("-//W3C//DTD XHTML 1.0 Strict//EN", "http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd"),
    ("-//W3C//DTD XHTML 1.1//EN", "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd"),
}
RAW_CONTEXTS = {"title": "rcdata", "textarea": "rcdata", **dict.fromkeys(("style", "xmp", "iframe", "noembed", "noframes", "noscript"), "rawtext"), "script": "script", "plaintext": "plaintext"}


def quirks_of(name: str | None, public: str | None, system: str | None, forced: bool) -> str:
    p = public or ""
    if forced or name != "html" or p.startswith(_QUIRKY) or p in ("-//W3O//DTD W3 HTML Strict 3.0//EN//", "-/W3C/DTD HTML 4.0 Transitional/EN", "HTML"):
        return "quirks"
    if system == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or (system is None and p.startswith(_LOOSE_401)):
        return "quirks"
    return "limited" if p.startswith(_LOOSE_XHTML) or p.startswith(_LOOSE_401) else "no"


class Restart(Exception):
    """A meta element names another encoding than the one the bytes were read with."""


def _split_space(s: str) -> tuple[str, str]:
    rest = s.lstrip(SPACE)
    return s[: len(s) - len(rest)], rest


class TreeBuilder:
    def __init__(self, text: str, context: tuple[str, str] | None = None, on_meta=None):
        """context: (tag, namespace) of a fragment's context element. on_meta: gets a meta's attributes while it is not certain
        which encoding the text has; it may raise Restart."""
        self.document = Node("document")
        self.quirks = "no"
        self.errors: list[str] = []
        self.open: list[Node] = []
        self.active: list[Node | None] = []  # None is a marker
        self.head: Node | None = None
        self.form: Node | None = None
        self.frameset_ok, self.foster, self.skip_newline, self.stopped = True, False, False, False
        self.pending: list[str] = []
        self.mode = self.original = self.initial
        self.context = Node("element", lower(context[0]) if context[1] == "html" else context[0], context[1], {}) if context else None
        self.on_meta = on_meta
        state = RAW_CONTEXTS.get(self.context.tag, "data") if context and context[1] == "html" else "data"
        self.tokens = Tokenizer(text, state, allows_cdata=self._in_foreign)

    # ---- running

    def run(self) -> TreeBuilder:
        if self.context is not None:
            root = Node("element", "html", "html", {})
            self.document.append(root)
            self.open.append(root)
            self.reset_mode()
        while not self.stopped and (token := self.tokens.next()) is not None:
            self.take(token)
        if not self.stopped:
            self.take(("eof",))
        if self.context is not None:
            root = self.open[0] if self.open else self.document.children[0]
            for child in list(root.children):
                self.document.append(child)
            self.document.children.remove(root)
            root.parent = None
        return self

    def take(self, token: tuple) -> None:
        if token[0] == "error":
            self.errors.append("Tokenizer: " + token[1])
            return
        if self.skip_newline:
            self.skip_newline = False
            if token[0] == "chars" and token[1].startswith("\n"):
                if len(token[1]) == 1:
                    return
                token = ("chars", token[1][1:])
        self.dispatch(token)

    def dispatch(self, token: tuple) -> None:
        node = self.adjusted
        kind = token[0]
        if node is None or node.ns == "html" or kind == "eof":
            self.mode(token)
        elif node.ns == "math" and node.tag in MATH_TEXT and (kind == "chars" or (kind == "start" and token[1] not in ("mglyph", "malignmark"))):
            self.mode(token)
        elif (node.ns == "math" and node.tag == "annotation-xml" and kind == "start" and token[1] == "svg") or (_html_point(node) and kind in ("start", "chars")):
            self.mode(token)
        else:
            self.foreign(token)

    @property
    def current(self) -> Node | None:
        return self.open[-1] if self.open else None

    @property
    def adjusted(self) -> Node | None:
        return self.context if self.context is not None and len(self.open) == 1 else self.current

    def _in_foreign(self) -> bool:
        return self.adjusted is not None and self.adjusted.ns != "html"

    def error(self, message: str) -> None:
        self.errors.append(message)

    # ---- the stack

    def is_open(self, node: Node | None) -> bool:
        return any(x is node for x in reversed(self.open))

    def in_scope(self, *tags: str, extra: tuple[str, ...] = ()) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if _bounds(node, extra):
                return False
        return False

    def in_button_scope(self, tag: str) -> bool:
        return self.in_scope(tag, extra=("button",))

    def in_table_scope(self, *tags: str) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.ns == "html" and node.tag in ("html", "table"):
                return False
        return False

    def in_select_scope(self) -> bool:
        for node in reversed(self.open):
            if node.tag == "select":
                return True
            if not (node.ns == "html" and node.tag in ("optgroup", "option")):
                return False
        return False

    def node_in_scope(self, wanted: Node | None) -> bool:
        for node in reversed(self.open):
            if node is wanted:
                return True
            if _bounds(node, ()):
                return False
        return False

    def pop_until(self, *tags: str) -> None:
        while self.open and self.open.pop().tag not in tags:
            pass

    def pop_to(self, node: Node) -> None:
        while self.open and self.open.pop() is not node:
            pass

    def unstack(self, node: Node | None) -> None:
        self.open = [x for x in self.open if x is not node]

    def imply_ends(self, but: str | None = None) -> None:
        while self.open and self.open[-1].tag in IMPLIED and self.open[-1].tag != but:
            self.open.pop()

    def close_p(self) -> None:
        self.imply_ends("p")
        if self.current.tag != "p":
            self.error("closing a p that is not current")
        self.pop_until("p")

    def close_p_in_button_scope(self) -> None:
        if self.in_button_scope("p"):
            self.close_p()

    # ---- insertion

    def place(self, target: Node | None = None) -> tuple[Node, int]:
        target = target or self.current or self.document
        if self.foster and target.tag in TABLE_PARTS:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == "table"), None)
            if at is None:
                return self.open[0], len(self.open[0].children)
            table = self.open[at]
            if table.parent is not None and table.parent.kind == "element":
                own = table.parent.children  # the table mostly is the last
                return table.parent, next(i for i in range(len(own) - 1, -1, -1) if own[i] is table)
            before = self.open[at - 1]
            return before, len(before.children)
        return target, len(target.children)

    def insert(self, tag: str, attrs: dict | None = None, ns: str = "html") -> Node:
        node = Node("element", tag, ns, dict(attrs or {}))
        parent, at = self.place()
        parent.insert(at, node)
        self.open.append(node)
        return node

    def insert_void(self, token: tuple) -> None:
        self.insert(token[1], token[2])
        self.open.pop()

    def text(self, s: str) -> None:
        if s:
            parent, at = self.place()
            if parent.kind != "document":
                parent.insert_text(at, s)

    def comment(self, data: str, parent: Node | None = None) -> None:
        where, at = (parent, len(parent.children)) if parent is not None else self.place()
        where.insert(at, Node("comment", data=data))

    def raw(self, token: tuple, state: str) -> None:
        self.insert(token[1], token[2])
        self.tokens.state = state
        self.original, self.mode = self.mode, self.in_text

    # ---- active formatting elements

    def push_active(self, node: Node) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            x = self.active[i]
            if x is None:
                break
            if x.tag == node.tag and x.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(node)

    def forget(self, node: Node) -> None:
        self.active = [x for x in self.active if x is not node]

    def active_index(self, node: Node | None) -> int:
        return next((i for i, x in enumerate(self.active) if x is node and x is not None), -1)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.is_open(self.active[-1]):
            return
        i = len(self.active) - 1
        while i and not (self.active[i - 1] is None or self.is_open(self.active[i - 1])):
            i -= 1
        for j in range(i, len(self.active)):
            old = self.active[j]
            self.active[j] = self.insert(old.tag, old.attrs)

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    # ---- modes

    def initial(self, token: tuple) -> None:
        kind = token[0]
        if kind == "chars":
            rest = _split_space(token[1])[1]
            if not rest:
                return
            token = ("chars", rest)
        elif kind == "comment":
            return self.comment(token[1], self.document)
        elif kind == "doctype":
            _, name, public, system, forced = token
            if not (name == "html" and (public, system) in _KNOWN_TYPES or name == "html" and public is None and system in (None, "about:legacy-compat")):
                self.error("unusual document type")
            self.document.append(Node("doctype", tag=name or "", public_id=public or "", system_id=system or ""))
            self.quirks = quirks_of(name, public, system, forced)
            self.mode = self.before_html
            return None
        self.error("no document type")
        self.quirks = "quirks"
        self.mode = self.before_html
        return self.dispatch(token)

    def before_html(self, token: tuple) -> None:
        kind = token[0]
        if kind == "doctype":
            return self.error("document type out of place")
        if kind == "comment":
            return self.comment(token[1], self.document)
        if kind == "chars":
            rest = _split_space(token[1])[1]
            if not rest:
                return None
            token = ("chars", rest)
        if kind == "start" and token[1] == "html":
            node = Node("element", "html", "html", dict(token[2]))
            self.document.append(node)
            self.open.append(node)
            self.mode = self.before_head
            return None
        if kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return self.error("end tag before html")
        node = Node("element", "html", "html", {})
        self.document.append(node)
        self.open.append(node)
        self.mode = self.before_head
        return self.dispatch(token)

    def before_head(self, token: tuple) -> None:
        kind = token[0]
        if kind == "chars":
            rest = _split_space(token[1])[1]
            if not rest:
                return None
            token = ("chars", rest)
        elif kind == "comment":
            return self.comment(token[1])
        elif kind == "doctype":
            return self.error("document type out of place")
        elif kind == "start" and token[1] == "html":
            return self.in_body(token)
        elif kind == "start" and token[1] == "head":
            self.head = self.insert("head", token[2])
            self.mode = self.in_head
            return None
        elif kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return self.error("end tag before head")
        self.head = self.insert("head")
        self.mode = self.in_head
        return self.dispatch(token)

    def in_head(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars":
            space, rest = _split_space(tag)
            self.text(space)
            if not rest:
                return None
            token = ("chars", rest)
        elif kind == "comment":
            return self.comment(tag)
        elif kind == "doctype":
            return self.error("document type out of place")
        elif kind == "start":
            if tag == "html":
                return self.in_body(token)
            if tag in ("base", "basefont", "bgsound", "link"):
                return self.insert_void(token)
            if tag == "meta":
                self.insert_void(token)
                if self.on_meta:
                    self.on_meta(self, token[2])
                return None
            if tag == "title":
                return self.raw(token, "rcdata")
            if tag in ("noscript", "noframes", "style"):
                return self.raw(token, "rawtext")
            if tag == "script":
                return self.raw(token, "script")
            if tag == "head":
                return self.error("head inside head")
        elif kind == "end":
            if tag == "head":
                self.open.pop()
                self.mode = self.after_head
                return None
            if tag not in ("body", "html", "br"):
                return self.error("end tag inside head")
        self.open.pop()
        self.mode = self.after_head
        return self.dispatch(token)

    def after_head(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars":
            space, rest = _split_space(tag)
            self.text(space)
            if not rest:
                return None
            token = ("chars", rest)
        elif kind == "comment":
            return self.comment(tag)
        elif kind == "doctype":
            return self.error("document type out of place")
        elif kind == "start":
            if tag == "html":
                return self.in_body(token)
            if tag == "body":
                self.insert("body", token[2])
                self.frameset_ok = False
                self.mode = self.in_body
                return None
            if tag == "frameset":
                self.insert("frameset", token[2])
                self.mode = self.in_frameset
                return None
            if tag in HEAD_CONTENT:
                self.error("head content after head")
                self.open.append(self.head)
                self.in_head(token)
                self.unstack(self.head)
                return None
            if tag == "head":
                return self.error("second head")
        elif kind == "end" and tag not in ("body", "html", "br"):
            return self.error("end tag after head")
        self.insert("body")
        self.mode = self.in_body
        return self.dispatch(token)

    def in_body(self, token: tuple) -> None:
        kind = token[0]
        if kind == "chars":
            s = token[1]
            if "\0" in s:
                for _ in range(s.count("\0")):
                    self.error("NUL in body")
                s = s.replace("\0", "")
            if s:
                self.reconstruct()
                self.text(s)
                if s.strip(SPACE + "\r"):
                    self.frameset_ok = False
        elif kind == "start":
            self.body_start(token)
        elif kind == "end":
            self.body_end(token)
        elif kind == "comment":
            self.comment(token[1])
        elif kind == "doctype":
            self.error("document type out of place")
        else:
            for node in self.open:
                if node.tag not in ("dd", "dt", "li", "p", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"):
                    self.error("element still open at the end of input")
                    break
            self.stopped = True

    def _merge(self, node: Node, attrs: dict) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    def body_start(self, token: tuple) -> None:
        _, tag, attrs, closing = token
        current = self.current
        if tag in BLOCKS:
            self.close_p_in_button_scope()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            self._formatting_start(tag, attrs, token)
        elif tag in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.insert_void(token)
            self.frameset_ok = False
        elif tag == "li":
            self._list_item(tag, attrs, ("li",))
        elif tag in ("dd", "dt"):
            self._list_item(tag, attrs, ("dd", "dt"))
        elif tag in HEADINGS:
            self.close_p_in_button_scope()
            if self.current.tag in HEADINGS:
                self.error("heading inside heading")
                self.open.pop()
            self.insert(tag, attrs)
        elif tag == "html":
            self.error("second html")
            self._merge(self.open[0], attrs)
        elif tag in HEAD_CONTENT:
            self.in_head(token)
        elif tag == "body":
            self.error("second body")
            if len(self.open) > 1 and self.open[1].tag == "body":
                self.frameset_ok = False
                self._merge(self.open[1], attrs)
        elif tag == "frameset":
            self.error("frameset in body")
            if len(self.open) > 1 and self.open[1].tag == "body" and self.frameset_ok:
                body = self.open[1]
                if body.parent is not None:
                    body.parent.children.remove(body)
                    body.parent = None
                del self.open[1:]
                self.insert(tag, attrs)
                self.mode = self.in_frameset
        elif tag in ("menu", "hr"):
            self.close_p_in_button_scope()
            if self.current.tag == "menuitem":
                self.open.pop()
            self.insert(tag, attrs)
            if tag == "hr":
                self.open.pop()
                self.frameset_ok = False
        elif tag in ("pre", "listing"):
            self.close_p_in_button_scope()
            self.insert(tag, attrs)
            self.skip_newline, self.frameset_ok = True, False
        elif tag == "form":
            if self.form is not None:
                self.error("form inside form")
            else:
                self.close_p_in_button_scope()
                self.form = self.insert(tag, attrs)
        elif tag == "plaintext":
            self.close_p_in_button_scope()
            self.insert(tag, attrs)
            self.tokens.state = "plaintext"
        elif tag == "button":
            if self.in_scope("button"):
                self.error("button inside button")
                self.imply_ends()
                self.pop_until("button")
            self.reconstruct()
            self.insert(tag, attrs)
            self.frameset_ok = False
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
            self.frameset_ok = False
        elif tag == "table":
            if self.quirks != "quirks":
                self.close_p_in_button_scope()
            self.insert(tag, attrs)
            self.frameset_ok = False
            self.mode = self.in_table
        elif tag == "input":
            self.reconstruct()
            self.insert_void(token)
            if attrs.get("type", "").lower() != "hidden":
                self.frameset_ok = False
        elif tag in ("param", "source", "track"):
            self.insert_void(token)
        elif tag == "image":
            self.error("image for img")
            self.dispatch(("start", "img", attrs, closing))
        elif tag == "textarea":
            self.raw(token, "rcdata")
            self.skip_newline, self.frameset_ok = True, False
        elif tag in ("xmp", "iframe", "noembed", "noscript"):
            if tag == "xmp":
                self.close_p_in_button_scope()
                self.reconstruct()
            if tag in ("xmp", "iframe"):
                self.frameset_ok = False
            self.raw(token, "rawtext")
        elif tag == "select":
            self.reconstruct()
            self.insert(tag, attrs)
            self.frameset_ok = False
            in_table = (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell)
            self.mode = self.in_select_in_table if self.mode in in_table else self.in_select
        elif tag in ("optgroup", "option"):
            if current.tag == "option":
                self.open.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag == "menuitem":
            if current.tag == "menuitem":
                self.open.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rp", "rt"):
            if self.in_scope("ruby"):
                self.imply_ends()
                if self.current.tag != "ruby":
                    self.error("ruby part outside ruby")
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self.reconstruct()
            self.insert(tag, _math_attrs(attrs) if tag == "math" else _svg_attrs(attrs), tag)
            if closing:
                self.open.pop()
        elif tag in CELLS_AND_ROWS or tag in ("frame", "head"):
            self.error("start tag without its table or document")
        else:
            self.reconstruct()
            self.insert(tag, attrs)

    def _formatting_start(self, tag: str, attrs: dict, token: tuple) -> None:
        if tag == "a":
            found = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == "a":
                    found = x
                    break
            if found is not None:
                self.error("link inside link")
                if not self.adopt("a"):
                    return self.any_other_end(token[1])
                self.forget(found)
                self.unstack(found)
        self.reconstruct()
        if tag == "nobr" and self.in_scope("nobr"):
            self.error("nobr inside nobr")
            if not self.adopt("nobr"):
                return self.any_other_end(token[1])
            self.reconstruct()
        self.push_active(self.insert(tag, attrs))
        return None

    def _list_item(self, tag: str, attrs: dict, closes: tuple[str, ...]) -> None:
        self.frameset_ok = False
        for node in reversed(self.open):
            if node.tag in closes:
                self.imply_ends(node.tag)
                if self.current.tag != node.tag:
                    self.error("list item that is not current")
                self.pop_until(node.tag)
                break
            if _special(node) and not (node.ns == "html" and node.tag in ("address", "div", "p")):
                break
        self.close_p_in_button_scope()
        self.insert(tag, attrs)

    def _end_in_scope(self, tag: str, but: str | None = None, also: tuple[str, ...] = ()) -> bool:
        self.imply_ends(but)
        if self.current.tag != tag:
            self.error("end tag of an element that is not current")
        self.pop_until(tag, *also)
        return True

    def body_end(self, token: tuple) -> None:
        tag = token[1]
        if tag in ENDED_BLOCKS:
            if self.in_scope(tag):
                self._end_in_scope(tag)
            else:
                self.error("end tag that nothing opened")
        elif tag == "p":
            if not self.in_button_scope("p"):
                self.error("end tag p that nothing opened")
                self.insert("p")
            self.close_p()
        elif tag in FORMATTING:
            if not self.adopt(tag):
                self.any_other_end(tag)
        elif tag == "li":
            if self.in_scope("li", extra=("ol", "ul")):
                self._end_in_scope("li", "li")
            else:
                self.error("end tag that nothing opened")
        elif tag in ("dd", "dt"):
            if self.in_scope(tag):
                self._end_in_scope(tag, tag)
            else:
                self.error("end tag that nothing opened")
        elif tag in HEADINGS:
            if self.in_scope(*HEADINGS):
                self._end_in_scope(tag, also=tuple(HEADINGS))
            else:
                self.error("end tag that nothing opened")
        elif tag in ("body", "html"):
            if not self.in_scope("body"):
                return self.error("end of a body that is not in scope")
            for node in reversed(self.open):
                if node.tag not in _MAY_STAY_OPEN:
                    self.error("element still open at the end of body")
                    break
            self.mode = self.after_body
            if tag == "html":
                self.dispatch(token)
        elif tag == "form":
            node, self.form = self.form, None
            if node is None or not self.node_in_scope(node):
                return self.error("end of a form that is not in scope")
            self.imply_ends()
            if self.current is not node:
                self.error("end of a form that is not current")
            self.unstack(node)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self._end_in_scope(tag)
                self.clear_to_marker()
            else:
                self.error("end tag that nothing opened")
        elif tag == "br":
            self.error("end tag br")
            self.body_start(("start", "br", {}, False))
        else:
            self.any_other_end(tag)
        return None

    def any_other_end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.tag == tag:
                self.imply_ends(tag)
                if self.current is not None and self.current.tag != tag:
                    self.error("end tag of an element that is not current")
                if self.is_open(node):
                    self.pop_to(node)
                return
            if _special(node):
                self.error("end tag that nothing opened")
                return

    def adopt(self, tag: str) -> bool:
        """The adoption agency; False if the end tag is to be treated as any other."""
        for _ in range(8):
            element = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.tag == tag:
                    element = x
                    break
            if element is None:
                return False
            if not self.is_open(element):
                self.error("formatting element is not open")
                self.forget(element)
                return True
            if not self.node_in_scope(element):
                self.error("formatting element is not in scope")
                return True
            if self.current is not element:
                self.error("formatting element is not current")
            at = next(i for i, x in enumerate(self.open) if x is element)
            block = next((x for x in self.open[at + 1 :] if _special(x)), None)
            if block is None:
                self.pop_to(element)
                self.forget(element)
                return True
            ancestor = self.open[at - 1]
            mark = self.active_index(element)
            before = self.active[mark - 1] if mark else None
            after = self.active[mark + 1] if mark + 1 < len(self.active) else None
            node = last = block
            i = next(j for j, x in enumerate(self.open) if x is block)
            inner = 0
            while True:
                inner += 1
                i -= 1
                node = self.open[i]
                if node is element:
                    break
                k = self.active_index(node)
                if inner > 3 and k >= 0:
                    del self.active[k]
                    k = -1
                if k < 0:
                    del self.open[i]
                    continue
                copy = Node("element", node.tag, "html", dict(node.attrs))
                self.active[k] = self.open[i] = copy
                before, after = copy if before is node else before, copy if after is node else after
                node = copy
                if last is block:
                    before = node
                    after = self.active[k + 1] if k + 1 < len(self.active) else None
                node.append(last)
                last = node
            parent, where = self.place(ancestor)
            parent.insert(where, last)
            copy = Node("element", element.tag, "html", dict(element.attrs))
            for child in list(block.children):
                copy.append(child)
            block.append(copy)
            self.forget(element)
            b, a = self.active_index(before), self.active_index(after)
            self.active.insert(b + 1 if b >= 0 else a if a >= 0 else min(mark, len(self.active)), copy)
            self.unstack(element)
            self.open.insert(next(j for j, x in enumerate(self.open) if x is block) + 1, copy)
        return True

    def in_text(self, token: tuple) -> None:
        if token[0] == "chars":
            self.text(token[1])
        elif token[0] == "end":
            self.open.pop()
            self.mode = self.original
        elif token[0] == "eof":
            self.error("end of input in raw text")
            self.open.pop()
            self.mode = self.original
            self.dispatch(token)

    # ---- tables

    def _clear_to(self, *tags: str) -> None:
        while self.open and self.current.tag not in tags:
            self.open.pop()

    def in_table(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars" and self.current.tag in TABLE_PARTS:
            self.pending = []
            self.original, self.mode = self.mode, self.in_table_text
            return self.dispatch(token)
        if kind == "comment":
            return self.comment(tag)
        if kind == "doctype":
            return self.error("document type out of place")
        if kind == "eof":
            return self.in_body(token)
        if kind == "start":
            if tag == "caption":
                self._clear_to("table", "html")
                self.active.append(None)
                self.insert(tag, token[2])
                self.mode = self.in_caption
                return None
            if tag == "colgroup":
                self._clear_to("table", "html")
                self.insert(tag, token[2])
                self.mode = self.in_column_group
                return None
            if tag == "col":
                self._clear_to("table", "html")
                self.insert("colgroup")
                self.mode = self.in_column_group
                return self.dispatch(token)
            if tag in ("tbody", "tfoot", "thead"):
                self._clear_to("table", "html")
                self.insert(tag, token[2])
                self.mode = self.in_table_body
                return None
            if tag in ("td", "th", "tr"):
                self._clear_to("table", "html")
                self.insert("tbody")
                self.mode = self.in_table_body
                return self.dispatch(token)
            if tag == "table":
                self.error("table inside table")
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset_mode()
                    self.dispatch(token)
                return None
            if tag in ("style", "script"):
                return self.in_head(token)
            if tag == "input" and token[2].get("type", "").lower() == "hidden":
                self.error("hidden input in a table")
                return self.insert_void(token)
            if tag == "form":
                self.error("form in a table")
                if self.form is None:
                    self.form = self.insert(tag, token[2])
                    self.open.pop()
                return None
        if kind == "end":
            if tag == "table":
                if not self.in_table_scope("table"):
                    return self.error("end tag that nothing opened")
                self.pop_until("table")
                return self.reset_mode()
            if tag in CELLS_AND_ROWS or tag in ("body", "html"):
                return self.error("end tag inside a table")
        return self._foster(token)

    def _foster(self, token: tuple) -> None:
        self.error("content that does not belong in a table")
        self.foster = True
        self.in_body(token)
        self.foster = False

    def in_table_text(self, token: tuple) -> None:
        if token[0] == "chars":
            s = token[1]
            for _ in range(s.count("\0")):
                self.error("NUL in a table")
            self.pending.append(s.replace("\0", ""))
            return
        s = "".join(self.pending)
        if s.strip(SPACE + "\r"):
            self._foster(("chars", s))
        else:
            self.text(s)
        self.mode = self.original
        self.dispatch(token)

    def in_caption(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "end" and tag == "caption":
            if not self.in_table_scope("caption"):
                return self.error("end tag that nothing opened")
            self._end_in_scope("caption")
            self.clear_to_marker()
            self.mode = self.in_table
            return None
        # a colgroup start tag falls through to the body's rules, which ignore it
        if (kind == "start" and tag in CELLS_AND_ROWS - {"colgroup"}) or (kind == "end" and tag == "table"):
            self.error("table part inside a caption")
            if self.in_table_scope("caption"):
                self.pop_until("caption")
                self.clear_to_marker()
                self.mode = self.in_table
                self.dispatch(token)
            return None
        if kind == "end" and (tag in CELLS_AND_ROWS or tag in ("body", "html")):
            return self.error("end tag inside a caption")
        return self.in_body(token)

    def in_column_group(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars":
            space, rest = _split_space(tag)
            self.text(space)
            if not rest:
                return None
            token = ("chars", rest)
        elif kind == "comment":
            return self.comment(tag)
        elif kind == "doctype":
            return self.error("document type out of place")
        elif kind == "eof":
            return self.in_body(token)
        elif kind == "start" and tag == "html":
            return self.in_body(token)
        elif kind == "start" and tag == "col":
            return self.insert_void(token)
        elif kind == "end" and tag == "colgroup":
            if self.current.tag != "colgroup":
                return self.error("end tag that nothing opened")
            self.open.pop()
            self.mode = self.in_table
            return None
        elif kind == "end" and tag == "col":
            return self.error("end tag col")
        if self.current.tag != "colgroup":
            return self.error("content of a column group that is not open")
        self.open.pop()
        self.mode = self.in_table
        return self.dispatch(token)

    def in_table_body(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "start" and tag in ("tr", "td", "th"):
            self._clear_to("tbody", "tfoot", "thead", "html")
            if tag != "tr":
                self.error("cell without a row")
            self.insert("tr", token[2] if tag == "tr" else None)
            self.mode = self.in_row
            return None if tag == "tr" else self.dispatch(token)
        if kind == "end" and tag in ("tbody", "tfoot", "thead"):
            if not self.in_table_scope(tag):
                return self.error("end tag that nothing opened")
            self._clear_to("tbody", "tfoot", "thead", "html")
            self.open.pop()
            self.mode = self.in_table
            return None
        if (kind == "start" and tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead")) or (kind == "end" and tag == "table"):
            if not self.in_table_scope("tbody", "tfoot", "thead"):
                return self.error("table part without a table body")
            self._clear_to("tbody", "tfoot", "thead", "html")
            self.open.pop()
            self.mode = self.in_table
            return self.dispatch(token)
        if kind == "end" and tag in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return self.error("end tag inside a table body")
        return self.in_table(token)

    def in_row(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "start" and tag in ("td", "th"):
            self._clear_to("tr", "html")
            self.insert(tag, token[2])
            self.mode = self.in_cell
            self.active.append(None)
            return None
        again = (kind == "start" and tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")) or (kind == "end" and tag in ("table", "tbody", "tfoot", "thead"))
        if again or (kind == "end" and tag == "tr"):
            if kind == "end" and tag in ("tbody", "tfoot", "thead") and not self.in_table_scope(tag):
                return self.error("end tag that nothing opened")
            if not self.in_table_scope("tr"):
                return self.error("row part without a row")
            self._clear_to("tr", "html")
            self.open.pop()
            self.mode = self.in_table_body
            return self.dispatch(token) if again else None
        if kind == "end" and tag in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return self.error("end tag inside a row")
        return self.in_table(token)

    def _close_cell(self) -> None:
        self.imply_ends()
        if self.current.tag not in ("td", "th"):
            self.error("closing a cell that is not current")
        self.pop_until("td", "th")
        self.clear_to_marker()
        self.mode = self.in_row

    def in_cell(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "end" and tag in ("td", "th"):
            if not self.in_table_scope(tag):
                return self.error("end tag that nothing opened")
            self._end_in_scope(tag)
            self.clear_to_marker()
            self.mode = self.in_row
            return None
        if kind == "start" and tag in CELLS_AND_ROWS:
            if not self.in_table_scope("td", "th"):
                return self.error("table part without a cell")
            self._close_cell()
            return self.dispatch(token)
        if kind == "end" and tag in ("body", "caption", "col", "colgroup", "html"):
            return self.error("end tag inside a cell")
        if kind == "end" and tag in TABLE_PARTS:
            if not self.in_table_scope(tag):
                return self.error("end tag that nothing opened")
            self._close_cell()
            return self.dispatch(token)
        return self.in_body(token)

    # ---- select

    def in_select(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars":
            for _ in range(tag.count("\0")):
                self.error("NUL in select")
            self.text(tag.replace("\0", ""))
        elif kind == "comment":
            self.comment(tag)
        elif kind == "doctype":
            self.error("document type out of place")
        elif kind == "eof":
            self.in_body(token)
        elif kind == "start":
            if tag == "html":
                self.in_body(token)
            elif tag in ("option", "optgroup"):
                if self.current.tag == "option":
                    self.open.pop()
                if tag == "optgroup" and self.current.tag == "optgroup":
                    self.open.pop()
                self.insert(tag, token[2])
            elif tag in ("select", "input", "keygen", "textarea"):
                self.error("start tag that closes select")
                if self.in_select_scope():
                    self.pop_until("select")
                    self.reset_mode()
                    if tag != "select":
                        self.dispatch(token)
            elif tag == "script":
                self.in_head(token)
            else:
                self.error("start tag inside select")
        elif tag == "optgroup":
            if self.current.tag == "option" and len(self.open) > 1 and self.open[-2].tag == "optgroup":
                self.open.pop()
            if self.current.tag == "optgroup":
                self.open.pop()
            else:
                self.error("end tag that nothing opened")
        elif tag == "option":
            if self.current.tag == "option":
                self.open.pop()
            else:
                self.error("end tag that nothing opened")
        elif tag == "select":
            if self.in_select_scope():
                self.pop_until("select")
                self.reset_mode()
            else:
                self.error("end tag that nothing opened")
        else:
            self.error("end tag inside select")

    def in_select_in_table(self, token: tuple) -> None:
        if token[0] in ("start", "end") and token[1] in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.error("table part inside select")
            if token[0] == "start" or self.in_table_scope(token[1]):
                self.pop_until("select")
                self.reset_mode()
                self.dispatch(token)
        else:
            self.in_select(token)

    # ---- after the body, framesets

    def after_body(self, token: tuple) -> None:
        kind = token[0]
        if kind == "chars":
            space, rest = _split_space(token[1])
            if space:
                self.in_body(("chars", space))
            if not rest:
                return None
            token = ("chars", rest)
        elif kind == "comment":
            return self.comment(token[1], self.open[0])
        elif kind == "doctype":
            return self.error("document type out of place")
        elif kind == "start" and token[1] == "html":
            return self.in_body(token)
        elif kind == "end" and token[1] == "html":
            if self.context is not None:
                return self.error("end tag html in a fragment")
            self.mode = self.after_after_body
            return None
        elif kind == "eof":
            self.stopped = True
            return None
        self.error("content after body")
        self.mode = self.in_body
        return self.dispatch(token)

    def after_after_body(self, token: tuple) -> None:
        kind = token[0]
        if kind == "comment":
            return self.comment(token[1], self.document)
        if kind == "doctype" or (kind == "start" and token[1] == "html"):
            return self.in_body(token)
        if kind == "chars":
            space, rest = _split_space(token[1])
            if space:
                self.in_body(("chars", space))
            if not rest:
                return None
            token = ("chars", rest)
        elif kind == "eof":
            self.stopped = True
            return None
        self.error("content after the document")
        self.mode = self.in_body
        return self.dispatch(token)

    def _only_space(self, s: str) -> str:
        kept = "".join(c for c in s if c in SPACE)
        for _ in range(len(s) - len(kept)):
            self.error("text in a frameset")
        return kept

    def in_frameset(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars":
            self.text(self._only_space(tag))
        elif kind == "comment":
            self.comment(tag)
        elif kind == "start" and tag == "html":
            self.in_body(token)
        elif kind == "start" and tag == "frameset":
            self.insert(tag, token[2])
        elif kind == "start" and tag == "frame":
            self.insert_void(token)
        elif kind == "start" and tag == "noframes":
            self.in_head(token)
        elif kind == "end" and tag == "frameset":
            if self.current.tag == "html":
                self.error("end tag that nothing opened")
            else:
                self.open.pop()
                if self.context is None and self.current.tag != "frameset":
                    self.mode = self.after_frameset
        elif kind == "eof":
            if self.current.tag != "html":
                self.error("frameset still open at the end of input")
            self.stopped = True
        else:
            self.error("content of a frameset that does not belong there")

    def after_frameset(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "chars":
            self.text(self._only_space(tag))
        elif kind == "comment":
            self.comment(tag)
        elif kind == "start" and tag == "html":
            self.in_body(token)
        elif kind == "end" and tag == "html":
            self.mode = self.after_after_frameset
        elif kind == "start" and tag == "noframes":
            self.in_head(token)
        elif kind == "eof":
            self.stopped = True
        else:
            self.error("content after a frameset")

    def after_after_frameset(self, token: tuple) -> None:
        kind, tag = token[0], token[1] if len(token) > 1 else None
        if kind == "comment":
            self.comment(tag, self.document)
        elif kind == "doctype" or (kind == "start" and tag == "html"):
            self.in_body(token)
        elif kind == "chars":
            space = self._only_space(tag)
            if space:
                self.in_body(("chars", space))
        elif kind == "start" and tag == "noframes":
            self.in_head(token)
        elif kind == "eof":
            self.stopped = True
        else:
            self.error("content after the document")

    # ---- foreign content

    def foreign(self, token: tuple) -> None:
        kind = token[0]
        if kind == "chars":
            s = token[1]
            for _ in range(s.count("\0")):
                self.error("NUL in foreign content")
            if s.strip(SPACE + "\0"):
                self.frameset_ok = False
            self.text(s.replace("\0", "�"))
        elif kind == "comment":
            self.comment(token[1])
        elif kind == "doctype":
            self.error("document type out of place")
        elif kind == "start":
            _, tag, attrs, closing = token
            if tag in BREAKOUT or (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                self.error("start tag that ends foreign content")
                if self.context is None:
                    self.open.pop()
                    while self.current is not None and not (self.current.ns == "html" or (self.current.ns == "math" and self.current.tag in MATH_TEXT) or _html_point(self.current)):
                        self.open.pop()
                    return self.dispatch(token)
            ns = self.adjusted.ns
            if ns == "math":
                attrs = _math_attrs(attrs)
            elif ns == "svg":
                tag, attrs = _SVG_TAGS.get(tag, tag), _svg_attrs(attrs)
            node = Node("element", tag, ns, dict(attrs))
            self.current.append(node)
            self.open.append(node)
            if closing:
                self.open.pop()
        elif kind == "end":
            if self.current.tag.lower() != token[1]:
                self.error("end tag of an element that is not current")
            for i in range(len(self.open) - 1, -1, -1):
                if i == 0:
                    return None
                if self.open[i].tag.lower() == token[1]:
                    del self.open[i:]
                    return None
                if self.open[i - 1].ns == "html":
                    break
            self.mode(token)
        return None

    # ---- which mode

    def reset_mode(self) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            node, last = self.open[i], i == 0
            if last and self.context is not None:
                node = self.context
            tag = node.tag
            if tag == "select":
                self.mode = self.in_select
                for above in reversed(self.open[:i]):
                    if above.tag == "table":
                        self.mode = self.in_select_in_table
                        break
                return
            if tag in ("td", "th") and not last:
                self.mode = self.in_cell
                return
            mode = {
                "tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body, "caption": self.in_caption,
                "colgroup": self.in_column_group, "table": self.in_table, "head": self.in_body if last else self.in_head, "body": self.in_body,
                "frameset": self.in_frameset, "html": self.before_head,
            }.get(tag)
            if mode or last:
                self.mode = mode or self.in_body
                return


_MAY_STAY_OPEN = _set("dd dt li optgroup option p rp rt tbody td tfoot th thead tr body html")


def _special(node: Node) -> bool:
    return node.tag in (SPECIAL if node.ns == "html" else MATH_SPECIAL if node.ns == "math" else SVG_SPECIAL)


def _bounds(node: Node, extra: tuple[str, ...]) -> bool:
    if node.ns == "html":
        return node.tag in SCOPE or node.tag in extra
    return node.tag in (MATH_SPECIAL if node.ns == "math" else SVG_SPECIAL)


def _html_point(node: Node) -> bool:
    if node.ns == "svg":
        return node.tag in SVG_SPECIAL
    return node.ns == "math" and node.tag == "annotation-xml" and node.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")


def _svg_attrs(attrs: dict) -> dict:
    return {_SVG_ATTRS.get(k, k): v for k, v in attrs.items()}


def _math_attrs(attrs: dict) -> dict:
    return {"definitionURL" if k == "definitionurl" else k: v for k, v in attrs.items()}


def parse_document(text: str, on_meta=None) -> TreeBuilder:
    return TreeBuilder(text, on_meta=on_meta).run()


def parse_fragment(text: str, context: str = "div", ns: str = "html") -> TreeBuilder:
    return TreeBuilder(text, (context, ns)).run()
