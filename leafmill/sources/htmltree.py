"""HTML text to an element tree, after the WHATWG parsing rules, with no library.

Covered: character references, raw and escapable raw text, void elements, implied html,
head and body, implied end tags, active formatting elements with the adoption agency,
tables with foster parenting, first-attribute-wins, merging of neighbouring text.  Not
covered: framesets, quirks mode, the inert contents of ``template`` (kept as children)
and namespaces of foreign content.
"""

from __future__ import annotations

import html
import re


class Element:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.kids = tag, attrs or {}, []
        self.parent: Element | None = None

    def add(self, kid: "Element | str", before: "Element | None" = None) -> None:
        at = len(self.kids) if before is None else next(i for i, k in enumerate(self.kids) if k is before)
        if isinstance(kid, str):
            if at and isinstance(self.kids[at - 1], str):
                self.kids[at - 1] += kid
            else:
                self.kids.insert(at, kid)
            return
        if kid.parent is not None:
            kid.parent.kids = [k for k in kid.parent.kids if k is not kid]
            at = len(self.kids) if before is None else next(i for i, k in enumerate(self.kids) if k is before)
        kid.parent = self
        self.kids.insert(at, kid)


# Fixed values of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta script style template title noframes noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset("applet marquee object".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPACE = "\t\n\f\r "

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_ATTR = re.compile(r"[\t\n\f\r /]*(?:(?P<end>>)|(?P<name>=?[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)'|(?P<u>[^\t\n\f\r >]*)))?)")
_AMBIGUOUS = re.compile(r"&([A-Za-z][A-Za-z0-9]*)(?=[=A-Za-z0-9])(?![A-Za-z0-9]*;)")
_COMMENT_END = re.compile(r"--!?>")


def _attr_text(s: str) -> str:
    """References in attributes: a name without a semicolon isn't one before ``=`` or a letter or digit."""
    return html.unescape(_AMBIGUOUS.sub(lambda m: f"&amp;{m[1]}", s)) if "&" in s else s


def tokens(text: str):
    """("text", s), ("start", tag, attrs, closed) and ("end", tag) and ("comment",), without its text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at, size, lower = 0, len(text), None
    while at < size:
        lt = text.find("<", at)
        if lt < 0:
            yield "text", html.unescape(text[at:]).replace("\0", "")
            return
        if lt > at:
            yield "text", html.unescape(text[at:lt]).replace("\0", "")
        nxt = text[lt + 1 : lt + 2]
        if text.startswith("<!--", lt):
            yield ("comment",)
            if text.startswith(">", lt + 4) or text.startswith("->", lt + 4):
                at = text.index(">", lt) + 1
                continue
            m = _COMMENT_END.search(text, lt + 4)
            at = m.end() if m else size
            continue
        end = nxt == "/"
        m = _NAME.match(text, lt + 1 + end)
        if not m:
            if nxt in ("!", "?") and nxt or end and lt + 2 < size:
                gt = text.find(">", lt + 1)
                at = gt + 1 if gt >= 0 else size
            else:
                yield "text", "</" if end else "<"
                at = lt + 1 + end
            continue
        tag, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        while True:
            m = _ATTR.match(text, at)
            if m["end"]:
                closed = text[m.end() - 2] == "/"
                at = m.end()
                break
            if m.end() >= size:  # a tag that doesn't end is dropped
                return
            if m.end() == at:
                at += 1
                continue
            at = m.end()
            if m["name"]:
                value = next((v for v in (m["d"], m["s"], m["u"]) if v is not None), "")
                attrs.setdefault(m["name"].lower(), _attr_text(value))
        if end:
            yield "end", tag
            continue
        yield "start", tag, attrs, closed
        if tag in RAW or tag in ESCAPABLE_RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\t\n\f\r />])", re.I).search(text, at)
            raw = text[at : m.start()] if m else text[at:]
            at = m.start() if m else size
            if raw:
                yield "raw", html.unescape(raw) if tag in ESCAPABLE_RAW else raw
        elif tag == "plaintext":
            yield "raw", text[at:]
            return


_MARK = Element("#marker")
_TABLE_SCOPE = frozenset(("html", "table", "template"))
_FOREIGN = frozenset(("svg", "math"))
#: Elements that decide how tokens are taken, and the mode's name where it isn't the tag.
_MODES = {"td": "cell", "th": "cell", "tbody": "rows", "thead": "rows", "tfoot": "rows", "tr": "", "caption": "", "colgroup": "", "table": "", "select": "", "body": "", "template": ""}
_LI_BARRIERS = SPECIAL - {"address", "div", "p"}


class Stack(list):
    """The open elements, with their places by tag, so that scopes cost the same at any depth."""

    def __init__(self, elements=()) -> None:
        super().__init__(elements)
        self._index()

    def _index(self) -> None:
        self.places: dict[str, list[int]] = {}
        for i, e in enumerate(self):
            self.places.setdefault(e.tag, []).append(i)
        self.held = set(map(id, self))

    def append(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self))
        self.held.add(id(e))
        super().append(e)

    def pop(self) -> Element:
        e = super().pop()
        self.places[e.tag].pop()
        self.held.discard(id(e))
        return e

    def highest(self, tags) -> int:
        """The place nearest to the top of any of the tags; -1 if none is open."""
        places = self.places
        some = tags if len(tags) < len(places) else places
        return max((places[t][-1] for t in some if t in tags and places.get(t)), default=-1)

    def __contains__(self, e: object) -> bool:
        return id(e) in self.held

    def index(self, e: Element) -> int:
        return next(i for i in reversed(self.places[e.tag]) if self[i] is e)

    # rarer changes, by the adoption agency and misplaced forms
    def __setitem__(self, k, e) -> None:
        super().__setitem__(k, e)
        self._index()

    def __delitem__(self, k) -> None:
        super().__delitem__(k)
        self._index()

    def insert(self, k: int, e: Element) -> None:
        super().insert(k, e)
        self._index()

    def remove(self, e: Element) -> None:
        del self[self.index(e)]


class Builder:
    """The tree construction stage."""

    def __init__(self) -> None:
        self.root = Element("html")
        self.stack, self.active = Stack([self.root]), []
        self.head: Element | None = None
        self.body: Element | None = None
        self.form: Element | None = None
        self.in_head = False

    # --- the stack and its scopes
    @property
    def top(self) -> Element:
        return self.stack[-1]

    def scoped(self, tags: frozenset | set, more: frozenset = frozenset()) -> bool:
        at = self.stack.highest(tags)
        return at >= 0 and at >= max(self.stack.highest(SCOPE), self.stack.highest(more))

    def table_scoped(self, tags: set) -> bool:
        at = self.stack.highest(tags)
        return at >= 0 and at >= self.stack.highest(_TABLE_SCOPE)

    def pop_to(self, tags: set | frozenset) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag not in tags:
            pass

    def imply(self, but: str = "") -> None:
        while self.top.tag in IMPLIED_END and self.top.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.scoped({"p"}, frozenset(["button"])):
            self.imply("p")
            self.pop_to({"p"})

    # --- insertion
    def place(self, kid: Element | str, foster: bool = False) -> None:
        if foster and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            k = max(0, self.stack.highest({"table"}))
            table = self.stack[k]
            if table.parent is not None:
                table.parent.add(kid, table)
            else:
                self.stack[k - 1].add(kid)
            return
        self.top.add(kid)

    def insert(self, tag: str, attrs: dict, foster: bool = False) -> Element:
        e = Element(tag, attrs)
        self.place(e, foster)
        self.stack.append(e)
        return e

    def reconstruct(self, foster: bool = False) -> None:
        k = len(self.active)
        while k and self.active[k - 1] is not _MARK and self.active[k - 1] not in self.stack:
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            self.active[i] = self.insert(old.tag, dict(old.attrs), foster)

    def push_active(self, e: Element) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            a = self.active[i]
            if a is _MARK:
                break
            if a.tag == e.tag and a.attrs == e.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(e)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not _MARK:
            pass

    def forget(self, e: Element) -> None:
        self.active = [a for a in self.active if a is not e]

    def adopt(self, tag: str) -> None:
        """The adoption agency."""
        if self.top.tag == tag and self.top not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            f = None
            for a in reversed(self.active):
                if a is _MARK:
                    break
                if a.tag == tag:
                    f = a
                    break
            if f is None:
                self.other_end(tag)
                return
            if f not in self.stack:
                self.forget(f)
                return
            at = self.stack.index(f)
            if any(e.tag in SCOPE for e in self.stack[at + 1 :]):
                return
            block = next((e for e in self.stack[at + 1 :] if e.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.forget(f)
                return
            above = self.stack[at - 1]
            mark = self.active.index(f)
            last, k, inner = block, self.stack.index(block), 0
            while True:
                k -= 1
                inner += 1
                e = self.stack[k]
                if e is f:
                    break
                if inner > 3 and e in self.active:
                    i = self.active.index(e)
                    mark -= i < mark
                    del self.active[i]
                if e not in self.active:
                    del self.stack[k]
                    continue
                new = Element(e.tag, dict(e.attrs))
                i = self.active.index(e)
                self.active[i] = self.stack[k] = new
                if last is block:
                    mark = i + 1
                new.add(last)
                last = new
            if above.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                tops, self.stack = self.stack, Stack(self.stack[:at])
                if last.parent is not None:
                    last.parent.kids = [x for x in last.parent.kids if x is not last]
                    last.parent = None
                self.place(last, True)
                self.stack = tops
            else:
                above.add(last)
            new = Element(f.tag, dict(f.attrs))
            for kid in list(block.kids):
                if isinstance(kid, str):
                    new.add(kid)
                else:
                    new.kids.append(kid)
                    kid.parent = new
            block.kids = []
            block.add(new)
            i = self.active.index(f)
            mark -= i < mark
            del self.active[i]
            self.active.insert(mark, new)
            self.stack.remove(f)
            self.stack.insert(self.stack.index(block) + 1, new)

    def other_end(self, tag: str) -> None:
        at = self.stack.highest({tag})
        if at > 0 and at >= self.stack.highest(SPECIAL):
            e = self.stack[at]
            self.imply(tag)
            while self.stack.pop() is not e:
                pass

    # --- modes before the body
    def ensure_head(self) -> None:
        if self.head is None:
            self.head = Element("head")
            self.root.add(self.head)

    def ensure_body(self, attrs: dict | None = None) -> None:
        self.ensure_head()
        if self.body is None:
            del self.stack[1:]
            self.in_head = False
            self.body = self.insert("body", attrs or {})

    def mode(self) -> str:
        at = self.stack.highest(_MODES)
        if at < 0:
            return "body"
        tag = self.stack[at].tag
        return _MODES[tag] or tag

    # --- tokens
    def text(self, s: str) -> None:
        if self.body is None:
            kept = s.lstrip(SPACE)
            blank = s[: len(s) - len(kept)]
            if blank and self.in_head:
                self.top.add(blank)
            if not kept:
                return
            s = kept
            self.ensure_body()
        if s.strip(SPACE) and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            self.reconstruct(True)
            self.place(s, True)
        elif self.top.tag in ("table", "tbody", "tfoot", "thead", "tr", "colgroup"):
            self.top.add(s)
        else:
            self.reconstruct()
            self.top.add(s)

    def raw(self, s: str) -> None:
        if self.top.tag in ("textarea", "plaintext") and s.startswith("\n"):
            s = s[1:]
        if s:
            self.top.add(s)

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag == "head":
                if self.head is None:
                    self.ensure_head()
                    self.head.attrs, self.in_head = attrs, True
                    self.stack.append(self.head)
                return
            if tag in HEAD_ONLY:
                first = self.head is None
                self.ensure_head()
                if first:
                    self.in_head = True
                    self.stack.append(self.head)
                into = self.top if self.in_head else self.head
                e = Element(tag, attrs)
                into.add(e)
                if tag not in VOID:
                    self.stack.append(e)
                return
            self.ensure_body(attrs if tag == "body" else None)
            if tag == "body":
                return
        if tag == "body":
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if tag == "head" or tag in ("frameset", "frame"):
            return
        mode = self.mode()
        if mode in ("table", "rows", "tr", "caption", "cell", "colgroup") and self.table_start(mode, tag, attrs):
            return
        self.body_start(tag, attrs, closed, mode in ("table", "rows", "tr"))

    def table_start(self, mode: str, tag: str, attrs: dict) -> bool:
        """Whether the tag has been dealt with by the rules for tables."""
        if mode in ("cell", "caption"):
            if tag not in TABLE_PARTS:
                return False
            self.pop_to({"td", "th", "caption"})
            self.clear_active()
            self.start(tag, attrs, False)
            return True
        if mode == "colgroup":
            if tag == "col":
                self.top.add(Element(tag, attrs))
                return True
            self.pop_to({"colgroup"})
            self.start(tag, attrs, False)
            return True
        stop = {"table": ("table",), "rows": ("tbody", "thead", "tfoot"), "tr": ("tr",)}[mode]
        if tag in TABLE_PARTS or tag == "table":
            while self.top.tag not in (*stop, "html"):
                self.stack.pop()
        if tag == "table":
            self.pop_to({"table"})
            self.start(tag, attrs, False)
        elif tag in ("td", "th"):
            if mode != "tr":
                self.start("tr", {}, False)
            self.insert(tag, attrs)
            self.active.append(_MARK)
        elif tag == "tr":
            if mode == "tr":
                self.stack.pop()
            elif mode == "table":
                self.insert("tbody", {})
            self.insert(tag, attrs)
        elif tag in TABLE_PARTS:
            while self.top.tag != "table":
                self.stack.pop()
            if tag == "col":
                self.insert("colgroup", {})
                self.top.add(Element(tag, attrs))
                return True
            self.insert(tag, attrs)
            if tag == "caption":
                self.active.append(_MARK)
        elif tag in ("style", "script", "template"):
            self.insert(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.top.add(Element(tag, attrs))
        else:
            return False
        return True

    def body_start(self, tag: str, attrs: dict, closed: bool, foster: bool) -> None:
        foster = foster and self.top.tag in ("table", "tbody", "tfoot", "thead", "tr")
        if tag in TABLE_PARTS:
            return
        if tag in HEAD_ONLY:
            self.insert(tag, attrs, foster)
            if tag in VOID:
                self.stack.pop()
            return
        if tag in CLOSES_P or tag in HEADINGS or tag in ("pre", "listing", "form", "plaintext", "xmp", "hr", "table"):
            if tag == "form" and self.form is not None:
                return
            self.close_p()
            if tag in HEADINGS and self.top.tag in HEADINGS:
                self.stack.pop()
            if tag == "xmp":
                self.reconstruct(foster)
            e = self.insert(tag, attrs, foster)
            if tag == "form":
                self.form = e
            if tag == "hr":
                self.stack.pop()
            return
        if tag in ("li", "dd", "dt"):
            same = {"li"} if tag == "li" else {"dd", "dt"}
            at = self.stack.highest(same)
            if at >= 0 and at >= self.stack.highest(_LI_BARRIERS - same):
                own = self.stack[at].tag
                self.imply(own)
                self.pop_to({own})
            self.close_p()
            self.insert(tag, attrs, foster)
            return
        if tag == "button" and self.scoped({"button"}):
            self.imply()
            self.pop_to({"button"})
        elif tag == "a":
            for a in reversed(self.active):
                if a is _MARK:
                    break
                if a.tag == "a":
                    self.adopt("a")
                    self.forget(a)
                    self.stack = Stack(e for e in self.stack if e is not a)
                    break
        elif tag == "image":
            tag = "img"
        elif tag in ("option", "optgroup"):
            if self.top.tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.top.tag == "optgroup":
                self.stack.pop()
        elif tag in ("rb", "rtc", "rp", "rt") and self.scoped({"ruby"}):
            self.imply("rtc" if tag in ("rp", "rt") else "")
        elif tag == "nobr":
            self.reconstruct(foster)
            if self.scoped({"nobr"}):
                self.adopt("nobr")
        if tag not in ("param", "source", "track", "rb", "rtc", "rp", "rt", "iframe", "noembed"):
            self.reconstruct(foster)
        e = self.insert(tag, attrs, foster)
        if tag in FORMATTING:
            self.push_active(e)
        elif tag in MARKED:
            self.active.append(_MARK)
        foreign = tag in ("svg", "math") or self.stack.highest(_FOREIGN) >= 0
        if tag in VOID or closed and foreign:
            self.stack.pop()

    def end(self, tag: str) -> None:
        if self.body is None:
            if len(self.stack) > 1 and self.top.tag == tag:
                self.stack.pop()
                if tag == "head":
                    self.in_head = False
                return
            if tag in ("body", "html", "br"):
                self.ensure_body()
            elif tag == "head":
                self.ensure_head()
                return
            else:
                return
        if tag in ("body", "html"):
            return
        mode = self.mode()
        if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"):
            if self.table_scoped({tag}):
                if tag in ("td", "th", "caption"):
                    self.imply()
                    self.pop_to({tag})
                    self.clear_active()
                else:
                    if mode in ("cell", "caption"):
                        self.pop_to({"td", "th", "caption"})
                        self.clear_active()
                    self.pop_to({tag})
            return
        if tag == "p":
            if not self.scoped({"p"}, frozenset(["button"])):
                self.insert("p", {}, mode in ("table", "rows", "tr"))
            self.close_p()
        elif tag == "br":
            self.body_start("br", {}, False, False)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag == "form":
            form, self.form = self.form, None
            if form is not None and form in self.stack and self.scoped({"form"}):
                self.imply()
                self.stack.remove(form)
        elif tag == "li":
            if self.scoped({"li"}, frozenset(["ol", "ul"])):
                self.imply("li")
                self.pop_to({"li"})
        elif tag in ("dd", "dt"):
            if self.scoped({tag}):
                self.imply(tag)
                self.pop_to({tag})
        elif tag in HEADINGS:
            if self.scoped(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif tag in CLOSES_P or tag in ("button", "listing", "pre") or tag in MARKED:
            if self.scoped({tag}):
                self.imply()
                self.pop_to({tag})
                if tag in MARKED:
                    self.clear_active()
        else:
            self.other_end(tag)


def parse(text: str | None) -> Element:
    """The ``html`` element of a document."""
    b = Builder()
    for token in tokens(text or ""):
        kind = token[0]
        if kind == "text":
            if token[1]:
                b.text(token[1])
        elif kind == "raw":
            b.raw(token[1])
        elif kind == "comment":  # it keeps the texts on its sides apart
            b.top.add(Element("#comment"))
        elif kind == "start":
            b.start(*token[1:])
        else:
            b.end(token[1])
    b.ensure_body()
    return b.root
