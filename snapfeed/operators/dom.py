"""HTML tree and selectors used inside extraction tasks.

Only what item extraction needs: a forgiving tree builder on the standard
library's ``html.parser`` (void elements, raw-text script/style, implied end
tags for p/li/dt/dd/tr/td/th/option) and two selector dialects evaluated
against it — CSS with ``::text`` / ``::attr(x)`` pseudo-elements, and an
XPath 1.0 subset (location paths, predicates, the common string functions).
Field selectors are matched from descendant-or-self of the context element.
"""

from __future__ import annotations

import functools
import re
from html import escape as _html_escape
from html.parser import HTMLParser


class SelectorError(ValueError):
    pass


# ---------------------------------------------------------------------------
# Tree

# HTML void elements.
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
# Start tags that close an open <p>.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt summary".split())
# Implied end tags — start tag -> (tags it closes, tags that stop the search).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_P_SCOPE_STOP = frozenset("button table td th caption html marquee object applet template".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW_TEXT = frozenset(("script", "style"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "pos", "eidx", "eend", "kids", "kid_ix")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.parent = parent
        self.kids = []  # element children
        self.kid_ix = 0


class Text:
    __slots__ = ("text", "parent", "pos")

    def __init__(self, text, parent):
        self.text = text
        self.parent = parent


class Attr:
    __slots__ = ("el", "name", "value", "order")

    def __init__(self, el, name, value, order):
        self.el, self.name, self.value, self.order = el, name, value, order


class Document:
    def __init__(self, root: Node, elements: list):
        self.root = root
        self.elements = elements


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.stack = [self.root]

    def _pop_to(self, names, stops):
        """Close the outermost open element in ``names`` below the nearest scope
        boundary in ``stops`` (so a new <tr> closes the open <td> and its <tr>)."""
        hit = None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in stops:
                break
            if tag in names:
                hit = i
        if hit is not None:
            del self.stack[hit:]

    def _open(self, tag, attrs, empty):
        if tag in CLOSES_P:
            self._pop_to({"p"}, _P_SCOPE_STOP)
        if tag in IMPLIED:
            self._pop_to(*IMPLIED[tag])
        if tag in _HEADINGS and self.stack[-1].tag in _HEADINGS:
            self.stack.pop()
        d = {}
        for k, v in attrs:
            if k not in d:
                d[k] = "" if v is None else v
        parent = self.stack[-1]
        node = Node(tag, d, parent)
        parent.children.append(node)
        if not empty and tag not in VOID:
            self.stack.append(node)

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        parent = self.stack[-1]
        if parent.children and isinstance(parent.children[-1], Text):
            parent.children[-1].text += data
        else:
            parent.children.append(Text(data, parent))


def parse_html(html: str | None) -> Document:
    b = _Builder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # malformed markup: keep what was built
        pass
    elements = []
    pos = 0
    # iterative pre-order walk: positions, element index ranges, element children
    stack = [(b.root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.eend = len(elements)
            continue
        node.pos = pos
        pos += 1
        if isinstance(node, Text):
            continue
        node.eidx = len(elements)
        if node.tag != "#document":
            elements.append(node)
        node.kids = [c for c in node.children if isinstance(c, Node)]
        for i, k in enumerate(node.kids):
            k.kid_ix = i
        stack.append((node, True))
        for child in reversed(node.children):
            stack.append((child, False))
    b.root.eidx = -1
    return Document(b.root, elements)


def descendants(doc: Document, node: Node):
    start = node.eidx + 1
    return doc.elements[start:node.eend]


def text_content(node) -> str:
    if isinstance(node, Text):
        return node.text
    if isinstance(node, Attr):
        return node.value
    out = []
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, Text):
            out.append(n.text)
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


def outer_html(node) -> str:
    if isinstance(node, Text):
        return _html_escape(node.text, quote=False)
    if isinstance(node, Attr):
        return node.value
    if node.tag == "#document":
        return "".join(outer_html(c) for c in node.children)
    parts = ["<", node.tag]
    for k, v in node.attrs.items():
        parts.append(' %s="%s"' % (k, _html_escape(v, quote=True).replace("&#x27;", "'")))
    parts.append(">")
    if node.tag in VOID:
        return "".join(parts)
    raw = node.tag in _RAW_TEXT
    for c in node.children:
        parts.append(c.text if (raw and isinstance(c, Text)) else outer_html(c))
    parts.append("</%s>" % node.tag)
    return "".join(parts)


def _order_key(n):
    if isinstance(n, Attr):
        return (n.el.pos, 1 + n.order)
    return (n.pos, 0)


# ---------------------------------------------------------------------------
# CSS

_IDENT = "-?(?:[_a-zA-Z\u00a0-\uffff]|\\\\.)(?:[-\\w\u00a0-\uffff]|\\\\.)*"
_ident_re = re.compile(_IDENT)
_ws_re = re.compile(r"\s*")
_nth_re = re.compile(r"^\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$")


def _unescape_ident(s):
    return re.sub(r"\\(.)", r"\1", s)


class _Compound:
    __slots__ = ("tag", "ids", "classes", "attrs", "pseudos")

    def __init__(self):
        self.tag = None
        self.ids = []
        self.classes = []
        self.attrs = []
        self.pseudos = []


class CssSelector:
    __slots__ = ("parts", "pseudo_element")

    def __init__(self, parts, pseudo_element):
        self.parts = parts  # [(combinator, _Compound)], first combinator None
        self.pseudo_element = pseudo_element  # None | ("text",) | ("attr", name)


class _CssParser:
    def __init__(self, text):
        self.s = text
        self.i = 0

    def error(self, msg):
        raise SelectorError(f"{msg} at position {self.i} in {self.s!r}")

    def ws(self):
        m = _ws_re.match(self.s, self.i)
        had = m.end() > self.i
        self.i = m.end()
        return had

    def peek(self, n=1):
        return self.s[self.i:self.i + n]

    def ident(self):
        m = _ident_re.match(self.s, self.i)
        if not m:
            self.error("expected identifier")
        self.i = m.end()
        return _unescape_ident(m.group(0))

    def string_or_ident(self):
        c = self.peek()
        if c in ("'", '"'):
            j = self.i + 1
            out = []
            while j < len(self.s) and self.s[j] != c:
                if self.s[j] == "\\" and j + 1 < len(self.s):
                    j += 1
                out.append(self.s[j])
                j += 1
            if j >= len(self.s):
                self.error("unterminated string")
            self.i = j + 1
            return "".join(out)
        return self.ident()

    def parse_group(self):
        groups = [self.parse_selector()]
        while self.peek() == ",":
            self.i += 1
            groups.append(self.parse_selector())
        if self.i != len(self.s):
            self.error("unexpected character")
        return groups

    def parse_selector(self):
        self.ws()
        parts = []
        comb = None
        pseudo_el = None
        while True:
            comp, pe = self.parse_compound()
            if comp is None and pe is None:
                if parts and comb not in (None, " "):
                    self.error("dangling combinator")
                if not parts:
                    self.error("empty selector")
                break
            if comp is None:
                comp = _Compound()
            parts.append((comb if parts else None, comp))
            if pe is not None:
                pseudo_el = pe
                self.ws()
                break
            had_ws = self.ws()
            c = self.peek()
            if c in (">", "+", "~"):
                self.i += 1
                self.ws()
                comb = c
                nxt = self.peek()
                if not nxt or nxt == ",":
                    self.error("dangling combinator")
            elif c == "," or c == "":
                break
            elif had_ws:
                comb = " "
            else:
                self.error("unexpected character")
        return CssSelector(parts, pseudo_el)

    def parse_compound(self):
        comp = _Compound()
        seen = False
        pe = None
        c = self.peek()
        if c == "*":
            self.i += 1
            seen = True
        elif c and _ident_re.match(self.s, self.i):
            comp.tag = self.ident().lower()
            seen = True
        while True:
            c = self.peek()
            if c == "#":
                self.i += 1
                comp.ids.append(self.ident())
            elif c == ".":
                self.i += 1
                comp.classes.append(self.ident())
            elif c == "[":
                self.i += 1
                self.ws()
                name = self.ident().lower()
                self.ws()
                op = None
                val = None
                for cand in ("~=", "^=", "$=", "*=", "|=", "!=", "="):
                    if self.s.startswith(cand, self.i):
                        op = cand
                        self.i += len(cand)
                        break
                if op:
                    self.ws()
                    val = self.string_or_ident()
                    self.ws()
                    if self.peek() in ("i", "s") and self.peek(2)[1:] in ("]", " "):
                        self.i += 1
                        self.ws()
                if self.peek() != "]":
                    self.error("expected ]")
                self.i += 1
                comp.attrs.append((name, op, val))
            elif self.s.startswith("::", self.i):
                self.i += 2
                name = self.ident().lower()
                if name == "text":
                    pe = ("text",)
                elif name == "attr":
                    if self.peek() != "(":
                        self.error("expected (")
                    self.i += 1
                    self.ws()
                    an = self.string_or_ident()
                    self.ws()
                    if self.peek() != ")":
                        self.error("expected )")
                    self.i += 1
                    pe = ("attr", an)
                else:
                    self.error(f"unknown pseudo-element {name}")
                return (comp if (seen or comp.ids or comp.classes or comp.attrs or comp.pseudos) else None), pe
            elif c == ":":
                self.i += 1
                name = self.ident().lower()
                arg = None
                if self.peek() == "(":
                    self.i += 1
                    depth = 1
                    j = self.i
                    while j < len(self.s) and depth:
                        if self.s[j] == "(":
                            depth += 1
                        elif self.s[j] == ")":
                            depth -= 1
                        j += 1
                    if depth:
                        self.error("unbalanced (")
                    arg = self.s[self.i:j - 1]
                    self.i = j
                comp.pseudos.append(_compile_pseudo(name, arg, self))
            else:
                break
            seen = True
        return (comp if seen else None), pe


def _parse_nth(arg, p):
    m = _nth_re.match(arg or "")
    if not m:
        p.error("bad nth expression")
    odd, even, a, sign, b, plain = m.groups()
    if odd:
        return 2, 1
    if even:
        return 2, 0
    if plain is not None:
        return 0, int(plain)
    a = 1 if a in ("", "+") else (-1 if a == "-" else int(a))
    b = int(b or 0) * (-1 if sign == "-" else 1)
    return a, b


def _nth_ok(a, b, n):
    if a == 0:
        return n == b
    k = (n - b) / a
    return k >= 0 and k == int(k)


def _compile_pseudo(name, arg, p):
    if name in ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type",
                "empty", "root", "checked", "disabled", "enabled"):
        return (name, None)
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        return (name, _parse_nth(arg, p))
    if name == "not":
        inner = _CssParser(arg or "").parse_group()
        for sel in inner:
            if len(sel.parts) != 1 or sel.pseudo_element:
                p.error(":not() takes simple selectors")
        return (name, [sel.parts[0][1] for sel in inner])
    if name == "contains":
        q = _CssParser(arg or "")
        q.ws()
        return (name, q.string_or_ident())
    p.error(f"unknown pseudo-class {name}")


def _siblings(el):
    return el.parent.kids if el.parent is not None else [el]


def _match_pseudo(el, name, arg):
    if name == "first-child":
        return el.kid_ix == 0 and el.parent.tag != "#document"
    if name == "last-child":
        return el.parent.tag != "#document" and el.kid_ix == len(el.parent.kids) - 1
    if name == "only-child":
        return el.parent.tag != "#document" and len(el.parent.kids) == 1
    if name in ("first-of-type", "last-of-type", "only-of-type", "nth-of-type", "nth-last-of-type"):
        same = [k for k in _siblings(el) if k.tag == el.tag]
        i = same.index(el)
        if name == "first-of-type":
            return i == 0
        if name == "last-of-type":
            return i == len(same) - 1
        if name == "only-of-type":
            return len(same) == 1
        n = i + 1 if name == "nth-of-type" else len(same) - i
        return _nth_ok(arg[0], arg[1], n)
    if name == "nth-child":
        return _nth_ok(arg[0], arg[1], el.kid_ix + 1)
    if name == "nth-last-child":
        return _nth_ok(arg[0], arg[1], len(_siblings(el)) - el.kid_ix)
    if name == "not":
        return not any(_match_compound(el, c) for c in arg)
    if name == "empty":
        return not el.children
    if name == "root":
        return el.parent is not None and el.parent.tag == "#document"
    if name == "contains":
        return arg in text_content(el)
    if name == "checked":
        return "checked" in el.attrs or "selected" in el.attrs
    if name == "disabled":
        return "disabled" in el.attrs
    if name == "enabled":
        return "disabled" not in el.attrs
    return False


def _match_compound(el, comp):
    if comp.tag is not None and el.tag != comp.tag:
        return False
    attrs = el.attrs
    for i in comp.ids:
        if attrs.get("id") != i:
            return False
    if comp.classes:
        have = attrs.get("class")
        if have is None:
            return False
        have = have.split()
        for c in comp.classes:
            if c not in have:
                return False
    for name, op, val in comp.attrs:
        v = attrs.get(name)
        if v is None:
            if op == "!=":
                continue
            return False
        if op is None:
            continue
        if op == "=" and v != val:
            return False
        if op == "!=" and v == val:
            return False
        if op == "~=" and (not val or val not in v.split()):
            return False
        if op == "^=" and (not val or not v.startswith(val)):
            return False
        if op == "$=" and (not val or not v.endswith(val)):
            return False
        if op == "*=" and (not val or val not in v):
            return False
        if op == "|=" and not (v == val or v.startswith(val + "-")):
            return False
    for name, arg in comp.pseudos:
        if not _match_pseudo(el, name, arg):
            return False
    return True


@functools.lru_cache(maxsize=4096)
def compile_css(selector: str):
    if selector is None or not selector.strip():
        raise SelectorError("empty selector")
    return _CssParser(selector.strip()).parse_group()


def _css_elements(doc: Document, ctx: Node, sel: CssSelector):
    comb0, comp0 = sel.parts[0]
    pool = descendants(doc, ctx) if ctx.tag == "#document" else [ctx] + descendants(doc, ctx)
    cur = [n for n in pool if _match_compound(n, comp0)]
    for comb, comp in sel.parts[1:]:
        found = {}
        if comb == " ":
            covered_end = -1
            for n in cur:
                if n.eidx < covered_end:
                    continue
                covered_end = n.eend
                for c in descendants(doc, n):
                    if _match_compound(c, comp):
                        found[c.eidx] = c
        else:
            for n in cur:
                if comb == ">":
                    cands = n.kids
                elif comb == "+":
                    sib = _siblings(n)
                    cands = sib[n.kid_ix + 1:n.kid_ix + 2]
                else:
                    cands = _siblings(n)[n.kid_ix + 1:]
                for c in cands:
                    if _match_compound(c, comp):
                        found[c.eidx] = c
        cur = [found[k] for k in sorted(found)]
    return cur


def css_nodes(doc: Document, ctx: Node, selector: str):
    """Nodes (elements, text nodes or attributes) matched by a CSS selector, document order."""
    groups = compile_css(selector)
    out = {}
    for sel in groups:
        for el in _css_elements(doc, ctx, sel):
            pe = sel.pseudo_element
            if pe is None:
                out[(el.pos, 0)] = el
            elif pe[0] == "text":
                for c in el.children:
                    if isinstance(c, Text):
                        out[(c.pos, 0)] = c
            else:
                if pe[1] in el.attrs:
                    a = Attr(el, pe[1], el.attrs[pe[1]], list(el.attrs).index(pe[1]))
                    out[_order_key(a)] = a
    return [out[k] for k in sorted(out)]


# ---------------------------------------------------------------------------
# XPath 1.0 subset

_XP_TOKEN = re.compile(r"""\s*(?:
    (?P<num>\d+(?:\.\d*)?|\.\d+) |
    (?P<str>"[^"]*"|'[^']*') |
    (?P<op>//|::|\.\.|!=|<=|>=|[/()\[\],@|=<>+\-*.$]) |
    (?P<name>[A-Za-z_][\w.\-]*(?::[A-Za-z_][\w.\-]*)?)
)""", re.X)

_AXES = {"child", "descendant", "descendant-or-self", "self", "parent", "ancestor", "ancestor-or-self",
         "following-sibling", "preceding-sibling", "attribute", "following", "preceding"}
_NODE_TYPES = {"text", "node", "comment", "processing-instruction"}
_FUNCS = {"last", "position", "count", "string", "concat", "contains", "starts-with", "ends-with",
          "normalize-space", "string-length", "substring", "substring-before", "substring-after", "translate",
          "not", "true", "false", "boolean", "number", "sum", "name", "local-name", "round", "floor",
          "ceiling", "lower-case", "upper-case"}


def _xp_tokens(expr):
    toks = []
    i = 0
    expr = expr.strip()
    while i < len(expr):
        m = _XP_TOKEN.match(expr, i)
        if not m or m.end() == i:
            raise SelectorError(f"bad xpath token at {i} in {expr!r}")
        i = m.end()
        kind = m.lastgroup
        toks.append((kind, m.group(kind)))
    return toks


class _Ctx:
    __slots__ = ("doc", "node", "pos", "size")

    def __init__(self, doc, node, pos=1, size=1):
        self.doc, self.node, self.pos, self.size = doc, node, pos, size


def _string(v):
    if isinstance(v, list):
        return text_content(v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if v != v:
            return "NaN"
        if v == int(v):
            return str(int(v))
        return repr(v)
    return v


def _number(v):
    if isinstance(v, list):
        v = _string(v)
    if isinstance(v, bool):
        return 1.0 if v else 0.0
    if isinstance(v, float):
        return v
    try:
        return float(v.strip())
    except (ValueError, AttributeError):
        return float("nan")


def _boolean(v):
    if isinstance(v, list):
        return bool(v)
    if isinstance(v, float):
        return v != 0 and v == v
    if isinstance(v, str):
        return bool(v)
    return bool(v)


def _compare(op, a, b):
    def cmp(x, y):
        if op in ("=", "!="):
            if isinstance(x, bool) or isinstance(y, bool):
                r = _boolean(x) == _boolean(y)
            elif isinstance(x, float) or isinstance(y, float):
                r = _number(x) == _number(y)
            else:
                r = _string(x) == _string(y)
            return r if op == "=" else not r
        x, y = _number(x), _number(y)
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    if isinstance(a, list) and isinstance(b, list):
        sb = [text_content(n) for n in b]
        return any(cmp(text_content(x), y) for x in a for y in sb)
    if isinstance(a, list):
        if isinstance(b, bool):
            return cmp(_boolean(a), b)
        return any(cmp(text_content(x) if not isinstance(b, float) else _number(text_content(x)), b) for x in a)
    if isinstance(b, list):
        if isinstance(a, bool):
            return cmp(a, _boolean(b))
        return any(cmp(a, text_content(y) if not isinstance(a, float) else _number(text_content(y))) for y in b)
    return cmp(a, b)


def _axis(doc, node, axis):
    if isinstance(node, (Text, Attr)):
        parent = node.parent if isinstance(node, Text) else node.el
        if axis == "self":
            return [node]
        if axis in ("parent",):
            return [parent]
        if axis in ("ancestor", "ancestor-or-self"):
            out = [node] if axis == "ancestor-or-self" else []
            n = parent
            while n is not None:
                out.append(n)
                n = n.parent
            return out
        if axis == "descendant-or-self":
            return [node]
        if axis in ("following-sibling", "preceding-sibling") and isinstance(node, Text):
            sib = parent.children
            i = sib.index(node)
            return sib[i + 1:] if axis == "following-sibling" else list(reversed(sib[:i]))
        return []
    if axis == "child":
        return list(node.children)
    if axis == "attribute":
        return [Attr(node, k, v, i) for i, (k, v) in enumerate(node.attrs.items())]
    if axis in ("descendant", "descendant-or-self"):
        out = [node] if axis == "descendant-or-self" else []
        stack = list(reversed(node.children))
        while stack:
            n = stack.pop()
            out.append(n)
            if isinstance(n, Node):
                stack.extend(reversed(n.children))
        return out
    if axis == "self":
        return [node]
    if axis == "parent":
        return [node.parent] if node.parent is not None else []
    if axis in ("ancestor", "ancestor-or-self"):
        out = [node] if axis == "ancestor-or-self" else []
        n = node.parent
        while n is not None:
            out.append(n)
            n = n.parent
        return out
    if axis in ("following-sibling", "preceding-sibling"):
        if node.parent is None:
            return []
        sib = node.parent.children
        i = sib.index(node)
        return sib[i + 1:] if axis == "following-sibling" else list(reversed(sib[:i]))
    if axis in ("following", "preceding"):
        allnodes = _axis(doc, doc.root, "descendant")
        if axis == "following":
            sub = _axis(doc, node, "descendant-or-self")
            last_pos = max(n.pos for n in sub)
            return [n for n in allnodes if n.pos > last_pos]
        anc = set(id(a) for a in _axis(doc, node, "ancestor"))
        return [n for n in reversed(allnodes) if n.pos < node.pos and id(n) not in anc]
    return []


def _node_test(n, axis, test):
    kind, val = test
    if kind == "type":
        if val == "node":
            return True
        if val == "text":
            return isinstance(n, Text)
        return False
    if axis == "attribute":
        return isinstance(n, Attr) and (val == "*" or n.name == val.lower())
    if not isinstance(n, Node) or n.tag == "#document":
        return False
    return val == "*" or n.tag == val.lower()


class _XPathParser:
    def __init__(self, expr):
        self.expr = expr
        self.toks = _xp_tokens(expr)
        self.i = 0

    def error(self, msg="bad xpath"):
        raise SelectorError(f"{msg} in {self.expr!r}")

    def peek(self, k=0):
        j = self.i + k
        return self.toks[j] if j < len(self.toks) else (None, None)

    def take(self, val=None):
        tok = self.peek()
        if tok[0] is None or (val is not None and tok[1] != val):
            self.error(f"expected {val}")
        self.i += 1
        return tok

    def parse(self):
        f = self.or_expr()
        if self.i != len(self.toks):
            self.error("trailing tokens")
        return f

    def _binary(self, sub, ops, combine):
        left = sub()
        while self.peek()[1] in ops and self.peek()[0] in ("op", "name"):
            op = self.take()[1]
            right = sub()
            left = combine(op, left, right)
        return left

    def or_expr(self):
        return self._binary(self.and_expr, ("or",),
                            lambda op, a, b: lambda c: _boolean(a(c)) or _boolean(b(c)))

    def and_expr(self):
        return self._binary(self.eq_expr, ("and",),
                            lambda op, a, b: lambda c: _boolean(a(c)) and _boolean(b(c)))

    def eq_expr(self):
        return self._binary(self.rel_expr, ("=", "!="), lambda op, a, b: lambda c: _compare(op, a(c), b(c)))

    def rel_expr(self):
        return self._binary(self.add_expr, ("<", ">", "<=", ">="),
                            lambda op, a, b: lambda c: _compare(op, a(c), b(c)))

    def add_expr(self):
        def comb(op, a, b):
            return (lambda c: _number(a(c)) + _number(b(c))) if op == "+" else \
                (lambda c: _number(a(c)) - _number(b(c)))
        return self._binary(self.mul_expr, ("+", "-"), comb)

    def mul_expr(self):
        left = self.unary()
        while True:
            kind, val = self.peek()
            if (kind == "op" and val == "*") or (kind == "name" and val in ("div", "mod")):
                self.i += 1
                right = self.unary()
                if val == "*":
                    left = (lambda a, b: lambda c: _number(a(c)) * _number(b(c)))(left, right)
                elif val == "div":
                    left = (lambda a, b: lambda c: _div(_number(a(c)), _number(b(c))))(left, right)
                else:
                    left = (lambda a, b: lambda c: _mod(_number(a(c)), _number(b(c))))(left, right)
            else:
                return left

    def unary(self):
        if self.peek() == ("op", "-"):
            self.i += 1
            inner = self.unary()
            return lambda c: -_number(inner(c))
        return self.union()

    def union(self):
        left = self.path_expr()
        while self.peek() == ("op", "|"):
            self.i += 1
            right = self.path_expr()
            left = (lambda a, b: lambda c: _merge(a(c) + b(c)))(left, right)
        return left

    def path_expr(self):
        kind, val = self.peek()
        is_func = kind == "name" and self.peek(1) == ("op", "(") and val not in _NODE_TYPES
        if kind in ("num", "str") or (kind == "op" and val == "(") or is_func:
            prim = self.filter_expr()
            if self.peek() in (("op", "/"), ("op", "//")):
                return self.rel_path(prim)
            return prim
        return self.location_path()

    def filter_expr(self):
        kind, val = self.take()
        if kind == "num":
            v = float(val)
            prim = lambda c: v
        elif kind == "str":
            s = val[1:-1]
            prim = lambda c: s
        elif val == "(":
            inner = self.or_expr()
            self.take(")")
            prim = inner
        else:
            prim = self.function(val)
        preds = self.predicates()
        if preds:
            base = prim
            prim = lambda c: _apply_preds(c.doc, base(c), preds, False)
        return prim

    def function(self, name):
        if name not in _FUNCS:
            self.error(f"unknown function {name}()")
        self.take("(")
        args = []
        if self.peek() != ("op", ")"):
            args.append(self.or_expr())
            while self.peek() == ("op", ","):
                self.i += 1
                args.append(self.or_expr())
        self.take(")")
        return _make_function(name, args, self)

    def predicates(self):
        preds = []
        while self.peek() == ("op", "["):
            self.i += 1
            preds.append(self.or_expr())
            self.take("]")
        return preds

    def location_path(self):
        kind, val = self.peek()
        if kind == "op" and val in ("/", "//"):
            self.i += 1
            root = lambda c: [c.doc.root]
            if val == "//":
                return self.rel_path(root, first_sep="//")
            nk, nv = self.peek()
            if nk is None or (nk == "op" and nv not in (".", "..", "@", "*")):
                return root
            return self.rel_path(root, first_sep="/")
        return self.rel_path(lambda c: [c.node], first_sep="/")

    def rel_path(self, start, first_sep=None):
        steps = []
        sep = first_sep
        if sep is None:
            sep = self.take()[1]
        while True:
            if sep == "//":
                steps.append(("descendant-or-self", ("type", "node"), []))
            steps.append(self.step())
            if self.peek() in (("op", "/"), ("op", "//")):
                sep = self.take()[1]
            else:
                break

        def run(c):
            nodes = start(c)
            if not isinstance(nodes, list):
                raise SelectorError("path step on a non-node-set")
            for axis, test, preds in steps:
                out = []
                for n in nodes:
                    cand = [x for x in _axis(c.doc, n, axis) if _node_test(x, axis, test)]
                    if preds:
                        cand = _apply_preds(c.doc, cand, preds, axis in ("ancestor", "ancestor-or-self",
                                                                        "preceding", "preceding-sibling"))
                    out.extend(cand)
                nodes = _merge(out)
            return nodes
        return run

    def step(self):
        kind, val = self.peek()
        if (kind, val) == ("op", "."):
            self.i += 1
            return ("self", ("type", "node"), [])
        if (kind, val) == ("op", ".."):
            self.i += 1
            return ("parent", ("type", "node"), [])
        axis = "child"
        if (kind, val) == ("op", "@"):
            self.i += 1
            axis = "attribute"
        elif kind == "name" and self.peek(1) == ("op", "::"):
            if val not in _AXES:
                self.error(f"unknown axis {val}")
            axis = val
            self.i += 2
        kind, val = self.take()
        if kind == "op" and val == "*":
            test = ("name", "*")
        elif kind == "name" and val in _NODE_TYPES and self.peek() == ("op", "("):
            self.take("(")
            if self.peek()[0] == "str":
                self.i += 1
            self.take(")")
            test = ("type", val)
        elif kind == "name":
            test = ("name", val)
        else:
            self.error("expected node test")
        return (axis, test, self.predicates())


def _div(a, b):
    if b == 0:
        return float("nan") if a == 0 or a != a else (float("inf") if a > 0 else float("-inf"))
    return a / b


def _mod(a, b):
    import math
    if b == 0:
        return float("nan")
    return math.fmod(a, b)


def _merge(nodes):
    seen = {}
    for n in nodes:
        seen.setdefault(id(n) if not isinstance(n, Attr) else (id(n.el), n.name), n)
    return sorted(seen.values(), key=_order_key)


def _apply_preds(doc, nodes, preds, reverse):
    if not isinstance(nodes, list):
        raise SelectorError("predicate on a non-node-set")
    for p in preds:
        seq = list(reversed(nodes)) if reverse else nodes
        size = len(seq)
        keep = []
        for i, n in enumerate(seq, 1):
            v = p(_Ctx(doc, n, i, size))
            if isinstance(v, float):
                ok = v == i
            else:
                ok = _boolean(v)
            if ok:
                keep.append(n)
        nodes = list(reversed(keep)) if reverse else keep
    return nodes


def _make_function(name, args, parser):
    def a(i, c):
        return args[i](c)

    def s_or_ctx(c):
        return _string(a(0, c)) if args else text_content(c.node)

    table = {
        "last": lambda c: float(c.size),
        "position": lambda c: float(c.pos),
        "count": lambda c: float(len(a(0, c))),
        "string": s_or_ctx,
        "concat": lambda c: "".join(_string(f(c)) for f in args),
        "contains": lambda c: _string(a(1, c)) in _string(a(0, c)),
        "starts-with": lambda c: _string(a(0, c)).startswith(_string(a(1, c))),
        "ends-with": lambda c: _string(a(0, c)).endswith(_string(a(1, c))),
        "normalize-space": lambda c: " ".join(s_or_ctx(c).split()),
        "string-length": lambda c: float(len(s_or_ctx(c))),
        "substring": lambda c: _substring(_string(a(0, c)), _number(a(1, c)),
                                          _number(a(2, c)) if len(args) > 2 else None),
        "substring-before": lambda c: _string(a(0, c)).partition(_string(a(1, c)))[0]
        if _string(a(1, c)) in _string(a(0, c)) else "",
        "substring-after": lambda c: _string(a(0, c)).partition(_string(a(1, c)))[2]
        if _string(a(1, c)) in _string(a(0, c)) else "",
        "translate": lambda c: _translate(_string(a(0, c)), _string(a(1, c)), _string(a(2, c))),
        "not": lambda c: not _boolean(a(0, c)),
        "true": lambda c: True,
        "false": lambda c: False,
        "boolean": lambda c: _boolean(a(0, c)),
        "number": lambda c: _number(a(0, c)) if args else _number(text_content(c.node)),
        "sum": lambda c: float(sum(_number(text_content(n)) for n in a(0, c))),
        "name": lambda c: _node_name(a(0, c)[0] if args and a(0, c) else c.node),
        "local-name": lambda c: _node_name(a(0, c)[0] if args and a(0, c) else c.node),
        "round": lambda c: float(__import__("math").floor(_number(a(0, c)) + 0.5)),
        "floor": lambda c: float(__import__("math").floor(_number(a(0, c)))),
        "ceiling": lambda c: float(__import__("math").ceil(_number(a(0, c)))),
        "lower-case": lambda c: _string(a(0, c)).lower(),
        "upper-case": lambda c: _string(a(0, c)).upper(),
    }
    arity = {"last": (0, 0), "position": (0, 0), "count": (1, 1), "contains": (2, 2), "starts-with": (2, 2),
             "ends-with": (2, 2), "substring": (2, 3), "substring-before": (2, 2), "substring-after": (2, 2),
             "translate": (3, 3), "not": (1, 1), "true": (0, 0), "false": (0, 0), "boolean": (1, 1),
             "sum": (1, 1), "round": (1, 1), "floor": (1, 1), "ceiling": (1, 1), "concat": (2, 99)}
    lo, hi = arity.get(name, (0, 1))
    if not lo <= len(args) <= hi:
        parser.error(f"wrong number of arguments to {name}()")
    return table[name]


def _node_name(n):
    if isinstance(n, Attr):
        return n.name
    if isinstance(n, Node) and n.tag != "#document":
        return n.tag
    return ""


def _substring(s, start, length):
    import math
    if start != start:
        return ""
    first = math.floor(start + 0.5)
    if length is None:
        return s[max(first - 1, 0):] if first != float("-inf") else s
    if length != length:
        return ""
    last = first + math.floor(length + 0.5)
    lo = max(first, 1)
    if last == float("inf"):
        return s[int(lo) - 1:]
    return s[int(lo) - 1:max(int(last) - 1, int(lo) - 1)] if last > lo else ""


def _translate(s, frm, to):
    table = {}
    for i, ch in enumerate(frm):
        if ch not in table:
            table[ch] = to[i] if i < len(to) else None
    return "".join(table.get(ch, ch) or "" for ch in s if table.get(ch, ch) is not None)


@functools.lru_cache(maxsize=4096)
def compile_xpath(expr: str):
    if expr is None or not expr.strip():
        raise SelectorError("empty xpath")
    return _XPathParser(expr).parse()


def xpath_eval(doc: Document, ctx, expr: str):
    return compile_xpath(expr)(_Ctx(doc, ctx))


# ---------------------------------------------------------------------------
# Values, as a scraping selector library returns them


def node_value(n) -> str:
    if isinstance(n, Text):
        return n.text
    if isinstance(n, Attr):
        return n.value
    return outer_html(n)


def _scalar_value(v) -> str:
    if isinstance(v, bool):
        return "1" if v else "0"
    if isinstance(v, float):
        return repr(v) if v == v and v not in (float("inf"), float("-inf")) else str(v)
    return v


def select_nodes(doc: Document, ctx, selector: str, kind: str = "css"):
    """Matches as nodes (xpath scalars come back as a one-string list)."""
    if kind == "xpath":
        v = xpath_eval(doc, ctx, selector)
        return v if isinstance(v, list) else [_scalar_value(v)]
    if not isinstance(ctx, Node):
        return []
    return css_nodes(doc, ctx, selector)


def select_values(doc: Document, ctx, selector: str, kind: str = "css") -> list:
    return [x if isinstance(x, str) else node_value(x) for x in select_nodes(doc, ctx, selector, kind)]


def check_selector(selector: str | None, kind: str | None) -> str | None:
    """None when the selector compiles, else the error text."""
    kind = kind or "css"
    try:
        if kind == "css":
            compile_css(selector)
        elif kind == "xpath":
            compile_xpath(selector)
        else:
            return f"unknown selector type {kind!r}"
    except SelectorError as exc:
        return f"Invalid {kind} selector {selector!r}: {exc}"
    except Exception as exc:  # pragma: no cover - defensive
        return f"Invalid {kind} selector {selector!r}: {exc}"
    return None


# ---------------------------------------------------------------------------
# Item extraction for one page and one config


def field_value(doc: Document, el, field: dict):
    sel = field.get("selector")
    kind = field.get("selector_type") or "css"
    if kind == "xpath":
        values = select_values(doc, el, sel, "xpath")
    elif "::text" in sel or "::attr" in sel:
        values = select_values(doc, el, sel, "css")
    elif field.get("attr"):
        val = el.attrs.get(field["attr"]) if isinstance(el, Node) else None
        values = [val] if val else []
    else:
        values = select_values(doc, el, sel, "css")
    return values[0] if values else None


def extract_from_doc(doc: Document, item: dict) -> list[dict]:
    """Items of one page: one dict per container match, all-null items dropped."""
    containers = select_nodes(doc, doc.root, item["container"], item.get("container_type") or "css")
    out = []
    for el in containers:
        if isinstance(el, str):
            continue
        rec = {f["name"]: field_value(doc, el, f) for f in item["fields"]}
        if any(v is not None for v in rec.values()):
            out.append(rec)
    return out


def next_link(doc: Document, pagination: dict | None):
    if not pagination or not pagination.get("next"):
        return None
    vals = select_values(doc, doc.root, pagination["next"], pagination.get("next_type") or "css")
    return vals[0] if vals else None
