"""HTML to article to Markdown, in plain Python: the one step that Catalyst expressions can't do.

A forgiving parser builds a tree; the article is the page's <article> or <main>, else the block with the most text
outside links, as text density tells content from boilerplate; an emitter writes it as Markdown.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

NO_ARTICLE = "Could not extract article content. Page may not contain article-like content."

# Element names by what becomes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg iframe object nav aside footer form button select textarea head dialog".split())
BLOCKS = frozenset("address article blockquote dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table ul".split())
SELF_CLOSING = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
BOILERPLATE = re.compile(r"\b(ad|ads|advert|banner|breadcrumb|comment|cookie|menu|nav|newsletter|popup|promo|related|share|sidebar|social|sponsor|subscribe)s?\b", re.I)
MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**", "del": "~~", "s": "~~", "strike": "~~"}
#: Characters of text below which a page has no article.
LEAST_TEXT = 25
#: Deeper elements are taken as children of this depth.
MOST_DEPTH = 200


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)


class TreeBuilder(HTMLParser):
    """Elements that omit their end tags close where the next one begins; stray end tags are ignored; comments go."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if tag in SELF_CLOSING.get(name, ()):
                del self.open[i:]
                break
            if name in BLOCKS or name in ("table", "tr", "td", "th"):
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < MOST_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def _meta(root: Node) -> dict[str, str]:
    found: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta" and (name := n.attrs.get("property") or n.attrs.get("name")):
            found.setdefault(name.lower(), n.attrs.get("content", "").strip())
    return found


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _dropped(n: Node) -> bool:
    if n.tag in DROPPED or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
        return True
    if n.tag in ("body", "html", "article", "main", "#root"):
        return False
    return bool(BOILERPLATE.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".replace("-", " ").replace("_", " ")))


def prune(n: Node) -> Node:
    stack = [n]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _dropped(c)]
        stack.extend(c for c in node.children if isinstance(c, Node))
    return n


class Lengths:
    """Lengths of the texts below every element, each found once, from its children's.

    raw: characters. line: characters as one line, words parted by one blank. linked: those of links. A text joins the
    next one's first word unless white space is between them, so each keeps whether it starts and ends in a word.
    """

    def __init__(self, root: Node):
        self.raw: dict[Node, int] = {}
        self.linked: dict[Node, int] = {}
        self._words: dict[Node, tuple[int, int, bool, bool] | None] = {}
        for node in reversed(list(root.walk())):
            raw = linked = 0
            own = None
            for c in node.children:
                if isinstance(c, str):
                    raw += len(c)
                    own = self._joined(own, self._of(c))
                else:
                    raw += self.raw[c]
                    linked += self.linked[c]
                    own = self._joined(own, self._words[c])
            self.raw[node], self._words[node] = raw, own
            self.linked[node] = linked + (self.line(node) if node.tag == "a" else 0)

    @staticmethod
    def _of(text: str) -> tuple[int, int, bool, bool] | None:
        parts = text.split()
        return (len(parts), sum(map(len, parts)), not text[0].isspace(), not text[-1].isspace()) if text else None

    @staticmethod
    def _joined(a, b):
        if a is None or b is None:
            return b if a is None else a
        return a[0] + b[0] - (a[3] and b[2]), a[1] + b[1], a[2], b[3]

    def line(self, node: Node) -> int:
        own = self._words[node]
        return own[1] + max(0, own[0] - 1) if own else 0

    def density(self, n: Node) -> float:
        """Characters of text, less twice those in links, with a share of what paragraphs below have."""
        own = sum(self.line(c) for c in n.children if isinstance(c, Node) and c.tag in ("p", "pre", "ul", "ol", "table", "blockquote", "h1", "h2", "h3"))
        return own + 0.25 * self.line(n) - 2 * self.linked[n]


def find_article(root: Node) -> Node | None:
    """The element that holds the article, or None if there is too little text."""
    lengths, nodes = Lengths(root), list(root.walk())
    for tag in ("article", "main"):
        best = max((n for n in nodes if n.tag == tag), key=lengths.raw.get, default=None)
        if best is not None and lengths.line(best) >= LEAST_TEXT:
            return best
    best = max((n for n in nodes if n.tag in ("div", "section", "body", "td", "#root")), key=lengths.density, default=None)
    return best if best is not None and lengths.line(best) >= LEAST_TEXT else None


class Emitter:
    """Markdown of a tree: # headings, fenced code, - bullets, *em*, **strong**, --- rules, tables, ~~strike~~, tasks."""

    def __init__(self, base: str):
        self.base = base

    def inline(self, n: Node | str) -> str:
        if isinstance(n, str):
            return re.sub(r"\s+", " ", n)
        inner = "".join(map(self.inline, n.children))
        if n.tag == "br":
            return "  \n"
        if n.tag == "img":
            src = n.attrs.get("src", "")
            return f"![{_one_line(n.attrs.get('alt', ''))}]({urljoin(self.base, src)})" if src else ""
        if n.tag == "input":
            return ("[x] " if "checked" in n.attrs else "[ ] ") if n.attrs.get("type") == "checkbox" else ""
        if n.tag == "a" and (href := n.attrs.get("href", "")) and inner.strip():
            try:
                return f"[{inner.strip()}]({urljoin(self.base, href)})"
            except ValueError:
                return inner
        if n.tag == "code":
            return f"`{n.text()}`" if n.text().strip() else ""
        if n.tag in MARKS and inner.strip():
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{MARKS[n.tag]}{inner.strip()}{MARKS[n.tag]}{tail}"
        return inner

    def blocks(self, n: Node) -> list[str]:
        """The blocks of a container; runs of inline children are paragraphs."""
        out: list[str] = []
        run: list[str] = []

        def flush():
            text = "".join(run).strip()
            run.clear()
            if text:
                out.append(text)

        for c in n.children:
            if isinstance(c, str) or not self._has_blocks(c):
                run.append(self.inline(c))
            else:
                flush()
                out.extend(self.block(c))
        flush()
        return out

    @staticmethod
    def _has_blocks(n: Node) -> bool:
        return any(x.tag in BLOCKS for x in n.walk())

    def block(self, n: Node) -> list[str]:
        tag = n.tag
        if tag[0] == "h" and tag[1:].isdigit():
            text = _one_line(self.inline(Node("span", None)) + "".join(map(self.inline, n.children)))
            return [f"{'#' * int(tag[1])} {text}"] if text else []
        if tag == "hr":
            return ["---"]
        if tag == "pre":
            code = next((c for c in n.walk() if c.tag == "code"), n)
            lang = re.search(r"\blang(?:uage)?-([\w+#-]+)", code.attrs.get("class", ""))
            return [f"```{lang[1] if lang else ''}\n{n.text().strip(chr(10))}\n```"]
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(n))
            return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        if tag in ("ul", "ol"):
            return self.items(n)
        if tag == "table":
            return self.table(n)
        return self.blocks(n)

    def items(self, n: Node) -> list[str]:
        lines = []
        number = int(n.attrs["start"]) if n.attrs.get("start", "").isdigit() else 1
        for c in n.children:
            if isinstance(c, str) or c.tag != "li":
                continue
            head = f"{number}. " if n.tag == "ol" else "- "
            number += 1
            inner = "\n".join(self.blocks(c)).split("\n")
            lines.append(head + inner[0])
            lines += [" " * len(head) + x for x in inner[1:]]
        return ["\n".join(lines)] if lines else []

    def table(self, n: Node) -> list[str]:
        rows = []
        for r in n.walk():
            if r.tag == "tr":
                rows.append([" ".join(self.blocks(c)).replace("\n", " ").replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")])
        rows = [r for r in rows if r]
        if not rows:
            return self.blocks(Node("div")) or []
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
        return ["\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])]


def extract(html: str | None, url: str | None) -> dict:
    """body (Markdown before clean-up), title, byline, excerpt, site_name, error; never raises."""
    out: dict = dict.fromkeys(("body", "title", "byline", "excerpt", "site_name", "error"))
    try:
        root = parse(html or "")
        meta = _meta(root)
        title = meta.get("og:title") or next((_one_line(n.text()) for n in root.walk() if n.tag == "title"), "")
        title = title or next((_one_line(n.text()) for n in root.walk() if n.tag == "h1"), "")
        article = find_article(prune(root))
        if article is None:
            return out | {"error": NO_ARTICLE}
        emitter = Emitter(url or "")
        blocks = emitter.blocks(article)
        heads = [n for n in article.walk() if n.tag == "h1"]
        if len(heads) == 1 and blocks and blocks[0] == f"# {title}":
            blocks = blocks[1:]
        body = "\n\n".join(blocks)
        if not body.strip():
            return out | {"error": NO_ARTICLE}
        first = next((_one_line(n.text()) for n in article.walk() if n.tag == "p" and n.text().strip()), None)
        byline = meta.get("author") or next((_one_line(n.text()) for n in root.walk() if n.attrs.get("rel") == "author" or "byline" in n.attrs.get("class", "").split()), None)
        return out | {
            "body": body, "title": title, "byline": meta.get("author") if byline is None else byline, "excerpt": meta.get("description") or meta.get("og:description") or first,
            "site_name": meta.get("og:site_name"),
        }
    except Exception as e:  # noqa: BLE001  a page that can't be read is a row with an error
        return out | {"error": str(e) or type(e).__name__}
