"""HTML to Markdown, in two dialects: `page` (the engine's own output) and `tab` (that of a browser tab's converter).

Both walk the tree of dom.py. `page` writes `**bold**`, `*italic*` and bullets that change with depth; `tab` writes `_emphasis_`,
always makes pipe tables, and takes extra rules, removed and kept elements.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pagemill.functions.dom import SILENT, TEXT, Node, parse

BLOCKS = frozenset(
    "address article aside blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
BULLETS = "*+-"
_GAPS = re.compile(r"[\t\n\r ]+")


def _lines(text: str, prefix: str, rest: str) -> str:
    first, *more = text.split("\n")
    return "\n".join([prefix + first, *(rest + m if m else "" for m in more)])


def _edges(text: str) -> tuple[str, str, str]:
    """Blank before, what is between, and blank after: marks stand next to letters."""
    inner = text.strip()
    return (" " if text[:1].isspace() else ""), inner, (" " if text[-1:].isspace() else "")


def _fence(text: str, least: int = 3) -> str:
    return "`" * max(least, max(map(len, re.findall(r"`+", text)), default=0) + 1)


def _language(node: Node) -> str:
    for n in (node, *node.elements("code")):
        m = re.search(r"(?:^|\s)(?:language|lang)-([\w+#-]+)", n.attrs.get("class", ""))
        if m:
            return m[1]
    return ""


def _integer(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d+", value.strip()) else default


class PageMarkdown:
    """Fixed by this engine's goldens: ATX headings, `*` and `_` escaped, fenced blocks, titles of images and links kept."""

    def render(self, root: Node) -> str:
        text = self.children(root, frozenset())
        return re.sub(r"\n{3,}", "\n\n", text).strip("\n")

    def children(self, node: Node, context: frozenset) -> str:
        out: list[str] = []
        for child in node.children:
            piece = self.node(child, context)
            if not piece:
                continue
            if out:  # breaks between blocks do not add up
                before = out[-1]
                have = len(before) - len(before.rstrip("\n"))
                extra = len(piece) - len(piece.lstrip("\n"))
                if have and extra:
                    piece = piece.lstrip("\n")
                    out[-1] = before.rstrip("\n") + "\n" * min(2, max(have, extra))
                elif have:
                    piece = piece.lstrip(" ") if "pre" not in context else piece
            out.append(piece)
        return "".join(out)

    def node(self, node: Node, context: frozenset) -> str:
        if node.tag == TEXT:
            return self.text(node, context)
        if node.tag[0] == "#" or node.tag in SILENT:
            return ""
        inner = context
        if node.tag in ("pre", "code", "kbd", "samp"):
            inner = inner | {"pre" if node.tag == "pre" else "code"}
        if node.tag in HEADINGS or node.tag in ("td", "th"):
            inner = inner | {"inline"}
        if node.tag in ("ul", "ol"):
            inner = inner | {"list"}
        method = getattr(self, "on_" + ("heading" if node.tag in HEADINGS else node.tag), None)
        content = self.children(node, inner)
        if method is not None:
            return method(node, content, context)
        return self.block(content, context) if node.tag in BLOCKS else content

    def text(self, node: Node, context: frozenset) -> str:
        text = node.text
        if "pre" not in context:
            text = _GAPS.sub(" ", text)
            if node.parent is not None and node.parent.tag in BLOCKS or node.parent is None or node.parent.tag == "#root":
                peers = node.parent.children if node.parent is not None else [node]
                if node is peers[0]:
                    text = text.lstrip(" ")
                if node is peers[-1]:
                    text = text.rstrip(" ")
                if text == " " and any(p.tag in BLOCKS for p in peers):
                    return ""
        if not context & {"pre", "code"}:
            text = re.sub(r"([\\*_])", r"\\\1", text)
        return text

    def block(self, content: str, context: frozenset) -> str:
        content = content.strip()
        if not content:
            return ""
        return f" {content} " if "inline" in context else f"\n\n{content}\n\n"

    on_p = on_div = on_section = on_article = lambda self, node, content, context: self.block(content, context)

    def on_heading(self, node, content, context):
        content = " ".join(content.split())
        if not content or "inline" in context:
            return content
        return f"\n\n{'#' * int(node.tag[1])} {content}\n\n"

    def marked(self, content, context, mark):
        before, inner, after = _edges(content)
        return f"{before}{mark}{inner}{mark}{after}" if inner and not context & {"pre", "code"} else content

    on_b = on_strong = lambda self, node, content, context: self.marked(content, context, "**")
    on_i = on_em = lambda self, node, content, context: self.marked(content, context, "*")
    on_del = on_s = lambda self, node, content, context: self.marked(content, context, "~~")

    def on_code(self, node, content, context):
        before, inner, after = _edges(content)
        if "pre" in context or not inner:
            return content
        ticks = _fence(inner, 1) if "`" in inner else "`"
        pad = " " if "`" in inner else ""
        return f"{before}{ticks}{pad}{inner}{pad}{ticks}{after}"

    on_kbd = on_samp = on_code

    def on_pre(self, node, content, context):
        if not content.strip():
            return ""
        fence = _fence(content) if "```" in content else "```"
        return f"\n\n{fence}{_language(node)}\n{content.strip(chr(10))}\n{fence}\n\n"

    def on_a(self, node, content, context):
        before, inner, after = _edges(content)
        href, title = node.attrs.get("href"), node.attrs.get("title")
        if not inner or context & {"pre", "code"}:
            return content if inner else ""
        if not href:
            return content
        if inner.replace("\\_", "_").replace("\\*", "*") == href and not title:
            return f"{before}<{href}>{after}"
        quoted = ' "{}"'.format(title.replace('"', r"\"")) if title else ""
        return f"{before}[{inner}]({href}{quoted}){after}"

    def on_img(self, node, content, context):
        alt, src, title = node.attrs.get("alt") or "", node.attrs.get("src") or "", node.attrs.get("title") or ""
        if "inline" in context:
            return alt
        quoted = ' "{}"'.format(title.replace('"', r"\"")) if title else ""
        return f"![{alt}]({src}{quoted})"

    def on_br(self, node, content, context):
        return " " if "inline" in context else "\n" if "pre" in context else "  \n"

    def on_hr(self, node, content, context):
        return "\n\n---\n\n"

    def on_blockquote(self, node, content, context):
        content = content.strip()
        if "inline" in context or not content:
            return f" {content} " if content else ""
        return "\n\n" + "\n".join(f"> {x}" if x else ">" for x in content.split("\n")) + "\n\n"

    def items(self, node, content, context):
        if not content.strip():
            return ""
        return "\n" + content.strip("\n") if "list" in context else "\n\n" + content.strip("\n") + "\n\n"

    on_ul = on_ol = items

    def on_li(self, node, content, context):
        up = node.parent
        if up is not None and up.tag == "ol":
            place = [c for c in up.children if c.tag == "li"].index(node)
            bullet = f"{_integer(up.attrs.get('start'), 1) + place}."
        else:
            depth, n = -1, node
            while n is not None:
                depth, n = depth + (n.tag == "ul"), n.parent
            bullet = BULLETS[max(depth, 0) % 3]
        content = content.strip()
        return _lines(content, f"{bullet} ", " " * (len(bullet) + 1)) + "\n"

    def on_dt(self, node, content, context):
        return f"\n\n{' '.join(content.split())}\n" if content.strip() else ""

    def on_dd(self, node, content, context):
        return _lines(content.strip(), ":   ", "    ") + "\n" if content.strip() else ""

    def on_td(self, node, content, context):
        span = min(max(_integer(node.attrs.get("colspan"), 1), 1), 1000)
        return " " + " ".join(content.split()).replace("|", r"\|") + " |" * span

    on_th = on_td

    def on_tr(self, node, content, context):
        cells = [c for c in node.children if c.tag in ("td", "th")]
        if not cells:
            return ""
        table = node.parent
        while table is not None and table.tag not in ("table", "#root"):
            table = table.parent
        first = table is not None and next(iter(table.elements("tr")), None) is node
        width = content.count(" |") if cells else 0
        row = f"|{content}\n"
        rule = "|" + " --- |" * max(width, 1) + "\n"
        if first and (all(c.tag == "th" for c in cells) or node.parent is not None and node.parent.tag == "thead"):
            return row + rule
        if first:  # a table without a head gets an empty one
            return "|" + "  |" * max(width, 1) + "\n" + rule + row
        return row

    def on_table(self, node, content, context):
        return f"\n\n{content.strip()}\n\n" if content.strip() else ""

    def on_caption(self, node, content, context):
        return f"{content.strip()}\n\n" if content.strip() else ""

    def on_figcaption(self, node, content, context):
        return self.block(content, context)


#: Marks that the tab dialect escapes wherever they are, and those that count after white space at a line's start and before a blank.
ESCAPED_MARKS = re.compile(r"([\\*_`\[\]])")
ESCAPED_STARTS = re.compile(r"^(\s*)(?:([-+]|#{1,6}|>) |(\d+)\. )", re.M)


def escape_tab(text: str) -> str:
    """Authored marks as literal text."""
    text = ESCAPED_MARKS.sub(r"\\\1", text)
    return ESCAPED_STARTS.sub(lambda m: f"{m[1]}\\{m[2]} " if m[2] else f"{m[1]}{m[3]}\\. ", text)


class TabMarkdown(PageMarkdown):
    """Options of the converter, and rules: (name, tags, function of node and content); the first that fits wins."""

    def __init__(self, heading_style: str = "atx", bullet: str = "-", fenced: bool = True, images: bool = True, rules: list[tuple[str, tuple, Callable]] | None = None, remove: tuple = (), keep: tuple = ()):
        self.heading_style, self.bullet, self.fenced, self.images = heading_style, bullet, fenced, images
        self.rules, self.remove, self.keep = list(rules or ()), frozenset(remove), frozenset(keep)

    def add_rule(self, name: str, tags: tuple, replacement: Callable[[Node, str], str]) -> None:
        self.rules = [r for r in self.rules if r[0] != name] + [(name, tags, replacement)]

    def node(self, node, context):
        if node.tag[0] != "#":
            for _, tags, replacement in self.rules:
                if node.tag in tags:
                    return replacement(node, self.children(node, context))
            if node.tag in self.remove:
                return ""
            if node.tag in self.keep:
                return f"\n\n{node.html()}\n\n" if node.tag in BLOCKS else node.html()
        return super().node(node, context)

    def text(self, node, context):
        plain = super().text(node, context | {"code"})
        if context & {"pre", "code"}:
            return plain
        return escape_tab(plain)

    def on_heading(self, node, content, context):
        content = " ".join(content.split())
        level = int(node.tag[1])
        if not content:
            return ""
        if self.heading_style == "setext" and level < 3:
            return f"\n\n{content}\n{('=' if level == 1 else '-') * len(content)}\n\n"
        return f"\n\n{'#' * level} {content}\n\n"

    on_i = on_em = lambda self, node, content, context: self.marked(content, context, "_")

    def on_code(self, node, content, context):
        if "pre" in context or not content:
            return content
        content = re.sub(r"\r?\n|\r", " ", content)
        tick = "`"
        runs = re.findall(r"`+", content)
        while tick in runs:
            tick += "`"
        pad = " " if "`" in content else ""
        return f"{tick}{pad}{content}{pad}{tick}"

    on_kbd = on_samp = lambda self, node, content, context: content

    def on_pre(self, node, content, context):
        code = node.text_content()
        if not self.fenced:
            return "\n\n" + _lines(code.strip("\n"), "    ", "    ") + "\n\n"
        fence = _fence(code)
        language = re.search(r"language-(\w+)", " ".join(n.attrs.get("class", "") for n in (node, *node.elements("code"))))
        return f"\n\n{fence}{language[1] if language else ''}\n{code.rstrip(chr(10))}\n{fence}\n\n"

    def on_a(self, node, content, context):
        href, title = node.attrs.get("href") or "", node.attrs.get("title")
        if not content.strip():
            return ""
        if not href or href.startswith("#") or href.lower().startswith("javascript:"):
            return content
        quoted = ' "{}"'.format(title.replace('"', r"\"")) if title else ""
        return f"[{content.strip()}]({href}{quoted})"

    def on_img(self, node, content, context):
        src = node.attrs.get("src") or ""
        size = [_integer(node.attrs.get(k), 20) for k in ("width", "height")]
        if not self.images or not src or min(size) < 20:
            return ""
        title = node.attrs.get("title")
        quoted = f' "{title}"' if title else ""
        return f"![{node.attrs.get('alt') or ''}]({src}{quoted})"

    def on_li(self, node, content, context):
        up = node.parent
        content = _lines(content.strip(), "", "    ")
        if up is not None and up.tag == "ol":
            place = [c for c in up.children if c.tag == "li"].index(node)
            return f"{_integer(up.attrs.get('start'), 1) + place}. {content}\n"
        return f"{self.bullet} {content}\n"

    def on_table(self, node, content, context):
        rows = [[self.cell(c) for c in r.children if c.tag in ("td", "th")] for r in node.elements("tr")]
        rows = [r for r in rows if r]
        if not any(c for r in rows for c in r):
            return ""
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n\n" + "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n"

    @staticmethod
    def cell(node: Node) -> str:
        return node.text_content().strip().replace("|", r"\|").replace("\r\n", "<br>").replace("\n", "<br>")

    def on_figcaption(self, node, content, context):
        return f"\n\n*{content.strip()}*\n\n" if content.strip() else ""


def html_to_markdown(html: str, root: Node | None = None) -> str:
    return PageMarkdown().render(root or parse(html))


def tab_to_markdown(html: str, **options) -> str:
    return TabMarkdown(**options).render(parse(html))
