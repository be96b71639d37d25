"""Which part of a page is its content: all, one semantic element, the best scoring region, or what a selector matches."""

from __future__ import annotations

import re

from pagemill.functions.dom import TEXT, Node, SelectorError, parse, select

MODES = ("full", "main", "selector")
#: An article counts with so much text; a scored region needs so much text and so many paragraphs.
ARTICLE_CHARS, REGION_CHARS, REGION_PARAGRAPHS = 200, 300, 2
NO_REGION = "this page has no region that is clearly its content; take the whole page, or name a selector"


class RegionError(ValueError):
    """The requested region cannot be selected."""


def check_request(mode: str, selector: str | None) -> None:
    if mode not in MODES:
        raise RegionError(f"unknown content mode: {mode}")
    if mode == "selector" and not (selector and selector.strip()):
        raise RegionError("selector mode needs a selector")
    if mode != "selector" and selector:
        raise RegionError("only selector mode takes a selector")


#: Fixed values of the scoring: scored elements, base scores, and class or id words that speak for or against content.
SCORED = ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre")
BASE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3}
BASE |= {f"h{n}": -5 for n in range(1, 7)} | {"th": -5}
POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(
    r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll"
    r"|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget|nav|menu|breadcrumb",
    re.I,
)
DROPPED = ("script", "style", "noscript", "template", "form", "button", "input", "select", "textarea", "iframe", "object", "embed")
FURNITURE = ("nav", "aside", "footer", "header")


def _text(node: Node) -> str:
    return " ".join(node.text_content(" ").split())


def _class_weight(node: Node) -> int:
    score = 0
    for name in ("class", "id"):
        value = node.attrs.get(name, "")
        if value:
            score += 25 * bool(POSITIVE.search(value)) - 25 * bool(NEGATIVE.search(value))
    return score


def _link_density(node: Node) -> float:
    size = len(_text(node))
    return sum(len(_text(a)) for a in node.elements("a")) / size if size else 0.0


def _unlikely(node: Node) -> bool:
    words = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return node.tag not in ("body", "html", "article", "main", "a") and bool(NEGATIVE.search(words)) and not POSITIVE.search(words)


def _scores(root: Node) -> dict[int, list]:
    """Candidates by identity: node and score. A scored element speaks for five ancestors, less the higher they are."""
    found: dict[int, list] = {}
    for node in root.elements(*SCORED):
        text = _text(node)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + 1 + min(len(text) // 100, 3)
        up, level = node.parent, 0
        while up is not None and up.tag[0] != "#" and level < 5:
            if id(up) not in found:
                found[id(up)] = [up, BASE.get(up.tag, 0) + _class_weight(up)]
            found[id(up)][1] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    for entry in found.values():
        entry[1] *= 1 - _link_density(entry[0])
    return found


def _depth(node: Node) -> int:
    n = 0
    while node.parent is not None:
        node, n = node.parent, n + 1
    return n


def _best_region(html: str, strict: bool) -> Node | None:
    root = parse(html)
    for node in list(root.elements()):
        if node.tag in DROPPED or strict and (node.tag in FURNITURE or _unlikely(node)):
            node.remove()
    found = _scores(root)
    if not found:
        return None
    ranked = sorted(found.values(), key=lambda e: -e[1])[:5]
    top, score = ranked[0]
    # an ancestor of three good alternatives holds the content better than one of them
    good = [e[0] for e in ranked[1:] if e[1] >= 0.75 * score]
    if len(good) >= 3:
        up = top.parent
        while up is not None and up.tag not in ("#root", "body", "html"):
            if sum(any(x is g for x in up.elements()) for g in good) >= 3:
                top, score = up, max(score, found.get(id(up), [up, 0])[1])
                break
            up = up.parent
    # a parent that scores as well is taken, down to a third of the score
    up, least = top.parent, score / 3
    last = score
    while up is not None and up.tag not in ("#root", "body", "html"):
        s = found.get(id(up), [up, 0])[1]
        if s < least:
            break
        if s > last:
            top, score = up, s
        last, up = s, up.parent
    out = Node("div")
    limit = max(10, 0.2 * score)
    for peer in list(top.parent.children) if top.parent is not None else [top]:
        if peer is top:
            keep = True
        elif peer.tag[0] == "#":
            keep = False
        else:
            bonus = 0.2 * score if peer.attrs.get("class") and peer.attrs.get("class") == top.attrs.get("class") else 0
            keep = id(peer) in found and found[id(peer)][1] + bonus >= limit
            if not keep and peer.tag == "p":
                text, density = _text(peer), _link_density(peer)
                keep = len(text) > 80 and density < 0.25 or 0 < len(text) <= 80 and density == 0 and bool(re.search(r"\.( |$)", text))
        if keep:
            out.add(peer)
    for node in list(out.elements("div", "section", "ul", "table")):
        if node.parent is not None and (_unlikely(node) or _link_density(node) > 0.5 and len(_text(node)) < 500):
            node.remove()
    return out


def _confident(node: Node | None) -> bool:
    return node is not None and len(node.text_content(" ", True)) >= REGION_CHARS and sum(1 for _ in node.elements("p")) >= REGION_PARAGRAPHS


def main_region(html: str, root: Node | None = None) -> str:
    """One article with enough text, else the only main element, else the best scoring region, or an error."""
    root = root or parse(html)
    articles = [a for a in root.elements("article") if len(a.text_content(" ", True)) >= ARTICLE_CHARS]
    if len(articles) == 1:
        return articles[0].html()
    mains = list(root.elements("main"))
    if len(mains) == 1:
        return mains[0].html()
    for strict in (True, False):
        region = _best_region(html, strict)
        if _confident(region):
            return region.html()
    raise RegionError(NO_REGION)


def content_region(html: str, mode: str = "full", selector: str | None = None, root: Node | None = None) -> str:
    check_request(mode, selector)
    if mode == "full":
        return html
    root = root or parse(html)
    if mode == "main":
        return main_region(html, root)
    try:
        chosen = select(root, selector)
    except SelectorError as error:
        raise RegionError(f"the selector cannot be read: {error}") from error
    if not chosen:
        raise RegionError(f"nothing on the page fits the selector {selector}")
    return "<main>" + "".join(n.html() for n in chosen) + "</main>"


def has_text(node: Node) -> bool:
    return any(n.tag == TEXT and n.text.strip() for n in node.walk())
