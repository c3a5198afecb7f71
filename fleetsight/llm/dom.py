"""A forgiving HTML reader: block elements as a tree, text as runs of their own.

No recursion; open elements are counted, not searched, for text and inline ends. Inline elements leave no node; their text
belongs to the nearest block. A run is the text between two block borders.
Scripts, styles, form controls, comments and other unseen text leave none.
"""

from __future__ import annotations

import html as entities
import re

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z)))",
    re.S)
ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names of HTML by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noscript iframe template".split())
UNSEEN = set("head select option button svg canvas audio video datalist".split())
BLOCK = set("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot
tr td th blockquote pre figure figcaption address center details summary dialog nav header footer aside form fieldset
legend hgroup menu search""".split())
CONTROLS = set("input select textarea button label".split())
# an opening tag ends an open element of the second set, unless one of the third set lies between
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}


class Page:
    """Per node (parents first): parent, tag, name tokens of class, id and role, marks, and counts of its subtree.

    ``runs`` are (node, text) in page order; ``links`` and ``chars`` count the
    characters inside links and altogether, ``before`` those ahead of the node.
    """

    def __init__(self, html: str | None):
        self.parent, self.tag, self.names, self.main = [-1], ["#page"], [frozenset()], [None]
        self.before, self.chars, self.links, self.controls, self.own, self.stops = [0], [0], [0], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._read(html or "")
        for n in range(len(self.parent) - 1, 0, -1):
            p = self.parent[n]
            for sums in (self.chars, self.links, self.controls):
                sums[p] += sums[n]

    def _node(self, tag: str, parent: int, attrs: str, seen: int) -> int:
        names, main = set(), None
        for m in ATTR.finditer(attrs):
            key = m[1].lower()
            if key in ("class", "id", "role", "itemprop", "aria-label"):
                names.update(t.lower() for t in TOKEN.findall(m[2] or m[3] or m[4] or ""))
            elif key == "data-main":
                main = (m[2] or m[3] or m[4]) == "1"
        for sums in (self.chars, self.links, self.controls, self.own, self.stops):
            sums.append(0)
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(frozenset(names))
        self.main.append(main)
        self.before.append(seen)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        # open elements, the block node each lies in and, of a block, the inline elements open around it
        stack: list[tuple[str, int, dict]] = [("#page", 0, {})]
        blocks: list[int] = []                             # places of the open blocks in the stack
        everywhere: dict[str, int] = {}                    # how many of each tag are open
        parts: list[str] = []
        state = {"seen": 0, "links": 0, "unseen": 0, "inline": {}}   # inline: open ones inside the last block

        def close_run(node: int) -> None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.runs.append((node, text))
                self.chars[node] += len(text)
                self.own[node] += len(text)
                self.stops[node] += text.endswith((".", "!", "?", ":", ";", "…", "”", '"'))
                self.links[node] += min(len(text), state["links"])
                state["seen"] += len(text)
            state["links"] = 0

        def push(tag: str, node: int) -> None:
            everywhere[tag] = everywhere.get(tag, 0) + 1
            if tag in BLOCK:
                blocks.append(len(stack))
                stack.append((tag, node, state["inline"]))
                state["inline"] = {}
            else:
                state["inline"][tag] = state["inline"].get(tag, 0) + 1
                state["unseen"] += tag in UNSEEN
                stack.append((tag, node, {}))

        def pop(to: int) -> None:
            while len(stack) > to:
                tag, node, around = stack.pop()
                everywhere[tag] -= 1
                if tag in BLOCK:
                    close_run(node)
                    blocks.pop()
                    state["inline"] = around
                else:
                    state["inline"][tag] -= 1
                    state["unseen"] -= tag in UNSEEN

        def text(piece: str) -> None:
            if piece and not state["unseen"]:
                parts.append(entities.unescape(piece))     # a reference does not reach across a tag
                if state["inline"].get("a"):
                    state["links"] += len(piece.strip())

        at, size = 0, len(html)
        while at < size:
            m = TAG.search(html, at)
            if m is None:
                text(html[at:])
                break
            text(html[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "br":
                    text(" ")
                open_ = everywhere if tag in BLOCK or tag in UNSEEN else state["inline"]
                if not open_.get(tag):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][0] in BLOCK and tag not in BLOCK and tag not in UNSEEN:
                        break                              # an inline end does not end a block
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                if tag == "textarea":
                    self.controls[stack[-1][1]] += 1
                at = end.end() if end else size
                continue
            if tag in CONTROLS:
                self.controls[stack[-1][1]] += 1
            if tag in VOID:
                if tag in ("br", "hr", "img"):
                    text(" ")
                if tag == "hr":
                    close_run(stack[-1][1])
                continue
            if tag == "body":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "head":
                        pop(k)
                        break
            if tag in BLOCK:
                last, stop = ENDS.get(tag, ({"p"}, {"td", "th", "table"}))
                for k in reversed(blocks[:]):
                    if stack[k][0] in last or stack[k][0] == "p" and tag in BLOCK:
                        pop(k)
                        if tag not in ENDS:
                            break
                    elif stack[k][0] in stop or tag not in ENDS and stack[k][0] in BLOCK:
                        break
                close_run(stack[-1][1])
                push(tag, self._node(tag, stack[-1][1], m[3] or "", state["seen"]))
            elif not (tag in UNSEEN and (m[3] or "").endswith("/>")):    # <svg/> holds nothing
                push(tag, stack[-1][1])
        pop(1)
        close_run(0)
