"""Plain per-page walks with the standard parser, to check the column version against."""

from html.parser import HTMLParser

from sitegrain import constants as K


class Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.chars = 0
        self.starts = []
        self.nodes = []  # (parent, depth, tag, line)
        self.open = []  # (index, tag)
        self.block = ""

    def handle_starttag(self, tag, attrs):
        self.starts.append(tag)
        if tag in K.QUIET_TAGS:
            self.hidden += 1
            return
        if tag in K.CLOSES_PARAGRAPH and self.block == "p":
            self._pop("p")
            self.block = ""
        if tag in K.STRUCTURAL_TAGS:
            parent = self.open[-1][0] if self.open else 0
            self.nodes.append((parent, len(self.open), tag, self.getpos()[0]))
            if tag not in K.VOID_TAGS:
                self.open.append((len(self.nodes), tag))
        if tag in K.HEADING_TAGS or tag == "p":
            self.block = tag

    def handle_endtag(self, tag):
        if tag in K.QUIET_TAGS:
            self.hidden = max(0, self.hidden - 1)
            return
        if tag in K.STRUCTURAL_TAGS:
            self._pop(tag)
        if tag == self.block:
            self.block = ""

    def _pop(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][1] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if not self.hidden:
            self.chars += len(data.strip())


def walk(html):
    w = Walk()
    w.feed(html)
    w.close()
    return w


def outline(nodes, max_nodes, max_depth):
    """(kept indexes, dropped by depth, dropped by count), entering subtrees one by one."""
    kids = {}
    for i, (parent, *_rest) in enumerate(nodes, 1):
        kids.setdefault(parent, []).append(i)

    def size(i):
        return 1 + sum(size(k) for k in kids.get(i, []))

    kept, deep, many = [], 0, 0

    def visit(i):
        nonlocal deep, many
        for k in kids.get(i, []):
            if nodes[k - 1][1] > max_depth:
                deep += size(k)
            elif len(kept) >= max_nodes:
                many += size(k)
            else:
                kept.append(k)
                visit(k)

    visit(0)
    return kept, deep, many
