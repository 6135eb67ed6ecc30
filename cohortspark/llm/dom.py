"""A small forgiving DOM for page extraction."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split())
#: a start tag of these ends an open element of the value
_ENDS_P = BLOCKS - {"option", "optgroup", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
             "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPES = frozenset("ul ol dl table select article section div body html main nav aside form".split())


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings, in order

    def label(self) -> str:
        """What must agree for two nodes to be aligned: tag, id and classes without digits."""
        names = f"{self.attrs.get('id', '')}.{self.attrs.get('class', '')}"
        return f"{self.tag}#{re.sub(r'[0-9]+', '', names)}" if len(names) > 1 else self.tag


def _close(stack: list[Node], tags, scopes) -> None:
    """End the innermost open element among ``tags``, unless a scope stands in between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scopes:
            return


def parse(text: str) -> Node:
    """The tree of a page; unclosed and stray tags are put up with."""
    root = Node("#root")
    stack, at, lower = [root], 0, None
    for_ = _TOKEN.search
    while True:
        m = for_(text, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(text[at : m.start()]))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in VOID:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, _SCOPES)
        if tag in _SIBLINGS:
            _close(stack, _SIBLINGS[tag], _SCOPES)
        node = Node(tag, {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])} if "=" in m[3] else {})
        stack[-1].children.append(node)
        if tag in RAW:
            lower = lower or text.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(text) else text.find(f"</{tag}", at)
            at = len(text) if end < 0 else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(html.unescape(text[at:]))
    return root
