"""DOM leaf blocks of a page: runs of inline text between block-level tags."""

from __future__ import annotations

import html
import re
from collections import Counter

# a quote opens a value behind an equals sign only, and only if it is closed somewhere
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>|<[!?/][^>]*>|[^<]+|<""", re.S)
# behind the last tag that ends: an open tag reaches to the next one
_LOOSE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?|<[!?/][^<>]*>?|[^<]+|<""", re.S)
_STARTS = re.compile(r"/?[a-zA-Z]|[!?/]")
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""display\s*:\s*none|(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([a-zA-Z]+)""")

BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template iframe object svg math canvas audio video textarea select head".split())
RAW = frozenset("script style textarea template noscript iframe title".split())
#: What a start tag closes when it is still open (its scope ends at the second set).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}


class Open:
    """An open block element. What it shares with its parent (distinct tags
    above, distinct names, hidden) is held once, so depth costs nothing."""

    __slots__ = ("tag", "parent", "up", "above", "tags", "names", "hidden")

    def __init__(self, tag: str, names: list[str], hidden: bool, parent: "Open | None"):
        self.tag, self.parent, self.up = tag, parent, parent.tag if parent else "none"
        self.above = parent.tags if parent else ()
        self.tags = self.above if tag in self.above else (*self.above, tag)
        known = parent.names if parent else {}
        new = [w for w in names if w not in known]
        self.names = {**known, **dict.fromkeys(new)} if new else known
        self.hidden = hidden or bool(parent and parent.hidden)


_TOP = Open("none", [], False, None)  # text outside of any block
_TOP.tags = ()


class Block:
    """``own`` and ``up``: the innermost block tag and the one around it;
    ``above``: distinct tags around the innermost; ``tags``: with it;
    ``names``: distinct words of class, id and role; ``linked``: characters
    inside links."""

    __slots__ = ("text", "at", "own", "up", "above", "tags", "names", "linked", "hidden")

    def __init__(self, text: str, at: Open, linked: int):
        self.text, self.at, self.linked = text, at, linked
        self.own, self.up, self.above, self.tags, self.names, self.hidden = at.tag, at.up, at.above, at.tags, at.names, at.hidden

    @property
    def path(self) -> tuple[str, ...]:
        """All open block tags, outermost first."""
        out, at = [], self.at
        while at is not None and at is not _TOP:
            out.append(at.tag)
            at = at.parent
        return tuple(reversed(out))


def _next(page: str, pos: int, token: re.Pattern) -> tuple[re.Match, re.Pattern]:
    """Next token and the pattern to go on with: a tag that never ends turns
    to the loose one for the rest, so the page is read to its end once."""
    m = token.match(page, pos)
    if token is _TOKEN and m[0] == "<" and _STARTS.match(page, pos + 1):
        return _LOOSE.match(page, pos), _LOOSE
    return m, token


def declared_language(page: str) -> str | None:
    """Language of the ``html`` tag, its primary subtag in lower case."""
    pos, token = 0, _TOKEN
    while pos < len(page):
        m, token = _next(page, pos, token)
        pos = m.end()
        if m[2] and m[2].lower() == "html" and not m[1]:
            found = _LANG.search(m[3])
            return found[1].lower() if found else None
        if m[2] and m[2].lower() == "body":
            return None
    return None


def blocks(page: str) -> list[Block]:
    """Non-empty leaf blocks in page order. Character references are
    decoded, white space is one space. Time grows with the page's length
    whatever its depth, unclosed tags or quotes (names that are new at every
    level are features of all below, and add up). A quote that is
    never closed belongs to its tag up to the next ``>``; a tag that never
    ends reaches to the next ``<``."""
    out: list[Block] = []
    stack: list[Open] = []
    opened: Counter = Counter()
    never: set[str] = set()
    token = _TOKEN
    buf: list[str] = []
    links: list[str] = []
    depth_a = 0
    pos, n = 0, len(page)

    def flush():
        nonlocal depth_a
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                out.append(Block(text, stack[-1] if stack else _TOP, linked))
            buf.clear()
            links.clear()

    def close(k):
        for s in stack[k:]:
            opened[s.tag] -= 1
        del stack[k:]

    def behind(tag, pattern, at):
        """End of a skipped element; one that is nowhere is sought once."""
        if tag in never:
            return None
        end = re.compile(pattern, re.I).search(page, at)
        if end is None:
            never.add(tag)
        return end

    while pos < n:
        m, token = _next(page, pos, token)
        pos = m.end()
        tag = m[2]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                buf.append(t)
                if depth_a:
                    links.append(t)
            continue
        tag = tag.lower()
        if m[1]:  # end tag
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            elif tag in BLOCK:
                flush()
                if opened[tag]:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
                depth_a = 0
            continue
        if tag in SKIP:
            if tag == "head":
                end = behind(tag, r"</head\s*>|<body[\s>]", _past_raw(page, pos))
                pos = (end.start() if end[0].lower().startswith("<body") else end.end()) if end else pos
            elif not m[3].rstrip().endswith("/"):
                end = behind(tag, rf"</{tag}\b[^>]*>", pos)
                pos = end.end() if end else (n if tag in RAW else pos)
            buf.append(" ")
            continue
        if tag == "title":
            end = behind(tag, r"</title\s*>", pos)
            pos = end.end() if end else pos
            continue
        if tag == "br":
            buf.append(" ")
            if depth_a:
                links.append(" ")
        elif tag == "a":
            depth_a = 1
        elif tag in BLOCK:
            flush()
            depth_a = 0
            if tag in VOID:
                continue
            if stack and stack[-1].tag == "p":  # a block ends an open paragraph
                close(len(stack) - 1)
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                if any(opened[t] for t in ends):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].tag in ends:
                            close(k)
                            break
                        if stack[k].tag in scope:
                            break
            names = [w for a in _ATTR.findall(m[3]) for w in _WORD.findall("".join(a).lower())] if m[3] else []
            stack.append(Open(tag, names, bool(m[3]) and bool(_HIDDEN.search(m[3])), stack[-1] if stack else None))
            opened[tag] += 1
    flush()
    return out


def _past_raw(page: str, pos: int) -> int:
    """Position behind the raw text elements that open a head."""
    while True:
        m = re.compile(r"<(script|style|title|template|noscript)\b[^>]*>|</head\s*>|<body[\s>]", re.I).search(page, pos)
        if not m or not m[1]:
            return pos
        end = re.compile(rf"</{m[1]}\b[^>]*>", re.I).search(page, m.end())
        if not end:
            return m.end()
        pos = end.end()
