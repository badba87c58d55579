"""Labelled training pages: layouts drawn from a small grammar and filled
with sentences of the corpus. Every block's label is known by construction:
1 for the article, 0 for menus, headers, footers, sidebars, notices,
adverts, forms and reader comments."""

from __future__ import annotations

import html
import random

WORDS = {
    "nav": "nav navbar menu navigation breadcrumb breadcrumbs topnav links toc pagination tabs skip",
    "header": "header masthead banner branding top logo site tagline",
    "footer": "footer copyright colophon bottom legal credits imprint",
    "aside": "sidebar aside widget related recommended trending popular recent archive tags more side promo box",
    "ad": "ad ads advert advertisement sponsored sponsor promo promoted banner commercial adsbox",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay warning message privacy",
    "form": "form search login signup subscribe newsletter contact register feedback field",
    "comments": "comments comment reply respond discussion replies thread reader disqus responses",
    "share": "share social follow buttons author byline meta date posted",
}
CONTENT = "content main article post entry story body text page copy prose single".split()
TAGS = {"nav": "nav div ul", "header": "header div", "footer": "footer div", "aside": "aside div section", "ad": "div aside section",
        "notice": "div section aside", "form": "form div", "comments": "section div ol", "share": "div p ul"}


class Builder:
    def __init__(self, sentences: list[str], seed: int):
        self.rng, self.sentences = random.Random(seed), sentences

    def words(self, low, high):
        s = self.rng.choice(self.sentences).split() or ["x"]
        n = self.rng.randint(low, high)
        return " ".join((s * (n // len(s) + 1))[:n])

    def prose(self):
        return " ".join(self.rng.choice(self.sentences) for _ in range(self.rng.randint(1, 7)))

    def esc(self, t):
        return html.escape(t, quote=False)

    def link(self, t):
        return f'<a href="/{self.rng.randint(1, 999)}">{self.esc(t)}</a>'

    def piece(self, kind: str) -> list[tuple[str, int]]:
        """Inner markup of one boilerplate element with its labels."""
        r = self.rng
        if kind in ("nav", "aside") and r.random() < 0.7 or kind == "nav":
            items = [self.link(self.words(1, 4 if kind == "nav" else 9)) for _ in range(r.randint(2, 8))]
            if r.random() < 0.6:
                return [("<ul>", None)] + [(f"<li>{i}</li>", 0) for i in items] + [("</ul>", None)]
            if r.random() < 0.5:
                return [(" | ".join(items), 0)]
            return [(f"<div>{i}</div>", 0) for i in items]
        if kind == "form":
            return [(f"<label>{self.esc(self.words(1, 5))}</label><input name=q><button>{self.esc(self.words(1, 2))}</button>", 0)] + \
                   ([(f"<p>{self.esc(self.words(4, 25))}</p>", 0)] if r.random() < 0.5 else [])
        if kind == "comments":
            out = [(f"<h{r.randint(2, 4)}>{self.esc(self.words(1, 3))}</h3>", 0)] if r.random() < 0.6 else []
            for _ in range(r.randint(1, 5)):
                out += [(f"<div class=\"{r.choice(['comment', 'reply', 'c', 'item'])}\"><p>{self.esc(self.words(1, 3))}</p>", 0), (f"<p>{self.esc(self.prose())}</p></div>", 0)]
            return out
        if kind == "footer":
            return [(f"{r.choice(['&copy; ', '&#169; ', '', 'Copyright '])}{self.words(1, 3)} &middot; {self.esc(self.words(2, 16))}", 0)] + \
                   ([(f"<p>{self.link(self.words(1, 3))} {self.link(self.words(1, 3))}</p>", 0)] if r.random() < 0.4 else [])
        if kind == "header":
            return [(f"<{t}>{self.esc(self.words(1, 6))}</{t}>", 0) for t in r.sample(["h1", "p", "div", "h2"], r.randint(1, 2))]
        if kind == "share":
            return [(self.esc(self.words(1, 6)), 0)]
        return [(f"<p>{self.esc(self.words(3, 30))}</p>" if r.random() < 0.5 else self.esc(self.words(3, 30)), 0)]

    def wrap(self, kind: str) -> list[tuple[str, int]]:
        r = self.rng
        tag = r.choice(TAGS[kind].split())
        named = tag in ("div", "section", "p", "ul", "ol") or r.random() < 0.4
        name = ""
        if named:
            w = r.choice(WORDS[kind].split())
            name = f' {r.choice(["class", "id", "class"])}="{r.choice(["", "site-", "c-", "page_"])}{w}{r.choice(["", "-list", " box", "-1"])}"'
        return [(f"<{tag}{name}>", None), *self.piece(kind), (f"</{tag}>", None)]

    def article(self) -> list[tuple[str, int]]:
        r = self.rng
        title = r.choices(["h1", "h2", "div"], [8, 1, 1])[0]
        out = [(f"<{title}>{self.esc(self.words(2, 12))}</{title}>", 1)] if r.random() < 0.85 else []
        if out and r.random() < 0.1:
            out = [("<div>", None), *out, ("</div>", None)]
        plain = r.random() < 0.12  # every paragraph a div of its own
        for k in range(r.randint(1, 9)):
            x = r.random()
            t = self.esc(self.prose() if r.random() < 0.85 else self.words(1, 8))
            if plain and x < 0.7:
                out.append((f"<div>{t}</div>", 1))
            elif x < 0.12:
                out.append((f"<p><b>{t}<br>", 1))
            elif x < 0.2:
                out.append((f"<h{r.randint(2, 4)}>{self.esc(self.words(1, 8))}</h2>", 1))
            elif x < 0.27:
                out += [("<ul>", None)] + [(f"<li>{self.esc(self.words(2, 20))}</li>", 1) for _ in range(r.randint(2, 4))] + [("</ul>", None)]
            elif x < 0.33:
                out += [(f"<blockquote>{t}</blockquote>", 1)]
            elif x < 0.38:
                out += [(f"<div>{t}</div>", 1)]
            elif x < 0.42:
                out += [(f"<pre>{t}</pre>", 1)]
            else:
                out.append((f"<p>{t} {self.link(self.words(1, 3)) if r.random() < 0.15 else ''}</p>", 1))
            if r.random() < 0.06:
                out += self.wrap(r.choice(["ad", "aside", "share"]))
        return out

    def page(self) -> list[tuple[str, int]]:
        r = self.rng
        out = []
        for kind in ("notice", "header", "nav", "ad", "form"):
            if r.random() < {"nav": 0.8, "ad": 0.5}.get(kind, 0.35):
                out += self.wrap(kind)
        if r.random() < 0.3:
            out += self.wrap("aside")
        x = r.random()
        if x < 0.5:
            shell = ("<article>", "</article>")
        elif x < 0.63:
            shell = ("<main>", "</main>")
        elif x < 0.73:  # nothing says where the article is
            deep = r.randint(0, 3)
            shell = ("<div>" * deep, "</div>" * deep)
        elif x < 0.76:
            shell = r.choice([("<table><tr><td>", "</td></tr></table>"), ("<section>", "</section>")])
        else:
            shell = (f'<div {r.choice(["class", "id"])}="{r.choice(["", "post-", "entry-"])}{r.choice(CONTENT)}">', "</div>")
        if r.random() < 0.15:
            shell = ("<main>" + shell[0], shell[1] + "</main>")
        inner = self.article()
        if r.random() < 0.15:
            inner += self.wrap("comments")
        out += [(shell[0], None), *inner, (shell[1], None)]
        for kind in ("share", "comments", "aside", "ad", "form", "notice", "footer"):
            if r.random() < {"footer": 0.85, "comments": 0.35}.get(kind, 0.25):
                out += self.wrap(kind)
        if r.random() < 0.3:
            around = r.choice(["", ' id="page"', ' id="wrapper"', ' class="container"', ' id="root"', ' class="wrap"'])
            out = [(f"<div{around}>", None), *out, ("</div>", None)]
        return out


def labelled_pages(sentences: list[str], n: int, seed: int) -> list[list[tuple[str, int]]]:
    """``n`` pages as lists of (markup, label); the label is None for markup
    without text of its own."""
    b = Builder(sentences, seed)
    return [b.page() for _ in range(n)]
