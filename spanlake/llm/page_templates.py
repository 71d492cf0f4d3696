"""Made-up pages with known main text: the labelled rows of the extraction model.

Words, lengths, nesting, tags and names are drawn anew for every page, so that no single sign (a tag, a class, a length) decides.
Text that belongs to the article starts with ``MARK``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "\ue000"

# Words of class and id attributes by what they mostly name.
NAMES = {
    "main": "article content main post entry story text body".split(),
    "menu": "nav menu navbar breadcrumbs breadcrumb navigation tabs toc pagination links".split(),
    "header": "header masthead top logo branding topbar".split(),
    "footer": "footer bottom copyright colophon legal foot".split(),
    "side": "sidebar aside widget related rail secondary recommended trending popular more".split(),
    "notice": "notice cookie consent alert gdpr popup modal warning message newsflash".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsense commercial".split(),
    "form": "form newsletter subscribe search login signup contact".split(),
    "comments": "comments comment discussion replies respond disqus thread feedback".split(),
    "share": "share social sharing follow tags".split(),
    "": "container wrapper row col inner outer grid block box clearfix page site layout wrap left right center region".split(),
}
_TAGS = {"main": "article main section div div", "menu": "nav nav div ul", "header": "header header div", "footer": "footer footer div", "side": "aside aside div section",
         "notice": "div div section aside", "ad": "div div aside ins section", "form": "form form div section", "comments": "section section div aside ol", "share": "div ul p"}
_SYLLABLES = "a the on er in st re to sch ung en de la ción qu eau ment é ü wh li ka to mo ra ne vi su".split()
#: Elements that blocks without a name are.
_PLAIN = {"ad": "aside", "notice": "aside", "side": "aside", "comments": "aside", "footer": "footer", "header": "header", "form": "form"}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.named = rng.random() < 0.8  # some pages name nothing
        self.noisy = rng.random() < 0.15  # some texts are full of signs
        self.mean = rng.choice((4, 15, 40, 80))

    def words(self, low: int, high: int, stops: bool = True) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(low, high)):
            word = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
            if self.noisy:
                word += r.choice(("&amp;&amp;", "%%%", "***", "$$$", "###", ""))
            out.append(word + (r.choice((".", ".", ",", ",", "!", "?")) if stops and r.random() < 0.13 else ""))
        return " ".join(out).capitalize() + ("." if stops else "")

    def attributes(self, role: str, p: float = 0.85) -> str:
        r = self.rng
        if not (self.named and r.random() < p):
            return ""
        word = r.choice(NAMES[role] or NAMES[""])
        if r.random() < 0.35:  # compounds, also with names of the article: sidebar-content, post-comments
            other = r.choice(NAMES[r.choice(("", "main", role) if role != "main" else ("", "main"))])
            word = r.choice(("-", "_", "__")).join(r.sample([word, other], 2)) if r.random() < 0.8 else word + other.capitalize()
        if role == "main" and r.random() < 0.1:
            word = r.choice(NAMES[""])
        return f' {r.choice(("class", "class", "id"))}="{word}{r.choice(("", "", " " + r.choice(NAMES[""]), "-" + str(r.randint(1, 9))))}"'

    def block(self, role: str, inner: str) -> str:
        r = self.rng
        tag, named = r.choice(_TAGS[role].split()), self.attributes(role)
        if not named and role in _PLAIN:  # a reader could not tell it from the article either
            tag = _PLAIN[role]
        if tag in ("ul", "ol") and not inner.startswith("<li"):
            tag = "div"
        if r.random() < 0.1:
            inner = f"<div{self.attributes('')}>{inner}</div>"
        extra = ' role="navigation"' if role == "menu" and r.random() < 0.1 else ""
        return f"<{tag}{named}{extra}>{inner}</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        r, kind = self.rng, self.rng.choice(("li", "li", "li", "li", "a", "a", "bar", "bar", "p", "p", "plain"))
        items = [f'<a href="/{i}">{self.words(1, r.choice((1, 3, 8)), False)}</a>' for i in range(r.randint(low, high))]
        if kind == "li":
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if r.random() < 0.9 else "") for x in items) + "</ul>"
        if kind == "plain":
            return "<ul>" + "".join(f"<li>{self.words(1, 3, False)}</li>" for _ in items) + "</ul>"
        return (" | " if kind == "bar" else " ").join(items) if kind != "p" else "".join(f"<p>{x}</p>" for x in items)

    def heading(self, text: str, mark: str = "", levels: str = "234") -> str:
        level = self.rng.choice(levels)
        return f"<h{level}>{mark}{text}</h{level}>"

    def prose(self, mark: str, paragraphs: int) -> str:
        """Paragraphs in one of the ways that pages have."""
        r, out = self.rng, []
        kind = r.choice(("p", "p", "p", "bold", "div", "br", "mixed"))
        for _ in range(paragraphs):
            longest = r.choice((1, 3, 15))
            text = mark + self.words(1, max(1, int(r.expovariate(1 / self.mean))))
            if r.random() < 0.2:
                text += f' <a href="/x">{self.words(1, 4, False)}</a> {self.words(1, 9)}'
            form = kind if kind != "mixed" else r.choice(("p", "bold", "div", "list", "quote", "table", "head", "figure"))
            if kind == "p" and r.random() < 0.15:
                form = r.choice(("list", "quote", "head", "table", "bold"))
            out.append({"p": f"<p>{text}</p>", "bold": f"<p><b>{text}<br>", "div": f"<div>{text}</div>", "br": f"{text}<br><br>",
                        "quote": f"<blockquote><p>{text}</p></blockquote>", "figure": f"<figure><img src=x><figcaption>{text}</figcaption></figure>",
                        "list": "<ul>" + "".join(f"<li>{mark}{self.words(1, longest, r.random() < 0.5)}</li>" for _ in range(r.randint(1, 6))) + "</ul>",
                        "table": "<table>" + "".join(f"<tr><td>{mark}{self.words(1, 3, False)}<td>{mark}{r.randint(1, 9999)}</tr>" for _ in range(r.randint(1, 5))) + "</table>",
                        "head": self.heading(self.words(1, 7, False), mark)}[form])
        return "".join(out)

    def notice(self) -> str:
        return self.block("notice", self.rng.choice(("{0}", "<p>{0}</p>", "<p>{0}</p><button>OK</button>", '{0} <a href="/p">more</a>')).format(self.words(3, 40)))

    def advert(self) -> str:
        text = self.words(2, self.rng.choice((8, 25, 60)))
        return "<!-- ad -->" * self.rng.randint(0, 1) + self.block("ad", self.rng.choice(("{0}", "{0}", "<p>{0}</p>", '<a href="/buy">{0}</a>', "<h4>Ad</h4><p>{0}</p>")).format(text))

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3, False)} <input name=f{i}></label>" for i in range(self.rng.randint(1, 4)))
        return self.block("form", f"<p>{self.words(2, 25)}</p>" * self.rng.randint(0, 1) + fields + "<button>Send</button>")

    def side(self) -> str:
        r = self.rng
        parts = [self.heading(self.words(1, 4, False)) + r.choice((self.links(), f"<p>{self.words(3, 40)}</p>", self.links() + f"<p>{self.words(2, 20)}</p>")) for _ in range(r.randint(1, 3))]
        return self.block("side", "".join(parts))

    def share(self) -> str:
        return self.block("share", self.links(2, 5))

    def comments(self) -> str:
        r, out = self.rng, []
        tag = r.choice(("div", "li", "article", "section"))
        for i in range(r.randint(1, 6)):
            text = self.words(1, r.choice((10, 40, 90)))
            head = r.choice(("<b>{0}</b> {1} ", "<div>{0} {1}</div>", "<h4>{0}</h4>", "")).format(self.words(1, 2, False), f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 24)}")
            body = f"<p>{text}</p>" if r.random() < 0.7 else text
            out.append(f"<{tag}{self.attributes('comments', 0.6)}>{head}{body}{'<a href=#r>Reply</a>' * r.randint(0, 1)}</{tag}>")
        title = self.heading(r.choice((f"{len(out)} comments", "Comments", self.words(1, 3, False)))) * (r.random() < 0.8)
        body = "".join(out)
        return self.block("comments", title + (f"<ol>{body}</ol>" if tag == "li" else body) + (self.form() if r.random() < 0.3 else ""))

    def footer(self) -> str:
        r = self.rng
        text = r.choice((f"&copy; 20{r.randint(10, 24)} {self.words(1, 3, False)}", f"&copy; {self.words(1, 2, False)} &middot; {self.words(2, 20)}", self.words(2, 30)))
        return self.block("footer", r.choice((text, f"<p>{text}</p>", self.links() + f"<p>{text}</p>", f"{text} {self.links(1, 4)}")))

    def article(self) -> str:
        r = self.rng
        title = f"<h1>{MARK}{self.words(1, 12, r.random() < 0.5)}</h1>" * (r.random() < 0.85)
        if r.random() < 0.15 and title:
            title = f"<header>{title}</header>"
        parts = [self.prose(MARK, r.choice((1, 1, 2, 4, 8, 20)))]
        for extra, p in ((self.advert, 0.2), (self.share, 0.15), (self.side, 0.12), (self.notice, 0.08), (self.form, 0.08)):
            if r.random() < p:
                parts.insert(r.randint(0, len(parts)), extra())
        if len(parts) > 1 or r.random() < 0.1:
            parts.append(self.prose(MARK, r.choice((1, 3))))
        inside = title + "".join(parts)
        if r.random() < 0.15:
            inside += self.comments()
        if r.random() < 0.1:  # straight below what is around it
            return inside
        if r.random() < 0.08:
            return f"<table><tr><td>{self.links()}</td><td>{inside}</td></tr></table>"
        return self.block("main", inside)

    def html(self) -> str:
        r = self.rng
        head = f'<html><head><meta charset="utf-8"><title>{self.words(1, 8, False)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body{self.attributes("", 0.2)}>'
        if r.random() < 0.02:
            return MARK + self.words(1, 60)
        before = [p() for p, share in ((lambda: self.block("header", self.words(1, 4, False) + (self.links() if r.random() < 0.5 else "")), 0.5), (lambda: self.block("menu", self.links()), 0.7),
                                       (self.notice, 0.2), (self.advert, 0.4), (self.form, 0.1)) if r.random() < share]
        after = [p() for p, share in ((self.share, 0.15), (self.comments, 0.3), (self.side, 0.35), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.15)) if r.random() < share]
        middle = self.article() if r.random() < 0.96 else ""
        if r.random() < 0.2 and before:
            r.shuffle(before)
        if r.random() < 0.15:
            before.append(self.side())
        body = "".join(before) + middle + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            body = f"<div{self.attributes('')}>{body}</div>"
        body += self.footer() * (r.random() < 0.8) + (self.notice() if r.random() < 0.1 else "")
        out = head + body + "</body></html>"
        return out.replace("</p>", "") if r.random() < 0.05 else out


def pages(number: int, seed: int) -> Iterator[str]:
    """``number`` pages; the same seed gives the same pages."""
    for i in range(number):
        yield _Page(random.Random(f"{seed}/{i}")).html()
