"""Made-up pages with known blocks, on which the block labeller is trained.

A page is a list of parts, and each part a function of a random generator that yields (tag structure, label) pieces. What
the labeller is to learn is the structure of pages: what elements and class names enclose, how long blocks are, how many
links they have, and what stands before and after them. Words are made of syllables, as their meaning is not to be learned.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable

# Names that pages give to their parts, and what such parts say.
NAMES = {
    "content": "content article-body entry-content post-content post-body story-body story post entry main main-content page-content article-text text body-text richtext prose article article-content maincontent bodycopy copy story-text wysiwyg",
    "nav": "nav navbar menu main-menu topnav navigation breadcrumb breadcrumbs site-nav nav-links pagination pager tabs submenu toc-nav dropdown menu-item navlist categories",
    "header": "header site-header masthead page-header top topbar branding logo banner-top hdr head site-title tagline",
    "footer": "footer site-footer bottom colophon copyright legal foot footer-links page-footer site-info imprint ftr disclaimer",
    "side": "sidebar side aside rail right-rail widget related related-posts recommended trending popular more-stories secondary right-column left-column most-read teaser you-may-like read-more latest-news",
    "notice": "cookie cookie-banner consent gdpr notice alert newsletter subscribe popup modal paywall signup overlay cookie-notice privacy-notice announcement site-notice notification warning-bar",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot ad-banner adbox commercial banner-ad advertorial ad-unit partner-content dfp adsense promo-box",
    "form": "form search searchbox login contact-form subscribe-form signup-form newsletter-form poll feedback-form register",
    "comments": "comments comment comment-list discussion replies respond reader-comments responses thread comment-body disqus comments-area user-comments reply talkback guestbook",
    "share": "share social sharing share-buttons follow-us social-links tools print-tools share-bar tags post-meta",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SAYS = {
    "nav": "Home|News|Sport|Contact|About us|Business|World|Culture|Login|Archive|Shop|Blog|FAQ|Help|Next|Previous|Inicio|Accueil|Startseite|Kontakt|Contacto|Actualités",
    "header": "Welcome to our site|The daily news|Your source of news since 1998|Skip to content|Search|Sign in|My account",
    "footer": "All rights reserved.|Privacy policy|Terms of use|Copyright 2021|Imprint|Contact us|Powered by WordPress|Alle Rechte vorbehalten|Tous droits réservés|Todos los derechos reservados|Sitemap|© 2019",
    "side": "Related articles|Most read|You may also like|Popular posts|Recent posts|Trending now|Read more|Latest news|Tags|Categories|More from this author",
    "notice": "This site uses cookies to improve your experience.|We use cookies. By continuing to browse you accept our policy.|Accept|Subscribe to our newsletter!|Sign up for free to continue reading.|Please enable JavaScript.|Wir verwenden Cookies.|Nous utilisons des cookies.|You have read your last free article.",
    "ad": "Advertisement|Sponsored|Buy now and save 50%!|Limited offer, order today.|Special offer for our readers|Click here|Free shipping on all orders|Anzeige|Publicité|Win a prize now",
    "form": "Your name|E-mail|Message|Send|Search|Password|Log in|Submit|Remember me|Your comment|Choose a country",
    "comments": "Reply|Report|Great article, thanks for sharing!|I disagree with this.|3 comments|Leave a reply|Comments|posted 2 hours ago|says:|Anonymous wrote|Thanks!|Load more comments",
    "share": "Share|Tweet|Print|E-mail this|Follow us|Share on Facebook|Facebook|Twitter|LinkedIn|Copy link|Filed under",
}
SAYS = {k: v.split("|") for k, v in SAYS.items()}
SYLLABLES = ["the of and to in a is that it for on re th er an nd st es en on at or ti ng ing tion ly ed sh wh ble", "de la que el en y los se las un con ar os ci do ra ado mente", "le de et les des du un une en est au eur aux ment oi é è", "der die und das ein ich ung sch en er ge be ver keit zu ä ü", "ka lo mi ne ru ta shi ko na vo pe zi"]
SYLLABLES = [s.split() for s in SYLLABLES]


class Writer:
    """Words, sentences and the pieces of a page; keeps the text and label of each block in page order."""

    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.syllables = rng.choice(SYLLABLES)
        self.out: list[str] = []
        self.blocks: list[tuple[str, int]] = []
        self.plain = rng.random() < 0.15  # a page whose names say nothing

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, least: int = 3, most: int = 22) -> str:
        words = [self.word() for _ in range(self.rng.randint(least, most))]
        if len(words) > 8 and self.rng.random() < 0.5:
            words[len(words) // 2] += ","
        return " ".join(words).capitalize() + self.rng.choice("....?!")

    def prose(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def words(self, most: int = 4) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(1, most))).capitalize()

    def named(self, kind: str, sure: bool = False) -> str:
        """A class or id, or (unless sure) none, as a page might name this kind of part."""
        rng = self.rng
        if not sure and (self.plain or rng.random() < 0.12):
            return rng.choice(["", "", f' class="{rng.choice("abcxyz")}{rng.randint(1, 99)}"', f' class="css-{rng.randrange(16**6):06x}"'])
        name = rng.choice(NAMES[kind])
        if rng.random() < 0.25:
            name += " " + rng.choice(["clearfix", "col-8", "row", "box", "wide", "block", "inner", "wrap", rng.choice(NAMES[kind])])
        quote = rng.choice(['"', '"', "'"])
        return f" {rng.choice(['class', 'class', 'id'])}={quote}{name}{quote}"

    def block(self, tag: str, text: str, label: int, attrs: str = "", inside: Callable[[str], str] = lambda t: t) -> None:
        rng = self.rng
        shown = html.escape(text, quote=False) if rng.random() < 0.8 else html.escape(text).replace(" ", "&nbsp;", 1)
        close = f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.9 else ""
        self.out.append(f"<{tag}{attrs}>{inside(shown)}{close}" + rng.choice(["", "\n", "\n  "]))
        self.blocks.append((text, label))

    def open(self, tag: str, attrs: str = "") -> None:
        self.out.append(f"<{tag}{attrs}>")

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")


def link(text: str) -> str:
    return f'<a href="/{len(text)}">{text}</a>'


def said(w: Writer, kind: str) -> str:
    return w.rng.choice(SAYS[kind]) if w.rng.random() < 0.55 else w.words()


def links(w: Writer, kind: str, tag: str) -> None:
    """A list of links, as menus, footers and sidebars have."""
    rng = w.rng
    w.open(tag, w.named(kind))
    if kind == "side" and rng.random() < 0.7:
        w.block(rng.choice(["h2", "h3", "h4", "p"]), said(w, kind), 0)
    flat = rng.random() < 0.3
    if not flat:
        w.open("ul")
    for _ in range(rng.randint(1, 9)):
        text = said(w, kind) if kind != "side" else w.sentence(3, 9)
        w.block("div" if flat else "li", text, 0, inside=link)
    if not flat:
        w.close("ul")
    w.close(tag)


def note(w: Writer, kind: str, tag: str, inside: bool = False) -> None:
    """A notice, advert or line of a header or footer: one or a few sentences. Inside an article it has a name, or
    nothing would tell it from the article."""
    rng = w.rng
    bare = rng.random() < 0.5
    if not bare:
        w.open(tag, w.named(kind, inside))
    for _ in range(1 if bare else rng.randint(1, 3)):
        text = said(w, kind) if rng.random() < 0.5 else w.sentence(2, 14) if rng.random() < 0.7 else w.prose(3)
        if kind == "footer" and rng.random() < 0.5:
            text = "© " + text
        w.block(tag if bare else rng.choice(["p", "div", "p"]), text, 0, w.named(kind, inside) if bare else "", rng.choice([lambda t: t, lambda t: t, link]))
    if not bare:
        w.close(tag)


def form(w: Writer) -> None:
    rng = w.rng
    w.open("form", w.named("form") + ' action="/go"')
    for _ in range(rng.randint(1, 5)):
        w.block(rng.choice(["p", "div", "li", "legend"]), said(w, "form"), 0, inside=lambda t: f'<label>{t}</label> <input name="q">')
    if rng.random() < 0.5:
        w.block("button", rng.choice(SAYS["form"]), 0)
    w.close("form")


def comments(w: Writer) -> None:
    rng = w.rng
    outer = rng.choice(["div", "section", "ol", "ul", "aside"])
    w.open(outer, w.named("comments"))
    if rng.random() < 0.7:
        w.block(rng.choice(["h2", "h3", "p"]), rng.choice(["Comments", "3 comments", "Discussion", "Leave a reply", w.words()]), 0)
    for _ in range(rng.randint(1, 6)):
        tag = "li" if outer in ("ol", "ul") else rng.choice(["div", "article", "div"])
        w.open(tag, w.named("comments", tag == "article"))
        if rng.random() < 0.6:
            w.block(rng.choice(["div", "p", "h4"]), w.words(2) + rng.choice(["", " says:", " wrote 2 days ago"]), 0)
        for _ in range(rng.choice((1, 1, 2))):
            w.block(rng.choice(["p", "p", "div"]), w.prose(3) if rng.random() < 0.8 else said(w, "comments"), 0)
        if rng.random() < 0.5:
            w.block("div", rng.choice(["Reply", "Report", "Like"]), 0, inside=link)
        w.close(tag)
    w.close(outer)


def boilerplate(w: Writer, kind: str, inside: bool = False) -> None:
    rng = w.rng
    if kind == "form":
        return form(w)
    if kind == "comments":
        return comments(w)
    tags = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div", "p"], "side": ["aside", "aside", "div", "section"]}.get(kind, ["div", "div", "section", "aside", "p"])
    tag = rng.choice(tags)
    if kind in ("nav", "side") or kind in ("footer", "share", "header") and rng.random() < 0.4:
        return links(w, kind, "div" if tag in ("ul", "p") else tag)
    return note(w, kind, "div" if tag == "ul" else tag, inside)


def article(w: Writer) -> None:
    rng = w.rng
    wraps = []
    for _ in range(rng.choice((0, 1, 1, 1, 2, 3))):
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        if tag == "td":
            w.open("table")
            w.open("tr")
        w.open(tag, w.named("content") if tag in ("div", "td", "section") or rng.random() < 0.4 else "")
        wraps.append(tag)
    if rng.random() < 0.85:
        head = rng.random() < 0.15 and bool(wraps)
        if head:
            w.open("header")
        w.block(rng.choice(["h1", "h1", "h1", "h2"]), w.sentence(2, 12).rstrip(".?!") if rng.random() < 0.7 else w.sentence(2, 12), 1)
        if head:
            w.close("header")
    for _ in range(rng.choice((1, 2, 3, 4, 6, 8, 12, 20))):
        what = rng.random()
        if what < 0.74:
            some = rng.choice([lambda t: t, lambda t: t, lambda t: t, lambda t: f"<b>{t}<br>", lambda t: f"<em>{t}</em>", lambda t: " ".join(link(x) if w.rng.random() < 0.06 else x for x in t.split(" "))])
            w.block("p" if rng.random() < 0.9 else "div", w.prose() if rng.random() < 0.85 else w.sentence(1, 6), 1, inside=some)
        elif what < 0.81:
            w.block(rng.choice(["h2", "h3"]), w.words(7), 1)
        elif what < 0.86:
            tag = rng.choice(["ul", "ol"])
            w.open(tag)
            for _ in range(rng.randint(2, 6)):
                w.block("li", w.sentence(2, 14), 1)
            w.close(tag)
        elif what < 0.88:
            w.open("blockquote")
            w.block("p", w.prose(3), 1)
            w.close("blockquote")
        elif what < 0.90:
            w.block(rng.choice(["pre", "figcaption"]), w.sentence(), 1)
        elif what < 0.92:
            w.open("table")
            for _ in range(rng.randint(2, 4)):
                w.open("tr")
                for _ in range(rng.randint(2, 3)):
                    w.block("td", w.words(3), 1)
                w.close("tr")
            w.close("table")
        else:
            boilerplate(w, rng.choice(["ad", "ad", "share", "side", "notice", "form"]), True)
    if rng.random() < 0.15:
        boilerplate(w, rng.choice(["comments", "share"]))
    for tag in reversed(wraps):
        if tag == "td" and rng.random() < 0.3:
            w.open("td", w.named("side"))
            w.block("p", said(w, "side"), 0, inside=link)
            w.close("td")
        w.close(tag)
        if tag == "td":
            w.close("tr")
            w.close("table")


def made_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """(html, [(text of the block, 1 for main text)]) of one page."""
    rng = random.Random(seed)
    w = Writer(rng)
    w.open("html")
    w.out.append(f"<head><title>{w.words(6)}</title><style>p{{margin:0}}</style></head>")
    w.open("body")
    shell = rng.random() < 0.4
    if shell:
        w.open("div", rng.choice([' id="page"', ' class="wrapper"', ' class="container"', ""]))
    before = [k for k in ("notice", "header", "nav", "ad", "form", "share", "side") if rng.random() < {"nav": 0.75, "header": 0.5, "ad": 0.35, "side": 0.2}.get(k, 0.15)]
    after = [k for k in ("share", "comments", "side", "ad", "form", "notice", "nav", "footer") if rng.random() < {"footer": 0.8, "comments": 0.3, "side": 0.35}.get(k, 0.12)]
    if rng.random() < 0.5:
        rng.shuffle(before)
    for kind in before:
        boilerplate(w, kind)
    if rng.random() < 0.93:
        article(w)
    for kind in after:
        boilerplate(w, kind)
    if shell:
        w.close("div")
    w.close("body")
    w.close("html")
    return "".join(w.out), w.blocks
