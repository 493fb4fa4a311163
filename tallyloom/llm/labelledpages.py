"""Labelled pages that the HTML extractor is trained on: layouts with known main text, filled with made-up words.

Layouts differ in what marks the article (its tag, a class, an id, nothing), in what stands around and inside it, and in how well the markup is closed. Words are random syllables, so nothing can be learnt from an article's words; paragraphs have one word to hundreds, and adverts, notices and comments are written like paragraphs too. The same seed gives the same pages.
"""

from __future__ import annotations

import random
from html import escape

#: Names that web pages commonly give to the parts of a page, and common wordings of what isn't an article.
ARTICLE_NAMES = ["article", "post", "entry", "content", "story", "main", "article-body", "post-content", "entry-content", "story-body", "text", "page-content"]
MENU_NAMES = ["menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "toc", "tabs", "site-nav"]
HEADER_NAMES = ["header", "masthead", "site-header", "banner", "topbar", "branding"]
FOOTER_NAMES = ["footer", "site-footer", "bottom", "colophon", "copyright", "legal"]
SIDE_NAMES = ["sidebar", "aside", "widget", "related", "rail", "recommended", "popular", "more-stories", "trending", "tags", "author-box"]
NOTICE_NAMES = ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "paywall", "announcement"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor"]
COMMENT_NAMES = ["comments", "comment-list", "comment", "responses", "discussion", "replies", "disqus", "reader-comments"]
SHARE_NAMES = ["share", "social", "sharing", "share-buttons", "follow"]
FORM_NAMES = ["newsletter", "search", "subscribe", "signup", "contact-form", "login"]
PHRASES = {
    "menu": ["Home", "About us", "Contact", "Login", "Sign in", "News", "Sports", "Startseite", "Accueil", "Inicio", "Kontakt", "Menu", "Next", "Previous", "Skip to content"],
    "footer": ["All rights reserved.", "Privacy policy", "Terms of use", "Impressum", "Datenschutz", "Mentions légales", "Aviso legal", "Powered by", "Sitemap"],
    "notice": ["We use cookies to improve this site.", "This site uses cookies. Accept", "Accept all cookies", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies.", "Subscribe to read the full story.", "Your browser is out of date."],
    "ad": ["Advertisement", "Sponsored", "Buy now", "Anzeige", "Publicité", "Publicidad", "Special offer"],
    "comments": ["Comments", "Leave a reply", "Reply", "Kommentare", "Commentaires", "Comentarios", "Log in to comment", "3 comments"],
    "share": ["Share", "Tweet", "Share on Facebook", "Follow us", "Print", "Email this"],
    "form": ["Subscribe", "Your email", "Search", "Sign up for our newsletter", "Submit", "Send", "Password", "Remember me"],
    "side": ["Related articles", "Most read", "You may also like", "Tags", "Trending", "Recent posts", "Read more", "About the author"],
}
SYLLABLES = "an the er ing on re ti ou st en ver sch ge lich eau que ment oi ción ado os ar lo mi ta vé ß ñ ö é ka ru po".split()


class Layout:
    """One page: its markup in `out`, its main text in `main`."""

    def __init__(self, seed: int):
        self.rng, self.out, self.main = random.Random(seed), [], []
        self.marks = self.rng.choice(["tags", "classes", "both", "both", "bare"])

    def some(self, of: list[str]) -> str:
        return self.rng.choice(of)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = min(high, max(low, round(low + self.rng.expovariate(1) * (high - low) / 3)))
        out = ["".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(n)]
        for k in range(0, n, self.rng.randint(4, 15)):
            out[k] = out[k].capitalize()
            out[k - 1] += self.some([".", ".", ",", "?", " & co.", "%%%"]) if k else ""
        return " ".join(out) + ("." if self.chance(0.85) else "")

    def named(self, names: list[str], tag: str, plain: str = "div") -> tuple[str, str]:
        """Opening and closing tag of a part, told by its tag, its name, both or neither."""
        if self.marks == "bare":
            return f"<{plain}>", f"</{plain}>"
        name = self.some(names) + self.some(["", "", "-wrapper", f" c{self.rng.randint(0, 99)}", "-inner"])
        mark = f' {self.some(["class", "class", "id"])}="{name}"' if self.marks != "tags" or tag == plain else ""
        tag = plain if self.marks == "classes" else tag
        return f"<{tag}{mark}>", f"</{tag}>"

    def put(self, *parts: str) -> None:
        self.out += parts

    def inline(self, text: str) -> str:
        """Escaped, with some words in inline tags."""
        words = escape(text, quote=False).split(" ")
        for _ in range(self.rng.randint(0, 2)):
            k = self.rng.randrange(len(words))
            tag = self.some(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return self.some([" ", " ", "\n", "  "]).join(words)

    def links(self, kind: str, names: list[str], tag: str) -> None:
        start, end = self.named(names, tag)
        item = self.some(["li", "li", "div", "p", "span"])
        labels = [self.some([self.some(PHRASES[kind]), self.words(1, 3).rstrip("."), self.words(1, 8)]) for _ in range(self.rng.randint(1, 12))]
        wrap = ("<ul>", "</ul>") if item == "li" else ("", "")
        self.put(start, self.some(["", "", f"<h3>{self.some(PHRASES[kind])}</h3>"]), wrap[0], *[f'<{item}><a href="/{k}">{escape(x)}</a></{item}>' for k, x in enumerate(labels)], wrap[1], end)

    def prose(self, kind: str, names: list[str], tag: str, most: int = 2) -> None:
        """Text that reads like an article's but isn't."""
        start, end = self.named(names, tag)
        inner = self.some(["p", "p", "div", "span", ""])
        texts = [self.some([self.words(1, 60), self.some(PHRASES[kind]), f"{self.some(PHRASES[kind])} {self.words(2, 20)}"]) for _ in range(self.rng.randint(1, most))]
        self.put(start, *[f"<{inner}>{escape(x)}</{inner}>" if inner else escape(x) for x in texts[: None if inner else 1]], end)

    def form(self) -> None:
        start, end = self.named(FORM_NAMES, "form", "form")
        self.put(start, f"<label>{self.some(PHRASES['form'])}</label><input name=q>", self.some(["", "<select><option>1</option><option>2</option></select>", f"<p>{escape(self.words(3, 20))}</p>"]), f"<button>{self.some(PHRASES['form'])}</button>", end)

    def comments(self) -> None:
        start, end = self.named(COMMENT_NAMES, "section")
        if self.marks == "bare":
            start = f'<div id="{self.some(COMMENT_NAMES)}">'
        self.put(start, f"<h3>{self.some(PHRASES['comments'])}</h3>")
        item = self.some(["div", "li", "article"])
        for _ in range(self.rng.randint(1, 6)):
            self.put(f'<{item} class="{self.some(["comment", "reply", "comment-body"])}">', f"<b>{escape(self.words(1, 2))}</b>" if self.chance(0.5) else "", f"<p>{escape(self.words(1, 80))}</p>", f'<a href="#r">{self.some(PHRASES["comments"])}</a>' if self.chance(0.4) else "", f"</{item}>")
        if self.chance(0.4):
            self.form()
        self.put(end)

    def boilerplate(self, inside: bool = False) -> None:
        kind = self.some(["ad", "ad", "notice", "side", "share", "form", "script"] if inside else ["ad", "ad", "notice", "notice", "side", "side", "share", "form", "menu", "script", "comment-tag"])
        if kind in ("ad", "notice"):
            self.prose(kind, AD_NAMES if kind == "ad" else NOTICE_NAMES, "aside" if kind == "ad" else "div")
        elif kind == "side":
            (self.links if self.chance(0.6) else self.prose)("side", SIDE_NAMES, "aside")
        elif kind in ("share", "menu"):
            self.links(kind, SHARE_NAMES if kind == "share" else MENU_NAMES, "div" if kind == "share" else "nav")
        elif kind == "form":
            self.form()
        elif kind == "script":
            self.put(self.some(['<script>var t="</p><p>no text";</script>', "<style>p{margin:0}</style>", "<noscript>Enable scripts</noscript>"]))
        else:
            self.put(f"<!-- {escape(self.words(1, 5))} -->")

    def tell(self, tag: str, text: str, close: bool = True) -> None:
        self.put(f"<{tag}>{self.inline(text)}" + (f"</{tag}>" if close else ""))
        self.main.append(text)

    def article(self) -> None:
        start, end = self.named(ARTICLE_NAMES, self.some(["article", "article", "main", "section"]))
        if self.marks == "bare":
            start, end = self.some([("<div>", "</div>"), ("<td>", "</td>"), ("<article>", "</article>"), ('<div role="main">', "</div>"), ("", "")])
        self.put(start)
        heading = self.some(["h1", "h1", "h1", "h2", ""])
        if heading:
            wrap = self.chance(0.15)
            self.put("<header>" if wrap else "")
            self.tell(heading, self.words(1, 12))
            self.put("</header>" if wrap else "")
        inner = self.named(["body", "text", "content", "article-text"], "div") if self.chance(0.3) else ("", "")
        self.put(inner[0])
        for _ in range(self.rng.randint(1, 14)):
            kind = self.rng.random()
            if kind < 0.75:
                long = self.some([(1, 3), (3, 40), (20, 160), (60, 300)])
                self.tell("p", self.words(*long), self.chance(0.9))
            elif kind < 0.8:
                self.put("<p><b>")
                text = self.words(2, 60)
                self.put(self.inline(text), "<br>")
                self.main.append(text)
            elif kind < 0.86:
                self.tell(self.some(["h2", "h3"]), self.words(1, 8))
            elif kind < 0.9:
                self.put("<blockquote>")
                self.tell("p", self.words(4, 50))
                self.put("</blockquote>")
            elif kind < 0.95:
                tag = self.some(["ul", "ol"])
                self.put(f"<{tag}>")
                for _ in range(self.rng.randint(1, 6)):
                    self.tell("li", self.words(1, 25), self.chance(0.8))
                self.put(f"</{tag}>")
            else:
                self.tell(self.some(["pre", "figcaption", "div"]), self.words(2, 30))
            if self.chance(0.08):
                self.boilerplate(inside=True)
        self.put(inner[1])
        if self.chance(0.1):
            self.comments()
        self.put(end)

    def page(self) -> tuple[str, str]:
        self.put("<!DOCTYPE html><html><head><meta charset=utf-8>", f"<title>{escape(self.words(1, 10))}</title>", "<style>a{b:c}</style>", "</head><body>")
        if self.chance(0.5):
            start, end = self.named(HEADER_NAMES, "header")
            self.put(start, self.some(["", f"<a href='/'>{self.words(1, 3)}</a>", f"<p>{escape(self.words(1, 12))}</p>", f"<div>{escape(self.words(1, 5))}</div>"]))
            if self.chance(0.5):
                self.links("menu", MENU_NAMES, "nav")
            self.put(end)
        if self.chance(0.8):
            self.links("menu", MENU_NAMES, "nav")
        for _ in range(self.rng.randint(0, 2)):
            self.boilerplate()
        if self.chance(0.97):
            self.article()
        for _ in range(self.rng.randint(0, 3)):
            self.boilerplate()
        if self.chance(0.35):
            self.comments()
        if self.chance(0.8):
            start, end = self.named(FOOTER_NAMES, "footer")
            self.put(start, self.some([f"&copy; {self.words(1, 4)} &middot; {escape(self.words(1, 15))}", f"<p>&copy; 2024 {escape(self.words(1, 6))}</p><p>{self.some(PHRASES['footer'])}</p>", f"<p>{self.some(PHRASES['footer'])}</p>", escape(self.words(2, 30))]), end)
        self.put(self.some(["</body></html>", "</body></html>", ""]))
        return "".join(self.out), "\n\n".join(" ".join(t.split()) for t in self.main)


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, str]]:
    """n pairs of a page and its main text."""
    return [Layout(seed * 1_000_003 + k).page() for k in range(n)]
