"""Labelled pages for training the extractor: pages of many layouts, made from a seed, in which each
text of the article is marked. Words are invented, so that the model learns places and shapes."""

from __future__ import annotations

import numpy as np

#: Stands before every text that belongs to the article.
MARK = "\ue000"

SITE_HEADERS = ("header", "site-header", "masthead", "topbar", "page-header", "brand", "logo", "top")
MENUS = ("nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "nav-links", "submenu", "toc", "pagination", "pager", "skip-link")
NOTICES = ("cookie-notice", "cookie", "notice", "banner", "alert", "consent", "gdpr", "message", "announcement", "popup", "modal", "newsletter", "subscribe", "disclaimer", "notification", "paywall", "overlay")
ADVERTS = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad-slot", "adsense", "banner-ad", "promotion", "ad-container", "teaser")
SIDEBARS = ("sidebar", "side", "widget", "related", "aside", "right-col", "left-col", "secondary", "most-read", "popular", "recommended", "rail", "tags", "archive", "see-also", "related-posts")
COMMENTS = ("comments", "comment", "comment-list", "discussion", "replies", "reply", "responses", "disqus", "comment-body", "user-comments")
FOOTERS = ("footer", "site-footer", "bottom", "copyright", "legal", "foot", "colophon", "page-footer")
SHARES = ("share", "social", "share-buttons", "toolbar", "actions", "follow", "buttons", "print", "social-links")
FORMS = ("search", "login", "form", "search-form", "signup", "contact-form", "poll", "feedback")
ARTICLES = ("content", "article", "post", "entry", "entry-content", "post-content", "story", "article-body", "main-content", "text", "body", "page-content", "post-body", "story-body", "prose", "main", "article-text")
SHORT = ("Home", "About us", "Contact", "News", "Login", "Sign up", "Subscribe", "Share", "Tweet", "Read more", "Next", "Previous", "Comments", "Reply", "Privacy", "Terms", "Search", "Menu", "Accept all cookies", "Advertisement", "Related", "Tags", "Print", "Help", "Jobs", "FAQ", "Follow us", "Submit", "Close")
FOOT = ("&copy; 2021 {}", "© {} All rights reserved.", "Copyright 2019 {}", "&copy; {} &middot; {}", "Privacy policy | Terms | {}", "{} &copy;", "Impressum {}")


class _Maker:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        parts = ["".join(self.r.choice(list("bcdfghlmnprstvw"), 1)) + "".join(self.r.choice(list("aeiouéäo"), 1)) + ("" if self.r.random() < 0.5 else "".join(self.r.choice(list("nrstl"), 1))) for _ in range(60)]
        self.parts = parts

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def pick(self, values):
        return values[int(self.r.integers(len(values)))]

    def word(self) -> str:
        return "".join(self.pick(self.parts) for _ in range(int(self.r.integers(1, 5))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self) -> str:
        return self.words(int(self.r.integers(1, 22))).capitalize() + self.pick(".....?!")

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(int(self.r.integers(1, 7))))
        if self.chance(0.1):
            text = self.words(int(self.r.integers(1, 4))).capitalize() + self.pick(("", ".", ":"))
        if self.chance(0.08):
            text = " ".join(w + self.pick(("###", "***", "&amp;&amp;&amp;", "!!", " |")) for w in text.split())
        if self.chance(0.05):
            text = text.upper()
        return text

    def inline(self, text: str) -> str:
        words = text.split()
        for _ in range(int(self.r.integers(0, 3))):
            k = int(self.r.integers(len(words)))
            tag = self.pick(("b", "i", "em", "strong", "a", "code", "span"))
            words[k] = f'<{tag}{" href=/" + "x" if tag == "a" else ""}>{words[k]}</{tag}>'
        if self.chance(0.15):
            words.insert(int(self.r.integers(len(words) + 1)), "<br>")
        return " ".join(words)

    def attribute(self, names) -> str:
        name = self.pick(names)
        if self.chance(0.2):
            name = f"{self.word()}-{name}"
        return f' {self.pick(("class", "class", "class", "id"))}="{name}"'

    def links(self, n: int) -> str:
        made = []
        for _ in range(n):
            text = self.pick(SHORT) if self.chance(0.4) else self.words(int(self.r.integers(1, 5))) if self.chance(0.8) else self.sentence()
            made.append(f'<a href="/{self.word()}">{text}</a>')
        style = int(self.r.integers(3))
        return "<ul>" + "".join(f"<li>{x}</li>" for x in made) + "</ul>" if style == 0 else " ".join(made) if style == 1 else "".join(f"<div>{x}</div>" for x in made)

    def wrapped(self, element: str, names, inner: str, plain: float = 0.35) -> str:
        """In the element of that meaning, or in a div with a telling name, or both."""
        if element != "div" and self.chance(plain):
            return f"<{element}>{inner}</{element}>"
        tag = element if element != "div" and self.chance(0.3) else self.pick(("div", "div", "section", "p") if "<" not in inner else ("div", "div", "section"))
        return f"<{tag}{self.attribute(names)}>{inner}</{tag}>"

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(2)}</label><input name={self.word()}>" for _ in range(int(self.r.integers(1, 4)))) + f"<button>{self.pick(SHORT)}</button>"
        if self.chance(0.4):
            inner = f"<p>{self.sentence()}</p>" + inner
        return self.wrapped("div", FORMS, f"<form>{inner}</form>") if self.chance(0.5) else f"<form{self.attribute(FORMS) if self.chance(0.4) else ''}>{inner}</form>"

    def noise(self) -> str:
        kind = int(self.r.integers(6))
        text = self.prose() if self.chance(0.6) else self.pick(SHORT)
        text = f"<p>{text}</p>" if self.chance(0.3) else text
        if kind == 0:
            return self.wrapped("div", ADVERTS, text)
        if kind == 1:
            return self.wrapped("div", NOTICES, text)
        if kind == 2:
            return self.wrapped("div", SHARES, self.links(int(self.r.integers(1, 5))))
        if kind == 3:
            return self.form()
        if kind == 4:
            return self.wrapped("aside", SIDEBARS, (f"<h3>{self.words(2)}</h3>" if self.chance(0.5) else "") + (self.links(4) if self.chance(0.6) else text))
        return self.wrapped("div", ADVERTS + SIDEBARS, self.links(2) + text)

    def comments(self) -> str:
        def one() -> str:
            by = f"<{self.pick(('div', 'span', 'p', 'h4'))}>{self.word()}" if self.chance(0.5) else ""
            by += f"</{by[1:].split('>')[0]}>" if by else ""
            return f'<div{self.attribute(COMMENTS) if self.chance(0.7) else ""}>{by}<p>{self.prose()}</p></div>'

        inner = (f"<h3>{self.pick(('Comments', 'Responses', '3 comments', 'Discussion'))}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(int(self.r.integers(1, 5))))
        tag = "section" if self.chance(0.2) else "div"
        return f"<{tag}{self.attribute(COMMENTS)}>{inner}</{tag}>"

    def article(self) -> str:
        out = [f"<h1>{MARK}{self.words(int(self.r.integers(2, 12))).capitalize()}{self.pick(('', '.'))}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.r.integers(1, 14))):
            x = self.r.random()
            text = MARK + self.inline(self.prose())
            if x < 0.70:
                out.append(f"<p>{text}</p>" if self.chance(0.85) else f"<p>{text}" if self.chance(0.5) else f"<p><b>{text}<br>")
            elif x < 0.76:
                level = self.pick((2, 3, 4))
                out.append(f"<h{level}>{MARK}{self.words(int(self.r.integers(1, 7))).capitalize()}</h{level}>")
            elif x < 0.83:
                kind = self.pick(("ul", "ol"))
                out.append(f"<{kind}>" + "".join(f"<li>{MARK}{self.inline(self.sentence())}</li>" for _ in range(int(self.r.integers(2, 6)))) + f"</{kind}>")
            elif x < 0.87:
                out.append(f"<blockquote>{'<p>' if self.chance(0.5) else ''}{text}</blockquote>")
            elif x < 0.90:
                out.append(f"<pre>{text}</pre>")
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.96:
                out.append(f"<figure><img src=x.png><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            else:
                out.append(f"<div>{text}</div>")
            if self.chance(0.06):
                out.append(self.noise())
        return "".join(out)

    def page(self) -> str:
        head = f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var x='</p>';</script></head><body>"
        top = []
        if self.chance(0.6):
            top.append(self.wrapped("header", SITE_HEADERS, f"<a href=/>{self.words(2)}</a>" + (f"<p>{self.sentence()}</p>" if self.chance(0.4) else "")))
        if self.chance(0.85):
            top.append(self.wrapped("nav", MENUS, self.links(int(self.r.integers(2, 9))), 0.5))
        for _ in range(int(self.r.integers(0, 3))):
            top.append(self.noise())
        kind = self.r.random()
        inner = self.article()
        if self.chance(0.15):
            inner += self.comments()
        if kind < 0.45:
            main = f"<article{self.attribute(ARTICLES) if self.chance(0.3) else ''}>{inner}</article>"
            main = f"<main>{main}</main>" if self.chance(0.3) else main
        elif kind < 0.6:
            main = f"<main>{inner}</main>"
        elif kind < 0.93:
            main = f"<{(t := self.pick(('div', 'div', 'section')))}{self.attribute(ARTICLES)}>{inner}</{t}>"
        else:
            main = f"<div>{inner}</div>" if self.chance(0.5) else inner
        low = []
        if self.chance(0.35):
            low.append(self.comments())
        for _ in range(int(self.r.integers(0, 3))):
            low.append(self.noise())
        if self.chance(0.85):
            foot = self.pick(FOOT).replace("{}", self.words(2)) if self.chance(0.7) else self.prose()
            low.append(self.wrapped("footer", FOOTERS, foot + (" " + self.sentence() if self.chance(0.5) else "") + (self.links(3) if self.chance(0.3) else ""), 0.5))
        if self.chance(0.3):
            side = self.wrapped("aside", SIDEBARS, f"<h3>{self.words(2)}</h3>" + self.links(5))
            (top if self.chance(0.5) else low).append(side)
        body = "".join(top) + main + "".join(low)
        return head + body + ("</body></html>" if self.chance(0.9) else "")


def labelled_pages(count: int, seed: int) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(count)]
