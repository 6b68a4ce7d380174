"""Labelled web pages made from page layouts: main text is marked data-y="1"."""

from __future__ import annotations

import random

SYLLABLES = "ba ko ri ten sul mar ven dio lat per con tra um is ol eth an gre fi no ch qu ser po".split()
MENU = ["nav", "menu", "navbar", "main-menu", "navigation", "site-nav", "topnav", "breadcrumb", "breadcrumbs", "tags", "pagination", "pager", "categories", "social", "share", "sharing-links", "toolbar"]
SIDE = ["sidebar", "side-column", "widget", "related", "related-posts", "more-stories", "recommended", "popular", "trending", "latest-teasers", "rail"]
FOOT = ["footer", "site-footer", "foot", "copyright", "bottom", "legal"]
AD = ["ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "promotion", "banner"]
NOTICE = ["cookie-notice", "cookie-consent", "notice", "notification", "consent", "gdpr-banner", "alert-message", "popup", "modal"]
FORM = ["newsletter", "subscribe", "search-form", "login", "signup-form", "contact-form", "subscription"]
COMMENTS = ["comments", "comment-list", "discussion", "responses", "reader-comments", "replies"]
CONTENT = ["content", "article-body", "post-content", "entry-content", "story", "main-content", "post", "entry", "article", "text", "body-text", "hentry"]


class Layout:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: A third of the pages have little main text.
        self.short = self.r.random() < 0.33

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice([1, 1, 2, 2, 3])))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(3, 16).capitalize() + self.r.choice([".", ".", ".", "!", "?", ", " + self.words(2, 5) + "."])

    def prose(self, lo: int = 1, hi: int = 7) -> str:
        out = []
        for _ in range(self.r.randint(lo, hi)):
            s = self.sentence()
            k = self.r.random()
            if k > 0.97:
                s = f"{s} <math><mi>{self.word()}</mi><mo>=</mo><mn>{self.word()}</mn></math>"
            if k < 0.06:
                s = f'<a href="/{self.word()}">{s}</a>'
            elif k < 0.16:
                s = f"<{(t := self.r.choice(['b', 'em', 'i', 'strong', 'span']))}>{s}</{t}>"
            elif k < 0.2:
                s += self.r.choice(["<br>", "&nbsp;", " &amp; ", "&#8212;"])
            out.append(s)
        return " ".join(out)

    def named(self, names: list[str], p: float = 1.0) -> str:
        if self.r.random() >= p:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def links(self, lo: int = 2, hi: int = 8) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(lo, hi))]
        kind = self.r.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if kind == 1 else " ").join(items)

    def menu(self) -> str:
        return self.r.choice([f"<nav{self.named(MENU, 0.4)}>{self.links()}</nav>", f'<div role="navigation">{self.links()}</div>', f"<div{self.named(MENU)}>{self.links()}</div>", f"<ul{self.named(MENU)}>" + "".join(f'<li><a href="#">{self.words(1, 2)}</a></li>' for _ in range(4)) + "</ul>"])

    def ad(self) -> str:
        inner = self.r.choice([self.prose(1, 3), f"<p>{self.prose(1, 2)}</p>", f'<a href="/x">{self.sentence()}</a>', f"<h3>{self.words(1, 4)}</h3><p>{self.sentence()}</p>"])
        tag = self.r.choice(["div", "div", "aside", "section"])
        return f"<{tag}{self.named(AD)}>{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(["div", "section", "aside"])
        role = self.r.choice(["", "", ' role="alert"', ' role="dialog"'])
        return f"<{tag}{self.named(NOTICE)}{role}><p>{self.prose(1, 4)}</p>{self.r.choice(['', '<button>' + self.words(1, 2) + '</button>'])}</{tag}>"

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input name=q><select><option>{self.word()}<option>{self.word()}</select><button>{self.word()}</button>"
        inner = self.r.choice(["", f"<p>{self.prose(1, 2)}</p>", self.prose(1, 4) + " ", f"<h3>{self.words(1, 5)}</h3>"]) + inner
        return self.r.choice([f"<form{self.named(FORM, 0.5)}>{inner}</form>", f"<div{self.named(FORM)}>{inner}</div>", f"<div{self.named(FORM)}><form>{inner}</form></div>"])

    def long_form(self) -> str:
        """Many questions with a field each."""
        return f"<form{self.named(FORM, 0.4)}>" + "".join(f"<p>{self.sentence()}</p>{self.r.choice(['<input name=a>', '<textarea></textarea>', '<select><option>x</select>'])}" for _ in range(self.r.choice([4, 8, 15, 40, 80]))) + "<button>ok</button></form>"

    def wrapped(self, inner: str) -> str:
        """Parts of a page in the one form that some servers put around them."""
        hidden = '<input type="hidden" name="state" value="x">' * self.r.randint(0, 2)
        return f'<form{self.r.choice([" id=aspnetForm", " id=form1", "", " method=post action=/"])}>{hidden}{inner}</form>'

    def unscripted(self) -> str:
        return f"<noscript>{self.r.choice([self.sentence(), '<p>' + self.sentence() + '</p>', '<img src=x>', '<div' + self.named(NOTICE) + '>' + self.prose(1, 2) + '</div>'])}</noscript>"

    def side(self) -> str:
        items = []
        for _ in range(self.r.randint(1, 4)):
            items.append(self.r.choice([f"<h3>{self.words(1, 4)}</h3>{self.links(2, 5)}", f"<p>{self.prose(1, 3)}</p>", f'<div class="{self.r.choice(SIDE)}"><h4><a href="/y">{self.sentence()}</a></h4><p>{self.prose(1, 3)}</p></div>']))
        return self.r.choice([f"<aside{self.named(SIDE, 0.5)}>{''.join(items)}</aside>", f'<div role="complementary">{"".join(items)}</div>', f"<div{self.named(SIDE)}>{''.join(items)}</div>", f"<section{self.named(SIDE)}>{''.join(items)}</section>"])

    def foot(self) -> str:
        inner = self.r.choice([f"&copy; {self.word()}.example &middot; {self.prose(1, 2)}", f"<p>&copy; 2020 {self.words(2, 8)}.</p>" + self.links(), self.links(), f"<div>{self.prose(1, 4)}</div>", f"<p>{self.prose(1, 4)}</p><p>{self.words(2, 6)}</p>"])
        return self.r.choice([f"<footer{self.named(FOOT, 0.3)}>{inner}</footer>", f'<div role="contentinfo">{inner}</div>', f"<div{self.named(FOOT)}>{inner}</div>"])

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 7)}</p>"]) + self.r.choice(["", self.menu(), self.form(), f"<p>{self.words(2, 9)}</p>"])
        return self.r.choice([f"<header{self.named(['header', 'masthead', 'top', 'site-header'], 0.4)}>{inner}</header>", f"<div{self.named(['header', 'masthead', 'page-header', 'banner', 'top'])}>{inner}</div>"])

    def comments(self) -> str:
        items = []
        for _ in range(self.r.randint(1, 5)):
            text = self.r.choice([f"<p>{self.prose(1, 4)}</p>", self.prose(1, 4)])
            items.append(self.r.choice([f'<div class="comment"><b>{self.word()}</b> {text}</div>', f"<li>{text}</li>", f'<article class="{self.r.choice(["comment", "reply", "comment-body"])}"><header>{self.word()}</header>{text}</article>', text]))
        inner = self.r.choice(["", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.words(1, 2)} ({len(items)})</h3>"]) + "".join(items)
        tag = self.r.choice(["div", "section", "ol", "ul"])
        return f"<{tag}{self.named(COMMENTS)}>{inner}</{tag}>{self.r.choice(['', self.form()])}"

    def block(self) -> str:
        """A block of main text."""
        k, y = self.r.random(), ' data-y="1"'
        if self.short and k < 0.6:
            return f"<p{y}>{self.words(1, 9)}" + self.r.choice([".</p>", "</p>", "."])
        if k < 0.68:
            return f"<p{y}>{self.prose()}" + self.r.choice(["</p>", "</p>", "</p>", ""])
        if k < 0.76:
            return f"<{(h := self.r.choice(['h2', 'h2', 'h3', 'h4']))}{y}>{self.words(1, 8)}</{h}>"
        if k < 0.82:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li{y}>{self.prose(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if k < 0.87:
            return f"<blockquote{y}><p{y}>{self.prose(1, 3)}</p></blockquote>"
        if k < 0.9:
            return "<table>" + "".join(f"<tr><td{y}>{self.words(1, 3)}</td><td{y}>{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if k < 0.93:
            return f"<pre{y}>{self.words(3, 12)}\n{self.words(3, 12)}</pre>"
        if k < 0.96:
            return f"<figure><img src=x><figcaption{y}>{self.sentence()}</figcaption></figure>"
        return f"<div{y}>{self.prose()}</div>"

    def article(self) -> str:
        y = ' data-y="1"'
        body = [self.block() for _ in range(self.r.choice([1, 1, 2, 3] if self.short else [1, 2, 3, 5, 8, 12, 20]))]
        if self.r.random() < 0.15:  # text without paragraphs
            body = [f"<div{y}>{self.prose(3, 12)}<br><br>{self.prose(3, 12)}</div>"]
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            made = self.r.choice([self.ad, self.ad, self.form, self.form, self.side, self.menu, self.notice, self.unscripted])()
            body.insert(self.r.randint(0, len(body)), made)
        title = f"<h1{y}>{self.words(1, 9)}</h1>"
        kind = self.r.random()
        if kind < 0.15:
            title = f"<header>{title}</header>".replace("<header>", f"<header{y}>")
        elif kind < 0.25:
            title = ""
        inner = title + "".join(body)
        wrap = self.r.random()
        if wrap < 0.3:
            return f"<article{self.named(CONTENT, 0.3)}>{inner}</article>"
        if wrap < 0.42:
            return f"<main{self.named(CONTENT, 0.3)}>{self.r.choice([inner, '<article>' + inner + '</article>'])}</main>"
        if wrap < 0.76:
            return f"<div{self.named(CONTENT)}>{self.r.choice([inner, '<div>' + inner + '</div>', '<section>' + inner + '</section>'])}</div>"
        if wrap < 0.82:
            return f"<section{self.named(CONTENT, 0.5)}>{inner}</section>"
        if wrap < 0.88:
            return f'<div role="main">{inner}</div>'
        if wrap < 0.96:
            return f'<div{self.r.choice(["", " class=col-8", " class=left", " id=center"])}>{inner}</div>'
        return inner

    def page(self) -> str:
        before = [f() for f in (self.notice, self.header, self.menu, self.ad) if self.r.random() < 0.5]
        if self.r.random() < 0.1:
            before.append(self.unscripted())
        self.r.shuffle(before)
        after = [f() for f in (self.side, self.ad, self.comments, self.menu, self.form, self.notice, self.foot) if self.r.random() < 0.45]
        core = self.article()
        extra = self.r.choice(["", "", self.comments(), self.side()])
        if self.r.random() < 0.4:
            tag = self.r.choice(["div", "div", "main"])
            core = f"<{tag}{self.named(['wrapper', 'container', 'row', 'page', 'main', 'col'], 0.7)}>{core}{extra}</{tag}>"
        head = f'<head><title>{self.words(1, 8)}</title><meta charset="utf-8"><style>p{{margin:0}}</style><script>var a="<p>";</script></head>'
        if self.r.random() < 0.05:
            return "".join(self.block() for _ in range(3))
        kind = self.r.random()
        if kind < 0.12:
            core = self.r.choice([core + self.long_form(), f"<main>{core}{self.long_form()}</main>", f"<div>{self.long_form()}{core}</div>"])
            if kind < 0.05:  # little beside the form
                y = ' data-y="1"'
                core = f"<main><article><h1{y}>{self.words(1, 3)}</h1><p{y}>{self.prose(1, 2)}</p></article>{self.long_form()}{self.long_form()}</main>"
        elif kind < 0.18:
            core = self.wrapped(core)
        elif kind < 0.22:
            core = self.wrapped("".join(self.block() for _ in range(self.r.randint(1, 6))))
        elif kind < 0.27:
            return f'<html>{head}<body>{self.wrapped("".join(before) + core + "".join(after))}{self.r.choice(["", self.foot()])}</body></html>'
        return f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(before)}{core}{"".join(after)}' + self.r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    """n pages; equal arguments give equal pages."""
    return [Layout(seed * 1_000_003 + k).page() for k in range(n)]
