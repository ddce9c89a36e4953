"""Labelled web pages made by rule: random words in the usual parts of a page, in many mark-ups."""

from __future__ import annotations

import random

SYLLABLES = "an be cor den el fa ger hi in jo ka lor men no or per qui ra sel ta un ver wi ys zo tion ment ly ed".split()
#: Mark-ups of the main part, from outside to inside.
FRAMES = [["article"], ["main", "article"], ["main"], ["div class=content"], ["div id=main-content", "article class=post"], ["div class=entry-content"],
          ["section class=story"], ["div class=page", "div class=article-body"], ["div id=content", "div class=text"], ["div", "article class=entry"], ["div class=wrapper", "div class=main"]]


class Writer:
    """Parts of one page; `main` gathers the texts that belong to its main part."""

    def __init__(self, seed: int):
        self.r, self.main = random.Random(seed), set()

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 14).capitalize() + self.r.choice([".", ".", ".", "?", "!"]) for _ in range(self.r.randint(low, high)))

    def keep(self, text: str) -> str:
        self.main.add(" ".join(text.split()))
        return text

    def one_of(self, *choices: str) -> str:
        return self.r.choice(choices)

    def maybe(self, chance: float, make) -> str:
        return make() if self.r.random() < chance else ""

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        shape = self.r.randrange(3)
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if shape == 0 else " | ".join(items) if shape == 1 else "".join(f"<span>{i}</span> " for i in items)

    def element(self, tag: str, inside: str) -> str:
        name, _, attribute = tag.partition(" ")
        key, _, value = attribute.partition("=")
        return f"<{name}" + (f' {key}="{value}"' if key else "") + f">{inside}</{name}>"

    def header(self) -> str:
        inside = self.maybe(0.6, lambda: f"<{(t := self.one_of('h1', 'h2', 'div', 'p'))}>{self.words(1, 4).title()}</{t}>") + self.maybe(0.5, lambda: f"<p>{self.words(2, 8)}</p>")
        return self.element(self.one_of("header", "div class=header", "div id=masthead", "div class=site-header"), inside + self.maybe(0.6, self.menu))

    def menu(self) -> str:
        return self.element(self.one_of("nav", "nav", "div class=menu", "div id=navigation", "ul class=nav", "div class=breadcrumb"), self.links(3, 9))

    def advert(self) -> str:
        text = self.one_of(self.sentences(1, 3), self.words(2, 20))
        return self.element(self.one_of("div class=ad", "div class=advert", "div class=sponsored", "aside class=promo", "div id=banner-ad", "div class=advertisement", "section class=ads"),
                            self.one_of(text, f"<p>{text}</p>", f'<a href="/{self.word()}">{text}</a>'))

    def notice(self) -> str:
        text = self.one_of(self.sentences(1, 3), self.sentences(2, 5))
        return self.element(self.one_of("div class=cookie-banner", "div id=consent", "div class=notice", "div role=alert", "section class=gdpr-notice", "dialog", "div class=popup", "div class=message"),
                            self.one_of(text, f"<p>{text}</p>") + self.maybe(0.5, lambda: f"<button>{self.words(1, 2)}</button>"))

    def sidebar(self) -> str:
        inside = f"<{(t := self.one_of('h2', 'h3', 'h4'))}>{self.words(1, 4)}</{t}>" + self.one_of(self.links(3, 8), f"<p>{self.sentences(1, 4)}</p>", self.links(2, 4) + f"<p>{self.sentences(1, 3)}</p>")
        return self.element(self.one_of("aside", "aside", "div class=sidebar", "div id=side", "div class=widget", "section class=related", "div class=popular", "aside class=recommended"), inside)

    def form(self) -> str:
        return self.element(self.one_of("form", "form class=search", "div class=newsletter", "form class=login", "form id=subscribe"),
                            f"<label>{self.words(1, 4)}</label><input name=x>" + self.maybe(0.5, lambda: f"<p>{self.sentences(1, 2)}</p>") + f"<button>{self.words(1, 2)}</button>")

    def comments(self) -> str:
        each = self.one_of("div class=comment", "li class=comment", "article class=comment", "div class=reply")
        listed = "".join(self.element(each, self.one_of(f"<p>{self.sentences(1, 6)}</p>", f"<b>{self.word()}</b><p>{self.sentences(1, 4)}</p><p>{self.sentences(1, 3)}</p>", self.sentences(1, 3)))
                         for _ in range(self.r.randint(1, 5)))
        return self.element(self.one_of("section class=comments", "div id=comments", "div class=discussion", "section id=respond", "ol class=comments"), f"<h3>{self.words(1, 3)}</h3>" + listed)

    def footer(self) -> str:
        text = self.one_of(f"&copy; {self.word()}.example &middot; {self.sentences(1, 3)}", f"&copy; 20{self.r.randint(10, 25)} {self.words(1, 4)}", self.sentences(1, 3), f"Copyright {self.words(2, 6)}")
        return self.element(self.one_of("footer", "footer", "div class=footer", "div id=footer", "footer class=legal"), self.one_of(text, f"<p>{text}</p>", self.links(2, 6) + f"<p>{text}</p>"))

    def share(self) -> str:
        return self.element(self.one_of("div class=share", "ul class=social", "div class=tags", "p class=meta"), self.links(2, 5))

    def article(self) -> str:
        frame = self.r.choice(FRAMES)
        title = self.keep(self.one_of(self.words(2, 9).capitalize(), self.sentences(1, 1), self.sentences(1, 2)))
        tag = self.one_of("h1", "h1", "h1", "h2")
        parts = [self.one_of(f"<{tag}>{title}</{tag}>", f"<header><{tag}>{title}</{tag}></header>", f"<{tag}>{title}</{tag}>")]
        broken = self.r.random() < 0.4
        listy = self.r.random() < 0.15
        for _ in range(self.r.randint(1, 14)):
            text = self.keep(self.words(1, 40) if listy else self.one_of(self.sentences(1, 8), self.sentences(1, 2), self.sentences(3, 10), self.words(1, 6)))
            shape = self.r.random()
            if broken and shape < 0.3:
                parts.append(f"<p><b>{text}<br>")
            elif shape < 0.75:
                parts.append(f"<p>{text}</p>")
            elif shape < 0.8:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif shape < 0.85:
                parts.append(f"<{(t := self.one_of('h2', 'h3'))}>{text}</{t}>")
            elif shape < 0.9:
                parts.append("<ul>" + "".join(f"<li>{self.keep(self.sentences(1, 2))}</li>" for _ in range(self.r.randint(1, 4))) + f"</ul><p>{text}</p>")
            elif shape < 0.93:
                first, _, rest = text.partition(" ")
                parts.append(f'<p><a href="/x">{first}</a> {rest}</p>')
            elif shape < 0.95:
                parts.append("<table><tr>" + "".join(f"<td>{self.keep(self.words(1, 5))}</td>" for _ in range(3)) + f"</tr></table><p>{text}</p>")
            else:
                parts.append(f"<div>{text}</div>")
            parts.append(self.maybe(0.05, self.one_of_makers(self.advert, self.form, self.share, self.notice)))
        parts.append(self.maybe(0.15, self.share))
        parts.append(self.maybe(0.15, self.comments))
        body = "".join(parts)
        for tag_ in reversed(frame):
            body = self.element(tag_, body)
        return body

    def one_of_makers(self, *makers):
        return lambda: self.r.choice(makers)()

    def page(self) -> str:
        before = [self.maybe(0.5, self.header), self.maybe(0.7, self.menu), self.maybe(0.4, self.advert), self.maybe(0.3, self.notice), self.maybe(0.2, self.form), self.maybe(0.2, self.sidebar)]
        after = [self.maybe(0.3, self.comments), self.maybe(0.4, self.sidebar), self.maybe(0.3, self.advert), self.maybe(0.2, self.form), self.maybe(0.2, self.notice), self.maybe(0.2, self.menu)]
        self.r.shuffle(before)
        self.r.shuffle(after)
        end = self.maybe(0.9, self.footer) + self.maybe(0.1, self.notice)
        head = f"<head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{self.article()}{''.join(after)}{end}" + self.one_of("</body></html>", "")


def labelled(count: int, seed: int = 0) -> list[tuple[str, set[str]]]:
    """Pages and the texts of their main blocks; texts that other blocks of a page have as well are avoided by their length or chance."""
    out = []
    for i in range(count):
        writer = Writer(seed * 1_000_003 + i)
        out.append((writer.page(), writer.main))
    return out
