"""Built web pages with known main text: what op3's classifier is fitted on, and what it is tested on.

``page(seed)`` gives (html, the article's blocks). Layouts, wrappers, class names, the
order of the parts and sloppy markup vary; seeds of the fit and of the test differ.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber con da el fi gor hu in jo ka lu men no or pe qui ro sta tu ul ver wi xe yo zan".split()


class Builder:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.kept: list[str] = []

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))

    def prose(self, least: int, most: int) -> str:
        parts, left = [], self.r.randint(least, most)
        while left > 0:
            n = min(left, self.r.randint(2, 18))
            parts.append(self.words(n).capitalize() + self.r.choice("...!?"))
            left -= n
        return " ".join(parts)

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def keep(self, text: str) -> str:
        self.kept.append(text)
        return text

    def links(self, n: int, between: str = "li") -> str:
        return "".join(f'<{between}><a href="/{self.words(1)}">{self.words(self.r.randint(1, 3))}</a></{between}>' for _ in range(n))

    # ---- the article

    def paragraph(self) -> str:
        r = self.r
        text = self.prose(*r.choice([(2, 8), (10, 60), (40, 160)]))
        parts, shown = text.split(" "), text
        if r.random() < 0.3 and len(parts) > 4:
            k = r.randrange(len(parts) - 1)
            tag = r.choice(["b", "i", "em", "a href='/x'", "code", "span class=note"])
            shown = " ".join([*parts[:k], f"<{tag}>{parts[k]}</{tag.split()[0]}>", *parts[k + 1 :]])
        elif r.random() < 0.15 and len(parts) > 4:
            k = r.randrange(1, len(parts))
            shown = " ".join(parts[:k]) + "<br>" + " ".join(parts[k:])
        self.keep(text)
        return f"<p{self.pick('', '', '', ' class=lead', ' class=text')}>{shown}" + self.pick("</p>", "</p>", "</p>", "")

    def article_body(self) -> str:
        out = []
        for _ in range(self.r.randint(1, 14)):
            kind = self.r.random()
            if kind < 0.68:
                out.append(self.paragraph())
            elif kind < 0.78:
                out.append(f"<h{2 + self.r.randrange(3)}>{self.keep(self.words(self.r.randint(1, 7)).capitalize())}</h2>".replace("</h2>", ""))
                out[-1] += f"</{out[-1][1:3]}>"
            elif kind < 0.86:
                items = [self.keep(self.prose(2, 25)) for _ in range(self.r.randint(2, 6))]
                out.append("<ul>" + "".join(f"<li>{x}" + self.pick("</li>", "") for x in items) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.keep(self.prose(6, 40))}</p></blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(self.r.randint(1, 4)))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.95:
                out.append(f"<figure><img src=x><figcaption>{self.keep(self.prose(3, 15))}</figcaption></figure>")
            elif kind < 0.97:
                out.append(f"<pre>{self.keep(self.words(8))}</pre>")
            elif kind < 0.985:
                out.append(f'<div class="{self.pick("ad", "advert-box", "promo")}">{self.prose(3, 20)}</div>')
            else:
                out.append(f'<aside class="{self.pick("related", "pullout", "newsletter-signup")}">{self.prose(3, 20)}</aside>')
        return "".join(out)

    def article(self) -> str:
        title = self.keep(self.words(self.r.randint(2, 12)).capitalize())
        head = f"<h1>{title}</h1>"
        head = self.pick(head, head, f"<header>{head}</header>", f'<div class="{self.pick("post-header", "entry-header", "article-header")}">{head}</div>')
        body = self.article_body()
        body = self.pick(body, body, f'<div class="{self.pick("entry-content", "post-body", "prose", "content")}">{body}</div>')
        inner = head + body
        inner += self.pick("", "", f'<div class="{self.pick("share-buttons", "social", "sharing")}"><ul>{self.links(3)}</ul></div>', f"<footer>{self.prose(2, 12)}</footer>")
        state = self.pick("", "", " has-comments", " no-sidebar", " with-sidebar", " type-post", " is-related")
        tag = self.r.random()
        if tag < 0.6:
            return f'<article{self.pick("", f" class={chr(34)}post{state}{chr(34)}", " id=story")}>{inner}</article>'
        if tag < 0.8:
            return f'<main{self.pick("", " id=content", " role=main")}>{inner}</main>'
        return f'<div class="{self.pick("post", "content", "article-body", "story", "entry")}{state}">{inner}</div>'

    # ---- what is around it

    def comments(self) -> str:
        n = self.r.randint(1, 8)
        one = self.pick('<div class="comment"><p>{}</p></div>', "<li>{}</li>", '<article class="comment"><p>{}</p></article>')
        return f'<{self.pick("section", "div")} {self.pick("id", "class")}="{self.pick("comments", "comment-list", "disqus_thread", "replies")}"><h2>{self.words(2)}</h2>' + "".join(one.format(self.prose(3, 50)) for _ in range(n)) + "</section>"

    def part(self) -> str:
        kind = self.r.randrange(9)
        if kind == 0:
            return f'<div class="{self.pick("ad", "ads", "advertisement", "sponsored", "banner-ad")}">{self.prose(2, 30)}</div>'
        if kind == 1:
            return f'<div {self.pick("class", "id")}="{self.pick("cookie-notice", "cookie-banner", "gdpr", "consent", "notice", "alert")}"><p>{self.prose(4, 40)}</p><button>{self.words(1)}</button></div>'
        if kind == 2:
            return f'<aside{self.pick("", " class=sidebar")}><h3>{self.words(2)}</h3><ul>{self.links(self.r.randint(2, 8))}</ul><p>{self.prose(3, 40)}</p></aside>'
        if kind == 3:
            return f'<div class="{self.pick("sidebar", "sidebar-right", "side-widget widget")}"><h3>{self.words(2)}</h3><p>{self.prose(3, 50)}</p></div>'
        if kind == 4:
            return f"<form><label>{self.words(2)}</label><input name=q><select><option>{self.words(1)}</select><p>{self.prose(2, 25)}</p></form>"
        if kind == 5:
            return f'<div class="{self.pick("related", "related-posts", "recommended")}"><h3>{self.words(2)}</h3>' + "".join(f"<div><a href=/r>{self.words(6)}</a><p>{self.prose(3, 25)}</p></div>" for _ in range(3)) + "</div>"
        if kind == 6:
            return f'<div class="{self.pick("newsletter", "subscribe", "newsletter-signup", "popup")}"><p>{self.prose(4, 30)}</p></div>'
        if kind == 7:
            return f'<div class="{self.pick("breadcrumbs", "pagination", "share", "toolbar")}">{self.links(4, "span")}</div>'
        return f"<nav><ul>{self.links(self.r.randint(3, 9))}</ul></nav>"

    def whole(self) -> str:
        r = self.r
        top = self.pick(
            f"<header><a href=/>{self.words(2)}</a><p>{self.words(5)}</p></header>", f'<div class="{self.pick("site-header", "masthead", "header")}">{self.words(3)}</div>',
            f"<nav><ul>{self.links(r.randint(3, 9))}</ul></nav>", f'<div id="{self.pick("nav", "menu", "navbar")}"><ul>{self.links(5)}</ul></div>', "",
        )
        before = "".join(self.part() for _ in range(r.randint(0, 2)))
        middle = self.article()
        after = "".join(self.part() for _ in range(r.randint(0, 2)))
        after += self.pick("", self.comments())
        foot = self.pick(f"<footer>&copy; {self.words(2)} &middot; {self.prose(3, 20)}</footer>", f'<div class="{self.pick("footer", "site-footer")}">{self.prose(4, 30)}</div>', f'<div id="copyright">{self.prose(3, 12)}</div>', "")
        inside = top + before + middle + after + foot
        wrap = self.pick("", "", '<div class="layout sidebar-right">{}</div>', '<div class="wrapper has-sidebar">{}</div>', '<div id="page">{}</div>', "<form id=whole>{}</form>" if "<form" not in inside else "", '<div class="page with-sidebar"><div class="container">{}</div></div>')
        inside = wrap.replace("{}", inside) if wrap else inside
        head = f"<!DOCTYPE html><html lang=en><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";track({r.randrange(9)});</script></head>"
        return f"{head}<body{self.pick('', ' class=has-sidebar')}>{inside}" + self.pick("</body></html>", "")


def page(seed: int) -> tuple[str, list[str]]:
    b = Builder(seed)
    return b.whole(), b.kept
