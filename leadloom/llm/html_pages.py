"""Labelled pages for the extraction model, made from templates.

Each page is a list of (label, html) parts in page order inside a frame; label 1 is article text, 0 is
not. Parts carry their label to the parser as the attribute data-y on their outer element.
"""

from __future__ import annotations

from itertools import product

_WORDS = "over land the old road turns toward a quiet harbour where boats wait for morning and people speak of weather work and news".split()
_FEW = "home about contact products more help login search".split()


def _text(n: int, k: int) -> str:
    return " ".join(_WORDS[(i * (k % 7 + 2) + k) % len(_WORDS)] for i in range(n)).capitalize() + "."


def _links(n: int, k: int) -> str:
    return "".join(f'<li><a href="/{i}">{_FEW[(i + k) % len(_FEW)]}</a></li>' for i in range(n))


def _plain(k: int) -> str:
    """An article without blocks of its own, with a single paragraph, or of links."""
    n = 6 + (k * 13) % 180
    if k % 3 == 0:
        return f"{_text(n, k)}<br><br>{_text(n // 2 + 4, k + 1)}" if k % 2 else _text(n, k)
    if k % 3 == 1:
        return f"<p>{_text(n, k)}</p>"
    return f"<h1>{_text(4, k)}</h1><ul>" + "".join(f"<li><a href='/{i}'>{_text(5 + (i + k) % 9, k + i)}</a></li>" for i in range(3 + k % 5)) + f"</ul><p>{_text(12, k)}</p>"


def _article(k: int) -> str:
    """The article's inside: heading, paragraphs long and short, a list, a quotation, a table now and then."""
    parts = [f"<h1>{_text(6, k)}</h1>", f"<p><b>{_text(9, k)}<br>"] if k % 2 else [f"<h1>{_text(6, k)}</h1>", f"<p>{_text(18, k)}</p>"]
    for i in range(2 + k % 4):
        parts.append(f"<p>{_text(4 + (i * 17 + k * 5) % 60, k + i)} <a href='/x'>{_text(2, i)}</a> <em>{_text(3, k)}</em></p>" if i % 3 == 1 else f"<p>{_text(1 + (i * 23 + k * 7) % 70, k + i)}</p>")
    if k % 3 == 0:
        parts.append(f"<h2>{_text(4, k)}</h2><ul><li>{_text(8, k)}</li><li>{_text(5, k + 1)}</li></ul>")
    if k % 4 == 1:
        parts.append(f"<blockquote><p>{_text(20, k)}</p></blockquote>")
    if k % 5 == 2:
        parts.append(f"<table><tr><th>{_text(2, k)}</th><td>{_text(3, k)}</td></tr><tr><td>{_text(2, k)}</td><td>{_text(4, k)}</td></tr></table>")
    if k % 6 == 3:
        parts.append(f"<figure><img src='a.png'><figcaption>{_text(7, k)}</figcaption></figure><pre><code>{_text(6, k)}</code></pre>")
    return "".join(parts)


#: (tag, attributes) that hold an article.
_HOMES = (("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("section", 'class="post-body entry"'), ("div", 'class="article-text"'), ("div", ""), ("div", 'id="wrap"'), ("div", ""))
#: (tag, attributes, kind of inside) that hold none.
_OTHERS = (
    ("nav", "", "links"), ("ul", 'class="menu"', "links"), ("header", "", "short"), ("header", 'class="site-header"', "links"), ("footer", "", "short"), ("footer", 'id="footer"', "links"),
    ("div", 'class="ad"', "text"), ("div", 'class="advert banner"', "text"), ("aside", "", "text"), ("aside", 'class="sidebar"', "links"), ("div", 'id="sidebar"', "text"), ("div", 'class="related"', "links"),
    ("div", 'class="cookie-notice"', "text"), ("div", 'class="notice"', "text"), ("div", 'id="consent" role="dialog"', "text"), ("section", 'class="comments"', "comments"), ("div", 'id="comments"', "comments"), ("ol", 'class="comment-list"', "comments"),
    ("form", "", "form"), ("div", 'class="newsletter subscribe"', "form"), ("div", 'class="share social"', "links"), ("div", 'class="breadcrumb"', "links"), ("div", 'class="promo sponsored"', "text"), ("div", 'class="popup modal"', "text"),
    ("div", "", "links"),
)


def _other(kind: str, k: int) -> str:
    if kind == "links":
        return f"<ul>{_links(3 + k % 5, k)}</ul>" if k % 2 else " ".join(f'<a href="/{i}">{_FEW[(i + k) % len(_FEW)]}</a>' for i in range(4))
    if kind == "short":
        return f"<h2>{_text(2, k)}</h2><p>&copy; {_text(3, k)}</p>" if k % 2 else f"&copy; {_text(3, k)} &middot; {_text(7, k)}"
    if kind == "text":
        return f"<p>{_text(8 + k % 30, k)}</p>" if k % 2 else _text(6 + k % 30, k)
    if kind == "comments":
        return "".join(f'<div class="comment"><b>{_text(1, i)}</b><p>{_text(6 + (k + i) % 25, k + i)}</p></div>' for i in range(2 + k % 3))
    return f'<label>{_text(2, k)}</label><input name="q"><button>{_text(1, k)}</button>'


def labelled_pages() -> list[str]:
    """Pages of every home with a moving window over what is not article, some with the parts nested in wrappers."""
    out = []
    for k, ((tag, attrs), turn) in enumerate(product(_HOMES, range(24))):
        some = [_OTHERS[(turn + i * 5 + k // 24 * 3) % len(_OTHERS)] for i in range(6)]
        rest = [f'<{t} {a} data-y="0">{_other(kind, k + i)}</{t}>' for i, (t, a, kind) in enumerate(some)]
        inside = _plain(k) if turn % 5 == 3 or not attrs and turn % 2 else _article(k)
        body = f'<{tag} {attrs} data-y="1">{inside}</{tag}>'
        if turn % 4 == 1:  # something that is no article inside the article's home
            body = f'<{tag} {attrs} data-y="1">{_article(k)}{rest.pop()}<p>{_text(12, k)}</p></{tag}>'
        page = "".join(rest[:3]) + body + "".join(rest[3:])
        if turn % 3 == 0:
            page = f'<div class="wrapper">{page}</div>'
        if turn % 7 == 2:  # a form around the whole page
            page = f'<form id="page" method="post">{page}</form>'
        out.append(f"<!DOCTYPE html><html lang='en'><head><title>{_text(4, k)}</title></head><body>{page}</body></html>")
    return out
