"""Labelled page layouts: pages built from a rule, with ``data-main`` on what is main text.

They show the model parts that a single site's pages lack: name-only
containers, sidebars, notices, forms and reader comments.
"""

from __future__ import annotations

import random

PAGES = 400

_SYLLABLES = "ka lo mi ter ven sa dur pel on ra ti es al un me shi por".split()


def _words(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize()


def _prose(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 5, 16) + r.choice(". . . ! ?".split()) for _ in range(r.randint(low, high)))


def _links(r: random.Random, low: int, high: int, sep: str = "") -> str:
    return sep.join(f'<li><a href="/x">{_words(r, 1, 3)}</a></li>' for _ in range(r.randint(low, high)))


def _named(r: random.Random, *names: str) -> str:
    name = r.choice(names)
    return r.choice([f'class="{name}"', f'id="{name}"', f'class="box {name}"', f'class="{name}-wrap"'])


def _menu(r):
    items = f"<ul>{_links(r, 4, 9)}</ul>"
    return r.choice([f"<nav>{items}</nav>", f"<div {_named(r, 'menu', 'navigation', 'breadcrumb')}>{items}</div>",
                     f"<ul {_named(r, 'nav', 'main-menu')}>{_links(r, 3, 8)}</ul>", f"<div>{items}</div>"])


def _header(r):
    inner = r.choice([f"<h1>{_words(r, 1, 3)}</h1><p>{_words(r, 3, 8)}</p>", f"<div>{_words(r, 1, 3)}</div>",
                      f"<p>{_words(r, 2, 9)}</p>", f"<a href='/'>{_words(r, 1, 2)}</a>"])
    return r.choice([f"<header>{inner}</header>", f"<div {_named(r, 'header', 'masthead', 'topbar')}>{inner}</div>"])


def _footer(r):
    inner = r.choice([f"&copy; {_words(r, 2, 12)}.", f"<p>{_words(r, 4, 20)}.</p>", f"<ul>{_links(r, 3, 6)}</ul>",
                      f"<p>{_prose(r, 1, 3)}</p>"])
    return r.choice([f"<footer>{inner}</footer>", f"<div {_named(r, 'footer', 'copyright', 'legal')}>{inner}</div>"])


def _side(r):
    inner = r.choice([f"<h3>{_words(r, 1, 3)}</h3><ul>{_links(r, 3, 8)}</ul>", f"<p>{_prose(r, 1, 3)}</p>",
                      f"<h2>{_words(r, 1, 4)}</h2><p>{_prose(r, 1, 2)} <a href='/'>{_words(r, 1, 2)}</a></p>"])
    return r.choice([f"<aside>{inner}</aside>", f"<div {_named(r, 'sidebar', 'widget', 'related')}>{inner}</div>",
                     f"<section {_named(r, 'sidebar', 'trending', 'related')}>{inner}</section>"])


def _advert(r):
    inner = r.choice([_prose(r, 1, 3), f"<p>{_prose(r, 1, 3)}</p>", f"<a href='/'>{_words(r, 3, 9)}</a>"])
    return f"<div {_named(r, 'ad', 'advert', 'sponsored', 'promo', 'banner')}>{inner}</div>"


def _notice(r):
    inner = r.choice([f"<p>{_prose(r, 1, 3)}</p><button>{_words(r, 1, 1)}</button>", _prose(r, 1, 2)])
    return r.choice([f"<div {_named(r, 'cookie-notice', 'consent', 'alert', 'notice', 'modal')}>{inner}</div>",
                     f"<section role='alert' {_named(r, 'cookie', 'gdpr')}>{inner}</section>"])


def _form(r):
    inner = f"<label>{_words(r, 1, 3)}</label><input name='q'><p>{_prose(r, 1, 2)}</p><button>{_words(r, 1, 1)}</button>"
    return r.choice([f"<form>{inner}</form>", f"<div {_named(r, 'newsletter', 'signup')}><form>{inner}</form></div>",
                     f"<div {_named(r, 'subscribe', 'search')}>{inner}</div>"])


def _comments(r):
    one = [f"<p>{_prose(r, 1, 4)}</p>" for _ in range(r.randint(1, 5))]
    return r.choice([
        f"<section {_named(r, 'comments')}><h2>{_words(r, 1, 2)}</h2>" + "".join(
            f"<div class='comment'><b>{_words(r, 1, 2)}</b>{c}</div>" for c in one) + "</section>",
        f"<ol {_named(r, 'comment-list', 'replies')}>" + "".join(f"<li>{c}</li>" for c in one) + "</ol>",
        f"<div {_named(r, 'comments', 'discussion')}>" + "".join(
            f"<article class='comment'>{c}</article>" for c in one) + "</div>"])


def _share(r):
    return f"<div {_named(r, 'share', 'social', 'tags')}>{_words(r, 1, 3)} <a href='/'>{_words(r, 1, 1)}</a></div>"


def _block(r):
    """A block of main text."""
    return r.choice([
        lambda: f"<p>{_prose(r, 1, 8)}</p>", lambda: f"<p>{_prose(r, 1, 8)}</p>", lambda: f"<p>{_prose(r, 1, 8)}",
        lambda: f"<p>{_words(r, 1, 6)}.</p>", lambda: f"<p><b>{_words(r, 2, 9)}.<br><p>{_prose(r, 1, 4)}</p>",
        lambda: f"<h2>{_words(r, 2, 7)}</h2><p>{_prose(r, 1, 5)}</p>",
        lambda: f"<ul><li>{_words(r, 2, 12)}</li><li>{_words(r, 2, 12)}</li><li>{_prose(r, 1, 2)}</li></ul>",
        lambda: f"<blockquote><p>{_prose(r, 1, 3)}</p></blockquote>", lambda: f"<div>{_prose(r, 1, 5)}</div>",
        lambda: f"<table><tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr></table>",
        lambda: f"<pre>{_words(r, 3, 20)}</pre>",
        lambda: f"<p>{_prose(r, 1, 3)} <a href='/x'>{_words(r, 1, 3)}</a> {_prose(r, 1, 3)}</p>",
        lambda: f"<figure><img src='x'><figcaption>{_words(r, 3, 10)}.</figcaption></figure>"])()


def _main(r):
    title = r.choice([f"<h1>{_words(r, 2, 9)}</h1>", f"<h1>{_words(r, 2, 9)}.</h1>", f"<h2>{_words(r, 2, 9)}</h2>", ""])
    body = [_block(r) for _ in range(r.randint(1, 10))]
    for extra in (_advert, _share, _side, _form):
        if r.random() < 0.12:
            body.insert(r.randint(0, len(body)), f'<div data-main="0">{extra(r)}</div>')
    inner = title + "".join(body)
    name = _named(r, "content", "post", "entry", "story", "article-body")
    return r.choice([
        f'<article data-main="1">{inner}</article>', f'<main data-main="1">{inner}</main>',
        f'<main data-main="1"><article>{inner}</article></main>', f'<div {name} data-main="1">{inner}</div>',
        f'<article data-main="1"><div {name}>{inner}</div></article>', f'<div data-main="1">{inner}</div>',
        f'<section data-main="1"><div>{inner}</div></section>'])


def pages(n: int = PAGES, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        top = [f(r) for f in (_notice, _header, _menu, _advert, _form) if r.random() < 0.5]
        low = [f(r) for f in (_share, _side, _comments, _form, _advert, _side, _footer) if r.random() < 0.5]
        inner = "".join(top) + _main(r) + "".join(low)
        if r.random() < 0.3:
            inner = f"<div {_named(r, 'page', 'container', 'wrapper')}>{inner}</div>"
        out.append(f"<html><head><title>{_words(r, 2, 6)}</title></head><body>{inner}</body></html>")
    return out
