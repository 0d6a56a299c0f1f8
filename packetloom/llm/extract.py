"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one per block of the page. What tags, roles or class
names show to be no article (menus, adverts, notices, forms, comments ...) leaves
blank lines, and text inside links does not count. The text lengths of every
``WINDOW`` lines in a row are summed; the article begins where the sum surges and
ends where it dives to zero. The text between surge and dive is kept, and so is
every other line of the element around it, so that an advert in the middle does
not cut an article in two. Where the page names its article (article, main), what
surge and dive found is widened to the named elements around it and bounded by them.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 80

# Elements by what HTML says they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object title noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
NO_ARTICLE = frozenset("head nav header footer aside form menu button select option dialog label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids of what is no article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer discussion disqus dropdown feedback footer form header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion reactions "
    "recommend recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser toc toolbar topbar trending warning widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_UNENDED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_PIECES = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _kept_out(name: str, inside: bool) -> bool:
    """Does a class name or id say that this is no article?"""
    parts = [p.lower() for p in _PIECES.split(name) if p]
    if not parts or parts[0] in ("has", "with", "no", "without") or parts[-1] in ("free", "open", "enabled"):
        return False
    return any(p in NAMES and not (inside and p == "header") for p in parts)


def _aside(tag: str, attributes: str, inside: bool, names: bool = True) -> bool:
    """Is the element left out with all it holds? ``inside`` an article, a header is that of the article.

    Without ``names`` classes and ids say nothing.
    """
    if tag in NO_ARTICLE and not (inside and tag == "header"):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if names and name in ("class", "id") and any(_kept_out(v, inside) for v in value.split()) and (tag != "article" or inside):
            return True
        if name == "class" and tag == "article" and re.search(r"comment|repl(y|ies)|teaser|related|promo", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:[\s/]|$)", _QUOTED.sub("", attributes)))


def lines(page: str) -> list[tuple[str, int, tuple[int, ...], tuple[int, ...]]]:
    """(text, length outside links, elements around it, named) of each line; blank lines where something was left out.

    ``named`` are the article and main elements around the line, outermost first. A
    name leaves an element out only if that leaves a text: not if the only article or
    main stands in it, nor, comments aside, if it holds nearly all text of the page.
    """
    spared: set[int] = set()
    while True:
        out, left = _lines(page, spared)
        size = sum(n for _, n, *_ in out)
        whole = size + sum(n for _, n, *_ in left)
        more = set() if any(x[3] for x in out) else {at for at, _, holds, _ in left if holds}
        more |= {at for at, n, _, talk in left if n and (not size or not talk and 5 * n > 4 * whole)}
        if not more:
            return out
        spared |= more


def _lines(page: str, spared: set[int]) -> tuple[list[tuple[str, int, tuple[int, ...], tuple[int, ...]]], list[tuple[int, int, bool, bool]]]:
    """The lines, where elements that start at ``spared`` are not left out for their names.

    Also of each element left out for its names: start, length of its text outside
    links, whether an article or main stands in it, whether it holds comments.
    """
    out: list[tuple[str, int, tuple[int, ...], tuple[int, ...]]] = []
    left: list[tuple[int, int, bool, bool]] = []
    soft, lost, holds, talk = -1, 0, False, False  # the element left out for its names
    hard = 0  # elements in it that are left out in any case
    text: list[str] = []
    loose = 0  # characters outside links
    stack: list[tuple[str, bool, bool, tuple[int, ...], tuple[int, ...]]] = []  # tag, left out, left out within such, named and elements before
    skipping = linked = number = 0
    part: tuple[int, ...] = ()
    around: tuple[int, ...] = ()

    def flush() -> None:
        nonlocal loose
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append((line, min(loose, len(line)), around, part))
        text.clear()
        loose = 0

    def close(to: int) -> None:
        nonlocal skipping, linked, part, around, soft, lost, holds, hard
        while len(stack) > to:
            tag, left_out, within, before, outer = stack.pop()
            if tag in BLOCK and not skipping:
                flush()
            skipping -= left_out
            hard -= within
            if left_out and soft >= 0:
                left.append((soft, lost, holds, talk))
                soft, lost, holds = -1, 0, False
            linked -= tag == "a"
            part, around = before, outer
            if left_out and not skipping:
                out.extend([("", 0, around, part)] * WINDOW)

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at and not skipping:
            run = page[at:stop] if token else _UNENDED.sub("", page[at:stop])
            text.append(run)
            loose += 0 if linked else len(run.strip())
        elif stop > at and soft >= 0 and not hard and not linked:
            lost += len(page[at:stop].strip())
        if token is None:
            break
        at = token.end()
        closing, tag, attributes = token.group(1), (token.group(2) or "").lower(), token.group(3)
        if not tag:
            continue
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i >= 0:
                close(i)
            continue
        if tag in RAW and not attributes.endswith("/"):
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = found.end() if found else end
            continue
        if tag in BLOCK:
            # an open paragraph ends where a block begins, an item where the next one does
            ends = ("p",) if tag != "li" else ("p", "li")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                elif stack[i][0] in BLOCK:
                    break
            if not skipping:
                flush()
        if tag in VOID or attributes.endswith("/") or tag in ("td", "th"):
            text.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        left_out = not skipping and _aside(tag, attributes, bool(part), token.start() not in spared)
        within = soft >= 0 and _aside(tag, attributes, bool(part))
        hard += within
        if left_out:
            flush()
            if not _aside(tag, attributes, bool(part), False):
                soft, talk = token.start(), bool(re.search("comment|discuss|disqus|repl|respond|reaction", attributes, re.I))
        elif soft >= 0 and not hard:
            holds |= tag in ("article", "main")
        stack.append((tag, left_out, within, part, around))
        skipping += left_out
        linked += tag == "a"
        if tag in BLOCK:
            number += 1
            around = (*around, number)
        if tag in ("article", "main") and not skipping:
            part = (*part, number)
    close(0)
    if not skipping:
        flush()
    return out, left


def main_text(page: str | None) -> str:
    """Blocks of the article, in page order, joined by an empty line."""
    found = lines(page) if page else []
    if not any(t for t, *_ in found):
        return ""
    size = np.array([n if n * 2 >= len(t) else 0 for t, n, *_ in found])
    if not size.any():
        return ""
    # surge and dive: runs of lines between stretches of WINDOW lines without text
    window = np.convolve(size, np.ones(WINDOW, int))[WINDOW - 1 :]  # sum over a line and those after it
    run = np.cumsum(np.r_[True, (window[1:] > 0) & (window[:-1] == 0)])
    total = np.bincount(run, size)
    surged = np.bincount(run, window >= SURGE) > 0
    surged[total.argmax()] = True
    kept = surged[run] & (size > 0)
    # article and main elements with a fair share of the text: what surged is widened to those around it and bounded by them
    whole: dict[int, int] = {}
    hit: dict[int, int] = {}
    for n, k, (*_, named) in zip(size.tolist(), kept.tolist(), found):
        for e in named:
            whole[e] = whole.get(e, 0) + n
            hit[e] = hit.get(e, 0) + n * k
    loose = sum(n for n, x in zip(size.tolist(), found) if not x[3])
    wanted: set[int] = set()
    for i in np.flatnonzero(kept):
        named = found[i][3]
        # the outermost that is nearly all surge, or else the innermost
        wanted.update(next(((e,) for e in named if 10 * hit[e] >= 9 * whole[e]), named[-1:]))
    if wanted and 4 * sum(n for n, x in zip(size.tolist(), found) if wanted.intersection(x[3])) >= loose:
        return "\n\n".join(t for t, *_, named in found if t and wanted.intersection(named))
    # what else stands in the innermost element around nearly all of it belongs to it
    held: dict[int, int] = {}
    for i in np.flatnonzero(kept):
        for e in found[i][2]:
            held[e] = held.get(e, 0) + int(size[i])
    most = size[kept].sum()
    for e in sorted((e for e, n in held.items() if 10 * n >= 9 * most), reverse=True)[:1]:
        inside = np.array([e in x[2] for x in found])
        if 10 * size[inside & kept].sum() >= 9 * size[inside].sum():
            kept = inside & (size > 0)
    return "\n\n".join(found[i][0] for i in np.flatnonzero(kept))


def extracted(page: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return of(page)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A NULL, empty or text-free page has an empty text. Whole pages are read, however
    long or broken; repeated rows give repeated rows. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), extracted(F.col(page)).alias("text"))
    return rows.select("*", F.length("text").cast("long").alias("n_chars"))
