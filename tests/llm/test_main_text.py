"""Pages with markup left open, and pages without a marked article."""

import pytest

from tallyline.llm.main_text import main_text

FIRST = "These are words of an article that are long enough to be a text of some weight, here and there."
SECOND = "More words follow in the next block of it, and these are kept as well, whatever stands before them."


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><body><article><p>{0}<p>{1}</article>",
    "<html><head><title>t</title><meta charset=x><p>{0}<p>{1}",
    "<html><title>t</title><p>{0}<p>{1}",
    "<head><title>t<body><p>{0}<p>{1}",
])
def test_open_heads(page):
    assert main_text(page.format(FIRST, SECOND)) == f"{FIRST}\n{SECOND}"


@pytest.mark.parametrize("name", ["object", "svg", "iframe", "select", "button", "noscript", "template"])
def test_open_elements(name):
    both = f"{FIRST}\n{SECOND}"
    assert main_text(f"<body><article><p>{FIRST}</p><{name} a='b'/><p>{SECOND}</p></article>") == both
    assert main_text(f"<body><article><p>{FIRST}</p><{name} a='b'>away<p>{SECOND}</p></article>") == both
    assert main_text(f"<body><article><p>{FIRST}</p><div><{name} a=b>away</div><p>{SECOND}</p></article>") == both
    assert main_text(f"<body><article><p>{FIRST} <{name}>away<p>away</p></{name}></p><{name}>away<p>{SECOND}</p></article>") == both
    assert main_text(f"<body><{name} a=b>away<article><p>{FIRST}</p><p>{SECOND}</p></article><{name}>away</{name}>") == both


def test_raw_text_to_the_end():
    for name in ("script", "style", "textarea"):
        assert main_text(f"<p>{FIRST}</p><{name}>away<p>{SECOND}</p>") == FIRST
        assert main_text(f"<p>{FIRST}</p><{name}>away<p></{name} ><p>{SECOND}</p>") == f"{FIRST}\n{SECOND}"


ADS = "<div class=ad>Buy this now</div>" * 4


@pytest.mark.parametrize("sizes", [(40, 1, 1), (1, 40, 1), (1, 1, 40), (1, 1, 1)])
@pytest.mark.parametrize("around", ["<div id=story>{}</div>", "{}"])
def test_sections_without_a_marked_article(sizes, around):
    sections = [[f"{FIRST} Part {k}, block {i}." for i in range(n)] for k, n in enumerate(sizes)]
    story = ADS.join("".join(f"<p>{p}</p>" for p in s) for s in sections)
    page = f"<body><nav><a href=/>Home</a></nav><div>Site</div>{ADS}{around.format(story)}{ADS}<div>All rights</div>"
    assert main_text(page) == "\n".join(p for s in sections for p in s)


def test_short_sections_without_a_marked_article():
    assert main_text(f"<body><p>{FIRST}</p>{ADS}<p>Short.</p>{ADS}<p>{SECOND}</p>") == f"{FIRST}\nShort.\n{SECOND}"
    assert main_text(f"<body><div><p>Short.</p>{ADS}<p>{FIRST}</p>{ADS}<p>The end.</p></div>{ADS}<div><p>Site</p></div>") == f"Short.\n{FIRST}\nThe end."
    assert main_text(f"<body><div><p>{FIRST}</p></div>{ADS}<ul><li><a href=/a>A long headline of another story on this site, and more of it</a><li><a href=/b>Another headline of the same length and kind</a></ul>") == FIRST


def test_links_in_a_marked_article():
    links = "<ol><li><a href=/a>First reference</a><li><a href=/b>Second reference</a></ol><p><a href=/c>A paragraph that is a link</a></p>"
    assert main_text(f"<article><p>{FIRST}</p>{links}</article><p>{SECOND}</p>") == f"{FIRST}\nFirst reference\nSecond reference\nA paragraph that is a link"
    assert main_text(f"<div><p>{FIRST}</p><p>{SECOND}</p></div><article><a href=/a>Only a headline</a></article>") == f"{FIRST}\n{SECOND}"
