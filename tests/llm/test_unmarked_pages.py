"""Pages that mark no article: what is left out neither cuts nor shortens the text around it."""

import pytest

from roadspark.llm.line_blocks import main_text

A, B = "a" * 300, "b" * 1000


@pytest.mark.parametrize("first, second", [(A, B), (B, A)])
def test_nested_advert_keeps_short_side(first, second):
    page = f'<div class="content"><p>{first}</p><div class="ad"><p>Buy</p></div><p>{second}</p></div>'
    assert main_text(page) == f"{first}\n{second}"


def test_short_stretch_beside_links_stays():
    links = "<ul>" + "<li><a href=x>Link</a></li>" * 5 + "</ul>"
    assert main_text(f"<div><section><p>{A}</p></section>{links}<section><p>{B}</p></section></div>") == f"{A}\n{B}"


def test_text_before_an_inline_advert_stays():
    assert main_text('<div><p>Before <span class="ad"><div>Buy</div></span> after</p></div>') == "Before\nafter"
