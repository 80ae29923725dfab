"""Operator 8: formulas, drawings, selects, raw elements and CDATA lose no visible text."""

import pytest

from roadloom.llm.html import render


@pytest.mark.parametrize(("page", "text"), [
    ("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> holds", "so E=mc 2 holds"),
    ("<p><math><semantics><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation encoding='tex'>\\frac12</annotation></semantics></math>", "1 2"),
    ("<p>a<svg><title>t</title><defs><text>no</text></defs><style>x{}</style><g><text>Ja<tspan>n</tspan><title>tip</title></text><text display='none'>no</text><path/><text>Feb</text></g></svg>b", "a Jan Feb b"),
    ("<svg><defs/><text><![CDATA[1 < 2]]></text><foreignObject><p>in</p></foreignObject></svg><p>out", "1 < 2\n\nin\n\nout"),
    ("<p><svg><path d='x'><p>after", "after"),
    ("<p>Size <select><optgroup label=g><option>S<option selected>M<option>L</select> now", "Size M now"),
    ("<p><select><option disabled>pick<option label='First'>x<option>y</select>", "First"),
    ("<select multiple><option>a<option>b</select>c", "a\nb\nc"),
    ("<script>var a = '</scripty>'</script x>one<style>p{}</style\n>two", "onetwo"),
    ("<title>t</title/ ><textarea>in</textarea foo>out", "tinout"),
    ("a<![CDATA[b>c]]>d", "ac]]>d"),
])
def test_visible_text(page, text):
    assert render(page) == text
