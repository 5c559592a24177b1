"""Pages whose article stands in plain elements, with short blocks beside the long ones."""

import pytest

from plenum.llm import html

HEAD, LAST = "A heading of 20 char", "The end."
LONG = [f"{i} " + "word after word of a long paragraph " * 11 for i in range(8)]
WANT = "\n\n".join([HEAD, *(" ".join(t.split()) for t in LONG), LAST])
PARAS = "".join(f"<p>{t}</p>" for t in LONG)
MENU = "<div class=top>Some site</div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<h1>{HEAD}</h1>{PARAS}<p>{LAST}</p>",
        f"<div>{MENU}<div><h1>{HEAD}</h1>{PARAS}<p>{LAST}</p></div><div>Copyright</div></div>",
        f"<div>{MENU}<div><h1>{HEAD}</h1>{''.join(f'<div>{t}</div>' for t in LONG)}<p>{LAST}</p></div><div>Copyright</div></div>",
        f"<div>{MENU}<div><h1>{HEAD}</h1><div>{PARAS}<p>{LAST}</p></div></div></div>",
        f"<div>{MENU}<section><h2>{HEAD}</h2><ul>{''.join(f'<li>{t}' for t in LONG)}</ul><p>{LAST}</section></div>",
        f"<nav>m</nav><table><tr><td>{MENU}<td><h1>{HEAD}</h1>{PARAS}<p>{LAST}</p></table>",
    ],
)
def test_short_blocks_beside_long_ones(body):
    assert html.main_text(f"<html><body>{body}</body></html>") == WANT


def test_one_long_block():
    for page in (f"<div><h1>{HEAD}</h1><div>{LONG[0]}</div><p>{LAST}</p></div>", f"<h1>{HEAD}</h1><p>{LONG[0]}</p><p>{LAST}</p>"):
        assert html.main_text(page) == "\n\n".join([HEAD, " ".join(LONG[0].split()), LAST])
    assert html.main_text(f"<div><div><div>{LONG[0]}</div></div></div>") == " ".join(LONG[0].split())


def test_articles_are_whole_and_alone():
    assert html.main_text(f"<div>{LONG[3]}</div><div><article><h1>{HEAD}</h1>{PARAS}<p>{LAST}</p></article></div>") == WANT
