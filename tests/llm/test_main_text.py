"""Surge and dive decide on every page, with and without an article."""

from riskloom.llm.html_text import main_text

BODY = "The council met on Monday and agreed to rebuild the old bridge over the river before the winter comes."


def test_teaser_article_beside_the_body():
    page = f"<body><article><h2>Other news</h2></article><div><p>{BODY}</p><p>{BODY}</p></div></body>"
    assert main_text(page) == f"Other news\n\n{BODY}\n\n{BODY}"


def test_text_outside_of_the_article():
    page = f"<body><nav>menu</nav><div><p>{BODY}</p></div><article><p>Short.</p></article><div>Top</div><footer>end</footer></body>"
    assert main_text(page) == f"{BODY}\n\nShort."


def test_short_text_without_an_article():
    assert main_text("<body><nav>menu</nav><div><p>Closed today.</p></div><nav>more</nav></body>") == "Closed today."
    assert main_text("<nav>menu</nav>") == main_text("") == main_text(None) == ""


def test_window_and_surge_change_results():
    """By hand: lines of 40, 0, 30, 30, 30, 0 and 10 code points. Sums over three lines reach 90, over one line 40."""
    lines = ["a" * 40, "b" * 30, "c" * 30, "d" * 30, "e" * 10]
    page = f"<body><p>{lines[0]}</p><nav>x</nav><p>{lines[1]}</p><p>{lines[2]}</p><p>{lines[3]}</p><nav>y</nav><p>{lines[4]}</p></body>"
    assert main_text(page) == "\n\n".join(lines[1:4])
    assert main_text(page, surge=40) == "\n\n".join(lines[:4])
    assert main_text(page, surge=5) == "\n\n".join(lines)
    assert main_text(page, window=1) == lines[0]
    assert main_text(page, surge=1000) == "\n\n".join(lines[1:4])
