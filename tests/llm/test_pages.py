from fieldloom.llm.pages import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>"</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy now &amp; save</div>{0}<aside>Side &copy;</aside><div id="comments"><p>First comment by a reader, which is long enough to look like text.</p></div>
<form><label>Mail</label><input></form><footer>&copy; Foot</footer></body></html>"""
BODY = "<h1>A title</h1><p>One &lt;two&gt;\n  three &eacute;<br>four.<p>Five <b>six</b>,seven<p>.</p>"
WANT = "A title\nOne <two> three é four.\nFive six,seven\n."


def test_article():
    assert main_text(PAGE.replace("{0}", f"<article>{BODY}</article>")) == WANT


def test_without_article_elements():
    filler = "".join(f"<p>Sentence number {i} of a text that goes on for quite a while.</p>" for i in range(6))
    got = main_text(PAGE.replace("{0}", f'<div class="content">{BODY}{filler}</div>'))
    assert got.startswith(WANT) and got.count("Sentence number") == 6
    for out in ("Menu", "cookies", "Buy now", "Side", "comment", "Foot", "Mail", "Site"):
        assert out not in got


def test_one_long_paragraph_is_not_the_article():
    parts = ["Short one. " * 9, "Long one. " * 100, "Last one. " * 10]
    want = "\n".join(p.strip() for p in parts)
    said = "".join(f"<p>{p}</p>" for p in parts)
    assert main_text(f"<body>{said}</body>") == main_text(PAGE.replace("{0}", f"<div>{said}</div>")) == want


def test_beside_an_inner_part():
    inner = "".join(f"<p>{f'Sentence {i} of the middle. ' * 20}</p>" for i in range(6))
    page = f"<div id=all><h1>Title</h1><p>The lead.</p><div>{inner}</div><div><h2>More</h2><p>The last section.</p></div></div>"
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(9)) + "</ul></div>"
    for got in (main_text(f"<body>{page}</body>"), main_text(f"<body>{menu}{page}{menu}</body>")):
        assert got.startswith("Title\nThe lead.\nSentence 0") and got.endswith("\nMore\nThe last section.") and got.count("\n") == 9


def test_links_in_the_text_stay():
    text = "".join(f"<p>{f'Sentence {i} of a text. ' * 9}</p>" + "<p><a href=x>See what else there is</a></p>" for i in range(4))
    want = 4 * ["See what else there is"]
    for page in (f"<body><div><a href=/>Home</a></div><div>{text}</div></body>", f"<body><div><a href=/>Home</a></div><article>{text}</article></body>"):
        assert main_text(page).split("\n")[1::2] == want and "Home" not in main_text(page)


def test_two_articles():
    cards = "<article><a href=/x>Another page that is elsewhere</a></article>"
    got = main_text(PAGE.replace("{0}", f"<article>{BODY}</article><div class=ad>Buy</div><article><p>{'Second. ' * 90}</p></article>{cards}"))
    assert got == WANT + "\n" + ("Second. " * 90).strip()


def test_regions_decide_between_article_elements_and_the_text_beside_them():
    """Gold pages by hand: cards in article elements beside the text, and an article beside short lines."""
    text = "".join(f"<p>{f'Sentence {i} of the story. ' * 12}</p>" for i in range(5))
    cards = "".join(f"<article><h3>Card {i}</h3><p>A word on another page.</p></article>" for i in range(4))
    got = main_text(f"<body><div id=story><h1>Title</h1>{text}</div><div>{cards}</div></body>")
    assert got.startswith("Title\nSentence 0") and "Sentence 4" in got
    got = main_text(f"<body><div><p>Short line.</p></div><article><h1>Title</h1>{text}<p>End.</p></article><div><p>Another.</p></div></body>")
    assert got.startswith("Title\nSentence 0") and got.endswith("\nEnd.") and got.count("\n") == 6


def test_cut_off_and_malformed():
    assert main_text("<body><article><p>Text &amp more</p></article><footer>&copy; a &am") == "Text & more"
    assert main_text("<p><b>a<br><p>b</b></i></p></div>c") == "a\nb\nc"
    assert main_text("") == main_text("<nav>only a menu</nav>") == ""


def test_head_without_its_end_tag():
    for page in (PAGE.replace("</head>", ""), PAGE.replace("</head><body>", ""), PAGE.replace("</head><body>", "<noscript><div>No script</div></noscript>")):
        assert main_text(page.replace("{0}", f"<article>{BODY}</article>")) == WANT
    assert main_text("<head><meta charset=x><title>T</title>Text at once.<p>More.") == "Text at once.\nMore."
    assert main_text("<head><title>T</title><link rel=a></head><body><p>Text.</p></body>") == "Text."


def test_long_pages_are_read_whole():
    text = "".join(f"<p>Paragraph {i} &amp; its words.</p>" for i in range(20_000))
    got = main_text(PAGE.replace("{0}", f"<article>{text}</article>"))
    assert got.split("\n")[-1] == "Paragraph 19999 & its words." and got.count("\n") == 19_999


def test_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(str, map(tuple, extract_text(pages).collect()))) == ["(1, 'u', '', 0)", "(1, 'u', '', 0)", "(None, None, 'a', 1)"]
    assert extract_text(pages.where("false")).count() == 0
