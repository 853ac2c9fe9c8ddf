"""The labelled table that the block classifier is trained on: hand-written pages.

Every text block starts with ``+`` (article) or ``-`` (not); ``{n}`` stands for about n words, and a star after an element for
one to ten such elements, short and long ones in any order. Pages with
and without semantic elements, with long boilerplate and short paragraphs, and with names that
say one thing on one page and another on the next, so that no single feature decides. Each page is drawn
``DRAWS`` times with other word counts: the table has ``DRAWS * len(PAGES)`` pages, whatever the corpus.
"""

from __future__ import annotations

import random
import re

DRAWS = 16

PAGES = (
    # semantic elements; short and long paragraphs, heading in the article
    """<body><header><p>-{3}</p><p>-{12}</p></header><nav><ul><li><a>-{1}</a></li><li><a>-{1}</a></li><li><a>-{2}</a></li></ul></nav>
    <main><article><h1>+{6}</h1><p>+{40}</p><p>+{1}</p><p>+{3}</p><p>+{90}</p><h2>+{3}</h2><p>+{25}</p><p>+{200}</p></article></main>
    <aside><h3>-{2}</h3><p>-{30}</p><ul><li><a>-{6}</a></li><li><a>-{7}</a></li></ul></aside><footer><p>-{8}</p><a>-{2}</a></footer></body>""",
    """<body><nav><ul><li><a>-{1}</a></li><li><a>-{1}</a></li></ul></nav><div class="ad">-{8}</div><article><h1>+{8}</h1><p>+{8}</p><p>+{60}</p><p>+{2}</p></article><footer>-{14}</footer></body>""",
    """<body><nav><ul><li><a>-{1}</a></li><li><a>-{1}</a></li><li><a>-{1}</a></li></ul></nav><div>-{8}</div><article><h1>+{9}</h1><p>+{30}</p><p>+{5}</p><p>+{120}</p><p>+{80}</p><p>+{3}</p><p>+{2}</p></article><footer>-{11}</footer></body>""",
    """<body><nav><a>-{1}</a></nav><div class="ad">-{20}</div><article><h1>+{1}</h1><p>+{1}</p></article><footer>-{9}</footer></body>""",
    """<body><nav><ul><li><a>-{1}</a></li><li><a>-{1}</a></li></ul></nav><div class="ad">-{12}</div><article><h1>+{7}</h1><p>+{4}</p><p>+{6}</p><p>+{3}</p></article><footer>-{15}</footer></body>""",
    # the article's own header, share links, comments and forms inside it
    """<body><header><h1>-{3}</h1></header><article><header><h1>+{7}</h1></header><p>+{50}</p><ul><li>+{9}</li><li>+{12}</li></ul><blockquote>+{20}</blockquote><p>+{70} <a>{4}</a></p>
    <div class="share"><a>-{1}</a><a>-{1}</a></div><section class="comments"><h2>-{1}</h2><div><p>-{30}</p></div><div><p>-{80}</p></div></section>
    <form><label>-{2}</label><p>-{10}</p></form><footer><p>-{25}</p></footer></article><footer>-{10}</footer></body>""",
    # notices and boxes without semantic elements, main text in named divs
    """<body><div id="cookie-notice"><p>-{35}</p><a>-{1}</a></div><div class="menu"><a>-{1}</a><a>-{1}</a></div><div id="content"><h1>+{5}</h1><p>+{45}</p><p>+{4}</p><p>+{110}</p></div>
    <div class="sidebar"><p>-{50}</p><p>-{5}</p></div><div class="newsletter"><h3>-{4}</h3><p>-{18}</p></div><div class="related"><a>-{8}</a><a>-{7}</a></div><div class="footer">-{12}</div></body>""",
    """<body><div role="banner">-{6}</div><div role="navigation"><a>-{1}</a></div><div role="main"><h1>+{6}</h1><p>+{30}</p><p>+{5}</p></div><div role="complementary"><p>-{60}</p></div><div role="contentinfo">-{9}</div></body>""",
    # nothing but tables and bare divs: length and links have to tell
    """<body><div><a>-{2}</a> <a>{2}</a> <a>{1}</a></div><div>-{3}</div><div><h1>+{6}</h1></div><div>+{80}</div><div>+{60}</div><div>+{45}</div><div>+{100}</div><div>-{4}</div><div><a>-{4}</a></div><div><a>-{3}</a></div></body>""",
    """<body><table><tr><td><a>-{1}</a></td><td><a>-{2}</a></td></tr></table><p>+{55}</p><p>+{20}</p><p>+{75}</p><p>+{30} <a>{3}</a></p><table><tr><td>-{3}</td><td><a>-{3}</a></td></tr></table></body>""",
    """<body><p><a>-{2}</a></p><h1>+{7}</h1><p>+{120}</p><p>+{15}</p><p>+{64}</p><p>-{2} <a>{9}</a></p><p><a>-{5}</a></p><p>-{3}</p></body>""",
    """<body><ul><li><a>-{2}</a></li><li><a>-{1}</a></li><li><a>-{1}</a></li></ul><h1>+{5}</h1><p>+{33}</p><p>+{28}</p><p>+{41}</p><p>-{6}</p><ul><li><a>-{5}</a></li><li><a>-{6}</a></li></ul></body>""",
    # comments after the article, as siblings
    """<body><article><h1>+{9}</h1><p>+{21}</p><p>+{66}</p></article><div id="comments"><p>-{14}</p><p>-{90}</p><p>-{3}</p></div><div class="login-form"><p>-{4}</p></div></body>""",
    """<body><section class="hero-banner"><p>-{9}</p></section><article><p>+{12}</p><p>+{2}</p></article><article><p>+{35}</p></article><div class="advert"><p>-{40}</p></div><div class="modal">-{22}</div></body>""",
    """<body><nav><a>-{1}</a><a>-{1}</a></nav><article><h1>+{6}</h1><p>+{60}</p><p>+{25}</p><section class="comments"><p>-{25}</p><p>-{12}</p></section></article><section id="comments"><h3>-{2}</h3><p>-{40}</p><p>-{18}</p></section><footer>-{7}</footer></body>""",
    # text beside an article without any hint of what it is
    """<body><div>-{7}</div><p>-{30}</p><article><h1>+{6}</h1><p>+{26}</p><p>+{3}</p><p>+{80}</p></article><div>-{25}</div><p>-{60}</p></body>""",
    """<body><p>-{16}</p><main><p>+{10}</p><p>+{31}</p><p>+{14}</p></main><div><p>-{45}</p><p>-{12}</p></div><p>-{9}</p></body>""",
    """<body><main><h1>+{4}</h1><p>+{3}</p><p>+{6}</p><p>+{11}</p><div class="promo">-{15}</div><p>+{17}</p><aside>-{28}</aside><p>+{2}</p></main><footer><p>-{45}</p></footer></body>""",
    # names that mislead: they hold the article's own text here
    """<body><nav><a>-{1}</a><a>-{1}</a></nav><article><h1>+{5}</h1><p>+{70}</p><div class="side-note"><p>+{40}</p></div><p>+{55}</p><div class="tags"><p>+{30}</p></div><div class="share"><p>+{45}</p><p>+{60}</p></div></article><footer>-{9}</footer></body>""",
    """<body><div class="header"><a>-{1}</a><a>-{2}</a></div><div class="search"><h1>+{5}</h1><p>+{90}</p><p>+{8}</p><p>+{60}</p></div><div class="skip"><p>+{75}</p><p>+{50}</p></div><div class="main"><a>-{3}</a><a>-{4}</a></div><div class="content">-{6}</div></body>""",
    """<body><div class="post"><a>-{2}</a><a>-{1}</a></div><div class="related"><h2>+{6}</h2><p>+{65}</p><p>+{4}</p><p>+{85}</p><p>+{40}</p></div><div class="story"><p>-{4}</p><a>-{4}</a></div></body>""",
    # lists and quotations that are text, lists that are links
    """<body><ul><li><a>-{1}</a></li><li><a>-{1}</a></li></ul><article><h1>+{7}</h1><p>+{35}</p><ol><li>+{14}</li><li>+{2}</li><li>+{9} <a>{2}</a></li></ol><blockquote><p>+{33}</p></blockquote><p>+{20}</p></article><ul><li><a>-{6}</a></li><li><a>-{5}</a></li><li><a>-{8}</a></li></ul><footer>-{6}</footer></body>""",
    """<body><header><a>-{2}</a></header><main><h1>+{5}</h1><p>+{22} <a>{12}</a></p><p>+{48}</p><table><tr><td>+{2}</td><td>+{3}</td></tr><tr><td>+{4}</td><td>+{1}</td></tr></table><p>+{36}</p></main><form><p>-{12}</p><label>-{3}</label></form><footer><p>-{16}</p></footer></body>""",
    # ordinary pages with articles of any length
    """<body><nav><ul><li><a>-{1}</a></li>*</ul></nav><div>-{8}</div><article><h1>+{9}</h1><p>+{30}</p>*</article><footer>-{11}</footer></body>""",
    """<body><nav><ul><li><a>-{1}</a></li>*</ul></nav><div class="box">-{9}</div><article><h1>+{10}</h1><p>+{12}</p>*<p>+{60}</p>*</article><footer>-{8}</footer></body>""",
    """<body><nav><ul><li><a>-{1}</a></li>*</ul></nav><article><h1>+{7}</h1><p>+{30}</p>*<h2>+{3}</h2><p>+{30}</p>*</article><aside><h3>-{2}</h3><p>-{20}</p>*</aside><footer>-{11}</footer></body>""",
    """<body><header><p>-{4}</p><a>-{2}</a></header><nav><a>-{1}</a>*</nav><main><h1>+{7}</h1><p>+{25}</p>*<ul><li>+{6}</li>*</ul><p>+{25}</p>*</main><section id="comments"><p>-{20}</p>*</section><footer><p>-{9}</p></footer></body>""",
    """<body><div class="top"><a>-{2}</a><a>-{1}</a></div><div id="page"><h1>+{6}</h1><p>+{30}</p>*<blockquote>+{15}</blockquote><p>+{30}</p>*</div><div class="sidebar"><p>-{15}</p>*</div><div class="bottom">-{10}</div></body>""",
    """<body><div><a>-{1}</a> <a>{1}</a> <a>{2}</a></div><div><h1>+{6}</h1><p>+{35}</p>*</div><div><a>-{6}</a> <a>{5}</a> <a>{7}</a></div><div>-{9}</div></body>""",
    """<body><p>-{4}</p><ul><li><a>-{2}</a></li>*</ul><h1>+{8}</h1><p>+{40}</p>*<p>-{5} <a>{6}</a></p><p>-{7}</p></body>""",
    """<body><nav><a>-{1}</a>*</nav><div class="notice">-{14}</div><article><h1>+{6}</h1><p>+{3}</p>*</article><footer>-{9}</footer></body>""",
    """<body><nav><a>-{1}</a>*</nav><div class="ad">-{11}</div><article><p>+{40}</p>*<div class="ad">-{9}</div><p>+{40}</p>*</article><section class="comments"><h3>-{1}</h3><p>-{25}</p>*</section><footer>-{13}</footer></body>""",
    """<body><nav><a>-{1}</a>*</nav><article><h1>+{5}</h1><p>+{30}</p>*<section><h2>+{3}</h2><p>+{20}</p>*</section><section><h2>+{4}</h2><p>+{20}</p>*</section><section class="comments"><p>-{15}</p>*</section></article><footer>-{10}</footer></body>""",
    """<body><header><h1>-{3}</h1><p>-{8}</p></header><form><label>-{2}</label>*</form><article><header><h1>+{8}</h1></header><p>+{22}</p>*</article><aside><p>-{30}</p>*</aside><aside><a>-{6}</a>*</aside><footer><p>-{12}</p>*</footer></body>""",
    """<body><div role="navigation"><a>-{1}</a>*</div><div role="main"><h1>+{5}</h1><p>+{26}</p>*</div><div role="complementary"><p>-{22}</p>*</div><div role="contentinfo">-{9}</div></body>""",
    # small pages, with little or nothing around the article
    """<article><p>+{2}</p></article>""",
    """<body><article><p>+{3}</p>*</article></body>""",
    """<article><p>+{2}</p><form><p>-{2}</p></form><aside>-{2}</aside><p>+{2}</p></article>""",
    """<article><p>+{20}</p>*<aside>-{30}</aside><p>+{20}</p>*<form><p>-{12}</p></form></article>""",
    """<body><nav><a>-{1}</a></nav><article><h1>+{2}</h1><p>+{3}</p></article><footer>-{2}</footer></body>""",
    """<body><header><p>-{6}</p></header><article><p>+{5}</p><footer><p>-{4}</p></footer></article><aside><p>-{9}</p></aside></body>""",
    """<body><article><p>+{4}</p><p>+{3}</p></article><section class="comments"><p>-{12}</p>*</section></body>""",
)


def labelled(pages: tuple[str, ...] = PAGES, draws: int = DRAWS, seed: int = 11) -> list[str]:
    """The pages with their words put in; every draw has word counts of its own."""
    rng = random.Random(seed)
    count = lambda n, spread: max(1, round(n * rng.lognormvariate(0, spread)))
    any_size = lambda w: f"{{{rng.randint(1, 3) if rng.random() < 0.3 else count(int(w[1]), 1.2)}}}"
    many = lambda m: "".join(re.sub(r"\{(\d+)\}", any_size, m[1]) for _ in range(rng.randint(1, 10)))
    words = lambda m: " ".join(["word"] * count(int(m[1]), 0.45))
    drawn = (re.sub(r"(<(\w+)>(?:(?!</\2>).)*</\2>)\*", many, p) for p in pages for _ in range(draws))
    return [re.sub(r"\{(\d+)\}", words, p) for p in drawn]
