"""Pages labelled by hand for the extraction of main text: content stands between ``<!--+-->`` and ``<!--/-->``.

In the templates {L} is a long paragraph, {S} a sentence, {T} a title, {N} a
link's label and {W} one word; each becomes made-up words, so that nothing but
structure, punctuation and a few cues of boilerplate can be learned.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "ba ce di fo gu ha ki le mo nu pa re si to vu an er is on ul".split()
VARIANTS = 6

TEMPLATES = (
    # an article with head, menu, advert and foot
    """<html><head><title>{T}</title></head><body><nav><ul><li><a href=/>{N}</a></li><li><a href=/a>{N}</a></li><li><a href=/b>{N}</a></li></ul></nav><div class="ad">{S}</div>
    <article><!--+--><h1>{T}</h1><p>{L}</p><p>{S}<br>{S}</p><p>{L}</p><!--/--></article><footer>&copy; {W}.com &middot; {S}</footer></body></html>""",
    # the same, the advert within, comments after
    """<body><header><h1>{W}</h1><nav><a href=/>{N}</a> <a href=/n>{N}</a></nav></header><article><!--+--><h1>{T}</h1><p>{L}</p><!--/--><div class="ad-slot">{S}</div><!--+--><p>{L}</p><ul><li>{S}</li><li>{N}</li></ul>
    <blockquote>{S}</blockquote><!--/--><section class="comments"><h2>{T}</h2><p>{S}</p><p>{L}</p></section></article><aside class="related"><h3>{T}</h3><a href=/a>{T}</a><a href=/b>{T}</a></aside><footer>{S} {S}</footer></body>""",
    # plain containers with telling classes
    """<body><div id="menu"><a href=/>{N}</a> | <a href=/b>{N}</a> | <a href=/c>{N}</a></div><div class="post-content"><!--+--><h2>{T}</h2><p>{L}</p><p>{L} <a href=/x>{N}</a> {S}</p><!--/--></div>
    <div id="comments"><div class="comment">{L}</div><div class="comment">{S}</div></div><form><label>{W}</label><button>{W}</button></form><div id="footer">Copyright 2021 {W}. All rights reserved.</div></body>""",
    # main with a cookie notice and a table
    """<body><div class="cookie-notice"><p>We use cookies. {S}</p><a href=/p>{N}</a></div><header>{S}</header><main><!--+--><p>{L}</p><table><tr><th>{W}</th><th>{W}</th></tr><tr><td>{N}</td><td>{N}</td></tr></table><p>{S}</p><!--/--></main><div class="promo-banner">{S}</div></body>""",
    # a layout table without any container
    """<body><table><tr><td><a href=/1>{N}</a></td><td><a href=/2>{N}</a></td><td><a href=/3>{N}</a></td></tr></table><!--+--><h1>{T}</h1><p>{L}</p><p>{L}</p><p>{S}</p><!--/--><ul><li><a href=/4>{N}</a></li><li><a href=/5>{N}</a></li></ul><p>Copyright {W}</p></body>""",
    # divs with no telling classes
    """<body><div><a href=/>{N}</a> <a href=/a>{N}</a> <a href=/c>{N}</a></div><div><div><!--+--><h2>{T}</h2><div>{L}</div><div>{L}</div><div>{S}</div><!--/--></div></div><div><a href=/t>{N}</a></div><div>Copyright 2019 {W}. All rights reserved.</div></body>""",
    """<body><div>{N}</div><div><a href=/a>{N}</a></div><div><a href=/b>{T}</a></div><div><!--+--><p>{L}</p><p>{L}</p><p>{L}</p><!--/--></div><div>{N}</div><div>{W} {W}, {W}</div><div>Sign up</div></body>""",
    # a story in main, a teaser in an article; and the other way round
    """<main><!--+--><h1>{T}</h1><p>{L}</p><p>{L}</p><!--/--></main><article><h3>{T}</h3><p>{S}</p></article><article><h3>{T}</h3><p>{S}</p></article>""",
    """<main><p>{N}</p><article><!--+--><p>{L}</p><p>{S}</p><p>{L}</p><!--/--></article><p>{S}</p></main>""",
    # two articles around a sidebar full of links
    """<body><article><!--+--><p>{L}</p><p>{S}</p><!--/--></article><aside><a href=/1>{N}</a> <a href=/2>{N}</a> <a href=/3>{N}</a> <a href=/4>{N}</a> <a href=/5>{N}</a></aside><article><!--+--><p>{L}</p><p>{W}.</p><!--/--></article><footer><p>{S}</p></footer></body>""",
    # an article of links only, and of one short line
    """<body><nav><a href=/>{N}</a></nav><article><!--+--><ul><li><a href=/x>{T}</a></li><li><a href=/y>{N}</a></li></ul><!--/--></article></body>""",
    """<body><article><!--+--><p>{W}</p><!--/--></article><div class="sidebar">{S}</div></body>""",
    """<body><article><!--+--><p>{S}</p><p>{W}.</p><p>{N}</p><!--/--></article></body>""",
    """<body><nav><a href=/>{N}</a></nav><article><!--+--><h1>{W}</h1><p>{W}</p><div>{N}</div><p>{T}</p><!--/--></article><footer>{S}</footer></body>""",
    """<body><article><!--+--><h1>{N}</h1><ul><li>{W}</li><li>{T}</li></ul><div>{T}</div><p>{N}: <a href=/x>{T}</a></p><!--/--></article><footer>{W}</footer></body>""",
    """<body><main><!--+--><h1>{T}</h1><p>{L}</p><h3>{N}</h3><p>{N}</p><div>{S}</div><ul><li>{T}</li><li><a href=/x>{N}</a></li></ul><!--/--></main><div>{N}</div><div>{W} <a href=/x>{N}</a></div></body>""",
    """<body><p>{N}</p><article><!--+--><p>{L}</p><h2>{T}</h2><p>{T}</p><!--/--></article><article><!--+--><p>{N}</p><p>{L}</p><!--/--></article><p>{S}</p></body>""",
    # classes that only hold a word of boilerplate
    """<body><article class="post has-sidebar"><!--+--><p>{L}</p><div class="share-price">{S}</div><div class="content-ad-free">{L}</div><section class="related-work"><h2>{T}</h2><p>{L}</p></section><!--/--><div class="social-share"><a href=/f>{W}</a></div></article></body>""",
    """<body><div class="site comments-open"><div class="entry"><!--+--><h2>{T}</h2><p>{L}</p><p class="menu-price">{S}</p><p>{L}</p><!--/--></div><div class="entry-footer">{S}</div></div></body>""",
    """<body class="no-sidebar"><div class="story no-comments"><!--+--><p>{L}</p><p class="ad-hoc">{S}</p><!--/--></div><div class="newsletter-signup"><p>Subscribe. {S}</p><button>{W}</button></div></body>""",
    # a form around the whole page
    """<body><form action=/><div><a href=/a>{N}</a> <a href=/b>{N}</a></div><div class="content"><!--+--><h1>{T}</h1><p>{L}</p><p>{L}</p><p>{L}</p><!--/--></div><div class="footer">{S}</div></form></body>""",
    # bare text
    """<p><!--+-->{S}<br>{S}<!--/--></p>""",
    """<!--+-->{S}<!--/-->""",
    """<!--+-->{T} {N}<!--/-->""",
    """<!--+-->{T}<br>{T}<!--/-->""",
    """<!--+--><p>{L}</p><p>{S}</p><!--/-->""",
    """<h1><!--+-->{T}</h1><p>{S}<!--/--></p>""",
    """<p><!--+-->{N}<!--/--></p>""",
    # menus and nothing else
    """<nav><a href=/>{N}</a></nav>""",
    """<ul><li><a href=/a>{N}</a></li><li><a href=/b>{N}</a></li></ul><footer>{S}</footer>""",
    # adverts and notices of many words
    """<body><p><!--+-->{L}<!--/--></p><div class="ad">{L}{L}</div><p><!--+-->{L}<!--/--></p></body>""",
    """<body><article><!--+--><p>{L}</p><!--/--></article><div class="banner-ad">{L} {L}</div><article><!--+--><p>{L}</p><!--/--></article><article class="comment"><p>{L}</p></article></body>""",
    """<body><div class="alert">{L}</div><div role="main" class="with-sidebar"><!--+--><h1>{T}</h1><p>{L}</p><!--/--></div><aside>{L}</aside><div class="disclaimer">{L}</div></body>""",
    # questions and answers, definitions, quotes
    """<body><div class="topbar"><a href=/>{N}</a></div><main><article><!--+--><h1>{T}</h1><dl><dt>{N}</dt><dd>{S}</dd><dt>{N}</dt><dd>{L}</dd></dl><pre>{S}</pre><figure><figcaption>{S}</figcaption></figure><!--/--></article><section id="respond"><h3>{T}</h3><p>{S}</p></section></main></body>""",
    # a long legal paragraph far below the text
    """<body><div><!--+--><p>{L}</p><p>{L}</p><p>{L}</p><!--/--></div><div><a href=/1>{T}</a></div><div><a href=/2>{T}</a></div><div><a href=/3>{T}</a></div><div><a href=/4>{T}</a></div><div><a href=/5>{T}</a></div><div>{N}</div><div>Terms of use and privacy policy. {S}</div></body>""",
)


#: Ways to mark boilerplate; each holds whole paragraphs, so that nothing but the mark tells.
WRAPPERS = (
    "<nav>|</nav>", "<header>|</header>", "<footer>|</footer>", "<aside>|</aside>", "<form>|</form>", "<dialog>|</dialog>", "<div hidden>|</div>", '<div style="display:none">|</div>', '<div class="ad">|</div>',
    '<div class="advert-box">|</div>', '<div class="sponsored">|</div>', '<ul class="menu">|</ul>', '<div id="navigation">|</div>', '<div class="breadcrumbs">|</div>', '<div class="sidebar-left">|</div>', '<div class="related-posts">|</div>',
    '<div class="share-buttons">|</div>', '<div class="widget">|</div>', '<div id="comments">|</div>', '<section class="comment-list">|</section>', '<div class="cookie-consent">|</div>', '<div class="newsletter">|</div>',
    '<div class="notice">|</div>', '<div class="modal">|</div>', '<div class="site-footer">|</div>', '<div class="search-form">|</div>', '<div class="login">|</div>',
)
AROUND = (
    "<body><p><!--+-->{L}<!--/--></p>|<p><!--+-->{S}</p><p>{L}<!--/--></p></body>",
    "<body><article><!--+--><h1>{T}</h1><p>{L}</p><!--/-->|<!--+--><p>{L}</p><!--/--></article></body>",
    '<body>|<div class="content"><!--+--><h1>{T}</h1><p>{S}</p><p>{L}</p><!--/--></div></body>',
)


def filled(template: str, rng: random.Random) -> str:
    """A page with made-up words for the marks."""
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice("..?!")
    make = {"L": lambda: " ".join(sentence(6, 18) for _ in range(rng.randint(2, 6))), "S": lambda: sentence(4, 14), "T": lambda: words(2, 8).capitalize(), "N": lambda: words(1, 3).capitalize(), "W": word}
    return re.sub(r"\{([LSTNW])\}", lambda m: make[m[1]](), template)


def pages() -> list[str]:
    """Every template a few times over; always the same pages."""
    rng = random.Random(20)
    marked = []
    for wrapper in WRAPPERS:
        for around in AROUND:
            if not (wrapper.startswith("<header>") and "article" in around):  # an article's own header is content
                marked += [around.replace("|", wrapper.replace("|", text)) for text in ("<p>{L}</p>", "{S}", "<p>{S}</p><p>{N}</p>", "<ul><li>{N}</li><li>{T}</li></ul>")]
    marked.append("<body><article><header><!--+--><h1>{T}</h1><p>{S}</p></header><p>{L}</p><!--/--></article></body>")
    return [filled(t, rng) for t in TEMPLATES for _ in range(VARIANTS)] + [filled(t, rng) for t in marked]
