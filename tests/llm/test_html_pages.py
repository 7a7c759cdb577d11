"""Pages written by hand, apart from the training table; elements that nobody ends."""

from __future__ import annotations

import pytest

from lumenforge.llm import html_extract as H

#: data-y labels an element and what is below it: 1 content, 0 not. The model doesn't read it.
PAGES = [
    """<!doctype html><html><head><title>Sourdough basics</title><script>ga('send');</script></head><body data-y="1">
<div class="site-header" data-y="0"><span class="logo">Crumb &amp; Crust</span><div class="nav-wrap"><a href="/">Home</a> <a href="/recipes">Recipes</a> <a href="/about">About us</a></div></div>
<div class="wrap"><div class="entry"><h1>Sourdough basics</h1><p class="meta" data-y="0">Posted by Ruth on March 3, 2019</p>
<p>A starter is nothing more than flour, water and time. Feed it daily and keep it at room temperature.</p>
<p>After five days it should double within six hours. If it does not, give it two more days before you bake.</p>
<h2>What you need</h2><ul><li>500 g strong flour</li><li>350 g water</li><li>100 g active starter</li><li>10 g salt</li></ul>
<p>Mix everything but the salt and let it rest for an hour.</p></div>
<div class="cmts" data-y="0"><h3>4 comments</h3><div><strong>Paul</strong> says: <p>Mine smells like nail polish, is that fine?</p><a href="#">Reply</a></div><div><strong>Ruth</strong> says: <p>It is hungry, feed it twice a day.</p><a href="#">Reply</a></div></div></div>
<div class="site-foot" data-y="0">&copy; 2019 Crumb &amp; Crust &middot; <a href="/privacy">Privacy</a></div></body></html>""",
    """<html><body bgcolor=white data-y=1><table border=0 width=760 data-y=1><tr data-y=0><td colspan=2 bgcolor=navy><font color=white><b>The Kite Flyers' Page</b></font></td></tr><tr><td valign=top data-y=0><a href=index.html>Home</a><br><a href=kites.html>My kites</a><br><a href=links.html>Links</a><br><a href=guest.html>Guestbook</a></td><td valign=top data-y=1><h2>Choosing a line</h2><p>Braided polyester stretches less than nylon, so you feel the kite better. For a small delta a line of forty pounds is plenty.<p>In strong wind wear gloves. I learned that the hard way on the beach at Ouddorp, when a gust took the reel out of my hands.<p>Always check the knots before you launch.</td></tr><tr data-y=0><td colspan=2 align=center><small>Last updated 12 June 2001. Mail the webmaster</small></td></tr></table></body></html>""",
    """<html lang=de><body data-y=1><header data-y=0><a href="/">Lokalblatt</a><nav><a href="/sport">Sport</a><a href="/kultur">Kultur</a><a href="/wetter">Wetter</a></nav></header><main><h1>Brücke über die Leine wird saniert</h1><p>Die Stadt beginnt im April mit der Sanierung der alten Brücke. Die Arbeiten dauern voraussichtlich acht Monate, der Verkehr wird umgeleitet.</p><p>Nach Angaben der Verwaltung kostet das Vorhaben 2,4 Millionen Euro. Das Land übernimmt davon die Hälfte.</p><div class="anz" data-y=0>Anzeige</div><p>Anwohner befürchten vor allem Lärm. Eine Versammlung findet am Dienstag im Rathaus statt.</p></main><div class="teaser-box" data-y=0><h3>Auch interessant</h3><a href=1>Neuer Spielplatz eröffnet</a><a href=2>Markt zieht um</a></div><footer data-y=0><a href=i>Impressum</a> <a href=d>Datenschutz</a></footer></body></html>""",
    """<html><body data-y=1><div id="app"><div class="css-9x1" data-y=0><p>We value your privacy. We and our partners store cookies on your device.</p><button>Accept all</button></div><div class="css-2k3" data-y=0><a href=/>Daily Ledger</a><a href=/w>World</a><a href=/b>Business</a><a href=/t>Tech</a></div><div class="css-7aa"><h1>Port strike enters its second week</h1><div class="css-1b1" data-y=0>By Maria Keller, 14 May 2021</div><div class="css-p0"><p>Container ships are waiting off the coast as dock workers refuse to return to their posts.</p><p>The union demands a pay rise of six percent. The port authority has offered three, and a bonus.</p><p>Economists warn that shops could run short of imported goods by the end of the month.</p></div></div><div class="css-4rr" data-y=0><h4>Related</h4><ul><li><a href=1>Rail freight at record high</a></li><li><a href=2>Why shipping costs tripled</a></li></ul></div><div class="css-88c" data-y=0><div>Subscribe to our newsletter</div><form><input type=email><input type=submit></form></div></div></body></html>""",
    """<html lang=fr><body data-y=1><ul class="m" data-y=0><li><a href="/">Accueil</a><li><a href="/blog">Blog</a><li><a href="/contact">Contact</a></ul><article><h2>Une semaine en Auvergne</h2><p>Nous sommes partis de Clermont par un matin gris. Le train était presque vide, et la campagne défilait sous une pluie fine.<p>Le lendemain, nous avons gravi le puy de Dôme à pied. Du sommet, on voit toute la chaîne des volcans.<blockquote>Il faut y aller au printemps, quand les jonquilles couvrent les prés.</blockquote><p>Pour dormir, les gîtes ne manquent pas.</article><div data-y=0><h3>Commentaires</h3><div><b>Lucie</b><p>Merci pour ce beau récit !</p></div><div><b>Jean</b><p>Quel gîte avez-vous choisi ?</p></div></div></body></html>""",
    """<html><body data-y=1><div class="navheader" data-y=0><a href="ch02.html">Prev</a> <a href="index.html">Up</a> <a href="ch04.html">Next</a></div><div class="chapter"><h1>Chapter 3. Configuration</h1><p>The daemon reads its settings from a single file. Every line holds a key and a value, separated by white space.</p><pre>listen 8080
root /srv/www</pre><p>Unknown keys are ignored, but a warning is written to the log.</p><table><tr><th>Key</th><th>Default</th></tr><tr><td>listen</td><td>80</td></tr><tr><td>root</td><td>/var/www</td></tr></table><p>Changes take effect after a restart.</p></div><div class="navfooter" data-y=0><a href="ch02.html">Prev</a> <a href="index.html">Home</a> <a href="ch04.html">Next</a></div></body></html>""",
    """<html><body data-y=1><div class=hd data-y=0>Gardeners' Forum &raquo; <a href=v>Vegetables</a></div><div class=topic><h1>Tomatoes splitting on the vine</h1><div class=first><p>Since the heavy rain last week nearly all of my tomatoes have split. They were almost ripe and looked perfect before.</p><p>I water them every evening and mulch with straw. Is there anything I can do to save the rest?</p></div></div><div class=posts data-y=0><h2>Replies</h2><div><p>Pick them a little early and let them ripen indoors.</p><span>mossy, 2 days ago</span></div><div><p>Uneven watering does it. Less in the evening, more in the morning.</p><span>oldspade, 1 day ago</span></div></div><div class=ft data-y=0><a href=r>Rules</a> <a href=c>Contact</a></div></body></html>""",
    """<html><body data-y=1><p>My father kept bees. Every summer, when the lime trees were in flower, we drove the hives to the edge of the wood.</p><p>I was afraid of them until I was nine. Then he gave me a veil and showed me how to move slowly.</p><p>The honey from those years was pale and tasted faintly of mint.</p></body></html>""",
    """<html><body data-y=1><header data-y=0><h1>Ana's notebook</h1><p>Thoughts on maps and trains</p></header><section><h2>Night trains are back</h2><p>Ten years after the last sleeper left this station, a new company has taken up the route. I booked the first night.</p><p>The beds are narrow, but the windows open, and at five in the morning there is coffee.</p></section><aside data-y=0><h3>About me</h3><p>I draw maps for a living.</p></aside><footer data-y=0><a href=/rss>RSS</a> <a href=/archive>Archive</a></footer></body></html>""",
    """<html lang=es><body data-y=1><div id=cab data-y=0><a href=/>Portada</a> <a href=/cine>Cine</a> <a href=/libros>Libros</a></div><div id=nota><h1>La librería que no cierra</h1><p>Desde 1952, la pequeña tienda de la calle Mayor abre todos los días del año. Su dueña, Carmen, tiene ya ochenta años.</p><p>Dice que nunca ha pensado en jubilarse. Los clientes vienen por los libros y se quedan por la conversación.</p></div><div id=op data-y=0><h4>3 comentarios</h4><p>Pedro: ¡Qué gran historia!</p><p>Luz: Voy cada semana.</p></div><div id=pie data-y=0>Aviso legal. Todos los derechos reservados.</div></body></html>""",
]


def block_accuracy():
    """(share of blocks decided rightly, of their characters), and what went wrong."""
    m, right, total, chars, of, wrong = H.trained(), 0, 0, 0, 0, []
    for k, page in enumerate(PAGES):
        nodes, blocks = H.parse(page)
        y, odds = H.labels(nodes), m.content(nodes)
        for i, t in blocks:
            ok = (odds[i] >= 0) == (y[i] == 1)
            right, total, chars, of = right + ok, total + 1, chars + ok * len(t), of + len(t)
            if not ok:
                wrong.append((k, y[i], t))
    return right / total, chars / of, wrong


def test_blocks_of_pages_by_another_hand():
    blocks, chars, _ = block_accuracy()
    assert blocks >= 0.93 and chars >= 0.97  # 0.953 and 0.988 when written


def text_of(page):
    return " ".join(t for _, t in H.parse(page)[1])


@pytest.mark.parametrize("tag", sorted(H.HIDDEN | H.RAW))
def test_unended_elements_end_at_the_next_block(tag):
    for page in (f"<body><{tag}>Go<article><h1>One</h1><p>two.</article>", f"<html><head><title>x</title><{tag}><body><p>One</p><p>two.</p>", f"<div><p><{tag} class='a'>Go</p></div><div>One two.</div>", f"<div><{tag}>Go</div>One two."):
        assert text_of(page).endswith("One two.") or tag in ("head",) and "One two." in text_of(page), (tag, page, text_of(page))


@pytest.mark.parametrize("tag", sorted(H.HIDDEN | H.RAW))
def test_ended_elements_hide_what_they_hold(tag):
    page = f"<body><p>One</p><{tag}><p>hidden <b>here</b></p></{tag}><p>two.</p></body>"
    assert text_of(page) == "One two."
    assert text_of(f"<p>One <{tag}/>two.</p>") == "One two."


def test_head_and_comments():
    assert text_of("<html><head><title>x</title><article><p>One two.</article>") == "One two."
    assert text_of("<head><meta charset=x>One two.") == "One two."
    assert text_of("One<!-- a > b --> two<!-- never ended <p>three</p>") == "One two three"
    assert text_of("One <!--> two <!---> three") == "One two three"
    assert text_of("a < b <3 c <a href='x>y'>d</a> <i title=\"p > q\">e</i> <u title='>f") == "a < b <3 c d e f"
    assert text_of("<ſcript>x</ſcript>İ<script>a</SCRIPT >b<style>c</style\n>d") == "<ſcript>xİbd"


def test_deep_long_and_odd_pages():
    deep = "<div>" * 5000 + "word." + "</div>" * 5000
    assert H.extract(deep, H.trained())[0] == "word."
    long = "<p>" + "many words. " * 200_000 + "</p>"
    assert len(H.extract(long, H.trained())[0]) == 12 * 200_000 - 1
    assert H.extract("<a " * 20_000, H.trained())[0].startswith("<a <a")
    assert H.extract("<script>" * 3000 + "<p>x</p>", H.trained())[0] == "x"
    assert H.extract("", H.trained()) == ("", 0, 0)


#: Pages whose headings are made of menu words, and notices, adverts and boxes without names: what is to be found.
PLAIN = {
    "<body><nav><a href=/>Home</a> <a href=/x>Blog</a></nav><main><h1>About us</h1><h2>Contact</h2><p>Write to us at any time. We answer within a day.</p><h2>Subscribe and privacy</h2><p>We keep what you send for a year. Then it goes.</p></main><footer>&copy; 2020</footer></body>": "About us Contact Write to us at any time. We answer within a day. Subscribe and privacy We keep what you send for a year. Then it goes.",
    "<body><div><p>We value your privacy. This site stores data about your visit.</p></div><div><h1>Lakes</h1><p>The lake lies in a wide valley. It was cold and clear when we came.</p><div>Buy cheap tyres today at Tyre World, free delivery on all orders.</div><p>In spring the ice breaks with a noise like thunder. Nobody sleeps then.</p></div><div><h3>Newsletter</h3><p>Get our newsletter in your inbox every week.</p></div></body>": "Lakes The lake lies in a wide valley. It was cold and clear when we came. In spring the ice breaks with a noise like thunder. Nobody sleeps then.",
    "<body><div class=x1><a href=/>Start</a> <a href=/k>Kontakt</a></div><article><h2>Archiv und Suche</h2><p>Das Archiv wurde 1890 gegründet. Es liegt am Markt.</p><h3>Datenschutz im Archiv</h3><p>Akten werden nach dreißig Jahren geöffnet. Bis dahin bleiben sie zu.</p></article></body>": "Archiv und Suche Das Archiv wurde 1890 gegründet. Es liegt am Markt. Datenschutz im Archiv Akten werden nach dreißig Jahren geöffnet. Bis dahin bleiben sie zu.",
}


def test_headings_of_menu_words_stay_and_nameless_notices_go():
    for page, text in PLAIN.items():
        assert H.extract(page, H.trained())[0] == text
