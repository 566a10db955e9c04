"""Extraction from pages written by hand after common kinds of sites, none of which the training pages are made like."""

from collections import Counter

import pytest

from stackloom.llm import extract

PAGES = {
    "weblog": (
        """<!DOCTYPE html><html lang="en"><head><title>Sourdough at altitude - Crumb Notes</title><style>p{margin:0}</style></head><body class="single">
<div id="page"><header id="masthead"><a href="/" rel="home">Crumb Notes</a><p class="site-description">Baking above two thousand metres</p>
<nav id="site-navigation"><ul><li><a href="/about">About</a></li><li><a href="/recipes">Recipes</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
<div id="content"><article id="post-412" class="hentry"><header class="entry-header"><h1 class="entry-title">Sourdough at altitude</h1></header>
<div class="entry-content"><p>My first loaf up here rose in half the time and then fell flat in the oven.</p><p>Air pressure is lower, so gas expands more, and the dough dries out faster than the recipe expects.</p>
<h2>What I changed</h2><ul><li>A fifth less starter.</li><li>Three more spoons of water.</li><li>A cold proof overnight.</li></ul>
<p>The crumb is still more open than I would like, but it stands up.</p></div></article>
<div id="comments"><h2>3 thoughts on this post</h2><ol><li class="comment"><p>Same here, I gave up on rye entirely.</p></li><li class="comment"><p>Try a lidded pot for the first twenty minutes!</p></li></ol></div></div>
<div id="secondary" class="widget-area"><section class="widget"><h3>Recent Posts</h3><ul><li><a href="/a">Bagels</a></li><li><a href="/b">Flour from the mill</a></li></ul></section></div>
<footer id="colophon"><div class="site-info">Proudly hosted on a small machine</div></footer></div></body></html>""",
        "Sourdough at altitude My first loaf up here rose in half the time and then fell flat in the oven. Air pressure is lower, so gas expands more, and the dough dries out faster than the recipe expects. What I changed A fifth less starter. Three more spoons of water. A cold proof overnight. The crumb is still more open than I would like, but it stands up.",
    ),
    "encyclopedia": (
        """<html><head><title>Lesser kestrel</title></head><body><div id="mw-navigation"><h2>Navigation</h2><div role="navigation"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li></ul></div></div>
<main id="content" role="main"><h1 id="firstHeading">Lesser kestrel</h1><div id="bodyContent"><p>The <b>lesser kestrel</b> is a small <a href="/f">falcon</a> that breeds from the <a href="/m">Mediterranean</a> across to <a href="/c">Mongolia</a>.<sup><a href="#1">[1]</a></sup></p>
<h2>Diet</h2><p>It takes <a href="/i">insects</a>, which it catches on the ground or in the air, and now and then a small <a href="/l">lizard</a>.</p>
<table><tr><td>Length</td><td>29 to 32 cm</td></tr><tr><td>Wingspan</td><td>63 to 72 cm</td></tr></table><p>Colonies may hold more than a hundred pairs.</p></div></main>
<footer><ul><li>This page was last changed in May.</li><li><a href="/p">Privacy policy</a></li><li><a href="/d">Disclaimers</a></li></ul></footer></body></html>""",
        "Lesser kestrel The lesser kestrel is a small falcon that breeds from the Mediterranean across to Mongolia.[1] Diet It takes insects, which it catches on the ground or in the air, and now and then a small lizard. Length 29 to 32 cm Wingspan 63 to 72 cm Colonies may hold more than a hundred pairs.",
    ),
    "news with utility classes": (
        """<html><body><div class="css-1q2w3e"><div class="css-9zx"><a href="/world">World</a><a href="/money">Money</a><a href="/sport">Sport</a></div>
<div class="css-77a"><h1 class="css-h">Harbour bridge closes for a week</h1><p class="css-p">Drivers face long detours from Monday as crews replace two of the bridge's expansion joints.</p>
<div class="css-ad"><span>Advertisement</span></div><p class="css-p">The work was put off twice, the port authority said, because the parts did not arrive in time.</p>
<p class="css-p">"We would rather close once and do it properly," its director told reporters on Friday.</p><p class="css-p">Ferries will run every ten minutes until the bridge opens again.</p></div>
<div class="css-more"><h4>More on this story</h4><a href="/1">Port strike ends</a><a href="/2">Toll to rise in spring</a></div>
<div class="css-foot"><span>© Harbour Daily</span><a href="/t">Terms</a><a href="/c">Cookies</a></div></div></body></html>""",
        "Harbour bridge closes for a week Drivers face long detours from Monday as crews replace two of the bridge's expansion joints. The work was put off twice, the port authority said, because the parts did not arrive in time. \"We would rather close once and do it properly,\" its director told reporters on Friday. Ferries will run every ten minutes until the bridge opens again.",
    ),
    "old table layout": (
        """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><FONT SIZE=5>The Narrow Gauge Society</FONT></TD></TR><TR><TD WIDTH=120><A HREF=i.html>Home</A><BR><A HREF=e.html>Engines</A><BR><A HREF=l.html>Links</A></TD>
<TD><H2>Engine No. 7</H2><P>Built in 1903, the engine hauled slate down the valley for almost forty years.<P>It was sold for scrap in 1946, but the yard went broke before anyone cut it up.<P>Our members found it under a collapsed shed and have been at work on it since.</TD></TR></TABLE>
<CENTER><FONT SIZE=1>Page kept by the webmaster. You are visitor 00412.</FONT></CENTER></BODY></HTML>""",
        "Engine No. 7 Built in 1903, the engine hauled slate down the valley for almost forty years. It was sold for scrap in 1946, but the yard went broke before anyone cut it up. Our members found it under a collapsed shed and have been at work on it since.",
    ),
    "manual": (
        """<html><body><div class="wy-nav-side"><div class="wy-menu"><p class="caption">Contents</p><ul><li><a href="q.html">Quick start</a></li><li><a href="i.html">Installation</a></li><li><a href="a.html">Interface</a></li></ul></div></div>
<section class="wy-nav-content-wrap"><div role="navigation"><ul class="wy-breadcrumbs"><li><a href="/">Docs</a></li><li>Retries</li></ul></div><div role="main" class="document"><div class="section"><h1>Retries</h1>
<p>A client tries a request again when the server closes the connection before it answers.</p><pre>client = Client(retries=3, wait=0.5)</pre><p>The wait doubles with each attempt, up to one minute.</p>
<div class="admonition warning"><p>Requests that change data are tried once only.</p></div></div></div><footer><div class="rst-footer-buttons"><a href="i.html">Previous</a><a href="n.html">Next</a></div><p>Built with a page generator.</p></footer></section></body></html>""",
        "Retries A client tries a request again when the server closes the connection before it answers. client = Client(retries=3, wait=0.5) The wait doubles with each attempt, up to one minute. Requests that change data are tried once only.",
    ),
    "German council": (
        """<html lang="de"><body><a class="skip" href="#i">Zum Inhalt springen</a><div class="kopf"><img alt="Wappen"><ul class="hauptnavigation"><li><a href="/r">Rathaus</a></li><li><a href="/b">Bürger</a></li></ul></div>
<div id="inhalt"><h1>Sperrmüll im Herbst</h1><p>Die Abholung beginnt am ersten Oktober und dauert drei Wochen.</p><p>Bitte stellen Sie die Möbel erst am Abend vorher an die Straße, damit die Gehwege frei bleiben.</p>
<h2>Was nicht mitgenommen wird</h2><ul><li>Farben und Lacke</li><li>Autoreifen</li><li>Bauschutt</li></ul></div>
<div class="fuss"><a href="/i">Impressum</a> <a href="/d">Datenschutz</a></div></body></html>""",
        "Sperrmüll im Herbst Die Abholung beginnt am ersten Oktober und dauert drei Wochen. Bitte stellen Sie die Möbel erst am Abend vorher an die Straße, damit die Gehwege frei bleiben. Was nicht mitgenommen wird Farben und Lacke Autoreifen Bauschutt",
    ),
    "Chinese story": (
        """<html><body><div class="top-bar"><a href="/">首页</a><a href="/n">新闻</a></div><div class="article-box"><h1>老茶馆重新开门</h1><p>上个月，关了三年的老茶馆又在街角开门了。</p><p>老板说，桌椅都是从前的，只有水壶换成了新的。</p><p>每天早上，客人从城里各处赶来，坐下就不愿意走。</p></div>
<div class="recommend-list"><h3>相关阅读</h3><ul><li><a href="/1">城南旧书店</a></li><li><a href="/2">河边的早市</a></li></ul></div><div class="footer-wrap"><p>版权所有</p></div></body></html>""",
        "老茶馆重新开门 上个月，关了三年的老茶馆又在街角开门了。 老板说，桌椅都是从前的，只有水壶换成了新的。 每天早上，客人从城里各处赶来，坐下就不愿意走。",
    ),
    "shop guide with consent box": (
        """<html><body><div id="onetrust-banner" class="cookieConsent" role="dialog"><p>We value your privacy. We and our partners store data on your device.</p><button>Accept all</button></div>
<div class="nav-wrapper"><form action="/s"><input placeholder="Search"><button>Go</button></form><ul><li><a href="/t">Tents</a></li><li><a href="/b">Boots</a></li></ul></div>
<main><div class="guide-intro"><h1>How to choose a tent</h1><p>Start with how many people sleep in it, then add room for the bags.</p></div><div class="row"><div class="col-8"><h2>Weight</h2><p>If you carry it all day, every hundred grams counts, and a single wall may be enough.</p><h2>Weather</h2><p>For snow, look for poles that cross more than once.</p></div><div class="col-4"><div class="newsletter-box"><h3>Get ten percent off</h3><form><label>E-mail</label><input><button>Sign up</button></form></div></div></div></main>
<footer class="shop-footer"><p>Free returns within thirty days.</p><ul><li><a href="/h">Help</a></li></ul></footer></body></html>""",
        "How to choose a tent Start with how many people sleep in it, then add room for the bags. Weight If you carry it all day, every hundred grams counts, and a single wall may be enough. Weather For snow, look for poles that cross more than once.",
    ),
}


def f1(got: str, want: str) -> float:
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * (a & b).total() / (a.total() + b.total())


def scores() -> dict[str, float]:
    field = extract.default_field()
    return {name: f1(field.main_text(html), want) for name, (html, want) in PAGES.items()}


def test_pages_of_other_makes():
    found = scores()
    assert sum(found.values()) / len(found) >= 0.85, found


@pytest.mark.parametrize("html", ["<div>" * 400 + "<article><p>One line of text stands in here.</p></article>" + "</div>" * 400 + "<footer>&copy; x</footer>"])
def test_depth_changes_nothing(html):
    """End tags close their own elements however deep they are."""
    text, foot = extract.leaf_blocks(html)
    assert text[1][-2:] == (("article", frozenset()), ("p", frozenset())) and foot[1] == (("footer", frozenset()),)
