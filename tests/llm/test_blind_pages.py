"""Ten more pages of other makes, written before any change to the training pages and scored as they were: a blind figure."""

from collections import Counter

from stackloom.llm import extract

PAGES = {
    "press release": (
        """<html><head><title>Harbour bridge reopens</title></head><body><div class="site-top"><img src="l.png" alt="City"><ul class="lang-switch"><li><a href="/de">DE</a></li><li><a href="/fr">FR</a></li></ul></div>
<div class="press-release"><p class="dateline">Northport, 4 May</p><h1>Harbour bridge reopens after two years</h1><p>The harbour bridge reopens to traffic on Monday after two years of work on its bearings.</p>
<p>"We kept one lane open for ambulances throughout," said the city engineer at a short ceremony.</p><p>The work cost eleven million, two less than planned.</p></div>
<div class="contact-box"><h4>Press office</h4><p>Tel. 555 0100</p></div><div id="bottom"><a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></div></body></html>""",
        "Northport, 4 May Harbour bridge reopens after two years The harbour bridge reopens to traffic on Monday after two years of work on its bearings. \"We kept one lane open for ambulances throughout,\" said the city engineer at a short ceremony. The work cost eleven million, two less than planned.",
    ),
    "manual page": (
        """<!doctype html><html><body><nav class="docs-nav"><a href="1.html">Install</a><a href="2.html">Configure</a><a href="3.html">Upgrade</a></nav><main class="docs-main"><h1>Configure the cache</h1>
<p>The cache keeps recent answers on disk. Set its size in the file named below.</p><pre>cache.size = 200</pre><p>Restart the service after a change; a reload is not enough.</p><h2>Limits</h2><p>A size of zero turns the cache off.</p></main>
<footer><p>Version 4.2, built in March</p></footer></body></html>""",
        "Configure the cache The cache keeps recent answers on disk. Set its size in the file named below. cache.size = 200 Restart the service after a change; a reload is not enough. Limits A size of zero turns the cache off.",
    ),
    "forum thread": (
        """<html><body><div class="navbar"><a href="/">Board index</a> <a href="/faq">FAQ</a> <a href="/login">Log in</a></div><h2 class="topic-title">Squeaking rear wheel</h2>
<div class="post first"><div class="author">tomh</div><div class="content"><p>My rear wheel squeaks once per turn, only when I pedal. The hub was greased last month and the brakes do not touch.</p><p>What else can it be?</p></div></div>
<div class="comments"><div class="comment"><div class="author">ann</div><p>Check the spokes where they cross.</p></div><div class="comment"><div class="author">ray</div><p>Mine was the saddle in the end.</p></div></div>
<div class="footer">Powered by a board</div></body></html>""",
        "Squeaking rear wheel My rear wheel squeaks once per turn, only when I pedal. The hub was greased last month and the brakes do not touch. What else can it be?",
    ),
    "recipe": (
        """<html><body><header><a href="/">Kitchen</a><form role="search"><input name="q"><button>Find</button></form></header><section itemprop="recipe"><h1>Leek soup</h1><p>A soup for cold evenings that is done in half an hour.</p>
<ul><li>Four leeks</li><li>Two potatoes</li><li>A litre of stock</li></ul><ol><li>Cut the leeks into rings and wash them well.</li><li>Boil everything for twenty minutes, then blend it.</li></ol></section>
<aside><h3>More soups</h3><ul><li><a href="/p">Pea soup</a></li><li><a href="/o">Onion soup</a></li></ul></aside><footer>Write to us</footer></body></html>""",
        "Leek soup A soup for cold evenings that is done in half an hour. Four leeks Two potatoes A litre of stock Cut the leeks into rings and wash them well. Boil everything for twenty minutes, then blend it.",
    ),
    "university": (
        """<html><body><table width="100%"><tr><td colspan="2"><b>Department of Geology</b></td></tr><tr><td class="menu"><a href="a">Staff</a><br><a href="b">Courses</a><br><a href="c">Library</a></td><td><h2>Field course in the Alps</h2><p>The course takes place every second summer and lasts nine days.</p>
<p>Students map an area of four square kilometres in groups of three and hand in a report by October.</p></td></tr><tr><td colspan="2"><small>Last changed 3 March</small></td></tr></table></body></html>""",
        "Field course in the Alps The course takes place every second summer and lasts nine days. Students map an area of four square kilometres in groups of three and hand in a report by October.",
    ),
    "shop item": (
        """<html><body><div id="cookie-bar">This shop uses cookies. <button>Accept</button></div><div class="breadcrumbs"><a href="/">Home</a> / <a href="/l">Lamps</a></div><div class="product"><h1>Desk lamp Lumen 3</h1><div class="product-description"><p>The arm turns all the way round and stays where you leave it.</p><p>Its light can be set from warm to cold in five steps, and it remembers the last one.</p></div></div>
<div class="related-products"><h3>You may also like</h3><a href="/2">Lumen 2</a><a href="/4">Lumen 4</a></div><div class="newsletter-signup"><p>Ten percent off your first order.</p></div></body></html>""",
        "Desk lamp Lumen 3 The arm turns all the way round and stays where you leave it. Its light can be set from warm to cold in five steps, and it remembers the last one.",
    ),
    "minutes": (
        """<html><body class="wp"><div class="wrap"><div class="col-main"><h1>Minutes of the parish council</h1><p>Present were seven members; two sent apologies.</p><h3>Footpath</h3><p>The council agreed to mend the footpath by the mill before winter. Three offers will be asked for.</p><h3>Trees</h3><p>Two limes on the green are hollow and will be felled in February.</p></div><div class="col-side"><h4>Archive</h4><ul><li><a href="/1">May</a></li><li><a href="/2">April</a></li></ul></div></div><div class="ftr">Site map | Contact</div></body></html>""",
        "Minutes of the parish council Present were seven members; two sent apologies. Footpath The council agreed to mend the footpath by the mill before winter. Three offers will be asked for. Trees Two limes on the green are hollow and will be felled in February.",
    ),
    "question": (
        """<html><body><div id="header"><a href="/">Ask</a> <a href="/tags">Tags</a></div><article class="question"><h1>Why does dough tear when it is rolled?</h1><p>I knead for ten minutes and rest it for an hour, yet it tears at the edges as soon as I roll it thin.</p></article><div class="answers"><article class="answer"><p>It is too dry. Add water until a pressed finger leaves no crack, and let it rest longer, as flour takes up water slowly.</p></article></div><div id="sidebar"><p>Linked</p><a href="/q/2">How thin is thin?</a></div><div class="site-footer"><a href="/legal">Legal</a></div></body></html>""",
        "Why does dough tear when it is rolled? I knead for ten minutes and rest it for an hour, yet it tears at the edges as soon as I roll it thin. It is too dry. Add water until a pressed finger leaves no crack, and let it rest longer, as flour takes up water slowly.",
    ),
    "plain letter": (
        """<html><head><title>Letter</title></head><body><h1>A letter from the lighthouse</h1><p>The wind has not dropped since Tuesday, and the boat with the post turned back twice.</p><p>We have flour for a week. The lamp burns well, and nobody is ill.</p><p>Send word to my sister if you can.</p><hr><p><a href="index.html">Back to the letters</a></p></body></html>""",
        "A letter from the lighthouse The wind has not dropped since Tuesday, and the boat with the post turned back twice. We have flour for a week. The lamp burns well, and nobody is ill. Send word to my sister if you can.",
    ),
    "magazine": (
        """<html><body><div class="ad-slot">Advertisement</div><div class="masthead"><span>The Weekly Rower</span><ul><li><a href="/races">Races</a></li><li><a href="/gear">Gear</a></li></ul></div><div class="story"><h1>Oars of ash</h1><div class="byline">By K. Brandt</div><p>For a century oars were made of ash, which bends before it breaks.</p><figure><img src="o.jpg"><figcaption>An oar from 1910.</figcaption></figure><p>Carbon took its place within ten years, and most of the workshops closed.</p></div><div class="share"><a href="#">Share</a><a href="#">Print</a></div><div class="comments-area"><h3>2 replies</h3><p>My grandfather made these.</p></div><div class="subscribe-box"><p>Get the magazine by post.</p></div></body></html>""",
        "Oars of ash For a century oars were made of ash, which bends before it breaks. An oar from 1910. Carbon took its place within ten years, and most of the workshops closed.",
    ),
}


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    same = sum((a & b).values())
    return 2 * same / max(sum(a.values()) + sum(b.values()), 1)


def test_blind_figure():
    """A floor below what was measured once, so that a change for the worse shows."""
    field = extract.default_field()
    scores = {name: f1(field.main_text(html), want) for name, (html, want) in PAGES.items()}
    assert sum(scores.values()) / len(scores) > 0.6, scores
