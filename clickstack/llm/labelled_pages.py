"""Labelled pages for fitting the weights of the HTML extractor.

Own examples of common page layouts. The content region of each lies between ``{{`` and ``}}``, which
are not part of the page.
"""

PAGES = [
    """<!DOCTYPE html><html><head><title>Rivers</title><style>p{margin:0}</style><script>var a=1;</script></head>
<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>
<div class="ad">Buy two boats now.</div><article>{{<h1>Rivers of the north</h1><p>The longest of the rivers rises in the
hills and crosses three plains before it meets the sea.</p><p>Its <b>upper course</b> is narrow.<br>Boats go no further
than the old mill, where the water falls by nine metres.</p><p>In spring the meadows flood.</p>}}</article>
<footer>&copy; 2020 Rivers &middot; <a href="/i">Imprint</a></footer></body></html>""",
    """<html><head><meta charset="utf-8"><title>Bread</title></head><body><header><a href="/">Kitchen</a><form action="/s">
<input name="q"><button>Search</button></form></header><main>{{<h1>Bread at home</h1><p>Mix flour, water, salt and a little
yeast and let the dough rest over night.</p><h2>Baking</h2><p>Heat the oven well before you shape the loaf. A stone helps
to keep the heat.</p><ul><li>Bake it covered for half an hour</li><li>Bake it open until the crust is dark</li></ul><p>Let the
loaf cool before you cut it.</p>}}</main><aside><h3>More</h3><ul><li><a href="/r1">Rolls</a></li><li><a href="/r2">Cakes</a>
</li></ul></aside><section id="comments"><p>Nice one!</p><p>Mine came out flat.</p></section>
<footer><p>All rights reserved</p></footer></body></html>""",
    """<html><body><div id="menu"><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div><div class="content">{{
<h1>The lamp</h1><p>A lamp stood in the window of the last house, and nobody in the village could say who lit it when
evening came.</p><p>One winter a traveller asked for a bed there. <i>Come in</i>, said a voice, and the door stood open.</p>
<blockquote>Who keeps a light keeps a road.</blockquote><p>So the story goes.</p>}}</div><div class="sidebar"><h4>Popular</h4>
<a href="/x">The well</a><a href="/y">The bell</a></div><div class="cookie-notice">We use cookies. <button>Fine</button></div>
</body></html>""",
    """<html><head><title>Results</title><script>track();</script></head><body><nav><a href="/">Start</a></nav><article>{{
<h1>Results of the count</h1><p>All forty districts have been counted twice and the figures agree with one another.</p>
<table><tr><th>District</th><th>Votes</th></tr><tr><td>North</td><td>812</td></tr><tr><td>South</td><td>790</td></tr></table>
<p>The council will meet on the first day of the month to confirm them.</p>}}</article><div class="share"><a href="#">Share</a>
<a href="#">Print</a></div><ul class="related"><li><a href="/o">Older counts</a></li></ul><footer><p>Contact us</p></footer>
</body></html>""",
]
