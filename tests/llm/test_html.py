"""What an article is made of, and pages that are nested or cut in odd ways."""

import time

from claimloom.llm import wrappers


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(wrappers.extract(df).collect(), key=lambda r: r.page_id)]


def test_headings_that_all_articles_have(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>Cake {i}</h1><h2>Ingredients</h2><p>{i} eggs, flour and {i} spoons</p><h2>Method</h2><p>Stir {i} times and bake.</p></article><footer>All rights</footer></body>"
    got = texts(spark, [(f"http://r.org/{i}", page.format(i=i)) for i in range(6)])
    assert got == [f"Cake {i} Ingredients {i} eggs, flour and {i} spoons Method Stir {i} times and bake." for i in range(6)]


def test_regions_and_classes(spark):
    pages = [
        "<main><p>real</p></main><article>teaser</article>",
        "<main><h1>list</h1><article><p>inner</p></article></main><article>teaser</article>",
        '<article><p>Lunch</p><div class="menu-item">Soup of the day</div><ul class="menu-item"><li>Home</li></ul></article>',
        '<article><p>one</p><p class="advert">Buy now</p><h2 class="share">share this</h2><p>two</p></article>',
        '<article><p class="advert">Buy <div>three</div></p>four</article>',
        "<article><div class='comments'><p>first!</p></div><p>five</article>six",
        "<main></main><article>seven</article>",
    ]
    got = texts(spark, [(f"http://{i}.org/", p) for i, p in enumerate(pages)])
    assert got == ["real", "inner", "Lunch Soup of the day", "one two", "three four", "five", "seven"]


def test_deep_and_unclosed_markup():
    began = time.time()
    deep = "<div><p>x" * 50_000
    assert wrappers.text_of(deep, wrappers.stream(deep), set(), set()) == " ".join(["x"] * 50_000)
    closing = "<div>y</section></p>" * 20_000
    assert wrappers.text_of(closing, [], set(), set()) == " ".join(["y"] * 20_000)
    assert time.time() - began < 30
