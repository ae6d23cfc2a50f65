"""Extraction from pages that are put together of parts: what is the article's is known, whatever stands between."""

import html
import random

import pytest

from tramline.llm import html_extract

PAGES = "page_id long, url string, html string"
#: What may stand anywhere, in an article too, and isn't its text.
OTHERS = [
    "<div class='comments-wrapper'><p>{}</p></div>", "<div class=user-comment>{}</div>", "<div id=respond><h3>Reply</h3>{}</div>", "<div class='comment-body'><p>{}</p></div>", "<div class=advert-box>{}</div>",
    "<div class='ad-slot'>{}</div>", "<div class=newsletter><p>{}</p></div>", "<div class=cookie-message>{}</div>", "<div class=promo>{}</div>", "<div class='sponsored-content'><p>{}</p></div>", "<div class=share><a href=/>{}</a></div>",
    "<div class=related><ul><li><a href=/x>{}</a></ul></div>", "<ol class=commentlist><li class=comment><p>{}</p></ol>", "<h3 class=comments-title>{}</h3>", "<section class='reader-comments'><article><p>{}</p></article></section>",
    "<aside>{}</aside>", "<form><p>{}</p></form>", "<nav><a href=/>{}</a></nav>", "<script>'{}'</script>", "<style>.x{{}}/* {} */</style>", "<!-- {} -->", "<div class=adBox>{}</div>", "<ul id=comments><li>{}</ul>", "<p class='ad sponsor'>{}</p>",
]
#: Parts of an article that names might be taken for others.
OWN = [
    "<section id=related-work><p>{}</p></section>", "<h2 id=comments>{}</h2>", "<section id=sharing><p>{}</p></section>", "<p class=text-warning>{}</p>", "<p class=lead>{}</p>", "<blockquote>{}</blockquote>", "<p class='notice'>{}</p>",
    "<div class=advantages><p>{}</p></div>", "<div class='commented-code'><pre>{}</pre></div>", "<p hidden>{}</p>", "<div class=shared-memory>{}</div>", "<p id=share>{}</p>", "<table><tr><td>{}</table>", "<ul><li>{}</ul>", "<p><span class=share>{}</span></p>",
]
TEMPLATES = [
    "<header><h1>Site</h1></header><article>{}</article><footer>f</footer>",
    "<div class=menu><a href=/>m</a></div><main>{}</main><div class=sidebar>s</div>",
    "<div id=top-nav>n</div><div class=content>{}</div><div class='left-sidebar'>s</div>",
    "<div class=wrapper><div class='post-{k} entry'>{}</div></div><div id=footer>f</div>",
    "<div class=page><section class=text>{}</section></div>",
]


@pytest.mark.parametrize("seed", range(len(TEMPLATES)))
def test_articles_of_templates(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for k in range(40):
        parts, own = [], []
        for n in range(rng.randint(3, 9)):
            text = " ".join(rng.choice(["word", "longer", "é", "a & b", "x < y", "text"]) for _ in range(rng.randint(12, 40))) + f" {n}"
            if n > 2 and rng.random() < 0.5:
                parts.append(rng.choice(OTHERS).format(html.escape(text[: rng.randint(5, 60)], quote=False)))
            else:
                parts.append(rng.choice(OWN if n > 1 else ["<p>{}</p>"]).format(html.escape(text, quote=False)))
                own.append(text)
        rows.append((k, f"http://h{seed}.com/{k}", "<html><head><title>t</title></head><body>" + TEMPLATES[seed].replace("{k}", str(k)).format("\n".join(parts)) + "</body></html>"))
        want[k] = "\n".join(own)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


@pytest.mark.parametrize("other", OTHERS)
def test_what_is_no_part_of_an_article(other):
    inner = "<p>" + "words of the article " * 9 + "</p>" + other.format("gone") + "<p>last</p>"
    for outer in ("<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"):
        assert html_extract.Page(outer.format(inner)).text(None) == ("words of the article " * 9).strip() + "\nlast"


@pytest.mark.parametrize("own", OWN)
def test_what_is_part_of_an_article(own):
    inner = "<p>" + "words of the article " * 9 + "</p>" + own.format("kept") + "<p>last</p>"
    for outer in ("<article>{}</article>", "<main>{}</main>"):
        assert html_extract.Page(outer.format(inner)).text(None) == ("words of the article " * 9).strip() + "\nkept\nlast"
