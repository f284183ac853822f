"""Names of article parts, small hosts, and simple tree matching against its recursive definition."""

import random
from functools import lru_cache

import pytest

from gleanery.llm import extraction as E

KEPT = [
    '<h2 id="social-impact">{}</h2>', '<h2 id="navigation">{}</h2>', '<section id="search-algorithms"><p>{}</p></section>', '<div class="copyright-law"><p>{}</p></div>', '<div class="ad-hoc-networks">{}</div>',
    '<pre class="search">{}</pre>', '<table class="related-work"><tr><td>{}</td></tr></table>', '<p class="response-body">{}</p>', '<p id="comments">{}</p>', '<section id="notice"><p>{}</p></section>', '<p>{}</p>',
]
DROPPED = [
    '<div class="ad">{}</div>', '<div class="ad-slot wide">{}</div>', '<ul class="share-buttons"><li>{}</li></ul>', '<section class="comments-area" id="comments"><p>{}</p></section>', '<div class="related-posts"><a href="/x">{}</a></div>',
    '<div id="newsletter"><p>{}</p></div>', '<div class="notice">{}</div>', '<nav>{}</nav>', '<div class="breadcrumbs">{}</div>', '<div class="cookie-banner">{}</div>',
]


@pytest.mark.parametrize("top", ["article", "main"])
def test_blocks_of_an_article_do_not_go_by_their_names(top):
    pages, wanted = [], []
    for k in range(6):
        rng = random.Random(k)
        say = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) for _ in range(12))  # noqa: E731, B023
        parts = [(t, say(), True) for t in KEPT] + [(t, say(), False) for t in DROPPED]
        rng.shuffle(parts)
        pages.append(f"<html><body><div class=top>Same menu</div><{top}>" + "".join(t.format(x) for t, x, _ in parts) + f"</{top}><div>Same footer</div></body></html>")
        wanted.append("\n".join(x for _, x, keep in parts if keep))
    assert E.extract_block(pages) == wanted
    assert [E.extract_block([p])[0] for p in pages] == wanted


@pytest.mark.parametrize("n", [2, 3, 4, 7])
def test_menus_and_footers_of_hosts_with_few_pages_go(n):
    pages = [f"<html><body><div>Home | News | Shop</div><div><h1>Title {k}</h1><p>{'text of page ' * 9}{k}</p></div><div>(c) 2020 host</div></body></html>" for k in range(n)]
    assert E.extract_block(pages) == [f"Title {k}\n{'text of page ' * 9}{k}" for k in range(n)]


def test_a_long_passage_that_two_pages_share_stays():
    passage = "a passage that both quote " * 6
    pages = [f"<html><body><article><h1>T{k}</h1><p>{passage}</p><p>own {k} words</p></article></body></html>" for k in range(2)]
    assert E.extract_block(pages) == [f"T{k}\n{passage.strip()}\nown {k} words" for k in range(2)]


def test_matched_is_the_best_order_preserving_matching():
    def brute(a, b, w):
        @lru_cache(None)
        def best(i, j):
            if i == len(a) or j == len(b):
                return 0
            return max(best(i + 1, j), best(i, j + 1), w[i] + best(i + 1, j + 1) if a[i] == b[j] else 0)

        return best(0, 0)

    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        w = {x: rng.randrange(1, 5) for x in "xyz"}
        got = E.matched(a, b, [w[x] for x in a], [w[x] for x in b])
        assert all(a[p] == b[q] for p, q in got) and got == sorted(got) and len({p for p, _ in got}) == len({q for _, q in got}) == len(got)
        assert all(p < r and q < t for (p, q), (r, t) in zip(got, got[1:]))
        assert sum(w[a[p]] for p, _ in got) == brute(a, b, [w[x] for x in a])
