"""Fingerprints, language, line and set operators, pages: against plain versions and on odd rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import boilerplate, crf, iblt, line_dedup, set_join

ODD = [None, "", " \n\t ", "one", "12 34 !!", "a" * 3000, "same words here\nsame words here"]


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# Fingerprints


def likeness(a, b):
    x, y = Counter(iblt.PIECE.findall(a)), Counter(iblt.PIECE.findall(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, 400)).replace("w7 ", ". ") for _ in range(20)] + ODD + ["x. " * 500, "y.\n" * 2000]
    texts += texts[:2]
    df = spark.createDataFrame([(k * 7, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in iblt.fingerprint(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, nxt = t or "", texts[(k + 1) % len(texts)] or ""
        r, changed = got[k * 7], iblt.edited(t, nxt)
        assert r["n_chars"] == len(t)
        assert r["near_edited"] == pytest.approx(likeness(t, changed)) and r["near_next"] == pytest.approx(likeness(t, nxt))
    assert got[0]["fingerprint"] == got[7 * (len(texts) - 2)]["fingerprint"]
    assert iblt.fingerprint(df.limit(0)).count() == 0
    alone = iblt.fingerprint(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_every_character_counts(spark):
    pairs = ["???", "", "a\nb", "a\n\n\nb", "x", "x.", "\n", "y" * 500 + "!", "y" * 500]
    assert ["".join(iblt.PIECE.findall(t)) for t in pairs] == pairs
    df = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    assert all(r["near_next"] < 1 for r in iblt.fingerprint(df).collect() if r["doc_id"] % 2 == 0 and r["doc_id"] < 8)


def test_peeling_recovers_both_sides():
    a, b = ["x. y. z.", "x. q. z. r."], None
    made, ends = iblt.digests(a)
    owner, key, side = iblt.differences(made, ends, np.array([0]), np.array([1]), cells=6)
    assert sorted(side.tolist()) == [-1, -1, 1]
    assert set(key[side == 1].tolist()) == set(made[ends[0] : ends[1]].tolist()) - set(made[ends[1] : ends[2]].tolist())
    assert b is None


# Language


def naive(scores, moves):
    n, k = scores.shape
    e, a = np.exp(scores - scores.max(1, keepdims=True)), np.exp(moves - moves.max())
    f, x = [], np.full(k, 1 / k)
    for t in range(n):
        x = (x @ a) * e[t]
        x /= x.sum()
        f.append(x)
    y, out = np.ones(k), [None] * n
    for t in range(n - 1, -1, -1):
        out[t] = f[t] * y / (f[t] * y).sum()
        y = (e[t] * y) @ a.T
        y /= y.sum()
    return np.array(out)


def test_forward_backward_in_blocks():
    rng = np.random.default_rng(0)
    sizes = [1, 5, 64, 65, 130, 700]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    scores, moves = rng.normal(0, 2, (sum(sizes), 3)), rng.normal(0, 1, (3, 3))
    got = crf.forward_backward(scores, owner, moves)
    for k in range(len(sizes)):
        assert np.allclose(got[owner == k], naive(scores[owner == k], moves))


def test_expected_moves():
    """Against all label sequences, and the gradient they give against differences."""
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(0, 1, (5, 2)), rng.normal(0, 1, (2, 2))

    def weigh(path, m):
        return np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(m[a, b] for a, b in itertools.pairwise(path)))

    # The chain starts from equal odds and one move, which only scales the first word.
    first = np.log(np.exp(moves).mean(axis=0))

    def total(m):
        return sum(weigh(p, m) * np.exp(first[p[0]]) for p in itertools.product(range(2), repeat=5))

    _, got = crf.forward_backward(np.r_[scores, scores], np.repeat([0, 1], 5), moves, pairs=True)
    want = np.zeros((2, 2))
    for p in itertools.product(range(2), repeat=5):
        for a, b in itertools.pairwise(p):
            want[a, b] += weigh(p, moves) * np.exp(first[p[0]]) / total(moves)
    assert np.allclose(got, 2 * want)
    for a, b in itertools.product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        assert np.isclose((np.log(total(moves + step)) - np.log(total(moves - step))) / 2e-5, want[a, b], atol=1e-6)
    long_scores = rng.normal(0, 1, (200, 3))
    _, one = crf.forward_backward(long_scores, np.zeros(200, int), np.eye(3), pairs=True)
    _, other = crf.forward_backward(long_scores, np.zeros(200, int), np.eye(3), block=7, pairs=True)
    assert np.allclose(one, other) and np.isclose(one.sum(), 199)


SYLLABLES = {"aa": ["ka", "ti", "mo", "ke"], "bb": ["str", "ung", "ach", "ber"], "cc": ["eau", "oi", "ment", "que"]}


def made_text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(4)
    rows = [(k, made_text(rng, lang, 60), lang) for k, lang in enumerate(list(SYLLABLES) * 30)]
    rows += [(1000 + k, t, None) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'clash' AS score", "1 AS words")
    model = crf.fit(df.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in crf.predict(df, model).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows if k < 1000)
    for k in (1000, 1001, 1002, 1004):
        assert (got[k]["lang_pred"], got[k]["score"]) == (crf.UNKNOWN, 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    mixed = crf.label_words(model, made_text(rng, "aa", 12) + " " + made_text(rng, "bb", 12))
    said = [x[1] for x in mixed]
    assert said[:10].count("aa") >= 9 and said[-10:].count("bb") >= 9
    nothing = crf.fit(df.where("lang IS NULL"))
    assert {r["lang_pred"] for r in crf.predict(df, nothing).collect()} == {crf.UNKNOWN}
    kept = crf.accept(df, model)
    assert kept.columns == df.columns and kept.where("doc_id < 1000").count() == 90


# Lines


def close(a, b):
    if a == b:
        return True
    n, m = len(a), len(b)
    if n == m:
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(n - m) != 1:
        return False
    long, short = (a, b) if n > m else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def deduped(rows):
    seen, out = [], []
    for doc_id, text in rows:
        for number, line in enumerate((text or "").split("\n") if text is not None else []):
            w = re.findall(r"[^\t-\r ]+", line)
            if w:
                seen.append(((doc_id, number), w))
    first = {}
    for at, w in seen:
        key = tuple(w)
        first[key] = min(first.get(key, at), at)
    gone = {at for at, w in seen if at > first[tuple(w)]}
    longer = [(at, list(w)) for w, at in first.items() if len(w) >= line_dedup.MIN_WORDS]
    gone |= {a for (a, x), (b, y) in itertools.product(longer, longer) if b < a and close(x, y)}
    for doc_id, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (doc_id, k) not in gone)
        out.append((doc_id, kept, sum(1 for d, _ in gone if d == doc_id)))
    return out


def edits(rng, w):
    w, kind = list(w), rng.randrange(4)
    k = rng.randrange(len(w))
    if kind == 0:
        w[k] = "new"
    elif kind == 1:
        del w[k]
    elif kind == 2:
        w.insert(k, "new")
    else:
        w[0], w[-1] = "two", "edits"
    return w


def test_lines(spark):
    rng = random.Random(8)
    bases = [words(rng, n, 40) for n in (8, 8, 9, 12, 20, 300, 700)] + [["the"] * 10]
    rows = []
    for k in range(40):
        lines = [" ".join(words(rng, rng.randint(1, 12), 60)) for _ in range(3)]
        lines += [" ".join(edits(rng, rng.choice(bases))), "  ".join(rng.choice(bases)), "", "tail"]
        rng.shuffle(lines)
        rows.append((k * 2, "\n".join(lines)))
    rows += [(1000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "x", -7, [1]) for r in rows], "doc_id long, text string, key string, n_lines int, __drops array<int>")
    same = line_dedup.dedup(df, "a", "b")
    assert same.columns == [*df.columns, "a", "b"] and same.where("n_lines <> -7 OR key <> 'x'").count() == 0
    got = sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.dedup(df).collect())
    assert got == sorted(deduped(rows))
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_lines_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b\nc d"), (1, "a b\nc d"), (2, "c d")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup(df).collect())
    assert got == [(-1, "a b"), (1, "c d"), (1, "c d"), (2, "")]


def deduped_rows(rows):
    """As `deduped`, row by row: for ids that several rows share."""
    low = float("-inf")
    lines = [((low if i is None else i, n), tuple(re.findall(r"[^\t-\r ]+", line))) for i, t in rows if t is not None for n, line in enumerate(t.split("\n"))]
    first = {}
    for at, w in lines:
        if w:
            first[w] = min(first.get(w, at), at)
    longer = [(at, w) for w, at in first.items() if len(w) >= line_dedup.MIN_WORDS]
    near = {(a, x) for (a, x), (b, y) in itertools.product(longer, longer) if b < a and close(list(x), list(y))}
    out = []
    for i, t in rows:
        kept = []
        for n, line in enumerate(t.split("\n") if t is not None else []):
            at, w = (low if i is None else i, n), tuple(re.findall(r"[^\t-\r ]+", line))
            if not w or (at == first[w] and (at, w) not in near):
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept), (t.count("\n") + 1 if t is not None else 0) - len(kept)))
    return out


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    df = spark.createDataFrame([(7, "x one\nfoo unique A"), (7, "y two\nx one"), (None, "p\nq"), (None, "r\np"), (None, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup(df).collect())
    assert got == Counter([(7, "x one\nfoo unique A"), (7, "y two"), (None, "p\nq"), (None, "r"), (None, None)])
    rng = random.Random(4)
    bases = [words(rng, n, 40) for n in (8, 9, 12, 20)]
    rows = []
    for _ in range(60):
        lines = [" ".join(words(rng, rng.randint(0, 3), 9)) for _ in range(rng.randint(0, 3))]
        lines += [" ".join(edits(rng, rng.choice(bases))) for _ in range(rng.randint(0, 3))] + ["  ".join(rng.choice(bases))]
        rng.shuffle(lines)
        rows.append((rng.choice([None, 1, 2, 3, rng.randint(4, 30)]), "\n".join(lines)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, number string")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "number", "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()) == Counter(deduped_rows(rows))


# Sets


def linked(rows, width, per_cent):
    table = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
        sets[doc_id] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= per_cent * len(x | y):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return sorted((k, len(s), find(k)) for k, s in sets.items())


@pytest.mark.parametrize("width,per_cent", [(4, 85), (5, 80)])
def test_shingle_sets(spark, width, per_cent):
    rng = random.Random(width)
    bases, passage = [words(rng, n, 400) for n in (6, 30, 80, 150)], words(rng, 60, 400)
    rows = []
    for k in range(150):
        w = list(rng.choice(bases)) if k % 3 else words(rng, rng.randint(1, 120), 400)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["NEW", "new", f"v{k}"])
        rows.append((k * 5, " ".join(w if k % 4 else w + passage)))
    rows += [(2000 + k, t) for k, t in enumerate(ODD)] + [(3000, rows[0][1]), (3001, "one"), (3002, "ONE")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.near_components(df, width, per_cent).collect())
    assert got == linked(rows, width, per_cent)


def test_shingle_sets_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in set_join.near_components(df).collect()}
    assert got == {(None, None), (1, 1), (2, 1)}
    assert set_join.near_components(df.limit(0)).count() == 0


def test_shingle_sets_of_an_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(200)), " ".join(f"b{k}" for k in range(200))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " end"), (9, "x y z x y z")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in set_join.near_components(df).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (9, 9)}
    near = b.replace("b3 ", "c3 ")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, near), (12, a + " more"), (12, None), (None, a)], "doc_id long, text string")
    rows = [(r["doc_id"], r["component_id"]) for r in set_join.near_components(df).collect()]
    assert len(rows) == 7 and set(rows) == {(3, 3), (5, 3), (9, 3), (12, 3), (None, None)}


# Pages


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("<p>", ""),
    ("<nav><a href=1>Home</a></nav><article><h1>A &amp; B</h1><p>Some \n text<br>here</p></article><footer>&copy; x</footer>", "A & B\nSome text here"),
    ("<article><p>One</p><div class='sidebar'><p>" + "side " * 40 + "</p></div><p>Two</p></article>", "One\nTwo"),
    ("<article><p>Body.</p><section id=comments><p>" + "I agree with it. " * 9 + "</p></section></article>", "Body."),
    ("<article><p>x</p><script>var a='</p><p>no</p>';</script><!-- <p>no</p> --><p>y <b>z", "x\ny z"),
    ("<article><form><p>Your name</p><input></form><p>Text</p></article>", "Text"),
    ('<article><p title="a>b">in</p></article>', "in"),
    ("<div><p>" + "long text without any links in it " * 4 + "</p></div><div><a href=1>x</a> <a href=2>y</a></div>", ("long text without any links in it " * 4).strip()),
])
def test_main_text(html, text):
    assert boilerplate.main_text(html, boilerplate.labelled_tree()) == text


@pytest.mark.parametrize("html,text", [
    ("<html><head><title>t</title><meta charset=utf-8><script>if (a<b) '<p>'</script><body><article><p>In.</p></article>", "In."),
    ("<head><title>t</title><link rel=x><article><p>In.</p></article>", "In."),
    ("<head><style>p{}</style></head><body><article><p>In.</p></article>", "In."),
    ("<article class='post has-sidebar'><p>One.</p></article>", "One."),
    ("<main class=with-header role=main><p>One.</p><div class=sidebar><p>no</p></div></main>", "One."),
    ("<article><p>See <span class='notice'>a <span>b</span> c</span> the <a class='related' href=1>text</a> <img class=social>here.</p></article>", "See the text here."),
    ("<article><p><span class=notice>open <b>x</b></p><p>Next.</p></article>", "Next."),
    ("<article><p>One.</p><span class=ad>Buy this now</span><hr class=social>Two.</article>", "One.\nTwo."),
])
def test_nothing_else_is_left_out(html, text):
    assert boilerplate.main_text(html, boilerplate.labelled_tree()) == text


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "clash"), (None, None, None, None), (1, "u", "<article><p>é</p></article>", "clash")],
                               "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in boilerplate.extract(df).collect()))
    assert got == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert boilerplate.extract(df.limit(0)).count() == 0
    assert boilerplate.main_text("<" * 5000 + "p '" * 2000, boilerplate.labelled_tree()) is not None


P = "plain prose of an article that goes on for a good number of words and has no link in it at all, as prose does. "
BARE = [  # blocks in plain divs, without any telling tag, and whether they are main text
    ("<a href=1>Start</a>", 0), ("<a href=1>About us</a>", 0), ("<a href=1>All products</a>", 0), ("<a href=1>Sign in</a>", 0), ("Find it all here", 0),
    ("A short head", 1), (P * 3, 1), (P * 2, 1), (P + "<a href=1>one link</a> " + P, 1), (P * 4, 1), ("Another head", 1), (P, 1), (P * 2, 1),
    ("<a href=2>a linked line</a>", 1), (P * 3, 1), (P, 1), ("It ends so.", 1), (P * 2, 1),
    ("<a href=1>Next story about things</a>", 0), ("<a href=1>Most read today</a>", 0), ("<a href=1>A third one to read</a>", 0),
    ("<a href=1>Terms</a>", 0), ("<a href=1>Imprint</a>", 0), ("Made with care", 0),
]
MARKED = [  # blocks of an article, and whether they are main text
    ("<h1>Title</h1>", 1), ("<p>Short.</p>", 1), (f"<p>{P}</p>", 1), (f"<p class=share>{P * 3}</p>", 1), ("<p class=share>Send this to friends</p>", 0),
    ("<h2><a href=1>A linked head</a></h2>", 1), (f"<p>{P * 2}</p>", 1), ("<p><a href=3>A whole paragraph that is one link to the source</a></p>", 1), (f"<p>{P}</p>", 1),
    ("<ul><li><a href=1>Story one</a></li>", 0), ("<li><a href=1>Story two</a></li>", 0), ("<li><a href=1>Story three</a></li></ul>", 0),
    ("<p>A word.</p>", 1), ("<p>Eight words stand here before a link comes.</p>", 1), ("<p><a href=3>The link itself is here</a></p>", 1),
    ("<p>Some more words.</p>", 1), (f"<p>{P * 5}</p>", 1), (f"<div class=comments><p>{P * 3}</p>", 0), ("<p>Me too</p></div>", 0), (f"<p class=comment>{P * 3}</p>", 0),
    ("<p>And so it ends.</p>", 1), (f"<p>{P}</p>", 1), ("<h3>Part</h3>", 1), ("<p>1</p>", 1), ("<p>Two words</p>", 1), (f"<p><b>{P}</b></p>", 1),
    (f"<aside><p>{P * 2}</p></aside>", 0), (f"<p>{P}</p>", 1), ("<p>Last.</p>", 1),
]


L = "plain prose that goes on for some words and has no link at all " * 5
WRAPPED = [  # page, text: what a page part's name can't take away, and what it does take
    (f"<div class='layout has-sidebar'><article><p>{L}</p></article></div>", [L]),
    (f"<div id='content-sidebar-wrap'><main><p>One.</p><p>{L}</p></main></div>", ["One.", L]),
    ("<form id='aspnetForm'><nav><a href=1>Home</a></nav><article><p>One.</p><p>Two.</p></article><input></form>", ["One.", "Two."]),
    (f"<form><div><p>{L}</p><p>{L}</p></div><input type=hidden></form>", [L, L]),
    (f"<div class='page sidebar'><main><h1>A</h1><p>{L}</p></main></div>", ["A", L]),
    (f"<div class=header-fixed><div><article><p>{L}</p></article></div></div>", [L]),
    (f"<article><p>a b</p><section class='ad-hoc-analysis'><p>{L}</p></section><p>c</p></article>", ["a b", L, "c"]),
    (f"<article><div class='market-share'><p>{L}</p></div><blockquote class='notice'>{L}</blockquote></article>", [L, L]),
    ("just text &amp; more", ["just text & more"]),
    ("<p>Roses are red</p><p>Violets are blue</p>", ["Roses are red", "Violets are blue"]),
    ("<ul><li>one</li><li>two</li></ul>", ["one", "two"]),
    (f"<article><p>{L}</p></article><div id='discussion'><p>{L}</p></div>", [L]),
    (f"<article><p>{L}</p><div class='comments-wrapper'><article class=comment><p>{L}</p></article></div></article>", [L]),
    (f"<article><section id='discussion'><h2>Discussion</h2><p>{L}</p></section></article>", ["Discussion", L]),
    (f"<div class=sidebar><article><p>{L}</p></article></div><article><p>Main.</p><p>{L}</p></article>", ["Main.", L]),
    (f"<article><p>T</p><div class='ad'><p>{L}</p></div><div class=cookie-consent><p>We use cookies. Accept them.</p></div></article>", ["T"]),
    (f"<article><form><p>Your name and the address, please, in this field here, thank you all</p><input><input></form><p>{L}</p></article>", [L]),
    (f"<aside><p>{L}</p></aside><article><p>x</p><aside><p>{L}</p></aside></article><footer><p>{L}</p></footer>", ["x"]),
    ("<nav><a href=1>Home</a> <a href=2>Us</a></nav>", []),
]


@pytest.mark.parametrize("html,text", WRAPPED)
def test_content_overrules_names(html, text):
    assert boilerplate.main_text(html, boilerplate.labelled_tree()) == "\n".join(x.strip() for x in text)


def test_blocks_by_words_and_links():
    """Labelled by hand: tags alone don't tell these."""
    tree = boilerplate.labelled_tree()
    for blocks, page in ((BARE, "".join(f"<div>{x}</div>" for x, _ in BARE)), (MARKED, "<article>" + "".join(x for x, _ in MARKED) + "</article>")):
        want = [" ".join(re.sub("<[^>]*>", "", x).split()) for x, main in blocks if main]
        assert boilerplate.main_text(page, tree).split("\n") == want
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(boilerplate.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert {"words", "links", "links_before", "links_after"} <= used


def test_very_long_page():
    page = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    assert len(boilerplate.main_text(page, boilerplate.labelled_tree()).split("\n")) == 20_000
