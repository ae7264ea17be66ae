"""Main content of pages without an article element: hand-made pages, and the run by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from newscorpus.functions import density
from newscorpus.operators import cleaning, extraction

PARAGRAPHS = [
    "The council met on Monday to decide about the bridge, which has been closed since spring.",
    "Engineers told the members that two of its pillars had moved; a repair would take a year.",
    "\"We cannot wait that long,\" the mayor said. A temporary crossing is to open in June.",
    "Shops on the north bank report losses, and many residents now travel by boat.",
]
MENU = "".join(f'<div class="m"><a href="/{w}">{w}</a></div>' for w in ("Home", "Politics", "World", "Sports", "Contact us"))
TEASERS = "".join(
    f'<div class="t"><a href="/{i}"><div>Another headline about something that happened, number {i}</div><img src="x"></a>'
    f"<div>A short teaser of it.</div></div>" for i in range(6)
)
FOOT = '<div>Copyright 2026 by us, all rights reserved.</div><div><a href="/i">Imprint</a> <a href="/p">Privacy</a></div>'


def body(parts, tag="div"):
    return "".join(f"<{tag}>{p}</{tag}>" for p in parts)


PAGES = {
    "plain divs": (f"<div><div>{MENU}</div></div><div><div><h1>Bridge closed</h1>{body(PARAGRAPHS)}</div></div><div>{TEASERS}</div><div>{FOOT}</div>", ["Bridge closed", *PARAGRAPHS]),
    "unclosed paragraphs": (f"<div>{MENU}</div><div><h2>Bridge closed</h2><p>" + "<p>".join(PARAGRAPHS) + f"</div><div>{TEASERS}</div>", ["Bridge closed", *PARAGRAPHS]),
    "subheading and link inside": (
        f"<div>{MENU}</div><div>{body(PARAGRAPHS[:2])}<h3>What now</h3><div>The <a href='/x'>city hall</a> keeps silent about the costs so far, and nobody asks.</div>{body(PARAGRAPHS[2:])}</div><div>{TEASERS}{FOOT}</div>",
        [*PARAGRAPHS[:2], "What now", "The city hall keeps silent about the costs so far, and nobody asks.", *PARAGRAPHS[2:]],
    ),
    "teasers first": (f"<div>{TEASERS}</div><div><div><h1><a href='/'>The Daily</a></h1></div><div><h1>Bridge closed</h1>{body(PARAGRAPHS)}</div></div>", ["Bridge closed", *PARAGRAPHS]),
    "Gujarati": (
        f"<div>{MENU}</div><div><div>સરકારે આજે નવી યોજના જાહેર કરી છે, જેનાથી ખેડૂતોને લાભ થશે એમ મંત્રીએ કહ્યું હતું.</div><div>આ યોજના આગામી મહિનાથી લાગુ થશે; તેની વિગતો ટૂંક સમયમાં આપવામાં આવશે।</div></div><div>{TEASERS}</div>",
        ["સરકારે આજે નવી યોજના જાહેર કરી છે, જેનાથી ખેડૂતોને લાભ થશે એમ મંત્રીએ કહ્યું હતું.", "આ યોજના આગામી મહિનાથી લાગુ થશે; તેની વિગતો ટૂંક સમયમાં આપવામાં આવશે।"],
    ),
    "links only": (f"<div>{MENU}</div>", []),
    "unclosed link": (f"<div><a href='/x'>Home</div><div>{body(PARAGRAPHS)}</div>", PARAGRAPHS),
    "article element": (f"<div>{body(PARAGRAPHS)}</div><article><h1>T</h1><p>{PARAGRAPHS[0]}</p><div>{TEASERS}</div></article>", ["T", PARAGRAPHS[0]]),
    "nothing": ("", []),
    "control characters": (f"<div>\u0003\u0004{PARAGRAPHS[0]}\u0004</div>", [PARAGRAPHS[0]]),
}


def frame(spark, pages):
    return spark.createDataFrame([(k, h, "b", 1) for k, h in pages], "name string, html string, run string, score int")


def test_hand_made_pages(spark):
    runs = extraction.main_run(frame(spark, [(k, h) for k, (h, _) in PAGES.items()])).collect()
    got = {r["name"]: [b["text"] for b in r["blocks"]] for r in runs}
    assert got == {k: want for k, (_, want) in PAGES.items()}
    right = sum(len(set(got[k]) & set(w)) for k, (_, w) in PAGES.items())
    assert right == sum(map(len, got.values())) == sum(len(w) for _, w in PAGES.values())  # precision and recall are 1


def test_tags_keep_what_density_drops(spark):
    df = frame(spark, [("p", PAGES["plain divs"][0]), ("none", None)])
    by = {m: {r["name"]: r for r in cleaning.clean_corpus(df, words=["###"], content=m).collect()} for m in ("tags", "density")}
    assert "Imprint" in by["tags"]["p"]["body"] and "Another headline" in by["tags"]["p"]["body"]
    lines = ["<h2>Bridge closed</h2>", *(f"<p>{p}</p>" for p in PARAGRAPHS)]
    assert by["density"]["p"]["body"] == "\n".join(lines) and by["density"]["p"]["n_raw"] == 5
    assert by["density"]["none"]["n_blocks"] is None or by["density"]["none"]["n_blocks"] <= 0
    with pytest.raises(ValueError):
        cleaning.clean_corpus(df, content="magic")


def brute(blocks, level):
    """(score, first, last) over all runs that begin and end with a block of text."""
    with_text = [i for i, b in enumerate(blocks) if b[0]]
    best = (0, None, None)
    for y in range(len(with_text)):
        for x in range(y, -1, -1):
            total = sum(blocks[i][2] for i in with_text[x : y + 1])
            for a, b in zip(with_text[x:y], with_text[x + 1 : y + 1]):
                total -= level * abs(sum(blocks[i][1] for i in range(a + 1, b + 1)))
            if total > best[0]:
                best = (total, with_text[x], with_text[y])
    return best


def test_runs_by_brute_force(spark):
    draw = random.Random(8)
    cases = []
    for _ in range(150):
        cases.append([(draw.random() < 0.7, draw.choice([-1, 0, 0, 1]), draw.randint(-6, 8)) for _ in range(draw.randint(0, 14))])
    rows = [(n, [(i, "x" if t else "", s, v if t else 0) for i, (t, s, v) in enumerate(c)]) for n, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, blocks array<struct<pos:bigint,text:string,step:bigint,score:bigint>>")
    weights = density.Weights(level=2)
    for r in df.select("n", density.best_run(F.col("blocks"), weights).alias("run")).collect():
        assert tuple(r["run"]) == brute(cases[r["n"]], 2), cases[r["n"]]


def test_features_of_a_block(spark):
    html = "<div>One, two. <a href='/a'>three</a></div><a href='/b'><div>four</div><p>five</a> six!</p>"
    blocks = extraction.score_blocks(frame(spark, [("x", html)])).first()["blocks"]
    got = [(b["tag"], b["text"], b["n_chars"], b["link_chars"], b["n_marks"], b["score"]) for b in blocks if b["text"]]
    assert got == [
        ("div", "One, two. three", 15, 6, 2, 9 + 20 - 18 - 40),
        ("div", "four", 4, 4, 0, -12 - 40),
        ("p", "five six!", 9, 5, 1, 4 + 10 - 15 - 40),
    ]
    assert [b["step"] for b in blocks] == [0, 1, -1, 1, -1, 0, 0]


def test_one_pass_without_shuffle(spark, capsys):
    extraction.main_run(frame(spark, [("x", "<p>a</p>")])).where("run_score > 3").explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and plan.count("Generate") == 1
