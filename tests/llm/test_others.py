"""HTML extraction, chat formatting, nearest neighbours, suffix arrays."""

import hashlib
import random

import duckdb
import numpy as np

from fauntrack.llm import chat, html_extract, nearest, quality, suffix_array


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a>one</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
    <div id=sidebar><p>Side text that is long enough, with commas, to look like a paragraph of its own.</p></div>
    <article><h1>Head &amp; line</h1><p><b>First   paragraph,<br>with a break &lt;here&gt;<p>Second &eacute; one, with <a href=x>a link</a> inside.</p>
    <aside>Not this</aside><ul><li>Item one</li><li>Item two</li></ul><form><input><button>Send</button></form></article>
    <section class=comments><p>Great article, thanks, I liked it, all of it.</p></section><footer>&copy; me</footer></body></html>"""
    assert html_extract.extract(page) == "Head & line\nFirst paragraph, with a break <here>\nSecond é one, with a link inside.\nItem one\nItem two"


def test_page_without_article_and_awkward_pages():
    p = "Words of a paragraph, with commas, that go on for a while so that they score. " * 3
    page = f"<body><div class=menu><a>x</a></div><div class=content><h2>Title</h2><p>{p}</p><p>{p}</p></div><div class=footer>end</div>"
    assert html_extract.extract(page) == f"Title\n{p.strip()}\n{p.strip()}"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("just text < with signs") == "just text < with signs"
    for bad in ("<", "<p", "<!--", "</", "<a href='", "<script>", "<p><b><i>" * 3000 + "deep", "</div>" * 100 + "x"):
        html_extract.extract(bad)


def test_pages_query(spark, sf_dir):
    d = html_extract.op1_html_extraction(spark, sf_dir)
    assert d.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert d.where("n_chars <> length(text)").count() == 0


def test_chat_round_trip():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choices(["\\", "###", "### ", "</turn>", " </turn>\n", "\n", "a", ":", "<"], k=rng.randint(0, 10)))
        role = "".join(rng.choices(["\\", "#", ":", ": ", "user", "###"], k=rng.randint(0, 4)))
        f, start, end = chat.render(role, text)
        assert chat.read_turn(f) == (role, text, len(f)) and (start == end or chat.unescape(f[start:end]) == text)


def test_chat_folds_events(spark):
    ev = [(1, 0, None, "message", "user", "hi"), (1, 1, None, None, "assistant", "a"), (1, 2, 1, "delta", None, "b"), (1, 4, 1, "edit", None, "X"), (1, 5, 1, "delta", None, "Y"), (1, 6, 1, "regenerate", None, None), (1, 7, 1, "delta", None, "Z"), (1, 3, None, "message", "user", None), (2, 9, 8, "delta", "assistant", "late"), (None, None, None, None, None, None)]
    rows = chat.format_chats(spark.createDataFrame(ev, "conv_id long, seq long, target long, kind string, role string, text string")).collect()
    turns = {}
    for r in rows:
        turns.setdefault(r["conv_id"], []).append(chat.read_turn(r["formatted"])[:2])
    assert turns == {1: [("user", "hi"), ("assistant", "Z"), ("user", "")], 2: [("assistant", "late")], None: [("", "")]}


def test_chat_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in chat.op4_chat_formatting(spark, sf_dir).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(chat.OP4_SQL).df()
    assert len(got) == len(want)
    for w in want.itertuples():
        assert tuple(getattr(w, k) for k in want.columns) == tuple(got[w.conv_id][k] for k in want.columns)
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_sha256"] == hashlib.sha256(chat.CONTRACT_TEXT.encode()).hexdigest()


def test_quality_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(quality.OP9_SQL).df().sort_values("doc_id")
    got = quality.op9_quality_rules(spark, sf_dir).toPandas().sort_values("doc_id")
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 64))
    x[600:640] = x[3]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 64), (1040, [float("nan")] * 64), (1060, [1.0] * 3), (None, [1.0] * 64)]
    r = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    lists = {q: p.sort_values("rank") for q, p in r.groupby("query_id")}
    assert sorted(lists) == list(range(0, 700, 20))
    hit = 0
    for q, p in lists.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -s))[:20]
        hit += len(set(best) & set(p["vec_id"]))
        assert p["rank"].tolist() == list(range(1, 21)) and np.allclose(p["score"], x[p["vec_id"]] @ x[q])
    assert hit / (20 * len(lists)) >= 0.95
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert nearest.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")).count() == 1


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60))
        a = suffix_array.suffix_array(t)
        assert a.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        p = suffix_array.common_prefixes(t, a, 10, int(rng.integers(1, 5)))
        for i, j in zip(a[1:], a[:-1], strict=True):
            n = 0
            while n < 10 and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            assert p[i] == n
