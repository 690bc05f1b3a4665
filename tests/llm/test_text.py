"""Main text of pages, languages and chat windows."""

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import chat
from corpusloom.llm import html_extract as hx
from corpusloom.llm import language_id as li

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body>
<header><a href="/">Site</a> tagline</header><nav><ul><li><a href="a">One</a><li><a href="b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, please accept all of them now.</p></div><div id="ad-1">Buy this</div>
<main><article class="post has-sidebar"><h1>Head &amp; line</h1><p>First <b>bold
 words</b>&nbsp;here.<br>and on<p>Second &#233;t&eacute; with <a href="x">a link</a>.<table><tr><td>cell one<td>cell two</table>
<aside>side</aside><form><p>Subscribe to it</p></form></article><section class="comments"><p>Great post, I liked every part of it.</p></section></main>
<div class="sidebar"><p>Other things to read in the bar.</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert hx.main_text(PAGE) == "Head & line\nFirst bold words here. and on\nSecond été with a link.\ncell one\ncell two"


def test_main_text_without_article():
    text = "A sentence that belongs to the story and goes on for a while. "
    page = f"<body><ul>{'<li><a href=x>link text</a>' * 20}</ul><div><div><p>{text * 3}</p><p>{text * 2}</p></div><div><p>{text}</p><p>{text}</p></div></div></body>"
    assert hx.main_text(page).count("A sentence") == 7 and "link text" not in hx.main_text(page)


def test_main_text_of_several_articles_and_in_a_form():
    story = lambda w: f"<p>{w} is a sentence that belongs to the story and goes on for a while.</p>" * 3
    menu = f"<nav>{'<a href=x>link text</a>' * 20}</nav>"
    several = f"<body>{menu}<div><article>{story('One')}</article><article>{story('Two')}{story('Two')}</article><article>{story('Three')}</article></div></body>"
    beside = f"<body>{menu}<main>{story('One')}{story('Two')}</main><div>{story('Three')}</div></body>"
    for page in (several, beside):
        text = hx.main_text(page)
        assert all(w in text for w in ("One", "Two", "Three")) and "link" not in text
    body = f"{menu}<div><h1>Head</h1>{story('One')}</div>"
    for inner in (body, f"{menu}<article>{story('One')}</article>"):
        text = hx.main_text(f"<body><form id='aspnetForm' action='x'><input type='hidden' value='v'>{inner}</form></body>")
        assert text.count("One is a sentence") == 3 and "link" not in text
    assert "Subscribe" not in hx.main_text(f"<body><div>{story('One')}</div><form><p>Subscribe to it</p></form></body>")


STORY = "is a sentence that belongs to the story and goes on for a while, with a clause or two."
MENU = "<ul>" + "<li><a href=x>link text</a></li>" * 12 + "</ul>"
NOISE = [
    f"<nav>{MENU}</nav>", f"<div class='nav-bar'>{MENU}</div>", "<div id='cookie-notice'><p>We use cookies, please accept all of them.</p></div>",
    "<div class='ad'>Buy this now, it is cheap.</div>", "<aside><h3>More</h3><p>Other things to read in the bar.</p></aside>", "<form action='s'><p>Subscribe to it</p><input></form>",
]
AFTER = ["<div class='comments'><p>Great post, I liked it.</p><p>So did I.</p></div>", "<footer><p>All rights reserved.</p></footer>", "<div class='related-posts'><a href=y>Next story</a></div>"]
LAYOUTS = [
    "<body>{noise}<article>{text}</article>{after}</body>", "<body>{noise}<main><div>{text}</div></main>{after}</body>", "<body>{noise}<div class='layout has-sidebar'><div class='post-body'>{text}</div></div>{after}</body>",
    "<body><div class='content-with-header'>{noise}<div>{text}</div>{after}</div></body>", "<body><form id='aspnetForm'>{noise}<div>{text}</div>{after}</form></body>", "<body>{noise}<table><tr><td>{text}</td></tr></table>{after}</body>",
]


def gold_pages():
    for i in range(36):
        sentences = [f"Part{i}x{k} {STORY}" for k in range(4 + i % 5)]
        kinds = ["", " class='reply'", " class='social-theory'", " class='search-results-explained'", " id='share'"]
        text = f"<h1>Title {i}</h1>" + "".join(f"<p{kinds[k % 5] if i % 2 else ''}>{x}</p>" for k, x in enumerate(sentences))
        yield LAYOUTS[i % 6].format(noise="".join(NOISE[j] for j in range(6) if (i + j) % 3), after="".join(AFTER[: i % 4]), text=text), "\n".join([f"Title {i}", *sentences])


def test_main_text_of_gold_pages():
    for page, want in gold_pages():
        assert hx.main_text(page) == want, page


def test_main_text_of_probe_pages():
    story = lambda w, n=4: f"<p>{w} {STORY}</p>" * n
    text = lambda w, n=4: "\n".join([f"{w} {STORY}"] * n)
    pages = {
        f"<body><div class='layout has-sidebar'>{NOISE[0]}<div>{story('A')}</div></div></body>": text("A"),
        f"<body><div class='content-with-header'><div>{story('A')}</div></div></body>": text("A"),
        f"<body><article>{story('A')}<p class='reply'>One</p><p class='social-theory'>Two</p><p class='search-results-explained'>Three</p></article></body>": text("A") + "\nOne\nTwo\nThree",
        f"<body><article>{story('A')}</article><article>{story('B', 1)}</article></body>": text("A") + "\n" + text("B", 1),
        f"<body><div><h1>Head</h1><div>{story('A')}</div></div></body>": "Head\n" + text("A"),
        f"<body><nav>{MENU}<div>{story('A')}</div></body>": text("A"),
        f"<body><div>{story('A', 2)}</div><div class='comments'>{story('C', 30)}</div></body>": text("A", 2),
        f"<body>{NOISE[0]}<footer><p>Copyright of us.</p></footer></body>": "",
    }
    for page, want in pages.items():
        assert hx.main_text(page) == want, page


def test_deep_pages_take_linear_time():
    began = time.time()
    assert hx.main_text("<b>" * 60_000 + "deep" + "</i>" * 60_000 + "<p>" * 20_000 + "end").endswith("end")
    assert hx.main_text("<div>" * 30_000 + f"<p>{STORY}</p>" * 5).count(STORY) == 5
    assert time.time() - began < 30


def test_main_text_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain words"), (4, "u", "<p>a < b & c"), (5, None, "<div" * 2000), (6, "u", "<p>" + "x" * 200_000), (6, "u", "<p>twice"), (7, "u", "<b>" * 5000 + "deep")]
    got = [(r.page_id, r.text, r.n_chars) for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    texts = [t for _, t, _ in got]
    assert texts[:4] == ["", "", "plain words", "a < b & c"] and len(texts[5]) == 200_000 and texts[6:] == ["twice", "deep"]
    assert all(n == len(t) for _, t, n in got)
    assert hx.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and right / n > 0.97


def brute_grams(text):
    words = "".join(c if c.isalpha() or c.isnumeric() and not c.isdecimal() else " " for c in text.lower())
    padded = " " + " ".join(words.split()) + " "
    found = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
    return Counter(g for g in found if g != " " and not (len(g) == 3 and g[1] == " "))


def brute_rank(counts, size):
    """Ties in order of the gram's number, 21 bits a letter, as for the profiles."""
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return [number(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def test_languages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.collect() if r.text]
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    totals = {}
    for r in rows:
        if not held(r) and r.lang:
            totals.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    size = 120
    profiles = {k: {g: i for i, g in enumerate(brute_rank(c, size))} for k, c in totals.items()}
    got = {r.doc_id: r for r in li.identify(docs, size=size).collect()}
    for r in rows:
        own = brute_rank(brute_grams(r.text), size)
        if own:
            apart = {k: sum(abs(p[g] - i) if g in p else size for i, g in enumerate(own)) for k, p in profiles.items()}
            best = sorted(apart, key=lambda k: (apart[k], k))
            assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (best[0], held(r))
            assert abs(got[r.doc_id].score - (1 - apart[best[0]] / apart[best[1]])) < 1e-9


def test_sample_is_bounded(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 100 == 0, "a").otherwise("b").alias("lang"), F.lit("one text of all").alias("text"))
    assert {r[0]: r[1] for r in li.draw(rows, 100).groupBy("lang").count().collect()} == {"a": 40, "b": 100}


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "123 ²½ !!", "de"), (None, "the thing and the other", None), (-5, "the thing and the other", "en"), (-5, "the thing and the other", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd).withColumn("score", F.lit(9))
    got = [r for r in li.identify(both).collect() if r.doc_id is None or r.doc_id < 0]
    assert sorted(((r.doc_id or 0), r.lang_pred) for r in got) == [(-5, "en"), (-5, "en"), (-3, "und"), (-2, "und"), (-1, "und"), (0, "en")]
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in li.identify(odd.limit(2)).collect()} == {"und"}
    assert li.identify(odd.limit(0)).collect() == []
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_unknown_languages_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    unknown = ["Съешь ещё этих мягких французских булок, да выпей чаю", "我们的语言模型不认识这种文字", "xqzj kwvx zzqp jjxw qqkz vwxj", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar"]
    text = docs.where("lang = 'de'").first().text
    planted = spark.createDataFrame([*((-1 - i, t, None) for i, t in enumerate(unknown)), (-50, text, None)], "doc_id long, text string, lang string")
    kept = li.keep_identified(docs.union(planted))
    assert kept.where("doc_id >= 0").count() == docs.count()
    assert [(r.doc_id, r.lang) for r in kept.where("doc_id < 0").collect()] == [(-50, "de")]


def digests(turns):
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b \\\\ <|im_end|>\n<|im_start|>user", "<<SYS>>", "", "\\", "<|im_<|im_end|>end|>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", nasty[i % len(nasty)]) for i in range(12)]
    rows += [(2, 0, "system", "be kind"), *[(2, i, "assistant" if i % 3 else "user", "word " * (i % 90)) for i in range(1, 700)]]
    rows += [(3, 5, "a\nb", "x"), (3, 5, None, None), (3, None, "assistant", "first"), (None, 1, "assistant", "lost"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tokens": F.lit("x"), "place": F.lit(1)})
    windows = chat.format_conversations(turns, budget=256, history=64)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(windows).collect()}
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((r or "", x or ""))
    assert got == {c: digests(t) for c, t in groups.items()}
    kept = [r for r in windows.collect() if r.conv_id == 2]
    assert len(kept) > 30 and all(r.tokens <= 256 for r in kept)
    assert sorted(r.window for r in kept) == list(range(len(kept)))
    assert all("<|im_start|>system\nbe kind<|im_end|>" in r.formatted for r in kept) and any(r.context_turns > 1 for r in kept)
    assert chat.digest(chat.format_conversations(turns.limit(0))).collect() == []


def brute_windows(turns, budget, history, sizes):
    """Windows of one conversation: (context turns, new turns), by the rules of the module."""
    slices = {}
    for t in turns:
        slices.setdefault(t[0] // chat.SLICE, []).append(t)
    lead = turns[0] if turns[0][1] == "system" else None
    system = sizes[lead[2]] if lead else 0
    room = max(budget - history - system, history)
    out, past = [], []
    for _, own in sorted(slices.items()):
        found, small, bigs = {}, 0, 0
        for t in own:
            size = sizes[t[2]]
            if t is lead:
                key = (0, 0)
            elif size > history:
                key, bigs = (2 * bigs + 1, 0), bigs + 1
            else:
                key, small = (2 * bigs, small // room), small + size
            found.setdefault(key, []).append(t)
        near = [t for t in past if t is not lead]
        for key in sorted(found):
            new = found[key]
            free = min(history, budget - system - sum(sizes[t[2]] for t in new if t is not lead))
            context, used = [], 0
            for t in reversed(near[-chat.HISTORY_TURNS:]):
                used += sizes[t[2]]
                if used > free or new[0] is lead:
                    break
                context.insert(0, t)
            if lead and new[0] is not lead:
                context.insert(0, lead)
            out.append((context, new))
            near += [t for t in new if t is not lead]
        past = own[-chat.HISTORY_TURNS:]
    return out


def test_chat_windows_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    rows = []
    for c, n in enumerate([1, 2, 9, 127, 128, 129, 300, 700]):
        for lead in (0, 1):
            rows += [(2 * c + lead, i, "system" if lead and i == 0 else ("user", "assistant")[i % 2], "word " * int(draw.choice([1, 9, 40, 90])) + str(i)) for i in range(n)]
    rows += [(99, 50 * i, "assistant", f"far {i}") for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    count = chat._tokenizer(chat.default_tokenizer())
    texts = sorted({r[3] for r in rows})
    sizes = dict(zip(texts, [len(ids) + chat.TURN_COST for ids in count.encode(texts)], strict=True))
    read = chat.format_conversations(turns, budget=256, history=64).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {}
    for r in sorted(read.collect(), key=lambda r: (r.conv_id, r.window)):
        told = [(t.role, t.text) for t in r.turns]
        loss = [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss]
        assert loss == [x for role, x in told[r.context_turns :] if role == "assistant"] and len(told) == r.context_turns + r.n_turns
        assert r.tokens == sum(sizes[x] for _, x in told)
        got.setdefault(r.conv_id, []).append((r.window, told[: r.context_turns], told[r.context_turns :]))
    for c in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == c]
        expected = [(i, [t[1:] for t in context], [t[1:] for t in new]) for i, (context, new) in enumerate(brute_windows(own, 256, 64, sizes))]
        assert got[c] == expected, c
