"""BPE, HTML, media, language and near duplicates against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from recordspark.llm import bpe, html_extract, langid, media, minhash
from recordspark.llm.queries import QUERIES, tokenizer_path

# BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(library):
    own, rnd = bpe.Bpe(tokenizer_path(), cache_words=50), random.Random(4)
    alphabet = " \n\t  ab'sé1½\u00a0\u3000\x85\x1c.,!日本\u200b٣ⅷ_-🙂"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "x<|endoftext|> y<|endoftext|><|endo", "a" * 3000, "ab" * 700 + " " + "é" * 900, "don't they'll I'd  x ", "\n\n a\n\nb"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_query(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = QUERIES["op3_bpe_round_trip"](spark, data).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(docs, no_docs):
    texts = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    back = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == texts
    assert bpe.round_trip(no_docs, tokenizer_path()).isEmpty() and bpe.encode(no_docs, tokenizer_path()).isEmpty()


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>A slogan</p></header>
<div id="cookie-notice"><p>We use cookies and more cookies.</p></div><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="layout"><div class="sidebar"><p>Side text that is long
enough to look like text of the article itself.</p></div>%s</div><div class="ad-slot">Buy!</div><footer>&copy; Foot</footer><script>var x = "<p>no</p>";</script></body></html>"""
BODY = """<h1>Title &amp; more</h1><p>Hello   <i>wor</i>ld one&nbsp;two.<p>Short.<ul><li>item <b>one</b><li>item two</ul><form><label>Name</label><input></form><div class=advert>buy now</div>
<p>The last paragraph is a fairly long one,<br>in two lines.</p><!-- no --><section id=comments><h2>Comments</h2><article class="comment"><p>I liked it, says a reader at some length.</p></article></section>"""
TEXT = "Title & more\nHello world one two.\nShort.\nitem one\nitem two\nThe last paragraph is a fairly long one, in two lines."


@pytest.mark.parametrize("tag", ["article", "main", "div", "div class=content", "section"])
def test_main_text(tag):
    assert html_extract.main_text(PAGE % f"<{tag}>{BODY}</{tag.split()[0]}>") == TEXT


def test_parts_that_are_left_out():
    for part in ("div class='topNavbar'", "div id=leftsidebar", "ul class='main-menu'", "div role=navigation", "div class='promo box'", "div id='cookieBar'", "div class=notice", "p class=ad", "div hidden", "section class='userComments'", "aside", "form", "div style='display: none'"):
        assert html_extract.main_text(f"<body><article><div class='entry-header'><h1>Title</h1></div><p>Text of it.</p><{part}>Not this.</{part.split()[0]}><p>More.</p></article>") == "Title\nText of it.\nMore.", part


def test_words_of_articles_stay():
    for part in ("div class=warning", "div class='related-work'", "section id=discussion", "div class='note box'", "div role=note", "p class=alert-text"):
        assert html_extract.main_text(f"<body><article><h1>Title</h1><p>Text of it.</p><{part}>This too.</{part.split()[0]}><p>More.</p></article>") == "Title\nText of it.\nThis too.\nMore.", part


def test_words_that_count_outside_of_articles():
    page = "<body><div><h1>Title</h1><p>%s</p></div><div class='discussion'><p>%s</p></div><div id='related-posts'><p>%s</p></div></body>" % tuple(x * 30 for x in ("Long text. ", "A reader says. ", "Other posts. "))
    assert html_extract.main_text(page) == "Title\n" + ("Long text. " * 30).strip()


def page_without_names(rnd):
    """Its main text, and a page whose parts only differ in how dense their text is: no telling tag, class or id."""
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    cloud = lambda: f"<div class=x{rnd.randint(1, 9)}>" + "".join(f"<div><b>{word()}</b> <i>{word()}</i> <u>{word()}</u></div>" for _ in range(rnd.randint(25, 50))) + "</div>"
    links = lambda: "<ul>" + "".join(f"<li><a href=/{word()}>{say(3)}</a></li>" for _ in range(rnd.randint(5, 30))) + "</ul>"
    lines = [say(rnd.randint(3, 9))] + [say(rnd.choice([4, 30, 60, 90])) for _ in range(rnd.randint(5, 9))] + [say(40)]
    body = f"<div><h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:]) + "</div>"
    return "\n".join(lines), f"<html><body><div>{links()}{cloud()}</div><div>{body}<div>{cloud()}{cloud()}</div></div><div>{links()}</div></body></html>"


def test_ratios_select_the_lines():
    """Of 60 pages without named parts all come out right; with one ratio for all lines hardly any does."""
    pages = [page_without_names(random.Random(i)) for i in range(60)]
    assert all(html_extract.main_text(page) == want for want, page in pages)
    alike = sum(html_extract.main_text(page, ratio=lambda chars, tags: np.ones(len(chars))) == want for want, page in pages)
    assert alike <= 6


def test_deep_pages_are_read_in_linear_time():
    import time

    pages = ("<div>x" * 8000, "<td>" + "<span>x" * 8000 + "<div></div>" * 8000, "<p>" + "<i>" * 9000 + "x</b>" * 9000, "<ul>" + "<li><span>x" * 8000)
    html_extract.main_text(pages[0])
    began = time.process_time()
    for page in pages:
        assert html_extract.main_text(page).count("x") >= 1
    assert time.process_time() - began < 1.0
    assert html_extract.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>") == "deep\nafter"


def test_main_text_of_odd_pages():
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "just text", "a &lt; b & c")] == ["", "", "", "just text", "a < b & c"]
    assert html_extract.main_text("<article><p>one<p>two <div>three") == "one\ntwo\nthree"
    assert html_extract.main_text("<div class=ad>never closed<article><p>text</p></article>") == "text"
    assert html_extract.main_text("<article>" + "<p>x y</p>" * 5000 + "</article>").count("\n") == 4999


def test_smoothing_keeps_a_constant():
    assert html_extract.smoothed(np.full(9, 3.0), 1.0) == pytest.approx(np.full(9, 3.0))


def test_html_query(spark, data):
    import html as entities
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in QUERIES["op1_html_main_text"](spark, data).collect():
        article = re.split("</article>|<footer>", pages[r.page_id].split("<article>")[1])[0]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "x"), (1, None, "", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in html_extract.extract(pages).collect()) == [("1", ""), ("1", ""), ("None", "a")]
    assert html_extract.extract(pages.where("false")).isEmpty()


# Media


def test_media_holds_any_bytes():
    rnd = random.Random(1)
    for raw in (b"", b"\xff" * 5000, bytes(range(256)) * 40, rnd.randbytes(64), rnd.randbytes(20_001)):
        stored = media.write_avi(media.padded(raw), len(raw))
        payload, n = media.payload_of(stored)
        assert payload == media.padded(raw) and n == len(raw) and len(payload) % 64 == 0 < len(payload)
        frames, fps, _ = media.parse_avi(stored)
        assert fps == 25 and len(frames) == -(-len(payload) // 4096)


def test_general_decoder_agrees():
    frame = media.parse_avi(media.write_avi(media.padded(random.Random(2).randbytes(4096))))[0][0]
    fast = media.uniform_luma(media.uniform_blocks(frame)).reshape(8, 8, 8, 8).transpose(0, 2, 1, 3).reshape(64, 64)
    assert (media.decode_luma(frame) == fast).all()


def jpeg_of_grey(levels, width, height):
    """A baseline JPEG of flat blocks, with a Huffman table of several lengths, no restarts."""
    sizes = list(range(12))
    counts = [0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[sizes[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    bits, last = "", 0
    for level in levels:
        d = (level - 128) - last
        last += d
        size = abs(d).bit_length()
        c, length = codes[size]
        bits += f"{c:0{length}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = media.segment(0xDB, b"\0" + b"\x08" * 64) + media.segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
    tables = media.segment(0xC4, b"\0" + bytes(counts) + bytes(sizes)) + media.segment(0xC4, media.one_code(1, 0, 1))
    return b"\xff\xd8" + head + tables + media.segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def avi_of(frames, index=True):
    movie = b"".join(media.chunk(b"00dc", f) for f in frames)
    return media.chunk(b"RIFF", b"AVI " + media.chunk(b"LIST", b"movi" + movie))


def test_other_frames_and_shots(spark):
    dark, light = jpeg_of_grey([20, 22, 24, 26], 16, 16), jpeg_of_grey([200, 201, 202, 203], 16, 16)
    luma = media.decode_luma(light)
    assert luma.shape == (16, 16) and (luma[:8, :8] == 200).all() and (luma[8:, 8:] == 203).all()
    df = spark.createDataFrame([(1, bytearray(avi_of([dark] * 10 + [light] * 5 + [dark] * 5))), (2, None), (3, bytearray(avi_of([dark])))], "doc_id long, media binary")
    got = [(r.doc_id, r.first_frame, r.end_frame, r.start_s) for r in media.clips(df).orderBy("doc_id", "clip").collect()]
    assert got == [(1, 0, 10, 0.0), (1, 10, 15, 0.4), (1, 15, 20, 0.6), (3, 0, 1, 0.0)]
    for bad in (b"RIFFxxxxWAVE", b"", dark):
        with pytest.raises(ValueError):
            media.parse_avi(bad)


def plain_feature(stored):
    """From samples by the cosine sum of the format, histograms and cuts in plain Python."""
    frames, fps, _ = media.parse_avi(stored)
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    wave = [[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) for u in range(8)] for x in range(8)]
    hist = []
    for frame in frames:
        counts = [0] * 16
        data = media.uniform_blocks(frame)
        for at in range(0, len(data), 64):
            level = {rc: b if b >= 128 else b - 255 for rc, b in zip(order, data[at : at + 64])}
            half = [[sum(level[v, u] * wave[x][u] for u in range(8)) for x in range(8)] for v in range(8)]
            for y in range(8):
                for x in range(8):
                    sample = sum(half[v][x] * wave[y][v] for v in range(8)) / 4 + 128
                    counts[min(255, max(0, round(sample))) // 16] += 1
        hist.append([c / sum(counts) for c in counts])
    moved = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(hist, hist[1:])]
    cuts = [0]
    for i, d in enumerate(moved):
        near = [moved[j] for j in range(max(0, i - 12), min(len(moved), i + 13)) if j != i]
        mean = sum(near) / len(near) if near else 0.5
        spread = math.sqrt(sum((x - mean) ** 2 for x in near) / len(near)) if near else 0
        if d > 0.1 and d > mean + 2 * spread:
            cuts.append(i + 1)
    return [(a / fps, b / fps, [sum(h[k] for h in hist[a:b]) / (b - a) for k in range(16)]) for a, b in zip(cuts, [*cuts[1:], len(hist)])]


def test_feature_equals_plain_python(spark):
    texts = ["", "short", "plain words of one kind " * 700, "a" * 30_000 + "\U0001f600" * 6000 + "zebra " * 4000, "é" * 9000 + "0123456789 " * 2500]
    out = media.digests(media.write_column(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    cuts = 0
    for r in out:
        want = plain_feature(media.write_avi(media.padded(texts[r.doc_id].encode())))
        got = [(x.partition(":")[0], [float(v) for v in x.partition(":")[2].split(",")]) for x in r.feature.split(";")]
        assert [x for x, _ in got] == [f"{a:.2f}-{b:.2f}" for a, b, _ in want]
        for (_, shares), (*_, exact) in zip(got, want):
            assert shares == pytest.approx(exact, abs=0.002)
        cuts += len(got) - 1
    assert cuts >= 2


def test_long_values_and_scans_cost_in_proportion():
    import time
    import tracemalloc

    raw = random.Random(3).randbytes(1 << 20) + b"text " * (1 << 20)
    tracemalloc.start()
    stored = media.write_avi(media.padded(raw), len(raw))
    assert media.payload_of(stored) == (media.padded(raw), len(raw)) and tracemalloc.get_traced_memory()[1] < 8 * len(raw)
    tracemalloc.stop()
    took = []
    for side in (50, 200):
        frame = jpeg_of_grey([random.Random(1).randrange(256) for _ in range(side * side)], side * 8, side * 8)
        began = time.process_time()
        media.decode_luma(frame)
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0]


def test_further_segments_of_large_files():
    dark, light = jpeg_of_grey([20, 22, 24, 26], 16, 16), jpeg_of_grey([200, 201, 202, 203], 16, 16)
    more = media.chunk(b"RIFF", b"AVIX" + media.chunk(b"LIST", b"movi" + media.chunk(b"LIST", b"rec " + media.chunk(b"00dc", light)) + media.chunk(b"01wb", b"sound")))
    frames, _, _ = media.parse_avi(avi_of([dark] * 3) + more + more)
    assert frames == [dark] * 3 + [light] * 2


def test_media_rows(docs, no_docs):
    out = media.digests(media.write_column(docs)).collect()
    by_text = collections.defaultdict(set)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in out:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by_text[texts[r.doc_id]].add((r.media_sha256, r.media_bytes, r.feature))
    assert len(out) == 12 and all(len(x) == 1 for x in by_text.values()) and media.digests(media.write_column(no_docs)).isEmpty()


# Languages


def test_language_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = QUERIES["op9_language_mixture"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    own = out[out.held_out]
    assert len(own) > 20 and (own.lang == own.lang_pred).mean() >= 0.98 and out.score.between(0, 1).all()


def test_mixture_of_two_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs)
    text = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}'").limit(6).collect())[:6000] for lang in ("en", "de")}
    found = dict(langid.infer(model, text["en"][:4000] + " " + text["de"][:2000]))
    assert set(found) == {"en", "de"} and found["en"] == pytest.approx(2 / 3, abs=0.1)
    assert langid.infer(model, text["de"])[0][0] == "de"
    for none in (None, "", "12 !? ..", "   "):
        assert langid.infer(model, none) == []


def plain_em(chance, n, rounds, tolerance=1e-4):
    """Shares by expectation-maximisation over single trigrams."""
    width = len(chance[0])
    share = [1 / width] * width
    for _ in range(rounds):
        new = [0.0] * width
        for row, times in zip(chance, n):
            total = sum(s * c for s, c in zip(share, row))
            for i in range(width):
                new[i] += times * share[i] * row[i] / total
        new = [x / sum(n) for x in new]
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < tolerance:
            break
    return share, sum(times * math.log(sum(s * c for s, c in zip(share, row))) for row, times in zip(chance, n))


def test_shares_equal_plain_sums():
    rng = np.random.default_rng(2)
    for width in (1, 2, 5):
        chance, n = rng.dirichlet(np.ones(width) / 2, 60) + 1e-6, rng.integers(1, 9, 60).astype(float)
        share, value = langid.shares_of(chance, n, np.full(width, 1 / width), 30)
        want, likely = plain_em(chance.tolist(), n.tolist(), 30)
        assert share == pytest.approx(want) and value == pytest.approx(likely)


def test_mixture_decides_where_single_languages_mislead():
    """A document of 55 % a and 45 % b: alone a third language that is between both is likeliest, as a mixture a and b are."""
    model_of = lambda columns: langid.Model(["a", "b", "between"], np.array(columns, np.float32).T)
    rng, size = np.random.default_rng(5), langid.BUCKETS
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    own = {x: [word() for _ in range(60)] for x in "ab"}
    counts = {x: np.full(size, 0.5) for x in "ab"}
    for x in "ab":
        at, n = langid.trigrams(" ".join(own[x] * 20))
        counts[x][at] += n
    a, b = (counts[x] / counts[x].sum() for x in "ab")
    model = model_of([a, b, 0.5 * (0.4 * a + 0.6 * b) + 0.5 / size])
    text = " ".join(list(rng.choice(own["a"], 110)) + list(rng.choice(own["b"], 90)))
    at, n = langid.trigrams(text)
    assert np.argmax(n @ np.log(model.chance[at])) == 2
    found = langid.infer(model, text)
    assert [x for x, _ in found] == ["a", "b"] and dict(found)["a"] == pytest.approx(0.55, abs=0.05)
    # The set is the best of all sets by penalised likelihood.
    value = {}
    for chosen in ([0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]):
        _, likely = plain_em(model.chance[at][:, chosen].astype(float).tolist(), n.tolist(), 200, 1e-7)
        value[tuple(chosen)] = likely - 3.0 * math.log(n.sum() + 1) * len(chosen)
    assert max(value, key=value.get) == (0, 1)


def test_what_is_no_letter_is_no_language(spark):
    rows = [(1, "\U000f0000 \U000e0041 \U0001f600"), (2, "\U00020000\U00020001\U0002a6d6"), (3, "\ud7ff\u0300 12")]
    model = langid.fit(spark.createDataFrame([(i, "words of a language", "en") for i in range(5)], "doc_id long, text string, lang string"))
    assert [langid.infer(model, t) == [] for _, t in rows] == [True, False, True]
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit(spark.createDataFrame([(i, "x", f"l{i}") for i in range(9)], "doc_id long, text string, lang string"), most_languages=3)


def test_language_odd_rows(docs, no_docs):
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 5, 10)) and got[1][0] == "en" and got[None][0] == "de"
    assert langid.fit(no_docs).languages == [] and langid.predict(no_docs, model).isEmpty()
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(no_docs)).collect()} == {"und"}


# Near duplicates


def labelled(text):
    words, seen, out = text.split(), collections.Counter(), []
    for i in range(max(1, len(words) - 4)) if words else ():
        s = tuple(words[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def plain_similarity(a, b):
    """By the full table of the alignment, without a band."""
    a, b = labelled(a), labelled(b)
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def planted(seed=0, groups=25):
    """Texts, their classes at 0.8, and passages that texts share without being alike."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    passage = [word() for _ in range(70)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rnd.randint(6, 220))]
        if g % 3 == 0:
            base = base[:40] + passage + base[40:140]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            w = list(base)
            for _ in range(max(0, int(len(w) * rnd.choice([0, 0.01, 0.02, 0.03, 0.08])))):
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([[word()], [], [w[i], word()]])
            texts.append(" ".join(w))
    texts += ["a b c", "a b c", "a b d", "the same line again " * 60, "the same line again " * 62, "", "  "]
    return texts


def test_alignment_equals_the_full_table():
    texts = planted(3, 12)
    for i, a in enumerate(texts):
        for b in texts[: i + 1]:
            if not a.split() or not b.split():
                continue
            want, got = plain_similarity(a, b), minhash.aligned(minhash.shingles(a), minhash.shingles(b))
            assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_order_counts():
    w = [f"w{i}" for i in range(200)]
    turned = w[100:] + w[:100]
    assert minhash.aligned(minhash.shingles(" ".join(w)), minhash.shingles(" ".join(turned))) < 0.8


def test_near_duplicates_equal_brute_force(spark):
    texts = planted()
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            if a.split() and texts[j].split() and plain_similarity(a, texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in out.collect()} == {i: find(i) for i in range(len(texts))}


def test_large_group_around_a_text_that_is_not_its_least(spark):
    """500 variants, each similar to a base in mid id order and hardly to each other: every pair of a band key counts."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(500):
        w = list(base)
        for i in rnd.sample(range(300), 6):
            w[i] = word()
        texts.append(" ".join(w))
    texts[250] = " ".join(base)
    hashes = [minhash.shingles(t) for t in texts]
    members, root = collections.defaultdict(list), list(range(len(texts)))
    for i, h in enumerate(hashes):
        for key in minhash.band_keys(h).tolist():
            members[key].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    assert max(map(len, members.values())) > 64
    for i, j in {(i, j) for own in members.values() for i in own for j in own if i < j}:
        x, y = sorted((find(i), find(j)))
        if x != y and minhash.aligned(hashes[i], hashes[j]) >= 0.8:
            root[y] = x
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in out.collect()} == {i: find(i) for i in range(len(texts))}


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    own = [rng.choice(60, rng.integers(1, 40), replace=False).astype(np.uint64) for _ in range(12)]
    got = minhash.shared_counts(np.concatenate(own), np.array([len(x) for x in own]), np.arange(5), np.arange(5, 12))
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in own[5:]] for a in own[:5]]


def test_ids_of_any_kind(spark):
    """Texts as ids, and numbers whose sum is no number of 64 bits."""
    texts = [f"{'one two three four five six seven eight nine ten ' * 3}{'' if i < 6 else i}" for i in range(8)] + ["something else"]
    for ids in ([f"doc-{i}" for i in range(9)], [2**62 + i for i in range(9)], [-(2**62) - i for i in range(9)]):
        kind = "string" if isinstance(ids[0], str) else "long"
        out = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")).collect()}
        assert out == {i: min(ids[:8]) for i in ids[:8]} | {ids[8]: ids[8]}
    far = [(2**62 + i, 2**62 + i + 1) for i in range(6)]
    assert {r.rep: r.root for r in minhash.components(spark.createDataFrame(far, "a long, b long")).collect()} == {2**62 + i: 2**62 for i in range(1, 7)}


def test_a_band_key_of_thousands_of_unlike_texts(spark):
    """Each pair meets in some pair of blocks, those of the most frequent root only with others; 30 alike pairs are found, no other."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(30)]
    texts = [" ".join(passage + [word() for _ in range(25)]) for _ in range(5000)]
    alike = {(rnd.randrange(2500), 2500 + i) for i in rnd.sample(range(2500), 30)}
    for a, b in alike:
        texts[b] = texts[a] + " " + word()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rep long, text string")
    root = [i for i in range(5000)]
    root[10:200] = [10] * 190  # one component holds many of them already
    members = spark.createDataFrame([(77, i, r) for i, r in enumerate(root)], "key long, rep long, root long")
    found = minhash.links_in_blocks(members, minhash.several_roots(members), df, 0.8).collect()
    assert {tuple(sorted((r.a, r.b))) for r in found} == {x for x in alike if root[x[0]] != root[x[1]]}


def test_near_duplicates_odd_rows(docs, no_docs):
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert got == {(1, 1): 1, (6, 1): 2, (None, None): 1, **{(i, i): 1 for i in (2, 3, 4, 5, 7, 8, 9, 10)}}
    assert minhash.near_duplicates(no_docs).isEmpty()


def test_bands_meet_for_similar_texts():
    """At a similarity from 0.8 to 0.85 hardly any pair agrees in no band."""
    rnd, pairs, missed = random.Random(5), 0, 0
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    while pairs < 150:
        base = [word() for _ in range(rnd.choice([40, 100, 300]))]
        w = list(base)
        for _ in range(max(1, len(w) * rnd.randint(10, 25) // 1000)):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[word()], [], [w[i], word()]])
        a, b = minhash.shingles(" ".join(base)), minhash.shingles(" ".join(w))
        if 0.8 <= minhash.aligned(a, b) < 0.85:
            pairs += 1
            missed += not set(minhash.band_keys(a).tolist()) & set(minhash.band_keys(b).tolist())
    assert missed <= 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201)]
    random.Random(1).shuffle(chain)
    got = {r.rep: r.root for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}


def test_components_with_further_links(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    whole = {(r.rep, r.root) for r in minhash.components(frame(links)).collect()}
    roots = minhash.components(frame(links[:200]))
    for part in (links[200:250], links[250:], links[:40], [(1, 1)]):
        roots = minhash.extended(roots, frame(part))
    assert {(r.rep, r.root) for r in roots.collect()} == whole and roots.count() == len(whole)


def tasks_of(spark, group, run):
    """How many tasks run() takes with 50 partitions in each shuffle."""
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_few_links_take_no_shuffle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    more = spark.createDataFrame([(40, 60), (60, 61)], "a long, b long")
    out = []
    assert tasks_of(spark, "links", lambda: out.extend(minhash.extended(minhash.components(links), more).collect())) < 200
    assert {r.rep: r.root for r in out} == {i: 0 for i in [*range(1, 41), 60, 61]}


def test_near_duplicates_take_few_tasks(spark):
    """Over 64 texts to a band key and smaller keys, so that each step has work."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = planted(5, 40)
    for _ in range(150):
        w = list(base)
        for i in rnd.sample(range(300), 6):
            w[i] = word()
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert tasks_of(spark, "classes", lambda: minhash.near_duplicates(df).collect()) < 1200


@pytest.mark.parametrize("most", [0, 7, 1 << 20])
def test_components_whatever_one_task_holds(spark, monkeypatch, most):
    """In rounds, and in one task; a partition's links are made stars a few at a time, too."""
    monkeypatch.setattr(minhash, "ONE_TASK", most)
    rnd = random.Random(most)
    links = [(rnd.randrange(300) << 40, rnd.randrange(300) << 40) for _ in range(240)] + [(1 << 50, 1 << 50)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(3)
    want = {x: find(x) for x in root if find(x) != x}
    got = [(r.rep, r.root) for r in minhash.components(frame(links)).collect()]
    assert dict(got) == want and len(got) == len(want)
    got = [(r.rep, r.root) for r in minhash.extended(minhash.components(frame(links[:150])), frame(links[150:])).collect()]
    assert {a: b for a, b in got if a != b} == want
    assert not minhash.components(frame(links).where("false")).collect()


def test_near_copies_of_rows_that_repeat_or_have_no_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join(words + [x]) for x in "abc")
    rows = [(None, a), (None, a), (5, b), (5, b), (7, a), (3, c), (None, c), (9, "something else"), (None, "alone")]
    got = collections.Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, 3): 3, (5, 3): 2, (7, 3): 1, (3, 3): 1, (9, 9): 1, (None, None): 1}
    none = [(None, a), (None, a), (None, b)]
    got = minhash.text_classes(spark.createDataFrame(none, "doc_id long, text string")).collect()
    assert len(got) == 2 and len({r.root for r in got}) == 1 and {r.id for r in got} == {None}


def test_what_is_a_word_is_the_same_in_sql(spark):
    """The pattern tells white space as str.split does, in Python and in Spark."""
    import re

    blank = [c for c in range(0x110000) if not chr(c).split()]
    assert blank == [c for c in range(0x110000) if not re.search(minhash.WORD, chr(c))] and len(blank) > 20
    rows = [(chr(c),) for c in [*blank, 0x200B, 0x180E, 0xFEFF, 0x1F600, 0x61]]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame(rows, "text string").coalesce(1).select(F.regexp_like("text", F.lit(minhash.WORD))).collect()]
    assert got == [False] * len(blank) + [True] * 5
