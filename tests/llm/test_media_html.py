import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glyphlake.llm import audio, html

from . import cases


def test_payloads_round_trip(spark):
    got = audio.media(cases.frame(spark), with_file=True).collect()
    want = {}
    for r in cases.rows():
        raw = (r[1] or "").encode()
        want.setdefault(r[0], set()).add((len(raw), hashlib.sha256(audio.padded(raw)).hexdigest(), zlib.crc32(audio.padded(raw)[-64:])))
    assert len(got) == len(cases.rows())
    for r in got:
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and r.media_bytes == r.payload_bytes + 44
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and audio.wav_decode(bytes(r.media))[1][: r.n_bytes] is not None
    assert len({r.feature for r in got if r.n_bytes == 0}) == 1
    assert audio.media(cases.empty(spark)).collect() == []


def test_pieces_do_not_show(monkeypatch):
    raw = np.random.default_rng(0).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    whole = audio.features(16_000, raw)
    monkeypatch.setattr(audio, "PIECE", 1 << 11)
    parts = audio.features(16_000, raw)
    assert np.allclose(whole.log_mel, parts.log_mel, atol=1e-3) and whole.digest(audio.tensor_table(whole)) == parts.digest(audio.tensor_table(parts))


def test_resampling_keeps_a_tone():
    t = np.arange(16_000)
    sound = np.sin(2 * np.pi * 440 * t / 16_000).astype(np.float32)
    out = audio.resample(sound, 5, 8)
    spectrum = np.abs(np.fft.rfft(out[:10_000]))
    assert len(out) == 10_000 and abs(int(spectrum.argmax()) - 440) <= 1
    high = audio.resample(np.sin(2 * np.pi * 7_000 * t / 16_000).astype(np.float32), 5, 8)
    assert np.abs(high[100:-100]).max() < 0.2


def test_hysteresis_holds_between_its_thresholds():
    energy = np.asarray([0, 0, 2, 4, 2, 2, 0, 2, 0, 5, 0, 0, 0], float)
    assert audio.hysteresis(energy, 3, 1) == [(2, 5), (9, 9)]


def plain_log_mel(samples):
    """Resampling, windows and filterbank by their formulas, one output at a time."""
    up, down, n = 5, 8, 5 * audio.TAPS_EACH
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / down) / down * np.hanning(n + 2)[1:-1]
    taps *= up / taps.sum()
    total = -(-len(x) * up // down)
    sound = [sum(taps[k] * x[(j * down - k) // up] for k in range(n) if (j * down - k) % up == 0 and 0 <= (j * down - k) // up < len(x)) for j in range(total)]
    frames = 1 + max(0, -(-(total - audio.WINDOW) // audio.HOP))
    sound = np.pad(sound, (0, (frames - 1) * audio.HOP + audio.WINDOW - len(sound)))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(5_000), audio.MELS + 2) / 2595) - 1)
    out = []
    for k in range(frames):
        window = sound[k * audio.HOP : k * audio.HOP + audio.WINDOW] * np.hanning(audio.WINDOW + 1)[:-1]
        power = np.abs(np.fft.rfft(window)) ** 2
        freq = np.arange(len(power)) * 10_000 / audio.WINDOW
        bands = [sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, freq, strict=True)) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)]
        out.append(10 * np.log10(np.array(bands) + 1e-10))
    return np.array(out)


@pytest.mark.parametrize("size", [64, 640, 3_200])
def test_features_are_those_of_the_formulas(size):
    raw = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert np.allclose(audio.features(16_000, raw).log_mel, plain_log_mel(raw), atol=0.05)


def test_spans_are_stored_as_fixed_shape_tensors(spark):
    rows = audio.media(cases.frame(spark)).collect()
    for r in rows:
        table = audio.tensors_decode(bytes(r.tensors))
        assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), (audio.SPAN, audio.MELS))
        frames = int(r.feature.split(";")[0].split("=")[1])
        starts, ends = table.column("start_s").to_pylist(), table.column("end_s").to_pylist()
        assert len(starts) == -(-frames // audio.SPAN) and all(a < b for a, b in zip(starts, ends, strict=True))
        assert ends[-1] == pytest.approx(((frames - 1) * audio.HOP + audio.WINDOW) / audio.RATE_OUT)
    spans = audio.spans(audio.media(cases.frame(spark), with_file=True)).collect()
    assert all(len(r.log_mel) == audio.SPAN * audio.MELS and r.end_s > r.start_s for r in spans)
    assert {r.doc_id for r in spans} == {r[0] for r in cases.rows()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy</div><article><h1>Head {i}</h1><p><b>One &amp; two<br><p>{body}</p>
<form><input><button>go</button></form><aside>side</aside><section id="comments"><p>nice</p></section></article><footer>&copy; x</footer></body></html>"""


def test_article_text_is_extracted(spark):
    bodies = ["  a\n b&nbsp;c ", "é &lt;tag&gt;", "", "x" * 50_000]
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, body=b)) for i, b in enumerate(bodies)]
    rows += [(10, None, None), (11, "http://h.example/e", ""), (12, "bad url", "plain <b>text</b>"), rows[0]]
    got = html.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, tokens int")).collect()
    want = {i: "\n".join(x for x in (f"Head {i}", "One & two", " ".join(b.replace("&nbsp;", " ").replace("&lt;", "<").replace("&gt;", ">").split())) if x) for i, b in enumerate(bodies)}
    want |= {10: "", 11: "", 12: "plain text"}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_template_text_is_dropped_from_pages_without_an_article(spark):
    page = "<html><body><div><p>Welcome to our site</p><p>All offers</p></div><div><p>story {i} told</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i)) for i in range(6)] + [(9, "http://b.example/", page.format(i=9))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 told"
    assert got[9] == "Welcome to our site\nAll offers\nstory 9 told"


@pytest.mark.parametrize("page", ["<", "<a", "<!--", "<p", "</", "a < b > c", "<script>x", "<p>a</div>b", "<nav>m<article><p>t", "<b>" * 2000])
def test_broken_markup_does_not_crash(page):
    assert isinstance(html.main_text(page, []), str)


def members(*pairs):
    return [html.Member(token, kind) for token, kind in pairs]


def test_classes_that_cross_do_not_both_hold():
    page = "<div><p>a</p><p>x</p><p>b</p><p>y</p><p>c</p><p>z</p></div>"
    number = {t.text: t.number for t in html.parse(page) if t.text}
    crossing = members((number["a"], 1), (number["x"], 2), (number["b"], 1), (number["y"], 2), (number["c"], 1))
    assert html.main_text(page, crossing) == "x\ny\nz"
    nested = members((number["a"], 1), (number["x"], 2), (number["b"], 2), (number["c"], 1))
    assert html.main_text(page, nested) == "y\nz"


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def site(spark, page, n=8, host="s.example"):
    return extracted(spark, [(i, f"http://{host}/{i}", page.format(i=i, w="word" * (i + 3))) for i in range(n)])


def test_a_line_of_all_articles_of_a_host_is_template_text(spark):
    page = "<html><body><nav>menu</nav><article><h1>Title {i}</h1><p>Read our offers now</p><p>story {i} about {w} and {w}</p></article></body></html>"
    got = site(spark, page)
    assert got[3] == "Title 3\nstory 3 about " + "word" * 6 + " and " + "word" * 6
    # without the template the line stays, as on a host of one page
    assert extracted(spark, [(1, "http://o.example/1", page.format(i=1, w="x"))])[1] == "Title 1\nRead our offers now\nstory 1 about x and x"
    assert html.main_text(page.format(i=3, w="x"), []) == "Title 3\nRead our offers now\nstory 3 about x and x"


def test_articles_that_a_host_repeats_are_kept(spark):
    page = "<html><body><article><h1>Same</h1><p>one text on all pages</p></article><footer>f {i}</footer></body></html>"
    assert set(site(spark, page).values()) == {"Same\none text on all pages"}


def test_the_slot_of_most_text_is_the_main_one_without_an_article(spark):
    page = "<html><body><div id='top'>item {i}</div><div id='text'><div class='entry-header'><h1>Title {i}</h1></div><div class='body'><p>story {i} of {w}</p><p>more {w} {w}</p></div></div><div id='side'><p>other {i}</p></div></body></html>"
    assert site(spark, page)[2] == "Title 2\nstory 2 of " + "word" * 5 + "\nmore " + " ".join(["word" * 5] * 2)


def test_titles_related_work_and_inline_elements_stay(spark):
    page = "<article><div class='entry-header'><h1>Title {i}</h1></div><section id='related-work'><p>work {i}</p></section><p>one<wbr>two<img src=x>three <b>{w}</b></p><section id='comments'><p>nice {i}</p></section><div class='x ad'>buy {i}</div></article>"
    assert site(spark, page)[1] == "Title 1\nwork 1\nonetwothree " + "word" * 4


def test_pages_of_equal_rows_and_hosts(spark):
    page = "<body><div><p>Welcome</p><p>Menu of all</p></div><div><p>story {i}</p></div></body>"
    rows = [(i, f"http://{h}.example/{i}", page.format(i=i)) for h in "ab" for i in range(4)] + [(50, "HTTP://A.example:80/0", page.format(i=0)), (51, None, page.format(i=0)), (0, "http://a.example/0", page.format(i=0))]
    got = html.extract(spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, template int")).collect()
    assert len(got) == len(rows) and all(r.text == (f"story {r.page_id % 50}" if r.page_id != 51 else "Welcome\nMenu of all\nstory 0") for r in got)


def test_reading_is_linear():
    began = time.perf_counter()
    for page in ('<a b="x ' * 130_000, "<p class='" * 100_000 + ">", "<div>" * 100_000 + "</x>" * 100_000, "<!" * 500_000, "<script>" * 100_000):
        html.parse(page)
    assert time.perf_counter() - began < 10


def brute_template(pages):
    """Texts that stand once on each page of a host that has them, on half of them or more, in a class of at least two tokens."""
    vectors = {}
    for k, page in enumerate(pages):
        for token in html.parse(page):
            vectors.setdefault(token.number, [0] * len(pages))[k] += 1
    classes = {}
    for number, vector in vectors.items():
        if max(vector) == 1 and sum(vector) >= max(html.LEAST_PAGES, html.LEAST_SHARE * len(pages)):
            classes.setdefault(tuple(vector), set()).add(number)
    return {frozenset(c) for c in classes.values() if len(c) >= html.LEAST_TOKENS}


def test_templates_are_those_of_the_occurrence_vectors(spark):
    rng = random.Random(7)
    pages = []
    for i in range(20):
        optional = "<div id='o'><p>Optional box</p><p>More of it</p></div>" if rng.random() < 0.7 else ""
        items = "".join(f"<li>item {rng.randrange(4)}</li>" for _ in range(rng.randint(1, 4)))
        pages.append(f"<body><div id='t'><p>Site name</p>{optional}<ul>{items}</ul></div><div id='m'><p>story {i}</p><p>{rng.choice(['yes', 'no'])}</p></div><p>The end</p></body>")
    rows = html.templates(spark.createDataFrame([(f"http://h.example/{i}", p) for i, p in enumerate(pages)], "url string, html string")).collect()
    found = {}
    for m in rows[0].template:
        found.setdefault(m["class"], set()).add(m["token"])
    assert {frozenset(c) for c in found.values()} == brute_template(pages) and len(found) >= 2
    texts = {t.number: t.text for p in pages for t in html.parse(p)}
    gone = {texts[n] for c in found.values() for n in c} - {None}
    got = extracted(spark, [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)])
    assert {"Site name", "The end"} <= gone and not any(line in gone for text in got.values() for line in text.split("\n"))
