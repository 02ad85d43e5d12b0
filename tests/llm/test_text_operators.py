"""Token counts, BPE, secrets, HTML, media: against the library, brute force and exact round trips."""

import base64
import hashlib
import json
import os
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from chronofold.llm import bpe, html, media, secrets, tokens, webp  # noqa: E402
from chronofold.llm.pieces import sections  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "  a", "a  ", "a\n", "\na", "a\n\nb", "a \n b", "don't we'll 'S I'D", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "é" * 70, "ab" * 3000, "x\x1c 1\x85 y",
    "a\xa0 b　c", "👍🏽 नमस्ते 12345 %%%$$$", "long " * 40_000, "z" * 5000, "\x00\x00 \x00",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab \n\t'strevml<|endoftext|>é1２ \xa0 👍$.") for _ in range(rng.randrange(60))) for _ in range(1500)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS string, secrets string")


def test_sections_give_the_text_back(texts):
    for x in texts:
        assert "\n".join(" ".join(line) for line in sections(x or "")) == (x or "")


def test_token_counts(spark, library, texts):
    got = tokens.token_counts(frame(spark, texts), PATH).collect()
    assert len(got) == len(texts) and {"doc_id", "n_bytes", "n_tokens", "over_limit"} <= set(got[0].asDict())
    for r in got:
        x = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(x.encode()), len(library.encode(x, add_special_tokens=False).ids)), x[:50]
        assert r.over_limit == (r.n_tokens > 1024)


def test_bpe(spark, library, texts):
    df = frame(spark, texts)
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    for r in bpe.round_trip(df, PATH).collect():
        x = texts[r.doc_id] or ""
        ids = library.encode(x, add_special_tokens=False).ids
        assert back[r.doc_id].ids == ids and back[r.doc_id].decoded == library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()


def test_bpe_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    own = bpe.Vocabulary(PATH)
    for k in range(30):
        assert own.encode([f"word{k} other{k}"])[0].tolist() == library.encode(f"word{k} other{k}", add_special_tokens=False).ids
    assert sum(map(len, own.known)) < 20


def test_decode_of_broken_ids(library):
    own = bpe.vocabulary(PATH)
    for ids in ([], [50256], [10 ** 6], library.encode("é", add_special_tokens=False).ids[:1], [162, 162]):
        known = [i for i in ids if i <= 50256]
        assert own.decode(ids) == library.decode(known, skip_special_tokens=False)


def base_spans(text):
    """Brute force of the base kinds, by the patterns as they are written."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


DER = bytes.fromhex("302e0201003005060341424304224120") + bytes(range(32))
JWT = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256", "typ": "JWT"}, {"sub": "1"})) + ".c2ln"
SSH = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))).decode()


def test_der():
    assert secrets.is_der(DER)
    assert not secrets.is_der(DER[:-1]) and not secrets.is_der(DER + b"\0") and not secrets.is_der(b"\x31" + DER[1:]) and not secrets.is_der(b"")


def test_secrets(spark):
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(DER).decode() + "\n-----END PRIVATE KEY-----"
    rng = random.Random(3)
    made = ["".join(rng.choice(['token', 'PASSWD', ' ', '=', ':', '"', 'a', 'f0', 'AKIA', 'Z9', 'é', '😀', 'api_key', 'ſecret', '\n']) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts = [None, "", "token=secret=abcdefg", "password: token: abcdefgh", "x" * 100_000 + " token = abcdef", f"see {pem} there", f"auth {JWT}.", f"auth {JWT[3:]}", "eyJhIjoxfQ.e30.", SSH, DER.hex(), "A" * 60, "0" * 60, *made]
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, texts), redact=True).collect()}
    for i, x in enumerate(texts):
        want, r = base_spans(x or ""), got[i]
        said = [s for s in r.spans.split(",") if s.split(":")[0] in secrets.BASE]
        assert said == [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert not base_spans(r.redacted.replace("[secret]", "\0")) or "ſ" in x
    kinds = [{s.split(":")[0] for s in got[i].spans.split(",") if s} for i in range(5, 13)]
    assert kinds == [{"pem", "der"}, {"jwt"}, set(), set(), {"ssh"}, {"hex", "der"}, set(), {"hex"}]


def test_secrets_in_other_forms():
    def kinds(text):
        return {(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.scan(text) if k >= len(secrets.BASE)}

    upper, mixed = DER.hex().upper(), DER.hex().replace("e", "E")
    assert kinds(f"x {upper} y") == {("der", upper)} and kinds(f"x {mixed} y") == {("der", mixed)}
    der = DER[:-1] + b"\xff"
    der = der[:-4] + b"\xfb\xff\xfe\xff"
    url = base64.urlsafe_b64encode(der).decode()
    assert ("_" in url or "-" in url) and kinds(f"x {url} y") == {("der", url)}
    plain = base64.b64encode(DER).decode()
    wrapped = "\n".join(plain[i : i + 24] for i in range(0, len(plain), 24))
    assert kinds(f"x {wrapped}\nword") == {("der", wrapped)}
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{base64.b64encode(bytes(48)).decode()}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", pem) in kinds(f"x {pem} y")


SECRETS_LIKE = ["KEY ", "-----BEGIN KEY-----", "-----BEGIN KEY ", "eyJ", "eyJa.", "token ", " ", 'password"', "AKIA", "M", "MAAAAAAAAAAAAAAAAAAA\n", "AAAA\n\t ", "0", "30", "a_", "f-", "3080"]


@pytest.mark.parametrize("piece", SECRETS_LIKE)
def test_hostile_texts_take_time_in_proportion(piece):
    for lead in ("", "-----BEGIN ", "secret"):
        began = time.perf_counter()
        secrets.scan(lead + piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 15


PAGES = [
    (None, ""), ("", ""), ("<p>", ""), ("<article><h1>T</h1><p>a &amp; b<br>c  d</p><p>e <b>f</b>g</p></article><footer>x</footer>", "T\na & b c d\ne fg"),
    ('<nav><a href="/">n</a></nav><div class="ad">buy</div><article><p>One.<p>Two <script>x("</p>")</script>three</article>', "One.\nTwo three"),
    ('<header><h1>Site</h1></header><main><p>Text</p><div class="comments"><p>mine</p></div><aside>x</aside><form><input>y</form><p>End</main>', "Text\nEnd"),
    ("<article><p>no end", "no end"), ("<article><!-- <p>hidden</p> --><p>&lt;p&gt; &#233; &eacute;</p></article>", "<p> é é"), ("<div class=broadcast><article class='reader ad-free-not'><p>x</p></article></div>", "x"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_html(page, text):
    assert html.extract(page or "") == text


def test_html_without_an_article():
    long = "This is the text of a page that has no element for its article, and it is long enough for the rules to see that there are words in it which people use. " * 2
    page = f"<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h1>Head</h1><p>{long}</p><p>Short.</p><p>{long}</p><div id=sidebar>{long}</div><p>(c) 2020</p><ul><li><a href=c>More of it here</a></ul>"
    assert html.extract(page) == "\n".join(["Head", long.strip(), "Short.", long.strip()])


def test_html_with_an_article_that_is_not_the_story():
    """The words of every block count, so a teaser's element does not hide the text, nor does an element keep what is between bad blocks."""
    long = "This is the text of a page that has no element for its article, and it is long enough for the rules to see that there are words in it which people use. " * 2
    card = "<article><h3>Card</h3><p>Read on.</p></article>"
    story = f"<div><p>{long}</p><p>{long}</p></div>"
    assert html.extract(story + card).startswith("\n".join([long.strip()] * 2)) and html.extract(card + story).endswith("\n".join([long.strip()] * 2))
    link = "<p><a href=x>" + "Zyx " * 30 + "</a></p>"
    foot = "Imprint Berlin Phone Fax Email Register Munich Court Number Hamburg Office"
    page = f"<article><p>{long}</p>{link}<p>{foot}</p>{link}</article><p>Outside text that is in the page.</p><p>{long}</p>"
    assert html.extract(page) == "\n".join([long.strip()] * 2)


def test_html_rows(spark):
    df = spark.createDataFrame([(i, p, "z") for i, (p, _) in enumerate(PAGES)] + [(99, "<p>" * 20_000 + "x", "z")], "page_id long, html string, N_CHARS string")
    got = {r.page_id: r for r in html.main_text(df).collect()}
    assert all(got[i].text == t and got[i].n_chars == len(t) for i, (_, t) in enumerate(PAGES)) and len(got) == len(PAGES) + 1


class Tree(HTMLParser):
    """A second way to the blocks of a page whose elements are all closed: whole paths are looked at for every piece of text."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.found, self.piece = [], [], []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join("".join(t for t, _ in self.piece).split())
        if text:
            names = [t for t, _ in self.path]
            bad, article = False, False
            for tag, attrs in self.path:
                named = set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower()))
                role = (attrs.get("role") or "").lower() in html.ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
                frame = tag in ("html", "body", "article", "main")
                bad |= (tag in html.BOILERPLATE and not (tag == "header" and article)) or (not frame and (role or bool(named & html.MARKS)))
                article |= tag in ("article", "main")
            heading = any(n in html.HEADINGS for n in names)
            self.found.append((text, sum(len(" ".join(t.split())) for t, link in self.piece if link), bad, article, heading))
        self.piece = []

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            if tag == "hr":
                self.end()
            elif tag == "br":
                self.piece.append((" ", False))
            return
        if tag in html.BLOCKS:
            self.end()
        self.path.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        while self.path:
            if self.path[-1][0] in html.BLOCKS:
                self.end()
            if self.path.pop()[0] == tag:
                break

    def handle_data(self, data):
        names = [t for t, _ in self.path]
        if not any(n in html.SKIPPED for n in names):
            self.piece.append((data, "a" in names))


def second_text(page):
    """The two passes, with a look at every block for each block."""
    found = Tree(page).found
    words = [[w.lower() for w in re.findall(r"[^\W\d_]+", b[0])] for b in found]
    density = [sum(w in html.STOP_WORDS for w in ws) / max(1, len(ws)) for ws in words]
    label = []
    for (text, linked, bad, _, heading), d in zip(found, density, strict=True):
        kind = "bad" if bad or (linked / len(text) > 0.33 and not heading) else "short" if len(text) < 70 else "good" if d >= 0.2 else "near" if d > 0 or heading else "none"
        label.append(kind)
    weight = {side: sum(len(b[0]) for b, c in zip(found, label, strict=True) if c == "good" and b[3] == side) for side in (True, False)}
    leads = any(b[3] and not b[2] for b in found) and weight[True] >= weight[False]
    for k, b in enumerate(found):
        if leads and not b[3] and (label[k] != "good" or density[k] < 0.3 or len(b[0]) < 200):
            label[k] = "bad"
        if label[k] == "none":
            label[k] = "near" if leads else "bad"
    keep = []
    for k, b in enumerate(found):
        if label[k] in ("good", "bad"):
            keep.append(label[k] == "good")
            continue
        before = next((i for i in range(k - 1, -1, -1) if label[i] in ("good", "bad")), None)
        after = next((i for i in range(k + 1, len(found)) if label[i] in ("good", "bad")), None)
        near = [i for i in (before, after) if i is not None]
        if leads:
            near = [label[i] for i in near if found[i][3] and not found[i][2]]
            keep.append(not near or "good" in near)
        else:
            near = [label[i] for i in near]
            keep.append(bool(near) and ("good" in near if label[k] == "near" or b[4] else set(near) == {"good"}))
    return "\n".join(b[0] for b, good in zip(found, keep, strict=True) if good)


def made_page(rng):
    """A page of closed elements, of every kind that the rules tell apart."""
    common, rare = "the of and is it was to in that we".split(), "Zyx Berlin Kappa Register Munich Court Omega".split()

    def words(n, share):
        return " ".join(rng.choice(common if rng.random() < share else rare) for _ in range(n))

    def block(depth):
        kind = rng.randrange(10)
        if kind < 4 or depth > 2:
            tag = rng.choice(["p", "p", "div", "li", "h2", "blockquote"])
            text = words(rng.choice([2, 5, 20, 60]), rng.choice([0, 0.1, 0.25, 0.5, 0.6]))
            if rng.random() < 0.3:
                text += f" <a href='x'>{words(rng.choice([1, 8, 30]), 0.3)}</a> &amp; <b>{words(2, 0.5)}</b><br>{words(1, 0)}"
            return f"<{tag}{rng.choice(['', '', ' class=\"lead\"', ' class=\"sideBar x\"', ' hidden', ' role=search'])}>{text}</{tag}>"
        if kind == 4:
            return f"<script>if (a < b) {{ x('<p>{words(30, 0.5)}</p>') }}</script><!-- <p>{words(30, 0.5)}</p> --><hr>"
        tag = rng.choice(["div", "section", "article", "main", "nav", "footer", "header", "aside", "form"])
        return f"<{tag}>" + "".join(block(depth + 1) for _ in range(rng.randrange(5))) + f"</{tag}>"

    return "<html><head><title>T</title></head><body>" + "".join(block(0) for _ in range(rng.randrange(1, 9))) + "</body></html>"


def test_html_a_second_way():
    rng = random.Random(12)
    for page in (made_page(rng) for _ in range(1500)):
        assert html.extract(page) == second_text(page), page


def test_html_of_the_table_a_second_way():
    parquet = pytest.importorskip("pyarrow.parquet")
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    for page in parquet.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist():
        assert html.extract(page or "") == second_text(page or "")


HOSTILE = ["<a ", '<a ">" ', "<svg>", "<b>", "</b>", "<!", "<!--", "<div>", "<p>the of a", "<a href=x>y", "&#1", "<", "<i class='", "</p>", "<article><b>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_time_in_proportion(piece):
    began = time.perf_counter()
    html.extract(piece * (600_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_html_odd_markup():
    assert html.extract("<article><p>a &#" + "9" * 5000 + "; b &#0000000065; &#x41;</p></article>") == "a \ufffd b A A"
    assert html.extract("<article><p>one<svg/>two</p><svg><text>x</text></svg><noscript>three</p></article>") == "onetwo"
    assert html.extract("<article><p title='>'>a</p><p title='>b</p></article>") == "a\nb"
    assert html.extract("<p>a <b><article><p>" + "the of and it is " * 20 + "</b> x</p></article>").endswith("x")


def picture(rng, shape, kind):
    y, x = np.indices(shape)
    if kind == "smooth":
        return webp.join(np.stack([np.full(shape, 255), (3 * x + y) % 256, (2 * x + 5 * y + rng.integers(0, 2, shape)) % 256, (x * y) % 256], -1))
    if kind == "few":
        return np.array([0xFF000000, 0xFF00FF12, 0x80112233, 0xFFFFFFFF, 0xFF123456], np.uint32)[rng.integers(0, 5, shape)]
    return rng.integers(0, 2**32, shape, dtype=np.uint64).astype(np.uint32)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 5), (20, 33)])
@pytest.mark.parametrize("kind", ["smooth", "few", "noise"])
def test_webp_round_trips(shape, kind):
    rng = np.random.default_rng(4)
    px = picture(rng, shape, kind)
    for mode in range(14):
        data = webp.encode(px, predictor=mode, subtract=mode % 2 == 0, cross=(5, -7, 20) if mode % 3 else None, cache_bits=mode % 12, matches=mode % 4 < 3)
        assert (webp.images(data)[0] == px).all()
    if kind == "few":
        for n in (1, 2, 4, 5):
            part = np.minimum(px, np.unique(px)[: n][-1])
            assert (webp.images(webp.encode(part, palette=True, predictor=1, cache_bits=2))[0] == part).all()


def by_hand(*fields):
    """A WebP file of a stream given field by field: (value, bits), lowest bit first, or bits as they follow each other."""
    bits = "".join(f if isinstance(f, str) else f"{f[0]:0{f[1]}b}"[::-1] for f in fields)
    bits += "0" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    body = b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw + bytes(len(raw) % 2)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def head(width, height):
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)]


def one(symbol):
    """A simple prefix code of one symbol."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def two(a, b):
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


END, PLAIN = (0, 1), [(0, 1), (0, 1)]  # no further transform; no cache, no meta codes
#: A code for code lengths: 18 (long run of zeros) is 0, 1 is 10, 17 (short run of zeros) is 11.
RUNS = [(0, 1), (0, 4), (2, 3), (1, 3), (0, 3), (2, 3)]
FIRST = 0xFF000500
SLOT = (0x1E35A7BD * FIRST % 2**32) >> 31
BY_HAND = {
    "literals": ([*head(2, 1), END, *PLAIN, *one(20), *two(10, 11), *one(30), *one(255), *one(0), "0", "1"], [[0xFF0A141E, 0xFF0B141E]]),
    # green 7 is 0 and 258, a length of 3, is 1; distance symbol 1 is the left neighbour
    "reference": ([*head(6, 1), END, *PLAIN, *RUNS, (0, 1), "11", (4, 3), "10", "0", (127, 7), "0", (101, 7), "10", "0", (10, 7), *one(0), *one(0), *one(255), *one(1), "0001"], [[0xFF000700] * 6]),
    "reference, coloured": ([*head(6, 1), END, *PLAIN, *RUNS, (0, 1), "11", (4, 3), "10", "0", (127, 7), "0", (101, 7), "10", "0", (10, 7), *two(0, 9), *one(0), *one(255), *one(1), "00", "01", "00", "1"], [[0xFF000700, 0xFF090700, *[0xFF000700] * 4]]),
    # one bit of cache; green 5 is 0 and the cache's place is 1; five code lengths are stored
    "cache": ([*head(3, 1), END, (1, 1), (1, 4), (0, 1), *RUNS, (1, 1), (0, 3), (3, 2), "11", (2, 3), "10", "0", (127, 7), "0", (125 + SLOT, 7), "10", *one(0), *one(0), *one(255), *one(0), "011"], [[FIRST] * 3]),
    "subtract green": ([*head(1, 1), (1, 1), (2, 2), END, *PLAIN, *one(2), *one(1), *one(3), *one(255), *one(0)], [[0xFF030205]]),
    "predictor 12": ([*head(2, 2), (1, 1), (0, 2), (0, 3), (0, 1), *one(12), *one(0), *one(0), *one(255), *one(0), END, *PLAIN, *one(1), *one(1), *one(0), *one(0), *one(0)], [[0xFF010100, 0xFF020200], [0xFF020200, 0xFF040400]]),
    "predictor 1": ([*head(2, 2), (1, 1), (0, 2), (0, 3), (0, 1), *one(1), *one(0), *one(0), *one(255), *one(0), END, *PLAIN, *one(1), *one(1), *one(0), *one(0), *one(0)], [[0xFF010100, 0xFF020200], [0xFF020200, 0xFF030300]]),
    # green to red 32 / 32, green to blue 16 / 32, red to blue -32 / 32
    "cross-colour": ([*head(1, 1), (1, 1), (1, 2), (0, 3), (0, 1), *one(16), *one(0xE0), *one(32), *one(255), *one(0), END, *PLAIN, *one(8), *one(3), *one(20), *one(255), *one(0)], [[0xFF0B080D]]),
    # two colours, the second as its difference; eight samples to a pixel
    "palette": ([*head(5, 1), (1, 1), (3, 2), (1, 8), (0, 1), *two(1, 2), *one(1), *two(1, 3), *two(0, 255), *one(0), "111", "000", END, *PLAIN, *one(0b10110), *one(0), *one(0), *one(255), *one(0)], [[0xFF010203, 0xFF020304, 0xFF020304, 0xFF010203, 0xFF020304]]),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_webp_by_hand(name):
    fields, pixels = BY_HAND[name]
    assert webp.images(by_hand(*fields))[0].tolist() == pixels


def features_used(data):
    """Transforms and whether references occur, by the order of the encoder's choices."""
    bits = webp.Bits(data[20:])
    bits.at = 40
    return bits.read(1) and bits.read(2)


def test_payloads_in_every_form():
    rng = random.Random(8)
    prose = " ".join(rng.choice("some words that stand in no order at all but often".split()) for _ in range(700))
    ramp = "".join(chr(33 + 3 * i % 94) for i in range(5000))
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    for text, kind in (("", 3), ("ab" * 900, 3), (prose, 2), (ramp, 0), (f"{line} {line} {prose} " * 40, 2), ("é" * 70_000 + prose, 2), ("\n" + line * 30_000, None)):
        data = media.payload(text)
        stored = media.stored(data)
        assert media.samples(stored) == data and (kind is None or features_used(stored) == kind), text[:20]
    plain = webp.repeats(np.frombuffer(media.payload(prose), np.uint8))
    for at, length, far in plain:
        assert length >= webp.LEAST and media.payload(prose)[at : at + length] == media.payload(prose)[at - far : at - far + length]
    twice = media.payload(f"{line} {line} {line}")
    found = webp.repeats(np.frombuffer(twice, np.uint8))
    assert [(a, d) for a, _, d in found] == [(61, 61)] and found[0][1] >= 121
    assert len(media.stored(media.payload(f"{line} {prose[:800]} " * 20))) < len(media.stored(media.payload(f"{line} {prose[:800]} "))) * 2


def brute_feature(data):
    n, total = len(data), sum(data)
    size = n // 64
    bits = "".join("1" if sum(data[k * size : (k + 1) * size]) * 64 > total else "0" for k in range(64))
    shares = [sum(b // 32 == k for b in data) * 1000 // n for k in range(8)]
    return f"{int(bits, 2):016x}:{total // n}:" + "-".join(map(str, shares))


def test_webp_malformed():
    data = webp.encode(picture(np.random.default_rng(1), (6, 6), "smooth"), predictor=11)
    rng = random.Random(2)
    for _ in range(200):
        broken = bytearray(data)
        broken[rng.randrange(20, len(data))] = rng.randrange(256)
        try:
            webp.images(bytes(broken))
        except (ValueError, IndexError):
            pass


def test_media(spark, texts):
    some = texts[: len(ODD) + 50] + ["big " * 400_000]
    files = {r.doc_id: bytes(r.media) for r in media.store(frame(spark, some)).collect()}
    stored = media.load(media.store(frame(spark, some))).collect()
    for r in stored:
        assert bytes(r.samples) == media.payload(some[r.doc_id] or "")
    got = {r.doc_id: r for r in media.round_trip(frame(spark, some)).collect()}
    assert len(got) == len(some)
    for i, x in enumerate(some):
        want = (x or "").encode()
        padded = want + bytes(max(64, -(-len(want) // 64) * 64) - len(want))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(want), len(padded), hashlib.sha256(padded).hexdigest())
        import zlib

        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(files[i]) and r.media_sha256 == hashlib.sha256(files[i]).hexdigest()
        assert r.feature == brute_feature(padded)
    assert got[0].feature == got[1].feature and got[0].media_sha256 == got[1].media_sha256


def test_empty_tables(spark):
    none = frame(spark, [])
    assert tokens.token_counts(none, PATH).count() == bpe.round_trip(none, PATH).count() == secrets.scan_secrets(none).count() == html.main_text(none, html="text", out="main").count() == media.round_trip(none).count() == 0
