"""The training-data operators against brute force, exact round trips and held-out labels, and on odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat, html_extract, induced_sort, knn, line_dedup, media, mixing, ngram_join, packing, quality, suffix_dedup

ODD = [
    (1, "the cat sat on the mat and then it left again", "en", "b", 1), (2, "the cat sat on the mat and then it left again", "en", "b", 1),
    (2, "the cat sat on the mat and then it left again", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
    (None, "a line of several words here\nanother line of several words\n\n", "en", None, 3), (5, "x " * 30000, "en", "b", 60000),
    (6, "a line of several words here\nanother line of several words", "en", "", 3), (7, "ünï\x00\x1f <|im_end|> \\ 😀", "xx", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"th": F.lit(1), "size": F.lit(2), "spans": F.lit("x"), "score": F.lit(0.5), "tokens": F.lit(3)}).cache()


# N-gram Jaccard join


def brute_links(rows):
    sets = []
    for d, t in rows:
        w = [x for x in (t or "").lower().encode().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root[i], []).append(d)
    return sorted(((d, min(x for x in least[root[i]]), len(linked[i])) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(seed=1):
    rng, rows = random.Random(seed), []
    for g in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
            rows.append((len(rows), " ".join(w)))
    return [*rows, (900, ""), (901, None)]


def test_ngram_join_is_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.similar_documents(df).collect()), key=str)
    assert got == brute_links(rows)


def test_ngram_join_splits_large_groups_into_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1200):  # more than two blocks of near copies
        w = list(base)
        w[i % 120] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {1199}


def test_ngram_join_of_a_group_without_any_link(spark):
    words = [f"w{i}" for i in range(28)]
    rows = [(k, " ".join(words[:n])) for k, n in enumerate((28, 22, 17))]  # 24, 18 and 13 runs: probable, but too unlike in size
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]


def test_ngram_join_odd(spark, odd):
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.similar_documents(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0)} <= got
    assert ngram_join.similar_documents(odd.limit(0)).count() == 0


def test_bayesian_steps_keep_pairs_at_the_threshold():
    for n, least in ngram_join.least_matches():
        assert least < 0.8 * n
    assert ngram_join.least_matches()[-1][0] == ngram_join.BANDS * ngram_join.ROWS


# Mixing


def test_mix_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(5000, "w " * 10, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        taken = sum(r["size"] * r["copies"] for r in rs)
        assert abs(taken - rs[0]["target"]) <= 20 and rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
        assert {r["copies"] for r in rs} <= {k + int(rs[0]["target"] // rs[0]["source_size"]) for k in (0, 1)}
    assert by["tiny"][0]["copies"] == 3
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in mixing.mix(df.repartition(7)).collect())


def test_mix_odd(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if not r["text"]} == {0}
    assert mixing.repeat(mixing.mix(odd)).count() == sum(r["copies"] for r in got)
    assert mixing.mix(odd.limit(0)).count() == 0


# Packing


def test_encoder_gives_the_tokenizers_ids():
    rng = random.Random(1)
    alphabet = "ab'stredlvm  \n\t  é9½²ß'.!<|>日本😀ÆẞⅫ\x1c\x85_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["don't we've", "'s", "<|endoftext|>a", "", " ", "a'll b"]
    e = packing.Encoder(packing.tokenizer_path())
    want = [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want


def test_plan_fills_without_gaps():
    use = {}
    runs = packing.plan({2048: 5, 1500: 3, 548: 4, 300: 7, 10: 1000, 1: 3})
    for length, _, count, per, first, offset in runs:
        for i in range(count):
            use.setdefault(first + i // per, []).append((offset + i % per * length, length))
    for slots in use.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(use) == -(-sum(k * n for k, n in {2048: 5, 1500: 3, 548: 4, 300: 7, 10: 1000, 1: 3}.items()) // 2048)


def test_packing_odd(spark, odd):
    pieces = packing.tokenize(odd).withColumn("crc", F.crc32("tokens")).cache()
    got = packing.pack(pieces, ["doc_id", "piece", "start", "crc"]).collect()
    whole = {}
    for r in got:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["tokens"]) == 4 * r["length"]
    for slots in whole.values():
        assert sum(n for _, n in slots) <= 2048 and sorted(o for o, _ in slots)[0] == 0
    assert sum(1 for r in got if r["doc_id"] == 2) == 2 and all(r["length"] == 1 for r in got if r["doc_id"] in (3, 4))
    ids = sorted((r for r in got if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert [r["length"] for r in ids[1:]] == [2048] * (len(ids) - 1)
    assert packing.pack(pieces.limit(0), ["doc_id"]).count() == 0
    named = pieces.withColumns({"sequence_id": F.lit("x"), "offset": F.lit("y"), "th": F.lit(1)})
    assert sorted(r["length"] for r in packing.pack(named, ["doc_id", "piece", "start", "crc"]).filter("offset >= 0 AND sequence_id >= 0").collect()) == sorted(r["length"] for r in got)


# Media


@pytest.mark.parametrize("text", ["", "a" * 64, "b" * 65, "é" * 40000, "x" * (1 << 20) + "yz", None, "\x00\x00"])
def test_media_round_trip(text):
    p = media.payload(text)
    assert len(p) % 64 == 0 and p and media.decode_grey(media.encode_grey(p)) == p


class Bits:
    """A writer of images for the decoder, with every feature of the format."""

    def __init__(self, width, height):
        self.w = media._Writer()
        for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.w.put(v, n)

    def flat(self, alphabet, used, length):
        """A code of `used` symbols, each of `length` bits."""
        self.w.put(0, 1)
        order = media._LENGTH_ORDER
        last = max(order.index(length), order.index(0)) + 1
        self.w.put(last - 4 if last > 4 else 0, 4)
        for s in order[: max(4, last)]:
            self.w.put(int(s in (length, 0)), 3)
        self.w.put(0, 1)
        one = max(length, 0) == length and length > 0
        for s in range(alphabet):  # two symbols of one bit: the smaller is 0
            self.w.put(int(s < used) if one else 0, 1)

    def code(self, symbol, length):
        for k in range(length - 1, -1, -1):
            self.w.put(symbol >> k & 1, 1)

    def single(self, symbol):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.w.put(v, n)

    def pair(self, a, b):
        for v, n in ((1, 1), (1, 1), (1, 1), (a, 8), (b, 8)):
            self.w.put(v, n)

    def done(self):
        return media._riff(self.w.bytes())


def plain_codes(b):
    for used in (256, 256, 256, 256):
        b.flat(280 if not hasattr(b, "seen") else 256, used, 8)
        b.seen = True
    b.single(0)


def pixels(b, image):
    for a, r, g, bl in image.reshape(-1, 4).tolist():
        for v in (g, r, bl, a):
            b.code(v, 8)


def test_decoder_undoes_predictor_cross_and_green():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    for mode in range(14):
        b = Bits(7, 9)
        modes = np.full((3, 2), mode)
        factors = rng.integers(0, 256, (3, 2, 4), dtype=np.uint8)
        coded = image.copy()
        coded[..., 1] -= coded[..., 2]
        coded[..., 3] -= coded[..., 2]
        crossed = media._cross(coded, factors, 2, False)
        coded = media._predict(crossed, modes, 2, False)
        # Steps are undone from the last to the first.
        b.w.put(1, 1), b.w.put(2, 2)
        b.w.put(1, 1), b.w.put(1, 2), b.w.put(0, 3), b.w.put(0, 1)
        plain_codes(b)
        pixels(b, factors)
        b.w.put(1, 1), b.w.put(0, 2), b.w.put(0, 3), b.w.put(0, 1)
        b.single(mode), b.single(0), b.single(0), b.single(255), b.single(0)
        b.w.put(0, 1), b.w.put(0, 1), b.w.put(0, 1)
        del b.seen
        plain_codes(b)
        pixels(b, coded)
        assert (media.decode(b.done()) == image).all(), mode


def test_decoder_reads_palette():
    index = np.array([[0, 1, 1, 0, 1, 0, 0, 1, 1]])
    palette = np.array([[255, 1, 2, 3], [255, 200, 100, 50]], np.uint8)
    b = Bits(9, 1)
    b.w.put(1, 1), b.w.put(3, 2), b.w.put(1, 8), b.w.put(0, 1)
    plain_codes(b)
    pixels(b, np.array([palette[0], palette[1] - palette[0]], np.uint8))
    b.w.put(0, 1), b.w.put(0, 1), b.w.put(0, 1)
    packed = [sum(int(v) << k for k, v in enumerate(index[0][i : i + 8])) for i in (0, 8)]
    b.pair(*sorted(packed)), b.single(0), b.single(0), b.single(255), b.single(0)
    for p in packed:
        b.w.put(int(p == max(packed)), 1)
    assert (media.decode(b.done()) == palette[index]).all()


def test_decoder_reads_back_references_and_cache():
    b = Bits(6, 2)
    b.w.put(0, 1)
    b.w.put(1, 1), b.w.put(1, 4)  # a cache of two colours
    b.w.put(0, 1)
    # Green: 7 (literal), 256 + 3 (a length of 4), 280 + 0 and 280 + 1 (cache): four codes of two bits
    lengths = [0] * 282
    for s in (7, 259, 280, 281):
        lengths[s] = 2
    b.w.put(0, 1)
    order = media._LENGTH_ORDER
    b.w.put(order.index(2) + 1 - 4, 4)
    for s in order[: order.index(2) + 1]:
        b.w.put(int(s in (0, 2)), 3)
    b.w.put(0, 1)
    for n in lengths:
        b.w.put(int(n == 2), 1)
    b.single(1), b.single(2), b.single(255)
    b.single(1)  # distance code 2 is the pixel to the left
    codes = {7: 0, 259: 1, 280: 2, 281: 3}
    value = 0xFF010702
    slot = 0x1E35A7BD * value % 2**32 >> 31
    for s in (7, 259, 280 + slot, 280 + slot, 259, 7, 7, 280 + slot):
        b.code(codes[s], 2)
    got = media.decode(b.done())
    assert got.reshape(-1, 4).tolist() == [[255, 1, 7, 2]] * 12


def test_decoder_refuses_what_is_broken():
    good = media.encode_grey(b"x" * 64)
    for bad in (b"", good[:30], b"RIFX" + good[4:], good[:21] + b"\xff" + good[22:40]):
        with pytest.raises(ValueError):
            media.decode(bad)
    b = Bits(4, 1)  # a distance beyond its alphabet
    b.w.put(0, 3)
    for symbol in (1, 2, 3, 255, 41):
        b.single(symbol)
    with pytest.raises(ValueError):
        media.decode(b.done())
    b = Bits(4, 1)  # a colour cache of no bits
    b.w.put(0, 1), b.w.put(1, 1), b.w.put(0, 4), b.w.put(0, 1)
    for symbol in (1, 2, 3, 255, 0):
        b.single(symbol)
    with pytest.raises(ValueError):
        media.decode(b.done())


def test_decoder_never_fails_otherwise():
    rng = random.Random(5)
    files = media.encode_all([media.payload("".join(rng.choice("abcdefgh ") for _ in range(400)) * k) for k in (1, 1, 3)])
    for trial in range(400):
        data = bytearray(files[trial % 3])
        if trial % 2:
            at = rng.randrange(20, len(data))
            data[at] ^= 1 << rng.randrange(8)
        else:
            body = data[20 : rng.randrange(21, len(data))]
            data = bytearray(media._riff(bytes(body)))
        for decode in (media.decode, lambda x: media.greens([x] * media.ABREAST)):
            try:
                decode(bytes(data))
            except ValueError:
                pass


def test_images_side_by_side_are_those_alone():
    rng = random.Random(6)
    texts = ["", "a" * 700, "ab" * 300, "abcdefghijklmnop" * 200, "é" * 9000, "Er Er ingestau " * 900]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ,.\n") for _ in range(rng.randrange(2000))) * rng.choice((1, 1, 4)) for _ in range(40)]
    payloads = [media.payload(t) for t in texts]
    stored = media.encode_all(payloads)
    assert media.decode_all(stored) == payloads
    images = [f for x in stored for f in media.files(x)]
    assert media.greens(images) == [media.decode(f)[..., 2].tobytes() for f in images]
    assert stored == [media.encode_grey(x) for x in payloads]


def test_media_odd(spark, odd):
    got = media.read_media(media.store_texts(odd)).collect()
    assert len(got) == len(ODD) and all(bytes(r["samples"]) == media.payload(t) for r, (_, t, *_) in zip(got, ODD))
    assert media.read_media(media.store_texts(odd.limit(0))).count() == 0


# Line dedup


def brute_lines(rows, least):
    lines = {(d if d is not None else -1): [x for x in (t or "").split("\n")] for d, t in rows}
    seen, gone = {}, {d: set() for d in lines}
    runs = []
    for d in sorted(lines):
        ink = [(j, x) for j, x in enumerate(lines[d]) if x.split()]
        for s in range(len(ink)):
            for e in range(s, len(ink)):
                run = tuple(x for _, x in ink[s : e + 1])
                if sum(len(x.split()) for x in run) >= least:
                    runs.append((run, d, s, [j for j, _ in ink[s : e + 1]]))
    for run, d, s, js in sorted(runs, key=lambda r: (r[1], r[2])):
        if seen.setdefault(run, (d, s)) < (d, s):
            gone[d].update(js)
    return {d: "\n".join(x for j, x in enumerate(v) if j not in gone[d]) for d, v in lines.items()}


def test_line_dedup_is_brute_force(spark):
    rng, rows = random.Random(5), []
    for d in range(60):
        rows.append((d, "\n".join(rng.choice(["a b", "c", "d e f", "", "g h i j", "k", " ", "long line of six words here", f"own {d} {rng.random()}"]) for _ in range(rng.randrange(12)))))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, line_dedup.MIN_WORDS)


def test_line_dedup_odd(spark, odd):
    got = line_dedup.dedup_lines(odd).collect()
    texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in got}
    assert len(got) == len(ODD) and texts[(1, 1)] and texts[(2, 1)] == "" and texts[(3, None)] is None
    assert texts[(6, 3)] == "" and texts[(None, 3)].startswith("a line")  # a null id comes first
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# Quality


def test_quality_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out()).select("score", "quality", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_quality_gradients():
    rng = np.random.default_rng(1)
    x, counts, y = rng.normal(size=(9, quality.FEATURES)).astype(np.float32), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0], np.float32)
    m = quality.Model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := m.scores(x, counts), 1 - s)))
    for k, g in m._gradients(x, counts, y).items():
        at = tuple(0 for _ in g.shape)
        m.p[k][at] += 1e-5
        up = loss()
        m.p[k][at] -= 2e-5
        down = loss()
        m.p[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(float(g[at]), abs=1e-4), k


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.train(odd, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0


# HTML


def test_html():
    prose = "The cat and the dog were in the house for a long time with the others. " * 5
    page = (
        f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies.</div><article><h1>Title &amp; more</h1><p><b>{prose}<br><p>Short.</p><div class=ad>Buy the thing now</div><form>Name <input></form>"
        f"<aside>By the way</aside></article><div id='comments'><p>{prose}</p></div><footer>&copy; x</footer>"
    )
    assert html_extract.main_text(page) == f"Title & more\n\n{prose.strip()}\n\nShort."
    page = f"<div><h2>A title of it</h2><p>{prose}</p><p>Short one.</p></div><ul><li><a href=x>one</a><li><a href=y>two</a></ul>"
    assert html_extract.main_text(page) == f"A title of it\n\n{prose.strip()}\n\nShort one."
    assert html_extract.main_text(None) == "" == html_extract.main_text("<nav><a>x</a></nav>")
    assert html_extract.main_text("<p>1 < 2 &lt;b&gt; <a href='x>y'>l</a>  z") == "1 < 2 <b> l z"


PROSE = "The cat and the dog were in the house for a long time with the others. " * 5


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout no-sidebar"><p>{}</p></div>', '<div id="page" class="has-header"><p>{}</p></div>', '<div class="social-science"><p>{}</p></div>',
        '<div class="share-price"><p>{}</p></div>', '<article><section class="related-work"><p>{}</p></section></article>',
        '<body class="widget"><div class="menu"><a href="/">Home</a></div><p>{}</p></body>', '<div class="comments-closed-notice-free"><p>{}</p></div>',
        '<div class="siteHeader"><p>{}</p></div><p>{}</p>', '<div class="site-header">x</div><p>{}</p><div class="related-posts"><p>{}</p></div>',
        '<p>{}</p><ul class="comment-list"><li id="comment-17"><p>{}</p></ul>', '<div class="ad-slot"><p>{}</p></div><div><p>{}</p></div>',
        "<article><p>{}</p><canvas></canvas><object></object></article>",
    ],
)
def test_html_names_count_as_a_whole(page):
    """Prose stands under a name that only looks like one of a menu, or beside one that is: it is there once."""
    assert html_extract.main_text(page.replace("{}", PROSE)) == PROSE.strip()


def test_html_names_say_nothing_where_all_prose_stands_under_them():
    page = f'<div class="widget"><p>{PROSE}</p><p>{PROSE}</p></div><nav>Home</nav>'
    assert html_extract.main_text(page) == "\n\n".join([PROSE.strip()] * 2)
    assert html_extract.main_text(f'<div class="cookie-notice"><p>{PROSE}</p></div><nav>Home</nav>') == ""


@pytest.mark.parametrize(
    "prose",
    [
        "Кошка долго сидела у окна и смотрела на улицу. Потом она спрыгнула на пол. " * 4, "猫は窓辺に長い間座っていました。それから床に飛び降りて、台所へ歩いていきました。" * 4,
        "Kot długo siedział przy oknie. Potem zeskoczył na podłogę i poszedł do kuchni. " * 4, "고양이는 창가에 오래 앉아 있었습니다. 그리고 부엌으로 걸어갔습니다. " * 5,
    ],
)
def test_html_other_languages(prose):
    page = f"<ul><li><a href=x>Один</a><li><a href=y>Два</a></ul><div>{prose}</div><div><a href=z>{'ссылка ' * 30}</a></div>"
    assert html_extract.main_text(page) == prose.strip()


def test_html_keeps_formulas_and_what_stands_in_for_objects():
    page = f"<article><p>{PROSE}<math><mi>x</mi></math> is<object> a thing</object>.</p></article>"
    assert html_extract.main_text(page) == PROSE + "x is a thing."


SOME = "The house by the lake was sold to a family from the city in the spring of that year, as the paper said."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # Comments are never the text, however long they are and however short the article.
        (f'<div><h1>A title</h1><p>{SOME}</p></div><div class="comments"><p>{PROSE}</p><p>{PROSE}</p></div>', ["A title", SOME]),
        (f'<div id="comments"><p>{PROSE}</p><p>{PROSE}</p></div>', []), (f'<div class="opinions"><p>{PROSE}</p><p>{PROSE}</p></div><p>{SOME}</p>', [SOME]),
        (f'<article class="comment"><p>{PROSE}</p></article><article class="comment"><p>{PROSE}</p></article>', []),
        (f'<section class="user-comments"><article><p>{PROSE}</p></article></section><div><p>{PROSE}</p></div>', [PROSE.strip()]),
        # The title in the header of an article stays, with or without a line below it.
        (f"<article><header><h1>Title</h1><p>By A. Writer</p></header><p>{PROSE}</p></article>", ["Title", PROSE.strip()]),
        (f"<article><header><h1>Title</h1></header><p>{PROSE}</p></article>", ["Title", PROSE.strip()]),
        # Links of an article are its text; those outside are not.
        (f"<article><p>{PROSE}</p><ul><li><a href=a>First source</a><li><a href=b>Second source</a></ul></article><ul><li><a href=c>Home</a></ul>", [PROSE.strip(), "First source", "Second source"]),
        (f"<p>This website uses cookies so that you have the best time here. By going on you agree to the use of them as we say in our policy. {SOME}</p><p>{PROSE}</p>", [PROSE.strip()]),
        (f"<article><p>We found that the site uses cookies, as the report says. {PROSE}</p></article>", [f"We found that the site uses cookies, as the report says. {PROSE}".strip()]),
        # Pages that mark no article.
        (f"<div><h2>Of the lake</h2><p>{PROSE}</p><p>Soon.</p><p>{PROSE}</p></div><div><a href=x>{SOME}</a></div><p>© The paper</p>", ["Of the lake", PROSE.strip(), "Soon.", PROSE.strip()]),
        (f"<main><nav><a href=a>Home</a></nav><h1>Of the lake</h1><p>{PROSE}</p><footer>All rights</footer></main><p>{PROSE}</p>", ["Of the lake", PROSE.strip()]),
    ],
)
def test_html_pages(page, want):
    assert html_extract.main_text(page) == "\n\n".join(want)


def test_html_odd(spark):
    df = spark.createDataFrame([(1, None, "u"), (1, "<article>x</article>", None), (None, "", "u")], "page_id long, html string, text string")
    assert [r["text"] for r in html_extract.extract(df).collect()] == ["", "x", ""]
    assert html_extract.extract(df.limit(0)).count() == 0


# Suffix-array dedup


@pytest.mark.parametrize("spills", [False, True])
def test_induced_sort_is_the_suffix_array(monkeypatch, tmp_path, spills):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(induced_sort, "QUEUED", 500)
    written = []
    write = induced_sort.Spill.write
    monkeypatch.setattr(induced_sort.Spill, "write", lambda self, arrays: written.append(1) or write(self, arrays))
    for trial in range(80):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 150))
        if trial % 3 == 0:
            t = np.concatenate([t, t[: len(t) // 2], t])
        limit, x = int(rng.integers(3, 400)), t.tolist()
        sa, lcp = induced_sort.suffix_order(t, limit, str(tmp_path / "queues") if spills else None, 2, 2)
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert [x[i : i + limit] for i in sa] == [x[i : i + limit] for i in want]
        for r in range(1, len(x)):
            a, b = x[sa[r] :], x[sa[r - 1] :]
            k = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert lcp[r] == min(k, limit)
    assert bool(written) == spills and not (spills and list((tmp_path / "queues").iterdir()))


def test_induced_sort_spills_at_its_own_bound(tmp_path, monkeypatch):
    written = []
    write = induced_sort.Spill.write
    monkeypatch.setattr(induced_sort.Spill, "write", lambda self, arrays: written.append(1) or write(self, arrays))
    text = np.random.default_rng(1).integers(1, 60, suffix_dedup.SORTED)
    sa, _ = induced_sort.suffix_order(text, suffix_dedup.LENGTH, str(tmp_path))
    raw = text.astype(np.uint8).tobytes()
    assert written and all(raw[sa[i] : sa[i] + 100] <= raw[sa[i + 1] : sa[i + 1] + 100] for i in range(0, len(sa) - 1, 97))


def brute_bytes(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out[d] = bytes(x for x, g in zip(b, gone) if not g)
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 0: every hash's windows meet one by one
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef ") for _ in range(400))
    texts = ["a" * 2000, "ab" * 400, "xyz" * 50 + "q" + "xyz" * 60, base, base[:200] + "!" + base[200:], base[100:300] * 3, "", None, "é" * 49, "é" * 60, "a" * 99, base[50:149], base[50:150], "zz" + base[17:311] + "yy" + base[:130]]
    texts += [base[i : i + 150] + base[i // 2 : i // 2 + 120] for i in range(0, 200, 7)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_bytes(rows)


def test_suffix_dedup_of_periods_that_differ_in_one_byte(spark):
    """The least hash recurs in such texts, so that their chunks are as long as chunks can be."""
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        period = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(65))
        text = (period * 9)[: rng.randint(400, 552)]
        at = rng.randrange(120, 300)
        rows += [text, text[:at] + "#" + text[at + 1 :]]
    rows = list(enumerate(rows))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r["doc_id"]: bytes(r["kept"]) for r in got.collect()}
    assert kept == brute_bytes(rows)
    assert suffix_dedup.WINDOWS <= suffix_dedup.LENGTH + 1


def test_suffix_dedup_odd(spark, odd):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and {len(r["kept"]) for r in got if r["doc_id"] in (3, 4)} == {0}
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


# Top-k


@pytest.mark.parametrize("cells, queries, vectors", [(128, 1024, 8192), (5, 3, 16)])
def test_top_k_is_brute_force(spark, monkeypatch, cells, queries, vectors):
    monkeypatch.setattr(knn, "QUERIES", queries)
    monkeypatch.setattr(knn, "VECTORS", vectors)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(2)
    x[50:150] = x[50]  # a hot vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (500, [float("nan")] * 8), (600, [1.0, None] * 4), (700, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in knn.top_k(knn.whole_vectors(df), F.col("vec_id") % 50 == 0, 10, cells).collect())
    v = np.floor(1024 * x).astype(int)
    want = []
    for q in range(0, 300, 50):
        s = v @ v[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    assert got == sorted(want)
    assert knn.top_k(knn.whole_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_scores_are_exact_or_refused(spark):
    x = [1_500_001, 1_500_002, 2_500_001, 2_500_003]  # products need 63 bits
    df = spark.createDataFrame([(i, [float(v), 1.0]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in knn.top_k(knn.whole_vectors(df), F.col("vec_id") == 0).collect()}
    assert got == {i: 1024 * x[0] * 1024 * x[i] + 1024**2 for i in (1, 2, 3)}
    df = spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        knn.top_k(knn.whole_vectors(df), F.col("vec_id") == 0).collect()


# Chat


def test_chat_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", "\\<|\\\\"), (2, None, None, None), (None, 3, "assistant", "é\n😀"), (3, 0, "assistant", "")]
    rows += [(4, 0, "us\ner\\", "t"), (4, 1, "x<|", "é" * (3 * chat.DELTA + 1)), (5, 2, "user", "twice"), (5, 2, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.render(chat.rebuild(chat.conversations_as_events(df))).collect()}
    assert chat.parse(got[1]["formatted"]) == [("user", said), ("assistant", said), ("assistant", "\\<|\\\\")]
    assert chat.parse(got[2]["formatted"]) == [("", "")] and len(got) == 6
    assert chat.parse(got[4]["formatted"]) == [("us\ner\\", "t"), ("x<|", "é" * (3 * chat.DELTA + 1))]
    assert chat.parse(got[5]["formatted"]) == [("user", "twice")] * 2
    for r in got.values():
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert [chat.unescape(s) for s in spans] == [t for role, t in chat.parse(r["formatted"]) if role == "assistant"]
    assert chat.render(chat.rebuild(chat.conversations_as_events(df.limit(0)))).count() == 0


def test_chat_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "he"), (1, 3, "delta", 1, "assistant", "llo"), (1, 4, "message", 2, "user", "more"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, "assistant", "hey"), (1, 7, "edit", 0, None, "hi!"), (1, 8, "edit", 9, None, "x"),
        (1, 9, "message", None, "user", "bye"), (1, 10, "delete", None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = chat.rebuild(df.repartition(5)).first()["messages"]
    assert [(m["role"], m["text"]) for m in got] == [("user", "hi!"), ("assistant", "hey")]


@pytest.mark.parametrize(
    "events, want",
    [
        ([("start", None, "a", None), ("delta", None, None, "he"), ("delta", None, None, "llo"), ("end", None, None, None)], [("a", "hello")]),
        ([("delta", None, "a", "he"), ("delta", None, "a", "llo")], [("a", "hello")]),
        ([("message", None, "u", "x"), ("delta", None, "a", "he"), ("delta", None, "a", "llo")], [("u", "x"), ("a", "hello")]),
        ([("start", None, "a", "x"), ("end", None, None, None), ("delta", None, "b", "y")], [("a", "x"), ("b", "y")]),
        ([(None, None, "a", "x")], [("a", "x")]),
        ([("start", 3, "a", "x"), ("start", 1, "b", "y"), ("delta", 3, None, "z")], [("b", "y"), ("a", "xz")]),
        ([("start", 0, "u", "x"), ("start", 1, "a", "y"), ("regenerate", 1, None, None), ("delta", None, None, "z"), ("end", None, None, None)], [("u", "x"), ("a", "z")]),
        ([("edit", None, None, "x"), ("delete", 7, None, None), ("end", None, None, None)], []),
        ([("start", None, "a", "x"), ("delete", None, None, None), ("start", None, "b", "y")], [("b", "y")]),
        ([], []),
    ],
)
def test_chat_fold(events, want):
    assert chat.fold(events) == want


@pytest.mark.parametrize("turn", [None, 0, 9])
def test_chat_refuses_unknown_kinds(turn):
    with pytest.raises(ValueError):
        chat.fold([("message", 0, "u", "x"), ("redo", turn, None, None)])
