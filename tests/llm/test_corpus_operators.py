"""Near duplicates, mixing, sampling, media and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwise.llm import jaccard_join, mixing, pieces, queries, webp

MODEL = queries.PIECE_MODEL
DOCS = "doc_id long, text string"


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    links = [[j for j in range(len(rows)) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(rows))]
    while True:
        new = [min([label[i], *[label[j] for j in links[i]]]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids[label[i]] = min(ids.get(label[i], d), d)
    return {d: (len(sets[i]), ids[label[i]]) for i, (d, _) in enumerate(rows)}


def family(seed, n, length, edits, bases):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passages = [[r.choice(words) for _ in range(30)] for _ in range(2)]
    own = [[r.choice(words) for _ in range(r.randint(*length))] for _ in range(bases)]
    rows = []
    for i in range(n):
        b = list(r.choice(own))
        for _ in range(r.randint(0, edits)):
            b[r.randrange(len(b))] = r.choice(words)
        if r.random() < 0.2:
            b += r.choice(passages)
        if r.random() < 0.1:
            b = b[: r.randint(1, len(b))]
        rows.append(((i * 7) % n + n * (i % 2), " ".join(b)))
    return rows


@pytest.mark.parametrize("shape", [(1, 160, (100, 150), 10, 1), (2, 160, (20, 60), 4, 4), (3, 160, (3, 12), 2, 8)])
def test_components(spark, shape):
    rows = family(*shape)
    got = {x.id: (x.size, x.component) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == plain_components(rows)


def test_components_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a B"), (5, "A b"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "A B C D E F"), (None, None), (7, "z " * 5000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"k": F.lit(1), "_k": F.lit(2)})
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert sorted((x.id, x.size, x.component) for x in got if x.id) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (6, 2, 6), (7, 1, 7)]
    assert {x.component for x in got if x.id is None and x.size} == {6}
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard_join.without_copies(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id or 0 for x in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_mixing_meets_its_targets(spark):
    r = random.Random(1)
    rows = [(i, "s" + str(min(int(r.expovariate(0.5)), 5)), " ".join(["w"] * r.randint(1, 30))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(docs, repeats=3.0).toPandas()
    by = got.groupby("source").agg(tokens=("n_tokens", "sum"), epochs=("epochs", "first"), weight=("weight", "first"))
    taken = (got["copies"] * got["n_tokens"]).groupby(got["source"]).sum()
    assert abs(by.epochs.max() - 3) < 1e-3 and abs(by.epochs.min() - 1) < 1e-9 and abs(by.weight.sum() - 1) < 1e-9
    budget = by.epochs * by.tokens
    assert ((taken <= budget + 1e-6) & (taken > budget - 60)).all() and (got["copies"] >= 1).all()
    assert np.allclose(budget / budget.sum(), by.weight)
    h = mixing.mixed(docs, entropy=0.9).toPandas().groupby("source").weight.first()
    assert abs(-(h * np.log(h)).sum() / np.log(len(h)) - 0.9) < 1e-3
    # the part of a pass is a prefix of the seeded permutation
    place = {x.doc_id: x.p for x in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("doc_id")), 1).alias("p")).collect()}
    for _, own in got.groupby("source"):
        more = own[own["copies"] > own["epochs"].astype(int)]
        less = own[own["copies"] == own["epochs"].astype(int)]
        assert more.empty or less.empty or max(place[i] for i in more["doc_id"]) < min(place[i] for i in less["doc_id"])
    out = mixing.arranged(docs, repeats=1.5)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 3000


def test_mixing_edge_cases(spark):
    rows = [(1, None, "a b"), (2, "s", None), (3, "s", ""), (None, "s", "a"), (4, "t", "a b c"), (4, "t", "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"rows": F.lit(1), "_turn": F.lit(2)})
    got = mixing.mixed(docs, repeats=2.0).collect()
    assert len(got) == 6 and all(x.copies >= 1 for x in got)
    assert mixing.arranged(docs, repeats=2.0).columns == docs.columns
    assert mixing.mixed(docs.limit(0), repeats=2.0).count() == 0


def exact_segmentations(vocab, word):
    """Every segmentation of a word with its weight."""
    if not word:
        return {(): 0.0}
    out = {}
    for i, piece in enumerate(vocab.bytes):
        if piece and word.startswith(piece) and not (len(piece) == 1 and vocab.byte_id[piece[0]] == i):
            out |= {(i, *rest): vocab.weight[i] + w for rest, w in exact_segmentations(vocab, word[len(piece) :]).items()}
    return out


def test_gumbel_top_k_is_exact():
    vocab = pieces.Vocabulary(open(MODEL, "rb").read(), 4.0)
    every = exact_segmentations(vocab, b" than")
    total = np.logaddexp.reduce(list(every.values()))
    p = {s: float(np.exp(w - total)) for s, w in every.items()}
    n, first, second, estimate = 6000, {}, {}, 0.0
    for _, found in pieces.samples_of(pa.array(["than"] * n), np.arange(n, dtype=np.uint64), 2, pieces.Lattices(vocab)):
        for samples in found:
            a, b = tuple(samples[0][0].tolist()), tuple(samples[1][0].tolist())
            assert a != b and samples[0][2] > samples[1][2] and abs(samples[0][1] - np.log(p[a])) < 1e-9
            first[a], second[b] = first.get(a, 0) + 1, second.get(b, 0) + 1
            estimate += sum(np.exp(s[1] - s[3]) for s in samples)
    for s in sorted(p, key=p.get)[-4:]:
        assert abs(first.get(s, 0) / n - p[s]) < 0.03
        assert abs(second.get(s, 0) / n - sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s)) < 0.03
    assert abs(estimate / n - 1) < 0.05  # weighted by inverse inclusion, probabilities add up to 1


def test_samples_round_trip(spark):
    texts = [None, "", " ", "a", "  x \n y", "Hello  world\nfoo ñ 漢字🙂▁", "tab\there\r\n", "the cat sat " * 300, "z" * 3000, "\n\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "a")], DOCS).withColumn("samples", F.lit("clash"))
    out = pieces.decoded(pieces.sampled(docs, MODEL, k=4), F.col("samples")[0]["ids"], MODEL)
    rows = out.collect()
    assert len(rows) == 11
    for x in rows:
        assert x.decoded == x.text if x.text is not None else x.samples is None
        if x.samples:
            assert len({tuple(s.ids) for s in x.samples}) == len(x.samples) <= 4 and [s.score for s in x.samples] == sorted((s.score for s in x.samples), reverse=True)
    assert len([x for x in rows if x.doc_id == 3 and x.samples == rows[3].samples]) == 2
    moved = {x.doc_id: x for x in pieces.sampled(docs.repartition(3), MODEL, k=4, decode=True).collect()}
    assert all(moved[x.doc_id].samples == x.samples and moved[x.doc_id].decoded == x.decoded for x in rows)
    assert pieces.sampled(docs.limit(0), MODEL).count() == 0


class Stream(webp.Writer):
    """Writes lossless streams with every feature, for reading back."""

    def code(self, lengths):
        """A prefix code by explicit lengths (at most 15), each length written with four bits."""
        self.put(0, 1)
        self.put(15, 4)
        for place in webp.LENGTH_ORDER:
            self.put(4 if place < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)
        book, code, before = {}, 0, 0
        for s in sorted((s for s, n in enumerate(lengths) if n), key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - before
            before = lengths[s]
            book[s] = (int(f"{code:0{before}b}"[::-1], 2), before)
            code += 1
        return book

    def file(self, w, h):
        head = webp.Writer()
        for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
            head.put(v, n)
        head.put(self.value, self.n)
        body = head.value.to_bytes((head.n + 7) // 8, "little")
        body += b"\0" * (len(body) & 1)
        return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def lengths(symbols, alphabet):
    """Lengths of a complete code of these symbols, not all equal."""
    out, n = [0] * alphabet, len(symbols)
    high = max(1, (n - 1).bit_length())
    short = (1 << high) - n
    for i, s in enumerate(symbols):
        out[s] = high - (i < short)
    return out


def plain_image(stream, pixels, main=True):
    """Pixels by literals only."""
    stream.put(0, 1)
    if main:
        stream.put(0, 1)
    books = []
    for shift, alphabet in ((8, 280), (16, 256), (0, 256), (24, 256)):
        used = sorted({int(p) >> shift & 255 for p in pixels})
        books.append(stream.code(lengths(used if len(used) > 1 else [*used, (used[0] + 1) % 256], alphabet)))
    webp._put_code(stream, [0], 40)
    for p in pixels:
        for book, shift in zip(books, (8, 16, 0, 24), strict=True):
            stream.put(*book[int(p) >> shift & 255])


def test_webp_literals():
    r = random.Random(1)
    pixels = np.array([r.randrange(2**32) & 0x0F0F0F0F for _ in range(35)], np.uint32)
    s = Stream()
    s.put(0, 1)
    plain_image(s, pixels)
    w, h, got = webp.decode(s.file(7, 5))
    assert (w, h) == (7, 5) and (got == pixels).all()


def test_webp_references_and_cache():
    s = Stream()
    s.put(0, 1)
    s.put(1, 1)
    s.put(2, 4)  # a cache of four colours
    s.put(0, 1)
    a, b = 0xFF102030, 0xFF405060
    slot = lambda c: (0x1E35A7BD * c & 0xFFFFFFFF) >> 30
    green = s.code(lengths([0x20, 0x50, 256 + 3, 280 + slot(a)], 284))
    red, blue, alpha = s.code(lengths([0x10, 0x40], 256)), s.code(lengths([0x30, 0x60], 256)), s.code(lengths([0xFE, 0xFF], 256))
    far = s.code(lengths([0, 1], 40))
    for c in (a, b):
        for book, shift in ((green, 8), (red, 16), (blue, 0), (alpha, 24)):
            s.put(*book[c >> shift & 255])
    s.put(*green[259])  # four pixels from the left neighbour (distance code 2)
    s.put(*far[1])
    s.put(*green[280 + slot(a)] if slot(a) != slot(b) else green[0x20])
    if slot(a) == slot(b):
        for book, shift in ((red, 16), (blue, 0), (alpha, 24)):
            s.put(*book[a >> shift & 255])
    s.put(*green[259])  # and four from the row above (distance code 1)
    s.put(*far[0])
    _, _, got = webp.decode(s.file(1, 11))  # one column: the neighbour to the left and the one above are the same
    assert got.tolist() == [a, b, b, b, b, b, a, a, a, a, a]


def test_webp_transforms():
    r = random.Random(2)
    w, h = 9, 6
    want = np.array([r.randrange(2**32) & 0x07070707 for _ in range(w * h)], np.uint32)
    # subtract green
    s = Stream()
    s.put(1, 1)
    s.put(2, 2)
    s.put(0, 1)
    g = want >> 8 & 255
    plain_image(s, want & np.uint32(0xFF00FF00) | ((want >> 16) - g & 255) << 16 | (want - g & 255))
    assert (webp.decode(s.file(w, h))[2] == want).all()
    # predictor, every mode in turn
    for mode in range(14):
        s = Stream()
        s.put(1, 1)
        s.put(0, 2)
        s.put(2, 3)
        plain_image(s, [mode << 8 | 0xFF000000], main=False)
        s.put(0, 1)
        left = []
        flat = want.tolist()
        for i, p in enumerate(flat):
            y, x = divmod(i, w)
            guess = webp.BLACK if not i else flat[i - 1] if not y else flat[i - w] if not x else webp._predicted(mode, flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1])
            left.append(sum(((p >> k & 255) - (guess >> k & 255) & 255) << k for k in (0, 8, 16, 24)))
        plain_image(s, left)
        assert (webp.decode(s.file(w, h))[2] == want).all(), mode
    # cross colour
    small = lambda v: v - 256 if v > 127 else v
    s = Stream()
    s.put(1, 1)
    s.put(1, 2)
    s.put(2, 3)
    to_red, to_blue, red_blue = 5, 250, 33
    plain_image(s, [0xFF000000 | red_blue << 16 | to_blue << 8 | to_red], main=False)
    s.put(0, 1)
    sent = []
    for p in want.tolist():
        red, green, blue = p >> 16 & 255, p >> 8 & 255, p & 255
        nr = red - (small(to_red) * small(green) >> 5) & 255
        nb = blue - (small(to_blue) * small(green) >> 5) - (small(red_blue) * small(red) >> 5) & 255
        sent.append(p & 0xFF00FF00 | nr << 16 | nb)
    plain_image(s, sent)
    assert (webp.decode(s.file(w, h))[2] == want).all()


@pytest.mark.parametrize("colours", [2, 3, 9, 20])
def test_webp_palette(colours):
    r = random.Random(colours)
    table = [0xFF000000 | r.randrange(2**24) for _ in range(colours)]
    w, h = 13, 4
    index = [r.randrange(colours) for _ in range(w * h)]
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    s = Stream()
    s.put(1, 1)
    s.put(3, 2)
    s.put(colours - 1, 8)
    deltas = [sum(((c >> k & 255) - (p >> k & 255) & 255) << k for k in (0, 8, 16, 24)) for p, c in zip([0, *table], table, strict=False)]
    plain_image(s, deltas, main=False)
    s.put(0, 1)
    sent, each = [], 8 >> packed
    for y in range(h):
        row = index[y * w : (y + 1) * w]
        for x in range(0, w, 1 << packed):
            sent.append(0xFF000000 | sum(v << (i * each) for i, v in enumerate(row[x : x + (1 << packed)])) << 8)
    plain_image(s, sent)
    assert webp.decode(s.file(w, h))[2].tolist() == [table[i] for i in index]


def test_store_and_load():
    r = random.Random(5)
    for i in range(60):
        raw = bytes(r.choice((range(256), b"abc \n", b"a", b"ab")[i % 4]) for _ in range(r.randint(0, 1500)))
        payload = webp.padded(raw)
        assert len(payload) % 192 == 0 and payload and webp.load(webp.store(payload)).tobytes() == payload
    big = webp.padded(bytes(range(97, 123)) * 150_000)
    assert len(webp.images_in(webp.store(big))) == 2 and webp.load(webp.store(big)).tobytes() == big


def test_media_query_columns(spark):
    texts = [None, "", "é" * 100, "x" * 192, "y" * 50_000, "x" * 192]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("media", F.lit("clash"))
    rows = webp.media_column(docs, F.col("text")).withColumn("r", webp.read_back("media")).orderBy("doc_id").collect()
    for x in rows:
        want = webp.padded((x.text or "").encode())
        assert x.r.payload_sha256 == hashlib.sha256(want).hexdigest() and x.r.tail_crc32 == zlib.crc32(want[-16:]) and x.r.media_sha256 == hashlib.sha256(bytes(x.media)).hexdigest()
    assert rows[3].r == rows[5].r
    bad = spark.createDataFrame([(bytearray(b"junk"),), (None,), (bytearray(webp.store(webp.padded(b"ok"))),)], "x binary").select(webp.pixels("x").alias("p")).collect()
    assert bad[0].p.error and bad[1].p.width is None and (bad[2].p.width, bad[2].p.height, bytes(bad[2].p.argb[:4])) == (192, 1, b"\xff\x00o\x00")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.08 else "") for _ in range(n))
    rows = [(i, prose(80), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", "en", "s0") for i in range(5)] + [(200, " ".join(w + "###" for w in prose(60).split()), "en", "s1"), (201, prose(60) + " password=abcdefgh12", "en", "s2")]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == set(range(60)) | {201} and all(x.round_trip and x.n_pieces for x in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secret_scan", "source_mixing", "sentencepiece"]
    mid = corpus_pipeline.secrets(spark, docs, "")
    assert mid.columns == docs.columns and "[secret]" in mid.where("doc_id = 201").first().text


def test_pipeline_samples_several_segmentations(spark):
    """The last stage searches beyond the first walk: the others are distinct, less likely to come first, and spell the same text."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "s", "some words of a plain text"), (2, "s", ""), (3, "s", None)], "doc_id long, source string, text string")
    got = {x.doc_id: x for x in corpus_pipeline.tokens(spark, docs, "").collect()}
    want = {x.doc_id: x.samples for x in pieces.sampled(docs, MODEL, k=3).collect()}
    assert corpus_pipeline.SAMPLES == 3 and len(got[1].others) == 2 and len({tuple(got[1].ids), *(tuple(o.ids) for o in got[1].others)}) == 3
    assert got[1].ids == want[1][0].ids and got[1].others == want[1][1:] and got[2].others == [] and got[3].others is None
    spelt = spark.createDataFrame([(o.ids,) for o in got[1].others], "ids array<int>")
    assert {x.decoded for x in pieces.decoded(spelt, F.col("ids"), MODEL).collect()} == {"some words of a plain text"}


def test_only_linked_rows_are_copies(spark):
    """Unlinked texts that share a null or a repeated id all stay."""
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r"), (5, "s t u v w x"), (5, "y z a1 b1 c1 d1"), (7, "A B C D E F")]
    kept = jaccard_join.without_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(x.text for x in kept) == sorted(t for _, t in rows[1:])


def test_stored_images_take_the_general_path(monkeypatch):
    """Every stored image passes through prefix codes of several lengths; texts through a predictor, the cache and copies; few values through a palette."""
    seen = []
    monkeypatch.setattr(webp, "undo_predictor", lambda *a, f=webp.undo_predictor: (seen.append("predictor"), f(*a))[1])
    monkeypatch.setattr(webp, "undo_palette", lambda *a, f=webp.undo_palette: (seen.append("palette"), f(*a))[1])
    tokens = webp._tokens

    def watched(*a):
        found = tokens(*a)
        if found is not None:
            symbols = found[0]
            seen.extend(name for name, some in (("copy", (symbols >= 256) & (symbols < 280)), ("cache", symbols >= 280), ("literal", symbols < 256)) if some.any())
        return found

    monkeypatch.setattr(webp, "_tokens", watched)
    r = random.Random(7)
    for i in range(40):
        words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(80)]
        raw = " ".join(r.choice(words) for _ in range(r.randint(60, 400))).encode() if i % 4 else bytes(r.choice(b"abc") for _ in range(900))
        seen.clear()
        payload = webp.padded(raw)
        assert webp.load(webp.store(payload)).tobytes() == payload
        assert ({"predictor", "literal", "cache", "copy"} if len(set(payload)) > 16 else {"palette", "literal", "cache"}) <= set(seen)


def test_prefix_code_lengths():
    r = np.random.default_rng(3)
    for most, n in ((15, 300), (15, 2), (7, 19), (15, 1300), (7, 100)):
        for skew in (0, 1, 3):
            counts = (r.pareto(0.3, n) + 1).astype(np.int64) ** skew % 10**12 + (r.random(n) < 0.5)
            lengths = webp.code_lengths(counts, most)
            used = counts > 0
            assert (lengths[used] > 0).all() and not lengths[~used].any() and lengths.max() <= most
            if used.sum() > 1:
                assert sum(2.0 ** -lengths[used]) == 1


def test_entropy_target_and_passes(spark):
    """The exponent lies inside (0, 1) and meets the entropy; each pass is a permutation with a place for each row taken."""
    r = random.Random(3)
    rows = [(i, f"s{min(int(r.expovariate(0.7)), 4)}", "w " * r.randint(1, 20)) for i in range(4000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string"), entropy=0.95).toPandas()
    by = got.groupby("source").agg(weight=("weight", "first"), tokens=("n_tokens", "sum"))
    exponent = got["exponent"].iloc[0]
    assert 0 < exponent < 1 and got["exponent"].nunique() == 1
    assert abs(-(by.weight * np.log(by.weight)).sum() / np.log(len(by)) - 0.95) < 1e-6
    powered = (by.tokens / by.tokens.sum()) ** exponent
    assert np.allclose(by.weight, powered / powered.sum())
    taken = [(row.source, p["pass"], p["block_order"], p["row_order"], row.doc_id, row.block) for row in got.itertuples() for p in row.passes]
    assert all(len(row.passes) == row.copies and [p["pass"] for p in row.passes] == list(range(1, row.copies + 1)) for row in got.itertuples())
    assert len({t[:4] for t in taken}) == len(taken)  # no two rows share a place of a pass
    blocks = {(t[0], t[1], t[5]): t[2] for t in taken}
    assert len(set(blocks.values())) == len(blocks) and all(blocks[t[0], t[1], t[5]] == t[2] for t in taken)


def test_pipeline_edge_cases(spark, tmp_path):
    """An empty table gives an empty result with the same columns; nulls, empty and repeated rows and extra columns pass through."""
    import corpus_pipeline

    schema = DOCS + ", lang string, source string, n_chars long, extra string, _k long"
    r = random.Random(9)
    prose = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.08 else "") for _ in range(60))
    other = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) + ("." if r.random() < 0.08 else "") for _ in range(60))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1), (3, prose, "en", "s", 1, "x", 1), (3, prose, "en", "s", 1, "x", 1), (None, other, None, None, None, None, None)]
    for name, data in (("none", []), ("some", rows)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
    empty, some = (corpus_pipeline.run(spark, str(tmp_path / name)) for name in ("none", "some"))
    assert empty.columns == some.columns and empty.count() == 0
    got = some.collect()
    assert {x.doc_id for x in got} == {3, None} and all(x.round_trip for x in got)


def test_hot_tokens_without_broadcasts(spark, monkeypatch):
    """The same components where neither tokens, pairs nor hubs are broadcast and hubs are dealt out in copies."""
    rows = family(5, 150, (60, 90), 5, 2) + [(1000 + i, "same words in very many texts of one kind here " * 3) for i in range(40)]
    monkeypatch.setattr(jaccard_join, "SPLIT", 3)
    monkeypatch.setattr(jaccard_join, "small_side", lambda df, *a: df)
    got = {x.id: (x.size, x.component) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert got == plain_components(rows)


def test_source_mixing_query_binds(spark):
    """op7's target is met by an exponent strictly inside (0, 1) on the given tables."""
    rows = queries.op7_source_mixing(spark, "/root/testdata/sf0.001").toPandas()
    by = rows.groupby("source").weight.first()
    assert 0 < rows["exponent"].iloc[0] < 1 and abs(-(by * np.log(by)).sum() / np.log(len(by)) - queries.SOURCE_ENTROPY) < 1e-6


def test_a_tiny_source_beside_a_large_one(spark):
    """A source of one token is taken very often: its row stays short, and copies are made step by step."""
    rows = [(i, "large", "w " * 500) for i in range(400)] + [(1000, "tiny", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in mixing.mixed(docs, entropy=0.999999, block_rows=8).collect()}
    assert got[1000].copies > 100_000 and len(got[1000].passes) == mixing.LISTED and got[1000].whole + got[1000].extra == got[1000].copies
    assert len({x.block for x in got.values()}) > 30
    both = {x.doc_id: x for x in mixing.mixed(docs, entropy=0.999999, repeats=3.0).collect()}
    assert 3 >= both[1000].copies >= 2
    copies = F.when(F.col("id") == 0, F.lit(200_001)).otherwise(F.col("id"))
    made = mixing.repeated(spark.range(3), copies.cast("long"), "turn").groupBy("id").agg(F.count("*").alias("n"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("d"))
    assert {tuple(x) for x in made.collect()} == {(0, 200_001, 1, 200_001, 200_001), (1, 1, 1, 1, 1), (2, 2, 1, 2, 2)}


def test_all_passes_are_listed(spark, tmp_path):
    """op7 gives every pass of a row that is taken often, a bounded number in each row."""
    rows = [(i, "large", "w " * 50) for i in range(60)] + [(1000, "tiny", "w"), (1001, "blank", "")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_source_mixing(spark, str(tmp_path)).toPandas()
    assert got.passes.map(len).max() == mixing.LISTED and set(got.doc_id) == {x[0] for x in rows}
    for _, own in got.groupby("doc_id"):
        assert sorted(p["pass"] for x in own.passes for p in x) == list(range(1, own.copies.iloc[0] + 1))
    assert got[got.doc_id == 1000].copies.iloc[0] > 2 * mixing.LISTED


def test_mixing_without_broadcasts(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else f"s{i % 4}", "w " * (i % 9)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    shown = lambda: (sorted(map(str, mixing.mixed(docs, repeats=2.0, block_rows=8).collect())), sorted(map(str, mixing.arranged(docs, repeats=2.0, block_rows=8).collect())))
    want = shown()
    monkeypatch.setattr(mixing, "small_side", lambda df: df)
    assert shown() == want


@pytest.mark.parametrize("stage", ["quality_rules", "jaccard_join", "sentencepiece"])
def test_stages_with_python_bound_their_batches(spark, stage):
    """Long texts reach Python a few MB at a time, not a whole partition at once."""
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["size"])

    few = spark.createDataFrame([(1, "some words of a text", "en", "web", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    long = spark.range(0, 1000, 1, 1).select(F.expr("repeat('word and ', 2000)").alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, few, "")
        found = [x.size for x in long.mapInArrow(sizes, "size long").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sum(found) > 16_000_000 and max(found) <= corpus_pipeline.BATCH_BYTES + 20_000


def test_repeated_codes_are_read_once(monkeypatch):
    """Of an image after another only the code of greens is read from its lengths; what is written and read stays the same."""
    read, own = [], webp._read_code
    monkeypatch.setattr(webp, "_read_code", lambda bits, alphabet: read.append(alphabet) or own(bits, alphabet))
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(300)).encode() for _ in range(3)]
    stored = [webp.store(webp.padded(x)) for x in texts]
    webp.load(stored[0])
    read.clear()
    assert [webp.load(x).tobytes() for x in stored] == [webp.padded(x) for x in texts] and 40 not in read and len(read) == 3
    # another code of distances, and the first one again, cut short
    out, lengths = webp.Writer(), np.repeat([5, 6], [24, 16])[::-1]
    webp.put_lengths(out, lengths)
    raw = out.value.to_bytes(out.n // 8 + 1, "little")
    other = webp.read_code(webp.Bits(raw), 40)
    assert np.bincount(other.symbols)[[0, 39]].tolist() == [1, 2] and read[-1] == 40
    with pytest.raises(ValueError):
        webp.read_code(webp.Bits(raw[: len(raw) // 2]), 40)


def test_images_are_read_side_by_side(monkeypatch):
    """Texts of a batch share the walk over their symbols; few are read alone, and samples, copies, palettes and damage come out as from load()."""
    alone, own = [], webp._tokens
    monkeypatch.setattr(webp, "_tokens", lambda *a: (alone.append(1), own(*a))[1])
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(900)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(100, 400))).encode() for _ in range(300)]
    texts[::5] = [x + b"\n" + x[:300] * 2 + b"-" * r.randint(0, 900) for x in texts[::5]]
    raw = [webp.padded(x) for x in [*texts, b"", b"ab" * 500, bytes(range(256)) * 300, texts[0] * 20]]
    stored = [webp.store(x) for x in raw]
    found = webp.read_back.func(pa.array(stored, pa.binary())).to_pylist()
    assert [(x["payload_bytes"], x["payload_sha256"]) for x in found] == [(len(x), hashlib.sha256(x).hexdigest()) for x in raw]
    assert len(alone) < 60
    # one bit is wrong: other samples, or the same error
    readable = []
    for i in range(300):
        x = bytearray(stored[i])
        x[r.randrange(20 + (i % 2) * 200, len(x))] ^= 1 << r.randrange(8)
        try:
            readable.append((bytes(x), webp.load(bytes(x)).tobytes()))
        except ValueError as e:
            with pytest.raises(ValueError, match=re.escape(str(e))):
                list(webp.load_all([*stored[:40], bytes(x)]))
    assert len(readable) > 30 and [x.tobytes() for x in webp.load_all([*stored, *(x for x, _ in readable)])] == raw + [x for _, x in readable]
