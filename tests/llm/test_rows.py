"""Operators that work row by row, against libraries and plain versions."""

import hashlib
import io
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer, models

from kotonoha.llm import bpe, layout, media, unigram
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aeiou thnstre  \n\t.,'’éàßñ漢字かな\U0001f600𝔘1234567890!?|_-\x85"


def odd_rows(documents):
    rows = [(i, t, None, None) for i, t in enumerate(ODD)]
    return documents([*rows, rows[4], (None, "no id", None, None)])


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(library):
    encoder, decoder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 70))) for _ in range(3000)]
    texts += ["".join(rnd.choice("aaaabthes") for _ in range(rnd.randint(0, 900))) for _ in range(150)]
    texts += ["a" * 3000, "ab" * 2000, "!" * 700, *[t for t in ODD if t]]
    for text in texts:
        ids, decimals = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert decimals == " ".join(map(str, ids))
        assert decoder.decode(ids) == "".join(decoder.pieces(ids)) == text


def test_bpe_tables_that_fill_up(library):
    encoder = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN, most=2000)
    encoder.transducer.most = 60
    rnd = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(rnd.choice("thernoia") for _ in range(rnd.randint(1, 9))) for _ in range(12))
        assert encoder.encode(text)[0] == library.encode_ordinary(text)


def test_streaming_decoder_replaces_like_the_library(library):
    decoder, rnd = bpe.codec(RANKS, public_tokenizers.PATTERN)[1], random.Random(3)
    for _ in range(3000):
        ids = [rnd.randrange(50256) for _ in range(6)]
        assert "".join(decoder.pieces(ids)) == library.decode(ids, errors="replace")
    stream = bpe.Utf8Stream()
    data = "é漢😀x".encode()
    assert "".join(stream.feed(bytes([b])) for b in data) + stream.close() == "é漢😀x"
    assert stream.feed(b"\xe6\xbc") == "" and stream.close() == "�"


def test_bpe_column(documents, library):
    df = odd_rows(documents)
    out = bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == df.count()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in out:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_texts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pair_checks_undo_merges():
    machine, rnd = bpe.Transducer(bpe.load_ranks(RANKS)), random.Random(7)
    tokens, named = [t for t in machine.ranks if len(t) < 9], {rank: t for t, rank in machine.ranks.items()}
    pairs = [rnd.sample(tokens, 2) for _ in range(4000)] + [[t, t] for t in rnd.sample(tokens, 500)]
    for _ in range(1500):  # neighbours in real encodings, most of which may follow
        ids = machine.encode("".join(rnd.choice("aeinorsth") for _ in range(12)).encode())
        pairs += [[named[a], named[b]] for a, b in zip(ids, ids[1:])]
    known = {(left, right): machine.merged(left + right) == [left, right] for left, right in pairs}
    assert 0 < sum(known.values()) < len(known)
    assert {pair: machine.apart(*pair) for pair in known} == known
    # ranks that do not rise from parts to wholes
    odd = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 310, b"bc": 320, b"cab": 305, b"ca": 330}
    machine = bpe.Transducer(odd)
    for left in odd:
        for right in (b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca", b"cab"):
            if left[0] in b"abc":
                assert machine.apart(left, right) == (machine.merged(left + right) == [left, right])


def test_bpe_works_out_pieces_and_characters_once():
    encoder, decoder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert decoder.made == 0  # texts of whole tokens are kept by the worker
    walked, encode = [], encoder.transducer.encode
    encoder.transducer.encode = lambda piece: walked.append(piece) or encode(piece)
    ids, _ = encoder.encode("so thonwhea, thonwhea. (thonwhea) thonwhea; thonwhea: 漢漢")
    assert walked.count(b" thonwhea") == 1
    decoder.pieces = None  # one split character does not send the whole text through the machine
    assert decoder.decode(ids) == "so thonwhea, thonwhea. (thonwhea) thonwhea; thonwhea: 漢漢"
    assert 0 < decoder.made < 10
    assert decoder.decode(ids[:-1]) == "so thonwhea, thonwhea. (thonwhea) thonwhea; thonwhea: 漢\ufffd"


@pytest.fixture(scope="module")
def unigram_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def test_unigram_counts_equal_the_library(documents, unigram_library):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(LETTERS + "▁") for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [t for t in ODD if t]
    count = unigram.counter(PIECES).count
    for text in texts:
        assert count(text) == len(unigram_library.encode("▁" + text.replace(" ", "▁")).ids) if text else count(text) == 0
    df = odd_rows(documents)
    given = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    out = unigram.count_tokens(df, PIECES).collect()
    assert len(out) == len(ODD) + 2
    assert all(r["n_tokens"] == count(given[r["doc_id"]]) for r in out)


def test_unigram_ties_and_unknown_runs():
    pieces = [("ab", -1.0), ("a", -1.0), ("b", -1.0), ("c", -2.0), ("bc", -2.0), ("abc", -3.0)]
    plain = unigram.Counter(pieces, byte_fallback=False)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0))
    rnd = random.Random(6)
    for _ in range(2000):
        text = "".join(rnd.choice("abcxy") for _ in range(rnd.randint(1, 12)))
        # the library has <unk> as an entry, which lowers nothing here: the worst score is the same
        assert plain.best(text) == len(library.encode(text).ids)
    assert plain.best("xyx") == 1 and unigram.Counter(pieces, byte_fallback=True).best("é") == 2


def brute_resize(a, rows, columns):
    out = np.zeros((rows, columns, a.shape[2]))
    big = np.kron(a.astype(float), np.ones((rows, columns, 1)))
    for i in range(rows):
        for j in range(columns):
            out[i, j] = big[i * a.shape[0]:(i + 1) * a.shape[0], j * a.shape[1]:(j + 1) * a.shape[1]].mean((0, 1))
    return out


def test_images_of_all_kinds():
    rnd = np.random.default_rng(1)
    colour = rnd.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    grey = rnd.integers(0, 256, (4, 9, 1)).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(colour)) == colour).all()
    assert (media.decode(media.encode_netpbm(grey)) == grey).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    plain = b"P3 # note\n5 7\n255\n" + " ".join(map(str, colour.reshape(-1))).encode()
    assert (media.decode(plain) == colour).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n010").reshape(-1).tolist() == [1, 0, 1, 0, 1, 0]
    assert media.decode(b"P4\n3 2\n\xa0\x40").reshape(-1).tolist() == [1, 0, 1, 0, 1, 0]
    assert media.decode(b"P2 2 1 9 3 7").reshape(-1).tolist() == [3, 7]
    assert media.decode(b"P5 1 1 1000\n\x03\xe8")[0, 0, 0] == 1000
    palette = media.struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 62, 40, 3, -1, 1, 1, 0, 0, 0, 0, 2, 0)
    assert media.decode(palette + bytes([1, 2, 3, 0, 9, 8, 7, 0]) + b"\x40\0\0\0").tolist() == [[[3, 2, 1], [7, 8, 9], [3, 2, 1]]]
    for broken in (b"", b"P6", b"P6 1 1", b"P6 2 2 255\nabc", b"BM", b"GIF89a", b"P5 0 1 255\n", b"P4 9 9\n"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_reduction_and_hash():
    a = np.random.default_rng(2).integers(0, 256, (13, 11, 3)).astype(np.uint8)
    assert np.allclose(media.area_resize(a, 8, 9), brute_resize(a, 8, 9))
    assert np.allclose(media.area_resize(a[:2, :3], 5, 4), brute_resize(a[:2, :3], 5, 4))
    ramp = np.tile(np.arange(18, dtype=np.uint8)[None, :, None], (16, 1, 1))
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8
    assert np.load(io.BytesIO(media.npy_tile(a, 4))).shape == (4, 4, 3)


def test_payload_columns(spark, documents):
    df = odd_rows(documents)
    given = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    out = media.store_texts(df, with_files=True).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        data = given[r["doc_id"]]
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and len(payload) % 192 == 0
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert r["media"].endswith(payload)
    files = spark.createDataFrame([(1, out[0]["media"]), (2, b"junk"), (3, None)], "id long, data binary")
    read = {r["id"]: r for r in media.read_media(files, "id", "data").collect()}
    assert read[1]["feature"] == out[0]["feature"] and read[1]["tile"] == out[0]["tile"]
    assert read[2]["error"] and read[2]["tile"] is None and read[3]["error"]


CASES = {
    "a<p>b<p>c": "a\n\nb\n\nc",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>": "* a\n* b\n  3. x\n  4. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>fig<td>12<br>more</table>":
        "Name       Qty\napple pie  3\nfig        12\n           more",
    "<p>one <b>two<p>three</b> four": "one two\n\nthree four",
    "x<script>if (a<b) '</p>'</script><style>.h{display:none}</style><i class=h>no</i>y": "xy",
    "<div hidden>a</div><div style='display: none'>b</div><span style='visibility:hidden'>c<b style='visibility:visible'>d</b></span>": "d",
    "<pre>\n a  b\n  c</pre>d": " a  b\n  c\n\nd".strip("\n"),
    "a &lt;b&gt; &amp;amp; &#233; < c": "a <b> &amp; é < c",
    "<table>stray<tr><td rowspan=2>1<td>2<tr><td>3</table>": "stray\n\n1  2\n   3",
    "<select><option>a<option selected>b</select> <a href='x>y'>l</a>": "b l",
    "<details><summary>s</summary>hidden</details><dl><dt>t<dd>d</dl>": "s\n\nt\n    d",
    "a<br>b<hr>c<!-- no --><?php no ?>": "a\nb\n\nc",
    "": "", "<": "<", "<p": "", "</": "", "a<b": "a", "<title>t</title>x": "x", "<textarea> q </textarea>": "q",
    "<h1>A</h1><div>b</div><div>c</div>": "A\n\nb\nc",
}


MORE_CASES = {
    "<style>@media print {.m{display:none}}</style><p class=m>a": "a",
    "<style>@import 'x;{'; @media screen and (min-width:600px){.m{display:none}} .n{display:none}</style><p class=m>a<p class=n>b<p>c": "c",
    "<style>@media (max-width: 600px){.m{display:none}} @supports (a:b){@media print{p{display:none}} .n{display:none}}</style>"
    "<p class=m>a<p class=n>b": "a",
    "<style>@media not print{.m{display:none}} @font-face{src:x} @keyframes k{to{display:none}}</style><b class=m>a</b>b": "b",
    "<style media=print>p{display:none}</style><style>.x{content:'}'; display:none}</style><p>a<p class=x>b": "a",
    "<style>div.a{display:none} .b.c{display:none} p#d.e{display:none}</style>"
    "<div class=a>1</div><p class=a>2<p class='c b'>3<p class=b>4<p id=d class=e>5<p id=d>6": "2\n\n4\n\n6",
    "<style>p.a{display:none} .a{display:block}</style><p class=a>x</p>y": "y",
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> b": "a x=2 b",
    "a <svg><title>t</title><defs/><rect/><g>no<text>one</text><text>two <tspan>three</tspan></text></g>"
    "<defs><text>no</text></defs></svg> b": "a one two three b",
    "<svg><foreignObject><p>in</p></foreignObject></svg><svg><rect><p>out": "in\n\nout",
    "<object>a</object><object data=x>b</object>c": "ac",
    "<table><form>Search <b>x</b><tr><td>1<td>2</form></table>": "Search x\n\n1  2",
    "<table><tr><form><td>1<input value=a><td>2</table>": "1a  2",
    "<table><input value=go><input type=hidden value=no><tr><td>1</table>": "go\n\n1",
}


@pytest.mark.parametrize("page", MORE_CASES)
def test_layout_shows_all_visible_text(page):
    assert layout.render(page).strip(" ") == MORE_CASES[page]


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert layout.render(page).strip(" ") == CASES[page].strip(" ")


def test_layout_of_tag_soup():
    rnd = random.Random(8)
    tags = "p b i div table tr td th li ul ol a pre select option h1 span details dd dt tbody caption br hr style x-y textarea".split()
    for _ in range(1500):
        soup = "".join(rnd.choice((f"<{t}>", f"</{t}>", f"<{t} hidden>", "text ", "&amp;", f"<{t} class='"))
                       if rnd.random() < 0.97 else "<!--" for t in rnd.choices(tags, k=rnd.randint(0, 40)))
        layout.render(soup)
    assert layout.render("<div>" * 20000 + "x") == "x"
    assert "deep" in layout.render("<table><tr><td>" * 400 + "deep")


def test_layout_column(spark):
    pages = spark.createDataFrame([(1, "<p>a", 0), (1, "<p>a", 0), (2, None, 0), (None, "b", 0)], "page_id long, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"]) for r in layout.extract(pages).collect()) == [(0, "b"), (1, "a"), (1, "a"), (2, "")]


def test_every_character_survives_bpe():
    encoder, decoder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    text = "".join(chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) != "Cs")
    assert decoder.decode(encoder.encode(text)[0]) == text
