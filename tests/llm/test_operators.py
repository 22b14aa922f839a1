"""The ten operators against brute force, on rows with nulls, odd texts, ties, repeats and clashing columns."""

import hashlib
import html.parser
import itertools
import json
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest
import xxhash

from lodestar.llm import (
    bitpack, components, exactdedup, htmltext, jaccard, langid, matroska, mixing, packing, sharding, simhash, tokens, wordpiece,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def got(df):
    return [r.asDict() for r in df.collect()]


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_file(name))


def whole_ids(name, text, end):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


# --- 1 ---

def test_shards(docs, rows):
    out = got(sharding.balanced_shards(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    sizes, longest = Counter(), max(r["size"] for r in out)
    for r in out:
        sizes[r["shard"]] += r["size"]
    target = sum(sizes.values()) / 16
    assert all(abs(sizes[k] - target) <= longest for k in sizes) and set(sizes) <= set(range(16))
    in_order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in in_order]
    assert ids == sorted(ids)
    for k in sizes:
        assert [r["slot"] for r in in_order if r["shard"] == k] == list(range(sum(r["shard"] == k for r in out)))


def test_shards_are_even_without_long_rows(spark):
    rows = spark.range(20_000).selectExpr("id", "id % 7 + 1 AS size")
    out = {r["shard"]: r["b"] for r in sharding.shards(rows, ["id"], "size").groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()}
    assert len(out) == 16 and max(out.values()) - min(out.values()) <= 14


def test_shards_of_nothing(empty):
    assert got(sharding.balanced_shards(empty)) == []


# --- 2 ---

@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 20, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 640, dtype=np.uint64).astype("<u4")
    data = bitpack.pack(ids, bits)
    assert len(data) == 640 * bits // 8
    assert (bitpack.unpack(data, bits) == ids).all()
    as_int = int.from_bytes(data, "little")  # id i in bits i * bits and up
    assert all(as_int >> i * bits & ((1 << bits) - 1) == int(x) for i, x in enumerate(ids))


def test_bits_for():
    assert [bitpack.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, int(n), dtype=np.uint32) for n in (0, 1, 5000, 3, 9000, 4096)]
    file = bitpack.PackedFile(bitpack.write_file([5, None, 7, 8, 9, -1], [d.astype("<u4").tobytes() for d in docs], 16))
    assert file.doc_ids == [5, None, 7, 8, 9, -1]
    for k, d in enumerate(docs):
        assert (file.doc(k) == d).all()
    every = np.concatenate(docs)
    for a, b in ((0, 1), (4095, 4097), (100, 12000), (7, 7)):
        assert (file.ids(a, b) == every[a:b]).all()


@pytest.mark.parametrize("name", list(tokens.CHUNKS))
def test_chunks_encode_as_whole_texts(name, rows):
    rng = random.Random(2)
    signs = "abS'tve  \n\t,.é́ſßİ²1日👩‍\x1c 　<|endoftext|>"
    texts = [t for _, t, _, _ in rows if t and len(t) < 2000] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += ["日\n\n<|endoftext|>", "_\n\n<|endoftext|>", " \x85<|endoftext|>x", "<|endoftext|>" * 3]
    for t, ids in zip(texts, tokens.ChunkEncoder(name, kept=30_000).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole_ids(name, t, 0)[:-1], ascii(t)


def test_packed_token_ids(docs, rows):
    files = bitpack.write_files(docs, file_ids=3000)
    out = got(bitpack.read_files(files))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, t, _, _ in ordered:
        ids = whole_ids("byte_bpe_50k.json", t, 0)
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    same = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in out)
    # rows of one id may come in another order
    assert [x[:3] for x in same if x[1] < 30] == [(d is not None, d or 0, a) for d, a, _, _ in want if (d or 0) < 30]
    assert Counter(x[1:2] + x[3:] for x in same) == Counter((d or 0, n, c) for d, _, n, c in want)
    assert sum(r["n_tokens"] for r in out) == at


def test_packed_nothing(empty):
    assert got(bitpack.packed_token_ids(empty)) == []


# --- 3 ---

def test_matroska_round_trip():
    for n in (64, 512, 4096, 4160, 28672, 28736, 200_000):
        samples = random.Random(n).randbytes(n)
        data = matroska.mux(samples)
        assert matroska.track_bytes(data) == samples
        table = matroska.packets(data)
        assert [p[1] for p in table] == list(range(0, n, matroska.FRAME))
        for time, track, at in matroska.cues(data):
            assert track == 1 and int.from_bytes(data[at:at + 4], "big") == matroska.CLUSTER
            assert min(p[1] for p in table if at < p[6] <= at + 12) == time


def test_matroska_lacing_and_unknown_sizes():
    frames = [bytes([i]) * n for i, n in enumerate((700, 3, 255, 510, 1, 9000, 40))]
    for lacing in ("xiph", "ebml"):
        block = matroska.block(1, -5, frames, lacing)
        cluster = matroska.number(matroska.TIMESTAMP, 100) + block
        unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
        tail = matroska.element(matroska.CUES, b"")
        data = matroska._HEAD + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + matroska._TRACKS + unknown + tail
        table = matroska.packets(data)
        assert [data[p[3]:p[3] + p[4]] for p in table] == frames
        assert table[0][1] == 95 and {p[5] for p in table} == {lacing}


def test_media_columns(docs, rows, empty):
    out = got(matroska.media_columns(docs))
    want = Counter()
    for d, t, _, _ in rows:
        raw = (t or "").encode()
        pay = raw + b"\0" * ((-len(raw) % 64) if raw else 64)
        want[d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    by = defaultdict(set)
    for r in out:
        by[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert all(json.loads(r["feature"])["ticks"] == r["payload_bytes"] for r in out)
    n = matroska.packet_table(matroska.with_media(docs)).count()
    assert n == sum(json.loads(r["feature"])["packets"] for r in out)
    assert got(matroska.media_columns(empty)) == []


# --- 4 ---

def test_pack_documents(docs, rows, empty):
    out = got(packing.pack_documents(docs))
    want = Counter()
    for d, t, _, _ in rows:
        ids = whole_ids(packing.VOCABULARY, t, 1)
        for k, at in enumerate(range(0, len(ids), 4096)):
            p = ids[at:at + 4096]
            want[d, k, at, len(p), crc(p)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    check_sequences(out, 4096)
    assert len({r["sequence_id"] for r in out}) == -(-sum(r["length"] for r in out) // 4096)
    assert got(packing.pack_documents(empty)) == []


def check_sequences(out, capacity):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity


def fewest(sizes, capacity):
    """The optimum by exhaustive search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def made_of(plan, capacity):
    made = Counter()
    for filling, n in plan.fillings:
        assert sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            made[x] += n * k
    return made


def test_bin_completion_finds_the_optimum():
    rng = random.Random(3)
    cases = [[rng.randint(1, 60) for _ in range(rng.randint(1, 11))] for _ in range(400)] + [[21, 22, 22, 23, 25, 26, 37, 50, 51, 56, 56]]
    for sizes in cases:
        plan = packing.bin_completion(dict(Counter(sizes)), 100)
        assert made_of(plan, 100) == Counter(sizes)
        assert plan.sequences == fewest(sizes, 100), sizes


def test_bin_completion_of_few_lengths():
    for counts, best in (({1001: 9000, 1000: 18000, 600: 9000, 495: 9000}, 9000), ({904: 1000, 867: 2000, 821: 1000, 637: 1000}, 1000)):
        plan = packing.bin_completion(counts, 4096)
        assert plan.sequences == best and made_of(plan, 4096) == Counter(counts)


def test_dominated_fillings():
    """A filling whose members could give way to a longer one that is left, within its waste, is dominated."""
    left = {5: 1, 3: 1, 2: 2}
    assert packing.dominated({3: 1, 2: 1}, 0, left) and not packing.dominated({5: 1}, 0, left)
    assert packing.dominated({3: 1}, 2, left) and packing.dominated({2: 1}, 1, left) and not packing.dominated({3: 1, 2: 2}, 0, {3: 1, 2: 2})
    rng = random.Random(4)
    for _ in range(100):
        counts = Counter(rng.randint(1, 12) for _ in range(7))
        room = rng.randint(5, 30)
        fillings = [dict(f) for f, _ in packing.fillings(dict(counts), room, room, packing.Budget(10**6))]
        every = [dict(c) for c in {tuple(sorted(Counter(c).items())) for n in range(8) for c in itertools.combinations(list(counts.elements()), n)} if sum(x * k for x, k in c) <= room]
        waste = lambda f: room - sum(x * k for x, k in f.items())
        assert sorted(map(sorted, (f.items() for f in fillings))) == sorted(sorted(f.items()) for f in every if not packing.dominated(f, waste(f), counts))


def test_packing_hot_length(spark):
    rows = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 40L ELSE id % 100 + 1 END AS length")
    out = got(packing.packed(rows, 100))
    assert len(out) == 9000
    check_sequences(out, 100)
    plain = packing.best_fit(dict(Counter(r["length"] for r in out)), 100)
    assert len({r["sequence_id"] for r in out}) <= plain.sequences


# --- 5 ---

def test_mix_sizes(docs, rows):
    out = got(mixing.mix_sizes(docs))
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        target = {s: 2 * size[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    assert Counter((r["size"], r["source_size"]) for r in out) == Counter((len(WORD.findall(t or "")), size[s]) for _, t, _, s in rows)
    by_source = {d: s for d, t, _, s in rows if d is not None and d != 31}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] in by_source:
            assert r["target"] == pytest.approx(target[by_source[r["doc_id"]]])
    assert sorted(map(str, out)) == sorted(map(str, got(mixing.mix_sizes(docs))))


def test_mix_sql_and_emission(docs, spark, empty):
    documents = docs.toArrow()  # noqa: F841
    sql = duckdb.sql(mixing.SQL).df()
    ours = mixing.mix_sizes(docs).toPandas()
    key = lambda f: sorted(zip(f["doc_id"].fillna(-1), f["size"], f["source_size"], f["target"], f["taken"]))
    assert key(sql) == key(ours)
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs).select("doc_id").collect())
    for r in ours.itertuples():
        if r.size and r.doc_id == r.doc_id and r.doc_id not in (30, 31):
            assert copies[r.doc_id] * r.size == r.taken
    assert mixing.mixed(docs).columns == docs.columns
    assert got(mixing.mix_sizes(empty)) == [] and got(mixing.mixed(empty)) == []


def test_mix_comes_near_targets(spark):
    big = spark.range(30_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 40 as int) + 1) AS text", "concat('s', cast(least(id % 9, 4) as string)) AS source")
    out = mixing.mix_sizes(big).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    for r in out:
        assert abs(r[2] - r["target"]) < 0.05 * r["target"]


# --- 6 ---

def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        pool = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_word_pieces_against_greedy():
    rng = random.Random(4)
    for _ in range(40):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
        initial, continuing = {piece() for _ in range(12)}, {piece() for _ in range(12)}
        a = wordpiece.Automaton(sorted(initial), sorted(continuing))
        for _ in range(200):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
            assert a.count(w) == greedy(w, initial, continuing), (w, initial, continuing)


def test_token_counts(docs, rows, empty):
    out = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in got(wordpiece.token_counts(docs)))
    a = wordpiece.automaton()
    assert out == Counter((d, len(w), sum(map(a.count, w))) for d, t, _, _ in rows for w in [wordpiece.WORDS(t or "")])
    assert got(wordpiece.token_counts(empty)) == []


# --- 7 ---

def groups(rows):
    by = defaultdict(list)
    for d, t, _, _ in rows:
        by[ascii_lower(t or "")].append(d)
    return by


@pytest.mark.parametrize("block,bits", [(4096, 47), (64, 47), (16, 4)])
def test_exact_dedup(docs, rows, block, bits):
    some = rows if bits > 4 else [r for r in rows if len(r[1] or "") < 500]
    frame = docs if bits > 4 else docs.where("coalesce(length(text), 0) < 500")
    out = got(exactdedup.duplicate_groups(frame, block, bits))
    want = Counter()
    for text, ids in groups(some).items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            want[d, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups(some))
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_exact_dedup_rows(docs, rows, empty):
    left = got(exactdedup.without_duplicates(docs))
    assert set(left[0]) == set(docs.columns)
    assert Counter(ascii_lower(r["text"] or "") for r in left) == Counter(groups(rows).keys())
    assert got(exactdedup.duplicate_groups(empty)) == [] and got(exactdedup.without_duplicates(empty)) == []


# --- 8 ---

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site no</h1><a href=/>Home no</a></header><nav><ul><li><a href="/a>b">no</a></li></ul></nav>
<!-- <p>no</p> --><div class="cookie-notice">We use no cookies</div><div class=ad>Buy no thing</div>
<article><header><h1>Title &amp; more</h1></header><p>First  <b>bold</b>\n para&shy;graph &lt;x&gt; &eacute;<br>next</p><p>One.</p>
<p>Second <a href="x">link</a> here.<p>Third &#8364;
<form><p>no mail</p><input value="no"><button>no</button></form><aside>no aside</aside><div class="share social">no share</div>
<ul><li>item one</li><li>item two</li></ul>
<section id="comments"><h2>Comments no</h2><article class="comment"><p>no reader</p></article></section></article>
<div class="sidebar"><p>no sidebar text that is rather long and goes on and on for a while so that words are many</p></div>
<footer><p>&copy; no</p></footer></body></html>"""


def test_main_text():
    want = ["Title & more", "First bold para­graph <x> é next", "One.", "Second link here.", "Third €", "item one", "item two"]
    assert htmltext.main_text(PAGE).split("\n") == want


def test_main_text_odd_pages(spark):
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<nav><a>x</a></nav>") == ""
    assert htmltext.main_text("<article><p>cut &am") == "cut &am"
    assert htmltext.main_text("<article><p>cut <b") == "cut"
    assert htmltext.main_text("<article><p>a <script>never closed </p><p>x") == "a\nx"
    assert htmltext.main_text('<article><p>a</p><svg class="icon"/><p>b</p><svg><p>c</p></article>') == "a\nb\nc"
    assert htmltext.main_text('<article class="post search-post"><p>hello there</p></article>') == "hello there"
    long = " ".join(["word"] * 20)
    assert htmltext.main_text(f'<article><p>{long}</p><div class="recommended-reading"><p>{long} x</p></div><div class="cookie-notice"><p>{long} y</p></div></article>') == f"{long}\n{long} x"
    assert htmltext.main_text("<p>One short.</p><p>Two short.</p><p>Three short ones.</p>") == "One short.\nTwo short.\nThree short ones."
    links = "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "About us", "More"))
    assert htmltext.main_text(f"<article><p>{long}</p><ul>{links}</ul><p>See <a href=y>this</a>.</p></article>") == f"{long}\nSee this."
    assert htmltext.main_text("<article><p>a<a href='x>b</p><p>c</p>") .endswith("c")
    plain = " ".join(["word"] * 40)
    assert htmltext.main_text(f"<div class=menu><a>m</a></div><div><p>{plain}</p><p>{plain} x</p></div><footer>f</footer>") == f"{plain}\n{plain} x"
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<main><p>t</p></main>", "y"), (2, None, "<main><p>t</p></main>", "y")], "page_id long, url string, html string, text string")
    assert sorted(map(str, got(htmltext.extract_text(pages)))) == sorted(map(str, [
        {"page_id": 1, "url": "u", "text": "", "n_chars": 0}, *[{"page_id": 2, "url": None, "text": "t", "n_chars": 1}] * 2]))


def test_malformed_pages_take_linear_time():
    began = time.process_time()
    for page in ('<article><p>x<img ' + "a" * 2_000_000 + '="> y</p><p>' + "z " * 200_000, "<a " * 200_000 + '"', "<svg>" * 100_000, "<!-- " * 200_000,
                 '<a ">' * 100_001, "<div>" * 100_000 + "</x>" * 100_000, "<i a='" * 100_001, "<![CDATA[" * 100_000, "<" * 500_000):
        htmltext.main_text(page)
    assert time.process_time() - began < 30


class Plain(html.parser.HTMLParser):
    """Text of the article's headings and paragraphs by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "h2", "div", "ul", "li", "nav", "footer", "article"):
            self.out.append("")

    def handle_endtag(self, tag):
        self.handle_starttag(tag, ())
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.out.append(self.out.pop() + data if self.out else data)


def test_pages_against_a_plain_parser(spark):
    """Every page of the smallest table has one article of headings and paragraphs."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        parser = Plain()
        parser.feed(r["html"].replace("<br>", " "))
        want[r["page_id"]] = "\n".join(t for t in (" ".join(x.split()) for x in parser.out) if t)
    made = {r["page_id"]: r for r in htmltext.extract_text(pages).collect()}
    assert {k: r["text"] for k, r in made.items()} == want and all(r["n_chars"] == len(r["text"]) for r in made.values())


# --- 9 ---

def parse_slowly(text, sample):
    """Phrases of ``text`` (classes as a string) by longest matches in ``sample``."""
    n, phrase = 1, ""
    for c in text:
        if phrase + c in sample:
            phrase += c
        else:
            n += 1
            phrase = c if c in sample else ""
    return n


@pytest.mark.parametrize("window,steps", [(512, 1 << 22), (16, 1 << 22), (7, 400)])
def test_phrases_against_substring_search(monkeypatch, window, steps):
    monkeypatch.setattr(langid, "WINDOW", window)
    monkeypatch.setattr(langid, "PART_STEPS", steps)
    rng = random.Random(6)
    samples = {"a": ["".join(rng.choice("abé ") for _ in range(900))], "b": ["".join(rng.choice("bcd ") for _ in range(60))], "c": ["ab " * 300]}
    model = langid.train(samples)
    texts = ["".join(rng.choice("abcdé zZ1") for _ in range(n)) for n in (1, 255, 256, 257, 700, 3, 0)] + ["ab " * 200, "ab " * 150 + "x" + " ab" * 100]
    fold = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t)
    made = langid.phrases(model, texts)
    for t, row in zip(texts, made):
        for k, lang in enumerate(model.languages):
            assert row[k] == parse_slowly(fold(t), fold(" ".join(samples[lang]))), (t, lang)


def test_languages_of_many_letters_and_foreign_texts():
    rng = random.Random(8)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    texts = {"x": [" ".join(word("the of and ing".split()) for _ in range(150)) for _ in range(64)], "y": [" ".join(word("der sch ung ein".split()) for _ in range(150)) for _ in range(64)],
             "z": ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(1000)) for _ in range(64)]}
    model = langid.train(texts)
    assert sum(x.nbytes for x in (model.base, model.owner, model.go, model.first)) < 100 << 20
    two = langid.train({k: texts[k] for k in "xy"})
    held = ["andtheof ofthe", "the", "q", texts["z"][0][:60], "привет как дела сегодня очень хорошая погода", "12", None, ""]
    names, scores, fits = langid.predict(two, held)
    assert fits == [True, True, True, False, False, False, False, False] and names[:2] == ["x", "x"] and names[5:] == ["und"] * 3
    assert all(0 <= x <= 1 for x in scores)
    assert langid.predict(model, [texts["z"][1][:40]])[0] == ["z"]


def test_languages(docs, rows, empty):
    out = got(langid.languages(docs))
    assert len(out) == len(rows)
    right = tried = 0
    by = {d: (t, l) for d, t, l, _ in rows if d not in (None, 31)}
    for r in out:
        if r["doc_id"] not in by:
            continue
        text, lang = by[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
        if r["held_out"] and lang and r["lang_pred"] != "und" and len(text) > 20:
            tried, right = tried + 1, right + (r["lang_pred"] == lang)
    assert tried > 30 and right >= 0.95 * tried
    kept = got(langid.identified(docs))
    assert len(kept) == sum(any(map(str.isalpha, t or "")) for _, t, _, _ in rows) and set(kept[0]) == set(docs.columns)
    assert got(langid.languages(empty)) == [] and got(langid.identified(empty)) == []


# --- 10 ---

def simhash_slowly(text, k=3):
    w = WORD.findall(ascii_lower(text or ""))
    s = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_slowly(fps, distance):
    """{fp: smallest member} by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_duplicates(docs, rows, empty):
    out = got(simhash.near_duplicates(docs))
    fps = {t: simhash_slowly(t) for t in {t for _, t, _, _ in rows}}
    part = components_slowly(set(fps.values()), 2)
    least = {}
    for d, t, _, _ in rows:
        p = part[fps[t]]
        if d is not None:
            least[p] = min(d, least.get(p, d))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == Counter(
        (d, f"{fps[t]:016x}", least.get(part[fps[t]])) for d, t, _, _ in rows)
    assert got(simhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("distance", [0, 2, 5])
def test_links_reach_just_what_is_near(spark, distance):
    rng = random.Random(distance)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):  # chains and stars of near ones
        f = rng.choice(fps)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps += [rng.getrandbits(14) for _ in range(300)]  # one crowded list
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)
    made = {r["node"]: r["label"] for r in components.components(edges).collect()}
    want = components_slowly(fps, distance)
    classes = defaultdict(set)
    for f, s in zip(fps, signed):
        classes[want[f]].add(made.get(s, s))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_a_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r["label"] for r in components.components(edges).collect()} == {0}


def test_crowded_lists_are_cut_by_more_bytes(spark, monkeypatch):
    """Fingerprints that share most bytes, at every size of the lists."""
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(18) << 20 for _ in range(900)} | {rng.getrandbits(64) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = components_slowly(fps, 2)
    for most in (2, 40, 4096):
        made = {r["node"]: r["label"] for r in components.components(simhash.links(frame, 2, most)).collect()}
        classes = defaultdict(set)
        for f, s in zip(fps, signed):
            classes[want[f]].add(made.get(s, s))
        assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)
    a, b = np.array([3, 3, 0x0101010101010101], dtype=np.uint64), np.array([3, 0x0103, 0], dtype=np.uint64)
    assert simhash.tally(a, b).tolist() == [8, 7, 0]


def shingles(text):
    """The set of a text's runs of five words; fewer words are one run."""
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    shared = len(a & b)
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def test_one_of_each_near_group(docs, rows, empty):
    texts = sorted({t or "" for _, t, _, _ in rows})
    sets, root = {t: shingles(t) for t in texts}, {t: t for t in texts}
    for _ in texts:
        changed = False
        for a in texts:
            for b in texts:
                if root[a] != root[b] and alike(sets[a], sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        if not changed:
            break
    least = {}
    for d, t, _, _ in rows:
        p = root[t or ""]
        least[p] = min((x for x in (d, least.get(p)) if x is not None), default=None)
    left = got(jaccard.without_near_duplicates(docs))
    assert set(left[0]) == set(docs.columns)
    assert Counter((r["doc_id"], root[r["text"] or ""]) for r in left) == Counter((d, p) for p, d in least.items())
    assert got(jaccard.without_near_duplicates(empty)) == []


def test_edited_texts_are_near_and_others_are_not(spark):
    """Texts of 60 to 300 words: copies with one to three changed words go, texts that share a third of their words stay."""
    rng = random.Random(11)
    texts, copies = [], []
    for i in range(300):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 300))]
        texts.append((2 * i, " ".join(words)))
        edited = list(words)
        if i % 3:
            for at in rng.sample(range(len(words)), max(1, len(words) // 100)):  # similarity of 0.84 and more
                edited[at] = "changed"
            copies.append(2 * i + 1)
        else:
            edited[len(words) // 3:] = [f"v{rng.randrange(4000)}" for _ in edited[len(words) // 3:]]
        texts.append((2 * i + 1, " ".join(edited)))
    left = {r["doc_id"] for r in jaccard.without_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(2 * i in left for i in range(300)) and left >= {2 * i + 1 for i in range(0, 300, 3)}
    assert len(left & set(copies)) <= 0.1 * len(copies)


def test_components_of_blocks_and_rounds(spark):
    """Random links, a chain and a node that most are linked with, in one block, in several and in rounds."""
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1, 1), (2, 3), (2, 3)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    want = {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for block in (1 << 17, 200, 1):
        assert {r["node"]: r["label"] for r in components.components(edges, block).collect()} == want, block
    assert components.components(edges.where("false")).count() == 0
