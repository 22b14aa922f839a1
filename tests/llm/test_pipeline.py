"""The pipeline against its stages by brute force."""

import random
import re
from collections import Counter

import corpus_pipeline

from lodestar.llm import jaccard, langid, mixing, packing, simhash


def test_pipeline(spark, docs, rows, tmp_path):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL AND doc_id NOT IN (30, 31)")
    plain.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = [r.asDict() for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()]

    left = {r["doc_id"]: r["text"] for r in plain.collect() if any(map(str.isalpha, r["text"] or ""))}
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for d, t in sorted(left.items()):
        last[fold(t)] = d
    left = {d: left[d] for d in last.values()}
    root, _ = groups_slowly(left)
    left = {d: t for d, t in left.items() if root[d] == d}
    kept = plain.where(plain["doc_id"].isin(list(left)))
    mixed = Counter(r["doc_id"] for r in mixing.mixed(kept).collect())
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == mixed
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= packing.CAPACITY


def test_stages_on_nothing(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]
    assert langid.UNKNOWN == "und"


def shingles(text):
    """The set of a text's runs of five words, A-Z lower-cased; fewer words are one run."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def groups_slowly(texts):
    """{doc_id: smallest doc_id} over all pairs with a Jaccard similarity of 0.8 and more, and those pairs' similarities."""
    sets, root, found = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}, {}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                found[a, b] = shared / (len(sets[a]) + len(sets[b]) - shared)
    for _ in ids:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    return root, found


def staged(spark, texts):
    """The doc_ids that the near-duplicate stage keeps."""
    return {r["doc_id"] for r in jaccard.without_near_duplicates(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}


def test_every_pair_of_the_required_similarity_is_found(spark, monkeypatch):
    """Pairs just at 0.8 of texts of 20 to 300 words, and one group of copies in lists that take several rounds."""
    monkeypatch.setattr(jaccard, "HUBS", 2)
    monkeypatch.setattr(jaccard, "MORE", 2)
    rng, texts = random.Random(5), {}
    for i in range(250):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(20, 300))]
        texts[2 * i] = " ".join(words)
        n = len(words) - 4
        edits, k = list(words), 0
        while True:  # as many changed words, far from each other, as 0.8 allows
            k += 1
            at = 4 + 5 * (k - 1) + 1
            if 9 * (n - 5 * k) < 8 * n or at + 5 > len(words):
                break
            edits[at] = f"changed{i}"
        texts[2 * i + 1] = " ".join(edits)
    base = [f"b{rng.randrange(9000)}" for _ in range(120)]
    for d in range(1000, 1060):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 4)):
            words[at] = f"x{rng.randrange(9000)}"
        texts[d] = " ".join(words)
    root, found = groups_slowly(texts)
    assert sum(s < 0.83 for s in found.values()) > 100
    assert staged(spark, texts) == {d for d in texts if root[d] == d}


def test_texts_below_the_required_similarity_stay(spark):
    """Short texts that differ in the last word or two (0.67), and long ones at 0.7 to 0.79, whatever their fingerprints."""
    rng, texts = random.Random(6), {}
    for i in range(200):
        words = [f"w{rng.randrange(9000)}" for _ in range([9, 14, 200][i % 3])]
        texts[2 * i] = " ".join(words)
        if i % 3 < 2:
            words[-1 - i % 3:] = ["last"] * (1 + i % 3)
        else:
            for k in range(rng.randrange(5, 7)):
                words[5 + 10 * k] = "changed"
        texts[2 * i + 1] = " ".join(words)
    assert not groups_slowly(texts)[1]
    assert staged(spark, texts) == set(texts)


def test_simhash_groups_come_before_the_join(spark, monkeypatch):
    """Copies within two fingerprint bits have one label when the join begins; a pair that is proposed but below 0.8 has not."""
    rng, labels = random.Random(7), []
    base = [[f"w{rng.randrange(9000)}" for _ in range(600)] for _ in range(5)]
    texts = {10 * i + k: " ".join(words[:-1] + [f"end{k}"]) for i, words in enumerate(base) for k in range(10)}
    texts |= {1000 + i: " ".join(f"v{rng.randrange(9000)}" for _ in range(50)) for i in range(40)}
    proposed, joined = jaccard.fingerprint_pairs, jaccard.candidates

    def more(fps):
        one, two = (fps.where(f"least = {d}").selectExpr(f"sid AS {c}") for d, c in ((1020, "a"), (1030, "b")))
        return proposed(fps).union(one.crossJoin(two))

    def noted(posted, *rounds):
        labels.append({r["sid"]: r["label"] for r in posted.select("sid", "label").distinct().collect()})
        return joined(posted, *rounds)

    monkeypatch.setattr(jaccard, "fingerprint_pairs", more)
    monkeypatch.setattr(jaccard, "candidates", noted)
    assert staged(spark, texts) == {d for d in texts if d >= 1000 or d % 10 == 0}
    bits = {d: simhash.fingerprint(t) & (2 ** 64 - 1) for d, t in texts.items()}
    near = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= 2]
    assert len(near) > 20
    assert sorted(n for n in Counter(labels[0].values()).values() if n > 1) == sorted(components_slowly(near))


def components_slowly(pairs):
    """The sizes of what ``pairs`` join up."""
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return list(Counter(root.values()).values())


def test_fingerprint_pairs(spark):
    """The SimHash index's groups of random fingerprints with two bits changed in turn, by brute force."""
    rng, bits = random.Random(8), []
    for _ in range(60):
        x = rng.getrandbits(64)
        bits.append(x)
        for _ in range(rng.randrange(4)):
            for at in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << at
            bits.append(x)
    fps = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(bits)], "sid long, bits long")
    pairs = [(a, b) for a in range(len(bits)) for b in range(a + 1, len(bits)) if (bits[a] ^ bits[b]).bit_count() <= 2]
    root = list(range(len(bits)))
    for _ in bits:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {(r["a"], r["b"]) for r in jaccard.fingerprint_pairs(fps).collect()} == {(r, i) for i, r in enumerate(root) if r != i}


def test_short_lists_are_paired_in_one_round(spark):
    """Lists of up to WHOLE times as many members as hubs leave nothing for another round; a pair of several lists comes once."""
    most, size = jaccard.WHOLE * jaccard.HUBS, 100 << 32
    posted = spark.createDataFrame([(s, i, size + s, i) for s in range(3) for i in range(most)] + [(9, i, size, i) for i in range(most + 1)], "shingle long, sid long, n_at long, label long")
    out = [tuple(r) for r in jaccard.candidates(posted.where("shingle < 9").coalesce(1), jaccard.HUBS).select("a", "b").collect()]
    assert all(b is not None for _, b in out) and set(out) == {(a, b) for a in range(most) for b in range(a + 1, most)}
    left = [tuple(r) for r in jaccard.candidates(posted.where("shingle = 9"), jaccard.HUBS).where("b IS NULL").select("a").collect()]
    assert len(left) == most + 1
