import itertools
import random
import re
from array import array

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytequarry.llm import minhash_bbit, nbest_pieces, pii_crf, ppm_langid
from bytequarry.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, band int"


def frame(spark, rows, lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), "s", 0, "k", 3) for i, t in rows], SCHEMA)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(x for x in (least.get(find(i)), doc) if x is not None) if (least.get(find(i)), doc) != (None, None) else None
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def near_corpus(seed=3):
    rnd = random.Random(seed)
    words = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    rows, shared = [], words(60)
    for family in range(12):
        base = words(rnd.randint(20, 200))
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 60)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words(1))
            rows.append(" ".join(copy))
    rows += [" ".join(words(30) + shared + words(30)) for _ in range(25)]
    rows += [rows[0]] * 8 + ["", None, "  \n", "One two", "one  TWO", "one two three", "É one two three four five", "É ONE two three four five"]
    rows.append(" ".join(words(20000)))
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1000, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_bbit, "BLOCK", block)
    rows = near_corpus()
    out = minhash_bbit.near_duplicates(frame(spark, rows).repartition(3)).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert got == sorted(brute_groups(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_without_broadcasts_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(minhash_bbit, "BROADCAST_IDS", 0)
    text = "a b c d e f g h i j k l m n"
    rows = [(None, text), (4, text + " o"), (4, text + " o"), (9, text), (1, "other words altogether here now"), (1, None), (None, None)]
    out = minhash_bbit.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"] or 0), (r["component_id"] or 0)) for r in out) == [(0, 0), (0, 4), (1, 1), (1, 1), (4, 4), (4, 4), (9, 4)]
    left = minhash_bbit.without_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, ""), (1, ""), (1, "other words altogether here now"), (4, text + " o")]
    assert minhash_bbit.near_duplicates(frame(spark, [])).count() == 0
    assert minhash_bbit.without_duplicates(frame(spark, [])).count() == 0


def test_estimate_follows_the_true_similarity(spark):
    texts = [" ".join(f"x{i}" for i in range(a, a + 400)).encode() for a in (0, 40, 100, 5000)]
    value, starts = minhash_bbit.shingle_sets(texts)
    _, packed, _ = minhash_bbit.signatures(value, starts)
    rows = spark.createDataFrame([(packed[0].tolist(), p.tolist()) for p in packed], "a array<long>, b array<long>")
    got = [r[0] for r in rows.select(minhash_bbit.estimate("a", "b")).collect()]
    for e, t in zip(got, (1.0, 356 / 436, 296 / 496, 0.0)):
        assert abs(e - t) < 0.13


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["key"]: r["root"] for r in out} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def brute_base(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(pii_crf.KINDS.index(k), m.start(), m.end()) for k, m in out]


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("1245 .-+()@ab255é") for _ in range(rnd.randint(0, 70))) for _ in range(5000)]
    texts += ["4111 1111 1111 1111, 4111-1111-1111-1112", "x@y.z.w@q.r a..b@c-d.e", "+1 (017) 555-7713", "é" * 10 + " 255.1.2.3.4.5.6.7 256.1.1.1"]
    for text in texts:
        assert pii_crf.base_spans(text) == brute_base(text), text


TRAIN = [f"call +1 ({i:03d}) 555-7{i:03d} or 555-7{i:03d} and mail a{i}@x{i}.org about {i * 37} things in {1900 + i}" for i in range(100)]


def test_second_mentions_and_clean_texts(spark):
    field = pii_crf.train(TRAIN)
    found = pii_crf.find_spans(field, ["Call +1 (017) 555-7713 now, later 555-7713. In 1999 there were 12345678 things.", "Call 555-7713, 555-7713.", "", None])
    base, added = found[0]
    assert base == [(3, 5, 22)] and added == [(3, 34, 42)]
    assert found[1:] == [([], []), ([], []), ([], [])]
    text = "Call +1 (017) 555-7713 now, later 555-7713. mail a@b.co"
    assert pii_crf.redact_text(text, [s for part in pii_crf.find_spans(field, [text])[0] for s in part]) == "Call [PHONE] now, later [PHONE]. mail [EMAIL]"
    out = pii_crf.detect(frame(spark, [(1, text), (1, text), (None, None), (2, ""), (3, "x" * 300_000 + " a@b.co")]), field).collect()
    assert [(r["n_email"], r["n_phone"], r["n_added"]) for r in out] == [(1, 1, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 0, 0)]
    assert out[0]["spans"] == "email:49:55,phone:5:22,phone:34:42"
    assert pii_crf.detect(frame(spark, []), pii_crf.fit(frame(spark, []))).count() == 0


def test_a_number_repeated_fifty_times_is_found_every_time():
    field = pii_crf.train(TRAIN)
    again = " Then 5557713000 again, they said." * 50
    clean = "Call +1 (555) 771-3000." + " Then 1234567890 apples." * 50
    found = pii_crf.find_spans(field, ["Call +15557713000 now." + again, again + " Call +15557713000.", clean])
    assert [(len(base), len(added)) for base, added in found] == [(1, 50), (1, 50), (1, 0)]
    assert found[:1] == pii_crf.find_spans(field, ["Call +15557713000 now." + again])


def test_marginals_are_exact_on_a_chain():
    import numpy as np

    field = pii_crf.train(TRAIN)
    block = pii_crf._Block([], [], [], [])
    pii_crf._graph("+1 555 1234 77", [], block)
    block.far.clear()
    got = pii_crf.marginals(field, block, rounds=60)
    unary = np.stack([field.unary[f].sum(0) for f in block.features])
    want = np.zeros_like(got)
    for labels in itertools.product(range(5), repeat=len(block.label)):
        score = sum(unary[i, x] for i, x in enumerate(labels)) + sum(field.near[labels[a], labels[b]] for a, b in block.near)
        for i, x in enumerate(labels):
            want[i, x] += np.exp(score)
    assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 1e-6


@pytest.mark.parametrize(
    "text",
    [
        "+15557713000 5557713000 5557713000 12 5557713000",
        "a@b.cd a@b.cd, 5557713000 +15557713000 5557713000",
        "4111111111111111 x 4111-1111-1111-1111 1111111 9 1111111",
        "10.0.0.1 7 10.0.0.1 10.0.0.1 7",
    ],
)
def test_loopy_documents_agree_with_enumeration(text):
    """Beliefs of message passing against the sum over all labellings, skip edges and clamped tokens included."""
    import numpy as np

    field = pii_crf.train(TRAIN)
    for base in (pii_crf.base_spans(text), []):
        block = pii_crf._Block([], [], [], [])
        pii_crf._graph(text, base, block)
        edges = len(block.near) + len(block.far) + len(block.held)
        assert block.far and (edges >= len(block.label) or not base)  # loops
        got = pii_crf.marginals(field, block)
        unary = np.stack([field.unary[f].sum(0) for f in block.features])
        want = np.zeros_like(got)
        choices = [[x] if x else range(5) for x in block.label]
        for labels in itertools.product(*choices):
            score = sum(unary[i, x] for i, x in enumerate(labels) if not block.label[i])
            score += sum(field.near[labels[a], labels[b]] for a, b in block.near) + sum(field.far[labels[a], labels[b]] for a, b in block.far + block.held)
            for i, x in enumerate(labels):
                want[i, x] += np.exp(score)
        want /= want.sum(1, keepdims=True)
        assert (got.argmax(1) == want.argmax(1)).all() and np.abs(got - want).max() < 0.1
        sure = want.max(1) >= pii_crf.CONFIDENCE
        assert (got.max(1)[sure] >= pii_crf.CONFIDENCE - 0.02).all()


def slow_bits(counts, order, text, alphabet):
    """Code length by the definition: escape method C with exclusion, byte by byte."""
    import math

    bits = 0.0
    for i, byte in enumerate(text):
        ruled = set()
        for n in range(min(order, i), -1, -1):
            seen = {b: c for b, c in counts.get(text[i - n : i], {}).items() if b not in ruled}
            total, distinct = sum(seen.values()), len(seen)
            if not total:
                continue
            if byte in seen:
                bits -= math.log2(seen[byte] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
            ruled |= set(seen)
        else:
            bits += math.log2(max(1, alphabet - len(ruled)))
    return bits


def test_code_lengths_by_definition():
    samples = {"a": ["abracadabra abra"], "b": ["xylophone zebra xylem"]}
    model = ppm_langid.train(samples, order=2, contexts=10_000)
    used = set(b"".join(t.encode() for v in samples.values() for t in v))
    contexts = {}  # the most that a language sees it
    for v in samples.values():
        own = {}
        for t in v:
            for n in range(3):
                for i in range(len(t) - n + 1):
                    own[t[i : i + n].encode()] = own.get(t[i : i + n].encode(), 0) + 1
        contexts |= {c: max(k, contexts.get(c, 0)) for c, k in own.items()}
    for text in (b"abra", b"xylem zebra", b"cab"):
        for k, v in enumerate(samples.values()):
            counts = {}
            for t in v:
                t = t.encode()
                for n in range(3):
                    for i in range(n, len(t)):
                        if n == 0 or contexts[t[i - n : i]] >= 2:
                            at = counts.setdefault(t[i - n : i], {})
                            at[t[i]] = at.get(t[i], 0) + 1
            got = ppm_langid.code_lengths(model, [text])[0, k]
            assert abs(got - slow_bits(counts, 2, text, len(used) + 1)) < 1e-3


def test_language_of_held_out_texts(spark):
    rnd = random.Random(1)
    syllables = {"en": ["the", "ing", "er", "and"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "que", "é", "le"]}
    make = lambda x: " ".join("".join(rnd.choice(syllables[x]) for _ in range(3)) for _ in range(12))
    langs = [["en", "de", "fr"][i % 3] for i in range(300)]
    rows = [(i, make(x)) for i, x in enumerate(langs)]
    docs = frame(spark, rows + [(900, None), (901, "123 !!"), (902, "the " * 90_000), (902, "the " * 90_000)], lambda i: langs[i] if i < 300 and i % 7 else None)
    model = ppm_langid.fit(docs)
    out = ppm_langid.predict(docs, model).withColumn("held_out", ppm_langid.held_out("doc_id")).collect()
    ours = [r for r in out if r["doc_id"] < 300]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in ours) / len(ours) > 0.97 and any(r["held_out"] for r in ours)
    assert [(r["lang_pred"], r["score"]) for r in out if r["doc_id"] in (900, 901)] == [("und", 0.0)] * 2
    assert [r["lang_pred"] for r in out if r["doc_id"] == 902] == ["en"] * 2
    assert all(0 <= r["score"] <= 1 for r in out)
    assert ppm_langid.predict(frame(spark, []), model).count() == 0
    assert ppm_langid.predict(frame(spark, [(1, "the")], lambda i: None), None).first()["lang_pred"] == "und"


def test_lanes_and_blocks_do_not_change_code_lengths(monkeypatch):
    for order in (1, 4, 10):
        _lanes(monkeypatch, ppm_langid.train({"a": ["some words of a text " * 20], "b": ["quelques mots d'un texte " * 20]}, order))


def _lanes(monkeypatch, model):
    texts = [b"some words", b"", b"q" * 3000, b"mots d'un texte " * 200, b"x"]
    whole = ppm_langid.code_lengths(model, texts)
    for lanes in (1, 3, 50):
        monkeypatch.setattr(ppm_langid, "LANES", lanes)
        assert abs(ppm_langid.code_lengths(model, texts) - whole).max() < 1e-3
    alone = [ppm_langid.code_lengths(model, [t])[0] for t in texts]
    assert abs(alone - whole).max() < 1e-3


def test_long_texts_are_walked_in_pieces(monkeypatch):
    rnd = random.Random(5)
    for _ in range(60):
        sizes = [rnd.choice([0, 1, 3, 4, 5, 6, 40, 400]) for _ in range(rnd.randint(0, 4))]
        word = lambda: (b"W%d" % rnd.randint(0, 60)) * rnd.choice([1, 1, 1, 9]) + rnd.choice([b" ", b"\n\n", b"\t"])
        texts = [rnd.choice([b"", b"  "]) + b"".join(word() for _ in range(n)) for n in sizes]
        whole = minhash_bbit.shingle_sets(texts)
        for chunk in (7, 50, 333):
            monkeypatch.setattr(minhash_bbit, "CHUNK", chunk)
            got = minhash_bbit.sets_of(texts)
            assert got[0].tolist() == whole[0].tolist() and got[1].tolist() == whole[1].tolist()


def test_training_samples_are_bounded(spark):
    rows = [(None, f"call +1 555 771 {i:04d} now, number {i}") for i in range(300)] + [(None, None), (1, "9" * 5000)] + [(2, "mail a@b.cd")] * 50
    docs = frame(spark, rows)
    seen = []
    for rows_, bytes_ in ((20, 1 << 20), (1000, 1 << 20), (1000, 400)):
        taken = {}
        train, pii_crf.train = pii_crf.train, lambda texts: taken.setdefault("t", texts)
        try:
            pii_crf.fit(docs, train_rows=rows_, train_bytes=bytes_)
        finally:
            pii_crf.train = train
        assert len(taken["t"]) <= rows_ and len(set(taken["t"])) == len(taken["t"]) and sum(map(len, taken["t"])) <= bytes_
        seen.append(len(taken["t"]))
    assert seen[0] > 0 and seen[1] == 302 and 5 < seen[2] < 20
    model = ppm_langid.fit(docs, rows_per_language=7)
    assert model is not None and model.languages == ["en"]


def every_path(pieces, group):
    if not group:
        yield 0.0, []
    for n in range(1, min(len(group), pieces.longest) + 1):
        score = pieces.score.get(group[:n], pieces.unknown_score if n == 1 else None)
        if score is not None:
            for s, ids in every_path(pieces, group[n:]):
                yield score + s, pieces.ids(group[:n]) + ids


@pytest.mark.parametrize("text", ["a  b", "hello wor", "naïve,", "x\n yz", "the cat", "  ", "日本 a", "a", "1.5 (b)"])
def test_nbest_equals_all_paths(text):
    pieces = nbest_pieces.load()
    every = sorted((s for s, _ in every_path(pieces, "▁" + text.replace(" ", "▁"))), reverse=True)
    got = pieces.encode(text, 6)
    assert [s.score for s in got] == every[:6]
    assert len({s.ids for s in got}) == len(got)
    assert all(pieces.decode(array("i", s.ids)) == text and s.whole for s in got)


def test_groups_solved_together_are_those_solved_alone(monkeypatch):
    pieces = nbest_pieces.load()
    texts = ["", "The quick brown fox", "日本 語 a▁b ▁▁ x", "Straße 🙂🙂 naïveté", None, "a  b\n\n c", "q" * 300 + " tail", " lead and trail ", "0123 45.6 +(x)"] * 3
    alone = [None if t is None else [pieces.solve(g) for g in pieces.groups(t)] for t in texts]
    for chars in (1, 30, 1 << 19):
        monkeypatch.setattr(nbest_pieces, "BATCH_CHARS", chars)
        pieces.forget()
        got = list(pieces.encode_all(texts))
        assert len(got) == len(texts)
        for text, best, groups in zip(texts, got, alone):
            if text is None:
                assert best == []
                continue
            assert best[0].score == pytest.approx(sum(g[0] for g in groups)) and best[0].ids == b"".join(g[1] for g in groups)
            assert all(s.whole and pieces.decode(array("i", s.ids)) == text for s in best)
            assert [s.score for s in best] == sorted((s.score for s in best), reverse=True)
    pieces.forget()
    assert not nbest_pieces.Pieces.spells(pieces, [pieces.id["a"]], "b")


def test_a_mark_of_the_text_itself_comes_back(spark):
    rows = [(1, "a▁b"), (2, "▁"), (3, "▁ ▁▁x "), (4, "a b")]
    out = nbest_pieces.encode_nbest(frame(spark, rows)).select("doc_id", F.explode("segmentations.ids").alias("ids"))
    assert {(r["doc_id"], r["text"]) for r in nbest_pieces.decode_ids(out).collect()} == set(rows)
    assert all(r["restored"] for r in nbest_pieces.segmentation_digests(frame(spark, rows)).collect())


def test_viterbi_and_search_agree_and_the_library_decodes():
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=nbest_pieces.MODEL)
    pieces = nbest_pieces.load()
    for text in ("The quick brown fox, jumping", "Straße naïveté", "a\tb\r\nc", "🙂 emoji", "word" * 40):
        for group in pieces.groups(text):
            best, ids, gap, whole = pieces.solve(group)
            found = pieces.paths(group, 2)
            assert (best, list(array("i", ids)), whole) == (*found[0], True)
            assert gap == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))
        assert processor.decode(list(array("i", pieces.encode(text, 1)[0].ids))) == text


def test_encoding_rows(spark):
    rows = [(1, "some text"), (1, "some text"), (None, None), (2, ""), (3, "x" * 50_000 + " y"), (4, " lead")]
    out = nbest_pieces.encode_nbest(frame(spark, rows))
    texts = nbest_pieces.decode_ids(out.where("segmentations is not null").select("doc_id", F.explode("segmentations.ids").alias("ids")))
    assert {(r["doc_id"], r["text"]) for r in texts.collect()} == {(i, t) for i, t in rows if t is not None}
    digests = nbest_pieces.segmentation_digests(frame(spark, rows)).collect()
    assert [r["restored"] for r in digests] == [True, True, None, True, True, True]
    assert [r["n_tokens"] for r in digests][2:4] == [None, 0]
    assert nbest_pieces.encode_nbest(frame(spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    rows = [(i, t) for i, t in near_corpus() if t is None or len(t) < 2000]
    rows += [(500, "mail me at someone@example.org or call +1 (017) 555-7713"), (501, "12345 !!")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "pieces":
            assert docs.columns == before.columns
        if name == "language":
            assert ids == {i for i, t in rows if t and re.search("[^\\W\\d_]", t)}
        elif name == "near_duplicates":
            left = [(i, t) for i, t in rows if i in {r["doc_id"] for r in before.select("doc_id").collect()}]
            assert ids == {c for _, _, c in brute_groups(left)}
        elif name == "personal_data":
            assert docs.where("doc_id = 500").first()["text"] == "mail me at [EMAIL] or call [PHONE]"
            assert docs.where("text like '%@%'").count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids", "scores"] and docs.count() > 10
