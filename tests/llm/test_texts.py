"""Tokens, licences, quality, language, toxicity, mixing: against libraries, brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import byte_bpe, language_id, license_scan, mixing, quality, token_counts, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n x", "日本語 😀 é", "<|endoftext|>don't I'LL", "a" * 3000, " " * 700, "-=" * 900, "ΑΣ ΟΔΟΣ İx", "½ ³ ٣ 12345", "a\x1cb\x85c", "".join(map(chr, range(32, 1500)))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(ODD)] + [(None, "null id", None, 0), (3, ODD[3], "s", 3)], "doc_id long, text string, source string, n int").withColumns({"ids": F.lit("clash"), "host": F.lit(1)})


def test_bpe_equals_the_library(spark, docs, odd):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for df in (docs, odd):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
            want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in byte_bpe.round_trip(df, path, P.PATTERN).collect()) == want
    coded = byte_bpe.encode_documents(odd, path, P.PATTERN)
    assert {r.doc_id: r.text for r in byte_bpe.decode_documents(coded, path, P.PATTERN).collect()} == {r.doc_id: r.text or "" for r in odd.collect()}
    assert byte_bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0


def test_streaming_keeps_characters_whole_and_lookahead_bounded():
    codec = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    text = "é日😀x" * 50
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    decoder = byte_bpe.StreamDecoder(codec.transducer.table)
    assert "".join([*(decoder.feed([i]) for i in ids), decoder.finish()]) == text
    small = byte_bpe.MergeTransducer(codec.transducer.ranks, hold=16)
    piece = b"antidisestablishmentarianism" * 200
    parts = list(small.stream(piece))
    assert len(parts) > 100 and b"".join(np.array(p, "<u4").tobytes() for p in parts) == codec.transducer.encode_piece(piece)
    decoder = byte_bpe.StreamDecoder([b"\xff", b"\xe2\x82", b"a"])
    assert decoder.feed([0]) + decoder.feed([1]) + decoder.finish() == "��"


@pytest.mark.parametrize("chunk,group", [(8 << 20, 64), (20_000, 2)])
def test_token_counts_equal_the_library(spark, docs, odd, monkeypatch, chunk, group):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    monkeypatch.setattr(token_counts, "PARTITIONS", group)
    odd = odd.union(spark.createDataFrame([(2**62 + 1, "la " * 70_000 + "<|endoftext|>", "s", 0, "x", 1), (None, "no<|endoftext|>id", "s", 0, "x", 1)], odd.schema))

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, odd, odd.limit(0)):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False)), n > 50) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in token_counts.count_tokens(df, path, 50).collect()) == want


def test_licence_base_equals_brute_force(spark, docs, odd):
    notice = "MIT License, mit license. Apache--License; GNU General\nPublic License v3"
    more = spark.createDataFrame([(1, notice), (2, "permit license"), (3, "MIT licensed")], "doc_id long, text string")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for df in (docs, odd, more):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate(low))
            at = [(i, x) for p, x in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            want[r.doc_id, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
        got = license_scan.scan(df).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def notices():
    return [(label, text) for label, text, _ in license_scan.TEMPLATES]


def labels_by_brute_force(found, index):
    """label -> best share over all templates and all starts."""
    best = {}
    for t, body in enumerate(index.words):
        rare = [(w, p) for w, posts in index.postings.items() for k, p in posts if k == t]
        for start in range(-len(body), len(found)):
            votes = sum(0 <= start + p < len(found) and found[start + p] == w for w, p in rare)
            if votes and votes >= index.needed[t] and (share := license_scan.share_at(found, t, start, index)):
                best[index.labels[t]] = max(share, best.get(index.labels[t], 0.0))
    return best


def test_licence_labels_equal_brute_force(spark, docs):
    index = license_scan.Index()
    rng = np.random.RandomState(5)
    rows = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) < 150]
    for label, text in notices():
        w = text.split()
        rows += [text, " ".join(reversed(w)), "Copyright 2020\n" + " ".join(x if rng.rand() > 0.2 else "other" for x in w) + " end", " ".join(w[: len(w) // 2])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        want = labels_by_brute_force(license_scan.words(rows[r.doc_id].encode()), index)
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == base | set(want)
        assert r.score == max([0.5 if base else 0.0, *want.values()])
    assert license_scan.scan(df.limit(0)).count() == 0


def test_licence_notices_are_found_by_position(spark):
    body = notices()[0][1]
    broken = " ".join(reversed(body.split()))
    df = spark.createDataFrame([(1, f"x y z {body.upper()} more"), (2, broken), (3, "This work is licensed under CC-BY-NC 4.0."), (4, body.replace("copy", "copies"))], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in license_scan.scan(df.withColumns({"labels": F.lit("clash"), "found": F.lit(1)})).collect()}
    assert got[1] == ("mit", 1.0) and got[2] == ("", 0.0) and got[3] == ("cc-by-nc", 1.0) and got[4][0] == "mit"


def test_every_notice_of_a_file_is_found(spark):
    every = notices()
    groups = [(a, b) for i, a in enumerate(every) for b in every[i + 1 :]] + [tuple(every)]
    df = spark.createDataFrame([(i, "\n".join(text for _, text in g)) for i, g in enumerate(groups)], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.scan(df).collect()}
    assert all(got[i] >= {label for label, _ in g} for i, g in enumerate(groups))
    alone = spark.createDataFrame(list(enumerate(text for _, text in every)), "doc_id long, text string")
    for r in license_scan.scan(alone).collect():
        assert every[r.doc_id][0] in r.labels.split(",") and r.score == 1.0


def quality_by_brute_force(rows, limit):
    """Expected rows for (doc_id, text, host)."""
    word, holders, lines = re.compile(r"[^\x20\x09-\x0D]+"), {}, []
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text, host in rows:
        own = Counter()
        for line in (text or "").split("\n"):
            if w := word.findall(line.translate(low)):
                own[re.sub("[0-9]+", "0", " ".join(w))] += len(w)
        lines.append(own)
        for key in own:
            holders.setdefault((host or "", key), set()).add((None, text) if doc_id is None else doc_id)
    want = Counter()
    for (doc_id, text, host), own in zip(rows, lines):
        text = text or ""
        w = word.findall(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        gone = sum(n for key, n in own.items() if len(holders[host or "", key]) > limit)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed, not failed and len(w) - gone >= quality.LEFT * len(w), gone] += 1
    return want


def test_quality_equals_brute_force(spark, docs, odd):
    for df in (docs, odd, odd.limit(0)):
        want = quality_by_brute_force([tuple(r) for r in df.select("doc_id", "text", "source").collect()], quality.LIMIT)
        assert Counter(map(tuple, quality.assess(df).collect())) == want


def test_frequent_lines_by_documents_not_rows(spark):
    """Production limit: repeated rows are one document, rows without an id are told apart by text, hosts count apart."""
    body = [" ".join(f"w{'ab'[i % 2]}{'x' * i}{'y' * k}" for k in range(40)) for i in range(40)]
    head = "Header  {}\n" + " ".join(f"menu{k}" for k in range(60))
    rows = [(i, f"{head.format(i)}\n{body[i]}", "big") for i in range(quality.LIMIT + 1)]
    rows += [(3, rows[3][1], "big")] * 2 + [(4, f"{head.format(7)}\n{body[9]} more", "big"), (None, rows[5][1], None), (None, rows[5][1], None)]
    rows += [(100 + i, f"{head.format(i)}\n{body[i]}", "small") for i in range(quality.LIMIT)] + [(100, f"{head.format(0)}\n{body[0]}", "small")] * 5
    rows += [(200 + i % 3, f"{head.format(i)}\n{body[i]}", None) for i in range(20)] + [(None, f"{head.format(i)}\n{body[i]}", "anonymous") for i in range(quality.LIMIT + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit("x"), "row": F.lit(1), "doc": F.lit(2), "key": F.lit(3)}).repartition(4)
    got = quality.assess(df).collect()
    assert Counter(map(tuple, got)) == quality_by_brute_force(rows, quality.LIMIT)
    gone = {r.doc_id: (r.kept, r.n_removed_words) for r in got if r.doc_id is not None}
    assert gone[0] == (False, 62) and gone[3] == (False, 62) and gone[100] == (True, 0) and gone[200][0]


def test_frequent_lines_leave_the_texts(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"Header  {i}\n{body}\nown line {'x' * (i + 1)}", "h") for i in range(10)] + [(50, f"{body}\n{body.upper()}", "other"), (51, body + "\n" + " ".join(f"q{i}z" for i in range(300)), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.n_removed_words) for r in quality.assess(df, limit=3).collect()}
    assert all(got[i] == (False, 62) for i in range(10))
    assert got[50][1] == 0 and got[51] == (True, 60)
    frequent = quality.frequent_lines(quality.line_rows(df), 3)
    assert {r.doc_id: r.text for r in quality.clean_lines(df, frequent).collect()}[0] == "own line x"


def test_language_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_language_mixture_and_nothing(spark, odd):
    model = language_id.Model({x: np.bincount(language_id.trigrams(w.encode().split())[0], minlength=language_id.BUCKETS) for x, w in {"a": "lorem ipsum dolor sit amet " * 20, "b": "zwei drei vier acht zehn " * 20}.items()})
    df = spark.createDataFrame([(1, "lorem ipsum dolor " * 30 + "drei vier " * 15), (2, "zehn acht"), (3, "12 34 !"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.languages) for r in language_id.identify(df, model).collect()}
    assert got == {1: ("a", "a,b"), 2: ("b", "b"), 3: ("und", ""), 4: ("und", "")}
    assert language_id.identify(odd, model).count() == odd.count()
    assert {r.lang_pred for r in language_id.identify(df, language_id.Model({})).collect()} == {"und"}


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    print("toxic found", hit, "of", sum(r.toxic for r in got), "predicted", sum(r.predicted for r in got), "of", len(got))
    assert hit / sum(r.predicted for r in got) > 0.9 and hit / sum(r.toxic for r in got) > 0.75


def test_length_makes_nothing_toxic(spark):
    """Blank lines, repeated and distinct clean sentences, and ten megabytes of them stay clean under a model that knows toxic
    words; one toxic sentence among them is found."""
    model = toxicity.learned(spark, "/root/testdata/sf0.01")
    memo = model.word_scores()
    distinct = b". ".join(b"value number%d of line%d" % (i * 7919, i) for i in range(30000))
    for text in (b"\n" * 30000, b"..." * 10000, b"Nice day. " * 30000, b"a. " * 30000, distinct, (distinct + b". ") * 10, b"", b" "):
        assert toxicity.document_score(text, memo) < 0.05
    rows = [(1, "\n" * 30000), (2, None), (3, "Nice day. " * 30000), (4, distinct.decode() + ". you worthless scum, pathetic idiot. bye")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, model).collect()}
    assert max(got[1], got[2], got[3]) < 0.05 and got[4] >= 0.7
    assert sorted(r.doc_id for r in toxicity.without_toxic(df, model).collect()) == [1, 2, 3]


def test_toxic_sentences_are_located(spark, odd):
    bags = [(f"nice day number{i}. you are awful{i % 3} scum{i % 4}. bye now".encode(), 1) for i in range(40)] + [(f"nice day number{i}. you are kind. bye now".encode(), 0) for i in range(80)]
    model = toxicity.fit(bags, epochs=40)
    df = spark.createDataFrame([(1, "bye now. you are scum1! nice day"), (2, "nice day. bye now")], "doc_id long, text string")
    assert {(r.doc_id, r.sentence) for r in toxicity.locate(df, model).collect()} == {(1, 1)}
    scores = toxicity.score_documents(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    empty = toxicity.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score < 0.01 for r in toxicity.score_documents(odd, empty).collect())


def earliest_deadlines(weights):
    """The schedule by trying all sources in each slot."""
    slots, given, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        released = [s for s, w in weights.items() if given[s] < w and given[s] * slots // w <= t]
        due = lambda s: ((-(-(given[s] + 1) * slots // weights[s])), (given[s] + 1) * slots % weights[s] == 0, -weights[s], s)
        out.append(min(released, key=due))
        given[out[-1]] += 1
    return out


def test_pfair_keeps_every_source_within_a_block():
    rng = np.random.RandomState(3)
    for n in (1, 2, 9, 40, 700):
        weights = mixing.whole_weights({f"s{i}": float(x) for i, x in enumerate(rng.rand(n) ** 3 + 1e-6)})
        slots = sum(weights.values())
        assert slots == max(mixing.SLOTS, 2 * n) and min(weights.values()) >= 1
        given = Counter()
        for t, s in enumerate(mixing.period(weights), 1):
            given[s] += 1
            if n < 100:
                assert all(abs(given[k] - w * t / slots) < 1 for k, w in weights.items())
        assert given == weights
        if n < 100:
            assert mixing.period(weights) == earliest_deadlines(weights)
    assert mixing.whole_weights({"a": 0.0, "b": 1.0}) == {"a": 1, "b": 999} and sum(mixing.whole_weights({"a": 0.0, "b": 0.0, "c": 0.0}).values()) == 1000


def test_mixture_equals_brute_force(spark, docs):
    """Ranks, blocks, slots and places of all documents, with given targets."""
    rows = [(r.doc_id, r.source) for r in docs.select("doc_id", "source").collect()] + [(10**6, None), (None, "src1"), (7, "src1")]
    sizes = Counter(s or "" for _, s in rows)
    for target in (None, {"src1": 5.0, "src2": 1.0}):
        weights = mixing.whole_weights(mixing.tempered(sizes) if target is None else {s: target.get(s, 1.0) for s in sizes})
        slots = earliest_deadlines(weights)
        at = {s: [t for t, x in enumerate(slots) if x == s] for s in weights}
        want = Counter()
        for s, w in weights.items():
            own = sorted((hashlib.md5((str(i) if i is not None else "").encode()).hexdigest(), i) for i, x in rows if (x or "") == s)
            for rank, (_, i) in enumerate(own):
                block = rank // mixing.BLOCK
                want[i, s, block, block // w * len(slots) + at[s][block % w], rank % mixing.BLOCK] += 1
        out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), target)
        assert Counter(tuple(r) for r in out.select("doc_id", "_source", "_block", "_slot", "_place").collect()) == want


def test_mixture_of_more_sources_than_slots(spark):
    rows = [(i, f"host{i % 1500}") for i in range(6000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), block=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and len({(r._slot, r._place) for r in got}) == 6000
    assert len({r._source for r in got if r._slot < 3000}) == 1500


def test_mixture_holds_every_row_once(spark, odd):
    rows = [(i, "big" if i % 3 else "small", str(i)) for i in range(2000)] + [(5000, None, "x"), (5001, "rare", None), (7, "big", "7")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mixed(df, block=4)
    got = out.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows)
    assert len({(r._slot, r._place) for r in got}) == len(got)
    share = Counter(r._source for r in got if r._slot < 200)
    assert abs(share["big"] / (share["big"] + share["small"]) - 2**0.5 / (1 + 2**0.5)) < 0.02
    clash = odd.withColumns({"_slot": F.lit("x"), "_bucket": F.lit("mine"), "_row": F.lit(1)})
    assert {(r._bucket, r._row) for r in mixing.mixed(clash).collect()} == {("mine", 1)}
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(odd.limit(0)).count() == 0
