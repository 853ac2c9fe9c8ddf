import hashlib
import random
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from synblock.llm import bpe, edits, html, html_labels, quality
from synblock.llm.queries import PATTERN, RANKS

FOLDER = "/root/testdata/sf0.001"
ALPHABET = [*"ab'sdtre.,  \n\t\r\x0b\x0c\x1c\x85\xa0　é漢0١½_-!?😀​᠎", "'ll", " the", "tion", "\n\n"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(RANKS)), special_tokens={})


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "a" * 3000, "ab" * 2000, " \n" * 40, "<|endoftext|>", "x" * 70000 + " y"]


def test_encoder_equals_library(library):
    sample = texts(3000, 1)
    for batch in (sample, sample[:5]):  # both ways of replaying merges
        encoder = bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN)
        for t, ids in zip(batch, encoder.encode(batch), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)


def test_codec_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(50, 2))] + [(None, "null id", "x"), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encoded(docs, RANKS, PATTERN, decode=True).collect()
    assert len(out) == len(rows)
    want = {(i, (t or "").encode()) for i, t, _ in rows}
    assert {(r["doc_id"], bytes(r["decoded"])) for r in out} == want
    for r in out:
        assert r["n_tokens"] == len(library.encode_ordinary(bytes(r["decoded"]).decode()))
        assert hashlib.sha256(bytes(r["ids"])).digest() == hashlib.sha256(np.array(library.encode_ordinary(bytes(r["decoded"]).decode()), "<u4").tobytes()).digest()
    again = bpe.decoded(bpe.encoded(docs, RANKS, PATTERN), RANKS).collect()
    assert {(r["doc_id"], bytes(r["decoded"])) for r in again} == want
    assert bpe.encoded(docs.limit(0), RANKS, PATTERN).collect() == []


def test_edits_count_like_whole_texts(library):
    rng = random.Random(4)
    counter = edits.Counter(bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), PATTERN))
    for _ in range(300):
        leaf = rng.choice([4, 16, 256])
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 60, 400])))
        tree = edits.Tree(*counter.runs([text], leaf)[0])
        for _ in range(5):
            at, delete, insert = rng.randrange(len(text) + 3), rng.choice([0, 0, 1, 3, 50]), "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 3, 40])))
            a = min(at, len(text))
            want = text[:a] + insert + text[a + delete :]
            text, tree, _ = edits.apply_edit(text, tree, counter, at, delete, insert, leaf)
            assert text == want
            assert tree.n_tokens() == len(library.encode_ordinary(want))
            tree = edits.Tree.unpack(tree.pack())


def test_edits_over_tables(spark, library):
    rows = [(1, "one two three " * 200, 5), (2, "", 5), (3, None, 5), (None, "x y", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tree int")
    wanted = spark.createDataFrame([(1, 1, 10, 5, "zzz"), (1, 2, 0, 3, None), (2, 1, 4, 4, "new text"), (3, 1, None, None, "a")], "doc_id long, seq int, at long, delete long, insert string")
    state = edits.with_edits(edits.trees(docs, RANKS, PATTERN), wanted)
    out = {r["doc_id"]: r for r in edits.edited(state, RANKS, PATTERN).collect()}
    first = rows[0][1][:10] + "zzz" + rows[0][1][15:]
    assert out[1]["text"] == first[3:] and out[2]["text"] == "new text" and out[3]["text"] == "a" and out[None]["text"] == "x y"
    for r in out.values():
        assert r["n_tokens"] == len(library.encode_ordinary(r["text"]))
    assert out[1]["n_encoded"] < len(first) / 2
    fused = edits.followed(docs.drop("tree").join(state.select("doc_id", "edits"), "doc_id", "left"), RANKS, PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in fused if r["doc_id"]} == {k: r["n_tokens"] for k, r in out.items() if k}


def test_html_tree_reads_its_table():
    by, wrong, n = html.classifier(), 0, 0
    for page in html_labels.labelled():
        found = html.blocks(page, by.weights)
        for b, row in zip(found, html.features(found), strict=True):
            n += 1
            wrong += html.predict(by.tree, row) != (b.text[0] == "+")
    assert n > 100 and wrong <= 0.02 * n


def verdicts(by, pages, is_article):
    """Of all blocks: features that decided, verdict, truth, and what element names alone would say."""
    for page in pages:
        found = html.blocks(page or "", by.weights)
        for b, row in zip(found, html.features(found), strict=True):
            yield *html.path(by.tree, row), is_article(b), b.element.article and not b.element.furniture


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_words_and_links_decide_first(spark):
    by = html.classifier()
    pages = [r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("html").collect()]
    found = list(verdicts(by, pages, lambda b: b.element.article))
    assert found and all(used[0] < len(html.TEXT) for used, *_ in found)
    assert all(said == true for _, said, true, _ in found)
    bare = list(verdicts(html.classifier(handicap=float("inf")), pages, lambda b: b.element.article))  # no names at all
    assert sum(said != true for _, said, true, _ in bare) <= 0.05 * len(bare)
    own = list(verdicts(by, html_labels.labelled(seed=5), lambda b: b.text[0] == "+"))
    assert sum(said != true for _, said, true, _ in own) < 0.05 * len(own)
    assert sum(said != names for _, said, _, names in own) > 0.1 * len(own)


def test_html_names_that_mislead():
    by, words = html.classifier(), lambda n: " ".join(["word"] * n)
    for name in ("side-note", "tags", "search", "share", "skip"):
        page = f"<nav><a>a</a><a>b</a></nav><article><h1>t</h1><p>{words(60)}</p><div class='{name}'><p>{words(50)}</p><p>{words(40)}</p></div></article><footer>f</footer>"
        assert html.main_text(page, by) == "t " + words(150), name


@pytest.mark.parametrize("piece", ["<a '", '<a "', "<a '>'", "<b>", "<button>", "<", "<!--", "</p>", "<p><blockquote>", "<div class=a>", "<!", "<!a", "<?x", "<![", "><!a"])
def test_html_hostile_pages_are_linear(piece):
    began = time.process_time()
    html.features(html.blocks(piece * (1_000_000 // len(piece))))
    assert time.process_time() - began < (1 if piece.startswith("<a") else 4)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One&nbsp;two &amp; three<br>four</article><footer>f</footer>", "T One two & three four"),
        ("<article><p>a < b &lt; c</p><script>var x='</p>';</script><p title='>'>d<!-- <p>no</p> -->e</p></article>", "a < b < c de"),
        ("<body><div class='ad'>buy</div><article><p><b>Unclosed bold<br><p>next   para</article><div id=comments><p>me too, a long comment that goes on and on</p></div>", "Unclosed bold next para"),
        ("<article><p>text</p><form><p>sign up</p></form><aside>side</aside><p>more</p></article>", "text more"),
    ],
)
def test_html_pages(page, text):
    assert html.main_text(page, html.classifier()) == text


def test_html_table(spark):
    rows = [(1, "u", "<article><p>héllo</p></article>", "c"), (1, "u", "<article><p>héllo</p></article>", "c"), (2, None, None, "c")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out) == [(1, "héllo", 5), (1, "héllo", 5), (2, "", 0)]


def slow_counts(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n_chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), n_chars, symbols, dup, len(marked)


def test_quality_counts():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "ü ", "#", "|", "\n", "a\n", "\x0b", "\x85", "word "]) for _ in range(rng.randrange(80)))
        assert quality.features(t.encode())[:5] == slow_counts(t)
    assert quality.features(None)[:5] == (0, 0, 0, 0, 0)


def test_frequent_words_are_exact(spark):
    rng = random.Random(12)
    words = {"en": ["the", "The", "of", *(f"e{i}" for i in range(400))], None: ["zu", *(f"n{i}" for i in range(90))], "one": ["x"]}
    rows = [(i, " ".join(rng.choice(words[x][: rng.choice([1, 3, 1000])]) for _ in range(rng.randrange(80))), x) for i in range(300) for x in [rng.choice(list(words))]] + [(1000, None, "en"), (1001, None, "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6, "doc_id")
    got = {r["key"]: (set(map(bytes, r["words"])), r["share"]) for r in quality.frequent_words(docs, least=0.01).collect()}
    for lang in ("en", None, "one", "void"):
        n = Counter(w for _, t, x in rows if x == lang for w in (t or "").lower().encode().split())
        want = {w for w, k in n.items() if k >= 0.01 * n.total()}
        own = got.get("" if lang is None else f"={lang}", (set(), 0.0))
        assert own[0] == want and abs(own[1] - sum(n[w] for w in want) / max(1, n.total())) < 1e-12


def test_candidates_are_few_whatever_the_languages_and_partitions(spark):
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{min(int(rng.expovariate(0.2)), rng.randrange(1, 60))}" for _ in range(rng.randrange(40))), f"l{rng.randrange(1000) if i % 3 else 0}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(200, "doc_id")
    few = quality.candidates(docs, least=0.05, fan=8).collect()
    assert max(len(r["words"]) for r in few) <= 20 and len(few) == len({x for _, t, x in rows if t})
    got = {r["key"]: set(map(bytes, r["words"])) for r in quality.frequent_words(docs, least=0.05).collect()}
    for lang in {x for _, _, x in rows}:
        n = Counter(w for _, t, x in rows if x == lang for w in t.encode().split())
        assert got.get(f"={lang}", set()) == {w for w, k in n.items() if k >= 0.05 * n.total()}


def test_summaries_hold_few_words_whatever_a_partition_has():
    texts = [(f"={i % 3}", b"The often " * 4 + b" ".join(b"word%d" % (i * 40 + j) for j in range(40))) for i in range(4000)]
    tracemalloc.start()
    out = list(quality.summaries(texts, most=20, held=2000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6 and len(out) == 1
    for own in out[0].values():  # at most a 21st of all 48 words a text is taken from a count
        assert len(own) <= 20 and {b"the", b"often"} <= set(own) and min(own[b"the"], own[b"often"]) > 1333 * (4 - 48 / 21)
    many = list(quality.summaries(((f"={i}", b"a a b") for i in range(5000)), most=20, held=1000))
    assert len(many) > 1 and max(sum(map(len, x.values())) for x in many) <= 1002
    total = Counter()
    for x in many:
        total.update({(k, w): n for k, own in x.items() for w, n in own.items()})
    assert total == Counter({(f"={i}", w): n for i in range(5000) for w, n in ((b"a", 2), (b"b", 1))})


def test_a_task_with_several_summaries_gives_every_word_once(spark):
    rows = [(i, "x x x y", f"l{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    few = quality.candidates(docs, least=0.2, held=100).collect()
    assert len(few) == 300 and all(sorted(map(bytes, r["words"])) == [b"x", b"y"] for r in few)


def slow_em(pattern, count, rounds=60):
    """Dawid and Skene with loops."""
    v, n = quality.votes(pattern), len(quality.RULES)
    start = [[[0.45, 0.35, 0.20]] * n, [[0.02, 0.18, 0.80]] * n]
    prior, table = 0.8, start
    for _ in range(rounds):
        tallies, weight = [[[0.0] * 3 for _ in range(n)] for _ in range(2)], [0.0, 0.0]
        for row, c in zip(v, count, strict=True):
            like = [1 - prior, prior]
            for y in range(2):
                for j in range(n):
                    like[y] *= table[y][j][row[j] + 1]
            for y in range(2):
                share = c * like[y] / sum(like)
                weight[y] += share
                for j in range(n):
                    tallies[y][j][row[j] + 1] += share
        table = [[[(tallies[y][j][k] + 2 * start[y][j][k]) / (weight[y] + 2) for k in range(3)] for j in range(n)] for y in range(2)]
        prior = (weight[1] + 8) / (sum(weight) + 10)
    return prior, np.array(table)


def test_em_equals_a_slow_one():
    rng = np.random.default_rng(3)
    pattern = np.unique(rng.integers(0, 3 ** len(quality.RULES), 200)).astype(np.int32)
    count = rng.integers(1, 500, len(pattern)).astype(float)
    for rounds in (1, 7, 60):
        prior, table = quality.fit(pattern, count, rounds)
        want, slow = slow_em(pattern, count, rounds)
        assert abs(prior - want) < 1e-7 and np.abs(table - slow).max() < 1e-7


def test_quality_model_separates_classes(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "of", "to", *[f"{chr(97 + i % 26)}ord{i}" for i in range(300)]] + ["and", "in"] * 20) for _ in range(120)) + "." for _ in range(150)]
    bad = [" ".join(f"{chr(97 + i % 26)}ord{rng.randrange(300)}***" for i in range(100)) for _ in range(20)] + ["SHOUT " + " ".join(f"WORD{rng.randrange(400)}!!" for _ in range(90)) for _ in range(20)]
    rows = [(i, t, 1) for i, t in enumerate(good + bad)] + [(1000, None, 1), (1001, "short", 1), (None, good[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = quality.judged(docs).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert kept == {*range(150), None}
    left = quality.filtered(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == kept
    assert quality.judged(docs.limit(0)).collect() == [] and quality.filtered(docs.limit(0)).collect() == []
