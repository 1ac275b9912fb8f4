import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import chat, html_main, langid, mixing
from faultline.llm.packing import PieceEncoder, pack_documents

from .fixtures import documents, empty, texts

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(BPE)
    odd = ["", " ", "  x", "x  ", "\n x", "a\n\n\nb \t c", "12ab 3²½x", "it's we'll", "<|endoftext|> x", "a <|endoftext|> b", " a b", "\x1c\x85"]
    points = [chr(c) for c in range(1, 0x3000) if c != 39]
    odd += ["".join(points[k : k + 40]) + " " + "  ".join(points[k : k + 40]) for k in range(0, len(points), 40)]
    every = texts() + odd
    got = PieceEncoder(BPE).encode(every)
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in every]


def test_pieces_cover_every_id_once(spark):
    docs = documents(spark).repartition(3)
    encoder = PieceEncoder(BPE)
    rows = pack_documents(docs, BPE, 128, with_ids=True).collect()
    want = sorted((repr(r["doc_id"]), encoder.encode([r["text"] or ""])[0].tolist() + [1]) for r in docs.collect())
    pieces, at = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at[r["sequence_id"]] = r["offset"] + r["length"]
        key = (repr(r["doc_id"]), r["sequence_id"] * 128 + r["offset"] - r["start"])
        pieces.setdefault(key, []).extend(r["ids"])
    assert sorted((k[0], v) for k, v in pieces.items()) == want
    assert set(list(at.values())[:-1]) <= {128} and sorted(at) == list(range(len(at)))
    assert pack_documents(empty(spark), BPE).count() == 0


def test_languages_are_told_apart(spark):
    rng = np.random.default_rng(4)
    syllables = {"xx": ["ka", "lo", "mi", "zu"], "yy": ["ber", "schn", "tal", "gut"]}
    rows = []
    for k in range(400):
        lang = "xx" if k // 4 % 2 else "yy"
        rows.append((k, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(1 + k % 30)), lang))
    rows += [(900, None, "xx"), (901, "12 !?", None), (902, "", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train_models(docs.where("doc_id % 4 <> 2"), F.col("doc_id") % 4 == 1)
    out = {r["doc_id"]: r for r in langid.identify(docs, models, ["doc_id"]).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and r[0] < 900]
    assert sum(out[k]["lang_pred"] == lang for k, _, lang in held) == len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {out[k]["lang_pred"] for k in (900, 901, 902)} == {"und"}
    strange = langid.identify(spark.createDataFrame([("qwq xkcd vvv wqx " * 9,)], "text string"), models, []).first()
    assert strange["rejected"] and not out[held[-1][0]]["rejected"]


def test_probabilities_sum_to_one():
    models = langid.train({"a": {"banana": 3, "band": 1, "ban": 2}, "b": {"nab": 1}})
    symbols = sorted({ord(c) for c in "band"})
    total = 0.0
    for s in [*symbols, langid.END]:
        framed = np.array([langid.START, ord("b"), ord("a"), s], np.uint64)
        hashes = langid._gram_hashes(framed)
        p = np.full((1, 2), 1 / models.alphabet)
        for k in range(1, 5):
            weight = langid._look_up(models.contexts[k - 1], models.weights[k - 1], hashes[k - 1][2:3], 1.0) if k > 1 else models.weights[0]
            p = langid._look_up(models.grams[k - 1], models.shares[k - 1], hashes[k][3:4], 0.0) + weight * p
        total += p[0, 0]
    assert 0.9 < total <= 1 + 1e-9  # the rest is for letters never seen


def test_without_labels_there_is_no_language(spark):
    models = langid.train_models(empty(spark), F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(documents(spark), models, ["doc_id"]).collect()} == {"und"}


def test_rates_meet_targets_and_kkt(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(["good", "fine", "nice"] if k % 4 else ["bad", "vile", "ugly"], 20 + k % 9))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rate", F.lit("clash"))
    labelled = spark.createDataFrame([(k, "plus" if k % 4 else "minus") for k in range(120)], "doc_id long, domain string")
    out, mixture = mixing.mix_sources(docs, labelled, {"plus": 0.5, "minus": 0.5})
    got = out.collect()
    p, tokens, rate = np.array([r["posteriors"] for r in got]), np.array([r["n_tokens"] for r in got]), np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and (p.argmax(1) == [mixture.domains.index("plus" if r["doc_id"] % 4 else "minus") for r in got]).all()
    after = (tokens * rate) @ p
    assert np.allclose(after, mixture.after, rtol=1e-6)
    # The plain solution of the same least squares, iterated long enough.
    budget, plain, before = tokens.sum(), np.ones(len(got)), tokens @ p
    for _ in range(4000):
        residual = ((tokens * plain) @ p - budget * 0.5) / before
        plain = np.maximum(0, plain - (p @ residual + mixing.STIFFNESS * (plain - 1)) / (1 + mixing.STIFFNESS))
    assert np.abs(rate - plain).max() < 0.05
    assert np.abs(after / budget - 0.5).max() < 0.05


@pytest.mark.parametrize("share", [0.02, 0.1, 0.9])
def test_rates_settle_whatever_the_anchor_holds(spark, share):
    rng = np.random.default_rng(2)
    p = np.where(rng.random((2000, 1)) < share, [[0.97, 0.02, 0.01]], [[0.02, 0.9, 0.08]])
    described = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(1, 400, 2000), p, strict=True)], "n_tokens long, posteriors array<double>")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    _, fit = mixing.solve(described, ["a", "b", "c"], weights, "a", 0.1)
    assert np.isclose(fit.targets.sum(), 1.1 * fit.before[0] / 0.5) and np.isclose(fit.targets[0] / fit.targets.sum(), 0.5)
    rates = fit.after / fit.before
    assert (rates >= 0).all() and rates.max() < 60
    # c has no documents of its own, so its target can't be reached; the fit says so, and is the least squares one.
    assert not np.isclose(fit.after[2], fit.targets[2], rtol=0.02)
    rows = described.collect()
    tokens, q, plain = np.array([r["n_tokens"] for r in rows]), np.array([r["posteriors"] for r in rows]), np.ones(len(rows))
    for _ in range(20000):
        plain = np.maximum(0, plain - (q @ (((tokens * plain) @ q - fit.targets) / fit.before) + mixing.STIFFNESS * (plain - 1)) / (1 + mixing.STIFFNESS))
    assert np.allclose(fit.after, (tokens * plain) @ q, rtol=0.03)


def test_copies_are_the_rates_on_average(spark):
    rows = [(k, f"{'plus' if k % 3 else 'minus'} word{k % 7} " * 5) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(k, "plus" if k % 3 else "minus") for k in range(300)] + [(1, "plus"), (1, "plus")], "doc_id long, domain string")
    out, fit = mixing.mix_sources(docs, labelled, {"plus": 0.8, "minus": 0.2}, "plus", margin=0.1)
    got = out.collect()
    p, tokens = np.array([r["posteriors"] for r in got]), np.array([r["n_tokens"] for r in got])
    drawn = (tokens * np.array([r["copies"] for r in got])) @ p
    assert np.allclose(fit.after, fit.targets, rtol=0.02) and np.allclose(drawn, fit.targets, rtol=0.05)
    assert abs(np.mean([r["copies"] - r["rate"] for r in got])) < 0.03


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    out, _ = mixing.mix_sources(documents(spark), none, {})
    assert {(r["rate"], r["copies"]) for r in out.collect()} == {(1.0, 1)}
    out, _ = mixing.mix_sources(empty(spark), none, {"x": 1.0})
    assert out.count() == 0


def brute_cut(odds, edges):
    best = None
    for mask in range(1 << len(odds)):
        keep = [bool(mask >> k & 1) for k in range(len(odds))]
        cost = sum(max(0, o) for o, x in zip(odds, keep, strict=True) if not x) + sum(max(0, -o) for o, x in zip(odds, keep, strict=True) if x) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    rng = np.random.default_rng(7)
    for _ in range(80):
        n = int(rng.integers(1, 9))
        odds = rng.normal(0, 1.2, n).round(2).tolist()
        edges = [(int(a), int(b), round(float(c), 2)) for a, b, c in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.uniform(0, 1, 12), strict=True) if a != b]
        keep = html_main.minimum_cut(odds, edges)
        cost = sum(max(0, o) for o, x in zip(odds, keep, strict=True) if not x) + sum(max(0, -o) for o, x in zip(odds, keep, strict=True) if x) + sum(c for a, b, c in edges if keep[a] != keep[b])
        assert abs(cost - brute_cut(odds, edges)) < 1e-6


PAGE = """<html><head><title>t &amp; t</title><script>var a = "</p><p>no";</script></head><body><div id="cookie-notice">We use cookies, accept them.</div>
<header>Site</header><nav><a href=x>Home</a></nav><article><h1>Head &amp; more</h1><p>First  paragraph<br>with a break.<p>Ok.<div class="ad">Buy</div><p>Last &eacute;.</p></article>
<div class="comments"><p>A reader says this at some length, with a stop.</p></div><aside>Side</aside><form>Name</form><footer>&copy; x</footer>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "no tags at all, just text. " * 3)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_main.extract_main_text(pages, ["page_id", "url"]).collect()}
    assert out[1]["text"] == "Head & more\n\nFirst paragraph with a break.\n\nOk.\n\nLast é." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == out[3]["text"] == "" and out[2]["n_chars"] == 0
    assert html_main.extract_main_text(pages.limit(0), ["page_id"]).count() == 0


def test_one_name_does_not_lose_the_article():
    inner = "<article><p>One.<p>Two.</article>"
    for names in ("layout has-sidebar", "with-nav", "no-comments"):
        assert [b.evidence for b in html_main.blocks_of(f'<div class="{names}">{inner}</div>')] == [1, 1]
    assert [b.evidence for b in html_main.blocks_of(f'<div class="sidebar">{inner}<p>Three.</div>')] == [0, 0, -1]
    comment = '<div class="comments"><article class="comment"><p>One.</article></div>'
    assert [b.evidence for b in html_main.blocks_of(comment)] == [-1]
    for hidden in ("<nav>", "<footer>", '<div class="sidebar" hidden>'):
        assert [b.evidence for b in html_main.blocks_of(hidden + inner)] == [-1, -1]


def test_neighbours_and_classifier_overrule_a_name():
    weights = np.zeros(html_main._SHAPES)
    weights[3], weights[6] = 2.0, 1.0  # paragraphs, ends of sentences
    page = "<article><p>One.<p>Two.<p class=notice>Three.<p>Four.<p>Five.<div class=ad>Buy</div><p>Six.</article>"
    assert html_main.main_text(page, weights) == "One.\n\nTwo.\n\nThree.\n\nFour.\n\nFive.\n\nSix."


@pytest.mark.parametrize("text", ["", "<|im_end|>", "\\", "\\<|", "<\\|im_end|>", "a\n<|im_start|>user\nx", "<<||>>", "\\\\<|im_end|>\\"])
def test_turns_round_trip(text):
    turns = [("user", text), ("assistant", text), (f"odd\n{text}", "x"), ("assistant", "")]
    formatted, spans = chat.format_turns(turns)
    assert chat.parse_turns(formatted) == turns
    assert [chat.unescape(formatted[s : s + n]) for s, n in spans] == [text, ""]


def test_trees_become_ranked_paths(spark):
    rows = [(1, 0, None, "user", "q"), (1, 1, 0, "assistant", "a"), (1, 2, 0, "assistant", ""), (1, 3, 1, "user", "r"), (1, 4, 3, "assistant", "s"), (2, 9, 8, "user", "lost parent"), (None, 5, None, None, None)]
    messages = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string")
    paths = chat.leaf_paths(messages).collect()
    assert sorted((repr(r["conv_id"]), r["leaf"], r["node"], r["up"]) for r in paths) == [("1", 2, 0, 1), ("1", 2, 2, 0), ("1", 4, 0, 3), ("1", 4, 1, 2), ("1", 4, 3, 1), ("1", 4, 4, 0), ("2", 9, 9, 0), ("None", 5, 5, 0)]
    both = {(r["conv_id"], r["rank"]): r for r in chat.format_conversations(messages, 2).collect()}
    assert both[1, 1]["leaf"] == 4 and both[1, 2]["leaf"] == 2 and both[1, 1]["n_turns"] == 4
    assert chat.parse_turns(both[1, 1]["formatted"]) == [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "s")]
    assert both[None, 1]["formatted"] == "<|im_start|>\n<|im_end|>\n"


def test_circles_are_broken_at_their_smallest_message(spark):
    rows = [(1, 5, 7, "user", "a"), (1, 6, 5, "assistant", "b"), (1, 7, 6, "user", "c"), (1, 9, 7, "assistant", "leaf"), (2, 1, 1, "user", "self"), (3, 1, None, "user", "x"), (3, 2, 1, "assistant", "y"), (3, 2, 1, "assistant", "z"), (4, 1, 2, "user", "p"), (4, 2, 1, "user", "q")]
    messages = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string")
    found = {}
    for r in chat.leaf_paths(messages).collect():
        found.setdefault((r["conv_id"], r["leaf"]), []).append((r["up"], r["node"]))
    # 5 is the root of 6, 7 and 9; 1 that replies to itself is a root; 1 is the root of 2 in conversation 4.
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {(1, 9): [9, 7, 6, 5], (2, 1): [1], (3, 2): [2, 1], (4, 2): [2, 1]}
    out = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(messages).collect()}
    assert chat.parse_turns(out[3]) == [("user", "x"), ("assistant", "y")]


def test_long_chains_end(spark):
    rows = [(1, k, k - 1 if k else None, "user", str(k)) for k in range(150)]
    paths = chat.leaf_paths(spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string"))
    assert sorted((r["up"], r["node"]) for r in paths.collect()) == [(k, 149 - k) for k in range(150)]


def test_linear_conversations_read_back(spark):
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "c"), (3, None, "user", "x")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.as_reply_tree(turns))).collect()}
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nc\n").hexdigest()
    assert (out[1]["loss_chars"], out[1]["loss_sha256"]) == (2, hashlib.sha256(b"bc").hexdigest())
    assert out[3]["loss_chars"] == 0 and out[3]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(chat.as_reply_tree(turns.limit(0)))).count() == 0
